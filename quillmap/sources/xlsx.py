"""Reads the rows of one workbook sheet from its bytes (zip archive of XML parts)."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, CELL, VALUE, INLINE, ITEM, TEXT, RUN = (MAIN + tag for tag in ("row", "c", "v", "is", "si", "t", "r"))
#: A sheet of more bytes of XML is read row by row, and each row let go; a shorter one is parsed at once.
STREAMED_FROM = 1 << 18
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show a date, a time or a duration.
DATE_FORMATS = frozenset({14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47})
DURATION_FORMATS = frozenset({46})


class SheetNotFound(Exception):
    """The workbook has no such sheet; the file is skipped, not broken."""


class _Archive:
    """The members of a zip archive in memory, found and unpacked without a file object for each.

    Only what is plain is read here: one disk, short sizes, names in ASCII, stored or deflated, and
    all of it as the directory says. Whatever is not, or is broken, is left to `zipfile`.
    """

    # as texts: the class goes to the tasks by value
    DIRECTORY, LOCAL, END = "<4s6H3L5H2L", "<4s5H3L2H", "<4s4H2LH"
    DIRECTORY_SIZE, LOCAL_SIZE, END_SIZE = map(struct.calcsize, (DIRECTORY, LOCAL, END))

    def __init__(self, content: bytes):
        self._content = content
        self._opened: zipfile.ZipFile | None = None
        self._members = self._plain_members() if isinstance(content, bytes) else None
        if self._members is None:
            self._slow()

    def __enter__(self) -> _Archive:
        return self

    def __exit__(self, *raised) -> None:
        if self._opened is not None:
            self._opened.close()

    def _slow(self) -> zipfile.ZipFile:
        if self._opened is None:
            self._opened = zipfile.ZipFile(io.BytesIO(self._content))
        return self._opened

    def _plain_members(self) -> dict[str, tuple[int, ...]] | None:
        """name -> (method, CRC, packed size, size, place of its header, place where the next part begins)."""
        content, members, starts = self._content, {}, []
        at = end = len(content) - self.END_SIZE
        if end < 0:
            return None
        mark, disk, first_disk, here, total, size, at, comment = struct.unpack_from(self.END, content, end)
        if mark != b"PK\5\6" or disk or first_disk or here != total or comment or at + size != end:
            return None
        start = at
        while at < end:
            if at + self.DIRECTORY_SIZE > end:
                return None
            mark, _, needs, flags, method, _, _, crc, packed, size, name, extra, comment, disk, _, _, place = struct.unpack_from(self.DIRECTORY, content, at)
            named = content[at + self.DIRECTORY_SIZE : (at := at + self.DIRECTORY_SIZE + name)]
            if mark != b"PK\1\2" or needs > 20 or flags & ~0x80E or method not in (0, 8) or extra or comment or disk or place >= start:
                return None
            if not named.isascii() or b"\0" in named or at > end:
                return None
            members[named.decode()] = (method, crc, packed, size, place)
            starts.append(place)
        if len(starts) != total:
            return None
        following = dict(zip(starts := sorted(starts), [*starts[1:], start]))
        return {name: (*m, following[m[-1]]) for name, m in members.items()}

    def _unpacked(self, name: str) -> bytes | None:
        method, crc, packed, size, place, following = self._members[name]
        mark, _, flags, kind, _, _, _, _, _, named, extra = struct.unpack_from(self.LOCAL, self._content, place)
        begin = place + self.LOCAL_SIZE + named + extra
        same = self._content[place + self.LOCAL_SIZE : begin - extra] == name.encode()
        if mark != b"PK\3\4" or flags & ~0x80E or kind != method or not same or begin + packed > following:
            return None
        data = self._content[begin : begin + packed]
        if method == 8:
            unpacker = zlib.decompressobj(-15)
            try:
                data = unpacker.decompress(data, size + 1)
            except zlib.error:
                return None
        return data if len(data) == size and zlib.crc32(data) == crc else None

    def namelist(self) -> list[str]:
        return list(self._members) if self._members is not None else self._slow().namelist()

    def __contains__(self, name: str) -> bool:
        return name in (self._members if self._members is not None else self._slow().NameToInfo)

    def size(self, name: str) -> int:
        return self._members[name][3] if self._members and name in self._members else self._slow().getinfo(name).file_size

    def read(self, name: str) -> bytes:
        data = self._unpacked(name) if self._members and name in self._members else None
        return self._slow().read(name) if data is None else data

    def open(self, name: str):
        return self._slow().open(name)


def sheet_rows(content: bytes, sheet: int | str, width: int) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, first `width` cell texts) of every row the sheet holds."""
    with _Archive(content) as book:
        workbook = _xml(book, "xl/workbook.xml")
        part = _sheet_part(book, workbook, sheet)
        strings = _shared_strings(book)
        styles = _date_styles(book)
        settings = workbook.find(MAIN + "workbookPr")
        mac_dates = settings is not None and settings.get("date1904") in ("1", "true")
        epoch = dt.datetime(1904, 1, 1) if mac_dates else dt.datetime(1899, 12, 30)
        row_no = 0
        for row in _rows(book, part):
            row_no = int(row.get("r", row_no + 1))
            cells: list[str | None] = [None] * width
            position, last = 0, 0
            for cell in row.iter(CELL):
                position = _column(cell.get("r")) or position + 1
                last = max(last, position)
                if position <= width:
                    cells[position - 1] = _text(cell, strings, styles, epoch)
            yield row_no, cells[: min(last, width)]


def _rows(book: _Archive, part: str) -> Iterator[ElementTree.Element]:
    """The row elements of a sheet, in their order."""
    if book.size(part) < STREAMED_FROM:
        yield from _xml(book, part).iter(ROW)
        return
    with book.open(part) as stream:
        rows = None
        for event, row in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                rows = row if row.tag == MAIN + "sheetData" else rows
                continue
            if row.tag != ROW:
                continue
            yield row
            row.clear()
            if rows is not None:
                rows.clear()  # else every empty row stays under it


def _xml(book: _Archive, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(book.read(name))


def _sheet_part(book: _Archive, workbook: ElementTree.Element, sheet: int | str) -> str:
    sheets = list(workbook.iter(MAIN + "sheet"))
    if isinstance(sheet, int):
        if not 0 <= sheet < len(sheets):
            raise SheetNotFound(f"sheet index {sheet} out of range")
        chosen = sheets[sheet]
    else:
        named = [s for s in sheets if s.get("name") == sheet]
        if not named:
            raise SheetNotFound(f"sheet {sheet!r} not found")
        chosen = named[0]
    targets = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    return posixpath.normpath(posixpath.join("/xl", targets[chosen.get(REL_ID)])).lstrip("/")


def _shared_strings(book: _Archive) -> list[str]:
    if "xl/sharedStrings.xml" not in book:
        return []
    return [_plain_text(item) for item in _xml(book, "xl/sharedStrings.xml").iter(ITEM)]


def _plain_text(item: ElementTree.Element) -> str:
    """Text of a string item: its own or its runs', without phonetic hints."""
    if len(item) == 1 and item[0].tag == TEXT and not len(item[0]):
        return item[0].text or ""
    texts = [item.find(TEXT), *(run.find(TEXT) for run in item.iter(RUN))]
    return "".join(t.text or "" for t in texts if t is not None)


def _date_styles(book: _Archive) -> dict[int, str]:
    """Cell style number -> "date" or "duration"."""
    if "xl/styles.xml" not in book:
        return {}
    root = _xml(book, "xl/styles.xml")
    own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(MAIN + "numFmt")}
    kinds = {}
    cell_styles = root.find(MAIN + "cellXfs")
    for number, style in enumerate([] if cell_styles is None else cell_styles):
        format_id = int(style.get("numFmtId", 0))
        if format_id in own:
            kind = _format_kind(own[format_id])
        elif format_id in DATE_FORMATS:
            kind = "date"
        else:
            kind = "duration" if format_id in DURATION_FORMATS else None
        if kind:
            kinds[number] = kind
    return kinds


def _format_kind(code: str) -> str | None:
    shown = re.sub(r'"[^"]*"|\\.|_.', "", code.split(";")[0])
    if re.search(r"\[(h+|m+|s+)\]", shown, re.I):
        return "duration"
    return "date" if re.search(r"[dmhys]", re.sub(r"\[[^\]]*\]", "", shown), re.I) else None


def _column(reference: str | None) -> int:
    number = 0
    for c in reference or "":
        if "A" <= c <= "Z":
            number = number * 26 + ord(c) - 64
        elif c.isalpha():
            number = number * 26 + ord(c.upper()) - 64
        else:
            break
    return number


def _text(cell: ElementTree.Element, strings: list[str], styles: dict[int, str], epoch: dt.datetime) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        item = cell.find(INLINE)
        return None if item is None else _plain_text(item)
    value = cell.find(VALUE)
    raw = None if value is None else value.text
    if raw is None:
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return str(bool(int(raw)))
    if kind == "d":
        return str(dt.datetime.fromisoformat(raw))
    if kind != "n":
        return raw
    number = float(raw) if re.search(r"[.eE]", raw) else int(raw)
    shown_as = styles.get(int(cell.get("s", 0)))
    if shown_as is None:
        return str(number)
    span = dt.timedelta(milliseconds=round(number * 86_400_000))
    if shown_as == "duration":
        return str(span)
    if dt.timedelta(0) <= span < dt.timedelta(days=1):
        return str((epoch + span).time())
    # the 1900 calendar counts a 29 February that never was
    missing_day = dt.timedelta(days=1 if epoch.year == 1899 and 0 <= span.days < 60 else 0)
    return str(epoch + missing_day + span)
