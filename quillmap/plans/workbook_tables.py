"""Workbooks made from the test tables, as rows of the binaryFile layout.

Every file of the grid becomes a real .xlsx archive, built where its rows are. A
file is cut into workbooks of ROWS_PER_WORKBOOK rows, so that none grows with the
data.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.plans import tables as t
from quillmap.schemas import FOLDER, WORKBOOK_FILE

ROWS_PER_WORKBOOK = 5
FIRST_ROW = t.HEADER_ROWS + 1
HEADERS = (["No", "Dim./Meas.", "Name", "Mapping"], ["", "type", "field", "rule"])
MODIFIED = "2001-08-01 12:00:00"
BROKEN, TWO_SHEETS = "Brand7_", "Brand9_"  # file names with these are broken / have a second sheet

NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def workbook_bytes(sheets: dict[str, list[tuple[int, list]]], frames: dict | None = None) -> bytes:
    """A workbook of (row number, cells) rows. Column A holds numbers, the others
    text: shared in B, inline in C, a formula's cached value in D. `frames` keeps the
    parts that tell the sheets, for the next workbook that has the same."""
    shared: dict[str, int] = {}

    def cell(row_no: int, column: int, value: str | None) -> str:
        if value is None:
            return ""
        place = f'r="{chr(65 + column)}{row_no}"'
        if column == 0 and value.lstrip("-").isdigit():
            return f"<c {place}><v>{value}</v></c>"
        if column == 2:
            return f'<c {place} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        if column == 3:
            kind = "e" if value.startswith("#") and value.endswith(("!", "?", "A")) else "str"
            return f'<c {place} t="{kind}"><f>A1</f><v>{escape(value)}</v></c>'
        number = shared.setdefault(value, len(shared))
        return f'<c {place} t="s"><v>{number}</v></c>'

    parts = []
    for i, rows in enumerate(sheets.values(), start=1):
        lines = "".join(
            f'<row r="{n}">' + "".join([cell(n, c, v) for c, v in enumerate(values)]) + "</row>"
            for n, values in rows
        )
        parts.append(_packed(
            f"xl/worksheets/sheet{i}.xml",
            f'<worksheet xmlns="{NAMESPACE}"><sheetData>{lines}</sheetData></worksheet>',
        ))
    texts = "".join([f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared])
    strings = _packed("xl/sharedStrings.xml", f'<sst xmlns="{NAMESPACE}">{texts}</sst>')
    frames, names = {} if frames is None else frames, tuple(sheets)
    if names not in frames:
        frames[names] = _frame(names)
    return _archive([*parts, *frames[names], strings])


def _packed(name: str, text: str) -> tuple[bytes, bytes, bytes]:
    """The name of an archive's member, what its headers say of it, and its packed bytes."""
    data = text.encode()
    packer = zlib.compressobj(zlib.Z_BEST_SPEED, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    # needs version 2.0, name in UTF-8, deflated, 1980-01-01
    told = struct.pack("<5H3L", 20, 0x800, 8, 0, 33, zlib.crc32(data), len(packed), len(data))
    return name.encode(), told, packed


def _frame(names: tuple[str, ...]) -> list[tuple[bytes, bytes, bytes]]:
    """The parts that tell which sheets there are."""
    entries = [f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(names, start=1)]
    relations = [
        f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>'
        for i in range(1, len(names) + 1)
    ]
    return [
        _packed(
            "xl/workbook.xml",
            f'<workbook xmlns="{NAMESPACE}" xmlns:r="{RELATIONS}"><sheets>{"".join(entries)}</sheets></workbook>',
        ),
        _packed("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{"".join(relations)}</Relationships>'),
    ]


def _archive(parts: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A zip archive of packed parts."""
    out, directory, at = [], [], 0
    for name, told, packed in parts:
        out += [b"PK\3\4", told, struct.pack("<2H", len(name), 0), name, packed]
        directory += [b"PK\1\2\x14\x03", told, struct.pack("<5H2L", len(name), 0, 0, 0, 0, 0o600 << 16, at), name]
        at += 30 + len(name) + len(packed)
    size = sum(map(len, directory))
    end = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(parts), len(parts), size, at, 0)
    return b"".join([*out, *directory, end])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    headers, frames = list(enumerate(HEADERS, start=1)), {}
    for batch in batches:
        contents, paths = [], batch.column("path").to_pylist()
        # column by column: a list of records made into Python objects at once takes many times as long
        rows = batch.column("rows")
        starts, records = rows.offsets.to_pylist(), rows.values
        numbers, cells = records.field("sheet_row").to_pylist(), records.field("cells")
        ends, values = cells.offsets.to_pylist(), cells.values.to_pylist()
        for i, path in enumerate(paths):
            lines = headers + [(numbers[r], values[ends[r] : ends[r + 1]]) for r in range(starts[i], starts[i + 1])]
            sheets = {"Rules": lines}
            if TWO_SHEETS in path:
                sheets["Extra"] = [(n, [*c[:1], "Extra", *c[2:]]) for n, c in lines]
            content = workbook_bytes(sheets, frames)
            contents.append(content[: len(content) // 2] if BROKEN in path else content)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), pa.array(contents, pa.binary())], names=["path", "content"]
        )


def workbook_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, modificationTime, length, content of all workbooks."""
    at = F.col("row_no") - FIRST_ROW
    part = F.floor(at / ROWS_PER_WORKBOOK)
    name = F.concat("file_stem", F.lit("_"), part.cast("string"), F.lit(".xlsx"))
    path = F.concat_ws("/", F.lit("/data/rules"), *FOLDER, F.lit("LdRules"), name)
    row = F.struct((at % ROWS_PER_WORKBOOK + FIRST_ROW).alias("sheet_row"), "cells")
    sheets = t.grid(spark, sf_dir).groupBy(path.alias("path")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    books = sheets.mapInArrow(_encode, "path string, content binary")
    names = [column.split()[0] for column in WORKBOOK_FILE.split(", ")]
    return books.withColumns(
        {"modificationTime": F.lit(MODIFIED).cast("timestamp"), "length": F.octet_length("content").cast("bigint")}
    ).select(*names)
