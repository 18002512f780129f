"""Column functions that read filters out of plain-language questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmap.functions.cells import strip

# For every filter, the phrasings tried in turn. The first one that
# matches anywhere in the lower-cased question gives the value.
FIELD_PATTERNS = (
    r"(?:for|of)\s+['\"]([^'\"]+)['\"]",
    r"field[s]?\s+['\"]([^'\"]+)['\"]",
    r"mapping[s]?\s+for\s+['\"]([^'\"]+)['\"]",
    r"logic[s]?\s+for\s+['\"]([^'\"]+)['\"]",
    r"['\"]([^'\"]+)['\"]",
    r"(?:for|of)\s+(\w+)",
    r"field[s]?\s+(\w+)",
)
VALUE = r"['\"]?([^'\".,;\s]+)['\"]?"
DIMENSION_PATTERNS = (
    r"dimension[s]?\s+(?:is\s+)?" + VALUE,
    r"measure[s]?\s+(?:is\s+)?" + VALUE,
    r"dim\s+(?:is\s+)?" + VALUE,
)
MODULE_PATTERNS = (
    r"(?:in|for|from)\s+module\s+(?:is\s+)?" + VALUE,
    r"(?:where|and)\s+(?:my\s+)?module\s+(?:is\s+)?" + VALUE,
    r"module\s+(?:is\s+)?" + VALUE,
)
SOURCE_NAME_PATTERNS = (
    r"(?:where|and)\s+(?:my\s+)?source\s+name\s+(?:is\s+)?" + VALUE,
    r"(?:in|for|from)\s+source\s+name\s+(?:is\s+)?" + VALUE,
    r"source\s+name\s+(?:is\s+)?" + VALUE,
    r"(?:where|and)\s+(?:my\s+)?sourcename\s+(?:is\s+)?" + VALUE,
)
SOURCE_PATTERNS = (
    r"(?:where|and)\s+(?:my\s+)?source\s+(?:is\s+)?" + VALUE + r"(?!\s*name)",
    r"(?:in|for|from)\s+source\s+(?:is\s+)?" + VALUE + r"(?!\s*name)",
    r"source\s+(?:is\s+)?" + VALUE + r"(?!\s*name)",
)
VENDOR_PATTERNS = (
    r"(?:where|and)\s+(?:my\s+)?vendor\s+(?:is\s+)?" + VALUE,
    r"(?:in|for|from)\s+vendor\s+(?:is\s+)?" + VALUE,
    r"vendor\s+(?:is\s+)?" + VALUE,
)
OPERATOR_PATTERNS = (
    r"(?:where|and)\s+(?:my\s+)?operator\s+(?:is\s+)?" + VALUE,
    r"(?:in|for|from)\s+operator\s+(?:is\s+)?" + VALUE,
    r"operator\s+(?:is\s+)?" + VALUE,
)
# What parts vendor names, and how near "source name" a source is the name's.
VENDOR_SEPARATOR = r"\s+or\s+|\s+and\s+"
SOURCE_NAME_PHRASE = "source name"
SOURCE_NAME_REACH = 10

# Messages that are commands, by kind.
COMMANDS = {
    "help": ("help", "h", "?"),
    "list": ("list", "show all", "list all", "sources"),
    "stats": ("stats", "statistics", "info"),
    "cache_stats": ("cache stats", "cache", "cachestats"),
    "clear_cache": ("clear cache", "clearcache", "reset cache"),
}

FILTERS = ("field", "dimension", "source", "module", "source_name", "vendor", "operator")


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    """A capture is never empty, so an empty one means that the pattern did not match."""
    found = [F.nullif(F.regexp_extract(text, "(?U)" + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def parse_field(question: Column) -> Column:
    return _first_match(F.lower(question), FIELD_PATTERNS)


def parse_dimension(question: Column) -> Column:
    return _first_match(F.lower(question), DIMENSION_PATTERNS)


def parse_module(question: Column) -> Column:
    return _first_match(F.lower(question), MODULE_PATTERNS)


def parse_source_name(question: Column) -> Column:
    return _first_match(F.lower(question), SOURCE_NAME_PATTERNS)


def parse_source(question: Column) -> Column:
    """A phrasing counts only if no "source name" stands in or shortly after its match."""
    text = F.lower(question)
    found = []
    for p in SOURCE_PATTERNS:
        surroundings = F.regexp_extract(text, f"(?Us)(?:{p}).{{0,{SOURCE_NAME_REACH}}}", 0)
        value = F.nullif(F.regexp_extract(text, "(?U)" + p, 1), F.lit(""))
        found.append(F.when(~surroundings.contains(SOURCE_NAME_PHRASE), value))
    return F.coalesce(*found)


def parse_vendor(question: Column) -> Column:
    return strip(_first_match(F.lower(question), VENDOR_PATTERNS))


def parse_operator(question: Column) -> Column:
    return strip(_first_match(F.lower(question), OPERATOR_PATTERNS))


PARSERS = {
    "field": parse_field,
    "dimension": parse_dimension,
    "source": parse_source,
    "module": parse_module,
    "source_name": parse_source_name,
    "vendor": parse_vendor,
    "operator": parse_operator,
}


def split_vendors(vendor: Column) -> Column:
    """The alternatives of a vendor filter such as "nokia or ericsson"."""
    return F.transform(F.split(F.lower(vendor), "(?U)" + VENDOR_SEPARATOR), strip)


def message_kind(message: Column) -> Column:
    word = strip(F.lower(F.coalesce(message, F.lit(""))))
    kind = F.when(word == "", "empty")
    for name, spellings in COMMANDS.items():
        kind = kind.when(word.isin(*spellings), name)
    return kind.otherwise("search")


def message_text(message: Column) -> Column:
    """The question of a message as JSON text: a text, or a list of texts and records.

    Of a list the last part counts, a record by its `content`. A list that ends in anything
    else is taken by its own JSON text. What has no text, an empty list included, is empty;
    so are null and what is no JSON.
    """
    parsed = F.try_parse_json(message)
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    parts = F.when(is_list, parsed.cast("array<variant>"))
    last = F.try_element_at(parts, F.lit(-1))
    kind = F.schema_of_variant(last)
    content = F.try_variant_get(last, "$.content", "variant")
    has_content = kind.startswith("OBJECT") & F.array_contains(F.json_object_keys(F.to_json(last)), "content")

    def text_of(value: Column) -> Column:
        return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

    of_list = (
        F.when(F.size(parts) == 0, "").when(kind == "STRING", text_of(last)).when(has_content, text_of(content)).otherwise(message)
    )
    return F.coalesce(F.when(is_list, of_list).otherwise(text_of(parsed)), F.lit(""))
