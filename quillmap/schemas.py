"""Explicit schemas of every table; nothing is inferred."""

FOLDER = ("source", "module", "source_name", "vendor")
KEY = (*FOLDER, "dimension", "field")

LISTING = "path string, modificationTime timestamp, length bigint"
WORKBOOK_FILE = LISTING + ", content binary"  # the layout of Spark's binaryFile source
DECODED = "path string, status string, error string, row_no bigint, cells array<string>, entry_key string"
META = "timestamp double, file_mtime double, file_path string, data_size bigint, cache_version bigint"
MANIFEST = (
    "entry_key string, file_path string, file_mtime double, timestamp double,"
    " data_size bigint, cache_version bigint, entry_bytes bigint, load_id string"
)
STATUSES = "path string, status string, error string, read_at double, load_id string"
RULES = (
    "source string, module string, source_name string, vendor string, file_stem string,"
    " row_no bigint, dimension string, field string, expression string,"
    " operator string, entry_key string, load_id string"
)
#: What a file has of each key: the part that counts are summed from.
KEY_COUNTS = (
    "source string, module string, source_name string, vendor string, file_stem string,"
    " dimension string, field string, expressions bigint, entry_key string, load_id string"
)
