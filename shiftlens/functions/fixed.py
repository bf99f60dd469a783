"""Sizes, names and texts that results must agree on."""

# Sizes.
CHUNK_ROWS = 5
BATCH_TEXTS = 50
TOP_K = 3

# Columns that are never shown.
CONFIDENTIAL = ("PUID", "SHIFT_ID", "ID")

# Chunk texts.
CELL = "{column}: "
CELL_SEPARATOR = " | "
MISSING = "None"
DATA_HEADER = "Data chunk:"
SCHEMA_HEADER = "Table schema:"
SCHEMA_LINE = "Column: {column}, Type: {type}"

# Responses.
SQL_FENCE = "```sql"
FENCE = "```"
ELLIPSIS = "..."
DETAILS = "\n\nDetailed results:\n"
NO_RESULTS = "No results found."

# Times: in messages, in the token log, and as date labels.
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
LOG_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"
TODAY = "Today"
YESTERDAY = "Yesterday"

# The characters that Python's str.split() and str.strip() take as white space: Unicode white space and
# the four ASCII separators.
WHITESPACE = r"[\s\x1C-\x1F]"
UNICODE_CLASSES = "(?U)"
