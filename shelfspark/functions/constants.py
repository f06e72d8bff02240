"""Fixed values the results depend on."""

# Record enums.
TYPES = ("decision", "rule", "feature", "guide", "map", "pitfall")
TYPE_ORDER = ("rule", "decision", "feature", "guide", "map", "pitfall")
SCOPES = ("dev", "repo", "global")
STATUSES = ("proposed", "accepted", "deprecated", "superseded")
SEVERITIES = ("must", "must-not", "should", "should-not")
RETIRED = ("superseded", "deprecated")
SCOPE_RANK = {"repo": 3, "global": 2, "dev": 1}
LINK_KINDS = ("pin", "record", "repo")

# Words that carry no meaning in a query.
STOPWORDS = tuple(
    (
        "a after an and are as at be before by do does for from how i in into is it its no not of on or our "
        "that the this to was we what when where which who why will with without you your"
    ).split()
)

# Limits.
TOP_K = 20
CANDIDATE_FACTOR = 3
VECTOR_FLOOR = 0.50
RRF_K = 60
EXPLORE_LIMIT = 30
SIMILAR_FLOOR = 0.80
SIMILAR_LIMIT = 20
FEATURE_FILES = 4
COMMIT_WINDOW = 500
FOLLOW_SECONDS = 30 * 60
WIDE_PATHS = 30
REVIEW_DAYS = 7
FILE_TEXT_BYTES = 8192
EXCERPT_FILES = 4
EXCERPT_FILE_BYTES = 2048
EXCERPT_TOTAL_BYTES = 24576
LOG_CLIP_BYTES = 65536
MAX_ATTEMPTS = 5
DOC_LINES = 24
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
SNIPPET_LEAD = 80
SNIPPET_WINDOW = 240

# Commands.
COUNTED_COMMANDS = ("search", "get", "map", "check", "remember", "update", "retire", "cite")
MAINTENANCE_COMMANDS = ("index", "embed", "import", "export", "publish", "status", "review")

# Query prefix for models that were trained with an instruction.
INSTRUCT_MODEL = "qwen3-embedding"
INSTRUCT_PREFIX = (
    "Instruct: Given a question about a software project's archive, retrieve the relevant record\nQuery:"
)

# File name extensions that are never indexed.
BINARY_EXTENSIONS = tuple(
    ".png .jpg .jpeg .gif .webp .ico .zip .tar .gz .pdf .woff .woff2 .exe .so .dylib .dll .wasm".split()
)

# Extensions the generic declaration scan leaves alone.
PROSE_EXTENSIONS = tuple(
    (
        ".md .markdown .txt .rst .adoc .json .jsonc .yaml .yml .toml .ini .cfg .conf .csv "
        ".html .htm .xml .svg .css .scss .sass .less .lock .sum .mod .log"
    ).split()
)
# Names the generic scan never reports.
DECLARATION_STOP_NAMES = tuple("a an and be for from if in is it not of or that the this to with".split())
# Modifiers and keywords of the generic declaration pattern.
DECLARATION_MODIFIERS = (
    r"pub(?:lic|\([^)]+\))?", "private", "protected", "internal", "export", "default", "async", "static",
    "final", "abstract", "override", "sealed", "open", "virtual", "partial", "unsafe", "extern", "mut",
    "crate", "readonly", "required", "inline", "data", "actual", "expect", "suspend", "tailrec",
    "operator", "infix", "reified", "inner", "value", "native",
)
DECLARATION_KEYWORDS = (
    "function", "defmodule", "typedef", "interface", "companion", "protocol", "object", "struct", "class",
    "trait", "union", "enum", "macro", "actor", "record", "impl", "module", "proc", "defp", "func", "fun",
    "fn", "def", "type", "sub",
)
FUNCTION_KEYWORDS = ("func", "fn", "fun", "def", "defp", "function", "proc", "sub", "macro")
IMPORT_PATTERN = r"(?i)^(?:export\s+)?(?:import|use|require|include|from)\s+([^\s;(]+)"
