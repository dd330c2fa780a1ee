"""Word lists, patterns and thresholds that define the results."""

# --- fixed values: substring keyword lists (counted in lower-cased text) -----
KEYWORDS = (
    "if", "else", "for", "while", "switch", "case", "try", "catch", "finally",
    "throw", "throws", "public", "private", "protected", "static", "final",
    "return", "new", "import", "class", "interface", "enum",
)
EXTENDED_KEYWORDS = KEYWORDS + ("extends", "implements")
CONTROL_WORDS = ("if", "for", "while", "switch", "case")
EXCEPTION_WORDS = ("try", "catch", "throw", "throws", "finally")
SUSPICIOUS_WORDS = ("null", "fail", "error", "exception", "retry")
RISKY_API_WORDS = ("thread", "file", "socket", "inputstream", "system.exit")

# --- fixed values: commit mining --------------------------------------------
BUGFIX_WORDS = ("fix", "bug", "resolve", "patch", "defect", "error")
BUGFIX_WORDS_WIDE = BUGFIX_WORDS + ("issue",)
MESSAGE_FLAG_WORDS = ("fix", "bug", "patch")
LANGUAGE_SUFFIXES = (".java",)
MIN_CHANGED_LINES = 5
SOFT_LABEL_BELOW = 10
MIN_LINES_PER_SIDE = 3
LATEST_COMMITS = 200
MAX_DIFF_CHARS = 5000

# --- fixed values: lint patterns, as regular expressions with '.' = any but \n
LINT_PATTERNS = (r"TODO", r"FIXME", r"null", r"==", r"System\.exit", r"print\([^\n]*\)")

# --- fixed values: review ----------------------------------------------------
FORCE_RISK_MARKER = "FORCE_RISK"
PULL_REQUEST_EVENT = "pull_request"
PULL_REQUEST_ACTIONS = ("opened", "synchronize", "reopened")
LINTER_SOURCE = "Checkstyle"
NO_LINT_MESSAGE = "No message provided."
REVIEWER_SOURCE = "LLM"

# --- fixed values: TF-IDF risk ------------------------------------------------
RISKY_TOKENS = ("null", "catch", "synchronized", "thread", "system.exit", "exception")
VOCABULARY_SIZE = 1000
RISK_THRESHOLD = 0.5

# --- fixed values: text rules --------------------------------------------------
# The line breaks of Python's str.splitlines, CRLF counting as one.
BREAK_CLASS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029"
LINE_BREAK = rf"(?:\r\n|[{BREAK_CLASS}])"
BREAK_CHARS = ("\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
# A word character: letters and numbers of any script and the underscore.
WORD_CHAR = r"[\p{L}\p{N}_]"
# Whitespace of any script, as a character class body.
SPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
