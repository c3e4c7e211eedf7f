"""Fixed values. Results depend on these being exactly as they are."""

# --- File kinds -----------------------------------------------------------
# Extension -> language, and the extensions that are scanned.
LANGUAGE_BY_EXTENSION = {"py": "python", "java": "java", "c": "c", "h": "c"}
SUPPORTED_EXTENSIONS = ("py", "java", "c", "h")
MAX_FILE_SIZE_MB = 10
EDITOR_EXCLUDED_DIRS = (
    ".git", "node_modules", "dist", "build", ".venv", "venv", "__pycache__",
)

# --- Fragment geometry ----------------------------------------------------
WINDOW_LINES = 80
WINDOW_STRIDE = 60
MIN_TOKENS = 3

# --- Lexical patterns -----------------------------------------------------
# Line breaks recognised inside a text, and the token grammar.
# Word characters are letters, numbers, underscore and dollar in any script, and
# white space is the Unicode set; both are spelled out because the regular
# expression dialects disagree about the short forms.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
SPACE_CLASS = (
    " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680"
    "\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
TOKEN_ALTERNATIVES = (
    r"//[^\n]*",
    r"/\*[\s\S]*?\*/",
    r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"',
    r"'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'",
    r"(?<![\p{L}\p{N}_])\p{Nd}+(?:\.\p{Nd}+)?(?![\p{L}\p{N}_])",
    r"[A-Za-z_$][\p{L}\p{N}_$]*",
    r">>>?=?", r"<<=?", r"==", r"!=", r"<=", r">=", r"&&", r"\|\|",
    r"\+\+", r"--", r"\*\*", r"//", r"[-+*/%&|^]=", r"->",
    "[^" + SPACE_CLASS + "]",
)
TOKEN_PATTERN = "|".join(TOKEN_ALTERNATIVES)
# The same grammar for engines without look-around or possessive repetition;
# used by the SQL checks.
TOKEN_PATTERN_PLAIN = (
    r"//[^\n]*|/\*[\s\S]*?\*/|"
    r'"(?:\\[^\n]|[^"\\])*"|' r"'(?:\\[^\n]|[^'\\])*'|"
    r"\b\d+(?:\.\d+)?\b|[A-Za-z_$][\p{L}\p{N}_$]*|"
    r">>>?=?|<<=?|==|!=|<=|>=|&&|\|\||\+\+|--|\*\*|//|[-+*/%&|^]=|->|\S"
)
IDENTIFIER_PATTERN = r"^[\p{L}\p{Nl}_$][\p{L}\p{N}\p{Mn}\p{Mc}_$]*$"
IDENTIFIER_STRICT_PATTERN = r"^[\p{L}\p{Nl}_][\p{L}\p{N}\p{Mn}\p{Mc}_]*$"
LITERAL_PATTERN = "^[\\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089\"']"
CODE_SEGMENT_PATTERN = (
    r"//[^\n]*|/\*[\s\S]*?\*/"
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'" r'|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
    r"""|[^'"/]+|[\s\S]"""
)
CODE_SEGMENT_PATTERN_PLAIN = (
    r"//[^\n]*|/\*[\s\S]*?\*/"
    r"|'(?:\\[\s\S]|[^'\\])*'" r'|"(?:\\[\s\S]|[^"\\])*"'
    r"""|[^'"/]+|[\s\S]"""
)
WORD_PATTERN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\p{L}\p{N}_" + SPACE_CLASS + "]"

# --- Word lists -----------------------------------------------------------
# Words that are never renamed, for all languages at once.
PYTHON_KEYWORDS = (
    "False None True and as assert async await break class continue def del elif "
    "else except finally for from global if import in is lambda nonlocal not or "
    "pass raise return try while with yield"
).split()
JAVA_KEYWORDS = (
    "public private protected static void int float double boolean char interface "
    "extends implements new this super null true false byte short long final "
    "abstract synchronized throws throw catch switch case default package "
    "instanceof enum assert do"
).split()
C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float "
    "for goto if inline int long register restrict return short signed sizeof "
    "static struct switch typedef union unsigned void volatile while _Bool "
    "_Complex _Imaginary NULL true false"
).split()
LAYOUT_MARKERS = ("INDENT", "DEDENT", "NEWLINE")
KEYWORDS = tuple(
    dict.fromkeys([*PYTHON_KEYWORDS, *JAVA_KEYWORDS, *C_KEYWORDS, *LAYOUT_MARKERS])
)
STRUCTURAL_KEYWORDS = (
    "def class return if else elif for while in try except public private "
    "protected static new import from"
).split()
DECLARATION_WORDS = ("class", "interface", "enum")

# --- Near-miss weights, times ten so that sums are exact integers ----------
DELIMITERS = ("(", ")", "{", "}", ":", ",", ";", "INDENT", "DEDENT", "NEWLINE")
DELIMITER_WEIGHT = 1
IDENTIFIER_WEIGHT = 5
OTHER_WEIGHT = 10

# --- Thresholds -----------------------------------------------------------
DEFAULT_THRESHOLD = 0.50
THRESHOLD_RANGE = (0.30, 0.99)
NEAR_MISS_FLOOR = 0.75
TYPE4_CLASSIFIER_CUTOFF = 0.50
TYPE4_EMBEDDING_CUTOFF = 0.85
TYPE4_CORROBORATED_CUTOFF = 0.70
MIN_AGREEING_SAMPLES = 5
MIN_DIVERSE_OUTPUTS = 3
MIN_SHARED_SAMPLES = 3
# Alternative taxonomy cut-offs.
TAXONOMY = {
    "type1_tokens": 0.95,
    "type2_semantic": 0.75, "type2_tokens": 0.60, "type2_renamed": 0.85,
    "type3_semantic": 0.65, "type3_tokens": 0.30, "type3_renamed": 0.55,
}
WILSON_Z = 1.96
NO_THRESHOLD = 1.000001
GATE_MIN_PER_CLASS = 100

# --- Semantic scope -------------------------------------------------------
BASE_SEMANTIC_LANGUAGES = ("java", "python")
SUPPORTED_LANGUAGE_PAIRS = ("java:java", "python:python", "java:python", "c:c")
HEAD_FORMAT = "graphcodebert-symmetric-head-v1"
HEAD_ENCODER = "microsoft/graphcodebert-base"
MAX_CODE_CHARS = 131072
MAX_MODEL_TOKENS = 509
FEATURE_DIM = 768

# --- Names ----------------------------------------------------------------
CLONE_TYPES = ("Type-1", "Type-2", "Type-3", "Type-4")
TYPE_DESCRIPTIONS = {
    "Type-1": "Exact copy \u2014 only whitespace or comment differences",
    "Type-2": "Same structure, identifiers or literals renamed",
    "Type-3": "Near-miss \u2014 statements added, removed, or modified",
    "Type-4": "Semantic clone \u2014 different implementation, same behaviour",
}
CROSS_LANGUAGE_TYPE4 = "Semantic clone \u2014 cross-language implementation"
CROSS_LANGUAGE_SUFFIX = " \u00b7 cross-language"
JOB_STATUSES = ("queued", "running", "done", "failed")
STAGES = (
    "queued", "extracting", "tokenizing", "structural", "semantic", "preparing",
    "complete",
)
SPLITS = ("train", "valid", "test")
DETECTOR_REVISION = "evaluated-classifier-v4"
COMPARISON_SCOPE = "within_and_across_files"
SEMANTIC_POLICY = "validated_classifier_or_diverse_behavioral_agreement"
ERROR_LIMIT = 2000
RECENT_JOBS = 8
