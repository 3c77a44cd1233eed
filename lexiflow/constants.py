"""Fixed values that must equal the behaviour being reproduced.

Everything here is data, stated plainly and in natural order.
"""

# --- fixed values: white space --------------------------------------------
# The Python ``str.isspace`` set, written as a Java regex character-class body.
WS_JAVA = r"\t-\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same set for DuckDB / RE2 (RE2 ``\s`` lacks the vertical tab).
WS_RE2 = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The same set as a plain string of characters (for trim).
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Word characters of Python's ``\w`` on str: letters, numbers, underscore.
WORD_CLASS = r"\p{L}\p{N}_"

# --- fixed values: labels ---------------------------------------------------
LABEL_OTTOMAN = "osmanlica"
LABEL_DIALECT = "Ağız"
LABEL_IDIOM = "deyim"
# alias -> canonical label (applied after strip, quote removal and lower-casing)
LABEL_ALIASES = {
    "ağız": "Ağız",
    "agiz": "Ağız",
    "agız": "Ağız",
    "şive": "Ağız",
    "osmanlıca": "osmanlica",
    "osmanlica": "osmanlica",
}
# characters removed from labels before lower-casing
LABEL_QUOTES = "\"'"

# --- fixed values: prompts ----------------------------------------------------
# training prompt prefix per canonical label
TRAIN_PREFIXES = {
    "osmanlica": "translate ottoman to tr: ",
    "Ağız": "normalize dialect to tr: ",
}
INFERENCE_PREFIX = "translate Turkish to Turkish: "
MAX_TRAIN_TOKENS = 96
MAX_INFER_TOKENS = 128
MIN_KEEP_TOKENS = 1
MAX_KEEP_TOKENS = 256
PAD_ID = 0
LABEL_IGNORE_ID = -100

# --- fixed values: sentinels and messages -------------------------------------
NO_MATCH = "[Eşleşme bulunamadı]"
PLACEHOLDER_PREFIX = "[ST Çeviri placeholder] "
NO_MODULE = "[Çeviri modülü bulunamadı]"
MISMATCH_WARNING = "⚠ Bu cümle **{label}** özelliğine daha yakın görünüyor."
NOT_ENGLISH = "⚠ Lütfen **sadece İngilizce deyimler** giriniz."
NOT_IDIOM = "Bu ifade **deyim** değil ."
STOP_MARKER = "q"

# --- fixed values: thresholds ------------------------------------------------------
MEMORY_THRESHOLD = 0.75
HYBRID_THRESHOLD = 0.70
SEED = 42

# --- fixed values: idiom alphabet gate ----------------------------------------------
ALPHABET_GATE_BODY = "A-Za-z" + "{ws}" + r"\-'’"

# --- fixed values: quotes for generator output repair ---------------------------------
OPEN_QUOTES = "“\""
CLOSE_QUOTES = "”\""

# --- fixed values: pandas default NA tokens (read_csv) ----------------------------------
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Suffix of cleaned line files.
LINE_FILE_SUFFIX = "_nokta_kaldirilmis"
