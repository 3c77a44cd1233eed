"""Column -> Column text functions (JVM-side, inside whole-stage codegen).

Each function reproduces one normaliser exactly on Python ``str`` semantics:
Unicode lower-casing, Python's ``\\w`` (letters, numbers, underscore) and
Python's white-space set.  Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow import constants as K

WS = K.WS_JAVA
_NON_WORD = f"[^{K.WORD_CLASS}{WS}]"
_WS_RUN = f"[{WS}]+"
_EDGE_WS = f"^[{WS}]+|[{WS}]+\\z"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove the full Unicode white-space set at both ends
    (``TRIM(BOTH <set> FROM s)``, no regex)."""
    return F.trim(_c(col), F.lit(K.WS_CHARS))


def collapse_ws(col) -> Column:
    """Runs of white space -> one blank, then strip."""
    return F.trim(F.regexp_replace(_c(col), _WS_RUN, " "))


def clean_text(col) -> Column:
    """lower -> delete non-word, non-space -> collapse white space -> strip."""
    deleted = F.regexp_replace(F.lower(_c(col)), _NON_WORD, "")
    return F.trim(F.regexp_replace(deleted, _WS_RUN, " "))


def normalize_text(col) -> Column:
    """strip -> lower -> delete non-word, non-space.  No collapse, no final strip."""
    return F.regexp_replace(F.lower(strip_ws(col)), _NON_WORD, "")


def lookup_key(col) -> Column:
    """``strip().lower()``: punctuation is kept."""
    return F.lower(strip_ws(col))


def label_lower(col) -> Column:
    return F.lower(strip_ws(col))


def remove_dots(col) -> Column:
    return F.translate(_c(col), ".", "")


def token_count(col) -> Column:
    """``len(s.split())`` on Python white space; empty text -> 0."""
    return F.size(F.filter(F.split(_c(col), _WS_RUN), lambda x: x != F.lit("")))


def tokens(col) -> Column:
    """``s.split()`` as an array."""
    return F.filter(F.split(_c(col), _WS_RUN), lambda x: x != F.lit(""))


def norm_label(col, aliases: dict | None = None, turkish_case: bool = False) -> Column:
    """strip -> drop ASCII quotes -> lower -> alias map; unknown labels pass through.

    ``turkish_case`` maps ``I``/``İ`` the Turkish way before lower-casing (opt-in).
    """
    aliases = K.LABEL_ALIASES if aliases is None else aliases
    x = F.translate(strip_ws(col), K.LABEL_QUOTES, "")
    if turkish_case:
        x = F.translate(x, "Iİ", "ıi")
    x = F.lower(x)
    amap = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
    return F.coalesce(F.try_element_at(amap, x), x)


def quote_repair(col) -> Column:
    """Drop an unbalanced leading quote, then an unbalanced trailing one; strip after each."""
    s = strip_ws(col)
    starts = f"^[{K.OPEN_QUOTES}]"
    ends = f"[{K.CLOSE_QUOTES}]\\z"
    s1 = F.when(s.rlike(starts) & ~s.rlike(ends), strip_ws(F.substring(s, F.lit(2), F.length(s)))).otherwise(s)
    s2 = F.when(s1.rlike(ends) & ~s1.rlike(starts), strip_ws(F.left(s1, F.length(s1) - 1))).otherwise(s1)
    return s2


def alphabet_gate(col, body: str = K.ALPHABET_GATE_BODY) -> Column:
    """``re.fullmatch('[A-Za-z\\s\\-'’]+', s.strip())`` as a boolean column."""
    pattern = "\\A[" + body.replace("{ws}", WS) + "]+\\z"
    return F.coalesce(strip_ws(col).rlike(pattern), F.lit(False))


def infer_prompt(col, prefix: str = K.INFERENCE_PREFIX) -> Column:
    return F.concat(F.lit(prefix), _c(col))


def prefix_map_column(label_col, prefixes: dict) -> Column:
    """Prefix per label from a literal map; labels without a prefix get ''."""
    if not prefixes:
        return F.lit("")
    pmap = F.create_map(*[F.lit(v) for kv in prefixes.items() for v in kv])
    return F.coalesce(F.try_element_at(pmap, _c(label_col)), F.lit(""))


def prompt_input(text_col, label_col, prefixes: dict | None = None) -> Column:
    prefixes = K.TRAIN_PREFIXES if prefixes is None else prefixes
    return F.concat(prefix_map_column(label_col, prefixes), F.coalesce(_c(text_col), F.lit("")))


def na_to_null(col, tokens_: list[str] | None = None) -> Column:
    """Map the pandas NA tokens to null (exact, case-sensitive match)."""
    toks = K.NA_TOKENS if tokens_ is None else tokens_
    c = _c(col)
    return F.when(c.isin(toks), F.lit(None).cast("string")).otherwise(c)


def changed(before, after) -> Column:
    return ~_c(before).eqNullSafe(_c(after))


def loose_equal(a, b) -> Column:
    """Case- and edge-space-insensitive equality (gold vs prediction)."""
    return lookup_key(a) == lookup_key(b)


def placeholder(col) -> Column:
    return F.concat(F.lit(K.PLACEHOLDER_PREFIX), _c(col))


def word_features(col) -> Column:
    """Default TF-IDF word tokens: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(f"[{K.WORD_CLASS}]{{2,}}"), 0)


def _substr_of(word: Column, n: int):
    return lambda i: F.substring(word, i, F.lit(n))


def char_wb_ngrams(col, n_min: int = 3, n_max: int = 5) -> Column:
    """Word-bounded character n-grams: each word padded with one blank per side.

    A padded word of length L yields L-n+1 grams for each n; a word no longer
    than n yields itself once and no larger n.
    """
    words = tokens(F.lower(_c(col)))

    def per_word(w):
        pw = F.concat(F.lit(" "), w, F.lit(" "))
        L = F.length(pw)
        parts = []
        for n in range(n_min, n_max + 1):
            grams = F.transform(F.sequence(F.lit(1), F.greatest(L - n + 1, F.lit(1))), _substr_of(pw, n))
            if n > n_min:
                grams = F.when(L > n - 1, grams).otherwise(F.array().cast("array<string>"))
            parts.append(grams)
        return F.concat(*parts)

    return F.flatten(F.transform(words, per_word))


def char_wb_gram_rows(df, id_col: str, text_col: str, n_min: int = 3, n_max: int = 5):
    """Same grams as :func:`char_wb_ngrams`, as (id, term) rows built with flat
    generators (explode words, then explode positions): codegen-friendly, no
    nested lambdas, and no per-document array of every gram."""
    w = df.select(id_col, F.explode(tokens(F.lower(F.col(text_col)))).alias("_w"))
    w = w.select(id_col, F.concat(F.lit(" "), F.col("_w"), F.lit(" ")).alias("_pw"))
    w = w.withColumn("_L", F.length("_pw"))
    w = w.select(id_col, "_pw", "_L", F.explode(F.array(*[F.lit(n) for n in range(n_min, n_max + 1)])).alias("_n"))
    w = w.where((F.col("_n") == n_min) | (F.col("_L") > F.col("_n") - 1))
    g = w.select(id_col, "_pw", "_n", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_L") - F.col("_n") + 1, F.lit(1)))).alias("_i"))
    return g.select(id_col, F.substring(F.col("_pw"), F.col("_i"), F.col("_n")).alias("term"))


char_wb_ngrams.rows = char_wb_gram_rows
