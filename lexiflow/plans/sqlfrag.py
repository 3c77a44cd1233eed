"""DuckDB SQL fragments mirroring the Column functions (used by the oracle SQL).

Independent re-statements of the same semantics in another engine's dialect,
so the oracle is a second implementation rather than a copy of the plan.
"""

from __future__ import annotations

from lexiflow import constants as K

WS = K.WS_RE2
NONWORD = f"[^\\p{{L}}\\p{{N}}_{WS}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+\\z', '', 'g')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{NONWORD}', '', 'g'), '[{WS}]+', ' ', 'g'))"


def normalize(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '{NONWORD}', '', 'g')"


def lookup_key(x: str) -> str:
    return f"lower({strip(x)})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{WS}]+'), lambda t: t <> '')"


def ntok(x: str) -> str:
    return f"len({tokens(x)})"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm_label(x: str) -> str:
    v = f"lower(replace(replace({strip(x)}, '\"', ''), '''', ''))"
    cases = " ".join(f"WHEN {sq(a)} THEN {sq(c)}" for a, c in K.LABEL_ALIASES.items())
    return f"coalesce(CASE {v} {cases} END, {v})"


def lang_rule(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '[éèêçàùâîôëïœ]') THEN 'fr' "
        f"WHEN regexp_matches({x}, '[äöüß]') THEN 'de' "
        f"WHEN regexp_matches({x}, '[ñáíóú¿¡]') THEN 'es' ELSE 'en' END"
    )


def md5key(x: str, seed: int = K.SEED) -> str:
    return f"md5('{seed}:' || CAST({x} AS VARCHAR))"


def quote_repair(x: str) -> str:
    s = strip(x)
    s1 = (
        f"(CASE WHEN regexp_matches({s}, '^[“\"]') AND NOT regexp_matches({s}, '[”\"]\\z') "
        f"THEN {strip(f'substr({s}, 2)')} ELSE {s} END)"
    )
    return (
        f"(CASE WHEN regexp_matches({s1}, '[”\"]\\z') AND NOT regexp_matches({s1}, '^[“\"]') "
        f"THEN {strip(f'substr({s1}, 1, length({s1}) - 1)')} ELSE {s1} END)"
    )


def alphabet_gate(x: str) -> str:
    body = "A-Za-z" + WS + "\\-''’"
    return f"coalesce(regexp_full_match({strip(x)}, '[{body}]+'), false)"


def route_input() -> str:
    return (
        "SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS id, text, lang AS requested_label FROM documents "
        "UNION ALL SELECT 'conv:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, text, "
        "'en' AS requested_label FROM conversations WHERE role = 'user'"
    )


def corpus_dictionary(key_sql) -> str:
    """Last-wins dictionary over documents: (key, standard, pos)."""
    k = key_sql("text")
    return (
        f"SELECT key, standard, pos FROM (SELECT key, standard, first_pos AS pos, "
        f"row_number() OVER (PARTITION BY key ORDER BY p DESC) AS rn FROM ("
        f"SELECT {k} AS key, {strip('source')} AS standard, doc_id AS p, "
        f"min(doc_id) OVER (PARTITION BY {k}) AS first_pos FROM documents WHERE {k} IS NOT NULL)) WHERE rn = 1"
    )


def text_memory_ctes(queries_sql: str, with_label: bool = False) -> str:
    """CTEs ``q``, ``mem``, ``best(qid, mem_id, mem_standard, mem_score)``: word
    TF-IDF fitted on the benchmark memory, exact top-1 by cosine, ties to the
    lowest position.  ``queries_sql`` yields (qid, text[, label])."""
    lab_m = f", {lang_rule('text')} AS label" if with_label else ""
    lab_join = "AND q.label = m.label" if with_label else ""
    return f"""
q AS ({queries_sql}),
mem AS (SELECT item_id AS mem_id, text, 'item:' || CAST(item_id AS VARCHAR) AS standard, item_id AS pos{lab_m} FROM benchmark),
mem_tf AS (SELECT mem_id, term, count(*) AS tf FROM (SELECT mem_id, unnest({words('text')}) AS term FROM mem) GROUP BY ALL),
mem_n AS (SELECT count(*) AS n FROM mem),
vocab AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1 AS idf FROM mem_tf, mem_n GROUP BY term, n),
mem_w AS (SELECT mem_id, term, tf * idf AS w FROM mem_tf JOIN vocab USING (term)),
mem_v AS (SELECT mem_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY mem_id)) AS w FROM mem_w),
q_tf AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({words('text')}) AS term FROM q) GROUP BY ALL),
q_w AS (SELECT qid, term, tf * idf AS w FROM q_tf JOIN vocab USING (term)),
q_v AS (SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM q_w),
pairs AS (SELECT qv.qid, mv.mem_id, sum(qv.w * mv.w) AS score FROM q_v qv JOIN mem_v mv USING (term) GROUP BY ALL),
ranked AS (SELECT p.qid, m.mem_id, m.standard AS mem_standard, p.score AS mem_score,
  row_number() OVER (PARTITION BY p.qid ORDER BY round(p.score, 12) DESC, m.pos) AS rn
  FROM pairs p JOIN mem m USING (mem_id) JOIN q ON q.qid = p.qid {lab_join}),
best AS (SELECT qid, mem_id, mem_standard, mem_score FROM ranked WHERE rn = 1)
"""
