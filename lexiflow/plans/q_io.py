"""Source / sink queries: every one writes driver data to files under the shared
checkpoint folder and reads it back through the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import corpus as C
from lexiflow.operators import dictionary as D
from lexiflow.operators import memory as MEM
from lexiflow.plans import sqlfrag as S
from lexiflow.plans.q_corpus import _LINES_SQL, _SEQ_LABELS, _split_sql, _PREFIX_CASE
from lexiflow.plans.registry import DRIVER_PREFIXES, register
from lexiflow.session import scratch_path
from lexiflow.sources import artefacts as AR
from lexiflow.sources import contract as CT
from lexiflow.sources import csv as CSV
from lexiflow.sources import lines as LN
from lexiflow.sources import tables as TB


def _docs_csv(spark, sf, cols=None):
    d = TB.table(spark, sf, "documents")
    d = d.select(*cols) if cols else d.select("doc_id", "text", "lang", "source")
    path = scratch_path(spark, "documents-csv")
    CSV.write_csv(d, path)
    return path


@register("csv_roundtrip", "SELECT doc_id, text, lang, source FROM documents")
def q_csv_roundtrip(spark, sf):
    path = _docs_csv(spark, sf)
    rows, _ = CSV.read_csv(spark, path, columns=["doc_id", "text", "lang", "source"])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


@register(
    "csv_quarantine",
    """SELECT CAST(sum(CASE WHEN doc_id % 7 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows,
  CAST(sum(CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_padded,
  CAST(sum(CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_quarantined FROM documents""",
)
def q_csv_quarantine(spark, sf):
    """An export in which every seventh row has a field too many and every fifth one too
    few: the long rows are quarantined, the short ones padded with null."""
    d = TB.table(spark, sf, "documents")
    two = F.concat_ws(",", F.col("doc_id").cast("string"), "lang")
    line = F.when(F.col("doc_id") % 7 == 0, F.concat_ws(",", two, "source", F.lit("more"))).when(F.col("doc_id") % 5 == 0, two)
    body = d.select(line.otherwise(F.concat_ws(",", two, "source")).alias("value"), "doc_id")
    path = scratch_path(spark, "broken-csv")
    parts = body.repartition(4, "doc_id")

    def with_header(batches):  # every file of the folder starts with the header
        import pandas as pd

        yield pd.DataFrame({"value": ["doc_id,lang,source"]})
        for b in batches:
            yield b[["value"]]

    parts.mapInPandas(with_header, "value string").write.text(path)
    rows, bad = CSV.read_csv(spark, path)
    flags = rows.select(F.lit(1).alias("row"), F.col("source").isNull().cast("int").alias("padded"), F.lit(0).alias("bad"))
    flags = flags.unionByName(bad.select(F.lit(0).alias("row"), F.lit(0).alias("padded"), F.col("_corrupt_record").isNotNull().cast("int").alias("bad")))
    return flags.agg(
        F.sum("row").cast("long").alias("n_rows"), F.sum("padded").cast("long").alias("n_padded"), F.sum("bad").cast("long").alias("n_quarantined")
    )


@register(
    "load_dataset_clean",
    f"SELECT doc_id, {S.clean('text')} AS text, lang AS label, {S.clean('source')} AS standard FROM documents",
)
def q_load_dataset_clean(spark, sf):
    d = TB.table(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("label"), F.col("source").alias("standard")
    )
    path = scratch_path(spark, "corpus-csv")
    CSV.write_csv(d, path)
    out = CT.load_dataset(spark, path)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", "standard")


_CSV_CORPUS_SQL = f"""c AS (SELECT doc_id, {S.clean('text')} AS text, {S.clean('source')} AS standard, lang AS label FROM documents)"""


@register(
    "dict_build",
    f"""WITH {_CSV_CORPUS_SQL}
SELECT key, standard, first_doc FROM (SELECT text AS key, standard, min(doc_id) OVER (PARTITION BY text) AS first_doc,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn FROM c WHERE text IS NOT NULL) WHERE rn = 1""",
)
def q_dict_build(spark, sf):
    """Export -> CSV -> contract and cleaning -> last-wins dictionary by file position
    (raw text keys) -> parquet artefact -> read back.  The exported id column tells the
    row of the first occurrence."""
    rows = _csv_corpus(spark, sf)
    d = D.build_dictionary(rows, key_fn=None, strip_standard=False)
    path = AR.save_table(d, scratch_path(spark, "dictionary"))
    d = AR.load_table(spark, path)
    first = rows.select(F.col("doc_id").cast("long").alias("first_doc"), F.col("pos").alias("_pos"))
    return d.join(first, d["pos"] == first["_pos"]).select("key", "standard", "first_doc")


def _csv_corpus(spark, sf):
    """The documents exported in id order over several CSV files and loaded back."""
    d = TB.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"), F.col("source").alias("standard"))
    path = scratch_path(spark, "ordered-corpus-csv")
    CSV.write_csv(d.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), path)
    return CT.load_dataset(spark, path)


@register(
    "memory_from_csv",
    f"""WITH {S.text_memory_ctes("SELECT doc_id AS qid, text FROM documents")}
SELECT q.qid AS doc_id, 'item:' || m.mem_id AS standard, round(m.mem_score, 6) AS score FROM q LEFT JOIN best m USING (qid)""",
)
def q_memory_from_csv(spark, sf):
    """Memory items exported as CSV -> contract -> last-wins dictionary -> TF-IDF memory with
    file positions -> saved, loaded, matched against every document."""
    items = TB.memory_texts(spark, sf).select("mem_id", "text", F.lit("idiom").alias("label"), "standard")
    path = scratch_path(spark, "memory-csv")
    CSV.write_csv(items.repartitionByRange(2, "mem_id").sortWithinPartitions("mem_id"), path)
    rows = CT.load_dataset(spark, path, clean=False)
    entries = D.build_dictionary(rows, key_fn=None, strip_standard=False).select(
        F.col("key").alias("mem_id"), F.col("key").alias("text"), "standard", "pos"
    )
    saved = MEM.TextMemory(entries).save(scratch_path(spark, "memory-saved"))
    memory = MEM.TextMemory.load(spark, saved)
    out = memory.match(TB.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.col("mem_standard").alias("standard"), F.round("mem_score", 6).alias("score"))


@register(
    "line_file_roundtrip",
    f"WITH {_LINES_SQL} SELECT count(*) AS n_lines, CAST(sum(CASE WHEN before IS DISTINCT FROM after THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM clean",
)
def q_line_file_roundtrip(spark, sf):
    """Lines written as text files, cleaned by the line job (output written with the
    suffix), and the report computed from the files."""
    lines = C.lines_of(TB.table(spark, sf, "documents"), "doc_id", "text")
    src = scratch_path(spark, "lines") + ".txt"
    lines.select(F.col("before").alias("value")).write.mode("overwrite").text(src)
    return LN.cleanup_job(spark, src)


@register(
    "line_files",
    """WITH l AS (SELECT coalesce(lang, 'und') AS file, doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS before FROM (
  SELECT lang, doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END AS p FROM documents))
SELECT file || '_clean.txt' AS file, row_number() OVER (PARTITION BY file ORDER BY doc_id, i) - 1 AS line_no, """
    + S.collapse("replace(before, '.', '')")
    + " AS line FROM l",
)
def q_line_files(spark, sf):
    """A folder with a line file per language is cleaned into one suffixed output per input;
    the outputs are read back with their line numbers."""
    docs = TB.table(spark, sf, "documents").select(F.struct(F.coalesce("lang", F.lit("und")).alias("lang"), "doc_id").alias("key"), "text")
    named = C.lines_of(docs, "key", "text").select(F.concat("key.lang", F.lit(".txt")).alias("file"), "key.doc_id", "line_no", "before")
    src, out = scratch_path(spark, "line-files"), scratch_path(spark, "line-files-out")
    LN.write_line_files(named, src, [], ["doc_id", "line_no"], col="before")
    folders = [f"{src}/{r['file']}" for r in named.select("file").distinct().collect()]  # one per language
    one = LN.read_lines(spark, folders, whole_folders=True).withColumn("file", F.regexp_extract("file_path", "[^/]*$", 0))
    cleaned = C.line_cleanup(one).withColumn("target", F.regexp_replace("file", r"\.txt$", "_clean.txt"))
    LN.write_line_files(cleaned, out, [], ["line_no"], "target")
    back = LN.read_lines(spark, [f"{out}/{f.rsplit('/', 1)[1][:-4]}_clean.txt" for f in folders], whole_folders=True)
    return back.select(F.regexp_extract("file_path", "[^/]*$", 0).alias("file"), "line_no", F.col("before").alias("line"))


@register(
    "trainset_files",
    _split_sql(
        1, 10, ("train", "validation"),
        label_sql=S.norm_label("lang"),
        where=f"{S.norm_label('lang')} IN ({', '.join(S.sq(x) for x in _SEQ_LABELS)}) "
        f"AND {S.ntok('text')} BETWEEN 1 AND 256 AND {S.ntok('source')} BETWEEN 1 AND 256",
        select="r.id, CASE WHEN r.rn <= q.quota THEN '{test}' ELSE '{train}' END AS split, "
        f"coalesce(CASE r.label {_PREFIX_CASE} END, '') || coalesce(r.text, '') AS input, r.source AS target",
    ),
)
def q_trainset_files(spark, sf):
    """Sequence training set written ``partitionBy('split')`` and read back."""
    ts = C.seq2seq_trainset(TB.corpus(spark, sf), labels=_SEQ_LABELS, prefixes=DRIVER_PREFIXES)
    path = scratch_path(spark, "trainset")
    ts.select("id", "input", "target", "split").write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("id", "split", "input", "target")


@register(
    "multi_source_load",
    """SELECT 'documents' AS source, 'loaded' AS status, count(*) AS rows FROM documents
UNION ALL SELECT 'benchmark', 'bad header', NULL
UNION ALL SELECT 'absent', 'missing', NULL""",
)
def q_multi_source_load(spark, sf):
    """Three sources: a good corpus, one without the required columns, one missing."""
    good = _docs_csv(spark, sf, [F.col("text"), F.col("lang").alias("label"), F.col("source").alias("standard")])
    bench = scratch_path(spark, "benchmark-csv")
    CSV.write_csv(TB.table(spark, sf, "benchmark"), bench)
    absent = scratch_path(spark, "absent")
    _, report = CT.load_sources(spark, [("documents", good), ("benchmark", bench), ("absent", absent)])
    return report.select("source", "status", "rows")


def _ragged_sql(table: str, key: str) -> str:
    """Raw lines cut at commas, padded and cut to three columns; blank lines skipped.  A quote
    that does not begin a field is text, and no line of the tables begins a field with one."""
    cols = ", ".join(f"coalesce(nullif(p[{i}], ''), '') AS {c}" for i, c in enumerate(("text", "label", "standard"), 1))
    return f"""SELECT {cols} FROM (SELECT string_split(line, ',') AS p FROM (
  SELECT unnest(CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) END) AS line
  FROM {table}) WHERE line <> '')"""


def _ragged_file(spark, sf, table: str, key: str) -> str:
    lines = C.lines_of(TB.table(spark, sf, table), key, "text")
    path = scratch_path(spark, f"ragged-{table}")
    lines.select(F.col("before").alias("value")).write.text(path)
    return path


@register(
    "ragged_quoted",
    """SELECT coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(lang, '') END AS label,
CASE WHEN doc_id % 3 = 2 THEN coalesce(source, '') ELSE '' END AS standard FROM documents""",
)
def q_ragged_quoted(spark, sf):
    """Whole documents as quoted fields, with their newlines and doubled quotes, in rows of one,
    two and four fields; the files are cut at any byte and read by many tasks."""
    field = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    n = F.col("doc_id") % 3
    more = F.when(n == 0, F.lit("")).when(n == 1, F.concat(F.lit(","), field("lang"))).otherwise(F.concat_ws(",", F.lit(""), "lang", field("source"), F.lit("x,y")))
    d = TB.table(spark, sf, "documents").select(F.concat(field("text"), more).alias("value"))
    path = scratch_path(spark, "ragged-quoted")
    d.write.text(path)
    return CSV.read_ragged_csv(spark, path, header=False, split=True).select("text", "label", "standard")


@register("ragged_csv", _ragged_sql("documents", "doc_id"))
def q_ragged_csv(spark, sf):
    """Document lines written as raw text, read back as a ragged 3-column CSV
    (short rows padded with '', long rows cut, empty lines skipped)."""
    return CSV.read_ragged_csv(spark, _ragged_file(spark, sf, "documents", "doc_id"), header=False).select("text", "label", "standard")


@register("ragged_merge", f"{_ragged_sql('documents', 'doc_id')} UNION ALL {_ragged_sql('conversations', 'conv_id')}")
def q_ragged_merge(spark, sf):
    """Two ragged files (document lines, conversation lines) repaired, merged in
    source order and written as one headered CSV; the merged file is read back."""
    a, b = _ragged_file(spark, sf, "documents", "doc_id"), _ragged_file(spark, sf, "conversations", "conv_id")
    merged = C.union_corpora(
        [("a", CSV.read_ragged_csv(spark, a, header=False, source_rank=0)), ("b", CSV.read_ragged_csv(spark, b, header=False, source_rank=1))]
    )
    out = scratch_path(spark, "ragged-merged")
    CSV.write_csv(merged.select("text", "label", "standard"), out)
    back, _ = CSV.read_csv(spark, out, na_tokens=None, ignore_leading_ws=False)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "label", "standard")])


EXPORT_BYTES = 32 << 20  # characters of the texts of an exported file, which one task reads


@register("row_positions", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents")
def q_row_positions(spark, sf):
    """Row renumbering from file positions: the corpus is exported in order over
    several files, read back with (file, block, row) positions, and given dense
    row numbers by a distributed sort — equal to the original order."""
    from lexiflow.operators import features as FE

    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    path = scratch_path(spark, "ordered-csv")
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    files = max(3, -(-int(size) // EXPORT_BYTES))
    CSV.write_csv(d.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id"), path)
    rows, _ = CSV.read_csv(spark, path, columns=["doc_id", "text"])
    numbered = FE.dense_ids(rows.select("doc_id", "pos"), [F.asc("pos")], "row_no")
    return numbered.select(F.col("doc_id").cast("long").alias("doc_id"), "row_no")
