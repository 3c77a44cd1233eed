"""Classifier and hook queries (rows-only checks: fitted models have no SQL oracle)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiflow.operators import classify as CL
from lexiflow.operators import features as FE
from lexiflow.operators import hooks as HK
from lexiflow.operators import memory as MEM
from lexiflow.operators import report as RP
from lexiflow.operators import sampling as SM
from lexiflow.plans.registry import register
from lexiflow.session import scratch_path
from lexiflow.sources import artefacts as AR
from lexiflow.sources import tables as TB


def _split_corpus(spark, sf):
    return SM.stratified_split(TB.corpus(spark, sf), "label", "id", 0.2)


def _word_model(spark, sf):
    """Fitted by every query that uses it, on the table it is given."""
    split = _split_corpus(spark, sf)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    model = CL.fit_variant_classifier(train, analyzer="word", max_iter=500, clean=True)
    return model, test


@register("variant_train_predict", None)
def q_variant_train_predict(spark, sf):
    """Word TF-IDF + LR fitted on the 80 % side; predictions for the 20 % hold-out."""
    model, test = _word_model(spark, sf)
    return CL.predict(model, test, ["id", "label"]).select("id", "label", "predicted")


@register("variant_train_report", None)
def q_variant_train_report(spark, sf):
    model, test = _word_model(spark, sf)
    pred = CL.predict(model, test, ["label"]).select(F.col("label").alias("gold"), "predicted")
    return RP.classification_report(pred, "gold", "predicted")


@register("variant_train_balanced", None)
def q_variant_train_balanced(spark, sf):
    """Char 3-5 gram TF-IDF (min_df 3) + class-balanced LR on the quality label."""
    d = TB.table(spark, sf, "documents").join(TB.table(spark, sf, "labels"), "doc_id")
    d = d.select(F.col("doc_id").alias("id"), "text", F.col("quality").cast("string").alias("label"))
    split = SM.stratified_split(d, "label", "id", 0.2)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    model = CL.fit_variant_classifier(train, analyzer="char_wb", min_df=3, max_iter=1000, balanced=True)
    return CL.predict(model, test).select("id", "label", "predicted")


@register("variant_predict", None)
def q_variant_predict(spark, sf):
    """Fitted model saved with the ML writer, loaded back, applied to every incoming text."""
    model, _ = _word_model(spark, sf)
    path = scratch_path(spark, "variant-model")
    AR.save_model(model, path)
    loaded = AR.load_model(spark, path)
    return CL.predict(loaded, TB.route_input(spark, sf), ["id", "requested_label"]).select("id", "requested_label", "predicted")


DIM = 64
_BUCKET = f"CAST(('0x' || substr(md5(gram), 1, 4)) AS INTEGER) % {DIM}"


def _trigram_sql(table: str, key: str) -> str:
    return f"""SELECT k, {_BUCKET} AS b, count(*) AS n FROM (
  SELECT k, substr(s, i, 3) AS gram FROM (SELECT k, s, unnest(range(1, length(s) - 1)) AS i FROM (
    SELECT {key} AS k, ' ' || lower(text) || ' ' AS s FROM {table} WHERE text IS NOT NULL))) GROUP BY ALL"""


_ENCODE_SQL = f"""WITH m AS ({_trigram_sql('benchmark', 'item_id')}), q AS ({_trigram_sql('documents', 'doc_id')}),
mn AS (SELECT k, sqrt(sum(n * n)) AS nrm FROM m GROUP BY k), qn AS (SELECT k, sqrt(sum(n * n)) AS nrm FROM q GROUP BY k),
p AS (SELECT q.k AS qk, m.k AS mk, sum(q.n * m.n) AS dot FROM q JOIN m USING (b) GROUP BY ALL),
r AS (SELECT qk, mk, dot / (qn.nrm * mn.nrm) AS score FROM p JOIN qn ON qn.k = qk JOIN mn ON mn.k = mk),
z AS (SELECT qk, mk, score, row_number() OVER (PARTITION BY qk ORDER BY round(score, 12) DESC, mk) AS rn FROM r)
SELECT d.doc_id, z.mk AS match_id, round(z.score, 6) AS score FROM documents d LEFT JOIN z ON z.qk = d.doc_id AND rn = 1"""


@register("encode_hook", _ENCODE_SQL)
def q_encode_hook(spark, sf):
    """Memory and queries encoded as hashed character trigram counts in Arrow batches, then
    exact cosine top-1.  Any encoder with the same (id, vec, pos) contract can take its
    place, also a batch hook (``mapInPandas``) around a foreign model."""
    mem = TB.memory_texts(spark, sf).select(F.col("mem_id").alias("id"), "text", "pos")
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("pos"))
    best = MEM.VectorMemory(FE.hashed_trigrams(mem, DIM)).match(FE.hashed_trigrams(docs, DIM))
    return best.select(F.col("qid").cast("long").alias("doc_id"), "match_id", F.round("score", 6).alias("score"))


def trigram_encoder():
    """A model hook in plain Python: hashed character trigram counts, as the SQL has them.
    Made once per process, so its memo of grams serves all batches."""
    import hashlib

    memo: dict[str, int] = {}

    def place(gram: str) -> int:
        if gram not in memo:
            if len(memo) > 1_000_000:
                memo.clear()
            memo[gram] = int(hashlib.md5(gram.encode()).hexdigest()[:4], 16) % DIM
        return memo[gram]

    def encode(texts):
        out = []
        for t in texts:
            s = f" {t.lower()} "
            v = [0.0] * DIM
            for i in range(len(s) - 2):
                v[place(s[i : i + 3])] += 1.0
            out.append(v)
        return out

    return encode


@register("hook_encoder", _ENCODE_SQL)
def q_hook_encoder(spark, sf):
    """The same search with vectors from a model hook that is loaded once per process."""
    hook = HK.ModelHook(trigram_encoder, "array<double>", batch_size=256)
    mem = TB.memory_texts(spark, sf).select(F.col("mem_id").alias("id"), "text", "pos")
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("pos"))
    best = MEM.VectorMemory(hook.encode(mem)).match(hook.encode(docs))
    return best.select(F.col("qid").cast("long").alias("doc_id"), "match_id", F.round("score", 6).alias("score"))
