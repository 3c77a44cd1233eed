"""Corpus pipeline: rules, language, near-duplicates, mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
``run`` writes every stage's rows to the shared folder and reads them back.
``ORACLE_SQL`` is None: line labels, language filters, XXH64 fingerprints and BPE are not
expressible in SQL; ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from lexiflow.llm import common, langid, lexicon, linecrf, mixing, simhash

STAGES = [
    ("quality_rules", linecrf.stage),
    ("language_id", langid.stage),
    ("simhash_near_dedup", simhash.stage),
    ("source_mix", mixing.stage),
    ("bpe_encoding", lexicon.stage),
]

ORACLE_SQL = None


def run(spark, sf_dir: str):
    common.prepare(spark)
    docs = common.source_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
