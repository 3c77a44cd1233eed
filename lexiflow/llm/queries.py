"""Registered queries of this subpackage: name -> (callable, DuckDB SQL or None).

SQL is given where it can express the result; the others are held against brute force,
round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from lexiflow.llm import backoff, collocations, langid, lexicon, linecrf, mixing, packing, rabitq, rules, runs, simhash, toxicity, wavelet

QUERIES = {
    "op1_counterfactual_toxicity": (toxicity.query, None),
    "op2_wavelet_shards": (wavelet.query, None),
    "op3_bpe_lexicon": (lexicon.query, None),
    "op4_language_filters": (langid.query, None),
    "op5_sainte_lague_mix": (mixing.query, None),
    "op6_line_crf_rules": (linecrf.query, None),
    "op7_simhash_balls": (simhash.query, None),
    "op8_stupid_backoff": (backoff.query, backoff.ORACLE_SQL),
    "op9_one_bit_codes": (rabitq.query, rabitq.ORACLE_SQL),
    "op10_rule_ensemble": (rules.query, None),
    "op11_bm25_packing": (packing.query, None),
    "op12_quotient_collocations": (collocations.query, collocations.ORACLE_SQL),
    "op13_periodic_runs": (runs.query, None),
}
