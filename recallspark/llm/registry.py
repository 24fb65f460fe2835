"""The queries of this subpackage and their SQL, and the pipeline."""

from __future__ import annotations

from recallspark.llm import pipeline, op1_quality, op2_langid, op3_hilbert, op4_jaccard, op5_itq, op6_mixing, op7_suffix, op8_lsh, op9_bpe, op10_toxicity, op11_spelling, op12_lattice, op13_alignment

MODULES = (op1_quality, op2_langid, op3_hilbert, op4_jaccard, op5_itq, op6_mixing, op7_suffix, op8_lsh, op9_bpe, op10_toxicity, op11_spelling, op12_lattice, op13_alignment)


def queries() -> dict:
    found = {name: query for module in MODULES for name, query in module.QUERIES.items()}
    return found | {"pipeline": pipeline.run}


def oracles() -> dict:
    found = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
    return found | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
