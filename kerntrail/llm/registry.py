"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .decontamination import OP2_SQL, op2_decontamination
from .language import op6_language
from .mixing import OP8_SQL, op8_mixing
from .packing import op1_packing
from .repeats import OP3_SQL, op3_repeats
from .scoring import OP4_SQL, op4_scoring
from .sharding import op7_sharding
from .simhash import op9_simhash
from .tokencount import op12_token_counts
from .topk import OP5_SQL, op5_topk
from .spelling import OP11_SQL, op11_spelling
from .toxicity import op10_toxicity


def queries() -> dict:
    import corpus_pipeline

    found = [op1_packing, op2_decontamination, op3_repeats, op4_scoring, op5_topk, op6_language, op7_sharding, op8_mixing, op9_simhash, op10_toxicity, op11_spelling, op12_token_counts, op13_filter_audit]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op3_repeats": OP3_SQL, "op4_scoring": OP4_SQL, "op5_topk": OP5_SQL, "op8_mixing": OP8_SQL, "op11_spelling": OP11_SQL, "op13_filter_audit": OP13_SQL}
