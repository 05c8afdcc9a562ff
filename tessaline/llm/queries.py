"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import op7_chat_format
from .decontaminate import op8_decontaminate
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .jaccard_join import op3_jaccard_join
from .language_id import op1_language_id
from .packing import op4_best_fit_packing
from .pii import op2_pii
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op9_token_counts
from .warc import OP5_SQL, op5_warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc": op5_warc,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": pipeline,
}
SQL = {"op5_warc": OP5_SQL, "op10_exact_dedup": OP10_SQL}
