"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .ann import op1_permutation_index
from .language_id import op10_language_id
from .near_dedup import op9_minhash_near_dedup
from .packing import op5_best_fit_packing
from .quality_classifier import op3_quality_classifier
from .quality_rules import op7_quality_rules
from .sentencepiece_unigram import op2_sentencepiece
from .suffix_dedup import op4_suffix_dedup
from .toxicity import op6_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_permutation_index": op1_permutation_index,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {"op8_warc": OP8_SQL}
