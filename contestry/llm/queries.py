"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contestry.llm.bpe import op2_bpe
from contestry.llm.decontaminate import op8_decontaminate
from contestry.llm.divergence import OP12_SQL, op12_source_divergence
from contestry.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from contestry.llm.language import op9_language
from contestry.llm.mixing import op3_mixing
from contestry.llm.quality_classifier import op5_quality_classifier
from contestry.llm.quality_rules import op4_quality_rules
from contestry.llm.simhash import op1_simhash
from contestry.llm.substring import op10_substring
from contestry.llm.suffix_dedup import op6_suffix_dedup
from contestry.llm.token_files import op7_token_files
from contestry.llm.vector_codes import OP13_SQL, op13_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_files": op7_token_files,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_substring": op10_substring,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op11_exact_dedup": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_vector_codes": OP13_SQL}
