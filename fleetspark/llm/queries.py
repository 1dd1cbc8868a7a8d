"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetspark.llm.bpe import op8_bpe
from fleetspark.llm.conversation_trie import OP13_SQL, op13_conversation_trie
from fleetspark.llm.decontamination import OP5_SQL, op5_decontamination
from fleetspark.llm.jaccard_join import OP11_SQL, op11_jaccard_join
from fleetspark.llm.language_id import op6_language_id
from fleetspark.llm.license_scan import OP3_SQL, op3_license_scan
from fleetspark.llm.minhash import op7_minhash_dedup
from fleetspark.llm.quality_rules import op9_quality_rules
from fleetspark.llm.sharding import op2_sharding
from fleetspark.llm.spelling import OP12_SQL, op12_spelling_variants
from fleetspark.llm.substring_dedup import op10_substring_dedup
from fleetspark.llm.toxicity import op4_toxicity
from fleetspark.llm.url_filters import OP1_SQL, op1_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_sharding": op2_sharding,
        "op3_license_scan": op3_license_scan,
        "op4_toxicity": op4_toxicity,
        "op5_decontamination": op5_decontamination,
        "op6_language_id": op6_language_id,
        "op7_minhash_dedup": op7_minhash_dedup,
        "op8_bpe": op8_bpe,
        "op9_quality_rules": op9_quality_rules,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op3_license_scan": OP3_SQL, "op5_decontamination": OP5_SQL, "op11_jaccard_join": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_conversation_trie": OP13_SQL}
