"""The queries of this package and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlog.llm.bpe import op1_bpe
from driftlog.llm.embedding_dedup import op9_embedding_dedup
from driftlog.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from driftlog.llm.jaccard_join import op6_ngram_jaccard
from driftlog.llm.language_id import op10_language_id
from driftlog.llm.license_scan import op2_license_scan
from driftlog.llm.line_dedup import op4_line_dedup
from driftlog.llm.mixing import op7_source_mixing
from driftlog.llm.oracles import OP2_BASE_SQL, OP4_SQL, OP6_SQL, OP9_SQL
from driftlog.llm.quality import op3_quality
from driftlog.llm.secret_scan import op8_secret_scan


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that its base phrases give, which SQL can express."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_license_scan": op2_license_scan,
        "op3_quality": op3_quality,
        "op4_line_dedup": op4_line_dedup,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_ngram_jaccard": op6_ngram_jaccard,
        "op7_source_mixing": op7_source_mixing,
        "op8_secret_scan": op8_secret_scan,
        "op9_embedding_dedup": op9_embedding_dedup,
        "op10_language_id": op10_language_id,
        "license_base_places": license_base_places,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "license_base_places": OP2_BASE_SQL,
        "op4_line_dedup": OP4_SQL,
        "op5_exact_dedup": OP5_SQL,
        "op6_ngram_jaccard": OP6_SQL,
        "op9_embedding_dedup": OP9_SQL,
    }
