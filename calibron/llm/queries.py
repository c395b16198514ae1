"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calibron.llm import alignment, katz, langid, licenses, mixing, order_minhash, packing, pieces, quality, secrets, simhash, suffix_dedup, whitening
from calibron.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": _over_documents(licenses.license_query),
        "op2_simhash_groups": _over_documents(simhash.simhash_query),
        "op3_suffix_dedup": _over_documents(suffix_dedup.suffix_query),
        "op4_secret_scan": _over_documents(secrets.secrets_query),
        "op5_katz_backoff": _over_documents(katz.katz_query),
        "op6_order_minhash": _over_documents(order_minhash.minhash_query),
        "op7_quality_ledger": _over_documents(quality.quality_query),
        "op8_sentencepiece": _over_documents(pieces.pieces_query),
        "op9_source_mixing": _over_documents(mixing.mixing_query),
        "op10_language_id": _over_documents(langid.language_query),
        "op11_token_alignment": _over_documents(alignment.alignment_query),
        "op12_embedding_whitening": lambda spark, sf_dir: whitening.whitening_query(table(spark, sf_dir, "embeddings")),
        "op13_best_fit_packing": _over_documents(packing.packing_query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_ledger": quality.QUALITY_SQL, "op9_source_mixing": mixing.MIXING_SQL}
