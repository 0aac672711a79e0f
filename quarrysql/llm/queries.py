"""The registered queries of the training-data operators: thin calls over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, ngram_join, pieces, quality_rules, secret_scans, site_quality, spot_signatures, token_counts, token_files, warc
from .common import table


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": _over("documents", lambda docs: token_files.query(docs, tokenizer("byte_bpe_50k.json"))),
    "op2_spot_signatures": _over("documents", spot_signatures.query),
    "op3_site_quality": lambda spark, sf_dir: site_quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_warc": _over("pages", warc.query),
    "op5_ngram_join": _over("documents", ngram_join.query),
    "op6_pieces": _over("documents", lambda docs: pieces.query(docs, tokenizer("piece_bpe_32k.model"))),
    "op7_quality_rules": _over("documents", quality_rules.query),
    "op8_secret_scans": _over("documents", secret_scans.query),
    "op9_token_counts": _over("documents", lambda docs: token_counts.query(docs, tokenizer("byte_bpe_50k.json"))),
    "op10_mixing": _over("documents", mixing.query),
}

#: DuckDB SQL, where it can express the query.
SQL: dict[str, str] = {
    "op4_warc": warc.sql(),
    "op5_ngram_join": ngram_join.sql(),
    "op7_quality_rules": quality_rules.sql(),
    "op10_mixing": mixing.sql(),
}
