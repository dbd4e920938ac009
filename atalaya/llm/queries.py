"""The registered queries of the corpus operators and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atalaya.llm import bestfit, exact_stream, extraction, imatch, lines, merkle, mixing, packing, pii, quality, simhash, suffixes, trie
from atalaya.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_mixing": lambda spark, d: mixing.op1(documents(spark, d)),
    "op2_suffixes": lambda spark, d: suffixes.repeated_passages(documents(spark, d)),
    "op3_exact_dedup": lambda spark, d: exact_stream.op3(spark, f"{d}/documents.parquet"),
    "op4_simhash": lambda spark, d: simhash.op4(documents(spark, d)),
    "op5_imatch": lambda spark, d: imatch.compared_with_edits(documents(spark, d)),
    "op6_packing": lambda spark, d: packing.packed(documents(spark, d)),
    "op7_lines": lambda spark, d: lines.deduplicated(documents(spark, d), with_rows=False),
    "op8_extraction": lambda spark, d: extraction.extracted(spark.read.parquet(f"{d}/pages.parquet")),
    "op9_quality": lambda spark, d: quality.op9(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op10_pii": lambda spark, d: pii.op10(documents(spark, d)),
    "op11_merkle": lambda spark, d: merkle.manifest(documents(spark, d)),
    "op12_trie": lambda spark, d: trie.prefix_trie(spark.read.parquet(f"{d}/conversations.parquet")),
    "op13_bestfit": lambda spark, d: bestfit.packed(documents(spark, d)),
}

CHECKS: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op3_exact_dedup": exact_stream.OP3_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op12_trie": trie.OP12_SQL,
}
