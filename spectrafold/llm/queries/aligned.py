"""op11: alignment of two tokenizers on all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import token_alignment
from ..common import scratch, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The sizes of the two vocabularies.
SIZES = (50_257, 32_000)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align(docs, public_tokenizers.path(A), public_tokenizers.path(B), digest=True)
    folder = scratch(spark, "token_alignment")
    aligned.withColumnRenamed("groups", "groups_sha256").write.parquet(folder)  # read twice, encoded once
    aligned = spark.read.parquet(folder)
    out = token_alignment.weigh(aligned, token_alignment.link_counts(aligned, *SIZES), *SIZES)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLES: dict[str, str] = {}
