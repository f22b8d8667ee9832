"""op12: token files of all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .. import token_files
from ..common import scratch, table


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the ORC files that are written first."""
    folder = scratch(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read(spark, folder))


QUERIES = {"op12_token_files": op12_token_files}
ORACLES: dict[str, str] = {}
