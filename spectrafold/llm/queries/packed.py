"""op8: packing of all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import packing
from ..common import table

TOKENIZER = "word_bpe_49k.json"


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return digest(packing.pack(docs, public_tokenizers.path(TOKENIZER)))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
