"""op6: SentencePiece encoding and decoding of all documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import piece_codec
from ..common import table


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, from the ids and texts of the operator."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLES: dict[str, str] = {}
