"""op7: toxicity of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import toxicity
from ..common import crc32_of_id, table


def held_out():
    return crc32_of_id() % 5 == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
