"""op2: the language of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .. import language_id
from ..common import crc32_of_id, table


def held_out():
    return crc32_of_id() % 4 == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, ~held_out())
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
