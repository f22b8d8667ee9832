"""op9: near-duplicate classes of all documents."""

from pyspark.sql import DataFrame, SparkSession

from .. import near_dedup
from ..common import table


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": op9_near_dedup}
ORACLES: dict[str, str] = {}
