"""op3 and op4: line dedup and fingerprints of all documents, by DataFrame functions only."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fingerprints, line_dedup
from ..common import table


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text without repeated windows, and the numbers of lines and removed lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near these and the next document are."""
    out = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprints.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op3_line_dedup": op3_line_dedup, "op4_fingerprints": op4_fingerprints}
ORACLES = {
    "op3_line_dedup": """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM split WHERE len(ls) >= 3),
windows AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM places),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM ranked WHERE nth > 1)),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS p FROM split),
kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL), '') AS text,
    count(*) AS n_lines, count(g.p) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
}
