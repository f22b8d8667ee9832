"""op1 and op10: main texts and URL list decisions of all pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import html_text, url_lists
from ..common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.round("importance", 6).alias("importance"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
ORACLES: dict[str, str] = {}


def _number(text):
    """A number from 0 to 65535 that depends on the text only."""
    return F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("int")


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: a fixed rule says what is added and removed when."""
    hosts = pages.select(url_lists.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    patterns = hosts.select(F.explode(F.array(F.col("host"), domain, F.concat("host", F.lit("/en")))).alias("pattern")).where("pattern <> ''").distinct()
    n = _number(F.col("pattern"))
    first = F.expr("date_add(date '2024-01-01', n % 200)")
    events = F.array(
        F.struct(first.alias("day"), F.lit("add").alias("action")),
        F.when(F.col("n") % 3 == 0, F.struct(F.date_add(first, 30 + F.col("n") % 90).alias("day"), F.lit("remove").alias("action"))),
        F.when(F.col("n") % 6 == 0, F.struct(F.date_add(first, 150).alias("day"), F.lit("add").alias("action"))),
    )
    listed = patterns.withColumn("n", n).where("n % 4 < 2")
    return listed.select("pattern", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("pattern", "e.day", "e.action")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, fetched, blocked, pattern, listed and delisted of every page, as of a day drawn from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date '2024-01-01', cast(pmod(page_id * 37, 365) as int))"))
    out = url_lists.evaluate(captures, list_entries(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed", "delisted")})


QUERIES |= {"op10_url_lists": op10_url_lists}
ORACLES |= {
    "op10_url_lists": """
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched,
    rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '.') AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
patterns AS (
  SELECT host AS pattern FROM hosts
  UNION SELECT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) FROM hosts WHERE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) <> ''
  UNION SELECT host || '/en' FROM hosts),
numbered AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS n FROM patterns),
entries AS (
  SELECT pattern, DATE '2024-01-01' + n % 200 AS day, 'add' AS action FROM numbered WHERE n % 4 < 2
  UNION ALL SELECT pattern, DATE '2024-01-01' + n % 200 + 30 + n % 90, 'remove' FROM numbered WHERE n % 4 < 2 AND n % 3 = 0
  UNION ALL SELECT pattern, DATE '2024-01-01' + n % 200 + 150, 'add' FROM numbered WHERE n % 4 < 2 AND n % 6 = 0),
daily AS (SELECT pattern, day, bool_or(action = 'remove') AS removes FROM entries GROUP BY 1, 2),
ordered AS (SELECT pattern, day AS listed, removes, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS delisted FROM daily),
hits AS (
  SELECT c.page_id, c.url, i.pattern, i.listed, i.delisted,
    row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(i.pattern) DESC, i.pattern DESC) AS nth
  FROM captures c JOIN ordered i ON NOT i.removes AND c.fetched >= i.listed AND (i.delisted IS NULL OR c.fetched < i.delisted)
    AND c.host <> '' AND (
    c.host = i.pattern OR ends_with(c.host, '.' || i.pattern)
    OR (contains(i.pattern, '/') AND (c.host || c.path = i.pattern OR starts_with(c.host || c.path, i.pattern || '/')))))
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, h.pattern IS NOT NULL AS blocked, h.pattern,
  CAST(h.listed AS VARCHAR) AS listed, CAST(h.delisted AS VARCHAR) AS delisted
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url = h.url AND h.nth = 1
"""
}
