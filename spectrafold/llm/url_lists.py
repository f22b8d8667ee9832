"""URL filters by dated lists: a temporal join of captures with list entries.

A list is a history of entries: a pattern was added or removed on a day. Each entry becomes an interval
that ends where the next entry of its pattern begins. A capture has one key for each pattern that could
match it, every suffix of its host by labels and every prefix of its path by segments behind the whole
host; an equality join on the key gives the history of each such pattern, from which the as-of join takes the
one interval, if any, that holds the time of the fetch. Keys are 128-bit hashes of labels from the last to
the first and then of segments, so that long URLs don't make long keys. Any share of all captures may have
one key: the join is salted. The host of an address in numbers or brackets has no suffixes.

Defined results: of entries of one pattern and day the removal counts; null patterns, days and actions are
left out. A capture without a usable URL or without a time matches nothing. The most specific (longest)
active pattern is reported. Equal captures get equal results. URLs may be of any length; empty tables are
no special case. Columns of the captures are kept, whatever their names; ``blocked``, ``pattern``,
``listed`` and ``delisted`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, let, spread_join

ADDED = ("blocked", "pattern", "listed", "delisted")


def host(url: Column) -> Column:
    """The host in lower case, without port, user and a final dot; empty for anything else."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#]+)", 1))
    return F.coalesce(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path without query, fragment and a final slash."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.regexp_replace(found, r"/+$", ""), F.lit(""))


def _steps(host_part: Column, segments: Column) -> Column:
    """What a pattern is made of, the widest first: labels from the last to the first, then segments of a path."""
    number = host_part.rlike(r"^([0-9.]+|\[.*)$")
    labels = F.when(number, F.array(host_part)).otherwise(F.reverse(F.split(host_part, r"\.")))
    return F.concat(labels, F.transform(segments, lambda s: F.concat(F.lit("/"), s)))


def _hashes(steps: Column, sizes: Column) -> Column:
    """(a, b): the hash of so many first steps, for each of the sizes."""
    return let(steps, lambda x: F.transform(sizes, lambda n: F.struct(F.xxhash64(F.lit(0), F.slice(x, F.lit(1), n)).alias("a"), F.xxhash64(F.lit(1), F.slice(x, F.lit(1), n)).alias("b"))))


def keys(url: Column) -> Column:
    """The key (a, b) of every pattern that would match a URL: suffixes of the host, and the host with prefixes of the path."""
    parts = F.split(path(url), "/")
    steps = _steps(host(url), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.when(host(url) != "", _hashes(steps, F.sequence(F.lit(1), F.size(steps))))


def pattern_key(pattern: Column) -> Column:
    """The key (a, b) of a pattern: a host or the end of one, or a whole host and the beginning of a path."""
    parts = F.split(pattern, "/")
    steps = _steps(parts[0], F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.get(_hashes(steps, F.array(F.size(steps))), F.lit(0))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, listed, delisted (null: still listed) from entries (pattern, day, action: add or remove)."""
    usable = entries.where(F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = usable.groupBy("pattern", "day").agg(F.max(F.col("action") == "remove").alias("removes"))
    # a pattern has few entries, however many captures it matches
    ordered = daily.withColumn("delisted", F.lead("day").over(Window.partitionBy("pattern").orderBy("day")))
    return ordered.where("not removes").select("pattern", F.col("day").alias("listed"), "delisted")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Captures with the decision of the entries that were active at the time of each fetch."""
    read = captures.select(beside(captures, *ADDED), F.col(url).alias("u"), F.col(fetched).alias("at"))
    read = read.withColumns({"c": F.xxhash64(F.lit(0), "u", F.col("at").cast("string")), "d": F.xxhash64(F.lit(1), "u", F.col("at").cast("string"))})
    history = intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("listed", "delisted")).alias("history"))
    history = history.withColumn("key", pattern_key(F.col("pattern"))).select("key.*", "pattern", "history")
    asked = read.where(F.col("at").isNotNull() & F.col("u").isNotNull()).select("c", "d", "at", "u").distinct()
    asked = asked.select("c", "d", "at", F.explode(keys(F.col("u"))).alias("key")).select("c", "d", "at", "key.*")
    met = spread_join(asked, history, ["a", "b"], "c")
    active = F.filter("history", lambda i: (F.col("at") >= i["listed"]) & (i["delisted"].isNull() | (F.col("at") < i["delisted"])))
    hits = met.withColumn("i", F.get(active, F.lit(0))).where("i is not null")
    best = hits.groupBy("c", "d").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "i.listed", "i.delisted")).alias("hit"))
    out = read.join(best, ["c", "d"], "left")
    return out.select("row.*", F.col("hit").isNotNull().alias("blocked"), *[F.col(f"hit.{c}").alias(c) for c in ADDED[1:]])
