"""The registered graph-signal queries and their DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model_oracles
from .functions import links
from .functions.filters import NAMES, Filter, custom, multivariate, univariate
from .operators import dense, distributed, linop, models, tables, transform
from .operators.graphs import Graph, ProductGraph
from .plans import rules
from .sources import signals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *values: str, digits: int = 4) -> DataFrame:
    return df.withColumns({v: F.round(v, digits) + F.lit(0.0) for v in values or ("v",)})


# ---- inputs -------------------------------------------------------------------------------------------

DAYS, TYPES = 30, 5


def day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each day has of each type, on 30 days and 5 types."""
    events = signals.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")
    return signals.cube(events, ["day", "event_type"], F.count("*"), fill=0.0)[0]


def day_type_graph(spark: SparkSession) -> ProductGraph:
    return ProductGraph(Graph.chain(spark, DAYS), Graph.complete(spark, TYPES))


def partial(signal: DataFrame) -> DataFrame:
    """A signal of which a third of the cells is missing."""
    return signal.withColumn("v", F.when((F.col("ax0") + F.col("ax1")) % 3 != 0, F.col("v")))


def month_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of orders in millions by month and nation; months and nations without orders are NULL."""
    orders = signals.read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = signals.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = orders.join(customer, "o_custkey").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "c_nationkey", "o_totalprice")
    return signals.cube(rows, ["month", "c_nationkey"], F.sum("o_totalprice") / 1e6)[0]


def region_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations of one region are next to each other."""
    nation = signals.read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    other = nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey")
    pairs = nation.join(other, "n_regionkey").where("n_nationkey < dst").select(F.col("n_nationkey").alias("src"), "dst")
    return Graph.from_edges(pairs, 25)


def month_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price of line items (thousands) by ship month and return flag, with mean quantity, discount and tax."""
    items = signals.read(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    cells = items.groupBy("month", "l_returnflag").agg((F.avg("l_extendedprice") / 1e3).alias("v"), F.array(F.avg("l_quantity") / 50, F.avg("l_discount") * 10, F.avg("l_tax") * 10).alias("x"))
    months, flags = signals.axis(cells, "month", "ax0"), signals.axis(cells, "l_returnflag", "ax1")
    full = months.join(flags.withColumnRenamed("label", "l_returnflag"), how="cross").withColumnRenamed("label", "month").join(cells, ["month", "l_returnflag"], "left")
    return full.select("ax0", "ax1", "v", F.coalesce("x", F.array(*[F.lit(0.0)] * 3)).alias("x"))


def month_flag_graph(signal: DataFrame) -> ProductGraph:
    n0, n1 = signal.agg(F.max("ax0") + 1, F.max("ax1") + 1).first()
    return ProductGraph(Graph.chain(signal.sparkSession, n0), Graph.complete(signal.sparkSession, n1))


def hour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source and language of documents, whether most labelled documents are of quality 1."""
    docs = signals.read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = signals.read(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left")
    signal, _ = signals.cube(rows, ["source", "lang"], F.avg("quality"))
    return signal


def source_graph(signal: DataFrame) -> ProductGraph:
    return month_flag_graph(signal)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, x: the mean embedding of each label."""
    rows = signals.read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "e"))
    means = rows.groupBy("label", "pos").agg(F.avg(F.col("e").cast("double")).alias("e"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "e"))), lambda s: s["e"])
    return means.groupBy("label").agg(ordered.alias("x"))


# ---- SQL of the same inputs ---------------------------------------------------------------------------

_DAY_TYPE = """
days AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS ax0 FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS ax1 FROM (SELECT DISTINCT event_type FROM events)),
counts AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
sig AS (
  SELECT d.ax0, t.ax1, CAST(coalesce(c.n, 0) AS DOUBLE) AS v FROM days d CROSS JOIN types t
  LEFT JOIN counts c ON c.day = d.day AND c.event_type = t.event_type)"""


def _basis_sql(name: str, n: int, kind: str) -> str:
    lam = {"chain": f"2 - 2 * cos(pi() * k / {n})", "complete": f"CASE WHEN k = 0 THEN 0.0 ELSE {n}.0 END"}[kind]
    return f"""
{name} AS (
  SELECT CAST(i AS INTEGER) AS i, CAST(k AS INTEGER) AS k, {lam} AS lam,
    CASE WHEN k = 0 THEN sqrt(1.0 / {n}) ELSE sqrt(2.0 / {n}) * cos(pi() * (i + 0.5) * k / {n}) END AS u
  FROM range({n}) a(i) CROSS JOIN range({n}) b(k))"""


_BASES = _basis_sql("b0", DAYS, "chain") + "," + _basis_sql("b1", TYPES, "complete")
_SPECTRUM = """
spec AS (
  SELECT a.k AS k0, b.k AS k1, any_value(a.lam) AS lam0, any_value(b.lam) AS lam1, sum(s.v * a.u * b.u) AS z
  FROM sig s JOIN b0 a ON a.i = s.ax0 JOIN b1 b ON b.i = s.ax1 GROUP BY 1, 2)"""


def _filter_sql(gain: str, digits: int = 4) -> str:
    return f"""WITH {_DAY_TYPE}, {_BASES}, {_SPECTRUM}
SELECT a.i AS ax0, b.i AS ax1, round(sum(z * ({gain}) * a.u * b.u), {digits}) + 0.0 AS v
FROM spec JOIN b0 a ON a.k = k0 JOIN b1 b ON b.k = k1 GROUP BY 1, 2"""


_GAINS = {
    "random_walk": "1 / (1 + {s})",
    "diffusion": "exp(-({s}))",
    "relu": "greatest(1 - ({s}), 0.0)",
    "sigmoid": "2 * exp(-({s})) / (1 + exp(-({s})))",
}


# ---- constructors, validation, Laplacians -------------------------------------------------------------


_MONTHS = "months AS (SELECT CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders))"
_NATIONS = "nations AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS i FROM nation)"
_REGIONS = "regions AS (SELECT CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS i FROM region)"


def _size(spark: SparkSession, sf_dir: str, table: str) -> int:
    return signals.read(spark, sf_dir, table).count()


def order_months(spark: SparkSession, sf_dir: str) -> int:
    """How many months have orders."""
    return signals.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct().count()


def event_hours(spark: SparkSession, sf_dir: str) -> int:
    """How many hours have events."""
    return signals.read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour")).distinct().count()


@query(f"""WITH {_MONTHS} SELECT i AS node, CAST(CASE WHEN i IN (0, (SELECT max(i) FROM months)) THEN 1 ELSE 2 END AS DOUBLE) AS degree FROM months""")
def graph_chain_degree(spark, sf_dir):
    """The months with orders, each next to the following one."""
    return Graph.chain(spark, order_months(spark, sf_dir)).degrees()


@query("""WITH hours AS (SELECT CAST(row_number() OVER (ORDER BY hour) - 1 AS INTEGER) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events))
SELECT a.i, b.i AS j, CAST(CASE WHEN a.i = b.i THEN 2 ELSE -1 END AS DOUBLE) AS w FROM hours a, hours b WHERE a.i = b.i OR (a.i - b.i + a.n) % a.n IN (1, a.n - 1)""")
def graph_loop_laplacian(spark, sf_dir):
    """The hours with events on a loop."""
    return Graph.loop(spark, event_hours(spark, sf_dir)).laplacian()


@query(f"WITH {_NATIONS} SELECT a.i AS src, b.i AS dst, CAST(1 AS DOUBLE) AS w FROM nations a, nations b WHERE a.i <> b.i")
def graph_complete_edges(spark, sf_dir):
    """All nations next to each other."""
    return Graph.complete(spark, _size(spark, sf_dir, "nation")).edges


@query(f"""WITH {_MONTHS}, {_NATIONS}, s AS (SELECT count(*) AS n FROM nations)
SELECT m.i * n + k.i AS src, p.i * n + q.i AS dst, CAST(1 AS DOUBLE) AS w FROM s, months m, nations k, months p, nations q
WHERE (p.i = m.i AND abs(k.i - q.i) = 1) OR (q.i = k.i AND abs(m.i - p.i) = 1)""")
def graph_lattice_edges(spark, sf_dir):
    """Months with orders by nations, as a lattice."""
    return ProductGraph.lattice(spark, order_months(spark, sf_dir), _size(spark, sf_dir, "nation")).edges()


@query(f"WITH {_DAY_TYPE} SELECT CAST(ax0 * (SELECT count(*) FROM types) + ax1 AS BIGINT) AS node, CAST(4 AS DOUBLE) AS degree FROM sig")
def graph_torus_degree(spark, sf_dir):
    """Days by types of events, as a torus."""
    days, types = day_type(spark, sf_dir).agg(F.max("ax0") + 1, F.max("ax1") + 1).first()
    return ProductGraph.torus(spark, days, types).edges().groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("degree"))


@query("""WITH s AS (SELECT (SELECT count(*) FROM region) AS w, (SELECT count(*) FROM nation) AS h)
SELECT CAST(2 * (3 * ((w - 1) * h + w * (h - 1)) + w * h * 3) AS BIGINT) AS edges, CAST(3 * w * h AS BIGINT) AS nodes FROM s""")
def graph_image_size(spark, sf_dir):
    """Regions by nations by three colours."""
    edges = ProductGraph.image(spark, _size(spark, sf_dir, "region"), _size(spark, sf_dir, "nation")).edges()
    return edges.agg(F.count("*").alias("edges"), F.countDistinct("src").alias("nodes"))


@query("""SELECT n_nationkey AS i, n_nationkey AS j, CAST(count(*) OVER (PARTITION BY n_regionkey) - 1 AS DOUBLE) AS w FROM nation
UNION ALL SELECT a.n_nationkey, b.n_nationkey, CAST(-1 AS DOUBLE) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey""")
def nation_region_laplacian(spark, sf_dir):
    kind = signals.read(spark, sf_dir, "nation").schema["n_nationkey"].dataType
    return region_graph(spark, sf_dir).laplacian().select(F.col("i").cast(kind), F.col("j").cast(kind), "w")


@query("""WITH s AS (SELECT count(*) AS n FROM supplier)
SELECT 'tree' AS graph, 'nodes' AS measure, CAST(n AS BIGINT) AS value FROM s UNION ALL SELECT 'tree', 'edges', n - 1 FROM s UNION ALL SELECT 'tree', 'components', 1
UNION ALL SELECT 'connected', 'nodes', n FROM s UNION ALL SELECT 'connected', 'components', 1
UNION ALL SELECT 'regular', 'nodes', n - n % 2 FROM s UNION ALL SELECT 'regular', 'edges', CAST(n // 2 * 3 AS BIGINT) FROM s
UNION ALL SELECT 'regular', 'least degree', 3 UNION ALL SELECT 'regular', 'greatest degree', 3""")
def graph_random_invariants(spark, sf_dir):
    """Random graphs of the suppliers: what isn't random of their edges, degrees and components."""
    n, rows = _size(spark, sf_dir, "supplier"), []
    for name, g in (("tree", Graph.random_tree(spark, n, 3)), ("connected", Graph.random_connected(spark, n, seed=3)), ("regular", Graph.random_regular(spark, n - n % 2, 3, 1))):
        sizes = g.edges.groupBy("src").count().agg(F.count("*").alias("nodes"), F.min("count").alias("low"), F.max("count").alias("high"), (F.sum("count") / 2).cast("long").alias("edges")).first()
        rows.append((name, "nodes", sizes["nodes"]))
        if name != "connected":
            rows.append((name, "edges", sizes["edges"]))
        if name == "regular":
            rows += [(name, "least degree", sizes["low"]), (name, "greatest degree", sizes["high"])]
        else:
            rows.append((name, "components", g.components()))
    return spark.createDataFrame(rows, "graph string, measure string, value long")


@query(f"""WITH {_MONTHS} SELECT a.i, b.i AS j, CAST(CASE WHEN a.i <> b.i THEN -1 WHEN a.i IN (0, (SELECT max(i) FROM months)) THEN 1 ELSE 2 END AS DOUBLE) AS w
FROM months a, months b WHERE abs(a.i - b.i) <= 1""")
def laplacian_round_trip(spark, sf_dir):
    """Adjacency to Laplacian to a graph and back, with both checks."""
    n = order_months(spark, sf_dir)
    return Graph.from_laplacian(Graph.chain(spark, n).laplacian(), n).laplacian()


@query("""SELECT 'symmetric' AS matrix, CAST(0 AS BIGINT) AS faults UNION ALL
SELECT 'asymmetric', CAST(2 * count(*) AS BIGINT) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND a.n_nationkey % 2 = 0""")
def validate_adjacency(spark, sf_dir):
    """The nations of a region next to each other, whole, and without one direction of some pairs."""
    from .operators.graphs import asymmetric

    edges = _peers(spark, sf_dir)
    bad = edges.where("not (i < j and i % 2 = 0)")
    count = lambda t, name: asymmetric(t).agg(F.lit(name).alias("matrix"), F.count("*").alias("faults"))
    return count(edges, "symmetric").union(count(bad, "asymmetric"))


@query(f"""WITH {_DAY_TYPE} SELECT s.ax0, s.ax1, round(
  coalesce(sum(s.v - o.v), 0), 4) + 0.0 AS v
FROM sig s LEFT JOIN sig o ON (abs(s.ax0 - o.ax0) = 1 AND s.ax1 = o.ax1) OR (s.ax0 = o.ax0 AND s.ax1 <> o.ax1) GROUP BY 1, 2""")
def laplacian_product(spark, sf_dir):
    return rounded(transform.laplacian_product(day_type(spark, sf_dir), day_type_graph(spark)))


@query("""WITH rows AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey, sum(o_totalprice) / 1e6 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
months AS (SELECT month, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS ax0 FROM (SELECT DISTINCT month FROM rows))
SELECT m.ax0, round(sum(pow(a.v - b.v, 2)), 4) + 0.0 AS smoothness FROM rows a JOIN rows b ON a.month = b.month AND a.c_nationkey < b.c_nationkey
JOIN nation n ON n.n_nationkey = a.c_nationkey JOIN nation p ON p.n_nationkey = b.c_nationkey AND p.n_regionkey = n.n_regionkey
JOIN months m ON m.month = a.month GROUP BY 1""")
def order_smoothness(spark, sf_dir):
    """y' L y of each month's order values over the regions' nations."""
    cells = month_nation(spark, sf_dir).where("v is not null").select(F.col("ax0").alias("month"), F.col("ax1").alias("ax0"), "v")
    out = transform.smoothness(cells, region_graph(spark, sf_dir), ["month"])
    return rounded(out.withColumnRenamed("month", "ax0"), "smoothness")


# ---- transforms and filters ---------------------------------------------------------------------------


@query(f"""WITH {_DAY_TYPE}, {_basis_sql("b0", DAYS, "chain")}
SELECT b0.k AS ax0, round(sum(v * u), 4) + 0.0 AS v FROM sig JOIN b0 ON b0.i = sig.ax0 GROUP BY 1""")
def events_gft_chain(spark, sf_dir):
    days = day_type(spark, sf_dir).groupBy("ax0").agg(F.sum("v").alias("v"))
    return rounded(transform.gft(days, Graph.chain(spark, DAYS)))


@query(f"WITH {_DAY_TYPE} SELECT round(sum(v * v), 3) AS vertices, round(sum(v * v), 3) AS spectrum, round(0.0, 3) AS trip FROM sig")
def events_parseval(spark, sf_dir):
    """The energy on both sides of the transform, and the greatest error of a round trip."""
    y, g = day_type(spark, sf_dir), day_type_graph(spark)
    z = transform.gft(y, g)
    back = transform.rgft(z, g).withColumnRenamed("v", "b")
    energy = lambda t, n: t.agg(F.round(F.sum(F.col("v") * F.col("v")), 3).alias(n))
    trip = y.join(back, ["ax0", "ax1"]).agg((F.round(F.max(F.abs(F.col("v") - F.col("b"))), 3) + 0.0).alias("trip"))
    return energy(y, "vertices").join(energy(z, "spectrum"), how="cross").join(trip, how="cross")


def _register_filters() -> None:
    def make(g: Filter, power: float | None = None):
        return lambda spark, sf_dir: rounded(transform.filter_signal(day_type(spark, sf_dir), day_type_graph(spark), g, power))

    for name in NAMES:
        if name == "bandlimited":
            one, many = "CASE WHEN lam0 + lam1 <= 1 / 0.15 THEN 1.0 ELSE 0.0 END", "CASE WHEN lam0 * 0.4 < 1 AND lam1 * 0.15 < 1 THEN 1.0 ELSE 0.0 END"
            g1, g2 = univariate(name, 0.15), multivariate(name, 0.4, 0.15)
        else:
            one, many = _GAINS[name].format(s="0.4 * (lam0 + lam1)"), _GAINS[name].format(s="0.3 * lam0 + 0.4 * lam1")
            g1, g2 = univariate(name, 0.4), multivariate(name, 0.3, 0.4)
        query(_filter_sql(one), f"filter_{name}")(make(g1))
        query(_filter_sql(many), f"filter_{name}_mv")(make(g2))
    query(_filter_sql("pow(1 / (1 + 0.4 * (lam0 + lam1)), 2.0)"), "filter_power")(make(univariate("random_walk", 0.4), 2))
    query(_filter_sql("pow(1 + 0.4 * (lam0 + lam1), -2.0)"), "filter_custom_two_hop")(make(custom(lambda lam, b: 1 / ((1 + b * lam) * (1 + b * lam)), 0.4)))
    query(_filter_sql("exp(-0.7 * (lam0 + lam1))"), "filter_fused")(make(rules.fuse(univariate("diffusion", 0.4), univariate("diffusion", 0.3))))
    query(_filter_sql("exp(-0.4 * (lam0 + lam1))"), "filter_polynomial")(lambda spark, sf_dir: rounded(transform.chebyshev(day_type(spark, sf_dir), day_type_graph(spark), univariate("diffusion", 0.4), degree=14)))


_register_filters()


@query("""WITH hours AS (SELECT h AS ax0, coalesce(n, 0.0) AS v FROM range(24) t(h) LEFT JOIN (
  SELECT date_part('hour', ts) AS hh, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) e ON e.hh = t.h),
kernel AS (SELECT a.i, b.j, sum(exp(-0.5 * (2 - 2 * cos(2 * pi() * k / 24))) * cos(2 * pi() * k * (a.i - b.j) / 24)) / 24 AS u
  FROM range(24) a(i), range(24) b(j), range(24) c(k) GROUP BY 1, 2)
SELECT CAST(kernel.i AS INTEGER) AS ax0, round(sum(u * v), 4) + 0.0 AS v FROM kernel JOIN hours ON hours.ax0 = kernel.j GROUP BY 1""")
def filter_loop_hours(spark, sf_dir):
    """Diffusion of the counts by hour of day around the clock."""
    counts = signals.read(spark, sf_dir, "events").groupBy(F.hour("ts").alias("ax0")).agg(F.count("*").cast("double").alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("ax0")).join(counts, "ax0", "left").select("ax0", F.coalesce("n", F.lit(0.0)).alias("v"))
    return rounded(transform.filter_signal(hours, Graph.loop(spark, 24), univariate("diffusion", 0.5)))


@query(f"""WITH {_DAY_TYPE} SELECT a.ax0, b.ax1, round(a.v * b.v, 3) + 0.0 AS v FROM
  (SELECT ax0, sum(v) AS v FROM sig GROUP BY 1) a CROSS JOIN (SELECT ax1, sum(v) AS v FROM sig GROUP BY 1) b""")
def outer_product(spark, sf_dir):
    y = day_type(spark, sf_dir)
    return rounded(transform.outer_product(y.groupBy("ax0").agg(F.sum("v").alias("v")), y.groupBy("ax1").agg(F.sum("v").alias("v"))), digits=3)


@query(f"WITH {_DAY_TYPE} SELECT ax0, ax1, CAST(ax0 AS BIGINT) * 5 + ax1 AS flat, 0 AS batch, v FROM sig")
def flatten_axes(spark, sf_dir):
    """Row-major numbers of the cells, back to coordinates, and a further axis."""
    g = day_type_graph(spark)
    flat = day_type(spark, sf_dir).select(transform.flat_id(g).alias("flat"), "v")
    return transform.expand_axis(flat.select(*transform.unflatten(F.col("flat"), g), "flat", "v"), "batch")


# ---- preprocessing, links, encodings ------------------------------------------------------------------


@query(f"""WITH {_DAY_TYPE}, p AS (SELECT ax0, ax1, CASE WHEN (ax0 + ax1) % 3 <> 0 THEN v END AS v FROM sig),
s AS (SELECT avg(v) AS loc, stddev_pop(v) AS scale FROM p)
SELECT ax0, ax1, v IS NOT NULL AS obs, round(coalesce((v - loc) / scale, 0), 4) + 0.0 AS v FROM p CROSS JOIN s""")
def normalise(spark, sf_dir):
    return rounded(signals.preprocess(partial(day_type(spark, sf_dir))).drop("loc", "scale"))


@query(f"WITH {_DAY_TYPE} SELECT ax0, ax1, CAST(CASE WHEN (ax0 + ax1) % 3 <> 0 THEN v END AS DOUBLE) AS v FROM sig")
def postprocess_round_trip(spark, sf_dir):
    out = signals.postprocess(signals.preprocess(partial(day_type(spark, sf_dir))))
    return out.select("ax0", "ax1", F.when(F.col("obs"), F.round("v", 6)).alias("v"))


@query("SELECT vec_id, CAST(c AS INTEGER) AS c, CAST(CASE WHEN label = c THEN 1 ELSE 0 END AS DOUBLE) AS v FROM embeddings CROSS JOIN range(10) t(c)")
def one_hot(spark, sf_dir):
    return links.one_hot(signals.read(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 10).select("vec_id", "c", "v")


@query("""SELECT vec_id, CAST(c AS INTEGER) AS c, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS p
FROM (SELECT vec_id, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def softmax(spark, sf_dir):
    """Softmax of each vector, as an array function."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    out = signals.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(links.softmax(whole)).alias("c", "p"))
    return rounded(out, "p", digits=6)


@query("""SELECT vec_id, CAST(c AS INTEGER) AS c, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS p
FROM (SELECT vec_id, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def softmax_rows(spark, sf_dir):
    """Softmax over rows of one vector."""
    rows = signals.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "x"))
    return rounded(rows.select("vec_id", "c", links.softmax_over(F.col("x").cast("double"), ["vec_id"]).alias("p")), "p", digits=6)


@query("""SELECT vec_id, CAST(arg_max(c, (x, -c)) AS INTEGER) AS c, CAST(arg_max(c, (x, -c)) AS INTEGER) AS by_array FROM (
  SELECT vec_id, unnest(range(64)) AS c, unnest(embedding) AS x FROM embeddings) GROUP BY 1""")
def argmax_decode(spark, sf_dir):
    rows = signals.read(spark, sf_dir, "embeddings")
    one = links.argmax(rows.select("vec_id", F.posexplode("embedding").alias("c", "x")), ["vec_id"], "c", "x")
    return one.join(rows.select("vec_id", links.argmax_array(F.col("embedding")).alias("by_array")), "vec_id")


@query("""SELECT vec_id, CAST(c AS INTEGER) AS c, round(1 / (1 + exp(-x)), 6) AS p, CAST(x > 0 AS INTEGER) AS label
FROM (SELECT vec_id, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def logistic_link(spark, sf_dir):
    rows = signals.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "x"))
    f = F.col("x").cast("double")
    return rounded(rows.select("vec_id", "c", links.logistic(f).alias("p"), links.threshold(f).alias("label")), "p", digits=6)


@query("""WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2)
SELECT p.label AS a, q.label AS b, round(exp(-sum(pow(p.x - q.x, 2)) / (2 * 0.25)), 6) AS k FROM c p JOIN c q ON p.i = q.i GROUP BY 1, 2""")
def rbf_kernel_pairs(spark, sf_dir):
    """The kernel of all pairs of label centroids."""
    return rounded(models.kernel_pairs(centroids(spark, sf_dir), 0.5, "label"), "k", digits=6)


# ---- operator algebra ---------------------------------------------------------------------------------


@query(f"""WITH {_DAY_TYPE}, {_BASES}, {_SPECTRUM}
SELECT a.i AS ax0, b.i AS ax1, round(sum(z * (2 * pow(lam0 + lam1, 2) + 1) * a.u * b.u), 3) + 0.0 AS v
FROM spec JOIN b0 a ON a.k = k0 JOIN b1 b ON b.k = k1 GROUP BY 1, 2""")
def operator_algebra(spark, sf_dir):
    """(2 L L' + I) y, composed lazily."""
    lap = linop.KroneckerSum(day_type_graph(spark))
    return rounded((2 * (lap @ lap.T) + linop.Identity()) @ day_type(spark, sf_dir), digits=3)


@query(_filter_sql("exp(-0.3 * lam0 - 0.4 * lam1)"))
def operator_kronecker(spark, sf_dir):
    """A Kronecker product of one kernel for each axis."""
    g = day_type_graph(spark)
    kernels = [(transform.axis_kernel(f, F.exp(-F.col("lam") * b)), f.n**2) for f, b in zip(g.factors, (0.3, 0.4))]
    return rounded(linop.KroneckerProduct(tuple(kernels)).T @ day_type(spark, sf_dir))


@query(f"WITH {_DAY_TYPE} SELECT ax0, ax1, round(v / 100 * (SELECT sum(o.v * o.v) / 100 FROM sig o WHERE o.ax0 = sig.ax0), 3) + 0.0 AS v FROM sig")
def operator_mu_block(spark, sf_dir):
    """mu mu' y for each day, with the types as classes."""
    y = day_type(spark, sf_dir)
    mu = y.select("ax0", "ax1", (F.col("v") / 100).alias("mu"))
    return rounded(linop.MuBlock(mu, ("ax0",), "ax1").apply(y), digits=3)


@query("""WITH x AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c FROM lineitem),
long AS (SELECT sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc FROM x)
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, 2) AS v FROM (
  SELECT 0 AS i, 0 AS j, aa AS v FROM long UNION ALL SELECT 0, 1, ab FROM long UNION ALL SELECT 0, 2, ac FROM long
  UNION ALL SELECT 1, 0, ab FROM long UNION ALL SELECT 1, 1, bb FROM long UNION ALL SELECT 1, 2, bc FROM long
  UNION ALL SELECT 2, 0, ac FROM long UNION ALL SELECT 2, 1, bc FROM long UNION ALL SELECT 2, 2, cc FROM long)""")
def gram_matrix(spark, sf_dir):
    items = signals.read(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10).alias("x"))
    return rounded(linop.gram(items), digits=2)


@query(f"""WITH {_DAY_TYPE}, f AS (SELECT ax0, v / sum(v) OVER (PARTITION BY ax0) AS mu, ax1 AS c, ax0 / 30.0 AS x1, 1.0 AS x0 FROM sig),
x AS (SELECT ax0, c, mu, unnest([0, 1]) AS i, unnest([x0, x1]) AS a FROM f)
SELECT CAST(p.i AS INTEGER) AS i, p.c, CAST(q.i AS INTEGER) AS j, q.c AS d, round(sum(p.a * q.a * (CASE WHEN p.c = q.c THEN p.mu ELSE 0 END - p.mu * q.mu)), 4) + 0.0 AS v
FROM x p JOIN x q ON p.ax0 = q.ax0 GROUP BY 1, 2, 3, 4""")
def softmax_gram(spark, sf_dir):
    """X' R X of class shares by day with the day as a feature, over all days."""
    y = day_type(spark, sf_dir)
    arrays = y.groupBy("ax0").agg(F.transform(F.array_sort(F.collect_list(F.struct("ax1", "v"))), lambda s: s["v"]).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    rows = arrays.select(F.array(F.lit(1.0), F.col("ax0") / 30.0).alias("x"), F.transform("v", lambda x: x / total).alias("mu"))
    return rounded(linop.softmax_gram(rows))


@query("SELECT CAST(model AS INTEGER) AS model, true AS stationary FROM range(9) t(model)")
def model_stationarity(spark, sf_dir):
    """Whether the gradients of nine models' penalised likelihoods vanish at their solutions (squares up to 1e-5)."""
    gamma, lam = 1.2, 5.0

    def run(y, s, x, prior, loc, scale):
        days, types = np.indices(y.shape)
        x = np.stack([days / 30, types / 5, np.cos(days)], -1)
        hot = np.eye(3)[np.digitize(y, [-0.5, 0.5])] * s[..., None]
        label = s * (y > 0)
        k, v = np.linalg.eigh(dense.rbf_kernel(np.arange(3.0)[:, None], 1.0))
        kernel = prior.with_kernel(v, k)
        y3, s3, l3, h3 = (np.stack([a, 0.5 * a if a is y else a, a]) for a in (y, s, label, hot))

        def smooth(b, p):  # gamma H^-2 b, by the spectrum; gains are positive here
            spectral = dense.Prior(p.bases, np.ones_like(p.gain))
            extra = (1,) * (b.ndim - p.gain.ndim)
            return gamma * spectral.to_vertices(spectral.to_spectrum(b) / (p.gain**2).reshape(p.gain.shape + extra))

        def gap(r, b, p, w=None):
            worst = np.abs(r + smooth(b, p)).max()
            if w is not None:
                m = x.reshape(-1, 3).T @ r.reshape(days.size, -1) + lam * w.reshape(3, -1)
                worst = max(worst, np.abs(m).max())
            return float(worst) ** 2 <= 1e-5

        out = []
        f = dense.gsr(s * y, s, prior, gamma)
        out.append(gap(s * (f - y), f, prior))
        f = dense.gsr(s3 * y3, s3, kernel, gamma)
        out.append(gap(s3 * (f - y3), f, kernel))
        b, w = dense.solve_rnc(s * y, s, x, prior, gamma, lam)
        out.append(gap(s * (b + x @ w - y), b, prior, w))
        f = dense.lgsr(label, s, prior, gamma)
        out.append(gap(s * (dense.mu_logistic(f) - label), f, prior))
        f = dense.lgsr(l3, s3, kernel, gamma)
        out.append(gap(s3 * (dense.mu_logistic(f) - l3), f, kernel))
        b, w = dense.lrnc(label, s, x, prior, gamma, lam)
        out.append(gap(s * (dense.mu_logistic(b + x @ w) - label), b, prior, w))
        f = dense.lgsr_multiclass(hot, s, prior, gamma)
        out.append(gap(s[..., None] * (dense.mu_softmax(f) - hot), f, prior))
        f = dense.lgsr_multiclass(h3, s3, kernel, gamma)
        out.append(gap(s3[..., None] * (dense.mu_softmax(f) - h3), f, kernel))
        b, w = dense.lrnc_multiclass(hot, s, x, prior, gamma, lam)
        out.append(gap(s[..., None] * (dense.mu_softmax(b + x @ w) - hot), b, prior, w))
        return np.array([[i, float(fine)] for i, fine in enumerate(out)])

    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), multivariate("diffusion", 0.3, 0.1), gamma)
    out = model._run(run, "model double, fine double", cells=False)
    return out.select(F.col("model").cast("int").alias("model"), (F.col("fine") == 1).alias("stationary"))


# ---- reconstruction -----------------------------------------------------------------------------------

_SHRUNK = _filter_sql("exp(-0.8 * (lam0 + lam1)) / (exp(-0.8 * (lam0 + lam1)) + 0.5)")


@query(_SHRUNK)
def gsr_closed_form(spark, sf_dir):
    """Everything observed: one filter, by tables alone."""
    return rounded(rules.closed_form(day_type(spark, sf_dir), day_type_graph(spark), univariate("diffusion", 0.4), 0.5))


_RICHARDSON = f"""WITH RECURSIVE {_DAY_TYPE}, {_BASES},
k0 AS (SELECT a.i, b.i AS j, sum(exp(-0.8 * a.lam) * a.u * b.u) AS h FROM b0 a JOIN b0 b ON a.k = b.k GROUP BY 1, 2),
k1 AS (SELECT a.i, b.i AS j, sum(exp(-0.8 * a.lam) * a.u * b.u) AS h FROM b1 a JOIN b1 b ON a.k = b.k GROUP BY 1, 2),
seen AS (SELECT ax0, ax1, v FROM sig WHERE (ax0 + ax1) % 3 <> 0),
stats AS (SELECT avg(v) AS loc, stddev_pop(v) AS scale FROM seen),
o AS (SELECT ax0, ax1, (v - loc) / scale AS y FROM seen CROSS JOIN stats),
k AS (SELECT p.ax0 AS p0, p.ax1 AS p1, q.ax0 AS q0, q.ax1 AS q1, a.h * b.h AS h
  FROM o p CROSS JOIN o q JOIN k0 a ON a.i = p.ax0 AND a.j = q.ax0 JOIN k1 b ON b.i = p.ax1 AND b.j = q.ax1),
step AS (
  SELECT 0 AS n, ax0, ax1, CAST(0 AS DOUBLE) AS a FROM o
  UNION ALL
  SELECT s.n + 1, p.ax0, p.ax1, any_value(p.a) + 2 / (2 * 0.5 + 1) * (any_value(o.y) - 0.5 * any_value(p.a) - sum(k.h * s.a))
  FROM step s JOIN k ON k.q0 = s.ax0 AND k.q1 = s.ax1 JOIN step p ON p.ax0 = k.p0 AND p.ax1 = k.p1 AND p.n = s.n
  JOIN o ON o.ax0 = p.ax0 AND o.ax1 = p.ax1 WHERE s.n < 60 GROUP BY s.n, p.ax0, p.ax1),
dual AS (SELECT ax0, ax1, a FROM step WHERE n = 60)
SELECT c.ax0, c.ax1, round(sum(a.h * b.h * d.a) * any_value(scale) + any_value(loc), 3) + 0.0 AS v
FROM sig c CROSS JOIN dual d CROSS JOIN stats JOIN k0 a ON a.i = c.ax0 AND a.j = d.ax0 JOIN k1 b ON b.i = c.ax1 AND b.j = d.ax1 GROUP BY 1, 2"""


@query(_RICHARDSON)
def gsr_partial(spark, sf_dir):
    """A third of the cells missing: conjugate gradients in one task."""
    return rounded(models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), 0.5).solve(), digits=3)


@query(_RICHARDSON)
def gsr_partial_tables(spark, sf_dir):
    """The same by conjugate gradients over tables, as for signals that no task can hold."""
    y = partial(day_type(spark, sf_dir))
    stats = F.broadcast(signals.statistics(y))  # one row
    normal = y.join(stats, how="cross").withColumn("v", (F.col("v") - F.col("loc")) / F.col("scale")).drop("loc", "scale")
    out = distributed.reconstruct(normal, day_type_graph(spark), univariate("diffusion", 0.4), 0.5)
    return rounded(signals.postprocess(out.join(stats, how="cross")), digits=3)


@query(_RICHARDSON)
def gsr_partial_splitting(spark, sf_dir):
    """The same over tables by a splitting of the system, which needs no inner products."""
    model = tables.TableModel(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), 0.5, solver="splitting")
    return rounded(model.solve(), digits=3)


@query(f"SELECT CAST(t.i AS INTEGER) AS solver, r.ax0, r.ax1, r.v FROM ({_RICHARDSON}) r CROSS JOIN range(4) t(i)")
def solver_agreement(spark, sf_dir):
    """The reconstruction by four solvers of one system: conjugate gradients plain and preconditioned, splitting, elimination."""
    gamma = 0.5

    def run(y, s, x, prior, loc, scale):
        h2 = dense.covariance(prior)
        o = np.flatnonzero(s.ravel())
        a, b = h2[np.ix_(o, o)] + gamma * np.eye(len(o)), y.ravel()[o]
        phi, top = 1 / np.sqrt(np.diag(a)), 1.01 * np.abs(a).sum(1).max()
        found = [
            dense.conjugate_gradients(lambda v: a @ v, b)[0],
            dense.preconditioned(lambda v: a @ v, lambda v: phi * v, lambda v: phi * v, b)[0],
            dense.splitting(lambda v: v - a @ v / top, lambda v: v / top, b, 1e-12, 100_000)[0],
            np.linalg.solve(a, b),
        ]
        return np.stack([(h2[:, o] @ f).reshape(y.shape) * scale + loc for f in found], -1)

    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), gamma)
    out = model._run(run, ", ".join(f"s{i} double" for i in range(4)))
    rows = F.array(*[F.struct(F.lit(i).alias("solver"), F.col(f"s{i}").alias("v")) for i in range(4)])
    return rounded(out.select("ax0", "ax1", F.inline(rows)), digits=3)


@query(_RICHARDSON)
def gsr_partial_dual(spark, sf_dir):
    """The same through the observed cells alone."""
    gamma = 0.5
    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), gamma)
    return rounded(model._run(lambda y, s, x, prior, loc, scale: dense.gsr_dual(y, s, prior, gamma) * scale + loc), digits=3)


@query()
def gsr_planned(spark, sf_dir):
    """Hours by types, reconstructed by the plan that the rules choose."""
    events = signals.read(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), "event_type", "value")
    y, dictionaries = signals.cube(events, ["hour", "event_type"], F.avg("value"))
    n = dictionaries[0].count()
    return rules.reconstruct(y, ProductGraph(Graph.chain(spark, n), Graph.complete(spark, TYPES)), multivariate("diffusion", 2.0, 0.3), 0.5)


@query()
def gsr_sampler(spark, sf_dir):
    """Sampled and exact posterior variance of each cell."""
    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), 0.5)
    sampled = model.estimate_marginal_variance(64, seed=1).withColumnRenamed("variance", "sampled")
    return sampled.join(model.marginal_variance(), ["ax0", "ax1"])


@query()
def gsr_sampler_tables(spark, sf_dir):
    """Posterior variances from draws over tables, with their standard error, beside the exact ones."""
    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), 0.5)
    sampled = model.on_tables().estimate_marginal_variance(16, seed=1).withColumnRenamed("variance", "sampled")
    return sampled.join(model.marginal_variance(), ["ax0", "ax1"])


def _months(signal: DataFrame) -> np.ndarray:
    """Covariates of the months: trend and season."""
    n = np.arange(signal.agg(F.max("ax0")).first()[0] + 1)
    return np.stack([n / 12, np.cos(2 * np.pi * n / 12), np.sin(2 * np.pi * n / 12)], 1)


def _kernel_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return month_nation(spark, sf_dir).select(F.col("ax0").alias("t"), F.col("ax1").alias("ax0"), "v")


MODELS = model_oracles.oracles(_DAY_TYPE)


@query(MODELS["kgr_orders"])
def kgr_orders(spark, sf_dir):
    """Order values of months by nations: a kernel over months, regions as the graph."""
    y = month_nation(spark, sf_dir)
    return rounded(models.KGR(_kernel_signal(spark, sf_dir), region_graph(spark, sf_dir), univariate("diffusion", 0.2), 0.5, covariates=_months(y), kernel_std=1.0).solve(), digits=3)


def _month_rows(signal: DataFrame) -> DataFrame:
    """The covariates of the months as a table (t, x)."""
    n = F.col("t").cast("double")
    return signal.select(F.col("ax0").alias("t")).distinct().withColumn("x", F.array(n / 12, F.cos(2 * np.pi * n / 12), F.sin(2 * np.pi * n / 12)))


@query(MODELS["kgr_orders"])
def kgr_orders_tables(spark, sf_dir):
    """The same over tables: the kernel of the months as an incomplete Cholesky factor, chosen and applied by joins."""
    y = month_nation(spark, sf_dir)
    model = tables.TableModel(_kernel_signal(spark, sf_dir), region_graph(spark, sf_dir), univariate("diffusion", 0.2), 0.5, rows=_month_rows(y), kernel_std=1.0)
    return rounded(model.solve(), digits=3)


@query()
def kgr_orders_variance(spark, sf_dir):
    y = month_nation(spark, sf_dir)
    model = models.KGR(_kernel_signal(spark, sf_dir), region_graph(spark, sf_dir), univariate("diffusion", 0.2), 0.5, covariates=_months(y), kernel_std=1.0)
    return model.estimate_marginal_variance(8, seed=2)


@query(MODELS["rnc_lineitem"])
def rnc_lineitem(spark, sf_dir):
    """Mean prices with features: prediction and intercept of each cell."""
    y = month_flag(spark, sf_dir)
    return rounded(models.RNC(y, month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).solve(), "v", "b", digits=3)


@query(MODELS["rnc_lineitem"])
def rnc_lineitem_tables(spark, sf_dir):
    """The same over tables: the weights by a Schur complement, the cells by block conjugate gradients."""
    y = month_flag(spark, sf_dir)
    return rounded(models.RNC(y, month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).on_tables().solve(), "v", "b", digits=3)


@query(MODELS["rnc_lineitem_weights"])
def rnc_lineitem_weights_tables(spark, sf_dir):
    """The weights of the features alone, over tables."""
    y = month_flag(spark, sf_dir)
    return rounded(models.RNC(y, month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).on_tables().fit().weights, "w")


@query(MODELS["rnc_lineitem_weights"])
def rnc_lineitem_weights(spark, sf_dir):
    y = month_flag(spark, sf_dir)
    return rounded(models.RNC(y, month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).weights(), "w")


@query()
def rnc_lineitem_variance(spark, sf_dir):
    y = month_flag(spark, sf_dir)
    return models.RNC(y, month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).estimate_marginal_variance(16, seed=3)


def _kernel_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, np.ndarray]:
    y = month_flag(spark, sf_dir)
    return y.select(F.col("ax0").alias("t"), F.col("ax1").alias("ax0"), "v", "x"), _months(y)


@query(MODELS["kgrnc_lineitem"])
def kgrnc_lineitem(spark, sf_dir):
    y, months = _kernel_features(spark, sf_dir)
    return rounded(models.KGRNC(y, Graph.complete(spark, 3), univariate("diffusion", 0.2), 0.5, lam=1.0, covariates=months, kernel_std=1.0).solve(), "v", "b", digits=3)


def _high(signal: DataFrame, cut_at: float) -> DataFrame:
    """1 for values over ``cut_at``, 0 for others, missing ones kept."""
    return signal.withColumn("v", (F.col("v") > cut_at).cast("double"))


@query(MODELS["lgsr_quality"])
def lgsr_quality(spark, sf_dir):
    """Whether the labelled documents of a source and language are mostly good; unlabelled cells are filled in."""
    y = hour_quality(spark, sf_dir)
    return rounded(models.LGSR(_high(y, 0.8), month_flag_graph(y), univariate("diffusion", 0.3), 0.5).solve(), digits=3)


@query(MODELS["lgsr_quality"])
def lgsr_quality_tables(spark, sf_dir):
    """The same over tables: Newton steps whose systems are solved by conjugate gradients from the last solution."""
    y = hour_quality(spark, sf_dir)
    return rounded(models.LGSR(_high(y, 0.8), month_flag_graph(y), univariate("diffusion", 0.3), 0.5).on_tables().solve(), digits=3)


@query(MODELS["lkgr_orders"])
def lkgr_orders(spark, sf_dir):
    y = month_nation(spark, sf_dir)
    middle = y.agg(F.percentile_approx("v", 0.5)).first()[0]
    return rounded(models.LKGR(_high(_kernel_signal(spark, sf_dir), middle), region_graph(spark, sf_dir), univariate("diffusion", 0.2), 0.5, covariates=_months(y), kernel_std=1.0).solve(), digits=3)


@query(MODELS["lrnc_lineitem"])
def lrnc_lineitem(spark, sf_dir):
    y = month_flag(spark, sf_dir)
    middle = y.agg(F.percentile_approx("v", 0.5)).first()[0]
    return models.LRNC(_high(y, middle), month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).solve(classify=True)


@query(MODELS["lrnc_lineitem"])
def lrnc_lineitem_tables(spark, sf_dir):
    """The same over tables: the Schur complement of the weights is made anew in each Newton step."""
    y = month_flag(spark, sf_dir)
    middle = y.agg(F.percentile_approx("v", 0.5)).first()[0]
    return models.LRNC(_high(y, middle), month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).on_tables().solve(classify=True)


def _thirds(signal: DataFrame) -> DataFrame:
    low, high = signal.agg(F.percentile_approx("v", [1 / 3, 2 / 3])).first()[0]
    return signal.withColumn("v", F.when(F.col("v").isNotNull(), (F.col("v") > low).cast("double") + (F.col("v") > high).cast("double")))


@query(MODELS["multiclass_lgsr_events"])
def multiclass_lgsr_events(spark, sf_dir):
    y = partial(_thirds(day_type(spark, sf_dir)))
    shares = models.MulticlassLGSR(y, day_type_graph(spark), univariate("diffusion", 0.4), 0.5, classes=3).solve()
    return rounded(shares.select("ax0", "ax1", F.posexplode("p").alias("c", "p")), "p", digits=3)


@query(MODELS["multiclass_lgsr_events"])
def multiclass_lgsr_events_tables(spark, sf_dir):
    """The same over tables: the classes are columns, coupled by the weights of each cell."""
    y = partial(_thirds(day_type(spark, sf_dir)))
    shares = models.MulticlassLGSR(y, day_type_graph(spark), univariate("diffusion", 0.4), 0.5, classes=3).on_tables().solve()
    return rounded(shares.select("ax0", "ax1", F.posexplode("p").alias("c", "p")), "p", digits=3)


@query(MODELS["multiclass_lkgr_orders"])
def multiclass_lkgr_orders(spark, sf_dir):
    y = month_nation(spark, sf_dir)
    return models.MulticlassLKGR(_thirds(_kernel_signal(spark, sf_dir)), region_graph(spark, sf_dir), univariate("diffusion", 0.2), 0.5, classes=3, covariates=_months(y), kernel_std=1.0).solve(classify=True)


@query(MODELS["multiclass_lrnc_lineitem"])
def multiclass_lrnc_lineitem(spark, sf_dir):
    y = month_flag(spark, sf_dir)
    return models.MulticlassLRNC(_thirds(y), month_flag_graph(y), univariate("diffusion", 0.4), 0.5, classes=3, lam=1.0).solve(classify=True)


@query()
def gsr_by_nation(spark, sf_dir):
    """A problem for each nation: the months without orders are filled in, all nations in parallel."""
    y = month_nation(spark, sf_dir).select(F.col("ax1").alias("nation"), "ax0", "v")
    n = y.agg(F.max("ax0") + 1).first()[0]
    return models.GSR(y, Graph.chain(spark, n), univariate("diffusion", 2.0), 0.5, by=("nation",)).solve()


# ---- further constructors, operators and model state ----------------------------------------------------

_PEERS = "SELECT a.n_nationkey AS i, b.n_nationkey AS j, CAST(1 AS DOUBLE) AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey"
_PEER_DEGREES = f"SELECT CAST(i AS INTEGER) AS node, sum(w) AS degree FROM ({_PEERS}) GROUP BY 1"


def _peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjacency matrix of nations of one region, as a table."""
    nation = signals.read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    other = nation.select(F.col("n_nationkey").alias("j"), "n_regionkey")
    return nation.join(other, "n_regionkey").where("n_nationkey <> j").select(F.col("n_nationkey").alias("i"), "j", F.lit(1.0).alias("w"))


@query(_PEER_DEGREES)
def graph_from_adjacency(spark, sf_dir):
    return Graph.of(adjacency=_peers(spark, sf_dir)).degrees()


class _Network:
    """What the library uses of a networkx graph."""

    def __init__(self, nodes: list, edges: list) -> None:
        self.nodes, self._edges = nodes, edges

    def edges(self, data: bool = False) -> list:
        return [(a, b, {"weight": w}) if data else (a, b) for a, b, w in self._edges]


@query(_PEER_DEGREES)
def graph_from_network(spark, sf_dir):
    """From a networkx graph whose nodes are the nations in order (25 of them at every size)."""
    rows = _peers(spark, sf_dir).where("i < j").collect()
    return Graph.of(spark, network=_Network(list(range(25)), [(r["i"], r["j"], r["w"]) for r in rows])).degrees()


_NATION_REGION = f"""WITH {_REGIONS}, s AS (SELECT count(*) AS n FROM regions), peers AS (
  SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT CAST(p.i AS BIGINT) * n + r.i AS src, CAST(p.j AS BIGINT) * n + r.i AS dst, CAST(1 AS DOUBLE) AS w FROM s, peers p, regions r
UNION ALL SELECT CAST(k.n_nationkey AS BIGINT) * n + r.i, CAST(k.n_nationkey AS BIGINT) * n + q.i, CAST(1 AS DOUBLE) FROM s, nation k, regions r, regions q WHERE abs(r.i - q.i) = 1"""


def _nation_region(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """The adjacency matrices of nations (of one region) and of a chain of regions, and their sizes."""
    regions = _size(spark, sf_dir, "region")
    chain = Graph.chain(spark, regions).edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), "w")
    return _peers(spark, sf_dir), chain, (_size(spark, sf_dir, "nation"), regions)


@query(_NATION_REGION)
def product_from_matrices(spark, sf_dir):
    """Nations by regions from the adjacency matrices of both."""
    return ProductGraph.from_adjacency(*_nation_region(spark, sf_dir)[:2]).edges()


@query(_NATION_REGION)
def product_from_laplacians(spark, sf_dir):
    from .operators.graphs import adjacency_to_laplacian

    return ProductGraph.from_laplacian(*map(adjacency_to_laplacian, _nation_region(spark, sf_dir)[:2])).edges()


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """The adjacency matrix of the product of both, by its own joins."""
    peers, chain, (n, m) = _nation_region(spark, sf_dir)
    flat = lambda i, r: (F.col(i).cast("long") * m + F.col(r))
    along = peers.crossJoin(spark.range(m).withColumnRenamed("id", "r")).select(flat("i", "r").alias("i"), flat("j", "r").alias("j"), "w")
    across = chain.crossJoin(spark.range(n).withColumnRenamed("id", "k")).select(flat("k", "i").alias("i"), flat("k", "j").alias("j"), "w")
    return along.union(across), (n, m)


@query(_NATION_REGION)
def product_from_whole_adjacency(spark, sf_dir):
    """The factors found again in the Kronecker sum of their adjacency matrices."""
    whole, shape = _whole(spark, sf_dir)
    return ProductGraph.of(shape, adjacency=whole).edges()


@query(_NATION_REGION)
def product_from_whole_laplacian(spark, sf_dir):
    from .operators.graphs import adjacency_to_laplacian

    whole, shape = _whole(spark, sf_dir)
    return ProductGraph.of(shape, laplacian=adjacency_to_laplacian(whole)).edges()


@query("""SELECT CAST(0 AS INTEGER) AS axis, count(*) AS nodes, CAST(1 AS BIGINT) AS components FROM supplier
UNION ALL SELECT 1, count(*), 1 FROM nation""")
def product_random_connected(spark, sf_dir):
    """Random connected graphs of suppliers and of nations: their nodes and components."""
    g = ProductGraph.random_connected(spark, _size(spark, sf_dir, "supplier"), _size(spark, sf_dir, "nation"), seed=4)
    rows = [(a, f.edges.select("src").distinct().count(), f.components()) for a, f in enumerate(g.factors)]
    return spark.createDataFrame(rows, "axis int, nodes long, components long")


@query(f"WITH {_DAY_TYPE} SELECT ax0, ax1, v FROM sig")
def pandas_round_trip(spark, sf_dir):
    """A signal to a pandas frame with labels, and back."""
    y = day_type(spark, sf_dir)
    frame = signals.to_pandas(y, [list(range(DAYS)), ["a", "b", "c", "d", "e"]])
    return signals.from_pandas(spark, frame)[0]


@query(_filter_sql("exp(-0.4 * (lam0 + lam1))"))
def filter_with_new_beta(spark, sf_dir):
    return rounded(transform.filter_signal(day_type(spark, sf_dir), day_type_graph(spark), univariate("diffusion", 2.0).with_beta(0.4)))


@query(_filter_sql("exp(-0.4 * (lam0 + lam1))"))
def filter_by_attributes(spark, sf_dir):
    """The filter from the arrays that graphs decompose into when they are asked for."""
    y, g = day_type(spark, sf_dir), day_type_graph(spark)
    back = [linop.KroneckerProduct(tuple((_matrix(spark, m), f.n**2) for f, m in zip(g.factors, ms))) for ms in ([f.u * np.exp(-0.4 * f.lam) for f in g.factors], [f.u.T for f in g.factors])]
    return rounded(back[0] @ (back[1] @ y))


def _matrix(spark: SparkSession, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m) for j, v in enumerate(row)], "i int, j int, u double")


@query(f"WITH {_DAY_TYPE} SELECT ax0, ax1, round(v * (1 + ax0), 3) + 0.0 AS v, round(v, 3) + 0.0 AS back FROM sig")
def operator_diagonal(spark, sf_dir):
    """A diagonal operator and its inverse."""
    y = day_type(spark, sf_dir)
    d = linop.Diagonal(y.select("ax0", "ax1", (1.0 + F.col("ax0")).alias("d")), ("ax0", "ax1"))
    both = (d @ y).join((d.inverse() @ (d.T @ y)).withColumnRenamed("v", "back"), ["ax0", "ax1"])
    return rounded(both, "v", "back", digits=3)


_TWO_CLASSES = f"{_DAY_TYPE}, twin AS (SELECT ax0, ax1, 0 AS c, v FROM sig UNION ALL SELECT ax0, ax1, 1, -2 * v FROM sig)"


@query(f"""WITH {_DAY_TYPE}, {_BASES}, {_SPECTRUM}
SELECT a.i AS ax0, b.i AS ax1, c, round(sum(z * (CASE c WHEN 0 THEN 1 ELSE -2 END) * pow(lam0 + lam1, 2) * a.u * b.u), 3) + 0.0 AS v
FROM spec CROSS JOIN (VALUES (0), (1)) t(c) JOIN b0 a ON a.k = k0 JOIN b1 b ON b.k = k1 GROUP BY 1, 2, 3""")
def operator_expanded(spark, sf_dir):
    """An operator on each class apart: its power, transpose and conjugate."""
    y = day_type(spark, sf_dir)
    both = y.withColumn("c", F.lit(0)).unionByName(y.withColumn("c", F.lit(1)).withColumn("v", -2 * F.col("v")))
    return rounded((linop.Expanded(linop.KroneckerSum(day_type_graph(spark))).T.conj ** 2) @ both, digits=3)


@query(f"WITH {_TWO_CLASSES} SELECT ax0, ax1, c, round(v / 4, 3) + 0.0 AS v FROM twin")
def operator_inverses(spark, sf_dir):
    """The inverse of a scaled inverse transform, on each class apart, behind the transform's own."""
    y, g = day_type(spark, sf_dir), day_type_graph(spark)
    both = y.withColumn("c", F.lit(0)).unionByName(y.withColumn("c", F.lit(1)).withColumn("v", -2 * F.col("v")))
    op = linop.Expanded(linop.Scale(linop.Compose((linop.Fourier(g), linop.Identity())), 4.0))
    return rounded(linop.Fourier(g) @ (op.inverse() @ both), digits=3)


@query(f"WITH {_DAY_TYPE} SELECT ax0, ax1, CAST(CASE WHEN ax0 IN (0, 29) THEN 1 ELSE 2 END + 4 AS DOUBLE) AS v FROM sig")
def operator_entries(spark, sf_dir):
    """The diagonal of the Laplacian of the product, from all of its entries."""
    g = day_type_graph(spark)
    return linop.KroneckerSum(g).entries_on_diagonal(g)


_FEATURES = f"{_DAY_TYPE}, x AS (SELECT ax0, ax1, CAST(m AS INTEGER) AS m, CASE m WHEN 0 THEN 1.0 ELSE ax0 / 30.0 END AS x FROM sig CROSS JOIN range(2) t(m))"


def _features(y: DataFrame) -> linop.Features:
    return linop.Features(y.select("ax0", "ax1", F.array(F.lit(1.0), F.col("ax0") / 30.0).alias("x")), ("ax0", "ax1"))


@query(f"""WITH {_FEATURES}, l AS (SELECT s.ax0, s.ax1, coalesce(sum(s.v - o.v), 0) AS v
  FROM sig s LEFT JOIN sig o ON (abs(s.ax0 - o.ax0) = 1 AND s.ax1 = o.ax1) OR (s.ax0 = o.ax0 AND s.ax1 <> o.ax1) GROUP BY 1, 2)
SELECT m, round(2 * sum(l.v * x), 3) + 0.0 AS v FROM l JOIN x USING (ax0, ax1) GROUP BY 1""")
def operator_cross_block(spark, sf_dir):
    """The transpose of (Laplacian, features, scaled identity) on a signal: weights."""
    y = day_type(spark, sf_dir)
    block = linop.QXBlock(linop.KroneckerSum(day_type_graph(spark)), _features(y), linop.Scale(linop.Identity(), 2.0))
    return rounded(block.T @ y, digits=3)


@query(f"""WITH {_FEATURES}, w AS (SELECT m, sum(v * x) AS w FROM sig JOIN x USING (ax0, ax1) GROUP BY 1)
SELECT ax0, ax1, round(3 * sig.v + sum(x.x * w.w), 2) + 0.0 AS v FROM sig JOIN x USING (ax0, ax1) JOIN w USING (m) GROUP BY ax0, ax1, sig.v""")
def operator_block(spark, sf_dir):
    """The cells of [[3 I, X], [X', I]] applied to (y, X' y), between block diagonal operators that undo one another."""
    y = day_type(spark, sf_dir)
    x, one = _features(y), linop.Identity()
    block = linop.Block(linop.Scale(one, 3.0), x, x.T, one).T
    scaling = linop.BlockDiagonal(linop.Scale(one, 5.0), linop.Scale(one, 5.0))
    cells, weights = block.apply(*scaling.inverse().apply(y, x.T @ y))
    return rounded(scaling.T.apply(cells, weights)[0], digits=2)


@query(_RICHARDSON)
def gsr_changed(spark, sf_dir):
    """A model whose parameters were changed after it was made."""
    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 9.0), 7.0)
    return rounded(model.with_gamma(0.5).with_beta(0.4).solve(), digits=3)


@query(MODELS["gsr_variance"])
def gsr_variance(spark, sf_dir):
    """The exact posterior variance of each cell."""
    model = models.GSR(partial(day_type(spark, sf_dir)), day_type_graph(spark), univariate("diffusion", 0.4), 0.5)
    return rounded(model.marginal_variance(), "variance", digits=3)


@query(MODELS["rnc_predictor"])
def rnc_predictor(spark, sf_dir):
    """Intercepts plus features times weights, from one solution."""
    y = month_flag(spark, sf_dir)
    fitted = models.RNC(y, month_flag_graph(y), univariate("diffusion", 0.4), 0.5, lam=1.0).with_lam(1.0).fit()
    return rounded(fitted.predictor(y), "f", digits=3)


@query("SELECT CAST(m AS INTEGER) AS model, true AS fine FROM range(4) t(m)")
def sampled_variances(spark, sf_dir):
    """Whether the variances of 300 draws of four Gaussian models are within a fifth of the exact ones on average."""
    y = month_flag(spark, sf_dir)
    n0, n1 = y.agg(F.max("ax0") + 1, F.max("ax1") + 1).first()
    y = y.withColumn("v", F.when((F.col("ax0") + F.col("ax1")) % 3 != 0, F.col("v")))
    graph, kernel = ProductGraph(Graph.chain(spark, n0), Graph.complete(spark, n1)), Graph.complete(spark, n1)
    months, g = _months(y), univariate("diffusion", 0.4)
    timed = y.select(F.col("ax0").alias("t"), F.col("ax1").alias("ax0"), "v", "x")
    made = [
        models.GSR(y.drop("x"), graph, g, 0.5),
        models.KGR(timed.drop("x"), kernel, g, 0.5, covariates=months),
        models.RNC(y, graph, g, 0.5, lam=1.0),
        models.KGRNC(timed, kernel, g, 0.5, lam=1.0, covariates=months),
    ]
    rows = []
    for i, m in enumerate(made):
        both = m.estimate_marginal_variance(300, seed=i).withColumnRenamed("variance", "sampled").join(m.marginal_variance(), m.axes)
        ratio = both.agg(F.avg(F.col("sampled") / F.col("variance"))).first()[0]
        rows.append((i, bool(0.8 < ratio < 1.25)))
    return spark.createDataFrame(rows, "model int, fine boolean")
