"""DuckDB SQL of the statistical models, by another way than the library takes.

All models maximise a likelihood of f = b + X w with the penalties gamma b' H^-2 b / 2 and lam w' w / 2. With
K = H^2 / gamma + X X' / lam, restricted to the observed cells, the residuals a = y - mu(f) at the maximum
solve a = y - mu(K a), where mu is the identity, the logistic function or softmax. The SQL iterates
a <- a + t (y - mu(K a) - a) with lists in a recursive query, t = 2 / (2 + w L), where L is the largest row
sum of K and w the largest slope of mu; the library solves preconditioned primal systems instead.
"""

from __future__ import annotations

MONTHS = """
months AS (SELECT month, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS i0 FROM (SELECT DISTINCT month FROM facts))"""

#: cells(i0, i1, v, x): month by nation, values of orders.
MONTH_NATION = f"""
facts AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey AS other, sum(o_totalprice) / 1e6 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
{MONTHS},
others AS (SELECT other, CAST(row_number() OVER (ORDER BY other) - 1 AS INTEGER) AS i1 FROM (SELECT DISTINCT other FROM facts)),
raw AS (SELECT i0, i1, v, [0.0] AS x FROM months CROSS JOIN others LEFT JOIN facts USING (month, other))"""

#: cells(i0, i1, v, x): ship month by return flag, mean prices.
MONTH_FLAG = f"""
facts AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS other, avg(l_extendedprice) / 1e3 AS v,
  [avg(l_quantity) / 50, avg(l_discount) * 10, avg(l_tax) * 10] AS x FROM lineitem GROUP BY 1, 2),
{MONTHS},
others AS (SELECT other, CAST(row_number() OVER (ORDER BY other) - 1 AS INTEGER) AS i1 FROM (SELECT DISTINCT other FROM facts)),
raw AS (SELECT i0, i1, v, coalesce(x, [0.0, 0.0, 0.0]) AS x FROM months CROSS JOIN others LEFT JOIN facts USING (month, other))"""

#: cells(i0, i1, v, x): source by language of documents, mean quality of the labelled ones.
QUALITY = """
facts AS (SELECT source, lang, avg(quality) AS v FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
months AS (SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS i0 FROM (SELECT DISTINCT source FROM facts WHERE source IS NOT NULL)),
others AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS i1 FROM (SELECT DISTINCT lang FROM facts WHERE lang IS NOT NULL)),
raw AS (SELECT i0, i1, v, [0.0] AS x FROM months CROSS JOIN others LEFT JOIN facts USING (source, lang))"""


def from_signal(signal: str) -> str:
    """raw cells from a table sig(ax0, ax1, v)."""
    return f"""{signal},
months AS (SELECT DISTINCT ax0 AS i0 FROM sig), others AS (SELECT DISTINCT ax1 AS i1 FROM sig),
raw AS (SELECT ax0 AS i0, ax1 AS i1, v, [0.0] AS x FROM sig)"""


def chain(beta: float, name: str = "h0", nodes: str = "months", i: str = "i0") -> str:
    """exp(-2 beta L) of a chain as a table (i, j, h)."""
    return f"""
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {nodes}),
{name}_u AS (SELECT {i} AS i, k, exp(-{2 * beta} * (2 - 2 * cos(pi() * k / n))) AS g,
  CASE WHEN k = 0 THEN sqrt(1 / n) ELSE sqrt(2 / n) * cos(pi() * (i + 0.5) * k / n) END AS u
  FROM {nodes} CROSS JOIN {name}_n CROSS JOIN (SELECT {i} AS k FROM {nodes})),
{name} AS (SELECT a.i, b.i AS j, sum(a.g * a.u * b.u) AS h FROM {name}_u a JOIN {name}_u b ON a.k = b.k GROUP BY 1, 2)"""


def complete(beta: float, name: str = "h1", nodes: str = "others", i: str = "i1") -> str:
    """exp(-2 beta L) of a complete graph."""
    return f"""
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {nodes}),
{name} AS (SELECT a.{i} AS i, b.{i} AS j, (1 - exp(-{2 * beta} * n)) / n + CASE WHEN a.{i} = b.{i} THEN exp(-{2 * beta} * n) ELSE 0 END AS h
  FROM {nodes} a CROSS JOIN {nodes} b CROSS JOIN {name}_n)"""


def regions(beta: float) -> str:
    """exp(-2 beta L) of the graph in which the nations of a region are next to each other: one clique each."""
    return f"""
h1_m AS (SELECT n_regionkey, CAST(count(*) AS DOUBLE) AS m FROM nation GROUP BY 1),
h1 AS (SELECT p.i1 AS i, q.i1 AS j, CASE WHEN a.n_regionkey <> b.n_regionkey THEN 0 ELSE (1 - exp(-{2 * beta} * m)) / m END + CASE WHEN p.i1 = q.i1 THEN exp(-{2 * beta} * m) ELSE 0 END AS h
  FROM others p JOIN nation a ON a.n_nationkey = p.other CROSS JOIN others q JOIN nation b ON b.n_nationkey = q.other JOIN h1_m ON h1_m.n_regionkey = a.n_regionkey)"""


#: The kernel of the months, by trend and season, with a standard deviation of 1.
SEASONS = """
h0 AS (SELECT a.i0 AS i, b.i0 AS j, exp(-0.5 * (pow((a.i0 - b.i0) / 12.0, 2)
  + pow(cos(2 * pi() * a.i0 / 12.0) - cos(2 * pi() * b.i0 / 12.0), 2) + pow(sin(2 * pi() * a.i0 / 12.0) - sin(2 * pi() * b.i0 / 12.0), 2))) AS h
  FROM months a CROSS JOIN months b)"""


def rank_value(share: str) -> str:
    """The value of which that share of the values is no greater."""
    return f"(SELECT list_sort(list(v))[CAST(ceil({share} * count(v)) AS BIGINT)] FROM raw WHERE v IS NOT NULL)"


def kernel(inputs: str, h0: str, h1: str, target: str, gamma: float, lam: float | None) -> str:
    """cells (with y), obs and the rows of K: all (k for f, kb for b alone) and those of observed cells (ko, a list of lists)."""
    cross = f" + list_dot_product(p.x, q.x) / {lam}" if lam else ""
    return f"""WITH RECURSIVE {inputs}, {h0}, {h1},
stats AS (SELECT avg(v) AS loc, stddev_pop(v) AS scale FROM raw),
cells AS (SELECT row_number() OVER (ORDER BY i0, i1) AS id, i0, i1, x, {target} AS y FROM raw CROSS JOIN stats),
obs AS (SELECT * FROM cells WHERE y IS NOT NULL),
pairs AS (SELECT p.id, p.i0, p.i1, q.id AS q, a.h * b.h / {gamma} AS kb, a.h * b.h / {gamma}{cross} AS k
  FROM cells p CROSS JOIN obs q JOIN h0 a ON a.i = p.i0 AND a.j = q.i0 JOIN h1 b ON b.i = p.i1 AND b.j = q.i1),
rows_ AS (SELECT id, i0, i1, list(k ORDER BY q) AS k, list(kb ORDER BY q) AS kb, max(k) AS top FROM pairs GROUP BY 1, 2, 3),
mat AS (SELECT list(r.k ORDER BY o.id) AS ko, list(o.y ORDER BY o.id) AS ys, max(list_sum(r.k)) AS l FROM obs o JOIN rows_ r ON r.id = o.id)"""


def solved(head: str, mean: str, slope: float, steps: int) -> str:
    """dual(a): the residuals of the observed cells; ``mean`` is an expression of f."""
    return f"""{head},
step AS (
  SELECT 0 AS n, list_transform(ys, lambda y: CAST(0 AS DOUBLE)) AS a FROM mat
  UNION ALL
  SELECT n + 1, list_transform(list_transform(ko, lambda k: list_dot_product(k, a)), lambda f, i: a[i] + 2 / (2 + {slope} * l) * (ys[i] - ({mean}) - a[i]))
  FROM step CROSS JOIN mat WHERE n < {steps}),
dual AS (SELECT a FROM step WHERE n = {steps})"""


LOGISTIC = "1 / (1 + exp(-f))"


def solved_classes(head: str, steps: int) -> str:
    """dual(a0, a1, a2): the residuals of three classes; ys holds labels."""
    f = ", ".join(f"list_transform(ko, lambda k: list_dot_product(k, a{c})) AS f{c}" for c in range(3))
    total = "list_transform(f0, lambda f, i: exp(f) + exp(f1[i]) + exp(f2[i])) AS s"
    new = ", ".join(f"list_transform(f{c}, lambda f, i: a{c}[i] + 2 / (2 + 0.5 * l) * ((CASE WHEN ys[i] = {c} THEN 1.0 ELSE 0.0 END) - exp(f) / s[i] - a{c}[i]))" for c in range(3))
    zero = ", ".join(f"list_transform(ys, lambda y: CAST(0 AS DOUBLE)) AS a{c}" for c in range(3))
    return f"""{head},
step AS (
  SELECT 0 AS n, {zero} FROM mat
  UNION ALL
  SELECT n + 1, {new} FROM (SELECT *, {total} FROM (SELECT n, a0, a1, a2, ys, l, {f} FROM step CROSS JOIN mat WHERE n < {steps}))),
dual AS (SELECT a0, a1, a2 FROM step WHERE n = {steps})"""


def cells_of(axes: tuple[str, str], *columns: str) -> str:
    """The output rows: the cells with expressions of f (or f0, f1, f2) and b."""
    return f"SELECT i0 AS {axes[0]}, i1 AS {axes[1]}, {', '.join(columns)} FROM (SELECT i0, i1, list_dot_product(k, a) AS f, list_dot_product(kb, a) AS b FROM rows_ CROSS JOIN dual) CROSS JOIN stats"


def classes_of(axes: tuple[str, str], columns: str) -> str:
    f = ", ".join(f"list_dot_product(k, a{c}) AS f{c}" for c in range(3))
    return f"SELECT i0 AS {axes[0]}, i1 AS {axes[1]}, {columns} FROM (SELECT i0, i1, {f} FROM rows_ CROSS JOIN dual)"


NORMAL = "(v - loc) / scale"
VALUE = "round(f * scale + loc, 3) + 0.0 AS v"
LABEL = "CAST(CASE WHEN f > 0 THEN 1 ELSE 0 END AS INTEGER) AS v"
SHARES = "unnest([0, 1, 2]) AS c, round(unnest([exp(f0), exp(f1), exp(f2)]) / (exp(f0) + exp(f1) + exp(f2)), 3) + 0.0 AS p"
BEST = "CAST(CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS INTEGER) AS v"
THIRDS = f"CASE WHEN v IS NOT NULL THEN CAST(v > {rank_value('1 / 3.0')} AS INTEGER) + CAST(v > {rank_value('2 / 3.0')} AS INTEGER) END"
HIGH = f"CAST(v > {rank_value('0.5')} AS INTEGER)"
GRID, KERNEL = ("ax0", "ax1"), ("t", "ax0")


def oracles(day_type: str) -> dict[str, str]:
    """SQL by the name of the query; ``day_type`` is the SQL of sig."""
    flags = lambda target, lam=1.0: kernel(MONTH_FLAG, chain(0.4), complete(0.4), target, 0.5, lam)
    seasons = lambda target: kernel(MONTH_NATION, SEASONS, regions(0.2), target, 0.5, None)
    kernel_flags = kernel(MONTH_FLAG, SEASONS, complete(0.2), NORMAL, 0.5, 1.0)
    rnc = solved(flags(NORMAL), "f", 1.0, 3000)
    events = kernel(from_signal(day_type), chain(0.4), complete(0.4), f"CASE WHEN (i0 + i1) % 3 <> 0 THEN {THIRDS} END", 0.5, None)
    partial = kernel(from_signal(day_type), chain(0.4), complete(0.4), f"CASE WHEN (i0 + i1) % 3 <> 0 THEN (v - (SELECT avg(v) FROM raw WHERE (i0 + i1) % 3 <> 0)) END", 0.5, None)
    return {
        "gsr_variance": f"""{partial},
seen AS (SELECT var_pop(v) AS s2 FROM raw WHERE (i0 + i1) % 3 <> 0),
every AS (SELECT list(k ORDER BY id) AS ks FROM rows_),
step AS (
  SELECT 0 AS n, list_transform(ks, lambda k: list_transform(k, lambda x: CAST(0 AS DOUBLE))) AS us FROM every
  UNION ALL
  SELECT n + 1, list_transform(us, lambda u, c: list_transform(ko, lambda k, i: u[i] + 2 / (2 + l) * (ks[c][i] - list_dot_product(k, u) - u[i])))
  FROM step CROSS JOIN mat CROSS JOIN every WHERE n < 60),
last AS (SELECT us FROM step WHERE n = 60),
own AS (SELECT p.i0, p.i1, a.h * b.h / 0.5 AS d FROM cells p JOIN h0 a ON a.i = p.i0 AND a.j = p.i0 JOIN h1 b ON b.i = p.i1 AND b.j = p.i1)
SELECT i0 AS ax0, i1 AS ax1, round((d - list_dot_product(k, us[rank])) * s2, 3) + 0.0 AS variance
FROM (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM rows_) JOIN own USING (i0, i1) CROSS JOIN last CROSS JOIN seen""",
        "rnc_predictor": f"{rnc} {cells_of(GRID, 'round(f * scale + loc, 3) + 0.0 AS f')}",
        "kgr_orders": f"{solved(seasons(NORMAL), 'f', 1.0, 800)} {cells_of(KERNEL, VALUE)}",
        "rnc_lineitem": f"{rnc} {cells_of(GRID, VALUE, 'round(b * scale + loc, 3) + 0.0 AS b')}",
        "rnc_lineitem_weights": f"""{rnc} SELECT CAST(m AS INTEGER) AS m, round(list_dot_product(xs, a) * scale, 4) + 0.0 AS w
FROM (SELECT m, list(x[m + 1] ORDER BY id) AS xs FROM obs CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) GROUP BY m) CROSS JOIN dual CROSS JOIN stats""",
        "kgrnc_lineitem": f"{solved(kernel_flags, 'f', 1.0, 3000)} {cells_of(KERNEL, VALUE, 'round(b * scale + loc, 3) + 0.0 AS b')}",
        "lgsr_quality": f"{solved(kernel(QUALITY, chain(0.3), complete(0.3), 'CAST(v > 0.8 AS INTEGER)', 0.5, None), LOGISTIC, 0.25, 400)} {cells_of(GRID, f'round({LOGISTIC}, 3) + 0.0 AS v')}",
        "lkgr_orders": f"{solved(seasons(HIGH), LOGISTIC, 0.25, 400)} {cells_of(KERNEL, f'round({LOGISTIC}, 3) + 0.0 AS v')}",
        "lrnc_lineitem": f"{solved(flags(HIGH), LOGISTIC, 0.25, 1500)} {cells_of(GRID, LABEL)}",
        "multiclass_lgsr_events": f"{solved_classes(events, 300)} {classes_of(GRID, SHARES)}",
        "multiclass_lkgr_orders": f"{solved_classes(seasons(THIRDS), 500)} {classes_of(KERNEL, BEST)}",
        "multiclass_lrnc_lineitem": f"{solved_classes(flags(THIRDS), 2500)} {classes_of(GRID, BEST)}",
    }
