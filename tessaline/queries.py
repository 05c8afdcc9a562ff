"""Queries over the test tables, one per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import formulas as fx
from .functions import metrics
from .operators import families as fam
from .operators.families import Config
from .operators.pipeline import FeatureSet, Pipeline
from .operators.workflows import apply_stage, auto_run, deepen, discover_carrier_space, multi_pass, prune_run, recipe_light, recipes
from .plans.expr import derive, raw, with_features
from .plans.moments import collect_moments
from .plans.stats import column_stats, empirical_rank, infer_types

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
C = Config()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def shown(df: DataFrame, key: str, features, digits: int = 6) -> DataFrame:
    wide, names = with_features(df, features)
    return wide.select(F.col(key), *[(F.round(F.col(n), digits) + 0.0).alias(f"v{k}") for k, n in enumerate(names)])


def r(*expressions: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) + 0.0 AS v{k}" for k, e in enumerate(expressions))


# ---------------------------------------------------------------- unary: customer balances (signed)

CUSTOMER = "WITH b AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS k FROM customer), s AS (SELECT min(x) AS lo, max(x) AS hi, stddev_pop(x) AS sd, count(*) AS n FROM b) "


def balances(family: str) -> Query:
    def run(spark, sf):
        df = table(spark, sf, "customer")
        made = fam.unary(df, [raw("c_acctbal"), raw("c_nationkey", "categorical")], {"raw", "rank", "onehot", "reciprocal", *fx.UNARY} - {family})
        return shown(df, "c_custkey", [f for f in made if f.family == family], 1 if family == "cube" else 6)

    return run


for family, sql in {
    "raw": "x", "squared": "x * x", "log": "ln(1 + abs(x))", "sqrt": "sqrt(abs(x))", "cube": "x * x * x", "tanh": "tanh(x)", "reciprocal": "1 / (abs(x) + 1e-6 * sd)",
}.items():
    columns = r(sql, "k") if family == "raw" else r(sql, digits=1 if family == "cube" else 6)
    query(f"unary_{family}", CUSTOMER + f"SELECT c_custkey, {columns} FROM b, s")(balances(family))
query("unary_rank", CUSTOMER + "SELECT c_custkey, " + r("CAST(rank() OVER (ORDER BY x) - 1 AS DOUBLE) / n") + " FROM b, s")(balances("rank"))
query("unary_onehot", CUSTOMER + "SELECT c_custkey, " + r(*[f"CASE WHEN k = {v} THEN 1.0 ELSE 0.0 END" for v in range(25)]) + " FROM b")(balances("onehot"))

# ---------------------------------------------------------------- pairs: order lines by their keys

LINES = """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b FROM lineitem),
s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb, min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM b) """


def line_pairs(*families: str, digits: int | tuple[int, ...] = 6) -> Query:
    """digits: of all columns, or of each; a near-zero denominator makes a ratio of so many digits before the point."""

    def run(spark, sf):
        df = table(spark, sf, "lineitem")
        made = [f for f in fam.pairwise(df, [[raw("l_quantity"), raw("l_discount")]], C) if f.family in families]
        wide, names = with_features(df, made)
        return wide.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[(F.round(F.col(n), digits if isinstance(digits, int) else digits[k]) + 0.0).alias(f"v{k}") for k, n in enumerate(names)])

    return run


N01A, N01B = "((a - la) / (ha - la))", "((b - lb) / (hb - lb))"
for name, families, columns in [
    ("product", ["am_product"], ["a * b"]),
    ("diff", ["am_diff"], ["abs(a - b)"]),
    ("ratio", ["am_ratio"], ["b / (abs(a) + 1e-6 * (sa + 1e-10))", "a / (abs(b) + 1e-6 * (sb + 1e-10))"]),
    ("sqdiff", ["am_sq_diff"], ["(a - b) * (a - b)"]),
    ("minmax", ["am_min", "am_max"], ["least(a, b)", "greatest(a, b)"]),
    ("hmean", ["am_hmean"], ["CASE WHEN abs(a + b) > 1e-10 THEN 2 * a * b / (a + b) ELSE 0.0 END"]),
    ("normdiff", ["am_normdiff"], ["CASE WHEN abs(a) + abs(b) > 1e-10 THEN abs(a - b) / (abs(a) + abs(b)) ELSE 0.0 END"]),
    ("logratio", ["am_logratio"], ["ln(abs(a) + 1e-6 * sa) - ln(abs(b) + 1e-6 * sb)"]),
    ("damped", ["am_damped"], ["a / (1 + abs(b))", "b / (1 + abs(a))"]),
    ("relu", ["am_relu"], ["greatest(0, a - b)", "greatest(0, b - a)"]),
    ("power", ["am_power"], [f"sign({x}) * pow(abs({x}) + 1e-10, {k} * {y})" for x, y in (("a", N01B), ("b", N01A)) for k in (0.5, 1, 2, 3)]),
]:
    query(f"pair_{name}", LINES + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + (r(*columns) if name != "ratio" else f"round({columns[0]}, 9) + 0.0 AS v0, round({columns[1]}, 1) + 0.0 AS v1") + " FROM b, s")(line_pairs(*families, digits=(9, 1) if name == "ratio" else 6))

# ---------------------------------------------------------------- carriers and spaces: orders

ORDERS = """WITH b AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS m FROM orders),
s AS (SELECT min(x) AS lo, max(x) AS hi, stddev_pop(x) AS sd, min(m) AS ml, max(m) AS mh, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.3) AS q30, quantile_cont(x, 0.7) AS q70 FROM b),
c AS (SELECT *, (x - lo) / (hi - lo) AS n, (m - ml) / (mh - ml) AS u FROM b, s) """
FLOORED = "((({0}) - floor({0})))"
tri = lambda p: f"2 * abs(2 * {FLOORED.format(p)} - 1) - 1"
bump = lambda x, c, w: f"exp(-0.5 * pow(({x} - {c}) / ({w} + 1e-12), 2))"


def order_carriers(family: str) -> Query:
    def run(spark, sf):
        df = table(spark, sf, "orders")
        return shown(df, "o_orderkey", [f for f in fam.carriers(df, [raw("o_totalprice")], C) if f.family == family])

    return run


for family, columns in {
    "sin": [f"sin({k} * pi() * n)" for k in (0.5, 1, 2, 3)],
    "cos": [f"cos({k} * pi() * n)" for k in (0.5, 1, 2, 3)],
    "tri": [tri(f"{k} * n") for k in (0.5, 1, 2, 3)],
    "step": [f"CASE WHEN x > q{q} THEN 1.0 ELSE 0.0 END" for q in (25, 50, 75)],
    "pulse": [f"CASE WHEN n >= {a} AND n <= {b} THEN 1.0 ELSE 0.0 END" for a, b in C.pulse_bands],
    "gauss": [bump("n", f"((q{q} - lo) / (hi - lo))", w) for q in (25, 50, 75) for w in C.gauss_widths],
}.items():
    query(f"carrier_{family}", ORDERS + "SELECT o_orderkey, " + r(*columns) + " FROM c")(order_carriers(f"carrier_{family}"))

CLIPPED = "least(greatest(x, 1e-6), 0.999999)"
for name, sql in {
    "log": "sign(x) * ln(1 + abs(x))", "log2": "sign(x) * ln(1 + abs(x)) / ln(2)", "log10": "sign(x) * ln(1 + abs(x)) / ln(10)", "sqrt": "sign(x) * sqrt(abs(x))", "cbrt": "sign(x) * pow(abs(x), 1.0 / 3)",
    "exp": "sign(x) * (exp(abs(x)) - 1)", "arcsinh": "sign(x) * ln(abs(x) + sqrt(x * x + 1))", "logit": f"ln({CLIPPED} / (1 - {CLIPPED}))", "tanh": "tanh(x)", "pow:1.5": "sign(x) * pow(abs(x), 1.5)",
}.items():

    def in_space(spark, sf, name=name):
        df = table(spark, sf, "customer").withColumn("z", F.col("c_acctbal") / 10000.0)
        return shown(df, "c_custkey", [derive(fx.space(name), [raw("z")], name, "space")])

    query(f"space_{name.replace(':', '_').replace('.', '_')}", f"WITH b AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 10000.0 AS x FROM customer) SELECT c_custkey, {r(sql)} FROM b")(in_space)

# ---------------------------------------------------------------- modulation: orders, price by customer key


def modulated(family: str) -> Query:
    def run(spark, sf):
        df = table(spark, sf, "orders")
        return shown(df, "o_orderkey", fam.modulate(df, [raw("o_totalprice")], [raw("o_custkey")], C, [family]))

    return run


K = (0.5, 1, 2, 3)
for family, columns in {
    "fm_sin": [f"sin(({k} + {d} * u) * pi() * n)" for k in K for d in C.fm_depths],
    "pm_sin": [f"sin({k} * pi() * n + {p} * pi() * u)" for k in K for p in C.pm_depths],
    "fm_tri": [tri(f"({k} + {d} * u) * n") for k in K for d in C.fm_depths],
    "fm_pulse": [bump("n", f"(q{q} + 1.0 * (u - 0.5))", w) for q in (30, 50, 70) for w in C.gauss_widths],
    "wm_center": [bump("x", f"(q{q} + sd * (u - 0.5))", "0.3 * sd") for q in (30, 50, 70)],
    "wm_width": [bump("x", f"q{q}", f"greatest(0.3 * sd * (1 + {w} * (u - 0.5)), 1e-12)") for q in (30, 50, 70) for w in C.wm_width_mods],
}.items():
    query(f"mod_{family}", ORDERS + "SELECT o_orderkey, " + r(*columns) + " FROM c")(modulated(family))

# ---------------------------------------------------------------- fields: parts

PARTS = "WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part), s AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, " + ", ".join(f"quantile_cont({v}, {q / 100}) AS {v}{q}" for v in "xy" for q in (20, 40, 60, 80)) + " FROM b), c AS (SELECT *, (x - lx) / (hx - lx) AS nx, (y - ly) / (hy - ly) AS ny FROM b, s) "
CENTRES = [(a, b) for a in (20, 40, 60, 80) for b in (20, 40, 60, 80)]
FAR = [f"sqrt(pow(nx - (x{a} - lx) / (hx - lx), 2) + pow(ny - (y{b} - ly) / (hy - ly), 2))" for a, b in CENTRES]
ZONES = [[f"CASE WHEN {d} <= {s} THEN 1.0 ELSE 0.0 END" for d in FAR] for s in C.field_scales]


def part_fields(spark, sf, families, which=None):
    df = table(spark, sf, "part")
    made = [f for f in fam.fields(df, [raw("p_size"), raw("p_retailprice")], C) if f.family in families]
    return df, made


@query("field_near", PARTS + "SELECT p_partkey, " + r("least(" + ", ".join(FAR) + ")") + " FROM c")
def field_near(spark, sf):
    return shown(*(lambda d, m: (d, "p_partkey", m))(*part_fields(spark, sf, {"field_nearest"})))


def melted(df: DataFrame, key: str, features) -> DataFrame:
    """key, label and value of every feature: for a number of features that the data decide."""
    wide, names = with_features(df, features)
    cells = F.explode(F.array(*[F.struct(F.lit(f.label).alias("label"), (F.round(F.col(n), 6) + 0.0).alias("value")) for f, n in zip(features, names)]))
    return wide.select(key, cells.alias("cell")).select(key, "cell.*")


def gated(columns: dict[str, str]) -> str:
    """SQL: key, label and value of the columns that are not constant."""
    each = [f"SELECT p_partkey, '{label}' AS label, round(CAST({sql} AS DOUBLE), 6) + 0.0 AS value FROM c" for label, sql in columns.items()]
    return PARTS + ", m AS (" + " UNION ALL ".join(each) + ") SELECT p_partkey, label, value FROM m WHERE label IN (SELECT label FROM m GROUP BY label HAVING stddev_pop(value) > 1e-10)"


PAIR = "p_size+p_retailprice"
EVERY_ZONE = {f"zone({PAIR},c{k},r={s:g})": ZONES[j][k] for j, s in enumerate(C.field_scales) for k in range(16)}


@query("field_zone", gated(EVERY_ZONE))
def field_zone(spark, sf):
    return melted(*(lambda d, m: (d, "p_partkey", m))(*part_fields(spark, sf, {"field_zone"})))


@query("field_zcount", gated({f"zcount({PAIR},r={s:g})": " + ".join(ZONES[j]) for j, s in enumerate(C.field_scales)}))
def field_zcount(spark, sf):
    return melted(*(lambda d, m: (d, "p_partkey", m))(*part_fields(spark, sf, {"field_zcount"})))


ADJUSTED = PARTS + ", m AS (" + " UNION ALL ".join(f"SELECT p_partkey, x, y, '{label}' AS label, {sql} AS value FROM c" for label, sql in EVERY_ZONE.items()) + """), k AS (SELECT label FROM m GROUP BY label HAVING stddev_pop(value) > 1e-10),
a AS (SELECT p_partkey, label || '*p_size' AS label, value * x AS value FROM m WHERE label IN (SELECT label FROM k) UNION ALL SELECT p_partkey, label || '*p_retailprice', value * y FROM m WHERE label IN (SELECT label FROM k))
SELECT p_partkey, label, round(CAST(value AS DOUBLE), 6) + 0.0 AS value FROM a WHERE label IN (SELECT label FROM a GROUP BY label HAVING stddev_pop(value) >= 1e-10)"""


@query("field_adjust", ADJUSTED)
def field_adjust(spark, sf):
    df, made = part_fields(spark, sf, {"field_zone"})
    return melted(df, "p_partkey", fam.zone_adjustments(df, made, [raw("p_size"), raw("p_retailprice")]))


# ---------------------------------------------------------------- statistics


@query("stats_columns", "SELECT 'o_totalprice' AS name, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS sd, round(quantile_cont(o_totalprice, 0.3), 4) AS q30 FROM orders")
def stats_columns(spark, sf):
    s = column_stats(table(spark, sf, "orders"), [raw("o_totalprice")], [30])[0]
    return spark.createDataFrame([("o_totalprice", *(round(x, 4) for x in (s.lo, s.hi, s.mean, s.sd, s.quantiles[30])))], "name string, lo double, hi double, mean double, sd double, q30 double")


@query("stats_infer_types", """WITH c AS (SELECT 'p_size' AS name, count(DISTINCT p_size) AS n FROM part UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey) FROM part UNION ALL SELECT 'one', 1)
SELECT name, CASE WHEN n <= 2 THEN 'bool' ELSE 'numeric' END AS kind FROM c""")
def stats_infer_types(spark, sf):
    df = table(spark, sf, "part").withColumn("one", F.lit(1.0))
    return spark.createDataFrame(sorted(infer_types(df, ["p_size", "p_partkey", "one"]).items()), "name string, kind string")


@query("gram_small", """WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c FROM lineitem)
SELECT 'a' AS x, 'b' AS y, round(covar_pop(a, b), 3) AS cov, round(corr(a, b), 6) AS cor FROM b UNION ALL SELECT 'a', 'c', round(covar_pop(a, c), 3), round(corr(a, c), 6) FROM b UNION ALL SELECT 'b', 'c', round(covar_pop(b, c), 3), round(corr(b, c), 6) FROM b""")
def gram_small(spark, sf):
    m = collect_moments(table(spark, sf, "lineitem"), [raw("l_quantity"), raw("l_extendedprice")], [F.col("l_discount")])[0]
    c = m.correlation()
    return spark.createDataFrame([("abc"[i], "abc"[j], round(float(m.scatter[i, j] / m.n), 3), round(float(c[i, j]), 6)) for i, j in ((0, 1), (0, 2), (1, 2))], "x string, y string, cov double, cor double")


@query("fft_bins", """WITH r AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS rn FROM part), n AS (SELECT count(*) AS n, count(DISTINCT p_size) AS u FROM part),
g AS (SELECT least(greatest(u // 2, 20), 200) AS bins, greatest(1, n // least(greatest(u // 2, 20), 200)) AS size FROM n)
SELECT CAST(rn // size AS INTEGER) AS bin, round(avg(p_retailprice), 6) AS mean FROM r, g WHERE rn // size < bins GROUP BY 1""")
def fft_bins(spark, sf):
    from .operators.frequency import binned

    (_, mean), = binned(table(spark, sf, "part"), [raw("p_size")], F.col("p_retailprice"), ["p_partkey"])
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(mean)], "bin int, mean double")


@query("metrics_regression", """WITH b AS (SELECT CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_extendedprice * (1 - l_discount) AS DOUBLE) AS p FROM lineitem)
SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse FROM b""")
def metrics_regression(spark, sf):
    df = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("p"))
    out = df.agg(*metrics.regression("y", "p"))
    return out.select(F.round("r2", 6).alias("r2"), F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("metrics_brier", """WITH b AS (SELECT toxic AS y, 0.1 + 0.8 * quality AS p FROM labels)
SELECT round(avg((y - p) * (y - p)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM b""")
def metrics_brier(spark, sf):
    df = table(spark, sf, "labels").select(F.col("toxic").alias("y"), (0.1 + 0.8 * F.col("quality")).alias("p"))
    out = df.agg(*metrics.classification("y", "p"))
    return out.select(F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query("metrics_auc", """WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, l_quantity AS p FROM lineitem), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY p),
w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM w""")
def metrics_auc(spark, sf):
    df = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.col("l_quantity").alias("p"))
    return metrics.roc_auc(df, "y", "p").select(F.round("auc", 6).alias("auc"))


@query("metrics_auc_price", """WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem), g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY p),
w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM w""")
def metrics_auc_price(spark, sf):
    df = table(spark, sf, "lineitem").repartition(16).select(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"), F.col("l_extendedprice").alias("p"))
    return metrics.roc_auc(df, "y", "p").select(F.round("auc", 9).alias("auc"))


@query("rank_large", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CAST(rank() OVER (ORDER BY CAST(l_extendedprice AS DOUBLE)) - 1 AS DOUBLE) / count(*) OVER (), 9) AS share FROM lineitem")
def rank_large(spark, sf):
    df = table(spark, sf, "lineitem").repartition(16)
    out = empirical_rank(df, df, "l_extendedprice", "share")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("share", 9).alias("share"))


@query("fft_bins_lineitem", """WITH r AS (SELECT l_discount, row_number() OVER (ORDER BY CAST(l_extendedprice AS DOUBLE), l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS rn FROM lineitem), n AS (SELECT count(*) AS n, count(DISTINCT l_extendedprice) AS u FROM lineitem),
g AS (SELECT least(greatest(u // 2, 20), 200) AS bins, greatest(1, n // least(greatest(u // 2, 20), 200)) AS size FROM n)
SELECT CAST(rn // size AS INTEGER) AS bin, round(avg(l_discount), 6) AS mean FROM r, g WHERE rn // size < bins GROUP BY 1""")
def fft_bins_lineitem(spark, sf):
    from .operators.frequency import binned

    (_, mean), = binned(table(spark, sf, "lineitem").repartition(16), [raw("l_extendedprice")], F.col("l_discount"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(mean)], "bin int, mean double")


@query("bootstrap_grouped")
def bootstrap_grouped(spark, sf):
    """Mean and interval of the difference of two losses over all events, whole users drawn again; tested against NumPy."""
    df = table(spark, sf, "events")
    found = metrics.grouped_bootstrap(df, "user_id", F.abs(F.col("value") - 10), F.abs(F.col("value") - 12))
    return spark.createDataFrame([tuple(round(x, 6) for x in found)], "mean double, low double, high double")


@query("bootstrap_paired")
def bootstrap_paired(spark, sf):
    """Mean and interval of the paired difference of two losses over all labels; tested against NumPy."""
    found = metrics.paired_bootstrap(table(spark, sf, "labels"), "doc_id", F.abs(F.col("quality") - 0.2), F.abs(F.col("quality") - 0.6), 200)
    return spark.createDataFrame([tuple(round(x, 6) for x in found)], "mean double, low double, high double")


MATCHED = "SELECT o_custkey, month(o_orderdate) AS m, CAST(max(o_totalprice) > 250000 AS INTEGER) AS won FROM orders WHERE year(o_orderdate) {} 1995 GROUP BY 1, 2"


@query("label_matched", f"SELECT a.o_custkey, a.m, CAST(b.won > a.won AS DOUBLE) AS label FROM ({MATCHED.format('<')}) a JOIN ({MATCHED.format('>=')}) b ON a.o_custkey = b.o_custkey AND a.m = b.m")
def label_matched(spark, sf):
    orders = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    early, late = (orders.where(c).groupBy("o_custkey", "m").agg((F.max("o_totalprice") > 250000).cast("int").alias("won")) for c in (F.year("o_orderdate") < 1995, F.year("o_orderdate") >= 1995))
    return metrics.matched_label(early, late, ["o_custkey", "m"], "won").select("o_custkey", "m", "label")


@query("readout_logistic")
def readout_logistic(spark, sf):
    """Out-of-fold scores of all line items, orders whole in a fold; the readout is tested against Newton's method."""
    df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity"), F.col("l_discount"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    out = metrics.out_of_fold(df, ["l_quantity", "l_discount"], "y", "l_orderkey")
    return out.agg(F.count("probability").alias("n"), *metrics.classification("y", "probability")).select("n", F.round("brier", 4).alias("brier"), F.round("log_loss", 4).alias("log_loss"))


@query("split_time", "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-10' THEN 'train' WHEN ts < TIMESTAMP '2024-01-20' THEN 'val' ELSE 'test' END AS split FROM events")
def split_time(spark, sf):
    from datetime import datetime

    return metrics.time_split(table(spark, sf, "events"), "ts", datetime(2024, 1, 10), datetime(2024, 1, 20)).select("event_id", "split")


@query("calendar_cyclical", "SELECT event_id, " + ", ".join(f"round({f}(2 * pi() * {h} * CAST(hour(ts) AS DOUBLE) / 24), 6) + 0.0 AS {f}{h}" for h in (1, 2) for f in ("sin", "cos")) + " FROM events")
def calendar_cyclical(spark, sf):
    df = table(spark, sf, "events").withColumn("h", F.hour("ts"))
    return df.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(metrics.cyclical("h", 24), ("sin1", "cos1", "sin2", "cos2"))])


# ---------------------------------------------------------------- pipelines (rows only)

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def revenue(spark, sf, **options) -> Pipeline:
    df = table(spark, sf, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return Pipeline(df, "revenue", LINE, {c: "numeric" for c in LINE}, row_id=KEY, **options)


def applied(p: Pipeline, fs: FeatureSet | None = None) -> DataFrame:
    out = p.transform(p.df, KEY, fs)
    return out.toDF(*KEY, *[f"f{k}" for k in range(len(out.columns) - len(KEY))])


def history(spark, p: Pipeline) -> DataFrame:
    return p.stages[-1].history.to_df(spark)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("marginal_r2", "cumulative_r2")})


@query("pipeline_flagship")
def flagship(spark, sf):
    p = revenue(spark, sf)
    s0 = p.raw()
    p.select(p.fuse(s0, p.am(s0)), 5, "omp")
    return applied(p)


def selecting(method: str, **options) -> Query:
    def run(spark, sf):
        p = revenue(spark, sf, **options)
        s0 = p.raw()
        p.select(p.fuse(s0, p.carriers(s0)), 5, method)
        return history(spark, p)

    return run


for method in ("greedy", "omp", "correlation"):
    query(f"select_{method}")(selecting(method))
    query(f"select_{method}_folds")(selecting(method, use_folds=True))


INPUTS = "WITH b AS (SELECT CAST(l_quantity AS DOUBLE) AS a, CAST(l_extendedprice AS DOUBLE) AS b, CAST(l_discount AS DOUBLE) AS c, CAST(l_tax AS DOUBLE) AS d, CAST(l_extendedprice AS DOUBLE) * (1 - l_discount) AS y FROM lineitem), r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, abs(corr({v}, y)) AS rel, abs(corr({v}, a)) AS ra, abs(corr({v}, b)) AS rb, abs(corr({v}, c)) AS rc, abs(corr({v}, d)) AS rd FROM b" for n, v in zip(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "abcd")) + ")"


@query("select_inputs_omp", INPUTS + ", f AS (SELECT name, rel FROM r ORDER BY rel DESC LIMIT 1) SELECT 0 AS step, name, 'raw' AS family, round(rel * rel, 6) AS marginal_r2, round(rel * rel, 6) AS cumulative_r2 FROM f")
def select_inputs_omp(spark, sf):
    """Pursuit of one input: its R² is the squared correlation."""
    p = revenue(spark, sf)
    p.select(FeatureSet(p._inputs), 1, "omp")
    return rounded(history(spark, p))


@query("select_inputs_correlation", INPUTS + """, f AS (SELECT name, rel FROM r ORDER BY rel DESC LIMIT 1), s AS (SELECT r.name, r.rel, r.rel - 0.5 * CASE f.name WHEN 'l_quantity' THEN ra WHEN 'l_extendedprice' THEN rb WHEN 'l_discount' THEN rc ELSE rd END AS score FROM r, f WHERE r.name <> f.name ORDER BY score DESC LIMIT 1)
SELECT 0 AS step, name, 'raw' AS family, round(rel, 6) AS marginal_r2, round(rel, 6) AS cumulative_r2 FROM f UNION ALL SELECT 1, name, 'raw', round(rel, 6), round(score, 6) FROM s""")
def select_inputs_correlation(spark, sf):
    """Two steps of relevance minus redundancy."""
    p = revenue(spark, sf)
    p.select(FeatureSet(p._inputs), 2, "correlation")
    return rounded(history(spark, p))


@query("pipeline_fuse_transform", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + r("q", "q * q", "p", "q * p", "abs(q - p)") + " FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS p FROM lineitem)")
def pipeline_fuse_transform(spark, sf):
    """A fusion keeps an expression that repeats once, and transform projects it."""
    p = revenue(spark, sf)
    q, tax = raw("l_quantity"), raw("l_tax")
    both = p.fuse(FeatureSet((q, derive("{0} * {0}", [q], "q2", "squared"))), FeatureSet((tax, q, derive("{0} * {1}", [q, tax], "qt", "am_product"))), FeatureSet((derive("abs({0} - {1})", [q, tax], "|q-t|", "am_diff"),)))
    out = p.transform(p.df, KEY[:4], both)
    return out.select(*KEY[:4], *[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(f"v{k}") for k, c in enumerate(out.columns[4:])])


@query("select_per_class")
def select_per_class(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("cls", F.when(F.col("l_quantity") > 30, 1).otherwise(0))
    p = Pipeline(df, "cls", LINE, {c: "numeric" for c in LINE}, row_id=KEY, classification=True)
    p.raw(select=3, method="greedy")
    return history(spark, p)


@query("select_group_aware")
def select_group_aware(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    p = Pipeline(df, "revenue", LINE, {c: "numeric" for c in LINE}, row_id=KEY, group="l_linenumber", group_weight=0.5)
    p.raw(select=3)
    return history(spark, p)


@query("stage_fields")
def stage_fields(spark, sf):
    p = revenue(spark, sf)
    p.field_pipeline(FeatureSet(p._inputs), 3, 3)
    return applied(p)


@query("stage_probe_fields")
def stage_probe_fields(spark, sf):
    p = revenue(spark, sf)
    p.probe_fields(FeatureSet(p._inputs), select=4, max_groups=1)
    return applied(p)


@query("stage_fft_carriers")
def stage_fft_carriers(spark, sf):
    df = table(spark, sf, "part").withColumn("wave", F.sin(F.col("p_retailprice") / 40))
    p = Pipeline(df, "wave", ["p_size", "p_retailprice"], {"p_size": "numeric", "p_retailprice": "numeric"}, row_id=["p_partkey"])
    p.fft_carriers(FeatureSet(p._inputs), select=4)
    return p.transform(p.df, ["p_partkey"]).toDF("p_partkey", *[f"f{k}" for k in range(len(p.output))])


@query("stage_modulations")
def stage_modulations(spark, sf):
    p = revenue(spark, sf)
    s = FeatureSet(p._inputs)
    sets = [p.fm(s, s, 4), p.fm_nonsmooth(s, s, 4), p.wm(s, s, 4)]
    return applied(p, p.fuse(*sets))


@query("workflow_auto_run")
def workflow_auto_run(spark, sf):
    p = revenue(spark, sf)
    return applied(p, auto_run(p, 6, 2))


@query("workflow_deepen")
def workflow_deepen(spark, sf):
    p = revenue(spark, sf)
    return applied(p, deepen(p, p.raw(), 6, 1, 3))


@query("workflow_carrier_space")
def workflow_carrier_space(spark, sf):
    p = revenue(spark, sf)
    return applied(p, discover_carrier_space(p, FeatureSet(p._inputs), 5, spaces=["linear", "log", "sqrt"])[0])


@query("workflow_prune")
def workflow_prune(spark, sf):
    out = prune_run(revenue(spark, sf), 5, 1, n_seeds=2)
    return spark.createDataFrame([(f, n) for f, n in sorted(out["family_counts"].items())], "family string, n int")


@query("workflow_multi_pass")
def workflow_multi_pass(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    result = multi_pass(df, "revenue", LINE, recipe_light(2), 2)
    out = result.transform_with_unused(df, KEY)
    return out.toDF(*[f"c{k}" for k in range(len(out.columns))])


@query("workflow_apply_stage")
def workflow_apply_stage(spark, sf):
    df = table(spark, sf, "part")
    return shown(df, "p_partkey", apply_stage(df, "am", ["p_size", "p_retailprice"], {"p_size": "numeric", "p_retailprice": "numeric"}))
