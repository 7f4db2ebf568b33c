"""One query for each operator of the sampling engine over the driver's tables, and its
SQL. Names of results are the same on both sides; fractions are rounded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ordering import ordered, serp, terms
from .functions.prn import uniform, uniform_sql
from .operators import coordinate, estimate, joint, report
from .operators.pools import pool_sizes
from .operators.validate import fingerprint_differences, issues_of
from .plans import bound, sampling_design
from .plans.serialize import design_json, replay_design
from .sources import table
from .streaming import stream_bernoulli, stream_poisson

SEED = 20
PRIORITY = "o_orderpriority"
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: Attributes of the strata, made up for these queries.
VARIANCE = dict(zip(PRIORITIES, (4.0, 9.0, 1.0, 16.0, 2.25), strict=True))
COST = dict(zip(PRIORITIES, (1.0, 4.0, 2.25, 1.0, 9.0), strict=True))
CV = dict(zip(PRIORITIES, (0.5, 0.25, 1.0, 0.75, 0.3), strict=True))
IMPORTANCE = dict(zip(PRIORITIES, (10.0, 20.0, 30.0, 40.0, 50.0), strict=True))
SIZES = dict(zip(PRIORITIES, (5, 10, 15, 20, 25), strict=True))
RATES = dict(zip(PRIORITIES, (0.01, 0.02, 0.0105, 0.0033, 0.05), strict=True))

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", PRIORITY, "o_orderdate", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("mos"))


def part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", F.round(F.col("p_retailprice") * 100).cast("long").alias("mos"))


ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, o_totalprice, CAST(round(o_totalprice * 100) AS BIGINT) AS mos FROM orders)"
PART = "p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, CAST(round(p_retailprice * 100) AS BIGINT) AS mos FROM part)"


def u(key: str, stage: int = 1, seed: int | str = SEED) -> str:
    return uniform_sql(seed, stage, key)


def values(name: str, rows: dict) -> str:
    return f"{name}(o_orderpriority, {name}_v) AS (VALUES {', '.join(f'({k!r}, {v}::DOUBLE)' for k, v in rows.items())})"


# sizes


def sizes(spark: SparkSession, d: str, **options) -> DataFrame:
    strata = {k: options.pop(k) for k in ("alloc", "variance", "cost", "cv", "importance", "power") if k in options}
    design = sampling_design().stratify_by(PRIORITY, **strata).draw(**options)
    s = design.stages[0]
    return pool_sizes(orders(spark, d), [], s.strata, s.draw).select(PRIORITY, F.col("_pop").alias("pop"), F.col("_n").alias("n_h"))


def allocated_sql(measure: str, tables: str = "", joins: str = "", n: int = 100) -> str:
    return f"""WITH {tables} s AS (SELECT o_orderpriority, count(*) AS pop FROM orders GROUP BY 1),
m AS (SELECT s.*, ({measure})::DOUBLE AS x FROM s {joins}), t AS (SELECT *, {n}.0 * x / sum(x) OVER () AS target FROM m),
f AS (SELECT *, floor(round(target, 9))::BIGINT AS fl FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY round(target - fl, 9) DESC, fl DESC, o_orderpriority) AS rn, round(sum(target) OVER ())::BIGINT - sum(fl) OVER () AS more FROM f)
SELECT o_orderpriority, pop, least(fl + (rn <= more)::BIGINT, pop)::BIGINT AS n_h FROM r"""


@query(allocated_sql("1"))
def alloc_equal(spark, d):
    return sizes(spark, d, alloc="equal", n=100)


@query(allocated_sql("pop"))
def alloc_proportional(spark, d):
    return sizes(spark, d, alloc="proportional", n=100)


@query(allocated_sql("pop * sqrt(variance_v)", values("variance", VARIANCE) + ",", "JOIN variance USING (o_orderpriority)"))
def alloc_neyman(spark, d):
    return sizes(spark, d, alloc="neyman", variance=VARIANCE, n=100)


@query(allocated_sql("pop * sqrt(variance_v) / sqrt(cost_v)", values("variance", VARIANCE) + "," + values("cost", COST) + ",", "JOIN variance USING (o_orderpriority) JOIN cost USING (o_orderpriority)"))
def alloc_optimal(spark, d):
    return sizes(spark, d, alloc="optimal", variance=VARIANCE, cost=COST, n=100)


@query(allocated_sql("cv_v * pow(importance_v, 0.5)", values("cv", CV) + "," + values("importance", IMPORTANCE) + ",", "JOIN cv USING (o_orderpriority) JOIN importance USING (o_orderpriority)"))
def alloc_power(spark, d):
    return sizes(spark, d, alloc="power", cv=CV, importance=IMPORTANCE, n=100)


@query(f"WITH {values('size', SIZES)} SELECT o_orderpriority, count(*) AS pop, least(any_value(size_v), count(*))::BIGINT AS n_h FROM orders JOIN size USING (o_orderpriority) GROUP BY 1")
def alloc_table_n(spark, d):
    return sizes(spark, d, n=SIZES)


def rates_sql(how: str) -> str:
    return f"WITH {values('rate', RATES)} SELECT o_orderpriority, count(*) AS pop, greatest({how}(any_value(rate_v) * count(*)::DOUBLE), 1)::BIGINT AS n_h FROM orders JOIN rate USING (o_orderpriority) GROUP BY 1"


@query(rates_sql("ceil"))
def alloc_named_frac(spark, d):
    return sizes(spark, d, frac=RATES)


def one_rate_sql(how: str) -> str:
    return f"SELECT o_orderpriority, count(*) AS pop, greatest({how}(0.0123::DOUBLE * count(*)::DOUBLE), 1)::BIGINT AS n_h FROM orders GROUP BY 1"


@query(one_rate_sql("ceil"))
def alloc_round_up(spark, d):
    return sizes(spark, d, frac=0.0123, round="up")


@query(one_rate_sql("floor"))
def alloc_round_down(spark, d):
    return sizes(spark, d, frac=0.0123, round="down")


@query(one_rate_sql("round_even").replace("count(*)::DOUBLE)", "count(*)::DOUBLE, 0)"))
def alloc_round_nearest(spark, d):
    return sizes(spark, d, frac=0.0123, round="nearest")


@query("WITH s AS (SELECT o_orderpriority, count(*) AS pop, row_number() OVER (ORDER BY o_orderpriority) AS i FROM orders GROUP BY 1) SELECT o_orderpriority, pop, least(20, pop)::BIGINT AS n_h FROM s")
def alloc_min_max(spark, d):
    return sizes(spark, d, alloc="proportional", n=100, min_n=20, max_n=20)


# chances


def capped_sql(frame: str, pool: str, key: str, x: str, n: str, more: str = "") -> str:
    """CTEs ``c``: chances of fixed-size draws by size, from a CTE ``frame`` with n."""
    return f"""j AS (SELECT *, row_number() OVER w AS jj, sum({x}) OVER (PARTITION BY {pool} ORDER BY {x} DESC, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suffix, {n} AS n FROM {frame} {more} WINDOW w AS (PARTITION BY {pool} ORDER BY {x} DESC, {key})),
h AS (SELECT *, min(CASE WHEN {x} > 0 AND jj <= n AND (n - jj + 1) * {x} >= suffix THEN 1 ELSE 0 END) OVER (PARTITION BY {pool} ORDER BY {x} DESC, {key} ROWS UNBOUNDED PRECEDING) AS capped FROM j),
g AS (SELECT *, sum(capped) OVER (PARTITION BY {pool}) AS mm, sum(CASE WHEN capped = 0 THEN {x} END) OVER (PARTITION BY {pool}) AS rest FROM h),
c AS (SELECT *, CASE WHEN capped = 1 THEN 1.0 WHEN {x} = 0 THEN 0.0 ELSE (n - mm)::DOUBLE * {x}::DOUBLE / rest::DOUBLE END AS pi FROM g)"""


def chance_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("chance", 9).alias("chance"))


@query(f"WITH {PART}, {capped_sql('p', 'p_brand', 'p_partkey', 'p_size', '30')} SELECT p_brand, p_partkey, round(pi, 9) AS chance FROM c")
def chance_pps_capped(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_brewer", mos="p_size")
    return chance_rows(report.stage_chances(design, part(spark, d), 1, "p_partkey"), "p_brand", "p_partkey")


CERTAIN = 49
_certain_rest = capped_sql("rest", "p_brand", "p_partkey", "p_size", "n0")


@query(f"""WITH {PART}, z AS (SELECT *, p_size >= {CERTAIN} AS certain FROM p), k AS (SELECT *, greatest(30 - count(*) FILTER (certain) OVER (PARTITION BY p_brand), 0) AS n0 FROM z),
rest AS (SELECT * FROM k WHERE NOT certain), {_certain_rest}
SELECT p_brand, p_partkey, 1.0 AS chance, TRUE AS certainty FROM k WHERE certain UNION ALL SELECT p_brand, p_partkey, round(pi, 9), FALSE FROM c""")
def chance_certainty_size(spark, d):
    """As its SQL has it: where more units than draws are certain, all of them stay."""
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_sps", mos="p_size", certainty_size=CERTAIN, certainty_overflow="allow")
    return report.stage_chances(design, part(spark, d), 1, "p_partkey").select("p_brand", "p_partkey", F.round("chance", 9).alias("chance"), "certainty")


@query(f"""WITH {PART}, s AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS suf FROM p),
z AS (SELECT *, min((p_size::DOUBLE >= 0.022 * suf::DOUBLE)::INT) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS UNBOUNDED PRECEDING) = 1 AS certain FROM s),
k AS (SELECT *, 60 - count(*) FILTER (certain) OVER (PARTITION BY p_brand) AS n0 FROM z), rest AS (SELECT * FROM k WHERE NOT certain), {_certain_rest}
SELECT p_brand, p_partkey, 1.0 AS chance, TRUE AS certainty FROM k WHERE certain UNION ALL SELECT p_brand, p_partkey, round(pi, 9), FALSE FROM c""")
def chance_certainty_prop(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=60, method="pps_sps", mos="p_size", certainty_prop=0.022, certainty_overflow="allow")
    return report.stage_chances(design, part(spark, d), 1, "p_partkey").select("p_brand", "p_partkey", F.round("chance", 9).alias("chance"), "certainty")


@query(f"WITH {PART} SELECT p_brand, p_partkey, round(least(0.6 * count(*) OVER w::DOUBLE * p_size::DOUBLE / sum(p_size) OVER w::DOUBLE, 1.0), 9) AS chance FROM p WINDOW w AS (PARTITION BY p_brand)".replace("OVER w::DOUBLE", "OVER w"))
def chance_poisson_capped(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(frac=0.6, method="pps_poisson", mos="p_size")
    return chance_rows(report.stage_chances(design, part(spark, d), 1, "p_partkey"), "p_brand", "p_partkey")


@query(f"WITH {PART} SELECT p_brand, p_partkey, round(60.0 * p_size::DOUBLE / sum(p_size) OVER (PARTITION BY p_brand), 9) AS chance FROM p")
def chance_hits(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=60, method="pps_multinomial", mos="p_size")
    return chance_rows(report.stage_chances(design, part(spark, d), 1, "p_partkey"), "p_brand", "p_partkey")


@query("SELECT o_custkey, o_orderkey, round(least(3, count(*) OVER w)::DOUBLE / count(*) OVER w, 9) AS chance FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def chance_within_parent(spark, d):
    design = sampling_design().add_stage().cluster_by("o_custkey").draw(n=40).add_stage().draw(n=3)
    return chance_rows(report.stage_chances(design, orders(spark, d), 2, "o_orderkey"), "o_custkey", "o_orderkey")


# selection


def drawn(sample, *columns: str) -> DataFrame:
    fpc = F.when(F.col("_fpc_1") == float("inf"), None).otherwise(F.col("_fpc_1").cast("long"))
    return sample.df.select(*columns, F.round("_weight", 6).alias("weight"), fpc.alias("fpc"))


@query(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {u('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS pop FROM orders) SELECT o_orderkey, round(pop / 50.0, 6) AS weight, pop AS fpc FROM r WHERE rn <= 50")
def srswor(spark, d):
    return drawn(sampling_design().draw(n=50).execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey")


@query(f"WITH a AS ({allocated_sql('pop')}), r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {u('o_orderkey')}, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_orderpriority, round(pop / n_h::DOUBLE, 6) AS weight, pop AS fpc FROM r JOIN a USING (o_orderpriority) WHERE rn <= n_h")
def srswor_stratified(spark, d):
    design = sampling_design("Orders by priority").stratify_by(PRIORITY, alloc="proportional").draw(n=100)
    return drawn(design.execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey", PRIORITY)


def draws_sql(pool: str, n: int) -> str:
    text = f"'{SEED}:1:draw:' || {pool} || ':' || i"
    return f"((('0x' || substr(md5({text}), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r})"


@query(f"WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS pop FROM orders), k AS (SELECT DISTINCT o_orderpriority, pop FROM r), dr AS (SELECT o_orderpriority, i, floor({draws_sql('o_orderpriority', 20)} * pop)::BIGINT + 1 AS rn FROM k, range(1, 21) t(i)) SELECT o_orderkey, i::BIGINT AS draw, round(pop / 20.0, 6) AS weight, NULL::BIGINT AS fpc FROM r JOIN dr USING (o_orderpriority, rn)")
def srswr(spark, d):
    design = sampling_design().stratify_by(PRIORITY).draw(n=20, method="srswr")
    return drawn(design.execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey", "_draw_1").withColumnRenamed("_draw_1", "draw")


def start_sql(pool: str) -> str:
    return f"((('0x' || substr(md5('{SEED}:1:start:' || {pool}), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r})"


def systematic_sql(order: str, source: str = "orders") -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {order}) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS pop FROM {source}),
a AS (SELECT *, floor((i * 20)::DOUBLE / pop - {start_sql('o_orderpriority')}) AS spot FROM r), b AS (SELECT *, coalesce(lag(spot) OVER (PARTITION BY o_orderpriority ORDER BY i), -1) AS was FROM a)"""


@query(f"WITH {systematic_sql('o_orderkey')} SELECT o_orderkey, round(pop / 20.0, 6) AS weight, pop AS fpc FROM b WHERE spot > was")
def systematic(spark, d):
    design = sampling_design().stratify_by(PRIORITY).draw(n=20, method="systematic")
    return drawn(design.execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey")


SERP = """k AS (SELECT *, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus NULLS LAST) AS k1, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate NULLS LAST) AS r2 FROM orders),
km AS (SELECT *, CASE WHEN (k1 - 1) % 2 = 0 THEN r2 ELSE max(r2) OVER (PARTITION BY o_orderpriority) + 1 - r2 END AS k2 FROM k)"""


@query(f"WITH {SERP}, {systematic_sql('k1, k2, o_orderkey', 'km')} SELECT o_orderkey, round(pop / 20.0, 6) AS weight, pop AS fpc FROM b WHERE spot > was")
def systematic_serp(spark, d):
    design = sampling_design().stratify_by(PRIORITY).draw(n=20, method="systematic", control=serp("o_orderstatus", "o_orderdate"))
    return drawn(design.execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey")


@query(f"WITH {SERP} SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY k1, k2, o_orderkey) AS place FROM km")
def serpentine_rank(spark, d):
    from pyspark.sql import Window

    df, by, helpers = ordered(orders(spark, d), terms(serp("o_orderstatus", "o_orderdate")), [PRIORITY], ["o_orderkey"])
    return df.select("o_orderkey", F.row_number().over(Window.partitionBy(PRIORITY).orderBy(*by)).cast("long").alias("place"))


@query(f"SELECT o_orderkey, round(1 / 0.05, 6) AS weight, (SELECT count(*) FROM orders) AS fpc FROM orders WHERE {u('o_orderkey')} < 0.05")
def bernoulli(spark, d):
    return drawn(sampling_design().draw(frac=0.05, method="bernoulli").execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey")


@query(f"WITH {ORDERS}, c AS (SELECT *, least(0.02 * count(*) OVER w * mos::DOUBLE / sum(mos) OVER w, 1.0) AS pi, count(*) OVER w AS pop FROM o WINDOW w AS (PARTITION BY o_orderpriority)) SELECT o_orderkey, round(1 / pi, 6) AS weight, pop AS fpc FROM c WHERE {u('o_orderkey')} < pi")
def pps_poisson(spark, d):
    design = sampling_design().stratify_by(PRIORITY).draw(frac=0.02, method="pps_poisson", mos="mos")
    return drawn(design.execute(orders(spark, d), "o_orderkey", seed=SEED), "o_orderkey")


def ranked_sql(rank: str) -> str:
    return f"""WITH {PART}, {capped_sql('p', 'p_brand', 'p_partkey', 'p_size', '30')},
v AS (SELECT *, {u('p_partkey')} AS uu FROM c WHERE pi > 0), q AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN pi >= 1 THEN -1.0 ELSE {rank} END, uu, p_partkey) AS rn, 0 AS z FROM v),
t AS (SELECT p_brand, count(*) AS pop FROM p GROUP BY 1)
SELECT p_partkey, round(1 / pi, 6) AS weight, pop AS fpc FROM q JOIN t USING (p_brand) WHERE rn <= n"""


@query(ranked_sql("uu / pi"))
def pps_sps(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_sps", mos="p_size")
    return drawn(design.execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey")


@query(ranked_sql("uu * (1 - pi) / ((1 - uu) * pi)"))
def pps_pareto(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_pareto", mos="p_size")
    return drawn(design.execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey")


@query(f"""WITH {PART}, {capped_sql('p', 'p_brand', 'p_partkey', 'p_size', '30')}, t AS (SELECT p_brand, count(*) AS pop FROM p GROUP BY 1),
x AS (SELECT *, sum(CASE WHEN capped = 0 THEN p_size ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS upto FROM c WHERE pi > 0),
a AS (SELECT *, floor(coalesce((upto * (n - mm))::DOUBLE / nullif(rest, 0), 0) - {start_sql('p_brand')}) AS spot FROM x), b AS (SELECT *, coalesce(lag(spot) OVER (PARTITION BY p_brand ORDER BY p_partkey), -1) AS was FROM a)
SELECT p_partkey, round(1 / pi, 6) AS weight, pop AS fpc FROM b JOIN t USING (p_brand) WHERE spot > was OR capped = 1""")
def pps_systematic(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_systematic", mos="p_size")
    return drawn(design.execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey")


@query(f"""WITH {PART}, s AS (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS upto, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM p WHERE p_size > 0),
k AS (SELECT DISTINCT p_brand, total FROM s), dr AS (SELECT p_brand, total, i, {draws_sql('p_brand', 30)} * total::DOUBLE AS point FROM k, range(1, 31) t(i))
SELECT p_partkey, i::BIGINT AS draw, round(total / (30.0 * p_size), 6) AS weight, NULL::BIGINT AS fpc FROM dr JOIN s USING (p_brand, total) WHERE upto - p_size < point AND point <= upto""")
def pps_multinomial(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_multinomial", mos="p_size")
    return drawn(design.execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "_draw_1").withColumnRenamed("_draw_1", "draw")


def pooled(name: str, **options):
    def run(spark, d):
        design = sampling_design().stratify_by("p_brand").draw(n=20, method=name, mos="p_size", **options)
        return drawn(design.execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "p_brand")

    run.__name__ = name
    return run


for _name in ("pps_brewer", "pps_cps", "pps_sampford", "pps_chromy"):
    query()(pooled(_name))


def invariants(name: str, n: int, **options):
    """Sizes and weights by stratum of a method whose units no SQL can name."""

    def run(spark, d):
        rows = sampling_design().stratify_by("p_brand").draw(n=n, method=name, **options).execute(part(spark, d), "p_partkey", seed=SEED).df
        by = rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("units"), F.max("_fpc_1").alias("pop"))
        return by.select("p_brand", "n", "units", F.round("pop", 0).cast("long").alias("pop"))

    run.__name__ = f"{name}_sizes"
    return run


for _name in ("pps_brewer", "pps_cps", "pps_sampford"):
    query("SELECT p_brand, least(20, count(*) FILTER (p_size > 0))::BIGINT AS n, least(20, count(*) FILTER (p_size > 0))::BIGINT AS units, count(*) AS pop FROM part GROUP BY 1")(invariants(_name, 20, mos="p_size"))
for _name, _options in (("cube", {"aux": "p_retailprice"}), ("lpm2", {"spread": ["p_size", "p_retailprice"]}), ("scps", {"spread": ["p_size", "p_retailprice"]})):
    query("SELECT p_brand, least(10, count(*))::BIGINT AS n, least(10, count(*))::BIGINT AS units, count(*) AS pop FROM part GROUP BY 1")(invariants(_name, 10, **_options))


@query("SELECT p_brand, count(*) AS pop, true AS within_bounds, 60 AS n FROM part GROUP BY 1")
def cube_bounds_sizes(spark, d):
    """Every brand's count is the whole number below or above what it expects."""
    parts = part(spark, d)
    rows = sampling_design().draw(n=60, method="cube", aux=["p_retailprice", bound("p_brand")]).execute(parts, "p_partkey", seed=SEED).df
    taken = rows.groupBy("p_brand").agg(F.count("*").alias("got"))
    by = parts.groupBy("p_brand").agg(F.count("*").alias("pop")).join(taken, "p_brand", "left").crossJoin(F.broadcast(parts.agg(F.count("*").alias("all")))).crossJoin(F.broadcast(rows.agg(F.count("*").cast("int").alias("n"))))
    expected = F.col("pop") * 60 / F.col("all")
    got = F.coalesce("got", F.lit(0))
    return by.select("p_brand", "pop", ((got >= F.floor(expected + 1e-9)) & (got <= F.ceil(expected - 1e-9))).alias("within_bounds"), "n")


@query()
def cube(spark, d):
    return drawn(sampling_design().draw(n=60, method="cube", aux=["p_size", "p_retailprice"]).execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "p_size", "p_retailprice")


@query()
def cube_stratified(spark, d):
    return drawn(sampling_design().stratify_by("p_brand").draw(n=10, method="cube", aux="p_retailprice").execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "p_brand")


@query()
def cube_bounds(spark, d):
    return drawn(sampling_design().draw(n=60, method="cube", aux=["p_retailprice", bound("p_brand")]).execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "p_brand")


@query()
def lpm2(spark, d):
    return drawn(sampling_design().stratify_by("p_brand").draw(n=10, method="lpm2", spread=["p_size", "p_retailprice"]).execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "p_brand")


@query()
def scps(spark, d):
    return drawn(sampling_design().stratify_by("p_brand").draw(n=10, method="scps", spread=["p_size", "p_retailprice"]).execute(part(spark, d), "p_partkey", seed=SEED), "p_partkey", "p_brand")


# stages


def two_stage_sample(spark: SparkSession, d: str):
    design = sampling_design().add_stage("customers").cluster_by("o_custkey").draw(n=40).add_stage("orders").draw(n=3)
    return design.execute(orders(spark, d), "o_orderkey", seed=SEED)


CLUSTERS = f"""k AS (SELECT DISTINCT o_custkey FROM orders), kr AS (SELECT o_custkey, row_number() OVER (ORDER BY {u('o_custkey')}, o_custkey) AS rn, count(*) OVER () AS clusters FROM k), kc AS (SELECT * FROM kr WHERE rn <= 40)"""
TWO_STAGE = f"""{CLUSTERS}, e AS (SELECT o.*, clusters, count(*) OVER (PARTITION BY o_custkey) AS pop2, row_number() OVER (PARTITION BY o_custkey ORDER BY {u('o_orderkey', 2)}, o_orderkey) AS rn2 FROM orders o JOIN kc USING (o_custkey)),
ts AS (SELECT *, clusters / 40.0 AS w1, pop2 / least(3, pop2)::DOUBLE AS w2, clusters / 40.0 * (pop2 / least(3, pop2)::DOUBLE) AS w FROM e WHERE rn2 <= 3)"""


@query(f"WITH {CLUSTERS} SELECT o_custkey, o_orderkey, round(clusters / 40.0, 6) AS weight, clusters AS fpc FROM orders JOIN kc USING (o_custkey)")
def cluster_srs(spark, d):
    return drawn(sampling_design().cluster_by("o_custkey").draw(n=40).execute(orders(spark, d), "o_orderkey", seed=SEED), "o_custkey", "o_orderkey")


@query(f"WITH {TWO_STAGE} SELECT o_custkey, o_orderkey, round(w, 6) AS weight, round(w1, 6) AS weight_1, round(w2, 6) AS weight_2, clusters AS fpc_1, pop2 AS fpc_2 FROM ts")
def two_stage(spark, d):
    s = two_stage_sample(spark, d)
    return s.df.select("o_custkey", "o_orderkey", *(F.round(f"_{c}", 6).alias(c) for c in ("weight", "weight_1", "weight_2")), *(F.col(f"_{c}").cast("long").alias(c) for c in ("fpc_1", "fpc_2")))


@query(f"WITH {TWO_STAGE} SELECT o_custkey, o_orderkey, round(w, 6) AS weight FROM ts")
def continuation(spark, d):
    design = sampling_design().add_stage().cluster_by("o_custkey").draw(n=40).add_stage().draw(n=3)
    first = design.execute(orders(spark, d), "o_orderkey", stages=[1], seed=SEED)
    return first.execute(orders(spark, d)).df.select("o_custkey", "o_orderkey", F.round("_weight", 6).alias("weight"))


@query(f"""WITH cn AS (SELECT c_custkey, c_nationkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT DISTINCT c_nationkey FROM cn), ar AS (SELECT c_nationkey, row_number() OVER (ORDER BY {u('c_nationkey')}, c_nationkey) AS rn, count(*) OVER () AS p1 FROM a),
b AS (SELECT DISTINCT c_nationkey, c_custkey, p1 FROM cn JOIN ar USING (c_nationkey) WHERE rn <= 5),
br AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY {u("octet_length(encode(c_nationkey::VARCHAR)) || '.' || c_nationkey || octet_length(encode(c_custkey::VARCHAR)) || '.' || c_custkey", 2)}, c_custkey) AS rn2, count(*) OVER (PARTITION BY c_nationkey) AS p2 FROM b),
e AS (SELECT cn.*, p1, p2, row_number() OVER (PARTITION BY c_custkey ORDER BY {u('o_orderkey', 3)}, o_orderkey) AS rn3, count(*) OVER (PARTITION BY c_custkey) AS p3 FROM cn JOIN (SELECT * FROM br WHERE rn2 <= 4) USING (c_nationkey, c_custkey))
SELECT c_nationkey, c_custkey, o_orderkey, round(p1 / 5.0 * (p2 / least(4, p2)::DOUBLE) * (p3 / least(2, p3)::DOUBLE), 6) AS weight FROM e WHERE rn3 <= 2""")
def three_stage(spark, d):
    frame = orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "c_custkey", "o_orderkey")
    design = sampling_design().add_stage().cluster_by("c_nationkey").draw(n=5).add_stage().cluster_by("c_custkey").draw(n=4).add_stage().draw(n=2)
    return design.execute(frame, "o_orderkey", seed=SEED).df.select("c_nationkey", "c_custkey", "o_orderkey", F.round("_weight", 6).alias("weight"))


_WR_PARENT = f"""cl AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) AS rn, count(*) OVER () AS clusters FROM cl),
dr AS (SELECT i, floor({draws_sql("''", 40)} * clusters)::BIGINT + 1 AS rn FROM (SELECT DISTINCT clusters FROM k), range(1, 41) t(i)),
h AS (SELECT o_custkey, i, clusters / 40.0 AS w1 FROM k JOIN dr USING (rn)),
ts AS (SELECT o.*, i, w1, row_number() OVER (PARTITION BY o_custkey, i ORDER BY {u('o_orderkey', 2)}, o_orderkey) AS rn2, count(*) OVER (PARTITION BY o_custkey, i) AS p2 FROM orders o JOIN h USING (o_custkey))"""


@query(f"WITH {_WR_PARENT} SELECT o_custkey, o_orderkey, i::INT AS draw, round(w1 * p2 / least(3, p2)::DOUBLE, 6) AS weight FROM ts WHERE rn2 <= 3")
def two_stage_wr_parent(spark, d):
    design = sampling_design().add_stage().cluster_by("o_custkey").draw(n=40, method="srswr").add_stage().draw(n=3)
    return design.execute(orders(spark, d), "o_orderkey", seed=SEED).df.select("o_custkey", "o_orderkey", F.col("_draw_1").alias("draw"), F.round("_weight", 6).alias("weight"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY {u('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS p1 FROM orders), f AS (SELECT * FROM a WHERE rn <= 400),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u('o_orderkey', 1, SEED + 1)}, o_orderkey) AS rn2, count(*) OVER (PARTITION BY o_orderstatus) AS p2 FROM f)
SELECT o_orderkey, o_orderstatus, round(p1 / 400.0 * (p2 / least(10, p2)::DOUBLE), 6) AS weight FROM b WHERE rn2 <= 10""")
def two_phase(spark, d):
    first = sampling_design().draw(n=400).execute(orders(spark, d), "o_orderkey", seed=SEED)
    second = sampling_design().stratify_by("o_orderstatus").draw(n=10).execute(first, "o_orderkey", seed=SEED + 1)
    return second.df.select("o_orderkey", "o_orderstatus", F.round("_weight", 6).alias("weight"))


@query(f"""WITH a AS (SELECT o_orderkey, r, row_number() OVER (PARTITION BY r, o_orderpriority ORDER BY ((('0x' || substr(md5(({SEED} + r - 1) || ':1:' || o_orderkey), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}), o_orderkey) AS rn, count(*) OVER (PARTITION BY r, o_orderpriority) AS pop FROM orders, range(1, 6) t(r))
SELECT o_orderkey, r::INT AS replicate, round(pop / 10.0, 6) AS weight FROM a WHERE rn <= 10""")
def replicates(spark, d):
    s = sampling_design().stratify_by(PRIORITY).draw(n=10).execute(orders(spark, d), "o_orderkey", seed=SEED, reps=5)
    return s.df.select("o_orderkey", F.col("_replicate").alias("replicate"), F.round("_weight", 6).alias("weight"))


@query(f"""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {u('o_orderkey')}, o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 4 + 1)::INT AS panel FROM r WHERE rn <= 10""")
def panels(spark, d):
    s = sampling_design().stratify_by(PRIORITY).draw(n=10).execute(orders(spark, d), "o_orderkey", seed=SEED, panels=4)
    return s.df.select("o_orderkey", PRIORITY, F.col("_panel").alias("panel"))


@query(f"""WITH {CLUSTERS.replace('<= 40', '<= 50')}, e AS (SELECT o.*, clusters, count(*) OVER (PARTITION BY o_custkey) AS pop2, row_number() OVER (PARTITION BY o_custkey ORDER BY {u('o_orderkey', 2)}, o_orderkey) AS rn2 FROM orders o JOIN kc USING (o_custkey))
SELECT o_custkey, o_orderkey, round(clusters / 50.0 * (pop2 / greatest(round_even(0.2::DOUBLE * pop2::DOUBLE, 0), 1)), 6) AS weight FROM e WHERE rn2 <= greatest(round_even(0.2::DOUBLE * pop2::DOUBLE, 0), 1)""")
def two_stage_self_weighting(spark, d):
    design = sampling_design().add_stage().cluster_by("o_custkey").draw(n=50).add_stage().stratify_by("o_custkey").draw(frac=0.2, round="nearest")
    return design.execute(orders(spark, d), "o_orderkey", seed=SEED).df.select("o_custkey", "o_orderkey", F.round("_weight", 6).alias("weight"))


# reports


def by_priority(**options):
    return sampling_design().stratify_by(PRIORITY, **({"alloc": options.pop("alloc")} if "alloc" in options else {})).draw(**options)


@query("WITH s AS (SELECT o_orderpriority, count(*) AS pop FROM orders GROUP BY 1) SELECT o_orderpriority, pop, 20.0 AS n_target, round(least(20, pop)::DOUBLE, 6) AS n_expected, least(20, pop)::BIGINT AS n_realized, round(least(20, pop)::DOUBLE / pop, 9) AS take_rate FROM s")
def frame_summary_pool(spark, d):
    s = by_priority(n=20).execute(orders(spark, d), "o_orderkey", seed=SEED)
    return report.frame_summary(s, detail="pool").select(PRIORITY, F.col("N").alias("pop"), F.col("n_target").cast("double").alias("n_target"), F.round("n_expected", 6).alias("n_expected"), "n_realized", F.round("take_rate", 9).alias("take_rate"))


@query("WITH s AS (SELECT o_orderpriority, count(*) AS pop FROM orders GROUP BY 1) SELECT 1 AS stage, 'element' AS unit_level, 'inclusion' AS chance_kind, 'constant' AS storage, count(*) AS n_pools, sum(pop)::BIGINT AS pop, round(sum(least(20, pop))::DOUBLE, 6) AS n_expected, sum(least(20, pop))::BIGINT AS n_realized FROM s")
def frame_summary_stage(spark, d):
    s = by_priority(n=20).execute(orders(spark, d), "o_orderkey", seed=SEED)
    return report.frame_summary(s, detail="stage").select("stage", "unit_level", "chance_kind", "storage", "n_pools", F.col("N").alias("pop"), F.round("n_expected", 6).alias("n_expected"), "n_realized")


@query(f"WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {u('o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS pop FROM orders) SELECT o_orderkey, round(20.0 / pop, 9) AS chance, rn <= 20 AS selected FROM r")
def frame_summary_unit(spark, d):
    s = by_priority(n=20).execute(orders(spark, d), "o_orderkey", seed=SEED)
    return report.frame_summary(s, detail="unit").select("o_orderkey", F.round("chance", 9).alias("chance"), "selected")


@query(f"WITH {PART}, {capped_sql('p', 'p_brand', 'p_partkey', 'p_size', '30')} SELECT p_brand, count(*) AS pop, round(sum(pi), 6) AS n_expected, CASE WHEN max(pi) - min(pi) <= 1e-12 THEN 'constant' ELSE 'varying' END AS chance_status FROM c GROUP BY 1")
def exante_digest(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_brewer", mos="p_size")
    return report.pool_table(design, part(spark, d)).select("p_brand", F.col("N").alias("pop"), F.round("n_expected", 6).alias("n_expected"), "chance_status")


@query(f"""WITH {PART}, c AS (SELECT p_brand, p_partkey, least(0.3 * count(*) OVER w * p_size::DOUBLE / sum(p_size) OVER w, 1.0) AS pi, count(*) OVER w AS pop FROM p WINDOW w AS (PARTITION BY p_brand)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pi, p_partkey) AS i, least(10, pop) AS k FROM c), b AS (SELECT *, ceil(i * k / pop::DOUBLE)::INT AS g FROM r)
SELECT p_brand, CASE WHEN i > pop * g // k THEN g + 1 ELSE g END AS bin, count(*) AS n, round(avg(pi), 6) AS chance FROM b GROUP BY 1, 2""")
def quantile_bins(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(frac=0.3, method="pps_poisson", mos="p_size")
    return report.chance_bins(design, part(spark, d), bins=10).select("p_brand", "bin", "n", F.round("chance", 6).alias("chance"))


@query("SELECT unnest(['mos column ''c_acctbal'' has negative or infinite values']) AS issue")
def frame_validation(spark, d):
    design = sampling_design().stratify_by("c_mktsegment").draw(n=5, method="pps_brewer", mos="c_acctbal")
    return spark.createDataFrame([(x,) for x in issues_of(design, table(spark, d, "customer"), 1)], "issue string")


@query("WITH a AS (SELECT o_orderpriority, count(*) AS b FROM orders GROUP BY 1), c AS (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT o_orderpriority, b AS before, n AS now FROM a FULL JOIN c USING (o_orderpriority) WHERE b IS DISTINCT FROM n")
def frame_drift(spark, d):
    old = orders(spark, d)
    return report.pool_drift(by_priority(n=20), old, old.where("o_orderstatus <> 'P'")).select(PRIORITY, F.col("N_before").alias("before"), F.col("N_now").alias("now"))


@query(f"""WITH p AS (SELECT o_orderpriority, count(*) AS pop FROM orders GROUP BY 1), h AS (SELECT r, o_orderpriority, count(*) AS n FROM orders, range(1, 4) t(r)
WHERE ((('0x' || substr(md5(({SEED} + r - 1) || ':1:' || o_orderkey), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)!r}) < 0.002 GROUP BY 1, 2)
SELECT r::INT AS replicate, o_orderpriority, pop, round(0.002 * pop, 6) AS n_expected, coalesce(n, 0) AS n_realized FROM range(1, 4) t(r), p LEFT JOIN h USING (r, o_orderpriority)""".replace("FROM range(1, 4) t(r), p LEFT", "FROM (SELECT * FROM range(1, 4) t(r), p) LEFT"))
def digest_replicates(spark, d):
    s = by_priority(frac=0.002, method="bernoulli", on_empty="silent").execute(orders(spark, d), "o_orderkey", seed=SEED, reps=3)
    return report.frame_digest(s).pools.select(F.col("_replicate").alias("replicate"), F.col("pool")[PRIORITY].alias(PRIORITY), F.col("N").alias("pop"), F.round("n_expected", 6).alias("n_expected"), "n_realized")


@query(f"""WITH {CLUSTERS}, e AS (SELECT o_custkey, count(*) AS pop FROM orders JOIN kc USING (o_custkey) GROUP BY 1)
SELECT 1 AS stage, NULL::VARCHAR AS o_custkey, count(*) AS pop, 40::BIGINT AS n_realized FROM k UNION ALL SELECT 2, o_custkey::VARCHAR, pop, least(3, pop) FROM e""")
def digest_continuation(spark, d):
    design = sampling_design().add_stage().cluster_by("o_custkey").draw(n=40).add_stage().draw(n=3)
    o = orders(spark, d)
    s = design.execute(o, "o_orderkey", stages=[1], seed=SEED).execute(o)
    return report.frame_digest(s).pools.select("stage", F.col("pool")["o_custkey"].alias("o_custkey"), F.col("N").alias("pop"), "n_realized")


@query(f"""WITH {PART}, a AS (SELECT p_brand, least(0.3 * count(*) OVER w * p_size::DOUBLE / sum(p_size) OVER w, 1.0) AS pi FROM p WINDOW w AS (PARTITION BY p_brand)),
b AS (SELECT p_brand, least(0.3 * count(*) OVER w * p_size::DOUBLE / sum(p_size) OVER w, 1.0) AS pi FROM p WHERE p_size <> 50 OR p_brand > 'Brand#3' WINDOW w AS (PARTITION BY p_brand)),
x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pi) AS i FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pi) AS i FROM b),
g AS (SELECT p_brand, max(abs(coalesce(x.pi, 0) - coalesce(y.pi, 0))) AS m FROM x FULL JOIN y USING (p_brand, i) GROUP BY 1) SELECT p_brand, round(m, 9) AS largest_change FROM g WHERE m > 1e-9""")
def chance_drift(spark, d):
    design = sampling_design().stratify_by("p_brand").draw(frac=0.3, method="pps_poisson", mos="p_size")
    p = part(spark, d)
    return report.chance_drift(design, p, p.where("p_size <> 50 or p_brand > 'Brand#3'")).select("p_brand", F.round("largest_change", 9).alias("largest_change"))


@query("SELECT min(p_size)::INT AS p_size_min, max(p_size)::INT AS p_size_max, round(min(p_retailprice), 2) AS p_retailprice_min, round(max(p_retailprice), 2) AS p_retailprice_max, count(*) - count(DISTINCT (p_size, p_retailprice)) AS duplicates FROM part")
def spatial_ranges(spark, d):
    design = sampling_design().draw(n=40, method="lpm2", spread=["p_size", "p_retailprice"])
    out = report.spatial_diagnostics(part(spark, d), design)
    return out.select(*(F.col(f"p_size_{x}").cast("int").alias(f"p_size_{x}") for x in ("min", "max")), *(F.round(f"p_retailprice_{x}", 2).alias(f"p_retailprice_{x}") for x in ("min", "max")), "duplicates")


@query(_oracles["srswor_stratified"])
def replayed_design(spark, d):
    """A sample drawn again from the JSON of its design and receipt."""
    o = orders(spark, d)
    design = sampling_design("Orders by priority").stratify_by(PRIORITY, alloc="proportional").draw(n=100)
    return drawn(replay_design(design_json(design.execute(o, "o_orderkey", seed=SEED), o), o), "o_orderkey", PRIORITY)


_STRAT = f"""r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {u('o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS pop FROM orders),
s AS (SELECT *, pop / 20.0 AS w FROM r WHERE rn <= 20)"""


def stratified(spark: SparkSession, d: str):
    return by_priority(n=20).execute(orders(spark, d), "o_orderkey", seed=SEED)


@query(f"WITH {_STRAT} SELECT count(*) AS n, round(avg(w), 6) AS mean, round(min(w), 6) AS min, round(max(w), 6) AS max, round(stddev_samp(w) / avg(w), 6) AS cv, round(count(*) * sum(w * w) / sum(w) ** 2, 6) AS deff, round(sum(w) ** 2 / sum(w * w), 6) AS n_eff FROM s")
def weight_diagnostics(spark, d):
    out = report.weight_diagnostics(stratified(spark, d))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("mean", "min", "max", "cv", "deff", "n_eff")))


# inference


def est(df: DataFrame) -> DataFrame:
    return df.select(F.round("estimate", 1).alias("estimate"), F.round("se", 1).alias("se"))


@query(f"WITH {_STRAT}, h AS (SELECT o_orderpriority, count(*) AS n, any_value(pop) AS pop, var_samp(w * o_totalprice) AS s2, sum(w * o_totalprice) AS t FROM s GROUP BY 1) SELECT round(sum(t), 1) AS estimate, round(sqrt(sum((1 - n / pop) * n * s2)), 1) AS se FROM h")
def ht_total(spark, d):
    return est(estimate.svytotal(stratified(spark, d), "o_totalprice"))


_MEAN = "m AS (SELECT sum(w * o_totalprice * a) / sum(w * a) AS mu, sum(w * a) AS size FROM x), z AS (SELECT x.*, CASE WHEN a = 1 THEN w * (o_totalprice - mu) / size ELSE 0 END AS z FROM x, m), h AS (SELECT o_orderpriority, count(*) AS n, any_value(pop) AS pop, var_samp(z) AS s2 FROM z GROUP BY 1) SELECT round((SELECT mu FROM m), 1) AS estimate, round(sqrt(sum((1 - n / pop) * n * s2)), 1) AS se FROM h"


@query(f"WITH {_STRAT}, x AS (SELECT *, 1 AS a FROM s), {_MEAN}")
def ht_mean_se_strat(spark, d):
    return est(estimate.svymean(stratified(spark, d), "o_totalprice"))


@query(f"WITH {_STRAT}, x AS (SELECT *, (o_orderstatus = 'O')::INT AS a FROM s), {_MEAN}")
def domain_mean(spark, d):
    return est(estimate.svymean(stratified(spark, d), "o_totalprice", F.col("o_orderstatus") == "O"))


_WR = _oracles["srswr"].replace("SELECT o_orderkey, i::BIGINT AS draw, round(pop / 20.0, 6) AS weight, NULL::BIGINT AS fpc FROM r", ", s AS (SELECT r.*, i, pop / 20.0 AS w, o_totalprice FROM r").replace("WITH r AS (SELECT o_orderkey,", "WITH r AS (SELECT o_orderkey, o_totalprice,")


@query(_WR.replace("pop / 20.0 AS w, o_totalprice FROM", "pop / 20.0 AS w FROM") + "), h AS (SELECT o_orderpriority, count(*) AS n, var_samp(w * o_totalprice) AS s2, sum(w * o_totalprice) AS t FROM s GROUP BY 1) SELECT round(sum(t), 1) AS estimate, round(sqrt(sum(n * s2)), 1) AS se FROM h")
def hh_total_wr(spark, d):
    s = by_priority(n=20, method="srswr").execute(orders(spark, d), "o_orderkey", seed=SEED)
    return est(estimate.svytotal(s, "o_totalprice"))


@query(f"SELECT round(sum(o_totalprice / 0.05), 1) AS estimate, round(sqrt(sum((1 - 0.05) * (o_totalprice / 0.05) ** 2)), 1) AS se FROM orders WHERE {u('o_orderkey')} < 0.05")
def poisson_se(spark, d):
    return est(estimate.svytotal(sampling_design().draw(frac=0.05, method="bernoulli").execute(orders(spark, d), "o_orderkey", seed=SEED), "o_totalprice"))


@query(f"WITH {CLUSTERS}, c AS (SELECT o_custkey, any_value(clusters) AS clusters, sum(clusters / 40.0 * o_totalprice) AS z FROM orders JOIN kc USING (o_custkey) GROUP BY 1) SELECT round(sum(z), 1) AS estimate, round(sqrt((1 - 40.0 / any_value(clusters)) * 40 * var_samp(z)), 1) AS se FROM c")
def cluster_se(spark, d):
    return est(estimate.svytotal(sampling_design().cluster_by("o_custkey").draw(n=40).execute(orders(spark, d), "o_orderkey", seed=SEED), "o_totalprice"))


@query(f"""WITH {TWO_STAGE}, v AS (SELECT ts.*, w1 * w2 * o_totalprice AS z FROM ts),
c AS (SELECT o_custkey, any_value(w1) AS w1, sum(z) AS z, count(*) AS n2, any_value(w2) AS w2, coalesce(var_samp(z), 0) AS s2 FROM v GROUP BY 1)
SELECT round(sum(z), 1) AS estimate, round(sqrt((1 - 1 / any_value(w1)) * count(*) * var_samp(z) + sum((1 - 1 / w2) * n2 * s2 / w1)), 1) AS se FROM c""")
def two_stage_se(spark, d):
    return est(estimate.svytotal(two_stage_sample(spark, d), "o_totalprice"))


@query(f"WITH {_WR_PARENT}, c AS (SELECT i, sum(w1 * p2 / least(3, p2) * o_totalprice) AS z FROM ts WHERE rn2 <= 3 GROUP BY 1) SELECT round(sum(z), 1) AS estimate, round(sqrt(40 * var_samp(z)), 1) AS se FROM c")
def two_stage_wr_se(spark, d):
    design = sampling_design().add_stage().cluster_by("o_custkey").draw(n=40, method="srswr").add_stage().draw(n=3)
    return est(estimate.svytotal(design.execute(orders(spark, d), "o_orderkey", seed=SEED), "o_totalprice"))


@query(f"""WITH b AS (SELECT p_brand, sum(p_size) AS size FROM part GROUP BY 1), c AS (SELECT p_brand, least(0.6 * count(*) OVER () * size::DOUBLE / sum(size) OVER (), 1.0) AS pi FROM b),
s AS (SELECT * FROM c WHERE {u('p_brand')} < pi), r AS (SELECT p.*, pi, row_number() OVER (PARTITION BY p_brand ORDER BY {u('p_partkey', 2)}, p_partkey) AS rn, count(*) OVER (PARTITION BY p_brand) AS pop FROM part p JOIN s USING (p_brand)),
v AS (SELECT *, pop / least(6, pop)::DOUBLE AS w2, p_retailprice / pi * (pop / least(6, pop)::DOUBLE) AS z FROM r WHERE rn <= 6),
g AS (SELECT p_brand, any_value(pi) AS pi, sum(z) AS z, count(*) AS n, any_value(w2) AS w2, coalesce(var_samp(z), 0) AS s2 FROM v GROUP BY 1)
SELECT round(sum(z), 1) AS estimate, round(sqrt(sum((1 - pi) * z * z) + sum(pi * (1 - 1 / w2) * n * s2)), 1) AS se FROM g""")
def pps_two_stage_se(spark, d):
    sized = part(spark, d).join(part(spark, d).groupBy("p_brand").agg(F.sum("p_size").alias("size")), "p_brand")
    design = sampling_design().add_stage().cluster_by("p_brand").draw(frac=0.6, method="pps_poisson", mos="size").add_stage().draw(n=6)
    return est(estimate.svytotal(design.execute(sized, "p_partkey", seed=SEED), "p_retailprice"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY {u('o_orderkey')}, o_orderkey) AS rn FROM orders), f AS (SELECT * FROM a WHERE rn <= 400),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u('o_orderkey', 1, SEED + 1)}, o_orderkey) AS rn2, count(*) OVER (PARTITION BY o_orderstatus) AS p2 FROM f)
SELECT o_orderkey, rn2 <= 10 AS phase2, CASE WHEN rn2 <= 10 THEN round(p2 / least(10, p2)::DOUBLE, 6) END AS conditional FROM b""")
def two_phase_weights(spark, d):
    first = sampling_design().draw(n=400).execute(orders(spark, d), "o_orderkey", seed=SEED)
    second = sampling_design().stratify_by("o_orderstatus").draw(n=10).execute(first, "o_orderkey", seed=SEED + 1)
    return estimate.two_phase(second).select("o_orderkey", F.col("_phase2").alias("phase2"), F.round("_weight_conditional", 6).alias("conditional"))


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY {u('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS pop FROM orders), f AS (SELECT * FROM a WHERE rn <= 400),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {u('o_orderkey', 1, SEED + 1)}, o_orderkey) AS rn2, count(*) OVER (PARTITION BY o_orderstatus) AS p2 FROM f),
s AS (SELECT o_orderstatus, o_totalprice AS y, pop / 400.0 AS w1, p2, p2 / least(10, p2)::DOUBLE AS w2 FROM b WHERE rn2 <= 10),
g AS (SELECT any_value(w1) AS w1, sum(w2 * y) AS t, sum(w2 * y * y) AS q, coalesce((1 - count(*) / any_value(p2)::DOUBLE) * count(*) * var_samp(w2 * y), 0) AS v FROM s GROUP BY o_orderstatus)
SELECT round(any_value(w1) * sum(t), 0) AS estimate, round(sqrt(any_value(w1) ** 2 * sum(v) + (any_value(w1) * 400) ** 2 * (1 - 1 / any_value(w1)) / 400 * (sum(q) - (sum(t) ** 2 - sum(v)) / 400) / 399), 0) AS se FROM g""")
def two_phase_se(spark, d):
    first = sampling_design().draw(n=400).execute(orders(spark, d), "o_orderkey", seed=SEED)
    second = sampling_design().stratify_by("o_orderstatus").draw(n=10).execute(first, "o_orderkey", seed=SEED + 1)
    return estimate.two_phase_total(second, "o_totalprice").select(F.round("estimate").alias("estimate"), F.round("se").alias("se"))


@query(f"WITH {_STRAT} SELECT round(count(*) * sum(w * w) / sum(w) ** 2, 9) AS deff FROM s")
def deff_kish(spark, d):
    return estimate.design_effect(stratified(spark, d)).select(F.round("deff", 9).alias("deff"))


@query(f"""WITH {CLUSTERS}, k2 AS (SELECT o_custkey, count(*)::DOUBLE AS m, avg(o_totalprice) AS a, coalesce(var_samp(o_totalprice), 0) AS v FROM orders JOIN kc USING (o_custkey) GROUP BY 1),
t AS (SELECT count(*) AS g, sum(m) AS n, sum(m * m) AS mm, sum((m - 1) * v) AS w, sum(m * a) AS s, sum(m * a * a) AS ss FROM k2),
x AS (SELECT g, n, (n - mm / n) / (g - 1) AS m0, (ss - s * s / n) / (g - 1) AS b, w / (n - g) AS w FROM t)
SELECT round(1 + (n / g - 1) * (b - w) / (b + (m0 - 1) * w), 6) AS deff FROM x""")
def deff_cluster(spark, d):
    s = sampling_design().cluster_by("o_custkey").draw(n=40).execute(orders(spark, d), "o_orderkey", seed=SEED)
    return estimate.design_effect(s, "o_totalprice", "cluster").select(F.round("deff", 6).alias("deff"))


@query(f"WITH {_STRAT} SELECT round(sum(w) ** 2 / sum(w * w), 9) AS n_eff FROM s")
def effective_n(spark, d):
    return estimate.effective_n(stratified(spark, d)).select(F.round("n_eff", 9).alias("n_eff"))


@query(f"""WITH {TWO_STAGE}, c AS (SELECT o_custkey, sum(w2 * o_totalprice) AS t, sum(w2) AS m, coalesce(var_samp(o_totalprice), 0) AS s2, any_value(w1) AS w1 FROM ts GROUP BY 1),
q AS (SELECT *, (1 / w1) / sum(1 / w1) OVER () AS p FROM c), g AS (SELECT avg(t / p) AS total, var_samp(t / p) AS b, avg(m * m * s2 / p) AS v FROM q)
SELECT round(b / total ** 2, 9) AS b2, round(v / total ** 2, 9) AS w2, round(b / (b + v), 9) AS delta FROM g""")
def varcomp_two_stage(spark, d):
    return estimate.varcomp(two_stage_sample(spark, d), "o_totalprice").select(*(F.round(c, 9).alias(c) for c in ("b2", "w2", "delta")))


@query(f"""WITH {PART}, c AS (SELECT *, least(0.02 * count(*) OVER () * p_size::DOUBLE / sum(p_size) OVER (), 1.0) AS pi FROM p), s AS (SELECT * FROM c WHERE {u('p_partkey')} < pi)
SELECT a.p_partkey AS i, b.p_partkey AS j, round(CASE WHEN a.p_partkey = b.p_partkey THEN a.pi ELSE a.pi * b.pi END, 9) AS pi_ij FROM s a, s b""")
def joint_poisson(spark, d):
    s = sampling_design().draw(frac=0.02, method="pps_poisson", mos="p_size").execute(part(spark, d), "p_partkey", seed=SEED)
    # rounded as DuckDB does, in doubles: Spark's round makes a decimal of each of the pairs
    rounded = F.floor(F.col("pi_ij") * 1e9 + 0.5) / 1e9
    return joint.joint_expectation(s).select(F.col("p_partkey_i").alias("i"), F.col("p_partkey_j").alias("j"), rounded.alias("pi_ij"))


@query(f"""WITH m AS ({_oracles['pps_multinomial'].replace('round(total / (30.0 * p_size), 6)', 'total / (30.0 * p_size)')}), s AS (SELECT DISTINCT p_partkey, p_brand, 1 / weight AS e FROM m JOIN part USING (p_partkey))
SELECT a.p_partkey AS i, b.p_partkey AS j, round(29 / 30.0 * a.e * b.e + CASE WHEN a.p_partkey = b.p_partkey THEN a.e ELSE 0 END, 4) AS pi_ij FROM s a JOIN s b USING (p_brand)""")
def joint_multinomial(spark, d):
    s = sampling_design().stratify_by("p_brand").draw(n=30, method="pps_multinomial", mos="p_size").execute(part(spark, d), "p_partkey", seed=SEED)
    return joint.joint_expectation(s).select(F.col("p_partkey_i").alias("i"), F.col("p_partkey_j").alias("j"), F.round("pi_ij", 4).alias("pi_ij"))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {u('o_orderkey')}, o_orderkey) AS rn, count(*) OVER () AS pop FROM orders), s AS (SELECT *, pop / 50.0 AS w FROM r WHERE rn <= 50), t AS (SELECT sum(w * o_totalprice) AS t FROM s) SELECT round((SELECT t FROM t), 1) AS estimate, round(sqrt(sum(49 / 50.0 * ((t.t - s.w * s.o_totalprice) * 50 / 49.0 - t.t) ** 2)), 1) AS se FROM s, t")
def jk1_replicates(spark, d):
    s = sampling_design().draw(n=50).execute(orders(spark, d), "o_orderkey", seed=SEED)
    return est(estimate.replicate_total(s, "o_totalprice", "JK1"))


# coordination


def wave(spark: SparkSession, d: str, by: str, rate: float = 0.1) -> DataFrame:
    frame = orders(spark, d).withColumn("prn", uniform(SEED, 1, ["o_orderkey"])).withColumn("later", coordinate.rotated("prn", F.lit(rate)))
    return sampling_design().draw(frac=rate, method="bernoulli", prn=by).execute(frame, "o_orderkey").df.select("o_orderkey")


_PRN = f"x AS (SELECT o_orderkey, {u('o_orderkey')} AS prn FROM orders), y AS (SELECT *, (prn - 0.1) - floor(prn - 0.1) AS later FROM x)"


@query(f"WITH {_PRN} SELECT count(*) FILTER (prn < 0.1) AS n_a, count(*) FILTER (prn < 0.15) AS n_b, count(*) FILTER (prn < 0.1 AND prn < 0.15) AS n_both FROM y")
def overlap_positive(spark, d):
    return coordinate.overlap(wave(spark, d, "prn"), wave(spark, d, "prn", 0.15), "o_orderkey")


@query(f"WITH {_PRN} SELECT count(*) FILTER (prn < 0.1) AS n_a, count(*) FILTER (later < 0.1) AS n_b, count(*) FILTER (prn < 0.1 AND later < 0.1) AS n_both FROM y")
def overlap_negative(spark, d):
    return coordinate.overlap(wave(spark, d, "prn"), wave(spark, d, "later"), "o_orderkey")


@query("WITH a AS (SELECT p_partkey, least(0.3 * count(*) OVER () * p_size::DOUBLE / sum(p_size) OVER (), 1.0) AS pa, 0.4::DOUBLE AS pb FROM part) SELECT round(sum(greatest(pa + pb - 1, 0)), 6) AS least, round(sum(pa * pb), 6) AS independent, round(sum(least(pa, pb)), 6) AS most FROM a")
def overlap_bounds(spark, d):
    p = part(spark, d)
    a = report.stage_chances(sampling_design().draw(frac=0.3, method="pps_poisson", mos="p_size"), p, 1, "p_partkey")
    b = report.stage_chances(sampling_design().draw(frac=0.4, method="bernoulli"), p, 1, "p_partkey")
    out = coordinate.overlap_bounds(a, b, "p_partkey")
    return out.select(*(F.round(c, 6).alias(c) for c in ("least", "independent", "most")))


@query(f"WITH {_PRN}, w AS (SELECT o_orderkey, CASE WHEN prn < 0.1 THEN 1 WHEN later < 0.1 THEN 2 WHEN prn < 0.15 THEN 3 END AS wave FROM y), n AS (SELECT wave, count(*) AS n_new FROM w WHERE wave IS NOT NULL GROUP BY 1) SELECT r::INT AS wave, coalesce(n_new, 0) AS n_new, sum(coalesce(n_new, 0)) OVER (ORDER BY r)::BIGINT AS n_so_far FROM range(1, 4) t(r) LEFT JOIN n ON wave = r")
def cumulative_coverage(spark, d):
    return coordinate.coverage([wave(spark, d, "prn"), wave(spark, d, "later"), wave(spark, d, "prn", 0.15)], "o_orderkey")


@query("SELECT o_orderkey, 'birth' AS event FROM orders WHERE o_orderdate >= DATE '1998-01-01' UNION ALL SELECT o_orderkey, 'death' FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < DATE '1998-01-01'")
def births_deaths(spark, d):
    o = orders(spark, d)
    return coordinate.births_and_deaths(o.where("o_orderdate < date '1998-01-01'"), o.where("o_orderstatus <> 'P' or o_orderdate >= date '1998-01-01'"), "o_orderkey")


# streams, as a batch


@query(f"SELECT event_id, 10.0 AS weight FROM events WHERE {u('event_id')} < 0.1")
def stream_rate(spark, d):
    return stream_bernoulli(table(spark, d, "events"), 0.1, ["event_id"], SEED).select("event_id", F.round("_weight", 6).alias("weight"))


@query(f"WITH e AS (SELECT event_id, least(value * 0.001, 1.0) AS pi FROM events) SELECT event_id, round(1 / pi, 6) AS weight FROM e WHERE {u('event_id')} < pi")
def stream_by_size(spark, d):
    return stream_poisson(table(spark, d, "events"), "value", 0.001, ["event_id"], SEED).select("event_id", F.round("_weight", 6).alias("weight"))


@query("SELECT 'content' AS what, 'rows: ' || count(*) || ' before, ' || count(*) FILTER (o_orderstatus <> 'P') || ' now' AS difference FROM orders")
def fingerprint_drift(spark, d):
    from .operators.validate import fingerprint

    o = orders(spark, d)
    found = fingerprint_differences(fingerprint(o), fingerprint(o.where("o_orderstatus <> 'P'")))
    return spark.createDataFrame([("content", x) for x in found], "what string, difference string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
