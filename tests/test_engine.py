"""Invariants and goldens of the sampling engine."""

import json
import math
import time
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import errors
from framewright.functions.ordering import desc, ordered, serp, terms
from framewright.operators import algorithms, coordinate, estimate, joint, planning, report, select
from framewright.operators.pools import bounded_sizes, pool_sizes
from framewright.operators.validate import fingerprint, fingerprint_differences, validate_frame
from framewright.plans import bound, register_method, sampling_design, unregister_method
from framewright.plans.serialize import design_json, read_design, replay_design
from framewright.sources import expand_listing
from framewright.streaming import stream_bernoulli


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, "ABCD"[i % 4], i // 10, 10 + (i // 10) * 7 % 90, float(i % 13), math.sin(i / 7) + 2, i % 12 + 0.5, i % 10 + 0.25) for i in range(200)]
    return spark.createDataFrame(rows, "id long, region string, ea long, mos long, y double, income double, lon double, lat double").cache()


def total(sample):
    return sample.df.agg(F.count("*"), F.sum("_weight")).first()


# verbs


@pytest.mark.parametrize(
    "build",
    [
        lambda d: d.draw(n=5, frac=0.1), lambda d: d.draw(), lambda d: d.draw(n=0), lambda d: d.draw(n=2.5), lambda d: d.draw(frac=1.5), lambda d: d.draw(n=5, method="pps_brewer"),
        lambda d: d.draw(n=5, mos="mos"), lambda d: d.draw(n=5, prn="p"), lambda d: d.draw(frac=0.1, method="pps_cps", mos="mos"), lambda d: d.draw(n={"A": 5}),
        lambda d: d.draw(n=5, aux="y"), lambda d: d.draw(n=5, method="lpm2"), lambda d: d.draw(n=5, method="no"), lambda d: d.draw(n=5).draw(n=5), lambda d: d.add_stage("a").add_stage(),
        lambda d: d.stratify_by("a", alloc="neyman").draw(n=5), lambda d: d.stratify_by("a", alloc="equal").draw(frac=0.1), lambda d: d.stratify_by("a", alloc="equal").draw(n={"x": 1}),
        lambda d: d.draw(n=5, method="pps_sps", mos="m", certainty_size=3, certainty_prop=0.1), lambda d: d.draw(n=5, certainty_size=3), lambda d: d.stratify_by("a").stratify_by("b"),
        lambda d: d.stratify_by("a", alloc="power", cv={"x": 1}, importance={"x": -1}), lambda d: d.draw(n=5, method="cube", aux=[bound("a")], spread="x"),
    ],
)
def test_wrong_plans_are_refused(build):
    with pytest.raises(errors.SamplingError):
        build(sampling_design())


def test_bounds_without_allocation_warn():
    with pytest.warns(errors.SamplingWarning):
        sampling_design().stratify_by("a").draw(n=5, min_n=2)


# sizes


def sizes(spark, populations, **options):
    rows = [(k,) for k, n in populations.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "region string")
    strata = {k: options.pop(k) for k in ("alloc", "cv", "importance", "variance", "cost", "power") if k in options}
    s = sampling_design().stratify_by("region", **strata).draw(**options).stages[0]
    return {r["region"]: r["_n"] for r in pool_sizes(df, [], s.strata, s.draw).collect()}


def test_allocation_goldens(spark):
    pops = {"A": 20, "B": 30, "C": 50}
    assert sizes(spark, pops, alloc="proportional", n=20) == {"A": 4, "B": 6, "C": 10}
    assert sizes(spark, pops, alloc="equal", n=12) == {"A": 4, "B": 4, "C": 4}
    assert sizes(spark, pops, frac=0.001, round="down") == {"A": 1, "B": 1, "C": 1}
    assert sizes(spark, pops, frac=0.05, round="nearest") == {"A": 1, "B": 2, "C": 2}
    assert sizes(spark, pops, n=40) == {"A": 20, "B": 30, "C": 40}
    assert sizes(spark, {"A": 800, "B": 150, "C": 50}, alloc="proportional", n=100, min_n=10) == {"A": 75, "B": 15, "C": 10}


def test_bounded_sizes():
    assert bounded_sizes(np.array([0.5, 2.5, 1.5]), np.array([9, 9, 9]), 4, None, None).sum() == 4
    for seed in range(50):
        rng = np.random.default_rng(seed)
        pop = rng.integers(1, 40, 6)
        n = int(rng.integers(6, max(7, pop.sum() // 2)))
        lo, hi = 1, int(max(8, -(-n // 2)))
        if np.minimum(hi, pop).sum() < n:
            continue
        got = bounded_sizes(n * pop / pop.sum(), pop, n, lo, hi)
        assert got.sum() == n and (got >= np.minimum(lo, pop)).all() and (got <= np.minimum(hi, pop)).all()
    with pytest.raises(errors.AllocationError):
        bounded_sizes(np.array([5.0, 5.0]), np.array([9, 9]), 10, 6, None)
    with pytest.raises(errors.AllocationError):
        bounded_sizes(np.array([5.0, 5.0]), np.array([9, 9]), 10, None, 4)


def test_missing_strata_in_a_table(spark, frame):
    with pytest.raises(errors.AuxiliaryError):
        sampling_design().stratify_by("region").draw(n={"A": 2}).execute(frame, "id").df.count()


# chances


def capped_naive(x, n):
    pi = np.zeros(len(x))
    on = np.zeros(len(x), bool)
    while True:
        free = n - on.sum()
        pi = np.where(on, 1.0, free * x / x[~on].sum())
        new = ~on & (pi >= 1)
        if not new.any():
            return pi
        on |= new


def test_capped_chances_against_iteration(spark):
    rng = np.random.default_rng(0)
    rows = [(p, i, int(v)) for p in range(12) for i, v in enumerate(np.ceil(rng.pareto(0.8, 40) * 3))]
    df = spark.createDataFrame(rows, "pool int, id int, x long")
    design = sampling_design().stratify_by("pool").draw(n=15, method="pps_brewer", mos="x")
    found = report.stage_chances(design, df, 1, "id").toPandas()
    for p, part in found.groupby("pool"):
        part = part.sort_values("id")
        x = np.array([r[2] for r in rows if r[0] == p], float)
        assert np.allclose(part["chance"], capped_naive(x, 15))
        assert math.isclose(part["chance"].sum(), 15)


def test_certainty(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([500, 400] + [10] * 8)], "id int, x long")
    s = sampling_design().draw(n=4, method="pps_brewer", mos="x", certainty_size=300).execute(df, "id", seed=3)
    rows = s.df.orderBy("id").collect()
    assert [r["id"] for r in rows[:2]] == [0, 1] and all(r["_certainty_1"] for r in rows[:2]) and len(rows) == 4
    assert [r["_weight"] for r in rows] == [1.0, 1.0, 4.0, 4.0]
    with pytest.raises(errors.SelectionError):
        sampling_design().draw(n=1, method="pps_brewer", mos="x", certainty_size=300).execute(df, "id")
    allowed = sampling_design().draw(n=1, method="pps_sps", mos="x", certainty_size=300, certainty_overflow="allow").execute(df, "id")
    assert {r["id"] for r in allowed.df.collect()} == {0, 1}


# selection

FIXED = ["srswor", "systematic", "pps_brewer", "pps_systematic", "pps_cps", "pps_sampford", "pps_sps", "pps_pareto", "pps_chromy", "pps_multinomial", "srswr", "cube", "lpm2", "scps"]


@pytest.mark.parametrize("method", FIXED)
def test_sizes_and_weights(frame, method):
    options = {"mos": "mos"} if method.startswith("pps") else {"aux": "income"} if method == "cube" else {"spread": ["lon", "lat"]} if method in ("lpm2", "scps") else {}
    design = sampling_design().stratify_by("region").draw(n=7, method=method, **options)
    s = design.execute(frame, "id", seed=11)
    rows = s.df.collect()
    counts = {r: sum(x["region"] == r for x in rows) for r in "ABCD"}
    assert counts == dict.fromkeys("ABCD", 7)
    if method not in ("srswr", "pps_multinomial", "pps_chromy"):
        assert len({x["id"] for x in rows}) == len(rows)
    chance = {r["id"]: r["chance"] for r in report.stage_chances(design, frame, 1, "id").collect()}
    assert all(math.isclose(x["_weight"], 1 / chance[x["id"]]) for x in rows)
    again = design.execute(frame.repartition(7, "y"), "id", seed=11).df
    assert sorted(x["id"] for x in again.collect()) == sorted(x["id"] for x in rows)  # partitions do not matter


def test_random_sizes_and_prn(frame):
    prn = frame.withColumn("u", (F.col("id") + 0.5) / 200)
    s = sampling_design().draw(frac=0.1, method="bernoulli", prn="u").execute(prn, "id", seed=1)
    assert {r["id"] for r in s.df.collect()} == set(range(20))
    assert {r["id"] for r in sampling_design().draw(frac=0.1, method="bernoulli", prn="u").execute(prn, "id", seed=2).df.collect()} == set(range(20))
    with pytest.raises(errors.SamplingError):
        sampling_design().draw(frac=0.1, method="bernoulli", prn="u").execute(prn, "id", reps=3)
    with pytest.raises(errors.SelectionError):
        sampling_design().draw(frac=1e-9, method="bernoulli", on_empty="error").execute(frame, "id")


def test_algorithms_keep_their_chances():
    rng = np.random.default_rng(0)
    x = rng.pareto(2, 12) + 0.3
    pi = capped_naive(x, 4)
    for name in ("pps_brewer", "pps_cps", "pps_sampford", "pps_chromy"):
        hits = np.mean([algorithms.select_pool(name, pi, rng) for _ in range(4000)], 0)
        assert np.abs(hits - pi).max() < 0.04, name
    spots = rng.random((12, 2))
    for name in ("lpm2", "scps"):
        draws = [algorithms.select_pool(name, pi, rng, spots=spots) for _ in range(3000)]
        assert {d.sum() for d in draws} == {4} and np.abs(np.mean(draws, 0) - pi).max() < 0.04, name
    expected = 6 * x / x.sum()
    hits = [algorithms.chromy(expected, rng) for _ in range(4000)]
    assert all(h.sum() == 6 for h in hits)
    assert all((h >= np.floor(expected)).all() and (h <= np.floor(expected) + 1).all() for h in hits)
    assert np.abs(np.mean(hits, 0) - expected).max() < 0.05


@pytest.mark.parametrize("name", ["lpm2", "scps"])
def test_spatial_draws_do_not_grow_by_the_square(name):
    rng = np.random.default_rng(4)
    took = []
    for size in (2000, 16000):
        spots = np.c_[rng.integers(1, 51, size), rng.random(size) * 1000]
        start = time.process_time()
        hits = algorithms.select_pool(name, np.full(size, 8 / size), rng, spots=spots)
        took.append(time.process_time() - start)
        assert hits.sum() == 8
    assert took[1] < 25 * took[0]  # 8 times the units; all pairs would be 64 times the work


def test_spatial_draws_spread_out():
    rng = np.random.default_rng(5)
    spots = np.array([(i % 40, i // 40) for i in range(1600)], float)
    for copies in (1, 3):
        many = np.tile(spots, (copies, 1))
        for name in ("lpm2", "scps"):
            hits = algorithms.select_pool(name, np.full(len(many), 16 / len(many)), rng, spots=many)
            by = np.bincount((many[hits > 0] // 10 @ [1, 4]).astype(int), minlength=16)
            assert hits.sum() == 16 and by.max() <= 3 and (by == 0).sum() <= 6, name


def test_cube_balances_and_bounds(spark, frame):
    s = sampling_design().draw(n=40, method="cube", aux=["income", "y"]).execute(frame, "id", seed=5)
    for r in report.balance_diagnostics(s).collect():
        assert abs(r["residual"]) < 0.1 * r["total"]
    b = sampling_design().draw(n=20, method="cube", aux=bound("region")).execute(frame, "id", seed=5)
    assert all(r["satisfied"] and r["realized"] == 5 for r in report.bounds_diagnostics(b).collect())


def test_cube_keeps_fractional_crossed_bounds(frame):
    s = sampling_design().draw(n=30, method="cube", aux=["income", bound("region"), bound("y")]).execute(frame, "id", seed=5)
    assert s.df.count() == 30 and all(r["satisfied"] for r in report.bounds_diagnostics(s).collect())
    rng = np.random.default_rng(2)
    pi = np.full(60, 11.0) / 60
    levels = [np.arange(60) % 7, np.arange(60) // 9]
    hard = np.stack([np.ones(60), *(np.equal(v, g).astype(float) for v in levels for g in range(7))], 1)
    expected = hard.T @ pi
    draws = np.array([algorithms.select_pool("cube", pi, rng, balance=np.c_[hard, rng.random(60)], fixed=15) for _ in range(1500)])
    counts = draws @ hard
    assert (counts[:, 0] == 11).all() and (np.abs(counts - expected) < 1).all()
    assert np.abs(draws.mean(0) - pi).max() < 0.05
    # each two of three units hold one: no draw does that
    pairs = np.array([[1, 1, 0, 1], [1, 1, 1, 0], [1, 0, 1, 1]], float)
    with pytest.raises(errors.SelectionError):
        algorithms.select_pool("cube", np.full(3, 0.5), rng, balance=pairs, fixed=4)


@pytest.mark.parametrize("options", [{"aux": ["y"]}, {"aux": ["y", bound("region")]}, {"aux": "y", "strata": "region"}])
def test_cube_pools_fly_in_parts(frame, monkeypatch, options):
    # no task may hold the pool of 200 units; parts leave a few open each
    monkeypatch.setattr(select, "CUBE_PART", 12)
    monkeypatch.setattr(select, "POOL_LIMIT", 90)
    strata = options.pop("strata", None)
    design = sampling_design()
    design = (design.stratify_by(strata) if strata else design).draw(n=6 if strata else 26, method="cube", **options)
    s = design.execute(frame, "id", seed=5)
    assert s.df.count() == (24 if strata else 26) and s.df.select("id").distinct().count() == s.df.count()
    for r in report.balance_diagnostics(s).where("total > 0").groupBy("variable").agg(F.sum("residual").alias("gap"), F.sum("total").alias("total")).collect():
        assert abs(r["gap"]) < 0.2 * r["total"]
    if design.stages[0].draw.bounds:
        assert all(r["satisfied"] for r in report.bounds_diagnostics(s).collect())


def test_short_flights_keep_chances_and_sums():
    rng = np.random.default_rng(6)
    pi = rng.random(40) * 0.5 + 0.1
    columns = np.c_[np.ones(40), rng.random((40, 2))]
    flown = np.array([algorithms.flight(pi, columns, rng) for _ in range(3000)])
    assert np.abs(flown @ columns - pi @ columns).max() < 1e-9 and ((flown > 0) & (flown < 1)).sum(1).max() <= 3
    assert np.abs(flown.mean(0) - pi).max() < 0.05
    assert algorithms.null_vector([[1.0, 2.0], [2.0, 4.0], [0.0, 1.0]], 2) == [-1.0, 0.5, 0.0]


def test_registered_methods(frame):
    def first(pool, n, rng):
        return (np.arange(len(pool)) < n).astype(int)

    register_method("pps_first", first)
    with pytest.raises(errors.DesignError):
        sampling_design().draw(n=3, method="pps_first", mos="mos")
    register_method("pps_first", first, probabilities="exact", variance="brewer")
    try:
        s = sampling_design().stratify_by("region").draw(n=3, method="pps_first", mos="mos").execute(frame, "id")
        assert {r["id"] for r in s.df.collect()} == set(range(12))
    finally:
        unregister_method("pps_first")
    with pytest.raises(errors.DesignError):
        register_method("lucky", first)


# order


@pytest.mark.parametrize("control", [serp("a", "b"), serp("a", "b", "c"), [desc("a"), "b"]])
def test_orders(spark, control):
    rng = np.random.default_rng(1)
    rows = [(i, *(None if v == 3 else int(v) for v in rng.integers(0, 4, 3))) for i in range(60)]
    df, by, helpers = ordered(spark.createDataFrame(rows, "id int, a int, b int, c int"), terms(control), [], ["id"])
    got = [r["id"] for r in df.orderBy(*by).drop(*helpers).collect()]

    def rank(v):
        return 4 if v is None else v + 1

    if isinstance(control, list):
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0, r[0]))
    else:
        def key(r):
            keys, moved = [], 0
            for j in range(len(control.columns)):
                k = rank(r[1 + j])
                k = k if j == 0 or moved % 2 == 0 else 5 - k
                keys.append(k)
                moved += k - 1
            return (*keys, r[0])

        want = sorted(rows, key=key)
    assert got == [r[0] for r in want]


# stages


def two_stage(frame, **options):
    return sampling_design().add_stage("areas").cluster_by("ea").draw(n=8, **options).add_stage("people").draw(n=3)


def test_two_stages_and_continuation(frame):
    design = two_stage(frame)
    whole = design.execute(frame, "id", seed=4)
    assert tuple(total(whole)) == (24, pytest.approx(8 * (20 / 8) * 10))
    first = design.execute(frame, "id", stages=[1], seed=4)
    assert first.df.count() == 80 and first.stages == [1]
    rest = first.execute(frame)
    assert sorted(r["id"] for r in rest.df.collect()) == sorted(r["id"] for r in whole.df.collect())
    assert rest.stages == [1, 2]
    with pytest.raises(errors.SampleError):
        rest.execute(frame)


def test_parents_hit_twice_have_samples_of_their_own(frame):
    s = two_stage(frame, method="srswr").execute(frame, "id", seed=4)
    by = s.df.groupBy("ea", "_draw_1").count().collect()
    assert len(by) == 8 and all(r["count"] == 3 for r in by)
    assert math.isclose(total(s)[1], 200)


def test_child_ids_may_repeat_across_parents(spark):
    rows = [(d, e, h) for d in "ABC" for e in range(4) for h in range(5)]
    df = spark.createDataFrame(rows, "district string, ea int, hh int")
    design = sampling_design().add_stage().cluster_by("district").draw(n=2).add_stage().cluster_by("ea").draw(n=2).add_stage().draw(n=1)
    s = design.execute(df, ["district", "ea", "hh"], seed=2)
    assert s.df.count() == 4 and s.df.select("district", "ea").distinct().count() == 4
    assert math.isclose(total(s)[1], 60)


def test_clusters_must_be_constant(frame):
    with pytest.raises(errors.FrameError):
        sampling_design().cluster_by("ea").draw(n=3, method="pps_brewer", mos="y").execute(frame, "id")
    s = sampling_design().cluster_by("ea").draw(n=3, method="pps_brewer", mos="mos").execute(frame, "id", seed=1)
    assert s.df.count() == 30


def test_phases_replicates_panels(frame):
    first = sampling_design().draw(n=100).execute(frame, "id", seed=1)
    second = sampling_design().stratify_by("region").draw(n=5).execute(first, "id", seed=2)
    assert math.isclose(total(second)[1], 200) and second.df.count() == 20
    conditional = estimate.two_phase(second)
    assert conditional.count() == 100 and conditional.where("_phase2").count() == 20
    design = sampling_design().stratify_by("region").draw(n=5)
    many = design.execute(frame, "id", seed=10, reps=4)
    for r in (1, 3):
        one = design.execute(frame, "id", seed=10 + r - 1).df.select("id").collect()
        assert sorted(one) == sorted(many.replicate(r).df.select("id").collect())
    with pytest.raises(errors.SampleError):
        estimate.svytotal(many, "y")
    dealt = design.execute(frame, "id", seed=10, panels=4).df.groupBy("region", "_panel").count().collect()
    assert {r["count"] for r in dealt} == {1, 2} and len(dealt) == 16


# frames


def test_frames_are_checked(spark, frame):
    design = sampling_design().stratify_by("region").draw(n=2, method="pps_brewer", mos="mos")
    with pytest.raises(errors.FrameError):
        design.execute(frame.drop("mos"), "id")
    with pytest.raises(errors.FrameError):
        design.execute(frame.limit(0), "id")
    with pytest.raises(errors.FrameError):
        design.execute(frame.withColumn("_weight", F.lit(1)), "id")
    bad = frame.withColumn("mos", F.when(F.col("id") == 3, -1).otherwise(F.col("mos"))).withColumn("region", F.when(F.col("id") > 5, F.col("region")))
    with pytest.raises(errors.FrameError) as caught:
        validate_frame(design, bad, unit_key="ea")
    assert len(caught.value.issues) == 3
    assert fingerprint_differences(fingerprint(frame), fingerprint(frame.repartition(5))) == []
    assert fingerprint_differences(fingerprint(frame), fingerprint(frame.drop("y")))
    assert fingerprint_differences(fingerprint(frame), fingerprint(frame.withColumn("y", F.col("y") + 1))) == ["the content differs"]


def test_samples_notice_changes(frame):
    s = sampling_design().stratify_by("region").draw(n=5).execute(frame, "id", seed=1)
    for changed in (s.filter("y > 3"), s.withColumn("_weight", F.lit(1.0)), s.withColumnRenamed("region", "r")):
        with pytest.raises(errors.SampleError):
            changed.check()
    s.withColumn("z", F.lit(1)).check()
    assert not hasattr(s.select("id"), "design")
    assert s.rewrap(s.df.repartition(3)).df.count() == 20
    with pytest.raises(errors.SampleError):
        s.rewrap(s.df.limit(19))
    assert [r["_sample_id"] for r in s.with_ids().orderBy("id").collect()] == list(range(1, 21))


# inference


def test_totals_and_domains(frame):
    s = sampling_design().draw(n=200).execute(frame, "id", seed=1)
    r = estimate.svytotal(s, "y").first()
    assert math.isclose(r["estimate"], frame.agg(F.sum("y")).first()[0]) and r["se"] < 1e-6  # a census
    s = sampling_design().stratify_by("region").draw(n=20).execute(frame, "id", seed=1)
    jk = estimate.replicate_total(s, "y", "JKn").first()
    lin = estimate.svytotal(s, "y").first()
    assert math.isclose(jk["se"] ** 2 * (1 - 20 / 50), lin["se"] ** 2, rel_tol=1e-9)
    assert estimate.svymean(s, "y", F.col("lon") > 6).first()["se"] > 0
    assert estimate.replicate_total(s, "y", "bootstrap", replicates=200).first()["se"] == pytest.approx(jk["se"], rel=0.3)
    two = sampling_design().stratify_by("region").draw(n=2).execute(frame, "id", seed=1)
    brr = estimate.replicate_total(two, "y", "BRR").first()["se"]
    assert math.isclose(brr, estimate.replicate_total(two, "y", "JKn").first()["se"], rel_tol=1e-9)


def test_standard_errors_count_every_stage(frame):
    # all clusters, 5 of 10 in each: the first stage adds nothing, the second all
    design = sampling_design().add_stage().cluster_by("ea").draw(n=20).add_stage().draw(n=5)
    s = design.execute(frame, "id", seed=3)
    rows = s.df.select("ea", "y").toPandas()
    within = sum(10 * 10 * (1 - 0.5) / 5 * part["y"].var() for _, part in rows.groupby("ea"))
    assert math.isclose(estimate.svytotal(s, "y").first()["se"], math.sqrt(within), rel_tol=1e-9)
    # three stages by hand: n1 of N1, then n2 of N2, then n3 of N3
    parts = frame.withColumn("area", F.floor(F.col("ea") / 5))
    design = sampling_design().add_stage().cluster_by("area").draw(n=3).add_stage().cluster_by("ea").draw(n=2).add_stage().draw(n=4)
    rows = design.execute(parts, "id", seed=3).df.select("area", "ea", "y").toPandas()
    w = 4 / 3 * 5 / 2 * 10 / 4
    v1 = (1 - 3 / 4) * 3 * (w * rows.groupby("area")["y"].sum()).var()
    v2 = sum((1 - 2 / 5) * 2 * (w * g.groupby("ea")["y"].sum()).var() for _, g in rows.groupby("area")) * 3 / 4
    v3 = sum((1 - 4 / 10) * 4 * (w * g["y"]).var() for _, g in rows.groupby("ea")) * 3 / 4 * 2 / 5
    assert math.isclose(estimate.svytotal(design.execute(parts, "id", seed=3), "y").first()["se"], math.sqrt(v1 + v2 + v3), rel_tol=1e-9)


def test_jackknife_by_totals_is_that_by_weights(frame):
    for kind, design in (("JK1", sampling_design().draw(n=12)), ("JKn", sampling_design().stratify_by("region").draw(n=4)), ("JK1", sampling_design().cluster_by("ea").draw(n=5))):
        s = design.execute(frame, "id", seed=2)
        rows, scale = estimate.replicate_weights(s, kind)
        whole = s.df.agg(F.sum(F.col("_weight") * F.col("y"))).first()[0]
        reps = rows.groupBy("_rep").agg(F.sum(F.col("_rep_weight") * F.col("y")).alias("t"), F.first("_rep_scale").alias("c")).collect()
        assert math.isclose(estimate.replicate_total(s, "y", kind).first()["se"], math.sqrt(sum(r["c"] * (r["t"] - whole) ** 2 for r in reps)), rel_tol=1e-9)


def test_a_cut_of_the_numbers_changes_no_sample(spark, frame, monkeypatch):
    from framewright.operators import select

    design = sampling_design().stratify_by("region").draw(n=7)
    many = spark.range(20_000).withColumn("region", F.when(F.col("id") < 60, "small").otherwise("large"))
    for rows, d in ((frame, design), (many, sampling_design().stratify_by("region").draw(n=45))):
        plain = d.execute(rows, "id", seed=8)
        monkeypatch.setattr(select, "CUT", 0)
        assert sorted(r["id"] for r in d.execute(rows, "id", seed=8).df.collect()) == sorted(r["id"] for r in plain.df.collect())
        monkeypatch.setattr(select, "CUT", 1000)
    # a pool short of numbers below the cut keeps all its units
    units = spark.createDataFrame([(i, 0.9 + i / 10_000, 50, 900) for i in range(900)], "id long, _u double, _n long, _pop long")
    pools = spark.createDataFrame([(50, 900)], "_n long, _pop long")
    assert select.below_cut(units, pools, [], "_u").count() == 900
    assert select.below_cut(units.withColumn("_u", F.col("id") / 900), pools, [], "_u").count() < 200


def test_unit_keys_are_checked(spark, frame):
    with pytest.raises(errors.FrameError, match="unit key"):
        sampling_design().draw(n=3).execute(frame.withColumn("id", F.when(F.col("id") > 3, F.col("id"))), "id")
    with pytest.raises(Exception, match="tell the units"):
        sampling_design().draw(n=3, method="pps_brewer", mos="mos").execute(frame.withColumn("k", F.lit(1)), "k").df.count()


def test_equal_rows_do_not_cancel_out_and_drift_has_both_sides(spark, frame):
    s = sampling_design().draw(n=4).execute(frame, "id", seed=1)
    one, two = (s.df.limit(1) for _ in range(2))
    other = s.df.orderBy(F.col("id").desc()).limit(1)
    assert s.__class__(one.union(two), s.design, [1], 1, ["id"]).integrity()[0] == 2
    pair = lambda df: s.__class__(df.union(df).withColumn("_weight", F.col("id") * 1.0), s.design, [1], 1, ["id"]).integrity()
    assert pair(s.df.orderBy("id").limit(1)) != pair(other)
    design = sampling_design().stratify_by("region").draw(n=2, method="pps_brewer", mos="mos")
    gone = {r["region"] for r in report.chance_drift(design, frame, frame.where("region != 'A'")).collect()}
    assert gone == {"A"}


def test_multistage_bootstrap_is_refused(frame):
    s = sampling_design().draw(n=20).execute(frame, "id", seed=1)
    with pytest.raises(errors.ExportError):
        estimate.replicate_weights(s, "mrbbootstrap")


def test_design_effects(frame):
    s = sampling_design().stratify_by("region").draw(n={"A": 5, "B": 10, "C": 20, "D": 25}).execute(frame, "id", seed=1)
    w = np.array([r["_weight"] for r in s.df.collect()])
    assert math.isclose(estimate.design_effect(s).first()[0], len(w) * (w**2).sum() / w.sum() ** 2)
    assert math.isclose(estimate.effective_n(s).first()[0], w.sum() ** 2 / (w**2).sum())
    assert estimate.design_effect(s, "y", "spencer").first()[0] > 0
    c = two_stage(frame).execute(frame, "id", seed=2)
    assert estimate.design_effect(c, "y", "cluster", cluster="ea").first()[0] is not None
    v = estimate.varcomp(c, "y").first()
    assert 0 < v["delta"] < 1


def test_joint_expectations():
    rng = np.random.default_rng(0)
    pi = capped_naive(rng.random(9) + 0.4, 4)
    for name in ("pps_cps", "pps_sampford", "pps_systematic"):
        m = joint.pool_matrix(name, pi, 4, 0)
        assert np.allclose(m, m.T) and np.allclose(np.diag(m), pi)
        assert np.allclose(m.sum(1), 4 * pi, atol=1e-6), name
        draw = (lambda: algorithms.select_pool(name, pi, rng)) if name != "pps_systematic" else (lambda: np.diff(np.floor(np.concatenate([[0], np.cumsum(pi)]) - rng.random())))
        seen = np.mean([np.outer(h, h) for h in (draw() for _ in range(6000))], 0)
        assert np.abs(seen - m).max() < 0.04, name
    m = joint.pool_matrix("pps_brewer", pi, 4, 0)
    assert (m <= np.minimum.outer(pi, pi) + 1e-12).all()


def test_joint_of_a_sample(frame):
    s = sampling_design().stratify_by("region").draw(n=4, method="pps_cps", mos="mos").execute(frame, "id", seed=1)
    pairs = joint.joint_expectation(s).toPandas()
    assert len(pairs) == 4 * 16
    same = pairs[pairs["id_i"] == pairs["id_j"]].set_index("id_i")["pi_ij"]
    weights = {r["id"]: r["_weight"] for r in s.df.collect()}
    assert all(math.isclose(1 / weights[i], v, rel_tol=1e-6) for i, v in same.items())
    with pytest.raises(errors.ExportError):
        joint.joint_expectation(sampling_design().draw(n=4, method="lpm2", spread=["lon", "lat"]).execute(frame, "id"))


# reports, files, planning, coordination


def test_summaries(frame):
    design = sampling_design("T").stratify_by("region").draw(n=5)
    s = design.execute(frame, "id", seed=1)
    pools = report.frame_summary(s).collect()
    assert all((r["N"], r["n_realized"], r["chance_status"]) == (50, 5, "constant") for r in pools)
    assert "20 of 200 elements in 4 pools" in report.summary_text(s)
    zero = sampling_design().draw(frac=0.02, method="bernoulli", on_empty="silent").execute(frame, "id", seed=1, reps=20)
    assert report.frame_summary(zero).count() == 20
    assert report.pool_drift(design, frame, frame.where("id <> 7")).collect()[0]["N_now"] == 49
    assert report.chance_drift(design, frame, frame).count() == 0
    assert report.spatial_diagnostics(frame, sampling_design().draw(n=3, method="scps", spread=["lon", "lat"])).first()["duplicates"] == 140
    before = report.frame_summary(two_stage(frame), frame, detail="stage").collect()
    assert [(r["n_pools"], r["N"], r["storage"]) for r in before] == [(1, 20, "units"), (20, 200, "constant")]


def test_design_files(tmp_path, frame):
    design = sampling_design("F").stratify_by("region", alloc="power", cv=dict.fromkeys("ABCD", 1.0), importance=dict(zip("ABCD", (1.0, 2.0, 3.0, 4.0)))).draw(n=12, method="systematic", control=[serp("ea", "y"), desc("lon")])
    s = design.execute(frame, "id", seed=9)
    path = tmp_path / "design.json"
    path.write_text(design_json(s, frame))
    again, _ = read_design(str(path))
    assert again == design
    replayed = replay_design(str(path), frame)
    assert sorted(r["id"] for r in replayed.df.collect()) == sorted(r["id"] for r in s.df.collect())
    with pytest.raises(errors.ReplayError):
        replay_design(str(path), frame.where("id > 0"))
    with pytest.raises(errors.ReplayError):
        read_design("https://example.org/design.json")
    broken = json.loads(path.read_text())
    broken["design"]["stages"][0]["draw"]["control"] = [{"order": "random", "columns": ["x"]}]
    with pytest.raises(errors.ReplayError):
        read_design(json.dumps(broken))
    with pytest.raises(errors.ReplayError):
        replay_design(design_json(design), frame)


def test_planning():
    assert planning.n_prop(0.5, 0.05).n == pytest.approx(384.15, abs=0.01)
    n = planning.n_mean(100, 1.0).n
    assert planning.prec_mean(50, 100, n)["moe"] == pytest.approx(1.0)
    p = planning.n_cluster(10000, 50, 5, 0.05)
    assert p.to_draw_n(1, True) == math.ceil(p.n) and p.to_draw_n(2, False) == math.ceil(p.per_cluster)
    size = planning.power_prop(0.3, 0.4, power=0.8)
    assert planning.power_prop(0.3, 0.4, n=size) == pytest.approx(0.8)


def test_strata_borders(frame):
    found = planning.strata_bounds(frame, "mos", 3).orderBy("stratum").collect()
    assert [r["stratum"] for r in found] == [1, 2, 3] and found[-1]["upper"] == frame.agg(F.max("mos")).first()[0]


def test_coordination(frame):
    a, b = frame.where("id < 50"), frame.where("id >= 40")
    assert tuple(coordinate.overlap(a, b, "id").first()) == (50, 160, 10)
    assert [(r["n_new"], r["n_so_far"]) for r in coordinate.coverage([a, b], "id").orderBy("wave").collect()] == [(50, 50), (150, 200)]
    assert coordinate.births_and_deaths(a, b, "id").groupBy("event").count().orderBy("event").collect()[0]["count"] == 150


def test_streams_and_listings(spark, frame, tmp_path):
    path = str(tmp_path / "frame")
    frame.write.parquet(path)
    stream = stream_bernoulli(spark.readStream.schema(frame.schema).parquet(path), 0.2, ["id"], 5)
    running = stream.writeStream.format("memory").queryName("taken").start()
    running.processAllAvailable()
    running.stop()
    batch = sampling_design().draw(frac=0.2, method="bernoulli").execute(frame, "id", seed=5)
    assert sorted(r["id"] for r in spark.table("taken").collect()) == sorted(r["id"] for r in batch.df.collect())
    assert expand_listing(frame.where("id < 5").withColumn("k", F.col("id")), "k").count() == 10


def test_monte_carlo(frame):
    """Replicates in one job: estimates are right on average, errors of the right size."""
    design = sampling_design().stratify_by("region").draw(n=10)
    many = design.execute(frame, "id", seed=100, reps=199)
    t = np.array([r[1] for r in many.df.groupBy("_replicate").agg(F.sum(F.col("_weight") * F.col("income"))).collect()])
    truth = frame.agg(F.sum("income")).first()[0]
    assert abs(t.mean() / truth - 1) < 0.02
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        se = estimate.svytotal(many.replicate(1), "income").first()["se"]
    assert 0.7 < se / t.std() < 1.4


def test_two_phase_variance_has_both_ends(frame):
    few = sampling_design().stratify_by("region").draw(n=12)
    all_of = sampling_design().draw(n=200)
    first = few.execute(frame, "id", seed=3)
    whole = sampling_design("again").stratify_by("region").draw(n=50)
    with pytest.warns(errors.SamplingWarning, match="fewer units"):
        second = whole.execute(first, "id", seed=4)
    a, b = estimate.two_phase_total(second, "income").first(), estimate.svytotal(first, "income").first()
    assert math.isclose(a["estimate"], b["estimate"]) and math.isclose(a["se"], b["se"])
    second = few.execute(all_of.execute(frame, "id", seed=3), "id", seed=4)
    a, b = estimate.two_phase_total(second, "income").first(), estimate.svytotal(few.execute(frame, "id", seed=4), "income").first()
    assert math.isclose(a["estimate"], b["estimate"]) and math.isclose(a["se"], b["se"])
    clusters = sampling_design().cluster_by("ea").draw(n=5).execute(first, "id", seed=5)
    with pytest.raises(errors.ExportError, match="two-phase"):
        estimate.two_phase_total(clusters, "income")
    with pytest.raises(errors.ExportError, match="two phases"):
        estimate.two_phase_total(first, "income")


def test_two_phase_variance_by_simulation():
    """The formula of two simple phases, in numpy, against what estimates do."""
    rng = np.random.default_rng(5)
    y, pool = rng.gamma(2.0, size=300), np.arange(300) % 3
    found, guessed = [], []
    for _ in range(3000):
        one = rng.choice(300, 90, replace=False)
        t = q = v = 0.0
        for g in range(3):
            inside = one[pool[one] == g]
            two = y[rng.choice(inside, 8, replace=False)]
            w = len(inside) / 8
            t, q, v = t + w * two.sum(), q + w * (two**2).sum(), v + (1 - 1 / w) * 8 * (w * two).var(ddof=1)
        found.append(300 / 90 * t)
        guessed.append((300 / 90) ** 2 * v + 300**2 * (1 - 0.3) / 90 * (q - (t * t - v) / 90) / 89)
    assert abs(np.mean(guessed) / np.var(found) - 1) < 0.08 and abs(np.mean(found) / y.sum() - 1) < 0.01


def test_rows_put_in_by_hand_are_found(frame):
    from dataclasses import replace

    sample = sampling_design().stratify_by("region").draw(n=5).execute(frame, "id", seed=2)
    estimate.svytotal(sample.withColumn("twice", F.col("y") * 2), "twice")
    estimate.svytotal(replace(sample, df=sample.df.orderBy("id")), "y")
    for changed in (sample.df.withColumn("_weight", F.lit(1.0)), sample.df.where("id % 2 = 0"), sample.df.union(sample.df), sample.df.drop("region")):
        with pytest.raises(errors.SampleError, match="as drawn"):
            estimate.svytotal(replace(sample, df=changed), "y")
    other = frame.select("region", F.lit(1).alias("more"))
    with pytest.raises(errors.SampleError, match="as drawn"):
        estimate.svytotal(sample.join(other, "region"), "y")
    estimate.svytotal(sample.join(other.distinct(), "region"), "more")
    many = sampling_design().draw(n=5).execute(frame, "id", reps=2)
    estimate.svytotal(many.replicate(2), "y")
    with pytest.raises(errors.SampleError, match="as drawn"):
        replace(many, df=many.df.limit(7)).replicate(2).check()


def test_digests_are_merged_and_kept(spark, frame, tmp_path):
    design = sampling_design().add_stage().cluster_by("ea").draw(n=4).add_stage().draw(n=3)
    other = frame.where("ea < 100")
    first = design.execute(frame, "id", stages=[1], seed=2)
    sample = first.execute(other)
    assert sample.frames == [frame, other]
    digest = report.frame_digest(sample)
    digest.write(str(tmp_path))
    again = report.read_digest(spark, str(tmp_path))
    assert [(r["stage"], r["N"], r["n_realized"]) for r in again.pools.orderBy("stage").collect()] == [(1, 20, 4)] + [(2, 10, 3)] * 4
    assert {r["stage"]: r["n_realized"] for r in again.stages.collect()} == {1: 4, 2: 12}
    many = sampling_design().stratify_by("region").draw(frac=0.05, method="bernoulli", on_empty="silent").execute(frame, "id", reps=3)
    found = report.frame_digest(many)
    assert found.pools.count() == 12 and found.stages.count() == 3
    assert found.pools.agg(F.sum("n_realized")).first()[0] == many.df.count() == found.stages.agg(F.sum("n_realized")).first()[0]
    with pytest.raises(errors.SampleError):
        report.frame_digest(sample.filter("id > 3"))


def test_doubts_are_told(frame):
    with pytest.warns(errors.SamplingWarning, match="is 0 in 16 of 200 rows"):
        sampling_design().draw(n=5, method="pps_sps", mos="y").execute(frame, "id")
    with pytest.warns(errors.SamplingWarning, match="4 pools have fewer"):
        assert sampling_design().stratify_by("region").draw(n=60).execute(frame, "id").df.count() == 200
    rare = sampling_design().draw(frac=0.004, method="bernoulli", on_empty="error")
    with pytest.raises(errors.SelectionError, match="in replicates"):
        rare.execute(frame, "id", reps=10)
    sample = sampling_design().draw(n=5).execute(frame, "id", seed=2)
    text, changed = design_json(sample, frame), frame.withColumn("y", F.col("y") + 1)
    with pytest.raises(errors.ReplayError, match="not the one recorded"):
        replay_design(text, changed)
    with pytest.warns(errors.SamplingWarning, match="not the one recorded"):
        replay_design(text, changed, "warn")
    with warnings.catch_warnings():
        warnings.simplefilter("error", errors.SamplingWarning)
        for mode in ("inform", "ignore"):
            assert replay_design(text, changed, mode).df.count() == 5
    with pytest.raises(errors.ReplayError, match="on_difference"):
        replay_design(text, changed, "perhaps")
