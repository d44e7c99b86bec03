"""What Spark actually runs: shared shuffles, pruned scans and no joins that multiply rows."""

from __future__ import annotations

import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeprofile.functions.columns import as_double
from lakeprofile.functions.pvalues import shapiro_wilk
from lakeprofile.operators import (
    correlate, frequency, groups, ks, moments, normality, quantiles, ranks, sketch,
)
from lakeprofile.plans import chartfeed, correlation, drift, health, missing, target
from lakeprofile.plans.profile import Profile


@pytest.fixture
def executed(monkeypatch):
    """Final plans of everything collected during a test."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans: list[str] = []
    collect = DataFrame.collect

    def recording(self):
        out = collect(self)
        text = self._jdf.queryExecution().executedPlan().toString()
        plans.append(text.split("Initial Plan")[0])
        return out

    monkeypatch.setattr(DataFrame, "collect", recording)
    return plans


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    n = 4000
    pdf = pd.DataFrame({
        "a": rng.normal(size=n), "b": rng.integers(0, 50, n), "c": rng.exponential(size=n),
        "k": rng.choice(["x", "y", "z"], n), "t": [f"text {v}" for v in rng.integers(0, 900, n)],
        "unused": "never read",
    })
    path = str(tmp_path_factory.mktemp("data") / "t.parquet")
    pdf.to_parquet(path, index=False)
    return spark.read.parquet(path)


def read_columns(plan: str) -> set[str]:
    return set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))))


def test_scans_read_only_what_they_need(stored, executed):
    moments.numeric_moments(stored, ["a"], ["k"])
    assert read_columns(executed[-1]) == {"a", "k"}
    frequency.number_frequencies(stored, ["b"])
    assert read_columns(executed[-1]) == {"b"}


def test_moments_stay_in_generated_code(stored, executed):
    moments.numeric_moments(stored, ["a", "b", "c"])
    assert len(re.findall(r"\*\(\d+\) HashAggregate", executed[-1])) == 2


def test_frequency_branches_share_one_shuffle(stored, executed):
    frequency.text_frequencies(stored, ["k", "t"], checks=True)
    assert executed[0].count("FileScan") == 1
    assert executed[0].count("ReusedExchange") >= 3 and "WindowGroupLimit" in executed[0]
    executed.clear()
    ranks = {"a": [0, 10, 3999], "c": [5]}
    limits = {"a": (-5.0, 5.0), "c": (0.0, 12.0)}
    frequency.number_frequencies(stored, ["a", "c"], ranks, limits)
    assert executed[0].count("FileScan") == 1 and executed[0].count("ReusedExchange") >= 3


def test_bracket_search_shuffles_no_values_until_the_end(stored, executed, monkeypatch):
    monkeypatch.setattr(quantiles, "_SKETCH", 64)
    monkeypatch.setattr(quantiles, "_SLACK", 0.05)
    quantiles.exact_quantiles(
        stored, {"a": as_double(stored, "a")}, [0.1, 0.5], {"a": 4000}, {"a": (-5.0, 5.0)}, 100
    )
    *rounds, last = executed
    # A round shuffles sketches by group of tasks and counts by bracket and bound, never values.
    keys = [k for plan in rounds for k in re.findall(r"hashpartitioning\((\w+)#", plan)]
    assert rounds and set(keys) <= {"k", "__group"}, keys
    assert "hashpartitioning" in last


def test_sketches_of_tasks_meet_in_groups(stored, monkeypatch):
    """However many tasks there are, the last one merges at most GROUPS sketches of a column."""
    monkeypatch.setattr(sketch, "GROUPS", 3)
    cells = stored.repartition(20).selectExpr("b % 2 as c", "a as x")
    plan = sketch.sketches(cells, ["c"], 256)._jdf.queryExecution().executedPlan().toString()
    last, first = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert "__group" in first and "__group" not in last
    got = sketch.sketched_quantiles(stored.repartition(20), {"a": (F.col("a"), [0.1, 0.5]), "none": (F.lit(None).cast("double"), [0.5])}, 1024)
    want = np.quantile(stored.toPandas()["a"], [0.1, 0.5])
    assert got["none"] == [] and np.abs(np.array(got["a"]) - want).max() < 0.1


def test_ranges_do_not_grow_the_plan(spark):
    """Ten and twenty thousand ranges of a million rows, in plans of one size; no range is too large."""
    rows = 1_000_000
    cells = spark.range(rows).selectExpr("0 as c", "pow(rand(3), 9) as x")
    sizes = []
    for each in (100, 50):
        placed = ranks.in_ranges(cells, 1, rows, each)
        sizes.append(len(placed._jdf.queryExecution().optimizedPlan().toString()))
        counts = placed.groupBy("b").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).toPandas()
        assert len(counts) > 0.4 * rows / each and counts["n"].max() < 12 * each
        counts = counts.sort_values("b")
        assert (counts["high"].to_numpy()[:-1] < counts["low"].to_numpy()[1:]).all()
    assert abs(sizes[0] - sizes[1]) < 50 and sizes[0] < 20_000


def test_rank_joins_spread_gaps_and_hot_values(spark):
    """No task of a rank join gets all rows with a gap, nor all rows of a value that many hold."""
    rng = np.random.default_rng(10)
    n = 8000
    gap, hot, both = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    gap[: n // 2] = np.nan
    hot[n // 3 :] = 4.0
    both[: n // 2], both[n // 2 :] = np.nan, 1.5  # equal rows but for the others
    pdf = pd.DataFrame({"gap": gap, "hot": hot, "both": both}).sample(frac=1, random_state=2)
    df = spark.createDataFrame(pdf).repartition(48)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        for order in (["gap", "hot"], ["hot", "both"]):  # the last join deals the rows
            joined = correlate._with_ranks(df, {c: k for k, c in enumerate(order)}, [c for c in order if c != "hot"], n, 1000)
            tasks = joined.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
            assert tasks.sum() == n and tasks.max() < 3 * n / 16, order
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ranks_of_columns_with_gaps_shuffle_cells_twice(spark):
    """However many columns, a cell goes to its range and back, and no row is joined to ranks."""
    rng = np.random.default_rng(12)
    n, names = 3000, list("abcd")
    pdf = pd.DataFrame({c: rng.normal(size=n).round(k) for k, c in enumerate(names)})
    pdf.loc[rng.random(n) < 0.7, "d"] = 0.25
    for c in names:
        pdf.loc[rng.random(n) < 0.2, c] = np.nan
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=3)).repartition(5)
    ranked = correlate._with_ranks(df, {c: k for k, c in enumerate(names)}, names, n, 200)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    got = ranked.toPandas()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a != b:
                want = pdf[a][pdf[a].notna() & pdf[b].notna()].rank()
                pair = got[[f"r{i}_{j}", f"r{j}_{i}"]].dropna()
                assert np.array_equal(np.sort(pair.iloc[:, 0]), np.sort(want)), (a, b)
                assert pair.corr().iloc[0, 1] == pytest.approx(pdf[[a, b]].corr("spearman").iloc[0, 1], abs=1e-12)


@pytest.fixture
def jobs(spark, request):
    """Number of Spark jobs a piece of work starts."""

    def count(work) -> int:
        tracker, group = spark.sparkContext.statusTracker(), f"{request.node.name}-{time.time()}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            work()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    return count


def test_ks_takes_as_many_jobs_for_any_data_and_number_of_columns(stored, jobs):
    """Two equal distributions are the usual case."""
    halves = [stored.where(f"b % 2 = {k}").selectExpr("a", "c", "a as d", "c as e").cache() for k in (0, 1)]
    rows = [h.count() for h in halves]
    found = []
    for columns in (["a"], ["a", "c", "d", "e"]):
        for bucket_rows in (100, 500):
            found.append(jobs(lambda c=columns, b=bucket_rows: ks.ks_distances(
                *halves, c, dict.fromkeys(c, rows[0]), dict.fromkeys(c, rows[1]), b)))
    assert max(found) - min(found) <= 2 and max(found) < 12


def test_class_quantiles_take_as_many_jobs_for_any_number_of_classes(stored, jobs):
    found = []
    for classes in (4, 400):
        df = stored.selectExpr(f"cast(pmod(hash(a), {classes}) as string) as k", "a").cache()
        df.count()
        work = groups.class_quantiles(df, F.col("k"), {"a": F.col("a")}, [0.5], 4000, 300)
        found.append(jobs(work.collect))
    assert abs(found[0] - found[1]) <= 4  # adaptive execution cuts stages by size


@pytest.mark.parametrize("few", [10_000, 0])
def test_class_quantiles_read_cells_of_wanted_ranges_only(spark, monkeypatch, few):
    """Cells of other ranges don't leave the scan, whether the wanted ranges are few or many."""
    monkeypatch.setattr(groups, "FEW_RANGES", few)
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"k": rng.choice(list("xyz"), 6000), "a": rng.normal(size=6000), "b": rng.integers(0, 5, 6000) + 0.5})
    pdf.loc[rng.random(6000) < 0.3, "a"] = np.nan
    df = spark.createDataFrame([*pdf.itertuples(index=False, name=None), ("none", float("nan"), float("nan"))], "k string, a double, b double")
    df = df.select("k", *[F.nanvl(c, F.lit(None)).alias(c) for c in "ab"])
    got = groups.class_quantiles(df, F.col("k"), {c: F.col(c) for c in "ab"}, [0.5, 0.9], 6001, 300)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(CASE" not in plan and (not few or plan.count("MapInArrow") == 1)
    got = {r["key"]: r for r in got.collect()}
    assert got["none"]["a"] is None and got["none"]["b"] is None and len(got) == 4
    for k, own in pdf.groupby("k"):
        for c in "ab":
            assert got[k][c] == pytest.approx(own[c].dropna().quantile([0.5, 0.9]).tolist(), abs=1e-12)


def test_shapiro_shuffles_no_hot_values(stored, executed):
    """Ranks are added up where the values of a range lie, without windows over melted rows."""
    df = stored.selectExpr("a", "cast(pmod(hash(a), 3) as double) as three")
    columns = ["a", "three"]
    pdf = df.toPandas()
    executed.clear()
    rows, means = {c: int(pdf[c].count()) for c in columns}, {c: float(pdf[c].mean()) for c in columns}
    got = normality.shapiro_w(df, columns, rows, means, 100, 50)
    assert not any("Window" in plan or "Expand" in plan for plan in executed)
    for c in columns:
        assert got[c] == pytest.approx(shapiro_wilk(pdf[c].dropna().to_numpy())[0], abs=1e-10)


def test_ks_does_not_melt_rows(stored, executed):
    """Cells are merged by value where they are read."""
    halves = [stored.where(f"b % 2 = {k}").selectExpr("a", "b div 5 as e") for k in (0, 1)]
    pdfs = [h.toPandas() for h in halves]
    rows = [{c: len(p) for c in ("a", "e")} for p in pdfs]
    executed.clear()
    got = ks.ks_distances(*halves, ["a", "e"], *rows, 100)
    assert not any("Expand" in plan for plan in executed)
    for c in ("a", "e"):
        at = np.unique(np.concatenate([p[c] for p in pdfs]))
        gaps = [np.searchsorted(np.sort(p[c]), at, "right") / len(p) for p in pdfs]
        assert got[c] == pytest.approx(np.abs(gaps[0] - gaps[1]).max(), abs=1e-12)


def test_no_join_multiplies_rows(stored, executed):
    df = stored.drop("unused")
    p = Profile(df, checks=True)
    health.findings(p, target="k")
    correlation.spearman_matrix(p)
    correlation.cramers_matrix(p)
    target.target_notes(p, "k")
    chartfeed.class_boxes(p, "k").collect()
    chartfeed.histograms(p).collect()
    missing.missing_patterns(p).collect()
    other = df.selectExpr("a + 1 as a", "b", "c", "k", "t")
    drift.Drift(df, other).table()
    assert len(executed) > 10
    for plan in executed:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
