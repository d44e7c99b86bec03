"""Building blocks against pandas and numpy, with limits low enough to take every path."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeprofile.functions.columns import as_double
from lakeprofile.operators import (
    contingency, correlate, distinct, duplicates, frequency, groups, isolation, ks, moments, quantiles, ranks,
)

PROBABILITIES = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def numbers() -> pd.DataFrame:
    """Shapes that trouble a selection: a third of one value, heavy ties, long tails, gaps."""
    rng = np.random.default_rng(5)
    n = 3000
    hot = rng.normal(size=n)
    hot[: n // 3] = 0.25
    gaps = rng.normal(size=n)
    gaps[rng.choice(n, 400, replace=False)] = np.nan
    return pd.DataFrame({
        "hot": hot, "ties": rng.integers(0, 5, n).astype(float),
        "tail": rng.lognormal(0, 4, n), "gaps": gaps, "same": np.full(n, 7.5),
        "two": np.where(np.arange(n) < n - 1, 1.0, 2.0),
    }).sample(frac=1, random_state=1)


@pytest.mark.parametrize("window_values", [10, 200, 1_000_000])
def test_quantiles_equal_numpy_on_every_path(frame, numbers, window_values):
    df = frame(numbers)
    clean = {c: numbers[c].dropna() for c in numbers}
    got = quantiles.exact_quantiles(
        df, {c: as_double(df, c) for c in numbers}, PROBABILITIES,
        {c: len(v) for c, v in clean.items()}, {c: (v.min(), v.max()) for c, v in clean.items()},
        window_values,
    )
    for c, v in clean.items():
        expected = np.percentile(v, [100 * p for p in PROBABILITIES])
        assert got[c] == pytest.approx(list(expected), rel=1e-12), c


def test_quantiles_of_infinite_values(frame):
    x = [-np.inf, 1.0, 2.0, 3.0, np.inf]
    df = frame({"x": x})
    got = quantiles.exact_quantiles(
        df, {"x": F.col("x")}, [0.25, 0.5], {"x": 5}, {"x": (-np.inf, np.inf)}
    )
    assert got["x"] == [1.0, 2.0]


@pytest.mark.parametrize("bucket_rows", [100, 1_000_000])
def test_ranks_equal_pandas(frame, numbers, bucket_rows):
    df = frame(numbers)
    for c in ("hot", "ties", "tail", "gaps"):
        table = ranks.average_ranks(df, as_double(df, c), len(numbers), bucket_rows).toPandas()
        expected = numbers[c].rank()
        found = numbers[c].map(dict(zip(table["x"], table["rank"], strict=True)))
        assert np.allclose(found.dropna(), expected.dropna()), c


def test_ranges_cut_twice_keep_ranks(frame, numbers, monkeypatch):
    """Eight ranges at first, of which the large ones are cut again."""
    monkeypatch.setattr(ranks, "CUTS", 8)
    df = frame(numbers)
    for c in ("hot", "ties", "tail", "gaps"):
        table = ranks.average_ranks(df, as_double(df, c), len(numbers), 60).toPandas()
        expected = numbers[c].rank()
        found = numbers[c].map(dict(zip(table["x"], table["rank"], strict=True)))
        assert np.allclose(found.dropna(), expected.dropna()), c
    got = groups.class_quantiles(df, F.col("ties"), {"h": F.col("hot"), "t": F.col("tail")}, [0.5], 3000, 60)
    for r in got.collect():
        own = numbers[numbers["ties"] == r["key"]]
        assert r["h"] == pytest.approx([own["hot"].median()]) and r["t"] == pytest.approx([own["tail"].median()])


@pytest.mark.parametrize("bucket_rows", [2, 1_000_000])
def test_class_quantiles_keep_classes_without_values(spark, bucket_rows):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None), ("a", 3.0, 5.0), (None, 2.0, 2.0)], "k string, x double, y double")
    got = groups.class_quantiles(df, F.col("k"), {"x": F.col("x"), "y": F.col("y")}, [0.5], 4, bucket_rows)
    assert {r["key"]: (r["x"], r["y"]) for r in got.collect()} == {"a": ([2.0], [5.0]), "b": (None, None)}


def test_correlations_equal_pandas(frame, numbers):
    df = frame(numbers)
    columns = list(numbers)
    rows, present, stats = moments.numeric_moments(df, columns)
    pearson = correlate.pearson_pairs(df, columns, stats, rows)
    spearman = correlate.spearman_pairs(df, columns, stats, rows, bucket_rows=500)
    for method, got in (("pearson", pearson), ("spearman", spearman)):
        expected = numbers.corr(method)
        for (a, b), r in got.items():
            if np.isnan(expected.loc[a, b]):
                assert r is None, (method, a, b)
            else:
                assert r == pytest.approx(expected.loc[a, b], abs=1e-9), (method, a, b)


def test_moments_equal_numpy(frame, numbers):
    _, _, stats = moments.numeric_moments(frame(numbers), list(numbers))
    x = numbers["tail"]
    m = stats["tail"]
    d = x - x.mean()
    assert m.std == pytest.approx(x.std(ddof=1))
    assert m.skewness == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5)
    assert m.kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
    assert stats["same"].std == 0.0 and stats["same"].skewness is None
    assert stats["ties"].whole and not m.whole


def test_number_frequencies(frame, numbers):
    columns = list(numbers)
    got = frequency.number_frequencies(frame(numbers), columns)
    for c in columns:
        assert got[c].unique == numbers[c].nunique()
        assert got[c].mode == numbers[c].mode().iloc[0]
        assert got[c].top_count == numbers[c].value_counts().iloc[0]


def test_large_whole_numbers_keep_every_digit(spark):
    from lakeprofile.plans.profile import Profile

    big = 2**60
    df = spark.createDataFrame([(big + k,) for k in (0, 1, 2, 2)], "x bigint")
    f = Profile(df).frequencies["x"]
    assert f.unique == 3 and f.top[0] == (str(big + 2), 2)


def test_long_text_is_whole_and_counted_exactly(spark):
    long = "word " * 200
    texts = [long + "a"] * 5 + [long + "b"] * 3 + ["short"] * 4 + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    f = frequency.text_frequencies(df, ["t"], checks=True)["t"]
    assert f.top == [(long + "a", 5), ("short", 4), (long + "b", 3)]


def test_text_checks_see_through_padding(spark):
    texts = [" " * 100 + "NA", "0" * 80 + "1", "12", "x", "2024-01-05", "Jan 5 2024", "?"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = frequency.text_frequencies(df, ["t"], checks=True)["t"].text
    assert (t.numbers, t.dates, t.hidden) == (2, 2, 2)


def test_top_values_without_gathering_a_column(spark):
    """The top branch limits every task before its exchange."""
    df = spark.range(1000).selectExpr("cast(id % 50 as string) as t")
    counts = frequency.text_counts(df, ["t"])
    from pyspark.sql import Window

    top = counts.withColumn(
        "rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "s"))
    ).where("rank <= 10")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_large_numbers_that_lie_close_together(frame):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.choice(list("abc"), 500), "x": rng.normal(size=500)})
    pdf["x"] += (pdf["k"] == "b") * 0.8
    layouts = [
        groups.one_way(frame(pdf.assign(x=pdf["x"] + shift)), F.col("k"), {"x": F.col("x")},
                       centre={"x": shift})["x"].eta_squared for shift in (0.0, 1.7e9)
    ]
    assert layouts[0] > 0.05 and layouts[1] == pytest.approx(layouts[0], rel=1e-6)


def test_the_mode_of_decimals_is_the_lowest(spark):
    from lakeprofile.plans.profile import Profile

    df = spark.range(40).selectExpr("cast(5 + id % 20 as decimal(12,2)) as x", "'t' || id % 30 as t")
    assert Profile(df).frequencies["x"].mode == 5.0


def test_rows_with_gaps_in_different_cells_differ(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), (None, None)], "x string, y string")
    assert tuple(duplicates.duplicate_rows(df).first()) == (4, 1)
    twice = spark.createDataFrame([(1, 3, 3), (1, 3, 5), (2, 4, 3), (2, 4, 5)], "a int, b int, c int")
    assert duplicates.duplicate_columns(twice) == []


def test_duplicates(frame):
    pdf = pd.DataFrame({"a": [1, 1, 2, 2, 2, 3], "b": [np.nan, np.nan, 1, 1, 1, 2.0]})
    r = duplicates.duplicate_rows(frame(pdf)).first()
    assert (r["rows"], r["duplicates"]) == (6, int(pdf.duplicated().sum()))


def test_duplicate_columns_need_equal_order(frame):
    pdf = pd.DataFrame({"a": [1.0, 2, np.nan], "b": [1.0, 2, np.nan], "c": [2.0, 1, np.nan]})
    assert duplicates.duplicate_columns(frame(pdf)) == [("a", "b")]


def test_cramers_v_with_hot_and_rare_values(frame):
    rng = np.random.default_rng(2)
    a = np.where(rng.random(900) < 0.4, "hot", rng.integers(0, 200, 900).astype(str))
    b = rng.choice(["x", "y", "z"], 900)
    pdf = pd.DataFrame({"a": a, "b": b})
    table = pd.crosstab(pdf["a"], pdf["b"]).to_numpy()
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    chi2 = ((table - expected) ** 2 / expected).sum()
    got = contingency.cramers_v(frame(pdf), [("a", "b")], {"a": pdf["a"].nunique(), "b": 3})
    assert got["a", "b"] == pytest.approx(np.sqrt(chi2 / (900 * 2)), rel=1e-10)


@pytest.mark.parametrize("bucket_rows", [9, 50, 1_000_000])
def test_class_quantiles_split_large_classes(frame, bucket_rows):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["hot"] * 400 + list("abc") * 20, "x": rng.normal(size=460)})
    df = frame(pdf)
    got = groups.class_quantiles(
        df, F.col("k"), {"x": F.col("x")}, [0.25, 0.5], 460, bucket_rows
    ).collect()
    assert len(got) == 4
    for r in got:
        expected = np.percentile(pdf.loc[pdf["k"] == r["key"], "x"], [25, 50])
        assert r["x"] == pytest.approx(list(expected))


@pytest.mark.parametrize("bucket_rows", [20, 300, 1_000_000])
@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_ks_distance_equals_sorted_search(frame, bucket_rows, shift):
    rng = np.random.default_rng(4)
    ref = {"x": rng.normal(size=1100), "t": rng.integers(0, 6, 1100).astype(float),
           "i": np.r_[-np.inf, rng.normal(size=1098), np.inf]}
    cur = {"x": np.r_[rng.normal(shift, 1, 500), np.zeros(300)],
           "t": rng.integers(0, 7, 800).astype(float), "i": rng.normal(shift, 2, 800)}
    got = ks.ks_distances(
        frame(ref), frame(cur), list(ref), dict.fromkeys(ref, 1100), dict.fromkeys(ref, 800),
        bucket_rows,
    )
    for c in ref:
        both = np.concatenate([ref[c], cur[c]])
        f1 = np.searchsorted(np.sort(ref[c]), both, side="right") / 1100
        f2 = np.searchsorted(np.sort(cur[c]), both, side="right") / 800
        assert got[c] == pytest.approx(np.abs(f1 - f2).max(), abs=1e-12), c


def test_isolation_forest_finds_planted_values(frame):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 3000), [40.0, -35.0]])
    df = frame({"x": x})
    found = isolation.isolated_count(df, F.col("x"), len(x), contamination=0.001)
    assert 1 <= found <= 4
    auto = isolation.isolated_count(df, F.col("x"), len(x))
    assert 2 <= auto < len(x) / 2


def test_isolation_forest_samples_copies_one_by_one(frame):
    """A value that a third of the rows hold has about a third of every tree's sample."""
    x = np.concatenate([np.full(30_000, 5.0), np.random.default_rng(7).normal(0, 1, 60_000)])
    df = frame({"x": x})
    drawn = isolation.subsamples(df, F.col("x"), len(x)).select("tree", "x").toPandas()
    each = drawn.groupby("tree")["x"]
    assert (each.size() == isolation.SAMPLE).all() and len(each) == isolation.TREES
    share = each.apply(lambda s: (s == 5.0).mean())
    assert share.between(0.15, 0.52).all() and abs(share.mean() - 1 / 3) < 0.02
    again = isolation.subsamples(df.repartition(3), F.col("x"), len(x)).select("tree", "x").toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, drawn.to_numpy()))


def test_few_values_moves_no_column_of_many(spark, monkeypatch):
    """Columns at, below and above the limit; one of unique values is not read again."""
    from pyspark.sql.classic.dataframe import DataFrame

    df = spark.range(0, 20_000, 1, 8).selectExpr(
        "id % 30 as at", "id % 31 as above", "cast(id as double) as each", "id * 0 + 7 as one",
        "cast(null as double) as none", "if(id % 3 = 0, null, cast(id % 5 as string)) as text",
        "concat(repeat('long ', 2000), id % 2) as long", "uuid() as words",
    )
    plans = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (plans.append(self), collect(self))[1])
    got = distinct.few_values(df, {c: F.col(c) for c in df.columns}, 30)
    assert {c: v if v is None else len(v) for c, v in got.items()} == {
        "at": 30, "above": None, "each": None, "one": 1, "none": 0, "text": 5, "long": 2, "words": None,
    }
    second = " ".join(p._jdf.queryExecution().optimizedPlan().toString() for p in plans[1:])
    assert "uuid" not in second and "each" not in second and plans[1:]
    with pytest.raises(ValueError):
        distinct.few_values(df, {"at": F.col("at")}, 1000)


def test_times_with_a_named_zone_are_dates(spark):
    from lakeprofile.functions.text import parse_date

    texts = ["2024-01-01 10:00:00.123456 America/Argentina/ComodRivadavia", "2024-01-01", "2024 things to do"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_date(F.col("t")).isNotNull()).collect()
    assert [r[0] for r in got] == [True, True, False]
