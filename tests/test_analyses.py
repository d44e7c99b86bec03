from __future__ import annotations

import statistics

import numpy as np
import pandas as pd
import pytest
from conftest import by, rows
from pyspark.sql import functions as F

from lakeprofile.functions.pvalues import shapiro_wilk
from lakeprofile.operators.normality import normal_quantile, shapiro_w
from lakeprofile.plans import (
    chartfeed, correlation, distribution, drift, missing, outlier, quality, summary, target,
)
from lakeprofile.plans.profile import Profile

# Quality


def test_gate_stops_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(quality.DataQualityError):
        quality.quality_issues(empty)
    with pytest.raises(quality.DataQualityError):
        quality.assert_quality(empty)
    assert rows(quality.quality_status(empty))[0]["status"] == "FAILED"
    found = rows(quality.quality_issues(spark.createDataFrame([], ""), gate=False))
    assert [r["check"] for r in found] == ["Empty rows", "Empty columns"]


def test_gap_and_copy_limits(frame):
    """A share of 0.90 missing cells or 0.50 copies is still quiet."""
    cells = np.full(50, np.nan)
    cells[:5] = [4.0, 8.0, 1.0, 9.0, 2.0]
    assert rows(quality.quality_issues(frame({"full": np.arange(50), "thin": cells}))) == []
    cells[4] = np.nan
    found = rows(quality.quality_issues(frame({"full": np.arange(50), "thin": cells})))
    assert [(r["check"], r["column"], r["value"]) for r in found] == [("High missing: thin", "thin", 0.92)]
    for copies, expected in ((30, []), (31, ["High duplicates"])):
        x = np.maximum(np.arange(60) - copies, 0)
        assert [r["check"] for r in rows(quality.quality_issues(frame({"x": x, "y": x * 2})))] == expected


def test_mixed_share_counts_missing_rows(frame):
    cells = [str(k / 4) for k in range(42)] + ["n.a.?"] * 8 + [None] * 10
    found = rows(quality.quality_issues(frame({"q&a": range(60), "v": cells})))
    assert [(r["check"], round(r["value"], 6)) for r in found] == [
        ("Special chars in column names", 1.0), ("Mixed types: v", 0.7),
    ]
    text = rows(quality.quality_issues(frame({"a": ["x", "y"], "b": ["z", "x"]})))
    assert [(r["check"], r["value"]) for r in text] == [("All-object dtypes", 2.0)]
    assert rows(quality.quality_status(frame({"a": ["x", "y"], "b": ["z", "x"]})))[0]["warnings"] == 1


def test_clean_table_passes(frame, beds):
    df = frame(beds)
    assert quality.assert_quality(df) is df
    assert rows(quality.quality_status(df))[0]["status"] == "PASSED"


def test_overview(frame):
    got = by(quality.overview(frame({"x": [1.0, np.nan], "t": ["ab", "c"]})))
    assert (got["x"]["non_null"], got["x"]["null_pct"], got["t"]["bytes"]) == (1, 50.0, 3)


# Distribution


def test_numeric_statistics_equal_numpy(frame, gappy):
    got = by(distribution.numeric_stats(frame(gappy)))
    assert list(got) == ["height", "weight", "shade"]
    for c, r in got.items():
        x = gappy[c].dropna()
        assert r["count"] == len(x) and r["null_count"] == 240 - len(x)
        assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std())
        assert r["p95"] == pytest.approx(np.percentile(x, 95))
        assert r["iqr"] == pytest.approx(r["p75"] - r["p25"])
        assert r["cv"] == pytest.approx(x.std() / abs(x.mean()))
        assert r["normality_test"] == "D'Agostino-Pearson" and 0 <= r["normality_pvalue"] <= 1
    assert any("skewness" in n for n in got["weight"]["notes"])


def test_small_and_odd_columns(frame):
    df = frame({"one": [5.0] + [np.nan] * 9, "none": [np.nan] * 10, "same": [3] * 10,
                "zero": [-1.0, 1.0] * 5})
    got = by(distribution.numeric_stats(df))
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None
    assert got["none"]["normality_test"] == "N/A" and got["none"]["notes"] == []
    assert got["one"]["std"] == 0.0 and got["one"]["skewness"] is None
    codes = [(r["column"], r["code"]) for r in rows(distribution.distribution_notes(df))]
    assert [c for n, c in codes if n == "one"] == ["single_value"]
    assert [c for n, c in codes if n == "same"] == ["zero_variance"] and len(got["same"]["notes"]) == 1
    assert got["zero"]["cv"] is None and got["zero"]["mode"] == -1.0


def test_large_columns_use_moments(spark):
    df = spark.range(6000).selectExpr("cast(id % 97 as double) x")
    got = rows(distribution.numeric_stats(df))[0]
    assert got["normality_test"] == "D'Agostino-Pearson"
    assert "large_sample" in [r["code"] for r in rows(distribution.distribution_notes(df))]
    with pytest.raises(ValueError, match="5000"):
        distribution.shapiro(df)


def test_shapiro_is_asked_for(frame, beds):
    got = by(distribution.shapiro(frame(beds), ["height", "weight"]))
    assert set(got) == {"height", "weight"}
    assert got["weight"]["pvalue"] < 1e-6 < got["height"]["w"] <= 1


def test_shapiro_w_has_no_row_limit(frame):
    rng = np.random.default_rng(4)
    few = {"hot": [3.0] * 700 + list(rng.normal(size=300)), "even": list(rng.normal(size=990)) + [None] * 10,
           "one": [2.0] * 1000, "scant": [1.0, 2.0] + [None] * 998}
    got = by(distribution.shapiro(frame(few)))
    assert set(got) == {"hot", "even", "one"} and got["one"]["w"] == 1.0
    for c in ("hot", "even"):
        w, p = shapiro_wilk(np.array([v for v in few[c] if v is not None]))
        assert got[c]["w"] == pytest.approx(w, abs=1e-10) and got[c]["pvalue"] == pytest.approx(p, abs=1e-8)
    many = frame({"x": np.exp(rng.normal(size=6000)).round(1)})
    found = by(distribution.shapiro(many, max_rows=None))["x"]
    assert found["w"] == pytest.approx(shapiro_wilk(many.toPandas()["x"].to_numpy())[0], abs=1e-10)
    assert found["pvalue"] is None
    # Ranges and parts of copies of any size give the same W.
    means = {"x": float(many.toPandas()["x"].mean())}
    again = shapiro_w(many, ["x"], {"x": 6000}, means, bucket_rows=100, copies=7)
    assert again["x"] == pytest.approx(found["w"], abs=1e-10)


def test_normal_quantile(spark):
    p = [1e-300, 1e-12, 1e-5, 0.01, 0.075, 0.3, 0.5, 0.7, 0.93, 0.99999]
    df = spark.createDataFrame([(v,) for v in p], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in df.collect():
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-15)


def test_categories(frame):
    df = frame({"c": ["x"] * 5 + ["y"] * 5 + [None] * 2, "b": [True] * 12,
                "d": pd.date_range("2024-01-01", periods=12)})
    got = by(distribution.categorical_stats(df))
    assert got["c"]["entropy"] == pytest.approx(1.0) and got["c"]["mode"] == "x"
    assert got["c"]["top_values"][1] == {"value": "y", "count": 5, "share": 0.5}
    assert got["b"]["entropy"] == 0.0 and got["b"]["mode"] == "True"
    assert got["d"]["unique_count"] == 12
    codes = {(r["column"], r["code"]) for r in rows(distribution.distribution_notes(df))}
    assert ("b", "single_category") in codes and ("c", "small_sample") in codes


def test_bounded_probability_and_repartition_change_nothing(frame, gappy):
    df = frame(gappy)
    first = sorted(map(repr, rows(distribution.numeric_stats(df).drop("mean", "std", "variance",
        "cv", "skewness", "excess_kurtosis", "normality_pvalue", "notes"))))
    second = sorted(map(repr, rows(distribution.numeric_stats(df.repartition(7)).drop("mean",
        "std", "variance", "cv", "skewness", "excess_kurtosis", "normality_pvalue",
        "notes"))))
    assert first == second


# Missingness


def test_missing_tables(frame, gappy):
    df = frame(gappy)
    got = by(missing.missing_columns(df))
    assert got["height"]["missing_count"] == 36 and got["fenced"]["missing_pct"] == 0
    total = rows(missing.missing_summary(df))[0]
    assert total["total_missing"] == 126
    assert total["complete_rows"] == len(gappy.dropna())
    found = {tuple(r["missing"]): r["row_count"] for r in rows(missing.missing_patterns(df))}
    mask = gappy[["height", "weight"]].isna()
    assert found[("height", "weight")] == int((mask["height"] & mask["weight"]).sum())
    assert sum(found.values()) == int(mask.any(axis=1).sum())


def test_joint_missing_needs_half_of_the_rows(frame):
    a = [None] * 6 + [1.0] * 4
    df = frame(pd.DataFrame({"a": a, "b": a, "c": [None] * 4 + [1.0] * 6}, dtype=float))
    assert [tuple(r.values()) for r in rows(missing.correlated_missing(df))] == [("a", "b", 0.6)]


def test_no_gaps_no_patterns(frame, beds):
    assert rows(missing.missing_patterns(frame(beds))) == []


# Outliers


def test_each_rule_equals_its_definition(frame):
    x = np.random.default_rng(31).standard_t(2, size=400)
    got = rows(outlier.outliers(frame({"x": x})))[0]
    q1, median, q3 = np.percentile(x, [25, 50, 75])
    away = np.abs(x - median)
    for count, flags in (
        ("iqr_count", (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))),
        ("iqr_extreme_count", (x < q1 - 3 * (q3 - q1)) | (x > q3 + 3 * (q3 - q1))),
        ("zscore_count", np.abs(x - x.mean()) > 3 * x.std(ddof=1)),
        ("mzscore_count", 0.6745 * away / np.median(away) > 3.5),
    ):
        assert got[count] == flags.sum() > 0
    assert got["iforest_count"] is None


def test_outlier_edge_cases(frame):
    got = by(outlier.outliers(frame({"few": [1.0, 2.0, 3.0] + [np.nan] * 27,
                                     "flat": [1.0] * 29 + [9.0]})))
    assert got["few"]["iqr_count"] == 0 and got["few"]["notes"] == []
    assert got["flat"]["mzscore_count"] == 0 and got["flat"]["zscore_count"] == 1
    assert any("median deviation is 0" in n for n in got["flat"]["notes"])


def test_outlier_rows_and_points(frame):
    df = frame({"id": range(100), "x": [0.0, 1.0] * 48 + [50.0, -50.0, 60.0, 0.5]})
    found = rows(outlier.outlier_rows(df, "id", keep=2))
    assert [(r["row_id"], r["value"]) for r in found] == [(96, 50.0), (97, -50.0)]
    points = rows(chartfeed.outlier_points(df, "id"))
    assert len(points) == 100 and sum(r["is_outlier"] for r in points) == 3


# Correlation


def test_strong_pairs_equal_numpy(frame):
    rng = np.random.default_rng(32)
    x = rng.uniform(size=(150, 4))
    x[:, 1] -= 2 * x[:, 0]
    x[:, 3] += 0.55 * x[:, 2]
    df = frame(pd.DataFrame(x, columns=list("klmn")))
    r = np.corrcoef(x.T)
    want = {("klmn"[i], "klmn"[j]): r[i, j] for i in range(4) for j in range(i + 1, 4)}
    for threshold in (0.3, 0.7):
        found = {(f["col_a"], f["col_b"]): f for f in rows(correlation.strong_pairs(df, threshold))}
        assert set(found) == {k for k, v in want.items() if abs(v) >= threshold}
        for k, f in found.items():
            assert f["r"] == pytest.approx(want[k])
            assert f["label"] == ("strong positive" if want[k] > 0 else "strong negative")


def test_many_columns_are_one_pass(frame):
    rng = np.random.default_rng(33)
    x = rng.normal(size=(90, 15)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"c{k}" for k in range(15)]
    got = {(r["row"], r["col"]): r["value"] for r in rows(correlation.pearson_matrix(frame(pd.DataFrame(x, columns=names))))}
    want = pd.DataFrame(x, columns=names).corr()
    assert all(v == pytest.approx(want.loc[a, b], abs=1e-7) for (a, b), v in got.items())


def test_monotone_change_keeps_spearman(frame, beds):
    df = frame(pd.DataFrame({"a": beds["height"], "b": np.exp(beds["height"] / 10)}))
    got = {(r["row"], r["col"]): r["value"] for r in rows(correlation.spearman_matrix(df))}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "a"] == 1.0


def test_one_number_has_no_matrix(frame):
    df = frame({"a": [1, 2, 3], "c": ["x", "y", "z"]})
    assert rows(correlation.pearson_matrix(df)) == [] == rows(correlation.cramers_matrix(df))


def test_point_biserial(frame, beds):
    got = {r["num_col"]: r for r in rows(correlation.point_biserial(frame(beds)))}
    y = (beds["fenced"] == "yes").astype(float)
    assert got["height"]["r"] == pytest.approx(np.corrcoef(beds["height"], y)[0, 1])
    assert {r["bin_col"] for r in got.values()} == {"fenced"}


def test_inflation_factors(frame):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:, 2] += x[:, 0] + x[:, 1]
    pdf = pd.DataFrame(x, columns=list("abc"))
    got = by(correlation.vif(frame(pdf)))
    inverse = np.linalg.inv(np.corrcoef(x.T))
    for k, c in enumerate("abc"):
        assert got[c]["vif"] == pytest.approx(inverse[k, k])
    pdf["d"] = 2 * pdf["a"] - pdf["b"]
    pdf["e"] = 5.0
    got = by(correlation.vif(frame(pdf)))
    assert got["d"]["vif"] == np.inf and got["e"]["vif"] is None
    assert np.isfinite(got["c"]["vif"])
    assert Profile(frame(pdf.head(20))).vif is None  # fewer than ten rows a column


# Target


def test_numeric_target(frame):
    rng = np.random.default_rng(3)
    a = rng.normal(size=150)
    pdf = pd.DataFrame({"a": a, "b": rng.normal(size=150), "kind": np.where(a > 0, "u", "v"),
                        "many": rng.choice(list("abc"), 150), "const": 1.0,
                        "price": 3 * a + rng.normal(0, 0.1, 150)})
    found = rows(target.feature_table(frame(pdf), "price"))
    assert [r["feature"] for r in found[:2]] == ["a", "kind"]
    assert found[0]["method"] == "pearson" and found[1]["method"] == "point_biserial"
    assert found[1]["direction"] == "negative"
    assert found[-1]["feature"] == "const" and found[-1]["score"] is None
    assert "many" not in [r["feature"] for r in found]


def test_class_targets(frame, beds):
    df = frame(beds)
    two = by(target.feature_table(df, "fenced"), "feature")
    assert two["height"]["method"] == "point_biserial" and two["soil"]["method"] == "cramers_v"
    three = by(target.feature_table(df, "soil"), "feature")
    groups = [g["height"].to_numpy() for _, g in beds.groupby("soil")]
    mean = beds["height"].mean()
    between = sum(len(g) * (g.mean() - mean) ** 2 for g in groups)
    total = ((beds["height"] - mean) ** 2).sum()
    assert three["height"]["score"] == pytest.approx(between / total)
    assert target.target_type(frame({"t": [True, False]}), "t") == "numeric"


def test_perfect_separation_scores_one(frame):
    df = frame({"x": [1.0] * 10 + [2.0] * 10 + [3.0] * 10, "k": list("a" * 10 + "b" * 10 + "c" * 10)})
    assert rows(target.feature_table(df, "k"))[0]["score"] == pytest.approx(1.0)


def test_unknown_target(frame, beds):
    with pytest.raises(ValueError, match="no column 'nothing'"):
        target.feature_table(frame(beds), "nothing")


def test_target_notes(frame):
    rng = np.random.default_rng(4)
    spread = np.repeat([1.0, 1.0, 30.0], 100)
    pdf = pd.DataFrame({"x": rng.normal(0, spread), "k": np.repeat(["a", "b", "c"], 100)})
    pdf.loc[300] = [0.0, "d"]
    codes = [r["code"] for r in rows(target.target_notes(frame(pdf), "k"))]
    assert codes == ["unequal_variances", "small_classes"]
    skewed = frame({"t": rng.lognormal(0, 2, 200)})
    assert [r["code"] for r in rows(target.target_notes(skewed, "t"))] == ["skewed_target"]


# Drift


def test_drift_verdicts(frame):
    rng = np.random.default_rng(34)

    def batch(n: int, swell: float, kinds: str) -> pd.DataFrame:
        return pd.DataFrame({"still": rng.logistic(3, 2, n), "swell": rng.logistic(0, swell, n),
                             "kind": rng.choice(list(kinds), n)})

    ref = frame(batch(700, 1.0, "pqr"))
    calm = drift.Drift(ref, frame(batch(600, 1.0, "pqr")))
    assert rows(calm.summary())[0]["drifted_count"] == 0
    d = drift.Drift(ref, frame(batch(600, 4.0, "pqs")))
    assert [c for c, r in d.columns().items() if r.drift_detected] == ["kind", "swell"]
    assert d.columns()["swell"].ks_pvalue < 0.001
    assert rows(d.summary())[0]["overall_drift"] and by(drift.compare(ref, ref))["swell"]["psi"] == 0.0


def test_values_outside_the_reference_are_dropped(frame):
    ref, cur = frame({"a": np.arange(100.0)}), frame({"a": np.arange(1000.0, 1100.0)})
    assert drift.Drift(ref, cur).columns()["a"].drift_severity == "none"
    assert drift.Drift(ref, cur, open_ended=True).columns()["a"].drift_severity == "high"


def test_psi_bins_equal_numpy(frame):
    rng = np.random.default_rng(6)
    ref, cur = rng.normal(size=600), rng.normal(0.4, 1.2, 500)
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    shares = [np.clip(np.histogram(x, edges)[0] / np.histogram(x, edges)[0].sum(), 1e-6, None)
              for x in (ref, cur)]
    expected = np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0]))
    got = drift.Drift(frame({"a": ref}), frame({"a": cur})).columns()["a"]
    assert got.psi == pytest.approx(expected, rel=1e-9)
    assert got.drift_severity == ("none" if expected < 0.1 else "moderate")


def test_column_changes_and_short_columns(frame):
    ref = frame({"a": [1.0, 2, 3], "b": [1.0, 2, 3], "n": [1.0, 2, 3]})
    cur = frame({"a": [1.0, 2, 3], "c": [1.0, 2, 3], "n": ["x", "y", "z"]})
    d = drift.Drift(ref, cur)
    assert [tuple(r.values()) for r in rows(d.column_changes())] == [
        ("b", "missing_in_current", 3, 3), ("c", "new_in_current", 3, 3),
    ]
    assert d.columns()["a"].psi is None and d.columns()["n"].col_type == "type_mismatch"


def test_lower_threshold_never_finds_less(frame):
    rng = np.random.default_rng(7)
    ref, cur = frame({"x": rng.normal(0, 1, 300)}), frame({"x": rng.normal(0.5, 1, 300)})
    low, high = (rows(drift.Drift(ref, cur, t).summary())[0]["drift_fraction"] for t in (0.05, 0.5))
    assert low >= high


# Summary and feeds


def test_key_issues_order(frame):
    n = 100
    df = frame({"const": [1] * n, "gap": [np.nan] * 30 + [3.0, 1.0, 4.0, 1.0, 5.0] * 14,
                "id": range(n)})
    got = rows(summary.key_issues(df))
    assert [r["tier"] for r in got][:2] == [1, 3] and got[0]["column"] == "const"
    assert [r["column"] for r in got if r["code"] == "key_like"] == ["id"]
    assert len(rows(summary.key_issues(df, keep=1))) == 1
    glance = rows(summary.at_a_glance(df, "id"))[0]
    assert (glance["rows"], glance["columns"], glance["target"]) == (100, 3, "id")


def test_histogram_equals_numpy(frame, gappy):
    pdf = gappy.assign(die=np.arange(240) % 6)
    got = rows(chartfeed.histograms(frame(pdf)))
    for c, bins in (("height", 30), ("weight", 30), ("die", 6)):
        expected, edges = np.histogram(pdf[c].dropna(), bins=bins)
        mine = sorted((r for r in got if r["column"] == c), key=lambda r: r["bin"])
        assert [r["count"] for r in mine] == list(expected)
        assert [r["low"] for r in mine] == pytest.approx(list(edges[:-1]))


def test_constant_column_histogram(frame):
    got = rows(chartfeed.histograms(frame({"x": [4.0] * 3})))
    assert [(r["low"], r["high"], r["count"]) for r in got] == [(3.5, 4.5, 3)]


def test_overlays(frame):
    rng = np.random.default_rng(8)
    ref = frame({"x": rng.normal(0, 1, 200), "k": ["a", "b"] * 100})
    cur = frame({"x": rng.normal(2, 1, 100), "k": ["b", "c"] * 50})
    d = drift.Drift(ref, cur)
    shared = rows(chartfeed.drift_overlay(d))
    assert len(shared) == 25
    assert (sum(r["reference"] for r in shared), sum(r["current"] for r in shared)) == (200, 100)
    for side in ("reference", "current"):
        area = sum(r["density"] * (r["high"] - r["low"])
                   for r in rows(chartfeed.density_overlay(d)) if r["side"] == side)
        assert area == pytest.approx(1.0)
    shares = by(chartfeed.category_overlay(d, "k"), "category")
    assert shares["a"] == {"category": "a", "reference": 0.5, "current": 0.0}
    calm = drift.Drift(ref, ref)
    assert rows(chartfeed.drift_overlay(calm)) == []


def test_class_and_grid_feeds(frame, beds):
    df = frame(beds)
    boxes = {(r["class"], r["feature"]): r for r in rows(chartfeed.class_boxes(df, "soil"))}
    expected = beds.loc[beds["soil"] == "loam", "height"].quantile(0.75)
    assert boxes["loam", "height"]["p75"] == pytest.approx(expected)
    bins = rows(chartfeed.class_histograms(df, "soil"))
    assert sum(r["count"] for r in bins if r["feature"] == "height") == 240
    grid = rows(chartfeed.target_grid(df, "shade"))
    assert sum(r["count"] for r in grid if r["feature"] == "height") == 240
