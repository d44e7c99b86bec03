"""The registered queries: one Spark result per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprofile.functions.columns import small_table
from lakeprofile.plans import (
    analysis, chartfeed, contract, correlation, distribution, drift, health, missing, outlier,
    quality, summary, target,
)
from lakeprofile.plans.profile import Profile
from lakeprofile.sources import delimited
from lakeprofile.sources.delimited import infer_types
from lakeprofile.sources.load import drop_columns, sample_rows
from lakeprofile.sources.sink import json_safe
from registered.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 6, **by_column: int) -> DataFrame:
    """Doubles rounded, as the two engines add in a different order."""
    return df.select(*[
        F.round(F.col(f.name), by_column.get(f.name, digits)).alias(f.name)
        if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


# Overview and quality


@register
def overview_orders(spark, sf_dir):
    return quality.overview(table(spark, sf_dir, "orders")).drop("dtype")


@register
def overview_gaps(spark, sf_dir):
    return quality.overview(table(spark, sf_dir, "gaps")).drop("dtype")


@register
def quality_issues_messy(spark, sf_dir):
    return rounded(quality.quality_issues(table(spark, sf_dir, "messy")).drop("note"))


@register
def quality_issues_all_text(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderstatus", F.col("o_orderpriority").alias("priority?")
    )
    return rounded(quality.quality_issues(df).drop("note"))


@register
def quality_status_messy(spark, sf_dir):
    return quality.quality_status(table(spark, sf_dir, "messy"))


@register
def duplicate_rows_copies(spark, sf_dir):
    return rounded(quality.duplicate_summary(table(spark, sf_dir, "copies")))


@register
def duplicate_rows_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("text", "lang")
    return rounded(quality.duplicate_summary(df))


# Distribution


def _numeric(df: DataFrame) -> DataFrame:
    stats = distribution.numeric_stats(df).drop("notes")
    return rounded(stats, 6, mean=4, std=4, variance=2)


@register
def numeric_stats_lineitem(spark, sf_dir):
    return _numeric(table(spark, sf_dir, "lineitem"))


def _shapiro(df: DataFrame) -> DataFrame:
    return rounded(distribution.shapiro(df, max_rows=None).drop("pvalue"), 8)


@register
def shapiro_lineitem(spark, sf_dir):
    return _shapiro(table(spark, sf_dir, "lineitem"))


@register
def shapiro_gaps(spark, sf_dir):
    return _shapiro(table(spark, sf_dir, "gaps"))


@register
def numeric_stats_gaps(spark, sf_dir):
    return _numeric(table(spark, sf_dir, "gaps"))


@register
def numeric_stats_events(spark, sf_dir):
    return _numeric(table(spark, sf_dir, "events").select("value", "user_id"))


@register
def distribution_notes_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", "event_type", "props")
    return distribution.distribution_notes(df).select("column", "code")


@register
def distribution_notes_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("c_debt", F.col("c_acctbal") - 9000)
    return distribution.distribution_notes(df.drop("c_custkey")).select("column", "code")


@register
def normality_supplier(spark, sf_dir):
    return rounded(distribution.normality_table(table(spark, sf_dir, "supplier")))


@register
def numeric_stats_money(spark, sf_dir):
    """Decimals, with ties for the mode."""
    return _numeric(table(spark, sf_dir, "money"))


def _categorical(df: DataFrame) -> DataFrame:
    stats = distribution.categorical_stats(df).drop("notes")
    top = F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"].cast("string")))
    return rounded(stats.withColumn("top_values", F.array_join(top, ",")))


@register
def categorical_stats_orders(spark, sf_dir):
    return _categorical(table(spark, sf_dir, "orders"))


@register
def categorical_stats_gaps(spark, sf_dir):
    return _categorical(table(spark, sf_dir, "gaps"))


@register
def top_values_documents(spark, sf_dir):
    """Whole texts, ranked by count; long ones are grouped by digest."""
    df = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return rounded(distribution.top_values(df))


@register
def value_table_part(spark, sf_dir):
    from lakeprofile.operators.frequency import value_table

    df = table(spark, sf_dir, "part")
    return rounded(value_table(df, ["p_name", "p_brand", "p_type", "p_size"]))


# Missingness


@register
def missing_columns_gaps(spark, sf_dir):
    return rounded(missing.missing_columns(table(spark, sf_dir, "gaps")))


@register
def missing_summary_gaps(spark, sf_dir):
    return rounded(missing.missing_summary(table(spark, sf_dir, "gaps")))


@register
def missing_patterns_gaps(spark, sf_dir):
    found = missing.missing_patterns(table(spark, sf_dir, "gaps"))
    return rounded(found.withColumn("missing", F.array_join("missing", ",")))


@register
def joint_missing_gaps(spark, sf_dir):
    return rounded(missing.correlated_missing(table(spark, sf_dir, "gaps")))


# Outliers


@register
def outliers_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("value", "user_id")
    return rounded(outlier.outliers(df).drop("notes", "iforest_count", "iforest_pct"))


@register
def outliers_messy(spark, sf_dir):
    found = outlier.outliers(table(spark, sf_dir, "messy"))
    return rounded(found.drop("notes", "iforest_count", "iforest_pct"))


@register
def outlier_notes_messy(spark, sf_dir):
    return outlier.outlier_note_table(table(spark, sf_dir, "messy")).select("column", "code")


@register
def outlier_rows_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value", "user_id")
    return outlier.outlier_rows(df, "event_id")


@register
def isolation_forest_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("value")
    found = outlier.outliers(df, outlier.Rules(use_iforest=True))
    return found.select("column", "iforest_count", "iforest_pct")


# Correlation


@register
def pearson_lineitem(spark, sf_dir):
    return rounded(correlation.pearson_matrix(table(spark, sf_dir, "lineitem")))


@register
def pearson_gaps(spark, sf_dir):
    return rounded(correlation.pearson_matrix(table(spark, sf_dir, "gaps")))


@register
def spearman_lineitem(spark, sf_dir):
    return rounded(correlation.spearman_matrix(table(spark, sf_dir, "lineitem")))


@register
def spearman_gaps(spark, sf_dir):
    return rounded(correlation.spearman_matrix(table(spark, sf_dir, "gaps")))


@register
def strong_pairs_related(spark, sf_dir):
    return rounded(correlation.strong_pairs(table(spark, sf_dir, "related")))


@register
def spearman_holes(spark, sf_dir):
    """Six columns with gaps: every pair has ranks of its own."""
    return rounded(correlation.spearman_matrix(table(spark, sf_dir, "holes")))


@register
def pearson_wide(spark, sf_dir):
    """More columns than one aggregate takes."""
    return rounded(correlation.pearson_matrix(table(spark, sf_dir, "wide")))


@register
def cramers_v_orders(spark, sf_dir):
    return rounded(correlation.cramers_matrix(table(spark, sf_dir, "orders")))


@register
def cramers_v_gaps(spark, sf_dir):
    return rounded(correlation.cramers_matrix(table(spark, sf_dir, "gaps")))


@register
def point_biserial_related(spark, sf_dir):
    df = table(spark, sf_dir, "related").drop("l_returnflag")
    return rounded(correlation.point_biserial(df))


@register
def vif_mixture(spark, sf_dir):
    df = table(spark, sf_dir, "related").select("l_quantity", "cubed", "shifted")
    return rounded(correlation.vif(df), 4)


@register
def vif_gaps(spark, sf_dir):
    df = table(spark, sf_dir, "gaps").select("o_orderkey", "price", "cust")
    return rounded(correlation.vif(df), 6)


@register
def correlation_notes_curved(spark, sf_dir):
    df = table(spark, sf_dir, "curved")
    return correlation.correlation_notes(df).select("code", "subject")


# Target association


@register
def target_numeric_related(spark, sf_dir):
    return rounded(target.feature_table(table(spark, sf_dir, "related"), "shifted"))


@register
def target_binary_related(spark, sf_dir):
    return rounded(target.feature_table(table(spark, sf_dir, "related"), "l_linestatus"))


@register
def target_classes_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    return rounded(target.feature_table(df, "l_returnflag"), 9)


@register
def target_classes_shifted(spark, sf_dir):
    """Large numbers that lie close together, as times and keys do."""
    df = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", (F.col("l_quantity") + 1.7e9).alias("late"), (F.col("l_partkey") + 1.7e9).alias("key")
    )
    return rounded(target.feature_table(df, "l_returnflag"), 6)


@register
def target_top_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return rounded(target.feature_table(df, "o_orderpriority", top=3))


@register
def levene_lineitem(spark, sf_dir):
    return rounded(target.levene_table(table(spark, sf_dir, "lineitem"), "l_returnflag"))


@register
def class_sizes_documents(spark, sf_dir):
    return rounded(target.class_sizes(table(spark, sf_dir, "documents"), "source"))


@register
def small_classes_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    df = df.withColumn("ward", F.concat("c_mktsegment", F.lit(" "), "c_nationkey"))
    return rounded(target.small_classes(df, "ward"))


@register
def target_notes_events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    wide = df.withColumn("spike", F.pow("value", F.lit(3.0)))
    by_class = target.target_notes(wide.select("value", "event_type"), "event_type")
    by_number = target.target_notes(wide.select("user_id", "spike"), "spike")
    return by_class.unionByName(by_number).select("code")


# Drift


def _orders_drift(spark, sf_dir) -> drift.Drift:
    return drift.Drift(table(spark, sf_dir, "orders_then"), table(spark, sf_dir, "orders_now"))


def _items_drift(spark, sf_dir) -> drift.Drift:
    return drift.Drift(table(spark, sf_dir, "items_then"), table(spark, sf_dir, "items_now"))


@register
def drift_numeric_orders(spark, sf_dir):
    found = _orders_drift(spark, sf_dir).table().where("col_type = 'numeric'")
    found = found.drop("chi2_statistic", "chi2_pvalue")
    return rounded(found, 6, mean_ref=4, mean_cur=4, std_ref=4, std_cur=4)


@register
def drift_ks_lineitem(spark, sf_dir):
    found = _items_drift(spark, sf_dir).table().where("col_type = 'numeric'")
    return rounded(found.select("column", "ks_statistic", "ks_pvalue", "psi"))


@register
def drift_categorical_orders(spark, sf_dir):
    found = _orders_drift(spark, sf_dir).table().where("col_type = 'categorical'")
    return rounded(found.select("column", "chi2_statistic", "chi2_pvalue", "drift_detected"))


@register
def drift_summary_orders(spark, sf_dir):
    found = _orders_drift(spark, sf_dir).summary()
    joined = [
        F.array_join(c, ",").alias(c)
        for c in ("drifted_columns", "missing_in_current", "new_in_current")
    ]
    rest = [c for c in found.columns if c not in
            ("drifted_columns", "missing_in_current", "new_in_current")]
    return rounded(found.select(*joined, *rest))


@register
def drift_ranked_items(spark, sf_dir):
    found = _orders_drift(spark, sf_dir).ranked().where("psi is not null")
    return rounded(found)


@register
def drift_column_changes(spark, sf_dir):
    return _orders_drift(spark, sf_dir).column_changes()


# Health audit and summary


@register
def health_findings_messy(spark, sf_dir):
    found = health.Audit(table(spark, sf_dir, "messy")).table()
    return rounded(health.by_column(found).drop("rank", "note"))


@register
def health_score_messy(spark, sf_dir):
    found = health.Audit(table(spark, sf_dir, "messy")).score()
    return found.withColumn("worst_categories", F.array_join("worst_categories", ","))


@register
def health_findings_copies(spark, sf_dir):
    found = health.Audit(table(spark, sf_dir, "copies")).table()
    return rounded(health.by_column(found).drop("rank", "note"))


@register
def health_findings_region(spark, sf_dir):
    """Few rows, text only, and a name with a special character."""
    df = table(spark, sf_dir, "region")
    df = df.select(F.col("r_name").alias("name?"), F.substring("r_name", 1, 2).alias("short"))
    found = health.Audit(df).table()
    return rounded(health.by_column(found).drop("rank", "note"))


@register
def health_categories_messy(spark, sf_dir):
    return health.Audit(table(spark, sf_dir, "messy")).categories()


@register
def health_redundancy_related(spark, sf_dir):
    found = health.Audit(table(spark, sf_dir, "related"), skip_outlier=True).table()
    found = found.where("category = 'Redundancy'")
    return health.by_column(found).select("check", "severity", "columns")


@register
def health_target_risks(spark, sf_dir):
    df = table(spark, sf_dir, "messy").drop("blank")
    parts = [
        health.Audit(df, t, skip_correlation=True, skip_outlier=True).table().withColumn(
            "target", F.lit(t)
        )
        for t in ("half_empty", "outcome")
    ]
    found = parts[0].unionByName(parts[1]).where("category = 'Target Risks'")
    return health.by_column(found).select("target", "check", "severity", "columns")


@register
def key_issues_gaps(spark, sf_dir):
    return rounded(summary.key_issues(table(spark, sf_dir, "gaps")).drop("note"))


@register
def key_issues_shifted(spark, sf_dir):
    """Repeated rows and inflated variances."""
    df = table(spark, sf_dir, "related").select("l_quantity", "cubed", "shifted")
    return rounded(summary.key_issues(df, keep=None).drop("note"), 4)


@register
def key_issue_candidates_messy(spark, sf_dir):
    df = table(spark, sf_dir, "messy")
    rows = [issue[:3] for issue in summary.issue_list(df)]
    return rounded(small_table(spark, rows, "tier bigint, magnitude double, column string"), 4)


@register
def at_a_glance_copies(spark, sf_dir):
    return rounded(summary.at_a_glance(table(spark, sf_dir, "copies"), "o_orderstatus"))


# Contracts


@register
def contract_rules_customer(spark, sf_dir):
    rules = contract.rule_table(spark, contract.infer(table(spark, sf_dir, "customer")))
    return rounded(rules.withColumn("allowed_values", F.array_join("allowed_values", ",")))


@register
def contract_rules_gaps(spark, sf_dir):
    rules = contract.rule_table(spark, contract.infer(table(spark, sf_dir, "gaps")))
    return rounded(rules.withColumn("allowed_values", F.array_join("allowed_values", ",")))


@register
def contract_global_copies(spark, sf_dir):
    inferred = contract.infer(table(spark, sf_dir, "copies"), "copies")
    return contract.global_table(spark, inferred)


def _customer_contract(spark, sf_dir) -> contract.Contract:
    rules = contract.infer(table(spark, sf_dir, "customer"))
    rules.columns["c_phone"] = contract.ColumnRule("categorical")
    rules.columns["c_name"].dtype = "numeric"
    rules.min_rows = 2 * rules.min_rows
    return rules


@register
def contract_violations_customer(spark, sf_dir):
    found = contract.validate(
        table(spark, sf_dir, "customer_now"), _customer_contract(spark, sf_dir)
    )
    return found.select("position", "column", "check", "severity", "expected", "actual")


@register
def contract_violations_copies(spark, sf_dir):
    """Too many repeated rows, a new label and a number below its bound."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    return contract.validate(table(spark, sf_dir, "copies"), contract.infer(orders))


@register
def contract_verdict_strict(spark, sf_dir):
    rules = _customer_contract(spark, sf_dir)
    return contract.verdict(table(spark, sf_dir, "customer_now"), rules, strict=True)


@register
def contract_verdict_passing(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return contract.verdict(df, contract.infer(df))


@register
def contract_unexpected_values(spark, sf_dir):
    rules = _customer_contract(spark, sf_dir)
    return contract.unexpected_values(table(spark, sf_dir, "customer_now"), rules)


# Chart feeds


@register
def histograms_lineitem(spark, sf_dir):
    return rounded(chartfeed.histograms(table(spark, sf_dir, "lineitem")))


@register
def histograms_gaps(spark, sf_dir):
    return rounded(chartfeed.histograms(table(spark, sf_dir, "gaps")))


@register
def box_stats_gaps(spark, sf_dir):
    return rounded(chartfeed.box_stats(table(spark, sf_dir, "gaps")), 4)


@register
def value_bars_gaps(spark, sf_dir):
    df = table(spark, sf_dir, "gaps").drop("o_orderdate")
    return chartfeed.value_bars(df)


@register
def heatmap_related(spark, sf_dir):
    df = table(spark, sf_dir, "related")
    return rounded(chartfeed.heatmap(df, "pearson"))


@register
def missing_bars_gaps(spark, sf_dir):
    return chartfeed.missing_bars(table(spark, sf_dir, "gaps"))


@register
def shown_missing_gaps(spark, sf_dir):
    return rounded(chartfeed.shown_missing(table(spark, sf_dir, "gaps")))


@register
def shown_joint_missing_gaps(spark, sf_dir):
    return rounded(chartfeed.shown_joint_missing(table(spark, sf_dir, "gaps")))


@register
def shown_strong_pairs_related(spark, sf_dir):
    df = table(spark, sf_dir, "related").select("l_quantity", "cubed", "shifted", "mixture")
    return rounded(chartfeed.shown_strong_pairs(df))


@register
def outlier_bars_messy(spark, sf_dir):
    return chartfeed.outlier_bars(table(spark, sf_dir, "messy"))


@register
def outlier_points_events(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(chartfeed.outlier_points(df, "event_id"))


@register
def drift_overlay_orders(spark, sf_dir):
    return rounded(chartfeed.drift_overlay(_orders_drift(spark, sf_dir)), 4)


@register
def density_overlay_orders(spark, sf_dir):
    return rounded(chartfeed.density_overlay(_orders_drift(spark, sf_dir)), 4, density=9)


@register
def category_overlay_orders(spark, sf_dir):
    found = chartfeed.category_overlay(_orders_drift(spark, sf_dir), "o_orderpriority")
    return rounded(found)


@register
def class_boxes_related(spark, sf_dir):
    df = table(spark, sf_dir, "related").select("shifted", "cubed", "l_returnflag")
    return rounded(chartfeed.class_boxes(df, "l_returnflag"))


@register
def class_histograms_related(spark, sf_dir):
    df = table(spark, sf_dir, "related").select("shifted", "cubed", "l_returnflag")
    return rounded(chartfeed.class_histograms(df, "l_returnflag"))


@register
def target_grid_related(spark, sf_dir):
    df = table(spark, sf_dir, "related").select("shifted", "mixture", "l_extendedprice")
    return rounded(chartfeed.target_grid(df, "l_extendedprice"))


# Sources, preparation and sinks


@register
def typed_cells(spark, sf_dir):
    typed = infer_types(table(spark, sf_dir, "cells"), ["day"])
    return typed.withColumn("day", F.col("day").cast("date").cast("string"))


LINE_NAMES = ["key", "label", "price", "day"]


@register
def parsed_lines_orders(spark, sf_dir):
    """Lines with a key of 19 digits and quoted delimiters, whose delimiter is found out."""
    lines = table(spark, sf_dir, "lines").select("value")
    typed = delimited.infer_types(delimited.split_lines(lines, LINE_NAMES), ["day"])
    return rounded(typed.withColumn("day", F.col("day").cast("date").cast("string")))


@register
def line_delimiters_orders(spark, sf_dir):
    return delimited.best_delimiter(table(spark, sf_dir, "lines"), ["part"])


@register
def long_lines_orders(spark, sf_dir):
    """Lines with a cell too many."""
    lines = table(spark, sf_dir, "ragged").select("value")
    return delimited.long_lines(lines, LINE_NAMES)


@register
def typed_cells_schema(spark, sf_dir):
    typed = infer_types(table(spark, sf_dir, "cells"), ["day"])
    rows = [(f.name, f.dataType.simpleString()) for f in typed.schema.fields]
    return small_table(spark, rows, "column string, type string")


@register
def drop_columns_orders(spark, sf_dir):
    df = drop_columns(table(spark, sf_dir, "orders"), ["o_orderdate", "o_custkey", "nothing"])
    return df


@register
def sample_rows_orders(spark, sf_dir):
    """An exact-size sample; every sampled row is a row of the table, and a new layout changes
    nothing."""
    orders = table(spark, sf_dir, "orders")
    picked = sample_rows(orders, 500).intersect(sample_rows(orders.repartition(3), 500))
    return picked.join(orders.select("o_orderkey"), "o_orderkey", "left_semi").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys")
    )


@register
def json_safe_numbers(spark, sf_dir):
    return rounded(json_safe(table(spark, sf_dir, "odd_numbers")))


@register
def profile_many_status(spark, sf_dir):
    """Several tables at once; the empty one fails its gate and stops nobody."""
    names = ["region", "nation", "supplier"]
    tables = {n: table(spark, sf_dir, n) for n in names}
    tables["nobody"] = table(spark, sf_dir, "supplier").where("s_suppkey < 0")
    sections, status = analysis.profile_many(tables, skip_correlation=True, skip_outlier=True)
    rows = sections["overview"].groupBy("dataset").agg(
        F.count(F.lit(1)).alias("columns"), F.max("rows").alias("rows")
    )
    return status.select("dataset", "status").join(rows, "dataset", "left")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution statistics of every numeric column of the line items."""
    return distribution.flatten(distribution.numeric_stats(Profile(table(spark, sf_dir, "lineitem"))))
