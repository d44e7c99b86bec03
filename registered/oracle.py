"""Oracle SQL of the registered queries, written from the definitions of the statistics."""

from __future__ import annotations

from itertools import combinations

from lakeprofile.functions.pvalues import NORMAL_CENTRE, NORMAL_FAR, NORMAL_TAIL
from registered.tables import oracle_table as T

ORACLE: dict[str, str] = {}

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
GAPS = ["o_orderkey", "price", "cust", "priority", "status", "o_orderdate"]
GAP_NUMBERS = ["o_orderkey", "price", "cust"]
RELATED = ["l_quantity", "l_extendedprice", "l_discount", "cubed", "mixture", "negative",
           "shifted"]
MESSY_NUMBERS = ["id", "price", "price_copy", "price_near", "fixed", "half_empty", "thin", "blank",
                 "wild"]
MESSY_TEXTS = ["cust_text", "day_text", "nearly", "label", "priority", "mixed", "outcome"]
MESSY = [
    "id", "price", "price_copy", "price_near", "cust_text", "day_text", "fixed", "nearly", "label",
    "priority", "mixed", "half_empty", "thin", "blank", "wild", "outcome",
]


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def missing_of(table: str, columns: list[str]) -> str:
    """(column, total, n, nulls) per column."""
    return union([
        f"SELECT '{c}' AS \"column\", count(*) AS total, count({c}) AS n,"
        f" count(*) - count({c}) AS nulls FROM {T(table)}"
        for c in columns
    ])


# Overview and quality


def overview(table: str, sizes: dict[str, str]) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null,"
        f" round(100.0 * (count(*) - count({c})) / count(*), 2) AS null_pct,"
        f" CAST(sum({size}) AS BIGINT) AS bytes FROM {T(table)}"
        for c, size in sizes.items()
    ])


ORACLE["overview_orders"] = overview("orders", {
    "o_orderkey": "8", "o_custkey": "8", "o_orderstatus": "strlen(o_orderstatus)",
    "o_totalprice": "8", "o_orderdate": "8", "o_orderpriority": "strlen(o_orderpriority)",
})
ORACLE["overview_gaps"] = overview("gaps", {
    "o_orderkey": "8", "price": "8", "cust": "8", "priority": "strlen(priority)",
    "status": "strlen(status)", "o_orderdate": "8",
})

NUMBER = "(try_cast(trim({c}) AS DOUBLE) IS NOT NULL AND NOT isnan(try_cast(trim({c}) AS DOUBLE)))"


def number_share(column: str, per: str = "count(*)") -> str:
    return f"CAST(count(*) FILTER ({NUMBER.format(c=column)}) AS DOUBLE) / {per}"


ORACLE["quality_issues_messy"] = f"""
SELECT * FROM (
SELECT 'High missing: ' || "column" AS "check", 'WARNING' AS severity, "column",
       round(nulls / total, 6) AS value
FROM ({missing_of("messy", MESSY)}) WHERE nulls > 0.9 * total
UNION ALL
SELECT 'Mixed types: ' || "column", 'WARNING', "column", round(share, 6)
FROM ({union([f'''SELECT '{c}' AS "column", {number_share(c)} AS share FROM {T("messy")}'''
              for c in MESSY_TEXTS])})
WHERE share > 0.01 AND share < 0.99)"""

ORACLE["quality_issues_all_text"] = """
WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
     d AS (SELECT sum(n - 1) AS copies, sum(n) AS total FROM g)
SELECT 'All-object dtypes' AS "check", 'WARNING' AS severity, '' AS "column",
       CAST(2 AS DOUBLE) AS value
UNION ALL
SELECT 'Special chars in column names', 'INFO', '', 1
UNION ALL
SELECT 'High duplicates', 'WARNING', '', round(copies / total, 6)
FROM d WHERE copies > 0.5 * total"""

ORACLE["quality_status_messy"] = f"""
SELECT CASE WHEN count(*) FILTER (severity = 'WARNING') > 0 THEN 'PASSED WITH WARNINGS'
            ELSE 'PASSED' END AS status,
       CAST(0 AS BIGINT) AS fatal, count(*) FILTER (severity = 'WARNING') AS warnings,
       count(*) FILTER (severity = 'INFO') AS infos
FROM ({ORACLE["quality_issues_messy"]})"""


def duplicates(table: str, columns: str) -> str:
    return f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
       round(sum(n - 1) / sum(n), 6) AS duplicate_share
FROM (SELECT {columns}, count(*) AS n FROM {T(table)} GROUP BY ALL)"""


ORACLE["duplicate_rows_copies"] = duplicates("copies", "o_custkey, o_orderstatus, o_totalprice")
ORACLE["duplicate_rows_documents"] = duplicates("documents", "text, lang")

# Distribution


def moments(table: str, columns: list[str]) -> str:
    """Unrounded statistics per column, from centred powers and sorted values."""
    return union([
        f"""
SELECT '{c}' AS "column", count(x) AS n, count(*) AS total, avg(x) AS mean,
       quantile_cont(x, 0.5) AS med, stddev_samp(x) AS sd, var_samp(x) AS var,
       min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25,
       quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95,
       CASE WHEN min(x) < max(x) THEN avg(d * d * d) / pow(avg(d * d), 1.5) END AS skew,
       CASE WHEN min(x) < max(x) THEN avg(d * d * d * d) / pow(avg(d * d), 2) - 3 END AS kurt,
       count(DISTINCT x) AS uniq,
       (SELECT CAST({c} AS DOUBLE) FROM {T(table)} WHERE {c} IS NOT NULL
        GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode
FROM (SELECT CAST({c} AS DOUBLE) AS x,
             CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM {T(table)}) AS d FROM {T(table)})"""
        for c in columns
    ])


def with_normality(source: str) -> str:
    """Adds the D'Agostino-Pearson p (skewness and kurtosis scores squared, two degrees)."""
    return f"""
SELECT *, exp(-(zs * zs + zk * zk) / 2) AS p FROM (
SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
       (1 - 2 / (9 * a) - sign(base) * pow(abs(base), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM (
SELECT *, (1 - 2 / a) / (1 + xk * sqrt(2 / (a - 4))) AS base FROM (
SELECT *, -1 + sqrt(2 * (b2 - 1)) AS w2,
       6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM (
SELECT *, skew * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y,
       3.0 * (CAST(n AS DOUBLE) * n + 27 * n - 70) * (n + 1) * (n + 3)
         / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2,
       (kurt + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3)
         / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))) AS xk,
       6.0 * (CAST(n AS DOUBLE) * n - 5 * n + 2) / ((n + 7.0) * (n + 9))
         * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS sb
FROM (SELECT * REPLACE (CAST(n AS DOUBLE) AS n) FROM ({source}))))))"""


def numeric_stats(table: str, columns: list[str]) -> str:
    return f"""
SELECT "column", CAST(n AS BIGINT) AS count, CAST(total - n AS BIGINT) AS null_count,
       round((total - n) / total, 6) AS null_pct, round(mean, 4) AS mean, round(med, 6) AS median,
       round(mode, 6) AS mode, round(sd, 4) AS std, round(var, 2) AS variance,
       round(sd / abs(mean), 6) AS cv, round(lo, 6) AS min, round(q05, 6) AS p5,
       round(q25, 6) AS p25, round(med, 6) AS p50, round(q75, 6) AS p75, round(q95, 6) AS p95,
       round(hi, 6) AS max, round(q75 - q25, 6) AS iqr, round(skew, 6) AS skewness,
       round(kurt, 6) AS excess_kurtosis, uniq AS unique_count,
       round(uniq / n, 6) AS unique_pct, 'D''Agostino-Pearson' AS normality_test,
       round(p, 6) AS normality_pvalue
FROM ({with_normality(moments(table, columns))})"""


ORACLE["numeric_stats_lineitem"] = numeric_stats("lineitem", LINEITEM)


def polynomial(coefficients: list[float], x: str) -> str:
    """Horner's scheme, highest power first."""
    out = f"{coefficients[0]!r}::double"
    for a in coefficients[1:]:
        out = f"({out} * {x} + {a!r}::double)"
    return out


def normal_score(p: str) -> str:
    """Wichura's normal quantile (AS 241) of a column."""
    centre, tail, far = (
        f"{polynomial(above, 'r')} / {polynomial(below, 'r')}"
        for above, below in (NORMAL_CENTRE, NORMAL_TAIL, NORMAL_FAR)
    )
    root = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425
       THEN list_transform([0.180625 - ({p} - 0.5) * ({p} - 0.5)], lambda r: ({p} - 0.5) * {centre})[1]
       WHEN {root} <= 5 THEN list_transform([{root} - 1.6], lambda r: sign({p} - 0.5) * {tail})[1]
       ELSE list_transform([{root} - 5], lambda r: sign({p} - 0.5) * {far})[1] END"""


def shapiro(table: str, columns: list[str]) -> str:
    """W from sorted values and Royston's weights of the two values at either end."""
    first = polynomial([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0], "u")
    second = polynomial([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], "u")
    return union([
        f"""
SELECT '{c}' AS "column",
       round(least(1, pow(a1 * (y1 - x1) + a2 * (y2 - x2) + "inner" / sqrt((norm - 2 * m1 * m1 - 2 * m2 * m2)
             / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / total), 8) AS w
FROM (SELECT *, {first} + m1 / sqrt(norm) AS a1, {second} + m2 / sqrt(norm) AS a2
FROM (SELECT 1 / sqrt(any_value(n)) AS u, sum(d * d) AS total, sum(m * m) AS norm,
             sum(m * d) FILTER (i > 2 AND i < n - 1) AS "inner",
             max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2,
             max(d) FILTER (i = 1) AS x1, max(d) FILTER (i = 2) AS x2,
             max(d) FILTER (i = n - 1) AS y2, max(d) FILTER (i = n) AS y1
FROM (SELECT i, n, d, {normal_score("p")} AS m
FROM (SELECT i, n, x - mu AS d, (i - 0.375::double) / (n + 0.25::double) AS p
FROM (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n,
             avg(CAST({c} AS DOUBLE)) OVER () AS mu
      FROM {T(table)} WHERE {c} IS NOT NULL)))))"""
        for c in columns
    ])


ORACLE["shapiro_lineitem"] = shapiro("lineitem", LINEITEM)
ORACLE["shapiro_gaps"] = shapiro("gaps", GAP_NUMBERS)
ORACLE["numeric_stats_gaps"] = numeric_stats("gaps", GAP_NUMBERS)
# Decimals: the mode is the lowest of the most frequent values, of which there are many.
ORACLE["numeric_stats_money"] = numeric_stats("money", ["price", "fee"])
ORACLE["normality_supplier"] = f"""
SELECT "column", 'D''Agostino-Pearson' AS normality_test, round(p, 6) AS normality_pvalue
FROM ({with_normality(moments("supplier", ["s_suppkey", "s_nationkey", "s_acctbal"]))})"""
ORACLE["numeric_stats_events"] = numeric_stats("events", ["value", "user_id"])


def numeric_notes(source: str, large: bool) -> str:
    p = with_normality(source) if large else f"SELECT *, 1.0 AS p FROM ({source})"
    return f"""
SELECT "column", code FROM (SELECT "column", unnest([
    CASE WHEN sd = 0 THEN 'zero_variance' END,
    CASE WHEN abs(skew) > 2 THEN 'heavy_skew' WHEN abs(skew) > 1 THEN 'moderate_skew' END,
    CASE WHEN p < 0.05 AND n > 2000 THEN 'large_sample' END,
    CASE WHEN mean < 0 THEN 'negative_mean' END,
    CASE WHEN n >= 50 AND uniq / n > 0.95 THEN 'id_like' END]) AS code
FROM ({p})) WHERE code IS NOT NULL"""


def text_notes(table: str, columns: list[str]) -> str:
    return union([
        f"""SELECT "column", code FROM (SELECT '{c}' AS "column", unnest([
    CASE WHEN count(DISTINCT {c}) = 1 THEN 'single_category'
         WHEN count(DISTINCT {c}) > 50 THEN 'high_cardinality' END,
    CASE WHEN count({c}) < 30 THEN 'small_sample' END]) AS code FROM {T(table)})
WHERE code IS NOT NULL"""
        for c in columns
    ])


ORACLE["distribution_notes_events"] = union([
    numeric_notes(moments("events", ["event_id", "value"]), True),
    text_notes("events", ["event_type", "props"]),
])
_DEBT = moments("customer", ["c_nationkey", "c_acctbal"]) + "\nUNION ALL\n" + moments(
    "customer", ["c_acctbal - 9000"]
).replace("'c_acctbal - 9000'", "'c_debt'")
ORACLE["distribution_notes_customer"] = union([
    numeric_notes(_DEBT, False), text_notes("customer", ["c_name", "c_mktsegment"]),
])


def categorical_stats(table: str, columns: list[str]) -> str:
    return union([
        f"""
SELECT '{c}' AS "column", CAST(sum(k) AS BIGINT) AS count,
       CAST(any_value(total) - sum(k) AS BIGINT) AS null_count,
       round((any_value(total) - sum(k)) / any_value(total), 6) AS null_pct,
       count(*) AS unique_count, round(count(*) / sum(k), 6) AS unique_pct,
       arg_max(v, (k, -pos)) AS mode, max(k) AS mode_frequency,
       list_aggregate(list_transform(list_slice(list_sort(list((-k, pos, v || '=' || k))), 1, 10),
                      lambda t: t[3]), 'string_agg', ',') AS top_values,
       round(-sum(k / m * log2(k / m)) / log2(count(*)), 6) AS entropy
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS k,
             row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) AS pos,
             (SELECT count(*) FROM {T(table)}) AS total,
             (SELECT count({c}) FROM {T(table)}) AS m
      FROM {T(table)} WHERE {c} IS NOT NULL GROUP BY 1)"""
        for c in columns
    ])


ORACLE["categorical_stats_orders"] = categorical_stats(
    "orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"]
)
ORACLE["categorical_stats_gaps"] = categorical_stats("gaps", ["priority", "status", "o_orderdate"])

ORACLE["top_values_documents"] = union([
    f"""
SELECT '{c}' AS "column", rank, value, count, round(count / total, 6) AS share FROM (
SELECT any_value({c}) AS value, count(*) AS count,
       row_number() OVER (ORDER BY count(*) DESC, key) AS rank,
       (SELECT count({c}) FROM documents) AS total
FROM (SELECT {c}, CASE WHEN strlen({c}) > 64 THEN '#' || sha256({c}) ELSE {c} END AS key
      FROM documents WHERE {c} IS NOT NULL)
GROUP BY key) WHERE rank <= 10"""
    for c in ("text", "lang", "source")
])

ORACLE["value_table_part"] = union([
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count,
       round(count(*) / (SELECT count({c}) FROM part), 6) AS share
FROM part WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in ("p_name", "p_brand", "p_type", "p_size")
])

# Missingness

ORACLE["missing_columns_gaps"] = f"""
SELECT "column", nulls AS missing_count, round(nulls / total, 6) AS missing_pct,
       n AS present_count FROM ({missing_of("gaps", GAPS)})"""
ORACLE["missing_summary_gaps"] = f"""
SELECT CAST(sum(total) AS BIGINT) AS total_cells, CAST(sum(nulls) AS BIGINT) AS total_missing,
       round(sum(nulls) / sum(total), 6) AS global_missing_pct,
       (SELECT count(*) FROM {T("gaps")} WHERE price IS NOT NULL AND cust IS NOT NULL
          AND priority IS NOT NULL AND status IS NOT NULL) AS complete_rows,
       round((SELECT count(*) FROM {T("gaps")} WHERE price IS NOT NULL AND cust IS NOT NULL
          AND priority IS NOT NULL AND status IS NOT NULL) / max(total), 6) AS complete_rows_pct
FROM ({missing_of("gaps", GAPS)})"""
ORACLE["missing_patterns_gaps"] = f"""
SELECT missing, row_count, round(row_count / total, 6) AS row_pct FROM (
SELECT concat_ws(',', CASE WHEN cust IS NULL THEN 'cust' END,
                 CASE WHEN price IS NULL THEN 'price' END,
                 CASE WHEN priority IS NULL THEN 'priority' END,
                 CASE WHEN status IS NULL THEN 'status' END) AS missing,
       count(*) AS row_count, (SELECT count(*) FROM {T("gaps")}) AS total
FROM {T("gaps")} GROUP BY 1 ORDER BY row_count DESC, missing LIMIT 10) WHERE missing <> ''"""
ORACLE["joint_missing_gaps"] = f"""
SELECT * FROM ({union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b,"
    f" round(avg(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0 ELSE 0 END), 6) AS p_both"
    f" FROM {T('gaps')}" for a, b in combinations(GAPS, 2)
])}) WHERE p_both >= 0.5"""

ORACLE["shown_joint_missing_gaps"] = f"""
SELECT * FROM ({ORACLE["joint_missing_gaps"]}) ORDER BY p_both DESC LIMIT 10"""

# Outliers


def outlier_counts(table: str, columns: list[str]) -> str:
    """Counts by rule, with skewness and MAD."""
    return union([
        f"""
SELECT '{c}' AS "column", any_value(n) AS n,
       count(*) FILTER (n >= 4 AND (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))) AS iqr,
       count(*) FILTER (n >= 4 AND (x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1))) AS extreme,
       count(*) FILTER (n >= 4 AND sd > 0 AND abs(x - m) / sd > 3) AS z,
       count(*) FILTER (n >= 4 AND mad > 0 AND 0.6745 * abs(x - med) / mad > 3.5) AS mz,
       any_value(mad) AS mad,
       CASE WHEN any_value(sd) > 0
            THEN avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) END AS skew
FROM (SELECT *, (SELECT quantile_cont(abs({c} - s.med), 0.5) FROM {T(table)}) AS mad
      FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {T(table)}) v,
           (SELECT count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                   quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med,
                   quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                   avg({c}) AS m, stddev_samp({c}) AS sd FROM {T(table)}) s)"""
        for c in columns
    ])


def outliers(table: str, columns: list[str]) -> str:
    pct = ", ".join(
        f"{k} AS {name}_count, CASE WHEN n > 0 THEN round({k} / n, 6) ELSE 0 END AS {name}_pct"
        for k, name in (("iqr", "iqr"), ("extreme", "iqr_extreme"), ("z", "zscore"),
                        ("mz", "mzscore"))
    )
    return f'SELECT "column", {pct} FROM ({outlier_counts(table, columns)})'


ORACLE["outliers_events"] = outliers("events", ["value", "user_id"])
ORACLE["outliers_messy"] = outliers("messy", MESSY_NUMBERS)
ORACLE["outlier_notes_messy"] = f"""
SELECT "column", code FROM (SELECT "column", unnest([
    CASE WHEN abs(skew) > 1.5 AND n >= 20 THEN 'z_on_skew' END,
    CASE WHEN n >= 20 AND mz > 0 AND z > 3 * mz THEN 'z_above_mz'
         WHEN n >= 20 AND z = 0 AND mz > 0 THEN 'mz_only' END,
    CASE WHEN abs(skew) > 2 AND iqr > 0 THEN 'iqr_on_skew' END,
    CASE WHEN mad = 0 THEN 'mad_zero' END]) AS code
FROM ({outlier_counts("messy", MESSY_NUMBERS)}) WHERE n >= 4) WHERE code IS NOT NULL"""
ORACLE["outlier_rows_events"] = union([
    f"""
SELECT * FROM (SELECT '{c}' AS "column", event_id AS row_id, CAST({c} AS DOUBLE) AS value,
       row_number() OVER (ORDER BY event_id) AS rank
FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events)
WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) WHERE rank <= 20"""
    for c in ("value", "user_id")
])

# Correlation


def matrix(columns: list[str], value, diagonal: str = "1.0") -> str:
    parts = []
    for a in columns:
        for b in columns:
            v = diagonal if a == b else f"round(({value(*sorted((a, b), key=columns.index))}), 6)"
            parts.append(f"SELECT '{a}' AS row, '{b}' AS col, CAST({v} AS DOUBLE) AS value")
    return union(parts)


def pairs_table(columns: list[str], value) -> str:
    """Upper triangle computed once, then mirrored."""
    upper = union([
        f"SELECT '{a}' AS a, '{b}' AS b, CAST(({value(a, b)}) AS DOUBLE) AS v"
        for a, b in combinations(columns, 2)
    ])
    names = ", ".join(f"('{c}')" for c in columns)
    return f"""
WITH u AS MATERIALIZED ({upper})
SELECT a AS row, b AS col, round(v, 6) AS value FROM u
UNION ALL SELECT b, a, round(v, 6) FROM u
UNION ALL SELECT c, c, 1.0 FROM (VALUES {names}) AS t(c)"""


def pearson(table: str):
    return lambda a, b: f"SELECT corr({a}, {b}) FROM {T(table)}"


def spearman(table: str):
    return lambda a, b: f"""
SELECT corr(ra, rb) FROM (
SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
       rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb
FROM {T(table)} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


def cramers(table: str):
    return lambda a, b: f"""
WITH t AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b FROM {T(table)}
           WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
     ra AS (SELECT a, count(*) AS na FROM t GROUP BY a),
     rb AS (SELECT b, count(*) AS nb FROM t GROUP BY b),
     c AS (SELECT a, b, count(*) AS o FROM t GROUP BY a, b),
     e AS (SELECT coalesce(o, 0) AS o, CAST(na AS DOUBLE) * nb / (SELECT count(*) FROM t) AS e
           FROM ra CROSS JOIN rb LEFT JOIN c USING (a, b))
SELECT sqrt(sum((o - e) * (o - e) / e) / (SELECT count(*) FROM t)
       / (least((SELECT count(*) FROM ra), (SELECT count(*) FROM rb)) - 1)) FROM e"""


def wide_pearson() -> str:
    """The constant column has no correlation, not even with itself."""
    body = pairs_table(list("abcdefghijkln"), pearson("wide"))
    parts = [f"SELECT 'm' AS row, '{c}' AS col, CAST(NULL AS DOUBLE) AS value" for c in "abcdefghijklmn"]
    parts += [f"SELECT '{c}', 'm', NULL" for c in "abcdefghijkln"]
    return f"SELECT * FROM ({body})\nUNION ALL\n" + union(parts)


ORACLE["pearson_lineitem"] = pairs_table(LINEITEM, pearson("lineitem"))
ORACLE["pearson_gaps"] = pairs_table(GAP_NUMBERS, pearson("gaps"))
ORACLE["spearman_lineitem"] = pairs_table(LINEITEM, spearman("lineitem"))
ORACLE["spearman_gaps"] = pairs_table(GAP_NUMBERS, spearman("gaps"))
ORACLE["spearman_holes"] = pairs_table(list("abcdef"), spearman("holes"))
ORACLE["pearson_wide"] = wide_pearson()
ORACLE["heatmap_related"] = pairs_table(RELATED, pearson("related"))
ORACLE["cramers_v_orders"] = pairs_table(
    ["o_orderstatus", "o_orderdate", "o_orderpriority"], cramers("orders")
)
ORACLE["cramers_v_gaps"] = pairs_table(["priority", "status", "o_orderdate"], cramers("gaps"))


def strong(columns: list[str], table: str) -> str:
    upper = union([
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, ({pearson(table)(a, b)}) AS r"
        for a, b in combinations(columns, 2)
    ])
    return f"""
SELECT col_a, col_b, round(r, 6) AS r,
       CASE WHEN r > 0 THEN 'strong positive' ELSE 'strong negative' END AS label
FROM ({upper}) WHERE abs(r) >= 0.7"""


ORACLE["strong_pairs_related"] = strong(RELATED, "related")
ORACLE["shown_strong_pairs_related"] = strong(
    ["l_quantity", "cubed", "shifted", "mixture"], "related"
)

# The p of a correlation: 1 minus twice the integral of Student's density from 0 to |t| (Simpson).
ORACLE["point_biserial_related"] = f"""
WITH b AS ({union([f'''
SELECT '{c}' AS num_col, corr({c}, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS r,
       count({c}) AS n FROM {T("related")}''' for c in RELATED])}),
t AS (SELECT *, n - 2.0 AS v, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM b),
s AS (SELECT num_col, sum(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
        * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())
        * pow(1 + pow(least(t, 40) * k / 4000, 2) / v, -(v + 1) / 2))
        * any_value(least(t, 40)) / 4000 / 3 AS area
      FROM t, range(4001) AS g(k) GROUP BY num_col)
SELECT num_col, 'l_linestatus' AS bin_col, round(r, 6) AS r,
       round(greatest(0.0, 1 - 2 * area), 6) AS pvalue, n AS pairs
FROM t JOIN s USING (num_col)"""


def vif3(table: str, columns: list[str], digits: int) -> str:
    a, b, c = columns
    complete = f"(SELECT * FROM {T(table)} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in columns)})"
    return f"""
WITH r AS (SELECT corr({a}, {b}) AS ab, corr({a}, {c}) AS ac, corr({b}, {c}) AS bc
           FROM {complete}),
     d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
SELECT '{a}' AS "column", round((1 - bc * bc) / det, {digits}) AS vif FROM d
UNION ALL SELECT '{b}', round((1 - ac * ac) / det, {digits}) FROM d
UNION ALL SELECT '{c}', round((1 - ab * ab) / det, {digits}) FROM d"""


ORACLE["vif_mixture"] = vif3("related", ["l_quantity", "cubed", "shifted"], 4)
ORACLE["vif_gaps"] = vif3("gaps", GAP_NUMBERS, 6)

_CURVED = ["l_quantity", "steep", "rising"]
ORACLE["correlation_notes_curved"] = f"""
SELECT 'pearson_spearman_gap' AS code, a || ' × ' || b AS subject FROM ({union([f'''
SELECT '{a}' AS a, '{b}' AS b, ({pearson("curved")(a, b)}) AS r, ({spearman("curved")(a, b)}) AS s
''' for a, b in combinations(_CURVED, 2)])}) WHERE abs(r - s) > 0.15 AND abs(s) > 0.2
UNION ALL
SELECT CASE WHEN vif > 10 THEN 'severe_vif' ELSE 'moderate_vif' END, "column"
FROM ({vif3("curved", _CURVED, 9)}) WHERE vif > 5
UNION ALL
SELECT 'many_categories', c FROM ({union([
    f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u FROM {T('curved')}"
    for c in ("l_shipdate", "l_linestatus")])}) WHERE u > 20
UNION ALL
SELECT 'skewed_columns', string_agg("column", ', ' ORDER BY list_position({_CURVED}, "column"))
FROM ({moments("curved", _CURVED)}) WHERE abs(skew) > 2 HAVING count(*) >= 2"""

# Target association


def ranked_features(source: str, digits: int = 6, top: str = "") -> str:
    return f"""
SELECT row_number() OVER (ORDER BY score DESC) AS rank, feature, round(score, {digits}) AS score,
       method, direction FROM ({source}) QUALIFY true {top}"""


def linear(table: str, feature: str, x: str, y: str, method: str) -> str:
    return f"""
SELECT '{feature}' AS feature, abs(corr({x}, {y})) AS score, '{method}' AS method,
       CASE WHEN corr({x}, {y}) > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM {T(table)}"""


def eta(table: str, feature: str, by: str) -> str:
    return f"""
SELECT '{feature}' AS feature,
       sum(n * (m - (SELECT avg({feature}) FROM {T(table)} WHERE {by} IS NOT NULL)) ** 2)
         / (SELECT var_pop({feature}) * count({feature}) FROM {T(table)} WHERE {by} IS NOT NULL),
       'eta_squared', 'N/A'
FROM (SELECT {by}, avg({feature}) AS m, count({feature}) AS n FROM {T(table)}
      WHERE {by} IS NOT NULL GROUP BY {by})"""


def nominal(table: str, feature: str, by: str) -> str:
    return f"SELECT '{feature}', ({cramers(table)(feature, by)}), 'cramers_v', 'N/A'"


_IS_O = "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"
ORACLE["target_numeric_related"] = ranked_features(union(
    [linear("related", c, c, "shifted", "pearson") for c in RELATED if c != "shifted"]
    + [linear("related", "l_linestatus", _IS_O, "shifted", "point_biserial")]
))
ORACLE["target_binary_related"] = ranked_features(union(
    [linear("related", c, c, _IS_O, "point_biserial") for c in RELATED]
    + [nominal("related", "l_returnflag", "l_linestatus")]
))
ORACLE["target_classes_lineitem"] = ranked_features(union(
    [eta("lineitem", c, "l_returnflag").replace(",\n       'eta_squared', 'N/A'",
                                                " AS score, 'eta_squared' AS method,"
                                                " 'N/A' AS direction") for c in LINEITEM]
    + [nominal("lineitem", "l_linestatus", "l_returnflag")]
), 9)
ORACLE["target_classes_shifted"] = ranked_features(union([
    eta("lineitem", c, "l_returnflag")
    .replace(f"SELECT '{c}' AS feature", f"SELECT '{name}' AS feature")
    .replace(",\n       'eta_squared', 'N/A'",
             " AS score, 'eta_squared' AS method, 'N/A' AS direction")
    for c, name in (("l_quantity", "late"), ("l_partkey", "key"))
]))
ORACLE["target_top_orders"] = f"""SELECT * FROM ({ranked_features(union(
    [eta("orders", c, "o_orderpriority").replace(",\n       'eta_squared', 'N/A'",
                                                 " AS score, 'eta_squared' AS method,"
                                                 " 'N/A' AS direction")
     for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    + [nominal("orders", c, "o_orderpriority") for c in ("o_orderstatus", "o_orderdate")]
))}) WHERE rank <= 3"""


def levene(table: str, columns: list[str], by: str) -> str:
    """F of the distances to the class medians."""
    return union([
        f"""
SELECT '{c}' AS "column", count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows,
       (sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS w
FROM (SELECT k, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS ss, any_value(g) AS g
      FROM (SELECT k, z, avg(z) OVER () AS g FROM (
            SELECT {by} AS k, abs({c} - median({c}) OVER (PARTITION BY {by})) AS z
            FROM {T(table)} WHERE {c} IS NOT NULL AND {by} IS NOT NULL)) GROUP BY k)"""
        for c in columns
    ])


# With three classes the F tail has two degrees above the line and a closed form; so with five.
ORACLE["levene_lineitem"] = f"""
SELECT "column", round(w, 6) AS w, classes, rows,
       round(pow(1 + 2 * w / (rows - 3), -(rows - 3) / 2), 6) AS pvalue
FROM ({levene("lineitem", LINEITEM, "l_returnflag")})"""

ORACLE["class_sizes_documents"] = """
SELECT source AS class, count(*) AS count,
       round(count(*) / (SELECT count(source) FROM documents), 6) AS share
FROM documents WHERE source IS NOT NULL GROUP BY source"""
ORACLE["small_classes_customer"] = """
SELECT * FROM (SELECT c_mktsegment || ' ' || c_nationkey AS class, count(*) AS count,
       round(count(*) / (SELECT count(*) FROM customer), 6) AS share
FROM customer GROUP BY 1) WHERE count < 30"""
ORACLE["target_notes_events"] = f"""
SELECT 'unequal_variances' AS code FROM (
  SELECT w, (rows - 5) / 2 AS a, (rows - 5) / (rows - 5 + 4 * w) AS x
  FROM ({levene("events", ["value"], "event_type")})) WHERE pow(x, a) * (1 + a * (1 - x)) < 0.05
UNION ALL
SELECT 'small_classes' FROM (SELECT event_type FROM events GROUP BY 1 HAVING count(*) < 30 LIMIT 1)
UNION ALL
SELECT 'skewed_target' FROM ({moments("events", ["pow(value, 3)"])}) WHERE abs(skew) > 2"""

# Drift

_THEN_NOW = ("orders_then", "orders_now")


def cast(c: str) -> str:
    return f"CAST(CAST({c} AS INT) AS DOUBLE)" if c == "even" else f"CAST({c} AS DOUBLE)"


def ks(c: str, then: str, now: str) -> str:
    return f"""
(SELECT max(abs(f1 / n1 - f2 / n2)) FROM (
 SELECT sum(r) OVER w AS f1, sum(1 - r) OVER w AS f2, sum(r) OVER () AS n1, sum(1 - r) OVER () AS n2
 FROM (SELECT {cast(c)} AS x, 1 AS r FROM {T(then)} UNION ALL SELECT {cast(c)}, 0 FROM {T(now)})
 WHERE x IS NOT NULL
 WINDOW w AS (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


def psi(c: str, then: str, now: str) -> str:
    return f"""
(WITH e AS (SELECT list_sort(list_distinct(quantile_cont({cast(c)},
               [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM {T(then)}),
 b AS (SELECT k, e[k] AS lo, e[k + 1] AS hi, k = len(e) - 1 AS last
       FROM e, (SELECT unnest(range(1, 11)) AS k) WHERE k < len(e)),
 c AS (SELECT k, (SELECT count(*) FROM {T(then)}
                  WHERE {cast(c)} >= lo AND ({cast(c)} < hi OR last AND {cast(c)} <= hi)) AS n1,
              (SELECT count(*) FROM {T(now)}
                  WHERE {cast(c)} >= lo AND ({cast(c)} < hi OR last AND {cast(c)} <= hi)) AS n2
       FROM b),
 p AS (SELECT greatest(n1 / sum(n1) OVER (), 1e-6) AS p1,
              greatest(n2 / sum(n2) OVER (), 1e-6) AS p2 FROM c)
 SELECT greatest(0.0, sum((p2 - p1) * ln(p2 / p1))) FROM p)"""


def drift_numeric(columns: list[str], then: str, now: str) -> str:
    return union([
        f"""
SELECT '{c}' AS "column", avg({cast(c)}) AS m1, stddev_samp({cast(c)}) AS s1,
       (SELECT avg({cast(c)}) FROM {T(now)}) AS m2,
       (SELECT stddev_samp({cast(c)}) FROM {T(now)}) AS s2,
       {ks(c, then, now)} AS d, {psi(c, then, now)} AS psi,
       CAST(count({c}) AS DOUBLE) AS n1, CAST((SELECT count({c}) FROM {T(now)}) AS DOUBLE) AS n2
FROM {T(then)}"""
        for c in columns
    ])


# Kolmogorov's series at the argument with the finite-sample terms; for small arguments its other
# form, which converges there.
_KS_P = """
       round(least(1.0, greatest(0.0, CASE WHEN l < 0.05 THEN 1.0 WHEN l < 1 THEN
         1 - sqrt(2 * pi()) / l * list_sum(list_transform(range(1, 20),
               lambda j: exp(-(2 * j - 1) * (2 * j - 1) * pi() * pi() / (8 * l * l))))
         ELSE 2 * list_sum(list_transform(range(1, 200),
               lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * l * l))) END)),
       6)"""


def ks_argument(source: str) -> str:
    return f"""
SELECT *, d * sqrt(n) + 1 / (6 * sqrt(n)) + (d * sqrt(n) - 1) / (4 * n) AS l
FROM (SELECT *, n1 * n2 / (n1 + n2) AS n FROM ({source}))"""


_ORDER_NUMBERS = drift_numeric(["bucket", "even", "o_custkey", "o_totalprice"], *_THEN_NOW)
_SEVERITY = "CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.2 THEN 'moderate' ELSE 'high' END"
ORACLE["drift_numeric_orders"] = f"""
SELECT "column", 'numeric' AS col_type, round(m1, 4) AS mean_ref, round(m2, 4) AS mean_cur,
       round(abs(m1 - m2) / abs(m1) * 100, 6) AS mean_shift_pct, round(s1, 4) AS std_ref,
       round(s2, 4) AS std_cur, round(d, 6) AS ks_statistic, {_KS_P} AS ks_pvalue,
       round(psi, 6) AS psi, psi >= 0.1 AS drift_detected, {_SEVERITY} AS drift_severity
FROM ({ks_argument(_ORDER_NUMBERS)})"""
ORACLE["drift_ranked_items"] = f"""
SELECT rank, "column", round(psi, 6) AS psi, {_SEVERITY} AS drift_severity
FROM (SELECT *, row_number() OVER (ORDER BY coalesce(psi, 0) DESC, "column") AS rank
      FROM (SELECT "column", psi FROM ({_ORDER_NUMBERS})
            UNION ALL SELECT unnest(['channel', 'o_orderpriority', 'o_orderstatus']), NULL))
WHERE psi IS NOT NULL"""

ORACLE["drift_ks_lineitem"] = f"""
SELECT "column", round(d, 6) AS ks_statistic, round(psi, 6) AS psi, {_KS_P} AS ks_pvalue
FROM ({ks_argument(drift_numeric(["l_quantity", "l_extendedprice", "l_discount"],
                                 "items_then", "items_now"))})"""


def chi_square(c: str) -> str:
    """Chi-square of two categories carries Yates' correction."""
    return f"""
SELECT '{c}' AS "column", count(*) AS k, sum(
  CASE WHEN k2 = 2 THEN (abs(a - ea) - least(0.5, abs(a - ea))) ** 2 / ea
                      + (abs(b - eb) - least(0.5, abs(b - eb))) ** 2 / eb
       ELSE (a - ea) ** 2 / ea + (b - eb) ** 2 / eb END) AS chi2
FROM (SELECT *, (a + b) * sa / (sa + sb) AS ea, (a + b) * sb / (sa + sb) AS eb FROM (
  SELECT *, sum(a) OVER () AS sa, sum(b) OVER () AS sb, count(*) OVER () AS k2 FROM (
    SELECT {c}, count(*) FILTER (r = 1) + 1e-6 AS a, count(*) FILTER (r = 0) + 1e-6 AS b
    FROM (SELECT {c}, 1 AS r FROM {T("orders_then")} UNION ALL
          SELECT {c}, 0 FROM {T("orders_now")}) WHERE {c} IS NOT NULL GROUP BY {c})))"""


# Even degrees of freedom have a closed form; for one degree the error function is summed as
# exp(-z²) 2/√π Σ 2^i z^(2i+1) / (2i+1)!!, whose terms are all positive.
_CHI = f"""
SELECT *, CASE k WHEN 3 THEN exp(-chi2 / 2) WHEN 5 THEN exp(-chi2 / 2) * (1 + chi2 / 2)
          WHEN 2 THEN CASE WHEN chi2 > 60 THEN 0 ELSE greatest(0.0, 1 - list_sum(list_transform(
            range(0, 200), lambda i: exp(-chi2 / 2 + (2 * i + 1) * ln(greatest(1e-300, sqrt(chi2 / 2)))
              + (2 * i + 1) * ln(2) + lgamma(i + 1) - lgamma(2 * i + 2)))) * 2 / sqrt(pi()) / 2) END END AS p,
       p < 0.05 AS drifted
FROM ({union([chi_square(c) for c in ("channel", "o_orderpriority", "o_orderstatus")])})"""
ORACLE["drift_categorical_orders"] = f"""
SELECT "column", round(chi2, 6) AS chi2_statistic, round(p, 6) AS chi2_pvalue,
       drifted AS drift_detected FROM ({_CHI})"""
ORACLE["drift_summary_orders"] = f"""
WITH d AS (SELECT "column", psi >= 0.1 AS drifted FROM ({_ORDER_NUMBERS})
           UNION ALL SELECT "column", drifted FROM ({_CHI}))
SELECT coalesce(string_agg("column", ',' ORDER BY "column") FILTER (drifted), '')
         AS drifted_columns,
       count(*) FILTER (drifted) AS drifted_count, count(*) AS total_columns,
       round(count(*) FILTER (drifted) / count(*), 6) AS drift_fraction,
       bool_or(drifted) AS overall_drift,
       (SELECT count(*) FROM {T("orders_then")}) AS ref_rows, CAST(8 AS BIGINT) AS ref_columns,
       (SELECT count(*) FROM {T("orders_now")}) AS cur_rows, CAST(8 AS BIGINT) AS cur_columns,
       'o_orderkey' AS missing_in_current, 'o_orderdate' AS new_in_current, CAST(0.2 AS DOUBLE) AS psi_threshold
FROM d"""
ORACLE["drift_column_changes"] = f"""
SELECT 'o_orderkey' AS "column", 'missing_in_current' AS change, count(o_orderkey) AS present,
       count(*) AS rows FROM {T("orders_then")}
UNION ALL SELECT 'o_orderdate', 'new_in_current', count(o_orderdate), count(*) FROM {T("orders_now")}"""

# Health audit and summary


def findings(table: str, numbers: list[str], texts: list[str], order: list[str]) -> str:
    """(check, category, severity, columns) by the audit's rules."""
    text_parts = []
    for c in texts:
        text_parts.append(f"""
SELECT '{c}' AS c, count({c}) AS n, count(*) AS total, count(DISTINCT {c}) AS uniq,
       {number_share(c, f"count({c})")} AS numeric_share, {number_share(c)} AS all_share,
       CAST(count(try_cast({c} AS DATE)) AS DOUBLE) / count({c}) AS date_share,
       count(*) FILTER (lower(trim({c})) IN ('', '?', '-', 'na', 'n/a', '#n/a', 'null', 'none',
                                             'nan', 'missing')) AS hidden,
       (SELECT count(*) FROM (SELECT lower(trim({c})) FROM {T(table)} WHERE {c} IS NOT NULL
                              GROUP BY 1 HAVING count(DISTINCT {c}) > 1)) AS variants,
       (SELECT max(k) FROM (SELECT count(*) AS k FROM {T(table)} WHERE {c} IS NOT NULL
                            GROUP BY {c})) AS top
FROM {T(table)}""")
    number_parts = [f"""
SELECT '{c}' AS c, count({c}) AS n, count(DISTINCT {c}) AS uniq,
       bool_and(CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE))) AS whole,
       (SELECT max(k) FROM (SELECT count(*) AS k FROM {T(table)} WHERE {c} IS NOT NULL
                            GROUP BY {c})) AS top
FROM {T(table)}""" for c in numbers]  # fmt: skip
    number_pairs = list(combinations([c for c in order if c in numbers], 2))
    r_parts = [f"""
SELECT '{a}' AS a, '{b}' AS b,
       CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0
             AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0
            THEN corr({a}, {b}) END AS r,
       bool_and({a} IS NOT DISTINCT FROM {b}) AS same FROM {T(table)}"""
               for a, b in number_pairs]
    joint = [f"""
SELECT '{a}' AS a, '{b}' AS b,
       avg(CASE WHEN {a} IS NULL AND {b} IS NULL THEN 1.0 ELSE 0 END) AS p
FROM {T(table)}""" for a, b in combinations(order, 2)]  # fmt: skip
    return f"""
WITH gaps AS ({missing_of(table, order)}),
     texts AS ({union(text_parts)}),
     numbers AS ({union(number_parts)}),
     r AS ({union(r_parts)}),
     joint AS ({union(joint)}),
     outs AS ({outlier_counts(table, numbers)}),
     ids AS (SELECT c, n, uniq FROM numbers WHERE n >= 50 AND uniq / n > 0.95 AND whole
             UNION ALL SELECT c, n, uniq FROM texts WHERE n >= 20 AND uniq / n >= 0.98)
SELECT CASE WHEN nulls = total THEN 'Empty column' WHEN nulls >= 0.5 * total
            THEN 'Severe missingness' ELSE 'High missingness' END AS "check",
       'Completeness' AS category,
       CASE WHEN nulls >= 0.5 * total THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
       "column" AS columns, round(nulls / total, 6) AS value FROM gaps WHERE nulls >= 0.1 * total
UNION ALL
SELECT 'Correlated missingness', 'Completeness', 'INFO', a || ',' || b, round(p, 6)
FROM joint WHERE p >= 0.5
UNION ALL
SELECT 'Duplicate columns', 'Duplication', 'CRITICAL', a || ',' || b, 1 FROM r WHERE same
UNION ALL
SELECT 'Mixed types', 'Type Integrity', 'WARNING', c, round(all_share, 6) FROM texts
WHERE all_share > 0.01 AND all_share < 0.99
UNION ALL
SELECT 'Numeric stored as text', 'Type Integrity', 'WARNING', c, round(numeric_share, 6) FROM texts
WHERE numeric_share >= 0.99
UNION ALL
SELECT 'Dates stored as text', 'Type Integrity', 'INFO', c, round(date_share, 6) FROM texts
WHERE numeric_share < 0.5 AND n >= 5 AND date_share >= 0.95
UNION ALL
SELECT 'Disguised missing values', 'Type Integrity', 'WARNING', c, hidden FROM texts WHERE hidden > 0
UNION ALL
SELECT 'Inconsistent category labels', 'Type Integrity', 'WARNING', c, variants FROM texts
WHERE variants > 0
UNION ALL
SELECT 'Constant column', 'Feature Quality', 'CRITICAL', c, 1 FROM
  (SELECT c, uniq FROM numbers UNION ALL SELECT c, uniq FROM texts) WHERE uniq = 1
UNION ALL
SELECT 'Near-constant column', 'Feature Quality', 'WARNING', c, round(top / n, 6) FROM
  (SELECT c, n, uniq, top FROM numbers UNION ALL SELECT c, n, uniq, top FROM texts)
WHERE n >= 20 AND uniq > 1 AND top / n >= 0.99
UNION ALL
SELECT 'Identifier column', 'Feature Quality', 'WARNING', c, round(uniq / n, 6) FROM ids
UNION ALL
SELECT 'High-cardinality column', 'Feature Quality', 'INFO', c, uniq FROM texts
WHERE uniq > 50 AND c NOT IN (SELECT c FROM ids)
UNION ALL
SELECT 'Extreme outliers', 'Feature Quality', 'WARNING', "column", round(extreme / n, 6) FROM outs
WHERE n > 0 AND extreme / n >= 0.05 AND "column" NOT IN (SELECT c FROM ids)
UNION ALL
SELECT 'Near-duplicate features', 'Redundancy', 'WARNING', a || ',' || b, round(r, 6) FROM r
WHERE abs(r) >= 0.95 AND NOT same"""


# No row of the messy table is complete, so it has no inflation factors.
_MESSY = findings("messy", MESSY_NUMBERS, MESSY_TEXTS, MESSY)
ORACLE["health_findings_messy"] = _MESSY
ORACLE["health_findings_copies"] = f"""
SELECT 'Duplicate rows' AS "check", 'Duplication' AS category,
       CASE WHEN copies >= 0.2 * total THEN 'CRITICAL' WHEN copies >= 0.01 * total THEN 'WARNING'
            ELSE 'INFO' END AS severity, '' AS columns, round(copies / total, 6) AS value
FROM (SELECT sum(n - 1) AS copies, sum(n) AS total FROM
      (SELECT *, count(*) AS n FROM {T("copies")} GROUP BY ALL)) WHERE copies > 0"""
ORACLE["health_findings_region"] = """
SELECT 'Few rows per column' AS "check", 'Structure' AS category, 'WARNING' AS severity,
       '' AS columns, count(*) / 2 AS value FROM region HAVING count(*) < 10
UNION ALL SELECT 'Special characters in column names', 'Structure', 'INFO', '', 1
UNION ALL SELECT 'All-text columns', 'Type Integrity', 'WARNING', '', 2"""
_ORDER = """['Structure', 'Completeness', 'Duplication', 'Type Integrity', 'Feature Quality',
             'Redundancy', 'Target Risks']"""
ORACLE["health_categories_messy"] = f"""
SELECT CAST(list_position(names, category) AS BIGINT) AS position, category, coalesce(findings, 0) AS findings,
       CAST(coalesce(deducted, 0) AS BIGINT) AS deducted
FROM (SELECT {_ORDER} AS names, unnest({_ORDER}) AS category)
LEFT JOIN (SELECT category, count(*) AS findings,
                  least(25, sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'WARNING' THEN 5
                                ELSE 0 END)) AS deducted
           FROM ({_MESSY}) GROUP BY category) USING (category)"""
ORACLE["health_score_messy"] = f"""
WITH f AS ({_MESSY}),
     p AS (SELECT category, least(25, sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'WARNING'
                                          THEN 5 ELSE 0 END)) AS lost FROM f GROUP BY category),
     t AS (SELECT string_agg(category, ',') AS worst FROM (
             SELECT category FROM p ORDER BY lost DESC, list_position({_ORDER}, category) LIMIT 2)),
     s AS (SELECT CAST(greatest(0, 100 - (SELECT sum(lost) FROM p)) AS BIGINT) AS score,
                  count(*) FILTER (severity = 'CRITICAL') AS critical,
                  count(*) FILTER (severity = 'WARNING') AS warnings,
                  count(*) FILTER (severity = 'INFO') AS infos FROM f)
SELECT score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good'
                   WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor'
                   ELSE 'Critical' END AS band, critical, warnings, infos,
       worst AS worst_categories
FROM s, t"""

# The dependent columns of the related table, where the factor is above 10 by construction:
# mixture = 3 quantity + 100 discount, negative follows price up to the tax, and shifted is
# quantity plus 0 or 5.  cubed is left to its own factor given quantity, the only column it
# depends on besides what quantity already explains.
ORACLE["health_redundancy_related"] = f"""
SELECT 'Near-duplicate features' AS "check", 'WARNING' AS severity, a || ',' || b AS columns
FROM ({union([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {T('related')}"
              for a, b in combinations(RELATED, 2)])}) WHERE abs(r) >= 0.95
UNION ALL
SELECT 'Severe multicollinearity', 'WARNING',
       unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'mixture', 'negative', 'shifted'])"""

ORACLE["health_target_risks"] = f"""
SELECT 'half_empty' AS target, 'Missing target values' AS "check", 'WARNING' AS severity,
       'half_empty' AS columns
FROM {T("messy")} HAVING count(*) > count(half_empty)
UNION ALL
SELECT 'half_empty', 'Possible target leakage', 'CRITICAL', c FROM ({union([
    f"SELECT '{c}' AS c, corr({c}, half_empty) AS r FROM {T('messy')}"
    for c in ("id", "price", "price_copy", "price_near", "thin", "wild")
])}) WHERE abs(r) >= 0.99
UNION ALL
SELECT 'outcome', 'Class imbalance', 'WARNING', 'outcome' FROM (
  SELECT min(n) / sum(n) AS share FROM (
    SELECT count(*) AS n FROM {T("messy")} WHERE outcome IS NOT NULL GROUP BY outcome))
WHERE share < 0.1"""


def whole_ids(table: str, numbers: list[str], texts: list[str]) -> str:
    return union([
        f"SELECT '{c}' AS c, count({c}) AS n, count(DISTINCT {c}) AS u,"
        f" bool_and(CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE))) AND count({c}) >= 50"
        f" AND count(DISTINCT {c}) / count({c}) > 0.95 AS id FROM {T(table)}" for c in numbers
    ] + [
        f"SELECT '{c}', count({c}), count(DISTINCT {c}), count({c}) >= 20"
        f" AND count(DISTINCT {c}) / count({c}) >= 0.98 FROM {T(table)}" for c in texts
    ])


def candidates(table: str, numbers: list[str], texts: list[str], order: list[str]) -> str:
    """(tier, magnitude, column) of every issue; tables without complete rows have no tier 4."""
    pairs = list(combinations([c for c in order if c in numbers], 2))
    return f"""
SELECT 1 AS tier, 1.0 AS magnitude, c AS "column" FROM ({whole_ids(table, numbers, [])})
WHERE u = 1
UNION ALL
SELECT 3, nulls / total, "column" FROM ({missing_of(table, order)}) WHERE nulls >= 0.1 * total
UNION ALL
SELECT 5, abs(r), a || ',' || b FROM ({union([f'''
SELECT '{a}' AS a, '{b}' AS b,
       CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0
             AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0
            THEN corr({a}, {b}) END AS r FROM {T(table)}''' for a, b in pairs])})
WHERE abs(r) >= 0.7
UNION ALL
SELECT 6, u / n, c FROM ({whole_ids(table, numbers, texts)}) WHERE id
UNION ALL
SELECT 7, abs(skew), "column" FROM ({moments(table, numbers)}) WHERE abs(skew) > 2
UNION ALL
SELECT 8, iqr / n, "column" FROM ({outlier_counts(table, numbers)}) WHERE n > 0 AND iqr / n >= 0.1"""


ORACLE["key_issue_candidates_messy"] = f"""
SELECT CAST(tier AS BIGINT) AS tier, round(magnitude, 4) AS magnitude, "column"
FROM ({candidates("messy", MESSY_NUMBERS, MESSY_TEXTS, MESSY)})"""
ORACLE["key_issues_gaps"] = f"""
SELECT rank, CAST(tier AS BIGINT) AS tier, round(magnitude, 6) AS magnitude, "column",
       CASE tier WHEN 3 THEN 'missing_share' WHEN 6 THEN 'key_like' END AS code
FROM (SELECT *, row_number() OVER (ORDER BY tier, magnitude DESC) AS rank
      FROM ({candidates("gaps", GAP_NUMBERS, ["priority", "status", "o_orderdate"], GAPS)}))
WHERE rank <= 5"""
_SHIFTED = ["l_quantity", "cubed", "shifted"]
_SHIFTED_VIF = vif3("related", _SHIFTED, 9)
ORACLE["key_issues_shifted"] = f"""
WITH inflated AS (SELECT "column" AS c, vif FROM ({_SHIFTED_VIF}) WHERE vif > 10),
r AS ({union([f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM {T('related')}"
              for a, b in combinations(_SHIFTED, 2)])}),
f AS (
  SELECT 2 AS tier, CAST(sum(n - 1) AS DOUBLE) AS magnitude, '' AS "column", 'repeated_rows' AS code
  FROM (SELECT l_quantity, cubed, shifted, count(*) AS n FROM {T("related")} GROUP BY ALL)
  UNION ALL SELECT 4, vif, c, 'vif' FROM inflated
  UNION ALL SELECT 5, r, a || ',' || b, 'strong_pair' FROM r
  WHERE r >= 0.7 AND a NOT IN (SELECT c FROM inflated) AND b NOT IN (SELECT c FROM inflated)
  UNION ALL SELECT 7, abs(skew), "column", 'skewed' FROM ({moments("related", _SHIFTED)})
  WHERE abs(skew) > 2
  UNION ALL SELECT 8, iqr / n, "column", 'outliers' FROM ({outlier_counts("related", _SHIFTED)})
  WHERE iqr / n >= 0.1)
SELECT row_number() OVER (ORDER BY tier, magnitude DESC) AS rank, CAST(tier AS BIGINT) AS tier,
       round(magnitude, 4) AS magnitude, "column", code FROM f"""
ORACLE["at_a_glance_copies"] = f"""
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns,
       CAST(0 AS DOUBLE) AS missing_share, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
       CAST(2 AS BIGINT) AS numeric_features, CAST(1 AS BIGINT) AS categorical_features, 'o_orderstatus' AS target
FROM (SELECT *, count(*) AS n FROM {T("copies")} GROUP BY ALL)"""

# Contracts


def rules(table: str, kinds: dict[str, str]) -> str:
    parts = []
    for c, kind in kinds.items():
        low = high = "NULL"
        labels = "CAST(NULL AS VARCHAR)"
        if kind == "numeric":
            low = f"round(min({c}) - abs(min({c})) * 0.1, 6)"
            high = f"round(max({c}) + abs(max({c})) * 0.1, 6)"
        if kind == "categorical":
            labels = (f"CASE WHEN count(DISTINCT {c}) <= 20"
                      f" THEN string_agg(DISTINCT {c}, ',' ORDER BY {c}) END")  # fmt: skip
        parts.append(f"""
SELECT '{c}' AS "column", '{kind}' AS dtype, true AS required, CAST({low} AS DOUBLE) AS min,
       CAST({high} AS DOUBLE) AS max,
       round(least(100, 150.0 * (count(*) - count({c})) / count(*)), 1) AS max_missing_pct,
       {labels} AS allowed_values FROM {T(table)}""")
    return union(parts)


ORACLE["contract_rules_customer"] = rules("customer", {
    "c_custkey": "numeric", "c_name": "categorical", "c_nationkey": "numeric",
    "c_acctbal": "numeric", "c_mktsegment": "categorical",
})
ORACLE["contract_rules_gaps"] = rules("gaps", {
    "o_orderkey": "numeric", "price": "numeric", "cust": "numeric", "priority": "categorical",
    "status": "categorical", "o_orderdate": "datetime",
})
ORACLE["contract_global_copies"] = f"""
SELECT 'copies' AS name, '1.0' AS version, CAST(floor(0.8 * sum(n)) AS BIGINT) AS min_rows,
       round(least(100, 150.0 * sum(n - 1) / sum(n) + 1), 1) AS max_duplicate_pct,
       'warn' AS extra_columns
FROM (SELECT *, count(*) AS n FROM {T("copies")} GROUP BY ALL)"""

# The changed customers: too few for the rule, a column less and one more, a retyped name, shifted
# numbers, gaps and new segments.


def bound(column: str, low: bool) -> str:
    edge = f"min({column})" if low else f"max({column})"
    sign = "-" if low else "+"
    return f"(SELECT round({edge} {sign} abs({edge}) * 0.1, 6) FROM customer)"


_BROKEN = f"""
SELECT 1 AS seq, '__global__' AS "column", 'min_rows' AS "check", 'error' AS severity,
       '>= ' || (SELECT 2 * CAST(floor(0.8 * count(*)) AS BIGINT) FROM customer) AS expected,
       CAST(count(*) AS VARCHAR) AS actual FROM {T("customer_now")}
HAVING count(*) < (SELECT 2 * CAST(floor(0.8 * count(*)) AS BIGINT) FROM customer)
UNION ALL SELECT 2, 'c_phone', 'required', 'error', 'present', 'missing'
UNION ALL SELECT 3, 'c_extra', 'extra_column', 'warning', 'not present', 'present'
UNION ALL SELECT 4, 'c_name', 'dtype', 'error', 'numeric', 'categorical'
UNION ALL SELECT 5, 'c_nationkey', 'max', 'error', '<= ' || {bound("c_nationkey", False)},
       CAST(CAST(max(c_nationkey) AS DOUBLE) AS VARCHAR)
FROM {T("customer_now")} HAVING max(c_nationkey) > {bound("c_nationkey", False)}
UNION ALL SELECT 6, 'c_acctbal', 'max_missing_pct', 'error', '<= 0.0%',
       printf('%.1f', 100.0 * (count(*) - count(c_acctbal)) / count(*)) || '%'
FROM {T("customer_now")} HAVING count(*) > count(c_acctbal)
UNION ALL SELECT 7, 'c_acctbal', 'min', 'error', '>= ' || {bound("c_acctbal", True)},
       CAST(min(c_acctbal) AS VARCHAR)
FROM {T("customer_now")} HAVING min(c_acctbal) < {bound("c_acctbal", True)}
UNION ALL SELECT 8, 'c_mktsegment', 'allowed_values', 'warning',
       (SELECT 'subset of [\'\'' || string_agg(DISTINCT c_mktsegment, '\'\', \'\'' ORDER BY c_mktsegment)
               || '\'\']' FROM customer),
       count(DISTINCT c_mktsegment) || ' other values'
FROM {T("customer_now")} WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer)
HAVING count(*) > 0"""
ORACLE["contract_violations_customer"] = f"""
SELECT row_number() OVER (ORDER BY seq) AS position, "column", "check", severity, expected, actual
FROM ({_BROKEN})"""
ORACLE["contract_violations_copies"] = f"""
WITH o AS (SELECT sum(n - 1) AS d, sum(n) AS t FROM
           (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus, o_totalprice)),
     c AS (SELECT sum(n - 1) AS d, sum(n) AS t FROM
           (SELECT *, count(*) AS n FROM {T("copies")} GROUP BY ALL)),
     b AS (SELECT round(min(o_totalprice) * 0.9, 6) AS low FROM orders)
SELECT row_number() OVER (ORDER BY seq) AS position, * EXCLUDE (seq) FROM (
SELECT 1 AS seq, '__global__' AS "column", 'max_duplicate_pct' AS "check", '<= ' || round(least(100,
       150.0 * o.d / o.t + 1), 1) || '%' AS expected, printf('%.1f', 100.0 * c.d / c.t) || '%' AS actual,
       'error' AS severity FROM o, c
UNION ALL SELECT 2, 'o_orderstatus', 'allowed_values',
       (SELECT 'subset of [\'\'' || string_agg(DISTINCT o_orderstatus, '\'\', \'\'' ORDER BY o_orderstatus)
               || '\'\']' FROM orders), '1 other values', 'warning'
UNION ALL SELECT 3, 'o_totalprice', 'min', '>= ' || low, '2.5', 'error' FROM b)"""
ORACLE["contract_verdict_strict"] = f"""
SELECT count(*) = 0 AS passed, false AS has_warnings, count(*) AS errors, CAST(0 AS BIGINT) AS warnings
FROM ({_BROKEN})"""
ORACLE["contract_verdict_passing"] = """
SELECT true AS passed, false AS has_warnings, CAST(0 AS BIGINT) AS errors,
       CAST(0 AS BIGINT) AS warnings"""
ORACLE["contract_unexpected_values"] = f"""
SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS count
FROM {T("customer_now")} WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer)
GROUP BY c_mktsegment"""

# Chart feeds


def edges(lo: str, hi: str, n: str) -> str:
    """Inner edges of equal bins."""
    return f"list_transform(range(1, {n}), lambda k: {lo} + k * (({hi} - {lo}) / {n}))"


def bin_of(x: str, inner: str) -> str:
    return f"len(list_filter({inner}, lambda e: e <= {x}))"


def histogram(table: str, c: str, n: str, extra: str = "count(x) AS count") -> str:
    return f"""
SELECT '{c}' AS "column", k AS bin, lo + k * ((hi - lo) / n) AS low,
       CASE WHEN k = n - 1 THEN hi ELSE lo + (k + 1) * ((hi - lo) / n) END AS high, {extra}
FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {n} AS n FROM {T(table)}) s
CROSS JOIN range(30) AS g(k)
LEFT JOIN (SELECT x, {bin_of("x", "inner_")} AS b FROM
  (SELECT {c}::DOUBLE AS x FROM {T(table)} WHERE {c} IS NOT NULL),
  (SELECT {edges("lo", "hi", "n")} AS inner_ FROM
   (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {n} AS n FROM {T(table)}))) v
ON v.b = k
WHERE k < n GROUP BY ALL"""


def histograms(table: str, columns: list[str]) -> str:
    body = union([
        histogram(table, c, f"least(30, (SELECT count(DISTINCT {c}) FROM {T(table)}))")
        for c in columns
    ])
    return f"""
SELECT "column", bin, round(low, 6) AS low, round(high, 6) AS high, count FROM ({body})"""


ORACLE["histograms_lineitem"] = histograms("lineitem", LINEITEM)
ORACLE["histograms_gaps"] = histograms("gaps", GAP_NUMBERS)
ORACLE["box_stats_gaps"] = f"""
SELECT "column", round(lo, 4) AS min, round(q25, 4) AS p25, round(med, 4) AS p50,
       round(q75, 4) AS p75, round(hi, 4) AS max, round(mean, 4) AS mean
FROM ({moments("gaps", GAP_NUMBERS)})"""
ORACLE["value_bars_gaps"] = union([
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS count,
       round(100.0 * count(*) / (SELECT count({c}) FROM {T("gaps")}), 2) AS pct
FROM {T("gaps")} WHERE {c} IS NOT NULL GROUP BY {c}"""
    for c in ("priority", "status")
])
ORACLE["missing_bars_gaps"] = f"""
SELECT "column", round(100.0 * nulls / total, 2) AS missing_pct, nulls AS missing_count
FROM ({missing_of("gaps", GAPS)}) WHERE nulls > 0"""
ORACLE["shown_missing_gaps"] = f"""
SELECT row_number() OVER (ORDER BY nulls DESC) AS rank, "column", nulls AS missing_count,
       round(nulls / total, 6) AS missing_pct
FROM ({missing_of("gaps", GAPS)}) WHERE nulls > 0"""
ORACLE["outlier_bars_messy"] = f"""
SELECT "column", iqr, extreme AS iqr_extreme, z AS z_score, mz AS modified_z
FROM ({outlier_counts("messy", MESSY_NUMBERS)})"""
ORACLE["outlier_points_events"] = """
SELECT event_id AS row_id, 'value' AS "column", round(value, 6) AS value,
       round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high,
       value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier
FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
              FROM events)
WHERE value IS NOT NULL"""


def overlay(c: str) -> str:
    both = (f"(SELECT {cast(c)} AS x, 1 AS r FROM {T('orders_then')} UNION ALL"
            f" SELECT {cast(c)}, 0 FROM {T('orders_now')})")  # fmt: skip
    return f"""
SELECT '{c}' AS "column", k AS bin, round(lo + k * ((hi - lo) / 25), 4) AS low,
       round(CASE WHEN k = 24 THEN hi ELSE lo + (k + 1) * ((hi - lo) / 25) END, 4) AS high,
       count(*) FILTER (r = 1) AS reference, count(*) FILTER (r = 0) AS current
FROM (SELECT min(x) AS lo, max(x) AS hi FROM {both}) CROSS JOIN range(25) AS g(k)
LEFT JOIN (SELECT r, {bin_of("x", "inner_")} AS b FROM {both},
           (SELECT {edges("lo", "hi", "25")} AS inner_
            FROM (SELECT min(x) AS lo, max(x) AS hi FROM {both})) WHERE x IS NOT NULL) v
ON v.b = k
GROUP BY ALL"""


def only_drifted(body: str) -> str:
    return f"""
SELECT * FROM ({body}) WHERE "column" IN (SELECT "column" FROM ({_ORDER_NUMBERS}) WHERE psi >= 0.1)"""


_DRIFT_NUMBERS = ["bucket", "even", "o_custkey", "o_totalprice"]
ORACLE["drift_overlay_orders"] = only_drifted(union([overlay(c) for c in _DRIFT_NUMBERS]))


def density(c: str, side: str, table: str) -> str:
    return f"""
SELECT '{side}' AS side, '{c}' AS "column", k AS bin, round(lo + k * ((hi - lo) / 30), 4) AS low,
       round(CASE WHEN k = 29 THEN hi ELSE lo + (k + 1) * ((hi - lo) / 30) END, 4) AS high,
       round(count(b) / (SELECT count({c}) FROM {T(table)}) / ((hi - lo) / 30), 9) AS density
FROM (SELECT min({cast(c)}) AS lo, max({cast(c)}) AS hi FROM {T(table)})
CROSS JOIN range(30) AS g(k)
LEFT JOIN (SELECT {bin_of("x", "inner_")} AS b FROM
             (SELECT {cast(c)} AS x FROM {T(table)} WHERE {c} IS NOT NULL),
             (SELECT {edges("lo", "hi", "30")} AS inner_ FROM
              (SELECT min({cast(c)}) AS lo, max({cast(c)}) AS hi FROM {T(table)}))) v
ON v.b = k
GROUP BY k, lo, hi"""


ORACLE["density_overlay_orders"] = only_drifted(union([
    density(c, side, t) for c in _DRIFT_NUMBERS
    for side, t in (("reference", "orders_then"), ("current", "orders_now"))
]))
ORACLE["category_overlay_orders"] = f"""
SELECT category, round(count(*) FILTER (r = 1) / (SELECT count(*) FROM {T("orders_then")}), 6)
         AS reference,
       round(count(*) FILTER (r = 0) / (SELECT count(*) FROM {T("orders_now")}), 6) AS current
FROM (SELECT o_orderpriority AS category, 1 AS r FROM {T("orders_then")} UNION ALL
      SELECT o_orderpriority, 0 FROM {T("orders_now")})
GROUP BY category ORDER BY category LIMIT 15"""
ORACLE["class_boxes_related"] = union([
    f"""SELECT l_returnflag AS class, '{c}' AS feature, round(min({c}), 6) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max
FROM {T("related")} GROUP BY l_returnflag"""
    for c in ("shifted", "cubed")
])
ORACLE["class_histograms_related"] = union([
    f"""
SELECT class, '{c}' AS feature, b AS bin, round(lo + b * ((hi - lo) / 30), 6) AS low,
       round(CASE WHEN b = 29 THEN hi ELSE lo + (b + 1) * ((hi - lo) / 30) END, 6) AS high,
       count(*) AS count
FROM (SELECT class, lo, hi, {bin_of("x", "inner_")} AS b FROM
        (SELECT l_returnflag AS class, {c} AS x FROM {T("related")}),
        (SELECT *, {edges("lo", "hi", "30")} AS inner_ FROM
         (SELECT min({c}) AS lo, max({c}) AS hi FROM {T("related")})))
GROUP BY class, b, lo, hi"""
    for c in ("shifted", "cubed")
])
ORACLE["target_grid_related"] = union([
    f"""
SELECT '{c}' AS feature, xb AS x_bin, yb AS y_bin, round(xl + xb * ((xh - xl) / 30), 6) AS x_low,
       round(yl + yb * ((yh - yl) / 30), 6) AS y_low, count(*) AS count
FROM (SELECT xl, xh, yl, yh, {bin_of("x", "xi")} AS xb, {bin_of("y", "yi")} AS yb FROM
        (SELECT {c} AS x, l_extendedprice AS y FROM {T("related")}),
        (SELECT *, {edges("xl", "xh", "30")} AS xi, {edges("yl", "yh", "30")} AS yi FROM
         (SELECT min({c}) AS xl, max({c}) AS xh, min(l_extendedprice) AS yl,
                 max(l_extendedprice) AS yh FROM {T("related")})))
GROUP BY xb, yb, xl, xh, yl, yh"""
    for c in ("shifted", "mixture")
])

# Sources, preparation and sinks

ORACLE["typed_cells"] = f"""
SELECT CAST(whole AS BIGINT) AS whole, CAST(nullif(gappy, 'NA') AS DOUBLE) AS gappy,
       CAST("decimal" AS DOUBLE) AS "decimal", flag = 'True' AS flag,
       nullif(gappy_flag, 'n/a') AS gappy_flag, nullif(label, '') AS label,
       CAST(NULL AS DOUBLE) AS blank, day FROM {T("cells")}"""
ORACLE["typed_cells_schema"] = """
SELECT unnest(['whole', 'gappy', 'decimal', 'flag', 'gappy_flag', 'label', 'blank', 'day'])
         AS "column",
       unnest(['bigint', 'double', 'double', 'boolean', 'string', 'string', 'double',
               'timestamp']) AS type"""
ORACLE["parsed_lines_orders"] = """
SELECT 9007199254740990000 + o_orderkey AS key, o_orderpriority || '; ' || o_orderstatus AS label,
       round(o_totalprice, 6) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders"""
ORACLE["line_delimiters_orders"] = """
SELECT DISTINCT o_orderkey % 3 AS part, ';' AS delimiter FROM orders"""
ORACLE["long_lines_orders"] = f"""
SELECT value, CAST(5 AS INTEGER) AS cells FROM {T("ragged")} WHERE value LIKE '%|more'"""
ORACLE["drop_columns_orders"] = """
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"""
ORACLE["sample_rows_orders"] = """
SELECT least(500, count(*)) AS rows, least(500, count(*)) AS keys FROM orders"""
ORACLE["json_safe_numbers"] = f"""
SELECT o_orderkey, CASE WHEN isnan(price) OR isinf(price) THEN NULL ELSE round(price, 6) END
         AS price FROM {T("odd_numbers")}"""
ORACLE["profile_many_status"] = """
SELECT 'region' AS dataset, 'ok' AS status, CAST(2 AS BIGINT) AS columns, count(*) AS rows FROM region
UNION ALL SELECT 'nation', 'ok', 3, count(*) FROM nation
UNION ALL SELECT 'supplier', 'ok', 4, count(*) FROM supplier
UNION ALL SELECT 'nobody', 'failed', NULL, NULL"""
