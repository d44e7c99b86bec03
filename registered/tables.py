"""Input tables of the registered queries.

The given tables hold no gaps, copies or disorder, so some inputs are derived from them.  Each
derivation is one SQL text that both engines read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED = {
    # Orders with cells left out.
    "gaps": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
               CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS cust,
               CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 10 < 7 THEN NULL ELSE o_orderstatus END AS status,
               o_orderdate
        FROM {orders}""",
    # Orders with a fifth of the rows doubled and a third of all rows being one row.
    "copies": """
        SELECT o_custkey, o_orderstatus, o_totalprice FROM {orders}
        UNION ALL
        SELECT o_custkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 5 = 0
        UNION ALL
        SELECT 1 AS o_custkey, 'X' AS o_orderstatus, CAST(2.5 AS DOUBLE) AS o_totalprice
        FROM {orders} WHERE o_orderkey % 5 < 3""",
    # Orders with every disorder the audit looks for.
    "messy": """
        SELECT o_orderkey AS id,
               o_totalprice AS price,
               o_totalprice AS price_copy,
               o_totalprice * 2 + o_custkey AS price_near,
               CAST(o_custkey AS STRING) AS cust_text,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS day_text,
               7 AS fixed,
               CASE WHEN o_orderkey % 200 = 0 THEN 'rare' ELSE 'usual' END AS nearly,
               CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus
                    ELSE lower(o_orderstatus) || ' ' END AS label,
               CASE WHEN o_orderkey % 10 = 0 THEN 'N/A' WHEN o_orderkey % 10 = 1 THEN ' none '
                    ELSE o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 3 = 0 THEN 'x' || CAST(o_custkey AS STRING)
                    ELSE CAST(o_custkey AS STRING) END AS mixed,
               CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_totalprice END AS half_empty,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS thin,
               CAST(NULL AS DOUBLE) AS blank,
               CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice * 1000 ELSE o_totalprice END AS wild,
               CASE WHEN o_orderkey % 50 = 0 THEN 'late' ELSE 'fine' END AS outcome
        FROM {orders}""",
    # Line items with linearly related columns.
    "related": """
        SELECT l_quantity, l_extendedprice, l_discount,
               l_quantity * l_quantity * l_quantity AS cubed,
               l_quantity * 3 + l_discount * 100 AS mixture,
               -2 * l_extendedprice + l_tax AS negative,
               CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE l_quantity + 5 END AS shifted,
               l_linestatus, l_returnflag
        FROM {lineitem}""",
    # Line items with a curve that a straight line follows badly.
    "curved": """
        SELECT l_quantity, exp(l_quantity) AS steep, exp(l_quantity / 2) AS rising,
               l_shipdate, l_linestatus
        FROM {lineitem}""",
    # Two halves of the orders; the current one has a column more and one less.
    "orders_then": """
        SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
               o_custkey % 2 = 0 AS even, CAST(o_custkey % 100 AS DOUBLE) AS bucket,
               CASE WHEN o_custkey % 2 = 0 THEN 'web' ELSE 'shop' END AS channel
        FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'""",
    "orders_now": """
        SELECT o_custkey, o_totalprice * 3 / 5 + 20000 AS o_totalprice, o_orderstatus,
               CASE WHEN o_custkey % 4 = 0 THEN '1-URGENT' ELSE o_orderpriority END
                   AS o_orderpriority,
               o_custkey % 3 = 0 AS even, CAST(o_custkey % 100 AS DOUBLE) * 3 / 4 + o_custkey % 7 AS bucket,
               CASE WHEN o_custkey % 3 = 0 THEN 'web' ELSE 'shop' END AS channel,
               o_orderdate
        FROM {orders} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'""",
    "items_then": """
        SELECT l_quantity, l_extendedprice, l_discount, l_returnflag
        FROM {lineitem} WHERE l_orderkey % 2 = 0""",
    "items_now": """
        SELECT l_quantity, l_extendedprice + 500 AS l_extendedprice, l_discount, l_returnflag
        FROM {lineitem} WHERE l_orderkey % 2 = 1""",
    # Cells as a delimited file would hold them.
    "cells": """
        SELECT CAST(o_orderkey AS STRING) AS whole,
               CASE WHEN o_orderkey % 9 = 0 THEN 'NA' ELSE CAST(o_custkey AS STRING) END AS gappy,
               CAST(o_totalprice AS STRING) AS decimal,
               CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS flag,
               CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' WHEN o_orderkey % 2 = 0 THEN 'True'
                    ELSE 'False' END AS gappy_flag,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS label,
               '' AS blank,
               CAST(CAST(o_orderdate AS DATE) AS STRING) AS day
        FROM {orders}""",
    # Numbers that JSON cannot hold.
    "odd_numbers": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE)
                    WHEN o_orderkey % 5 = 1 THEN CAST('Infinity' AS DOUBLE)
                    WHEN o_orderkey % 5 = 2 THEN CAST('-Infinity' AS DOUBLE)
                    ELSE o_totalprice END AS price
        FROM {orders}""",
    "customer_now": """
        SELECT c_custkey, c_name, c_nationkey + 10 AS c_nationkey,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal - 3000 END AS c_acctbal,
               CASE WHEN c_custkey % 10 = 0 THEN 'SPACE' WHEN c_custkey % 10 = 1 THEN 'FARM'
                    ELSE c_mktsegment END AS c_mktsegment,
               c_custkey AS c_extra
        FROM {customer}""",
    # Orders' prices as decimals, and decimals with few values that are about as frequent.
    "money": """
        SELECT CAST(o_totalprice AS DECIMAL(15, 2)) AS price,
               CAST(o_orderkey % 40 AS DECIMAL(15, 2)) + CAST(0.25 AS DECIMAL(15, 2)) AS fee
        FROM {orders}""",
    # Orders with a sixth of the cells left out, another sixth in every column.
    "holes": """
        SELECT CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS a,
               CASE WHEN o_orderkey % 6 <> 1 THEN o_custkey END AS b,
               CASE WHEN o_orderkey % 6 <> 2 THEN o_totalprice + 100 * o_custkey END AS c,
               CASE WHEN o_custkey % 6 <> 3 THEN o_custkey % 17 END AS d,
               CASE WHEN o_custkey % 6 <> 4 THEN o_orderkey - 3 * o_custkey END AS e,
               CASE WHEN o_custkey % 6 <> 5 THEN o_totalprice * o_custkey END AS f
        FROM {orders}""",
    # Fourteen columns, some with gaps.
    "wide": """
        SELECT o_orderkey AS a, o_custkey AS b, o_totalprice AS c, o_orderkey % 7 AS d,
               o_custkey % 11 AS e, o_totalprice * o_custkey AS f,
               CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS g,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + o_orderkey END AS h,
               o_orderkey % 13 - o_custkey % 13 AS i, o_totalprice + 1700000000 AS j,
               o_custkey * o_custkey AS k, CASE WHEN o_custkey % 4 = 0 THEN o_orderkey END AS l,
               7 AS m, o_orderkey * 2 - o_custkey AS n
        FROM {orders}""",
    # Orders as lines of text: a key of 19 digits, a label with a delimiter inside quotes.
    "lines": """
        SELECT o_orderkey % 3 AS part,
               CAST(9007199254740990000 + o_orderkey AS STRING) || ';"' || o_orderpriority || '; '
               || o_orderstatus || '";' || CAST(o_totalprice AS STRING) || ';'
               || CAST(CAST(o_orderdate AS DATE) AS STRING) AS value
        FROM {orders}""",
    "ragged": """
        SELECT CAST(o_orderkey AS STRING) || '|x|1|2024-01-05'
               || CASE WHEN o_orderkey % 50 = 0 THEN '|more' ELSE '' END AS value
        FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = DERIVED[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle_table(name: str) -> str:
    """The same table as a FROM item for the oracle."""
    if name in TABLES:
        return name
    return "(" + DERIVED[name].format(**{t: t for t in TABLES}) + ")"
