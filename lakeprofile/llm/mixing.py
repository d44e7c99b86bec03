"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Each source gets a target in words and so a rate, target over size, of copies per document. Whole
copies are certain; what is left is a fraction p per document, a mass of p * size words. Rounding
pairs two fractional documents and moves words from one to the other, in a random direction whose
odds keep every expectation, until one of them holds nothing or a whole copy. The words of a pair
never change, so a source misses its target by less than one document.

The pairs form a tree: documents are dealt by a hash of their id into groups of about `fan`, a
group is folded in the order of a second hash until at most one document is fractional, and these
rests are grouped again, level by level, until a source has one group; its last rest is drawn at
random. All sources share the jobs of a level, and no group grows with its source. Only SQL
functions run. Hashes are the only randomness, so reruns agree on any layout of the rows.

Defined results: null text has size 0 and is never taken; null sources are one source, ranked last;
sources are ranked by code point. Rows that agree in source, id and size share one decision about
their number of copies, spread over them as evenly as it goes. An empty table gives no rows; where
all sizes are 0, all targets are. Other columns are kept only by `copies_of`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.llm import shared

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
FAN = 64
SEED = 20260


def targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """source, source_size, n, target from rows (source, size, m), of which m are alike.

    Weights repeat along the ranked sources. A level is raised until the targets, weight * level
    but at most cap * size, sum to share * all sizes; each pass over the table of sources caps
    more of them, and only two sums reach the driver.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    kind = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = by.withColumn("last", F.col("source").isNull())
    table = shared.ranked(table, [F.col("last"), F.col("source")])
    table = shared.cut(table.withColumn("weight", kind.cast("double")), "weights")
    most = cap * F.col("source_size")
    goal = (table.agg(F.sum("source_size")).first()[0] or 0) * min(share, cap)
    level = 0.0
    while True:
        full = most <= level * F.col("weight")
        fixed, open_weight = table.agg(
            F.sum(F.when(full, most).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if not open_weight:
            break
        raised = (goal - fixed) / open_weight
        if raised <= level:
            break
        level = raised
    return table.select(
        "source", "source_size", "n", F.least(most, level * F.col("weight")).alias("target")
    )


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


UNIT = "struct<h:bigint,doc_id:{id},size:bigint,m:bigint,base:bigint,a:double>"

#: Folds the units of a group: c is the fractional one so far, out what is decided.
FOLD = """
aggregate(units,
  named_struct('c', cast(null as {unit}), 'out', cast(array() as array<{done}>)),
  (s, e) -> if(s.c is null, named_struct('c', e, 'out', s.out),
    element_at(transform(transform(transform(
      array(named_struct('up', least(s.c.size - s.c.a, e.a), 'down', least(s.c.a, e.size - e.a))),
      x -> named_struct('go', x.up + x.down = 0 or
        cast(shiftrightunsigned(xxhash64({seed}, s.c.h, e.h), 11) as double) * {ulp}
          * (x.up + x.down) < x.down)),
      x -> named_struct('go', x.go, 'first',
        if(x.go, s.c.size - s.c.a <= e.a, s.c.a <= e.size - e.a))),
      x -> named_struct(
        'c', if(x.first,
          named_struct('h', e.h, 'doc_id', e.doc_id, 'size', e.size, 'm', e.m, 'base', e.base,
            'a', greatest(0D, least(cast(e.size as double),
                 s.c.a + e.a - if(x.go, s.c.size, 0)))),
          named_struct('h', s.c.h, 'doc_id', s.c.doc_id, 'size', s.c.size, 'm', s.c.m, 'base', s.c.base,
            'a', greatest(0D, least(cast(s.c.size as double),
                 s.c.a + e.a - if(x.go, 0, e.size))))),
        'out', concat(s.out, array(if(x.first,
          named_struct('doc_id', s.c.doc_id, 'size', s.c.size, 'm', s.c.m,
            'total', s.c.base + if(x.go, 1L, 0L)),
          named_struct('doc_id', e.doc_id, 'size', e.size, 'm', e.m,
            'total', e.base + if(x.go, 0L, 1L))))))), 1)))
"""


def decide(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    fan: int = FAN,
    seed: int = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, source, size, m (rows that agree in these), total (their copies), source_size, target."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        shared.word_count(F.col(text_column)).alias("size"),
    )
    units = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    units = shared.cut(units, "units")
    goals = shared.cut(targets(units.select("source", "size", "m"), weights, share, cap), "targets")
    id_type = units.schema["doc_id"].dataType.simpleString()
    unit = UNIT.format(id=id_type)
    done = f"struct<doc_id:{id_type},size:bigint,m:bigint,total:bigint>"

    # A few values per source: Spark broadcasts them while they are small, else it shuffles.
    known = goals.withColumn("key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(rate)
    extra = F.col("m") * (rate - whole)
    base = F.when(F.col("size") > 0, F.col("m") * whole + F.floor(extra)).otherwise(F.lit(0))
    left = F.when(F.col("size") > 0, (extra - F.floor(extra)) * F.col("size")).otherwise(F.lit(0.0))
    key = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    start = (
        units.withColumn("key", key)
        .join(known.select("key", "source_size", "target", "n"), "key")
        .select(
            "key", "n", "doc_id", "size", "m",
            base.cast("long").alias("base"), left.alias("a"),
            F.xxhash64(F.lit(seed), "doc_id", "size").alias("h"),
        )
    )
    flat = start.where("a <= 0 or size = 0").select("key", "doc_id", "size", "m", F.col("base").alias("total"))
    rest = start.where("a > 0 and size > 0").select(
        "key", "n", F.struct("h", "doc_id", "size", "m", "base", "a").cast(unit).alias("u")
    )
    most = goals.agg(F.max("n")).first()[0] or 0
    decided, level = [flat], 0
    while most > 0:
        most, level = math.ceil(most / fan), level + 1
        groups = F.ceil(F.col("n") / fan)
        dealt = rest.select(
            "key", groups.alias("n"),
            F.pmod(F.xxhash64(F.lit(seed + level), "u.h", "u.doc_id"), groups).alias("g"), "u",
        )
        folded = (
            dealt.groupBy("key", "n", "g")
            .agg(F.sort_array(F.collect_list("u")).alias("units"))
            .select("key", "n", F.expr(FOLD.format(unit=unit, done=done, seed=seed + level,
                                                   ulp="1.1102230246251565E-16D")).alias("r"))
        )
        folded = shared.cut(folded, "level")
        out = folded.select("key", F.explode("r.out").alias("d")).select("key", "d.*")
        decided.append(out)
        rest = folded.where("r.c is not null").select("key", "n", F.col("r.c").alias("u"))
        if most <= 1:
            break
    last = F.when(_unit(F.lit(seed), F.lit("last"), F.col("u.h")) * F.col("u.size") < F.col("u.a"), 1)
    decided.append(
        rest.select("key", "u.doc_id", "u.size", "u.m",
                    (F.col("u.base") + F.coalesce(last, F.lit(0))).alias("total"))
    )
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    return every.join(known.drop("n"), "key").select(
        "doc_id", "source", "size", "m", "total", "source_size", "target"
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    spread = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i")
    share = F.floor(F.col("total") / F.col("m")) + (F.col("i") <= F.col("total") % F.col("m")).cast("long")
    return (
        decide(docs, **options)
        .select("*", spread)
        .select("doc_id", "source", "size", "source_size", "target", share.cast("long").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def copies_of(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with docs' columns.

    Of rows that share a decision, those with the smaller hashes of their texts are taken more often.
    """
    names = docs.columns
    by = [options.get(f"{c}_column", c if c != "id" else "doc_id") for c in ("id", "source", "text")]
    by = [f"c{names.index(c)}" for c in by]
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever they are called
    options |= {f"{c}_column": own for c, own in zip(("id", "source", "text"), by)}
    chosen = decide(docs, **options)
    plan = chosen.where("total > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
        F.col("size").alias("__size"), F.col("m").alias("__m"), F.col("total").alias("__total"),
    )
    sized = docs.withColumn("__words", shared.word_count(F.col(by[2])))
    joined = sized.join(
        plan,
        F.col(by[0]).eqNullSafe(F.col("__id"))
        & F.col(by[1]).eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size")),
    )
    one = joined.where("__m = 1").withColumn("__copies", F.col("__total"))
    order = Window.partitionBy("__id", "__source", "__size").orderBy(F.xxhash64(by[2]))
    many = joined.where("__m > 1").withColumn("__i", F.row_number().over(order))
    many = many.withColumn(
        "__copies",
        F.floor(F.col("__total") / F.col("__m"))
        + (F.col("__i") <= F.col("__total") % F.col("__m")).cast("long"),
    ).drop("__i")
    rows = one.unionByName(many).where("__copies > 0")
    return rows.withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    ).select(*docs.columns).toDF(*names)
