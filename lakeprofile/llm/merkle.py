"""Merkle manifest of a table: digests of rows, of each group and of all, and a proof for every row.

A row's leaf is the SHA-256 of its fields. The leaves of a group stand in order; every FANOUT
neighbours become the digest of their digests, until one is left, the group's subroot. Subroots in
the order of their groups become the root in the same way.

The ranks of the nodes in a group are written as digits to the base FANOUT. LEVELS digits make a block
of bounded size (4,096 nodes), which one shuffle brings together; grouping by all but the last digit,
then all but the last two, and so on, needs no other shuffle and nests the nodes of a run, in order, in
their parent's struct. The digests of whole blocks are nodes of the next round: a table 4,096 times
smaller, rolled up by the same function, until every group has one block. What a block's digest needs
for its proof comes back to the block in one aggregation over both, and each block is unfolded from
the top: every step explodes the nested nodes with the digests left and right of them.
No step joins rows with rows: the only joined table counts rows of a range (`ranking`).

Defined results: fields that are null are `-`, else their length in bytes, a colon and the value; rows
without an id come first, rows with equal ids are ordered by their leaf and all have a leaf of their
own; empty texts are of length 0; null is a group of its own, the first; an empty table has no rows.
Columns other than those named are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeprofile.llm import ranking, shared

FANOUT, BITS, LEVELS = 16, 4, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def written(value: Column) -> Column:
    """A field as it is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(written, values)), 256)


def _height(total: Column) -> Column:
    """Levels above the leaves until one node is left."""
    return sum((F.when(total > F.lit(FANOUT**k), 1).otherwise(0) for k in range(15)), F.lit(0))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, height, kids, hash): nodes (tree, rank, height, hash, item) nested by their digits."""
    digits = [f"d{k}" for k in range(LEVELS)]
    rows = nodes.select(
        "tree", F.shiftright("rank", BITS * LEVELS).alias("block"), "height", "hash", "item",
        *[F.shiftright("rank", BITS * k).bitwiseAND(FANOUT - 1).cast("int").alias(d) for k, d in enumerate(digits)],
    ).repartition("tree", "block")
    nested = "item"
    for k, digit in enumerate(digits):
        kids = F.array_sort(F.collect_list(F.struct(digit, "hash", nested)))
        rows = rows.groupBy("tree", "block", *digits[k + 1 :]).agg(
            F.first("height").alias("height"), kids.alias("kids")
        )
        # Above the last level of its tree a node stands for its only child.
        together = F.sha2(F.array_join(F.col("kids.hash"), ""), 256)
        rows = rows.withColumn("hash", F.when(F.col("height") > k, together).otherwise(F.col("kids")[0]["hash"]))
        nested = "kids"
    return rows


def _rounds(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The blocks of the nodes, of their blocks, and so on until each tree has one block; `most` is the
    number of nodes of the largest tree."""
    rounds = []
    while True:
        rounds.append(shared.cut(_blocks(nodes), "blocks"))
        if most <= FANOUT**LEVELS:
            return rounds
        most = -(-most // FANOUT**LEVELS)
        nodes = rounds[-1].select(
            "tree", F.col("block").alias("rank"), F.greatest(F.col("height") - LEVELS, F.lit(0)).alias("height"),
            "hash", F.col("block").alias("item"),
        )


_PATH = "array<struct<left:string,right:string>>"


def _step(k: int) -> Column:
    """What a proof needs of one level: the digests left and right of the node; nothing above the last level."""
    left = F.array_join(F.slice("siblings", F.lit(1), F.col("at")), "")
    right = F.array_join(F.slice("siblings", F.col("at") + 2, F.lit(FANOUT)), "")
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.when(F.col("height") > k, step).otherwise(F.array().cast(_PATH))


def _unfolded(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, item, hash, path, carried): the nodes of the first round with their proofs.

    `above` is (tree, block, path, carried) of the last round's blocks."""
    for blocks in reversed(rounds):
        both = blocks.drop("hash").unionByName(above, allowMissingColumns=True)
        rows = both.groupBy("tree", "block").agg(
            *[F.first(c, True).alias(c) for c in ("height", "kids", "path", "carried")]
        )
        for k in reversed(range(LEVELS)):
            opened = rows.select(
                "tree", "height", "path", "carried", F.col("kids.hash").alias("siblings"),
                F.posexplode("kids").alias("at", "node"),
            )
            below = ("node.hash", "node.item") if k == 0 else ("node.kids",)
            rows = opened.select("tree", "height", F.concat(_step(k), "path").alias("path"), "carried", *below)
        above = rows.select("tree", F.col("item").alias("block"), "path", "carried")
    return rows.select("tree", "item", "hash", "path", "carried")


def _ranked(rows: DataFrame, by: list[Column]) -> DataFrame:
    ranks = ranking.ranked_within(rows, "tree", by, "rank", "total")
    return ranks.withColumn("height", _height(F.col("total"))).drop("total")


def proofs(leaves: DataFrame, group: str, order: str, leaf: str, *extra: str) -> DataFrame:
    """(group, order, extra, leaf, subroot, root, path): each row with its digests and its proof.

    `path` has, level by level up to the root, the digests left and right of the row's node, as text.
    """
    item = F.struct(F.col(order).alias("order"), *[F.col(c).alias(f"extra{i}") for i, c in enumerate(extra)])
    rows = leaves.select(F.col(group).alias("tree"), F.col(leaf).alias("hash"), item.alias("item"))
    # Two numbers, for how many rounds it takes; reads the groups alone.
    most, groups = rows.groupBy("tree").count().agg(F.max("count"), F.count("*")).first()
    below = _rounds(_ranked(rows, [F.col("item.order").asc_nulls_first(), F.col("hash")]), most or 0)

    subroots = below[-1].select(F.lit(0).alias("tree"), "hash", F.struct(F.col("tree").alias("group")).alias("item"))
    upper = _rounds(_ranked(subroots, [F.col("item.group").asc_nulls_first()]), groups)
    nothing = F.array().cast(_PATH).alias("path")
    root = upper[-1].select("tree", "block", nothing, F.struct(F.col("hash").alias("root")).alias("carried"))
    above = _unfolded(upper, root).select(
        F.col("item.group").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
        F.struct(F.col("hash").alias("subroot"), "carried.root").alias("carried"),
    )
    return _unfolded(below, above).select(
        F.col("tree").alias(group), F.col("item.order").alias(order),
        *[F.col(f"item.extra{i}").alias(c) for i, c in enumerate(extra)],
        F.col("hash").alias("leaf"), "carried.subroot", "carried.root", "path",
    )


def folded(start: Column, path: Column) -> Column:
    """The topmost digest that a leaf and its proof lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The SHA-256 of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _sql_written(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    step = "lambda a, b: xor(a >> 1, 3988292384 * (a & 1))"
    byte = f"lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], {step})"
    return f"xor(list_reduce([4294967295::bigint] || list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint), {byte}), 4294967295)"


def oracle() -> str:
    fields = " || ".join(_sql_written(f) for f in FIELDS[:-1])
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    levels = """
  select {g}, 0 lvl, r, h, n from {leaves}
  union all
  select {g}, lvl + 1, r // 16, sha256(string_agg(h, '' order by r)), any_value((n + 15) // 16)
  from {name} where n > 1 group by {g}, lvl, r // 16"""
    return f"""
with recursive leaves as (
  select doc_id, source, sha256({fields} || {_sql_written("text")}) leaf,
    case when {crc32_sql("doc_id::varchar")} % 5 = 0 then sha256({fields} || {_sql_written(lowered)}) end tampered
  from documents),
ranked as (
  select *, leaf h, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 r,
    count(*) over (partition by source) n from leaves),
nodes as ({levels.format(g="source", leaves="ranked", name="nodes")}),
subroots as (
  select source, h, row_number() over (order by source nulls first) - 1 r, count(*) over () n from nodes where n = 1),
tops as ({levels.format(g="one", leaves="(select 1 one, * from subroots)", name="tops")}),
runs as (select source, lvl, r // 16 run, list(h order by r) hs from nodes where n > 1 group by all),
top_runs as (select lvl, r // 16 run, list(h order by r) hs from tops where n > 1 group by all),
steps as (
  select d.source, d.r, a.lvl seq, a.hs, (d.r >> (4 * a.lvl)) & 15 p
  from ranked d join runs a on a.source is not distinct from d.source and a.run = d.r >> (4 * a.lvl + 4)
  union all
  select d.source, d.r, 100 + a.lvl, a.hs, (s.r >> (4 * a.lvl)) & 15
  from ranked d join subroots s on s.source is not distinct from d.source
  join top_runs a on a.run = s.r >> (4 * a.lvl + 4)),
parts as (
  select source, r, row_number() over (partition by source, r order by seq) k,
    array_to_string(hs[1:p], '') l, array_to_string(hs[p + 2:], '') g from steps),
fold as (
  select source, r, 0::bigint k, coalesce(tampered, leaf) h from ranked
  union all
  select f.source, f.r, p.k, sha256(p.l || f.h || p.g)
  from fold f join parts p on p.source is not distinct from f.source and p.r = f.r and p.k = f.k + 1),
ends as (select source, r, arg_max(h, k) folded_root from fold group by all),
proof as (select source, r, sha256(string_agg(l || g, '' order by k)) proof_sha256 from parts group by all)
select d.doc_id, d.leaf, s.h subroot, t.h root, coalesce(p.proof_sha256, sha256('')) proof_sha256, e.folded_root,
  e.folded_root = t.h verified
from ranked d join subroots s on s.source is not distinct from d.source cross join (select h from tops where n = 1) t
join ends e on e.source is not distinct from d.source and e.r = d.r
left join proof p on p.source is not distinct from d.source and p.r = d.r
"""
