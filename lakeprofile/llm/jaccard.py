"""Similarity join on word shingles by T-occurrence search, and the classes it links.

A document's set is its distinct shingles of `k` words; texts with equal sets are one class, kept
once. Two classes link when 100 * shared >= percent * union, so they share at least
T = percent / 100 * (larger size) shingles, and so, in any order of all shingles, one among the
first n - T + 1 of each (the lists that DivideSkip merges; the other T - 1, the longest, are only
probed). The order used is by hash, frequent shingles last: a table of frequent shingles of fixed
size is counted over all documents first. It only steers the work; any table gives the same links.

1. One scan: set size and class of every document, and local counts of shingles.
2. One scan: the shingles to be merged, packed by hash range; lists with one class are dropped.
3. Classes that share a sampled shingle are compared with one class of its list. What links is
   grouped into components; a list all of whose classes are in one component is done.
4. Of the other lists, short ones give the pairs of classes of different components, and those that
   meet in as many of them as a link needs are compared. Long ones are dealt into blocks, and every class that is not of the list's main component is searched for
   in every block.

Steps 3 and 4 compare in tasks, in blocks of at most BLOCK members, so neither a frequent shingle nor
a group of copies gathers in one task. First the smallest quarter of each set's hashes is compared:
what two sets share of it and could share beyond it bounds their overlap, and most of those that
have a passage in common drop out (`sifted`). For the others the texts are fetched: members of a
block are indexed by shingle, and each query merges its short lists and probes the long ones by
binary search (`search`).

Defined results: null, empty or blank text has the empty set and is linked with nothing; a text of
fewer than `k` words is one shingle; repeated rows and equal ids are documents of their own with the
same component where their texts agree; null ids are documents like others, and a component's id is
the smallest one that is not null, so null only where none of its documents has an id. Shingles are
64-bit hashes, classes 64-bit hashes of sorted sets. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprofile.llm import shared, textnp
from lakeprofile.llm.components import components

K = 5
PERCENT = 75
#: A shingle of so many classes is frequent; the table of frequent ones keeps the first of them.
FREQUENT = 24
FREQUENT_TABLE = 1 << 20
#: Longest list that gives pairs; members of a block.
SHORT = 64
BLOCK = 256
#: Rows of a few numbers up to which a table is broadcast to the texts; beyond, both are shuffled.
BROADCAST_ROWS = 250_000


def class_of(found: np.ndarray) -> int:
    """The class of a set, from its sorted shingles."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def required(a, b, percent: int = PERCENT):
    """Smallest overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def search(lists: np.ndarray, owner: np.ndarray, sizes: np.ndarray, query: np.ndarray,
           percent: int = PERCENT) -> np.ndarray:
    """Members that link with a query, by DivideSkip.

    lists: the members' shingles, sorted; owner: the member of each, ascending within a shingle;
    sizes: the members' set sizes. The longest lists are set aside, the rest is merged into counts,
    and members that can still reach T are probed for in the long lists.
    """
    low, high = np.searchsorted(lists, query, "left"), np.searchsorted(lists, query, "right")
    low, high = low[high > low], high[high > low]
    length = high - low
    least = -(-percent * len(query) // 100)
    if len(low) < least:
        return np.zeros(0, np.int64)
    order = np.argsort(length, kind="stable")
    low, high, length = low[order], high[order], length[order]
    # Setting a list aside pays where merging it costs more than probing the candidates for it.
    aside = min(least - 1, int(np.count_nonzero(length > 8)))
    merged = len(length) - aside
    total = int(length[:merged].sum())
    at = np.repeat(low[:merged] - np.concatenate(([0], np.cumsum(length[:merged])[:-1])), length[:merged])
    counts = np.bincount(owner[at + np.arange(total)], minlength=len(sizes))
    found = np.flatnonzero(counts >= max(1, least - aside))
    counts = counts[found]
    for i in range(merged, len(length)):
        if not len(found):
            break
        own = owner[low[i] : high[i]]
        counts += own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
        still = counts >= least - (len(length) - 1 - i)
        found, counts = found[still], counts[still]
    return found[counts >= required(len(query), sizes[found], percent)]


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.sliced(batches, 4096):
            ids, texts, th = batch.column(0), batch.column(1), batch.column(2)
            found = [s for _, s in textnp.sets(texts, k)]
            size = np.array([len(s) for s in found], np.int32)
            own = np.array([class_of(s) for s in found], np.int64)
            _, once = np.unique(own, return_index=True)  # copies count once
            every = np.concatenate([found[i] for i in once] or [np.zeros(0, np.uint64)])
            x, n = np.unique(every, return_counts=True)
            x, n = x[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([ids, pa.nulls(len(x), ids.type)]),
                    pa.concat_arrays([th, pa.nulls(len(x), th.type)]),
                    pa.array(np.concatenate((size, n.astype(np.int32)))),
                    pa.array(np.concatenate((own, x.view(np.int64)))),
                    pa.array(np.repeat([False, True], (len(ids), len(x)))),
                ],
                ["doc_id", "th", "n", "key", "counts"],
            )

    return run


def _postings(k: int, percent: int, frequent: np.ndarray, buckets: int):
    """Packs of the shingles to be merged: bucket, shingles, and whose they are."""
    width = np.uint64((1 << 64) // buckets + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            xs, owners, sizes, hot, many = [], [], [], [], 0
            for _, s in textnp.sets(batch.column(0), k):
                c = class_of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                keep = len(s) - -(-percent * len(s) // 100) + 1
                often = np.zeros(len(s), bool)
                if len(frequent):
                    often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                rare = s[~often][:keep]
                rest = s[often][: keep - len(rare)]
                xs += [rare, rest]
                hot += [np.zeros(len(rare), bool), np.ones(len(rest), bool)]
                owners.append(c)
                sizes.append(len(s))
                many += keep
                if many > 1 << 20:  # bounds what is held
                    yield from packed(xs, hot, owners, sizes)
                    xs, owners, sizes, hot, many = [], [], [], [], 0
            yield from packed(xs, hot, owners, sizes)

    def packed(xs, hot, owners, sizes):
        if not owners:
            return
        x, often = np.concatenate(xs), np.concatenate(hot)
        lengths = [len(a) + len(b) for a, b in zip(xs[::2], xs[1::2])]
        doc = np.repeat(np.arange(len(owners)), lengths)
        c, n = np.array(owners, np.int64), np.array(sizes, np.int32)
        # A frequent shingle is known to be shared: its list need not meet, and is spread.
        bucket = np.where(often, (x ^ c[doc].view(np.uint64)) % np.uint64(buckets), x // width)
        bucket = bucket.astype(np.int64) * 2 + often
        order = np.argsort(bucket, kind="stable")
        x, doc, bucket = x[order], doc[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = {"bucket": [], "often": [], "x": [], "c": [], "n": [], "many": []}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own, many = np.unique(doc[a:b], return_counts=True)
            rows["bucket"].append(int(bucket[a]) // 2)
            rows["often"].append(bool(bucket[a] & 1))
            rows["x"].append(x[a:b].tobytes())
            rows["c"].append(c[own].tobytes())
            rows["n"].append(n[own].tobytes())
            rows["many"].append(many.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_pydict(rows, PACK)

    return run


PACK = pa.schema(
    [("bucket", pa.int32()), ("often", pa.bool_())]
    + [(c, pa.binary()) for c in ("x", "c", "n", "many")]
)
PACK_DDL = "bucket int, often boolean, x binary, c binary, n binary, many binary"
LIST_DDL = "x long, c long, n int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of a hash range that two classes or more hold, with these classes."""

    def out(x, c, n):
        arrays = [pa.array(x.view(np.int64)), pa.array(c), pa.array(n)]
        return pa.RecordBatch.from_arrays(arrays, ["x", "c", "n"])

    held = []
    for batch in batches:
        for often, x, c, n, many in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            many = np.frombuffer(many, np.int32)
            x = np.frombuffer(x, np.uint64)
            c, n = np.repeat(np.frombuffer(c, np.int64), many), np.repeat(np.frombuffer(n, np.int32), many)
            if often:
                yield out(x, c, n)
            else:
                held.append((x, c, n))
    if not held:
        return
    x, c, n = (np.concatenate(a) for a in zip(*held))
    held.clear()
    order = np.lexsort((c, x))
    x, c, n = x[order], c[order], n[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (c[1:] != c[:-1])
    x, c, n = x[new], c[new], n[new]
    same = x[1:] == x[:-1]
    shared_by = np.zeros(len(x), bool)
    shared_by[1:] |= same
    shared_by[:-1] |= same
    x, c, n = x[shared_by], c[shared_by], n[shared_by]
    for i in range(0, len(x), 100_000):
        yield out(x[i : i + 100_000], c[i : i + 100_000], n[i : i + 100_000])


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts (doc_id, th, text) compressed; copies without an id come once a task."""
    pack = zstandard.ZstdCompressor(level=3)
    seen: set[int] = set()
    for batch in shared.sliced(batches):
        if batch.column(0).null_count:
            keep = []
            for key, th in zip(batch.column(0).is_valid().to_pylist(), batch.column(1).to_pylist()):
                keep.append(key or th not in seen)
                if not key:
                    seen.add(th)
            batch = batch.filter(pa.array(keep, pa.bool_()))
        z = [pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["doc_id", "th", "z"]
        )


def low_part(found: np.ndarray, percent: int) -> np.ndarray:
    """The upper halves of the smallest hashes of a set, one more than two linked sets may differ in."""
    keep = len(found) - -(-percent * len(found) // 100) + 1
    return (found[:keep] >> np.uint64(32)).astype(np.uint32)


def _with_low_parts(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in shared.sliced(batches):
            texts = pa.array([unpack.decompress(z) for z in batch.column(1).to_pylist()], pa.binary())
            found = [s for _, s in textnp.sets(texts, k)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in found], pa.int32()),
                 pa.array([low_part(s, percent).tobytes() for s in found], pa.binary())],
                ["c", "z", "n", "low"],
            )

    return run


class Sieve:
    """The low parts of a block's members, indexed by hash."""

    def __init__(self, lows: list[np.ndarray], sizes: list[int], percent: int):
        self.sizes, self.percent = np.array(sizes, np.int64), percent
        every = np.concatenate(lows)
        owner = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
        order = np.argsort(every, kind="stable")
        self.lists, self.owner = every[order], owner[order]
        self.last = np.array([x[-1] for x in lows], np.int64)
        self.beyond = self.sizes - np.array([np.searchsorted(x, x[-1]) for x in lows])

    def passes(self, low: np.ndarray, size: int) -> np.ndarray:
        """Members that a query may link with.

        All hashes of both sets below the smaller of the two last ones are in both low parts; what
        is shared of them is counted (by upper halves, so rather too much), and of the rest no more
        can be shared than the set with the smaller last one has left.
        """
        a, b = np.searchsorted(self.lists, low, "left"), np.searchsorted(self.lists, low, "right")
        many = b - a
        at = np.repeat(a - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        rest = size - int(np.searchsorted(low, low[-1]))
        most = common + np.where(self.last <= int(low[-1]), self.beyond, rest)
        large = np.maximum(self.sizes, size)
        fits = self.percent * large <= 100 * np.minimum(self.sizes, size)
        return np.flatnonzero(fits & (most >= required(size, self.sizes, self.percent)))


def _sifted(percent: int):
    """Of groups (g, salt), members first and then queries, the rows that may link with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, alive, sieve = None, [], set(), None

        def out(key, rows, query):
            columns = list(zip(*[(*key, query, c, comp) for c, comp in rows])) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
            arrays = [pa.array(list(v), t) for v, t in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, ["g", "salt", "query", "c", "comp"])

        for batch in batches:
            g, salt, query, c, comp, n, low = (batch.column(i).to_pylist() for i in range(7))
            done = []
            for i in range(len(batch)):
                if key != (g[i], salt[i]):
                    if alive:
                        done.append(out(key, [members[j][:2] for j in sorted(alive)], False))
                    key, members, alive, sieve = (g[i], salt[i]), [], set(), None
                part = np.frombuffer(low[i], np.uint32)
                if not query[i]:
                    members.append((c[i], comp[i], n[i], part))
                    continue
                if not members:
                    continue
                if sieve is None:
                    sieve = Sieve([m[3] for m in members], [m[2] for m in members], percent)
                found = [j for j in sieve.passes(part, n[i]).tolist() if members[j][1] != comp[i]]
                if found:
                    alive.update(found)
                    done.append(out(key, [(c[i], comp[i])], True))
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if alive:
            yield out(key, [members[j][:2] for j in sorted(alive)], False)

    return run


def _searched(k: int, percent: int):
    """Runs over groups (g, salt), members first and then queries.

    Of the links those come back that join components which no link of the group joined before, so
    a group gives fewer links than it has components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        key, members, index = None, [], None
        above: dict[int, int] = {}

        def root(a: int) -> int:
            while above.get(a, a) != a:
                above[a] = above.get(above[a], above[a])
                a = above[a]
            return a

        for batch in shared.sliced(batches):
            g, salt, query, c, comp = (batch.column(i).to_pylist() for i in range(5))
            texts = pa.array([unpack.decompress(z) for z in batch.column(5).to_pylist()], pa.binary())
            links = []
            for i, s in textnp.sets(texts, k):
                if key != (g[i], salt[i]):
                    key, members, index = (g[i], salt[i]), [], None
                    above.clear()
                if not query[i]:
                    members.append((c[i], comp[i], s))
                    continue
                if not members:
                    continue
                if index is None:
                    sizes = np.array([len(m[2]) for m in members])
                    every = np.concatenate([m[2] for m in members])
                    owner = np.repeat(np.arange(len(members)), sizes)
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], sizes
                for j in search(*index, s, percent).tolist():
                    other, group, _ = members[j]
                    a, b = root(comp[i]), root(group)
                    if a != b:
                        above[max(a, b)] = min(a, b)
                        links.append((c[i], other))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["u", "v"]
            )

    return run


def _search_in(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links from rows (g, salt, query, c, comp), whose texts are joined by class."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ("g", "salt")
    groups = shared.cut(groups, "groups")
    rows = texts.select("c", "n", "low").join(_small(groups), "c")
    rows = rows.select(*by, "query", "c", "comp", "n", "low")
    rows = rows.repartition(n, *by).sortWithinPartitions(*by, "query")
    ddl = "g long, salt int, query boolean, c long, comp long"
    left = shared.cut(rows.mapInArrow(_sifted(percent), ddl), "sifted")
    rows = texts.select("c", "z").join(_small(left), "c").select(*by, "query", "c", "comp", "z")
    return (
        rows.repartition(n, *by)
        .sortWithinPartitions(*by, "query")
        .mapInArrow(_searched(k, percent), "u long, v long")
    )


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Which pairs (a, b) of classes link; partners of one class are dealt into blocks."""
    many = pairs.groupBy(F.col("a").alias("g")).agg(F.count("*").alias("many"))
    members = pairs.join(many, F.col("a") == F.col("g")).select(
        "g", F.pmod(F.xxhash64("b"), F.ceil(F.col("many") / BLOCK)).cast("int").alias("salt"),
        F.lit(False).alias("query"), F.col("b").alias("c"), F.col("b").alias("comp"),
    )
    queries = members.select("g", "salt").distinct().select(
        "g", "salt", F.lit(True).alias("query"), F.col("g").alias("c"), F.col("g").alias("comp")
    )
    return _search_in(members.unionByName(queries), texts, k, percent)


def similar_sizes(a: str, b: str, percent: int):
    return F.lit(percent) * F.greatest(a, b) <= F.lit(100) * F.least(a, b)


def smallest_id():
    """(gone, doc_id, th): its minimum is the row with the smallest id, null coming last."""
    return F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "th")


def _linked(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component (a class of it; null for the empty set)
    and component_id for rows (doc_id, text)."""
    spark = rows.sparkSession
    id_type = rows.schema["doc_id"].dataType.simpleString()
    hashed = rows.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    signs = shared.cut(
        hashed.mapInArrow(
            _signatures(k), f"doc_id {id_type}, th long, n int, key long, counts boolean"
        ),
        "signs",
    )
    own = signs.where("not counts").select("doc_id", "th", "n", F.col("key").alias("c"))
    classes = shared.cut(
        own.where("n > 0").groupBy("c").agg(F.min(smallest_id()).alias("rep"), F.max("n").alias("n")),
        "classes",
    )
    top = (
        signs.where("counts").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "key").limit(FREQUENT_TABLE)
    )
    frequent = np.sort(np.array([r[0] for r in top.select("key").collect()], np.int64).view(np.uint64))
    buckets = shared.parts(spark, own.count(), 5000)
    packs = rows.select("text").mapInArrow(_postings(k, percent, frequent, buckets), PACK_DDL)
    lists = shared.cut(packs.repartition(buckets, "bucket").mapInArrow(_lists, LIST_DDL), "lists")

    def packed(which: str) -> DataFrame:
        found = hashed.where(which).select("doc_id", "th", "text")
        return found.mapInArrow(_compressed, f"doc_id {id_type}, th long, z binary")

    wanted = lists.select("c").distinct().join(classes, "c")
    wanted = wanted.select("c", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    texts = packed("doc_id is not null").join(wanted, ["doc_id", "th"]).select("c", "z")
    # Classes none of whose documents has an id.
    bare = packed("doc_id is null").drop("doc_id").join(wanted.where("doc_id is null").drop("doc_id"), "th")
    texts = texts.unionByName(bare.groupBy("c").agg(F.first("z").alias("z")))
    texts = shared.cut(
        texts.mapInArrow(_with_low_parts(k, percent), "c long, z binary, n int, low binary"), "texts"
    )

    # Step 3: a sixteenth of the shingles, each class of a list against the first one.
    sampled = lists.where("pmod(x, 16) = 0")
    first = sampled.groupBy("x").agg(F.min(F.struct("c", "n")).alias("f"))
    stars = (
        sampled.join(first, "x")
        .where((F.col("c") != F.col("f.c")) & similar_sizes("n", "f.n", percent))
        .select(F.col("f.c").alias("a"), F.col("c").alias("b"))
        .distinct()
    )
    links = shared.cut(_compare(shared.cut(stars, "stars"), texts, k, percent), "links")
    known = components(links).select(F.col("node").alias("c"), F.col("component").alias("comp"))

    # Step 4: lists that still hold classes of different components.
    placed = lists.join(known, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    placed = shared.cut(placed, "placed")
    by = placed.groupBy("x").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    left = shared.cut(placed.join(by.where("lo < hi").select("x", "m"), "x"), "open")
    short = left.where(F.col("m") <= SHORT).groupBy("x").agg(
        F.sort_array(F.collect_list(F.struct("c", "n", "comp"))).alias("l")
    )
    pairs = F.flatten(
        F.transform(
            "l",
            lambda a, i: F.transform(
                F.filter(
                    F.slice("l", i + 2, F.size("l")),
                    lambda b: (b["comp"] != a["comp"])
                    & (F.lit(percent) * F.greatest(a["n"], b["n"]) <= F.lit(100) * F.least(a["n"], b["n"])),
                ),
                lambda b: F.struct(
                    a["c"].alias("a"), b["c"].alias("b"), a["n"].alias("na"), b["n"].alias("nb")
                ),
            ),
        )
    )
    # T-occurrence: a pair that links shares so many of the merged shingles, less those in the long
    # lists of either, which are not merged here.
    long_lists = left.where(F.col("m") > SHORT).groupBy("c").agg(F.count("*").alias("long"))
    pairs = short.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b", "p.na", "p.nb").agg(
        F.count("*").alias("common")
    )
    for end in ("a", "b"):
        lists_of = long_lists.select(F.col("c").alias(end), F.col("long").alias(f"long_{end}"))
        pairs = pairs.join(lists_of, end, "left").fillna(0, [f"long_{end}"])
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    spare = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1
    aside = F.least("long_a", "long_b")
    pairs = pairs.where(F.col("common") >= need - spare - aside).select("a", "b")
    more = _compare(shared.cut(pairs, "pairs"), texts, k, percent)

    long = left.where(F.col("m") > SHORT)
    main = (
        long.groupBy("x", "comp").agg(F.count("*").alias("n")).groupBy("x")
        .agg(F.max_by("comp", F.struct("n", "comp")).alias("g"))
    )
    members = shared.cut(long.join(main, "x").select("g", "c", "comp").distinct(), "members")
    many = members.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(many, "g")
    blocks = dealt.select("g", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("salt"),
                          F.lit(False).alias("query"), "c", "comp")
    queries = dealt.where("comp <> g").select(
        "g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"),
        F.lit(True).alias("query"), "c", "comp",
    )
    rest = _search_in(blocks.unionByName(queries), texts, k, percent)

    named = classes.select("c", F.col("rep.doc_id").alias("doc_id"))
    found = components(links.unionByName(more).unionByName(rest).distinct())
    joined = shared.cut(found.join(named, F.col("node") == F.col("c")).drop("node"), "joined")
    ids = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = joined.join(ids, "component").select("c", "component", "component_id")
    groups = named.join(joined, "c", "left").select(
        "c", F.coalesce("component", "c").alias("component"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
    return own.join(groups, "c", "left").select(
        "doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def linked(
    docs: DataFrame,
    k: int = K,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    Equal component_ids are one component unless ids repeat or are null.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return _linked(rows, k, percent).drop("th", "component")


def representatives(
    docs: DataFrame,
    k: int = K,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of docs with one document of each component, that with the smallest id; texts without
    words all stay. A null id counts as the largest. Of rows with this id the one with the smallest text
    hash stays."""
    names = docs.columns
    id_column, text_column = (f"c{names.index(c)}" for c in (id_column, text_column))
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # whatever they are called
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = shared.cut(_linked(rows, k, percent), "linked")
    first = found.where("n_shingles > 0").groupBy("component").agg(F.min(smallest_id()).alias("rep"))
    empty = found.where("n_shingles = 0").select("doc_id", "th").distinct()
    stay = first.select(
        F.col("rep.doc_id").alias("__id"), F.col("rep.th").alias("__th"), F.lit(True).alias("__once")
    )
    stay = stay.unionByName(
        empty.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.lit(False).alias("__once"))
    )
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    hashed = shared.packed(hashed, text_column)
    same = (F.col(id_column).eqNullSafe(F.col("__id"))) & (F.col("__h") == F.col("__th"))
    kept = hashed.join(stay, same)
    order = Window.partitionBy("__id", "__th", "__once").orderBy("__h")
    kept = kept.withColumn("__row", F.row_number().over(order)).where("not __once or __row = 1")
    return shared.unpacked(kept.select(*docs.columns), text_column, docs.schema).toDF(*names)
