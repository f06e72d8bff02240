"""Exact join of documents whose word shingles have a Jaccard likeness of 80 percent or more.

Documents with equal sets are one class from the start.  For a likeness of t, two linked sets
share m tokens among the first n - ceil(t n) + m of each, in any fixed order of tokens (prefix filter; m is
``shared_needed``, a twentieth of the set).  Tokens that many prefixes hold go last in that order, so shared passages
rarely lie in a prefix, and a class that shares fewer tokens than that with all others is alone.

Token-group matrix:
1. Each class meets those classes that are next to it, or hubs, in most lists of its prefix tokens (``BEST`` of them).
   The verified links make components.
2. Classes that best neighbours connect are partitioned into groups of about ``GROUP``.  The matrix holds each group's union of prefix
   tokens, from which the overlap of two groups' members is bounded, together with the most that a member can share.
3. Only qualifying pairs of groups are opened.  Their members of different components and fitting sizes are compared by
   bit maps, which rule out most, and what is left in full.
Links inside a component need no check, as the result is the component; no list of a token is ever paired with itself in full.

Null or empty text and text without words: the empty set, linked with nothing, its own component.
Repeated rows are members of one class.  A null id takes the component of its class; the component of texts that all have
null ids has a null id, and ``label`` tells such components apart.  Empty tables give empty results.  Other columns are ignored.  Sets are 64-bit hashes of shingles, classes 128-bit hashes of sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sizing import lookup_join
from .common import map_rows, written
from .graphs import components
from .shingles import set_id, shingle_set

PERCENT = 80
WORDS = 5
#: Members of one group of the matrix.
GROUP = 64
#: A token in this many prefixes goes last; at most MAX_LATE such tokens are known (8 bytes each, broadcast).
#: Both only steer work: any order of tokens gives the same links.
LATE, MAX_LATE = 4, 1_000_000
#: Neighbours and hubs in each list that count, and classes that a class is compared with at first.
NEIGHBOURS, HUBS, BEST = 2, 2, 8
#: A class of more than this share of all rows is joined by broadcast: at most 1 / HOT of them exist.
HOT = 1e-3
#: Classes that a task remembers in order to skip their copies.
SEEN = 500_000


def shared_needed(n, floor=int):
    """Tokens that the prefixes of a set of n and of a larger linked one share at least."""
    return floor(n / 20) + 1


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + shared_needed(n)


def _prefix(members: np.ndarray, late: np.ndarray | None, percent: int) -> np.ndarray:
    size = prefix_size(len(members), percent)
    if late is None or not len(late):
        return members[:size]
    at = np.minimum(np.searchsorted(late, members), len(late) - 1)
    last = late[at] == members
    early = members[~last][:size]
    return early if len(early) == size else np.concatenate([early, members[last][: size - len(early)]])


def set_rows(docs: DataFrame, text: str, id_col: str, percent: int, words: int, late=None, once: bool = False) -> DataFrame:
    """doc_id, n, class, prefix and, of a null id, text hash of every document; with ``once`` a task gives a class it has seen
    no second time."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[bytes] = set()
        last = None if late is None else late.value
        for doc_id, body, key in rows:
            members = shingle_set(body, words)
            if not len(members):
                yield doc_id, 0, None, [], key
                continue
            name = set_id(members)
            if once:
                if name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
            yield doc_id, len(members), name, _prefix(members, last, percent).view(np.int64).tolist(), key

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text, text_key(id_col, text))
    return map_rows(rows, run, "doc_id long, n long, s binary, prefix array<long>, key long", lambda r: 60 + 8 * len(r[3]))


def text_key(id_col: str, text: str) -> Column:
    """What a row with a null id is fetched by: a hash of its text; null for other rows."""
    return F.when(F.col(id_col).cast("long").isNull(), F.xxhash64(text)).alias("key")


def late_tokens(rows: DataFrame):
    """Broadcast of the sorted tokens that most prefixes hold."""
    spark = rows.sparkSession
    counts = rows.select(F.explode("prefix").alias("t")).groupBy("t").count().where(F.col("count") >= LATE)
    most = counts.orderBy(F.desc("count"), "t").limit(MAX_LATE).select("t").toPandas()["t"]  # bounded
    return spark.sparkContext.broadcast(np.sort(most.to_numpy(dtype=np.int64).view(np.uint64)))


def shared_tokens(docs: DataFrame, late, text: str, id_col: str, percent: int, words: int) -> DataFrame:
    """Prefix tokens (t) of classes (s, n) that two or more classes hold, and o, the most tokens that s can share with any class.

    Prefix tokens that no other class holds are shared with none, which bounds o.
    """
    rows = set_rows(docs, text, id_col, percent, words, late, once=True).where("n > 0")
    lists = rows.select(F.explode("prefix").alias("t"), "s", "n")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    once = lists.repartition(parts, "t").dropDuplicates(["t", "s"])
    counted = once.withColumn("c", F.count("*").over(Window.partitionBy("t")))
    shared = written(counted.where("c > 1").select("t", "s", "n"), "ngram-shared")
    alone = F.lit(-1) * F.floor(F.col("n") * -percent / 100)  # ceil(t n)
    held = shared.groupBy("s").agg(F.count("*").alias("c"), F.first("n").alias("n")).select(
        "s", "c", "n", (alone - F.floor(F.col("n") / 20) - 1 + F.col("c")).cast("long").alias("o"))  # n - prefix + shared
    enough = held.where((F.col("c") >= _least(F.col("n"), percent)) & (100 * F.col("o") >= percent * F.col("n")))
    return written(shared.join(enough.select("s", "o"), "s"), "ngram-shared")


def _overlap(small: Column, large: Column, percent: int) -> Column:
    """Least overlap at which sets of these sizes are linked."""
    return F.ceil((small + large) * percent / (100 + percent))


def _least(n: Column, percent: int) -> Column:
    """Tokens that a set of n shares with any linked one: those of the smallest that fits."""
    return F.floor(F.ceil(n * percent / 100) / 20) + 1


def class_sets(docs: DataFrame, wanted: DataFrame, text: str, id_col: str, words: int) -> DataFrame:
    """The full sets of the wanted classes (s, rid: their smallest id, or key: a text hash, when all their ids are null); a
    repeated row may give one a second time."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen: set[bytes] = set()
        for (body,) in rows:
            members = shingle_set(body, words)
            name = set_id(members)
            if name in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
            yield name, members.view(np.int64).tolist(), len(members), bit_map(members)

    texts = lookup_join(docs.select(F.col(id_col).cast("long").alias("rid"), F.col(text).alias("_text")),
                        wanted.where("rid IS NOT NULL").select("rid").distinct(), ["rid"], "left_semi")
    unnamed = lookup_join(docs.select(text_key(id_col, text), F.col(text).alias("_text")).where("key IS NOT NULL"),
                          wanted.where("rid IS NULL").select("key").distinct(), ["key"], "left_semi")
    made = map_rows(texts.select("_text").union(unnamed.select("_text")), run, "s binary, members array<long>, n long, bits binary", lambda r: 60 + 9 * len(r[1]))
    return written(made, "ngram-sets")


def bit_map(members: np.ndarray) -> bytes:
    """Which of at least 4 n ranges of hashes hold a member; the number of ranges is a power of two."""
    width = max(6, int(4 * len(members) - 1).bit_length())
    marks = np.zeros(1 << width, dtype=bool)
    marks[(members >> np.uint64(64 - width)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


@lru_cache(maxsize=2048)
def _marks(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)


def most_common(na: int, a: bytes, nb: int, b: bytes) -> int:
    """Upper bound of the overlap of two sets, from their bit maps: members in ranges that are empty in the other set are not shared."""
    x, y = _marks(a), _marks(b)
    size = min(len(x), len(y))
    x, y = (v if len(v) == size else v.reshape(size, -1).any(axis=1) for v in (x, y))
    return min(na - int((x & ~y).sum()), nb - int((y & ~x).sum()))


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bit maps do not rule out."""
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b, na, x, nb, y in rows:
            c = most_common(na, x, nb, y)
            if 100 * c >= percent * (na + nb - c):
                yield a, b

    left = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "x", "nb", "y")
    return written(map_rows(both, run, "a binary, b binary").distinct(), "ngram-pairs")


def _fits(na: str, oa: str, nb: str, ob: str, percent: int) -> Column:
    """Sizes, and the most that each can share, allow a link."""
    return F.least(oa, ob, na, nb) >= _overlap(F.col(na), F.col(nb), percent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left = sets.select(F.col("s").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", common.alias("c"), F.size("x").alias("na"), F.size("y").alias("nb")).where(
        F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b").distinct()


def neighbours(shared: DataFrame, percent: int) -> DataFrame:
    """For each class s, the classes y that are next to it, or hubs, in most of its lists, with their rank r.

    The hubs of a list are the classes that can share most tokens: the plain version among edited copies, for one.
    """
    next_to, open_most = Window.partitionBy("t").orderBy("n", "s"), Window.partitionBy("t").orderBy(F.desc("o"), "s")
    whole = open_most.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("s", "n", "o")
    near = shared.select("n", "s", "o", *[F.lead(one, k).over(next_to).alias(f"k{k}") for k in range(1, NEIGHBOURS + 1)],
                         *[F.nth_value(one, k).over(whole).alias(f"h{k}") for k in range(1, HUBS + 1)])
    steps = [f"k{k}" for k in range(1, NEIGHBOURS + 1)] + [f"h{k}" for k in range(1, HUBS + 1)]
    out = near.select("s", "n", "o", F.explode(F.array_compact(F.array(*steps))).alias("x"))
    met = out.where((F.col("s") != F.col("x.s")) & _fits("n", "o", "x.n", "x.o", percent)).groupBy("s", F.col("x.s").alias("y")).count()
    # BEST of those a class met; a hub is met by many, but meets few itself
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy(F.desc("count"), "y"))).where(F.col("r") <= BEST)
    return written(best.select("s", "y", "r"), "ngram-neighbours")


def grouped(shared: DataFrame, near: DataFrame, labels: DataFrame) -> DataFrame:
    """Each class (s, n, o) with its label and its group g: classes that best neighbours connect, in blocks of GROUP."""
    best = components(near.where("r = 1").select(F.col("s").alias("a"), F.col("y").alias("b"))).select(
        F.col("v").alias("s"), F.col("label").alias("family"))
    classes = shared.select("s", "n", "o").distinct().join(best, "s", "left").withColumn("family", F.coalesce("family", "s"))
    sizes = classes.groupBy("family").agg(F.count("*").alias("size"))
    named = classes.join(sizes, "family").join(labels.withColumnRenamed("v", "s"), "s", "left")
    block = F.pmod(F.xxhash64("s"), F.ceil(F.col("size") / GROUP))
    return written(named.select("s", "n", "o", F.coalesce("label", "s").alias("label"), F.xxhash64("family", block).alias("g")), "ngram-groups")


def qualifying(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups (g, h) whose members may be linked, by the matrix of tokens and groups."""
    kinds = classes.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("o").alias("top"),
                                     F.min("label").alias("first"), F.max("label").alias("last"))
    matrix = written(shared.select("t", "s").join(classes.select("s", "g"), "s").select("t", "g").distinct().join(kinds, "g"), "ngram-matrix")
    other = matrix.select("t", *[F.col(c).alias(f"{c}_") for c in ("g", "low", "high", "top", "first", "last")])
    several = (F.least("first", "first_") != F.greatest("last", "last_"))  # more than one component
    may_fit = F.least("top", "top_", "high", "high_") >= _overlap(F.col("low"), F.col("low_"), percent)
    met = matrix.join(other, "t").where((F.col("g") <= F.col("g_")) & several & may_fit)
    shares = met.groupBy("g", F.col("g_").alias("h")).agg(
        F.count("*").alias("overlap"), F.first(shared_needed(F.least("low", "low_"), F.floor)).alias("need"))
    return shares.where("overlap >= need").select("g", "h")


class _Group:
    """Members of a group as arrays, with their bit maps by width."""

    def __init__(self, members: list[dict]):
        self.names = [m["s"] for m in members]
        self.n, self.o = (np.array([m[c] for m in members], dtype=np.int64) for c in ("n", "o"))
        self.labels = np.array([m["label"] for m in members], dtype="S16")
        self.widths = np.array([len(m["bits"]) for m in members])
        self.bits = [m["bits"] for m in members]
        self._folded: dict[tuple[int, int], np.ndarray] = {}

    def folded(self, width: int, to: int) -> np.ndarray:
        """Bit maps of the members of one width, folded to ``to`` bytes."""
        if (width, to) not in self._folded:
            rows = np.frombuffer(b"".join(b for b in self.bits if len(b) == width), dtype=np.uint8).reshape(-1, width)
            if to < width:
                marks = np.unpackbits(rows, axis=1).reshape(len(rows), to * 8, -1).any(axis=2)
                rows = np.packbits(marks, axis=1)
            self._folded[width, to] = rows
        return self._folded[width, to]


def linkable(a: _Group, b: _Group, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of members of different components that sizes and bit maps do not rule out."""
    for width in np.unique(b.widths):
        at = np.flatnonzero(b.widths == width)
        for i in range(len(a.names)):
            need = -(-(a.n[i] + b.n[at]) * percent // (100 + percent))
            ok = (np.minimum(np.minimum(a.n[i], a.o[i]), np.minimum(b.n[at], b.o[at])) >= need) & (b.labels[at] != a.labels[i])
            if not ok.any():
                continue
            size = min(int(width), len(a.bits[i]))
            mine = a.folded(len(a.bits[i]), size)[int((a.widths[:i] == a.widths[i]).sum())]
            theirs = b.folded(int(width), size)[ok]
            lost_a = np.bitwise_count(mine & ~theirs).sum(axis=1)
            lost_b = np.bitwise_count(theirs & ~mine).sum(axis=1)
            found = np.minimum(a.n[i] - lost_a, b.n[at][ok] - lost_b) >= need[ok]
            for j in at[ok][found]:
                yield a.names[i], b.names[j]


def open_groups(shared: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that may link, of members of qualifying groups.

    A group travels as one row, so pairs that bit maps rule out are never rows.
    """
    members = classes.join(sets.select("s", "bits"), "s").dropDuplicates(["s"])
    groups = members.groupBy("g").agg(F.collect_list(F.struct("s", "n", "o", "label", "bits")).alias("a"))  # about GROUP members
    both = qualifying(shared, classes, percent).join(groups, "g").join(groups.select(F.col("g").alias("h"), F.col("a").alias("b")), "h")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for a, b in rows:
            yield from linkable(_Group(a), _Group(b), percent)

    pairs = map_rows(both.select("a", "b"), run, "a binary, b binary")
    return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-pairs")


def find_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, ``s``, its class, ``label``, the class that names its component,
    and ``key``, the text hash of a null id."""
    first = written(set_rows(docs, text, id_col, percent, words), "ngram-rows")
    late = late_tokens(first)
    shared = shared_tokens(docs, late, text, id_col, percent, words)
    classes = first.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("rid"), F.min("key").alias("key"), F.count("*").alias("copies"))
    wanted = written(shared.select("s").distinct().join(classes, "s"), "ngram-wanted")
    sets = class_sets(docs, wanted, text, id_col, words)
    near = neighbours(shared, percent)
    pairs = near.select(F.least("s", "y").alias("a"), F.greatest("s", "y").alias("b")).distinct()
    links = written(verify(may_link(pairs, sets, percent), sets, percent), "ngram-links")
    classes_in = grouped(shared, near, components(links))
    more = written(verify(open_groups(shared, classes_in, sets, percent), sets, percent), "ngram-links")
    labels = components(links.union(more))
    known = classes.join(labels.withColumnRenamed("v", "s"), "s", "left").withColumn("label", F.coalesce("label", "s"))
    roots = known.groupBy("label").agg(F.min("rid").alias("component_id"))
    told = known.join(roots, "label").where("copies > 1 OR component_id <> rid OR rid IS NULL")  # others are alone
    linked = written(told.select("s", "copies", "component_id", "label"), "ngram-classes")
    return with_classes(first.select("doc_id", "n", "s", "key"), linked)


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Give each document the component of its class; classes with very many rows are joined by broadcast."""
    total = rows.count()
    hot = classes.where(F.col("copies") > max(2.0, total * HOT)).select("s", F.col("component_id").alias("_hot"), F.col("label").alias("_hot_label"))
    some = rows.join(F.broadcast(hot), "s", "left")
    spread = F.when(F.col("_hot").isNull() & F.col("s").isNotNull(), F.col("s")).otherwise(
        F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rest = classes.where(F.col("copies") <= max(2.0, total * HOT)).select(F.col("s").alias("_key"), F.col("component_id").alias("_cold"), F.col("label").alias("_cold_label"))
    out = some.withColumn("_key", spread).join(rest, "_key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.coalesce("_hot", "_cold", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "s",
                      F.coalesce("_hot_label", "_cold_label", "s").alias("label"), "key")
