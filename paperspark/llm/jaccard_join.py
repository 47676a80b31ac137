"""N-gram Jaccard join by grouped prefixes.

Documents with the same shingle set are one class. The shingles of a class
are ordered by the size of their bucket in a fixed-size count of all
shingles, rarest first; two classes can only be similar if their prefixes in
this order share a shingle. Classes with the same prefix and size form one
group, so postings and the size and position filters work on groups, and
group pairs that remain are expanded to members and verified on whole sets.

Only components are asked for, so pairs that are already connected need no
test. A few rounds compare the groups of each posting list with one of them,
another one each time. Lists with few pairs left in different components are
then compared exhaustively. In a longer one every class is compared with one
of the list, its pivot, and what it differs by from the pivot is its new set:
two sets differ by what their differences differ by, so edits that two near
copies do not share set them apart, however much they have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperspark.llm.common import (
    byte_words, gram_hashes, join_by_id, mixed, staged, sum_vectors, word_hashes,
)
from paperspark.llm.components import components

SHINGLE_WORDS = 3
# Similarity in percent: link where 100 x intersection >= PERCENT x union.
PERCENT = 90
# Buckets of the shingle count; its size does not depend on the data.
BUCKET_BITS = 22
BUCKETS = 1 << BUCKET_BITS
PARTS = 64
ROUNDS = 2
# A list is compared exhaustively up to so many pairs (rows outside its largest
# component times its length); longer ones first by so many levels of pivots.
FEW_PAIRS = 1024
LEVELS = 2


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; with fewer
    words the whole sequence is the only shingle, without words none."""
    words = word_hashes(byte_words(text))
    if not len(words):
        return words
    if len(words) < n:
        return mixed(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, n))


def bucket_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """Documents per bucket of shingles, over all documents (a task counts a
    bucket 65,535 times at most; only the order depends on it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, bucket_of(shingle_set(text, shingle_words)), 1)
        parts = np.minimum(total, 65535).astype("<u2").reshape(PARTS, -1)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
            names=["part", "vector"])

    total = np.zeros((PARTS, BUCKETS // PARTS), np.uint32)
    sums = sum_vectors(docs.select("text").mapInArrow(run, "part int, vector binary"), "<u2", "<u4")
    for row in sums.collect():  # vectors of fixed size
        total[row["part"]] = np.frombuffer(row["vector"], "<u4")
    return total.ravel()


def signatures(docs: DataFrame, rank, percent: int, shingle_words: int) -> DataFrame:
    """``doc_id, n, key, prefix``: set size, a 128-bit digest of the set
    (null: empty set), and the prefix in order of ``rank`` (the broadcast
    counts), then hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, prefix = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, shingle_words)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                long = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                # Order by bucket size, then hash.
                size = rank.value[bucket_of(s)]
                if long < len(s):
                    near = np.flatnonzero(size <= np.partition(size, long - 1)[long - 1])
                else:
                    near = np.arange(len(s))
                order = near[np.lexsort((s[near], size[near]))][:long]
                prefix.append(s[order].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "prefix"])

    return staged(docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n bigint, key binary, prefix array<bigint>"), "signatures")


def most_common(x: np.ndarray, y: np.ndarray, nx: int, ny: int, rank: np.ndarray) -> int:
    """The most shingles that two sets can share, given their prefixes. A
    shingle of one prefix that is missing from the other, though the other
    reaches beyond it in the order, is missing from the whole set."""
    def missing(a: np.ndarray, b: np.ndarray) -> int:
        size, last = rank[bucket_of(a)], rank[bucket_of(b[-1:])][0]
        within = (size < last) | ((size == last) & (a <= b[-1]))
        return int((within & ~np.isin(a, b)).sum())

    return min(nx - missing(x, y), ny - missing(y, x))


def possible(pairs: DataFrame, classes: DataFrame, rank, percent: int) -> DataFrame:
    """``a, b, ok``: whether the prefixes of a pair leave it a chance."""
    sides = [classes.select(F.col("rep").alias(t), F.col("n").alias(f"n_{t}"), F.col("prefix").alias(f"prefix_{t}"))
             for t in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for nx, x, ny, y in zip(*(batch.column(c) for c in ("n_a", "prefix_a", "n_b", "prefix_b"))):
                nx, ny = nx.as_py(), ny.as_py()
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                ok.append((100 + percent) * most_common(x, y, nx, ny, rank.value) >= percent * (nx + ny))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select(
        "a", "b", "n_a", "prefix_a", "n_b", "prefix_b")
    return staged(joined.mapInArrow(run, "a bigint, b bigint, ok boolean"), "possible")


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rank, percent: int,
             shingle_words: int) -> DataFrame:
    """``a, b, linked`` of ``pairs(a, b)`` of class names, staged. Pairs that
    their prefixes leave a chance are compared by whole sets; the set of
    ``a`` travels once per pair, that of ``b`` once."""
    filtered = possible(pairs, classes, rank, percent)
    done = compared(docs, filtered.where("ok").select("a", "b"), percent, shingle_words)
    return done.unionByName(filtered.where("NOT ok").withColumnRenamed("ok", "linked"))


def compared(docs: DataFrame, pairs: DataFrame, percent: int, shingle_words: int,
             differences: bool = False) -> DataFrame:
    """``a, b, linked`` of ``pairs(a, b)`` by whole sets, staged. With
    ``differences`` also ``n``, the size of the set of ``a``, digests ``own``
    and ``pivot`` of both sets, and ``diff``, what only one of them holds."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, shingle_words).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            for a in range(0, max(1, len(found)), 200):
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(found[a:a + 200], pa.binary())],
                    names=[*batch.schema.names[:-1], "shingles"])

    left = join_by_id(docs.select(F.col("doc_id").alias("a"), "text"), pairs, "a").select(
        "a", "b", "text").mapInArrow(sets, "a bigint, b bigint, shingles binary")
    right = join_by_id(docs.select(F.col("doc_id").alias("b"), "text"), pairs.select("b").distinct(), "b").select(
        "b", "text").mapInArrow(sets, "b bigint, shingles binary").withColumnRenamed("shingles", "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, n, own, pivot, diff = [], [], [], [], []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                if differences:
                    n.append(len(x))
                    own.append(xxhash.xxh3_128_digest(left))
                    pivot.append(xxhash.xxh3_128_digest(right))
                    diff.append(np.setxor1d(x, y, assume_unique=True).astype(np.int64))
            more = [pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(pivot, pa.binary()),
                    pa.array(diff, pa.list_(pa.int64()))] if differences else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), *more],
                names=["a", "b", "linked", *["n", "own", "pivot", "diff"][:len(more)]])

    schema = "a bigint, b bigint, linked boolean"
    if differences:
        schema += ", n bigint, own binary, pivot binary, diff array<bigint>"
    joined = left.join(right, "b").select("a", "b", "shingles", "other")
    return staged(joined.mapInArrow(compare, schema), "verified")


def may_link(x: str, y: str, percent: int):
    """Size and position filters for two postings of one shingle. A pair is
    sought by the first shingle its prefixes share: none before it is common,
    so no more can be than are left from there on."""
    nx, ny, px, py = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (x, y))
    most = F.least(nx - px, ny - py)
    return ((100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
            & ((100 + percent) * most >= percent * (nx + ny)))


def may_differ(x: str, y: str, percent: int):
    """The same for two postings of one element of differences from a pivot:
    sets link if their differences, of sizes ``s``, differ by little enough."""
    nx, ny, sx, sy, px, py = (F.col(f"{t}.{c}") for c in ("n", "s", "pos") for t in (x, y))
    most = F.least(sx - px, sy - py)
    return (100 + percent) * (sx + sy - 2 * most) <= (100 - percent) * (nx + ny)


def difference_lists(found: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, s, pos``: postings of the prefixes of differences
    from a pivot, rarest elements among those of the pivot first.

    Sets of sizes n and m link if they differ by (n + m)(100 - P) / (100 + P)
    at most, so by n (100 - P) / P. If the sizes of their differences add up
    to no more, both link to the pivot. Otherwise the differences share an
    element, and one of the first n (100 - P) / P + 1 of either."""
    found = found.dropDuplicates(["pivot", "own", "a"]).select(
        "pivot", "own", F.col("a").alias("node"), "n", F.size("diff").cast("long").alias("s"),
        F.explode("diff").alias("e"))
    counts = staged(found.groupBy("pivot", "e").agg(F.count("*").alias("c")), "counts")
    order = Window.partitionBy("pivot", "own", "node").orderBy("c", "e")
    placed = found.join(counts, ["pivot", "e"]).withColumn("pos", F.row_number().over(order).cast("long") - 1)
    return staged(placed.where((percent * F.col("pos") <= (100 - percent) * F.col("n")) & (F.col("c") > 1)).select(
        F.xxhash64("pivot", "e").alias("token"), "node", "n", "s", "pos"), "differences")


def untested(pairs: DataFrame, tested: list[DataFrame]) -> DataFrame:
    """Distinct pairs in ascending order that no earlier round has tested."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for t in tested:
        pairs = pairs.join(t.select("a", "b"), ["a", "b"], "left_anti")
    return pairs


def with_component(rows: DataFrame, comp: DataFrame | None, on: str) -> DataFrame:
    """``rows`` with ``comp``, the component of the class in column ``on``."""
    if comp is None:
        return rows.withColumn("comp", F.col(on))
    found = comp.select(F.col("node").alias(on), F.col("component").alias("__c"))
    return rows.join(found, on, "left").withColumn("comp", F.coalesce("__c", F.col(on))).drop("__c")


def rest_rows(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` of the tokens that still have several components, with the
    largest of them as ``big``, and ``pairs``, the rows outside it times all.
    Positions of a pair add up to n (100 - P) / P at most, or neither filter
    lets it pass; rows that no other of their token leaves a chance go."""
    lowest = rows.groupBy("token").agg(
        F.min("pos").alias("lowest"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    lowest = staged(lowest.where("lo != hi").select("token", "lowest"), "lowest")
    rows = staged(rows.join(lowest, "token").where(
        percent * (F.col("pos") + F.col("lowest")) <= (100 - percent) * F.col("n")).drop("lowest"), "rest")
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("token").agg(
        F.max(F.struct("c", "comp"))["comp"].alias("big"), F.count("*").alias("k"),
        ((F.sum("c") - F.max("c")) * F.sum("c")).alias("pairs"))
    return staged(rows.join(staged(largest.where("k > 1").drop("k"), "largest"), "token"), "rest")


def rest_pairs(rows: DataFrame, may, percent: int) -> DataFrame:
    """Pairs of rows of one token in different components. One side leaves out
    the token's largest component, so a list that is nearly connected costs
    its stragglers times its length."""
    x, y = rows.where("comp != big").alias("x"), rows.alias("y")
    return x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.comp") != F.col("y.comp"))
        & ((F.col("y.comp") == F.col("y.big")) | (F.col("x.node") < F.col("y.node"))) & may("x", "y", percent)
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def similar_components(docs: DataFrame, percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS,
                       id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Null or wordless texts have an empty set and link with nothing. Rows that
    repeat an id stay repeated; their texts belong to one node. Ids are
    integers; a row without an id has no component. Other columns are
    ignored. The shingle hash has 64 bits.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rank = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, shingle_words))
    sign = signatures(docs, rank, percent, shingle_words)
    # Classes of equal sets, named after their least document, then groups of
    # classes with equal size and prefix, named after their least class.
    classes = staged(sign.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "classes")
    groups = staged(classes.groupBy("n", "prefix").agg(F.min("rep").alias("gid"), F.count("*").alias("size")), "groups")
    posts = groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
    # What is grouped by a key is staged before it is joined on that key, so
    # that the join shuffles both sides by itself and can split a hot key.
    shared = staged(posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"), "shared")
    lists = staged(posts.join(shared, "token"), "lists")
    crowded = classes.select("rep", "n", "prefix").join(groups.where("size > 1"), ["n", "prefix"]).select("gid", "rep")
    crowded = staged(crowded, "crowded")

    tested: list[DataFrame] = []
    comp = None
    for r in range(rounds):
        rows = with_component(lists, comp, "gid")
        star = rows.groupBy("token").agg(
            F.min(F.struct(F.xxhash64("gid", "token", F.lit(r)).alias("h"), "gid", "n", "pos", "comp")).alias("s"),
            F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("token", "s.*")
        star = staged(star, "star")
        near = rows.alias("x").join(star.alias("y"), "token").where(
            (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y", percent)
        ).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b"))
        if r == 0:  # the one that shares most of the prefix
            near = near.groupBy("a", "b").agg(F.count("*").alias("c")).groupBy("a").agg(
                F.max(F.struct("c", "b"))["b"].alias("b")).unionByName(
                crowded.where("rep != gid").select(F.col("rep").alias("a"), F.col("gid").alias("b")))
        done = verified(docs, untested(near, tested), classes, rank, percent, shingle_words)
        tested.append(done)
        comp = linked_components(tested)
    # What is left: the classes of lists in several components. Members of one
    # group share all of its prefix, so one token stands for it.
    mixed_groups = staged(with_component(crowded, comp, "rep").groupBy("gid").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select(
        "gid", F.lit(True).alias("mixed")), "mixed")
    inside = groups.join(mixed_groups, "gid").select(
        "gid", "n", F.lit(0).alias("pos"), F.col("prefix")[0].alias("token"))
    rows = with_component(lists.unionByName(inside), comp, "gid").join(mixed_groups, "gid", "left")
    left = rows.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("mixed").alias("mixed"),
    ).where("lo != hi OR mixed > 0").select("token")
    alone = groups.where("size = 1").select("gid", F.col("gid").alias("rep"))
    members = crowded.unionByName(alone).withColumnRenamed("rep", "node")
    rows = rows.select("token", "gid", "n", "pos").join(staged(left, "left"), "token").join(members, "gid").drop("gid")
    may = may_link
    for level in range(LEVELS + 1):
        rows = rest_rows(with_component(rows, comp, "node"), percent)
        many = rows.where(F.col("pairs") > (FEW_PAIRS if level < LEVELS else (1 << 63) - 1))
        heads = staged(many.groupBy("token").agg(
            F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("b")), "heads")
        more = bool(heads.limit(1).count())
        few = rows.where(F.col("pairs") <= FEW_PAIRS) if more else rows
        tested.append(verified(docs, untested(rest_pairs(few, may, percent), tested), classes, rank, percent,
                               shingle_words))
        if not more:
            break
        pairs = many.join(heads, "token").where("node != b").select(F.col("node").alias("a"), "b").distinct()
        found = compared(docs, staged(pairs, "pivots"), percent, shingle_words, differences=True)
        tested.append(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "linked"))
        comp = linked_components(tested)
        rows, may = difference_lists(found, percent), may_differ
    comp = linked_components(tested)
    rank.destroy()  # all that used it is staged
    named = with_component(classes.select("key", "rep"), comp, "rep").select("key", "comp")
    return sign.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def linked_components(tested: list[DataFrame]) -> DataFrame:
    links = tested[0]
    for t in tested[1:]:
        links = links.unionByName(t)
    return staged(components(links.where("linked").select("a", "b")), "components")
