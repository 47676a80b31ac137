"""Nested list views built without unbounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import literal, null_join, staged, staged_for

DEFAULT_CHUNK = 10_000
# A task cuts lists from about so many bytes of entries as they are stored, and
# from no more than so many entries (or one list's, if it has more).
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 65_536


def _block_rows(entries: DataFrame, n: int, chunk: int) -> int:
    """Entries of a block, a multiple of ``chunk``: a block for every shuffle
    partition, more if they would be too large."""
    stored = int(str(entries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per_task = -(-n // int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = min(per_task, max(64, n * BLOCK_BYTES // max(1, stored)), BLOCK_ROWS)
    return chunk * max(1, -(-rows // chunk))


def _counted_keys(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _c, _range, _sum``: how many entries each key has, and how many
    its range of the sorted keys has up to it."""
    counts = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy("_range").orderBy("_row")
    return (counts.repartitionByRange(*keys).sortWithinPartitions(*keys)
            .select(*keys, "_c", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_row"))
            .select(*keys, "_c", "_range", F.sum("_c").over(up_to).alias("_sum")))


def _block_starts(entries: DataFrame, group_cols: list[str], chunk: int) -> DataFrame:
    """A staged row for each block of the sorted entries: ``block`` (from 0),
    ``at`` (place of its first entry), ``key`` (group and key of that),
    ``key_at`` (place of the key's first entry), ``pos`` (place in the group),
    ``total`` (entries of the group) and ``rows`` (entries of a block).

    Block ``j`` begins with the first list that begins at ``j * rows`` or
    later, so no list is in two blocks. Values are not read."""
    keys = [*group_cols, "_k"]
    with staged_for(_counted_keys(entries, keys), "list-keys") as counted:
        # As many rows as there are shuffle partitions.
        held = {r["_range"]: r["_n"] for r in counted.groupBy("_range").agg(F.sum("_c").alias("_n")).collect()}
        before = [0]
        for i in range(max(held, default=0)):
            before.append(before[-1] + held.get(i, 0))
        rows = _block_rows(entries, sum(held.values()), chunk)
        offset = F.get(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("_range"))
        placed = counted.select(*keys, "_c", (offset + F.col("_sum") - F.col("_c")).alias("_at"))
        first, total, last = F.col("_first"), F.col("_total"), F.col("_first") + F.col("_total")
        starts = placed.groupBy(*group_cols).agg(F.min("_at").alias("_first"), F.sum("_c").alias("_total")).select(
            "_first", "_total", F.explode(F.filter(
                F.sequence(F.floor(first / rows), F.floor((last - 1) / rows)), lambda j: j * rows >= first)).alias("block"))
        pos = F.ceil((F.col("block") * rows - first) / chunk) * chunk
        starts = starts.select("block", total.alias("total"), F.when(pos < total, pos).otherwise(0).alias("pos"),
                               F.least(first + pos, last).alias("at"))
        at, end = F.col("_at"), F.col("_at") + F.col("_c") - 1
        near = placed.select(at.alias("key_at"), end.alias("_end"), F.struct(*keys).alias("key"), F.explode(F.filter(
            F.sequence(F.floor((at - chunk) / rows), F.floor(end / rows)), lambda j: j * rows > at - chunk)).alias("block"))
        return staged(near.join(F.broadcast(starts), "block").where(F.col("at").between(F.col("key_at"), F.col("_end")))
                      .select("block", "at", "key", "key_at", "pos", "total", F.lit(rows).cast("bigint").alias("rows")),
                      "list-starts")


def _tied_entries(entries: DataFrame, tied: DataFrame, starts, group_cols: list[str]) -> DataFrame:
    """``group..., _k, _v, _b``, staged: the entries of the ``tied`` keys, in
    which a block begins, and their blocks. They are placed by value, in ranges,
    as many of them may be equal."""
    keys = [*group_cols, "_k"]
    order = [*keys, "_v", "_n"]
    ranged = staged(null_join(entries, F.broadcast(tied), keys).withColumn("_n", F.monotonically_increasing_id())
                    .repartitionByRange(*order).sortWithinPartitions(*order)
                    .select(*keys, "_v", "_key_at", "_rows", F.spark_partition_id().alias("_range"),
                            F.monotonically_increasing_id().alias("_row")), "list-ties")
    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"), F.min("_row").alias("_first"))
    counts = staged(counts.select(*keys, "_range", (F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range"))
                                                    - F.col("_c") - F.col("_first")).alias("_before")), "list-counts")
    placed = null_join(ranged, F.broadcast(counts), [*keys, "_range"]).withColumn(
        "_at", F.col("_key_at") + F.col("_before") + F.col("_row"))
    block = F.floor(F.col("_at") / F.col("_rows")).cast("int")
    begun = F.get(starts, block)["at"] <= F.col("_at")
    return placed.select(*keys, "_v", F.when(begun, block).otherwise(block - 1).alias("_b"))


def chunked_lists(df: DataFrame, group_cols: list[str], value, order=None,
                  chunk: int = DEFAULT_CHUNK, out_col: str = "items", stored: bool = False) -> DataFrame:
    """``(group..., part, n_items, first_position, items)``: the values of
    each group in order, ``chunk`` to a row. Rows of one group joined in the
    order of ``part`` are the whole list; ``first_position`` is the place of
    a row's first value in it, from 0.

    ``order`` (default ``value``) sorts the list; equal keys are sorted by
    value. The sorted entries are cut into blocks of whole lists, so neither a
    hot group nor a hot key meets in one task. Where a block begins is found
    from the keys alone; only the entries of a key in which a block begins are
    sorted by value for it. Then every value is shuffled once, to its block,
    and the lists are cut there. The input is read once (the entries are
    staged), unless it is ``stored`` already; a stored one is read again.
    """
    if chunk < 1:
        raise ValueError("chunk must be positive")
    value = F.col(value) if isinstance(value, str) else value
    order = value if order is None else (F.col(order) if isinstance(order, str) else order)
    keys = [*group_cols, "_k"]
    entries = df.select(*group_cols, order.alias("_k"), value.alias("_v"))
    if not stored:
        entries = staged(entries, "list-entries")
    blocks = _block_starts(entries, group_cols, chunk)
    within = [r["within"] for r in blocks.select((F.col("at") > F.col("key_at")).alias("within")).collect()]
    starts = literal(blocks.agg(F.sort_array(F.collect_list(F.struct("block", "at", "key", "pos", "total")))))
    # The last start that is not after the key, by halves.
    steps = [F.lit(1 << i) for i in reversed(range(max(1, len(within).bit_length())))]
    found = F.aggregate(F.array(*steps), F.lit(0), lambda n, step: F.when(
        F.get(starts, n + step - 1)["key"] <= F.struct(*keys), n + step).otherwise(n), lambda n: n - 1)
    rest = entries
    if any(within):
        tied = blocks.where(F.col("at") > F.col("key_at")).select(
            "key.*", F.col("key_at").alias("_key_at"), F.col("rows").alias("_rows")).distinct()
        rest = null_join(entries, F.broadcast(tied.select(*keys)), keys, "left_anti")
    rows = rest.select(*keys, "_v", found.alias("_b"))
    if any(within):
        rows = rows.unionByName(_tied_entries(entries, tied, starts, group_cols))
    lists = (rows.repartitionById(max(1, len(within)), F.col("_b")).groupBy(*group_cols, "_b")
             .agg(F.sort_array(F.collect_list(F.struct("_k", "_v"))).alias("_l")))
    here, after = F.get(starts, F.col("_b")), F.get(starts, F.col("_b") + 1)

    def continues(start):
        """Whether a block begins amid the list of the row's group."""
        return (start["pos"] > 0) & F.struct(*[start["key"][c].alias(c) for c in group_cols]).eqNullSafe(F.struct(*group_cols))

    size, first = F.size("_l"), F.when(continues(here), here["pos"]).otherwise(F.lit(0).cast("bigint"))
    n_items = F.when(continues(here), here["total"]).when(continues(after), after["total"]).otherwise(size.cast("bigint"))
    # Entries are taken one by one, as a slice reads the whole array; and what a
    # row keeps of it is selected first, or every row made would carry it.
    return (lists.select(*group_cols, n_items.alias("n_items"), first.alias("_first"), "_l")
            .select(*group_cols, "n_items", "_first", F.explode(F.transform(
                F.sequence(F.lit(0), size - 1, F.lit(chunk)), lambda i: F.struct(i.alias("at"), F.transform(
                    F.sequence(i, F.least(i + (chunk - 1), size - 1)), lambda n: F.get("_l", n)["_v"]).alias("values")))).alias("_e"))
            .select(*group_cols, F.floor((F.col("_first") + F.col("_e.at")) / chunk).alias("part"), "n_items",
                    (F.col("_first") + F.col("_e.at")).alias("first_position"), F.col("_e.values").alias(out_col)))
