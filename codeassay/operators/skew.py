"""Ordered and lookup operations that stay bounded when one group holds much of the table.

* ``ordinal`` and ``carry_forward`` split each group into blocks of consecutive positions. A block
  holds at most ``BLOCK`` rows. Summaries of blocks are scanned as a tree of FAN blocks to a node, so
  sparse or 64-bit positions never put more than FAN summaries into a window either.
* ``number_in_groups`` ranks on ascending keys within slices whose bounds are fixed before, ``rank_in_groups`` on
  arbitrary sort orders through one range-partitioned sort that is written.
* ``lookup_join`` broadcasts only a lookup whose size it has measured; beyond that it splits hot keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from codeassay.session import stable

BLOCK = 65_536
#: Blocks (or nodes) that a node of the tree of summaries has below it, as bits.
FAN_BITS = 16
MAX_BROADCAST_BYTES = 32 * 1024 * 1024


def block_of(position: str, block: int) -> Column:
    """Number of the block of a whole position; blocks of negative positions have negative numbers."""
    return F.expr(f"(`{position}` - pmod(`{position}`, {block}L)) div {block}L")


def spans_blocks(df: DataFrame, position: str, block: int) -> Column:
    """Whether any position lies outside the first block, as a condition that is found when the query runs.

    Summaries filtered by it are empty in the usual case, and what joins them is planned anew without them. On a
    Parquet table row-group statistics answer it.
    """
    outside = (F.col(position) >= block) | (F.col(position) < 0)
    return df.select(position).filter(outside).exists()


def _scan_blocks(blocks: DataFrame, group: str, bits: int, fold: Callable[[Column, Column], Column], join: Callable[[Column, Column], Column], over: Callable[[Column], Column]) -> DataFrame:
    """(group, _block, _before): what the blocks before each block of a group amount to.

    ``blocks`` has (group, _block, _v), one row a block. As in a parallel prefix sum, summaries go up a tree with
    2**FAN_BITS children to a node, then the sums before each node come down. ``bits`` is the width of block numbers.
    ``fold`` combines values of a node in order, ``join`` a far value with a near one, ``over`` those in a window.
    Groups of one block take no part.
    """
    levels = max(1, -(-bits // FAN_BITS))
    ends = blocks.groupBy(group).agg(F.min("_block").alias("_lo"), F.max("_block").alias("_hi"))
    nodes = [blocks.join(ends.filter("_lo < _hi").select(group), group, "left_semi")]
    for _ in range(levels - 1):
        up = nodes[-1].groupBy(group, F.shiftright("_block", FAN_BITS).alias("_up"))
        nodes.append(up.agg(fold(F.col("_v"), F.col("_block")).alias("_v")).withColumnRenamed("_up", "_block"))
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = nodes[-1].select(group, "_block", over(F.col("_v")).over(earlier).alias("_before"))
    for level in reversed(nodes[:-1]):
        near = Window.partitionBy(group, "_up").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        placed = level.withColumn("_up", F.shiftright("_block", FAN_BITS)).withColumn("_near", over(F.col("_v")).over(near))
        far = before.select(group, F.col("_block").alias("_up"), F.col("_before").alias("_far"))
        before = placed.join(far, [group, "_up"], "left").select(group, "_block", join(F.col("_far"), F.col("_near")).alias("_before"))
    return before.filter("_before is not null")


def _block_bits(df: DataFrame, position: str, block: int) -> int:
    width = 64 if df.schema[position].dataType.simpleString() == "bigint" else 32
    return width - (block.bit_length() - 1)


def ordinal(df: DataFrame, group: str, position: str, out: str, block: int = BLOCK) -> DataFrame:
    """1-based row number of the whole ``position`` within ``group`` (positions unique within a group).

    Only the in-block window moves the rows; block sizes come from the two key columns alone.
    """
    keyed = df.withColumn("_block", block_of(position, block))
    in_block = Window.partitionBy(group, "_block").orderBy(position)
    numbered = keyed.withColumn("_row", F.row_number().over(in_block))
    sizes = keyed.filter(spans_blocks(df, position, block)).groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_v"))
    offsets = _scan_blocks(
        sizes,
        group,
        _block_bits(df, position, block),
        fold=lambda v, at: F.sum(v),
        join=lambda far, near: F.when(far.isNull() & near.isNull(), None).otherwise(F.coalesce(far, F.lit(0)) + F.coalesce(near, F.lit(0))),
        over=F.sum,
    )
    return (
        numbered.join(offsets, [group, "_block"], "left")
        .withColumn(out, (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("int"))
        .drop("_block", "_row", "_before")
    )


def carry_forward(
    df: DataFrame,
    group: str,
    position: str,
    value: str,
    out: str,
    block: int = BLOCK,
    census: DataFrame | None = None,
) -> DataFrame:
    """Last non-null ``value`` at an earlier ``position`` of the same group.

    Meant for narrow values (a number, a length, a pointer); texts are then fetched by pointer.
    ``census`` is a cheaper frame with the same positions to check for long groups.
    """
    keyed = df.withColumn("_block", block_of(position, block))
    before = Window.partitionBy(group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(value, ignorenulls=True).over(before)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position)))
    spans = spans_blocks(df if census is None else census, position, block)
    inherited = _scan_blocks(
        keyed.filter(spans).groupBy(group, "_block").agg(last.alias("_v")),
        group,
        _block_bits(df, position, block),
        fold=lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)),
        join=lambda far, close: F.coalesce(close, far),
        over=lambda v: F.last(v, ignorenulls=True),
    )
    return (
        keyed.withColumn("_here", near)
        .join(inherited, [group, "_block"], "left")
        .withColumn(out, F.coalesce("_here", "_before"))
        .drop("_block", "_here", "_before")
    )


#: Keys that are looked at for each bound, and characters of a text in a bound (texts that agree in them share a slice).
SAMPLED, BOUND_CHARS = 32, 256


def range_bounds(df: DataFrame, keys: list[str], slices: int) -> list[tuple]:
    """Ascending keys that cut ``df`` into about ``slices`` slices of its rows, fewer for few rows.

    Only keys are read: once to count them, once for a sample by hash, of which some SAMPLED keys a slice come to the
    driver, texts cut to BOUND_CHARS.
    """
    rows = df.select(*keys)
    every = max(1, rows.count() // (slices * SAMPLED))
    cut = [F.left(c, F.lit(BOUND_CHARS)).alias(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c) for c in keys]
    sample = rows.filter(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).select(*cut).orderBy(*keys).collect()
    stride = max(SAMPLED, -(-len(sample) // slices))
    found = [tuple(r) for r in sample[stride::stride]]
    return [b for k, b in enumerate(found) if not k or b != found[k - 1]]


def slice_of(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """How many bounds a row's keys have reached: a binary search, nulls before all values."""
    if not bounds:
        return F.lit(0)
    key = F.struct(*[F.col(c).alias(c) for c in keys])
    ends = F.array(*[F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(keys, b, strict=True)]) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def further(low: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(ends, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low)

    return F.aggregate(steps, F.lit(0), further)


def number_in_groups(df: DataFrame, groups: list[str], keys: list[str], out: str, slices: int | None = None) -> DataFrame:
    """1-based rank within ``groups`` by ascending ``keys`` (a total order, nulls first), for groups of any size.

    Bounds on groups and keys together are found while the query is built, and are part of it: every job, also one
    that runs again after a loss, cuts the rows alike. Rows move once, to their slice; each (slice, group) is ranked
    alone and shifted by the group's rows in earlier slices. Nothing is written.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, [*groups, *keys], slices)
    keyed = df.withColumn("_slice", slice_of(df, [*groups, *keys], bounds))
    in_slice = Window.partitionBy("_slice", *groups).orderBy(*keys)
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a slice can continue from an earlier one, so this frame has fewer rows than
    # there are slices: a proven bound for the broadcast.
    shifts = (
        keyed.groupBy("_slice", *groups)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_slice", *groups, F.sum("_n").over(earlier).alias("_shift"))
        .filter("_shift is not null")
    )
    ranked = keyed.withColumn("_row", F.row_number().over(in_slice)).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("_slice", *groups)])
    return ranked.join(F.broadcast(shifts).alias("s"), same, "left").select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("r._row") + F.coalesce("s._shift", F.lit(0))).cast("long").alias(out),
    )


def rank_in_groups(df: DataFrame, groups: list[str], order: list[Column | str], out: str) -> DataFrame:
    """1-based rank within ``groups`` by ``order`` (a total order), for groups of any size.

    The global sort range-partitions on groups and order together, so a hot group spreads over many
    partitions. Written once, its partition numbers are stable; each (partition, group) slice
    is then ranked alone and shifted by the rows its group has in earlier partitions.
    """
    position = F.monotonically_increasing_id()  # partition number and row number of the sorted frame
    sorted_once = stable(df.orderBy(*groups, *order).withColumn("_pos", position))
    placed = sorted_once.withColumn("_part", F.shiftright("_pos", 33))
    in_slice = Window.partitionBy("_part", *groups).orderBy("_pos")
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first group of a partition can continue from an earlier one, so this frame has at
    # most one row per partition: a proven bound for the broadcast.
    shifts = (
        placed.groupBy("_part", *groups)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", *groups, F.sum("_n").over(earlier).alias("_shift"))
        .filter("_shift is not null")
    )
    ranked = placed.withColumn("_row", F.row_number().over(in_slice)).alias("r")
    shifts = F.broadcast(shifts).alias("s")
    same_slice = reduce(
        lambda a, b: a & b,
        [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("_part", *groups)],
    )
    return ranked.join(shifts, same_slice, "left").select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("r._row") + F.coalesce("s._shift", F.lit(0))).cast("long").alias(out),
    )


def _row_bytes(df: DataFrame) -> Column:
    def size(field: T.StructField) -> Column:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            return F.coalesce(F.octet_length(F.to_json(column)), F.lit(0))
        if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.NullType, T.AnsiIntervalType)):
            return F.lit(16)
        raise TypeError(f"the size of {kind.simpleString()} columns is not known")

    return reduce(lambda a, b: a + b, [size(f) + F.lit(8) for f in df.schema.fields])


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure a frame with one aggregation; only the total reaches the driver."""
    total = df.agg(F.sum(_row_bytes(df).cast("long")).alias("bytes")).first()["bytes"]
    return (total or 0) <= max_bytes


def hot_keys(df: DataFrame, on: str) -> DataFrame:
    """Keys with more rows than an average shuffle partition, and how many partitions each would fill.

    With P shuffle partitions, fewer than P keys can hold more than 1/P of the rows each.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = max(df.count() / partitions, 1.0)
    counts = df.groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.filter(F.col(on).isNotNull() & (F.col("_n") > fair))
    return stable(hot.select(on, F.ceil(F.col("_n") / F.lit(fair)).cast("int").alias("_salts")))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: str,
    how: str = "left",
    spread: list[str] | None = None,
    census: DataFrame | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Join facts to a lookup that has one row per key.

    The lookup is computed once, into the shared folder, and measured there. A small one is
    broadcast, so the facts do not move. A larger one is joined by a shuffle on its key, in which
    each hot key is split over as many tasks as its share asks for, by the ``spread`` columns; only
    lookup rows of hot keys are copied. ``census`` is a cheaper frame with the same keys to count.
    """
    lookup = stable(lookup)
    if fits_broadcast(lookup, max_bytes):
        return facts.join(F.broadcast(lookup), on, how)
    # bounded by the number of shuffle partitions, hence the broadcasts
    hot = F.broadcast(hot_keys(facts if census is None else census, on))
    partitions = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # null keys match nothing, so they only need spreading
    ways = F.when(F.col(on).isNull(), F.lit(partitions)).otherwise(F.coalesce("_salts", F.lit(1)))
    row_hash = F.xxhash64(*(spread or [c for c in facts.columns if c != on]))
    salted = facts.join(hot, on, "left").withColumn("_salt", F.pmod(row_hash, ways).cast("int")).drop("_salts")
    slots = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    copies = lookup.join(hot, on, "left").withColumn("_salt", F.explode(slots)).drop("_salts")
    return salted.join(copies, [on, "_salt"], how).drop("_salt")
