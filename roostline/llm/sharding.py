"""Sharding with sampled splitters: shards of near equal bytes over a range partition of the records."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm.common import table, without
from roostline.session import staged

RECORD_OVERHEAD = 16
KEY = "struct<k:bigint,t:bigint,r:bigint>"
LEAST = -(2**63)


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus a fixed overhead per record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + RECORD_OVERHEAD


def _longs(values) -> Column:
    """A constant array; one literal text that the optimizer folds, however long the list."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(key: Column, splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at most ``key``: found among every 32nd, then within one stretch of 32."""
    if not splitters:
        return F.lit(0)
    step = 32

    def constant(some):
        return F.arrays_zip(*[_longs(v) for v in zip(*some)]).cast(f"array<{KEY}>")

    fine, coarse = constant(splitters), constant(splitters[::step])
    at_most = lambda some: F.size(F.filter(some, lambda s: s <= key))

    def inside(block: Column) -> Column:
        return F.when(block == 0, 0).otherwise((block - 1) * step + at_most(F.slice(fine, (block - 1) * step + 1, F.lit(step))))

    # Bound to a lambda variable, so that the first search is made once a record.
    return F.transform(F.array(at_most(coarse)), inside)[0]


def _draw(rows: DataFrame, step: float, salt: int) -> list[tuple[tuple[int, int, int], float]]:
    """A size-weighted sample of keys: a record of at least ``step`` bytes is certain, a smaller one in proportion.

    What comes to the driver has an expected ``total / step`` keys, whatever the number of records.
    """
    u = (F.xxhash64("_key", F.lit(salt)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)
    drawn = rows.where(F.col("_size") > u * step).select("_key", F.greatest("_size", F.lit(step)).alias("w"))
    return sorted(((r[0].k, r[0].t, r[0].r), r[1]) for r in drawn.collect())


def _quantiles(drawn, limit: float) -> list[tuple[int, int, int]]:
    """Keys at which the drawn weight passes another multiple of ``limit``."""
    out, weight = [], 0.0
    for key, w in drawn:
        if weight >= limit or (w >= limit and weight > 0):
            out.append(key)
            weight = 0.0
        weight += w
    return out


def _ranges(rows: DataFrame, total: int, pieces: int, draws: int):
    """Splitters, and per range its bytes and records, such that no range is overfull.

    A range is overfull when it exceeds ``2 * total / pieces`` bytes without its largest record.
    Only overfull ranges are drawn from again, each time four times as densely; at the latest
    when every record is drawn each range is a single record.
    """
    limit = total / pieces
    splitters = _quantiles(_draw(rows, limit / draws, 0), limit)
    for again in itertools.count(1):
        ranged = rows.withColumn("_range", _range_of(F.col("_key"), splitters))
        sums = {
            r._range: (r.b, r.n, r.largest)
            for r in ranged.groupBy("_range")
            .agg(F.sum("_size").alias("b"), F.count("*").alias("n"), F.max("_size").alias("largest"))
            .collect()
        }
        overfull = [i for i, (b, _, largest) in sums.items() if b - largest > 2 * limit]
        if not overfull:
            return splitters, sums
        part = ranged.where(F.array_contains(_longs(overfull), F.col("_range").cast("bigint")))
        more = _quantiles(_draw(part, limit / draws / 4**again, again), limit / 2)
        splitters = sorted({*splitters, *more})


def shard(
    df: DataFrame, size: Column, group: Column, tie: Column, shards: int, pieces: int = 32, draws: int = 8
) -> DataFrame:
    """Adds ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 within a shard).

    Records are ordered by ``group`` and ``tie`` (both bigint, null first), so that equal groups
    lie together. A shard takes the records whose start, in bytes of that order, falls into its
    ``1 / shards`` of all bytes: shard sizes differ from the mean by one record at most.

    The order is never sorted as a whole. ``shards * pieces`` ranges are cut at the quantiles of a
    size-weighted sample of keys, ranges that come out overfull are subdivided, and windows run
    within a range. Since a key ends in the id of its record, a group of equal records is
    split like any other stretch. The driver holds ``draws`` keys a range, as expected, and one sum a range.

    Null sizes count as 0, an empty table gives no rows, repeated rows get a slot each. Columns of
    ``df`` named ``shard`` or ``slot`` are replaced. Reruns over the same rows agree but for the
    slots of rows that are equal in group and tie.
    """
    df = without(df, "shard", "slot")
    payload = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    key = F.struct(
        F.coalesce(group, F.lit(LEAST)).alias("k"),
        F.coalesce(tie, F.lit(LEAST)).alias("t"),
        F.monotonically_increasing_id().alias("r"),
    )
    # Written once, so that each later read sees the same record ids.
    rows = staged(df.select(payload.alias("_row"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_size"), key.alias("_key")), "shards")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    splitters, sums = _ranges(rows, total, shards * pieces, draws) if total else ([], {0: (0, 0, 0)})
    counts = [sums.get(i, (0, 0, 0)) for i in range(len(splitters) + 1)]
    before_bytes = [0, *itertools.accumulate(c[0] for c in counts)]
    before_rows = [0, *itertools.accumulate(c[1] for c in counts)]

    at = F.col("_range") + 1
    order = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.element_at(_longs(before_bytes), at) + F.sum("_size").over(order) - F.col("_size")
    index = F.element_at(_longs(before_rows), at) + F.count(F.lit(1)).over(order) - 1
    placed = (
        rows.withColumn("_range", _range_of(F.col("_key"), splitters))
        .select("_row", start.alias("_start"), index.alias("_index"))
        .withColumn("_shard", F.least(F.lit(shards - 1), F.floor(F.col("_start") * shards / max(total, 1))).cast("int"))
    )
    firsts = dict(placed.groupBy("_shard").agg(F.min("_index")).collect())
    first = F.element_at(_longs(firsts.get(s, 0) for s in range(shards)), F.col("_shard") + 1)
    return placed.select("_row.*", F.col("_shard").alias("shard"), (F.col("_index") - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents of equal text lie together, in the order of ``doc_id``."""
    return shard(docs, record_bytes(F.col("text")), F.xxhash64("text"), F.col("doc_id").cast("bigint"), shards)


def op1_shard_by_bytes(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, folder, "documents").select(
        "doc_id", record_bytes(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("group")
    )
    placed = shard(slim, F.col("size"), F.col("group"), F.col("doc_id"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
