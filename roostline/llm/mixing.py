"""Mixing sources to target weights with hash-threshold histograms: no sort, one threshold per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm.common import WORD, table, without
from roostline.session import staged

HASH_BITS = 60
LEVEL_BITS = 10
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_hash(*parts: Column) -> Column:
    """The first 60 bits of the MD5 of what tells a row from others, such as its id and text; nulls count as empty texts."""
    whole = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to one row per source (``src``, ``source_size``).

    Sources in code point order, null last, weigh 1, 2, 3 and so on again, and share the sum of all
    sizes. A target stops at three times its source's size; what is over is shared by weight among
    the others until no target is above. Sorted by cap per weight, the capped sources come first, so
    prefix sums give the final share at once. The windows hold one row per source, never documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    weighed = sources.select("*", ((rank - 1) % 3 + 1).alias("w"), (F.col("source_size") * MOST_REPEATS).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole)
    share = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(rest)
    shared = weighed.withColumn("share", share).withColumn("free", F.col("cap") > F.col("w") * F.col("share"))
    final = F.min_by(F.when(F.col("free"), F.col("share")), F.when(F.col("free"), F.col("cap") / F.col("w"))).over(whole)
    return shared.select(
        "src", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * final, F.col("cap").cast("double"))).alias("target")
    )


def _boundary(buckets: DataFrame, carried: list[str]) -> DataFrame:
    """Of each source, the first bucket with which the running size exceeds the remainder.

    ``buckets``: src, remainder, base, bucket, size, lo, hi; at most 1,024 rows a source.
    """
    order = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("base") + F.sum("size").over(order)
    found = buckets.withColumn("after", after).where(F.col("after") > F.col("remainder"))
    return (
        found.groupBy("src", *carried)
        .agg(F.min_by(F.struct("bucket", "size", "lo", "hi", "after"), "bucket").alias("b"))
        .select("src", *carried, (F.col("b.after") - F.col("b.size")).alias("base"), "b.bucket", "b.size", "b.lo", "b.hi")
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """Per source: its size, target, whole repeats and the hash up to which documents are taken once more.

    ``rows``: src, h, size. A histogram of sizes by the top ten bits of the hash holds the budget
    threshold of each source; only the bucket in which it lies is cut by the next ten bits, until that
    bucket is one hash value. That value is included if the taken size comes nearer to the target.
    """
    top = HASH_BITS - LEVEL_BITS
    bucket = F.shiftright("h", top).alias("bucket")
    counted = [F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi")]
    histogram = staged(rows.groupBy("src", bucket).agg(*counted), "mix-histogram")
    aimed = targets(histogram.groupBy("src").agg(F.sum("size").alias("source_size")))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    aimed = aimed.withColumn("repeats", repeats.cast("bigint"))
    aimed = staged(aimed.withColumn("remainder", F.col("target") - F.col("repeats") * F.col("source_size")), "mix-targets")

    carried = ["source_size", "target", "repeats", "remainder"]
    same = lambda a, b: a["src"].eqNullSafe(b["src"])
    first = histogram.join(aimed, same(histogram, aimed)).drop(aimed["src"]).withColumn("base", F.lit(0).cast("bigint"))
    state = staged(_boundary(first, carried), "mix-level")
    for shift in range(top - LEVEL_BITS, -1, -LEVEL_BITS):
        is_open = state.where("lo < hi")
        if is_open.isEmpty():
            break
        near = rows.join(
            is_open.select(F.col("src").alias("s"), "bucket", "base", *carried),
            F.col("src").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("bucket")),
        )
        finer = near.groupBy("src", *carried, "base", F.shiftright("h", shift).alias("bucket")).agg(*counted)
        # Only the boundary bucket of an open source is refined; the others are handed on.
        state = staged(_boundary(finer, carried).unionByName(state.where("lo = hi")), "mix-level")
    include = F.col("base") + F.col("size") - F.col("remainder") < F.col("remainder") - F.col("base")
    cut = state.select(F.col("src").alias("s"), F.when(include, F.col("lo")).otherwise(F.col("lo") - 1).alias("cut"))
    return aimed.join(cut, F.col("src").eqNullSafe(F.col("s")), "left").select(*aimed.columns, F.coalesce("cut", F.lit(-1)).alias("cut"))


def mix(df: DataFrame, size: Column, source: Column, *ident: Column) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``copies`` (0 to 3, how often the mix takes a row).

    Rows equal in all of ``ident`` share a hash and are taken or left together: give the id and the text, so that rows
    without an id, or with one of many, are chosen one by one. Null sizes count as
    0 and such rows get the whole repeats of their source only; a null source is a source of its own.
    An empty table gives no rows. Columns of ``df`` with the names of the added ones are replaced.
    Hashes depend on ``ident`` alone: reruns agree, and a larger target keeps all that a smaller one took.
    """
    measured = F.struct(
        F.coalesce(size, F.lit(0)).cast("bigint").alias("size"), source.alias("src"), row_hash(*ident).alias("h")
    ).alias("_m")
    kept = without(df, "size", "source_size", "target", "copies")
    payload = F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row")
    slim = staged(df.select(measured).select("_m.*"), "mix-sizes")
    per_source = thresholds(slim)
    extra = ((F.col("_m.h") <= F.col("cut")) & (F.col("_m.size") > 0)).cast("bigint")
    # One row per source on the right: broadcast when measured to be small, else AQE splits hot sources.
    joined = df.select(payload, measured).join(per_source, F.col("_m.src").eqNullSafe(F.col("src")), "left")
    return joined.select("_row.*", "_m.size", "source_size", "target", (F.col("repeats") + extra).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only."""
    mixed = mix(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), word_count(F.col("d.text")), F.col("d.source"), F.col("d.doc_id"), F.col("d.text"))
    return mixed.where("copies > 0").select("d", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("d.*")


def op3_mix_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed = mix(docs.select("doc_id", "source", "text"), word_count(F.col("text")), F.col("source"), F.col("doc_id"), F.col("text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS w
        FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3 * s AS cap,
         ((sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS share
  FROM per),
final AS (SELECT min_by(share, cap / w) AS lam FROM ranked WHERE cap > w * share),
aimed AS (SELECT source, s, least(cap::DOUBLE, coalesce(w * lam, cap::DOUBLE)) AS target FROM ranked, final),
parts AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS k FROM aimed),
running AS (
  SELECT d.*, p.s, p.target, p.k, p.target - p.k * p.s AS rem,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
edges AS (SELECT source, min(h) AS edge FROM running WHERE after > rem GROUP BY source),
cuts AS (SELECT DISTINCT r.source, CASE WHEN after - rem < rem - (after - own) THEN h ELSE h - 1 END AS cut
         FROM running r JOIN edges e ON r.source IS NOT DISTINCT FROM e.source AND r.h = e.edge)
SELECT doc_id, size, s AS source_size, target,
       (size * (k + CASE WHEN h <= cut THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source
"""
