"""Removes benchmark passages from documents: windows of normalised words against a broadcast set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm.common import lower_ascii, table, without
from roostline.session import staged

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same words before lower-casing, and what lies between them.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WIDTH = 10
# Windows in one broadcast: 100,000 of ten words are about 20 MB in memory. Larger sets go in blocks.
BLOCK = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _named(some_words: Column, width: int) -> Column:
    """One 64-bit name for each ``width`` consecutive words.

    The word hashes are bound to a lambda variable, so that they are computed once per document.
    """
    def names(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        one = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])
        return F.when(F.size(h) >= width, F.transform(at, one))

    return F.transform(F.array(F.transform(some_words, lambda w: F.xxhash64(w))), names)[0]


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct windows of the items (``item_id``, ``text``): name, wide, window (its words) and the ids that hold it.

    An item of fewer words, but not none, is one window. An item without an id marks words and is not counted.
    """
    cut = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = cut.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(width)).alias("part"))
    named = each.select("item", F.size("part").alias("wide"), F.array_join("part", " ").alias("window"), F.expr("transform(part, x -> xxhash64(x))").alias("hs"))
    name = reduce(lambda otherwise, n: F.when(F.col("wide") == n, F.xxhash64(*[F.get("hs", F.lit(k)) for k in range(n)])).otherwise(otherwise), range(1, width + 1), F.lit(None))
    return named.groupBy(name.alias("name"), "wide", "window").agg(F.collect_set("item").alias("items"))


def _scan(docs: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """Verified occurrences: ``docs`` columns, at (from 0), wide, items.

    Names are looked up in the broadcast set while the windows of a document stream by; the words of
    a document travel no further than the comparison that follows a find.
    """
    found = []
    for wide in widths:
        some = F.broadcast(windows.where(F.col("wide") == wide))
        # The outer form: with the inner one the optimizer would compute the names once more, as a filter.
        each = docs.withColumn("_names", _named(F.col("_w"), wide)).select(*docs.columns, F.posexplode_outer("_names").alias("at", "name"))
        hit = each.join(some, "name").where(F.array_join(F.slice("_w", F.col("at") + 1, F.lit(wide)), " ") == F.col("window"))
        found.append(hit.select(*[c for c in docs.columns if c != "_w"], "at", "wide", "items"))
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document that holds an occurrence: ``doc_id``, ``_text_hash``, ``covered`` (sorted word
    positions from 0) and ``item_ids`` (sorted as strings).

    ``docs`` needs doc_id and text; rows that agree in both count as one document here. The set of
    windows is broadcast in blocks of a fixed number of windows, one pass over the documents for each
    block (a benchmark of usual size is one block), so its memory does not grow with the benchmark.
    """
    windows = staged(item_windows(items, width), "windows")
    sizes = {r.wide: r.n for r in windows.groupBy("wide").agg(F.count("*").alias("n")).collect()}
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), words(F.col("text")).alias("_w"))
    if not sizes:
        spark = docs.sparkSession
        return spark.createDataFrame([], "doc_id BIGINT, _text_hash BIGINT, covered ARRAY<INT>, item_ids ARRAY<STRING>")
    blocks = -(-sum(sizes.values()) // BLOCK)
    parts = [windows.where(F.pmod("name", F.lit(blocks)) == b) if blocks > 1 else windows for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, [_scan(keyed, p, sorted(sizes)) for p in parts])
    spans = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["wide"] - 1)))
    return (
        hits.groupBy("doc_id", "_text_hash")
        .agg(F.collect_set(F.struct("at", "wide")).alias("spans"), F.collect_set("items").alias("ids"))
        .select(
            "doc_id", "_text_hash",
            F.array_sort(F.array_distinct(spans)).alias("covered"),
            F.array_sort(F.array_distinct(F.flatten("ids"))).alias("item_ids"),
        )
    )


def _with_hits(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    h = hits.withColumnsRenamed({"doc_id": "_hit_id", "_text_hash": "_hit_hash"})
    return docs.join(h, docs["doc_id"].eqNullSafe(h["_hit_id"]) & (docs["_text_hash"] == h["_hit_hash"]), how)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; an empty benchmark hits nothing; every row of ``docs`` comes
    back once, repeated rows with equal results.
    """
    count = F.coalesce(F.regexp_count(lower_ascii(F.col("text")), F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), count.alias("n_words"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("covered"), F.lit(0)).cast("bigint")
    return _with_hits(slim, contamination(docs, items), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any occurrence, unchanged and with all their columns."""
    plain = without(docs, "_text_hash")
    keyed = plain.withColumn("_text_hash", F.xxhash64("text"))
    return _with_hits(keyed, contamination(plain, items), "left_anti").drop("_text_hash")


def without_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All documents; covered words go, each with what separates it from the next word."""
    plain = without(docs, "_text_hash")
    keyed = plain.withColumn("_text_hash", F.xxhash64("text"))
    hits = contamination(plain, items).withColumnRenamed("covered", "_covered")
    pieces = F.regexp_extract_all("text", F.lit(f"{CASED_WORD}{GAP}*"), F.lit(0))
    kept = F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains("_covered", i)), "")
    cleaned = F.concat(F.regexp_extract("text", f"^{GAP}*", 0), kept)
    text = F.when(F.col("_covered").isNull(), F.col("text")).otherwise(cleaned)
    joined = _with_hits(keyed, hits, "left")
    return joined.select(*[text.alias(c) if c == "text" else joined[f"`{c}`"] for c in plain.columns])


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return report(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


OP4_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
         FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, i, spot.n, item_id FROM spot JOIN win ON spot.t = win.t AND spot.n = win.n),
cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s COLLATE "C") AS joined
        FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (rid) LEFT JOIN ids USING (rid)
"""
