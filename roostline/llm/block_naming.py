"""Exact deduplication by naming: sorted blocks become integers, pairs of names become names, until one is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm.common import table
from roostline.session import staged

BLOCK = 4096
# A task remembers blocks of so many bytes, so that copies which it meets again travel as a reference.
REMEMBERED = 16 << 20
CHUNK_ROWS = 2048
CHUNK_BYTES = 8 << 20

CUT = "row BIGINT, doc_id BIGINT, text_sha256 STRING, blocks INT, idx INT, uid BIGINT, content BINARY"
CUT_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("blocks", pa.int32()),
                       ("idx", pa.int32()), ("uid", pa.int64()), ("content", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each normalised text. A block met before in this task refers to the first by ``uid``."""
    base = TaskContext.get().partitionId() << 36
    row = uid = held = kept = 0
    known: dict[bytes, int] = {}
    out: list[tuple] = []
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            data = (text or "").encode().lower()
            digest, doc_id = hashlib.sha256(data).hexdigest(), ids[i].as_py()
            blocks = max(1, -(-len(data) // BLOCK))
            for k in range(blocks):
                content = data[k * BLOCK : (k + 1) * BLOCK]
                first = known.get(content)
                if first is None:
                    first, uid = base + uid, uid + 1
                    if kept > REMEMBERED:
                        known, kept = {}, 0
                    known[content] = first
                    kept += len(content) + 64
                    held += len(content)
                    out.append((base + row, doc_id, digest, blocks, k, first, content))
                else:
                    out.append((base + row, doc_id, digest, blocks, k, first, None))
                if len(out) >= CHUNK_ROWS or held >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), CUT_ARROW)], schema=CUT_ARROW)
                    out, held = [], 0
            row += 1
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), CUT_ARROW)], schema=CUT_ARROW)


def _numbered(level: int, keys: int):
    """Numbers the distinct keys (first ``keys`` columns) of a sorted partition; the rest of the columns pass."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (level << 57) | (TaskContext.get().partitionId() << 36)
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = None
            for k in range(keys):
                column = batch.column(k)
                equal = pc.equal(column.slice(1), column.slice(0, n - 1))
                same = equal if same is None else pc.and_(same, equal)
            head = tuple(batch.column(k)[0].as_py() for k in range(keys))
            fresh = pa.concat_arrays([pa.array([last is not None and head != last]), pc.invert(same)])
            names = pc.add(pc.cumulative_sum(pc.cast(fresh, pa.int64())), name)
            name, last = names[n - 1].as_py(), tuple(batch.column(k)[n - 1].as_py() for k in range(keys))
            rest = [batch.column(i) for i in range(keys if level == 0 else 0, batch.num_columns)]
            fields = [batch.schema.field(i) for i in range(keys if level == 0 else 0, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, names], schema=pa.schema([*fields, ("name", pa.int64())]))

    return number


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """``uid`` -> ``name``: equal contents meet in one partition, are sorted and numbered."""
    contents = blocks.where("content IS NOT NULL").select("content", "uid")
    dealt = contents.repartition("content").sortWithinPartitions("content")
    return dealt.mapInArrow(_numbered(0, 1), "uid BIGINT, name BIGINT")


def _name_pairs(pairs: DataFrame, level: int) -> DataFrame:
    """(a, b) -> name over distinct pairs; the distinct sums up before the shuffle."""
    distinct = pairs.select("a", "b").distinct().repartition("a", "b").sortWithinPartitions("a", "b")
    return distinct.mapInArrow(_numbered(level, 2), "a BIGINT, b BIGINT, name BIGINT")


def identities(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): row, doc_id, text_sha256, name.

    Two rows have the same name exactly if their texts are identical after lower-casing A-Z; null counts
    as empty. No hash decides: blocks of 4,096 bytes are compared in sorted order, pairs of names by value.
    Names of different levels differ, so an odd block at the end keeps its name. The number of rounds is
    the logarithm of the longest text in blocks; only texts with more than one name left take part.
    """
    cut = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_cut, CUT)
    cut = staged(cut, "blocks", compression="zstd")
    names = staged(_name_blocks(cut), "names")
    state = cut.select("row", "idx", "blocks", "uid").join(names, "uid").select("row", "idx", "blocks", "name")
    state = staged(state, "names")
    longest = cut.agg(F.max("blocks")).first()[0] or 1
    done = state.where("blocks = 1").select("row", "name")
    level = 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        at = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = (
            state.where("blocks > 1")
            .groupBy("row", F.shiftright("idx", 1).alias("idx"), F.shiftright(F.col("blocks") + 1, 1).alias("blocks"))
            .agg(at(0).alias("a"), at(1).alias("b"))
        )
        pairs = staged(pairs, "pairs")
        named = staged(_name_pairs(pairs.where("b IS NOT NULL"), level), "names")
        state = staged(pairs.join(named, ["a", "b"], "left").select("row", "idx", "blocks", F.coalesce("name", "a").alias("name")), "names")
        done = done.unionByName(state.where("blocks = 1").select("row", "name"))
    return cut.where("idx = 0").select("row", "doc_id", "text_sha256").join(done, "row")


def duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest doc_id stays (a null id is the smallest; of rows
    that agree in the id, too, exactly one stays). An empty table gives no rows.
    """
    named = staged(identities(docs), "identities")
    best = F.max(F.struct("doc_id", (-F.col("row")).alias("r")))
    # One row per text, written: so a text with very many copies is a skewed join that AQE can split.
    per = staged(named.groupBy("name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return named.join(per, "name").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == -F.col("best.r")).alias("kept"), "text_sha256"
    )


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates(table(spark, folder, "documents").select("doc_id", "text"))


OP9_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
