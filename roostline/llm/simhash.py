"""Near-duplicates by SimHash: 64-bit fingerprints, linked within a Hamming radius through BK-trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm import tokens
from roostline.llm.common import table
from roostline.llm.components import components
from roostline.llm.xxh64 import xxh64
from roostline.session import staged

SHINGLE = 4
SEED = 42
RADIUS = 4
CHUNK = 1 << 16
# Two of six blocks of the fingerprint choose a shard: with at most four differing bits two blocks are equal.
BLOCKS = (11, 11, 11, 11, 10, 10)


def shingle_hashes(data: np.ndarray, cuts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the word shingles of each text between two cuts, in pieces: which text (ascending), and its hashes.

    Words are lower-cased; a text of fewer words than ``width`` has one shingle of all of them, one without words none.
    """
    data = tokens.LOWER[data]
    starts, ends = tokens.spans(data, cuts, tokens.IS_SPACE)
    if not len(starts):
        return
    # All words again, one space after each.
    after = np.cumsum(ends - starts + 1)
    joined = np.full(after[-1], 0x20, np.uint8)
    inside = np.ones(after[-1], bool)
    inside[after - 1] = False
    joined[inside] = data[~tokens.IS_SPACE[data]]
    begin = np.r_[0, after[:-1]]

    first = np.searchsorted(starts, cuts)  # the first word of each text
    count = np.diff(first)
    some = np.flatnonzero(count)
    shingles = np.maximum(count[some] - width + 1, 1)
    offset = np.r_[0, np.cumsum(shingles)]
    for low in range(0, offset[-1], CHUNK):
        n = np.arange(low, min(low + CHUNK, offset[-1]))
        at = np.searchsorted(offset, n, "right") - 1
        text = some[at]
        word = first[text] + n - offset[at]
        reach = np.minimum(count[text], width) - 1
        yield text, xxh64(joined, begin[word], after[word + reach] - 1, SEED)


def fingerprint_group(data: np.ndarray, cuts: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """SimHash of the word shingles of each text between two cuts, as signed 64-bit integers; 0 without words."""
    ones = np.zeros((len(cuts) - 1, 64), np.int64)
    shingles = np.zeros(len(cuts) - 1, np.int64)
    for text, h in shingle_hashes(data, cuts, width):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        edge = np.flatnonzero(np.diff(text, prepend=-1))
        ones[text[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
        shingles[text[edge]] += np.diff(np.r_[edge, len(text)])
    bits = ones * 2 > shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0].astype(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the last, which is the text; its fingerprint takes its place."""
    for batch in batches:
        *kept, text = batch.columns
        parts = [fingerprint_group(data, cuts) for _, _, data, cuts in tokens.groups(text)]
        found = pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
        yield pa.RecordBatch.from_arrays([*kept, found], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *keys: Column) -> DataFrame:
    """``keys`` (doc_id, if none are given) and fp of each row of ``docs`` (doc_id, text)."""
    chosen = docs.select(*(keys or [F.col("doc_id").cast("bigint")]), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_fingerprints, chosen.drop("text").schema.add("fp", "long"))


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, key: int, radius: int) -> Iterator[int]:
        """Indexes of the keys at a distance of ``radius`` or less."""
        todo = [0] if self.keys else []
        while todo:
            i = todo.pop()
            d = (self.keys[i] ^ key).bit_count()
            if d <= radius:
                yield i
            todo.extend(child for edge, child in self.children[i].items() if -radius <= edge - d <= radius)

    def add(self, key: int) -> None:
        at = 0
        if self.keys:
            while True:
                d = (self.keys[at] ^ key).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = len(self.keys)
                    break
                at = below
        self.keys.append(key)
        self.children.append({})


def shard_links(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """A star per connected group of one shard: (least key of the group, other key). Keys are distinct and signed."""
    tree, root = BKTree(), list(range(len(keys)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, key in enumerate(keys):
        bits = key & 0xFFFFFFFFFFFFFFFF
        for j in tree.near(bits, radius):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
        tree.add(bits)
    return [(keys[find(i)], keys[i]) for i in range(len(keys)) if find(i) != i]


def _links(radius: int):
    """Runs of equal shard in a partition sorted by shard and fingerprint; a run may go over several batches."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shards, fps):
            """Links of complete runs; shards of one fingerprint are passed over at once."""
            if not len(shards):
                return
            edge = np.flatnonzero(np.diff(shards)) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(shards)]
            many = np.flatnonzero(ends - starts > 1)
            pairs = [p for k in many for p in shard_links(fps[starts[k] : ends[k]].tolist(), radius)]
            if pairs:
                v, u = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            shards, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(shards):
                continue
            cut = int(np.searchsorted(shards, shards[-1], "left"))
            if cut or (held and held[0][0][0] != shards[0]):
                held.append((shards[:cut], fps[:cut]))
                yield from done(*(np.concatenate(c) for c in zip(*held)))
                held = []
            held.append((shards[cut:], fps[cut:]))
        if held:
            yield from done(*(np.concatenate(c) for c in zip(*held)))

    return link


def _shards(fp: Column) -> Column:
    """The shards of a fingerprint: a name for each pair of its six blocks with their bits."""
    masks, low = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << low)
        low += width
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    pairs = list(itertools.combinations(masks, 2))
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(a | b)))) for i, (a, b) in enumerate(pairs)])


def near_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (``fp``) at most ``radius`` (up to 4) bits apart.

    Only a star per connected group of a shard leaves a task, not its pairs.
    """
    if radius > 4:
        raise ValueError("six blocks, two of them equal, prove a radius of at most 4")
    dealt = nodes.select(F.explode(_shards(F.col("fp"))).alias("shard"), "fp")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(_links(radius), "u BIGINT, v BIGINT").distinct()


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (distinct ``fp`` and more) with the ``root`` of their group: its least fingerprint."""
    labels = components(near_links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    return nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fp (signed 64 bits) and component_id.

    Equal fingerprints become one node first, however many documents share one. The trees are
    small and many: one for each shard, grown and searched in the task that holds the shard's fingerprints.
    Null and empty texts, and texts without words, have fingerprint zero and link like any other.
    component_id is the smallest doc_id of the group; null ids count only if there is no other.
    """
    marked = staged(fingerprints(docs), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    rooted = staged(_rooted(nodes, radius), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(rooted.join(ids, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


KEY = ["no_id", "id", "one", "two"]


def one_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, nulls last.

    A row is told from others by its id and two 64-bit hashes of its text. Of rows that share an id, the least by
    these hashes stays; of rows equal in id and text, any one. All columns stay, whatever their names.
    Groups are those of ``near_duplicates``; rows without words are one of them. An empty table gives no rows.
    """
    doc_id = F.col("doc_id").cast("bigint")
    text_hash = lambda seed: F.xxhash64(F.lit(seed), F.col("text").cast("string"))
    key = [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), text_hash(1).alias("one"), text_hash(2).alias("two")]
    marked = staged(fingerprints(docs, *key), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min(F.struct(*KEY)).alias("least")), "nodes")
    chosen = _rooted(nodes, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    times = marked.groupBy(*KEY).agg((F.count("*") > 1).alias("again"))
    keep = staged(times.join(chosen, KEY, "left_semi"), "kept")
    rows = docs.select(F.struct("*").alias("row"), *key)
    out = rows.join(keep.where("NOT again"), KEY, "left_semi")
    if not keep.where("again").isEmpty():
        # Rows that repeat are reduced to one before they meet, so that a hot row is no hot key of the join.
        out = out.unionByName(rows.dropDuplicates(KEY).join(keep.where("again"), KEY, "left_semi"))
    return out.select("row.*")


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
