"""Substring deduplication by recompression: pairs of words become symbols, symbols become phrases, repeats meet by name.

A round names adjacent pairs of words: each word is a left or a right one by its name, and a left word
followed by a right one becomes one symbol. Where a passage repeats, all its symbols but those at its
two ends are the same again. The symbol that is least in a stretch of 14 words ends a phrase, so phrases,
too, are the same in the inside of every repeat. Spark then names, in three rounds:

1. the six words at the head of each phrase; a head seen once belongs to no repeat, and its phrase is done;
2. whole phrases; all occurrences of a phrase but the first are repeats as they stand;
3. the windows of the phrases that are left: first occurrences, and phrases at the ends of repeats.

A name is a function of the words, the same on every executor. Phrases are compared by 96 bits of
names, windows by 128. Runs of one word stay single symbols, since a window can begin inside a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm import tokens
from roostline.llm.common import table
from roostline.session import staged

WINDOW = 20
HEAD = 6
# A phrase head lies behind the first word of a window and has all its words inside it.
STRETCH = WINDOW - HEAD
LEAST = -(2**63)
UNKNOWN, SHARED, LATER = 0, 1, 2
# What tells texts apart: the id, then 95 bits of hashes of the text; the last bit of ``tie`` tells that there is no id.
KEY = ["doc", "sub", "tie"]
CHUNK = 1 << 16

PHRASE = {"route": "BIGINT", "phrase": "BIGINT", "other": "INT", "status": "TINYINT", "doc": "BIGINT", "sub": "BIGINT", "tie": "INT", "start": "INT", "count": "TINYINT"}
FOUND = {"route": "BIGINT", "other": "BIGINT", "status": "TINYINT", "doc": "BIGINT", "sub": "BIGINT", "tie": "INT", "start": "INT"}
_TYPES = {"BIGINT": pa.int64(), "INT": pa.int32(), "TINYINT": pa.int8()}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _batches(columns: dict[str, str], arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, _TYPES[t]) for c, t in columns.items()])
    for low in range(0, len(arrays[0]), CHUNK):
        cut = [a[low : low + CHUNK] for a in arrays]
        signed = [a.view(np.int64) if a.dtype == np.uint64 else a for a in cut]
        yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(signed, schema)], schema=schema)


class Ranges:
    """Names of word ranges, from prefix sums of a polynomial in the words' names."""

    def __init__(self, names: np.ndarray, base: int) -> None:
        n = len(names) + 1
        up = np.full(n, base, np.uint64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self.down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.down, out=self.down)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(names * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return tokens.mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * tokens.ODD)


def first_names(names: np.ndarray) -> Ranges:
    return Ranges(names, 0x9FB21C651E98DF25)


def second_names(others: np.ndarray) -> Ranges:
    return Ranges(others, 0xA24BAED4963EE407)


def symbols(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rank of the symbol that starts at each word; the highest rank where none starts.

    ``first``: word offsets of the texts. Rank and place of a symbol depend on the word before and two from it on.
    """
    n = len(names)
    left = (tokens.mixed(names + tokens.ODD) >> np.uint64(63)).astype(bool)
    last = np.zeros(n, bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    pair = np.zeros(n, bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
    rank = tokens.mixed(names ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1 << 63)
    # Pairs rank before single words: they are rarer.
    two = np.flatnonzero(pair)
    rank[two] = tokens.mixed(names[two] * np.uint64(0xA0761D6478BD642F) + names[two + 1]) >> np.uint64(1)
    rank[two + 1] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return rank


def phrases(names: np.ndarray, others: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of the texts, from both names of their words: text, first window (from 0 in its text), windows, name of the head, two names of the phrase.

    The windows of a phrase are the consecutive ones in which the same symbol ranks least.
    """
    count = np.diff(first)
    windows = np.maximum(count - WINDOW + 1, 0)
    if not windows.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.int32)
    n = len(names)
    # Rank above, place below: the least value is the leftmost symbol of the least rank.
    order = (symbols(names, first) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    two = np.minimum(order[:-1], order[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    least = np.minimum(eight[: n - STRETCH + 1], eight[STRETCH - 8 : n - STRETCH + 1 + STRETCH - 8])
    text = np.repeat(np.arange(len(count)), windows)
    within = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = first[text] + within
    head = (least[begin + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.diff(head, prepend=-1) | np.diff(text, prepend=-1))
    size = np.diff(np.r_[edge, len(head)])
    name, a, b = first_names(names), begin[edge], begin[edge] + size + WINDOW - 1
    other = (second_names(others).of(a, b) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return text[edge], within[edge], size, name.of(head[edge], head[edge] + HEAD), name.of(a, b), other


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of texts: first, last + 1, both names of the words, and word offsets of the texts."""
    for low, high, data, starts, ends, first in _texts(texts):
        yield low, high, tokens.names(data, starts, ends), tokens.names(data, starts, ends, tokens.OTHER_VALUES), first


def _scattered(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where rows go whose fate is known: anywhere, evenly."""
    return tokens.mixed(doc.astype(np.uint64) * tokens.ODD + start.astype(np.uint64))


def _elsewhere(other: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Rows whose place is not that of the row ``other``; a row that is there twice is at one place."""
    return np.logical_or.reduce([p != p[other] for p in place])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases of the documents (doc, sub, tie, text). What a batch can tell by itself is settled here.

    A phrase met before in the batch is a repeat. Of the phrases that share a head one row goes to the other
    batches' rows of that head; so a head of which there are very many arrives once per batch.
    """
    for batch in batches:
        keys = [batch.column(i).to_numpy() for i in range(3)]
        order = np.lexsort(keys[::-1])
        texts = batch.column(3).take(pa.array(order))
        parts = []
        for low, _, names, others, first in _words(texts):
            text, *rest = phrases(names, others, first)
            parts.append((text + low, *rest))
        if not parts:
            continue
        text, start, size, head, name, other = (np.concatenate(c) for c in zip(*parts))
        if not len(text):
            continue
        doc, sub, tie = (k[order][text] for k in keys)
        _, head_at, head_of, head_times = np.unique(head, return_index=True, return_inverse=True, return_counts=True)
        both = tokens.mixed(name + head * tokens.ODD) ^ other.view(np.uint32)
        _, name_at, name_of = np.unique(both, return_index=True, return_inverse=True)
        status = np.where(head_times[head_of] > 1, SHARED, UNKNOWN).astype(np.int8)
        first = name_at[name_of]
        status[_elsewhere(first, doc, sub, tie, start) & (name[first] == name) & (other[first] == other)] = LATER
        route = np.where(head_at[head_of] == np.arange(len(head)), head, _scattered(doc, start))
        yield from _batches(PHRASE, [route, name, other, status, doc, sub, tie, start, size])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route: those whose head occurs again, and those known to be shared or repeated."""
    held: pa.Table | None = None
    before = None  # the route of the row before the held one

    def known(rows: pa.Table, previous, following) -> Iterator[pa.RecordBatch]:
        route = rows.column("route").to_numpy()
        same = np.r_[previous is not None and route[0] == previous, route[1:] == route[:-1]]
        again = np.r_[same[1:], following is not None and route[-1] == following]
        keep = same | again | (rows.column("status").to_numpy() > UNKNOWN)
        yield from rows.filter(pa.array(keep)).combine_chunks().to_batches(CHUNK)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            yield from known(held, before, rows.column("route")[0].as_py())
            before = held.column("route")[-1].as_py()
        held = rows
    if held is not None:
        yield from known(held, before, None)


def _repeats(keys: tuple[str, ...]):
    """Rows sorted by ``keys`` and then by place: marks those of equal keys as later that are not at the first place."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = place = None  # keys and first place of the run that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [batch.column(k).to_numpy() for k in keys]
            places = [batch.column(k).to_numpy() for k in (*KEY, "start")]
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
            first = np.maximum.accumulate(np.where(fresh, np.arange(batch.num_rows), 0))
            later = _elsewhere(first, *places)
            if run == tuple(v[0] for v in values):
                head = first == 0
                later[head] = np.logical_or.reduce([p[head] != x for p, x in zip(places, place)])
            else:
                place = None
            end = first[-1]
            if end or place is None:
                place = tuple(p[end] for p in places)
            run = tuple(v[-1] for v in values)
            status = batch.column("status").to_numpy()
            status = np.where(later & (status < LATER), LATER, status).astype(np.int8)
            at = batch.schema.get_field_index("status")
            yield batch.set_column(at, batch.schema.field(at), pa.array(status))

    return mark


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, count) of a column of lists of (start, count)."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return row, flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)


def _expanded(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... start + count - 1, one range after the other."""
    total = count.sum()
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the windows that the spans of the documents (doc, sub, tie, text, spans) list."""
    for batch in batches:
        row, start, count = _spans(batch.column(4))
        by_row = np.argsort(row, kind="stable")
        row, start, count = row[by_row], start[by_row], count[by_row]
        parts = []
        for low, high, names, others, first in _words(batch.column(3)):
            a, b = np.searchsorted(row, low), np.searchsorted(row, high)
            if a == b:
                continue
            at = _expanded(start[a:b], count[a:b])
            owner = np.repeat(row[a:b], count[a:b])
            begin = first[owner - low] + at
            parts.append((owner, at, first_names(names).of(begin, begin + WINDOW), second_names(others).of(begin, begin + WINDOW)))
        if not parts:
            continue
        owner, at, one, two = (np.concatenate(c) for c in zip(*parts))
        doc, sub, tie = (batch.column(i).to_numpy()[owner] for i in range(3))
        order = np.lexsort((at, tie, sub, doc))
        doc, sub, tie, at, one, two = (x[order] for x in (doc, sub, tie, at, one, two))
        _, seen, which = np.unique(one, return_index=True, return_inverse=True)
        again = _elsewhere(seen[which], doc, sub, tie, at) & (two[seen[which]] == two)
        status = np.where(again, LATER, SHARED).astype(np.int8)
        yield from _batches(FOUND, [np.where(again, _scattered(doc, at), one), two, status, doc, sub, tie, at])


REPORT = "doc BIGINT, tie INT, n_words BIGINT, n_removed BIGINT, kept_sha256 STRING, kept STRING"


def _remove(with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops the words of all windows that the spans of the documents (doc, sub, tie, text, spans) list."""
        for batch in batches:
            row, start, count = _spans(batch.column(4))
            by_row = np.argsort(row, kind="stable")
            row, start, count = row[by_row], start[by_row], count[by_row]
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for low, high, data, starts, ends, first in _texts(batch.column(3)):
                a, b = np.searchsorted(row, low), np.searchsorted(row, high)
                begin = first[row[a:b] - low] + start[a:b]
                covers = np.zeros(len(starts) + 1, np.int64)
                np.add.at(covers, begin, 1)
                np.add.at(covers, begin + count[a:b] + WINDOW - 1, -1)
                keep = np.cumsum(covers)[:-1] == 0
                # The kept words again, a space after each.
                s, e = starts[keep], ends[keep]
                after = np.cumsum(e - s + 1)
                joined = np.full(after[-1] if len(after) else 0, 0x20, np.uint8)
                inside = np.ones(len(joined), bool)
                inside[after - 1] = False
                joined[inside] = data[_expanded(s, e - s)]
                kept_before = np.r_[0, np.cumsum(keep)][first]
                edges = np.r_[0, after][kept_before]
                whole = joined.tobytes()
                for x, y in zip(edges[:-1], edges[1:]):
                    text = whole[x : max(x, y - 1)]
                    digests.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        kept_texts.append(text.decode())
                n_words.append(np.diff(first))
                n_removed.append(np.diff(first) - np.diff(kept_before))
            join = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))
            texts = pa.array(kept_texts if with_text else [None] * len(digests), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), join(n_words), join(n_removed), pa.array(digests, pa.string()), texts],
                names=["doc", "tie", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return remove


def _texts(texts: pa.Array):
    """Per group of texts: first, last + 1, bytes, word starts and ends, and word offsets of the texts."""
    for low, high, data, cuts in tokens.groups(texts):
        starts, ends = tokens.spans(data, cuts, tokens.IS_SPACE)
        yield low, high, data, starts, ends, np.searchsorted(starts, cuts)


def _listed(spans: DataFrame) -> DataFrame:
    """One row per document with its spans; there are no more of them than words in it."""
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "count")).alias("spans"))


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the text that stays).

    A window is 20 consecutive words of a document. Each word that a window covers is removed if the same words
    already start earlier: in a document of smaller id (null is the smallest), or earlier in the same one.
    All windows are judged on the input. Rows of equal id and text are one document and get the same result;
    rows of equal id and different texts follow each other by hashes of the text, and so do null ids and -2**63. Null texts have no words, texts
    under 20 words no window; an empty table gives no rows.
    """
    doc_id, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    named = lambda seed: F.xxhash64(F.lit(seed), text)
    tie = F.shiftright(named(2), 32).cast("int").bitwiseAND(-2).bitwiseOR(doc_id.isNull().cast("int"))
    given = docs.select(F.coalesce(doc_id, F.lit(LEAST)).alias("doc"), named(1).alias("sub"), tie.alias("tie"), text.alias("text"))
    place = [*KEY, "start"]

    cut = given.mapInArrow(_cut, _ddl(PHRASE)).repartition("route").sortWithinPartitions("route")
    candidates = staged(cut.mapInArrow(_shared, _ddl(PHRASE)), "phrases")
    # A phrase that its batch has settled need not meet the others of its name.
    target = F.when(F.col("status") == LATER, F.col("route")).otherwise(F.col("phrase"))
    dealt = candidates.withColumn("route", target).repartition("route").sortWithinPartitions("route", "other", *place)
    settled = staged(dealt.mapInArrow(_repeats(("route", "other")), _ddl(PHRASE)).drop("route", "phrase", "other"), "phrases")

    # A document that is there twice has its phrases listed once.
    later = settled.where(F.col("status") == LATER).select(*place, "count")
    open_ = _listed(settled.where(F.col("status") < LATER).select(*place, "count").distinct())
    found = given.join(open_, KEY).select(*KEY, "text", "spans").mapInArrow(_windows, _ddl(FOUND))
    ordered = found.repartition("route").sortWithinPartitions("route", "other", *place)
    windows = ordered.mapInArrow(_repeats(("route", "other")), _ddl(FOUND)).where(F.col("status") == LATER)
    gone = _listed(later.unionByName(windows.select(*place, F.lit(1).cast("tinyint").alias("count"))))
    # Both joins shuffle the same columns of the documents, so that it is done once.
    report = given.join(gone, KEY, "left").select(*KEY, "text", "spans").mapInArrow(_remove(with_text), REPORT)
    doc_id = F.when(F.col("tie").bitwiseAND(1) == 0, F.col("doc")).alias("doc_id")
    return report.select(doc_id, "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else []))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
