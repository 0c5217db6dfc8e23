"""Periodic runs of words: recursive frequency splitting, then a scan of lags over the segments that survive.

A run of period q has at least four times q words, so each of its words occurs four times in it. A word that
occurs less often within a segment therefore splits it; the parts are counted again, until every word of
every segment occurs often enough. In prose nearly nothing is left by then. For each lag q, a run holds a
stretch of three times q words that begins at a multiple of q from its segment's start, and there the first
and the last two thirds are equal: so a segment of m words takes some m log m comparisons of range names.
Equal names only nominate; each run is measured word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roostline.llm import tokens
from roostline.llm.common import WORD, table

TIMES = 4
LEAST = 6
# Comparisons of range names made at once.
PROBES = 1 << 20


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; equal words, and only they, have equal numbers."""
    sizes = ends - starts
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def segments(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) of the texts that begin at ``first`` in which each word occurs ``TIMES`` times or more."""
    place = np.arange(len(ids))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stable: list[tuple[int, int]] = []
    while len(place):
        key = segment * (ids.max() + 1) + ids[place]
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        often = times[which] >= TIMES
        # Segments that lost no word are done; the others fall apart where one went.
        split = np.zeros(segment[-1] + 1, bool)
        split[segment[~often]] = True
        done = place[~split[segment]]
        if len(done):
            owner = segment[~split[segment]]
            edge = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.r_[edge, len(done)])
            stable += [(int(s), int(s + n)) for s, n in zip(done[edge], size) if n >= LEAST]
        keep = often & split[segment]
        place, segment = place[keep], segment[keep]
        if len(place):
            segment = np.cumsum((np.diff(place, prepend=place[0]) > 1) | (np.diff(segment, prepend=segment[0]) > 0))
            long = np.bincount(segment)[segment] >= LEAST
            place, segment = place[long], segment[long]
    return sorted(stable)


def _agreement(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around ``at`` within [low, high) in which words ``lag`` apart are equal."""
    start, size = at, 32
    while start > low:
        begin = max(low, start - size)
        differ = np.flatnonzero(ids[begin:start] != ids[begin + lag : start + lag])
        if len(differ):
            start = begin + int(differ[-1]) + 1
            break
        start, size = begin, size * 2
    end, size = at, 32
    while end + lag < high:
        upto = min(high - lag, end + size)
        differ = np.flatnonzero(ids[end:upto] != ids[end + lag : upto + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, size = upto, size * 2
    return start, end + lag


def runs(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of the texts whose words are ``ids``, by start and period; places count over all texts."""
    found: list[tuple[int, int, int]] = []
    cut = segments(ids, first)
    if not cut:
        return found
    low, high = (np.array(c, np.int64) for c in zip(*cut))
    base = np.uint64(0xD1342543DE82EF95)
    up = np.full(len(ids) + 1, base, np.uint64)
    up[0] = 1
    np.multiply.accumulate(up, out=up)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(tokens.mixed(ids.astype(np.uint64) + tokens.ODD) * up[:-1], out=sums[1:])

    lags = (high - low) // TIMES
    owner = np.repeat(np.arange(len(cut)), lags)
    lag = np.arange(len(owner)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    reach = np.where(lag == 1, LEAST, (TIMES - 1) * lag)
    probes = (high - low)[owner] // lag - reach // lag + 1
    owner, lag, reach, probes = (x[probes > 0] for x in (owner, lag, reach, probes))
    # What covers a place: of the stretches found so far, the one that reaches farthest, as its end and period.
    end_of, period_of, known = np.zeros(len(ids), np.int64), np.ones(len(ids), np.int64), set()
    cuts = np.searchsorted(np.cumsum(probes), np.arange(PROBES, probes.sum() + PROBES, PROBES), "right")
    begin = 0
    for upto in [*np.unique(cuts[cuts > 0]), len(owner)]:
        upto = max(int(upto), begin)
        some = np.repeat(np.arange(begin, upto), probes[begin:upto])
        step = np.arange(len(some)) - np.repeat(np.cumsum(probes[begin:upto]) - probes[begin:upto], probes[begin:upto])
        begin = upto
        at, q, w = low[owner[some]] + step * lag[some], lag[some], reach[some]
        near = (sums[at + w - q] - sums[at]) * up[q] == sums[at + w] - sums[at + q]
        at, q, w, some = at[near], q[near], w[near], owner[some][near]
        order = np.lexsort((at, q, some))
        at, q, w, some = at[order], q[order], w[order], some[order]
        i = 0
        while i < len(at):
            x, period = int(at[i]), int(q[i])
            if end_of[x] >= x + w[i] and period % period_of[x] == 0:
                i += 1
                continue
            start, end = _agreement(ids, x, period, int(low[some[i]]), int(high[some[i]]))
            if (start, end) not in known and end - start >= (TIMES - 1) * period:
                known.add((start, end))
                farther = end_of[start:end] < end
                end_of[start:end][farther], period_of[start:end][farther] = end, period
                if end - start >= max(LEAST, TIMES * period):
                    found.append((start, end, period))
            i += 1
            if end - start > 1000:
                # A long stretch nominates itself at many places and multiples of its period.
                rest = np.flatnonzero(~((end_of[at[i:]] >= at[i:] + w[i:]) & (q[i:] % period_of[at[i:]] == 0))) + i
                at, q, w, some, i = at[rest], q[rest], w[rest], some[rest], 0
    return sorted(found, key=lambda r: (r[0], r[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns but the last, which is the text, then n_words, runs and collapsed."""
    for batch in batches:
        *kept, texts = batch.columns
        n_words, owners, places, collapsed = [], [], [], []
        for low, _, data, cuts in tokens.groups(texts):
            starts, ends = tokens.spans(data, cuts, tokens.IS_SPACE)
            first = np.searchsorted(starts, cuts)
            n_words.append(np.diff(first))
            found = runs(exact_ids(data, starts, ends), first) if len(starts) else []
            table = np.array(found, np.int64).reshape(-1, 3)
            text = np.searchsorted(first, table[:, 0], "right") - 1
            owners.append(text + low)
            places.append(np.stack([table[:, 0] - first[text], table[:, 1] - table[:, 0], table[:, 2]]))
            covers = np.zeros(len(starts) + 1, np.int64)
            np.add.at(covers, table[:, 0] + table[:, 2], 1)
            np.add.at(covers, table[:, 1], -1)
            keep = np.cumsum(covers)[:-1] == 0
            # The kept words again, a space after each.
            s, e = starts[keep], ends[keep]
            after = np.cumsum(e - s + 1)
            joined = np.full(after[-1] if len(after) else 0, 0x20, np.uint8)
            inside = np.ones(len(joined), bool)
            inside[after - 1] = False
            joined[inside] = data[np.repeat(s - (np.cumsum(e - s) - (e - s)), e - s) + np.arange((e - s).sum())]
            edges = np.r_[0, after][np.r_[0, np.cumsum(keep)][first]]
            whole = joined.tobytes()
            collapsed += [whole[x : max(x, y - 1)].decode() for x, y in zip(edges[:-1], edges[1:])]
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        start, length, period = np.concatenate([np.zeros((3, 0), np.int64), *places], axis=1)
        spans = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"])
        offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
        count = pa.array(np.concatenate([np.zeros(0, np.int64), *n_words]))
        columns = [*kept, count, pa.ListArray.from_arrays(offsets, spans), pa.array(collapsed, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns of ``docs`` (default: doc_id) with ``n_words``, ``runs`` and ``collapsed``, one row per row.

    A run (start, length, period) is a stretch of consecutive words whose smallest period q is at most a quarter of
    its length, of six words or more, that no neighbouring word extends at that period. Runs are listed by start, then
    period. ``collapsed`` is the text without the words that lie in any run behind its first q words, one space between
    words. Words are split at white space and compared byte by byte; a null or empty text has no words, no
    runs and an empty ``collapsed``. Rows are scanned on their own: repeated rows get equal results, null ids stay
    null, an empty table gives no rows, other columns of ``docs`` are not looked at. A task holds one batch of texts.
    """
    chosen = docs.select(*(kept or [F.col("doc_id").cast("bigint").alias("doc_id")]), F.col("text").cast("string").alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("_text").schema)
    runs_type = "ARRAY<STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>>"
    return chosen.mapInArrow(_scan, f"{out}, n_words BIGINT, runs {runs_type}, collapsed STRING")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; one document in ten (by the CRC-32 of its id) repeats itself from some word on.

    Of n words, those from a = g % n on become the p words from there, over and over, p = 1 + (n - a) // (3 + g % 8),
    where g is the CRC-32 without its last digit. A document without an id stays as it is.
    """
    doc_id = F.col("doc_id").cast("bigint")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select(doc_id.alias("doc_id"), F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs(with_planted_period(table(spark, folder, "documents")))
    # The first of those with the greatest length / period, compared without division.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
