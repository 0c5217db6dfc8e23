"""Language identification by cross-parsing: how many phrases of a language's sample does a text need?"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm import tokens
from roostline.llm.common import id_fold, table, without
from roostline.session import staged

FOLDS, HELD_OUT = 3, 1
# Bounds of the sample that is fitted: documents per language, characters of each, and symbols per automaton.
SAMPLE_DOCS = 80
SAMPLE_CHARS = 3000
# Where a language has not so many documents of LONG characters, shorter ones fill up, as many as have the same characters together.
LONG = 200
SHORT_DOCS = SAMPLE_DOCS * SAMPLE_CHARS // LONG
# A rate from a few symbols counts as if so many more had been covered, or a language of one word would win every text.
DOUBT = 20
REFERENCE = 40_000
BASELINE = 20_000
# All automata together: with more than 40 languages each gets fewer symbols, so that the model stays below some 60 MB.
TOTAL = 40 * REFERENCE
# A text is parsed in stretches of so many symbols, all languages and many stretches side by side.
STRETCH = 256
SIDE_BY_SIDE = 4096

GAP, UNSEEN = 0, 1
# Slots that are tried for the edges of one state before they go behind all others.
TRIES = 64


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts the substrings of ``symbols``; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow


@dataclass
class Model:
    """Suffix automata of all languages. The edges of a state lie at ``first[state] + symbol``; a slot whose ``owner`` is another
    state holds none of its edges. Start states keep their edges apart, in ``opening`` (language, symbol): whatever follows a start
    begins a phrase, and so does a symbol for which a state has no edge. ``rates``: phrases per symbol of a language's own text.
    """

    languages: list[str]
    letters: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    opening: np.ndarray
    rates: np.ndarray


def packed(follow: list[dict[int, int]], width: int) -> tuple[np.ndarray, ...]:
    """``first``, ``owner``, ``target`` and ``opening`` of one automaton: few edges a state share one array by displacement."""
    first = np.zeros(len(follow), np.int32)
    several = sorted((q for q in range(1, len(follow)) if len(follow[q]) > 1), key=lambda q: -len(follow[q]))
    taken: dict[int, tuple[int, int]] = {}
    low = top = width
    for q in several:
        symbols = sorted(follow[q])
        while low in taken:
            low += 1
        for at in range(low, low + TRIES):
            if not any(at + c - symbols[0] in taken for c in symbols):
                break
        else:
            at = max(top, low)
        first[q] = at - symbols[0]
        for c in symbols:
            taken[at + c - symbols[0]] = (q, follow[q][c])
        top = max(top, at + symbols[-1] - symbols[0] + 1)
    one = np.array([(q, *edge) for q, edges in enumerate(follow) if q and len(edges) == 1 for edge in edges.items()], np.int64).reshape(-1, 3)
    size = top + len(one) + width + 1
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    if taken:
        slots = np.fromiter(taken, np.int64, len(taken))
        owner[slots], target[slots] = np.array(list(taken.values()), np.int32).T
    # A state with one edge fits into any free slot.
    free = (np.flatnonzero(owner[width:] < 0) + width)[: len(one)]
    owner[free], target[free] = one[:, 0], one[:, 2]
    first[one[:, 0]] = free - one[:, 1]
    used = int(np.flatnonzero(owner >= 0).max(initial=width)) + width + 1
    opening = np.zeros(width, np.int32)
    opening[list(follow[0])] = list(follow[0].values())
    return first, owner[:used], target[:used], opening


def alphabet(texts: Iterable[str]) -> np.ndarray:
    """Code points of all letters of lower-cased texts, sorted."""
    return np.array(sorted({ord(c) for text in texts for c in set(text.lower()) if c.isalpha()}), np.int32)


def sample_classes(letters: np.ndarray) -> np.ndarray:
    """Symbol of each code point of the samples: a number per letter, gap for all others."""
    out = np.zeros(sys.maxunicode + 1, np.uint16 if len(letters) + 2 < 1 << 16 else np.int32)
    out[letters] = np.arange(2, len(letters) + 2)
    return out


def letter_classes(letters: np.ndarray) -> np.ndarray:
    """Symbol of each code point of any text: as in the samples, and unseen for letters that those lack."""
    out = sample_classes(letters)
    others = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    out[others & (out == GAP)] = UNSEEN
    return out


def symbols_of(text: str, classes: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols; a run of anything else is one gap."""
    found = classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(found) > 1:
        keep = found != GAP
        keep[0] = True
        keep[1:] |= found[:-1] != GAP
        found = found[keep]
    return found


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Longest-match phrases that each text needs in each language: (texts, languages).

    Every stretch of a text starts a phrase of its own, in all languages alike. All symbols count. A letter that a
    language has not at all needs two phrases: with one, it would cost as much as a known letter after which nothing is known.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    pieces = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), pieces)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    if not len(owner):
        return out
    cells = np.zeros((len(owner), STRETCH), texts[0].dtype)
    at = 0
    for t, n in zip(texts, pieces):
        cells[at : at + n].reshape(-1)[: len(t)] = t
        at += n
    size = np.full(len(owner), STRETCH)
    last = np.cumsum(pieces)[pieces > 0] - 1
    size[last] = lengths[pieces > 0] - (pieces[pieces > 0] - 1) * STRETCH
    # Long stretches first: those that have ended are cut off at the end of a block.
    order = np.argsort(-size, kind="stable")
    for low in range(0, len(owner), SIDE_BY_SIDE):
        some = order[low : low + SIDE_BY_SIDE]
        block = np.ascontiguousarray(cells[some].T)
        live = np.searchsorted(-size[some], -np.arange(STRETCH), "left")
        state = np.repeat(model.starts[:, None], len(some), axis=1)
        ended = np.zeros(state.shape, np.int32)
        for symbol, n in zip(block, live):
            if not n:
                break
            symbol, now = symbol[:n], state[:, :n]
            slot = model.first.take(now) + symbol
            hit = model.owner.take(slot) == now
            state = np.where(hit, model.target.take(slot), model.opening.take(symbol, axis=1))
            ended[:, :n] += ~hit
            ended[:, :n] += state == model.starts[:, None]
        np.add.at(out, owner[some], ended.T)
    return out


def joined(languages: list[str], letters: np.ndarray, parts: list[tuple]) -> Model:
    """One model of (first, owner, target, opening, rate) of each language."""
    slots = np.cumsum([0] + [len(p[1]) for p in parts])
    states = np.cumsum([0] + [len(p[0]) for p in parts])
    if max(slots[-1], states[-1]) >= 1 << 31:
        raise ValueError("the automata of all languages need more than 2**31 cells")
    put = lambda column, by: np.concatenate([p[column] + np.int32(d) for p, d in zip(parts, by)])
    owner = np.concatenate([np.where(p[1] < 0, -1, p[1] + np.int32(d)) for p, d in zip(parts, states)])
    opening = np.stack([p[3] + np.int32(d) for p, d in zip(parts, states)])
    return Model(languages, letters, states[:-1].astype(np.int32), put(0, slots), owner.astype(np.int32), put(2, states), opening, np.array([p[4] for p in parts]))


def fit_language(texts: list[str], letters: np.ndarray, classes: np.ndarray, most: int = REFERENCE) -> tuple:
    """A packed automaton over up to ``most`` symbols; the symbols after those give the language's own phrase rate."""
    own = symbols_of(" ".join(texts), classes)
    # Half of a small sample is left to measure the rate with.
    cut = min(most, max(1, len(own) * 2 // 3))
    reference = own[:cut].tolist()
    # Nothing that stands in a text is an unseen letter, and no edge is kept for one.
    part = packed(suffix_automaton(reference), len(letters) + 2)
    rest = own[cut : cut + BASELINE]
    alone = joined([""], letters, [(*part, 1.0)])
    return *part, max(1, int(phrases(alone, [rest])[0, 0])) / (len(rest) + DOUBT)


def fit(samples: dict[str, list[str]]) -> Model:
    """The model of samples that are at hand; ``fitted`` does the same on Spark."""
    languages, letters = sorted(samples), alphabet(t for texts in samples.values() for t in texts)
    classes, most = sample_classes(letters), min(REFERENCE, TOTAL // len(samples))
    return joined(languages, letters, [fit_language(samples[lang], letters, classes, most) for lang in languages])


def sampled(docs: DataFrame) -> DataFrame:
    """The sample that is fitted (lang, n, t): of each language the documents with the smallest hash of id and text, up to the bounds above.

    Only rows of the learning folds with a language and a letter count, equal ones once. Texts of 200 or more characters come
    first; shorter ones follow where a language has fewer than ``SAMPLE_DOCS`` of those, so that every such language has a
    sample. How many rows a language has decides below which hash they are looked at, so no task sees more than
    a few times the bound of a language, however many rows or tasks there are.
    """
    short = (F.length("text") < LONG).alias("short")
    learn = docs.where((id_fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    named = learn.select("lang", short, F.xxhash64("doc_id", "text").alias("h"), F.substring("text", 1, SAMPLE_CHARS).alias("t"))
    bound = F.when(F.col("short"), SHORT_DOCS).otherwise(SAMPLE_DOCS)
    # The count of distinct rows is right within a few hundredths; twice the bound is far beyond its error.
    sizes = named.groupBy("lang", "short").agg(F.approx_count_distinct("h", 0.02).alias("rows"))
    sizes = staged(sizes.select("lang", "short", ((2 * bound + 50) / F.col("rows")).alias("share")), "langid-sizes")
    near = named.join(sizes, ["lang", "short"]).where(F.shiftrightunsigned("h", 11) < F.col("share") * float(1 << 53))
    near = near.groupBy("lang", "short", "h").agg(F.min("t").alias("t"))
    order = Window.partitionBy("lang", "short").orderBy("h")
    size = F.length("t")
    chosen = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= bound)
    # Short ones fill up what long ones leave.
    together = Window.partitionBy("lang").orderBy("short", "rank").rowsBetween(Window.unboundedPreceding, -1)
    before = chosen.select("lang", "short", "rank", "t", F.sum(size).over(together).alias("chars"), F.sum((~F.col("short")).cast("int")).over(together).alias("long"))
    fills = (F.coalesce("chars", F.lit(0)) < SAMPLE_DOCS * SAMPLE_CHARS) & (F.coalesce("long", F.lit(0)) < SAMPLE_DOCS)
    return before.where(~F.col("short") | fills).select("lang", (F.col("short").cast("int") * SAMPLE_DOCS + F.col("rank")).alias("n"), "t")


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(alphabet(batch.column(0).to_pylist()))], names=["letter"])


def fitted(docs: DataFrame) -> Model | None:
    """The model of the sample of ``docs``; None if there is nothing to learn. Each language is fitted in a task of its own.

    The driver gets the letters and the packed automata, about 1.5 MB a language and 60 MB at most.
    """
    sample = staged(sampled(docs), "langid-sample")
    languages = sample.select("lang").distinct().count()
    if not languages:
        return None
    letters = np.array(sorted(r.letter for r in sample.select("t").mapInArrow(_letters, "letter INT").distinct().collect()), np.int32)
    most = max(1, min(REFERENCE, TOTAL // languages))

    def fit_group(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("n")
        *arrays, rate = fit_language(ordered["t"].tolist(), letters, sample_classes(letters), most)
        return pd.DataFrame({"lang": [ordered["lang"].iloc[0]], "arrays": [[a.tobytes() for a in arrays]], "rate": [rate]})

    found = sample.groupBy("lang").applyInPandas(fit_group, "lang STRING, arrays ARRAY<BINARY>, rate DOUBLE").collect()
    found.sort(key=lambda r: r.lang)
    return joined([r.lang for r in found], letters, [(*(np.frombuffer(a, np.int32) for a in r.arrays), r.rate) for r in found])


def _predict(shared, text_at: int, keep: list[int]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value) if shared.value else None
        classes = letter_classes(model.letters) if model else None
        for batch in batches:
            langs, scores = [], []
            for low, high, _, _ in tokens.groups(batch.column(text_at), 8 << 20):
                part = batch.column(text_at).slice(low, high - low)
                if model is None:
                    langs += ["und"] * len(part)
                    scores += [0.0] * len(part)
                    continue
                texts = [symbols_of(t or "", classes) for t in part.to_pylist()]
                blank = np.array([not (t != GAP).any() for t in texts])
                needed = phrases(model, texts) / model.rates
                best = needed.argmin(axis=1)
                ordered = np.sort(needed, axis=1)
                second = ordered[:, 1] if ordered.shape[1] > 1 else 2 * ordered[:, 0]
                score = np.where(blank | (second <= 0), 0.0, 1 - ordered[:, 0] / np.where(second > 0, second, 1))
                langs += ["und" if b else model.languages[i] for b, i in zip(blank, best)]
                scores += score.tolist()
            columns = [*(batch.column(i) for i in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in keep), "lang_pred", "score"])

    return predict


def predictions(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with ``held_out``, ``lang_pred`` and ``score``.

    A text is predicted from itself alone: the language wins whose sample covers it with the fewest
    longest-match phrases, each count divided by what the language needs for its own text. ``score`` is the
    lead over the second, from 0 to 1. Languages are learned from texts of any length, long ones first. Null texts, texts without a letter, and all texts where
    nothing can be learned are ``und`` with score 0. Ties go to the language first in order, an empty table
    gives no rows, columns of ``docs`` with the names of the added ones are replaced. Whole texts are parsed.
    """
    model = fitted(docs.select("doc_id", "text", "lang"))
    # Plain arrays, bounded by TOTAL.
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    plain = without(docs, "held_out", "lang_pred", "score")
    kept = plain.columns if columns is None else columns
    given = plain.withColumn("held_out", id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).select(*{*kept, "text"}, "held_out")
    out = given.select(*kept, "held_out").schema.add("lang_pred", "string").add("score", "double")
    at = given.columns.index
    return given.mapInArrow(_predict(shared, at("text"), [at(c) for c in (*kept, "held_out")]), out)


def identified_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is undetermined; all columns stay as they are."""
    return predictions(docs).where("lang_pred <> 'und'").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return predictions(table(spark, folder, "documents"), ["doc_id"])
