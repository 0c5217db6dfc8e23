"""Toxicity: a convolutional classifier over hashed word embeddings, trained on all labelled texts, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm import tokens
from roostline.llm.common import id_fold, table
from roostline.session import staged

FOLDS, HELD_OUT = 5, 0
# Bounds of a sample for trials in one process: labelled texts of each class, and their characters together. The query takes none.
PER_CLASS = 1500
CLASS_CHARS = 8_000_000
SPLIT = 5  # one in five labelled texts calibrates and does not train
LEAST = 50  # with fewer texts all of them do both
# So many texts and characters on average train side by side as one shard, however many shards that makes.
SHARD_DOCS = 16_384
SHARD_CHARS = 16_000_000

WIDTHS = (1, 2, 3)
FILTERS = 16
DIMENSIONS = 8
STEM = 4
HASH_BITS = 20  # names of words: bounds the model, whatever the texts hold
ROUNDS = 8
BATCH = 16
RATE = 0.05
SOME_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # the letters, digits and others that ``hashed_words`` takes
BINS = 256  # thresholds are found to 1/256 of a logit
# Changes of parameters are summed up as whole numbers of this share, so that no order of adding shows.
GRAIN = 2.0**-16

# Frequent words by which a text's language is guessed from itself, for the thresholds.
FREQUENT = {
    "en": "the and of to in is that for with was",
    "de": "der die und das ist nicht ein eine zu mit",
    "fr": "le les et des est une pour dans que pas",
    "es": "el los las y del por con una para se",
}


def hashed_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of consecutive texts: how many, 20-bit names of each lower-cased word and of its stem, words before each text.

    The stem is the first four bytes, so that forms of a word that the labelled texts lack still count.
    """
    for low, high, data, cuts in tokens.groups(texts):
        data = tokens.LOWER[data]
        starts, ends = tokens.spans(data, cuts, tokens.IS_PUNCTUATION)
        both = [tokens.names(data, starts, ends), ~tokens.names(data, starts, np.minimum(ends, starts + STEM))]
        yield high - low, (np.stack(both, axis=1) >> np.uint64(64 - HASH_BITS)).astype(np.int32), np.searchsorted(starts, cuts)


def frequent_words() -> dict[str, np.ndarray]:
    return {lang: np.unique(np.concatenate([f[:, 0] for _, f, _ in hashed_words(pa.array([w]))])) for lang, w in FREQUENT.items()}


@dataclass
class Model:
    """``vectors[0]`` is the zero vector of words that are not learned; ``keys`` are the names of the others, sorted."""

    keys: np.ndarray
    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    frequent: dict[str, np.ndarray]
    thresholds: dict[str, float]

    def lookup(self) -> np.ndarray:
        """Row of the vector by name."""
        out = np.zeros(1 << HASH_BITS, np.int32)
        out[self.keys] = np.arange(1, len(self.keys) + 1)
        return out


PADDING = max(WIDTHS) - 1


def _padded(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other with rows of zero after each, so that no window of a word joins two; where each begins, and which rows are padding.

    A window that begins in the padding would reach into the next text; its answer is 0.
    """
    begin = np.r_[0, np.cumsum(count + PADDING)]
    out, padding = np.zeros((begin[-1], rows.shape[1]), np.int32), np.ones(begin[-1], bool)
    at = np.arange(len(rows)) + PADDING * np.repeat(np.arange(len(count)), count)
    out[at], padding[at] = rows, False
    return out, begin[:-1], padding


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(parameter: np.ndarray, seen: np.ndarray, gradient: np.ndarray, at=...) -> None:
    """An AdaGrad step in place."""
    seen[at] += gradient**2
    parameter[at] -= RATE * gradient / np.sqrt(seen[at])


def _start(words: int, rng: np.random.Generator) -> tuple:
    """Parameters before any step, and the sums of squares that go with them."""
    vectors = rng.normal(0, 0.1, (words + 1, DIMENSIONS)).astype(np.float32)
    vectors[0] = 0
    filters = [rng.normal(0, 1 / np.sqrt(w * DIMENSIONS), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights, bias = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), np.zeros(1, np.float32)
    parameters = [vectors, *filters, *biases, weights, bias]
    return parameters, [np.full_like(x, 1e-2) for x in parameters]


def _parts(parameters: list[np.ndarray]) -> tuple:
    n = len(WIDTHS)
    return parameters[0], parameters[1 : 1 + n], parameters[1 + n : 1 + 2 * n], *parameters[1 + 2 * n :]


def _weights(clean: int, toxic: int) -> np.ndarray:
    """What an error counts by class: the rarer one more, by the root of its share, so that it is learned however rare it is."""
    return np.sqrt((clean + toxic) / (2 * np.array([clean, toxic]))).astype(np.float32)


def _train(rows: list[np.ndarray], labels: np.ndarray, words: int, weight: np.ndarray = np.ones(2, np.float32)) -> tuple:
    """All rounds over the texts at hand."""
    rng = np.random.default_rng(7)
    parameters, seen = _start(words, rng)
    for _ in range(ROUNDS):
        _round(parameters, seen, rows, labels, weight, rng)
    vectors, filters, biases, weights, bias = _parts(parameters)
    return vectors, filters, biases, weights, float(bias[0])


def _round(parameters: list[np.ndarray], seen: list[np.ndarray], rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One pass in place, in batches of texts. Through the pooling only the strongest position of a filter learns."""
    vectors, filters, biases, weights, bias = _parts(parameters)
    s_vectors, s_filters, s_biases, s_weights, s_bias = _parts(seen)
    order = rng.permutation(len(rows))
    for low in range(0, len(order), BATCH):
        some = order[low : low + BATCH]
        count = np.array([len(rows[t]) for t in some])
        ids, begin, padding = _padded(np.concatenate([rows[t] for t in some]), count)
        x = vectors[ids].sum(axis=1)
        tops, places = [], []
        for f, b in zip(filters, biases):
            answer = x @ f[0]
            for k in range(1, len(f)):
                answer[:-k] += x[k:] @ f[k]
            answer[padding] = 0
            top = np.maximum.reduceat(answer, begin, axis=0)
            at, which = np.nonzero(answer == np.repeat(top, count + PADDING, axis=0))
            place = np.empty(top.shape, np.int64)
            place[np.searchsorted(begin, at[::-1], "right") - 1, which[::-1]] = at[::-1]
            tops.append(top + b)
            places.append(place)
        top = np.concatenate(tops, axis=1)
        pooled = np.maximum(top, 0)
        error = (_sigmoid(pooled @ weights + bias) - labels[some]).astype(np.float32) * weight[labels[some]]
        back = error[:, None] * weights * (top > 0)
        _descend(weights, s_weights, pooled.T @ error)
        _descend(bias, s_bias, error.sum(keepdims=True))
        touched, moves = [], []
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            _descend(biases[i], s_biases[i], g.sum(axis=0))
            g = g * ~padding[places[i]]
            for k in range(w):
                at = np.minimum(places[i] + k, len(ids) - 1)
                touched.append(ids[at].reshape(-1, 2))
                moves.append((g[:, :, None] * filters[i][k].T).reshape(-1, DIMENSIONS))
                _descend(filters[i][k], s_filters[i][k], np.einsum("bfd,bf->df", x[at], g))
        touched, moves = np.concatenate(touched), np.concatenate(moves)
        distinct, which = np.unique(touched.T.reshape(-1), return_inverse=True)
        gradient = np.zeros((len(distinct), DIMENSIONS), np.float32)
        np.add.at(gradient, which, np.concatenate([moves, moves]))
        _descend(vectors, s_vectors, gradient, distinct)
        vectors[0] = 0


def _logits(model: Model, names: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One logit per text; ``first`` are the word offsets of the texts."""
    rows, begin, padding = _padded(table.take(names), np.diff(first))
    pooled = []
    x = model.vectors.take(rows[:, 0], axis=0)
    x += model.vectors.take(rows[:, 1], axis=0)
    for f, b in zip(model.filters, model.biases):
        answer = x @ f[0]
        for k in range(1, len(f)):
            answer[:-k] += x[k:] @ f[k]
        answer[padding] = 0
        pooled.append(np.maximum(np.maximum.reduceat(answer, begin, axis=0) + b, 0))
    return np.concatenate(pooled, axis=1) @ model.weights + model.bias


def _guess(model: Model, names: np.ndarray, first: np.ndarray) -> list[str]:
    """The language whose frequent words a text holds most often; empty if it holds none."""
    langs = sorted(model.frequent)
    count = np.stack([np.add.reduceat(np.r_[np.isin(names[:, 0], model.frequent[lang]), False].astype(np.int64), first[:-1]) * (np.diff(first) > 0) for lang in langs])
    return [langs[i] if n else "" for i, n in zip(count.argmax(axis=0), count.max(axis=0))]


def _threshold(bins: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the fewest weighted errors, between bins of logits, sorted, that hold so much of each class; the middle of the gap it lies in."""
    total = np.r_[0, np.cumsum(toxic)] + np.sum(clean) - np.r_[0, np.cumsum(clean)]
    best = np.flatnonzero(total <= total.min() + 1e-9)
    k = int(best[len(best) // 2])
    below, above = np.r_[bins[0] - 2 * BINS, bins], np.r_[bins, bins[-1] + 2 * BINS]
    return float((below[k] + 1 + above[k]) / 2 / BINS)


def _thresholds(found: list[tuple[str, int, int, int]], prior: float) -> dict[str, float]:
    """A cut for all texts and one for each language with 20 texts of either class, from (language, bin, class, texts)."""
    langs, (bins, toxic, n) = np.array([f[0] for f in found], object), np.array([f[1:] for f in found], np.int64).reshape(-1, 3).T
    share = n[toxic == 1].sum() / n.sum()
    weight = n * np.where(toxic == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
    out = {}
    for lang in ["", *FREQUENT]:
        own = langs == lang if lang else np.ones(len(n), bool)
        if not lang or min(n[own & (toxic == 0)].sum(), n[own & (toxic == 1)].sum()) >= 20:
            distinct, which = np.unique(bins[own], return_inverse=True)
            clean, bad = (np.bincount(which, weight[own] * (toxic[own] == c), len(distinct)) for c in (0, 1))
            out[lang] = _threshold(distinct, clean, bad)
    return out


def _calibration(model: Model, names: list[np.ndarray], labels: np.ndarray, table: np.ndarray) -> Iterator[tuple[str, int, int]]:
    """Per text: the language guessed, the bin of the logit, the class."""
    first = np.r_[0, np.cumsum([len(n) for n in names])]
    joined = np.concatenate(names)
    bins = np.floor(_logits(model, joined, first, table).astype(np.float64) * BINS).astype(np.int64)
    return zip(_guess(model, joined, first), bins.tolist(), labels.tolist())


def fit(texts: list[str], labels: list[int], prior: float) -> Model | None:
    """The model of texts that are at hand, in one process; ``fitted`` does the same on Spark for texts of any number.

    None if one of the classes has too few texts to learn from. ``prior``: share of label 1 among all labelled rows.
    """
    y = np.array(labels, np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    names: list[np.ndarray] = []
    for n, found, first in hashed_words(pa.array(texts, pa.large_string())):
        names += [found[first[i] : first[i + 1]] for i in range(n)]
    held = np.arange(len(y)) % SPLIT == 0 if len(y) >= LEAST else np.zeros(len(y), bool)
    distinct, times = np.unique(np.concatenate([np.unique(n) for n in names]), return_counts=True)
    model = Model(distinct[times >= (3 if len(y) >= LEAST else 1)], None, None, None, None, 0.0, frequent_words(), {})
    table, train = model.lookup(), np.flatnonzero(~held)
    model.vectors, model.filters, model.biases, model.weights, model.bias = _train([table[names[i]] for i in train], y[train], len(model.keys), _weights((y == 0).sum(), (y == 1).sum()))
    check = np.flatnonzero(held) if held.any() else train
    found = _calibration(model, [names[i] for i in check], y[check], table)
    model.thresholds = _thresholds([(*f, 1) for f in found], prior)
    return model


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """All labelled texts of the learning folds (doc_id, toxic, text), written once, and the share of label 1.

    A document labelled twice differently takes part as toxic; of texts that share an id the least, so that reruns agree.
    Texts without a word teach nothing.
    """
    per = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    learn = per.where(id_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    given = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(SOME_WORD) & (id_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    text = given.join(learn, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    total = sum(counts.values())
    return staged(text, "toxic-texts"), counts.get(1, 0) / total if total else 0.0


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int], float]:
    """For trials with ``fit`` in one process: of each class the labelled texts with the smallest hash, up to the bounds above, labels, share of label 1.

    The query does not use it; ``fitted`` learns from all labelled texts.
    """
    text, prior = labelled(docs, labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [text.where(F.col("toxic") == c).orderBy(*order).limit(PER_CLASS) for c in (1, 0)]
    running = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(*order))
    rows = chosen[0].unionByName(chosen[1]).withColumn("chars", running).where(F.col("chars") <= CLASS_CHARS).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.toxic for r in rows], prior


SHARD = "shard INT, words BINARY, counts BINARY, toxic BINARY, held BINARY"


def _shard(group: pa.Table) -> pa.Table:
    """One row for the texts of a shard, by id: names of their words, and per text how many words, its class, whether it calibrates."""
    group = group.sort_by("doc_id")
    words, counts = [], []
    for text in group.column("text").chunks:
        for _, found, first in hashed_words(text):
            words.append(found.tobytes())
            counts.append(np.diff(first).astype(np.int64).tobytes())
    as_bytes = lambda c: group.column(c).to_numpy().astype(np.int8).tobytes()
    row = [pa.compress(b"".join(words), "zstd", asbytes=True), b"".join(counts), as_bytes("toxic"), as_bytes("held")]
    return pa.table([group.column("shard").slice(0, 1), *[pa.array([x], pa.binary()) for x in row]], names=["shard", "words", "counts", "toxic", "held"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Per shard: number, names of each text, classes, which texts calibrate."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts, toxic, held = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.int64), (3, np.int8), (4, np.int8)))
            words = np.frombuffer(pa.decompress(batch.column(1)[i].as_buffer(), int(counts.sum()) * 8, "zstd"), np.int32)
            yield batch.column(0)[i].as_py(), np.split(words.reshape(-1, 2), np.cumsum(counts)[:-1]), toxic.astype(np.int64), held > 0


def _times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a shard each name stands."""
    for _, names, _, _ in _unpacked(batches):
        times = np.zeros(1 << HASH_BITS, np.int64)
        for n in names:
            times[np.unique(n)] += 1
        found = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(times[found])], names=["name", "times"])


def _cells(parameters: list[np.ndarray]) -> np.ndarray:
    """All parameters as rows of as many numbers as a vector has: the vectors, then the others one after the other."""
    others = np.concatenate([x.reshape(-1) for x in parameters[1:]])
    return np.concatenate([parameters[0], np.r_[others, np.zeros(-len(others) % DIMENSIONS, np.float32)].reshape(-1, DIMENSIONS)])


def _filled(parameters: list[np.ndarray], cells: np.ndarray) -> None:
    """The inverse of ``_cells``, in place."""
    words = len(parameters[0])
    parameters[0][:] = cells[:words]
    others, at = cells[words:].reshape(-1), 0
    for x in parameters[1:]:
        x.reshape(-1)[:] = others[at : at + x.size]
        at += x.size


CHANGES = [f"{kind}{i}" for kind in ("moved", "squares") for i in range(DIMENSIONS)]


def _changes(shared, number: int, weight: np.ndarray):
    """Each shard trains for one round from the same parameters; what it changed, as whole grains."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *common = shared.value
        table = Model(keys, None, None, None, None, 0.0, {}, {}).lookup()
        before = [_cells(x) for x in common]
        for shard, names, toxic, held in _unpacked(batches):
            own = [[x.copy() for x in some] for some in common]
            train = np.flatnonzero(~held)
            if not len(train):
                continue
            _round(*own, [table[names[t]] for t in train], toxic[train], weight, np.random.default_rng([7, number, shard]))
            moved, squares = (_cells(x).astype(np.float64) - b for x, b in zip(own, before))
            grains = np.rint(np.concatenate([moved, squares], axis=1) / GRAIN).astype(np.int64)
            at = np.flatnonzero(grains.any(axis=1))
            grains = grains[at]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(c) for c in grains.T.copy()]], names=["cell", *CHANGES])

    return changes


def _bins(shared, split: bool):
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        table = model.lookup()
        for _, names, toxic, held in _unpacked(batches):
            check = np.flatnonzero(held) if split else np.arange(len(names))
            if len(check):
                langs, at, classes = zip(*_calibration(model, [names[t] for t in check], toxic[check], table))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(at, pa.int64()), pa.array(classes, pa.int64())], names=["lang", "bin", "toxic"])

    return bins


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, float]:
    """The model of all labelled texts of the learning folds, and the share of label 1; no model if one of the classes has too few texts.

    One text in five, by a hash of its id, calibrates the thresholds; all others train. In each round every shard makes one
    pass from the same parameters, and each parameter moves by the mean of the shards that moved it. Texts are dealt to shards
    by a hash of the id, so the number of texts decides how many tasks work, and no partitioning shows in the model. The driver
    holds one model, whose size the names bound.
    """
    spark = docs.sparkSession
    text, prior = labelled(docs, labels)
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(SPLIT)) == 0
    sizes = text.groupBy("toxic", held.alias("held")).agg(F.count("*").alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars")).collect()
    n = [sum(r.n for r in sizes if r.toxic == c) for c in (0, 1)]
    if min(n) < 2:
        return None, prior
    texts = sum(n)
    # Both classes have to stand on either side.
    split = texts >= LEAST and len(sizes) == 4
    count = max(-(-texts // SHARD_DOCS), -(-sum(r.chars for r in sizes) // SHARD_CHARS))
    dealt = text.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("shard"), F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", (held & F.lit(split)).alias("held"), "text")
    shards = staged(dealt.groupBy("shard").applyInArrow(_shard, SHARD), "toxic-shards")
    times = shards.mapInArrow(_times, "name INT, times BIGINT").groupBy("name").agg(F.sum("times").alias("times"))
    keys = np.sort(times.where(F.col("times") >= (3 if texts >= LEAST else 1)).select("name").toArrow().column(0).to_numpy())
    parameters, seen = _start(len(keys), np.random.default_rng(7))
    sums = [F.count("*").alias("shards"), *[F.sum(c).alias(c) for c in CHANGES]]
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast((keys, parameters, seen))
        changed = shards.mapInArrow(_changes(shared, number, _weights(*n)), ", ".join(["cell INT", *[f"{c} BIGINT" for c in CHANGES]]))
        found = changed.groupBy("cell").agg(*sums).toArrow()
        at, by = found.column("cell").to_numpy(), found.column("shards").to_numpy() / GRAIN
        for some, kind in ((parameters, "moved"), (seen, "squares")):
            cells = _cells(some)
            for i in range(DIMENSIONS):
                cells[at, i] += found.column(f"{kind}{i}").to_numpy() / by
            _filled(some, cells)
        shared.destroy()
    vectors, filters, biases, weights, bias = _parts(parameters)
    model = Model(keys, vectors, filters, biases, weights, float(bias[0]), frequent_words(), {})
    shared = spark.sparkContext.broadcast(vars(model))
    found = shards.mapInArrow(_bins(shared, split), "lang STRING, bin BIGINT, toxic BIGINT").groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n")).collect()
    shared.destroy()
    model.thresholds = _thresholds([tuple(r) for r in found], prior)
    return model, prior


def _score(shared, prior: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value) if shared.value else None
        table = model.lookup() if model else None
        for batch in batches:
            scores = []
            if model is None:
                scores = [min(prior, 1.0)] * batch.num_rows
            else:
                for _, names, first in hashed_words(batch.column(2)):
                    logits, langs = _logits(model, names, first, table), _guess(model, names, first)
                    cut = np.array([model.thresholds.get(lang, model.thresholds[""]) for lang in langs])
                    scores += np.where(np.diff(first) > 0, _sigmoid(logits - cut), min(prior, 1.0)).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return score


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted.

    A score depends on the text alone: its words, and the language guessed from them, whose threshold
    moves the score so that 0.5 is the calibrated cut. Texts without words, null ones too, score the share of
    label 1, as does each row if one class has no labelled texts. An empty table gives no rows.
    """
    model, prior = fitted(docs, labels)
    # Plain arrays; its size is bounded by the names.
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    held_out = id_fold(F.col("doc_id"), FOLDS) == HELD_OUT
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string"))
    scored = plain.mapInArrow(_score(shared, prior), "doc_id BIGINT, held_out BOOLEAN, score DOUBLE")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scores(docs, table(spark, folder, "labels"))
