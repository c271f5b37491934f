"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of those of three hashes: of the word, of its first four and of its
first five bytes (words are letters and digits, A-Z lowered). Filters of several widths run over
all words of the whole text; each filter's largest output goes through a rectifier into a logistic
unit. Everything is trained in numpy, by gradient steps of one text each, on a bounded sample of
labelled rows: ``POSITIVE`` and ``NEGATIVE`` rows whose ids hash lowest. Hashes that fewer than
``MIN_TEXTS`` texts of the sample hold have no embedding, and at most ``FEATURES`` have one, which
bounds the model that goes to the tasks.

A fifth of the sample is kept from training. On it, one threshold is chosen per language, the one
with the best F1 at the labels' own rate, and scores are moved so that every threshold becomes
0.5. The language is told by common words of the text itself and by nothing else.

Defined results: a null text is an empty one and scores as a text without any known word; equal
texts score alike; several labels of one id count as toxic if one of them is; without a toxic and a
clean labelled row every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common_words import COMMON_WORDS
from lonja.llm.text import ALPHANUMERIC, ASCII_LOWER, bounded, slices, utf8, word_bounds, word_hashes

POSITIVE, NEGATIVE = 1500, 3000
MIN_TEXTS = 3
FEATURES = 1 << 17
WIDTHS = (1, 2, 3)
DIMENSIONS, FILTERS = 8, 8
EPOCHS = 8
RATE = 0.03
#: What embeddings shrink to after 100 texts, so that words of few texts do not stay.
DECAY = 0.95
SLICE_BYTES = 2 << 20

_LANGUAGES = tuple(sorted(COMMON_WORDS))


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array(words, pa.large_string()))
    return np.sort(word_hashes(data, offsets[:-1], offsets[1:]))


_COMMON = [_hashes(COMMON_WORDS[name].split()) for name in _LANGUAGES]


def _found(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values are in an ordered array, and whether they are there."""
    if not len(ordered):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


class _Words:
    """The words of texts: distinct words with their hashes, and which word stands where."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = ASCII_LOWER[data]
        starts, ends = word_bounds(data, offsets, ALPHANUMERIC)
        hashes = word_hashes(data, starts, ends)
        self.hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        heads = [word_hashes(data, starts, np.minimum(ends, starts + n)) + np.uint64(n) for n in (4, 5)]
        self.features = np.stack([self.hashes, *heads], axis=1)
        self.bounds = np.searchsorted(word_bounds(data, offsets, ALPHANUMERIC)[0], offsets)
        self.which = which

    def padded(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with blanks (number len(hashes)) after texts of fewer words than a filter."""
        counts = np.diff(self.bounds)
        held = np.maximum(counts, max(WIDTHS))
        bounds = np.concatenate([[0], np.cumsum(held)])
        out = np.full(bounds[-1], len(self.hashes))
        out[np.arange(len(self.which)) + np.repeat(bounds[:-1] - self.bounds[:-1], counts)] = self.which
        return out, bounds

    def languages(self) -> np.ndarray:
        """The number of each text's language; one more than there are when no word tells it."""
        counts = []
        for common in _COMMON:
            flags = np.append(_found(self.hashes, common)[1][self.which], False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(flags)])
            counts.append(sums[self.bounds[1:]] - sums[self.bounds[:-1]])
        counts = np.stack(counts)
        return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(_LANGUAGES))


@dataclass
class ToxicityModel:
    features: np.ndarray
    embeddings: np.ndarray  # the last row, of zeros, is for unknown features
    filters: dict[int, np.ndarray]  # width -> (width, dimensions, filters)
    shifts: np.ndarray  # one for each filter
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(_LANGUAGES) + 1))

    def rows(self, features: np.ndarray) -> np.ndarray:
        at, known = _found(features.ravel(), self.features)
        return np.where(known, at, len(self.features)).reshape(features.shape)

    def logits(self, words: _Words) -> np.ndarray:
        vectors = self.embeddings[self.rows(words.features)].sum(axis=1)
        vectors = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
        which, bounds = words.padded()
        peaks = []
        for width, weights in self.filters.items():
            total = len(which) - width + 1
            out = (vectors @ weights[0])[which[:total]]
            for place in range(1, width):
                out += (vectors @ weights[place])[which[place : place + total]]
            edges = np.stack([bounds[:-1], bounds[1:] - width + 1], axis=1).ravel()
            peaks.append(np.maximum.reduceat(np.append(out, out[-1:], axis=0), edges, axis=0)[::2])
        peaks = np.maximum(np.concatenate(peaks, axis=1) + self.shifts, 0)
        return peaks @ self.weights + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        words = _Words(data, offsets)
        moved = self.logits(words).astype(np.float64) - self.thresholds[words.languages()]
        return 1 / (1 + np.exp(-np.clip(moved, -500, 500)))


def training_sample(
    docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE
) -> tuple[list[tuple[str, int]], float]:
    """Texts with labels, and the share of toxic ones among all labelled rows.

    Only ids and labels are ordered; texts are fetched for the chosen ids alone, whose number is
    bounded by the two parameters.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("share")).collect()[0]["share"]
    chosen = []
    for label, rows in ((1, positive), (0, negative)):
        found = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen += [(row["doc_id"], label) for row in found.collect()]
    if not chosen:
        return [], 0.0
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id bigint, toxic int"))
    texts = docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r["text"] or "", r["toxic"]) for r in sorted(texts, key=lambda r: (r["doc_id"], r["text"] or ""))], share


def train(sample: list[tuple[str, int]], share: float, seed: int = 5) -> ToxicityModel | None:
    """Fit the classifier and its thresholds; None unless both labels are there."""
    target = np.array([label for _, label in sample])
    if len(set(target.tolist())) < 2:
        return None
    texts, languages = _sample_features([text for text, _ in sample])
    random = np.random.default_rng(seed)
    order = random.permutation(len(sample))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    every, counts = np.unique(np.concatenate([np.unique(texts[n]) for n in used]), return_counts=True)
    kept = np.sort(every[np.argsort(-counts, kind="stable")][: min(FEATURES, int((counts >= MIN_TEXTS).sum()))])
    model = ToxicityModel(
        kept,
        random.normal(0, 0.1, (len(kept) + 1, DIMENSIONS)).astype(np.float32),
        {w: random.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        np.abs(random.normal(0, 0.5, len(WIDTHS) * FILTERS)).astype(np.float32),
        -1.0,
    )
    model.embeddings[-1] = 0
    rows = [model.rows(t) for t in texts]
    weight = {1: len(used) / max(2 * target[used].sum(), 1), 0: len(used) / max(2 * (1 - target[used]).sum(), 1)}
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for step, n in enumerate(random.permutation(used)):
            if step % 100 == 0:
                model.embeddings *= DECAY
            words = rows[n][random.random(len(rows[n])) < 0.7]
            _step(model, words, int(target[n]), rate * weight[int(target[n])])
    logits = np.array([_forward(model, rows[n])[0] for n in held])
    model.thresholds = _thresholds(logits, target[held], languages[held], share)
    return model


def _sample_features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The three features of every word of each text, and the texts' languages."""
    out, languages = [], []
    for first in range(0, len(texts), 64):
        words = _Words(*utf8(pa.array(texts[first : first + 64], pa.large_string())))
        features = words.features[words.which]
        out += [features[a:b] for a, b in zip(words.bounds, words.bounds[1:])]
        languages.append(words.languages())
    return out, np.concatenate(languages)


def _forward(model: ToxicityModel, rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Logit, word vectors, the rectified peaks and where they are."""
    blanks = max(WIDTHS) - len(rows)
    if blanks > 0:
        rows = np.concatenate([rows, np.full((blanks, 3), len(model.features))])
    vectors = model.embeddings[rows].sum(axis=1)
    peaks, places = [], []
    for width, weights in model.filters.items():
        total = len(vectors) - width + 1
        out = sum(vectors[j : j + total] @ weights[j] for j in range(width))
        at = out.argmax(axis=0)
        places.append(at)
        peaks.append(out[at, np.arange(FILTERS)])
    peaks = np.maximum(np.concatenate(peaks) + model.shifts, 0)
    return float(peaks @ model.weights + model.bias), vectors, peaks, np.concatenate(places)


def _step(model: ToxicityModel, rows: np.ndarray, label: int, rate: float) -> None:
    """One gradient step on one text; only the words under the peaks move."""
    logit, vectors, peaks, places = _forward(model, rows)
    error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label
    step = np.float32(rate * error)
    back = step * model.weights * (peaks > 0)
    model.weights -= step * peaks
    model.bias -= float(step)
    model.shifts -= back
    for number, (width, weights) in enumerate(model.filters.items()):
        columns = slice(number * FILTERS, (number + 1) * FILTERS)
        at, pull = places[columns], back[columns]
        for j in range(width):
            inside = at + j < len(rows)
            moved = (weights[j] * pull).T
            weights[j] -= (vectors[at + j] * pull[:, None]).T
            np.subtract.at(
                model.embeddings, rows[(at + j)[inside]].ravel(), np.repeat(moved[inside], 3, axis=0)
            )
    model.embeddings[-1] = 0


def _thresholds(logits: np.ndarray, target: np.ndarray, languages: np.ndarray, share: float) -> np.ndarray:
    """The threshold of each language, or that of all rows where a language has too few."""

    def best(rows: np.ndarray) -> float:
        order = rows[np.argsort(-logits[rows], kind="stable")]
        toxic = target[order] == 1
        clean_weight = max(1 - share, 1e-6) / max(share, 1e-6) * toxic.sum() / max((~toxic).sum(), 1)
        hits = np.cumsum(toxic)
        f1 = 2 * hits / (hits + np.cumsum(~toxic) * clean_weight + toxic.sum())
        last = int(np.argmax(f1))
        below = logits[order[last + 1]] if last + 1 < len(order) else logits[order[last]] - 1
        return float((logits[order[last]] + below) / 2)

    whole = np.arange(len(target))
    if len(set(target.tolist())) < 2:
        return np.zeros(len(_LANGUAGES) + 1)
    out = np.full(len(_LANGUAGES) + 1, best(whole))
    for language in range(len(out)):
        rows = whole[languages == language]
        if (target[rows] == 1).sum() >= 5 and (target[rows] == 0).sum() >= 5:
            out[language] = best(rows)
    return out


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> Column:
    """The score of each text, from 0 to 1; 0.5 is the threshold of its language."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        model = held.value
        if model is None:
            return pa.array(np.zeros(len(texts)))
        parts = [model.scores(*utf8(part)) for part in slices(texts, SLICE_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(F.col(text).cast("string"))


def _text_batches(rows) -> "Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]":
    """Features of every word of each text, languages and labels, 64 rows at a time."""
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == 64:
            yield _chunk_features(chunk)
            chunk = []
    if chunk:
        yield _chunk_features(chunk)


def _chunk_features(chunk: list) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    texts, languages = _sample_features([row["text"] or "" for row in chunk])
    return texts, languages, np.array([row["toxic"] for row in chunk])


def fit(docs: DataFrame, labels: DataFrame, seed: int = 5) -> ToxicityModel | None:
    """The classifier fitted on every labelled row, without a sample.

    Spark counts in how many texts each feature stands; every epoch runs gradient steps over each
    partition's rows from the same model, and the partitions' models are averaged by their numbers of
    rows. A fifth of the rows, by the hash of their ids, is kept from training for the thresholds, which
    come from exact counts of toxic and clean rows above every logit. Only the models, one for each
    core, and counts of bounded size reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).persist()
    try:
        return _fit(rows, known, seed)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, known: DataFrame, seed: int) -> ToxicityModel | None:
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("share")).collect()[0]["share"]
    used = rows.where(~F.col("held")).select("text", "toxic")
    counted = {r["toxic"]: r["count"] for r in used.groupBy("toxic").count().collect()}
    if len(counted) < 2:
        return None
    total = sum(counted.values())
    weight = {label: total / max(2 * counted.get(label, 0), 1) for label in (0, 1)}

    def features(batches):
        for batch in bounded(batches, limit=SLICE_BYTES):
            for texts, _, _ in _text_batches(batch.to_pylist()):
                found = np.concatenate([np.unique(t) for t in texts] + [np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["feature"])

    vocabulary = used.mapInArrow(features, "feature long").groupBy("feature").count()
    vocabulary = vocabulary.where(F.col("count") >= MIN_TEXTS).orderBy(F.desc("count"), "feature").limit(FEATURES)
    kept = np.sort(np.array([r["feature"] for r in vocabulary.collect()], np.int64).view(np.uint64))
    random = np.random.default_rng(seed)
    model = ToxicityModel(
        kept,
        random.normal(0, 0.1, (len(kept) + 1, DIMENSIONS)).astype(np.float32),
        {w: random.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        np.abs(random.normal(0, 0.5, len(WIDTHS) * FILTERS)).astype(np.float32),
        -1.0,
    )
    model.embeddings[-1] = 0
    context = rows.sparkSession.sparkContext
    # As many partitions as cores: each sends one model to the driver, and nothing is written.
    training = used.coalesce(context.defaultParallelism).rdd
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        held = context.broadcast(model)

        def steps(number, partition, held=held, rate=rate, epoch=epoch):
            import copy

            own = copy.deepcopy(held.value)
            draw = np.random.default_rng((seed, epoch, number))
            step = 0
            for texts, _, target in _text_batches(partition):
                for n in draw.permutation(len(texts)):
                    if step % 100 == 0:
                        own.embeddings *= DECAY
                    step += 1
                    words = own.rows(texts[n])
                    words = words[draw.random(len(words)) < 0.7]
                    _step(own, words, int(target[n]), rate * weight[int(target[n])])
            if step:
                yield step, [own.embeddings * step, *(f * step for f in own.filters.values()), own.shifts * step, own.weights * step, own.bias * step]

        def added(a, b):
            return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]

        count, sums = training.mapPartitionsWithIndex(steps).reduce(added)
        held.unpersist()
        model.embeddings = (sums[0] / count).astype(np.float32)
        for n, width in enumerate(WIDTHS):
            model.filters[width] = (sums[1 + n] / count).astype(np.float32)
        model.shifts = (sums[-3] / count).astype(np.float32)
        model.weights = (sums[-2] / count).astype(np.float32)
        model.bias = float(sums[-1] / count)
        model.embeddings[-1] = 0
    model.thresholds = _spread_thresholds(rows.where(F.col("held")).select("text", "toxic"), model, share)
    return model


def _spread_thresholds(held: DataFrame, model: ToxicityModel, share: float) -> np.ndarray:
    """The threshold of each language as ``_thresholds`` chooses it, from counts above each logit."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def logits(batches):
        for batch in bounded(batches, limit=SLICE_BYTES):
            if not batch.num_rows:
                continue
            words = _Words(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shared.value.logits(words).astype(np.float64)), pa.array(words.languages()), batch.column("toxic")],
                ["logit", "language", "toxic"],
            )

    found = held.mapInArrow(logits, "logit double, language long, toxic int")
    every = found.withColumn("language", F.lit(-1)).unionByName(found)
    counts = every.groupBy("language", "logit").agg(
        F.sum(F.col("toxic")).alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")
    )
    totals = counts.groupBy("language").agg(F.sum("toxic").alias("all_toxic"), F.sum("clean").alias("all_clean"))
    down = Window.partitionBy("language").orderBy(F.desc("logit"))
    clean_weight = F.lit(max(1 - share, 1e-6) / max(share, 1e-6)) * F.col("all_toxic") / F.greatest(F.col("all_clean"), F.lit(1))
    hits = F.sum("toxic").over(down.rowsBetween(Window.unboundedPreceding, 0))
    misses = F.sum("clean").over(down.rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.lead("logit").over(down), F.col("logit") - 1)
    scored = counts.join(totals, "language").select(
        "language", "all_toxic", "all_clean",
        F.coalesce(F.try_divide(2 * hits, hits + misses * clean_weight + F.col("all_toxic")), F.lit(0.0)).alias("f1"),
        ((F.col("logit") + below) / 2).alias("threshold"), "logit",
    )
    best = scored.groupBy("language", "all_toxic", "all_clean").agg(
        F.max_by("threshold", F.struct("f1", "logit")).alias("threshold")
    ).collect()
    shared.unpersist()
    found = {r["language"]: r for r in best}
    if -1 not in found or not found[-1]["all_toxic"] or not found[-1]["all_clean"]:
        return np.zeros(len(_LANGUAGES) + 1)
    out = np.full(len(_LANGUAGES) + 1, found[-1]["threshold"])
    for language, r in found.items():
        if language >= 0 and r["all_toxic"] >= 5 and r["all_clean"] >= 5:
            out[language] = r["threshold"]
    return out
