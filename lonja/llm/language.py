"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are the runs of three and four bytes of its words, with the edges of words as
blanks; digits and ASCII punctuation count as blanks. Each subword is hashed to an embedding; the
mean of all embeddings of the whole text goes through a linear softmax. Embeddings and softmax are
trained together by stochastic gradient descent on a bounded sample of labelled rows: at most
``ROWS_PER_LANGUAGE`` of each language and ``SAMPLE_ROWS`` of all, those whose hashes are lowest. A
fifth of the sample is kept from training and calibrates the probabilities (one temperature) and the
rejection.

A softmax is sure of texts in no learned language too, so a text is rejected on either of two grounds:

* its probability is so low that the calibration rows below it were more often wrong than right;
* its subwords are not those of any learned language. ``familiarity`` is the mean, over the subwords,
  of the logarithm of their share in the sample (all languages alike), counted in deviations that
  texts of its length have. What a text in an unknown language gets is learned by leaving each
  language out in turn. The limit is half way from the lowest known rows (all but
  ``REJECTED_KNOWN`` are above) to the middle of those left out, at least one deviation beneath the
  known ones, and just that with a single language.

Being linear, the trained model is folded into one table of a score per bucket and language where
that is narrower than the embeddings; its size is fixed by ``BUCKETS`` and ``DIMENSIONS``, and that
table and the softmax are what goes to the tasks.

Defined results: a null text or one without any letter is ``und`` with score 0, and rejected; a
letter too short for a subword gets the languages' shares in the sample; languages are those of the
labelled rows, and without any such row every text is ``und``. Each row is judged by its text
alone, so equal texts agree, whatever their other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.text import ASCII_LOWER, slices, utf8

ROWS_PER_LANGUAGE = 500
SAMPLE_ROWS = 250_000
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
#: Small samples are gone through more often, up to so many steps.
STEPS = 3000
SLICE_BYTES = 1 << 20
#: The share of calibration rows that may be rejected as unfamiliar.
REJECTED_KNOWN = 0.002
#: Calibration rows are also judged by so many of their first subwords, for texts as short.
SHORT = (8, 24, 80)
UNDEFINED = "und"

_BLANK = 0x20
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_FOLDED = np.where(_LETTERS | (np.arange(256) >= 0x80), ASCII_LOWER, _BLANK).astype(np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all subwords, and where each text's begin (one more entry: the end)."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(len(data) + len(offsets) + 4, _BLANK, dtype=np.uint32)
    folded = _FOLDED[data]
    # the accented capitals of Latin-1: their second byte is 32 less than that of the small letters
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    folded[1:][capital] += 0x20
    padded[np.arange(len(data)) + text + 1] = folded
    edges = offsets + np.arange(len(offsets))
    word = padded != _BLANK
    three = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    places, buckets = [], []
    for length, valid, value in (
        (3, word[1:-1], three),
        (4, word[1:-2] & word[2:-1], three[:-1] | padded[3:] << 24),
    ):
        at = np.flatnonzero(valid)
        places.append(at)
        buckets.append((value[at] * np.uint32(2654435761) ^ np.uint32(length * 0x9E3779B1 & 0xFFFFFFFF)) >> shift)
    place = np.concatenate(places)
    order = np.argsort(place, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(place[order], edges)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_LETTERS[data])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    for row in np.flatnonzero(~found & (high[offsets[1:]] > high[offsets[:-1]])):
        text = data[offsets[row] : offsets[row + 1]].tobytes().decode("utf-8", "replace")
        found[row] = any(c.isalpha() for c in text)
    return found


@dataclass(frozen=True)
class Familiarity:
    """How usual a text's subwords are in the learned languages."""

    shares: np.ndarray  # the logarithm of each bucket's share
    mean: float
    within: float  # variance of a subword, and between texts
    between: float
    limit: float

    def deviations(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        known = np.maximum(counts, 1)
        far = (sums / known - self.mean) / np.sqrt(self.within / known + self.between)
        return np.where(counts > 0, far, np.inf)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # for each bucket what is averaged
    weights: np.ndarray  # a score per column of the table and language
    bias: np.ndarray
    temperature: float
    threshold: float
    familiarity: Familiarity | None

    def _judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities, the sums of the subwords' logarithms of shares, and the subwords' number."""
        buckets, bounds = subwords(data, offsets)
        counts = np.diff(bounds)
        full = np.flatnonzero(counts)
        means = np.zeros((len(counts), self.table.shape[1]))
        shares = np.zeros(len(counts))
        if len(full):
            for column in range(self.table.shape[1]):
                sums = np.add.reduceat(self.table[:, column][buckets], bounds[full])
                means[full, column] = sums / counts[full]
            if self.familiarity is not None:
                shares[full] = np.add.reduceat(self.familiarity.shares[buckets], bounds[full])
        logits = np.where(counts[:, None] > 0, means @ self.weights, 0.0) + self.bias
        return _softmax(logits / self.temperature), shares, counts

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self._judged(data, offsets)[0]

    def judged(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities, and whether each text is accepted."""
        chances, shares, counts = self._judged(data, offsets)
        accepted = chances.max(axis=1) > self.threshold
        if self.familiarity is not None:
            accepted &= self.familiarity.deviations(shares, counts) >= self.familiarity.limit
        return chances, accepted


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def training_sample(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``rows`` (text, language) of each language, in the order of their hashes.

    Fewer of each where ``SAMPLE_ROWS`` are not enough for all languages. The hash is cut so that
    about twice the wanted rows are ranked; only wanted ones reach the driver, and the number of rows
    of each language.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return []
    rows = max(min(rows, SAMPLE_ROWS // len(counts)), 2)
    cuts = [(r["lang"], int((1 << 40) * min(1.0, 2 * rows / r["count"]))) for r in counts]
    cuts = spark.createDataFrame(cuts, f"lang {known.schema['lang'].dataType.simpleString()}, cut long")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("place")
    taken = known.select("doc_id", "lang", "text", place).join(F.broadcast(cuts), "lang").where("place <= cut")
    # a row that is there many times counts once, and the cut leaves few rows to rank
    order = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    ranked = taken.dropDuplicates(["lang", "doc_id", "text"]).withColumn("rank", F.row_number().over(order))
    chosen = ranked.where(F.col("rank") <= rows).select("lang", "rank", "text").collect()
    return [(r["text"], r["lang"]) for r in sorted(chosen, key=lambda r: (r["lang"], r["rank"]))]


def train(sample: list[tuple[str, str]], seed: int = 7) -> LanguageModel | None:
    """Fit the embeddings, the softmax, the temperature and the rejection; None without rows."""
    if not sample:
        return None
    languages = tuple(sorted({lang for _, lang in sample}))
    target = np.array([languages.index(lang) for _, lang in sample])
    rows = []
    for part in slices(pa.array([text for text, _ in sample], pa.large_string()), SLICE_BYTES):
        buckets, bounds = subwords(*utf8(part))
        rows += [np.unique(buckets[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    embeddings = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = random.normal(0, 0.1, (DIMENSIONS, len(languages)))
    shares = np.bincount(target, minlength=len(languages)) + 1.0
    bias = np.log(shares / shares.sum())
    epochs = max(EPOCHS, min(60, STEPS // max(len(used), 1)))
    for epoch in range(epochs):
        rate = 0.5 * (1 - epoch / epochs)
        for row in random.permutation(used):
            features, counts = rows[row]
            if not len(features):
                continue
            share = counts / counts.sum()
            mean = share @ embeddings[features]
            error = _softmax((mean @ weights + bias)[None])[0]
            error[target[row]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            embeddings[features] -= rate * len(features) ** 0.5 * share[:, None] * back
    if len(languages) <= DIMENSIONS:
        embeddings, weights = embeddings @ weights, np.eye(len(languages))
    plain = LanguageModel(languages, embeddings, weights, bias, 1.0, 0.0, None)
    if not len(held):
        return plain
    logits = np.log(np.maximum(_held_probabilities(plain, sample, held), 1e-300))
    temperature = min(
        np.geomspace(0.25, 4, 33),
        key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), target[held]], 1e-300)).sum(),
    )
    calibrated = _softmax(logits / temperature)
    score, right = calibrated.max(axis=1), calibrated.argmax(axis=1) == target[held]
    rising = np.argsort(score)
    wrong_below = np.cumsum(~right[rising]) * 2 > np.arange(1, len(rising) + 1)
    last = np.flatnonzero(wrong_below)
    threshold = float(score[rising][last[-1]]) if len(last) else 0.0
    familiarity = _familiarity(rows, target, used, _in_order(sample, held), target[held])
    return LanguageModel(languages, embeddings, weights, bias, float(temperature), threshold, familiarity)


def _in_order(sample: list[tuple[str, str]], held: np.ndarray) -> list[np.ndarray]:
    """The subwords of the calibration rows."""
    found = []
    for part in slices(pa.array([sample[n][0] for n in held], pa.large_string()), SLICE_BYTES):
        buckets, bounds = subwords(*utf8(part))
        found += [buckets[a:b] for a, b in zip(bounds, bounds[1:])]
    return found


def _familiarity(rows: list, target: np.ndarray, used: np.ndarray, held: list[np.ndarray], own: np.ndarray) -> Familiarity | None:
    """Shares of the buckets in the training rows, and the limit from the calibration rows."""
    languages = int(target.max()) + 1
    total = np.zeros(BUCKETS)
    single = {}
    for language in range(languages):
        counts = np.zeros(BUCKETS)
        for row in used[target[used] == language]:
            features, times = rows[row]
            counts[features] += times
        share = counts / max(counts.sum(), 1)
        total += share
        at = np.flatnonzero(share)
        single[language] = at, share[at]

    def logarithms(shares: np.ndarray) -> np.ndarray:
        shares = shares / max(shares.sum(), 1e-9)
        return np.log((shares + 0.05 / BUCKETS) / 1.05)

    def judged(buckets_of: list[np.ndarray], shares: np.ndarray, lengths: tuple) -> tuple[np.ndarray, np.ndarray]:
        parts = [b[:n] for b in buckets_of for n in lengths if len(b) and (n is None or n < len(b))]
        return np.array([shares[p].sum() for p in parts]), np.array([len(p) for p in parts])

    shares = logarithms(total)
    sums, counts = judged(held, shares, (None, *SHORT))
    if not len(sums):
        return None
    means = sums / counts
    mean = float(np.average(means, weights=np.minimum(counts, 100)))
    square = (means - mean) ** 2
    # the variance of a mean of n is within / n + between: fitted by least squares of shares of it
    inverse = np.stack([1 / counts, np.ones(len(counts))], axis=1)
    scale = 1 / (inverse[:, 0] + 1e-3)
    within, between = np.linalg.lstsq(inverse * scale[:, None], square * scale, rcond=None)[0]
    usual = Familiarity(shares, mean, max(float(within), 1e-3), max(float(between), 1e-3), -np.inf)
    known = usual.deviations(sums, counts)
    low = float(np.quantile(known, REJECTED_KNOWN))
    foreign = []
    for language in range(languages if languages > 1 else 0):
        others = total.copy()
        at, share = single[language]
        others[at] -= share
        mine = [b for b, o in zip(held, own) if o == language]
        sums, counts = judged(mine, logarithms(np.maximum(others, 0)), (None,))
        foreign += usual.deviations(sums, counts).tolist()
    middle = float(np.median(foreign)) if foreign else low
    limit = min(low - 1.0, (low + middle) / 2)
    return Familiarity(usual.shares, usual.mean, usual.within, usual.between, limit)


def _held_probabilities(model: LanguageModel, sample: list[tuple[str, str]], held: np.ndarray) -> np.ndarray:
    texts = pa.array([sample[n][0] for n in held], pa.large_string())
    return np.concatenate([model.probabilities(*utf8(part)) for part in slices(texts, SLICE_BYTES)])


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> Column:
    """A struct of ``lang``, ``score`` (the probability of that language) and ``accepted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, accepted boolean")
    def run(texts: pa.Array) -> pa.Array:
        model = held.value
        lang, score, accepted = [], [], []
        for part in slices(texts, SLICE_BYTES):
            data, offsets = utf8(part)
            letters = has_letter(data, offsets)
            if model is None:
                letters[:] = False
                best, top, sure = np.zeros(len(part), int), np.zeros(len(part)), letters
            else:
                chances, sure = model.judged(data, offsets)
                best, top = chances.argmax(axis=1), chances.max(axis=1)
            lang += [model.languages[b] if ok else UNDEFINED for b, ok in zip(best, letters)]
            score.append(np.where(letters, np.clip(top, 0, 1), 0.0))
            accepted.append(letters & sure)
        joined = [np.concatenate(x) if x else np.zeros(0) for x in (score, accepted)]
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(joined[0], pa.float64()), pa.array(joined[1].astype(bool))],
            names=["lang", "score", "accepted"],
        )

    return run(F.col(text).cast("string"))
