"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or abstain on every text.  Expectation
maximisation estimates each labeller's confusion of the unseen classes; it runs
on the counts of vote patterns, of which there are at most 3 to the power of the
labellers, whatever the rows.  Two such models are fitted, for quality and for
toxicity; where there are annotations (table ``labels``) these hold the class of
their texts.  Their posteriors are the soft labels of one hashed linear scorer over
words and votes, which decides.

Fixed bounds: the lexicon is extended from at most ``max_labels`` annotated rows
and the scorer is fitted on about ``train_rows`` rows, both chosen by hash; vote
statistics and scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import hashing
from tidemark.llm.store import Scratch, small_batches

MAX_LABELS = 100_000
TRAIN_ROWS = 12_000
FEATURES = 1 << 18
KEEP = 0.5
TRUST = 0.999
PRECISION = 0.999
PRIOR = 0.1
STEM = 5
_STEM_SALT = np.uint64(0x5DEECE66D1CE4E5B)

# Insults that start the toxicity lexicon.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "clown", "disgusting", "imbecile", "vermin")

QUALITY = ("symbols", "shouting", "exclaiming", "few_words", "repeating", "listing", "empty")
SAFETY = ("insult", "insults", "insult_rate")


def _word_array(words) -> np.ndarray:
    return hashing.word_hashes(pa.array(list(words), pa.string()))[0]


@dataclass
class Text:
    """Bare words of a batch: lower-cased, ASCII punctuation counted as space; and their stems of STEM bytes."""

    word: np.ndarray
    stem: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> tuple[Text, np.ndarray, np.ndarray]:
        raw, at = hashing.buffers(column)
        low = hashing.lowered(raw)
        punctuation = ((low >= 33) & (low <= 47)) | ((low >= 58) & (low <= 64)) | ((low >= 91) & (low <= 96)) | ((low >= 123) & (low <= 126))
        low[punctuation] = 32
        starts, ends, first = hashing.words(low, at)
        stem = hashing.span_hashes(low, starts, np.minimum(ends, starts + STEM)) ^ _STEM_SALT
        return cls(hashing.span_hashes(low, starts, ends), stem, first), raw, at

    def units(self, i: int) -> np.ndarray:
        """Distinct words and stems of a text."""
        at = slice(self.first[i], self.first[i + 1])
        return np.unique(np.concatenate([self.word[at], self.stem[at]]))


def _share(low: float, high: float, x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """0 (bad) above high, 1 (good) below low, -1 between or where not known."""
    return np.where(~known, -1, np.where(x > high, 0, np.where(x < low, 1, -1))).astype(np.int8)


def votes(text: Text, raw: np.ndarray, at: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Votes of all heuristics (rows: texts), and each text's distinct words."""

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    n = np.diff(text.first)
    many = np.maximum(n, 1)
    upper = count((raw >= 65) & (raw <= 90))
    lower = count((raw >= 97) & (raw <= 122))
    symbols = count(np.isin(raw, np.frombuffer(b"*#$%&~^", np.uint8)))
    bangs, bars = count(raw == 33), count(raw == 124)
    hit = np.isin(text.word, lexicon) | np.isin(text.stem, lexicon)
    hits = np.add.reduceat(np.append(hit, False).astype(np.int64), text.first[:-1]) * (n > 0) if len(n) else np.empty(0, np.int64)
    distinct, fresh, kinds = [], np.ones(len(n)), np.zeros(len(n), np.int64)
    for i in range(len(n)):
        w = text.word[text.first[i] : text.first[i + 1]]
        distinct.append(np.unique(w))
        if len(w) >= 30:
            fresh[i] = len(hashing.shingles(w, 3)) / (len(w) - 2)
        if hits[i]:
            kinds[i] = len(np.unique(w[hit[text.first[i] : text.first[i + 1]]]))
    variety = np.array([len(d) for d in distinct]) / many
    some = n > 0
    columns = [
        _share(0.02, 0.3, symbols / many, some),
        _share(0.2, 0.4, upper / np.maximum(upper + lower, 1), upper + lower >= 20),
        _share(0.1, 0.3, bangs / many, some),
        _share(-0.55, -0.4, -variety, n >= 30),
        _share(0.1, 0.3, 1 - fresh, n >= 30),
        _share(0.02, 0.1, bars / many, some),
        np.where(some, -1, 0),
        np.where(hits > 0, 0, 1),
        np.where(kinds > 1, 0, np.where(hits == 0, 1, -1)),
        _share(1e-9, 0.003, hits / many, some),
    ]
    return np.stack(columns, axis=1).astype(np.int8).reshape(len(n), len(columns)), distinct


@dataclass
class LabelModel:
    """Prior of each class, and ``table[labeller, class, vote]`` (vote 0: bad, 1: good).

    Class 0 is good.  Bad texts come in kinds that seldom go together, so each
    labeller starts a bad class of its own; one bad class for all would call a
    text good that a single labeller finds bad.
    """

    prior: np.ndarray
    table: np.ndarray

    def classes(self, pattern: np.ndarray) -> np.ndarray:
        """Posterior of every class (columns) for each row of votes; -1 abstains."""
        log = np.tile(np.log(self.prior), (len(pattern), 1))
        for k in range(pattern.shape[1]):
            by_vote = np.log(self.table[k]).T
            log += np.where(pattern[:, [k]] < 0, 0.0, by_vote[np.maximum(pattern[:, k], 0)])
        log -= log.max(axis=1, keepdims=True, initial=-1e300)
        odds = np.exp(log)
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes."""
        return self.classes(pattern)[:, 0]

    def accuracy(self) -> np.ndarray:
        """Of each labeller: P(votes bad | bad) and P(votes good | good), where it votes."""
        bad = self.prior[1:] / self.prior[1:].sum()
        return np.stack([self.table[:, 1:, 0] @ bad, self.table[:, 0, 1]], axis=1)


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, known: np.ndarray | None = None, steps: int = 3000) -> LabelModel:
    """Fit labeller confusions to vote patterns with their counts.

    ``known`` has the annotated class of a pattern's texts (1 good, 0 bad, -1
    none); it holds with ``TRUST``.  A prior with ``PRIOR`` of the data's weight expects
    labellers to be right on good texts with ``PRECISION``: a kind of bad text
    that one labeller alone sees could otherwise as well be its errors.
    """
    known = np.full(len(pattern), -1) if known is None else known
    width = pattern.shape[1]
    bad = (pattern == 0).astype(float)
    none = bad.sum(axis=1) == 0
    weight = np.hstack([np.where(none, 0.95, 0.05)[:, None], np.where(none[:, None], 0.05 / width, 0.95 * bad / np.maximum(bad.sum(axis=1, keepdims=True), 1))])
    model = None
    for _ in range(steps):
        good = np.where(known < 0, weight[:, 0], np.where(known == 1, TRUST, 1 - TRUST))
        rest = weight[:, 1:] / np.maximum(weight[:, 1:].sum(axis=1, keepdims=True), 1e-300)
        mass = np.hstack([good[:, None], (1 - good[:, None]) * rest]) * count[:, None]
        table = np.empty((width, width + 1, 2))
        for k in range(width):
            for v in (0, 1):
                table[k, :, v] = mass[pattern[:, k] == v].sum(axis=0) + 0.1
                table[k, 0, v] += PRIOR * count.sum() * (PRECISION if v else 1 - PRECISION)
        table /= table.sum(axis=2, keepdims=True)
        prior = mass.sum(axis=0) + 0.1
        model = LabelModel(prior / prior.sum(), table)
        new = model.classes(pattern)
        if np.abs(new - weight).max(initial=0) < 1e-9:
            break
        weight = new
    return model


def _vote_rows(lexicon: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                text, raw, at = Text.of(batch.column("text"))
                found, _ = votes(text, raw, at, lexicon)
                code = (found.astype(np.int64) + 1) @ 3 ** np.arange(found.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(code)], names=["doc_id", "code"])

    return run


def _features(found: np.ndarray, distinct: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices, values and row starts: distinct words of weight 1/sqrt(n), and one slot a vote."""
    base = FEATURES - 3 * found.shape[1]
    index, value, start = [], [], [0]
    for row, words in zip(found, distinct, strict=True):
        index += [(words % np.uint64(base)).astype(np.int64), base + 3 * np.arange(len(row)) + row + 1]
        value += [np.full(len(words), 1 / np.sqrt(max(len(words), 1))), np.ones(len(row))]
        start.append(start[-1] + len(words) + len(row))
    return np.concatenate(index) if index else np.empty(0, np.int64), np.concatenate(value) if value else np.empty(0), np.array(start)


def _feature_rows(lexicon: np.ndarray, quality: LabelModel, safety: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                text, raw, at = Text.of(batch.column("text"))
                found, distinct = votes(text, raw, at, lexicon)
                index, _, start = _features(found, distinct)
                soft = quality.posterior(found[:, : len(QUALITY)]) * safety.posterior(found[:, len(QUALITY) :])
                n_words = np.array([len(d) for d in distinct])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(index.astype(np.int32))), pa.array(n_words, pa.int32()), pa.array(soft)],
                    names=["index", "n_words", "soft"],
                )

    return run


def fit_linear(index: list[np.ndarray], n_words: np.ndarray, soft: np.ndarray, epochs: int = 6, least_df: int = 5, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights (and bias last) of a logistic scorer by AdaGrad over batches in a fixed order."""
    weight, square = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    if not len(index):
        return weight
    df = np.bincount(np.concatenate(index), minlength=FEATURES)
    order = np.random.default_rng(5).permutation(len(index))
    bad = np.clip((1 - soft).mean(), 0.02, 0.98)
    for _ in range(epochs):
        for first in range(0, len(order), 64):
            rows = order[first : first + 64]
            at = np.concatenate([index[i] for i in rows])
            row = np.repeat(np.arange(len(rows)), [len(index[i]) for i in rows])
            value = np.concatenate([np.concatenate([np.full(n_words[i], 1 / np.sqrt(max(n_words[i], 1))), np.ones(len(index[i]) - n_words[i])]) for i in rows])
            value[df[at] < least_df] = 0.0
            z = np.bincount(row, weight[at] * value, minlength=len(rows)) + weight[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            cost = (p - soft[rows]) * np.where(soft[rows] < 0.5, 0.5 / bad, 0.5 / (1 - bad)) / len(rows)
            used, where = np.unique(at, return_inverse=True)
            slope = np.bincount(where, cost[row] * value) + decay * weight[used]
            square[used] += slope**2
            weight[used] -= rate * slope / np.sqrt(square[used])
            slope = cost.sum()
            square[-1] += slope**2
            weight[-1] -= rate * slope / np.sqrt(square[-1])
    return weight


@dataclass
class Classifier:
    lexicon: np.ndarray
    quality: LabelModel
    safety: LabelModel
    weight: np.ndarray

    def score(self, docs: DataFrame, keep: float = KEEP) -> DataFrame:
        """``docs`` plus p_good, p_safe (posteriors of the heuristics), score and accepted."""
        lexicon, quality, safety, weight = self.lexicon, self.quality, self.safety, self.weight.astype(np.float32)
        docs = docs.drop("p_good", "p_safe", "score", "accepted")
        columns = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in hashing.slices(whole, "text"):
                    text, raw, at = Text.of(batch.column("text"))
                    found, distinct = votes(text, raw, at, lexicon)
                    index, value, start = _features(found, distinct)
                    row = np.repeat(np.arange(len(found)), np.diff(start))
                    z = np.bincount(row, weight[index] * value, minlength=len(found)) + weight[-1]
                    score = np.where(np.diff(text.first) > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                    good = quality.posterior(found[:, : len(QUALITY)])
                    safe = safety.posterior(found[:, len(QUALITY) :])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good), pa.array(safe), pa.array(score), pa.array(score >= keep)], names=[*columns, "p_good", "p_safe", "score", "accepted"])

        schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("p_good", "p_safe", "score")), T.StructField("accepted", T.BooleanType())])
        return docs.mapInArrow(run, schema)


def _distinct_words(wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.slices(whole, "text"):
                text, _, _ = Text.of(batch.column("text"))
                found = [text.units(i) for i in range(batch.num_rows)]
                words = np.concatenate(found) if found else np.empty(0, np.uint64)
                words = words if wanted is None else words[np.isin(words, wanted)]
                word, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    return run


def learn_lexicon(texts: DataFrame, share: float = 0.02, ratio: float = 20.0, least: int = 8) -> np.ndarray:
    """Hashes of words and stems in ``share`` of the toxic ``texts(text, toxic)`` and ``ratio`` times rarer in the others."""
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    bad, fine = size.get(1, 0), size.get(0, 0)
    if not bad or not fine:
        return np.empty(0, np.uint64)
    count = F.sum("n").alias("n")
    often = texts.filter("toxic = 1").mapInArrow(_distinct_words(None), "word long, n long").groupBy("word").agg(count).filter(F.col("n") >= max(least, share * bad)).toArrow()
    word, n = often["word"].to_numpy(), often["n"].to_numpy()  # at most 1/share times the mean of distinct words
    if not len(word):
        return np.empty(0, np.uint64)
    also = texts.filter("toxic = 0").mapInArrow(_distinct_words(word.view(np.uint64)), "word long, n long").groupBy("word").agg(count).toArrow()
    other = dict(zip(also["word"].to_pylist(), also["n"].to_pylist(), strict=True))
    return np.array([w for w, k in zip(word.tolist(), n.tolist(), strict=True) if k / bad >= ratio * (other.get(w, 0) + 0.5) / (fine + 1)], np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame | None = None, max_labels: int = MAX_LABELS, train_rows: int = TRAIN_ROWS) -> Classifier:
    """Fit the label models and the scorer to ``docs(doc_id, text)`` and ``labels(doc_id, quality, toxic)``."""
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, max_labels, train_rows)


def _fit(docs: DataFrame, labels: DataFrame | None, max_labels: int, train_rows: int) -> Classifier:
    scratch = Scratch(docs.sparkSession, "quality")
    plain = docs.select("doc_id", "text")
    lexicon = _word_array(INSULTS)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    if labels is not None:
        labels = scratch.table(labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "labels")
        known = labels.filter(spread < max_labels / max(1, labels.count()))
        lexicon = np.union1d(lexicon, learn_lexicon(plain.join(F.broadcast(known), "doc_id").select("text", "toxic")))
    coded = plain.mapInArrow(_vote_rows(lexicon), "doc_id long, code long")
    if labels is not None:
        coded = coded.join(labels, "doc_id", "left")
    else:
        coded = coded.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    asked = coded.groupBy("code", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(1 - F.col("toxic"), F.lit(-1)).alias("safe")).count().collect()
    width = len(QUALITY) + len(SAFETY)
    code = np.array([r["code"] for r in asked], np.int64)
    pattern = (code[:, None] // 3 ** np.arange(width) % 3 - 1).reshape(len(code), width)
    count = np.array([r["count"] for r in asked], float)
    annotated = [np.array([r[c] for r in asked], np.int64) for c in ("quality", "safe")]
    quality = expectation_maximisation(pattern[:, : len(QUALITY)], count, annotated[0])
    safety = expectation_maximisation(pattern[:, len(QUALITY) :], count, annotated[1])
    rate = train_rows / max(1.0, float(count.sum()))
    sample = plain.filter(spread < rate).mapInArrow(_feature_rows(lexicon, quality, safety), "index array<int>, n_words int, soft double").toArrow()
    # Rows as views of the sample's own buffers; the driver gives the sample's memory back before it goes on.
    index = [x for part in sample["index"].chunks for x in np.split(part.flatten().to_numpy(), np.diff(part.offsets.to_numpy()).cumsum()[:-1]) if len(part)]
    weight = fit_linear(index, sample["n_words"].to_numpy(), sample["soft"].to_numpy())
    del index, sample
    hashing.trim()
    return Classifier(lexicon, quality, safety, weight)


def classify(docs: DataFrame, labels: DataFrame | None = None, **parameters) -> DataFrame:
    """``docs`` plus p_good, p_safe, score and accepted, by a classifier fitted to them.

    A null or blank text has no words, scores 0 and is rejected.  Equal
    texts score equally; rows of an empty table come back as an empty table.
    Columns passed in under the added names are replaced; labels of unknown
    doc_ids are ignored and of repeated ones the larger value counts.
    """
    return fit(docs, labels, **parameters).score(docs)
