"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model on its words; the
document's is their noisy-or, one minus the product of what the sentences leave. Only documents have labels: the
likelihood of the noisy-or trains the sentence model, which then says where the offending sentences are.

Fitting takes at most ``max_labelled`` labelled documents, whole texts, chosen by a hash of the id; scoring covers
every text and runs map-only with the weights (2**BITS numbers) broadcast. Where labels are rare or wrong in part,
the likelihood's own scores lie low. So the log odds are shifted by one number, which puts 0.5 where the labels of
learning rows are told apart when each is scored by a model of the other FOLDS - 1 folds: where a logistic curve through
their odds, both labels weighing alike, gives even chances, or higher, so that SPARED of the clean rows lie below.
Ranks stay as they are.

Defined cases: null or empty texts and texts without words have no sentence and score 0; a sentence is what lies
between full stops, exclamation and question marks and line ends; repeated rows score alike; a document whose
label is null teaches nothing; of several labels of an id the largest holds; with no labelled rows or one class
only, all scores fall to the bias and nothing is shifted; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.labelled import labelled_sample, remainder

BITS = 20
#: Besides whole words, their first so many bytes are features, so that inflected forms share what they have in common.
STEMS = (5, 6, 7)
#: Parts of the learning rows that are scored by models of the others, and the share of clean ones that must lie below 0.5.
FOLDS, SPARED = 4, 0.95
_ENDS = np.zeros(256, np.int64)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = 1


def sentence_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Features of words and their stems, the sentence of each (numbered over the chunk), each sentence's text, first byte and end byte."""
    h, start, owner = tb.words(raw, off, "alnum")
    if not len(h):
        return (np.zeros(0, np.int64),) * 5
    after = np.cumsum(_ENDS[raw])
    sentence = after[start] + owner  # a word holds no sentence end itself
    new = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    first = np.flatnonzero(new)
    where = start[first]
    stops = np.flatnonzero(_ENDS[raw])
    text = owner[first]
    at = np.searchsorted(stops, where)
    end = np.minimum(np.append(stops + 1, len(raw))[at], off[text + 1])
    place = np.cumsum(new) - 1
    features, places = [h], [place]
    sizes = tb.word_sizes(raw, off, start, "alnum")
    for n in STEMS:
        which, stem = tb.prefixes(raw, start, sizes, n, "alnum")
        features.append(stem)
        places.append(place[which])
    return (np.concatenate(features) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(places), text, where, end


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, and each distinct (sentence of the text from 0, word) as two lists, sentences in order."""
    for batch in batches:
        for first, end, raw, off in tb.chunks(batch.column(1)):
            word, sentence, text, _, _ = sentence_words(raw, off)
            pairs = np.unique(sentence << BITS | word)
            sentence, word = pairs >> BITS, pairs & ((1 << BITS) - 1)
            owner = text[sentence] if len(text) else sentence
            cut = np.searchsorted(owner, np.arange(end - first + 1))
            own = sentence - np.searchsorted(text, np.arange(end - first))[owner] if len(text) else sentence
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).slice(first, end - first), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(own, pa.int32())), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(word, pa.int32()))],
                ["label", "sentence", "word"],
            )


class Bags:
    """Labelled documents: the sentence and word of every feature, those of document i from cut[i] to cut[i + 1]."""

    def __init__(self, table: pa.Table):
        chunks = table.to_batches()
        self.label = np.concatenate([b.column(0).to_numpy() for b in chunks]) if chunks else np.zeros(0, np.int32)
        self.sentence, self.word = (np.concatenate([b.column(i).flatten().to_numpy() for b in chunks]) if chunks else np.zeros(0, np.int32) for i in (1, 2))
        sizes = np.concatenate([b.column(1).value_lengths().to_numpy() for b in chunks]) if chunks else np.zeros(0, np.int64)
        self.cut = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.full = np.flatnonzero(sizes)

    def join(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence (numbered over all) and word of each feature of some documents, the document of each sentence, and the labels."""
        spans = [slice(a, b) for a, b in zip(self.cut[part], self.cut[part + 1], strict=True)]
        sizes = np.array([self.sentence[s.stop - 1] + 1 for s in spans], np.int64)
        base = np.repeat(np.cumsum(sizes) - sizes, self.cut[part + 1] - self.cut[part])
        sentence = np.concatenate([self.sentence[s] for s in spans]) + base
        return sentence, np.concatenate([self.word[s] for s in spans]), np.repeat(np.arange(len(part)), sizes), self.label[part]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pull(p: np.ndarray, owner: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slope, by each sentence's log odds, of minus the log likelihood of labels under the noisy-or of sentences with chances p."""
    none = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(label)))
    return np.where(label > 0, -none / np.maximum(1 - none, 1e-6), 1.0)[owner] * p


def _descend(bags: Bags, rows: np.ndarray, epochs: int, penalty: float, least: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias from these documents, by steps scaled with each feature's past slopes."""
    weight, bias = np.zeros(1 << BITS, np.float32), -5.0
    if not len(rows):
        return weight, bias
    seen = np.zeros(1 << BITS, np.int32)
    for i in rows:
        seen[np.unique(bags.word[bags.cut[i] : bags.cut[i + 1]])] += 1
    usable = seen >= min(least, 1 + len(rows) // 200)
    squares, bias_squares = np.full(1 << BITS, 1e-2, np.float32), 1.0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        order = random.permutation(rows)
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            sentence, word, owner, label = bags.join(part)
            slope = pull(_sigmoid(bias + np.bincount(sentence, weight[word], len(owner))), owner, label)
            used, inverse = np.unique(word, return_inverse=True)
            g = np.bincount(inverse, slope[sentence]) * usable[used] + penalty * len(part) * weight[used]
            squares[used] += g * g
            weight[used] -= 0.3 * g / np.sqrt(squares[used])
            bias_squares += slope.sum() ** 2
            bias -= 0.3 * slope.sum() / np.sqrt(bias_squares)
    return weight, float(bias)


def _noisy_or_odds(bags: Bags, rows: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.zeros(len(rows))
    for at in range(0, len(rows), 64):
        sentence, word, owner, label = bags.join(rows[at : at + 64])
        p = _sigmoid(bias + np.bincount(sentence, weight[word], len(owner)))
        out[at : at + 64] = log_odds(-np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label)))
    return out


def log_odds(miss: np.ndarray) -> np.ndarray:
    """Log odds of 1 - exp(-miss)."""
    return np.log(np.maximum(np.expm1(np.maximum(miss, 1e-300)), 1e-300))


def balanced_cut(odds: np.ndarray, label: np.ndarray, spared: float = SPARED) -> float:
    """The log odds at which a label is as likely as the other if both were as frequent, but not below ``spared`` of the zeros; 0 with fewer than 20 of a label."""
    ones, zeros = label > 0, label <= 0
    if min(ones.sum(), zeros.sum()) < 20:
        return 0.0
    x = np.clip(odds, -30, 30)
    weight = np.where(ones, 0.5 / ones.sum(), 0.5 / zeros.sum())
    center, scale = np.average(x, weights=weight), max(float(np.sqrt(np.cov(x, aweights=weight))), 1e-9)
    z = (x - center) / scale
    slope = level = 0.0
    for _ in range(50):  # Newton's steps, with a small penalty that keeps the slope finite where labels don't overlap
        p = _sigmoid(level + slope * z)
        gap, bend = weight * (p - ones), weight * p * (1 - p) + 1e-12
        g = np.array([gap.sum(), (gap * z).sum() + 1e-3 * slope])
        h = np.array([[bend.sum(), (bend * z).sum()], [(bend * z).sum(), (bend * z * z).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        level, slope = level - step[0], slope - step[1]
        if np.abs(step).max() < 1e-9:
            break
    even = center - scale * level / slope if slope > 1e-6 else -np.inf
    return float(max(even, np.quantile(x[zeros], spared)))


def fit(documents: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, max_labelled: int = 8000, epochs: int = 20, penalty: float = 1e-4, least: int = 10, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """Weights of words and stems, the bias, and the shift of log odds; features in fewer than ``least`` labelled documents have no weight."""
    sample = labelled_sample(documents, labels, "toxic", divisor, held_out, max_labelled).select("doc_id", "text", "label").orderBy("doc_id")
    bags = Bags(sample.mapInArrow(_features, "label int, sentence array<int>, word array<int>").toArrow())
    cut = 0.0
    if len(np.unique(bags.label[bags.full] > 0)) == 2:
        part = np.random.default_rng(seed).permutation(len(bags.full)) % FOLDS
        odds = np.zeros(len(bags.full))
        for k in range(FOLDS):
            odds[part == k] = _noisy_or_odds(bags, bags.full[part == k], *_descend(bags, bags.full[part != k], epochs, penalty, least, seed))
        cut = balanced_cut(odds, bags.label[bags.full])
    weight, bias = _descend(bags, bags.full, epochs, penalty, least, seed)
    return weight, bias, -cut


def bag_scores(raw: np.ndarray, off: np.ndarray, weight: np.ndarray, bias: float, shift: float) -> tuple[np.ndarray, ...]:
    """Shifted noisy-or of each text of a chunk; and each sentence's shifted probability, text, first byte and end byte."""
    n = len(off) - 1
    word, sentence, text, start, stop = sentence_words(raw, off)
    if not len(word):
        return np.zeros(n), np.zeros(0), text, start, stop
    pairs = np.unique(sentence << BITS | word)
    z = bias + np.bincount(pairs >> BITS, weight[pairs & ((1 << BITS) - 1)], len(text))
    miss = -np.bincount(text, np.log1p(-np.minimum(_sigmoid(z), 1 - 1e-12)), n)
    return np.where(miss > 0, _sigmoid(log_odds(miss) + shift), 0.0), _sigmoid(z + shift), text, start, stop


def _scores(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, off in tb.chunks(batch.column(1)):
                n = end - first
                score, p, text, start, stop = bag_scores(raw, off, *model.value)
                hot = np.flatnonzero(p >= threshold)
                cut = np.searchsorted(text[hot], np.arange(n + 1))
                spans = pa.StructArray.from_arrays([pa.array(start[hot] - off[text[hot]], pa.int64()), pa.array(stop[hot] - off[text[hot]], pa.int64()), pa.array(p[hot])], ["start", "end", "score"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.clip(score, 0, 1)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans)], ["doc_id", "score", "sentences"])

    return run


def scored(documents: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, sentences): the noisy-or, and UTF-8 byte spans of sentences that reach the threshold alone."""
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(broadcast, threshold), "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def without_toxic(documents: DataFrame, model: tuple[np.ndarray, float, float], threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns, whose score is below the threshold."""
    broadcast = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [bag_scores(raw, off, *broadcast.value)[0] < threshold for _, _, raw, off in tb.chunks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(low) if low else np.zeros(0, bool)))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """Every document's score, with its offending sentences and whether its label could have been learnt from."""
    found = scored(documents, fit(documents, labels, divisor, held_out))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), divisor) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
