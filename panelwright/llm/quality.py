"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; the other sample is unlabelled web text, a mixture of
good and bad in unknown shares. The share of good ones is estimated from how much of the unlabelled sample lies
where positives do: the smallest ratio of upper tails under a classifier of positives against unlabelled, with a
margin for the samples' sizes. A small network then minimises the non-negative unbiased risk with that prior.

Fitting takes at most ``max_positive`` and ``max_unlabelled`` documents, whole texts, chosen by a hash of the id;
scoring covers every text and runs map-only. Inputs are shares and counts over the whole text, nothing else.

Defined cases: null texts are empty and have a score from zero counts; repeated rows score alike; labels that are
null or of bad quality teach nothing; with no positives every score is 0.5; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.labelled import document_sample, labelled_sample, remainder

#: Shares of a text's bytes that are inputs, as ranges of byte values.
BYTE_KINDS = {
    "lower": [(97, 122)], "upper": [(65, 90)], "digit": [(48, 57)], "blank": [(32, 32)], "line end": [(10, 10)], "other control": [(0, 9), (11, 31), (127, 127)],
    "stop": [(46, 46)], "comma": [(44, 44)], "shout": [(33, 33), (63, 63)], "bar": [(124, 124)], "sign": [(35, 38), (42, 42), (64, 64), (94, 94), (126, 126)],
    "bracket": [(40, 41), (60, 60), (62, 62), (91, 91), (93, 93), (123, 123), (125, 125)], "slash": [(47, 47), (92, 92), (95, 95), (58, 59), (61, 61)], "high": [(128, 255)],
}


def _kinds() -> np.ndarray:
    out = np.full(256, len(BYTE_KINDS), np.int64)
    for i, ranges in enumerate(BYTE_KINDS.values()):
        for a, b in ranges:
            out[a : b + 1] = i
    return out


KINDS = _kinds()


def inputs(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of numbers per text of a chunk."""
    n, k = len(off) - 1, len(BYTE_KINDS) + 1
    size = np.diff(off)
    text = np.repeat(np.arange(n), size)
    share = np.bincount(text * k + KINDS[raw], minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
    h, start, owner = tb.words(raw, off, "space")
    count = np.bincount(owner, minlength=n)
    per = np.maximum(count, 1)
    blank = np.cumsum(np.concatenate([[0], (raw == 32) | (raw == 10)]))
    end = np.append(start[1:], len(raw))
    length = end - start - (blank[end] - blank[start]) if len(start) else np.zeros(0)
    mean = np.bincount(owner, length, n) / per
    spread = np.sqrt(np.maximum(np.bincount(owner, length * length, n) / per - mean * mean, 0))
    pair = np.zeros(len(h), bool)
    pair[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct = _distinct(owner, h, n)
    again = np.zeros(len(h), bool)
    if len(h) > 5:
        again[5:] = (h[5:] == h[:-5]) & (owner[5:] == owner[:-5])
    letters = np.bincount(text, (KINDS[raw] <= 1) | (raw >= 128), n)
    lines = np.bincount(text, raw == 10, n) + 1
    stops = np.bincount(text, (raw == 46) | (raw == 33) | (raw == 63), n)
    extra = [
        np.log1p(size), np.log1p(count), mean, spread, np.bincount(owner, pair, n) / per, np.bincount(owner, again, n) / per, distinct / per, distinct / np.sqrt(per),
        letters / np.maximum(size, 1), np.log1p(count / lines), np.log1p(count / (stops + 1)), np.bincount(owner, length > 20, n) / per, (count == 0).astype(float),
    ]
    return np.column_stack([share, *extra])


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    return np.bincount(owner[order[new]], minlength=n)


def _inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, off in tb.chunks(batch.column(0)):
            x = inputs(raw, off)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["x"])


class Network:
    """One hidden layer on standardised inputs."""

    def __init__(self, x: np.ndarray, hidden: int, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(x @ self.w[0] + self.w[1])
        return a @ self.w[2] + self.w[3][0], a

    def step(self, x: np.ndarray, a: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        back = slope[:, None] * self.w[2] * (1 - a * a)
        self.t += 1
        for i, g in enumerate((x.T @ back, back.sum(axis=0), a.T @ slope, slope.sum(keepdims=True))):
            g = g + decay * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.standard(x))[0], -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int, sureness: float = 0.1) -> float:
    """Share of positives among the unlabelled: best bin of a positive-against-unlabelled classifier on rows it was not fitted on."""
    a, b = len(positive) // 2, len(unlabelled) // 2
    net = Network(np.concatenate([positive[:a], unlabelled[:b]]), 16, seed)
    p, u = net.standard(positive[:a]), net.standard(unlabelled[:b])
    random = np.random.default_rng(seed)
    for _ in range(400):
        i, j = random.integers(0, len(p), 256), random.integers(0, len(u), 256)
        x = np.concatenate([p[i], u[j]])
        z, hidden = net.forward(x)
        net.step(x, hidden, (_sigmoid(z) - np.repeat([1, 0], 256)) / 512, 5e-3, 1e-4)
    sp, su = np.sort(net.score(positive[a:])), np.sort(net.score(unlabelled[b:]))
    cut = np.quantile(sp, np.linspace(0, 0.95, 200))
    tail_p = 1 - np.searchsorted(sp, cut) / len(sp)
    tail_u = 1 - np.searchsorted(su, cut) / len(su)
    margin = np.sqrt(np.log(4 / sureness) / 2 / len(sp)) + np.sqrt(np.log(4 / sureness) / 2 / len(su))
    best = np.argmin((tail_u + margin) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.98))


def risk_slope(z: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Slope of the non-negative unbiased risk by outputs z, of which the first n are positives'; the loss is the sigmoid's.

    The risk is prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)); where the
    second part is below zero it is pushed back alone.
    """
    s, m = _sigmoid(z), len(z) - n
    d = s * (1 - s)
    if s[n:].mean() - prior * s[:n].mean() >= 0:
        return np.concatenate([-2 * prior * d[:n] / n, d[n:] / m])
    return np.concatenate([prior * d[:n] / n, -d[n:] / m])


def fit(documents: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, max_positive: int = 8000, max_unlabelled: int = 16000, hidden: int = 32, steps: int = 1500, seed: int = 3) -> Network | None:
    """The network, or nothing where there are too few positives to learn from."""
    good = labelled_sample(documents, labels, "quality", divisor, held_out, max_positive).where("label = 1")
    web = document_sample(documents, max_unlabelled)
    p, u = (np.array([r for r in x.orderBy("doc_id").select("text").mapInArrow(_inputs, "x array<double>").toArrow().column("x").to_pylist()]) for x in (good, web))
    if len(p) < 4 or len(u) < 4:
        return None
    random = np.random.default_rng(seed)
    p, u = p[random.permutation(len(p))], u[random.permutation(len(u))]
    prior = class_prior(p, u, seed)
    net = Network(u, hidden, seed)
    p, u = net.standard(p), net.standard(u)
    for _ in range(steps):
        i, j = random.integers(0, len(p), min(len(p), 512)), random.integers(0, len(u), min(len(u), 512))
        x = np.concatenate([p[i], u[j]])
        z, a = net.forward(x)
        slope = risk_slope(z, len(i), prior)
        net.step(x, a, slope, 3e-3, 1e-4)
    return net


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for first, end, raw, off in tb.chunks(batch.column(1)):
                score = net.score(inputs(raw, off)) if net else np.full(end - first, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(score)], ["doc_id", "score"])

    return run


def quality(documents: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1) -> DataFrame:
    """Every document's score, and whether its label could have been learnt from."""
    broadcast = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, divisor, held_out))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(broadcast), "doc_id long, score double")
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), divisor) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
