"""LM scoring with Brown class-based bigrams.

Words are counted over the whole learning corpus and put into classes in two steps. First by exchange: units are the
``single`` most frequent words, one by one, and groups of all other words by a hash of their last bytes; each unit
moves to the class where the likelihood of the class bigrams is highest, a part of the units at a time against one
frozen table of classes, so the moves do not depend on tasks or their number, until a sweep no longer gains. Then
every further word of the ``head`` joins the class in which the bigrams it was seen in are likeliest, again against
one table. Words beyond the head, seen or not, keep the class of their group. The score of a text is the log10
probability of its class bigrams (interpolated with class frequencies, so that none is zero) and of each word in its
class, where words beyond the head, and words never seen, are smoothed by one.

What each task carries is bounded: the ``head`` most frequent words with their counts and classes, the groups'
classes and the table of classes. All other words keep their counts in a distributed table that texts are joined
with. Words are named by 64-bit hashes.

Defined cases: null and empty texts are one end token; equal texts score alike; rows that repeat an id are scored
each; a null id counts as learning; with nothing to learn from, every probability is that of one unseen word;
an empty table gives an empty table; other columns are ignored. What begins a text is taken from class frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.labelled import remainder
from panelwright.llm.shared import written

U = np.uint64
END = U(0x454E44)
FLUSH = 4_000_000
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(raw: np.ndarray, off: np.ndarray, shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and ending (a hash of the last three bytes, below ``shapes``) of every token of a chunk, an end after each text's words."""
    h, start, owner = tb.words(raw, off, "space")
    n = len(off) - 1
    ending = np.zeros(len(h), U)
    if len(h):
        last = start + tb.word_sizes(raw, off, start, "space") - 1
        low = raw | ((raw >= 0x41) & (raw <= 0x5A)).astype(np.uint8) * np.uint8(0x20)
        for i in range(3):
            ending = ending << U(8) | np.where(last - i >= start, low[np.maximum(last - i, 0)], 0).astype(U)
    ending = (tb.mix(ending) % U(shapes)).astype(np.int64)
    stop = np.searchsorted(owner, np.arange(n), "right")
    return np.insert(h, stop, END), np.insert(owner, stop, np.arange(n)), np.insert(ending, stop, 0)


def _counts(shapes: int):
    """Rows (word, ending, n), counted over some texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, endings, size = [], [], 0

        def out() -> pa.RecordBatch:
            value, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.concatenate(endings)[first], pa.int32()), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

        for batch in batches:
            for _, _, raw, off in tb.chunks(batch.column(0)):
                h, _, ending = tokens(raw, off, shapes)
                held.append(h)
                endings.append(ending)
                size += len(h)
                if size > FLUSH:
                    yield out()
                    held, endings, size = [], [], 0
        if held:
            yield out()

    return run


class Words:
    """The most frequent words: hash, count and rank, found by hash."""

    def __init__(self, word: np.ndarray, count: np.ndarray):
        by_hash = np.argsort(word)
        self.word, self.count, self.rank = word[by_hash], count[by_hash], by_hash.astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not among them."""
        if not len(self.word):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
        return np.where(self.word[at] == h, at, -1)


def units(words: Words, h: np.ndarray, ending: np.ndarray, single: int) -> tuple[np.ndarray, np.ndarray]:
    """Place among ``words`` (or -1) and unit of each token: its rank, or a group of endings after the single words."""
    at = words.find(h)
    rank = np.where(at >= 0, words.rank[np.maximum(at, 0)], single) if len(words.rank) else np.full(len(h), single)
    return at, np.where(rank < single, rank, single + ending)


def _bigrams(broadcast, single: int, shapes: int):
    """Rows (a, b, n): neighbouring units, counted over some texts each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n_units = broadcast.value, single + shapes
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair // n_units, pa.int32()), pa.array(pair % n_units, pa.int32()), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for _, _, raw, off in tb.chunks(batch.column(0)):
                h, owner, ending = tokens(raw, off, shapes)
                _, unit = units(words, h, ending, single)
                inside = owner[:-1] == owner[1:]
                held.append(unit[:-1][inside] * n_units + unit[1:][inside])
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _moves(state, part: int, parts: int, classes: int):
    """New classes of the units of one part, from those they follow and precede, all against the same table of classes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, m = state.value[0], state.value[1].astype(float)
        d = np.arange(classes)
        for x in frames:
            rows = []
            for w, after, n_after, before, n_before in x.itertuples(index=False, name=None):
                if w % parts != part:
                    continue
                own = of[w]
                after, before = np.asarray(after, np.int64), np.asarray(before, np.int64)
                loop = float(np.asarray(n_after)[after == w].sum())
                r = np.bincount(of[after], np.asarray(n_after) * (after != w), classes)
                s = np.bincount(of[before], np.asarray(n_before) * (before != w), classes)
                rest = m.copy()  # the table without this unit
                rest[own] -= r
                rest[:, own] -= s
                rest[own, own] -= loop
                left, right = rest.sum(axis=1), rest.sum(axis=0)
                base = _xlogx(rest)
                # gain of the bigram terms in each class it could join, less the growth of the classes' totals
                gain = (_xlogx(rest + r) - base).sum(axis=1) + (_xlogx(rest + s[:, None]) - base).sum(axis=0)
                gain += _xlogx(rest[d, d] + r + s + loop) - _xlogx(rest[d, d] + r) - _xlogx(rest[d, d] + s) + base[d, d]
                one, other = left + s, right + r  # totals wherever it goes
                gain -= _xlogx(one + r.sum() + loop) - _xlogx(one) + _xlogx(other + s.sum() + loop) - _xlogx(other)
                best = int(np.argmax(np.round(gain, 6)))
                if best != own and gain[best] > gain[own] + 1e-6:
                    rows.append((w, best))
            yield pd.DataFrame(rows, columns=["word", "class"]).astype({"word": "int32", "class": "int32"})

    return run


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, up to what no exchange changes."""
    return float(_xlogx(m.astype(float)).sum() - _xlogx(m.sum(axis=1).astype(float)).sum() - _xlogx(m.sum(axis=0).astype(float)).sum())


def exchange(pairs: DataFrame, n_units: int, classes: int, rounds: int, parts: int = 4, least_gain: float = 1e-4) -> np.ndarray:
    """Class of each unit, from counts (a, b, n) of neighbouring units.

    A round exchanges one part of the units. It ends when a sweep over all parts gains less than ``least_gain`` of what
    the likelihood has gained so far, after ``rounds`` at the latest; the classes with the highest likelihood count. A
    unit has at most ``n_units`` neighbours on either side.
    """
    spark = pairs.sparkSession
    right = pairs.groupBy(F.col("a").alias("word")).agg(F.collect_list("b").alias("after"), F.collect_list("n").alias("n_after"))
    left = pairs.groupBy(F.col("b").alias("word")).agg(F.collect_list("a").alias("before"), F.collect_list("n").alias("n_before"))
    empty_ids, empty_counts = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    rows = right.join(left, "word", "full").select("word", F.coalesce("after", empty_ids), F.coalesce("n_after", empty_counts), F.coalesce("before", empty_ids), F.coalesce("n_before", empty_counts)).toDF("word", "after", "n_after", "before", "n_before")
    rows = written(rows.repartition("word"), "neighbours")
    of = np.arange(n_units, dtype=np.int64) % classes
    best, reached, last_sweep = of, -np.inf, -np.inf
    start = None
    for turn in range(rounds + 1):
        table = pairs_by_class(pairs, of, classes)
        now = likelihood(table)
        start = now if start is None else start
        if now > reached:
            best, reached = of, now
        if turn and turn % parts == 0:
            if reached - max(last_sweep, start) <= least_gain * (reached - start):
                break
            last_sweep = reached
        if turn == rounds:
            break
        state = spark.sparkContext.broadcast((of, table))
        moved = rows.mapInPandas(_moves(state, turn % parts, parts, classes), "word int, class int").toPandas()
        of = of.copy()
        of[moved["word"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int64)
        state.unpersist()
    return best


def _contexts(broadcast, single: int, shapes: int, classes: int):
    """Rows (rank, side, n): how often words of the head that are no units of their own stand before (side < classes) or behind a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of = broadcast.value
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key // (2 * classes), pa.int32()), pa.array(key % (2 * classes), pa.int32()), pa.array(n.astype(np.int64))], ["rank", "side", "n"])

        for batch in batches:
            for _, _, raw, off in tb.chunks(batch.column(0)):
                h, owner, ending = tokens(raw, off, shapes)
                at, unit = units(words, h, ending, single)
                rank = np.where(at >= 0, words.rank[np.maximum(at, 0)], -1) if len(words.rank) else np.full(len(h), -1)
                near = np.flatnonzero(owner[:-1] == owner[1:])
                for i, j, side in ((near, near + 1, 0), (near + 1, near, classes)):
                    own = rank[i] >= single
                    held.append(rank[i[own]] * (2 * classes) + side + of[unit[j[own]]])
                    size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _placed(table: np.ndarray, size: np.ndarray, classes: int):
    """Class of each word from its neighbours' classes, where the bigrams it was seen in are likeliest."""
    m = table.astype(float) + 0.5
    ahead, behind = np.log(m / m.sum(axis=1, keepdims=True)), np.log(m / m.sum(axis=0, keepdims=True))
    # what a class pays for one more token among its own
    weights = np.concatenate([ahead.T, behind]) - np.log(size + 1.0) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = batch.column(1).offsets.to_numpy()
            side, n = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            total = np.stack([np.bincount(row, n * weights[side, c], batch.num_rows) for c in range(classes)], axis=1) if batch.num_rows else np.zeros((0, classes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.argmax(np.round(total, 6), axis=1), pa.int32())], ["rank", "class"])

    return run


def _class_bigrams(broadcast, shapes: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, class_of, of_group = broadcast.value
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for _, _, raw, off in tb.chunks(batch.column(0)):
                h, owner, ending = tokens(raw, off, shapes)
                c = classes_of(words, class_of, of_group, h, ending)[1]
                inside = owner[:-1] == owner[1:]
                total += np.bincount(c[:-1][inside] * classes + c[1:][inside], minlength=classes * classes)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["k", "n"])

    return run


def classes_of(words: Words, class_of: np.ndarray, of_group: np.ndarray, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place among ``words`` (or -1) and class of each token."""
    at = words.find(h)
    return at, np.where(at >= 0, class_of[np.maximum(at, 0)], of_group[ending]) if len(class_of) else of_group[ending]


def _square(counted: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros(classes * classes, np.int64)
    for r in counted.groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most classes**2 rows
        out[r["k"]] = r["n"]
    return out.reshape(classes, classes)


def pairs_by_class(pairs: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Class bigram counts from word bigram counts."""
    spark = pairs.sparkSession
    known = spark.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for b in batches:
            key = known.value[b.column(0).to_numpy()] * classes + known.value[b.column(1).to_numpy()]
            np.add.at(total, key, b.column(2).to_numpy())
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["k", "n"])

    return _square(pairs.select("a", "b", "n").mapInArrow(run, "k long, n long"), classes)


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """At most ``head`` words: all whose count lies in the highest steps (sixteenths of a doubling) that fit."""
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # at most 16 * 64 rows
    least, held = None, 0
    for r in steps:
        held += r["v"]
        if held > head:
            break
        least = r["least"]
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)


class Model:
    """Classes of words and their smoothed log10 probabilities.

    class_of: by place in words; of_group: by ending; rest_tokens, rest_kinds: tokens and words of each group beyond the head.
    """

    def __init__(self, words: Words, class_of: np.ndarray, of_group: np.ndarray, shapes: int, classes: int, rest_tokens: np.ndarray, rest_kinds: np.ndarray, pairs: np.ndarray):
        self.words, self.class_of, self.of_group, self.shapes, self.classes = words, class_of, of_group, shapes, classes
        size = np.bincount(class_of, words.count, classes) + np.bincount(of_group, rest_tokens, classes)
        smoothed = size + np.bincount(of_group, rest_kinds, classes) + 1
        self.size_log = np.log10(smoothed)
        self.emit = np.log10(words.count)  # by place; words beyond the head have one more than their count
        share = (size + 1) / (size + 1).sum()
        seen, back = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True) + 1.0
        step = np.log10((pairs + back * share[None, :]) / (seen + back))
        self.step = np.concatenate([step, np.log10(share)[None, :]])  # last: what may begin a text

    def logs(self, h: np.ndarray, owner: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the head's words and log10 probability of each token, up to the counts of words beyond the head."""
        at, c = classes_of(self.words, self.class_of, self.of_group, h, ending)
        before = np.concatenate([[self.classes], np.where(owner[1:] == owner[:-1], c[:-1], self.classes)])
        emit = np.where(at >= 0, self.emit[np.maximum(at, 0)] if len(self.emit) else 0.0, 0.0)
        return at, self.step[before, c] + emit - self.size_log[c]


def _scores(broadcast):
    """Per text the sums over words of the head; and its other words (hash and count) for the distributed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        base = np.log10(model.words.count + 1.0) if len(model.words.count) else np.zeros(1)
        for batch in batches:
            for first, end, raw, off in tb.chunks(batch.column(2)):
                n = end - first
                h, owner, ending = tokens(raw, off, model.shapes)
                at, logs = model.logs(h, owner, ending)
                there = at >= 0
                base_sum = np.bincount(owner, np.where(there, base[np.maximum(at, 0)], 0.0), n)
                far = np.flatnonzero(~there)
                order = far[np.lexsort((h[far], owner[far]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order[1:]] != h[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(order)))
                cut = np.searchsorted(owner[order[head]], np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(np.bincount(owner, minlength=n), pa.int64()), pa.array(np.bincount(owner, there, n).astype(np.int64)),
                        pa.array(base_sum), pa.array(np.bincount(owner, logs, n)),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[order[head]].view(np.int64))), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(times, pa.int32())),
                    ],
                    ["row_id", "doc_id", "n_tokens", "near", "base", "score", "far", "times"],
                )

    return run


def fit(learning: DataFrame, head: int = 1 << 18, single: int = 4096, shapes: int = 512, classes: int = 64, rounds: int = 32) -> tuple[Model, DataFrame, int, int]:
    """The model of the texts, the counts of all words, and how many tokens and distinct tokens there are.

    head: words that tasks carry; single: those of them that are exchanged one by one.
    """
    spark = learning.sparkSession
    counts = learning.mapInArrow(_counts(shapes), "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    by_ending = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # one row per ending
    total, vocabulary = int(by_ending["n"].sum()), int(by_ending["v"].sum())
    top = most_frequent(counts, head).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = Words(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))
    single = min(single, len(top))
    pairs = learning.mapInArrow(_bigrams(spark.sparkContext.broadcast(words), single, shapes), "a int, b int, n long")
    pairs = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")
    of = exchange(pairs, single + shapes, classes, rounds)

    # every further word of the head
    rank_class = np.concatenate([of[:single], of[single + top["ending"].to_numpy(np.int64)[single:]]])
    seen = learning.mapInArrow(_contexts(spark.sparkContext.broadcast((words, of)), single, shapes, classes), "rank int, side int, n long")
    seen = seen.groupBy("rank", "side").agg(F.sum("n").alias("n")).groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("side", "n"))).alias("x"))
    size = np.bincount(of, np.concatenate([top["n"].to_numpy()[:single], np.zeros(shapes)]), classes)
    found = seen.select("rank", "x.side", "x.n").mapInArrow(_placed(pairs_by_class(pairs, of, classes), size, classes), "rank int, class int").toPandas()
    rank_class[found["rank"].to_numpy(np.int64)] = found["class"].to_numpy(np.int64)
    class_of, of_group = rank_class[words.rank], of[single:]

    rest_tokens, rest_kinds = np.zeros(shapes), np.zeros(shapes)
    rest_tokens[by_ending["ending"]], rest_kinds[by_ending["ending"]] = by_ending["n"], by_ending["v"]
    np.subtract.at(rest_tokens, top["ending"].to_numpy(), top["n"].to_numpy())
    np.subtract.at(rest_kinds, top["ending"].to_numpy(), 1)
    steps = _square(learning.mapInArrow(_class_bigrams(spark.sparkContext.broadcast((words, class_of, of_group)), shapes, classes), "k long, n long"), classes)
    return Model(words, class_of, of_group, shapes, classes, rest_tokens, rest_kinds, steps), counts, total, vocabulary


def scores(documents: DataFrame, divisor: int = 7, held_out: int = 2, **sizes: int) -> DataFrame:
    """Every document's counts, its add-one unigram score and its class-bigram score (log10)."""
    spark = documents.sparkSession
    held = F.coalesce(remainder(F.col("doc_id"), divisor) == held_out, F.lit(False))
    model, counts, total, vocabulary = fit(documents.where(~held).select("text"), **sizes)

    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row_id long, doc_id long, n_tokens long, near long, base double, score double, far array<long>, times array<int>"
    partly = written(rows.mapInArrow(_scores(spark.sparkContext.broadcast(model)), schema), "partly")
    far = partly.select("row_id", F.explode(F.arrays_zip("far", "times")).alias("x")).select("row_id", F.col("x.far").alias("word"), F.col("x.times").alias("times"))
    rare = far.join(counts, "word").groupBy("row_id").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("logs"))
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return partly.join(rare, "row_id", "left").select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), divisor) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("near") + known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(total + vocabulary + 1))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
