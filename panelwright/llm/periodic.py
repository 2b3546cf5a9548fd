"""Runs: maximal stretches of words that repeat with some period.

Method: every run has a root that is the longest Lyndon word at its place under an order of the words or under its
reverse. Both Lyndon arrays come straight from the first phase of Baier's suffix sorting, ``lyndon_lengths``: suffixes
are kept in groups that share their Lyndon prefix, the highest group is taken, and each suffix whose prefix ends where
members of that group begin is moved into a new group right above its old one, its prefix lengthened by theirs. No
suffix array is finished and none is needed. Each root is then extended to both sides as far as the words equal those
one root away (longest common extensions by names of doubled lengths), and equal runs of several roots are one.

Words that can't lie in a run are set aside first, exactly: in a run of ``min_periods`` periods each word occurs that
often, so a document is cut at words that are rarer, and the stretches again at words that are rarer within them.
What remains goes through the method whole. All of it is map-only; tasks hold a few MB of text, or one longer text.

Defined cases: a null text stays null and has no words and no runs, an empty text or one of blanks has none either;
a stretch of one word has period 1; rows that repeat an id are judged each; null ids are kept; a very long text is one
piece of work of linear size (times the logarithm of its longest stretch) in one task; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb

U = np.uint64
#: Words of whole texts that are looked at together.
CHUNK_WORDS = 200_000
#: Rounds of setting aside rare words; further ones would spare work but change nothing.
ROUNDS = 12
RUN = pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()})


def lyndon_lengths(x: np.ndarray) -> list[int]:
    """Length of the longest Lyndon word that begins at each place of ``x``; its end counts as smaller than any symbol."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    group = np.searchsorted(ranked, x).tolist()  # first place of the group that a suffix is in
    size = np.bincount(group, minlength=n).tolist()  # by first place
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place, held = place.tolist(), order.tolist()
    length, before = [1] * n, [-1] * n
    end = n
    while end:
        start = group[held[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(held[start:end]) if end - start > 1 else (held[start],):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        grown = length[held[start]]
        by_times: dict[int, list[int]] = {}
        for j, c in times.items():
            by_times.setdefault(c, []).append(j)
        for c in sorted(by_times, reverse=True):
            moved = by_times[c]
            for j in moved:  # to the end of its group
                g = group[j]
                size[g] -= 1
                last, mine = g + size[g], place[j]
                other = held[last]
                held[last], held[mine], place[j], place[other] = j, other, last, mine
                length[j] += c * grown
            for j, new in [(j, group[j] + size[group[j]]) for j in moved]:
                group[j] = new
                size[new] += 1
        end = start
    return length


class Extensions:
    """Longest common extensions of pairs of places, by names of stretches of 1, 2, 4, ... words up to ``longest``."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n, self.names = len(ids), [tb.mix(ids.astype(U) + U(1))]
        while 2 << (len(self.names) - 1) <= longest:
            half, known = 1 << (len(self.names) - 1), self.names[-1]
            if len(known) <= half:
                break
            self.names.append(tb.mix(known[:-half] * U(0x9E3779B97F4A7C15) + known[half:]))

    def right(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, at most ``most``."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name = self.names[k]
            for _ in range(2 if k == len(self.names) - 1 else 1):
                x, y = a + out, b + out
                fits = np.flatnonzero(out + (1 << k) <= most)
                out[fits[name[x[fits]] == name[y[fits]]]] += 1 << k
        return out

    def left(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words before a and b, at most ``most``."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            for _ in range(2 if k == len(self.names) - 1 else 1):
                x, y = a - out - step, b - out - step
                fits = np.flatnonzero(out + step <= most)
                out[fits[name[x[fits]] == name[y[fits]]]] += step
        return out


def stretches(ids: np.ndarray, owner: np.ndarray, min_length: int, min_periods: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the stretches that runs lie in; ``ids`` are small numbers of their own for each text (``owner``)."""
    at, seg, names = np.arange(len(ids)), owner, ids
    for _ in range(ROUNDS):
        keep = np.bincount(names)[names] >= min_periods if len(names) else np.zeros(0, bool)
        if not keep.all():
            at, seg = at[keep], seg[keep]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(seg) != 0)
        seg = np.cumsum(new) - 1
        long = (np.bincount(seg) >= min_length)[seg] if len(seg) else np.zeros(0, bool)
        at, seg = at[long], seg[long]
        if not len(at) or (keep.all() and long.all()):
            break
        names = np.unique(seg * (int(ids.max()) + 1) + ids[at], return_inverse=True)[1]
    if not len(at):
        return at, at
    first = np.flatnonzero(np.diff(seg, prepend=-1))
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def runs(ids: np.ndarray, owner: np.ndarray, min_length: int, min_periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and period of every run of the texts laid end to end, by place and period."""
    starts, ends = stretches(ids, owner, min_length, min_periods)
    if not len(starts):
        return starts, starts, starts
    root, span, low, high = [], [], [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        x = ids[a:b]
        for order in (x, -x):
            root.append(np.arange(a, b))
            span.append(np.array(lyndon_lengths(order)))
            low.append(np.full(b - a, a))
            high.append(np.full(b - a, b))
    root, span, low, high = (np.concatenate(v) for v in (root, span, low, high))
    near = span * min_periods <= high - low
    root, span, low, high = root[near], span[near], low[near], high[near]
    common = Extensions(ids, int((ends - starts).max()))
    right = common.right(root, root + span, high - root - span)
    left = common.left(root, root + span, root - low)
    length = left + span + right
    good = length >= np.maximum(min_length, min_periods * span)
    found = np.unique(np.stack([(root - left)[good], span[good], length[good]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _rows(min_length: int, min_periods: int):
    def chunk(ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        words = [t.split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        first = np.cumsum(sizes) - sizes
        numbers, seen = np.zeros(int(sizes.sum()), np.int64), 0
        for w, a in zip(words, first.tolist(), strict=True):
            own = {x: seen + k for k, x in enumerate(dict.fromkeys(w))}
            seen += len(own)
            numbers[a : a + len(w)] = np.fromiter(map(own.__getitem__, w), np.int64, len(w))
        owner = np.repeat(np.arange(len(words)), sizes)
        start, length, period = runs(numbers, owner, min_length, min_periods)
        gone = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, start + length, -1)
        keep = np.cumsum(gone)[:-1] == 0
        of = owner[start] if len(start) else start
        marked = (np.bincount(of, minlength=len(words)) > 0).tolist()
        kept = []
        for i, (t, w, a) in enumerate(zip(texts, words, first.tolist(), strict=True)):
            kept.append(None if t is None else b" ".join(compress(w, keep[a : a + len(w)].tolist()) if marked[i] else w))
        found = pa.StructArray.from_arrays([pa.array(start - first[of]), pa.array(length), pa.array(period)], fields=list(RUN))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)), found)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "kept_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc)
                texts.append(text.as_py())
                size += len(texts[-1] or b"")
                if size >= 6 * CHUNK_WORDS:
                    yield chunk(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield chunk(ids, texts)

    return run


def repetitions(documents: DataFrame, min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, kept_text): the runs of at least so many words and periods, by start and period, and the text without repeats.

    ``runs`` are structs of start (word number), length and period; of each run the first period's words stay, and
    kept words are joined by one space.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_rows(min_length, min_periods), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string")


def looped(text: Column, seed: Column) -> Column:
    """``text`` whose words from number ``seed`` mod n on repeat the first few of them; null where there are no words.

    With a = seed mod n of n words, the period is 1 + floor((n - a) / (3 + seed mod 8)). A way to plant runs.
    """

    def run(texts: pa.Array, seeds: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts.cast(pa.binary()).to_pylist(), seeds.to_pylist(), strict=True):
            w = t.split() if t else []
            if w and g is not None:
                a = g % len(w)
                p = 1 + (len(w) - a) // (3 + g % 8)
                tail = w[a : a + p]
                w = w[:a] + (tail * (len(w) // len(tail) + 1))[: len(w) - a]
            out.append(b" ".join(w) if w else None)
        return pa.array(out, pa.binary()).cast(pa.string())

    return F.arrow_udf(run, "string")(text, seed)


def planted(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with a periodic tail where crc32 of the id ends in 0 (in tens); a null id has no such tail."""
    h = F.crc32(F.col("doc_id").cast("string"))
    tail = looped(F.when(h % 10 == 0, F.col("text")), F.floor(h / 10).cast("long"))
    return documents.select("doc_id", F.coalesce(tail, F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """How many runs there are, the one of the greatest exponent (compared exactly), and hashes of all runs and of what is kept."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r.length * b.period > b.length * r.period), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
