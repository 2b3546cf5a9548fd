"""Benchmark decontamination by winnowing.

Both sides keep, of every ``window - k + 1`` consecutive k-grams of words, the smallest hash. Two texts that
share ``window`` consecutive words share the k-grams of that span and so keep the same one: a join of the kept
fingerprints meets every shared span, and each meeting is extended word by word to see whether it is long enough.

The benchmark is the query set. It is laid out in blocks of at most ``block_words`` words; a block is what one
pass over the documents carries to each task, so memory has a bound whatever the benchmark's size, and no item,
document or occurrence is left out.

Defined cases: null or empty texts have no words and no hits; an item with fewer words than ``window`` is one
window of its own length; an item without words is ignored; rows that repeat an item's id count as one item, and items without an id as one whose id is the empty string; documents that repeat an id
keep a row each when there is one block, and are told apart by a row number otherwise; an empty benchmark gives
no hits; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb

K = 5
SPANS = "row_id long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Block:
    """Word hashes of some items and their sorted fingerprints."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        raw, off = tb.text_buffer(pa.array(texts, pa.large_string()))
        self.words, _, self.item = tb.words(raw, off, "alnum")
        self.ids, self.window = np.array(ids, object), window
        counts = np.bincount(self.item, minlength=len(ids))
        first = np.concatenate([[0], np.cumsum(counts)])
        at = fingerprints(self.words, self.item, window)
        at = at[counts[self.item[at]] >= window]
        g = tb.grams(self.words, K)
        order = np.argsort(g[at], kind="stable")
        self.at, self.keys = at[order], g[at][order]
        #: items shorter than a window, by length: sorted hashes of the whole item, and its place
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, window):
            which = np.flatnonzero(counts == n)
            if len(which):
                whole = tb.grams(self.words, n)[first[which]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], which[order]


def fingerprints(h: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Places of the winnowed k-grams that lie inside one text."""
    at = tb.window_minima(tb.grams(h, K), window - K + 1)
    return at[owner[at] == owner[at + K - 1]]


def matches(keys: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into found, into keys) of equal values; keys are sorted."""
    lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
    n = hi - lo
    left = np.repeat(np.arange(len(found)), n)
    return left, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def occurrences(block: Block, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (word places in the chunk) and item of every stretch covered by windows of the block's items."""
    window, out = block.window, []
    at = fingerprints(h, owner, window)
    if len(at) and len(block.keys):
        g = tb.grams(h, K)[at]
        i, j = matches(block.keys, g)
        d, b = at[i], block.at[j]
        left, right, going = np.zeros(len(d), np.int64), np.full(len(d), K), np.ones(len(d), bool)
        going &= (h[d] == block.words[b]) & (h[d + K - 1] == block.words[b + K - 1])
        whole = going.copy()
        for _ in range(window - K):  # a window over this fingerprint reaches no further
            x, y = d - left - 1, b - left - 1
            going &= (x >= 0) & (y >= 0)
            x, y = np.maximum(x, 0), np.maximum(y, 0)
            going &= (h[x] == block.words[y]) & (owner[x] == owner[d]) & (block.item[y] == block.item[b])
            left += going
        going = whole.copy()
        for _ in range(window - K):
            x, y = d + right, b + right
            going &= (x < len(h)) & (y < len(block.words))
            x, y = np.minimum(x, len(h) - 1), np.minimum(y, len(block.words) - 1)
            going &= (h[x] == block.words[y]) & (owner[x] == owner[d]) & (block.item[y] == block.item[b])
            right += going
        good = whole & (left + right >= window)
        out.append((d[good] - left[good], d[good] + right[good], block.item[b[good]]))
    for n, (keys, which) in block.short.items():
        if len(h) >= n:
            g = tb.grams(h, n)
            inside = np.flatnonzero(owner[: len(g)] == owner[n - 1 :])
            i, j = matches(keys, g[inside])
            out.append((inside[i], inside[i] + n, which[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    step = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def _documents(column: pa.Array, block: Block) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for first, end, raw, off in tb.chunks(column):
        h, _, owner = tb.words(raw, off, "alnum")
        yield first, end, h, owner, *occurrences(block, h, owner)


def _digests(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        none = items_digest([])
        for batch in batches:
            ids = batch.column(0)
            for first, end, h, owner, start, stop, item in _documents(batch.column(1), block):
                rows = end - first
                n_words = np.bincount(owner, minlength=rows)
                n_hit = np.bincount(owner[covered(start, stop, len(h))], minlength=rows)
                n_items, digest = np.zeros(rows, np.int64), [none] * rows
                if len(start):
                    pairs = np.unique(owner[start] * len(block.ids) + item)
                    doc, cut = np.unique(pairs // len(block.ids), return_index=True)
                    for d, which in zip(doc, np.split(pairs % len(block.ids), cut[1:]), strict=True):
                        found = list(set(block.ids[which]))
                        n_items[d], digest[d] = len(found), items_digest(found)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, rows), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items), pa.array(digest), pa.array(n_hit > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return run


def _spans(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = broadcast.value
        for batch in batches:
            for first, end, h, owner, start, stop, item in _documents(batch.column(2), block):
                rows = end - first
                n_words = np.bincount(owner, minlength=rows)
                base = np.cumsum(n_words) - n_words
                hit = covered(start, stop, len(h))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                spans: list[list[dict]] = [[] for _ in range(rows)]
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    while a < b:  # a stretch ends where its text does
                        d = owner[a]
                        stop_at = min(b, base[d] + n_words[d])
                        spans[d].append({"start": int(a - base[d]), "end": int(stop_at - base[d])})
                        a = stop_at
                items: list[set] = [set() for _ in range(rows)]
                for d, i in set(zip(owner[start].tolist(), item.tolist(), strict=True)):
                    items[d].add(block.ids[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    ["row_id", "doc_id", "n_words", "spans", "items"],
                )

    return run


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark's items in blocks; one is in the driver's memory at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        n = len(row.text) // 2 + 1
        if ids and size + n > block_words:
            yield Block(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(row.item_id or "")
        texts.append(row.text)
        size += n
    yield Block(ids, texts, window)


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 4_000_000) -> DataFrame:
    """Per document and block its words, merged hit spans (word places) and the items found: the operator's own output."""
    spark = documents.sparkSession
    rows = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [rows.mapInArrow(_spans(spark.sparkContext.broadcast(b)), SPANS) for b in blocks(benchmark, window, block_words)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 4_000_000) -> DataFrame:
    """The rows of ``documents``, all columns, in which no item window occurs."""
    spark = documents.sparkSession

    def clean(broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, _, owner, start, _, _ in _documents(batch.column("text"), broadcast.value):
                    keep[first + owner[start]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = documents
    for block in blocks(benchmark, window, block_words):
        out = out.mapInArrow(clean(spark.sparkContext.broadcast(block)), documents.schema)
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 4_000_000) -> DataFrame:
    """One row per document: its words, the words inside occurrences of item windows, and the items."""
    if window <= K:
        raise ValueError(f"window must be over {K}")
    spark = documents.sparkSession
    source = blocks(benchmark, window, block_words)
    first = next(source)
    second = next(source, None)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if second is None:
        return docs.mapInArrow(_digests(spark.sparkContext.broadcast(first)), RESULT)
    spans = contaminated_spans(documents, benchmark, window, block_words)
    grouped = spans.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a.reach, s.end).alias("reach"), (a.n + F.greatest(F.lit(0), s.end - F.greatest(a.reach, s.start))).alias("n")),
        lambda a: a.n,
    )
    return grouped.select(
        "doc_id",
        "n_words",
        step.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (step > 0).alias("contaminated"),
    )
