"""Exact removal of long repeated byte strings, found on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes around it also starts earlier in the corpus. The corpus is cut into
independent pieces of work without losing any repeat: of every ``length - K + 1`` consecutive K-byte grams the
one with the smallest hash is an *anchor*, so all occurrences of a string of ``length`` bytes have the same
anchor at the same place inside. Around each anchor lies a *segment*: every such string that contains it.

1. Anchors are gathered by hash. Equal segments collapse to their earliest occurrence; all strings of the others
   are repeats and need no further look. Anchors with one segment left are done.
2. The segments that remain are fetched and, by anchor, put into blocks. A block's Burrows-Wheeler transform is
   expanded breadth first: intervals of strings one longer are derived from those of the level before by backward
   extension, each level fixes the boundaries whose common prefix has just that value, and it stops at ``length``.
   Suffixes between which no boundary was fixed share at least ``length`` bytes.
3. An anchor with more than ``hot`` different segments is not put into one block: its strings are spread by a
   128-bit hash, counted and compared by group-by instead.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; matches never cross texts; a row
that repeats id and text is the same text (both rows get equal results); rows that repeat an id with other text
rank by a 32-bit hash of the text after the id, by which they are told apart; rows without an id rank first, by a
72-bit hash of the text; ids within 2**40 of the smallest long count as none; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.shared import written

U = np.uint64
K = 32
#: Bytes of segments in one Burrows-Wheeler transform.
BLOCK_BYTES = 1 << 20
#: Starts are kept in the low bits (a text has less than 2 GB), the text's 32-bit hash above them.
START_BITS = 31
#: Rows without an id rank first: they get one of the smallest ids, by another 40 bits of the text's hash.
NO_ID, NO_ID_BITS = -(1 << 63), 40
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _text_keys(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    data = raw.tobytes()
    return np.array([text_key(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def prefix_hash(raw: np.ndarray, salt: int = 0) -> np.ndarray:
    values = tb.mix(np.arange(256, dtype=np.uint64) + U(0x5DEECE66D + salt)) | U(1)
    out = np.zeros(len(raw) + 1, U)
    np.cumsum(values[raw] * tb.powers(len(raw)), out=out[1:])
    return out


def anchors(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hash of the gram, hash of the segment, text, place, segment's start and end of each anchor of a chunk."""
    if len(raw) < length:
        return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 4
    total, inverse = prefix_hash(raw), tb.powers(len(raw) + 1, True)
    g = tb.mix((total[K:] - total[:-K]) * inverse[: len(raw) - K + 1])
    at = tb.window_minima(g, length - K + 1)
    owner = np.searchsorted(off, at, "right") - 1
    begin, end = off[owner], off[owner + 1]
    lo, hi = np.maximum(at - (length - K), begin), np.minimum(at + length, end)
    good = (at + K <= end) & (hi - lo >= length)
    at, owner, lo, hi = at[good], owner[good], lo[good], hi[good]
    segment = tb.mix((total[hi] - total[lo]) * inverse[lo] + U(0x9E37) * (at - lo).astype(U) + U(0x85EBCA6B) * (hi - at).astype(U))
    return g[at], segment, owner, at, lo, hi


def _batch_anchors(batch: pa.RecordBatch, length: int):
    """Anchors of a batch with doc_id and start code (text's hash and place); and which are the earliest with their segment."""
    parts = []
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, _, raw, off in tb.chunks(batch.column(1)):
        h, segment, owner, at, lo, hi = anchors(raw, off, length)
        code = _text_keys(raw, off)[owner] << START_BITS if len(owner) else owner
        begin = off[owner]
        parts.append((h, segment, ids[first + owner], code, at - begin, lo - begin, hi - begin))
    h, segment, doc, code, at, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((at, code, doc, segment, h))
    again = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    again[b] = (h[a] == h[b]) & (segment[a] == segment[b])
    # the same row's place comes once; a row that repeats id and text is no earlier occurrence
    same = (doc[a] == doc[b]) & (code[a] == code[b]) & (at[a] == at[b]) & ~again[a]
    again[b[same]] = False
    return h, segment, doc, code, at, lo, hi, again


def _first_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, segment, doc, code, at, _, _, again = _batch_anchors(batch, length)
                keep = ~again
                yield pa.RecordBatch.from_arrays([pa.array(x[keep], pa.int64()) for x in (h.view(np.int64), segment.view(np.int64), doc, code | at)], ["h", "segment", "doc_id", "at"])

    return run


def _later_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, doc, code, _, lo, hi, again = _batch_anchors(batch, length)
                doc, code, lo, hi = doc[again], code[again] >> START_BITS, lo[again], hi[again] - length
                order = np.lexsort((lo, code, doc))
                doc, code, lo, hi = doc[order], code[order], lo[order], hi[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1]) | (lo[1:] > hi[:-1] + 1)
                first = np.flatnonzero(new)
                if len(first):
                    last = np.append(first[1:], len(doc)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[first], code[first], lo[first], hi[last])], ["doc_id", "text_key", "lo", "hi"])

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [(x.as_py() or "").encode() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary())], ["doc_id", "text_key", "packed"])


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            h, doc, start, body, place = [], [], [], [], []
            for d, key, packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                text = unpack.decompress(packed.as_py())
                for x in wanted.as_py():
                    lo = max(0, x["at"] - (length - K))
                    h.append(x["h"])
                    doc.append(d)
                    start.append(key << START_BITS | lo)
                    body.append(text[lo : x["at"] + length])
                    place.append(x["at"] - lo)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(body, pa.binary()), pa.array(place, pa.int32())], ["h", "doc_id", "start", "body", "place"])

    return run


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least, by doubling (uint8 symbols; 0 follows the end)."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U)
    key = np.zeros(n, U)
    for i in range(8):
        key = key << U(8) | padded[i : i + n]
    order = np.argsort(key)
    known = 8
    while True:
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        place = np.cumsum(new) - 1
        if known >= depth or place[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = place + 1
        later = np.zeros(n, np.int64)
        later[: n - known] = rank[known:] if known < n else 0
        key = (rank.astype(U) << U(32)) | later.astype(U)
        tied = ~new | np.append(~new[1:], False)
        part = order[tied]
        order = order.copy()
        order[tied] = part[np.argsort(key[part], kind="stable")]
        known *= 2


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def boundaries(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """For i in 0..n, whether suffixes i-1 and i of the order share fewer than ``stop`` symbols.

    Breadth-first backward extension on the transform: the intervals of all strings of one length are disjoint;
    each gives, for every symbol before it, the interval of a string one longer, whose end is a boundary with the
    present length as common prefix unless a shorter one was found there before. Only intervals that found a new
    boundary are extended, so all levels together handle no more intervals than there are suffixes.
    """
    n = len(text)
    before = text[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(stop):
        if not len(lo):
            break
        inside = ranges(lo, hi)
        interval = np.repeat(np.arange(len(lo)), hi - lo)
        to = step[inside]
        s = np.argsort(to)
        to, interval, symbol = to[s], interval[s], before[inside[s]]
        new = np.ones(len(to), bool)
        new[1:] = (interval[1:] != interval[:-1]) | (symbol[1:] != symbol[:-1])
        first = np.flatnonzero(new)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~fixed[high]
        lo, hi = low[fresh], high[fresh]
        fixed[hi] = True
    return fixed


def repeats_in_block(bodies: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, start code) of every string of ``length`` bytes in the segments that also starts earlier there."""
    size = np.array([len(b) for b in bodies])
    first = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    # symbol 0 only separates: NUL bytes of texts share it with nothing that matters, as starts are told apart by size
    owner = np.repeat(np.arange(len(size)), size + 1)
    within = np.arange(len(joined)) - first[owner]
    order = sorted_suffixes(joined, length)
    fixed = boundaries(joined, order, length)
    group = np.cumsum(fixed[:-1]) - 1
    valid = (within + length <= size[owner])[order]
    order, group = order[valid], group[valid]
    d, s = doc[owner[order]], start[owner[order]] + within[order]
    ranked = np.lexsort((s, d, group))
    group, d, s = group[ranked], d[ranked], s[ranked]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    at = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0)) if len(group) else np.zeros(0, np.int64)
    later = (d != d[at]) | (s != s[at])
    return d[later], s[later]


def _runs(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    mask = (1 << START_BITS) - 1
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[first], start[first] >> START_BITS, start[first] & mask, start[last] & mask)], ["doc_id", "text_key", "lo", "hi"])


def with_company(bodies: list[bytes], places: list[int], length: int) -> list[int]:
    """Segments of one anchor that can share a string of ``length`` bytes with another.

    Such a string holds the anchor and either half of the rest before it or more than half after it.
    """
    half = (length - K) // 2
    before = [b[p - half : p + K] if p >= half else None for b, p in zip(bodies, places, strict=True)]
    after = [b[p : p + K + half] for b, p in zip(bodies, places, strict=True)]
    n_before, n_after = Counter(before), Counter(after)
    return [i for i, (x, y) in enumerate(zip(before, after, strict=True)) if (x is not None and n_before[x] > 1) or n_after[y] > 1]


def _blocks(length: int):
    """Rows come sorted by h; a block takes whole anchors until it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple[int, int, bytes]] = []
        anchor: list[tuple[int, int, bytes, int]] = []
        size, last = 0, None

        def close() -> None:
            nonlocal size
            if len(anchor) > 1:
                for i in with_company([x[2] for x in anchor], [x[3] for x in anchor], length):
                    block.append(anchor[i][:3])
                    size += len(anchor[i][2]) + 1
            anchor.clear()

        def out() -> pa.RecordBatch:
            docs, starts, bodies = zip(*block, strict=True)
            return _runs(*repeats_in_block(list(bodies), np.array(docs), np.array(starts), length))

        for batch in batches:
            for h, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if h != last:
                    close()
                    last = h
                    if size > BLOCK_BYTES:
                        yield out()
                        block, size = [], 0
                anchor.append(tuple(row))
        close()
        if block:
            yield out()

    return run


def _strings(length: int):
    """Strings of ``length`` bytes in segments: of each the earliest in some rows, with its 128-bit hash; and runs of the later ones (no hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s1", "s2", "doc_id", "text_key", "lo", "hi"]
        for batch in batches:
            doc, start = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            parts = []
            for first, _, raw, off in tb.chunks(batch.column(3)):
                size = np.diff(off)
                at = ranges(off[:-1], off[:-1] + np.maximum(size - length + 1, 0))
                owner = np.searchsorted(off, at, "right") - 1
                inverse = tb.powers(len(raw) + 1, True)
                both = []
                for salt in (1, 2):
                    total = prefix_hash(raw, salt)
                    both.append(tb.mix((total[at + length] - total[at]) * inverse[at]).view(np.int64))
                parts.append((*both, doc[first + owner], start[first + owner] + at - off[owner]))
            if not parts:
                continue
            s1, s2, d, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((s, d, s2, s1))
            s1, s2, d, s = s1[order], s2[order], d[order], s[order]
            head = np.ones(len(s1), bool)
            head[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            at = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.zeros(0, np.int64)
            later = (d != d[at]) | (s != s[at])
            key, low = s[head] >> START_BITS, s[head] & ((1 << START_BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (s1[head], s2[head], d[head], key, low, low)], names)
            spans = _runs(d[later], s[later])
            none = pa.nulls(spans.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *spans.columns], names)

    return run


def _ranked(documents: DataFrame) -> DataFrame:
    none = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 64 - NO_ID_BITS)
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), "text")


def repeated_spans(documents: DataFrame, length: int = 100, hot: int = 4096) -> DataFrame:
    """(doc_id, text_key, lo, hi): the strings of ``length`` bytes that start at lo..hi also start earlier."""
    if length < 2 * K:
        raise ValueError(f"length must be at least {2 * K}")
    spark = documents.sparkSession
    docs = _ranked(documents)
    spans = "doc_id long, text_key long, lo long, hi long"
    here = docs.mapInArrow(_first_anchors(length), "h long, segment long, doc_id long, at long")
    ordered = Window.partitionBy("h").orderBy("segment", "doc_id", "at")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mask = (1 << START_BITS) - 1
    met = here.select(
        *("h", "segment", "doc_id", "at"),
        F.lag("segment").over(ordered).eqNullSafe(F.col("segment")).alias("again"),
        F.lag("doc_id").over(ordered).eqNullSafe(F.col("doc_id")).alias("same_doc"),
        F.lag("at").over(ordered).eqNullSafe(F.col("at")).alias("same_at"),
        (F.first("segment").over(whole) != F.last("segment").over(whole)).alias("several"),
    )
    met = met.where("not (again and same_doc and same_at)").where("again or several")
    met = written(met.select("h", "doc_id", F.shiftright("at", START_BITS).alias("text_key"), F.col("at").bitwiseAND(F.lit(mask)).alias("at"), "again"), "met")
    later = met.where("again").select("doc_id", "text_key", "at")

    wanted = met.where("not again").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("h", "at")).alias("wanted"))
    packed = docs.mapInArrow(_compressed, "doc_id long, text_key long, packed binary").dropDuplicates(["doc_id", "text_key"])
    fetched = packed.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "packed", "wanted")
    hot_anchors = met.where("not again").groupBy("h").count().where(F.col("count") > hot).select("h")
    segments = written(fetched.mapInArrow(_segments(length), "h long, doc_id long, start long, body binary, place int"), "segments")
    cold = segments.join(hot_anchors, "h", "left_anti").select("h", "doc_id", "start", "body", "place")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_blocks = cold.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_blocks(length), spans)

    strings = segments.join(hot_anchors, "h", "left_semi").select("h", "doc_id", "start", "body").mapInArrow(_strings(length), "s1 long, s2 long, doc_id long, text_key long, lo long, hi long")
    strings = written(strings, "strings")
    firsts = strings.where("s1 is not null")
    place = F.struct("doc_id", "text_key", "lo")
    groups = firsts.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("s1", "s2", "first")
    spread = firsts.join(groups, ["s1", "s2"]).where(place != F.col("first")).select("doc_id", "text_key", "lo", "hi").distinct()
    spread = spread.unionByName(strings.where("s1 is null").select("doc_id", "text_key", "lo", "hi"))

    near = docs.mapInArrow(_later_anchors(length), spans)
    far = later.select("doc_id", "text_key", F.greatest(F.lit(0), F.col("at") - (length - K)).alias("lo"), F.col("at").alias("hi"))
    return near.unionByName(far).unionByName(in_blocks).unionByName(spread)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for d, packed, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                text = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                n = len(text)
                lo = hi = np.zeros(0, np.int64)
                if spans.is_valid and n >= length:
                    lo, hi = spans.values.field(0).to_numpy(), np.minimum(spans.values.field(1).to_numpy(), n - length)
                    lo, hi = lo[hi >= lo], hi[hi >= lo]
                gone = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi + length, minlength=n + 1))[:n] > 0
                edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
                rows.append((d, n, int(gone.sum()), int((edges > 0).sum()), hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(),) * 4 + (pa.string(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def without_repeats(documents: DataFrame, length: int = 100, hot: int = 4096) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, and the digest of what is left."""
    docs = _ranked(documents)
    spans = repeated_spans(documents, length, hot).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    packed = docs.mapInArrow(_compressed, "doc_id long, text_key long, packed binary")
    return packed.join(spans, ["doc_id", "text_key"], "left").select(F.when(F.col("doc_id") >= NO_ID + (1 << NO_ID_BITS), F.col("doc_id")).alias("doc_id"), "packed", "spans").mapInArrow(_cut(length), RESULT)
