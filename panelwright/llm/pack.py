"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Tokens never leave the task that makes them: what is packed are piece *lengths*, of which there are at most
``capacity`` different ones. Their counts (one small aggregate, whatever the corpus' size) decide the whole
packing: a bin is filled greedily with the largest length that still fits; then its smallest document is
exchanged for the two unpacked ones that fill the widened gap best; and the same bin is laid down as often as
the counts allow. The plan is a bounded list of runs ("the next r pieces of length L go to sequences s, s+1, ...,
m to each, from this offset"). Each piece finds its place by its rank among the pieces of its length, which is
counted per salted sub-group so that one very common length is spread over all tasks.

Defined cases: null and empty texts are the end id alone (length 1); a document over ``capacity`` tokens is cut
into full pieces and a rest; equal documents are packed each; rows that repeat an id are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.shared import written
from panelwright.llm.textbytes import release

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Word forms that a worker remembers. When they are so many, the first half stays: common words are met early.
CACHE_WORDS = 200_000

# The split pattern of the vocabulary file for lower-case Latin text, and the characters for which
# it is known to hold (others, and texts that name a special token, go through the tokenizer as a whole).
_LETTERS = "a-zªµºß-öø-ÿĀ-įı-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ]*")


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], bytes]:
    """Text to its ids as little-endian 32-bit numbers, remembering what each word form encodes to."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[str, bytes] = {}

    def as_bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return as_bytes(tokenizer.encode(text, add_special_tokens=False).ids)
        forms = _SPLIT.findall(text.lower())
        try:
            return b"".join(map(known.__getitem__, forms))
        except KeyError:
            if len(known) > CACHE_WORDS:
                for x in list(known)[CACHE_WORDS // 2 :]:
                    del known[x]
            new = [x for x in set(forms) if x not in known]
            known.update(zip(new, (as_bytes(e.ids) for e in tokenizer.encode_batch(new, add_special_tokens=False)), strict=True))
            return b"".join(map(known.__getitem__, forms))

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(vocabulary: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encode, end, step = encoder(vocabulary or default_vocabulary()), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = (encode(text.as_py() or "")) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at : at + step]
                    rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            release()

    return run


def pieces(documents: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """Every document's token ids, counted and cut to at most ``capacity``."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(vocabulary, capacity), PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces of it in a bin, first sequence, offset) that place every piece.

    A run holds until the next run of its length begins. There are no more bins' shapes than a small multiple of
    the number of different lengths: each shape is repeated until some length in it (nearly) runs out.
    """
    left = dict(counts)
    lengths = sorted(n for n, c in left.items() if c)
    used_rank: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    while lengths:
        shape: dict[int, int] = {}
        gap, top = capacity, len(lengths)
        while gap and (top := bisect_right(lengths, gap, 0, top)):
            n = lengths[top - 1]
            if m := min(left[n] - shape.get(n, 0), gap // n):
                shape[n] = shape.get(n, 0) + m
                gap -= m * n
            top -= 1
        if gap:
            smallest = min(shape)
            pair = best_pair(lengths, left, shape, gap + smallest, smallest)
            if pair:
                shape[smallest] -= 1
                for n in pair:
                    shape[n] = shape.get(n, 0) + 1
        shape = {n: m for n, m in shape.items() if m}
        times = min(left[n] // m for n, m in shape.items())
        offset = 0
        for n, m in sorted(shape.items(), reverse=True):
            first = used_rank.get(n, 0)
            runs.append((n, first, m, sequence, offset))
            used_rank[n] = first + m * times
            offset += n * m
            left[n] -= m * times
            if not left[n]:
                lengths.remove(n)
        sequence += times
    return runs


def best_pair(lengths: list[int], left: dict[int, int], shape: dict[int, int], room: int, over: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is at most ``room``, over ``over``, and as large as can be."""
    free = np.array([n for n in lengths[: bisect_right(lengths, room)] if left[n] - shape.get(n, 0) > 0])
    if not len(free):
        return None
    mate = np.searchsorted(free, np.minimum(room - free, free), "right") - 1
    single = np.array([left[n] - shape.get(n, 0) < 2 for n in free.tolist()])
    mate -= (mate >= 0) & (free[np.maximum(mate, 0)] == free) & single
    total = np.where(mate >= 0, free + free[np.maximum(mate, 0)], -1)
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(free[best]), int(free[mate[best]])) if over < total[best] <= room else None


def _placed(broadcast):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = broadcast.value
        key = runs[:, 0] << 48 | runs[:, 1]
        for x in frames:
            r = runs[np.searchsorted(key, (x["length"].to_numpy() << 48) | x["rank"].to_numpy(), "right") - 1]
            beyond = x["rank"].to_numpy() - r[:, 1]
            yield x.drop(columns="rank").assign(sequence_id=r[:, 3] + beyond // r[:, 2], offset=r[:, 4] + beyond % r[:, 2] * r[:, 0])

    return run


def packed(documents: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """One row per piece with the sequence and offset it is packed at."""
    spark = documents.sparkSession
    cut = written(pieces(documents, capacity, vocabulary), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(within)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("n") - 1).alias("rank"))
    return ranked.mapInPandas(_placed(spark.sparkContext.broadcast(runs)), RESULT)
