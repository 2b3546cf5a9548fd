"""Token counts of fields by offset-mapped attribution.

A document is encoded once, whole, by a byte-level vocabulary, whose tokens spell out the text's bytes: their
lengths add up to byte spans. Fields are spans of the same text. Tokens and fields are joined as intervals, both
in order, and every token is given to exactly one field, so field counts add up to the document's count:

- a token inside one field belongs to it;
- a token over a boundary belongs to the field it shares most bytes with (``largest``), or to the one where it
  begins (``start``); of equal shares the earlier field has it;
- a token that touches no field (blanks between them) belongs to the field before it, or the first one.

Defined cases: null and empty texts have no tokens and one empty field; texts without field ends are one field;
special tokens' strings are ordinary text; repeated rows and rows without an id count alike; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb

RULES = ("largest", "start")
FIELDS = "doc_id long, n_tokens long, n_crossing long, fields array<struct<start:long,end:long,tokens:long,crossing:long>>"


@lru_cache(maxsize=2)
def _encoding(path: str | None):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each line; line ends are in none."""
    stops = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    return np.concatenate([[0], stops + 1]), np.append(stops, len(text))


def sentences(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each sentence: it ends after a full stop, exclamation or question mark or before a line end."""
    raw = np.frombuffer(text, np.uint8)
    stop = np.isin(raw, np.frombuffer(b".!?", np.uint8))
    last = np.flatnonzero(stop & ~np.append(stop[1:], False)) + 1
    ends = np.union1d(last, np.flatnonzero(raw == 10))
    starts = np.concatenate([[0], ends])
    ends = np.append(ends, len(text))
    full = ends > starts
    return (starts[full], ends[full]) if full.any() else (np.array([0]), np.array([len(text)]))


FIELD_KINDS = {"line": lines, "sentence": sentences}


def attribute(start: np.ndarray, end: np.ndarray, field_start: np.ndarray, field_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Field of each token, and whether the token crosses a field's boundary. Both sides are sorted and do not overlap among themselves."""
    first = np.searchsorted(field_end, start, "right")  # first field that ends after the token's start
    last = np.searchsorted(field_start, end, "left") - 1  # last field that starts before the token's end
    touches = first <= last
    home = np.where(touches, first, np.maximum(np.searchsorted(field_start, start, "right") - 1, 0))
    wide = np.flatnonzero(touches & (last > first))
    if rule == "largest" and len(wide):
        n = last[wide] - first[wide] + 1
        which = np.repeat(np.arange(len(wide)), n)
        field = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[wide][which]
        share = np.minimum(field_end[field], end[wide][which]) - np.maximum(field_start[field], start[wide][which])
        best = np.lexsort((field, -share, which))
        home[wide] = field[best[np.cumsum(n) - n]]
    elif rule == "start" and len(wide):
        home[wide] = first[wide]
    at = np.minimum(home, len(field_start) - 1)
    crossing = (last > first) | (touches & ((start < field_start[at]) | (end > field_end[at])))
    return at, crossing


def _attributed(kind: str, rule: str, vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, size = _encoding(vocabulary)
        split = FIELD_KINDS[kind]
        for batch in batches:
            for first, stop, _, _ in tb.chunks(batch.column(1)):
                n_tokens, n_crossing, parts = [], [], []
                for x in batch.column(1).slice(first, stop - first):
                    text = x.as_py() or ""
                    ids = np.array(encoding.encode_ordinary(text), np.int64)
                    end = np.cumsum(size[ids])
                    a, b = split(text.encode())
                    home, crossing = attribute(end - size[ids], end, a, b, rule)
                    n_tokens.append(len(ids))
                    n_crossing.append(int(crossing.sum()))
                    parts.append((a, b, np.bincount(home, minlength=len(a)), np.bincount(home, crossing, len(a)).astype(np.int64)))
                cut = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
                fields = pa.StructArray.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts, strict=True)], ["start", "end", "tokens", "crossing"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, stop - first), pa.array(n_tokens, pa.int64()), pa.array(n_crossing, pa.int64()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), fields)],
                    ["doc_id", "n_tokens", "n_crossing", "fields"],
                )

    return run


def field_tokens(documents: DataFrame, kind: str = "line", rule: str = "largest", vocabulary: str | None = None) -> DataFrame:
    """Per document its tokens, those over a boundary, and each field's byte span and tokens."""
    if rule not in RULES or kind not in FIELD_KINDS:
        raise ValueError(f"rule must be of {RULES} and kind of {tuple(FIELD_KINDS)}")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_attributed(kind, rule, vocabulary), FIELDS)
