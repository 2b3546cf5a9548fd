"""Substring dedup by hashing units of text.

Units are sentences within lines: a run of other characters with the full stops, exclamation marks, question marks
and line ends that follow it; together they are the whole text. A unit is normalised (blanks squeezed and trimmed,
A-Z to a-z), digested to 128 bits, and the digests are grouped over the whole corpus: the earliest unit (smallest
doc_id, then place) of each digest stays. Later ones go where they stand together: a stretch of adjacent later units
is removed if it has at least ``min_words`` words. So a passage that was copied into another text goes whole even
if its first or last sentence has run into its surroundings, and short phrases that any two texts may share stay.

Each task first settles what it can: of the units of one digest that it has seen together only the earliest is
shuffled, the others are later ones whatever other tasks hold. So no digest, however common, sends more rows than
there were chunks, and the window over a digest is small.

Defined cases: a null text stays null and has no units; an empty text has none and stays; units without words always
stay; rows that repeat both id and text are one document (they get equal results); rows that repeat an id with other
text rank by a hash of the text; a document all of whose units go keeps its row with an empty text; a null id ranks
first; an empty table gives an empty table; other columns are carried along untouched, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.shared import unused, written

U = np.uint64
#: Units that a task looks at together before it reports the earliest of each digest.
FLUSH = 250_000
_ENDS = np.zeros(256, bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def split(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and text index of every unit of a chunk."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = _ENDS[raw]
    begins = np.zeros(len(raw), bool)
    begins[1:] = ends[:-1] & ~ends[1:]
    begins[off[:-1][np.diff(off) > 0]] = True
    start = np.flatnonzero(begins)
    return start, np.searchsorted(off, start, "right") - 1


def digests(raw: np.ndarray, off: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each unit and the two halves of its digest; units without words have 0, 0."""
    h, first, _ = tb.words(raw, off, "space")
    # a word that holds a stop inside (as in 3.5) is one word of the text but lies in two units: each unit has its own part
    cut = np.setdiff1d(start, first, assume_unique=True)
    inside = cut[tb.byte_class("space")[raw[cut]]] if len(cut) else cut
    if len(inside):
        h, first, _ = tb.words(raw, np.union1d(off, inside), "space")
    owner = np.searchsorted(start, first, "right") - 1
    words = np.bincount(owner, minlength=len(start))
    begin = np.cumsum(words) - words
    place = np.arange(len(h)) - begin[owner]
    a, b = np.zeros(len(start), U), np.zeros(len(start), U)
    full = words > 0
    if len(h):
        step = tb.powers(int(words.max()) + 1)[place]
        a[full] = np.add.reduceat(tb.mix(h + U(0x1234567)) * step, begin[full])
        b[full] = np.add.reduceat(tb.mix(h ^ U(0x5DEECE66D)) * step, begin[full])
    return words, np.where(full, tb.mix(a + words.astype(U)), U(0)), np.where(full, tb.mix(b ^ words.astype(U)), U(0))


def _survey(flush: int):
    """Rows (doc_id, text_key, place, a, b): the earliest unit of each digest of a chunk; units known to be later have no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            doc, known, key, place, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, key, doc, known, b, a))
            later = np.zeros(len(order), bool)
            later[1:] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
            # rows that repeat id and text are one document
            same = later.copy()
            for x in (doc, known, key, place):
                same[1:] &= x[order[1:]] == x[order[:-1]]
            order, later = order[~same], later[~same]
            digest = [pa.array(x[order].view(np.int64), mask=later) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(doc[order], mask=~known[order]), pa.array(key[order]), pa.array(place[order].astype(np.int32)), *digest], ["doc_id", "text_key", "place", "a", "b"])

        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for at, _, raw, off in tb.chunks(batch.column(2)):
                start, text = split(raw, off)
                words, a, b = digests(raw, off, start)
                first = np.searchsorted(text, np.arange(len(off) - 1))
                full = np.flatnonzero(words)
                row = at + text[full]
                held.append((ids[row], known[row], keys[row], full - first[text[full]], a[full], b[full]))
                size += len(full)
                if size > flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def later_units(documents: DataFrame, flush: int = FLUSH) -> DataFrame:
    """(doc_id, text_key, goes): for each document with such, the places of its units that came earlier."""
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    found = written(rows.mapInArrow(_survey(flush), "doc_id long, text_key long, place int, a long, b long"), "units")
    order = Window.partitionBy("a", "b").orderBy("doc_id", "text_key", "place")
    judged = found.where("a is not null").dropDuplicates(["a", "b", "doc_id", "text_key", "place"]).withColumn("rank", F.row_number().over(order)).where("rank > 1")
    later = found.where("a is null").select("doc_id", "text_key", "place").unionByName(judged.select("doc_id", "text_key", "place"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("goes"))


def _edited(min_words: int):
    """Text and places of later units of each document, as (kept, n_units, removed)."""

    def of_one(part: np.ndarray, own: np.ndarray, goes: np.ndarray) -> tuple[str | None, list[dict]]:
        words, _, _ = digests(part, np.array([0, len(part)]), own)
        later = np.zeros(len(own) + 2, np.int8)
        later[goes + 1] = 1
        keep, gone, stop = np.ones(len(part), bool), [], np.append(own[1:], len(part))
        for x, y in np.flatnonzero(np.diff(later)).reshape(-1, 2).tolist():
            if words[x:y].sum() >= min_words:
                gone += range(x, y)
                keep[own[x] : stop[y - 1]] = False
        if not gone:
            return None, []
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        return part[keep].tobytes().decode(), [{"place": p, "start": int(chars[own[p]]), "end": int(chars[stop[p]])} for p in gone]

    def run(text: pa.Array, goes: pa.Array) -> pa.Array:
        units, kept, spans = np.zeros(len(text), np.int32), [], []
        for at, end, raw, off in tb.chunks(text):
            start, owner = split(raw, off)
            first = np.searchsorted(owner, np.arange(len(off)))
            units[at:end] = np.diff(first)
            for i in range(at, end):
                mark, lo, hi, own = goes[i].as_py(), off[i - at], off[i - at + 1], start[first[i - at] : first[i - at + 1]]
                rest, removed = of_one(raw[lo:hi], own - lo, np.array(mark)) if mark else (None, [])
                kept.append(text[i].as_py() if rest is None else rest)
                spans.append(removed)
        span = pa.struct({"place": pa.int32(), "start": pa.int64(), "end": pa.int64()})
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(units), pa.array(spans, pa.list_(span))], ["kept", "n_units", "removed"])

    # a filter on the result would otherwise run the function a second time, in workers of its own
    return F.arrow_udf(run, "struct<kept:string,n_units:int,removed:array<struct<place:int,start:long,end:long>>>").asNondeterministic()


def _found(documents: DataFrame, min_words: int, name: str) -> DataFrame:
    """``documents`` with a struct (kept, n_units, removed) of that name."""
    key, doc, text_key, goes = (unused(x, documents.columns) for x in ("key", "later_doc", "later_key", "goes"))
    later = later_units(documents).toDF(doc, text_key, goes)
    keyed = documents.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(later, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text_key)), "left")
    return joined.select(*(F.col(f"`{c}`") for c in documents.columns), _edited(min_words)("text", goes).alias(name))


def repeated_units(documents: DataFrame, min_words: int = 25) -> DataFrame:
    """``documents`` with ``kept_text``, ``n_units``, and ``removed``: place, start and end (characters) of each unit that goes.

    Where the table has a column of such a name, underscores are added to the new one's.
    """
    found = unused("found", documents.columns)
    out = [F.col(f"{found}.{x}").alias(unused(y, documents.columns)) for x, y in (("kept", "kept_text"), ("n_units", "n_units"), ("removed", "removed"))]
    return _found(documents, min_words, found).select(*(F.col(f"`{c}`") for c in documents.columns), *out)


def without_repeated_units(documents: DataFrame, min_words: int = 25) -> DataFrame:
    """``documents`` with what is left of each text, and without rows that had text and have none left; ``n_chars`` follows the text."""
    found = unused("found", documents.columns)
    kept, removed = F.col(f"{found}.kept"), F.size(f"{found}.removed") > 0
    rows = _found(documents, min_words, found).where(~removed | (F.trim(kept) != ""))
    new = {"text": kept, "n_chars": F.when(removed, F.length(kept)).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType) if "n_chars" in documents.columns else None}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in documents.columns))
