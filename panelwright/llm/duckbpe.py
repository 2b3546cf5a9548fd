"""Byte-level BPE, encoded and decoded by DuckDB queries inside each partition.

A partition's task keeps one in-memory database with two tables made from the rank file: ``vocab`` (token, its bytes in
hex) and ``merges`` (left, right, token), a row for each way in which a token falls into two tokens, as any two
neighbours whose bytes together are a token may be joined. Word forms that the task hasn't met yet become rows
(word, place, token), one for each byte, and a recursive query contracts them: every round joins neighbours with the
merge table, takes each word's smallest rank and contracts it, leftmost first, until no word has a pair left. Decoding
joins token rows with the vocabulary and aggregates their bytes in order of place.

In words of ``LONG`` bytes and more, equal pairs that don't overlap are contracted in one round, as far as that can't
differ from one after the other, so a word of n equal letters takes rounds in the number of ranks and not of letters. It
could differ only where a new token and a neighbour have a smaller rank than the token itself (``falling``).
Rounds are emitted as they are done, so memory holds one round's rows, of words of ``CHUNK`` bytes
together or of one longer word.

Defined cases: null and empty texts have no tokens and decode to no bytes; very long texts and words without end are
encoded whole; rows that repeat an id are encoded each; null ids are kept; special tokens' names are plain text; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of new words that one query contracts.
CHUNK = 1 << 19
#: Bytes from which a word counts as long.
LONG = 64
#: Bytes that a task spends on word forms it remembers, with what Python adds to each.
CACHE, ENTRY = 64 << 20, 220

#: A round contracts each word's leftmost pair of the smallest rank.
CONTRACT = """
WITH RECURSIVE state(word, place, token, ready) AS (
    SELECT word, place, token, false FROM fresh
    UNION ALL
    SELECT * FROM (
        WITH pair AS MATERIALIZED (
            SELECT word, place, token, lead(token) OVER w AS next_token, lead(word) OVER w AS next_word, lag(place) OVER w AS last_place
            FROM state WHERE NOT ready WINDOW w AS (ORDER BY place)),
        best AS (
            SELECT word, min(CAST(merges.token AS BIGINT) << 32 | place) AS pick
            FROM pair JOIN merges ON CAST(pair.token AS BIGINT) << 32 | next_token = both_tokens AND next_word = word GROUP BY word)
        SELECT pair.word, place, CASE WHEN place = pick & 4294967295 THEN CAST(pick >> 32 AS INTEGER) ELSE token END, pick IS NULL
        FROM pair LEFT JOIN best ON pair.word = best.word
        WHERE pick IS NULL OR last_place IS DISTINCT FROM pick & 4294967295))
SELECT word, place, token FROM state WHERE ready ORDER BY place
"""

#: The same for long words: a round contracts all pairs of the smallest rank that don't overlap, from the left, up to
#: the first whose new token has a still smaller rank together with a neighbour.
CONTRACT_LONG = """
WITH RECURSIVE state(word, place, token, ready) AS (
    SELECT word, place, token, false FROM fresh
    UNION ALL
    SELECT * FROM (
        WITH pair AS MATERIALIZED (
            SELECT word, place, token, lead(token) OVER w AS next_token, lead(word) OVER w AS next_word, lead(place) OVER w AS next_place,
                CASE WHEN lag(word) OVER w = word THEN lag(token) OVER w END AS last_token, CASE WHEN lead(word, 2) OVER w = word THEN lead(token, 2) OVER w END AS third_token
            FROM state WHERE NOT ready WINDOW w AS (ORDER BY place)),
        joined AS MATERIALIZED (
            SELECT word, place, next_place, last_token, third_token, merges.token AS made
            FROM pair JOIN merges ON CAST(pair.token AS BIGINT) << 32 | next_token = both_tokens AND next_word = word),
        least AS MATERIALIZED (SELECT word, min(made) AS made FROM joined GROUP BY word),
        chosen AS (
            SELECT joined.*, row_number() OVER w AS nth, coalesce(lag(next_place) OVER w = place, false) AS chained
            FROM joined JOIN least USING (word, made) WINDOW w AS (PARTITION BY joined.word ORDER BY place)),
        apart AS (
            SELECT * FROM (SELECT *, nth - max(CASE WHEN chained THEN 0 ELSE nth END) OVER (PARTITION BY word ORDER BY place) AS beyond FROM chosen) WHERE beyond % 2 = 0),
        judged AS (
            SELECT apart.*, coalesce(a.token < made, false) OR coalesce(b.token < made, false) OR coalesce(c.token < made, false) AS stops
            FROM apart LEFT JOIN falling a ON CAST(last_token AS BIGINT) << 32 | made = a.both_tokens LEFT JOIN falling b ON CAST(made AS BIGINT) << 32 | third_token = b.both_tokens
                LEFT JOIN falling c ON CAST(made AS BIGINT) << 32 | made = c.both_tokens),
        taken AS MATERIALIZED (
            SELECT place, next_place, made FROM (SELECT *, min(CASE WHEN stops THEN nth END) OVER (PARTITION BY word) AS stop FROM judged) WHERE nth <= coalesce(stop, nth))
        SELECT pair.word, pair.place, coalesce(taken.made, pair.token), least.word IS NULL
        FROM pair LEFT JOIN taken ON pair.place = taken.place LEFT JOIN taken AS gone ON pair.place = gone.next_place LEFT JOIN least ON pair.word = least.word
        WHERE gone.place IS NULL))
SELECT word, place, token FROM state WHERE ready ORDER BY place
"""

DECODE = "SELECT text, unhex(array_to_string(list(hex ORDER BY place), '')) AS bytes FROM tokens JOIN vocab USING (token) GROUP BY text"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(both_tokens, token, falls): each pair of tokens that together are one; ``falls`` where that one has a smaller rank than a part."""
    ways = [(ranks[a], ranks[b], t) for token, t in ranks.items() for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
    left, right, made = (np.array(x, np.int32) for x in zip(*ways, strict=True)) if ways else (np.zeros(0, np.int32),) * 3
    return pa.table({"both_tokens": left.astype(np.int64) << 32 | right, "token": made, "falls": made < np.maximum(left, right)})


class Codec:
    """The two tables of one rank file, and the word forms met so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        for name, table in (("merges", merge_table(self.ranks)), ("vocab", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "hex": [b.hex() for b in self.ranks]}))):
            self.db.register("source", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM source")
            self.db.unregister("source")
        self.db.execute("CREATE TABLE falling AS SELECT * FROM merges WHERE falls")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}
        self.spent = 0

    def contract(self, words: list[bytes], long: bool = False) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit numbers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        fresh = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "place": np.arange(len(raw), dtype=np.int32), "token": self.single[raw]})
        self.db.register("fresh", fresh)
        found = self.db.execute(CONTRACT_LONG if long else CONTRACT).fetchnumpy()
        self.db.unregister("fresh")
        ends = np.searchsorted(found["word"], np.arange(len(words) + 1)) * 4
        ids = found["token"].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def make_room(self) -> None:
        """Where too much is remembered, forget the later half: common forms are met early."""
        if self.spent > CACHE:
            for form in list(self.known)[len(self.known) // 2 :]:
                self.spent -= ENTRY + len(form.encode()) + len(self.known.pop(form))

    def learn(self, forms: set[str]) -> None:
        """Remember the ids of new word forms; a form that is a token itself is that token."""
        rest: dict[bool, list[bytes]] = {False: [], True: []}
        for form in forms:
            word = form.encode()
            if (token := self.ranks.get(word)) is not None:
                self.remember(word, token.to_bytes(4, "little"))
            else:
                rest[len(word) >= LONG].append(word)
        for long, words in rest.items():
            first, size = 0, 0
            for end, word in enumerate([*words, b""]):
                size += len(word)
                if end > first and (end == len(words) or size > CHUNK):
                    for w, ids in zip(words[first:end], self.contract(words[first:end], long), strict=True):
                        self.remember(w, ids)
                    first, size = end, len(word)

    def remember(self, word: bytes, ids: bytes) -> None:
        self.known[word.decode()] = ids
        self.spent += ENTRY + len(word) + len(ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.find(text or "") for text in texts]
        new = {form for forms in split for form in forms if form not in self.known}
        if new:
            self.make_room()
            new.update(form for forms in split for form in forms if form not in self.known)
            self.learn(new)
        return [b"".join(map(self.known.__getitem__, forms)) for forms in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        token = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        tokens = pa.table({"text": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "place": np.arange(len(token), dtype=np.int32), "token": token})
        self.db.register("tokens", tokens)
        found = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("tokens")
        return [found.get(k, b"") for k in range(len(ids))]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _coded(ranks: str | None, pattern: str | None, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(ranks or default_ranks(), pattern or default_pattern())

        def out(rows: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
            ids = known.encode([t for _, t in rows])
            columns = [pa.array([d for d, _ in rows], pa.int64()), pa.array(ids, pa.binary()), pa.array(known.decode(ids), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc, text.as_py()))
                size += len(held[-1][1] or "")
                if size >= chars:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    return run


def coded(documents: DataFrame, ranks: str | None = None, pattern: str | None = None, chars: int = 1 << 21) -> DataFrame:
    """(doc_id, ids, decoded): each text's token ids as little-endian 32-bit numbers, and the bytes they decode to.

    ``ranks`` is the path of a rank file that every executor has; ``pattern`` splits a text into words; tasks hold about
    ``chars`` characters of whole texts at a time.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_coded(ranks, pattern, chars), "doc_id long, ids binary, decoded binary")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
