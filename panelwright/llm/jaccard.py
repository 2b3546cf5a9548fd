"""N-gram Jaccard join by grouped prefixes.

Each document is its set of hashed word shingles. Under one order of all shingles, two sets whose Jaccard
similarity is at least t share one of their first ``n - ceil(t n) + 1`` elements, so joining these prefixes
meets every pair. The order puts shingles that many documents hold last (rarest of them first) and the rest by
hash; it only decides how much work is done, never which links are found.

Documents with the same prefix and size form one group, over the whole corpus; a task emits a prefix once for each
group it sees and the rows that several tasks emit for one group are one from then on. Group pairs are filtered by
size and by how many prefix elements they share; then groups are expanded and members verified on whole sets. That
runs in three steps, of which only the last decides what is not linked:

1. Guesses, a linear number: neighbours in size order among the rows of a prefix element, and its smallest set; and
   the members of a group with its smallest id.
2. For elements of more than ``hot`` sets that are still in several components, each set's closest one of another
   component, by sketches.
3. All pairs of sets in different components that can meet first at a prefix element, less those that sketches rule out.

Two sets of n and m elements need ``percent (n + m) / (100 + percent)`` common ones, so where they first meet both must
have that many left, this one included. A row of an element carries how many its set has left, which bounds the sizes
it can still be linked to there. Rows are dealt by element and band of sizes: into the bands of the smaller sets it
can meet, and into its own if it can meet larger ones. Frequent elements stand last in their order, so a passage that
many otherwise different texts share leaves no two rows that can meet at it, however many the texts are.

A sketch has one bit for each residue of the shingles' hashes, the parity of how many fall there. Two sets differ in
at least as many shingles as their sketches differ in bits, so what a sketch rules out is no link. Sketches are
compared inside the tasks and pairs leave a task only if their sketches allow a link. Rows that can meet no small row of
another component, by what they have left and by its sizes, are dropped before. Texts to verify are picked by a bitmap of bounded size. Rows of one element and band
that do not fit a block are dealt into pairs of blocks: the sets outside the largest component there, against
all, so no task holds more than two blocks and no pair within that component is looked at.

Shingles and sets are named by 64-bit and 128-bit hashes of their content. ``hot``, the sizes of blocks and bitmaps
and COMMON change the amount of work, never the links.

Defined cases: null or empty texts and texts without words have no shingles and are linked with nothing; with
fewer than k words the whole sequence is one shingle; equal sets are one node; rows that repeat an id are one
node that any of their texts may link; rows without an id are linked with nothing and have no component; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.components import components, merged
from panelwright.llm.shared import written

U = np.uint64
#: Shingles counted together before those above COMMON of the texts are reported.
FLUSH_SHINGLES = 1_000_000
COMMON = 1 / 2000
#: Rows of one prefix element that are dealt out together.
BLOCK = 4096
#: Bits of a sketch, least and most; and pairs whose sketches are compared at once.
SKETCH_BITS = (64, 8192)
PAIRS_AT_ONCE = 1 << 17
SIEVE_BITS = 1 << 26
#: Documents whose prefixes leave a task together.
ROWS_AT_ONCE = 1000
#: What changes from row to row of a document stands together, and so does what doesn't: shuffled rows are compressed in their order.
PREFIX_ROWS = {"part": pa.int32(), "token": pa.int64(), "place": pa.int64(), "group": pa.int64()}


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a column."""
    for first, end, raw, off in tb.chunks(column):
        h, _, owner = tb.words(raw, off, "space")
        counts = np.bincount(owner, minlength=end - first)
        g, at = tb.grams(h, k), 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(g[at : at + n - k + 1])
            else:
                yield tb.grams(h[at : at + n], n) if n else np.zeros(0, U)
            at += n


def set_name(s: np.ndarray) -> tuple[int, int]:
    a = int(np.add.reduce(tb.mix(s + U(0x51ED27)), dtype=np.uint64)) if len(s) else 0
    b = int(np.bitwise_xor.reduce(tb.mix(s + U(0xA5A5A5A5)))) if len(s) else 0
    return int(np.int64(np.uint64(a))), int(np.int64(np.uint64(b)))


def _survey(k: int):
    """Rows of kind 0: id, set name and size of each document, and a sketch where the task sees the set first; of kind 1: a shingle common in the rows counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sets_seen: set[tuple] = set()
        docs = size = 0

        def common() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            value, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= max(4, COMMON * docs)
            return value[keep].view(np.int64), n[keep].astype(np.int64)

        def rows(kind: int, *columns, sketches: list[bytes | None] | None = None) -> pa.RecordBatch:
            n = len(columns[0])
            shapes = pa.nulls(n, pa.binary()) if sketches is None else pa.array(sketches, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(c, pa.int64()) for c in columns), shapes], ["kind", "doc_id", "a", "b", "n", "sketch"])

        for batch in batches:
            names, sizes, sketches = [], [], []
            for doc_id, s in zip(batch.column(0), shingle_sets(batch.column(1), k), strict=True):
                name = set_name(s)
                names.append(name)
                sizes.append(len(s))
                new = len(s) > 0 and doc_id.is_valid and (*name, len(s)) not in sets_seen
                sketches.append(sketch(s) if new else None)
                if new:
                    sets_seen.add((*name, len(s)))
                held.append(s)
                docs += 1
                size += len(s)
                if size > FLUSH_SHINGLES:
                    value, n = common()
                    yield rows(1, np.zeros(len(value), np.int64), value, np.zeros(len(value), np.int64), n)
                    held, docs, size = [], 0, 0
            yield rows(0, batch.column(0), [x for x, _ in names], [x for _, x in names], sizes, sketches=sketches)
        value, n = common()
        yield rows(1, np.zeros(len(value), np.int64), value, np.zeros(len(value), np.int64), n)

    return run


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements at each residue of their hashes; wide enough for sets of up to a quarter of SKETCH_BITS[1]."""
    least, most = SKETCH_BITS
    bits = min(max(1 << int(2 * len(s) - 1).bit_length(), least), most)
    at = (tb.mix(s + U(0x2545F491)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _prefixes(k: int, percent: int, common):
    """Prefix elements (part, token, place, group) of the first document of each group in a task.

    place is the set's size times 2^32, plus the elements before this one. A row of part -1 states instead that the
    document ``token`` is in the group. part is 0 but for common shingles, whose rows are dealt into parts of about
    BLOCK rows from 1 on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = common.value
        sets_seen: set[tuple] = set()
        groups: set[int] = set()
        for part in (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
            prefixes: list[tuple] = []
            members: list[tuple] = []
            for doc_id, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), k), strict=True):
                n = len(s)
                if not n or (name := (*set_name(s), n)) in sets_seen:
                    continue
                sets_seen.add(name)
                key, dealt = s >> U(7), np.zeros(n, np.int64)
                listed = np.zeros(n, bool)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    listed = known[at] == s
                    key = np.where(listed, U(1 << 63) | (level[at] << U(57)) | key, key)
                first = np.argsort(key, kind="stable")[: n - -(-percent * n // 100) + 1]
                prefix = s[first]
                group = set_name(prefix + U(n))[0]
                members.append((-1, doc_id, n << 32, group))
                if group in groups:
                    continue
                groups.add(group)
                if listed.any():
                    dealt[listed] = 1 + ((group >> 20) & ((1 << np.maximum(level[at[listed]].astype(np.int64) - BLOCK.bit_length() + 1, 0)) - 1))
                prefixes.append((dealt[first], prefix.view(np.int64), (n << 32) + np.arange(len(prefix)), np.full(len(prefix), group)))
            for rows, columns in ((len(members), list(zip(*members, strict=True))), (sum(len(x[0]) for x in prefixes), [np.concatenate(x) for x in zip(*prefixes, strict=True)])):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, PREFIX_ROWS.values(), strict=True)], list(PREFIX_ROWS))

    return run


def sieve(ids: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids and the logarithm of its bits: what it leaves out is none of the ids.

    At most SIEVE_BITS bits, whatever the number of ids; where they are many more, it lets most others through.
    """
    power = min(max(math.ceil(math.log2(16 * ids.count() + 1)), 16), SIEVE_BITS.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(1 << power - 3, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.bitwise_or.at(mine, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = mine.view(np.int64)
        there = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(words[there])], ["at", "word"])

    found = ids.select(hashed(column, power)).mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << power - 6, np.int64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return out.view(np.uint8), power


def hashed(column: str, power: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(column), 64 - power)


def _compressed(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.column(2).to_numpy()
            some = batch.filter(pa.array(broadcast.value[at >> 3] >> (at & 7) & 1 > 0))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([pack.compress((t.as_py() or "").encode()) for t in some.column(1)], pa.binary())], ["doc_id", "packed"])

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last: dict[bytes, np.ndarray] = {}

        def of(packed: bytes) -> np.ndarray:
            if (s := last.get(packed)) is None:
                if len(last) > 64:
                    last.clear()
                s = last[packed] = next(shingle_sets(pa.array([unpack.decompress(packed)], pa.large_binary()), k))
            return s

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = of(x.as_py()), of(y.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def verified(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets are similar; each side's text travels compressed, for the documents in a pair only."""
    pairs = written(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bits, power = sieve(needed, "doc_id")
    pack = _compressed(documents.sparkSession.sparkContext.broadcast(bits))
    texts = documents.where("doc_id is not null").select("doc_id", "text", hashed("doc_id", power)).mapInArrow(pack, "doc_id long, packed binary")
    texts = written(texts, "texts")
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verified(k, percent), "a long, b long").distinct()


def _close(percent: int, closest: bool):
    """Pairs (a, b) of nodes in different components that can meet first at this element and whose sketches allow a link, from rows sorted by block.

    Each row that asks (role 1) meets each row that is told (role 2; both are 3) of its block, but no two rows meet that
    can both only be the larger set of a pair (without role 4). closest: of each row's partners only the one whose
    sketch differs least.
    """

    def met(asks: np.ndarray, told: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each of ``asks`` with each of ``told`` of its group, PAIRS_AT_ONCE at a time."""
        first = np.searchsorted(group[told], np.arange(group[-1] + 2))
        partners = np.diff(first)[group[asks]]
        ends = np.cumsum(partners)
        at = 0
        while at < len(asks):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            many = partners[at:to]
            x = np.repeat(asks[at:to], many)
            yield x, told[np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[group[asks[at:to]]], many)]
            at = to

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        token, block, node, component, n, left, role = (batch.column(c).to_numpy() for c in ("token", "block", "node", "component", "n", "left", "role"))
        new = np.ones(len(node), bool)
        new[1:] = (token[1:] != token[:-1]) | (block[1:] != block[:-1])
        fresh = new.copy()
        fresh[1:] |= node[1:] != node[:-1]  # a node stands for many documents; its row counts once
        group = np.cumsum(new) - 1
        raw, off = tb.text_buffer(batch.column("sketch"))
        width = np.diff(off)
        small = role & 4 > 0
        asks, told = fresh & (role & 1 > 0), fresh & (role & 2 > 0)
        for mine, theirs in ((asks & small, told), (asks & ~small, told & small)):
            for x, y in met(np.flatnonzero(mine), np.flatnonzero(theirs), group):
                least, total = np.minimum(n[x], n[y]), n[x] + n[y]
                need = -(-percent * total // (100 + percent))
                keep = (component[x] != component[y]) & (least * 100 >= (total - least) * percent) & (np.minimum(left[x], left[y]) >= need)
                if not closest:
                    keep &= (role[y] & 1 == 0) | (node[x] < node[y])
                x, y, total = x[keep], y[keep], total[keep]
                differ = differing(raw, off, width, x, y)
                near = np.flatnonzero(differ <= total - 2 * need[keep])
                if closest and len(near):
                    near = near[np.lexsort((differ[near] / total[near], x[near]))]
                    near = near[np.concatenate([[True], x[near[1:]] != x[near[:-1]]])]
                a, b = node[x[near]], node[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token, block = batch.column("token").to_numpy(), batch.column("block").to_numpy()
            before = np.flatnonzero((token != token[-1]) | (block != block[-1]))
            cut = before[-1] + 1 if len(before) else 0  # the last block goes on in the next batch
            same = held and (held[-1].column("token")[0].as_py(), held[-1].column("block")[0].as_py()) == (token[-1], block[-1])
            if not cut and (same or not held):
                held.append(batch)
                continue
            yield from rows_of(pa.concat_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from rows_of(pa.concat_batches(held))

    return run


def differing(raw: np.ndarray, off: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of rows x and y differ, the wider one folded to the other's size."""
    differ = np.zeros(len(x), np.int64)
    narrow = np.minimum(width[x], width[y])
    for w in np.unique(narrow[narrow > 0]).tolist():
        some = np.flatnonzero(narrow == w)
        sides = []
        for side in (x[some], y[some]):
            own, back = np.unique(side, return_inverse=True)
            folded = np.zeros((len(own), w), np.uint8)
            for half in range(int(width[own].max()) // w):
                has = width[own] > half * w
                folded[has] ^= raw[off[own[has], None] + half * w + np.arange(w)]
            sides.append((folded.view(U), back))
        (p, i), (q, j) = sides
        step = max(1, PAIRS_AT_ONCE * 32 // w)
        for a in range(0, len(some), step):
            differ[some[a : a + step]] = np.bitwise_count(p[i[a : a + step]] ^ q[j[a : a + step]]).sum(axis=1)
    return differ


def likely(n: Column, m: Column, shared: Column, percent: int, first: Column | None = None) -> Column:
    """Whether sets of sizes n <= m that share so many prefix elements can be similar.

    What is not counted lies behind the prefix that ends first, that of the set of size ``first`` (by default the larger, which leaves most room).
    """
    need = F.ceil(percent * (n + m) / (100 + percent) - 1e-9)
    return (n * 100 >= m * percent) & (shared + F.ceil((m if first is None else first) * percent / 100 - 1e-9) - 1 >= need)


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 75, hot: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links, for every row of ``documents``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = written(docs.mapInArrow(_survey(k), "kind int, doc_id long, a long, b long, n long, sketch binary"), "survey")
    sets = survey.where("kind = 0")
    broadcast = docs.sparkSession.sparkContext.broadcast(_common(survey))

    # one node for equal sets: the smallest id
    linked = sets.where("n > 0 and doc_id is not null")
    named = linked.groupBy("a", "b", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = linked.join(named.where("first != last"), ["a", "b", "n"]).select("doc_id", F.col("first").alias("rep")).where("doc_id != rep")
    copies = written(copies.distinct(), "copies")

    rows = docs.where("doc_id is not null").mapInArrow(_prefixes(k, percent, broadcast), "part int, token long, place long, group long")
    rows = rows.repartition("token", "part")  # before the windows' own columns are computed, which would be shuffled else
    n = F.shiftright("place", 32).cast("int")
    in_order = Window.partitionBy("token", "part").orderBy(n, "group")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.select(
        *("token", "part", "group", n.alias("n"), (n - F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("left")),
        F.lag(F.struct("group", n.alias("n"))).over(in_order).alias("near"),
        F.lead("group").over(in_order).alias("next"),
        F.first(F.struct("group", n.alias("n"))).over(so_far).alias("smallest"),
    ).where("near is not null or next is not null or part != 0")
    other = met.where((F.col("part") < 0) | ~F.col("near.group").eqNullSafe(F.col("group")))  # one row for each group
    smallest = F.when(F.col("smallest.group") != F.col("near.group"), F.col("smallest"))
    met = written(other.select("token", "n", "group", F.when(F.col("part") >= 0, F.col("left")).alias("left"), "near", smallest.alias("smallest")), "met")

    member = met.where("left is null").select(F.col("token").alias("doc_id"), "group", "n")
    comps = components(verified(_of_reps(_guesses(met, member, percent), copies), docs, k, percent))

    shapes = sets.where("sketch is not null").select("doc_id", "sketch").join(copies, "doc_id", "left").select(F.coalesce("rep", "doc_id").alias("node"), "sketch", F.xxhash64("sketch").alias("name"))
    shapes = shapes.groupBy("node").agg(F.first("sketch").alias("sketch"), F.min("name").alias("least"), F.max("name").alias("most"))
    # an id with several texts has no sketch of its own: an empty one rules nothing out
    shape = written(shapes.select("node", F.when(F.col("least") == F.col("most"), F.col("sketch")).otherwise(F.lit(b"")).alias("sketch")), "nodes")
    nodes = member.join(copies, "doc_id", "left").select("group", F.coalesce("rep", "doc_id").alias("node"), "n").distinct()
    nodes = nodes.join(comps, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
    places = met.where("left is not null").select("token", "group", "n", "left")
    pure = nodes.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = places.join(pure, "group").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("token")
    live = _cells(places.join(several, "token", "left_semi").join(nodes, "group"), percent)
    live = written(_mixed(live, percent), "live")

    best = _pairs_by_sketch(live.where(F.col("c") > hot), shape, percent, closest=True).distinct()
    comps = merged(comps, verified(best, docs, k, percent))
    now = comps.select(F.col("node").alias("component"), F.col("component").alias("now"))
    live = live.join(now, "component", "left").select("token", "node", "n", "left", "small", F.coalesce("now", "component").alias("component"))
    rest = _pairs_by_sketch(_mixed(live, percent), shape, percent, closest=False).distinct()
    settled = merged(comps, verified(rest, docs, k, percent))

    label = sets.select("doc_id", "n").join(copies, "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node"))
    return label.join(settled, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``documents``, all columns, that stand for their component: those with its smallest id.

    Of rows that repeat both id and text one stays; rows that repeat an id with other texts stay, as do rows without an id.
    """
    keep = near_duplicates(documents, k, percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = documents.where("doc_id is not null").join(keep, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in documents.columns))
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(documents.where("doc_id is null"))


def _common(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least COMMON / 2 of all documents hold, in order, and the doubling of their counts.

    At most 2 / COMMON times the mean set size: a shingle is listed only if so large a share of all documents holds it.
    """
    floor = max(4, math.floor(survey.where("kind = 0").count() * COMMON / 2))
    found = survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()
    value, count = found.column("a").to_numpy().view(np.uint64), found.column("n").to_numpy().astype(np.float64)
    order = np.argsort(value)
    return value[order], np.log2(np.maximum(count[order], 1)).astype(np.uint64)


def _guesses(met: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of likely links, of the smallest ids of two groups; and those of a group's members with its smallest id."""
    row = met.where("left is not null")
    pairs = row.select(F.explode(F.array("near", "smallest")).alias("x"), F.col("group").alias("y"), F.col("n").alias("m")).where("x is not null")
    pairs = pairs.select(F.col("x.group").alias("x"), "y", F.col("x.n").alias("n"), "m").where((F.col("x") != F.col("y")) & (F.col("n") * 100 >= F.col("m") * percent))
    counted = pairs.groupBy("x", "y", "n", "m").agg(F.count("*").alias("shared")).where(likely(F.col("n"), F.col("m"), F.col("shared"), percent)).select("x", "y")
    first = member.groupBy("group").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"))
    ends = first.select(F.col("group").alias("x"), "a"), first.select(F.col("group").alias("y"), F.col("a").alias("b"))
    across = counted.join(ends[0], "x").join(ends[1], "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b")
    group = member.join(first.where("a != last"), "group").where("a != doc_id").select("a", F.col("doc_id").alias("b"))
    return across.unionByName(group).distinct()


def _of_reps(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs of documents as pairs of the nodes that stand for them."""
    a = pairs.join(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a", "left")
    b = a.join(copies.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b", "left")
    x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    return b.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a != b").distinct()


def _cells(places: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, n, left, small, component), one for each band of sizes that a row of an element can meet; ``token`` then names element and band.

    Of two sets that meet, the larger is in the band of the smaller: in all bands from the least size it can be linked
    to up to the largest that what it has left allows. ``small`` marks a row in its own band that can meet larger sets.
    """
    n, left = F.col("n"), F.col("left").cast("long")
    most = F.floor(left * (100 + percent) / F.lit(float(percent)) + 1e-9) - n
    band = lambda size: F.floor(F.log(size.cast("double")) * F.lit(2 / math.log(100 / percent)))
    low, top = F.ceil(n * percent / 100 - 1e-9), F.least(n.cast("long"), most)
    met = places.where(top >= low).withColumn("band", F.explode(F.sequence(band(low), band(top)))).withColumn("small", (most >= n) & (F.col("band") == band(n)))
    return met.select(F.xxhash64("token", "band").alias("token"), "node", "n", "left", "small", "component")


def _mixed(live: DataFrame, percent: int) -> DataFrame:
    """The rows of ``live`` that can meet another one of their token, with the token's rows ``c``, its largest component ``major`` and the rows ``s`` outside it.

    Of two rows that meet, the smaller is a small row of another component. A row goes if even the smallest, the largest
    or the fullest small row of its token leaves it too few common elements, whatever their components are.
    """
    whole, own = Window.partitionBy("token"), Window.partitionBy("token", "component")
    few = F.when(F.col("small"), 1)
    rows = live.select("token", "node", "n", "left", "small", "component").repartition("token")  # one exchange for all windows
    rows = rows.withColumn("own", F.count(F.lit(1)).over(own)).withColumn("own_few", F.count(few).over(own))
    rows = rows.withColumns({"c": F.count(F.lit(1)).over(whole), "few": F.count(few).over(whole), "most": F.max(F.struct("own", "component")).over(whole)})
    rows = rows.withColumns({name: f(F.when(F.col("small"), F.col(c))).over(whole) for name, f, c in (("least", F.min, "n"), ("largest", F.max, "n"), ("fullest", F.max, "left"))})
    n, need = F.col("n"), F.ceil(percent * (F.col("n") + F.col("least")) / F.lit(100.0 + percent) - 1e-9)
    larger = (F.col("few") > F.col("own_few")) & (F.col("largest") * 100 >= n * percent) & (F.least(F.col("left"), F.col("fullest")) >= need)
    kept = rows.where((F.col("c") > F.col("most.own")) & (F.col("small") | larger))
    return kept.select("token", "node", "n", "left", "small", "component", "c", F.col("most.component").alias("major"), (F.col("c") - F.col("most.own")).alias("s"))


def _pairs_by_sketch(live: DataFrame, shape: DataFrame, percent: int, closest: bool) -> DataFrame:
    """(a, b) once for every token at which the two can meet, see ``_close``.

    Rows outside the largest component ask, dealt into ``asked`` blocks; all rows are told, dealt into ``told`` blocks.
    """
    asked, told = (F.ceil(F.col(x) / F.lit(float(BLOCK))).cast("int") for x in ("s", "c"))
    deal = F.xxhash64("node")
    mine, own = F.pmod(deal, asked).cast("int"), F.pmod(F.shiftright(deal, 20), told).cast("int")
    asks = F.col("component") != F.col("major")
    bit = F.col("small").cast("int") * 4
    cell = lambda i, j, role: F.struct((i.cast("long") * told + j).alias("block"), (role + bit).cast("int").alias("role"))
    both = F.transform(F.sequence(F.lit(0), asked - 1), lambda i: cell(i, own, F.when(asks & (i == mine), F.lit(3)).otherwise(F.lit(2))))
    others = F.filter(F.sequence(F.lit(0), told - 1), lambda j: asks & (j != own))
    cells = F.concat(both, F.transform(others, lambda j: cell(mine, j, F.lit(1))))
    row = ("node", "component", "n", "left")
    placed = live.select("token", *row, F.explode(cells).alias("cell")).select("token", "cell.block", *row, "cell.role")
    ready = placed.join(shape, "node").select("token", "block", *row, "role", "sketch")
    ready = ready.repartition("token", "block").sortWithinPartitions("token", "block", "node")
    return ready.mapInArrow(_close(percent, closest), "a long, b long")
