"""Byte-level BPE, periodic runs and the Merkle manifest against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from panelwright.llm import duckbpe, merkle, periodic
from panelwright.llm.oracles import ORACLE_SQL
from panelwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, ids string, runs int, place long, tree string, leaf string, n int, `a.b` int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(7)
    texts = [None, None, "", "", " \n\t ", "same words here", "same words here", "É A", "a" * 30_000, "x y " * 5_000, "ab " * 40]
    texts += [" ".join(r.choice(["tie", "tIE", "the", "of", "ß"]) for _ in range(r.randint(1, 90))) for _ in range(60)]
    rows = [(i if i % 9 else None, t, [None, "en", "de", f"l{i}"][i % 4], "s" if i % 5 else None, len(t or "") if i % 7 else None, "x", 1, 2, "t", "l", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (3, "other text under one id", "en", "s", 1, "x", 1, 2, "t", "l", 3, 4)]
    return spark.createDataFrame(rows, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], ODD)


# byte-level BPE


@pytest.fixture(scope="module")
def plain_bpe():
    import tiktoken

    ranks = duckbpe.read_ranks(duckbpe.default_ranks())
    return tiktoken.Encoding("own", pat_str=duckbpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def code(encoding, text):
    return np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()


def test_bpe_equals_the_library(odd, nothing, plain_bpe):
    got = duckbpe.coded(odd, chars=2_000).collect()
    want = [(r.doc_id, code(plain_bpe, r.text), (r.text or "").encode()) for r in odd.collect()]
    assert ordered((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == ordered(want)
    assert duckbpe.coded(nothing).collect() == []


def test_bpe_query_equals_the_library(spark, plain_bpe):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for d in docs:
        ids = code(plain_bpe, d.text)
        want.append((d.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), sha(d.text or "")))
    assert sorted(tuple(r) for r in QUERIES["op11_byte_bpe"](spark, SF).collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(4))
def test_bpe_of_long_and_strange_words(plain_bpe, seed):
    r = random.Random(seed)
    codec = duckbpe.codec(duckbpe.default_ranks(), duckbpe.default_pattern())
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéñ .,'\n\t0123456789　 漢字😀\x1c\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(40)]
    texts += ["".join(r.choice(["sch", "ing", "ab", "a", "中国", "the"]) for _ in range(300)) for _ in range(5)]
    texts += ["<|endoftext|>", "I'm  we'LL ", "a" * 999, "ab" * 2_000, "".join(r.choice("abc") for _ in range(900))]
    ids = codec.encode(texts)
    assert ids == [code(plain_bpe, t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_bpe_with_falling_ranks():
    """Where a token's neighbour makes a smaller rank, that one comes before the next equal pair; both queries agree with a plain loop."""
    r = random.Random(2)
    ranks = {bytes([b]): 1000 + b for b in range(256)}
    tokens = [b"ab", b"abc", b"bc", b"cab", b"abab", b"aba", b"aa", b"aab", b"ca", b"bca"]

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
            if not pairs:
                return np.array([ranks[p] for p in parts], "<u4").tobytes()
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    import tempfile
    from base64 import b64encode

    for _ in range(6):
        order = r.sample(range(len(tokens)), len(tokens))
        ranks = {k: v for k, v in ranks.items() if len(k) == 1} | {t: o for t, o in zip(tokens, order)}
        with tempfile.NamedTemporaryFile("w", suffix=".ranks") as f:
            f.write("\n".join(f"{b64encode(k).decode()} {v}" for k, v in ranks.items()))
            f.flush()
            codec = duckbpe.Codec(f.name, r"\p{L}+|[^\p{L}]+")
        words = ["".join(r.choice("abc") for _ in range(r.randint(2, 60))).encode() for _ in range(60)]
        want = [plain(w) for w in words]
        assert codec.contract(words) == want and codec.contract(words, long=True) == want


def test_bpe_forgets_and_learns_again(plain_bpe, monkeypatch):
    monkeypatch.setattr(duckbpe, "CACHE", 2_000)
    codec = duckbpe.Codec(duckbpe.default_ranks(), duckbpe.default_pattern())
    for k in range(30):
        text = f"unlikelyword{k % 4}x anotherword{k}"
        assert codec.encode([text]) == [code(plain_bpe, text)]
        assert codec.spent < 6_000


# periodic runs


def plain_runs(words, least, periods):
    n, out = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, periods * q):
                out.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def test_lyndon_lengths():
    r = random.Random(3)
    for _ in range(400):
        x = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 30))]
        want = []
        for i in range(len(x)):
            j = i + 1
            while j < len(x) and x[j:] > x[i:]:
                j += 1
            want.append(j - i)
        assert periodic.lyndon_lengths(np.array(x, np.int64)) == want


@pytest.mark.parametrize("least,periods", [(24, 3), (6, 3), (2, 2)])
def test_runs_of_repetitive_words(spark, least, periods):
    r = random.Random(least)
    rows = []
    for i in range(150):
        words = []
        for _ in range(r.randint(0, 4)):
            unit = [r.choice("abcdAB"[: r.choice([2, 4, 6])]) for _ in range(r.randint(1, 7))]
            words += unit * r.randint(1, 9) + unit[: r.randrange(len(unit) + 1)]
        rows.append((i, " ".join(words)))
    got = {x.doc_id: x for x in periodic.repetitions(spark.createDataFrame(rows, "doc_id long, text string"), least, periods).collect()}
    some = 0
    for i, text in rows:
        words = text.split()
        want = plain_runs(words, least, periods)
        some += len(want)
        assert [tuple(x) for x in got[i].runs] == want and got[i].n_words == len(words)
        gone = {k for s, length, q in want for k in range(s + q, s + length)}
        assert got[i].kept_text == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert some > 20


def plain_periodic(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None,) * 3
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), hashlib.sha256(kept).hexdigest())


def test_runs_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 20_000]
    short = odd.where("text is null or length(text) < 20000")
    assert ordered(tuple(r) for r in periodic.digests(periodic.repetitions(periodic.planted(short))).collect()) == ordered(plain_periodic(*r) for r in rows)
    assert periodic.digests(periodic.repetitions(periodic.planted(nothing))).collect() == []
    long = periodic.repetitions(odd.where("text like 'x y %'")).first()
    assert [tuple(x) for x in long.runs] == [(0, 10_000, 2)] and long.kept_text == "x y"
    kept = {r.kept_text for r in periodic.repetitions(odd.where("text is null or trim(text) = ''")).collect()}
    assert kept == {None, ""}


# manifest


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = {c: c + 32 for c in range(65, 91)}
    trees = {}
    for r in rows:
        head = "".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars"))
        leaf, spoilt = sha(head, field(r["text"])), None
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            spoilt = sha(head, field(r["text"] and r["text"].translate(lower)))
        trees.setdefault(r["lang"], []).append((r["doc_id"], leaf, spoilt or leaf))

    def build(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
            levels.append(nodes)
        return levels

    def way(levels, i):
        for nodes in levels[:-1]:
            a = i // 8 * 8
            yield "".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])
            i //= 8

    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for t in names:
        trees[t].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[t] = build([leaf for _, leaf, _ in trees[t]])
    top = build([built[t][-1][0] for t in names]) if names else []
    for k, t in enumerate(names):
        for i, (doc, leaf, digest) in enumerate(trees[t]):
            path = [*way(built[t], i), *way(top, k)]
            for left, right in path:
                digest = sha(left, digest, right)
            yield doc, leaf, built[t][-1][0], top[-1][0], sha(*(a + b for a, b in path)), digest, digest == top[-1][0]


def test_manifest_of_odd_rows(odd, nothing):
    got = [tuple(r) for r in merkle.digests(merkle.manifest(odd)).collect()]
    want = list(plain_manifest(odd.collect()))
    assert ordered(got) == ordered(want) and len({r.lang for r in odd.collect()}) > 8
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.digests(merkle.manifest(nothing)).collect() == []


def test_manifest_of_one_row_and_of_identical_rows(spark):
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(1, "s", "en", 3, "aBc")], columns)
    row = merkle.digests(merkle.manifest(one)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha()
    same = spark.createDataFrame([(1, "s", "en", 3, "aBc")] * 20, columns)
    assert ordered(tuple(r) for r in merkle.digests(merkle.manifest(same)).collect()) == ordered(plain_manifest(same.collect()))


@pytest.mark.parametrize("name", ["op12_periodic_runs", "op13_merkle_manifest"])
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert ordered(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()) == ordered(found.fetchall())
