"""Each operator against a plain version, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from panelwright.llm import brownlm, components, decontaminate, jaccard, jpegmedia, linededup, pack, quality, suffixdedup, textbytes, tokencount, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token long, n int, rep long, component long, rank int, h long, label int, g string"


def corpus(seed=5):
    r = random.Random(seed)
    stems = ["the", "of", "an", "Thé", "ing", "ß", "on", "re", "ed", "at", "to", "is", "era", "NTI", "hea", "wha", "dou", "sti", "'s", "12", "x|y"]
    word = lambda: "".join(r.choice(stems) for _ in range(r.randint(1, 3)))
    text = lambda n: "".join(word() + r.choice([" ", " ", " ", ". ", "\n", "  "]) for _ in range(n))
    texts = [text(r.choice([1, 4, 5, 9, 30, 80, 150])) for _ in range(40)]
    passage = text(60)
    base = text(120).split(" ")
    for k in range(12):  # near copies with a few words changed
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[3], passage + text(30), text(25) + "\n" + passage + "\n" + text(4), text(6) + passage]
    texts += ["", None, " \n\t ", "a", "a" * 20_000, "tie tie tie tie tie tie", "one two three", "one two three", text(9_000)]
    return [(10 * i + 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None, 7, 1, 2, 3, 4, 5, 1, "x") for d, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without an id, and rows that repeat one."""
    t = "some words that are long enough to be looked at by every operator there is, and again and again until a hundred bytes are full"
    return spark.createDataFrame([(None, t), (None, None), (1, t), (1, t), (1, "another text"), (2, t)], "doc_id long, text string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def items_of(rows):
    words = " ".join(t for _, t in rows if t).split()
    return [(1, " ".join(words[40:60])), (2, " ".join(words[300:310])), (3, "one two three"), (4, None), (5, ""), (6, "tie"), (6, "tie"), (7, " ".join(words[500:540]).upper())]


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_contamination(spark, docs, rows, block_words):
    items = items_of(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(rows, [x for x in items if x[1]]))
    assert got(decontaminate.contamination(docs, bench, block_words=block_words)) == want
    kept = decontaminate.without_contaminated(docs, bench, block_words=block_words)
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[5]] and kept.columns == docs.columns


def test_contamination_without_items(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(docs, none).collect()} == {False}
    assert decontaminate.contamination(nothing, none).count() == 0


def test_window_minima_keep_shared_spans():
    r = np.random.default_rng(0)
    g = r.integers(0, 50, 400).astype(np.uint64)
    at = set(textbytes.window_minima(g, 6).tolist())
    for k in range(len(g) - 5):
        w = g[k : k + 6]
        assert any(k + i in at for i in np.flatnonzero(w == w.min()))


def packing_holds(out, want, capacity):
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(docs, rows):
    for capacity in (4096, 300):
        out = pack.packed(docs, capacity).collect()
        n = packing_holds(out, brute.token_pieces(rows, capacity), capacity)
        assert n <= -(-sum(r.length for r in out) // capacity) + 1


def test_packing_nothing(nothing, odd):
    assert pack.packed(nothing).count() == 0
    assert pack.packed(odd).count() == 6


def test_plan_exchanges_the_smallest_for_two():
    # 60 + 30 leave a gap of 10; 30 goes for 22 and 18, which fill the bin
    runs = pack.plan({60: 1, 30: 1, 22: 1, 18: 1}, 100)
    first = sorted(n for n, _, m, s, _ in runs if s == 0)
    assert first == [18, 22, 60]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_all(seed):
    r = np.random.default_rng(seed)
    lengths, counts = np.unique(r.integers(1, 120, 400), return_counts=True)
    runs = pack.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 128)
    bins: dict = {}
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        mine = sorted(x for x in runs if x[0] == n)
        for rank in range(c):
            _, first, m, s, o = [x for x in mine if x[1] <= rank][-1]
            bins.setdefault(s + (rank - first) // m, []).append((o + (rank - first) % m * n, n))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 128
    plain: list[int] = []  # best fit of the lengths in falling order
    for n in sorted(np.repeat(lengths, counts).tolist(), reverse=True):
        fits = [i for i, room in enumerate(plain) if room >= n]
        if fits:
            i = min(fits, key=plain.__getitem__)
            plain[i] -= n
        else:
            plain.append(128 - n)
    assert len(bins) <= len(plain) * 1.02 + 1


def test_fast_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pack.default_vocabulary())
    e = pack.encoder(pack.default_vocabulary())
    for text in ["It's  the Ünïté, don't!\n1.5² ½ª", "<|endoftext|> x", "汉字 é İ", "''s 'll'd''", "a\x85b\x1cc", "ſẞŉ ÀÉ_x-y#$%"]:
        assert e(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("hot", [4096, 2])
def test_long_repeats(docs, rows, hot):
    assert got(suffixdedup.without_repeats(docs, 100, hot)) == sorted(brute.long_repeats(rows))


def test_long_repeats_of_odd_rows(odd, nothing):
    out = suffixdedup.without_repeats(odd, 100).collect()
    assert len(out) == 6 and suffixdedup.without_repeats(nothing).count() == 0
    # the row without an id comes first and keeps all; later ones lose all
    assert {(r.doc_id, r.n_removed > 0) for r in out if r.n_bytes > 100} == {(None, False), (1, True), (2, True)}


def test_texts_without_an_id_are_told_apart(spark):
    """Two rows without an id whose crc32 agrees in 24 bits; the same under one id."""
    seen: dict = {}
    for i in range(200_000):
        t = f"{i:0100d}" + "x"
        a, b = seen.setdefault(zlib.crc32(t.encode()) & 0xFFFFFF, t), t
        if a != b:
            break
    r = random.Random(1)
    fill = lambda: "".join(r.choice("abcdefghij ") for _ in range(150))
    shared = fill()
    rows = [(None, shared + a), (None, fill() + fill()), (None, b), (5, shared + b), (7, fill()), (7, fill() + shared)]
    out = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixdedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()}
    assert out[None, 300] == 0 and out[7, 150] == 0 and out[7, 300] >= 150 and out[5, 251] >= 150


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_are_common_prefixes(seed):
    r = np.random.default_rng(seed)
    text = np.append(r.integers(1, 4, 300), 0).astype(np.uint8)
    order = suffixdedup.sorted_suffixes(text, 16)
    fixed = suffixdedup.boundaries(text, order, 12)
    raw = text.tobytes() + bytes(64)
    for i in range(1, len(text)):
        a, b = (raw[order[j] : order[j] + 12] for j in (i - 1, i))
        assert fixed[i] == (a != b)


def test_jaccard(docs, rows):
    want = sorted(brute.shingle_components(rows))
    assert got(jaccard.near_duplicates(docs)) == want
    kept = jaccard.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want}) and kept.columns == docs.columns


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_of_many_near_copies(spark, seed):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(60)] = f"x{r.randrange(40)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jaccard.near_duplicates(df)) == sorted(brute.shingle_components(rows))


def test_jaccard_of_odd_rows(odd, nothing):
    out = jaccard.near_duplicates(odd).collect()
    assert len(out) == 6 and {r.component_id for r in out if r.doc_id} == {1}
    assert jaccard.near_duplicates(nothing).count() == 0
    # of rows that repeat id and text one stays, another text of the same id stays too
    assert sorted(r.text for r in jaccard.one_of_each(odd).where("doc_id = 1").collect()) == sorted({r.text for r in odd.collect() if r.doc_id == 1})
    assert jaccard.one_of_each(odd).where("doc_id = 2").count() == 0


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_prefix_rows_are_dealt_without_the_windows_own_columns(docs, monkeypatch):
    plans, write = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: (plans.setdefault(name, plan_of(df)), write(df, name))[1])
    jaccard.near_duplicates(docs)
    assert re.findall(r"\(\d+\) Exchange\s+Input \[(\d+)\]", plans["met"])[-1] == "4"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 50), (50, 199)]
    out = dict(got(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100 and out[200] == 50 and out[199] == 50


@pytest.mark.parametrize("min_words", [1, 25])
def test_units(docs, rows, nothing, odd, min_words):
    out = linededup.repeated_units(docs, min_words).collect()
    want = {d: (t, p) for d, t, p in brute.kept_units(rows, min_words)}
    assert len(out) == len(rows) and any(r.removed for r in out)
    for r in out:
        assert (r.kept_text or "", [x.place for x in r.removed]) == want[r.doc_id]
        units = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", r.text or "")
        assert r.n_units == len(units) and all(r.text[x.start : x.end] == units[x.place] for x in r.removed)
        assert r.text is not None or r.kept_text is None
    assert linededup.repeated_units(nothing).count() == 0
    kept = linededup.without_repeated_units(odd, 1).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, ""), (0, odd.first().text), (1, "another text")])


def test_units_of_many_chunks(spark):
    r = random.Random(4)
    rows = [(d, "".join(f"{r.choice('abcd')} x{r.randrange(9)}{r.choice(['. ', '! ', '.5 ', chr(10)])}" for _ in range(r.randrange(30)))) for d in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {d: places for d, _, places in brute.kept_units(rows, 0) if places}
    for flush in (5, 1_000_000):
        assert {r.doc_id: sorted(r.goes) for r in linededup.later_units(df, flush).collect()} == want


def test_units_are_cut_out_once(docs):
    plan = plan_of(linededup.without_repeated_units(docs))
    assert len(re.findall(r"\(\d+\) ArrowEvalPython", plan)) == 1


def test_units_leave_columns_alone(spark):
    t = "a passage of some words that is long enough to be judged as one unit, and of which there are two copies in all of the rows that there are. "
    names = ["kept_text", "n_units", "removed", "found", "key", "later_doc", "goes"]
    df = spark.createDataFrame([(1, t, *"abcdefg"), (2, t + "More.", *"hijklmn")], ["doc_id", "text", *names])
    kept = linededup.without_repeated_units(df)
    assert kept.columns == df.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple("abcdefg"), tuple("hijklmn")}
    assert {r.doc_id: r.text for r in kept.collect()} == {1: t, 2: " More."}
    assert linededup.repeated_units(df).columns == [*df.columns, "kept_text_", "n_units_", "removed_"]


def test_media_round_trip(docs, rows, nothing):
    media = jpegmedia.encoded(docs)
    out = {r.doc_id: r for r in jpegmedia.rgb_tensors(media).collect()}
    for d, t in rows:
        b = (t or "").encode()
        payload = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = out[d]
        assert bytes(r.payload) == payload and r.n_bytes == len(b) and len(r.rgb) == r.height * r.width * 3
    digest = {r.doc_id: r for r in jpegmedia.digests(media).collect()}
    for d, r in digest.items():
        assert r.payload_sha256 == hashlib.sha256(bytes(out[d].payload)).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(out[d].media)).hexdigest()
        assert r.tail_crc32 == zlib.crc32(bytes(out[d].payload)[-32:])
    same: dict = {}
    for d, t in rows:
        same.setdefault(t or "", set()).add(digest[d].feature)
    assert all(len(x) == 1 for x in same.values())
    assert jpegmedia.digests(jpegmedia.encoded(nothing)).count() == 0


def test_media_pixels_are_the_inverse_transform():
    payload = bytes(range(256)) * 9
    stored = jpegmedia.coefficients([jpegmedia.File(jpegmedia.encode([payload])[0])])
    block = np.zeros(64)
    block[jpegmedia.ZIGZAG] = stored[1, 2]
    block = block.reshape(8, 8)
    x = np.arange(8)
    c = np.where(x == 0, np.sqrt(0.5), 1)
    plain = np.array([[sum(c[u] * c[v] * block[u, v] * np.cos((2 * i + 1) * u * np.pi / 16) * np.cos((2 * j + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 + 128 for j in range(8)] for i in range(8)])
    ours = np.clip(np.floor((stored[1, 2] @ jpegmedia._basis() + 128 * 8192 + 4096) / 8192), 0, 255).reshape(8, 8)
    assert np.abs(ours - np.clip(plain, 0, 255)).max() <= 1


def test_media_of_ordinary_text_are_smaller_than_the_text():
    assert sorted(jpegmedia.BYTES.tolist()) == list(range(256)) and (jpegmedia.BYTES[jpegmedia.PLACE] == np.arange(256)).all()
    text = ("The quick brown fox jumps over the lazy dog, and nobody in the long queue sees where it has gone. " * 200).encode()
    payload = text[: len(text) // 576 * 576]
    media = jpegmedia.encode([payload])[0]
    assert len(media) < 0.9 * len(payload)  # once more than all of it, a byte being stored as its value
    assert next(jpegmedia.decode([media]))[0] == payload


def test_slow_scans_of_runs_and_ended_blocks():
    codes = jpegmedia.canonical({0x01: 2, 0x21: 2, 0x00: 3, 0x10: 3, 0xF0: 3})
    lengths = {0x01: 2, 0x21: 2, 0x00: 3, 0x10: 3, 0xF0: 3}
    symbols, _ = jpegmedia._symbols(jpegmedia._table_segment(0x10, lengths)[1:])

    def bits(*parts):
        text = "".join(format(v, f"0{n}b") for v, n in parts)
        text += "1" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")

    # block 0: +1, two zeros and -1, end; blocks 1 and 2: ended together
    data = bits(codes[0x01], (1, 1), codes[0x21], (0, 1), codes[0x00], codes[0x10], (0, 1))
    out = jpegmedia._slow_first(data, 3, 1, 5, symbols)
    assert out.tolist() == [[1, 0, 0, -1, 0], [0] * 5, [0] * 5]
    # refinement: correction of the first, a new value after one zero (passing the known -2), end with no more corrections
    known = np.array([[2, 0, 0, -2, 0]])
    data = bits(codes[0x01], (1, 1), (1, 1), codes[0x00], (1, 1))
    assert jpegmedia._slow_refine(data, known, 0, symbols).tolist() == [[3, 1, 0, -3, 0]]


def test_token_fields(docs, rows, nothing):
    out = {r.doc_id: r for r in tokencount.field_tokens(docs, "line", "largest").collect()}
    encoding, _ = tokencount._encoding(None)
    for d, t in rows:
        r = out[d]
        assert r.n_tokens == len(encoding.encode_ordinary(t or "")) == sum(f.tokens for f in r.fields)
        assert [(f.start, f.end) for f in r.fields][-1][1] == len((t or "").encode())
    assert tokencount.field_tokens(nothing).count() == 0


def test_token_sentences_against_a_plain_version(docs, rows):
    out = {r.doc_id: r for r in tokencount.field_tokens(docs, "sentence", "largest").collect()}
    encoding, _ = tokencount._encoding(None)
    for d, t in rows:
        raw = (t or "").encode()
        spans, begin = [], 0
        for i in range(len(raw)):
            stop = raw[i : i + 1] in (b".", b"!", b"?") and raw[i + 1 : i + 2] not in (b".", b"!", b"?")
            if stop or (raw[i + 1 : i + 2] == b"\n" and raw[i : i + 1] not in (b".", b"!", b"?")):
                spans.append((begin, i + 1))
                begin = i + 1
        if begin < len(raw) or not raw:
            spans.append((begin, len(raw)))
        spans = [(a, b) for a, b in spans if b > a] or [(0, len(raw))]
        if raw.startswith(b"\n"):
            continue  # its first end is at 0
        tokens, crossing, at = [0] * len(spans), 0, 0
        for piece in map(encoding.decode_single_token_bytes, encoding.encode_ordinary(t or "")):
            shares = [min(b, at + len(piece)) - max(a, at) for a, b in spans]
            tokens[shares.index(max(shares))] += 1
            crossing += sum(x > 0 for x in shares) > 1
            at += len(piece)
        r = out[d]
        assert [(f.start, f.end) for f in r.fields] == spans
        assert ([f.tokens for f in r.fields], r.n_crossing) == (tokens, crossing)


def test_maps_of_odd_rows(spark, odd):
    assert sorted(r.n_tokens for r in tokencount.field_tokens(odd, "sentence").collect()) == sorted(len(tokencount._encoding(None)[0].encode_ordinary(r.text or "")) for r in odd.collect())
    media = jpegmedia.digests(jpegmedia.encoded(odd)).collect()
    assert len(media) == 6 and len({r.media_sha256 for r in media}) == 3 and all(len(r.rgb) == r.height * r.width * 3 for r in media)
    bench = spark.createDataFrame([(None, "some words that are long enough to be looked at by"), (4, "again and again until a hundred bytes are full")], "item_id long, text string")
    out = decontaminate.contamination(odd, bench).collect()
    assert len(out) == 6 and sum(r.contaminated for r in out) == 4


@pytest.mark.parametrize("rule,want", [("largest", [0, 0, 1, 1, 2]), ("start", [0, 0, 0, 1, 2])])
def test_token_rules(rule, want):
    # fields 0-5, 5-9, 11-14; tokens: inside, inside, over 5 (2 bytes right), in the gap, last
    start, end = np.array([0, 2, 4, 9, 11]), np.array([2, 4, 7, 11, 14])
    home, crossing = tokencount.attribute(start, end, np.array([0, 5, 11]), np.array([5, 9, 14]), rule)
    assert home.tolist() == want and crossing.tolist() == [False, False, True, False, False]


def test_lm_counts_and_gain(spark, docs, rows, nothing):
    import math
    import re
    from collections import Counter

    out = {r.doc_id: r for r in brownlm.scores(docs, head=64, single=32, shapes=16, classes=8, rounds=4).collect()}
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.AZ)) + [None] for d, t in rows}
    count: Counter = Counter()
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for d, w in tokens.items():
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in count for x in w), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert brownlm.scores(nothing).count() == 0


def test_lm_scores_equal_a_plain_class_model(spark, docs, rows):
    """The model's classes are taken as given; transitions, class sizes, smoothing and scores are counted again plainly."""
    import math
    from collections import Counter

    sizes = {"head": 64, "single": 24, "shapes": 8, "classes": 5, "rounds": 8}
    learn = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    model = brownlm.fit(docs.where(docs.doc_id.isin([d for d, _ in learn])).select("text"), **sizes)[0]

    def read(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        h, _, ending = brownlm.tokens(raw, np.array([0, len(raw)]), 8)
        at, c = brownlm.classes_of(model.words, model.class_of, model.of_group, h, ending)
        return list(zip(h.tolist(), c.tolist(), (at >= 0).tolist(), strict=True))

    count, size, unseen, pair = Counter(), Counter(), Counter(), Counter()
    kinds: dict = {}
    for _, t in learn:
        seq = read(t)
        for (w, c, near), following in zip(seq, [*seq[1:], None], strict=True):
            count[w] += 1
            size[c] += 1
            if not near:
                kinds.setdefault(c, set()).add(w)
            if following:
                pair[c, following[1]] += 1
    unseen = {c: len(x) for c, x in kinds.items()}
    whole = sum(size.values()) + 5
    share = {c: (size[c] + 1) / whole for c in range(5)}
    out = {r.doc_id: r.score for r in brownlm.scores(docs, **sizes).collect()}
    for d, t in rows:
        score, before = 0.0, None
        for w, c, near in read(t):
            if before is None:
                score += math.log10(share[c])
            else:
                back = sum(pair[before, x] > 0 for x in range(5)) + 1
                score += math.log10((pair[before, c] + back * share[c]) / (sum(pair[before, x] for x in range(5)) + back))
            score += math.log10((count[w] if near else count[w] + 1) / (size[c] + unseen.get(c, 0) + 1))
            before = c
        assert out[d] == pytest.approx(score, abs=1e-9)


def test_lm_scores_do_not_depend_on_tasks(spark, docs):
    sizes = {"head": 200, "single": 60, "shapes": 16, "classes": 6, "rounds": 8}
    one, many = (got(brownlm.scores(docs.repartition(n), **sizes)) for n in (1, 7))
    assert [x[:6] for x in one] == [x[:6] for x in many] and [x[6] for x in one] == pytest.approx([x[6] for x in many], abs=1e-9)


def test_lm_of_odd_rows(odd):
    out = brownlm.scores(odd).collect()
    assert len(out) == 6 and len({r.score for r in out if r.n_tokens > 5 and r.doc_id == 1}) == 1


def test_exchange_finds_alternating_words(spark):
    r = random.Random(1)
    rows = [(i, " ".join(x for _ in range(40) for x in (f"a{r.randrange(3)}", f"b{r.randrange(8)}"))) for i in range(60)]
    out = brownlm.scores(spark.createDataFrame(rows, "doc_id long, text string"), single=12, shapes=2, classes=4, rounds=8).collect()
    held = [x for x in out if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) + 5 * len(held)


def labelled(spark):
    r = random.Random(2)
    bad = ["zork", "blarg", "flum"]
    docs, labels = [], []
    for d in range(600):
        toxic, junk = r.random() < 0.3, r.random() < 0.3
        w = [f"w{r.randrange(200)}" for _ in range(r.randint(5, 60))]
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", "ed", "ing"])
        if junk:
            w = [x + r.choice(["###", "$$$", "|||"]) for x in w]
        docs.append((d, " ".join(x + ("." if r.random() < 0.15 else "") for x in w)))
        labels.append((d, int(not junk), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "w1 zork")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"), dict((d, (q, t)) for d, q, t in labels)


def test_toxicity(spark, nothing):
    docs, labels, truth = labelled(spark)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.9
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id].encode()[s.start : s.end].decode() for r in held if truth[r.doc_id][1] for s in r.sentences]
    assert spans and np.mean([any(b in s for b in ("zork", "blarg", "flum")) for s in spans]) > 0.9
    assert toxicity.toxicity(nothing, labels).count() == 0
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}


def test_noisy_or_slope():
    r = np.random.default_rng(1)
    z, owner, label = r.normal(-1, 1, 9), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3]), np.array([1, 0, 1, 0])

    def loss(x):
        chance = [1 - np.prod([1 - 1 / (1 + np.exp(-v)) for v in x[owner == k]]) for k in range(4)]
        return -sum(np.log(c if y else 1 - c) for c, y in zip(chance, label, strict=True))

    plain = [(loss(z + d) - loss(z - d)) / 2e-6 for d in 1e-6 * np.eye(9)]
    assert np.allclose(toxicity.pull(1 / (1 + np.exp(-z)), owner, label), plain, atol=1e-6)


def test_cut_tells_labels_apart():
    odds = np.concatenate([np.linspace(-6, -2, 50), np.linspace(-1, 4, 30)])
    label = np.repeat([0, 1], [50, 30])
    assert -2.2 < toxicity.balanced_cut(odds, label) < 0
    assert toxicity.balanced_cut(odds[:60], label[:60]) == 0.0  # too few to tell
    # where labels overlap, clean rows are spared; where they are the same, all but a few
    r = np.random.default_rng(2)
    mixed = np.concatenate([r.normal(-3, 1, 400), r.normal(-1, 1, 40)])
    label = np.repeat([0, 1], [400, 40])
    cut = toxicity.balanced_cut(mixed, label)
    assert (mixed[:400] < cut).mean() >= 0.949 and (mixed[400:] > cut).mean() > 0.4
    assert (r.permutation(mixed) > toxicity.balanced_cut(mixed, r.permutation(label))).mean() < 0.1


def test_toxicity_scores_equal_a_plain_noisy_or(spark):
    """Scores recomputed word by word from given weights."""
    import re

    r = np.random.default_rng(5)
    weight, bias, shift = r.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -1.5, 0.7
    texts = ["Some words. Other words! some WORDS? longerword longerwords", "", None, "one", "a b c\nd e f... g", "...", "tie tie tie. tie", "schön über alles, Straße 5.5 x"]

    def feature(word):
        return int(textbytes.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), "alnum")[0][0] >> np.uint64(64 - toxicity.BITS))

    def stem(word, n):
        raw = np.frombuffer(word, np.uint8)
        return int(textbytes.prefixes(raw, np.array([0]), np.array([len(word)]), n, "alnum")[1][0] >> np.uint64(64 - toxicity.BITS))

    def plain(text):
        miss = 0.0
        for sentence in re.split(rb"[.!?\n]", (text or "").encode()):
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
            seen = {feature(w) for w in words} | {stem(w, n) for w in words for n in toxicity.STEMS if len(w) > n}
            if words:
                miss -= np.log1p(-1 / (1 + np.exp(-(bias + sum(float(weight[f]) for f in seen)))))
        return 1 / (1 + np.exp(-(np.log(np.expm1(miss)) + shift))) if miss > 0 else 0.0

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.scored(docs, (weight, bias, shift)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [plain(t) for t in texts], rtol=1e-6)
    kept = {x.doc_id for x in toxicity.without_toxic(docs, (weight, bias, shift)).collect()}
    assert kept == {i for i, t in enumerate(texts) if plain(t) < 0.5}


def test_toxicity_of_odd_rows(odd):
    labels = odd.sparkSession.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 2}) == 1 and all(0 <= r.score <= 1 for r in out)
    # a text of very many words and sentences, and ties
    long = odd.sparkSession.createDataFrame([(1, "word. " * 20_000), (2, "word. " * 20_000), (3, "x " * 20_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(long, labels).collect()}
    assert scores[1] == scores[2]


def test_quality(spark, nothing):
    docs, labels, truth = labelled(spark)
    out = quality.quality(docs, labels).collect()
    assert len(out) == 603 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    good, bad = ([r.score for r in held if truth[r.doc_id][0] == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert quality.quality(nothing, labels).count() == 0
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("prior", [0.4, 0.95])
def test_risk_slope(prior):
    r = np.random.default_rng(2)
    z = r.normal(0.5, 1, 12)
    loss = lambda t: 1 / (1 + np.exp(t))

    def parts(x):
        return prior * loss(x[:5]).mean(), loss(-x[5:]).mean() - prior * loss(-x[:5]).mean()

    second = parts(z)[1] >= 0
    risk = (lambda x: sum(parts(x))) if second else (lambda x: -parts(x)[1])
    plain = [(risk(z + e) - risk(z - e)) / 2e-6 for e in 1e-6 * np.eye(12)]
    assert np.allclose(quality.risk_slope(z, 5, prior), plain, atol=1e-6)


def test_quality_of_odd_rows(odd):
    labels = odd.sparkSession.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    out = quality.quality(odd, labels).collect()
    assert len(out) == 6 and len({r.score for r in out if r.doc_id == 2}) == 1


def test_class_prior():
    r = np.random.default_rng(0)
    p, n = r.normal(2, 1, (3000, 2)), r.normal(-2, 1, (1200, 2))
    u = np.concatenate([r.normal(2, 1, (2800, 2)), n])
    assert abs(quality.class_prior(p, u[r.permutation(len(u))], 1) - 0.7) < 0.08


def test_pairs_of_few_sets_go_by_sketches_too(spark):
    """Rows that can meet nothing leave before sketches are joined, and two sets of one element need not be read to be told apart."""
    row = "token long, node long, n int, left int, small boolean, component long"
    live = spark.createDataFrame([(1, 1, 100, 60, True, 1), (1, 2, 102, 60, True, 2), (2, 1, 100, 90, True, 1), (2, 3, 130, 90, False, 3), (3, 1, 100, 90, True, 1), (3, 4, 130, 97, False, 4), (3, 5, 131, 131, False, 1), (4, 6, 9, 9, True, 6)], row)
    kept = {(r.token, r.node): (r.c, r.major, r.s) for r in jaccard._mixed(live, 75).collect()}
    # of elements 2 and 3 the larger rows have less left than the 99 that both would need, node 5 has its own component's small row only; 6 is alone
    assert kept == {(1, 1): (2, 2, 1), (1, 2): (2, 2, 1), (2, 1): (2, 3, 1), (3, 1): (3, 1, 1)}
    sets = {i: np.unique(textbytes.mix(np.arange(100, dtype=np.uint64) + np.uint64(1000 * i))) for i in (1, 2)}
    shape = spark.createDataFrame([(i, bytearray(jaccard.sketch(x))) for i, x in sets.items()], "node long, sketch binary")
    pairs = jaccard._pairs_by_sketch(jaccard._mixed(live.where("token = 1"), 75), shape, 75, closest=False)
    assert pairs.count() == 0  # once a pair to verify, as elements of up to four sets went without sketches
