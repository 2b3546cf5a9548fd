"""Plain-Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

AZ = {i: i + 32 for i in range(65, 91)}


def contamination(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(AZ))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def token_pieces(docs, capacity=4096):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, k in enumerate(range(0, len(ids), capacity)):
            x = ids[k : k + capacity]
            out.append((d, p, k, len(x), zlib.crc32(x.tobytes())))
    return out


def long_repeats(docs, length=100):
    """Per document: bytes, bytes removed, spans, digest of the rest."""
    seen: set[bytes] = set()
    out = []
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_components(docs, k=5, percent=75):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for d, t in docs:
        w = word.findall((t or "").translate(AZ))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    index: dict[tuple, list] = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for d, s in sets.items():
        for e in {y for x in s for y in index[x] if y < d}:
            inter = len(s & sets[e])
            if 100 * inter >= percent * (len(s) + len(sets[e]) - inter):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return [(d, len(s), find(d)) for d, s in sets.items()]


def kept_units(docs, min_words=25):
    """Per (doc_id, text): text without stretches of sentences whose normal form came earlier, and the places of these sentences."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        units = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", t or "")
        later = []
        for u in units:
            words = re.findall(r"[^\x20\x09-\x0D]+", u.translate(AZ))
            n = " ".join(words)
            later.append((bool(n) and n in seen, len(words)))
            seen.add(n)
        gone, at = set(), 0
        while at < len(units):
            end = at
            while end < len(units) and later[end][0]:
                end += 1
            if end > at and sum(w for _, w in later[at:end]) >= min_words:
                gone |= set(range(at, end))
            at = max(end, at + 1)
        out.append((d, "".join(u for i, u in enumerate(units) if i not in gone), sorted(gone)))
    return out
