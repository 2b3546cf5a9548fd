"""Media columns: payloads kept in progressive JPEG files, and their full-resolution RGB tensors.

The unit of a JPEG file is the quantised DCT coefficient: a byte is stored as coefficient 2 plus its place in BYTES, a
fixed order from frequent to rare in texts, so that frequent bytes are small coefficients with few bits; in zigzag order,
block after block of 4:2:0 macroblocks (four luma blocks and one of each chroma). All quantisers are 1, so the
coefficients read back are the payload, bit for bit. A file has eleven scans: DC and two spectral bands of each
component without their last bit, then DC and AC refinements with it. Restart markers cut every scan into short
segments, and the decoder advances all segments of all files of a chunk together, one symbol a step, in numpy;
segments with zero runs or early block ends take a symbol-by-symbol path.

Decoding accumulates the scans into coefficient arrays, inverse-transforms them in numpy (integers held in
float64, so results do not depend on the machine or the batch), doubles chroma and converts to RGB.

Defined cases: null texts are empty; an empty text is one unit of 576 bytes 255; equal texts give equal files;
very long texts are chunks alone; rows may repeat, or have no id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
FILL = 255
SHIFT = 2
#: All bytes, those first that texts in Latin letters and UTF-8 use most, the fill among them; and each byte's place.
_FIRST = b" entahiorsduclm\xff\xc3g.,wfbpyvkz!TAESINO\xa9\nHRDCLMPWBFGU'-\"jxq?:;()0123456789JKVYQXZ%&*$#|/"
BYTES = np.array([*_FIRST, *sorted(set(range(256)) - set(_FIRST), key=lambda b: (b < 128, b))], np.uint8)
PLACE = np.argsort(BYTES).astype(np.int64)
CHUNK = 1 << 20
BANDS = ((1, 5), (6, 63))
#: Macroblocks or blocks between restart markers, by scan: DC, short band, long band, refinements.
RESTART = {"dc": 32, (1, 5): 32, (6, 63): 8, "refine": 32}

# Fixed values of the JPEG format: the zigzag order, the colour conversion (in 65536ths) and marker codes.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
RED_CR, GREEN_CB, GREEN_CR, BLUE_CB = 91881, -22554, -46802, 116130
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE

#: Code lengths of our Huffman tables. AC: sizes without a run (most letters have sizes 1 to 3), block ends and the long run.
DC_LENGTHS = {s: 4 for s in range(12)}
AC_LENGTHS = {0x01: 2, 0x02: 2, 0x03: 2, 0x04: 3, 0x05: 4, 0x06: 5, 0x07: 6, 0x08: 7, 0x00: 9} | {n << 4: 12 for n in range(1, 16)}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), as a JPEG table lists them."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _table_segment(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    counts = bytes(sum(n == i for _, n in order) for i in range(1, 17))
    return bytes([kind]) + counts + bytes(s for s, _ in order)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def _value_codes() -> tuple[np.ndarray, ...]:
    """Code and length of a DC difference (from -255) and of an AC value (from 0), magnitude bits included."""
    dc, ac = canonical(DC_LENGTHS), canonical(AC_LENGTHS)
    d = np.zeros((2, 511), np.int64)
    for v in range(-255, 256):
        s = abs(v).bit_length()
        code, n = dc[s]
        d[:, v + 255] = (code << s) | (v if v >= 0 else v + (1 << s) - 1), n + s
    a = np.zeros((2, 129), np.int64)
    for v in range(1, 129):
        s = v.bit_length()
        code, n = ac[s]
        a[:, v] = (code << s) | v, n + s
    return d[0], d[1], a[0], a[1]


def _packed(codes: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of segments of ``counts`` codes each, padded with ones to whole bytes; and the bytes of each segment."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    bits = total[edge[1:]] - total[edge[:-1]]
    length = (bits + 7) // 8
    begin = np.cumsum(length) - length
    at = total[:-1] + np.repeat(begin * 8 - total[edge[:-1]], counts)
    word, off = at >> 5, at & 31
    value = codes.astype(np.uint64) << (64 - off - sizes).astype(np.uint64)
    words = np.zeros(int(length.sum()) // 4 + 3, np.uint64)
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    out = words.astype(">u4").view(np.uint8)[: int(length.sum())].copy()
    out[begin + length - 1] |= ((1 << (length * 8 - bits)) - 1).astype(np.uint8)
    return out, length


def _marked(data: np.ndarray, length: np.ndarray, per_file: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each file: stuffed, with restart markers between its segments."""
    full = data == 0xFF
    ordinal = np.arange(len(length)) - np.repeat(np.cumsum(per_file) - per_file, per_file)
    last = np.zeros(len(length), bool)
    last[np.cumsum(per_file) - 1] = True
    gap = np.where(last, 0, 2)
    segment = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(data)) + np.cumsum(full) - full + (np.cumsum(gap) - gap)[segment]
    stuffed = np.add.reduceat(full, np.cumsum(length) - length, dtype=np.int64)
    size = length + stuffed + gap
    out = np.zeros(int(size.sum()), np.uint8)
    out[place] = data
    end = np.cumsum(size)
    inner = ~last
    out[end[inner] - 2] = 0xFF
    out[end[inner] - 1] = 0xD0 + ordinal[inner] % 8
    stop = end[np.cumsum(per_file) - 1]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)]


def shape(payload: int) -> tuple[int, int]:
    """Macroblock rows and columns of a file."""
    n = -(-payload // 384)
    columns = int(np.ceil(np.sqrt(n)))
    return -(-n // columns), columns


def luma_order(rows: int, columns: int) -> np.ndarray:
    """Luma blocks in raster order, as places in macroblock order."""
    return np.arange(rows * columns * 4).reshape(rows, columns, 2, 2).transpose(0, 2, 1, 3).ravel()


def _cuts(blocks: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all files' segments of ``every`` blocks (the last of a file may be shorter), and segments per file."""
    per = -(-blocks // every)
    out = np.full(int(per.sum()), every)
    out[np.cumsum(per) - 1] = blocks - (per - 1) * every
    return out, per


def encode(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file of each payload (positive multiples of UNIT)."""
    shapes = [shape(len(p)) for p in payloads]
    macro = np.array([r * c for r, c in shapes])
    joined = b"".join(p + bytes([FILL]) * (m * 384 - len(p)) for p, m in zip(payloads, macro.tolist(), strict=True))
    coefficients = PLACE[np.frombuffer(joined, np.uint8)].reshape(-1, 6, 64) + SHIFT
    base = np.cumsum(macro) - macro
    order = np.concatenate([luma_order(r, c) + 4 * b for (r, c), b in zip(shapes, base.tolist(), strict=True)])
    planes = [coefficients[:, :4].reshape(-1, 64)[order], coefficients[:, 4], coefficients[:, 5]]
    counts = [macro * 4, macro, macro]
    dc_code, dc_size, ac_code, ac_size = _value_codes()

    scans: list[tuple[bytes, list[bytes]]] = []
    every = RESTART["dc"]
    dri = _segment(DRI, struct.pack(">H", every))
    length, per = _cuts(macro, every)
    dc = coefficients[:, :, 0] >> 1
    head = np.zeros(len(dc), bool)
    head[np.cumsum(length) - length] = True
    diff = np.empty_like(dc)
    diff[:, 1:4] = dc[:, 1:4] - dc[:, 0:3]
    for i, before in ((0, 3), (4, 4), (5, 5)):
        diff[0, i] = dc[0, i]
        diff[1:, i] = dc[1:, i] - np.where(head[1:], 0, dc[:-1, before])
    v = diff.ravel() + 255
    scans.append((dri + _scan_header((1, 2, 3), 0, 0, 0, 1), _marked(*_packed(dc_code[v], dc_size[v], length * 6), per)))
    for c in range(3):
        for a, b in BANDS:
            every = RESTART[a, b]
            length, per = _cuts(counts[c], every)
            v = planes[c][:, a : b + 1].ravel() >> 1
            scans.append((_segment(DRI, struct.pack(">H", every)) + _scan_header((c + 1,), a, b, 0, 1), _marked(*_packed(ac_code[v], ac_size[v], length * (b - a + 1)), per)))
    length, per = _cuts(macro, RESTART["dc"])
    scans.append((dri + _scan_header((1, 2, 3), 0, 0, 1, 0), _marked(*_packed(coefficients[:, :, 0].ravel() & 1, np.ones(len(dc) * 6, np.int64), length * 6), per)))
    ends = canonical(AC_LENGTHS)
    for c in range(3):
        every = RESTART["refine"]
        length, per = _cuts(counts[c], every)
        # one symbol ends all blocks of a segment; the bits of values known so far follow it
        run = np.zeros((2, every + 1), np.int64)
        for n in range(1, every + 1):
            k = n.bit_length() - 1
            code, size = ends[k << 4]
            run[:, n] = (code << k) | (n - (1 << k)), size + k
        bits = planes[c][:, 1:].ravel() & 1
        per_segment = length * 63
        at = np.cumsum(per_segment) - per_segment
        codes, sizes = np.insert(bits, at, run[0][length]), np.insert(np.ones(len(bits), np.int64), at, run[1][length])
        scans.append((_segment(DRI, struct.pack(">H", every)) + _scan_header((c + 1,), 1, 63, 1, 0), _marked(*_packed(codes, sizes, per_segment + 1), per)))

    tables = _segment(DQT, b"\0" + b"\1" * 64) + _segment(DHT, _table_segment(0x00, DC_LENGTHS) + _table_segment(0x10, AC_LENGTHS))
    out = []
    for i, (payload, (rows, columns)) in enumerate(zip(payloads, shapes, strict=True)):
        frame = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [b"\xff\xd8", _segment(COM, b"payload %d" % len(payload)), tables, _segment(SOF2, frame)]
        for header, data in scans:
            parts += header, data[i]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _scan_header(parts: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(SOS, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c in parts) + bytes([first, last, high << 4 | low]))


_END = re.compile(rb"\xff[^\x00\xd0-\xd7]")
_RST = re.compile(rb"\xff[\xd0-\xd7]")


class File:
    """What the headers of one file say, and its scans as lists of segments."""

    def __init__(self, media: bytes):
        self.quantisers: dict[int, np.ndarray] = {}
        self.scans: list[tuple[tuple, list[bytes]]] = []
        self.payload = 0
        tables: dict[int, bytes] = {}
        every, at = 0, 2
        if media[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            marker = media[at + 1]
            if marker == EOI:
                break
            size = int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == COM and body.startswith(b"payload "):
                self.payload = int(body[8:])
            elif marker == DQT:
                while body:
                    self.quantisers[body[0] & 15] = np.frombuffer(body[1:65], np.uint8)
                    body = body[65:]
            elif marker == DHT:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == SOF2:
                _, height, width, parts = struct.unpack(">BHHB", body[:6])
                if parts != 3 or body[7::3] != b"\x22\x11\x11" or height % 16 or width % 16:
                    raise ValueError("only 4:2:0 frames of whole macroblocks are supported")
                self.rows, self.columns = height // 16, width // 16
                self.tables_of = body[8::3]
            elif marker == DRI:
                every = int.from_bytes(body, "big")
            elif marker == SOS:
                n = body[0]
                parts = tuple(body[1 : 1 + 2 * n : 2])
                which = body[2]
                first, last, shift = body[1 + 2 * n : 4 + 2 * n]
                end = _END.search(media, at).start()
                table = tables.get(which >> 4 if not first else 0x10 | which & 15, b"")
                self.scans.append(((parts, first, last, shift >> 4, shift & 15, every, table), [s.replace(b"\xff\x00", b"\xff") for s in _RST.split(media[at:end])]))
                at = end


@lru_cache(maxsize=64)
def _symbols(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: symbol and its code's length; and, for values without a run, bits | value << 8 (0: another symbol)."""
    symbol, bits = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    simple = np.zeros(1 << 16, np.int32)
    code, k = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo, hi = code << (16 - n), (code + 1) << (16 - n)
            s = table[k]
            symbol[lo:hi], bits[lo:hi] = s, n
            if s <= 15 and n + s <= 16:
                ahead = (np.arange(lo, hi) >> (16 - n - s)) & ((1 << s) - 1)
                value = np.where(ahead < (1 << s) >> 1, ahead - (1 << s) + 1, ahead) if s else np.zeros(hi - lo, np.int64)
                simple[lo:hi] = value * 256 + n + s
            code, k = code + 1, k + 1
        code <<= 1
    return (symbol << 8) | bits, simple


def _lockstep(segments: list[bytes], steps: np.ndarray, simple: np.ndarray, zero: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of each segment (rows), ``steps`` of them, read side by side; and which segments hold nothing else.

    zero: whether a value of no bits is one (a DC difference) or ends a block.
    """
    length = np.array([len(s) for s in segments])
    data = np.frombuffer(b"".join(segments) + b"\xff" * 8, np.uint8).astype(np.int64)
    window = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).astype(np.int64)
    order = np.argsort(-steps, kind="stable")
    at = ((np.cumsum(length) - length) * 8)[order]
    limit = len(window) * 8 - 8
    most = int(steps.max())
    active = np.searchsorted(-steps[order], -np.arange(1, most + 1), "right")
    out = np.zeros((most, len(segments)), np.int32)
    for i in range(most):
        m = active[i]
        p = at[:m]
        e = simple[(window[p >> 3] >> (16 - (p & 7))) & 0xFFFF]
        out[i, :m] = e
        p += e & 31
        np.minimum(p, limit, out=p)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out = out.T[back]
    inside = np.arange(most) < steps[:, None]
    used = out & 31
    value = out >> 8
    bad = (used == 0) & inside
    if not zero:
        bad |= (value == 0) & inside
    return value, ~bad.any(axis=1)


def _slow_first(segment: bytes, blocks: int, first: int, last: int, symbols: np.ndarray) -> np.ndarray:
    """AC values of one segment, symbol by symbol: runs, early ends and runs of ended blocks."""
    bits, size = int.from_bytes(segment + b"\xff" * 4, "big"), len(segment) * 8 + 32
    at = 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return (bits >> (size - at)) & ((1 << n) - 1)

    out = np.zeros((blocks, last - first + 1), np.int64)
    block = 0
    while block < blocks:
        k = first
        while k <= last:
            entry = int(symbols[(bits >> (size - at - 16)) & 0xFFFF])
            at += entry & 31
            run, s = entry >> 12, (entry >> 8) & 15
            if s:
                k += run
                v = take(s)
                out[block, k - first] = v if v >> (s - 1) else v - (1 << s) + 1
                k += 1
            elif run == 15:
                k += 16
            else:
                block += (1 << run) + take(run) - 1
                break
        block += 1
    return out


def _slow_refine(segment: bytes, known: np.ndarray, low: int, symbols: np.ndarray) -> np.ndarray:
    """Refined AC values of one segment (blocks by band), symbol by symbol."""
    bits, size = int.from_bytes(segment + b"\xff" * 4, "big"), len(segment) * 8 + 32
    at, skip = 0, 0
    one = 1 << low

    def take(n: int) -> int:
        nonlocal at
        at += n
        return (bits >> (size - at)) & ((1 << n) - 1)

    out = known.copy()
    for row in out:
        k, n = 0, len(row)
        while k < n and not skip:
            entry = int(symbols[(bits >> (size - at - 16)) & 0xFFFF])
            at += entry & 31
            run, s = entry >> 12, (entry >> 8) & 15
            new = 0
            if s:
                new = one if take(1) else -one
            elif run < 15:
                skip = (1 << run) + take(run)
                break
            while k < n:
                if row[k]:
                    if take(1):
                        row[k] += one if row[k] > 0 else -one
                elif not run:
                    row[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if skip:
            for k in range(k, n):
                if row[k] and take(1):
                    row[k] += one if row[k] > 0 else -one
            skip -= 1
    return out


def coefficients(files: list[File]) -> np.ndarray:
    """(macroblocks, 6, 64) of all files, zigzag order, accumulated over their scans."""
    macro = np.array([f.rows * f.columns for f in files])
    base = np.cumsum(macro) - macro
    total = int(macro.sum())
    planes = [np.zeros((4 * total, 64), np.int64), np.zeros((total, 64), np.int64), np.zeros((total, 64), np.int64)]
    for number in range(max(len(f.scans) for f in files)):
        groups: dict[tuple, list[int]] = {}
        for i, f in enumerate(files):
            if number < len(f.scans):
                groups.setdefault(f.scans[number][0], []).append(i)
        for key, members in groups.items():
            _add_scan(key, members, files, number, macro, base, planes)
    order = np.concatenate([luma_order(f.rows, f.columns) + 4 * b for f, b in zip(files, base.tolist(), strict=True)])
    luma = np.empty_like(planes[0])
    luma[order] = planes[0]
    return np.concatenate([luma.reshape(total, 4, 64), planes[1][:, None], planes[2][:, None]], axis=1)


def _add_scan(key: tuple, members: list[int], files: list[File], number: int, macro: np.ndarray, base: np.ndarray, planes: list[np.ndarray]) -> None:
    parts, first, last, high, low, every, table = key
    segments = [s for i in members for s in files[i].scans[number][1]]
    times = 1 if first == 0 or parts[0] != 1 else 4
    blocks = macro[members] * times
    length, _ = _cuts(blocks, every or int(blocks.max()))
    which = np.concatenate([np.arange(n) + b * times for n, b in zip(blocks.tolist(), base[members].tolist(), strict=True)])
    if first == 0:
        if len(parts) != 3:
            raise ValueError("DC scans must hold all components")
        if high:
            bits = _raw_bits(segments, length * 6)
            value = bits.reshape(-1, 6) << low
        else:
            diff, ok = _lockstep(segments, length * 6, _symbols(table)[1], True)
            if not ok.all():
                raise ValueError("broken DC scan")
            diff = diff.reshape(len(segments), -1, 6)
            kept = np.arange(diff.shape[1]) < length[:, None]
            luma = np.cumsum(diff[:, :, :4].reshape(len(segments), -1), axis=1).reshape(len(segments), -1, 4)
            value = np.concatenate([luma, np.cumsum(diff[:, :, 4:], axis=1)], axis=2)[kept] << low
        # luma blocks come in macroblock order here and are kept in raster order
        order = np.concatenate([luma_order(files[i].rows, files[i].columns) + 4 * base[i] for i in members])
        in_macro = np.repeat(which * 4, 4) + np.tile(np.arange(4), len(which))
        luma_of = np.zeros(4 * int(macro.sum()), np.int64)
        luma_of[in_macro] = value[:, :4].ravel()
        planes[0][np.sort(order), 0] |= luma_of[order]
        planes[1][which, 0] |= value[:, 4]
        planes[2][which, 0] |= value[:, 5]
        return
    plane, band = planes[parts[0] - 1], last - first + 1
    symbols, simple = _symbols(table)
    if not high:
        value, ok = _lockstep(segments, length * band, simple, False)
        value = value.reshape(len(segments), -1, band)
        kept = np.arange(value.shape[1]) < length[:, None]
        for i in np.flatnonzero(~ok):
            value[i, : length[i]] = _slow_first(segments[i], int(length[i]), first, last, symbols)
        plane[which, first : last + 1] = value[kept] << low
        return
    known = plane[which, first : last + 1]
    head = np.array([int.from_bytes(s[:4].ljust(4, b"\xff"), "big") for s in segments])
    entry = symbols[head >> 16]
    run, used = (entry >> 12).astype(np.int64), (entry & 31).astype(np.int64)
    ended = (1 << run) + ((head >> np.maximum(32 - used - run, 0)) & ((1 << run) - 1))
    quick = ((entry >> 8) & 15 == 0) & (run < 15) & (used + run <= 32) & (ended >= length)
    held = known != 0
    owner = np.repeat(np.arange(len(segments)), length)
    if quick.any():
        mask = held & quick[owner][:, None]
        per = np.bincount(owner, mask.sum(axis=1), len(segments)).astype(np.int64)
        bits = _raw_bits(segments, per, used + run)
        known[mask] += np.where(known[mask] > 0, bits, -bits) << low
    edge = np.cumsum(length) - length
    for i in np.flatnonzero(~quick):
        rows = slice(edge[i], edge[i] + length[i])
        known[rows] = _slow_refine(segments[i], known[rows], low, symbols)
    plane[which, first : last + 1] = known


def _raw_bits(segments: list[bytes], counts: np.ndarray, skip: np.ndarray | int = 0) -> np.ndarray:
    """``counts`` bits of each segment, after ``skip``."""
    length = np.array([len(s) for s in segments])
    bits = np.unpackbits(np.frombuffer(b"".join(segments), np.uint8))
    begin = (np.cumsum(length) - length) * 8 + skip
    at = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    return bits[at].astype(np.int64)


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """Inverse transform of 64 zigzag coefficients to 64 samples, in whole 8192ths."""
    u = np.arange(8)
    one = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1)[:, None] / 2
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(both * 8192)[ZIGZAG]


def tiles(coefficient: np.ndarray, quantisers: np.ndarray) -> np.ndarray:
    """RGB of each macroblock: (n, 16, 16, 3) bytes, chroma doubled both ways."""
    n = len(coefficient)
    sums = (coefficient * quantisers).reshape(-1, 64).astype(np.float64) @ _basis()
    samples = np.clip(np.floor((sums + (128 * 8192 + 4096)) / 8192), 0, 255).astype(np.int32).reshape(n, 6, 8, 8)
    y = samples[:, :4].reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 16, 16)
    cb, cr = (np.repeat(np.repeat(samples[:, i] - 128, 2, axis=1), 2, axis=2) for i in (4, 5))
    out = np.empty((n, 16, 16, 3), np.uint8)
    out[..., 0] = np.clip(y + ((RED_CR * cr + 32768) >> 16), 0, 255)
    out[..., 1] = np.clip(y + ((GREEN_CB * cb + GREEN_CR * cr + 32768) >> 16), 0, 255)
    out[..., 2] = np.clip(y + ((BLUE_CB * cb + 32768) >> 16), 0, 255)
    return out


def decode(media: list[bytes]) -> Iterator[tuple[bytes, int, int, np.ndarray]]:
    """Payload, height, width and RGB tensor (height, width, 3) of each file."""
    files = [File(m) for m in media]
    stored = coefficients(files)
    at = 0
    macro = [f.rows * f.columns for f in files]
    scale = np.stack([[f.quantisers[f.tables_of[c]] for c in (0, 0, 0, 0, 1, 2)] for f in files])
    scale = np.repeat(scale, macro, axis=0) if (scale != 1).any() else np.ones((1, 6, 64), np.int64)
    rgb = tiles(stored, scale)
    for f, n in zip(files, macro, strict=True):
        payload = BYTES[(stored[at : at + n].reshape(-1)[: f.payload] - SHIFT).astype(np.uint8)].tobytes()
        picture = rgb[at : at + n].reshape(f.rows, f.columns, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(f.rows * 16, f.columns * 16, 3)
        yield payload, f.rows * 16, f.columns * 16, picture
        at += n


def _grouped(sizes: list[int]) -> Iterator[slice]:
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            yield slice(first, i)
            first, held = i, 0
        held += n
    if held:
        yield slice(first, len(sizes))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t.as_py() or "").encode() for t in batch.column(1)]
        padded = [t + bytes([FILL]) * (max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in texts]
        for part in _grouped([len(p) for p in padded]):
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(encode(padded[part]), pa.binary())], ["doc_id", "n_bytes", "media"])


def encoded(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a progressive JPEG file."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoded, "doc_id long, n_bytes long, media binary")


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2).to_pylist()
        for part in _grouped([len(m) for m in media]):
            rows = [(p, h, w, x.tobytes()) for p, h, w, x in decode(media[part])]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], batch.column(2)[part], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "media", "payload", "height", "width", "rgb"])


def rgb_tensors(media: DataFrame) -> DataFrame:
    """``encoded``'s rows with the payload read back and the RGB tensor (row-major bytes, three to a pixel)."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_tensors, "doc_id long, n_bytes long, media binary, payload binary, height int, width int, rgb binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = batch.column(2).to_pylist()
        for part in _grouped([len(m) for m in media]):
            rows = []
            for stored, (payload, height, width, rgb) in zip(media[part], decode(media[part]), strict=True):
                total = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
                feature = f"{width}x{height} {'/'.join(map(str, total))} {zlib.crc32(rgb.tobytes()):08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, height, width, rgb.tobytes()))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def digests(media: DataFrame) -> DataFrame:
    """What the stored files say of themselves: payload and file digests, the picture's channel sums and checksum, and its RGB tensor."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digests, DIGEST)
