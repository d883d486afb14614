"""Image files as bytes, with numpy alone: PNG both ways, baseline JPEG out.

Executors have no imaging library in Python; these need none.  JPEG files are written
without subsampling, with Huffman tables made for each image.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

#: The quantisation steps that the JPEG standard suggests at quality 50, by row.
LUMA_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_STEPS = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
#: places of a block along its diagonals, by turns up and down
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_K = np.arange(8)
COSINES = np.sqrt(2 / 8) * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.5), 1)[:, None]


# ---------------------------------------------------------------- PNG
def png(px: np.ndarray) -> bytes:
    """An RGB array as a PNG file."""
    h, w = px.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), px.reshape(h, 3 * w)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def unpng(body: bytes) -> np.ndarray:
    """The RGB array of a PNG file of 8 bits a channel without interlacing: gray, RGB, or either with alpha, which goes."""
    if body[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at + 8 <= len(body):
        size, kind = struct.unpack(">I4s", body[at : at + 8])
        part = body[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        data += [part] if kind == b"IDAT" else []
        at += 12 + size
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or not channels:
        raise ValueError("a kind of PNG file that is not read")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(h, 1 + w * channels)
    out, above = np.empty((h, w * channels), dtype=np.uint8), np.zeros(w * channels, dtype=np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, channels)
    px = out.reshape(h, w, channels)
    return np.repeat(px[..., :1], 3, axis=2) if channels < 3 else px[..., :3]


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, channels: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, channels), axis=0, dtype=np.uint8).reshape(-1)
    out = [0] * channels + row.tolist()
    up = [0] * channels + above.tolist()
    for k in range(channels, len(out)):
        a, b, c = out[k - channels], up[k], up[k - channels]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (out[k] + guess) & 255
    return np.array(out[channels:], dtype=np.uint8)


# ---------------------------------------------------------------- JPEG
def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """How many symbols get codes of 1..16 bits; no code is all ones, as that is not allowed."""
    heap = [(int(c), k, [0]) for k, c in enumerate(counts) if c] + [(0, 256, [0])]  # the last stands for the code that stays free
    heapq.heapify(heap)
    number = 257
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], number, [d + 1 for d in a[2] + b[2]]))
        number += 1
    bits = np.bincount(heap[0][2], minlength=64)
    for long in range(len(bits) - 1, 16, -1):  # codes that are too long: one of a pair takes its parent's place
        while bits[long]:
            short = long - 2
            while not bits[short]:
                short -= 1
            bits[long] -= 2
            bits[long - 1] += 1
            bits[short + 1] += 2
            bits[short] -= 1
    bits = bits[:17]
    bits[np.flatnonzero(bits)[-1]] -= 1
    return bits[1:]


def _huffman(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as a file holds it, and the code and its length for each of 256 symbols."""
    counts = np.bincount(symbols, minlength=256)
    bits = _code_lengths(counts)
    order = np.lexsort((np.arange(256), -counts))[: np.count_nonzero(counts)]
    code, size = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    at = value = 0
    for length, n in enumerate(bits.tolist(), 1):
        for s in order[at : at + n].tolist():
            code[s], size[s] = value, length
            value += 1
        at += n
        value <<= 1
    return bits.astype(np.uint8).tobytes() + order.astype(np.uint8).tobytes(), code, size


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that a coefficient takes, and these bits."""
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _packed(values: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> bytes:
    """Values of the given numbers of bits, one after another, filled up with ones."""
    parts = []
    for a in range(0, len(values), step):
        v, n = values[a : a + step], sizes[a : a + step]
        ends = np.cumsum(n)
        which = np.repeat(np.arange(len(n)), n)
        left = ends[which] - 1 - np.arange(int(ends[-1]))
        parts.append(((v[which] >> left) & 1).astype(np.uint8))
    bits = np.concatenate(parts)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])).tobytes()


def jpeg(px: np.ndarray, quality: float = 0.9) -> bytes:
    """An RGB array as a baseline JPEG file; quality 0..1."""
    h, w = px.shape[:2]
    q = min(100, max(1, round(quality * 100)))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    steps = [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA_STEPS, CHROMA_STEPS)]
    p = np.pad(px, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    y = p @ np.array([0.299, 0.587, 0.114])
    planes = (y - 128, (p[..., 2] - y) / 1.772, (p[..., 0] - y) / 1.402)
    found = []
    for k, plane in enumerate(planes):
        blocks = plane.reshape(plane.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        own = (COSINES @ blocks @ COSINES.T).reshape(-1, 64) / steps[min(k, 1)]
        found.append(np.rint(own[:, ZIGZAG]).astype(np.int64))
    coefs = np.stack(found, axis=1)
    coefs[1:, :, 0] -= coefs[:-1, :, 0].copy()  # the first of a block as the change to the block before
    coefs = coefs.reshape(-1, 64)
    chroma = np.arange(len(coefs)) % 3 > 0

    size, bits = _magnitude(coefs[:, 0])
    first = (np.arange(len(coefs)) * 130, 2 * chroma, size, bits, size)
    block, place = np.nonzero(coefs[:, 1:])
    before = np.concatenate([[-1], place[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]] = -1
    run = place - before[: len(place)] - 1
    size, bits = _magnitude(coefs[block, place + 1])
    others = (block * 130 + 2 * place + 3, 2 * chroma[block] + 1, (run & 15) << 4 | size, bits, size)
    long = np.repeat(np.arange(len(run)), run >> 4)  # sixteen zeros each
    zeros = (block[long] * 130 + 2 * place[long] + 2, 2 * chroma[block[long]] + 1, np.full(len(long), 0xF0), np.zeros(len(long), dtype=np.int64), np.zeros(len(long), dtype=np.int64))
    done = np.flatnonzero(coefs[:, 63] == 0)
    ends = (done * 130 + 129, 2 * chroma[done] + 1, np.zeros(len(done), dtype=np.int64), np.zeros(len(done), dtype=np.int64), np.zeros(len(done), dtype=np.int64))
    order, table, symbol, bits, size = (np.concatenate(x).astype(np.int64) for x in zip(first, others, zeros, ends))
    order = np.argsort(order, kind="stable")
    table, symbol, bits, size = table[order], symbol[order], bits[order], size[order]
    code, length, tables = np.empty_like(symbol), np.empty_like(symbol), []
    for k in range(4):
        own = table == k
        held, c, n = _huffman(symbol[own])
        tables.append(held)
        code[own], length[own] = c[symbol[own]], n[symbol[own]]
    body = _packed(code << size | bits, length + size).replace(b"\xff", b"\xff\x00")

    part = lambda mark, x: b"\xff" + bytes([mark]) + struct.pack(">H", len(x) + 2) + x
    out = [b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [part(0xDB, bytes([k]) + s[ZIGZAG].astype(np.uint8).tobytes()) for k, s in enumerate(steps)]
    out.append(part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(3))))
    out += [part(0xC4, bytes([(k & 1) << 4 | k >> 1]) + t) for k, t in enumerate(tables)]
    out.append(part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])))
    return b"".join(out) + body + b"\xff\xd9"
