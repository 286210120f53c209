"""Baseline JPEG in NumPy: three full-size components, a discrete cosine transform of 8 x 8 blocks, Huffman codes by a rule."""

from __future__ import annotations

import struct

import numpy as np

#: The standard's example tables of quantisation steps, for light and for colour, row by row.
LIGHT = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *(99,) * 32,
)
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8)[:, None], 0.5, 0.5 / np.sqrt(2))

END, SIXTEEN = 0x00, 0xF0  # the rest of a block is zero; sixteen zeros
#: Symbols by the length of their codes: sizes of first coefficients, and run and size of the others, of which the commonest are short.
_FIRST = {4: list(range(12))}
_COMMON = {2: [END], 3: [0x01], 4: [0x02, 0x11]}
_OTHERS = _COMMON | {9: [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in (0x01, 0x02, 0x11)] + [SIXTEEN]}


def _codes(by_length: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol: as decoders number them, in order of length."""
    code, length, now = np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for n in range(1, 17):
        for symbol in by_length.get(n, ()):
            code[symbol], length[symbol] = now, n
            now += 1
        now <<= 1
    return code, length


def steps(table: tuple[int, ...], quality: int) -> np.ndarray:
    """Quantisation steps for a quality from 1 to 100."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255).astype(np.int64)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _huffman(kind: int, by_length: dict[int, list[int]]) -> bytes:
    symbols = [by_length.get(n, []) for n in range(1, 17)]
    return _segment(0xC4, bytes([kind, *map(len, symbols), *(x for s in symbols for x in s)]))


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of the absolute value."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _items(values: np.ndarray, size: np.ndarray, symbol: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of bits) of codes with their values behind them; negative values as their complement."""
    extra = np.where(values < 0, values + (1 << size) - 1, values)
    return table[0][symbol] << size | extra, table[1][symbol] + size


def encode(image: np.ndarray, quality: int = 95) -> bytes:
    """A JPEG file of a blue, green, red or grey image."""
    if image.ndim == 2 or image.shape[2] == 1:
        image = np.repeat(image.reshape(*image.shape[:2], 1), 3, 2)
    h, w = image.shape[:2]
    pad = np.pad(image[..., :3], ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    b, g, r = (pad[..., k] for k in range(3))
    light = 0.299 * r + 0.587 * g + 0.114 * b
    tables = [steps(LIGHT, quality), steps(COLOUR, quality), steps(COLOUR, quality)]
    rows, cols = pad.shape[0] // 8, pad.shape[1] // 8
    parts = []
    for plane, q in zip((light - 128, (b - light) / 1.772, (r - light) / 1.402), tables, strict=True):
        blocks = plane.reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3)
        parts.append(np.rint((_COSINES @ blocks @ _COSINES.T).reshape(-1, 64) / q).astype(np.int64)[:, _ZIGZAG])
    coefficients = np.clip(np.stack(parts, 1).reshape(-1, 64), -1023, 1023)  # block by block, its three components
    first_codes, other_codes = _codes(_FIRST), _codes(_OTHERS)
    change = np.diff(coefficients[:, 0].reshape(-1, 3), axis=0, prepend=np.zeros((1, 3), np.int64)).ravel()
    at = np.arange(len(coefficients)) * 130
    size = _size(change)
    items = [(at, *_items(change, size, size, first_codes))]
    row, place = np.nonzero(coefficients[:, 1:])
    place += 1
    before = np.where(np.concatenate(([True], row[1:] != row[:-1]))[: len(row)], 0, np.concatenate(([0], place[:-1]))[: len(row)])
    zeros = place - before - 1
    value = coefficients[row, place]
    size = _size(value)
    items.append((row * 130 + 2 * place, *_items(value, size, zeros % 16 << 4 | size, other_codes)))
    long_ = np.repeat(row * 130 + 2 * place - 1, zeros // 16)
    items.append((long_, np.full(len(long_), other_codes[0][SIXTEEN]), np.full(len(long_), other_codes[1][SIXTEEN])))
    open_ = at[coefficients[:, 63] == 0] + 129
    items.append((open_, np.full(len(open_), other_codes[0][END]), np.full(len(open_), other_codes[1][END])))
    key, bits, n = (np.concatenate(c) for c in zip(*items, strict=True))
    order = np.argsort(key, kind="stable")
    bits, n = bits[order], n[order]
    shift = np.repeat(n, n) - 1 - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    flat = (np.repeat(bits, n) >> shift & 1).astype(np.uint8)
    data = np.packbits(np.concatenate((flat, np.ones(-len(flat) % 8, np.uint8)))).tobytes().replace(b"\xff", b"\xff\x00")
    head = _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + b"".join(_segment(0xDB, bytes([k, *tables[k][_ZIGZAG].tolist()])) for k in (0, 1))
    head += _segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += _huffman(0x00, _FIRST) + _huffman(0x10, _OTHERS)
    scan = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + head + scan + data + b"\xff\xd9"
