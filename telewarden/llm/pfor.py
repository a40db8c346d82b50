"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds 256 numbers less their minimum, packed at the width that fits a fixed share of them. The high bits of the
rest, its outliers, follow as an exception list. Layout of a block: minimum (4 bytes), width (1), number of exceptions
(2), packed numbers (32 bytes per bit of width), exception places (1 byte each), exception high parts (4 bytes each).
"""

from __future__ import annotations

import numpy as np

BLOCK = 256
#: Share of a block's numbers that the packed width must fit.
FITTING_SHARE = 0.9
_HEADER = np.dtype([("low", "<u4"), ("width", "u1"), ("exceptions", "<u2")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` numbers below ``2 ** width`` as rows of ``32 * width`` bytes."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(values), 32 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(packed.reshape(-1, 8 * width).view("<u8").T)
    lanes = np.empty((64, words.shape[1]), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        part = words[word] >> np.uint64(shift)
        if shift + width > 64:
            part |= words[word + 1] << np.uint64(64 - shift)
        lanes[i] = part & mask
    return np.ascontiguousarray(lanes.T).reshape(len(packed), BLOCK)


def encode(numbers: np.ndarray, share: float = FITTING_SHARE) -> tuple[bytes, bytes]:
    """The blocks, and the index: where each block starts, as little-endian unsigned 32-bit integers."""
    n = len(numbers)
    if not n:
        return b"", b""
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, numbers[-1], np.uint32)
    full[:n] = numbers
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    kth = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    fitting = np.partition(rest, kth, axis=1)[:, kth]
    width = np.ceil(np.log2(fitting.astype(np.float64) + 1)).astype(np.int64)  # exact below 2 ** 53
    outlier = rest >> width.astype(np.uint32)[:, None] if width.max() < 32 else np.where(width[:, None] < 32, rest >> np.minimum(width, 31).astype(np.uint32)[:, None], 0)
    patched = outlier > 0
    exceptions = patched.sum(axis=1)
    sizes = _HEADER.itemsize + 32 * width + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    header = np.empty(blocks, _HEADER)
    header["low"], header["width"], header["exceptions"] = low, width, exceptions
    out[starts[:-1, None] + np.arange(_HEADER.itemsize)] = header.view(np.uint8).reshape(blocks, -1)
    body = starts[:-1] + _HEADER.itemsize
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        packed = _pack(rest[rows] & np.uint32((1 << int(w)) - 1), int(w))
        out[body[rows, None] + np.arange(32 * w)] = packed
    row, place = np.nonzero(patched)
    if len(row):
        order = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = (body + 32 * width)[row]
        out[at + order] = place
        out[(at + exceptions[row] + 4 * order)[:, None] + np.arange(4)] = outlier[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), starts[:-1].astype("<u4").tobytes()


def decode(payload: bytes, index: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of all blocks, in order."""
    data, starts = np.frombuffer(payload, np.uint8), np.frombuffer(index, "<u4").astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint32)
    header = np.ascontiguousarray(data[starts[:, None] + np.arange(_HEADER.itemsize)]).view(_HEADER).reshape(-1)
    width, exceptions = header["width"].astype(np.int64), header["exceptions"].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    body = starts + _HEADER.itemsize
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        out[rows] = _unpack(data[body[rows, None] + np.arange(32 * w)], int(w))
    if exceptions.any():
        row = np.repeat(np.arange(len(starts)), exceptions)
        order = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = (body + 32 * width)[row]
        high = np.ascontiguousarray(data[(at + exceptions[row] + 4 * order)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        out[row, data[at + order]] |= high << width[row].astype(np.uint32)
    return (out + header["low"][:, None]).reshape(-1)[:count]
