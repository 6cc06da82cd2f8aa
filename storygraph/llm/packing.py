"""Patched frame-of-reference blocks of 32-bit numbers, in NumPy.

A block holds ``BLOCK`` numbers less their minimum. All are packed at one width, which some
percentile of the block fits; the high bits of the few that are wider stand in an exception
list behind the packed words. Of the percentiles tried the one that takes least room counts.
A block is: minimum (u32), width (u16), number of exceptions (u16), packed 64-bit words,
positions of the exceptions (u16 each), their high bits (u32 each), all little-endian.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
GROUP = 64  # numbers packed together: at width w they fill w words
HEAD = np.dtype([("least", "<u4"), ("width", "<u2"), ("over", "<u2")])
PERCENTILES = (50, 75, 85, 90, 95, 98, 100)
AT_ONCE = 256  # blocks worked on together, which bounds the memory


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 0 for 0."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, GROUP) values below 2 ** width as (n, width) words."""
    out = np.zeros((len(values), width), np.uint64)
    values = values.astype(np.uint64)
    for i in range(GROUP if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, word] |= values[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= values[:, i] >> np.uint64(64 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``, as 32-bit values."""
    out = np.zeros((len(words), GROUP), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(GROUP if width else 0):
        word, shift = divmod(i * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = (value & mask).astype(np.uint32)
    return out


def chosen_widths(bits: np.ndarray, percentiles=PERCENTILES) -> np.ndarray:
    """The width of each block, from the sorted bit lengths of its values."""
    ranks = [max(0, -(-BLOCK * p // 100) - 1) for p in percentiles]
    widths = np.sort(bits, axis=1)[:, ranks].astype(np.int64)
    over = np.stack([(bits > widths[:, [k]]).sum(axis=1) for k in range(len(ranks))], axis=1)
    cost = widths * (BLOCK // 8) + over * 6
    return widths[np.arange(len(bits)), cost.argmin(axis=1)]


def encode(ids: np.ndarray) -> list[bytes]:
    """The blocks of the numbers, in order; the last one is filled up with its last number."""
    out: list[bytes] = []
    for at in range(0, len(ids), AT_ONCE * BLOCK):
        part = ids[at : at + AT_ONCE * BLOCK].astype(np.uint32)
        fill = -len(part) % BLOCK
        rows = np.concatenate([part, np.full(fill, part[-1])]).reshape(-1, BLOCK)
        least = rows.min(axis=1)
        rows = rows - least[:, None]
        bits = bit_lengths(rows)
        widths = chosen_widths(bits)
        made: list[bytes] = [b""] * len(rows)
        for width in np.unique(widths).tolist():
            which = np.flatnonzero(widths == width)
            low = rows[which] & np.uint32((1 << width) - 1)
            words = pack(low.reshape(-1, GROUP), width).reshape(len(which), -1).astype("<u8")
            wide = bits[which] > width
            row, place = np.nonzero(wide)
            high = (rows[which][row, place].astype(np.uint64) >> np.uint64(width)).astype("<u4")
            ends = np.searchsorted(row, np.arange(len(which) + 1))
            place = place.astype("<u2")
            for k, block in enumerate(which.tolist()):
                a, b = ends[k], ends[k + 1]
                head = np.array([(least[block], width, b - a)], HEAD).tobytes()
                made[block] = head + words[k].tobytes() + place[a:b].tobytes() + high[a:b].tobytes()
        out += made
    return out


def decode(data: bytes, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` numbers from blocks that begin at ``starts`` within ``data``."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(len(starts) * BLOCK, np.uint32)
    for at in range(0, len(starts), AT_ONCE):
        first = starts[at : at + AT_ONCE].astype(np.int64)
        heads = raw[first[:, None] + np.arange(HEAD.itemsize)].reshape(-1).view(HEAD)
        rows = np.empty((len(first), BLOCK), np.uint32)
        for width in np.unique(heads["width"]).tolist():
            which = np.flatnonzero(heads["width"] == width)
            size = width * (BLOCK // 8)
            words = raw[first[which, None] + HEAD.itemsize + np.arange(size)].reshape(-1, width * 8) if width else np.zeros((len(which) * (BLOCK // GROUP), 0), np.uint8)
            rows[which] = unpack(np.ascontiguousarray(words).view("<u8") if width else words, width).reshape(len(which), BLOCK)
        over = heads["over"].astype(np.int64)
        row = np.repeat(np.arange(len(first)), over)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(over) - over, over)
        lists = (first + HEAD.itemsize + heads["width"].astype(np.int64) * (BLOCK // 8))[row]
        place = raw[(lists + 2 * nth)[:, None] + np.arange(2)].reshape(-1).view("<u2")
        high = raw[(lists + 2 * over[row] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
        rows[row, place] |= (high.astype(np.uint64) << heads["width"][row].astype(np.uint64)).astype(np.uint32)
        rows += heads["least"][:, None]
        out[at * BLOCK : at * BLOCK + rows.size] = rows.reshape(-1)
    return out[:n]
