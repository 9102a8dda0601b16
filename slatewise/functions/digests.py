"""The numbers of ``expressions.hex_number`` for whole arrays: MD5 of short texts, many at once."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np

#: Texts hashed at once (their words stay in a core's cache), and the longest text of a single MD5 block.
_AT_ONCE, _LONGEST = 8192, 55
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _first_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of padded texts; ``words``: 16 rows of little-endian words."""
    a, b, c, d = [np.full(words.shape[1], x, dtype=np.uint32) for x in _START]
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif i < 32:
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        f += a
        f += np.uint32(_SINES[i])
        f += words[_WORDS[i]]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


def _texts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as rows of letters that end together, and the lengths."""
    left = np.abs(values).astype(np.uint64)
    digits = np.searchsorted(np.array([10**i for i in range(1, 20)], dtype=np.uint64), left, side="right") + 1
    lengths = digits + (values < 0)
    out = np.zeros((len(values), int(lengths.max())), dtype=np.uint8)
    for i in range(1, int(digits.max()) + 1):
        rest = left // np.uint64(10)
        out[:, -i] = (left - rest * np.uint64(10)).astype(np.uint8) + ord("0")
        left = rest
    below = np.flatnonzero(values < 0)
    out[below, out.shape[1] - lengths[below]] = ord("-")
    return out, lengths


def _messages(head: bytes, left: np.ndarray, right: np.ndarray, tail: bytes) -> np.ndarray:
    """``head``, left_right and ``tail`` as padded rows of 64 bytes."""
    out = np.zeros((len(left), 64), dtype=np.uint8)
    at = 0
    for piece in (head, left, b"_", right, tail):
        size = len(piece) if isinstance(piece, bytes) else piece.shape[1]
        out[:, at : at + size] = np.frombuffer(piece, dtype=np.uint8) if isinstance(piece, bytes) else piece
        at += size
    out[:, at] = 0x80
    out[:, 56:58] = np.frombuffer((8 * at).to_bytes(2, "little"), dtype=np.uint8)
    return out


def _shapes(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(left length, right length, rows that have them), a bounded number of rows at a time."""
    shape = 32 * left + right
    order = np.argsort(shape, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
        for start in range(0, len(rows), _AT_ONCE):
            part = rows[start : start + _AT_ONCE]
            yield int(left[part[0]]), int(right[part[0]]), part


def hex_numbers(before: Sequence[int], left: np.ndarray, right: np.ndarray, last: Sequence[int]) -> np.ndarray:
    """``hex_number(*before, left, right, x)`` of each row, a column for each x in ``last``: the first 15 digits of the MD5 of the
    parts joined by underscores."""
    head, tails = "".join(f"{x}_" for x in before).encode(), [f"_{x}".encode() for x in last]
    out = np.empty((len(left), len(tails)), dtype=np.int64)
    if not len(left):
        return out
    (a, wide), (b, high) = _texts(left), _texts(right)
    for i, j, rows in _shapes(wide, high):
        mine, theirs = a[rows, a.shape[1] - i :], b[rows, b.shape[1] - j :]
        for k, tail in enumerate(tails):
            if len(head) + i + j + 1 + len(tail) > _LONGEST:
                texts = (b"".join((head, x.tobytes(), b"_", y.tobytes(), tail)) for x, y in zip(mine, theirs))
                out[rows, k] = [int(hashlib.md5(text).hexdigest()[:15], 16) for text in texts]
                continue
            words = np.ascontiguousarray(_messages(head, mine, theirs, tail).view("<u4").T)
            first, second = [w.byteswap().astype(np.uint64) for w in _first_words(words)]
            out[rows, k] = ((first << np.uint64(32) | second) >> np.uint64(4)).astype(np.int64)
    return out
