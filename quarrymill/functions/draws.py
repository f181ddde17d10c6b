"""Reproducible draws: the heads of MD5 hashes of numbered texts, many at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Fixed values of MD5: start, constants and turns of the steps; and how many hashes are made at once.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
AT_ONCE = 1 << 14


def _words(prefix: bytes, start: int, stop: int) -> list[int | np.ndarray]:
    """The block of MD5 as 16 words, for prefix + number; a word without digits is one number for all."""
    digits = len(str(start))
    ends = len(prefix) + digits
    if ends > 55:
        raise ValueError("the text must fit one block of MD5")
    fixed = bytearray(prefix + bytes(digits) + b"\x80" + bytes(63 - ends))
    fixed[56:] = (8 * ends).to_bytes(8, "little")
    words: list[int | np.ndarray] = [int.from_bytes(fixed[4 * i : 4 * i + 4], "little") for i in range(16)]
    number = np.arange(start, stop, dtype=np.int64)
    for at in range(ends - 1, len(prefix) - 1, -1):
        number, digit = number // 10, number % 10
        words[at // 4] = words[at // 4] | (digit + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
    return words


def _heads(words: list[int | np.ndarray], n: int) -> np.ndarray:
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        w, turn = words[g], _TURN[i // 16][i % 4]
        f += a
        f += np.uint32((_ADD[i] + w) % 2**32) if isinstance(w, int) else w + np.uint32(_ADD[i])
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return (a + np.uint32(_START[0])).byteswap()


def md5_heads(prefix: str, n: int) -> Iterator[np.ndarray]:
    """For the numbers from 1 to n, in their order and in parts: the first eight hexadecimal digits of md5(prefix + number) as a number."""
    start = 1
    while start <= n:
        stop = min(start + AT_ONCE, 10 ** len(str(start)), n + 1)
        yield _heads(_words(prefix.encode(), start, stop), stop - start)
        start = stop
