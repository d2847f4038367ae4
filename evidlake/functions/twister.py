"""Jumps of the Mersenne Twister, so that tasks can start anywhere in one generator's stream.

The generator is linear over bits: its words follow a recurrence whose polynomial has degree 19937, found
here from the words themselves (Berlekamp-Massey). Going on by J words is the combination of the first
windows of words that x^J, reduced by that polynomial, names.
"""

from __future__ import annotations

import functools
import random

import numpy as np

WORDS, MIDDLE, DEGREE = 624, 397, 19937
#: Fixed values of the generator.
MATRIX, UPPER, LOWER = np.uint32(0x9908B0DF), np.uint32(0x80000000), np.uint32(0x7FFFFFFF)


def words(state: np.ndarray, n: int) -> np.ndarray:
    """A state and the untempered words after it, n in all."""
    x = np.empty(n, dtype=np.uint32)
    x[:WORDS] = state
    step = WORDS - MIDDLE  # so many words depend on known ones only
    for k in range(0, n - WORDS, step):
        m = min(step, n - WORDS - k)
        y = (x[k : k + m] & UPPER) | (x[k + 1 : k + m + 1] & LOWER)
        x[k + WORDS : k + WORDS + m] = x[k + MIDDLE : k + MIDDLE + m] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), MATRIX, np.uint32(0))
    return x


def shortest_recurrence(bits: list[int]) -> int:
    """The polynomial of least degree that the bits obey, leading coefficient first in order of powers."""
    c, b, length, gap, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit
        if (c & seen).bit_count() & 1:
            c, before = c ^ (b << gap), c
            if 2 * length <= n:
                length, b, gap = n + 1 - length, before, 0
        gap += 1
    return int(bin(c)[2:].zfill(length + 1)[::-1], 2)


@functools.cache
def polynomial() -> int:
    x = words(first_state(1), WORDS + 2 * DEGREE + 64)
    return shortest_recurrence((x[WORDS:] & np.uint32(1)).tolist()[: 2 * DEGREE + 32])


def times(a: int, b: int) -> int:
    """The product of two polynomials over bits, reduced."""
    p, out, i = polynomial(), 0, 0
    while a:
        low = (a & -a).bit_length() - 1
        a >>= low + 1
        i += low
        out ^= b << i
        i += 1
    while (over := out.bit_length() - p.bit_length()) >= 0:
        out ^= p << over
    return out


def power(n: int) -> int:
    """x^n, reduced."""
    out = 1
    for bit in bin(n)[2:]:
        out = times(out, out)
        if bit == "1":
            out = times(2, out)
    return out


def first_state(seed: int) -> np.ndarray:
    """The state of the standard library's generator before its first word."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], dtype=np.uint32)


def jumped(state: np.ndarray, combination: int) -> np.ndarray:
    """The state after as many words as the power of x stands for."""
    x, out = words(state, DEGREE + WORDS), np.zeros(WORDS, dtype=np.uint32)
    for i in np.flatnonzero(np.array(list(bin(combination)[:1:-1])) == "1"):
        out ^= x[i : i + WORDS]
    return out


def states(seed: int, step: int, n: int) -> list[np.ndarray]:
    """States of one seed's generator after 0, step, 2 step, ... words."""
    start = first_state(seed)
    out, one, at = [start], power(step) if n > 1 else 1, 1
    for _ in range(n - 1):
        at = times(at, one)
        out.append(jumped(start, at))
    return out


def generator(state: np.ndarray) -> np.random.RandomState:
    """A generator whose random_sample() goes on from a state as the standard library's random() would."""
    g = np.random.RandomState()
    g.set_state(("MT19937", state, WORDS))
    return g
