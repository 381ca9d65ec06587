"""The standard generator (MT19937) at any place of its sequence, without running through what comes before.

Words of its state obey a linear recurrence over GF(2), so the state J words on is a fixed sum of
the first 19,937 words: the coefficients are those of t^J modulo the recurrence's characteristic polynomial.
Polynomials are integers, bit i the coefficient of t^i.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words of the state, and bits that matter in it.
WORDS, BITS = 624, 19_937


def seeded(seed: int) -> np.ndarray:
    """The state of ``random.Random(seed)`` before its first word."""
    words = [abs(seed) >> s & 0xFFFFFFFF for s in range(0, max(1, abs(seed).bit_length()), 32)]
    return np.random.RandomState(words).get_state()[1].astype(np.uint32)


def generator(state: np.ndarray):
    """A bit generator whose next word is the first that ``state`` makes."""
    raw = np.random.MT19937(0)
    raw.state = {"bit_generator": "MT19937", "state": {"key": state.copy(), "pos": WORDS}}
    return raw


def _states(state: np.ndarray, n: int) -> np.ndarray:
    """At least n words of the untempered sequence that begins with ``state``."""
    raw, out = generator(state), [state]
    while sum(map(len, out)) < n:
        raw.random_raw(WORDS)
        out.append(raw.state["state"]["key"].astype(np.uint32))
    return np.concatenate(out)


@lru_cache(maxsize=1)
def characteristic() -> tuple[int, ...]:
    """Exponents, but for the highest, of the polynomial that the sequence obeys; found from its own bits (Berlekamp and Massey)."""
    bits = (_states(seeded(1), 2 * BITS + 64) >> 31).tolist()[: 2 * BITS + 64]
    c, b, length, gap, window = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        window = window << 1 | bit
        if (c & window).bit_count() & 1:
            if 2 * length <= n:
                c, b, length, gap = c ^ b << gap, c, n + 1 - length, 1
                continue
            c ^= b << gap
        gap += 1
        if window.bit_length() > BITS + 64:
            window &= (1 << (BITS + 1)) - 1
    return tuple(length - i for i in range(1, length + 1) if c >> i & 1)


def _reduced(x: int) -> int:
    rest = (1 << BITS) - 1
    while x.bit_length() > BITS:
        high, x = x >> BITS, x & rest
        for e in characteristic():
            x ^= high << e
    return x


def power(j: int) -> int:
    """t^j modulo the characteristic polynomial."""
    x = 1
    for bit in bin(j)[2:]:
        x = _reduced(int("0".join(bin(x)[2:]), 2))
        if bit == "1":
            x = _reduced(x << 1)
    return x


def jumped(state: np.ndarray, j: int) -> np.ndarray:
    """The state j words after ``state``."""
    x, words = power(j), _states(state, BITS + WORDS)
    taken = np.frombuffer(bin(x)[:1:-1].encode(), np.uint8) == ord("1")
    out = np.zeros(WORDS, np.uint32)
    for i in np.flatnonzero(taken).tolist():
        out ^= words[i : i + WORDS]
    return out
