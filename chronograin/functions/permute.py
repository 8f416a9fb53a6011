"""Keyed permutations of 0 .. n-1: k different positions, every set of k as likely as any other.

A Feistel network over two halves of ``b`` bits permutes 0 .. 4^b - 1, whatever its round functions are; here they are
``(a * r + c) mod P`` with numbers drawn for each key and round. Results of n and above are permuted again until they
fall below n (cycle walking), which leaves a permutation of 0 .. n-1. So k positions are the images of 0 .. k-1: no set
of drawn positions is kept, and any single one can be computed by itself.

All steps are whole-number arithmetic below 2^53, so SQL gives the same positions (``permuted_sql``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronograin.functions.draws import draw, draw_sql

ROUNDS = 12
# the round functions work modulo this prime; the lower bits of a draw shift, the upper ones multiply
PRIME = (1 << 31) - 1
SHIFT_BITS = 21
# halves below two bits have too few round functions
LEAST_BITS = 2


def round_keys(seed: int, *keys: Column | str) -> Column:
    """One draw for each round."""
    return F.array(*[draw(seed, *keys, F.lit(f"round {i}")) for i in range(ROUNDS)])


def half_bits(n: np.ndarray) -> np.ndarray:
    """Bits of a half, so that the two hold n values."""
    bits = np.full(len(n), LEAST_BITS, np.int64)
    while (short := np.left_shift(1, 2 * bits) < n).any():
        bits += short
    return bits


def permuted(x: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Images of ``x`` under the permutations of 0 .. n-1 with these round keys, row by row."""
    out, todo = x.astype(np.int64), np.arange(len(x))
    bits = half_bits(n)
    while len(todo):
        b = bits[todo]
        mask = (1 << b) - 1
        left, right = out[todo] >> b, out[todo] & mask
        for key in keys[todo].T:
            mixed = ((key >> SHIFT_BITS) * right + (key & ((1 << SHIFT_BITS) - 1))) % PRIME
            left, right = right, (left + mixed) & mask
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= n[todo]]
    return out


def positions_drawn(n: Column, k: int, keys: Column) -> Column:
    """min(k, n) different positions of 1 .. n. The walk repeats until it ends, which no built-in function can."""

    @F.pandas_udf("array<bigint>")
    def walk(sizes: pd.Series, drawn: pd.Series) -> pd.Series:
        out = np.full(len(sizes), None, dtype=object)
        rows = np.flatnonzero((sizes > k).to_numpy())
        if len(rows):
            size = np.repeat(sizes.to_numpy(dtype=np.int64)[rows], k)
            found = permuted(np.tile(np.arange(k), len(rows)), size, np.repeat(np.stack(drawn.to_numpy()[rows]), k, axis=0))
            out[rows] = list(found.reshape(len(rows), k) + 1)
        return pd.Series(out)

    everything = F.sequence(F.lit(1).cast("bigint"), n)
    return F.when(n <= k, everything).otherwise(walk(n, keys))


def round_keys_sql(seed: int, *keys: str) -> str:
    parts = [draw_sql(seed, *keys, f"'round {i}'") for i in range(ROUNDS)]
    return f"[{', '.join(parts)}]"


def half_bits_sql(n: str) -> str:
    return f"greatest({LEAST_BITS}, (length(bin({n} - 1)) + 1) // 2)"


def permuted_sql(x: str, bits: str, keys: str) -> str:
    """One pass of the network over ``x``; the walk is the caller's recursion. The first element of the list is the state."""
    mask = f"((1::BIGINT << {bits}) - 1)"
    low = (1 << SHIFT_BITS) - 1
    mixed = f"(((key >> {SHIFT_BITS}) * (s & {mask}) + (key & {low})) % {PRIME})"
    return f"list_reduce(list_prepend({x}, {keys}), lambda s, key: ((s & {mask}) << {bits}) | (((s >> {bits}) + {mixed}) & {mask}))"
