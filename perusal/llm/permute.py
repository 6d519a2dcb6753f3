"""Keyed permutations of 0..n-1 as column expressions: a Feistel network with cycle-walking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: A value leaves its walk at each step with a chance over 1/2, so that one in 2^96 would be left.
WALKS, SOON = 96, 4


def _network(x: Column, key: Column, a: Column, b: Column) -> Column:
    """Permute the values of a + b bits: the halves take turns to be changed by the other one."""
    mask = lambda bits: F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    halves = F.struct(F.call_function("shiftright", x, b).alias("l"), x.bitwiseAND(mask(b)).alias("r"))
    turn = lambda s, i: F.struct(
        F.when(i % 2 == 0, s["l"].bitwiseXOR(F.xxhash64(s["r"], key, i).bitwiseAND(mask(a)))).otherwise(s["l"]).alias("l"),
        F.when(i % 2 == 1, s["r"].bitwiseXOR(F.xxhash64(s["l"], key, i).bitwiseAND(mask(b)))).otherwise(s["r"]).alias("r"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves, turn, lambda s: F.call_function("shiftleft", s["l"], b).bitwiseOR(s["r"]))


def permuted(x: Column, n: Column, key: Column) -> Column:
    """Place of x (long, 0 <= x < n) under the permutation of 0..n-1 that ``key`` chooses.

    The network permutes as many bits as n - 1 has. A value of n or more is sent through again:
    that stays on its cycle, so what ends below n is a permutation of 0..n-1. An endless walk is
    an error, not a wrong place. Null x or n give null.
    """
    bits = F.length(F.bin(F.greatest(n - 1, F.lit(1))))
    a, b = F.floor(bits / 2).cast("int"), F.ceil(bits / 2).cast("int")
    lost = F.raise_error(F.lit("a walk did not end: choose another key")).cast("long")
    step = lambda v, _: F.when(v < n, v).otherwise(_network(v, key, a, b))
    walk = lambda v, steps, end: F.aggregate(F.array(*map(F.lit, range(steps))), v, step, end)
    # a few steps do for nearly all; the rest walk on
    on = lambda v: F.when(v < n, v).otherwise(walk(v, WALKS - SOON, lambda w: F.when(w >= n, lost).otherwise(w)))
    return walk(_network(x, key, a, b), SOON, on)
