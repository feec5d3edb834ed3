"""Keyed draws by integer arithmetic that any SQL engine has: the same rows draw the same numbers, whatever the partitions and the engine.

A draw is the fifth power, modulo a prime, of a linear form of both halves of an id and of a salt; the fifth power is a bijection there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2^31 - 1, a prime; draws are whole numbers of 0..PRIME - 1.
PRIME = 2_147_483_647


def salt(seed: int, k: int = 0) -> int:
    return (seed * 1_000_003 + k * 7_919 + 12_345) % PRIME


def draw(id_: Column, seed: int, k: int = 0) -> Column:
    """The k-th draw of an id under a seed."""
    low, high = id_.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(id_, 32)
    x = (low % PRIME * 48_271 + high % PRIME * 69_621 + salt(seed, k)) % PRIME
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def draw_sql(id_: str, seed: int, k: int = 0) -> str:
    """The same as SQL text, for an id that isn't negative."""
    x = f"((({id_} & 4294967295) % {PRIME} * 48271 + ({id_} >> 32) % {PRIME} * 69621 + {salt(seed, k)}) % {PRIME})"
    square = f"({x} * {x} % {PRIME})"
    return f"({square} * {square} % {PRIME} * {x} % {PRIME})"
