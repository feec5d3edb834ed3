"""Predicates and updates of 64-bit flag registers, as column expressions.

A register is a long; bit 63 makes it negative, so tests compare with zero or with the mask, never by size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(mask: int) -> int:
    """An unsigned 64-bit mask as the long that has the same bits."""
    if not -(1 << 63) <= mask < 1 << 64:
        raise ValueError(f"{mask} doesn't fit 64 bits")
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bit_mask(bit: int) -> int:
    if not 0 <= bit < 64:
        raise ValueError(f"bit {bit} is outside 0..63")
    return signed(1 << bit)


def _masked(register: Column, mask: int) -> Column:
    return register.bitwiseAND(F.lit(signed(mask)))


def has_all(register: Column, mask: int) -> Column:
    return _masked(register, mask) == signed(mask)


def has_any(register: Column, mask: int) -> Column:
    return _masked(register, mask) != 0


def has_none(register: Column, mask: int) -> Column:
    return _masked(register, mask) == 0


def either_and(register: Column, any_of: int, all_of: int) -> Column:
    """Any bit of any_of, if there are some, and all of all_of."""
    out = has_all(register, all_of)
    return out & has_any(register, any_of) if any_of else out


def set_bits(register: Column, mask: int) -> Column:
    return register.bitwiseOR(F.lit(signed(mask)))


def clear_bits(register: Column, mask: int) -> Column:
    return register.bitwiseAND(F.lit(~signed(mask)))


def put_bits(register: Column, mask: int, on: Column) -> Column:
    return F.when(on, set_bits(register, mask)).otherwise(clear_bits(register, mask))


def bit(register: Column, i: int) -> Column:
    """0 or 1."""
    bit_mask(i)
    return F.bit_get(register, F.lit(i)).cast("int")


def bits_of(register: Column) -> Column:
    """The numbers of the bits that are set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.bit_get(register, i) == 1)


def either(*masks: Column) -> Column:
    out = F.lit(0).cast("long")
    for m in masks:
        out = out.bitwiseOR(m)
    return out
