"""Morton keys, child masks and mirrors as native column expressions. Digit = 4 * x + 2 * y + z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which bits of a child mask swap under the mirror of one axis, and by how much.
SWAPS = {4: (0xF0, 0x0F, 4), 2: (0xCC, 0x33, 2), 1: (0xAA, 0x55, 1)}


def interleave(x: Column, y: Column, z: Column, levels: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(levels):
        for axis, bit in ((x, 2), (y, 1), (z, 0)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(axis.cast("long"), i).bitwiseAND(F.lit(1).cast("long")), 3 * i + bit))
    return out


def axis_of(key: Column, axis: int, levels: int) -> Column:
    """0, 1, 2: x, y, z of a key."""
    out = F.lit(0).cast("long")
    for i in range(levels):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(key, 3 * i + 2 - axis).bitwiseAND(F.lit(1).cast("long")), i))
    return out


def prefix(key: Column, up: int) -> Column:
    return F.shiftright(key, 3 * up)


def slot(key: Column) -> Column:
    return key.bitwiseAND(F.lit(7).cast("long")).cast("int")


def bit(key: Column) -> Column:
    """The child-mask bit of a key's own slot."""
    return F.call_function("shiftleft", F.lit(1), slot(key))


def mirror_mask(mask: Column, mirror: int) -> Column:
    """A child mask under a mirror: bits 4, 2, 1 of `mirror` are the x, y and z axes."""
    for axis, (high, low, by) in SWAPS.items():
        if mirror & axis:
            mask = F.shiftright(mask.bitwiseAND(F.lit(high)), by).bitwiseOR(F.shiftleft(mask.bitwiseAND(F.lit(low)), by))
    return mask


def canonical_mask(mask: Column) -> Column:
    return F.least(*(mirror_mask(mask, m) for m in range(8)))


def bits(mask: Column) -> Column:
    return F.bit_count(mask).cast("long")
