"""Hexagonal grid cell indices (64-bit): the operations that are arithmetic on the index's bits.

Layout, from the top: 1 reserved bit, 4 mode bits (1 for a cell), 3 reserved, 4 resolution, 7 base cell, then 15 digits of 3 bits, of
which those past the resolution are all ones. Coordinates and grid distance need the projection itself and are not here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the index layout.
MODE_BIT, RESOLUTION_BIT, BASE_BIT, DIGIT_BITS, MOST_DIGITS, BASE_CELLS = 59, 52, 45, 3, 15, 122


def from_text(c: str | Column) -> Column:
    """An index given as hexadecimal text, as a signed 64-bit integer; null for malformed text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.regexp_like(c, F.lit("^[0-9a-fA-F]{1,16}$")), F.conv(c, 16, -10).cast("long"))


def to_text(c: str | Column) -> Column:
    return F.lower(F.hex(F.col(c) if isinstance(c, str) else c))


def resolution(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.shiftright(c, RESOLUTION_BIT).bitwiseAND(F.lit(15).cast("long")).cast("int")


def base_cell(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.shiftright(c, BASE_BIT).bitwiseAND(F.lit(127).cast("long")).cast("int")


def digit(c: str | Column, k: int) -> Column:
    """The k-th digit, from 1."""
    c = F.col(c) if isinstance(c, str) else c
    return F.shiftright(c, DIGIT_BITS * (MOST_DIGITS - k)).bitwiseAND(F.lit(7).cast("long")).cast("int")


def is_valid(c: str | Column) -> Column:
    """Mode, reserved bits, base cell and digits are those of a cell (deleted subsequences of pentagons are not checked)."""
    c = F.col(c) if isinstance(c, str) else c
    ok = (F.shiftrightunsigned(c, MODE_BIT) == 1) & (F.shiftright(c, 56).bitwiseAND(F.lit(7).cast("long")) == 0) & (base_cell(c) < BASE_CELLS)
    for k in range(1, MOST_DIGITS + 1):
        ok &= F.when(F.lit(k) <= resolution(c), digit(c, k) != 7).otherwise(digit(c, k) == 7)
    return F.coalesce(ok, F.lit(False))


def parent(c: str | Column, coarser: int) -> Column:
    """The cell of a coarser resolution that holds this one; null if that resolution is finer than the cell's."""
    c = F.col(c) if isinstance(c, str) else c
    ones = (1 << DIGIT_BITS * (MOST_DIGITS - coarser)) - 1
    cleared = c.bitwiseAND(F.lit(~(15 << RESOLUTION_BIT)).cast("long")).bitwiseOR(F.lit(coarser << RESOLUTION_BIT).cast("long"))
    return F.when(resolution(c) >= coarser, cleared.bitwiseOR(F.lit(ones).cast("long")))
