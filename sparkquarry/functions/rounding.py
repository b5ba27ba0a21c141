"""Rounding of binary doubles by their exact decimal value, ties to even, as Python's ``round`` does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_SPLIT = 134217729.0  # 2^27 + 1 cuts a double into halves of 26 bits


def round_half_even(x: Column, digits: int = 2) -> Column:
    """``x`` to ``digits`` (0 to 5) places: 2.675 gives 2.67, being less than that in binary, and 0.125 gives 0.12.

    2 * 10^digits * x is worked out without error, as a product and what it
    lost (Dekker), and then as a whole number and a fraction; a tie is an odd
    number without one.  Null and NaN, infinities and doubles that lie further apart
    than the places come out as they are.
    """
    if not 0 <= digits <= 5:
        raise ValueError("digits must be from 0 to 5")
    places = 10.0**digits
    scale = 2 * places

    def whole(v: Column) -> Column:
        units = let(F.abs(v), lambda a: let(_SPLIT * a, lambda big: let(big - (big - a), lambda high: parts(a, high, a * scale))))
        found = units.cast("double") / places
        # (the sign of a negative zero stays)
        return F.when(F.isnan(v) | (F.abs(v) * places >= 2.0**53), v).otherwise(F.when(v < 0, -found).otherwise(F.when(v == 0, v).otherwise(found)))

    def parts(a: Column, high: Column, product: Column) -> Column:
        lost = (high * scale - product) + (a - high) * scale
        return let(F.floor(product), lambda n: let((product - n) + lost, lambda rest: halved(n + F.floor(rest), rest - F.floor(rest))))

    def halved(n: Column, rest: Column) -> Column:
        down, odd = F.shiftright(n, 1), F.pmod(n, F.lit(2)) == 1
        return down + F.when(odd & ((rest > 0) | (F.pmod(down, F.lit(2)) == 1)), 1).otherwise(0)

    return let(x.cast("double"), whole)
