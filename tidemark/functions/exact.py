"""Exact integers beyond 64 bits: 256-bit words of logs, square root prices of ticks.

Column types end at 38 digits, a word has 78, so these integers are decimal text, made by the integers of Python on
Arrow batches. Limbs in arrays of longs give the same in columns, but took 14 seconds where this takes one (9,621
logs on one core), and have no quotient of 256 bits, which a tick's price needs.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_TICK = 887_272


def words(data: Column, **signed: bool) -> Column:
    """The 32-byte words of hex ``data`` in order, as a struct of decimal texts: a name for each word and whether
    it is in two's complement. Words beyond the end of the data are null, as are all of data that is no hex."""

    @F.pandas_udf(", ".join(f"{name} string" for name in signed))
    def made(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([word_texts(text, list(signed.values())) for text in column], columns=list(signed))

    return made(data)


def word_texts(text: str | None, signed: list[bool]) -> list[str | None]:
    try:
        body = bytes.fromhex((text or "").removeprefix("0x").removeprefix("0X"))
    except ValueError:
        body = b""
    return [str(int.from_bytes(body[at : at + 32], "big", signed=s)) if len(body) >= at + 32 else None for at, s in zip(range(0, 32 * len(signed), 32), signed)]


@cache
def _factors() -> list[int]:
    """128-bit fixed-point powers 1.0001 ** -(2 ** k / 2), rounded half up, for the bits of a tick."""
    with localcontext() as context:
        context.prec = 120
        root = Decimal("1.0001").sqrt()
        return [int((Decimal(2) ** 128 / root ** (1 << k)).to_integral_value(ROUND_HALF_UP)) for k in range(20)]


def root_x96_of(tick: int) -> int | None:
    """Square root price of a tick in 64.96 fixed point, rounded up as contracts do: a product of one factor for
    each bit of the tick's size, cut to 128 bits after each; its reciprocal for positive ticks."""
    if abs(tick) > MOST_TICK:
        return None
    ratio = 1 << 128
    for bit, factor in enumerate(_factors()):
        if abs(tick) >> bit & 1:
            ratio = ratio * factor >> 128
    if tick > 0:
        ratio = ((1 << 256) - 1) // ratio
    return -(-ratio >> 32)


def root_x96_text(tick: Column) -> Column:
    """``root_x96_of`` a column as decimal text, null outside the ticks that pools allow."""

    @F.pandas_udf("string")
    def made(ticks: pd.Series) -> pd.Series:
        return ticks.map(lambda t: None if pd.isna(t) or (root := root_x96_of(int(t))) is None else str(root))

    return made(tick)
