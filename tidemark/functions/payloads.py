"""Columns from payload text: orders, tickers, logs, times, numbers. Malformed values become null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States in which an order can still be filled.
OPEN_STATES = ("wait", "confirm", "pending_cancel")
TWO_128 = 2.0**128


def number(text: Column) -> Column:
    """A double, or null where the text is no number."""
    return F.trim(text).try_cast("double")


def order_value(payload: Column, name: str) -> Column:
    """A number of a payload that may be a scalar or an object with ``amount`` or ``value``; else 0."""
    at = lambda path: number(F.get_json_object(payload, path))
    return F.coalesce(at(f"$.{name}.amount"), at(f"$.{name}.value"), at(f"$.{name}"), F.lit(0.0))


def field_value(text: Column) -> Column:
    """``order_value`` of a field's text: a scalar, or an object's ``amount`` or ``value``; else 0."""
    nested = F.when(text.startswith("{"), F.coalesce(number(F.get_json_object(text, "$.amount")), number(F.get_json_object(text, "$.value"))))
    return F.coalesce(nested, number(text), F.lit(0.0))


def order_status(payload: Column) -> Column:
    named = lambda key: F.nullif(F.get_json_object(payload, f"$.{key}"), F.lit(""))
    return F.lower(F.coalesce(named("state"), named("status"), F.lit("")))


def order_side(payload: Column) -> Column:
    side = F.lower(F.get_json_object(payload, "$.side"))
    return F.when(side.isin("buy", "sell"), side)


def order_is_open(payload: Column) -> Column:
    status, remaining, volume = order_status(payload), order_value(payload, "remaining_volume"), order_value(payload, "volume")
    sized = (F.when(remaining <= 0, volume).otherwise(remaining) > 0) | (order_value(payload, "origin_volume") > order_value(payload, "executed_volume"))
    live = status.isin(*OPEN_STATES)
    return F.when((status != "") & ~live, False).otherwise(sized | live)


def time_ms(text: Column) -> Column:
    """Milliseconds from seconds (up to ten digits' range), milliseconds or an ISO time; else null."""
    whole = F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(F.when(whole > 10_000_000_000, whole).otherwise(whole * 1000), F.unix_millis(F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))))


def first_positive(*values: Column) -> Column:
    return F.coalesce(*(F.when(v > 0, v) for v in values))


def bare_hex(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "^0x", "")


def signed_word(data: Column, word: int) -> Column:
    """The 128-bit signed integer in a 32-byte word of hex ``data``, as a double. Its last 26 digits are
    exact up to 2**104; a word of leading f is negative."""
    body = F.substring(bare_hex(data), 64 * word + 1, 64)
    high = F.conv(F.substring(body, 39, 13), 16, 10).cast("double")
    low = F.conv(F.substring(body, 52, 13), 16, 10).cast("double")
    flipped = F.translate(body, "0123456789abcdef", "fedcba9876543210")
    high_n, low_n = (F.conv(F.substring(flipped, at, 13), 16, 10).cast("double") for at in (39, 52))
    shift = F.lit(float(1 << 52))
    return F.when(body.startswith("f"), -(high_n * shift + low_n + 1)).otherwise(high * shift + low)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_revert(text: Column) -> Column:
    """An error without the hex data at its end; hex data alone that encodes Error(string) as its message."""
    number_at = lambda hexed, at: F.conv(F.nullif(F.substring(hexed, at, F.lit(64)), F.lit("")), 16, 10).try_cast("bigint")
    fits = lambda hexed, n: F.when(n <= F.length(hexed) / 2, n * 2).cast("int")  # noqa: E731  in digits

    def message(hexed: Column) -> Column:
        """The string behind an offset, with its length before it; null where the data ends too early."""

        def behind(at: Column) -> Column:
            data = lambda long: F.when(F.length(F.substring(hexed, at + 65, long)) == long, F.try_validate_utf8(F.decode(F.unhex(F.substring(hexed, at + 65, long)), "UTF-8")))
            return let(fits(hexed, number_at(hexed, at + 1)), data)

        return let(fits(hexed, number_at(hexed, F.lit(1))), behind)

    def cleaned(bare: Column) -> Column:
        decoded = F.concat(F.lit("execution reverted: "), message(F.substring(bare, 11, 2**31 - 1)))
        return F.when(bare.rlike("^0x08c379a0[0-9a-fA-F]*$"), F.coalesce(decoded, bare)).otherwise(bare)

    return let(F.trim(F.regexp_replace(text, r":\s*0x[0-9a-fA-F]{8,}$", "")), cleaned)


#: Markers of error classes, tried in this order on the lower-case text.
ERROR_MARKERS = {
    "rpc": ("connectionerror", "timeouterror", "timeout", "connection refused", "httperror", "read timed out", "max retries", "connectionrefused", "remotedisconnected", "broken pipe", "connection reset"),
    "balance": ("transfer amount exceeds balance", "insufficient balance", "erc20: transfer"),
    "permit2": ("allowanceexpired", "insufficientallowance"),
    "pool_paused": ("lok", "poolnotinitialized", "paused"),
}


def error_class(text: Column) -> Column:
    """First class of which a marker occurs in the text."""
    out, low = None, F.lower(text)
    for name, markers in ERROR_MARKERS.items():
        holds = low.rlike("|".join(markers))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise("unknown")
