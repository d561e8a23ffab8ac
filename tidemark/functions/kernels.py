"""Column kernels: pool swaps, quote normalisation, book capacities, bucketing, text rules."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
#: Widths of price buckets by lookback; an hour beyond.
WIDTHS = ((10 * 60_000, 30_000), (HOUR, 60_000), (DAY, 300_000), (7 * DAY, 1_800_000))


def swap_0_for_1(x: Column, liquidity: Column, root: Column, fee: float = 0.0) -> Column:
    """Output of a single-range pool for input ``x`` of token 0; root is the square root price.

    Written as L q (x q) / (L + x q): no difference of near-equal numbers, and invertible in x.
    """
    inp = x * (1 - fee)
    out = liquidity * root * (inp * root) / (liquidity + inp * root)
    return F.when((liquidity > 0) & (root > 0) & (x > 0), out).otherwise(F.lit(0.0))


def swap_1_for_0(x: Column, liquidity: Column, root: Column, fee: float = 0.0) -> Column:
    inp = x * (1 - fee)
    return F.when((liquidity > 0) & (root > 0) & (x > 0), inp / (root * (root + inp / liquidity))).otherwise(F.lit(0.0))


def tick_price(tick: Column, decimals_gap: int = 0) -> Column:
    return F.pow(F.lit(1.0001), tick) * F.pow(F.lit(10.0), F.lit(decimals_gap))


def price_tick(price: Column) -> Column:
    """Truncates towards zero."""
    return (F.log(price) / F.log(F.lit(1.0001))).cast("int")


def position_amounts(liquidity: Column, root: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(token 0, token 1) of a range position; roots are square root prices."""
    inside = F.least(F.greatest(root, low), high)
    return liquidity * (1 / inside - 1 / high), liquidity * (inside - low)


def inverted(mid: Column) -> Column:
    return F.when(mid > 0, 1 / mid)


def normalised_by_range(mid: Column) -> Column:
    """Mid on the common basis without a pair: below 1 as it is, above 100 inverted, else unknown."""
    return F.when(mid <= 0, None).when(mid < 1, mid).when(mid > 100, 1 / mid)


def bucket(ts_ms: Column, width_ms: int) -> Column:
    return F.floor(ts_ms / width_ms) * width_ms


def bucket_width(lookback_ms: int) -> int:
    """Width of a price bucket for a lookback."""
    for limit, width in WIDTHS:
        if lookback_ms <= limit:
            return width
    return HOUR


def bucket_width_of(lookback_ms: Column) -> Column:
    """``bucket_width`` of a column."""
    out = F.lit(HOUR)
    for limit, width in reversed(WIDTHS):
        out = F.when(lookback_ms <= limit, width).otherwise(out)
    return out.cast("bigint")


def uptime_text(age_ms: Column) -> Column:
    """Hours and minutes, or minutes alone under an hour."""
    seconds = F.floor(age_ms / 1000)
    part = lambda x, suffix: F.concat(F.floor(x).cast("string"), F.lit(suffix))
    hours = F.concat_ws(" ", part(seconds / 3600, "h"), part(seconds % 3600 / 60, "m"))
    return F.when(seconds >= 3600, hours).otherwise(part(seconds / 60, "m"))


def market_id(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def market_matches(order_market: Column, market: Column) -> Column:
    """Whether an order belongs to a market: letters and digits agree; an order without a market always does."""
    return order_market.isNull() | (market_id(order_market) == market_id(market))


def event_id(tx_hash: Column, log_index: Column) -> Column:
    """``hash:index`` with a lower-case prefixed hash and a decimal index (``log_index`` is hex text); null if one is
    missing."""
    index = F.conv(F.regexp_replace(log_index, "^0[xX]", ""), 16, 10)
    return F.concat(F.lit("0x"), F.regexp_replace(F.lower(tx_hash), "^0x", ""), F.lit(":"), index)


def address(text: Column) -> Column:
    """Lower-case hex without prefix, left-padded to 40, the last 40 digits of longer topics."""
    bare = F.regexp_replace(F.lower(text), "^0x", "")
    return F.when(F.length(bare) > 40, F.right(bare, F.lit(40))).otherwise(F.lpad(bare, 40, "0"))


def confidence(missing: Column) -> Column:
    return F.least(F.lit(0.9), F.greatest(F.lit(0.0), 0.9 - 0.2 * missing))


def spread_bps(bid: Column, ask: Column, mid: Column) -> Column:
    """Rounded half up."""
    return F.floor(F.try_divide(ask - bid, mid) * 10000 + 0.5).cast("int")


def tenths(value: Column) -> Column:
    """Nearest tenth of the double as it stands, exact halves to even, where ten times it is below 2**53. Ten times it
    is rounded once; the sum's error tells on which side of a half it was."""
    eight, two = value * 8, value * 2
    ten = eight + two
    error = two - (ten - eight)
    half = ten - F.floor(ten) == 0.5
    return F.when(half & (error > 0), F.ceil(ten)).when(half & (error < 0), F.floor(ten)).otherwise(F.rint(ten)) / 10


def human_usd(value: Column, halves_up: bool = True) -> Column:
    """$1.2M, $3K or $45; negative values are not shortened. Halves of shortened values round up, or to even as in
    C's printf (then by the double's exact value)."""
    text = lambda x, form, suffix: F.concat(F.lit("$"), F.format_string(form, x), F.lit(suffix))
    if not halves_up:
        whole = F.floor(value + 0.5)
        return F.when(value >= 1e6, text(tenths(value / 1e6), "%.1f", "M")).when(value >= 1e3, text(F.rint(value / 1e3), "%.0f", "K")).otherwise(text(whole, "%d", ""))
    return F.when(value >= 1e6, text(value / 1e6, "%.1f", "M")).when(value >= 1e3, text(value / 1e3, "%.0f", "K")).otherwise(text(F.floor(value + 0.5), "%d", ""))


def rate_band(rate: Column, fair: Column, low: float = 1.003, high: float = 1.005) -> Column:
    """Target rate where ``rate`` is outside [fair low, fair high], else null."""
    return F.when((rate < fair * low) | (rate > fair * high), fair * low)


def gas_cost(gwei: Column, native_usd: Column, age_ms: Column, units: int = 200_000, stale_ms: int = 300_000) -> Column:
    return F.when(age_ms <= stale_ms, gwei * units / 1e9 * native_usd)


def range_distance(price: Column, low: Column, high: Column) -> Column:
    """Distance beyond the nearer bound in percent of it, 0 inside."""
    return F.when(price < low, (low - price) / low * 100).when(price > high, (price - high) / high * 100).otherwise(0.0)


def short_address(text: Column, head: int = 6, tail: int = 6, whole: int = 10) -> Column:
    """The first and last characters of addresses longer than ``whole``; null for empty ones."""
    cut = F.concat(F.left(text, F.lit(head)), F.lit("..."), F.right(text, F.lit(tail)))
    return F.nullif(F.when(F.length(text) > whole, cut).otherwise(text), F.lit(""))


def shown_address(text: Column, chars: int = 6) -> Column:
    """As a page shows it: two more characters in front, for the prefix."""
    cut = F.concat(F.left(text, F.lit(chars + 2)), F.lit("..."), F.right(text, F.lit(chars)))
    return F.when(F.length(text) > 2 * chars + 2, cut).otherwise(text)


def age_text(age_ms: Column) -> Column:
    seconds = F.floor(age_ms / 1000)
    unit = lambda n, suffix: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{suffix} ago"))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


# --- pools and positions: doubles; roots are square root prices --------------------------------------

Q96 = float(1 << 96)


def root_at(tick: Column) -> Column:
    return F.pow(F.lit(1.0001), tick / 2)


def root_x96(tick: Column) -> Column:
    """Square root price of a tick times 2**96, null outside the ticks that pools allow."""
    return F.when(F.abs(tick) <= 887272, root_at(tick) * Q96)


def price_of_root(x96: Column, decimals0: int, decimals1: int) -> Column:
    return (x96 / Q96) * (x96 / Q96) * 10.0 ** (decimals0 - decimals1)


def required_ratio(root: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Amounts of both tokens for a unit of liquidity: below, inside and above the range."""
    r0 = F.when(root <= low, (high - low) / (low * high)).when(root >= high, 0.0).otherwise((high - root) / (root * high))
    r1 = F.when(root <= low, 0.0).when(root >= high, high - low).otherwise(root - low)
    return r0, r1


def liquidity_for(root: Column, low: Column, high: Column, amount0: Column, amount1: Column) -> Column:
    """Liquidity that the amounts buy; inside the range the scarcer one decides, or the only one."""
    l0, l1 = amount0 * root * high / (high - root), amount1 / (root - low)
    inside = F.when((l0 > 0) & (l1 > 0), F.least(l0, l1)).otherwise(F.greatest(l0, l1))
    return F.when(high <= low, 0.0).when(root <= low, amount0 * low * high / (high - low)).when(root >= high, amount1 / (high - low)).otherwise(inside)


def snapped(tick: Column, spacing: int, up: bool) -> Column:
    return (F.ceil(tick / spacing) if up else F.floor(tick / spacing)) * spacing


def tick_range(mean: Column, deviation: Column, multiplier: float, skew: Column, spacing: int, least: int, most: int) -> tuple[Column, Column]:
    """Ticks around an average price: the skew's share of the width lies below it; snapped to the
    spacing, then widened or narrowed about the middle, and snapped again."""
    total = deviation * multiplier * 2
    low = snapped(price_tick(F.greatest(mean - total * skew, F.lit(0.0001))), spacing, False)
    high = snapped(price_tick(mean + total * (1 - skew)), spacing, True)
    middle, width = F.floor((low + high) / 2), high - low
    fit = lambda edge, sign: F.when(width < least, middle + sign * (least // 2)).when(width > most, middle + sign * (most // 2)).otherwise(edge)
    return snapped(fit(low, -1), spacing, False), snapped(fit(high, 1), spacing, True)


def recovered_skew(skew: Column, price: Column, mean: Column, deviation: Column, multiplier: float) -> Column:
    """Skew moved by how far a recovery price is from the mean, within 0.2 to 0.8."""
    moved = F.greatest(F.lit(0.2), F.least(F.lit(0.8), skew + (price - mean) / (deviation * multiplier) * 0.15))
    return F.when(price.isNotNull() & (deviation > 0), moved).otherwise(skew)


def best_size(profit: Callable[[Column], Column], high: float, low: float = 1.0, tolerance: float = 0.5) -> Column:
    """Size of the greatest profit of a unimodal function: thirds are cut off until ``tolerance`` remains;
    of equal thirds the upper one goes."""
    steps = math.ceil(math.log((high - low) / tolerance) / math.log(1.5))

    def step(at: Column, _: Column) -> Column:
        m1 = at["lo"] + (at["hi"] - at["lo"]) / 3
        m2 = at["hi"] - (at["hi"] - at["lo"]) / 3
        rises = profit(m1) < profit(m2)
        return F.struct(F.when(rises, m1).otherwise(at["lo"]).alias("lo"), F.when(rises, at["hi"]).otherwise(m2).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(float(high)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda at: (at["lo"] + at["hi"]) / 2)
