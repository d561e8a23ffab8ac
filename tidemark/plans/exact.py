"""Registered queries over exact integers: words of swap logs and prices of ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact as X
from ..functions import payloads as P
from ..sources import views as V
from .market import query

# SQL: limbs of 32 bits; a value of up to 160 bits is cut in two by long division with 10**27.

_DIVIDED = "list_reduce({limbs}, lambda s, x: {{'q': s.q*4294967296+(s.r*4294967296+x.r)//1000000000000000000000000000, 'r': (s.r*4294967296+x.r)%1000000000000000000000000000}}, {{'q': 0::HUGEINT, 'r': 0::HUGEINT}})"


def _decimal(divided: str) -> str:
    return f"CASE WHEN {divided}.q>0 THEN {divided}.q::VARCHAR||lpad({divided}.r::VARCHAR,27,'0') ELSE {divided}.r::VARCHAR END"


def _limb(word: int, k: int) -> str:
    """Limb ``k`` (of 8, most significant first) of a word."""
    return f"('0x'||substr(body,{64 * word + 8 * k + 1},8))::BIGINT::HUGEINT"


def _signed(word: int) -> str:
    """Text of a word that holds a sign-extended integer of 128 bits."""
    size = lambda limb: "+".join(f"{limb(k)}::UHUGEINT*{1 << 32 * (7 - k)}::UHUGEINT" for k in range(4, 8))
    flipped = size(lambda k: f"(4294967295-{_limb(word, k)})")
    return f"CASE WHEN {_limb(word, 4)}>=2147483648 THEN '-'||({flipped}+1)::VARCHAR ELSE ({size(lambda k: _limb(word, k))})::VARCHAR END"


def _wide(word: int) -> str:
    return _DIVIDED.format(limbs="[" + ",".join(f"{{'q': 0::HUGEINT, 'r': {_limb(word, k)}}}" for k in range(3, 8)) + "]")


@query("swap_stream_decode", f""", d AS (SELECT *, replace(data,'0x','') AS body FROM pool_logs WHERE length(data)>=386), e AS (SELECT *, {_wide(2)} AS root, {_wide(3)} AS liq FROM d)
  SELECT id, pool, block, {_signed(0)} AS amount0, {_signed(1)} AS amount1, {_decimal('root')} AS root_x96, {_decimal('liq')} AS liquidity, ({_signed(4)})::INT AS tick, ({_signed(5)})::INT AS fee FROM e""", "pool_logs")
def swap_stream_decode(spark, sf):
    """All six words of each log as exact integers; payloads under 192 bytes drop out."""
    logs = V.RELATIONS["pool_logs"](spark, sf).filter(F.length(P.bare_hex(F.col("data"))) >= 384)
    word = X.words(F.col("data"), amount0=True, amount1=True, root_x96=False, liquidity=False, tick=True, fee=False)
    out = logs.select("id", "pool", "block", word.alias("w")).select("id", "pool", "block", "w.*")
    return out.withColumns({"tick": F.col("tick").cast("int"), "fee": F.col("fee").cast("int")})


_FACTORS = ",".join(f"{{'b': {1 << k}, 'h': {f >> 96}, 'g': {f >> 64 & 0xFFFFFFFF}, 'f': {f >> 32 & 0xFFFFFFFF}, 'e': {f & 0xFFFFFFFF}}}" for k, f in enumerate(X._factors()))


@query("tick_to_sqrt_price_x96", f"""WITH t AS (SELECT p_partkey, ((p_partkey*7919)%887280)::INT*(CASE WHEN p_size%2=0 THEN 1 ELSE -1 END) AS tick FROM part),
  m AS (SELECT *, abs(tick) AS n, list_reduce([{{'b': 0, 'h': 0::HUGEINT, 'g': 0::HUGEINT, 'f': 0::HUGEINT, 'e': 0::HUGEINT, 'one': true}}]||list_transform([{_FACTORS}], lambda x: {{'b': x.b, 'h': x.h::HUGEINT, 'g': x.g::HUGEINT, 'f': x.f::HUGEINT, 'e': x.e::HUGEINT, 'one': false}}),
    lambda s, x: CASE WHEN abs(tick)&x.b=0 THEN s WHEN s.one THEN x ELSE list_transform([[
      s.e*x.e, s.e*x.f+s.f*x.e, s.e*x.g+s.f*x.f+s.g*x.e, s.e*x.h+s.f*x.g+s.g*x.f+s.h*x.e, s.f*x.h+s.g*x.g+s.h*x.f, s.g*x.h+s.h*x.g, s.h*x.h]],
      lambda p: list_transform([((((p[1]>>32)+p[2])>>32)+p[3])>>32], lambda c: list_transform([(c+p[4])>>32], lambda d: list_transform([d+p[5]], lambda v: list_transform([(v>>32)+p[6]], lambda u: {{'b': 0, 'h': ((u>>32)+p[7])>>32, 'g': ((u>>32)+p[7])%4294967296, 'f': u%4294967296, 'e': v%4294967296, 'one': false}})[1])[1])[1])[1])[1] END) AS s FROM t WHERE abs(tick)<=887272),
  w AS (SELECT p_partkey, tick, CASE WHEN s.one THEN NULL ELSE s.h::UHUGEINT*79228162514264337593543950336::UHUGEINT+s.g::UHUGEINT*18446744073709551616::UHUGEINT+s.f::UHUGEINT*4294967296::UHUGEINT+s.e::UHUGEINT END AS r FROM m),
  v AS (SELECT *, CASE WHEN tick>0 THEN list_reduce([{{'m': 0::UHUGEINT, 'a': 0::UHUGEINT, 'b': 0::UHUGEINT, 'i': 0}}]||list_transform(range(256), lambda i: {{'m': 0::UHUGEINT, 'a': 0::UHUGEINT, 'b': 0::UHUGEINT, 'i': i::INT}}),
    lambda s, x: CASE WHEN s.m>=r-s.m-1 THEN {{'m': s.m-(r-s.m-1), 'a': CASE WHEN x.i<128 THEN s.a*2+1 ELSE s.a END, 'b': CASE WHEN x.i<128 THEN s.b ELSE s.b*2+1 END, 'i': x.i}} ELSE {{'m': s.m*2+1, 'a': CASE WHEN x.i<128 THEN s.a*2 ELSE s.a END, 'b': CASE WHEN x.i<128 THEN s.b ELSE s.b*2 END, 'i': x.i}} END) END AS q FROM w),
  z AS (SELECT *, CASE WHEN tick>0 THEN q.a ELSE 0::UHUGEINT END AS hi, CASE WHEN tick>0 THEN q.b ELSE r END AS lo FROM v),
  up AS (SELECT *, lo//4294967296::UHUGEINT + (CASE WHEN lo%4294967296::UHUGEINT>0 THEN 1::UHUGEINT ELSE 0::UHUGEINT END) AS low FROM z),
  ls AS (SELECT p_partkey, tick, r, [hi//4294967296::UHUGEINT, hi%4294967296::UHUGEINT, low//18446744073709551616::UHUGEINT, low//4294967296::UHUGEINT%4294967296::UHUGEINT, low%4294967296::UHUGEINT] AS xs FROM up),
  dv AS (SELECT p_partkey, r, {_DIVIDED.format(limbs="list_transform(xs, lambda y: {'q': 0::HUGEINT, 'r': y::HUGEINT})")} AS d FROM ls)
  SELECT t.p_partkey, t.tick, CASE WHEN t.tick=0 THEN '79228162514264337593543950336' ELSE {_decimal('d')} END AS root_x96 FROM t LEFT JOIN dv ON dv.p_partkey=t.p_partkey""")
def tick_to_sqrt_price_x96(spark, sf):
    """The exact integer of each part's tick; null outside the ticks that pools allow."""
    tick = (F.col("p_partkey") * 7919 % 887_280).cast("int") * F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1)
    return V.read(spark, sf, "part").select("p_partkey", tick.alias("tick"), X.root_x96_text(tick).alias("root_x96"))
