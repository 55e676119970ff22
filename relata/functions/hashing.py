"""Two published hashes as column expressions: MurmurHash3 of 32 bits and SipHash-2-4.

Both read a value as bytes: a text as UTF-8, a whole number as its four or eight bytes, lowest byte
first. Null gives null. Rounds are steps of an ``aggregate`` over a constant array, so that a round's
state is computed once however often the next one mentions it. The unsigned numbers of 32 bits are
bigints; a hash of 64 bits is the bigint with the same bits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of the two published functions.
MURMUR_FACTORS = (0xCC9E2D51, 0x1B873593)
MURMUR_FINAL = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))
SIP_START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
SIP_TURNS = ((13, 16), (17, 21))

_LOW = 0xFFFFFFFF


def _long(value: int) -> Column:
    """A number of 64 bits as the bigint with the same bits."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _low(value: Column) -> Column:
    return value.bitwiseAND(_long(_LOW))


def _left(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftleft", value, F.lit(bits) if isinstance(bits, int) else bits)


def _right(value: Column, bits: Column | int) -> Column:
    bits = F.lit(bits) if isinstance(bits, int) else bits
    return F.call_function("shiftrightunsigned", value, bits)


# bytes


def _unit(text_hex: Column, place: Column) -> Column:
    """The four bytes at ``4 * place``, or as many as are left, as a number, lowest first."""
    found = F.substring(text_hex, place * 8 + 1, F.lit(8))
    number = F.conv(F.regexp_replace(F.reverse(found), "(.)(.)", "$2$1"), 16, 10).cast("long")
    return F.when(found == "", 0).otherwise(number)


def _from_zero(last: Column) -> Column:
    return F.sequence(F.lit(0), last.cast("int"))


def _whole(n_bytes: Column, size: int) -> Column:
    return F.floor(n_bytes / size).cast("int")


# MurmurHash3


def _times(value: Column, factor: Column | int) -> Column:
    """Product of two numbers of 32 bits, its low 32 bits. The signed factor keeps it in a bigint."""
    if isinstance(factor, int):
        factor = F.lit(factor - (1 << 32) if factor >> 31 else factor).cast("long")
    return _low(value * factor)


def _turned(value: Column, bits: int) -> Column:
    return _low(_left(value, bits)).bitwiseOR(_right(value, 32 - bits))


def _murmur(units: Column, n_bytes: Column, seed: int) -> Column:
    """Hash of ``units``: struct(u, whole), a unit of fewer than four bytes being the last."""

    def take(state: Column, unit: Column) -> Column:
        mixed = _times(_turned(_times(unit["u"], MURMUR_FACTORS[0]), 15), MURMUR_FACTORS[1])
        met = state.bitwiseXOR(mixed)
        return F.when(unit["whole"], _low(_turned(met, 13) * 5 + 0xE6546B64)).otherwise(met)

    taken = F.aggregate(units, _long(seed & _LOW), take).bitwiseXOR(n_bytes.cast("long"))
    last = F.array(
        *[
            F.struct(F.lit(bits).alias("bits"), F.lit(f - (1 << 32) if f >> 31 else f).cast("long").alias("f"))
            for bits, f in MURMUR_FINAL
        ]
    )
    return F.aggregate(last, taken, lambda h, s: _times(h.bitwiseXOR(_right(h, s["bits"])), s["f"]))


def _as_unit(value: Column, whole: Column | bool = True) -> Column:
    return F.struct(value.alias("u"), (F.lit(whole) if isinstance(whole, bool) else whole).alias("whole"))


def murmur3_text(text: Column, seed: int = 0) -> Column:
    """MurmurHash3, 32 bits, of a text: a bigint from 0 to 2**32 - 1."""
    n_bytes, text_hex = F.octet_length(text), F.hex(F.encode(text, "UTF-8"))
    full = _whole(n_bytes, 4)
    units = F.transform(_from_zero(full), lambda i: _as_unit(_unit(text_hex, i), i < full))
    return _murmur(units, n_bytes, seed)


def murmur3_int(number: Column, seed: int = 0) -> Column:
    """MurmurHash3 of a whole number of 32 bits."""
    unit = _low(number.cast("int").cast("long"))
    return F.when(number.isNotNull(), _murmur(F.array(_as_unit(unit)), F.lit(4), seed))


def murmur3_long(number: Column, seed: int = 0) -> Column:
    """MurmurHash3 of a whole number of 64 bits."""
    value = number.cast("long")
    units = F.array(_as_unit(_low(value)), _as_unit(_right(value, 32)))
    return F.when(number.isNotNull(), _murmur(units, F.lit(8), seed))


# SipHash


def _sum(a: Column, b: Column) -> Column:
    """Sum modulo 2**64, by halves, as a bigint's own sum may not overflow."""
    low = _low(a) + _low(b)
    high = _right(a, 32) + _right(b, 32) + _right(low, 32)
    return _left(high, 32).bitwiseOR(_low(low))


def _sip_state(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))


def _half_round(state: Column, turn: Column) -> Column:
    """Half a round; the second half is the first with ``a`` and ``c`` in each other's place."""

    def rotated(value: Column, bits: Column) -> Column:
        return _left(value, bits).bitwiseOR(_right(value, F.lit(64) - bits))

    first, second = _sum(state["a"], state["b"]), _sum(state["c"], state["d"])
    return _sip_state(
        second,
        rotated(state["b"], turn["b"]).bitwiseXOR(first),
        rotated(first, F.lit(32)),
        rotated(state["d"], turn["d"]).bitwiseXOR(second),
    )


def _rounds(state: Column, number: int, finish=None) -> Column:
    turns = F.array(
        *[F.struct(F.lit(b).alias("b"), F.lit(d).alias("d")) for b, d in SIP_TURNS * number]
    )
    return F.aggregate(turns, state, _half_round, finish)


def _sip(words: Column, key: tuple[int, int]) -> Column:
    start = [_long(value ^ key[i % 2]) for i, value in enumerate(SIP_START)]

    def take(state: Column, word: Column) -> Column:
        met = _sip_state(state["a"], state["b"], state["c"], state["d"].bitwiseXOR(word))
        return _rounds(
            met, 2, lambda s: _sip_state(s["a"].bitwiseXOR(word), s["b"], s["c"], s["d"])
        )

    def last(state: Column) -> Column:
        met = _sip_state(state["a"], state["b"], state["c"].bitwiseXOR(_long(0xFF)), state["d"])
        return _rounds(
            met,
            4,
            lambda s: s["a"].bitwiseXOR(s["b"]).bitwiseXOR(s["c"]).bitwiseXOR(s["d"]),
        )

    return F.aggregate(words, _sip_state(*start), take, last)


def sip_key(key: bytes) -> tuple[int, int]:
    """The two words of a key of 16 bytes."""
    if len(key) != 16:
        raise ValueError("a key has 16 bytes")
    return int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")


def siphash_text(text: Column, key: bytes) -> Column:
    """SipHash-2-4 of a text under a key of 16 bytes: a bigint."""
    n_bytes, text_hex = F.octet_length(text), F.hex(F.encode(text, "UTF-8"))
    full = _whole(n_bytes, 8)
    ending = _left(n_bytes.cast("long"), 56)

    def word(i: Column) -> Column:
        read = _left(_unit(text_hex, i * 2 + 1), 32).bitwiseOR(_unit(text_hex, i * 2))
        return F.when(i < full, read).otherwise(read.bitwiseOR(ending))

    return _sip(F.transform(_from_zero(full), word), sip_key(key))


def siphash_int(number: Column, key: bytes) -> Column:
    """SipHash-2-4 of a whole number of 32 bits."""
    word = _low(number.cast("int").cast("long")).bitwiseOR(_long(4 << 56))
    return F.when(number.isNotNull(), _sip(F.array(word), sip_key(key)))


def siphash_long(number: Column, key: bytes) -> Column:
    """SipHash-2-4 of a whole number of 64 bits."""
    words = F.array(number.cast("long"), _long(8 << 56))
    return F.when(number.isNotNull(), _sip(words, sip_key(key)))


def bytes_in_hex(value: Column, n_bytes: int) -> Column:
    """A hash as its bytes in hex, lowest byte first."""
    digits = F.lpad(F.lower(F.hex(value)), 2 * n_bytes, "0")
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def murmur3_sql(number: str, source: str, seed: int = 0) -> str:
    """DuckDB SQL of :func:`murmur3_long`: the columns of ``source`` and ``hash``."""
    c1, c2 = MURMUR_FACTORS
    taken = f"SELECT *, {seed}::HUGEINT AS h, ({number}::HUGEINT + {1 << 64}) % {1 << 64} AS m FROM {source}"
    for at in (0, 32):
        for step in (
            f"* REPLACE (h AS h), (((m >> {at}) & {_LOW}) * {c1}) & {_LOW} AS k",
            f"* REPLACE (((((k * 32768) & {_LOW}) | (k >> 17)) * {c2}) & {_LOW} AS k)",
            "* REPLACE (xor(h, k) AS h)",
            f"* EXCLUDE (k) REPLACE (((((h * 8192) & {_LOW}) | (h >> 19)) * 5 + {0xE6546B64}) & {_LOW} AS h)",
        ):
            taken = f"SELECT {step} FROM ({taken})"
    taken = f"SELECT * REPLACE (xor(h, 8::HUGEINT) AS h) FROM ({taken})"
    for bits, factor in MURMUR_FINAL:
        taken = f"SELECT * REPLACE ((xor(h, h >> {bits}) * {factor}) & {_LOW} AS h) FROM ({taken})"
    return f"SELECT * EXCLUDE (h, m), h::BIGINT AS hash FROM ({taken})"


def siphash_sql(number: str, source: str, key: bytes) -> str:
    """DuckDB SQL of :func:`siphash_long`: the columns of ``source`` and ``hash``, unsigned."""
    words, size = sip_key(key), 1 << 64
    start = [value ^ words[i % 2] for i, value in enumerate(SIP_START)]
    named = ", ".join(f"{value}::HUGEINT AS v{i}" for i, value in enumerate(start))
    taken = f"SELECT *, {named}, ({number}::HUGEINT + {size}) % {size} AS m FROM {source}"

    def rotated(value: str, bits: int) -> str:
        return f"(({value} * {1 << bits}::HUGEINT) % {size} | ({value} >> {64 - bits}))"

    def rounds(text: str, number: int) -> str:
        for b, d in SIP_TURNS * number:
            text = f"SELECT *, (v0 + v1) % {size} AS s, (v2 + v3) % {size} AS t FROM ({text})"
            text = (
                f"SELECT * EXCLUDE (s, t) REPLACE (t AS v0, xor({rotated('v1', b)}, s) AS v1,"
                f" {rotated('s', 32)} AS v2, xor({rotated('v3', d)}, t) AS v3) FROM ({text})"
            )
        return text

    for word in ("m", f"{8 << 56}::HUGEINT"):
        taken = rounds(f"SELECT * REPLACE (xor(v3, {word}) AS v3) FROM ({taken})", 2)
        taken = f"SELECT * REPLACE (xor(v0, {word}) AS v0) FROM ({taken})"
    taken = rounds(f"SELECT * REPLACE (xor(v2, 255::HUGEINT) AS v2) FROM ({taken})", 4)
    return (
        "SELECT * EXCLUDE (v0, v1, v2, v3, m), xor(xor(v0, v1), xor(v2, v3)) AS hash"
        f" FROM ({taken})"
    )
