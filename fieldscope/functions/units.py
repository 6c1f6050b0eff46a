"""Column functions over field units and payload values.

Values are hex texts of fixed width (one digit per started 4 bits), so fields of
any width keep exact values; byte order is handled by reversing byte pairs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_left(value: Column, n: Column) -> Column:
    return F.call_function("shiftleft", value, n)


def shift_right(value: Column, n: Column) -> Column:
    """Unsigned shift by a column."""
    return F.call_function("shiftrightunsigned", value, n)


def byte_repr(a: Column, b: Column) -> Column:
    return F.when(a == b, a.cast("string")).otherwise(F.concat_ws(",", a.cast("string"), b.cast("string")))


def bits_label(bits: Column) -> Column:
    """``[3]``, ``[7:4]`` or ``[0,2,5]`` for a set of bits."""
    s = F.array_sort(F.array_distinct(bits))
    lo, hi = F.array_min(s), F.array_max(s)
    return (
        F.when(F.size(s) == 0, "[]").when(F.size(s) == 1, F.concat(F.lit("["), lo.cast("string"), F.lit("]")))
        .when(hi - lo + 1 == F.size(s), span_label(lo, hi))
        .otherwise(F.concat(F.lit("["), F.array_join(s.cast("array<string>"), ","), F.lit("]")))
    )


def span_label(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, F.concat(F.lit("["), lo.cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), hi.cast("string"), F.lit(":"), lo.cast("string"), F.lit("]"))
    )


def label_bits(label: Column) -> Column:
    """Bits named by a label text; empty when it is not a bracketed label."""
    body = F.regexp_extract(F.trim(label), r"^\[(.*)\]$", 1)
    hi = F.regexp_extract(body, r"^\s*(\d+)\s*:\s*(\d+)\s*$", 1).try_cast("int")
    lo = F.regexp_extract(body, r"^\s*(\d+)\s*:\s*(\d+)\s*$", 2).try_cast("int")
    single = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    return F.when(hi.isNotNull(), F.sequence(F.least(lo, hi), F.greatest(lo, hi))).otherwise(single)


def label_bounds(label: Column) -> Column:
    """struct<lo, hi> of ``[h:l]`` or ``[n]``; null for other labels."""
    wide = r"^\s*\[\s*(\d+)\s*:\s*(\d+)\s*\]\s*$"
    hi, lo = F.regexp_extract(label, wide, 1).try_cast("int"), F.regexp_extract(label, wide, 2).try_cast("int")
    one = F.regexp_extract(label, r"^\s*\[(\d+)\]\s*$", 1).try_cast("int")
    return F.when(hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"))).when(
        one.isNotNull(), F.struct(one.alias("lo"), one.alias("hi"))
    )


def bit_repr(parent: Column, bits: Column) -> Column:
    return F.concat(parent, bits_label(bits))


def unit_dir(repr_: Column) -> Column:
    """Directory-safe form of a unit id."""
    t = F.replace(repr_, F.lit(","), F.lit("_"))
    t = F.replace(F.replace(F.replace(t, F.lit("["), F.lit("__bits_")), F.lit("]"), F.lit("")), F.lit(":"), F.lit("_"))
    t = F.regexp_replace(F.regexp_replace(t, "[^0-9A-Za-z_]+", "_"), "^_+|_+$", "")
    return F.when(t == "", "field").otherwise(t)


def field_key(a: Column, b: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    """Stable join key ``b:a:b`` or ``bit:a:b:lo:hi``."""
    byte = F.concat_ws(":", F.lit("b"), a.cast("string"), b.cast("string"))
    if lo is None:
        return byte
    return F.when(lo.isNull(), byte).otherwise(
        F.concat_ws(":", F.lit("bit"), a.cast("string"), b.cast("string"), lo.cast("string"), hi.cast("string"))
    )


def reverse_bytes(hex_text: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(hex_text, F.lit("([0-9a-f]{2})"), 1)), "")


def _in_order(hex_text: Column, order: str) -> Column:
    return reverse_bytes(hex_text) if order == "little" else hex_text


def read_bytes(payload: Column, a: Column, b: Column, order: str = "big") -> Column:
    """Hex value of payload bytes a..b, most significant digit first."""
    return _in_order(F.lower(F.substring(payload, 2 * a + 1, 2 * (b - a + 1))), order)


_BITS = {f"{i:x}": f"{i:04b}" for i in range(16)}


def _to_bits(hex_text: Column) -> Column:
    """Bit text, most significant bit first."""
    table = F.create_map(*[F.lit(x) for kv in _BITS.items() for x in kv])
    digits = F.filter(F.split(hex_text, ""), lambda c: c != "")
    return F.array_join(F.transform(digits, lambda d: F.element_at(table, d)), "")


def _to_hex(bit_text: Column) -> Column:
    """Hex digits of a bit text whose length is a multiple of 4."""
    table = F.create_map(*[F.lit(x) for k, v in _BITS.items() for x in (v, k)])
    return F.array_join(F.transform(F.regexp_extract_all(bit_text, F.lit("([01]{4})"), 1), lambda q: F.element_at(table, q)), "")


def _pad4(bit_text: Column) -> Column:
    width = (F.ceil(F.length(bit_text) / F.lit(4)) * 4).cast("int")
    return F.lpad(bit_text, width, "0")


def read_bits(payload: Column, a: Column, b: Column, bits: Column, order: str = "big") -> Column:
    """Gathered bits of bytes a..b as hex; bit 0 is the least significant one."""
    text = _to_bits(read_bytes(payload, a, b, order))
    width = F.length(text)
    picked = F.transform(F.reverse(F.array_sort(bits)), lambda i: F.substring(text, width - i, F.lit(1)))
    return _to_hex(_pad4(F.array_join(picked, "")))


def write_bytes(payload: Column, a: Column, b: Column, value_hex: Column, order: str = "big") -> Column:
    """Payload with bytes a..b replaced; too wide values keep their low bytes."""
    digits = (2 * (b - a + 1)).cast("int")
    value = F.substring(F.lpad(value_hex, F.greatest(digits, F.length(value_hex)), "0"), -digits, digits)
    return F.overlay(payload, _in_order(value, order), 2 * a + 1, digits)


def write_bits(payload: Column, a: Column, b: Column, bits: Column, value_hex: Column, order: str = "big") -> Column:
    """Payload with the given bits of bytes a..b replaced by the low bits of the value."""
    old = _to_bits(read_bytes(payload, a, b, order))
    width = F.length(old)
    ordered = F.array_sort(bits)
    new = F.lpad(_to_bits(value_hex), F.greatest(F.size(ordered), 4 * F.length(value_hex)), "0")
    merged = F.transform(
        F.sequence(F.lit(1), width),
        lambda p: F.when(
            F.array_contains(ordered, width - p),
            F.substring(new, F.length(new) - F.array_position(ordered, width - p).cast("int") + 1, F.lit(1)),
        ).otherwise(F.substring(old, p, F.lit(1))),
    )
    return write_bytes(payload, a, b, _to_hex(F.array_join(merged, "")), order)


# 2^0 .. 2^64 as exact decimals.
_POWERS = [Decimal(2**i) for i in range(65)]


def power_of_two(bits: Column) -> Column:
    """2^bits for 0 <= bits <= 64, exact."""
    return F.element_at(F.array(*[F.lit(p).cast("decimal(20,0)") for p in _POWERS]), bits + 1)


def mask_value(value: Column, width_bits: Column) -> Column:
    """Low ``width_bits`` of a (signed) value of at most 64 bits, as decimal(20,0)."""
    w = F.least(width_bits, F.lit(64))
    return F.pmod(value.cast("decimal(21,0)"), power_of_two(w)).cast("decimal(20,0)")


def value_hex(value: Column, width_bits: Column) -> Column:
    """Fixed-width hex digits of an unsigned decimal value."""
    digits = F.greatest(F.ceil(width_bits / F.lit(4)), F.lit(1)).cast("int")
    raw = F.lower(F.conv(value.cast("decimal(20,0)").cast("string"), 10, 16))
    return F.lpad(raw, F.greatest(digits, F.length(raw)), "0")


def number_hex(text: Column) -> Column:
    """``[-]digits``: a signed number text (0x hex of any length, or decimal up to 64 bits) as lower-case hex; null if it is none."""

    def read(t):
        body = F.regexp_replace(t, "^[+-]", "")
        decimal = F.when(body.rlike(r"^\d{1,20}$") & (body.try_cast("decimal(20,0)") < F.lit(Decimal(2**64))), F.lower(F.conv(body, 10, 16)))
        digits = F.when(body.rlike("^0x[0-9a-f]+$"), F.substring(body, 3, 1 << 30)).otherwise(decimal)
        return bind(F.regexp_replace(digits, "^0+(?=.)", ""), lambda d: F.when(t.startswith("-") & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d))

    return bind(F.lower(F.trim(text)), read)


def fixed_hex(number: Column, width_bits: Column) -> Column:
    """The low ``width_bits`` of a ``number_hex``, two's complement, as fixed-width hex digits; any width."""
    digits = F.greatest(F.ceil(width_bits / F.lit(4)), F.lit(1)).cast("int")

    def cut(n):
        low = bind(F.regexp_replace(n, "^-", ""), lambda body: F.substring(F.lpad(body, F.greatest(digits, F.length(body)), "0"), -digits, digits))
        turn = lambda v: F.when(n.startswith("-"), bind(F.translate(v, "0123456789abcdef", "fedcba9876543210"), lambda f: _bump(f, True))).otherwise(v)
        return bind(bind(low, turn), lambda v: mask_hex(v, width_bits))

    return bind(number, cut)


def hex_bits(digits: Column) -> Column:
    """Numbers of the set bits of hex digits, lowest first; any width."""

    def read(h):
        value = lambda k: F.conv(F.substring(h, F.length(h) - k, F.lit(1)), 16, 10).cast("int")
        four = lambda k: bind(value(k), lambda v: F.filter(F.sequence(k * 4, k * 4 + 3), lambda i: shift_right(v, F.pmod(i, F.lit(4))).bitwiseAND(1) == 1))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.length(h) - 1), four))

    return bind(digits, read)


def _bump(high: Column, up: bool) -> Column:
    """High hex part plus or minus one, modulo its width."""
    fill, edge = ("0", "f") if up else ("f", "0")
    run = F.length(F.regexp_extract(high, f"({edge}*)$", 1))
    keep = F.length(high) - run
    table = ("0123456789abcde", "123456789abcdef") if up else ("123456789abcdef", "0123456789abcde")
    digit = F.translate(F.substring(high, keep, F.lit(1)), *table)
    return F.when(keep == 0, F.repeat(F.lit(fill), run)).otherwise(
        F.concat(F.substring(high, F.lit(1), keep - 1), digit, F.repeat(F.lit(fill), run))
    )


def bind(value: Column, fn) -> Column:
    """fn(value) with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def hex_add(value: Column, delta: int, width_bits: Column) -> Column:
    """value + delta modulo 2^width for a fixed-width hex value and |delta| < 2^31."""

    def narrow(v):
        mask = shift_left(F.lit(1).cast("long"), width_bits) - 1
        total = (F.conv(v, 16, 10).cast("long") + F.lit(delta)).bitwiseAND(mask)
        return F.lpad(F.lower(F.hex(total)), F.length(v), "0")

    def wide(v):
        # The low 12 digits are a number, the rest only moves on a carry.
        cut = F.length(v) - 12
        span = F.lit(1 << 48)
        high = F.substring(v, F.lit(1), cut)

        def join(low):
            moved = F.when(low < 0, _bump(high, False)).when(low >= span, _bump(high, True)).otherwise(high)
            return mask_hex(F.concat(moved, F.lpad(F.lower(F.hex(F.pmod(low, span))), 12, "0")), width_bits)

        return bind(F.conv(F.substring(v, -12, 12), 16, 10).cast("long") + F.lit(delta), join)

    return bind(value, lambda v: F.when(F.length(v) <= 15, narrow(v)).otherwise(wide(v)))


def mask_hex(value: Column, width_bits: Column) -> Column:
    """Clear the unused high bits of the first digit when the width is no multiple of 4."""
    spare = F.pmod(width_bits, F.lit(4)).cast("int")
    first = F.conv(F.substring(value, 1, 1), 16, 10).cast("int").bitwiseAND(shift_left(F.lit(1), spare) - 1)
    return F.when(spare == 0, value).otherwise(F.concat(F.lower(F.hex(first)), F.substring(value, F.lit(2), F.length(value))))


def max_hex(width_bits: Column) -> Column:
    digits = F.greatest(F.ceil(width_bits / F.lit(4)), F.lit(1)).cast("int")
    return mask_hex(F.repeat(F.lit("f"), digits), width_bits)
