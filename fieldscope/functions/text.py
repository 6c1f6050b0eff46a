"""Column functions over trace text: byte index sets, operand values, immediates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den as double, ``default`` when the denominator is 0."""
    return F.when(den == 0, F.lit(default)).otherwise(num.cast("double") / den.cast("double"))


def _ints(found: Column) -> Column:
    return F.transform(found, lambda x: x.try_cast("int"))


# Most index texts are plain lists, which need no pattern search.
_LIST = "^[0-9]+(,[0-9]+)*$"


def _listed(idx: Column) -> Column:
    return F.array_distinct(_ints(F.split(idx, ",")))


def _numbers(text: Column) -> Column:
    return F.array_distinct(_ints(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+)"), 1)))


def index_plain(idx: Column) -> Column:
    """Numbers of an index text, distinct; ranges are not expanded."""
    return F.when(idx.rlike(_LIST), _listed(idx)).otherwise(_numbers(idx))


def _expand(text: Column, pattern: str) -> Column:
    los = F.regexp_extract_all(text, F.lit(pattern), 1)
    his = F.regexp_extract_all(text, F.lit(pattern), 2)
    pairs = F.arrays_zip(los.alias("lo"), his.alias("hi"))
    return F.flatten(
        F.transform(
            pairs,
            lambda p: F.sequence(
                F.least(p["lo"].cast("int"), p["hi"].cast("int")),
                F.greatest(p["lo"].cast("int"), p["hi"].cast("int")),
            ),
        )
    )


def index_expanded(idx: Column) -> Column:
    """Numbers of an index text; ``(a:b)``, ``(a,b)`` and ``a-b`` stand for whole ranges."""
    text = F.coalesce(idx, F.lit(""))
    paren = _expand(text, r"\((\d+)\s*[,:\-]\s*(\d+)\)")
    dash = _expand(text, r"(\d+)\s*-\s*(\d+)")
    ranged = F.array_sort(F.array_distinct(F.concat(paren, dash, _numbers(text))))
    return F.when(idx.rlike(_LIST), F.array_sort(_listed(idx))).otherwise(ranged)


def index_part(part: Column) -> Column:
    """Numbers of one ``;`` part; a parenthesised range alone decides when present."""
    paren = r"\(\s*(\d+)\s*[,:\-]\s*(\d+)\s*\)"
    only = F.sequence(
        F.least(F.regexp_extract(part, paren, 1).try_cast("int"), F.regexp_extract(part, paren, 2).try_cast("int")),
        F.greatest(F.regexp_extract(part, paren, 1).try_cast("int"), F.regexp_extract(part, paren, 2).try_cast("int")),
    )
    open_form = F.array_sort(F.array_distinct(F.concat(_expand(part, r"\b(\d+)\s*-\s*(\d+)\b"), _numbers(part))))
    return F.when(part.rlike(paren), only).otherwise(open_form)


def runs_of(sorted_ints: Column) -> Column:
    """Contiguous runs of a sorted distinct int array as array<struct<a,b>>."""

    def grow(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        longer = F.array(F.struct(last["a"].alias("a"), x.alias("b")))
        return F.when(last["b"] == x - 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(
            F.concat(acc, F.array(F.struct(x.alias("a"), x.alias("b"))))
        )

    return F.aggregate(sorted_ints, F.array().cast("array<struct<a:int,b:int>>"), grow)


def index_groups(idx: Column) -> Column:
    """Contiguous byte runs of every ``;`` part, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(idx, F.lit("")), ";"), lambda x: F.trim(x)), lambda p: p != "")
    general = F.flatten(F.transform(parts, lambda p: runs_of(index_part(p))))
    return F.when(idx.rlike(_LIST), runs_of(F.array_sort(_listed(idx)))).otherwise(general)


# Operand values are unsigned 64-bit.
WIDE = "decimal(20,0)"
# Fixed number formats of operand text.
_HEX = r"(?<![0-9A-Za-z_])(-?0x[0-9a-fA-F]+)"
_DEC = r"(?<![0-9A-Za-z_])(-?\d+)"


def hex_value(text: Column) -> Column:
    """Unsigned value of hex digits (optional 0x), up to 64 bits; null when malformed."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,16}$"), F.conv(digits, 16, 10).try_cast(WIDE))


def immediates(operands: Column) -> Column:
    """Constants of an operand text, memory operands skipped; hex before decimal per operand."""
    ops = F.filter(F.split(F.coalesce(operands, F.lit("")), ","), lambda o: ~(o.contains("[") & o.contains("]")))

    def one(op):
        hexes = F.transform(F.regexp_extract_all(op, F.lit(_HEX), 1), _signed_hex)
        rest = F.regexp_replace(op, _HEX, " ")
        decs = F.transform(F.regexp_extract_all(rest, F.lit(_DEC), 1), lambda d: d.try_cast(WIDE))
        return F.concat(hexes, decs)

    return F.filter(F.array_distinct(F.flatten(F.transform(ops, one))), lambda v: v.isNotNull())


def _signed_hex(t: Column) -> Column:
    magnitude = hex_value(F.regexp_replace(t, "^-", ""))
    return F.when(t.startswith("-"), -magnitude).otherwise(magnitude).cast(WIDE)


def untainted_values(info: Column) -> Column:
    """Constants on the sides of an operand-value text that carry no ``*`` mark."""
    tokens = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda t: t.contains("="))
    clean = F.filter(tokens, lambda t: ~F.substring_index(t, "=", 1).contains("*"))
    values = F.transform(clean, lambda t: immediates(F.regexp_replace(t, "^[^=]*=", "")))
    return F.array_distinct(F.flatten(values))


def operand_pairs(info: Column) -> Column:
    """array<struct<side, tainted, value>> of an operand-value text: ``SIDE = value`` parts, signed hex or decimal.

    A part whose value is no number is left out.
    """
    text = F.coalesce(info, F.lit(""))
    # Fixed format of a part: a name that may hold the mark, and all up to the next ; or tab.
    pattern = r"([A-Za-z0-9_*]+)\s*=\s*([^;\t]+)"
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("side"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("value"))

    def number(raw):
        t = F.lower(F.trim(raw))
        return F.when(t.rlike("^-?0x[0-9a-f]+$"), _signed_hex(t)).when(t.rlike(r"^[+-]?\d+$"), t.try_cast(WIDE))

    parts = F.transform(
        zipped,
        lambda p: F.struct(F.replace(p["side"], F.lit("*"), F.lit("")).alias("side"), p["side"].contains("*").alias("tainted"), number(p["value"]).alias("value")),
    )
    return F.filter(parts, lambda p: p["value"].isNotNull())
