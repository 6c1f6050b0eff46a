"""Bit-field recovery from explicit mask, shift, test and compare instructions.

Events are one row per use of a field's bits.  They may also come from a tracer
that knows bit provenance (kind ``mov_derived``); every rule below only reads
the event table.  After grouping by bit set the tables hold one row per distinct
set of a field, and after ``split_runs`` at most width*(width+1)/2 rows per field.

Spans carry where they come from: ``sources`` names the bit sets that went into a span, united
when spans merge and kept when they are split or shrunk.  Constraints and evidence lines are not dragged
through these steps; ``span_events`` joins them to the final spans by source.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.ordered import line_block, many, next_row
from fieldscope.functions.text import hex_value, index_plain, operand_pairs, runs_of
from fieldscope.functions.units import bind, fixed_hex, hex_bits, number_hex, shift_left, shift_right, span_label
from fieldscope.operators.trace import after_first_taint, branch_outcome

# Fixed event kinds.
OPERATIONS = ["and", "or", "xor", "shr", "sar", "shl", "sal", "test_mask"]
WEAK = ["and", "or", "xor", "shr", "sar", "shl", "sal", "mov_derived"]
COMPARES = ["cmp", "test_mask", "test_reg"]
SHIFTS = ["shr", "sar", "shl", "sal"]
MODES = ["full", "operation_driven", "flat_evidence"]

KEY = ["run_id", "field_id"]


def resolve_field(trace: DataFrame, fields: DataFrame) -> DataFrame:
    """Attach the one field an index text stands for.

    ``fields``: run_id, field_id, a, b.  A token equal to exactly one field id
    wins; else the token spans must name exactly one field.
    """
    named = fields.select("run_id", "field_id", "a", "b").distinct()
    tokens = F.filter(F.transform(F.split(F.coalesce("idx_raw", F.lit("")), ";"), lambda x: F.trim(x)), lambda t: (t != "") & (t != "-"))
    numbers = lambda t: F.array_sort(index_plain(t))
    tight = lambda n: (F.size(n) > 0) & (F.array_max(n) - F.array_min(n) + 1 == F.size(n))
    # Equal index texts of a run name the same field: each text is looked up once.
    texts = trace.select("run_id", "idx_raw").distinct().withColumn("_tokens", tokens)
    exact = texts.withColumn("field_id", F.explode("_tokens")).join(many(named), ["run_id", "field_id"]).withColumn("_far", F.lit(0))
    spans = texts.select("run_id", "idx_raw", F.explode(F.filter(F.transform("_tokens", numbers), tight)).alias("_s"))
    near = spans.select("run_id", "idx_raw", F.array_min("_s").alias("a"), F.array_max("_s").alias("b")).join(many(named), ["run_id", "a", "b"]).withColumn("_far", F.lit(1))
    cols = ["run_id", "idx_raw", "_far", "field_id", "a", "b"]
    met = exact.select(*cols).unionByName(near.select(*cols)).distinct()
    sole = met.groupBy("run_id", "idx_raw", "_far").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("field_id", "a", "b")).alias("_h")).where("_n = 1")
    found = sole.groupBy("run_id", "idx_raw").agg(F.min_by("_h", "_far").alias("_h"))
    return trace.join(many(found), ["run_id", "idx_raw"]).select(
        *trace.columns, F.col("_h.field_id").alias("field_id"), ((F.col("_h.b") - F.col("_h.a") + 1) * 8).alias("width")
    )


def _immediate(op: Column) -> Column:
    t = F.trim(op)
    value = F.when(t.rlike("^-?0x[0-9a-fA-F]+$"), hex_value(F.regexp_replace(t, "^-", ""))).when(
        t.rlike(r"^-?\d+$"), F.regexp_replace(t, "^-", "").try_cast("decimal(20,0)")
    )
    return _as_bits(F.when(t.startswith("-"), -value).otherwise(value))


def _as_bits(value: Column) -> Column:
    """The 64 bits of a value in -2^63 .. 2^64 - 1 as a long."""
    wide = value.cast("decimal(22,0)")
    return F.when(wide >= F.lit(Decimal(2**63)), wide - F.lit(Decimal(2**64))).otherwise(wide).try_cast("long")


def mask_bits(mask: Column, width: Column) -> Column:
    """Set bits of a 64-bit mask below ``width``."""
    return F.filter(
        F.sequence(F.lit(0), F.least(width, F.lit(64)) - 1), lambda i: shift_right(mask, i).bitwiseAND(1) == 1
    )


def bit_use_events(events: DataFrame, fields: DataFrame, compat_branch: bool = False) -> DataFrame:
    """Bit-use events of instructions with an explicit mask, shift, test or compare.

    A ``test`` takes its constraint from the next instruction of its run.
    ``compat_branch`` treats a not-taken branch as taken, as the mark contains it.
    """
    live = after_first_taint(events).where((F.col("kind") == "Instruction") & F.col("disasm").isNotNull())
    taken = F.col("payload").contains("TAKEN") if compat_branch else F.coalesce(branch_outcome(strict=True) == "TAKEN", F.lit(False))
    follow = F.struct(F.lower(F.regexp_extract("disasm", r"^\s*[jJ]([A-Za-z]+)\b", 1)).alias("cc"), taken.alias("taken"))
    d = next_row(live, ["run_id"], F.col("line_no"), line_block(), follow, "next")
    d = d.where(F.col("mnemonic").isin("and", "or", "xor", "test", "cmp", *SHIFTS))
    d = resolve_field(d, fields)
    ops = F.transform(F.split(F.regexp_replace("disasm", r"^\S+\s*", ""), ","), lambda x: F.trim(x))
    d = d.withColumn("ops", ops).where(F.size("ops") == 2)
    left, right = F.get("ops", F.lit(0)), F.get("ops", F.lit(1))
    runtime = F.get(F.filter(operand_pairs(F.col("info_raw")), lambda p: ~p["tainted"]), F.lit(0))["value"]
    runtime = _as_bits(runtime)
    # Masks of fields wider than 64 bits are read from the text, whatever their length.
    clean = F.regexp_extract(F.coalesce("info_raw", F.lit("")), r"(?:^|[;\t])\s*[A-Za-z0-9_]+\s*=\s*(-?(?:0x[0-9a-fA-F]+|\d+))\s*(?:[;\t]|$)", 1)
    d = d.withColumn("wide_mask", F.when(F.col("width") > 64, F.coalesce(number_hex(right), number_hex(clean))))
    d = d.withColumn("imm", _immediate(right)).withColumn("known", F.coalesce("imm", runtime))
    m = F.col("mnemonic")
    logic, shift = m.isin("and", "or", "xor"), m.isin(SHIFTS)
    kind = (
        F.when(logic & (F.col("known").isNotNull() | F.col("wide_mask").isNotNull()) & ~((m == "xor") & (F.lower(left) == F.lower(right))), m)
        .when(shift & (F.col("imm").isNotNull() | ~right.contains("[")), m)
        .when((m == "test") & F.col("imm").isNotNull(), "test_mask")
        .when(m == "test", "test_reg")
        .when(m == "cmp", "cmp")
    )
    mask = F.when(logic, F.col("known")).when(m == "test", F.col("imm"))
    full = F.sequence(F.lit(0), F.col("width") - 1)
    d = d.select(
        "run_id", "field_id", "width", "line_no", "addr", "disasm", kind.alias("event_kind"),
        F.when((logic | (m == "test")) & F.col("wide_mask").isNotNull(), hex_bits(fixed_hex(F.col("wide_mask"), F.col("width"))))
        .when(mask.isNotNull(), mask_bits(mask, F.col("width"))).otherwise(full).alias("bits"),
        mask.alias("mask"), F.when(shift, F.col("imm")).alias("shift"),
        F.when(m == "cmp", F.col("known")).alias("compare_value"),
        (shift & F.col("imm").isNull()).alias("variable_shift"), "next",
    ).where(F.col("event_kind").isNotNull() & (F.size("bits") > 0))
    return close_tests(d).drop("next")


def close_tests(d: DataFrame) -> DataFrame:
    """Add the constraint of each event; pending tests read the ``next`` instruction."""
    cc, taken = F.col("next.cc"), F.col("next.taken")
    is_test = F.col("event_kind").isin("test_mask", "test_reg")
    op = (
        F.when(F.col("event_kind") == "cmp", F.when(F.col("compare_value").isNotNull(), "eq"))
        .when(~is_test | F.col("next").isNull(), None)
        .when(cc.isin("z", "e"), F.when(taken, "zero").otherwise("nonzero"))
        .when(cc.isin("nz", "ne"), F.when(taken, "nonzero").otherwise("zero"))
        .when(cc == "s", F.when(taken, "nonzero").otherwise("zero"))
        .when(cc == "ns", F.when(taken, "zero").otherwise("nonzero"))
        .when(cc == "", "nonzero")
    )
    sign = is_test & F.coalesce(cc.isin("s", "ns"), F.lit(False))
    top = F.array(F.array_max("bits"))
    d = d.withColumn("_op", op).withColumn("_bits", F.when(sign, top).otherwise(F.col("bits")))
    mask = F.when(~sign & (F.col("event_kind") == "test_mask"), F.col("mask"))
    return d.withColumn(
        "constraint", F.when(F.col("_op").isNotNull(), bit_constraint(F.col("_bits"), F.col("_op"), F.col("compare_value"), mask))
    ).drop("_op", "_bits")


def bits_mask_hex(bits: Column) -> Column:
    """Hex digits of the mask of a bit set, any width."""
    nibble = lambda n: F.aggregate(
        F.sequence(F.lit(0), F.lit(3)), F.lit(0),
        lambda acc, k: acc + F.when(F.array_contains(bits, n * 4 + k), shift_left(F.lit(1), k)).otherwise(0),
    )
    top = (F.array_max(bits) / 4).cast("int")
    return F.array_join(F.transform(F.sequence(top, F.lit(0), F.lit(-1)), lambda n: F.lower(F.hex(nibble(n)))), "")


def bits_name(bits: Column) -> Column:
    s = F.array_sort(bits)
    lo, hi = F.array_min(s), F.array_max(s)
    return (
        F.when(F.size(s) == 1, F.concat(F.lit("bit"), lo.cast("string")))
        .when(hi - lo + 1 == F.size(s), F.format_string("bits[%d:%d]", hi, lo))
        .otherwise(F.concat(F.lit("bits{"), F.array_join(s.cast("array<string>"), ","), F.lit("}")))
    )


def bit_constraint(bits: Column, op: Column, value: Column, explicit_mask: Column | None = None) -> Column:
    """struct<mask, operator, value, subfield_constraint, expression> of a bit set."""
    size, lo = F.size(bits), F.array_min(bits)
    hi = F.array_max(bits)
    tight = hi - lo + 1 == size
    one = F.lit(1).cast("long")
    summed = F.when(tight, shift_left(shift_left(one, size) - 1, lo)).otherwise(
        F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(shift_left(one, b)))
    )
    own_long = F.when(hi <= 62, summed).otherwise(F.conv(F.substring(bits_mask_hex(bits), -16, 16), 16, -10).cast("long"))
    mask_long = own_long if explicit_mask is None else F.coalesce(explicit_mask, own_long)
    own_text = F.when(hi <= 62, F.lower(F.hex(summed))).otherwise(F.regexp_replace(bits_mask_hex(bits), "^0+(?=.)", ""))
    mask_text = own_text if explicit_mask is None else F.coalesce(F.lower(F.hex(explicit_mask)), own_text)
    fits = (value >= 0) & ((size >= 63) | (value < shift_left(F.lit(1).cast("long"), size)))
    # Beyond bit 62 the masked value is a set of bits.
    held = F.array_intersect(hex_bits(fixed_hex(number_hex(value.cast("string")), hi + 1)), F.array_sort(bits))
    digits = lambda some: bind(some, lambda b: F.when(F.size(b) == 0, "0").otherwise(F.regexp_replace(bits_mask_hex(b), "^0+(?=.)", "")))
    wide = bind(digits(F.transform(held, lambda b: b - lo)), lambda h: F.when(F.length(h) <= 16, F.conv(h, 16, 10)).otherwise(F.concat(F.lit("0x"), h)))
    inner = F.when(~tight | fits, value.cast("string")).when(hi <= 62, shift_right(value.bitwiseAND(mask_long), lo).cast("string")).otherwise(wide)
    masked = F.when(hi <= 62, F.lower(F.hex(value.bitwiseAND(mask_long)))).otherwise(digits(held))
    name = bits_name(bits)
    plain_span = tight & (F.lit(True) if explicit_mask is None else (explicit_mask.isNull() | (explicit_mask == own_long)))
    eq = (
        F.when(size == 1, F.concat(name, F.lit(" == "), F.when(F.substring(inner, -1, 1).isin(*"13579"), "1").otherwise("0")))
        .when(plain_span, F.concat(name, F.lit(" == "), inner))
        .otherwise(F.concat(name, F.lit(" == 0x"), masked))
    )
    nonzero = F.when(size == 1, F.concat(name, F.lit(" == 1"))).otherwise(F.concat(name, F.lit(" != 0")))
    sub = F.when(op == "zero", F.concat(name, F.lit(" == 0"))).when(op == "nonzero", nonzero).when(op == "eq", eq)
    return F.struct(
        F.concat(F.lit("0x"), mask_text).alias("mask"),
        op.alias("operator"),
        F.when(op == "eq", F.concat(F.lit("0x"), F.lower(F.hex(value)))).alias("value"),
        sub.alias("subfield_constraint"), sub.alias("expression"),
    )


def events_for_mode(events: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unsupported recovery mode: {mode!r}")
    return events.where(F.col("event_kind").isin(OPERATIONS)) if mode == "operation_driven" else events


def bitfield_decision(events: DataFrame, mode: str = "full", keys: Sequence[str] = KEY) -> DataFrame:
    """Is the field a bit field?  One aggregation and three vetoes."""
    e = events_for_mode(events, mode)
    kind, size, width = F.col("event_kind"), F.size("bits"), F.col("width")
    part = size < width
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    many = (
        ((kind == "and") & F.col("mask").isNotNull() & (F.col("mask") != 1)) | (kind == "cmp")
        | ((size != 1) & kind.isin("and", *COMPARES))
    )
    g = e.groupBy(*keys).agg(
        F.max("width").alias("width"),
        flag(part & kind.isin(OPERATIONS)).alias("strong"),
        flag(part).alias("partial"),
        F.count_if(~part & kind.isin("cmp", "test_reg")).alias("full_compares"),
        F.min(F.when(~part & kind.isin("cmp", "test_reg"), F.col("line_no"))).alias("first_full_compare"),
        F.min(F.when(part, F.col("line_no"))).alias("first_partial"),
        F.count_if(part & kind.isin(COMPARES)).alias("partial_compares"),
        F.min(F.when(part & kind.isin(COMPARES), size)).alias("smallest_partial_compare"),
        flag(part & ~kind.isin(WEAK)).alias("beyond_weak"),
        flag(F.col("variable_shift")).alias("variable_shift"),
        flag(many).alias("beyond_single_bit"),
    )
    scan = F.col("variable_shift") & ~F.col("beyond_single_bit") & (F.col("partial_compares") == 0)
    found = F.col("strong") | F.col("partial")
    if mode != "flat_evidence":
        whole = (F.col("full_compares") > 0) & (F.col("partial_compares") == 0) & ~F.col("beyond_weak") & ~F.col("strong")
        near_full = (
            (F.col("width") <= 8) & (F.col("full_compares") >= 2) & (F.col("partial_compares") > 0)
            & (F.col("smallest_partial_compare") >= F.col("width") - 2)
            & (F.col("smallest_partial_compare") > F.greatest(F.lit(1), F.floor(F.col("width") / 2)))
        )
        found = found & ~whole & ~F.coalesce(near_full, F.lit(False)) & ~scan
    early = F.col("first_partial").isNotNull() & (
        F.col("first_full_compare").isNull() | (F.col("first_partial") < F.col("first_full_compare"))
    )
    return g.select(
        *keys, "width", found.alias("is_bitfield"), "first_full_compare", early.alias("partial_first"), scan.alias("bit_scan")
    )


def subfield_candidates(events: DataFrame, decision: DataFrame, mode: str = "full", keys: Sequence[str] = KEY) -> DataFrame:
    """One row per distinct partial bit set with support, ratio, flags, kind and confidence."""
    keys = list(keys)
    e = events_for_mode(events, mode).where(F.size("bits") < F.col("width"))
    kind = F.col("event_kind")
    g = e.groupBy(*keys, "bits").agg(
        F.count(F.lit(1)).alias("support"),
        F.bool_or(kind.isin(COMPARES) | F.col("compare_value").isNotNull()).alias("compare_like"),
        F.bool_or(kind.isin("and", "or", "xor", *SHIFTS)).alias("arith_like"),
        F.bool_or(kind == "mov_derived").alias("derived"),
        F.bool_and(kind.isin(WEAK)).alias("weak_only"),
        F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
        F.array_sort(F.collect_set("event_kind")).alias("kinds"),
        F.count_distinct(F.when(F.col("constraint").isNotNull(), F.to_json("constraint"))).alias("constraints"),
    )
    # Uses of a bit are summed over the distinct sets that hold it.
    names = [c for c in g.columns if c not in keys and c != "bits"]
    per_bit = g.withColumn("bit", F.explode("bits"))
    uses = per_bit.withColumn("_uses", F.sum("support").over(Window.partitionBy(*keys, "bit")))
    d = uses.groupBy(*keys, "bits").agg(F.max("_uses").alias("_most"), *[F.first(c).alias(c) for c in names])
    d = d.join(many(decision), keys)
    single = F.size("bits") == 1
    tight = F.array_max("bits") - F.array_min("bits") + 1 == F.size("bits")
    d = d.withColumn("together_ratio", F.col("support") / F.greatest("_most", F.lit(1)))
    if mode != "flat_evidence":
        late = (
            F.col("first_full_compare").isNotNull() & F.col("partial_first") & ~F.col("compare_like") & F.col("weak_only")
            & (F.col("first_line") >= F.col("first_full_compare")) & (F.col("last_line") > F.col("first_full_compare"))
        )
        d = d.where(~late)
    keep = single | (F.col("support") >= 2) | (F.col("together_ratio") >= 0.75) | F.col("compare_like") | F.col("arith_like") | F.col("derived")
    confidence = F.least(
        F.lit(0.99),
        0.35 + 0.08 * F.col("support") + 0.10 * F.col("constraints") + 0.15 * F.col("together_ratio")
        + F.when(F.col("compare_like"), 0.10).otherwise(0.0) + F.when(single, 0.05).otherwise(0.0),
    )
    shape = F.when(single, "flag").when(~tight, "bit_group").when(F.col("compare_like"), "enum_or_small_int").otherwise("bit_range")
    return d.where(keep).select(
        *keys, "width", "is_bitfield", "bit_scan", "bits", shape.alias("shape"), "support", "together_ratio",
        "compare_like", "arith_like", "derived", "constraints", confidence.alias("confidence"), "kinds",
    )


_SPAN = ["lo", "hi", "shape", "confidence", "kinds", "constraints", "sources"]


def source_name(bits: Column) -> Column:
    """Name of a bit set in ``sources``."""
    return F.array_join(bits.cast("array<string>"), ",")


def split_runs(candidates: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Candidates as contiguous (lo, hi) spans; split ones lose a little confidence."""
    d = candidates.withColumn("_runs", runs_of(F.col("bits"))).withColumn("_split", F.size("_runs") > 1)
    d = d.withColumn("_r", F.explode("_runs"))
    one = F.col("_r.a") == F.col("_r.b")
    return d.select(
        *keys, F.col("_r.a").alias("lo"), F.col("_r.b").alias("hi"),
        F.when(~F.col("_split"), F.col("shape")).when(one, "flag").otherwise("enum_or_small_int").alias("shape"),
        F.when(F.col("_split"), F.greatest(F.lit(0.55), F.col("confidence") - 0.05)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("_split"), F.concat("kinds", F.array(F.lit("split_noncontiguous")))).otherwise(F.col("kinds")).alias("kinds"),
        "constraints", F.array(source_name(F.col("bits"))).alias("sources"), F.struct(F.size("bits").alias("n"), "bits").alias("ord"),
    )


def _first_of_kinds(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of equal spans with equal kinds, that of the smallest source set; the others add nothing."""
    facts = ["shape", "confidence", "constraints", "sources"]
    g = d.groupBy(*keys, "lo", "hi", F.array_sort("kinds").alias("kinds")).agg(F.min(F.struct("ord", *facts)).alias("_f"))
    return g.select(*keys, "lo", "hi", "kinds", "_f.*")


def _spans_per_field(d: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """All spans of a field as one array.

    Spans are merged before, so a field holds at most width*(width+1)/2 of them
    (times the few event-kind sets), whatever the number of events.
    """
    return d.groupBy(*keys).agg(F.collect_list(F.struct(*_SPAN, *more)).alias("_spans"))


def shrink_derived(d: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Reduce shift-derived wide spans to their lowest bit when direct spans cover two or more of their bits."""
    s = _spans_per_field(_first_of_kinds(d, keys), keys, ["ord"])
    direct = F.array_distinct(F.flatten(F.transform(
        F.filter("_spans", lambda x: ~F.array_contains(x["kinds"], "mov_derived")), lambda x: F.sequence(x["lo"], x["hi"])
    )))
    s = s.withColumn("_direct", direct).select(*keys, "_direct", F.inline("_spans"))
    derived = F.array_contains("kinds", "mov_derived") & ~F.arrays_overlap("kinds", F.array(*map(F.lit, ["and", "or", "xor"])))
    inside = F.size(F.array_intersect(F.sequence("lo", "hi"), "_direct"))
    s = s.withColumn("_hit", (F.col("hi") > F.col("lo")) & derived & (inside >= 2))
    pick = lambda c, new: F.when(F.col("_hit"), new).otherwise(F.col(c)).alias(c)
    shrunk = s.select(
        *keys, "lo", pick("hi", F.col("lo")), pick("shape", F.lit("flag")),
        pick("confidence", F.least(F.lit(0.99), F.greatest("confidence", F.lit(0.72)))),
        pick("kinds", F.concat("kinds", F.array(F.lit("boundary_shrink")))), "constraints", "sources", "ord",
    )
    return _first_of_kinds(shrunk, keys)


def merge_candidates(d: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Merge equal spans: union of kinds and sources, highest confidence (at most 0.99)."""
    return d.groupBy(*keys, "lo", "hi").agg(
        F.min("shape").alias("shape"),
        F.least(F.lit(0.99), F.max("confidence")).alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
        F.max("constraints").alias("constraints"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )


def strength(kinds: Column) -> Column:
    has = lambda names: F.arrays_overlap(kinds, F.array(*map(F.lit, names)))
    return (
        F.when(has(COMPARES), 3).when(has(["and", "or", "xor"]), 2)
        .when(has([*SHIFTS, "mov_derived", "boundary_shrink"]), 1).otherwise(0)
    )


def resolve_nested(d: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Settle spans inside spans: a stronger outer span drops the inner ones, otherwise the
    outer span gives way to its uncovered rest.

    The merged spans of a field form one small array, judged span by span.
    """
    keys = list(keys)
    s = _spans_per_field(d.withColumn("power", strength(F.col("kinds"))), keys, ["power"])
    inside = lambda x, o: (x["lo"] >= o["lo"]) & (x["hi"] <= o["hi"]) & ((x["lo"] > o["lo"]) | (x["hi"] < o["hi"]))
    judged = F.transform(
        "_spans",
        lambda o: F.struct(
            o["lo"].alias("lo"), o["hi"].alias("hi"), o["power"].alias("power"),
            F.transform(
                F.filter("_spans", lambda x: inside(x, o)),
                lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["power"].alias("power")),
            ).alias("inner"),
        ),
    )
    s = s.withColumn("_j", F.filter(judged, lambda o: F.size(o["inner"]) > 0))
    wins = lambda o: o["power"] > F.array_max(F.transform(o["inner"], lambda x: x["power"]))
    span = lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))
    dropped = F.flatten(F.transform(F.filter("_j", wins), lambda o: F.transform(o["inner"], span)))
    split = F.filter("_j", lambda o: ~wins(o))
    s = s.withColumn("_split", split).withColumn("_gone", F.concat(dropped, F.transform("_split", span)))
    rest_of = lambda o: runs_of(F.filter(
        F.sequence(o["lo"], o["hi"]), lambda i: ~F.exists(o["inner"], lambda x: (i >= x["lo"]) & (i <= x["hi"]))
    ))
    rests = F.flatten(F.transform("_split", lambda o: F.transform(
        rest_of(o), lambda r: F.struct(r["a"].alias("lo"), r["b"].alias("hi"), o["lo"].alias("olo"), o["hi"].alias("ohi"))
    )))
    s = s.withColumn("_rests", rests)
    whole = s.select(*keys, "_gone", "_rests", F.inline("_spans"))
    mine = F.filter("_rests", lambda r: (r["olo"] == F.col("lo")) & (r["ohi"] == F.col("hi")))
    keep = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.lit(False).alias("cut")))
    pieces = F.concat(keep, F.transform(mine, lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), F.lit(True).alias("cut"))))
    p = whole.withColumn("_p", F.explode(pieces)).where(
        ~F.exists("_gone", lambda g: (g["lo"] == F.col("_p.lo")) & (g["hi"] == F.col("_p.hi")))
    )
    cut = F.col("_p.cut")
    p = p.select(
        *keys, F.col("_p.lo").alias("lo"), F.col("_p.hi").alias("hi"),
        F.when(~cut, F.col("shape")).when(F.col("_p.lo") == F.col("_p.hi"), "flag").otherwise("bit_range").alias("shape"),
        F.when(cut, F.greatest(F.lit(0.50), F.col("confidence") - 0.08)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(cut, F.concat("kinds", F.array(F.lit("coverage_split")))).otherwise(F.col("kinds")).alias("kinds"),
        "constraints", "sources",
    )
    return merge_candidates(p, keys)


def drop_serialization(d: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Drop fields (16 bits or more) whose spans are exactly their bytes, from weak traces without constraints."""
    keys = list(keys)
    w = Window.partitionBy(*keys)
    weak = F.size(F.array_except("kinds", F.array(*map(F.lit, ["mov_derived", "boundary_shrink", "coverage_split"])))) == 0
    veto = (
        F.bool_and((F.col("lo") % 8 == 0) & (F.col("hi") == F.col("lo") + 7)).over(w)
        & F.bool_and(weak & (F.col("constraints") == 0)).over(w)
        & (F.col("width") >= 16) & (F.col("width") % 8 == 0) & (F.count(F.lit(1)).over(w) * 8 == F.col("width"))
    )
    return d.withColumn("_veto", veto).where(~F.col("_veto")).drop("_veto")


def recover_bitfields(events: DataFrame, mode: str = "full", keys: Sequence[str] = KEY) -> DataFrame:
    """Final sub-field spans of every field decided to be a bit field."""
    facts = ["width", "is_bitfield", "bit_scan"]
    own = [*keys, *facts]
    c = subfield_candidates(events, bitfield_decision(events, mode, keys), mode, keys)
    c = c.where(F.col("is_bitfield") & (F.lit(mode == "flat_evidence") | ~F.col("bit_scan")))
    d = split_runs(c, own)
    if mode == "flat_evidence":
        d = merge_candidates(d, own)
    else:
        d = drop_serialization(resolve_nested(merge_candidates(shrink_derived(d, own), own), own), own)
    return d.drop("is_bitfield", "bit_scan").withColumn("label", span_label(F.col("lo"), F.col("hi")))


def span_events(subfields: DataFrame, events: DataFrame, mode: str = "full", keys: Sequence[str] = KEY) -> DataFrame:
    """One row per final span and event it rests on: keys, lo, hi, label, source, line_no, event_kind, constraint."""
    used = events_for_mode(events, mode).where(F.size("bits") < F.col("width"))
    used = used.select(*keys, source_name(F.col("bits")).alias("source"), "line_no", "event_kind", "constraint")
    spans = subfields.select(*keys, "lo", "hi", "label", F.explode("sources").alias("source"))
    return spans.join(many(used), [*keys, "source"])


CONSTRAINT = ["mask", "operator", "value", "subfield_constraint", "expression"]


def span_constraints(spans: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Distinct constraints of every span of ``span_events`` with the lines that state them.

    A constraint that reaches a span from two bit sets is listed once for each, as their lines differ.
    ``trace_lines`` is as long as the constraint's uses in the run; ``span_events`` has the same in rows.
    """
    stated = spans.where(F.col("constraint").isNotNull())
    return stated.groupBy(*keys, "lo", "hi", "label", "source", *[F.col(f"constraint.{c}").alias(c) for c in CONSTRAINT]).agg(
        F.array_sort(F.collect_set("line_no")).alias("trace_lines")
    )


def bitfields_table(subfields: DataFrame, events: DataFrame, mode: str = "full", keys: Sequence[str] = KEY) -> DataFrame:
    """Final sub-fields with their constraints, in the order of the constraint texts; a span may have none."""
    keys = list(keys)
    rows = span_constraints(span_events(subfields, events, mode, keys), keys)
    order = F.struct(F.coalesce("subfield_constraint", F.lit("")).alias("_t"), *CONSTRAINT, "trace_lines")
    lists = rows.groupBy(*keys, "lo", "hi").agg(F.array_sort(F.collect_list(order)).alias("_c"))
    shape = lambda c: F.struct(*[c[n].alias(n) for n in [*CONSTRAINT, "trace_lines"]])
    d = subfields.join(many(lists.select(*keys, "lo", "hi", F.transform("_c", shape).alias("_listed"))), [*keys, "lo", "hi"], "left")
    empty = F.array().cast(d.schema["_listed"].dataType)
    return d.select(*keys, "width", "lo", "hi", "label", F.coalesce("_listed", empty).alias("constraints"))


def bit_layout(subfields: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Layout text per field, highest bits first; a field has at most ``width`` spans."""
    order = F.struct((-F.col("hi")).alias("h"), (F.col("lo") - F.col("hi")).alias("s"), F.col("label"))
    d = subfields.groupBy(*keys).agg(F.array_sort(F.collect_set(order)).alias("_l"))
    return d.select(*keys, F.array_join(F.transform("_l", lambda x: x["label"]), " ").alias("layout"))


def bitfield_counts(filled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parents, sub-fields and synthetic gaps; ``filled`` has field_id and synthetic."""
    return filled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("subfields"), F.count_if("synthetic").alias("synthetic_gap_subfields"),
        F.count_if(~F.col("synthetic")).alias("non_synthetic_subfields"),
    )


def ablation_table(metrics: DataFrame) -> DataFrame:
    """Modes as rows, seven scores as columns, from (mode, metric, value) rows."""
    names = [
        "bitfield_precision", "bitfield_recall", "bitfield_f1", "subfield_precision", "subfield_recall", "subfield_f1",
        "exact_partition_recall",
    ]
    return metrics.groupBy("mode").pivot("metric", names).agg(F.first("value"))
