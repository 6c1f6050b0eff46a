"""Perturbation planning: compare evidence, constraint profiles, candidates and mutations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.intervals import stab_join
from fieldscope.functions.ordered import line_block, many, next_row, number_rows, top_k
from fieldscope.functions.text import hex_value, immediates, index_expanded, untainted_values
from fieldscope.functions.units import fixed_hex, hex_add, max_hex, number_hex, power_of_two, write_bits, write_bytes
from fieldscope.operators.matrix import hash_order
from fieldscope.operators.trace import after_first_taint
from fieldscope.session import stored

GROUPS = ["neighborhood", "boundary", "enum", "extreme"]
# Fixed mnemonic classes of the instruction mix.
COMPARE = ["cmp", "test"]
COMPUTE = ["add", "sub", "adc", "sbb", "and", "or", "xor", "shl", "shr", "sar", "sal", "mul", "imul", "div", "idiv", "inc", "dec", "neg", "not", "lea", "rol", "ror", "rcl", "rcr"]
MOVE = ["mov", "movzx", "movsx", "movsxd", "cmovz", "cmovnz", "cmove", "cmovne", "xchg"]

FIELD = ["run_id", "a", "b"]


def touched(events: DataFrame, fields: DataFrame, owned: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Instructions with the field they belong to (or with every field they overlap).

    The owner is the field with most of the instruction's bytes, then the wider, then the lower
    one.  Bytes meet fields in one binned join; an instruction has few bytes.
    """
    live = after_first_taint(events).where((F.col("kind") == "Instruction") & F.col("disasm").isNotNull())
    d = live.select("run_id", "line_no", "addr", "disasm", "mnemonic", "info_raw", index_expanded(F.col("idx_raw")).alias("idx"), *extra)
    d = d.where(F.size("idx") > 0)
    bytes_ = d.select("run_id", "line_no", F.explode("idx").alias("_i"))
    met = stab_join(bytes_, fields.select(*FIELD).distinct(), ["run_id"], "_i")
    hits = met.groupBy("run_id", "line_no", "a", "b").agg(F.count(F.lit(1)).alias("_n"))
    if owned:
        rank = F.struct("_n", (F.col("b") - F.col("a")).alias("s"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
        best = hits.groupBy("run_id", "line_no").agg(F.max(rank).alias("_o"))
        hits = best.select("run_id", "line_no", (-F.col("_o.na")).alias("a"), (-F.col("_o.nb")).alias("b"))
    return d.drop("idx").join(many(hits.select("run_id", "line_no", "a", "b")), ["run_id", "line_no"])


def is_zero_test(disasm: Column) -> Column:
    return F.lower(disasm).rlike(r"^\s*test\s+([^,\s]+)\s*,\s*\1\s*$")


def compare_evidence(events: DataFrame, fields: DataFrame, owned: bool = True) -> DataFrame:
    """First occurrence of every constant a field is compared with, masked to its width.

    ``test r,r`` counts as the value 0 when the next instruction jumps on zero.
    ``fields``: run_id, a, b (and optionally width_bits).
    """
    jump = F.struct(F.lower("disasm").rlike(r"^\s*j(z|e|nz|ne)\b").alias("zero_jump"))
    # Only the instruction behind a compare matters, but it can be any instruction.
    narrow = after_first_taint(events).where((F.col("kind") == "Instruction") & F.col("disasm").isNotNull()).select("run_id", "line_no", "disasm")
    follow = (
        next_row(narrow, ["run_id"], F.col("line_no"), line_block(), jump, "next")
        .where(is_zero_test(F.col("disasm")) & F.col("next.zero_jump")).select("run_id", "line_no", F.lit(True).alias("zero_jump"))
    )
    d = touched(events.where((F.col("kind") == "Taint") | F.col("mnemonic").isin(COMPARE)), fields, owned)
    d = d.join(many(follow), ["run_id", "line_no"], "left")
    widths = fields.select(*FIELD, (F.col("width_bits") if "width_bits" in fields.columns else (F.col("b") - F.col("a") + 1) * 8).alias("width_bits")).distinct()
    d = d.join(many(widths), FIELD)
    literal = immediates(F.regexp_extract("disasm", r"^\S+ (.*)$", 1))
    limit = F.when(F.col("width_bits") < 64, power_of_two(F.col("width_bits")))
    runtime = F.filter(untainted_values(F.col("info_raw")), lambda v: limit.isNull() | (v < limit))
    zero = is_zero_test(F.col("disasm"))
    values = (
        F.when(zero, F.when(F.coalesce("zero_jump", F.lit(False)), F.array(F.lit(0).cast("decimal(20,0)"))))
        .when(F.size(literal) > 0, literal)
        .when(F.col("mnemonic") == "cmp", runtime)
    )
    rows = d.select(*FIELD, "width_bits", "line_no", "addr", "disasm", F.posexplode(values).alias("pos", "raw"))
    # Negative constants are extended to the field's own width.
    return (
        rows.withColumn("value_hex", fixed_hex(number_hex(F.col("raw").cast("string")), F.col("width_bits")))
        .groupBy(*FIELD, "width_bits", "value_hex")
        .agg(F.min_by(F.struct("line_no", "pos", "raw", "addr", "disasm"), F.struct("line_no", "pos")).alias("_f"))
        .select(*FIELD, "width_bits", "value_hex", narrow_value(F.col("value_hex")).alias("value"), "_f.*")
    )


def _hexed(evidence: DataFrame) -> DataFrame:
    """Evidence with ``value_hex``; a table that has numbers only (value, width_bits) gets it from them."""
    if "value_hex" in evidence.columns:
        return evidence
    return evidence.withColumn("value_hex", fixed_hex(number_hex(F.col("value").cast("decimal(38,0)").cast("string")), F.col("width_bits")))


def narrow_value(digits: Column) -> Column:
    """Number of hex digits; null if it needs more than 64 bits."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) <= 16, F.conv(short, 16, 10).cast("decimal(20,0)"))


def _hex_gap(lo: Column, hi: Column) -> Column:
    """hi - lo of fixed-width hex digits; above 64 bits an estimate that is at least 2^63."""
    low = lambda h: F.conv(F.substring(h, -16, 16), 16, 10).cast("decimal(20,0)")
    head = lambda h: F.substring(h, F.lit(1), F.greatest(F.length(h) - 16, F.lit(0)))
    return F.when(head(lo) == head(hi), (low(hi) - low(lo)).cast("double")).otherwise(F.lit(2.0**64))


def instruction_mix(events: DataFrame, fields: DataFrame, owned: bool = True) -> DataFrame:
    m = F.col("mnemonic")
    return touched(events, fields, owned).groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(m.isin(COMPARE)).alias("compare_count"),
        F.count_if(m.isin(COMPUTE)).alias("compute_count"), F.count_if(m.isin(MOVE)).alias("move_count"),
        F.count_if(~m.isin(COMPARE + COMPUTE + MOVE)).alias("other_count"),
    )


def constraint_profile(fields: DataFrame, evidence: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """Evidence summary per field: mode, count, density, inferred range and the bitmask flag.

    ``evidence`` has one row per (field, value), so plain counts are distinct counts.
    """
    low_bits = F.length(F.replace(F.conv(F.col("value").cast("string"), 10, 2), F.lit("0"), F.lit("")))
    # Digits of one width order like their values.
    g = _hexed(evidence).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value_hex").alias("lo"), F.max("value_hex").alias("hi"),
        F.count_if((F.col("value") > 0) & (low_bits <= 2)).alias("_sparse"),
    )
    d = fields.select(*keys, "width_bits").distinct().join(many(g), list(keys), "left")
    count = F.coalesce("n", F.lit(0))
    density = F.when(count > 0, count / (_hex_gap(F.col("lo"), F.col("hi")) + 1)).otherwise(0.0)
    ranged = (count >= 4) & (density >= 0.6)
    return d.select(
        *keys, "width_bits",
        F.when(ranged, "range").when(count > 0, "enum").otherwise("fallback").alias("mode"),
        count.alias("evidence_count"), density.alias("density"),
        F.when(ranged, narrow_value(F.col("lo"))).alias("range_lo"), F.when(ranged, narrow_value(F.col("hi"))).alias("range_hi"),
        F.when(ranged, F.col("lo")).alias("range_lo_hex"), F.when(ranged, F.col("hi")).alias("range_hi_hex"),
        ((count > 0) & (F.col("_sparse") / F.greatest(count, F.lit(1)) >= 0.5) & (F.col("width_bits") <= 32)).alias("bitmask_detected"),
    )


def field_budget(profile: DataFrame, mix: DataFrame, top: int = 6, rounds: int = 2, keys: Sequence[str] = FIELD) -> DataFrame:
    d = profile.join(many(mix.select(*keys, "compare_count", "compute_count")), list(keys), "left").na.fill(0, ["compare_count", "compute_count"])
    top = max(1, top)
    level = F.when((F.col("evidence_count") > 0) | (F.col("compare_count") > 0), "high").when(F.col("compute_count") > 0, "medium").otherwise("low")
    pick = lambda h, m, l: F.when(F.col("importance") == "high", h).when(F.col("importance") == "medium", m).otherwise(l)
    return d.withColumn("importance", level).select(
        *keys, "importance", pick(F.lit(top), F.lit(min(top, 4)), F.lit(min(top, 3))).alias("group_topk"),
        pick(F.lit(rounds > 1), F.lit(False), F.lit(False)).alias("allow_round2"),
        pick(F.lit(0), F.lit(6), F.lit(4)).alias("early_stop_min"),
    )


def _first_distinct(items: Column, base: Column, k: Column) -> Column:
    """First k items of an array<struct<strategy, value>> that differ from base and from earlier ones."""
    start = F.array().cast("array<struct<strategy:string,value:string>>")
    seen = lambda acc, v: F.exists(acc, lambda x: x["value"] == v)
    return F.aggregate(
        items, start,
        lambda acc, it: F.when(
            (F.size(acc) >= k) | (it["value"] == base) | seen(acc, it["value"]), acc
        ).otherwise(F.concat(acc, F.array(F.struct(it["strategy"].alias("strategy"), it["value"].alias("value"))))),
    )


def _supplement(items: Column, base: Column, width: Column, k: Column, steps: int) -> Column:
    """Fill a short group from the neighbours of its members, breadth first."""
    seen = lambda acc, v: F.exists(acc, lambda x: x["value"] == v)

    def step(acc, i):
        cursor = F.floor(i / 2).cast("int")
        minus = F.pmod(i, F.lit(2)) == 0
        name = F.when(minus, "supplement_minus_1").otherwise("supplement_plus_1")
        seed = F.get(acc, cursor)["value"]
        value = F.when(minus, hex_add(seed, -1, width)).otherwise(hex_add(seed, 1, width))
        grown = F.transform(F.array(value), lambda v: F.when(
            (v == base) | seen(acc, v), acc
        ).otherwise(F.concat(acc, F.array(F.struct(name.alias("strategy"), v.alias("value"))))))
        return F.when((F.size(acc) >= k) | (cursor >= F.size(acc)), acc).otherwise(F.get(grown, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * steps - 1)), items, step)


def first_evidence(evidence: DataFrame, k: int, keys: Sequence[str] = FIELD, order: Sequence[str] = ("line_no", "pos")) -> DataFrame:
    """First k + 2 constants per field as hex values, in order of first use.

    The constants are distinct, so k + 2 of them hold at least k + 1 values other
    than the baseline, and every group that reads them stops at k values.  The
    inferred range comes from the full profile, not from this list.
    """
    n = k + 2
    top = top_k(_hexed(evidence), keys, [F.col(c) for c in order], ["value_hex"], n, "_n")
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("value_hex").alias("v")))), lambda x: x["v"]).alias("evidence")
    )


def grouped_candidates(
    fields: DataFrame, profile: DataFrame, evidence: DataFrame, k: int | str = 6, keys: Sequence[str] = FIELD, order: Sequence[str] = ("line_no", "pos")
) -> DataFrame:
    """Candidate values per strategy group.

    ``fields``: keys, width_bits, base_hex (current value, fixed-width hex), and a
    column of per-field limits when ``k`` is a column name.  Output: one row per
    (field, group, pos) with strategy and value_hex.
    """
    keys = list(keys)
    limit = F.col(k) if isinstance(k, str) else F.lit(int(k))
    # With a limit per field, the largest one decides how many steps there are.
    steps = int(fields.agg(F.max(k)).first()[0] or 1) if isinstance(k, str) else int(k)
    d = (
        fields.join(many(first_evidence(evidence, steps, keys, order)), keys, "left")
        .join(many(profile.select(*keys, "range_lo_hex", "range_hi_hex")), keys, "left")
        .withColumn("_k", F.greatest(limit, F.lit(1)))
        .withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    )
    w, base, ev = F.col("width_bits"), F.col("base_hex"), F.col("evidence")
    item = lambda name, v: F.struct(F.lit(name).alias("strategy"), v.alias("value"))
    near = lambda v, name, dlt: item(name, hex_add(v, dlt, w))
    zero = F.repeat(F.lit("0"), F.length(base))
    top = max_hex(w)
    around = F.flatten(F.transform(ev, lambda v: F.array(near(v, "constraint_minus_1", -1), item("constraint", v), near(v, "constraint_plus_1", 1))))
    neighborhood = F.concat(F.array(near(base, "base_minus_1", -1), near(base, "base_plus_1", 1)), around)
    lo, hi = F.col("range_lo_hex"), F.col("range_hi_hex")
    edges = F.when(
        lo.isNotNull(),
        F.array(
            near(lo, "range_l_minus_1", -1), item("range_l", lo), near(lo, "range_l_plus_1", 1),
            near(hi, "range_u_minus_1", -1), item("range_u", hi), near(hi, "range_u_plus_1", 1),
        ),
    ).otherwise(F.array().cast("array<struct<strategy:string,value:string>>"))
    boundary = F.concat(F.array(item("min", zero), near(zero, "min_plus_1", 1), near(top, "max_minus_1", -1), item("max", top)), edges)
    spare = F.array(item("enum_supplement", zero), near(zero, "enum_supplement", 1), item("enum_supplement", top))
    usable = F.filter(ev, lambda v: v != base)
    enum = F.when(F.size(usable) > 0, F.transform(ev, lambda v: item("constraint", v))).otherwise(spare)
    extreme = F.array(item("zero", zero), item("all_ff", top), near(base, "base_minus_0x10", -16), near(base, "base_plus_0x10", 16))
    groups = F.array(*[
        F.struct(F.lit(n).alias("strategy_group"), c.alias("items"))
        for n, c in zip(GROUPS, [neighborhood, boundary, enum, extreme])
    ])
    d = d.where(w > 0).select(*keys, "width_bits", "base_hex", "_k", F.inline(groups))
    d = d.withColumn("items", _first_distinct(F.col("items"), base, F.col("_k")))
    d = d.withColumn("items", _supplement(F.col("items"), base, F.col("width_bits"), F.col("_k"), steps))
    return d.select(*keys, "width_bits", "strategy_group", F.posexplode("items").alias("pos", "_i")).select(
        *keys, "width_bits", "strategy_group", "pos", "_i.strategy", F.col("_i.value").alias("value_hex")
    )


def mutations(fields: DataFrame, candidates: DataFrame, tried: DataFrame | None = None, round_id: int = 1, order: str = "big", keys: Sequence[str] = FIELD) -> DataFrame:
    """Mutation rows with name, new payload and padded value.

    ``fields``: keys, a, b, payload_hex and optionally bits (array, for bit units).
    ``tried``: keys, value_hex already executed.
    """
    keys = list(keys)
    c = candidates
    if tried is not None:
        c = c.join(many(tried.select(*keys, "value_hex").distinct()), [*keys, "value_hex"], "left_anti")
    # at most k candidates per (field, group)
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "strategy_group").orderBy("pos")))
    extra = [x for x in ("a", "b", "payload_hex", "bits") if x in fields.columns and x not in keys]
    d = c.join(many(fields.select(*keys, *extra)), keys)
    new = write_bytes(F.col("payload_hex"), F.col("a"), F.col("b"), F.col("value_hex"), order)
    if "bits" in fields.columns:
        new = F.when(F.col("bits").isNotNull(), write_bits(F.col("payload_hex"), F.col("a"), F.col("b"), F.col("bits"), F.col("value_hex"), order)).otherwise(new)
    return d.select(
        *keys, F.format_string(f"%s_%s_r{round_id}_%02d", "strategy_group", "strategy", "_n").alias("name"),
        "strategy_group", "strategy", F.col("payload_hex").alias("base_payload_hex"), new.alias("payload_hex"),
        F.concat(F.lit("0x"), "value_hex").alias("final_value_hex"), *[x for x in ("a", "b") if x not in keys],
    )


def leaves_field() -> Column:
    """True when a mutation changes the payload length or bytes outside its field."""
    head = lambda c: F.substring(c, F.lit(1), 2 * F.col("a"))
    rest = lambda c: F.substring(c, 2 * F.col("b") + 3, F.length(c))
    old, new = F.col("base_payload_hex"), F.col("payload_hex")
    return (F.length(old) != F.length(new)) | (head(old) != head(new)) | (rest(old) != rest(new))


def invalid_mutations(m: DataFrame) -> DataFrame:
    """Mutations that leave their field; empty when all is well."""
    return m.where(leaves_field())


def bit_constraint_values(unit_constraints: Column, width: Column) -> Column:
    """Evidence values of a bit unit's constraints (array<struct<operator,value,subfield_constraint,expression>>).

    The value behind ``==``, else the stated hex value, else 0 or 1 for zero and nonzero; fixed-width hex of
    the unit's width, each value once, in the order of the constraints.
    """

    def one(c):
        text = F.coalesce(F.nullif(c["subfield_constraint"], F.lit("")), c["expression"])
        stated = number_hex(F.regexp_extract(text, r"==\s*(\S+)", 1))
        op, value = F.lower(c["operator"]), F.lower(F.trim(c["value"]))
        hexed = F.when(value.rlike("^-?(0x)?[0-9a-f]+$"), number_hex(F.regexp_replace(value, "^(-?)(0x)?", "$10x")))
        return fixed_hex(F.coalesce(stated, hexed, F.when(op == "zero", "0").when(op == "nonzero", "1")), width)

    return F.array_distinct(F.filter(F.transform(unit_constraints, one), lambda v: v.isNotNull()))


def dedupe_payloads(m: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Per mutation: the first mutation of its field with the same payload, and whether it is reused."""
    first = m.groupBy(*keys, F.lower("payload_hex").alias("_p")).agg(F.min_by(name, order).alias("executed_as"), F.min(order).alias("_o"))
    d = m.withColumn("_p", F.lower("payload_hex")).join(first, [*keys, "_p"])
    return d.withColumn("reused", F.col(order) != F.col("_o")).drop("_p", "_o")


def closed_loop(
    fields: DataFrame, base_evidence: DataFrame, responses: DataFrame, rounds: int = 2, k: int | str = 6, keys: Sequence[str] = FIELD, byte_order: str = "big"
) -> DataFrame:
    """All rounds of planning: mutations of round 1, then enum mutations for constants that executed ones bring up.

    ``fields``: keys, width_bits, base_hex, payload_hex and optionally allow_round2 (fields without it stop after round 1);
    ``base_evidence``: keys, value_hex, line_no, pos of the baseline (``compare_evidence``);
    ``responses``: keys, tried_hex, value_hex, line_no, pos: constants seen in the trace of the run that had the value tried_hex.

    Every round reads the responses to the values of the round before only, and drops what is known; a field
    without news takes no further part, and the loop ends when no field has any, or nothing new can be tried, or at the round limit.
    Result: the rows of ``mutations`` with round and value_hex, named ``_r<round>_``.  A round's tables are
    written once, so plans do not grow with the rounds.
    """
    keys = list(keys)
    profile = constraint_profile(fields, base_evidence.withColumn("value", narrow_value(F.col("value_hex"))), keys)
    planned = lambda m, r: stored(m.withColumn("value_hex", F.substring("final_value_hex", 3, 1 << 30)).withColumn("round", F.lit(r)), "round")
    news = stored(base_evidence.select(*keys, "value_hex", F.lit(1).alias("round"), "line_no", "pos"), "known")
    known, out = news, [planned(mutations(fields, grouped_candidates(fields, profile, base_evidence, k, keys), order=byte_order, keys=keys), 1)]
    open_fields = fields.where("allow_round2") if "allow_round2" in fields.columns else fields
    for r in range(2, rounds + 1):
        executed = out[-1].select(*keys, F.col("value_hex").alias("tried_hex")).distinct()
        seen = responses.join(many(executed), [*keys, "tried_hex"], "left_semi").join(many(known.select(*keys, "value_hex")), [*keys, "value_hex"], "left_anti")
        first = seen.groupBy(*keys, "value_hex").agg(F.min(F.struct("line_no", "pos")).alias("_f"))
        news = stored(first.select(*keys, "value_hex", F.lit(r).alias("round"), "_f.line_no", "_f.pos").join(many(open_fields.select(*keys)), keys, "left_semi"), "news")
        if news.isEmpty():
            break
        known = known.unionByName(news)
        active = open_fields.join(many(news.select(*keys).distinct()), keys, "left_semi")
        enum = grouped_candidates(active, profile, known, k, keys, ("round", "line_no", "pos")).where("strategy_group = 'enum'")
        tried = out[0].select(*keys, "value_hex")
        for done in out[1:]:
            tried = tried.unionByName(done.select(*keys, "value_hex"))
        more = planned(mutations(active, enum, tried, r, byte_order, keys), r)
        if more.isEmpty():
            break
        out.append(more)
    return reduce(DataFrame.unionByName, out)


def next_round(evidence: DataFrame, base_evidence: DataFrame, tried: DataFrame, fields: DataFrame, keys: Sequence[str] = FIELD) -> DataFrame:
    """Constants seen in mutation traces but not in the baseline and not tried yet."""
    keys = list(keys)
    fresh = _hexed(evidence).join(many(_hexed(base_evidence).select(*keys, "value_hex")), [*keys, "value_hex"], "left_anti")
    fresh = fresh.join(many(tried.select(*keys, "value_hex").distinct()), [*keys, "value_hex"], "left_anti")
    return fresh.join(many(fields.select(*keys, "base_hex")), keys).where(F.col("value_hex") != F.col("base_hex"))


def select_targets(fields: DataFrame, spec: str | None = None, done: DataFrame | None = None, seed: int | None = None, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Fields named by ``spec`` (``a``, ``a,b``, ``a_b``, ``a-b`` or a bit label); without it all
    fields, or with ``seed`` one hash-picked field per key among those not done."""
    if spec:
        s = spec.strip()
        t = fields.where(F.col("repr") == s)
        nums = [int(x) for x in s.replace("-", ",").replace("_", ",").split(",") if x.strip().isdigit()]
        if "[" not in s and len(nums) in (1, 2):
            by_range = (F.col("a") == nums[0]) & ((F.col("b") == nums[-1]) if len(nums) == 2 else F.lit(True))
            t = fields.where((F.col("repr") == s) | ((F.col("kind") == "byte") & by_range))
        return t
    d = fields
    if done is not None:
        d = d.join(done.select(*keys, "repr").distinct(), [*keys, "repr"], "left_anti")
    if seed is None:
        return d
    pick = F.struct(hash_order(seed, *[F.col(c) for c in keys], F.col("repr")), F.col("repr"))
    names = [c for c in d.columns if c not in keys]
    return d.groupBy(*keys).agg(F.min_by(F.struct(*names), pick).alias("_u")).select(*keys, "_u.*")


def constraint_values(m: DataFrame) -> DataFrame:
    """Values planned from constraints: the enum group or a ``constraint*`` strategy."""
    keep = (F.lower(F.coalesce("strategy_group", F.lit(""))) == "enum") | F.lower(F.coalesce("strategy", F.lit(""))).startswith("constraint")
    value = F.coalesce(F.nullif(F.col("final_value_hex"), F.lit("")), F.col("requested_value_hex"))
    return m.where(keep & value.isNotNull()).withColumn("constraint_value", F.lower(value))
