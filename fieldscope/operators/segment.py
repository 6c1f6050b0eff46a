"""Byte-field segmentation: evidence per byte range, ranking and greedy coverage.

Everything after ``field_stats`` works on one row per (run, range); a run has at
most payload-length-squared distinct ranges, whatever its number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.functions.intervals import gap_fill, islands
from fieldscope.functions.ordered import last_before, line_block, many
from fieldscope.functions.text import index_groups
from fieldscope.functions.units import bit_repr, byte_repr, label_bounds, span_label
from fieldscope.operators.trace import after_first_taint
from fieldscope.session import stored

# Fixed mnemonic classes of byte evidence.
COMPUTE = ["add", "adc", "sub", "sbb", "imul", "mul", "idiv", "div", "and", "or", "xor", "shl", "shr", "sar", "sal", "rol", "ror", "rcl", "rcr", "inc", "dec", "neg", "not", "lea"]
MOVE = ["mov", "movzx", "movsx", "movsxd", "movss", "movsd"]
FLOAT_WIDTH = {"movss": 4, "movsd": 8}


def is_compare(disasm: Column) -> Column:
    return F.lower(disasm).rlike(r"^\s*(cmp|test)\b")


def is_jump(disasm: Column) -> Column:
    return F.lower(disasm).rlike(r"^\s*j[a-z]+\b")


def is_setcc(disasm: Column) -> Column:
    return F.lower(disasm).rlike(r"^\s*set[a-z]+\b")


def evidence_level(disasm: Column, mnemonic: Column) -> Column:
    """3 compare, jump or setcc; 2 compute; 1 move; 0 ignored."""
    return (
        F.when(is_compare(disasm) | is_jump(disasm) | is_setcc(disasm), 3)
        .when(mnemonic.isin(COMPUTE), 2).when(mnemonic.isin(MOVE), 1).otherwise(0)
    )


def field_evidence(events: DataFrame) -> DataFrame:
    """Rows (run_id, line_no, a, b, level, mnemonic, ...): one per used range of an instruction.

    A jump or setcc without its own bytes takes the last range of the nearest
    compare before it.
    """
    d = (
        after_first_taint(events)
        .where((F.col("kind") == "Instruction") & F.col("disasm").isNotNull())
        .select(
            "run_id", "line_no", "disasm", "mnemonic",
            evidence_level(F.col("disasm"), F.col("mnemonic")).alias("level"),
            index_groups(F.col("idx_raw")).alias("groups"),
        )
        .where(F.col("level") > 0)
    )
    out = ["run_id", "line_no", "a", "b", "level", "mnemonic", "disasm"]
    own = d.withColumn("_g", F.explode("groups")).select("*", "_g.a", "_g.b").select(*out)
    compare = is_compare(F.col("disasm"))
    bare = F.size("groups") == 0
    chain = d.where(compare | (bare & (is_jump(F.col("disasm")) | is_setcc(F.col("disasm")))))
    last = F.get("groups", F.size("groups") - 1)
    carried = F.when(compare, F.struct(last["a"].alias("a"), last["b"].alias("b")))
    inherited = (
        last_before(chain, ["run_id"], F.col("line_no"), line_block(), carried, "_c")
        .where(bare & ~compare & F.col("_c.a").isNotNull())
        .select("run_id", "line_no", F.col("_c.a").alias("a"), F.col("_c.b").alias("b"), "level", "mnemonic", "disasm")
    )
    return own.unionByName(inherited)


def merge_subranges(evidence: DataFrame) -> DataFrame:
    """Move the evidence of a range to the first larger range (by first use) that holds it."""
    ranges = evidence.groupBy("run_id", "a", "b").agg(F.min("line_no").alias("_first"))
    outer = ranges.where(F.col("a") < F.col("b")).select("run_id", F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("_first").alias("of"))
    homes = (
        # equi-join on the first byte, so only ranges over the same byte meet
        ranges.join(outer.withColumn("a", F.explode(F.sequence("oa", "ob"))), ["run_id", "a"])
        .where((F.col("b") <= F.col("ob")) & ~((F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob"))))
        .groupBy("run_id", "a", "b").agg(F.min_by(F.struct("oa", "ob"), F.struct("of", "oa", "ob")).alias("_home"))
    )
    d = evidence.join(homes, ["run_id", "a", "b"], "left")
    return d.withColumn("a", F.coalesce("_home.oa", "a")).withColumn("b", F.coalesce("_home.ob", "b")).drop("_home")


def drop_covered(evidence: DataFrame) -> DataFrame:
    """Remove evidence of ranges that lie strictly inside another used range."""
    ranges = evidence.select("run_id", "a", "b").distinct()
    outer = ranges.select("run_id", F.col("a").alias("oa"), F.col("b").alias("ob"), F.explode(F.sequence("a", "b")).alias("a"))
    covered = (
        ranges.join(outer, ["run_id", "a"])
        .where((F.col("b") <= F.col("ob")) & ~((F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob"))))
        .select("run_id", "a", "b").distinct()
    )
    return evidence.join(covered, ["run_id", "a", "b"], "left_anti")


def field_stats(evidence: DataFrame) -> DataFrame:
    """Counts, levels, promotions, joint-use suppression and rank per range."""
    width = F.col("b") - F.col("a") + 1
    typed = F.lit(False)
    for name, size in FLOAT_WIDTH.items():
        typed = typed | ((F.col("mnemonic") == name) & (width == size))
    from_memory = F.col("disasm").rlike(r"^\s*\S+\s+[^,]*,.*\[")
    landing = is_compare(F.col("disasm")) | is_setcc(F.col("disasm")) | F.col("mnemonic").isin(MOVE)
    s = evidence.groupBy("run_id", "a", "b").agg(
        F.count_if(F.col("level") == 3).alias("compare_count"),
        F.count_if(F.col("level") == 2).alias("compute_count"),
        F.count_if(F.col("level") == 1).alias("move_count"),
        F.count(F.lit(1)).alias("total_count"),
        F.bool_or(typed & from_memory).alias("_typed"),
        F.bool_or(landing).alias("_landing"),
    )
    level = F.when(F.col("compare_count") > 0, 3).when(F.col("compute_count") > 0, 2).otherwise(1)
    at_max = F.when(F.col("compare_count") > 0, F.col("compare_count")).when(F.col("compute_count") > 0, F.col("compute_count")).otherwise(F.col("move_count"))
    s = s.withColumn("max_level", level).withColumn("count_at_max_level", at_max)
    # Compute evidence on shorter ranges that share the start or the end of a range.
    computed = F.col("compute_count") > 0
    shorter = Window.partitionBy("run_id", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("run_id", "b").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_parts", F.coalesce(F.count_if(computed).over(shorter), F.lit(0)) + F.coalesce(F.count_if(computed).over(later), F.lit(0)))
    assembled = (F.col("b") > F.col("a")) & F.col("_landing") & (F.col("_parts") >= 2)
    s = (
        s.withColumn("assembled_full_value", (F.col("_typed") | assembled).cast("int"))
        .withColumn("typed_float_consumption", F.col("_typed").cast("int"))
        .withColumn(
            "effective_level",
            F.when(F.col("assembled_full_value") == 1, F.greatest(F.col("max_level"), F.lit(2))).otherwise(F.col("max_level")),
        )
        .drop("_typed", "_landing", "_parts")
    )
    s = _suppress(s)
    w = Window.partitionBy("run_id").orderBy(
        F.desc("effective_level"), F.desc("assembled_full_value"), F.desc("count_at_max_level"), F.desc("total_count"),
        F.col("b") - F.col("a"), "a", "b",
    )
    return s.withColumn("rank", F.row_number().over(w))


def _suppress(s: DataFrame) -> DataFrame:
    """Flag even ranges of 4+ bytes whose two halves are both stable fields."""
    stable = (F.col("compare_count") >= 1) | (
        (F.col("assembled_full_value") >= 1) & (F.col("effective_level") >= 2) & (F.col("total_count") >= 3)
    )
    half = s.where(stable).select("run_id", "a", "b")
    width = F.col("b") - F.col("a") + 1
    parent = s.where((width >= 4) & (width % 2 == 0) & ((F.col("compare_count") >= 1) | (F.col("total_count") >= 4)))
    middle = (F.col("a") + F.col("b") - 1) / 2
    parent = parent.select("run_id", "a", "b", middle.cast("int").alias("_m"))
    left = half.select("run_id", "a", F.col("b").alias("_m"))
    right = half.select("run_id", (F.col("a") - 1).alias("_m"), "b")
    both = parent.join(left, ["run_id", "a", "_m"], "left_semi").join(right, ["run_id", "_m", "b"], "left_semi")
    return s.join(both.select("run_id", "a", "b", F.lit(True).alias("_s")), ["run_id", "a", "b"], "left").withColumn(
        "suppressed", F.coalesce("_s", F.lit(False))
    ).drop("_s")


def segment_fields(stats: DataFrame) -> DataFrame:
    """Final fields: each byte goes to the best-ranked kept range over it, then runs per owner."""
    owners = (
        stats.where(~F.col("suppressed"))
        .select("run_id", "rank", F.explode(F.sequence("a", "b")).alias("byte"))
        .groupBy("run_id", "byte").agg(F.min("rank").alias("rank"))
    )
    pieces = islands(owners, ["run_id", "rank"], "byte", "a", "b")
    parent = stats.select("run_id", "rank", F.col("total_count").alias("_parent"))
    own = stats.select("run_id", "a", "b", F.col("total_count").alias("_own"))
    return (
        pieces.join(parent, ["run_id", "rank"]).join(own, ["run_id", "a", "b"], "left")
        .select("run_id", "a", "b", byte_repr(F.col("a"), F.col("b")).alias("repr"), F.coalesce("_own", "_parent").alias("count"))
    )


def fields_from_trace(events: DataFrame, merge: bool = False, drop: bool = False) -> DataFrame:
    e = field_evidence(events)
    if merge:
        e = merge_subranges(e)
    if drop:
        e = drop_covered(e)
    # Evidence and statistics feed several steps each; both are small next to the trace.
    return segment_fields(stored(field_stats(stored(e, "evidence")), "stats"))


def bounds_check(fields: DataFrame, length: str = "payload_len", a: str = "a", b: str = "b") -> DataFrame:
    """Flag fields that leave their payload."""
    bad = (F.col(a) < 0) | (F.col(b) >= F.col(length)) | (F.col(a) > F.col(b))
    return fields.withColumn("out_of_bounds", bad).withColumn(
        "problem", F.when(bad, F.concat(F.lit("byte:"), byte_repr(F.col(a), F.col(b))))
    )


def merge_bitfields(byte_fields: DataFrame, bit_fields: DataFrame, keys: list[str]) -> DataFrame:
    """Replace byte fields by their recovered bit sub-fields.

    ``bit_fields``: keys, repr of the parent, bits array<int> (empty sets are ignored
    but still replace the parent), and optionally the constraints of each sub-field, which
    its unit keeps (byte fields have none).
    """
    carried = [c for c in ("constraints",) if c in bit_fields.columns]
    parents = bit_fields.select(*keys, F.col("parent_repr").alias("repr")).distinct()
    plain = byte_fields.join(many(parents), [*keys, "repr"], "left_anti").select(
        *keys, F.lit("byte").alias("kind"), "a", "b", "repr", F.lit(None).cast("string").alias("parent_repr"),
        F.lit(None).cast("array<int>").alias("bits"), ((F.col("b") - F.col("a") + 1) * 8).alias("width_bits"),
        *[F.array().cast(bit_fields.schema[c].dataType).alias(c) for c in carried],
    )
    subs = bit_fields.where(F.size("bits") > 0).select(*keys, F.col("parent_repr").alias("repr"), "bits", *carried)
    bit = byte_fields.join(many(subs), [*keys, "repr"]).select(
        *keys, F.lit("bit").alias("kind"), "a", "b", bit_repr(F.col("repr"), F.col("bits")).alias("repr"),
        F.col("repr").alias("parent_repr"), F.array_sort(F.array_distinct("bits")).alias("bits"),
        F.size(F.array_distinct("bits")).alias("width_bits"), *carried,
    )
    return plain.unionByName(bit)


def byte_ranges(units: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Distinct byte ranges with the position of their first unit."""
    return units.groupBy(*keys, "a", "b").agg(F.min(position).alias("first_position"))


def bit_gap_fill(subfields: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Cover each parent's bits: labelled sub-fields clipped in order plus synthetic gaps."""
    # Inside of a generator the label is read once a row; filters on its bounds would read it again each.
    r = subfields.select(*keys, F.explode(F.array(label_bounds(F.col("label")))).alias("_l")).where(F.col("_l").isNotNull())
    filled = gap_fill(r.select(*keys, "_l.lo", "_l.hi"), parents.select(*keys, "width_bits"), keys, "lo", "hi", "width_bits")
    return filled.withColumn("label", span_label(F.col("lo"), F.col("hi")))
