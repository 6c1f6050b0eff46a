"""Ground-truth construction from dissected packets, labels and response documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscope.functions.intervals import atomize, subtract
from fieldscope.functions.ordered import top_k
from fieldscope.functions.text import runs_of
from fieldscope.functions.units import field_key, span_label
from fieldscope.operators.bits import bits_mask_hex
from fieldscope.operators.profile import extract_json

PACKET = ["protocol", "sample_id"]


def bit_pattern(showname: Column, size: Column) -> Column:
    """Used bits (descending) of a pattern such as ``..01 .... = x``; null when the length does not fit."""
    compact = F.replace(F.regexp_extract(showname, r"^\s*([.01 ]*[.01])\s*=", 1), F.lit(" "), F.lit(""))
    total = size * 8
    bits = F.transform(
        F.filter(F.sequence(F.lit(1), total), lambda i: F.substring(compact, i, F.lit(1)) != "."), lambda i: total - i
    )
    return F.when((size > 0) & (F.length(compact) == total) & compact.rlike("[01]"), bits)


def bits_mask_text(bits: Column) -> Column:
    """Mask text padded to whole bytes of the highest bit, any width."""
    digits = (2 * (F.floor(F.array_max(bits) / 8) + 1)).cast("int")
    return F.concat(F.lit("0x"), F.lpad(bits_mask_hex(bits), digits, "0"))


def bits_ranges_text(bits: Column) -> Column:
    """``[7:4],[1]``: runs from high to low."""
    runs = F.reverse(runs_of(F.array_sort(bits)))
    return F.array_join(F.transform(runs, lambda r: span_label(r["a"], r["b"])), ",")


def raw_bytes(unmasked: Column, value: Column, size: Column) -> Column:
    """Hex bytes of a field: the unmasked value when it is hex, else the value; left-padded to the size."""
    digits = (2 * size).cast("int")

    def one(c):
        t = F.regexp_replace(F.lower(F.trim(c)), "^0x|[: ]", "")
        t = F.when(F.length(t) % 2 == 1, F.concat(F.lit("0"), t)).otherwise(t)
        return F.when(t.rlike("^[0-9a-f]+$"), F.lpad(t, F.greatest(digits, F.length(t)), "0"))

    return F.coalesce(one(unmasked), one(value))


def relative_ranges(fields: DataFrame, spans: DataFrame | None = None, keys: Sequence[str] = PACKET) -> DataFrame:
    """Inclusive payload ranges of dissected fields.

    ``fields``: keys, field_offset, field_length; ``spans``: keys, offset, length of
    the packet's protocols.  The base is the lowest protocol offset, else the
    lowest field offset; empty and negative ranges are dropped.
    """
    keys = list(keys)
    usable = F.col("field_length") > 0
    low = fields.where(usable).groupBy(*keys).agg(F.min("field_offset").alias("_f"))
    if spans is not None:
        low = low.join(spans.groupBy(*keys).agg(F.min("offset").alias("_p")), keys, "left")
    else:
        low = low.withColumn("_p", F.lit(None).cast("int"))
    d = fields.where(usable).join(low.withColumn("base", F.coalesce("_p", "_f")).drop("_p", "_f"), keys)
    a = F.col("field_offset") - F.col("base")
    return d.withColumn("a", a).withColumn("b", a + F.col("field_length") - 1).where(F.col("a") >= 0)


def in_span(ranges: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranges that lie inside their own protocol's span (relative ``a``/``b``); protocols without a span keep all."""
    s = spans.groupBy(*keys).agg(F.min("span_a").alias("_lo"), F.max("span_b").alias("_hi"))
    return ranges.join(s, list(keys), "left").where(
        F.col("_lo").isNull() | ((F.col("a") >= F.col("_lo")) & (F.col("b") <= F.col("_hi")))
    ).drop("_lo", "_hi")


def packet_view(ranges: DataFrame, keys: Sequence[str] = PACKET) -> DataFrame:
    """Truth fields of each packet: leaves plus what containers leave uncovered, cut into atoms.

    ``ranges``: keys, a, b, has_children.
    """
    keys = list(keys)
    leaf = ranges.where(~F.col("has_children")).select(*keys, "a", "b")
    box = ranges.where(F.col("has_children")).select(*keys, "a", "b")
    rest = subtract(box, leaf, keys).select(*keys, "a", "b")
    return atomize(leaf.unionByName(rest), keys)


def align_samples(samples: DataFrame, offsets: DataFrame) -> DataFrame:
    """Replay sample names with the packet number of the dissector: index plus the protocol's offset.

    ``samples``: protocol_name, replay_index; ``offsets``: protocol_name, shift (one row per protocol).
    """
    d = samples.join(offsets, "protocol_name", "left")
    number = F.col("replay_index") + F.coalesce("shift", F.lit(0))
    return d.withColumn("replay_sample_id", F.format_string("sample_%03d", "replay_index")).withColumn(
        "packet_sample_id", F.format_string("sample_%03d", number)
    ).drop("shift")


def export_truth(ranges: DataFrame, alignment: DataFrame) -> DataFrame:
    """Truth ranges as field ids under the replay sample names."""
    return ranges.join(alignment, ["protocol_name", "packet_sample_id"]).select(
        "protocol_name", F.col("replay_sample_id").alias("sample_id"), field_key(F.col("a"), F.col("b")).alias("field_id")
    ).distinct()


# --- labels ---------------------------------------------------------------------

# Fixed label rules, first match wins: (label, coarse tag, part of the field, words).
# Parts: name = field name, text = all texts, token = whole token of the name.
RULES = [
    ("reserved", "other_or_unknown", [("text", ["reserved", "padding"])]),
    ("transaction_id", "identifier", [("name", ["trans_id", "transaction"])]),
    ("protocol_id", "identifier", [("name", ["prot_id", "protocol_id"]), ("text", ["protocol identifier"])]),
    ("protocol_id", "identifier", [("name", ["version"])]),
    ("session_id", "identifier", [("name", ["session"])]),
    ("session_id", "identifier", [("name", ["context"])]),
    ("invoke_id", "identifier", [("name", ["invoke"])]),
    ("pdu_reference", "identifier", [("name", ["pduref", "pdu_ref", "pdu-reference", "pdu.reference"])]),
    ("pdu_reference", "identifier", [("token", ["rx", "tx"])]),
    ("protocol_id", "identifier", [("name", ["protid"])]),
    ("unit_id", "identifier", [("name", ["unit_id", "unitid"])]),
    ("domain_id", "identifier", [("name", ["domainid", "domain_id"])]),
    ("item_id", "identifier", [("name", ["itemid", "item_id"])]),
    ("session_id", "identifier", [("name", ["iface", "serial_num", "vendor"])]),
    ("length", "length_or_count", [("name", ["length", ".len", "_len", "apdulen", "byte_cnt", "byte_count", "size"]), ("token", ["li"]), ("text", ["length:", "byte count"])]),
    ("quantity", "length_or_count", [("name", ["quantity", "qty"])]),
    ("count", "length_or_count", [("name", ["count", "_cnt", ".cnt", "numix"]), ("text", [" count:", "quantity"])]),
    ("function_code", "control_or_flags", [("name", ["func_code", "function", "command"]), ("token", ["func"])]),
    ("service_code", "control_or_flags", [("name", ["service"])]),
    ("cause_of_transmission", "control_or_flags", [("name", ["cause"])]),
    ("status", "control_or_flags", [("name", ["status", "error"])]),
    ("type_id", "control_or_flags", [("name", ["rosctr", "typeid", "type_id"]), ("token", ["type"])]),
    ("flag", "control_or_flags", [("name", ["start", "qos", "timeout", "control", "option", "priority", "pduflags", "flags"]), ("mask", [])]),
    ("common_address", "addressing", [("name", ["common_address", "causetx_originator", "originator"])]),
    ("common_address", "addressing", [("token", ["oa"])]),
    ("object_address", "addressing", [("name", ["object_address", "ioa"])]),
    ("address", "addressing", [("name", ["reference_num", "regnum", "reference", "addr", "address", "destref", "srcref"])]),
    ("class_id", "addressing", [("name", ["class_id", ".class", "_class"])]),
    ("instance_id", "addressing", [("name", ["instance"])]),
    ("attribute_id", "addressing", [("name", ["attribute"])]),
    ("instance_id", "addressing", [("text", ["device instance range", "property identifier"])]),
    ("timestamp", "data_value", [("text", ["cp56time", "timestamp", "utc_time", "time of day", "milliseconds"])]),
    ("mask", "data_value", [("name", ["mask"])]),
    ("payload_data", "data_value", [("name", ["payload", "data"])]),
    ("value", "data_value", [("name", ["regval", "value", "boolean", "integer", "float"])]),
]
# Fixed finer names of time labels, first match wins; no match means "value".
TIME_RULES = [
    ("timestamp_ms", ["millisecond", ".milliseconds", "timestamp_ms"]), ("timestamp_minute", ["minute"]), ("timestamp_hour", ["hour"]),
    ("timestamp_day", ["day", "dayof"]), ("timestamp_month", ["month"]), ("timestamp_year", ["year"]),
]
# Fixed words of the two structural tags.
CONSTANT_NAMES = ["version", "prot_id", "protocol_id", "protid"]
CONSTANT_TEXT = ["reserved", "padding", "shall be zero", "must be zero"]
STRUCTURE = ["lvt", "tag", "segment", "ber.", "wrapper", "variablespecification"]


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join("".join(f"\\{ch}" if not ch.isalnum() and ch not in " _" else ch for ch in w) for w in words))


def _token(text: Column, words: list[str]) -> Column:
    # Fixed token borders: dot, underscore, backslash and the letter s.
    return text.rlike(r"(^|[._s\\])(" + "|".join(words) + r")($|[._s\\])")


def label_fields(df: DataFrame, bitmask: str | None = None) -> DataFrame:
    """Rule-based label, coarse tag, structural tags, review flag and note.

    ``df``: field_name, parent_field, showname, display_value (missing ones count as empty).
    """
    text_of = lambda names: F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns]))
    d = df.withColumn("_name", F.lower(F.coalesce("field_name", F.lit(""))))
    d = d.withColumn("_text", text_of(["field_name", "parent_field", "showname", "display_value"]))
    d = d.withColumn("_frame", text_of(["field_name", "parent_field"]))
    name, text = F.col("_name"), F.col("_text")
    rule = None
    for i, (_, _, parts) in enumerate(RULES):
        cond = F.lit(False)
        for where, words in parts:
            if where == "mask":
                cond = cond | (F.coalesce(F.col(bitmask), F.lit("")) != "" if bitmask else F.lit(False))
            else:
                cond = cond | (_token(name, words) if where == "token" else _any(name if where == "name" else text, words))
        rule = F.when(cond, i) if rule is None else rule.when(cond, i)
    time = F.lit("value")
    for label, words in reversed(TIME_RULES):
        time = F.when(_any(text, words), label).otherwise(time)
    show = F.lower(F.coalesce(F.col("showname"), F.lit(""))) if "showname" in df.columns else F.lit("")
    value = F.lower(F.coalesce(F.col("display_value"), F.lit(""))) if "display_value" in df.columns else F.lit("")
    constant = _any(name, CONSTANT_NAMES) | _any(text, CONSTANT_TEXT) | (show.contains("protocol identifier") & value.isin("0", "0x00000000"))
    structure = _any(F.col("_frame"), STRUCTURE)
    tags = F.filter(F.array(F.when(constant, "constant_like"), F.when(structure, "structure_or_encoding")), lambda x: x.isNotNull())
    d = d.withColumn("_rule", rule).withColumn("structure_tags", tags)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("_rule"))
    label = pick([r[0] for r in RULES])
    none = F.col("_rule").isNull()
    note = (
        F.when(none & F.array_contains("structure_tags", "structure_or_encoding"), "structure/encoding wrapper; review if it maps to a finer semantic role")
        .when(none, "no rule matched")
        .when(F.col("_rule") == 3, "version treated as protocol identifier")
        .when(F.col("_rule") == 8, "transport/APDU sequence counter").otherwise("")
    )
    return d.withColumn("label", F.when(none, "unknown").when(label == "timestamp", time).otherwise(label)).withColumn(
        "coarse_tag", F.coalesce(pick([r[1] for r in RULES]), F.lit("other_or_unknown"))
    ).withColumn("needs_review", none).withColumn("note", note).drop("_name", "_text", "_frame", "_rule")


def label_candidates(fields: DataFrame) -> DataFrame:
    """Field ids of dissected fields: byte range, or lowest and highest bit when bits are known.

    ``fields``: a, b (relative), bits array or null.
    """
    has = F.coalesce(F.size("bits") > 0, F.lit(False))
    return fields.withColumn(
        "field_id", field_key(F.col("a"), F.col("b"), F.when(has, F.array_min("bits")), F.when(has, F.array_max("bits")))
    )


def label_summary(labels: DataFrame, k: int = 30) -> DataFrame:
    """Counts by protocol, by tag, by review flag and of the k most frequent labels, in one long table."""
    one = labels.groupBy("protocol_name", "coarse_tag", "label", "needs_review").agg(F.count(F.lit(1)).alias("n"))
    cut = lambda kind, c: one.groupBy(F.col(c).cast("string").alias("value")).agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    top = top_k(cut("label", "label"), ["kind"], [F.desc("n"), F.col("value")], ["value"], k).select("kind", "value", "n")
    return cut("protocol", "protocol_name").unionByName(cut("tag", "coarse_tag")).unionByName(cut("needs_review", "needs_review")).unionByName(top)


# --- response documents -----------------------------------------------------------

DOC_FIELD = T.StructType([T.StructField("field_id", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("summary", T.StringType())])
# A document is one field or holds a list of them.
DOC = T.StructType([*DOC_FIELD.fields, T.StructField("fields", T.ArrayType(DOC_FIELD))])


def normal_field_id(c: Column) -> Column:
    """``b:5`` becomes ``b:5:5``; other ids stay."""
    return F.regexp_replace(F.trim(c), r"^b:(\d+)$", "b:$1:$1")


def collect_fields(docs: DataFrame, text: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(field rows, parse errors) of response texts; ``name`` is an optional file name whose
    ``<seq>_<protocol>_<packet>`` form gives the keys."""
    d = extract_json(docs, text, DOC)
    single = F.struct("doc.field_id", "doc.tags", "doc.summary")
    listed = F.filter(F.coalesce("doc.fields", F.array(single)), lambda f: f["field_id"].isNotNull())
    d = d.withColumn("_fields", listed).withColumn("error", F.when(F.col("error").isNull() & (F.size("_fields") == 0), "missing key").otherwise(F.col("error")))
    if name:
        part = lambda i: F.regexp_extract(F.col(name), r"(\d+)_([^_]+)_(pkt_\d+)", i)
        d = d.withColumn("seq", part(1).try_cast("int")).withColumn("protocol_name", part(2)).withColumn("sample_id", part(3))
    good = d.where(F.col("error").isNull()).withColumn("_f", F.explode("_fields"))
    good = good.withColumn("field_id", normal_field_id(F.col("_f.field_id"))).withColumn("tags", F.col("_f.tags"))
    return good.drop("doc", "error", "_fields", "_f", text), d.where(F.col("error").isNotNull()).drop("doc", "_fields")


def gap_rows(ranges: DataFrame, lengths: DataFrame, keys: Sequence[str], length: str = "length") -> DataFrame:
    """Uncovered byte runs of each payload as rows flagged for review.

    A range that leaves its payload is ignored as a whole.
    """
    keys = list(keys)
    limit = lengths.where(F.col(length) > 0).groupBy(*keys).agg(F.max(length).alias("_n"))
    inside = ranges.select(*keys, "a", "b").join(limit, keys).where((F.col("a") >= 0) & (F.col("a") <= F.col("b")) & (F.col("b") < F.col("_n")))
    # One row per start, and the end of the payload as the last: a gap lies between a start and what was covered before.
    kind = lengths.schema[length].dataType
    starts = inside.groupBy(*keys, F.col("a").cast(kind).alias("a")).agg(F.max(F.col("b").cast(kind)).alias("b"))
    ends = limit.select(*keys, F.col("_n").alias("a"), F.col("_n").alias("b"))
    prior = Window.partitionBy(*keys).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    d = starts.unionByName(ends).withColumn("_from", F.coalesce(F.max("b").over(prior) + 1, F.lit(0)).cast(kind))
    gaps = d.where(F.col("_from") < F.col("a")).select(*keys, F.col("_from").alias("a"), (F.col("a") - 1).cast(kind).alias("b"))
    return gaps.withColumn("field_id", field_key(F.col("a"), F.col("b"))).withColumn("needs_review", F.lit(True))


# Fixed marks of texts that wait for a person, and the review reason that says so by itself.
MARKERS = ["人工校验补齐", "人工校验修正", "人工校验保留", "manual boundary correction"]
PLACEHOLDER_REASON = "manual boundary correction"


def placeholders(df: DataFrame, cols: Sequence[str], reason: str | None = None) -> DataFrame:
    """Rows whose texts hold a placeholder mark, or whose review reason is the placeholder reason."""
    text = F.concat_ws("\n", *cols, *([reason] if reason else []))
    marked = F.lit(False) if reason is None else F.coalesce(F.col(reason) == PLACEHOLDER_REASON, F.lit(False))
    for m in MARKERS:
        marked = marked | text.contains(m)
    return df.where(marked)


def merge_updates(fields: DataFrame, updates: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fields with updated columns and an audit word: ``updated``, ``missing`` (no update) or ``unexpected`` (no field)."""
    u = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_u"))
    d = fields.withColumn("_f", F.lit(True)).join(u, list(keys), "full")
    audit = F.when(F.col("_f").isNull(), "unexpected").when(F.col("_u").isNull(), "missing").otherwise("updated")
    return d.withColumn("audit", audit).select(
        *keys, *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in cols], "audit"
    )


def upsert_latest(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Latest row per key of two result tables; a tie keeps the new table's row."""
    both = old.withColumn("_w", F.lit(0)).unionByName(new.withColumn("_w", F.lit(1)))
    names = [c for c in old.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(version, "_w")).alias("_r")).select(*key, "_r.*")
