"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only
that reply is trainable.  Texts are escaped so that no control string of the template can come
from a text, and the escape can be undone exactly.  Everything runs in built-in expressions; an
example is built when its row is produced, never all examples of a conversation at once.

Template of a turn: ``### role: text</turn>`` and a line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: Letters that stand, after a backslash, for characters of a role; the backslash is written first and read last.
ROLE_CODES = {"\\": "b", ":": "c", "#": "h", "<": "l"}


def escape(text: Column) -> Column:
    """Doubles backslashes and breaks up ``##`` and ``</turn>``; all other text stays as it is."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("##"), F.lit("#\\#"))
    return F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/])", "$1")


def _role_in(role: Column) -> Column:
    """Roles lose the colon that ends them in the template, and what could be a mark of it; line breaks stay."""
    for plain, code in ROLE_CODES.items():
        role = F.replace(role, F.lit(plain), F.lit("\\" + code))
    return role


def _role_out(role: Column) -> Column:
    for plain, code in reversed(ROLE_CODES.items()):
        role = F.replace(role, F.lit("\\" + code), F.lit(plain))
    return role


def expand(turns: DataFrame, keep_tail: bool = True, trainable: str = "assistant") -> DataFrame:
    """Turns (conv_id, turn, role, text) -> one example per trainable turn.

    Result: conv_id, example (from 1, in turn order), n_turns (in the example), is_last (the
    conversation's longest example), formatted, loss_start and loss_chars (code points of
    ``formatted`` that are trainable).  With ``keep_tail`` turns after the last trainable one, or
    a conversation without any, come as a last example with nothing trainable.

    Null text and null role count as empty.  Turns are ordered by turn, then role, then text, a
    null turn first, so ties and repeated rows have one defined order and are all kept.  A null
    conv_id is a conversation of its own.  Other columns are ignored.  Empty in, empty out.
    """
    one = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    # One conversation is the unit of work: its list is as long as the conversation itself.
    convs = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), _role_in(t["role"]), F.lit(BETWEEN))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    n = F.size("roles")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(F.col("roles"), i) == trainable)
    if keep_tail:
        ends = F.when(F.element_at("roles", -1) == trainable, ends).otherwise(F.concat(ends, F.array(n)))
    convs = convs.select(
        "conv_id",
        "heads",
        "bodies",
        F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE))).alias("rendered"),
        "roles",
        ends.alias("ends"),
    )
    each = convs.select("conv_id", "heads", "bodies", "rendered", "roles", F.size("roles").alias("n"), F.posexplode("ends").alias("pos", "end"))
    target = F.element_at("roles", F.col("end")) == trainable
    before = F.aggregate(F.slice("rendered", F.lit(1), F.col("end") - 1), F.lit(0).cast("long"), lambda a, r: a + F.length(r))
    return each.select(
        "conv_id",
        (F.col("pos") + 1).cast("long").alias("example"),
        F.col("end").cast("long").alias("n_turns"),
        (F.col("end") == F.col("n")).alias("is_last"),
        F.array_join(F.slice("rendered", F.lit(1), F.col("end")), "").alias("formatted"),
        F.when(target, before + F.length(F.element_at("heads", F.col("end")))).otherwise(F.lit(0)).cast("long").alias("loss_start"),
        F.when(target, F.length(F.element_at("bodies", F.col("end")))).otherwise(F.lit(0)).cast("long").alias("loss_chars"),
    )


def parse_turns(formatted: Column) -> Column:
    """Formatted text -> array of (role, text), escapes undone."""
    pieces = F.filter(F.split(formatted, "</turn>\n", -1), lambda p: p != "")
    cut = lambda p: F.instr(p, BETWEEN)
    return F.transform(
        pieces,
        lambda p: F.struct(
            _role_out(F.substring(p, F.lit(len(OPEN) + 1), cut(p) - len(OPEN) - 1)).alias("role"),
            unescape(F.substring(p, cut(p) + len(BETWEEN), F.length(p))).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, escapes undone."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, trainable text and output size."""
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), parse_turns(F.col("formatted"))).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    )
    read = read.select(
        "conv_id",
        "chars",
        F.size("turns").cast("long").alias("size"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("digest"),
        F.struct("example", "loss").alias("part"),
    )
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["loss"]), "")
    return read.groupBy("conv_id").agg(
        F.max("size").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.length(ordered).cast("long").alias("loss_chars"),
        F.sha2(ordered, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )
