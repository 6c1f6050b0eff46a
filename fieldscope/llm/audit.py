"""How filters interact: every order of the filters, from one decision diagram a part.

A document's failures are a mask with one bit a filter.  Documents are counted by part and mask; a
part then is a few counts (at most 2^filters), however many rows it has.  A decision diagram
holds them: one level a filter, low edge for documents that pass, high edge for those that fail,
leaves with counts, equal nodes shared, every node with the counts below it.  Two neighbouring levels
can be swapped by touching these two levels only; going through all orders by such swaps (plain
changes) costs one swap an order.  In each order, the path of low edges from the root is what
survives: at level i the high edge carries what filter i removes, the low edge what it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

Counts = tuple[int, ...]


class Diagram:
    """Count-weighted decision diagram over failure masks with a level for every filter.

    ``levels[i]`` maps a node to its (low, high) children on the next level; the children of the
    last level are leaves.  ``weight[i]`` has the counts below a node of level i (i = number of
    filters: of a leaf).  Nodes of a level differ in their children, so equal subfunctions are one.
    """

    def __init__(self, filters: Sequence[str], counts: dict[int, Counts], width: int):
        self.order, n = list(filters), len(filters)
        zero = (0,) * width
        unique: dict = {}
        below = [unique.setdefault(counts.get(_mask(leaf, n), zero), len(unique)) for leaf in range(1 << n)]
        self.weight: list[dict[int, Counts]] = [{v: w for w, v in unique.items()}]
        self.levels: list[dict[int, tuple[int, int]]] = []
        for _ in range(n):
            unique = {}
            below = [unique.setdefault(pair, len(unique)) for pair in zip(below[::2], below[1::2])]
            self.levels.insert(0, {v: pair for pair, v in unique.items()})
            self.weight.insert(0, {v: _plus(self.weight[0][a], self.weight[0][b]) for (a, b), v in unique.items()})
        self.root = below[0]

    def swap(self, i: int) -> None:
        """Exchange levels i and i + 1; nodes above and below keep their identity."""
        upper, lower, under = self.levels[i], self.levels[i + 1], self.weight[i + 2]
        unique: dict[tuple[int, int], int] = {}
        for node, (low, high) in upper.items():
            (a, b), (c, d) = lower[low], lower[high]
            upper[node] = unique.setdefault((a, c), len(unique)), unique.setdefault((b, d), len(unique))
        self.levels[i + 1] = {v: pair for pair, v in unique.items()}
        self.weight[i + 1] = {v: _plus(under[a], under[b]) for (a, b), v in unique.items()}
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> Iterator[tuple[str, Counts, Counts]]:
        """(filter, counts kept, counts removed) along the path on which everything passes."""
        node = self.root
        for i, name in enumerate(self.order):
            low, high = self.levels[i][node]
            yield name, self.weight[i + 1][low], self.weight[i + 1][high]
            node = low


def _mask(leaf: int, n: int) -> int:
    """Leaves are numbered with the first filter as the highest bit, masks with it as the lowest."""
    return sum((leaf >> (n - 1 - i) & 1) << i for i in range(n))


def _plus(a: Counts, b: Counts) -> Counts:
    return tuple(x + y for x, y in zip(a, b))


def plain_changes(n: int) -> Iterator[int]:
    """Positions i whose swaps with i + 1, one after the other, lead through all n! orders."""
    if n < 2:
        return
    inner = list(plain_changes(n - 1))
    for at in range(len(inner) + 1):
        yield from range(n - 2, -1, -1) if at % 2 == 0 else range(n - 1)
        if at < len(inner):
            yield inner[at] + 1 if at % 2 == 0 else inner[at]


def audit_rows(filters: Sequence[str], counts: dict[int, Counts]) -> list[tuple]:
    """(order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders.

    ``counts`` maps a mask to (documents, good ones, toxic ones).
    """
    fails = {f: sum(c[0] for m, c in counts.items() if m >> i & 1) for i, f in enumerate(filters)}
    alone = {f: counts.get(1 << i, (0,))[0] for i, f in enumerate(filters)}
    diagram = Diagram(filters, counts, 3)
    rows, shapley = [], dict.fromkeys(filters, 0)
    changes = plain_changes(len(filters))
    while True:
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[name] += removed[0]
            rows.append((order, step, name, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2]))
        change = next(changes, None)
        if change is None:
            return [(*r, shapley[r[2]]) for r in rows]
        diagram.swap(change)


def text_failures(text: Column, n_words: Column, n_distinct: Column) -> dict[str, Column]:
    """Filters on one text: A too short, B repetitive, C many capitals, D symbols."""
    return {
        "A": n_words < 50,
        "B": 100 * n_distinct < 65 * n_words,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask of the filters A to E.

    E fails where a row with a smaller id has the same text (same SHA-256), whether or not other
    filters fail.  Copies are counted before they meet, so a text that a third of all rows share is a few rows: first
    by id, then by part and labels.  Null texts count as empty, null parts as the empty string; rows with a null id never
    fail E and have no labels; repeated rows count each; several label rows of an id count as one that holds each mark.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    base = base.select("id", "part", "text", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    failing = text_failures(F.col("text"), F.col("n_words"), F.col("n_distinct"))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(failing.values())), F.lit(0))
    rows = base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("same"), mask.alias("mask"))

    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    marked = rows.join(marks, "id", "left").na.fill(False, ["good", "toxic"])

    kinds = ["part", "mask", "good", "toxic"]
    by_id = marked.groupBy("same", *kinds, "id").agg(F.count(F.lit(1)).alias("c"))
    by_text = by_id.groupBy("same", *kinds).agg(
        F.sum("c").alias("n"),
        F.min("id").alias("least"),
        F.min_by("c", "id").alias("of_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("without"),
    )
    first = by_text.groupBy("same").agg(F.min("least").alias("first"))
    stays = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("of_least")).otherwise(0)
    split = by_text.join(first, "same").select(*kinds, F.array(F.struct(F.col("mask"), stays.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stays).alias("n"))).alias("s"))
    each = split.select("part", "good", "toxic", F.inline("s")).where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masks: DataFrame, filters: Sequence[str] = ("A", "B", "C", "D", "E")) -> DataFrame:
    """Mask counts (part, mask, n, good, toxic; one row a pair) -> one row per part, order of the filters and step.

    A part is at most 2^len(filters) counts, and all orders are listed, so keep the filters few.
    Parts are those that have rows; without any the result is empty.
    """
    letters = list(filters)
    arrow = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]) for name, kind in (c.split() for c in _OUT.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = {m["mask"]: (m["n"], m["good"], m["toxic"]) for m in row["counts"]}
                order, step, _, *values = zip(*audit_rows(letters, counts))
                columns = [[row["part"]] * len(order), order, step, *values]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(run, _OUT)
