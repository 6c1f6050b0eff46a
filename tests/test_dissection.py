"""Packet trees are parsed once, whatever their depth."""

import os

import pytest

from fieldscope.plans.source_queries import dissection_flatten
from fieldscope.session import scratch_path
from fieldscope.sources.dissection import read_dissection


def write(path, levels):
    tree = "".join(f'<field name="n{i}" pos="{i}" size="1">' for i in range(levels)) + "</field>" * levels
    chain = '<proto name="frame"><field name="frame.protocols" show="eth:ip:tcp:p"/></proto>'
    path.write_text(f'<packet>{chain}<proto name="p" pos="0" size="9">{tree}<field name="flat" pos="8" size="1"/></proto></packet>\n')
    return str(path)


@pytest.mark.parametrize("levels", [1, 3, 5, 6, 12])
def test_all_levels_without_another_parse(spark, tmp_path, levels):
    d = read_dissection(spark, write(tmp_path / "p.xml", levels), one_per_line=True)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "FileScan xml" not in plan and plan.count("FileScan parquet") <= levels
    got = {r.field_name: (r.parent_field, r.has_children) for r in d.collect()}
    want = {f"n{i}": (f"n{i - 1}" if i else None, i < levels - 1) for i in range(levels)}
    assert got == want | {"flat": (None, False)}


def test_written_packets_are_compressed_and_whole(spark, tmp_path):
    path = scratch_path(spark, "probe").rsplit("/", 1)[0]
    before = set(os.listdir(path)) if os.path.isdir(path) else set()
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    rows = [(o, p, 1, n, f, "O") for o in range(9) for p in range(3) for n in (1, 2) for f in "AN"] * 2 + [(1, None, 1, 1, "A", "O"), (2, 1, 1, 1, None, "O")]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted((r.packet_index, r.protocol, r.parent_field or "", r.field_name) for r in dissection_flatten(spark, str(tmp_path)).collect())
    ranges = {(f, o, (n - 1) * 5 + p % 4, (n - 1) * 5 + p % 4 + o % 5) for o, p, _, n, f, _ in rows if None not in (o, p, f)}
    want = [(o * 4 + "AN".index(f), f.lower(), "", f"f.{a}.{b}") for f, o, a, b in ranges]
    assert got == sorted(want + [(o * 4 + "AN".index(f), f.lower(), f"f.{a}.{b}", f"c.{a}") for f, o, a, b in ranges if b > a])
    texts = [x for d in set(os.listdir(path)) - before if d.startswith("dissection-") for x in os.listdir(f"{path}/{d}") if x.startswith("part-")]
    assert texts and all(x.endswith(".gz") for x in texts)
