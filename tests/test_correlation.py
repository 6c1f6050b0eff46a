"""Correlation of axes with probes against pandas, and the plan it takes."""

import re

import numpy as np
import pandas as pd

from fieldscope.operators import profile as P


def test_axes_and_probes_with_ties_nulls_and_constants(spark):
    rng = np.random.default_rng(11)
    emb = pd.DataFrame(rng.normal(size=(400, 2)), columns=["z1", "z2"])
    emb["z2"] = emb["z2"].round(1) + 1e9  # ties at a large offset
    probes = pd.DataFrame(rng.integers(0, 5, (400, 3)).astype(float), columns=["DTM_x", "loop_count", "flat"])
    probes["flat"] = 2.0
    probes["DTM_x"] += emb["z1"]
    emb["id"] = probes["id"] = range(400)
    gone = {3: None, 7: float("nan"), 8: float("inf")}
    rows = [(int(i), *[gone[i] if c == "DTM_x" and i in gone else float(v) for c, v in zip(["DTM_x", "loop_count", "flat"], x)])
            for i, x in zip(probes["id"], probes[["DTM_x", "loop_count", "flat"]].to_numpy())]
    left = spark.createDataFrame(emb[["id", "z1", "z2"]])
    right = spark.createDataFrame(rows, "id long, DTM_x double, loop_count double, flat double").where("id <> 10")
    d = P.axis_probe_corr(left, right, ["z1", "z2"], ["DTM_x", "loop_count", "flat"], ["id"])
    got = {(r.axis, r.probe): (r.pearson, r.spearman) for r in d.collect()}
    kept = emb.merge(probes, on="id")
    kept = kept[~kept["id"].isin([*gone, 10])]
    ranks = kept.rank()
    assert len(got) == 6
    for a in ("z1", "z2"):
        assert got[a, "flat"] == (None, None)
        for p in ("DTM_x", "loop_count"):
            assert np.allclose(got[a, p], (kept[a].corr(kept[p]), ranks[a].corr(ranks[p])), atol=1e-7)
    plan = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    count = lambda what: len(re.findall(rf"{what} ", plan))
    # Rows are never multiplied by pairs, and the joined inputs are read from one written table.
    assert count("Generate") == 0 and count("FileScan") <= 4
    assert len(set(re.findall(r"probe_rows-[0-9a-f]+", plan))) <= 1
    assert P.axis_probe_corr(left.limit(0), right, ["z1", "z2"], ["flat"], ["id"]).count() == 0
