"""Ranks must not depend on the order in which parts of a table arrive."""

import json
import random

from pyspark.sql import functions as F

from fieldscope.functions import ranks
from fieldscope.operators import profile


def test_value_blocks_are_the_same_in_every_use(spark):
    anywhere = F.udf(lambda i: random.SystemRandom().randrange(16), "int").asNondeterministic()
    d = spark.range(400_000).select(F.col("id").cast("double").alias("x"))
    b = ranks.value_blocks(d.repartition(16, anywhere("x")), [], "x", limit=1000)
    firsts = lambda: sorted(tuple(r) for r in b.groupBy("_blk").agg(F.min("x")).collect())
    once = firsts()
    assert len(once) > 200 and once == firsts()


def test_equal_scores_go_by_axis(spark):
    p = spark.createDataFrame([(1, "z4", 1.0, 0.85), (1, "z5", 2.0, 1.0)], "id int, axis string, value double, percentile double")
    words = [("z4", "high", "a", "t", "high"), ("z5", "high", "b", "t", "medium")]
    s = spark.createDataFrame(words, "axis string, side string, latent_name string, definition string, confidence string")
    active = profile.active_axes(p, s)
    assert active.select("axis_score").distinct().count() == 1
    text = profile.fusion_payload(profile.field_profile(active, ["id"]), ["id"]).first().payload
    assert [x["axis"] for x in json.loads(text)["semantics"]] == ["z4", "z5"]
