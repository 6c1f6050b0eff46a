"""Explicit schemas of the artifacts the engine exchanges (never inferred)."""

from pyspark.sql import types as T

TRACE_LINE = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("sample_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("line", T.StringType()),
    ]
)

CONSTRAINT = T.StructType(
    [
        T.StructField("mask", T.StringType()),
        T.StructField("operator", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("subfield_constraint", T.StringType()),
        T.StructField("expression", T.StringType()),
        T.StructField("trace_lines", T.ArrayType(T.IntegerType())),
    ]
)

UNIT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("a", T.IntegerType()),
        T.StructField("b", T.IntegerType()),
        T.StructField("repr", T.StringType()),
        T.StructField("width_bits", T.IntegerType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("parent_repr", T.StringType()),
        T.StructField("bits", T.ArrayType(T.IntegerType())),
        T.StructField("constraints", T.ArrayType(CONSTRAINT)),
        T.StructField("synthetic_gap", T.BooleanType()),
    ]
)

SAMPLE = T.StructType(
    [
        T.StructField("mode", T.StringType()),
        T.StructField("pcap", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("index", T.LongType()),
        T.StructField("proto", T.StringType()),
        T.StructField("payload_hex", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("frozen_packet_id", T.StringType()),
        T.StructField("frozen_ordinal", T.IntegerType()),
    ]
)

FIELDS = T.StructType([T.StructField("fields", T.ArrayType(UNIT))])

# Names of the metrics of one perturbed run, in report order.
METRICS = [
    "branch_sites_jaccard", "bb_set_jaccard", "cmp_site_set_jaccard", "lcp_ratio",
    "instr_delta_ratio", "bb_multiset_l1_ratio", "suffix_instr_count", "suffix_cmp_count",
    "suffix_bb_exec_total", "cmp_delta_ratio", "branch_flip_ratio", "loop_delta_ratio",
]

MUTATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("strategy_group", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("payload_hex", T.StringType()),
        T.StructField("field_id", T.StringType()),
        T.StructField("requested_value_hex", T.StringType()),
        T.StructField("final_value_hex", T.StringType()),
        T.StructField("constraint_guided", T.BooleanType()),
    ]
)

MUTATIONS = T.StructType(
    [
        T.StructField("field", UNIT),
        T.StructField("mutations", T.ArrayType(MUTATION)),
        T.StructField("seed", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
    ]
)

REPORT = T.StructType(
    [
        T.StructField("created_at", T.DoubleType()),
        T.StructField(
            "fields",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("field_id", T.StringType()),
                        T.StructField("field_dir", T.StringType()),
                        T.StructField("field_kind", T.StringType()),
                        T.StructField("field_unit", UNIT),
                        T.StructField("baseline_field_hex", T.StringType()),
                        T.StructField(
                            "diff",
                            T.StructType(
                                [
                                    T.StructField(
                                        "per_mutation",
                                        T.ArrayType(
                                            T.StructType(
                                                [
                                                    T.StructField("run_id", T.StringType()),
                                                    T.StructField("strategy_group", T.StringType()),
                                                    T.StructField("strategy", T.StringType()),
                                                    T.StructField("final_value_hex", T.StringType()),
                                                    T.StructField(
                                                        "metrics",
                                                        T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS]),
                                                    ),
                                                ]
                                            )
                                        ),
                                    )
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)
