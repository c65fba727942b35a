"""Schemas of the structured records."""

from pyspark.sql import types as T

METRICS = T.StructType([T.StructField("duration_ms", T.LongType())])

# A structured log document as stored in an index; absent keys are NULL.
INDEXED_DOC = T.StructType(
    [
        T.StructField("@timestamp", T.StringType()),
        T.StructField("log.level", T.StringType()),
        T.StructField("service.name", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("is_login", T.BooleanType()),
        T.StructField("is_request", T.BooleanType()),
        T.StructField("is_response", T.BooleanType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("urc", T.StringType()),
        T.StructField("uid", T.StringType()),
        T.StructField("cif_id", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("api_endpoint", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("metrics", METRICS),
        T.StructField("source_idx", T.IntegerType()),
        T.StructField("file_idx", T.IntegerType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("line_no", T.LongType()),
        # the text of a time that could not be parsed
        T.StructField("ts_raw", T.StringType()),
        # the same as @timestamp, as a value whose bounds files know
        T.StructField("ts", T.TimestampType()),
        # partition column, from the folder names
        T.StructField("event_date", T.DateType()),
    ]
)

IDENTIFIERS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("session_id", "urc", "uid", "service_name", "api_endpoint", "transaction_type")
    ]
)

ANALYSIS = T.StructType(
    [
        T.StructField("problem_description", T.StringType()),
        T.StructField("probable_root_cause_summary", T.StringType()),
        T.StructField("key_error_log_messages", T.ArrayType(T.StringType())),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("associated_identifiers", IDENTIFIERS),
    ]
)

RECOMMENDATIONS = T.StructType(
    [
        T.StructField(
            "recommendations",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("recommendation_type", T.StringType()),
                        T.StructField("recommendation_description", T.StringType()),
                        T.StructField("action_steps", T.ArrayType(T.StringType())),
                        T.StructField("relevant_documentation", T.ArrayType(T.StringType())),
                        T.StructField(
                            "applicable_to_identifiers",
                            T.StructType(
                                [
                                    T.StructField(name, T.StringType())
                                    for name in ("session_id", "service_name", "urc")
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)
