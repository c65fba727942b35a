"""Model replies: removing code fences, parsing and checking the JSON inside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlogs.parse import evaluated_once
from sessionlogs.schemas import ANALYSIS, RECOMMENDATIONS

FENCE = "```"


def strip_code_fence(text: Column) -> Column:
    """Text inside a fence that opens and closes it: without first and last line and a ``json`` line."""
    lines = F.split(text, "\n")
    inner = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(
        text.startswith(FENCE) & text.endswith(FENCE), F.regexp_replace(inner, r"\Ajson\n", "")
    ).otherwise(text)


def parsed_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Replies with ``body`` (fence removed), its JSON as a variant (``json``) and ``parsed_ok``.

    The parser stops after the first value, so a body counts only if it is one value within a list and within
    an object too, which no trailing text can be. NaN and repeated keys make a body invalid.
    """
    body = replies.withColumn("body", strip_code_fence(F.col(reply)))
    alone = F.try_parse_json(F.concat(F.lit("["), "body", F.lit("]"))).isNotNull() & F.try_parse_json(
        F.concat(F.lit('{"v":'), "body", F.lit("}"))
    ).isNotNull()
    parsed = evaluated_once(body, "json", F.when(alone, F.try_parse_json("body")))
    return parsed.withColumn("parsed_ok", F.col("json").isNotNull())


def accepted(replies: DataFrame) -> DataFrame:
    return parsed_replies(replies).where("parsed_ok")


def rejected(replies: DataFrame) -> DataFrame:
    return parsed_replies(replies).where(~F.col("parsed_ok"))


def analyses(replies: DataFrame) -> DataFrame:
    """Checked root-cause analyses: fields, ``is_valid`` and, if not, the ``reason``.

    ``key_error_log_messages`` may be a lone string; it must end as a non-empty list of strings.
    """
    def member(name: str, kind: str = "variant") -> Column:
        return F.try_variant_get("json", f"$.{name}", kind)

    def kind_of(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(member(name)), F.lit("VOID"))

    names = ["problem_description", "probable_root_cause_summary", "key_error_log_messages",
             "confidence_score", "associated_identifiers"]
    rows = accepted(replies).select(
        "*", F.from_json("body", ANALYSIS).alias("_a"), *[kind_of(n).alias(f"_{n}") for n in names]
    )
    # a list of strings; an empty list is ARRAY<VOID>
    messages = F.when(
        F.col("_key_error_log_messages") == "STRING",
        F.array(member("key_error_log_messages", "string")),
    ).when(
        F.col("_key_error_log_messages") == "ARRAY<STRING>",
        member("key_error_log_messages", "array<string>"),
    )
    rows = rows.withColumn("key_error_log_messages", messages)
    numeric = F.col("_confidence_score").rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*|TINYINT|SMALLINT|INT)$")
    reason = (
        F.when(F.col("_problem_description") != "STRING", "problem_description")
        .when(F.col("_probable_root_cause_summary") != "STRING", "probable_root_cause_summary")
        .when(F.col("key_error_log_messages").isNull(), "key_error_log_messages")
        .when(~numeric, "confidence_score")
        .when(~F.col("_associated_identifiers").startswith("OBJECT"), "associated_identifiers")
    )
    return (
        rows.withColumn("reason", reason)
        .withColumn("is_valid", F.col("reason").isNull())
        .withColumn(
            "llm_initial_analysis",
            F.when(
                F.col("is_valid"),
                F.struct(
                    "_a.problem_description",
                    "_a.probable_root_cause_summary",
                    "key_error_log_messages",
                    "_a.confidence_score",
                    "_a.associated_identifiers",
                ),
            ),
        )
        .drop("_a", *[f"_{n}" for n in names])
    )


def _item_reason(item: Column) -> Column:
    """Name of the first field of a recommendation that has the wrong kind, NULL if all are right."""

    def kind(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")), F.lit("VOID"))

    def wrong_list(name: str) -> Column:
        return ~kind(name).isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")

    ids = "applicable_to_identifiers"
    wrong_ids = (kind(ids) != "VOID") & (
        ~kind(ids).startswith("OBJECT") | reduce(Column.__or__, [~kind(f"{ids}.{n}").isin("VOID", "STRING") for n in ("session_id", "service_name", "urc")])
    )
    return (
        F.when(~F.coalesce(F.schema_of_variant(item), F.lit("VOID")).startswith("OBJECT"), "item")
        .when(kind("recommendation_type") != "STRING", "recommendation_type")
        .when(kind("recommendation_description") != "STRING", "recommendation_description")
        .when(wrong_list("action_steps"), "action_steps")
        .when(wrong_list("relevant_documentation"), "relevant_documentation")
        .when(wrong_ids, ids)
    )


def recommendations(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Checked recommendation lists: ``item_reasons``, one per element and NULL for a right one, ``is_valid`` and the first ``reason``.

    Type and description must be strings, steps and documentation lists of strings or absent, identifiers an object of strings or absent. A
    reply that does not parse, or of which an element is wrong, has NULL ``llm_recommendations``.
    """
    rows = parsed_replies(replies, reply)
    items = F.try_variant_get("json", "$.recommendations", "array<variant>")
    rows = evaluated_once(rows, "item_reasons", F.transform(items, _item_reason))
    numbered = F.transform("item_reasons", lambda r, i: F.when(r.isNotNull(), F.concat(F.lit("recommendations["), i.cast("string"), F.lit("]."), r)))
    first = F.get(F.filter(numbered, lambda r: r.isNotNull()), F.lit(0))
    reason = F.when(~F.col("parsed_ok"), "json").when(F.col("item_reasons").isNull(), "recommendations").otherwise(first)
    rows = rows.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())
    return rows.withColumn("llm_recommendations", F.when(F.col("is_valid"), F.from_json("body", RECOMMENDATIONS)))


def checked(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies about sessions (``session_id``, ``analysis``, ``recommendations``, as texts) as model output, and what was wrong with others.

    The output has a row for each session with a valid analysis; its recommendations are NULL if theirs are not valid. The
    rejects have ``session_id``, ``part``, ``reason`` and ``reply``. A missing recommendation text is no reject.
    """
    answers = parsed_replies(replies.select("session_id", F.col("analysis").alias("reply")))
    good = analyses(replies.select("session_id", F.col("analysis").alias("reply")))
    advice = recommendations(replies.where(F.col("recommendations").isNotNull()).select("session_id", F.col("recommendations").alias("reply")))
    names = ["session_id", "llm_initial_analysis"]
    valid = advice.where("is_valid").select("session_id", "llm_recommendations")
    output = good.where("is_valid").select(*names).join(valid, "session_id", "left")
    rejects = [
        answers.where(~F.col("parsed_ok")).select("session_id", F.lit("analysis").alias("part"), F.lit("json").alias("reason"), "reply"),
        good.where(~F.col("is_valid")).select("session_id", F.lit("analysis").alias("part"), "reason", "reply"),
        advice.where(~F.col("is_valid")).select("session_id", F.lit("recommendations").alias("part"), "reason", "reply"),
    ]
    return output, reduce(DataFrame.unionByName, rejects)
