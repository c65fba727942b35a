"""Root-cause records: the trigger of each session with its context, and the texts for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlogs import chains
from sessionlogs.objects import item, opened
from sessionlogs.parse import content_severity, iso_time
from sessionlogs.schemas import ANALYSIS, RECOMMENDATIONS
from sessionlogs.skew import LIST_ITEMS


PRETTY = {"pretty": "true", "ignoreNullFields": "false"}


def chain_of_trigger(triggers: DataFrame, pool: DataFrame) -> DataFrame:
    """Triggers whose chain is found: one with an error of the same message or time.

    A session has one chain, so its id names it. Errors are reduced to their
    distinct messages and times first; both lookups are then equi-joins with one
    match per trigger.
    """
    errors = pool.where("in_chain")
    found = [
        triggers.join(
            errors.groupBy("session_id", value.alias(key)).agg(F.count(F.lit(1)).alias("_n")),
            ["session_id", key],
            "left_semi",
        ).select("session_id")
        for key, value in (("message", F.col("message")), ("timestamp", iso_time(F.col("ts"))))
    ]
    return found[0].unionByName(found[1]).distinct()


def trigger_context(triggers: DataFrame, nodes: DataFrame, pool: DataFrame) -> DataFrame:
    """Triggers with the root call of their session and the header of their chain.

    Sessions without a tree get the root ``unknown``, triggers without a chain the
    impact ``UNKNOWN``.
    """
    roots = nodes.where(F.col("level") == 0).select("session_id", F.col("urc").alias("root_urc"))
    headers = chains.chain_headers(pool).join(
        chain_of_trigger(triggers, pool), "session_id", "left_semi"
    )
    return (
        triggers.join(roots, "session_id", "left")
        .join(headers, "session_id", "left")
        .withColumn("root_urc", F.coalesce("root_urc", F.lit("unknown")))
        .withColumn("impact_level", F.coalesce("impact_level", F.lit("UNKNOWN")))
    )


def scalar_fields() -> list[Column]:
    """The fields of a root-cause record that hold one value."""
    absent = F.lit(None).cast("string")
    return [
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("message", F.lit("")).alias("triggering_error_message"),
        F.coalesce("error_type", F.lit("unknown")).alias("triggering_error_type"),
        F.coalesce("source", F.lit("unknown")).alias("source_service_from_log"),
        F.col("session_id"),
        F.col("root_urc").alias("root_urc_of_session"),
        F.col("urc").alias("error_specific_urc"),
        F.col("uid").alias("error_specific_uid"),
        # chain errors do not carry these two
        absent.alias("error_specific_api_endpoint"),
        absent.alias("error_specific_transaction_type"),
        F.col("impact_level").alias("overall_chain_impact"),
    ]


def trigger_as_error() -> Column:
    names = ["timestamp", "level", "source", "message", "error_type", "urc", "uid"]
    return F.struct(*names, "calculated_severity")


def _chain(errors: Column, own: bool = True) -> Column:
    """Chain details; a trigger whose chain is not found stands for itself. ``own=False`` leaves the errors out."""
    found = F.col("total_errors").isNotNull()
    return F.struct(
        "session_id",
        *([F.when(found, errors).otherwise(F.array(trigger_as_error())).alias("errors")] if own else []),
        F.coalesce("total_errors", F.lit(1)).alias("total_errors"),
        "impact_level",
        F.when(found, F.struct(*chains.BREAKDOWN)).alias("severity_breakdown"),
    )


def _with_model_output(context: DataFrame, model_output: DataFrame | None) -> DataFrame:
    """Triggers with ``llm_initial_analysis`` and ``llm_recommendations``; given output, those without an analysis are left out."""
    if model_output is None:
        return context.withColumns({"llm_initial_analysis": F.lit(None).cast(ANALYSIS), "llm_recommendations": F.lit(None).cast(RECOMMENDATIONS)})
    known = model_output.where(F.col("llm_initial_analysis").isNotNull())
    return context.join(known.select("session_id", "llm_initial_analysis", "llm_recommendations"), "session_id")


def root_cause_records(nodes: DataFrame, pool: DataFrame, model_output: DataFrame | None = None, size: int = LIST_ITEMS) -> DataFrame:
    """One record per trigger, with its error chain; the errors of a chain of more than ``size`` are NULL here.

    ``model_output`` has ``session_id`` and, as structs, ``llm_initial_analysis`` and
    ``llm_recommendations``; sessions without an analysis are then left out.
    """
    context = _with_model_output(trigger_context(chains.trigger_errors(pool), nodes, pool), model_output)
    rows = context.join(chains.chain_errors(pool, size).drop("n_items"), "session_id", "left")
    return rows.select(
        *scalar_fields(), _chain(F.col("errors")).alias("full_error_chain_details_for_context"), "llm_initial_analysis", "llm_recommendations"
    )


def root_cause_objects(nodes: DataFrame, pool: DataFrame, model_output: DataFrame | None = None, timestamp: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``{session_id, timestamp, root_causes[]}`` as marks and pieces for ``objects.write_objects``, with errors of any number."""
    rows = _with_model_output(trigger_context(chains.trigger_errors(pool), nodes, pool), model_output)
    now = F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss") if timestamp is None else timestamp
    found = F.col("total_errors").isNotNull()
    chain = opened(_chain(F.array().cast("array<string>"), own=False))
    head = F.concat(
        opened(F.struct("session_id", now.alias("timestamp"))), F.lit(',"root_causes":['),
        opened(F.struct(*scalar_fields())), F.lit(',"full_error_chain_details_for_context":'), chain, F.lit(',"errors":['),
        F.when(found, "").otherwise(item(trigger_as_error())),
    )
    given = opened(F.struct("llm_initial_analysis", "llm_recommendations"))
    end = F.concat(F.lit("]},"), F.substring(given, F.lit(2), F.length(given)), F.lit("}]}"))
    marks = rows.select("session_id", F.array(head, end).alias("marks"), found.alias("found"))
    items = chains.error_pieces(pool, 0).join(marks.where("found").select("session_id"), "session_id", "left_semi")
    return marks.drop("found"), items


def _detail(label: str, value: Column | str, default: str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"- {label}: "), F.coalesce(value, F.lit(default)))


def _documentation(context: str | Column) -> Column:
    return F.coalesce(context if isinstance(context, Column) else F.lit(context), F.lit(""))


def rca_context(nodes: DataFrame, pool: DataFrame, doc_context: str | Column = "", size: int = LIST_ITEMS) -> DataFrame:
    """The facts about each trigger as one text: details, error chain as JSON, documentation (see ``retrieval.fixed_context``).

    A chain of more than ``size`` errors is given by its header, with ``null`` for the errors.
    """
    context = trigger_context(chains.trigger_errors(pool), nodes, pool)
    rows = context.join(chains.chain_errors(pool, size).drop("n_items"), "session_id", "left")
    text = F.concat_ws(
        "\n",
        _detail("Session ID", "session_id", "unknown"),
        _detail("URC", "urc", "N/A"),
        _detail("UID", "uid", "N/A"),
        _detail("Service", "source", "unknown"),
        _detail("Error type", "error_type", "unknown"),
        _detail("Message", "message", ""),
        _detail("Severity", content_severity(F.col("message")), "LOW"),
        _detail("API endpoint", F.lit(None).cast("string"), "N/A"),
        _detail("Transaction type", F.lit(None).cast("string"), "N/A"),
        F.lit("Error chain:"),
        F.to_json(_chain(F.col("errors")), PRETTY),
        F.lit("Documentation:"),
        _documentation(doc_context),
    )
    return rows.select("session_id", text.alias("context"))


def recommendation_context(
    triggers: DataFrame, analyses: DataFrame, doc_context: str | Column = ""
) -> DataFrame:
    """The facts for recommendations: the analysis as JSON and its trigger.

    ``analyses`` has ``session_id`` and ``llm_initial_analysis``; rows without one are skipped. Both sides grow with the input,
    and the estimate of parsed replies is far too small (about a byte a row), so the join is by shuffle, never by broadcast.
    """
    rows = triggers.hint("merge").join(
        analyses.where(F.col("llm_initial_analysis").isNotNull()), "session_id"
    )
    text = F.concat_ws(
        "\n",
        F.lit("Analysis:"),
        F.to_json("llm_initial_analysis", PRETTY),
        _detail("Message", "message", "N/A"),
        _detail("Error type", "error_type", "unknown"),
        _detail("Session ID", "session_id", "unknown"),
        _detail("Service", "source", "unknown"),
        F.lit("Documentation:"),
        _documentation(doc_context),
    )
    return rows.select("session_id", text.alias("context"))
