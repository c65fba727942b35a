"""End to end: records in, correlations and root causes out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from sessionlogs import calltree, chains, modeljson, parse, retrieval, rootcause, sessions, sinks, sources


class Analysis:
    """The tables derived from one set of records; the shared ones are written once, on first use."""

    def __init__(self, records: DataFrame, by_input_order: bool = False):
        self.records = records
        self.by_input_order = by_input_order

    @cached_property
    def positions(self) -> DataFrame:
        return sessions.positions(self.records)

    @cached_property
    def nodes(self) -> DataFrame:
        return calltree.call_tree(self.positions, self.by_input_order)

    @cached_property
    def pool(self) -> DataFrame:
        return chains.error_pool(self.positions, self.nodes)

    def log_content(self) -> DataFrame:
        return sessions.log_content(self.positions, by_input_order=self.by_input_order)

    def correlations(self) -> DataFrame:
        return chains.correlation_records(self.nodes, self.pool)

    def root_causes(self, model_output: DataFrame | None = None) -> DataFrame:
        return rootcause.root_cause_records(self.nodes, self.pool, model_output)

    def rca_contexts(self, chunks: DataFrame | None = None) -> DataFrame:
        """The text about each trigger for a model; with ``chunks`` (``vec_id, content``), also the documentation on the fixed query."""
        found = "" if chunks is None else retrieval.fixed_context(chunks, retrieval.ANALYSIS_QUERY)
        return rootcause.rca_context(self.nodes, self.pool, found)

    def recommendation_contexts(self, analyses: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """The text for recommendations from each analysis and its trigger; documentation as in ``rca_contexts``."""
        found = "" if chunks is None else retrieval.fixed_context(chunks, retrieval.REMEDY_QUERY)
        return rootcause.recommendation_context(chains.trigger_errors(self.pool), analyses, found)

    def raw_logs(self) -> DataFrame:
        """Deduplicated records of the sessions, under the field names of an index."""
        return sinks.to_indexed(self.positions, "source_bucket").drop("ts")

    def write(self, path: str, model_output: DataFrame | None = None, replies: DataFrame | None = None) -> None:
        """Write the full analysis and the root causes as JSON lines below ``path``, one object per session.

        Instead of ``model_output``, its texts can be given as ``replies`` (see ``modeljson.checked``); those that are no valid
        answers go to the table ``rejects``.
        """
        if replies is not None:
            model_output, rejects = modeljson.checked(replies)
            sinks.write_rows(rejects, f"{path}/rejects")
        sinks.write_full_analysis(self.nodes, self.pool, f"{path}/correlations")
        sinks.write_rows(self.log_content(), f"{path}/log_content")
        sinks.write_rows(self.raw_logs(), f"{path}/raw_logs")
        sinks.write_root_causes(self.nodes, self.pool, f"{path}/root_causes", model_output)


def analyse(
    spark: SparkSession,
    *,
    log_files: Sequence[str] | None = None,
    index: str | None = None,
    start_time: datetime | None = None,
    end_time: datetime | None = None,
    max_results: int | None = None,
    infer_session: bool = True,
    fmt: str = "parquet",
) -> Analysis:
    """Analyse log files or an index, exactly one of them, optionally within a time range."""
    if (log_files is None) == (index is None):
        raise ValueError("give log_files or index, exactly one of them")
    if index is not None:
        records = sources.scan_indexed_docs(spark, index, start_time, end_time, max_results, fmt)
        return Analysis(records)
    lines = sources.scan_log_text(spark, log_files, skip_missing=False)
    records = sources.with_file_bucket(parse.parse_lines(lines, infer_session))
    records = sources.time_range(records, start_time, end_time)
    return Analysis(sources.earliest(records, max_results), by_input_order=True)
