"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlogs.llm import decontaminate, html_text, language_id, lexical_search, mixing, near_dedup, quality, secret_scan, token_output, toxicity, url_filter, warc, word_runs
from sessionlogs.llm.oracle import ORACLES as ORACLES
from sessionlogs.stage import fresh_path, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_rows(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` and reads each document's place and checksum back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    token_output.write(docs, path, tokenizer)
    # written, so that the files are decoded once
    found = materialise(token_output.read(spark, path, with_ids=False), "token_rows")
    return token_output.with_starts(found).select("doc_id", "start", "n_tokens", "ids_crc32", "file_no")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document's ids are in the output, and their checksum."""
    return token_rows(table(spark, sf_dir, "documents"))


#: Texts from this score on count as toxic.
TOXIC = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.add_score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= TOXIC).cast("int").alias("predicted")
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "n_clauses")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-duplicates of every document, by 2-word shingles."""
    return near_dedup.groups(table(spark, sf_dir, "documents"), shingle=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    path = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; words that the documents use are easy to guess."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.scan(docs, rank_of=secret_scan.learned_words(docs)).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (F.col("kept") & ~base_failed).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.add_text(pages, html_text.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


SITE_RULES = [
    url_filter.site_rule("allow", "com", "/"),
    url_filter.site_rule("block", "example.com", "/en/"),
    url_filter.site_rule("allow", "www.example.com", "/en/"),
    url_filter.site_rule("block", "net", "/es/"),
    url_filter.site_rule("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting site rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judge(pages, "url", [*SITE_RULES, *url_filter.JUNK_HOSTS])
    return out.select(
        "page_id", "host", "path", F.when(~F.col("fit").startswith("host:"), F.col("fit")).alias("rule"), "verdict",
        F.when(F.col("fit").startswith("host:"), F.col("fit")).alias("junk_rule"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of every document."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash"))
    out = mixing.mix(docs, F.col("words"), text="text_hash")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the test items found in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.inline("hits")).select("doc_id", "item_id", "score", "start", "end")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.add_language(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_period(text: Column, doc_id: Column) -> Column:
    """The text; for a tenth of the ids, its words made periodic from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, mixing.SPACE), lambda w: w != "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.concat(F.slice(words, F.lit(1), a), rest))).otherwise(text)


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, and its words without repetitions, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text"))
    out = word_runs.add_runs(docs).select("doc_id", "runs", "collapsed", word_runs.strongest(F.col("runs")).alias("best"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(word_runs.as_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every test item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_toxicity": op2_toxicity,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_warc": op4_warc,
    "op5_secrets": op5_secrets,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_url_filter": op8_url_filter,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_language_id": op11_language_id,
    "op12_word_runs": op12_word_runs,
    "op13_lexical_search": op13_lexical_search,
}
