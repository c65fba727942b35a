"""Small document tables with the awkward cases that every operator must bear."""

from __future__ import annotations

LONG = "word " * 50_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(spark):
    return documents(spark, [(1, None, None), (2, ""), (3, LONG), (4, "a b c"), (4, "a b c"), (None, "null id", "t"), (5, " \n\t "), (6, "é ü 漢字 \U0001f600 x")])
