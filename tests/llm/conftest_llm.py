"""Small frames for the tests of this folder."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"


def docs_frame(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
