from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or (doc_id, text) pairs; other columns, with clashing names, come along."""

    def make(texts, extra=True):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "fr", f"s{(i or 0) % 3}" if i != 4 else None, len(t or "")) for i, t in rows], DOCS)
        if extra:
            for name in ("id", "n", "size", "hub", "row", "score", "label", "sig", "h", "part", "shard", "task", "a", "component", "_slot", "words", "copies"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make


#: Nulls, empty and blank texts, one word, ties, repeated rows, a null id, and a long text.
ODD = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "a b c d e f g h"), (6, "mit license " * 30000), (7, "Ünï çödé MIT License."), (8, "123 456"), (9, "日本語 テキスト")]
