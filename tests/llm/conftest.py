from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) or (doc_id, text, lang)."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, *lang = r
            full.append((doc_id, text, lang[0] if lang else "en", "src0", None if text is None else len(text)))
        return spark.createDataFrame(full, DOC)

    return make
