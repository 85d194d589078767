import pytest

#: Names that the operators use inside, as columns of an input.
CLASHING = ["key", "n", "digest", "ref", "bucket", "tokens", "rank", "part", "lang_pred", "score", "spans", "component_id"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents of (doc_id, text[, lang]) with extra columns."""
        extra = ", ".join(f"`{name}` string" for name in CLASHING)
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")

    return make
