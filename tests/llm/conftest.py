import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = "row size target n_words words sig rep label component rid h1 path shard train t skey position kept start".split()


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns of clashing names if asked."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})
        return df

    return make


LONG = "word " * 60_000
#: Nulls, empty texts, blanks alone, a very long text, a repeated row and a tie.
EDGES = [(1, None, None, None), (2, ""), (3, " \t\n\x0b "), (4, LONG), (5, "tie a b c"), (6, "tie a b c"), (6, "tie a b c"), (7, "Ünïcode ￿ 🧠 \x00 x"), (None, "no id", "en", "s")]
