import pytest

DATA = "/root/testdata/sf0.001"
#: Columns that a table may have besides its own, with names that operators use inside or return.
EXTRA = ["size", "taken", "target", "h", "key", "fp", "k", "n", "g", "kept", "score", "comp", "bin_id"]


@pytest.fixture
def docs(spark):
    """Documents with nulls in every column, blank, short and long texts, repeated rows and clashing columns."""
    long = " ".join(f"word{i % 977} und{i % 31}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the old stone bridge at night", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog near the old stone bridge at night", "en", "b"),
        (2, "the quick brown fox jumps over the lazy dog near the old stone bridge at night", "en", "b"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t ", "de", None),
        (6, long, "de", "b"),
        (None, "ein Satz ohne Nummer steht hier allein", "de", "c"),
        (None, None, None, None),
        (7, "1234 5678 !!", None, "c"),
        (8, "Über die Brücke geht der Weg", "de", "a"),
        (9, "two words", "en", "a"),
        (10, "the old stone bridge", None, "b"),
    ]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA:
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
