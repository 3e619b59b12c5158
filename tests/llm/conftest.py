import pytest
from pyspark.sql import Row

WORDS = "the cat sat on a mat and the dog ran to it with an old hat from here".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case: null and empty texts, null ids and languages, repeated rows, ties, long texts, clashing columns."""
    rows = [
        (1, " ".join(WORDS), "en"), (2, " ".join(WORDS), "en"), (2, " ".join(WORDS), "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "fr"),
        (None, "no id here at all", "en"), (6, "word", "en"), (7, "WORD", "de"), (8, "Été à la plage ☃ 𓀀", "fr"), (9, "x" * 300_000, "en"), (10, "one two three four five six seven " * 9_000, "en"),
        (11, " ".join(WORDS[1:]), "en"), (12, "!!! ### 123", None), (13, " ".join(WORDS) + " tail", "en"),
    ]
    clash = [Row(doc_id=i, text=t, lang=g, source="s", n_chars=0, node="n", root=1, lang_pred="?", toxic_score=2.0, signatures="z", kept=None) for i, t, g in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, root int, lang_pred string, toxic_score double, signatures string, kept boolean"
    return spark.createDataFrame(clash, schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, None, None), (6, 1, 0), (6, 1, 1), (99, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
