import pytest
from hypothesis import settings
from pyspark.sql import functions as F

# The first call of a test may load tables; wall-clock deadlines say nothing on a busy machine.
settings.register_profile("no_deadline", deadline=None)
settings.load_profile("no_deadline")

# Names that the operators use inside; here they are columns of the table.
CLASHING = ["class", "n", "group", "score", "label", "posterior", "words", "spans", "n_tokens"]
CLASHING += ["row", "named", "known", "keep", "keep_id", "rank", "digest", "bad", "key", "tree"]
CLASHING += ["__named", "__known", "__keep", "__keep_id", "__rank", "__digest", "__pipeline_score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while nine wizards box with vexing jinx "


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows and ids."""
    long_text = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, PROSE * 3, "en", "a", 10),
        (1, PROSE * 3, "en", "a", 10),
        (2, PROSE * 3, None, None, None),
        (2, "other text under the same id", "en", "a", 1),
        (3, None, "en", "a", None),
        (4, "", "fr", "b", 0),
        (5, " \t\n ", "fr", "b", 3),
        (6, long_text, "en", "b", len(long_text)),
        (None, PROSE, "en", "c", 1),
        (None, None, None, None, None),
        (7, "éè \U0001f600 \x00 x\x1cy", "fr", "c", 1),
        (8, "x" * 200_000, "en", "c", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (3, 0, 0), (4, None, None), (None, 1, 1), (6, 1, 0)]
    rows += [(5, 0, 1), (7, 1, 0), (8, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
