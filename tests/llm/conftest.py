import pytest


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Rows with nulls in every column, empty and blank texts, repeated rows, a long text, and columns with names that operators use inside.
LONG = "long words ever-changing " * 6000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It's fine!", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "  \n\t ", "de", "b"),
    (5, "The quick brown fox jumps over the lazy dog. It's fine!", "en", "b"), (5, "The quick brown fox jumps over the lazy dog. It's fine!", "en", "b"),
    (6, LONG, "en", "a"), (None, "a row without an id", "fr", "a"), (7, "Ünïcödé wörds Σας ½ 日本 🙂 <|endoftext|>x", None, "c"), (8, "aa aa aa aa", "en", None),
]
EXTRA = ["queue", "block", "n", "ids", "fp", "key", "score", "x", "y", "word", "cell", "size", "salt", "shard", "id", "part", "role", "raw", "weight", "label", "component"]


@pytest.fixture(scope="session")
def documents(spark):
    from pyspark.sql import functions as F

    from anamnesis.llm.durable import ship

    ship(spark)
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(f"other {c}") for c in EXTRA})


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
