"""Models that fail, and replies that are kept."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anamnesis.functions import embedding
from anamnesis.sources.memo import Memo


def test_one_failure_in_a_thousand(spark):
    def model(texts):
        if any(t == "text 777" for t in texts):
            raise RuntimeError("no such text")
        return embedding.hashing_model(8)(texts)

    d = spark.createDataFrame([(i, f"text {i}") for i in range(1000)], "id long, text string").repartition(3)
    got = {r.id: r.e for r in d.select("id", embedding.embedder(model, reasons=True)("text").alias("e")).collect()}
    assert [i for i, e in got.items() if e.vector is None] == [777] and got[777].reason == "RuntimeError: no such text"
    plain = {r.id: r.v for r in d.select("id", embedding.embedder(embedding.hashing_model(8))("text").alias("v")).collect()}
    assert all(e.vector == plain[i] and e.reason is None for i, e in got.items() if i != 777)


def test_halving():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("bad")
        return np.array([[float("nan") if t == "odd" else 1.0] for t in texts])

    found = embedding.isolated(model, [f"t{i}" for i in range(31)] + ["bad"])
    assert [why for _, why in found] == [None] * 31 + ["ValueError: bad"] and len(calls) == 11
    assert [v is None for v, _ in embedding.isolated(model, ["a", "odd", "b"])] == [False, True, False]
    assert embedding.isolated(lambda t: np.ones((1, 2)), ["a", "b"])[1][1] is None and embedding.isolated(lambda t: np.ones((2, 2)), ["a"])[0][1] == "ValueError: 2 vectors for 1 texts"
    assert [len(b) for b in embedding.batches_of(["x"] * 5, most_texts=2)] == [2, 2, 1] and [len(b[0]) for b in embedding.batches_of(["y" * 100], most_tokens=10)] == [36]


def test_replies_are_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def model_that(fails):
        @F.udf(T.StringType())
        def run(text):
            import uuid

            if text == fails:
                raise RuntimeError(text)
            (calls / uuid.uuid4().hex).write_text(text)
            return text.upper()

        return run

    asked = lambda: sorted(f.read_text() for f in calls.iterdir())
    texts = spark.createDataFrame([(t,) for t in [*"abcdefgh", "a", None, ""]], "text string")
    memo = Memo(f"file://{tmp_path}/memo")
    with pytest.raises(Exception, match="RuntimeError"):
        memo.ask(texts, model_that("h"), 1)
    before = {r.key for r in memo.read(spark).collect()}
    assert before  # some portions were done
    for f in calls.iterdir():
        f.unlink()
    got = {r.text: r.reply for r in memo.ask(texts, model_that(None), 1).collect()}
    assert got == {t: t.upper() for t in [*"abcdefgh", ""]} and len(asked()) == len(set(asked())) == 9 - len(before)
    assert memo.ask(texts, model_that("a"), 2).count() == 9 and len(asked()) == 9 - len(before)  # a second run never calls it
    memo.ask(spark.createDataFrame([("new",), ("a",)], "text string"), model_that("a"), 1)
    assert asked().count("new") == 1 and memo.read(spark).count() == 10
    assert sorted(map(tuple, memo.merge(spark, f"file://{tmp_path}/one").read(spark).select("key", "reply").collect())) == sorted(map(tuple, memo.read(spark).select("key", "reply").collect()))
