import json

from pyspark.sql import functions as F

from anamnesis.functions.text import tokens
from anamnesis.sources.store import read_study, write_csv
from anamnesis.streaming import windows


def test_study_reader(spark, tmp_path):
    """Three sessions, one with a turn without a reply; an evidence turn in a session that is named as well."""
    sessions = {
        "kiln": [{"role": "user", "content": "when is the kiln free"}],
        "loom": [{"role": "user", "content": "which loom", "has_answer": True}, {"role": "assistant", "content": "the small one", "has_answer": False}],
        "mill": [{"role": "user", "content": "mill hours"}, {"role": "assistant", "content": "until noon"}, {"role": "user", "content": "thanks"}],
    }
    record = {
        "question_id": "k-17", "question_type": "update", "question": "which loom is it now", "question_date": "2021/02/03 (Wed) 08:15", "answer_session_ids": ["loom", "mill"],
        "haystack_sessions": [*sessions.values()], "haystack_dates": ["2021/01/31 (Sun) 22:05", "2021/02/01 (Mon) 06:00", "soon"], "haystack_session_ids": [*sessions],
    }
    (tmp_path / "study.json").write_text(json.dumps([record, record | {"question_id": "k-18", "haystack_sessions": [], "haystack_dates": [], "haystack_session_ids": []}]))
    rows = read_study(spark, str(tmp_path / "study.json")).orderBy("session_id", "turn").collect()
    want = [(s, i, t["role"], t["content"], bool(t.get("has_answer")), s != "kiln") for s, turns in sessions.items() for i, t in enumerate(turns)]
    assert [(r.session_id, r.turn, r.role, r.content, r.evidence, r.fallback) for r in rows] == want
    assert {r.question_id for r in rows} == {"k-17"} and str(rows[0].asked) == "2021-02-03 08:15:00" and str(rows[0].held) == "2021-01-31 22:05:00" and rows[-1].held is None


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("two, quoted", 0.25, None, 31.5)], "method string, alpha double, coverage double, mean_tokens double")
    write_csv(df, f"file://{tmp_path}/out")
    assert spark.read.csv(f"file://{tmp_path}/out", header=True).first().asDict() == {"method": "two, quoted", "alpha": "0.25", "coverage": None, "mean_tokens": "31.5"}


def test_windows_on_a_stream(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 2).cast("string").alias("kind"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream, "1 hour", "kind").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, windows.tumbling(rows, "1 hour", "kind").collect()))
    assert sorted(map(tuple, spark.table("windows").collect())) == want and sum(r[2] for r in want) == 40


def test_estimates(spark):
    got = spark.createDataFrame([("",), ("abcd",), ("éé",), (None,)], "t string").select(tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [1, 2, 2, None]
