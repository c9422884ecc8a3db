"""Nested blocks by VARIANT against the plain recursion."""

import json
import random

from anamnesis.functions import text
from anamnesis.operators import messages


def nested(rng, depth):
    kind = rng.randrange(8)
    if kind < 3:
        return {"type": "text", "text": rng.choice(["a ", "é\n", "", 7, None, '"q"'])}
    if kind < 6 and depth:
        return {"type": "tool_result", "content": rng.choice([[nested(rng, depth - 1) for _ in range(rng.randrange(4))], "plain", None, 5, {"type": "text", "text": "no"}])}
    return rng.choice([{"type": "image"}, "bare", None, {"text": "untyped"}, [{"type": "text", "text": "list"}], 3])


def test_random_nesting(spark):
    rng = random.Random(5)
    rows = []
    for i in range(150):
        made = [{"role": rng.choice(["user", "assistant"]), "content": rng.choice(["text", [nested(rng, 4) for _ in range(rng.randrange(13))]])} for _ in range(rng.randrange(4))]
        rows.append((i, json.dumps({"messages": made})))
    rows += [(900, "{broken"), (901, None), (902, "[]"), (903, '{"messages": 5}'), (904, '{"messages": [3, {"role": "user"}, {"role": "user", "content": []}]}')]
    got = {r.request_id: r.text for r in messages.last_user_texts(spark.createDataFrame(rows, "request_id long, body string")).collect()}

    def plain(body):
        try:
            listed = json.loads(body or "{}").get("messages")
        except (ValueError, AttributeError):
            return ""
        users = [m for m in listed if isinstance(m, dict) and m.get("role") == "user" and "content" in m] if isinstance(listed, list) else []
        return "".join(text.block_texts(users[-1]["content"])) if users else ""

    assert got == {i: plain(b) for i, b in rows} and sum(map(bool, got.values())) > 60


def test_no_python(spark):
    d = spark.createDataFrame([(1, json.dumps({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}]}]}))], "request_id long, body string")
    plan = messages.last_user_texts(d)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
