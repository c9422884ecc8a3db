import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.config import ADAPTIVE_EDGES, ADAPTIVE_K, InjectMode, Settings
from anamnesis.functions import embedding, scoring, temporal, text
from anamnesis.operators import context, lexical, messages, ranks, retrieval, store, study
from anamnesis.streaming import ingest


def values(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_settings():
    assert Settings.parse(["--top-k", "7", "--decay-mode", "legacy"]).top_k == 7 and InjectMode.parse("other") is InjectMode.SYSTEM
    for wrong in ({"decay_days": 0}, {"target_coverage": 0.5}, {"adaptive_k": True}, {"history_trim_ratio": float("nan")}, {"rrf_k": 0}, {"memory_line_chars": 0}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_scores(spark):
    """Against the formulas, written out with numbers of our own."""
    def rank(sim, age_hours, same, mode):
        base = scoring.similarity_score(F.lit(sim), F.lit(same), 1.2)
        return scoring.rank_score(base, scoring.recency(F.lit(age_hours), 30), mode)

    cases = [(sim, age, same, mode) for sim in (0.42, 0.77) for age in (0.0, 36.0, 250.0, 5000.0) for same in (False, True) for mode in ("tiebreak", "legacy")]
    got = values(spark, **{f"c{i}": rank(*c) for i, c in enumerate(cases)})
    for x, (sim, age, same, mode) in zip(got, cases):
        base, recent = sim * (1.2 if same else 1.0), max(0.5, min(1.0, 1 - age / 720))
        assert abs(x - (base + 0.001 * recent if mode == "tiebreak" else base * recent)) < 1e-9
    k = values(spark, **{f"k{i}": scoring.adaptive_k(F.lit(s), F.lit(0.9), F.lit("tiebreak")) for i, s in enumerate((-0.2, 0.0, 0.5, 0.66, 0.95))})
    low, high = ADAPTIVE_EDGES["tiebreak"]
    few, some, many = ADAPTIVE_K[0.9, "tiebreak"]
    assert list(k) == [max(8, few if s <= low else some if s <= high else many) if s > 0 else 8 for s in (-0.2, 0.0, 0.5, 0.66, 0.95)]
    line, whole = values(spark, a=text.longest_line_tokens(F.lit(100)), b=text.required_tokens(F.lit(3), F.lit(100)))
    assert whole == text.estimate(text.HEADER) + text.estimate(text.FOOTER) + 3 * line


def test_truncation(spark):
    cut = ["abècd", "x€yz", "ééééé", "🙂🙂", "plain", ""]
    d = spark.createDataFrame([(t,) for t in cut], "t string")
    for most in range(0, 8):
        got = [r[0] for r in d.select(text.truncate_utf8(F.col("t"), most)).collect()]
        assert got == [text.cut_utf8(t, most) for t in cut]


def test_sentences():
    parts = lambda t: [t.encode()[a:b].decode() for a, b in text.sentence_spans(t)]
    assert parts("Le marché ouvre à sept heures du matin. 札幌 has snow for most of the long winter!") == ["Le marché ouvre à sept heures du matin.", "札幌 has snow for most of the long winter!"]
    assert parts("words that go on without any stop") == ["words that go on without any stop"]
    assert [p.startswith("```") for p in parts("These words come before the listing.\n```\nfor i in rows: print(i); go()\n```\nThose words come after the listing.")] == [False, True, False]
    assert [len(p) for p in parts("m" * 360 + " " + "n" * 645)] == [300, 60, 300, 300, 45]
    assert parts("") == [] and parts("\t\n  ") == [] and text.sentence_spans(None) == []
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab .!?\n-`é1 ") for _ in range(rng.randint(0, 700)))
        spans = text.sentence_spans(t)
        raw = t.encode()
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        for a, b in spans:
            raw[a:b].decode()


def test_compression():
    """The nearest sentences that fit, in text order, with a mark where some are left out."""
    t = "Rivers rise in the spring. Roads stay dry in the east. Bridges close when rivers rise."
    b, g = t.index("Roads"), t.index("Bridges")
    s = [(0, 0, b - 1, [0.9, 0.1]), (1, b, g - 1, [-0.2, 0.4]), (2, g, len(t), [0.7, 0.0])]
    assert text.compressed(t, s, [1.0, 0.0], 66) == "Rivers rise in the spring. … Bridges close when rivers rise."
    assert text.compressed(t, s, None, 12) == t[:12] + "..." and text.compressed(t, [], [1.0], 900) == t
    assert text.compressed(t, s, [1.0, 0.0], 6) == t[:6] + "..."


def test_replies_and_keys(spark):
    one = '{"subject":"garden","attribute":"size","value":"small"}'
    replies = {f"Sure:\n```json\n[{one}, {one}]\n```": 2, "[]": 0, '[{"subject":"a","attribute":7,"value":"b"}]': 0, "[" + ",".join([one] * 15) + "]": 10, None: 0, "no ] list [": 0, "[{broken": 0}
    assert [len(text.facts_in_reply(r)) for r in replies] == [*replies.values()]
    long = text.facts_in_reply('[{"subject":"%s","attribute":"a","value":"v"}]' % ("ü" * 900))[0]["subject"]
    assert len(long.encode()) == 400 and long == "ü" * 200
    assert values(spark, k=text.fact_key(F.lit("\tThe  Garden "), F.lit(" Soil\n  Type "))).k == "the garden|soil type"
    blocks = [{"type": "tool_result", "content": [{"type": "text", "text": "inner"}, {"type": "image"}]}, {"type": "text", "text": "outer"}, "bare", None]
    assert text.block_texts(blocks) == ["inner", "outer"]


def test_dates(spark):
    import datetime

    day = lambda y, m, d: (datetime.date(y, m, d) - datetime.date(1970, 1, 1)).days
    now = F.lit(day(2023, 11, 9) * 86400.0 + 4000)
    got = values(spark, d=temporal.mentioned_days(F.lit("Met on July 14, 2022, again 2 Octubre 2021; today too. Not 2022-02-30, but 2020-02-29 and 1 gennaio 2023."), now), n=temporal.utc_day(F.lit(-86401.0)), bad=temporal.parse_date(F.lit("31 June 2023"), F.lit(2023)), open=temporal.parse_date(F.lit("september 9"), F.lit(1999)))
    assert got.d == sorted([day(2022, 7, 14), day(2021, 10, 2), day(2023, 11, 9), day(2020, 2, 29), day(2023, 1, 1)])
    assert got.n == -2 and got.bad is None and got.open == day(1999, 9, 9)


def test_windows_of_far_times(spark):
    """Counts that lead out of the calendar end no query."""
    now = F.lit(1_700_000_000.0)
    today = 19675
    texts = {"what was it 3 weeks ago": today - 21, "999999999 weeks ago": today - 7 * 999999999, "2000000000 days ago": today - 2000000000, "99999999999999999999 days ago": None, "999999999 months ago": None, "300000 months ago": None, "hace 2 semanas": today - 14, "due WEEKS AGO": None}
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(temporal.window(F.col("t"), now).alias("w"))
    assert [r.w and r.w.start_day for r in d.collect()] == [*texts.values()]
    assert values(spark, p=temporal.plain(F.lit("ÀÉ Ñandú LUNEDÌ Ö"))).p == "ÀÉ nandu lunedÌ Ö"


def test_lexical_terms(spark):
    q = {"order A7-99x": ["order", "A7", "99x"], "NOT (near) ^col:*": ["NOT", "near", "col"], "?!": [], "naïve": ["na", "ve"]}
    got = [r[0] for r in spark.createDataFrame([(x,) for x in q], "t string").select(lexical.match_expression(F.col("t"))).collect()]
    assert got == [" OR ".join(f'"{w}"' for w in words) for words in q.values()]


def test_bm25_against_a_full_text_index(spark):
    import sqlite3

    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "café", "naïve", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12))), " ".join(rng.choices(words + ["the"] * 6, k=rng.randint(1, 20)))) for i in range(120)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(u, a, content='')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index in this sqlite")
    con.executemany("INSERT INTO f(rowid, u, a) VALUES (?, ?, ?)", docs)
    asked = [(0, "alpha beta"), (1, "the the zeta"), (2, "gamma-delta the")]
    m = spark.createDataFrame(docs, "id long, user_text string, assist_text string").withColumn("agent_id", F.lit(None).cast("string"))
    got = {(r.query_id, r.id): r.bm25 for r in lexical.bm25(spark.createDataFrame(asked, "query_id long, text string").withColumn("agent_id", F.lit("")), m, 1000).collect()}
    for q, t in asked:
        match = " OR ".join(f'"{w}"' for w in t.replace("-", " ").split())
        for i, s in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall():
            assert abs(got.pop((q, i)) - s) < 1e-6
    assert not got


def test_history(spark):
    """Against the rule on random conversations, with a counter of one token a letter."""
    rng = random.Random(4)
    rows = [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "w" * rng.randint(1, 30)) for c in range(12) for t in range(rng.randint(1, 9))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    size = lambda body: body.count("w")
    for budget in (0, 20, 60, 1000):
        got = {(r.conv_id, r.turn) for r in messages.trim_history(d, budget, 0.5, size).where("kept").collect()}
        for c in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == c]
            cost = {t: 0 if role == "system" else len(x) for _, t, role, x in own}
            users = [t for _, t, role, _ in own if role == "user"]
            cut = next((t for t in users if sum(n for u, n in cost.items() if u >= t) <= budget // 2), users[-1] if users else 0)
            over = 0 < budget < sum(cost.values()) and users
            assert {t for x, t in got if x == c} == {t for _, t, role, _ in own if not over or role == "system" or t >= cut}
    empty = d.limit(0)
    assert messages.trim_history(empty, 80, 0.5).count() == 0 and messages.conversation_context(empty).count() == 0


def test_quantiles(spark):
    """Against sorted lists."""
    scores = [0.31, 0.05, 0.62, 0.62, 0.97, 0.44]
    p = spark.createDataFrame([("g", x, i) for i, x in enumerate(scores)], "g string, best_score double, best_rank int")
    for alpha in (0.0, 0.1, 0.3, 0.6, 0.99):
        place = int(alpha * (len(scores) + 1) + 1e-9)
        assert study.conformal_threshold(p, alpha, ["g"]).first()["value"] == (sorted(scores)[min(place, len(scores)) - 1] if place else float("-inf"))
    best = [3, 1, 1, 7, 20]
    r = spark.createDataFrame([("g", x) for x in best], "g string, best_rank int")
    for alpha in (0.1, 0.25, 0.5, 0.9):
        place = min(max(1, int(np.ceil((1 - alpha) * (len(best) + 1) - 1e-9))), len(best))
        assert study.rank_quantile(r, alpha, ["g"]).first()["value"] == sorted(best)[place - 1]
    assert study.upper_quantile(r, "best_rank", 0.01, ["g"]).first()["value"] == float("inf")
    curves = [[0.75, 0.75, 0.25, 0.0], [1.0, 0.5, 0.5, 0.0], [0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0]]
    found = [(q, k + 1, 4) for q, line in enumerate(curves) for k, x in enumerate(line) for _ in range(round(4 * ((line[k - 1] if k else 1.0) - x)))]
    rows, known = spark.createDataFrame(found, "question_id int, rk int, evidence_count int"), spark.createDataFrame([(q, 4) for q in range(4)], "question_id int, size int")
    for alpha in (0.8, 0.7, 0.4, 0.2, 0.05):
        want = next((k + 1 for k in range(4) if (sum(c[k] for c in curves) + 1) / (len(curves) + 1) <= alpha), 4)
        assert ranks.crc_k(rows, known, alpha).first().k == want


def test_supersession(spark):
    f = [(11, "a", "Garden", "soil", "Clay"), (12, "a", "garden ", "Soil", "CLAY"), (13, "a", "garden", "soil", "sand"), (14, None, "garden", "soil", "sand"), (15, "a", "Garden", "soil", "clay"), (16, "b", "Garden", "size", "small")]
    got = {r.id: r.superseded_by for r in store.supersede(spark.createDataFrame(f, "id long, agent_id string, subject string, attribute string, value string")).collect()}
    assert got == {11: 13, 13: 15, 14: None, 15: None, 16: None}


SCHEMA = "id long, agent_id string, created_at double, user_text string, assist_text string, user_emb array<float>, assist_emb array<float>"


def test_search(spark):
    now = 1_688_888_888.0
    v = lambda *x: [float(i) for i in x]
    rows = [(1, None, now, "g", "", v(1, 0, 0), v(0, 0, 1)), (2, "coder", now, "c", "", v(0.8, 0.6, 0), v(0, 1, 0)), (3, "other", now, "o", "", v(1, 0, 0), v(1, 0, 0)), (4, None, now, "dim", "", v(1, 0), v(1, 0)), (5, None, None, "null", "", None, None), (6, None, now, "tie", "", v(1, 0, 0), v(0, 0, 1))]
    m = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(1, "coder", v(2, 0, 0)), (2, "", v(0, 0, 5)), (3, "coder", v(0, 0, 0))], "query_id long, agent_id string, query_emb array<float>")
    got = [(r.query_id, r.rk, r.id, round(r.similarity, 6)) for r in retrieval.search(q, m).orderBy("query_id", "rk").collect()]
    assert got == [(1, 1, 1, 1.0), (1, 2, 6, 1.0), (1, 3, 2, 0.8), (2, 1, 1, 1.0), (2, 2, 6, 1.0)]
    assert retrieval.search(q.limit(0), m).count() == 0 and retrieval.search(q, m.limit(0)).count() == 0
    dup = retrieval.find_duplicates(q.where("query_id = 1"), m, 0.92).first()
    assert (dup.id, dup.similarity) == (1, 1.0)
    retrieval.BROADCAST_QUERIES, before = 1, retrieval.BROADCAST_QUERIES
    try:
        assert [(r.query_id, r.rk, r.id, round(r.similarity, 6)) for r in retrieval.search(q, m).orderBy("query_id", "rk").collect()] == got
    finally:
        retrieval.BROADCAST_QUERIES = before


def test_ingest_is_sequential(spark):
    rng = np.random.default_rng(3)
    unit = lambda x: [float(i) for i in x / np.linalg.norm(x)]
    centres = rng.standard_normal((12, 4))
    rows = [(i, [None, "a", "b"][int(rng.integers(3))], float(i), "t", "t", unit(centres[int(rng.integers(12))] + 0.35 * rng.standard_normal(4)), unit(rng.standard_normal(4))) for i in range(90)]
    stored, touched = {}, []
    for n, (i, agent, *_, u, _a) in enumerate(rows):
        seen = {j: float(np.dot(np.float32(u), np.float32(x))) for j, (g, x) in stored.items() if g is None or g == agent}
        best = min(((-round(s, 9), j) for j, s in seen.items() if s >= 0.9), default=None)
        if best:
            touched.append((best[1], i))
        else:
            stored[i] = agent, u
    d = spark.createDataFrame(rows, SCHEMA)
    a, ta = ingest.resolve(d.limit(0), d.where("id < 40"), 0.9)
    b, tb = ingest.resolve(a, d.where("id >= 40"), 0.9)
    assert sorted(r.id for r in a.union(b).collect()) == sorted(stored)
    assert sorted((r.id, r.by) for r in ta.select("id", "by").union(tb.select("id", "by")).collect()) == sorted(touched)


def test_budget_and_embedding(spark):
    lines = spark.createDataFrame([(1, 1, 10, "x" * 40), (1, 2, 11, "y" * 400), (1, 3, 12, "z")], "query_id long, rk int, id long, line string")
    assert [r.id for r in context.within(lines, 20).collect()] == [10]
    assert [r.id for r in context.within(lines, 20, counter=lambda t: 5).orderBy("rk").collect()] == [10, 11, 12]
    assert [len(b) for b in embedding.batches_of(["x"] * 20)] == [8, 8, 4] and [len(b) for b in embedding.batches_of(["y" * 7000, "y" * 7000, "z" * 90000])] == [1, 1, 1]
    embedding.register(spark)
    assert spark.sql("SELECT size(split_sentences('One sentence that is long. Another sentence that is long.')) AS n").first().n == 2
