"""Queries on ingest, embedding and event time."""

from pyspark.sql import functions as F

from ..functions import embedding, text
from ..sources import memo
from ..sources.scratch import kept, scratch
from ..sources.store import MEMORIES_SQL, memories, table
from ..streaming import ingest, saving, state, windows
from .context import reply_chunks
from .registry import Registry
from .store import PLAIN

R = Registry()
COLUMNS = ["id", "agent_id", "created_at", "user_text", "assist_text", "user_emb", "assist_emb"]


@R.query("dedup_ingest")
def dedup_ingest(spark, d):
    """Memories of odd conversations against those of even ones: what goes in, and what touches what."""
    m = memories(spark, d).select(COLUMNS)
    odd = F.floor(F.col("id") / 1000) % 2 == 1
    rows, touches = ingest.resolve(m.where(~odd), m.where(odd), 0.4)
    return rows.select(F.lit("insert").alias("kind"), "id", F.lit(None).cast("long").alias("by")).unionByName(touches.select(F.lit("touch").alias("kind"), "id", "by"))


@R.query("stream_ingest")
def stream_ingest(spark, d):
    """All memories as files that arrive in three lots; the stored rows with their counts of touches."""
    source, target, progress = scratch(spark, "save-events"), scratch(spark, "stored"), scratch(spark, "progress")
    for lot in range(3):
        memories(spark, d).select(COLUMNS).where(F.floor(F.col("id") / 1000) % 3 == lot).write.mode("append").parquet(source)
        ingest.start(spark, source, target, progress, 0.4, files=10_000).awaitTermination()
    touched = spark.read.parquet(f"{target}/touches").groupBy("id").agg(F.count("*").cast("int").alias("times"))
    stored = ingest.read_store(spark, target)
    return stored.join(touched, "id", "left").select("id", "agent_id", (F.col("access_count") + F.coalesce("times", F.lit(0))).alias("access_count"))


@R.query("save_path", f"""WITH {MEMORIES_SQL}, s AS (SELECT id, agent_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, id DESC) AS n FROM memories)
SELECT id, agent_id, CAST(1 AS INTEGER) AS access_count FROM s WHERE n <= CASE WHEN agent_id IS NULL THEN 30 ELSE 20 END""")
def save_path(spark, d):
    """All memories as files in three lots, with a threshold that nothing reaches: what is stored after evictions batch by batch."""
    source, progress = scratch(spark, "save-events"), scratch(spark, "progress")
    saver = saving.Saver(scratch(spark, "saved"), threshold=2.0, per_agent=20, per_global=30)
    for lot in range(3):
        memories(spark, d).select(COLUMNS).where(F.floor(F.col("id") / 1000) % 3 == lot).write.mode("append").parquet(source)
        saver.start(spark, source, progress, files=10_000).awaitTermination()
    return saver.live(spark).select("id", "agent_id", "access_count")


WHOLE_SQL = f"""WITH {MEMORIES_SQL}, o AS (SELECT id, agent_id, id // 1000 % 7 AS k, row_number() OVER (ORDER BY id // 1000 % 3, id) AS n FROM memories),
f AS (SELECT *, min(CASE WHEN agent_id IS NULL THEN n END) OVER (PARTITION BY k) AS g, min(n) OVER (PARTITION BY k, agent_id) AS a FROM o),
i AS (SELECT *, CASE WHEN agent_id IS NULL THEN n = g ELSE n = a AND (g IS NULL OR g > n) END AS goes_in FROM f),
t AS (SELECT r.id, min(m.id) AS touched FROM i r JOIN i m ON m.goes_in AND m.k = r.k AND m.n < r.n AND (m.agent_id IS NULL OR m.agent_id = r.agent_id) WHERE NOT r.goes_in GROUP BY r.id),
x AS (SELECT id * 100 AS id, agent_id, concat('plain|k', (100000 + id) % 5) AS key, (100000 + id) // 5 % 3 AS v FROM memories), c AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY agent_id, key ORDER BY id) AS b FROM x) WHERE b IS NULL OR b <> v)
SELECT 'memory' AS kind, i.id, 1 + count(t.id) AS n FROM i LEFT JOIN t ON t.touched = i.id WHERE goes_in GROUP BY i.id UNION ALL SELECT 'sentences', id, 3 FROM i WHERE goes_in
UNION ALL SELECT 'fact', id, coalesce(lead(id) OVER (PARTITION BY agent_id, key ORDER BY id), -1) FROM c"""


@R.query("save_path_whole", WHOLE_SQL)
def save_path_whole(spark, d):
    """Plain texts with seven directions of vectors, in three lots: what goes in with its count of touches, the sentences of it, and the versions of facts of all exchanges."""
    source, progress = scratch(spark, "save-events"), scratch(spark, "progress")
    number = lambda prompt: F.regexp_extract(prompt, r"Reply number (\d+)", 1).cast("long")
    fact = lambda p: F.array(F.struct(F.lit("Plain").alias("subject"), F.concat(F.lit("k"), (number(p) % 5).cast("string")).alias("attribute"), (F.floor(number(p) / 5) % 3).cast("string").alias("value")))
    saver = saving.Saver(scratch(spark, "saved"), per_agent=1 << 30, per_global=1 << 30, embed=lambda part: F.array(F.length(part).cast("float")), extract=fact)
    conv = F.floor(F.col("id") / 1000)
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (i == conv % 7).cast("float"))
    m = kept(memories(spark, d, True).selectExpr("id", "agent_id", "created_at", *PLAIN).withColumns({"user_emb": one_hot, "assist_emb": one_hot}).select(COLUMNS), "plain")
    for lot in range(3):
        m.where(conv % 3 == lot).write.mode("append").parquet(source)
        saver.start(spark, source, progress, files=10_000).awaitTermination()
    sentences = saver.sentences(spark).groupBy(F.col("memory_id").alias("id")).agg(F.count("*").alias("n"))
    parts = (("memory", saver.live(spark).select("id", F.col("access_count").cast("long").alias("n"))), ("sentences", sentences), ("fact", saver.facts(spark).select("id", F.coalesce("superseded_by", F.lit(-1)).alias("n"))))
    rows = [part.select(F.lit(kind).alias("kind"), "id", "n") for kind, part in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _in_lots(spark, rows, lots: int, lot, make, columns: str):
    """What a stream with state writes over files that arrive in lots, each taken up where the last run stopped."""
    source, target, progress = (scratch(spark, f"lots-{x}") for x in ("in", "out", "progress"))
    rows = kept(rows.withColumn("_lot", lot), "lots")
    for n in range(lots):
        rows.where(F.col("_lot") == n).drop("_lot").write.mode("append").parquet(source)
        events = spark.readStream.schema(rows.drop("_lot").schema).parquet(source)
        make(events).writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).outputMode("append").start(target).awaitTermination()
    return spark.read.schema(columns).parquet(target)


@R.query("stream_replies", "SELECT conv_id * 1000 + turn AS stream_id, text, true AS done FROM conversations WHERE role = 'assistant'")
def stream_replies(spark, d):
    """The chunks of all replies in three lots, which cut lines and texts; what was emitted, put together."""
    found = _in_lots(spark, reply_chunks(spark, d), 3, F.least(F.floor(F.col("seq") / 5), F.lit(2)), state.replies, "stream_id long, seq long, text string, done boolean")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return found.groupBy("stream_id").agg(F.array_join(parts, "").alias("text"), F.bool_or("done").alias("done"))


@R.query("stream_sticky", """WITH e AS (SELECT event_id AS n, event_type AS cache, user_id AS k, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS p FROM events),
d AS (SELECT e.n, count(DISTINCT x.k) AS others FROM e LEFT JOIN e x ON x.cache = e.cache AND x.n > e.p AND x.n < e.n GROUP BY e.n)
SELECT n AS request_id, p IS NOT NULL AND others < 20 AS hit FROM e JOIN d USING (n)""")
def stream_sticky(spark, d):
    """Events as requests to a cache per type, of 20 users each, in three lots."""
    e = table(spark, d, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("key"), F.concat(F.lit("block "), F.col("event_id").cast("string")).alias("block"))
    most = e.agg(F.max("request_id")).first()[0] or 0
    found = _in_lots(spark, e, 3, F.least(F.floor(F.col("request_id") * 3 / (most + 1)), F.lit(2)), lambda s: state.recent_blocks(s, 20), "request_id long, hit boolean, block string")
    return found.select("request_id", "hit")


@R.query("stream_expiry", f"WITH {MEMORIES_SQL} SELECT id FROM memories WHERE created_at < (SELECT max(created_at) FROM memories) - 20 * 86400")
def stream_expiry(spark, d):
    """What has expired after 20 days, by timers, when all memories have arrived in three lots by their time."""
    m = memories(spark, d, True).select("id", F.col("created_at").alias("at"))
    span = m.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    lot = F.least(F.floor((F.col("at") - span.a) * 3 / ((span.b or 0) - (span.a or 0) + 1)), F.lit(2))
    return _in_lots(spark, m, 3, lot, lambda s: state.expiries(s, 20), "id long")


@R.query("embed_texts")
def embed_texts(spark, d):
    """Unit vectors of user texts by the stand-in model."""
    embed = embedding.embedder(embedding.hashing_model(16))
    return memories(spark, d, True).select("id", F.transform(embed("user_text"), lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


@R.query("embed_failures", f"WITH {MEMORIES_SQL} SELECT id, contains(user_text, 'qu') AS failed, CASE WHEN contains(user_text, 'qu') THEN 'ValueError: qu' END AS reason FROM memories")
def embed_failures(spark, d):
    """A model that fails for every batch with a certain text in it: only such texts lack a vector."""

    def model(texts):
        if any("qu" in t for t in texts):
            raise ValueError("qu")
        return embedding.hashing_model(16)(texts)

    m = memories(spark, d, True).select("id", embedding.embedder(model, reasons=True)("user_text").alias("e"))
    return m.select("id", F.col("e.vector").isNull().alias("failed"), "e.reason")


@R.query("reply_memo", f"""WITH {MEMORIES_SQL}, t AS (SELECT user_text AS text, min(CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END) AS run FROM memories GROUP BY 1)
SELECT sha256(text) AS key, concat('re: ', substr(text, 1, 20)) AS reply, CAST(run AS INTEGER) AS run FROM t""")
def reply_memo(spark, d):
    """Replies of a stand-in model to all user texts, of which a run before has answered some."""
    texts = kept(memories(spark, d, True).select("id", F.col("user_text").alias("text")), "asked")
    store = memo.Memo(scratch(spark, "memo"))
    reply = lambda c: F.concat(F.lit("re: "), F.substring(c, 1, 20))
    store.ask(texts.where("id % 3 = 0"), reply, 1)
    store.ask(texts, reply, 2)
    return store.read(spark).select("key", "reply", "run")


@R.query("extract_facts", "SELECT conv_id * 1000 + turn AS id, 'user' AS subject, 'topic' AS attribute, substr(user_text, 1, 10) AS value FROM (SELECT conv_id, turn, role, text AS user_text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE role = 'user' AND n = 'assistant'")
def extract_facts(spark, d):
    """Facts of a stand-in model that replies with the first letters of what the user said."""
    import json

    def model(prompts):
        return [f"Here: {json.dumps([{'subject': 'user', 'attribute': 'topic', 'value': p.split('User: ', 1)[1][:10]}])}" for p in prompts]

    m = memories(spark, d, True)
    facts = embedding.fact_extractor(model)(text.fact_prompt(F.col("user_text"), F.col("assist_text")))
    return m.select("id", F.explode(facts).alias("f")).select("id", "f.*")


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("event_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark, d):
    w = windows.tumbling(_events(spark, d), "6 hours", "event_type")
    return w.withColumn("start", F.unix_timestamp("start"))


@R.query("event_sliding", "SELECT CAST(epoch(b) AS BIGINT) - 3600 * k AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, event_type FROM events), (SELECT unnest(range(3)) AS k) GROUP BY ALL")
def event_sliding(spark, d):
    return windows.sliding(_events(spark, d), "3 hours", "1 hour", "event_type").withColumn("start", F.unix_timestamp("start"))


@R.query("event_sessions", """WITH g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events))
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, d):
    return windows.sessions(_events(spark, d), "30 minutes", "user_id").withColumn("start", F.unix_timestamp("start"))
