"""Queries on the store: listing, statistics, maintenance, facts, days and temporal expressions."""

from pyspark.sql import functions as F

from ..config import NOW
from ..functions import temporal, text
from ..operators import store
from ..sources.store import DATED_SQL, FACTS_SQL, MEMORIES_SQL, dated, fact_inputs, memories, table
from .registry import Registry
from .retrieval import FACT_SQL, stored_facts

R = Registry()
M = f"WITH {MEMORIES_SQL}"


def _m(spark, d):
    return memories(spark, d, text_only=True).withColumn("updated_at", F.col("created_at"))


@R.query("memory_list_page", f"{M} SELECT id, agent_id, created_at, user_text FROM memories WHERE agent_id = 'agent1' ORDER BY id DESC LIMIT 20 OFFSET 5")
def memory_list_page(spark, d):
    return store.page(_m(spark, d), "agent1", 20, 5).select("id", "agent_id", "created_at", "user_text")


@R.query("agent_stats", f"{M} SELECT coalesce(agent_id, '(global)') AS agent, count(*) AS memories FROM memories GROUP BY 1 UNION ALL SELECT '(all)', count(*) FROM memories")
def agent_stats(spark, d):
    return store.agent_stats(_m(spark, d))


EVICT = "stays AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at + 86400 * access_count DESC, id DESC) AS n FROM memories) WHERE n <= CASE WHEN agent_id IS NULL THEN 30 ELSE 20 END)"


@R.query("evict_lru", f"{M}, {EVICT} SELECT id, agent_id FROM stays")
def evict_lru(spark, d):
    return store.evict(_m(spark, d), 20, 30).select("id", "agent_id")


@R.query("purge_ttl", f"{M} SELECT id, created_at FROM memories WHERE created_at >= {NOW} - 30 * 86400")
def purge_ttl(spark, d):
    m = _m(spark, d)
    return store.without(m, store.expired(m, 30, NOW), "id", "id").select("id", "created_at")


def _touches(spark, d):
    """Events as touches of memories."""
    return table(spark, d, "events").select((F.col("user_id") % 100 * 1000).alias("id"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))").cast("double").alias("at"))


@R.query("touch_merge", f"""{M}, t AS (SELECT user_id % 100 * 1000 AS id, count(*) AS times, max(floor(epoch_us(ts) / 1000000)) AS touched FROM events GROUP BY 1)
SELECT id, CAST(access_count + coalesce(times, 0) AS INTEGER) AS access_count, coalesce(touched, created_at) AS updated_at FROM memories LEFT JOIN t USING (id)""")
def touch_merge(spark, d):
    return store.touch(_m(spark, d), _touches(spark, d)).select("id", "access_count", "updated_at")


@R.query("cascade_delete", f"{M}, {FACTS_SQL}, gone AS (SELECT id FROM memories WHERE id % 3 = 0) SELECT 'fact' AS kind, id FROM fact_inputs WHERE source_memory_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'memory', id FROM memories WHERE id NOT IN (SELECT id FROM gone)")
def cascade_delete(spark, d):
    m = _m(spark, d)
    gone = m.where("id % 3 = 0").select("id")
    facts = store.without(fact_inputs(spark, d), gone, "source_memory_id", "id").select(F.lit("fact").alias("kind"), "id")
    return facts.union(store.without(m, gone, "id", "id").select(F.lit("memory").alias("kind"), "id"))


@R.query("missing_sentences", f"{M} SELECT id FROM memories WHERE id % 2 = 1 OR id % 6 = 0")
def missing_sentences(spark, d):
    """Odd memories have no sentences, multiples of six only those of the user's side."""
    m = _m(spark, d)
    s = store.sentences(m.where("id % 2 = 0")).where("side = 'u' OR memory_id % 6 <> 0")
    return store.missing_sentences(m, s)


@R.query("missing_dates", f"{M}, {DATED_SQL} SELECT id FROM dated WHERE id % 5 = 3")
def missing_dates(spark, d):
    m = dated(_m(spark, d))
    return store.without(m, store.memory_days(m), "id", "memory_id").select("id")


@R.query("fact_supersession", f"{FACT_SQL} SELECT id, agent_id, key, value, superseded_by, subject || ' ' || attribute || ': ' || value AS embedded FROM facts")
def fact_supersession(spark, d):
    f = store.supersede(fact_inputs(spark, d))
    return f.select("id", "agent_id", "key", "value", "superseded_by", store.fact_text(F.col("subject"), F.col("attribute"), F.col("value")).alias("embedded"))


@R.query("fact_list_active", f"{FACT_SQL} SELECT id, subject, value FROM facts WHERE superseded_by IS NULL AND agent_id = 'agent1' ORDER BY id DESC LIMIT 50")
def fact_list_active(spark, d):
    return store.page(store.supersede(fact_inputs(spark, d)).where("superseded_by IS NULL"), "agent1").select("id", "subject", "value")


@R.query("fact_key_normalize", f"WITH {FACTS_SQL} SELECT DISTINCT subject, lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) || '|order status' AS key FROM fact_inputs")
def fact_key_normalize(spark, d):
    return fact_inputs(spark, d).select("subject", text.fact_key(F.col("subject"), F.concat(F.lit("  Order \t"), F.lit("STATUS "))).alias("key")).distinct()


#: Texts whose sentences are plain: two sentences of fixed length.
PLAIN = ["'The first sentence is long enough.' AS user_text", "concat('Reply number ', 100000 + id, ' is long enough too. Its second sentence ends it.') AS assist_text"]


@R.query("sentence_counts", f"""{M}, p AS (SELECT id, {', '.join(PLAIN)} FROM memories), s AS (SELECT id, 'u' AS side, [[0, strlen(user_text)]] AS spans FROM p
UNION ALL SELECT id, 'a', [[0, strpos(assist_text, ' Its') - 1], [strpos(assist_text, ' Its'), strlen(assist_text)]] FROM p)
SELECT id AS memory_id, side, CAST(len(spans) AS BIGINT) AS n, array_to_string(list_transform(spans, lambda x: concat(x[1], '-', x[2])), ',') AS spans FROM s""")
def sentence_counts(spark, d):
    """How many sentences each side has, and the byte spans in order."""
    m = _m(spark, d).selectExpr("id", *PLAIN)
    spans = F.transform(F.array_sort(F.collect_list(F.struct("idx", "start_byte", "end_byte"))), lambda x: F.concat_ws("-", x["start_byte"], x["end_byte"]))
    return store.sentences(m).groupBy("memory_id", "side").agg(F.count("*").alias("n"), F.array_join(spans, ",").alias("spans"))


#: The sentences of plain texts, in SQL: (id, side, idx, start_byte, end_byte).
SPANS_SQL = f"""p AS (SELECT id, {', '.join(PLAIN)} FROM memories), spans AS (SELECT id AS memory_id, 'u' AS side, 0 AS idx, 0 AS start_byte, strlen(user_text) AS end_byte FROM p
UNION ALL SELECT id, 'a', 0, 0, strpos(assist_text, ' Its') - 1 FROM p UNION ALL SELECT id, 'a', 1, strpos(assist_text, ' Its'), strlen(assist_text) FROM p)"""
SPAN = "memory_id, side, CAST(idx AS INTEGER) AS idx, CAST(start_byte AS INTEGER) AS start_byte"


@R.query("sentence_rows", f"{M}, {SPANS_SQL} SELECT {SPAN}, CAST(end_byte AS INTEGER) AS end_byte FROM spans")
def sentence_rows(spark, d):
    """Sentences of plain texts by the table function, in SQL."""
    from ..functions import embedding

    embedding.register(spark)
    plain = _m(spark, d).selectExpr("id", *PLAIN)
    return spark.sql("SELECT id AS memory_id, side, s.* FROM (SELECT id, stack(2, 'u', user_text, 'a', assist_text) AS (side, text) FROM {plain}) t, LATERAL sentence_rows(t.text) s", plain=plain)


@R.query("sentence_upsert_plain", f"{M}, {SPANS_SQL} SELECT {SPAN}, CAST(end_byte - (memory_id % 2 = 0)::INT AS INTEGER) AS end_byte FROM spans UNION ALL SELECT id, 'a', CAST(2 AS INTEGER), CAST(0 AS INTEGER), CAST(1 AS INTEGER) FROM p WHERE id % 2 = 0")
def sentence_upsert_plain(spark, d):
    """Spans of plain texts, of which those of even memories are replaced, and one is added to each of those."""
    s = store.sentences(_m(spark, d).selectExpr("id", *PLAIN))
    new = s.where("memory_id % 2 = 0").withColumn("end_byte", F.col("end_byte") - 1)
    more = new.where("idx = 1").select("memory_id", "side", F.lit(2).alias("idx"), F.lit(0).alias("start_byte"), F.lit(1).alias("end_byte"))
    return store.upsert(s, new.unionByName(more), ["memory_id", "side", "idx"])


@R.query("sentence_backfill", f"{M} SELECT id, true AS u, true AS a FROM memories")
def sentence_backfill(spark, d):
    """Memories that lack sentences get them; in the end none lacks any."""
    m = _m(spark, d)
    s = store.fill_sentences(m, store.sentences(m.where("id % 2 = 0")).where("side = 'u' OR memory_id % 6 <> 0"))
    return s.groupBy(F.col("memory_id").alias("id")).agg(F.bool_or(F.col("side") == "u").alias("u"), F.bool_or(F.col("side") == "a").alias("a"))


@R.query("positional_ages", f"{M}, p AS (SELECT id, agent_id, created_at, row_number() OVER (PARTITION BY agent_id ORDER BY id) AS place FROM memories) SELECT id, CASE WHEN agent_id IN ('agent1', 'agent2') THEN {NOW} - (place * 3 + 1) * 3600.0 ELSE created_at END AS created_at FROM p")
def positional_ages(spark, d):
    """Two agents' memories get ages by their place."""
    m = _m(spark, d)
    counts = m.where("agent_id IN ('agent1', 'agent2')").groupBy("agent_id").count()
    ages = counts.select("agent_id", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("place")).withColumn("age_hours", F.col("place") * 3.0 + 1.0)
    return store.positional_ages(m, ages, NOW).select("id", "created_at")


@R.query("sentence_upsert")
def sentence_upsert(spark, d):
    """Stored spans, of which those of even memories are replaced by spans that end a byte earlier."""
    s = store.sentences(_m(spark, d))
    new = s.where("memory_id % 2 = 0").withColumn("end_byte", F.col("end_byte") - 1)
    return store.upsert(s, new, ["memory_id", "side", "idx"])


@R.query("embedding_cache_misses", f"{M} SELECT DISTINCT sha256(user_text) AS key, user_text AS text FROM memories WHERE sha256(user_text) NOT IN (SELECT sha256(user_text) FROM memories WHERE id % 3 = 0)")
def embedding_cache_misses(spark, d):
    m = _m(spark, d)
    cache = m.where("id % 3 = 0").select(F.sha2("user_text", 256).alias("key"))
    return store.cache_misses(m.select(F.col("user_text").alias("text")), cache)


@R.query("injection_log_ring", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 10")
def injection_log_ring(spark, d):
    return store.newest(table(spark, d, "events").where("event_type = 'view'"), 10, "ts", "event_id").select("event_id", "user_id")


@R.query("admin_filter_sort", f"{M} SELECT id, access_count FROM memories WHERE contains(lower(user_text || ' ' || assist_text || ' ' || coalesce(agent_id, '')), 'agent2') ORDER BY access_count DESC, id")
def admin_filter_sort(spark, d):
    return store.containing(_m(spark, d), "Agent2").select("id", "access_count").orderBy(F.desc("access_count"), "id")


@R.query("mentioned_days", f"""{M}, {DATED_SQL}, e AS (SELECT id, CAST(floor(created_at / 86400) AS BIGINT) AS made FROM dated)
SELECT id AS memory_id, CASE id % 5 WHEN 0 THEN 19739 WHEN 1 THEN made - 1 WHEN 2 THEN 19764 ELSE 19762 END AS day FROM e WHERE id % 5 <> 3""")
def mentioned_days(spark, d):
    return store.memory_days(dated(_m(spark, d)))


#: Questions about orders: a template for Spark's format_string over (n, year, month, month name, day, weekday), with the first and last day but one that it means, in SQL.
#: d is the day of the order as a number; n and other (a date, t as a number) come from the order's row, as does the weekday. A null window is none.
_day = lambda date: f"({date} - DATE '1970-01-01')"
QUESTIONS = [
    ("was it paid today?", "d", "d + 1"), ("chi l'ha pagato ieri", "d - 1", "d"), ("llega mañana", "d + 1", "d + 2"),
    ("sold %1$d days ago", "d - n", "d - n + 1"), ("venduto %1$d settimane fa", "d - 7 * n", "d - 7 * n + 1"), ("vendido hace %1$d meses", _day("back"), _day("back") + " + 1"),
    ("what came on %6$s last", "d - prior", "d - prior + 1"), ("shipped last week", "monday - 7", "monday"), ("llega esta semana", "monday", "monday + 7"),
    ("chiuso il mese scorso", _day("m0"), _day("m1")), ("open this month", _day("m1"), _day("m2")), ("returned last year", _day("y0"), _day("y1")), ("due this year", _day("y1"), _day("y2")),
    ("sent in %4$s %2$d", _day("o1"), _day("o2")), ("delivered on %4$s %5$d, %2$d", "t", "t + 1"), ("since %2$d-%3$02d-%5$02d", "t", str(temporal.OPEN_END)), ("anything before %5$d %4$s %2$d", str(temporal.OPEN_START), "t"),
    ("%2$d-%3$02d-%5$02d, was that it?", "t", "t + 1"), ("by cheque or in cash", "NULL", "NULL"),
]
ENGLISH, WEEK = list(temporal.MONTHS)[:12], list(temporal.WEEKDAYS)[:7]


def _windows_sql() -> str:
    side = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {q[i]}" for k, q in enumerate(QUESTIONS)) + " END"
    return f"""WITH b AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt, o_orderkey % {len(QUESTIONS)} AS k, o_custkey % 30 + 1 AS n, CAST(o_orderdate AS DATE) - CAST(o_custkey % 700 AS INTEGER) AS other FROM orders),
x AS (SELECT *, dt - DATE '1970-01-01' AS d, other - DATE '1970-01-01' AS t, CAST(dt - INTERVAL 1 MONTH * n AS DATE) AS back, dt - DATE '1970-01-01' - (isodow(dt) - 1) AS monday, CASE (isodow(dt) - 1 - n % 7 + 7) % 7 WHEN 0 THEN 7 ELSE (isodow(dt) - 1 - n % 7 + 7) % 7 END AS prior,
  CAST(date_trunc('month', dt) - INTERVAL 1 MONTH AS DATE) AS m0, CAST(date_trunc('month', dt) AS DATE) AS m1, CAST(date_trunc('month', dt) + INTERVAL 1 MONTH AS DATE) AS m2, CAST(date_trunc('year', dt) - INTERVAL 1 YEAR AS DATE) AS y0, CAST(date_trunc('year', dt) AS DATE) AS y1, CAST(date_trunc('year', dt) + INTERVAL 1 YEAR AS DATE) AS y2,
  CAST(date_trunc('month', other) AS DATE) AS o1, CAST(date_trunc('month', other) + INTERVAL 1 MONTH AS DATE) AS o2 FROM b)
SELECT o_orderkey, CAST({side(1)} AS BIGINT) AS start_day, CAST({side(2)} AS BIGINT) AS end_day FROM x"""


@R.query("temporal_window_parse", _windows_sql())
def temporal_window_parse(spark, d):
    """A question about each order, asked during the day of the order, put together from its row; and the days that it means."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    other, n = F.date_sub(day, (customer % 700).cast("int")), customer % 30 + 1
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int"))
    cells = [n, F.year(other), F.month(other), name(ENGLISH, F.month(other)), F.dayofmonth(other), name(WEEK, n % 7 + 1)]
    text = F.lit(None).cast("string")
    for k, (template, *_) in enumerate(QUESTIONS):
        text = F.when(key % len(QUESTIONS) == k, F.format_string(template, *cells)).otherwise(text)
    asked = F.unix_date(day) * 86400.0 + (key * 7919) % 86400
    orders = table(spark, d, "orders").select("o_orderkey", text.alias("query"), asked.alias("now"))
    return orders.withColumn("w", temporal.window(F.col("query"), F.col("now"))).select("o_orderkey", "w.start_day", "w.end_day")


@R.query("utc_day_date", f"{M} SELECT id, CAST(floor(created_at / 86400) AS BIGINT) AS day, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date FROM memories")
def utc_day_date(spark, d):
    return _m(spark, d).select("id", temporal.utc_day(F.col("created_at")).alias("day"), temporal.utc_date(F.col("created_at")).alias("date"))


@R.query("time_ago", f"""{M}, s AS (SELECT id, CASE id % 4 WHEN 0 THEN -5 WHEN 1 THEN id % 3600 WHEN 2 THEN id % 86400 ELSE {NOW} - created_at END AS s FROM memories)
SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(CAST(floor(s / 60) AS BIGINT), 'm ago') WHEN s < 86400 THEN concat(CAST(floor(s / 3600) AS BIGINT), 'h ago') ELSE concat(CAST(floor(s / 86400) AS BIGINT), 'd ago') END AS ago FROM s""")
def time_ago(spark, d):
    i = F.col("id")
    s = F.when(i % 4 == 0, F.lit(-5)).when(i % 4 == 1, i % 3600).when(i % 4 == 2, i % 86400).otherwise(F.lit(NOW) - F.col("created_at"))
    return _m(spark, d).select("id", temporal.time_ago(s.cast("double")).alias("ago"))
