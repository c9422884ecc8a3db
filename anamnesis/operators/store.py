"""Maintenance of the store as set operations: every function returns the new state of a table or the affected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import both_mentioned_days
from ..functions.text import fact_key, normalised_component, split_sentences
from .ordering import running_sums


def of_agent(agent: str) -> Column:
    """All rows for '', else the agent's."""
    return F.lit(True) if agent == "" else F.col("agent_id") == agent


def page(rows: DataFrame, agent: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first."""
    return rows.where(of_agent(agent)).orderBy(F.desc("id")).offset(offset).limit(limit)


def agent_stats(memories: DataFrame) -> DataFrame:
    """(agent, memories): per agent, with '(all)' for the total."""
    named = memories.select(F.coalesce("agent_id", F.lit("(global)")).alias("agent"))
    return named.rollup("agent").agg(F.count("*").alias("memories")).select(F.coalesce("agent", F.lit("(all)")).alias("agent"), "memories")


def with_days(memories: DataFrame) -> DataFrame:
    """Memories with the days that their texts mention."""
    return memories.withColumn("mentioned_days", both_mentioned_days(F.col("user_text"), F.col("assist_text"), F.col("created_at")))


def memory_days(memories: DataFrame) -> DataFrame:
    """(memory_id, day): the index of days."""
    return with_days(memories).select(F.col("id").alias("memory_id"), F.explode("mentioned_days").alias("day"))


def without(rows: DataFrame, others: DataFrame, on: str, key: str) -> DataFrame:
    """Rows whose ``on`` isn't among the others' ``key``: missing children, or what a deletion leaves."""
    return rows.join(others.select(F.col(key).alias(on)).distinct(), on, "left_anti")


def missing_sentences(memories: DataFrame, sentences: DataFrame, limit: int | None = None) -> DataFrame:
    """Memories without sentences on one side or both, by id."""
    sides = sentences.groupBy(F.col("memory_id").alias("id")).agg(F.bool_or(F.col("side") == "u").alias("u"), F.bool_or(F.col("side") == "a").alias("a"))
    found = memories.join(sides.where("u AND a"), "id", "left_anti").select("id")
    return found if limit is None else found.orderBy("id").limit(limit)


def sentences(memories: DataFrame, embed=None) -> DataFrame:
    """(memory_id, side, idx, start_byte, end_byte[, embedding]) of both sides; ``embed`` is a column function text -> vector."""
    side = lambda name, column: F.struct(F.lit(name).alias("side"), F.coalesce(column, F.lit("")).alias("text"))
    both = memories.select(F.col("id").alias("memory_id"), F.explode(F.array(side("u", "user_text"), side("a", "assist_text"))).alias("x"))
    cut = both.select("memory_id", "x.side", "x.text", F.explode(split_sentences("x.text")).alias("s"))
    columns = ["memory_id", "side", "s.idx", "s.start_byte", "s.end_byte"]
    if embed is None:
        return cut.select(columns)
    # spans are of bytes and begin and end at characters
    part = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("s.start_byte") + 1, F.col("s.end_byte") - F.col("s.start_byte")), "UTF-8")
    return cut.select(*columns, embed(part).alias("embedding"))


def fill_sentences(memories: DataFrame, stored: DataFrame, embed=None) -> DataFrame:
    """The stored sentences and those of memories that lack them on a side; stored ones of such a memory are replaced."""
    missing = missing_sentences(memories, stored)
    new = sentences(memories.join(missing, "id", "left_semi"), embed)
    kept = stored.join(missing.select(F.col("id").alias("memory_id")), "memory_id", "left_anti")
    return kept.unionByName(new)


def fill_days(memories: DataFrame, days: DataFrame) -> DataFrame:
    """(memory_id, day): the index of days with those of memories that it lacks."""
    missing = without(memories.select("id", "user_text", "assist_text", "created_at"), days, "id", "memory_id")
    return days.select("memory_id", "day").unionByName(memory_days(missing))


def positional_ages(memories: DataFrame, ages: DataFrame, now: float) -> DataFrame:
    """Memories whose times are ``now`` less the age in hours of the same place: (agent_id, place, age_hours) from place 1 in the order of ids.

    An agent whose numbers of memories and ages differ is an error; memories without any ages stay as they are.
    """
    placed = running_sums(memories, ["agent_id"], [F.col("id")], {"place": F.lit(1)})
    both = placed.join(ages.withColumn("_told", F.lit(True)), ["agent_id", "place"], "full_outer")
    counts = ages.groupBy("agent_id").agg(F.count("*").alias("ages"))
    both = both.join(counts, "agent_id", "left")
    fails = (F.col("id").isNull() | (F.col("ages").isNotNull() & F.col("_told").isNull()))
    at = F.when(fails, F.raise_error(F.concat(F.lit("memories and ages don't match for "), F.coalesce("agent_id", F.lit("null")))).cast("double")).when(F.col("_told"), F.lit(now) - F.col("age_hours") * 3600.0)
    times = {c: F.coalesce(at, F.col(c)).alias(c) for c in ("created_at", "updated_at")}
    return both.select([times.get(c, F.col(c)) for c in memories.columns])


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The union with the new row winning for equal keys; among several new ones with a key, a hash of the whole row decides."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("_new"), F.xxhash64(*rows.columns))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def touch(memories: DataFrame, touches: DataFrame) -> DataFrame:
    """Access counts and times after (id, at) touches, which are summed before they meet the memories."""
    t = touches.groupBy("id").agg(F.count("*").cast("int").alias("times"), F.max("at").alias("at"))
    return memories.join(t, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("times", F.lit(0))).withColumn("updated_at", F.coalesce("at", "updated_at")).drop("times", "at")


def evict(memories: DataFrame, per_agent: int, per_global: int) -> DataFrame:
    """What stays: the rows of each agent with the greatest last use plus a day per access."""
    weight = F.col("updated_at") + 86400 * F.col("access_count")
    w = Window.partitionBy("agent_id").orderBy(weight.desc(), F.desc("id"))
    # two plain limits, which Spark applies before it shuffles
    own, shared = (memories.where(who).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n") for who, most in ((F.col("agent_id").isNotNull(), per_agent), (F.col("agent_id").isNull(), per_global)))
    return own.unionByName(shared)


def expired(memories: DataFrame, ttl_days: float, now: float) -> DataFrame:
    return memories.where(F.col("created_at") < now - ttl_days * 86400)


def supersede(facts: DataFrame) -> DataFrame:
    """Versions of facts: an equal value in a row is no new version, a different one supersedes the last.

    ``facts`` has id, agent_id, subject, attribute, value and more; adds key and superseded_by.
    """
    keyed = facts.withColumn("key", fact_key(F.col("subject"), F.col("attribute"))).withColumn("_v", normalised_component(F.col("value")))
    w = Window.partitionBy("agent_id", "key").orderBy("id")
    changed = keyed.withColumn("_b", F.lag("_v").over(w)).where(F.col("_b").isNull() | (F.col("_b") != F.col("_v")))
    return changed.withColumn("superseded_by", F.lead("id").over(w)).drop("_v", "_b")


def fact_text(subject: Column, attribute: Column, value: Column) -> Column:
    """What is embedded of a fact."""
    return F.concat(subject, F.lit(" "), attribute, F.lit(": "), value)


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text): distinct texts whose hash isn't cached."""
    return texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def newest(rows: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """The ``n`` newest rows, newest first."""
    return rows.orderBy(F.desc(by), F.desc(tie)).limit(n)


def containing(memories: DataFrame, text: str) -> DataFrame:
    """Rows whose texts or agent contain a text, whatever the case."""
    whole = F.concat_ws(" ", "user_text", "assist_text", F.coalesce("agent_id", F.lit("")))
    return memories.where(F.lower(whole).contains(text.lower()))
