"""Chat messages (conv_id, turn, role, text): extraction, history trimming, injection, streamed replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_tokens
from ..sources.scratch import kept
from .ordering import running_sums


def message_tokens(role: Column, content: Column, counter=None) -> Column:
    """The tokens of a message as JSON with sorted keys."""
    return count_tokens(counter)(F.to_json(F.struct(content.alias("content"), role.alias("role"))))


def last_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, text) of each conversation's last user turn."""
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def conversation_context(messages: DataFrame, turns: int = 3) -> DataFrame:
    """(conv_id, context): the last ``turns`` pairs of user and assistant messages, 'role: text' joined by ' | '."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.where(F.col("role").isin("user", "assistant")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * turns)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("part"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), " | ").alias("context"))


def history_tokens(messages: DataFrame, counter=None) -> DataFrame:
    """(conv_id, tokens) of all but system messages."""
    return messages.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "system", message_tokens(F.col("role"), F.col("text"), counter)).otherwise(0)).alias("tokens"))


def trim_history(messages: DataFrame, budget: int, ratio: float, counter=None) -> DataFrame:
    """(conv_id, turn, role, text, kept): what goes when a history is over its budget.

    The cut is the first user turn from which on at most ``ratio`` of the budget is used, or the last user turn. System
    messages stay, as does a history without user turns.
    """
    cost = F.when(F.col("role") != "system", message_tokens(F.col("role"), F.col("text"), counter)).otherwise(0)
    whole = Window.partitionBy("conv_id")
    onward = whole.orderBy("turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    m = messages.withColumn("cost", cost).withColumn("total", F.sum("cost").over(whole)).withColumn("suffix", F.sum("cost").over(onward))
    user = F.col("role") == "user"
    fits = F.min(F.when(user & (F.col("suffix") <= F.floor(F.lit(budget) * ratio)), F.col("turn"))).over(whole)
    cut = F.coalesce(fits, F.max(F.when(user, F.col("turn"))).over(whole))
    over = (F.lit(budget) > 0) & (F.col("total") > budget)
    kept = ~over | F.col("cut").isNull() | (F.col("role") == "system") | (F.col("turn") >= F.col("cut"))
    return m.withColumn("cut", cut).select("conv_id", "turn", "role", "text", kept.alias("kept"))


def inject(messages: DataFrame, contexts: DataFrame, mode: str) -> DataFrame:
    """(conv_id, turn, role, text): messages with (conv_id, context) put in.

    ``system`` adds it to a first system message, or makes one in front; ``suffix`` puts it before the last user message's text and
    does as ``system`` where there is none. Empty contexts change nothing.
    """
    w = Window.partitionBy("conv_id")
    m = messages.join(contexts.where("context <> ''"), "conv_id", "left").withColumn("first", F.min("turn").over(w)).withColumn("user", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(w))
    m = m.withColumn("leads", F.max((F.col("turn") == F.col("first")) & (F.col("role") == "system")).over(w))
    to_user = F.col("user").isNotNull() if mode == "suffix" else F.lit(False)
    text = (
        F.when(F.col("context").isNull(), F.col("text"))
        .when(to_user & (F.col("turn") == F.col("user")), F.concat_ws("\n\n", "context", "text"))
        .when(~to_user & F.col("leads") & (F.col("turn") == F.col("first")), F.concat_ws("\n\n", "text", "context"))
        .otherwise(F.col("text"))
    )
    same = m.select("conv_id", "turn", "role", text.alias("text"))
    new = m.where(F.col("context").isNotNull() & ~to_user & ~F.col("leads") & (F.col("turn") == F.col("first"))).select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit("system").alias("role"), F.col("context").alias("text"))
    return same.unionByName(new)


def sticky_keys(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, key): for each user turn, a hash of the agent and of everything up to it. ``messages`` may have agent_id.

    A message counts by 120 bits of a digest of its place, role and text; the sums of those so far are hashed, so no list of messages is built.
    """
    agent = F.coalesce(F.col("agent_id"), F.lit("")) if "agent_id" in messages.columns else F.lit("")
    digest = F.md5(F.concat_ws(":", F.col("turn").cast("string"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    digits = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")
    m = messages.select("conv_id", "turn", "role", agent.alias("_agent"), digits(1).alias("_a"), digits(16).alias("_b"))
    m = running_sums(m, ["conv_id"], [F.col("turn")], {"_x": F.col("_a"), "_y": F.col("_b")})
    key = F.sha2(F.concat_ws(":", "_agent", F.col("_x").cast("string"), F.col("_y").cast("string")), 256)
    return m.where("role = 'user'").select("conv_id", "turn", key.alias("key"))


def request_key(messages: DataFrame) -> DataFrame:
    """(conv_id, key): the first message's line with the current date, and the last message's text.

    Retrieved context is added to the first message, so the key is the same before and after. Null without such a line.
    """
    ends = messages.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max_by("text", "turn").alias("last"))
    date_line = F.nullif(F.regexp_extract("first", r"[^\r\n]*Current date[^\r\n]*", 0), F.lit(""))
    return ends.select("conv_id", F.concat(date_line, F.lit("\n"), F.coalesce("last", F.lit(""))).alias("key"))


def sticky_history(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, shown): earlier user turns with their cached blocks; ``cache`` has key, block, memory_ids."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    keys = sticky_keys(messages).join(last, "conv_id").where("turn < last").join(cache, "key").select("conv_id", "turn", "block", "memory_ids")
    m = messages.join(keys, ["conv_id", "turn"], "left")
    text = F.when(F.coalesce("block", F.lit("")) != "", F.concat_ws("\n\n", "block", "text")).otherwise(F.col("text"))
    return m.select("conv_id", "turn", "role", text.alias("text"), F.coalesce("memory_ids", F.array().cast("array<bigint>")).alias("shown"))


def recently_used(cache: DataFrame, capacity: int) -> DataFrame:
    """The cache's ``capacity`` rows used last: a top-k, so no task sorts them all."""
    return cache.orderBy(F.desc("last_access"), "key").limit(capacity)


def omission_notice(trimmed: DataFrame, notice: str) -> DataFrame:
    """(conv_id, context): a notice for each conversation that lost messages."""
    return trimmed.groupBy("conv_id").agg(F.count_if(~F.col("kept")).alias("n")).where("n > 0").select("conv_id", F.concat(F.lit(notice), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("context"))


def reply_of_chunks(chunks: DataFrame) -> DataFrame:
    """(stream_id, text): the text of (stream_id, seq, chunk) with 'data: ' lines of either wire format, lines cut anywhere."""
    joined = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("body"))
    lines = F.transform(F.split("body", "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data: ") & (x != "data: [DONE]")), lambda x: F.substring(x, 7, 1 << 30))
    delta = lambda x: F.coalesce(F.get_json_object(x, "$.choices[0].delta.content"), F.when(F.get_json_object(x, "$.delta.type") == "text_delta", F.get_json_object(x, "$.delta.text")), F.lit(""))
    return joined.select("stream_id", F.array_join(F.transform(data, delta), "").alias("text"))


def response_text(body: Column) -> Column:
    """The texts of a reply's text blocks, put together."""
    blocks = F.from_json(F.get_json_object(body, "$.content"), "array<struct<type:string,text:string>>")
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")


def request_status(body: Column, most_bytes: int = 1 << 20, blocks: bool = False) -> Column:
    """413 for a body over the limit, 400 for one that can't be read or lacks messages (for ``blocks`` also: none, or the last isn't the user's), else 200."""
    parsed = F.try_parse_json(body)
    messages = F.get_json_object(body, "$.messages")
    bad = parsed.isNull() | messages.isNull() | ~messages.startswith("[")
    if blocks:
        rows = F.from_json(messages, "array<struct<role:string>>")
        bad = bad | (F.size(rows) <= 0) | (F.try_element_at(rows, F.lit(-1))["role"] != "user")
    return F.when(F.octet_length(body) > most_bytes, 413).when(F.coalesce(bad, F.lit(True)), 400).otherwise(200)


def block_texts(contents: DataFrame) -> DataFrame:
    """(request_id, text): the texts of structured contents (request_id, content), where ``content`` is a VARIANT: a text, or blocks with texts and nested results of tools, put together in order.

    Blocks are taken apart level by level; a level is written, and the next one has only what results of tools hold. Requests without any text aren't returned.
    """
    spark, is_a = contents.sparkSession, lambda c, kind: F.schema_of_variant(c).startswith(kind)
    part = lambda c, path: F.try_variant_get(c, path, "variant")
    open_, found = contents.select("request_id", F.array().cast("array<int>").alias("path"), "content").where("content IS NOT NULL"), []
    while True:
        found.append(open_.where(is_a(F.col("content"), "STRING")).select("request_id", "path", F.variant_get("content", "$", "string").alias("text")))
        blocks = open_.where(is_a(F.col("content"), "ARRAY")).lateralJoin(spark.tvf.variant_explode(F.col("content").outer()))
        blocks = blocks.select("request_id", F.concat("path", F.array("pos")).alias("path"), F.try_variant_get("value", "$.type", "string").alias("type"), part(F.col("value"), "$.text").alias("text"), part(F.col("value"), "$.content").alias("content"))
        # as text, since a written VARIANT isn't read by every reader
        level = kept(blocks.where("type IN ('text', 'tool_result')").select("request_id", "path", "type", F.to_json("text").alias("text"), F.to_json("content").alias("content")), "blocks")
        texts = level.where("type = 'text' AND text IS NOT NULL").select("request_id", "path", F.parse_json("text").alias("text"))
        found.append(texts.where(is_a(F.col("text"), "STRING")).select("request_id", "path", F.variant_get("text", "$", "string").alias("text")))
        deeper = level.where("type = 'tool_result' AND content IS NOT NULL")
        if deeper.isEmpty():
            break
        open_ = deeper.select("request_id", "path", F.parse_json("content").alias("content"))
    parts = F.array_sort(F.collect_list(F.struct("path", "text")))
    return reduce(DataFrame.unionByName, found).groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def last_user_texts(bodies: DataFrame) -> DataFrame:
    """(request_id, text) of (request_id, body): the text of the last user message of a request, empty for a body that can't be read or has none. No Python runs."""
    spark = bodies.sparkSession
    listed = bodies.select("request_id", F.try_variant_get(F.try_parse_json("body"), "$.messages", "variant").alias("messages")).where(F.schema_of_variant("messages").startswith("ARRAY"))
    each = listed.lateralJoin(spark.tvf.variant_explode(F.col("messages").outer())).select("request_id", "pos", F.try_variant_get("value", "$.role", "string").alias("role"), F.to_json(F.try_variant_get("value", "$.content", "variant")).alias("content"))
    last = each.where("role = 'user' AND content IS NOT NULL").groupBy("request_id").agg(F.max_by("content", "pos").alias("content"))
    texts = block_texts(last.select("request_id", F.parse_json("content").alias("content")))
    return bodies.select("request_id").join(texts, "request_id", "left").fillna("", "text")
