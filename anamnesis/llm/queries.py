"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, attribution, bpe, collocations, embeddings, orderhash, packing, quality, sharding, simhash, toxicity, urls, warc
from .durable import ship, table


def vocab(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Ids that a source hands out at a time; a window holds 16 such.
QUANTUM = 128


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's share of a window holds to within a quantum, and over windows exactly."""
    return packing.pack(table(ship(spark), sf_dir, "documents"), vocab(), quantum=QUANTUM).drop("queue", "ids")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(ship(spark), sf_dir, "documents"), vocab())


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return lambda doc_id: F.crc32(doc_id.cast("string")) % modulus


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose remainder modulo 4 is 2 are never learned from."""
    docs, labels = table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.fit(docs, labels, lambda i: remainder(4)(i) != 2))
    return found.select("doc_id", F.coalesce(remainder(4)(F.col("doc_id")) == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose remainder modulo 3 is 1 are never learned from."""
    docs, labels = table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.score(docs, quality.fit(docs, labels, lambda i: remainder(3)(i) != 1))
    return found.select("doc_id", F.coalesce(remainder(3)(F.col("doc_id")) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(ship(spark), sf_dir, "documents"), 24)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(ship(spark), sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(ship(spark), sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of all pages and put its records together again; sizes and digests are those of the rebuilt responses' blocks, and for revisits those of the payload that they refer to, taken once where it is stored."""
    path = warc.write_archive(table(ship(spark), sf_dir, "pages"))
    records = warc.blocks(warc.read_archive(spark, path))
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length("block").cast("long"))
    digest = F.when(revisit, F.col("payload_digest")).otherwise(warc.base32(F.sha1("block")))
    return records.select(F.col("id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(ship(spark), sf_dir, "documents"), vocab("byte_bpe_50k.tiktoken"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderhash.compare_edits(table(ship(spark), sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(ship(spark), sf_dir, "documents"), vocab("byte_bpe_50k.json"), vocab("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(ship(spark), sf_dir, "documents"))


#: Hosts with the start of a path, and what becomes of their URLs.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(ship(spark), sf_dir, "pages"), URL_RULES)


#: In DuckDB: base32 of a SHA-1, five hexadecimal digits (four letters) at a time.
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((instr('0123456789abcdef', substr(h, 5 * (i // 4) + 1, 1)) - 1) * 65536 + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 2, 1)) - 1) * 4096 + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 3, 1)) - 1) * 256 + (instr('0123456789abcdef', substr(h, 5 * (i // 4) + 4, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 5 * (i // 4) + 5, 1)) - 1) // (1 << (15 - 5 * (i % 4)))) % 32 + 1, 1)), 'string_agg', '')"

ORACLES: dict[str, str] = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
d AS (SELECT page_id, owner, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d""",
    "op12_collocations": collocations.mine_sql(),
    "op13_urls": urls.judge_sql(URL_RULES),
}

QUERIES = {
    "op1_packing": op1_packing, "op2_warc": op2_warc, "op3_token_counts": op3_token_counts, "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity, "op7_quality": op7_quality, "op6_kd_shards": op6_kd_shards, "op8_embedding_dedup": op8_embedding_dedup, "op9_simhash": op9_simhash, "op10_order_minhash": op10_order_minhash,
    "op11_alignment": op11_alignment, "op12_collocations": op12_collocations, "op13_urls": op13_urls,
}
