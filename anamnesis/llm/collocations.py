"""Operator 12: phrase collocations from the counts of longest windows alone.

Every word is counted once, in the window of ``longest`` words that it leads; windows are
padded where their piece of text ends. A task counts the windows of a portion of text in numpy
(the columns of a window are the words' codes shifted by one place each) and deals the
distinct ones over buckets by a hash of the whole window, in order and compressed, so no common word or pair
gathers in a task. Shorter phrases are never cut out of the text: their counts are sums over longer windows, which
Spark's ROLLUP makes (a prefix that ends in padding is the next shorter one's).

Before that, what can't be a candidate is folded. Where all of a window's counts have met and are under ``least``, its last word becomes
padding; where all windows of the remaining words have met and are rare too, the word before. No sum over a
prefix that comes ``least`` times changes by that, nor the sums of single words and of all words.

A candidate is a phrase of 2 to ``longest`` words with a = f(phrase) >= ``least``. Each cut into two parts
gives floor(1000000 * a * a / (l * r)); the lowest counts, ties to the earliest cut. All
products are decimals of 38 digits, which hold a up to 10**16. A candidate is dropped if it lies in a longer
candidate whose count is at least ``inside`` percent of its own.

Everything is per ``lang`` (null: ``und``). What a language keeps is its first ``top``, by score, count and phrase.

Defined results: A-Z are put in lower case; pieces end at ``.,;:!?`` and at the characters from line feed to carriage
return; words are what lies between spaces and tabs; null is empty. Repeated rows count as often as they
come. Ids and further columns aren't read. A language without words has no rows, and no candidate gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import csv
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import materialise
from .lines import glued, joined, portions, strings
from .orderhash import BASE, mix

#: Kinds of bytes: part of a word, white space within a piece, end of a piece.
WORD, SPACE, STOP = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = SPACE
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = STOP
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SCALE = 1_000_000
NOTHING = pa.scalar("", pa.large_string())
#: Bytes of text per bucket, bytes of text that are counted and windows that are dealt at a time.
BUCKET_BYTES, AT_ONCE, DEALT_AT_ONCE = 2 << 20, 3 << 20, 250_000


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, rows, pieces): in order, each with its text's number and its piece's; pieces are numbered across texts."""
    data, offsets = joined(texts)
    data = FOLD[data]
    kind = KIND[data]
    inside = np.concatenate([[False], kind == WORD, [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    # a text's end is also a word's
    edge = offsets[1:-1]
    edge = np.unique(edge[(edge > 0) & (edge < len(data))])
    edge = edge[inside[edge] & inside[edge + 1]]
    start, end = np.sort(np.concatenate([start, edge])), np.sort(np.concatenate([end, edge]))
    stops = np.concatenate([[0], np.cumsum(kind == STOP)])
    rows = np.searchsorted(offsets, start, "right") - 1
    return strings(data, start, end), rows, stops[start] + rows


def count_windows(texts: pa.Array, langs: pa.Array, longest: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """(lang, windows, counts, hashes): the distinct padded windows of a portion in order; a window is its words joined by spaces, padding being empty."""
    found, rows, pieces = words(texts)
    if not len(found):
        return
    coded = found.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)  # 0 is padding
    lead = rank[coded.indices.to_numpy()]
    kinds = langs.fill_null("und").dictionary_encode()
    columns = [kinds.indices.to_numpy().astype(np.int64)[rows], lead]
    for k in range(1, longest):
        shifted = np.zeros(len(lead), np.int64)
        same = pieces[k:] == pieces[:-k]
        shifted[: len(same)][same] = lead[k:][same]
        columns.append(shifted)
    distinct, n = counted(columns)
    names = pa.concat_arrays([pa.array([""], pa.large_string()), coded.dictionary.take(pa.array(order))])
    whole = glued(*(names.take(pa.array(c)) for c in distinct[1:]), by=" ")
    of_word = hashes(names)
    hashed = np.zeros(len(n), np.uint64)
    for c in distinct[1:]:
        hashed = mix(hashed * BASE + of_word[c])
    for lang, i, j in runs(distinct[0]):
        yield kinds.dictionary[lang].as_py(), whole.slice(i, j - i), n[i:j], hashed[i:j]


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of integer columns in order, and how often each comes."""
    keys, room = [], 0
    for c in columns:  # as many columns as fit go into one integer of 63 bits
        bits = max(1, int(c.max()).bit_length())
        if not keys or room + bits > 63:
            keys.append(c.copy())
            room = bits
        else:
            keys[-1] = keys[-1] << bits | c
            room += bits
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs of equal values."""
    edges = np.flatnonzero(np.diff(values, prepend=values[:1] - 1, append=values[-1:] - 1)) if len(values) else np.zeros(1, int)
    for i, j in zip(edges[:-1], edges[1:]):
        yield int(values[i]), int(i), int(j)


def fewer(keys: pa.Array) -> pa.Array:
    """Windows without their last word."""
    return pc.replace_substring_regex(keys, " [^ ]*$", "")


def hashes(texts: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, texts.to_pylist()), np.uint64, len(texts))


def deal(lang: str, keys: pa.Array, counts: np.ndarray, hashed: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, lang, size, payload): windows compressed together by their bucket."""
    bucket = (hashed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    lines = glued(glued(keys.take(pa.array(order)), pa.array(counts[order]), by="\t"), NOTHING, by="\n")
    data, offsets = joined(lines)
    parts = [(k, data[offsets[i] : offsets[j]].tobytes()) for k, i, j in runs(bucket[order])]
    codec = pa.Codec("zstd")
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in parts], pa.int32()), pa.array([lang] * len(parts), pa.string()), pa.array([len(x) for _, x in parts], pa.int32()), pa.array([codec.compress(x, asbytes=True) for _, x in parts], pa.binary())],
        ["bucket", "lang", "size", "payload"])


DEALT = "bucket int, lang string, size int, payload binary"


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(lang, windows, counts) of one bucket and language after the other: its distinct windows, in order, with their sums. Rows come sorted by bucket and language."""
    key, parts, codec = None, [], pa.Codec("zstd")
    options = {"read_options": csv.ReadOptions(column_names=["k", "n"], use_threads=False), "parse_options": csv.ParseOptions(delimiter="\t", quote_char=False), "convert_options": csv.ConvertOptions(column_types={"k": pa.large_string(), "n": pa.int64()}, strings_can_be_null=False)}

    def summed() -> tuple[str, pa.Array, np.ndarray]:
        rows = csv.read_csv(pa.BufferReader(b"".join(parts)), **options)
        coded = rows["k"].combine_chunks().dictionary_encode()
        sums = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(sums, coded.indices.to_numpy(), rows["n"].to_numpy())
        order = pc.sort_indices(coded.dictionary)
        return key[1], coded.dictionary.take(order), sums[order.to_numpy()]

    for batch in batches:
        for bucket, lang, size, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if (bucket, lang) != key:
                if parts:
                    yield summed()
                key, parts = (bucket, lang), []
            parts.append(codec.decompress(payload, decompressed_size=size, asbytes=True))
    if parts:
        yield summed()


def folded(keys: pa.Array, counts: np.ndarray, by: pa.Array, rare: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Windows in which rare ones have become the window ``by``, equal ones summed."""
    both = pa.concat_arrays([keys.filter(pa.array(~rare)), by.filter(pa.array(rare))]).dictionary_encode()
    sums = np.zeros(len(both.dictionary), np.int64)
    np.add.at(sums, both.indices.to_numpy(), np.concatenate([counts[~rare], counts[rare]]))
    order = pc.sort_indices(both.dictionary)
    return both.dictionary.take(order), sums[order.to_numpy()]


def windows(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, w1..wn, n): how often each padded longest window comes; those that come less than ``least`` times have their ends padded further, as far as needed. Written."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, min(size // BUCKET_BYTES, 1 << 20))
    parts = max(min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), buckets // 4)
    names = [f"w{k + 1}" for k in range(longest)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in portions(batch.column(0), AT_ONCE):
                for lang, keys, n, hashed in count_windows(batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), longest):
                    yield deal(lang, keys, n, hashed, buckets)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    def fold_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows are complete here: rare ones lose their last word. They are dealt by what is left, those of several buckets together."""
        held: dict[str, list] = {}
        for lang, keys, n in met(batches):
            padded = glued(fewer(keys), NOTHING, by=" ")
            held.setdefault(lang, []).append(folded(keys, n, padded, n < least))
            if sum(len(n) for lot in held.values() for _, n in lot) >= DEALT_AT_ONCE:
                yield from (dealt_by_beginning(*lot) for lot in held.items())
                held.clear()
        yield from (dealt_by_beginning(*lot) for lot in held.items())
        pa.default_memory_pool().release_unused()

    def dealt_by_beginning(lang: str, lot: list) -> pa.RecordBatch:
        keys, n = pa.concat_arrays([k for k, _ in lot]), np.concatenate([n for _, n in lot])
        begin = fewer(keys).dictionary_encode()
        return deal(lang, keys, n, hashes(begin.dictionary)[begin.indices.to_numpy()], buckets)

    def fold_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All windows with the same words but the last are here: rare groups lose one word more. Padding becomes null."""
        for lang, keys, n in met(batches):
            begin = fewer(keys).dictionary_encode()
            total = np.zeros(len(begin.dictionary), np.int64)
            np.add.at(total, begin.indices.to_numpy(), n)
            rare = (total < least)[begin.indices.to_numpy()]
            keys, n = folded(keys, n, glued(fewer(fewer(keys)), NOTHING, NOTHING, by=" "), rare)
            columns = pc.split_pattern(keys, " ")
            cells = columns.flatten().cast(pa.string()) if isinstance(columns, pa.LargeListArray) else columns.values.cast(pa.string())
            at = np.arange(len(keys)) * longest
            words_ = [pc.replace_with_mask(c := cells.take(pa.array(at + k)), pc.equal(c, ""), pa.scalar(None, pa.string())) for k in range(longest)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), *words_, pa.array(n)], ["lang", *names, "n"])

    exchange = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket", "lang")
    dealt = exchange(docs.select("text", F.col("lang").cast("string")).mapInArrow(count, DEALT))
    if longest > 1:
        dealt = exchange(dealt.mapInArrow(fold_last, DEALT))
    found = dealt.mapInArrow(fold_more, f"lang string, {', '.join(f'{c} string' for c in names)}, n long")
    return materialise(found.groupBy("lang", *names).agg(F.sum("n").alias("n")), "windows")


def phrase_counts(counted: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of phrases that come ``least`` times, and (lang, n) with all words of each language."""
    names = [f"w{k + 1}" for k in range(longest)]
    rolled = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # the grouping number has a bit for each column that is summed over; padding within a prefix is no word
    size = F.lit(longest) - F.bit_count("g")
    real = F.coalesce(F.size(F.array_compact(F.array(*names))) == F.col("size"), F.lit(False))
    rolled = materialise(rolled.withColumn("size", size.cast("int")).where(F.col("lang").isNotNull() & ((F.col("size") == 0) | (F.col("f") >= least) & real)), "rolled")
    return rolled.where("size > 0").select("lang", F.concat_ws(" ", *names).alias("phrase"), "size", "f"), rolled.where("size = 0").select("lang", F.col("f").alias("n"))


def cut_scores(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score): candidates with the parts of their lowest cut."""
    candidates = counts.where("size >= 2").withColumnRenamed("f", "a")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    part = lambda c: F.array_join(c, " ")
    cuts = candidates.select("*", k).withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", "size", "a", "k", part(F.slice("w", F.lit(1), F.col("k"))).alias("left"), part(F.slice("w", F.col("k") + 1, F.col("size"))).alias("right"))
    side = lambda name, value: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    both = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    score = _whole((big("a") * big("a")) * F.lit(SCALE).cast("decimal(7,0)"), big("l") * big("r"))
    scored = both.withColumn("score", score)
    return scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def _whole(a: Column, b: Column) -> Column:
    """The whole part of a quotient of decimals."""
    return F.call_function("div", a, b)


def not_inside(scored: DataFrame, longest: int, inside: int) -> DataFrame:
    """Candidates that lie in no longer candidate of ``inside`` percent of their count."""
    at = F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(0, size - k), i -> struct(i AS i, k AS k))))")).alias("at")
    longer = scored.where("size >= 3").select("lang", "a", F.split("phrase", " ").alias("w"), "size", at)
    covering = longer.select("lang", F.array_join(F.slice("w", F.col("at.i") + 1, F.col("at.k")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    found = scored.join(covering, ["lang", "phrase"], "left")
    return found.where(F.coalesce(F.lit(100) * F.col("most") < F.lit(inside) * F.col("a"), F.lit(True))).drop("most")


def mine(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language. ``docs`` has text and lang."""
    counts, totals = phrase_counts(windows(docs, longest, least), longest, least)
    scored = materialise(cut_scores(materialise(counts, "phrases"), longest), "candidates")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = not_inside(scored, longest, inside).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def mine_sql(longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000) -> str:
    """The same over ``documents`` in SQL for DuckDB, by counting every phrase on its own."""
    sizes = range(1, longest + 1)
    phrases = " UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM pieces WHERE len(w) >= {k}" for k in sizes)
    return rf"""WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM split),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM ({phrases}) GROUP BY ALL), total AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2 AND f >= {least}),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM c, (SELECT unnest(range(1, {longest})) AS k) WHERE k < size),
s AS (SELECT cuts.lang, cuts.size, cuts.phrase, a, k, p.f AS l, q.f AS r, (1000000::HUGEINT * a * a) // (p.f::HUGEINT * q.f) AS score FROM cuts JOIN counts p ON p.lang = cuts.lang AND p.phrase = x JOIN counts q ON q.lang = cuts.lang AND q.phrase = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
within AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest(range(2, {longest})) AS m), (SELECT unnest(range(1, {longest})) AS i) WHERE m < size AND i + m - 1 <= size GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN within ON within.lang = b.lang AND within.phrase = b.phrase WHERE most IS NULL OR 100 * most < {inside} * a)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= {top}"""
