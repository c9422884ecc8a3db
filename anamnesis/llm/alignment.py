"""Operator 11: alignment of two tokenizers' tokens, by divide and conquer at ends that they share.

Text with a space before it is encoded by a byte-level BPE (A) and by a piece model (B, which adds that space itself). Both
cut a text independently before a space or line feed that follows a visible character, and before a mark like a full stop that follows
a letter if no piece of B holds both, so texts are cut there and each
distinct chunk is encoded once per portion of text; a worker remembers the first ones that it meets.

Token ends are byte offsets. An interval of both token lists that ends at a common end is divided at a common end near
its middle: the middle A end is looked up among the B ends by bisection, then its neighbours on both
sides; both halves are divided in turn, all intervals of a level at once in numpy. An interval without
a common end inside is a leaf group. Links are the pairs of tokens whose bytes overlap.

Links are counted by how many documents have their pair of ids. A document's pairs are written once, with how
often each comes; counts join them with the commonest pairs broadcast (a proven bound) and the others shuffled.

Defined results: null and empty texts, and texts whose tokens' bytes aren't the text (as one with U+2581), have no tokens and zeros.
Rows are told apart even if they repeat an id; each counts as a document. An empty table stays empty. Columns other
than the key and the text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import materialise
from .hotjoin import BOUND, hot_apart
from .lines import joined, portions, strings

#: Bytes of text at a time; chunks that a worker remembers, and their length at most; neighbours that are asked one by one.
AT_ONCE, REMEMBERED, SHORT, NEIGHBOURS = 3 << 20, 300_000, 64, 8


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers: chunks to ids, ids to bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        spelled, special = byte_alphabet(), self.a.get_added_tokens_decoder()
        a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            a_bytes[i] = token.encode() if i in special else bytes(spelled[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = not any(re.search("[^▁]▁|\n", p) for p in pieces)
        self.stops = np.array([ord(c) for c in ".,;:!?" if not any(re.search(f"[A-Za-zÀ-ÖØ-öø-ÿ]{re.escape(c)}", p) for p in pieces)], np.uint8)
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        self.space = self.b.piece_to_id("▁")
        #: Chunks with both lists of ids, as 32-bit numbers: how many are A's, A's, B's. Nothing if a list's bytes aren't the chunk.
        self.known: dict[str, bytes] = {}

    def encode(self, chunks: list[str]) -> list[bytes]:
        """What ``known`` holds, of chunks that begin with a space or a line feed."""
        new = [c for c in chunks if c not in self.known]
        found = {}
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            # the library puts a space before a text that isn't empty: here for the chunk's own, or left out again with a line feed that parts it from the chunk
            right = self.b.encode([c[1:] if c[0] == " " else f"\n{c}" for c in part], num_threads=1)
            for c, a, b in zip(part, self.a.encode_batch_fast(part, add_special_tokens=False), right):
                b = (b or [self.space]) if c[0] == " " else b[2:]
                want = c.encode()
                same = all(b"".join(map(own.__getitem__, ids)) == want for own, ids in zip(self.bytes, (a.ids, b)))
                found[c] = array("I", [len(a.ids), *a.ids, *b]).tobytes() if same else b""
        if room := REMEMBERED - len(self.known):
            self.known |= islice(((c, ids) for c, ids in found.items() if len(c) <= SHORT), room)
        return [found[c] if c in found else self.known[c] for c in chunks]


@cache
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def gather(start: np.ndarray, count: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the stretches ``which`` of a ragged array, in a row."""
    n = count[which]
    before = np.cumsum(n) - n
    return np.arange(n.sum()) + np.repeat(start[which] - before, n)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of both sides end at common ends. ``a`` and ``b`` are ends in order; the cuts are places of common ends already known, the last tokens among them."""
    at_a, at_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    at_a[a_cuts] = at_b[b_cuts] = True
    begin = lambda cuts: np.concatenate([[0], cuts[:-1] + 1])
    lo, hi, lo_b, hi_b = begin(a_cuts), a_cuts, begin(b_cuts), b_cuts  # inclusive; hi is the interval's own end
    while len(lo):
        open_ = (hi > lo) & (hi_b > lo_b)
        lo, hi, lo_b, hi_b = lo[open_], hi[open_], lo_b[open_], hi_b[open_]
        middle = (lo + hi - 1) // 2
        i, j, left = np.full(len(lo), -1), np.full(len(lo), -1), np.arange(len(lo))
        for step in (s for d in range(NEIGHBOURS + 1) for s in ((d, -d) if d else (0,))):
            if not len(left):
                break
            probe = middle[left] + step
            asked = left[(probe >= lo[left]) & (probe < hi[left])]
            probe = middle[asked] + step
            place = np.searchsorted(b, a[probe])
            hit = b[place] == a[probe]
            i[asked[hit]], j[asked[hit]] = probe[hit], place[hit]
            left = left[i[left] < 0]
        for x in left[hi[left] - lo[left] > 2 * NEIGHBOURS]:  # not all of its ends were asked
            own = a[lo[x] : hi[x]]
            place = lo_b[x] + np.searchsorted(b[lo_b[x] : hi_b[x]], own)
            hits = np.flatnonzero(b[place] == own)
            if len(hits):
                best = hits[np.argmin(np.abs(hits + lo[x] - middle[x]))]
                i[x], j[x] = lo[x] + best, place[best]
        cut = i >= 0
        i, j, lo, hi, lo_b, hi_b = (v[cut] for v in (i, j, lo, hi, lo_b, hi_b))
        at_a[i] = at_b[j] = True
        lo, hi, lo_b, hi_b = (np.concatenate(v) for v in ((lo, i + 1), (i, hi), (lo_b, j + 1), (j, hi_b)))
    return at_a, at_b


def digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below ``most`` as rows of decimal digits, with room for one more character, and how many digits they have."""
    texts = [str(i).encode() for i in range(most)]
    width = max(map(len, texts)) + 1
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(most, width), np.array([len(t) for t in texts])


digits = cache(digits)


class Aligned:
    """A portion of texts: ids, ends and groups of both sides. Texts without tokens have none."""

    def __init__(self, texts: pa.Array, p: Pair):
        column = texts.cast(pa.large_string()).fill_null("")
        self.n = len(column)
        given = np.array(pc.binary_length(column)) > 0
        data, offsets = joined(pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column.filter(pa.array(given)), pa.scalar("", pa.large_string())))
        docs = np.flatnonzero(given)
        first = np.zeros(len(data) + 1, bool)
        if p.cuttable and len(data) > 2:
            before = data[1:-1]
            accented = (before >= 0x80) & (data[:-2] == 0xC3)
            visible = (before >= 0x21) & (before <= 0x7E) | accented
            letter = (before | 0x20 >= 0x61) & (before | 0x20 <= 0x7A) & (before < 0x80) | accented & (before != 0x97) & (before != 0xB7)
            first[2:-1] = visible & ((data[2:] == 0x20) | (data[2:] == 0x0A)) | letter & np.isin(data[2:], p.stops)
        first[offsets[:-1]] = True
        start = np.flatnonzero(first[:-1])
        chunks = strings(data, start, np.append(start[1:], len(data))).dictionary_encode()
        which, of = chunks.indices.to_numpy(), docs[np.searchsorted(offsets, start, "right") - 1]
        ids = p.encode(chunks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        wrong = np.zeros(self.n, bool)
        wrong[of[(sizes == 0)[which]]] = True
        keep = ~wrong[of]
        which, of = which[keep], of[keep]
        n_a = np.zeros(len(ids), np.int64)
        n_a[sizes > 0] = flat[at[sizes > 0]]
        self.ids, self.ends, self.doc = [], [], []
        for side, (start, count) in enumerate(((at + 1, n_a), (at + 1 + n_a, sizes - 1 - n_a))):
            own = flat[gather(start, count, which)].astype(np.int64)
            self.ids.append(own)
            self.ends.append(np.cumsum(p.lengths[side][own]))
            self.doc.append(np.repeat(of, count[which]))
        last = [np.flatnonzero(np.diff(d, append=-1) != 0) for d in self.doc]
        self.cut = shared_cuts(*self.ends, *last)
        self.last = last

    def per_doc(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=self.n)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of A and B tokens that overlap: a pair for each stretch between neighbouring ends."""
        (a, b), (_, cut_b) = self.ends, self.cut
        rest = np.flatnonzero(~cut_b)
        return np.concatenate([np.arange(len(a)), np.searchsorted(a, b[rest])]), np.concatenate([np.searchsorted(b, a), rest])

    def spelled(self) -> Iterator[tuple[int, bytes]]:
        """Each text's groups, as its number and ``a1,a2|b1;a3|b2,b3``."""
        (a, b), (cut_a, cut_b) = self.ids, self.cut
        end_a, end_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
        group = lambda cut: np.cumsum(cut) - cut
        at_a = np.arange(len(a)) + np.concatenate([[0], end_b])[group(cut_a)]
        at_b = np.arange(len(b)) + end_a[group(cut_b)]
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b], mark[at_a[cut_a]], mark[at_b[cut_b]] = a, b, ord("|"), ord(";")
        table, width = digits(1 << 16 if max(a.max(initial=0), b.max(initial=0)) < 1 << 16 else int(max(a.max(), b.max())) + 1)
        rows, wide = table[ids], width[ids]
        rows[np.arange(len(ids)), wide] = mark
        text = rows[np.arange(table.shape[1]) <= wide[:, None]]
        upto = np.cumsum(wide + 1)[at_b[self.last[1]]]
        for doc, i, j in zip(self.doc[1][self.last[1]], np.concatenate([[0], upto[:-1]]), upto):
            yield int(doc), text[i : j - 1].tobytes()


def _documents(texts: pa.Array, p: Pair) -> list[pa.Array]:
    """Columns of a portion: numbers of tokens, groups and links, the digest, pairs of ids and how often each comes."""
    x = Aligned(texts, p)
    n_a, n_b, n_groups = x.per_doc(x.doc[0]), x.per_doc(x.doc[1]), x.per_doc(x.doc[0][x.cut[0]])
    digest = [""] * x.n
    for doc, text in x.spelled() if len(x.ids[0]) else ():
        digest[doc] = hashlib.sha256(text).hexdigest()
    i, j = x.links()
    bits = int(len(p.lengths[0]) * len(p.lengths[1])).bit_length()
    keys = np.sort(x.doc[0][i] << bits | x.ids[0][i] * len(p.lengths[1]) + x.ids[1][j])
    new = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
    times, of = np.diff(np.append(new, len(keys))), keys[new] >> bits
    offsets = pa.array(np.concatenate([[0], np.cumsum(x.per_doc(of))]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((keys[new] & ((1 << bits) - 1), pa.int64()), (times, pa.int32()))]
    return [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_a + n_b - n_groups), pa.array(digest), *lists]


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def documents(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are A's id times the size of B's vocabulary and B's id."""
    source = docs.select(F.col(key).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            for i, j in portions(batch.column(1), AT_ONCE):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), *_documents(part.column(1), p)], ["key", *(c.split()[0] for c in FOUND.split(", "))])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, {FOUND}")


def group_rows(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """(key, group, start, end, a_ids, b_ids): the groups themselves, with their bytes in the text after its added space."""
    source = docs.select(F.col(key).alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_path, b_path)
        for batch in batches:
            for i, j in portions(batch.column(1), AT_ONCE >> 2):
                part = batch.slice(i, j - i)
                x = Aligned(part.column(1), p)
                (cut_a, cut_b), own = map(np.flatnonzero, x.cut), x.doc[0][x.cut[0]]
                first = np.searchsorted(own, own)  # the number of a text's first group
                end, zero = x.ends[0][cut_a], np.concatenate([[0], x.ends[0]])
                begin = zero[np.concatenate([[0], cut_a[:-1] + 1])] if len(cut_a) else end
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cut + 1]), pa.int32()), pa.array(ids, pa.int32())) for cut, ids in zip((cut_a, cut_b), x.ids)]
                columns = [part.column(0).take(pa.array(own)), pa.array(np.arange(len(own)) - first), pa.array(begin - begin[first]), pa.array(end - begin[first]), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "group", "start", "end", "a_ids", "b_ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, group long, start long, end long, a_ids array<int>, b_ids array<int>").withColumnRenamed("key", key)


def pair_counts(found: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many documents have a pair, and whether no pair of its A id is in more."""
    counts = materialise(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(b_size)).cast("long")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return materialise(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", bound: int = BOUND) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    found = materialise(documents(docs, a_path, b_path, key).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(found, pair(a_path, b_path).b.get_piece_size())
    each = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    # a pair's count is its number of rows here, so it is its own weight
    own = hot_apart(each, counts.withColumn("rows", F.col("n")), "pair", "rows", bound)
    sums = own.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"), F.sum(F.col("times") * F.col("n")).alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero(F.col("best"))("n_best"), zero(F.col("total"))("count_sum"), "groups_sha256")
