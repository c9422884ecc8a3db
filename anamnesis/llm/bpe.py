"""Operator 4, BPE encoding and decoding by a minimal acyclic transducer lexicon.

Frequent words of the corpus are compiled into a minimal acyclic automaton: words
share prefixes and suffixes, and every arc carries a number. The numbers along a
word's path add up to the word's place in the lexicon, under which its ids are
kept. The automaton is a few flat arrays in one file, which executors
memory-map. Whole batches of words walk through it at once; words that it doesn't
know are merged exactly by rank. Which words are in it never changes a result.

Defined results: a null text counts as empty and gives no ids; repeated rows are
encoded each on its own; an empty table gives an empty table; only the id and the
text column are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import publish
from .wordpiece import ChunkTable, Vocabulary, chunks, patterns, portions, ragged, vocabulary

#: Symbols of the lexicon, letters of its longest word, and bytes of its file. What stays out is merged by rank, with the same ids.
ALPHABET, LONGEST, MOST_BYTES = 128, 64, 64 << 20


class Lexicon:
    """A transducer from words to id lists, in flat arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.next, self.out, self.final, self.symbols, self.first, self.ids = (arrays[k] for k in ("next", "out", "final", "symbols", "first", "ids"))

    @classmethod
    def build(cls, entries: Iterable[tuple[str, list[int]]]) -> Lexicon:
        """Compile (word, ids) pairs. Words of over ``LONGEST`` letters, or with symbols beyond the ``ALPHABET`` most frequent ones, stay out."""
        entries = {w: list(i) for w, i in entries if 0 < len(w) <= LONGEST}
        used = Counter(c for w in entries for c in w)
        symbols = sorted(ord(c) for c, _ in used.most_common(ALPHABET))
        place = {chr(s): i for i, s in enumerate(symbols)}
        words = sorted(w for w in entries if all(c in place for c in w))
        arcs, final, register = [{}], [False], {}
        path: list[tuple[int, str, int]] = []  # states of the latest word that may still change: parent, symbol, child
        below: dict[int, int] = {}  # words that end at a settled state or beyond it

        def settle(keep: int) -> None:
            while len(path) > keep:
                parent, symbol, child = path.pop()
                below[child] = final[child] + sum(below[s] for s in arcs[child].values())
                key = (final[child], tuple(arcs[child].items()))
                arcs[parent][symbol] = register.setdefault(key, child)

        before = ""
        for word in words:
            common = next((i for i, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            settle(common)
            state = path[-1][2] if path else 0
            for c in word[common:]:
                arcs.append({})
                final.append(False)
                arcs[state][c] = len(arcs) - 1
                path.append((state, c, len(arcs) - 1))
                state = len(arcs) - 1
            final[state] = True
            before = word
        settle(0)
        number, order, stack = {0: 0}, [0], [0]
        while stack:
            for child in arcs[stack.pop()].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
                    stack.append(child)

        following = np.full((len(order), max(len(symbols), 1)), -1, np.int32)
        out = np.zeros_like(following)
        for state in order:
            passed = int(final[state])
            for c in sorted(arcs[state]):
                following[number[state], place[c]] = number[arcs[state][c]]
                out[number[state], place[c]] = passed
                passed += below[arcs[state][c]]
        lists = [entries[w] for w in words]
        return cls({
            "next": following, "out": out, "final": np.array([final[s] for s in order]), "symbols": np.array(symbols, np.int32),
            "first": np.cumsum([0, *map(len, lists)]).astype(np.int64), "ids": np.array([i for x in lists for i in x], np.uint16),
        })

    def dump(self) -> bytes:
        head, at, body = {}, 0, io.BytesIO()
        for k, a in self.arrays.items():
            head[k] = [str(a.dtype), a.shape, at]
            body.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
            at += a.nbytes + -a.nbytes % 8
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        return len(text).to_bytes(8, "little") + text + body.getvalue()

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-map a dumped lexicon: processes of one machine share its pages."""
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view(np.uint64)[0])
        arrays = {}
        for k, (kind, shape, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            arrays[k] = raw[8 + n + at : 8 + n + at + size].view(kind).reshape(shape)
        return cls(arrays)

    def find(self, words: list[str]) -> np.ndarray:
        """Each word's place in the lexicon, -1 if it isn't there."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points) or not len(self.symbols):
            return np.full(len(words), -1, np.int64)
        symbol = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        symbol = np.where(self.symbols[symbol] == points, symbol, -1)
        start = np.cumsum(n) - n
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        state[n == 0] = -1
        alive, step = np.flatnonzero(n > 0), 0
        while len(alive):
            s = symbol[start[alive] + step]
            after = np.where(s < 0, -1, self.next[state[alive], s])
            place[alive] += self.out[state[alive], s]
            state[alive] = after
            step += 1
            alive = alive[(after >= 0) & (n[alive] > step)]
        return np.where((state >= 0) & self.final[state], place, -1)


def resolver(lexicon: Lexicon, vocab: Vocabulary):
    """Words to ids: by the lexicon where it has them, by merging otherwise."""

    def resolve(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        place = lexicon.find(words)
        known = place >= 0
        merged, m = vocab.merge([w for w, k in zip(words, known) if not k])
        n = np.zeros(len(words), np.int64)
        n[~known] = m
        n[known] = lexicon.first[place[known] + 1] - lexicon.first[place[known]]
        out = np.zeros(int(n.sum()), np.uint16)
        at = np.cumsum(n) - n
        out[ragged(at[~known], n[~known])] = merged
        out[ragged(at[known], n[known])] = lexicon.ids[ragged(lexicon.first[place[known]], n[known])]
        return out, n

    return resolve


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs. Within a portion of text, words that occur once are left to the merges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = patterns()[0].findall
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in portions(texts, 1 << 22):
                seen = Counter(c for t in texts[a:b] for c in chunks(t) if isinstance(c, str))
                words: Counter = Counter()
                for c, k in seen.items():
                    for w in (c,) if c.isalpha() else find(c):
                        words[w] += k
                rows = [(w, k) for w, k in words.items() if k > 1]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([k for _, k in rows], pa.int64())], ["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocab_path: str, text_col: str = "text", entries: int = 32_768) -> str:
    """Compile the corpus's ``entries`` most frequent words, or as many halvings of them as fit the file, and publish it; returns its name on executors."""
    vocab = vocabulary(vocab_path)
    top = word_counts(docs, text_col).orderBy(F.desc("n"), "word").limit(entries).collect()
    words = [r.word for r in top]
    ids, n = vocab.merge(words)
    ends = np.cumsum(n)
    pairs = [(w, ids[e - k : e].tolist()) for w, k, e in zip(words, n, ends)]
    while len(file := Lexicon.build(pairs).dump()) > MOST_BYTES:
        pairs = pairs[: len(pairs) // 2]
    return publish(docs.sparkSession, "lexicon.bin", file)


@cache
def _table(lexicon: str, vocab_path: str) -> ChunkTable:
    return ChunkTable(resolver(Lexicon.load(SparkFiles.get(lexicon)), vocabulary(vocab_path)))


def encode_batches(batches: Iterator[pa.RecordBatch], lexicon: str, vocab_path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(keys, id arrays) for batches of (key, text)."""
    table = _table(lexicon, vocab_path)
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in portions(texts):
            flat, n = table.encode(texts[a:b])
            yield keys.slice(a, b - a), np.split(flat, np.cumsum(n)[:-1])


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = 32_768) -> DataFrame:
    """(id, ids array<int>) of every whole text."""
    lexicon = compile_lexicon(docs, vocab_path, text_col, entries)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for keys, ids in encode_batches(batches, lexicon, vocab_path):
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def detokenise(ids: list[int], vocab: Vocabulary) -> str:
    """The vocabulary has no decoder: its tokens are joined by spaces, special ones included."""
    return " ".join(map(vocab.tokens.__getitem__, ids))


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of id lists; a null list counts as empty."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [detokenise(x or [], vocab) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", entries: int = 32_768) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode, keeping digests only."""
    lexicon = compile_lexicon(docs, vocab_path, text_col, entries)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(vocab_path)
        digits = [str(i) for i in range(1 << 16)]
        for keys, ids in encode_batches(batches, lexicon, vocab_path):
            lists = [x.tolist() for x in ids]
            sha = [hashlib.sha256(" ".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in lists]
            back = [hashlib.sha256(detokenise(x, vocab).encode()).hexdigest() for x in lists]
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(len, lists), pa.int64()), pa.array(sha), pa.array(back)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
