"""Word-level encoding shared by the packing and the BPE operators.

The vocabulary ``word_bpe_49k.json`` normalises a text (NFC, white space, lower
case), cuts it into words by one pattern and merges every word on its own. So a
text's ids are its words' ids in a row, and a word need be merged only once per
worker: texts are cut at white space, every distinct chunk is resolved once, and a
ragged numpy gather puts the ids of whole batches together.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache, cached_property

import numpy as np

NO_MERGE, TABLE_BITS = 1 << 30, 20

#: Special strings of the vocabulary and their ids; they're found in raw text before it is normalised.
SPECIAL = {"<|startoftext|>": 49406, "<|endoftext|>": 49407}
SPECIALS = re.compile("|".join(map(re.escape, SPECIAL)))

#: Characters that str.split() takes for white space and Unicode's White_Space doesn't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _char_class(test: Callable[[str], bool]) -> str:
    """The code points that pass a test, as ranges for use in a pattern."""
    parts, start = [], None
    for cp in range(sys.maxunicode + 2):
        inside = cp <= sys.maxunicode and test(chr(cp))
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            parts.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(parts)


@cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """The word pattern and the white-space pattern, spelled with explicit classes for the standard library's engine."""
    white = _char_class(lambda c: c.isspace() and c not in SEPARATORS)
    letter = _char_class(lambda c: unicodedata.category(c)[0] == "L")
    number = _char_class(lambda c: unicodedata.category(c)[0] == "N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{white}{letter}{number}]+"), re.compile(f"[{white}]+")


def chunks(text: str | None) -> list:
    """White-space-free pieces of the normalised text; a special string stands as its id."""
    if not text:
        return []
    if "<|" in text and (found := [m.span() for m in SPECIALS.finditer(text)]):
        out: list = []
        at = 0
        for a, b in found:
            out += chunks(text[at:a])
            out.append(SPECIAL[text[a:b]])
            at = b
        return out + chunks(text[at:])
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # lower() has a form for the end of words that a per-character mapping lacks
        text = text.replace("Σ", "σ")
    text = text.lower()
    if any(c in text for c in SEPARATORS):
        return [x for x in patterns()[1].split(text) if x]
    return text.split()


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Token strings, ids and merge ranks read from a tokenizer file."""

    def __init__(self, path: str):
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        self.path, self.ids, self.suffix = path, model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in SPECIAL.items()}

    @cached_property
    def _arrays(self) -> tuple:
        """First symbols by byte, and the merges as hash tables: pair of ids to (rank, merged id)."""
        inner = np.array([self.ids[x] for x in self.letters], np.int64)
        final = np.array([self.ids[x + self.suffix] for x in self.letters], np.int64)
        pairs = list(self.ranks)
        keys = np.array([self.ids[a] << 16 | self.ids[b] for a, b in pairs], np.uint64)
        made = np.array([self.ids[a + b] for a, b in pairs], np.int64)
        tables, left, k = [], np.arange(len(keys)), 0
        while len(left):
            factor = np.uint64((0x9E3779B97F4A7C15 + 2 * 0x5851F42D4C957F2D * k) % (1 << 64) | 1)
            slot = (keys[left] * factor) >> np.uint64(64 - TABLE_BITS)
            table = np.full(1 << TABLE_BITS, -1, np.int32)
            first = np.unique(slot, return_index=True)[1]
            table[slot[first]] = left[first]
            tables.append((factor, table))
            left, k = np.delete(left, first), k + 1
        return inner, final, keys, made, tables

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; NO_MERGE where there is none."""
        _, _, keys, _, tables = self._arrays
        pair = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        out = np.full(len(pair), NO_MERGE, np.int32)
        for factor, table in tables:
            at = table[(pair * factor) >> np.uint64(64 - TABLE_BITS)]
            hit = (at >= 0) & (keys[at] == pair)
            out[hit] = at[hit]
        return out

    def merge(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in a row, and each word's count.

        Each round merges, in every word that isn't finished, all places of the word's lowest-ranked pair.
        """
        inner, final, _, made, _ = self._arrays
        data = [w.encode() for w in words]
        n = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = inner[raw]
        last = np.cumsum(n) - 1
        ids[last[n > 0]] = final[raw[last[n > 0]]]
        word = np.repeat(np.arange(len(words)), n)
        rank = np.full(len(ids), NO_MERGE, np.int32)
        if len(ids) > 1:
            rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[:-1][word[:-1] != word[1:]] = NO_MERGE
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = least == NO_MERGE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, rank, least = ids[~over], word[~over], rank[~over], least[~over]
                if not len(ids):
                    break
            hit = rank == least
            at = np.flatnonzero(hit)
            # of touching places (the same symbol three times or more) every second one merges, from the left
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            here = at - np.arange(len(at))  # where the merged symbols stand afterwards
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for i in (here, here[here > 0] - 1):
                rank[i] = NO_MERGE
                j = i[i + 1 < len(ids)]
                j = j[word[j] == word[j + 1]]
                rank[j] = self._rank(ids[j], ids[j + 1])
        if not done_ids:
            return np.zeros(0, np.uint16), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint16), np.bincount(word, minlength=len(words))


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start[i], start[i] + 1, ..., for each i in turn."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


class ChunkTable:
    """Ids of the chunks met so far by this worker, at most ``limit`` of them between two batches.

    It's a memo with a fixed bound: when it is full it starts anew, and results don't depend on it.
    """

    def __init__(self, resolve: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.resolve, self.limit = resolve, limit
        self.clear()

    def clear(self) -> None:
        self.codes: dict = {}
        self.flat, self.start, self.length = np.zeros(1 << 20, np.uint16), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.known = self.used = 0

    def _room(self, name: str, n: int) -> None:
        a = getattr(self, name)
        if n > len(a):
            setattr(self, name, np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)]))

    def _learn(self, fresh: list) -> None:
        """Cut new chunks into words, resolve each distinct word once and note the chunks' ids."""
        find = patterns()[0].findall
        words: dict = {}
        of, counts = [], []
        for c in fresh:
            if isinstance(c, int) or c.isalpha():
                cut = (c,)
            elif c[-1] in ".," and c[:-1].isalpha():
                cut = (c[:-1], c[-1])
            else:
                cut = find(c)
            counts.append(len(cut))
            for w in cut:
                k = words.get(w)
                if k is None:
                    k = words[w] = len(words)
                of.append(k)
        special = [w for w in words if isinstance(w, int)]
        flat, n = self.resolve(["" if isinstance(w, int) else w for w in words])
        if special:
            at = np.array([words[w] for w in special])
            flat = np.insert(flat, (np.cumsum(n) - n)[at], special)
            n[at] = 1
        first = np.cumsum(n) - n
        of, counts = np.array(of, np.int64), np.array(counts, np.int64)
        flat = flat[ragged(first[of], n[of])]
        ends = np.concatenate([[0], np.cumsum(n[of])])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
        m = self.known + len(fresh)
        for name in ("start", "length"):
            self._room(name, m)
        self._room("flat", self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[self.known : m] = lengths
        self.start[self.known : m] = self.used + np.cumsum(lengths) - lengths
        self.known, self.used = m, self.used + len(flat)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has."""
        if len(self.codes) > self.limit:
            self.clear()
        per_text, codes = [], self.codes
        fresh: list = []
        for text in texts:
            cut = chunks(text)
            row = list(map(codes.get, cut))
            if None in row:
                for i, k in enumerate(row):
                    if k is None:
                        k = codes.get(c := cut[i])
                        if k is None:
                            k = codes[c] = len(codes)
                            fresh.append(c)
                        row[i] = k
            per_text.append(np.array(row, np.int64))
        if fresh:
            self._learn(fresh)
        every = np.concatenate(per_text) if per_text else np.zeros(0, np.int64)
        n = self.length[every]
        ends = np.concatenate([[0], np.cumsum(n)])
        text_ends = np.cumsum([0, *map(len, per_text)])
        return self.flat[ragged(self.start[every], n)], np.diff(ends[text_ends])


def portions(texts: Sequence[str | None], most_chars: int = 1 << 21):
    """(first, last) slices of about ``most_chars`` characters; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most_chars:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if len(texts) > first:
        yield first, len(texts)
