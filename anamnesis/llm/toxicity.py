"""Operator 5, toxicity by noisy-channel deobfuscation.

A character language model (trigrams of letters, counted over the whole corpus) says
how likely a string is. Suspicious tokens - with digits or signs among letters,
with letters repeated three times or more, or spelled out with spaces - become lattices:
each character may stand for itself, for the letters that it imitates, for a mere
separator, or for one more copy of the letter before it. Viterbi decoding picks the
likeliest reading under channel and language model, and the restored text is what is
scored.

The score is a noisy-or over words, and over beginnings of words that come several times,
whose share of toxic documents is high, with a share that is shrunk towards the base
rate. Such a feature counts only if it was seen after enough different words, so
that copies of one toxic document teach nothing. Features that come together share their
evidence, so the noisy-or says too much of one that stands alone. A monotone step
function turns it into the share of toxic documents among those with such evidence. It
is fitted on evidence by weights from the other folds, so no document vouches for itself.

Labels are learned from at most ``sample`` toxic and as many other labelled documents; nothing else is capped.

Defined results: null, empty and blank texts get the base score; repeated rows are
scored each on its own; a token may have any length; a null id is never learned from; labels that are null or
unknown are ignored; without toxic labels every score is the base score; empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import materialise

#: The letters of the language model. Place 0 is a word's edge, the last place any other character.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëìíîïñòóôöøœùúûüýÿß"
EDGE, OTHER, SIZE = 0, len(LETTERS) + 1, len(LETTERS) + 2

#: Letters that signs and digits imitate.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i", "(": "c", "<": "c", "*": "aeiou",
}

#: Signs that separate letters without meaning any.
SEPARATORS = set(".-_*~'`^\"/\\,:;")

#: Letters of beginnings of words, how often they must come, and the folds of the calibration.
BEGINNINGS, LEVELS, FOLDS = (4, 5), (2, 3), 4

#: Costs of the channel, as negative natural logarithms.
IMITATION, SEPARATION, REPETITION = 0.7, 1.0, 1.0

#: Positions after which a decoder settles what all its paths share.
SETTLE = 16_384

EDGES = "".join(set("#%&*.,;:!?\"'()[]{}<>|/\\-_~`^=+“”«»¿¡…$@"))
SPELLED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€])(?:[ \t]+(?:[^\W_]|[@$!|+€])){2,}(?!\S)")
TRIPLED = re.compile(r"([^\W\d_])\1\1")


@cache
def _places() -> np.ndarray:
    table = np.full(0x180, OTHER, np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    for c in (9, 10, 11, 12, 13, 32):
        table[c] = EDGE
    return table


def places(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _places()[np.where(points < 0x180, points, 0x17F)]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): letters' trigrams over all texts. There are at most SIZE ** 3 grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    p = np.concatenate([[0, 0], places(text.lower()), [0]])
                    total += np.bincount((p[:-2] * SIZE + p[1:-1]) * SIZE + p[2:], minlength=SIZE**3) if len(p) > 1 << 14 else 0
                    if len(p) <= 1 << 14:
                        np.add.at(total, (p[:-2] * SIZE + p[1:-1]) * SIZE + p[2:], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    return docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Trail:
    """Back pointers of a decoder: for each state of each position, the state before it and the place of the letter added (0: none)."""

    def __init__(self):
        self.before, self.added, self.ends = array("H"), array("B"), array("Q")

    def add(self, came) -> None:
        for i, p in came:
            self.before.append(i)
            self.added.append(p)
        self.ends.append(len(self.before))

    def text(self, state: int, positions: int | None = None) -> str:
        """What the path to a state of the last position, or of the one before ``positions``, has spelled."""
        before, added, ends, out = self.before, self.added, self.ends, []
        for k in range((len(ends) if positions is None else positions) - 1, -1, -1):
            at = (ends[k - 1] if k else 0) + state
            if added[at]:
                out.append(LETTERS[added[at] - 1])
            state = before[at]
        return "".join(reversed(out))

    def settle(self, states: int) -> str:
        """The text up to the last position at which all paths to ``states`` states meet; it is dropped from the trail."""
        alive = set(range(states))
        for k in range(len(self.ends) - 1, -1, -1):
            if len(alive) == 1:
                found, cut = self.text(alive.pop(), k + 1), self.ends[k]
                self.before, self.added = self.before[cut:], self.added[cut:]
                self.ends = array("Q", (e - cut for e in self.ends[k + 1 :]))
                return found
            start = self.ends[k - 1] if k else 0
            alive = {self.before[start + i] for i in alive}
        return ""


class Channel:
    """The decoder: trigram costs and the lattice of readings."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        n = np.zeros(SIZE**3)
        n[grams] = counts
        n = n.reshape(SIZE, SIZE, SIZE)
        two = n.sum(0)
        one = (two.sum(0) + 1) / (two.sum() + SIZE)
        second = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
        third = (n + 20 * second[None]) / (n.sum(2, keepdims=True) + 20)
        self.cost = (-np.log(third)).astype(np.float32)
        self.flat = self.cost.ravel().tolist()
        self.place = {c: i + 1 for i, c in enumerate(LETTERS)}
        self.readings: dict[str, list[tuple[int, float]]] = {c: [(p, 0.0)] for c, p in self.place.items()}
        for c, letters in IMITATES.items():
            self.readings.setdefault(c, []).extend((self.place[x], IMITATION) for x in letters)

    def decode(self, token: str) -> str:
        """The likeliest reading of a lower-case token without white space.

        A state is the last two places, as one number. Each position keeps, for each of its states, which state before
        it came from and the letter that it added; texts are read from these once, at the end. Every ``SETTLE`` positions
        what all paths share is read and forgotten. So time is linear in the token's length, and memory is small unless paths
        never meet (a few bytes a position and state then).
        """
        states, trail, settled, limit = {EDGE: 0.0}, Trail(), [], SETTLE
        cost, readings = self.flat, self.readings
        for c in token:
            own = readings.get(c)
            if own is None:  # an unknown sign costs all states the same and changes none
                skipped = SEPARATION * (1 if c in SEPARATORS else 6)
                states = {s: value + skipped for s, value in states.items()}
                continue
            skipped = SEPARATION if c in SEPARATORS else None
            after: dict[int, float] = {}
            came: dict[int, tuple[int, int]] = {}
            for i, (s, value) in enumerate(states.items()):
                row, last = s * SIZE, s % SIZE
                for p, noise in own:
                    t, v = last * SIZE + p, value + noise + cost[row + p]
                    if t not in after or v < after[t]:
                        after[t], came[t] = v, (i, p)
                    if p == last:
                        v = value + noise + REPETITION
                        if s not in after or v < after[s]:
                            after[s], came[s] = v, (i, 0)
                if skipped is not None:
                    v = value + skipped
                    if s not in after or v < after[s]:
                        after[s], came[s] = v, (i, 0)
            states = after
            trail.add(came.values())
            if len(trail.ends) > limit:
                settled.append(trail.settle(len(states)))
                limit = 2 * len(trail.ends) + SETTLE  # paths that never meet are not walked again and again
        final = [value + cost[s * SIZE + EDGE] for s, value in states.items()]
        least = min(final)
        return "".join(settled) + min(trail.text(i) for i, value in enumerate(final) if value == least)

    def read(self, chunk: str) -> str:
        """A chunk as it is scored: without signs at its edges, decoded if it looks disguised."""
        if chunk.isalpha():
            return self.decode(chunk) if TRIPLED.search(chunk) else chunk
        word = chunk.strip(EDGES)
        if word.isalpha() and not TRIPLED.search(word) and (word == chunk or not any(c in IMITATES for c in chunk.replace(word, ""))):
            return word
        if not any(c.isalpha() for c in chunk):
            return word
        whole = chunk.strip(".,;:?\"'()[]{}<>")
        return self.decode(whole) if any(c in IMITATES or c in SEPARATORS for c in whole) and len(word) > 2 else word

    def restore(self, text: str) -> str:
        """The text with spelled-out words closed up and disguised tokens decoded, in lower case."""
        text = SPELLED.sub(lambda m: self.decode("".join(m[0].split())), text.lower())
        return " ".join(map(self.read, text.split()))


class Reader:
    """Words of restored texts, with a bounded memo of chunks."""

    def __init__(self, channel: Channel, limit: int = 300_000):
        self.channel, self.limit, self.memo = channel, limit, {}

    def _spelled(self, letters: str) -> str:
        """A spelled-out run, also without a letter at either end, which may be a word of its own."""
        return " ".join(map(self.channel.decode, (letters, letters[1:], letters[:-1])))

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.lower()
        if SPELLED.search(text):
            text = SPELLED.sub(lambda m: self._spelled("".join(m[0].split())), text)
        memo, out = self.memo, []
        if len(memo) > self.limit:
            memo.clear()
        for c in text.split():
            w = memo.get(c)
            if w is None:
                w = self.channel.read(c)
                if len(c) <= 64:  # so the memo is bounded in bytes too
                    memo[c] = w
            out.append(w)
        return out


def fit_channel(docs: DataFrame, text_col: str = "text") -> Channel:
    rows = trigram_counts(docs, text_col).toPandas()
    return Channel(rows.gram.to_numpy(np.int64), rows.n.to_numpy(np.int64))


def features(words: list[str]) -> dict[str, str]:
    """What a text can be told by, each with the word before its first occurrence.

    These are its words of three letters or more, and beginnings of words (four and five letters, marked by ^) that
    come ``LEVELS`` times: a beginning that means nothing by itself may come once by chance, but seldom again.
    """
    out: dict[str, str] = {}
    counts: Counter = Counter()
    for before, w in zip(["", *words], words):
        if len(w) > 2:
            out.setdefault(w, before)
        for n in BEGINNINGS:
            if len(w) >= n:
                f = f"^{w[:n]}"
                counts[f] += 1
                if counts[f] in LEVELS:
                    out[f"{f}{counts[f]}"] = before
    return out


def family(feature: str) -> str:
    """Features that begin alike tell the same thing, so only the best of them counts."""
    return feature[1:5] if feature[0] == "^" else feature[:4]


class Model:
    """Toxic features with their probabilities, the base score, the channel and the steps of calibration."""

    def __init__(self, channel: Channel, weights: dict[str, float], base: float):
        self.channel, self.weights, self.base, self.memo = channel, weights, base, {}
        self.edges, self.levels = np.zeros(0), np.zeros(0)
        self.begun = {f[:-1] for f in weights if f[0] == "^"}

    def evidence(self, found) -> float | None:
        """The noisy-or over features, of which a family's best one counts; None if none has a weight."""
        best: dict[str, float] = {}
        for f in found:
            p = self.weights.get(f, 0.0)
            if p > best.get(of := family(f), 0.0):
                best[of] = p
        clear = 1.0
        for p in sorted(best.values()):
            clear *= 1.0 - p
        return 1.0 - clear if best else None

    def _marks(self, word: str) -> list[str] | None:
        """The word if it has a weight, and its beginnings that may come to have one."""
        if len(self.memo) > 300_000:
            self.memo.clear()
        found = [word] if word in self.weights else []
        found += [f for n in BEGINNINGS if len(word) >= n and (f := f"^{word[:n]}") in self.begun]
        if len(word) <= 64:
            self.memo[word] = found or None
        return found or None

    def weighted(self, words: list[str]) -> set[str]:
        """Those of the text's features that have a weight."""
        memo, out, counts = self.memo, set(), Counter()
        for w in words:
            marks = memo[w] if w in memo else self._marks(w)
            for f in marks or ():
                if f[0] == "^":
                    counts[f] += 1
                    f = f"{f}{counts[f]}"
                if f in self.weights:
                    out.add(f)
        return out

    def score(self, words: list[str]) -> float:
        raw = self.evidence(self.weighted(words))
        if raw is None:
            return self.base
        k = int(np.searchsorted(self.edges, raw, "right")) - 1
        if k >= 0:
            level = self.levels[k]
        else:  # less evidence than any document had that was learned from
            level = min([raw, *self.levels[:1]])
        # the evidence itself orders documents of one step
        return max(self.base, 0.999 * float(level) + 0.001 * raw)


def fit(
    docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 20_000, least_share: float = 0.6, least_contexts: int = 5, prior: float = 4.0,
) -> Model:
    """Learn from the labelled documents for which the column ``learn(id)`` is true."""
    channel = fit_channel(docs, text_col)
    given = labels.where(F.col(label_col).isin(0, 1) & learn(F.col(id_col))).groupBy(id_col).agg(F.max(label_col).alias("y"))
    given = materialise(given.join(docs.select(id_col).distinct(), id_col, "left_semi"), "labels")
    sizes = {r.y: r["count"] for r in given.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Model(channel, {}, 0.0)
    base = toxic / (toxic + clean)
    # at most ``sample`` ids of each class
    chosen = [given.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(sample) for y in (1, 0)]
    taught = docs.select(id_col, text_col).join(F.broadcast(chosen[0].union(chosen[1])), id_col)
    # equal texts share a fold
    taught = taught.select(F.col("y").cast("int").alias("y"), F.pmod(F.xxhash64(text_col), F.lit(FOLDS)).cast("int").alias("fold"), text_col)
    read = materialise(_read(taught, channel), "labelled-features")
    up, down = toxic / min(toxic, sample), clean / max(1, min(clean, sample))
    weights = _weights(read, up, down, prior, base, least_share, least_contexts)
    model = Model(channel, weights[FOLDS], min(base, 0.1) / 4)
    model.edges, model.levels = _calibration(_histogram(read, weights[:FOLDS]), up, down, prior, base)
    return model


def _read(taught: DataFrame, channel: Channel) -> DataFrame:
    """(y, fold, found array<struct<feature, before>>) of documents (y, fold, text): all that is learned from, read once."""
    shared = taught.sparkSession.sparkContext.broadcast(channel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            start, names, befores, ends = 0, [], [], []
            for i, (y, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                found = features(reader.words(text))
                names += found.keys()
                befores += found.values() if y else [""] * len(found)
                ends.append(len(names))
                if len(names) > 200_000 or i == batch.num_rows - 1:
                    pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(befores, pa.string())], ["feature", "before"])
                    lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pairs)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i + 1 - start), batch.column(1).slice(start, i + 1 - start), lists], ["y", "fold", "found"])
                    start, names, befores, ends = i + 1, [], [], []

    return taught.mapInArrow(run, "y int, fold int, found array<struct<feature:string, before:string>>")


def _weights(read: DataFrame, up: float, down: float, prior: float, base: float, least_share: float, least_contexts: int) -> list[dict[str, float]]:
    """For each fold the features' probabilities by the other folds, and at last those by all.

    Only features of ``least_share`` and more leave Spark; their number is bounded by the sample of toxic documents.
    """
    each = read.select("y", "fold", F.explode("found").alias("x")).select("y", "fold", "x.feature", "x.before")
    in_fold = [(F.col("fold") == k).cast("long") for k in range(FOLDS)]
    pairs = each.where("y = 1").groupBy("feature", "before").agg(*(F.sum(x).alias(f"a{k}") for k, x in enumerate(in_fold)))
    every = sum(F.col(f"a{k}") for k in range(FOLDS))
    hits = pairs.groupBy("feature").agg(*(F.sum(f"a{k}").alias(f"a{k}") for k in range(FOLDS)), *(F.count_if(every > (F.col(f"a{k}") if k < FOLDS else 0)).alias(f"contexts{k}") for k in range(FOLDS + 1)))
    others = each.where("y = 0").groupBy("feature").agg(*(F.sum(x).alias(f"b{k}") for k, x in enumerate(in_fold)))
    both = hits.where(f"contexts{FOLDS} >= {least_contexts}").join(others, "feature", "left").na.fill(0)
    a, b = (sum(F.col(f"{c}{k}") for k in range(FOLDS)) for c in "ab")
    shares = []
    for k in range(FOLDS + 1):
        mine, its = (a - F.col(f"a{k}"), b - F.col(f"b{k}")) if k < FOLDS else (a, b)
        share = (mine * up + prior * base) / (mine * up + its * down + prior)
        shares.append(F.when((F.col(f"contexts{k}") >= least_contexts) & (share >= least_share), F.least(share, F.lit(0.99))).alias(f"p{k}"))
    found = both.select("feature", *shares).where(F.coalesce(*(F.col(f"p{k}") for k in range(FOLDS + 1))).isNotNull()).collect()
    return [{r.feature: r[f"p{k}"] for r in found if r[f"p{k}"] is not None} for k in range(FOLDS + 1)]


def _histogram(read: DataFrame, weights: list[dict[str, float]], bins: int = 1000) -> list[tuple[float, int, int]]:
    """(least evidence, toxic documents, other documents) of each bin of evidence, by the weights of each document's fold."""
    shared = read.sparkSession.sparkContext.broadcast(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, seen = [Model(None, w, 0.0) for w in shared.value], Counter()
        for batch in batches:
            lists = batch.column(2)
            names, ends = lists.flatten().field(0).to_pylist(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for y, fold, start, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0, *ends], ends):
                raw = models[fold].evidence(names[start:end])
                if raw is not None:
                    seen[y, int(raw * bins)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b for _, b in seen], pa.int32()), pa.array([n if y else 0 for (y, _), n in seen.items()], pa.int64()), pa.array([0 if y else n for (y, _), n in seen.items()], pa.int64())], ["bin", "a", "b"])

    found = read.mapInArrow(count, "bin int, a long, b long").groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return sorted((r.bin / bins, r.a, r.b) for r in found)


def _calibration(histogram: list[tuple[float, int, int]], up: float, down: float, prior: float, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges and levels of rising steps: neighbouring bins are pooled until the share of toxic documents rises."""
    pools: list[list[float]] = []
    for edge, a, b in histogram:
        pools.append([edge, a * up, b * down])
        while len(pools) > 1 and pools[-2][1] * sum(pools[-1][1:]) >= pools[-1][1] * sum(pools[-2][1:]):
            _, a, b = pools.pop()
            pools[-1][1] += a
            pools[-1][2] += b
    levels = [(a + prior * base) / (a + b + prior) for _, a, b in pools]
    return np.array([p[0] for p in pools]), np.maximum.accumulate(np.array(levels)) if levels else np.zeros(0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): from 0 to 1, higher for likelier toxic texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of trigrams, and words bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.channel)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(reader.words(t)) for t in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def scorer(spark, model: Model):
    """A column function: the score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(shared.value.channel)
        for texts in batches:
            yield pd.Series([shared.value.score(reader.words(t)) for t in texts], dtype=float)

    return run


def restore(docs: DataFrame, channel: Channel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): restored texts; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(channel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.restore(t or "") for t in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
