"""Toxicity of texts whose words may be disguised.

A disguised word is taken as sent through a noisy channel: letters became digits or signs, were repeated,
or were set apart. Each such word gives a lattice of what its characters may have been; the best path under
the channel and a character language model of the whole corpus restores it (Viterbi). The restored text is
then scored by word features learned from labels.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import settle, whole_text

# What a sign may stand for. A letter stands for itself.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
    "€": "e", "£": "l", "¥": "y", "(": "c", "<": "c", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "к": "k", "м": "m", "т": "t",
}
APART = set(".-_*~'’·:/\\,")
HIDDEN = re.compile("[­​-‏⁠﻿]")
SPACED = re.compile(r"(?<![^\s])[^\s](?: [^\s]){2,}(?![^\s])")
# The end of every match of SPACED; as it begins with a blank, it is looked for at blanks only.
SPACED_END = re.compile(r" [^\s] [^\s](?![^\s])")
ENDS = re.compile(r"^[\W_]+(?=[@$!|+(<€£][^\W_])|^[^\w@$!|+(<€£]+|^[\W_]+(?![^\W_])|[\W_]+$")
PLAIN = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"(.)\1")
LONG_RUN = re.compile(r"(.)\1\1")
SIGN_LETTERS = frozenset(c for c in SIGNS if c.isalpha())
# Costs (negative logarithms) of the channel: a sign read as a letter or left alone, a letter repeated, letters set apart.
AS_LETTER, AS_SIGN, REPEATED, DOUBLED, SET_APART = 1.0, 8.0, 1.0, 2.0, 0.5

# The alphabet of the language model: 0 is the edge of a word, 1 to 26 are a to z, then the letters from
# U+00DF to U+00FF; what is left is one symbol.
ALPHABET = 27 + 33 + 1
CACHE_WORDS = 200_000
SPACED_LETTERS = 12


def symbol(char: str) -> int:
    code = ord(char)
    if 97 <= code <= 122:
        return code - 96
    if 0xDF <= code <= 0xFF:
        return 27 + code - 0xDF
    return ALPHABET - 1 if char.isalnum() else 0


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of symbols per task, each with its count."""
    table = np.array([symbol(chr(i)) for i in range(0x250)], np.int32)
    counts = np.zeros(ALPHABET**3, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            text = " ".join(batch.column(0).slice(at, 512).to_pylist()).lower()
            codes = np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)
            s = np.where(codes < 0x250, table[np.minimum(codes, 0x24F)], np.where(codes == 0x3000, 0, ALPHABET - 1))
            counts += np.bincount((s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:], minlength=ALPHABET**3)
    grams = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.int32()), pa.array(counts[grams], pa.int64())], names=["gram", "n"])


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Negative log probabilities of a symbol after two others, from the trigrams of all texts.

    The table is bounded by the alphabet (227 thousand entries), whatever the corpus; it is added up on the
    executors. Trigrams back off to bigrams and symbols by interpolation.
    """
    rows = docs.select(whole_text(text).alias("text")).mapInArrow(_count_trigrams, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(ALPHABET**3)
    three[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    three = three.reshape((ALPHABET,) * 3)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + ALPHABET)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (three + 20 * p2[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3).astype(np.float32)


def lattice(word: str, halve: bool = True) -> Iterator[list[tuple[str, float]]]:
    """Readings of each place of a word with their costs: letters, pairs of letters, or nothing.

    `halve` says whether a pair of equal letters may stand for one."""
    i, n = 0, len(word)
    while i < n:
        c = word[i]
        j = i + 1
        while j < n and word[j] == c:
            j += 1
        run = j - i
        if c in APART and 0 < i and j < n:
            yield [("", SET_APART * run), (c, AS_SIGN)]
        else:
            readings = [(r, AS_LETTER) for r in SIGNS.get(c, "")] + [(c, AS_SIGN if c in SIGNS or not c.isalpha() else 0.0)]
            if run == 1:
                yield readings
            else:
                once = [(r, cost + (REPEATED if run > 2 else DOUBLED)) for r, cost in readings]
                twice = [(r + r, cost + (REPEATED if run > 2 else 0.0)) for r, cost in readings]
                yield once + twice if halve or run > 2 else twice
        i = j


def restore(word: str, model: np.ndarray, halve: bool = True) -> str:
    """The likeliest original of a word: the cheapest path through its lattice, each state two symbols of context.

    Of paths of equal cost the one found first stays. Paths are chains of readings, so a word of any length
    takes time in proportion to it.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in lattice(word, halve):
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letters, channel in readings:
                x, y, total = a, b, cost + channel
                for letter in letters:
                    s = symbol(letter)
                    total += float(model[x, y, s])
                    x, y = y, s
                held = best.get((x, y))
                if held is None or total < held[0]:
                    best[(x, y)] = (total, (path, letters))
        states = best
    path = min(((cost + float(model[a, b, 0]), (a, b), path) for (a, b), (cost, path) in states.items()), key=lambda f: f[:2])[2]
    parts: list[str] = []
    while path is not None:
        path, letters = path
        parts.append(letters)
    return "".join(reversed(parts))


def clean(text: str) -> str:
    """Lower case, compatibility forms, nothing invisible."""
    if not text.isascii():
        if not is_normalized("NFKC", text):
            text = normalize("NFKC", text)
        text = HIDDEN.sub("", text)
    return text.lower()


def readings_of(token: str, model: np.ndarray) -> tuple[str, ...]:
    """What a token is scored as: itself without punctuation around it and, if its lattice has several paths, the restored word
    (with pairs of letters halved where that is likelier, and with all of them kept)."""
    core = ENDS.sub("", token)
    if not core:
        return ()
    if PLAIN.fullmatch(core) and (core.isascii() or SIGN_LETTERS.isdisjoint(core)):
        # Every letter has one reading: a lattice without runs has one path, and one with pairs only has two readings for pairs alone.
        if not RUN.search(core):
            return (core,)
        if not LONG_RUN.search(core):
            return tuple(dict.fromkeys((core, restore(core, model))))
    return tuple(dict.fromkeys((core, restore(core, model), restore(core, model, halve=False))))


def spaced_words(text: str) -> list[str]:
    """Letters set apart by single spaces, joined: from each of them on, SPACED_LETTERS of them at most.

    Features of a word reach over eight letters, so a longer piece would add nothing but its own name; a run of
    any length gives work in proportion to it.
    """
    if not SPACED_END.search(text):
        return []
    return [joined[i : i + SPACED_LETTERS] for run in SPACED.findall(text) for joined in [run.replace(" ", "")] for i in range(len(joined) - 2)]


def features_of(word: str) -> list[str]:
    """Features of a word: itself and its beginnings of 4 to 8 letters."""
    return ["=" + word, *("^" + word[:n] for n in range(4, 9) if len(word) >= n)]


@dataclass(frozen=True)
class Scorer:
    """Language model, feature weights and intercept of a logistic regression."""

    model: np.ndarray
    weights: dict[str, float]
    base: float

    @cached_property
    def begun(self) -> frozenset[str]:
        """What the features with a weight begin with."""
        return frozenset(f[1:n] for f in self.weights for n in range(1, len(f) + 1))

    def may_bring(self, core: str) -> bool:
        """Whether a path through the lattice of a word has a feature with a weight. Nearly no word has one, and only these are restored."""
        paths = {""}
        for readings in lattice(core):
            paths = {p + letters for p in paths for letters, _ in readings}
            # A reading has two letters at most.
            if any("^" + p in self.weights or "^" + p[:-1] in self.weights for p in paths):
                return True
            paths &= self.begun
            if not paths:
                return False
        return any("=" + p in self.weights for p in paths)

    def features(self, token: str) -> tuple[str, ...]:
        """The features with a weight that a token brings."""
        core = token if token.isalpha() else ENDS.sub("", token)
        if core.isalpha() and (core.isascii() or SIGN_LETTERS.isdisjoint(core)):
            # All readings begin alike if there is no pair of letters in the beginning, and without any pair there is one reading.
            if core[:4] not in self.begun and not RUN.search(core[:4]):
                return ()
            if not RUN.search(core):
                return tuple(f for f in features_of(core) if f in self.weights)
        if core not in self.begun and not self.may_bring(core):
            return ()
        return tuple({f for reading in readings_of(token, self.model) for f in features_of(reading) if f in self.weights})

    def score(self, found: set[str]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.base + sum(sorted(self.weights[f] for f in found))))))


def fit_features(
    names: list[str], marks: list[str], labels: list[int], features: list[np.ndarray], least: float = 3.0, precision: float = 0.6, ridge: float = 0.01, steps: int = 400, sure: float = 8.0
) -> tuple[dict[str, float], float]:
    """Weights of features and the intercept, from texts as places of their features in `names`, with labels.

    Texts with equal marks are copies and share one vote, so the words of a text that was copied often do not
    look toxic because it was. Features that `least` toxic votes have, and that are right at least `precision`
    of the time, enter a logistic regression with a ridge, fitted by gradient steps over all of them. As toxic
    words keep company, the ridge splits their weight; a feature with `sure` toxic votes and less than one in
    32 against it gets at least the weight that it deserves alone.
    """
    if len(set(labels)) < 2:
        return {}, (math.log(99.0) if labels and labels[0] else -math.log(99.0))
    y, sizes = np.array(labels, float), Counter(marks)
    votes = np.array([1 / sizes[m] for m in marks])
    row = np.repeat(np.arange(len(features), dtype=np.int32), [len(f) for f in features])
    column = np.concatenate(features).astype(np.int32, copy=False)
    toxic = np.bincount(column, (votes * y)[row], len(names))
    harmless = np.bincount(column, (votes * (1 - y))[row], len(names))
    used = np.flatnonzero((toxic >= least) & (toxic >= precision * (toxic + harmless)))
    place = np.full(len(names), -1, np.int32)
    place[used] = np.arange(len(used))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    toxic, harmless = toxic[used], harmless[used]
    w, b = np.zeros(len(used)), math.log((votes @ y + 0.5) / (votes @ (1 - y) + 0.5))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, w[column], len(y)))))
        error = votes * (p - y)
        slope = np.r_[np.bincount(column, error[row], len(used)) + ridge * w, error.sum()]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    alone = np.where((toxic >= sure) & (32 * harmless < toxic), np.log((toxic + 0.5) / (harmless + 0.5)) - b, -np.inf)
    return {names[f]: float(x) for f, x in zip(used, np.maximum(w, alone), strict=True)}, float(b)


def held_out(key: Column) -> Column:
    """Rows whose labels are kept for testing."""
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def _sample_features(batches: Iterator[pa.RecordBatch], model: np.ndarray, names: dict[str, int] | None) -> Iterator[pa.RecordBatch]:
    """Label, mark (the three least word checksums) and features of sampled texts: all of them as strings, or the places of those in `names`."""
    for batch in batches:
        marks, features = [], []
        for text in batch.column("text").to_pylist():
            text = clean(text)
            words = {r for t in {*text.split(), *spaced_words(text)} for r in readings_of(t, model)}
            marks.append(",".join(map(str, sorted(zlib.crc32(w.encode()) for w in words)[:3])))
            found = {f for w in words for f in features_of(w)}
            features.append(sorted(found) if names is None else sorted(names[f] for f in found if f in names))
        kind = pa.list_(pa.string() if names is None else pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(marks), pa.array(features, kind)], names=["toxic", "mark", "features"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, least: float = 3.0) -> Scorer:
    """A scorer from the labels that are not held out.

    The language model is counted over all texts. The features are fitted to at most `sample` labelled rows,
    those with the least checksum of their doc_id; labels of 0 and 1 in any proportion. Features that occur in
    toxic texts of the sample often enough are gathered first; then the driver gets of each text which of
    them it has. Without both labels every text gets the same score.
    """
    model = character_model(docs)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = usable.orderBy(F.crc32(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string"))), "doc_id", "toxic").limit(sample)
    rows = settle(docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))
    listed = rows.where("toxic = 1").mapInArrow(partial(_sample_features, model=model, names=None), "toxic int, mark string, features array<string>")
    voted = listed.withColumn("vote", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("mark"))).select("vote", F.explode("features").alias("feature"))
    names = sorted(voted.groupBy("feature").agg(F.sum("vote").alias("votes")).where(F.col("votes") >= least - 1e-9).select("feature").toPandas()["feature"])
    places = {f: i for i, f in enumerate(names)}
    found = rows.mapInArrow(partial(_sample_features, model=model, names=places), "toxic int, mark string, features array<int>")
    given = found.select("mark", "toxic", "features").toArrow()
    lists = given.column("features").combine_chunks()
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    texts = sorted(((mark, label, flat[a:b]) for mark, label, a, b in zip(given.column("mark").to_pylist(), given.column("toxic").to_pylist(), ends[:-1], ends[1:], strict=True)), key=lambda t: (t[0], t[1], t[2].tobytes()))
    weights, base = fit_features(names, [t[0] for t in texts], [t[1] for t in texts], [t[2] for t in texts], least)
    return Scorer(model, weights, base)


def _scores(texts: list[str | None], scorer: Scorer, known: dict[str, tuple[str, ...]]) -> list[float]:
    """Scores of texts; `known` keeps the features of words between calls, up to CACHE_WORDS of them."""
    scores = []
    for text in texts:
        text = clean(text or "")
        words = set(text.split())
        new = words.difference(known)
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = words
        for word in new:
            known[word] = scorer.features(word)
        found = {f for features in filter(None, map(known.__getitem__, words)) for f in features}
        found.update(f for word in set(spaced_words(text)) for f in scorer.features(word))
        scores.append(scorer.score(found))
    return scores


def _score(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        scores = _scores(batch.column("text").to_pylist(), scorer, known)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def _keep_harmless(batches: Iterator[pa.RecordBatch], scorer: Scorer, threshold: float, text: str) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[str, ...]] = {}
    for batch in batches:
        yield batch.filter(pa.array([s < threshold for s in _scores(batch.column(text).to_pylist(), scorer, known)], pa.bool_()))


def drop_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores below `threshold`."""
    return docs.mapInArrow(partial(_keep_harmless, scorer=scorer, threshold=threshold, text=text), docs.schema)


def score_texts(docs: DataFrame, scorer: Scorer, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each text.

    Scores come from the text alone. Null and empty texts get the score of a text without features. Rows are
    scored one by one, without a shuffle; a null doc_id is not held out.
    """
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).mapInArrow(partial(_score, scorer=scorer), "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
