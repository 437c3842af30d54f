"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import collocations as col

SCHEMA = "doc_id bigint, text string, lang string, block string, word string, phrase string, n int, part int"


def plain(rows, least, longest, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for i in range(len(words)):
                for n in range(1, min(longest, len(words) - i) + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (i, j) != (0, len(p)) and a >= f[p[i:j]]}
        scored = []
        for p, a in cands.items():
            if p not in dropped:
                cut = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        out += [[lang, i, p.decode(), -a, x, y, totals[lang], -s] for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def got(df):
    return sorted([r[c] for c in COLUMNS] for r in df.collect())


def drawn(seed, texts):
    rng = random.Random(seed)
    words = ["the", "of", "a", "Ab", "aB", "é", "a\x01", "a\x00", "b\x85c", "|", "x", "ÿz", "long" * 50, "q\x1c"]
    sep = [" ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "!", "\r\n", "\x0b", "?:"]
    return [(i, "".join(rng.choice(words[: rng.randrange(2, len(words))]) + rng.choice(sep) for _ in range(rng.randrange(0, 120))), rng.choice(["en", "de", "", None])) for i in range(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "w", "p", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("least,top,sizes", [(3, 40, {"block_words": 300, "range_words": 100}), (10, 7, {"block_words": 5000, "range_words": 7}), (1, 500, {})])
def test_collocations_equal_plain_counting(spark, least, top, sizes):
    rows = drawn(least, 120) + [(500, None, "en"), (501, "", "en"), (502, " \t\n", None), (None, "the of a . the of a", None)] * 2
    want = plain(rows, least, 5, top)
    assert want and got(col.top_collocations(frame(spark, rows), least, 5, top, **sizes)) == want


def test_hot_words_and_repeated_texts(spark):
    rows = [(i, "hot hot hot hot hot hot hot a b c d e f", "en") for i in range(150)] + [(1, "word " * 30_000, "fr")]
    assert got(col.top_collocations(frame(spark, rows), block_words=2000, range_words=50)) == plain(rows, 100, 5, 2000)


def test_empty_tables_and_rare_words(spark):
    assert got(col.top_collocations(frame(spark, []))) == []
    assert got(col.top_collocations(frame(spark, [(1, "a few words", "en"), (2, None, None)]))) == []


def test_large_products_stay_exact(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 10**13, [10**12, 3 * 10**12], [10**12 + 7, 10**12])]
    [cut] = spark.createDataFrame(rows, "a bigint, n bigint, l array<bigint>, r array<bigint>").select(col._lowest_cut().alias("c"), F.lit(1)).collect()
    assert (cut["c"]["score"], cut["c"]["l"], cut["c"]["r"]) == min((1000 * 10**25 // (x * y), x, y) for x, y in zip(*rows[0][2:], strict=True))


def test_transducers_unite_and_compose():
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 4, (n, 5)) for n in (1, 50, 400)]
    for s in sets:
        s[:, 0] += 1
        s[np.cumsum(s == 0, axis=1) > 0] = 0
    made = [col.CountTransducer.from_sorted(*col.distinct_rows(s)) for s in sets]
    whole = col.CountTransducer.union([col.CountTransducer.from_bytes(t.to_bytes()) for t in made], 5)
    counts = Counter(tuple(r[:n]) for s in sets for r in s.tolist() for n in range(1, 6) if r[n - 1])
    found = {tuple(p[: d + 1]): int(w) for d, ws in enumerate(whole.weights) for p, w in zip(whole.paths(d, np.arange(len(ws)), 5).tolist(), ws, strict=True)}
    assert found == dict(counts)
    asked = np.array([[1, 2, 0, 0, 0], [1, 0, 0, 0, 0], [4, 3, 3, 3, 3], [9, 1, 0, 0, 0], [2, 1, 1, 1, 0]])
    rows, weights = whole.compose(col.CountTransducer.from_sorted(*col.distinct_rows(asked)), 5)
    assert {tuple(r): int(w) for r, w in zip(rows.tolist(), weights, strict=True)} == {tuple(r): counts.get(tuple(x for x in r if x), 0) for r in asked.tolist()}


def test_places_follow_the_order():
    rng = np.random.default_rng(8)
    n = np.array([0, *rng.integers(1, 10**12, 60)], float)
    before = np.concatenate([[0], np.cumsum(n)[:-1]])
    rows = rng.integers(0, 61, (20_000, 5))
    rows[np.cumsum(rows == 0, axis=1) > 0] = 0
    rows, _ = col.distinct_rows(rows[rows[:, 0] > 0])
    where = col.places(rows, before, n, n.sum())
    assert (np.diff(where) >= 0).all() and where.max() <= n.sum()
