"""Personal data in texts: exact patterns, and a character-level BiLSTM with a CRF for what they miss.

The network reads characters in both directions; a linear chain with transition scores over its outputs
gives the tags. It is trained in numpy on labelled spans: those that the patterns find in a bounded sample,
and rewritten ones (numbers in other notations, addresses spelled out) set into texts of the sample. Long
texts are read in overlapping windows. Each window is decoded by Viterbi; of two windows that cover a
character, the one in which it is further from the edge decides, so spans are formed on the whole text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # place in KINDS, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from the others as well.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

# Symbols of the network: the characters from blank to tilde, line ends, other letters, the rest.
SYMBOLS = 95 + 3
HIDDEN = 8
TAGS = 1 + len(KINDS)
WINDOW, MARGIN, LANES = 256, 16, 2048
# More than the rounding of the sums along a window can come to.
ROUNDING = 0.25


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and without overlap for each kind; those that fail their test are dropped."""
    found: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            # Leading zeros, however many, do not count; without them a part has three digits at most.
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m.groups())):
                found.append((1, m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def symbols_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = (codes >= 0xC0) & (codes < 0x2000)
    return np.where((codes >= 32) & (codes < 127), codes - 32, np.where(codes == 10, 95, np.where(letters, 96, 97))).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass(frozen=True)
class Tagger:
    """Weights: inputs (2, SYMBOLS, 4H) and recurrence (2, H, 4H) per direction, output (2H, TAGS) and its bias, transitions."""

    inputs: np.ndarray
    recur: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray

    def tags(self, x: np.ndarray) -> np.ndarray:
        """Viterbi tags of windows: symbols (time, lanes) -> tags (time, lanes).

        The time axis is walked once per direction; a step works on all lanes. Halved gate weights make one
        tanh serve for all four gates.
        """
        steps, lanes = x.shape
        h = HIDDEN
        scale = np.r_[np.full(3 * h, 0.5), np.ones(h)].astype(np.float32)
        emissions = np.broadcast_to(self.bias.astype(np.float32)[:, None], (steps, TAGS, lanes)).copy()
        for way in (0, 1):
            table = np.ascontiguousarray((self.inputs[way] * scale).T.astype(np.float32))
            recur = np.ascontiguousarray((self.recur[way] * scale).T.astype(np.float32))
            out = np.ascontiguousarray(self.output[way * h : (way + 1) * h].T.astype(np.float32))
            state, cell = np.zeros((h, lanes), np.float32), np.zeros((h, lanes), np.float32)
            gates, pulled = np.empty((4 * h, lanes), np.float32), np.empty((4 * h, lanes), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                np.take(table, x[t], axis=1, out=pulled, mode="clip")  # the default mode copies by way of a buffer
                np.matmul(recur, state, out=gates)
                gates += pulled
                np.tanh(gates, out=gates)
                sigmoid = gates[: 3 * h]
                sigmoid *= 0.5
                sigmoid += 0.5
                cell *= gates[h : 2 * h]
                gates[:h] *= gates[3 * h :]
                cell += gates[:h]
                np.tanh(cell, out=state)
                state *= gates[2 * h : 3 * h]
                emissions[t] += out @ state
        tags = np.zeros((steps, lanes), np.uint8)
        moves = self.transitions.astype(np.float32)
        some = _in_doubt(emissions, moves)
        if len(some):
            tags[:, some] = _best_path(emissions[:, :, some], moves)
        return tags


def _in_doubt(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Lanes whose best path may have a tag other than 0: all but those in which no stretch of tags gains what it costs.

    A stretch costs the moves into and out of it, one of them at an end of the window, none if it fills the window.
    """
    stay, into, out_of = (m.max() - moves[0, 0] for m in (moves[1:, 1:], moves[0, 1:], moves[1:, 0]))
    gains = emissions[:, 1:].max(axis=1) - emissions[:, 0] + max(0.0, stay)
    stretch = best = gains[0]
    for gain in gains[1:]:
        stretch = np.maximum(stretch, 0) + gain
        best = np.maximum(best, stretch)
    return np.flatnonzero((best + max(into, out_of, into + out_of) > -ROUNDING) | (gains.sum(axis=0) > -ROUNDING))


def _best_path(emissions: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi: emissions (time, tags, lanes) and transitions -> tags (time, lanes)."""
    steps, _, lanes = emissions.shape
    score = emissions[0].copy()
    back = np.empty((steps, TAGS, lanes), np.uint8)
    for t in range(1, steps):
        best = score[0] + moves[0][:, None]
        came = back[t]
        came[:] = 0
        for k in range(1, TAGS):
            other = score[k] + moves[k][:, None]
            better = other > best
            np.copyto(best, other, where=better)
            np.copyto(came, np.uint8(k), where=better)
        best += emissions[t]
        score = best
    tags = np.empty((steps, lanes), np.uint8)
    each = np.arange(lanes)
    tags[-1] = score.argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t][tags[t], each]
    return tags


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (negative log likelihood per window) and gradients on a batch: symbols and tags (time, lanes)."""
    steps, lanes = x.shape
    h, each = HIDDEN, np.arange(x.shape[1])
    runs = []
    hidden = np.zeros((steps, lanes, 2 * h))
    for way in (0, 1):
        order = range(steps) if way == 0 else range(steps - 1, -1, -1)
        state, cell, kept = np.zeros((lanes, h)), np.zeros((lanes, h)), {}
        for t in order:
            z = p["inputs"][way][x[t]] + state @ p["recur"][way]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            kept[t] = (i, f, o, g, before, squashed, last)
            hidden[t, :, way * h : (way + 1) * h] = state
        runs.append((order, kept))
    emit = hidden @ p["output"] + p["bias"]
    move = p["transitions"]
    forward = np.empty((steps, lanes, TAGS))
    forward[0] = emit[0]
    for t in range(1, steps):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, :, None] + move, axis=1) + emit[t]
    total = np.logaddexp.reduce(forward[-1], axis=1)
    backward = np.zeros((steps, lanes, TAGS))
    d_move = np.zeros_like(move)
    for t in range(steps - 2, -1, -1):
        onward = emit[t + 1] + backward[t + 1]
        backward[t] = np.logaddexp.reduce(move + onward[:, None, :], axis=2)
        d_move += np.exp(forward[t][:, :, None] + move + onward[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(d_move, (y[t], y[t + 1]), -1.0)
    d_emit = np.exp(forward + backward - total[:, None])
    gold = np.zeros(lanes)
    for t in range(steps):
        gold += emit[t][each, y[t]] + (move[y[t - 1], y[t]] if t else 0)
        d_emit[t][each, y[t]] -= 1
    g = {"transitions": d_move, "bias": d_emit.sum(axis=(0, 1)), "output": np.einsum("tbh,tbk->hk", hidden, d_emit), "inputs": np.zeros_like(p["inputs"]), "recur": np.zeros_like(p["recur"])}
    d_hidden = d_emit @ p["output"].T
    for way, (order, kept) in enumerate(runs):
        d_state, d_cell = np.zeros((lanes, h)), np.zeros((lanes, h))
        for t in reversed(list(order)):
            i, f, o, c, before, squashed, last = kept[t]
            d_state = d_state + d_hidden[t, :, way * h : (way + 1) * h]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            dz = np.concatenate([d_cell * c * i * (1 - i), d_cell * before * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - c**2)], axis=1)
            np.add.at(g["inputs"][way], x[t], dz)
            g["recur"][way] += last.T @ dz
            d_state, d_cell = dz @ p["recur"][way].T, d_cell * f
    return float((total - gold).mean()), {k: v / lanes for k, v in g.items()}


def fit_tagger(windows: list[tuple[str, list[Span]]], epochs: int = 12, batch: int = 128, rate: float = 0.02, seed: int = 3) -> Tagger:
    """Train on texts of equal use with their labelled spans; shorter ones are filled up with line ends."""
    rng = np.random.default_rng(seed)
    steps = max(len(t) for t, _ in windows)
    x = np.full((len(windows), steps), 95, np.int64)
    y = np.zeros((len(windows), steps), np.int64)
    for i, (text, spans) in enumerate(windows):
        x[i, : len(text)] = symbols_of(text)
        for kind, start, end in spans:
            y[i, start:end] = kind + 1
    h = HIDDEN
    p = {
        "inputs": rng.normal(0, 0.3, (2, SYMBOLS, 4 * h)), "recur": rng.normal(0, 0.3, (2, h, 4 * h)), "output": rng.normal(0, 0.3, (2 * h, TAGS)),
        "bias": np.zeros(TAGS), "transitions": 2.0 * np.eye(TAGS),
    }
    p["inputs"][:, :, h : 2 * h] += 1.0
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, planned = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            _, g = _gradients(p, x[some].T, y[some].T)
            step += 1
            norm = np.sqrt(sum((a**2).sum() for a in g.values()))
            for k in p:
                a = g[k] * min(1.0, 5.0 / (norm + 1e-12))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a**2
                p[k] -= rate * (1 - 0.9 * step / planned) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Tagger(**{k: a.astype(np.float32) for k, a in p.items()})


def _invented(rng: random.Random) -> tuple[int, str]:
    """A labelled span in a notation that the patterns may miss."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    kind = rng.randrange(4)
    if kind == 0:
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" @ ", ".")])
        return 0, f"{name()}{rng.choice(['', '.' + digits(2), '_' + name()])}{at}{name()}{rng.choice(['', dot + name()])}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    if kind == 1:
        return 1, rng.choice([".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = rng.choice("3456") + digits(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        gap = rng.choice(["", " ", "-", "."])
        return 2, gap.join(number[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return 3, rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"00{rng.randint(10, 99)} {a} {b}{c}", f"+{rng.randint(1, 99)} {a} {b} {c}"])


def training_windows(texts: list[str], size: int = 96, each: int = 1200, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Labelled windows: around spans of the texts, rewritten spans set into the texts, and windows without any."""
    rng = random.Random(seed)
    found, plain = [], []
    for text in texts:
        spans = sorted(base_spans(text), key=lambda s: s[1])
        for kind, start, end in spans[:20]:
            lo = max(0, start - rng.randint(8, size // 2))
            inside = [(k, s - lo, min(e, lo + size) - lo) for k, s, e in spans if s >= lo and s < lo + size]
            found.append((text[lo : lo + size], inside))
        for _ in range(3):
            lo = rng.randrange(max(1, len(text) - size))
            if not any(s < lo + size and e > lo for _, s, e in spans):
                plain.append(text[lo : lo + size])
    rng.shuffle(found)
    rng.shuffle(plain)
    plain = plain or ["the and of to in is it. No one knows, or so they say.\nA line of words 12 and 3,400 more."]
    windows = found[:each]
    for i in range(each):
        kind, span = _invented(rng)
        host = plain[i % len(plain)]
        at = host.find(" ", rng.randrange(max(1, len(host) // 2))) + 1
        windows.append((f"{host[:at]}{span} {host[at:]}"[:size], [(kind, at, min(size, at + len(span)))]))
    # Numbers that are nobody's: years, amounts, serials; and text as it is.
    for i in range(each):
        host = plain[i % len(plain)]
        at = host.find(" ", rng.randrange(max(1, len(host) // 2))) + 1
        other = rng.choice([str(rng.randint(1, 10**rng.randint(1, 9))), f"{rng.randint(1, 999)},{rng.randint(100, 999)}", f"{rng.randint(1, 9)}.{rng.randint(1, 99)}", f"{rng.getrandbits(80):x}", f"AKIA{rng.getrandbits(60):X}", ""])
        windows.append((f"{host[:at]}{other} {host[at:]}"[:size], []))
    return windows


PLAUSIBLE = {
    0: lambda s: bool(re.search(r"@|\bat\b", s)) and bool(re.search(r"\.|\bdot\b", s)),
    1: lambda s: len(p := re.findall("[0-9]+", s)) == 4 and all(len(x) < 4 and int(x) <= 255 for x in p),
    2: lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d),
    3: lambda s: 7 <= len(re.sub("[^0-9]", "", s)) <= 15 and len(s) <= 24,
}

# What a span needs to pass: an at sign, a digit, or "at" as a word of its own, of which one end may be that of the span.
EVIDENCE = re.compile(r"[0-9@]|at(?:\b|(?<!\wat))")


def more_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the decoded tags that pass a test of their kind and touch no span of the patterns."""
    where = np.flatnonzero(tags)
    if not len(where):
        return []
    cuts = np.flatnonzero((np.diff(where) > 1) | (np.diff(tags[where].astype(int)) != 0)) + 1
    out = []
    for run in np.split(where, cuts):
        start, end, kind = int(run[0]), int(run[-1]) + 1, int(tags[run[0]]) - 1
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))
        if start < end and PLAUSIBLE[kind](text[start:end]) and not any(s < end and start < e for _, s, e in base):
            out.append((kind, start, end))
    return out


def tag_texts(texts: list[str], tagger: Tagger, evidence: re.Pattern[str] | None = None) -> list[np.ndarray]:
    """Tags of whole texts, from overlapping windows.

    With `evidence` every run of tags that holds a match of it is found whole: the windows with a match are
    decoded, and from there on each neighbour that a run of tags leads into. The tags of the others stay 0.
    """
    lengths = [len(t) for t in texts]
    flat = symbols_of("".join(texts))
    first = np.cumsum([0, *lengths])
    stride = WINDOW - 2 * MARGIN
    windows = np.array([(i, at, min(WINDOW, n - at)) for i, n in enumerate(lengths) for at in range(0, max(1, n - 2 * MARGIN), stride) if n], np.int64).reshape(-1, 3)
    of, at, sizes = windows.T
    begin = first[of] + at
    # What a window decides: up to the next one's part, so the parts of all windows cover the texts without a gap.
    low = begin + np.where(at > 0, MARGIN, 0)
    high = begin + sizes - np.where(at + sizes < np.array(lengths, np.int64)[of], MARGIN, 0)
    tags = np.zeros(len(flat), np.uint8)

    def decode(chosen: np.ndarray) -> None:
        # Windows of like length share a matrix, so short texts are not filled up to the full window.
        order = chosen[np.argsort(sizes[chosen], kind="stable")]
        for lo in range(0, len(order), LANES):
            some = order[lo : lo + LANES]
            place = begin[some] + np.arange(int(sizes[some].max()))[:, None]
            x = np.where(place < begin[some] + sizes[some], flat[np.minimum(place, len(flat) - 1)], 95)
            decoded = tagger.tags(x)
            own = (place >= low[some]) & (place < high[some])
            tags[place[own]] = decoded[own]

    wanted, done = np.ones(len(windows), bool), np.zeros(len(windows), bool)
    if evidence is not None:
        met = np.array([(start + m.start(), start + m.end() - 1) for start, text in zip(first, texts, strict=False) for m in evidence.finditer(text)], np.int64)
        wanted[:] = False
        wanted[np.searchsorted(low, met.ravel(), side="right") - 1] = True
    while wanted.any():
        decode(np.flatnonzero(wanted))
        done |= wanted
        inner = of[1:] == of[:-1]
        wanted[:] = False
        wanted[:-1] |= inner & done[1:] & (tags[low[1:]] > 0)
        wanted[1:] |= inner & done[:-1] & (tags[low[1:] - 1] > 0)
        wanted &= ~done
    return [tags[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _find(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    for batch in batches:
        keys, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        lo, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text)
            if chars >= WINDOW * LANES or i == len(texts) - 1:
                rows = []
                for t, tags in zip(texts[lo : i + 1], tag_texts(texts[lo : i + 1], tagger, EVIDENCE), strict=True):
                    base = base_spans(t)
                    spans = [(*s, True) for s in base] + [(*s, False) for s in more_spans(t, tags, base)]
                    rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in sorted(spans)])
                yield pa.RecordBatch.from_arrays([keys.slice(lo, i + 1 - lo), pa.array(rows, kind)], names=["doc_id", "spans"])
                lo, chars = i + 1, 0


def train_tagger(docs: DataFrame, sample: int = 1500, chars: int = 20_000) -> Tagger:
    """A tagger from at most `sample` texts with a digit or an at sign, those with the least checksum of their doc_id.

    Of a sampled text the first `chars` characters are used for training. All texts are tagged whole later.
    """
    marked = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select(F.crc32(F.concat(F.lit("private:"), F.col("doc_id").cast("string"))).alias("order"), "doc_id")
    # The ids are chosen first: of each task only ids go to the driver, and then the sampled texts.
    chosen = marked.distinct().orderBy("order", "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("order", "doc_id", F.substring("text", 1, chars).alias("text")).toPandas()
    return fit_tagger(training_windows(rows.sort_values(["order", "doc_id", "text"])["text"].tolist()))


def find_private(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id and spans of each whole text, by kind then start; code points, end exclusive; `base` marks those of the patterns.

    Null and empty texts have no spans. Rows are read one by one, without a shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(partial(_find, tagger=tagger), "doc_id bigint, spans array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")


def private_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int) -> Column:
        # The lambda has one parameter: Spark would fill a second one with the place in the array.
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
