"""Toxicity scores from a subsequence string-kernel SVM with Nyström landmarks.

The kernel of two strings counts their common subsequences of ``ORDER``
characters, each weighted by a decay for every character it skips, so an
insult stays recognisable with characters inserted between its own.  A
Nyström map on landmark strings turns the kernel into finite features, a
linear SVM is trained there on sentences, and the learnt combination of
landmarks folds into one weight per subsequence.  Scoring a text then is a
table lookup per subsequence of a short span; the text's value is its best
stretch of up to ``STRETCH`` characters, so any length of text is read whole.

Labels are per document, examples are sentences.  Every sentence of a clean
document is a negative; in a toxic document the sentence with the best stretch
is the positive, which is chosen again after each training round.  A sentence
stands in the machine by its best stretch, at first by the stretch around its
most telling word, in clean ones around any word.  Negatives beyond the first are those sentences that the
last round left inside the margin, as the others add nothing to the loss.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotide.llm.common import append_columns, quoted, rows_about

#: Kernel: characters in a subsequence, characters it may span, decay for each one skipped.
ORDER, SPAN, DECAY = 4, 7, 0.75
#: Longest stretch that is scored as one, in characters.
STRETCH = 20
#: Letters with a code of their own, and codes that all other letters, digits and signs of any script share by
#: code point; 1 stands for white space, 0 for punctuation, which is skipped.
LETTERS, SHARED = 40, 6
SIZE = LETTERS + SHARED + 2
LANDMARKS, ROUNDS, COST = 256, 4, 20.0
#: Sentences of clean documents that the first round takes, and most that a later one adds (the worst ones).
FIRST_NEGATIVES, MORE_NEGATIVES = 4000, 4000
#: Lengths of the word pieces by which the first positives are found.
PIECES = (5, 7)
#: Labelled documents of each class that training takes at most.
TRAIN_DOCUMENTS = 2000
#: A sentence ends at a line break, or after . ! or ? before white space (so i.d.i.o.t is in one).
_END = re.compile(r"(?<=[.!?])\s+|\n")
#: Ranges of code points read as punctuation beyond ASCII, and white space.
PUNCTUATION = [(0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x3000, 0x303F), (0xFE00, 0xFE0F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F)]
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _offsets() -> list[tuple[tuple[int, ...], float]]:
    """How far before its last character a subsequence's others lie, and its weight."""
    out = []

    def extend(back: tuple[int, ...]) -> None:
        if len(back) == ORDER - 1:
            out.append((back[::-1], DECAY ** (back[-1] - ORDER + 1)))
            return
        for d in range(back[-1] + 1 if back else 1, SPAN):
            extend((*back, d))

    extend(())
    return out


OFFSETS = _offsets()
POWERS = SIZE ** np.arange(ORDER - 1, -1, -1)


@dataclass
class Model:
    """What scoring needs: codes of characters, a weight per subsequence, and the calibration."""

    codes: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def encode(self, text: str) -> np.ndarray:
        """Codes of the letters and of single boundaries between words.

        Punctuation is left out, and so are the boundaries in a run of single
        letters: i.d.i.o.t and i d i o t read as one word.
        """
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[points].astype(np.int32)
        codes = codes[codes > 0]
        codes = codes[(codes > 1) | (np.concatenate([[0], codes[:-1]]) != 1)]
        wide = np.concatenate([[1, 1], codes, [1, 1]])
        return codes[(codes > 1) | (wide[:-4] > 1) | (wide[4:] > 1) | (wide[1:-3] == 1) | (wide[3:-1] == 1)]


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of all subsequences in a short encoded string that hold no other-character."""
    found, weights = [], []
    n = len(codes)
    for back, weight in OFFSETS:
        if n <= back[0]:
            continue
        parts = [codes[back[0] - d : n - d] for d in (*back, 0)]
        index = sum(p * int(w) for p, w in zip(parts, POWERS, strict=True))
        keep = np.logical_and.reduce([p > 0 for p in parts])
        found.append(index[keep])
        weights.append(np.full(int(keep.sum()), weight, np.float32))
    return (np.concatenate(found), np.concatenate(weights)) if found else (np.zeros(0, np.int64), np.zeros(0, np.float32))


def stretches(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each position the value of the best stretch that ends there."""
    n = len(codes)
    gained = np.zeros(n, np.float32)
    codes = codes.astype(np.int32)
    heads: dict[tuple[int, ...], np.ndarray] = {}
    for back, weight in OFFSETS:
        if n <= back[0]:
            continue
        gap = tuple(b - back[-1] for b in back[:-1])
        if gap not in heads:  # all but the last character, ending at a position
            lead = gap[0]
            parts = [codes[lead - d : n - d] for d in (*gap, 0)]
            heads[gap] = sum(p * np.int32(w) for p, w in zip(parts, POWERS[:-1], strict=True))
        head = heads[gap][: n - back[0]]
        gained[back[0] :] += np.float32(weight) * weights[head + codes[back[0] :]]
    total = np.concatenate([[0.0], np.cumsum(gained, dtype=np.float64)])
    low, width = total.copy(), 1  # smallest running total of the last STRETCH positions
    while width < STRETCH:
        step = min(width, STRETCH - width)
        low[step:] = np.minimum(low[step:], low[:-step])
        width += step
    return (total[1:] - low[:-1]).astype(np.float32)


def _joined(parts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Encoded strings in one array, so far apart that no stretch reaches two, and where each begins."""
    gap = np.zeros(STRETCH + SPAN, np.int32)
    sizes = np.array([len(p) + len(gap) for p in parts], np.int64)
    return np.concatenate([x for p in parts for x in (p, gap)]), np.cumsum(sizes) - sizes


def best_each(parts: Sequence[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each encoded string the value of its best stretch, and where that ends."""
    tops, ends = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
    step = 1000
    for a in range(0, len(parts), step):
        joined, begins = _joined(parts[a : a + step])
        values = stretches(joined, weights)
        top = np.maximum.reduceat(values, begins)
        owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(joined))))
        at = np.flatnonzero(values == top[owner])
        _, first = np.unique(owner[at], return_index=True)
        tops[a : a + step], ends[a : a + step] = top, at[first] - begins
    return tops, ends


def score_texts(model: Model, texts: Sequence[str]) -> np.ndarray:
    """Scores of whole texts, 0 to 1."""
    if not len(texts):
        return np.zeros(0)
    joined, begins = _joined([model.encode(f" {t} ") for t in texts])
    top = np.maximum.reduceat(stretches(joined, model.weights), begins).astype(np.float64)
    return 1 / (1 + np.exp(-(model.slope * top + model.shift)))


# ---------------------------------------------------------------- training


def code_table(letters: Sequence[int]) -> np.ndarray:
    """The code of every code point: own ones for ``letters``, shared ones for all others but punctuation."""
    points = np.arange(0x110000)
    codes = (2 + LETTERS + points % SHARED).astype(np.uint8)
    codes[:0x80] = [2 + LETTERS + p % SHARED if chr(p).isalnum() else 0 for p in range(0x80)]
    for first, last in PUNCTUATION:
        codes[first : last + 1] = 0
    codes[WHITE] = 1
    codes[list(letters)] = np.arange(2, 2 + len(letters))
    return codes


def _alphabet(texts: Sequence[str]) -> np.ndarray:
    """The codes of the most frequent letters of ``texts``, in order of code point."""
    counts: Counter[str] = Counter()
    for text in texts:
        counts.update(text.lower())
    letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c.isalpha()][:LETTERS]
    return code_table(sorted(map(ord, letters)))


def sentences(text: str) -> list[str]:
    """The sentences of a text, blank ones left out."""
    return [s for s in map(str.strip, _END.split(text)) if s]


def _telling_words(documents: list[tuple[str, int]]) -> tuple[dict[int, list[str]], dict[str, str], Counter]:
    """For each toxic document its most telling words, each word's most telling piece, and counts of clean words."""
    counts = (Counter(), Counter())
    words = []
    clean: Counter[str] = Counter()
    for text, toxic in documents:
        own = set(re.findall(r"[^\W\d_]{3,}", text.lower()))
        words.append(own)
        counts[toxic].update({g for w in own for n in PIECES for g in _grams(f" {w} ", n)})
        if not toxic:
            clean.update(own)
    toxics = sum(t for _, t in documents)
    cleans = len(documents) - toxics

    def told(piece: str) -> float:
        """Log odds of a document with this piece, drawn towards none where few documents hold it."""
        a, b = counts[1][piece], counts[0][piece]
        return float((np.log((a + 0.5) / (toxics + 1)) - np.log((b + 0.5) / (cleans + 1))) * a / (a + 4))

    out = {}
    pieces: dict[str, str] = {}
    for k, (_, toxic) in enumerate(documents):
        if toxic:
            for w in words[k]:
                if w not in pieces:
                    pieces[w] = max((g for n in PIECES for g in _grams(f" {w} ", n)), key=lambda g: (told(g), g), default="")
            ranked = sorted((w for w in words[k] if pieces[w]), key=lambda w: (-told(pieces[w]), w))[:2]
            out[k] = [w for w in ranked if told(pieces[w]) > 0.7]
    return {k: v for k, v in out.items() if v}, pieces, clean


def _grams(word: str, n: int) -> list[str]:
    return [word[i : i + n] for i in range(max(0, len(word) - n + 1))]


class _Nystrom:
    """Kernel features of strings on landmarks: k(s, landmarks) times the root of the inverse Gram matrix."""

    def __init__(self, landmarks: Sequence[np.ndarray]):
        found = [subsequences(s) for s in landmarks]
        self.features = np.unique(np.concatenate([f for f, _ in found]))
        self.place = np.full(SIZE**ORDER, -1, np.int32)
        self.place[self.features] = np.arange(len(self.features))
        self.dense = np.zeros((len(self.features), len(landmarks)), np.float32)
        for k, (index, weight) in enumerate(found):
            np.add.at(self.dense[:, k], np.searchsorted(self.features, index), weight)
        self.dense /= np.maximum(np.linalg.norm(self.dense, axis=0), 1e-9)
        gram = self.dense.T.astype(np.float64) @ self.dense
        values, vectors = np.linalg.eigh(gram)
        keep = values > 1e-3 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])

    def __call__(self, strings: Sequence[np.ndarray]) -> np.ndarray:
        """Features of encoded strings, block by block."""
        if not len(strings):
            return np.zeros((0, self.root.shape[1]))
        out = np.zeros((len(strings), self.dense.shape[1]), np.float32)
        for a in range(0, len(strings), 128):
            part = strings[a : a + 128]
            codes = np.zeros((len(part), max(map(len, part)) + SPAN), np.int64)
            for k, own in enumerate(part):
                codes[k, : len(own)] = own
            n = codes.shape[1]
            for back, weight in OFFSETS:
                if n <= back[0]:
                    continue
                parts = [codes[:, back[0] - d : n - d] for d in (*back, 0)]
                whole = np.logical_and.reduce([p > 0 for p in parts])
                at = self.place[sum(p * int(w) for p, w in zip(parts, POWERS, strict=True))]
                row, column = np.nonzero(whole & (at >= 0))
                if len(row):
                    rows, first = np.unique(row, return_index=True)
                    out[a + rows] += np.float32(weight) * np.add.reduceat(self.dense[at[row, column]], first, axis=0)
        return out.astype(np.float64) @ self.root

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The weight of each subsequence in the learnt function."""
        out = np.zeros(SIZE**ORDER, np.float32)
        out[self.features] = self.dense @ (self.root @ w)
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by Newton steps on its active set."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(50):
        a = x1[active] * cost[active, None]
        w = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _calibration(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from values to label probabilities (Platt)."""
    mean, spread = values.mean(), values.std() + 1e-9
    x = np.stack([(values - mean) / spread, np.ones(len(values))], 1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (labels - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0] / spread), 1e-6), float(w[1] - w[0] * mean / spread)


def train(documents: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit on (text, label) rows.  Without rows of both labels the score is the share of label 1, at most 0.5."""
    codes = _alphabet([t for t, _ in documents])
    labels = np.array([y for _, y in documents], np.float64)
    if not 0 < labels.sum() < len(labels):
        share = min(0.5, float(labels.mean())) if len(labels) else 0.0
        return Model(codes, np.zeros(SIZE**ORDER, np.float32), 1e-6, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    model = Model(codes, np.zeros(SIZE**ORDER, np.float32), 1.0, 0.0)
    draw = np.random.Generator(np.random.PCG64(seed))
    told, pieces, clean = _telling_words(documents)
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))]
    insults = Counter(w for ws in told.values() for w in ws)
    telling = [w for w, _ in sorted(insults.items(), key=lambda x: (-x[1], x[0]))]
    alike: dict[str, list[str]] = {}
    for w in telling:
        alike.setdefault(pieces[w], []).append(w)
    groups = sorted(alike.values(), key=lambda ws: (-sum(insults[w] for w in ws), ws[0]))
    spread = [ws[k] for k in range(12) for ws in groups if k < len(ws)]
    others = [common[i] for i in sorted(draw.choice(len(common), min(LANDMARKS // 8, len(common)), replace=False))]
    encoded = lambda words: [model.encode(f" {w} ") for w in words]
    nystrom = _Nystrom(encoded(dict.fromkeys([*spread[: LANDMARKS * 3 // 4], *common[: LANDMARKS // 8], *others])))

    own = [sentences(t) for t, _ in documents]  # the examples: (document, sentence)
    doc_of = np.repeat(np.arange(len(own)), [len(x) for x in own])
    flat = [s for x in own for s in x]
    codes = encoded(flat)
    clean_ones = np.flatnonzero(labels[doc_of] == 0) if len(flat) else np.zeros(0, np.int64)

    def around(sentence: str, words: Sequence[str]) -> np.ndarray | None:
        """The stretch of the sentence around the first of ``words`` in it."""
        low = sentence.lower()
        hit = next((m for w in words if (m := re.search(rf"(?<![^\W\d_]){re.escape(w)}(?![^\W\d_])", low))), None)
        return model.encode(f" {low[hit.start() : hit.end()]} ") if hit else None

    positives: dict[int, list[np.ndarray]] = {}
    for k, words in told.items():
        for w in words:
            found = next((x for s in own[k] if w in s.lower() and (x := around(s, [w])) is not None), None)
            if found is not None:
                positives.setdefault(k, []).append(found)
    chosen = np.sort(draw.choice(clean_ones, min(FIRST_NEGATIVES, len(clean_ones)), replace=False)) if len(clean_ones) else clean_ones
    negatives = []
    for k in chosen.tolist():
        words = sorted(set(re.findall(r"[^\W\d_]{2,}", flat[k].lower())))
        negatives.append(around(flat[k], [words[int(draw.integers(len(words)))]]) if words else codes[k][:STRETCH])

    def spaced(words: list[str]) -> list[str]:
        """Words with one more letter or boundary among theirs, as insults are hidden."""
        out = []
        for k, w in enumerate(words):
            if 4 <= len(w) <= 12:
                at = 2 + k % (len(w) - 3)
                out += [f"{w[:at]}{w[at - 1]}{w[at:]}", f"{w[:at]} {w[at:]}", f"{w[:at]}x{w[at:]}"]
        return out

    frequent = [w for w in telling if insults[w] >= max(3, len(told) // 200)][:60]
    x_hidden = nystrom(encoded(spaced(frequent)))
    x_negative = nystrom([*negatives, *encoded(common[:400])])
    seen = {x.tobytes() for x in negatives}
    for _ in range(ROUNDS):
        if not positives:
            break
        held = [x for k in sorted(positives) for x in positives[k]]
        even = (len(x_negative) / len(positives)) ** 0.5
        weight = [even / len(positives[k]) for k in sorted(positives) for _ in positives[k]]
        x = np.vstack([nystrom(held), x_hidden, x_negative])
        y = np.r_[np.ones(len(held) + len(x_hidden)), -np.ones(len(x_negative))]
        cost = np.r_[np.array(weight), np.full(len(x_hidden), even / 2), np.ones(len(x_negative))]
        w, bias = _svm(x, y, COST * cost)
        model.weights = nystrom.folded(w)
        tops, ends = best_each(codes, model.weights)
        piece = lambda i: codes[i][max(0, int(ends[i]) - STRETCH + 1) : int(ends[i]) + 1]
        order = np.lexsort((np.arange(len(tops)), -tops, doc_of))
        for i in order[np.unique(doc_of[order], return_index=True)[1]].tolist():
            if doc_of[i] in positives and len(piece(i)):
                positives[int(doc_of[i])] = [piece(i)]
        worst = clean_ones[tops[clean_ones] + bias > -1]
        fresh = []
        for i in worst[np.argsort(-tops[worst], kind="stable")].tolist():
            if piece(i).tobytes() not in seen:
                seen.add(piece(i).tobytes())
                fresh.append(piece(i))
                if len(fresh) == MORE_NEGATIVES:
                    break
        if fresh:
            x_negative = np.vstack([x_negative, nystrom(fresh)])
    values = np.concatenate([best_each([model.encode(f" {t} ")], model.weights)[0] for t, _ in documents])
    model.slope, model.shift = _calibration(values, labels)
    return model


# ---------------------------------------------------------------- Spark


def labelled(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> DataFrame | None:
    """(doc_id, text, toxic): at most about ``limit`` labelled documents of each class, whole texts.

    Rows whose crc32 of the doc_id as text leaves 1 when divided by 3 are held
    out and never read here; rows without label or doc_id neither.  Which
    rows are taken is decided by a hash of the doc_id.  None without any.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for toxic, rows in sorted(counts.items()):
        part = rows_about(known.where(F.col("toxic") == toxic), F.col("doc_id"), limit, rows)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return None
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by limit
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")  # one text for a repeated id


def _in_order(table: pa.Table) -> list[tuple[str, int]]:
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["toxic"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
    return [(text or "", int(toxic)) for _, text, toxic in rows]


def trained(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Model:
    """The model of the labelled documents, fitted in one task on the bounded sample; only weights reach the driver."""
    sample = labelled(documents, labels, limit)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        model = train(_in_order(pa.Table.from_batches(parts)) if parts else [])
        at = np.flatnonzero(model.weights)
        row = (model.codes.tobytes(), at.tobytes(), model.weights[at].tobytes(), model.slope, model.shift)
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["codes", "at", "weights", "slope", "shift"])

    got = sample.repartition(1).mapInArrow(fit, "codes binary, at binary, weights binary, slope double, shift double").collect() if sample is not None else []
    if not got:
        return train([])
    weights = np.zeros(SIZE**ORDER, np.float32)
    weights[np.frombuffer(bytes(got[0]["at"]), np.int64)] = np.frombuffer(bytes(got[0]["weights"]), np.float32)
    return Model(np.frombuffer(bytes(got[0]["codes"]), np.uint8), weights, got[0]["slope"], got[0]["shift"])


def toxicity(documents: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` and ``score`` (0 to 1), one row for each row.

    Every text is read whole.  An empty or null text gets the score of a text
    without any telling stretch.  An input column named like ``score`` is replaced.
    """
    codes, slope, shift = model.codes, model.slope, model.shift
    at = np.flatnonzero(model.weights)
    values = model.weights[at]
    held: dict[str, Model] = {}

    def kernel(texts: list[str]) -> list[pa.Array]:
        if "model" not in held:
            weights = np.zeros(SIZE**ORDER, np.float32)
            weights[at] = values
            held["model"] = Model(codes, weights, slope, shift)
        return [pa.array(score_texts(held["model"], texts), pa.float64())]

    return append_columns(documents, text, [T.StructField(score, T.DoubleType())], kernel, 1 << 20)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row's label is kept for testing; false without a key."""
    return F.coalesce(F.crc32(quoted(key).cast("string")) % 3 == 1, F.lit(False))
