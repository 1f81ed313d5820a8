"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

Texts become sequences of words, lower-cased and without punctuation.  An
item is cut into windows of at most WINDOW words; of the edits that it may
differ by, one window has its share at most.  The CGK random walk copies a
window into a sequence of up to three times its length, staying on a word or
stepping on as a random function of the word and the step says; few edits
between two windows then leave few places different.  A repetition samples
some places of the walk and looks the words there up among those of the items'
windows.  Repetitions are added until simulated windows with all their edits,
in several patterns, meet their originals with the target probability; there
is no other bound on their number.  Every meeting is verified by the exact
edit distance of the whole item, computed bit-parallel around the place.

Windows of documents are walked only where enough words and pairs of words
are those of items: an edit changes one word and two pairs at most, so this
drops no match.  A match starts at a word that some item holds: one of fewest
edits always can.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotide.llm.common import Lookup, append_columns, checkpoint, joined_words, mixed, quoted

#: Two passages are alike if at least this share of an item's words stays unedited.
SIMILARITY = 0.8
#: Words in a window at most, places of a walk that one repetition samples, share of simulated matches to be found.
WINDOW, SAMPLED, TARGET_RECALL = 20, 3, 0.999
#: Simulated matches of each pattern of edits.
TRIALS = 2000
#: Bytes of item text that one pass over the documents holds in every executor.
ITEM_BLOCK_BYTES = 16 << 20

LEAKS = T.ArrayType(
    T.StructType(
        [
            T.StructField("item_id", T.LongType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("item_words", T.IntegerType()),
            T.StructField("start_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
        ]
    ),
    containsNull=False,
)
_LEAKS_ARROW = pa.list_(
    pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("item_words", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64())])
)


_END = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Repetition:
    places: list[int]
    seeds: np.ndarray
    #: For each sampled place the keys that items have so far; the last maps to windows.
    prefixes: list[np.ndarray]
    keys: np.ndarray
    windows: np.ndarray


@dataclass
class Band:
    """Windows of nearly one length, and the repetitions that find them."""

    width: int
    edits: int
    items: np.ndarray
    places: np.ndarray
    repetitions: list[Repetition]


@dataclass
class Plan:
    ids: list[int]
    words: list[np.ndarray]
    masks: list[dict[int, int]]
    known: Lookup
    pairs: Lookup
    bands: list[Band]


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of so many words may differ by."""
    return int(words * (1 - similarity) + 1e-9)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """One hash for the ``length`` words from each start."""
    key = hashes[starts]
    for k in range(1, length):
        key = mixed(key) + hashes[starts + k]
    return mixed(key)


def embed(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, rep: Repetition, look: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Walk from every start and return the starts that still meet an item, and their keys.

    With ``look`` false all starts are kept, as for the items themselves.
    """
    at = starts.copy()
    alive = np.arange(len(starts))
    key = np.zeros(len(starts), np.uint64)
    sampled = 0
    for step in range(rep.places[-1] + 1):
        inside = at < ends
        word = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], _END)
        if step == rep.places[sampled]:
            key = mixed(key ^ word)
            if look:
                seen = rep.prefixes[sampled]
                keep = np.flatnonzero(seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] == key)
                if not len(keep):
                    return alive[:0], key[:0]
                at, ends, key, alive, word = at[keep], ends[keep], key[keep], alive[keep], word[keep]
            sampled += 1
        at += ((word ^ rep.seeds[step]) * (rep.seeds[step] | np.uint64(1)) >> np.uint64(63)).astype(np.int64)
    return alive, key


def repetition(draw: np.random.Generator, width: int) -> Repetition:
    length = max(1, 2 * width - 2)
    places = sorted(draw.choice(length, min(SAMPLED, length), replace=False).tolist())
    return Repetition(places, draw.integers(1, 1 << 63, length + 1, dtype=np.uint64), [], np.zeros(0, np.uint64), np.zeros(0, np.int64))


def edited(draw: np.random.Generator, words: list[int], edits: int, pattern: str) -> list[int]:
    """``words`` with so many edits: anywhere, evenly spread, together inside, or at the start."""
    fresh = lambda: int(draw.integers(1, 1 << 63))
    copy = list(words)
    if pattern == "dropped":
        return copy[edits:]
    for k in range(edits):
        kind = int(draw.integers(0, 3)) if pattern == "anywhere" else 0
        at = {"replaced": k, "inside": len(words) // 3 + k, "spread": (2 * k + 1) * len(words) // (2 * edits)}.get(pattern, int(draw.integers(0, len(copy))))
        copy[at : at + (kind != 1)] = [fresh()] if kind < 2 else []
    return copy


PATTERNS = ("anywhere", "spread", "replaced", "inside", "dropped")


@functools.lru_cache(maxsize=64)
def repetitions(width: int, edits: int, recall: float, seed: int) -> tuple[Repetition, ...]:
    """Repetitions (without items) until matches with all ``edits`` are found in the share ``recall``, for every pattern.

    A match stands among other words and is found by any start that is at most
    ``edits`` words off its own, as in a document.
    """
    draw = np.random.Generator(np.random.PCG64([seed, width, edits]))
    if not edits:
        return (repetition(draw, width),)
    strange = lambda n: draw.integers(1, 1 << 63, n, dtype=np.uint64)
    length = 2 * width + 6 * edits
    own = strange(len(PATTERNS) * TRIALS * width)
    copies = strange(len(PATTERNS) * TRIALS * length)
    for k in range(len(PATTERNS) * TRIALS):
        copy = edited(draw, own[k * width : (k + 1) * width].tolist(), edits, PATTERNS[k // TRIALS])
        copies[k * length + 2 * edits : k * length + 2 * edits + len(copy)] = copy
    starts = np.arange(len(PATTERNS) * TRIALS) * width
    around = (np.arange(len(starts)) * length)[:, None] + 2 * edits + np.arange(-edits, edits + 1)
    found = np.zeros(len(starts), bool)
    out = []
    while found.reshape(len(PATTERNS), -1).mean(1).min() < recall:
        rep = repetition(draw, width)
        key = embed(own, starts, starts + width, rep, False)[1]
        met = embed(copies, around.ravel(), around.ravel() + width, rep, False)[1].reshape(around.shape)
        found |= (met == key[:, None]).any(1)
        out.append(rep)
    return tuple(out)


def index(rep: Repetition, words: np.ndarray, starts: np.ndarray, width: int) -> Repetition:
    """``rep`` with the keys of the windows of ``words`` from ``starts``."""
    prefixes = [np.unique(embed(words, starts, starts + width, Repetition(rep.places[: k + 1], rep.seeds, [], rep.keys, rep.windows), False)[1]) for k in range(len(rep.places))]
    key = embed(words, starts, starts + width, rep, False)[1]
    order = np.argsort(key, kind="stable")
    return Repetition(rep.places, rep.seeds, prefixes, key[order], order)


def build_plan(ids: Sequence[int], texts: Sequence[str], similarity: float = SIMILARITY, recall: float = TARGET_RECALL, seed: int = 11) -> Plan:
    """Hash the items, cut them into windows, and index these in as many repetitions as the target recall takes.

    Items without a word are never found.  Items of fewer than 1 / (1 -
    similarity) words allow no edit.
    """
    hashes, begins = joined_words([t.lower().encode() for t in texts])
    words = [hashes[begins[k] : begins[k + 1]] for k in range(len(texts))]
    kept = [k for k in range(len(texts)) if len(words[k])]
    ids, words = [ids[k] for k in kept], [words[k] for k in kept]
    masks = []
    cut: list[tuple[int, int, int, int]] = []
    for k, own in enumerate(words):
        mask: dict[int, int] = {}
        for i, w in enumerate(own.tolist()):
            mask[w] = mask.get(w, 0) | 1 << i
        masks.append(mask)
        parts = -(-len(own) // WINDOW)
        edges = [len(own) * i // parts for i in range(parts + 1)]
        cut += [(b - a, allowed(len(own), similarity) // parts, k, a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    first = np.cumsum([0, *map(len, words)])
    groups: list[list[tuple[int, int, int, int]]] = []
    for window in sorted(cut):
        if not groups or window[0] > groups[-1][0][0] * 1.25 or window[0] < 5:
            groups.append([])
        groups[-1].append(window)
    bands = []
    for group in groups:
        width, edits = group[0][0], max(w[1] for w in group)
        items, places = np.array([w[2:] for w in group], np.int64).T
        reps = [index(rep, flat, first[items] + places, width) for rep in repetitions(width, edits, recall, seed)]
        bands.append(Band(width, edits, items, places, reps))
    inner = np.ones(len(flat), bool)
    inner[first[1:] - 1] = False
    return Plan(list(ids), words, masks, Lookup(flat), Lookup(run_hashes(flat, np.flatnonzero(inner), 2)), bands)


def prefix_distance(mask: dict[int, int], size: int, text: Sequence[int], limit: int) -> tuple[int, int]:
    """Smallest edit distance between a whole item and a beginning of ``text``, and where that ends.

    Myers' bit-parallel columns in Hyyrö's form, with a first row that counts
    up, so the match is anchored at the start.  The shorter beginning wins ties.
    """
    full = (1 << size) - 1
    top = 1 << (size - 1)
    plus, minus, score = full, 0, size
    found, end = size, 0
    for j, word in enumerate(text):
        same = mask.get(word, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if score < found:
            found, end = score, j + 1
            if not found:
                break
        if score - (len(text) - j - 1) > limit and found > limit:
            break
    return found, end


def nearest_ends(mask: dict[int, int], size: int, text: Sequence[int]) -> tuple[int, list[int]]:
    """Smallest edit distance between a whole item and any stretch of ``text``, and where such stretches end."""
    full = (1 << size) - 1
    top = 1 << (size - 1)
    plus, minus, score = full, 0, size
    found, ends = size, []
    for j, word in enumerate(text):
        same = mask.get(word, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full  # a match may start anywhere
        down = (down << 1) & full
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        if score < found:
            found, ends = score, []
        if score == found:
            ends.append(j + 1)
    return found, ends


def stretches(plan: Plan, hashes: np.ndarray, begins: np.ndarray, held: np.ndarray, similarity: float) -> list[tuple[int, int, int, int]]:
    """(row, item, from, to): where windows of the item say that it may stand, joined where they meet."""
    row_of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    ends_of = begins[1:][row_of]
    count = np.concatenate([[0], np.cumsum(held)])
    both = np.zeros(len(held) + 1, bool)  # a pair of words of items, both in one text
    at = np.flatnonzero(held[:-1] & held[1:] & (row_of[:-1] == row_of[1:]))
    both[at] = plan.pairs.ids(run_hashes(hashes, at, 2)) >= 0
    pairs = np.concatenate([[0], np.cumsum(both)])
    # a match or its window holds a word of items; every start up to the edits before one is looked at
    found = []
    for band in plan.bands:
        reach = np.minimum(np.arange(len(hashes)) + band.width + band.edits, ends_of)
        good = (count[reach] - count[:-1] >= band.width - band.edits) & (pairs[np.maximum(reach - 1, 0)] - pairs[:-2] >= band.width - 1 - 2 * band.edits)
        starts = np.flatnonzero(good)
        if not len(starts):
            continue
        stops = np.minimum(starts + band.width, ends_of[starts])
        for rep in band.repetitions:
            alive, key = embed(hashes, starts, stops, rep)
            low, high = np.searchsorted(rep.keys, key, "left"), np.searchsorted(rep.keys, key, "right")
            window = rep.windows[np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())]
            met = np.repeat(starts[alive], high - low)
            found.append((row_of[met], band.items[window], met - band.places[window]))
    if not sum(len(x[0]) for x in found):
        return []
    row, item, at = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((at, item, row))
    row, item, at = row[order], item[order], at[order]
    sizes = np.array([len(w) for w in plan.words], np.int64)
    margin = 2 * np.array([allowed(n, similarity) for n in sizes.tolist()], np.int64)[item]  # edits before the window, and its start
    low = np.maximum(at - margin, begins[row])
    high = np.minimum(at + sizes[item] + margin, begins[row + 1])
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(row)) - 1
    return list(zip(row[heads].tolist(), item[heads].tolist(), low[heads].tolist(), high[tails].tolist(), strict=True))


def find(plan: Plan, texts: Sequence[str], similarity: float = SIMILARITY) -> list[list[dict]]:
    """For each text the items found in it: the match of fewest edits, the first of those."""
    out: list[dict[int, tuple]] = [{} for _ in texts]
    if not plan.words:
        return [[] for _ in texts]
    hashes, begins = joined_words([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    if not len(hashes):
        return [[] for _ in texts]
    held = plan.known.ids(hashes) >= 0
    for row, k, low, high in stretches(plan, hashes, begins, held, similarity):
        size, mask = len(plan.words[k]), plan.masks[k]
        limit = allowed(size, similarity)
        text = hashes[low:high].tolist()
        if sum(w in mask for w in text) < size - limit:
            continue
        distance, ends = nearest_ends(mask, size, text)
        was = out[row].get(k)
        if distance > limit or was is not None and was[0] < distance:
            continue
        may = {s for e in ends for s in range(max(0, e - size - distance), e - size + distance + 1) if 0 <= s < len(text) and held[low + s]}
        for s in sorted(may):
            own, end = prefix_distance(mask, size, text[s : s + size + limit], limit)
            if own == distance:
                at = low + s - int(begins[row])
                if was is None or (distance, at) < was[:2]:
                    out[row][k] = (distance, at, at + end)
                break
    return [
        sorted(
            (
                {"item_id": plan.ids[k], "distance": d, "item_words": len(plan.words[k]), "start_word": a, "end_word": e}
                for k, (d, a, e) in row.items()
            ),
            key=lambda x: (x["item_id"], x["distance"], x["start_word"]),
        )
        for row in out
    ]


def item_blocks(items: DataFrame, block_bytes: int = ITEM_BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of about a bounded size, ordered by id, read one partition at a time; an id stays in one block."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for row in items.select("item_id", "text").where("text is not null and item_id is not null").orderBy("item_id", "text").toLocalIterator():
        if held and held + len(row["text"]) > block_bytes and row["item_id"] != ids[-1]:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"])
    yield ids, texts


def with_leaks(documents: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text: str = "text", leaks: str = "leaks") -> DataFrame:
    """``documents`` and ``leaks``: the items found in each whole text, one entry an item.

    An item is found with TARGET_RECALL at least where it stands with all the
    edits allowed, nearly always with fewer, and always without any.  Null and
    empty texts hold none; items without text or id are skipped; items that
    come twice under one id count once.  One pass over the documents serves a
    block of items; passes after the first start from a checkpoint.  An input
    column named like ``leaks`` is replaced.
    """
    out = None
    for ids, texts in item_blocks(items):
        plan = build_plan(ids, texts, similarity)

        def kernel(rows: list[str], plan=plan) -> list[pa.Array]:
            found = []
            for row in find(plan, rows, similarity):
                own: dict[int, dict] = {}
                for leak in row:
                    own.setdefault(leak["item_id"], leak)
                found.append(list(own.values()))
            return [pa.array(found, _LEAKS_ARROW)]

        if out is None:
            out = append_columns(documents, text, [T.StructField(leaks, LEAKS)], kernel)
        else:
            before = checkpoint(out.withColumnRenamed(leaks, "__before"))
            out = append_columns(before, text, [T.StructField(leaks, LEAKS)], kernel)
            out = out.withColumn(leaks, F.concat("__before", quoted(leaks))).drop("__before")
    return out
