"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within the
distance agree in one of them but for one bit at most.  Every segment is
indexed once as it is and once for each of its bits with that bit wiped out;
fingerprints that share an index entry are compared whole.  An entry with a
wiped bit compares only those that differ in it, so a pair meets in one entry
for each segment that qualifies.

Entries meet by an equality shuffle of (entry, fingerprint) rows and a sort;
runs of equal entries are compared in blocks.  A long run reports a spanning
forest of its links instead of all of them, which keeps every component and
lets the output grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotide.llm.common import TOKEN_BYTES, append_columns, checkpoint, components, joined_once, joined_words, maybe_in, mixed, quoted

#: Runs up to this length are compared offset by offset and report all links.
SHORT_RUN = 64
#: Runs up to this length are compared row by row; longer ones by wiping further bits.
MIDDLE_RUN = 8192
#: Words of a shingle, and differing bits up to which fingerprints link.
PRINT_SHINGLE, PRINT_BITS = 3, 2

_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.uint8).view(np.uint64).ravel()


def majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each group of hashes the bits that more than half of them have.

    Group k holds ``hashes[begins[k]:begins[k + 1]]``; an empty one gives 0.
    """
    sizes = np.diff(begins)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pieces = (sizes[full] + 254) // 255  # at most 255 hashes fit the lanes of a byte
    first = np.repeat(begins[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, first, axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(counts, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    bits = 2 * counts > sizes[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 (seed 42) of the runs of ``shingle`` words of a text whose A-Z are lower-cased.

    Words are parted by white space; a shorter text is one run, one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprints(texts: Sequence[str], shingle: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text, repeated shingles counted each time."""
    parts = [shingle_hashes(t, shingle) for t in texts]
    begins = np.cumsum([0, *map(len, parts)])
    return majority(np.array([h for p in parts for h in p], np.uint64), begins)


def shingle_sets(texts: Sequence[str], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; a text of fewer words is one shingle, one without words has none."""
    hashes, begins = joined_words([t.encode("utf-8", "surrogatepass").lower() for t in texts], TOKEN_BYTES)
    parts = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        own = hashes[a:b]
        size = min(shingle, len(own))
        if not size:
            parts.append(own)
            continue
        mix = own[: len(own) - size + 1].copy()
        for k in range(1, size):
            mix = mixed(mix) + own[k : len(own) - size + 1 + k]
        parts.append(np.unique(mixed(mix)))
    return parts


def band_keys(sets: Sequence[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set, and its key in each band: a hash of the band and the smallest shingles by ``rows`` orders."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    nodes, keys = np.zeros(len(sets), np.uint64), np.zeros((len(sets), bands), np.uint64)
    keys[:] = mixed(np.arange(bands, dtype=np.uint64))
    if len(full):
        flat = np.concatenate([sets[k] for k in full.tolist()])
        starts = np.cumsum(sizes[full]) - sizes[full]
        nodes[full] = mixed(np.add.reduceat(mixed(flat), starts) + sizes[full].astype(np.uint64))
        draw = np.random.Generator(np.random.PCG64(20240301))
        for band in range(bands):
            own = keys[full, band]
            for seed, step in draw.integers(1, 1 << 63, (rows, 2), dtype=np.uint64):
                order = (flat ^ seed) * (step << np.uint64(1) | np.uint64(1))
                own = mixed(own ^ np.minimum.reduceat(order, starts))
            keys[full, band] = own
    return nodes, keys


# ---------------------------------------------------------------- index entries


def entries(nodes: DataFrame, words: Sequence[str], segments: int, width: int, per_word: int) -> DataFrame:
    """(entry, *words): every node once for each segment and for each wiped bit of it.

    Segment s is bits ``width * (s % per_word)`` and on of word ``s // per_word``.
    """
    rows = nodes.select(*words, F.explode(F.sequence(F.lit(0), F.lit(segments * (width + 1) - 1))).alias("variant"))
    segment = (F.col("variant") / (width + 1)).cast("int")
    wiped = F.col("variant") % (width + 1)
    value: Column = F.lit(None).cast("long")
    for s in reversed(range(segments)):
        part = F.shiftrightunsigned(quoted(words[s // per_word]), width * (s % per_word)).bitwiseAND(F.lit((1 << width) - 1))
        value = F.when(segment == s, part).otherwise(value)
    mask = F.when(wiped == width, F.lit(-1).cast("long")).otherwise(F.expr(f"~shiftleft(1L, variant % {width + 1})"))
    entry = F.shiftleft(F.col("variant").cast("long"), width).bitwiseOR(value.bitwiseAND(mask))
    return rows.select(entry.alias("entry"), *words)


class Finder:
    """Compares the fingerprints that share an entry; rows arrive sorted by entry."""

    def __init__(self, words: int, width: int, per_word: int, distance: int, short_run: int = SHORT_RUN):
        self.words, self.width, self.per_word, self.distance = words, width, per_word, distance
        self.short_run = short_run

    def apart(self, variant: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Which differences (rows of ``gap``) count as links in their entries."""
        wiped = variant % (self.width + 1)
        place = variant // (self.width + 1)
        own = gap[np.arange(len(gap)), place // self.per_word]
        shift = (self.width * (place % self.per_word) + np.minimum(wiped, self.width - 1)).astype(np.uint64)
        return (np.bitwise_count(gap).sum(1, dtype=np.int64) <= self.distance) & ((wiped == self.width) | ((own >> shift) & np.uint64(1) == 1))

    def links(self, entry: np.ndarray, prints: np.ndarray) -> list[np.ndarray]:
        """Pairs of linked fingerprints, as rows of twice ``words`` numbers."""
        if len(entry) < 2:
            return []
        out = []
        edges = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1], [True]]))
        sizes = np.diff(edges)
        variant = entry >> self.width
        longest = int(sizes.max())
        short = np.repeat(sizes <= self.short_run, sizes)
        for offset in range(1, min(longest, self.short_run)):
            at = np.flatnonzero((entry[offset:] == entry[:-offset]) & short[offset:])
            if not len(at):
                break
            at = at[self.apart(variant[at], prints[at] ^ prints[at + offset])]
            out.append(np.concatenate([prints[at], prints[at + offset]], 1))
        for k in np.flatnonzero(sizes > self.short_run).tolist():
            out.append(self.forest(int(variant[edges[k]]), prints[edges[k] : edges[k + 1]]))
        return out

    def forest(self, variant: int, prints: np.ndarray) -> np.ndarray:
        """A spanning forest of the links of one long run."""
        if len(prints) > MIDDLE_RUN and self.words == 1 and self.distance <= 2:
            return self.wiped_forest(variant, prints)
        if len(prints) <= 256:
            return self.nearest_forest(variant, prints)
        root = np.arange(len(prints))
        found = []
        steps = sorted({min(self.distance, d) for d in (2, 5, 10, 16, self.distance)})
        for limit in steps:  # the nearest first, so that a forest keeps the closest links
            for i in range(len(prints) - 1):
                gap = prints[i + 1 :] ^ prints[i]
                near = np.flatnonzero(np.bitwise_count(gap).sum(1, dtype=np.int64) <= limit)
                near = near[root[near + i + 1] != root[i]]
                if not len(near):
                    continue
                near = near[self.apart(np.full(len(near), variant), gap[near])] + i + 1
                others, first = np.unique(root[near], return_index=True)
                found += [(i, int(j)) for j in near[first]]
                if len(others):
                    root[np.isin(root, others)] = root[i]
        at = np.array(found, np.int64).reshape(-1, 2)
        return np.concatenate([prints[at[:, 0]], prints[at[:, 1]]], 1)

    def nearest_forest(self, variant: int, prints: np.ndarray) -> np.ndarray:
        """The spanning forest of smallest distances, by taking the links in rising order."""
        i, j = np.triu_indices(len(prints), 1)
        gap = prints[i] ^ prints[j]
        linked = np.flatnonzero(self.apart(np.full(len(i), variant), gap))
        order = linked[np.argsort(np.bitwise_count(gap[linked]).sum(1, dtype=np.int64), kind="stable")]
        root = list(range(len(prints)))
        found = []
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            x, y = a, b
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[y] = x
                found.append((a, b))
                if len(found) == len(prints) - 1:
                    break
        at = np.array(found, np.int64).reshape(-1, 2)
        return np.concatenate([prints[at[:, 0]], prints[at[:, 1]]], 1)

    def wiped_forest(self, variant: int, prints: np.ndarray) -> np.ndarray:
        """The same for one word and a distance of 2, by wiping bits outside the segment too.

        The segment of a run is settled but for its wiped bit; what differs in
        the rest is at most as many bits as the distance has left.
        """
        wiped, place = variant % (self.width + 1), variant // (self.width + 1)
        outside = [b for b in range(64) if not self.width * place <= b < self.width * (place + 1)]
        left = self.distance - (wiped < self.width)
        one = prints[:, 0]
        root = np.arange(len(one))
        found = []
        own = [self.width * place + wiped] if wiped < self.width else []
        for bits in combinations(outside, left):
            key = one & ~np.uint64(sum(1 << b for b in (*bits, *own)))
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            lead = np.repeat(order[heads], np.diff(np.append(heads, len(one))))
            differ = np.flatnonzero(root[lead] != root[order])
            for i, j in zip(lead[differ].tolist(), order[differ].tolist(), strict=True):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((i, j))
            while (root[root] != root).any():
                root = root[root]
        at = np.array(found, np.int64).reshape(-1, 2)
        return np.concatenate([prints[at[:, 0]], prints[at[:, 1]]], 1)


def fingerprint_links(
    nodes: DataFrame, words: Sequence[str], segments: int, width: int, per_word: int, distance: int, short_run: int = SHORT_RUN
) -> DataFrame:
    """Links between the distinct fingerprints in ``nodes``: columns a0.. and b0.., each link's smaller print first."""
    finder = Finder(len(words), width, per_word, distance, short_run)
    names = [f"{side}{k}" for side in "ab" for k in range(len(words))]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def result(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if rows:
                table = np.concatenate(rows).view(np.int64)
                a, b = table[:, : len(words)], table[:, len(words) :]
                swap = a[:, 0] > b[:, 0]
                a, b = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*a.T, *b.T)], names=names)

        def settle(cut: bool) -> Iterator[pa.RecordBatch]:
            entry = np.concatenate([e for e, _ in held])
            prints = np.concatenate([p for _, p in held])
            keep = int(np.searchsorted(entry, entry[-1])) if cut else len(entry)
            held[:] = [(entry[keep:], prints[keep:])] if keep < len(entry) else []
            yield from result(finder.links(entry[:keep], prints[:keep]))

        for batch in batches:
            if not batch.num_rows:
                continue
            entry = batch.column(0).to_numpy()
            prints = np.stack([batch.column(1 + k).to_numpy() for k in range(len(words))], 1).view(np.uint64)
            same = held and held[-1][0][-1] == entry[-1]  # a run that goes on is only kept
            held.append((entry, prints))
            if not same:
                yield from settle(True)
        if held:
            yield from settle(False)

    # sorted by print too: forests of a run must not depend on the order in which a shuffle delivers its rows
    rows = entries(nodes, words, segments, width, per_word).repartition("entry").sortWithinPartitions("entry", *words)
    return rows.mapInArrow(run, schema).distinct()


# ---------------------------------------------------------------- operators


def rooted_prints(prints: DataFrame, distance: int) -> DataFrame:
    """``prints`` with a column root, the same for all fingerprints (column print, distinct) that links of ``distance`` bits join."""
    links = fingerprint_links(prints.select("print"), ["print"], 2, 32, 2, distance).select(F.col("a0").alias("a"), F.col("b0").alias("b"))
    found = components(links)
    rooted = prints.join(found, prints["print"] == found["node"], "left")
    return rooted.select(*prints.columns, F.coalesce("component", "print").alias("root"))


def simhash_groups(
    documents: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = PRINT_SHINGLE, distance: int = PRINT_BITS
) -> DataFrame:
    """(key, fingerprint, component_id): one row for each row of ``documents``.

    Fingerprints link at ``distance`` (at most 3) or fewer differing bits;
    equal fingerprints always do.  component_id is the smallest key reachable,
    null where all keys of a component are null.  Null and empty texts have
    fingerprint zero and are linked like any other.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments leave one differing bit only up to a distance of 3")

    def kernel(texts: list[str]) -> list[pa.Array]:
        return [pa.array(fingerprints(texts, shingle).view(np.int64))]

    signed = documents.select(quoted(key).alias("__key"), quoted(text).alias("__text"))
    signed = checkpoint(append_columns(signed, "__text", [T.StructField("print", T.LongType())], kernel).select("__key", "print"))
    prints = signed.groupBy("print").agg(F.min("__key").alias("first"))
    rooted = rooted_prints(prints, distance)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("print", "component_id")
    return signed.join(named, "print").select(
        F.col("__key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: Near-duplicate groups by shared content: texts link if the sets of their
#: five-word shingles have a Jaccard similarity of ALIKE or more.  Candidates
#: are the components of ``simhash_groups`` by its defaults, and texts that
#: share the smallest shingles by BAND_ROWS random orders in one of BANDS bands:
#: at a similarity of 0.8 fingerprints differ in more bits than segments can
#: find.  The chance of a band depends on the similarity s alone, wherever the
#: texts differ: 1 - (1 - s^6)^24, 0.9993 at 0.8.  Every link is verified by the
#: exact sets.  Candidates are taken in two SWEEPS, the components in the first:
#: most of a group that it finds is one label in the second, which compares
#: different labels only.
SHINGLE = 5
ALIKE = (4, 5)
BANDS, BAND_ROWS = 24, 6
SWEEPS = ((0, 4), (4, 24))
#: Shingles that one task compares at once (about); places with more are cut into cells.
CELL_SHINGLES = 1 << 18


def alike_forest(sets: Sequence[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets that are alike, all verified: enough to join every two labels that have such a pair.

    Pairs have one set in ``left`` and one in ``right``; sets of one label
    aren't compared, nor are sets whose labels earlier pairs have joined.
    """
    above, below = ALIKE
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own, root, found = np.zeros(len(values), bool), np.unique(labels, return_inverse=True)[1], []
    done = np.zeros(len(sets), bool)
    for i in np.flatnonzero(left).tolist():
        done[i] = right[i]
        near = np.flatnonzero(right & (root != root[i]) & ~(done & left))
        near = near[below * np.minimum(sizes[near], sizes[i]) >= above * np.maximum(sizes[near], sizes[i])]
        if not len(near):
            continue
        own[ids[starts[i] : ends[i]]] = True
        begins = np.cumsum(sizes[near]) - sizes[near]
        at = np.repeat(starts[near] - begins, sizes[near]) + np.arange(int(sizes[near].sum()))
        both = np.add.reduceat(own[ids[at]], begins, dtype=np.int64)
        own[ids[starts[i] : ends[i]]] = False
        near = near[below * both >= above * (sizes[near] + sizes[i] - both)]
        others, first = np.unique(root[near], return_index=True)
        found += [(i, int(j)) for j in near[first]]
        root[np.isin(root, others)] = root[i]
    return found


def in_runs(rows: DataFrame, schema: T.StructType, result: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``result`` of each run of equal first columns, in the order of the first two columns."""
    by = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            value = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != value[a]:
                    yield from result(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from result(pa.Table.from_batches(held))

    return rows.repartition(by).sortWithinPartitions(*rows.columns[:2]).mapInArrow(run, schema)


def alike_links(rows: DataFrame) -> DataFrame:
    """(a, b): labels joined by a pair of like texts in a cell of ``rows(cell, node, label, side, text)``.

    side 0 is compared with side 1, and side 2 with all of its own.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def result(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, at, back = np.unique(table.column("node").to_numpy(), return_index=True, return_inverse=True)
        label, side = table.column("label").to_numpy()[at], table.column("side").to_numpy()
        left, right = np.zeros(len(node), bool), np.zeros(len(node), bool)
        left[back[side != 1]] = True
        right[back[side != 0]] = True
        sets = shingle_sets([t or "" for t in table.column("text").take(pa.array(at)).to_pylist()], SHINGLE)
        found = alike_forest(sets, label, left, right)
        if found:
            pairs = np.sort(label[np.array(found)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in pairs.T], names=["a", "b"])

    return in_runs(rows, schema, result).distinct()


def print_places(signed: DataFrame) -> DataFrame:
    """(node, size, place): a place for each component of the fingerprints in ``signed(node, size, print)``."""
    roots = rooted_prints(signed.select("print").distinct(), PRINT_BITS)
    own = signed.select("node", "size", "print").distinct().join(roots, "print")
    return own.select("node", "size", F.xxhash64("root", F.lit("print")).alias("place")).distinct()


def band_places(nodes: DataFrame, low: int, high: int) -> DataFrame:
    """(node, size, place): a place for each key in bands ``low`` to ``high``."""
    return nodes.select("node", "size", F.explode(F.slice("bands", low + 1, high - low)).alias("place"))


def places(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(place, node, label, size, weight): who is in those places of ``rows(node, size, place)`` that have several labels."""
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = rows.groupBy("place").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("weight"))
    return rows.join(several.where("low <> high").select("place", "weight"), "place").select("place", "node", "label", "size", "weight")


def heavy() -> Column:
    """Whether a place is cut into cells."""
    return F.col("weight") > CELL_SHINGLES


def cells(members: DataFrame) -> DataFrame:
    """(cell, node, label, side): each place of ``places`` as one cell, or cut by a hash into cells of bounded weight."""
    parts = F.ceil(F.col("weight") / CELL_SHINGLES).cast("long")
    cut = F.when(parts > 1, F.pmod(F.xxhash64("node", F.lit("cell")), parts)).otherwise(F.lit(0))
    return members.select(F.xxhash64("place", cut).alias("cell"), "node", "label", F.lit(2).alias("side"))


def crossed_cells(members: DataFrame) -> DataFrame:
    """(cell, node, label, side): the rest of the places that ``cells`` has cut, all pairs of labels that cells kept apart.

    Every such pair has a text outside the label that weighs most in its
    place; those (side 1) meet each part of the place (side 0) in a cell of its
    own.  A group that its cells have joined has none.
    """
    many = members.where(heavy())
    held = many.groupBy("place", "label").agg(F.sum("size").alias("held"))
    top = held.groupBy("place").agg(F.max(F.struct("held", "label")).alias("top"), F.sum("held").alias("weight"))
    top = top.select("place", F.col("top.label").alias("most"), "weight", (F.col("weight") - F.col("top.held")).alias("rest")).where("rest > 0")
    rows = many.drop("weight").join(top, "place")
    parts = F.ceil(F.col("weight") / CELL_SHINGLES).cast("long")
    others = F.ceil(F.col("rest") / CELL_SHINGLES).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit("cell")), parts)
    other = F.pmod(F.xxhash64("node", F.lit("other")), others)
    all_parts = rows.select("place", "node", "label", F.lit(0).alias("side"), own.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("j"))
    few = rows.where("label <> most").select(
        "place", "node", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("i"), other.alias("j")
    )
    return all_parts.unionByName(few).select(F.xxhash64("place", "i", "j").alias("cell"), "node", "label", "side")


def content_groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, keep): for each row of ``documents`` a hash of its text, and whether it leads its group.

    Groups hold texts whose sets of five-word shingles have a similarity of
    0.8 or more, directly or through others; all pairs in a component of
    fingerprints and all in a band are compared.  The row with the smallest key
    leads, rows without key come last; of rows equal in key and text all are
    marked.
    """

    def kernel(texts: list[str]) -> list[pa.Array]:
        sets = shingle_sets(texts, SHINGLE)
        own, keys = band_keys(sets, BANDS, BAND_ROWS)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS)
        bands = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
        prints = fingerprints(texts, PRINT_SHINGLE)
        return [pa.array(own.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), bands, pa.array(prints.view(np.int64))]

    rows = documents.select(quoted(key).alias("__key"), F.xxhash64(quoted(text)).alias("content"), quoted(text).alias("__text"))
    kinds = {"node": T.LongType(), "size": T.LongType(), "bands": T.ArrayType(T.LongType()), "print": T.LongType()}
    added = [T.StructField(n, t) for n, t in kinds.items()]
    signed = checkpoint(append_columns(rows, "__text", added, kernel, 1 << 20).drop("__text"))
    order = F.struct(F.col("__key").isNull().alias("missing"), F.col("__key").alias("key"), F.col("content").alias("content"))
    nodes = checkpoint(signed.groupBy("node").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")))

    def linked(found: DataFrame) -> DataFrame:
        """Links between the labels of the texts that meet in the cells of ``found``."""
        wanted = checkpoint(found.select("node").distinct().join(nodes, "node").select("node", F.col("first.content").alias("content")))
        here = maybe_in(rows.select("content", "__text"), "content", wanted.select("content"))
        # one text for each hash, so that copies are never fetched one by one
        texts = here.groupBy("content").agg(F.first("__text").alias("text")).join(wanted, "content").select("node", "text")
        return checkpoint(alike_links(found.join(texts, "node").select("cell", "node", "label", "side", "text")))

    first = checkpoint(places(print_places(signed).unionByName(band_places(nodes, *SWEEPS[0])), None))
    links = linked(cells(first))
    labels = checkpoint(joined_once(links))
    links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
    second = checkpoint(places(band_places(nodes, *SWEEPS[1]), labels))
    links = links.unionByName(linked(cells(second)))
    cut = first.where(heavy()).unionByName(second.where(heavy())).drop("label")
    if not cut.isEmpty():
        labels = checkpoint(joined_once(links))
        cut = cut.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        links = links.unionByName(linked(checkpoint(crossed_cells(cut))))
    found = components(links)
    grouped = nodes.select("node", "first").join(found, "node", "left").select("first", F.coalesce("component", "node").alias("root"))
    leaders = grouped.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.key").alias("__lead"), F.col("first.content").alias("content"), F.lit(True).alias("keep")
    )
    joined = signed.select("__key", "content").alias("s").join(
        leaders.alias("l"), F.col("s.__key").eqNullSafe(F.col("l.__lead")) & F.col("s.content").eqNullSafe(F.col("l.content")), "left"
    )
    return joined.select(F.col("s.__key").alias(key), F.col("s.content"), F.coalesce("keep", F.lit(False)).alias("keep"))


def without_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of ``content_groups``; columns as they come.

    Of rows that repeat a leading row's key and text, the one whose other
    columns come first as JSON stays; rows equal in that too are
    interchangeable.
    """
    named = {c: f"__own{k}" for k, c in enumerate(documents.columns)}  # no column can clash
    key, text = named[key], named[text]
    own = documents.select(*[quoted(c).alias(n) for c, n in named.items()])
    groups = content_groups(own, key, text).where("keep").groupBy(F.col(key).alias("lead"), "content")
    leaders = checkpoint(groups.agg(F.count("*").alias("rows")))
    rows = own.withColumn("content", F.xxhash64(text))

    def led(rows: DataFrame, leaders: DataFrame) -> DataFrame:
        d, g = rows.alias("d"), leaders.alias("g")
        return d.join(g, F.col(f"d.{key}").eqNullSafe(F.col("g.lead")) & (F.col("d.content") == F.col("g.content")), "left_semi")

    kept = led(rows, leaders.where("rows = 1")).select(*[F.col(n).alias(c) for c, n in named.items()])
    several = checkpoint(leaders.where("rows > 1"))
    if several.isEmpty():
        return kept
    others = [n for n in named.values() if n not in (key, text)]
    rank = F.to_json(F.struct(*others)) if others else F.lit("")
    repeated = led(maybe_in(rows, "content", several.select("content")), several).groupBy(key, "content")
    repeated = repeated.agg(F.min_by(F.struct(*named.values()), rank).alias("row"))
    return kept.unionByName(repeated.select(*[F.col("row").getField(n).alias(c) for c, n in named.items()]))
