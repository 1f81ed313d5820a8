"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of the white-space tokenisation: space and the controls 9 to 13.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared folder of ``spark.checkpoint.dir``.

    A local session without that setting (a test) gets a folder of its own; on
    a cluster that is an error, as executors would not share it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="annotide-checkpoint-"))
    return df.checkpoint(eager=True)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns that a result is about to define."""
    taken = {name.lower() for name in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def by_bytes(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` of at most ``limit`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def append_columns(
    df: DataFrame,
    text: str,
    added: Sequence[T.StructField],
    kernel: Callable[[list[str]], list[pa.Array]],
    limit: int = 2 << 20,
) -> DataFrame:
    """``df`` and the columns that ``kernel`` makes of each slice of whole texts.

    Texts arrive in slices balanced by bytes; a null text reaches the kernel
    as an empty one.  Input columns named like an added one are replaced.
    """
    rows = without(df, [f.name for f in added])
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, text, limit):
                made = kernel([t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *made], names=[*part.schema.names, *(f.name for f in added)]
                )

    return rows.mapInArrow(run, schema)


def scrambled(node: Column) -> Column:
    """Another 64-bit number for each one (xorshift, one to one), so that the order of ids tells nothing."""
    for left, right, last in ((13, 7, 17), (11, 5, 32)):
        node = node.bitwiseXOR(F.shiftleft(node, left))
        node = node.bitwiseXOR(F.shiftrightunsigned(node, right))
        node = node.bitwiseXOR(F.shiftleft(node, last))
    return node


def joined_once(links: DataFrame) -> DataFrame:
    """(node, label): every linked node of ``links(a, b)`` and its first neighbour's first neighbour, in a scrambled order.

    One round of ``components``: nodes of one label are in one component, but
    not the other way round.  A dense group has few labels left.
    """
    pairs = links.select("a", "b").where("a <> b")
    own, other = (F.struct(scrambled(F.col(c)).alias("order"), F.col(c).alias("node")) for c in "ab")
    both = pairs.select(own.alias("x"), other.alias("y")).union(pairs.select(other.alias("x"), own.alias("y")))
    near = both.groupBy("x").agg(F.least("x", F.min("y")).alias("low"))
    ahead = near.select("x.order", F.col("low.node").alias("label"))
    return near.select("x.node", "low.order").join(ahead, "order").select("node", "label")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: one row (node, component) per linked node.

    ``component`` is the smallest node reachable.  In each round every node
    goes to its first neighbour's first neighbour in a scrambled order, and
    the links shrink to those between such nodes: a dense group is gone after
    one round, and any group after about the logarithm of its size, ids in a
    row included.  Every round is checkpointed; only whether links are left
    reaches the driver.
    """
    pairs = links.select("a", "b").where("a <> b")
    own = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node"), scrambled(F.col("a")).alias("own"))
    a, b = scrambled(F.col("a")), scrambled(F.col("b"))
    edges = checkpoint(pairs.select(a.alias("a"), b.alias("b")).union(pairs.select(b.alias("a"), a.alias("b"))).distinct())
    found = None
    while True:
        near = edges.groupBy(F.col("a").alias("own")).agg(F.least("a", F.min("b")).alias("low"))
        ahead = near.select(F.col("own").alias("low"), F.col("low").alias("label"))
        moved = checkpoint(near.join(ahead, "low").select("own", "label"))  # a first neighbour is a node too
        edges = edges.join(moved.select(F.col("own").alias("a"), F.col("label").alias("la")), "a").join(
            moved.select(F.col("own").alias("b"), F.col("label").alias("lb")), "b"
        )
        edges = checkpoint(edges.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        if found is None:
            found = moved
        else:
            later = moved.select(F.col("own").alias("label"), F.col("label").alias("further"))
            found = checkpoint(found.join(later, "label", "left").select("own", F.coalesce("further", "label").alias("label")))
        if edges.isEmpty():
            break
    named = own.join(found, "own").select("node", "label")
    smallest = named.groupBy("label").agg(F.min("node").alias("component"))
    return checkpoint(named.join(smallest, "label").select("node", "component"))


def rows_about(df: DataFrame, key: Column, wanted: int, rows: int) -> DataFrame:
    """A sample of about ``wanted`` of the ``rows`` rows of ``df``, decided by the hash of ``key``."""
    if rows <= wanted:
        return df
    grain = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(grain)) < F.lit(int(wanted * grain / rows)))


#: Bits of the maps that find wanted rows before a shuffle: 16 for each wanted value, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 24


def maybe_in(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose 64-bit ``column`` may be in the one column of ``wanted``: all that are, and few others.

    A bit map is broadcast, 64 bits a row: MOST_BITS bits (some 16 MB) at most.
    Beyond some 10^7 wanted values it passes most rows on.  A join must follow.
    """
    bits = LEAST_BITS
    n = wanted.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(c, F.lit("slot")), F.lit(bits))
    own = slot(F.col(wanted.columns[0]))
    one = F.expr("shiftleft(1L, cast(__slot % 64 as int))")
    words = wanted.select(own.alias("__slot")).select(F.expr("__slot div 64").alias("__word"), one.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    here = rows.withColumn("__slot", slot(quoted(column))).withColumn("__word", F.expr("__slot div 64")).join(F.broadcast(words), "__word")
    return here.where("shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1 = 1").select(*map(quoted, rows.columns))


#: Fixed odd multipliers and byte values of the word hash, drawn from a seed.
_DRAW = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _DRAW.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


#: Bytes that are no white space: all but the space and the controls 9 to 13.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[9, 10, 11, 12, 13, 32]] = False


def word_hashes(data: np.ndarray, letters_of: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words in lower-cased UTF-8 bytes.

    A word is a longest run of bytes that ``letters_of`` marks: by default
    ASCII digits, ASCII small letters and bytes of characters outside ASCII.
    """
    inside = letters_of[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    letters = data[inside]
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, sizes)
    values = _BYTE[letters] * _STEP[place & 4095]
    return starts, ends, mixed(np.add.reduceat(values, first) + sizes.astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, elementwise on unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: Sequence[str]) -> np.ndarray:
    """The hash that ``word_hashes`` gives each of these words."""
    return np.array([int(word_hashes(np.frombuffer(w.encode(), np.uint8))[2][0]) for w in words], np.uint64)


class Lookup:
    """Positions of 64-bit hashes in a small sorted vocabulary; a bit table rejects most strangers."""

    def __init__(self, hashes: np.ndarray, bits: int = 20):
        self.hashes = np.unique(hashes)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.hashes >> self.shift).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash its position, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        maybe = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        sure = self.hashes[at] == hashes[maybe]
        out[maybe[sure]] = at[sure]
        return out


def joined_words(texts: Sequence[bytes], letters_of: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and where each text's words begin (one more entry at the end)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, _, hashes = word_hashes(data, letters_of)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins, side="left")
