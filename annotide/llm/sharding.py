"""A global shuffle into shards, in two passes over the data.

Pass one scatters records uniformly into buckets that fit a task's memory, by
a seeded hash of the whole record.  Pass two shuffles each bucket with
Fisher-Yates and lays the buckets end to end; the shards are equal cuts of
that sequence, so their row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annotide.llm.common import quoted, without

BUCKET_BYTES = 8 << 20
#: Buckets at most, so that their offsets (16 bytes each) can be broadcast; beyond it buckets grow (to 100 MB at 100 TB).
MOST_BUCKETS = 1 << 20


def record_hash(records: DataFrame, seed: int, method=F.xxhash64) -> F.Column:
    """A hash of whole records: nulls count by their place, nested columns and maps as JSON."""
    plain, nested = [], []
    for field in records.schema.fields:
        value = quoted(field.name)
        if isinstance(field.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType)):
            nested.append(F.to_json(F.struct(value), {"ignoreNullFields": "false"}))
        else:
            plain.append(value)
    nulls = F.concat(F.lit("n"), *[F.when(c.isNull(), "1").otherwise("0") for c in plain])
    return method(F.lit(seed), nulls, *plain, *nested)


def repeats(batch: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """Which rows ``at`` of ``batch`` equal the row before them in every column."""
    same = np.ones(len(at), bool)
    for column in batch.columns:
        try:
            here, before = column.take(pa.array(at)), column.take(pa.array(at - 1))
            equal = pc.if_else(pc.and_(pc.is_null(here), pc.is_null(before)), True, pc.fill_null(pc.equal(here, before), False))
            same &= equal.to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:  # nested values
            same &= np.array([column.slice(k, 1).equals(column.slice(k - 1, 1)) for k in at.tolist()], bool)
    return same


def shuffled_shards(
    records: DataFrame, size: F.Column, shards: int = 24, seed: int = 5, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``records`` with shard (0 to ``shards`` - 1) and slot (0, 1, ... in each shard).

    ``size`` is a record's bytes.  The order is a seeded random permutation
    that depends on the records alone, not on their partitioning; records
    equal in all columns, compared value by value, are interchangeable and a
    task holds them once.  An empty input gives an empty result.  Columns named
    shard or slot are replaced.
    """
    records = without(records, ["shard", "slot"])
    own = [f.name for f in records.schema.fields]
    draw, other = record_hash(records, seed), record_hash(records, seed, F.hash)
    total = records.agg(F.sum(size.cast("long")).alias("bytes"), F.count("*").alias("rows")).first()
    rows = total["rows"]
    buckets = min(MOST_BUCKETS, max(1, -(-(total["bytes"] or 0) // bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), F.col("__draw")), F.lit(buckets)).alias("__bucket")
    drawn = records.withColumns({"__draw": draw, "__other": other}).select("*", bucket)

    counts = records.select(draw.alias("__draw")).select(bucket).groupBy("__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select(
        F.col("__bucket"), F.expr("sum(__n) over (order by __bucket rows between unbounded preceding and current row) - __n").alias("__offset")
    )  # one row a bucket

    schema = T.StructType([*drawn.drop("__draw", "__other").schema.fields, T.StructField("__place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        copies: list[int] = []
        state = {"bucket": None, "draw": None, "other": None, "row": None}

        def emit() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            source = np.repeat(np.arange(table.num_rows), copies)
            order = np.random.Generator(np.random.PCG64([seed, int(state["bucket"])])).permutation(len(source))  # Fisher-Yates
            mean = max(1, table.nbytes // max(1, table.num_rows))
            step = max(1, min(8192, (1 << 20) // mean))
            for at in range(0, len(order), step):
                part = table.take(pa.array(source[order[at : at + step]])).combine_chunks()
                columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in part.columns]
                place = pa.array(np.arange(at, at + part.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*columns, place], names=[*part.schema.names, "__place"])
            held.clear()
            copies.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            in_bucket = batch.column(names.index("__bucket")).to_numpy()
            drawn_as = batch.column(names.index("__draw")).to_numpy()
            other = batch.column(names.index("__other")).to_numpy()
            rest = batch.drop_columns(["__draw", "__other"])
            cuts = [0, *(np.flatnonzero(in_bucket[1:] != in_bucket[:-1]) + 1).tolist(), len(in_bucket)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if in_bucket[a] != state["bucket"]:
                    yield from emit()
                    state["bucket"], state["draw"] = in_bucket[a], None
                begins = state["draw"] is None or drawn_as[a] != state["draw"] or other[a] != state["other"] or not rest.slice(a, 1).equals(state["row"])
                changes = (drawn_as[a + 1 : b] != drawn_as[a : b - 1]) | (other[a + 1 : b] != other[a : b - 1])
                new = np.concatenate([[begins], changes])
                alike = a + np.flatnonzero(~new)
                alike = alike[alike > a]
                if len(alike):  # equal hashes: only rows equal in every column are copies
                    new[alike - a] = ~repeats(rest, alike)
                state["draw"], state["other"], state["row"] = drawn_as[b - 1], other[b - 1], rest.slice(b - 1, 1)
                group = np.cumsum(new)
                if group[0] == 0:
                    copies[-1] += int((group == 0).sum())
                copies.extend(np.bincount(group)[1:].tolist())
                if new.any():
                    held.append(rest.slice(a, b - a).filter(pa.array(new)))
        yield from emit()

    mixed = drawn.repartition("__bucket").sortWithinPartitions("__bucket", "__draw", "__other").mapInArrow(run, schema)
    place = F.col("__offset") + F.col("__place")
    cut = F.expr(f"(__at * {shards}) div {max(1, rows)}")
    return (
        mixed.join(F.broadcast(offsets), "__bucket")
        .withColumn("__at", place)
        .withColumn("__shard", cut)
        .select(
            *map(quoted, own),
            F.col("__shard").cast("int").alias("shard"),
            (F.col("__at") - F.expr(f"(__shard * {rows} + {shards - 1}) div {shards}")).alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; files hold slots in order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
