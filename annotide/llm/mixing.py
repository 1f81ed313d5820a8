"""Mixing sources to target weights by Sainte-Laguë apportionment.

The words of each source, its documents in a seeded order, form a stream that
is cut into blocks of equal length.  As many blocks as the corpus holds are
allotted to the sources by the highest quotients target / (2 k - 1), so every
source has an integer quota, dealt on to the shards: quotas are integers for
every shard and source.  Each shard then selects its quota of blocks: the runs
of a source's shards follow one another from a seeded start in the seeded
order, around the end and on as often as needed, so no block comes twice
before all came once.

DataFrame operations only.  Positions in a stream come from sums over
(source, slice of the order) and within them, so no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm.common import SPACE_WORD, quoted, without

#: Words in a block; the most times a document may be taken; weights by rank of the source.
BLOCK_WORDS, MOST_COPIES, WEIGHTS = 32, 3, (5, 2, 1)
#: Shards that quotas are given to.
SHARDS = 24
SEED = "mix-1"


def words_in(text: Column) -> Column:
    """Runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Sources in code-point order, null last; never null itself."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, copies: int = MOST_COPIES) -> DataFrame:
    """``sizes(__source, source_size)`` with weight, target: one row a source.

    All words are shared by weight; a source stops at ``copies`` times its
    size and what it leaves is shared by the others, until none is above.  In
    order of size by weight, the common share of one weight is the largest of
    (words left after the sources before) / (weights left).
    """
    rank = F.row_number().over(Window.orderBy("__source"))
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    rows = sizes.withColumn("__weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("__weight"), "__source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    onward = F.sum("__weight").over(whole) - F.coalesce(F.sum("__weight").over(before), F.lit(0))
    left = F.sum("source_size").over(whole) - copies * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("__share", left.cast("double") / onward)
    share = F.greatest(F.max("__share").over(whole), F.lit(0.0))
    return rows.withColumn(
        "target", F.least((copies * F.col("source_size")).cast("double"), share * F.col("__weight"))
    ).drop("__share")


def quotas(sized: DataFrame, block_words: int = BLOCK_WORDS, copies: int = MOST_COPIES) -> DataFrame:
    """``targets`` with __blocks (of the source's stream) and __quota (blocks taken).

    The number of blocks is the corpus's words by ``block_words``, rounded.
    A divisor a little too large gives every source a lower bound of its seats
    and one a little too small an upper bound; only the quotients between, at
    most three times as many as sources, are ranked.
    """
    whole = Window.partitionBy()
    rows = sized.withColumns(
        {
            "__blocks": F.ceil(F.col("source_size") / block_words).cast("long"),
            "__seats": F.round(F.sum("source_size").over(whole) / block_words).cast("long"),
            "__all": F.sum("target").over(whole),
            "__n": F.count("*").over(whole),
        }
    )
    large = F.col("__all") / (F.col("__seats") - F.col("__n"))
    small = F.col("__all") / (F.col("__seats") + F.col("__n"))
    rows = rows.withColumns(
        {
            "__low": F.when((F.col("__seats") > F.col("__n")) & (F.col("__all") > 0), F.floor(F.col("target") / large + 0.5)).otherwise(0).cast("long"),
            "__high": F.when(F.col("__all") > 0, F.floor(F.col("target") / small + 0.5)).otherwise(0).cast("long"),
        }
    )
    rows = rows.withColumn("__open", F.col("__seats") - F.sum("__low").over(whole))
    seats = rows.where("__high > __low").select("__source", "target", "__open", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__k"))
    best = F.row_number().over(Window.orderBy(F.desc(F.col("target") / (2 * F.col("__k") - 1)), "__source", "__k"))
    won = seats.withColumn("__rank", best).where("__rank <= __open").groupBy("__source").agg(F.count("*").alias("__won"))
    return rows.join(won, "__source", "left").select(
        "__source",
        "source_size",
        "target",
        "__blocks",
        F.least(F.col("__low") + F.coalesce("__won", F.lit(0)), copies * F.col("__blocks")).alias("__quota"),
    )


def shard_quotas(allotted: DataFrame, shards: int) -> DataFrame:
    """(__source, shard, quota): each source's blocks dealt to the shards in turn, totals at most one apart."""
    start = F.sum("__quota").over(Window.orderBy("__source").rowsBetween(Window.unboundedPreceding, -1))
    rows = allotted.withColumn("__start", F.coalesce(start, F.lit(0)))
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ahead = F.pmod(F.col("shard") - F.col("__start"), F.lit(shards))
    return rows.select("__source", "shard", F.floor((F.col("__quota") - ahead + shards - 1) / shards).cast("long").alias("quota"))


def shard_runs(allotted: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """``allotted`` with __start, the seeded first block, and __runs: each shard's blocks from ``low`` to ``high``.

    Blocks are counted on over several passes: block k of the source stands
    for k, k + __blocks and so on.  One row a source, one run a shard.
    """
    start = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:start:"), F.col("__source"))), 1, 8), 16, 10).cast("long"), F.col("__blocks"))
    dealt = shard_quotas(allotted, shards).groupBy("__source").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("__dealt"))
    rows = allotted.join(dealt, "__source").withColumn("__start", F.when(F.col("__blocks") > 0, start).otherwise(F.lit(0)))

    def run(x: Column, k: Column) -> Column:
        before = F.aggregate(F.slice("__dealt", 1, k), F.lit(0).cast("long"), lambda a, y: a + y["quota"])
        low = F.col("__start") + before
        return F.struct(x["shard"].alias("shard"), low.alias("low"), (low + x["quota"]).alias("high"))

    return rows.withColumn("__runs", F.transform("__dealt", run)).drop("__dealt")


def mixed(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    block_words: int = BLOCK_WORDS,
    weights: tuple[int, ...] = WEIGHTS,
    copies: int = MOST_COPIES,
    seed: str = SEED,
    shards: int = SHARDS,
) -> DataFrame:
    """``documents`` with size, source_size, target, taken, taken_from and taken_by_shard.

    taken_by_shard has (shard, words) for every shard whose blocks of the
    document's source hold words of it; taken is their sum, repeats included,
    and never exceeds ``copies`` times the size.  taken_from is the first word
    of the part taken once more than the rest.  Empty and null texts have size 0
    and take nothing; null is a source of its own, last in order.  Rows equal
    in key, size and text may swap places.  Columns with these names are
    replaced.
    """
    rows = without(documents, ["size", "source_size", "target", "taken", "taken_from", "taken_by_shard"])
    own = rows.columns
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(key).cast("string"), F.lit("~"))))
    tie = F.xxhash64(quoted(text))
    rows = rows.withColumns({"size": words_in(quoted(text)), "__source": _source_key(quoted(source)), "__draw": drawn, "__tie": tie})
    rows = rows.withColumn("__slice", F.substring("__draw", 1, 3))
    sums = rows.groupBy("__source", "__slice").agg(F.sum("size").alias("__words"))
    in_source = Window.partitionBy("__source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sums.select("__source", "__slice", F.coalesce(F.sum("__words").over(in_source), F.lit(0)).alias("__before"))
    sizes = sums.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    plan = slices.join(shard_runs(quotas(targets(sizes, weights, copies), block_words, copies), shards, seed), "__source")
    within = Window.partitionBy("__source", "__slice").orderBy("__draw", "size", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum("size").over(within)).join(plan, ["__source", "__slice"])
    rows = rows.withColumn("__end", F.col("__before") + F.col("__upto")).withColumn("__begin", F.col("__end") - F.col("size"))

    def words(x: Column) -> Column:
        """Words of the document in one shard's run, over all passes that the run can touch."""
        total: Column = F.lit(0).cast("long")
        for turn in range(copies + 1):
            first = F.greatest(x["low"] - turn * F.col("__blocks"), F.lit(0)) * block_words
            last = F.least(F.least(x["high"] - turn * F.col("__blocks"), F.col("__blocks")) * block_words, F.col("source_size"))
            total = total + F.greatest(F.least(F.col("__end"), last) - F.greatest(F.col("__begin"), first), F.lit(0))
        return F.struct(x["shard"].alias("shard"), total.alias("words"))

    parts = F.filter(F.transform("__runs", words), lambda x: x["words"] > 0)
    around = F.when(F.col("__blocks") > 0, F.greatest(F.col("__start") + F.expr("__quota % __blocks") - F.col("__blocks"), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("taken_by_shard", F.when(F.col("size") > 0, parts).otherwise(F.array().cast("array<struct<shard:int,words:bigint>>")))
    return rows.select(
        *map(quoted, own),
        "size",
        "source_size",
        "target",
        F.aggregate("taken_by_shard", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.when(F.col("__begin") < around * block_words, F.lit(0))
        .otherwise(F.greatest(F.col("__start") * block_words - F.col("__begin"), F.lit(0)))
        .alias("taken_from"),
        "taken_by_shard",
    )


def mixed_documents(documents: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the words taken.

    A document in whole passes comes whole each time.  A part (at the ends of
    a source's run of blocks) keeps its words and the white space before
    them; a run that wraps inside one document takes its beginning and its end
    as one part.  Documents of which nothing is taken, empty ones among them,
    are left out.  All columns come as they are, whatever their names; a
    column n_chars, if there, follows the text.
    """
    named = {c: f"__own{k}" for k, c in enumerate(documents.columns)}
    own = documents.select(*[quoted(c).alias(n) for c, n in named.items()])
    words = named[text]
    rows = mixed(own, words, named[source], named[key], **options).where("taken > 0")
    rows = rows.withColumns({"__part": F.expr("taken % size"), "__whole": F.expr("taken div size")})
    rows = rows.withColumn("__turn", F.explode(F.sequence(F.lit(1), (F.col("__whole") + (F.col("__part") > 0).cast("long")).cast("int"))))
    pieces = F.regexp_extract_all(F.col(words), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.expr("__turn > __whole")
    fits = F.col("taken_from") + F.col("__part") <= F.col("size")
    tail = F.col("size") - F.col("taken_from")
    ends = F.concat(F.slice("__pieces", 1, (F.col("__part") - F.greatest(tail, F.lit(0))).cast("int")), F.slice("__pieces", (F.col("taken_from") + 1).cast("int"), tail.cast("int")))
    rows = rows.withColumn("__pieces", F.when(cut, pieces))
    piece = F.when(fits, F.slice("__pieces", (F.col("taken_from") + 1).cast("int"), F.col("__part").cast("int"))).otherwise(ends)
    rows = rows.withColumn(words, F.when(cut, F.array_join(piece, "")).otherwise(F.col(words)))
    kinds = dict(documents.dtypes)
    return rows.select(*[(F.length(words).cast(kinds[c]) if c == "n_chars" else F.col(n)).alias(c) for c, n in named.items()])
