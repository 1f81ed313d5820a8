"""Line dedup by a segment-partition edit join.

Lines whose edit distance is at most ``edits`` are near-duplicates.  A line is
cut into one segment more than that, so a line near it holds one of these
segments unchanged, at a place that the number of edits bounds.  Segments
are indexed with the line's length and the segment's number; a line probes
the lengths up to ``edits`` below its own with the substrings that can match.
Pairs that meet are verified by a banded bit-parallel edit distance.

DataFrame operations only.  Equal lines are one line before any pair is made,
and an index entry holds hashes, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annotide.llm.common import checkpoint, components, quoted

#: Edits that near-duplicate lines may differ by, and characters that a line needs to have near-duplicates.
EDITS, LEAST_CHARS = 2, 24
# Characters counted in 16 classes, by place in this string; common letters fall in different ones.
COUNTED = "etaonirshldcumfpgwybvkxjqzéèêàçùâîôûëïüöäßñíóúá0123456789.,ETAONIRSHLDCUMFPGWYBVKXJQZ"
#: Lines with one entry beyond which pairs are made by their counts of characters.
CROWD = 32
#: Bits of the map that finds the lines of candidate pairs; 16 bytes of broadcast for 64 of them.
FILTER_BITS = 1 << 22


def lines_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, content, line_no, line): lines between line feeds, from 0; blank ones have no row; content is the text's hash."""
    content = F.xxhash64(quoted(text)).alias("content")
    rows = documents.select(quoted(key).alias("doc"), content, F.posexplode(F.split(quoted(text), "\n")).alias("line_no", "line"))
    return rows.where(F.length(F.trim("line")) > 0)


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment, characters fewer, shift): where an indexed line's segment can stand in a line that is near it.

    Lines probe lines of their own length and of up to ``edits`` characters
    fewer.  The places are those that the edits before and after the segment
    allow; the unshifted ones of one length are the index entries themselves.
    """
    found = []
    for fewer in range(edits + 1):
        for number in range(edits + 1):
            low = max(-number, fewer - (edits - number))
            high = min(number, fewer + (edits - number))
            found += [(number, fewer, shift) for shift in range(low, high + 1) if fewer or shift]
    return found


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counts(line: Column) -> Column:
    """How often each class of characters stands in a line, modulo 16: 16 numbers of 4 bits."""
    marks = "0123456789abcdef"
    marked = F.translate(line, COUNTED, "".join(marks[k % 16] for k in range(len(COUNTED))))

    def packed(t: Column) -> Column:
        own = [F.shiftleft((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(m), F.lit("")))).cast("long").bitwiseAND(F.lit(15)), 4 * k) for k, m in enumerate(marks)]
        total = own[0]
        for part in own[1:]:
            total = total.bitwiseOR(part)
        return total

    return _bound(marked, packed)


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """False only for counts that ``edits`` edits can't bring together: an edit changes two by one at most."""
    total: Column = F.lit(0)
    for k in range(16):
        gap = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        total = total + F.least(gap, 16 - gap)
    return total <= 2 * edits


def count_keys(packed: Column, edits: int) -> Column:
    """2 edits + 1 keys of a line's counts; lines within ``edits`` edits have one in common.

    The 16 counts fall into so many groups, and edits change their sum by twice
    their number at most, so one group stays as it is.
    """
    parts = min(16, 2 * edits + 1)
    edges = [16 * k // parts for k in range(parts + 1)]
    keys = []
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        own = F.shiftrightunsigned(packed, 4 * a).bitwiseAND(F.lit((1 << 4 * (b - a)) - 1)).cast("long")
        keys.append(own.bitwiseOR(F.lit(k << 56).cast("long")))
    return F.array(*keys)


def entries(lines: DataFrame, places: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """(entry, id, indexed): a hash of (length, segment, substring) for each of ``places`` in each line.

    indexed tells the line's own segments from its probes of other lines.
    Segments' lengths differ by one at most, the longer ones last.  Lines are
    cut as four bytes a character, where a place needs no search.
    """
    shapes = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("f"), F.lit(s).alias("s")) for n, f, s in places])
    rows = lines.withColumn("chars", F.encode("line", "UTF-32")).select("id", "size", "chars", F.explode(shapes).alias("at"))
    length = F.col("size") - F.col("at.f")
    short = (length / (edits + 1)).cast("int")
    shorter = edits + 1 - length % (edits + 1)
    begin = short * F.col("at.n") + F.greatest(F.col("at.n") - shorter, F.lit(0)) + F.col("at.s")
    width = F.when(F.col("at.n") < shorter, short).otherwise(short + 1)
    piece = F.substring("chars", begin * 4 + 1, width * 4)
    indexed = (F.col("at.f") == 0) & (F.col("at.s") == 0)
    return rows.select(F.xxhash64(length, F.col("at.n"), piece).alias("entry"), "id", indexed.alias("indexed"))


def trimmed(a: Column, b: Column) -> Column:
    """Both strings without most of their common beginning and end, as a struct (a, b)."""
    steps = F.array(*[F.lit(n) for n in (4096, 4096, 1024, 1024, 1024, 256, 256, 256, 64, 64, 64, 16, 16, 16, 4, 4, 4)])
    start = F.struct(a.alias("a"), b.alias("b"))

    def front(acc: Column, n: Column) -> Column:
        same = (F.length(acc["a"]) >= n) & (F.length(acc["b"]) >= n) & (F.substring(acc["a"], F.lit(1), n) == F.substring(acc["b"], F.lit(1), n))
        return F.when(same, F.struct(F.substring(acc["a"], n + 1, F.length(acc["a"])).alias("a"), F.substring(acc["b"], n + 1, F.length(acc["b"])).alias("b"))).otherwise(acc)

    def back(acc: Column, n: Column) -> Column:
        left, right = F.length(acc["a"]), F.length(acc["b"])
        same = (left >= n) & (right >= n) & (F.substring(acc["a"], left - n + 1, n) == F.substring(acc["b"], right - n + 1, n))
        return F.when(same, F.struct(F.substring(acc["a"], F.lit(1), left - n).alias("a"), F.substring(acc["b"], F.lit(1), right - n).alias("b"))).otherwise(acc)

    return F.aggregate(steps, F.aggregate(steps, start, front), back)


def banded(a: Column, b: Column, edits: int) -> Column:
    """The last band of the edit matrix of two arrays of characters: plus, minus, score.

    One machine word holds the vertical differences of the band of 2 edits + 1
    cells around the diagonal (Hyyrö's banded form of Myers' columns).  The
    word slides down one row for every character of ``b`` and is kept aligned
    for the next column; the band's lowest cell is followed along the diagonal.
    """
    band = 2 * edits + 1
    mask = (1 << band) - 1
    places = F.array(*[F.lit(k) for k in range(band)])

    def step(acc: Column, j: Column) -> Column:
        # bit k of the word is row j - edits + k of the matrix (rows from 1)
        near = F.slice(a, F.greatest(j - edits, F.lit(1)), F.lit(band) - F.greatest(edits + 1 - j, F.lit(0)))
        ahead = F.greatest(edits + 1 - j, F.lit(0))  # rows before the first
        same = F.aggregate(
            places,
            F.lit(0),
            lambda bits, k: bits.bitwiseOR(F.when(F.get(near, k - ahead) == F.get(b, j - 1), F.element_at(powers, k + 1)).otherwise(F.lit(0))),
        )

        def column(match: Column) -> Column:
            plus, minus = acc["plus"], acc["minus"]
            summed = (match.bitwiseAND(plus) + plus).bitwiseXOR(plus)
            return _bound(summed.bitwiseOR(match).bitwiseOR(minus).bitwiseAND(F.lit(mask)), slide)

        def slide(diagonal: Column) -> Column:
            plus, minus = acc["plus"], acc["minus"]
            up = minus.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(plus)).bitwiseAND(F.lit(mask)))
            shifted = F.shiftright(diagonal, 1)
            return F.struct(
                diagonal.bitwiseAND(plus).bitwiseOR(F.bitwise_not(shifted.bitwiseOR(up)).bitwiseAND(F.lit(mask))).alias("plus"),
                up.bitwiseAND(shifted).alias("minus"),
                (acc["score"] + 1 - F.shiftright(diagonal, band - 1)).alias("score"),
            )

        return _bound(same, column)

    powers = F.array(*[F.lit(1 << k) for k in range(band)])
    first = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).alias("plus"), F.lit(0).alias("minus"), F.lit(edits).alias("score"))
    return F.aggregate(F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>")), first, step)


def within(state: Column, m: Column, n: Column, edits: int) -> Column:
    """Whether the distance is at most ``edits``, from the last band of arrays of ``m`` and ``n`` characters.

    The lowest cell of the last column is row n + edits; its differences lead
    up the column to row m.
    """
    band = 2 * edits + 1
    last: Column = state["score"]
    for k in range(band - 1):
        bit = F.lit(1 << (band - 2 - k))
        back = (state["minus"].bitwiseAND(bit) != 0).cast("int") - (state["plus"].bitwiseAND(bit) != 0).cast("int")
        last = last + F.when(n + edits - m > k, back).otherwise(F.lit(0))
    return F.when(F.abs(m - n) > edits, F.lit(False)).when(n == 0, m <= edits).otherwise(last <= edits)


def alike(pairs: DataFrame, left: str, right: str, edits: int) -> DataFrame:
    """The rows of ``pairs`` whose two strings are within ``edits`` edits, without those strings.

    The banded bit-parallel distance decides; lengths and counts of characters
    only spare it pairs that they rule out.
    """
    pairs = pairs.where(F.abs(F.length(quoted(left)) - F.length(quoted(right))) <= edits)
    pairs = pairs.where(may_be_near(counts(quoted(left)), counts(quoted(right)), edits))
    others = [quoted(c) for c in pairs.columns if c not in (left, right)]
    clean = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    core = trimmed(quoted(left), quoted(right))

    def compared(chars: Column) -> Column:
        x, y = chars["x"], chars["y"]
        state = F.struct(F.size(x).alias("m"), F.size(y).alias("n"), banded(x, y, edits).alias("state"))
        return _bound(state, lambda k: within(k["state"], k["m"], k["n"], edits))

    # each value bound and the answer in one expression: the optimiser can neither repeat them nor move them into a loop
    near = _bound(core, lambda c: _bound(F.struct(clean(c["a"]).alias("x"), clean(c["b"]).alias("y")), compared))
    return pairs.where(near).select(*others)


def _held(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``lines(id, ..)`` whose id may be in ``ids(id)``: all that are, and few others.

    A bit map of FILTER_BITS bits, 64 in a row, is broadcast; it has that size at most.
    """
    slot = F.pmod(F.xxhash64("id", F.lit("slot")), F.lit(FILTER_BITS))
    bits = ids.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, 'slot'), {FILTER_BITS}) % 64 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    rows = lines.withColumns({"__slot": slot, "word": (slot / 64).cast("int")}).join(F.broadcast(words), "word")
    return rows.where("shiftrightunsigned(bits, cast(__slot % 64 as int)) & 1 = 1").select(*lines.columns)


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): ids of the different lines in ``lines(line)`` within ``edits`` edits, each pair once.

    An id is the line's 64-bit hash.  Each different line has its probes made
    once; texts come back only for lines of pairs that met.  The
    lines of an entry that more than CROWD lines have make a pair only if
    their counts of characters allow it.
    """
    known = lines.select("line").distinct().select(F.xxhash64("line").alias("id"), "line", F.length("line").alias("size"))
    own = [(n, 0, 0) for n in range(edits + 1)]
    order = Window.partitionBy("entry").orderBy("id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = entries(known, own, edits).withColumns({"crowd": F.count("*").over(whole), "place": F.row_number().over(order)})
    # a crowded entry is held by one row only, so a probe meets CROWD rows at most
    held = held.where((F.col("crowd") <= CROWD) | (F.col("place") == 1)).select("entry", "id", (F.col("crowd") > CROWD).alias("crowded"))
    asked = entries(known, own + probes(edits), edits).select("entry", F.col("id").alias("other"), "indexed")
    # pairs and the rows of crowded entries leave by one join, so probes are cut and shuffled once
    met = asked.join(held, "entry").where(F.expr("crowded or id < other or (not indexed and id > other)"))
    rows = checkpoint(
        met.select(
            F.when(~F.col("crowded"), 0).when(F.col("indexed"), 1).otherwise(2).alias("kind"),
            F.when(F.col("crowded"), F.col("entry")).otherwise(F.least("id", "other")).alias("a"),
            F.when(F.col("crowded"), F.col("other")).otherwise(F.greatest("id", "other")).alias("b"),
        )
    )
    pairs = rows.where("kind = 0").select("a", "b")
    many = rows.where("kind = 1").select(F.col("a").alias("entry"), F.col("b").alias("id"))
    asking = rows.where("kind = 2").select(F.col("a").alias("entry"), F.col("b").alias("other"))
    involved = many.select("id").union(asking.select("other")).distinct()
    marked = _held(lines.select(F.xxhash64("line").alias("id"), "line"), involved).distinct().select("id", counts(F.col("line")).alias("counts"))
    marked = checkpoint(marked)
    crowded = many.join(marked, "id")
    others = marked.select(F.col("id").alias("other"), F.col("counts").alias("other_counts"))
    asking = asking.join(others, "other").withColumn("ordered", F.lit(False))
    equal = crowded.select("entry", F.col("id").alias("other"), F.col("counts").alias("other_counts"), F.lit(True).alias("ordered"))
    near = may_be_near(F.col("counts"), F.col("other_counts"), edits)
    crowded = crowded.withColumn("key", F.explode(count_keys(F.col("counts"), edits)))
    asking = asking.unionByName(equal).withColumn("key", F.explode(count_keys(F.col("other_counts"), edits)))
    met = crowded.join(asking, ["entry", "key"]).where(near & F.expr("id < other or (not ordered and id > other)"))
    pairs = checkpoint(pairs.union(met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))).distinct())
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    texts = _held(lines.select(F.xxhash64("line").alias("id"), "line"), ids).distinct()
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("left")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("line").alias("right")), "b"
    )
    return alike(both, "left", "right", edits)


def line_dedup(documents: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, n_lines, n_kept, n_links, dropped): one row for each document with lines that are not blank.

    Lines are in one class if they are equal or linked, directly or through
    others; links need both lines to have ``least_chars`` characters.  A
    class keeps its first line, by key and then by line number; dropped lists
    the numbers of the others in the document.  n_links sums, over a
    document's lines, the different lines within ``edits`` edits.  Documents
    without lines (null, empty or blank texts) have no row.  Rows that repeat
    a key with another text are documents of their own, ordered by the text's
    hash; rows equal in key and text are one document.  Lines and texts are
    told apart by 64-bit hashes: of n different lines about n * n / 2^65 pairs
    share one.
    """
    rows = documents.select(quoted(key).alias("__doc"), quoted(text).alias("__text"))
    found = lines_of(rows, "__doc", "__text")
    near = near_lines(found.where(F.length("line") >= least_chars).select("line"), edits)
    links = checkpoint(near)
    classes = components(links)
    degrees = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    classes = classes.join(degrees, F.col("node") == F.col("id")).select("id", "component", "links")
    place = F.struct(F.col("doc").isNull().alias("missing"), "doc", "content", "line_no")
    placed = checkpoint(found.select("doc", "content", "line_no", F.xxhash64("line").alias("id")))
    firsts = placed.groupBy("id").agg(F.min(place).alias("first"))
    firsts = firsts.join(classes, "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    leads = firsts.groupBy("component").agg(F.min("first").alias("lead"))
    named = firsts.join(leads, "component").select("id", "links", "lead")
    marked = placed.join(named, "id").withColumn("kept", place.eqNullSafe(F.col("lead")))
    lines = F.collect_set(F.struct("line_no", "kept", F.col("links").cast("long").alias("links")))  # a repeated row adds none
    own = marked.groupBy("doc", "content").agg(F.array_sort(lines).alias("lines"))
    dropped = F.transform(F.filter("lines", lambda x: ~x["kept"]), lambda x: x["line_no"])
    return own.select(
        F.col("doc").alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x["kept"])).cast("long").alias("n_kept"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["links"]).alias("n_links"),
        F.array_join(dropped, ",").alias("dropped"),
    )
