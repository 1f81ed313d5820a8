"""Every training-data operator against a brute-force version, and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from annotide.llm import decontamination, licences, line_dedup, mixing, neighbours, queries, sharding, simhash, tokens, toxicity, url_filters
from annotide.llm.common import components, joined_once

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, leaks string, size string"
LONG = "word " * 60_000 + "Apache License"
AWKWARD = [
    (1, None, None, None, None, "x", "y", "z", "w"),
    (2, "", "en", "a", 0, "x", "y", "z", "w"),
    (3, LONG, "en", "a", len(LONG), None, None, None, None),
    (4, "Ünïcode \t\n words\x0b here CC BY cc by", "de", "b", 30, None, None, None, None),
    (4, "Ünïcode \t\n words\x0b here CC BY cc by", "de", "b", 30, None, None, None, None),
    (5, "Ünïcode \t\n words\x0b here CC BY cc by", "de", None, 30, None, None, None, None),
    (None, "a line of its own with words", "de", "b", 20, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


# ------------------------------------------------------------------ licences


def plain_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences_equal_brute_force(spark, documents, awkward):
    spark.sql("select 1")
    for rows in (documents, awkward):
        texts = sorted((plain_licences(r["text"]) for r in rows.select("text").collect()), key=str)
        found = licences.with_licences(rows.select("doc_id", "text"))
        got = []
        for r in found.collect():
            own = [m for m in r["licences"] if m["is_phrase"]]
            starts = [m["start_word"] for m in own]
            got.append((r["n_words"], len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted({m["label"] for m in own}))))
        assert sorted(got, key=str) == texts


def test_licence_templates_need_their_key_phrases():
    index = licences.build_index({}, 0)
    text = next(t for label, t, _ in licences.TEMPLATES if label == "mit-text")
    shifted = "Copyright someone. " + text.replace("free of charge", "free of charge,").replace("sublicense", "sub license")
    broken = text.replace("hereby granted", "granted")
    found = [{m["label"] for m in own} for own in licences.scan(index, [text, shifted, broken, "nothing at all"])[1]]
    assert found == [{"mit-text"}, {"mit-text"}, set(), set()]
    for label, words, _ in licences.TEMPLATES:
        assert label in {m["label"] for m in licences.scan(index, [f"x {words} y"])[1][0]}


def test_mandatory_phrases_alone_are_found_for_any_counts():
    draw = random.Random(5)
    _, number = licences.vocabulary()
    for counts in ({}, {w: 100 for w in number.values()}, *({w: draw.randint(0, 100) for w in number.values()} for _ in range(10))):
        index = licences.build_index(counts, 100)
        for label, _, keys in licences.TEMPLATES:
            text = " ".join(keys)
            other = " ".join(["some", "other", "words", *keys[0].split()[:-1]])
            found = licences.scan(index, [other, text, f"x {text} y", text + " z " * 200 + text])[1]
            assert label not in {m["label"] for m in found[0]} and label in {m["label"] for m in found[1]} & {m["label"] for m in found[2]}
            assert [m["start_word"] for m in found[3] if m["label"] == label] == [0, len(text.split()) + 200]


def test_every_place_of_a_template_is_reported():
    index = licences.build_index({}, 0)
    found = licences.scan(index, ["gnu lesser general public license " * 3, "gnu lesser general", "public license"])[1]
    assert [(m["start_word"], m["end_word"]) for m in found[0] if m["label"] == "lgpl"] == [(0, 5), (5, 10), (10, 15)]
    assert not found[1] and not found[2]  # not across texts


def test_licences_of_no_rows(empty):
    assert licences.with_licences(empty).count() == 0


# ------------------------------------------------------------------ sharding


@pytest.mark.parametrize("bucket_bytes", [1 << 10, 1 << 30])
def test_shards_hold_every_row_once(documents, awkward, bucket_bytes):
    for rows in (documents, awkward.drop("shard")):
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
        got = sharding.shuffled_shards(rows, size, 24, bucket_bytes=bucket_bytes).collect()
        want = Counter(tuple(r) for r in rows.collect())
        assert Counter(tuple(r)[:-2] for r in got) == want
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        counts = [len(slots[k]) for k in range(24)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_do_not_depend_on_partitions(documents):
    size = F.octet_length("text")
    a = sharding.shuffled_shards(documents, size, 24, bucket_bytes=1 << 14).collect()
    b = sharding.shuffled_shards(documents.repartition(7), size, 24, bucket_bytes=1 << 14).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    order = [r["doc_id"] for r in sorted(a, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)


def test_equal_rows_are_held_once_and_all_come_back(spark):
    rows = spark.range(2000).select(F.lit("same").alias("text"))
    got = sharding.shuffled_shards(rows, F.lit(1000), 3, bucket_bytes=100_000)
    assert sorted((r["shard"], r["count"]) for r in got.groupBy("shard").count().collect()) == [(0, 667), (1, 667), (2, 666)]


def test_unequal_rows_never_become_copies_of_one_another(spark):
    schema = "lang string, source string, tags map<string, string>, deep struct<m: map<string, int>>, many array<string>, at timestamp, raw binary, n double"
    rows = [("web", None, None, None, None, None, None, None), (None, "web", None, None, None, None, None, None), (None, None, {"a": "b"}, None, None, None, None, None)]
    rows += [(None, None, {"a": "c"}, None, None, None, None, None), (None, None, {"a": None}, None, None, None, None, None), (None, None, {}, None, None, None, None, None)]
    rows += [(None, None, None, ({"x": 1},), None, None, None, 0.5), (None, None, None, ({"x": 2},), None, None, None, 0.5), (None, None, None, (None,), None, None, None, 0.5)]
    rows += [(None, None, None, None, ["p", None], None, b"a", None), (None, None, None, None, [None, "p"], None, b"b", None), (None,) * 8]
    table = spark.createDataFrame([r for k, r in enumerate(rows) for _ in range(1 + k % 4)], schema)
    times = table.limit(2).withColumn("at", F.timestamp_micros(F.when(F.col("lang").isNull(), 1).otherwise(2).cast("long")))
    table = table.unionByName(times).unionByName(times)
    got = sharding.shuffled_shards(table.repartition(3), F.lit(8), 5, bucket_bytes=64)
    assert Counter(str(tuple(r)[:-2]) for r in got.collect()) == Counter(str(tuple(r)) for r in table.collect())


def test_equal_hashes_don_t_make_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(sharding, "record_hash", lambda *_: F.lit(1).cast("long"))
    table = spark.createDataFrame([(k // 2 % 3, "ab"[k % 2], {"k": k % 4}) for k in range(48)], "n int, t string, m map<string, int>")
    got = sharding.shuffled_shards(table, F.lit(8), 5)
    assert Counter(str(tuple(r)[:-2]) for r in got.collect()) == Counter(str(tuple(r)) for r in table.collect())


def test_shards_of_no_rows(empty):
    assert sharding.shuffled_shards(empty, F.lit(1), 24).count() == 0


# ------------------------------------------------------------------ line dedup


def test_banded_distance_equals_plain_one(spark):
    draw = random.Random(5)
    rows = []
    for i in range(400):
        a = "".join(draw.choice("abé") for _ in range(draw.randint(0, 14)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "é", "d"])
        rows.append((i, a, "".join(b)))
    table = spark.createDataFrame(rows, "i int, a string, b string")
    for edits in (1, 2, 3):
        got = {r[0] for r in line_dedup.alike(table, "a", "b", edits).collect()}
        assert got == {i for i, a, b in rows if edit_distance(a, b) <= edits}


def plain_line_dedup(rows, edits, least):
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" ")]
    texts = sorted({x for _, _, x in lines})
    parent = {x: x for x in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    first = {}
    for d, i, x in sorted(lines):
        first.setdefault(root(x), (d, i))
    out = {}
    for d, i, x in sorted(lines):
        own = out.setdefault(d, [0, 0, 0, []])
        own[0] += 1
        own[2] += links[x]
        if first[root(x)] == (d, i):
            own[1] += 1
        else:
            own[3].append(str(i))
    return {d: (a, b, c, ",".join(x)) for d, (a, b, c, x) in out.items()}


@pytest.mark.parametrize("crowd", [32, 1])
def test_line_dedup_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(30)) for _ in range(12)]
    rows = []
    for d in range(40):
        own = []
        for _ in range(draw.randint(0, 5)):
            x = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                at = draw.randrange(len(x))
                x[at : at + draw.randint(0, 1)] = draw.choice(["", "é", "zz"])
            own.append("".join(x))
        rows.append((d, "\n".join([*own, "short", "", "  "])))
    rows.append((99, None))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), edits=2, least_chars=10)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == plain_line_dedup(rows, 2, 10)


def test_the_banded_distance_decides(spark):
    draw = random.Random(13)
    pairs = []
    for _ in range(400):
        a = "".join(draw.choice("abcé ") for _ in range(draw.randint(0, 60)))
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(b) + 1)
            b[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "é"])
        pairs.append((len(pairs), a, "".join(b)))
    table = spark.createDataFrame(pairs, "n int, a string, b string")
    for edits in (1, 2):
        near = line_dedup.alike(table, "a", "b", edits)
        assert "levenshtein" not in near._jdf.queryExecution().optimizedPlan().toString()
        assert {r["n"] for r in near.collect()} == {n for n, a, b in pairs if edit_distance(a, b) <= edits}


def test_near_lines_share_a_key_of_their_counts(spark):
    draw = random.Random(14)
    rows = []
    for _ in range(300):
        a = "".join(draw.choice(line_dedup.COUNTED) for _ in range(40))
        b = list(a)
        for _ in range(2):
            at = draw.randrange(len(b))
            b[at : at + draw.randint(0, 1)] = draw.choice(["", *line_dedup.COUNTED])
        rows.append((a, "".join(b)))
    keys = [line_dedup.count_keys(line_dedup.counts(F.col(c)), 2).alias(c) for c in "ab"]
    assert all(set(r["a"]) & set(r["b"]) for r in spark.createDataFrame(rows, "a string, b string").select(*keys).collect())


def test_lines_of_repeated_rows(spark):
    line = "a line that is long enough to be here"
    rows = [(1, line), (1, line), (1, f"{line}\nanother line"), (2, line)]
    got = [tuple(r) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got)[2] == (2, 1, 0, 0, "0") and len(got) == 3
    assert sum(r[2] for r in got) == 2 and {r[:2] for r in got} == {(1, 1), (1, 2), (2, 1)}


def test_line_dedup_of_awkward_rows(awkward, empty):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(awkward).collect()}
    assert 1 not in got and 2 not in got and got[3]["n_kept"] == 1
    assert got[5]["n_kept"] == 0 and got[None]["n_lines"] == 1
    assert line_dedup.line_dedup(empty).count() == 0


# ------------------------------------------------------------------ neighbours


def plain_nearest(vectors, asks, k):
    out = {}
    for q, v in vectors:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q)
            out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours_reach_nine_tenths(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()], np.float64)
    got = defaultdict(list)
    for r in neighbours.nearest(rows, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
    hits = 0
    for q in range(0, len(x), 20):
        scores = x @ x[q]
        scores[q] = -9
        best = set(np.argsort(-scores, kind="stable")[:20].tolist())
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        hits += len(best & {v for _, v, _ in got[q]})
    assert hits / (20 * len(range(0, len(x), 20))) >= 0.9


def test_neighbours_of_few_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_repeated_ids_and_long_vectors(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 6)) * 1e8
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(20, (x[20] + 1e9).tolist()), (7, x[7].tolist())]
    x[20] = min(rows[20][1], rows[300][1])
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)  # bins with several blocks of queries
    monkeypatch.setattr(neighbours, "BIN_ROWS", 20)
    monkeypatch.setattr(neighbours, "LEAST_CANDIDATES", 300)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 300, 20):
        scores = (x * x[q]).sum(1)
        order = [k for k in np.lexsort((np.arange(300), -scores)) if k != q][:20]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == order


def test_walk_visits_cells_by_falling_sum():
    draw = np.random.default_rng(0)
    left, right = draw.normal(size=7), draw.normal(size=5)
    sums = (left[:, None] + right[None, :]).ravel()
    order = neighbours.walk(left, right, np.ones(35, np.int64), 20)
    assert order == np.argsort(-sums, kind="stable")[:20].tolist()


# ------------------------------------------------------------------ decontamination


def test_prefix_distance_equals_plain_one():
    draw = random.Random(2)
    for _ in range(300):
        item = [draw.randint(0, 4) for _ in range(draw.randint(1, 12))]
        text = [draw.randint(0, 4) for _ in range(draw.randint(0, 16))]
        mask = {}
        for i, w in enumerate(item):
            mask[w] = mask.get(w, 0) | 1 << i
        best = min((edit_distance(item, text[:j]), j) for j in range(len(text) + 1))
        distance, end = decontamination.prefix_distance(mask, len(item), text, len(item))
        assert distance == best[0] and edit_distance(item, text[:end]) == distance


def test_leaks_are_found_and_clean_texts_left_alone(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    plain = lambda s: " " + " ".join(re.findall("[0-9a-z\u0080-￿]+", s.lower())) + " "
    tests = [(r["item_id"], plain(r["text"])) for r in items.collect()]
    rows = [(r["doc_id"], plain(r["text"])) for r in documents.collect()]
    want = {(d, i) for d, t in rows for i, x in tests if x in t}
    got = {(r["doc_id"], leak["item_id"]): leak["distance"] for r in decontamination.with_leaks(documents, items).collect() for leak in r["leaks"]}
    assert want <= set(got) and all(got[p] == 0 for p in want)
    for (d, i), distance in got.items():
        size = len(dict(tests)[i].split())
        assert distance <= decontamination.allowed(size)


def test_edited_leaks_reach_the_target_recall(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    plan = decontamination.build_plan([i for i, _ in items], [t for _, t in items])
    draw = random.Random(9)
    found = 0
    for item, text in items:
        words = re.findall("[0-9a-z\u0080-￿]+", text.lower())
        for _ in range(decontamination.allowed(len(words))):
            at = draw.randrange(len(words))
            words[at : at + draw.randint(0, 1)] = draw.choice([[], [f"zz{draw.random()}".replace(".", "")]])
        found += item in {m["item_id"] for m in decontamination.find(plan, ["some words before " + " ".join(words) + " and after"])[0]}
    assert found >= 0.95 * len(items)


@pytest.mark.parametrize("size", [5, 17, 40, 120, 300])
@pytest.mark.parametrize("kind", ["first words missing", "first words new", "last words missing", "in one place", "scattered"])
def test_no_leak_is_lost_wherever_its_edits_are(kind, size):
    draw = random.Random(size)
    items = [[f"i{draw.randrange(3000)}" for _ in range(size)] for _ in range(40)]
    plan = decontamination.build_plan(list(range(40)), [" ".join(x) for x in items])
    edits = decontamination.allowed(size)
    for k, item in enumerate(items):
        new = [f"zz{draw.random()}".replace(".", "") for _ in range(edits)]
        middle = size // 3
        places = sorted(draw.sample(range(size), edits))
        copy = {
            "first words missing": item[edits:],
            "first words new": new + item[edits:],
            "last words missing": item[:-edits],
            "in one place": item[:middle] + new + item[middle + edits :],
            "scattered": [new[places.index(i)] if i in places else w for i, w in enumerate(item)],
        }[kind]
        found = {m["item_id"]: m for m in decontamination.find(plan, ["zzbefore it " + " ".join(copy) + " zzand after"])[0]}
        assert k in found and found[k]["distance"] <= edits


def test_found_places_equal_plain_ones():
    draw = random.Random(4)
    for _ in range(150):
        items = [[f"w{draw.randrange(6)}" for _ in range(draw.randint(1, 14))] for _ in range(3)]
        words = [f"w{draw.randrange(7)}" for _ in range(draw.randint(0, 30))]
        plan = decontamination.build_plan([0, 1, 2], [" ".join(x) for x in items])
        got = {m["item_id"]: (m["distance"], m["start_word"], m["end_word"]) for m in decontamination.find(plan, ["w0 w1 w2", " ".join(words)])[1]}
        for k, item in enumerate(items):
            own = [
                (edit_distance(item, words[a:b]), a, b)
                for a in range(len(words))
                if any(words[a] in x for x in items)
                for b in range(a + 1, min(len(words), a + 2 * len(item)) + 1)
            ]
            best = min(own, default=(99, 0, 0))
            assert got.get(k) == (best if best[0] <= decontamination.allowed(len(item)) else None)


@pytest.mark.parametrize("size", [20, 60, 200, 800])
def test_long_items_with_all_their_edits_are_found(size):
    draw = random.Random(size)
    items = [[f"i{draw.randrange(4000)}" for _ in range(size)] for _ in range(30)]
    plan = decontamination.build_plan(list(range(30)), [" ".join(x) for x in items])
    edits, found = decontamination.allowed(size), 0
    for k, item in enumerate(items):
        copy = list(item)
        for n in range(edits):
            kind, at = draw.randrange(3), draw.randrange(len(copy)) if n else 0  # the first word too
            copy[at : at + (kind != 1)] = [f"zz{draw.randrange(10**9)}"] if kind < 2 else []
        found += k in {m["item_id"] for m in decontamination.find(plan, ["zzbefore " + " ".join(copy) + " zzafter"])[0]}
    assert found >= 0.95 * 30


def test_leaks_equal_brute_force(spark, documents):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = [(r["item_id"], r["text"]) for r in items.collect()]
    edited = [(10**6 + i, "zz " + " ".join(w for k, w in enumerate(t.split()) if k % 7 != 3) + " zz") for i, t in texts]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    plan = decontamination.build_plan([i for i, _ in texts], [t for _, t in texts])
    want = set()
    for doc, text in [tuple(r) for r in rows.collect()]:
        words = decontamination.joined_words([text.lower().encode()])[0].tolist()
        for k, item in enumerate(plan.ids):
            distance, _ = decontamination.nearest_ends(plan.masks[k], len(plan.words[k]), words)
            if distance <= decontamination.allowed(len(plan.words[k])):
                want.add((doc, item, distance))
    got = {(r["doc_id"], leak["item_id"], leak["distance"]) for r in decontamination.with_leaks(rows, items).collect() for leak in r["leaks"]}
    assert len(want) > 40 and got == want


def test_an_id_stays_in_one_block_of_items(spark):
    items = spark.createDataFrame([(k // 2, f"word{k} " * 40) for k in range(8)], "item_id long, text string")
    blocks = list(decontamination.item_blocks(items, 300))
    assert [sorted(set(ids)) for ids, _ in blocks] == [[0], [1], [2], [3]]


def test_leaks_of_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "???"), (4, "words here cc by"), (4, "words here cc by"), (None, "a line")], "item_id long, text string")
    got = [(r["doc_id"], [m["item_id"] for m in r["leaks"]]) for r in decontamination.with_leaks(awkward, items).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (3, []), (4, [4]), (4, [4]), (5, [4]), (None, []), (None, [])], key=str)
    assert decontamination.with_leaks(empty, items).count() == 0
    assert decontamination.with_leaks(awkward, items.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_items_beyond_one_block_take_more_passes(spark, awkward, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} words here cc by") for i in range(3)] + [(9, "words here cc by")], "item_id long, text string")
    blocks = [([0, 1], ["item number", "b"]), ([9], ["words here cc by"])]
    monkeypatch.setattr(decontamination, "item_blocks", lambda x: iter(blocks))
    got = decontamination.with_leaks(awkward.where("doc_id = 5"), items).collect()
    assert [m["item_id"] for m in got[0]["leaks"]] == [9]


# ------------------------------------------------------------------ mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: capped.get(s, share * weight[s]) for s in order}
        capped |= {s: 3 * sizes[s] for s in over}


def test_mix_takes_what_targets_ask(documents):
    rows = mixing.mixed(documents).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = plain_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_WORDS


def test_quotas_are_the_highest_quotients(spark):
    draw = random.Random(4)
    for n in (1, 2, 7):
        sizes = [(f"0{k}", draw.randint(1, 4000)) for k in range(n)]
        table = spark.createDataFrame(sizes, "__source string, source_size long")
        got = {r["__source"]: r for r in mixing.quotas(mixing.targets(table)).collect()}
        seats = round(sum(s for _, s in sizes) / mixing.BLOCK_WORDS + 1e-9)
        best = sorted(((-r["target"] / (2 * k - 1), s) for s, r in got.items() for k in range(1, seats + 1)))[:seats]
        assert {s: r["__quota"] for s, r in got.items()} == {s: sum(1 for _, x in best if x == s) for s in got}
        dealt = mixing.shard_quotas(mixing.quotas(mixing.targets(table)), 4).collect()
        assert {s: sum(r["quota"] for r in dealt if r["__source"] == s) for s in got} == {s: r["__quota"] for s, r in got.items()}
        by_shard = Counter()
        for r in dealt:
            by_shard[r["shard"]] += r["quota"]
        assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mixed_documents_have_the_words_taken(documents, awkward, empty):
    for rows in (documents, awkward):
        taken = sum(r["taken"] for r in mixing.mixed(rows).collect())
        mix = mixing.mixed_documents(rows)
        assert mix.columns == rows.columns
        got = mix.select(mixing.words_in(F.col("text")).alias("n"), "text", "n_chars").collect()
        assert sum(r["n"] for r in got) == taken and all(r["n"] > 0 and r["n_chars"] == len(r["text"]) for r in got)
    assert mixing.mixed(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_of_awkward_rows(awkward):
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r["taken"] == 0 for r in rows if not r["text"])
    again = mixing.mixed(awkward.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


# ------------------------------------------------------------------ toxicity


def test_toxicity_finds_held_out_insults(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op7_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    flagged = [r["toxic"] for r in held if r["predicted"]]
    caught = [r["predicted"] for r in held if r["toxic"]]
    assert sum(flagged) / len(flagged) >= 0.9 and sum(caught) / len(caught) >= 0.7
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_hidden_insults_score_like_plain_ones():
    draw = random.Random(1)
    words = ["".join(draw.choice("aeiournstl") for _ in range(draw.randint(3, 8))) for _ in range(300)]
    rows = []
    for k in range(400):
        own = draw.choices(words, k=30)
        if k % 4 == 0:
            own[draw.randrange(30)] = draw.choice(["numbskull", "blockhead"])
        rows.append((" ".join(own) + ".", int(k % 4 == 0)))
    model = toxicity.train(rows)
    plain, dotted, spaced, clean, blank = toxicity.score_texts(model, ["you numbskull", "you n.u.m.b.s.k.u.l.l", "you n u m b s k u l l", " ".join(words[:30]), ""])
    assert plain > 0.7 and dotted > 0.7 and spaced > 0.7 and clean < 0.3 and blank < 0.3


def test_subsequence_weights_equal_the_kernel():
    rows = [("some plain words here", 0), ("an insult word here", 1)]
    model = toxicity.Model(toxicity._alphabet([t for t, _ in rows]), None, 1.0, 0.0)
    codes = model.encode(" insult ")
    index, weight = toxicity.subsequences(codes)
    table = np.zeros(toxicity.SIZE**toxicity.ORDER, np.float32)
    np.add.at(table, index, weight)
    want = defaultdict(float)
    for places in __import__("itertools").combinations(range(len(codes)), toxicity.ORDER):
        span = places[-1] - places[0]
        if span < toxicity.SPAN:
            want[tuple(int(codes[p]) for p in places)] += toxicity.DECAY ** (span - toxicity.ORDER + 1)
    for key, value in want.items():
        at = sum(c * int(p) for c, p in zip(key, toxicity.POWERS, strict=True))
        assert table[at] == pytest.approx(value, rel=1e-5)


def plain_kernel(a, b):
    """Common subsequences of two encoded strings, weighted by the decay of both, by listing them all."""
    import itertools

    def listed(codes):
        out = defaultdict(float)
        for places in itertools.combinations(range(len(codes)), toxicity.ORDER):
            if places[-1] - places[0] < toxicity.SPAN and all(codes[p] for p in places):
                out[tuple(int(codes[p]) for p in places)] += toxicity.DECAY ** (places[-1] - places[0] - toxicity.ORDER + 1)
        return out

    x, y = listed(a), listed(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_machine_equals_a_plain_one_on_the_kernel():
    draw = random.Random(6)
    model = toxicity.Model(toxicity._alphabet(["abcdefgh"]), None, 1.0, 0.0)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(5, 9))) for _ in range(40)]
    codes = [model.encode(f" {w} ") for w in words]
    nystrom = toxicity._Nystrom(codes)
    x = nystrom(codes)
    size = [plain_kernel(c, c) ** 0.5 for c in codes]
    for i in range(0, 40, 3):  # with every string a landmark, features give the kernel itself
        for j in range(0, 40, 7):
            assert x[i] @ x[j] == pytest.approx(plain_kernel(codes[i], codes[j]), rel=0.05, abs=0.02 * size[i] * size[j])
    y = np.array([1.0 if "ab" in w else -1.0 for w in words])
    cost = np.full(len(y), 5.0)
    w, bias = toxicity._svm(x, y, cost)
    loss = lambda w, b: w @ w + 5e0 * (np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    v, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20000):  # plain gradient descent on the same loss
        slack = np.maximum(0, 1 - y * (x @ v + b))
        v, b = v - 2e-4 * (2 * v - 10 * x.T @ (y * slack)), b + 2e-4 * 10 * (y * slack).sum()
    assert loss(w, bias) <= loss(v, b) * 1.001 + 1e-6
    assert np.abs((x @ w + bias) - (x @ v + b)).max() < 0.1
    folded = nystrom.folded(w)
    for k, c in enumerate(codes):  # the table gives the value of a whole string, and best stretches reach it
        index, weight = toxicity.subsequences(c)
        assert float((folded[index] * weight).sum()) == pytest.approx(float(x[k] @ w), rel=1e-3, abs=1e-3)
        tops, ends = toxicity.best_each([c], folded)
        gains = np.array([sum(float(folded[i]) * v for i, v in zip(*toxicity.subsequences(c[: p + 1]), strict=True)) for p in range(len(c))])
        gains = np.diff(gains, prepend=0.0)  # what ends at each place
        assert tops[0] == pytest.approx(max(gains[a : b + 1].sum() for a in range(len(c)) for b in range(max(a, 0), len(c))), rel=1e-3, abs=1e-3)


def test_no_script_is_left_out_of_scoring():
    model = toxicity.Model(toxicity._alphabet(["plain latin text only"] * 5), None, 1.0, 0.0)
    for text in ("идиот", "1d10t", "ηλίθιος", "愚か者ばか", "\U0001f595\U0001f595\U0001f595", "ﬀ①²"):
        codes = model.encode(text)
        assert len(codes) == len(text.lower()) and (codes > 1).all()
    assert model.encode("...!?—«»").tolist() == []
    assert toxicity.sentences("One i.d.i.o.t here. Two!  Three?\nfour\n\n") == ["One i.d.i.o.t here.", "Two!", "Three?", "four"]
    assert toxicity.sentences("") == []


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    model = toxicity.train([("a fine day", 0), ("you scoundrel you", 1)] * 4)
    rows = toxicity.toxicity(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(empty, model).count() == 0
    none = toxicity.train([])
    assert toxicity.score_texts(none, ["", "x"]).max() < 0.7
    labels = spark.createDataFrame([(1, 1), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.labelled(empty, labels.limit(0)) is None
    assert all(r["toxic"] in (0, 1) for r in toxicity.labelled(awkward, labels).collect())
    assert toxicity.score_texts(toxicity.trained(empty, labels), ["x"]).max() < 0.7


# ------------------------------------------------------------------ URL filters


def test_url_verdicts_equal_brute_force(spark):
    folder = DATA
    rows = queries.op8_url_filter(spark, folder).collect()
    captures = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    events = defaultdict(dict)
    for r in queries.list_events(captures).collect():
        events[r["key"]][str(r["date"])] = max(events[r["key"]].get(str(r["date"]), ""), r["action"])
    urls = dict(map(tuple, captures.collect()))
    assert len(rows) == len(urls)
    for r in rows:
        m = re.match(r"https?://([^/?#:]*)[^/?#]*(/[^/?#]+)?", urls[r["page_id"]])
        labels = m[1].lower().split(".")
        active = []
        for n in range(2, len(labels) + 1):
            for extra, key in enumerate([".".join(labels[-n:]), ".".join(labels[-n:]) + (m[2] or "")]):
                if extra and not m[2]:
                    continue
                before = [d for d in events.get(key, {}) if d <= r["fetched_on"]]
                if before and events[key][max(before)] != "off":
                    active.append((n * 2 + extra, max(before), key, events[key][max(before)]))
        best = max(active, default=(0, None, None, "none"))
        assert (r["n_active"], r["verdict"], r["matched_key"], r["active_since"]) == (len(active), best[3], best[2], best[1])


def test_addresses_have_no_parent_domains(spark):
    urls = ["http://10.0.0.1:8080/a/b", "https://u@[::1]:80/x", "http://a.b.example.org/", "http://localhost/z"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_filters.host_of(F.col("url")).alias("host"), url_filters.segment_of(F.col("url")).alias("segment"))
    got = {r["url"]: (r["host"], [k["key"] for k in r["keys"]]) for r in rows.withColumn("keys", url_filters.keys_of(F.col("host"), F.col("segment"))).collect()}
    assert got[urls[0]] == ("10.0.0.1", ["10.0.0.1", "10.0.0.1/a"]) and got[urls[1]] == ("[::1]", ["[::1]", "[::1]/x"])
    assert got[urls[2]] == ("a.b.example.org", ["example.org", "b.example.org", "a.b.example.org"]) and got[urls[3]] == ("localhost", [])


def test_urls_without_host_and_dates(spark):
    day = "2024-03-01"
    rows = [(1, None, day), (2, "not a url", day), (3, "http://u:p@A.Example.com.:80/x/y?z", day), (4, "http://a.example.com/", None), (3, "http://u:p@A.Example.com.:80/x/y?z", day)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on string").withColumn("fetched_on", F.to_date("fetched_on"))
    captures = captures.withColumn("verdict", F.lit("taken"))
    events = spark.createDataFrame([("example.com", "2024-01-01", "block"), ("a.example.com/x", "2024-03-01", "allow"), ("a.example.com", "2024-02-01", "off"), (None, "2024-01-01", "block")], "key string, date string, action string")
    events = events.withColumn("date", F.to_date("date"))
    got = sorted((r["page_id"], r["host"], r["n_active"], r["verdict"]) for r in url_filters.filtered(captures, events).collect())
    assert got == [(1, "", 0, "none"), (2, "", 0, "none"), (3, "a.example.com", 2, "allow"), (3, "a.example.com", 2, "allow"), (4, "a.example.com", 0, "none")]
    assert url_filters.filtered(captures.limit(0), events).count() == 0
    assert {r["verdict"] for r in url_filters.filtered(captures, events.limit(0)).collect()} == {"none"}


# ------------------------------------------------------------------ token counts


def test_token_counts_equal_the_library(documents, awkward, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = tokens.model_at(path)
    for rows in (documents, awkward):
        for r in tokens.with_token_counts(rows.select("doc_id", "text"), path).collect():
            assert r["n_tokens"] == len(model.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode())
    assert tokens.with_token_counts(empty, path).count() == 0


def test_cuts_do_not_change_counts():
    model = tokens.model_at(public_tokenizers.path("piece_bpe_32k.model"))
    draw = random.Random(8)
    bits = ["a", "b ", " ", "  ", "word", "\n", "é", "▁", "<s>", "9", " x y ", "\t", ". ", "日本"]
    for _ in range(300):
        text = "".join(draw.choice(bits) for _ in range(120))
        assert tokens.count_tokens(model, [text], limit=5) == [len(model.encode(text))]


# ------------------------------------------------------------------ SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash_groups_equal_brute_force(spark, documents, awkward, empty):
    near = documents.select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"))
    for rows in (documents.select("doc_id", "text").union(near), awkward.select("doc_id", "text")):
        own = [tuple(r) for r in rows.collect()]
        prints = [plain_print(t) for _, t in own]
        roots = plain_components(prints)
        smallest = {}
        for (d, _), r in zip(own, roots, strict=True):
            if d is not None:
                smallest[r] = min(d, smallest.get(r, d))
        want = Counter((d, f"{p:016x}", smallest.get(r)) for (d, _), p, r in zip(own, prints, roots, strict=True))
        assert Counter(tuple(r) for r in simhash.simhash_groups(rows).collect()) == want
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("limits", [(64, 8192), (2, 8192), (2, 4)])
def test_links_keep_every_component(spark, monkeypatch, limits):
    draw = random.Random(6)
    prints = set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(40):
            prints.add(base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))))
    prints = sorted(prints)
    own = simhash.Finder(1, 32, 2, 2, limits[0])
    monkeypatch.setattr(simhash, "MIDDLE_RUN", limits[1])
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    rows = simhash.entries(table, ["print"], 2, 32, 2).orderBy("entry").collect()
    entry, value = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64).view(np.uint64)[:, None]
    found = np.concatenate(own.links(entry, value))
    at = {p: k for k, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found.tolist():
        assert bin(a ^ b).count("1") <= 2
        parent[root(at[a])] = root(at[b])
    want = plain_components(prints)
    got = [root(k) for k in range(len(prints))]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 3)], "a long, b long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(41)}
    assert components(chain.limit(0)).count() == 0


def test_joined_once_stays_within_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(1000 + a, 1000 + b) for a in range(12) for b in range(a)]
    links = spark.createDataFrame(pairs, "a long, b long")
    whole = {r["node"]: r["component"] for r in components(links).collect()}
    got = {r["node"]: r["label"] for r in joined_once(links).collect()}
    assert set(got) == set(whole) and all(whole[n] == whole[x] for n, x in got.items())
    assert len({got[1000 + a] for a in range(12)}) == 1
    assert joined_once(links.limit(0)).count() == 0


def test_content_groups_keep_one_of_near_copies(spark):
    draw = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    rows, near = [], {}
    for k in range(60):
        own = draw.choices(words, k=draw.randint(80, 400))
        rows.append((10 * k, " ".join(own)))
        for c in range(3):
            copy = list(own)
            for _ in range(max(1, len(own) // 100)):
                copy[draw.randrange(len(copy))] = "new"
            rows.append((10 * k + c + 1, " ".join(copy)))
            near[10 * k + c + 1] = 10 * k
        rows.append((10 * k + 9, " ".join(own).upper()))
    rows += [(None, None), (None, None), (7000, ""), (7001, None), (7002, "two words"), (7002, "two words")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(table).collect()]
    assert set(range(0, 600, 10)) <= set(kept)
    assert len([d for d in kept if d in near]) <= 0.05 * len(near)
    assert not [d for d in kept if d is not None and d < 600 and d % 10 == 9]
    assert kept.count(7002) == 1 and 7000 in kept and None not in kept


def test_links_do_not_depend_on_the_order_of_rows(spark):
    draw = random.Random(5)
    base = (draw.getrandbits(63), draw.getrandbits(63))
    prints = [tuple(w ^ sum(1 << draw.randrange(60) for _ in range(2)) for w in base) for _ in range(60)]
    prints = sorted(set(prints))
    found = []
    for rows in (prints, prints[::-1], draw.sample(prints, len(prints))):
        nodes = spark.createDataFrame(rows, "f0 long, f1 long").repartition(3)
        links = simhash.fingerprint_links(nodes, ["f0", "f1"], 6, 21, 3, 24, 2)
        found.append({tuple(r) for r in links.collect()})
    assert found[0] and found[0] == found[1] == found[2]


def jaccard(a, b):
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(own[0] & own[1]) / len(own[0] | own[1])


@pytest.mark.parametrize("kind", ["appended", "truncated", "replaced", "scattered"])
@pytest.mark.parametrize("size", [60, 300])
def test_copies_that_differ_in_one_piece_are_dropped(spark, kind, size):
    draw = random.Random(31)
    rows = []
    for k in range(300):
        own = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        piece, least = [f"n{draw.randrange(10**6)}" for _ in range(size)], draw.choice([0.8, 0.85, 0.9])
        best = None
        for n in range(1, size // 3):  # the widest change that the similarity allows
            at = size // 4
            copy = {
                "appended": own + piece[:n],
                "truncated": own[:-n],
                "replaced": own[:at] + piece[:n] + own[at + n :],
                "scattered": [piece[i] if i % max(5, size // n) == 4 else w for i, w in enumerate(own)],
            }[kind]
            if jaccard(" ".join(own), " ".join(copy)) >= least:
                best = copy
        rows += [(2 * k, " ".join(own))] + ([(2 * k + 1, " ".join(best))] if best else [])
    assert sum(d % 2 for d, _ in rows) >= 100
    kept = [r["doc_id"] for r in simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {d for d, _ in rows if d % 2 == 0} <= set(kept)
    assert sum(d % 2 for d in kept) <= 0.01 * sum(d % 2 for d, _ in rows)


def test_groups_follow_fingerprints_too(spark):
    rows = []
    for k, seed in enumerate((1212, 1841, 2196)):  # seeds of pairs that are 0.8 alike and share no band
        draw = random.Random(seed)
        block, own, other = ([f"w{draw.randrange(10**6)}" for _ in range(n)] for n in (21, 60, 9))
        pair = [" ".join(block * 12 + own), " ".join(block * 12 + own[:51] + other)]
        assert jaccard(*pair) == 0.8
        keys = simhash.band_keys(simhash.shingle_sets(pair, simhash.SHINGLE), simhash.BANDS, simhash.BAND_ROWS)[1]
        assert not (keys[0] == keys[1]).any()
        pair.append(" ".join(block * 200 + [f"n{draw.randrange(10**6)}" for _ in range(60)]))  # linked by its print, but not alike
        a, b, c = simhash.fingerprints(pair)
        assert 1 <= int(a ^ b).bit_count() <= 2 and int(a ^ c).bit_count() <= 2 and jaccard(pair[0], pair[2]) < 0.2
        rows += [(10 * k + i, t) for i, t in enumerate(pair)]
    rows += [(500 + k, t) for k, (_, t) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.without_near_duplicates(table).collect()) == [0, 2, 10, 12, 20, 22]


def test_groups_are_those_of_exact_similarities(spark, monkeypatch):
    draw = random.Random(8)
    rows = []
    for k in range(40):
        own = [f"w{draw.randrange(10**6)}" for _ in range(200)]
        piece = [f"n{draw.randrange(10**6)}" for _ in range(400)]
        for c in range(8):  # some links of 0.8 and more among many of 0.7 and more
            n, at = draw.randint(5, 33), draw.choice([0, 20, 160])
            copy = own[:at] + piece[40 * c : 40 * c + n] + own[at + n :]
            rows.append((100 * k + c, " ".join(copy)))
    want = set()
    for k in range(40):
        own, left = [r for r in rows if r[0] // 100 == k], []
        near = {a: {b for b, u in own if jaccard(t, u) >= 0.8} for a, t in own}
        seen = set()
        for a in sorted(near):
            if a not in seen:
                want.add(a)
                todo = [a]
                while todo:
                    b = todo.pop()
                    if b not in seen:
                        seen.add(b)
                        todo += near[b]
    assert 40 < len(want) < len(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.without_near_duplicates(table).collect()}
    assert len(want ^ kept) <= 1
    monkeypatch.setattr(simhash, "CELL_SHINGLES", 700)  # places are cut into cells, and what these kept apart is crossed
    assert {r["doc_id"] for r in simhash.without_near_duplicates(table.repartition(5)).collect()} == kept
    whole = draw.sample(rows, 40)
    for text_of_all in ("", " shared " * 40):
        assert len({r["doc_id"] for r in simhash.without_near_duplicates(spark.createDataFrame([(d, text_of_all) for d, _ in whole], "doc_id long, text string")).collect()}) == 1


def test_cut_places_compare_all_labels_that_cells_kept_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_SHINGLES", 50)
    draw = random.Random(4)
    rows = [(place, 100 * place + k, 100 * place + (k if k % 3 else 0), 10, 10 * n) for place, n in ((1, 40), (2, 4), (3, 7)) for k in range(n)]
    members = spark.createDataFrame(draw.sample(rows, len(rows)), "place long, node long, label long, size long, weight long")
    met = set()
    for cut in (simhash.cells(members), simhash.crossed_cells(members)):
        held = defaultdict(list)
        for r in cut.collect():
            held[r["cell"]].append(r)
        for own in held.values():
            assert sum(10 for _ in own) <= 4 * 50
            met |= {(x["node"], y["node"]) for x in own for y in own if x["label"] != y["label"] and x["side"] != 1 and y["side"] != 0}
    for p, a, la, *_ in rows:
        for q, b, lb, *_ in rows:
            assert ((a, b) in met or (b, a) in met) == (p == q and la != lb) or p != q and (a, b) not in met


def test_near_duplicates_with_maps_and_repeated_rows(spark):
    rows = [(1, "a b c d e f", {"x": "2"}), (1, "a b c d e f", {"x": "1"}), (2, "a b c d e f", None), (None, None, {"x": None}), (None, None, None), (9, "", {}), (3, "z", {"q": "r"})]
    table = spark.createDataFrame(rows, "doc_id long, text string, extra map<string, string>")
    kept = {(r["doc_id"], r["text"], tuple((r["extra"] or {}).items())) for r in simhash.without_near_duplicates(table).collect()}
    assert kept == {(1, "a b c d e f", (("x", "1"),)), (9, "", ()), (3, "z", (("q", "r"),))}
    assert simhash.without_near_duplicates(table.limit(0)).count() == 0


def test_true_links_are_kept_among_false_ones():
    draw = random.Random(3)
    for _ in range(40):
        base = draw.sample(range(10**9), 100)
        sets = []
        for _ in range(draw.randint(2, 30)):
            own = draw.sample(base, draw.randint(80, 100)) + draw.sample(range(10**9, 2 * 10**9), draw.randint(0, 8))
            sets.append(np.unique(np.array(own, np.uint64)))
        like = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        labels, whole = np.array([draw.randrange(2**40) for _ in sets]), np.ones(len(sets), bool)
        if draw.random() < 0.3:
            labels[-1] = labels[0]  # one group already: pairs between these two are not needed
        found = simhash.alike_forest(sets, labels, whole, whole)
        assert all(like(sets[a], sets[b]) for a, b in found)

        def groups(links):
            root = list(range(len(sets)))
            for a, b in links:
                root = [root[a] if r == root[b] else r for r in root]
            return root

        same = [(a, b) for a in range(len(sets)) for b in range(a) if labels[a] == labels[b]]
        pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if like(sets[a], sets[b])]
        one, other = groups(found + same), groups(pairs + same)
        assert all((one[a] == one[b]) == (other[a] == other[b]) for a in range(len(sets)) for b in range(len(sets)))
        assert len(found) == len(set(labels.tolist())) - len(set(other))
