"""Every query against its SQL, and those without SQL against plain versions."""

import decimal
import glob
import itertools
import math
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from annotide.functions import polygons
from annotide.operators import matching, suppression, tables
from annotide.plans import catalogue, rewrites

DATA = "/root/testdata/sf0.001"
assert rewrites  # registers its queries


@pytest.fixture(scope="module")
def duck(tmp_path_factory):
    con = duckdb.connect()
    con.execute(f"set temp_directory='{tmp_path_factory.mktemp('duck')}'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(catalogue.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def boxes(spark, name):
    own, found = catalogue.derived(spark, DATA)
    return (found if name == "found" else own).collect()


def iou(a, b, pixel=0.0):
    w = min(a[2], b[2]) - max(a[0], b[0]) + pixel
    h = min(a[3], b[3]) - max(a[1], b[1]) + pixel
    common = max(w, 0) * max(h, 0)
    size = lambda x: (x[2] - x[0] + pixel) * (x[3] - x[1] + pixel)
    return common / (size(a) + size(b) - common)


def corner(r):
    return (r["x1"], r["y1"], r["x2"], r["y2"])


@pytest.mark.parametrize("name,keys", [("nms", ["image"]), ("multiclass_nms", ["image", "cls"])])
def test_suppression_equals_plain_one(spark, name, keys):
    groups = {}
    for r in boxes(spark, "found"):
        groups.setdefault(tuple(r[k] for k in keys), []).append(r)
    want = set()
    for rows in groups.values():
        gone = set()
        for r in sorted(rows, key=lambda r: (-r["conf"], r["obj"])):
            if r["obj"] not in gone:
                want.add((r["image"], r["obj"]))
                gone |= {o["obj"] for o in rows if iou(corner(r), corner(o), 1.0) >= 0.5}
    assert {(r["image"], r["obj"]) for r in catalogue.QUERIES[name](spark, DATA).collect()} == want


def test_connected_boxes_equal_plain_ones(spark):
    groups = {}
    for r in boxes(spark, "own"):
        groups.setdefault((r["image"], r["cls"]), []).append(corner(r))
    want = Counter()
    for (image, cls), rows in groups.items():
        left = list(rows)
        while left:
            part, todo = [], [left.pop()]
            while todo:
                a = todo.pop()
                part.append(a)
                near = [b for b in left if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]]
                left = [b for b in left if b not in near] if near else left
                todo += near
            n = len(part)
            want[(image, cls, min(p[0] for p in part), min(p[1] for p in part), max(p[2] for p in part), max(p[3] for p in part))] += n
    got = Counter()
    for r in catalogue.QUERIES["connected_merge"](spark, DATA).collect():
        got[(r["image"], r["cls"], r["x1"], r["y1"], r["x2"], r["y2"])] += r["n"]
    assert set(got) == set(want)


def plain_merge(rows, least):
    """Boxes by falling score: the first one is cut down by the first box that it covers enough of, and compared anew."""
    left = sorted(rows, key=lambda r: -r[0])
    out = []
    while left:
        conf, obj, box = left.pop(0)
        for k, (_, _, other) in enumerate(left):
            cut = (max(box[0], other[0]), max(box[1], other[1]), min(box[2], other[2]), min(box[3], other[3]))
            common = max(0, cut[2] - cut[0] + 1) * max(0, cut[3] - cut[1] + 1)
            if common / ((other[2] - other[0] + 1) * (other[3] - other[1] + 1)) > least:
                del left[k]
                left.insert(0, (conf, obj, cut))
                break
        else:
            out.append((obj, box))
    return out


def test_box_merge_equals_plain_one(spark):
    groups = {}
    for r in sorted(boxes(spark, "found"), key=lambda r: (r["image"], r["cls"], r["obj"])):
        groups.setdefault((r["image"], r["cls"]), []).append((r["conf"], r["obj"], corner(r)))
    rows = catalogue.derived(spark, DATA)[1].select("image", "obj", "cls", "x1", "y1", "x2", "y2", "conf").orderBy("obj")
    for least in (0.3, 0.6):
        want = {(image, cls, obj, *box) for (image, cls), own in groups.items() if len({c for c, _, _ in own}) == len(own) for obj, box in plain_merge(own, least)}
        got = {(r["image"], r["cls"], r["obj"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in suppression.merged_by_score(rows, least).collect()}
        assert want <= got and len(want) > 1000


def test_used_once_equals_plain_one(spark):
    sides = {}
    for name in ("own", "found"):
        for r in sorted(boxes(spark, name), key=lambda r: r["obj"]):
            sides.setdefault(r["image"], {"own": [], "found": []})[name].append(corner(r))
    for r in catalogue.QUERIES["used_once_match"](spark, DATA).collect():
        own, found = sides[r["image"]]["own"], sides[r["image"]]["found"]
        used, hits = set(), 0
        for b in found:
            shares = [iou(a, b) for a in own]
            if shares and max(shares) >= 0.5 and shares.index(max(shares)) not in used:
                used.add(shares.index(max(shares)))
                hits += 1
        assert (r["tp"], r["fp"], r["fn"]) == (hits, len(found) - hits, len(own) - hits)


def test_tiles_share_whole_pixels():
    assert [t[0] for t in tables.tiles(1000, 100, 512, 512, 0.2)] == [0, 410, 488]  # 512 - int(102.4)
    assert [t[0] for t in tables.tiles(130, 50, 100, 50, 0.9)] == [0, 10, 20, 30]
    assert tables.tiles(50, 40, 80, 80, 0.5) == [(0, 0, 50, 40)]


def test_shared_area_and_parts_of_polygons():
    draw = random.Random(4)
    box = lambda a, b, c, d: [a, b, c, b, c, d, a, d]
    for _ in range(200):
        p, q = ([draw.randint(0, 20) for _ in range(4)] for _ in "ab")
        p, q = ([min(x[0], x[2]), min(x[1], x[3]), max(x[0], x[2]) + 1, max(x[1], x[3]) + 1] for x in (p, q))
        common = max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
        assert polygons.shared_area(box(*p), box(*q)) == pytest.approx(common, abs=1e-9)
    comb = [(0, 0), (10, 0), (10, 8), (8, 8), (8, 2), (6, 2), (6, 8), (4, 8), (4, 2), (2, 2), (2, 8), (0, 8)]  # three teeth
    flat = [v for p in comb for v in p]
    parts = polygons.clip_parts(comb, (0, 4, 20, 6))
    assert sorted(abs(polygons._signed(p)) for p in parts) == pytest.approx([4, 4, 4])
    assert polygons.clip_parts(comb, (30, 30, 40, 40)) == [] and len(polygons.clip_parts(comb, (0, 0, 20, 20))) == 1
    for _ in range(100):
        star = [(10 + (r := draw.uniform(2, 10)) * math.cos(k / 9 * 2 * math.pi), 10 + r * math.sin(k / 9 * 2 * math.pi)) for k in range(9)]
        x, y = draw.uniform(0, 15), draw.uniform(0, 15)
        rect = (x, y, x + draw.uniform(1, 8), y + draw.uniform(1, 8))
        total = sum(abs(polygons._signed(p)) for p in polygons.clip_parts(star, rect))
        assert total == pytest.approx(polygons.shared_area([v for p in star for v in p], box(*rect)), abs=1e-7)
    assert polygons.shared_area(flat, flat) == pytest.approx(abs(polygons._signed(comb)))


def test_seeded_choices(spark):
    rows = catalogue.QUERIES["weighted_choice"](spark, DATA).collect()
    assert len({r["p_partkey"] for r in rows}) == 100
    shown = catalogue.QUERIES["shown_subset"](spark, DATA).collect()
    counts = Counter(r["image"] for r in shown)
    assert len(counts) == 20 and max(counts.values()) <= 3 and len(set(shown)) == len(shown)
    picked = catalogue.QUERIES["sample_distinct"](spark, DATA).collect()
    assert len({(r["c_nationkey"], r["c_mktsegment"]) for r in picked}) == 50
    first = {}
    for r in spark.read.parquet(f"{DATA}/customer.parquet").collect():
        key = (r["c_nationkey"], r["c_mktsegment"])
        first[key] = min(first.get(key, r["c_custkey"]), r["c_custkey"])
    assert all(first[r["c_nationkey"], r["c_mktsegment"]] == r["c_custkey"] for r in picked)


def test_changes_to_the_next_image(spark):
    from pyspark.sql import functions as F

    from annotide.operators import ordering

    rng = np.random.default_rng(5)
    a = rng.random((8, 8))
    other = rng.random((8, 8))
    images = [a, np.roll(a, (2, 3), (0, 1)), np.fliplr(np.roll(a, (2, 3), (0, 1))), np.rot90(np.fliplr(np.roll(a, (2, 3), (0, 1)))), other, np.zeros((8, 8))]
    table = spark.createDataFrame([(k, 0, x.ravel().tolist()) for k, x in enumerate(images)], "n int, g int, image array<double>")
    got = {r["n"]: r for r in ordering.changes_to_next(table, ["g"], [F.col("n")], "image", 8).collect()}

    def ssim(x, y):
        c1, c2 = 1e-4, 9e-4
        cov = ((x - x.mean()) * (y - y.mean())).mean()
        return (2 * x.mean() * y.mean() + c1) / (x.mean() ** 2 + y.mean() ** 2 + c1) * (2 * cov + c2) / (x.var() + y.var() + c2)

    for k in range(5):
        x, y = images[k], images[k + 1]
        assert got[k]["mirror"] == pytest.approx(ssim(x, np.fliplr(y)), abs=1e-9)
        assert got[k]["turn"] == pytest.approx(max(ssim(x, np.rot90(y, -q)) for q in (1, 2, 3)), abs=1e-9)
    assert got[0]["shift"] == pytest.approx(1.0) and got[3]["shift"] < 0.7 and got[4]["shift"] == 0.0
    assert got[1]["mirror"] == pytest.approx(1.0) and got[2]["turn"] == pytest.approx(1.0)
    assert got[5]["shift"] is None and got[5]["turn"] is None and got[5]["mirror"] is None


def test_merged_boxes_stay_inside_and_cover_all(spark):
    found = {(r["image"], r["obj"]): r for r in boxes(spark, "found")}
    rows = catalogue.QUERIES["box_merge"](spark, DATA).collect()
    assert 0 < len(rows) < len(found)
    for r in rows:
        own = corner(found[(r["image"], r["obj"])])
        assert own[0] <= r["x1"] < r["x2"] <= own[2] and own[1] <= r["y1"] < r["y2"] <= own[3]
    rng = np.random.default_rng(0)
    assert suppression.survivors(np.zeros((0, 4)), np.zeros(0), 0.5).sum() == 0
    box = rng.random((30, 2)).repeat(2, 1)[:, [0, 2, 1, 3]] + np.r_[0, 0, 1, 1]
    kept = np.flatnonzero(suppression.survivors(box, rng.random(30), 0.4, pixel=0.0))
    assert all(iou(box[a], box[b]) < 0.4 for a, b in itertools.combinations(kept, 2))


def test_assignment_is_the_cheapest():
    draw = random.Random(0)
    for _ in range(60):
        n, m = draw.randint(1, 5), draw.randint(1, 5)
        cost = np.array([[draw.random() for _ in range(m)] for _ in range(n)])
        pairs = matching.assignment(cost)
        k = min(n, m)
        assert len(pairs) == k and len({a for a, _ in pairs}) == k and len({b for _, b in pairs}) == k
        long, wide = (cost, m) if n <= m else (cost.T, n)
        best = min(sum(long[i, p[i]] for i in range(k)) for p in itertools.permutations(range(wide), k))
        assert sum(cost[a, b] for a, b in pairs) == pytest.approx(best)
    assert matching.assignment(np.zeros((0, 3))) == []


def test_optimal_matching_is_one_to_one_and_no_worse_than_greedy(spark):
    rows = catalogue.QUERIES["hungarian_match"](spark, DATA).collect()
    for side in ("l_obj", "p_obj"):
        assert max(Counter((r["image"], r[side]) for r in rows).values()) == 1
    greedy = [r["iou"] for r in catalogue.matched(spark, DATA)[2].where("threshold = 0.5").collect()]
    assert sum(r["iou"] for r in rows) >= sum(greedy) - 1e-6


def test_labels_as_predictions_are_perfect(spark):
    own, _ = catalogue.derived(spark, DATA)
    from pyspark.sql import functions as F

    found = own.withColumn("conf", F.lit(0.9))
    columns = ["image", "obj", "cls", "x1", "y1", "x2", "y2"]
    distinct = own.dropDuplicates(["image", "x1", "y1", "x2", "y2"]).select(*columns)
    ap = matching.average_precision(distinct, found.join(distinct.select("image", "obj"), ["image", "obj"]), matching.greedy(matching.iou_pairs(distinct, distinct, 0.5)))
    r = matching.map_summary(ap).first()
    assert r["map50"] == pytest.approx(1.0, abs=0.02)


def test_used_once_counts_add_up(spark):
    own, found = catalogue.derived(spark, DATA)
    rows = catalogue.QUERIES["used_once_match"](spark, DATA).collect()
    assert sum(r["tp"] + r["fn"] for r in rows) == own.count() and sum(r["tp"] + r["fp"] for r in rows) == found.count()


def test_smoothing_of_all_users_equals_plain_one(spark, duck):
    users = {}
    for user, event, value in duck.sql("select user_id, event_id, value from events order by user_id, event_id").fetchall():
        users.setdefault(user, []).append((event, value))
    want = {}
    for user, rows in users.items():
        for k, (event, _) in enumerate(rows):
            near = [(math.exp(-((j - k) ** 2) / 18), rows[j][1]) for j in range(max(0, k - 12), min(len(rows), k + 13))]
            want[user, event] = sum(w * v for w, v in near) / sum(w for w, _ in near)
    got = {(r["user_id"], r["event_id"]): r["smooth"] for r in catalogue.QUERIES["gaussian_smoothing"](spark, DATA).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())
