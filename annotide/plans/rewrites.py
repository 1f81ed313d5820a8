"""Queries for label rewrites, text functions, geometry and small joins over the driver's tables, and their SQL.

They are registered beside those of ``catalogue`` and use the same derived boxes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annotide.functions import boxes as B
from annotide.functions import geometry, polygons, text
from annotide.operators import joins, labels, matching, ordering, tables
from annotide.plans.catalogue import _BASE, _GREEDY, _PAIRS, derived, matched, query, table
from annotide.sources import documents, label_files

_ATTS = ", ".join(f"a{k}" for k in range(4))


def four(df, *shown):
    """The attributes as columns a0 to a3."""
    return df.select(*shown, *[F.get("atts", k).cast("int").alias(f"a{k}") for k in range(4)])


# ------------------------------------------------------------------ label rows


@query(f"with {_BASE} select image, obj, cls, {', '.join(f'case when cls = 2 then 0 else a{k} end as a{k}' for k in range(4))} from lab")
def zero_attributes(spark, sf):
    return four(labels.zero_attributes(derived(spark, sf)[0], 2, 4), "image", "obj", "cls")


@query(f"with {_BASE} select image, obj, cls from lab where cls <> 3")
def rows_without_class(spark, sf):
    return labels.without_classes(derived(spark, sf)[0], [3]).select("image", "obj", "cls")


@query(f"with {_BASE} select image, obj, cls from lab where cls in (1, 4)")
def rows_of_classes(spark, sf):
    return labels.with_classes(derived(spark, sf)[0], [1, 4]).select("image", "obj", "cls")


@query(f"with {_BASE} select image, obj, cls from lab where cls not in (0, 1, 2)")
def unknown_class_report(spark, sf):
    return labels.without_classes(derived(spark, sf)[0], [0, 1, 2]).select("image", "obj", "cls")


@query(f"with {_BASE} select image, obj, case cls when 0 then 2 when 1 then 0 when 2 then 1 else cls end as cls from lab")
def remap_by_names(spark, sf):
    rows = labels.remap_by_names(derived(spark, sf)[0], ["crack", "stain", "moss", "gone"], ["stain", "moss", "crack"])
    return rows.select("image", "obj", "cls")


@query(f"with {_BASE} select image, obj, a0, case when a1 = 1 then 2 else a1 end as a1, a2, a3 from lab")
def attribute_level_rewrite(spark, sf):
    return four(labels.set_level(derived(spark, sf)[0], 1, 1, 2), "image", "obj")


@query(f"with {_BASE} select image, obj, a0 + a1 + a2 + a3 > 0 as any_set, 1 in (a0, a1, a2, a3) as any_one, 2 in (a0, a1, a2, a3) as any_two from pred")
def level_predicates(spark, sf):
    atts = F.col("atts")
    shown = (labels.any_attribute(atts).alias("any_set"), labels.any_at_level(atts, 1).alias("any_one"), labels.any_at_level(atts, 2).alias("any_two"))
    return derived(spark, sf)[1].select("image", "obj", *shown)


_LINE = " || ' ' || ".join(f"{c}::bigint" for c in ("x1", "y1", "x2", "y2"))


@query(f"with {_BASE} select image, obj, cls || ' ' || {_LINE} as plain, cls || ' 4 ' || a0 || ' ' || a1 || ' ' || a2 || ' ' || a3 || ' ' || {_LINE} as full from lab")
def label_lines(spark, sf):
    """Label lines with and without the attribute block."""
    rows = derived(spark, sf)[0].withColumn("coords", F.array("x1", "y1", "x2", "y2"))
    bare = labels.drop_attributes(rows)
    plain = bare.select("image", "obj", labels.line_of(F.col("cls"), F.col("coords")).alias("plain"))
    return plain.join(rows.select("image", "obj", labels.line_of(F.col("cls"), F.col("coords"), F.col("atts")).alias("full")), ["image", "obj"])


def lines_of_images(spark, sf):
    """(file, line_no, line): the lines of the label files that would be written."""
    rows = derived(spark, sf)[0].withColumn("coords", F.array("x1", "y1", "x2", "y2"))
    texts = label_files.label_text(rows.withColumn("image", F.col("image").cast("string")), attributes=True)
    return texts.select(F.col("image").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


@query(f"with {_BASE} select image::varchar as image, (row_number() over (partition by image order by obj) - 1)::int as obj, cls::int as cls, a0, a1, a2, a3, (x1 + x2) / 2 as mx, y2 - y1 as h from lab")
def label_text_roundtrip(spark, sf):
    """Label files as text, read again with their attribute blocks."""
    rows = label_files.rows_of(lines_of_images(spark, sf), attributes=True, binary=True)
    return four(rows, "image", "obj", "cls", ((F.get("coords", 0) + F.get("coords", 2)) / 2).alias("mx"), (F.get("coords", 3) - F.get("coords", 1)).alias("h"))


@query(f"with {_BASE} select image::varchar as image, (row_number() over (partition by image order by obj) - 1)::int as obj, cls::int as cls, conf::double as conf, x1, y2 from pred")
def prediction_text_roundtrip(spark, sf):
    """Prediction files as text with a confidence last, read again."""
    rows = derived(spark, sf)[1].withColumns({"coords": F.array("x1", "y1", "x2", "y2", "conf"), "image": F.col("image").cast("string")})
    texts = label_files.label_text(rows)
    lines = texts.select(F.col("image").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    out = label_files.rows_of(lines, confidence=True)
    return out.select("image", "obj", "cls", "conf", F.get("coords", 0).alias("x1"), F.get("coords", 3).alias("y2"))


@query("select o_orderkey::varchar as file, case when o_orderkey % 3 = 0 then 'det' else 'seg' end as task from orders")
def label_task(spark, sf):
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1 0.5 0.5 0.1 0.1")).otherwise(F.lit("1 0.1 0.1 0.2 0.1 0.2 0.2"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file"), F.posexplode(F.array(F.lit("  "), line, F.lit("1 2 3"))).alias("line_no", "line"))
    return labels.task_of(rows)


@query("select o_orderkey::varchar as file from orders where o_orderkey not in (select l_orderkey from lineitem group by 1 having min(l_linenumber % 7) > 0)")
def faulty_label_files(spark, sf):
    line = F.when(F.col("l_linenumber") % 7 == 0, F.lit("1 2 3")).otherwise(F.lit("1 0.5 0.5 0.1 0.1"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), line.alias("line"))
    return labels.faulty_files(rows, table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file")))


@query("select p_partkey, p_size from part where p_size % 10 <> 0 and p_partkey % 4 <> 0")
def empty_box_filter(spark, sf):
    rows = table(spark, sf, "part").withColumns({"w": F.col("p_size") % 10, "h": F.col("p_partkey") % 4})
    return labels.empty_boxes(rows).select("p_partkey", "p_size")


@query("select event_id, user_id, case when min(event_id) over (partition by user_id) > 1 then event_id - min(event_id) over (partition by user_id) else event_id end as frame from events")
def rebased_frames(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.col("event_id").alias("frame"))
    return labels.rebased_frames(rows, "user_id", "frame")


@query("select o_orderkey as id, o_orderpriority as file_name from orders where o_orderpriority in ('1-URGENT', '5-LOW') and o_orderkey in (select l_orderkey from lineitem where l_partkey % 9 in (2, 4))")
def chosen_images(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file_name"))
    annos = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 9).alias("category_id"))
    return labels.chosen_images(images, annos, ["1-URGENT", "5-LOW"], [2, 4]).select("id", "file_name")


@query("select p_partkey from part where sqrt((p_size - 25) * (p_size - 25) + (p_partkey % 50 - 20) * (p_partkey % 50 - 20) + (p_partkey % 7 - 3) * (p_partkey % 7 - 3)) < 12")
def points_in_radius(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_partkey") % 50).alias("y"), (F.col("p_partkey") % 7).alias("z"))
    return labels.near_point(rows, (25.0, 20.0, 3.0), 12.0).select("p_partkey")


@query(f"with {_BASE} select image, obj, case when image % 5 = 0 then 3 else 4 end as n, case when image % 5 = 0 then 0 else a0 + a1 + a2 + a3 end as total from lab")
def inserted_attributes(spark, sf):
    own, _ = derived(spark, sf)
    rows = labels.insert_attributes(own, 3, own.where("image % 5 = 0").select("image"), "image")
    return rows.select("image", "obj", F.size("atts").alias("n"), F.aggregate("atts", F.lit(0), lambda s, v: s + v).alias("total"))


@query(f"with {_BASE} select image, obj, case a0 when 0 then 'none' else 'worn' end as n0, case a1 when 0 then 'dry' else 'wet' end as n1 from lab")
def attribute_level_names(spark, sf):
    names = [["none", "worn"], ["dry", "wet"], ["x", "y"], ["x", "y"]]
    found = labels.level_names(F.col("atts"), names)
    return derived(spark, sf)[0].select("image", "obj", F.get(found, 0).alias("n0"), F.get(found, 1).alias("n1"))


_NAMED = ["crack", "rust", "moss", "stain"]


def named_levels(spark, sf):
    levels = F.map_from_arrays(F.array(*map(F.lit, _NAMED)), F.col("atts"))
    return derived(spark, sf)[0].withColumn("levels", F.map_filter(levels, lambda k, _: k != "moss"))


@query(f"with {_BASE} select image, obj, a3 as h0, 0 as h1, a0 as h2 from lab")
def attribute_one_hot(spark, sf):
    hot = labels.one_hot(F.col("levels"), ["stain", "moss", "crack"])
    return named_levels(spark, sf).select("image", "obj", *[F.get(hot, k).cast("int").alias(f"h{k}") for k in range(3)])


@query(f"with {_BASE} select image, obj, concat_ws(', ', case when a0 = 1 then 'crack' end, case when a1 = 1 then 'rust' end, case when a3 = 1 then 'stain' end) as text, a0 + a1 + a3 as n from lab")
def attribute_text(spark, sf):
    return named_levels(spark, sf).select("image", "obj", labels.truthy(F.col("levels")).alias("t")).select("image", "obj", "t.text", F.col("t.n").cast("int").alias("n"))


def shaped_events(spark, sf):
    """(event_id, shapes): one shape with three attributes for each event."""
    put = F.create_map(F.lit("type"), F.col("event_type"), F.lit("odd"), (F.col("event_id") % 2).cast("string"), F.lit("who"), (F.col("user_id") % 3).cast("string"))
    shape = F.struct(F.col("event_type").alias("label"), put.alias("attributes"))
    return table(spark, sf, "events").select("event_id", F.array(shape).alias("shapes"))


@query("select event_id, 2 as n, null::varchar as odd, case (user_id % 3) when 1 then 'one' else (user_id % 3)::varchar end as who from events")
def nested_keys_and_values(spark, sf):
    """One attribute deleted from nested maps, another's values rewritten."""
    rows = shaped_events(spark, sf)
    shapes = labels.with_values(labels.without_key(F.col("shapes"), "odd"), "who", {"1": "one"})
    out = F.get(shapes, 0)["attributes"]
    return rows.select("event_id", F.size(out).alias("n"), F.try_element_at(out, F.lit("odd")).alias("odd"), F.try_element_at(out, F.lit("who")).alias("who"))


@query(
    """with a as (select event_id, event_type as label, unnest(['type', 'odd', 'who']) as attribute, unnest([event_type, (event_id % 2)::varchar, (user_id % 3)::varchar]) as value from events)
    select label, attribute, value, min(event_id) as first_file from a group by 1, 2, 3"""
)
def attribute_value_list(spark, sf):
    rows = labels.attribute_values(shaped_events(spark, sf).withColumnRenamed("event_id", "file"))
    return rows.select("label", "attribute", "value", F.col("first.file").alias("first_file"))


@query("select o_orderkey, '1 ' || (o_orderkey % 4) || ' 0.5' as line from orders where o_orderkey % 4 > 1")
def second_token_filter(spark, sf):
    line = F.concat(F.lit("1 "), (F.col("o_orderkey") % 4).cast("string"), F.lit(" 0.5"))
    return labels.with_second_above(table(spark, sf, "orders").select("o_orderkey", line.alias("line")))


@query("select p_partkey, (p_partkey % 3 + 1)::int as cls from part where p_size / 40.0 <= 1 and p_partkey % 30 / 25.0 <= 1")
def centre_filter(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("cls"), (F.col("p_size") / 40).alias("cx"), (F.col("p_partkey") % 30 / 25).alias("cy"))
    return labels.centres_inside(rows).select("p_partkey", "cls")


@query(f"with {_BASE} select image, obj, cls, 1.0::double as conf from pred")
def confidence_rewrite(spark, sf):
    return labels.with_confidence(labels.without_confidence(derived(spark, sf)[1])).select("image", "obj", "cls", "conf")


@query(f"with {_BASE} select image, obj, 3 as n, a0, a2, a3 from lab where (select min(a1 - (image % 2)::int) from lab) < 0")
def negative_attributes_dropped(spark, sf):
    own, _ = derived(spark, sf)
    lowered = F.transform("atts", lambda v, i: F.when(i == 1, v - (F.col("image") % 2).cast("int")).otherwise(v))
    rows = labels.without_negative(own.withColumn("atts", lowered))
    return rows.select("image", "obj", F.size("atts").alias("n"), *[F.get("atts", k).cast("int").alias(n) for k, n in enumerate(("a0", "a2", "a3"))])


# ------------------------------------------------------------------ names and text


@query(
    r"""select s_suppkey, split_part(lower(s_name) || '.rf.0a.jpg', '.rf.', 1) as origin, lower(s_name) || '_left.jpg' as sided, '.jpg' as ending, 'x' || (s_suppkey % 10) as letter,
    s_suppkey || '_0.png' as slice0, 'f/' || s_suppkey || '_2.png' as slice2 from supplier"""
)
def file_names(spark, sf):
    """Names of copies, of joined folders and of slices, and grouping by a character."""
    low = F.lower("s_name")
    rows = table(spark, sf, "supplier")
    number = F.col("s_suppkey").cast("string")
    sliced = tables.sliced_names(rows.select("s_suppkey", F.concat(number, F.lit(".png")).alias("p")), "p").where("slice = 0")
    deep = tables.sliced_names(rows.select("s_suppkey", F.concat(F.lit("f/"), number, F.lit(".png")).alias("p")), "p").where("slice = 2")
    jpg = F.concat(low, F.lit(".jpg"))
    shown = rows.select(
        "s_suppkey",
        text.origin_of_copy(F.concat(low, F.lit(".rf.0a.jpg"))).alias("origin"),
        text.with_folder(jpg, F.lit("left")).alias("sided"),
        text.suffix(jpg).alias("ending"),
        F.concat(F.lit("x"), text.name_group(F.concat(F.lit("a"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".txt")), 2)).alias("letter"),
    )
    return shown.join(sliced.select("s_suppkey", F.col("sliced").alias("slice0")), "s_suppkey").join(deep.select("s_suppkey", F.col("sliced").alias("slice2")), "s_suppkey")


@query("select o_orderkey, 'img_' || o_custkey as source, (o_orderkey % 900)::int as x1, 5 as y1, (o_orderkey % 900 + 640)::int as x2, 485 as y2 from orders")
def slice_names(spark, sf):
    x = F.col("o_orderkey") % 900
    name = F.concat_ws("_", F.concat(F.lit("img_"), F.col("o_custkey").cast("string")), x.cast("string"), F.lit("5"), (x + 640).cast("string"), F.lit("485"))
    return table(spark, sf, "orders").select("o_orderkey", text.slice_parts(name).alias("s")).select("o_orderkey", "s.*")


@query(
    """select s_suppkey, lpad(((s_suppkey % 9000) + 1)::varchar, 4, '0') as thermal, case when (s_suppkey % 9000) % 2 = 1 then 'thermal' else 'rgb' end as route,
    case s_suppkey % 5 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 else null end as light,
    round(10 + s_suppkey % 60 / 60.0 + 30 / 3600.0, 9) as north, round(-(10 + s_suppkey % 60 / 60.0 + 30 / 3600.0), 9) as south from supplier"""
)
def capture_names(spark, sf):
    number = F.lpad((F.col("s_suppkey") % 9000).cast("string"), 4, "0")
    name = F.concat(F.lit("DJI_"), number, F.lit("_T.JPG"))
    lights = F.array(*map(F.lit, ["Off", "YellowLeft", "RedRight", "greenX", "blank"]))
    dms = F.concat(F.lit("10 deg "), (F.col("s_suppkey") % 60).cast("string"), F.lit("' 30.0\""))
    return table(spark, sf, "supplier").select(
        "s_suppkey",
        F.substring(text.thermal_name(name), 5, 4).alias("thermal"),
        text.parity_route(name).alias("route"),
        text.four_lights(F.get(lights, (F.col("s_suppkey") % 5).cast("int"))).alias("light"),
        F.round(text.degrees(dms), 9).alias("north"),
        F.round(text.signed_degrees(dms, F.lit("s")), 9).alias("south"),
    )


@query(
    """select p_partkey, p_size::double as n0, p_retailprice as n1, 'b ' || p_size as second, 2 as n_listed, (p_size // 4 % 2)::double as b0, (p_size // 2 % 2)::double as b1, (p_size % 2)::double as b2 from part"""
)
def listed_values(spark, sf):
    """Lists and numbers written as text, and numbers as bits."""
    rows = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    numbers = text.numbers_in_brackets(F.concat(F.lit("[ "), size, F.lit("  "), F.col("p_retailprice").cast("string"), F.lit("]")))
    found = text.listed(F.concat(F.lit("['a', 'b "), size, F.lit("']")))
    bits = text.binary_vector(F.col("p_size"), 3)
    return rows.select("p_partkey", *[F.get(numbers, k).alias(f"n{k}") for k in range(2)], F.get(found, 1).alias("second"), F.size(found).alias("n_listed"), *[F.get(bits, k).alias(f"b{k}") for k in range(3)])


@query(
    """select event_id, abs(epoch_us(ts) % 86400000000 - epoch_us(ts + interval 7 minute) % 86400000000) as gap, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp,
    upper(substr(event_type, 1, 1)) || substr(event_type, 2) as title, event_type || ';x' as kinds from events"""
)
def time_texts(spark, sf):
    ts = F.col("ts").cast("timestamp")
    kinds = text.joined_distinct(F.array("event_type", F.lit("x"), "event_type"))
    return table(spark, sf, "events").select(
        "event_id", text.time_of_day_gap(ts, ts + F.expr("interval 7 minutes")).alias("gap"), text.time_stamp(ts, "yyyy-MM-dd HH:mm:ss").alias("stamp"), text.titled(F.col("event_type")).alias("title"), kinds.alias("kinds")
    )


# ------------------------------------------------------------------ boxes, polygons, geometry

_CENTRE = "(x1 + x2) / 2 / 320 as cx, (y1 + y2) / 2 / 240 as cy, (x2 - x1) / 320 as w, (y2 - y1) / 240 as h"


@query(
    f"""with {_BASE}, c as (select image, obj, {_CENTRE}, x1, y1 from lab) select image, obj, round(cx, 9) as cx, round(cy, 9) as cy, round(w, 9) as w, round(h, 9) as h,
    round(x1, 6) as ax, round(y1, 6) as ay, floor(x1 + 0.3)::int as px, round(least(1, greatest(0, cx * 2)), 9) as clamped from c"""
)
def box_conversions(spark, sf):
    """Corners to normalised centres and back, whole pixels, clamping."""
    own, _ = derived(spark, sf)
    rows = own.withColumns(dict(zip(("cx", "cy", "w", "h"), B.corners_to_centre(B.columns("", "x1 y1 x2 y2"), 320.0, 240.0), strict=True)))
    back = B.centre_to_corners(B.columns("", "cx cy w h"), 320.0, 240.0)
    sized = B.size_to_corners(B.corners_to_size(back))
    whole = B.truncated(tuple(c + 0.3 for c in sized))
    tight = B.clamped(tuple(c * 2 for c in B.columns("", "cx cy w h")))
    nine = lambda c, n: F.round(c, 9).alias(n)
    return rows.select("image", "obj", *[nine(F.col(c), c) for c in ("cx", "cy", "w", "h")], F.round(back[0], 6).alias("ax"), F.round(sized[1], 6).alias("ay"), whole[0].alias("px"), nine(tight[0], "clamped"))


@query(
    f"""with {_BASE}, p as (select a.image, a.obj as a, b.obj as b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as common,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as sizes, least(a.x2, b.x2) >= greatest(a.x1, b.x1) and least(a.y2, b.y2) >= greatest(a.y1, b.y1) as touching,
    greatest(a.x2, b.x2) - least(a.x1, b.x1) as wide from lab a join lab b on a.image = b.image and a.obj < b.obj and a.cls = b.cls)
    select image, a, b, round(common / (sizes - common + 1e-7), 9) as iou, touching, wide from p"""
)
def iou_matrix(spark, sf):
    """All pairs of boxes of a class in an image: iou with a small constant, touching, joint width."""
    own, _ = derived(spark, sf)
    side = lambda p: own.select("image", "cls", F.col("obj").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")])
    rows = side("a").join(side("b"), ["image", "cls"]).where("a < b")
    a, b = B.columns("a_", "x1 y1 x2 y2"), B.columns("b_", "x1 y1 x2 y2")
    outer = B.envelope(a, b)
    return rows.select("image", "a", "b", F.round(B.iou(a, b, 1e-7), 9).alias("iou"), B.overlaps(a, b, touching=True).alias("touching"), (outer[2] - outer[0]).alias("wide"))


@query(
    f"""with {_BASE} select image, obj, (greatest(least(x2, 120) - greatest(x1, 40), 0) * greatest(least(y2, 100) - greatest(y1, 30), 0))::double as area, (x2 - x1) * (y2 - y1) * 6 as scaled,
    (x1 + 7)::double as moved, 0.25 as bx from lab where least(x2, 120) > greatest(x1, 40) and least(y2, 100) > greatest(y1, 30)"""
)
def clipped_polygons(spark, sf):
    """Boxes as polygons, cut by a rectangle, scaled and moved; the label box of a clamped polygon."""
    own, _ = derived(spark, sf)
    shape = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    cut = polygons.clipped(F.col("coords"), *map(F.lit, (40.0, 30.0, 120.0, 100.0)))
    flat = polygons.box_of(F.array(*[F.lit(v) for v in (0.0, 0.2, 0.5, 0.2, 0.5, 0.4)]))
    rows = own.withColumn("coords", shape).withColumn("cut", cut)
    grown = polygons.area(polygons.scaled(F.col("coords"), 2, 3))
    shown = (F.round(polygons.area(F.col("cut")), 6).alias("area"), grown.alias("scaled"), F.get(polygons.moved(F.col("coords"), 7, 1), 0).alias("moved"), F.get(flat, 0).alias("bx"))
    return rows.where(polygons.area(F.col("cut")) > 0).select("image", "obj", *shown)


@query(
    f"""with {_BASE}, t as (select a * 2 + b as tile, b * 60 as tx1, a * 60 as ty1, b * 60 + 120 as tx2, a * 60 + 120 as ty2 from range(2) as y(a), range(2) as x(b))
    select image, obj, tile, 0 as part, ((least(x2, tx2) - greatest(x1, tx1)) * (least(y2, ty2) - greatest(y1, ty1)))::double as area, (greatest(x1, tx1) - tx1)::double as left
    from lab join t on greatest(x1, tx1) < least(x2, tx2) and greatest(y1, ty1) < least(y2, ty2)"""
)
def tiled_polygons(spark, sf):
    """Polygons in tiles, a row for each part."""
    own, _ = derived(spark, sf)
    rows = own.select("image", "obj", F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2").alias("coords"))
    cut = tables.tiled_polygons(rows, tables.tiles(180, 180, 120, 120, 0.5))
    return cut.select("image", "obj", "tile", "part", F.round(polygons.area(F.col("coords")), 6).alias("area"), F.array_min(polygons.xs(F.col("coords"))).alias("left"))


@query(f"with {_BASE}, {_PAIRS} select image, l_obj, p_obj, cls, round(iou, 7) as iou from pairs")
def polygon_iou_pairs(spark, sf):
    """Boxes as polygons matched by polygon iou."""
    shape = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    own, found = (d.select("image", "obj", "cls", shape.alias("coords")) for d in derived(spark, sf))
    rows = matching.polygon_pairs(own, found, 0.5)
    return rows.select("image", "l_obj", "p_obj", F.col("l_cls").alias("cls"), F.round("iou", 7).alias("iou"))


@query(
    """with m as (select l_orderkey as image, l_linenumber as obj, l_partkey % 3 as cls, [(l_partkey // (1 << k::int) % 2)::int for k in range(8)] as bits from lineitem),
    n as (select image, obj, cls, bits, list_sum(bits) as s from m), p as (select a.image, a.obj as l_obj, b.obj as p_obj, list_sum([x[1] * x[2] for x in list_zip(a.bits, b.bits)]) as c, a.s + b.s as t from n a join n b on a.image = b.image and a.cls = b.cls)
    select image, l_obj, p_obj, round(c / (t - c + 1e-7), 9) as iou from p where c / (t - c + 1e-7) >= 0.5"""
)
def mask_iou_pairs(spark, sf):
    """Flat masks of eight pixels matched by their common pixels."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit("l_partkey", k).cast("double"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("obj"), (F.col("l_partkey") % 3).alias("cls"), bits.alias("mask"))
    return matching.mask_pairs(rows, rows, 0.5).select("image", "l_obj", "p_obj", F.round("iou", 9).alias("iou"))


@query(
    f"""with {_BASE}, {_PAIRS}, r as (select *, row_number() over (partition by image, cls order by conf desc, obj) as rank from pred),
    g as (select * from (values ('all', 0.0, 1e10), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)) as v(area, low, high)),
    placed as (select image, obj, cls, area from lab join g on (x2 - x1) * (y2 - y1) >= low and (x2 - x1) * (y2 - y1) < high),
    totals as (select area, cls, count(*) as n from placed group by 1, 2),
    levels as (select round(0.5 + 0.05 * k, 2) as threshold from range(10) as q(k)), tops as (select unnest([1, 10, 100]) as most),
    ranked as (select most, p.*, threshold, row_number() over (partition by most, p.image, threshold, p_obj order by iou desc, l_obj) as k from pairs p
      join r on r.image = p.image and r.obj = p.p_obj join tops on r.rank <= most join levels on threshold <= iou),
    hits as (select most, image, threshold, l_obj from (select *, row_number() over (partition by most, image, threshold, l_obj order by p_obj) as m from ranked where k = 1) x where m = 1),
    found as (select most, area, p.cls, count(*) as hits from placed p join hits h on h.image = p.image and h.l_obj = p.obj group by 1, 2, 3)
    select tops.most, t.area, round(avg(coalesce(f.hits, 0) / t.n / 10.0), 9) as recall from totals t cross join tops left join found f on f.most = tops.most and f.area = t.area and f.cls = t.cls group by 1, 2"""
)
def recall_by_size(spark, sf):
    """Recall at 1, 10 and 100 detections for all, small, medium and large labels."""
    rows = matching.recall_summary(*derived(spark, sf))
    return rows.select("most", "area", F.round("recall", 9).alias("recall"))


@query(f"with {_BASE}, {_PAIRS}, {_GREEDY} select threshold::double as threshold, round(sum(hits) / (select count(*) from lab)::double, 9) as ap from (select threshold, count(*) as hits from matches group by 1) x group by 1")
def step_precision(spark, sf):
    """Step-wise area under curves of one point each: precision one at the recall reached."""
    own, _, hits = matched(spark, sf)
    total = own.agg(F.count("*").alias("n"))
    curve = hits.groupBy("threshold").agg(F.count("*").alias("hits")).join(F.broadcast(total))
    rows = matching.step_average_precision(curve.select("threshold", (F.col("hits") / F.col("n")).alias("recall"), F.lit(1.0).alias("precision")), ["threshold"])
    return rows.select("threshold", F.round("ap", 9).alias("ap"))


@query(
    """with s as (select p_partkey, [p_size::double, p_partkey % 11, p_partkey % 5] as v from part)
    select p_partkey, (list_position(v, list_max(v)) - 1)::int as cls, list_max(v) as conf from s"""
)
def best_class(spark, sf):
    scores = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 11).cast("double"), (F.col("p_partkey") % 5).cast("double"))
    return table(spark, sf, "part").select("p_partkey", geometry.best_class(scores).alias("b")).select("p_partkey", "b.cls", "b.conf")


@query(
    """with c as (select p_partkey, p_size::double as a, (p_partkey % 50)::double as b, (p_partkey % 17)::double as c, (p_partkey % 29)::double as d, p_partkey % 256 as r, p_partkey % 200 as g, p_size as bl from part),
    n as (select *, ((b + d) - (a + c)) / 60 as dx, ((c + d) - (a + b)) / 60 as dy from c), l as (select *, sqrt(dx * dx + dy * dy + 1) as s from n)
    select p_partkey, round((0 - dx) / s, 9) as nx, round(1 / s, 9) as nz, round(greatest(0, (-dx / s) * cos(radians(45)) * sin(radians(315)) + (-dy / s) * cos(radians(45)) * cos(radians(315)) + sin(radians(45)) / s), 9) as shade,
    round(0.2126 * case when r / 255 <= 0.03928 then r / 255 / 12.92 else pow((r / 255 + 0.055) / 1.055, 2.4) end + 0.7152 * case when g / 255 <= 0.03928 then g / 255 / 12.92 else pow((g / 255 + 0.055) / 1.055, 2.4) end
    + 0.0722 * case when bl / 255 <= 0.03928 then bl / 255 / 12.92 else pow((bl / 255 + 0.055) / 1.055, 2.4) end, 9) as light from l"""
)
def surface_light(spark, sf):
    """Surface normals, shading and luminance."""
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    normal = geometry.surface_normal(d(F.col("p_size")), d(k % 50), d(k % 17), d(k % 29), 30.0)
    light = geometry.luminance(k % 256, k % 200, F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.round(F.get(normal, 0), 9).alias("nx"), F.round(F.get(normal, 2), 9).alias("nz"), F.round(geometry.lambert(normal, 315.0, 45.0), 9).alias("shade"), F.round(light, 9).alias("light"))


@query(
    """with c as (select p_partkey, p_size - 25.0::double as x, p_partkey % 13 - 6.5::double as y, p_partkey % 7 - 3.5::double as z from part)
    select p_partkey, ((floor((atan2(y, x) + pi()) / (2 * pi()) * 360)::int % 360) + 360) % 360 as px, least(floor((pi() / 2 - asin(z / sqrt(x * x + y * y + z * z))) / pi() * 180)::int, 179) as py,
    round(x * cos(0.5) - y * sin(0.5), 6) as rx, round(x * sin(0.5) + y * cos(0.5), 6) as ry, 24 as n_edges, round(12 * 2 * x / 2 + 12 * (x + 2) - 12 * x, 6) as sum_x from c"""
)
def panorama_points(spark, sf):
    """Directions in a panorama, rotated points and points on the edges of a 3-D box."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 25.0).alias("x"), (k % 13 - 6.5).alias("y"), (k % 7 - 3.5).alias("z"))
    x, y, z = (F.col(c) for c in "xyz")
    px, py = geometry.panorama_pixel(x, y, z, 360, 180)
    rx, ry, _ = geometry.rotated(x, y, z, 0.0, 0.0, 0.5)
    edges = geometry.box_edges((x, y, z), (x + 2, y + 2, z + 2), 2)
    total = F.aggregate(edges, F.lit(0.0), lambda s, p: s + p["x"])
    return rows.select(
        "p_partkey", px.cast("int").alias("px"), py.cast("int").alias("py"), F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), F.size(edges).alias("n_edges"), F.round(total - 12 * x, 6).alias("sum_x")
    )


@query(
    """select vec_id, round(12 * sin(pi() / 6) * 9 / 2, 6) as area, (3 + vec_id % 5)::double as right, floor(vec_id % 5 + 0.9)::int as rx from embeddings"""
)
def circle_polygons(spark, sf):
    """Circles as polygons of twelve points, and the pixels that a polygon covers."""
    rows = table(spark, sf, "embeddings").withColumn("cx", (F.col("vec_id") % 5).cast("double"))
    ring = polygons.circle(F.col("cx"), F.lit(0.0), F.lit(3.0))
    box = polygons.raster_box(F.array(*[F.col("cx") + 0.4, F.lit(0.0), F.col("cx") + 9, F.lit(3.0), F.col("cx") + 5, F.lit(8.0)]))
    return rows.select("vec_id", F.round(polygons.area(ring), 6).alias("area"), F.round(F.array_max(polygons.xs(ring)), 6).alias("right"), F.get(box, 0).alias("rx"))


# ------------------------------------------------------------------ tables


@query("select '0_' || o_orderkey as image, case (o_orderkey % 3) when 0 then 7 else o_orderkey % 3 end as cls from orders where o_orderkey % 4 <> 1 union all select '1_' || l_orderkey, case l_linenumber when 0 then 7 else l_linenumber end from lineitem where l_linenumber not in (3)")
def merged_sets(spark, sf):
    """Two data sets joined: names kept apart, classes remapped, dropped ones left out."""
    a = table(spark, sf, "orders").where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("image"), (F.col("o_orderkey") % 3).cast("int").alias("cls"))
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").cast("int").alias("cls"))
    return tables.merged([a, b], {0: 7}, [3])


@query("select 'image' as kind, o_orderkey as id from orders where o_orderkey % 10 <> 3 union all select 'box', l_orderkey from lineitem where l_orderkey % 10 <> 3")
def images_deleted(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    annos = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"))
    left, right = tables.without_images(images, annos, images.where("id % 10 = 3"))
    return left.select(F.lit("image").alias("kind"), "id").union(right.select(F.lit("box"), "image_id"))


@query("select event_id as source_id, user_id, null::varchar as extra from events union all select c_custkey, null, c_mktsegment from customer")
def result_union(spark, sf):
    """A union by name in which each table lacks a column."""
    a = table(spark, sf, "events").select(F.col("event_id").alias("source_id"), "user_id")
    return tables.union(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("extra")))


@query("select count(*)::bigint as n, count(distinct doc_id)::bigint as n_docs, count(distinct case when c > 1 then t end)::bigint as n_repeated from (select doc_id, md5(coalesce(text, '')) as t, count(*) over (partition by md5(coalesce(text, ''))) as c from documents) x")
def equal_contents(spark, sf):
    """Exact copies by a hash of their content."""
    rows = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("content", tables.equal_content(rows, "text"))
    groups = keyed.groupBy("content").agg(F.count("*").alias("c"), F.countDistinct("doc_id").alias("d"))
    return groups.agg(F.sum("c").alias("n"), F.sum("d").alias("n_docs"), F.count_if(F.col("c") > 1).alias("n_repeated"))


@query("select 'in/' || s_suppkey || '.jpg' as source, 'out/' || s_suppkey || '.jpg' as target from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49)")
def copy_plan(spark, sf):
    listing = table(spark, sf, "supplier").select(F.concat(F.lit("in/"), F.col("s_suppkey").cast("string"), F.lit(".jpg")).alias("path"))
    wanted = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").cast("string").alias("stem"))
    return tables.copy_plan(wanted, listing, "stem", "out")


@query(
    """with a as (select o_custkey as key, count(*) as n from orders group by 1), b as (select user_id as key, count(*) as n from events group by 1)
    select coalesce(a.key, b.key) as key, coalesce(a.n, 0) as n_a, coalesce(b.n, 0) as n_b, coalesce(a.n, 0) = coalesce(b.n, 0) as equal from a full join b on a.key = b.key"""
)
def count_report(spark, sf):
    return tables.count_report(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf, "events").select(F.col("user_id").alias("key")), "key")


@query(
    """with e as (select vec_id, vec_id // 2 as pair, embedding::double[] as v from embeddings), s as (select *, len(v) as n, list_sum(v) / len(v) as m, list_sum([x * x for x in v]) / len(v) as q from e),
    p as (select a.vec_id as a, b.vec_id as b, a.m as ma, b.m as mb, a.q - a.m * a.m as va, b.q - b.m * b.m as vb, list_dot_product(a.v, b.v) / a.n - a.m * b.m as cov from s a join s b on a.pair = b.pair and a.vec_id < b.vec_id),
    r as (select a, b, (2 * ma * mb + 1e-4) / (ma * ma + mb * mb + 1e-4) * (2 * cov + 9e-4) / (va + vb + 9e-4) as similarity from p) select a, b, round(similarity, 6) as similarity from r where similarity > 0.05"""
)
def verified_pairs(spark, sf):
    """Pairs of one origin in two sets, kept if their contents are alike."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.expr("vec_id div 2").alias("pair"), (F.col("vec_id") % 2).alias("set"))
    pairs = tables.same_origin_pairs(rows, ["pair"], "set", "vec_id").select("a", "b")
    found = tables.verified_pairs(pairs, table(spark, sf, "embeddings"), "vec_id", "embedding", 0.05)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("select user_id, d.type as type, value, event_id from (select user_id, event_type as type, min(struct_pack(v := value, e := event_id)) as m from events group by 1, 2) d, lateral (select m.v as value, m.e as event_id) x")
def nearest_per_cell(spark, sf):
    """The nearest point of each pixel, by the smallest distance."""
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("type"), "value", "event_id")
    return joins.nearest_per_pixel(rows, ["user_id", "type"], "value", ["event_id"])


@query("select event_id, user_id from events qualify row_number() over (partition by user_id order by value desc, event_id) = 1")
def once_per_match(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "value")
    return joins.once_per_match(rows, F.col("user_id"), F.struct((-F.col("value")).alias("v"), F.col("event_id"))).select("event_id", "user_id")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k from orders) x where k not in (0, 5, 17)")
def places_excluded(spark, sf):
    return ordering.without_places(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", [0, 5, 17])


@query("select 'test' as split, floor((select count(*) from customer) * 0.8 + 0.1 * count(*) + 1e-9)::bigint - floor(count(*) * 0.8 + 1e-9)::bigint as n from customer union all select 'train', floor(count(*) * 0.8 + 1e-9)::bigint from customer union all select 'val', count(*) - floor((count(*) * (0.8 + 0.1)) + 1e-9)::bigint from customer")
def split_three_ways(spark, sf):
    """Sizes of a seeded split into train, test and val."""
    rows = ordering.three_way_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.8, 0.1)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


@query(f"with {_BASE} select image::varchar as image, coalesce(string_agg(cls::varchar, ',' order by conf desc, obj), '') as classes, count(cls) as n from (select distinct image from lab) i left join pred using (image) group by 1")
def submission_rows(spark, sf):
    """One row an image with its classes by falling confidence; an empty one for images without."""
    own, found = derived(spark, sf)
    rows = label_files.submission(own.select("image").distinct(), found)
    n = F.when(F.col("classes") == "", F.lit(0)).otherwise(F.size(F.split("classes", ",")))
    return rows.select(F.col("image").cast("string").alias("image"), "classes", n.cast("long").alias("n"))


@query(
    f"""with {_BASE}, u as (select image, obj, unnest([0, 1, 2, 3]) as att, unnest([a0, a1, a2, a3]) as level from lab)
    select image, obj, att, level, att || '/' || level || '/' || image || '_' || obj as file from u"""
)
def crop_layout(spark, sf):
    """Where the crop of each object goes, for each of its attributes."""
    return label_files.crop_layout(derived(spark, sf)[0], F.col("atts"))


@query()
def weighted_choice(spark, sf):
    """A hundred parts drawn by their price, without replacement."""
    return ordering.weighted_choice(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", "p_retailprice", 100)


@query()
def shown_subset(spark, sf):
    """At most three boxes of each of twenty images, as a review shows them."""
    own, _ = derived(spark, sf)
    return ordering.shown_subset(own.select("image").distinct(), own.select("image", "obj"), "image", "obj", 20, 3)


@query()
def sample_distinct(spark, sf):
    """Fifty customers in a seeded order, of the first one of each nation and segment."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return ordering.sample_distinct(rows, ["c_nationkey", "c_mktsegment"], [F.col("c_custkey")], 50)


# ------------------------------------------------------------------ documents of annotations as text


def framed(spark, sf):
    """Boxes with the fields that document writers ask for."""
    own, _ = derived(spark, sf)
    return own.select(F.concat(F.lit("i"), F.col("image").cast("string")).alias("image"), F.lit(320).alias("width"), F.lit(240).alias("height"), "obj", F.concat(F.lit("c"), F.col("cls").cast("string")).alias("name"), "x1", "y1", "x2", "y2", "atts")


@query(f"with {_BASE} select 'i' || image as file, 320 as width, (row_number() over (partition by image order by obj) - 1)::int as obj, 'c' || cls as name, x1::int as x1, y2::int as y2 from lab")
def voc_roundtrip(spark, sf):
    """XML annotations written and read again."""
    rows = documents.voc_of(documents.voc_documents(framed(spark, sf)).select(F.col("image").alias("file"), F.col("xml").alias("value")))
    return rows.select("file", F.col("width").cast("int").alias("width"), F.col("obj").cast("int").alias("obj"), "name", F.col("x1").cast("int").alias("x1"), F.col("y2").cast("int").alias("y2"))


@query(f"with {_BASE} select 'i' || image as image, 240 as height, (row_number() over (partition by image order by obj) - 1)::int as obj, 'c' || cls as label, 4 as n, x2::double as right, a0::varchar as worn from lab")
def shapes_roundtrip(spark, sf):
    """Polygon documents with attributes written and read again."""
    rows = framed(spark, sf).withColumns(
        {
            "points": F.array(F.array("x1", "y1"), F.array("x2", "y2")),
            "label": F.col("name"),
            "shape_type": F.lit("rectangle"),
            "attributes": F.create_map(F.lit("worn"), F.get("atts", 0).cast("string")),
        }
    )
    out = documents.shapes_of(documents.shape_documents(rows).select(F.col("image").alias("file"), F.col("json").alias("value")))
    return out.select(F.regexp_replace("file", r"\..*$", "").alias("image"), F.col("height").cast("int").alias("height"), F.col("obj").cast("int").alias("obj"), "label", F.size("coords").alias("n"), F.get("coords", 2).alias("right"), F.try_element_at("attributes", F.lit("worn")).alias("worn"))


@query(f"with {_BASE} select 'i' || image as image, (row_number() over (partition by image order by obj) - 1)::int as obj, x1::double as x, y2 - y1 as h from lab")
def face_blocks(spark, sf):
    """Blocks of a name, a count and its rows, many images in one text."""
    own = framed(spark, sf).withColumn("line", F.concat_ws(" ", *[c.cast("int").cast("string") for c in (F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))]))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obj", "line"))), lambda r: r["line"]), "\n")
    blocks = own.groupBy("image").agg(F.concat_ws("\n", "image", F.count("*").cast("string"), block).alias("block"))
    empty = F.concat(F.lit("none\n0\n0 0 0 0\n"), F.array_join(F.collect_list("block"), "\n"))
    texts = blocks.groupBy((F.xxhash64("image") % 16).alias("file")).agg(empty.alias("value"))
    return documents.face_blocks_of(texts).select("image", "obj", "x", "h")


@query("select o_custkey::varchar as file, (count(*) // 3)::int as epochs, round(avg(o_orderkey % 90 / 100.0) filter (k < 3), 2) as first from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k from orders) x group by 1 having count(*) >= 3")
def training_logs(spark, sf):
    """Epochs of logs with a row for each of three classes; the last epoch may be short."""
    line = F.concat(F.lit("defect1 | "), F.format_string("%.2f", F.col("o_orderkey") % 90 / 100), F.lit(" | x"))
    own = F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line"))))
    logs = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("file")).agg(F.array_join(F.transform(own, lambda r: r["line"]), "\n").alias("value"), F.count("*").alias("n"))
    rows = documents.training_log_of(logs.where("n >= 3"))
    whole = rows.join(logs.select("file", F.expr("int(n div 3)").alias("epochs")), "file")
    return whole.where("epoch < epochs").groupBy("file", "epochs").agg(F.max(F.when(F.col("epoch") == 0, F.col("miou"))).alias("first")).select("file", "epochs", "first")


@query("select user_id::varchar as file, count(*) as n, sum(event_id)::double as x, min(value)::double as low from events group by 1")
def trajectories(spark, sf):
    """Point-cloud text with a header, read from its DATA line on."""
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.lit("0.5"), F.col("value").cast("string"), F.lit("7"), *[F.lit("1")] * 9)
    text_of = F.concat(F.lit("VERSION .7\nFIELDS x y z\nDATA ascii\n"), F.array_join(F.collect_list(line), "\n"))
    files = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(text_of.alias("value"))
    return documents.trajectory_of(files).groupBy("file").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.min("z").alias("low"))


@query(f"with {_BASE} select image, obj, cls, x1::int as x, (x2 - x1)::int as w, (x2 - x1)::int * (y2 - y1)::int as area from lab")
def coco_annotation_entries(spark, sf):
    """COCO entries of absolute boxes in whole pixels."""
    own, _ = derived(spark, sf)
    rows = documents.coco_annotations(own.select(F.col("image").alias("image_id"), "obj", "cls", "x1", "y1", "x2", "y2"))
    box = lambda k: F.get("bbox", k).cast("int")
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("id"))
    order = own.select("image", "obj", F.row_number().over(Window.partitionBy("image").orderBy("obj")).alias("k"))
    found = rows.select(F.col("image_id").alias("image"), F.col("category_id").alias("cls"), box(0).alias("x"), box(2).alias("w"), F.col("area").cast("int").alias("area"), place.alias("k"))
    return found.join(order, ["image", "k"]).select("image", "obj", "cls", "x", "w", "area")


@query("select conv_id, count(*) as n, min(conv_id)::varchar || '.jpg' as image, string_agg(text, '|' order by turn) as said from conversations group by conv_id")
def conversation_documents(spark, sf):
    """Conversation records as JSON, parsed again."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.concat(F.col("conv_id").cast("string"), F.lit(".jpg")).alias("image"), "turn", F.col("role").alias("speaker"), F.col("text").alias("value"))
    parsed = documents.conversations(turns).select("id", F.from_json("json", "id string, image string, conversations array<struct<from: string, value: string>>").alias("d"))
    said = F.array_join(F.transform("d.conversations", lambda t: t["value"]), "|")
    return parsed.select(F.col("id").cast("long").alias("conv_id"), F.size("d.conversations").cast("long").alias("n"), "d.image", said.alias("said"))


@query()
def changes_to_next(spark, sf):
    """Vectors as 8 x 8 images, each against the next one: shift, turn and mirror."""
    images = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("part"), F.slice("embedding", 1, 64).alias("image"))
    rows = ordering.changes_to_next(images, ["part"], [F.col("vec_id")], "image", 8)
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in ("shift", "turn", "mirror")])
