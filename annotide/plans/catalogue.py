"""Queries over the driver's tables, and the same queries as SQL.

Orders, parts and events stand for images, classes and captures; boxes,
predictions and attributes are derived from line items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annotide.functions import boxes as B
from annotide.functions import geometry, polygons, text
from annotide.operators import joins, labels, matching, ordering, statistics, suppression, tables
from annotide.streaming import sensor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ derived boxes

_BASE = """
base as (
  select l_orderkey // 8 as image, (l_orderkey % 8) * 8 + l_linenumber as obj, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_quantity) as q,
         min(l_discount) as d, min(l_tax) as t, min(case when l_returnflag = 'R' then 1 else 0 end) as a0, min(case when l_linestatus = 'F' then 1 else 0 end) as a1,
         min(case when l_discount > 0.05 then 1 else 0 end) as a2, min(case when l_tax > 0.04 then 1 else 0 end) as a3
  from lineitem group by 1, 2
), lab as (
  select image, obj, pk % 5 as cls, (pk * 7 % 120)::double as x1, ((sk * 11 + obj * 37) % 90)::double as y1, pk * 7 % 120 + 20 + q as x2,
         (sk * 11 + obj * 37) % 90 + 20 + pk % 40 + 0.0::double as y2, a0, a1, a2, a3, pk from base
), pred as (
  select image, obj, case when sk % 10 = 0 then (pk + 1) % 5 else pk % 5 end as cls, (pk * 7 % 120 + obj * 3 % 9 - 4)::double as x1,
         ((sk * 11 + obj * 37) % 90 + pk % 7 - 3)::double as y1, pk * 7 % 120 + obj * 3 % 9 - 4 + 20 + q as x2,
         (sk * 11 + obj * 37) % 90 + pk % 7 - 3 + 20 + pk % 40 + 0.0::double as y2, round(0.5 + 3 * d + t, 4) as conf,
         case when pk % 3 = 0 then 1 - a0 else a0 end as a0, a1, a2, a3, pk from base where pk % 8 <> 0
)"""
_PAIRS = """
pairs as (
  select l.image, l.obj as l_obj, p.obj as p_obj, l.cls, c.v / (l.s + p.s - c.v) as iou
  from (select *, (x2 - x1) * (y2 - y1) as s from lab) l join (select *, (x2 - x1) * (y2 - y1) as s from pred) p on l.image = p.image and l.cls = p.cls,
       lateral (select greatest(least(l.x2, p.x2) - greatest(l.x1, p.x1), 0) * greatest(least(l.y2, p.y2) - greatest(l.y1, p.y1), 0) as v) c
  where c.v / (l.s + p.s - c.v) >= 0.5
)"""
_GREEDY = """
levels as (select round(0.5 + 0.05 * k, 2) as threshold from range(10) as r(k)),
ranked as (select p.*, threshold, row_number() over (partition by image, threshold, p_obj order by iou desc, l_obj) as n from pairs p join levels on threshold <= iou),
matches as (select image, threshold, l_obj, p_obj, cls, iou from (select *, row_number() over (partition by image, threshold, l_obj order by p_obj) as m from ranked where n = 1) x where m = 1)"""
_AP = """
sizes as (select cls, count(*) as n_labels from lab group by cls),
marked as (
  select p.cls, v.threshold, p.conf, p.image, p.obj, case when m.p_obj is null then 0 else 1 end as hit
  from pred p cross join levels v left join matches m on m.image = p.image and m.threshold = v.threshold and m.p_obj = p.obj
), counted as (
  select m.cls, threshold, sum(hit) over w as tp, row_number() over w as k, n_labels
  from marked m join sizes s on s.cls = m.cls window w as (partition by m.cls, threshold order by conf desc, image, obj rows between unbounded preceding and current row)
), curve as (
  select cls, threshold, k, tp / (n_labels + 1e-16) as r, max(tp::double / k) over (partition by cls, threshold order by k rows between current row and unbounded following) as p from counted
), points as (
  select cls, threshold, k, r, p from curve
  union all select distinct cls, threshold, 0, 0.0, 1.0 from curve
  union all select distinct cls, threshold, 1000000000, 1.0, 0.0 from curve
), spans as (
  select cls, threshold, r, p, lead(r) over w as r2, lead(p) over w as p2 from points window w as (partition by cls, threshold order by r, k)
), readings as (
  select cls, threshold, i, p + (i / 100.0::double - r) / (r2 - r) * (p2 - p) as v
  from spans join range(101) as g(i) on r2 > r and i >= ceil(r * 100 - 1e-9) and i <= ceil(r2 * 100 - 1e-9) - 1
), summed as (
  select cls, threshold, sum(case when i = 0 then v / 2 else v end) / 100 as ap from readings group by cls, threshold
), ap as (
  select s.cls, v.threshold, coalesce(x.ap, 0.0) as ap from sizes s cross join levels v left join summed x on x.cls = s.cls and x.threshold = v.threshold
)"""


def derived(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Label boxes and predictions.  One shuffle, by image, serves all that follows."""
    rows = table(spark, sf, "lineitem").withColumns(
        {"image": F.expr("l_orderkey div 8"), "obj": (F.col("l_orderkey") % 8) * 8 + F.col("l_linenumber")}
    )
    flag = lambda c: F.min(c.cast("int"))
    base = (
        rows.repartition("image")
        .groupBy("image", "obj")
        .agg(
            F.min("l_partkey").alias("pk"),
            F.min("l_suppkey").alias("sk"),
            F.min("l_quantity").alias("q"),
            F.min("l_discount").alias("d"),
            F.min("l_tax").alias("t"),
            F.array(flag(F.col("l_returnflag") == "R"), flag(F.col("l_linestatus") == "F"), flag(F.col("l_discount") > 0.05), flag(F.col("l_tax") > 0.04)).alias("atts"),
        )
    )
    x, y = F.col("pk") * 7 % 120, (F.col("sk") * 11 + F.col("obj") * 37) % 90
    w, h = 20 + F.col("q"), 20 + F.col("pk") % 40
    box = lambda a, b: {"x1": a.cast("double"), "y1": b.cast("double"), "x2": (a + w).cast("double"), "y2": (b + h).cast("double")}
    shown = ["image", "obj", "cls", "x1", "y1", "x2", "y2"]
    own = base.withColumns({"cls": F.col("pk") % 5, **box(x, y)}).select(*shown, "atts", "pk")
    flipped = F.transform("atts", lambda v, i: F.when((i == 0) & (F.col("pk") % 3 == 0), 1 - v).otherwise(v))
    found = base.where("pk % 8 <> 0").withColumns(
        {
            "cls": F.when(F.col("sk") % 10 == 0, (F.col("pk") + 1) % 5).otherwise(F.col("pk") % 5),
            "conf": F.round(0.5 + 3 * F.col("d") + F.col("t"), 4),
            "atts": flipped,
            **box(x + F.col("obj") * 3 % 9 - 4, y + F.col("pk") % 7 - 3),
        }
    )
    return own, found.select(*shown, "conf", "atts", "pk")


def matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own, found = derived(spark, sf)
    columns = ["image", "obj", "cls", "x1", "y1", "x2", "y2"]
    return own, found, matching.greedy(matching.iou_pairs(own.select(*columns), found.select(*columns), 0.5))


# ------------------------------------------------------------------ statistics


@query("select p_brand, count(*) as n from lineitem join part on l_partkey = p_partkey group by p_brand")
def category_counts(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k"))  # counted before the join
    named = rows.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy("p_brand").agg(F.sum("k").alias("n")).orderBy("p_brand")


@query("select size, count(*) as n from (select l_orderkey, count(*) as size from lineitem group by 1) x group by size")
def group_size_histogram(spark, sf):
    return statistics.group_sizes(table(spark, sf, "lineitem"), "l_orderkey")


_EDGES = [900, 950, 1000, 1100, 1200, 1300, 1400, 1500, 1700, 2000, 3000]


@query(
    f"""with e as (select unnest({_EDGES}) as low, unnest({_EDGES[1:] + [None]}) as high, unnest(range({len(_EDGES)})) as bin),
    v as (select l_extendedprice / l_quantity as v from lineitem)
    select bin::int as bin, low::double as low, high::double as high, (select count(*) from v where (v > low or bin = 0 and v = low) and v <= high) as n from e where high is not null""".replace("None", "null")
)
def binned_ratio_counts(spark, sf):
    return statistics.binned(table(spark, sf, "lineitem"), F.col("l_extendedprice") / F.col("l_quantity"), _EDGES)


_FLAGS = "case when o_orderpriority like '1%' then 1 else 0 end as urgent, case when o_totalprice > 200000 then 1 else 0 end as dear, case when o_orderdate >= timestamp '1996-01-01' then 1 else 0 end as late"


def flagged_orders(spark, sf):
    flag = lambda c: F.when(c, 1).otherwise(0)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        flag(F.col("o_orderpriority").like("1%")).alias("urgent"),
        flag(F.col("o_totalprice") > 200000).alias("dear"),
        flag(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")).alias("late"),
    )


@query(
    f"""with f as (select *, {_FLAGS} from orders)
    select case when grouping(o_orderstatus) = 1 then 'total' else o_orderstatus end as o_orderstatus, sum(urgent)::bigint as urgent, sum(dear)::bigint as dear, sum(late)::bigint as late
    from f group by rollup (o_orderstatus)"""
)
def attribute_totals_rollup(spark, sf):
    return statistics.totals_with_all(flagged_orders(spark, sf), "o_orderstatus", ["urgent", "dear", "late"])


@query(
    """with s as (select user_id, sum(case when event_type = 'error' then 1 else 0 end) as s from events group by user_id)
    select count(*) as groups, count(*) filter (s = 0) as zero, count(*) filter (s > 0) as positive from s"""
)
def zero_positive_groups(spark, sf):
    return statistics.zero_and_positive(table(spark, sf, "events"), "user_id", F.col("event_type") == "error")


@query(
    f"""with f as (select *, {_FLAGS} from orders where o_custkey in (select c_custkey from customer where c_mktsegment like 'A%'))
    select 'urgent' as attribute, sum(urgent)::bigint as total, round(avg(urgent), 9) as rate from f
    union all select 'dear', sum(dear)::bigint, round(avg(dear), 9) from f union all select 'late', sum(late)::bigint, round(avg(late), 9) from f"""
)
def attribute_rates(spark, sf):
    chosen = table(spark, sf, "customer").where(F.col("c_mktsegment").like("A%")).select(F.col("c_custkey").alias("o_custkey"))
    rows = joins.in_reference(flagged_orders(spark, sf), chosen, "o_custkey")
    return statistics.rates(rows, ["urgent", "dear", "late"]).withColumn("rate", F.round("rate", 9))


_TYPES = ["click", "error", "purchase", "signup", "view"]
_PRESENCE = "presence as (select user_id, ts::date as day, " + ", ".join(f"max(case when event_type = '{t}' then 1 else 0 end) as {t}" for t in _TYPES) + " from events group by 1, 2)"
_MATRIX = "matrix as (" + " union all ".join(f"select '{a}' as i, '{b}' as j, sum({a} * {b})::double / count(*) as v from presence" for a in _TYPES for b in _TYPES) + ")"


def presence_matrix(spark, sf, background=True):
    rows = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(*[F.max((F.col("event_type") == t).cast("int")).alias(t) for t in _TYPES])
    return statistics.cooccurrence(rows, _TYPES, background)


def rounded(df, column="v"):
    return df.withColumn(column, F.round(column, 9))


@query(f"with {_PRESENCE}, {_MATRIX} select i, j, round(v, 9) as v from matrix")
def cooccurrence_matrix(spark, sf):
    return rounded(presence_matrix(spark, sf))


@query(f"with {_PRESENCE}, {_MATRIX} select m.i, m.j, round(m.v / nullif(d.v, 0), 9) as v from matrix m join matrix d on d.i = m.i and d.j = m.i")
def cooccurrence_by_diagonal(spark, sf):
    return rounded(statistics.by_diagonal(presence_matrix(spark, sf)))


@query(f"with {_PRESENCE}, {_MATRIX}, n as (select m.i, m.j, m.v / nullif(d.v, 0) as v from matrix m join matrix d on d.i = m.i and d.j = m.i) select a.i, a.j, round((a.v + b.v) / 2, 9) as v from n a join n b on a.i = b.j and a.j = b.i")
def cooccurrence_symmetric(spark, sf):
    return rounded(statistics.symmetric(statistics.by_diagonal(presence_matrix(spark, sf))))


@query(f"with {_PRESENCE}, {_MATRIX} select m.i, m.j, round(m.v / nullif(sqrt(a.v * b.v), 0), 9) as v from matrix m join matrix a on a.i = m.i and a.j = m.i join matrix b on b.i = m.j and b.j = m.j")
def cooccurrence_cosine(spark, sf):
    return rounded(statistics.cosine_normalised(presence_matrix(spark, sf)))


@query(f"with {_PRESENCE}, {_MATRIX} select m.j as i, m.i as j, round(m.v / nullif(d.v, 0), 9) as v from matrix m join matrix d on d.i = m.i and d.j = m.i")
def cooccurrence_transposed(spark, sf):
    return rounded(statistics.transposed(statistics.by_diagonal(presence_matrix(spark, sf))))


def _moments(source: str, value: str) -> str:
    return f"""select count(*) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, round(stddev_pop(v), 6) as std, round(min(v), 6) as low, round(max(v), 6) as high,
    round(sum(v), 4) as total, round(var_pop(v), 4) as variance, round((avg(v*v*v) - 3 * avg(v) * avg(v*v) + 2 * pow(avg(v), 3)) / pow(var_pop(v), 1.5), 6) as skew,
    round(kurtosis_pop(v), 6) as kurtosis from (select ({value})::double as v from {source}) x"""


def distribution_of(df, value):
    rows = statistics.distribution(df, value)
    places = {"total": 4, "variance": 4}
    return rows.select("n", *[F.round(c, places.get(c, 6)).alias(c) for c in rows.columns if c != "n"])


@query(_moments("part", "p_size * p_retailprice / 1000"))
def area_distribution(spark, sf):
    return distribution_of(table(spark, sf, "part"), F.col("p_size") * F.col("p_retailprice") / 1000)


@query(_moments("documents", "n_chars / 1000.0"))
def length_distribution(spark, sf):
    return distribution_of(table(spark, sf, "documents"), F.col("n_chars") / 1000.0)


@query(
    """with v as (select p_retailprice as v from part), s as (select count(*) as n, min(v) as lo, max(v) as hi, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from v),
    b as (select *, greatest(ceil(log2(n)) + 1, ceil((hi - lo) / (2 * (q3 - q1) / pow(n, 1.0/3))), 1) as bins from s), c as (select *, (hi - lo) / bins as step from b)
    select least(bins - 1, floor((v - lo) / step))::int as bin, count(*) as n from v, c group by 1"""
)
def auto_histogram(spark, sf):
    return statistics.auto_histogram(table(spark, sf, "part"), F.col("p_retailprice")).select("bin", "n")


@query("select distinct o_totalprice as value, round(cume_dist() over (order by o_totalprice), 9) as share from orders")
def cdf_points(spark, sf):
    return rounded(statistics.cumulative_share(table(spark, sf, "orders"), "o_totalprice"), "share")


@query("select least(9, floor(p_size / 51.0 * 10))::int as bx, least(9, greatest(0, floor((p_retailprice - 900) / 1300 * 10)))::int as by, count(*) as n from part group by 1, 2")
def density_grid(spark, sf):
    return statistics.density(table(spark, sf, "part"), F.col("p_size") / 51.0, (F.col("p_retailprice") - 900) / 1300, 10)


@query(
    """select t as threshold, count(*) as n, count(distinct user_id) as n_keys, sum(case when event_type = 'error' then 1 else 0 end)::bigint as errors,
    sum(case when event_type in ('purchase', 'signup') then 1 else 0 end)::bigint as gains from events, (values (10.0::double), (50.0), (75.0), (90.0), (99.0)) as x(t) where value >= t group by t"""
)
def threshold_sweep(spark, sf):
    flags = {"errors": F.col("event_type") == "error", "gains": F.col("event_type").isin("purchase", "signup")}
    return statistics.threshold_sweep(table(spark, sf, "events"), "value", [10.0, 50.0, 75.0, 90.0, 99.0], "user_id", flags)


@query(
    """select source, count(*) as n_rows, count(distinct text) as n_images, count(*) filter (lang = 'de') as de, count(*) filter (lang = 'en') as en,
    count(*) filter (lang = 'es') as es, count(*) filter (lang = 'fr') as fr from documents group by source"""
)
def registry_stats(spark, sf):
    return statistics.registry(table(spark, sf, "documents"), ["source"], "text", "lang", ["de", "en", "es", "fr"])


@query(
    """select case when grouping(o_orderstatus) = 1 then 'all' else o_orderstatus end as o_orderstatus, count(*) filter (not o_totalprice < 50000) as kept,
    count(*) filter (o_totalprice < 50000) as dropped from orders group by rollup (o_orderstatus)"""
)
def keep_drop_rollup(spark, sf):
    return statistics.kept_and_dropped(table(spark, sf, "orders"), "o_orderstatus", F.col("o_totalprice") < 50000)


@query("select r_name, string_agg(n_name, ',' order by n_name) as nations from nation join region on n_regionkey = r_regionkey group by r_name")
def inverse_map(spark, sf):
    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return statistics.inverted(rows, "r_name", "n_name").select("r_name", F.array_join("keys", ",").alias("nations"))


@query(
    """with x as (select event_type, key, props ->> ('$.' || key) as value, event_id from (select event_type, event_id, props, unnest(json_keys(props)) as key from events) y)
    select event_type, key as attribute, value, min(event_id) as first from x group by 1, 2, 3"""
)
def distinct_attribute_values(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", F.explode(F.from_json("props", "map<string,string>")).alias("attribute", "value"))
    return rows.groupBy("event_type", "attribute", "value").agg(F.min("event_id").alias("first"))


@query(
    """select p_type, min(p_retailprice) as low, max(p_retailprice) as high, arg_min(p_partkey, (p_retailprice, p_partkey)) as low_p_partkey,
    arg_min(p_partkey, (-p_retailprice, p_partkey)) as high_p_partkey from part group by p_type"""
)
def extreme_places(spark, sf):
    return statistics.extremes(table(spark, sf, "part"), ["p_type"], "p_retailprice", ["p_partkey"])


@query("select user_id, arg_max(value, event_id) as last_value, arg_max(event_type, event_id) as last_type, count(*) as n from events group by user_id")
def best_row(spark, sf):
    last = F.max(F.struct("event_id", "value", "event_type"))
    rows = table(spark, sf, "events").groupBy("user_id").agg(last.alias("m"), F.count("*").alias("n"))
    return rows.select("user_id", F.col("m.value").alias("last_value"), F.col("m.event_type").alias("last_type"), "n")


@query(
    """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events),
    p as (select a.user_id, a.event_id, b.value as v, exp(-pow(b.k - a.k, 2) / 18.0) as w from r a join r b on a.user_id = b.user_id and abs(a.k - b.k) <= 12)
    select user_id, event_id, round(sum(v * w) / sum(w), 6) as smooth from p group by 1, 2"""
)
def gaussian_smoothing(spark, sf):
    rows = statistics.smoothed(table(spark, sf, "events"), ["user_id"], "event_id", "value", 3.0)
    return rows.select("user_id", "event_id", F.round("smooth", 6).alias("smooth"))


# ------------------------------------------------------------------ labels


@query(
    """select o_orderkey, case when n > 2 then 'serious' when n = 2 and m < 0.55 then 'moderate' when n = 1 and m < 0.55 then 'slight' else 'serious' end as severity
    from (select l_orderkey as o_orderkey, count(*) as n, max(l_discount * 10) as m from lineitem group by 1) x"""
)
def severity_bucket(spark, sf):
    rows = labels.severity(table(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_discount") * 10, 0.55)
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "severity")


_REMAP = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid", "5-LOW": "low"}


@query("select o_orderkey, case o_orderpriority when '1-URGENT' then 'high' when '2-HIGH' then 'high' when '3-MEDIUM' then 'mid' when '5-LOW' then 'low' else o_orderpriority end as o_orderpriority from orders where o_orderpriority <> '5-LOW'")
def class_remap(spark, sf):
    rows = labels.remap_class(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), _REMAP, "o_orderpriority")
    return labels.without_classes(rows, ["low"], "o_orderpriority")


@query("select s_suppkey, case when s_nationkey in (0, 3) then s_nationkey else s_nationkey - 1 end as s_nationkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def class_shift_and_lookup(spark, sf):
    rows = joins.suffixed(table(spark, sf, "supplier"), table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), ["s_nationkey"], "inner")
    return labels.shift_class(rows, -1, keep=[0, 3], column="s_nationkey").select("s_suppkey", "s_nationkey", "n_name")


@query("select p_type, (row_number() over (order by p_type) - 1)::bigint as cls from (select distinct p_type from part) x")
def class_ids(spark, sf):
    return labels.class_ids(table(spark, sf, "part"), "p_type").withColumn("cls", F.col("cls").cast("long"))


@query(f"with f as (select *, {_FLAGS} from orders) select o_orderkey, greatest(urgent, dear) as a0, late as a1 from f")
def or_merge_flags(spark, sf):
    rows = flagged_orders(spark, sf).withColumn("atts", F.array("urgent", "dear", "late"))
    return labels.merge_attributes(rows, {1: 0}).select("o_orderkey", F.get("atts", 0).alias("a0"), F.get("atts", 1).alias("a1"))


@query(f"with {_BASE} select image, obj, cls, (x2 - x1) * (y2 - y1) as box_area from lab where cls <> 4 and ((x2 - x1) * (y2 - y1) >= 2000 or cls not in (0, 1))")
def small_object_filter(spark, sf):
    own, _ = derived(spark, sf)
    rows = own.withColumn("coords", F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2"))
    return labels.keep_large(labels.without_classes(rows, [4]), 2000, [0, 1]).select("image", "obj", "cls", "box_area")


@query("select l_orderkey, count(*) as n, count(*) filter (l_quantity > 45 or l_discount = 0) as n_faulty from lineitem group by 1 having max(l_quantity) > 45 and count(*) <> 5")
def validate_rows(spark, sf):
    faulty = (F.col("l_quantity") > 45) | (F.col("l_discount") == 0)
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(faulty).alias("n_faulty"), F.max("l_quantity").alias("m"))
    return rows.where("m > 45 and n <> 5").drop("m")


@query(f"with {_BASE} select image, obj, (a0 + a1 + a2 + a3) > 0 as defect, a1 + a2 = 2 as both_middle from pred where conf >= 0.6")
def defect_predicates(spark, sf):
    _, found = derived(spark, sf)
    rows = found.where("conf >= 0.6")
    return rows.select("image", "obj", labels.any_attribute(F.col("atts")).alias("defect"), (F.get("atts", 1) + F.get("atts", 2) == 2).alias("both_middle"))


@query(f"with {_BASE}, c as (select distinct image from pred where conf >= 0.8 and a0 + a1 + a2 + a3 > 0) select image, obj, cls from pred where image in (select image from c)")
def pseudo_labels(spark, sf):
    _, found = derived(spark, sf)
    return labels.pseudo_labels(found, 0.8, "image").select("image", "obj", "cls")


@query(
    """select a.o_orderkey, a.o_orderstatus as o_orderstatus_x, case when a.o_orderkey % 7 = 0 then null else b.o_orderstatus end as o_orderstatus_y,
    (a.o_orderkey % 7 = 0 or a.o_orderkey % 5 = 0) as different from orders a join orders b using (o_orderkey) where a.o_orderkey % 3 <> 0"""
)
def review_diff(spark, sf):
    own = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    again = own.where("o_orderkey % 3 <> 0").withColumns(
        {"o_orderstatus": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")), "o_totalprice": F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))}
    )
    rows = labels.review_difference(own, again, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return rows.select("o_orderkey", "o_orderstatus_x", "o_orderstatus_y", "different")


@query("select event_id, 'n_k' as key, case when (props ->> '$.k') = '7' then 'seven' else props ->> '$.k' end as value from events where (props ->> '$.k') is not null")
def nested_map_rewrite(spark, sf):
    shape = F.struct(F.lit("event").alias("label"), F.from_json("props", "map<string,string>").alias("attributes"))
    rows = table(spark, sf, "events").select("event_id", F.array(shape).alias("shapes"))
    rows = rows.withColumn("shapes", labels.translated(F.col("shapes"), {}, {"k": "n_k"}, {"7": "seven"}))
    return rows.select("event_id", F.explode(F.col("shapes")[0]["attributes"]).alias("key", "value")).where("value is not null")


@query(
    """select o_orderkey, case when o_orderkey % 4 = 0 then 'checked' else o_orderstatus end as o_orderstatus, case when o_orderkey % 4 = 0 then 1 else 0 end as n_corrections from orders"""
)
def correction_lookup(spark, sf):
    own = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sheet = own.where("o_orderkey % 4 = 0").withColumn("o_orderstatus", F.lit("checked"))
    return joins.lookup_update(own, sheet.dropDuplicates(["o_orderkey"]), ["o_orderkey"], ["o_orderstatus"]).withColumn("n_corrections", F.col("n_corrections").cast("int"))


# ------------------------------------------------------------------ text and nested data


@query(
    r"""select page_id, regexp_extract(url, '([^/\\]*)$', 1) as base, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]*$', '') as stem,
    regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1) as folder, replace(url, 'http://', 'https://') as moved from pages"""
)
def string_identity(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.basename(u).alias("base"), text.stem(u).alias("stem"), text.folder(u).alias("folder"), text.moved_root(u, "http://", "https://").alias("moved"))


@query(r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, '<p[ >]')) as n_p, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) as n_links from pages")
def html_extract(spark, sf):
    found = lambda p, g: F.regexp_extract_all("html", F.lit(p), F.lit(g))
    return table(spark, sf, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(found("<p[ >]", 0)).cast("long").alias("n_p"),
        F.size(F.array_distinct(found('href="([^"]*)"', 1))).cast("long").alias("n_links"),
    )


@query("select event_id, 'cam_' || strftime(ts + interval 8 hour, '%Y%m%d%H%M%S') || lpad((epoch_us(ts) // 1000 % 1000)::varchar, 3, '0') as name from events")
def timestamp_shift_name(spark, sf):
    return table(spark, sf, "events").select("event_id", text.shifted_time_name(F.unix_micros(F.col("ts").cast("timestamp")), 8 * 3600, "cam_").alias("name"))


@query(r"select s_suppkey, regexp_replace(s_name, '(\d+)', '[\1]', 'g') as marked, lpad(regexp_extract(s_name, '(\d+)', 1), 12, '0') as first_number from supplier where regexp_matches(s_name, '\d')")
def natural_order_key(spark, sf):
    rows = table(spark, sf, "supplier").where(F.col("s_name").rlike(r"\d"))
    key = text.natural_key(F.col("s_name"))
    return rows.select("s_suppkey", F.regexp_replace("s_name", r"(\d+)", "[$1]").alias("marked"), F.regexp_extract(key, r"(\d{12})", 1).alias("first_number"))


@query("select conv_id, count(*) as n_turns, string_agg(role || ': ' || text, chr(10) order by turn) as dialog, string_agg(distinct role, ';' order by role) as roles from conversations group by conv_id")
def conversation_records(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), turns.alias("turns"), F.array_sort(F.collect_set("role")).alias("r"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return rows.select("conv_id", "n_turns", F.array_join(lines, "\n").alias("dialog"), F.array_join("r", ";").alias("roles"))


@query(
    """select o_orderkey % 40 as part, count(distinct o_orderkey) as n_images, count(l_partkey) as n_annotations, sum(l_partkey)::bigint as checksum
    from orders left join lineitem on o_orderkey = l_orderkey group by 1"""
)
def coco_json_roundtrip(spark, sf):
    """Nested documents of images and annotations as JSON text, parsed and taken apart again."""
    from annotide.sources import documents

    images = table(spark, sf, "orders").select((F.col("o_orderkey") % 40).alias("part"), F.col("o_orderkey").alias("id"))
    annos = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("part"), F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("category_id"))
    packed = documents.coco_text(images.distinct(), annos, ["part"])
    parsed = packed.select("part", F.from_json("json", documents.COCO).alias("d"))
    n = parsed.select("part", F.size("d.images").cast("long").alias("n_images"), F.size("d.annotations").cast("long").alias("n_annotations"), F.explode_outer("d.annotations.category_id").alias("c"))
    return n.groupBy("part").agg(F.max("n_images").alias("n_images"), F.max("n_annotations").alias("n_annotations"), F.sum("c").alias("checksum"))


# ------------------------------------------------------------------ joins


@query(
    """select n_name, r_name, count(*) as n, count(distinct o_orderkey) as n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2"""
)
def merge_images_annos(spark, sf):
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = table(spark, sf, "customer").join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    rows = table(spark, sf, "lineitem").select("l_orderkey").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(places, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("select l_orderkey, l_linenumber, l_partkey as key, l_extendedprice as price_x, p_retailprice as price_y, count(*) as n from lineitem left join (select * from part where p_size > 25) p on l_partkey = p_partkey group by all")
def object_record_left(spark, sf):
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("price"))
    b = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"))
    return joins.suffixed(a, b, ["key"]).groupBy("l_orderkey", "l_linenumber", "key", "price_x", "price_y").agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_custkey in (select user_id from events where event_type = 'purchase') then 'val' else 'train' end as split from customer")
def reference_split(spark, sf):
    buyers = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return joins.split_by_reference(table(spark, sf, "customer").select("c_custkey"), buyers, "c_custkey")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels) and doc_id not in (select doc_id from labels where toxic = 1 union select doc_id from labels where quality = 0)")
def semi_anti_references(spark, sf):
    marks = table(spark, sf, "labels")
    rows = joins.in_reference(table(spark, sf, "documents").select("doc_id", "source"), marks, "doc_id")
    return joins.not_in_reference(rows, marks.where("toxic = 1"), marks.where("quality = 0"), key="doc_id")


@query("select doc_id, coalesce(toxic, -1) as toxic from documents left join labels using (doc_id)")
def fill_missing(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.withColumn("toxic", F.coalesce("toxic", F.lit(-1)))


@query(
    """select p.event_id, v.event_id as view_id, abs(epoch_us(p.ts) - epoch_us(v.ts)) as gap from events p join events v on p.user_id = v.user_id and v.event_type = 'view' where p.event_type = 'purchase'
    qualify row_number() over (partition by p.event_id order by abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts) = 1"""
)
def nearest_asof(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    bought = rows.where("event_type = 'purchase'").drop("event_type")
    seen = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    found = joins.nearest_in_time(bought, seen, ["user_id"], "ts", ["view_id"]).where("nearest is not null")
    return found.select("event_id", "nearest.view_id", F.abs(F.unix_micros("ts") - F.unix_micros("nearest.time")).alias("gap"))


@query("select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and abs(c_acctbal - s_acctbal) <= 150")
def distance_join(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    b = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    return joins.within_distance(a, b, ["nation"], "c_acctbal", "s_acctbal", 150.0).select("c_custkey", "s_suppkey")


@query(f"with {_BASE}, {_PAIRS} select image, l_obj, p_obj, cls, round(iou, 9) as iou from pairs")
def iou_pairs(spark, sf):
    own, found = derived(spark, sf)
    columns = ["image", "obj", "cls", "x1", "y1", "x2", "y2"]
    rows = matching.iou_pairs(own.select(*columns), found.select(*columns), 0.5)
    return rows.select("image", "l_obj", "p_obj", F.col("l_cls").alias("cls"), F.round("iou", 9).alias("iou"))


@query(f"with {_BASE}, {_PAIRS}, {_GREEDY} select image, threshold::double as threshold, l_obj, p_obj from matches")
def greedy_match_at_thresholds(spark, sf):
    return matched(spark, sf)[2].select("image", "threshold", "l_obj", "p_obj")


@query()
def hungarian_match(spark, sf):
    own, found = derived(spark, sf)
    columns = ["image", "obj", "cls", "x1", "y1", "x2", "y2"]
    return matching.optimal(matching.iou_pairs(own.select(*columns), found.select(*columns), 0.5))


@query()
def used_once_match(spark, sf):
    own, found = derived(spark, sf)
    return matching.used_once(own, found)


@query(
    f"""with {_BASE}, {_PAIRS}, {_GREEDY} select l.image, l.obj, l.cls as cls_labels, p.cls as cls_pred, p.obj as obj_pred, p.conf as conf_pred from lab l
    left join (select * from matches where threshold = 0.5) m on m.image = l.image and m.l_obj = l.obj left join pred p on p.image = m.image and p.obj = m.p_obj"""
)
def left_match_expand(spark, sf):
    own, found, hits = matched(spark, sf)
    rows = matching.expanded(own.drop("pk"), found.drop("pk"), hits.where("threshold = 0.5"))
    return rows.select("image", "obj", "cls_labels", "cls_pred", "obj_pred", "conf_pred")


@query(f"with {_BASE}, {_PAIRS}, {_GREEDY}, {_AP} select cls, threshold::double as threshold, round(ap, 6) as ap from ap")
def ap_per_class(spark, sf):
    return matching.average_precision(*matched(spark, sf)).withColumn("ap", F.round("ap", 6))


@query(f"with {_BASE}, {_PAIRS}, {_GREEDY}, {_AP} select round(avg(ap) filter (threshold = 0.5), 6) as map50, round(avg(ap), 6) as map50_95 from ap")
def map_summary(spark, sf):
    rows = matching.map_summary(matching.average_precision(*matched(spark, sf)))
    return rows.select(F.round("map50", 6).alias("map50"), F.round("map50_95", 6).alias("map50_95"))


@query(
    f"""with {_BASE}, {_PAIRS}, {_GREEDY}, m as (select l.a0 = p.a0 as s0, l.a1 = p.a1 as s1, l.a2 = p.a2 as s2, l.a3 = p.a3 as s3 from matches x
    join lab l on l.image = x.image and l.obj = x.l_obj join pred p on p.image = x.image and p.obj = x.p_obj where threshold = 0.5)
    select 0 as position, round(avg(s0::int), 9) as agreement from m union all select 1, round(avg(s1::int), 9) from m union all select 2, round(avg(s2::int), 9) from m union all select 3, round(avg(s3::int), 9) from m"""
)
def attribute_oa(spark, sf):
    own, found, hits = matched(spark, sf)
    rows = hits.where("threshold = 0.5").select("image", "l_obj", "p_obj")
    rows = rows.join(own.select("image", F.col("obj").alias("l_obj"), F.col("atts").alias("l_atts")), ["image", "l_obj"])
    rows = rows.join(found.select("image", F.col("obj").alias("p_obj"), F.col("atts").alias("p_atts")), ["image", "p_obj"])
    return rounded(matching.attribute_agreement(rows), "agreement")


@query(
    f"""with {_BASE}, {_PAIRS}, {_GREEDY}, l as (select image, count(*) as n_labels from lab group by 1), p as (select image, count(*) as n_preds from pred group by 1),
    m as (select image, count(*) as n_matched from matches where threshold = 0.5 group by 1)
    select coalesce(l.image, p.image) as image, coalesce(n_labels, 0) as n_labels, coalesce(n_preds, 0) as n_preds, coalesce(n_matched, 0) as n_matched,
    round(coalesce(n_matched, 0) / nullif(n_preds, 0)::double, 9) as precision, round(coalesce(n_matched, 0) / nullif(n_labels, 0)::double, 9) as recall
    from l full join p on p.image = l.image left join m on m.image = coalesce(l.image, p.image)"""
)
def image_report(spark, sf):
    own, found, hits = matched(spark, sf)
    rows = matching.image_report(own, found, hits.where("threshold = 0.5"))
    return rounded(rounded(rows, "precision"), "recall")


@query()
def nms(spark, sf):
    _, found = derived(spark, sf)
    return suppression.suppressed(found.drop("atts", "pk"), 0.5, per_class=False)


@query()
def multiclass_nms(spark, sf):
    _, found = derived(spark, sf)
    return suppression.suppressed(found.drop("atts", "pk"), 0.5)


@query()
def box_merge(spark, sf):
    _, found = derived(spark, sf)
    return suppression.merged_by_score(found.drop("atts", "pk"), 0.6)


@query()
def connected_merge(spark, sf):
    own, _ = derived(spark, sf)
    return suppression.connected(own)


_GRID = tables.tiles(200, 200, 80, 80, 0.5)


@query(
    f"""with {_BASE}, t as (select a * 4 + b as tile, b * 40 as tx1, a * 40 as ty1, b * 40 + 80 as tx2, a * 40 + 80 as ty2 from range(4) as y(a), range(4) as x(b))
    select image, obj, tile, round((greatest(x1, tx1) + least(x2, tx2) - 2 * tx1) / 2.0 / (tx2 - tx1), 9) as tcx, round((greatest(y1, ty1) + least(y2, ty2) - 2 * ty1) / 2.0 / (ty2 - ty1), 9) as tcy,
    round((least(x2, tx2) - greatest(x1, tx1)) / (tx2 - tx1), 9) as tw, round((least(y2, ty2) - greatest(y1, ty1)) / (ty2 - ty1), 9) as th
    from lab join t on greatest(x1, tx1) < least(x2, tx2) and greatest(y1, ty1) < least(y2, ty2)"""
)
def tile_grid_join(spark, sf):
    own, _ = derived(spark, sf)
    rows = tables.tiled(own.drop("atts", "pk"), _GRID)
    return rows.select("image", "obj", "tile", *[F.round(c, 9).alias(c) for c in ("tcx", "tcy", "tw", "th")])


@query(f"with {_BASE} select image, obj, round(((x2 - x1) * (y2 - y1)) / 2, 6) as area, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, x2 - x1 as w, y2 - y1 as h from lab")
def polygon_area(spark, sf):
    """Triangles over half of each box: area and enclosing box of a polygon."""
    own, _ = derived(spark, sf)
    rows = own.select("image", "obj", F.array("x1", "y1", "x2", "y1", "x2", "y2").alias("p"))
    box = polygons.centre_box(F.col("p"))
    return rows.select("image", "obj", F.round(polygons.area(F.col("p")), 6).alias("area"), *[F.get(box, k).alias(n) for k, n in enumerate(("cx", "cy", "w", "h"))])


# ------------------------------------------------------------------ order, runs, splits


@query(
    """select event_id, value, next_value, abs(value - next_value) < 5 as flagged from (select event_id, value, lead(value) over (partition by user_id order by ts, event_id) as next_value from events) x
    where next_value is not null"""
)
def lead_pair_flag(spark, sf):
    rows = ordering.beside_next(table(spark, sf, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], [F.col("ts"), F.col("event_id")], ["value"])
    return rows.where("next_value is not null").select("event_id", "value", "next_value", (F.abs(F.col("value") - F.col("next_value")) < 5).alias("flagged"))


_COS = "list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))"


@query(f"select a.vec_id as a, b.vec_id as b, round({_COS}, 5) as similarity from embeddings a join embeddings b on b.vec_id - a.vec_id between -4 and 4 and a.vec_id <> b.vec_id")
def band_similarity(spark, sf):
    rows = tables.similar_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 4, 4)
    return rounded5(rows, "similarity")


def rounded5(df, column):
    return df.withColumn(column, F.round(column, 5))


@query(f"select vec_id from embeddings x where not exists (select 1 from embeddings a join embeddings b on b.vec_id - a.vec_id between -10 and 10 and a.vec_id <> b.vec_id where a.vec_id = x.vec_id and {_COS} > 0.2)")
def unlike_neighbours(spark, sf):
    return tables.unlike_neighbours(table(spark, sf, "embeddings"), "vec_id", "embedding", 10, 0.2).select("vec_id")


@query("select a.vec_id as a, b.vec_id as b, round(list_distance(a.embedding::double[], b.embedding::double[]), 5) as distance from embeddings a join embeddings b on b.vec_id - a.vec_id between 1 and 19 where list_distance(a.embedding::double[], b.embedding::double[]) < 1.2")
def near_vector(spark, sf):
    return rounded5(tables.near_ahead(table(spark, sf, "embeddings"), "vec_id", "embedding", 20, 1.2), "distance")


@query("select user_id, run::bigint as run, count(*) as n from (select user_id, sum(case when gap > 10 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from (select *, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as gap from events) x) y group by 1, 2")
def similarity_runs(spark, sf):
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("gap", F.abs(F.col("value") - F.lag("value").over(window)))
    return ordering.runs(rows, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("gap") > 10).groupBy("user_id", "run").agg(F.count("*").alias("n"))


@query("select a.doc_id as a, b.doc_id as b, bit_count(xor(a.h, b.h)) as bits from (select doc_id, ('0x' || substr(md5(text), 1, 4))::bigint as h from documents) a join (select doc_id, ('0x' || substr(md5(text), 1, 4))::bigint as h from documents) b on b.doc_id = a.doc_id + 1")
def hash_neighbours(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("long").alias("h"))
    pairs = joins.band(rows, "doc_id", 0, 1, ["h"])
    return pairs.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"), geometry.hamming(F.col("a_h"), F.col("b_h")).cast("int").alias("bits"))


@query("select l_returnflag, l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey) <= 15")
def quota_per_class(spark, sf):
    rows = ordering.first_per_group(table(spark, sf, "lineitem"), ["l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 15)
    return rows.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey")


_NUMBERED = "with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders) "


def order_keys(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey")


@query(_NUMBERED + "select o_orderkey, case when k < floor(n * 0.8 + 1e-9) then 'train' else 'val' end as split from o")
def split_train_val(spark, sf):
    return ordering.split_first(order_keys(spark, sf), "o_orderkey", 0.8)


@query("with o as (select o_orderkey, ntile(7) over (order by o_orderkey) - 1 as fold from orders) select o_orderkey, fold::int as fold from o")
def split_kfold(spark, sf):
    return ordering.folds(order_keys(spark, sf), "o_orderkey", 7)


@query(_NUMBERED + "select o_orderkey from o where k % 10 = 0")
def split_interval(spark, sf):
    return ordering.every(order_keys(spark, sf), "o_orderkey", ordering.interval_of(0.9))


@query(_NUMBERED + "select o_orderkey, (k % 4)::int as task from o")
def split_roundrobin(spark, sf):
    return ordering.dealt(order_keys(spark, sf), "o_orderkey", 4)


@query(_NUMBERED + "select o_orderkey, (k // 4000)::int as chunk from o")
def split_chunk(spark, sf):
    return ordering.chunks(order_keys(spark, sf), "o_orderkey", 4000)


@query(_NUMBERED + "select o_orderkey from o where k between 2000 and 2999")
def row_range(spark, sf):
    return ordering.between(order_keys(spark, sf), "o_orderkey", 2000, 3000)


@query("select count(*) filter (split = 'train') as train, count(*) filter (split = 'val') as val from (select case when row_number() over (order by o_orderkey) <= floor(count(*) over () * 0.9 + 1e-9) then 'train' else 'val' end as split from orders) x")
def split_random(spark, sf):
    """Sizes of a seeded random split; which rows fall where is this library's own order."""
    rows = ordering.random_split(order_keys(spark, sf), "o_orderkey", 0.9)
    return rows.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))


@query("select o_orderstatus, floor(count(*) * 0.7)::bigint as train, (count(*) - floor(count(*) * 0.7))::bigint as val from orders group by o_orderstatus")
def split_stratified(spark, sf):
    rows = ordering.split_per_class(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 0.7)
    return rows.groupBy("o_orderstatus").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val"))


@query("select l_orderkey, min(l_partkey) as l_partkey from (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as n from lineitem) x where n = 1 group by 1")
def drop_duplicates_first(spark, sf):
    rows = ordering.first_per_group(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])
    return rows.select("l_orderkey", "l_partkey")


@query("select text_key, min(doc_id) as kept, count(*) as n from (select md5(text) as text_key, doc_id from documents) x group by 1")
def dup_group_keep_min(spark, sf):
    rows = table(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id")
    return tables.first_of_group(rows.withColumn("size", F.lit(0)), ["text_key"], "size", "doc_id")


@query("select doc_id, row_number() over (partition by md5(text) order by n_chars, doc_id) > 1 as copy from documents")
def copies_marked(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("key"))
    return tables.copies_marked(rows, ["key"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "copy")


@query("select a.doc_id as a, b.doc_id as b from documents a join documents b on a.text = b.text and a.source < b.source")
def same_origin_pairs(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return tables.same_origin_pairs(rows, ["key"], "source", "doc_id").select("a", "b")


# ------------------------------------------------------------------ set operations


@query("select o_orderkey, o_custkey, 0 as part from orders union all select o_orderkey + 10000000, o_custkey + 500000, 1 from orders where o_orderstatus = 'F'")
def union_offset_ids(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parts = [rows.drop("o_orderstatus"), rows.where("o_orderstatus = 'F'").drop("o_orderstatus")]
    return tables.union_with_offsets(parts, {"o_orderkey": 10_000_000, "o_custkey": 500_000})


@query("(select o_custkey as key, 'left' as side from orders except select user_id, 'left' from events) union all (select user_id, 'right' from events except select o_custkey, 'right' from orders)")
def except_both_ways(spark, sf):
    return tables.difference_both_ways(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf, "events").select(F.col("user_id").alias("key")), "key")


@query("select r_name as name from region union select n_name from nation")
def distinct_union(spark, sf):
    return tables.union(table(spark, sf, "region").select(F.col("r_name").alias("name")), table(spark, sf, "nation").select(F.col("n_name").alias("name"))).distinct()


@query("select p_name, count(*) as n from part group by 1 having count(*) > 1")
def name_collisions(spark, sf):
    return tables.collisions(table(spark, sf, "part"), "p_name")


@query("select n_name, r_name from nation cross join region where (n_nationkey, r_regionkey) not in (select n_nationkey, n_regionkey from nation)")
def missing_cells(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    there = nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return joins.missing_cells(nation.select("n_nationkey", "n_name"), region, there, ["n_nationkey", "r_regionkey"]).select("n_name", "r_name")


# ------------------------------------------------------------------ streams


@query("select count(*) as n, round(sum(value * 0.1), 4) as scaled, count(distinct user_id) as n_sensors from events")
def sensor_stream(spark, sf):
    """A batch's worth of readings through a stream into a log, read back."""
    rows = sensor.drained(spark, table(spark, sf, "events"), f"{sf}/events.parquet")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("scaled"), 4).alias("scaled"), F.countDistinct("user_id").alias("n_sensors"))


@query("select epoch_us(time_bucket(interval 1 hour, ts)) as opened, event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1, 2")
def tumbling_window(spark, sf):
    rows = sensor.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value")
    return rows.select(F.unix_micros("opened").alias("opened"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query(
    """select epoch_us(time_bucket(interval 1 hour, ts)) - k * 3600000000 as opened, event_type, count(*) as n, round(avg(value), 6) as mean
    from events, (values (0), (1)) as s(k) group by 1, 2"""
)
def sliding_window(spark, sf):
    rows = sensor.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["event_type"], "value", "1 hour")
    return rows.select(F.unix_micros("opened").alias("opened"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query(
    """with g as (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 3600000000 then 0 else 1 end as b from events window w as (partition by user_id order by ts)),
    s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as session from g)
    select user_id, epoch_us(min(ts)) as opened, count(*) as n from s group by user_id, session"""
)
def session_window(spark, sf):
    rows = sensor.sessions(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["user_id"])
    return rows.select("user_id", F.unix_micros("opened").alias("opened"), "n")
