"""Queries of scans, projections, filters, joins, aggregations, windows, top-k and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import binned, confusion_cell, stable_key, strip
from ..operators import joins, ranks, sampling, spans
from ..session import table as t

@query("prj_path_parts", "SELECT page_id, split_part(url,'/',3) AS host, regexp_replace(url,'/[^/]*$','') AS head, regexp_extract(url,'([0-9]+)',1) AS digits, length(url) AS n FROM pages")
def _(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", F.element_at(F.split(u, "/"), 3).alias("host"), F.regexp_replace(u, "/[^/]*$", "").alias("head"), F.regexp_extract(u, "([0-9]+)", 1).alias("digits"), F.length(u).cast("long").alias("n"))


@query(
    "prj_text_flags",
    "SELECT doc_id, length(text) AS n, lower(trim(text)) IN ('','not given.','not given') AS is_blank, try_cast(nullif(regexp_extract(text,'([0-9]+)',1),'') AS double) AS first_number, coalesce(nullif(regexp_extract(text,'([A-Za-z]+)@([a-z0-9]+)',2),''),'NA') AS mail_host, length(regexp_replace(text,'^\\s+|\\s+$','','g')) AS n_stripped FROM documents",
)
def _(spark, d):
    x = F.col("text")
    return t(spark, d, "documents").select(
        "doc_id", F.length(x).cast("long").alias("n"), F.lower(F.trim(x)).isin("", "not given.", "not given").alias("is_blank"), F.regexp_extract(x, "([0-9]+)", 1).try_cast("double").alias("first_number"),
        F.coalesce(F.nullif(F.regexp_extract(x, "([A-Za-z]+)@([a-z0-9]+)", 2), F.lit("")), F.lit("NA")).alias("mail_host"), F.length(strip(x)).cast("long").alias("n_stripped"),
    )


@query(
    "prj_labels",
    "SELECT o_orderkey, o_totalprice >= 150000 AS high, CASE WHEN o_orderstatus='F' THEN 'done' ELSE 'open' END AS state, CASE WHEN o_totalprice>-1 AND o_totalprice<=50000 THEN 'small' WHEN o_totalprice>50000 AND o_totalprice<=150000 THEN 'middle' WHEN o_totalprice>150000 AND o_totalprice<=1e12 THEN 'large' END AS size_class, CASE WHEN o_orderstatus='F' AND o_totalprice>=150000 THEN 'TP' WHEN o_orderstatus='F' THEN 'FN' WHEN o_totalprice>=150000 THEN 'FP' ELSE 'TN' END AS cell, (o_orderstatus='F')::int + (o_totalprice>=150000)::int + (o_custkey%2=0)::int AS votes FROM orders",
)
def _(spark, d):
    high, done = F.col("o_totalprice") >= 150000, F.col("o_orderstatus") == "F"
    return t(spark, d, "orders").select("o_orderkey", high.alias("high"), F.when(done, "done").otherwise("open").alias("state"), binned(F.col("o_totalprice"), [-1, 50000, 150000, 1e12], ["small", "middle", "large"]).alias("size_class"), confusion_cell(done.cast("int"), high.cast("int")).alias("cell"), (done.cast("int") + high.cast("int") + (F.col("o_custkey") % 2 == 0).cast("int")).alias("votes"))


@query("prj_surrogate_key", "SELECT l_orderkey, l_linenumber, substr(sha1(concat_ws('|', l_orderkey::varchar, l_linenumber::varchar, coalesce(l_returnflag,'None'))),1,16) AS key FROM lineitem")
def _(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", stable_key(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("key"))


@query("prj_tuple_string", "SELECT event_id, json_extract_string(props,'$.k')::int AS k, list_sum([1, json_extract_string(props,'$.k')::int])::bigint AS total FROM events")
def _(spark, d):
    x = t(spark, d, "events").withColumn("s", F.concat(F.lit("(1, "), F.from_json("props", "k int")["k"].cast("string"), F.lit(")")))
    parts = F.transform(F.split(F.regexp_replace("s", "[()]", ""), ", "), lambda v: v.cast("int"))
    return x.select("event_id", F.element_at(parts, 2).alias("k"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("flt_semi_anti", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice>200000)) AS with_large, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without FROM customer GROUP BY 1")
def _(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey", "c_mktsegment"), t(spark, d, "orders")
    flags = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") > 200000).alias("large"))
    return c.join(flags, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if("large").alias("with_large"), F.count_if(F.col("o_custkey").isNull()).alias("without"))


@query("flt_tuple_semi", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def _(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return x.join(x.where("l_quantity >= 50").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("flt_patterns", "SELECT doc_id FROM documents WHERE regexp_matches(text,'(?i)licen[sc]e') AND NOT regexp_matches(text,'[0-9]{6}') OR contains(lower(text), 'queen') OR starts_with(source,'src1') AND starts_with(lang,'f')")
def _(spark, d):
    x = F.col("text")
    return t(spark, d, "documents").where(x.rlike("(?iu)licen[sc]e") & ~x.rlike("[0-9]{6}") | F.contains(F.lower(x), F.lit("queen")) | F.col("source").startswith("src1") & F.col("lang").startswith("f")).select("doc_id")


@query("flt_censored", "SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL AND NOT coalesce(value < 10 AND event_type <> 'purchase', false)")
def _(spark, d):
    return t(spark, d, "events").na.drop(subset=["value"]).where(~F.coalesce((F.col("value") < 10) & (F.col("event_type") != "purchase"), F.lit(False))).select("event_id", "user_id", "value")


@query("flt_group_having", "SELECT l_partkey, count(*) AS n, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1 HAVING count(*) > 10 AND min(l_returnflag) <> max(l_returnflag)")
def _(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("flags"), F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    return g.where("n > 10 and a <> b").drop("a", "b")


@query("flt_pool", "SELECT o.o_orderkey FROM orders o WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING')) AND o.o_custkey IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    o, c = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    locked = c.where("c_mktsegment = 'BUILDING'")
    on = F.col("o_custkey") == F.col("c_custkey")
    return o.join(locked, on, "left_anti").join(c, on, "left_semi").select("o_orderkey")


@query("jn_chain", "SELECT r_name, n_name, count(*) AS n_orders, round(sum(o_totalprice),2) AS total FROM orders JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2")
def _(spark, d):
    o, c, n, r = (t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return x.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jn_lookup_last", "WITH last AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) SELECT c_custkey, coalesce(event_type,'none') AS event_type FROM customer LEFT JOIN last ON c_custkey=user_id")
def _(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "event_type", F.struct("ts", "event_id").alias("at"))
    return joins.lookup(t(spark, d, "customer").select("c_custkey"), e, "c_custkey", "event_type", "at", "none")


@query(
    "jn_occurrence",
    "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS nth FROM events WHERE event_type='click'), b AS (SELECT user_id, event_id AS other, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS nth FROM events WHERE event_type='view') SELECT user_id, nth::int AS nth, event_id, other FROM a JOIN b USING (user_id, nth)",
)
def _(spark, d):
    e = t(spark, d, "events")
    a = joins.occurrence(e.where("event_type = 'click'").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])
    b = joins.occurrence(e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("other"), "ts"), ["user_id"], ["ts", "other"])
    return a.drop("ts").join(b.drop("ts"), ["user_id", "nth"]).select("user_id", "nth", "event_id", "other")


_SPANS = "WITH s AS (SELECT l_orderkey AS g, l_linenumber AS id, l_partkey % 97 AS s, l_partkey % 97 + 1 + l_suppkey % 7 AS e FROM lineitem)"


def _spans(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 97).alias("s"), (F.col("l_partkey") % 97 + 1 + F.col("l_suppkey") % 7).alias("e"))


@query("jn_span_overlap", _SPANS + " SELECT a.g, a.id, count(*) AS n_overlap, count(*) FILTER (WHERE a.s <= b.s AND b.e <= a.e) AS n_inside FROM s a JOIN s b ON a.g=b.g AND a.id<>b.id AND a.s<b.e AND b.s<a.e GROUP BY 1,2")
def _(spark, d):
    a = _spans(spark, d)
    b = a.toDF("g", "id2", "s2", "e2")
    x = a.join(b, "g").where("id <> id2 and s < e2 and s2 < e")
    return x.groupBy("g", "id").agg(F.count("*").alias("n_overlap"), F.count_if(F.expr("s <= s2 and e2 <= e")).alias("n_inside"))


@query(
    "jn_nearest",
    _SPANS + ", p AS (SELECT a.g, a.id, b.id AS t_id, greatest(0, b.s-a.e, a.s-b.e) AS gap, CASE WHEN b.s>=a.s THEN 0 ELSE 1 END AS side FROM s a JOIN s b ON a.g=b.g WHERE a.id%2=1 AND b.id%2=0), m AS (SELECT *, rank() OVER (PARTITION BY g,id ORDER BY gap, side) AS r FROM p WHERE gap <= 60) SELECT g, id, CASE WHEN count(*)=1 THEN min(t_id) END AS t_id, min(gap) AS gap, count(*)>1 AS tie FROM m WHERE r=1 GROUP BY 1,2",
)
def _(spark, d):
    s = _spans(spark, d)
    return joins.nearest(s.where("id % 2 = 1"), s.where("id % 2 = 0").toDF("g", "t_id", "t_s", "t_e"), ["g"], True, 60)


@query("jn_patterns", "SELECT p.item, count(*) AS n_docs FROM documents JOIN (VALUES ('licen[sc]e'),('[0-9]{4}'),('idiot|moron'),('\\|')) p(item) ON regexp_matches(text, p.item) GROUP BY 1")
def _(spark, d):
    # a handful of patterns: one scan with a flag each, instead of a product of texts and patterns
    items = ["licen[sc]e", "[0-9]{4}", "idiot|moron", r"\|"]
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(p)) for p in items)))
    return t(spark, d, "documents").select(F.explode(hit).alias("item")).groupBy("item").agg(F.count("*").alias("n_docs"))


@query("jn_class_pairs", "WITH c AS (SELECT l_shipdate::date AS day, l_returnflag AS f FROM lineitem GROUP BY 1,2) SELECT a.f AS f1, b.f AS f2, count(*) AS days FROM c a JOIN c b ON a.day=b.day AND a.f<b.f GROUP BY 1,2")
def _(spark, d):
    # the few flags of a day are gathered into a set, whose pairs are then counted
    day = t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("f1"), b.alias("f2")))))
    return day.select(F.explode(pairs).alias("x")).groupBy("x.f1", "x.f2").agg(F.count("*").alias("days"))


@query("agg_counts", "SELECT source, lang, count(*) AS n, count(DISTINCT text) AS n_texts, min(n_chars) AS lo, max(n_chars) AS hi, round(avg(n_chars),6) AS mean FROM documents GROUP BY 1,2")
def _(spark, d):
    return t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("agg_rollup_max", "SELECT user_id, max(value) AS top, min(ts) AS first_ts, count(*) AS n, bool_or(event_type='purchase') AS bought, bool_or(value>90) AS high, min_by(event_type,(ts,event_id)) AS first_type FROM events GROUP BY 1")
def _(spark, d):
    return t(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.min("ts").alias("first_ts"), F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_or(F.col("value") > 90).alias("high"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"))


@query("agg_lift", "SELECT p_type, count(*) AS n, round(avg((l_returnflag='R')::int)/(SELECT avg((l_returnflag='R')::int) FROM lineitem JOIN part ON l_partkey=p_partkey),6) AS lift FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = x.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    whole = W.partitionBy()  # over the few types
    return g.select("p_type", "n", F.round((F.col("r") / F.col("n")) / (F.sum("r").over(whole) / F.sum("n").over(whole)), 6).alias("lift"))


@query("agg_quantiles", "SELECT event_type, median(value) AS mid, quantile_cont(value,0.9) AS q90, quantile_cont(value,0.99) AS q99, max(value) AS top FROM events GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "events")
    q = ranks.quantiles(e, "value", {"mid": 0.5, "q90": 0.9, "q99": 0.99}, ("event_type",))
    return q.join(e.groupBy("event_type").agg(F.max("value").alias("top")), "event_type")


@query("agg_floor_percentile", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE k = floor(0.025*n)+1) AS lo, max(value) FILTER (WHERE k = floor(0.975*n)+1) AS hi FROM r GROUP BY 1")
def _(spark, d):
    return ranks.quantiles(t(spark, d, "events"), "value", {"lo": 0.025, "hi": 0.975}, ("event_type",), floor=True)


@query("agg_examples", "SELECT p_type, min_by(p_name, p_partkey) AS example, array_to_string(list_sort(list(DISTINCT p_brand)),' · ') AS brands FROM part GROUP BY 1")
def _(spark, d):
    return t(spark, d, "part").groupBy("p_type").agg(F.min_by("p_name", "p_partkey").alias("example"), F.array_join(F.sort_array(F.collect_set("p_brand")), " · ").alias("brands"))


@query("agg_crosstab", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus='F') AS F, count(*) FILTER (WHERE o_orderstatus='O') AS O, count(*) FILTER (WHERE o_orderstatus='P') AS P FROM orders GROUP BY 1")
def _(spark, d):
    return t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("agg_votes", "SELECT quality, toxic, votes, count(*) AS n FROM (SELECT quality, toxic, quality+toxic+(n_chars>1500)::int AS votes FROM documents JOIN labels USING (doc_id)) GROUP BY 1,2,3")
def _(spark, d):
    x = t(spark, d, "documents").select("doc_id", "n_chars").join(t(spark, d, "labels"), "doc_id")
    return x.groupBy("quality", "toxic", (F.col("quality") + F.col("toxic") + (F.col("n_chars") > 1500).cast("int")).alias("votes")).agg(F.count("*").alias("n"))


@query("agg_transitions", "SELECT before || ' -> ' || after AS step, count(*) AS n FROM (SELECT event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> after GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "events").select(F.col("event_type").alias("after"), F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    return x.where("before <> after").groupBy(F.concat_ws(" -> ", "before", "after").alias("step")).agg(F.count("*").alias("n"))


@query("agg_remainder", "SELECT coalesce(k,'unlabelled') AS class, count(*) AS n FROM documents LEFT JOIN (SELECT doc_id, CASE WHEN toxic=1 THEN 'toxic' WHEN quality=1 THEN 'good' ELSE 'poor' END AS k FROM labels) USING (doc_id) GROUP BY 1")
def _(spark, d):
    k = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    lab = t(spark, d, "labels").select("doc_id", k.alias("k"))
    return t(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").groupBy(F.coalesce("k", F.lit("unlabelled")).alias("class")).agg(F.count("*").alias("n"))


@query("agg_total_row", "SELECT coalesce(l_returnflag,'TOTAL') AS flag, count(*) AS n, round(sum(l_quantity),2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).select(F.coalesce("l_returnflag", F.lit("TOTAL")).alias("flag"), "n", "qty")


@query("agg_grains", "SELECT count(DISTINCT (l_orderkey,l_linenumber)) AS lines, count(DISTINCT (l_orderkey,l_suppkey)) AS pairs, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag='R'")
def _(spark, d):
    return t(spark, d, "lineitem").where("l_returnflag = 'R'").agg(F.count_distinct("l_orderkey", "l_linenumber").alias("lines"), F.count_distinct("l_orderkey", "l_suppkey").alias("pairs"), F.count_distinct("l_orderkey").alias("orders"))


@query("win_row_index", "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)::int AS idx, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS again FROM conversations")
def _(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn")
    return t(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("idx"), F.coalesce(F.col("role") == F.lag("role").over(w), F.lit(False)).alias("again"))


@query("win_first_last", "SELECT user_id, arg_min(event_id,(ts,event_id)) AS first_id, arg_max(event_id,(ts,event_id)) AS last_id FROM events GROUP BY 1")
def _(spark, d):
    at = F.struct("ts", "event_id")
    return t(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


@query("win_average_rank", "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1)/2.0::double AS rank FROM orders")
def _(spark, d):
    return ranks.average_rank(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", F.col("rank").cast("double"))


@query("win_multiplicity", "WITH g AS (SELECT p_type, count(*)::double/(SELECT count(*) FROM part)/10 AS p FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM g) SELECT p_type, round(least(1, min(p*m/k) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),9) AS bh, round(max(least(1,(m-k+1)*p)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING),9) AS holm FROM r")
def _(spark, d):
    g = t(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    g = g.select("p_type", (F.col("n") / F.sum("n").over(W.partitionBy()) / 10).alias("p"))  # over the few types
    x = ranks.holm(g.withColumn("bh", ranks.benjamini_hochberg(F.col("p"))), "p")
    return x.select("p_type", F.round("bh", 9).alias("bh"), F.round("holm", 9).alias("holm"))


@query("top_values", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5")
def _(spark, d):
    return t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(5)


@query("top_budget_curve", "WITH r AS (SELECT value, event_type='purchase' AS y, row_number() OVER (ORDER BY value DESC, event_id) AS k FROM events) SELECT b::int AS budget, count(*) FILTER (WHERE y) AS tp, min(value) AS threshold FROM r JOIN (VALUES (50),(100),(200),(400)) v(b) ON k <= b GROUP BY 1")
def _(spark, d):
    budgets = [50, 100, 200, 400]
    # the greatest budget bounds the rows that are ranked
    top = t(spark, d, "events").select("event_id", "value", (F.col("event_type") == "purchase").alias("y")).orderBy(F.desc("value"), "event_id").limit(max(budgets))
    r = top.withColumn("k", F.row_number().over(W.orderBy(F.desc("value"), "event_id")))
    fits = r.select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where("k <= budget")
    return fits.groupBy("budget").agg(F.count_if("y").alias("tp"), F.min("value").alias("threshold"))


@query("top_budget_quantile", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type='purchase') AS tp FROM events WHERE value >= (SELECT quantile_cont(value, 0.96) FROM events)")
def _(spark, d):
    e = t(spark, d, "events").select("value", "event_type")
    cut = ranks.quantiles(e, "value", {"cut": 0.96})  # one row
    return e.join(F.broadcast(cut)).where("value >= cut").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("tp"))


@query(
    "top_union_backfill",
    "WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS ra, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS rb FROM orders), u AS (SELECT *, (ra<=50 OR rb<=50) AS sure FROM a) SELECT o_orderkey, sure FROM (SELECT *, row_number() OVER (ORDER BY sure DESC, ra) AS k FROM u) WHERE k <= 100",
)
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    by_price = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    by_cust = o.orderBy(F.desc("o_custkey"), "o_orderkey").limit(50)
    ranked = by_price.withColumn("ra", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")))
    sure = ranked.where("ra <= 50").select("o_orderkey").union(by_cust.select("o_orderkey")).distinct().withColumn("sure", F.lit(True))
    fill = ranked.select("o_orderkey", "ra").join(sure, "o_orderkey", "full").select("o_orderkey", F.coalesce("sure", F.lit(False)).alias("sure"), "ra")
    return fill.orderBy(F.desc("sure"), F.asc_nulls_last("ra"), "o_orderkey").limit(100).select("o_orderkey", "sure")


@query("smp_simple", "SELECT c_custkey FROM customer ORDER BY sha1('s1|' || c_custkey::varchar), c_custkey LIMIT 40")
def _(spark, d):
    return sampling.simple(t(spark, d, "customer").select("c_custkey"), "c_custkey", 40, "s1")


@query("smp_per_stratum", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('s2|' || c_custkey::varchar), c_custkey) AS r FROM customer) WHERE r <= 7")
def _(spark, d):
    return sampling.per_stratum(t(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 7, "s2")


@query("smp_split", "SELECT c_custkey, CASE WHEN r <= round_even(n*0.7::double,0) THEN 'train' WHEN r <= round_even(n*0.7::double,0)+round_even(n*0.15::double,0) THEN 'dev' ELSE 'held_out' END AS split FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('s3|' || c_custkey::varchar), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)")
def _(spark, d):
    return sampling.split(t(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", "s3").select("c_custkey", "split")


@query("smp_quota", "WITH s AS (SELECT o_orderkey, CASE WHEN o_totalprice>250000 THEN 'large' WHEN o_orderstatus='P' THEN 'pending' WHEN o_orderpriority LIKE '1%' THEN 'urgent' END AS stratum FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha1('s4|' || o_orderkey::varchar), o_orderkey) AS k FROM s WHERE stratum IS NOT NULL) SELECT o_orderkey, stratum FROM r WHERE k <= CASE stratum WHEN 'large' THEN 20 WHEN 'pending' THEN 10 ELSE 15 END")
def _(spark, d):
    flags = {"large": F.col("o_totalprice") > 250000, "pending": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority").startswith("1")}
    return sampling.first_stratum(t(spark, d, "orders"), flags, "o_orderkey", {"large": 20, "pending": 10, "urgent": 15}, "s4").select("o_orderkey", "stratum")


@query("set_algebra", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag='R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag='N') SELECT (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS n_union, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS n_both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b")
def _(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "N").alias("b"))
    return g.agg(F.count_if(F.expr("a or b")).alias("n_union"), F.count_if(F.expr("a and b")).alias("n_both"), F.count_if(F.expr("a and not b")).alias("only_a"), F.count_if(F.expr("b and not a")).alias("only_b"))


@query("set_overlap_matrix", "WITH s AS (SELECT DISTINCT source, sha1(text) AS h FROM documents) SELECT a.source AS s1, b.source AS s2, count(*) AS n FROM s a JOIN s b ON a.h=b.h AND a.source<b.source GROUP BY 1,2")
def _(spark, d):
    # the sources of a text are gathered into a set first: it is bounded by the number of sources, the number of copies isn't
    g = t(spark, d, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(F.sort_array(F.collect_set("source")).alias("f")).where(F.size("f") > 1)
    pairs = F.flatten(F.transform("f", lambda a: F.transform(F.filter("f", lambda b: b > a), lambda b: F.struct(a.alias("s1"), b.alias("s2")))))
    return g.select(F.explode(pairs).alias("x")).groupBy("x.s1", "x.s2").agg(F.count("*").alias("n"))


@query("set_precedence", "SELECT sha1(text) AS h, min_by(lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END * 1000 + doc_id/1e9) AS lang FROM documents GROUP BY 1")
def _(spark, d):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return t(spark, d, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(F.min_by("lang", F.struct(rank, "doc_id")).alias("lang"))


@query("set_jaccard", "WITH s AS (SELECT c_nationkey AS g, list(DISTINCT c_mktsegment || (c_custkey%5)::varchar) AS x FROM customer GROUP BY 1) SELECT a.g AS g1, b.g AS g2, round(len(list_intersect(a.x,b.x))::double/len(list_distinct(list_concat(a.x,b.x))),9) AS jaccard FROM s a JOIN s b ON a.g<b.g AND b.g<=a.g+1")
def _(spark, d):
    s = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.collect_set(F.concat("c_mktsegment", (F.col("c_custkey") % 5).cast("string"))).alias("x"))
    b = s.select((F.col("g") - 1).alias("g"), F.col("g").alias("g2"), F.col("x").alias("y"))
    return s.join(b, "g").select(F.col("g").alias("g1"), "g2", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 9).alias("jaccard"))


@query("set_multiset_diff", "WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus='F' GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus='O' GROUP BY 1) SELECT coalesce(a.l_suppkey,b.l_suppkey) AS l_suppkey, greatest(coalesce(a.n,0)-coalesce(b.n,0),0) AS dropped, greatest(coalesce(b.n,0)-coalesce(a.n,0),0) AS added FROM a FULL JOIN b ON a.l_suppkey=b.l_suppkey")
def _(spark, d):
    g = t(spark, d, "lineitem").where("l_linestatus in ('F','O')").groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("b"))
    return g.select("l_suppkey", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("dropped"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


_SIDES = "x AS (SELECT l_orderkey AS g, l_returnflag AS concept, l_linenumber AS id, l_partkey % 5 AS s, l_partkey % 5 + 1 + l_suppkey % 3 AS e FROM lineitem), a AS (SELECT *, row_number() OVER (PARTITION BY g, concept, s, e ORDER BY id) AS nth FROM x WHERE id % 2 = 1), b AS (SELECT g, concept, s, e, id AS t_id, row_number() OVER (PARTITION BY g, concept, s, e ORDER BY id) AS nth FROM x WHERE id % 2 = 0)"


def _span_sides(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_returnflag").alias("concept"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 5).alias("s"), (F.col("l_partkey") % 5 + 1 + F.col("l_suppkey") % 3).alias("e"))
    return x.where("id % 2 = 1"), x.where("id % 2 = 0")


@query("jn_span_equal", f"WITH {_SIDES} SELECT g, concept, id, t_id FROM a FULL JOIN b USING (g, concept, s, e, nth)")
def _(spark, d):
    return spans.match_equal(*_span_sides(spark, d), ["g", "concept"])


@query("jn_span_scores", f"WITH {_SIDES}, p AS (SELECT concept, id, t_id FROM a FULL JOIN b USING (g, concept, s, e, nth)), n AS (SELECT concept, count(*) FILTER (WHERE id IS NOT NULL AND t_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t_id IS NULL) AS fn, count(*) FILTER (WHERE id IS NULL) AS fp FROM p GROUP BY 1) SELECT *, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall, 2*tp/nullif(2*tp+fp+fn,0) AS f1 FROM n")
def _(spark, d):
    return spans.span_scores(spans.match_equal(*_span_sides(spark, d), ["g", "concept"]), "concept")


@query("jn_span_greedy")
def _(spark, d):
    return spans.match_overlapping(*_span_sides(spark, d), ["g", "concept"])
