"""Queries of metrics, ranks, resampling and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import agreement_word, chance_f1, f1, kappa, mcc, ratio, wilson
from ..operators import probe, ranks, resample, vectors
from ..session import table as t

_CELLS = "WITH x AS (SELECT d.*, l.quality AS y, l.toxic AS z, (n_chars > 1500)::int AS p FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE y=1 AND p=1) AS tp, count(*) FILTER (WHERE y=0 AND p=1) AS fp, count(*) FILTER (WHERE y=1 AND p=0) AS fn, count(*) FILTER (WHERE y=0 AND p=0) AS tn FROM x GROUP BY 1)"


def _labelled(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, d, "labels"), "doc_id").withColumn("p", (F.col("n_chars") > 1500).cast("int"))


def _cells(x, *by):
    y, p = F.col("quality") == 1, F.col("p") == 1
    return x.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


@query("sta_cells", _CELLS + " SELECT lang, tp, fp, fn, tn, round(tp/nullif(tp+fp,0)::double,9) AS precision, round(tp/nullif(tp+fn,0)::double,9) AS recall, round(2*tp/nullif(2*tp+fp+fn,0)::double,9) AS f1, round(coalesce((tp::double*tn-fp::double*fn)/nullif(sqrt((tp+fp)::double*(tp+fn)*(tn+fp)*(tn+fn)),0),0),9) AS mcc, round(2.0::double*(tp+fn)*(tp+fp)/nullif((tp+fp+fn+tn)*(2*tp+fn+fp),0),9) AS chance FROM c")
def _(spark, d):
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    c = _cells(_labelled(spark, d), "lang")
    return c.select("lang", "tp", "fp", "fn", "tn", F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(f1(tp, fp, fn), 9).alias("f1"), F.round(mcc(tp, fp, fn, tn), 9).alias("mcc"), F.round(chance_f1(tp + fn, tp + fp, tp + fp + fn + tn), 9).alias("chance"))


@query("sta_kappa", _CELLS + ", k AS (SELECT lang, (tp+tn)/(tp+fp+fn+tn)::double AS po, ((tp+fp)::double*(tp+fn)+(tn+fp)::double*(tn+fn))/((tp+fp+fn+tn)::double*(tp+fp+fn+tn)) AS pe FROM c) SELECT lang, round(CASE WHEN pe<>1 THEN (po-pe)/(1-pe) END,9) AS kappa, CASE WHEN pe=1 THEN NULL WHEN (po-pe)/(1-pe)<0.01 THEN 'none' WHEN (po-pe)/(1-pe)<=0.2 THEN 'slight' WHEN (po-pe)/(1-pe)<=0.4 THEN 'fair' WHEN (po-pe)/(1-pe)<=0.6 THEN 'moderate' WHEN (po-pe)/(1-pe)<=0.8 THEN 'substantial' ELSE 'almost perfect' END AS word FROM k")
def _(spark, d):
    k = kappa(*map(F.col, ("tp", "fp", "fn", "tn")))
    return _cells(_labelled(spark, d), "lang").select("lang", F.round(k, 9).alias("kappa"), agreement_word(k).alias("word"))


@query("sta_kappa_classes", "WITH x AS (SELECT o_orderstatus AS a, CASE WHEN o_totalprice<100000 THEN 'F' WHEN o_totalprice<200000 THEN 'O' ELSE 'P' END AS b FROM orders), n AS (SELECT count(*)::double AS n, count(*) FILTER (WHERE a=b)::double AS s FROM x), e AS (SELECT sum(na*nb) AS e FROM (SELECT a, count(*)::double AS na FROM x GROUP BY 1) JOIN (SELECT b, count(*)::double AS nb FROM x GROUP BY 1) ON a=b) SELECT round((s/n - e/(n*n))/(1-e/(n*n)),9) AS kappa FROM n, e")
def _(spark, d):
    b = F.when(F.col("o_totalprice") < 100000, "F").when(F.col("o_totalprice") < 200000, "O").otherwise("P")
    c = t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("a"), b.alias("b")).agg(F.count("*").cast("double").alias("n"))  # nine rows at most
    same = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0.0)).alias("s"))
    left, right = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    e = left.join(right, F.col("a") == F.col("b")).agg(F.sum(F.col("na") * F.col("nb")).alias("e"))
    pe = F.col("e") / (F.col("n") * F.col("n"))
    return same.join(F.broadcast(e)).select(F.round((F.col("s") / F.col("n") - pe) / (1 - pe), 9).alias("kappa"))


@query("sta_macro", _CELLS + " SELECT round(avg(2*tp/nullif(2*tp+fp+fn,0)::double),9) AS macro_f1, round(2*sum(tp)/nullif(2*sum(tp)+sum(fp)+sum(fn),0)::double,9) AS micro_f1, round(sum(tp+tn)/sum(tp+fp+fn+tn)::double,9) AS accuracy FROM c")
def _(spark, d):
    c = _cells(_labelled(spark, d), "lang")
    s = F.sum
    return c.agg(F.round(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))), 9).alias("macro_f1"), F.round(f1(s("tp"), s("fp"), s("fn")), 9).alias("micro_f1"), F.round(s(F.col("tp") + F.col("tn")) / s(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 9).alias("accuracy"))


@query("sta_strata", _CELLS.replace("SELECT lang, count(*) FILTER (WHERE y=1 AND p=1)", "SELECT coalesce(lang,'ALL') AS lang, count(*) FILTER (WHERE y=1 AND p=1)").replace("FROM x GROUP BY 1)", "FROM x GROUP BY ROLLUP (lang))").replace("FROM x GROUP BY ROLLUP", "FROM (SELECT lang AS lang, y, p FROM x) x GROUP BY ROLLUP") + " SELECT lang, tp, fp, fn, tn FROM c")
def _(spark, d):
    y, p = F.col("quality") == 1, F.col("p") == 1
    x = _labelled(spark, d).rollup("lang").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return x.select(F.coalesce("lang", F.lit("ALL")).alias("lang"), "tp", "fp", "fn", "tn")


_AUC = "WITH x AS (SELECT lang, quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s)-1)/2.0::double AS k FROM x), g AS (SELECT lang, sum(y)::bigint AS n_pos, count(*)-sum(y)::bigint AS n_neg, sum(k) FILTER (WHERE y=1) AS rs FROM r GROUP BY 1) SELECT lang, n_pos, n_neg, round((rs-n_pos*(n_pos+1)/2)/nullif(n_pos::double*n_neg,0),9) AS auc FROM g"


@query("sta_auc", _AUC)
def _(spark, d):
    return ranks.auc(_labelled(spark, d), "n_chars", "quality", ("lang",)).withColumn("auc", F.round("auc", 9))


@query("sta_average_precision", "WITH x AS (SELECT lang, quality AS y, row_number() OVER w AS k, sum(quality) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id)) SELECT lang, round(avg(tp::double/k),9) AS ap FROM x WHERE y=1 GROUP BY 1")
def _(spark, d):
    return ranks.average_precision(_labelled(spark, d), "n_chars", "quality", "doc_id", ("lang",)).withColumn("ap", F.round("ap", 9))


@query("sta_correlation", "WITH r AS (SELECT n_chars::double AS a, doc_id::double AS b, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars)-1)/2.0::double AS ra, rank() OVER (ORDER BY doc_id) AS rb FROM documents) SELECT round(corr(a,b),9) AS pearson, round(corr(ra,rb::double),9) AS spearman FROM r")
def _(spark, d):
    x = t(spark, d, "documents").select("doc_id", "n_chars")
    r = ranks.average_rank(ranks.average_rank(x, "n_chars", into="ra"), "doc_id", into="rb")
    return r.agg(F.round(F.corr(F.col("n_chars").cast("double"), F.col("doc_id").cast("double")), 9).alias("pearson"), F.round(F.corr("ra", "rb"), 9).alias("spearman"))


@query("sta_threshold_sweep", "SELECT v.c::int AS threshold, count(*) FILTER (WHERE quality=1 AND n_chars>=v.c) AS tp, count(*) FILTER (WHERE quality=0 AND n_chars>=v.c) AS fp, round(count(*) FILTER (WHERE quality=1 AND n_chars>=v.c)/nullif(count(*) FILTER (WHERE quality=1),0)::double - count(*) FILTER (WHERE quality=0 AND n_chars>=v.c)/nullif(count(*) FILTER (WHERE quality=0),0)::double,9) AS youden FROM documents JOIN labels USING (doc_id), (VALUES (500),(1000),(2000),(4000)) v(c) GROUP BY 1")
def _(spark, d):
    grid = [500, 1000, 2000, 4000]
    y, s = F.col("quality"), F.col("n_chars")
    sums = _labelled(spark, d).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), *(F.count_if((y == v) & (s >= c)).alias(f"{k}{c}") for c in grid for k, v in (("tp", 1), ("fp", 0))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("threshold"), F.col(f"tp{c}").alias("tp"), F.col(f"fp{c}").alias("fp")) for c in grid)))
    return sums.select("pos", "neg", rows.alias("x")).select("x.*", F.round(ratio(F.col("x.tp"), F.col("pos")) - ratio(F.col("x.fp"), F.col("neg")), 9).alias("youden"))


@query("sta_wilson", _CELLS + ", w AS (SELECT lang, tp::double/nullif(tp+fn,0) AS p, (tp+fn)::double AS n FROM c) SELECT lang, round(greatest(0,(p+3.841458821/(2*n))/(1+3.841458821/n) - 1.959963985*sqrt(p*(1-p)/n+3.841458821/(4*n*n))/(1+3.841458821/n)),6) AS low, round(least(1,(p+3.841458821/(2*n))/(1+3.841458821/n) + 1.959963985*sqrt(p*(1-p)/n+3.841458821/(4*n*n))/(1+3.841458821/n)),6) AS high FROM w")
def _(spark, d):
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return _cells(_labelled(spark, d), "lang").select("lang", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("sta_operating_point", "WITH r AS (SELECT quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(sum(y)) OVER (ORDER BY s DESC) AS tp, sum(sum(1-y)) OVER (ORDER BY s DESC) AS fp FROM r GROUP BY 1), n AS (SELECT sum(y)::double AS p, sum(1-y)::double AS q FROM r) SELECT round(max(tp/p) FILTER (WHERE fp/q <= 0.10),9) AS tpr_at_fpr10, round(min(fp/q) FILTER (WHERE tp/p >= 0.80),9) AS fpr_at_tpr80 FROM g, n")
def _(spark, d):
    j = ranks.operating_points(_labelled(spark, d), "n_chars", "quality")
    return j.agg(F.round(F.max(F.when(F.col("fpr") <= 0.1, F.col("tpr"))), 9).alias("tpr_at_fpr10"), F.round(F.min(F.when(F.col("tpr") >= 0.8, F.col("fpr"))), 9).alias("fpr_at_tpr80"))


@query("sta_within_group", "WITH g AS (SELECT user_id, max(value) FILTER (WHERE event_type='purchase') AS p, max(value) FILTER (WHERE event_type<>'purchase') AS q FROM events GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE p>q) AS wins FROM g WHERE p IS NOT NULL AND q IS NOT NULL")
def _(spark, d):
    y = F.col("event_type") == "purchase"
    g = t(spark, d, "events").groupBy("user_id").agg(F.max(F.when(y, F.col("value"))).alias("p"), F.max(F.when(~y, F.col("value"))).alias("q"))
    return g.where("p is not null and q is not null").agg(F.count("*").alias("n"), F.count_if(F.expr("p > q")).alias("wins"))


@query("sta_horizon", "SELECT h::int AS horizon, count(*) AS n, count(*) FILTER (WHERE k < h) AS events FROM (SELECT json_extract_string(props,'$.k')::int AS k, value FROM events), (VALUES (10),(20),(50)) v(h) WHERE value >= h/10.0 GROUP BY 1")
def _(spark, d):
    e = t(spark, d, "events").select(F.from_json("props", "k int")["k"].alias("k"), "value")
    x = e.select("k", "value", F.explode(F.array(F.lit(10), F.lit(20), F.lit(50))).alias("horizon")).where(F.col("value") >= F.col("horizon") / 10)
    return x.groupBy("horizon").agg(F.count("*").alias("n"), F.count_if(F.expr("k < horizon")).alias("events"))


_U = "(('0x' || substr(md5('7|' || i || '|' || source),1,8))::bigint/4294967296.0::double)"
_POISSON = " + ".join(f"(u >= {p})::int" for p in resample.POISSON_1)


@query(
    "sta_bootstrap",
    f"WITH x AS (SELECT source, quality=1 AS y, n_chars>1500 AS a, n_chars>900 AS b FROM documents JOIN labels USING (doc_id)), g AS (SELECT source, sum((y AND a)::int) AS tpa, sum((y<>a)::int) AS ea, sum((y AND b)::int) AS tpb, sum((y<>b)::int) AS eb FROM x GROUP BY 1), m AS (SELECT g.*, i, {_U} AS u FROM g, (SELECT unnest(range(1,1001)) AS i)), w AS (SELECT *, {_POISSON} AS w FROM m), f AS (SELECT i, 2*sum(w*tpb)/nullif(2*sum(w*tpb)+sum(w*eb),0)::double - 2*sum(w*tpa)/nullif(2*sum(w*tpa)+sum(w*ea),0)::double AS d FROM w GROUP BY 1) "
    "SELECT round(avg(d),6) AS mean, round(quantile_cont(d,0.025),6) AS low, round(quantile_cont(d,0.975),6) AS high, round(stddev_samp(d),6) AS se, round(least(1,2*least(avg((d<=0)::int),avg((d>=0)::int))),6) AS p, count(d) AS defined, count(*)-count(d) AS undefined FROM f",
)
def _(spark, d):
    """The clustered bootstrap interval of the difference of two systems' F1."""
    x = _labelled(spark, d).withColumn("p2", (F.col("n_chars") > 900).cast("int"))
    y = F.col("quality") == 1
    sums = {}
    for k, p in (("a", F.col("p") == 1), ("b", F.col("p2") == 1)):
        sums |= {f"tp_{k}": (y & p).cast("int"), f"e_{k}": (y != p).cast("int")}
    draws = resample.weighted(x, "source", sums, 1000)
    f = lambda k: F.try_divide(2 * F.col(f"tp_{k}"), 2 * F.col(f"tp_{k}") + F.col(f"e_{k}"))
    return resample.interval(draws.withColumn("diff", f("b") - f("a")), "diff").select(*(F.round(k, 6).alias(k) for k in ("mean", "low", "high", "se", "p")), "defined", "undefined")


@query("sta_retrieval", "WITH q AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id, q.label = b.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e::double[], b.embedding::double[]),9) DESC, b.vec_id) AS k FROM q JOIN embeddings b ON q.vec_id <> b.vec_id) SELECT count(DISTINCT vec_id) AS n, round(avg(f),9) AS mean_rank, count(*) FILTER (WHERE f <= 10) AS r10 FROM (SELECT vec_id, min(k) FILTER (WHERE hit) AS f FROM s GROUP BY 1)")
def _(spark, d):
    r = vectors.first_hit_ranks(t(spark, d, "embeddings"), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)
    return r.agg(F.count("*").alias("n"), F.round(F.avg("rank"), 9).alias("mean_rank"), F.count_if(F.col("rank") <= 10).alias("r10"))


_BOTH = "p AS (SELECT vec_id, embedding::double[] AS a, list_transform(range(1,65), lambda i: embedding[i]::double + 0.4::double*embedding[65-i]::double) AS b FROM embeddings)"


def _direction_sql(own: str, other: str) -> str:
    return f"SELECT '{own}{other}' AS direction, count(*) AS n, round(avg((k<=1)::int)*100,9) AS r1, round(avg((k<=10)::int)*100,9) AS r10, median(k)::double AS med_r FROM (SELECT q.vec_id, 1+count(*) FILTER (WHERE round(list_cosine_similarity(q.{own},x.{other}),9) > s OR (round(list_cosine_similarity(q.{own},x.{other}),9) = s AND x.vec_id<q.vec_id)) AS k FROM (SELECT *, round(list_cosine_similarity(a,b),9) AS s FROM p WHERE vec_id%50=0) q, p x GROUP BY 1)"


@query("sta_pair_retrieval", f"WITH {_BOTH} {_direction_sql('a', 'b')} UNION ALL {_direction_sql('b', 'a')}")
def _(spark, d):
    """Ranks of each vector's own pair, in both directions."""
    e = F.col("embedding").cast("array<double>")
    p = t(spark, d, "embeddings").select("vec_id", e.alias("a"), F.zip_with(e, F.reverse(e), lambda x, y: x + y * 0.4).alias("b"))
    asked = F.col("vec_id") % 50 == 0
    out = None
    for own, other in (("a", "b"), ("b", "a")):
        x = vectors.retrieval_summary(vectors.pair_ranks(p, p, "vec_id", own, other, asked), at=(1, 10))
        x = x.select(F.lit(own + other).alias("direction"), "n", F.round("r1", 9).alias("r1"), F.round("r10", 9).alias("r10"), F.col("med_r").cast("double").alias("med_r"))
        out = x if out is None else out.unionByName(x)
    return out


@query("sta_near_copies", "SELECT count(*) AS asked, count(*) FILTER (WHERE k>0)::bigint AS with_copy FROM (SELECT q.vec_id, count(*) FILTER (WHERE x.vec_id<>q.vec_id AND round(list_cosine_similarity(q.embedding::double[],x.embedding::double[]),9) >= 0.4) AS k FROM embeddings q, embeddings x WHERE q.vec_id%50=0 GROUP BY 1)")
def _(spark, d):
    return vectors.near_copies(t(spark, d, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, 0.4)


@query("sta_balanced_folds", "WITH g AS (SELECT vec_id//4 AS g, max((label%2)::int) AS y FROM embeddings GROUP BY 1), f AS (SELECT g, ((row_number() OVER (PARTITION BY y ORDER BY sha1('0|' || g::varchar), g)-1)%5)::int AS fold FROM g) SELECT vec_id, fold FROM embeddings JOIN f ON vec_id//4=g")
def _(spark, d):
    x = t(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("g"), (F.col("label") % 2).cast("int").alias("y"))
    return probe.balanced_folds(x, "g", F.max("y")).select("vec_id", "fold")


@query("sta_embedding_gate", "SELECT count(*) AS n, count(*) - count(DISTINCT embedding::varchar) AS repeated, count(*) FILTER (WHERE abs(sqrt(list_dot_product(embedding::double[], embedding::double[]))-1) > 1e-3) AS not_unit FROM embeddings")
def _(spark, d):
    e = t(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, b: a + b))
    return e.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("embedding")).alias("repeated"), F.count_if(F.abs(norm - 1) > 1e-3).alias("not_unit"))


@query("sta_fusion", "WITH r AS (SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice)-1)/2.0::double AS a, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey)-1)/2.0::double AS b, count(*) OVER () AS n FROM orders) SELECT o_orderkey, round((a/n+b/n)/2,9) AS fused FROM r")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    r = ranks.average_rank(ranks.average_rank(o, "o_totalprice", into="a"), "o_custkey", into="b")
    n = o.agg(F.count("*").alias("n"))  # one row
    return r.join(F.broadcast(n)).select("o_orderkey", F.round((F.col("a") / F.col("n") + F.col("b") / F.col("n")) / 2, 9).alias("fused"))


@query(
    "sta_participation",
    "WITH e AS (SELECT vec_id, unnest(embedding)::double AS v, generate_subscripts(embedding,1) AS i FROM embeddings), c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM e), g AS (SELECT a.i AS i, b.i AS j, sum(a.v*b.v) AS s FROM c a JOIN c b USING (vec_id) GROUP BY 1,2) SELECT round(pow(sum(s) FILTER (WHERE i=j),2)/sum(s*s),6) AS participation FROM g",
)
def _(spark, d):
    return vectors.participation(t(spark, d, "embeddings"), "embedding").select(F.round("participation", 6).alias("participation"))


def _probed(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") % 2).alias("y"), probe.grouped_fold(F.floor(F.col("vec_id") / 4)).alias("fold"))


@query("sta_probe")
def _(spark, d):
    return probe.out_of_fold(_probed(spark, d), "embedding", "y", "fold").select("vec_id", "fold", "y", F.round("score", 5).alias("score"))


@query("sta_probe_held_out")
def _(spark, d):
    x = _probed(spark, d)
    fitted = probe.fit(x.where("fold < 3"), "embedding", "y")
    if fitted is None:
        return probe.held_out(x.where("fold = 4").withColumn("score", F.lit(None).cast("double")), None, "y")
    return probe.held_out(fitted.score(x.where("fold = 4")), probe.threshold_at_load(fitted.score(x.where("fold = 3")), 0.2), "y")
