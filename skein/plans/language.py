"""Queries of text, templates, gates, classification and packaging."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import query
from ..functions import normal_phrase, template_id
from ..operators import classify, gates
from ..session import ship
from ..session import table as t
from ..text.lexicon import Concept, Cue, Lexicon
from ..text.exposure import exposure
from ..text.mentions import annotator
from ..text.segment import explode_sentences

_PARTS = "(SELECT doc_id, source, lang, unnest(string_split_regex(text, '\\n+|\\. ')) AS part FROM documents)"
_NORM = "trim(regexp_replace(regexp_replace(lower(part), '[0-9]+(\\.[0-9]+)?', '<NUM>', 'g'), '\\s+', ' ', 'g'))"
_TRAIN = "substr(sha1(doc_id::varchar),1,1) < 'b'"


def _parts(spark, d):
    x = t(spark, d, "documents").select("doc_id", "source", "lang", F.explode(F.split("text", r"\n+|\. ")).alias("part"))
    return x.withColumn("norm", normal_phrase(F.col("part"))).where("norm <> ''")


def _hashed(spark, d):
    """The parts with a digest in place of their phrase, so that no text is shuffled."""
    return _parts(spark, d).select("doc_id", "source", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("h"))


def _train():
    return F.substring(F.sha1(F.col("doc_id").cast("string").cast("binary")), 1, 1) < "b"


@query("txt_blocks", "SELECT lang, count(*) AS n_blocks, sum(length(b))::bigint AS chars FROM (SELECT lang, unnest(string_split_regex(text,' {2,}|[·•]+|\\n+')) AS b FROM documents) WHERE trim(b) <> '' GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "documents").select("lang", F.explode(F.split("text", r" {2,}|[·•]+|\n+")).alias("b")).where("trim(b) <> ''")
    return x.groupBy("lang").agg(F.count("*").alias("n_blocks"), F.sum(F.length("b")).alias("chars"))


@query("txt_template_ids", f"SELECT doc_id, substr(sha1(part),1,12) AS exact_id, substr(sha1({_NORM}),1,12) AS norm_id, count(*) AS n FROM {_PARTS} WHERE {_NORM} <> '' GROUP BY 1,2,3")
def _(spark, d):
    return _parts(spark, d).groupBy("doc_id", template_id(F.col("part")).alias("exact_id"), template_id(F.col("norm")).alias("norm_id")).agg(F.count("*").alias("n"))


_CATALOGUE = f"WITH p AS (SELECT *, {_NORM} AS norm FROM {_PARTS}), c AS (SELECT norm, count(DISTINCT source) AS n FROM p WHERE norm<>'' AND {_TRAIN} GROUP BY 1)"


def _catalogue(parts):
    return parts.where(_train()).groupBy("h").agg(F.count_distinct("source").alias("n_sources"))


@query("txt_stock_flags", _CATALOGUE + " SELECT p.doc_id, count(*) AS n_parts, count(*) FILTER (WHERE coalesce(c.n,0)>=10) AS n_stock, sum(coalesce(c.n,0))::bigint AS n_sources FROM p LEFT JOIN c USING (norm) WHERE p.norm<>'' GROUP BY 1")
def _(spark, d):
    p = _hashed(spark, d)
    # a document's repeated parts are counted before the join
    x = p.groupBy("doc_id", "h").agg(F.count("*").alias("k")).join(_catalogue(p), "h", "left").withColumn("n", F.coalesce("n_sources", F.lit(0)))
    return x.groupBy("doc_id").agg(F.sum("k").alias("n_parts"), F.coalesce(F.sum(F.when(F.col("n") >= 10, F.col("k"))), F.lit(0)).alias("n_stock"), F.sum(F.col("n") * F.col("k")).alias("n_sources"))


@query("template_coverage", _CATALOGUE + ", s AS (SELECT p.norm, coalesce(max(c.n),0) AS n, count(*) AS parts FROM p LEFT JOIN c USING (norm) WHERE p.norm<>'' GROUP BY 1) SELECT k::int AS k, count(*) FILTER (WHERE n>=k) AS templates, coalesce(sum(parts) FILTER (WHERE n>=k),0)::bigint AS parts, round(coalesce(sum(parts) FILTER (WHERE n>=k),0)::double/sum(parts),9) AS share FROM s, (VALUES (1),(2),(3),(5),(10),(15),(20)) v(k) GROUP BY 1")
def _(spark, d):
    p = _hashed(spark, d)
    sizes = p.groupBy("h").agg(F.count("*").alias("parts"), F.count_distinct(F.when(_train(), F.col("source"))).alias("n"))
    grid = [1, 2, 3, 5, 10, 15, 20]
    # one aggregation with a sum for each threshold, then seven rows
    sums = sizes.agg(F.sum("parts").alias("all"), *(F.count_if(F.col("n") >= k).alias(f"t{k}") for k in grid), *(F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("parts"))), F.lit(0)).alias(f"p{k}") for k in grid))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"t{k}").alias("templates"), F.col(f"p{k}").alias("parts")) for k in grid)))
    return sums.select("all", rows.alias("x")).select("x.k", "x.templates", "x.parts", F.round(F.col("x.parts") / F.col("all"), 9).alias("share"))


@query("txt_flags", "SELECT doc_id, regexp_matches(text,'(?i)licensed under|token = ') AS caveat, NOT regexp_matches(text,'[.!?]$') AS unfinished, count(*) OVER (PARTITION BY sha1(text)) > 1 AS repeated, length(regexp_replace(text,'\\s+',' ','g')) AS n_collapsed, regexp_matches(substr(text,1,70),'[|]') AS table_head FROM documents")
def _(spark, d):
    x = F.col("text")
    docs = t(spark, d, "documents").select("doc_id", F.sha1(x.cast("binary")).alias("h"), x.rlike("(?i)licensed under|token = ").alias("caveat"), (~x.rlike(r"[.!?]\z")).alias("unfinished"), F.length(F.regexp_replace(x, r"\s+", " ")).cast("long").alias("n_collapsed"), F.substring(x, 1, 70).rlike("[|]").alias("table_head"))
    # counted by digest and joined back, so a text with very many copies doesn't meet in one task
    n = docs.groupBy("h").agg((F.count("*") > 1).alias("repeated"))
    return docs.join(n, "h").drop("h")


@query("txt_measures", "SELECT doc_id, len(m) AS n, list_max(list_transform(m, lambda x: x::double)) AS top FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m FROM benchmark_docs) WHERE len(m) > 0".replace("benchmark_docs", "(SELECT item_id AS doc_id, text FROM benchmark UNION ALL SELECT event_id, props FROM events)"))
def _(spark, d):
    x = t(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text").union(t(spark, d, "events").select("event_id", "props"))
    m = F.regexp_extract_all("text", F.lit("([0-9]+)"))
    return x.select("doc_id", m.alias("m")).where("size(m) > 0").select("doc_id", F.size("m").cast("long").alias("n"), F.array_max(F.transform("m", lambda v: v.cast("double"))).alias("top"))


@query("txt_ngrams", "WITH w AS (SELECT item_id, string_split(lower(text),' ') AS w FROM benchmark), g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1,len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS gram FROM w) SELECT gram, count(*) AS docs FROM g GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    w = t(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("w")).where("size(w) > 1")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1))))
    return w.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs")).where("docs >= 2")


@query("txt_surface_candidates", "WITH k AS (SELECT doc_id, quality, unnest(list_distinct(string_split_regex(lower(text),'\\s+'))) AS w FROM documents JOIN labels USING (doc_id)) SELECT w, count(*) FILTER (WHERE quality=0) AS support, count(*) FILTER (WHERE quality=1) AS noise FROM k WHERE w<>'' GROUP BY 1 HAVING count(*) FILTER (WHERE quality=0) >= 4 AND count(*) FILTER (WHERE quality=1) <= 2")
def _(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    words = x.select("quality", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count_if(F.col("quality") == 0).alias("support"), F.count_if(F.col("quality") == 1).alias("noise")).where("support >= 4 and noise <= 2")


@query("txt_number_signature", "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text,'[0-9]+')) AS v FROM documents) SELECT doc_id, v, count(*) AS n FROM e GROUP BY 1,2 HAVING count(*) > 1")
def _(spark, d):
    e = t(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([0-9]+)"))).alias("v"))
    return e.groupBy("doc_id", "v").agg(F.count("*").alias("n")).where("n > 1")


@query("txt_best_part", f"SELECT doc_id, max_by(part, (regexp_matches(part,'[0-9]')::int, length(part), part)) AS part FROM {_PARTS} WHERE trim(part)<>'' GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\n+|\. ")).alias("part")).where("trim(part) <> ''")
    return x.groupBy("doc_id").agg(F.max_by("part", F.struct(F.col("part").rlike("[0-9]"), F.length("part"), "part")).alias("part"))


@query("txt_sentences")
def _(spark, d):
    """Sentence rows with offsets; tests hold them against the text and hard cases."""
    ship(spark)
    return explode_sentences(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def product_lexicon() -> Lexicon:
    """A lexicon over words of the documents, as the tables have no clinical terms."""
    words = lambda kind, names: [Concept(w, kind, (w,), None, kind == "anatomy") for w in names]
    return Lexicon(words("observation", ["queen", "license", "token", "copyright"]) + words("anatomy", ["table", "apache"]) + words("qualifier", ["idiot", "stupid", "worthless"]), [Cue("that", "negation", ("that",), "forward"), Cue("by", "uncertain", ("by",), "backward")], [r"\.", ";"], {"the": "left", "of": "right"})


@query("txt_mentions")
def _(spark, d):
    """Annotated mentions of the documents' sentences."""
    ship(spark)
    lexicon = product_lexicon()
    # only sentences with a pattern of some concept go to the matcher
    some = "(?iu)" + "|".join(p for c in lexicon.concepts for p in c.patterns)
    sentences = explode_sentences(t(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").where(F.col("text").rlike(some))
    x = sentences.select("doc_id", "sent_idx", F.explode(annotator(lexicon)(F.col("text"))).alias("m"))
    return x.select("doc_id", "sent_idx", "m.*")


@query("txt_exposure", "SELECT item_id, count(*) AS n_docs, count(DISTINCT source) AS n_sources FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY 1")
def _(spark, d):
    """Documents that hold a whole benchmark text, in any case."""
    return exposure(t(spark, d, "documents").select("doc_id", "source", "text"), t(spark, d, "benchmark"), "item_id", "text").groupBy("item_id").agg(F.count("*").alias("n_docs"), F.count_distinct("source").alias("n_sources"))


@query("cls_pattern_conflicts", "WITH f AS (SELECT regexp_matches(text,'[0-9]') AS a, regexp_matches(text,'[|]') AS b, regexp_matches(text,'[%#$]') AS c FROM documents) SELECT count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c, count(*) FILTER (WHERE a AND b) AS ab, count(*) FILTER (WHERE a AND c) AS ac, count(*) FILTER (WHERE b AND c) AS bc, count(*) FILTER (WHERE NOT (a OR b OR c)) AS uncovered FROM f")
def _(spark, d):
    x = F.col("text")
    f = t(spark, d, "documents").select(x.rlike("[0-9]").alias("a"), x.rlike("[|]").alias("b"), x.rlike("[%#$]").alias("c"))
    return f.agg(*(F.count_if(F.expr(e)).alias(k) for k, e in (("a", "a"), ("b", "b"), ("c", "c"), ("ab", "a and b"), ("ac", "a and c"), ("bc", "b and c"), ("uncovered", "not (a or b or c)"))))


def _findings(spark, d):
    e = t(spark, d, "events")
    level = classify.decide([
        (F.col("event_type") == "login", "none", "benign", False), (F.col("value") > 99, "known_malignancy", "known", True), (F.col("value") < 5, "none", "absent", True),
        (F.col("value") > 90, "high", "degree", True), (F.col("value") < 20, "low", "low_confidence", False), (F.lit(True), "intermediate", "default", True),
    ])
    return e.select("event_id", "user_id", level.alias("x")).select("event_id", "user_id", "x.*")


_LEVEL = "CASE WHEN event_type='login' THEN 'none' WHEN value>99 THEN 'known_malignancy' WHEN value<5 THEN 'none' WHEN value>90 THEN 'high' WHEN value<20 THEN 'low' ELSE 'intermediate' END"
_SOURCE = "CASE WHEN event_type='login' THEN 'benign' WHEN value>99 THEN 'known' WHEN value<5 THEN 'absent' WHEN value>90 THEN 'degree' WHEN value<20 THEN 'low_confidence' ELSE 'default' END"


@query("cls_decisions", f"SELECT level, source, count(*) AS n FROM (SELECT {_LEVEL} AS level, {_SOURCE} AS source FROM events) GROUP BY 1,2")
def _(spark, d):
    return _findings(spark, d).groupBy("level", "source").agg(F.count("*").alias("n"))


@query(
    "cls_roll_up",
    f"WITH f AS (SELECT user_id, event_id, {_LEVEL} AS level, {_SOURCE} AS source FROM events), r AS (SELECT *, list_position(['none','low','indeterminate','intermediate','high','known_malignancy'], level) AS k, source NOT IN ('benign','low_confidence') AS up FROM f), b AS (SELECT user_id, count(*) AS n, arg_max(level,(k,-event_id)) FILTER (WHERE up) AS level, arg_max(source,(k,-event_id)) FILTER (WHERE up) AS source FROM r GROUP BY 1) SELECT user_id, coalesce(level,'not_mentioned') AS level, source, n, CASE level WHEN 'none' THEN 'no_finding' WHEN 'low' THEN 'low_risk' WHEN 'indeterminate' THEN 'uncertain' WHEN 'intermediate' THEN 'suspicious' WHEN 'high' THEN 'suspicious' WHEN 'known_malignancy' THEN 'known' ELSE 'insufficient' END AS class FROM b",
)
def _(spark, d):
    return classify.roll_up(_findings(spark, d), "user_id", "event_id")


@query("cls_low_confidence", "SELECT codes, count(*) AS n FROM (SELECT concat_ws('|', CASE WHEN value<10 THEN 'F1' END, CASE WHEN event_type='click' AND value<50 THEN 'F2' END) AS codes FROM events) GROUP BY 1")
def _(spark, d):
    x = classify.low_confidence(t(spark, d, "events"), F.col("value") < 10, (F.col("event_type") == "click") & (F.col("value") < 50))
    return x.groupBy(F.col("filter_codes").alias("codes")).agg(F.count("*").alias("n"))


@query("cls_label_rules", "WITH x AS (SELECT o_orderkey, o_orderpriority AS concept, list(DISTINCT l_returnflag) AS context FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1,2) SELECT o_orderkey, 'hot' AS label, max((list_has_any(context,['R']) AND NOT list_has_any(context,['N']))::int)::int AS flag FROM x WHERE concept IN ('1-URGENT','2-HIGH') GROUP BY 1 UNION ALL SELECT o_orderkey, 'calm', max((NOT list_has_any(context,['R']))::int)::int FROM x WHERE concept='5-LOW' GROUP BY 1")
def _(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.col("o_orderpriority").alias("concept")).agg(F.collect_set("l_returnflag").alias("context"))
    rules = spark.createDataFrame([("hot", ["1-URGENT", "2-HIGH"], ["R"], ["N"]), ("calm", ["5-LOW"], [], ["R"])], "label string, concepts array<string>, required array<string>, excluded array<string>")
    return classify.label_rules(x, "o_orderkey", rules)


@query("cls_gap", "SELECT lang, count(*) AS n, round(1 - count(*) FILTER (WHERE regexp_matches(text,'[0-9]'))::double/count(*),9) AS gap FROM documents GROUP BY 1")
def _(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(1 - F.count_if(F.col("text").rlike("[0-9]")) / F.count("*"), 9).alias("gap"))


@query(
    "gate_all",
    "SELECT 'K3 blank' AS rule, count(*) FILTER (WHERE l_returnflag IS NULL OR trim(l_returnflag)='') AS violations FROM lineitem UNION ALL SELECT 'K3c closed set', count(*) FILTER (WHERE l_returnflag NOT IN ('A','N')) FROM lineitem UNION ALL SELECT 'K1b order', count(*) FILTER (WHERE l_discount >= l_tax) FROM lineitem UNION ALL SELECT 'K3b unique', (SELECT sum(n-1) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber))::bigint UNION ALL SELECT 'K2 parent', (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) UNION ALL SELECT 'K3v version', (SELECT count(DISTINCT l_linestatus)-1 FROM lineitem)",
)
def _(spark, d):
    x = t(spark, d, "lineitem")
    rows = gates.row_rules(x, {"K3 blank": gates.blank("l_returnflag"), "K3c closed set": gates.outside("l_returnflag", ["A", "N"]), "K1b order": F.col("l_discount") >= F.col("l_tax")})
    return gates.all_rules(rows, gates.repeated(x, ["l_orderkey", "l_linenumber"], "K3b unique"), gates.orphans(x, "l_partkey", t(spark, d, "part").where("p_size > 10"), "p_partkey", "K2 parent"), gates.versions(x, "l_linestatus", "K3v version"))


@query("gate_contiguous", "SELECT count(*) AS violations FROM (SELECT turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE turn <> coalesce(p+1, turn) OR p IS NULL AND turn > 1")
def _(spark, d):
    x = t(spark, d, "conversations").select("turn", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("p"))
    return x.where("turn <> coalesce(p + 1, turn) or p is null and turn > 1").agg(F.count("*").alias("violations"))


@query("gate_leak", "SELECT count(DISTINCT d.h) AS shared FROM (SELECT sha1(text) AS h FROM documents WHERE source='src0') d JOIN (SELECT sha1(text) AS h FROM documents WHERE source<>'src0') e USING (h)")
def _(spark, d):
    g = t(spark, d, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(F.bool_or(F.col("source") == "src0").alias("a"), F.bool_or(F.col("source") != "src0").alias("b"))
    return g.agg(F.count_if(F.expr("a and b")).alias("shared"))


@query("pkg_fingerprint", "SELECT c_mktsegment, count(*) AS n, sha256(string_agg(c_custkey::varchar, chr(10) ORDER BY c_custkey::varchar) || chr(10)) AS sha256 FROM customer GROUP BY 1")
def _(spark, d):
    from ..operators.packaging import fingerprint

    return fingerprint(t(spark, d, "customer"), "c_custkey", ("c_mktsegment",))


@query(
    "txt_concept_sets",
    "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text,'(?i)(^|[^\\p{L}\\p{N}_])licen[sc]') THEN 'licence' END, CASE WHEN regexp_matches(text,'(?i)(^|[^\\p{L}\\p{N}_])qu') THEN 'question' END, CASE WHEN regexp_matches(text,'(?i)(^|[^\\p{L}\\p{N}_])re[adp]') THEN 'reader' END) AS concepts FROM documents",
)
def _(spark, d):
    # concepts that don't compete for places need no matcher: each is a flag of one scan
    names = {"licence": "licen[sc]", "question": "qu", "reader": "re[adp]"}
    found = F.concat_ws(",", *(F.when(F.col("text").rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}_]){p}"), F.lit(k)) for k, p in names.items()))
    return t(spark, d, "documents").select("doc_id", found.alias("concepts"))
