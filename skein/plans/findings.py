"""Queries of the findings table: verdicts, enrichment, series summaries, rule studies, and its gates.

The driver's tables have no clinical findings, so an entity table of their shape
is derived from `lineitem`: an order is a study, a line an entity.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import query
from ..operators import classify, findings, gates
from ..session import table as t

CONCEPTS = ["nodule", "mass", "lung", "liver", "spiculated", "calcified", "granuloma", "metastasis"]
KINDS = ["observation", "observation", "anatomy", "anatomy", "qualifier", "qualifier", "observation", "observation"]
ASSERTIONS = ["present", "absent", "uncertain"]
RULES = ["default", "inference:favours", "inference:possible"]
TEXTS = ["history of lung carcinoma", "no suspicious nodule in the right upper lobe", "possibly benign, lower lobe of the left lung", "pulmonary nodule, solid", "stable since the last examination"]
SIZES = ["5 mm", "about 1,5 cm", "small"]
BUCKETS = ["thorax", "mediastinum", "other_organ", "unknown"]


def _listed(values) -> str:
    return "[" + ",".join(f"'{x}'" for x in values) + "]"


_ENT = f"""WITH l AS (SELECT l_orderkey AS study, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity)::int AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
ent AS (SELECT study, CASE WHEN n%2=1 THEN 'findings' ELSE 'impression' END AS section, ((n-1)//4)::int AS sent_idx, study*10+n AS entity_id, ({_listed(CONCEPTS)})[p%8+1] AS concept, ({_listed(KINDS)})[p%8+1] AS kind, ({_listed(ASSERTIONS)})[s%3+1] AS assertion, ({_listed(RULES)})[q%3+1] AS rule, ({_listed(TEXTS)})[q%5+1] AS text, ({_listed(CONCEPTS)})[p%8+1] AS raw_text, (p%12)::int AS char_start, (p%12+s%7)::int AS char_end, CASE WHEN f<>'R' THEN f END AS cue, ({_listed(['none', 'increased', 'stable'])})[q%3+1] AS change, f FROM l),
rel AS (SELECT study, entity_id AS head_id, lead(entity_id) OVER (PARTITION BY study ORDER BY entity_id) AS tail_id, CASE WHEN kind='qualifier' THEN 'modify' WHEN kind='observation' AND assertion<>'absent' THEN 'located_at' ELSE 'measured_by' END AS relation_type, ({_listed(SIZES)})[entity_id%3+1] AS tail_text, entity_id AS seq FROM ent)"""


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _ent(spark, d):
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("study"), F.col("l_linenumber").alias("n"))
    x = x.agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"))
    n, p, s, q, f = (F.col(c) for c in "npsqf")
    return x.select(
        "study", F.when(n % 2 == 1, "findings").otherwise("impression").alias("section"), F.floor((n - 1) / 4).cast("int").alias("sent_idx"), (F.col("study") * 10 + n).alias("entity_id"), _pick(CONCEPTS, p % 8).alias("concept"), _pick(KINDS, p % 8).alias("kind"),
        _pick(ASSERTIONS, s % 3).alias("assertion"), _pick(RULES, q % 3).alias("rule"), _pick(TEXTS, q % 5).alias("text"), _pick(CONCEPTS, p % 8).alias("raw_text"), (p % 12).cast("int").alias("char_start"), (p % 12 + s % 7).cast("int").alias("char_end"),
        F.when(f != "R", f).alias("cue"), _pick(["none", "increased", "stable"], q % 3).alias("change"), "f",
    )


def _rel(ent):
    kind = F.when(F.col("kind") == "qualifier", "modify").when((F.col("kind") == "observation") & (F.col("assertion") != "absent"), "located_at").otherwise("measured_by")
    tail = F.lead("entity_id").over(W.partitionBy("study").orderBy("entity_id"))
    return ent.select("study", F.col("entity_id").alias("head_id"), tail.alias("tail_id"), kind.alias("relation_type"), _pick(SIZES, F.col("entity_id") % 3).alias("tail_text"), F.col("entity_id").alias("seq"))


_BENIGN = "SELECT DISTINCT study, section, sent_idx FROM ent WHERE (concept IN ('granuloma','calcified') AND assertion='present' AND rule IN ('inference:favours')) OR regexp_matches(text,'(?i)possibly benign')"


@query("cls_definite_benign", f"{_ENT} {_BENIGN}")
def _(spark, d):
    return findings.definite_benign(_ent(spark, d), ["granuloma", "calcified"], ["inference:favours"], "(?i)possibly benign")


@query("cls_known_cancer", f"{_ENT} SELECT entity_id, assertion<>'absent' AND regexp_matches(text,'(?i)history of|known') AND regexp_matches(text,'(?i)carcinom|metasta') AS known FROM ent")
def _(spark, d):
    return _ent(spark, d).select("entity_id", findings.known_cancer("(?i)history of|known", "(?i)carcinom|metasta").alias("known"))


_RICH = _ENT + """, st AS (SELECT study, section, sent_idx, bool_or(q) AS in_stock FROM (SELECT study, section, sent_idx, f='A' AS q FROM ent) GROUP BY 1,2,3),
su AS (SELECT DISTINCT r.tail_id FROM rel r JOIN ent e ON r.head_id=e.entity_id WHERE r.relation_type='modify' AND e.concept='spiculated'),
rich AS (SELECT ent.*, coalesce(in_stock,false) AS in_stock, entity_id IN (SELECT tail_id FROM su WHERE tail_id IS NOT NULL) AS suspicious FROM ent LEFT JOIN st USING (study, section, sent_idx))"""


def _rich(spark, d):
    ent = _ent(spark, d)
    stock = ent.select(*findings.SENTENCE, (F.col("f") == "A").alias("is_stock"))
    return findings.with_modifier(findings.with_stock(ent, stock), _rel(ent), ["spiculated"])


@query("cls_enriched", f"{_RICH} SELECT entity_id, in_stock, suspicious, concept IN ('nodule','mass') AND in_stock AND NOT suspicious AS stock_nodule FROM rich")
def _(spark, d):
    return _rich(spark, d).select("entity_id", "in_stock", "suspicious", findings.stock_nodule(True, ["nodule", "mass"]).alias("stock_nodule"))


_AWAY = """, away AS (SELECT e.entity_id FROM ent e WHERE e.entity_id IN (SELECT r.head_id FROM rel r JOIN ent a ON r.tail_id=a.entity_id WHERE r.relation_type='located_at' AND a.concept='liver') AND NOT regexp_matches(e.raw_text,'(?i)pulmonar|lung') AND NOT regexp_matches(substr(e.text, greatest(e.char_start-25,0)+1, e.char_end-greatest(e.char_start-25,0)),'(?i)pulmonar|lung') AND (study, section, sent_idx) NOT IN (SELECT (study, section, sent_idx) FROM ent GROUP BY study, section, sent_idx HAVING bool_or(concept='liver') AND bool_or(concept='lung')))"""


@query("cls_outside_region", f"{_ENT}{_AWAY} SELECT entity_id FROM away")
def _(spark, d):
    ent = _ent(spark, d)
    return findings.outside_region(ent, _rel(ent), ["liver"], ["lung"], "(?i)pulmonar|lung")


_MM = "CASE WHEN lower(regexp_extract({0},'(?i)([0-9]+(?:[.,][0-9]+)?)\\s*(mm|cm)',2))='cm' THEN round(replace(regexp_extract({0},'(?i)([0-9]+(?:[.,][0-9]+)?)\\s*(mm|cm)',1),',','.')::double*10,2) ELSE try_cast(replace(regexp_extract({0},'(?i)([0-9]+(?:[.,][0-9]+)?)\\s*(mm|cm)',1),',','.') AS double) END"
_SIZED = f", sized AS (SELECT e.entity_id, {_MM.format('r.tail_text')} AS size_mm FROM ent e LEFT JOIN rel r ON r.head_id=e.entity_id AND r.relation_type='measured_by')"


@query("cls_sizes", f"{_ENT}{_SIZED} SELECT entity_id, size_mm, CASE WHEN size_mm IS NULL THEN 'none' ELSE 'L1' END AS size_level FROM sized")
def _(spark, d):
    ent = _ent(spark, d)
    return findings.with_size(ent, _rel(ent)).select("entity_id", "size_mm", "size_level")


@query("cls_promoted", f"{_ENT} SELECT entity_id, section='findings' AND kind<>'anatomy' AND (study, concept) IN (SELECT (study, concept) FROM ent WHERE section='impression' AND kind<>'anatomy') AS promoted FROM ent")
def _(spark, d):
    return findings.promoted(_ent(spark, d)).select("entity_id", "promoted")


_CONTEXT = ", ctx AS (SELECT e.entity_id, e.study, e.concept, e.assertion, list_sort(list_distinct(list_concat(coalesce((SELECT list(a.concept) FROM rel r JOIN ent a ON r.tail_id=a.entity_id WHERE r.head_id=e.entity_id AND r.relation_type='located_at' AND a.kind='anatomy'),[]::varchar[]), coalesce(h.here,[]::varchar[])))) AS context FROM ent e LEFT JOIN (SELECT study, section, sent_idx, list(concept) AS here FROM ent WHERE kind='anatomy' GROUP BY 1,2,3) h USING (study, section, sent_idx) WHERE e.kind='observation')"


@query("cls_anatomy_context", f"{_ENT}{_CONTEXT} SELECT entity_id, concept, array_to_string(context,',') AS context FROM ctx")
def _(spark, d):
    ent = _ent(spark, d)
    return findings.anatomy_context(ent, _rel(ent)).select("entity_id", "concept", F.array_join("context", ",").alias("context"))


@query(
    "cls_panel",
    f"{_ENT}{_CONTEXT} SELECT study, 'nodule_of_lung' AS label, max((list_contains(context,'lung') AND NOT list_contains(context,'liver'))::int)::int AS flag FROM ctx WHERE concept IN ('nodule','mass') AND assertion='present' GROUP BY 1 UNION ALL SELECT study, 'spread', max((NOT list_contains(context,'liver'))::int)::int FROM ctx WHERE concept='metastasis' AND assertion='present' GROUP BY 1 UNION ALL SELECT study, 'benign', 1 FROM ctx WHERE concept='granuloma' AND assertion='present' GROUP BY 1",
)
def _(spark, d):
    ent = _ent(spark, d)
    rules = spark.createDataFrame([("nodule_of_lung", ["nodule", "mass"], ["lung"], ["liver"]), ("spread", ["metastasis"], [], ["liver"]), ("benign", ["granuloma"], [], [])], "label string, concepts array<string>, required array<string>, excluded array<string>")
    return classify.label_rules(findings.anatomy_context(ent, _rel(ent)).where("assertion = 'present'"), "study", rules)


@query(
    "cls_series_summary",
    f"{_ENT}{_AWAY}{_SIZED}, x AS (SELECT ent.*, f<>'N' OR section='findings' AS in_scope, ({_listed(BUCKETS)})[entity_id%4+1] AS bucket, entity_id IN (SELECT entity_id FROM away) AS is_outside, size_mm FROM ent JOIN sized USING (entity_id)), lob AS (SELECT *, CASE WHEN text LIKE '%right upper lobe%' THEN 'RUL' WHEN text LIKE '%lower lobe of the left%' THEN 'LLL' END AS lobe, in_scope AND NOT is_outside AS kept FROM x), "
    "g AS (SELECT study, CASE WHEN coalesce(bool_or(kept AND assertion='present' AND concept IN ('nodule','mass')),false) THEN 'true' WHEN coalesce(bool_or(kept AND assertion='absent' AND concept IN ('nodule','mass')),false) THEN 'false' ELSE 'not_assessable' END AS nodule, array_to_string(list_sort(list(DISTINCT lobe) FILTER (WHERE kept AND lobe IS NOT NULL)),',') AS lobes, bool_or(kept AND assertion='present' AND concept='granuloma') AS benign_evidence, count(*) FILTER (WHERE kept) AS n_evidence, bool_or(kept AND text LIKE '%solid%') AS kind_available, bool_or(size_mm IS NOT NULL) AS size_available, bool_or(NOT kept AND assertion='present' AND concept IN ('mass','metastasis') AND (bucket='other_organ' OR is_outside)) AS qf_outside, bool_or(NOT kept AND assertion='present' AND concept IN ('mass','metastasis') AND bucket IN ('unknown','meta')) AS qf_unknown, bool_or(kept AND assertion='present' AND bucket='mediastinum') AS qf_mediastinum FROM lob GROUP BY 1), "
    "lv AS (SELECT study, CASE WHEN bool_or(concept='metastasis' AND assertion='present') THEN 'high' WHEN bool_or(concept='mass' AND assertion='present') THEN 'intermediate' END AS level FROM lob WHERE kept GROUP BY 1), se AS (SELECT o_orderkey AS study, o_orderstatus='P' AS placeholder FROM orders) "
    "SELECT se.study, placeholder, coalesce(nodule,'not_assessable') AS nodule, coalesce(lobes,'') AS lobes, coalesce(level,'not_mentioned') AS level, coalesce(n_evidence,0) AS n_evidence, coalesce(benign_evidence,false) AS benign_evidence, coalesce(kind_available,false) AS kind_available, coalesce(size_available,false) AS size_available, coalesce(qf_outside,false) AS qf_outside, coalesce(qf_unknown,false) AS qf_unknown, coalesce(qf_mediastinum,false) AS qf_mediastinum, coalesce(n_evidence,0)=0 AS qf_no_section FROM se LEFT JOIN g USING (study) LEFT JOIN lv USING (study)",
)
def _(spark, d):
    ent = _ent(spark, d)
    rel = _rel(ent)
    away = findings.outside_region(ent, rel, ["liver"], ["lung"], "(?i)pulmonar|lung").withColumn("is_outside", F.lit(True))
    x = findings.with_size(ent, rel).join(away, "entity_id", "left").withColumns({"is_outside": F.coalesce("is_outside", F.lit(False)), "in_scope": (F.col("f") != "N") | (F.col("section") == "findings"), "bucket": _pick(BUCKETS, F.col("entity_id") % 4)})
    level = classify.decide([((F.col("concept") == "metastasis") & (F.col("assertion") == "present"), "high", "spread", True), ((F.col("concept") == "mass") & (F.col("assertion") == "present"), "intermediate", "mass", True)])
    found = x.where("in_scope and not is_outside").select("study", "entity_id", level.alias("d")).where("d is not null").select("study", "entity_id", "d.*")
    series = t(spark, d, "orders").select(F.col("o_orderkey").alias("study"), (F.col("o_orderstatus") == "P").alias("placeholder"))
    out = findings.summary(x, series, classify.roll_up(found, "study", "entity_id"), ["nodule", "mass"], ["granuloma"], ["mass", "metastasis"], "(?i)solid")
    return out.drop("source").withColumn("lobes", F.array_join("lobes", ","))


@query(
    "cls_axes",
    f"{_ENT}, ev AS (SELECT study, concept IN ('mass','metastasis') AS mal, f<>'N' AS here, text NOT LIKE 'history%' AS now, assertion='absent' AS negated, assertion='uncertain' AS hedged, rule='inference:possible' AS suspicious, rule='inference:favours' AS benign FROM ent WHERE kind='observation'), g AS (SELECT study, bool_or(here AND NOT negated AND mal AND now AND NOT hedged) AS sure, bool_or(here AND NOT negated AND mal AND now) AS current, bool_or(here AND NOT negated AND mal) AS malignancy, bool_or(here AND NOT negated AND NOT mal AND suspicious) AS suspicious, bool_or(here AND NOT negated AND NOT mal AND NOT benign) AS open_nodule, bool_or(here AND NOT negated AND NOT mal) AS nodule, bool_or(negated) AS negated FROM ev GROUP BY 1) "
    "SELECT study, CASE WHEN sure THEN 'high' WHEN current THEN 'intermediate' WHEN malignancy THEN 'known_malignancy' WHEN suspicious THEN 'intermediate' WHEN open_nodule THEN 'indeterminate' WHEN nodule THEN 'low' WHEN negated THEN 'none' ELSE 'not_mentioned' END AS axis_a, concat_ws(',', "
    + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in ("sure", "current", "malignancy", "suspicious", "open_nodule", "nodule", "negated"))
    + ") AS axis_b FROM g",
)
def _(spark, d):
    c, a = F.col("concept"), F.col("assertion")
    ev = _ent(spark, d).where("kind = 'observation'").select(
        "study", F.when(c.isin("mass", "metastasis"), "malignancy").otherwise("nodule").alias("kind"), F.when(F.col("f") != "N", "lung").otherwise("outside").alias("region"), F.when(F.col("text").startswith("history"), "history").otherwise("current").alias("time"),
        (a == "absent").alias("negated"), (a == "uncertain").alias("hedged"), (F.col("rule") == "inference:possible").alias("suspicious"), (F.col("rule") == "inference:favours").alias("benign"),
    )
    return findings.axes(ev, ["lung"]).withColumn("axis_b", F.array_join("axis_b", ","))


@query("cls_coverage", "SELECT 'numbers' AS grp, count(*) FILTER (WHERE regexp_matches(text,'[0-9]')) AS n_rows, count(DISTINCT source) FILTER (WHERE regexp_matches(text,'[0-9]')) AS n_keys FROM documents UNION ALL SELECT 'marks', count(*) FILTER (WHERE regexp_matches(text,'[|%#]')), count(DISTINCT source) FILTER (WHERE regexp_matches(text,'[|%#]')) FROM documents")
def _(spark, d):
    return findings.coverage(t(spark, d, "documents"), {"numbers": "[0-9]", "marks": "[|%#]"}, "text", "source")


@query("cls_pattern_diff", "SELECT * FROM (SELECT CASE WHEN a AND b THEN 'kept' WHEN a THEN 'lost' WHEN b THEN 'gained' END AS change, count(*) AS n, min(doc_id) AS example FROM (SELECT doc_id, regexp_matches(text,'[0-9]{3}') AS a, regexp_matches(text,'[0-9][.0-9]{4}|[|]') AS b FROM documents) GROUP BY 1) WHERE change IS NOT NULL")
def _(spark, d):
    return findings.pattern_diff(t(spark, d, "documents"), "[0-9]{3}", "[0-9][.0-9]{4}|[|]", "text", "doc_id")


_LEVELLED = ", lv AS (SELECT study, count(*) FILTER (WHERE kind='observation') AS n, bool_or(assertion='uncertain') AS hedged, bool_or(f='A') AS stock, CASE WHEN bool_or(concept='metastasis' AND assertion='present') THEN 'high' WHEN bool_or(concept='mass' AND assertion='present') THEN 'intermediate' END AS found FROM ent GROUP BY 1)"


def _levelled(ent):
    said = lambda c: F.bool_or((F.col("concept") == c) & (F.col("assertion") == "present"))
    found = F.when(said("metastasis"), "high").when(said("mass"), "intermediate")
    return ent.groupBy("study").agg(F.count_if(F.col("kind") == "observation").alias("n"), F.bool_or(F.col("assertion") == "uncertain").alias("hedged"), F.bool_or(F.col("f") == "A").alias("stock"), found.alias("found"))


@query("cls_mismatch_causes", f"{_ENT}{_LEVELLED} SELECT cause, count(*) AS studies FROM (SELECT CASE WHEN found IS NOT DISTINCT FROM expected THEN NULL WHEN n=0 THEN 'no_finding' WHEN stock THEN 'stock_sentence' WHEN hedged THEN 'hedge' WHEN found IS NULL THEN 'rule_without_level' ELSE 'threshold' END AS cause FROM (SELECT lv.*, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '2%' THEN 'intermediate' END AS expected FROM lv JOIN orders ON study=o_orderkey)) GROUP BY 1")
def _(spark, d):
    expected = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "intermediate")
    x = _levelled(_ent(spark, d)).join(t(spark, d, "orders").select(F.col("o_orderkey").alias("study"), expected.alias("expected")), "study")
    cause = findings.mismatch_cause(*(F.col(c) for c in ("found", "expected", "n", "hedged", "stock")))
    return x.groupBy(cause.alias("cause")).agg(F.count("*").alias("studies"))


_DECIDED = "CASE WHEN {a}='absent' THEN 'none' WHEN {r}='inference:possible' THEN 'low' WHEN concept IN ('mass','metastasis') THEN 'high' ELSE 'intermediate' END"


@query(
    "cls_scenarios",
    f"{_ENT}, s AS (SELECT 'as_is' AS scenario, {_DECIDED.format(a='assertion', r='rule')} AS level, {_DECIDED.format(a='assertion', r='rule')} AS base FROM ent UNION ALL SELECT 'no_hedges', {_DECIDED.format(a='assertion', r=chr(39) + 'default' + chr(39))}, {_DECIDED.format(a='assertion', r='rule')} FROM ent UNION ALL SELECT 'all_present', {_DECIDED.format(a=chr(39) + 'present' + chr(39), r='rule')}, {_DECIDED.format(a='assertion', r='rule')} FROM ent) SELECT scenario, level, count(*) AS n, count(*) FILTER (WHERE level<>base) AS changed FROM s GROUP BY 1,2",
)
def _(spark, d):
    level = F.when(F.col("assertion") == "absent", "none").when(F.col("rule") == "inference:possible", "low").when(F.col("concept").isin("mass", "metastasis"), "high").otherwise("intermediate")
    return findings.scenarios(_ent(spark, d), {"no_hedges": {"rule": F.lit("default")}, "all_present": {"assertion": F.lit("present")}}, level, "entity_id")


@query("cls_what_if", f"{_ENT}{_LEVELLED}, b AS (SELECT study, CASE WHEN bool_or(concept IN ('metastasis','nodule') AND assertion='present') THEN 'high' WHEN bool_or(concept='mass' AND assertion='present') THEN 'intermediate' END AS found FROM ent GROUP BY 1) SELECT lv.found AS from_level, b.found AS to_level, count(*) AS n FROM lv JOIN b USING (study) WHERE lv.found IS DISTINCT FROM b.found GROUP BY 1,2")
def _(spark, d):
    ent = _ent(spark, d)
    wider = ent.withColumn("concept", F.when(F.col("concept") == "nodule", "metastasis").otherwise(F.col("concept")))
    return findings.transitions(_levelled(ent), _levelled(wider), "study", "found")


@query("cls_tiers", f"{_ENT} SELECT c.concept, count(e.entity_id) AS support, CASE WHEN count(e.entity_id)=0 THEN 'B' ELSE 'A' END AS tier FROM (SELECT unnest({_listed([*CONCEPTS, 'cyst'])}) AS concept) c LEFT JOIN ent e ON e.concept=c.concept AND e.assertion='present' GROUP BY 1")
def _(spark, d):
    inventory = spark.createDataFrame([(c,) for c in [*CONCEPTS, "cyst"]], "concept string")
    return findings.tiers(inventory, _ent(spark, d).where("assertion = 'present'"))


@query("cls_sentence_gap", f"{_ENT}, s AS (SELECT DISTINCT study, section, sent_idx, text FROM ent), h AS (SELECT study, section, sent_idx, 'nodule' AS concept FROM s WHERE regexp_matches(text,'nodule') UNION ALL SELECT study, section, sent_idx, 'lung' FROM s WHERE regexp_matches(text,'lung|lobe')) SELECT concept, count(*) AS n, count(*) FILTER (WHERE NOT has) AS missed, round(count(*) FILTER (WHERE NOT has)/count(*)::double,9) AS share FROM (SELECT h.*, EXISTS (SELECT 1 FROM ent e WHERE e.study=h.study AND e.section=h.section AND e.sent_idx=h.sent_idx AND e.concept=h.concept) AS has FROM h) GROUP BY 1")
def _(spark, d):
    ent = _ent(spark, d)
    return findings.gap(ent.select(*findings.SENTENCE, "text").distinct(), ent, {"nodule": "nodule", "lung": "lung|lobe"}).withColumn("share", F.round("share", 9))


@query(
    "gate_entities",
    f"{_ENT}, sen AS (SELECT study, section, sent_idx, min(char_start)+1 AS a, max(char_end) AS b FROM ent WHERE f<>'N' GROUP BY 1,2,3) "
    "SELECT 'K1 text' AS rule, count(*) FILTER (WHERE substr(text, char_start+1, greatest(char_end-char_start,0)) <> raw_text) AS violations FROM ent UNION ALL SELECT 'K1c in sentence', count(*) FILTER (WHERE a IS NULL OR char_start<a OR char_end>b) FROM ent LEFT JOIN sen USING (study, section, sent_idx) UNION ALL SELECT 'K3e group values', count(DISTINCT (concept, f)) FILTER (WHERE kind='qualifier' AND NOT ((f='A' AND concept='spiculated') OR (f='R' AND concept='calcified')) AND f IN ('A','R')) FROM ent "
    "UNION ALL SELECT 'K3f assertion cue', count(*) FILTER (WHERE assertion IN ('absent','uncertain') AND cue IS NULL) FROM ent UNION ALL SELECT 'K3g change cue', count(*) FILTER (WHERE change IN ('increased','decreased') AND cue IS NULL) FROM ent",
)
def _(spark, d):
    ent = _ent(spark, d)
    sentences = ent.where("f <> 'N'").groupBy(*findings.SENTENCE).agg((F.min("char_start") + 1).alias("s_start"), F.max("char_end").alias("s_end"))
    groups = spark.createDataFrame([("A", "spiculated"), ("R", "calcified")], "grp string, concept string")
    rows = gates.row_rules(ent, {"K1 text": gates.off_text("text", "raw_text", "char_start", "char_end"), "K3f assertion cue": gates.needs_cue("assertion", ["absent", "uncertain"], "cue"), "K3g change cue": gates.needs_cue("change", ["increased", "decreased"], "cue")})
    return gates.all_rules(rows, gates.inside(ent, sentences, findings.SENTENCE, "K1c in sentence"), gates.in_group(ent.where("kind = 'qualifier'").withColumnRenamed("f", "grp"), groups, "grp", "concept", "K3e group values"))


@query(
    "gate_edges",
    f"{_ENT}, e AS (SELECT rel.study, relation_type, rel.study + (head_id%7=0)::int AS own, h.kind AS hk, h.study AS hs, x.kind AS tk, x.study AS ts FROM rel LEFT JOIN ent h ON h.entity_id=head_id LEFT JOIN (SELECT * FROM ent WHERE f<>'R') x ON x.entity_id=tail_id), k AS (SELECT *, hk IS NULL OR tk IS NULL AS lost FROM e) "
    "SELECT 'K2 ends' AS rule, count(*) FILTER (WHERE lost) AS violations FROM k UNION ALL SELECT 'K2b types', count(*) FILTER (WHERE NOT lost AND (relation_type,hk,tk) NOT IN (('modify','qualifier','observation'),('modify','qualifier','anatomy'),('located_at','observation','anatomy'))) FROM k WHERE relation_type IN ('modify','located_at') UNION ALL SELECT 'K2c one study', count(*) FILTER (WHERE NOT lost AND (hs<>ts OR hs<>own)) FROM k",
)
def _(spark, d):
    ent = _ent(spark, d)
    rel = _rel(ent).withColumn("study", F.col("study") + (F.col("head_id") % 7 == 0).cast("int"))
    types = spark.createDataFrame([("modify", "qualifier", "observation"), ("modify", "qualifier", "anatomy"), ("located_at", "observation", "anatomy")], "relation_type string, head_kind string, tail_kind string")
    heads, tails = ent.select(F.col("entity_id").alias("id"), "kind", "study"), ent.where("f <> 'R'").select(F.col("entity_id").alias("id"), "kind", "study")
    return gates.edges(rel, heads, tails, types)


@query(
    "gate_invariants",
    f"{_ENT}, s AS (SELECT study, section, sent_idx, bool_or(rule='inference:possible') AS technical, bool_or(f='A') AS negated, bool_or(text LIKE 'no %') AS coordinated, bool_or(assertion='absent') AS some_absent, count(*) FILTER (WHERE kind='observation') AS n_obs, (list(assertion ORDER BY char_start, entity_id) FILTER (WHERE kind='observation'))[2] AS second FROM ent GROUP BY 1,2,3) "
    "SELECT * FROM (SELECT 'K11' AS rule, count(*) FILTER (WHERE change='stable') AS n, count(*) FILTER (WHERE change='stable' AND assertion='absent') AS violations FROM ent UNION ALL SELECT 'K12', count(*), count(*) FILTER (WHERE assertion='absent') FROM ent JOIN s USING (study, section, sent_idx) WHERE technical AND NOT negated UNION ALL SELECT 'K13', count(*), count(*) FILTER (WHERE second<>'absent') FROM s WHERE coordinated AND n_obs>=2 UNION ALL SELECT 'K14', count(*) FILTER (WHERE assertion<>'present'), count(*) FILTER (WHERE assertion<>'present' AND cue IS NULL) FROM ent UNION ALL SELECT 'K15', count(*), count(*) FILTER (WHERE NOT some_absent) FROM s WHERE negated AND NOT technical)",
)
def _(spark, d):
    ent = _ent(spark, d).withColumn("covered", F.col("change") == "stable")
    sentences = ent.groupBy(*findings.SENTENCE).agg(F.bool_or(F.col("rule") == "inference:possible").alias("technical"), F.bool_or(F.col("f") == "A").alias("negated"), F.bool_or(F.col("text").startswith("no ")).alias("coordinated"))
    sentences = sentences.withColumn("backward_only", F.col("negated") & ~F.col("technical"))
    return gates.invariants(ent, sentences, findings.SENTENCE).select("rule", "n", "violations")


@query("gate_distribution", "SELECT 'click' AS value, round(count(*) FILTER (WHERE event_type='click')/count(*)::double,9) AS share, count(*) FILTER (WHERE event_type='click')/count(*)::double BETWEEN 0.1 AND 0.2 AS accepted FROM events")
def _(spark, d):
    return gates.share_within(t(spark, d, "events"), "event_type", "click", 0.1, 0.2).withColumn("share", F.round("share", 9))


@query(
    "gate_package",
    "WITH p AS (SELECT conv_id AS doc, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + (conv_id%5=0)::int AS span_order, dense_rank() OVER (ORDER BY conv_id) + (conv_id%7=0)::int AS doc_order FROM conversations), d AS (SELECT doc, min(doc_order) AS o, max(doc_order) AS o2 FROM p GROUP BY 1) "
    "SELECT 'document order' AS rule, (SELECT count(*) FILTER (WHERE o<>o2) FROM d) + (SELECT count(*) FROM (SELECT o, lag(o) OVER (ORDER BY o, doc) AS b FROM d) WHERE o <> coalesce(b,0)+1) AS violations UNION ALL SELECT 'span order', count(*) FROM (SELECT span_order, lag(span_order) OVER (PARTITION BY doc ORDER BY span_order, turn) AS b FROM p) WHERE span_order <> coalesce(b,0)+1",
)
def _(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn")
    docs = c.select("doc").distinct().select("doc", F.row_number().over(W.orderBy("doc")).alias("k"))  # a package is small by nature
    p = c.join(docs, "doc").select("doc", "turn", (F.row_number().over(W.partitionBy("doc").orderBy("turn")) + (F.col("doc") % 5 == 0).cast("int")).alias("span_order"), (F.col("k") + (F.col("doc") % 7 == 0).cast("int")).alias("doc_order"))
    return gates.ordered_package(p, "doc", "turn", "doc_order", "span_order")


@query(
    "gate_annotations",
    "WITH b AS (SELECT conv_id AS doc, turn, role FROM conversations), a AS (SELECT conv_id AS doc, turn, CASE WHEN conv_id%9=0 THEN 'x' ELSE role END AS role FROM conversations WHERE conv_id%11<>0 UNION ALL SELECT conv_id, turn+1000, role FROM conversations WHERE conv_id%13=0) SELECT rule, n AS violations FROM (SELECT count(*) FILTER (WHERE a.doc IS NULL) AS missing, count(*) FILTER (WHERE b.doc IS NULL) AS extra, count(*) FILTER (WHERE a.doc IS NOT NULL AND b.doc IS NOT NULL AND a.role IS DISTINCT FROM b.role) AS changed, 0::bigint AS repeated FROM a FULL JOIN b ON a.doc=b.doc AND a.turn=b.turn) UNPIVOT (n FOR rule IN (missing, extra, changed, repeated))",
)
def _(spark, d):
    b = t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role")
    a = b.where("doc % 11 <> 0").withColumn("role", F.when(F.col("doc") % 9 == 0, "x").otherwise(F.col("role"))).union(b.where("doc % 13 = 0").withColumn("turn", F.col("turn") + 1000))
    return gates.annotated(a, b, ["doc", "turn"], ["role"])


@query("gate_arms", "WITH a AS (SELECT event_id AS id, event_type AS arm, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS pos FROM events), b AS (SELECT pos, count(*) AS n, count(DISTINCT id%3) AS ids FROM a GROUP BY 1) SELECT count(*) AS positions, count(*) FILTER (WHERE n <> (SELECT count(DISTINCT arm) FROM a)) AS incomplete, count(*) FILTER (WHERE ids > 1) AS different FROM b")
def _(spark, d):
    x = t(spark, d, "events").select(F.col("event_type").alias("arm"), (F.col("event_id") % 3).alias("id"), "value", "event_id")
    return gates.same_order(x, "arm", "id", ["value", "event_id"])


@query("gate_stop", "SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS violations, count(*) >= 8 AND count(*) FILTER (WHERE bad) >= 0.6*count(*) AS stop FROM (SELECT value > 60 AS bad FROM events ORDER BY ts, event_id LIMIT 8)")
def _(spark, d):
    return gates.early_stop(t(spark, d, "events"), F.col("value") > 60, ["ts", "event_id"])


@query("cls_first_assertion", f"{_ENT} SELECT study, concept, arg_min(assertion,(section='impression',sent_idx,char_start,entity_id)) AS assertion, count(*) AS n FROM ent GROUP BY 1,2")
def _(spark, d):
    return findings.first_assertion(_ent(spark, d))


@query("cls_prefilter", f"{_ENT} SELECT count(*)::bigint AS n, 0::bigint AS lost, 0::bigint AS changed FROM (SELECT DISTINCT study, section, sent_idx FROM ent WHERE (concept IN ('granuloma','calcified') AND assertion='present' AND rule='inference:favours') OR regexp_matches(text,'(?i)possibly benign'))")
def _(spark, d):
    run = lambda ent: findings.definite_benign(ent, ["granuloma", "calcified"], ["inference:favours"], "(?i)possibly benign")
    keep = F.col("concept").isin("granuloma", "calcified") | F.col("text").contains("benign")
    return findings.preserved(_ent(spark, d), keep, run)


@query("gate_documented", "SELECT 'K16 decisions' AS rule, count(*) FILTER (WHERE p_size%4=0) AS violations FROM part UNION ALL SELECT 'K0 columns', 2")
def _(spark, d):
    p = t(spark, d, "part").select("p_name", F.when(F.col("p_size") % 4 != 0, "kept").otherwise(" ").alias("note"))
    return gates.all_rules(gates.documented(p, "note"), gates.schema_rules(p, ["p_name", "concept", "kind"]))


_REPORTS = ["No nodule in the lung ; history of a mass in the liver.", "Possible mass near the lung . Benign nodule, calcified", "nodule but not suspicious; nodule suspicious for mass", "clear lungs", ""]
_EVIDENCE = [
    (0, 0, "nodule", "lung", "current", True, False, False, False), (0, 1, "mass", "liver", "history", False, False, False, False), (1, 0, "mass", "lung", "current", False, False, True, False), (1, 1, "nodule", "unknown", "current", False, True, False, False),
    (2, 0, "nodule", "unknown", "current", False, False, False, False), (2, 1, "nodule", "unknown", "current", False, False, False, True), (2, 1, "mass", "unknown", "current", False, False, False, True),
]


@query("cls_evidence", "SELECT p_partkey, sent_idx, kind, region, time, negated, benign, hedged, suspicious FROM part JOIN (VALUES " + ", ".join(str(x).replace("True", "true").replace("False", "false") for x in _EVIDENCE) + ") v(k, sent_idx, kind, region, time, negated, benign, hedged, suspicious) ON p_partkey%5=k")
def _(spark, d):
    from ..session import ship
    from ..text.evidence import EvidenceLexicon, evidence

    ship(spark)
    lexicon = EvidenceLexicon({"nodule": "nodules?", "mass": "mass(?:es)?"}, {"lung": "lungs?", "liver": "liver"}, {"history": "history"}, r"\b(?:no|not)\b", r"\bbut\b", "benign", "possible", "suspicious", "spread")
    report = F.element_at(F.array(*map(F.lit, _REPORTS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    x = t(spark, d, "part").select("p_partkey", F.explode(evidence(lexicon)(report)).alias("e"))
    return x.select("p_partkey", *(F.col(f"e.{c}").alias(c) for c in ("sent_idx", "kind", "region", "time", "negated", "benign", "hedged", "suspicious")))
