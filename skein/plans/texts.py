"""Queries of small text rules: splitters, negation, signatures, rewriting checks, matches, sections, measurements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalogue import query
from ..session import ship
from ..session import table as t
from ..text import surface as s

_SPLIT = "list_filter(list_transform(string_split({0}, chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_AFTER = _SPLIT.format("regexp_replace({0}, '([{1}])\\s+', '\\1' || chr(1), 'g')")
_SPACED = _SPLIT.format("regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' \\. |\\.$|;', chr(1), 'g')")
_GLUED = _SPLIT.format("regexp_replace(regexp_replace(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '([a-z0-9][.])([A-Z])', '\\1' || chr(1) || '\\2', 'g'), ';|\\n+', chr(1), 'g')")


@query(
    "txt_splitters",
    "SELECT doc_id, " + ", ".join(f"len({e.format('text', '.')}) AS n_{k}, md5(array_to_string({e.format('text', '.')}, '|')) AS h_{k}" for k, e in (("naive", _AFTER), ("spaced", _SPACED), ("glued", _GLUED))) + f", len({_AFTER.format('text', '.;')}) AS n_semicolon FROM documents",
)
def _(spark, d):
    x = F.col("text")
    out = t(spark, d, "documents").select("doc_id", s.split_after(x, ".").alias("naive"), s.split_spaced(x).alias("spaced"), s.split_glued(x).alias("glued"), s.split_after(x, ".;").alias("semicolon"))
    kinds = ("naive", "spaced", "glued")
    return out.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in (*kinds, "semicolon")), *(F.md5(F.array_join(k, "|").cast("binary")).alias(f"h_{k}") for k in kinds))


@query("txt_around", "SELECT doc_id, trim(regexp_extract(substr(text,1,(n_chars//2)::int),'([^.;]*)$',1) || substr(text,(n_chars//2)::int+1,5) || regexp_extract(substr(text,(n_chars//2)::int+6),'^([^.;]*)',1)) AS around FROM documents")
def _(spark, d):
    at = F.floor(F.col("n_chars") / 2).cast("int")
    return t(spark, d, "documents").select("doc_id", s.around(F.col("text"), at, at + 5).alias("around"))


@query("txt_token_spans", "SELECT item_id, array_to_string(string_split(text,' ')[(item_id%4)::int+1:(item_id%4)::int+3],' ') AS span FROM benchmark")
def _(spark, d):
    first = (F.col("item_id") % 4).cast("int")
    return t(spark, d, "benchmark").select("item_id", s.token_span(F.col("text"), first, first + 2).alias("span"))


@query("txt_keyword_sentences", f"SELECT item_id, list_filter({_AFTER.format('text', '.!?')}, lambda x: contains(lower(x),'wh'))[1] AS sentence FROM benchmark")
def _(spark, d):
    return t(spark, d, "benchmark").select("item_id", s.keyword_sentence(F.col("text"), "Wh").alias("sentence"))


@query("txt_placeholders", "SELECT p_partkey, regexp_matches(note, '(?i)\\[[^\\]]{2,60}\\]|not visible|not given|placeholder') AS placeholder FROM (SELECT p_partkey, p_name || (['',' [to be filled]',' Not given',' []'])[p_partkey%4+1] AS note FROM part)")
def _(spark, d):
    note = F.concat("p_name", F.element_at(F.array(*map(F.lit, ["", " [to be filled]", " Not given", " []"])), (F.col("p_partkey") % 4 + 1).cast("int")))
    return t(spark, d, "part").select("p_partkey", s.placeholder(note).alias("placeholder"))


_TERM, _NEGATION, _BREAKER, _BEHIND = "thin|eau|zu", "the|de|der", "and|la|und", "\\s+of"
_PRESENT = f"len(list_filter(string_split_regex(text,'[.;]'), lambda x: regexp_matches(x,'(?i)(?:{_TERM})') AND NOT (regexp_matches(regexp_extract(x,'(?is)^(.*?)(?:{_TERM})(.*)$',1),'(?i)(?:{_NEGATION})') AND NOT regexp_matches(regexp_extract(regexp_extract(x,'(?is)^(.*?)(?:{_TERM})(.*)$',1),'(?is)^.*(?:{_NEGATION})(.*)$',1),'(?i)(?:{_BREAKER})') AND length(regexp_extract(regexp_extract(x,'(?is)^(.*?)(?:{_TERM})(.*)$',1),'(?is)^.*(?:{_NEGATION})(.*)$',1)) <= 110) AND NOT regexp_matches(substr(regexp_extract(x,'(?is)^(.*?)(?:{_TERM})(.*)$',2),1,40),'(?i)^(?:{_BEHIND})'))) > 0"


@query("txt_finding_present", f"SELECT item_id, {_PRESENT} AS present FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT conv_id*1000+turn+100000, text FROM conversations)")
def _(spark, d):
    x = t(spark, d, "benchmark").select("item_id", "text").union(t(spark, d, "conversations").select(F.col("conv_id") * 1000 + F.col("turn") + 100000, "text"))
    return x.select("item_id", s.finding_present(F.col("text"), _TERM, _NEGATION, _BREAKER, _BEHIND).alias("present"))


@query("txt_time_class", "SELECT doc_id, CASE WHEN regexp_matches(text,'[0-9]{4}') THEN 'dated' WHEN regexp_matches(text,'(?i)licen[sc]e|token') THEN 'technical' WHEN regexp_matches(text,'[!?]') THEN 'spoken' ELSE 'plain' END AS class FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", s.ordered_class(F.col("text"), [("dated", "[0-9]{4}"), ("technical", "(?i)licen[sc]e|token"), ("spoken", "[!?]")], "plain").alias("class"))


@query("txt_label_collapse", "SELECT l_orderkey, CASE WHEN list_contains(tags,'A') THEN 'A' WHEN len(tags)=1 THEN tags[1] WHEN len(tags)>1 THEN 'several' ELSE 'unstated' END AS label FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag) FILTER (WHERE l_quantity > 25)) AS tags FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity > 25) > 0 UNION ALL SELECT l_orderkey, [] FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_quantity > 25) = 0)")
def _(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))).alias("tags"))
    return x.select("l_orderkey", s.collapsed(F.col("tags"), "A").alias("label"))


_STOP = ["the", "of", "and", "that", "in"]
_GRAMS = "list_distinct(list_transform(list_filter(flatten(list_transform([1,2,3], lambda n: list_transform(range(1, len(w)-n+2), lambda i: w[i:i+n-1]))), lambda g: length(g[1]) >= 3 AND len(list_filter(g, lambda v: NOT list_contains(['the','of','and','that','in'], v))) > 0), lambda g: array_to_string(g,' ')))"
_WORDS = "list_filter(string_split_regex(lower(text),'[^\\p{L}\\p{N}]+'), lambda v: v <> '')"


@query("txt_word_ngrams", f"SELECT item_id, len(g) AS n, md5(array_to_string(list_sort(g),'|')) AS h FROM (SELECT item_id, {_GRAMS} AS g FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))")
def _(spark, d):
    g = t(spark, d, "benchmark").select("item_id", s.ngrams(F.col("text"), _STOP).alias("g"))
    return g.select("item_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|").cast("binary")).alias("h"))


@query(
    "txt_gap_ngrams",
    f"WITH g AS (SELECT quality, unnest({_GRAMS}) AS gram FROM (SELECT quality, {_WORDS} AS w FROM documents JOIN labels USING (doc_id))) SELECT gram, count(*) FILTER (WHERE quality=0) AS support, count(*) FILTER (WHERE quality=1) AS noise FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE quality=0) >= 3 AND count(*) FILTER (WHERE quality=1) = 0",
)
def _(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text").join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    g = x.select("quality", F.explode(s.ngrams(F.col("text"), _STOP)).alias("gram"))
    return g.groupBy("gram").agg(F.count_if(F.col("quality") == 0).alias("support"), F.count_if(F.col("quality") == 1).alias("noise")).where("support >= 3 and noise = 0")


@query("txt_cue_direction", "WITH x AS (SELECT length(regexp_extract(text,'(?is)^(.*?)\\b(?:the)',1))::double/greatest(length(text),1) AS pos FROM benchmark WHERE regexp_matches(text,'(?i)\\b(?:the)')), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE pos>0.6) AS at_end, count(*) FILTER (WHERE pos<0.3) AS at_start FROM x) SELECT *, CASE WHEN at_end/n>0.7 THEN 'backward' WHEN at_start/n>0.7 THEN 'forward' ELSE 'both' END AS direction FROM n")
def _(spark, d):
    return s.cue_direction(t(spark, d, "benchmark"), "text", "the")


_PAIRS = "pairs AS (SELECT p_partkey, p_size || ' mm ' || p_name || ', ' || (p_partkey%7) || ' cm' AS source, CASE p_partkey%6 WHEN 0 THEN p_size || ' mm ' || p_name || ', ' || (p_partkey%7) || ' cm' WHEN 1 THEN p_size || ' cm ' || p_name || ', ' || (p_partkey%7) || ' cm' WHEN 2 THEN p_name || ', ' || (p_partkey%7) || ' cm' WHEN 3 THEN p_size || ' mm ' || p_name || ', ' || (p_partkey%7) || ' cm, 3,5 of 90' WHEN 4 THEN '** ' || (p_size*10) || ' cm ' || p_brand ELSE 'Here is ' || (p_size+1) || ' mm' END AS target FROM part)"


def _pairs(spark, d):
    z, k, n = F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"), F.col("p_name")
    m = F.col("p_partkey") % 6
    source = F.concat(z, F.lit(" mm "), n, F.lit(", "), k, F.lit(" cm"))
    target = (
        F.when(m == 0, source).when(m == 1, F.concat(z, F.lit(" cm "), n, F.lit(", "), k, F.lit(" cm"))).when(m == 2, F.concat(n, F.lit(", "), k, F.lit(" cm"))).when(m == 3, F.concat(source, F.lit(", 3,5 of 90")))
        .when(m == 4, F.concat(F.lit("** "), (F.col("p_size") * 10).cast("string"), F.lit(" cm "), F.col("p_brand"))).otherwise(F.concat(F.lit("Here is "), (F.col("p_size") + 1).cast("string"), F.lit(" mm")))
    )
    return t(spark, d, "part").select("p_partkey", source.alias("source"), target.alias("target"))


@query("txt_term_audit", f"WITH {_PAIRS}, x AS (SELECT 'widget' AS term, target FROM pairs WHERE regexp_matches(source,'widget') UNION ALL SELECT 'size', target FROM pairs WHERE regexp_matches(source,'mm')), v AS (SELECT term, CASE WHEN term='widget' THEN CASE WHEN regexp_matches(target,'(?i)widget') THEN 'correct' WHEN regexp_matches(target,'(?i)brand') THEN 'corrupted' ELSE 'missing' END ELSE CASE WHEN regexp_matches(target,'(?i) mm') THEN 'correct' WHEN regexp_matches(target,'(?i)\\*\\*') THEN 'residual' WHEN regexp_matches(target,'(?i)cm') THEN 'corrupted' ELSE 'missing' END END AS k FROM x) SELECT term, count(*) AS n, count(*) FILTER (WHERE k='correct') AS correct, count(*) FILTER (WHERE k='residual') AS residual, count(*) FILTER (WHERE k='corrupted') AS corrupted, count(*) FILTER (WHERE k='missing') AS missing FROM v GROUP BY 1")
def _(spark, d):
    return s.term_audit(_pairs(spark, d), [("widget", "widget", "widget", None, "brand"), ("size", "mm", " mm", r"\*\*", "cm")])


_NUMBERS = "list_transform(regexp_extract_all({0},'[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x,',','.'))"
_UNITS = "list_transform(regexp_extract_all({0},'(?i)[0-9]\\s*(mm2|cm2|mm3|cm3|mm|cm|ml|cc|mg|kg|hu|msv|kvp|mas|m|g|%)(?:[^A-Za-z0-9]|$)',1), lambda x: lower(x))"


def _diff_sql(signature: str, name: str) -> str:
    one = "SELECT p_partkey, unnest({0}) AS v, {1} AS n FROM pairs"
    return f"{name}_o AS (SELECT p_partkey, v, sum(n) AS n FROM ({one.format(signature.format('source'), 1)} UNION ALL {one.format(signature.format('target'), -1)}) GROUP BY 1,2), {name} AS (SELECT p_partkey, list_sort(flatten(list(list_transform(range(n::int), lambda i: v)) FILTER (WHERE n>0))) AS dropped, list_sort(flatten(list(list_transform(range((-n)::int), lambda i: v)) FILTER (WHERE n<0))) AS added FROM {name}_o WHERE n<>0 GROUP BY 1)"


_CHANGED = f"WITH {_PAIRS}, {_diff_sql(_NUMBERS, 'nu')}, {_diff_sql(_UNITS, 'un')}, x AS (SELECT p.p_partkey, coalesce(nu.dropped,[]::varchar[]) AS dn, coalesce(nu.added,[]::varchar[]) AS an, coalesce(un.dropped,[]::varchar[]) AS du, coalesce(un.added,[]::varchar[]) AS au FROM pairs p LEFT JOIN nu USING (p_partkey) LEFT JOIN un USING (p_partkey))"


@query(
    "txt_signature_diff",
    _CHANGED + " SELECT p_partkey, array_to_string(dn,',') AS dropped, array_to_string(an,',') AS added, array_to_string(du,',') AS dropped_units, array_to_string(au,',') AS added_units, CASE WHEN len(dn)+len(an)+len(du)+len(au)=0 THEN 'clean' WHEN len(dn)+len(an)=0 THEN 'unit_only' WHEN len(dn)>0 AND len(an)=0 AND len(au)=0 THEN 'dropped' WHEN len(an)>0 AND len(dn)=0 THEN 'invented' WHEN (list_contains(du,'mm') AND list_contains(au,'cm')) OR (list_contains(du,'cm') AND list_contains(au,'mm')) THEN 'converted' ELSE 'changed' END AS class FROM x",
)
def _(spark, d):
    p = _pairs(spark, d)
    n, u = s.signature_diff(p, "p_partkey", "source", "target", s.numbers), s.signature_diff(p, "p_partkey", "source", "target", s.units).toDF("p_partkey", "dropped_units", "added_units")
    x = n.join(u, "p_partkey")
    lists = ("dropped", "added", "dropped_units", "added_units")
    return x.select("p_partkey", *(F.array_join(c, ",").alias(c) for c in lists), s.edit_class(*map(F.col, lists)).alias("class"))


@query("txt_rewriting_faults", f"WITH {_PAIRS} SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(target,'\\*\\*|(?:^|\\n)\\s*[*•-]\\s|(?:^|\\n)#{{1,6}}\\s') THEN 'marks' END, CASE WHEN regexp_matches(target,'(?i)(?:^|\\n)\\s*(?:impression|conclusion|summary)\\s*:?\\s*(?:\\n|$)') THEN 'heading' END, CASE WHEN regexp_matches(target,'(?i)^(?:here is|sure,|certainly|i have)\\b') THEN 'preamble' END, CASE WHEN contains(target,'90') THEN 'leak' END, CASE WHEN length(target)/greatest(length(source),1)::double < 0.7 THEN 'shorter' END, CASE WHEN length(target)/greatest(length(source),1)::double > 1.4 THEN 'longer' END) AS faults FROM pairs")
def _(spark, d):
    return _pairs(spark, d).select("p_partkey", F.array_join(s.rewriting_faults(F.col("source"), F.col("target"), "90"), ",").alias("faults"))


@query("txt_loose_match", f"WITH {_PAIRS}, x AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(target)) AS b FROM pairs JOIN part USING (p_partkey)) SELECT p_partkey, a<>'' AND b<>'' AND (contains(a,b) OR contains(b,a) OR list_has_any(list_filter(string_split_regex(a,'[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w)>=4), list_filter(string_split_regex(b,'[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w)>=4))) AS loose FROM x")
def _(spark, d):
    x = _pairs(spark, d).join(t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return x.select("p_partkey", s.loose_match(F.col("p_name"), F.col("target")).alias("loose"))


@query("txt_folded", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)),'\\s+',' ','g'))) AS h FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(s.folded(F.col("text")).cast("binary")).alias("h"))


@query("txt_free_lists", "SELECT doc_id, len(l) AS n, coalesce(list_max(list_transform(l, lambda x: length(x))),0) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text,'[;,\\n|]+'), lambda x: trim(x)), lambda x: x<>'') AS l FROM documents)")
def _(spark, d):
    x = t(spark, d, "documents").select("doc_id", s.free_list(F.col("text")).alias("l"))
    return x.select("doc_id", F.size("l").cast("long").alias("n"), F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("txt_salvage", "SELECT user_id, array_to_string(list_filter(['click','view','purchase','login'], lambda x: list_contains(ids,x)),',') AS known, array_to_string(list_sort(list_filter(ids, lambda x: x NOT IN ('click','view','purchase','login'))),',') AS others FROM (SELECT user_id, list(DISTINCT event_type) AS ids FROM events GROUP BY 1)")
def _(spark, d):
    rank = F.array_position(F.array(*map(F.lit, ["click", "view", "purchase", "login"])), F.col("event_type"))
    said = F.concat(F.lit('{"concept_id" : "'), F.col("event_type"), F.lit('", '))
    order = F.when(rank == 0, 9).otherwise(rank)
    raw = t(spark, d, "events").select("user_id", F.struct(order.alias("o"), F.col("event_type").alias("e"), said.alias("said")).alias("x")).groupBy("user_id").agg(F.sort_array(F.collect_set("x")).alias("x"))
    known, others = s.salvaged(F.array_join(F.transform("x", lambda v: v["said"]), ""), ["click", "view", "purchase", "login"])
    return raw.select("user_id", F.array_join(known, ",").alias("known"), F.array_join(others, ",").alias("others"))


_AT = "(('0x' || substr(sha1('d-{0}|' || item_id),1,8))::bigint % {1})::int + 1"


@query("txt_distractors", f"SELECT item_id, free[{_AT.format('word', 'len(free)')}] AS word, (['mass','cyst','scar'])[{_AT.format('concept', '3')}] AS concept FROM (SELECT item_id, list_filter(string_split(text,' '), lambda w: w NOT IN ('the','of')) AS free0, [x.w FOR x IN list_transform(list_filter(list_zip(string_split(text,' '), range(len(string_split(text,' ')))), lambda z: z[1] NOT IN ('the','of') AND list_position(string_split(text,' '), z[1]) = z[2]+1), lambda z: {{'w': z[1]}})] AS free FROM benchmark)")
def _(spark, d):
    x = t(spark, d, "benchmark").select("item_id", s.distractor(F.split("text", " "), ["the", "of"], ["mass", "cyst", "scar"], "d", F.col("item_id")).alias("x"))
    return x.select("item_id", "x.word", "x.concept")


@query(
    "txt_aligned",
    f"WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), q AS (SELECT conv_id, turn, length(a)//2 AS pos, {_AFTER.format('a', '.')} AS a, {_AFTER.format('b', '.')} AS b FROM p WHERE b IS NOT NULL), e AS (SELECT *, len(list_filter(list_transform(range(1,len(a)+1), lambda i: list_sum(list_transform(a[1:i], lambda x: length(x)+1))), lambda x: x <= pos)) AS k FROM q) SELECT conv_id, turn, CASE WHEN len(b)>0 THEN b[least(k,len(b)-1)+1] END AS beside FROM e",
)
def _(spark, d):
    x = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")
    return x.select("conv_id", "turn", s.aligned(F.col("a"), F.col("b"), F.floor(F.length("a") / 2).cast("int")).alias("beside"))


@query("txt_sections", "SELECT conv_id, role AS heading, count(*) AS n, sum(length(regexp_replace(text,'^\\s+|\\s+$','','g')))::bigint AS chars FROM conversations WHERE role IN ('user','assistant') GROUP BY 1,2")
def _(spark, d):
    from ..text.sections import normal_heading, sections

    ship(spark)
    known, marked = {"user", "assistant"}, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## "), "role", F.lit(" ##"))).otherwise(F.concat(F.lit("- **"), "role", F.lit(":**")))

    @F.pandas_udf("array<struct<heading:string,chars:bigint>>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: [{"heading": normal_heading(h, known), "chars": len(b)} for h, b in sections(x, known)])

    c = t(spark, d, "conversations").where(F.col("role").isin(*known)).select("conv_id", F.struct("turn", F.concat_ws("\n", marked, "text").alias("part")).alias("x"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda v: v["part"]), "\n").alias("report"))
    return whole.select("conv_id", F.explode(cut("report")).alias("s")).groupBy("conv_id", "s.heading").agg(F.count("*").alias("n"), F.sum("s.chars").alias("chars"))


@query(
    "txt_measurements",
    "WITH x AS (SELECT p_partkey, p_size AS z, (p_partkey%7) AS k, p_partkey%5 AS m FROM part) SELECT p_partkey, 1 AS meas_idx, CASE m WHEN 0 THEN z || '.0,' || (z+1) || '.0,' || (k+1) || '.0,2.0' WHEN 1 THEN z || '.0,' || (z+4) || '.0' ELSE z || '.0' END AS axes, m=1 AS is_range, m=3 AS is_technical, (CASE m WHEN 0 THEN greatest(z+1,k+1,2) WHEN 1 THEN z+4 ELSE z END)::double AS max_mm FROM x UNION ALL SELECT p_partkey, 2, (k*10) || '.0', false, m=3, (k*10)::double FROM x",
)
def _(spark, d):
    from ..text.measure import MEASUREMENTS, measurements

    ship(spark)

    @F.pandas_udf(MEASUREMENTS)
    def found(text: pd.Series) -> pd.Series:
        return text.map(measurements)

    z, k, m = F.col("p_size"), F.col("p_partkey") % 7, F.col("p_partkey") % 5
    txt = lambda c: c.cast("string")
    first = F.when(m == 0, F.concat(txt(z), F.lit("x"), txt(z + 1), F.lit(" x "), txt(k + 1), F.lit("×2 mm"))).when(m == 1, F.concat(txt(z), F.lit("-"), txt(z + 4), F.lit("mm"))).otherwise(F.concat(txt(z), F.lit(" mm")))
    text = F.concat(F.lit("On 7.12.2021 a part of "), first, F.when(m == 3, " sections were taken").otherwise(""), F.lit(", then "), txt(k), F.lit(" cm."))
    x = t(spark, d, "part").select("p_partkey", F.explode(found(text)).alias("m"))
    return x.select("p_partkey", (F.col("m.meas_idx") + 1).alias("meas_idx"), F.array_join(F.transform("m.axes_mm", lambda v: v.cast("string")), ",").alias("axes"), "m.is_range", "m.is_technical", "m.max_mm")
