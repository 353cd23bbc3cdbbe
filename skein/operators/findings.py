"""Findings as a table: verdicts, enrichment, regions, sizes, series summaries, and studies of a rule set.

The entity table has study, section, sent_idx, entity_id, kind, concept, raw_text,
text (of its sentence), char_start, char_end (in that text), assertion and rule;
the relation table study, head_id, tail_id, relation_type and what else is said
below. Sentences are numbered within a section, so all three key columns are used
everywhere. Rows with a null key join with nothing and keep their place in left
joins; an empty table gives empty results, flags without a match are false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = ["study", "section", "sent_idx"]
#: Characters before a mention in which a word on its region counts; fixed value.
REGION_WINDOW = 25
#: Codes of lobes by side and level; the left lung has no middle lobe. Fixed values.
LOBES = {("right", "upper"): "RUL", ("right", "middle"): "RML", ("right", "lower"): "RLL", ("left", "upper"): "LUL", ("left", "middle"): "LUL", ("left", "lower"): "LLL"}
_LOBE = r"(?i)\b(?:(right|left)\s+(upper|middle|lower)\s+lobe|(upper|middle|lower)\s+lobe\s+of\s+(?:the\s+)?(right|left)\b)"
_SIZE = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(mm|cm)"


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same table; a missing enrichment column is an error, never a silent false."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"enrichment columns are missing: {lost}")
    return df


def require_relations(rel: DataFrame | None, user: str) -> DataFrame:
    """The relation table; None isn't an empty one."""
    if rel is None:
        raise ValueError(f"{user} needs the relation table, which may be empty but not None")
    return rel


def lobe(text: Column) -> Column:
    """The code of the first lobe that the text names, in either word order; null without one."""
    part = [F.lower(F.regexp_extract(text, _LOBE, i)) for i in (1, 2, 3, 4)]
    name = F.concat_ws(" ", F.concat(part[0], part[3]), F.concat(part[1], part[2]))
    codes = F.create_map(*(F.lit(x) for (side, level), code in LOBES.items() for x in (f"{side} {level}", code)))
    return codes[name]


def size_mm(text: Column) -> Column:
    """The first size in the text in millimetres; a comma counts as the decimal point."""
    number = F.replace(F.regexp_extract(text, _SIZE, 1), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.lower(F.regexp_extract(text, _SIZE, 2)) == "cm", F.round(number * 10, 2)).otherwise(number)


def definite_benign(ent: DataFrame, benign: Sequence[str], rules: Sequence[str], said: str) -> DataFrame:
    """Keys of the sentences with a definite benign verdict: by a benign finding under one of the rules, or by their text."""
    finding = F.col("concept").isin(*benign) & (F.col("assertion") == "present") & F.col("rule").isin(*rules)
    return ent.where(F.coalesce(finding, F.lit(False)) | F.coalesce(F.col("text").rlike(said), F.lit(False))).select(*SENTENCE).distinct()


def known_cancer(anchor: str, term: str) -> Column:
    """Whether the sentence documents a known cancer: an anchor and a term, for findings that aren't absent."""
    said = F.col("text").rlike(anchor) & F.col("text").rlike(term)
    return F.coalesce(F.col("assertion") != "absent", F.lit(True)) & F.coalesce(said, F.lit(False))


def stock_nodule(enabled: bool, concepts: Sequence[str]) -> Column:
    """Whether a nodule in a stock sentence, without a suspicious modifier, counts as stock; off unless enabled."""
    return F.lit(enabled) & F.coalesce(F.col("concept").isin(*concepts) & F.col("in_stock") & ~F.col("suspicious"), F.lit(False))


def with_stock(ent: DataFrame, sentences: DataFrame) -> DataFrame:
    """Adds `in_stock`: whether the sentence (keys, is_stock) is a stock phrasing."""
    s = sentences.groupBy(*SENTENCE).agg(F.bool_or("is_stock").alias("in_stock"))
    return ent.join(s, SENTENCE, "left").withColumn("in_stock", F.coalesce("in_stock", F.lit(False)))


def with_modifier(ent: DataFrame, rel: DataFrame | None, concepts: Sequence[str], into: str = "suspicious") -> DataFrame:
    """Adds whether one of the qualifiers modifies the finding: in a modify relation the head is the qualifier."""
    rel = require_relations(rel, "with_modifier").where("relation_type = 'modify'")
    heads = ent.where(F.col("concept").isin(*concepts)).select(F.col("entity_id").alias("head_id"))
    hit = rel.join(heads, "head_id", "left_semi").select(F.col("tail_id").alias("entity_id"), F.lit(True).alias(into)).distinct()
    return ent.join(hit, "entity_id", "left").withColumn(into, F.coalesce(into, F.lit(False)))


def outside_region(ent: DataFrame, rel: DataFrame | None, away: Sequence[str], inside: Sequence[str], mark: str) -> DataFrame:
    """entity_id of findings that lie at an anatomy away from the region.

    Kept are findings with a word of the region in their own text or just before
    it, and those of sentences that name anatomies of both kinds, as a single
    relation can't be trusted there.
    """
    rel = require_relations(rel, "outside_region").where("relation_type = 'located_at'")
    tails = ent.where(F.col("concept").isin(*away)).select(F.col("entity_id").alias("tail_id"))
    found = rel.join(tails, "tail_id", "left_semi").select(F.col("head_id").alias("entity_id")).distinct()
    at = F.greatest(F.col("char_start") - REGION_WINDOW, F.lit(0))
    marked = F.coalesce(F.col("raw_text").rlike(mark), F.lit(False)) | F.coalesce(F.substring("text", at + 1, F.col("char_end") - at).rlike(mark), F.lit(False))
    both = ent.groupBy(*SENTENCE).agg(F.bool_or(F.col("concept").isin(*away)).alias("a"), F.bool_or(F.col("concept").isin(*inside)).alias("b")).where("a and b")
    return ent.where(~marked).join(found, "entity_id", "left_semi").join(both, SENTENCE, "left_anti").select("entity_id")


def with_size(ent: DataFrame, rel: DataFrame | None) -> DataFrame:
    """Adds size_mm and size_level: the last measurement (by seq) that a measured_by relation (head_id, tail_text, seq) ties to the finding."""
    rel = require_relations(rel, "with_size").where("relation_type = 'measured_by'")
    last = rel.groupBy(F.col("head_id").alias("entity_id")).agg(size_mm(F.max_by("tail_text", "seq")).alias("size_mm"))
    return ent.join(last, "entity_id", "left").withColumn("size_level", F.when(F.col("size_mm").isNotNull(), "L1").otherwise("none"))


def promoted(ent: DataFrame) -> DataFrame:
    """Adds whether a finding, not an anatomy, of the findings section is named in a study's impression again."""
    again = ent.where("section = 'impression' and kind <> 'anatomy'").select("study", "concept").distinct().withColumn("__again", F.lit(True))
    out = ent.join(again, ["study", "concept"], "left")
    return out.withColumn("promoted", F.coalesce((F.col("section") == "findings") & (F.col("kind") != "anatomy") & F.col("__again"), F.lit(False))).drop("__again")


def anatomy_context(ent: DataFrame, rel: DataFrame) -> DataFrame:
    """(entity_id, concept, context) of findings: the anatomies of located_at relations and all of the sentence, sorted."""
    anatomy = ent.where("kind = 'anatomy'")
    near = rel.where("relation_type = 'located_at'").join(anatomy.select(F.col("entity_id").alias("tail_id"), F.col("concept").alias("place")), "tail_id").groupBy(F.col("head_id").alias("entity_id")).agg(F.collect_set("place").alias("near"))
    here = anatomy.groupBy(*SENTENCE).agg(F.collect_set("concept").alias("here"))
    none = F.array().cast("array<string>")
    out = ent.where("kind = 'observation'").join(near, "entity_id", "left").join(here, SENTENCE, "left")
    return out.select("entity_id", "study", "concept", "assertion", F.sort_array(F.array_union(F.coalesce("near", none), F.coalesce("here", none))).alias("context"))


def summary(ent: DataFrame, series: DataFrame, levels: DataFrame, nodules: Sequence[str], benign: Sequence[str], malignant: Sequence[str], kind_said: str) -> DataFrame:
    """One row for each series (study, placeholder), also without findings.

    ent has in_scope, bucket, is_outside and size_mm besides; levels (study, level,
    source) are rolled up before. Only findings in scope and inside the region
    count; the quality flags say what was left out for which reason.
    """
    ent = require(ent, ["in_scope", "bucket", "is_outside", "size_mm"])
    kept = F.col("in_scope") & ~F.col("is_outside")
    present, c = F.col("assertion") == "present", F.col("concept")
    lost = ~kept & present & c.isin(*malignant)
    said = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    got = ent.groupBy("study").agg(
        F.when(said(kept & present & c.isin(*nodules)), "true").when(said(kept & (F.col("assertion") == "absent") & c.isin(*nodules)), "false").otherwise("not_assessable").alias("nodule"),
        F.sort_array(F.collect_set(F.when(kept, lobe(F.col("text"))))).alias("lobes"),
        said(kept & present & c.isin(*benign)).alias("benign_evidence"), F.count_if(kept).alias("n_evidence"), said(kept & F.col("text").rlike(kind_said)).alias("kind_available"), said(F.col("size_mm").isNotNull()).alias("size_available"),
        said(lost & ((F.col("bucket") == "other_organ") | F.col("is_outside"))).alias("qf_outside"), said(lost & F.col("bucket").isin("unknown", "meta")).alias("qf_unknown"), said(kept & present & (F.col("bucket") == "mediastinum")).alias("qf_mediastinum"),
    )
    flags = ["benign_evidence", "kind_available", "size_available", "qf_outside", "qf_unknown", "qf_mediastinum"]
    out = series.join(got, "study", "left").join(levels.select("study", "level", "source"), "study", "left")
    return out.select(
        "study", "placeholder", F.coalesce("nodule", F.lit("not_assessable")).alias("nodule"), F.coalesce("lobes", F.array().cast("array<string>")).alias("lobes"), F.coalesce("level", F.lit("not_mentioned")).alias("level"), "source",
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), *(F.coalesce(x, F.lit(False)).alias(x) for x in flags), (F.coalesce("n_evidence", F.lit(0)) == 0).alias("qf_no_section"),
    )


def axes(ev: DataFrame, inside: Sequence[str]) -> DataFrame:
    """(study, axis_a, axis_b) of evidence rows (study, kind, region, time, negated, hedged, suspicious, benign).

    Axis A is the level that the evidence inside the regions supports, the first of
    seven that holds; what is negated only counts as `none`. Axis B lists every
    aspect that some row inside has.
    """
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    here, free = F.col("region").isin(*inside), ~F.col("negated")
    mal, nod = here & free & (F.col("kind") == "malignancy"), here & free & (F.col("kind") == "nodule")
    now = F.col("time").isin("current", "follow_up")
    flags = ev.groupBy("study").agg(
        any_(mal & now & ~F.col("hedged")).alias("sure"), any_(mal & now).alias("current"), any_(mal).alias("malignancy"), any_(nod & F.col("suspicious")).alias("suspicious"),
        any_(nod & ~F.col("benign")).alias("open_nodule"), any_(nod).alias("nodule"), any_(F.col("negated")).alias("negated"),
    )
    levels = [("sure", "high"), ("current", "intermediate"), ("malignancy", "known_malignancy"), ("suspicious", "intermediate"), ("open_nodule", "indeterminate"), ("nodule", "low"), ("negated", "none")]
    a = F.coalesce(*(F.when(F.col(k), F.lit(v)) for k, v in levels), F.lit("not_mentioned"))
    b = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k, _ in levels)))
    return flags.select("study", a.alias("axis_a"), b.alias("axis_b"))


def coverage(df: DataFrame, groups: dict[str, str], text: str, key: str) -> DataFrame:
    """(grp, n_rows, n_keys): rows and distinct keys that each group's pattern meets, in one scan."""
    hit = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in groups.items())))
    return df.select(key, F.explode(hit).alias("grp")).groupBy("grp").agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def pattern_diff(df: DataFrame, old: str, new: str, text: str, key: str) -> DataFrame:
    """(change, n, example): rows gained, lost and kept by a new pattern, with the first key of each."""
    a, b = F.coalesce(F.col(text).rlike(old), F.lit(False)), F.coalesce(F.col(text).rlike(new), F.lit(False))
    change = F.when(a & b, "kept").when(a, "lost").when(b, "gained")
    return df.select(key, change.alias("change")).where("change is not null").groupBy("change").agg(F.count("*").alias("n"), F.min(key).alias("example"))


def mismatch_cause(found: Column, expected: Column, n: Column, hedged: Column, stock: Column) -> Column:
    """Why a found level isn't the expected one: null if it is, else the first cause that holds."""
    return F.when(found.eqNullSafe(expected), None).when(n == 0, "no_finding").when(stock, "stock_sentence").when(hedged, "hedge").when(found.isNull(), "rule_without_level").otherwise("threshold")


def scenarios(df: DataFrame, changes: dict[str, dict[str, Column]], decide: Column, key: str) -> DataFrame:
    """(scenario, level, n, changed): the decision over the table as it is and under each rewriting of columns.

    All scenarios are columns of one scan; nothing is joined.
    """
    base = df.withColumn("__base", decide)
    parts = None
    for name, columns in ({"as_is": {}} | changes).items():
        one = base.withColumns(columns).select(F.lit(name).alias("scenario"), decide.alias("level"), (~decide.eqNullSafe(F.col("__base"))).alias("c"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("scenario", "level").agg(F.count("*").alias("n"), F.count_if("c").alias("changed"))


def transitions(before: DataFrame, after: DataFrame, key: str, level: str) -> DataFrame:
    """(from_level, to_level, n) of keys whose level changes between two runs; a missing key counts as null."""
    a, b = before.select(key, F.col(level).alias("from_level")), after.select(key, F.col(level).alias("to_level"))
    return a.join(b, key, "full").where(~F.col("from_level").eqNullSafe(F.col("to_level"))).groupBy("from_level", "to_level").agg(F.count("*").alias("n"))


def gap(sentences: DataFrame, ent: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(concept, n, missed, share): sentences whose text meets a concept's pattern, and those without such a finding."""
    hit = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(k)) for k, p in patterns.items())))
    said = sentences.select(*SENTENCE, F.explode(hit).alias("concept"))
    has = ent.select(*SENTENCE, "concept").distinct().withColumn("__has", F.lit(True))
    got = said.join(has, [*SENTENCE, "concept"], "left").groupBy("concept").agg(F.count("*").alias("n"), F.count_if(F.col("__has").isNull()).alias("missed"))
    return got.withColumn("share", F.col("missed") / F.col("n"))


def tiers(inventory: DataFrame, support: DataFrame, concept: str = "concept") -> DataFrame:
    """The inventory with `support` and `tier`: A with some support in the corpus, B with none."""
    n = support.groupBy(concept).agg(F.count("*").alias("support"))
    out = inventory.join(n, concept, "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return out.withColumn("tier", F.when(F.col("support") == 0, "B").otherwise("A"))


def first_assertion(ent: DataFrame, sections: Sequence[str] = ("findings", "impression")) -> DataFrame:
    """(study, concept, assertion, n) of each concept of a study as its first mention has it, in the order of sections, sentences and places."""
    place = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    order = F.struct(F.when(place == 0, len(sections) + 1).otherwise(place), "sent_idx", "char_start", "entity_id")
    return ent.groupBy("study", "concept").agg(F.min_by("assertion", order).alias("assertion"), F.count("*").alias("n"))


def preserved(df: DataFrame, keep: Column, run) -> DataFrame:
    """(n, lost, changed): the rows that a run makes of the whole table, and how they differ when only the rows to keep go in: a prefilter is safe if both are 0."""
    whole, part = run(df), run(df.where(keep))
    columns = whole.columns
    a, b = whole.groupBy(*columns).agg(F.count("*").alias("__a")), part.groupBy(*(F.col(c).alias(f"__{c}") for c in columns)).agg(F.count("*").alias("__b"))
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    n, m = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return a.join(b, on, "full").agg(total(n).alias("n"), total(F.greatest(n - m, F.lit(0))).alias("lost"), total(F.greatest(m - n, F.lit(0))).alias("changed"))
