"""Gates: rules whose violations are counted, and writes that are refused while there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class GateError(ValueError):
    """A table broke its rules; nothing was written."""


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Names that the table lacks."""
    return [c for c in wanted if c not in df.columns]


def schema_rules(df: DataFrame, wanted: list[str], rule: str = "K0 columns") -> DataFrame:
    """(rule, violations): names that the table lacks."""
    return df.sparkSession.createDataFrame([(rule, len(missing_columns(df, wanted)))], "rule string, violations long")


def blank(c: str) -> Column:
    """Null, or text of blanks only."""
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def outside(c: str, values: list, nullable: bool = False) -> Column:
    """A value that isn't in the closed set."""
    bad = ~F.col(c).isin(values)
    return F.coalesce(bad, F.lit(not nullable))


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of all row rules, in one pass."""
    sums = df.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, c in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations")) for k in rules))
    return sums.select(F.explode(pairs).alias("x")).select("x.rule", "x.violations")


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, violations): rows beyond the first of each key."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, violations): rows whose key has no parent."""
    lost = df.join(parent.select(F.col(parent_key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def versions(df: DataFrame, column: str, rule: str) -> DataFrame:
    """(rule, violations): distinct values beyond the one a table may have."""
    return df.agg(F.greatest(F.count_distinct(column) - 1, F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def off_text(text: str, raw: str, start: str, end: str) -> Column:
    """A span whose text isn't the slice that its offsets name."""
    return ~F.substring(text, F.col(start) + 1, F.greatest(F.col(end) - F.col(start), F.lit(0))).eqNullSafe(F.col(raw))


def needs_cue(column: str, values: list[str], cue: str) -> Column:
    """A value other than the default without the cue it rests on."""
    return F.col(column).isin(values) & blank(cue)


def inside(df: DataFrame, parents: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """(rule, violations): spans (char_start, char_end) that leave the parent span (s_start, s_end) of their keys, or have none."""
    x = df.join(parents.select(*keys, "s_start", "s_end"), keys, "left")
    bad = F.col("s_start").isNull() | (F.col("char_start") < F.col("s_start")) | (F.col("char_end") > F.col("s_end"))
    return x.agg(F.count_if(bad).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def in_group(df: DataFrame, groups: DataFrame, group: str, value: str, rule: str) -> DataFrame:
    """(rule, violations): distinct values that aren't among those of their group; groups not listed are another rule's matter."""
    seen = df.select(group, value).distinct().join(groups.select(group).distinct(), group, "left_semi")
    return seen.join(groups, [group, value], "left_anti").agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def edges(rel: DataFrame, heads: DataFrame, tails: DataFrame, types: DataFrame) -> DataFrame:
    """(rule, violations): edges (study, head_id, tail_id, relation_type) whose ends are missing, of a wrong kind, or of another study.

    heads and tails have id, kind and study; types lists the kinds of ends of each
    relation type, and a type it doesn't list may join any.
    """
    h, x = heads.select(F.col("id").alias("head_id"), F.col("kind").alias("head_kind"), F.col("study").alias("__h")), tails.select(F.col("id").alias("tail_id"), F.col("kind").alias("tail_kind"), F.col("study").alias("__t"))
    known = types.select("relation_type").distinct().withColumn("__typed", F.lit(True))
    fits = types.distinct().withColumn("__fits", F.lit(True))
    e = rel.join(h, "head_id", "left").join(x, "tail_id", "left").join(known, "relation_type", "left").join(fits, ["relation_type", "head_kind", "tail_kind"], "left")
    lost = F.col("head_kind").isNull() | F.col("tail_kind").isNull()
    wrong = ~lost & F.col("__typed").isNotNull() & F.col("__fits").isNull()
    other = ~lost & ((F.col("__h") != F.col("__t")) | (F.col("__h") != F.col("study")))
    return row_rules(e, {"K2 ends": lost, "K2b types": wrong, "K2c one study": other})


#: Least shares, in per cent, that the invariants must reach; fixed values.
INVARIANTS = {"K11": 100.0, "K12": 100.0, "K13": 90.0, "K14": 100.0, "K15": 85.0}


def invariants(ent: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """(rule, n, violations, rate, least, met) of the behavioural invariants, each over its own denominator.

    ent has entity_id, kind, assertion, cue, char_start and covered (by a cue that
    forbids denial); sentences (one row for each key) have technical, negated (by a
    cue of its own), coordinated and backward_only. K11: covered findings aren't
    absent. K12: a technical remark alone denies nothing. K13: after a coordinated
    negation the second observation is absent too. K14: what isn't plainly present
    has a cue. K15: a cue behind its finding is enough for one denial.
    """
    absent = F.col("assertion") == "absent"
    x = ent.join(sentences, keys, "left")
    seen = F.sort_array(F.collect_list(F.when(F.col("kind") == "observation", F.struct("char_start", "entity_id", "assertion"))))
    per = x.groupBy(*keys).agg(
        F.count_if("covered").alias("a11"), F.count_if(F.col("covered") & absent).alias("b11"), F.count_if(F.col("technical") & ~F.col("negated")).alias("a12"), F.count_if(F.col("technical") & ~F.col("negated") & absent).alias("b12"),
        F.count_if(F.col("assertion").isin("absent", "uncertain")).alias("a14"), F.count_if(needs_cue("assertion", ["absent", "uncertain"], "cue")).alias("b14"),
        F.bool_or("coordinated").alias("coordinated"), F.bool_or("backward_only").alias("back"), F.bool_or(absent).alias("some"), seen.alias("seen"),
    )
    second = F.when(F.size("seen") >= 2, F.element_at("seen", 2)["assertion"])
    per = per.withColumns({"a13": (F.col("coordinated") & (F.size("seen") >= 2)).cast("int"), "b13": (F.col("coordinated") & (second != "absent")).cast("int"), "a15": F.col("back").cast("int"), "b15": (F.col("back") & ~F.col("some")).cast("int")})
    sums = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for k in range(11, 16) for c in (f"a{k}", f"b{k}")))
    rows = F.explode(F.array(*(F.struct(F.lit(f"K{k}").alias("rule"), F.col(f"a{k}").alias("n"), F.col(f"b{k}").alias("violations"), F.lit(INVARIANTS[f"K{k}"]).alias("least")) for k in range(11, 16))))
    rate = F.try_divide(100.0 * (F.col("n") - F.col("violations")), F.col("n").cast("double"))
    return sums.select(rows.alias("x")).select("x.*").withColumn("rate", rate).withColumn("met", F.coalesce(F.col("rate") >= F.col("least"), F.lit(True)))


def documented(lexicon: DataFrame, note: str, rule: str = "K16 decisions") -> DataFrame:
    """(rule, violations): lexicon entries without a note of why they are there."""
    return row_rules(lexicon, {rule: blank(note)})


def share_within(df: DataFrame, column: str, value: str, low: float, high: float) -> DataFrame:
    """(value, share, accepted): whether a class has a share within the interval fixed beforehand; an empty table isn't accepted."""
    share = F.try_divide(F.count_if(F.col(column) == value).cast("double"), F.count("*").cast("double"))
    return df.agg(share.alias("share")).select(F.lit(value).alias("value"), "share", F.coalesce(F.col("share").between(low, high), F.lit(False)).alias("accepted"))


def ordered_package(df: DataFrame, doc: str, span: str, doc_order: str, span_order: str) -> DataFrame:
    """(rule, violations): breaks in the numbering of documents, from 1, and of spans within each. Documents of a package are few by nature: one row each goes through the window."""
    docs = df.groupBy(doc).agg(F.min(doc_order).alias("o"), F.max(doc_order).alias("p"))
    steps = docs.select((F.col("o") != F.coalesce(F.lag("o").over(W.orderBy("o", doc)), F.lit(0)) + 1).alias("gap"), (F.col("o") != F.col("p")).alias("two"))
    first = steps.agg((F.count_if("gap") + F.count_if("two")).alias("violations")).select(F.lit("document order").alias("rule"), "violations")
    spans = df.select((F.col(span_order) != F.coalesce(F.lag(span_order).over(W.partitionBy(doc).orderBy(span_order, span)), F.lit(0)) + 1).alias("gap"))
    return first.unionByName(spans.agg(F.count_if("gap").alias("violations")).select(F.lit("span order").alias("rule"), "violations"))


def annotated(annotations: DataFrame, blind: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """(rule, violations): rows missing, extra, changed in a fixed column, or repeated, against the blind package."""
    same = lambda c: F.col(f"__{c}").eqNullSafe(F.col(c))
    changed = F.lit(False)
    for c in fixed:
        changed = changed | ~same(c)
    a = annotations.groupBy(*keys).agg(*(F.first(c).alias(c) for c in fixed), F.count("*").alias("__n"))
    x = a.join(blind.select(*keys, *(F.col(c).alias(f"__{c}") for c in fixed), F.lit(True).alias("__b")), keys, "full")
    here, there = F.col("__n").isNotNull(), F.col("__b").isNotNull()
    return row_rules(x, {"missing": ~here, "extra": here & ~there, "changed": here & there & changed, "repeated": F.col("__n") > 1})


def same_order(df: DataFrame, arm: str, key: str, order: list[str]) -> DataFrame:
    """(positions, incomplete, different): places in the order of the arms where an arm lacks a row, and where their ids differ."""
    x = df.select(arm, F.col(key).alias("__id"), F.row_number().over(W.partitionBy(arm).orderBy(*order)).alias("at"))
    arms = x.agg(F.count_distinct(arm).alias("arms"))
    per = x.groupBy("at").agg(F.count("*").alias("n"), F.min("__id").alias("a"), F.max("__id").alias("b"))
    # arms is one row
    return per.join(F.broadcast(arms)).agg(F.count("*").alias("positions"), F.count_if(F.col("n") != F.col("arms")).alias("incomplete"), F.count_if(F.col("a") != F.col("b")).alias("different"))


#: Rows after which an ordered run is judged, and the share of broken ones that stops it; fixed values.
STOP_FIRST, STOP_RATIO = 8, 0.6


def early_stop(df: DataFrame, broken: Column, order: list[str], first: int = STOP_FIRST, ratio: float = STOP_RATIO) -> DataFrame:
    """(n, violations, stop): whether so many of the first rows broke a rule that the run should end."""
    got = df.orderBy(*order).limit(first).agg(F.count("*").alias("n"), F.count_if(broken).alias("violations"))
    return got.withColumn("stop", (F.col("n") >= first) & (F.col("violations") >= ratio * F.col("n")))


def all_rules(*parts: DataFrame) -> DataFrame:
    """The rules of several tables together."""
    return reduce(DataFrame.unionByName, parts)


def write_gated(df: DataFrame, violations: DataFrame, path: str) -> None:
    """Writes the table unless a rule is broken."""
    broken = violations.where("violations > 0").collect()
    if broken:
        raise GateError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
    df.write.mode("errorifexists").parquet(path)
