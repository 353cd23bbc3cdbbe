"""Small text rules as column expressions: splitters, negation windows, signatures, rewriting checks, matches.

A null text gives null, or an empty list where a list is asked for, unless it is
said otherwise. Offsets are code points. Word lists and patterns are parameters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between a negation and its term, at most; fixed values for the two ways of use.
NEGATION_REACH, NEGATION_REACH_SHORT = 120, 110
#: Bounds of the length of a rewritten text against its source; fixed values.
SHORTEST, LONGEST = 0.70, 1.40
#: Units whose numbers a rewriting must keep. Fixed values.
UNITS = ["mm", "cm", "m", "ml", "cc", "mg", "g", "kg", "hu", "mm2", "cm2", "mm3", "cm3", "msv", "kvp", "mas", "%"]


def split_after(text: Column, stops: str) -> Column:
    """Parts of the text after each of the stop characters that blanks follow, trimmed; empty parts are left out."""
    return _filled(F.split(text, rf"(?<=[{stops}])\s+"))


def split_spaced(text: Column) -> Column:
    """Parts between full stops that stand apart, semicolons and a full stop at the end, with runs of blanks as one."""
    return _filled(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r" \. |\.\z|;"))


def split_glued(text: Column) -> Column:
    """Parts at four kinds of boundary: a stop and blanks, a stop glued between a small letter or digit and a capital, a semicolon, a line end."""
    return _filled(F.split(text, r"(?<=[.!?])\s+|(?<=[a-z0-9)][.])(?=[A-Z])|;|\n+"))


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def around(text: Column, start: Column, end: Column) -> Column:
    """The sentence around a span: from the last full stop or semicolon before it to the next one after it, trimmed."""
    before = F.regexp_extract(F.substring(text, F.lit(1), start), r"([^.;]*)\z", 1)
    after = F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"\A([^.;]*)", 1)
    return F.trim(F.concat(before, F.substring(text, start + 1, end - start), after))


def token_span(text: Column, first: Column, last: Column) -> Column:
    """The words from the first to the last place, both included, joined by blanks."""
    return F.array_join(F.slice(F.split(text, " "), first + 1, F.greatest(last - first + 1, F.lit(0))), " ")


def keyword_sentence(text: Column, keyword: str) -> Column:
    """The first sentence with the keyword, whatever its case; null without one."""
    return F.get(F.filter(split_after(text, ".!?"), lambda x: F.contains(F.lower(x), F.lit(keyword.lower()))), F.lit(0))


#: What stands for something still to be filled in: a short text in square brackets, or one of the phrases. Fixed values.
PLACEHOLDER = r"(?i)\[[^\]]{2,60}\]|not visible|not given|placeholder"


def placeholder(text: Column, pattern: str = PLACEHOLDER) -> Column:
    """Whether the text has a mark that stands for something still to be filled in; a null text has none."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def negated_before(before: Column, negation: str, breaker: str, reach: int = NEGATION_REACH) -> Column:
    """Whether the text before a term ends in the scope of a negation: the last one, near enough, with no breaker between."""
    tail = F.regexp_extract(before, rf"(?is)\A.*(?:{negation})(.*)\z", 1)
    has = before.rlike(f"(?i)(?:{negation})")
    return has & ~tail.rlike(f"(?i)(?:{breaker})") & (F.length(tail) <= reach)


def finding_present(text: Column, term: str, negation: str, breaker: str, after: str | None = None, only: str | None = None) -> Column:
    """Whether some sentence has the term without a negation before it, or right behind it (`after`); `only` keeps sentences of a region.

    Of a sentence's mentions the first one decides.
    """

    def holds(x: Column) -> Column:
        m = rf"(?is)\A(.*?)(?:{term})(.*)\z"
        free = x.rlike(f"(?i)(?:{term})") & ~negated_before(F.regexp_extract(x, m, 1), negation, breaker, NEGATION_REACH_SHORT)
        if after is not None:
            free = free & ~F.substring(F.regexp_extract(x, m, 2), 1, 40).rlike(rf"(?i)\A(?:{after})")
        return free & x.rlike(only) if only is not None else free

    return F.coalesce(F.exists(F.split(text, "[.;]"), holds), F.lit(False))


def ordered_class(text: Column, classes: list[tuple[str, str]], default: str) -> Column:
    """The first class whose pattern the text meets."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for k, p in classes), F.lit(default))


def collapsed(tags: Column, whole: str, several: str = "several", none: str = "unstated") -> Column:
    """One label of a set of tags: the whole if named, the only one, several, or none."""
    return F.when(F.array_contains(tags, whole), whole).when(F.size(tags) == 1, F.get(tags, F.lit(0))).when(F.size(tags) > 1, several).otherwise(none)


def ngrams(text: Column, stop: list[str], most: int = 3, head: int = 3) -> Column:
    """The distinct runs of one to `most` words, without those of stop words alone and those whose first word is shorter than `head`."""
    stops = F.array(*map(F.lit, stop))

    def runs(words: Column, n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        kept = lambda g: (F.length(F.get(g, F.lit(0))) >= head) & (F.size(F.array_except(g, stops)) > 0)
        return F.transform(F.filter(F.transform(starts, lambda i: F.slice(words, i, n)), kept), lambda g: F.array_join(g, " "))

    # the words are bound to a variable, as an expression would be worked out anew for every run
    cut = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.get(F.transform(F.array(cut), lambda w: F.array_distinct(F.concat(*(runs(w, n) for n in range(1, most + 1))))), F.lit(0))


def cue_direction(sentences: DataFrame, text: str, pattern: str) -> DataFrame:
    """(n, at_end, at_start, direction): where a cue's first mention stands in its sentences, and so which way it reaches."""
    before = F.length(F.regexp_extract(text, rf"(?is)\A(.*?)\b(?:{pattern})", 1)) / F.greatest(F.length(text), F.lit(1))
    x = sentences.where(F.col(text).rlike(rf"(?i)\b(?:{pattern})")).agg(F.count("*").alias("n"), F.count_if(before > 0.6).alias("at_end"), F.count_if(before < 0.3).alias("at_start"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")) > 0.7, F.lit(False))
    return x.withColumn("direction", F.when(share("at_end"), "backward").when(share("at_start"), "forward").otherwise("both"))


def term_audit(pairs: DataFrame, terms: list[tuple[str, str, str, str | None, str | None]], source: str = "source", target: str = "target") -> DataFrame:
    """(term, n, correct, residual, corrupted, missing) of terms (name, in the source, correct, residual, corrupted) over pairs of texts, in one scan."""
    says = lambda c, p: F.col(c).rlike(f"(?i){p}") if p else F.lit(False)
    verdict = lambda ok, left, bad: F.when(says(target, ok), "correct").when(says(target, left), "residual").when(says(target, bad), "corrupted").otherwise("missing")
    rows = F.array_compact(F.array(*(F.when(says(source, s), F.struct(F.lit(name).alias("term"), verdict(ok, left, bad).alias("verdict"))) for name, s, ok, left, bad in terms)))
    kinds = ("correct", "residual", "corrupted", "missing")
    return pairs.select(F.explode(rows).alias("x")).groupBy("x.term").agg(F.count("*").alias("n"), *(F.count_if(F.col("x.verdict") == k).alias(k) for k in kinds))


def numbers(text: Column) -> Column:
    """The numbers of a text, with a decimal point."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:[.,][0-9]+)?)")), lambda x: F.replace(x, F.lit(","), F.lit(".")))


def units(text: Column) -> Column:
    """The units of a text in lower case: words that follow a number."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)[0-9]\s*(mm2|cm2|mm3|cm3|mm|cm|ml|cc|mg|kg|hu|msv|kvp|mas|m|g|%)(?:[^A-Za-z0-9]|$)")), F.lower)
    return F.filter(found, lambda x: x.isin(*UNITS))


def signature_diff(pairs: DataFrame, key: str, source: str, target: str, signature) -> DataFrame:
    """(key, dropped, added): values of the signature that the target has fewer or more times, sorted; one row for each pair."""
    side = lambda c, n: F.transform(F.coalesce(signature(F.col(c)), F.array().cast("array<string>")), lambda v: F.struct(v.alias("v"), F.lit(n).alias("n")))
    values = pairs.select(key, F.explode(F.concat(side(source, 1), side(target, -1))).alias("x")).select(key, "x.v", "x.n")
    odds = values.groupBy(key, "v").agg(F.sum("n").alias("n")).where("n <> 0")
    many = lambda sign: F.when(F.col("n") * sign > 0, F.array_repeat("v", F.abs("n").cast("int")))
    per = odds.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list(many(1)))).alias("dropped"), F.sort_array(F.flatten(F.collect_list(many(-1)))).alias("added"))
    none = F.array().cast("array<string>")
    return pairs.select(key).join(per, key, "left").select(key, F.coalesce("dropped", none).alias("dropped"), F.coalesce("added", none).alias("added"))


def edit_class(dropped: Column, added: Column, dropped_units: Column, added_units: Column, same: list[tuple[str, str]] = (("mm", "cm"), ("ml", "cc"))) -> Column:
    """What a rewriting did to numbers and units: clean, unit_only, dropped, invented, converted or changed."""
    some = lambda x: F.size(x) > 0
    swap = F.lit(False)
    for a, b in same:
        for x, y in ((a, b), (b, a)):
            swap = swap | (F.array_contains(dropped_units, x) & F.array_contains(added_units, y))
    return (
        F.when(~some(dropped) & ~some(added) & ~some(dropped_units) & ~some(added_units), "clean")
        .when(~some(dropped) & ~some(added), "unit_only")
        .when(some(dropped) & ~some(added) & ~some(added_units), "dropped")
        .when(some(added) & ~some(dropped), "invented")
        .when(swap, "converted")
        .otherwise("changed")
    )


def rewriting_faults(source: Column, target: Column, leaks: str) -> Column:
    """Names of what shows that a text was rewritten and not corrected: marks, a summary heading, a preamble, a leaked prompt, its length."""
    ratio = F.length(target) / F.greatest(F.length(source), F.lit(1))
    marks = r"\*\*|(?:\A|\n)\s*[*•-]\s|(?:\A|\n)#{1,6}\s"
    heading = r"(?i)(?:\A|\n)\s*(?:impression|conclusion|summary)\s*:?\s*(?:\n|\z)"
    preamble = r"(?i)\A(?:here is|here's|sure,|certainly|i have)\b"
    faults = [(target.rlike(marks), "marks"), (target.rlike(heading), "heading"), (target.rlike(preamble), "preamble"), (target.rlike(leaks), "leak"), (ratio < SHORTEST, "shorter"), (ratio > LONGEST, "longer")]
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in faults)))


def loose_match(a: Column, b: Column, least: int = 4) -> Column:
    """Whether one text contains the other, or they share a word of at least that many letters."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    long = lambda t: F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | F.arrays_overlap(long(x), long(y)))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with marks and the letters without them, from their canonical decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.decomposition(chr(c))]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case, Latin letters without their marks, runs of blanks as one."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, *_accents())), r"\s+", " "))


def folded_match(a: Column, b: Column) -> Column:
    """Whether one folded text contains the other; empty texts match nothing."""
    x, y = folded(a), folded(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def free_list(text: Column) -> Column:
    """The items of a list that commas, semicolons, bars or line ends part, trimmed."""
    return _filled(F.split(text, r"[;,\n|]+"))


def salvaged(raw: Column, inventory: list[str]) -> tuple[Column, Column]:
    """Concept ids that an invalid answer names, once each in order: those in the inventory, and the others. For diagnosis only."""
    ids = F.array_distinct(F.regexp_extract_all(raw, F.lit(r'"concept_id"\s*:\s*"([^"]+)"')))
    known = F.array(*map(F.lit, inventory))
    return F.filter(ids, lambda x: F.array_contains(known, x)), F.filter(ids, lambda x: ~F.array_contains(known, x))


def distractor(words: Column, entities: list[str], concepts: list[str], seed: str, key: Column) -> Column:
    """struct(word, concept): a word that isn't an entity with a concept of another, both picked by a hash of seed and key; null without such a word."""
    free = F.array_distinct(F.filter(words, lambda w: ~w.isin(*entities)))
    at = lambda tag, n: F.pmod(F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit(f"{seed}-{tag}"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), n).cast("int")
    word = F.when(F.size(free) > 0, F.get(free, at("word", F.greatest(F.size(free), F.lit(1)))))
    concept = F.get(F.array(*map(F.lit, concepts)), at("concept", F.lit(len(concepts))))
    return F.when(word.isNotNull(), F.struct(word.alias("word"), concept.alias("concept")))


def aligned(source: Column, target: Column, at: Column) -> Column:
    """The target's sentence beside the one in which the source's character `at` stands: of the same place, or the last one.

    Both are cut after full stops; the source's sentences are passed by their
    lengths until `at` is reached.
    """
    a, b = split_after(source, "."), split_after(target, ".")
    ends = F.aggregate(a, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.length(x) + 1)))
    place = F.size(F.filter(ends, lambda e: e <= at))
    return F.when(F.size(b) > 0, F.get(b, F.least(place, F.size(b) - 1)))
