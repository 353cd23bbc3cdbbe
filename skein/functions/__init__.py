"""Column expressions: identifiers, text normalisation, labels and closed-form statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_key(*parts: Column, size: int = 16) -> Column:
    """The first characters of the sha1 of pipe-joined parts; a null part reads as None."""
    return F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)).cast("binary")), 1, size)


def normal_phrase(text: Column, mask_numbers: bool = True) -> Column:
    """Lower case, numbers masked, runs of blanks as one space, trimmed: what makes two phrasings one template."""
    x = F.lower(text)
    if mask_numbers:
        x = F.regexp_replace(x, r"[0-9]+(\.[0-9]+)?", "<NUM>")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def template_id(text: Column) -> Column:
    """The id of a phrasing: 12 hex digits of its sha1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def binned(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the right-closed interval (edges[i], edges[i+1]] that holds x; null outside."""
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        hit = (x > lo) & (x <= hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def confusion_cell(gold: Column, pred: Column) -> Column:
    """TP, FN, FP or TN."""
    return F.when((gold == 1) & (pred == 1), "TP").when(gold == 1, "FN").when(pred == 1, "FP").otherwise("TN")


def agreement_word(kappa: Column) -> Column:
    """Landis and Koch's words for a kappa; the cut points are fixed values."""
    return F.when(kappa.isNull(), None).when(kappa < 0.01, "none").when(kappa <= 0.2, "slight").when(kappa <= 0.4, "fair").when(kappa <= 0.6, "moderate").when(kappa <= 0.8, "substantial").otherwise("almost perfect")


def ratio(a: Column, b: Column, undefined: float | None = None) -> Column:
    """a / b; where b is 0, null or the value given."""
    x = F.try_divide(a.cast("double"), b.cast("double"))
    return x if undefined is None else F.coalesce(x, F.lit(undefined))


def f1(tp: Column, fp: Column, fn: Column, undefined: float | None = None) -> Column:
    """The harmonic mean of precision and recall."""
    return ratio(2 * tp, 2 * tp + fp + fn, undefined)


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews' correlation; 0 where degenerate."""
    d = lambda c: c.cast("double")
    under = F.sqrt((d(tp) + d(fp)) * (d(tp) + d(fn)) * (d(tn) + d(fp)) * (d(tn) + d(fn)))
    return F.coalesce(F.try_divide(d(tp) * d(tn) - d(fp) * d(fn), under), F.lit(0.0))


def kappa(tp: Column, fp: Column, fn: Column, tn: Column, undefined: float | None = None) -> Column:
    """Cohen's kappa of two binary raters."""
    n = (tp + fp + fn + tn).cast("double")
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)).cast("double") / (n * n)
    x = F.when(pe == 1, None).otherwise(F.try_divide(po - pe, 1 - pe))
    return x if undefined is None else F.coalesce(x, F.lit(undefined))


def wilson(k: Column, n: Column, z: float = 1.959963985) -> tuple[Column, Column]:
    """Wilson's interval of a proportion, within 0 and 1; null for n = 0."""
    p, z2 = F.try_divide(k.cast("double"), n.cast("double")), z * z
    mid = F.try_divide(p + z2 / (2 * n), 1 + z2 / n)
    half = F.try_divide(z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)) + z2 / (4 * n * F.nullif(n, F.lit(0)))), 1 + z2 / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def chance_f1(a: Column, c: Column, n: Column) -> Column:
    """The F1 that independent labels with a and c positives of n would reach."""
    return ratio(2 * a * c, n * (a + c))


def volume_parts(name: Column) -> dict[str, Column]:
    """split, patient, study and recon of a name like train_1_a_2.nii.gz: its first one to four parts."""
    parts = F.split(F.regexp_replace(name, r"\.nii\.gz", ""), "_")
    joined = lambda n: F.array_join(F.slice(parts, 1, n), "_")
    return {"split": F.get(parts, F.lit(0)), "patient": joined(2), "study": joined(3), "recon": joined(4)}


def age_years(text: Column) -> Column:
    """The first number of an age such as 063Y; null without one."""
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("double")


def one_hot(x: Column, values: list[str], prefix: str) -> list[Column]:
    """A 0 or 1 column for each value; null is none of them."""
    return [F.coalesce(x == v, F.lit(False)).cast("int").alias(f"{prefix}{v}") for v in values]


def any_true(*flags: Column) -> Column:
    """Whether some flag holds; null counts as false."""
    return F.exists(F.array(*flags), lambda x: F.coalesce(x, F.lit(False)))


def all_true(*flags: Column) -> Column:
    """Whether every flag holds; null counts as false."""
    return F.forall(F.array(*flags), lambda x: F.coalesce(x, F.lit(False)))


def filled(df, columns: list[str]):
    """The frame with null texts as empty ones and blanks at the ends taken off, in the columns named."""
    return df.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in columns})


def joined_sections(findings: Column, impression: Column) -> Column:
    """Both sections with an empty line between, without white space at the ends; an empty one leaves no line."""
    return strip(F.concat_ws("\n\n", F.nullif(strip(findings), F.lit("")), F.nullif(strip(impression), F.lit(""))))


def list_column(text: Column) -> Column:
    """The numbers of a list written as text, in square or round brackets."""
    return F.from_json(F.translate(text, "()", "[]"), "array<double>")
