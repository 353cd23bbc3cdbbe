"""Adapters for external models, and the strict contract of their output."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..text import surface
from ..text.segment import lossless

ASSERTIONS = ("present", "absent", "uncertain")


class Adapter(Protocol):
    """A model: a name and a function from texts to texts."""

    name: str

    def run(self, texts: list[str]) -> list[str]:
        """One output for each text, in order."""


def parse_output(raw: str | None, inventory: set[str]) -> tuple[list[tuple[str, str]] | None, str | None]:
    """(pairs, error) of a model's JSON: exactly {"findings": [{"concept_id", "assertion"}]}, closed sets, no repeated concept."""
    try:
        x = json.loads(raw or "")
    except (ValueError, RecursionError):
        return None, "not_json"
    if not isinstance(x, dict) or set(x) != {"findings"}:
        return None, "keys"
    if not isinstance(x["findings"], list):
        return None, "not_a_list"
    out: list[tuple[str, str]] = []
    for f in x["findings"]:
        if not isinstance(f, dict) or set(f) != {"concept_id", "assertion"}:
            return None, "finding_keys"
        if not isinstance(f["concept_id"], str) or f["concept_id"] not in inventory:
            return None, "inventory"
        if not isinstance(f["assertion"], str) or f["assertion"] not in ASSERTIONS:
            return None, "assertion"
        if (f["concept_id"], f["assertion"]) in out:
            return None, "repeated"
        out.append((f["concept_id"], f["assertion"]))
    return out, None


def parsed(inventory: set[str]) -> Callable[[Column], Column]:
    """The contract as a column function: struct(ok, findings, error)."""

    @F.pandas_udf("struct<ok:boolean,findings:array<struct<concept_id:string,assertion:string>>,error:string>")
    def run(raw: pd.Series) -> pd.DataFrame:
        rows = [parse_output(x, inventory) for x in raw]
        return pd.DataFrame({"ok": [e is None for _, e in rows], "findings": [[{"concept_id": c, "assertion": a} for c, a in p] if p is not None else None for p, _ in rows], "error": [e for _, e in rows]})

    return run


class BySentence:
    """An adapter that runs another one on single sentences and puts the results back where they stood, with all that lies between."""

    def __init__(self, adapter: Adapter):
        self.adapter, self.name = adapter, f"{adapter.name}, by sentence"

    def run(self, texts: list[str]) -> list[str]:
        """One output for each text, in order; blank texts and sentences stay as they are."""
        parts = [lossless(t or "") for t in texts]
        asked = [(n, i, p) for n, x in enumerate(parts) for i, p in enumerate(x) if i % 2 == 0 and p.strip()]
        done = self.adapter.run([p for _, _, p in asked])
        if len(done) != len(asked):
            raise ValueError(f"{self.adapter.name}: every sentence needs one output")
        for (n, i, _), out in zip(asked, done):
            parts[n][i] = out
        return ["".join(x) for x in parts]


def apply_adapter(df: DataFrame, key: str, text: str, adapter: Adapter) -> DataFrame:
    """(key, output) of every row; an adapter that returns another number of texts, or a blank one, fails.

    An adapter with `run_named` is given (key, text) pairs and returns (key, output)
    pairs, whose keys must come back in the same order.
    """

    def run(batches):
        for b in batches:
            if hasattr(adapter, "run_named"):
                named = adapter.run_named(list(zip(b[key].tolist(), b[text].tolist())))
                if [k for k, _ in named] != b[key].tolist():
                    raise ValueError(f"{adapter.name}: the keys came back in another order")
                out = [x for _, x in named]
            else:
                out = adapter.run(b[text].tolist())
            if len(out) != len(b) or any(not (x or "").strip() for x in out):
                raise ValueError(f"{adapter.name}: every text needs one output that isn't blank")
            yield pd.DataFrame({key: b[key], "output": out})

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, output string")


def post_edited(df: DataFrame, key: str, text: str, adapter: Adapter, leaks: str) -> DataFrame:
    """(key, text, output, class, faults, broken) of a correcting adapter: what it did to numbers and units, and what shows that it rewrote the text."""
    out = df.select(key, text).join(apply_adapter(df, key, text, adapter), key)
    numbers = surface.signature_diff(out, key, text, "output", surface.numbers)
    units = surface.signature_diff(out, key, text, "output", surface.units).toDF(key, "du", "au")
    x = out.join(numbers, key).join(units, key)
    x = x.select(key, text, "output", surface.edit_class(F.col("dropped"), F.col("added"), F.col("du"), F.col("au")).alias("class"), surface.rewriting_faults(F.col(text), F.col("output"), leaks).alias("faults"))
    return x.withColumn("broken", (F.col("class") != "clean") | (F.size("faults") > 0))


def prompt(template: str, inventory: set[str], text: Column) -> Column:
    """The prompt of each text: the sorted inventory and the text put in literally."""
    return F.replace(F.lit(template.replace("{INVENTORY}", "\n".join(sorted(inventory)))), F.lit("{TEXT}"), text)


def stop_early(violations: list[bool], first: int = 8, ratio: float = 0.6) -> bool:
    """Whether an ordered run stops: so many of its first documents broke a rule."""
    return len(violations) >= first and sum(violations[:first]) / first >= ratio
