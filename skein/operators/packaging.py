"""Fingerprints, canonical records, blind packages, provenance."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import draw


def fingerprint(df: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The sha256 of a group's sorted ids, one a line. For lock lists: a group is gathered into one row."""
    ids = F.concat(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), "\n"), F.lit("\n"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("sha256"))


def verify_lock(df: DataFrame, name: str, key: str, locked: dict[str, str]) -> DataFrame:
    """(name, n, sha256, state): the lists derived again, each holding, differing from its locked fingerprint, or missing in the lock."""
    x = fingerprint(df, key, (name,))
    known = F.create_map(*(F.lit(v) for kv in (locked | {"": ""}).items() for v in kv))[F.col(name)]
    return x.withColumn("state", F.when(known.isNull(), "missing").when(known == F.col("sha256"), "holds").otherwise("differs"))


def table_hash(df: DataFrame) -> DataFrame:
    """(n, sha256) of all rows as canonical JSON lines in their own order. For packages, which are small by nature: the lines are gathered into one row."""
    lines = F.concat(F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit("\n"))
    return canonical(df).agg(F.count("*").alias("n"), F.sha2(lines, 256).alias("sha256"))


def balanced_order(df: DataFrame, key: str, arrangements: list[str], seed: str) -> DataFrame:
    """Adds `arrangement`: dealt in turn over the rows in drawn order, so each occurs equally often."""
    from .ranks import running

    x = df.withColumn("__d", draw(seed, key)).withColumn("__h", F.conv(F.substring("__d", 1, 12), 16, 10).cast("double"))
    placed = running(x, "__h", {"__k": F.lit(1)}, (), ["__d", key])
    pick = F.element_at(F.array(*map(F.lit, arrangements)), (F.col("__k") % len(arrangements) + 1).cast("int"))
    return placed.withColumn("arrangement", pick).drop("__d", "__h", "__k")


def paired(df: DataFrame, variants: dict[str, str]) -> DataFrame:
    """(document_id, document_order, variant, text): each document once for each variant's text column."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.col(c).alias("text")) for k, c in variants.items())))
    return df.select("document_id", "document_order", rows.alias("x")).select("document_id", "document_order", "x.variant", "x.text")


def canonical(df: DataFrame) -> DataFrame:
    """Each row as JSON with its fields in name order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def records_hash(records: list[dict]) -> str:
    """The sha256 of records in order, each as canonical JSON on a line."""
    h = hashlib.sha256()
    for r in records:
        h.update(json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode() + b"\n")
    return h.hexdigest()


def blind(df: DataFrame, key: str, visible: list[str], hidden: list[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """(visible, key) tables of a package under case numbers in drawn order."""
    from .ranks import running

    x = df.withColumn("__d", draw(seed, key)).withColumn("__h", F.conv(F.substring("__d", 1, 12), 16, 10).cast("double"))
    numbered = running(x, "__h", {"__k": F.lit(1)}, (), ["__d", key]).withColumn("case_id", F.format_string("case-%08d", F.col("__k")))
    return numbered.select("case_id", *visible), numbered.select("case_id", key, *hidden)


def write_package(df: DataFrame, key: str, visible: list[str], hidden: list[str], seed: str, folder: str, about: dict) -> dict:
    """Writes the visible and the key table of a blind package and a manifest with their counts and hashes; nothing may be there yet."""
    from ..sources import write_jsonl_once, write_text_once

    manifest = dict(about)
    for name, part in zip(("visible", "key"), blind(df, key, visible, hidden, seed)):
        write_jsonl_once(part, f"{folder}/{name}")
        manifest[name] = table_hash(part).first().asDict()
    write_text_once(df.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True) + "\n")
    return manifest


def lock_annotations(annotations: DataFrame, blind_package: DataFrame, keys: list[str], fixed: list[str], annotator: str, folder: str) -> dict:
    """Writes finished annotations and a manifest once, if they cover the blind package and change none of its fixed columns."""
    from ..sources import write_jsonl_once, write_text_once
    from .gates import GateError, annotated

    broken = annotated(annotations, blind_package, keys, fixed).where("violations > 0").collect()
    if broken:
        raise GateError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
    write_jsonl_once(annotations, f"{folder}/annotations")
    manifest = {"annotator": annotator, "blind": table_hash(blind_package.select(*keys, *fixed)).first().asDict(), "annotations": table_hash(annotations).first().asDict(), "locked_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    write_text_once(annotations.sparkSession, f"{folder}/annotations.manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    return manifest


def check_package(df: DataFrame, expected: dict, name: str) -> None:
    """Fails unless the table has the number of rows and the hash that a manifest says."""
    got = table_hash(df).first().asDict()
    if got != expected:
        raise ValueError(f"{name} isn't what its manifest says")


def provenance(adapter: str, settings: dict, inputs: str, outputs: str, rows: int) -> dict:
    """What is noted beside an output."""
    return {"adapter": adapter, "settings": settings, "input_sha256": inputs, "output_sha256": outputs, "rows": rows, "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")}
