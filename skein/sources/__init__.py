"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.packaging import canonical


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, keep: list[str] | None = None, literal_none: bool = False, sep: str = ",") -> DataFrame:
    """CSV with a header. A byte order mark is dropped; with literal_none, "None" and "" stay texts; `keep` prunes columns."""
    r = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    if literal_none:
        r = r.option("nullValue", "\u0000").option("emptyValue", "")
    df = (r.schema(schema) if schema else r.option("inferSchema", not literal_none)).csv(path)
    first = df.columns[0]
    if first.startswith("﻿"):
        df = df.withColumnRenamed(first, first.lstrip("﻿"))
    if literal_none:
        df = df.na.fill("")  # an empty field is an empty text
    return df.select(*[c for c in keep if c in df.columns]) if keep else df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON record a line; a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A whole JSON document."""
    return spark.read.option("multiLine", True).json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The last path component of each line, once."""
    return spark.read.text(path).select(F.element_at(F.split(F.trim("value"), "/"), -1).alias("id")).where("id <> ''").distinct()


def read_tolerant(spark: SparkSession, paths: list[str], key: str) -> tuple[DataFrame | None, list[str]]:
    """The union of the CSVs that have the key column, with their path, and those left out."""
    out, skipped = None, []
    for p in paths:
        try:
            df = read_csv(spark, p, literal_none=True)
        except Exception as e:  # an unreadable file is reported, not fatal
            skipped.append(f"{p}: {type(e).__name__}")
            continue
        if key not in df.columns:
            skipped.append(f"{p}: no {key}")
            continue
        df = df.withColumn("path", F.lit(p))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, skipped


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated triggers: pattern and kind."""
    return spark.read.option("sep", "\t").schema("pattern string, kind string").csv(path).where("pattern is not null")


def read_vectors(spark: SparkSession, path: str, ids: tuple[str, ...] = ("ids", "names", "vol"), values: tuple[str, ...] = ("emb", "embeddings", "img")) -> DataFrame:
    """A numpy archive as (id, embedding); for files of one machine's size, at the boundary."""
    import numpy as np

    x = np.load(path, allow_pickle=False)
    pick = lambda names: next(x[n] for n in names if n in x.files)
    return spark.createDataFrame([(str(i), [float(v) for v in e]) for i, e in zip(pick(ids), pick(values))], "id string, embedding array<float>")


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned if asked."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def _paths(spark: SparkSession, *paths: str):
    jvm = spark.sparkContext._jvm
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def rewrite(spark: SparkSession, path: str, change) -> None:
    """Replaces a table by what `change` makes of it.

    The new table is written beside the old one, which is then moved to a backup
    and deleted only when the new one has its name; a crash in between leaves the
    backup, which the next call puts back.
    """
    at = path.rstrip("/")
    fs, (table, staged, backup) = _paths(spark, at, at + ".staged", at + ".backup")
    if fs.exists(backup) and not fs.exists(table):
        fs.rename(backup, table)
    fs.delete(backup, True)
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(at + ".staged")
    for old, new in ((table, backup), (staged, table)):
        if not fs.rename(old, new):
            raise OSError(f"{old.toString()} could not be moved to {new.toString()}")
    fs.delete(backup, True)


def write_csv(df: DataFrame, path: str, digits: int | None = None, mark: bool = False) -> None:
    """CSV with a header; doubles with a fixed number of digits, and a byte order mark before the header, if asked."""
    if digits is not None:
        df = df.select(*(F.format_string(f"%.{digits}f", F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    """JSON records, one a line, with null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_jsonl_once(df: DataFrame, path: str) -> None:
    """Canonical JSON lines; an existing target is an error."""
    canonical(df).write.mode("errorifexists").text(path)


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, complete or not there at all; an existing one is an error."""
    fs, (target, part) = _paths(spark, path, path + ".part")
    if fs.exists(target):
        raise FileExistsError(path)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        raise OSError(f"{path} could not be written")


def write_unannotated(df: DataFrame, path: str, answers: list[str]) -> None:
    """CSV of a form to be filled in; a target in which some answer stands already isn't overwritten."""
    spark = df.sparkSession
    fs, (target,) = _paths(spark, path)
    if fs.exists(target):
        old = read_csv(spark, path, literal_none=True)
        filled = [c for c in answers if c in old.columns and old.where(F.trim(c) != "").limit(1).count()]
        if filled:
            raise FileExistsError(f"{path} has answers in {filled}")
    write_csv(df, path)
