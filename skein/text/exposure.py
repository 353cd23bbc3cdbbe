"""Which texts hold which snippets, whole and literally, whatever their case.

The snippets are written to the shared folder; each task scans its texts once for
every ITEMS of them with an Aho-Corasick automaton, in time linear in the text.
Nothing is broadcast and no pairs are made. Null and empty snippets are in no text;
a null text holds none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, ship
from ..shared import parquet_batches

#: Snippets that one automaton holds.
ITEMS = 2000


def exposure(docs: DataFrame, snippets: DataFrame, item: str, text: str, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, source, item) for every document (key, source, text) and each snippet (item, text) in it."""
    spark = docs.sparkSession
    ship(spark)
    folder = shared_folder(spark, "snippets")
    snippets.where(F.length(text) > 0).select(F.col(item).cast("long").alias("item"), F.lower(text).alias("text")).write.parquet(folder)
    kinds = dict(docs.dtypes)

    def run(batches):
        import ahocorasick

        machines = []

        def built():
            if not machines:
                for part in parquet_batches(folder, ITEMS):
                    at: dict[str, list[int]] = {}
                    for i, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                        at.setdefault(x, []).append(i)
                    machine = ahocorasick.Automaton()
                    for x, ids in at.items():
                        machine.add_word(x, tuple(ids))
                    machine.make_automaton()
                    machines.append(machine)
            return machines

        for batch in batches:
            texts, place, found = batch.column(2).to_pylist(), [], []
            for machine in built():
                for n, x in enumerate(texts):
                    if x:
                        hit = {i for _, ids in machine.iter(x) for i in ids}
                        place += [n] * len(hit)
                        found += sorted(hit)
            if place:
                rows = pa.array(place)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.int64())], [key, source, item])

    return docs.select(key, source, F.lower(text).alias("text")).mapInArrow(run, f"`{key}` {kinds[key]}, `{source}` {kinds[source]}, `{item}` bigint")
