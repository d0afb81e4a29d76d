"""Exact duplicates by content sort.

Spark samples splitters and range-partitions the rows by (first normalised bytes, digest, identifier); an external
sort within each partition puts equal texts side by side, and neighbours are compared in full. As the identifier is
part of the range key, a text that a third of all rows share spreads over as many partitions as its size asks for:
such a run is cut into one run per partition, and only the first and last run of a partition can have a
continuation elsewhere. Those edge runs (two a partition at most) are summed up and broadcast.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Among rows with a null
identifier, none is preferred to one that has an identifier. Rows that repeat both text and identifier count each
in the group size, and one of them is kept. An empty table gives an empty result. Other columns, whatever their
names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, partitions, staged

HEAD = 32  # normalised bytes that lead the sort key


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lower = [(x or b"").lower() for x in b.column(1).cast(pa.binary()).to_pylist()]
        head = pa.array([x[:HEAD] for x in lower], pa.binary())
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in lower], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, head, sha], names=[*b.schema.names, "head", "sha"])


def _runs(best: Callable, whole: bool, schema: pa.Schema) -> Callable:
    """Rows of sorted partitions with the keeper and size of their run; ``whole``: only each run's first row, with all it carries."""

    def flush(run: list, ids: list, edge: bool) -> dict:
        known = [x for x in ids if x is not None]
        keep, n = best(known) if known else None, len(ids)
        if whole:
            return {"row": run[:1], "id": [ids[0]], "sha": [run[0]["sha"]], "keep_id": [keep], "group_size": [n], "edge": [edge], "first": [True]}
        again = [i > 0 and ids[i - 1] == x for i, x in enumerate(ids)]
        return {"id": ids, "sha": [run[0]["sha"]] * n, "keep_id": [keep] * n, "group_size": [n] * n, "edge": [edge] * n, "first": [i == 0 for i in range(n)], "again": again}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        ready, volume, opened = 0, 0, False  # opened: the partition's first run is over
        head, body, ids = None, None, []

        def packed() -> pa.RecordBatch:
            cols = {k: [x for part in out for x in part[k]] for k in out[0]}
            if whole:
                rows = cols.pop("row")
                cols |= {"text": [r["text"] for r in rows], "rest": [r["rest"] for r in rows]}
            out.clear()
            return pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in schema}, schema=schema)

        for b in batches:
            texts, shas, keys = b.column("text").cast(pa.binary()).to_pylist(), b.column("sha").to_pylist(), b.column("id").to_pylist()
            rest = b.column("rest") if whole else None
            for i, text in enumerate(texts):
                lower = (text or b"").lower()
                if head is not None and head["sha"] == shas[i] and body == lower:
                    ids.append(keys[i])
                    continue
                if head is not None:
                    out.append(flush([head], ids, not opened))
                    ready, volume, opened = ready + len(ids), volume + whole * len(body), True
                    if ready >= 16384 or volume > 1 << 22:
                        yield packed()
                        ready = volume = 0
                head, body, ids = {"sha": shas[i]}, lower, [keys[i]]
                if whole:
                    head |= {"text": text, "rest": rest[i].as_py()}
        if head is not None:
            out.append(flush([head], ids, True))
            yield packed()

    return run


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, carried: list[str]) -> DataFrame:
    frame = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*(F.col(f"`{c}`") for c in carried)).alias("rest")] if carried else []))
    schema = T.StructType([*frame.schema.fields, T.StructField("head", T.BinaryType()), T.StructField("sha", T.StringType())])
    first: Column = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    return frame.mapInArrow(_digest, schema).repartitionByRange(partitions(docs.sparkSession), "head", "sha", first).sortWithinPartitions("head", "sha", first)


def _joined(runs: DataFrame, keep: str) -> DataFrame:
    """Runs that continue in another partition get their common keeper and size."""
    extreme = F.min if keep == "min" else F.max
    edges = runs.where("edge and first").groupBy("sha").agg(extreme("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
    return (
        runs.join(F.broadcast(edges), "sha", "left")  # two rows a partition at most
        .withColumn("keep_id", F.when(F.col("edge"), F.col("all_keep")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.when(F.col("edge"), F.col("all_size")).otherwise(F.col("group_size")))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256. ``keep``: min or max identifier stays."""
    schema = "id long, sha string, keep_id long, group_size long, edge boolean, first boolean, again boolean"
    arrow = pa.schema([("id", pa.int64()), ("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("edge", pa.bool_()), ("first", pa.bool_()), ("again", pa.bool_())])
    runs = staged(_sorted(docs, id_col, text_col, keep, []).mapInArrow(_runs(min if keep == "min" else max, False, arrow), schema), "exact-runs")
    # without any identifier in its group, a row at the start of a run is the one that stays
    kept = F.when(F.col("keep_id").isNull(), F.col("first")).otherwise(F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("again"))
    return _joined(runs, keep).select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they were."""
    from pyspark.sql.pandas.types import to_arrow_schema

    carried = [c for c in docs.columns if c != text_col]
    ordered = _sorted(docs, id_col, text_col, keep, carried)
    fields = {f.name: f for f in ordered.schema.fields}
    schema = T.StructType([fields["text"], fields["rest"], fields["id"], fields["sha"], T.StructField("keep_id", T.LongType()), T.StructField("group_size", T.LongType()), T.StructField("edge", T.BooleanType()), T.StructField("first", T.BooleanType())])
    heads = staged(ordered.mapInArrow(_runs(min if keep == "min" else max, True, to_arrow_schema(schema)), schema), "exact-heads")
    stays = _joined(heads, keep).where(F.col("keep_id").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    return stays.select(*(F.col("text").alias(text_col) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns))
