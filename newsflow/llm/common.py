"""Helpers shared by the operators: tables, task code shipping, batches, text forms."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsflow.session import tune

# Rows and bytes of an Arrow batch: texts may be long, so a batch is bounded by both.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, and this package on every worker (once per application)."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_newsflow_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="newsflow-code-"), "newsflow_code.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("newsflow", os.path.relpath(full, top)))
        sc.addPyFile(path)
        sc._newsflow_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts_for(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def batch(**columns) -> pa.RecordBatch:
    """Record batch from named arrays or lists."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns)
    )


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each element when owner i has counts[i] elements."""
    counts = np.asarray(counts, dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - np.repeat(starts, counts)


def grouped_rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups of `key`, from batches in which equal keys follow each other.

    Many small groups come in one table. Only the group that is open is held back, so memory is bounded by
    the batch and the largest group; callers split groups that may be large.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key)
        last = keys[-1].as_py()
        first_of_last = _first_of_run(keys, last)
        if first_of_last == 0:
            if held and held[-1].column(key)[-1].as_py() != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        yield pa.Table.from_batches([*held, b.slice(0, first_of_last)])
        held = [b.slice(first_of_last)]
    if held:
        yield pa.Table.from_batches(held)


def _first_of_run(keys: pa.Array, last) -> int:
    """Where the run of the last key begins."""
    if keys.null_count or not pa.types.is_integer(keys.type):
        values = keys.to_pylist()
        i = len(values) - 1
        while i and values[i - 1] == last:
            i -= 1
        return i
    other = np.flatnonzero(keys.to_numpy(zero_copy_only=False) != last)
    return int(other[-1]) + 1 if len(other) else 0


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked to) for the links a-b, by label passing with shortcuts."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new
