"""Packing of token sequences into rows of fixed length by patterns of few documents.

Only the histogram of piece lengths, at most one count per length, decides the packing. Patterns of one to
three lengths that fill a row are fitted to the histogram by non-negative least squares, rounded to whole
repeats, and what is left over is packed best-fit decreasing, all on counts. A plan says for each length which
ranks go to which row and place; pieces look their place up by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.bpe import Shared, encoder, read_spec
from newsflow.llm.common import batch, parts_for, texts_of
from newsflow.session import cut_lineage

ROW_TOKENS = 2048
# Middle lengths of patterns of three documents: every so many tokens.
PATTERN_STEP = 128
FIT_ROUNDS = 400


def pieces(
    docs: DataFrame, path: str, end_id: int = 0, size: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents as tokens plus an end token, cut after every `size` tokens.

    A null or empty text is the end token alone. Repeated rows and null ids are kept; other columns are ignored.
    """
    shared = Shared(docs.sparkSession, read_spec(path), None)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(shared).encode
        for b in batches:
            rows, owners, numbers, starts, lengths, sums, ids = b.column(0), [], [], [], [], [], []
            for i, text in enumerate(texts_of(b.column(1))):
                data = to_ids(text) + end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at:at + 4 * size]
                    owners.append(i)
                    numbers.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            out = dict(doc_id=rows.take(pa.array(owners, pa.int32())), piece=pa.array(numbers, pa.int32()), start=pa.array(starts, pa.int64()),
                       length=pa.array(lengths, pa.int64()), ids_crc32=pa.array(sums, pa.int64()))
            yield batch(**out, ids=pa.array(ids, pa.list_(pa.int32()))) if with_ids else batch(**out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


# ---- the plan, on the histogram

def patterns(present: np.ndarray, size: int, step: int = PATTERN_STEP) -> np.ndarray:
    """Patterns of one, two or three of the lengths present that fill a row, as rows of three lengths, 0 for none."""
    has = np.zeros(size + 1, dtype=bool)
    has[present] = True
    has[0] = True
    found = []
    for middle in [0, *range(step, size, step)]:
        if not has[middle]:
            continue
        low = np.arange(0 if middle == 0 else 1, (size - middle) // 2 + 1)
        high = size - middle - low
        fits = has[low] & has[high]
        found.append(np.stack([high[fits], np.full(fits.sum(), middle), low[fits]], axis=1))
    rows = -np.sort(-np.concatenate(found), axis=1)
    return np.unique(rows, axis=0)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Non-negative repeats x of each pattern that make A x closest to the histogram, by multiplicative steps."""
    used = rows > 0
    flat, owner = rows[used], np.nonzero(used)[0]
    size = len(counts)
    weight = 1.0 / np.sqrt(np.maximum(counts, 1.0))  # rare lengths matter as much as common ones
    goal = np.bincount(owner, (counts * weight)[flat], len(rows))
    x = np.full(len(rows), counts.sum() / max(1, len(flat)))
    for _ in range(rounds):
        made = np.bincount(flat, x[owner], size)
        x *= goal / np.maximum(np.bincount(owner, (made * weight)[flat], len(rows)), 1e-12)
    return x


class Plan:
    """Rows as (pattern, count), in order: the pattern's lengths fill its rows from the left."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.rows: list[tuple[tuple[int, ...], int]] = []

    def segments(self) -> tuple[np.ndarray, ...]:
        """Sorted by (length, first rank): length, first rank, first row, offset. Rank r goes to row first + (r - first rank)."""
        taken = np.zeros(self.size + 1, dtype=np.int64)
        out, row = [], 0
        for pattern, count in self.rows:
            at = 0
            for length in pattern:
                out.append((length, taken[length], row, at))
                taken[length] += count
                at += length
            row += count
        table = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
        return tuple(table.T)


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths: equal rows are handled together."""
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room = np.zeros(size + 1, dtype=bool)

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        opened.setdefault(space, []).append((pattern, n))
        room[space] = True

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(room[length:])
            if not len(fits):
                each = size // length
                if left >= each:
                    put(size - each * length, (length,) * each, left // each)
                if left % each:
                    put(size - left % each * length, (length,) * (left % each), 1)
                break
            space = length + int(fits[0])
            pattern, n = opened[space].pop()
            if not opened[space]:
                room[space] = False
            now = min(left, n)
            if now < n:
                put(space, pattern, n - now)
            put(space - length, (*pattern, length), now)
            left -= now
    return [x for found in opened.values() for x in found]


def make_plan(histogram: dict[int, int], size: int = ROW_TOKENS) -> Plan:
    """Rows for `histogram` (length -> count). Cost depends on the number of lengths, not on the counts."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan = Plan(size)
    if not counts.sum():
        return plan
    rows = patterns(np.flatnonzero(counts), size)
    repeats = np.rint(fit(rows, counts.astype(float))).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    left = counts.copy()
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        pattern = tuple(int(x) for x in rows[i] if x)
        n = int(min(repeats[i], *(left[x] // pattern.count(x) for x in pattern)))
        if n > 0:
            plan.rows.append((pattern, n))
            for x in pattern:
                left[x] -= n
    plan.rows += best_fit(left, size)
    return plan


# ---- places of the pieces

def place(pieces_df: DataFrame, size: int = ROW_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces with a `length` from 1 to `size`.

    A piece's rank among those of its length is its rank in a slice of them plus the counts of the slices
    before it, so a common length is many groups. `pieces_df` must give the same rows each time it is read.
    Its other columns are kept.
    """
    histogram = {r["length"]: r["n"] for r in pieces_df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, size)
    shared = pieces_df.sparkSession.sparkContext.broadcast(plan.segments())  # bounded by the size of a row
    names = pieces_df.columns
    slices = 4 * parts_for(pieces_df)
    sliced = pieces_df.withColumn("_slice", F.pmod(F.xxhash64(*names), F.lit(slices).cast("long")))
    counted = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counted.select("length", "_slice", (F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n")).alias("_before"))
    ranked = sliced.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*names)) - 1)
    ranked = ranked.join(before, ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*names, "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, rows, offsets = shared.value
        keys = lengths << 48 | firsts
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            columns = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[at] + rank - firsts[at]), pa.array(offsets[at])],
                                             names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces_df.schema.fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(
    docs: DataFrame, path: str, end_id: int = 0, size: int = ROW_TOKENS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece, in rows of at most `size` tokens.

    Texts are tokenized once; the narrow table of pieces is cut off with a checkpoint. An empty table gives an
    empty one.
    """
    return place(cut_lineage(pieces(docs, path, end_id, size, id_col, text_col)), size)
