"""Homomorphic multiset fingerprints of documents.

Every paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors modulo
2^16 per lane (2^32 in the like lanes). Order does not matter, and a paragraph is put in or taken out by adding or subtracting its vector.
A vector has two parts: EXACT_LANES uniform lanes of the whole paragraph, which tell multisets of paragraphs
apart, and LIKE_LANES lanes of twice the width that sum a Cauchy value per word shingle of the paragraph. Such sums
are spread by the sum of absolute differences, so they measure how many shingles two documents do not share, a
shingle repeated m times m times, within a paragraph or over many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import batch, parts_for, texts_of

EXACT_LANES = 64
LIKE_LANES = 128
# Low halves of the like lanes, then their high halves.
LANES = EXACT_LANES + 2 * LIKE_LANES
SHINGLE_WORDS = 3
# The last lane pair holds the number of shingles, so likeness needs nothing but two fingerprints.
COUNT_LANES = 2
WIDTH = LANES + COUNT_LANES
# Cauchy values are whole numbers in units of 1 / SCALE, up to MOST in size.
SCALE = 16
MOST = 1 << 22
# Shingles taken through all lanes in one array step.
STEP_SHINGLES = 512


def paragraphs(text: str) -> list[str]:
    """Lines of a text. The empty text has none, so its fingerprint is zero; empty lines of other texts count."""
    return text.split("\n") if text else []


def shingles(paragraph: bytes) -> list[bytes]:
    """Word shingles of a paragraph, repeats included; a short one is one shingle, a blank one has none."""
    words = paragraph.split()
    if len(words) <= SHINGLE_WORDS:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(SHINGLE_WORDS)])))


@cache
def _cauchy() -> tuple[np.ndarray, np.ndarray]:
    """(odd factor of each lane, Cauchy value of each 16-bit number), the same in every task."""
    factors = np.random.default_rng(13).integers(0, 2 ** 31, LIKE_LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    values = np.tan(np.pi * ((np.arange(65_536) + 0.5) / 65_536 - 0.5))
    return factors, np.rint(SCALE * values).astype(np.int32)


def _cauchy_sums(hashes: np.ndarray) -> np.ndarray:
    """Sum over 32-bit hashes of their Cauchy value in each lane, modulo 2^32."""
    factors, values = _cauchy()
    total = np.zeros(LIKE_LANES, dtype=np.int32)
    for i in range(0, len(hashes), STEP_SHINGLES):
        mixed = hashes[i:i + STEP_SHINGLES, None] * factors
        at = (mixed >> np.uint32(16)).astype(np.uint16)
        found = values.take(at)
        # The two outermost numbers hold the long tails: the lower bits say how far out.
        ends = np.flatnonzero((at + np.uint16(1)).ravel() <= 1)
        if len(ends):
            rest = ((mixed.ravel()[ends] & np.uint32(0xFFFF)).astype(np.float64) + 0.5) / 65_536
            out = np.minimum(1 / np.tan(np.pi * rest / 65_536), MOST)
            found.ravel()[ends] = np.rint(SCALE * np.where(at.ravel()[ends] == 0, -out, out)).astype(np.int32)
        total += found.sum(axis=0, dtype=np.int32)
    return total.astype(np.int64)


def vector(parts: Iterable[str]) -> np.ndarray:
    """Sum of the vectors of paragraphs, modulo 2^16 per lane."""
    total = np.zeros(WIDTH, dtype=np.int64)
    hashes: list[int] = []
    for part in parts:
        data = part.encode("utf-8", "surrogatepass")
        total[:EXACT_LANES] += np.frombuffer(hashlib.shake_128(data).digest(2 * EXACT_LANES), dtype="<u2")
        hashes += map(xxhash.xxh32_intdigest, shingles(data))
    _set_sums(total, _cauchy_sums(np.array(hashes, dtype=np.uint32)))
    total[LANES:] = len(hashes) & 0xFFFF, len(hashes) >> 16
    return total.astype(np.uint64).astype(np.uint16)


def _set_sums(v: np.ndarray, sums: np.ndarray) -> None:
    v[EXACT_LANES:EXACT_LANES + LIKE_LANES] = sums & 0xFFFF
    v[EXACT_LANES + LIKE_LANES:LANES] = sums >> 16 & 0xFFFF


def _sums(v: np.ndarray) -> np.ndarray:
    """Like lanes modulo 2^32."""
    return v[EXACT_LANES:EXACT_LANES + LIKE_LANES].astype(np.int64) | v[EXACT_LANES + LIKE_LANES:LANES].astype(np.int64) << 16


def document_vector(text: str | None) -> np.ndarray:
    return vector(paragraphs(text or ""))


def _count(v: np.ndarray) -> int:
    return int(v[LANES]) | int(v[LANES + 1]) << 16


def _add(a: np.ndarray, b: np.ndarray, sign: int) -> np.ndarray:
    out = (a.astype(np.int64) + sign * b.astype(np.int64)) & 0xFFFF
    _set_sums(out, _sums(a) + sign * _sums(b))
    count = _count(a) + sign * _count(b)
    out[LANES:] = count & 0xFFFF, count >> 16 & 0xFFFF
    return out.astype(np.uint16)


def insert(fingerprint: np.ndarray, *parts: str) -> np.ndarray:
    """Fingerprint after paragraphs were added anywhere."""
    return _add(fingerprint, vector(parts), 1)


def remove(fingerprint: np.ndarray, *parts: str) -> np.ndarray:
    """Fingerprint after paragraphs were taken out."""
    return _add(fingerprint, vector(parts), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of shingles two documents have in common, 0 to 1, 1 for equal fingerprints.

    The differences per lane are Cauchy values, spread by the number of shingles that only one of them has, repeats
    included. Their most likely spread gives it, give or take the sampling error of LIKE_LANES lanes (an eighth).
    """
    if np.array_equal(a, b):
        return 1.0
    total = _count(a) + _count(b)
    if not total:
        return 0.0
    gap = np.abs((_sums(a) - _sums(b)).astype(np.uint32).astype(np.int32).astype(np.float64)) / SCALE
    return float(min(1.0, max(0.0, 1.0 - _spread(gap) / total)))


def _spread(sizes: np.ndarray) -> float:
    """Most likely scale of Cauchy values of these sizes."""
    low, high = 0.0, float(sizes.max())
    squares = sizes * sizes
    for _ in range(40):
        middle = (low + high) / 2
        if np.sum(squares / (squares + middle * middle + 1e-12)) > len(sizes) / 2:
            low = middle
        else:
            high = middle
    return high


def text_form(v: np.ndarray) -> str:
    return v.astype("<u2").tobytes().hex()


def from_text(form: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(form), dtype="<u2")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every text; null is the empty text. Other columns are ignored, repeated rows kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(doc_id=b.column(0), fingerprint=[text_form(document_vector(t)) for t in texts_of(b.column(1))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


# ---- a document and the next one

def _chunks(ids: pd.Series, borders: np.ndarray) -> np.ndarray:
    """Number of the chunk each id lies in: a border opens a chunk, null ids lie in the first."""
    known = ids.notna().to_numpy()
    out = np.zeros(len(ids), dtype=np.int32)
    out[known] = np.searchsorted(borders, ids[known].astype("int64").to_numpy(), side="right")
    return out


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one by ascending id; after the last, the first.

    Null ids come first, equal ids are ordered by text; a table of one row follows itself. Ids are cut at borders
    into chunks of about equal counts, each chunk is one sorted run, and the first document of a chunk is also sent
    to the end of the chunk before it: texts are shuffled once, and no task holds more than a batch of its chunk.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or 4 * parts_for(docs)
    probes = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    borders = np.unique(np.array(narrow.agg(F.percentile_approx("doc_id", probes, 100_000)).first()[0] or [], dtype=np.int64))

    @F.pandas_udf("int")
    def chunk(ids: pd.Series) -> pd.Series:
        return pd.Series(_chunks(ids, borders))

    firsts = narrow.select("doc_id", chunk("doc_id").alias("chunk")).groupBy("chunk").agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("chunk").collect()
    order = np.array([r["chunk"] for r in firsts], dtype=np.int64)
    nulls = any(r["nulls"] for r in firsts)
    lows = np.array([r["low"] for r in firsts if r["low"] is not None and not (r["nulls"])], dtype=np.int64)

    @F.pandas_udf("int")
    def back(ids: pd.Series) -> pd.Series:
        """Chunk before the one that this document opens, null if it opens none."""
        at = np.searchsorted(order, _chunks(ids, borders))
        first = np.isin(ids.fillna(0).astype("int64").to_numpy(), lows) & ids.notna().to_numpy()
        if nulls:
            first |= ids.isna().to_numpy()
        return pd.Series(order[at - 1]).where(first).astype("Int32")

    rows = narrow.select("doc_id", "text", chunk("doc_id").alias("own"), back("doc_id").alias("before")).select(
        "doc_id", "text", F.explode(F.filter(F.array(
            F.struct(F.col("own").alias("to"), F.lit(False).alias("guest")),
            F.struct(F.col("before").alias("to"), F.lit(True).alias("guest"))), lambda s: s["to"].isNotNull())).alias("s"),
    ).select("doc_id", "text", "s.to", "s.guest")
    sorted_rows = rows.repartition(parts, "to").sortWithinPartitions(
        "to", "guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for doc_id, text, to, guest in zip(*[c.to_pylist() for c in b.columns]):
                if held is not None and held[2] == to:
                    out.append((held[0], held[1], text))
                held = None if guest else (doc_id, text, to)
            yield batch(doc_id=pa.array([r[0] for r in out], pa.int64()), text=pa.array([r[1] for r in out], pa.string()),
                        next_text=pa.array([r[2] for r in out], pa.string()))

    return sorted_rows.mapInArrow(run, "doc_id long, text string, next_text string")


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and of its edited text, and likeness to the edited text and the next document.

    The edited text keeps the first part of the document and ends in as many characters of the start of the next
    document as were cut off, or all of it. Null texts are empty. One row per input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = "", document_vector("")
        for b in batches:
            rows = []
            for text, following in zip(texts_of(b.column(1)), texts_of(b.column(2))):
                half = len(text) // 2
                edited = text[:len(text) - half] + following[:half]
                # Rows come in order: the next document of one row is mostly the document of the next row.
                own = other if text == last else document_vector(text)
                changed, last, other = document_vector(edited), following, document_vector(following)
                rows.append((len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), text_form(own), text_form(changed),
                             likeness(own, changed), likeness(own, other)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield batch(doc_id=b.column(0), n_chars=pa.array(cols[0], pa.int64()), edited_sha256=pa.array(cols[1], pa.string()),
                        fingerprint=pa.array(cols[2], pa.string()), edited_fingerprint=pa.array(cols[3], pa.string()),
                        near_edited=pa.array(cols[4], pa.float64()), near_next=pa.array(cols[5], pa.float64()))

    return with_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
