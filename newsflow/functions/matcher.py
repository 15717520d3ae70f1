"""Entries of a lexicon found in the tokens of texts: a lexicon too large for literals, sent to every worker once.

A word of letters alone stands in a text if it is inside one of the text's tokens, so tokens are searched, each once
for many texts. Phrases of such words are found by pairs of their words. Texts are taken in array steps.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The functions below travel with the task, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Flags of texts and entries, and candidates, in one array step.
STEP_FLAGS = 16_000_000
STEP_PAIRS = 2_000_000
# Running hash of letters, and bits of it by which places are sorted out.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TABLE_BITS = 18

# A token is a run of word letters; lines end with a token of their own.
TOKENS = r"(?U)\w+|\n"


def tokens(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(TOKENS), F.lit(0))


def lists(rows: Iterable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, starts, numbers) of lists of numbers."""
    rows = list(rows)
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return counts, np.cumsum(counts) - counts, np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of each element when owner i has counts[i] elements."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def numbered(rows: Iterable[str]) -> dict[str, int]:
    return {x: i for i, x in enumerate(dict.fromkeys(rows))}


def grouped(keys: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Different keys in order, and for each the places it is at."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    starts = np.flatnonzero(np.diff(held, prepend=-1))
    return held[starts], (np.diff(starts, append=len(held)), starts, order)


class Finder:
    """Words that are looked for in tokens, by length and a running hash of their letters; what has the hash is compared."""

    def __init__(self, words: Iterable[str]) -> None:
        self.number = numbered(words)
        by_size: dict[int, list[str]] = {}
        for word in self.number:
            by_size.setdefault(len(word), []).append(word)
        by_size.pop(0, None)
        self.sizes = {}
        for size, own in by_size.items():
            letters = letters_of(own).reshape(len(own), size)
            h = np.zeros(len(own), np.uint64)
            for k in range(size):
                h = h * MULTIPLIER + letters[:, k]
            order = np.argsort(h, kind="stable")
            likely = np.zeros(1 << TABLE_BITS, bool)
            likely[h >> np.uint64(64 - TABLE_BITS)] = True
            # Words of one hash are tried one after the other.
            same = int(np.unique(h, return_counts=True)[1].max())
            self.sizes[size] = h[order], letters[order], np.array([self.number[own[i]] for i in order], np.int64), likely, same

    def inside(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, starts, numbers) of the words inside each token; some more than once."""
        flat, lengths = letters_of(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths)
        pos, end = np.arange(len(flat)), np.repeat(ends, lengths)
        h, rows = np.zeros(len(pos), np.uint64), []
        for size in range(1, max(self.sizes, default=0) + 1):
            keep = pos + size <= end
            if not keep.all():
                pos, end, h = pos[keep], end[keep], h[keep]
            if not len(pos):
                break
            h = h * MULTIPLIER + flat[pos + size - 1]
            if size not in self.sizes:
                continue
            hashes, letters, number, likely, same = self.sizes[size]
            i = np.flatnonzero(likely[h >> np.uint64(64 - TABLE_BITS)])
            place = np.searchsorted(hashes, h[i])
            for k in range(same):
                j = np.minimum(place + k, len(hashes) - 1)
                met = np.flatnonzero(hashes[j] == h[i])
                met = met[(flat[pos[i[met], None] + np.arange(size)] == letters[j[met]]).all(axis=1)]
                rows.append((pos[i[met]], number[j[met]]))
        if not rows:
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64), np.zeros(0, np.int64)
        where, found = (np.concatenate(x) for x in zip(*rows))
        token = np.repeat(np.arange(len(tokens)), lengths)[where]
        counts = np.bincount(token, minlength=len(tokens))
        return counts, np.cumsum(counts) - counts, found[np.argsort(token, kind="stable")]


def letters_of(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def indexed(data: dict) -> dict:
    """`data` with what is looked up in it, made once per worker: `words` and `phrases` of (parts, …) are lists."""
    if "ready" in data:
        return data
    words, phrases = data["words"], [p[0] for p in data["phrases"]]
    of_word: dict[str, list[int]] = {}
    for i, (word, _) in enumerate(words):
        of_word.setdefault(word, []).append(i)
    data["words_in"], data["of_word"] = Finder(of_word), lists(of_word.values())
    often = Counter(part for parts in phrases for part in set(parts))
    data["parts"] = numbered(often)
    of_part = data["parts"].__getitem__
    # By the word that the fewest phrases have: frequent words alone have few partners then.
    anchor = [min(range(len(parts)), key=lambda k: often[parts[k]]) for parts in phrases]
    data["long"] = np.array([len(parts) > 2 for parts in phrases], bool)
    data["anchor_first"] = np.array(anchor, np.int64) == 0
    data["partner"] = np.array([of_part(parts[k - 1] if k else parts[1]) for k, parts in zip(anchor, phrases)], np.int64)
    by_part: list[list[int]] = [[] for _ in often]
    for i, (k, parts) in enumerate(zip(anchor, phrases)):
        by_part[of_part(parts[k])].append(i)
    data["of_part"] = lists(by_part)
    data["ready"] = True
    return data


class Step:
    """Tokens of some texts: the text, the line and the number of each."""

    def __init__(self, data: dict, column: pa.Array) -> None:
        self.data, self.n = data, len(column)
        values = column.flatten().dictionary_encode()
        self.tokens = values.dictionary.to_pylist()
        self.text = np.repeat(np.arange(self.n), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        self.token = values.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.line = np.cumsum(pc.equal(values.dictionary, "\n").to_numpy(zero_copy_only=False)[self.token]) + self.text

    def words(self, flags: np.ndarray) -> None:
        """Flag the words that are inside the tokens of each text."""
        held = self.data
        counts, starts, found = held["words_in"].inside(self.tokens)
        different = np.sort(self.text * len(self.tokens) + self.token)
        different = different[np.flatnonzero(np.diff(different, prepend=-1))]
        text, token = different // max(1, len(self.tokens)), different % max(1, len(self.tokens))
        owner, place = ragged(counts[token])
        text, found = text[owner], found[starts[token[owner]] + place]
        counts, starts, entries = held["of_word"]
        owner, place = ragged(counts[found])
        flags[text[owner], entries[starts[found[owner]] + place]] = True

    def in_order(self, flags: np.ndarray) -> None:
        """Flag the phrases whose words are tokens of one line, one after the other."""
        held, size = self.data, len(self.data["parts"])
        part = np.array([held["parts"].get(t, -1) for t in self.tokens], np.int64)[self.token]
        at = np.flatnonzero(part >= 0)
        if not len(at):
            return
        part, line = part[at], self.line[at]
        key, (n, starts, order) = grouped(line * size + part)
        first, last = at[order[starts]], at[order[starts + n - 1]]
        text, (bucket, start, phrases) = self.text[first], held["of_part"]
        counts = bucket[key % size]
        ends, low = np.cumsum(counts), 0
        while low < len(key):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - counts[low] + STEP_PAIRS, side="right")))
            own, place = ragged(counts[low:high])
            own += low
            phrase = phrases[start[key[own] % size] + place]
            wanted = key[own] // size * size + held["partner"][phrase]
            other = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            met = key[other] == wanted
            own, other, phrase = own[met], other[met], phrase[met]
            ahead = held["anchor_first"][phrase]
            ok = held["long"][phrase] | (np.where(ahead, first[own], first[other]) < np.where(ahead, last[other], last[own]))
            for i in np.flatnonzero(held["long"][phrase]):
                where = key[own[i]] // size
                a, b = np.searchsorted(line, where), np.searchsorted(line, where, side="right")
                ok[i] = follow([held["parts"][p] for p in held["phrases"][phrase[i]][0]], part[a:b].tolist())
            flags[text[own[ok]], phrase[ok]] = True
            low = high


def follow(parts: list[int], line: list[int]) -> bool:
    """Whether the parts stand in the line, one after the other."""
    at = -1
    for part in parts:
        try:
            at = line.index(part, at + 1)
        except ValueError:
            return False
    return True


def steps(column: pa.Array, flags: int) -> Iterable[pa.Array]:
    n = max(1, STEP_FLAGS // max(1, flags))
    return (column.slice(low, n) for low in range(0, len(column), n))


def hits_of(data: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, number) of the words and, after these, the phrases of texts, phrases as whole words in order."""
    step, n = Step(data, column), len(data["words"])
    flags = np.zeros((step.n, n + len(data["phrases"])), bool)
    step.words(flags[:, :n])
    step.in_order(flags[:, n:])
    return np.nonzero(flags)


def hits_column(spark: SparkSession, data: dict, found: Column) -> Column:
    """array<struct<keyword, weight>> of the tokens in keyword order."""
    entries = list(data["words"]) + [(k, w) for _, w, k in data["phrases"]]
    order = sorted(range(len(entries)), key=lambda i: (entries[i][0].encode("utf-8", "surrogatepass"), entries[i][1] is not None, entries[i][1] or 0.0))
    sent = spark.sparkContext.broadcast(data | {"entries": [entries[i] for i in order], "order": order})

    @F.arrow_udf("array<struct<keyword:string,weight:double>>")
    def run(column: pa.Array) -> pa.Array:
        held = indexed(sent.value)
        keywords, weights = (pa.array([e[k] for e in held["entries"]], kind) for k, kind in ((0, pa.string()), (1, pa.float64())))
        rank = np.argsort(np.array(held["order"], np.int64))
        chosen, ends = [], [np.zeros(1, np.int64)]
        for part in steps(column, len(rank)):
            text, number = hits_of(held, part)
            place = rank[number]
            chosen.append(place[np.lexsort((place, text))].astype(np.int32))
            ends.append(ends[-1][-1] + np.cumsum(np.bincount(text, minlength=len(part))))
        rows = pa.array(np.concatenate([np.zeros(0, np.int32), *chosen]))
        listed = pa.StructArray.from_arrays([keywords.take(rows), weights.take(rows)], names=["keyword", "weight"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), listed)

    return run(found)
