"""Byte-pair encoding and decoding with a transducer lexicon of frequent words.

Frequent words of the corpus are encoded once and compiled into a minimal acyclic automaton: states with equal
futures are shared, and every transition carries the number of words before it, so the sum along a path is the
word's place in the table of id sequences. The automaton is a flat file that each worker maps into memory.
Words it does not hold are merged exactly by the merge ranks of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import batch, texts_of
from newsflow.session import cut_lineage

# Words of the lexicon at most, and the count from which a word is looked at for it. They bound memory; the ids do
# not depend on them.
LEXICON_WORDS = 65_536
LEXICON_MIN_COUNT = 16
# Entries of a worker's memory of words seen before, half of them from before it was last full, and the longest word kept in it.
MEMO_WORDS = 800_000
MEMO_CHARS = 48
# Entries of its memory of words that stand in chunks of several, like those of code.
MEMO_PARTS = 150_000
# Different words a counting task holds before it hands on what it has.
COUNTER_WORDS = 400_000
# Ids turned into bytes in one array step.
DECODE_IDS = 4_000_000

# The word patterns of the two vocabularies.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

NO_MERGE = 1 << 29
_ID_BITS = 21
_ID_MASK = (1 << _ID_BITS) - 1


@cache
def byte_symbols() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges, byte ids and special tokens of a tokenizer file (JSON of the tokenizers library)."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model, ids = data["model"], data["model"]["vocab"]
        end = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        self.word_ends = bool(end)
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(ids[a] << _ID_BITS | ids[b], rank << _ID_BITS | ids[a + b])
        # The same by the left id, as ranks, and the id that each rank makes.
        right: dict[int, dict[int, int]] = {}
        self.made = [0] * len(model["merges"])
        for pair, found in self.pairs.items():
            right.setdefault(pair >> _ID_BITS, {})[pair & _ID_MASK] = found >> _ID_BITS
            self.made[found >> _ID_BITS] = found & _ID_MASK
        nothing: dict[int, int] = {}
        self.right = [right.get(i, nothing).get for i in range(max(ids.values()) + 1)]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(WORD_END_WORDS if self.word_ends else BYTE_LEVEL_WORDS)
        of_symbol = {s: b for b, s in enumerate(symbols)}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in ids.items():
            if all(c in of_symbol for c in token):
                self.bytes_of[i] = bytes(of_symbol[c] for c in token)
        self.bytes_of.update({i: s.encode() for s, i in self.special.items()})

    def byte_table(self) -> pa.Array:
        """Bytes of each id by its number; null for numbers that are no id."""
        return pa.array([self.bytes_of.get(i) for i in range(max(self.bytes_of) + 1)], pa.large_binary())

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by its merges, lowest rank first, then leftmost."""
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > 256:
            return self._merge_long(ids)
        right, made, none = self.right, self.made, NO_MERGE
        ranks = [right[a](b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = right[ids[i - 1]](new, none)
            if i < len(ranks):
                ranks[i] = right[new](ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of any length."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(p, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (p := get(a << _ID_BITS | b))]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = found & _ID_MASK, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := get(ids[left] << _ID_BITS | ids[right])):
                    heapq.heappush(heap, (p, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def normal(self, chunk: str) -> str:
        """The text as words are taken from it."""
        if not self.word_ends:
            return chunk
        chunk = unicodedata.normalize("NFC", chunk)
        return chunk.lower() if chunk.isascii() else "".join([c.lower() for c in chunk])

    def words_of(self, chunk: str) -> list[bytes]:
        """Words of a text without special tokens, as the bytes that are merged."""
        chunk = self.normal(chunk)
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return [(body if self.word_ends else chunk).encode()]
        if body[-1:] in _STOPS and body[:-1].isalpha():  # a word and one sign
            return [(body[:-1] if self.word_ends else chunk[:-1]).encode(), body[-1:].encode()]
        return [w.encode() for w in self.words.findall(chunk)]

    def chunks(self, text: str) -> tuple[str, list[str]]:
        """(head, chunks): pieces of a text that never share a word, so each is encoded by itself.

        The head stands at the start of the text. Byte-level chunks stand for a blank and themselves.
        """
        if self.word_ends:
            return "", text.split() if not _SEPARATORS.search(text) else _BLANKS.split(text)
        if "  " in text or text.endswith(" "):
            return text, []
        head, *rest = text.split(" ")
        return head, rest


_STOPS = frozenset(".,;:!?")
# str.split() also cuts at these, the vocabularies do not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = regex.compile(r"\s+")


class Automaton:
    """Minimal acyclic transducer from words to id sequences, read from a mapped file."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile(prefix="newsflow-lexicon-") as file:  # stays mapped after it is closed
            file.write(data)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(self.map, dtype="<u4", count=4).tolist()
        states, arcs, words, ids = head
        view, at = memoryview(self.map), 16
        parts = []
        for count in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at:at + 4 * count].cast("I"))
            at += 4 * count
        self.first, self.target, self.before, self.ends, self.ids = parts
        self.final = view[at:at + states]
        self.labels = bytes(view[at + states:])  # one byte per transition, searched in place

    @classmethod
    def of(cls, entries: dict[bytes, list[int]]) -> bytes:
        """Compile words; equal right languages become one state."""
        words = sorted(w for w in entries if w)
        registry: dict[tuple, int] = {}
        arcs_of: list[tuple] = []
        final_of: list[int] = []
        count_of: list[int] = []

        def keep(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in registry:
                registry[key] = len(arcs_of)
                arcs_of.append(key[1])
                final_of.append(node[0])
                count_of.append(node[0] + sum(count_of[t] for _, t in key[1]))
            return registry[key]

        path, last = [[0, []]], b""
        for word in [*words, None]:
            same = 0 if word is None else len(os.path.commonprefix([word, last]))
            while len(path) - 1 > same:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], keep(node)))
            if word is not None:
                path += [[0, []] for _ in range(len(word) - same)]
                path[-1][0], last = 1, word
        root = keep(path[0])
        # The root is read at state 0.
        order = [root, *(i for i in range(len(arcs_of)) if i != root)]
        place = {old: new for new, old in enumerate(order)}
        first, target, before, labels = [0], [], [], bytearray()
        for old in order:
            passed = final_of[old]
            for label, to in arcs_of[old]:
                labels.append(label)
                target.append(place[to])
                before.append(passed)
                passed += count_of[to]
            first.append(len(labels))
        ids = [i for w in words for i in entries[w]]
        ends = np.cumsum([0, *(len(entries[w]) for w in words)])
        head = [len(order), len(labels), len(words), len(ids)]
        return b"".join([*(np.asarray(x, dtype="<u4").tobytes() for x in (head, first, target, before, ends, ids)),
                         bytes(final_of[i] for i in order), bytes(labels)])

    def get(self, word: bytes) -> memoryview | None:
        """Id sequence of a word, None if the lexicon does not hold it."""
        state, place, labels, first, before, target = 0, 0, self.labels, self.first, self.before, self.target
        for b in word:
            at = labels.find(b, first[state], first[state + 1])
            if at < 0:
                return None
            place += before[at]
            state = target[at]
        return self.ids[self.ends[place]:self.ends[place + 1]] if self.final[state] else None


class Encoder(dict):
    """Text to ids as packed unsigned 32-bit numbers; as a dictionary, a bounded memory of chunks seen, beside one of words."""

    def __init__(self, spec: str, lexicon: bytes | None = None) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(spec)
        self.lexicon = Automaton(lexicon) if lexicon else None
        self.lead = "" if self.vocabulary.word_ends else " "
        self.before: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.signs = {s: self.words(s) for s in _STOPS}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.ids_of(chunk)
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS // 2:  # what is not met again until the next time goes
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def ids_of(self, chunk: str) -> bytes:
        if chunk.isascii():
            if not self.lead and (low := chunk.lower()) != chunk:
                return self[low]
            if chunk.isalpha():
                return self.merged((self.lead + chunk).encode())
        body, sign = chunk[:-1], chunk[-1:]
        if sign in self.signs and body.isalpha() and (body.isascii() or self.vocabulary.normal(body).isalpha()):  # a word and a sign are two words
            return self[body] + self.signs[sign]
        return self.words(self.lead + chunk)

    def words(self, chunk: str) -> bytes:
        words = self.vocabulary.words_of(chunk)
        if len(words) == 1:  # its chunk is remembered
            return self.merged(words[0])
        return b"".join([self.part(w) for w in words])

    def part(self, word: bytes) -> bytes:
        """Ids of a word that stands in a chunk of several: it comes again in others."""
        ids = self.parts.get(word)
        if ids is None:
            ids = self.merged(word)
            if len(word) <= MEMO_CHARS:
                if len(self.parts) >= MEMO_PARTS:
                    self.parts.clear()
                self.parts[word] = ids
        return ids

    def merged(self, word: bytes) -> bytes:
        known = self.lexicon.get(word) if self.lexicon else None
        return array("I", self.vocabulary.merge(word)).tobytes() if known is None else known.tobytes()

    def plain(self, text: str) -> bytes:
        head, rest = self.vocabulary.chunks(text)
        return self.words(head) + b"".join(map(self.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return self.plain(text)
        parts = self.vocabulary.split_special.split(text)
        return b"".join(np.array([special[p]], dtype="<u4").tobytes() if p in special else self.plain(p) for p in parts if p)


class Shared:
    """A vocabulary and a lexicon on their way to the workers: both are of bounded size."""

    def __init__(self, spark: SparkSession, spec: str, lexicon: bytes | None) -> None:
        self.key = uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast((spec, lexicon))


# Encoders of this worker: a worker process serves many tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(shared: Shared) -> Encoder:
    if shared.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.key] = Encoder(*shared.data.value)
    return _ENCODERS[shared.key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n): how often every word, as bytes, occurs in the texts."""
    shared = Shared(docs.sparkSession, read_spec(path), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(shared).vocabulary
        heads, chunks = Counter(), Counter()

        def words() -> pa.RecordBatch:
            found: dict[bytes, int] = {}
            for lead, counted in (("", heads), (" ", chunks)):
                for chunk, n in counted.items():
                    for w in vocabulary.words_of(lead + chunk):
                        found[w] = found.get(w, 0) + n
            heads.clear()
            chunks.clear()
            return batch(word=pa.array(list(found), pa.binary()), n=pa.array(list(found.values()), pa.int64()))

        for b in batches:
            for text in texts_of(b.column(0)):
                for part in vocabulary.split_special.split(text):
                    if part and part not in vocabulary.special:
                        head, rest = vocabulary.chunks(part)
                        heads[head] += 1
                        chunks.update(rest)
                if len(chunks) + len(heads) > COUNTER_WORDS:
                    yield words()
        yield words()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """Automaton of the most frequent words of all texts, at most `words` of them, ties in or out together."""
    counts = cut_lineage(word_counts(docs, path, text_col).where(F.col("n") >= LEXICON_MIN_COUNT))
    # Word counts by size class; there are at most a few hundred classes.
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    left, least = words, None
    for at, n in sizes:
        if n > left:
            break
        left, least = left - n, at
    vocabulary = Vocabulary(read_spec(path))
    chosen = [] if least is None else [bytes(r["word"]) for r in counts.where(level >= least).select("word").collect()]
    return Automaton.of({w: vocabulary.merge(w) for w in chosen})


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids): token ids of every text, special tokens in a text included; null and empty texts have none.

    Ids are those of the tokenizers library for the same file without added special tokens. Repeated rows and
    null ids are kept as they are, other columns are ignored.
    """
    shared = Shared(docs.sparkSession, read_spec(path), lexicon(docs, path, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(shared).encode
        for b in batches:
            found = [to_ids(t) for t in texts_of(b.column(1))]
            ends = np.cumsum([0, *(len(f) // 4 for f in found)]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)
            yield batch(doc_id=b.column(0), ids=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of the ids; bytes that are no UTF-8 become U+FFFD, null ids give the empty text.

    Tasks get the bytes of the ids alone: merges would take a worker's memory for nothing.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_spec(path)).byte_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # of a worker that counted or encoded before
        table = shared.value
        for b in batches:
            lists = b.column(ids_col)
            flat = lists.flatten()  # without what null lists hold
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *counts.tolist()])
            texts = []
            # So many ids at a time that their bytes stay below Arrow's limit of a column.
            low = 0
            while low < len(counts):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + DECODE_IDS, side="right")) - 1)
                pieces = table.take(flat.slice(ends[low], ends[high] - ends[low]))
                if pieces.null_count:
                    raise KeyError("an id that the vocabulary does not have")
                data = memoryview(pieces.buffers()[2] or b"")
                at = np.frombuffer(pieces.buffers()[1], np.int64)[ends[low:high + 1] - ends[low]].tolist() if len(pieces) else [0] * (high - low + 1)
                texts += [str(data[x:y], "utf-8", "replace") for x, y in zip(at, at[1:])]
                low = high
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, `{out_col}` string")
