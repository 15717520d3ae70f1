"""Language of every word of a text by a linear-chain conditional random field, and of the text by its words.

Features of a word are its affixes, its character n-grams, itself and what a lexicon counted over all training
documents says about it, hashed into one weight table; transitions between languages are learned with them.
Words are labelled by forward-backward, in blocks of words so that whole batches run as array steps.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import batch, ragged, texts_of
from newsflow.session import cut_lineage

# The documents the weights are fitted on: about so many for each language, chosen by hash among those of at most
# so many characters. Only the fit is bounded: the lexicon counts all training documents, prediction takes whole texts.
FIT_DOCS = 150
FIT_CHARS = 20_000
FIT_ROUNDS = 25
# Words of the lexicon at most, and the least count.
LEXICON_WORDS = 50_000
LEXICON_MIN_COUNT = 16
HASH_BITS = 18
BLOCK = 32
MEMO_WORDS = 500_000
COUNTER_WORDS = 400_000
UNKNOWN = "und"

WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Hashed features of a word."""
    data = word.encode("utf-8", "surrogatepass")
    marked = b"^" + data + b"$"
    names = [b"", b"w" + data, b"l%d" % lexicon.get(word, -1)]
    names += [b"p" + data[:i] for i in (1, 2, 3)]
    names += [b"s" + data[-i:] for i in (1, 2, 3)]
    names += [marked[i:i + 2] for i in range(len(marked) - 1)]
    names += [marked[i:i + 3] for i in range(len(marked) - 2)]
    mask = (1 << HASH_BITS) - 1
    return [crc32(n) & mask for n in names]


def flat_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, where each word's begin)."""
    found = [features(w, lexicon) for w in words]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for f in found for i in f), np.int64, int(counts.sum())), np.cumsum(counts) - counts


class Chain:
    """Forward-backward over many sequences at once; `lengths` are their numbers of words."""

    def __init__(self, emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> None:
        n, labels = emission.shape
        self.shift = emission.max(axis=1, keepdims=True)
        blocks_of = -(-lengths // BLOCK)
        owner, place = ragged(lengths)
        block_first = np.cumsum(blocks_of) - blocks_of
        self.row, self.col = block_first[owner] + place // BLOCK, place % BLOCK
        count = int(blocks_of.sum())
        weight = np.ones((BLOCK, count, labels))
        weight[self.col, self.row] = np.exp(emission - self.shift)
        stay = np.ones((BLOCK, count), dtype=bool)  # padding and first words have no transition before them
        stay[self.col, self.row] = place == 0
        self.weight, self.stay = weight, stay[:, :, None]
        self.move = np.exp(transition)
        self.start = np.exp(start)
        self._run(blocks_of, block_first, count, labels)

    def _run(self, blocks_of: np.ndarray, block_first: np.ndarray, count: int, labels: int) -> None:
        # Product of the steps of each block: its effect on each label it may start from.
        product = np.repeat(np.eye(labels)[None], count, axis=0)
        for t in range(BLOCK):
            moved = np.where(self.stay[t][:, :, None], product, product @ self.move) * self.weight[t][:, None, :]
            product = moved / moved.sum(axis=(1, 2), keepdims=True)
        # Messages between blocks, over all sequences that have so many.
        enter, leave = np.empty((count, labels)), np.ones((count, labels))
        order = np.argsort(-blocks_of, kind="stable")
        sizes, firsts = blocks_of[order], block_first[order]
        most = int(sizes[0]) if len(sizes) else 0
        alive = [int(np.searchsorted(-sizes, -k, side="left")) for k in range(most + 1)]  # sequences with more than k blocks
        state = np.repeat(self.start[None], len(sizes), axis=0)
        for k in range(most):
            m = alive[k]
            at = firsts[:m] + k
            enter[at] = state[:m]
            nxt = (state[:m, None, :] @ product[at])[:, 0]
            state[:m] = nxt / nxt.sum(axis=1, keepdims=True)
        for k in range(most - 2, -1, -1):
            m = alive[k + 1]
            at = firsts[:m] + k
            back = (product[at + 1] @ leave[at + 1][:, :, None])[:, :, 0]
            leave[at] = back / back.sum(axis=1, keepdims=True)
        forward = np.empty((BLOCK, count, labels))
        self.enter = state = enter
        for t in range(BLOCK):
            state = np.where(self.stay[t], state, state @ self.move) * self.weight[t]
            state = state / state.sum(axis=1, keepdims=True)
            forward[t] = state
        backward = np.empty((BLOCK, count, labels))
        state = leave
        for t in range(BLOCK - 1, -1, -1):
            backward[t] = state
            pulled = self.weight[t] * state
            state = np.where(self.stay[t], pulled, pulled @ self.move.T)
            state = state / state.sum(axis=1, keepdims=True)
        self.forward, self.backward = forward, backward

    def posteriors(self) -> np.ndarray:
        """Probability of each label for each word."""
        both = self.forward * self.backward
        both /= both.sum(axis=2, keepdims=True)
        return both[self.col, self.row]

    def transitions(self) -> np.ndarray:
        """Expected number of steps between labels."""
        labels = len(self.start)
        total = np.zeros((labels, labels))
        before = self.enter
        for t in range(BLOCK):
            joint = before[:, :, None] * self.move * (self.weight[t] * self.backward[t])[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            total += joint[~self.stay[t][:, 0]].sum(axis=0)
            before = self.forward[t]
        return total


class Model:
    """Weights, transitions and lexicon; `langs` are the labels in order."""

    def __init__(self, langs: list[str], lexicon: dict[str, int]) -> None:
        self.key = uuid.uuid4().hex
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((1 << HASH_BITS, len(langs)), dtype=np.float32)
        self.move, self.start = np.zeros((len(langs), len(langs))), np.zeros(len(langs))

    def fit(self, docs: list[tuple[str, str]], rounds: int = FIT_ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Maximum likelihood by adaptive gradient steps; every word of a document has the document's language."""
        sequences = [(words_of(text), self.langs.index(lang)) for text, lang in docs]
        sequences = [s for s in sequences if s[0]]
        if not sequences or len(self.langs) < 2:
            return
        known: dict[str, int] = {}
        word = np.array([known.setdefault(w, len(known)) for words, _ in sequences for w in words])
        lengths = np.array([len(words) for words, _ in sequences])
        label = np.repeat([k for _, k in sequences], lengths)
        flat, starts = flat_features(list(known), self.lexicon)
        sizes = np.diff(np.r_[starts, len(flat)])
        labels, n = len(self.langs), len(word)
        truth = np.zeros((n, labels))
        truth[np.arange(n), label] = 1
        first = np.cumsum(lengths) - lengths
        inner = np.ones(n, dtype=bool)
        inner[first] = False
        seen = np.zeros((labels, labels))
        np.add.at(seen, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
        weights = np.zeros(self.weights.shape)
        past, past_move, past_start = np.full(weights.shape, 1e-8), np.full(self.move.shape, 1e-8), np.full(labels, 1e-8)
        for _ in range(rounds):
            emission = np.add.reduceat(weights[flat], starts, axis=0)[word]
            chain = Chain(emission, lengths, self.move, self.start)
            found = chain.posteriors()
            gap = truth - found
            by_word = np.stack([np.bincount(word, gap[:, k], len(known)) for k in range(labels)], axis=1)
            spread = np.repeat(by_word, sizes, axis=0)
            step = np.stack([np.bincount(flat, spread[:, k], len(weights)) for k in range(labels)], axis=1) / n - decay * weights
            step_move = (seen - chain.transitions()) / n - decay * self.move
            step_start = gap[first].sum(axis=0) / len(first) - decay * self.start
            past += step ** 2
            past_move += step_move ** 2
            past_start += step_start ** 2
            weights += rate * step / np.sqrt(past)
            self.move = self.move + rate * step_move / np.sqrt(past_move)
            self.start = self.start + rate * step_start / np.sqrt(past_start)
        self.weights = weights.astype(np.float32)


class Labeller(dict):
    """Emission scores of words; as a dictionary, word -> row of the score table, bounded."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.scores = np.empty((0, len(model.langs)))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
            self.scores = self.scores[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            flat, starts = flat_features(self.new, self.model.lexicon)
            made = np.add.reduceat(self.model.weights[flat].astype(np.float64), starts, axis=0)
            self.scores = np.concatenate([self.scores, made])
            self.new = []
        return self.scores[at]

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """Words of each text and the probabilities of their languages."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        if not lengths.sum() or not self.model.langs:
            return [(w, np.zeros((len(w), len(self.model.langs)))) for w in words]
        found = Chain(self.emissions([w for ws in words for w in ws]), lengths, self.model.move, self.model.start).posteriors()
        return list(zip(words, np.split(found, np.cumsum(lengths)[:-1])))

    def predict(self, text_words: list[str], found: np.ndarray) -> tuple[str, float]:
        """Language with most of the words, and its share."""
        if not text_words or not self.model.langs:
            return UNKNOWN, 0.0
        share = found.sum(axis=0)
        best = int(share.argmax())
        return self.model.langs[best], float(min(1.0, share[best] / share.sum()))


_LABELLERS: dict[str, Labeller] = {}


def labeller(model: Model) -> Labeller:
    if model.key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.key] = Labeller(model)
    return _LABELLERS[model.key]


# Texts labelled in one array step: bounded by their words.
STEP_CHARS = 4 << 20


def steps(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= STEP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


# ---- training

def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning; documents without an id are neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def lexicon_counts(docs: DataFrame) -> DataFrame:
    """(word, lang, n) over all of `docs` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(w, lang, n) for lang, c in found.items() for w, n in c.items()]
            found.clear()
            return batch(word=pa.array([r[0] for r in rows], pa.string()), lang=pa.array([r[1] for r in rows], pa.string()),
                         n=pa.array([r[2] for r in rows], pa.int64()))

        for b in batches:
            for text, lang in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, found.values())) > COUNTER_WORDS:
                    yield out()
        yield out()

    counted = docs.select("text", "lang").mapInArrow(run, "word string, lang string, n long")
    return counted.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, langs: list[str], words: int = LEXICON_WORDS) -> dict[str, int]:
    """Frequent words and what their counts say: language they lean to and how much, as one number.

    At most `words` words, the most frequent ones, ties in or out together.
    """
    totals = lexicon_counts(docs).groupBy("word").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    counts = cut_lineage(totals.where(F.col("n") >= LEXICON_MIN_COUNT))
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    left, least = words, None
    for at, n in sizes:
        if n > left:
            break
        left, least = left - n, at
    rows = [] if least is None else counts.where(level >= least).collect()
    mass = Counter()
    for r in rows:
        mass.update(r["by"])
    out = {}
    for r in rows:
        share = np.array([r["by"].get(lang, 0) / max(1, mass[lang]) for lang in langs])
        share /= share.sum()
        best = int(share.argmax())
        out[r["word"]] = best * 8 + int(share[best] * 7.999)
    return out


def train(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of the labelled documents that are not held out. No labels give a model without languages."""
    known = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    small = F.length("text") <= FIT_CHARS
    counts = known.groupBy("lang").agg(F.count_if(small).alias("n")).collect()
    langs = sorted(r["lang"] for r in counts)
    model = Model(langs, lexicon(known, langs) if langs else {})
    if len(langs) < 2:
        return model
    # Share of each language's documents that gives about fit_docs of them, in millionths of the hash range.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, fit_docs / max(1, r["n"])) * 1_000_000)))])
    chosen = known.where(small & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")]))
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in chosen.collect())
    model.fit([(text, lang) for _, text, lang in rows])
    return model


# ---- use

def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language of most words of each text and its share of the words.

    Texts that are null or have no letter are `und` with score 0. The model is broadcast; its size is bounded by
    HASH_BITS and LEXICON_WORDS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(shared.value)
        for b in batches:
            found = [label.predict(*x) for part in steps(texts_of(b.column("text"))) for x in label.label(part)]
            yield batch(doc_id=b.column("doc_id"), lang_pred=pa.array([f[0] for f in found], pa.string()),
                        score=pa.array([f[1] for f in found], pa.float64()))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """`docs` without those rejected: texts without a letter, and texts in which no language has the share `least` of the words.

    Columns stay. A model without languages only rejects texts without a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded = bool(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(shared.value)
        for b in batches:
            keep = []
            for part in steps(texts_of(b.column(text_col))):
                for words, found in label.label(part):
                    keep.append(bool(words) and (not bounded or label.predict(words, found)[1] >= least))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, word, lang, score): language of every word, for code-switched text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeller(shared.value)
        for b in batches:
            at = 0
            for part in steps(texts_of(b.column("text"))):
                owner, place, words, langs, scores = [], [], [], [], []
                for text_words, found in label.label(part):
                    if text_words and model_langs:
                        best = found.argmax(axis=1)
                        owner += [at] * len(text_words)
                        place += range(len(text_words))
                        words += text_words
                        langs += [model_langs[k] for k in best]
                        scores.append(found[np.arange(len(best)), best])
                    at += 1
                yield batch(doc_id=b.column("doc_id").take(pa.array(owner, pa.int64())), place=pa.array(place, pa.int64()), word=pa.array(words, pa.string()),
                            lang=pa.array(langs, pa.string()), score=pa.array(np.concatenate(scores) if scores else [], pa.float64()))

    model_langs = model.langs
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, place long, word string, lang string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the labelled documents that are not held out, predict all.

    Repeated rows and null ids are kept; an empty table gives an empty one; other columns are ignored.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
