"""Byte-pair encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from newsflow.llm import bpe
from newsflow.llm.common import ready
from newsflow.llm.queries import QUERIES

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "  ", "a  b", "a   b ", " lead", "trail ", "x\n\ny", "x \n y", "\n ", "a\n  b", "it's we'll 'S", "日本語 テキスト", "naïve ÉCOLE ΣΑΣ İx",
       "é áb", "x y　z", "a\x1cb \x1d c", "a\x85b", "<|endoftext|>", "a<|endoftext|> b<|startoftext|>c", "123 4567 !!!??", "🙂🙂 ok",
       "a" * 3000, "ab" * 700 + " " + "xyz" * 500, "tab\tsep\r\nline", " ́x", "ﬁ ﬁ ǅ", "x y", "<|endof text|>", "İ!", "Iİ.", "\u0958!", "\ufb1d.", "a\u0958? b", "\u0130;x \u0130;"]


def texts():
    rng = random.Random(3)
    pieces = ["a", "the", " ", "  ", "\n", "é", "ß", "'s", "ing", "1", "!", "　", "Σ", "\t", "İ", "\x1f", "é", "<|endoftext|>", "日"]
    return ODD + ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(2000)]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), bpe.Encoder(bpe.read_spec(path))
    for text in texts():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_automaton_holds_its_words_only():
    rng = random.Random(4)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): [rng.randrange(50_000) for _ in range(rng.randint(1, 5))] for _ in range(900)}
    lexicon = bpe.Automaton(bpe.Automaton.of(words))
    for _ in range(4000):
        word = bytes(rng.choices(b"abcd", k=rng.randint(0, 8)))
        found = lexicon.get(word)
        assert (found.tolist() if found is not None else None) == words.get(word)
    assert bpe.Automaton(bpe.Automaton.of({})).get(b"a") is None


def test_automaton_shares_suffixes():
    lexicon = bpe.Automaton(bpe.Automaton.of({a + b"tion": [1] for a in (b"na", b"sta", b"ra", b"mo")}))
    assert len(lexicon.final) < 4 * 6


def test_query_against_library(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe_codec"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_lexicon_changes_nothing(spark, monkeypatch):
    ready(spark)
    monkeypatch.setattr(bpe, "LEXICON_MIN_COUNT", 1)
    path = public_tokenizers.path(FILES[0])
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate([None, *ODD, "the the the"])] + [(None, "the", "z")], "doc_id long, text string, ids string")
    assert len(bpe.lexicon(df, path, words=40)) > 20
    got = [sorted((str(r[0]), r[1]) for r in bpe.encode(df, path, words=n).collect()) for n in (0, 10, 10_000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(ODD) + 3


def test_empty(spark):
    ready(spark)
    path = public_tokenizers.path(FILES[0])
    out = bpe.decode(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path), path)
    assert out.columns == ["doc_id", "ids", "decoded"] and out.count() == 0


def test_decode_in_steps(spark, monkeypatch):
    """Empty, null and long lists, invalid bytes cut at the ends of lists, more ids than one step takes."""
    ready(spark)
    monkeypatch.setattr(bpe, "DECODE_IDS", 5)
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    whole = library.encode("日本語 and more words than a step takes", add_special_tokens=False).ids
    lists = [None, [], whole, whole[:1], whole[1:3], [], None, whole[2:], [0]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").coalesce(1)
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, path).collect()}
    table = bpe.Vocabulary(bpe.read_spec(path)).bytes_of
    assert got == {i: b"".join(table[t] for t in x or ()).decode("utf-8", "replace") for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="vocabulary|out of bounds"):
        bpe.decode(spark.createDataFrame([(1, [max(table) + 1])], "doc_id long, ids array<int>"), path).collect()


def test_words_of_a_chunk_are_merged_once(monkeypatch):
    path = public_tokenizers.path(FILES[1])
    own, library = bpe.Encoder(bpe.read_spec(path)), Tokenizer.from_file(path)
    seen, merge = [], own.vocabulary.merge
    monkeypatch.setattr(own.vocabulary, "merge", lambda word: seen.append(word) or merge(word))
    monkeypatch.setattr(bpe, "MEMO_PARTS", 5)
    for text in ("alpha=beta", "beta(alpha)", "alpha[beta]=gamma.delta", "alpha=beta"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.parts) <= 5
    assert seen[:5] == [b"alpha", b"=", b"beta", b"(", b")"]


def test_words_that_are_met_again_stay_in_memory(monkeypatch):
    """A full memory keeps its last half; ids are those of the library all along."""
    path = public_tokenizers.path(FILES[1])
    own, library = bpe.Encoder(bpe.read_spec(path)), Tokenizer.from_file(path)
    seen, merge = [], own.vocabulary.merge
    monkeypatch.setattr(own.vocabulary, "merge", lambda word: seen.append(word) or merge(word))
    monkeypatch.setattr(bpe, "MEMO_WORDS", 8)
    text = " ".join(f"often w{'abcdefghijklmnopqrst'[i]} Often." for i in range(20))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert seen.count(b"often") == 1 and len(own) <= 4 and len(own.before) <= 4


def test_memory_of_words_is_bounded():
    """What a worker remembers beside its vocabulary; two workers share an executor."""
    import tracemalloc

    import public_tokenizers

    held = bpe.Encoder(bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    held.ids_of = lambda chunk: chunk.encode() * 4
    tracemalloc.start()
    for i in range(1_190_000):
        held[f"{i:x}"]
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held) + len(held.before) <= 800_000 and used < 140_000_000
