"""Token counts and piece ids against the libraries themselves."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refloom.llm import bpe_count, piece_codec

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "\t a\n\nb ", "   leading", "trailing   ", " " * 15, " " * 16, " " * 17, " " * 33, "x" + " " * 35 + "y", " " * 40 + "日本",
    "a" * 3000, "ab" * 500, "aaa aaaa aaaaa", "The quick  brown fox's 12345 ½ ²", "naïve café é ﬁ ａ", "日本語のテキスト 한국어",
    "emoji 👍🏽 👨‍👩‍👧 ", "▁under▁ ▁▁", "<s>a</s> <unk> <0x41> <|endoftext|>x<|startoftext|> <|x|>", "\x00\x01\x7f\x85\xa0", "ΣΟΣ İİ ΑΣ Σ",
    "it's I'll we've they'd 'S", "​ 　", "don''t -- ## !!! ...", "\U0010ffff �", "=" * 700, "word " * 4000,
]


def random_texts(n=300):
    rng = random.Random(5)
    alphabet = "abcdeimnorstu ETA  \n.,'▁012éßç日ァ👍́"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_counts_are_the_librarys():
    library = Tokenizer.from_file(WORDS)
    own = bpe_count.TokenCounter(WORDS)
    for text in ODD + random_texts():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:80])


def test_pieces_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = piece_codec.PieceCodec(PIECES)
    texts = ODD + random_texts()
    for text, (raw, decoded) in zip(texts, own.batch(texts), strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(raw, "<u4").tolist() == ids, repr(text[:80])
        assert decoded == library.decode(ids) == own.decode(np.array(ids, np.uint32)), repr(text[:80])


def long_texts(n):
    rng = random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "ABCdef0123456789+/", ["the", "hing", "in", "ere", "re", "ation", "tion", "é", "漢"]]
    return ["".join(rng.choice(k) for _ in range(n)) for k in kinds] + ["a" * n]


def test_texts_without_blanks(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for long in (2, piece_codec.LONG):
        monkeypatch.setattr(piece_codec, "LONG", long)
        own = piece_codec.PieceCodec(PIECES)
        texts = ODD + random_texts(100) + [t for n in (3, 17, 511, 513, 2000) for t in long_texts(n)]
        for text, (raw, _) in zip(texts, own.batch(texts), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True), (long, text[:80])


def test_a_million_letters_without_a_blank():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES)
    text = long_texts(1_000_000)[0]
    start = time.perf_counter()
    raw, _ = next(iter(own.batch([text])))
    assert time.perf_counter() - start < 30
    assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words, pieces = Tokenizer.from_file(WORDS), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe_count.token_counts(docs, WORDS).collect():
        n = len(words.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)
    for r in piece_codec.encoded(docs, PIECES).collect():
        ids = pieces.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded == pieces.decode(ids)


@pytest.mark.parametrize("rows", [0, 1])
def test_nulls_and_clashing_names(spark, rows):
    data = [(None, None, 1, "x"), (5, "", 2, "y"), (5, "", 2, "y"), (6, "a b", 3, None)] if rows else []
    docs = spark.createDataFrame(data, "doc_id long, text string, n_tokens int, ids string")
    counted = bpe_count.token_counts(docs, WORDS)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(r.n_tokens for r in counted.collect()) == [0, 0, 0, 2][: len(data)]
    made = piece_codec.encoded(docs, PIECES)
    assert made.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(r.n_tokens for r in made.select(F.col("n_tokens")).collect()) == [2, 2, 2, 4][: len(data)]
