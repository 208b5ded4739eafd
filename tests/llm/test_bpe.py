"""Ids and texts against the tokenizers library."""

import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from tidepanel.llm import bpe


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_every_token_is_its_own_encoding():
    codec = bpe.Encoder(bpe.vocabulary_path())
    assert all(codec.encode_piece(token) == [number] for token, number in codec.ids.items())


def test_fuzz_matches_library():
    codec, library = bpe.Encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    draw = random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "<|endoftext|>", "<|end", "'s", "'ll", "1", "٣", "²", " ", "\x1c", "\x85", "漢", "👍",
             "Ա", "՘", "zz", "the", "in", "!", "??", "​", "　", "aaa", "ª", "ƻ", " "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(8000)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0, 0xD7FF), draw.randint(0xE000, 0x10FFFF)]))
                      for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(draw.choice("abtheinor") for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    texts += [" " + chr(c) for c in range(0x600)] + ["ab" * 20000, " " * 10000, "x " * 30000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids_of(codec, text) == want.ids, text[:80]
        assert codec.decode(codec.encode(text)) == library.decode(want.ids, skip_special_tokens=False), text[:80]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "LONG_TEXT", 2)
    small, library = bpe.Encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    text = "Some words, and  some more\n\nwords that come again, some words"
    assert ids_of(small, text) == library.encode(text, add_special_tokens=False).ids


def test_decode_of_partial_characters():
    codec, library = bpe.Encoder(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())
    ids = library.encode("👍é漢", add_special_tokens=False).ids
    for cut in range(len(ids)):
        part = ids[:cut] + ids[cut + 1:]
        assert codec.decode(np.array(part, "<u4").tobytes()) == library.decode(part, skip_special_tokens=False)


def test_operator_round_trip_with_nulls(spark):
    rows = [(1, "a b", 0), (None, None, 0), (1, "a b", 0), (3, "", 0), (4, "é<|endoftext|>", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    back = bpe.decode(bpe.encode(docs)).collect()
    assert [(r.doc_id, r.text) for r in back] == [(d, t or "") for d, t, _ in rows]
    digest = bpe.round_trip(docs).collect()
    assert [r.decoded_sha256 for r in digest] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows]
    assert [r.n_tokens for r in digest][1] == 0 and digest[0] == digest[2]
    assert bpe.round_trip(docs.limit(0)).collect() == []


def test_a_word_is_remembered_once():
    codec, words = bpe.Encoder(bpe.vocabulary_path()), [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    codec.encode("start " + " ".join(words))
    assert len(codec.spaced_ids) == 100 and not [p for p in codec.piece_ids if p.startswith(" w")]
    assert bpe.REMEMBERED <= 200_000
