import hashlib
import random
import time
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from linemill.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.TOKENIZER)
OWN = bpe.ByteBPE(Path(bpe.TOKENIZER).read_bytes())
TEXTS = [
    "", " ", "  \n\n x", "Hello world's  end.\n\nIt's 12345 don't", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 20, "été naïve Straße ñandú", "日本語のテキスト 한국어", "🙂👩‍👩‍👧 emoji",
    "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "<|endoftext", "  x​", "tab\tand\r\nlines \u0085 ", "x" * 30_000, "ab" * 5000, "\x00\x01 control", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢", "١٢٣ ½ Ⅷ", "'S 's 'LL 'll",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_match_the_library(text):
    ids = OWN.encode([text])[0].tolist()
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert OWN.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False) == text


def test_random_texts_match_the_library():
    rng = random.Random(1)
    letters = "abcdefgh ABé \n\t'.,!12ß漢🙂-_|  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 400))) for _ in range(400)]
    for t, got in zip(texts, OWN.encode(texts), strict=True):
        assert got.tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_long_words_match_the_library(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice(a) for _ in range(n)) for a in ("ab", "the and ing".replace(" ", ""), "abcdefghijklmnopqrstuvwxyz", "é漢🙂a") for n in (5, 50, 400, 1500)]
    want = [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
    for bound in (1, 100, 10**6):
        monkeypatch.setattr(bpe, "LONG", bound)
        assert [x.tolist() for x in bpe.ByteBPE(Path(bpe.TOKENIZER).read_bytes()).encode(words)] == want


def test_a_word_of_very_many_letters():
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500_000))
    began = time.perf_counter()
    ids = OWN.encode([word])[0].tolist()
    assert time.perf_counter() - began < 30 and OWN.decode(ids) == word
    assert ids == LIBRARY.encode(word, add_special_tokens=False).ids


def test_table_is_forgotten_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    own = bpe.ByteBPE(Path(bpe.TOKENIZER).read_bytes())
    monkeypatch.setattr(own, "groups", lambda texts: ([t] for t in texts))
    for t in TEXTS:
        assert own.encode([t])[0].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


def test_digests(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (7, TEXTS[7])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as d")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame).collect()), key=str)
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(frame.limit(0)).collect() == []


def test_counter(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string")
    got = [tuple(r) for r in frame.select("text", bpe.counter(spark)(frame["text"]).alias("n")).collect()]
    assert got == [(t, len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for t in [*TEXTS, None]]


def test_round_trip_columns(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "text string")
    out = frame.select("text", bpe.encoder(spark)("text").alias("ids")).select("text", bpe.decoder(spark)("ids").alias("back")).collect()
    assert all((r.text or "") == r.back for r in out)
