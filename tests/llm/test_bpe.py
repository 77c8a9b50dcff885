import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bulwark.llm import bpe

FILE = bpe.public_vocabulary()


@pytest.fixture(scope="module")
def merges():
    with open(FILE, "rb") as f:
        return bpe.Merges(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids(merges, text):
    return np.frombuffer(b"".join(merges.encode(text)), dtype=bpe.PACKED).tolist()


def expected(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(found, skip_special_tokens=False)
    packed = np.array(found, dtype="<u4").tobytes()
    return len(found), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_documents_as_the_library_does(documents, texts, library):
    rows = bpe.digests(bpe.encode(documents, FILE, decoded=True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])


def test_odd_rows(odd, library):
    rows = bpe.digests(bpe.encode(odd, FILE, decoded=True)).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"], *expected(library, r["text"])) for r in odd.where("doc_id is not null").collect())
    assert sorted((False, *r) for r in rows if r["doc_id"] is not None) == want
    assert sum(r["doc_id"] is None for r in rows) == 2


def test_empty_table(empty):
    encoded = bpe.encode(empty, FILE)
    assert encoded.count() == 0 and encoded.columns == ["doc_id", "n_tokens", "ids"]


def test_random_texts(merges, library):
    rng = random.Random(1)
    letters = "aeiourstnlthe  \n\t'’sdm0123½²Ⅷ一é́ ᲀ\x1c\x85 !!&&"
    for i in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if i % 4 == 0:
            text = "<|endoftext|>".join([text, text[::-1], ""])
        assert ids(merges, text) == library.encode(text, add_special_tokens=False).ids
        assert "".join(merges.decode(merges.encode(text))) == text


@pytest.mark.parametrize("letters", ["ab", "the", "aeiourstnlhe", "!-=_", "0", "é", "x", " "])
def test_lookahead_transducer(merges, library, letters):
    rng = random.Random(2)
    for size in (1, 300, 5000):
        text = "".join(rng.choice(letters) for _ in range(size))
        assert list(merges.streamed(text.encode())) == library.encode(text, add_special_tokens=False).ids


def test_every_piece_runs_through_the_transducer(merges, texts, library, monkeypatch):
    seen = []
    streamed = bpe.Merges.streamed
    monkeypatch.setattr(bpe.Merges, "streamed", lambda self, data: seen.append(data) or streamed(self, data))
    merges.clear()
    for text in list(texts.values())[:20]:
        assert ids(merges, text) == library.encode(text, add_special_tokens=False).ids
    assert {p.decode() for p in seen} == set(merges) and seen


def test_long_pieces_and_windows(merges, library):
    text = "x" * 200_000 + " " + "\n" * 70_000 + "word " * 30_000
    assert ids(merges, text) == library.encode(text, add_special_tokens=False).ids


def test_transducer_holds_few_prefixes(merges):
    """What is kept between emissions is bounded by the lookahead, not by the piece."""
    stream = merges.streamed(b"ab" * 40_000)
    consumed = [next(stream) for _ in range(100)]
    frame = stream.gi_frame.f_locals
    assert consumed and len(frame["back"]) < 8 * merges.lookahead and len(frame["live"]) <= merges.lookahead + 1


def test_malformed_bytes_decode_like_the_library(merges, library):
    rng = np.random.default_rng(3)
    for _ in range(200):
        sequence = rng.integers(0, 256, rng.integers(1, 12)).tolist()
        text = "".join(merges.decode([np.array(sequence, dtype=bpe.PACKED).tobytes()]))
        assert text == library.decode(sequence, skip_special_tokens=False)
    # A character split over windows.
    halves = [np.array([merges.single[b]], dtype=bpe.PACKED).tobytes() for b in "é".encode()]
    assert "".join(merges.decode(halves)) == "é"


def test_decode_table(documents, texts):
    tokens = bpe.encode(documents, FILE).withColumn("extra", F.lit(1))
    assert {r["doc_id"]: r["text"] for r in bpe.decode(tokens, FILE).collect()} == texts
    assert bpe.decode(tokens.withColumn("ids", F.lit(None).cast("binary")).limit(1), FILE).first()["text"] == ""
