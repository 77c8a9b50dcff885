import glob
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bulwark.llm import token_files
from bulwark.session import scratch

FILE = token_files.public_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected(rows, library):
    """(id, n_tokens, ids_crc32) with running starts, in the order of the files for distinct ids."""
    out, start = [], 0
    for id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END]
        out.append((id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(documents, library):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = token_files.round_trip(documents, FILE).collect()
    assert sorted(map(tuple, got)) == expected(rows, library)


def test_odd_rows(odd, empty, library):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = [tuple(r) for r in token_files.round_trip(odd, FILE).collect()]
    want = expected(rows, library)
    free = lambda table: sorted(((r[0], r[2], r[3]) for r in table), key=str)
    assert free(got) == free(want)
    # Ids ascend with the starts, nulls first, and the starts leave no gap.
    by_start = sorted(got, key=lambda r: r[1])
    ids = [r[0] for r in by_start]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1].tolist()]
    assert token_files.round_trip(empty, FILE).collect() == []


STRANGE = [
    "<|endoftext|>a<|startoftext|> b", "it's WE'LL don't'VE", "a b c\u0085d\x1ce", "é ́x ΣΣ İI", "1234 5.6e7\n\n\t#$%&",
    "ẛ̣ ﬁ Å", "\U0001f468‍\U0001f469‍\U0001f467 กำ", "\x00\x01 �", "'s 't", "  ",
]


def encoded(encoder, texts):
    """Ids of each text without its end."""
    sizes, ids = encoder.encode(pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary()))
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert all(p[-1] == token_files.END for p in parts)
    return [p[:-1].tolist() for p in parts]


def whole(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    with open(FILE, "rb") as f:
        return token_files.Encoder(f.read())


def test_strings_equal_whole_texts(encoder, library):
    assert not encoder.whole
    texts = [j for t in STRANGE for j in (t, f"{t} {t}", f"{t}\v{t}\f", f"X{t}É", f"{t}\u0301{t.upper()}")]
    assert encoded(encoder, texts) == whole(library, texts)


def test_every_character(encoder, library):
    """Alone, between letters of both cases, and before and after a sign."""
    codes = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xF900, 0x10000, 7)]
    texts = [f"{c} a{c}b A{c}B J{c} .{c} {c}, '{c} {c}{c}" for c in codes]
    assert encoded(encoder, texts) == whole(library, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aBsStTlLvé\xc9\xd7\xf7\xdfÿ\u0178µ\u0301\u030cJ'’.,<|>0²½ \n\t\x1c\x85\xa0世ΣİẞǅŽ", max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    global _both
    if _both is None:
        with open(FILE, "rb") as f:
            _both = token_files.Encoder(f.read()), Tokenizer.from_file(FILE)
    assert encoded(_both[0], texts) == whole(_both[1], texts)


_both = None


def test_other_vocabularies_take_whole_texts():
    with open(token_files.public_vocabulary("byte_bpe_50k.json"), "rb") as f:
        data = f.read()
    encoder = token_files.Encoder(data)
    assert encoder.whole
    texts = ["Hello  world\n\n  it's <|endoftext|>", "", "é"]
    assert encoded(encoder, texts) == whole(Tokenizer.from_buffer(data), texts)


def test_malformed_bytes_count_as_replacement_characters(encoder, library):
    assert encoded(encoder, [b"ok", b"a\xff\xfe b"]) == whole(library, ["ok", "a\ufffd\ufffd b"])


def test_memory_is_bounded(documents, library, monkeypatch):
    monkeypatch.setattr(token_files, "CACHED", 50)
    with open(FILE, "rb") as f:
        encoder = token_files.Encoder(f.read())
    for row in documents.select("text").limit(30).collect():
        assert encoded(encoder, [row["text"]]) == whole(library, [row["text"]])
        for memory in (encoder.words, encoder.pieces):
            assert len(memory.young) <= memory.size and len(memory.old) <= 2 * memory.size


def test_slices_hold_every_row(monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 10)
    texts = [b"", b"x" * 30, b"abc", b"defg", b"hijk", b"", b"lmnopqrst"]
    batch = pa.RecordBatch.from_pydict({"doc": range(7), "data": pa.array(texts, pa.binary())})
    slices = [s.to_pylist() for _, s in token_files._slices(batch)]
    assert sum(slices, []) == texts and all(len(s) == 1 or sum(map(len, s)) <= 10 for s in slices)


@pytest.fixture(scope="module")
def written(spark):
    docs = spark.range(60_000).selectExpr("id * 2 AS doc_id", "concat('text number ', id, repeat(' more words', CAST(id % 7 AS INT))) AS text")
    path = scratch(spark, "token-test")
    token_files.write(docs, path, FILE)
    return path


def test_files_have_stripes_indexes_and_bloom_filters(spark, written):
    """Read from the stripes' own footers."""
    java = spark.sparkContext._jvm
    kinds, files = set(), glob.glob(f"{written.removeprefix('file:')}/*.orc")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        reader = java.org.apache.orc.OrcFile.createReader(java.org.apache.hadoop.fs.Path(file), java.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.INDEXED
        rows = reader.rows()
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            kinds |= {(s.getColumn(), str(s.getKind())) for s in footer.getStreamsList()}
            assert "DIRECT_V2" in {str(c.getKind()) for c in footer.getColumnsList()}
        rows.close()
    assert files and (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
    assert not {c for c, kind in kinds if kind == "BLOOM_FILTER_UTF8"} - {1}


def scanned(frame):
    """Rows that the scan of a collected frame gave."""
    plan = frame._jdf.queryExecution().executedPlan()
    leaf = plan
    while leaf.children().size():
        leaf = leaf.children().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_metadata_prunes(spark, written):
    found = token_files.look_up(spark, written, [4242])
    assert [r["doc"] for r in found.collect()] == [4242]
    assert scanned(found) <= 2 * token_files.INDEXED
    # An id between two others is inside every range, and the Bloom filter knows better.
    absent = token_files.look_up(spark, written, [4243])
    assert absent.collect() == []
    assert scanned(absent) <= token_files.INDEXED
    assert "PushedFilters: [IsNotNull(doc), EqualTo(doc,4242)]" in found._jdf.queryExecution().toString()


def test_starts_come_without_reading_ids_first(spark, written):
    frame = token_files.read(spark, written)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    narrow = [line for line in plan.splitlines() if "ReadSchema: struct<part:int,n_tokens:bigint>" in line]
    assert len(narrow) == 1


def test_parts_beyond_the_bound_join_by_shuffle(spark, written, monkeypatch):
    want = sorted(map(tuple, token_files.checksums(token_files.read(spark, written)).collect()))
    monkeypatch.setattr(token_files, "BROADCAST_FILES", 0)
    assert sorted(map(tuple, token_files.checksums(token_files.read(spark, written)).collect())) == want
    assert [r[1] for r in want] == [0, *np.cumsum([r[2] for r in want])[:-1].tolist()]
