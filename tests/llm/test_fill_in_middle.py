import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bulwark.llm import fill_in_middle as fim


def plain(id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rule, on code points."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = []
    for id, text in rows:
        *head, output = plain(id, text)
        out.append((id, *head, sha(output), sha(text or "")))
    return sorted(out, key=str)


def check(docs):
    got = [tuple(r) for r in fim.digests(fim.arranged(docs)).collect()]
    assert sorted(got, key=str) == expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, empty):
    check(odd)
    assert fim.digests(fim.arranged(empty)).collect() == []


def test_forms_all_occur(documents):
    forms = {r["form"] for r in fim.digests(fim.arranged(documents)).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_markers_in_texts_and_between_parts(spark):
    rows = [(i, t) for i, t in enumerate(["a<P>b", "<S>", "x <M", "<P", "< P>", "a<" * 40, "<<<>>>" * 30, "S>M>P>" * 50, "<P" * 33] * 12)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_small_pieces_and_blocks(spark, odd, monkeypatch):
    """Cuts inside runs of letters, characters of several bytes, and blocks."""
    rows = [(i, t) for i, t in enumerate(["é😀" * 50, "abc" * 40 + "日本語 x1" * 9, " " * 77, "ab " * 60] * 8)]
    for units, size, block in ((1, 1, 1), (2, 3, 7), (5, 64, 16)):
        for id, text in rows:
            data = text.encode()
            monkeypatch.setattr(fim, "UNITS", units)
            monkeypatch.setattr(fim, "BYTES", size)
            monkeypatch.setattr(fim, "BLOCK", block)
            n, form, first, second, counted = fim.plan(id, data)
            pieces = list(fim.output_pieces(data, form, first, second, counted))
            chars = (None, None) if form == "plain" else (counted.chars(0, first), counted.chars(first, second))
            assert (n, form, *chars, b"".join(pieces).decode()) == plain(id, text)
            assert max(map(len, pieces)) <= size + fim.MARKER


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>ab é\U0001f600", max_size=60), st.integers(-(2**63), 2**63 - 1), st.integers(1, 5))
def test_stream_restores(text, id, step):
    n, form, first, second, units = fim.plan(id, text.encode())
    output = b"".join(fim.output_pieces(text.encode(), form, first, second, units))
    restorer, parts = fim.Restorer(form), {0: [], 1: [], 2: []}
    found = [p for i in range(0, len(output), step) for p in restorer.feed(output[i : i + step])]
    for rank, data in [*found, *restorer.end()]:
        parts[rank].append(data)
    assert b"".join(b"".join(parts[r]) for r in range(3)).decode() == text


def test_outputs_and_restored_texts(odd):
    written = fim.outputs(fim.arranged(odd))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(((r["doc_id"], r["output"]) for r in written.collect()), key=str) == sorted(((i, plain(i, t)[4]) for i, t in rows), key=str)
    back = fim.restored(written)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_one_shuffle(documents):
    """The pieces cross the network once; restoring sorts inside the partitions."""
    frame = fim.digests(fim.arranged(documents))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    assert plan.count("Sort [") == 2


@pytest.mark.parametrize("text", ["", None])
def test_empty_text_is_plain(spark, text):
    row = fim.digests(fim.arranged(spark.createDataFrame([(3, text)], "doc_id long, text string"))).first()
    assert (row["n"], row["form"], row["prefix_chars"], row["output_sha256"]) == (0, "plain", None, sha(""))
