"""Fill-in-middle against a restatement over code points."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.test_llm import documents, odd, rows_of, small
from treeloom.llm import middle


def by_hand(doc_id, text, rate=90, spm=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return n, "plain", text, None, None
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if d % 100 < spm:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


ALPHABET = st.text(alphabet="ab Z9<PSM>\n\r\u0000éß각\U0001f600́", max_size=60)


@given(ALPHABET, st.integers(-5, 10**12))
def test_transform_equals_code_points(text, doc_id):
    got = middle.transform(doc_id, text.encode())
    assert (got.n, got.form, got.output.decode(), got.prefix_chars, got.middle_chars) == by_hand(doc_id, text)
    assert middle.restore(got.output, got.form).decode() == text


@given(ALPHABET)
def test_exceptions_convert_both_ways(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    index = middle.Exceptions(raw)
    places = np.arange(len(text) + 1)
    offsets = np.array([len(text[:i].encode()) for i in places])
    assert index.bytes(places).tolist() == offsets.tolist()
    assert index.chars(offsets).tolist() == places.tolist()
    assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


def test_restore_refuses_other_texts():
    for output, form in ((b"<P>a<M>b", "psm"), (b"a", "spm"), (b"<S>a<M>b<P>c", "spm")):
        with pytest.raises(ValueError):
            middle.restore(output, form)


def marked(spark):
    rows = [(100 + i, t, "a") for i, t in enumerate(["<P>", "a <S> b", "x<M>", "<P", "<<S>", "é" * 9, "word " * 300_000, "각a" * 50_000])]
    return documents(spark, rows + [(None, "<<P<S", None), (None, "<<P<S", None)])


@pytest.mark.parametrize("which", ["odd", "small", "marked"])
def test_query_rows_equal_brute_force(spark, sf_dir, which):
    docs = {"odd": odd, "marked": marked}[which](spark) if which != "small" else small(spark, sf_dir)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, form, output, prefix, mid = by_hand(r.doc_id, r.text)
        want.append((r.doc_id, n, form, prefix, mid, sha(output), sha(r.text or "")))
    got = [tuple(r.values()) for r in rows_of(middle.digests(docs))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_outputs_restore_through_spark(spark):
    docs = odd(spark)
    cuts = middle.fill_in_middle(docs, rate=100, spm=50)
    want = [(r.doc_id, *by_hand(r.doc_id, r.text, 100, 50)) for r in docs.collect()]
    got = [(r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in cuts.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {"psm", "spm", "plain"} <= {r[2] for r in got}
    back = sorted(repr((r.doc_id, r.text)) for r in middle.restored(cuts).collect())
    assert back == sorted(repr((r.doc_id, r.text or "")) for r in docs.collect())


def test_empty_table(spark):
    none = documents(spark, [])
    assert rows_of(middle.digests(none)) == [] and rows_of(middle.fill_in_middle(none)) == []
