"""Fill-in-the-middle against the definition in plain Python, over any chunk size; the automaton against a walk byte by byte."""

import hashlib
import re

import numpy as np
import pytest

from folioscope.llm import fim
from tests.llm.data import documents, empty, stored

AWKWARD = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "one\ntwo\n\nthree", "mark <P> here\nx", "almost <P\n> <<S x", "<M>", "😀\n漢字\nñ", "x" * 50 + "\n" + "y" * 70 + "\n", "a<\nS>b", "\n".join(f"line {i} é" for i in range(40))]


def plain(id_, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("chunk_bytes", [3, 16, 1 << 16])
def test_any_chunk_size(spark, tmp_path, chunk_bytes):
    docs = documents(spark, [(100 + i, t, *[None] * 18) for i, t in enumerate(AWKWARD) if chunk_bytes > 3 or len(t or "") < 500])
    if chunk_bytes < 1000:
        docs = docs.filter("coalesce(length(text), 0) < 1500")
    docs = stored(docs, tmp_path)
    made = fim.fill_in_middle(docs, chunk_bytes=chunk_bytes)
    assert made.columns == [*docs.columns, *fim.OUTPUT]
    rows = made.withColumn("back", fim.restored(made.output, made.form)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "spm", "psm"}


def test_rates_and_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a\nb {i}\nc", "kept", "gives way", 1) for i in range(60)], "`doc_id` long, text string, `a.b` string, output string, row int")
    made = fim.fill_in_middle(stored(docs, tmp_path), percent=50, spm_percent=20)
    assert made.columns == ["doc_id", "text", "a.b", "row", *fim.OUTPUT]
    for r in made.collect():
        assert (r["a.b"], r["row"]) == ("kept", 1)
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, 50, 20)
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_functions_by_walk():
    automaton = fim.Automaton()
    rng = np.random.default_rng(5)
    chunks = [bytes(rng.choice(list(b"\n<PSM>xy"), rng.integers(0, 60))) for _ in range(200)]
    ends, starts = automaton.functions(chunks)
    for chunk, end, start in zip(chunks, ends, starts):
        for state in range(automaton.states):
            at, n = state, 0
            for byte in chunk:
                c = automaton.classes[byte]
                n += automaton.starts[c, at]
                at = automaton.step[c, at]
            assert (at, n) == (end[state], start[state])
    # a cut anywhere composes to the same function
    whole = b"".join(chunks)
    (one,), (count,) = automaton.functions([whole])
    both = fim.composed(ends, starts, np.zeros(len(chunks), dtype=int))
    assert (both[0][0] == one).all() and (both[1][0] == count).all()
    assert automaton.marked(one[:1])[0] == any(m.encode() in whole for m in fim.MARKS)
