"""All queries on the smallest tables, with their SQL where there is one, or a plain version of their own columns; the pipeline, stage by stage."""

import base64
import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import decontam, exactdup, neardup, oracles, pii, queries, secrets, sharding, toxicity
from folioscope.llm.common import ascii_lower, words_of
from tests.compare import connect, difference
from tests.llm.data import documents, stored
from tests.llm.test_neardup import classes
from tests.llm.test_scans import plain_hits


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    if name != "op13_hard_negatives":
        assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    if name in oracles.oracle_sql():
        assert difference(df, connect(sf), oracles.oracle_sql()[name]) is None


def texts_of(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted((a, kinds.index(k), k, b) for k, a, b in spans))


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def digits(text):
    return "".join(c for c in text if c in "0123456789")


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
)
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6 and m[1].isascii()),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


@pytest.mark.parametrize("name, base, rules", [("op2_pii", PII, ()), ("op3_secrets", SECRETS, secrets.ADDED_RULES)])
def test_spans_by_plain_patterns(spark, sf, name, base, rules):
    """Counts, the digest of the base spans, and the list of all spans: base ones by plain patterns, and those of the added rules where they are patterns."""
    texts = texts_of(spark, sf)
    kinds = [k for k, _, _ in base]
    for r in queries.queries()[name](spark, sf).collect():
        text = texts[r.doc_id]
        spans = [(k, m.start(), m.end()) for k, p, ok in base for m in re.finditer(p, text) if ok(m)]
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        assert r.base_sha256 == sha(joined(spans, kinds)), r.doc_id
        found = r.spans.split(",") if r.spans else []
        if rules:
            spans += [(x.kind, m.start(), m.end()) for x in rules for m in re.finditer(x.pattern, text)]
            assert r.spans == joined(spans, [*kinds, *(x.kind for x in rules)])
        else:
            assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(found) and len(found) == len(set(found))


def test_token_digests(spark, sf):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = texts_of(spark, sf)
    for r in queries.queries()["op7_byte_bpe"](spark, sf).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[r.doc_id]))


def test_token_files(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in queries.queries()["op8_token_files"](spark, sf).collect()}
    at = 0
    for i, text in sorted(texts_of(spark, sf).items()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_long_runs_are_scanned_once():
    """A rule's time follows the text's length."""
    scanner = secrets.Scanner(secrets.RULES)
    assert scanner.scan(["eyJ" * 300_000, "eyJ." * 200_000, "x eyJa.eyJb.c"])[2]["jwt"] == [(2, 13)]


@pytest.mark.parametrize("work", [lambda d: sharding.shard(d, queries.SHARD_TREE), exactdup.exact_groups, neardup.near_groups])
def test_columns_of_any_name_stay(spark, tmp_path, work):
    names = ["a.b", *(f"__{n}" for n in "rank start run row node digest key hot n best piece c0 b0 maybe region rack size".split()), "row", "node", "id", "in0", "cell"]
    rows = [(i, f"some text of some words number {i // 2}", *[f"{n} {i}" for n in names]) for i in range(6)]
    docs = stored(spark.createDataFrame(rows, ["doc_id", "text", *names]), tmp_path)
    made = work(docs)
    assert made.columns[: len(docs.columns)] == docs.columns
    assert sorted(tuple(r)[: len(docs.columns)] for r in made.collect()) == rows


def test_shards_of_the_query_by_hand(spark, sf):
    """The query's own tree of 24 shards: sizes, checksums, slots, and what one more shard takes."""
    text = texts_of(spark, sf)
    rows = queries.queries()["op1_sharding"](spark, sf).collect()
    slots = {}
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert 0 < sum(r.grown_shard == 24 for r in rows) < len(rows) / 4
    again = sharding.shard(spark.createDataFrame([(r.doc_id, None) for r in rows], "doc_id long, text string"), queries.SHARD_TREE)
    assert {r.doc_id: r.shard for r in again.collect()} == {r.doc_id: r.shard for r in rows}


def test_near_classes_of_the_query(spark, sf):
    docs = sorted(texts_of(spark, sf).items())
    of = classes(docs)
    rows = {r.doc_id: r for r in queries.queries()["op5_near_dedup"](spark, sf).collect()}
    sizes = {}
    for _, t in docs:
        first = of[ascii_lower(t)][0]
        sizes[first] = sizes.get(first, 0) + 1
    for i, t in docs:
        first = of[ascii_lower(t)][0]
        assert (rows[i].class_id, rows[i].class_size, rows[i].kept) == (first, sizes[first], i == first)


def test_pii_time_follows_the_length():
    for unit in ("IBAN", "iban DE", "http://-", "http://", "@", "a@", "a@b.", "+1", "+1(", "ssn:", "SSN    ", "1.", "1-"):
        took = []
        for size in (40_000, 320_000):
            began = time.process_time()
            pii.find(unit * (size // len(unit)))
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.01)  # 8 times the text; a quadratic walk takes 64 times as long


def test_pipeline_by_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = queries.toxicity_model(spark, sf)
    bad = model.score([t for _, t in docs]) >= 0.3
    kept = [d for d, b in zip(docs, bad) if not b]
    last = {ascii_lower(t or ""): max(j for j, u in kept if ascii_lower(u or "") == ascii_lower(t or "")) for _, t in kept}
    kept = [d for d in kept if last[ascii_lower(d[1] or "")] == d[0]]
    of = classes(kept)
    kept = [d for d in kept if of[ascii_lower(d[1] or "")][0] == d[0]]
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.SuffixAutomaton(items, 13)

    def clean(text):
        words = words_of(text)
        flags, _, _ = index.hits(words)
        return not flags or 20 * sum(flags) < len(words)

    dirty = [d for d in kept if not clean(d[1])]
    assert all(sum(plain_hits(words_of(t), items, 13)[0]) * 20 >= len(words_of(t)) for _, t in dirty)
    want = {i for i, t in kept if clean(t)}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "byte-level BPE"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), sf)
        assert out.columns == docs.columns and out.count() == 0
    assert exactdup and toxicity


def test_stages_on_awkward_rows(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names: columns stay, and what goes is what the stage takes out."""
    docs = stored(documents(spark), tmp_path)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    nodes, of = {ascii_lower(t or "") for _, t in rows}, classes(rows)
    want = {"exact dedup": len(nodes), "near dedup": len({of[n][0] if of[n][1] > 1 else n for n in nodes}), "byte-level BPE": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        found = out.collect()
        assert len(found) == want.get(name, len(found)) <= len(rows)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
            left = {(r.doc_id, r.text) for r in found}
            assert left <= set(rows)
            if name in ("toxicity", "decontamination"):  # equal rows go or stay together
                assert len(found) == sum(r in left for r in rows)
