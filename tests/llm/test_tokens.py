"""Byte-level BPE and token files: the tiktoken library, exact round trips."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscope.llm import bpe, queries, tokenbin
from tests.llm.data import documents, empty, stored, texts


@pytest.fixture(scope="module")
def definition():
    return queries.ranked_tokenizer()


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_is_tiktoken(definition, reference):
    own, rng = bpe.Codec(definition, public_tokenizers.PATTERN, limit=50), random.Random(3)
    odd = "ab'sé 1  \n\t.,!  ß漢😀\x1c\x85ªₐ²½​﻿"
    for t in [*texts(), *("".join(rng.choice(odd) for _ in range(rng.randint(0, 14))) for _ in range(4000)), "<|endoftext|> x", "I'll we've don't 'S"]:
        ids = own.encode(t)
        assert ids.tolist() == reference.encode_ordinary(t or "")
        raw = own.decode_bytes(ids)
        assert raw == (t or "").encode() and own.decode(ids) == (t or "")
        if len(ids):
            starts, ends = own.offsets(ids, raw)
            assert starts[0] == 0 and ends[-1] == len(t) and (starts[1:] <= ends[:-1]).all()
            if (t or "").isascii():
                assert "".join(t[a:b] for a, b in zip(starts, ends)) == t
    assert own.decode(own.encode("漢")[:1]) == "�"  # a character cut in two


def test_encode_and_decode_tables(spark, definition, tmp_path):
    docs = stored(documents(spark), tmp_path)
    coded = bpe.encode(docs, definition, public_tokenizers.PATTERN, offsets=True)
    assert set(coded.columns) == {*docs.columns, "starts", "ends"}
    back = bpe.decode(coded.select("doc_id", "ids", "text"), definition, public_tokenizers.PATTERN, out="again").collect()
    assert len(back) == docs.count() and all(r.again == (r.text or "") for r in back)
    assert bpe.encode(empty(spark), definition, public_tokenizers.PATTERN).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(7)
    for bits in (0, 1, 3, 8, 16, 17, 31, 33, 60, 63):
        for n in (0, 1, 2, 61, 1000, 5000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.int64).astype(np.uint64)
            if n > 2 and bits > 16:
                ids[[0, n // 2]] = (1 << 64) - 1  # escapes
            (payload,) = tokenbin.pack(ids)
            assert (tokenbin.unpack(payload) == ids).all()
            # the same ids as documents of several sizes, some of them empty, and as one block of them
            ends = np.sort(rng.integers(0, n + 1, 5))
            ends[-1] = n
            several = tokenbin.pack(ids, ends)
            assert all((tokenbin.unpack(p) == ids[a:b]).all() for p, a, b in zip(several, [0, *ends], ends))
            assert (tokenbin.unpack(tokenbin.join([tokenbin.join(several[:2]), *several[2:]])) == ids).all()
    assert len(tokenbin.pack(np.zeros(24_000, dtype=np.uint64))[0]) < 1000
    with pytest.raises(ValueError):
        tokenbin.unpack(b"nothing of the kind")


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = stored(documents(spark), tmp_path)
    with open(path, encoding="utf-8") as f:
        tokenbin.write_tokens(docs, str(tmp_path / "files"), f.read(), public_tokenizers.PATTERN, 2, block_ids=300)
    rows = tokenbin.read_tokens(spark, str(tmp_path / "files")).collect()
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    at = 0
    for (doc_id, text), r in zip(order, sorted(rows, key=lambda r: r.start), strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (doc_id, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_token_files_with_added_tokens(spark, tmp_path):
    """The library in its default setting takes an added token in the text for one id."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(8)
    rows = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n  y <|endoftext|", "é<|endoftext|>漢 ", None]
    rows += ["".join(rng.choice(["<|endoftext|>", " ", "  ", "word", "\n", "'s", "é", "<|"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = stored(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3), tmp_path)
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    tokenbin.write_tokens(docs, str(tmp_path / "files"), definition, public_tokenizers.PATTERN, 2, block_ids=50)
    found, at = {r.doc_id: r for r in tokenbin.read_tokens(spark, str(tmp_path / "files")).collect()}, 0
    for i, text in enumerate(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (found[i].start, list(found[i].ids)) == (at, ids), text
        assert bpe.codec(definition, public_tokenizers.PATTERN).decode(np.array(ids[:-1])) == (text or "")
        at += len(ids)


def test_token_files_of_nothing(spark, definition):
    assert tokenbin.token_files(empty(spark), definition, public_tokenizers.PATTERN, 2).count() == 0
