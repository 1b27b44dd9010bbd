"""Byte-level BPE: encoding with character offsets, and decoding.

The tokenizers library does the merges. Texts come as Arrow arrays. Their bytes are cut, for a whole batch at once, before single blanks and around single line ends (which the split pattern never crosses); Arrow's dictionary encoding finds the distinct pieces, and each of them is encoded once per worker: its UTF-8 bytes are mapped to the printable characters that the model's vocabulary is written in, and the model tokenizes each match of the split pattern. The texts' ids are then gathered by piece. A worker's memory of pieces is bounded. Texts that hold one of the definition's added tokens are split there first, as the library does by default.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from folioscope.llm.common import bounded_batches, free_columns, held, map_texts

#: Letters below it have long been letters in every version of Unicode.
_PLAIN = "\u0250"
_WHITE = [*range(9, 14), *range(28, 33)]
#: Bytes that white space beyond ASCII begins with.
_WIDE_WHITE = (0xC2, 0xE1, 0xE2, 0xE3)
_NO_WHITE = np.ones(256, dtype=bool)
_NO_WHITE[_WHITE] = False
#: Bytes that certainly begin a character that is no white space.
_BEGINS = _NO_WHITE.copy()
_BEGINS[list(_WIDE_WHITE)] = False
#: Bytes of text that are worked on at once.
WINDOW = 8 << 20
_LONG = 64


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves, the others from 256 on in order."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def tokenizer_json_from_ranks(path: str) -> str:
    """A tokenizers definition with the vocabulary and the merges that a rank file implies.

    A token's merge is the pair of parts that is left when all merges of lower rank have been applied to its bytes.
    """
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    as_text = byte_characters()
    name = lambda token: "".join(as_text[b] for b in token)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            i = min(range(len(found)), key=found.__getitem__)
            if found[i] >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append([name(parts[0]), name(parts[1])])
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name(t): r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model})


def piece_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of texts that stand one behind the other, and begin at starts (ascending).

    A blank or a line end alone between two characters that are no white space ends a piece: the blank begins the next one, the line end is a piece of its own. Where a neighbour may be white space beyond ASCII, nothing is cut.
    """
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[starts] = True
    out = first.copy()
    for sign in (32, 10):
        at = np.nonzero(raw[:-1] == sign)[0]
        at = at[(at > 0) & ~first[at] & ~first[at + 1]]
        before = raw[at - 1]
        two, three = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
        alone = _BEGINS[raw[at + 1]] & np.where(before < 128, _NO_WHITE[before], (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))
        out[at[alone]] = True
        if sign == 10:
            out[at[alone] + 1] = True
    return np.nonzero(out[: len(raw)])[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, the places where they begin and the end of the last); null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = texts.buffers()
    kind = "<i8" if pa.types.is_large_string(texts.type) else "<i4"
    places = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[places[0] : places[-1]] if places[-1] > places[0] else np.zeros(0, dtype=np.uint8)
    return raw, places - places[0]


class Codec:
    """Encodes and decodes with a byte-level BPE given as tokenizers JSON."""

    def __init__(self, definition: str, pattern: str, limit: int = 250_000):
        self.model = (kept := Tokenizer.from_str(definition)).model
        self._kept = kept
        self.model._resize_cache(0)  # every piece is asked for once
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))
        self.find = regex.compile(pattern).findall
        self.vocabulary = kept.get_vocab(with_added_tokens=True)
        added = kept.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that look at or take what is around them are not supported")
        self.added = {t.content: i for i, t in added.items() if t.content}
        # the library looks for tokens that aren't normalized first; of several at a place, the longest is taken
        rounds = [sorted((t.content for t in added.values() if t.content and t.normalized == n), key=len, reverse=True) for n in (False, True)]
        self.marks = [re.compile("(" + "|".join(map(re.escape, r)) + ")") for r in rounds if r]
        self.blank, self.limit = characters[32], limit
        # place << 32 | number of the ids of each piece known
        self.pieces: dict[bytes, int] = {}
        # ids of the pieces, and behind the used ones those that aren't in the array yet
        self.ids, self.used, self.fresh = np.zeros(1 << 20, dtype=np.uint32), 0, []
        self._bytes = None

    def _match(self, text: str) -> list[int]:
        return [token.id for token in self.model.tokenize(text)]

    def _piece_ids(self, piece: bytes) -> list[int]:
        """A word of letters that every engine takes for letters is one match with the blank before it, and so is a comma or full stop behind it."""
        body = piece[1:] if piece[:1] == b" " else piece
        if body.isalpha():
            return self._match(piece.decode().replace(" ", self.blank))
        if not body.isascii() and (text := body.decode()).isalpha() and max(text) < _PLAIN:
            return self._match(piece.decode("latin-1").translate(self.to_characters))
        if body[-1:] in (b",", b".") and body[:-1].decode().isalpha():
            return [*self._known(piece[:-1]), *self._known(piece[-1:])]
        return [i for match in self.find(piece.decode()) for i in self._match(match.encode().decode("latin-1").translate(self.to_characters))]

    def _known(self, piece: bytes) -> list[int]:
        code = self.pieces.get(piece)
        if code is None:
            code = self._add(piece)
        at = (code >> 32) - self.used
        return self.fresh[at : at + (code & 0xFFFFFFFF)] if at >= 0 else self.ids[code >> 32 : (code >> 32) + (code & 0xFFFFFFFF)].tolist()

    def _add(self, piece: bytes) -> int:
        ids = self._piece_ids(piece)
        code = self.used + len(self.fresh) << 32 | len(ids)
        self.fresh += ids
        if len(piece) <= _LONG:
            self.pieces[piece] = code
        return code

    def _settle(self) -> None:
        """Move fresh ids into the array."""
        end = self.used + len(self.fresh)
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(self.fresh)), dtype=np.uint32)])
        self.ids[self.used : end] = self.fresh
        self.used, self.fresh = end, []

    def _window(self, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids before each text and all in all) of texts that begin at places."""
        if not len(raw):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(places), dtype=np.int64)
        if len(self.pieces) >= self.limit or self.used >= 16 * self.limit:
            self.pieces.clear()
            self.ids, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        starts = piece_starts(raw, places[:-1])
        offsets = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        _, bounds, data = pieces.dictionary.buffers()
        bounds, data = np.frombuffer(bounds, dtype="<i4")[: len(pieces.dictionary) + 1].tolist(), data.to_pybytes()
        distinct = [data[a:b] for a, b in zip(bounds, bounds[1:])]
        # a piece may have become known as a part of another new one
        codes = [c if c is not None else k if (k := self.pieces.get(p)) is not None else self._add(p) for p, c in zip(distinct, map(self.pieces.get, distinct))]
        self._settle()
        own = np.array(codes, dtype=np.int64)[pieces.indices.to_numpy()]
        counts = own & 0xFFFFFFFF
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat((own >> 32) - ends + counts, counts) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, places)]

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one text, a window of whole pieces at a time."""
        out, at, size = [], 0, WINDOW
        while at < len(raw):
            end = min(at + size, len(raw))
            if end < len(raw):
                last = int(piece_starts(raw[at:end], np.zeros(1, dtype=np.int64))[-1])
                if not last:
                    size *= 2
                    continue
                end = at + last
            out.append(self._window(raw[at:end], np.array([0, end - at]))[0])
            at, size = end, WINDOW
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)

    def _plain(self, raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Like _window, for texts of any size without added tokens."""
        if len(raw) <= WINDOW:
            return self._window(raw, places)
        out, counts, at, n = [], [], 0, len(places) - 1
        while at < n:
            end = max(int(np.searchsorted(places, places[at] + WINDOW, side="right")) - 1, at + 1)
            own = raw[places[at] : places[end]]
            if end == at + 1:
                out.append(self._long(own))
                counts.append(np.array([len(out[-1])]))
            else:
                ids, before = self._window(own, places[at : end + 1] - places[at])
                out.append(ids)
                counts.append(np.diff(before))
            at = end
        return np.concatenate(out), np.cumsum(np.concatenate([[0], *counts]))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids before each text and all in all); null is empty."""
        raw, places = text_bytes(texts)
        held = raw.tobytes() if self.added else b""
        if not any(t.encode() in held for t in self.added):
            return self._plain(raw, places)
        split = [self._split(t or "") for t in texts.to_pylist()]
        parts = [p for s in split for p in s]
        ids, before = self._plain(*text_bytes(pa.array(["" if token else p for p, token in parts], pa.string())))
        each = [np.array([self.added[p]], dtype=np.uint32) if token else ids[a:b] for (p, token), a, b in zip(parts, before[:-1], before[1:])]
        counts = np.cumsum([0, *map(len, each)])
        return np.concatenate([np.zeros(0, dtype=np.uint32), *each]), counts[np.cumsum([0, *map(len, split)])]

    def _split(self, text: str) -> list[tuple[str, bool]]:
        """The text's parts, each with whether it is an added token."""
        parts = [(text, False)]
        for mark in self.marks:
            parts = [x for p, token in parts for x in ([(p, True)] if token else [(q, k % 2 == 1) for k, q in enumerate(mark.split(p))])]
        return parts

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()))[0]

    @property
    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; the reverse of the byte table."""
        if self._bytes is None:
            back = {c: b for b, c in enumerate(byte_characters())}
            self._bytes = [b""] * (max(self.vocabulary.values(), default=-1) + 1)
            for token, i in self.vocabulary.items():
                self._bytes[i] = bytes(back[c] for c in token) if token not in self.added and all(c in back for c in token) else token.encode()
            self.lengths = np.array([len(b) for b in self._bytes], dtype=np.int64)
        return self._bytes

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, joined before anything is read as characters, so a character may be split over ids."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that are no UTF-8 (as in a cut sequence) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each id in the text; ids that share a split character all cover it."""
        self.token_bytes  # noqa: B018
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        character = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80) - 1
        return character[starts].astype(np.int32), (character[ends - 1] + 1).astype(np.int32)


def codec(definition: str, pattern: str, limit: int = 250_000) -> Codec:
    """One codec in each worker, whatever the number of its tasks; limit bounds its memory of pieces (about 0.2 kB each; it is emptied when it is full)."""
    return held("codec", (definition, pattern, limit), lambda: Codec(definition, pattern, limit))


def int_lists(values: np.ndarray, before: np.ndarray) -> pa.ListArray:
    """A list array of ints; row i has the values from before[i] to before[i + 1]."""
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(values.view("<i4") if values.dtype == np.uint32 else values.astype("<i4")))


IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), True))


def encode(docs: DataFrame, definition: str, pattern: str, text_col: str = "text", offsets: bool = False, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """docs's columns (or those in keep) and ids: the ids of the whole text, each match of the pattern encoded separately, without special tokens of the encoder's own; the definition's added tokens in the text are one id each.

    offsets adds starts and ends: the first character and the end (exclusive) of each id, in code points. decoded adds the bytes that the ids decode to. Input columns of these names give way. Null and empty texts have no ids; rows are independent, so repeated rows give repeated results; an empty table gives an empty table.
    """
    fields = [IDS]
    fields += [T.StructField(n, T.ArrayType(T.IntegerType(), True)) for n in ("starts", "ends")] if offsets else []
    fields += [T.StructField("decoded", T.BinaryType())] if decoded else []

    def make():
        own = codec(definition, pattern)

        def work(texts: pa.Array):
            ids, before = own.encode_column(texts)
            out = [int_lists(ids, before)]
            if offsets or decoded:
                each = [ids[a:b] for a, b in zip(before[:-1], before[1:])]
                raw = [own.decode_bytes(i) for i in each]
                if offsets:
                    both = [own.offsets(i, r) for i, r in zip(each, raw)]
                    out += [int_lists(np.concatenate([np.zeros(0, dtype=np.int32), *(b[k] for b in both)]), before) for k in (0, 1)]
                if decoded:
                    out.append(pa.array(raw, pa.binary()))
            return out

        return work

    return map_texts(docs, fields, make, text_col, keep, arrow=True)


def decode(df: DataFrame, definition: str, pattern: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """df without ids_col and with the decoded text in out (an input column of that name gives way). Null ids are none; bytes that are no UTF-8 become U+FFFD."""
    base = free_columns(df, [out] if out != ids_col else [])
    passed = [c for c in base.columns if c != ids_col]
    source = base.select(*[base[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(passed)], base[ids_col].cast("array<int>").alias("i"))
    schema = T.StructType([*(T.StructField(f"c{i}", base.schema[c].dataType) for i, c in enumerate(passed)), T.StructField("d", T.StringType())])

    def run(batches):
        own = codec(definition, pattern)
        for batch in batches:
            *rest, ids = batch.columns
            yield pa.RecordBatch.from_arrays([*rest, pa.array([own.decode(np.array(x or [], dtype=np.int64)) for x in ids.to_pylist()], pa.string())], names=schema.names)

    return bounded_batches(source).mapInArrow(run, schema).toDF(*passed, out)
