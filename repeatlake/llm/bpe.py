"""Byte-pair encoding and decoding with public vocabularies, fragment by fragment.

A byte pair that occurs inside no vocabulary token can never be inside a merge:
between its two bytes every encoding has a token boundary. Such forced cuts
split a text into fragments that are encoded independently, each once as long
as it stays in a bounded memo, and concatenated. Cutting happens on two levels:

* whole texts are cut at the forced pairs of a visible byte and white space,
  found by one vectorised table lookup over all bytes. The splitting pattern
  never spans such a place either, and looks only forward, so a fragment (its
  white space, then what is visible) is split as it is in the text;
* a fragment not seen lately is split by the pattern, and each part again at
  every forced pair, before merges run on what is left.

Special tokens are cut out first, as the library does.

Cases: null is encoded as the empty text, which has no ids. Texts of any length
are worked on whole. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from repeatlake.llm.arrow import map_rows, plain_text, texts

#: The pattern that splits text before merges, white space spelled out as the library has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
MEMO = 250_000  # entries of a memo's newer half


class Memo(dict):
    """A bounded memo of ``make``: when full it becomes the older half, from which entries that are met again return."""

    def __init__(self, make: Callable, most: int = MEMO, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself where visible, else the next free one from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in seen}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """A tokenizer file with what its tokens say about byte pairs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        back = {c: b for b, c in enumerate(letters)}
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: c.encode() for c, i in self.special.items()}
        self.inside = np.zeros((256, 256), bool)
        for token, number in spec["model"]["vocab"].items():
            if number in self.bytes:
                continue
            core = token.removesuffix(self.suffix) if self.suffix else token
            if not all(c in back for c in core):
                core = ""
            raw = bytes(back[c] for c in core)
            self.bytes[number] = raw
            if len(raw) > 1:
                b = np.frombuffer(raw, np.uint8)
                self.inside[b[:-1], b[1:]] = True
        white = np.zeros(256, bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        #: pairs where a whole text is cut: forced, a byte that is not white space before one that is
        self.outer = ~self.inside & ~white[:, None] & white[None, :]
        self.flat = self.inside.tobytes()
        self.parts = Memo(self._part)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def forced(self, raw: bytes) -> list[bytes]:
        """``raw`` cut between the bytes of every pair that is inside no token."""
        if len(raw) < 64:  # too short for arrays to pay
            flat = self.flat
            cuts = [k for k, (a, b) in enumerate(zip(raw, raw[1:]), 1) if not flat[a << 8 | b]]
        else:
            b = np.frombuffer(raw, np.uint8)
            cuts = (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        if not cuts:
            return [raw]
        at = [0, *cuts, len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def _part(self, raw: bytes) -> list[int]:
        pieces = self.forced(raw)
        return self._merge(raw) if len(pieces) == 1 else [i for piece in pieces for i in self._merge(piece)]

    def _merge(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]


class ByteBpe(Vocabulary):
    """Byte-level BPE: ids of fragments as decimal text, and the bytes that decoding gives back."""

    def __init__(self, path: str):
        super().__init__(path)
        self.pattern = regex.compile(BYTE_PATTERN)
        self.fragments = Memo(self._fragment)

    def _fragment(self, raw: bytes) -> tuple[bytes, bytes]:
        parts, ids = self.parts, []
        for token in self.pattern.findall(raw.decode("utf-8")):
            ids += parts[token.encode("utf-8")]
        return b",".join(b"%d" % i for i in ids), self.decode(ids)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def _plain(self, raw: bytes) -> list[tuple[bytes, bytes]]:
        if not raw:
            return []
        b = np.frombuffer(raw, np.uint8)
        at = [0, *(np.flatnonzero(self.outer[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        memo = self.fragments
        return [memo[raw[i:j]] for i, j in zip(at, at[1:])]

    def encode(self, text: str) -> list[tuple[bytes, bytes]]:
        """Of each fragment the ids as decimal text joined by commas, and the bytes these ids decode to."""
        parts = self.split_special.split(text) if self.split_special else [text]
        if len(parts) == 1:
            return self._plain(text.encode("utf-8"))
        out = []
        for k, part in enumerate(parts):
            out += [(b"%d" % self.special[part], part.encode())] if k % 2 else self._plain(part.encode("utf-8"))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(i) for some, _ in self.encode(text) for i in some.split(b",")]


_LOADED: dict[tuple, object] = {}


def loaded(kind: type, path: str):
    """One instance for each Python worker, so its memos serve all of the worker's tasks."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trips(documents: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of every text's ids and of the text decoded from them."""

    def make():
        bpe = loaded(ByteBpe, vocabulary or public_path("byte_bpe_50k.json"))

        def each(batch: pa.RecordBatch):
            out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in texts(batch):
                got = bpe.encode(text)
                ids, raw = (b",".join([a for a, _ in got]), b"".join([b for _, b in got]))
                decoded = raw.decode("utf-8", errors="replace")
                out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
            yield out

        return each

    return map_rows(plain_text(documents, id_column), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def encode_documents(documents: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every text."""

    def make():
        bpe = loaded(ByteBpe, vocabulary or public_path("byte_bpe_50k.json"))
        return lambda batch: [{"doc_id": batch.column(0), "ids": [bpe.ids(t) for t in texts(batch)]}]

    return map_rows(plain_text(documents, id_column), "doc_id long, ids array<int>", make)


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids give a null text, an id outside the vocabulary an error."""

    def make():
        bpe = loaded(ByteBpe, vocabulary or public_path("byte_bpe_50k.json"))

        def each(batch: pa.RecordBatch):
            ids = batch.column(1)
            yield {"doc_id": batch.column(0), "text": [None if not x.is_valid else bpe.decode(x.as_py()).decode("utf-8", errors="replace") for x in ids]}

        return each

    return map_rows(encoded.selectExpr("cast(doc_id as long) as doc_id", "cast(ids as array<int>) as ids"), "doc_id long, text string", make)


def query(spark, sf_dir: str) -> DataFrame:
    """``op10``: every document encoded and decoded."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"))
