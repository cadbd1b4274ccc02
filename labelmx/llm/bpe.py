"""BPE encoding and decoding with forced boundaries.

A byte pair that lies inside no token of the vocabulary can never be joined by a
merge, so a text may be cut there and its fragments encoded on their own. Of
those cuts the operator takes the ones between a non-space character and ASCII
white space: the pre-tokenizer also always splits there, whatever surrounds it,
so fragment ids put together are the ids of the whole text. Fragments repeat
(they are mostly words), so each is encoded once per task and then looked up;
special tokens have no white space and so lie in one fragment.

Decoding joins the tokens' bytes and reads them as UTF-8, malformed parts as U+FFFD.

Defined cases: null and empty texts have no ids, no ids decode to an empty text
(null ids too); unknown ids are left out; texts without cuts, however long, are
one fragment and are not kept; rows stay rows; extra columns are kept, a column
named like the output is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import column

_SPACES = b" \t\n\x0b\x0c\r"
_ASCII_CUT = re.compile("[ \\t-\\r]*[^ \\t-\\r]+|[ \\t-\\r]+").findall
_SEPARATOR = re.compile("[\\x1c-\\x1f]").search
_KEEP_CHARS = 64
#: Fragments that a task keeps may take this much memory, by a rough count; then it starts anew.
KEEP_BYTES = 32 << 20
_ENTRY_BYTES = 200  # of objects and table, beside characters and ids


# Fixed value: the pre-tokenizer pattern of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """What tasks need of a tokenizer: the bytes of each id, special tokens, and the pattern of its cuts."""

    tokens: list[bytes | None]
    special: dict[str, int]
    cuts: str | None


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE tokenizer file on the driver; its ids must follow its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if any(model["vocab"][t] != 256 + i for i, t in enumerate(merged)):
        raise ValueError("ids that follow the merges are needed")
    byte = _byte_of_char()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens: list[bytes | None] = [None] * (max([*model["vocab"].values(), *special.values()], default=-1) + 1)
    for token, i in model["vocab"].items():
        if token not in special:
            tokens[i] = bytes(byte[c] for c in token)
    cuts = forced_cuts(t for t in tokens if t)
    for token, i in special.items():
        tokens[i] = token.encode()
    return Vocabulary(tokens, special, cuts)


def forced_cuts(tokens: Iterable[bytes]) -> str | None:
    """Pattern of the places before white space where every text may be cut.

    The byte before such a place ends a non-space character and forms no pair
    inside any token with the white space behind it. Characters from U+0800 on
    are cut after only if none of their last bytes forms such a pair.
    """
    before: dict[int, set[int]] = {y: set() for y in _SPACES}
    for t in tokens:
        for a, b in zip(t, t[1:]):
            if b in before:
                before[b].add(a)
    parts = []
    for y, bad in before.items():
        free = [c for c in range(0x800) if not chr(c).isspace() and chr(c).encode("utf-8", "surrogatepass")[-1] not in bad]
        ranges: list[list[int]] = []
        for c in free:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        inside = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges)
        if not any(0x80 <= b < 0xC0 for b in bad):
            inside += "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _above())
        if inside:
            parts.append((inside, y))
    groups: dict[str, list[int]] = {}
    for inside, y in parts:
        groups.setdefault(inside, []).append(y)
    return "|".join(f"(?<=[{inside}])(?=[{''.join(f'\\x{y:02x}' for y in ys)}])" for inside, ys in groups.items()) or None


def _above() -> list[tuple[int, int]]:
    """Ranges of non-space characters from U+0800 on."""
    out, start = [], 0x800
    for c in range(0x800, 0x3002):
        if chr(c).isspace():
            if c > start:
                out.append((start, c - 1))
            start = c + 1
    return [*out, (start, 0x10FFFF)]


class Encoder:
    """Encodes texts in one task; keeps the ids of short fragments, up to a bound."""

    def __init__(self, tokens: list[bytes | None], special: dict[str, int], cuts: str | None):
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokens) if t is not None and i not in special.values()}
        self.plain = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ordinary = self.plain.encode_ordinary
        self.special = list(special)
        self.cut = re.compile(cuts).split if cuts else lambda text: [text]
        # in ASCII texts the cuts are simple, if no ASCII character was ruled out
        simple = "\\u0000-\\u0008\\u000e-\\u001b\\u0021-\\u0084"
        self.simple = cuts is not None and cuts.count("(?=") == cuts.count(simple) and all(f"\\x{y:02x}" in cuts for y in _SPACES)
        self.kept: dict[str, bytes] = {}
        self.size = 0

    def split(self, text: str) -> list[str]:
        return _ASCII_CUT(text) if self.simple and text.isascii() and not _SEPARATOR(text) else self.cut(text)

    def _ids(self, fragment: str) -> bytes:
        if any(s in fragment for s in self.special):
            return array("i", self.plain.encode(fragment, allowed_special="all")).tobytes()
        return array("i", self.ordinary(fragment)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        fragments, kept = self.split(text), self.kept
        new = set(fragments).difference(kept)
        for f in new:
            kept[f] = self._ids(f)
        ids = np.frombuffer(b"".join(map(kept.__getitem__, fragments)), np.int32)
        for f in new:
            if len(f) > _KEEP_CHARS:
                del kept[f]
            else:
                self.size += _ENTRY_BYTES + len(f) + len(kept[f])
        if self.size > KEEP_BYTES:
            kept.clear()
            self.size = 0
        return ids


def _slices(lengths: list[int], most: int = 1_000_000):
    """Ranges of rows of about ``most`` characters."""
    start = total = 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids of ``text``, as the tokenizer's own encode without added special tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))  # as large as the vocabulary file
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(*[column(c) for c in kept], column(text).cast("string").alias(out))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        encoder = Encoder(*shared.value)
        for b in batches:
            for s, e in _slices([len(x) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]):
                part = b.slice(s, e - s)
                ids = [encoder.encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=b.schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``: the text of ``ids``, special tokens included."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    given = rows.select(*[column(c) for c in kept], column(ids).alias(out))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches):
        tokens = [t or b"" for t in shared.value]
        known = len(tokens)
        for b in batches:
            texts = []
            for row in b.column(b.num_columns - 1):
                listed = row.values.to_pylist() if row.is_valid else []
                texts.append(b"".join([tokens[i] for i in listed if i is not None and 0 <= i < known]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=b.schema.names)

    return given.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document, encoded and decoded again.

    One pass per task: neither ids nor decoded texts leave it, and it holds those
    of one document at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(path)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches):
        encoder = Encoder(*shared.value)
        tokens = [t or b"" for t in shared.value[0]]
        decimal = [str(i) for i in range(len(tokens))]

        def digest(text):
            ids = encoder.encode(text).tolist()
            listed = sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest()
            back = b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")
            return len(ids), listed, sha256(back.encode()).hexdigest()

        for b in batches:
            done = [digest(t.as_py()) for t in b.column(1)]
            columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return rows.mapInArrow(run, schema)
