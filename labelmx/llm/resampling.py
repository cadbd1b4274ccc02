"""Target-distribution importance resampling over hashed word n-grams.

Features of a text are its runs of one to three consecutive words; each falls
into one of ``BUCKETS`` buckets by the crc32 of its bytes. A bucket's gain is the
log ratio of its smoothed share in the target texts to that in the documents, a
document's weight the sum over its features, and a draw without replacement of
the documents takes the largest weights with Gumbel noise added.

Segment deduplication. A newline separates words, so it cuts a text into lines
and no run inside a line depends on its neighbours. All lines of all documents
are grouped to distinct lines with their occurrences; the features of a distinct
line are counted once and multiplied. Runs that reach over a line's end are
counted in the documents on their own and added. Weights are summed the same way,
with the distinct lines of a few megabytes of text at a time, where no exchange is needed.

A run's crc32 comes from those of its words: appending ``k`` bytes to a text maps
its crc32 by a linear function of ``k`` alone, held as four tables of 256 entries.

Defined cases: null and empty texts have no words, no features and weight 0;
texts and lines of any length are taken whole; equal texts have equal weights and
are drawn on their own; rows stay rows, a null ``doc_id`` hashes as an empty one
and loses ties; with fewer than 20 documents of 20 words nothing is drawn; no
documents give no rows, no target texts only smoothed shares; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered
from .base import column
from .terms import byte_table, gathered, mapped, word_codes

BUCKETS = 10_000
_GATHER = 4 << 20
_WORDS = byte_table(digits=True)
_LINES = byte_table(digits=True, newlines=True)


def _byte_step() -> np.ndarray:
    """What one appended zero byte does to a crc32, by its lowest byte (the polynomial is a fixed value)."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 0xFF]
    for k in range(1, 4):
        out = out ^ tables[k][(crc >> np.uint32(8 * k)) & 0xFF]
    return out


@lru_cache(maxsize=4096)
def _doubled(bit: int) -> np.ndarray:
    """Tables of ``2**bit`` appended bytes."""
    if bit == 0:
        low = np.arange(256, dtype=np.uint32)
        return np.stack([_byte_step()] + [low << np.uint32(8 * (k - 1)) for k in range(1, 4)])
    half = _doubled(bit - 1)
    return np.stack([_apply(half, half[k]) for k in range(4)])


@lru_cache(maxsize=4096)
def _appended(size: int) -> np.ndarray:
    """Tables of ``size`` appended bytes."""
    low = np.arange(256, dtype=np.uint32)
    out = np.stack([low << np.uint32(8 * k) for k in range(4)])
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            out = np.stack([_apply(_doubled(bit), t) for t in out])
    return out


class Words:
    """crc32 of the distinct words of a batch, and of runs of them."""

    def __init__(self, dictionary: pa.Array):
        texts = dictionary.cast(pa.large_binary()).to_pylist()
        self.crc = np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))
        self.spaced = np.fromiter((zlib.crc32(b" ", c) for c in self.crc.tolist()), np.uint32, len(texts))
        sizes, self.size = np.unique(np.fromiter(map(len, texts), np.int64, len(texts)), return_inverse=True)
        # a row of entries per distinct length of a word
        self.tables = np.stack([_appended(int(s)) for s in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)

    def _then(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """crc32 of a text with another word appended."""
        row = self.size[word]
        out = self.crc[word]
        for k in range(4):
            out = out ^ self.tables[row, k, (crc >> np.uint32(8 * k)) & 0xFF]
        return out

    def _space(self, crc: np.ndarray) -> np.ndarray:
        return _apply(_doubled(0), crc) ^ np.uint32(zlib.crc32(b" "))

    def pairs(self, a, b) -> np.ndarray:
        return self._then(self.spaced[a], b)

    def triples(self, a, b, c) -> np.ndarray:
        return self._then(self._space(self.pairs(a, b)), c)


def runs(words: Words, code: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run of one to three words inside one part, and the part; ``part`` ascends along the words."""
    two = np.flatnonzero(part[1:] == part[:-1])
    three = two[part[np.minimum(two + 2, len(part) - 1)] == part[two]]
    three = three[three + 2 < len(part)]
    crc = [words.crc[code], words.pairs(code[two], code[two + 1]), words.triples(code[three], code[three + 1], code[three + 2])]
    return np.concatenate(crc) % BUCKETS, np.concatenate([part, part[two], part[three]])


def crossing(words: Words, code: np.ndarray, line: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every run that reaches over the end of a line inside one document, and the document."""
    one = np.arange(len(code))
    two = one[:-1][(doc[1:] == doc[:-1]) & (line[1:] != line[:-1])]
    three = one[:-2][(doc[2:] == doc[:-2]) & (line[2:] != line[:-2])]
    crc = [words.pairs(code[two], code[two + 1]), words.triples(code[three], code[three + 1], code[three + 2])]
    return np.concatenate(crc) % BUCKETS, np.concatenate([doc[two], doc[three]])


class Cut:
    """Texts of a batch cut into distinct lines: the words of these, and the sequence of lines of each text."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(mapped(texts, _LINES), "\n")
        coded = pc.utf8_trim(lists.flatten(), " ").dictionary_encode()
        dictionary, self.code, first = word_codes(coded.dictionary)
        self.words, self.n = Words(dictionary), len(texts)
        self.line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first, self.size = first[:-1], np.diff(first)

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code, line occurrence and document of every word in order."""
        size = self.size[self.line]
        occurrence = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(occurrence)) - np.repeat(np.cumsum(size) - size, size)
        return self.code[np.repeat(self.first[self.line], size) + inside], occurrence, self.doc[occurrence]

    def crossing(self) -> tuple[np.ndarray, np.ndarray]:
        return crossing(self.words, *self.whole())

    def inside(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and number of the distinct line of every run inside a distinct line."""
        return runs(self.words, self.code, np.repeat(np.arange(len(self.size)), self.size))


def _emit(total: np.ndarray):
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])


def _count_lines(batches):
    """Features of distinct lines, each times the line's occurrences: one total per bucket and task."""
    total = np.zeros(BUCKETS, np.int64)
    for b in gathered(batches, _GATHER):
        dictionary, code, first = word_codes(mapped(b.column(0), _WORDS))
        bucket, line = runs(Words(dictionary), code, np.repeat(np.arange(b.num_rows), np.diff(first)))
        np.add.at(total, bucket, b.column(1).to_numpy()[line])
    yield _emit(total)


def _count_crossing(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in gathered(batches, _GATHER):
        total += np.bincount(Cut(b.column(0)).crossing()[0], minlength=BUCKETS)
    yield _emit(total)


def distinct_lines(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``(line, n)``: every distinct line that holds a word, A-Z lower-cased, and how often it occurs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lines = docs.select(F.explode(F.split(F.translate(column(text).cast("string"), upper, upper.lower()), "\n", -1)).alias("line"))
    return lines.where(F.col("line").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def bucket_counts(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """Features of all texts per bucket; at most ``BUCKETS`` rows reach the driver."""
    inside = distinct_lines(docs, text=text).mapInArrow(_count_lines, "bucket int, n bigint")
    over = docs.select(column(text).cast("string").alias("text")).mapInArrow(_count_crossing, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in inside.unionByName(over).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the documents."""
    s_all, t_all = int(docs.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(s_all + BUCKETS)) / (float(s + 1) * float(t_all + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(docs.tolist(), target.tolist())], np.int64)


def _weigh(shared, batches):
    gain = shared.value
    for b in gathered(batches, _GATHER):
        cut = Cut(b.column(1))
        bucket, line = cut.inside()
        # features of a distinct line add up once, and go to every text that holds it
        of_line, size = np.zeros(len(cut.size), np.int64), cut.size
        np.add.at(of_line, line, gain[bucket])
        weight, n = np.zeros(cut.n, np.int64), np.zeros(cut.n, np.int64)
        np.add.at(weight, cut.doc, of_line[cut.line])
        np.add.at(n, cut.doc, size[cut.line])
        bucket, doc = cut.crossing()
        np.add.at(weight, doc, gain[bucket])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "weight"])


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw from the first 8 hex digits of sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, text: str = "text") -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; ``rank`` is null for those not drawn."""
    gain = gains(bucket_counts(docs, text=text), bucket_counts(target, text="text"))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket
    given = docs.select(column("doc_id").cast("bigint").alias("doc_id"), column(text).cast("string").alias("text"))
    weighed = given.mapInArrow(partial(_weigh, shared), "doc_id bigint, n_words bigint, weight bigint")
    features = F.greatest(3 * F.col("n_words") - 3, 2 * F.col("n_words") - 1, F.col("n_words"))
    n_features = F.when(F.col("n_words") == 0, 0).otherwise(features).cast("bigint")
    scored = weighed.select("doc_id", n_features.alias("n_features"), "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("long"))
    # documents that may be drawn come first; one exchange of narrow rows gives all of them their place
    placed = numbered(scored, F.desc("long"), F.desc("score"), F.asc_nulls_last("doc_id"), out="place")
    drawn = placed.agg(F.call_function("div", F.lit(percent) * F.count_if("long"), F.lit(100))).first()[0]
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).cast("bigint").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``: rows whose ``doc_id`` is drawn, with their columns."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["drawn_id"], "left_semi")
