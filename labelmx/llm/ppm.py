"""LM scoring: prediction by partial matching over byte contexts, trained on the corpus.

Training counts every run of up to ``ORDER`` + 1 bytes (A-Z lower-cased) of the
training texts; a run of k bytes is a context of k - 1 bytes and the byte after
it. They form a trie of contexts. A byte is scored by its longest known context:
if the context has seen it, (2 count - 1) / (2 total); else the context's escape
probability, distinct / (2 total), and on to the next shorter context, where the bytes that
the longer one has seen are excluded from all counts. Below the empty context
all bytes not excluded are equally likely. Texts begin with marks that no text
holds and are followed by an end mark, which is scored too.

No run is left out, however rare, and no task holds the whole trie. A run of ORDER + 1
bytes decides its score, so each distinct run of the scored texts is scored once:
runs are dealt by the last ``LOW`` bytes of their contexts, which brings together
all that followed a context of ``LOW`` bytes or more, and what followed shorter
ones is at most 256**LOW runs, known to all tasks. Scores of runs that make up at
least 2**-SHARE_BITS of all are looked up in a table of bounded size; the others meet
the places where they occur in a join, which packs the rows of a part into arrays;
the sums of a block of rows come back as arrays too, one for each part it met.

Word tokens (runs of non-space bytes, and one end per text) are scored by an
add-one unigram model for comparison. Tokens above such a share, 2**-TOKEN_BITS of all, are
looked up in a table of bounded size; the rest meet their counts in a join.

Defined cases: null, empty and blank texts have the end token and end mark only;
without training documents all bytes are equally likely and counts are 0; rows
with equal ids share a fold and are rows of their own, scored alike if their texts are
equal; null ids have the fold of an empty text; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from .base import chunks, column, fold, task_count
from .shingles import _STEP, _words, buffers, mix

ORDER = 6
LOW = 3
SHARE_BITS = 22
TOKEN_BITS = 21
BEGIN, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
END_TOKEN = -1
_CHUNK_BYTES = 500_000
_COUNT_BYTES = 4_000_000
_SPILL_ROWS = 1_500_000
PART_RUNS = 1 << 18  # distinct runs of a part, on average: their scores are one task's table


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _marked(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts with ``ORDER`` begin marks before and one end mark behind each, and where each first byte stands."""
    n = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(n + ORDER + 1)])
    out = np.full(int(starts[-1]), BEGIN, np.uint8)
    out[starts[1:] - 1] = END
    shift = np.repeat(starts[:-1] + ORDER - offsets[:-1], n)
    out[np.arange(offsets[0], offsets[-1]) + shift] = _lower(data[offsets[0] : offsets[-1]])
    return out, starts[:-1] + ORDER


def _runs(marked: np.ndarray) -> np.ndarray:
    """The ORDER + 1 bytes that end at each place from ORDER on."""
    n = len(marked) - ORDER
    out = marked[:n].astype(np.uint64)
    for k in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= marked[k : k + n]
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _token_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, first = _words(offsets - offsets[0], data[offsets[0] : offsets[-1]])
    # the end token's key is kept free
    return np.where(hashes == np.uint64(END_TOKEN & (1 << 64) - 1), np.uint64(0), hashes), first


def _run_counts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of some texts and how often each occurs."""
    marked, first = _marked(offsets, data)
    # runs that end in a begin mark, or hold a former text's end, are no runs of a text
    inside = np.ones(len(marked) - ORDER, bool)
    for k in range(ORDER):
        inside[first[1:] - 1 - k - ORDER] = False
    runs = _runs(marked)[inside]
    runs.sort()
    edges = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    return runs[edges], np.diff(np.append(edges, len(runs)))


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Counts of byte runs (kind 0) and word tokens (kind 1) of a partition, merged in memory up to a bound.

    Texts that are not trained on add their runs with a count of 0.
    """
    kept: dict[int, list] = {0: [], 1: []}

    def out(kind):
        keys, counts = _merge(kept[kind])
        kept[kind] = []
        for s in range(0, len(keys), 100_000):
            k, c = keys[s : s + 100_000], counts[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "n"])

    for b in batches:
        for trained in (True, False):
            offsets, data = buffers(b.column(0).filter(pc.equal(b.column(1), trained)))
            for s, e in chunks(np.diff(offsets).tolist(), _COUNT_BYTES):
                at = offsets[s : e + 1]
                keys, counts = _run_counts(at, data)
                kept[0].append((keys, counts * trained))
                if trained:
                    tokens, _ = _token_hashes(at, data)
                    kept[1].append(np.unique(tokens, return_counts=True))
                    kept[1].append((np.array([END_TOKEN], np.int64).view(np.uint64), np.array([e - s])))
                for kind in kept:
                    if sum(len(k) for k, _ in kept[kind]) > _SPILL_ROWS:
                        kept[kind] = [_merge(kept[kind])]
                        if len(kept[kind][0][0]) > _SPILL_ROWS // 2:
                            yield from out(kind)
    for kind in kept:
        if kept[kind]:
            yield from out(kind)


class Table(NamedTuple):
    """An open-addressing hash table of 64-bit keys to row numbers; -1 where a key is absent."""

    keys: np.ndarray
    rows: np.ndarray
    shift: int

    @staticmethod
    def build(keys: np.ndarray) -> Table:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        slots, rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at = (keys * _STEP >> np.uint64(64 - bits)).astype(np.int64)
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = rows[at] < 0
            # of several keys that want one free slot the last written stays
            rows[at[free]] = left[free]
            won = rows[at] == left
            slots[at[won]] = keys[left[won]]
            at, left = (at[~won] + 1) & ((1 << bits) - 1), left[~won]
        return Table(slots, rows, 64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.keys) - 1
        at = (keys * _STEP >> np.uint64(self.shift)).astype(np.int64)
        found = self.rows.take(at)
        open_ = np.flatnonzero((found >= 0) & (self.keys.take(at) != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found[open_] = self.rows.take(at[open_])
            open_ = open_[(found[open_] >= 0) & (self.keys.take(at[open_]) != keys[open_])]
        return found


class Trie:
    """Runs by length, with what scoring needs per context."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]]):
        """``runs[k]``: sorted keys and counts of the runs of k + 1 bytes; all that followed a context, or nothing of it."""
        self.orders = len(runs)
        self.run_tables, self.count, self.context_tables, self.state, self.below = [], [], [], [], []
        for k, (keys, counts) in enumerate(runs):
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            total = np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0)
            distinct = np.diff(np.append(first, len(keys))).astype(np.float64)
            # the next shorter context without the bytes this one has seen
            if k == 0 or not len(keys):
                below = np.zeros((len(contexts), 2))
            else:
                shorter, n = runs[k - 1]
                at = np.searchsorted(shorter, keys & np.uint64((1 << 8 * k) - 1))
                seen = np.add.reduceat(n[at].astype(np.float64), first)
                up = self.context_tables[k - 1].find(contexts & np.uint64((1 << 8 * (k - 1)) - 1))
                below = self.state[k - 1][up] - np.stack([seen, distinct], axis=1)
            self.run_tables.append(Table.build(keys))
            self.context_tables.append(Table.build(contexts))
            self.count.append(counts.astype(np.float64))
            self.state.append(np.stack([total, distinct], axis=1))
            self.below.append(below.clip(min=0))
        top_keys = runs[-1][0] if runs else np.zeros(0, np.uint64)
        # scores of bytes that the longest context has seen: nearly all, so one lookup
        c = self.context_tables[-1].find(top_keys >> np.uint64(8)) if len(top_keys) else np.zeros(0, int)
        s = self.state[-1][c] if len(top_keys) else np.zeros((0, 2))
        self.top = np.log10((2 * self.count[-1] - 1) / (2 * s[:, 0])) if len(top_keys) else np.zeros(0)

    def scores(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run of ORDER + 1 bytes."""
        out = np.zeros(len(runs))
        if not self.orders or not len(self.count[0]):
            out[:] = -np.log10(256.0)
            return out
        row = self.run_tables[-1].find(runs)
        hit = row >= 0
        out[hit] = self.top[row[hit]]
        left = np.flatnonzero(~hit)
        state = np.full((len(left), 2), np.nan)  # what is left of the context after exclusions; nan: nothing excluded
        excluded = np.zeros(len(left))
        for k in range(self.orders - 1, -1, -1):
            if not len(left):
                break
            key = runs[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            if not len(self.count[k]):
                continue  # no context of that length is known
            context = self.context_tables[k].find(key >> np.uint64(8))
            row = self.run_tables[k].find(key)
            known = context >= 0
            now = np.where(np.isnan(state), self.state[k][np.maximum(context, 0)], state)
            size = 2 * now[:, 0]
            usable = known & (size > 0)
            seen = usable & (row >= 0)
            out[left[seen]] += np.log10((2 * self.count[k][row[seen]] - 1) / size[seen])
            gone = usable & ~seen
            out[left[gone]] += np.log10(now[gone, 1] / size[gone])
            # a known context passes its exclusions on, whether or not it had anything left
            nxt = state
            nxt[known] = self.below[k][context[known]]
            excluded[known] = self.state[k][context[known], 1]
            stay = ~seen
            left, state, excluded = left[stay], nxt[stay], excluded[stay]
        out[left] -= np.log10(np.maximum(256.0 - excluded, 1.0))
        return out


class Model(NamedTuple):
    low: list[tuple[np.ndarray, np.ndarray]]  # all runs of up to LOW bytes and their counts
    total: int  # trained places
    tokens: tuple[np.ndarray, np.ndarray]  # frequent tokens and their counts
    n_tokens: int
    n_kinds: int
    end_count: int


def train(docs: DataFrame, trained: Column, *, text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows of ``docs`` where ``trained``, ``(key, n)`` of every run of all rows, and of every word token of the model."""
    counted = docs.select(column(text).cast("string"), F.coalesce(trained, F.lit(False))).mapInArrow(_count, "kind tinyint, key bigint, n bigint")
    counted = stored(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "runs")
    runs, tokens = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    known = runs.where("n > 0")
    total = known.agg(F.sum("n")).first()[0] or 0
    low = []
    for k in range(LOW):
        tail = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        low.append(_sorted(known.groupBy(tail.alias("key")).agg(F.sum("n").alias("n"))))  # at most 256**LOW rows
    t = tokens.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.max(F.when(F.col("key") == END_TOKEN, F.col("n"))).alias("ends")).first()
    often = _sorted(tokens.where(F.col("n") >= (t.n or 0) / (1 << TOKEN_BITS)).where(F.col("key") != END_TOKEN))  # at most 2**TOKEN_BITS rows
    return Model(low, total, often, t.n or 0, t.kinds or 0, t.ends or 0), runs, tokens


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.select("key", "n").toArrow()
    key, n = got.column(0).to_numpy().astype(np.int64).view(np.uint64), got.column(1).to_numpy().astype(np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def _parcels(keys: np.ndarray, values: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Keys and their values by part."""
    part = (mix(keys) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    for p, s, e in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        yield p, keys[order[s:e]].tobytes(), values[order[s:e]].tobytes()


_PARCEL = "part int, kind tinyint, block bigint, keys binary, worth binary"


def _parcel_batches(parcels, kind: int, block: int = 0, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def out():
        part, keys, worth = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int8()), pa.array([block] * len(part), pa.int64()), pa.array(keys, pa.binary()), pa.array(worth, pa.binary())], ["part", "kind", "block", "keys", "worth"])

    for p in parcels:
        held.append(p)
        size += len(p[1]) + len(p[2])
        if size > most:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _rate(shared, parts, least, batches) -> Iterator[pa.RecordBatch]:
    """Scores of the runs of a partition, which holds all that followed its contexts of LOW bytes or more: frequent ones (kind 2), others (kind 0)."""
    got = [(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not got:
        return
    keys, n = (np.concatenate(x) for x in zip(*got))
    known = n > 0
    longer = []
    for k in range(LOW, ORDER + 1):
        longer.append(_merge([(keys[known] & np.uint64((1 << 8 * (k + 1)) - 1), n[known])]))
    score = Trie([*shared.value, *longer]).scores(keys)
    often = known & (n >= least)
    for s in range(0, int(often.sum()), 100_000):
        yield from _parcel_batches([(0, keys[often][s : s + 100_000].tobytes(), score[often][s : s + 100_000].tobytes())], 2)
    yield from _parcel_batches(_parcels(keys[~often], score[~often], parts), 0)


def _steps(rows: np.ndarray) -> bytes:
    """Row numbers, compressed: those of a part ascend, so their steps are small."""
    return zlib.compress(np.diff(rows, prepend=0).tobytes(), 1)


def _rows_of(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(steps), np.int64))


def _pack(parts, batches) -> Iterator[pa.RecordBatch]:
    """The rare runs of rows by part (kind 1), compressed: they are most of what is exchanged. The rows of a batch are a block."""
    for b in batches:
        lists = b.column(1).to_pylist()
        sizes = [len(x) // 8 for x in lists]
        keys = np.frombuffer(b"".join(lists), np.uint64)
        rows = np.repeat(b.column(0).to_numpy(zero_copy_only=False), sizes)
        small = ((p, zlib.compress(k, 1), _steps(np.frombuffer(r, np.int64))) for p, k, r in _parcels(keys, rows, parts))
        yield from _parcel_batches(small, 1, int(rows.min(initial=1 << 62)))


def _meet(batches) -> Iterator[pa.RecordBatch]:
    """Sums of scores by row, the rows of a parcel in one array; the scores of a part come before its rows."""
    now, keys, worth, table = None, [], [], None
    for b in batches:
        blocks, rows, sums = [], [], []
        for part, kind, block, k, w in zip(*[c.to_pylist() for c in b.columns]):
            if part != now:
                now, keys, worth, table = part, [], [], None
            if kind == 0:
                keys.append(np.frombuffer(k, np.uint64))
                worth.append(np.frombuffer(w, np.float64))
                continue
            if table is None:
                table, scores = Table.build(np.concatenate(keys)), np.concatenate(worth)
            row, at = np.unique(_rows_of(w), return_inverse=True)
            found = table.find(np.frombuffer(zlib.decompress(k), np.uint64))
            if (found < 0).any():
                raise ValueError("a run of the texts has no score")
            blocks.append(block)
            rows.append(_steps(row))
            sums.append(np.bincount(at, scores[found], len(row)).tobytes())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(rows, pa.binary()), pa.array(sums, pa.binary())], ["block", "rows", "sums"])


def _total(met: pa.Table) -> pa.Table:
    """The sums of a block's rows over all parts."""
    rows = np.concatenate([_rows_of(x) for x in met.column("rows").to_pylist()])
    sums = np.frombuffer(b"".join(met.column("sums").to_pylist()), np.float64)
    row, at = np.unique(rows, return_inverse=True)
    return pa.table({"row": pa.array(row), "rest": pa.array(np.bincount(at, sums, len(row)))})


def _score(shared, batches) -> Iterator[pa.RecordBatch]:
    (run_keys, run_scores), (token_keys, token_counts), n_tokens, n_kinds, ends = shared.value
    frequent, often = Table.build(run_keys), Table.build(token_keys)
    base = np.log10((token_counts + 1.0) / (n_tokens + n_kinds + 1.0))
    unit = np.log10((ends + 1.0) / (n_tokens + n_kinds + 1.0))
    for b in batches:
        offsets, data = buffers(b.column(b.num_columns - 1))
        score, known, sizes, part, rare, counts, runs = [], [], [], [], [], [], []
        for s, e in chunks(np.diff(offsets).tolist(), _CHUNK_BYTES):
            at = offsets[s : e + 1]
            marked, first = _marked(at, data)
            keys = _runs(marked)
            row = frequent.find(keys)
            values = run_scores[row] if len(run_scores) else np.zeros(len(keys))
            values[row < 0] = 0.0
            # a text's own runs end from its first byte to its end mark
            total = np.concatenate([[0.0], np.cumsum(values)])
            lo = first - ORDER
            hi = lo + np.diff(at) + 1
            score.append(total[hi] - total[lo])
            open_ = np.flatnonzero(row < 0)
            edges = np.searchsorted(open_, np.stack([lo, hi]))
            runs += [keys[open_[i:j]].tobytes() for i, j in zip(*edges.tolist())]
            hashes, place = _token_hashes(at, data)
            row = often.find(hashes)
            hit = row >= 0
            worth = np.concatenate([[0.0], np.cumsum(np.where(hit, base[np.maximum(row, 0)] if len(base) else 0.0, 0.0))])
            hits = np.concatenate([[0], np.cumsum(hit)])
            sizes.append(np.diff(place) + 1)
            part.append(worth[place[1:]] - worth[place[:-1]] + unit)
            known.append(hits[place[1:]] - hits[place[:-1]] + (ends > 0))
            rare.append(hashes[~hit])
            counts.append(sizes[-1] - 1 - (hits[place[1:]] - hits[place[:-1]]))
        ends_at = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32) if counts else np.zeros(1, np.int32)
        join = lambda xs, kind: pa.array(np.concatenate(xs).astype(kind)) if xs else pa.array([], pa.from_numpy_dtype(kind))
        lists = pa.ListArray.from_arrays(pa.array(ends_at), join(rare, np.uint64).cast(pa.uint64()).view(pa.int64()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], join(sizes, np.int64), join(known, np.int64), join(part, np.float64), join(score, np.float64), lists, pa.array(runs, pa.binary())], [*b.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "rare", "runs"])


def score(docs: DataFrame, model: Model, runs: DataFrame, tokens: DataFrame, *, text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row; ``runs`` has all runs of the rows."""
    spark = docs.sparkSession
    tasks = task_count(docs)
    # parts grow with the runs that one table holds, not with the tasks: a row meets each part at most once
    low, parts = spark.sparkContext.broadcast(model.low), max(1, -(-runs.count() // PART_RUNS))
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))
    rated = runs.repartition(tasks, context).mapInArrow(partial(_rate, low, parts, model.total / (1 << SHARE_BITS)), _PARCEL)
    rated = stored(rated, "rated")
    got = rated.where("kind = 2").select("keys", "worth").toArrow()  # at most 2**SHARE_BITS runs
    keys, worth = (b"".join(got.column(i).to_pylist()) for i in (0, 1))
    frequent = np.frombuffer(keys, np.uint64), np.frombuffer(worth, np.float64)
    shared = spark.sparkContext.broadcast((frequent, *model[2:]))
    rows = docs.select(column("doc_id").alias("doc_id"), F.monotonically_increasing_id().alias("row"), column(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(partial(_score, shared), f"doc_id {kind}, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, runs binary")
    done = stored(done, "scores")
    # runs too rare for the table meet their scores here
    packed = done.where(F.length("runs") > 0).select("row", "runs").mapInArrow(partial(_pack, parts), _PARCEL)
    met = rated.where("kind = 0").union(packed).repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(_meet, "block bigint, rows binary, sums binary")
    met = met.groupBy("block").applyInArrow(_total, "row bigint, rest double")
    # tokens too rare for the table meet their counts here; no key has more than a 2**-TOKEN_BITS share of them
    rare = done.select("row", F.explode("rare").alias("key")).join(tokens, "key", "left")
    scale = float(model.n_tokens + model.n_kinds + 1)
    sums = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(scale))).alias("more"), F.count("n").alias("found"))
    return done.drop("rare", "runs").join(sums, "row", "left").join(met, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def train_and_score(docs: DataFrame, *, held_out: int = 2, folds: int = 7, text: str = "text") -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) modulo ``folds`` is not ``held_out``."""
    model, runs, tokens = train(docs, fold(column("doc_id"), folds) != held_out, text=text)
    done = score(docs, model, runs, tokens, text=text)
    return done.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
