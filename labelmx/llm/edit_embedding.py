"""Document fingerprints by randomised edit embedding.

A walk reads a text's characters: at step j it writes the current character and,
by a random bit shared by all documents for (j, character), moves on or stays.
Texts a small edit distance apart soon walk in step again, so edit distance
becomes Hamming distance between the written sequences. A walk takes 3n + 16 steps
over n code points: it passes all of them but with a chance below 1 in 10,000.

The fingerprint keeps the characters written at ``SAMPLES`` steps: those with the
smallest shared hashes among the first 3n + 16, so texts of nearly equal length
sample nearly the same steps. It is n in hex, then a byte per sample. The likeness of two
fingerprints is the share of all sampled steps at which either still read its text
that both sampled with equal characters. Bands of samples, drawn as by random bits, are the join keys of
:func:`near_copies`, which verifies candidates by their likeness.

Defined cases: a null text counts as empty; the empty text's fingerprint is
``0-``, alike 1.0 to itself and 0.0 to others; equal texts have equal
fingerprints; rows with equal ids are ordered by a hash of their texts; null ids
come after all others; the only row of a table is its own next row; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from .base import column, task_count
from .components import components
from .shingles import mix

SAMPLES = 128
BANDS, BAND_SAMPLES, BAND_CHOICE = 16, 6, 24
_STEPS_PER_TABLE = 64
_BATCH_CHARS = 4_000_000


def _steps(n):
    """Steps of a walk over n code points."""
    return np.where(np.asarray(n) > 0, 3 * np.asarray(n) + 16, 0)


def _step_hashes(steps: int) -> np.ndarray:
    return mix(np.arange(steps, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


_KEPT: dict[int, np.ndarray] = {}


def _sampled(steps: int) -> np.ndarray:
    """The sampled steps of a walk of that length, smallest hash first."""
    at = _KEPT.get(steps)
    if at is None:
        h = _step_hashes(steps)
        at = np.argpartition(h, SAMPLES)[:SAMPLES] if steps > SAMPLES else np.arange(steps)
        at = at[np.argsort(h[at])]
        if len(_KEPT) >= 4096:
            _KEPT.clear()
        _KEPT[steps] = at
    return at


def _moves(table: int) -> np.ndarray:
    """For 64 steps, per character whether to move on; the end mark (0) stays."""
    words = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(table + 1))
    bits = (words[None, :] >> np.arange(_STEPS_PER_TABLE, dtype=np.uint64)[:, None]) & np.uint64(1)
    bits[:, 0] = 0
    return bits.astype(np.int64)


def _symbols(text: str) -> np.ndarray:
    """One byte per code point; 0 is kept for the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = (mix(codes.astype(np.uint64)) & np.uint64(127)).astype(np.uint32) + 128 if len(codes) and codes.max() > 127 else codes
    return np.where(codes < 128, np.maximum(codes, 1), high).astype(np.uint8)


def walk(texts: list[str]) -> list[bytes]:
    """The sampled characters of each text; all walks go in step, longest first."""
    symbols = [_symbols(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(symbols[i]))
    lengths = np.array([len(symbols[i]) for i in order], np.int64)
    data = np.concatenate([np.append(symbols[i], np.uint8(0)) for i in order]) if order else np.zeros(0, np.uint8)
    place = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if order else np.zeros(0, np.int64)
    samples = [_sampled(int(n)) for n in _steps(lengths)]
    sizes = [len(s) for s in samples]
    steps = np.concatenate(samples) if samples else np.zeros(0, np.int64)
    lanes = np.repeat(np.arange(len(order)), sizes)
    by_step = np.argsort(steps, kind="stable")
    wanted, first = np.unique(steps[by_step], return_index=True)
    ends = np.append(first[1:], len(steps))
    out = np.zeros(len(steps), np.uint8)
    # lanes still walking at step j are those with more than j steps, a prefix of the order
    ahead = _steps(lengths)
    walking = np.searchsorted(-ahead, -np.arange(0, int(ahead[0]) if len(ahead) else 0), side="left")
    done = 0
    for j in range(len(walking)):
        if j % _STEPS_PER_TABLE == 0:
            moves = _moves(j // _STEPS_PER_TABLE)
        if done < len(wanted) and wanted[done] == j:
            at = by_step[first[done] : ends[done]]
            out[at] = data[place[lanes[at]]]
            done += 1
        active = place[: walking[j]]
        active += moves[j % _STEPS_PER_TABLE].take(data.take(active))
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    found: list[bytes] = [b""] * len(texts)
    for k, i in enumerate(order):
        found[i] = out[edges[k] : edges[k + 1]].tobytes()
    return found


def fingerprints(texts: list[str | None]) -> list[str]:
    """Fingerprint of each text; walks are grouped into batches of bounded size."""
    plain = [t or "" for t in texts]
    out: list[str] = []
    start = total = 0
    for i, t in enumerate(plain):
        total += len(t)
        if total >= _BATCH_CHARS or i + 1 == len(plain):
            part = plain[start : i + 1]
            out += [f"{len(t):x}-{w.hex()}" for t, w in zip(part, walk(part))]
            start, total = i + 1, 0
    return out


def likeness(a: str, b: str) -> float:
    """Share of the steps at which either wrote a character that both sampled with equal characters."""
    if a == b:
        return 1.0
    (n, x), (m, y) = ((int(p[0], 16), np.frombuffer(bytes.fromhex(p[1]), np.uint8)) for p in (a.split("-"), b.split("-")))
    if not n or not m:
        return 0.0
    s, t = _sampled(int(_steps(n))), _sampled(int(_steps(m)))
    _, i, j = np.intersect1d(s, t, assume_unique=True, return_indices=True)
    both = (x[i] > 0) & (y[j] > 0)
    either = int((x > 0).sum()) + int((y > 0).sum()) - int(both.sum())
    return float((both & (x[i] == y[j])).sum()) / either if either else 0.0


def fingerprint(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint)`` per row."""
    rows = docs.select(column("doc_id").alias("doc_id"), column(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(fingerprints(texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _bands(print_: str) -> list[int]:
    """Keys of a fingerprint: hashes of the characters at drawn steps, with the length's magnitude.

    All texts of a magnitude draw from the same ``BAND_CHOICE`` steps, those of smallest
    hash among the steps of the shortest: a longer text has sampled these too, as it
    keeps smallest hashes. A band with a step that a text did not sample gives no key.
    """
    n = int(print_.split("-")[0], 16)
    x = np.frombuffer(bytes.fromhex(print_.split("-")[1]), np.uint8)
    if not n:
        return []
    base = {int(s): i for i, s in enumerate(_sampled(int(_steps(n))))}
    out = []
    for scale in (n.bit_length() - 1, n.bit_length()):  # texts near a power of two meet in one of both
        low = 1 << max(0, scale - 1)
        drawn = _sampled(int(_steps(low)))[:BAND_CHOICE]
        for band in range(BANDS):
            by_band = np.argsort(mix(np.arange(len(drawn), dtype=np.uint64) + np.uint64(1000 * (band + 1))))
            got = [int(x[base[p]]) if (p := int(drawn[k])) in base else -1 for k in by_band[:BAND_SAMPLES]]
            if -1 in got:
                continue
            key = hashlib.blake2b(repr((scale, band, got)).encode(), digest_size=8).digest()
            out.append(int.from_bytes(key, "big", signed=True))
    return out


def near_copies(docs: DataFrame, *, least: float = 0.75, text: str = "text") -> DataFrame:
    """``(doc_id, n_links, class_id)``: candidates share a band, links have at least that likeness.

    Every two different texts that share a band are verified, so ``n_links`` counts
    all links of a text to others and a band of m texts gives m (m - 1) / 2 pairs; equal
    texts are one. Classes are the components of the links. Documents without text are alone. Rows without an id are left out.
    """
    prints = stored(fingerprint(docs, text=text).where("doc_id IS NOT NULL"), "prints")
    one = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))  # equal texts

    def bands(batches):
        for b in batches:
            keys = [_bands(x) for x in b.column(0).to_pylist()]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array([k for ks in keys for k in ks], pa.int64()), b.column(1).take(pa.array(at))], ["band", "rep"])

    kind = prints.schema["doc_id"].dataType.simpleString()
    members = stored(one.mapInArrow(bands, f"band bigint, rep {kind}").distinct(), "bands")
    pairs = members.join(members.select("band", F.col("rep").alias("other")), "band").where("rep < other").select("rep", "other").distinct()
    side = lambda key, out: one.select(F.col("rep").alias(key), F.col("fingerprint").alias(out))

    def alike(batches):
        for b in batches:
            keep = [likeness(x, y) >= least for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("rep", "x"), "rep").join(side("other", "y"), "other").select("rep", "other", "x", "y")
    links = stored(both.mapInArrow(alike, f"rep {kind}, other {kind}"), "links")
    parts = components(links, "rep", "other").withColumnRenamed("node", "rep")
    counts = links.select(F.explode(F.array("rep", "other")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    known = prints.join(one, "fingerprint").join(parts, "rep", "left").join(counts, "rep", "left")
    return known.select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", F.when(F.col("n_chars") > 0, F.col("rep")).otherwise(F.col("doc_id"))).alias("class_id"))


def _with_next(docs: DataFrame, text: str) -> DataFrame:
    """Rows sorted by descending id within buckets of ids, each bucket followed by a copy of the next bucket's first row.

    Bounds come from the ids alone, so the texts are exchanged once and no bucket
    grows beyond a share of the rows.
    """
    rows = docs.select(column("doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    n = task_count(docs)
    ids = docs.select(column("doc_id").cast("bigint").alias("doc_id"))
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(found or []))
    listed = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # null ids come last: below every bucket
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(listed, lambda b: b < F.col("doc_id"))))
    keyed = rows.select(bucket.alias("bucket"), "doc_id", "text")
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"))
    heads = keyed.select("bucket", order.alias("o")).groupBy("bucket").agg(F.max("o").alias("o")).orderBy("bucket").collect()  # one row per bucket
    # the first row of a bucket also follows the bucket above; the topmost row follows the lowest bucket
    above = {heads[i].bucket: heads[(i + 1) % len(heads)].bucket for i in range(len(heads))}
    head = [F.when((F.col("bucket") == h.bucket) & (order == F.struct(F.lit(h.o[0]), F.lit(h.o[1]))), F.lit(above[h.bucket])) for h in heads]
    goes_to = F.coalesce(*head, F.lit(None).cast("int")) if head else F.lit(None).cast("int")
    copies = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("copy")), F.when(goes_to.isNotNull(), F.struct(goes_to.alias("bucket"), F.lit(True).alias("copy")))))
    spread = keyed.select(F.explode(copies).alias("to"), "doc_id", "text").select("to.bucket", "to.copy", "doc_id", "text")
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())


def edited(text: str, donor: str) -> str:
    """The last half (rounded down) replaced by as many first characters of the donor, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + donor[:half]


def _compare(batches) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []  # rows whose next row has not come yet: one at most

    def results(rows, nexts):
        texts = [r[3] for r in rows]
        changed = [edited(t, n[3]) for t, n in zip(texts, nexts)]
        prints = fingerprints(texts + changed + [n[3] for n in nexts[-1:]])
        own, other = prints[: len(rows)], prints[len(rows) : 2 * len(rows)]
        following = []
        for i, (r, n) in enumerate(zip(rows, nexts)):
            following.append(own[i + 1] if i + 1 < len(rows) and nexts[i] is rows[i + 1] else (prints[-1] if n is nexts[-1] else fingerprints([n[3]])[0]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[2] for r in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
                pa.array(own, pa.string()), pa.array(other, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, following)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for b in batches:
        incoming = list(zip(*[c.to_pylist() for c in b.columns]))
        pending, rows, nexts = held, [], []
        for r in incoming:
            if pending and pending[0][0] == r[0]:
                rows.append(pending[0])
                nexts.append(r)
                pending = []
            if not r[1]:
                pending = [r]
        held = pending
        if rows:
            yield results(rows, nexts)


def compare_with_next(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near both and the next text are."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs, text).mapInArrow(_compare, schema)
