"""Line dedup: lines equal to, or one edit away from, an earlier line are removed.

A line is a part of a text between newlines, in document order of ``doc_id``,
then line number. Only lines of at least ``min_chars`` code points take part. A
line goes if the same line occurs earlier, or if a line within one insertion,
deletion or substitution of a code point first occurs earlier; what stays is the
earliest. An exact first step keeps one occurrence of each distinct line; the
deletion neighbourhood then joins distinct lines:

* two lines one substitution apart give the same variant when that position is
  deleted from both, so they share (variant, position);
* a line one deletion apart from another *is* one of its variants.

So per key only the earliest line matters and no pairs inside a key are formed.
Lines that share neither half with a line of nearly equal length cannot be one
edit apart; they emit no variants. That test is exact and linear. Each found
(line, earlier line) is verified on the texts.

Defined cases: null texts stay null and have no lines; an empty text is one
empty line; rows with equal ``doc_id`` count as one document position (their
equal lines at one line number are the same occurrence and stay together); a null ``doc_id`` sorts
first; a text whose lines all go becomes empty; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import stored
from .base import column, fresh
from .shingles import mix

MIN_CHARS = 20
_P = np.uint64(0xD1342543DE82EF95)
_P_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BATCH_KEYS = 500_000


def _occurrences(docs: DataFrame, min_chars: int, text: str = "text") -> DataFrame:
    """``(at, line, h1, h2)``: where a line stands, its text and a 128-bit hash."""
    rows = docs.select(column("doc_id").alias("doc"), F.posexplode(F.split(column(text), "\n", -1)).alias("no", "line"))
    rows = rows.where(F.char_length("line") >= min_chars)
    return rows.select(F.struct("doc", "no").alias("at"), "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _half_keys() -> F.Column:
    """Hashes of both halves for every half length this line may share with a line one edit away."""
    n = F.char_length("line")
    halves = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")))
    first = F.transform(halves, lambda h: F.xxhash64(F.lit(0), h, F.substring(F.col("line"), F.lit(1), h)))
    last = F.transform(halves, lambda h: F.xxhash64(F.lit(1), h, F.substring(F.col("line"), n - h + 1, h)))
    return F.concat(first, last)


def _variants(batches):
    """All one-deletion variants of each line as (variant, position), and the line itself at -1."""
    for b in batches:
        starts, keys, places = [], [], []
        size = 0

        def flush():
            counts = [len(k) for k in keys]
            at = pa.array(np.repeat(np.array(starts, np.int64), counts))
            out = [c.take(at) for c in b.columns[:-1]]
            return pa.RecordBatch.from_arrays([*out, pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places))], [*b.schema.names[:-1], "variant", "place"])

        for i, line in enumerate(b.column(b.num_columns - 1).to_pylist()):
            codes = mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64))
            n = len(codes)
            power = np.full(n, _P, np.uint64)
            power[:1] = 1
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * np.multiply.accumulate(power), dtype=np.uint64)])
            shorter = total[:-1] + (total[-1] - total[1:]) * _P_INVERSE
            starts.append(i)
            keys.append(np.concatenate([mix(shorter + np.uint64(n - 1)), mix(total[-1:] + np.uint64(n))]))
            places.append(np.concatenate([np.arange(n, dtype=np.int32), np.array([-1], np.int32)]))
            size += n + 1
            if size >= _BATCH_KEYS:
                yield flush()
                starts, keys, places, size = [], [], [], 0
        if starts:
            yield flush()


def _one_edit(a: str, b: str) -> bool:
    """Whether the texts differ by at most one insertion, deletion or substitution."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[n + (len(a) == len(b)) :] == b[n + 1 :]


def _verified(batches):
    for b in batches:
        keep = [_one_edit(x, y) for x, y in zip(b.column("line").to_pylist(), b.column("other").to_pylist())]
        yield b.drop_columns(["line", "other"]).filter(pa.array(keep, pa.bool_()))


def near_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``firsts``: (h1, h2, at, n) per distinct line; ``near``: (at, kept) of first
    occurrences that have an earlier line one edit away, with the earliest such line's place."""
    lines = _occurrences(docs, min_chars, text)
    place = lines.schema["at"].dataType.simpleString()
    seen = lines.select("at", "h1", "h2", _half_keys().alias("halves"))
    firsts = stored(seen.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), F.min("halves").alias("halves")), "lines")
    shared = firsts.select("at", F.explode("halves").alias("half"))
    partner = shared.groupBy("half").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high").select("half")
    asked = shared.join(partner, "half", "left_semi").select("at").distinct()
    texts = stored(lines.select("at", "line").join(asked, "at", "left_semi").groupBy("at").agg(F.min("line").alias("line")), "lines")
    keyed = texts.mapInArrow(_variants, f"at {place}, variant bigint, place int")
    # all rows of a key are at most one alphabet times one line long; only minima are taken
    by_line = Window.partitionBy("variant")
    same_place = Window.partitionBy("variant", "place")
    at = F.col("at")
    found = keyed.select(
        "at", "place",
        F.min(at).over(same_place).alias("swapped"),
        F.min(F.when(F.col("place") == -1, at)).over(by_line).alias("itself"),
        F.min(F.when(F.col("place") >= 0, at)).over(by_line).alias("longer"),
    )
    other = F.when(F.col("place") >= 0, F.array("swapped", "itself")).otherwise(F.array("longer"))
    pairs = found.select("at", F.explode(other).alias("kept")).where("kept < at").distinct()
    line_of = lambda name, at: texts.select(F.col("line").alias(name), F.col("at").alias(at))
    checked = pairs.join(line_of("line", "at"), "at").join(line_of("other", "kept"), "kept").select("at", "kept", "line", "other")
    near = checked.mapInArrow(_verified, f"at {place}, kept {place}").groupBy("at").agg(F.min("kept").alias("kept"))
    return firsts.drop("halves"), near


def removed_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``(doc_id, removed)``: the 0-based numbers of the lines that go, per document that loses some."""
    firsts, near = near_lines(docs, min_chars=min_chars, text=text)
    decided = firsts.join(near, "at", "left").where("n > 1 OR kept IS NOT NULL")
    decided = decided.select("h1", "h2", F.col("at").alias("first"), F.col("kept").isNotNull().alias("all_go"))
    found = _occurrences(docs, min_chars, text).drop("line").join(decided, ["h1", "h2"])
    gone = found.where("all_go OR at > first").select(F.col("at.doc").alias("doc_id"), F.col("at.no").alias("no"))
    return gone.groupBy("doc_id").agg(F.collect_set("no").alias("removed"))


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; all rows and columns stay."""
    gone = removed_lines(docs, min_chars=min_chars, text=text)
    name, key = fresh(docs, "removed_lines"), fresh(docs, "removed_from")
    gone = gone.select(F.col("doc_id").alias(key), F.col("removed").alias(name))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone[key]), "left").drop(key)
    at = docs.columns.index(text)

    def cut(batches):
        for b in batches:
            out = []
            for t, numbers in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if numbers and t is not None:
                    drop = set(numbers)
                    t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                out.append(t)
            columns = b.columns[:-1]
            columns[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(b.schema)[:-1]))

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    return joined.mapInArrow(cut, schema)
