"""Token counts as delta-maintained rollups.

Counts of documents under named tokenizer versions become signed changes: an
insert adds, a delete subtracts, a revision does both. Changes are netted per
(source, lang, version) before anything is stored, and totals are the sum of all
committed batches, so totals are additive and never recounted.

A batch is committed under its own name to a folder of the rollup; committing a
name again changes nothing, whether the first attempt succeeded (it stays) or
was cut off (it is replaced): a batch counts only once its success mark stands.

Defined cases: null and empty texts count 0 tokens but count as documents; null
sources or languages are groups of their own; repeated rows are documents of
their own; an empty batch commits and changes nothing; groups whose documents
and tokens both come to 0 are left out of the totals; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column
from .bpe import Encoder, Vocabulary

GROUP = ("source", "lang", "version")
_KEEP_ENTRIES = 300_000


class _Counter:
    """Token counts of texts, fragment by fragment, with a bounded memory of short ones."""

    def __init__(self, vocabulary: tuple):
        self.encoder, self.kept = Encoder(*vocabulary), {}

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        kept, fragments = self.kept, self.encoder.split(text)
        new = set(fragments).difference(kept)
        for f in new:
            kept[f] = len(self.encoder._ids(f)) // 4
        n = sum(map(kept.__getitem__, fragments))
        for f in new:
            if len(f) > 64:
                del kept[f]
        if len(kept) > _KEEP_ENTRIES:
            kept.clear()
        return n


def _count(shared, batches):
    counters = {v: _Counter(x) if x else (lambda t: len(t.encode()) if t else 0) for v, x in shared.value.items()}
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        for version, count in counters.items():
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([version] * len(texts), pa.string()), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "source", "lang", "version", "n_tokens"])


def count_tokens(docs: DataFrame, versions: Mapping[str, Vocabulary | None], *, text: str = "text") -> DataFrame:
    """``(doc_id, source, lang, version, n_tokens)`` per row and version; a version without vocabulary counts UTF-8 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast({v: tuple(x) if x else None for v, x in versions.items()})
    rows = docs.select(column("doc_id").alias("doc_id"), column("source").cast("string").alias("source"), column("lang").cast("string").alias("lang"), column(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_count, shared), f"doc_id {kind}, source string, lang string, version string, n_tokens bigint")


def changes(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Net change per group of counted documents that come and go; a revision gives both."""
    signed = [x.select(*GROUP, F.lit(sign).cast("bigint").alias("docs"), (F.col("n_tokens") * sign).alias("tokens")) for x, sign in ((inserted, 1), (deleted, -1)) if x is not None]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept in a shared folder, one table per committed batch."""

    SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        jvm, root, fs = self._files()
        if not fs.exists(root):
            return []
        paths = [s.getPath() for s in fs.listStatus(root)]
        return sorted(p.getName().removeprefix("batch-") for p in paths if p.getName().startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def commit(self, name: str, change: DataFrame) -> bool:
        """Add a batch of changes; False and no effect if that name is committed already."""
        if not name or not all(c.isalnum() or c in "._-" for c in name):
            raise ValueError(f"not a batch name: {name!r}")
        if name in self.batches():
            return False
        net = change.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        net.write.mode("overwrite").parquet(f"{self.path}/batch-{name}")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, version, docs, tokens)`` over all committed batches."""
        paths = [f"{self.path}/batch-{b}" for b in self.batches()]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
