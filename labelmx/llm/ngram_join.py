"""N-gram Jaccard join: documents whose shingle sets are at least ``threshold`` % alike.

Grouped prefix join. Shingles are ordered by how often they occur (rare first).
Two sets that reach the threshold share at least one of their first
``n - ceil(threshold * n) + 1`` shingles, their prefixes.

1. Documents with equal sets collapse to one *set* (its smallest doc_id).
2. Sets with identical prefixes and sizes collapse to one *group*; only groups
   enter the posting lists, and shingles of one group only leave at once.
3. Group pairs are filtered: sizes must fit, and the shared prefix shingles plus
   what lies behind the prefixes must be able to reach the needed overlap.
4. Groups expand to their members, whose pairs are verified on the whole sets.

A posting list of many near copies is not expanded into all its pairs. Each list
proposes one hub (the set with the fewest shingles of its own) and every member
is verified against it; members whose components are known to be joined need no
further pair. This repeats with other hubs while it finds links and the pairs
left would be many; then the pairs of one list that are still in different
components are verified, so no link that could join components is lost. Of these
only pairs meet whose shared shingle comes early enough in both sets for their two
sizes, which sorts most members out before they meet. Members within that bound
that are not alike still meet in pairs.

The order comes from a table of 2**20 counters filled from all shingles of all
documents; which counters a shingle shares only affects speed, never results.

Defined cases: null, empty and blank texts have no shingles and are linked with
nothing; a text with fewer words than a shingle is one shingle; repeated rows and
equal texts link with each other; rows with equal ``doc_id`` are one document
that has all their sets (``n_shingles`` is the largest); rows with a null
``doc_id`` stay unlinked, one row each with a null component; an empty table
gives an empty result; extra columns are ignored. ``doc_id`` is an integer.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from .base import column, task_count
from .components import components
from .shingles import mix, shingle_sets

COUNTER_BITS = 20
_SLICE = 4096
FILTER_WORDS = 1 << 18  # 2**24 bits, 2 MB broadcast
HUBS = 4
LONG = 512  # members of a list from which on they meet by ranges of sizes
RANGES = 8  # ranges of sizes from one power of two to the next


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _count(width, batches):
    """Counter totals of a partition, in slices of compact integers."""
    totals = np.zeros(1 << COUNTER_BITS, np.int64)
    for b in batches:
        for s in shingle_sets(b.column(0), width):
            np.add.at(totals, _counters(s), 1)
    at = np.arange(0, len(totals), _SLICE)
    used = [i for i in at if totals[i : i + _SLICE].any()]
    kind = np.uint16 if totals.max(initial=0) < 65536 else np.int64
    yield pa.RecordBatch.from_arrays(
        [pa.array([i // _SLICE for i in used], pa.int32()), pa.array([totals[i : i + _SLICE].astype(kind).tobytes() for i in used], pa.binary())], ["slice", "counts"]
    )


def _decoded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * _SLICE else np.int64).astype(np.int64)


def _add_slices(rows: pa.Table) -> pa.Table:
    total = np.zeros(_SLICE, np.int64)
    for raw in rows.column("counts").to_pylist():
        total += _decoded(raw)
    return pa.table({"slice": rows.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def shingle_counters(docs: DataFrame, *, width: int = 5, text: str = "text") -> np.ndarray:
    """Counts of all shingles of all documents in 2**COUNTER_BITS counters (8 MB, whatever the input)."""
    sliced = docs.select(column(text)).mapInArrow(partial(_count, width), "slice int, counts binary")
    # two steps, so that no task adds up what all tasks of the scan have sent
    salted = sliced.withColumn("salt", (F.spark_partition_id() / 256).cast("int"))
    part = salted.groupBy("slice", "salt").applyInArrow(_add_slices, "slice int, counts binary")
    total = part.groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary")
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in total.toLocalIterator():
        out[r.slice * _SLICE : (r.slice + 1) * _SLICE] = np.frombuffer(r.counts, np.int64)
    return out


def prefix_size(n: np.ndarray | int, threshold: int):
    return n - -(-threshold * n // 100) + 1


def _signatures(width, threshold, order, batches):
    """Per document: size, 128-bit hashes of its set and of its prefix, and the prefix."""
    ranks = order.value
    for b in batches:
        ids, sizes, sets, prefixes, tokens = b.column(0), [], [], [], []
        for s in shingle_sets(b.column(1), width):
            n = len(s)
            sizes.append(n)
            sets.append((int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))) if n else (0, 0))
            k = prefix_size(n, threshold) if n else 0
            first = s[np.lexsort((s, ranks[_counters(s)]))[:k]] if n else s
            prefixes.append((int(first.sum(dtype=np.uint64)), int(mix(first).sum(dtype=np.uint64))) if n else (0, 0))
            tokens.append(first.tobytes())
        as_long = lambda xs, i: pa.array(np.array([x[i] for x in xs], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), as_long(sets, 0), as_long(sets, 1), as_long(prefixes, 0), as_long(prefixes, 1), pa.array(tokens, pa.binary())],
            ["doc_id", "n", "s1", "s2", "p1", "p2", "tokens"],
        )


_POSTING = "token bigint, gid bigint, place int"


def _postings(batches):
    for b in batches:
        raw = b.column(1).to_pylist()
        counts = [len(x) // 8 for x in raw]
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in counts]) if counts else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), counts)), pa.array(place)], ["token", "gid", "place"])


def _shared_only(batches):
    """From rows sorted by token, those whose token occurs again; keeps one row between batches."""
    held, held_shared = None, False
    for b in batches:
        rows = pa.Table.from_batches([b])
        if not b.num_rows:
            continue
        if held is not None:
            rows = pa.concat_tables([held, rows])
        token = rows.column(0).to_numpy()
        same = token[1:] == token[:-1]
        shared = np.zeros(len(token), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared[0] |= held_shared
        held, held_shared = rows.slice(len(token) - 1), bool(shared[-1])
        keep = np.flatnonzero(shared[:-1])
        if len(keep):
            yield from rows.take(pa.array(keep)).combine_chunks().to_batches()
    if held is not None and held_shared:
        yield from held.combine_chunks().to_batches()


def _id_filter(ids: DataFrame, name: str) -> np.ndarray:
    """A one-hash filter of 2**24 bits over all ids, added up on the executors."""
    bit = F.pmod(F.xxhash64(name), F.lit(FILTER_WORDS * 64))
    words = ids.groupBy((bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))).alias("bits"))
    out = np.zeros(FILTER_WORDS, np.int64)
    for r in words.toLocalIterator():
        out[r.word] = r.bits
    return out


def _sets(width, wanted, batches):
    bits = wanted.value
    for b in batches:
        at = b.column(2).to_numpy()
        keep = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
        if not len(keep):
            continue
        part = b.take(pa.array(keep))
        raw = [s.tobytes() for s in shingle_sets(part.column(1), width)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], ["id", "shingles"])


def _alike(threshold, batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= threshold * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class NgramJoin:
    """One run of the join over ``docs``; see the module's text."""

    def __init__(self, docs: DataFrame, *, width: int = 5, threshold: int = 75, text: str = "text"):
        self.spark, self.width, self.threshold = docs.sparkSession, width, threshold
        self.docs = docs.select(column("doc_id").cast("bigint").alias("doc_id"), column(text).alias("text"))
        order = self.spark.sparkContext.broadcast(shingle_counters(self.docs, width=width))
        # prefixes are computed again where they are needed: that costs less than to keep them on disk
        self.whole = self.docs.mapInArrow(partial(_signatures, width, threshold, order), "doc_id bigint, n bigint, s1 bigint, s2 bigint, p1 bigint, p2 bigint, tokens binary")
        self.signed = stored(self.whole.drop("tokens"), "signed")

    def sets(self) -> DataFrame:
        """``(doc_id, n, s1, s2, rep)`` per document and set; rep is the smallest document with that set."""
        rows = self.signed.where("doc_id IS NOT NULL").select("doc_id", "n", "s1", "s2").distinct()
        reps = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
        return rows.join(reps, ["n", "s1", "s2"], "left").select("doc_id", "n", "s1", "s2", "rep")

    def links(self, sets: DataFrame) -> DataFrame:
        """Verified links ``(a, b)`` between sets that join everything the threshold joins."""
        reps = sets.where("doc_id = rep").select("doc_id", "n", "s1", "s2")
        narrow = self.signed.select("doc_id", "n", "s1", "s2", "p1", "p2").distinct()
        heads = stored(narrow.join(reps, ["doc_id", "n", "s1", "s2"], "left_semi"), "heads")
        groups = heads.groupBy("n", "p1", "p2").agg(F.min(F.struct("doc_id", "s1", "s2")).alias("lead"), F.count(F.lit(1)).alias("members"))
        member = heads.select(F.col("doc_id").alias("id"), "n", "p1", "p2").join(groups, ["n", "p1", "p2"])
        member = stored(member.select("id", F.col("lead.doc_id").alias("gid"), "n", "members"), "members")
        # the only exchange of whole prefixes, one row per group
        lead = groups.select("lead.*")
        lists = self.whole.select("doc_id", "s1", "s2", "tokens").join(lead, ["doc_id", "s1", "s2"], "left_semi")
        lists = lists.select("doc_id", "tokens").mapInArrow(_postings, _POSTING)
        lists = lists.repartition(task_count(lists), "token").sortWithinPartitions("token").mapInArrow(_shared_only, _POSTING)
        # members of one group share their whole prefix: place -1
        several = member.where("members > 1").select(F.xxhash64(F.lit("group"), "gid").alias("token"), "id", "n", F.lit(-1).alias("place"))
        # members take over the posting lists of their group; a group of several is a list itself
        lists = stored(lists.join(member.select("gid", "id", "n"), "gid").select("token", "id", "n", "place").union(several), "lists")
        wanted = self.spark.sparkContext.broadcast(_id_filter(lists.select("id"), "id"))
        texts = self.docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_WORDS * 64)).alias("bit"))
        shingles = stored(texts.where("doc_id IS NOT NULL").mapInArrow(partial(_sets, self.width, wanted), "id bigint, shingles binary"), "shingles")
        # how many shingles of a set are in no list: a set without own shingles makes a good hub
        own = lists.groupBy("id").agg((F.max("n") - F.count(F.lit(1))).alias("own"))
        lists = stored(lists.join(own, "id"), "lists")
        links, tested, label, found, turn = None, None, None, 1, 0
        while True:
            rows = lists if label is None else lists.drop("own").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
            if label is not None:
                # lists whose members are all joined are done; the rest meets the commonest label
                by_label = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"))
                main = by_label.groupBy("token").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds"), F.min("least").alias("least")).where("kinds > 1")
                main = main.select("token", F.col("top.label").alias("main"), F.col("all").alias("size"), (F.col("all") - F.col("top.c")).alias("others"), "least")
                rows = stored(rows.join(main.drop("others"), "token"), "open")
                left = rows.agg(F.count(F.lit(1))).first()[0]
                if not left:
                    break
                pairs_left = main.agg(F.sum(F.col("others") * F.col("size"))).first()[0]
                last = not found or 20 * found < asked or pairs_left <= left
                pairs = self._rest(rows) if last else self._possible(self._to_hubs(rows, turn))
            else:
                last, pairs = False, self._possible(self._to_hubs(rows, turn))
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = stored(pairs, "pairs")
            new = stored(self._verify(pairs, shingles), "links")
            found, asked = new.count(), pairs.count()
            links = new if links is None else links.union(new)
            tested = pairs if tested is None else tested.union(pairs)
            if last:
                break
            turn += 1
            label = stored(components(links).select(F.col("node").alias("id"), F.col("component").alias("label")), "labels")
        return links

    def _to_hubs(self, rows: DataFrame, turn: int) -> DataFrame:
        """Members of each list with its hubs: first the set with the fewest own shingles,
        later some of the commonest label for the members of other labels."""
        if turn == 0:
            hubs = rows.groupBy("token").agg(F.array(F.min(F.struct("own", "id", "n"))).alias("hubs"))
        else:
            common = rows.where("label = main")
            draws = [F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(i), "id").alias("own"), "id", "n")) for i in range(HUBS)]
            hubs, rows = common.groupBy("token").agg(F.array_distinct(F.array(*draws)).alias("hubs")), rows.where("label <> main")
        hubs = hubs.select("token", F.explode("hubs").alias("hub")).select("token", F.col("hub.id").alias("b"), F.col("hub.n").alias("nb"))
        met = rows.join(hubs, "token").where("id <> b").select("token", F.when(F.col("place") < 0, self._prefix()).otherwise(1).alias("shares"), F.col("id").alias("a"), F.col("n").alias("na"), "b", "nb")
        # two draws may name one hub
        return met.dropDuplicates(["token", "a", "b"]) if turn else met

    def _rest(self, rows: DataFrame) -> DataFrame:
        """Distinct pairs of different labels that share a shingle early enough in both sets.

        Sets of sizes m and n that overlap by ``need`` share one of the first ``m - need + 1`` shingles
        of one and ``n - need + 1`` of the other. That is less than the whole prefix, which must do for the
        smallest partner, and it holds per set: members of a long list meet by ranges of sizes, and a
        member whose shingle comes too late for a range does not go there.
        """
        t = self.threshold
        size_range = lambda n: F.floor(F.log2(n) * RANGES).cast("int")
        low, high = F.expr(f"({t} * n + 99) div 100"), F.expr(f"100 * n div {t}")
        ranges = F.when(F.col("size") > LONG, F.sequence(size_range(low), size_range(high))).otherwise(F.array(F.lit(-1)))
        rows = rows.select("token", "id", "n", "place", "label", "main", F.when(F.col("size") > LONG, size_range(F.col("n"))).otherwise(-1).alias("own"), F.explode(ranges).alias("other"), "least", low.alias("low"))
        # the smallest partner of a list and range leaves the most room
        smallest = F.greatest(F.col("low").cast("double"), F.col("least").cast("double"), F.when(F.col("other") < 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("other") / RANGES)))
        rows = rows.where(F.col("place") <= F.col("n") - t * (F.col("n") + smallest) / (100 + t) + 1e-6)
        strange = rows.where("label <> main").select("token", "own", "other", F.col("id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("label").alias("la"))
        whole = rows.select("token", F.col("other").alias("own"), F.col("own").alias("other"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("label").alias("lb"), (F.col("label") == F.col("main")).alias("common"))
        need = f"({t} * (na + nb) + {99 + t}) div {100 + t}"
        met = strange.join(whole, ["token", "own", "other"]).where("la <> lb AND (common OR a < b)")
        met = met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * t).where(f"pa <= na - {need} AND pb <= nb - {need}")
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def _prefix(self):
        return F.expr(f"n - ({self.threshold} * n + 99) div 100 + 1")

    def _possible(self, made: DataFrame) -> DataFrame:
        """Distinct pairs that pass the size and the overlap filter."""
        t = self.threshold
        fit = made.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * t)
        pairs = fit.select("shares", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("na", "nb").alias("least"), F.greatest("na", "nb").alias("most"))
        pairs = pairs.groupBy("a", "b", "least", "most").agg(F.sum("shares").alias("shared"))
        # what is shared in the prefixes, and all behind the larger prefix, must reach the overlap
        need = F.expr(f"({t} * (least + most) + {99 + t}) div {100 + t}")
        behind = F.expr(f"({t} * most + 99) div 100 - 1")
        return pairs.where(F.col("shared") + behind >= need).select("a", "b").distinct()

    def _verify(self, pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        side = lambda key, out: shingles.select(F.col("id").alias(key), F.col("shingles").alias(out))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        return both.mapInArrow(partial(_alike, self.threshold), "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, *, width: int = 5, threshold: int = 75, text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every document."""
    run = NgramJoin(docs, width=width, threshold=threshold, text=text)
    sets = stored(run.sets(), "sets")
    links = run.links(sets)
    # rows of one document may have several sets; they belong together
    several = sets.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("doc_id")
    tied = sets.join(several, "doc_id").where("rep IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = components(links.union(tied)).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    named = sets.join(parts, "rep", "left").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("part", "rep", "doc_id")).alias("component_id"))
    lost = run.signed.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.union(lost)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, that with the smallest ``doc_id``, in one row; documents without ids stay."""
    found = stored(jaccard_components(docs, **options), "components")
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("other_id"))
    kept = docs.join(others, docs["doc_id"] == others["other_id"], "left_anti")
    ids = docs.select(column("doc_id").alias("id")).where("id IS NOT NULL")
    if ids.groupBy("id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(kept.where("doc_id IS NULL"))
