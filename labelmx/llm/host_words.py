"""URL filters: allow and block rules, and a classifier over segmented host names.

Rules name a host and a path beginning; a rule fits its host and all subdomains
where the URL's path begins with the rule's, and the longest fitting rule
decides. Other URLs are judged by a multinomial naive Bayes over words: host
labels are split at non-letters, and each run of letters into words by the best
path (Viterbi) under a unigram model; path words are added.

The unigram model counts the words of the pages' own texts and the parts of host
labels that are separated by other characters, all of them up to ``MAX_WORD`` letters; a seed counts as
seen once at least. Labels for the classifier come from
``SEEDS``: a host one of whose words is a seed is a bad example, others good. All
pages and tokens are counted. Words, runs and tokens that make up at least ``MIN_SHARE``
of all are looked up in tables of at most 1 / MIN_SHARE entries; the others meet in
joins: rare words with the distinct runs that may hold them, rare runs and tokens with their pages.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits
no rule, and is judged by the prior alone; empty hosts and paths have no words;
null or repeated html counts nothing or as often as it stands; with examples of
one kind only, the verdict is that kind, and with no pages nothing is returned;
ties go to allow; rows stay rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import stored
from .base import column

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SEEDS = ("casino", "bet", "bets", "pills", "spam", "adult", "ads", "porn", "loans", "viagra")
MIN_SHARE = 1e-5
MAX_WORD = 24
SALTS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = re.compile("[a-z]+|[0-9]+")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Segmenter:
    """Splits runs of letters into the likeliest words under unigram counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: the count of all words, where ``counts`` has not all of them."""
        self.total = total or sum(counts.values()) or 1
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}

    def _cost(self, word: str, more: dict[str, float] = {}) -> float:
        found = self.log.get(word, more.get(word))
        # an unknown word is the less likely the longer it is
        return found if found is not None else math.log(10 / self.total) - math.log(10) * len(word)

    def split(self, run: str, more: Iterable[tuple[str, int]] = ()) -> tuple[str, ...]:
        """The likeliest words of ``run``; ``more`` has counts of further words."""
        also = {w: math.log(n / self.total) for w, n in more}
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            score, start = max((best[s] + self._cost(run[s:end], also), s) for s in range(max(0, end - MAX_WORD), end))
            best.append(score)
            back.append(start)
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(words))


def runs_of(host: str, path: str) -> list[str]:
    """Runs of letters of host and path, marked h: or p:; a run of digits is 0."""
    return [kind + ("0" if run[0].isdigit() else run) for kind, text in (("h:", host), ("p:", path.lower())) for run in _LETTERS.findall(text)]


class Bayes(NamedTuple):
    prior: float  # log odds of a bad page
    weights: dict[str, float]  # of frequent tokens
    others: DataFrame | None  # (token, weight) of the others


def count_words(pages: DataFrame) -> DataFrame:
    """``(word, n)``: words of the html outside tags, and the separated parts of hosts."""
    text = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), "<[^>]*>", " ")
    html = pages.select(F.explode(F.split(F.lower(text), "[^a-z]+", -1)).alias("word"))
    labels = pages.select(F.explode(F.split(host_of(F.col("url")), "\\.", -1)).alias("label")).where(F.col("label").rlike("[^a-z]"))
    hosts = labels.select(F.explode(F.split("label", "[^a-z]+", -1)).alias("word"))
    return html.union(hosts).where(F.length("word").between(1, MAX_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _runs(batches):
    for b in batches:
        runs = [runs_of(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(runs, pa.list_(pa.string()))], [*b.schema.names, "runs"])


def _candidates(counts, batches):
    """Parts of runs that may be words not in the table."""
    for b in batches:
        for run in b.column(0).to_pylist():
            parts = sorted({run[s:e] for e in range(1, len(run) + 1) for s in range(max(0, e - MAX_WORD), e)} - counts.value.keys())
            yield pa.RecordBatch.from_arrays([pa.array([run] * len(parts), pa.string()), pa.array(parts, pa.string())], ["run", "word"])


def _splits(counts, total, batches):
    segmenter = Segmenter(counts.value, total)
    for b in batches:
        words = [segmenter.split(run, ((m["word"], m["n"]) for m in more or ())) for run, more in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], ["run", "uses", "words"])


def _not_in(known, cut, batches):
    """Distinct entries of each row's list, without their first ``cut`` characters, that the table has not."""
    for b in batches:
        found = [(r, x) for r, xs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in {x[cut:] for x in xs} - known.value.keys()]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["row", "entry"])


def _tokens(often, batches):
    for b in batches:
        rows = []
        for runs, more in zip(b.column("runs").to_pylist(), b.column("more").to_pylist()):
            also = {m["run"]: m["words"] for m in more or ()}
            rows.append([r[:2] + w for r in runs for w in (often.value.get(r[2:]) or also[r[2:]])])
        keep = ["row", "page_id", "host", "path"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(rows, pa.list_(pa.string()))], [*keep, "tokens"])


def split_runs(runs: DataFrame, words: DataFrame, seeds: Iterable[str] = SEEDS) -> DataFrame:
    """``(run, uses, words)``: the likeliest words of every run of ``(run, uses)`` under the counts ``(word, n)``."""
    spark = runs.sparkSession
    total = words.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= total * MIN_SHARE  # at most 1 / MIN_SHARE rows
    table = dict.fromkeys(seeds, 1) | {r.word: r.n for r in words.where(often | F.col("word").isin(*seeds)).collect()}
    shared = spark.sparkContext.broadcast(table)
    # a part may be in many runs: its rows are spread over salts
    parts = runs.select("run").mapInArrow(partial(_candidates, shared), "run string, word string").withColumn("salt", F.pmod(F.xxhash64("run"), F.lit(SALTS)))
    rare = words.where(~often).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    more = parts.join(rare, ["word", "salt"]).groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("more"))
    return runs.join(more, "run", "left").select("run", "uses", "more").mapInArrow(partial(_splits, shared, total), "run string, uses bigint, words array<string>")


def segmented(pages: DataFrame, words: DataFrame, seeds: Iterable[str] = SEEDS) -> DataFrame:
    """``(row, page_id, host, path, tokens)``; row numbers the pages."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), column("page_id").alias("page_id"), host_of(column("url")).alias("host"), path_of(column("url")).alias("path"))
    kind = f"row bigint, page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string"
    rows = stored(rows.mapInArrow(_runs, f"{kind}, runs array<string>"), "rows")
    runs = rows.select(F.explode("runs").alias("run")).select(F.expr("substring(run, 3)").alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("uses"))
    runs = stored(runs, "runs")
    total = runs.agg(F.sum("uses")).first()[0] or 0
    splits = stored(split_runs(runs.where("run <> '0'"), words, seeds), "splits")
    often = {"0": ["0"]} | {r.run: list(r.words) for r in splits.where(F.col("uses") >= total * MIN_SHARE).collect()}  # at most 1 / MIN_SHARE rows
    shared = pages.sparkSession.sparkContext.broadcast(often)
    rare = rows.select("row", "runs").mapInArrow(partial(_not_in, shared, 2), "row bigint, entry string").withColumnRenamed("entry", "run")
    more = rare.join(splits, "run").groupBy("row").agg(F.collect_list(F.struct("run", "words")).alias("more"))
    return rows.join(more, "row", "left").mapInArrow(partial(_tokens, shared), f"{kind}, tokens array<string>")


def fit_bayes(rows: DataFrame, seeds: Iterable[str] = SEEDS) -> Bayes:
    """Naive Bayes of pages whose hosts hold a seed word against the others."""
    bad = F.arrays_overlap("tokens", F.array(*[F.lit("h:" + s) for s in seeds]))
    seen = rows.select(bad.alias("bad"), "tokens")
    sizes = {r.bad: r["count"] for r in seen.groupBy("bad").count().collect()}
    if len(sizes) < 2:
        return Bayes(math.inf if sizes.get(True) else -math.inf, {}, None)
    counted = seen.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    counted = stored(counted, "tokens")
    n = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("kinds")).first()
    share = lambda c, of: F.log((F.col(c) + 1) / F.lit(float(of + n.kinds)))
    weighed = counted.withColumn("weight", share("bad", n.bad) - share("good", n.good))
    often = F.col("bad") + F.col("good") >= (n.bad + n.good) * MIN_SHARE  # at most 1 / MIN_SHARE rows
    return Bayes(math.log(sizes[True] / sizes[False]), {r.token: r.weight for r in weighed.where(often).collect()}, weighed.where(~often).select("token", "weight"))


def parse_rules(rules: Iterable[tuple[str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    """Per host its (path beginning, rule, verdict), longest first."""
    out: dict[str, list] = {}
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        out.setdefault(host.lower(), []).append((slash + rest, rule, verdict))
    return {h: sorted(x, key=lambda r: (-len(r[0]), r)) for h, x in out.items()}


def fitting_rule(host: str, path: str, rules: dict) -> tuple[str | None, str | None]:
    """The longest rule that fits, and its verdict."""
    best = None
    parts = host.split(".")
    for i in range(len(parts)):
        for begin, rule, verdict in rules.get(".".join(parts[i:]), ()):
            if path.startswith(begin) and (best is None or len(rule) > len(best[0])):
                best = (rule, verdict)
                break
    return best or (None, None)


def _judge(shared, batches):
    rules, prior, weights = shared.value
    for b in batches:
        fits, scores = [], []
        for host, path, tokens, more in zip(*[b.column(c).to_pylist() for c in ("host", "path", "tokens", "more")]):
            fits.append(fitting_rule(host, path, rules))
            scores.append(prior + sum(weights.get(t, 0.0) for t in tokens) + (more or 0.0) if math.isfinite(prior) else prior)
        verdicts = [v or ("block" if s > 0 else "allow") for (_, v), s in zip(fits, scores)]
        keep = ["page_id", "host", "path", "tokens"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([r for r, _ in fits], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], [*keep, "rule", "verdict", "score"])


def _occurrences(known, batches):
    """Each occurrence of a token that the table has not."""
    for b in batches:
        found = [(r, t) for r, ts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in ts if t not in known.value[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], ["row", "token"])


def judge(pages: DataFrame, *, rules: Iterable[tuple[str, str]] = RULES, seeds: Iterable[str] = SEEDS) -> DataFrame:
    """``(page_id, host, path, tokens, rule, verdict, score)`` for every page; score is the log odds of block."""
    rules, seeds = tuple(rules), tuple(seeds)
    rows = stored(segmented(pages, stored(count_words(pages), "words"), seeds), "segmented")
    model = fit_bayes(rows, seeds)
    shared = pages.sparkSession.sparkContext.broadcast((parse_rules(rules), model.prior, model.weights))
    kind = rows.schema["page_id"].dataType.simpleString()
    judged = rows.withColumn("more", F.lit(None).cast("double"))
    if model.others is not None:
        rare = rows.select("row", "tokens").mapInArrow(partial(_occurrences, shared), "row bigint, token string")
        judged = rows.join(rare.join(model.others, "token").groupBy("row").agg(F.sum("weight").alias("more")), "row", "left")
    return judged.mapInArrow(partial(_judge, shared), f"page_id {kind}, host string, path string, tokens array<string>, rule string, verdict string, score double")
