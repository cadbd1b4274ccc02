"""The corpus operators against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmx.llm import bpe, components, dimension_scan, edit_embedding, host_words, line_dedup, mixing, ngram_join, ppm, rollups, shingles, toxicity
from labelmx.llm.queries import vocabulary_path
from labelmx.plans.durable import new_path

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("n", "s", "t") for c in ("a", "e", "o", "um")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def shingle_set(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == roots({x for e in edges for x in e}, edges)


def test_jaccard_components(frame, odd, spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(8, 80)).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = roots(sets, alike)
    assert got == {i: (len(sets[i]), top[i]) for i in sets}
    assert len(set(top.values())) < len(rows)
    seen = ngram_join.jaccard_components(odd).collect()
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in seen}
    assert by_id[0] == (0, 0) and by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (1, 3)
    assert by_id[5][1] == 4 and by_id[None][1] is None and len(seen) == 11
    assert ngram_join.jaccard_components(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "6", "7", "8", "9", "None"])


@pytest.mark.parametrize("long", [0, 512])
def test_jaccard_components_of_sizes_that_differ(frame, monkeypatch, long):
    monkeypatch.setattr(ngram_join, "LONG", long)
    rng = random.Random(11)
    rows, word = [], iter(f"w{i}" for i in range(100_000))
    for size in (4, 6, 13, 40, 90):
        base = [next(word) for _ in range(size + 4)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 4 + size // 30)):  # some links hold, some just miss
                w[rng.randrange(len(w))] = next(word)
            a = rng.randrange(0, 1 + size // 4)
            rows.append((len(rows), " ".join(w[a:] + [next(word) for _ in range(rng.randrange(0, 2 + size // 8))])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(rows)).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    top = roots(sets, alike)
    assert got == {i: (len(sets[i]), top[i]) for i in sets}
    assert 5 < len(set(top.values())) < len(rows)


@pytest.mark.parametrize("size", [300, 3000])
def test_last_round_meets_early_shingles_only(frame, spark, size):
    # one list of 300 sets of 100 shingles: 200 have it too late for a partner of their size, 60 are too small for the rest
    rows = [(7, i, 100 if i < 240 else 70, 20 if i < 200 else 3, i % 100, 0, size, 70) for i in range(300)]
    lists = spark.createDataFrame(rows, "token bigint, id bigint, n bigint, place int, label bigint, main bigint, size bigint, least bigint")
    got = {(r.a, r.b) for r in ngram_join.NgramJoin(frame([(0, "a b c d e f")]))._rest(lists).collect()}
    left = range(200, 240)
    early = {(a, b) for a in left for b in left if a < b}
    small = {(a, b) for a in range(240, 300) for b in range(240, 300) if a < b}
    assert got == {(a, b) for a, b in early | small if a % 100 != b % 100}


def test_shingles_of_words_at_chunk_edges():
    import pyarrow as pa

    texts = ["A b c d e f", None, "", "  ", "a B\tc\nd e", "x", "a b c d e f"]
    got = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(s) for s in got] == [2, 0, 0, 0, 1, 1, 2]
    assert (got[0] == got[6]).all() and got[4][0] in got[0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(frame, odd):
    rng = random.Random(3)
    base = [prose(rng, 6)[:rng.randrange(20, 40)] for _ in range(8)]
    rows, letters = [], "abcxyzé"
    for i in range(30):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            x = rng.choice(base)
            for _ in range(rng.randrange(0, 3)):
                p = rng.randrange(len(x))
                x = rng.choice([x[:p] + x[p + 1 :], x[:p] + rng.choice(letters) + x[p + 1 :], x[:p] + rng.choice(letters) + x[p:]])
            lines.append(rng.choice([x, x, "short"]))
        rows.append((i, "\n".join(lines)))
    first = {}
    for i, t in rows:
        for no, x in enumerate(t.split("\n")):
            if len(x) >= 20:
                first.setdefault(x, (i, no))
    bad = {x for x, at in first.items() if any(other < at and abs(len(x) - len(y)) < 2 and edits(x, y) == 1 for y, other in first.items())}
    want = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if len(x) < 20 or (x not in bad and first[x] == (i, no))) for i, t in rows}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert got == want and bad
    out = line_dedup.dedup_lines(odd)
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == odd.columns and len(texts) == 12
    assert (0, None) in texts and (1, "") in texts and (9, "a\n\nb\nThe same line of some length here") in texts and (5, "") in texts
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,same", [("abc", "abc", True), ("abc", "abd", True), ("abc", "ab", True), ("abc", "axbc", True), ("ab", "ba", False), ("abc", "a", False), ("", "x", True)])
def test_one_edit(a, b, same):
    assert line_dedup._one_edit(a, b) is same and line_dedup._one_edit(b, a) is same


def test_toxicity(frame, odd, labels):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        words = prose(rng, 30).split()
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(["blarg", "snorfel", "gruntig", "gruntor"], 2):
                words.insert(rng.randrange(30), w)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic), "clash"))
    docs, known = frame(rows), labels(marks)
    lexicon = toxicity.learn_lexicon(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in held)
    assert toxicity.folded("BL4RG") in {e.term for e in lexicon.entries}
    tricky = frame([(0, "you Bl@rg there my dear friend of old"), (1, "Вlаrg it is again today or so"), (2, "unblargs here and there are fine words"), (3, "nothing at all is here today")])
    seen = {r.doc_id: len(r.terms) for r in toxicity.score(tricky, lexicon).collect()}
    assert seen[0] == 1 and seen[1] <= 1 and seen[2] == 0 and seen[3] == 0
    spared = lexicon._replace(exceptions=("blarg house",))
    assert not toxicity.score(frame([(0, "a blarg house by the sea")]), spared).first().terms
    out = toxicity.score(odd, lexicon)
    assert out.count() == 12 and [c for c in out.columns if c not in ("n_words", "terms", "score")] == [c for c in odd.columns if c not in ("n_words", "terms", "score")]
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.drop_toxic(docs, known).columns == docs.columns
    nothing = toxicity.learn_lexicon(odd, labels([(None, 1, 1, ""), (3, 1, None, "")]))
    assert nothing.entries == () and all(r.score == 0 for r in toxicity.score(odd, nothing).collect())


def test_mixing(frame, odd, labels, spark):
    rng = random.Random(5)
    kinds = {"good": VOCABULARY[:16], "low": VOCABULARY[16:32], "toxic": VOCABULARY[32:]}
    rows, marks = [], []
    for i in range(120):
        kind = ("good", "good", "low", "toxic")[i % 4]
        rows.append((i, " ".join(rng.choice(kinds[kind] + VOCABULARY) for _ in range(rng.randrange(1, 40)))))
        marks.append((i, int(kind != "low"), int(kind == "toxic"), "clash"))
    docs = frame(rows)
    weights = {"good": 2, "low": 1, "toxic": 1}
    rates, model, shift = mixing.mixing_rates(docs, mixing.label_domains(labels(marks[:60])), weights)
    got = rates.collect()
    p, n, r = np.array([x.posteriors for x in got]), np.array([x.n_tokens for x in got]), np.array([x.rate for x in got])
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all() and {x.doc_id: x.n_tokens for x in got} == {i: len(t.split()) for i, t in rows}
    total = n.sum()
    assert np.allclose(r @ (n[:, None] * p), [total / 2, total / 4, total / 4], rtol=1e-6)
    # posteriors by a plain naive Bayes over the same buckets
    bucket = {x.w: x.b for x in spark.createDataFrame([(w,) for w in VOCABULARY], "w string").select("w", mixing._bucket(F.col("w")).alias("b")).collect()}
    one = got[7]
    text = dict(rows)[one.doc_id].split()
    logits = [q + sum(e[bucket[w]] for w in text) / math.sqrt(len(text)) for q, e in zip(model.priors, model.evidence)]
    assert np.allclose(one.posteriors, np.exp(np.array(logits) - max(logits)) / np.exp(np.array(logits) - max(logits)).sum())
    copies = Counter(x.doc_id for x in mixing.mix(docs, mixing.label_domains(labels(marks[:60])), weights).collect())
    assert all(math.floor(x.rate) <= copies[x.doc_id] <= math.ceil(x.rate) for x in got)
    some = mixing.label_domains(labels([(4, 1, 0, ""), (8, 0, 0, ""), (8, 0, 0, ""), (3, 1, 1, ""), (None, 1, 1, ""), (99, 1, 0, "")]))
    out = mixing.mix(odd, some, weights)
    assert out.columns == odd.columns and mixing.mixing_rates(odd, some, weights)[0].count() == 12
    assert mixing.mix(odd.limit(0), some, weights).count() == 0
    assert mixing.mix(odd, some.limit(0), weights).count() == 12


def test_mixing_meets_what_it_can(spark):
    """Unreachable targets: nonnegative least squares may leave a rest but never a negative rate."""
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.8, 0.2]), (5, [0.6, 0.4])], "n_tokens bigint, posteriors array<double>")
    shift = mixing.fit_shift(rows, ("a", "b"), {"a": 0.0, "b": 1.0})
    rated = rows.withColumn("r", mixing.rate_of(F.col("posteriors"), shift)).collect()
    assert np.allclose([x.r for x in rated], [0, 0, 35 * 0.4 / (5 * 0.52)], atol=1e-4)


def plain_rates(a, want):
    """Nonnegative least squares by coordinate descent on a dense matrix."""
    r = np.ones(a.shape[1])
    rest = a @ r - want
    square = (a * a).sum(axis=0)
    for _ in range(20_000):
        before = r.copy()
        for d in range(len(r)):
            new = max(0.0, r[d] - a[:, d] @ rest / square[d])
            rest += a[:, d] * (new - r[d])
            r[d] = new
        if abs(before - r).max() < 1e-12:
            break
    return r


@pytest.mark.parametrize("seed, k, target", [(1, 2, (0, 1)), (3, 3, (0, 0, 1)), (4, 3, (0.5, 0.5, 0)), (5, 4, (1, 0, 0, 0)), (6, 3, (0.4, 0.3, 0.3)), (7, 4, (0, 0.7, 0.3, 0))])
def test_mixing_is_least_squares(spark, seed, k, target):
    """Rates against a plain solver, most targets out of reach: equal totals, none lower in distance."""
    rng = np.random.default_rng(seed)
    n, p = rng.integers(1, 60, 25), rng.dirichlet(np.full(k, 3.0), 25)
    rows = spark.createDataFrame([(int(x), [float(v) for v in y]) for x, y in zip(n, p)], "n_tokens bigint, posteriors array<double>").coalesce(1).persist()
    names = tuple("abcd"[:k])
    shift = mixing.fit_shift(rows, names, dict(zip(names, target)))
    got = np.maximum(0, 1 - p @ np.array(shift))
    a, want = (n[:, None] * p).T, np.array(target) * n.sum()
    best = a @ plain_rates(a, want)
    assert np.allclose(a @ got, best, atol=1e-4 * n.sum())
    assert np.linalg.norm(a @ got - want) <= np.linalg.norm(best - want) + 1e-5 * n.sum()


def test_bpe(frame, odd):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    signs = list("ab'sl \n\t é漢1!<| 　\x1c") + ["<|endoftext|>", " à "]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(0, 40)))) for i in range(500)]
    rows += [(500, " <|endoftext|> a"), (501, "don't we'LL 1234  x\r\n\r\n"), (502, "y" * 3000)]
    vocabulary = bpe.load_vocabulary(vocabulary_path())
    encoded = bpe.encode(frame(rows), vocabulary)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    plain = Tokenizer.from_file(vocabulary_path())
    assert got == {i: plain.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, vocabulary).collect()} == dict(rows)
    broken = encoded.select("doc_id", F.array(F.lit(10528), F.lit(-1), F.lit(999999)).cast("array<int>").alias("ids")).limit(1)
    assert bpe.decode(broken, vocabulary).first().decoded == plain.decode([10528], skip_special_tokens=False)
    out = bpe.encode(odd, vocabulary)
    assert sorted(out.columns) == sorted(odd.columns) and out.count() == 12
    made = {r.doc_id: r for r in bpe.digests(odd, vocabulary_path()).collect()}
    assert made[0].n_tokens == 0 and made[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(odd.limit(0), vocabulary_path()).count() == 0


def test_every_token_survives_its_own_merges():
    from tokenizers import Tokenizer

    vocabulary = bpe.load_vocabulary(vocabulary_path())
    encoder, plain = bpe.Encoder(*vocabulary), Tokenizer.from_file(vocabulary_path())
    texts = [t.decode() for t in vocabulary.tokens if t and not any(b >= 0x80 for b in t)]
    assert all(encoder.encode(t).tolist() == e.ids for t, e in zip(texts, plain.encode_batch(texts, add_special_tokens=False)))


def test_rollup(frame, odd, spark):
    versions = {"byte_bpe_50k": bpe.load_vocabulary(vocabulary_path()), "bytes": None}
    docs = frame([(i, t) for i, t in enumerate(["one two", "drei vier fünf", None, ""])])
    counted = rollups.count_tokens(docs, versions)
    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", rollups.changes(inserted=counted)) and not rollup.commit("a", rollups.changes(inserted=counted))
    later = rollups.count_tokens(docs.where("doc_id < 2").withColumn("text", F.lit("one")), versions)
    gone = counted.where("doc_id < 2")
    assert rollup.commit("b", rollups.changes(inserted=later, deleted=gone))
    assert rollup.commit("c", rollups.changes(deleted=counted.where("doc_id = 3")))
    assert rollup.commit("d", rollups.changes(inserted=counted.limit(0))) and rollup.batches() == ["a", "b", "c", "d"]
    got = {(r.source, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}
    # documents 0 (null source), 1 and 2 are left; 0 and 1 read "one"
    assert got == {(None, "bytes"): (1, 3), ("s", "bytes"): (2, 3), (None, "byte_bpe_50k"): (1, 1), ("s", "byte_bpe_50k"): (2, 1)}
    assert rollups.count_tokens(odd, versions).count() == 24
    with pytest.raises(ValueError):
        rollup.commit("../x", counted)


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "<p>the good house of the river</p>", 1) for i, u in enumerate(urls)], "page_id bigint, url string, html string, score int")


def test_host_words(spark):
    urls = [
        "http://a.com/x", "HTTPS://WWW.Example.COM/en/1?q#f", "http://example.com/en/", "http://sub.example.com/en/z", "http://x.net/es/1", "http://x.net/de/1", "http://com", "no scheme", None,
        "http://goodhouse.org", "http://casino-win.org/a", "http://bigcasino.org/a", "", "://", "http://u?://v/w",
    ]
    got = {r.page_id: r for r in host_words.judge(pages_of(spark, urls)).collect()}
    assert [got[i].rule for i in range(9)] == ["com/", "www.example.com/en/", "example.com/en/", "example.com/en/", "net/es/", None, None, None, None]
    assert [got[i].verdict for i in range(5)] == ["allow", "allow", "block", "block", "block"] and got[10].verdict == "block"
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/1") and (got[7].host, got[8].path) == ("", "") and (got[14].host, got[14].path) == ("u", "")
    assert "h:good" in got[9].tokens and "h:house" in got[9].tokens
    assert host_words.judge(pages_of(spark, urls).limit(0)).count() == 0
    only = host_words.judge(pages_of(spark, ["http://plain.org/a"] * 2)).collect()
    assert [r.verdict for r in only] == ["allow", "allow"]


def test_host_words_keeps_rare_words(spark, monkeypatch):
    monkeypatch.setattr(host_words, "MIN_SHARE", 0.2)  # nearly all words, runs and tokens are rare
    urls = ["http://rarehouse.org/goodzebra", "http://bigcasino.net/win", "http://bigwin.net/rare/zebra", "http://house.org/12/good", "http://casinozebra.org/", None] * 2
    texts = ["the good house", "the zebra", "the big win", "rare", "the of the", None] * 2
    pages = spark.createDataFrame([(i % 9, u, t) for i, (u, t) in enumerate(zip(urls, texts))], "page_id bigint, url string, html string")
    got = host_words.judge(pages, rules=()).collect()
    counts = Counter(w for t in texts if t for w in t.split())
    plain = host_words.Segmenter(dict.fromkeys(host_words.SEEDS, 1) | counts, sum(counts.values()))
    tokens = lambda h, p: [r[:2] + w for r in host_words.runs_of(h, p) for w in (plain.split(r[2:]) if r[2:] != "0" else "0")]
    assert len(got) == 12 and all(r.tokens == tokens(r.host, r.path) for r in got)
    assert {"h:rare", "h:house", "p:good", "p:zebra"} == set(next(r.tokens for r in got if r.host == "rarehouse.org")) - {"h:" + w for w in plain.split("org")}
    bad = [any(t[:2] == "h:" and t[2:] in host_words.SEEDS for t in r.tokens) for r in got]
    kinds = {b: Counter(t for r, x in zip(got, bad) if x is b for t in r.tokens) for b in (True, False)}
    size = {b: sum(kinds[b].values()) + len(kinds[True] | kinds[False]) for b in kinds}
    assert sum(bad) == 4
    for r in got:
        want = math.log(sum(bad) / (12 - sum(bad))) + sum(math.log((kinds[True][t] + 1) / size[True]) - math.log((kinds[False][t] + 1) / size[False]) for t in r.tokens)
        assert math.isclose(r.score, want, rel_tol=1e-9) and r.verdict == ("block" if want > 0 else "allow")


def test_segmentation_is_the_best_split():
    counts = {"the": 50, "river": 9, "r": 3, "iver": 1, "bank": 8, "ban": 2, "k": 1}
    s = host_words.Segmenter(counts)

    def every(x):
        return [[x]] + [[x[:i], *rest] for i in range(1, len(x)) for rest in every(x[i:])] if x else [[]]

    for run in ("theriver", "riverbank", "xthe", "kkk"):
        best = max(sum(s._cost(w) for w in split) for split in every(run))
        assert math.isclose(sum(s._cost(w) for w in s.split(run)), best)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_scan_abandons_inside_one_block(spread):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 64)) * spread + np.repeat(rng.standard_normal((7, 64)), 100, axis=0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    for rows in (x[:3], x[:250], x):  # fewer than k, one step, several steps
        q, c = dimension_scan.scan(x[:40], np.arange(40), rows, np.arange(len(rows)), 5)
        far = ((x[:40, None] - rows[None]) ** 2).sum(axis=2)
        far[np.arange(min(40, len(rows))), np.arange(min(40, len(rows)))] = np.inf
        best = {(i, j) for i in range(40) for j in np.argsort(far[i])[:5] if far[i, j] < np.inf}
        kept = set(zip(q.tolist(), c.tolist()))
        assert len(kept) == len(q) and len(kept & best) >= 0.97 * len(best)
        assert len(q) <= 40 * 5 * 3  # what is not among the nearest of its step is not scored


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((600, 16)) + np.repeat(rng.standard_normal((6, 16)) * 2, 100, axis=0)
    x[10:200] = x[10]  # a very common vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None, *[1.0] * 15], 1), (1003, [float("nan")] * 16, 1), (1004, [1.0], 1), (5, rows[5][1], 1), (None, rows[5][1], 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = {}
    for r in dimension_scan.search(table, F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = 0
    assert set(got) == set(range(0, 600, 50))
    for q, found in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        truth = sorted(range(600), key=lambda i: (-s[i], i))[:5]
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and all(math.isclose(f[2], s[f[1]], abs_tol=1e-9) for f in found)
        hits += len({f[1] for f in found} & set(truth))
    assert hits >= 0.9 * 5 * len(got)
    assert dimension_scan.search(table.limit(0), F.col("id") % 50 == 0).count() == 0
    assert dimension_scan.search(table.where("vec_id IN (0, 1)"), F.col("id") % 50 == 0).count() == 1


def test_edit_embedding(frame, odd):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(20, 200))) for i in range(60)]
    got = {r.doc_id: r for r in edit_embedding.compare_with_next(frame(rows)).collect()}
    texts = dict(rows)
    for i, t in rows:
        following = texts[(i - 1) % 60]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(t)
        assert [got[i].fingerprint, got[i].edited_fingerprint] == edit_embedding.fingerprints([t, changed])
        assert got[i].near_edited == edit_embedding.likeness(*edit_embedding.fingerprints([t, changed])) and got[i].near_next == edit_embedding.likeness(got[i].fingerprint, got[(i - 1) % 60].fingerprint)
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 + np.mean([r.near_next for r in got.values()])
    seen = edit_embedding.compare_with_next(odd).collect()
    assert len(seen) == 12 and {r.fingerprint for r in seen if r.doc_id in (0, 1)} == {"0-"} and all(0 <= r.near_next <= 1 for r in seen)
    assert len({r.fingerprint for r in seen if r.doc_id in (4, 5)}) == 1
    assert edit_embedding.compare_with_next(odd.limit(0)).count() == 0
    single = edit_embedding.compare_with_next(frame([(1, "only one")])).first()
    assert single.near_next == 1.0


def test_walk_is_the_plain_walk():
    text = "Größe und Maß, a walk of some length " * 4
    symbols = list(edit_embedding._symbols(text)) + [0]
    place, written = 0, []
    steps = 3 * len(text) + 16
    for j in range(steps):
        written.append(symbols[place])
        place += int(edit_embedding._moves(j // 64)[j % 64][symbols[place]])
    assert edit_embedding.walk(["", text, "short"])[1] == bytes(written[j] for j in edit_embedding._sampled(steps))
    assert place == len(text)


def test_walks_reach_the_end():
    rng = random.Random(31)
    texts = [prose(rng, rng.randrange(1, 60))[: rng.randrange(1, 200)] for _ in range(300)]
    changed = [t[:-1] + ("#" if t[-1] != "#" else "%") for t in texts]
    pairs = list(zip(edit_embedding.fingerprints(texts), edit_embedding.fingerprints(changed)))
    short = [(a, b) for a, b in pairs if 3 * int(a.split("-")[0], 16) + 16 <= edit_embedding.SAMPLES]
    assert len(short) > 20 and all(a != b for a, b in short)
    assert edit_embedding.likeness(*edit_embedding.fingerprints(["a", "b"])) == 0.0


def test_bands_meet_near_texts_and_part_others():
    rng = random.Random(32)
    texts = [prose(rng, rng.choice([4, 30, 200, 900])) for _ in range(200)]
    near = [t[: (at := rng.randrange(len(t)))] + "q" + t[at + 1 :] for t in texts]
    prints, others = edit_embedding.fingerprints(texts), edit_embedding.fingerprints(near)
    keys = [set(edit_embedding._bands(p)) for p in prints]
    alike = [i for i in range(200) if edit_embedding.likeness(prints[i], others[i]) >= 0.75]
    met = [i for i in alike if keys[i] & set(edit_embedding._bands(others[i]))]
    assert len(alike) > 120 and len(met) >= 0.9 * len(alike)
    apart = [(i, j) for i in range(200) for j in range(i) if edit_embedding.likeness(prints[i], prints[j]) < 0.75]
    assert sum(bool(keys[i] & keys[j]) for i, j in apart) < 0.05 * len(apart)


def test_near_copies(frame):
    rng = random.Random(9)
    base = [prose(rng, 120) for _ in range(6)]
    rows = [(10 * i + k, t if k < 2 else t[:300] + "x" * (k - 2) + t[300 + 2 * (k - 2) :]) for i, t in enumerate(base) for k in range(2)]
    rows += [(100, base[0][:-3] + "end"), (101, ""), (102, None)]
    got = {r.doc_id: r.class_id for r in edit_embedding.near_copies(frame(rows)).collect()}
    assert got[100] == 0 and all(got[10 * i + 1] == 10 * i for i in range(6)) and got[101] == 101 and got[102] == 102


def test_near_copies_verifies_every_pair_of_a_band(frame):
    rng = random.Random(3)
    text, rows = prose(rng, 200), []
    for i in range(14):  # a chain: each differs a little more from the first
        rows.append((i + 1, text))
        at = len(text) - 60 * (i + 1)
        text = text[:at] + "".join(rng.choice("qxz") for _ in range(40)) + text[at + 40 :]
    rows += [(20 + i, prose(rng, 200)) for i in range(4)] + [(0, rows[0][1][:200] + prose(rng, 170)), (40, rows[3][1])]
    prints = dict(zip([i for i, _ in rows], edit_embedding.fingerprints([t for _, t in rows])))
    keys = {i: set(edit_embedding._bands(p)) for i, p in prints.items()}
    links = [(a, b) for a in prints for b in prints if a < b and 40 not in (a, b) and keys[a] & keys[b] and edit_embedding.likeness(prints[a], prints[b]) >= 0.75]
    want = roots(prints, [*links, (4, 40)])
    got = {r.doc_id: r for r in edit_embedding.near_copies(frame(rows)).collect()}
    low = min(a for a, _ in links)
    assert any(low not in pair for pair in links) and any(want[i] == low and (low, i) not in links for i in range(low + 1, 15))
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(got[i].n_links == sum((4 if i == 40 else i) in pair for pair in links) for i in prints)


def plain_ppm(train, text, order):
    """Log10 probability by the rule, with plain dictionaries."""
    seen = {}
    for t in train:
        b = [ppm.BEGIN] * order + list(t.translate(LOWER).encode()) + [ppm.END]
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen.setdefault(tuple(b[i - k : i]), Counter())[b[i]] += 1
    b, total = [ppm.BEGIN] * order + list(text.translate(LOWER).encode()) + [ppm.END], 0.0
    for i in range(order, len(b)):
        out = set()
        for k in range(order, -1, -1):
            here = seen.get(tuple(b[i - k : i]), {})
            left = {s: n for s, n in here.items() if s not in out}
            size = 2 * sum(left.values())
            if b[i] in left:
                total += math.log10((2 * left[b[i]] - 1) / size)
                break
            if size:
                total += math.log10(len(left) / size)
            out |= set(here)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_ppm(frame, odd):
    rng = random.Random(10)
    rows = [(i, prose(rng, 30).title()) for i in range(60)] + [(60, "Ganz anderes ÄÖ"), (61, None)]
    got = {r.doc_id: r for r in ppm.train_and_score(frame(rows)).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [t or "" for i, t in rows if i not in held]
    count = Counter(w for t in train for w in [*WORD.findall(t.translate(LOWER)), None])
    n, kinds = sum(count.values()), len(count)
    for i, t in rows:
        w = [*WORD.findall((t or "").translate(LOWER)), None]
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (i in held, len(w), sum(x in count for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((count[x] + 1) / (n + kinds + 1)) for x in w), rel_tol=1e-9)
    for i in [*sorted(held)[:3], 0, 60, 61]:
        assert math.isclose(got[i].score, plain_ppm(train, dict(rows)[i] or "", ppm.ORDER), rel_tol=1e-9)
    assert ppm.train_and_score(odd).count() == 12 and ppm.train_and_score(odd.limit(0)).count() == 0
    bare = ppm.train_and_score(frame([(2, "ab"), (5, "")]).where("doc_id < 0")).count()
    assert bare == 0


def test_ppm_sums_come_back_in_blocks():
    """A record for each part that a block of rows met, not one for each of its rows."""
    rng, parts = np.random.default_rng(5), 4
    keys, worth = np.arange(500, dtype=np.uint64) * np.uint64(977), rng.normal(size=500)
    runs = [rng.choice(keys, 60) for _ in range(50)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(100, 150), pa.int64()), pa.array([x.tobytes() for x in runs], pa.binary())], ["row", "runs"])
    scores = list(ppm._parcel_batches(ppm._parcels(keys, worth, parts), 0))
    sent = pa.Table.from_batches([*scores, *ppm._pack(parts, [rows])]).sort_by([("part", "ascending"), ("kind", "ascending")])
    met = pa.Table.from_batches(ppm._meet(sent.to_batches()))
    assert met.num_rows == parts and set(met.column("block").to_pylist()) == {100}
    value = dict(zip(keys.tolist(), worth.tolist()))
    got = {r["row"]: r["rest"] for r in ppm._total(met).to_pylist()}
    assert got == pytest.approx({100 + i: sum(value[k] for k in x.tolist()) for i, x in enumerate(runs)})


def test_ppm_keeps_rare_runs(frame, monkeypatch):
    monkeypatch.setattr(ppm, "SHARE_BITS", 4)  # a table of 16 runs at most: nearly all are rare
    rng = random.Random(5)
    rows = [(i, prose(rng, 30) + (" Größe 漢字" if i % 4 == 0 else "")) for i in range(40)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    got = {r.doc_id: r.score for r in ppm.train_and_score(frame(rows)).collect()}
    assert len(train) < 40 and all(math.isclose(got[i], plain_ppm(train, t, ppm.ORDER), rel_tol=1e-9) for i, t in rows)
