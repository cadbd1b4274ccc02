"""Quality rules, source divergence and importance resampling against brute force, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmx.llm import divergence, quality, resampling, terms

from test_operators import LOWER, WORD, prose

TERM, RUN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_measures(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    again = {j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_stop_words": sum(x.translate(LOWER) in quality.STOP_WORDS for x in w), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullet_lines": sum(x.lstrip(" ")[:1] in quality.BULLETS for x in lines), "n_ellipsis_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
        "n_repeat_words": len(again),
    }


def held(rule, m):
    part, whole = (100 * m[rule.part], m[rule.whole]) if rule.whole else (m[rule.part], 1)
    return (rule.least is None or part >= rule.least * whole) and (rule.most is None or part <= rule.most * whole)


def test_quality_rules(frame, odd):
    rng = random.Random(21)
    small = ["the", "the", "of", "und", "THE", "x#y", "a|b", "kalo", "mirum", "…", "word...", "Größe"]
    rows = [(i, "".join(rng.choice(small) + rng.choice([" ", " ", "  ", "\t", "\n", "\n- ", "...\n"]) for _ in range(rng.randrange(0, 150)))) for i in range(120)]
    rows += [(200, "a b c " * 40), (201, "\n".join([prose(rng, 30) + " the of and"] * 2 + [prose(rng, 30)])), (202, " ".join(f"w{i} the" for i in range(40_000)))]
    got = {r.doc_id: r for r in quality.judge(frame(rows)).collect()}
    for i, text in rows:
        want = plain_measures(text)
        assert {c: got[i][c] for c in quality.MEASURES} == want
        base = all(held(r, want) for r in quality.BASE)
        assert got[i].base_failed == (not base) and got[i].kept == (base and all(held(r, want) for r in quality.RULES))
    assert {got[i].kept for i, _ in rows} == {True, False} and got[202].n_words == 80_000
    out = quality.judge(odd)
    assert out.count() == 12 and out.where("key = 'k' AND NOT kept").count() == 12 and quality.judge(odd.limit(0)).count() == 0
    kept = quality.keep_good(frame(rows))
    assert kept.columns == frame(rows).columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}


def test_quality_stays_in_the_jvm(frame):
    plan = quality.judge(frame([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def plain_audit(rows, least):
    words = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, w in words:
        docs[lang].update(set(w))
        counts[lang, source].update(w)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in docs.items()}
    groups = {(lang, source) for lang, source, _ in words}

    def shares(lang, c):
        total, v = sum(c[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept[lang]}

    apart = lambda p, q: (p - q) ** 2 // (p + q)
    of = {g: shares(g[0], counts[g]) for g in groups}
    whole = {lang: shares(lang, sum((counts[g] for g in groups if g[0] == lang), Counter())) for lang in kept}
    out = set()
    for g in groups:
        lang, source = g
        pairs = [(sum(apart(of[g][t], of[h][t]) for t in kept[lang]), h[1]) for h in groups if h[0] == lang and h != g]
        ups = [(apart(of[g][t], whole[lang][t]), t) for t in kept[lang] if counts[g][t] and of[g][t] > whole[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", ups, 10)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.add((lang, source, part, item, value, rank))
    return out


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_source_divergence(spark, block):
    rng = random.Random(22)
    rows = []
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None])
        words = [rng.choice(["kalo", "Mirum", "ruste", "eel", "Größe", "漢字", "x9y", "tail"]) for _ in range(rng.randrange(0, 30))]
        rows.append((rng.choice([" ", "-", "\n"]).join(words) + (" only" if source == "b" else ""), lang, source))
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("rare", "fr", "c"), ("x", "it", None)]
    docs = spark.createDataFrame([(i % 70, *r, "k") for i, r in enumerate(rows)], "doc_id int, text string, lang string, source string, term string")
    want = plain_audit(rows, 10)
    got = [tuple(r) for r in divergence.audit(docs, block=block).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {p for _, _, p, *_ in want} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_gallop_and_exact_shares():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 5000), (3000, 3100), (700, 20)):
        a, b = (np.unique(rng.integers(0, 9000, k)) for k in (n, m))
        assert (divergence.gallop(a, b) == (np.searchsorted(b, a) if len(b) else 0)).all()
    for n, total, kept in ((0, 0, 1), (7, 9, 3), (3 * 10**14, 4 * 10**15, 10**6)):
        assert divergence.shares_of(np.array([n]), total, kept)[0] == 1 + 10**9 * (n + 2) // (total + 2 * kept)
    with pytest.raises(OverflowError):
        divergence.shares_of(np.array([1]), 10**16, 5)


def features(text):
    w = RUN.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = {}
    for i, x in docs:
        w, fs = features(x)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out[i] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)]
    able = sorted((i for i in out if out[i][4] >= 20), key=lambda i: (-out[i][2], i))
    for rank, i in enumerate(able[: 5 * len(able) // 100], 1):
        out[i][3] = rank
    return {i: tuple(v[:4]) for i, v in out.items()}


def test_importance_resampling(spark, frame, odd):
    rng = random.Random(23)
    line = "One line that many of the documents share, word by word."
    rows = []
    for i in range(130):
        parts = [rng.choice([line, "", "x", "Größe 漢字", prose(rng, 9), "a9-b\tc"]) for _ in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(parts)))
    rows += [(300, None), (301, "z" * 70_000 + " and " + "é" * 300), (302, rows[3][1]), (303, "one two\nthree\n\nfour")]
    target = [line, "Größe 漢字 one two three", None, prose(rng, 40)]
    marks = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = resampling.resample(frame(rows), marks)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_resample(rows, target)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want and any(v[3] for v in want.values())
    out = resampling.resample(odd, marks).collect()
    assert len(out) == 12 and all(r["rank"] is None for r in out)
    assert resampling.resample(odd.limit(0), marks).count() == 0 and resampling.resample(odd, marks.limit(0)).count() == 12
    drawn = resampling.draw(frame(rows), marks, percent=20)
    assert drawn.columns == frame(rows).columns and drawn.count() == 20 * sum(len(features(t)[0]) >= 20 for _, t in rows) // 100


def test_crc_of_runs():
    words = ["a", "bc", "漢字", "q" * 300, "r" * 70_001, "zz9"]
    w = resampling.Words(pa.array(words, pa.large_string()))
    i = np.array([0, 3, 4, 5, 2])
    j, k = np.roll(i, 1), np.roll(i, 2)
    crc = lambda *at: zlib.crc32(" ".join(words[x] for x in at).encode())
    assert w.pairs(i, j).tolist() == [crc(a, b) for a, b in zip(i, j)]
    assert w.triples(i, j, k).tolist() == [crc(a, b, c) for a, b, c in zip(i, j, k)]


def test_word_codes_and_batches():
    texts = pa.array(["One two", None, "", "TWO--one", "9"])
    d, code, first = terms.word_codes(terms.mapped(texts, terms.byte_table(digits=False)))
    assert [d[int(c)].as_py() for c in code] == ["one", "two", "two", "one"] and first.tolist() == [0, 2, 2, 2, 4, 4]
    made = pa.RecordBatch.from_arrays([texts], ["t"]), pa.RecordBatch.from_arrays([texts.slice(0, 0)], ["t"])
    assert [b.num_rows for b in terms.gathered(iter([made[0]] * 5 + [made[1]]), 60)] and sum(b.num_rows for b in terms.gathered(iter([made[0]] * 5), 60)) == 25
    assert list(terms.gathered(iter([made[1]]), 60)) == []
