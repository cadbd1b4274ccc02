"""The pipeline against a plain version of its stages."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from labelmx.llm import mixing, toxicity
from labelmx.llm.queries import MIX, vocabulary_path

from test_operators import VOCABULARY, edits, prose, roots, shingle_set


@pytest.fixture(scope="module")
def folder(tmp_path_factory, frame, labels):
    rng = random.Random(11)
    rows, marks = [], []
    line = "This line of text comes back in many documents"
    for i in range(90):
        words = prose(rng, 40).split()
        if i % 6 == 0:
            words.insert(5, "blarg")
        rows.append((i, " ".join(words) + ("\n" + line if i % 4 == 1 else "")))
        marks.append((i, int(i % 5 > 0), int(i % 6 == 0), "x"))
    rows += [(200, rows[1][1]), (201, rows[2][1] + " more"), (202, None), (203, "")]
    path = tmp_path_factory.mktemp("tables")
    frame(rows).write.parquet(f"{path}/documents.parquet")
    labels(marks).write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline(spark, folder):
    from tokenizers import Tokenizer

    path, rows = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    lexicon = toxicity.learn_lexicon(docs, labels)
    bad = {r.doc_id for r in toxicity.score(docs, lexicon).collect() if r.score >= 0.7}
    assert bad == {i for i in range(90) if i % 6 == 0}
    kept = {i: t for i, t in rows if i not in bad}
    first = {}
    for i, t in sorted(kept.items()):
        for no, x in enumerate((t or "").split("\n")):
            if len(x) >= 20:
                first.setdefault(x, (i, no))
    near = {x for x in first if any(first[y] < first[x] and abs(len(x) - len(y)) < 2 and edits(x, y) == 1 for y in first)}
    kept = {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if len(x) < 20 or (x not in near and first[x] == (i, no))) for i, t in kept.items()}
    sets = {i: shingle_set(t) for i, t in kept.items()}
    top = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    kept = {i: t for i, t in kept.items() if top[i] == i}
    left = spark.createDataFrame(list(kept.items()), "doc_id bigint, text string")
    copies = Counter(r.doc_id for r in mixing.mix(left, mixing.label_domains(labels), MIX).collect())
    plain = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for i, n in copies.items():
        ids = plain.encode(kept[i] or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) == want


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), path).count() == 0
