"""The corpus operators on the given tables: one thin query per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import new_path, stored
from . import bpe, dimension_scan, divergence, edit_embedding, host_words, line_dedup, mixing, ngram_join, ppm, quality, resampling, rollups, toxicity
from .base import fold, ready, table

MIX = {"good": 0.85, "low": 0.1, "toxic": 0.05}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ready(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return add


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    """Toxicity of every document; the lexicon is learned from labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn_lexicon(docs, table(spark, sf_dir, "labels"), held_out=1, folds=3)
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_words", "terms",
    )


# Lines are compared at code-point level by cutting the line at every position.
LINE_SQL = """
WITH occ AS (
  SELECT doc_id, no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents
  ) WHERE length(line) >= 20
), firsts AS (
  SELECT line, length(line) AS n, min((doc_id, no)) AS pos FROM occ GROUP BY line
), halves AS (
  SELECT line, n, pos, h, side, CASE WHEN side = 0 THEN left(line, h) ELSE right(line, h) END AS half
  FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM firsts), (SELECT unnest([0, 1]) AS side)
), pairs AS (
  SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS m
  FROM halves a JOIN halves b ON a.h = b.h AND a.side = b.side AND a.half = b.half AND b.pos < a.pos AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT line FROM pairs WHERE len(list_filter(range(0, greatest(n, m)), lambda p:
    CASE WHEN n = m THEN left(line, p) = left(other, p) AND substr(line, p + 2) = substr(other, p + 2)
         WHEN n > m THEN left(line, p) = left(other, p) AND substr(line, p + 2) = substr(other, p + 1)
         ELSE left(line, p) = left(other, p) AND substr(line, p + 1) = substr(other, p + 2) END)) > 0
), gone AS (
  SELECT occ.doc_id, count(*) AS n_removed, sum(length(occ.line)) AS chars_removed
  FROM occ JOIN firsts f ON f.line = occ.line LEFT JOIN near ON near.line = occ.line
  WHERE near.line IS NOT NULL OR (occ.doc_id, occ.no) > f.pos GROUP BY occ.doc_id
)
"""


@query("op6_line_dedup", LINE_SQL + """
, kept AS (
  SELECT d.doc_id, string_agg(line, chr(10) ORDER BY d.no) AS text, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents) d
  LEFT JOIN (SELECT occ.doc_id, occ.no FROM occ JOIN firsts f ON f.line = occ.line LEFT JOIN near ON near.line = occ.line
             WHERE near.line IS NOT NULL OR (occ.doc_id, occ.no) > f.pos) g ON g.doc_id = d.doc_id AND g.no = d.no
  WHERE g.doc_id IS NULL GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
       sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
""")
def op6_line_dedup(spark, sf_dir):
    """Per document: lines before and after the dedup, and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    done = line_dedup.dedup_lines(docs)
    lines = lambda c: F.coalesce(F.size(F.split(c, "\n", -1)), F.lit(0)).cast("bigint")
    n = lines("before")
    kept = F.when((F.col("text") == "") & (F.col("before") != ""), F.lit(0).cast("bigint")).otherwise(lines("text"))
    return done.select("doc_id", n.alias("n_lines"), kept.alias("n_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op9_ngram_jaccard", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), entries AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM entries a JOIN entries b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common WHERE 100 * i >= 75 * (nx + ny - i)
), steps AS (
  SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.a, s.b FROM reach r JOIN steps s ON s.a = r.b
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN low ON low.a = doc_id
""")
def op9_ngram_jaccard(spark, sf_dir):
    """Set size and component of every document under 5-word shingles and a Jaccard similarity of 0.75."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=5, threshold=75)


@query("op1_mixing")
def op1_mixing(spark, sf_dir):
    """Rate of every document that brings the expected token totals of its domains to the target weights."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rates, model, _ = mixing.mixing_rates(docs, mixing.label_domains(labels), MIX)
    member = [F.get("posteriors", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rates.select("doc_id", "n_tokens", *member, "rate")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    """Token count and digests of the ids and of the decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op5_dimension_scan")
def op5_dimension_scan(spark, sf_dir):
    """The five nearest vectors by cosine for every row whose vec_id is divisible by 50."""
    return dimension_scan.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query("op3_host_words")
def op3_host_words(spark, sf_dir):
    """Verdict on every page's URL: its longest rule's, else the classifier's."""
    return host_words.judge(table(spark, sf_dir, "pages"))


@query("op8_token_rollup")
def op8_token_rollup(spark, sf_dir):
    """Token totals by source, language and tokenizer version after three batches: all documents come,
    those with runs of blanks are counted again without them, later copies of equal texts go. One batch is
    delivered twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    versions = {"byte_bpe_50k": bpe.load_vocabulary(vocabulary_path()), "bytes": None}
    counted = stored(rollups.count_tokens(docs, versions), "counts")
    plain = F.regexp_replace("text", r"[ \t]+", " ")
    revised = docs.where(F.col("text").rlike(r"\t|  ")).withColumn("text", plain)
    after = stored(rollups.count_tokens(revised, versions), "counts")
    rollup = rollups.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("insert", rollups.changes(inserted=counted))
    revise = rollups.changes(inserted=after, deleted=counted.join(after.select("doc_id").distinct(), "doc_id", "left_semi"))
    rollup.commit("revise", revise)
    same = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    first = same.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stored(same.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id"), "copies")
    now = counted.join(after.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(after)
    rollup.commit("delete", rollups.changes(deleted=now.join(copies, "doc_id", "left_semi")))
    rollup.commit("revise", revise)
    return rollup.totals()


@query("op2_edit_embedding")
def op2_edit_embedding(spark, sf_dir):
    """Fingerprints of every document and of its text edited with the next document's, and their likeness."""
    return edit_embedding.compare_with_next(table(spark, sf_dir, "documents"))


@query("op4_ppm")
def op4_ppm(spark, sf_dir):
    """Log10 probability of every document under the trained model, and under the unigram model."""
    return ppm.train_and_score(table(spark, sf_dir, "documents"), held_out=2, folds=7)


UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


@query("op13_quality_rules", rf"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM (
    SELECT *, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w3 FROM words) WHERE w3 IS NOT NULL
), repeated AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM windows WHERE c > 1) GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (translate(w, {UPPER}) IN ({STOPS})) AS n_stop_words FROM words GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (regexp_matches(line, '^ *[-*\x{{2022}}\x{{2023}}\x{{25CF}}]')) AS n_bullet_lines, count(*) FILTER (regexp_matches(line, '(\.\.\.|\x{{2026}}) *$')) AS n_ellipsis_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), measured AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
  FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 300 * n_words AND 1000 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * n_stop_words >= 2 * n_words
       AND 100 * n_dup_lines <= 30 * n_lines AND 100 * n_bullet_lines <= 90 * n_lines AND 100 * n_ellipsis_lines <= 30 * n_lines AS kept
FROM judged
""")
def op13_quality_rules(spark, sf_dir):
    """Measures and verdict of every document under the base rules and the threshold table."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op12_source_divergence", rf"""
WITH docs AS (
  SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), occ AS (
  SELECT no, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term FROM (SELECT DISTINCT no, lang, term FROM occ) GROUP BY ALL HAVING count(*) >= 10
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT g.lang, g.source, coalesce(s.total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source LEFT JOIN sizes ON sizes.lang = g.lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL)
  JOIN (SELECT lang, sum(n) AS total FROM counted GROUP BY lang) USING (lang) JOIN sizes USING (lang)
), priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN priced p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM shares s JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark, sf_dir):
    """Distances between the sources of each language, and the terms that each uses most above its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op11_importance_resampling", rf"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8
), texts AS (
  SELECT 'd' AS part, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark
), listed AS (
  SELECT part, id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), placed AS (
  SELECT part, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM listed
), followed AS (
  SELECT part, id, w, w || ' ' || lead(w, 1) OVER o AS w2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY part, id ORDER BY i)
), features AS (
  SELECT part, id, f, count(*) AS n FROM (SELECT part, id, unnest([w, w2, w3]) AS f FROM followed) WHERE f IS NOT NULL GROUP BY ALL
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda j: CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT))),
                            lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)), crc
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (part = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (part = 'b'), 0)::DOUBLE AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), totals AS (
  SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM buckets, totals
), weights AS (
  SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE part = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM listed LEFT JOIN weights USING (id) WHERE part = 'd'
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM ranked) THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
""")
def op11_importance_resampling(spark, sf_dir):
    """Weight and score of every document towards the benchmark texts, and the rank of the 5 % drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
