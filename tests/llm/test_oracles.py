"""The queries that SQL can express, decontamination and quality cases, and the pipeline."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import check_oracle
import corpus_pipeline
from wardline.llm import bpe, decontam, pii, quality, substring
from wardline.llm.queries import ORACLES, QUERIES

from .cases import DOCUMENT, SF_DIR, documents, table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = check_oracle.connect(SF_DIR).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert check_oracle.normalized(df.columns, [tuple(r) for r in df.collect()]) == check_oracle.normalized(columns, cursor.fetchall())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    wins = [(str(i) if i is not None else "", w[s : s + 10]) for i, t in items for w in [words(t)] if w for s in range(max(1, len(w) - 9))]
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for item, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    own.add(item)
        out.append(((d is None, d or 0), len(w), len(hit), sorted(own)))
    return sorted(out)


def found(docs, items):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, items).collect())


ITEMS = [
    (1, "the same words twice the same words twice"), (2, "one"), (3, None), (4, "... !!"), (None, "another text of id five"),
    (5, "der lange text mit vielen worten 4111 1111 1111 1111 geht weiter der lange"), (5, "no ID at all"), (6, "漢字かな Привет мир"),
    (7, "never seen anywhere"), (8, "twice the same"),
]


def test_contamination_as_brute_force(spark):
    docs = documents(spark).withColumns({"key": F.lit(1), "items": F.lit(1), "word": F.lit("w")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("start", F.lit(0))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, items) == brute(rows, ITEMS)
    assert found(docs, items.limit(0)) == brute(rows, [])
    assert found(docs.limit(0), items) == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y"), (2, "alpha x x x x x x x beta"), (3, "beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    rows = decontam.proximity_matches(*decontam.index_for(docs, items), slop=2).collect()
    assert [(r["item"], r.key.split("-")[0]) for r in rows] == [("1", "1")]


GRADE = "case when toxic > 0 then 0 when quality > 0 then 2 else 1 end"


def test_proximity_with_absent_terms_and_other_sizes(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y"), (2, "alpha " + "x " * 30 + "beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta zeta"), (2, "alpha " + "q " * 28 + "beta")], "item_id long, text string")
    near = lambda size: sorted((r["item"], r.key.split("-")[0]) for r in decontam.proximity_matches(*decontam.index_for(docs, items, size), slop=2).collect())
    assert near(30) == [("1", "1"), ("2", "2")]
    assert near(10) == [("1", "1")]
    assert decontam.proximity_matches(*decontam.index_for(docs, items.limit(0))).count() == 0


CLASH = {"_key": "clash", "_text": "clash", "key": "clash", "own_text": "clash", "_runs": "clash", "runs": "clash", "_bin": "clash", "bin": "clash"}


def test_clashing_columns_stay(spark):
    docs = documents(spark).withColumns({c: F.lit(v) for c, v in CLASH.items()})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    spans = pii.personal_spans(docs)
    results = [
        bpe.encode(docs, chunk=500, overlap=100), decontam.contamination(docs, items), pii.attach_spans(docs, spans), pii.redacted(docs, spans),
        substring.without_repeats(docs),
    ]
    for out in results:
        rows = out.collect()
        assert len(rows) == docs.count() and all(r[c] == v for r in rows for c, v in CLASH.items())


def test_quality_order(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels").withColumn("grade", F.expr(GRADE))
    model = quality.fit(docs, labels, 3)
    assert list(model.cuts) == sorted(model.cuts)
    graded = quality.grade_texts(docs.join(labels, "doc_id"), model)
    means = {r.grade: r.m for r in graded.groupBy("grade").agg(F.avg("expected_grade").alias("m")).collect()}
    assert means[2] > max(means[g] for g in means if g < 2)


def plain_scores(texts, model):
    """Expected grade and tails of each text, one feature after the other."""
    out = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        slots, _ = quality.features(data, np.array([0, len(data)]))
        score = sum(float(model.weights[s]) for s in slots.tolist())
        tails = [1 / (1 + math.exp(-min(max(score - c, -30), 30))) for c in model.cuts]
        out.append((sum(tails), tails))
    return out


def test_quality_scores_as_plain_version(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels").withColumn("grade", F.expr(GRADE))
    model = quality.fit(docs, labels, 3)
    rows = quality.grade_texts(docs, model).collect()
    for r, (grade, tails) in zip(rows, plain_scores([r.text for r in rows], model)):
        assert r.expected_grade == pytest.approx(grade, abs=1e-4) and r.tails == pytest.approx(tails, abs=1e-4)
    assert all(r.tails == sorted(r.tails, reverse=True) for r in rows)


def test_likelihood_slopes():
    rng = np.random.default_rng(4)
    score, grade, cuts = rng.normal(size=40), rng.integers(0, 4, 40), np.array([-1.0, 0.2, 1.5])
    value, in_score, in_cuts = quality.likelihood(score, grade, cuts)
    shares = np.stack([np.exp(quality.likelihood(score, np.full(40, g), cuts)[0]) for g in range(4)])
    assert np.allclose(shares.sum(axis=0), 1) and np.allclose(np.exp(value), shares[grade, np.arange(40)])
    step = 1e-6
    assert np.allclose((quality.likelihood(score + step, grade, cuts)[0] - value) / step, in_score, atol=1e-4)
    for j in range(3):
        moved = cuts + step * (np.arange(3) == j)
        assert np.allclose((quality.likelihood(score, grade, moved)[0] - value) / step, in_cuts[:, j], atol=1e-4)


def test_quality_of_few_rows(spark):
    texts = [(i, ("good words here " if i % 2 else "bad stuff there ") * 3) for i in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as grade")
    rows = quality.grade_texts(docs, quality.fit(docs, labels, 2)).collect()
    assert all((r.tails[0] > 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_quality_sample(spark):
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 3 as int) as grade")
    picked = quality.chosen(labels.unionByName(labels), 3, "doc_id", "grade", 100).collect()
    want = labels.selectExpr("doc_id", "grade", "xxhash64(doc_id, grade) as h").orderBy("h").limit(100).collect()
    whole = labels.selectExpr("doc_id", "grade", "shiftrightunsigned(xxhash64(doc_id, grade), 1) as h").collect()
    assert len(picked) == 100 == len(set(picked))
    assert len(want) == 100 and {r.key for r in picked} <= {r.doc_id for r in sorted(whole, key=lambda r: r.h)[:170]}


def test_quality_cases(spark):
    rows = documents(spark).withColumns({"grade": F.lit(0), "tails": F.lit("clash")})
    flat = quality.fit(rows, rows, 3)
    assert quality.grade_texts(rows, flat).filter("expected_grade between 0 and 2").count() == rows.count()
    none = quality.fit(rows, rows.limit(0), 3)
    assert quality.grade_texts(rows, none).count() == rows.count()
    assert quality.grade_texts(rows.limit(0), none).count() == 0


def test_language_without_labels(spark):
    docs = documents(spark, lang=None).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, SF_DIR)
    assert kept.count() == docs.filter("text rlike '[a-zA-Z]'").count()


def test_near_duplicates_with_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "x"]
    other = [f"v{i}" for i in range(40)]
    rows = [(None, words), (None, near), (5, words), (5, other), (2, near), (2, near), (None, None), (7, [])]
    docs = spark.createDataFrame([(i, " ".join(t) if t is not None else None, None, "s", 1) for i, t in rows], DOCUMENT)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF_DIR).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in kept)
    assert got == sorted([(False, 2, " ".join(near), False), (False, 5, " ".join(other), False), (True, 0, "", True), (False, 7, "", False)])


def test_pipeline(spark):
    docs, kept = table(spark, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR).cache()
        assert out.columns == corpus_pipeline.COLUMNS
        kept.append(out.count())
        assert out.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = out
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    run = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(tuple, final)) == sorted(map(tuple, run)) and len(run) == kept[-1]
    # brute force over what the first stage kept: one document of each group, none that holds a window
    first = corpus_pipeline.language(spark, table(spark, "documents"), SF_DIR)
    left = {r.doc_id for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]
    texts = [(r.doc_id, r.text) for r in first.collect()]
    hit = {d for (_, d), _, n, _ in brute(texts, items) if n}
    from .test_pairs import brute_components

    heads = {d for (_, d), _, name in brute_components(texts) if name == d}
    assert left == heads - hit


def test_pipeline_takes_nulls(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR).cache()
    assert docs.count() > 0
