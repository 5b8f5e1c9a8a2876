from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import langid
from wardline.llm.queries import QUERIES

from .cases import SF_DIR, documents, table


def test_held_out_accuracy(spark):
    rows = QUERIES["op5_language"](spark, SF_DIR).join(table(spark, "documents").select("doc_id", "lang"), "doc_id")
    got = rows.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert got[0] >= 0.95 and got[1] > 10


def brute(scores, penalty):
    """Best path by the plain recurrence."""
    best, back = [list(scores[0])], []
    for s in scores[1:]:
        top = max(range(len(s)), key=lambda j: (best[-1][j], -j))
        back.append([j if best[-1][j] >= best[-1][top] - penalty else top for j in range(len(s))])
        best.append([best[-1][back[-1][j]] - (penalty if back[-1][j] != j else 0) + s[j] for j in range(len(s))])
    path = [int(np.argmax(best[-1]))]
    for row in reversed(back):
        path.append(row[path[-1]])
    return path[::-1]


def test_viterbi_as_plain_recurrence():
    rng = np.random.default_rng(5)
    sizes = [0, 1, 7, 0, 40, 3, 200]
    first = np.cumsum([0, *sizes])
    scores = (-rng.integers(0, 64, (first[-1], 3)) / 8).astype(np.float32)
    got = langid.viterbi(scores, first, 2.0)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert got[a:b].tolist() == brute(scores[a:b].tolist(), 2.0)


def test_cases(spark):
    model = langid.train(table(spark, "documents"))
    rows = documents(spark).withColumn("score", F.lit("clash"))
    got = langid.identify(rows, model).collect()
    assert len(got) == rows.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1 and (letters or r.score == 0)
    assert langid.identify(rows.limit(0), model).count() == 0
    nothing = langid.train(rows.limit(0))
    assert {r.lang_pred for r in langid.identify(rows, nothing).collect()} == {"und"}


def test_mixed_text(spark):
    both = table(spark, "documents").filter("lang in ('de', 'es') and length(text) > 1500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("t")).orderBy("lang")
    de, es = (r.t[:1200] for r in both.collect())
    model = langid.train(table(spark, "documents"))
    rows = spark.createDataFrame([(1, de + "\n" + es)], "doc_id long, text string")
    spans = langid.identify(rows, model).first().spans
    assert [s.lang for s in spans] == ["de", "es"]


def test_scripts_narrow(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en")] * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    new = spark.createDataFrame([(1, "щука"), (2, "zebra")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(new, model).collect()} == {1: "ru", 2: "en"}


TEXTS = ["Hello hello привет 中文 a☃b × ÷×", "ß", "", "zebra привет 北京 hello Ж1ж 😀 日本語", "ab☃ ÀÉ zebra", "x" * 3000 + " hello"]


def slice_of(texts):
    data = [t.encode() for t in texts]
    return langid.Slice(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def words_of(part):
    return [part.words.data[a:b].tobytes().decode() for a, b in zip(part.words.starts, part.words.ends)]


def test_letters_and_scripts_as_plainly_read():
    part = slice_of(TEXTS)
    letters, script = part.words.letters()
    for word, n, name in zip(words_of(part), letters, script):
        own = [c for c in word if c.isalpha()]
        first = ord(own[0]) if own and not any(c.isascii() for c in own) else 0
        assert n == len(own) and langid.NAMES[name] == [s for a, s in langid.SCRIPTS if a <= first][-1]


def test_words_of_many_slices_are_taken_apart_once(monkeypatch):
    def model_of(waiting):
        monkeypatch.setattr(langid, "WAITING_WORDS", waiting)
        counter, apart = langid.Counter(2), []
        grams = langid.Words.grams
        monkeypatch.setattr(langid.Words, "grams", lambda words: (apart.append(len(words.starts)), grams(words))[1])
        for i, text in enumerate(TEXTS * 3):
            if text:
                counter.add(slice_of([text]), np.array([i % 2]))
        counter.count()
        monkeypatch.setattr(langid.Words, "grams", grams)
        return counter.total, sum(apart)

    (one, many), (all_, once) = model_of(1), model_of(1 << 19)
    distinct = len(slice_of(TEXTS).hashes)
    assert (one == all_).all() and once == distinct < many
    held = Counter()
    for i, text in enumerate(TEXTS * 3):
        if text:
            part = slice_of([text])
            held[i % 2] += int(part.words.letters()[0][part.word].sum())
    assert all_[:, 1 << langid.LOG2_GRAMS :].sum(axis=1).tolist() == [held[0], held[1]]

    model = langid.Model(["a", "b"], all_[:, : 1 << langid.LOG2_GRAMS].T, all_[:, 1 << langid.LOG2_GRAMS :].T)
    scored, scores = Counter(), model.scores
    monkeypatch.setattr(model, "scores", lambda words, *of: (scored.update(range(len(words.starts))), scores(words, *of))[1])
    for text in TEXTS * 2:
        part = slice_of([text])
        letters, got = model.lookup(part)
        assert (got == scores(part.words, *part.words.letters())).all() and (letters == part.words.letters()[0]).all()
    assert sum(scored.values()) == distinct
