import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import ann, graph, hashing, jaccard, substring
from wardline.llm.queries import QUERIES

from .cases import SF_DIR, documents, table


def words(text, fold):
    text = text or ""
    if fold:
        text = "".join(c.lower() if c.isascii() else c for c in text)
    return text.encode().split()


def brute_sets(texts):
    out = []
    for t in texts:
        w = words(t, True)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(rows):
    """doc_id -> (set size, smallest id); rows: (doc_id, text)."""
    sets = brute_sets([t for _, t in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    names = {}
    for (doc_id, _), x in zip(rows, label):
        if doc_id is not None:
            names[x] = min(doc_id, names.get(x, doc_id))
    return sorted(((d is None, d or 0), len(s), names.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label))


def family(rng, base, count, edits):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(0, len(w))] = f"new{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def jaccard_rows(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [vocabulary[i] for i in rng.integers(0, 400, n)]
    passage = make(30)
    texts = []
    for n, count, edits in ((60, 40, 4), (200, 25, 9), (8, 10, 1), (30, 30, 2)):
        texts += family(rng, make(n), count, edits)
    texts += [" ".join(passage + make(int(n))) for n in rng.integers(1, 40, 60)]
    texts += [texts[0]] * 3 + [None, "", "one", "one", "two words", "TWO words"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)] + [(None, texts[0]), (None, "")]


def test_components_as_brute_force(spark):
    rows = jaccard_rows()
    found = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_tiles_find_what_stars_miss(spark, monkeypatch):
    """Without stars, and with blocks of three classes, the tiles alone find every link."""
    monkeypatch.setattr(jaccard, "star_pairs", lambda classes: classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = jaccard_rows(2)
    found = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == brute_components(rows)


def test_jaccard_cases(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = jaccard.similarity_components(documents(spark)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in found) == brute_components(rows)
    assert jaccard.similarity_components(documents(spark).limit(0)).count() == 0


def brute_links(rows):
    """Linked pairs of classes by name, and doc_id -> (name of the class, number of linked rows)."""
    sets = [frozenset(s) for s in brute_sets([t for _, t in rows])]
    link = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    many, names = {}, {}
    for (d, _), s in zip(rows, sets):
        many[s] = many.get(s, 0) + 1
        names[s] = min((x for x in (d, names.get(s)) if x is not None), default=None)
    kinds = list(many)
    near = {x: [y for y in kinds if y is not x and link(x, y)] for x in kinds}
    pairs = sorted(tuple(sorted((names[x], names[y]))) for i, x in enumerate(kinds) for y in kinds[:i] if link(x, y))
    members = [((d is None, d or 0), names[s] if s else d, many[s] - 1 + sum(many[y] for y in near[s]) if s else 0) for (d, _), s in zip(rows, sets)]
    return pairs, sorted(members, key=str)


@pytest.mark.parametrize("cell", [3, 256])
def test_links_inside_components_as_brute_force(spark, monkeypatch, cell):
    """Every link of two texts counts, also between members of one family."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    rows = jaccard_rows(3)
    pairs, members = jaccard.similarity_links(spark.createDataFrame(rows, "doc_id long, text string"))
    want_pairs, want_members = brute_links(rows)
    assert sorted(map(tuple, pairs.collect())) == want_pairs and len(want_pairs) > 100
    members = members.collect()
    assert sorted((((r.doc_id is None, r.doc_id or 0), r.class_id, r.n_links) for r in members), key=str) == want_members
    got = sorted((((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in members), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_links_of_nothing(spark):
    pairs, members = jaccard.similarity_links(documents(spark).limit(0))
    assert pairs.count() == members.count() == 0


def test_bits_bound_overlap():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 700):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(0.9 * n)], rng.integers(0, 2**63, max(1, n // 9)).astype(np.uint64)]))
        a, b = (np.frombuffer(jaccard.signature(s), np.uint8) for s in (x, y))
        width = min(len(a), len(b))
        common = len(np.intersect1d(x, y))
        differ = jaccard.difference(jaccard.folded(a, width), jaccard.folded(b, width))
        assert common <= (len(x) + len(y) - differ) / 2


def test_bands_hold_all_sizes_that_link():
    sizes = np.arange(1, 3000)
    band = jaccard.band_of(sizes)
    for n in sizes[:2000:7]:
        top = n * 100 // jaccard.PERCENT
        assert band[top - 1] - band[n - 1] <= 1 or top >= 3000


def test_graph(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(i, i + 1) for i in range(100, 160)]
    root = {}
    for a, b in pairs:
        for x in (a, b):
            root.setdefault(x, x)
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: root[x] for x in linked}


def brute_removed(rows, window):
    seen = {}
    texts = [words(t, False) for _, t in rows]
    for w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(((d is None, d or 0), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("window", [35, 21, 50])
def test_repeats_as_brute_force(spark, window):
    rng = np.random.default_rng(window)
    make = lambda n: [f"v{i}" for i in rng.integers(0, 3000, n)]
    passages = [make(int(n)) for n in rng.integers(window - 2, window + 30, 12)]
    rows = []
    for i in range(120):
        text = make(int(rng.integers(0, 90)))
        for p in rng.integers(0, 12, rng.integers(0, 4)):
            at = rng.integers(0, len(text) + 1)
            text[at:at] = passages[p]
        rows.append((i, "  ".join(text)))
    rows += [(200, None), (201, ""), (202, "a " * 300), (203, rows[5][1]), (203, rows[5][1]), (None, rows[6][1])]
    found = substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in found) == brute_removed(rows, window)


def test_repeats_cases(spark):
    rows = documents(spark).withColumns({"kept": F.lit(1), "bin": F.lit(1), "key": F.lit("k")})
    found = substring.without_repeats(rows).collect()
    want = brute_removed([(r.doc_id, r.text) for r in rows.collect()], 35)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept) for r in found) == want
    assert {"bin", "key", "lang"} <= set(found[0].asDict())
    assert substring.without_repeats(rows.limit(0)).count() == 0


def test_cover_holds_all_differences():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_hashes_of_words(monkeypatch):
    text = "aa bb  aa\tcc " + "z" * 50 + " bb " + "z" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, first = hashing.spans(data, np.array([0, 5, len(data)]), hashing.WHITE)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split() and first.tolist() == [0, 2, 7]
    plain = hashing.word_hashes(data, starts, ends)
    monkeypatch.setattr(hashing, "PIECE", 16)
    monkeypatch.setattr(hashing, "_tables", {})
    small = hashing.word_hashes(data, starts, ends)
    assert plain.tolist() == small.tolist()
    assert len(set(plain.tolist())) == 4 and plain[0] == plain[2] and plain[4] == plain[6]


def brute_nearest(rows, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = next(x for i, x in ok if i == q)
        near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in ok if i != q)[:k]
        out += [(q, n + 1, i, s) for n, (s, i) in enumerate(near)]
    return out


def test_nearest_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, "embeddings").collect() if r.embedding is not None]
    found = {(r.query_id, r.vec_id): r.score for r in QUERIES["op4_nearest"](spark, SF_DIR).collect()}
    want = {(q, i): s for q, _, i, s in brute_nearest(rows, 10)}
    assert len(found) == len(want)
    same = set(found) & set(want)
    assert len(same) >= 0.9 * len(want)
    assert all(abs(found[x] - want[x]) < 1e-9 for x in same)


def test_nearest_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)] + [(100 + i, [3.0, 1.0]) for i in range(30)]
    rows += [(300, None), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [None, 1.0]), (800, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = ann.usable(df.withColumn("v", F.lit(0)))
    got = ann.neighbours(vectors.filter("vec_id % 100 = 0"), vectors, ann.fit(vectors)).collect()
    want = [x for x in brute_nearest(rows, 10) if x[0] != 800]
    assert sorted(map(tuple, got)) == sorted((q, n, i, s) for q, n, i, s in want)
    assert ann.fit(ann.usable(df.limit(0))) is None


def test_grouped_rows_are_padded():
    assert jaccard.node_of(np.zeros(0, np.uint64)) == 0
    assert [len(s) for _, s in jaccard.shingle_sets(pa.array([None, "", "a", "a b c d e", "a b c d e f"]))] == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("count", [1, 2, 7, 11])
def test_nearest_of_few_vectors(spark, count):
    rng = np.random.default_rng(count)
    rows = [(100 * i, rng.normal(size=4).round(3).tolist()) for i in range(count)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = ann.usable(df)
    got = ann.neighbours(vectors, vectors, ann.fit(vectors)).collect()
    assert sorted((q, n, i) for q, n, i, _ in got) == [(q, n, i) for q, n, i, _ in brute_nearest(rows, 10)]


def test_nearest_among_many_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = ann.usable(df)
    got = {(q, i) for q, _, i, _ in ann.neighbours(vectors.filter("vec_id % 100 = 0"), vectors, ann.fit(vectors)).collect()}
    want = {(q, i) for q, _, i, _ in brute_nearest(rows, 10)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_a_pair_comes_from_the_first_tile_it_shares():
    """Three classes in tiles of ten tokens; ``c`` shares only tokens behind its heads with the others."""
    tokens, rows = np.arange(1, 12), []
    heads = {1: tokens[:8], 2: tokens[1:9], 3: np.arange(50, 58)}
    held = {1: tokens, 2: tokens[1:], 3: [*heads[3], 10, 11]}
    for node, own in held.items():
        for token in own:
            rows.append((int(token), 5, 0, node, node, 20, int(token), bytes(8), heads[node].astype(np.int64).tobytes(), 5))
    names = ["place", "band", "side", "family", "node", "n", "token", "bits", "heads", "tile"]
    pairs, _ = jaccard._tile(pa.table(dict(zip(names, map(list, zip(*rows))))))
    pairs = [tuple(p) for p in pairs.tolist()]
    assert pairs.count((1, 2)) == 1
    assert set(pairs) == {(1, 2), (1, 3), (2, 3)}
