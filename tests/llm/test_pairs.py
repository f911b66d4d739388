import re
from collections import defaultdict

import numpy as np
import pytest

from gleanworks.llm import neardup, vectorjoin


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def documents():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(40):
        base = list(rng.choice(words, int(rng.integers(3, 120))))
        for _ in range(int(rng.integers(1, 7))):
            own = list(base)
            for _ in range(int(rng.integers(0, max(2, len(own) // 10)))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            rows.append(" ".join(own))
    rows += ["copy of one text"] * 30 + ["Copy OF one\ttext", "a", "a", "A b", "", None]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("k", "block"), [(2, 2048), (5, 4)])
def test_near_duplicates_equal_brute_force(spark, k, block):
    rows = documents()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rep int").repartition(3)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, neardup.Settings(words=k, block=block)).collect()}
    sets = {i: shingle_set(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_one_id_with_several_texts_links_by_each(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    near = [(2, one.replace("p30", "zzz")), (3, other.replace("q30", "zzz"))]
    rows = [(1, one), (1, other), *near, (7, "a text of its own, and a long one"), (7, one), (8, None), (8, other), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in neardup.near_duplicates(docs).collect())
    assert [(i, c, k) for i, c, k, _ in got] == [(i, 1 if i < 9 else 9, i in (1, 9)) for i, _ in sorted(rows, key=lambda r: r[0])]
    assert [n for i, _, _, n in got if i == 7] == [5, 56]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_of_repeated_ids_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    texts = [t for _, t in documents()]
    rows = [(int(rng.integers(len(texts))), texts[k]) for k in rng.permutation(len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(docs, neardup.Settings(words=2, block=8)).collect()
    sets = [(i, shingle_set(t, 2)) for i, t in rows]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and 100 * len(x & y) >= 80 * len(x | y)]
    want = components({i for i, _ in rows}, links)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((i, len(x), want[i], want[i] == i) for i, x in sets)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.component_id, r.kept))
    assert by[1] == [(1, True)] and by[2] == [(1, False)] and by[9] == [(9, True)] * 2 and by[None] == [(None, True)]
    assert all(by[i] == [(i, True)] for i in (3, 4, 5, 6, 7, 8, 10))
    assert neardup.near_duplicates(no_docs).count() == 0


def test_sketches_merge_and_estimate():
    settings = neardup.Settings()
    draws = neardup._draws(settings)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    a, b = x[:2000], x[500:2500]
    one, other = (neardup.registers(s, draws, settings) for s in (a, b))
    both = neardup.registers(np.unique(np.concatenate([a, b])), draws, settings)
    assert (np.maximum(one, other) == both).all()
    slope = lambda j: neardup.likelihood_slope(*(np.array([v]) for v in ((one > other).sum(), (one < other).sum(), (one == other).sum(), 2000.0, 2000.0)), j, settings.base)[0]
    assert slope(0.45) > 0 > slope(0.75)  # the true similarity is 0.6


# ------------------------------------------------------------------ op3


def brute(rows, least=0.93):
    valid = [r for r in rows if None not in r[:2] and r[2] and all(c is not None and np.isfinite(c) for c in r[2]) and any(r[2])]
    links = set()
    for i, a in enumerate(valid):
        for b in valid[i + 1 :]:
            if a[1] == b[1] and len(a[2]) == len(b[2]) and a[0] != b[0]:
                x, y = np.array(a[2], float), np.array(b[2], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.add((a[0], b[0]))
    nodes = {r[0] for r in rows if r[0] is not None}
    root = components(nodes, links)
    return {n: (sum(n in pair for pair in links), root[n]) for n in nodes}


@pytest.mark.parametrize("settings", [vectorjoin.Settings(), vectorjoin.Settings(per_pivot=30, block=16), vectorjoin.Settings(per_pivot=9, pivots=3, block=40)])
def test_vector_join_equals_brute_force(spark, settings):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, i % 2 if i % 50 else None, (centres[i % 12] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[5][2]) for i in range(20)]
    rows += [(2000, 1, None), (2001, 1, [0.0] * 8), (2002, 1, [None] * 8), (2003, 1, [float("nan")] * 8), (2004, 1, [float("inf")] * 8), (2005, 1, [1.0, 0.0]), (2006, 1, [1.0, 0.01]), (2007, 1, [])]
    table = spark.createDataFrame([(*r, 3) for r in rows] + [(None, 1, rows[5][2], 3)], "vec_id long, label int, embedding array<float>, cell int")
    got = vectorjoin.link_vectors(table, settings).collect()
    assert len(got) == len(rows) + 1
    want = brute([(r.vec_id, r.label, r.embedding) for r in table.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vectorjoin.link_vectors(table.where("false")).count() == 0


def test_pivots_prune_what_lies_apart():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    x = centres[rng.integers(10, size=500)] + rng.normal(size=(500, 32)) * 0.02
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    radius = vectorjoin.Settings().radius
    pivots = vectorjoin.choose_pivots(x, 10, radius)
    d = vectorjoin._distances(x, pivots)
    cells = vectorjoin.cells_of(d, radius)
    near = vectorjoin.cells_near(d, cells, pivots, radius)
    assert near[np.arange(500), cells].all()
    held = np.bincount(cells, minlength=20)
    assert (near * held[None]).sum() <= 0.2 * 500 * 500


@pytest.mark.parametrize("seed", range(5))
def test_rings_never_hide_a_partner(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 6))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    radius = vectorjoin.Settings().radius
    pivots = vectorjoin.choose_pivots(x[:60], 12, radius)
    d = vectorjoin._distances(x, pivots)
    cells = vectorjoin.cells_of(d, radius)
    near = vectorjoin.cells_near(d, cells, pivots, radius)
    for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
        assert near[a, cells[b]]
    assert not near.all()
