"""Search, mixing, language, quality, embeddings, the pipeline and the registered queries."""

import functools
import hashlib
import math
import random
import types
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.tables import CLASHES, documents, odd_rows
from tools.compare import compare, connect
from wellspark.llm import embeddings, language, mixing, quality, queries, topk

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, []).cache()


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("clash") for c in [*CLASHES, "vector", "dim", "gain", "copies", "at"] if c != "label"})


def odd_vectors(seed=1, n=300, d=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, d))
    rows = []
    for i in range(n):
        v = centres[r.integers(12)] + r.normal(size=d) * (0.05 if i % 2 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(3))))
    rows += [(1000 + i, rows[5][1], 0) for i in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * d, 1), (2003, [1.0, None] + [0.0] * (d - 2), 1), (2100, [float("nan")] * d, 1), (2200, [float("inf")] + [1.0] * (d - 1), 1)]
    return rows + [(2005, rows[5][1], None), (2300, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [1e30] * d, 1), (2009, [1e-30] * d, 1), (7, rows[7][1], rows[7][2]), (None, rows[5][1], 0)]


# --- search ---------------------------------------------------------------------------------------------------


def naive_top(rows, every=100, k=10):
    whole = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(1024 * x) for x in v]
    out = []
    for q in whole:
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rows = [r for r in odd_vectors() if r[0] not in (2008,)]
    got = topk.top_k(vectors(spark, rows), block=16, group=4)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == naive_top(rows)
    few = rows[100:104]
    assert sorted(map(tuple, topk.top_k(vectors(spark, few)).collect())) == naive_top(few)
    assert topk.top_k(vectors(spark, [])).count() == 0


def test_blocks_below_the_kth_score_are_not_scored():
    r = np.random.default_rng(4)
    centres = r.integers(-900, 900, (20, 32))
    vectors_ = np.repeat(centres, 64, axis=0) + r.integers(-9, 9, (1280, 32))
    ids = np.arange(1280)
    found, scored = topk.block_search(ids[:1], vectors_[:1], ids, vectors_, 10, {}, 64)
    want = sorted((-int(s), int(i)) for i, s in zip(ids[1:], vectors_[1:] @ vectors_[0]))[:10]
    assert [(-s, i) for _, i, s in found] == want and scored < 10


def test_queries_meet_all_groups_without_a_broadcast(spark, monkeypatch):
    plans, settle = [], topk.settle

    def watched(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, purpose)

    monkeypatch.setattr(topk, "settle", watched)
    rows = [r for r in odd_vectors() if r[0] not in (2008,)]
    for most in (64, 2):
        monkeypatch.setattr(topk, "COLUMNS", most)
        found = topk.top_k(vectors(spark, rows), block=4, group=4)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == naive_top(rows)
    assert any("MapInArrow" in p for p in plans) and not any("Broadcast" in p or "NestedLoop" in p for p in plans)


@pytest.mark.parametrize("wide", [1 << 10, 1 << 28])
def test_many_queries_search_blocks_as_one_by_one(wide):
    r = np.random.default_rng(8)
    vectors_ = np.repeat(r.integers(-wide, wide, (30, 8)), 20, axis=0) + r.integers(0, 3, (600, 8))
    vectors_[1::40] = vectors_[::40]
    ids = r.permutation(10_000)[:600]
    qids, queries_ = np.r_[ids[:150], -5], np.r_[vectors_[:150], -vectors_[:1]]
    scores = {int(q): sorted((-int(s), int(i)) for s, i in zip(vectors_ @ v, ids) if i != q) for q, v in zip(qids, queries_)}
    floors = {int(q): -scores[int(q)][20][0] for q in qids[:50]} | {int(qids[60]): 1 - scores[int(qids[60])][0][0]}
    found, _ = topk.block_search(qids, queries_, ids, vectors_, 10, floors, 16)
    want = {(q, i, -s) for q, best in scores.items() for s, i in best[:10] if -s >= floors.get(q, topk.NO_FLOOR)}
    assert len(found) == len(want) and set(map(tuple, found.tolist())) == want
    assert topk._same_width(queries_, vectors_)[0].dtype == (np.float64 if wide == 1 << 10 else np.int64)


@pytest.mark.parametrize("most", [0, 40, 40_000, 3_000_000_000, -(1 << 63)])
def test_packed_vectors_come_back(most):
    m = np.array([[most, -1, 2], [0, 5, -7]], np.int64)
    ids, back = topk._unpack(np.array([3, 4], np.int64).tobytes(), topk._narrow(m), 3)
    assert ids.tolist() == [3, 4] and back.tolist() == m.tolist()


# --- mixing ---------------------------------------------------------------------------------------------------


def naive_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > 2 * sizes[s] + 1e-9]
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def naive_mix(rows):
    """Words taken per (id, size, text) by a plain sort of all passes by finish time and a cut."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    sums = Counter()
    for (_, _, source), n in zip(rows, size):
        sums[source] += n
    target, reached, passes = naive_targets(dict(sums)), Counter(), []
    order = [hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest() for i, t, _ in rows]
    for k in sorted(range(len(rows)), key=lambda k: (str(rows[k][2]), order[k])):
        reached[rows[k][2]] += size[k]
        for e in (0, 1):
            if size[k]:
                source = rows[k][2]
                passes.append(((reached[source] + e * sums[source]) / target[source], "" if source is None else f"={source}", order[k], rows[k][0] is not None, rows[k][0] or 0, e, k))
    left, taken = math.floor(1.5 * sum(size)), Counter()
    for *_, k in sorted(passes):
        taken[k] += min(left, size[k])
        left -= min(left, size[k])
    return target, sums, [(rows[k][0], size[k], taken[k]) for k in range(len(rows))]


def check_mix(df):
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    target, sums, want = naive_mix(rows)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in got), key=str) == sorted(want, key=str)
    assert Counter((r.source_size, round(r.target, 6)) for r in got) == Counter((sums[s], round(target[s], 6)) for _, _, s in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and sum(r.taken for r in got) == math.floor(1.5 * sum(sums.values()))
    near, large = Counter(), Counter()
    for (_, n, t), (_, _, s) in zip(want, rows):
        near[s] += t
        large[s] = max(large[s], n)
    assert all(abs(near[s] - target[s]) <= large[s] for s in target)


def test_mix(spark, odd, empty):
    check_mix(odd)
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"))
    assert mixing.mix(empty).count() == 0
    assert [r.taken for r in mixing.mix(documents(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()] == [0, 0]


def test_the_mixed_documents_are_the_words_taken(spark, odd):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.encode().split())
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


# --- language -------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, odd, empty):
    got = language.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"} and all(r.lang_pred in {"en", "fr", "de", "es", "und"} for r in got)
    assert language.identify(empty).count() == 0
    assert [r.lang_pred for r in language.identify(documents(spark, [(1, "word", None, "a"), (2, "123 ½ _", "en", "a")])).collect()][1] == "und"


@pytest.mark.parametrize("one_id", [2, 3, 1, 4])
def test_many_texts_under_one_id_are_sampled_by_row(spark, one_id, monkeypatch):
    """3,000 texts of a labelled id, and one row a thousand times: the sample keeps its bound, and something is learned."""
    r = random.Random(1)
    stems = {"en": ["the", "and", "thing", "whole"], "fr": ["été", "que", "leur", "eaux"]}
    rows = [(one_id, " ".join(r.choice(stems[lang]) + r.choice("abc") for _ in range(12)), lang, "a") for lang in stems for _ in range(1500)]
    rows += [(one_id, "the same again", "en", "a")] * 1000
    seen = []
    fit = language.Model.fit
    monkeypatch.setattr(language.Model, "fit", lambda x, langs, names: seen.append(Counter(langs)) or fit(x, langs, names))
    got = language.identify(documents(spark, rows, clash=False), per_language=50).collect()
    if zlib.crc32(str(one_id).encode()) % 4 == 2:
        assert not seen and {x.lang_pred for x in got} == {"und"}
        return
    assert all(25 <= n <= 50 for n in seen[0].values()) and set(seen[0]) == {"en", "fr"}
    assert Counter(x.lang_pred for x in got) == Counter({"en": 2500, "fr": 1500})


def test_language_equals_a_plain_vote(spark):
    """The answer of every fifth document by plain sums: best family, then a vote of all pairs in it."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs, "doc_id", "text", "lang", 4, 2, 500, language.FAMILIES)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id % 5 == 0 and r.text and language.LETTER.search(r.text)}
    want = {}
    for i, text in texts.items():
        x = [float(v) for v in language.profiles(pa.array([text]))[0]]
        value = lambda w: sum(a * float(b) for a, b in zip(x, w)) + float(w[-1])
        family = max(zip(model.families, model.family_weights), key=lambda f: value(f[1]))[0] if len(model.families) > 1 else next(iter(model.families))
        votes = Counter({m: 0 for m in model.families[family]})
        for (a, b), w in model.pairs.items():
            if a in votes and b in votes:
                votes[a if value(w) >= 0 else b] += 1
        want[i] = [m for m in votes if votes[m] == max(votes.values())]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert len(want) > 30 and all(got[i] in best for i, best in want.items())


def test_profiles_do_not_cross_documents():
    import pyarrow as pa

    alone = np.vstack([language.profiles(pa.array([t])) for t in ("Ab cd", "", "É x")])
    assert np.allclose(alone, language.profiles(pa.array(["Ab cd", "", "É x"])))


# --- quality --------------------------------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_documents(docs, labels)
    rows = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.95
    assert sum(g >= 0.3 for g in good) >= 0.97 * len(good)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.doc_id for r in got.collect() if r.predicted == 1}


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, None), (7, 0, 0), (7, 1, 0), (8, None, 0), (9, 0, 1), (None, 1, 0), (12, 3, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.filter("false"), labels.filter("quality = 1")):
        got = quality.score_documents(odd, marks).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.keep_good(odd, labels.filter("false")).columns == odd.columns


def test_quality_equals_direct_normal_equations(spark):
    """Scores from one matrix of all labelled rows, solved at once, against those from partition sums."""
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    stats = {r.id: np.array(r.x) for r in quality.document_statistics(docs).collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and fold(r.doc_id) != 0 and r.doc_id in stats}
    known = sorted(y)
    x = np.array([stats[i] for i in known])
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = lambda rows: quality.fourier((np.array(rows) - mean) / spread, 11)
    fit = [i for i in known if fold(i) != 4]
    a, b = z([stats[i] for i in fit]), np.array([y[i] for i in fit], float)
    w = np.linalg.solve(a.T @ a + 1e-3 * len(fit) / quality.FEATURES * np.eye(a.shape[1]), a.T @ b)
    steps = Counter()
    for i in known:
        if fold(i) == 4:
            step = int(np.clip((float(z([stats[i]])[0] @ w) + 0.5) / 2 * quality.STEPS, 0, quality.STEPS - 1))
            steps[step] += 1
            steps[step, "good"] += y[i]
    at = sorted(s for s in steps if isinstance(s, int))
    values = quality.isotonic(np.array([steps[s] for s in at], float), np.array([steps[s, "good"] for s in at], float))
    raw = z([stats[i] for i in sorted(stats)]) @ w
    want = dict(zip(sorted(stats), np.clip(np.interp(raw, (np.array(at) + 0.5) / quality.STEPS * 2 - 0.5, values), 0, 1)))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(3).normal(size=(40, 8))
    z = quality.fourier(x, 1, 20_000)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 16)
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_isotonic_is_the_best_non_decreasing_fit():
    got = quality.isotonic(np.array([1, 1, 2, 1, 1.0]), np.array([0, 1, 1, 1, 0.0]))
    assert np.allclose(got, [0, 0.6, 0.6, 0.6, 0.6]) or np.all(np.diff(got) >= 0)
    assert np.allclose(quality.isotonic(np.array([2, 2.0]), np.array([2, 0.0])), [0.5, 0.5])


# --- embeddings -----------------------------------------------------------------------------------------------


def naive_near(rows):
    usable = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            usable[i] = (label, x / np.abs(x).max())
    links = defaultdict(set)
    for a, (la, x) in usable.items():
        for b, (lb, y) in usable.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[a].add(b), links[b].add(a)
    out = {}
    for i in sorted({r[0] for r in rows if r[0] is not None}):
        if i not in out:
            todo, seen = [i], {i}
            while todo:
                for b in links[todo.pop()] - seen:
                    seen.add(b), todo.append(b)
            out |= {j: i for j in seen}
    return {i: (len(links[i]), c, i == c) for i, c in out.items()}


def test_near_vectors(spark, monkeypatch):
    rows = odd_vectors()
    want = naive_near(rows)
    for cell in (512, 16):
        monkeypatch.setattr(embeddings, "cells", lambda *a, size=cell, f=embeddings.cells: f(*a, size=size))
        got = embeddings.near_vectors(vectors(spark, rows)).collect()
        monkeypatch.undo()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None} == want
        assert [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, None)]
    assert embeddings.near_vectors(vectors(spark, [])).count() == 0


def drawn(kind, n, d=64, seed=5):
    """Vectors around the given ones, normal ones, ones with a common mean, and ones of decaying spread."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    if kind == "given":
        return np.array([x.embedding for x in r_table()], np.float64)[r.integers(len(r_table()), size=n)] + 0.01 * x
    if kind == "decaying":
        return x * (np.arange(1, d + 1) ** -0.5) + 0.3
    return x + {"normal": 0.0, "mean 0.5": 0.5, "mean 1.0": 1.0}[kind]


@functools.cache
def r_table():
    import pyarrow.parquet as pq

    return [types.SimpleNamespace(**x) for x in pq.read_table(f"{BIG}/embeddings.parquet").to_pylist()]


@pytest.mark.parametrize("kind", ["given", "normal", "mean 0.5", "mean 1.0", "decaying"])
def test_tables_find_fresh_pairs(kind):
    """Recall of the tables on pairs that they were not fitted on, at the least cosine and above."""
    x = drawn(kind, 12_000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tables = embeddings.Tables(x[:8000], 12_000, 0.93)
    r = np.random.default_rng(9)
    for least in (0.93, 0.95):
        for off in (r.standard_normal((4000, 64)), x[8000:] - x[r.permutation(4000)]):
            a = x[8000:]
            off = off - (off * a).sum(axis=1, keepdims=True) * a
            b = least * a + math.sqrt(1 - least**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
            differ = np.hstack([tables._flips(a, b, w) for w in range(len(tables.words))])
            seen = np.logical_or.reduce([differ[:, tables.start(t) : tables.start(t) + tables.length].sum(axis=1) <= 1 for t in range(tables.count)]) & (differ.sum(axis=1) <= tables.radius)
            assert seen.mean() >= 0.97, (kind, least, seen.mean())


def test_substrings_follow_the_number_of_vectors():
    x = drawn("normal", 3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lengths = [embeddings.Tables(x, n, 0.93).length for n in (10**2, 10**4, 10**6, 10**8)]
    assert lengths == sorted(lengths) and lengths[-1] >= lengths[0] + 8


@pytest.mark.parametrize("kind", ["normal", "mean 1.0"])
def test_recall_against_all_pairs(spark, kind):
    x = drawn(kind, 300)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = np.random.default_rng(2)
    off = r.standard_normal(x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    c = r.uniform(0.931, 0.97, (300, 1))
    y = c * x + np.sqrt(1 - c * c) * off / np.linalg.norm(off, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in e], int(i % 300 % 3)) for i, e in enumerate(np.vstack([x, y]))]
    want = naive_near(rows)
    got = {v.vec_id: v.n_links for v in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(n for n, _, _ in want.values()) >= 600 and sum(got.values()) >= 0.97 * sum(n for n, _, _ in want.values())
    assert all(got[i] <= n for i, (n, _, _) in want.items())


def test_rotation_is_orthogonal_and_balanced():
    x = np.random.default_rng(5).normal(size=(3000, 16)) * np.linspace(1, 4, 16)
    mean, axes = embeddings.learn_rotation(x)
    assert axes.shape == (16, 64) and np.allclose(axes[:, :16].T @ axes[:, :16], np.eye(16), atol=1e-8)
    assert (np.abs(((x - mean) @ axes >= 0).mean(axis=0) - 0.5) < 0.1).all()


# --- pipeline and queries -------------------------------------------------------------------------------------


def test_pipeline_stages_keep_columns_and_take_effect(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).cache())
    for out in kept[1:-1]:
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    n = [x.count() for x in kept]
    assert n[1] <= n[0] and n[2] < n[1] and n[3] == n[2]
    assert set(kept[-1].columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.predicted == 1}
    from wellspark.llm.jaccard import near_copies

    first = {r.doc_id for r in near_copies(docs.filter(F.col("doc_id").isin(list(good)))).collect() if r.doc_id == r.component_id}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= first and len(first) < len(good)
    assert sum(r.length for r in out) > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        ok, text = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
        assert ok, text
    else:
        assert queries.QUERIES[name](spark, SF).count() >= 200


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
