import numpy as np

import corpus_pipeline
from payproof.llm import minhash, simhash

from .data import documents, prose


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    rows, near = [], []
    for i in range(60):
        words = prose(i, 300, 9000).split()
        copy = list(words)
        for at in rng.choice(len(words), 4 + i % 8, replace=False):
            copy[at] = f"changed{at}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy).upper())]
        near.append(jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "  "), (504, "few words"), (505, "Few  words"), (506, "few words"), (506, "few words"), (None, rows[0][1])]
    docs = documents(spark, rows)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in out.collect())
    want = [k for i in range(60) for k in (2 * i, 2 * i + 1) if not (near[i] and k % 2)]
    assert out.columns == docs.columns and 20 < sum(near) < 60
    assert kept == sorted(want + [500, 501, 502, 503, 504])
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_forest_keeps_what_strong_links_connect():
    rng = np.random.default_rng(2)
    u, v, w = rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300)
    a, b = minhash.best_forest(u, v, w, 40)
    strength = {}
    for x, y, z in zip(u, v, w):
        strength[x, y] = max(z, strength.get((x, y), 0))

    def joined(links):
        label = list(range(40))
        for _ in range(40):
            for x, y in links:
                label[x] = label[y] = min(label[x], label[y])
        return label

    for least in range(5):
        assert joined([e for e, z in strength.items() if z >= least]) == joined([e for e in zip(a, b) if strength[e] >= least])
    assert len(a) < 40


def test_fingerprints_find_sets_at_the_threshold():
    rng = np.random.default_rng(4)
    for n in (100, 10**7, 10**9):
        blocks, many = simhash.plan(n, 0.8, 0.997, 512)
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        met = 0
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
            fps = [simhash.fingerprints(np.unique(s), many).view(np.uint64) for s in (pool[:270], pool[30:])]
            differ = fps[0] ^ fps[1]
            met += any((differ >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1) == 0).any() for lo, hi in zip(edges, edges[1:]))
        assert met >= 196, (blocks, many, met)


def test_no_link_is_lost_in_a_large_group(spark):
    rng = np.random.default_rng(3)
    base, rows = prose(0, 400, 9000).split(), []
    for i in range(150):
        words = list(base)
        for at in rng.choice(len(words), 5 + i % 3, replace=False):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i][1], rows[j][1]) >= 0.8 and label[i] != label[j]:
                high, low = max(label[i], label[j]), min(label[i], label[j])
                label = [low if x == high else x for x in label]
    assert len(set(label)) == 65
    docs = documents(spark, rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(label))
    few = simhash.near_first(docs, cell=20)
    assert sorted(r["doc_id"] for r in few.collect()) == sorted(set(label))


def test_rows_do_not_grow_with_the_pairs_of_a_group(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, rows = prose(0, 400, 9000).split(), []
    for i in range(240):
        words = list(base)
        for at in rng.choice(len(words), 2 if i % 60 == 0 else 9, replace=False):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    near = {(i, j) for j in range(len(rows)) for i in range(j) if jaccard(rows[i][1], rows[j][1]) >= 0.8}
    label = list(range(len(rows)))
    for i, j in near:
        label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    compared, made, alike = [], [], simhash.alike

    def counted(f):
        def run(*a, **k):
            out = simhash.materialize(f(*a, **k))
            made.append(out.count())
            return out

        return run

    monkeypatch.setattr(simhash, "alike", lambda texts, pairs, *a: compared.append(pairs.count()) or alike(texts, pairs, *a))
    monkeypatch.setattr(simhash, "near_pairs", counted(simhash.near_pairs))
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect())
    assert kept == sorted(set(label)) and 100 < len(kept) < len(rows)
    assert sum(compared) <= 4 * len(rows) and sum(made) <= 36 * len(rows) < len(rows) * (len(rows) - 1) / 2
