"""Filter interactions, importance resampling and personal data against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from payproof.llm import importance, interactions, pii

from .data import awkward, documents, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def audited(rows, labels):
    """All counts by walking every document through every order."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = Counter()
    parts = set()
    for doc_id, text, lang in rows:
        t, part = text or "", lang or ""
        parts.add(part)
        w = WORDS.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                at = (part, order, step)
                out[at, "redundant"] += fails[f] and gone
                out[at, "unique_fails"] += [x for x in fails if fails[x]] == [f]
                if fails[f] and not gone:
                    gone = True
                    out[at, "removed"] += 1
                    out[at, "good_lost"] += doc_id in good
                    out[at, "toxic_lost"] += doc_id in toxic
                    out[(part, f), "shapley"] += 1
                out[at, "kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(out[(p, o, s), c] for c in names), out[(p, o[s - 1]), "shapley"]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6))


def test_interactions_match_brute_force(spark):
    rows = [r[:3] for r in awkward()] + [(20 + i, prose(i, 150), "de") for i in range(6)] + [(40 + i, "SAME TEXT #" * 30, ["en", "de", None][i % 3]) for i in range(60)]
    rows += [(7, prose(1, 120), "en"), (100, prose(1, 120), "fr"), (101, "A|b " * 200, ""), (102, " ".join(map(str, range(150))), "fr")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 103, 2)] + [(41, 1, 1), (41, 0, None), (None, 1, 1), (8, None, None)]
    got = interactions.interactions(documents(spark, rows), spark.createDataFrame([(*x, "p", 1) for x in labels], "doc_id long, quality int, toxic int, part string, n int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == audited(rows, labels)


def test_interactions_of_no_rows_and_no_labels(spark):
    docs, none = documents(spark, awkward()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.interactions(docs.where("false"), none).count() == 0
    assert {r["good_lost"] for r in interactions.interactions(docs, none).collect()} == {0}


def test_packed_fields_do_not_overflow():
    many = 2**62
    every, good, toxic = interactions.packed("ABCDE", 0b10010)
    got = {(o, s): c for o, s, c in interactions.unpacked("ABCDE", many * (every + good + toxic) + interactions.packed("ABCDE", 0)[0])}
    assert len(got) == 600
    assert got["ABCDE", 1] == [many + 1, 0, 0, 0, 0, 0] and got["ABCDE", 2] == [1, many, 0, 0, many, many] and got["ABCDE", 5] == [1, 0, many, 0, 0, 0]
    assert got["EBACD", 1] == [1, many, 0, 0, many, many] and got["EBACD", 2] == [1, 0, many, 0, 0, 0]


def grams(text, shortest, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return len(w), [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def drawn(rows, target, shortest, longest, buckets, percent, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text or "", shortest, longest)[1]))
    for text in target:
        t.update(map(bucket, grams(text or "", shortest, longest)[1]))
    big_s, big_t = s.total(), t.total()
    out = []
    for i, text in rows:
        n, own = grams(text or "", shortest, longest)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in map(bucket, own)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    pool = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(pool[: percent * len(pool) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("shortest,longest", [(1, 1), (1, 3), (2, 2)])
def test_resampling_matches_brute_force(spark, shortest, longest):
    rows = [r[:2] for r in awkward()] + [(100 + i, prose(i, 10 + i, words=200) + " É-x\x00y_Z9") for i in range(80)] + [(200 + i, "a copy of one text again and again " * 4) for i in range(40)]
    target = [prose(3, 200), None, "", "again and again w1 w2 w3"]
    docs = documents(spark, rows).repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, asked, importance.Features(shortest, longest, 500), percent=30, least_words=20, seed=7)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str) == drawn(rows, target, shortest, longest, 500, 30, 20, 7)
    assert importance.resample(docs.where("false"), asked).count() == 0
    assert importance.resample(docs, asked.where("false")).where("rank is not null").count() == 12


def test_batches_keep_texts_apart():
    import pyarrow as pa

    texts = ["a b", None, "", "b c " * 40, "c", "\x00d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    cut = list(importance.joined(iter([batch]), most=8))
    assert [t for _, ts in cut for t in ts] == [(t or "").encode() for t in texts] and len(cut) > 2
    kind = importance.Features(1, 2, 1 << 32)
    _, owner, n = kind.of([(t or "").encode() for t in texts])
    assert n.tolist() == [2, 0, 0, 80, 1, 1]
    assert np.bincount(owner, minlength=6).tolist() == [3, 0, 0, 159, 1, 1]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            double = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])]
            if kind == "email" or (kind == "ip" and max(map(int, m.group().split("."))) <= 255) or (kind == "card" and 14 <= len(d) <= 19 and sum(double) % 10 == 0) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "@", ".", "+", "-", " ", "1", "22", "255", "256", "(", ")", "é", "4111 1111 1111 1111", "4111111111111111", "+1 (017) 555-7713", "1.2.3.4", "x@y.z", "%", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 130_000, "( " * 200_000):
        base = pii.base_spans(run)
        pii.candidates(run, base)


def letters(seed, n):
    return prose(seed, n).translate({48 + i: 97 + i for i in range(10)})


def person(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    card = next(d + c for c in "0123456789" if pii.luhn(d + c))
    return rng.choice([f"ann.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(1, 255)) for _ in range(4)), card, f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"])


def test_trees_add_disguised_spans_and_leave_others_alone(spark):
    rng = random.Random(3)
    junk = lambda: rng.choice([f'token = "{rng.getrandbits(160):040x}"', "".join(rng.choice("123456789") for _ in range(16)) + " pieces", "meet at noon.The end", f"order {rng.randrange(10**9)}", "3, 4, 5, 6 of them"])
    rows = [(i, letters(i, 15) + " " + person(rng) + " " + letters(i + 1, 9) + " " + junk()) for i in range(500)] + awkward()
    model = pii.fit(documents(spark, rows).repartition(3))
    assert len(model.nodes) == 12 and sum(t < math.inf for t in model.thresholds) >= 3
    fresh, truth = [], []
    for i in range(300):
        kind, value = next((s[0], v) for v in iter(lambda: person(rng), None) for s in pii.base_spans(v)[:1])
        before = letters(2000 + i, 12) + " "
        value = pii.loosened(kind, value, rng)
        fresh.append((10_000 + i, before + value + " " + letters(3000 + i, 9) + " " + junk()))
        truth.append((10_000 + i, pii.KINDS[kind], len(before), len(before) + len(value)))
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in pii.find_private(documents(spark, fresh), model).collect() for s in r["found"] if not s["base"]}
    assert len(got & set(truth)) >= 0.7 * len(truth)
    assert len(got - set(truth)) <= 0.1 * len(got)


def test_rare_examples_of_a_large_table_are_learned_from(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 4500 = 7 THEN concat('write to ann', id, '@mail.example.com today') WHEN id % 50 = 0 THEN 'meet at noon.The end' ELSE concat('plain words ', id) END AS text")
    assert pii.fit(docs).thresholds[0] < math.inf  # 14 rows of 60,000


def test_private_data_of_awkward_rows(spark):
    rows = awkward() + [(50, "x@y.zz and +1 (017) 555-7713\n1.2.3.4"), (50, "x@y.zz and +1 (017) 555-7713\n1.2.3.4"), (51, "+4111111111111111 é x@y.zz")]
    docs = documents(spark, rows)
    found = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["found"]]) for r in pii.find_private(docs, pii.Trees()).collect()), key=str)
    assert found == sorted(((i, [(pii.KINDS[k], a, b) for k, a, b in plain(t or "")]) for i, t, *_ in rows), key=str)
    out = pii.redact(docs, pii.Trees())
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = [r["text"] for r in out.collect()]
    assert texts.count("[EMAIL] and [PHONE]\n[IP]") == 2 and texts.count("+[CARD] é [EMAIL]") == 1 and texts.count(None) == sum(t is None for _, t, *_ in rows)
    assert pii.fit(docs.where("false")).nodes == [] and pii.find_private(docs.where("false"), pii.Trees()).count() == 0
