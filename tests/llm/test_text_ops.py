import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from payproof.llm import chat, katz, langid, lines, mixing, phrases, quality, simhash
from payproof.llm._common import fold_of

from .data import awkward, documents, prose

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_counts_match_brute_force(spark):
    docs = documents(spark, awkward())
    got = sorted(tuple(r) for r in quality.features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect() if r[0] is not None)
    want = []
    for i, t, *_ in awkward():
        if i is None:
            continue
        t = t or ""
        w = WORDS.findall(t)
        runs = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        hit = {k for j in range(len(w) - 4) if runs[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        held = [x for x in t.split("\n") if WORDS.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(hit)))
    assert got == sorted(want)


def test_quality_rules_learn_and_reject(spark):
    rows = [(i, prose(i, 60) if i % 2 else " ".join(f"x{j}###" for j in range(60))) for i in range(1, 241)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows if i % 3] + [(5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out, rules = quality.judge(docs, labels)
    assert rules.rules and "CASE WHEN" in rules.sql()
    judged = [r["kept"] == (r["doc_id"] % 2 == 1) for r in out.where("not base_failed").collect()]
    assert np.mean(judged) > 0.95
    none, rules = quality.judge(docs, labels.where("false"))
    assert rules.sql() == "true" and none.where("kept = base_failed").count() == 0
    assert quality.judge(docs.where("false"), labels)[0].count() == 0


def test_quality_learns_from_few_rows_and_verdicts_follow_the_list(spark):
    """Forty bad rows are enough for a rule; ``kept`` is what the list says when it is read rule by rule."""
    rows = [(i, prose(i, 60) if i % 5 else " ".join(f"x{j}###" for j in range(60))) for i in range(200)] + awkward(9)[:7]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out, rules = quality.judge(documents(spark, rows), labels)
    assert rules.rules
    for r in out.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        rejects = any(all(r[f"r_{f}"] > t if above else r[f"r_{f}"] <= t for f, above, t in rule) for rule in rules.rules)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not rejects)
    assert quality.lower_bound(4, 4, 1.28) < 0.75 < quality.lower_bound(5, 5, 1.28)


CLASHES = ("_id", "_t", "_new", "cuts", "n_lines_removed", "_h", "_n", "_s", "_d", "h", "id", "t", "k", "fp", "root", "first", "size", "taken", "items", "a", "b", "node", "key")


def test_no_column_name_clashes(spark):
    from payproof.llm import decontaminate, minhash

    rows = [(i, prose(i, 40) + "\nsame line here\nand one more line\n" + prose(i + 100, 20), f"s{i % 3}") for i in range(30)] + [(31, None, None), (32, "", "s0")]
    docs = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    bench = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    added = {"n_lines_removed", "size", "taken"}
    for f, more in ((lines.dedup_lines, ()), (mixing.mixed_documents, ()), (decontaminate.drop_contaminated, (bench,)), (minhash.near_first, ()), (simhash.simhash_first, ())):
        out = f(docs, *more)
        assert len(set(out.columns)) == len(out.columns) and set(docs.columns) <= set(out.columns)
        own = [c for c in CLASHES if c not in added or f not in (lines.dedup_lines, mixing.mixed_documents)]
        got = out.collect()
        assert len(got) > 20 and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in own)


def test_quality_uses_no_python_on_executors(spark):
    plan = quality.features(documents(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixing_meets_targets(spark):
    rows = [(i, prose(i, 20 + i % 50), None, f"s{i % 4}" if i % 9 else None) for i in range(600)] + awkward()
    docs = documents(spark, rows)
    out = mixing.mix_by_source(docs).collect()
    assert len(out) == len(rows)
    assert sum(r["size"] for r in out) == sum(len(WORDS.findall(t or "")) for _, t, *_ in rows)
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        biggest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * biggest
        assert all(r["taken"] <= 2 * r["size"] for r in own) and own[0]["source_size"] == sum(r["size"] for r in own)
    again = mixing.mix_by_source(docs.repartition(7)).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"], str(r["source"])) for r in rs)
    assert key(out) == key(again)
    assert mixing.mix_by_source(docs.where("false")).count() == 0


def test_targets_by_hand():
    got = mixing.target_words({"a": 100, "b": 1000, None: 1000})
    assert sum(got.values()) == 3150 and got["a"] == 200
    assert math.isclose(got["b"], 2950 * 2 / 3) and math.isclose(got[None], 2950 / 3)
    assert mixing.target_words({}) == {} and mixing.target_words({"a": 0}) == {"a": 0}


def test_flow_is_maximal_and_cheapest():
    flow = mixing.route({"p": (10, ["a"]), "q": (10, ["a", "b"]), "r": (4, ["b"])}, {"a": 18, "b": 14})
    into = lambda s: sum(f.get(s, 0) for f in flow.values())
    assert into("a") == 18 and into("b") == 14
    extra = sum(max(0, sum(f.values()) - n) for f, n in ((flow["p"], 10), (flow["q"], 10), (flow["r"], 4)))
    assert extra == 32 - 24


def test_mixing_overlapping_sources(spark):
    rows = [(i, prose(i, 30), ["a"] if i % 3 == 0 else ["b", "a", "b"] if i % 3 == 1 else [] if i % 10 == 9 else ["b"]) for i in range(300)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    chosen, targets = mixing.mix(docs)
    want = {r["source"]: r["target"] for r in targets.collect()}
    got = Counter()
    for r in chosen.collect():
        assert len(r["given_to"]) == r["copies"] <= 2 and set(r["given_to"]) <= set(r["sources"])
        for s in r["given_to"]:
            got[s] += r["size"]
    assert set(want) == {"a", "b", None}
    for s in ("a", "b"):
        assert abs(got[s] - want[s]) <= 8 * 30


def test_line_dedup_takes_repeats_out_wherever_they_are(spark):
    block = [f"line {j} {prose(j, 6)}" for j in range(40)]
    rows = [(5, "\n".join(["own five", *block, "tail five"])), (3, "\n".join(["three", "more three", *block])), (8, "\n".join([*block[:19], "cut", *block[19:]])), (9, "alone\nlines\nhere"), (10, None), (11, ""), (3, "\n".join(["three", "more three", *block])), (None, "x\ny")]
    docs = documents(spark, rows)
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    assert out[3]["n_lines_removed"] == 0 and out[9]["text"] == "alone\nlines\nhere"
    assert out[10]["text"] is None and out[11]["text"] == "" and out[None]["text"] == "x\ny"
    assert 20 <= out[5]["n_lines_removed"] <= 40 and out[8]["n_lines_removed"] >= 15
    for i in (5, 8):
        was, now = dict((r[0], r[1]) for r in rows)[i].split("\n"), out[i]["text"].split("\n")
        it = iter(was)
        assert all(x in it for x in now) and len(was) - len(now) == out[i]["n_lines_removed"]
        assert {x for x in was if x not in block} <= set(now)
    assert set(docs.columns) < set(lines.dedup_lines(docs).columns)
    assert lines.dedup_lines(docs.where("false")).count() == 0


def test_line_chunks_against_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = [prose(i, 5) for i in range(60)]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, 8, 25))) for i in range(40)] + awkward()
    got = {(r["doc_id"], r["t"]): r["text"] for r in lines.dedup_lines(documents(spark, rows).withColumn("t", F.col("text"))).collect()}
    parts = [tuple(r) for r in lines.chunks(documents(spark, rows).where("text is not null").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("t"), "text")).select("id", "t", "k", "lines").distinct().collect()]
    first = {}
    for i, t, k, ls in sorted(parts, key=lambda p: p[:3]):
        first.setdefault(tuple(ls), (i, t, k))
    gone = defaultdict(set)
    for i, t, k, ls in parts:
        if first[tuple(ls)] != (i, t, k):
            gone[i, t].update(range(k, k + len(ls)))
    texts = {(r["id"], r["t"]): r["text"] for r in documents(spark, rows).where("text is not null").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("t"), "text").collect()}
    for (i, t), text in texts.items():
        want = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone[i, t])
        assert got[None if i == -(1 << 63) else i, text] == want
    assert any(gone.values())


def test_line_dedup_of_many_equal_rows(spark):
    block = "\n".join(f"line {j}" for j in range(40))
    docs = documents(spark, [(1, block)] * 60 + [(2, block)] * 60)
    out = {tuple(r): n for r, n in Counter(map(tuple, lines.dedup_lines(docs).select("doc_id", "n_lines_removed").collect())).items()}
    assert out == {(1, 0): 60, (2, 40): 60}


def test_line_chunks_hold_every_line_of_longer_texts(spark):
    rows = [(n, "\n".join(f"line {j} of {n}" for j in range(n))) for n in range(1, 120)] + [(200, "a\n\n\n" * 20), (201, "same\n" * 50)]
    parts = lines.chunks(documents(spark, rows).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text")).collect()
    held = defaultdict(list)
    for r in parts:
        assert len(r["lines"]) >= 2
        held[r["id"]] += range(r["k"], r["k"] + len(r["lines"]))
    for i, t in rows:
        n = len(t.split("\n"))
        assert sorted(held[i]) == (list(range(n)) if n > 1 else [])
    assert 2.5 < sum(len(v) for v in held.values()) / len(parts) < 4


def test_line_dedup_takes_whole_copies_and_empty_lines_out(spark):
    text = "\n".join(f"line {j}" for j in range(200))
    out = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, [(1, text), (2, text), (3, "\n"), (4, "\n")])).collect()}
    assert [out[i]["n_lines_removed"] for i in (1, 2, 3, 4)] == [0, 200, 0, 2] and out[2]["text"] == ""


def katz_by_hand(rows, train):
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    c, pairs, starts = Counter(), Counter(), 0
    for (i, toks), on in zip(texts, train):
        if on:
            starts += 1
            for v, w in zip([b"\n", *toks], toks):
                c[w] += 1
                pairs[v, w] += 1
    n = sum(c.values())
    seen = lambda x: np.array([sum(v == r for v in x.values()) for r in range(1, 7)])
    du, db = katz.discounts(seen(c)), katz.discounts(seen(pairs))
    d = lambda x, k: x * k[x - 1] if x <= 5 else x
    free = sum((1 - du[r - 1]) * r * m for r, m in enumerate(seen(c)[:5], 1))
    total, free = (n, free) if free > 0 else (n + 1, 1)
    uni = lambda w: (d(c[w], du) if w in c else free) / total
    after = defaultdict(dict)
    for (v, w), x in pairs.items():
        after[v][w] = x
    size = Counter(c)
    size[b"\n"] = starts

    def p(v, w):
        if not size.get(v) or v == b"" and not after[v]:
            return uni(w)
        loose, f = sum((1 - db[x - 1]) * x for x in after[v].values() if x <= 5) / size[v], 1
        if loose <= 0:
            loose, f = 1 / (size[v] + 1), size[v] / (size[v] + 1)
        return f * d(after[v][w], db) / size[v] if w in after[v] else loose / (1 - sum(map(uni, after[v]))) * uni(w)

    return texts, c, n, p


@pytest.mark.parametrize("chunk_mb", [0.003, 8])
def test_katz_scores_match_brute_force(spark, chunk_mb):
    rows = [(i, t) for i, t, *_ in awkward()] + [(100 + i, prose(i, 150, 60)) for i in range(40)]
    train = [i is not None and i % 4 != 1 for i, _ in rows]
    docs = documents(spark, rows)
    scored, model = katz.train_and_score(docs, F.col("doc_id").isNotNull() & (F.col("doc_id") % 4 != 1), chunk_mb=chunk_mb, bucket_mb=chunk_mb)
    got = scored.collect()
    assert len(got) == len(rows)
    texts, c, n, p = katz_by_hand(rows, train)
    want = defaultdict(list)
    for i, toks in texts:
        s = sum(math.log10(p(v, w)) for v, w in zip([b"\n", *toks], toks))
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (len(c) + 1))) for w in toks)
        want[i].append((len(toks), sum(c[w] > 0 for w in toks), n, base, s))
    for i, vals in want.items():
        own = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got if r["doc_id"] == i)
        assert np.allclose(own, sorted(vals), rtol=1e-9)
    new = [(7000, "never seen w1 W2 w1"), (7001, None), (7002, rows[1][1]), (None, "é")]
    by_joins = {r["doc_id"]: r for r in katz.score_new(model, documents(spark, new)).collect()}
    for i, t in new:
        toks = (t or "").encode().lower().split() + [b""]
        r = by_joins[i]
        assert (r["n_tokens"], r["n_known"]) == (len(toks), sum(c[w] > 0 for w in toks))
        assert math.isclose(r["score"], sum(math.log10(p(v, w)) for v, w in zip([b"\n", *toks], toks)), rel_tol=1e-9)
    assert model.pairs().count() > 1000 and model.words().count() == len(c)
    for v in (b"\n", b"w1", b"w2"):
        assert abs(sum(p(v, w) for w in c) + p(v, b"never seen") - 1) < 1e-9


def test_katz_without_training_or_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    got = {r["doc_id"]: r for r in katz.score(docs, F.lit(False)).collect()}
    assert got[1]["score"] == 0 and got[2]["n_tokens"] == 1 and got[1]["n_known"] == 0
    assert katz.score(docs.where("false"), F.lit(True)).count() == 0


def test_discounts_are_proper():
    for n in ([100, 50, 30, 20, 15, 12], [100, 60, 10, 40, 1, 9], [5, 0, 0, 0, 0, 0], [0] * 6):
        d = katz.discounts(np.array(n))
        assert ((d > 0) & (d < 1)).all()


def chats(spark, rows):
    return spark.createDataFrame([(*r, "noise", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, span int")


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|end|>\nnice"), (1, 1, "user", "<|text|> hi <\\|x|>"), (1, 2, "user", None), (1, 3, "assistant", "ok <"), (1, 4, "assistant", "| and \\ <\\\\|"), (2, None, None, ""), (2, 5, "user<|role|>", "same"), (2, 5, "user<|role|>", "same"), (None, 1, "assistant", "é漢\U0001f600"), (3, 1, "assistant", "x" * 100_000)] + [(4, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(700)]
    out = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(chats(spark, rows))).collect()}
    for cid in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == cid))
        assert [(t["role"], t["text"]) for t in out[cid]["turns"]] == [(r, x) for _, r, x in own]
    assert out[1]["formatted"].count("<|role|>") == 3 and out[4]["formatted"].endswith("<|end|>\n")
    d = {r["conv_id"]: r for r in chat.digests(chat.read_chats(chat.format_chats(chats(spark, rows)))).collect()}
    assert d[1]["loss_chars"] == len("ok <| and \\ <\\\\|")
    assert d[1]["loss_sha256"] == hashlib.sha256("ok <| and \\ <\\\\|".encode()).hexdigest()
    assert d[4]["n_turns"] == 700 and chat.format_chats(chats(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("chunk_mb", [0.004, 8])
def test_passage_removal_matches_brute_force(spark, chunk_mb):
    shared, other = prose(77, 90, 5000).split(), prose(78, 55, 5000).split()
    rows = [(i, t) for i, t, *_ in awkward()] + [(20 + i, " ".join(prose(300 + i, 40, 5000).split() + shared[i : i + 70] + prose(400 + i, 30, 5000).split() + (other if i % 2 else []))) for i in range(12)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in phrases.remove_repeats(documents(spark, rows), chunk_mb=chunk_mb, bucket_mb=chunk_mb).collect()))
    first, toks = {}, [((i is not None, i or 0), (t or "").split()) for i, t in rows]
    for i, w in toks:
        w = [x for x in w]
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, i), i)
    want = []
    for i, w in toks:
        gone = {k for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for k in range(j, j + 50)}
        want.append((not i[0], i[1], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    assert got == sorted(want) and sum(r[3] for r in got) > 500
    assert phrases.remove_repeats(documents(spark, rows).where("false")).count() == 0


def test_passages_of_short_null_and_repeated_rows(spark):
    def of(rows):
        return sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in phrases.remove_repeats(documents(spark, rows)).collect())

    assert of([(1, "short text"), (2, None)]) == [(1, 2, 0, "short text"), (2, 0, 0, "")]
    assert of([(1, None), (None, None), (3, "")]) == [(0, 0, 0, ""), (1, 0, 0, ""), (3, 0, 0, "")]
    long_text = prose(1, 70)
    assert of([(1, long_text)] * 3 + [(2, long_text)] * 2) == [(1, 70, 0, long_text)] * 3 + [(2, 70, 70, "")] * 2


def test_windows_of_equal_hashes_are_told_apart():
    k = phrases.distinct_keys(np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([3, 1, 2, 4]))
    assert k.key.tolist() == [5, 5, 9] and k.least.tolist() == [2, 1, 4] and k.several.tolist() == [True, False, False] and k.place.tolist() == [0, 1, 0, 2]


def test_simhash_matches_brute_force(spark):
    base = prose(5, 300, 3000).split()
    rows = [(i, t) for i, t, *_ in awkward()]
    for i in range(30):
        w = list(base)
        w[i * 7 % 300] = f"new{i}"
        rows.append((50 + i, " ".join(w)))
    rows += [(200 + i, prose(900 + i, 50)) for i in range(20)] + [(300, "One Two"), (301, "one two")]
    docs = documents(spark, rows)
    got = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.simhash_components(docs).collect()}

    def by_hand(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[j : j + 3]) for j in range(len(w) - 2)] or [b" ".join(w)]
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [(i, by_hand(t)) for i, t in rows]
    n = len(fps)
    label = list(range(n))
    for _ in range(n):
        new = [min(label[k] for k in range(n) if bin(fps[j][1] ^ fps[k][1]).count("1") <= 3) for j in range(n)]
        if new == label:
            break
        label = new
    for j, (i, fp) in enumerate(fps):
        own = [fps[k][0] for k in range(n) if label[k] == label[j] and fps[k][0] is not None]
        assert got[i, fp - (1 << 64) if fp >= 1 << 63 else fp] == (min(own) if own else None)
    one = simhash.simhash_first(docs)
    assert one.columns == docs.columns and one.count() == len(set(label))
    for rows in ([(1, "A x y z"), (2, "A x y z"), (2, "B u v w")], [(1, "A x y z"), (None, "A x y z"), (None, "B u v w")]):
        assert sorted(r["text"][0] for r in simhash.simhash_first(documents(spark, rows + rows)).collect()) == ["A", "B"]
    assert simhash.simhash_components(docs.where("false")).count() == 0


def test_simhash_hot_keys_in_cells(spark):
    values = spark.range(3000).select((F.col("id") * 0 + F.when(F.col("id") < 1500, F.expr("shiftleft(1L, cast(id % 60 as int)) + shiftleft(1L, cast(id % 59 as int))")).otherwise(F.xxhash64("id"))).alias("fp")).distinct()
    small = {tuple(r) for r in simhash.components(simhash.links(values, cell=16)).collect()}
    large = {tuple(r) for r in simhash.components(simhash.links(values, cell=100_000)).collect()}
    assert small == large and small


def test_language_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    sounds = {"xx": ["tha", "ing", "er", "on", "wh"], "yy": ["ché", "eau", "ou", "tion", "ré"], "zz": ["sch", "ung", "ß", "ei", "ver"]}
    make = lambda lang: " ".join("".join(rng.choice(sounds[lang], rng.integers(1, 4))) for _ in range(40))
    rows = [(i, make(lang), lang, "s") for i, lang in enumerate(list(sounds) * 60)]
    docs = documents(spark, rows + [(900, None, "xx", None), (901, "", None, None), (902, "123 !! 4", "yy", "s"), (902, "123 !! 4", "yy", "s"), (None, make("zz"), "zz", "s")])
    model = langid.fit(docs.where(fold_of(F.col("doc_id")) != 0), keep=100)
    out = langid.identify(docs, model).collect()
    pred = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert len(out) == 185 and pred[900] == pred[901] == pred[902] == ("und", 0.0)
    held = [(pred[i][0], lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97 and all(0 <= s <= 1 for _, s in pred.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == 181
    none = langid.fit(docs.where("false"))
    assert none.langs == [] and {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_learns_whole_texts_and_all_words(spark):
    texts = {lang: " ".join(f"{lang}{k:x}" for k in range(35_000)) for lang in ("ax", "by")}
    model = langid.fit(documents(spark, [(i, t, lang) for i, (lang, t) in enumerate(texts.items())]))
    assert set(model.words) == {w for t in texts.values() for w in t.split()}
    assert {"^ax1", "88b$", "1", "by"} <= set(model.grams)


def test_unseen_words_back_off(spark):
    docs = documents(spark, [(i, "abab cdcd" if i % 2 else "efef ghgh", "l1" if i % 2 else "l2") for i in range(40)])
    scorer = langid.Scorer(langid.fit(docs))
    assert scorer.predict("ababab")[0] == "l1" and scorer.predict("ghghgh")[0] == "l2"
    assert scorer.predict("zzz qqq")[0] in ("l1", "l2")


def test_language_scores_match_brute_force(spark):
    rows = [(i, " ".join(prose(i, 30).split()[:: 1 + i % 3]) if i % 2 else "ñandú azul über straße", f"l{i % 3}") for i in range(30)]
    learned, longest = Counter(), 4
    for _, text, lang in rows:
        for w in langid.tokens(text):
            learned[lang, 0, w] += 1
            for k in range(1, longest + 1):
                for j in range(len(w) + 3 - k):
                    learned[lang, k, f"^{w}$"[j : j + k]] += 1
    langs = ["l0", "l1", "l2"]
    sums = {(lang, k): sum(n for (x, y, _), n in learned.items() if (x, y) == (lang, k)) for lang in langs for k in range(longest + 1)}
    kinds = {(lang, k): sum((x, y) == (lang, k) for x, y, _ in learned) for lang in langs for k in range(longest + 1)}
    most = {k: max(kinds[lang, k] for lang in langs) for k in range(longest + 1)}
    log = lambda lang, k, x: math.log((learned[lang, k, x] + 0.5) / (sums[lang, k] + 0.5 * (most[k] + 1)))

    def word(lang, w):
        if any(learned[x, 0, w] for x in langs):
            return log(lang, 0, w)
        for k in range(min(longest, len(w) + 2), 0, -1):
            known = [g for g in (f"^{w}$"[j : j + k] for j in range(len(w) + 3 - k)) if any(learned[x, k, g] for x in langs)]
            if known:
                return sum(log(lang, k, g) for g in known) / len(known)
        return 0.0

    texts = ["ñandú", "azulado über qqq", rows[1][1], rows[3][1] + " straßen zzz", "ü ü ü", "x" * 50]
    asked = documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    model = langid.fit(documents(spark, rows))
    for cache in (4_000_000, 3):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(asked, model, cache).collect()}
        for i, t in enumerate(texts):
            toks = langid.tokens(t)
            logs = [sum(word(lang, w) for w in toks) / len(toks) * math.sqrt(len(toks)) for lang in langs]
            odds = [math.exp(x - max(logs)) for x in logs]
            assert abs(got[i][1] - max(odds) / sum(odds)) < 1e-4
            assert odds[langs.index(got[i][0])] > 0.9999


def test_language_model_keeps_within_its_bytes(spark):
    texts = " ".join(f"rare{k}" for k in range(400)) + " often" * 50
    docs = documents(spark, [(i, texts if i == 0 else "often", "aa") for i in range(3)])
    whole, small = langid.fit(docs), langid.fit(docs, most_bytes=20_000)
    assert len(whole.words.index) == 401 and set(small.words) == {"often"} and len(small.words.index) + len(small.grams.index) < 130
    assert langid.fit(docs, most_bytes=1).words.index == {} and langid.identify(docs, langid.fit(docs, most_bytes=1)).count() == 3
