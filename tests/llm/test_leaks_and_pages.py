import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from payproof.llm import decontaminate, html

from .data import awkward, documents, prose


def best_distance(item, words):
    """Least word edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_against_exact_search(spark):
    rng = np.random.default_rng(3)
    items = [(i, prose(1000 + i, 12 + 3 * i, 900)) for i in range(12)] + [(99, "too short"), (98, None), (None, prose(5000, 20, 900))]
    rows = [(i, t) for i, t, *_ in awkward()]
    for i in range(60):
        w = items[i % 12][1].split()
        for _ in range(i % 6):
            at = int(rng.integers(0, len(w)))
            w[at : at + 1] = [["other"], [], ["two", w[at]]][int(rng.integers(0, 3))]
        rows.append((100 + i, (prose(i, 30) + " " + " ".join(w).upper() + ". " + prose(i + 1, 30)) if i % 5 else prose(i, 80)))
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_matches(docs, bench).select("doc_id", "item_id").collect()}
    want = set()
    for i, t in rows:
        words = decontaminate_words(t)
        for k, text in items:
            item = decontaminate_words(text)
            if len(item) >= 8 and t is not None and best_distance(item, words) <= int(len(item) * 0.2 + 1e-9):
                want.add((i, k))
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 20
    every = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert every[3]["contaminated"] is False and every[100 + 1]["contaminated"]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({r[0] for r in got})
    assert decontaminate.find_matches(docs, bench.where("false")).count() == 0
    assert decontaminate.contamination(docs.where("false"), bench).count() == 0
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_matches(docs, bench, block=5).select("doc_id", "item_id").collect()}
    assert len(blocks & got) >= 0.95 * len(got)


def decontaminate_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def test_short_items_match_word_by_word(spark):
    docs = documents(spark, [(1, "so 42."), (2, "the Answer, is FORTY two"), (3, "the answer was forty two"), (4, "one two three four five six seven"), (5, "one two three four five six eight"), (6, "nothing")])
    bench = spark.createDataFrame([(1, "42"), (2, "the answer is forty two"), (3, "one two three four five six seven"), (4, " ... ")], "item_id long, text string")
    found = decontaminate.find_matches(docs, bench).select("doc_id", "item_id", "edits").distinct().collect()
    assert sorted(map(tuple, found)) == [(1, 1, 0), (2, 2, 0), (4, 3, 0)]


def test_index_reaches_its_recall():
    items = [(i, prose(i, 20 + i, 500).split()) for i in range(30)]
    index = decontaminate.Index(items, recall=0.95)
    assert index.recall >= 0.95 and index.bits.shape[1] == index.walks


def test_long_items_and_large_vocabularies_are_found():
    rng = np.random.default_rng(6)
    items = [(0, [f"a{k}" for k in range(1000)]), *((i, [f"u{i}x{k}" for k in range(300)]) for i in range(1, 251)), (300, prose(1, 30).split())]
    index = decontaminate.Index(items)
    assert len(index.vocabulary) > 70_000 and index.recall >= 0.99
    met = []
    for x in [0] * 5 + [*range(1, 251, 5)]:
        copy = np.array(index.edited(index.seqs[x], int(index.edits[x]), rng), np.int64)
        item, start = index.candidates(copy)
        assert x in item
        zero = np.zeros(len(item), np.int64)
        found, _, edits = index.matches(copy, zero, zero + len(copy), item, start)
        assert (edits <= index.edits[item[found]]).all()
        met.append(x in item[found])
    assert all(met[:5]) and np.mean(met) >= 0.95


def test_a_long_item_does_not_slow_short_ones():
    def found(items):
        index = decontaminate.Index(items)
        text = np.array([w for k in range(40) for w in (*index.seqs[k], 0)], np.int64)
        item, start = index.candidates(text)
        out, begun = [], time.process_time()
        for at in index.classes(item, 2_000_000):
            zero = np.zeros(len(at), np.int64)
            good, last, edits = index.matches(text, zero, zero + len(text), item[at], start[at])
            out += zip(item[at][good].tolist(), last.tolist(), edits.tolist())
        return sorted(out), time.process_time() - begun

    short = [(i, prose(i, 60, 5000).split()) for i in range(40)]
    alone, _ = found(short)
    mixed, seconds = found([*short, (99, prose(99, 8000, 5000).split())])
    assert [x for x in mixed if x[0] < 40] == alone and len({x for x, _, e in alone if e == 0}) == 40
    assert seconds < 1


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head><body><nav><ul><li>menu one</ul></nav><!-- <p>no</p> --><div class="ad">buy this</div>%s<footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>Head</h1><p>One &amp; two<br>three<p><b>Four</b> five</article>", ["Head", "One & two three", "Four five"]),
        ("<main><header>Lead</header><p>a  \n b</p><aside>side</aside><form>f</form><div class='comments'><p>c</p></div><p>z</main>", ["Lead", "a b", "z"]),
        ("<article>x<section class='related'>r</section>y<article class='comment'>no</article></article>", ["x", "y"]),
        ("<article><p>cut &am", ["cut &am"]),
        ("<article><div hidden>h</div><p title='a>b'>t 1 < 2</p></article>", ["t 1 < 2"]),
        ("", []),
    ],
)
def test_article_blocks(body, want):
    assert [t for t, sure in html.blocks(PAGE % body) if sure] == want


def test_boilerplate_of_hosts(spark):
    furniture = "welcome to our fine site read all the news here now"
    rows = [(i, f"http://h{i % 2}.example.com/{i}", f"<html><body><div>{furniture}</div><div>{prose(i, 20, 9000)}</div><div>{furniture} again</div></body></html>") for i in range(20)]
    rows += [(100, "http://h0.example.com/a", PAGE % f"<article><p>{furniture}</p></article>"), (101, None, None), (102, "x", ""), (103, "http://h0.example.com/a", "plain &lt;text&gt;"), (103, "http://h0.example.com/a", None), (None, "http://solo.example.com", "<p>alone")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    for i in range(20):
        own = prose(i, 20, 9000).split()
        assert "welcome" not in text[i] and len([w for w in text[i].split() if w in own]) >= 16
    assert text[100] == furniture and text[101] == "" and text[None] == "alone"
    assert {r["text"] for r in got if r["page_id"] == 103} == {"plain <text>", ""}
    assert html.main_text(pages.where("false")).count() == 0


def main_text_by_hand(rows, length=8, share=0.01, article_share=0.5):
    hosts = defaultdict(set)
    found = [(html.host_of(u), tuple(html.blocks(h or ""))) for _, u, h in rows]
    for host, x in found:
        hosts[host].add(x)
    texts = []
    for host, x in found:
        runs, own, whole = Counter(), Counter(), Counter()
        for y in hosts[host]:
            toks = [(w, b) for t, b in y for w in t.split(" ")]
            cut = [(tuple(w for w, _ in toks[j : j + length]), toks[j][1]) for j in range(len(toks) - length + 1)]
            runs.update({r for r, _ in cut})
            own.update({r for r, b in cut if b})
            whole.update({t for t, within in y if not within})
        outside, within_ = max(2, math.ceil(share * len(hosts[host]))), max(5, math.floor(article_share * len(hosts[host])) + 1)
        toks = [(w, b, k) for k, (t, b) in enumerate(x) for w in t.split(" ")]
        cut = [tuple(w for w, _, _ in toks[j : j + length]) for j in range(len(toks))]
        often = [(runs[r] >= outside, own[r] >= within_ and b) if len(r) == length else (False, False) for r, (_, b, _) in zip(cut, toks)]
        kept = defaultdict(list)
        for j, (w, b, k) in enumerate(toks):
            if not any(o[b] for o in often[max(0, j - length + 1) : j + 1]) and (b or whole[x[k][0]] < outside):
                kept[k].append(w)
        texts.append("\n\n".join(" ".join(kept[k]) for k in sorted(kept)))
    return texts


@pytest.mark.parametrize("shard_mb,few", [(0.005, 2), (8, 1000)])
def test_main_text_matches_brute_force(spark, shard_mb, few):
    notice, quote, banner, label = prose(1, 14, 9000), prose(2, 30, 9000), prose(3, 12, 9000), "Read more"
    rows = []
    for i in range(90):
        own = f"<h1>{prose(100 + i, 5, 9000)}</h1><p>{prose(200 + i, 25, 9000)}" + (f"<p>{quote}" if i % 5 == 0 else "") + (f"<p>{notice}" if i % 3 else "") + f"<p>{banner}"
        inner = f"<article>{own}</article>" if i % 2 else f"<div>{own}</div>"
        rows.append((i, f"http://h{i % 2 if i < 80 else 2}.example.com/{i}", f"<body><div>{notice} {i}</div>{inner}<div>{label}</div><p>{prose(300 + i % 40, 9, 9000)}"))
    rows += [(500 + i, f"http://h0.example.com/copy{i}", rows[2][2]) for i in range(12)] + [(600, rows[4][1], rows[4][2])] * 3
    rows += [(700, None, "<p>a b c"), (701, None, "<p>a b c"), (702, "http://h1.example.com/short", "<p>two words"), (703, "x", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["url"] or "", r["text"]) for r in html.main_text(pages, shard_mb=shard_mb, few=few, share=0.05).collect())
    want = sorted((i, u or "", t) for (i, u, _), t in zip(rows, main_text_by_hand(rows, share=0.05)))
    assert got == want
    assert not any(label in t or notice in t for i, _, t in got if i < 80 and not i % 2) and any(quote in t for _, _, t in got)


def test_suffix_array_orders_suffixes():
    x = np.array([2, 1, 2, 1, 0, 2, 1])
    order, ranks = html.suffix_array(x)
    assert [tuple(x[i:]) for i in order] == sorted(tuple(x[i:]) for i in range(len(x)))
    assert ranks[1][0] == ranks[1][2] and ranks[2][0] == ranks[2][5]
