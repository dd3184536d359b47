"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, slice int, chunk string, fp string"


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with columns whose names the operators use themselves."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "k", 2, "c", "f") for i, t, lang, s in full], DOCS)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n))


def awkward(seed=1):
    long_text = prose(seed + 1, 6000)
    base = [(1, prose(seed, 120)), (2, prose(seed + 2, 80) + "\n" + prose(seed, 120)), (3, None), (4, ""), (5, " \t\n "), (6, long_text), (7, long_text), (8, "tiny"), (8, "tiny"), (None, prose(seed, 120)), (None, None), (9, "é ü 漢字 \U0001f600 " + prose(seed, 60)), (10, "In " * 300), (11, "a\nb\na\nb\n" * 30)]
    return [(i, t, "en" if t else None, f"s{(i or 0) % 3}" if i != 4 else None) for i, t in base]
