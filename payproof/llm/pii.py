"""Personal data: strict patterns, generous candidates around them, and boosted trees that choose among the candidates."""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, sliced

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end, in code points; the end is exclusive
FOUND = "found array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"

# Strict patterns.  Look-behinds and the walk around "@" only keep long runs from being tried from each of their characters.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generous patterns, all of bounded length: what writers put in place of "@", of dots and of separators.
AT = re.compile(r"\s?[(\[{<]\s?(?:at|@)\s?[)\]}>]\s?|\sat\s|\s?@\s?", re.I)
DOT = r"(?:\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\s?\.\s?)"
LOOSE_DOMAIN = re.compile(rf"[\w-]{{1,63}}(?:(?:\.|\s?[(\[{{<]\s?(?:dot|\.)\s?[)\]}}>]\s?|\sdot\s)[\w-]{{1,63}}){{1,5}}", re.I)
# These three stand in look-aheads, so that a span is proposed from each group of digits it may start with.
LOOSE_IP = re.compile(rf"(?<![0-9.])(?=([0-9]{{1,3}}(?:(?:{DOT}|,)[0-9]{{1,3}}){{3}}(?![0-9])))", re.I)
LOOSE_CARD = re.compile(r"(?<![0-9])(?=([0-9](?:[ ._/\-]{0,2}[0-9]){12,21}(?![0-9])))")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?=([(0-9][0-9 ().\-/]{5,22}[0-9](?![0-9])))")

#: Words that announce a kind, or a number that is none of them.
HINTS = (
    re.compile(r"mail|contact|write|reach", re.I),
    re.compile(r"\bip\b|host|server|address|addr", re.I),
    re.compile(r"card|visa|credit|debit|payment", re.I),
    re.compile(r"phone|tel|call|fax|mobile|cell", re.I),
    re.compile(r"token|key|order|ref|invoice|sku|serial|version|id\b|isbn|no\.", re.I),
)
DIGITS = re.compile(r"[0-9]+")

#: More than the values of any feature: the longest candidate, an address of six words of 63 letters and what joins them, has
#: fewer characters.
MOST_VALUES = 1024


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap, less those whose parts, digits or check digit are wrong."""
    out: list[Span] = [(0, *s) for s in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = "".join(DIGITS.findall(m.group()))
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 10 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
                out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


class Taken:
    """Stretches of a text, and whether a span overlaps one of them: found by bisection."""

    def __init__(self, spans: list[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in spans:  # by start; those that overlap become one
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, span: Span) -> bool:
        at = bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]

    def add(self, span: Span) -> None:
        at = bisect_left(self.starts, span[1])
        self.starts.insert(at, span[1])
        self.ends.insert(at, span[2])


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal data in a form that the strict patterns leave out; they may overlap each other but no
    base span.  Recall matters here, the trees see to the rest."""
    out: list[Span] = []
    for m in AT.finditer(text):
        start = m.start()
        while start > max(0, m.start() - 64) and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        right = LOOSE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if right:
            out.append((0, start, right.end()))
    if DIGITS.search(text):
        out += [(1, *m.span(1)) for m in LOOSE_IP.finditer(text)]
        out += [(2, *m.span(1)) for m in LOOSE_CARD.finditer(text)]
        out += [(3, *m.span(1)) for m in LOOSE_PHONE.finditer(text) if 7 <= sum(map(len, DIGITS.findall(m.group(1)))) <= 15]
    strict = Taken(base)
    return [s for s in out if not strict.overlaps(s)]


def kind_of_char(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 4 if c in "\"'=#:/" else 3


def features(text: str, span: Span) -> list[float]:
    """Format (kind, lengths, groups, separators, checks) and context (neighbours, digits and hints around)."""
    kind, start, end = span
    s, left, right = text[start:end], text[max(0, start - 32) : start], text[end : end + 32]
    groups = DIGITS.findall(s) if kind else re.findall(r"[\w-]+", s)
    sizes = [len(g) for g in groups]
    digits = "".join(DIGITS.findall(s))
    between = [c for c in s if not c.isalnum()]
    n_digits = sum(c.isdigit() for c in s)
    format_ = [float(kind == k) for k in range(4)] + [len(s), n_digits, sum(c.isalpha() for c in s), len(between), len(set(between)), len(sizes), max(sizes), min(sizes), sizes[0], sizes[-1]]
    format_ += [s.startswith("00"), "(" in s or "[" in s, bool(digits) and luhn(digits), kind == 1 and all(len(g) <= 3 and int(g) <= 255 for g in groups), len(set(digits)), " " in s, s.count("."), s.count(","), s.count("/"), s.count("_"), "@" in s, groups[-1].isalpha(), kind == 0 and groups[-2:-1] == ["dot"]]
    context = [kind_of_char(left[-1:]), kind_of_char(right[:1]), sum(c.isdigit() for c in left), sum(c.isdigit() for c in right), *(bool(h.search(left)) for h in HINTS), bool(HINTS[kind].search(left))]
    return [float(x) for x in format_ + context]


def loosened(kind: int, s: str, rng: random.Random) -> str:
    """The same data as a writer might disguise or misspell it."""
    digits = "".join(DIGITS.findall(s))
    if kind == 0:
        local, domain = s.split("@", 1)
        return local + rng.choice([" at ", " (at) ", "[at]", "(at)", " [at] ", " @ "]) + domain.replace(".", rng.choice([".", " dot ", " (dot) ", "[.]", "[dot]"]))
    if kind == 1:
        return s.replace(".", rng.choice(["[.]", " . ", "(.)", " dot ", "[dot]", ","]))
    if kind == 2:
        return rng.choice([".", "/", "_", "--", ". "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}-{b}-{c}", f"{digits[:-10]} {a} {b} {c}".strip(), f"00{digits[:-10]} {a} {b} {c}", f"{a}/{b}-{c}"])


def rewritten(text: str, base: list[Span], rng: random.Random) -> tuple[str, set[Span]]:
    """``text`` with its base spans in looser forms, and where those are; a span inside an earlier one stays."""
    parts, at, size, out = [], 0, 0, set()
    for kind, start, end in base:
        if start < at:
            continue
        new = loosened(kind, text[start:end], rng)
        parts += [text[at:start], new]
        size += start - at
        out.add((kind, size, size + len(new)))
        size, at = size + len(new), end
    return "".join([*parts, text[at:]]), out


@dataclass
class Trees:
    """Boosted trees as arrays (a node's feature is -1 at a leaf) and a threshold per kind; infinite: nothing is added."""

    weight: list[float] = field(default_factory=list)
    nodes: list[list[np.ndarray]] = field(default_factory=list)  # feature, threshold, left, right, value
    thresholds: list[float] = field(default_factory=lambda: [math.inf] * len(KINDS))

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for w, (feature, cut, left, right, value) in zip(self.weight, self.nodes, strict=True):
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            margin += w * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def trees_of(model: GBTClassificationModel) -> Trees:
    out = Trees(list(model.treeWeights))
    for tree in model.trees:
        rows: list[list[float]] = []

        def walk(node, rows: list[list[float]] = rows) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        f, c, left, right, v = zip(*rows, strict=True)
        out.nodes.append([np.array(f, int), np.array(c), np.array(left, int), np.array(right, int), np.array(v)])
    return out


def lowest_bound(hits: int, all_: int, z: float) -> float:
    """Wilson's lower bound of a share."""
    if not all_:
        return 0.0
    p, zz = hits / all_, z * z / all_
    return (p + zz / 2 - z * math.sqrt((p * (1 - p) + zz / 4) / all_)) / (1 + zz)


def fit(docs: DataFrame, variants: int = 4, precision: float = 0.9, z: float = 1.28, trees: int = 12, depth: int = 4) -> Trees:
    """Boosted trees over the candidates of all documents, whose texts are read whole.

    There are no labelled spans, so the strict patterns teach: each of ``variants`` copies of a text with base spans has
    them rewritten in looser forms, which are the positive candidates; all others, those of the text as it is included, are
    negative.  Three fifths of the documents train Spark's gradient-boosted trees; on the others each kind gets the lowest
    threshold at which the share of true candidates is ``precision`` by the lower bound of its interval, or none.
    Candidates alike in part, kind, label and features are one row with a weight.  Nothing is sampled: Spark takes its split
    places from all rows where ``maxBins`` squared is at least their number, and every value is one where it exceeds the values
    of each feature.  Null and empty texts have no candidates, repeated rows count each.  Without candidates of both sorts
    nothing is ever added.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    part = F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(5))
    texts = docs.where(F.col("text").isNotNull()).select(doc_id.alias("doc_id"), part.cast("int").alias("part"), "text")

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for doc_id, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base = base_spans(text)
                versions = [(text, base, set())]
                for v in range(variants if base else 0):
                    new, planted = rewritten(text, base, random.Random(f"{doc_id}/{v}"))
                    versions.append((new, base_spans(new), planted))
                rows += [(part, s[0], float(s in planted), features(t, s)) for t, strict, planted in versions for s in candidates(t, strict)]
            names = ["part", "kind", "label", "x"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=names)

    rows = materialize(texts.mapInArrow(examples, "part int, kind int, label double, x array<double>").groupBy("part", "kind", "label", "x").agg(F.count("*").cast("double").alias("n")))
    learn = rows.where("part < 3")
    if learn.select("label").distinct().count() < 2:
        return Trees()
    bins = max(MOST_VALUES, math.isqrt(learn.count()) + 1)
    booster = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=bins, weightCol="n", seed=13, checkpointInterval=-1)
    out = trees_of(booster.fit(learn.select(array_to_vector("x").alias("features"), "label", "n")))

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("x").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.floor(out.scores(x) * 1000).astype(np.int32))], names=["kind", "label", "n", "grade"])

    counts = F.sum("n").cast("long").alias("n")
    grades = rows.where("part >= 3").select("kind", "label", "n", "x").mapInArrow(graded, "kind int, label double, n double, grade int").groupBy("kind", "label", "grade").agg(counts).collect()
    for k in range(len(KINDS)):
        hits = all_ = 0
        for grade in sorted({r["grade"] for r in grades if r["kind"] == k}, reverse=True):
            hits += sum(r["n"] for r in grades if (r["kind"], r["grade"], r["label"]) == (k, grade, 1.0))
            all_ += sum(r["n"] for r in grades if (r["kind"], r["grade"]) == (k, grade))
            if lowest_bound(hits, all_, z) >= precision:
                out.thresholds[k] = grade / 1000
    return out


def select(text: str, model: Trees) -> list[tuple[Span, float, bool]]:
    """Base spans, and the candidates at or above their kind's threshold, the best first where some overlap."""
    base = base_spans(text)
    out = [(s, 1.0, True) for s in base]
    if model.nodes and (found := candidates(text, base)):
        scores = model.scores(np.array([features(text, s) for s in found]))
        taken = Taken()
        for score, s in sorted(zip(scores.tolist(), found, strict=True), key=lambda x: (-x[0], x[1][1], x[1][0], x[1][2])):
            if score >= model.thresholds[s[0]] and not taken.overlaps(s):
                taken.add(s)
                out.append((s, score, False))
    return sorted(out, key=lambda x: (x[0][1], x[0][0]))


def find_private(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, found): the personal data of every row, by start and then kind, in code points of its whole text.

    Base spans, which may overlap across kinds, are all there; added ones overlap nothing.  Null and empty texts have none;
    very long texts are read whole in time that follows their length; repeated rows get equal results; other columns are
    ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
        for b in sliced(batches):
            found = [[{"kind": KINDS[k], "start": i, "end": j, "score": score, "base": base} for (k, i, j), score, base in select(t or "", model)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {FOUND}")


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans becomes the name of its first span's kind, in brackets."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; null stays null, all other columns stay, whatever their names."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain, at = docs.toDF(*names), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            new = [None if t is None else redacted(t, [s for s, _, _ in select(t, model)]) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(new, pa.string()), *b.columns[at + 1 :]], names=names)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
