"""Main text of web pages: suffix arrays over each host's pages find the boilerplate that markup does not name."""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, sliced

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|iframe|svg|math|object|head|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article.
OUTSIDE = frozenset("nav footer aside form button menu dialog header".split())
#: Parts of a class, id or role that say so.
ROLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|promo\w*|sponsor\w*|banner|cookies?|consent|notices?|popup|modal|overlay|newsletter|subscribe|signup|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommended|comments?|replies|reply|disqus|complementary|contentinfo|search|toolbar|pagination|pager)(?=$|[\s_-]|\d)", re.I)
MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def blocks(html: str) -> list[tuple[str, bool]]:
    """The page's blocks of text outside menus, adverts and the like, each with whether it is in an article or main element.

    Elements are matched as far as they are closed; a closing tag ends all that was opened inside its element, one that
    matches nothing is ignored.  Headers inside an article belong to it.
    """
    out: list[tuple[str, bool]] = []
    part: list[str] = []
    stack: list[tuple[str, str]] = []
    outside = inside = last = 0

    def close(before: bool) -> None:
        text = " ".join(unescape("".join(part)).split())
        part.clear()
        if text:
            out.append((text, before))

    for m in TOKEN.finditer(html):
        if m.start() > last and not outside:
            part.append(html[last : m.start()])
        last = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            part.append(" ")
            continue
        if m[2]:
            if name not in INLINE:
                close(inside > 0)
            if any(n == name for n, _ in reversed(stack)):
                while stack:
                    n, kind = stack.pop()
                    outside -= kind == "outside"
                    inside -= kind == "inside"
                    if n == name:
                        break
            continue
        said = m[4]
        if name not in INLINE:
            close(inside > 0)
            if name == "p":
                while stack and stack[-1][0] == "p":
                    outside -= stack.pop()[1] == "outside"
        kind = ""
        if (name in OUTSIDE and not (name == "header" and inside)) or (said and (any(ROLE.search(a or b or c) for a, b, c in MARK.findall(said)) or HIDDEN.search(said))) and name not in ("body", "html", "article", "main"):
            kind = "outside"
        elif name in ("article", "main"):
            kind = "outside" if said and any(re.search(r"comment|reply|related|promo|advert", a or b or c, re.I) for a, b, c in MARK.findall(said)) else "inside"
        if name in VOID or said.endswith("/"):
            continue
        if kind or name not in INLINE or outside:
            stack.append((name, kind))
            outside += kind == "outside"
            inside += kind == "inside"
    if not outside and last < len(html):
        part.append(html[last:])
    close(inside > 0)
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", (url or "").strip(), re.I)
    return m[1].lower() if m else ""


def suffix_array(x: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes of x in order, by their first ``depth`` numbers at least, and for each doubled length the ranks of the
    suffixes by so many first numbers."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    ranks, k, order = {1: rank}, 1, np.argsort(rank, kind="stable")
    while len(x) and k < (depth or len(x)) and rank.max() < len(x) - 1:
        after = np.full(len(x), -1, np.int64)
        after[: len(x) - k] = rank[k:]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.empty(len(x), np.int64)
        new[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        k *= 2
        rank = ranks[k] = new
    return order, ranks


class Shard:
    """The distinct contents of some of a host's pages as one stream of tokens, each page closed by a number of its own.

    Three kinds of units occur in it: runs of ``length`` tokens of one page, those that begin inside an article, and whole
    blocks outside articles.  ``at`` holds the places of each kind's occurrences, ``page`` their pages.
    """

    def __init__(self, bodies: list[bytes], counted: np.ndarray, length: int):
        self.length, self.counted = length, counted
        self.blocks = [unpacked(b) for b in bodies]
        index: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        texts: dict[str, int] = {}
        ids, inside, block, held = [], [], [], []
        for i, x in enumerate(self.blocks):
            for text, within in x:
                toks = text.split(" ")
                ids.append(np.fromiter(map(index.__getitem__, toks), np.int64, len(toks)))
                held.append(len(toks))
                inside.append(within)
                block.append(-1 if within else texts.setdefault(text, len(texts)))
            ids.append(np.array([-1 - i]))
            held.append(1)
            inside.append(False)
            block.append(-1)
        self.flat = np.concatenate(ids)
        self.held = np.array(held, np.int64)
        self.inside, self.block = np.repeat(np.array(inside, bool), self.held), np.array(block, np.int64)
        self.words, self.texts = index, texts
        last = self.flat < 0
        page, ends = np.cumsum(last) - last, np.flatnonzero(last)
        whole = ends[page] - np.arange(len(page)) >= length
        self.at = [np.flatnonzero(whole), np.flatnonzero(whole & self.inside), np.flatnonzero(self.block >= 0)]
        self.page = [page[self.at[0]], page[self.at[1]], page[(np.cumsum(self.held) - self.held)[self.at[2]]]]

    def numbers(self) -> list[np.ndarray]:
        """A number for each occurrence, the same for equal units: suffixes that share their first ``length`` tokens are
        neighbours in the suffix array of the stream and have one rank by so many tokens."""
        ranks = suffix_array(self.flat, self.length)[1]
        group = ranks.get(self.length, ranks[max(ranks)])
        return [group[self.at[0]], group[self.at[1]], self.block[self.at[2]]]

    def names(self) -> list[np.ndarray]:
        """64 bits for each occurrence that mean the same in every shard."""
        h = np.array([xxhash.xxh64_intdigest(w, 3) for w in self.words] or [0], np.uint64)
        token = h[np.maximum(self.flat, 0)]
        run = np.zeros(len(self.at[0]), np.uint64)
        for k in range(self.length):
            run = (run ^ token[self.at[0] + k]) * np.uint64(0x9E3779B97F4A7C15)
            run ^= run >> np.uint64(29)
        within = run[self.inside[self.at[0]]] * np.uint64(0xD6E8FEB86659FD93)
        text = np.array([xxhash.xxh64_intdigest(t, 4) for t in self.texts], np.uint64)
        return [run.astype(np.int64), within.astype(np.int64), text[self.block[self.at[2]]].astype(np.int64)]

    def tally(self, units: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct units and how many of the counted pages have each."""
        units, page = units[self.counted[page]], page[self.counted[page]]
        order = np.lexsort((page, units))
        u, p = units[order], page[order]
        new = np.append(True, (u[1:] != u[:-1]) | (p[1:] != p[:-1])) if len(u) else np.empty(0, bool)
        return np.unique(u[new], return_counts=True)

    def boilerplate(self, often: list[np.ndarray]) -> np.ndarray:
        """Which tokens of the stream the units cover that are ``often`` enough."""
        covers = []
        for at in (self.at[0][often[0]], self.at[1][often[1]]):
            edge = np.zeros(len(self.flat) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.length, -1)
            covers.append(np.cumsum(edge)[:-1] > 0)
        whole = np.zeros(len(self.held), bool)
        whole[self.at[2][often[2]]] = True
        return np.where(self.inside, covers[1], covers[0] | np.repeat(whole, self.held))

    def kept(self, gone: np.ndarray) -> list[str]:
        """The text of each content without the tokens that are gone."""
        out, k, at = [], 0, 0
        for x in self.blocks:
            left = []
            for text, _ in x:
                part = gone[at : at + self.held[k]]
                if not part.any():
                    left.append(text)
                elif not part.all():
                    left.append(" ".join(w for w, g in zip(text.split(" "), part) if not g))
                at, k = at + self.held[k], k + 1
            at, k = at + 1, k + 1
            out.append("\n\n".join(left))
        return out


def looked_up(units: np.ndarray, known: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n of each unit among the known ones, which are sorted; 0 for others."""
    if not len(known):
        return np.zeros(len(units), np.int64)
    at = np.minimum(np.searchsorted(known, units), len(known) - 1)
    return np.where(known[at] == units, n[at], 0)


def packed(found: list[tuple[str, bool]]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress("\n".join(f"{within:d}{text}" for text, within in found).encode("utf-8", "surrogatepass"))


def unpacked(body: bytes) -> list[tuple[str, bool]]:
    raw = zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass")
    return [(x[1:], x[0] == "1") for x in raw.split("\n")] if raw else []


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, c, size, body): a page's blocks outside menus, forms, scripts and the like, packed; their hash c and
    characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [blocks(h or "") for h in b.column(2).to_pylist()]
            host = pa.array([host_of(u) for u in b.column(1).to_pylist()], pa.string())
            body = [packed(x) for x in found]
            c = np.array([xxhash.xxh64_intdigest("\n".join(f"{w:d}{t}" for t, w in x).encode("utf-8", "surrogatepass")) for x in found], np.uint64).astype(np.int64)
            size = pa.array([sum(len(t) for t, _ in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), host, pa.array(c), size, pa.array(body, pa.binary())], names=["page_id", "url", "host", "c", "size", "body"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, host string, c long, size long, body binary")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table, marked for broadcast only if it has so few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def deal(parsed: DataFrame, shard_mb: float, few: int) -> tuple[DataFrame, DataFrame]:
    """The pages with their shard, and (host, shards, pages) of every host.

    A host's pages are dealt by content into shards of about ``shard_mb`` of text; pages counts its distinct contents.  Copies
    of a content beyond ``few`` spread over more shards; the content is counted in the first, where one of them always is.
    """
    parsed = parsed.withColumn("at", F.xxhash64("page_id", "url", F.spark_partition_id()))
    contents = materialize(parsed.groupBy("host", "c").agg(F.count("*").alias("n"), F.min("at").alias("least"), F.max("size").alias("size")))
    hosts = materialize(contents.groupBy("host").agg(F.count("*").alias("pages"), F.sum("size").alias("size")).select("host", "pages", F.greatest(F.lit(1), F.ceil(F.col("size") / (shard_mb * 1e6))).cast("long").alias("shards")))
    copied = materialize(contents.where(F.col("n") > few).select("host", "c", "least", F.ceil(F.col("n") / few).cast("long").alias("slots")))
    slot = F.when(F.col("slots").isNull() | (F.col("at") == F.col("least")), F.lit(0).cast("long")).otherwise(F.pmod("at", "slots"))
    dealt = parsed.join(small(hosts), "host").join(small(copied), ["host", "c"], "left").withColumn("slot", slot)
    shard = F.pmod(F.pmod(F.xxhash64("c"), F.col("shards")) + F.col("slot"), F.col("shards"))
    return dealt.select("host", shard.alias("shard"), "shards", "pages", (F.col("slot") == 0).alias("first"), "c", "page_id", "url", "body"), hosts


def main_text(pages: DataFrame, length: int = 8, share: float = 0.01, article_share: float = 0.5, shard_mb: float = 2, few: int = 1000) -> DataFrame:
    """(page_id, url, text) for every row of ``pages`` (page_id, url, html).

    Menus, headers, footers, sidebars, forms, adverts, notices and comments that the markup names are left out at once.  The
    rest of every page goes through the suffix arrays of its host: a run of ``length`` (a power of two) or more tokens, or a
    whole block, that is in ``share`` of the host's distinct contents, and in two at least, is boilerplate and removed; what is
    unique stays.  Articles quote and repeat each other, so inside an article or main element only runs that the articles of over
    ``article_share`` of the contents, and of five at least, have are boilerplate.

    A host is dealt by content into shards of about ``shard_mb`` of text.  A run that is in enough contents of the host is in
    its share of them in some shard, so shards propose such runs, each shard of the host then counts all that may still
    be in enough, and the sums decide: results do not depend on how a host is dealt.

    Null html and pages without text give an empty text; a null url is a host of its own; equal pages of a host are one content and
    get equal texts; extra columns are ignored; no rows give no rows.
    """
    dealt, hosts = deal(parse(pages), shard_mb, few)
    shards = dealt.groupBy("host", "shard")
    each = hosts.where("shards > 1").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))

    def opened(t: pa.Table) -> tuple[Shard, np.ndarray]:
        """A shard, and the place of each row's content in it."""
        c, row, place = np.unique(t.column("c").to_numpy(), return_index=True, return_inverse=True)
        first = np.zeros(len(c), bool)
        np.logical_or.at(first, place, t.column("first").to_numpy(zero_copy_only=False).astype(bool))
        return Shard([t.column("body")[int(i)].as_py() for i in row], first, length), place

    def told(host: str, keys: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table({"host": pa.array([host] * len(keys), pa.string()), "k": pa.array(keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    def enough(t: pa.Table) -> int:
        return max(2, math.ceil(share * t.column("pages")[0].as_py()))

    def propose(key: tuple, t: pa.Table) -> pa.Table:
        if t.column("shards")[0].as_py() == 1:
            return told("", np.empty(0), np.empty(0))
        s, _ = opened(t)
        least = -(-enough(t) // t.column("shards")[0].as_py())
        found = []
        for number, name, page in zip(s.numbers(), s.names(), s.page):
            units, n = s.tally(number, page)
            every, first = np.unique(number, return_index=True)
            found.append((name[first[np.searchsorted(every, units[n >= least])]], n[n >= least]))
        return told(key[0].as_py(), *map(np.concatenate, zip(*found)))

    def count(key: tuple, t: pa.Table, asked: pa.Table) -> pa.Table:
        if not t.num_rows or not asked.num_rows:
            return told("", np.empty(0), np.empty(0))
        s, _ = opened(t)
        wanted = np.sort(asked.column("k").to_numpy())
        found = []
        for name, page in zip(s.names(), s.page):
            met = looked_up(name, wanted, np.ones(len(wanted), np.int64)) > 0
            found.append(s.tally(name[met], page[met]))
        return told(key[0].as_py(), *map(np.concatenate, zip(*found)))

    def clean(key: tuple, t: pa.Table, sums: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(["page_id", "url"]).append_column("text", pa.array([], pa.string()))
        s, place = opened(t)
        least = [enough(t), max(5, math.floor(article_share * t.column("pages")[0].as_py()) + 1), enough(t)]
        if t.column("shards")[0].as_py() > 1:
            order = np.argsort(sums.column("k").to_numpy())
            known, n = (sums.column(c).to_numpy()[order] for c in ("k", "n"))
            found = [looked_up(name, known, n) for name in s.names()]
        else:
            found = [looked_up(number, *s.tally(number, page)) for number, page in zip(s.numbers(), s.page)]
        gone = s.boilerplate([n >= m for n, m in zip(found, least)])
        text = s.kept(gone)
        return pa.table({"page_id": t.column("page_id"), "url": t.column("url"), "text": pa.array([text[i] for i in place], pa.string())})

    kind = "host string, k long, n long"
    need = F.greatest(F.lit(2), F.ceil(F.col("pages") * share))
    most = F.col("n") + (F.col("shards") - F.col("of")) * (F.ceil(need / F.col("shards")) - 1)
    proposed = shards.applyInArrow(propose, kind).groupBy("host", "k").agg(F.sum("n").alias("n"), F.count("*").alias("of"))
    asked = proposed.join(hosts, "host").where(most >= need).select("host", "k").join(each, "host")
    counted = shards.cogroup(asked.groupBy("host", "shard")).applyInArrow(count, kind)
    sums = counted.groupBy("host", "k").agg(F.sum("n").alias("n")).where("n > 1").join(each, "host")
    return shards.cogroup(sums.groupBy("host", "shard")).applyInArrow(clean, "page_id long, url string, text string")
