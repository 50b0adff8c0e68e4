"""Main text of pages: block structure first, a suffix array per host for pages without a marked article."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.plans.session import materialize

#: Least length, in tokens, of a run that two pages of a host share for it to count as boilerplate.
REPEAT = 8
#: Tokens of one suffix array; the runs of a host with more are counted by their hashes instead.
HOST_TOKENS = 250_000
#: Parts of each repeated run's key when its mark is joined back, since a menu may stand on every page of a host.
SALTS = 16

_DROP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template", "iframe", "button", "select", "svg", "canvas", "object", "head", "menu", "dialog"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "tr", "ul"}
#: Whole names, of a class or id, of parts that are no article text; ``social-history`` or ``post-header`` is none of them.
_NOISE = re.compile(
    r"(?:^|\s)(?:(?:site|page|global|top|bottom|user|reader|main)[_-])?"
    r"(?:ad|ads|advert\w*|banner|comments?|cookies?|disqus|footer|header|menu|nav|navbar|navigation|newsletter|notice|popup|promo|promotion|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|widget)"
    r"(?:[_-](?:area|articles|banner|bar|block|box|buttons?|consent|container|footer|form|header|icons?|links?|list|menu|nav|notice|posts|section|slot|stories|thread|unit|widget|wrapper))*(?=$|\s)", re.I,
)
_SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Blocks of text outside of dropped elements, and which of them lie in an article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.dropped = self.inside = 0
        self.text: list[str] = []
        self.blocks: list[tuple[str, bool]] = []
        self.articles = 0

    def flush(self) -> None:
        t = _SPACE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if t:
            self.blocks.append((t, self.inside > 0))

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
        if tag in _VOID:
            return
        main = tag in ("article", "main")
        a = dict(attrs)
        noise = tag in _DROP or (not main and tag not in ("html", "body") and bool(_NOISE.search(f"{a.get('class') or ''} {a.get('id') or ''} {a.get('role') or ''}")))
        # an article within dropped parts, such as a reader's comment, stays dropped
        self.stack.append((tag, noise))
        self.dropped += noise
        if main:
            self.inside += 1
            self.articles += not self.dropped

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        if tag in _VOID or all(t != tag for t, _ in self.stack):
            return
        while self.stack:
            t, noise = self.stack.pop()
            self.dropped -= noise
            self.inside -= t in ("article", "main")
            if t == tag:
                break

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)


def blocks(html: str | None) -> tuple[list[str], bool]:
    """Candidate blocks in page order and whether the page marks its article."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    if p.articles:
        return [t for t, own in p.blocks if own], True
    return [t for t, _ in p.blocks], False


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix order by doubling ranks."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:] if k < n else []
        order = np.lexsort((second, rank))
        step = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(step)])
        rank = fresh
        if rank.max() == n - 1 or k >= n:
            return order
        k *= 2


def repeated(pages: list[list[str]], least: int = REPEAT) -> list[np.ndarray]:
    """For each page's tokens, marks of those covered by a run of ``least`` tokens or more that another page holds too."""
    ids: dict[str, int] = {}
    stream, owner = [], []
    for k, page in enumerate(pages):
        stream += [ids.setdefault(t, len(ids) + len(pages)) for t in page] + [k]  # a page's own end never repeats
        owner += [k] * (len(page) + 1)
    x, own = np.array(stream, np.int64), np.array(owner, np.int64)
    covered = np.zeros(len(x) + 1, np.int64)
    if len(pages) > 1:
        order = suffix_array(x)
        a, b = order[:-1], order[1:]
        same = np.ones(len(a), bool)
        for d in range(least):  # common prefix of neighbours, as far as the least length
            i, j = a + d, b + d
            ok = (i < len(x)) & (j < len(x))
            same &= ok & (x[np.minimum(i, len(x) - 1)] == x[np.minimum(j, len(x) - 1)])
        group = np.concatenate([[0], np.cumsum(~same)])
        first = np.full(group.max() + 1, len(pages), np.int64)
        last = np.full(group.max() + 1, -1, np.int64)
        np.minimum.at(first, group, own[order])
        np.maximum.at(last, group, own[order])
        hit = order[first[group] != last[group]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, np.minimum(hit + least, len(x)), -1)
    mark = np.cumsum(covered)[:-1] > 0
    out, at = [], 0
    for page in pages:
        out.append(mark[at : at + len(page)])
        at += len(page) + 1
    return out


def _unrepeated(own: list[str], mark: np.ndarray) -> str:
    """The blocks that are not mostly covered by marks, in order."""
    keep, at = [], 0
    for t in own:
        n = len(t.split())
        if 2 * mark[at : at + n].sum() <= n:
            keep.append(t)
        at += n
    return "\n".join(keep)


def _by_suffix_array(rest: DataFrame) -> DataFrame:
    """Texts of pages of hosts that fit in one suffix array each."""

    def host(f):
        own = dict(zip(f.key, f.blocks))  # a repeated row is no other page
        marks = repeated([[w for t in x for w in t.split()] for x in own.values()])
        text = {k: _unrepeated(x, m) for (k, x), m in zip(own.items(), marks, strict=True)}
        return f[["page_id", "url"]].assign(text=f.key.map(text))

    return rest.groupBy("host").applyInPandas(host, "page_id long, url string, text string")


def _by_hashes(rest: DataFrame, least: int = REPEAT) -> DataFrame:
    """The same for hosts of any size: hashes of token runs are counted by page over the whole host and their marks joined back."""
    digest = xxhash.xxh3_128_digest

    def runs(batches):
        for b in batches:
            for host, key, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = [x for t in own for x in t.split()]
                n = max(0, len(w) - least + 1)
                run = [digest(" ".join([host, *w[i : i + least]]).encode("utf-8", "surrogatepass")) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(run, pa.binary()), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int32())], names=["run", "key", "at"])

    found = rest.select("host", "key", "blocks").mapInArrow(runs, "run binary, key long, at int")
    shared = found.groupBy("run").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    shared = shared.select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    marks = found.withColumn("salt", F.pmod("key", F.lit(SALTS))).join(shared, ["run", "salt"], "left_semi").groupBy("key").agg(F.collect_set("at").alias("at"))

    def clean(batches):
        for b in batches:
            texts = []
            for own, at in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                mark = np.zeros(sum(len(t.split()) for t in own), bool)
                for i in at or ():
                    mark[i : i + least] = True
                texts.append(_unrepeated(own, mark))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rest.join(marks, "key", "left").select("page_id", "url", "blocks", "at").mapInArrow(clean, "page_id long, url string, text string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every whole page.

    A page that marks its article (``article`` or ``main`` outside of dropped parts) gives the
    article's blocks. Repeated runs say nothing there: articles quote each other and menus differ,
    so the suffix array alone cannot give the article (see the README). Of pages without the
    mark, blocks mostly covered by runs that other such pages of the host repeat are removed, the
    rest is kept in order. Runs are sought over the whole host: in one suffix array up to
    ``HOST_TOKENS``, by distributed counts of their hashes above it, with the same result.
    Null, empty and textless html gives an empty text; repeated rows (id and html) are one page and
    give repeated results; other columns are ignored.
    """
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))

    def parse(batches):
        for b in batches:
            texts, rest, n = [], [], []
            for h in b.column(4).to_pylist():
                own, marked = blocks(h)
                done = marked or not own
                texts.append("\n".join(own) if done else None)
                rest.append(None if done else own)
                n.append(0 if done else sum(len(t.split()) for t in own))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(texts, pa.string()), pa.array(rest, pa.list_(pa.string())), pa.array(n, pa.int64())], names=["page_id", "url", "host", "key", "text", "blocks", "n"])

    parsed = d.select("page_id", "url", host.alias("host"), F.xxhash64("page_id", "html").alias("key"), "html").mapInArrow(parse, "page_id long, url string, host string, key long, text string, blocks array<string>, n long")
    parsed = materialize(parsed, "html")
    out = parsed.where("text IS NOT NULL").select("page_id", "url", "text")
    rest = parsed.where("text IS NULL").drop("text")
    sizes = rest.groupBy("host").agg(F.sum("n").alias("n")).select("host", F.col("n").alias("size"))
    large = sizes.where(F.col("size") > HOST_TOKENS)
    if not rest.isEmpty():
        out = out.unionByName(_by_suffix_array(rest.join(large, "host", "left_anti")))
        if not large.isEmpty():
            out = out.unionByName(_by_hashes(rest.join(large, "host", "left_semi")))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
