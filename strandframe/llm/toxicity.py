"""Toxicity from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import isotonic, map_texts

#: Bound of the fitted index: labelled examples of each class, with all their terms.
EXAMPLES = 2000
NEIGHBOURS = 15
BLOCK = 64
#: Most terms that are kept dense, and queries that are multiplied with them at once; neither changes a result.
HEAD, BATCH = 512, 256
#: Distinct texts whose scores a Python worker remembers before it starts anew.
REMEMBER = 20_000

_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("neighbour_ids", pa.list_(pa.int64())), ("neighbour_cosines", pa.list_(pa.float64()))])
DDL = "doc_id long, score double, predicted int, neighbour_ids array<long>, neighbour_cosines array<double>"


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _slices(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``start[i]`` to ``start[i + 1]`` of every i, one after the other, and how many each has."""
    n = start[at + 1] - start[at]
    return np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


@dataclass
class BlockMaxIndex:
    """Unit vectors of the examples as an inverted index in blocks of example numbers.

    A term has an entry for each block that holds it, with its postings there and the largest
    of their weights. The ``HEAD`` terms of most postings, which nearly every query meets, are rows of a dense
    matrix and scored exactly for all blocks by one product for a batch of queries. A block's largest score so far and
    the sum of query weights times its entries' largest bound every cosine in the block, so the
    blocks of highest bounds are opened first and then only those whose bound reaches the
    k-th best cosine found: the result is the exact top k. Cosines count to 12 digits; ties go to the smaller example number.
    """

    n: int
    entries: np.ndarray  # first entry of each term, and the end
    block: np.ndarray
    top: np.ndarray
    postings: np.ndarray  # first posting of each entry, and the end
    number: np.ndarray
    weight: np.ndarray
    row: np.ndarray  # row of each term in the dense matrix, -1 for the others
    dense: np.ndarray  # terms x examples, filled up to whole blocks

    @classmethod
    def build(cls, weights: np.ndarray, head: int = HEAD) -> BlockMaxIndex:
        """From unit rows, examples x terms."""
        number, term = np.nonzero(weights)
        return cls.of(number, term, weights[number, term], *weights.shape, head)

    @classmethod
    def of(cls, number: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int, head: int = HEAD) -> BlockMaxIndex:
        df = np.bincount(term, minlength=terms)
        frequent = np.argsort(-df, kind="stable")[:head]
        frequent = frequent[df[frequent] > max(1, n // 64)]
        row = np.full(terms, -1)
        row[frequent] = np.arange(len(frequent))
        dense = np.zeros((len(frequent), -(-n // BLOCK) * BLOCK))
        own = row[term] >= 0
        dense[row[term[own]], number[own]] = weight[own]
        number, term, weight = number[~own], term[~own], weight[~own]
        order = np.lexsort((number, term))
        number, term, weight = number[order].astype(np.int32), term[order], weight[order]
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(number // BLOCK, prepend=-1) != 0))
        top = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        return cls(n, np.searchsorted(term[first], np.arange(terms + 1)), number[first] // BLOCK, top, np.append(first, len(number)), number, weight, row, dense)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For queries of term numbers and weights: numbers and cosines of the k nearest examples with a positive cosine."""
        out = []
        for lo in range(0, len(queries), BATCH):
            part = queries[lo : lo + BATCH]
            heads = np.zeros((len(part), len(self.dense)))
            for i, (ids, q) in enumerate(part):
                r = self.row[ids]
                heads[i, r[r >= 0]] = q[r >= 0]
            known = heads @ self.dense
            most = known.reshape(len(part), -1, BLOCK).max(axis=2) if self.n else known
            out += [self._best(ids, q, known[i], most[i], k, -1 if skip is None else skip[lo + i]) for i, (ids, q) in enumerate(part)]
        return out

    def _best(self, ids: np.ndarray, query: np.ndarray, known: np.ndarray, most: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        e, own = _slices(self.entries, ids)
        q, block = np.repeat(query, own), self.block[e]
        bound = most + np.bincount(block, q * self.top[e], len(most))
        order = np.argsort(-bound, kind="stable")
        best_n, best_s = np.zeros(0, np.int64), np.zeros(0)
        for todo in (order[:4], order[4:]):
            least = best_s[-1] - 1e-11 if len(best_s) == k else 0
            todo = todo[(bound[todo] > 0) & (bound[todo] >= least)]
            if not len(todo):
                continue
            use = np.zeros(len(most), bool)
            use[todo] = True
            inside = use[block]
            at, own = _slices(self.postings, e[inside])
            acc = (np.bincount(self.number[at], np.repeat(q[inside], own) * self.weight[at], len(known)) + known).reshape(-1, BLOCK)
            s = np.round(np.where(use[:, None], acc, 0).ravel(), 12)
            if skip >= 0:
                s[skip] = 0
            n = np.flatnonzero(s > least - 1e-11) if least else np.flatnonzero(s)
            n, s = np.concatenate([best_n, n]), np.concatenate([best_s, s[n]])
            if len(s) > k:
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                n, s = n[keep], s[keep]
            order = np.lexsort((n, -s))[:k]
            best_n, best_s = n[order], s[order]
        return best_n, best_s


@dataclass
class ToxicityModel:
    """The labelled examples with their term counts; every worker builds the index from them once."""

    terms: dict[str, int]
    idf: np.ndarray  # times the term's weight against the label
    ids: np.ndarray
    labels: np.ndarray
    importance: np.ndarray
    term: np.ndarray  # terms of the examples, one example after the other, and their counts
    count: np.ndarray
    ends: np.ndarray  # first place of each example, and the end
    knots: tuple[np.ndarray, np.ndarray]
    none: float

    @cached_property
    def index(self) -> BlockMaxIndex:
        weight = (1 + np.log(self.count.astype(float))) * self.idf[self.term]
        number = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.ends))
        weight /= np.sqrt(np.bincount(number, weight * weight, len(self.ids)))[number]
        return BlockMaxIndex.of(number, self.term, weight, len(self.ids), len(self.idf))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def own_votes(self, numbers: list[int]) -> list[float | None]:
        """Votes for examples from the others; null for those without a neighbour."""
        some = [k for k in numbers if self.ends[k] < self.ends[k + 1]]
        spans = [slice(self.ends[k], self.ends[k + 1]) for k in some]
        near = self.index.search([self.vector(self.term[x], self.count[x]) for x in spans], skip=some)
        found = {k: self.votes(n, s) for k, (n, s) in zip(some, near, strict=True) if len(n)}
        return [found.get(k) for k in numbers]

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids)
        ids = ids[order]
        w = (1 + np.log(counts[order].astype(float))) * self.idf[ids]
        return ids, w / (np.linalg.norm(w) or 1)

    def votes(self, n: np.ndarray, s: np.ndarray) -> float:
        """Share of toxic votes; a vote weighs the example's weight over its distance."""
        w = self.importance[n] / (1.05 - np.minimum(s, 1))
        return float((w * self.labels[n]).sum() / w.sum())

    def score(self, counts: list[dict[int, int]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, numbers and cosines of the nearest examples for the term counts of each text."""
        none = (self.none, np.zeros(0, np.int64), np.zeros(0))
        own = [k for k, c in enumerate(counts) if c]
        out = [none] * len(counts)
        queries = [self.vector(np.fromiter(counts[k], np.int64, len(counts[k])), np.fromiter(counts[k].values(), np.int64, len(counts[k]))) for k in own]
        for k, (n, s) in zip(own, self.index.search(queries), strict=True):
            if len(n):
                out[k] = (float(np.interp(self.votes(n, s), *self.knots)), n, s)
        return out


def _counts(text: str | None, get) -> Counter:
    """Counts of the numbers that ``get`` gives to the tokens of a text."""
    c = Counter(map(get, tokens(text)))
    c.pop(None, None)
    return c


def _term_counts(docs: DataFrame, terms) -> DataFrame:
    """``doc_id, y, t, n``: numbers and counts of the terms in each whole text."""

    def run(batches):
        get = terms.value.get
        for b in batches:
            t, n = [], []
            for text in b.column(2).to_pylist():
                c = _counts(text, get)
                t.append(list(c))
                n.append(list(c.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["doc_id", "y", "t", "n"])

    return docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, t array<int>, n array<int>")


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> ToxicityModel:
    """Build the index from a bounded sample of labelled rows.

    ``train`` is a condition on ``id_col``. The sample has up to ``examples`` rows of each
    class, by hash of the id, and their whole texts; several labels of a document count as
    their largest, null labels as none. All terms of these texts are indexed; one weighs its IDF
    times 1 + the root of its chi-square against the label in the sample, so none is left
    out and telling ones lead. Document frequencies for the IDF come from every row
    of ``docs``. An example speaks for as many rows as its class has for
    each sampled one. Of several texts under one id the least is the example. Calibration is isotonic over leave-one-out votes of the examples.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y")).where(train)
    population = {r.y: r.n for r in ids.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        picked = part if picked is None else picked.unionByName(part)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # a repeated id is one example

    def presence(batches):
        for b in batches:
            c: Counter = Counter()
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c.update((y, w) for w in {*tokens(t), ""})
            yield pa.RecordBatch.from_arrays([pa.array([w for _, w in c]), pa.array([n if y else 0 for (y, _), n in c.items()], pa.int64()), pa.array([0 if y else n for (y, _), n in c.items()], pa.int64())], names=["w", "pos", "neg"])

    seen = sample.mapInArrow(presence, "w string, pos long, neg long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow().sort_by("w")
    words, pos, neg = seen.column(0).to_pylist(), *(seen.column(c).to_numpy().astype(float) for c in (1, 2))
    n1, n0 = (pos[0], neg[0]) if words else (0.0, 0.0)  # the empty word stands first and counts the examples
    total = population.get(1, 0) + population.get(0, 0)
    base = (population.get(1, 0) + 0.5) / (total + 2)
    vocab = {w: k for k, w in enumerate(words[1:])} if n1 and n0 else {}
    if not vocab:
        none = np.zeros(0, np.int64)
        return ToxicityModel({}, np.zeros(0), none, np.zeros(0), np.zeros(0), none, none, np.zeros(1, np.int64), (np.array([0.0]), np.array([base])), base)

    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    n, pos, neg = n1 + n0, pos[1:], neg[1:]
    chi = n * (pos * (n0 - neg) - neg * (n1 - pos)) ** 2 / np.maximum(n1 * n0 * (pos + neg) * (n - pos - neg), 1.0)

    def frequency(batches):
        c: Counter = Counter()
        have = sent.value.keys()
        for b in batches:
            for t in b.column(0).to_pylist():
                c[""] += 1
                c.update(have & set(tokens(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])

    found = text.select("text").mapInArrow(frequency, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    df, every = np.zeros(len(vocab)), 0
    for w, c in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        if w:
            df[vocab[w]] = c
        else:
            every = c
    idf = (np.log((1 + every) / (1 + df)) + 1) * (1 + np.sqrt(chi))
    rows = _term_counts(sample, sent).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    sent.destroy()
    ends = np.concatenate([[0], np.cumsum(rows.column("t").combine_chunks().value_lengths().to_numpy())])
    term, count = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("t", "n"))
    y = rows.column("y").to_numpy().astype(float)
    share = np.where(y > 0, population.get(1, 0) / n1, population.get(0, 0) / n0)
    m = ToxicityModel(vocab, idf, rows.column("doc_id").to_numpy(), y, share, term, count, ends, (np.array([0.0]), np.array([base])), base)
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def votes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.own_votes(b.column(0).to_pylist()), pa.float64())], names=["k", "raw"])

    own = docs.sparkSession.range(0, rows.num_rows, 1, -(-rows.num_rows // BATCH)).toDF("k").mapInArrow(votes, "k long, raw double").toArrow().sort_by("k")
    sent.destroy()
    raw = own.column("raw").fill_null(-1.0).to_numpy()
    bare = raw < 0
    m.none = float(((share * y)[bare].sum() + base) / (share[bare].sum() + 1))
    if (~bare).any():
        xs, ys = isotonic(raw[~bare], y[~bare], share[~bare])
        mass = share[~bare].sum()
        m.knots = (xs, (ys * mass + base) / (mass + 1))  # never quite 0 or 1
    return m


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: ``doc_id, score, predicted`` and the evidence, ids and cosines of the nearest examples.

    Columns named in ``keep`` come back untouched in a struct ``kept``, so that rows can be decided without a join.

    A text without any term of the index (null and empty ones too) gets the rate of such
    texts among the examples and no evidence. Repeated rows score alike, an empty table
    gives no rows, and other columns are ignored. Terms that stand in no example can match nothing
    and are not in the norm. The index is bounded by ``EXAMPLES`` and is sent to each executor once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, known = sent.value, {}
        get = m.terms.get
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, BATCH):
                texts = b.column(1).slice(lo, BATCH).to_pylist()
                keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                if len(known) > REMEMBER:
                    known.clear()
                fresh = {k: _counts(t, get) for k, t in dict(zip(keys, texts, strict=True)).items() if k not in known}
                for k, (p, n, s) in zip(fresh, m.score(list(fresh.values())), strict=True):
                    known[k] = (p, int(p >= 0.5), m.ids[n].tolist(), s.tolist())
                out += [known[k] for k in keys]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in out], SCHEMA.field(c + 1).type) for c in range(4)), *b.columns[2:]], names=SCHEMA.names + b.schema.names[2:])

    return map_texts(docs, run, DDL, id_col, text_col, keep)
