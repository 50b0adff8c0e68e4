"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the fitting sample: documents of each language.
SAMPLE = 400
ROUNDS = 3
SMOOTH = 200.0
#: Cells of one lattice, starts by ends by words, in training; bounds memory for long words.
LATTICE = 4_000_000
START = "▁"
#: Distinct words whose scores a Python worker remembers before it starts anew.
REMEMBER = 400_000

_WORD = re.compile(r"[^\W\d_]+")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def vocabulary(model_file: str) -> list[str]:
    """All pieces of a public sentencepiece file that can stand in a word: lower case and letters only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == p.lower() and (p.lstrip(START).isalpha() or p == START))


def words(text: str | None) -> Counter:
    """Counts of the lower-case runs of letters, each with the mark of a word's start."""
    return Counter(START + w for w in _WORD.findall((text or "").lower()) if w[0].isalpha() or w.isalpha())


class Lattice:
    """Sums over segmentations of words into pieces of a vocabulary.

    A character outside the vocabulary stands as a piece of its own with number 0.
    """

    def __init__(self, pieces: list[str]):
        self.number = {p: k + 1 for k, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)

    def edges(self, batch: list[str], n: int) -> list[list[tuple[int, np.ndarray]]]:
        """For each end j: starts i with the piece numbers of batch[:, i:j], -1 where it is no piece. All words have n characters."""
        get = self.number.get
        out = []
        for j in range(1, n + 1):
            own = []
            for i in range(max(0, j - self.longest), j):
                miss = 0 if j - i == 1 else -1
                ids = np.fromiter([get(w[i:j], miss) for w in batch], np.int64, len(batch))
                if j - i == 1 or (ids >= 0).any():
                    own.append((i, ids))
            out.append(own)
        return out

    def log_likelihood(self, batch: list[str], n: int, p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, words x languages; p: languages in columns, pieces in rows, last row zeros."""
        alpha = {0: np.ones((len(batch), p.shape[1]))}
        log = np.zeros((len(batch), p.shape[1]))
        for j, own in enumerate(self.edges(batch, n), 1):
            a = np.zeros_like(log)
            for i, ids in own:
                a += alpha[i] * p[ids]
            log += np.log(a)
            alpha.pop(j - self.longest, None)
            for x in alpha.values():  # so that alpha at j is 1 and nothing underflows in long words
                x /= a
            alpha[j] = np.ones_like(a)
        return log

    def expected(self, counts: dict[str, float], p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words under probabilities p, by forward and backward sums.

        Forward sums are scaled to 1 at every end and backward sums by the same factors, so words of any length count.
        """
        total = np.zeros(len(p))
        by_length: dict[int, list[str]] = {}
        for w in counts:
            by_length.setdefault(len(w), []).append(w)
        for n, words_ in by_length.items():
            step = max(1, LATTICE // (n * self.longest))
            for lo in range(0, len(words_), step):
                batch = words_[lo : lo + step]
                edges = self.edges(batch, n)
                # f[i] and b[i] hold the sums over the product of the scales from each start to j and from j on
                scale, f, b = np.ones((n + 1, len(batch))), np.zeros((n + 1, len(batch))), np.zeros((n + 1, len(batch)))
                f[0] = b[n] = 1
                since = np.ones((self.longest + 1, len(batch)))  # product of the scales of the last ends, the newest first
                for j, own in enumerate(edges, 1):
                    for i, ids in own:
                        f[j] += f[i] * p[ids] / since[j - i - 1]
                    scale[j] = f[j]
                    f[j] = 1
                    since[1:] = since[:-1] * scale[j]
                    since[0] = 1
                weight = np.array([counts[w] for w in batch])
                for j in range(n, 0, -1):
                    reach = np.ones(len(batch))
                    at = j
                    for i, ids in sorted(edges[j - 1], key=lambda e: -e[0]):
                        while at > i:
                            reach = reach * scale[at]
                            at -= 1
                        use = p[ids] * b[j] / reach
                        b[i] += use
                        np.add.at(total, ids, weight * f[i] * use)
        total[-1] = 0
        return total


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[str]
    key: str  # names the model in a worker
    p: np.ndarray  # one row per piece after row 0 for unknown characters, one column per language; the last row is zero


def fit(docs: DataFrame, train: Column, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> LanguageModel:
    """Learn piece probabilities of each language by expectation maximisation.

    The sample is up to ``sample`` documents of each non-null language, by hash of the id,
    among those that ``train`` takes; their whole texts count. Word counts stay distributed; each
    round returns expected counts, at most pieces x languages numbers, to the driver.
    Probabilities are smoothed towards the mean of the languages.
    """
    spark = docs.sparkSession
    pieces = vocabulary(model_file)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    languages = sorted(r.lang for r in d.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], pieces, uuid.uuid4().hex, np.zeros((len(pieces) + 2, 0)))
    ids = None
    for x in languages:
        part = d.where(F.col("lang") == x).select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)
    texts = d.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in words(t).items():
                    c[x, w] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "w", "n"])

    counts = texts.mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).persist()
    v = len(pieces) + 2
    start = np.array([0.01, *(1.0 / len(x) ** 2 for x in pieces), 0.0])
    p = np.repeat((start / start.sum())[:, None], len(languages), axis=1)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((languages, pieces, p))

        def expect(batches, sent=sent):
            langs, own, prob = sent.value
            lattice, got = Lattice(own), {}
            for b in batches:
                by: dict[str, dict[str, float]] = {}
                for x, w, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    by.setdefault(x, {})[w] = n
                for x, c in by.items():
                    k = langs.index(x)
                    got[k] = got.get(k, 0) + lattice.expected(c, np.ascontiguousarray(prob[:, k]))
            for k, e in got.items():
                at = np.flatnonzero(e)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(e[at])], names=["k", "i", "e"])

        e = np.zeros((v, len(languages)))
        for r in counts.mapInArrow(expect, "k int, i int, e double").groupBy("k", "i").agg(F.sum("e").alias("e")).toLocalIterator():
            e[r.i, r.k] = r.e
        mean = (e / np.maximum(e.sum(0), 1e-9)).mean(1) + 1e-9
        mean[-1] = 0
        p = (e + SMOOTH * (mean / mean.sum())[:, None]) / (e.sum(0) + SMOOTH)
    counts.unpersist()
    return LanguageModel(languages, pieces, uuid.uuid4().hex, p)


class _Scorer:
    def __init__(self, m: LanguageModel):
        self.m, self.lattice, self.known = m, Lattice(m.pieces), {}
        self.rows = np.zeros((0, len(m.languages)))

    def learn(self, fresh: set[str]) -> None:
        if len(self.known) + len(fresh) > REMEMBER:
            self.known, self.rows = {}, self.rows[:0]
        by_length: dict[int, list[str]] = {}
        for w in fresh:
            by_length.setdefault(len(w), []).append(w)
        new, base = [], len(self.rows)
        for n, batch in by_length.items():
            new.append(self.lattice.log_likelihood(batch, n, self.m.p))
            for w in batch:
                self.known[w] = base
                base += 1
        self.rows = np.concatenate([self.rows, *new])

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for lo in range(0, len(texts), 256):
            counts = [words(t) for t in texts[lo : lo + 256]]
            distinct = set().union(*counts) if counts else set()
            fresh = distinct - self.known.keys()
            if fresh:
                if len(self.known) + len(fresh) > REMEMBER:
                    fresh = distinct
                self.learn(fresh)
            at = self.known.__getitem__
            for t, c in zip(texts[lo : lo + 256], counts, strict=True):
                if not self.m.languages or t is None or not c and not any(map(str.isalpha, t)):
                    out.append(("und", 0.0))
                    continue
                n = np.fromiter(c.values(), float, len(c))
                ll = n @ self.rows[np.fromiter(map(at, c), np.int64, len(c))] if c else np.zeros(len(self.m.languages))
                post = np.exp(ll - ll.max())
                k = int(ll.argmax())
                out.append((self.m.languages[k], float(post[k] / post.sum())))
        return out


_SCORERS: dict[str, _Scorer] = {}


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text.

    Each word's likelihood sums every segmentation by the forward algorithm; a text's is the
    product over its words; the score is the posterior under equal priors. Null texts and
    texts without a letter are ``und`` with score 0, as is everything when no language was
    learned; ties go to the first language by name. Repeated rows score alike; other columns
    are ignored. The model is sent out once; its size is set by vocabulary and languages.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    def run(batches):
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = _Scorer(sent.value)
        for b in batches:
            got = scorer.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], schema=SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
