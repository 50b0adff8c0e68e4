"""Quality: random Fourier features over document statistics, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import isotonic, map_texts, with_kept

FEATURES = 256
RIDGE = 1.0
SEED = 7
BINS = 2048
NAMES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "symbol", "mark_tail", "bar_words", "shout_words", "distinct_words",
    "top_word", "lines", "short_lines", "distinct_lines", "stop_ends", "non_ascii", "long_words", "entropy", "letters",
)

_UPPER = re.compile(rb"[A-Z]+")
_KEEP = {k: bytes(b for b in range(256) if not test(b)) for k, test in {
    "upper": lambda b: 65 <= b <= 90, "lower": lambda b: 97 <= b <= 122, "digit": lambda b: 48 <= b <= 57, "space": lambda b: b in b" \t\n\r\x0b\x0c",
    "symbol": lambda b: chr(b) in "#$%&*+<>=@\\^_`{}~|!", "high": lambda b: b >= 128,
}.items()}


def statistics(text: str | None) -> list[float]:
    """The document statistics named in ``NAMES``; null and empty texts give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    size = {k: len(raw.translate(None, v)) for k, v in _KEEP.items()}
    words = raw.split()
    w = len(words) or 1
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = len(lines) or 1
    tails = Counter([x[-1] for x in words])
    odd = sum(tails[c] for c in b"#$%&*!|")
    shout = sum(1 for x in words if x.isupper() and len(x) > 1)
    p = np.fromiter(counts.values(), float, len(counts)) / w
    return [
        math.log1p(n), math.log1p(len(words)), min(50.0, n / w), size["upper"] / n, size["digit"] / n, size["space"] / n, size["symbol"] / n, odd / w, counts[b"|"] / w, shout / w,
        len(counts) / w, max(counts.values(), default=0) / w, math.log1p(len(lines)), sum(len(x) < 40 for x in lines) / m, len(set(lines)) / m,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, size["high"] / n, sum(len(x) > 20 for x in words) / w, float(-(p * np.log(p)).sum()) if len(p) else 0.0, (size["upper"] + size["lower"] + size["high"]) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, stats`` for every whole text; columns named in ``keep`` come back untouched in a struct ``kept``.

    Null and empty texts have zeros, repeated rows are rows of their own, an empty table gives no rows, other columns are ignored.
    """

    def run(batches):
        for b in batches:
            stats = pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), stats, *b.columns[2:]], names=["doc_id", "stats", *b.schema.names[2:]])

    return map_texts(docs, run, "doc_id long, stats array<double>", id_col, text_col, keep)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos features whose inner product approaches a Gaussian kernel, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.freq + self.phase) * math.sqrt(2 / self.freq.shape[1]), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray, fold: int = -1) -> np.ndarray:
        return self.features(stats) @ self.beta[fold]

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.knots), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, train: Column, label_col: str = "quality", id_col: str = "doc_id", features: int = FEATURES, width: float | None = None) -> QualityModel:
    """Fit on every labelled row that ``train`` (a condition on ``doc_id``) takes.

    Means, normal equations and the calibration histogram are sums over partitions, of a size
    set by ``features`` and ``BINS`` alone. Rows fall into two folds by hash; each fold's raw
    scores for the calibration come from the other fold's equations, the final ones from
    both. Several labels of a document count as their largest; null labels as none.
    Without labelled rows every score is 0.5; with one class, that class's smoothed rate.
    """
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).where(train)
    rows = stats.join(y, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold")).persist()
    d = len(NAMES)

    def pack(sums):
        """A row of numbers for each row of each sum."""
        keys = [(k, i) for k, v in sums.items() for i in range(len(v))]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.array([sums[k][i].tolist() for k, i in keys], pa.list_(pa.float64()))], names=["k", "i", "s"])

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([c.flatten().to_numpy().reshape(len(c), -1).sum(axis=0) for c in t.column("s").chunks], axis=0)
        return pa.table({"k": t.column("k").slice(0, 1), "i": t.column("i").slice(0, 1), "s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    def total(fn) -> dict[int, np.ndarray]:
        """Sums over partitions: every task sends one partial sum, added up row by row."""
        ddl = "k int, i int, s array<double>"
        out: dict[int, dict[int, list[float]]] = {}
        for r in rows.mapInArrow(fn, ddl).groupBy("k", "i").applyInArrow(add, ddl).toLocalIterator():
            out.setdefault(r.k, {})[r.i] = r.s
        return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}

    def columns(b):
        return np.array(b.column(0).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d), b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_numpy(zero_copy_only=False)

    def moments(batches):
        s = np.zeros(2 * d + 2)
        for b in batches:
            if b.num_rows:
                x, t, _ = columns(b)
                s += np.concatenate([x.sum(0), (x * x).sum(0), [len(x), t.sum()]])
        yield pack({0: s[None]})

    s = total(moments).get(0, np.zeros((1, 2 * d + 2)))[0]
    n = s[-2]
    rng = np.random.default_rng(SEED)
    width = width or math.sqrt(d)
    freq, phase = rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * math.pi, features)
    base = (s[-1] + 0.5) / (n + 1)
    m = QualityModel(np.zeros(d), np.ones(d), freq, phase, np.zeros((1, features + 1)), (np.array([0.0]), np.array([base])))
    if not n:
        rows.unpersist()
        return m
    m.mean = s[:d] / n
    m.scale = np.sqrt(np.maximum(s[d : 2 * d] / n - m.mean**2, 0)) + 1e-6
    f = features + 1

    def equations(batches):
        sums = {k: np.zeros((f, f + 1)) for k in (0, 1)}
        for b in batches:
            if b.num_rows:
                x, t, fold = columns(b)
                z = m.features(x)
                for k in (0, 1):
                    own = fold == k
                    sums[k] += z[own].T @ np.column_stack([z[own], t[own]])
        yield pack(sums)

    eq = total(equations)
    solve = lambda e: np.linalg.solve(e[:, :f] + RIDGE * np.eye(f), e[:, f])
    m.beta = np.array([solve(eq[1]), solve(eq[0]), solve(eq[0] + eq[1])])

    def histogram(batches):
        h = np.zeros((2, BINS))
        for b in batches:
            if b.num_rows:
                x, t, fold = columns(b)
                raw = np.where(fold == 0, m.raw(x, 0), m.raw(x, 1))
                at = np.clip(((raw + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
                np.add.at(h, (0, at), 1)
                np.add.at(h, (1, at), t)
        yield pack({0: h})

    count, ones = total(histogram)[0]
    rows.unpersist()
    have = np.flatnonzero(count)
    m.knots = isotonic((have + 0.5) * 2 / BINS - 0.5, ones[have] / count[have], count[have])
    return m


def score(stats: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for every row of :func:`document_statistics`, and ``kept`` where it has that.

    ``predicted`` is 1 from the threshold on, so a tie with it counts as good; repeated rows score alike; an empty table
    gives no rows; other columns are ignored.
    """
    sent = stats.sparkSession.sparkContext.broadcast(model)
    d = len(NAMES)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
            p = sent.value.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *b.columns[2:]], names=["doc_id", "score", "predicted", *b.schema.names[2:]])

    kept = [c for c in ("kept",) if c in stats.columns]
    rows = stats.select("doc_id", "stats", *kept)
    return rows.mapInArrow(run, with_kept("doc_id long, score double, predicted int", rows))
