"""Benchmark decontamination with an Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import map_texts, with_kept
from strandframe.plans.session import materialize

WINDOW = 13
#: Bytes of normalised benchmark text in one automaton, and automata that a worker holds at once; a larger benchmark takes several passes over the texts.
BLOCK_BYTES, PASS_BLOCKS = 8_000_000, 4

_LOWER = bytes(range(65, 91))
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if b in _LOWER else 32 for b in range(256))

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
DDL = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: A-Z in lower case, every other ASCII character but digits and letters parts them."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not item:
        return []
    return [b" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The stated query set in blocks of bounded size: lists of ``(item id, text)``."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct().orderBy("i", "t").toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += len(r.t)
    if block:
        yield block


def automaton(block: list[tuple[str, str]], size: int = WINDOW) -> ahocorasick.Automaton | None:
    """One automaton over the windows of the items, each fenced by spaces; payload: words in the window and the items that hold it."""
    held: dict[bytes, tuple[int, set[str]]] = {}
    for i, t in block:
        w = words(t)
        for x in windows(w, size):
            held.setdefault(x, (min(len(w), size), set()))[1].update(() if i is None else (i,))
    if not held:
        return None
    a = ahocorasick.Automaton()
    for x, (n, items) in held.items():
        a.add_word(" " + x.decode("latin-1") + " ", (n, tuple(sorted(items))))
    a.make_automaton()
    return a


_BUILT: dict[str, list] = {}


def _scan(text: str | None, autos: list) -> tuple[int, np.ndarray | None, set[str]]:
    """Words in the text, a mark for each that lies in an occurrence of a window, items found."""
    w = words(text)
    flat = b" " + b" ".join(w) + b" "
    hay, found, marks = flat.decode("latin-1"), [], set()
    for a in autos:
        for end, (n, items) in a.iter(hay):
            found.append((end, n))
            marks.update(items)
    if not found:
        return len(w), None, marks
    # the space after word k stands at the sum of lengths up to k plus k + 1
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in w), np.int64, len(w)))
    hit = np.zeros(len(w) + 1, np.int64)
    at = np.array(found, np.int64)
    last = np.searchsorted(ends, at[:, 0])
    np.add.at(hit, last - at[:, 1] + 1, 1)
    np.add.at(hit, last + 1, -1)
    return len(w), np.cumsum(hit)[:-1] > 0, marks


_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def spans(text: str, hit: np.ndarray) -> list[dict]:
    """Character offsets, in the original text, of the runs of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    starts = np.frombuffer(raw, np.uint8)
    chars = np.concatenate([[0], np.cumsum((starts & 0xC0) != 0x80)])
    out, prev = [], False
    for (a, b), h in zip((m.span() for m in _RUN.finditer(raw)), hit, strict=True):
        if h and prev:
            out[-1]["end"] = int(chars[b])
        elif h:
            out.append({"start": int(chars[a]), "end": int(chars[b])})
        prev = h
    return out


def _automata(sent: list, size: int) -> list:
    """The automata of a pass, built once in each worker."""
    if not all(key in _BUILT for _, key in sent):
        _BUILT.clear()
        _BUILT.update({key: automaton(b.value, size) for b, key in sent})
    return [_BUILT[key] for _, key in sent if _BUILT[key] is not None]


def _passes(sc, found, size: int):
    """Blocks sent out, ``PASS_BLOCKS`` at a time."""
    while own := list(itertools.islice(found, PASS_BLOCKS)):
        yield [(sc.broadcast(b), hashlib.sha256(repr((size, b)).encode()).hexdigest()) for b in own]


def _row(text: str | None, n: int, hit: np.ndarray | None, items) -> tuple:
    return (n, 0 if hit is None else int(hit.sum()), len(items), sorted(items), [] if hit is None else spans(text, hit))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in every whole text.

    Returns one row per input row: ``doc_id, n_words, n_hit, n_items, item_ids`` (sorted as
    strings) and ``spans``, the hit passages as character offsets of the original text. An
    item of fewer words than the window is one window; null and empty texts have no words; an
    empty benchmark hits nothing; items with a null id hit without being named; repeated rows are judged each; columns
    named in ``keep`` come back untouched in a struct ``kept``, others are ignored.

    The benchmark is the query set: it is sent in blocks of ``block_bytes``, each built into one automaton in a Python
    worker, which holds ``PASS_BLOCKS`` of them. A benchmark of more is sought in several passes over the texts, whose
    hits are joined by row.
    """
    found = _passes(docs.sparkSession.sparkContext, blocks(benchmark, item_col, item_text_col, block_bytes), size)
    first, second = next(found, []), next(found, None)
    names = [f.name for f in SCHEMA]

    def whole(batches):
        autos = _automata(first, size)
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [_row(t, *_scan(t, autos)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], SCHEMA.field(k + 1).type) for k in range(5)), *b.columns[2:]], names=names + b.schema.names[2:])

    if second is None:
        return map_texts(docs, whole, DDL, id_col, text_col, keep)
    kept = [F.struct(*keep).alias("kept")] if keep else []
    keyed = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"), *kept), "decontaminate")

    def runs(sent):
        def run(batches):
            autos = _automata(sent, size)
            for b in batches:
                rows = []
                for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    _, hit, items = _scan(t, autos)
                    if hit is not None:
                        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                        rows.append((row, edge.tolist(), sorted(items)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["row", "edges", "items"])

        return materialize(keyed.select("row", "text").mapInArrow(run, "row long, edges array<long>, items array<string>"), "decontaminate-hits")

    hits = None
    for sent in itertools.chain([first, second], found):
        got = runs(sent)
        hits = got if hits is None else hits.unionByName(got)
        for b, _ in sent:
            b.destroy()
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("edges")).alias("edges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def joined(batches):
        for b in batches:
            out = []
            for t, edges, items in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                n, hit = len(words(t)), None
                if edges:
                    hit = np.zeros(n + 1, np.int64)
                    np.add.at(hit, edges[::2], 1)
                    np.add.at(hit, edges[1::2], -1)
                    hit = np.cumsum(hit)[:-1] > 0
                out.append(_row(t, n, hit, items or ()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], SCHEMA.field(k + 1).type) for k in range(5)), *b.columns[4:]], names=names + b.schema.names[4:])

    rows = keyed.join(hits, "row", "left").select("doc_id", "text", "edges", "items", *(["kept"] if keep else []))
    return rows.mapInArrow(joined, with_kept(DDL, rows))


def judged(found: DataFrame) -> DataFrame:
    """Adds ``contaminated``: some word is hit, and hit words are a twentieth of all at least."""
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
