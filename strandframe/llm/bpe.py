"""Byte-level BPE in column expressions: ranked merges folded over the bytes of words."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from copy import copy
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that are encoded once and looked up; bounds the literal table of common words.
COMMON = 1 << 18
NONE = (1 << 40) - 1
#: Bytes of words whose cuts fit in a long.
SHORT = 62
#: Windows whose tokens are listed beforehand; bounds the literal table of windows.
WINDOWS = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def java_pattern(pattern: str) -> str:
    """The pattern under Unicode classes, as the Rust and Python engines read it."""
    return "(?U)" + pattern


def _displaced(hashes: list[int], bits: int) -> tuple[list[int], list]:
    """Places for distinct 64-bit hashes in ``2 ** bits`` slots, no two alike: displacements by the top ``bits - 1`` bits, and the item of each slot.

    An item's slot is ``(hash ^ displacement) & (2 ** bits - 1)``, so a look-up reads two places and compares once.
    """
    mask, shift = (1 << bits) - 1, 65 - bits
    buckets: dict[int, list[int]] = {}
    for k, h in enumerate(hashes):
        buckets.setdefault(h >> shift, []).append(k)
    moved, slots = [0] * (1 << (bits - 1)), [None] * (1 << bits)
    for b in sorted(buckets, key=lambda b: (-len(buckets[b]), b)):
        own = [hashes[k] & mask for k in buckets[b]]
        for d in range(1 << bits):
            at = [h ^ d for h in own]
            if all(slots[x] is None for x in at) and len(set(at)) == len(at):
                break
        else:
            raise RuntimeError("two hashes are alike in their low bits, or the table is too full")
        moved[b] = d
        for x, k in zip(at, buckets[b], strict=True):
            slots[x] = k
    return moved, slots


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _literal(spark: SparkSession, values: pa.Array) -> Column:
    """A constant array as a scalar subquery over one local row.

    Spark runs it once and hands the value to tasks as a literal, in its compact binary form,
    and plans show a short name for it, not its megabytes.
    """
    return spark.createDataFrame(pa.table({"t": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)})).scalar()


def _ordered(ranks: dict[bytes, int]) -> bool:
    """Whether every token, encoded by itself, comes out whole by merges of rising rank.

    Then no merge, in any text, makes a pair of lower rank than its own: the joint bytes of
    such a pair would be a token whose own merges fall, as merges within its bytes do not depend on
    what surrounds them. So one pass over all tokens found in a word, by rank, does every merge.
    """
    for token in ranks:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
            if rank == NONE or rank < last:
                return False
            parts[i : i + 2], last = [parts[i] + parts[i + 1]], rank
    return True


class Bpe:
    """The literals of one rank file, as arrays that expressions read.

    ``_t`` and ``_d`` map the hash of a piece to its rank (a fingerprint of 48 bits and the rank
    in one long); ``_l`` bounds the length of tokens by the hash of their first four bytes; ``_o``, ``_f`` and ``_c``
    are the ends, all, and all but the inside of a stretch of a word as bits, by ``start * 64 + length - 1``.
    A window is five bytes of a word from its first, third, fifth ... byte, fewer at its end. By the hash of a window, ``_x`` and ``_h`` find its slot;
    ``_e`` lists the tokens within it that begin at its first two bytes, as ``rank << 12 | start << 6 | length - 1``, and ``_g``
    the longer tokens that may begin there, as ``length << 1 | start``. Windows that are not listed are looked up
    length by length, so which are listed changes no result.
    """

    SLOTS, PREFIX, WINDOW = 17, 4, 5

    def __init__(self, ranks: dict[bytes, int]):
        if len(ranks) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.ranks = ranks
        self.by_id = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            self.by_id[v] = k
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must have a rank")
        self.ordered, self.longest = _ordered(ranks), max(map(len, ranks))
        hashes = {w: xxhash.xxh64_intdigest(w, 42) for w in ranks}
        tokens = list(ranks)
        moved, slots = _displaced([hashes[w] for w in tokens], self.SLOTS)
        table = [0 if k is None else _signed(hashes[tokens[k]] & ~65535 | ranks[tokens[k]]) for k in slots]
        lengths = [self.PREFIX - 1] * 65536
        for w in tokens:
            at = xxhash.xxh64_intdigest(w[: self.PREFIX], 42) & 65535
            lengths[at] = max(lengths[at], len(w))
        ends, inner = [0] * 4096, [0] * 4096
        for i in range(1, SHORT + 1):
            for n in range(1, SHORT + 2 - i):
                ends[i << 6 | n - 1], inner[i << 6 | n - 1] = (1 | 1 << n) << (i - 1), ((1 << n - 1) - 1) << i
        self.tables = {
            "_t": pa.array(table, pa.int64()), "_d": pa.array(moved, pa.int32()), "_l": pa.array(lengths, pa.int32()), "_o": pa.array([_signed(x) for x in ends], pa.int64()),
            "_f": pa.array([_signed(a | b) for a, b in zip(ends, inner, strict=True)], pa.int64()), "_c": pa.array([_signed(~x) for x in inner], pa.int64()),
        }
        self._list_windows(())

    def _list_windows(self, words: Iterable[bytes], limit: int = WINDOWS) -> None:
        """Lists at most ``limit`` windows of the words."""
        seen, longer = {}, {}
        for w in words:
            for i in range(len(w) - 1):
                seen[w[i : i + self.WINDOW]] = None
            if len(seen) >= limit:
                break
        for w in self.ranks:
            for n in (self.WINDOW, self.WINDOW - 1):
                if n < len(w) <= SHORT:
                    longer.setdefault(w[:n], []).append(len(w))
        windows = list(seen)[:limit]
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in windows]
        self.bits = max(4, (2 * len(windows) - 1).bit_length())
        moved, slots = _displaced(hashes, self.bits)

        def inside(w: bytes) -> list[int]:
            return [self.ranks[w[i:k]] << 12 | i + 1 << 6 | k - i - 1 for i in (0, 1) for k in range(i + 2, len(w) + 1) if w[i:k] in self.ranks]

        def beyond(w: bytes) -> list[int] | None:
            return len(w) == self.WINDOW and sorted({k << 1 | i for i in (0, 1) for k in longer.get(w[i:], ())}) or None

        self.tables = self.tables | {
            "_x": pa.array(moved, pa.int32()), "_h": pa.array((None if k is None else _signed(hashes[k]) for k in slots), pa.int64()),
            "_e": pa.array((None if k is None else inside(windows[k]) for k in slots), pa.list_(pa.int32())), "_g": pa.array((None if k is None else beyond(windows[k]) for k in slots), pa.list_(pa.int32())),
        }

    def fitted(self, words: Iterable[bytes]) -> Bpe:
        """The same ranks with the windows of these words."""
        out = copy(self)
        out._list_windows(words)
        return out

    @classmethod
    def load(cls, path: str) -> Bpe:
        return _load(path)

    def bind(self, df: DataFrame) -> DataFrame:
        """``df`` with the literals under the names that :meth:`encode_word` reads, bound outside of any lambda by :meth:`let`."""
        return df.select("*", *(_literal(df.sparkSession, v).alias(f"{k}_") for k, v in self.tables.items()))

    def let(self, body: str) -> str:
        for k in self.tables:
            body = let(k, f"{k}_", body)
        return body

    def unbind(self, df: DataFrame) -> DataFrame:
        return df.drop(*(f"{k}_" for k in self.tables))

    def encode_word(self, word: str) -> str:
        """SQL of the ids of the word that an expression names.

        All tokens of two bytes and more that stand in the word are listed as ``rank << 12 | start << 6 | length - 1``, from the
        lists of its windows, and folded by rank, leftmost first, over a long whose bits are the places where the word
        is still cut: a token whose ends are cut, with one cut inside, is a pair that merges. (One bit of difference between the cuts of a
        stretch and its ends is such a pair, or a stretch with no cut inside, where nothing changes; -1 stands for no token.) What stands between the cuts
        that remain are the tokens. Words over ``SHORT`` bytes, and all words of a rank file that is not
        :func:`_ordered`, merge one pair a step instead.
        """
        entry = f"_t[(h ^ _d[shiftrightunsigned(h, {65 - self.SLOTS})]) & {(1 << self.SLOTS) - 1}]"
        known = f"if(shiftrightunsigned({entry} ^ h, 16) = 0, shiftleft(cast({entry} & 65535 as int), 12)"
        lengths = f"sequence(2, least(n - i, _l[xxhash64(substring(w, i + 1, {self.PREFIX})) & 65535]))"
        found = f"transform(transform({lengths}, k -> xxhash64(substring(w, i + 1, k))), (h, k) -> {known} + shiftleft(i, 6) + (k + 65), -1))"
        unlisted = f"flatten(transform(sequence(2 * j, least(2 * j + 1, n - 2)), i -> {found}))"
        longer = let("h", "xxhash64(substring(w, 2 * j + 1 + (y & 1), shiftright(y, 1)))", f"{known} + shiftleft(2 * j + (y & 1), 6) + (63 + shiftright(y, 1)), -1)")
        beyond = f"transform(_g[x], y -> if(2 * j + (y & 1) + shiftright(y, 1) > n, -1, {longer}))"
        inside = "transform(_e[x], y -> y + shiftleft(j, 7))"
        listed = f"if(_g[x] is null, {inside}, concat({inside}, {beyond}))"
        slots = f"transform(h_, h -> (h ^ _x[shiftrightunsigned(h, {65 - self.bits})]) & {(1 << self.bits) - 1})"
        at = let("h_", f"transform(sequence(1, n - 1, 2), i -> xxhash64(substring(w, i, {self.WINDOW})))", f"zip_with(h_, {slots}, (h, x) -> if(_h[x] = h, cast(x as int), -1))")
        tokens = f"flatten(transform({at}, (x, j) -> if(x < 0, {unlisted}, {listed})))"
        cuts = f"aggregate(sort_array({tokens}), -1L, (m, x) -> if(bit_count((m & _f[x & 4095]) ^ _o[x & 4095]) = 1, m & _c[x & 4095], m))"
        hashes = "transform(a, (i, k) -> xxhash64(substring(w, i + 1, coalesce(get(a, k + 1), n) - i)))"
        short = let("m", cuts, let("a", "filter(sequence(0, n - 1), i -> getbit(m, i) = 1)", f"transform({hashes}, h -> cast({entry} & 65535 as int))"))
        single = let("h", "xxhash64(w)", f"array(cast({entry} & 65535 as int))")

        def rank(start: str, end: str) -> str:
            return let("h", f"xxhash64(substring(w, {start} + 1, {end} - {start}))", f"if({end} - {start} <= {self.longest} and shiftrightunsigned({entry} ^ h, 16) = 0, {entry} & 65535, {NONE}L)")

        ranks = f"if(n > 1, transform(sequence(0, n - 2), i -> {rank('i', '(i + 2)')}), array())"
        place = let("a", "concat(slice(s.a, 1, p), slice(s.a, p + 2, size(s.a)))", f"""named_struct('a', a, 'r', concat(
            if(p > 1, concat(slice(s.r, 1, p - 2), array({rank('a[p - 2]', 'a[p]')})), array()),
            if(p + 1 < size(a), concat(array({rank('a[p - 1]', 'a[p + 1]')}), slice(s.r, p + 2, size(s.r))), array())))""")
        step = let("x", "array_min(s.r)", f"if(x < {NONE}L, {let('p', 'cast(array_position(s.r, x) as int)', place)}, s)")
        start = f"named_struct('a', sequence(0, n), 'r', cast({ranks} as array<bigint>))"
        long = let("s", f"aggregate(sequence(1, n), {start}, (s, y) -> {step})", f"transform(sequence(0, size(s.a) - 2), i -> cast({rank('s.a[i]', 's.a[i + 1]')} as int))")
        own = f"if(n <= {SHORT}, {short}, {long})" if self.ordered else long
        return let("w", f"cast({word} as binary)", let("n", "octet_length(w)", f"if(n = 0, cast(array() as array<int>), if(n = 1, {single}, {own}))"))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """Adds the bytes of a column of ids: concatenates their binary pieces, a character of Latin-1 for each byte; null gives null, no ids no bytes."""
        pieces = _literal(df.sparkSession, pa.array([p.decode("latin-1") for p in self.by_id]))
        joined = F.expr(let("p", "_p_", f"encode(array_join(transform(`{ids}`, i -> p[i]), ''), 'ISO-8859-1')"))
        return df.withColumn("_p_", pieces).withColumn(out, joined).drop("_p_")


@lru_cache(2)
def _load(path: str) -> Bpe:
    return Bpe(read_ranks(path))


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is computed once.

    The value starts a fold over nothing and the body finishes it, whose result is handed on as it is; transforms and the steps of
    folds copy theirs.
    """
    return f"aggregate(array(), {value}, (z_, y_) -> z_, {name} -> {body})"


def split(text: Column, pattern: str) -> Column:
    """The matches of the pattern, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0)), F.array().cast("array<string>"))


def common_words(docs: DataFrame, bpe: Bpe, pattern: str, text_col: str = "text", limit: int = COMMON) -> list:
    """The most frequent distinct words of all texts with their ids, at most ``limit``.

    Words are counted over every text, with partial sums before the shuffle. Only words that occur
    twice can gain from the table.
    """
    counts = docs.select(F.explode(split(F.col(text_col), pattern)).alias("w")).groupBy("w").count()
    top = counts.where("count > 1").orderBy(F.desc("count"), "w").limit(limit).select("w").repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism))
    got = bpe.bind(top).select("w", F.expr(bpe.let(bpe.encode_word("w"))).alias("ids")).toArrow()
    return list(zip(*(c.to_pylist() for c in got.columns), strict=True))


class Lookup:
    """Literals of words and their ids: ``_w`` and ``_i`` by slot, ``_m`` the displacements of slots."""

    def __init__(self, entries: list):
        self.bits = max(4, (2 * len(entries) - 1).bit_length())
        moved, slots = _displaced([xxhash.xxh64_intdigest(w.encode(), 42) for w, _ in entries], self.bits)
        self.tables = {"_m": pa.array(moved, pa.int32()), "_w": pa.array((None if k is None else entries[k][0] for k in slots), pa.string()), "_i": pa.array((None if k is None else entries[k][1] for k in slots), pa.list_(pa.int32()))}

    def bind(self, df: DataFrame) -> DataFrame:
        return df.select("*", *(_literal(df.sparkSession, v).alias(f"{k}_") for k, v in self.tables.items()))

    def let(self, body: str) -> str:
        for k in self.tables:
            body = let(k, f"{k}_", body)
        return body

    def unbind(self, df: DataFrame) -> DataFrame:
        return df.drop(*(f"{k}_" for k in self.tables))

    def find(self, words: str, other: str) -> str:
        """SQL of the ids of each word of an array; ``other`` gives those of a word ``v`` that is not in the table."""
        slots = f"transform(transform(v_, v -> xxhash64(v)), h -> (h ^ _m[shiftrightunsigned(h, {65 - self.bits})]) & {(1 << self.bits) - 1})"
        return let("v_", words, f"zip_with(v_, {slots}, (v, x) -> if(_w[x] = v, _i[x], {other}))")


def encode(docs: DataFrame, bpe: Bpe, pattern: str, text_col: str = "text", out: str = "ids", limit: int = COMMON) -> DataFrame:
    """Adds ``ids``, the token ids of every whole text, as the tiktoken library gives them without special tokens.

    Distinct common words are folded once and found in a literal table; a word outside it
    is folded where it stands, by the same expression, so nothing is shuffled but word counts; which words
    are common (equal counts go by the word) changes no result. Null and empty texts give no ids; repeated rows
    encode alike; an existing column of the name ``out`` is replaced, others pass through, but for
    names of an underscore, a letter and another underscore, which are taken.
    """
    common = common_words(docs, bpe, pattern, text_col, limit)
    known, bpe = Lookup(common), bpe.fitted(w.encode() for w, _ in common)
    split_text = docs.withColumn("_s_", split(F.col(text_col), pattern))
    ids = bpe.let(known.let(f"flatten({known.find('_s_', bpe.encode_word('v'))})"))
    return known.unbind(bpe.unbind(known.bind(bpe.bind(split_text)).withColumn(out, F.expr(ids)))).drop("_s_")


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
