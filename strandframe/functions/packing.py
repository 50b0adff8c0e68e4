"""Content ids and packed sequences: what Spark has no built-in for, as Arrow UDFs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandframe.functions.sequences import AMINO, DNA, MURPHY_10, RNA

SYMBOLS = {"DNA": DNA, "RNA": RNA, "AMINO": AMINO, "MURPHY_10": MURPHY_10}


def bits(alphabet: str) -> int:
    """Bits that hold one symbol: 1, 2, 4 or 8."""
    need = max(1, (len(SYMBOLS[alphabet]) - 1).bit_length())
    return next(b for b in (1, 2, 4, 8) if b >= need)


def kmer_parameters(alphabet: str, k: int) -> dict[str, int]:
    """Bits of a symbol, mask of a k-mer, and width in bits of the least integer that holds it."""
    b = max(1, (len(SYMBOLS[alphabet]) - 1).bit_length())
    if b * k > 64:
        raise ValueError("k-mer exceeds 64 bits")
    return {"bits": b, "mask": (1 << (b * k)) - 1, "width": next(w for w in (8, 16, 32, 64) if w >= b * k)}


def _codes(text: str, symbols: str) -> np.ndarray:
    table = np.full(256, 255, np.uint8)
    table[np.frombuffer(symbols.encode(), np.uint8)] = np.arange(len(symbols), dtype=np.uint8)
    out = table[np.frombuffer(text.encode("ascii"), np.uint8)]
    if (out == 255).any():
        raise ValueError("symbol outside of the alphabet")
    return out


def content_id(seq: Column, alphabet: str = "DNA") -> Column:
    """Hexadecimal BLAKE2b of 8 bytes over the codes of a clean sequence; null for null."""
    symbols = SYMBOLS[alphabet]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hashlib.blake2b(_codes(t, symbols).tobytes(), digest_size=8).hexdigest())

    return run(seq)


def pack(seq: Column, alphabet: str = "DNA") -> Column:
    """A clean sequence in the least power of two of bits a symbol, first symbol in the highest bits; null for null."""
    symbols, b = SYMBOLS[alphabet], bits(alphabet)

    def one(t):
        if t is None:
            return None
        c, per = _codes(t, symbols), 8 // b
        c = np.pad(c, (0, -len(c) % per)).reshape(-1, per)
        return (c << (b * np.arange(per - 1, -1, -1)).astype(np.uint8)).sum(1).astype(np.uint8).tobytes()

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(seq)


def unpack(packed: Column, length: Column, alphabet: str = "DNA") -> Column:
    """The sequence of :func:`pack`, given its length."""
    symbols, b = np.frombuffer(SYMBOLS[alphabet].encode(), np.uint8), bits(alphabet)

    def one(p, n):
        if p is None:
            return None
        c = np.frombuffer(p, np.uint8)[:, None] >> (b * np.arange(8 // b - 1, -1, -1)).astype(np.uint8) & ((1 << b) - 1)
        return symbols[c.ravel()[: int(n)]].tobytes().decode()

    @F.pandas_udf("string")
    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(p, n, strict=True)], dtype=object)

    return run(packed, length)
