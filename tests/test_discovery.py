import math
import random

import numpy as np
import pytest

from strandframe.operators import discovery as D


def test_tail_against_the_sum():
    for n, p in ((10, 0.3), (40, 0.01), (25, 0.9)):
        for x in range(n + 2):
            want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x, n + 1))
            got = D.log10_upper_tail(x, n, p)
            assert (10**got if got > -math.inf else 0) == pytest.approx(want, rel=1e-8)
    assert D.log10_upper_tail(5000, 1_000_000, 1e-6) < -1000


def test_planted_motif_is_found(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(i, text(60) + "TTGACATA" + text(60)) for i in range(40)]
    control = [(i, text(130)) for i in range(40)]
    make = lambda r: spark.createDataFrame(r, "seq_id long, seq string")
    for c in (None, make(control)):
        word, n, p, motif = D.discover(make(rows), 8, 3, c)[0]
        assert word in ("TTGACATA", "TATGTCAA") and n >= 40 and p < -20
        assert "".join("TCAG"[i] for i in np.argmax(motif.weights, 0)) == word
    assert D.discover(make([]), 8, 3) == []
