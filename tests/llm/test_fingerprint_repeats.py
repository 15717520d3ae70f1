"""Likeness of texts with repeated words and lines against counts of shared shingles."""

import random
from collections import Counter

import numpy as np

from newsflow.llm import fingerprint as fp


def shared(a, b):
    x, y = (Counter(s for p in fp.paragraphs(t) for s in fp.shingles(p.encode())) for t in (a, b))
    return 1 - sum(((x - y) + (y - x)).values()) / (sum(x.values()) + sum(y.values()))


def pairs():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    for n in (50, 150, 400):
        for repeats in (20, 120, 300):
            prose, other = (" ".join(rng.choices(words, k=n)) for _ in range(2))
            yield f"{prose} {'again ' * repeats}", prose  # one word many times
            yield f"{prose} {'again ' * repeats}", f"{other} {'again ' * repeats}"
            line = " ".join(rng.choices(words, k=8))
            yield "\n".join([prose, *[line] * repeats]), "\n".join([prose, *[line] * (repeats // 2)])  # one line many times
            yield "\n".join([prose, *[line] * repeats]), other


def test_likeness_with_repeats():
    gaps = [abs(fp.likeness(*map(fp.document_vector, p)) - shared(*p)) for p in pairs()]
    assert max(gaps) < 0.4 and np.mean(gaps) < 0.1, gaps


def test_long_tails():
    rng = np.random.default_rng(3)
    for n in (10, 1000, 200_000):
        sums = fp._cauchy_sums(rng.integers(0, 2 ** 32, n, dtype=np.uint32))
        assert abs(fp._spread(np.abs(sums) / fp.SCALE) / n - 1) < 0.4
