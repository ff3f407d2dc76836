"""The cumulative-link fit against a plain optimiser of the same likelihood, and scores by hand."""

import math
import random
import re

import numpy as np
import pytest

from leadloom.llm import toxicity
from leadloom.llm.blocks import U, span_hashes


def made(seed):
    """30 rows of four features whose grades are noisy, so that the best weights are finite."""
    rng = random.Random(seed)
    rows = []
    for _ in range(30):
        has = [k for k in range(4) if rng.random() < 0.5]
        rows.append((min(2, max(0, round(0.8 * len(has) - 0.6 + rng.gauss(0, 0.9)))), has, rng.choice([1, 1, 2, 3])))
    rows += [(2, [], 1), (0, [0, 1, 2, 3], 1), (1, [3], 1)]
    return rows


def value(w, cuts, rows):
    """The weighted mean log-likelihood of the grades, less the ridge: toxic rows and others have the same say."""
    toxic, clean = (sum(n for g, _, n in rows if (g > 0) == t) for t in (True, False))
    total = sum(n * (clean / toxic if g else 1.0) for g, _, n in rows)
    out = 0.0
    for grade, has, n in rows:
        s = sum(w[k] for k in has)
        above = [1.0, *(1 / (1 + math.exp(c - s)) for c in cuts), 0.0]
        out += n * (clean / toxic if grade else 1.0) / total * math.log(max(above[grade] - above[grade + 1], 1e-12))
    return out - toxicity.RIDGE / 2 * sum(x * x for x in w)


def plain(rows, cuts):
    """Coordinate by coordinate with shrinking steps; weights stay at 0 or above, thresholds in order."""
    x = [0.0] * 4 + [float(k) for k in range(cuts)]
    step, best = 1.0, value(x[:4], x[4:], rows)
    while step > 1e-5:
        moved = False
        for k in range(len(x)):
            for d in (step, -step):
                y = list(x)
                y[k] += d
                if y[k] < 0 and k < 4 or any(p >= q for p, q in zip(y[4:], y[5:])):
                    continue
                if (v := value(y[:4], y[4:], rows)) > best + 1e-12:
                    x, best, moved = y, v, True
        if not moved:
            step /= 2
    return x[:4], x[4:], best


@pytest.mark.parametrize("seed, cuts", [(1, 2), (2, 2), (3, 2), (4, 1)])
def test_fit_reaches_what_a_plain_optimiser_finds(seed, cuts):
    rows = [(min(g, cuts), has, n) for g, has, n in made(seed)]
    owner = np.repeat(np.arange(len(rows)), [len(h) for _, h, _ in rows])
    column = np.array([k for _, h, _ in rows for k in h], np.int64)
    w, c = toxicity.climb(np.array([g for g, _, _ in rows]), owner, column, np.array([n for _, _, n in rows]), 4, cuts)
    want_w, want_c, best = plain(rows, cuts)
    assert value(w, c, rows) >= best - 1e-5
    assert np.allclose(w, want_w, atol=0.03) and np.allclose(c, want_c, atol=0.03)
    assert (np.diff(c) > 0).all()


def test_scores_by_hand(spark):
    texts = ["You IDIOT, idiotic fools", "a kind word", "", None, "idiot", "fool's errand éidiot"]
    names = [(None, "idiot"), (None, "fools"), (4, "idio")]
    found = sorted((int(span_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x)]), seed=size or 0)[0] & U(toxicity.BUCKETS - 1)), w) for (size, x), w in zip(names, (1.5, 0.5, 0.25)))
    model = toxicity.SeverityModel(np.array([b for b, _ in found]), np.array([w for _, w in found]), np.array([1.0, 2.0]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.grade_documents(rows, model).collect():
        words = {w.lower() for w in re.findall("[A-Za-z\x80-\U0010ffff]+", texts[r["doc_id"]] or "")}
        s = 1.5 * ("idiot" in words) + 0.5 * ("fools" in words) + 0.25 * any(w.startswith("idio") and len(w) > 4 for w in words)
        above = [round(1 / (1 + math.exp(c - s)), 9) for c in (1.0, 2.0)]
        assert (r["p_any"], r["p_severe"], r["expected_severity"], r["grade"], r["toxic"]) == (*above, round(sum(above), 9), sum(a >= 0.5 for a in above), above[0] >= 0.5)
