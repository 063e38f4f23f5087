"""Strategies against a baseline, compared with plain loops over the same draws."""

import numpy as np
import pytest

from vantaloom.operators import paired

RANKS = {
    "base": {1: 1, 2: 5, 3: 21, 4: 2, 5: 11, 6: 1},
    "better": {1: 1, 2: 1, 3: 4, 4: 1, 5: 10, 6: 3},
    "same": {1: 1, 2: 5, 3: 21, 4: 2, 5: 11, 6: 1},
    "fewer": {1: 2, 4: 1},
}


def percentile(values, q):
    """Linear between the two neighbours."""
    own = sorted(values)
    place = (len(own) - 1) * q / 100
    low = int(place)
    high = min(low + 1, len(own) - 1)
    return own[low] + (own[high] - own[low]) * (place - low)


def plain(strategy, draws, seed, depth):
    """measure -> (delta, low, high, share of draws that are not above 0)."""
    ids = sorted(RANKS[strategy])
    a, b = [RANKS[strategy][i] for i in ids], [RANKS["base"][i] for i in ids]
    worth = {
        "recall_1": lambda r: float(r <= 1),
        "recall_10": lambda r: float(r <= 10),
        "mrr": lambda r: 1 / r if r <= depth else 0.0,
    }
    rng, out = np.random.default_rng(seed), {}
    for name, f in worth.items():
        d = [f(x) - f(y) for x, y in zip(a, b, strict=True)]
        picks = rng.integers(0, len(d), size=(draws, len(d))).tolist()
        means = [sum(d[i] for i in row) / len(d) for row in picks]
        out[name] = (sum(d) / len(d), percentile(means, 2.5), percentile(means, 97.5), sum(m <= 1e-15 for m in means) / draws)
    return out


def test_strategies_against_the_baseline(spark):
    rows = [(s, i, r) for s, ranks in RANKS.items() for i, r in ranks.items()]
    grid = spark.createDataFrame(rows, "strategy string, query_id long, rank long")
    found = paired.strategy_pairing(grid, "base", depth=20, draws=400, seed=11).collect()
    assert sorted({r["strategy"] for r in found}) == ["better", "fewer", "same"]
    for r in found:
        want = plain(r["strategy"], 400, 11, 20)[r["measure"]]
        assert (r["delta"], r["ci_low"], r["ci_high"], r["p_not_better"]) == pytest.approx(want, abs=1e-12)
    same = [r for r in found if r["strategy"] == "same"]
    assert len(same) == 3 and all((r["delta"], r["p_not_better"]) == (0.0, 1.0) for r in same)


def test_no_strategy_but_the_baseline(spark):
    grid = spark.createDataFrame([("base", 1, 1)], "strategy string, query_id long, rank long")
    assert paired.strategy_pairing(grid, "base", draws=10).collect() == []
