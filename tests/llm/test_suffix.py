"""Longest previous factors against their definition."""

import os
import random

import numpy as np
import pytest

from logloom.llm import suffix
from logloom.ship import ship


def agree(a, b):
    return len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("seed", range(20))
def test_previous_factors(seed):
    rng = random.Random(seed)
    text = bytes(rng.choices(b"ab", k=rng.randint(1, 60)))
    suffixes = [text[i:] for i in range(len(text))]
    order, common = suffix.neighbour_prefixes(suffixes)
    found = np.zeros(len(text), np.int64)
    found[order] = suffix.previous_factors(common, order)
    assert found.tolist() == [max((agree(suffixes[i], suffixes[j]) for j in range(i)), default=0) for i in range(len(text))]
    found[order] = suffix.either_factors(common)
    assert found.tolist() == [max((agree(s, t) for j, t in enumerate(suffixes) if j != i), default=0) for i, s in enumerate(suffixes)]


@pytest.mark.parametrize("seed", range(40))
def test_covered(seed):
    rng = random.Random(seed)
    n, least = rng.choice([2, 2, 3, 8, 30]), rng.randint(4, 12)
    prefixes, suffixes = ([bytes(rng.choices(b"aab", k=rng.randint(0, 9))) for _ in range(n)] for _ in range(2))
    suffixes = [b"#" + s for s in suffixes]  # the anchor, which all entries share
    position = np.array(rng.sample(range(100), n))
    for places in (None, position):
        low, high = suffix.covered(prefixes, suffixes, least, places)
        for i in range(n):
            pairs = [(agree(prefixes[i], prefixes[j]), agree(suffixes[i], suffixes[j])) for j in range(n) if j != i and (places is None or places[j] < places[i])]
            pairs = [p for p in pairs if sum(p) >= least]
            assert (low[i], high[i]) == tuple(max((p[k] for p in pairs), default=0) for k in (0, 1))


def test_shared_contexts(spark):
    ship(spark)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, short = text(280), text(190)
    rows = [(1, text(500) + passage + text(30)), (2, passage), (3, text(40) + short + text(300)), (4, short), (5, text(900)), (6, None), (None, text(700) + passage), (7, "")]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), report=200)
    assert {r.doc_id for r in out.collect() if r.shared} == {1, 2, None}
    assert all(not r.spans for r in out.collect())
