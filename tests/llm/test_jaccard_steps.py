"""The steps of the Jaccard join: small plans, no round more than needed, components joined across steps."""

import random

import pytest

from tallow.functions import scratch as shared
from tallow.llm import components as stars
from tallow.llm import jaccard_join, scratch
from tests.llm.test_operators import SCHEMA, brute_components, corpus


@pytest.fixture
def written(monkeypatch):
    """(name, exchanges of the plan) of each table written."""
    seen = []

    def table(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange ")))
        return shared.table(df, name)

    monkeypatch.setattr(scratch, "table", table)
    return seen


def chained(n=60, seed=5):
    """Texts that lead from one to the next by small edits at either end, in several chains, so that groups meet late."""
    rng = random.Random(seed)
    rows = []
    for chain in range(4):
        words = [f"c{chain}w{rng.randrange(10**6)}" for _ in range(200)]
        for step in range(n // 4):
            at = (step * 7) % 180
            rows.append((chain * 1000 + step, " ".join(words[at % 23 : 160 + at % 29]), "en", None, 1))
    return rows


def test_no_step_plans_many_exchanges(spark, written):
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(corpus(), SCHEMA)).collect()), key=str)
    assert got == brute_components(corpus())
    assert max(n for _, n in written) <= 9, sorted(written, key=lambda x: -x[1])[:4]


def test_stars_need_no_round(spark, written):
    links = spark.createDataFrame([(i, 0) for i in range(1, 30)] + [(0, 40), (0, 40), (50, 51), (None, 3), (7, None), (60, 60)], "a long, b long")
    got = dict(stars.components(links).collect())
    assert got == {**{i: 0 for i in range(30)}, 40: 0, 50: 50, 51: 50}
    assert [name for name, _ in written] == ["edges", "linked"]


def test_components_merge_across_steps(spark):
    rows = chained()
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = brute_components(rows)
    assert got == want
    assert len({c for _, _, c in want}) < len(rows) / 2
