"""Source divergence against brute force on plain Python integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallow.llm import divergence


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_docs, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    df, total, group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, w = lang or "", source or "", words(text)
        df[lang].update(set(w))
        total[lang].update(w)
        group[lang, source].update(w)
    out = []
    for (lang, source), own in group.items():
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        far = lambda p, q: {t: (p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept}  # noqa: E731, B023
        p, q = share(own), share(total[lang])
        pairs = [(o, sum(far(p, share(group[lang, o])).values())) for g, o in list(group) if g == lang and o != source]
        terms = [(t, v) for t, v in far(p, q).items() if own[t] and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(3)
    words = ["the", "The", "cat", "é", "ёж", "世界", "x1y", "w-w", "Zoo", *[f"a{'bcdefghijk'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)]]
    out = [(" ".join(rng.choice(words, int(rng.integers(0, 60)))), f"l{rng.integers(2)}", f"s{int(rng.integers(12) * (rng.random() < 0.7))}") for _ in range(150)]
    out += [out[0]] * 5 + [(None, "l0", "empty"), ("alone", "l9", "one"), ("", "l9", "two"), (None, None, None), ("the the", None, "s0"), ("cat " * 5000, "l0", "s1")]
    return out


@pytest.mark.parametrize("bucket, block", [(3500, 32), (5, 3)])
def test_divergence_equals_brute_force(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(divergence, "BUCKET_TERMS", bucket)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows()], "text string, lang string, source string, n int, term string")
    assert sorted(map(tuple, divergence.audit(df, min_docs=3, top=4).collect())) == brute(rows(), 3, 4)


def test_divergence_of_an_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).collect() == []


def test_equal_subtrees_are_one_node_and_priced_once():
    rng = np.random.default_rng(0)
    counts = np.where(rng.random((6, 1024)) < 0.02, rng.integers(1, 4, (6, 1024)), 0)
    counts[3] = counts[2]
    forest = divergence.Forest(counts)
    assert forest.root[2] == forest.root[3] and forest.nodes() < counts.size / 4
    one, two = np.array([0, 2, 1]), np.array([1, 3, 1])
    pair, a, b, times, visited = forest.leaf_pairs(one, two)
    assert visited < 3 * 1024
    for k in range(3):
        got = Counter(dict(zip(zip(a[pair == k].tolist(), b[pair == k].tolist()), times[pair == k].tolist())))
        assert got == Counter(zip(counts[one[k]].tolist(), counts[two[k]].tolist()))


def test_shares_of_counts_beyond_64_bits():
    big = np.array([10**10, 5, 0], np.int64)
    total = np.full(3, 10**10 + 5, np.int64)
    got = divergence.shares(big, total, np.full(3, 3, np.int64)).tolist()
    assert got == [1 + 10**9 * (c + 2) // (10**10 + 5 + 6) for c in big.tolist()]
