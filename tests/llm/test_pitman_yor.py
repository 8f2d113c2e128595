"""The Pitman-Yor model against a sampler over plain dictionaries, and its draws against their exact law."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallow.llm import pitman_yor as hpy
from tallow.llm.textbatch import NOT_SPACE, Words

OPEN, CLOSE = object(), object()


def key_of(word):
    if word is OPEN or word is CLOSE:
        return hpy.BEGIN if word is OPEN else hpy.END
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)]), NOT_SPACE).hash[0]


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), CLOSE]


def discount(counts):
    once, twice = sum(c == 1 for c in counts), sum(c == 2 for c in counts)
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def drawn(c, chance, d, key, sweep):
    return int(hpy.seat(np.array([c]), np.array([chance]), d, np.array([key], np.uint64), sweep, hpy.stirling_logs(d))[0])


def brute(rows, sweeps, burn_in):
    train = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1
    cells, words = Counter(), Counter()
    for d, text in rows:
        if train(d):
            w = split(text)
            words.update(w)
            cells.update(zip([OPEN, *w], w))
    v, n, contexts = len(words), sum(words.values()), Counter()
    for (u, _), c in cells.items():
        contexts[u] += c
    t, history = {x: 1 for x in cells}, []
    d1 = discount(cells.values())

    def summed():
        tables, customers = Counter(), Counter()
        for (u, w), k in t.items():
            tables[u] += k
            customers[w] += k
        return tables, customers

    tables, customers = summed()
    d0 = discount(customers.values())
    own = {w: 1 for w in customers}
    history.append((dict(t), tables, customers, own))

    def parent(s, w, less=0):
        _, _, customers, own = history[s]
        left = max(customers[w] - less, 0)
        new = (1 + d0 * sum(own.values())) / (v + 1)
        return (left - d0 * min(own.get(w, 0), left) + new) / (1 + max(sum(customers.values()) - less, 0))

    for s in range(1, sweeps + 1):
        before, tables, _, own = history[-1]
        t = {(u, w): drawn(c, (1 + d1 * (tables[u] - before[u, w])) * parent(s - 1, w, before[u, w]), d1, hpy.pair_keys(np.array([key_of(u)]), np.array([key_of(w)]))[0], s) for (u, w), c in cells.items()}
        chance = (1 + d0 * sum(own.values())) / (v + 1)
        tables, customers = summed()
        history.append((dict(t), tables, customers, {w: drawn(c, chance, d0, key_of(w), s) for w, c in customers.items()}))

    def p(u, w):
        used = range(burn_in + 1, sweeps + 1)
        return sum((cells[u, w] - d1 * history[s][0].get((u, w), 0) + (1 + d1 * history[s][1][u]) * parent(s, w)) / (1 + contexts[u]) for s in used) / len(used)

    for u in [OPEN, "the", "never seen", next(iter(words))]:
        assert sum(p(u, w) for w in words) + p(u, "never seen") == pytest.approx(1)
    out = []
    for d, text in rows:
        w = split(text)
        base = sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((d, not train(d), len(w), sum(x in words for x in w), n, base, sum(math.log10(p(u, x)) for u, x in zip([OPEN, *w], w))))
    return out


def texts():
    rng = np.random.default_rng(2)
    vocabulary = ["the", "The", "of", "cat", "é", "世界", "a-b", "x."] + [f"w{k}" for k in range(40)]
    out = [(int(i), " ".join(rng.choice(vocabulary, int(rng.integers(0, 40)), p=[0.2, 0.1, 0.2, 0.1, 0.05, 0.03, 0.02, 0.1] + [0.005] * 40))) for i in range(60)]
    return out + [(7, "the of the"), (7, "the of the"), (None, "null id"), (61, None), (62, ""), (63, "\n\t "), (64, "the of " * 3000), (66, "new words only here " * 3)]


@pytest.mark.parametrize("chunk, bucket", [(8 << 20, 1 << 20), (300, 16)])
def test_scores_equal_those_of_plain_dictionaries(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(hpy, "BUCKET_KEYS", bucket)
    df = spark.createDataFrame([(*r, "c", 1) for r in texts()], "doc_id long, text string, chunk string, score int").repartition(3 if bucket == 16 else 1)
    got = sorted((tuple(r)[:7] for r in hpy.score(df).collect()), key=str)
    want = sorted(brute(texts(), hpy.SWEEPS, hpy.BURN_IN), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("rows", [[], [(5, "one two"), (6, None)]])
def test_scores_without_training_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r)[:7] for r in hpy.score(df, train="false").collect()) == [(d, True, len(split(t)), 0, 0, 0.0, 0.0) for d, t in rows]


def test_seatings_follow_their_law():
    d, n = 0.6, 40_000
    keys = np.arange(n, dtype=np.uint64)
    for c, chance in ((2, 0.3), (5, 2.0), (20, 0.5)):
        t = hpy.seat(np.full(n, c), np.full(n, chance), d, keys, 1, hpy.stirling_logs(d))
        s = {(0, 0): 1.0}
        for k in range(c):
            for j in range(k + 2):
                s[k + 1, j] = s.get((k, j - 1), 0) + (k - d * j) * s.get((k, j), 0)
        law = np.array([s[c, j] * chance**j for j in range(1, c + 1)])
        got = np.bincount(t, minlength=c + 1)[1:] / n
        assert np.abs(got - law / law.sum()).max() < 0.01
    far = hpy.seat(np.full(2000, 5000), np.full(2000, 1.5), d, keys[:2000], 1, hpy.stirling_logs(d))
    assert far.min() >= 1 and far.max() <= 5000 and 8 < far.mean() < 25


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    assert (hpy.unpacked(hpy.packed(keys, True), np.uint64, True) == keys).all()
    for a in (np.zeros(0, np.int64), np.array([-5, 1 << 60]), rng.integers(0, 9, 77)):
        assert (hpy.unpacked(hpy.packed(a)) == a).all()
