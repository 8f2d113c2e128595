"""Conversation repair against a plain dynamic program over whole strings."""

import hashlib
import random
import re
import zlib

import pytest

from tallow.llm import conversation_repair as repairs

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in ("user" if f == 4 else role, text))
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def brute(rows, ids):
    """All audits by state, extended message by message; insertions anywhere."""
    out = []
    for conv in ids:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        best = {"": (0, "", [])}  # by initials so far, squeezed to (first is s, last)

        def spread(best):
            for _ in range(3):
                for made, (cost, audit, lines) in list(best.items()):
                    role = "assistant" if made.endswith("u") else "user"
                    put(best, made, cost + 3, audit + "I", lines, role, "")
            return best

        def put(best, made, cost, audit, lines, role, text):
            now = (made + role[:1])[-1:]
            if role[:1] not in ("s", "u", "a") or (role[0] == "s" and made) or (role[0] == "u" and made == "u") or (role[0] == "a" and made != "u"):
                return
            if now not in best or (cost, audit) < best[now][:2]:
                best[now] = (cost, audit, [*lines, f"{role}:{text}"])

        seen, counts, illegal, before = set(), [0, 0, 0], 0, None
        for _, role, text in mine:
            last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            after = {}
            for made, (cost, audit, lines) in spread(dict(best)).items():
                if made not in after or (cost + 4, audit + "D") < after[made][:2]:
                    after[made] = (cost + 4, audit + "D", lines)
                if fault >= 2:
                    more = 3 if fault == 2 else 0
                    put(after, made, cost + more, audit + "K", lines, role, text)
                    for to in ("user", "assistant"):
                        put(after, made, cost + 3 + more, audit + "R", lines, to, text)
            best = after
        cost, audit, lines = min(v for k, v in spread(best).items() if k in ("", "a"))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"]
    texts = ["Yes.", "No!", "Why?\n", "cut off", " \t\n", "", None, "A. B", "é。", "ok. ", "Yes."]
    out = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randrange(0, 9))]
    out += [(50, t, "user" if t % 2 else "assistant", f"m{t % 7}.") for t in range(300)]
    out += [(51, None, "user", "x."), (51, None, "user", "x."), (51, 3, "assistant", "y."), (51, 3, "assistant", "a."), (None, 1, "user", "q?"), (None, None, "assistant", "w."), (None, 9, "system", "s.")]
    out += [(52, 7, "system", "only.")] + [(53, t, "user", "word " * 20_000 + ".") for t in (1, 2)] + out[:20]
    return out


@pytest.mark.parametrize("stretch, partition", [(4096, 1 << 18), (3, 50)])
def test_repair_equals_brute_force(spark, monkeypatch, stretch, partition):
    monkeypatch.setattr(repairs, "STRETCH", stretch)
    monkeypatch.setattr(repairs, "PARTITION_ROWS", partition)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows()], SCHEMA + ", key string, place int")
    made = repairs.repair(repairs.damage(df), df)
    want = brute(damaged(rows()), {r[0] for r in rows()})
    assert sorted(map(tuple, made.audits.collect()), key=str) == want
    lines = {}
    for r in sorted(made.messages.collect(), key=lambda r: r["seq"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {w[0]: w[-1] for w in want} == {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in {r[0] for r in rows()}}


def test_repair_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    made = repairs.repair(repairs.damage(df), df)
    assert made.audits.collect() == [] and made.messages.collect() == []


@pytest.mark.parametrize("base", [0, 1, 1_315_423_911_877])
def test_order_of_linked_prefixes_in_spite_of_equal_hashes(base):
    rng = random.Random(1)
    tree, nodes = repairs.Prefixes(base), {}
    for _ in range(200):
        text, node = "".join(rng.choice("DIKR") for _ in range(rng.randrange(12))), 0
        for c in text:
            node = tree.add(node, ord(c))
        nodes[text] = node
        assert tree.text(node) == text
    assert all(tree.less(nodes[a], nodes[b]) == (a < b) for a in nodes for b in nodes)
