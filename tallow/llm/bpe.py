"""Byte-level BPE on whole Arrow batches.

The library's pre-tokens are found with numpy for texts of code points below
0x530 (Latin, Greek, Cyrillic), whose classes are stable; all other texts, and
those with the special string, go through the library's own pre-tokeniser.
What a pre-token encodes to is computed once and kept by its 64-bit hash,
beside its code points, which a later pre-token of that hash must equal.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from tokenizers import Tokenizer

from tallow.llm.textbatch import chunks, run_hashes

SPACE, LETTER, NUMBER, OTHER, FAR = range(5)
_LIMIT = 0x530
_CLASS = np.full(_LIMIT + 1, FAR, np.uint8)
for _c in range(_LIMIT):
    _ch = chr(_c)
    _CLASS[_c] = SPACE if regex.match(r"\s", _ch) else LETTER if regex.match(r"\p{L}", _ch) else NUMBER if regex.match(r"\p{N}", _ch) else OTHER

#: Bytes of text handled at once: each takes some forty bytes meanwhile.
CHUNK = 1 << 20
#: Pre-tokens kept by one worker; beyond it starts anew.
KEPT = 400_000
#: Bytes of a pre-token from which on it is counted by itself.
LONG_PRE_TOKEN = 64


class Kept:
    """Ragged int32 values by pre-token: its 64-bit hash and, to be sure, its code points."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.spot = np.zeros(0, np.int64)  # of each key its place in the columns below
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.text_at = np.zeros(0, np.int64)
        self.text_size = np.zeros(0, np.int64)
        self.points = np.zeros(0, np.uint32)

    def _same(self, spot: np.ndarray, pre: PreTokens) -> np.ndarray:
        """Which distinct pre-tokens have the code points kept at spot."""
        at, size = pre.start[pre.example], pre.end[pre.example] - pre.start[pre.example]
        same = self.text_size[spot] == size
        old, new, size = self.text_at[spot][same], at[same], size[same]
        unlike = gather(self.points, old, size) != gather(pre.points, new, size)
        if unlike.any():
            same[np.flatnonzero(same)[np.unique(np.repeat(np.arange(len(size)), size)[unlike])]] = False
        return same

    def find(self, pre: PreTokens, make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in flat of each distinct pre-token; make gives the values, one after the other, and their numbers, of texts not kept yet."""
        if len(self.keys) > KEPT:
            self.clear()
        keys = pre.keys
        near = np.searchsorted(self.keys, keys)
        near[near == len(self.keys)] = 0
        known = self.keys[near] == keys if len(self.keys) else np.zeros(len(keys), bool)
        spot = np.zeros(len(keys), np.int64)
        spot[known] = self.spot[near[known]]
        held = known.copy()
        if known.any():
            same = np.zeros(len(keys), bool)
            same[known] = self._same(self.spot[near], pre)[known]
            held &= same
        new = np.flatnonzero(~held)
        if len(new):
            values, size = make(pre.texts(new))
            spot[new] = len(self.at) + np.arange(len(new))
            text_at, text_size = pre.start[pre.example[new]], (pre.end - pre.start)[pre.example[new]]
            add = lambda old, more: np.concatenate([old, more])
            self.at, self.size = add(self.at, len(self.flat) + np.cumsum(size) - size), add(self.size, size)
            self.flat = add(self.flat, values)
            self.text_at, self.text_size = add(self.text_at, len(self.points) + np.cumsum(text_size) - text_size), add(self.text_size, text_size)
            self.points = add(self.points, gather(pre.points, text_at, text_size))
            fresh = np.flatnonzero(~known)  # a hash stays with its first owner
            every = add(self.keys, keys[fresh])
            order = np.argsort(every, kind="stable")
            self.keys, self.spot = every[order], add(self.spot, spot[fresh])[order]
        return self.at[spot], self.size[spot]


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces flat[at : at + size] one after the other."""
    behind = np.cumsum(size)
    total = int(behind[-1]) if len(behind) else 0
    return flat[np.repeat(at - (behind - size), size) + np.arange(total)]


class PreTokens:
    """Pre-tokens of one chunk: code point ranges, owning text, hash; slow texts are left to the library."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        self.begin, n = begin, len(points)
        code = np.minimum(points, _LIMIT)
        kind = _CLASS[code]
        self.points = points
        self.slow = set((np.searchsorted(begin, np.flatnonzero(kind == FAR), "right") - 1).tolist())
        at = data.tobytes().find(b"<|endoftext|>") if n else -1
        while at >= 0:
            self.slow.add(int(np.searchsorted(offs, at, "right")) - 1)
            at = data.tobytes().find(b"<|endoftext|>", at + 1)
        start = np.zeros(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        bounds = np.zeros(n + 1, bool)
        bounds[begin] = True
        start |= bounds
        start[n] = True
        edge = np.flatnonzero(start)
        run, behind = edge[:-1], edge[1:]
        # White space gives its last character to what follows, if that is a blank; else it is a token of its own.
        gap = (kind[run] == SPACE) & ~bounds[behind]
        last = behind[gap] - 1
        start[last] = True
        start[behind[gap][points[last] == 0x20]] = False
        # 's 't 'm 'd 're 've 'll
        mark = np.flatnonzero((kind[run] == OTHER) & (behind - run == 1) & (points[run] == 39) & start[run] & ~bounds[behind]) if n else []
        for i in mark:
            p, end = int(run[i]), int(behind[i + 1])
            if kind[p + 1] != LETTER:
                continue
            word = "".join(map(chr, points[p + 1 : min(p + 3, end)]))
            long = 2 if word[:1] in "stmd" else 3 if word in ("re", "ve", "ll") else 0
            if long:
                start[p + 1] = False
                start[p + long] = True
        self.start = np.flatnonzero(start[:n])
        self.end = np.append(self.start[1:], n)
        self.hash = run_hashes(code, self.start, self.end)
        self.doc = np.searchsorted(begin, self.start, "right") - 1
        fast = np.ones(len(offs), bool)
        fast[list(self.slow)] = False
        keep = fast[self.doc]  # pre-tokens of slow texts would be for nothing
        self.start, self.end, self.hash, self.doc = self.start[keep], self.end[keep], self.hash[keep], self.doc[keep]
        self.keys, self.example, self.number = np.unique(self.hash, return_index=True, return_inverse=True)

    def texts(self, which: np.ndarray) -> list[str]:
        """The strings of some of the distinct pre-tokens."""
        i = self.example[which]
        at, size = self.start[i], self.end[i] - self.start[i]
        whole = gather(self.points, at, size).tobytes().decode("utf-32-le", "replace")
        ends = np.cumsum(size).tolist()
        return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def slow_text(self, doc: int) -> str:
        return self.data[self.offs[doc] : self.offs[doc + 1]].tobytes().decode("utf-8", "replace")


def raw_vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]], list[str]]:
    """(ids of the tokens' bytes, merges in order, special strings) of a tokenizers file."""
    spec = json.load(open(path, encoding="utf-8"))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
    raw = lambda s: bytes(byte[c] for c in s)
    added = sorted(t["content"] for t in spec["added_tokens"])
    pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in added}, [(raw(a), raw(b)) for a, b in pairs], added


class Encoder:
    """Token ids of texts, as the library gives them without added special tokens.

    Single pre-tokens go through a second engine with the same vocabulary,
    several times as fast and lighter; it merges by id, so ids must be in the
    order of the merges, which is checked.
    """

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        ids, merges, _ = raw_vocabulary(path)
        order = [ids[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self.one = tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=ids, special_tokens={}).encode_ordinary
        self.kept = Kept()

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = list(map(self.one, texts))
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum())), size

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offs in chunks(texts, CHUNK):
            pre = PreTokens(data, offs)
            at, size = self.kept.find(pre, self._many)
            at, size = at[pre.number], size[pre.number]
            flat = gather(self.kept.flat, at, size)
            ends = np.cumsum(np.bincount(pre.doc, weights=size, minlength=len(offs) - 1)).astype(np.int64)
            for d, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                if d in pre.slow:
                    yield np.array(self.lib.encode(pre.slow_text(d), add_special_tokens=False).ids, np.int32)
                else:
                    yield flat[a:b]


class PrefixCounter:
    """Exact token counts of every prefix, by dynamic programming over a pre-token's prefixes.

    The last token of a prefix is the one whose pair with the last token before
    it is stable, that is, byte pair encoding of the two strings together gives
    just these two; there is exactly one.  Counts follow from the shorter
    prefix, so nothing is encoded twice.  Candidates are the tokens that end a
    prefix, longest first, from an Aho-Corasick automaton of the vocabulary;
    whether a pair is stable is read off the merge trees of its two tokens.
    All new pre-tokens of a chunk advance together, a byte at a time.
    """

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        ids, merges, self.special = raw_vocabulary(path)
        self.width = max(ids.values()) + 1
        order = [ids[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        #: Of a token made by a merge: its two parts; of a single byte: itself twice.
        self.left, self.right = np.arange(self.width), np.arange(self.width)
        self.left[order], self.right[order] = [ids[a] for a, _ in merges], [ids[b] for _, b in merges]
        pair = self.left[order] * self.width + self.right[order]
        by_pair = np.argsort(pair)
        self.pairs, self.made = pair[by_pair], np.array(order, np.int64)[by_pair]
        #: Whether any merge's pair has these bits of a product; most pairs looked up are no merge.
        self.perhaps = np.zeros(1 << 22, bool)
        self.perhaps[self._bits(pair)] = True
        self._automaton(ids)
        self.kept = Kept()
        self.far: dict[str, list[int]] = {}

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """Aho-Corasick over the vocabulary: moves of every state by byte, and the longest token that ends at each."""
        #: Of each token its length in bytes and the longest shorter token that ends it.
        self.size, self.shorter = np.zeros(self.width, np.int64), np.zeros(self.width, np.int64)
        children: dict[int, int] = {}
        token, levels = [-1], [[]]
        for text, k in ids.items():
            self.size[k], s = len(text), 0
            while len(levels) <= len(text):
                levels.append([])
            for depth, byte in enumerate(text, 1):
                to = children.get(s << 8 | byte)
                if to is None:
                    to = children[s << 8 | byte] = len(token)
                    levels[depth].append((s, byte, to))
                    token.append(-1)
                s = to
            token[s] = k
        self.moves = moves = np.zeros((len(token), 256), np.int32)
        self.token = np.array(token, np.int64)
        back = np.zeros(len(token), np.int64)
        for level in filter(None, levels):
            s, byte, to = np.array(level, np.int64).T
            back[to] = np.where(s > 0, moves[s, byte], 0)  # where the longest proper suffix goes, until the next line
            moves[s, byte] = to
            moves[to] = moves[back[to]]
            own, ends = self.token[to], self.token[back[to]]
            self.shorter[own[own >= 0]] = ends[own >= 0]
            self.token[to] = np.where(own >= 0, own, ends)

    @staticmethod
    def _bits(pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def _stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of tokens a and b comes before those that build them.

        Walks down both trees along the border, undoing the later merge first:
        what crosses the border then must be merged before the undone one.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), self.width)
        while len(at):
            pair = a * self.width + b
            cross = np.flatnonzero(self.perhaps[self._bits(pair)])
            wrong = np.zeros(len(at), bool)
            if len(cross):
                spot = np.minimum(np.searchsorted(self.pairs, pair[cross]), len(self.pairs) - 1)
                wrong[cross] = (self.pairs[spot] == pair[cross]) & (self.made[spot] < limit[cross])
                out[at[wrong]] = False
            a_in, b_in = self.right[a], self.left[b]
            undo_a = (a_in != a) & ((a > b) | (b_in == b))
            go = (undo_a | (b_in != b)) & ~wrong
            limit = np.where(undo_a, a, b + 1)[go]
            a, b, at = np.where(undo_a, a_in, a)[go], np.where(undo_a, b, b_in)[go], at[go]
        return out

    def prefixes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of text[:1], text[:2] ... of each pre-token, one after the other, and how many each has."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        long = np.flatnonzero(length > LONG_PRE_TOKEN)
        order = np.argsort(-length, kind="stable")[len(long) :]
        width, n = int(length[order[0]]) if len(order) else 0, len(order)
        # Column by column over all texts that are long enough: these stand first.
        data = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in order.tolist()), np.uint8).reshape(n, width).T if width else np.zeros((0, n), np.uint8)
        last, count = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        state, every = np.zeros(n, np.int64), np.arange(n)
        fall = np.searchsorted(-length[order], -np.arange(width + 1), "right")
        for i in range(1, width + 1):
            m = int(fall[i])
            state = self.moves[state[:m], data[i - 1, :m]].astype(np.int64)
            t = self.token[state]
            a = i - self.size[t]
            open_ = np.flatnonzero(a)
            while len(open_):
                fits = self._stable(last[a[open_], open_].astype(np.int64), t[open_])
                open_ = open_[~fits]
                t[open_] = self.shorter[t[open_]]
                a[open_] = i - self.size[t[open_]]
                open_ = open_[a[open_] > 0]
            last[i, :m], count[i, :m] = t, count[a, every[:m]] + 1
        # Back to the given order, code points only: a prefix ends where no continuation byte follows.
        ends = np.cumsum(length)
        flat, starts = np.zeros(int(length.sum()), np.int32), ends - length
        row, col = np.nonzero(np.arange(width)[:, None] < length[order][None, :])
        flat[starts[order][col] + row] = count[row + 1, col]
        for i in long.tolist():
            flat[starts[i] : ends[i]] = self._one(raw[i])
        text = np.frombuffer(b"".join(raw), np.uint8)
        whole = np.append(text[1:] & 0xC0 != 0x80, True) if len(text) else np.zeros(0, bool)
        whole[ends[length > 0] - 1] = True
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return flat[whole], sizes

    def _one(self, data: bytes) -> list[int]:
        """The same for one very long pre-token, byte by byte."""
        last, count, s = [0], [0], 0
        stable: dict[tuple[int, int], bool] = {}
        for i, byte in enumerate(data, 1):
            s = self.moves.item(s, byte)
            t = self.token.item(s)
            a = i - self.size.item(t)
            while a:
                pair = last[a], t
                if pair not in stable:
                    if len(stable) > KEPT:
                        stable.clear()
                    stable[pair] = bool(self._stable(np.array(pair[:1]), np.array(pair[1:]))[0])
                if stable[pair]:
                    break
                t = self.shorter.item(t)
                a = i - self.size.item(t)
            last.append(t)
            count.append(count[a] + 1)
        return count[1:]

    def prefix(self, text: str) -> list[int]:
        """Token counts of text[:1], text[:2] ... of one pre-token."""
        return self.prefixes([text])[0].tolist()

    def _slow(self, text: str) -> np.ndarray:
        """Counts of every prefix, the empty one first, for any text."""
        base, out, plain = 0, [0], ""  # plain: the text since the last special string, with base tokens before it
        for part in regex.split(f"({'|'.join(map(regex.escape, self.special))})", text) if self.special else [text]:
            if part in self.special:
                out += [base + c for c in self.prefix_of_plain(plain + part[:-1])[len(plain) :]]
                base = (out[-len(part)] if len(out) >= len(part) else 0) + 1
                out.append(base)
                plain = ""
            else:
                out += [base + c for c in self.prefix_of_plain(part)]
                plain = part
        return np.array(out, np.int32)

    def prefix_of_plain(self, text: str) -> list[int]:
        out: list[int] = []
        base = 0
        spans = [x for _, x in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        if len(self.far) > KEPT:
            self.far.clear()
        new = list({text[a:b] for a, b in spans} - self.far.keys())
        flat, size = self.prefixes(new)
        ends = np.cumsum(size).tolist()
        self.far |= {t: flat[x - len(t) : x].tolist() for t, x in zip(new, ends)}
        for a, b in spans:
            counts = self.far[text[a:b]]
            out += [base + c for c in counts]
            base += counts[-1]
        return self._spaces(text, out)

    def _spaces(self, text: str, out: list[int]) -> list[int]:
        """A prefix that ends in white space has the whole of it as one pre-token; a cut contraction is two."""
        for m in regex.finditer(r"\s{2,}", text):
            base = out[m.start() - 1] if m.start() else 0
            for k, c in enumerate(self.prefix(m.group())):
                out[m.start() + k] = base + c
        for m in regex.finditer(r"(?<! )(?<![^\s\p{L}\p{N}])'(?:re|ve|ll)", text):
            out[m.start() + 1] = (out[m.start() - 1] if m.start() else 0) + 2
        return out

    def counts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Per text the counts of all its prefixes, from the empty one to the whole."""
        for _, data, offs in chunks(texts, CHUNK):
            pre = PreTokens(data, offs)
            at, size = self.kept.find(pre, self.prefixes)
            at, size = at[pre.number], size[pre.number]
            inner = gather(self.kept.flat, at, size)
            whole = self.kept.flat[at + size - 1] if len(at) else np.zeros(0, np.int32)
            total = np.cumsum(whole) - whole
            n_docs = len(offs) - 1
            per_doc = np.bincount(pre.doc, weights=whole, minlength=n_docs).astype(np.int64)
            before = np.cumsum(per_doc) - per_doc
            counts = (inner + np.repeat(total - before[pre.doc], size)).astype(np.int32)
            points_of = np.bincount(pre.doc, weights=size, minlength=n_docs).astype(np.int64)
            ends = np.cumsum(points_of)
            for d in range(n_docs):
                if d in pre.slow:
                    yield self._slow(pre.slow_text(d))
                    continue
                a, b = int(pre.begin[d]), int(pre.begin[d + 1])
                own = np.concatenate([np.zeros(1, np.int32), counts[ends[d] - points_of[d] : ends[d]]])
                space = _CLASS[np.minimum(pre.points[a:b], _LIMIT)] == SPACE
                if (space[1:] & space[:-1]).any() or (pre.points[a:b] == 39).any():
                    own[1:] = self._spaces(pre.slow_text(d), own[1:].tolist())
                yield own


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One engine, with its memory of pre-tokens, per worker process."""
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One engine, with its memory of pre-tokens, per worker process."""
    return PrefixCounter(path)
