"""Benchmark decontamination with a generalised suffix automaton.

The test items' words become an automaton; document words stream through it
and the longest matching length at every word says which windows end there.  A
window is ``window`` consecutive words of an item; an item of fewer words is
one window.  Words are told apart by their 64-bit hashes (see textbatch).

Items are dealt into groups of bounded size; tasks build an automaton of each
and put it, as plain arrays, on shared storage.  Documents are read once: each
batch passes one automaton after the other, of which a worker process keeps
what fits in KEPT_BYTES and loads the others anew.
"""

from __future__ import annotations

import io
import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallow.llm import scratch
from tallow.llm.textbatch import ALNUM, Words, chunks

#: A word before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: UTF-8 bytes of item texts that one automaton takes, about; building takes some 240 bytes for each, the arrays some 10.
AUTOMATON_BYTES = 1 << 20
#: Words of a longer item's pieces, which overlap by a window.
PIECE_WORDS = 50_000
#: Bytes of automata that a worker process keeps.
KEPT_BYTES = 256 << 20


class SuffixAutomaton:
    """All substrings of some integer sequences; states have a length and a suffix link."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The part of q no longer than p's longest string and c, as a state."""
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another sequence had this string
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new = self._state(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def add(self, seq: list[int]) -> int:
        """The state of the whole sequence, which is the longest string there."""
        last = 0
        for c in seq:
            last = self._extend(last, c)
        return last

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """State and longest matching length after reading c."""
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)


class ItemIndex:
    """An automaton of items as arrays, with the items of every window and the words that may occur in one."""

    def __init__(self, window: int, ids: list[str], **arrays: np.ndarray):
        self.window, self.ids = window, ids
        self.__dict__ |= arrays
        self.arrays = arrays

    @classmethod
    def build(cls, items: list[tuple[str, str | None]], window: int) -> ItemIndex:
        ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(ids)}
        seqs = []
        for k, text in enumerate([t for _, t in items]):
            _, data, offs = next(chunks(pa.array([text], pa.string())))
            seqs.append((number[items[k][0]], Words(data, offs, ALNUM).hash))
        vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *[s for _, s in seqs]]))
        coded = [(k, np.searchsorted(vocab, s).tolist()) for k, s in seqs if len(s)]
        size = len(vocab)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(s[:-1], np.int64) * size + np.array(s[1:], np.int64) for _, s in coded]]))
        auto = SuffixAutomaton()
        for _, s in coded:
            auto.add(s)
        found: dict[int, set[int]] = {}  # of each state that holds strings of the window's length or the whole of a shorter item: those items
        short: set[int] = set()
        for k, s in coded:
            if len(s) < window:
                end = auto.add(s)  # a later item may have split the state that an earlier one ended in
                found.setdefault(end, set()).add(k)
                short.add(end)
        n = len(auto.len)
        up = [-1] * n  # the state of a state's suffix of the window's length
        shorter = [-1] * n  # the next state up the links that is a short item
        for v in sorted(range(1, n), key=auto.len.__getitem__):
            p = auto.link[v]
            up[v] = up[p] if auto.len[p] >= window else (v if auto.len[v] >= window else -1)
            shorter[v] = p if p in short else shorter[p]
        for k, s in coded:
            state = length = 0
            if len(s) >= window:
                for c in s:
                    state, length = auto.step(state, length, c)
                    if length >= window:
                        found.setdefault(up[state], set()).add(k)
        count = np.zeros(n + 1, np.int64)
        for v, x in found.items():
            count[v + 1] = len(x)
        edges = np.fromiter((v * size + c for v, moves in enumerate(auto.next) for c in moves), np.int64)
        ends = np.fromiter((to for moves in auto.next for to in moves.values()), np.int32)
        order = np.argsort(edges)
        return cls(
            window, ids, vocab=vocab, pairs=pairs, edges=edges[order], ends=ends[order], link=np.array(auto.link, np.int32), length=np.array(auto.len, np.int32), up=np.array(up, np.int32), shorter=np.array(shorter, np.int32),
            short=np.isin(np.arange(n), list(short)), first=np.cumsum(count), items=np.array([k for v in sorted(found) for k in sorted(found[v])], np.int32), least=np.array(min((min(window, len(s)) for _, s in coded), default=0)),
        )

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, head=np.frombuffer(json.dumps([self.window, self.ids]).encode(), np.uint8), **self.arrays)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> ItemIndex:
        with np.load(io.BytesIO(data)) as z:
            window, ids = json.loads(z["head"].tobytes())
            return cls(window, ids, **{k: z[k] for k in z.files if k != "head"})

    def _go(self, state: np.ndarray, length: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and longest matching lengths of many streams after one more word each."""
        state, length = state.copy(), length.copy()
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_].astype(np.int64) * len(self.vocab) + word[open_]
            spot = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[spot] == key
            state[open_[hit]] = self.ends[spot[hit]]
            length[open_[hit]] += 1
            open_ = open_[~hit]
            stuck = state[open_] == 0
            length[open_[stuck]] = 0
            open_ = open_[~stuck]
            state[open_] = self.link[state[open_]]
            length[open_] = self.length[state[open_]]
        return state, length

    def scan(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows met, as first words and words behind the last, and (text, item) pairs of one chunk."""
        none = np.zeros(0, np.int64)
        if not len(self.edges) or not len(words.hash):
            return none, none, none, none
        at = np.searchsorted(self.vocab, words.hash)
        at[at == len(self.vocab)] = 0
        known = self.vocab[at] == words.hash
        # A stretch of words each two of which stand together in some item: only there can a match be longer than a word.
        joined = known[:-1] & known[1:] & (words.doc[:-1] == words.doc[1:])
        idx = np.flatnonzero(joined)
        if len(self.pairs):
            key = at[idx].astype(np.int64) * len(self.vocab) + at[idx + 1]
            spot = np.searchsorted(self.pairs, key)
            spot[spot == len(self.pairs)] = 0
            joined[idx[self.pairs[spot] != key]] = False
        else:
            joined[:] = False
        begin = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        end = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
        far = end - begin >= self.least
        begin, end = begin[far], end[far]
        order = np.argsort(begin - end, kind="stable")  # longest first
        begin, size = begin[order], (end - begin)[order]
        state, length = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        spans, met = [(none, none)], [(none, none)]

        def note(which: np.ndarray, states: np.ndarray, long: np.ndarray, behind: int) -> None:
            spans.append((begin[which] + behind - long, begin[which] + behind))
            n = self.first[states + 1] - self.first[states]
            k = np.repeat(self.first[states] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            met.append((np.repeat(words.doc[begin[which]], n), self.items[k]))

        for i in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -i, "left"))  # streams of more than i words
            state, length = self._go(state[:m], length[:m], at[begin[:m] + i])
            whole = np.flatnonzero(length >= self.window)
            note(whole, self.up[state[whole]], np.full(len(whole), self.window), i + 1)
            u = np.where((length == self.length[state]) & self.short[state], state, self.shorter[state])
            which = np.flatnonzero(u > 0)
            while len(which):
                note(which, u[which], self.length[u[which]], i + 1)
                u[which] = self.shorter[u[which]]
                which = which[u[which] > 0]
        a, b = (np.concatenate(x) for x in zip(*spans))
        d, k = (np.concatenate(x) for x in zip(*met))
        return a, b, d, k


_kept: OrderedDict[str, tuple[ItemIndex, int]] = OrderedDict()


def _load(uri: str) -> ItemIndex:
    """An automaton from shared storage, or from this process's memory."""
    if uri in _kept:
        _kept.move_to_end(uri)
        return _kept[uri][0]
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        index = ItemIndex.loads(stream.read())
    _kept[uri] = index, sum(x.nbytes for x in index.arrays.values())
    while len(_kept) > 1 and sum(n for _, n in _kept.values()) > KEPT_BYTES:
        _kept.popitem(last=False)
    return index


def _scan_rows(uris: list[str], text_at: int):
    """Append the columns of SCAN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(base, Words(data, offs, ALNUM)) for base, data, offs in chunks(batch.column(text_at))]
            hit = [np.zeros(len(w.hash) + 1, np.int32) for _, w in parts]  # windows opened less those closed, before each word
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for uri in uris:
                index = _load(uri)
                for (base, words), opened in zip(parts, hit):
                    a, b, d, k = index.scan(words)
                    np.add.at(opened, a, 1)
                    np.subtract.at(opened, b, 1)
                    for doc, item in set(zip(d.tolist(), k.tolist())):
                        items[base + doc].add(index.ids[item])
            spans: list[list[dict[str, int]]] = []
            for (_, words), opened in zip(parts, hit):
                inside = np.cumsum(opened[:-1]) > 0
                new = np.ones(len(inside), bool)
                new[1:] = words.doc[1:] != words.doc[:-1]
                start = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside])[:-1]))
                end = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1 if len(inside) else start
                of: list[list[dict[str, int]]] = [[] for _ in words.count]
                for d, a, b in zip(words.doc[start].tolist(), (start - words.first[words.doc[start]]).tolist(), (end - words.first[words.doc[start]]).tolist()):
                    of[d].append({"a": a, "b": b})
                spans += of
            count = np.concatenate([np.zeros(0, np.int64), *[w.count for _, w in parts]])
            made = [pa.array(count), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *SCAN])

    return run


SCAN = {
    "__words": T.LongType(),
    "__spans": T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])),
    "__items": T.ArrayType(T.StringType()),
}


def _build_rows(folder: str, window: int):
    def run(table: pa.Table) -> pa.Table:
        index = ItemIndex.build(list(zip(table.column("id").to_pylist(), table.column("text").to_pylist())), window)
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.npz"  # a repeated task writes another file
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(index.dumps())
        return pa.table({"uri": [f"{folder}/{name}"]})

    return run


def automata(items: DataFrame, window: int = 13) -> list[str]:
    """Where the automata are that together hold all items."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # A very long item goes in pieces, none shorter than a window.
    piece = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)), F.lit(PIECE_WORDS)), lambda i: F.array_join(F.slice(w, i + 1, PIECE_WORDS + window - 1), " "))
    long = F.octet_length("text") > AUTOMATON_BYTES
    rows = rows.withColumn("w", F.when(long, words)).select("id", F.explode(F.when(long, piece(F.col("w"))).otherwise(F.array("text"))).alias("text"))
    group = F.pmod(F.xxhash64("id", "text"), F.lit(-(-size // AUTOMATON_BYTES) or 1)).alias("group")
    made = rows.select(group, "id", "text").groupBy("group").applyInArrow(_build_rows(scratch.folder(items.sparkSession, "automata"), window), "uri string")
    return [r[0] for r in scratch.table(made, "automaton-paths").collect()]  # a path for each AUTOMATON_BYTES of items


def scan(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """docs with __words (their number), __spans (hit word ranges, merged) and __items (ids of the items met)."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in SCAN.items()]])
    return docs.mapInArrow(_scan_rows(automata(items, window), docs.columns.index("text")), schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, max_percent: int = 5) -> DataFrame:
    """docs with n_words, n_hit, hit_spans, item_ids, contaminated and clean_text.

    docs needs a column text; all its columns are kept (one named like a new
    column is replaced).  items has item_id and text.  A word counts as hit
    inside any occurrence of a window; contaminated says that words are hit
    and make up max_percent of the text or more; clean_text is the text
    without the hit spans.  Null and empty texts have no words, are never
    contaminated, and a null stays null.  Items without words have no window;
    items of one id count once; an item without id goes by the name "null".
    Rows stay as they are, repeated ones too; empty tables give empty results
    or no hits.
    """
    new = ["n_words", "n_hit", "hit_spans", "item_ids", "contaminated", "clean_text"]
    found = scan(docs.drop(*new, *SCAN), items, window)
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    # Words and what stands before each: the text is gaps[0] words[0] gaps[1] ... gaps[n].
    gaps = F.split("text", WORD)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    inside = lambda i: F.exists("__spans", lambda s: (s["a"] <= i) & (i < s["b"]))
    kept = F.transform(F.col("__w"), lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(F.get(F.col("__g"), i), w)))
    clean = F.when(F.size("__spans") == 0, F.col("text")).otherwise(F.concat(F.array_join(kept, ""), F.element_at(F.col("__g"), -1)))
    some = F.size("__spans") > 0
    out = found.withColumns({"__w": F.when(some, words), "__g": F.when(some, gaps)})
    out = out.withColumns(
        {
            "n_words": F.col("__words"),
            "n_hit": hit,
            "hit_spans": F.col("__spans"),
            "item_ids": F.col("__items"),
            "contaminated": (hit > 0) & (100 * hit >= max_percent * F.col("__words")),
            "clean_text": clean,
        }
    )
    return out.drop("__w", "__g", *SCAN)
