import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallow.llm.bpe import Encoder, PrefixCounter, prefix_counter
from tallow.llm.textbatch import Words, NOT_SPACE, chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a", " ", "  ", "a  b", "a \n b", "\n\n x", "don't we'll I've they're o'clock 'tis ''s x's'd", "it's", "'", "'s", "x '", "12ab34 ²½", "a b   c", "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>", "Привет мир", "日本語 text 😀!", "tab\t\tend  ", "###***$$$ x&&&", "naïve façade ÀÉ", "we'RE we'r we'v", "a" * 3000, "Съешь ещё этих мягких булок, да выпей чаю. ёж Ґанок", "我能吞下玻璃而不伤身体。 你好你好 世界", "Ελληνικά γράμματα ώστε", "ab" * 90 + " x", "x" * 70]


def thue_morse(letters: str, n: int = 1024) -> str:
    """A word that a polynomial hash modulo 2^64 confuses with the one of swapped letters, at any base."""
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


TWINS = [thue_morse("ab"), thue_morse("ba")]


def texts():
    rows = duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' limit 120").fetchall()
    return ODD + [r[0] for r in rows]


def test_encoder_equals_library():
    lib, all_texts = Tokenizer.from_file(PATH), texts()
    for t, ids in zip(all_texts, Encoder(PATH).encode(pa.array(all_texts))):
        assert ids.tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_counts_of_whole_texts_equal_library():
    lib, all_texts = Tokenizer.from_file(PATH), texts()
    for t, c in zip(all_texts, prefix_counter(PATH).counts(pa.array(all_texts))):
        assert len(c) == len(t or "") + 1
        assert c[-1] == len(lib.encode(t or "", add_special_tokens=False).ids), t


@pytest.mark.parametrize("t", [t for t in ODD if t and len(t) < 100])
def test_counts_of_every_prefix_equal_library(t):
    lib = Tokenizer.from_file(PATH)
    c = next(prefix_counter(PATH).counts(pa.array([t])))
    want = [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
    assert c.tolist() == want


def test_counts_of_prefixes_of_prose():
    lib = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    some = texts()[len(ODD) : len(ODD) + 20]
    for t, c in zip(some, prefix_counter(PATH).counts(pa.array(some))):
        for k in rng.integers(0, len(t) + 1, 15).tolist():
            assert c[k] == len(lib.encode(t[:k], add_special_tokens=False).ids), (t, k)


def test_thue_morse_twins_stay_apart():
    for base in (0, 1):
        _, data, offs = next(chunks(pa.array(TWINS)))
        assert len(set(Words(data, offs, NOT_SPACE, base=base).hash.tolist())) == 2
    lib = Tokenizer.from_file(PATH)
    engine, counter = Encoder(PATH), PrefixCounter(PATH)
    for batch in (TWINS, TWINS[::-1]):  # the second time from memory
        for t, ids, c in zip(batch, engine.encode(pa.array(batch)), counter.counts(pa.array(batch))):
            want = lib.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want and c[-1] == len(want)


def test_equal_hashes_are_told_apart_by_their_letters(monkeypatch):
    monkeypatch.setattr("tallow.llm.bpe.run_hashes", lambda code, start, end: np.array([7 if e - s == 5 else hash((s, e)) & 0xFFFFFFFF for s, e in zip(start.tolist(), end.tolist())], np.uint64))
    lib, engine = Tokenizer.from_file(PATH), Encoder(PATH)
    for t in ("house", "mouse", "xyzzy", "house"):
        assert next(engine.encode(pa.array([t]))).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_very_long_words_hash_by_content_not_place():
    word = "abcdefghij" * 300_000
    _, data, offs = next(chunks(pa.array([word + " x " + word + " " + word[:-1] + "k"])))
    h = Words(data, offs, NOT_SPACE).hash
    assert h[0] == h[2] != h[3]
