"""Registered queries against brute force, and the operators' odd cases that test_operators leaves out."""

import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallow.llm import html_crf, jaccard_join, packing, quality_classifier, token_counts
from tallow.llm.queries import QUERIES
from tests.llm.test_operators import brute_components, corpus, SCHEMA

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def documents():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def test_query_of_token_counts(spark, library):
    got = sorted(map(tuple, QUERIES["op9_token_counts"](spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
    want = []
    for d, t in documents():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)


def pieces_of(library, text, capacity):
    ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or capacity
    cuts = [0, *range(first, len(ids), capacity), len(ids)]
    return [(a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for a, b in zip(cuts, cuts[1:])]


def test_query_of_packing(spark, library):
    rows = QUERIES["op7_packing"](spark, SF).collect()
    want = sorted((d, k, *p) for d, t in documents() for k, p in enumerate(pieces_of(library, t, 2048)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 2048) + 1


def test_packing_hashes_of_odd_texts(spark, library):
    from tests.llm.test_bpe import ODD, TWINS

    texts = [*ODD, *TWINS, "word " * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((d, k, *p) for d, t in enumerate(texts) for k, p in enumerate(pieces_of(library, t, 300)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(df, PATH, capacity=300).collect()) == want


def test_prefix_counts_of_long_repeated_and_clashing_rows(spark, library):
    long = "Ein längerer Satz mit Wörtern, ёж и 世界. " * 6000 + "x" * 200_000
    df = spark.createDataFrame([(1, long, "old"), (2, "a b", "old"), (2, "a b", "old")], "doc_id long, text string, prefix_tokens string")
    out = token_counts.prefix_counts(df, PATH).select("doc_id", F.size("prefix_tokens").alias("k"), token_counts.tokens_of(F.col("prefix_tokens")).alias("n")).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, len(long) + 1, len(library.encode(long, add_special_tokens=False).ids)), (2, 4, 2), (2, 4, 2)]


def test_jaccard_join_with_the_keys_shuffled(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", 0)
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(corpus(), SCHEMA)).collect()), key=str)
    assert got == brute_components(corpus())


def test_scores_of_very_long_texts(spark):
    df = spark.createDataFrame([(i, f"A sentence number {i}. " * (20_000 if i == 7 else 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    out = quality_classifier.score(df, labels, sample=5).collect()
    assert len(out) == 40 and all(0 <= r["score"] <= 1 for r in out)


# Pages written by hand in layouts that the generator of training pages does not know: (html, main text).
HAND = [
    ("<!doctype html><html><head><title>x</title></head><body><div id=top><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About</a></div><main><h1>River floods the valley</h1><p>After three days of heavy rain the river left its bed on Tuesday night and flooded most of the lower valley.</p><p>Firefighters brought forty families to the school, where volunteers had put up beds and cooked soup.</p></main><div class=related><h3>Read also</h3><ul><li><a href=/1>Storm warning</a></li><li><a href=/2>New bridge</a></li></ul></div><div class=foot>Copyright 2024 Valley Post. <a href=/imprint>Imprint</a></div></body></html>",
     "River floods the valley After three days of heavy rain the river left its bed on Tuesday night and flooded most of the lower valley. Firefighters brought forty families to the school, where volunteers had put up beds and cooked soup."),
    ("<html><body><table><tr><td width=150><a href=a>Index</a><br><a href=b>Links</a></td><td><h2>Growing tomatoes</h2>Tomatoes like warm and sunny places. Sow them indoors in March and plant them out when the nights are no longer cold.<p>Water the soil and never the leaves, or they will get ill.</p></td></tr></table><script>var a=1;</script></body></html>",
     "Growing tomatoes Tomatoes like warm and sunny places. Sow them indoors in March and plant them out when the nights are no longer cold. Water the soil and never the leaves, or they will get ill."),
    ("<html><body><header><nav><a href=/>Start</a><a href=/blog>Blog</a></nav></header><article class=post><h1>How I fixed my old radio</h1><p>The set is from 1957 and had been silent for years before I opened it last week.</p><blockquote>Never touch the big capacitor, my grandfather used to say.</blockquote><p>Two resistors were burnt; new ones cost me less than a coffee, and now it plays again.</p></article><section id=comments><h3>2 comments</h3><div class=comment><p>Great, thanks for this!</p></div><div class=comment><p>Mine hums, any idea?</p></div></section><footer>Powered by a blog engine</footer></body></html>",
     "How I fixed my old radio The set is from 1957 and had been silent for years before I opened it last week. Never touch the big capacitor, my grandfather used to say. Two resistors were burnt; new ones cost me less than a coffee, and now it plays again."),
    ("<html><body><div class='cookie'>We use cookies to improve your visit. <button>Accept</button></div><div class=wrap><div class=side><h4>Newsletter</h4><form><input type=email><button>Subscribe</button></form></div><div class=text><h1>The lighthouse keeper</h1><p>Every evening at six he climbed the hundred and twelve steps and lit the lamp, and every morning he put it out again.</p><div class=ad>Buy one, get one free!</div><p>When the electric light came he stayed, because nobody else knew the names of the gulls.</p></div></div></body></html>",
     "The lighthouse keeper Every evening at six he climbed the hundred and twelve steps and lit the lamp, and every morning he put it out again. When the electric light came he stayed, because nobody else knew the names of the gulls."),
]


def test_extraction_of_pages_written_by_hand(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HAND)] + [(0, HAND[0][0])], "page_id long, html string")
    rows = html_crf.extract(df).collect()
    assert len({r["text"] for r in rows if r["page_id"] == 0}) == 1
    right = found = wanted = 0
    for r in rows:
        a, b = re.findall(r"\w+", r["text"]), re.findall(r"\w+", HAND[r["page_id"]][1])
        right, found, wanted = right + sum(min(a.count(w), b.count(w)) for w in set(b)), found + len(a), wanted + len(b)
    print("words: precision", right / max(found, 1), "recall", right / wanted)
    assert right / max(found, 1) >= 0.85 and right / wanted >= 0.85
