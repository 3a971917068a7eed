"""Token ids against the tokenizers library, and the round trip."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluicelog.llm import encode
from sluicelog.llm.encode import TOKENIZER_DIR

TOKENS = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
TOKENS.encode_special_tokens = True
ENCODER = encode.Encoder(encode.load_merges(), kept_words=1000)


def want(texts):
    return [x.ids for x in TOKENS.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = encode.encode(df, "doc_id", "text").collect()
    assert len(got) == len(texts)
    assert [r.ids for r in got] == want([texts[r.doc_id] for r in got])
    counts = {r.doc_id: r.n_tokens for r in encode.token_counts(df, "doc_id", "text").collect()}
    assert counts == {r.doc_id: len(r.ids) for r in got}


def test_cases(spark):
    texts = [None, "", " ", "<|endoftext|>", "a\x00b\x1c c", "it's we'll 'sit", "aaaaaaaa" * 9000, "\r\n \t\n  x", "日本語" * 500, "🎉👩‍👩‍👧", "é" * 9, "é", "  \xa0x"]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = encode.encode(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    expected = want(texts)
    for r in got:
        assert r.ids == expected[r.doc_id or 0]
    assert encode.encode(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab '\n\r\t.!1é日🎉́ x'stre"), max_size=60))
def test_random(text):
    ENCODER.trim()
    assert ENCODER.encode([text]) == want([text])
    assert TOKENS.decode(ENCODER.encode([text])[0], skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab '1é日🎉=-stre"), min_size=1, max_size=12), min_size=1, max_size=20, unique=True))
def test_both_ways_agree(words):
    assert ENCODER.side_by_side(words) == ENCODER.replay(words)


def test_words_are_replayed_once(spark, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_CHARS", 10)
    df = spark.createDataFrame([(i, "the same words " * 3) for i in range(50)], "doc_id int, text string").repartition(5)
    assert all(r.ids == want(["the same words " * 3])[0] for r in encode.encode(df, "doc_id", "text").collect())


def test_segments_are_cut_where_words_begin():
    rng = random.Random(2)
    for _ in range(40):
        text = "".join(rng.choice(["  ", " ", "\n", "ab", "'s", "1", ".", "日"]) for _ in range(500))
        parts = list(encode.segments(text, rng.randint(1, 60)))
        assert "".join(parts) == text
        assert [w for p in parts for w in encode._WORDS.findall(p)] == encode._WORDS.findall(text)
