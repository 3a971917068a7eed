"""Pieces: limits, overlap, coverage, breaks, and ranges against whole texts."""

import random

import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluicelog.llm import splitting
from sluicelog.llm.encode import TOKENIZER_DIR

TOKENS = Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
TOKENS.encode_special_tokens = True


def count(text):
    return len(TOKENS.encode(text, add_special_tokens=False).ids)


def check(texts, rows, limits=splitting.Limits()):
    """texts: id to text; rows of one copy."""
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        pieces = sorted(by[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        total = count(text or "")
        assert (len(pieces) > 1) == (total > limits.most)
        if len(pieces) == 1:
            assert pieces[0].text == text and pieces[0].n_tokens == total
            continue
        assert pieces[0].start == 0 and pieces[-1].end == len(text)
        for p in pieces:
            assert p.text == text[p.start : p.end] and p.n_tokens == count(p.text) <= limits.most
        for a, b in zip(pieces, pieces[1:]):
            assert a.start < b.start < a.end < b.end
            assert limits.least_shared <= count(text[b.start : a.end]) <= limits.most_shared, (i, text[b.start : a.end])


def words(rng, n):
    return "".join(rng.choice(["the", "Quarterly", "naïve", "probe", "12345", "x"]) + rng.choice([" ", " ", " ", " ", ". ", ", ", "\n", "\n\n", "; ", "! "]) for _ in range(n))


def odd_texts():
    rng = random.Random(5)
    return {
        0: None, 1: "", 2: " ", 3: words(rng, 300), 4: words(rng, 3000), 5: words(rng, 30_000), 6: "日本語のとても長い文章" * 900, 7: "a" * 20_000, 8: "ab1" * 9_000, 9: "\n" * 9_000, 10: " " * 70_000, 11: "🎉" * 4_000,
        12: "x " * 6_000, 13: "word " * 513, 14: "\r\n".join(words(rng, 20) for _ in range(200)), 15: "=" * 50_000 + "\n" + words(rng, 2_000), 16: "tail " * 8_192 + "x" * 40, 17: "é" * 30_000 + " " + words(rng, 9_000),
        18: "".join(chr(rng.choice([*range(33, 127), *range(0x400, 0x450), 0x4E00, 0x1F600])) for _ in range(12_000)), 19: "<|endoftext|>" * 700,
    }


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, v, "clash", 7) for k, v in odd_texts().items()], "doc_id long, text string, hash string, start int").repartition(3)


def test_odd_texts(odd):
    check(odd_texts(), splitting.split(odd, "doc_id", "text").collect())


def test_ranges_equal_whole(odd):
    names = ["doc_id", "piece_no", "start", "end", "n_tokens", "text"]
    whole = {(r.doc_id, r.piece_no): r for r in splitting.split(odd, "doc_id", "text", size=2**30).select(*names).collect()}
    rows = splitting.split(odd, "doc_id", "text", size=12_000, halo=3_000).collect()
    check(odd_texts(), rows)
    # only where one word or run of white space fills a halo do ranges show
    plain = [i for i, t in odd_texts().items() if not (t and regex.search(r"\p{L}{2500}|\s{2500}|[^\s\p{L}\p{N}]{700}", t))]
    assert len(plain) > 12
    for i in plain:
        assert {(r.doc_id, r.piece_no): (r.start, r.end, r.n_tokens) for r in rows if r.doc_id == i} == {k: (r.start, r.end, r.n_tokens) for k, r in whole.items() if k[0] == i}


def test_one_long_text_is_read_by_many_tasks(spark):
    text = words(random.Random(3), 200_000)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shares = [r.n for r in splitting.ranges(df, "doc_id", "text", 16_384, 70_000).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == -(-len(text.encode()) // 16_384) and len(shares) == 4 and max(shares) < sum(shares) / 2


def test_repeated_rows_and_null_ids(spark):
    text = words(random.Random(1), 20_000)
    df = spark.createDataFrame([(1, text)] * 3 + [(None, text)] * 2 + [(2, "a")] * 2, "doc_id long, text string")
    rows = splitting.split(df, "doc_id", "text").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) % 3 == 0 and len([r for r in rows if r.doc_id is None]) == len(one) // 3 * 2 and len([r for r in rows if r.doc_id == 2]) == 2
    check({1: text}, set(one))


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check({r.doc_id: r.text for r in df.collect()}, splitting.split(df, "doc_id", "text").collect())


def test_natural_breaks(spark):
    paragraph = "This is a sentence of several words. " * 8
    text = "\n\n".join([paragraph.strip()] * 20)
    rows = splitting.split(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").orderBy("piece_no").collect()
    assert all(text[: r.end].endswith("\n\n") for r in rows[:-1])


@pytest.mark.parametrize("end", [". ", "\n"])
@pytest.mark.parametrize("size", [splitting.RANGE, 3_000])
def test_rare_breaks(spark, end, size):
    rng = random.Random(11)
    text = "".join(" ".join(rng.choice(["probe", "sends", "the", "rows"]) for _ in range(rng.randint(100, 300))) + end for _ in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(splitting.split(df, "doc_id", "text", size=size, halo=size // 4).collect(), key=lambda r: r.piece_no)
    check({1: text}, rows)
    assert all(text[: r.end].rstrip(" ").endswith(end.strip(" ")) for r in rows[:-1])


def test_empty(spark):
    with pytest.raises(ValueError):
        splitting.Limits(40, 10, 20)
    assert splitting.split(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    assert splitting.split(spark.createDataFrame([("a", None)], "k string, text string").withColumn("x", F.lit(1)), "k", "text").first().n_tokens == 0
