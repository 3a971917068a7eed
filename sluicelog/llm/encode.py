"""Encoding a corpus with a public byte-level BPE by replaying its merges over the words of the whole corpus.

Texts are cut into words block by block; a block keeps its different words and
each text as numbers of them. The words of all blocks are reduced to those of
the corpus, each once, and spread over the tasks. There their bytes lie in one
chain of symbols; an inverted index leads from a pair's rank to the places
where the pair stands. Ranks are taken in order: each merge is applied at all
its places, and only the neighbours it touches enter the index under the
(greater) ranks of the pairs they now form. The words' ids go back to the
blocks that hold the words, where they take the numbers' places.
"""

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..workdir import materialize

#: Where the tokenizers' files lie, unless a call names another folder.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k"
#: Fixed value: the public pattern that cuts texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block, of a long text's segment, and words that a worker keeps encoded from block to block.
BLOCK_CHARS, SEGMENT_CHARS, KEPT_WORDS = 4_000_000, 1_000_000, 400_000
#: Bytes up to which words are merged side by side, round by round, by ``Encoder``.
SHORT_BYTES = 48

_WORDS = regex.compile(PATTERN)
_CUT = regex.compile(r"(?<=\S)\s")


@dataclass(frozen=True)
class Merges:
    """First ids of the 256 bytes; for each rank the pair of ids and the id it becomes."""

    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    into: np.ndarray


def byte_names() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def load_merges(directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> Merges:
    """Read the vocabulary file; a few megabytes, whatever the corpus."""
    with open(f"{directory}/{name}.json", encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocabulary = model["vocab"]
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    return Merges(
        np.array([vocabulary[x] for x in byte_names()], np.int32), np.array([vocabulary[a] for a, _ in pairs], np.int32),
        np.array([vocabulary[b] for _, b in pairs], np.int32), np.array([vocabulary[a + b] for a, b in pairs], np.int32),
    )


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of about ``size`` characters that are cut into words as the whole is.

    White space after something else always begins a word, and how a word is
    found depends on nothing before it.
    """
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _cut(texts: Iterable[str | None]) -> list[list[str]]:
    return [[w for part in segments(t) for w in _WORDS.findall(part)] if t and len(t) > SEGMENT_CHARS else _WORDS.findall(t or "") for t in texts]


class Encoder:
    """Words and texts to ids, with the words of earlier blocks kept."""

    def __init__(self, merges: Merges, kept_words: int = KEPT_WORDS):
        self.byte_ids = merges.byte_ids
        self.left, self.right, self.into = (x.tolist() for x in (merges.left, merges.right, merges.into))
        self.width = int(max(merges.into.max(initial=0), merges.byte_ids.max())) + 1
        codes = merges.left.astype(np.int64) * self.width + merges.right
        self.rank = dict(zip(codes.tolist(), range(len(self.left)), strict=True))
        order = np.argsort(codes)
        self.codes, self.ranks, self.merged = codes[order], order, merges.into.astype(np.int64)
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}
        self.kept_words = kept_words

    def replay(self, words: list[str]) -> list[list[int]]:
        """The ids of different words, encoded together by merge replay."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(data) else 0
        symbols = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)].astype(np.int64)
        following = np.arange(1, total + 1)
        following[ends[lengths > 0] - 1] = -1
        previous = np.arange(-1, total - 1)
        previous[(ends - lengths)[lengths > 0]] = -1
        at = np.flatnonzero(following >= 0)
        ranks = self._ranks(symbols[at], symbols[at + 1])
        order = np.argsort(ranks, kind="stable")
        order = order[ranks[order] < len(self.left)]
        index: dict[int, list[int]] = {}
        if len(order):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(ranks[order])) + 1, [len(order)]))
            places = at[order]
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                index[int(ranks[order[i]])] = places[i:j].tolist()
        symbol, after, before = symbols.tolist(), following.tolist(), previous.tolist()
        queue = list(index)
        heapq.heapify(queue)
        rank_of, width = self.rank.get, self.width
        while queue:
            rank = heapq.heappop(queue)
            a, b, new = self.left[rank], self.right[rank], self.into[rank]
            for p in sorted(index.pop(rank)):
                if symbol[p] != a:
                    continue
                q = after[p]
                if q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -1
                r = after[p] = after[q]
                if r >= 0:
                    before[r] = p
                    got = rank_of(new * width + symbol[r])
                    if got is not None:
                        if got in index:
                            index[got].append(p)
                        else:
                            index[got] = [p]
                            heapq.heappush(queue, got)
                o = before[p]
                if o >= 0:
                    got = rank_of(symbol[o] * width + new)
                    if got is not None:
                        if got in index:
                            index[got].append(o)
                        else:
                            index[got] = [o]
                            heapq.heappush(queue, got)
        final = np.array(symbol, np.int64)
        alive = final >= 0
        upto = np.concatenate(([0], np.cumsum(alive)))
        ids = final[alive].tolist()
        return [ids[i:j] for i, j in zip(upto[ends - lengths].tolist(), upto[ends].tolist(), strict=True)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of ranks for none."""
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], len(self.codes))

    def side_by_side(self, words: list[str]) -> list[list[int]]:
        """The ids of different short words: every round applies the least rank of each word at all its places."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        word = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)))
        symbol = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)].astype(np.int64)
        none, done = len(self.codes), []
        while len(symbol):
            inner = np.append(word[1:] == word[:-1], False)
            rank = np.full(len(symbol), none)
            at = np.flatnonzero(inner)
            rank[at] = self._ranks(symbol[at], symbol[at + 1])
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = least == none
            if over.any():
                done.append((word[over], symbol[over]))
            take = np.flatnonzero((rank == least) & ~over)
            # of overlapping places in a run of one symbol the first, third and so on
            run = np.concatenate(([True], np.diff(take) != 1)) if len(take) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(run, take, 0))
            take = take[(take - first) % 2 == 0]
            symbol[take] = self.merged[rank[take]]
            keep = ~over
            keep[take + 1] = False
            word, symbol = word[keep], symbol[keep]
        if not done:
            return [[] for _ in words]
        word, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        ids = symbol[np.argsort(word, kind="stable")].tolist()
        upto = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words))))).tolist()
        return [ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True)]

    def trim(self) -> None:
        """Between blocks: forget all words once they are more than ``kept_words``."""
        if len(self.known) > self.kept_words:
            self.known.clear()
            self.sizes.clear()

    def words(self, texts: Iterable[str | None]) -> list[list[str]]:
        """The words of each text, with the ids of all of them at hand in ``known`` and their numbers in ``sizes``."""
        cut = _cut(texts)
        self.ensure(set().union(*cut))
        return cut

    def ensure(self, words: Iterable[str]) -> None:
        """Have the ids of these words at hand."""
        new = set(words).difference(self.known)
        short = [w for w in new if len(w) <= SHORT_BYTES // 4]
        long = [w for w in new if len(w) > SHORT_BYTES // 4]
        for part, way in ((short, self.side_by_side), (long, self.replay)):
            if part:
                got = way(part)
                self.known.update(zip(part, got, strict=True))
                self.sizes.update(zip(part, map(len, got), strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text; none for an empty or NULL one."""
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in self.words(texts)]

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Numbers of ids of each text."""
        return [sum(map(self.sizes.__getitem__, words)) for words in self.words(texts)]


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of texts of together about ``chars`` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict[int, tuple[Merges, Encoder]] = {}


def worker_encoder(shared) -> Encoder:
    """This worker's encoder for the broadcast ``Merges``, made once and kept with its words from task to task."""
    merges = shared.value
    if id(merges) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(merges)] = merges, Encoder(merges)
    return _ENCODERS[id(merges)][1]


def share(df: DataFrame, directory: str, name: str):
    """The merges for all tasks (a few megabytes, fixed by the tokenizer)."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(load_merges(directory, name))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) in; each text as numbers of its block's words, and one row with these words, out."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in blocks(texts):
            block, n = (task << 32) + n, n + 1
            cut = _cut(texts[i:j])
            number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut))))).astype(np.int32)
            flat = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int32, int(offsets[-1]))
            numbers = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            names = ["block", "id", "numbers", "words"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, block)), batch.column(0).slice(i, j - i), numbers, pa.nulls(j - i, pa.list_(pa.string()))], names)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, batch.column(0).type), pa.nulls(1, numbers.type), pa.array([list(number)], pa.list_(pa.string()))], names)


def _replayer(shared):
    """Different words in, with their ids out; as many at a time as a block has characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        words, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            got = encoder.replay(words)
            for i in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000]), pa.array(got[i : i + 50_000], pa.list_(pa.int32()))], ["word", "ids"])

        for batch in batches:
            new = batch.column(0).to_pylist()
            words += new
            size += sum(map(len, new))
            if size >= BLOCK_CHARS:
                yield from flush()
                words, size = [], 0
        if words:
            yield from flush()

    return run


def _fill(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The texts of a block with the ids of its words in place of their numbers."""
    ids = words.column("ids").combine_chunks()
    sizes = np.zeros(words.num_rows, np.int64)
    starts = sizes.copy()
    no = words.column("no").to_numpy()
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes[no], starts[no] = lengths, np.cumsum(lengths) - lengths
    numbers = texts.column("numbers").combine_chunks()
    each = numbers.value_lengths().to_numpy(zero_copy_only=False)
    flat = numbers.flatten().to_numpy()
    upto = np.concatenate(([0], np.cumsum(sizes[flat])))
    steps = np.arange(upto[-1]) - np.repeat(upto[:-1] - starts[flat], sizes[flat])
    offsets = upto[np.concatenate(([0], np.cumsum(each)))].astype(np.int32)
    return pa.table([texts.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.flatten().to_numpy()[steps], pa.int32()))], ["id", "ids"])


def encode(df: DataFrame, id: str, text: str, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``id`` and ``ids``, the token ids of ``text``, one row for each row.

    Empty and NULL texts give an empty list; spellings of special tokens are
    ordinary text; NULL and repeated ids stay. Letters and digits are those of
    the installed ``regex`` module's Unicode version. White space, control characters
    and any length are encoded as they are. Other columns are not read. The
    texts' words are written to the shared folder when this is called; a word
    that stands in every block is joined with one row a block, which AQE splits.
    """
    kind = df.schema[id].dataType.simpleString()
    shared = share(df, directory, name)
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    cut = materialize(rows.mapInArrow(_cutter, f"block long, id {kind}, numbers array<int>, words array<string>"), "words")
    words = cut.where("words IS NOT NULL").select("block", F.posexplode("words").alias("no", "word"))
    dictionary = words.select("word").distinct().mapInArrow(_replayer(shared), "word string, ids array<int>")
    held = words.join(dictionary, "word").select(F.col("block").alias("of_block"), "no", "ids")
    texts = cut.where("words IS NULL").select("block", "id", "numbers")
    filled = texts.groupBy("block").cogroup(held.groupBy("of_block")).applyInArrow(_fill, f"id {kind}, ids array<int>")
    return filled.withColumnsRenamed({"id": id})


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in blocks(texts):
                encoder.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(encoder.count(texts[i:j]), pa.int64())], ["id", "n_tokens"])

    return run


def token_counts(df: DataFrame, id: str, text: str, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``id`` and ``n_tokens`` of each row: numbers alone need no ids to travel, so each task encodes the words of its own blocks."""
    kind = df.schema[id].dataType.simpleString()
    shared = share(df, directory, name)
    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(_counter(shared), f"id {kind}, n_tokens long").withColumnsRenamed({"id": id})


def load_bytes(directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> list[bytes]:
    """What each id stands for."""
    with open(f"{directory}/{name}.json", encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte = {letter: b for b, letter in enumerate(byte_names())}
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def decoded_md5(df: DataFrame, id: str, ids: str, directory: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``id`` and ``md5`` of the bytes that ``ids`` stand for; NULL ids stand for none."""
    ship(df.sparkSession)
    spelled = df.sparkSession.sparkContext.broadcast(load_bytes(directory, name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        parts = spelled.value
        for batch in batches:
            sums = [hashlib.md5(b"".join([parts[i] for i in x or ()]), usedforsecurity=False).hexdigest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.string())], ["id", "md5"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), ids).mapInArrow(run, f"id {kind}, md5 string").withColumnsRenamed({"id": id})
