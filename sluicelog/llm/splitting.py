"""Splitting texts over a token limit at natural boundaries, with overlap, by byte ranges.

Every text, short or long, is cut into ranges of ``RANGE`` bytes with halos by
the scan, in the JVM; the ranges are spread over all tasks by text and number.
A task sees one range at a time: it finds the first certain word boundary at or
after the range's start, and that of the next range in its halo, cuts the words
between into tokens and notes where words begin, how good a place to cut each
is, and how many bytes, characters and tokens lie before it in the range. The
notes of a text's ranges are stitched in order, their places found by summing
what the ranges before hold, and the best boundary in a piece's reach is chosen
as its cut, another one 32 to 64 tokens before it as the next piece's start.
Pieces are then cut by offset, in the JVM, from the range they begin in.

Counts are exact without encoding a piece again: words do not depend on what
lies before them; where a text ends after white space only that run changes
(``adjust``); and a long word cut between two of its tokens gives those tokens,
since no merge ever crossed that place. Only where a halo holds no certain
boundary at all, in one word or one run of white space of thousands of bytes, a
range begins at a seam inside it. A piece ends at the seam, the next one
begins before it and is kept to half the limit; it is counted again.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import TOKENIZER, TOKENIZER_DIR, Encoder, share, worker_encoder

PARAGRAPH, LINE, SENTENCE, WORD, INSIDE, SEAM = 4, 3, 2, 1, 0, -1
#: Bytes of a range, of its halo in which the next range must find its start, and before its start for the kind of that boundary.
RANGE, HALO, BEFORE = 65_536, 4_096, 256
#: Words of more tokens may be cut inside, between tokens and characters.
LONG_WORD = 16
#: Bytes of ranges whose words are encoded together.
BLOCK_BYTES = 4_000_000

_CERTAIN = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_SENTENCE = regex.compile(r"""[.!?…]+["'”’)\]]*(?=\s)|[。！？]+[”’」』）]*""")
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


@dataclass(frozen=True)
class Limits:
    """Most tokens of a piece, and least and most tokens that consecutive pieces share."""

    most: int = 512
    least_shared: int = 32
    most_shared: int = 64

    def __post_init__(self):
        # boundaries are at most 2 * LONG_WORD tokens apart, so with such limits there is always one to cut at
        if not (self.least_shared >= 2 * LONG_WORD and self.most_shared - self.least_shared >= 2 * LONG_WORD and self.most >= 8 * self.most_shared):
            raise ValueError(f"limits must leave room for overlaps of {2 * LONG_WORD} tokens or more, {2 * LONG_WORD} to choose from, and eight overlaps a piece")

    @property
    def least(self) -> int:
        """Tokens from a piece's start beyond which it may be cut."""
        return self.most // 4


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds(text: str, white: np.ndarray, newline: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The kind of each boundary ``at`` > 0 characters."""
    kind = np.where(white[at] | white[at - 1], WORD, INSIDE).astype(np.int8)
    if ends := [m.end() for m in _SENTENCE.finditer(text)]:
        mark = np.zeros(len(text) + 1, bool)
        mark[ends] = True
        kind[mark[at]] = SENTENCE
    # newlines in the run of white space that ends at the boundary
    lines = np.concatenate(([0], np.cumsum(newline)))
    run = np.maximum.accumulate(np.concatenate(([0], np.where(white, 0, np.arange(1, len(white) + 1)))))
    passed = lines[at] - lines[run[at]]
    kind[passed == 1] = LINE
    kind[passed >= 2] = PARAGRAPH
    return kind


@dataclass
class Part:
    """The words that a range owns: where they begin, whether at a seam, their text, and what stands before it."""

    begin: int
    seam: bool
    text: str
    before: str


def _start(data: bytes, offset: int, at: int, length: int, halo: int) -> tuple[int, bool]:
    """Where the words of the range from byte ``at`` begin, and whether that is a seam; ``data`` holds the text from ``offset`` on."""
    if at <= 0 or at >= length:
        return max(0, min(at, length)), False
    i = at - offset
    while i < len(data) and data[i] & 0xC0 == 0x80:
        i += 1
    j = i - 1
    while j > 0 and data[j] & 0xC0 == 0x80:
        j -= 1
    window = data[j : i + halo].decode("utf-8", "ignore")
    found = _CERTAIN.search(window, 1)
    if found:
        return offset + j + len(window[: found.start()].encode()), False
    return (length, False) if at + halo >= length else (offset + i, True)


def owned(data: bytes | None, r: int, length: int, size: int, halo: int) -> Part:
    """What range ``r`` owns: from its own start to that of the next range."""
    if not data:
        return Part(0, False, "", "")
    offset = max(0, r * size - BEFORE)
    begin, seam = _start(data, offset, r * size, length, halo)
    end, _ = _start(data, offset, (r + 1) * size, length, halo)
    return Part(begin, seam, data[begin - offset : end - offset].decode(), data[max(0, begin - offset - BEFORE) : begin - offset].decode("utf-8", "ignore"))


def boundaries(part: Part, words: list[str], encoder: Encoder, byte_lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of bytes, characters and tokens before each boundary of the part, its kind and adjustment; and the tokens in all."""
    known, text = encoder.known, part.text
    tokens = np.fromiter(map(encoder.sizes.__getitem__, words), np.int64, len(words))
    chars = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    upto = np.cumsum(tokens)
    total = int(upto[-1]) if len(words) else 0
    data = np.frombuffer(text.encode(), np.uint8)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at, before = chars[:-1], upto[:-1]
    code = _codes(text)
    white, newline = _WHITE[np.minimum(code, 0x3001)], code == 10
    adjust = np.zeros(len(at), np.int8)
    dropped = np.zeros(len(at), bool)
    if len(at):
        # a text that ends after a run of white space has one word of it, not two
        ends_white = white[at - 1]
        both = np.flatnonzero(ends_white[1:] & ends_white[:-1]) + 1
        runs = [words[i - 1] + words[i] for i in both.tolist()]
        if runs:
            encoder.ensure(runs)
        for i, run in zip(both.tolist(), runs, strict=True):
            adjust[i] = max(-100, min(100, len(known[run]) - tokens[i - 1] - tokens[i]))
            dropped[i] = tokens[i - 1] > LONG_WORD
    extra = []
    for i in np.flatnonzero(tokens > LONG_WORD).tolist():
        word = words[i]
        cut = np.cumsum(byte_lengths[known[word]])[:-1]
        first = byte_at[chars[i] - len(word)]
        place = np.searchsorted(byte_at, first + cut)
        whole = byte_at[place] == first + cut
        # a lone space before a cut would join the white space before it, a last apostrophe the letters after it
        whole &= ~((cut == 1) & (word[0] == " ") & (word[-1] != " ")) & ~((place == chars[i] - 1) & (word[-1] == "'"))
        extra.append((place[whole], upto[i] - tokens[i] + 1 + np.flatnonzero(whole)))
    kind = _kinds(text, white, newline, at)
    if dropped.any():
        at, before, kind, adjust = (x[~dropped] for x in (at, before, kind, adjust))
    if extra:
        places, counts = (np.concatenate(x) for x in zip(*extra, strict=True))
        at, before = np.concatenate((at, places)), np.concatenate((before, counts))
        kind, adjust = np.concatenate((kind, np.zeros(len(places), np.int8))), np.concatenate((adjust, np.zeros(len(places), np.int8)))
        order = np.argsort(at, kind="stable")
        at, before, kind, adjust = at[order], before[order], kind[order], adjust[order]
    if part.begin and words:
        own = SEAM
        if not part.seam:
            around = part.before + text[0]
            spot = np.array([len(part.before)])
            codes = _codes(around)
            own = int(_kinds(around, _WHITE[np.minimum(codes, 0x3001)], codes == 10, spot)[0])
        at, before = np.concatenate(([0], at)), np.concatenate(([0], before))
        kind, adjust = np.concatenate(([own], kind)), np.concatenate(([0], adjust))
    return np.stack((byte_at[at], at, before, kind, adjust)).astype(np.int64), total


def pack_notes(notes: np.ndarray) -> bytes:
    """Places as steps of two bytes, kind and adjustment of one: what follows is at most a range away."""
    steps = np.diff(notes[:3], axis=1, prepend=0)
    return steps.astype(np.uint16).tobytes() + notes[3:].astype(np.int8).tobytes()


def unpack_notes(data: bytes) -> np.ndarray:
    """The notes that were packed."""
    n = len(data) // 8
    places = np.frombuffer(data, np.uint16, 3 * n).reshape(3, n).astype(np.int64)
    return np.concatenate((np.cumsum(places, axis=1), np.frombuffer(data, np.int8, 2 * n, 6 * n).reshape(2, n).astype(np.int64)))


def _best(b: np.ndarray, start: int, low: int, high: int, most: int) -> int | None:
    """Of the boundaries with ``low`` < tokens before <= ``high`` that leave at most ``most`` from ``start``, the last of the best kind."""
    i, j = np.searchsorted(b[2], (low, high), side="right")
    fits = np.flatnonzero(b[2, i:j] + b[4, i:j] - start <= most)
    if not len(fits):
        return None
    kinds = b[3, i:j][fits]
    return int(i + fits[len(fits) - 1 - np.argmax(kinds[::-1])])


class Stitcher:
    """Pieces of one text from the notes of its ranges, taken in order; holds the notes from the open piece on."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.held = np.zeros((5, 0), np.int64)
        self.bytes = self.chars = self.tokens = 0
        #: Bytes, characters and tokens before the open piece.
        self.start = (0, 0, 0)

    def add(self, begin: int, chars: int, tokens: int, notes: bytes) -> None:
        """The next range's notes, placed behind what came before."""
        if notes:
            new = unpack_notes(notes)
            new[:3] += np.array([[begin], [self.chars], [self.tokens]])
            self.held = np.concatenate((self.held[:, self.held[2] > self.start[2]], new), axis=1)
        self.chars += chars
        self.tokens += tokens

    def _seam(self) -> int | None:
        i = np.searchsorted(self.held[2], self.start[2], side="right")
        seams = np.flatnonzero(self.held[3, i:] == SEAM)
        return int(i + seams[0]) if len(seams) else None

    def pieces(self, length: int, ended: bool) -> Iterator[tuple[tuple[int, int, int], tuple[int, int], int, bool]]:
        """(start, end in bytes and characters, tokens, counted exactly) of the pieces that no later range can change."""
        most, least_shared, most_shared = self.limits.most, self.limits.least_shared, self.limits.most_shared
        while ended or self.start[2] + most + 4 * LONG_WORD < self.tokens:
            b, start = self.held, self.start[2]
            left = self.tokens - start
            if not b.shape[1] and not ended:
                return
            seam = self._seam()
            if seam is not None and b[2, seam] - start > most:
                seam = None
            crosses = seam is not None and b[2, seam] - start <= most_shared
            if ended and left <= (most if seam is None else most // 2 if crosses else 0):
                yield self.start, (length, self.chars), left, seam is None
                return
            if seam is not None and not crosses:
                c = seam  # what is left of a seam is counted as if the text ended there
            elif crosses:
                c = _best(b, start, int(b[2, seam]) + most_shared, start + most // 2, most)
            else:
                c = _best(b, start, start + self.limits.least, start + most + 2 * LONG_WORD, most)
            end = int(b[2, c] + b[4, c])
            yield self.start, (int(b[0, c]), int(b[1, c])), end - start, not crosses
            s = _best(b, start, end - most_shared - 1, end - least_shared, most)
            self.start = (int(b[0, s]), int(b[1, s]), int(b[2, s]))


def _byte_lengths(directory: str, name: str) -> np.ndarray:
    import json

    with open(f"{directory}/{name}.json", encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = np.ones(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


_KEY = ["doc", "hash", "length", "range_no"]


def ranges(df: DataFrame, id: str, text: str, size: int, right: int) -> DataFrame:
    """``id, doc, hash, length, range_no, slice``: the byte ranges of all texts with halos, cut in the JVM and spread by text and range."""
    raw = df.select(F.col(id).alias("id"), F.make_valid_utf8(F.col(text)).cast("binary").alias("raw"))
    keyed = raw.select("id", F.xxhash64("id").alias("doc"), F.xxhash64("raw").alias("hash"), F.coalesce(F.length("raw"), F.lit(0)).alias("length"), "raw")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("int"))
    at = F.greatest(F.col("range_no").cast("long") * size - BEFORE, F.lit(0))
    upto = (F.col("range_no").cast("long") + 1) * size + right
    each = keyed.select("id", "doc", "hash", "length", "raw", F.explode(numbers).alias("range_no"))
    return each.select("id", *_KEY, F.substring("raw", (at + 1).cast("int"), F.least(upto - at, F.lit(2**31 - 1)).cast("int")).alias("slice")).repartition(*_KEY)


def _reader(shared, limits: Limits, size: int, halo: int):
    """Ranges in; what each owns and its notes out. A text of one range within the limit needs no notes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, byte_lengths = worker_encoder(shared[0]), shared[1].value
        for batch in batches:
            lengths, numbers, slices = (batch.column(batch.schema.get_field_index(c)) for c in ("length", "range_no", "slice"))
            keys = [batch.column(batch.schema.get_field_index(c)) for c in _KEY]
            i = 0
            while i < batch.num_rows:
                parts, n = [], 0
                j = i
                while j < batch.num_rows and n < BLOCK_BYTES:
                    part = owned(slices[j].as_py(), numbers[j].as_py(), lengths[j].as_py(), size, halo)
                    parts.append(part)
                    n += len(part.text)
                    j += 1
                encoder.trim()
                rows = []
                for part, words, length in zip(parts, encoder.words([p.text for p in parts]), lengths.slice(i, j - i).to_pylist(), strict=True):
                    if length <= size and (total := sum(map(encoder.sizes.__getitem__, words))) <= limits.most:
                        rows.append((0, len(part.text), total, b""))
                        continue
                    notes, total = boundaries(part, words, encoder, byte_lengths)
                    rows.append((part.begin, len(part.text), total, pack_notes(notes)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[k.slice(i, j - i) for k in keys], *columns], [*_KEY, "begin", "chars", "tokens", "notes"])
                i = j

    return run


_SPAN = [("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("exact", pa.bool_())]


def _stitcher(limits: Limits, size: int):
    """Notes of one text after another in, ranges in order; its pieces out, each with the range it begins in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, text, piece_no = None, -1, Stitcher(limits), 0
        for batch in batches:
            rows = []
            for doc, hash, length, range_no, begin, chars, tokens, notes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, hash, length) != now:
                    now, last, text, piece_no = (doc, hash, length), -1, Stitcher(limits), 0
                if range_no == last:  # a row stored twice has each range twice, all alike
                    continue
                last = range_no
                ended = (range_no + 1) * size >= length
                if ended and not range_no and not notes:
                    rows.append((*now, 0, 0, 0, length, 0, chars, tokens, True))
                    continue
                text.add(begin, chars, tokens, notes)
                for start, end, n, exact in text.pieces(length, ended):
                    rows.append((*now, start[0] // size, piece_no, start[0], end[0], start[1], end[1], n, exact))
                    piece_no += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[t for _, t in _SPAN]]
                names = [*_KEY, "piece_no", *[n for n, _ in _SPAN]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def _recount(shared):
    """Pieces in and out; those over a seam are counted again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact = batch.column("exact")
            if exact.false_count:
                encoder = worker_encoder(shared[0])
                encoder.trim()
                where = np.flatnonzero(~exact.to_numpy(zero_copy_only=False))
                counts = batch.column("n_tokens").to_numpy().copy()
                counts[where] = encoder.count(batch.column("text").take(pa.array(where)).to_pylist())
                batch = batch.set_column(batch.schema.get_field_index("n_tokens"), "n_tokens", pa.array(counts, pa.int64()))
            yield batch.select([c for c in batch.schema.names if c != "exact"])

    return run


def split(
    df: DataFrame, id: str, text: str, limits: Limits = Limits(), directory: str = TOKENIZER_DIR, name: str = TOKENIZER,
    size: int = RANGE, halo: int = HALO,
) -> DataFrame:
    """Pieces of all texts: ``id, piece_no, start, end, n_tokens, text``. Lazy.

    A text within the limit is its only piece, as are empty and NULL texts with
    0 tokens; a longer one has pieces of at most ``limits.most`` tokens, counted
    on the piece alone, that end at the best break from a quarter of the limit on
    (paragraph, line, sentence, word; inside a word only where it is very long),
    the last of its kind, begin at the best one near, and share
    ``least_shared`` to ``most_shared`` tokens with the next. Offsets count
    characters from 0, ``end`` is exclusive. Repeated rows are split as often as
    they occur; NULL ids stay; bytes that are no UTF-8 count as U+FFFD. Other
    columns are not read. A single word or run of white space that fills a whole
    halo is cut at seams between ranges; pieces over a seam hold about half as much.
    """
    if size < 4 * halo or halo < 64:
        raise ValueError("a halo has at least 64 bytes and a range four halos")
    kind = df.schema[id].dataType.simpleString()
    byte_lengths = _byte_lengths(directory, name)
    shared = share(df, directory, name), df.sparkSession.sparkContext.broadcast(byte_lengths)
    # no piece has more bytes than this many of the longest tokens, so it lies whole in the slice it begins in
    right = max(halo + 8, (limits.most + 2 * LONG_WORD) * int(byte_lengths.max()))
    slices = ranges(df, id, text, size, right)
    notes = slices.mapInArrow(_reader(shared, limits, size, halo), "doc long, hash long, length int, range_no int, begin long, chars long, tokens long, notes binary")
    ordered = notes.repartition("doc", "hash", "length").sortWithinPartitions("doc", "hash", "length", "range_no")
    spans = ordered.mapInArrow(
        _stitcher(limits, size), "doc long, hash long, length int, range_no int, piece_no int, start_byte long, end_byte long, start long, end long, n_tokens long, exact boolean"
    )
    at = F.greatest(F.col("range_no").cast("long") * size - BEFORE, F.lit(0))
    piece = F.substring("slice", (F.col("start_byte") - at + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")).cast("string")
    pieces = slices.join(spans, _KEY).select("id", "piece_no", F.col("start").cast("int"), F.col("end").cast("int"), "n_tokens", "exact", piece.alias("text"))
    out = f"id {kind}, piece_no int, start int, end int, n_tokens long, text string"
    return pieces.mapInArrow(_recount(shared), out).withColumnsRenamed({"id": id})
