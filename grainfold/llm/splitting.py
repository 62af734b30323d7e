"""Oversized texts cut into pieces at natural boundaries, with overlap.

A text, in a column or in a file, is taken apart into byte ranges. Where a range begins is
found from the bytes around its nominal begin alone, so neighbours agree on it without
meeting. A worker reads its range and as many bytes before it as the overlap may need,
lists the places where the text may be cut with running token counts, chooses the cuts and
reads the pieces by offset. Pieces of a text of several ranges are numbered by prefix sums
over one row per range. A file is never loaded whole: ranges are read from storage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.llm import tokens
from grainfold.session import written

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Split:
    """limit, overlap: tokens; range_bytes: nominal size of a range; halo: bytes behind its
    nominal begin in which the best boundary is looked for, below half a range; path: the
    tokenizer's file (None: the installed default)."""

    limit: int = 1024
    overlap: int = 64
    range_bytes: int = 1_048_576
    halo: int = 4096
    path: str | None = None

    def file(self) -> str:
        return self.path or tokens.default_path()


# A place to cut is where blanks begin behind a word: there the tokenizer begins anew
# whatever surrounds it, so token counts add up. The bytes are those of UTF-8 blanks.
_BEHIND_WORD = rb"(?<![ \t\n\r\x0b\x0c\x1c-\x1f])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe2\x80[\x80-\x8a\xa8\xa9\xaf])(?<!\xe2\x81\x9f)(?<!\xe3\x80\x80)"
_PLACES = [re.compile(x) for x in (_BEHIND_WORD + rb"[ \t\r\x0b\x0c]*\n[ \t\r\x0b\x0c]*\n", rb"(?<=[.!?])[ \t\n\r\x0b\x0c]", _BEHIND_WORD + rb"[ \t\n\r\x0b\x0c]")]
_LEAD = 4


def range_begin(read: Read, size: int, part: int, s: Split) -> int:
    """Where range `part` begins: within the halo behind its nominal begin at the first end of
    a paragraph, else of a sentence, else of a word; else at the next end of a word, however
    far. A run without blanks thus belongs whole to the range it begins in."""
    nominal = part * s.range_bytes
    if part == 0 or nominal >= size:
        return min(nominal, size)
    body = read(nominal - _LEAD, min(size, nominal + s.halo))
    for place in _PLACES:
        if m := place.search(body, _LEAD):
            return nominal - _LEAD + m.start()
    at, step = nominal + s.halo, s.halo
    while at < size:
        if m := _PLACES[-1].search(read(at - _LEAD, min(size, at + step)), _LEAD):
            return at - _LEAD + m.start()
        at, step = at + step, 2 * step
    return size


def _context(read: Read, begin: int, least: int) -> int:
    """The last place to cut that is `least` bytes or more before `begin`; 0 if there is none."""
    end, step = begin - least, 256
    while end > 0:
        a = max(0, end - step)
        found = list(_PLACES[-1].finditer(read(max(0, a - _LEAD), end + 1), min(a, _LEAD)))
        if found:
            return max(0, a - _LEAD) + found[-1].start()
        end, step = a, 4 * step
    return 0


_SPACE, _STOP, _CLOSE = b" \t\n\r\x0b\x0c", b".!?", b"\"')]}"
_IS_SPACE, _IS_STOP, _IS_CLOSE = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (_SPACE, _STOP, _CLOSE))
TOKEN, WORD, SENTENCE, PARAGRAPH = 0, 1, 2, 3


def boundaries(raw: bytes, e, lengths: np.ndarray, longest_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(byte offset, tokens before, kind) of every place a text may be cut, and its tokens.

    PARAGRAPH: the blanks behind a word hold two line ends or more; SENTENCE: a stop (and
    closing marks) stands before; WORD: any other. In a stretch of more than `longest_run`
    tokens without a place every token begin is one, as kind TOKEN.
    """
    ids = np.array(e.encode_ordinary(raw.decode("utf-8", "replace")), dtype=np.int64)
    n = len(ids)
    body = np.frombuffer(raw, dtype=np.uint8)
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(lengths[ids], out=at[1:])
    inner = at[1:-1] if n else at[:0]
    space = _IS_SPACE[body]
    word_end = space[inner] & ~space[inner - 1]
    ended, close = _IS_STOP[body].copy(), _IS_CLOSE[body]
    for _ in range(3):  # closing marks behind the stop
        ended[1:] |= close[1:] & ended[:-1]
    kind = np.where(word_end, np.where(ended[inner - 1], SENTENCE, WORD), TOKEN)
    lines = np.concatenate([[0], np.cumsum(body == 10)])
    solid = np.append(np.flatnonzero(~space), len(body))
    behind = solid[np.searchsorted(solid, inner)]
    kind[word_end & (lines[behind] - lines[inner] >= 2)] = PARAGRAPH
    lead = (body & 0xC0) != 0x80  # a token may begin inside a character; no cut lies there
    keep = word_end.copy()
    if n > longest_run:
        marks = np.concatenate([[-1], np.flatnonzero(keep), [len(inner)]])
        gap = np.diff(marks)
        keep |= np.repeat(gap > longest_run, gap)[: len(inner)] & lead[inner]
    return inner[keep], np.flatnonzero(keep) + 1, kind[keep], n


def choose_cuts(at: np.ndarray, tok: np.ndarray, kind: np.ndarray, total: tuple[int, int], begin: int, s: Split) -> Iterator[tuple[int, int, int]]:
    """(first, last, tokens) of the pieces of one range. at, tok, kind: the places to cut, the
    range's begin among them or 0; total: the range's end; begin: index of the range's begin.

    A piece ends at the best kind of boundary in its last half, else anywhere in it, the
    latest of that kind. The next begins at the last place that is `overlap` tokens or more
    before. The last piece holds more than `overlap` new tokens, so that the next range's
    first piece begins behind its begin.
    """
    back = lambda t: int(np.searchsorted(tok, t - s.overlap, side="right")) - 1
    first = max(0, back(tok[begin])) if begin else 0
    inside, new = bool(kind[first] == TOKEN), int(tok[begin])
    while total[1] - tok[first] > s.limit:
        lo, hi = np.searchsorted(tok, max(tok[first] + s.overlap, new), side="right"), np.searchsorted(tok, tok[first] + s.limit, side="right")
        # The best kind of boundary in the last half of the piece, else anywhere in it.
        half = np.searchsorted(tok, tok[first] + max(s.limit // 2, s.overlap + 1), side="left")
        a = max(lo, half) if max(lo, half) < hi else lo
        if a >= hi:
            raise ValueError("no place to cut within the limit")
        if kind[a:hi].max() == TOKEN or inside:
            # Tokens of a parted run may fall otherwise once it stands alone: leave room.
            hi = max(a + 1, int(np.searchsorted(tok, tok[first] + s.limit - max(4, s.limit // 32), side="right")))
        hi = max(a + 1, min(hi, int(np.searchsorted(tok, total[1] - s.overlap - 1, side="right"))))
        cut = a + int(np.flatnonzero(kind[a:hi] == kind[a:hi].max())[-1])
        yield int(at[first]), int(at[cut]), int(tok[cut] - tok[first])
        new, nxt = int(tok[cut]), back(tok[cut])
        first = nxt if nxt > first else cut
        inside = bool(kind[first] == TOKEN)
    yield int(at[first]), total[0], total[1] - int(tok[first])


def cut_range(body: bytes, ctx: int, begin: int, s: Split, e, lengths: np.ndarray) -> tuple[int, list[tuple[int, int, int]]]:
    """(tokens of the range, its pieces): body holds the bytes from ctx on, the range those from begin."""
    if begin == ctx and len(body) <= s.limit:
        n = len(e.encode_ordinary(body.decode("utf-8", "replace")))  # cannot exceed the limit: never cut
        return n, [(ctx, ctx + len(body), n)]
    at, tok, kind, n = boundaries(body, e, lengths, max(1, (s.limit - s.overlap) // 4))
    at, tok, kind = np.append(0, at), np.append(0, tok), np.append(PARAGRAPH, kind)
    own = int(np.searchsorted(at, begin - ctx))
    if own == len(at) or at[own] != begin - ctx:
        raise ValueError("a range does not begin at a place to cut")
    pieces = [(a + ctx, b + ctx, k) for a, b, k in choose_cuts(at, tok, kind, (len(body), n), own, s)]
    return n - int(tok[own]), pieces


@lru_cache(maxsize=1)
def _longest(path: str) -> int:
    return int(tokens.byte_lengths(path).max())


_PIECES = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("repeated", pa.int64()), ("own", pa.int64()), ("tokens", pa.int32()), ("body", pa.string())])
_PIECES_SQL = "doc_id bigint, part int, piece int, first bigint, last bigint, repeated bigint, own bigint, tokens int, body string"
#: Pieces leave a worker in record batches of about so many bytes.
_BATCH = 4_000_000


def _emit(ranges: Iterator[tuple[int, int, int, int, bytes]], s: Split, bodies: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of (doc_id, part, ctx, begin, body) ranges; own: the range's tokens, with its first piece."""
    e, lengths = tokens.encoding(s.file()), tokens.byte_lengths(s.file())
    rows, held = [], 0
    for doc, part, ctx, begin, body in ranges:
        n, pieces = cut_range(body, ctx, begin, s, e, lengths)
        end = begin
        for k, (a, b, t) in enumerate(pieces):
            rows.append((doc, part, k + 1, a, b, end - a, n if k == 0 else 0, t, body[a - ctx : b - ctx].decode("utf-8", "replace") if bodies else None))
            end = b
        held += len(body)
        if held >= _BATCH or len(rows) >= 10_000:
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)
            rows, held = [], 0
    if rows:
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


def _bounds(read: Read, size: int, part: int, s: Split) -> tuple[int, int, int]:
    """(context, begin, end) of a range."""
    begin, end = range_begin(read, size, part, s), range_begin(read, size, part + 1, s)
    return (_context(read, begin, s.overlap * _longest(s.file())) if 0 < begin < end else begin), begin, end


def _numbered(pieces: DataFrame) -> DataFrame:
    """Pieces numbered through each text: ranges by prefix sums over one row per range."""
    stored = written(pieces, "pieces")
    counts = stored.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return stored.join(offsets, ["doc_id", "part"]).withColumn("piece", (F.col("piece") + F.col("before")).cast("int")).select(*_PIECES.names)


def _of_column(docs: DataFrame, doc_id: Column, text: Column, s: Split, bodies: bool) -> DataFrame:
    d = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    long_ = F.octet_length("text") > s.range_bytes

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ((d, 0, 0, 0, t.encode("utf-8", "surrogatepass")) for b in batches for d, t in zip(*(c.to_pylist() for c in b.columns)))
        return _emit(own, s, bodies)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "part", "ctx", "begin", "body"]
        for b in batches:
            for doc, t in zip(*(c.to_pylist() for c in b.columns)):
                raw = t.encode("utf-8", "surrogatepass")
                for part in range(-(-len(raw) // s.range_bytes)):
                    ctx, begin, end = _bounds(lambda a, z: raw[a:z], len(raw), part, s)
                    if begin < end:
                        yield pa.record_batch([pa.array([doc], pa.int64()), pa.array([part], pa.int32()), pa.array([ctx], pa.int64()), pa.array([begin], pa.int64()), pa.array([raw[ctx:end]], pa.binary())], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), s, bodies)

    parts = d.where(long_).mapInArrow(slices, "doc_id bigint, part int, ctx bigint, begin bigint, body binary").repartition("doc_id", "part")
    return d.where(~long_).mapInArrow(whole, _PIECES_SQL).unionByName(_numbered(parts.mapInArrow(cut, _PIECES_SQL)))


def split_texts(docs: DataFrame, doc_id: Column, text: Column, s: Split = Split(), bodies: bool = True) -> DataFrame:
    """(doc_id, piece, first, last, repeated, tokens, body): pieces of at most `limit` tokens, in
    order; first, last: bytes of the text's UTF-8 form; repeated: how many of them the piece
    before holds too. body is null if bodies are not asked for.

    Cuts lie at the best boundary in the last half of a piece: paragraph, then sentence,
    then word ends; inside an unbroken run, at a token. The next piece begins at the last
    boundary that is `overlap` tokens or more before the cut. A text within the limit is
    one piece; a text longer than a range is also cut where its ranges meet. Null and
    empty texts give no piece; doc_id must be unique and not null; ties and repeated texts
    change nothing; further columns are not read.
    """
    return _of_column(docs, doc_id, text, s, bodies).select("doc_id", "piece", "first", "last", "repeated", "tokens", "body")


def token_totals(docs: DataFrame, doc_id: Column, text: Column, s: Split) -> DataFrame:
    """(doc_id, tokens): summed over the ranges of a text."""
    return _of_column(docs, doc_id, text, s, False).groupBy("doc_id").agg(F.sum("own").alias("tokens"))


def split_files(files: DataFrame, doc_id: Column, uri: Column, s: Split = Split(), bodies: bool = True) -> DataFrame:
    """split_texts for UTF-8 files (local, HDFS, S3 and what else pyarrow reads): every worker
    reads its own byte ranges. Null addresses and empty files give no piece; bytes that are no
    UTF-8 are kept as replacement characters."""
    from pyarrow import fs

    f = files.select(doc_id.cast("bigint").alias("doc_id"), uri.alias("uri")).where("doc_id IS NOT NULL AND uri IS NOT NULL")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = []
            for u in b.column(1).to_pylist():
                system, path = fs.FileSystem.from_uri(u)
                n.append(system.get_file_info(path).size)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "uri", "size"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int, bytes]]:
        for b in batches:
            for doc, u, size, part in zip(*(c.to_pylist() for c in b.columns)):
                system, path = fs.FileSystem.from_uri(u)
                with system.open_input_file(path) as own:
                    ctx, begin, end = _bounds(lambda a, z: own.read_at(z - a, a), size, part, s)
                    if begin < end:
                        yield doc, part, ctx, begin, own.read_at(end - ctx, ctx)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(ranges(batches), s, bodies)

    sized = f.mapInArrow(sizes, "doc_id bigint, uri string, size bigint").where("size > 0")
    parts = sized.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / s.range_bytes).cast("int"))).alias("part"))
    return _numbered(parts.repartition("doc_id", "part").mapInArrow(cut, _PIECES_SQL)).select("doc_id", "piece", "first", "last", "repeated", "tokens", "body")


def own_stretches(pieces: DataFrame) -> DataFrame:
    """(doc_id, piece, body): each piece without what it repeats of the one before, so that the
    stretches of a text, laid end to end, are the text."""
    raw = F.encode("body", "UTF-8")
    return pieces.select("doc_id", "piece", F.decode(F.substring(raw, F.col("repeated").cast("int") + 1, F.octet_length(raw)), "UTF-8").alias("body"))
