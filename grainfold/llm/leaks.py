"""Held-out passages inside a training corpus, found with a positional inverted index.

The index is parted by documents: each worker turns its stretch of the corpus into posting
lists (term, position), sorted, and answers every run of `run` successive passage words on
them. A run with a term that has no list there is done with; for the others the lists are
intersected, each moved by the term's offset in the run, from the rarest term on. So no
posting ever leaves its worker, and a frequent term is never gathered in one place.

Near matches have an index of their own, as an edited passage may lack its rarest words: of
the words around a place of the passage so many may be missing, hence one more of the
rarest that the corpus has are looked for (a prefix filter).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.llm import textvec as tv


@dataclass(frozen=True)
class LeakSearch:
    """run: successive words that make a leak; near_share: share of the passage words around
    a shared word that must stand around it in the document, in any order, for a near match;
    block_words: passage words searched in one pass over the corpus; piece_chars: longer
    texts are indexed piece by piece, overlapping by 2 * (run - 1) words."""

    run: int = 13
    near_share: float = 0.8
    block_words: int = 200_000
    piece_chars: int = 2_000_000


def _pieces(text: str, s: LeakSearch) -> Iterator[str]:
    """The text in pieces; words are not cut."""
    size = s.piece_chars
    if len(text) <= size:
        yield text
        return
    begin = 0
    while True:
        end = begin + size
        while end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
            end += 1
        yield text[begin:end]
        if end >= len(text):
            return
        begin = end


def _slices(batches: Iterator[pa.RecordBatch], s: LeakSearch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each text, words, number of words of each text), slice by slice. A piece
    of a long text begins with the last words of those before it, as many as a match at
    their border can reach back, however few words a piece has."""
    reach = 2 * (s.run - 1)
    for batch in batches:
        docs, texts = [], []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if len(t) <= s.piece_chars:
                docs.append(d)
                texts.append(t)
                continue
            last = np.zeros(0, dtype=np.int64)
            for p in _pieces(t, s):
                last = np.concatenate([last[-reach:], tv.Batch([p]).words()[0].view(np.int64)])
                yield np.array([d], dtype=np.int64), last, np.array([len(last)])
        for a, b in tv.slices(texts):
            words, counts = tv.Batch(texts[a:b]).words()
            yield np.array(docs[a:b], dtype=np.int64), words.view(np.int64), counts


def _find(sorted_terms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word in sorted_terms, or -1."""
    at = np.searchsorted(sorted_terms, words)
    at[at == len(sorted_terms)] = 0
    return np.where(sorted_terms[at] == words, at, -1)


def document_frequencies(docs: DataFrame, terms: np.ndarray, s: LeakSearch) -> dict[int, int]:
    """Occurrences of each of the passages' words in the whole corpus; one row per word comes back."""
    terms = np.unique(terms)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for _, words, _ in _slices(batches, s):
            at = _find(terms, words)
            total += np.bincount(at[at >= 0], minlength=len(terms))
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(terms[hit]), pa.array(total[hit])], schema=schema)

    rows = docs.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


#: Alignments that are intersected at a time.
_ALIGNED = 1_000_000


def phrase_matches(docs: DataFrame, items: list[tuple[int, np.ndarray]], s: LeakSearch) -> DataFrame | None:
    """(doc_id, item_id, at): the passage words at places `at` that stand in the document in
    runs of `run` or more; exact."""
    items = [(i, w) for i, w in items if len(w) >= s.run]
    if not items:
        return None
    vocab = np.unique(np.concatenate([w for _, w in items]))
    runs = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.searchsorted(vocab, w), s.run) for _, w in items]).astype(np.int32)
    item = np.repeat([i for i, _ in items], [len(w) - s.run + 1 for _, w in items])
    place = np.concatenate([np.arange(len(w) - s.run + 1) for _, w in items])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("at", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, words, counts in _slices(batches, s):
            owner = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(words)) + s.run * owner  # a gap between texts: no run reaches over it
            size = len(words) + s.run * len(counts) + s.run
            term = _find(vocab, words)
            known = np.flatnonzero(term >= 0)
            # The posting lists of all terms, end to end: term * size + position.
            lists = np.sort(term[known] * size + at[known])
            lengths = np.bincount(term[known], minlength=len(vocab))
            first = np.cumsum(lengths) - lengths
            own = lengths[runs]
            alive = np.flatnonzero(own.min(axis=1) > 0)
            if not len(alive):
                continue
            order = np.argsort(own[alive], axis=1, kind="stable")  # offsets in the run, rarest term first
            terms = np.take_along_axis(runs[alive], order, axis=1).astype(np.int64)
            upto = np.cumsum(lengths[terms[:, 0]])
            cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + _ALIGNED, _ALIGNED), side="right"))
            for a, b in zip([0, *cuts], [*cuts, len(alive)]):
                row, posting = _spread(first[terms[a:b, 0]], lengths[terms[a:b, 0]])
                row += a
                begin = lists[posting] - terms[row, 0] * size - order[row, 0]
                for k in range(1, s.run):
                    wanted = terms[row, k] * size + begin + order[row, k]
                    found = np.searchsorted(lists, wanted)
                    same = lists[np.minimum(found, len(lists) - 1)] == wanted
                    row, begin = row[same], begin[same]
                if not len(row):
                    continue
                r = alive[row]
                whose = doc[owner[np.searchsorted(at, begin)]]
                rows = np.unique(np.stack([np.repeat(whose, s.run), np.repeat(item[r], s.run), (place[r][:, None] + np.arange(s.run)).ravel()]), axis=1)
                yield pa.record_batch([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], schema=schema)

    return docs.mapInArrow(scan, "doc_id bigint, item_id bigint, at int")


#: Successive places of a passage that are looked for together, and the most entries of the table of their words.
_SEGMENT, _TABLE = 8, 67_108_859


@dataclass(frozen=True)
class _NearIndex:
    """vocab: the block's words, numbered from 1 by order. Of each place of a passage that a
    document can match: item, own word, the distinct words around it, their number. Places
    begin[g] to begin[g + 1] are segment g, of which need[g] words at least must be met;
    the segments of term[i] are segments[first[i] : first[i + 1]]."""

    vocab: np.ndarray
    item: np.ndarray
    centre: np.ndarray
    around: np.ndarray
    of: np.ndarray
    begin: np.ndarray
    need: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    segments: np.ndarray


def _near_index(items: list[tuple[int, np.ndarray]], df: dict[int, int], s: LeakSearch) -> _NearIndex | None:
    """For each place of each passage, terms of which a near document has at least one around
    it: the rarest, one more than may be missing after the words that the corpus lacks; or
    the word at the place itself, if that is rarer than those together."""
    wing = s.run - 1
    vocab = np.unique(np.concatenate([w for _, w in items]))
    freq = np.array([df.get(int(w), 0) for w in vocab], dtype=np.int64)
    item, centre, around, of, begin, need, of_term = [], [], [], [], [], [], {}
    for i, words in items:
        ids = np.searchsorted(vocab, words) + 1
        for start in range(0, len(ids), _SEGMENT):
            least, terms, before = None, set(), len(centre)
            for p in range(start, min(start + _SEGMENT, len(ids))):
                own = np.unique(ids[max(0, p - wing) : p + wing + 1])
                shared = max(1, math.ceil(len(own) * s.near_share))
                there = own[freq[own - 1] > 0]
                if len(there) < shared or not freq[ids[p] - 1]:
                    continue
                rare = there[np.argsort(freq[there - 1], kind="stable")][: len(there) - shared + 1]
                terms |= {int(ids[p])} if freq[ids[p] - 1] <= freq[rare - 1].sum() else set(rare.tolist())
                least = shared if least is None else min(least, shared)
                item.append(i)
                centre.append(ids[p])
                around.append(np.pad(own, (0, 2 * wing + 1 - len(own))))
                of.append(len(own))
            if least is not None:
                for t in terms:
                    of_term.setdefault(t, []).append(len(need))
                begin.append(before)
                need.append(least)
    if not need:
        return None
    terms = sorted(of_term)
    first = np.cumsum([0, *[len(of_term[t]) for t in terms]])
    return _NearIndex(vocab, np.array(item, dtype=np.int64), np.array(centre), np.array(around), np.array(of), np.array([*begin, len(centre)]), np.array(need), np.array(terms), first, np.concatenate([of_term[t] for t in terms]).astype(np.int64))


def _spread(begins: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, begins[row] + 0 .. counts[row] - 1) of every row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, begins[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]


def near_matches(docs: DataFrame, index: _NearIndex, s: LeakSearch) -> DataFrame:
    """(doc_id, item_id, kind, words): exact. Around every term found, the words that belong
    to a segment are counted first (words that a table of bounded size confuses only add to
    them); where they are enough, each place is compared."""
    wing, x = s.run - 1, index
    width = 2 * wing + 1
    span = len(x.vocab) + 1
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("words", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = min(len(x.need) * span, _TABLE)
        table = np.zeros(size, dtype=bool)
        segment = np.repeat(np.arange(len(x.need)), np.diff(x.begin))
        table[((segment[:, None] * span + x.around)[x.around > 0]) % size] = True
        which = np.full(span, -1)
        which[x.terms] = np.arange(len(x.terms))
        counts_of = np.diff(x.first)
        for doc, words, counts in _slices(batches, s):
            # Texts lie end to end with 2 * wing unknown words before, between and behind.
            owner = np.repeat(np.arange(len(counts)), counts)
            text = np.zeros(len(words) + 2 * wing * (len(counts) + 1), dtype=np.int64)
            text[np.arange(len(words)) + 2 * wing * (owner + 1)] = _find(x.vocab, words) + 1
            whose = np.repeat(np.arange(len(counts)), counts + 2 * wing)
            hit = np.flatnonzero(which[text] >= 0)
            term = which[text[hit]]
            found = []
            # Cut where the pairs of a term's place and a segment exceed a bounded number.
            upto = np.cumsum(counts_of[term])
            cuts = np.unique(np.searchsorted(upto, np.arange(0, (upto[-1] if len(upto) else 0) + 50_000, 50_000), side="right"))
            for a, b in zip([0, *cuts], [*cuts, len(hit)]):
                row, at = _spread(x.first[term[a:b]], counts_of[term[a:b]])
                seg, t = x.segments[at], hit[a:b][row]
                key = seg[:, None] * span + text[t[:, None] + np.arange(-2 * wing, 2 * wing + 1)]
                flags = table[key if size == len(x.need) * span else key % size]
                total = np.cumsum(np.pad(flags, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
                enough = (total[:, width:] - total[:, :-width] >= x.need[seg][:, None]) & flags[:, wing : wing + width]
                i, j = np.nonzero(enough)
                found.append(np.unique((t[i] + j - wing) * len(x.need) + seg[i]))
            if not found:
                continue
            place, seg = np.divmod(np.unique(np.concatenate(found)), len(x.need))
            row, p = _spread(x.begin[seg], np.diff(x.begin)[seg])
            q = place[row]
            same = x.centre[p] == text[q]
            p, q = p[same], q[same]
            shared = np.zeros(len(p), dtype=np.int32)
            for a in range(0, len(p), 20_000):
                w, r = x.around[p[a : a + 20_000]], text[q[a : a + 20_000, None] + np.arange(-wing, wing + 1)]
                shared[a : a + 20_000] = ((w[:, :, None] == r[:, None, :]).any(axis=2) & (w > 0)).sum(axis=1)
            near = shared >= x.of[p] * s.near_share
            if near.any():
                owner, p = whose[q[near] - 2 * wing], p[near]
                yield pa.record_batch([pa.array(doc[owner]), pa.array(x.item[p]), pa.array(["near"] * len(p)), pa.array(shared[near])], schema=schema)

    found = docs.mapInArrow(scan, "doc_id bigint, item_id bigint, kind string, words int")
    return found.groupBy("doc_id", "item_id", "kind").agg(F.max("words").alias("words"))


def _item_blocks(items: DataFrame, s: LeakSearch) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The passages in blocks of bounded size, whatever their number."""
    block, size = [], 0
    for row in items.toLocalIterator():
        words = tv.Batch([row["text"]]).words()[0].view(np.int64)
        if len(words) >= s.run:
            block.append((row["item"], words))
            size += len(words)
        if size >= s.block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, passage: Column, s: LeakSearch = LeakSearch(), phrases_only: bool = False) -> DataFrame:
    """(doc_id, item_id, kind, words): kind `phrase` if the document holds `run` or more
    successive words of the passage, `words` being the passage words in such runs; else
    `near` if, around a word, near_share of the passage's words stand in any order, `words`
    being the most found at one place.

    Null and empty texts and passages, and passages with fewer than `run` words, match
    nothing. Repeated documents and items each count once per id; ids must not be null.
    Passages are searched in blocks against all documents; the result is exact. With
    phrases_only near matches are not looked for. Further columns are not read.
    """
    spark = docs.sparkSession
    d = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    it = items.select(item_id.cast("bigint").alias("item"), passage.alias("text")).where("item IS NOT NULL AND text IS NOT NULL AND text <> ''")
    parts = []
    for block in _item_blocks(it, s):
        phrases = phrase_matches(d, block, s)
        parts.append(phrases.groupBy("doc_id", "item_id").agg(F.count_distinct("at").cast("int").alias("words")).select("doc_id", "item_id", F.lit("phrase").alias("kind"), "words"))
        if not phrases_only and (near := _near_index(block, document_frequencies(d, np.concatenate([w for _, w in block]), s), s)):
            parts.append(near_matches(d, near, s))
    if not parts:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, kind string, words int")
    found = reduce(DataFrame.unionByName, parts)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("kind", "words")).alias("top"))
    return best.select("doc_id", "item_id", "top.kind", "top.words")
