"""Keyword-stuffed and link-list pages, by pointwise mutual information of neighbouring words over the whole corpus.

Three steps, none of which knows any language. Every page takes part in each; nothing is fitted on a sample.

1. One pass over all texts lays them out as blocks (``BLOCK`` characters): the words as places in the block's sorted
   vocabulary, a byte or two each, with their lengths and where segments begin. All later passes read these. Neighbouring
   words are counted a block at a time and added up over the corpus, both orders of a pair in one row; a block gets back
   the sums of those of its pairs that other blocks have as well, and knows the others' from itself.
2. Each page gets its *coherence*: the mean of PMI(a, b) - PMI(b, a) over its neighbouring words, from the corpus
   counts without the page's own. In sentences the order of words is fixed, so the reverse of a pair is hardly ever met;
   in word salad either order is as good. It also gets its *excess*: the share of its pairs that it repeats over
   ``EXCESS`` times as often as the corpus has them. Pages that are incoherent beyond Tukey's far fence of all pages'
   quartiles and repeat collocations excessively are word salad; with the pages of which links, handles and tags make
   more than half they are the seeds. The log odds of words in seeds against all other pages say how much a word belongs
   to stuffing; further rounds (``ROUNDS`` in all) take as seeds what the words of the round before find in all pages.
3. A last pass gives every word the mean log odds of the words around it (``WINDOW`` on either side, in
   the same line or sentence). A page is reported if more than half of its characters are links, handles, product tags
   or words whose surroundings speak for stuffing.

A word without evidence counts zero, so a page in a language or on a subject that the corpus does not know is not
reported for its words, and repetitive speech keeps the order of its words and stays coherent. Mixed with enough real
sentences a list stays under one half.

Everything inside a slice or block is array arithmetic; what is shuffled are the counts of a block's distinct pairs and
words, and each block once. A hot pair is one row a block. Quartiles are exact order statistics, found by counting. The words with odds are at most ``1 / LEAST_SHARE`` for the seeds and as many for the rest, by
counting, so their table may be sent to every task.

Cases: rows with a null id and null, empty or blank texts are no pages; texts of any length are read whole; equal texts are judged apart;
an empty table gives an empty result; without seeds only links, handles and tags count; extra columns are not read.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import Stages, spread

#: Characters handled at once, unless one text is longer.
SLICE = 1_000_000
#: Characters of the texts whose pairs are counted together, unless one text is longer, and rounds of fitting.
BLOCK, ROUNDS = 8_000_000, 3
#: Share of a page above which it is reported, and above which links alone make it a seed.
HALF = 0.5
#: Pairs that a seed has at least, the share of them that is repeated excessively, and what is excessive.
FEWEST, REPEATED, EXCESS = 16, 0.3, 4.0
#: Times the pair or its reverse is met on other pages before it is evidence of order.
EVIDENCE = 3
#: A word needs this many seeds and this share of the words to have odds, which are cut off at ``MOST_ODDS``.
LEAST_SEEDS, LEAST_SHARE, MOST_ODDS = 3, 1e-6, 3.0
#: Bits of a number by which numbers are counted at once: at most 2,048 counts for each rank that is sought.
RANK_BITS = 11
#: Words on either side that decide whether a word is stuffed, and the mean odds from which it is.
WINDOW, STUFFED_ODDS = 8, 0.25

_MARKS = re.compile(r"[Hh][Tt][Tt][Pp][Ss]?://\S+|[Ww][Ww][Ww]\.\S+|<[Aa]\s[^>]*>|</[Aa]>|<[Bb][Rr]\s*/?>|\]\([^)\s]*\)|[#@＃＠][\w-]+")
# Sought by what is rare in them: the end of a host before its path, and the sign of a currency.
_HOST_END, _HOST, _PATH = re.compile(r"\.[\w-]+/"), re.compile(r"(?<![^\s(])[\w-][\w.-]*\Z"), re.compile(r"\S*")
#: A product tag: a word, a code and a price.
_PRICE, _CODE = re.compile(r"[$€¥£]\d+(?:[.,]\d+)?"), re.compile(r"\w+\.?[ :]\d{3,} ?\Z")
#: Characters before a price in which its code is sought, and before the end of a host in which that begins (RFC 1035).
CODE, HOST = 64, 255
#: Field names of structured answers: neither sentences nor keywords.
_FIELDS = re.compile(r'"\w+"\s*:')
_BASE = np.uint64(0x9E3779B97F4A7C15)
NONE, LETTER, DIGIT, CJK = 0, 1, 2, 3


def _class(c: int) -> tuple[int, int]:
    """The class of a character and its lower case."""
    s = chr(c)
    if 0x3400 <= c <= 0x9FFF or 0x20000 <= c <= 0x3FFFF:
        return CJK, c
    if s.isdigit():
        return DIGIT, c
    if s.isalpha() or unicodedata.category(s) in ("Mn", "Mc"):
        s = unicodedata.normalize("NFKC", s) if 0xFF00 <= c <= 0xFFEF else s
        return LETTER, ord(low) if len(low := s.lower()) == 1 else c
    return NONE, c


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For characters below U+10000: class, lower case, what ends a line or sentence (1 break, 2 stop, 3 blank), and
    whether it is white space."""
    kind, lower = (np.array(x) for x in zip(*(_class(c) for c in range(0x10000))))
    ends, space = np.zeros(0x10000, np.int8), np.array([chr(c).isspace() for c in range(0x10000)])
    ends[space] = 3
    ends[[ord(c) for c in "\n\r\v\f\x85  。！？"]] = 1
    ends[[ord(c) for c in ".!?"]] = 2
    return kind.astype(np.int8), lower.astype(np.uint32), ends, space


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    p = np.cumprod(np.full(SLICE + 1, _BASE, np.uint64))
    q = np.cumprod(np.full(SLICE + 1, np.uint64(inverse), np.uint64))
    return p, q


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the character ranges, by differences of a running polynomial."""
    n = len(chars)
    p, q = _powers() if n <= SLICE else (np.cumprod(np.full(n + 1, _BASE, np.uint64)), np.cumprod(np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)))
    run = np.concatenate([[np.uint64(0)], np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * p[:n], dtype=np.uint64)])
    return _mix((run[end] - run[start]) * q[start])


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * np.uint64(3) + _mix(right + np.uint64(0x51ED270B)))


def _marks(whole: str) -> Iterator[tuple[int, int]]:
    """Where links, handles, tags, bare hosts with a path, and product tags stand."""
    yield from (m.span() for m in _MARKS.finditer(whole))
    for m in _HOST_END.finditer(whole):
        if host := _HOST.search(whole, max(0, m.start() - HOST), m.start()):
            yield host.start(), _PATH.match(whole, m.end()).end()
    for m in _PRICE.finditer(whole):
        if code := _CODE.search(whole, max(0, m.start() - CODE), m.start()):
            yield code.start(), m.end()


def _covered(spans: Iterable[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n characters lie in a span."""
    at = np.array(list(spans), np.int64).reshape(-1, 2)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at[:, 0], 1)
    np.subtract.at(edge, at[:, 1], 1)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


class Slice:
    """Words of a few texts laid out as one array of characters, and the share of each text that is marked."""

    def __init__(self, texts: list[str]):
        kinds, lowers, ends, space = _tables()
        whole = "\n".join([*texts, ""])
        raw = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n, low = len(raw), np.minimum(raw, 0xFFFF)
        kind, lower = kinds[low], lowers[low]
        if len(far := np.flatnonzero(raw > 0xFFFF)):
            seen, at = np.unique(raw[far], return_inverse=True)
            known = np.array([_class(int(c)) for c in seen])
            kind[far], lower[far] = known[at, 0], known[at, 1]
        self.n, self.bounds = n, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        marked, named = _covered(_marks(whole), n), _covered((m.span() for m in _FIELDS.finditer(whole)), n)
        kind = np.where(marked | named, NONE, kind)
        before, after = np.concatenate([[NONE], kind[:-1]]), np.concatenate([kind[1:], [NONE]])
        self.start = np.flatnonzero((kind != NONE) & ((kind != before) | (kind == CJK)))
        stops = np.flatnonzero((kind != NONE) & ((kind != after) | (kind == CJK))) + 1
        self.kind = kind[self.start]
        self.doc = np.searchsorted(self.bounds, self.start, "right") - 1
        self.word = np.where(self.kind == DIGIT, np.uint64(1), _hashes(lower, self.start, stops))
        # Lines, sentences and what stands between marks are segments of their own.
        ends = np.where(raw > 0xFFFF, 0, ends[low])
        spaced = np.concatenate([(ends[1:] == 1) | (ends[1:] == 3), [True]])
        self.segment = np.cumsum((ends == 1) | ((ends == 2) & spaced) | (marked & ~np.concatenate([[False], marked[:-1]])), dtype=np.int32)[self.start]
        # Characters that are neither field names nor blanks make the length of a text; a word's own reach to the next.
        skipped = named & ~marked
        self.seen = np.concatenate([[0], np.cumsum(marked | skipped, dtype=np.int32)])
        self.length = np.diff(self.bounds) - 1 - self._per_text(skipped)
        self.marked = self._per_text(marked)
        blank = self._per_text(~space[low] | (raw > 0xFFFF)) == 0
        self.length[blank] = 0
        self.linked = np.where(blank, 0.0, self.marked / np.maximum(self.length, 1))

    def _per_text(self, flag: np.ndarray) -> np.ndarray:
        """How many characters of each text have a flag."""
        run = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
        return run[self.bounds[1:] - 1] - run[self.bounds[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring words of the same text, numbers left out: left, right, text."""
        use = (self.doc[1:] == self.doc[:-1]) & (self.kind[1:] != DIGIT) & (self.kind[:-1] != DIGIT)
        return self.word[:-1][use], self.word[1:][use], self.doc[1:][use]

    def laid_out(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: whether it begins a segment, and its characters up to the next word."""
        head = np.concatenate([[True], self.segment[1:] != self.segment[:-1]])[: len(self.word)]
        until = np.minimum(np.append(self.start[1:], self.n), self.bounds[self.doc + 1] - 1)
        return head, (until - self.start) - (self.seen[until] - self.seen[self.start])

    def stuffed(self, words: np.ndarray, odds: np.ndarray, least: float) -> np.ndarray:
        """The share of each text's characters that are marked or stuffed, given the sorted words that have odds."""
        counts = self.kind != DIGIT
        return _share(np.where(counts, _looked_up(words, odds, self.word), 0.0), counts, *self.laid_out(), self.doc, self.length, self.marked, least)


def _looked_up(words: np.ndarray, odds: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The odds of words, zero for those without, given the sorted words that have odds."""
    if not len(words):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    return np.where(words[at] == asked, odds[at], 0.0)


def _share(score: np.ndarray, counts: np.ndarray, head: np.ndarray, size: np.ndarray, doc: np.ndarray, length: np.ndarray, marked: np.ndarray, least: float) -> np.ndarray:
    """The share of each text's characters that are marked or lie in words whose surroundings score over ``least``."""
    own, k = np.zeros(len(length)), len(score)
    if k and score.any():
        new = np.flatnonzero(head)
        of = np.cumsum(head) - 1
        low, high = new[of], np.append(new[1:], k)[of]
        i = np.arange(k)
        lo, hi = np.maximum(i - WINDOW, low), np.minimum(i + WINDOW + 1, high)
        total, f = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(score)])
        bad = (f[hi] - f[lo]) > least * np.maximum(total[hi] - total[lo], 1)
        own = np.bincount(doc, np.where(bad, size, 0), minlength=len(length))
    return np.where(length > 0, (own + marked) / np.maximum(length, 1), 0.0)


class Pairs(NamedTuple):
    """Neighbouring words of a block's texts, numbers left out. Both orders of two words are one distinct pair, whose
    ``low`` and ``high`` words are ``ahead`` times in this order and ``behind`` times in the other."""

    doc: np.ndarray
    at: np.ndarray
    flipped: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray


class Block(NamedTuple):
    """Texts as places of their words in a sorted vocabulary, with what their shares of stuffing need."""

    ids: np.ndarray
    words: np.ndarray
    """Words of each text."""
    vocabulary: np.ndarray
    place: np.ndarray
    head: np.ndarray
    size: np.ndarray
    length: np.ndarray
    marked: np.ndarray
    linked: np.ndarray

    @staticmethod
    def of(parts: list[tuple[np.ndarray, ...]]) -> Block:
        """From what ``part`` keeps of each slice."""
        ids, words, word, *rest = (np.concatenate(x) for x in zip(*parts))
        return Block(ids, words, *np.unique(word, return_inverse=True), *rest)

    @staticmethod
    def part(ids: np.ndarray, s: Slice) -> tuple[np.ndarray, ...]:
        return ids, np.bincount(s.doc, minlength=len(ids)), s.word, *s.laid_out(), s.length, s.marked, s.linked

    def packed(self) -> tuple[bytes, int]:
        """The arrays in as few bytes as their values need, compressed, and their length before."""
        out = io.BytesIO()
        for x in self:
            if x.dtype.kind == "i" and len(x) and x.min() >= 0:
                x = x.astype(np.min_scalar_type(x.max()))
            np.save(out, x, allow_pickle=False)
        return pa.compress(out.getvalue(), "zstd", asbytes=True), out.tell()

    @staticmethod
    def unpacked(data: bytes, raw: int) -> Block:
        f = io.BytesIO(pa.decompress(data, raw, "zstd", asbytes=True))
        b = Block(*(np.load(f, allow_pickle=False) for _ in Block._fields))
        return b._replace(ids=b.ids.astype(np.int64), **{c: getattr(b, c).astype(np.int64) for c in ("words", "place", "size", "length", "marked")})

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), self.words)

    def counts(self) -> np.ndarray:
        """Which words of the vocabulary are no numbers."""
        return self.vocabulary != 1

    def beside(self) -> np.ndarray:
        """Which words but the last make a pair with the next."""
        doc, plain = self.doc(), self.counts()[self.place]
        return (doc[1:] == doc[:-1]) & plain[1:] & plain[:-1]

    def pairs(self) -> Pairs:
        use = self.beside()
        left, right = self.place[:-1][use], self.place[1:][use]
        flipped, v = left > right, max(len(self.vocabulary), 1)
        pair, at = np.unique(np.minimum(left, right) * v + np.maximum(left, right), return_inverse=True)
        every, behind = np.bincount(at, minlength=len(pair)), np.bincount(at[flipped], minlength=len(pair))
        return Pairs(self.doc()[1:][use], at, flipped, self.vocabulary[pair // v], self.vocabulary[pair % v], every - behind, behind)

    def word_counts(self, pages: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pages that a flag names, or of all: distinct words, how often and, of flagged pages, in how many."""
        plain, v = self.counts(), len(self.vocabulary)
        if pages is None:
            n = np.bincount(self.place, minlength=v) * plain
            return self.vocabulary[n > 0], n[n > 0], np.zeros(int((n > 0).sum()), np.int64)
        use = np.repeat(pages, self.words) & plain[self.place]
        n = np.bincount(self.place[use], minlength=v)
        within = np.bincount(np.unique(self.doc()[use] * max(v, 1) + self.place[use]) % max(v, 1), minlength=v)
        return self.vocabulary[n > 0], n[n > 0], within[n > 0]

    def stuffed(self, words: np.ndarray, odds: np.ndarray, least: float) -> np.ndarray:
        """As of a slice."""
        plain = self.counts()
        score = np.where(plain, _looked_up(words, odds, self.vocabulary), 0.0)
        return _share(score[self.place], plain[self.place], self.head, self.size, self.doc(), self.length, self.marked, least)


SCHEMA = "kind int, doc_id long, key long, back long, n long, n_back long, size long, linked double"
PAIR_ROW, PAGE_ROW, OWN_PAIR, OWN_WORD = 0, 1, 2, 3


def _emit(kind: int, rows: int, **given) -> pa.RecordBatch:
    schema = [("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "key", "back", "n", "n_back", "size")), ("linked", pa.float64())]
    arrays = [pa.array(np.full(rows, kind, np.int32))]
    for name, t in schema[1:]:
        x = given.get(name)
        x = x.view(np.int64) if x is not None and x.dtype == np.uint64 else x
        arrays.append(pa.nulls(rows, t) if x is None else pa.array(x, t))
    return pa.RecordBatch.from_arrays(arrays, names=[s[0] for s in schema])


def _runs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of (doc, key), the first of each distinct one in it, and how many there are."""
    order = np.lexsort((key, doc))
    d, x = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])])) if len(d) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(d)))


def _slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[tuple[np.ndarray, Slice]]:
    """The texts of a batch, a slice of at most ``most`` characters at a time: positions in the batch, and the slice."""
    texts = batch.column("text").to_pylist()
    use = [i for i, t in enumerate(texts) if t]
    i = 0
    while i < len(use):
        j, size = i, 0
        while j < len(use) and (j == i or size + len(texts[use[j]]) < most - 1000):
            size += len(texts[use[j]]) + 1
            j += 1
        yield np.array(use[i:j]), Slice([texts[k] for k in use[i:j]])
        i = j


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of pairs a batch, and the pages, pairs and words of the pages with ``fit``: the plain form, a row for each
    pair of each page, which ``page_coherence`` joins with the counts. Tests hold ``page_figures`` against it."""
    for b in batches:
        ids, fit = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("fit").to_numpy(zero_copy_only=False).astype(bool)
        keys, counts = [], []
        for at, s in _slices(b):
            left, right, doc = s.pairs()
            pair = pair_key(left, right)
            key, n = np.unique(pair, return_counts=True)
            keys.append(key)
            counts.append(n)
            mine = fit[at]
            if not mine.any():
                continue
            page = np.flatnonzero(mine)
            yield _emit(PAGE_ROW, len(page), doc_id=ids[at][page], size=np.bincount(doc, minlength=len(at))[page].astype(np.int64), linked=s.linked[page])
            use = mine[doc]
            left, right, doc, pair = left[use], right[use], doc[use], pair[use]
            order, first, n = _runs(doc, pair)
            d, p, back = doc[order][first], pair[order][first], pair_key(right, left)[order][first]
            # How often the page itself has the reverse.
            own, asked = np.rec.fromarrays([d, p]), np.rec.fromarrays([d, back])
            where = np.minimum(np.searchsorted(own, asked), max(len(own) - 1, 0))
            n_back = np.where(own[where] == asked, n[where], 0) if len(own) else n
            yield _emit(OWN_PAIR, len(first), doc_id=ids[at][d], key=p, back=back, n=n.astype(np.int64), n_back=n_back.astype(np.int64))
            use = mine[s.doc] & (s.kind != DIGIT)
            doc, word = s.doc[use], s.word[use]
            order, first, n = _runs(doc, word)
            yield _emit(OWN_WORD, len(first), doc_id=ids[at][doc[order][first]], key=word[order][first], n=n.astype(np.int64))
        if keys:
            key, where = np.unique(np.concatenate(keys), return_inverse=True)
            yield _emit(PAIR_ROW, len(key), key=key, n=np.bincount(where, np.concatenate(counts), minlength=len(key)).astype(np.int64))


def _record(schema: str, *columns) -> pa.RecordBatch:
    """A batch with the names of a schema; words and keys become signed."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])


BLOCKS = "block long, data binary, raw long, pairs long"


def _blocks(most: int):
    """The texts as blocks of at most ``most`` characters, unless one text is longer."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, chars, number = [], 0, TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            block = Block.of(parts)
            data, raw = block.packed()
            return _record(BLOCKS, [number], [data], [raw], [int(block.beside().sum())])

        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for at, s in _slices(b, min(most, SLICE)):
                if parts and chars + s.n > most:
                    yield done()
                    parts, chars, number = [], 0, number + 1
                parts.append(Block.part(ids[at], s))
                chars += s.n
        if parts:
            yield done()

    return run


def _each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for b in batches:
        for number, data, raw in zip(b.column("block"), b.column("data"), b.column("raw")):
            yield number.as_py(), Block.unpacked(data.as_buffer(), raw.as_py())


PAIR_COUNTS = "key long, block long, at int, ahead int, behind int"
WORD_COUNTS = "key long, n long, pages long"


def _pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, block in _each(batches):
        p = block.pairs()
        k = len(p.low)
        yield _record(PAIR_COUNTS, pair_key(p.low, p.high), np.full(k, number), np.arange(k, dtype=np.int32), p.ahead.astype(np.int32), p.behind.astype(np.int32))


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, block in _each(batches):
        yield _record(WORD_COUNTS, *block.word_counts())


FIGURES = "doc_id long, size long, linked double, coherence double, rank long, excess double, words array<long>, counts array<long>"


def _ranked(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the numbers, and back: the bits, all but the sign turned over below zero."""
    bits = x.view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def _figures(total: int):
    """The pages of a block with their figures, given the sums of the pairs that other blocks have too; those that may be
    seeds, whatever the quartiles, with their words."""

    def run(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        [(_, block)] = _each(blocks.to_batches())
        p, docs = block.pairs(), len(block.ids)
        at, ahead, behind = sums["at"].to_numpy(), p.ahead.copy(), p.behind.copy()
        ahead[at], behind[at] = sums["all_ahead"].to_numpy(), sums["all_behind"].to_numpy()
        size = np.bincount(p.doc, minlength=docs)
        # Distinct pairs of a page, either order apart and then side by side.
        k = max(len(p.low), 1)
        own, n = np.unique((p.doc * k + p.at) * 2 + p.flipped, return_counts=True)
        both, row = np.unique(own >> 1, return_inverse=True)
        ours, turned = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
        back = (own & 1).astype(bool)
        ours[row[~back]], turned[row[back]] = n[~back], n[back]
        doc, pair = both // k, both % k
        others, reverse = ahead[pair] - ours, behind[pair] - turned
        # The marginal counts of PMI(a, b) and PMI(b, a) are the same and cancel.
        told = (others + reverse >= EVIDENCE) & (p.low[pair] != p.high[pair])
        gap = np.where(told, (ours - turned) * np.log((others + 0.5) / (reverse + 0.5)), 0.0)
        much = lambda n, rest: np.where((n >= 2) & (n > EXCESS * size[doc] * (rest + 0.5) / max(float(total), 1.0)), n, 0)
        per = lambda x: np.bincount(doc, x, minlength=docs)
        enough = per(np.where(told, ours + turned, 0))
        coherence = np.where((enough * 2 >= size) & (enough > 0), per(gap) / np.maximum(enough, 1), np.nan)
        excess = per(much(ours, others) + much(turned, reverse)) / np.maximum(size, 1)
        none, maybe = np.isnan(coherence), ((size >= FEWEST) & (excess > REPEATED) & ~np.isnan(coherence)) | (block.linked > HALF)
        # The words of pages that may be seeds.
        use = np.repeat(maybe, block.words) & block.counts()[block.place]
        v = max(len(block.vocabulary), 1)
        word, times = np.unique(block.doc()[use] * v + block.place[use], return_counts=True)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(word // v, minlength=docs))]).astype(np.int32))
        words, counts = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (block.vocabulary[word % v].view(np.int64), times))
        figures = [block.ids, size, block.linked, pa.array(coherence, mask=none), pa.array(_ranked(coherence), mask=none), excess, words, counts]
        return pa.Table.from_batches([_record(FIGURES, *figures)])

    return run


def _judge(words: np.ndarray, odds: np.ndarray):
    """The blocks' pages of which more than half is stuffed or marked."""
    least = STUFFED_ODDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _each(batches):
            share = block.stuffed(words, odds, least)
            hit = np.flatnonzero(share > HALF)
            yield _record(JUDGED, block.ids[hit], share[hit], block.linked[hit])

    return run


def _seed_words(words: np.ndarray, odds: np.ndarray):
    """The words of those pages, counted a block at a time."""
    least = STUFFED_ODDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _each(batches):
            yield _record(WORD_COUNTS, *block.word_counts(block.stuffed(words, odds, least) > HALF))

    return run


JUDGED = "doc_id long, stuffed double, linked double"


def _odds(st: Stages, words: DataFrame, total: int, in_seeds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words and their log odds between the seeds and all other pages, sorted by word, given the counts of all words and
    those in seeds by block or page."""
    counted = st.write(in_seeds.groupBy("key").agg(F.sum("n").alias("ns"), F.sum("pages").alias("seeds")))
    seeds = float(counted.agg(F.sum("ns")).first()[0] or 0)
    others = float(total) - seeds
    if not seeds or not others:
        return np.zeros(0, np.uint64), np.zeros(0)
    count = words.join(counted, "key", "left").select("key", "n", F.coalesce("ns", F.lit(0)).alias("ns"), F.coalesce("seeds", F.lit(0)).alias("seeds"))
    odds = F.log((F.col("ns") + 0.5) / F.lit(seeds)) - F.log((F.col("n") - F.col("ns") + 0.5) / F.lit(others))
    use = count.withColumn("odds", odds).where(((F.col("odds") > 0) & (F.col("seeds") >= LEAST_SEEDS) & (F.col("ns") >= LEAST_SHARE * seeds)) | ((F.col("odds") < 0) & (F.col("n") >= LEAST_SHARE * others)))
    # At most 1 / LEAST_SHARE words of either sign fit, whatever the corpus.
    rows = use.select("key", "odds").toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.clip(rows["odds"].to_numpy(), -MOST_ODDS, MOST_ODDS)[order]


def quantiles(ranked: DataFrame, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated as ``percentile`` does, of the numbers whose ``_ranked`` integers a column ``rank``
    holds: the numbers are counted by ``RANK_BITS`` more of their bits at a time, so no task and no memory sees them all."""
    n = ranked.count()
    if not n:
        return [0.0 for _ in shares]
    spots = [s * (n - 1) for s in shares]
    # For each rank sought, the bits known so far and the rank among the numbers that have them.
    at = {int(r): (0, int(r)) for x in spots for r in (np.floor(x), np.ceil(x))}
    known = 64
    while known:
        shift = max(known - RANK_BITS, 0)
        within = ranked if known == 64 else ranked.where(F.shiftright("rank", known).isin(sorted({p for p, _ in at.values()})))
        rows = within.groupBy(F.shiftright("rank", shift).alias("p")).agg(F.count("*").alias("n")).toArrow()
        p, count = rows["p"].to_numpy(), rows["n"].to_numpy()
        order = np.argsort(p)
        p, count = p[order], count[order]
        for r, (bits, rest) in at.items():
            mine = np.ones(len(p), bool) if known == 64 else (p >> (known - shift)) == bits
            ends = np.cumsum(count[mine])
            i = int(np.searchsorted(ends, rest, "right"))
            at[r] = int(p[mine][i]), rest - int(ends[i] - count[mine][i])
        known = shift
    value = {r: float(_ranked(np.array([bits], np.int64)).view(np.float64)[0]) for r, (bits, _) in at.items()}
    between = lambda x, a, b: value[a] if a == b else (b - x) * value[a] + (x - a) * value[b]
    return [between(x, int(np.floor(x)), int(np.ceil(x))) for x in spots]


def page_coherence(own: DataFrame, pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, size, linked, coherence (null without evidence for half of the pairs) and excess of sampled pages."""
    total = float(pairs.agg(F.sum("all_n")).first()[0] or 0)
    known = own.join(pairs, "key").join(pairs.select(F.col("key").alias("back"), F.col("all_n").alias("back_n")), "back", "left").join(pages, "doc_id")
    ahead, behind = F.col("all_n") - F.col("n"), F.coalesce("back_n", F.lit(0)) - F.col("n_back")
    # The marginal counts of PMI(a, b) and PMI(b, a) are the same and cancel.
    gap = F.log((ahead + 0.5) / (behind + 0.5))
    told = (ahead + behind >= EVIDENCE) & (F.col("key") != F.col("back"))
    much = (F.col("n") >= 2) & (F.col("n") > EXCESS * F.col("size") * (ahead + 0.5) / F.lit(max(total, 1.0)))
    part = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    sums = known.groupBy("doc_id").agg(F.first("size").alias("size"), F.first("linked").alias("linked"), part(told, F.col("n")).alias("told"), part(told, F.col("n") * gap).alias("gap"), part(much, F.col("n")).alias("much"))
    return sums.select("doc_id", "size", "linked", F.when(F.col("told") * 2 >= F.col("size"), F.col("gap") / F.col("told")).alias("coherence"), (F.col("much") / F.col("size")).alias("excess"))


def page_blocks(st: Stages, texts: DataFrame, most: int = BLOCK) -> DataFrame:
    """The texts (doc_id, text) as written blocks."""
    return st.write(texts.mapInArrow(_blocks(most), BLOCKS))


def page_figures(blocks: DataFrame) -> DataFrame:
    """All pages with size, linked, coherence (null without evidence for half of the pairs) and its rank, excess, and the
    words of those that may be seeds."""
    total = blocks.agg(F.sum("pairs")).first()[0] or 0
    everywhere = Window.partitionBy("key")
    counts = blocks.mapInArrow(_pair_counts, PAIR_COUNTS).withColumns({f"all_{c}": F.sum(c).over(everywhere) for c in ("ahead", "behind")})
    # What only one block has it knows itself.
    shared = counts.where("all_ahead <> ahead OR all_behind <> behind").select(F.col("block").alias("of"), "at", "all_ahead", "all_behind")
    return blocks.select("block", "data", "raw").groupBy("block").cogroup(shared.groupBy("of")).applyInArrow(_figures(total), FIGURES)


def stuffed_pages(spark: SparkSession, documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The pages with their figures: doc_id, stuffed (share of all that is stuffed or marked), linked (share marked)."""
    st = Stages(spark, "stuffing")
    blocks = page_blocks(st, spread(documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")))
    pages = st.write(page_figures(blocks))
    words = st.write(blocks.mapInArrow(_word_counts, WORD_COUNTS).groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    q1, q3 = quantiles(pages.where((F.col("size") >= FEWEST) & F.col("rank").isNotNull()), [0.25, 0.75])
    salad = (F.col("size") >= FEWEST) & (F.col("coherence") < F.lit(q1 - 3 * (q3 - q1))) & (F.col("excess") > REPEATED)
    seeds = pages.where(F.coalesce(salad, F.lit(False)) | (F.col("linked") > HALF)).select(F.explode(F.arrays_zip("words", "counts")).alias("w"))
    odds = _odds(st, words, total, seeds.select(F.col("w.words").alias("key"), F.col("w.counts").alias("n"), F.lit(1).alias("pages")))
    for _ in range(ROUNDS - 1):
        odds = _odds(st, words, total, blocks.mapInArrow(_seed_words(*odds), WORD_COUNTS))
    return blocks.select("block", "data", "raw").mapInArrow(_judge(*odds), JUDGED)
