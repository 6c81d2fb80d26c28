"""Encoding of a corpus with a public byte-level BPE tokenizer by merge replay over the corpus' vocabulary.

1. Texts are cut into words a slice at a time (``SLICE`` characters); a slice keeps its distinct words once, and each of
   its texts as places in that list, two bytes a word for slices of fewer than 65,536 words.
2. The distinct words of the whole corpus are replayed once: laid out as symbols, with an inverted index from token pairs
   to word positions that applies the merges in rank order and touches only the neighbours of a merge.
3. Every slice gets the ids of its own words back by a join on the word, and its texts by the slice. What is shuffled are
   distinct words and places, never texts; a slice is bounded, and a frequent word is one row a slice, so hot sources and
   copies cost no more than their bytes.

``count`` needs no ids back and replays each task's words where they are (``Encoder``).

Cases: null and empty texts give an empty list; texts of any length are encoded whole; the strings of special tokens
are ordinary text; all other columns pass through unless ``keep`` names fewer; an empty table stays empty.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import Stages, spread

#: Where the public vocabulary lies, unless a caller names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of the texts that share a list of words, unless one text is longer, and words replayed at once.
SLICE, REPLAYED = 4_000_000, 500_000
#: Words a task remembers between slices; beyond it the memory starts afresh, which changes no result.
MEMORY = 400_000
#: Fixed value: the public tokenizer's pattern for words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes themselves, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 0x100
    for b in range(256):
        letters.append(chr(b) if b in printable else chr(extra))
        extra += b not in printable
    return letters


class Replay:
    """Ids of words, by replaying the vocabulary's merges over all words at once."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        vocab = model["vocab"]
        self.first = [vocab[c] for c in byte_letters()]
        #: (left id << 32 | right id) -> rank, and by rank the ids before and after.
        self.rank: dict[int, int] = {}
        self.rule: list[tuple[int, int, int]] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.rule.append((vocab[a], vocab[b], vocab[a + b]))

    def encode(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and how many each has."""
        first, rank_of = self.first, self.rank.get
        sym: list[int] = []
        ends = []
        for w in words:
            sym.extend([first[b] for b in w.encode()])
            ends.append(len(sym))
        n = len(sym)
        last = np.zeros(n + 1, bool)
        ends_at = np.asarray(ends, np.int64)
        last[ends_at - 1] = True
        nxt = np.where(last[:n], -1, np.arange(1, n + 1)).tolist()
        prv = np.where(np.concatenate([[True], last[: n - 1]]) if n else np.zeros(0, bool), -1, np.arange(-1, n - 1)).tolist()
        where: dict[int, list[int]] = {}
        for i, j in enumerate(nxt):
            if j >= 0 and (r := rank_of(sym[i] << 32 | sym[j])) is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
        heap = list(where)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            a, b, made = self.rule[r]
            for i in sorted(where.pop(r)):
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = made, -1
                k, p = nxt[j], prv[i]
                nxt[i] = k
                for left, at in ((p, p), (i, k)):
                    if at < 0:
                        continue
                    right = i if left == p else k
                    q = rank_of(sym[left] << 32 | sym[right])
                    if q is not None:
                        if q in where:
                            where[q].append(left)
                        else:
                            where[q] = [left]
                            heapq.heappush(heap, q)
                if k >= 0:
                    prv[k] = i
        ids = np.asarray(sym, np.int32)
        live = ids >= 0
        before = np.concatenate([[0], np.cumsum(live)])
        return ids[live], np.diff(before[np.concatenate([[0], ends_at])]).astype(np.int32)


class Encoder:
    """Ids of texts, word by word, remembering the words of earlier slices."""

    def __init__(self, vocabulary: bytes):
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.replay = Replay(vocabulary)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def words(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The index of every word of every text, and how many words each text has."""
        if len(self.index) > MEMORY:
            self._forget()
        cut, index = self.cut, self.index
        seen, at, counts = len(index), [], []
        for t in texts:
            w = cut(t) if t else ()
            counts.append(len(w))
            at.extend([index.setdefault(x, len(index)) for x in w])
        if len(index) > seen:
            from itertools import islice

            flat, size = self.replay.encode(list(islice(index, seen, None)))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return np.asarray(at, np.int64), np.asarray(counts, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and the offsets of each text in it."""
        at, counts = self.words(texts)
        size = self.size[at].astype(np.int64)
        start = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)])[at]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        totals = np.concatenate([[0], ends])
        return self.flat[take], totals[np.concatenate([[0], np.cumsum(counts)])]

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        at, counts = self.words(texts)
        totals = np.concatenate([[0], np.cumsum(self.size[at], dtype=np.int64)])
        return np.diff(totals[np.concatenate([[0], np.cumsum(counts)])])


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _with_column(df: DataFrame, text: str, keep: Sequence[str] | None, field: T.StructField, make) -> DataFrame:
    keep = [c for c in df.columns if c != field.name] if keep is None else list(keep)
    read = list(dict.fromkeys([*keep, text]))
    out = T.StructType([*(df.schema[c] for c in keep), field])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(read.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, make(b.column(read.index(text)).to_pylist())], names=[*keep, field.name])

    return spread(df.select(*read)).mapInArrow(run, out)


def read_vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast value; its size is that of the public file, one to two megabytes."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most ``SLICE`` characters, or of one longer text."""
    a = 0
    while a < len(texts):
        e, size = a, 0
        while e < len(texts) and (e == a or size + len(texts[e] or "") <= SLICE):
            size += len(texts[e] or "")
            e += 1
        yield a, e
        a = e


TEXT_ROW, WORD_ROW = 0, 1


def _cutter(kept: Sequence[str]):
    """Rows of texts (slice, kept columns, width of a place, places) and of the distinct words of each slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find, number = regex.compile(PATTERN).findall, TaskContext.get().partitionId() << 32
        names = ["kind", "slice", *kept, "place", "places", "word"]
        for b in batches:
            texts = b.column("text").to_pylist()
            for a, e in _slices(texts):
                index: dict[str, int] = {}
                rows = [[index.setdefault(w, len(index)) for w in find(t)] if t else [] for t in texts[a:e]]
                width = 2 if len(index) < 1 << 16 else 4
                places = [np.array(r, f"<u{width}").tobytes() for r in rows]
                n, m = e - a, len(index)
                full = lambda k, v, t: pa.array(np.full(k, v), t)
                yield pa.RecordBatch.from_arrays([full(n, TEXT_ROW, pa.int32()), full(n, number, pa.int64()), *[b.column(c).slice(a, n) for c in kept], full(n, width, pa.int32()), pa.array(places, pa.binary()), pa.nulls(n, pa.string())], names=names)
                yield pa.RecordBatch.from_arrays([full(m, WORD_ROW, pa.int32()), full(m, number, pa.int64()), *[pa.nulls(m, b.column(c).type) for c in kept], pa.array(np.arange(m), pa.int32()), pa.nulls(m, pa.binary()), pa.array(list(index), pa.string())], names=names)
                number += 1

    return run


def _replayer(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, words = _encoder(shared.value).replay, []

        def done() -> pa.RecordBatch:
            flat, size = replay.encode(words)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["word", "tokens"])

        for b in batches:
            words += b.column("word").to_pylist()
            if len(words) >= REPLAYED:
                yield done()
                words = []
        if words:
            yield done()

    return run


def _returned(kept: Sequence[str]):
    """The texts of a slice with the ids of its words."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        words = words.combine_chunks()
        place = words["at"].to_numpy()
        order = np.argsort(place)
        lists = words["tokens"].chunk(0) if words.num_rows else pa.array([], pa.list_(pa.int32()))
        first, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        start, size = first[:-1][order].astype(np.int64), np.diff(first)[order].astype(np.int64)
        rows = [np.frombuffer(p, f"<u{w}") for p, w in zip(texts["places"].to_pylist(), texts["place"].to_pylist())]
        at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        ends = np.cumsum(size[at])
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(start[at] - (ends - size[at]), size[at])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[take].astype(np.int32)))
        return pa.Table.from_arrays([*[texts[c] for c in kept], ids], names=[*kept, "ids"])

    return run


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str = VOCABULARY, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the list of token ids of ``text``; ``keep`` names the other columns of the result, by default all."""
    keep = [c for c in df.columns if c != ids] if keep is None else list(keep)
    kept = [f"c{i}" for i in range(len(keep))]
    st, shared = Stages(df.sparkSession, "tokens"), read_vocabulary(df, path)
    read = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept)], F.col(f"`{text}`").alias("text"))
    carried = [T.StructField(k, df.schema[c].dataType) for c, k in zip(keep, kept)]
    shape = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("slice", T.LongType()), *carried, T.StructField("place", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("word", T.StringType())])
    seen = st.write(spread(read).mapInArrow(_cutter(kept), shape), by="kind")
    words = seen.where(F.col("kind") == WORD_ROW).select(F.col("slice").alias("of"), F.col("place").alias("at"), "word")
    vocabulary = st.write(words.select("word").distinct().mapInArrow(_replayer(shared), "word string, tokens array<int>"))
    dictionary = words.join(vocabulary, "word").select("of", "at", "tokens")
    texts = seen.where(F.col("kind") == TEXT_ROW).select("slice", *kept, "place", "places")
    out = texts.groupBy("slice").cogroup(dictionary.groupBy("of")).applyInArrow(_returned(kept), T.StructType([*carried, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], F.col("ids").alias(ids))


def count(df: DataFrame, text: str = "text", tokens: str = "n_tokens", path: str = VOCABULARY, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the number of tokens of ``text``."""
    shared = read_vocabulary(df, path)
    return _with_column(df, text, keep, T.StructField(tokens, T.LongType()), lambda texts: pa.array(_encoder(shared.value).count(texts)))
