"""Cutting oversized texts into pieces at natural boundaries, with overlap, by pointer doubling.

Every boundary of a text is joined to its farthest legal successor, the piece's start being ``overlap`` characters
before the boundary; squaring that successor table marks all cuts on the greedy path from the start in a logarithmic
number of steps. A text is a row and needs no other row, so the tables of a text live in arrays beside it and nothing
is shuffled; hot keys play no part.

A boundary lies behind a line break (best), behind the end of a sentence, or behind white space or one of
``. ! ? 。 ！ ？`` (last). A piece ends at the farthest boundary of the best kind in the later half of its reach, else
at the farthest boundary in reach, else, where a run of other characters fills the reach, exactly at the limit
(``forced``). Lengths count Unicode characters.

Cases: null texts and texts within the limit make no row; texts of any length are cut whole; an overlap of half the
limit or more raises ValueError; repeated rows give repeated results, which the queries reduce; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, SENTENCE, LINE = 1, 2, 3
KINDS = {0: "forced", WORD: "word", SENTENCE: "sentence", LINE: "line", 4: "end"}
# Marks that end a sentence, of which the wide ones need no white space behind them.
MARKS, WIDE_MARKS = ".!?。！？", "。！？"
BREAKS = "\n\v\f\r\x85\u2028\u2029"


@dataclass(frozen=True)
class Spec:
    name: str
    limit: int
    overlap: int

    def __post_init__(self):
        if not 0 <= self.overlap * 2 < self.limit:
            raise ValueError(f"overlap {self.overlap} must be less than half of the limit {self.limit}")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For characters below U+10000: is white space (Unicode's White_Space), and the kind of boundary behind it."""
    space = np.array([chr(c).isspace() and not 0x1C <= c <= 0x1F for c in range(0x10000)])
    kind = np.where(space, WORD, 0).astype(np.int8)
    kind[[ord(c) for c in MARKS]] = WORD
    kind[[ord(c) for c in WIDE_MARKS]] = SENTENCE
    kind[[ord(c) for c in BREAKS]] = LINE
    return space, kind


def boundaries(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The length of a text, the positions behind which it may be cut, and the kind of each."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars < 0x10000, chars, 0)
    space, kinds = _tables()
    kind = kinds[chars]
    spaced = np.append(space[chars[1:]], True) if len(chars) else np.zeros(0, bool)
    stop = np.isin(chars, [ord(c) for c in MARKS]) & spaced
    # Behind "\r\n" and behind the blank after a stop is as good a place as behind the stop itself.
    kind = np.where(stop, SENTENCE, kind)
    follows = np.append(False, stop[:-1]) & (kind == WORD) if len(chars) else kind > 0
    kind = np.where(follows, SENTENCE, kind)
    at = np.flatnonzero(kind)
    return len(chars), at + 1, kind[at]


def longest_run(n: int, at: np.ndarray) -> int:
    """The most successive characters behind which no cut is natural."""
    return int(np.max(np.diff(np.concatenate([[0], at, [n + 1]])) - 1)) if n else 0


def runs_cut(n: int, at: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The length of the run of other characters in which each forced cut of ``cut`` lies.

    A run longer than the limit is always met by a forced cut: the piece that reaches its start ends inside it or at the
    boundary before it, and then the next one cannot reach the boundary behind it."""
    e = ends[kinds == 0]
    i = np.searchsorted(at, e)
    edges = np.concatenate([[0], at, [n + 1]])
    return edges[i + 1] - edges[i] - 1


def cut(n: int, at: np.ndarray, kind: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pieces of a text of n characters, and the kind of boundary of each end (0: forced, 4: end)."""
    inner = at < n
    at, kind = at[inner], kind[inner]
    by_kind = [at, at[kind >= SENTENCE], at[kind == LINE]]

    def successor(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next cut from each cut, and whether it is forced."""
        start = np.where(p > 0, p - overlap, 0)
        reach = start + limit
        out, left = np.full(len(p), -1, np.int64), reach < n
        out[~left] = n
        for own, floor in ((by_kind[2], start + limit // 2), (by_kind[1], start + limit // 2), (by_kind[0], p)):
            if len(own):
                last = own[np.maximum(np.searchsorted(own, reach, "right") - 1, 0)]
                hit = left & (last <= reach) & (last > np.maximum(floor, p))
                out[hit], left = last[hit], left & ~hit
        out[left] = reach[left]
        return out, left

    nodes = [np.concatenate([[0], at, [n]]).astype(np.int64)]
    following, forced = successor(nodes[0])
    fresh = np.setdiff1d(following[forced], nodes[0])
    while len(fresh):
        nodes.append(fresh)
        following, forced = successor(fresh)
        fresh = following[forced]
    table = np.unique(np.concatenate(nodes))
    jump = np.searchsorted(table, successor(table)[0])
    jump[-1] = len(table) - 1
    marked = np.zeros(len(table), bool)
    marked[0] = True
    while True:
        more = marked.copy()
        more[jump[marked]] = True
        if (more == marked).all():
            break
        marked, jump = more, jump[jump]
    ends = table[marked][1:]
    place = np.minimum(np.searchsorted(at, ends), max(len(at) - 1, 0))
    natural = (at[place] == ends) if len(at) else np.zeros(len(ends), bool)
    return ends, np.where(ends == n, 4, np.where(natural, kind[place] if len(at) else 0, 0))


PIECES = "array<struct<piece_no:int,start:int,end:int,cut:string{}>>"


def pieces(df: DataFrame, id_column: str, text: str, specs: Sequence[Spec], with_text: bool = False) -> DataFrame:
    """One row a long text and spec: spec, id, forced INT, pieces. ``forced`` is 1 where a piece had to be cut
    inside a run longer than the limit that offers no natural boundary."""
    least = min((s.limit for s in specs), default=0)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, t in zip(f["id"], f["text"]):
                n, at, kind = boundaries(t)
                for s in specs:
                    if n <= s.limit:
                        continue
                    ends, kinds = cut(n, at, kind, s.limit, s.overlap)
                    starts = np.concatenate([[0], ends[:-1] - s.overlap])
                    made = [{"piece_no": i, "start": int(a), "end": int(e), "cut": KINDS[int(k)]} | ({"text": t[a:e]} if with_text else {}) for i, (a, e, k) in enumerate(zip(starts, ends, kinds))]
                    rows.append((s.name, key, int((runs_cut(n, at, ends, kinds) > s.limit).any()), made))
            yield pd.DataFrame(rows, columns=["spec", "id", "forced", "pieces"])

    long = df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where(F.length("text") > least if specs else F.lit(False))
    return long.mapInPandas(run, f"spec string, id {df.schema[id_column].dataType.simpleString()}, forced int, pieces {PIECES.format(',text:string' if with_text else '')}")
