"""Evaluation passages inside a training corpus, by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive words that ignores some of them. Every window of every test passage and
of every corpus text is hashed under every mask; windows with equal hashes, in which at most REPLACED words differ, are hits.
Around a hit both texts are laid side by side and compared word by word, so that the result never depends on a hash, and
overlaps go on across substituted words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm.text import slices, visible_words
from keyfold.session import cut

SPAN = 12
#: Positions that each mask ignores. The ends always count; any two inner positions are ignored by at least one mask,
#: so that twelve words in line are hit even if any two inner words were replaced. Fewer than four masks of six can't do that.
IGNORED = ((1, 3, 5, 6, 8, 10), (1, 2, 4, 7, 9, 10), (2, 3, 4, 7, 8, 9), (2, 4, 5, 6, 7, 9))
#: Words that may be replaced within SPAN words in line, so that the masks still find every such pair.
REPLACED = 2
#: A substituted word in an overlap must be outweighed by this many equal ones.
SUBSTITUTION = 4
#: Characters of test passages that are indexed, broadcast and compared at a time; larger test sets go in blocks. The
#: index of a block takes about 15 bytes for each of them in every worker.
BLOCK_CHARS = 4_000_000


def _constants(n: int) -> np.ndarray:
    """Odd multipliers, one for each position of a window."""
    return np.random.default_rng(12).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(ids: np.ndarray, starts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows among ``starts`` all of whose counting words are known, and their hashes."""
    c = _constants(SPAN)
    keep = np.ones(len(starts), bool)
    h = np.full(len(starts), mask + 1, np.uint64)
    with np.errstate(over="ignore"):
        for p in range(SPAN):
            if p not in IGNORED[mask]:
                w = ids[starts + p]
                keep &= w > 0
                x = w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                h += (x ^ (x >> np.uint64(29))) * c[p]
    return starts[keep], h[keep]


@dataclass
class TestIndex:
    """Hashed windows of a block of test passages. Words are numbered from 1; 0 is any other word."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list = field(default_factory=list)
    passages: list[np.ndarray] = field(default_factory=list)
    tables: list[tuple] = field(default_factory=list)
    #: The words of all passages in a row, and where each passage begins.
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    __test__ = False

    @classmethod
    def build(cls, rows: list[tuple]) -> TestIndex:
        """From ``(item_id, passage)``; passages of under SPAN words can't be hit."""
        t = cls()
        for item, passage in rows:
            words = visible_words(passage)
            if len(words) >= SPAN:
                t.items.append(item)
                t.passages.append(np.array([t.vocabulary.setdefault(w, len(t.vocabulary) + 1) for w in words], np.int64))
        if t.passages:
            t.flat = np.concatenate(t.passages)
            t.offsets = np.cumsum([0, *map(len, t.passages[:-1])])
        for mask in range(len(IGNORED)):
            hs, who, at = [], [], []
            for k, ids in enumerate(t.passages):
                starts, h = _hashes(ids, np.arange(len(ids) - SPAN + 1), mask)
                hs.append(h)
                who.append(np.full(len(h), k))
                at.append(starts)
            h, w, a = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, who, at))
            order = np.argsort(h, kind="stable")
            distinct, first, count = np.unique(h[order], return_index=True, return_counts=True)
            t.tables.append((distinct, first, count, w[order], a[order]))
        return t

    def overlaps(self, texts: list[list[str]]) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, longest equal run, overlap, substitutions)`` of every text and item with a hit."""
        return [x[:5] for x in self.compared(texts)]

    def compared(self, texts: list[list[str]]) -> list[tuple[int, int, int, int, int, int | None]]:
        """The same and the fewest words replaced within SPAN words in line whose ends are equal.

        Each is the best over all lines on which text and item have a hit."""
        if not self.items or not texts:
            return []
        get = self.vocabulary.get
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((get(w, 0) for ws in texts for w in ws), np.int64, int(lens.sum()))
        ends = np.cumsum(lens)
        owner = np.repeat(np.arange(len(texts)), lens)
        last = len(ids) - SPAN + 1
        if last <= 0:
            return []
        starts = np.flatnonzero((ids[:last] > 0) & (ids[SPAN - 1 :] > 0) & (owner[:last] == owner[SPAN - 1 :]))
        lines = []
        for mask, (distinct, first, count, who, at) in enumerate(self.tables):
            pos, h = _hashes(ids, starts, mask)
            slot = np.searchsorted(distinct, h)
            slot[slot == len(distinct)] = 0
            hit = distinct[slot] == h
            pos, slot = pos[hit], slot[hit]
            n = count[slot]
            row = np.repeat(first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos = np.repeat(pos, n)
            equal = np.zeros(len(pos), np.int8)
            begin = self.offsets[who[row]] + at[row]
            for p in range(SPAN):
                equal += ids[pos + p] == self.flat[begin + p]
            close = equal >= SPAN - REPLACED
            pos, row = pos[close], row[close]
            lines.append(np.stack([owner[pos], who[row], pos - at[row]], 1))
        best: dict[tuple[int, int], list] = {}
        for text, item, shift in np.unique(np.concatenate(lines), axis=0).tolist():
            begin, end, passage = int(ends[text] - lens[text]), int(ends[text]), self.passages[item]
            lo, hi = max(begin, shift), min(end, shift + len(passage))
            same = ids[lo:hi] == passage[lo - shift : hi - shift]
            run, overlap, substitutions = _compare(same)
            found = [run, (overlap, -substitutions), -_replaced(same)]
            best[text, item] = list(map(max, best.get((text, item), found), found))
        return [(t, i, run, overlap, -s, -r if -r <= SPAN else None) for (t, i), (run, (overlap, s), r) in best.items()]


def _compare(same: np.ndarray) -> tuple[int, int, int]:
    """Longest run of equal words on a line, and length and substitutions of its best overlap."""
    edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = int((end - begin).max()) if len(begin) else 0
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -SUBSTITUTION))])
    low = np.minimum.accumulate(score)
    stop = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: stop + 1] == low[stop])[-1])
    return run, stop - start, int((~same[start:stop]).sum())


def _replaced(same: np.ndarray) -> int:
    """Fewest unequal words among SPAN words in line whose ends are equal; more than SPAN where there are none."""
    wrong = np.concatenate([[0], np.cumsum(~same)])
    n = (wrong[SPAN:] - wrong[:-SPAN])[same[: 1 - SPAN] & same[SPAN - 1 :]]
    return int(n.min()) if len(n) else SPAN + 1


def leaks(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc, item, run, overlap, substitutions, replaced`` for every document that has a hit with a test passage.

    ``run`` is the longest run of equal words, ``overlap`` the longest stretch in which equal words outweigh
    substituted ones by SUBSTITUTION to one, with ``substitutions`` of them, and ``replaced`` the fewest words replaced
    within SPAN words in line whose ends are equal, or null; each on the line where it is best. Every pair with SPAN
    equal words in line is found (``replaced`` 0), and every pair with SPAN words in line of which one or two inner ones were
    replaced (1, 2). For more of them, not every pair is found.

    Words are those of ``visible_words``. Null or short texts and passages have no rows; rows repeated with one id
    count as one document or item; other columns aren't read; empty tables give an empty result. The test set is a
    stated query set: its passages are read in blocks of about ``block_chars`` characters, each broadcast and
    held against the whole corpus in one pass without a shuffle. If there are several blocks the corpus is taken apart into words once, which
    are kept in the shared folder. Only the pairs found are shuffled.
    """
    spark = corpus.sparkSession
    ids = {"doc": corpus.schema[doc].dataType.simpleString(), "item": items.schema[item].dataType.simpleString()}
    schema = f"doc {ids['doc']}, item {ids['item']}, run int, overlap int, substitutions int, replaced int"
    item_type = pa.schema([pa.field("x", _arrow(ids["item"]))]).field(0).type
    chars = items.agg(F.sum(F.length(passage))).first()[0] or 0
    blocks = -(-chars // block_chars)
    found = spark.createDataFrame([], schema)
    texts = corpus.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("text is not null")
    if blocks > 1:
        texts = cut(texts.mapInArrow(_words_of, texts.schema))
    wanted = items.select(F.col(item).alias("i"), F.col(passage).alias("p")).where("p is not null and i is not null")
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(TestIndex.build([tuple(r) for r in rows]))

        def scan(batches: Iterator[pa.RecordBatch], index=index, words=str.split if blocks > 1 else visible_words) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 1):
                got = index.value.compared([words(t) for t in part.column(1).to_pylist()])
                if got:
                    t, i, *rest = zip(*got, strict=True)
                    yield pa.record_batch(
                        [part.column(0).take(pa.array(t)), pa.array([index.value.items[k] for k in i], item_type), *(pa.array(x, pa.int32()) for x in rest)],
                        names=["doc", "item", "run", "overlap", "substitutions", "replaced"],
                    )

        part = texts.mapInArrow(scan, schema)
        found = found.unionByName(part) if b else part
    best = F.max(F.struct("overlap", (-F.col("substitutions")).alias("s"))).alias("b")
    return found.groupBy("doc", "item").agg(F.max("run").alias("run"), best, F.min("replaced").alias("replaced")).select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "run", F.col("b.overlap").alias("overlap"), (-F.col("b.s")).alias("substitutions"), "replaced"
    )


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        yield pa.record_batch([part.column(0), pa.array([" ".join(visible_words(t)) for t in part.column(1).to_pylist()], pa.string())], names=["doc", "text"])


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))
