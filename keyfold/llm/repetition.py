"""Repetition inside a document, beside the fertility of a public vocabulary on its words.

Fertility measures (letters per token, byte-fallback share, token entropy) don't know the order of words, so they can't
tell by themselves which share of a text is repeated. What they do give is a proven band: a repeated word brings no
token that its text hasn't had, so a text of ``T`` tokens with ``R`` repeated words has at most ``T - R`` different
tokens and a token entropy of at most ``log2(T - R)`` bits. A text above the band of the wanted share is rejected;
of all others the repeated words are counted exactly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm import tokens
from keyfold.llm.text import slices

#: A word is repeated if it lies in a run of this many words that starts at an earlier place too.
RUN = 8
SHARE = 0.3
#: Words of which a worker remembers the tokens; beyond it starts afresh.
MEMORY = 400_000
_LETTERS = regex.compile(r"\p{L}+")
_FIELDS = "words int, repeated int, share double, tokens int, letters_per_token double, byte_share double, entropy double, fertility double, script string, above_band boolean"


def letter_words(text: str | None) -> list[str]:
    """Runs of letters of the raw text, lower-cased one by one."""
    return [w.lower() for w in _LETTERS.findall(text)] if text else []


def repeated_words(ids: np.ndarray, lens: np.ndarray, run: int = RUN) -> np.ndarray:
    """How many words of each text are repeated. ``ids``: the words of all texts one after the other."""
    owner = np.repeat(np.arange(len(lens)), lens)
    n = len(ids) - run + 1
    if n <= 0:
        return np.zeros(len(lens), np.int64)
    starts = np.flatnonzero(owner[:n] == owner[run - 1 :])
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        h = owner[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for p in range(run):
            h = h * np.uint64(0x94D049BB133111EB) + x[starts + p]
            h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")  # equal windows side by side, the earliest first
    at, hs = starts[order], h[order]
    head = np.concatenate([[True], hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, bool)
    first = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))] if len(at) else at
    again, first = at[~head], first[~head]
    same = owner[again] == owner[first]
    for p in range(run):
        same &= ids[again + p] == ids[first + p]
    again = again[same]
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[again] += 1
    cover[again + run] -= 1
    return np.bincount(owner, weights=np.cumsum(cover[:-1]) > 0, minlength=len(lens)).astype(np.int64)


class Fertility:
    """Tokens of words under a vocabulary with byte fallback, remembered word by word."""

    def __init__(self, folder: str):
        self.folder = folder
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: dict[str, int] = {}
        # Tokens of all words in a row, and by word how many, how many letters, and the number of its script.
        self.flat, self.size, self.letters, self.scripts = (np.zeros(0, np.int64) for _ in range(4))

    def number(self, texts: list[list[str]]) -> np.ndarray:
        """Numbers of the words of all texts; new words are tokenized once."""
        if len(self.ids) > MEMORY:
            self._clear()
        known = len(self.ids)
        put = self.ids.setdefault
        out = np.fromiter((put(w, len(self.ids)) for ws in texts for w in ws), np.int64)
        if fresh := list(islice(self.ids, known, None)):
            sp, _ = tokens.pieces(self.folder)
            parts = sp.encode(fresh, num_threads=1)
            more = lambda old, new: np.concatenate([old, np.fromiter(new, np.int64)])
            self.flat = more(self.flat, (t for p in parts for t in p))
            self.size = more(self.size, map(len, parts))
            self.letters = more(self.letters, map(len, fresh))
            self.scripts = more(self.scripts, (self.names.setdefault(_script(w[0]), len(self.names)) for w in fresh))
        return out

    def measure(self, ids: np.ndarray, lens: np.ndarray) -> dict[str, np.ndarray]:
        """Per text: tokens, different tokens, letters, byte tokens, entropy in bits, script that most letters have."""
        n = len(lens)
        owner = np.repeat(np.arange(n), lens)
        begin = np.cumsum(self.size) - self.size
        count = self.size[ids]
        token = self.flat[np.repeat(begin[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        of = np.repeat(owner, count)
        total = np.bincount(of, minlength=n)
        is_byte = tokens.pieces(self.folder)[1]
        key = np.sort(of * (1 << 20) + token)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([edge, [len(key)]]))
        who = key[edge] >> 20
        p = times / np.maximum(total[who], 1)
        letters, scripts = self.letters[ids], self.scripts[ids]
        by = np.bincount(owner * max(1, len(self.names)) + scripts, weights=letters, minlength=n * max(1, len(self.names))).reshape(n, -1)
        names = [*self.names, ""]
        return {
            "tokens": total,
            "distinct": np.bincount(who, minlength=n),
            "letters": np.bincount(owner, weights=letters, minlength=n),
            "bytes": np.bincount(of, weights=is_byte[token], minlength=n),
            "entropy": np.bincount(who, weights=-p * np.log2(p), minlength=n),
            "script": [names[k] for k in by.argmax(1)],
        }


def _script(letter: str) -> str:
    return unicodedata.name(letter, "UNKNOWN").split()[0].split("-")[0]


def _band(total: np.ndarray, words: np.ndarray, share: float) -> np.ndarray:
    """The entropy that a text with this share of repeated words can't exceed."""
    need = np.ceil(share * words - 1e-9)
    return np.log2(np.maximum(total - need, 1)) + 1e-9


def repetition(docs: DataFrame, doc: str = "doc_id", text: str = "text", share: float = SHARE, run: int = RUN, all_counts: bool = True, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """Per document: ``words``, ``repeated`` words and their ``share``, and the fertility measures of the vocabulary.

    Words are runs of letters of the raw text, lower-cased. A word is repeated if it lies in a run of ``run`` words
    which also starts at an earlier place in the same text. ``tokens``, ``letters_per_token``, ``byte_share``,
    ``entropy`` (bits) and ``fertility`` (tokens per word) are those of the words under a public vocabulary with
    byte fallback; ``script`` is the one that most letters have. ``above_band``: the entropy is higher than a text with
    ``share`` of repeated words can have. With ``all_counts=False`` such texts aren't counted and have null ``repeated`` and
    ``share``.

    Every row gives one row, repeated ids as well; a null, empty or wordless text has 0 words, share 0 and null measures.
    Whole texts are read. No shuffle; a worker holds SLICE_BYTES of text and MEMORY words.
    """
    id_type = docs.schema[doc].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fertility(folder)
        for part in slices(batches, 1):
            texts = [letter_words(t) for t in part.column(1).to_pylist()]
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            ids = f.number(texts)
            m = f.measure(ids, lens)
            above = (m["entropy"] > _band(m["tokens"], lens, share)) & (lens > 0)
            counted = np.ones(len(lens), bool) if all_counts else ~above
            repeated = np.zeros(len(lens), np.int64)
            repeated[counted] = repeated_words(ids[np.repeat(counted, lens)], lens[counted], run)
            none, t = lens == 0, np.maximum(m["tokens"], 1)
            ratio = lambda x, y, hide=none: pa.array(x / y, pa.float64(), mask=hide)
            yield pa.record_batch(
                [
                    part.column(0), pa.array(lens, pa.int32()), pa.array(repeated, pa.int32(), mask=~counted), ratio(repeated, np.maximum(lens, 1), ~counted),
                    pa.array(m["tokens"], pa.int32()), ratio(m["letters"], t), ratio(m["bytes"], t), ratio(m["entropy"], 1), ratio(m["tokens"], np.maximum(lens, 1)),
                    pa.array([None if z else s for s, z in zip(m["script"], none, strict=True)], pa.string()), pa.array(above),
                ],
                names=["doc_id", "words", "repeated", "share", "tokens", "letters_per_token", "byte_share", "entropy", "fertility", "script", "above_band"],
            )

    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(scan, f"doc_id {id_type}, {_FIELDS}")


def repetitive(docs: DataFrame, share: float = SHARE, **options) -> DataFrame:
    """Documents of at least ``share`` repeated words, counted where the band doesn't rule it out."""
    r = repetition(docs, share=share, all_counts=False, **options)
    # The share as a fraction of whole numbers: 3 of 10 must pass 0.3.
    return r.where((F.col("words") > 0) & (F.col("repeated").cast("decimal(20,0)") >= F.lit(str(share)).cast("decimal(10,6)") * F.col("words").cast("decimal(20,0)")))


def bands(measured: DataFrame, width: float = 4.0) -> DataFrame:
    """Rejection bands per script: median of each measure and ``width`` times half the distance of its quartiles."""
    what = ["letters_per_token", "byte_share", "entropy_rate"]
    m = measured.where("words > 0").withColumn("entropy_rate", entropy_rate())
    q = m.groupBy("script").agg(F.count("*").alias("documents"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in what))
    cols = []
    for c in what:
        half = (F.col(c)[2] - F.col(c)[0]) / 2 * width
        cols += [(F.col(c)[1] - half).alias(f"{c}_low"), (F.col(c)[1] + half).alias(f"{c}_high")]
    return q.select("script", "documents", *cols)


def entropy_rate():
    """Entropy as a share of the most that a text of so many tokens can have; 1 for a text of one token."""
    return F.when(F.col("tokens") > 1, F.col("entropy") / F.log2("tokens")).otherwise(F.lit(1.0))


def fertility_verdicts(measured: DataFrame, width: float = 4.0) -> DataFrame:
    """``doc_id, script`` and, for each measure, its value and whether it lies outside the band of the script."""
    b = bands(measured, width)
    m = measured.withColumn("entropy_rate", entropy_rate()).where("words > 0")
    out = lambda c: ((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high"))).alias(f"{c}_out")
    # The bands have one row a script, of which Unicode has fewer than 400.
    return m.join(F.broadcast(b), "script").select("doc_id", "script", *(x for c in ("letters_per_token", "byte_share", "entropy_rate") for x in (F.col(c), out(c))))

