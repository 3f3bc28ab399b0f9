"""LM scoring by subword lattice likelihood.

A text is a sequence of words and an end. The probability of a word is that of a lattice: all segmentations into the
pieces of an existing subword vocabulary, all of its pieces (with bytes for characters it lacks), summed by a forward
recursion in log space. A piece weighs as often as the vocabulary's own scores choose it in the best segmentations of the
distinct words of the training texts, plus one. A word of the training texts is one more arc from the word's start to its
end: its training frequency, less an absolute discount, and the freed mass weighs the paths over pieces. With the weight
CACHE the text's own words so far are a last arc. Sums over arcs are sums over ways to write the text, so the result is
the marginal probability of the document.

The corpus side grows with the input: counts of all words of all training texts, combined before the shuffle. Words
that make up at least HEAVY of all training tokens (at most 1/HEAVY, so at most a million) are shipped to the tasks;
for the others each document sends its words to their counts and the sums come back. Lattices are walked once for each
distinct word.

Defined results: null text is empty and scores its end only; repeated rows are scored each; without training texts
every word is unknown; an empty table gives an empty result; other columns are ignored; a null doc_id hashes as ''.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialize

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 7, 2
HEAVY, CACHE = 1e-6, 0.1
#: Distinct words that a task counts, and words that it scores, before it hands them on.
COUNTED_WORDS, SCORED_WORDS = 500_000, 200_000
START = "▁"


@lru_cache(2)
def _processor(model: bytes):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=model)


def load_pieces(path: str = VOCABULARY) -> tuple[bytes, list[str]]:
    """The vocabulary file as it is, for the tasks, and its usable pieces: those without A-Z, and START only in front."""
    with open(path, "rb") as f:
        model = f.read()
    sp = _processor(model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return model, [p for p in names if not any("A" <= c <= "Z" for c in p) and START not in p[1:]]


class Lattice:
    """Forward recursion over all segmentations of a word: in log space, but for short words, whose products cannot
    underflow (a sum below FLOOR goes back to log space)."""

    SHORT, FLOOR = 40, 1e-250

    def __init__(self, pieces: dict[str, float], byte: list[float]):
        self.byte = byte
        self.next = dict.fromkeys((p[:k] for p in pieces for k in range(1, len(p))), 0.0)  # beginnings of pieces: 0
        self.next.update(pieces)

    def arcs(self, s: str) -> list[tuple[int, int, float]]:
        """Arcs (start, end, weight) of START + word, in the order of their starts."""
        n, get, out = len(s), self.next.get, []
        for i in range(n):
            w = get(s[i])
            if w is None or i and s[i] == START:
                out.append((i, i + 1, self.bytes_weight(s[i])))
                continue
            out.append((i, i + 1, w or self.bytes_weight(s[i])))
            for j in range(i + 2, n + 1):
                w = get(s[i:j])
                if w is None:
                    break
                if w:
                    out.append((i, j, w))
        return out

    def bytes_weight(self, c: str) -> float:
        return math.prod(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the word's marginal probability."""
        s = START + word
        if len(s) <= self.SHORT and (p := self.short_probability(s)) > self.FLOOR:
            return math.log(p)
        a = [0.0] + [-math.inf] * len(s)
        for i, j, w in self.arcs(s):
            x = a[i] + math.log(w)
            hi, lo = (a[j], x) if a[j] > x else (x, a[j])
            a[j] = hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))
        return a[-1]

    def short_probability(self, s: str) -> float:
        """The same sum over the arcs as they are found, in plain products."""
        n, get = len(s), self.next.get
        a = [1.0] + [0.0] * n
        for i in range(n):
            w = get(s[i])
            if w is None or i and s[i] == START:
                a[i + 1] += a[i] * self.bytes_weight(s[i])
                continue
            a[i + 1] += a[i] * (w or self.bytes_weight(s[i]))
            for j in range(i + 2, n + 1):
                w = get(s[i:j])
                if w is None:
                    break
                a[j] += a[i] * w
        return a[n]


def _words(text: pa.Scalar) -> list[bytes]:
    """The words of a text in UTF-8: bytes.lower and bytes.split know A-Z and the contract's white space only."""
    return (text.as_py() or b"").lower().split()


def _text(words) -> pa.Array:
    return pa.array(words, pa.binary()).view(pa.string())


def _chosen(model: bytes):
    """How often the vocabulary chooses each piece (a byte: as <0xNN>) in the words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = _processor(model)
        found = np.zeros(sp.get_piece_size(), np.int64)
        for b in batches:
            for lo in range(0, len(b), 5000):
                words = [w.encode("utf-8", "replace").decode() for w in b["word"].iloc[lo : lo + 5000]]
                found += np.bincount([i for ids in sp.encode(words, num_threads=1) for i in ids], minlength=len(found))
        at = np.flatnonzero(found)
        if len(at):
            yield pd.DataFrame({"piece": [sp.id_to_piece(int(i)) for i in at], "n": found[at]})

    return run


def _subword_logs(pieces, byte):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(pieces, byte)
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "c": b["c"], "sub": [lattice.log_probability(w) for w in b["word"]]})

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, handed on whenever it holds COUNTED_WORDS of them."""
    counts = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_text(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    for b in batches:
        for held, text in zip(b.column("held").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
            if held:
                counts.update(dict.fromkeys(_words(text), 0))
            else:
                counts.update(_words(text))
            if len(counts) > COUNTED_WORDS:
                yield made()
                counts.clear()
    if counts:
        yield made()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c (its count in training texts; 0 for words of held-out texts only)."""
    each = docs.select(_held_out().alias("held"), "text").mapInArrow(_counted, "word string, c long")
    return each.groupBy("word").agg(F.sum("c").alias("c"))


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def train_pieces(words: DataFrame, path: str) -> tuple[dict[str, float], list[float]]:
    """Weights of the pieces and of the 256 bytes from the distinct training words; at most as many counts as the
    vocabulary has pieces come to the driver."""
    model, names = load_pieces(path)
    sums = words.filter("c > 0").select("word").mapInPandas(_chosen(model), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    got = {r["piece"]: r["n"] for r in sums.collect()}
    weights = {k: got.get(k, 0) + 1.0 for k in names}
    bytes_ = [got.get(f"<0x{b:02X}>", 0) + 1.0 for b in range(256)]
    total = sum(weights.values()) + sum(bytes_)
    return {k: v / total for k, v in weights.items()}, [b / total for b in bytes_]


SCORED = "row long, key string, word string, n long, known long, base double, score double, shares array<double>"


def _score(words: dict[bytes, int], plus: np.ndarray, p: np.ndarray, cache: float):
    """Sums over the heavy words of each text (base and score); its other words with the cache's share at each
    occurrence. words: a heavy word's place in plus and p."""
    names, shares = [c.split()[0] for c in SCORED.split(", ")], pa.list_(pa.float64())

    def made(row, key, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(ws) for ws in texts], np.int64)
        flat = [w for ws in texts for w in ws]
        ids = np.fromiter(map(words.get, flat, repeat(-1)), np.int64, len(flat))
        rare: dict[bytes, int] = {}
        at = np.flatnonzero(ids < 0)
        ids[at] = [len(plus) + rare.setdefault(flat[i], len(rare)) for i in at.tolist()]
        owner = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        same = owner * (len(plus) + len(rare)) + ids
        order = np.argsort(same, kind="stable")  # equal words of a text side by side, in their order
        same, ids, owner = same[order], ids[order], owner[order]
        new = np.append(True, same[1:] != same[:-1])[: len(flat)]
        first = np.flatnonzero(new)
        before = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
        share = cache * before / np.maximum(place[order], 1)
        heavy = ids < len(plus)
        of, word = owner[heavy], ids[heavy]
        total = lambda x: pa.array(np.bincount(of, x, len(texts)).astype(float))  # noqa: E731  (without words: whole numbers)
        known = pa.array(np.bincount(of, minlength=len(texts)).astype(np.int64))
        none = [pa.nulls(len(texts), t) for t in (pa.string(), shares)]
        yield pa.RecordBatch.from_arrays([row, key, none[0], pa.array(size), known, total(plus[word]), total(np.log10((1.0 - cache) * p[word] + share[heavy])), none[1]], names)
        if len(at):
            begin = np.flatnonzero(new[~heavy])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), pa.array(share[~heavy]))
            zero, zeros = pa.array(np.zeros(len(begin), np.int64)), pa.array(np.zeros(len(begin)))
            word = _text(list(rare)).take(pa.array(ids[~heavy][begin] - len(plus)))
            yield pa.RecordBatch.from_arrays([row.take(pa.array(owner[~heavy][begin])), pa.nulls(len(begin), pa.string()), word, zero, zero, zeros, zeros, lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, held, texts = 0, 0, []
            for i, text in enumerate(b.column("text").cast(pa.binary())):
                texts.append(_words(text))
                held += len(texts[-1])
                if held > SCORED_WORDS or i == b.num_rows - 1:
                    yield from made(b.column("row").slice(lo, len(texts)), b.column("key").slice(lo, len(texts)), texts)
                    lo, held, texts = i + 1, 0, []

    return run


def score_texts(docs: DataFrame, path: str = VOCABULARY, heavy_share: float = HEAVY, cache: float = CACHE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text)."""
    counts = materialize(word_counts(docs), "words")
    ends = docs.filter(~_held_out()).count()
    t = counts.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    total, distinct = (t["n"] or 0) + ends, t["v"] + (ends > 0)
    discount = t["once"] / (t["once"] + 2 * t["twice"]) if t["once"] and t["twice"] else 0.5
    mass = discount * max(t["v"], 1) / total if total else 1.0
    pieces, byte = train_pieces(counts, path)
    words = materialize(counts.mapInPandas(_subword_logs(pieces, byte), "word string, c long, sub double"), "lattice")
    arc = F.when(F.col("c") > 0, F.log((F.col("c") - discount) / max(total, 1) + mass * F.exp("sub"))).otherwise(math.log(mass) + F.col("sub"))
    words = words.select("word", "c", F.log10(F.col("c") + 1.0).alias("plus"), arc.alias("log"))
    heavy, plus, p = {}, [], []
    for r in words.filter(F.col("c") >= max(1.0, heavy_share * total)).select("word", "plus", "log").toLocalIterator() if total else ():
        heavy[r["word"].encode("utf-8", "surrogatepass")] = len(plus)
        plus.append(r["plus"])
        p.append(math.exp(r["log"]))  # at least once in training, so far from 0
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("key"), "text")
    scored = _score(heavy, np.array(plus, float), np.array(p, float), cache)
    made = materialize(texts.mapInArrow(scored, SCORED), "scored")
    rare = made.filter("word is not null").select("row", "word", "shares").join(words, "word")
    mixed = F.expr(f"aggregate(shares, 0D, (a, s) -> a + if(s = 0, {math.log10(1.0 - cache)}D + log / {math.log(10)}D, log10({1.0 - cache}D * exp(log) + s)))")
    occurs = F.size("shares")
    rare = rare.select("row", F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, occurs).otherwise(0).cast("long").alias("known"), (F.col("plus") * occurs).alias("base"), mixed.alias("score"))
    sums = made.filter("word is null").select("row", "key", "n", "known", "base", "score").unionByName(rare)
    sums = sums.groupBy("row").agg(F.max("key").alias("key"), *[F.sum(c).alias(c) for c in ("n", "known", "base", "score")])
    return _finish(sums.withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)), total, distinct, ends, cache)


def _finish(sums: DataFrame, total: int, distinct: int, ends: int, cache: float) -> DataFrame:
    """Adds the end of each text. p(end) is its training frequency."""
    end_base, end_known = math.log10(ends + 1), int(ends > 0)
    end_score = math.log10((1.0 - cache) * ends / total) if ends else 0.0
    n = F.col("n") + 1
    return sums.select(
        "doc_id", _held_out().alias("held_out"), n.cast("long").alias("n_tokens"), (F.col("known") + end_known).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - n * math.log10(total + distinct + 1)).alias("base_score"), (F.col("score") + end_score).alias("score"),
    )
