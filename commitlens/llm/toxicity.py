"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

Two strings are alike by the subsequences of ORDER characters that they share, each place weighing DECAY for every
character it spans, so that gaps and inserted characters lower the likeness but do not end it; places that span over
SPAN characters are not counted (a bounded-gap kernel), which keeps the work in proportion to the length. The value is
normalised and raised to POWER. The kernel of two sentences is the sum of these values over their pairs of words: a sum of kernels, so
itself one. The Nyström space is spanned by LANDMARKS one-word strings out of the training sentences: most of them the
words that tell the labels apart, the others drawn by hash from all. A sentence is its kernel values with the landmarks,
times K_mm^-1/2. A linear SVM learns on sentences: for texts labelled 0 those most like the landmarks, for each text
labelled 1 the sentence that speaks loudest for it (chosen anew each round). The margin of a sentence is then a sum over
its words, so a word is worked out once and looked up afterwards. Each text is also fitted on with its words torn: COPIES
times, every word of five letters or more of its KEPT sentences gets a foreign letter, so that the machine weighs how
far a likeness may fall by one. A text's score is a logistic of its TOP greatest margins,
fitted to the labels at the share of 1s among all of them.

Only the fit is bounded: TRAIN_ROWS labelled texts of each label, those with the smallest MD5 of doc_id, each of at most
TRAIN_CHARS characters (longer ones are not fitted on), and of a text KEPT sentences. Scoring reads every text whole. ORDER, DECAY, SPAN, POWER and COPIES were chosen by three
inner folds of the training rows alone (chosen by MD5 of doc_id), whose texts were judged as they are and with a letter
inserted into every word of five letters or more; no held-out row was looked at for it.
Words are what white space separates, lower-cased, freed of marks and given marks at both ends; single letters in a row
are also read as one word; a sentence ends at . ! ? or a line end, and one of over STRETCH words is read in stretches
that overlap; a word of over MOST_LETTERS is read in windows of LONG letters, the last of which ends with the word, each
a sentence of its own. A word of one or two letters shares no subsequence with any landmark and is left out.

Defined results: null and empty texts have no sentence and get the score of a sentence without likeness; labels with a
null toxic are skipped, of several labels of a doc_id the greatest holds, of several texts the least; without training
rows of both labels every score is 0; repeated rows are scored each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT, CUT = 3, 1, 0.7
TRAIN_ROWS, TRAIN_CHARS, KEPT = 3000, 20_000, 12
LANDMARKS, TOP = 256, 3
ORDER, DECAY, SPAN, POWER = 4, 0.6, 6, 2
COPIES = 1
MOST_LETTERS, LONG, STEP, STRETCH, OVERLAP = 24, 8, 2, 40, 10
KEPT_WORDS = 400_000
_MARKS = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")
_LONELY = re.compile(r"(?<!\S)(?:\w\W*\s+){2,}\w(?!\w)")


def _words(text: str) -> dict[str, None]:
    """The distinct words of a stretch of text in lower case, runs of single letters also as one."""
    seen = dict.fromkeys(text.split())
    if sum(len(t) <= 2 for t in seen) >= 3:
        for m in _LONELY.finditer(text):
            run = _MARKS.sub("", m.group())
            seen.update(dict.fromkeys((run, run[1:], run[:-1])))
    return dict.fromkeys(_MARKS.sub("", t) for t in seen)


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as the strings that the kernel compares."""
    out = []
    for s in _SENTENCE.split((text or "").lower()):
        w = s.split()
        stretches = [s] if len(w) <= STRETCH else [" ".join(w[i : i + STRETCH]) for i in range(0, len(w) - OVERLAP, STRETCH - OVERLAP)]
        for part in stretches:
            words = [x for x in _words(part) if x]
            short = [f"^{x}$" for x in words if 2 < len(x) <= MOST_LETTERS]
            if short:
                out.append(short)
            for x in words:
                if len(x) > MOST_LETTERS:
                    out.extend([x[i : i + LONG]] for i in sorted({*range(0, len(x) - LONG, STEP), len(x) - LONG}))
    return out


@lru_cache(64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ORDER characters among n that span at most SPAN of them, and their prices."""
    inner = [(0, *c, last) for last in range(ORDER - 1, SPAN) for c in combinations(range(1, last), ORDER - 2)]
    at = np.array([[i + k for k in c] for c in inner for i in range(n - c[-1])], np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, value) with values of length 1 for each word, by word. A subsequence is a number made of the
    last 16 bits of its characters."""
    size, got = np.array([len(w) for w in words]), []
    for n in np.unique(size[size >= ORDER]):
        at = np.flatnonzero(size == n)
        places, price = _places(int(n))
        c = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, n) & np.uint64(0xFFFF)
        code = c[:, places[:, 0]]
        for k in range(1, ORDER):
            code = (code << np.uint64(16)) | c[:, places[:, k]]
        order = np.argsort(code, 1)
        code = np.take_along_axis(code, order, 1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        value = np.add.reduceat(price[order].ravel(), np.flatnonzero(new.ravel()))
        word = np.repeat(np.arange(len(at)), new.sum(1))
        got.append((at[word], code[new], value / np.sqrt(np.bincount(word, value * value))[word]))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


class Kernel:
    """Kernel values of words with the landmarks, whose subsequences are listed once, each with the landmarks that have it."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.mark, code, self.value = subsequences(landmarks)
        order = np.argsort(code, kind="stable")
        self.mark, self.value = self.mark[order], self.value[order]
        self.codes, self.first, self.many = np.unique(code[order], return_index=True, return_counts=True)

    def values(self, words: list[str]) -> np.ndarray:
        out, wide = np.zeros((len(words), len(self.landmarks)), np.float32), len(self.landmarks)
        for lo in range(0, len(words), 2000):
            word, code, value = subsequences(words[lo : lo + 2000])
            k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[k] == code
            word, k, value = word[known], k[known], value[known]
            many = self.many[k]
            e = np.repeat(self.first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
            part = out[lo : lo + 2000]
            part[:] = np.bincount(np.repeat(word, many) * wide + self.mark[e], np.repeat(value, many) * self.value[e], part.size).reshape(part.shape)
        return out**POWER


class Model:
    """Margins of sentences: the sum of their words' weights, and a bias; the logistic's weights and bias."""

    def __init__(self, kernel: Kernel, direction: np.ndarray, bias: float):
        self.kernel, self.direction, self.bias, self.logistic = kernel, direction, bias, np.zeros(TOP + 1)
        self.key = hashlib.md5(direction.tobytes() + "\n".join(kernel.landmarks).encode("utf-8", "surrogatepass")).hexdigest()

    def learn(self, known: dict[str, float], seen: set[str]) -> None:
        """Adds the weights of words that are not known yet."""
        new = [w for w in seen if w not in known]
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
            new = list(seen)
        for lo in range(0, len(new), 2000):
            part = new[lo : lo + 2000]
            known.update(zip(part, (self.kernel.values(part) @ self.direction).tolist(), strict=True))

    def loudest(self, texts: list[list[list[str]]], known: dict[str, float]) -> np.ndarray:
        """[texts, TOP]: the greatest margins; sentences that are not there count as without likeness."""
        self.learn(known, {w for t in texts for s in t for w in s})
        out = np.zeros((len(texts), TOP))
        for row, t in zip(out, texts, strict=True):
            row[:] = sorted([sum(map(known.__getitem__, s)) for s in t] + [0.0] * TOP, reverse=True)[:TOP]
        return out + self.bias

    def scores(self, texts: list[list[list[str]]], known: dict[str, float]) -> np.ndarray:
        x = self.loudest(texts, known) @ self.logistic[:-1] + self.logistic[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def choose_landmarks(texts: list[list[list[str]]], toxic: np.ndarray, most: int = LANDMARKS) -> list[str]:
    """Three in four: the words with the greatest difference in use between the labels, in standard errors; the others:
    words of the texts by the smallest MD5."""
    seen = [Counter(), Counter()]
    for t, y in zip(texts, toxic, strict=True):
        seen[int(y)].update({w for s in t for w in s})
    n1, n0, scores = max(1, int(toxic.sum())), max(1, int((~toxic).sum())), []
    for w, c in seen[1].items():
        p = (c + seen[0][w]) / (n1 + n0)
        z = (c / n1 - seen[0][w] / n0) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
        if c >= 2 and z >= 3.5 and c / n1 >= 4 * seen[0][w] / n0 and len(w) >= ORDER:
            scores.append((-z, w))
    told = [w for _, w in sorted(scores)[: most * 3 // 4]]
    digest = lambda w: hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()
    rest = sorted((digest(w), w) for w in seen[0].keys() - set(told) if len(w) >= ORDER)
    return told + [w for _, w in rest[: most - len(told)]] if told else []


def _svm(z: np.ndarray, y: np.ndarray, reg: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighing alike, by accelerated gradient steps. z: float32 rows whose
    last column is 1."""
    s = np.where(y, 1.0, -1.0)
    c = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    rate = 1.0 / (2 * float(c @ np.einsum("ij,ij->i", z, z)) + reg)
    w = v = np.zeros(z.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - s * (z @ v.astype(np.float32)))
        grad = -2 * ((c * s * slack).astype(np.float32) @ z) + reg * np.append(v[:-1], 0)
        new = v - rate * grad
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic regression, by damped Newton steps with a small ridge."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = 1e-4 * np.eye(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
    return w


def torn(word: str, copy: int) -> str:
    """The word with a foreign letter inside, both chosen by MD5; words of under five letters stay."""
    if len(word) < 7:
        return word
    h = int.from_bytes(hashlib.md5(f"{copy}:{word}".encode("utf-8", "surrogatepass")).digest()[:8])
    at = 2 + h % (len(word) - 4)
    return word[:at] + chr(ord("a") + (h >> 32) % 26) + word[at:]


def _likest(kernel: Kernel, texts: list[list[list[str]]], white: np.ndarray) -> list[list[np.ndarray]]:
    """For each text the rows of its KEPT sentences most like the landmarks, in the Nyström space; after all texts the
    same for each of the COPIES of them, in which every word of these sentences is torn."""
    out: list[list[np.ndarray]] = [[] for _ in range(COPIES + 1)]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        words = list({w: None for t in part for s in t for w in s})
        at, values, kept = {w: i for i, w in enumerate(words)}, kernel.values(words), []
        for t in part:
            rows = np.array([values[[at[w] for w in s]].sum(0) for s in t], np.float32).reshape(-1, len(kernel.landmarks))
            keep = np.sort(np.argsort(-rows.sum(1), kind="stable")[:KEPT])
            out[0].append(rows[keep] @ white if len(rows) else np.zeros((1, len(white)), np.float32))
            kept.append([t[i] for i in keep])
        for copy in range(1, COPIES + 1):
            again = [[[torn(w, copy) for w in s] for s in t] for t in kept]
            words = list({w: None for t in again for s in t for w in s})
            at, values = {w: i for i, w in enumerate(words)}, kernel.values(words)
            for t in again:
                rows = np.array([values[[at[w] for w in s]].sum(0) for s in t], np.float32).reshape(-1, len(kernel.landmarks))
                out[copy].append(rows @ white if len(rows) else np.zeros((1, len(white)), np.float32))
    return [r for part in out for r in part]


def fit(texts: list[list[list[str]]], toxic: np.ndarray, prior: float = 0.1) -> Model | None:
    """texts: the sentences of each. prior: the share of label 1 among all labelled texts. None without both labels or
    without words that tell them apart."""
    toxic = np.asarray(toxic, bool)
    landmarks = choose_landmarks(texts, toxic) if toxic.any() and not toxic.all() else []
    if not landmarks:
        return None
    kernel = Kernel(landmarks)
    gram = kernel.values(landmarks).astype(float)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    white = ((vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T).astype(np.float32)
    rows = _likest(kernel, texts, white)
    toxic = np.tile(toxic, COPIES + 1)
    calm, loud = [r for r, y in zip(rows, toxic, strict=True) if not y], [r for r, y in zip(rows, toxic, strict=True) if y]
    n = sum(map(len, calm)) + 1  # and a sentence without likeness
    z = np.ones((n + len(loud), len(landmarks) + 1), np.float32)
    z[0, :-1] = 0
    np.concatenate(calm, out=z[1:n, :-1])
    del calm
    said = [int(np.argmax(np.abs(r).sum(1))) for r in loud]
    for _ in range(4):
        for k, (r, i) in enumerate(zip(loud, said, strict=True)):
            z[n + k, :-1] = r[i]
        w, bias = _svm(z, np.arange(len(z)) >= n)
        said = [int(np.argmax(r @ w)) for r in loud]
    del z, loud
    model, known = Model(kernel, white @ w, bias), {}
    whole = [model.loudest(texts[lo : lo + 500], known) for lo in range(0, len(texts), 500)]
    copies = [np.array([np.sort(np.append(r @ w, np.zeros(TOP)))[::-1][:TOP] for r in rows[len(texts) :]]).reshape(-1, TOP) + bias]
    margins = np.vstack(whole + copies)
    weight = np.where(toxic, prior / toxic.sum(), (1 - prior) / (~toxic).sum()) * len(toxic)
    model.logistic = _logistic(margins, weight, toxic.astype(float))
    return model


def chosen_texts(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, toxic, text of at most `most` texts of each label from the training folds, by the smallest MD5 of doc_id; prior:
    the share of 1s among all labels of those folds."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [usable.filter(F.col("toxic") == y).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.char_length("text") <= chars)
    got = short.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return got.join(F.broadcast(usable.agg(F.avg("toxic").alias("prior"))))


def _fit_chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The landmarks and weights of the model of the chosen texts, one row; none if there is no model."""
    same: dict[str, str] = {}  # one string for each word
    rows, prior = [], 0.0
    for b in batches:
        rows += [(i, y, [[same.setdefault(w, w) for w in s] for s in sentences(t)]) for i, y, t in zip(b["doc_id"].tolist(), b["toxic"].tolist(), b["text"].tolist(), strict=True)]
        prior = float(b["prior"].iloc[0]) if len(b) else prior
    rows.sort(key=lambda r: r[0])
    model = fit([s for *_, s in rows], np.array([y == 1 for _, y, _ in rows], bool), min(max(prior, 1e-3), 1 - 1e-3))
    if model:
        yield pd.DataFrame({"landmarks": [model.kernel.landmarks], "direction": [model.direction.tolist()], "bias": [model.bias], "logistic": [model.logistic.tolist()]})


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


#: Weights of the words that a worker process has met, for one model, so that its tasks share them.
_KEPT: dict[str, dict[str, float]] = {}


def _score(model: Model):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model.key not in _KEPT:
            _KEPT.clear()
        known = _KEPT.setdefault(model.key, {})
        for b in batches:
            out = [model.scores([sentences(t) for t in b.iloc[lo : lo + 200]], known) for lo in range(0, len(b), 200)]
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)

    return F.pandas_udf(run, "double")


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The chosen texts, at most 2 * TRAIN_ROWS whatever the input, are fitted in a task of their own; the driver gets the
    landmarks and weights only."""
    fitted = chosen_texts(docs, labels).repartition(1).mapInPandas(_fit_chosen, "landmarks array<string>, direction array<double>, bias double, logistic array<double>").first()
    if fitted is None:
        return None
    model = Model(Kernel(list(fitted["landmarks"])), np.array(fitted["direction"], float), fitted["bias"])
    model.logistic = np.array(fitted["logistic"], float)
    return model


def toxicity_scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    score = _score(model)(F.col("text")) if model else F.lit(0.0)
    scored = docs.select("doc_id", _held_out().alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose score stays below CUT, with the columns of docs."""
    score = _score(model)(F.col("text")) if model else F.lit(0.0)
    return docs.filter(score < CUT)
