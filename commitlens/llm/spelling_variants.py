"""Spelling variant grouping: the vocabulary's acceptor, a one-edit transducer and the acceptor again, composed.

Two words within one edit share a beginning or an end: with m the length of the shorter, one of its two halves is in
both. So every word goes to the partitions (m, beginning) and (m, end) for m its own length and one less, each of which
is an initial state of the acceptor: the state that the shared beginning (or the reversed end) leads to. A pair belongs
to one partition only, by the length of its common beginning. A partition with more words than a task should hold is
halved again in its middle; in the end at most two characters differ, so that a partition holds at most A + A * A words of
an alphabet of A letters, 8,190 for that of the contract: the bound on a task is proven, and no word is left out.

Within a task all its partitions share one minimised acceptor (equal states are one), in which the words below each state
are counted, so that a path is a number and not a text. The composition is enumerated from each initial state: both tapes
read the same letter, then one edit (a letter replaced, or one of the longer word skipped), then both read to the end;
where both tapes reach the same state all words below it are accepted at once. Tasks return a row for each word, not
pairs: its number of near words there and the best of them.

Defined results: null text has no words; a null doc_id counts as the empty text in the hash; equal n go to the word that
is smallest in code-point order; repeated rows count again; an empty table gives an empty result; other columns are
ignored. Whole texts are read; words of any length take part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import UPPER, discard, materialize, small

#: Fixed values of the contract.
RUN, DAMAGE, LEAST_LENGTH, LEAST_COUNT, RATIO = r"[A-Za-zÀ-ÿ]+", 199, 6, 5, 5
#: Words of a partition beyond which it is halved again; words and characters of the partitions that share an acceptor.
PART_WORDS, TASK_WORDS, TASK_CHARS = 20_000, 50_000, 4_000_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
LOWER = str.maketrans(UPPER, UPPER.lower())


def damaged_run(doc: str, run: str) -> str:
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % DAMAGE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their numbers of occurrences, summed up within the task as far as memory should go."""
    runs, total = re.compile(RUN), Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    for b in batches:
        for i in range(b.num_rows):
            text, doc = b.column(1)[i].as_py(), b.column(0)[i].as_py()
            for run, n in Counter(m.translate(LOWER) for m in runs.findall(text)).items():
                word = damaged_run(doc, run)
                if len(word) >= LEAST_LENGTH:
                    total[word] += n
            if len(total) > COUNTED:
                yield out()
                total.clear()
    if total:
        yield out()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    texts = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


#: The two halves of a partition: its rest, of at least r characters, shares the first h of them or the last r - h.
_HALVES = """inline(array(
  named_struct('a', a + h, 'b', b, 'bound', bound, 'head', concat(head, left(rest, h)), 'tail', tail, 'rest', substring(rest, h + 1)),
  named_struct('a', a, 'b', b + r - h, 'bound', least(bound, a + h), 'head', head, 'tail', concat(right(rest, r - h), tail), 'rest', left(rest, length(rest) - r + h))))"""
KEY = ["m", "a", "b", "bound", "head", "tail"]


def _halved(parts: DataFrame) -> DataFrame:
    """(m, a, b, bound, head, tail, rest, n): words with the same first a and last b characters (head, tail), as partners of
    pairs whose shorter word has m characters and whose common beginning is shorter than bound."""
    r = parts.withColumn("r", F.expr("m - a - b")).withColumn("h", F.expr("int(r div 2)"))
    return r.select("m", "n", F.expr(_HALVES)).filter("a < bound")


def partitions(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Every word in the partitions of all its possible near words, each of at most part_words words, or of two
    characters in the middle."""
    root = words.select(F.explode(F.expr("array(length(word), length(word) - 1)")).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit((1 << 31) - 1).alias("bound"), F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("rest"), "n")
    todo, done = materialize(_halved(root.filter(F.col("m") >= LEAST_LENGTH)), "halves"), []
    while True:
        sizes = materialize(todo.groupBy(*KEY).agg(F.count("*").alias("size")).filter(f"size > {part_words} and m - a - b >= 2"), "oversized")
        if sizes.isEmpty():
            return todo if not done else _union(done + [todo])
        over = small(sizes.select(*KEY))
        done.append(todo.join(over, KEY, "left_anti"))
        todo = materialize(_halved(todo.join(over, KEY, "left_semi")), "halves")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Acceptor:
    """A minimised acyclic acceptor of many word sets at once. A state is a number; arcs[state] holds (letter, next state,
    words before it), below[state] how many words it accepts. Equal states are one, whatever set they come from."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.arcs: list[list[tuple[str, int, int]]] = []
        self.below: list[int] = []
        self.final: list[bool] = []

    def state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.arcs)
            before, out = int(final), []
            for letter, to in arcs:
                out.append((letter, to, before))
                before += self.below[to]
            self.arcs.append(out)
            self.below.append(before)
            self.final.append(final)
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of a set of distinct words in code-point order: states are closed when no later word can reach them."""
        if not words:
            return self.state(False, [])
        open_: list[list] = [[False, []]]  # of the last word's path: final, arcs so far; the letter that leads on is last[i]
        last = ""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
                    shared += 1
            while len(open_) > shared + 1:
                final, arcs = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], self.state(final, arcs)))
            if word is not None:
                open_ += [[False, []] for _ in word[shared:]]
                open_[-1][0], last = True, word
        return self.state(*open_[0])


def _both(acc: Acceptor, u: int, v: int, iu: int, iv: int) -> Iterator[tuple[int, int]]:
    """Numbers of the words that both states accept, one for each tape."""
    stack = [(u, v, iu, iv)]
    while stack:
        u, v, iu, iv = stack.pop()
        if u == v:
            for k in range(acc.below[u]):
                yield iu + k, iv + k
            continue
        if acc.final[u] and acc.final[v]:
            yield iu, iv
        stack += [(x, y, iu + p, iv + q) for x, p, y, q in _matching(acc.arcs[u], acc.arcs[v])]


def _matching(left: list, right: list) -> list[tuple[int, int, int, int]]:
    """Arcs with the same letter: next states and words before them."""
    if len(left) == 1 == len(right):
        return [(left[0][1], left[0][2], right[0][1], right[0][2])] if left[0][0] == right[0][0] else []
    on = {c: (y, q) for c, y, q in right}
    return [(x, p, *on[c]) for c, x, p in left if c in on]


def replaced(acc: Acceptor, start: int, within: int) -> Iterator[tuple[int, int]]:
    """Pairs of words of one set that differ in one replaced letter, among their first `within` letters."""
    stack = [(start, 0, 0)]
    while stack:
        u, depth, at = stack.pop()
        arcs = acc.arcs[u]
        for i, (_, x, p) in enumerate(arcs):
            for _, y, q in arcs[i + 1 :]:
                yield from _both(acc, x, y, at + p, at + q)
        if depth + 1 < within:
            stack += [(x, depth + 1, at + p) for _, x, p in arcs]


def skipped(acc: Acceptor, longer: int, shorter: int, within: int) -> Iterator[tuple[int, int]]:
    """Pairs (longer word, shorter word) where the longer has one letter more; of a run of equal letters the last is the one
    that is skipped, so every pair comes once."""
    stack = [(longer, shorter, 0, 0, 0)]
    while stack:
        u, v, depth, iu, iv = stack.pop()
        for c, x, p in acc.arcs[u]:
            if acc.final[x] and acc.final[v]:
                yield iu + p, iv
            for letter, y, q in acc.arcs[v]:
                if letter != c:
                    for d, z, o in acc.arcs[x]:
                        if d == letter:
                            yield from _both(acc, z, y, iu + p + o, iv + q)
        if depth + 1 < within:
            stack += [(x, y, depth + 1, iu + p, iv + q) for x, p, y, q in _matching(acc.arcs[u], acc.arcs[v])]


def _near_in(parts: list[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """parts: (head, tail, a, bound, rests and n of the words of m characters, and of m + 1), rests in order."""
    acc = Acceptor()
    starts = [(acc.add([x[0] for x in short]), acc.add([x[0] for x in long])) for *_, short, long in parts]
    for (head, tail, a, bound, short, long), (s, t) in zip(parts, starts, strict=True):
        n_near: Counter = Counter()
        best: dict[tuple[int, int], tuple[int, str]] = {}
        sides = (short, long)

        def meet(one: tuple[int, int], other: tuple[int, int]) -> None:
            for x, y in ((one, other), (other, one)):
                n_near[x] += 1  # noqa: B023
                rest, n = sides[y[0]][y[1]]  # noqa: B023
                if x not in best or (-n, rest) < best[x]:  # noqa: B023
                    best[x] = (-n, rest)  # noqa: B023

        for i, j in replaced(acc, s, bound - a):
            meet((0, i), (0, j))
        for i, j in skipped(acc, t, s, bound - a):
            meet((1, i), (0, j))
        for (side, i), k in n_near.items():
            n, rest = best[side, i]
            yield f"{head}{sides[side][i][0]}{tail}", k, -n, f"{head}{rest}{tail}"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their partition and rest; partitions are gathered until they fill an acceptor."""
    parts: list[tuple] = []
    now, short, long, words, chars = None, [], [], 0, 0

    def close() -> None:
        if now is not None and short and len(short) + len(long) > 1:
            parts.append((now[4], now[5], now[1], now[3], short, long))

    def out() -> pa.RecordBatch:
        found = list(_near_in(parts))
        parts.clear()
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
        return pa.RecordBatch.from_pydict({k: pa.array(list(c), kind) for c, (k, kind) in zip(columns, kinds.items(), strict=True)})

    for b in batches:
        for m, a, e, bound, head, tail, rest, n in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            key = (m, a, e, bound, head, tail)
            if key != now:
                close()
                if words > TASK_WORDS or chars > TASK_CHARS:
                    yield out()
                    words = chars = 0
                now, short, long = key, [], []
            (short if len(rest) == m - a - e else long).append((rest, n))
            words, chars = words + 1, chars + len(rest)
    close()
    yield out()


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """word, n_near, best_n, best (the near word of largest n, ties to the smallest) for words that have a near word."""
    parts = partitions(words, part_words)
    parts = parts.repartition(*KEY).sortWithinPartitions(*KEY, "rest").select(*KEY, "rest", "n")
    found = parts.mapInArrow(_near, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. Every round looks up the root's root, so chains halve; a form
    is RATIO times as frequent as its word, so they are short and have no cycle."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = materialize(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT, part_words: int = PART_WORDS) -> DataFrame:
    """word, n, form, root, n_near, form_n for every word of docs (doc_id, text)."""
    words = materialize(vocabulary(docs, least_count), "words")
    near = near_words(words, part_words)
    known = words.join(near, "word", "left").withColumn("takes", F.col("best_n") >= RATIO * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("takes"), F.col("best")).alias("form"), F.when(F.col("takes"), F.col("best_n")).alias("form_n"))
    known = materialize(known, "known")
    return known.join(roots(known.filter("form is not null")), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
