"""Line dedup by winnowing over line hashes.

At every line starts a window: the least run of lines with WORDS words or more. It selects the line in it with the least
hash, the last of equals; neighbouring windows mostly select the same one, so few lines are selected. Selected lines are
joined on their line hash; those that occur once go. The windows that selected a line that occurs again are then compared
by their own hash, and a place is matched with the first place of the same window in the order of (doc_id, line); a match
is extended line by line both ways, and the lines of the later run are deleted.

Guarantee: two places that share a run of whole lines with WORDS words share a window, both windows select the same line
of it, and so the later place is matched. Each deleted line has an equal earlier one, so the first of all stays.

The first place of a window is a minimum, combined before the shuffle; a line or passage of a third of all documents is
one row there, and is broadcast to its places.

Defined results: null text is one empty line and stays null; texts under WORDS words never change; rows that repeat
both doc_id and text count as one document and are treated alike; null doc_id comes first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import discard, hot_join, materialize, small

WORDS = 50
WINDOW = "struct<lines:array<long>,selected:array<struct<print:long,windows:array<struct<whole:long,first:int,last:int>>>>>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_windows(text: str | None, least: int = WORDS) -> tuple[list[int], list[tuple[int, list[tuple[int, int, int]]]]]:
    """Hashes of the lines; the selected lines (line hash, the windows that select it: window hash, first line, last line)."""
    lines = (text or "").split("\n")
    h = [_signed(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))) for s in lines]
    n = [len(s.split()) for s in lines]
    raw = [x.to_bytes(8, "big", signed=True) for x in h]
    out, falling, at, j, held = [], deque(), -1, 0, 0  # falling: places of rising hashes, the least first
    for i in range(len(lines)):
        while j < len(lines) and held < least:
            while falling and h[falling[-1]] >= h[j]:
                falling.pop()
            falling.append(j)
            held += n[j]
            j += 1
        if held < least:
            break
        if falling[0] < i:
            falling.popleft()
        if falling[0] != at:
            at = falling[0]
            out.append((h[at], []))
        out[-1][1].append((_signed(xxhash.xxh64_intdigest(b"".join(raw[i:j]))), i, j - 1))
        held -= n[i]
    return h, out


def _windows(least: int):
    names = ("whole", "first", "last")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [line_windows(t, least) for t in b]
            chosen = [[{"print": p, "windows": [dict(zip(names, w, strict=True)) for w in ws]} for p, ws in picks] for _, picks in made]
            yield pd.DataFrame({"lines": [h for h, _ in made], "selected": chosen})

    return F.pandas_udf(run, WINDOW)


def _extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The whole runs around matched windows: lines k of one text equal to k - shift of the other."""
    for b in batches:
        out = []
        for key, h, shift, places, mine, other in zip(b["doc_id"], b["h"], b["shift"], b["places"], b["lines"], b["other_lines"], strict=True):
            upto = -1
            for p in sorted(places, key=lambda p: p["first"]):
                lo, hi = int(p["first"]), int(p["last"])
                if hi <= upto:
                    continue
                while lo > 0 and lo - 1 - shift >= 0 and mine[lo - 1] == other[lo - 1 - shift]:
                    lo -= 1
                while hi + 1 < len(mine) and hi + 1 - shift < len(other) and mine[hi + 1] == other[hi + 1 - shift]:
                    hi += 1
                upto = hi
                out.append((key, h, lo, hi))
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "h", "lo", "hi"])


def _key() -> Column:
    """Sorts by doc_id, then tells texts of one doc_id apart."""
    return F.struct("doc_id", F.xxhash64("text").alias("h"))


def repeated_runs(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """doc_id, h (hash of the text), runs: array of (lo, hi), the lines to delete, for texts that have any."""
    made = docs.select(_key().alias("key"), _windows(least)(F.col("text")).alias("w")).select("key", "w.lines", "w.selected")
    made = materialize(made.filter(F.size("selected") > 0).dropDuplicates(["key"]), "windows")
    selected = made.select("key", F.inline("selected"))
    often = materialize(selected.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    places = materialize(hot_join(selected, often, "print", "n").filter("n is not null").select("key", F.inline("windows")), "places")
    first = places.groupBy("whole").agg(F.min(F.struct("key", "first")).alias("at"), F.count("*").alias("n")).filter("n > 1")
    later = hot_join(places, materialize(first, "first"), "whole", "n").filter(F.struct("key", "first") != F.col("at"))
    later = later.select("key", F.col("at.key").alias("other"), (F.col("first") - F.col("at.first")).alias("shift"), "first", "last")
    later = later.groupBy("key", "other", "shift").agg(F.collect_list(F.struct("first", "last")).alias("places"))
    lines = made.select("key", "lines")
    both = later.join(lines, "key").join(lines.select(F.col("key").alias("other"), F.col("lines").alias("other_lines")), "other")
    both = both.select(F.col("key.doc_id").cast("string").alias("doc_id"), F.col("key.h").alias("h"), "shift", "places", "lines", "other_lines")
    runs = both.mapInPandas(_extend, "doc_id string, h long, lo int, hi int")
    return runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def line_dedup(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """doc_id, text without its repeated runs, n_lines, n_deleted for every row of docs (doc_id, text)."""
    runs = small(materialize(repeated_runs(docs, least), "runs"), 200_000)
    joined = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(
        runs.select(F.col("doc_id").alias("id"), "h", "runs"), (F.col("doc_id").cast("string").eqNullSafe(F.col("id"))) & (F.col("hash") == F.col("h")), "left"
    )
    lines = joined.select("doc_id", "text", "runs", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    kept = F.when(F.col("runs").isNull(), F.col("l")).otherwise(F.expr("filter(l, (x, i) -> not exists(runs, r -> i between r.lo and r.hi))"))
    lines = lines.withColumn("kept", kept)
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return lines.select("doc_id", text.alias("text"), F.size("l").alias("n_lines"), (F.size("l") - F.size("kept")).alias("n_deleted"))
