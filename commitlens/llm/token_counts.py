"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole, so that its tokens are those a model sees; the lengths of the tokens' bytes give
every token's span. The sections' spans (lines, each with its line end) are joined to the tokens' spans as intervals,
and a token that lies across a boundary goes by an explicit rule: to the section of its first byte ("start"), of its
last byte ("end"), or of most of its bytes ("most", ties to the earlier). Sections partition the text, so the counts of
a document's sections add up to its tokens, whichever the rule.

Defined results: null and empty texts have one empty section without tokens; a text that ends with a line end has no
section after it; repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's own splitting pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROW = "array<struct<section:int,start:int,end:int,n_tokens:int,n_crossing:int>>"


def load(path: str = VOCABULARY) -> bytes:
    """The vocabulary file as it is: read on the driver and sent to the tasks, whose nodes need not have it."""
    with open(path, "rb") as f:
        return f.read()


def ranks(vocabulary: str | bytes = VOCABULARY) -> dict[bytes, int]:
    """Tokens and their ranks, from a vocabulary file's path or its bytes."""
    data = vocabulary if isinstance(vocabulary, bytes) else load(vocabulary)
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


@lru_cache(2)
def _encoding(vocabulary: str | bytes):
    import tiktoken

    r = ranks(vocabulary)
    sizes = np.zeros(max(r.values()) + 1, np.int64)
    for k, v in r.items():
        sizes[v] = len(k)
    return tiktoken.Encoding("sections", pat_str=PATTERN, mergeable_ranks=r, special_tokens={}), sizes


def section_counts(text: str | None, vocabulary: str | bytes = VOCABULARY, rule: str = "start") -> list[tuple[int, int, int, int, int]]:
    """(section, start, end in characters, n_tokens, n_crossing) of each line; n_crossing: tokens of it that reach into another."""
    encoding, sizes = _encoding(vocabulary)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return [(0, 0, 0, 0, 0)]
    ends = np.cumsum(sizes[np.array(encoding.encode_ordinary(text), np.int64)])
    starts = np.concatenate(([0], ends[:-1]))
    cuts = np.flatnonzero(data == 10) + 1
    bounds = np.concatenate(([0], cuts[cuts < len(data)], [len(data)]))  # of the sections, in bytes
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    to = {"start": first, "end": last}.get(rule)
    if to is None:
        to = first.copy()
        for i in np.flatnonzero(first != last):
            cut = np.diff(np.concatenate(([starts[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]])))
            to[i] += int(np.argmax(cut))
    k = len(bounds) - 1
    n, crossing = np.bincount(to, minlength=k), np.bincount(to[first != last], minlength=k)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[bounds]
    return list(zip(range(k), chars[:-1].tolist(), chars[1:].tolist(), n.tolist(), crossing.tolist(), strict=True))


def _count(vocabulary: bytes, rule: str):
    names = ("section", "start", "end", "n_tokens", "n_crossing")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in section_counts(t, vocabulary, rule)] for t in b])

    return F.pandas_udf(run, ROW)


def token_counts(docs: DataFrame, path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """doc_id, section, start, end (characters of the text), n_tokens, n_crossing for every line of every row of docs."""
    return docs.select("doc_id", _count(load(path), rule)(F.col("text")).alias("sections")).select("doc_id", F.inline("sections"))
