"""N-gram Jaccard join: documents link when their sets of word 5-grams have a Jaccard similarity of 0.8 or more.

1. One pass over the texts makes each document's set, as sorted 64-bit hashes, and its class: documents with one and
   the same set. From there on a class is represented once, however many copies it has.
2. Prefix filter. In the order of the hashes, two sets that link share at least k elements of their prefixes of
   n - ceil(0.8 n) + k elements. Chunks of documents send those elements, packed, to hash buckets, an element held by
   many documents of a chunk being sent once; the counts of shared elements come back, and sets with too few go. It is
   a bound, so no link is lost.
3. The remaining sets are ordered globally, rarest element first. A set's prefix in that order names its leaders (the
   least set with the element). Sets that link share a prefix element and so a leader: the sets of one leader are a
   group. Nothing is closed over: a group holds only sets that share a prefix element with its leader.
4. Prefix-tree join in each group: the ordered sets form a trie, which all sets of the group go through together, from
   node to node with the overlaps so far, which all sets below a node share; a set leaves a subtree when the lengths that
   remain cannot reach the overlap needed. A pair is told in the group of its least common leader only. Groups too large
   for one task are dealt into parts, and each pair of parts is a task: no set is dropped. Every link is found, by exact
   counts over whole sets, and counted at both its sets where it is found; what leaves a task is a row for each set with
   its number of links and the least set that links connect it with there, never the pairs themselves. A family of m near
   copies with different texts costs m*m/2 comparisons, shared in the trie; exact copies are one set.

Defined results: null or blank text has an empty set, links with nothing and is its own component; fewer than five
words make one shingle of the whole; repeated rows of a doc_id are one document per distinct set; a null doc_id stays
null and sorts first, as would -2**63; a doc_id that is no whole number is compared as it is, rows being numbered instead;
an empty table gives an empty result; other columns are ignored. Sets are compared through 64-bit
hashes: two different shingles fall together with probability 2**-64 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import connected_components, discard, hot_join, materialize, numbered, small

N, PERCENT = 5, 80
NO_ID = -(1 << 63)
CHUNK_CHARS, BUCKET_ENTRIES = 2_000_000, 1_000_000
#: A group of more sets or elements is dealt into parts; small groups share a task up to so many.
PART_SETS, TASK_SETS, TASK_ELEMENTS = 800, 500, 1_000_000
#: Cells of the table of which sets hold which elements, in a task.
CELLS = 32 << 20
_M1, _M2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(31)


def shingle_sets(texts, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """For a list of texts: all distinct (text, shingle hash) pairs, sorted, as two arrays (text number, hash)."""
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    w = np.fromiter((digest(x) for ws in words for x in ws), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    last = ends[owner] - 1 if len(w) else np.empty(0, np.int64)
    at, short = np.arange(len(w)), sizes[owner] < n
    starts = np.where(short, at == ends[owner] - sizes[owner], at + n - 1 <= last)
    i = np.flatnonzero(starts)
    h = w[i]
    for k in range(1, n):
        inside = i + k <= last[i]
        mixed = ((h ^ (h >> _S)) * _M1) + w[np.minimum(i + k, len(w) - 1)] * _M2
        h = np.where(inside, mixed, h)
    h = (h ^ (h >> _S)) * _M2
    h ^= h >> _S
    doc = owner[i]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n elements with any set that it links with."""
    return -(-n * PERCENT // 100)


def shared_prefix(n: np.ndarray) -> np.ndarray:
    """k of the prefix filter."""
    return np.maximum(1, n // 10)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of about CHUNK_CHARS characters, so that a worker's memory does not follow the batch."""
    for b in batches:
        cell = np.cumsum(b["text"].str.len().fillna(0).to_numpy(dtype=np.int64)) // CHUNK_CHARS
        cuts = np.flatnonzero(np.diff(cell)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            if hi > lo:
                yield b.iloc[lo:hi]


def _prefix_entries(bits: int):
    """Makes each chunk's row of documents (bucket -1) and its rows of prefix elements, one a bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for k, b in enumerate(_chunks(batches)):
            doc, h = shingle_sets(b["text"].tolist())
            n = np.bincount(doc, minlength=len(b))
            first = np.cumsum(n) - n
            sigs = [xxhash.xxh128_digest(h[s : s + m].tobytes()) if m else b"" for s, m in zip(first, n, strict=True)]
            keep = (np.arange(len(h)) - first[doc]) < (n - needed(n) + shared_prefix(n))[doc]
            pd_, ph = doc[keep], h[keep]
            order = np.argsort(ph, kind="stable")
            pd_, ph = pd_[order], ph[order]
            edge = np.flatnonzero(np.concatenate(([True], ph[1:] != ph[:-1]))) if len(ph) else np.empty(0, np.int64)
            run_len = np.diff(np.append(edge, len(ph)))
            local = np.bincount(pd_[np.repeat(run_len > 1, run_len)], minlength=len(b)) if len(ph) else np.zeros(len(b), np.int64)
            who = np.where(run_len > 1, -1, pd_[edge]).astype(np.int32)  # -1: known to be shared, sent for the others
            uh = ph[edge]
            out = [{"chunk": base + k, "bucket": -1, "keys": b["key"].to_numpy().tolist(), "ns": n.tolist(), "sigs": sigs, "local": local.astype(np.int32).tobytes(), "who": b"", "hash": b""}]
            bucket = (uh >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(uh), np.int64)
            cut = np.flatnonzero(np.diff(bucket)) + 1
            rest = (uh << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5]
            for lo, hi in zip([0, *cut], [*cut, len(uh)], strict=True):
                if hi > lo:
                    out.append({"chunk": base + k, "bucket": int(bucket[lo]), "keys": [], "ns": [], "sigs": [], "local": b"", "who": who[lo:hi].tobytes(), "hash": rest[lo:hi].tobytes()})
            yield pd.DataFrame(out)

    return run


def _shared_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, how many of its documents' elements in this bucket another chunk has too."""
    sizes = [len(w) // 4 for w in rows["who"]]
    h = np.zeros((sum(sizes), 8), np.uint8)
    h[:, 3:] = np.frombuffer(b"".join(rows["hash"]), np.uint8).reshape(-1, 5)
    h = h.reshape(-1).view(">u8").astype(np.uint64)
    who = np.frombuffer(b"".join(rows["who"]), np.int32)
    src = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(h, kind="stable")
    hs = h[order]
    edge = np.concatenate(([True], hs[1:] != hs[:-1]))
    many = np.diff(np.append(np.flatnonzero(edge), len(hs)))[np.cumsum(edge) - 1] > 1
    hit = order[many]
    hit = hit[who[hit] >= 0]
    out = []
    for s in np.unique(src[hit]):
        out.append((rows["chunk"].iloc[s], np.bincount(who[hit[src[hit] == s]]).astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "local"])


def _surviving(rows: pd.DataFrame) -> pd.DataFrame:
    docs = rows[rows["bucket"] == -1]
    if docs.empty:
        return pd.DataFrame({"key": [], "sig": [], "n": []})
    docs = docs.iloc[0]
    n = np.array(docs["ns"], np.int64)
    count = np.zeros(len(n), np.int64)
    for b in rows["local"]:
        x = np.frombuffer(b, np.int32)
        count[: len(x)] += x
    ok = (n > 0) & (count >= shared_prefix(needed(n)))
    return pd.DataFrame({"key": np.array(docs["keys"], np.int64)[ok], "sig": [s for s, k in zip(docs["sigs"], ok, strict=True) if k], "n": n[ok]})


def _whole_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _chunks(batches):
        doc, h = shingle_sets(b["text"].tolist())
        n = np.bincount(doc, minlength=len(b))
        parts = np.split(h, np.cumsum(n)[:-1])
        yield pd.DataFrame({"key": b["key"].to_numpy(), "sig": [xxhash.xxh128_digest(p.tobytes()) if len(p) else b"" for p in parts], "n": n, "elements": [p.view(np.int64) for p in parts]})


class Trie:
    """A radix trie over sets given as ascending arrays of ranks; sets holds them in lexicographic order."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.order, self.sets, self.sizes = np.array(order), [sets[i] for i in order], sizes[order]
        # node: [depth where its tokens start, where they end, first set, last set + 1, children, sets that end here]
        self.root = [0, 0, 0, len(order), [], []]
        stack, before = [self.root], np.empty(0, np.uint32)
        for i, s in enumerate(self.sets):
            m = min(len(before), len(s))
            same = before[:m] == s[:m]
            lcp = m if same.all() else int(np.argmin(same))
            while stack[-1][1] > lcp:
                node = stack.pop()
                node[3] = i
                if stack[-1][1] < lcp:  # split the edge: a new parent ends at lcp
                    mid = [node[0], lcp, node[2], i, [node], []]
                    node[0] = lcp
                    stack[-1][4][-1] = mid
                    stack.append(mid)
            if len(s) > lcp:
                leaf = [lcp, len(s), i, len(order), [], [i]]
                stack[-1][4].append(leaf)
                stack.append(leaf)
            else:
                stack[-1][5].append(i)
            before = s
        for node in stack:
            node[3] = len(order)

    def links(self, queries: list[np.ndarray], sizes: np.ndarray, n_elements: int) -> Iterator[tuple[np.ndarray, int]]:
        """(queries, set): the numbers of the queries that link with the set, for each set that any links with."""
        lens = np.array([len(s) for s in self.sets])
        start = np.cumsum([0] + [len(q) for q in queries])
        flat = np.concatenate(queries).astype(np.int64) + np.repeat(np.arange(len(queries)), np.diff(start)) * n_elements
        member = np.zeros((n_elements, len(queries)), bool)
        member[flat % n_elements, flat // n_elements] = True
        least_need = needed(sizes)
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
        while todo:
            node, q, overlap = todo.pop()
            lo, hi = node[2], node[3]
            if node[1] > node[0]:
                path = self.sets[lo][node[0] : node[1]]
                overlap = overlap + member[path][:, q].sum(0)
                rest = start[q + 1] - np.searchsorted(flat, q * n_elements + int(path[-1]), "right")
            else:
                rest = np.diff(start)[q]
            least = int(self.sizes[lo:hi].min())
            reach = overlap + np.minimum(rest, int(lens[lo:hi].max()) - node[1])
            stay = 9 * reach >= 4 * (sizes[q] + np.maximum(least, least_need[q]))
            q, overlap = q[stay], overlap[stay]
            if not len(q):
                continue
            for i in node[5]:
                hit = q[100 * overlap >= PERCENT * (sizes[q] + int(self.sizes[i]) - overlap)]
                if len(hit):
                    yield hit, i
            todo.extend((c, q, overlap) for c in node[4])


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, queries: np.ndarray | None = None, indexed: np.ndarray | None = None) -> np.ndarray:
    """All links (i, j) as an array [links, 2]: of the sets of queries with those of indexed, or of all with all, once each."""
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values), dtype=np.uint32)
    sets = [np.sort(x) for x in np.split(rank[at], np.cumsum([len(s) for s in sets])[:-1])]
    both = queries is None
    queries = np.arange(len(sets)) if both else queries
    indexed = np.arange(len(sets)) if both else indexed
    trie = Trie([sets[i] for i in indexed], sizes[indexed])
    place, out, step = indexed[trie.order], [np.empty((0, 2), np.int64)], max(1, CELLS // max(1, len(values)))
    for lo in range(0, len(queries), step):
        part = queries[lo : lo + step]
        for hit, i in trie.links([sets[k] for k in part], sizes[part], len(values)):
            a = part[hit]
            a = a[a < place[i]] if both else a
            out.append(np.stack([a, np.full(len(a), place[i])], 1))
    return np.concatenate(out)


def _connected(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least number that pairs connect each of n numbers with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], label[pairs[:, 0]])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _join_groups(rows: pd.DataFrame) -> pd.DataFrame:
    """The links inside each leader's group of a task, told where the leader is the least that both sets have: for each
    set with links a row of its class, the class that stands for what they connect, and the rows it links with."""
    got = []
    for leader, g in rows.groupby("leader", sort=False):
        if len(g) < 2:
            continue
        side, cid, leaders, weight = (g[c].to_numpy() for c in ("side", "cid", "leaders", "n_rows"))
        two = (side == 1).any()
        if two and (side == 1).all():
            continue
        sets = [np.asarray(e, np.int64) for e in g["elements"]]
        found = trie_links(sets, g["n"].to_numpy(np.int64), *((np.flatnonzero(side == 1), np.flatnonzero(side == 0)) if two else ()))
        first = np.array([x[0] == leader for x in leaders])  # no lesser leader to share
        keep = first[found[:, 0]] | first[found[:, 1]]
        for k in np.flatnonzero(~keep):
            keep[k] = min(set(leaders[found[k, 0]]) & set(leaders[found[k, 1]])) == leader
        found = found[keep]
        near = np.bincount(found[:, 0], weight[found[:, 1]], len(g)) + np.bincount(found[:, 1], weight[found[:, 0]], len(g))
        at = np.flatnonzero(near)
        got.append(pd.DataFrame({"a": cid[at], "b": cid[_connected(found, len(g))[at]], "near": near[at].astype(np.int64)}))
    return pd.concat(got) if got else pd.DataFrame({"a": [], "b": [], "near": []}, dtype=np.int64)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members (key, n, sig: the digest of its set), classes (cid, sig, key: the least of its members, n, n_rows) of the sets
    that are not empty, and links (a, b, near): in some task, class a is connected with b and links with `near` rows."""
    texts = docs.select(_key(), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(0, math.ceil(math.log2(max(1, size / 20 / BUCKET_ENTRIES)))) + 2)
    made = texts.mapInPandas(_prefix_entries(bits), "chunk long, bucket int, keys array<long>, ns array<int>, sigs array<binary>, local binary, who binary, hash binary")
    made = materialize(made, "prefixes")
    members = made.filter("bucket = -1").select(F.inline(F.arrays_zip("keys", "ns", "sigs"))).toDF("key", "n", "sig")
    classes = members.filter("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.count("*").alias("n_rows"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    shared = made.filter("bucket >= 0").select("chunk", "bucket", "who", "hash").groupBy("bucket").applyInPandas(_shared_in_bucket, "chunk long, local binary")
    counted = made.filter("bucket = -1").select("chunk", "bucket", "keys", "ns", "sigs", "local").unionByName(shared.withColumn("bucket", F.lit(0)), allowMissingColumns=True)
    alive = counted.groupBy("chunk").applyInPandas(_surviving, "key long, sig binary, n int")
    alive = small(materialize(alive.join(classes, ["key", "sig"]).select("key", "sig", "cid", "n_rows").distinct(), "alive"))
    sets = texts.join(alive.select("key").distinct(), "key", "left_semi").mapInPandas(_whole_sets, "key long, sig binary, n int, elements array<long>")
    sets = materialize(sets.join(alive, ["key", "sig"]).select("cid", "n", "n_rows", "elements"), "sets")
    links = _links(sets)
    members = materialize(members, "members")
    discard(made, alive, sets)
    return members, classes, links


def _links(sets: DataFrame) -> DataFrame:
    each = sets.select("cid", "n", "n_rows", F.explode("elements").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = each.join(often, "e").groupBy("cid", "n", "n_rows").agg(F.array_sort(F.collect_set(F.struct("df", "e"))).alias("o"))
    need = F.expr(f"(n * {PERCENT} + 99) div 100")
    ordered = ordered.filter(F.size("o") >= need).select("cid", "n", "n_rows", F.col("o.e").alias("elements"), (F.size("o") - need + 1).cast("int").alias("prefix"))
    ordered = materialize(ordered, "ordered")
    prefix = materialize(ordered.select("cid", F.size("elements").alias("len"), F.explode(F.expr("slice(elements, 1, prefix)")).alias("e")), "prefix")
    leaders = materialize(prefix.groupBy("e").agg(F.min("cid").alias("leader"), F.count("*").alias("df")).filter("df > 1"), "leaders")
    led = hot_join(prefix, leaders, "e", "df").filter("leader is not null").groupBy("cid").agg(F.array_sort(F.collect_set("leader")).alias("leaders"), F.first("len").alias("len"))
    led = materialize(led, "led")
    groups = led.select(F.explode("leaders").alias("leader"), "len").groupBy("leader").agg(F.count("*").alias("n_sets"), F.sum("len").alias("n_elements")).filter("n_sets > 1")
    groups = groups.withColumn("parts", F.ceil(F.greatest(F.col("n_sets") / PART_SETS, F.col("n_elements") / TASK_ELEMENTS)).cast("int"))
    groups = materialize(groups, "groups")
    held = groups.filter("parts = 1").agg(F.sum("n_elements").alias("elements"), F.sum("n_sets").alias("sets")).first()
    tasks = 1 + max((held["elements"] or 0) // TASK_ELEMENTS, (held["sets"] or 0) // TASK_SETS)
    placed = materialize(led.select("cid", "leaders", F.explode("leaders").alias("leader")), "placed")
    placed = hot_join(placed, groups, "leader", "n_sets").filter("parts is not null")
    placed = placed.withColumn("part", F.expr("cast(pmod(xxhash64(cid), parts) as int)")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    task = F.when(F.col("parts") > 1, F.col("leader")).otherwise(-1 - F.pmod(F.xxhash64("leader"), F.lit(tasks)))
    placed = placed.select("leader", "leaders", task.alias("task"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.expr("if(part > other, 1, 0)").alias("side"), "cid")
    links = placed.join(ordered.drop("prefix"), "cid").groupBy("task", "i", "j").applyInPandas(_join_groups, "a long, b long, near long")
    links = materialize(links, "links")
    discard(ordered, prefix, leaders, led, groups)
    return links


def _components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """cid, sig, key, n_rows, label (the least cid of the component; its own if it has no links), least (the smallest key
    in the component), n_links (documents that its documents link with, equal sets included)."""
    label = connected_components(links.filter("a <> b")).select(F.col("node").alias("cid"), "label")
    own = materialize(classes.join(label, "cid"), "labelled")
    least = materialize(own.groupBy("label").agg(F.min("key").alias("least"), F.count("*").alias("many")), "least")
    near = links.groupBy(F.col("a").alias("cid")).agg(F.sum("near").alias("near"))
    linked = hot_join(own.select("cid", "label"), least, "label", "many").select("cid", "label", "least").join(near, "cid")
    out = classes.join(linked, "cid", "left")
    return out.select("cid", "sig", "key", "n_rows", F.coalesce("label", "cid").alias("label"), F.coalesce("least", "key").alias("least"), (F.coalesce("near", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"))


def ngram_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (the other rows that it links with)
    for every row of docs (doc_id, text)."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = docs if whole else numbered(docs).select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"), F.col("doc.doc_id").alias("id"))
    members, classes, links = classes_and_links(rows)
    found = materialize(_components(classes, links), "components")
    out = hot_join(members, found.select("sig", "cid", "label", "least", "n_links", "n_rows"), "sig", "n_rows")
    n, many = F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    if whole:
        key = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType)
        return out.select(key("key").alias("doc_id"), n, F.when(F.col("least").isNull(), key("key")).otherwise(key("least")).alias("component_id"), many)
    named = materialize(out.join(rows.select(F.col("doc_id").alias("key"), "id"), "key"), "named")
    least = materialize(named.filter("label is not null").groupBy("label").agg(F.min("id").alias("first"), F.count("*").alias("many")), "least")
    linked = hot_join(named.filter("label is not null"), least, "label", "many").select(F.col("id").alias("doc_id"), n, F.coalesce("first", "id").alias("component_id"), many)
    return linked.unionByName(named.filter("label is null").select(F.col("id").alias("doc_id"), n, F.col("id").alias("component_id"), many))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows that stay when one of each component does: of those with the smallest doc_id (null first) the one with
    the smallest digest of its text. Rows of one doc_id, or of none, with different sets belong each to its own
    component; of empty sets one row stays for each doc_id. Columns of docs."""
    rows = numbered(docs)
    members, classes, links = classes_and_links(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")))
    label = connected_components(links.filter("a <> b")).select(F.col("node").alias("cid"), "label")
    named = materialize(classes.join(label, "cid", "left").select("sig", F.coalesce("label", "cid").alias("group"), "n_rows"), "named")
    group = hot_join(members.select("key", "sig"), named, "sig", "n_rows").select(F.col("key").alias("row"), "group")
    placed = rows.select("row", F.col("doc.doc_id").alias("id"), F.md5(F.coalesce(F.col("doc.text"), F.lit(""))).alias("digest")).join(group, "row")
    alone = F.when(F.col("group").isNull(), F.struct("id"))
    stay = placed.groupBy("group", alone.alias("alone")).agg(F.min(F.struct("id", "digest", "row")).alias("least")).select("least.row")
    return rows.join(stay, "row", "left_semi").select("doc.*")
