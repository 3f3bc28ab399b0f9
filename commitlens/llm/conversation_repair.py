"""Conversation structure repair: the cheapest edits that give a legal order of roles, ties to the least audit.

A legal conversation is empty, or perhaps a system turn and then user and assistant in turn, the assistant last. An
automaton of four states (START, after system, after user, after assistant) reads a conversation's rows; a node is a row
and a state, an arc an edit: Delete and Keep and Rerole lead to the next row, Insert stays before it. The cost DP runs
backwards and leaves at every node the cost to the end; arcs that lie on a cheapest path are optimal. Nodes are then
ranked by their least audits of 1, 2, 4 ... letters: the rank over 2n letters is that of (own rank, rank of the node
n arcs on), and pointers double with the ranks until all have reached an end. The ranks choose each node's arc, and the
doubled pointers give the node after any number of arcs, so a whole path is read at once.

Conversations of any length are dealt out: all rows are put in order by one range shuffle and cut into chunks of at most
CHUNK_ROWS. A conversation of one chunk is solved by itself, many at a time. Of a longer one each chunk becomes a 4 x 4
matrix of costs between its states; the matrices are multiplied from the end (min, +), so that every chunk knows the cost
to the end from its exit; each chunk then solves its four entries and the entries are followed from the start. What meets
in one task there is 20 numbers for a chunk; as an audit is one value of less than 2^31 letters, that is at most 2^31 /
CHUNK_ROWS chunks. SHA-256 is sequential by nature: rows of a conversation are streamed in order past one running hash.

Defined results: null conv_id, turn, role and text count as one space (a null conv_id is one conversation of its own);
rows of the same turn go by role, then by the MD5 of role and text, so equal rows are neighbours; null turns come first
and do not count in gaps; repeated rows are duplicates; a role of another initial can only be reroled or deleted; a
conversation without rows has zeros, an empty audit and the hash of the empty text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import WHITE_SPACE, materialize

#: Rows of a chunk, and of the chunks solved at once, as powers of two.
CHUNK_BITS, TOGETHER_BITS = 12, 16
#: Fixed values of the contract: costs of Delete, Insert, Rerole, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BIG = 1 << 60
LETTERS = "DIKR"  # in ASCII order
#: States: START, after system, after user, after assistant. What an inserted or reroled turn leads to, and the keeps.
TURN = np.array([2, 2, 3, 2])
KEEPS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, initial s u a other) -> state
#: Cost to the end after the last row.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: A row's code is 3 * initial + fault (0 none, 1 to be deleted, 2 truncated), written as a letter from A.
CODES = "ABCDEFGHIJKL"
FAULT = np.arange(12) % 3
KEEP_TO = np.array([[KEEPS.get((q, c // 3), 0) for q in range(4)] for c in range(12)])
KEEP_COST = np.array([[(TRUNCATED if c % 3 == 2 else 0) if (q, c // 3) in KEEPS and c % 3 != 1 else BIG for q in range(4)] for c in range(12)])
REROLE_COST = np.where(FAULT == 1, BIG, REROLE + np.where(FAULT == 2, TRUNCATED, 0))
LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the contract's damage."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), h.alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    """key, turn, role, text without nulls in role and text, and digest of both."""
    rows = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))


def _in_order() -> list[Column]:
    return [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def flagged_rows(rows: DataFrame) -> DataFrame:
    """key, turn, pos (rising in each conversation's order), initial (0-3), fault (none, blank, duplicate, truncated), a row each."""
    last = F.substring(F.rtrim("text", F.lit(WHITE_SPACE)), -1, 1)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("i")), F.lit(0)) - 1, F.lit(3))
    small = rows.select("key", "turn", "role", "digest", F.substring("role", 1, 1).alias("i"), last.alias("last"))
    small = small.withColumn("initial", F.when(F.col("i") == "", 3).otherwise(initial)).withColumn("blank", F.col("last") == "").withColumn("open", ~F.col("last").isin(".", "!", "?"))
    small = small.select("key", "turn", "role", "digest", "initial", "blank", "open").repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
    small = materialize(small.withColumn("pos", F.monotonically_increasing_id()).drop("role"), "turns")
    first = small.filter("not blank").groupBy("key", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("none")
    return small.join(first, "pos", "left").select("key", "turn", "pos", "initial", fault.alias("fault"))


def _costs(codes: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first (number of each chunk's first node, of 4 states each) and the cost to the end at every node; ends: the costs
    at each chunk's exit."""
    sizes = np.array([len(c) for c in codes])
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    togo = np.empty((int((sizes + 1).sum()), 4), np.int64)
    togo[first + sizes] = ends
    flat = np.concatenate([np.append(c, 0) for c in codes])
    by = np.argsort(-sizes, kind="stable")
    for back in range(1, int(sizes.max(initial=0)) + 1):
        here = by[: np.searchsorted(-sizes[by], -back, "right")]
        at = first[here] + sizes[here] - back
        code, on = flat[at], togo[at + 1]
        base = np.minimum(DELETE + on, KEEP_COST[code] + np.take_along_axis(on, KEEP_TO[code], 1))
        base = np.minimum(base, REROLE_COST[code][:, None] + on[:, TURN])
        togo[at] = np.minimum(base, np.minimum(INSERT + base[:, TURN], 2 * INSERT + base[:, TURN[TURN]]))
    return first, np.minimum(togo, BIG)


def _ranked_paths(codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """first, cost to the end, chosen letter (0 at an end) and doubled pointers of all nodes, and each node's number of letters."""
    first, togo = _costs(codes, ends)
    flat, sizes = np.concatenate([np.append(c, 0) for c in codes]), np.array([len(c) for c in codes])
    n, at_exit = len(flat), np.zeros(len(flat), bool)
    at_exit[first + sizes] = True
    trailing = np.zeros(n, bool)
    trailing[(first + sizes)[last]] = True
    row, own = np.arange(n)[:, None], np.arange(4)[None, :]
    on = np.minimum(row + 1, n - 1)
    big = np.where(at_exit, BIG, 0)[:, None]
    to = [on * 4 + own, row * 4 + TURN[None, :], on * 4 + KEEP_TO[flat], on * 4 + TURN[None, :]]
    price = [DELETE + big, np.where(at_exit & ~trailing, BIG, INSERT)[:, None], KEEP_COST[flat] + big, REROLE_COST[flat][:, None] + big]
    cost, flow = togo.reshape(-1), togo
    best = [(price[k] < BIG) & (np.minimum(price[k], BIG) + cost[to[k]] == flow) & (flow < BIG) for k in range(4)]
    ended = at_exit[:, None] & (~trailing[:, None] | (own == 0) | (own == 3)) | (flow >= BIG)
    best = [(b & ~ended).reshape(-1) for b in best]
    to = [np.broadcast_to(t, (n, 4)).reshape(-1) for t in to]
    letter = np.zeros(4 * n, np.int64)
    jump = np.arange(4 * n)
    for k in (3, 2, 1, 0):  # the least letter of the optimal arcs
        letter, jump = np.where(best[k], k + 1, letter), np.where(best[k], to[k], jump)
    rank, pointers, length = letter, [jump], (letter > 0).astype(np.int64)
    while True:  # ranks over twice as many letters, pointers twice as far
        far = pointers[-1]
        if not letter[far].any():
            break
        rank = np.unique(rank * (rank.max() + 1) + rank[far], return_inverse=True)[1].reshape(-1)
        length = length + length[far]
        pointers.append(far[far])
    # the ranks choose among a node's optimal arcs: by its letter, then by the rank of what follows
    chosen = np.min([np.where(best[k], (k + 1) * (rank.max() + 1) + rank[to[k]], BIG) for k in range(4)], 0)
    letter = np.where(chosen < BIG, chosen // (rank.max() + 1), 0)
    return first, togo, letter, pointers, length


def _read(starts: np.ndarray, letter: np.ndarray, pointers: list[np.ndarray], length: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The audit from each start and the node at its end: the node after t arcs is found through the bits of t."""
    n = length[starts]
    begin = np.concatenate([[0], np.cumsum(n)])
    node, t = np.repeat(starts, n), np.arange(begin[-1]) - np.repeat(begin[:-1], n)
    end = starts.copy()
    for k, far in enumerate(pointers):
        node = np.where(t >> k & 1, far[node], node)
        end = np.where(n >> k & 1, far[end], end)
    text = np.frombuffer(f"-{LETTERS}".encode(), np.uint8)[letter[node]].tobytes().decode()
    return [text[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)], end


def _coded(texts: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(t.encode(), np.uint8).astype(np.int64) - ord("A") for t in texts]


def _legal(codes: list[np.ndarray]) -> list[int]:
    kind = np.array([[(a, b) in LEGAL for b in range(4)] for a in range(4)])
    return [int(kind[c[:-1] // 3, c[1:] // 3].sum()) for c in codes]


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks in parts of at most 2^TOGETHER_BITS rows, or one chunk."""
    for b in batches:
        part = b["codes"].str.len().cumsum().floordiv(1 << TOGETHER_BITS)
        for _, some in b.groupby(part, sort=False):
            yield some


def _solve_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _together(batches):
        codes = _coded(b["codes"])
        first, togo, letter, pointers, length = _ranked_paths(codes, np.tile(END, (len(codes), 1)), np.ones(len(codes), bool))
        audits, _ = _read(first * 4, letter, pointers, length)
        yield pd.DataFrame({"key": b["key"].values, "cost": togo[first, 0], "illegal": [len(c) - 1 - n for c, n in zip(codes, _legal(codes), strict=True)], "audit": audits})


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in _together(batches):
        codes = _coded(b["codes"])
        exits = np.where(np.eye(4, dtype=bool), 0, BIG)  # exit by one state
        found = []
        for q in range(4):
            first, togo = _costs(codes, np.tile(exits[q], (len(codes), 1)))
            found.append(togo[first])
        m = np.stack(found, 2)  # chunk, entry, exit
        yield pd.DataFrame({"key": b["key"].values, "chunk": b["chunk"].values, "matrix": [x.reshape(-1).tolist() for x in m], "n": [len(c) for c in codes], "legal": _legal(codes), "head": [int(c[0] // 3) for c in codes], "tail": [int(c[-1] // 3) for c in codes]})


def _cost_to_end(chunks: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of one conversation the costs at its exit; the first one also has the whole cost and the illegal pairs."""
    chunks = chunks.sort_values("chunk")
    heads, tails = chunks["head"].tolist(), chunks["tail"].tolist()
    legal = int(chunks["legal"].sum()) + sum((a, b) in LEGAL for a, b in zip(tails, heads[1:], strict=False))
    ends, v = [], END.astype(np.int64)
    for m in reversed(chunks["matrix"].tolist()):
        ends.append(v)
        v = np.minimum((np.asarray(m).reshape(4, 4) + v[None, :]).min(1), BIG)
    last = np.arange(len(chunks)) == len(chunks) - 1
    cost, illegal = [int(v[0])] + [0] * (len(chunks) - 1), [int(chunks["n"].sum()) - 1 - legal] + [0] * (len(chunks) - 1)
    return pd.DataFrame({"key": chunks["key"].values, "chunk": chunks["chunk"].values, "ends": [e.tolist() for e in reversed(ends)], "last": last, "cost": cost, "illegal": illegal})


def _solve_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each chunk and each of its four entries the least audit and the exit."""
    for b in _together(batches):
        codes = _coded(b["codes"])
        first, _, letter, pointers, length = _ranked_paths(codes, np.stack([np.asarray(e) for e in b["ends"]]), b["last"].to_numpy(bool))
        starts = (first[:, None] * 4 + np.arange(4)[None, :]).reshape(-1)
        audits, end = _read(starts, letter, pointers, length)
        yield pd.DataFrame({"key": b["key"].values, "chunk": b["chunk"].values, "audits": [audits[4 * i : 4 * i + 4] for i in range(len(codes))], "exits": (end % 4).reshape(-1, 4).tolist(), "cost": b["cost"].values, "illegal": b["illegal"].values})


def _entries(chunks: pd.DataFrame) -> pd.DataFrame:
    """The state in which one conversation's path enters each chunk."""
    chunks, q, found = chunks.sort_values("chunk"), 0, []
    for exits in chunks["exits"].tolist():
        found.append(q)
        q = exits[q]
    return pd.DataFrame({"key": chunks["key"].values, "chunk": chunks["chunk"].values, "entry": found})


def audits(flagged: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """key, cost, illegal, audit of each conversation."""
    fault = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    coded = flagged.select("key", "pos", F.shiftright("pos", chunk_bits).alias("chunk"), F.substring(F.lit(CODES), (3 * F.col("initial") + fault + 1).cast("int"), F.lit(1)).alias("code"))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    chunks = materialize(coded.groupBy("key", "chunk").agg(codes.alias("codes")), "chunks")
    several = materialize(chunks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "several")
    alone = chunks.join(several, "key", "left_anti").select("key", "codes").mapInPandas(_solve_alone, "key string, cost long, illegal long, audit string")
    cut = materialize(chunks.join(several, "key", "left_semi"), "cut")
    ends = cut.mapInPandas(_matrices, "key string, chunk long, matrix array<long>, n long, legal long, head int, tail int").groupBy("key").applyInPandas(_cost_to_end, "key string, chunk long, ends array<long>, last boolean, cost long, illegal long")
    solved = cut.join(ends, ["key", "chunk"]).mapInPandas(_solve_entries, "key string, chunk long, audits array<string>, exits array<int>, cost long, illegal long")
    solved = materialize(solved, "solved")
    entry = solved.select("key", "chunk", "exits").groupBy("key").applyInPandas(_entries, "key string, chunk long, entry int")
    pieces = solved.join(entry, ["key", "chunk"]).select("key", "chunk", "cost", "illegal", F.col("audits")[F.col("entry")].alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "")
    return alone.unionByName(pieces.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), whole.alias("audit")))


def _streamed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A running SHA-256 for each key: its audit comes first, then its rows in order."""
    key, audit, at, state, digest, begun = None, "", 0, 0, None, False
    roles = {2: b"user", 3: b"assistant"}

    def put(line: bytes) -> None:
        nonlocal begun
        if begun:
            digest.update(b"\n")
        digest.update(line)
        begun = True

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = int(TURN[state])
            put(roles[state] + b":")
            at += 1

    for b in batches:
        done = []
        columns = [b.column(c) for c in ("key", "tag", "role", "text")]
        for i in range(b.num_rows):
            k, tag, role, text = (c[i].as_py() for c in columns)
            if tag == 0:
                if digest is not None:
                    inserts()
                    done.append((key, digest.hexdigest()))
                key, audit, at, state, digest, begun = k, text, 0, 0, hashlib.sha256(), False
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter == "D":
                continue
            if letter == "K":
                state = KEEPS[state, "sua".index(role[0])]
            else:
                state = int(TURN[state])
                role = roles[state].decode()
            put(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array([d[0] for d in done], pa.string()), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
    if digest is not None:
        inserts()
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.string()), "repaired_sha256": pa.array([digest.hexdigest()], pa.string())})


def repaired_hashes(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """key and the SHA-256 of its repaired `role:text` lines; no conversation is held as a whole."""
    first = audit.select("key", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    both = first.unionByName(rows.select("key", F.lit(1).alias("tag"), "turn", "role", "digest", "text"))
    both = both.repartition("key").sortWithinPartitions("key", "tag", *_in_order()[1:])
    return both.select("key", "tag", "role", "text").mapInArrow(_streamed_hashes, "key string, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of ids; rows:
    conv_id, turn, role, text."""
    keyed = _keyed(rows)
    flagged = materialize(flagged_rows(keyed), "flagged")
    is_ = lambda f: F.count_if(F.col("fault") == f).alias(f)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = flagged.groupBy("key").agg(gaps, is_("blank"), is_("duplicate"), is_("truncated"))
    audit = materialize(audits(flagged, chunk_bits), "audits")
    out = ids.select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    for part in (counts, audit, repaired_hashes(keyed, audit)):
        out = out.join(part, "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
