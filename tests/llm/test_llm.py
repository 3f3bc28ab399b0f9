"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra
columns, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from commitlens.llm import decontamination, exact_dedup, html_extraction, line_dedup, lm_scoring, mixing, ngram_join, sharding, token_counts, toxicity

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid int, row int, hash string"


def space_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))


def corpus(seed=1, n=80):
    r = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(60)] + ["é", "Ünder", "中文", "😀x", "a.b"]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    texts = [None, "", "   \n\t", "one", "one two three", "x" * 3000, line(4000)]
    texts += ["\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 8))) for _ in range(n)]
    base, shared = line(60), "\n".join(line(30) for _ in range(3))
    for k in range(25):
        w = base.split()
        w[(k * 7) % 60] = "edit" + str(k)
        texts.append(" ".join(w))
    texts += [base, base.upper(), base.replace(" ", "  "), texts[10], texts[10], "head\n" + shared + "\ntail", "other " + line(9) + "\n" + shared, shared]
    rows = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["a", "a", "b", None]), None, 1, 2, "x") for i, t in enumerate(texts)]
    rows.append(rows[12])  # a repeated row
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, nothing):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0]))
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {r[0]: re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows}
    kept = Counter()
    for g in got:
        text = by[g.doc_id]
        assert (g.keep_id, g.group_size) == (min(groups[text])[1], len(groups[text]))
        assert g.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        kept[text] += g.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_null_ids(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a b"), (4, "ab"), (4, "ab")], "doc_id long, text string")).collect()
    assert sorted((g.doc_id is None, g.kept) for g in got) == [(False, False), (False, False), (True, True)]


@pytest.mark.parametrize("limit", [200, 2000, 10**9])
def test_sharding(docs, rows, nothing, limit):
    got = sharding.shard_assignments(docs, limit=limit, more_bits=2).collect()
    assert Counter(g.doc_id for g in got) == Counter(r[0] for r in rows)
    shards = defaultdict(list)
    for g in got:
        shards[g.shard].append(g.n_bytes)
        h = f"{int(hashlib.md5(str(g.doc_id).encode()).hexdigest()[:15], 16):060b}"
        assert "-" in g.shard or h.startswith(g.shard) and len(g.shard) == g.depth
    for s, sizes in shards.items():
        assert sum(sizes) <= limit or len(sizes) == 1
    names = [s for s in shards if "-" not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # a partition of the hash space
    for s in names:  # only buckets over the limit were split
        if s:
            parent = [g.n_bytes for g in got if f"{int(hashlib.md5(str(g.doc_id).encode()).hexdigest()[:15], 16):060b}".startswith(s[:-1])]
            assert sum(parent) > limit and len(parent) > 1
    assert sharding.shard_assignments(nothing, limit=limit).count() == 0


def test_sharding_equal_keys(spark):
    df = spark.createDataFrame([(7, "x" * 60)] * 9 + [(8, "y" * 500), (None, None)], "doc_id long, text string")
    got = sharding.shard_assignments(df, limit=100).collect()
    sizes = Counter()
    for g in got:
        sizes[g.shard] += g.n_bytes
    assert len(got) == 11 and all(v <= 100 or v == 500 for v in sizes.values())


def waterfill(sizes, share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done, out = share * sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(2 * sizes[s] for s in done)
        weight = sum(w[s] for s in names if s not in done)
        out = {s: 2 * sizes[s] if s in done else rest * w[s] / weight for s in names}
        over = {s for s in names if s not in done and out[s] > 2 * sizes[s]}
        if not over:
            return out
        done |= over


def test_mixing(docs, rows, nothing):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(space_words(r[1]))
    want, got = waterfill(sizes), mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and math.isclose(g.target, want[g.source], rel_tol=1e-9)
        assert 0 <= g.taken <= 2 * g["size"]
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 4
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((g.doc_id, g.taken) for g in again) == sorted((g.doc_id, g.taken) for g in got)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_schedule_spreads(docs):
    sources = mixing.source_targets(mixing.word_sizes(docs))
    total = sources.first()["total"]
    slots = mixing.schedule(sources, 1, total).collect()
    share = {r.sid: r.target / total for r in sources.collect()}
    for cut in (50, 500):
        n = Counter(s.sid for s in slots if s.slot < cut)
        assert all(abs(n[s] - cut * share[s]) <= 4 for s in share)
    for s in share:
        assert sorted(x["rank"] for x in slots if x.sid == s) == list(range(sum(x.sid == s for x in slots)))


def test_mixing_production_blocks_and_small_sources(spark):
    n = 2_000_000
    x = np.sort((np.arange(n, dtype=np.uint64) * np.uint64(mixing.GOLDEN)) & np.uint64((1 << mixing.POINT_BITS) - 1)).astype(float) / (1 << mixing.POINT_BITS)
    assert np.diff(x).max() * n < 3 and np.diff(x).min() * n > 0.3
    words = {"a": [997] * 60, "b": [300], "c": [31] * 20, "d": [5, 3], None: [2000, 1]}
    rows = [(f"{s}{i}", "w " * k, s) for s, ks in words.items() for i, k in enumerate(ks)]
    for weights in (mixing.WEIGHTS, (40, 1, 3)):
        got = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string"), weights).collect()
        taken = Counter()
        for r in got:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= mixing.MOST_PASSES * r.size
        assert len(got) == len(rows) and all(abs(taken[r.source] - r.target) <= 0.5 for r in got)
    clash = spark.createDataFrame([(1, "w " * 9, "a", 7, 8, 9), (1, "x y", "a", 7, 8, 9), (None, "z", "b", 7, 8, 9), (2, None, None, 7, 8, 9)], "doc_id long, text string, source string, times int, nth int, doc int")
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and {(r.times, r.nth, r.doc) for r in mixed.collect()} == {(7, 8, 9)}
    sources = spark.createDataFrame([(0, 0, 1 << 59), (1, 1 << 59, 1 << 60)], "sid int, lo long, hi long")
    slots = mixing.schedule(sources, 1, 5000.0).collect()
    mask = (1 << mixing.POINT_BITS) - 1
    assert len(slots) == 5000 and all(r.sid == int((r.slot * mixing.GOLDEN & mask) >> 59) for r in slots)


def test_mixed_documents_by_row(spark):
    """Rows without doc_id, or with a shared one, are each given by their own share; sources come near their targets."""
    r = random.Random(4)
    texts = [("a", None, 400), ("a", 7, 200), ("b", None, 300), ("c", 1, 100)]
    rows = [(d, " ".join([f"{s}{k}"] + ["w"] * r.randint(0, 60)), s) for s, d, n in texts for k in range(n)] + [(None, None, "a"), (None, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    times = Counter(x.text for x in mixing.mixed_documents(df, (1, 4, 2), 1.2, 16).collect())
    got = mixing.mix(df, (1, 4, 2), 1.2, 16).collect()
    words = {t: len(t.split()) for _, t, _ in rows if t}
    given = Counter()
    for _, t, s in rows:
        given[s] += times[t] // sum(x[1] == t for x in rows) * words[t] if t else 0
    assert max(times.values()) <= 2 * 2 and None not in times and "" not in times
    for s in "abc":
        target = next(x.target for x in got if x.source == s)
        assert abs(given[s] - target) < 0.1 * target, (s, given[s], target)


def test_decontamination(spark, docs, rows, nothing):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    long = [r for r in rows if len(plain(r[1])) > 30]
    items = [(1, " ".join(plain(long[3][1])[5:30])), (2, long[5][1]), (3, None), (4, ""), (5, "w1 w2"), (6, "not in here at all really"), (7, " ".join(plain(long[3][1])[5:30])), (10, "W3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = plain(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[s : s + 10])].add(str(i))
    got = defaultdict(list)
    for g in decontamination.contamination(docs, bench).collect():
        got[g.doc_id].append(tuple(g)[1:])
    want = defaultdict(list)
    for r in rows:
        w, hit, ids = plain(r[1]), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit.update(range(s, s + k))
                    ids |= windows[tuple(w[s : s + k])]
        want[r[0]].append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    assert got == want and any(x[0][4] for x in want.values())
    assert decontamination.contamination(nothing, bench).count() == 0
    assert not any(g.contaminated for g in decontamination.contamination(docs, bench.limit(0)).collect())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a z b q c"), (2, "c b a"), (3, "a b x x x x x x x x x x x x x x x x x x x c")], "doc_id long, text string")
    got = decontamination.proximity_matches(docs, spark.createDataFrame([(9, "a b c")], "item_id long, text string"), window=3, slack=3).collect()
    assert {g.doc_id for g in got} == {1, 2}


def brute_components(rows):
    sets = {}
    for r in rows:
        w = space_words(r[1])
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("part", [1500, 4])
def test_ngram_join(docs, rows, nothing, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "PART_SETS", part)
    want = brute_components(rows)
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.n_shingles, g.component_id) for g in got} == want
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w) for w in map(space_words, (r[1] for r in rows))]
    links = sorted((r[0], sum(100 * len(a & b) >= 80 * len(a | b) for b in sets) - 1 if a else 0) for r, a in zip(rows, sets, strict=True))
    assert sorted((g.doc_id, g.n_links) for g in got) == links
    if part > 4:
        assert ngram_join.ngram_components(nothing).count() == 0
        stay = ngram_join.representatives(docs)
        assert stay.columns == docs.columns
        assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, c in want.values()})


def test_trie_links_against_all_pairs():
    r = np.random.default_rng(3)
    for trial in range(20):
        base = r.choice(400, 60, replace=False)
        sets: list[np.ndarray] = []
        for _ in range(25):
            s = base.copy()
            for i in r.choice(60, r.integers(0, 14), replace=False):
                s[i] = r.integers(400, 4000)
            sets.append(np.unique(s).astype(np.int64))
        n = np.array([len(s) for s in sets])

        true = {(j, i) for i in range(25) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
        found = [tuple(sorted(p)) for p in ngram_join.trie_links(sets, n).tolist()]
        assert len(found) == len(set(found)) and set(found) == true
        two = [tuple(sorted(p)) for p in ngram_join.trie_links(sets, n, np.arange(12), np.arange(12, 25)).tolist()]
        assert len(two) == len(set(two)) and set(two) == {p for p in true if (p[0] < 12) != (p[1] < 12)}


def test_ngram_join_ids_of_any_type(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [("k", a), ("c", a), (None, a), ("z", b), ("y", None), (None, "")]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("k", 36, "c", 2), ("c", 36, "c", 2), (None, 36, "c", 2), ("z", 36, "z", 0), ("y", 0, "y", 0), (None, 0, None, 0)], key=repr)
    got = ngram_join.ngram_components(spark.createDataFrame([(None, a), (None, a), (3, a), (4, b)], "doc_id int, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 36, None, 2), (None, 36, None, 2), (3, 36, None, 2), (4, 36, 4, 0)], key=repr)


def test_lm_scoring(docs, rows, nothing):
    counts = Counter()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    for r in rows:
        if not held(r[0]):
            counts.update([*space_words(r[1]), None])
    n, v = sum(counts.values()), len(counts)
    got = lm_scoring.score_texts(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for g in got:
        w = [*space_words(text[g.doc_id]), None]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(g.doc_id), len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert g.score < 0
    assert lm_scoring.score_texts(nothing).count() == 0
    # the way words reach their counts does not change a score
    rare = {g.doc_id: g.score for g in lm_scoring.score_texts(docs, heavy_share=2.0).collect()}
    assert all(math.isclose(rare[g.doc_id], g.score, rel_tol=1e-9) for g in got)


def test_lm_scoring_long_words(spark):
    unseen = [d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % lm_scoring.FOLDS == lm_scoring.HELD_OUT]
    rows = [(d, f"one two three big{d % 9}") for d in range(200)] + [(d, "zq" * 20 * 2**k) for k, d in enumerate(unseen[:8])]
    got = {r.doc_id: r.score for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    scores = [got[d] for d in unseen[:8]]
    steps = [b - a for a, b in zip(scores, scores[1:], strict=False)]
    assert all(math.isclose(2 * x, y, rel_tol=1e-6) for x, y in zip(steps, steps[1:], strict=False)) and scores[-1] < -2000  # by length, without a floor


def test_lm_scores_against_all_ways_to_write_a_text(spark):
    """The score of every text by listing the arcs: word, pieces, cache."""
    r = random.Random(8)
    rows = [(d, " ".join(r.choice(["the", "cat", "sat", "Mat", "xq", "é"]) for _ in range(r.randint(0, 12)))) for d in range(60)] + [(None, "the cat"), (70, None), (70, "zzz zzz")]
    got = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % lm_scoring.FOLDS == lm_scoring.HELD_OUT
    train = [t for d, t in rows if not held(d)]
    counts = Counter(w for t in train for w in space_words(t))
    total, once, twice = sum(counts.values()) + len(train), list(counts.values()).count(1), list(counts.values()).count(2)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    model, names = lm_scoring.load_pieces()
    sp = lm_scoring._processor(model)
    chosen = Counter(sp.id_to_piece(i) for w in counts for i in sp.encode(w))
    weights = {k: chosen[k] + 1.0 for k in names}
    bytes_ = [chosen[f"<0x{b:02X}>"] + 1.0 for b in range(256)]
    z = sum(weights.values()) + sum(bytes_)

    def pieces(s, i=0):
        if i == len(s):
            return 1.0
        out = sum(weights[s[i:j]] / z * pieces(s, j) for j in range(i + 1, len(s) + 1) if s[i:j] in weights and (i == 0 or s[i] != "▁"))
        return out if s[i] in weights else out + math.prod(bytes_[b] / z for b in s[i].encode()) * pieces(s, i + 1)

    def score(text):
        out, seen = math.log10((1 - lm_scoring.CACHE) * len(train) / total), Counter()
        for i, w in enumerate(space_words(text)):
            p = discount * len(counts) / total * pieces("▁" + w) + (max(counts[w] - discount, 0) / total if counts[w] else 0)
            out += math.log10((1 - lm_scoring.CACHE) * p + (lm_scoring.CACHE * seen[w] / i if seen[w] else 0))
            seen[w] += 1
        return out

    want = sorted((repr(d), round(score(t), 6)) for d, t in rows)
    assert sorted((repr(g.doc_id), round(g.score, 6)) for g in got) == want


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 0.1, "▁a": 0.2, "a": 0.05, "b": 0.05, "ab": 0.1, "▁ab": 0.02, "ba": 0.03}
    lattice = lm_scoring.Lattice(pieces, [1e-3] * 256)

    def all_ways(s, i=0):
        if i == len(s):
            return 1.0
        return sum(pieces[s[i:j]] * all_ways(s, j) for j in range(i + 1, len(s) + 1) if s[i:j] in pieces)

    for w in ("a", "ab", "abab", "baab"):
        assert math.isclose(math.exp(lattice.log_probability(w)), all_ways("▁" + w), rel_tol=1e-12)
    lattice.SHORT = 0  # log space
    for w in ("a", "ab", "abab", "é", "a" * 500):
        long = lattice.log_probability(w)
        assert len(w) > 9 or w == "é" or math.isclose(math.exp(long), all_ways("▁" + w), rel_tol=1e-12)
        assert long > -1e5


def test_line_dedup(docs, rows, nothing):
    first, want = {}, {}
    texts = sorted({(r[0], r[1]) for r in rows}, key=lambda x: x[0])
    drop = defaultdict(set)
    lines = {d: (t or "").split("\n") for d, t in texts}
    for d, _ in texts:
        n = [len(x.split()) for x in lines[d]]
        for i in range(len(n)):
            j = next((j for j in range(i, len(n)) if sum(n[i : j + 1]) >= 50), None)
            if j is None:
                break
            key = tuple(lines[d][i : j + 1])
            if key not in first:
                first[key] = (d, i)
                continue
            o, k = first[key]
            lo, hi, s = i, j, i - k
            while lo > 0 and lo - 1 - s >= 0 and lines[d][lo - 1] == lines[o][lo - 1 - s]:
                lo -= 1
            while hi + 1 < len(n) and hi + 1 - s < len(lines[o]) and lines[d][hi + 1] == lines[o][hi + 1 - s]:
                hi += 1
            drop[d] |= set(range(lo, hi + 1))
    for d, t in texts:
        want[d] = (t if not drop[d] else "\n".join(x for i, x in enumerate(lines[d]) if i not in drop[d]), len(lines[d]), len(drop[d]))
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows) and {g.doc_id: tuple(g)[1:] for g in got} == want
    assert sum(len(x) > 0 for x in drop.values()) >= 3
    assert line_dedup.line_dedup(nothing).count() == 0


def test_line_windows_select_minima():
    r = random.Random(3)
    lines = [" ".join(f"w{r.randrange(40)}" for _ in range(r.randint(0, 12))) for _ in range(300)]
    h, picks = line_dedup.line_windows("\n".join(lines))
    assert sum(len(ws) for _, ws in picks) > 4 * len(picks) / 2  # neighbours share a selection
    for p, ws in picks:
        for _, lo, hi in ws:
            n = [len(x.split()) for x in lines[lo : hi + 1]]
            assert p == min(h[lo : hi + 1]) and sum(n) >= line_dedup.WORDS > sum(n[:-1])
    # a run that two texts share is selected at the same line, whatever surrounds it
    shared = lines[50:80]
    other = ["x"] * 7 + shared + ["y z"] * 5
    mine = {(p, w[0]) for p, ws in picks for w in ws}
    theirs = {(p, w[0]) for p, ws in line_dedup.line_windows("\n".join(other))[1] for w in ws}
    n = [len(x.split()) for x in shared]
    whole = sum(sum(n[i:]) >= line_dedup.WORDS for i in range(len(n)))
    assert len(mine & theirs) >= whole


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_token_counts(docs, rows, nothing, rule):
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts.ranks(), special_tokens={})
    got = defaultdict(list)
    for g in token_counts.token_counts(docs, rule=rule).collect():
        got[g.doc_id].append(g)
    for r in rows:
        mine = sorted(got[r[0]], key=lambda g: g.section)
        text = r[1] or ""
        if len(mine) != len({g.section for g in mine}):
            continue  # the repeated row
        assert sum(g.n_tokens for g in mine) == len(enc.encode_ordinary(text))
        assert "".join(text[g.start : g.end] for g in mine) == text
        assert [text[g.start : g.end] for g in mine] == (text.splitlines(True) if not re.search("[\r\x0b\x0c\x1c-\x1e\x85  ]", text) else None) or text == ""
    assert token_counts.token_counts(nothing).count() == 0


def test_token_crossing_rule():
    text = "ab\n\n\n\ncd"
    for rule in ("start", "end", "most"):
        assert sum(s[3] for s in token_counts.section_counts(text, rule=rule)) == len(token_counts._encoding(token_counts.VOCABULARY)[0].encode_ordinary(text))
    assert sum(s[4] for s in token_counts.section_counts(text)) >= 1


def test_html_blocks():
    page = "<html><head><title>T</title></head><body><p>a<b>b</b>c<br>d <p>e &amp; f&nbsp;g<ul><li>x<li>y</ul><!-- c --><script>var t='</p>';</script>z<di"
    assert [b[1] for b in html_extraction.blocks(page)] == ["abc d", "e & f g", "x", "y", "z"]
    for cut in ('<a ' + 'k="v" ' * 20_000, "<a '" * 20_000, '<a "' * 20_000 + "<script>" * 5_000):  # read once, not over and over
        assert [b[1] for b in html_extraction.blocks("<p>x</p>" + cut)][:1] == ["x"]
    for page in ('<p title="a > b">text</p>', "<p title='a > b'>text</p>", "<p class=it's>text</p>", '<div "><p>text</p></div>'):
        assert [b[1] for b in html_extraction.blocks(page)] == ["text"], page
    assert html_extraction.blocks(None) == [] and html_extraction.blocks("<b>x") [0][1] == "x"


def test_html_held_out_accuracy(spark):
    field = html_extraction.default_field()
    test = html_extraction.training_set(html_extraction.labelled_pages(120, seed=99))
    pairs = [(p, y) for f, ys in test for p, y in zip(field.decode(f), ys, strict=True)]
    assert sum(p == y for p, y in pairs) / len(pairs) > 0.97
    page = '<body><nav><ul><li><a href=x>m</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>Head line</h1><p>One two &copy; three.<p>Four</article><div class="comments"><p>Nice one.</p></div><footer>end</footer>'
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extraction.extract_articles(df).collect()}
    assert got[1].text == "Head line One two © three. Four" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" == got[3].text and got[2].n_chars == 0
    assert html_extraction.extract_articles(df.limit(0)).count() == 0


def test_viterbi_against_all_paths():
    r = random.Random(4)
    for _ in range(30):
        n = r.randint(1, 7)
        field = html_extraction.Field({f"f{i}": (r.random(), r.random()) for i in range(n)}, np.array([[r.random(), r.random()], [r.random(), r.random()]]))
        feats = [[f"f{i}"] for i in range(n)]

        def value(path):
            return sum(field.weights[f"f{i}"][s] for i, s in enumerate(path)) + sum(field.between[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(([int(x) for x in f"{k:0{n}b}"] for k in range(2**n)), key=value)
        assert math.isclose(value(field.decode(feats)), value(best))


def brute_kernel(a, b):
    """The bounded-gap kernel by listing all places, normalised and raised."""
    from itertools import combinations

    def places(w):
        out = Counter()
        for at in combinations(range(len(w)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                out["".join(w[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = places(a), places(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return (dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER if x and y else 0.0


def test_subsequence_kernel_against_brute_force():
    marks = ["^idiot$", "^moron$", "^worthless$", "^banana$", "^aaaa$"]
    words = ["^idiot$", "^idxiot$", "^i1d2iot$", "^bandana$", "^aaaaaaa$", "^wort-hless$", "abcdidiotxx", "abc", "^çé中😀$", "zzzzzz"]
    got = toxicity.Kernel(marks).values(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            assert math.isclose(got[i, j], brute_kernel(w, m), rel_tol=1e-5, abs_tol=1e-7), (w, m)
    assert got[1, 0] > 0.2 and got[0, 0] > 0.999


def test_toxicity_sentences():
    assert toxicity.sentences(None) == toxicity.sentences("") == toxicity.sentences(" ?!\n.") == []
    assert toxicity.sentences("You IDIOT! so, so\nend") == [["^you$", "^idiot$"], ["^end$"]]  # words of two letters say nothing
    for text in ("you i d i o t. i know", "what a. i d i o t there", "so\ni d i o t\na man", "you id-i.ot. bye"):
        assert any("^idiot$" in s for s in toxicity.sentences(text)), text
    long = toxicity.sentences("x" * 30)
    assert set(map(tuple, long)) == {("x" * toxicity.LONG,)} and len(long) == (30 - toxicity.LONG) // toxicity.STEP + 1
    for n in range(25, 32):  # every letter is read
        word = "".join(chr(0x4E00 + i) for i in range(n))
        assert {c for s in toxicity.sentences(word) for w in s for c in w} == set(word)
    many = toxicity.sentences(" ".join(f"w{i}ord" for i in range(1000)))
    assert {w for s in many for w in s} == {f"^w{i}ord$" for i in range(1000)} and max(map(len, many)) <= toxicity.STRETCH


def test_toxicity_spaced_words_and_torn_copies():
    got = {w for s in toxicity.sentences("You are such a t r a s h.") for w in s}
    assert "^trash$" in got and "^atrash$" in got  # the article before the letters is one of them, or not
    for word in ("^worthless$", "^idiot$", "^ñañaño$", "abcdefgh"):
        for copy in (1, 2):
            new = toxicity.torn(word, copy)
            assert len(new) == len(word) + 1 and new == toxicity.torn(word, copy) and (new[0], new[-1]) == (word[0], word[-1])
            assert any(new[:i] + new[i + 1 :] == word for i in range(len(new)))
    assert toxicity.torn("^you$", 1) == "^you$" and toxicity.torn("", 1) == ""


def test_toxicity_inserted_letters_of_the_training_insults():
    """Texts of several insults stay above the cut when each word has a letter more; clean ones stay below."""
    insults, plain = ["worthless", "pathetic", "disgusting", "stupid"], ["garden", "window", "market", "bridge", "orchard", "mountain", "library", "picture"]
    pick = lambda i, k: plain[(i * 7 + k * 3) % 8]
    bad = [f"The {pick(i, 1)} is near. You are a {insults[i % 4]} and {insults[(i + 1) % 4]} {pick(i, 2)}. We saw the {pick(i, 3)}." for i in range(60)]
    good = [f"The {pick(i, 1)} is near. You are in a {pick(i, 4)} and {pick(i, 5)} today. We saw the {pick(i, 3)}." for i in range(240)]
    texts = [toxicity.sentences(t) for t in bad + good]
    model = toxicity.fit(texts, np.arange(300) < 60, 0.2)
    more = lambda t: " ".join(w if len(w) < 5 else w[: len(w) // 2] + "x" + w[len(w) // 2 :] for w in t.split())
    scores = model.scores([toxicity.sentences(more(t)) for t in bad + good], {})
    assert (scores[:60] >= toxicity.CUT).mean() >= 0.9 and (scores[60:] < toxicity.CUT).all()


def test_toxicity_margins_are_the_kernel_machine():
    """A sentence's margin is the SVM's product with its Nyström row, worked out pair by pair."""
    marks = ["^idiot$", "^scum$", "^hello$", "^world$"]
    kernel = toxicity.Kernel(marks)
    model = toxicity.Model(kernel, np.array([2.0, 1.5, -0.5, -0.25]), -0.75)
    texts = ["Hello idxiot world. Scum and i d i o t", "", "a scxum " * 3]
    for t, row in zip(texts, model.loudest([toxicity.sentences(t) for t in texts], {}), strict=True):
        margins = [sum(a * brute_kernel(w, m) for w in s for a, m in zip(model.direction, marks, strict=True)) for s in toxicity.sentences(t)]
        want = sorted(margins + [0.0] * toxicity.TOP, reverse=True)[: toxicity.TOP]
        assert np.allclose(row, np.array(want) - 0.75, atol=1e-6)


def test_toxicity_held_out(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ba", "ti", "ro", "ke", "su", "ni"]) for _ in range(r.randint(2, 4)))
    bad = ["idiot", "worthless", "grumblor", "loweischaft"]
    rows, labels = [], []
    for d in range(600):
        w = [word() + r.choice(["", "", ".", "\n"]) for _ in range(r.randint(10, 60))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(2):
                b = r.choice(bad)
                w.insert(r.randrange(len(w)), b if r.random() < 0.8 else "-".join(b))
        rows.append((d, " ".join(w), "x"))
        labels.append((d, None, y))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "idiot", "x"), (1002, "i d i o t you worthless " * 3, "x"), (1003, "ba ti " * 60_000 + "idiot. worthless. idiot", "x"), (5, "another text", "x"), rows[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, lab)
    every = toxicity.toxicity_scores(docs, model).collect()
    got = {g.doc_id: g for g in every}
    assert len(every) == len(rows) and all(0 <= g.score <= 1 for g in every)
    assert len({g.score for g in every if g.doc_id == rows[7][0]}) == 1 and got[1003].predicted == 1
    again = toxicity.train(docs.repartition(5), lab)
    assert np.array_equal(again.direction, model.direction) and np.array_equal(again.logistic, model.logistic)
    test = [(got[d].predicted, y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _, _ in labels)
    assert sum(p == y for p, y in test) / len(test) > 0.95
    assert got[1000].predicted == got[1001].predicted == 0 and got[1002].predicted == 1
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1001").count() == 1 and kept.filter("doc_id = 1002").count() == 0
    assert toxicity.train(docs, lab.limit(0)) is None
    assert toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_rows_that_share_a_doc_id(spark, tmp_path):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, b), (7, a), (7, c), (8, c + " end"), (9, None), (9, " "), (10, None)]
    got = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text or "").strip()) for r in got) == Counter([(None, a), (None, b), (7, c), (9, ""), (10, "")])
    spark.createDataFrame([(1, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame([(None, a), (None, b), (7, b), (7, c), (8, c), (9, None)], "doc_id long, text string"), str(tmp_path)).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, a), (7, c), (8, c), (9, None)])


def test_pipeline(spark, tmp_path, rows, docs):
    import corpus_pipeline

    d = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(i % 9 == 0)) for i, r in enumerate(rows[:-1])], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[20][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    step, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, step, d)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == step.columns
        out.write.parquet(f"{d}/stage{i}")
        step = spark.read.parquet(f"{d}/stage{i}")
        seen.append(Counter(r.doc_id for r in step.collect()))
    model = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(spark.read.parquet(f"{d}/documents.parquet"), model).collect()}
    assert set(seen[0]) == {k for k, s in scores.items() if s < toxicity.CUT}
    kept = [r for r in rows if r[0] in seen[0]]
    assert set(seen[1]) == {c for _, c in brute_components(kept).values()} and max(seen[1].values()) == 1
    assert set(seen[2]) <= set(seen[1]) and rows[20][0] not in seen[2]
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].values()) <= 2
    assert seen[4] == seen[3]
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == seen[4]
