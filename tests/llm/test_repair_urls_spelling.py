"""Conversation repair, URL filters and spelling variants against brute force on small tables with nulls, empty and long
texts, ties, repeated rows and extra columns, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from commitlens.llm import conversation_repair, spelling_variants, url_filters

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, pos int, digest string"


def one_conversation(r, cid, n):
    texts = ["Yes.", "No", "", " \n", "What?", "well ...", None, "x" * 500, "so be it!", "é。", "end. "]
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool"]
    turns = [r.choice([i, i, i + 3, None]) if r.random() < 0.2 else i for i in range(n)]
    return [(cid, t, r.choice(roles), r.choice(texts), "k", 1, "d") for t in turns]


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(5)
    rows = [x for cid in range(60) for x in one_conversation(r, cid, r.randint(1, 9))]
    rows += one_conversation(r, 777, 300) + one_conversation(r, None, 5) + one_conversation(r, 778, 16)
    rows += [rows[3], rows[3], rows[40]]
    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0 and i > 1000)
    return rows + [(gone, 0, "user", "Hi.", "k", 1, "d")]


def repaired_by_hand(rows):
    """Each conversation's result by a DP over (cost, audit)."""
    text_of = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for cid, turn, role, text, *_ in rows:
        got = by[cid]
        h = zlib.crc32(f"{text_of(cid)}:{text_of(turn)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        got += [(turn, role, text)] * (2 if h == 3 else 1)
    out = {}
    for cid, got in by.items():
        got.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in got:
            last = text.rstrip(" \t\n\x0b\f\r")[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "none")
            seen.add((role, text))
        nxt, keeps = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        best = {0: (0, ""), 3: (0, ""), 2: (3, "I"), 1: (6, "II")}
        for (_, role, _), fault in zip(reversed(got), reversed(faults), strict=True):
            new, more = {}, 3 if fault == "truncated" else 0
            for q in range(4):
                ways = [(4 + best[q][0], "D" + best[q][1])]
                if fault not in ("blank", "duplicate"):
                    if (q, role[:1]) in keeps:
                        b = best[keeps[q, role[:1]]]
                        ways.append((more + b[0], "K" + b[1]))
                    ways.append((3 + more + best[nxt[q]][0], "R" + best[nxt[q]][1]))
                new[q] = min(ways)
            for _ in range(3):
                new = {q: min(new[q], (3 + new[nxt[q]][0], "I" + new[nxt[q]][1])) for q in range(4)}
            best = new
        cost, audit = best[0]
        q, at, lines = 0, 0, []
        for letter in audit:
            if letter == "I":
                q = nxt[q]
                lines.append({2: "user:", 3: "assistant:"}[q])
                continue
            _, role, text = got[at]
            at += 1
            if letter != "D":
                q = keeps[q, role[:1]] if letter == "K" else nxt[q]
                lines.append(f"{role if letter == 'K' else {2: 'user', 3: 'assistant'}[q]}:{text}")
        assert at == len(got)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = [t for t, *_ in got if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:], strict=False))
        n = Counter(faults)
        out[cid] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_conversation_repair(spark, conversations, bits):
    """Chunks of 4,096 rows and of 4, where most conversations are cut."""
    df = spark.createDataFrame(conversations, CONVERSATIONS).repartition(5)
    got = conversation_repair.repair(conversation_repair.damaged(df), df, bits).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == repaired_by_hand(conversations)
    assert len(got) == len({c[0] for c in conversations})


def test_conversation_repair_of_nothing(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert conversation_repair.repair(conversation_repair.damaged(df), df).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    got = conversation_repair.repair(rows.filter("false"), rows).first()
    assert tuple(got) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


URLS = [
    (1, "http://Blog.Example.ORG/es/12?x=/es/"), (2, "https://example.org/en/19#top"), (3, "https://a.example.org/en/29"), (4, "http://x.com/fr/a"), (5, "http://x.com/de/a.html"), (6, None), (7, "no scheme"),
    (8, "http://org"), (9, "http://notexample.org/es/1"), (10, "ftp://host.net?q=/a"), (11, "x://y://z/p"), (12, "http://www.casino-win.net/en/1"), (13, "http://garden-museum.net/en/1"), (14, "http://h.net/" + "long/" * 20000),
    (15, "http://com/fr/"), (16, "://"), (16, "://"), (17, "http://example.org/\n?a"),
]


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(UP)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, None))


def test_url_filters(spark):
    model = url_filters.train(url_filters.labelled_urls(spark))
    pages = spark.createDataFrame([(i, u, "h", "p", 0.5) for i, u in URLS], "page_id long, url string, host string, path string, features double").repartition(3)
    got = url_filters.judge(pages, model).collect()
    assert sorted(r.page_id for r in got) == sorted(i for i, _ in URLS)
    urls = dict(URLS)
    for r in got:
        host, path, rule, verdict = judged_by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict in (None, r.verdict) and 0 <= r.score <= 1
    by = {r.page_id: r.verdict for r in got}
    assert (by[12], by[13], by[6], by[7]) == ("block", "allow", "allow", "allow")
    assert url_filters.judge(pages.limit(0), model).count() == 0
    other = url_filters.labelled_urls(spark, 2000, seed=99).withColumn("page_id", url_filters.F.monotonically_increasing_id())
    judged = url_filters.judge(other, model, ()).join(other, "page_id").selectExpr("avg(double((verdict = 'block') = (label = 1)))").first()[0]
    assert judged > 0.97  # other names, the same words and layouts


def variants_by_hand(rows, least_count):
    n = Counter()
    for doc, text, *_ in rows:
        for m in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            m = m.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{m}".encode())
            n[m[: h % len(m)] + m[h % len(m) + 1 :] if h % 199 == 0 else m] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least_count}
    near = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            near["-", i, w[:i], w[i + 1 :]].add(w)
            near["+", w[:i] + w[i + 1 :]].add(w)
    links = defaultdict(set)
    for k, ws in near.items():
        for a in ws:
            links[a] |= ws - {a} if k[0] == "-" else {k[1]} & n.keys() - {a}
            if k[0] == "+" and k[1] in n:
                links[k[1]].add(a)
    form = {}
    for w in n:
        best = min(((-n[x], x) for x in links[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], form[w], root, len(links[w]), n[form[w]] if form[w] else None)
    return out


def spelled(seed, letters, words):
    r = random.Random(seed)
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(words)]
    near = []
    for w in base:
        for _ in range(3):
            i = r.randrange(len(w) + 1)
            near.append(r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :]]))
    long = "q" * 700
    text = [w for w in base for _ in range(r.choice([1, 2, 30, 200]))] + near + near[::2] + [long, long + "q", long[:-1] + "z", "ÀÉÎÕÜ" + "é", "àéîõüé", "Straße", "strasse"]
    r.shuffle(text)
    cut = sorted(r.sample(range(len(text)), 40))
    rows = [(i * 7, " ".join(t), "en", "a", 3) for i, t in enumerate(text[a:b] for a, b in zip([0] + cut, cut + [len(text)], strict=True))]
    return rows + [(None, "aaaaaa1aaaaab,aaaaaa", "x", "y", 1), (5, None, None, None, None), (6, "", "", "", 0), rows[3], rows[3], rows[4]]


@pytest.mark.parametrize(("letters", "part_words"), [("ab", 1), ("abcé", 3), ("abcdef", 20_000), ("ab", 50)])
def test_spelling_variants(spark, letters, part_words):
    rows = spelled(len(letters) + part_words, letters, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, root string, n long").repartition(4)
    got = spelling_variants.spelling_variants(docs, 2, part_words).collect()
    want = variants_by_hand(rows, 2)
    assert len(got) == len(want) > 100
    assert {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in got} == want


def test_spelling_variants_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.spelling_variants(docs).columns == ["word", "n", "form", "root", "n_near", "form_n"]
    assert spelling_variants.spelling_variants(docs).count() == 0


def test_partitions_are_bounded(spark):
    """All words share their first half: partitions are halved until few words are left, and none is lost."""
    words = spark.range(4000).selectExpr("concat('common', lpad(conv(id, 10, 3), 8, '0')) as word", "1L as n")
    parts = spelling_variants.partitions(words, 100)
    sizes = parts.groupBy(*spelling_variants.KEY).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 100
    assert parts.selectExpr("concat(head, rest, tail) as word").distinct().count() == 4000
