"""Version order and version ranges as column expressions.

A version is a struct that sorts as PEP 440 does. A range is an array of branches, each an array of bounds; a null range
is a text that the grammar does not know. Matching has three values: true, false, and null for a version without order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a version (PEP 440, appendix B), with numbers that fit 64 bits; the stages of a prerelease; the other grammars.
VERSION = (
    r"(?i)^\s*v?(?:(\d{1,18})!)?(\d{1,18}(?:\.\d{1,18})*)([-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d{1,18})?)?"
    r"(?:-(\d{1,18})|([-_.]?(?:post|rev|r)[-_.]?(\d{1,18})?))?([-_.]?dev[-_.]?(\d{1,18})?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
STAGES = {"a": 0, "alpha": 0, "b": 1, "beta": 1, "c": 2, "rc": 2, "pre": 2, "preview": 2}
ZEROS = r"^0+(\.0+)*$|(\.0+)+$"
PLAIN = r"^\d{1,18}(\.\d{1,18})*$"
WILDCARD = r"^v*\d{1,18}(\.\d{1,18})*(\.[xX*])+$"
PARTIAL = r"^v?\d{1,18}(\.\d{1,18})?$"
HYPHEN = r"^\s*(\S+)\s+-\s+(\S+)\s*$"
SPECIFIER = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(\S+)\s*$"
INTERVAL = r"^\s*(\[|\()\s*([^,]*?)\s*,\s*([^\]\)]*?)\s*(\]|\))\s*$"
NUMERIC = r"^\s*\d{1,18}(\.\d{1,18})*\s*$"
KEY_TYPE = "struct<epoch:bigint,release:array<bigint>,pre:struct<stage:int,n:bigint>,post:bigint,dev:bigint,local:array<struct<n:bigint,s:string>>>"
BOUND_TYPE = f"struct<op:string,key:{KEY_TYPE},release:array<bigint>,text:string>"
LAST = (1 << 63) - 1


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once."""
    return F.transform(F.array(c), f)[0]


def _numbers(dotted: Column) -> Column:
    return F.transform(F.filter(F.split(dotted, r"\."), lambda x: x != ""), lambda x: x.try_cast("long"))


def without_zeros(version: Column) -> Column:
    """A PLAIN text without zeros at its end."""
    return F.regexp_replace(version, ZEROS, "")


def _plain_numbers(short: Column) -> Column:
    """Numbers of a PLAIN text without zeros at its end."""
    return F.when(short == "", F.array().cast("array<bigint>")).otherwise(F.split(short, r"\.").try_cast("array<bigint>"))


def _release_key(release: Column) -> Column:
    """Key of a plain release whose last number is not zero."""
    none = F.array().cast("array<struct<n:bigint,s:string>>")
    return F.struct(
        F.lit(0).cast("long").alias("epoch"), release.alias("release"), F.struct(F.lit(3).alias("stage"), F.lit(0).cast("long").alias("n")).alias("pre"),
        F.lit(-1).cast("long").alias("post"), F.lit(LAST).alias("dev"), none.alias("local"),
    )


def version_key(version: Column) -> Column:
    """Orders versions as PEP 440; null for other texts. One pass of the pattern; the rest takes its groups apart."""
    groups = F.split(F.regexp_replace(version, VERSION, "$1|$2|$4|$5|$6|$7|$8|$9|$10|$11"), r"\|", -1)
    n = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))

    def build(g):
        stage = F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.lower(g[2]))
        post = F.when(g[4] != "", n(g[4])).when(g[5] != "", n(g[6])).otherwise(F.lit(-1).cast("long"))
        first = F.when(stage.isNotNull(), stage).when((g[4] == "") & (g[5] == "") & (g[7] != ""), -1).otherwise(3)
        local = F.transform(F.filter(F.split(F.lower(g[9]), "[-_.]"), lambda x: x != ""), lambda x: F.struct(F.coalesce(x.try_cast("long"), F.lit(-1).cast("long")).alias("n"), F.when(x.try_cast("long").isNull(), x).otherwise("").alias("s")))
        return F.struct(
            n(g[0]).alias("epoch"), _numbers(F.regexp_replace(g[1], ZEROS, "")).alias("release"), F.struct(first.alias("stage"), n(g[3]).alias("n")).alias("pre"),
            post.alias("post"), F.when(g[7] != "", n(g[8])).otherwise(F.lit(LAST)).alias("dev"), local.alias("local"),
        )

    # most versions are plain numbers, which need no more than their zeros cut
    return F.when(version.rlike(PLAIN), _release_key(_plain_numbers(without_zeros(version)))).when(version.rlike(VERSION), let(groups, build))


def is_version(version: Column) -> Column:
    """Whether a text has a key."""
    return version.rlike(PLAIN) | version.rlike(VERSION)


def is_prerelease(key: Column) -> Column:
    return (key["pre"]["stage"] < 3) | (key["dev"] < LAST)


def raw_release(version: Column) -> Column:
    return _numbers(F.regexp_extract(version, VERSION, 2))


def bound(op: Column | str, key: Column, release: Column | None = None, text: Column | None = None) -> Column:
    op = F.lit(op) if isinstance(op, str) else op
    none = F.lit(None)
    return F.struct(op.alias("op"), key.alias("key"), (none.cast("array<bigint>") if release is None else release).alias("release"), (none.cast("string") if text is None else text).alias("text")).cast(BOUND_TYPE)


def _all_or_null(items: Column) -> Column:
    return F.when(~F.exists(items, lambda x: x.isNull()), items)


def _semver_token(token: Column, cargo: bool) -> Column:
    """Array of bounds of one token; null if it is none."""
    number = lambda r, i: F.coalesce(F.get(r, F.lit(i)), F.lit(0).cast("long"))
    ranged = token.rlike(WILDCARD) | token.rlike(PARTIAL)
    bare = token.rlike(r"^\d") & ~token.rlike(WILDCARD) if cargo else F.lit(False)
    kind = (
        F.when(token.isin("*", "x", "X"), "any").when(token.rlike(WILDCARD), "wild").when(token.rlike(r"(^v*|\.)[xX*](\.|$)"), "bad").when(token.startswith("^") | bare, "caret")
        .when(token.startswith("~"), "tilde").when(token.rlike(PARTIAL), "wild").otherwise("compare")
    )
    text = F.when(ranged, F.regexp_extract(token, r"^v*(\d+(?:\.\d+){0,2})", 1)).otherwise(F.regexp_replace(token, r"^(\^|[~][~>]*|<=|>=|<|>|=)", ""))
    op = F.coalesce(F.nullif(F.regexp_extract(token, r"^(<=|>=|<|>|=)", 1), F.lit("")), F.lit("="))

    def build(t):
        r, a, b, c = t["r"], number(t["r"], 0), number(t["r"], 1), number(t["r"], 2)
        caret = F.when(a > 0, F.array(a + 1)).when(b > 0, F.array(a, b + 1)).otherwise(F.array(a, b, c + 1))
        high = F.when(t["kind"] == "caret", caret).when(F.size(r) == 1, F.array(a + 1)).otherwise(F.array(a, b + 1))
        one = F.when(t["kind"] == "compare", F.array(bound(t["op"], t["key"]))).otherwise(F.array(bound(">=", t["key"]), bound("<", _release_key(high))))
        return F.when(t["kind"] == "any", F.array().cast(f"array<{BOUND_TYPE}>")).when((t["kind"] != "bad") & t["key"].isNotNull(), one)

    return let(F.struct(kind.alias("kind"), op.alias("op"), version_key(text).alias("key"), raw_release(text).alias("r")), build)


def semver_bounds(spec: Column, cargo: bool = False) -> Column:
    """npm and Cargo: || of blank- or comma-separated tokens, hyphen ranges, ^, ~, wildcards, comparisons."""

    def branch(b):
        ends = F.array(bound(">=", version_key(F.regexp_extract(b, HYPHEN, 1))), bound("<=", version_key(F.regexp_extract(b, HYPHEN, 2))))
        tokens = F.filter(F.split(b, r"[\s,]+"), lambda x: x != "")
        listed = let(_all_or_null(F.transform(tokens, lambda t: _semver_token(t, cargo))), F.flatten)
        return F.when(F.trim(b) == "", None).when(b.rlike(HYPHEN), F.when(~F.exists(ends, lambda e: e["key"].isNull()), ends)).otherwise(listed)

    return _all_or_null(F.transform(F.split(spec, r"\|\|", -1), branch))


def pep440_bounds(spec: Column) -> Column:
    """PyPI: comma-separated specifiers, all of which hold; prefixes (==1.*), compatible releases and === too."""

    def one(t):
        op, v = F.regexp_extract(t, SPECIFIER, 1), F.regexp_extract(t, SPECIFIER, 2)
        base = F.regexp_replace(v, r"\.\*$", "")
        given = F.struct(op.alias("op"), v.alias("v"), version_key(base).alias("key"), raw_release(base).alias("r"))
        return let(given, build)

    def build(t):
        op, v, key, r = t["op"], t["v"], t["key"], t["r"]
        near = F.array(bound("p>=", key), bound("p==*", key, F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))))
        plain = op.isin("==", "!=") | ~v.contains("+")
        return (
            F.when(op == "", None).when(op == "===", F.array(bound(op, key, text=F.lower(v)))).when(key.isNull(), None)
            .when(v.endswith(".*"), F.when(op.isin("==", "!=") & v.rlike(r"^v?(\d+!)?\d+(\.\d+)*\.\*$"), F.array(bound(F.concat(F.lit("p"), op, F.lit("*")), key, r))))
            .when(op == "~=", F.when((F.size(r) > 1) & ~v.contains("+"), near)).when(plain, F.array(bound(F.concat(F.lit("p"), op), key)))
        )

    texts = F.filter(F.split(spec, ","), lambda x: F.trim(x) != "")
    listed = let(_all_or_null(F.transform(texts, one)), F.flatten)
    return F.when(listed.isNotNull(), F.array(listed))


def maven_bounds(spec: Column) -> Column:
    """Maven: [a,b) and the like with numeric sides, either of which may be open."""
    side = lambda i: F.regexp_extract(spec, INTERVAL, i)
    low = F.when(side(2) != "", bound(F.when(side(1) == "[", ">=").otherwise(">"), version_key(side(2))))
    high = F.when(side(3) != "", bound(F.when(side(4) == "]", "<=").otherwise("<"), version_key(side(3))))
    ok = spec.rlike(INTERVAL) & ((side(2) == "") | side(2).rlike(NUMERIC)) & ((side(3) == "") | side(3).rlike(NUMERIC))
    return F.when(ok, F.array(F.array_compact(F.array(low, high))))


def range_bounds(ecosystem: str, spec: Column) -> Column:
    """Branches of bounds; null for a text or an ecosystem without range grammar."""
    if ecosystem == "PyPI":
        return pep440_bounds(spec)
    if ecosystem in ("npm", "Cargo"):
        return semver_bounds(spec, ecosystem == "Cargo")
    return maven_bounds(spec) if ecosystem == "Maven" else F.lit(None).cast(f"array<array<{BOUND_TYPE}>>")


def range_box(bounds: Column) -> Column:
    """struct(lo, hi): between which first numbers all versions of a range lie; null where a side is open. A cheap test
    that spares most releases the bounds themselves."""
    first = lambda b: F.when((b["key"]["epoch"] == 0) & (b["op"] != "==="), F.coalesce(F.get(b["key"]["release"], F.lit(0)), F.lit(0).cast("long")))
    low, high = ("=", ">", ">=", "p==", "p==*", "p>", "p>="), ("=", "<", "<=", "p==", "p==*", "p<", "p<=")
    side = lambda pick, ops: F.transform(bounds, lambda branch: pick(F.transform(F.filter(branch, lambda b: b["op"].isin(*ops)), first)))
    lows, highs = side(F.array_max, low), side(F.array_min, high)
    whole = lambda a: ~F.exists(a, lambda x: x.isNull())
    return F.struct(F.when(whole(lows), F.array_min(lows)).alias("lo"), F.when(whole(highs), F.array_max(highs)).alias("hi"))


def inside_box(key: Column, box: Column) -> Column:
    """Whether a version can lie in a range with this box; one without order or with an epoch always can."""
    first = F.coalesce(F.get(key["release"], F.lit(0)), F.lit(0).cast("long"))
    return key.isNull() | (key["epoch"] != 0) | ((box["lo"].isNull() | (first >= box["lo"])) & (box["hi"].isNull() | (first <= box["hi"])))


def takes_prereleases(ecosystem: str, spec: Column, bounds: Column) -> Column:
    """Whether a range lets prereleases in at all: if it names one, or sets no bound (PyPI)."""
    if ecosystem == "PyPI":
        return (F.size(F.flatten(bounds)) == 0) | F.coalesce(F.exists(F.flatten(bounds), lambda b: ~b["op"].startswith("p!=") & F.coalesce(is_prerelease(b["key"]), F.lit(False))), F.lit(False))
    return spec.rlike(r"\d-[0-9A-Za-z]")


def _holds(key: Column, version: Column, b: Column) -> Column:
    op, want = b["op"], b["key"]
    public = key.withField("local", F.array().cast("array<struct<n:bigint,s:string>>"))
    base = lambda k: F.struct(k["epoch"], k["release"])
    size = F.size(b["release"])
    prefix = (key["epoch"] == want["epoch"]) & (F.slice(F.concat(key["release"], F.array_repeat(F.lit(0).cast("long"), size)), 1, size) == b["release"])
    equal = F.when(F.size(want["local"]) > 0, key == want).otherwise(public == want)
    below = (key < want) & ~(~is_prerelease(want) & is_prerelease(key) & (base(key) == base(want)))
    above = (key > want) & ~((want["post"] < 0) & (key["post"] >= 0) & (base(key) == base(want))) & ~((F.size(key["local"]) > 0) & (base(key) == base(want)))
    return (
        F.when(op == "=", key == want).when(op == "<", key < want).when(op == "<=", key <= want).when(op == ">", key > want).when(op == ">=", key >= want)
        .when(op == "p==*", prefix).when(op == "p!=*", ~prefix).when(op == "p==", equal).when(op == "p!=", ~equal).when(op == "p<=", public <= want).when(op == "p>=", public >= want)
        .when(op == "p<", below).when(op == "p>", above).when(op == "===", F.lower(F.trim(version)) == b["text"])
    )


def range_match(ecosystem: str, version: Column, key: Column, bounds: Column, prereleases: Column) -> Column:
    """True, false, or null where the version has no order in this ecosystem."""
    known = key.isNotNull() & (version.rlike(NUMERIC) if ecosystem == "Maven" else F.lit(True))
    hit = F.exists(bounds, lambda branch: F.forall(branch, lambda b: _holds(key, version, b)))
    return F.when(known, F.when(is_prerelease(key) & ~prereleases, False).otherwise(hit) if ecosystem != "Maven" else hit)


def _edge(key: Column, stage: int) -> Column:
    """Before (stage -9) or behind (9) all versions of a key's release."""
    return F.struct(
        key["epoch"].alias("epoch"), key["release"].alias("release"), F.struct(F.lit(stage).alias("stage"), F.lit(0).cast("long").alias("n")).alias("pre"),
        F.lit(-1).cast("long").alias("post"), F.lit(0).cast("long").alias("dev"), F.array().cast("array<struct<n:bigint,s:string>>").alias("local"),
    )


def cut(key: Column, side: int) -> Column:
    """A place in the order of versions: just before (-1), at (0) or just behind (1) a key."""
    return F.struct(key.cast(KEY_TYPE).alias("key"), F.lit(side).alias("side"))


def placed_cut(key: Column, side: Column) -> Column:
    """A cut in a form that sorts alike and is short for plain releases: what follows their numbers is left out, and told from
    what lies before (-1) and behind it (1)."""
    rest = F.struct(key["pre"], key["post"], key["dev"], key["local"])
    plain = _release_key(F.array().cast("array<bigint>"))
    final = F.struct(plain["pre"], plain["post"], plain["dev"], plain["local"])
    after = F.when(rest == final, 0).when(rest < final, -1).otherwise(1)
    return F.struct(key["epoch"].alias("epoch"), key["release"].alias("release"), after.alias("after"), F.when(rest != final, rest).alias("rest"), side.alias("side"))


def placed_version(version: Column, easy: Column | None = None, short: Column | None = None) -> Column:
    """placed_cut of a version's own place; plain ones need no key. easy, short: whether it is PLAIN and what it is without
    zeros, where that is known."""
    easy, short = version.rlike(PLAIN) if easy is None else easy, without_zeros(version) if short is None else short
    rest = "struct<pre:struct<stage:int,n:bigint>,post:bigint,dev:bigint,local:array<struct<n:bigint,s:string>>>"
    plain = F.struct(F.lit(0).cast("long").alias("epoch"), _plain_numbers(short).alias("release"), F.lit(0).alias("after"), F.lit(None).cast(rest).alias("rest"), F.lit(0).alias("side"))
    return F.when(easy, plain).when(version.rlike(VERSION), let(version_key(version), lambda k: placed_cut(k, F.lit(0))))


CUT_TYPE = f"struct<key:{KEY_TYPE},side:int>"
STRETCH = f"struct<lo:{CUT_TYPE},hi:{CUT_TYPE},hole:boolean>"


def _stretch(b: Column) -> Column:
    """The versions that hold a bound, as struct(lo, hi, hole): between two cuts, or with hole outside them; null if they are no
    such stretch. A side that is open is null."""
    op, want, nowhere = b["op"], b["key"], F.lit(None).cast(CUT_TYPE)
    final = (want["pre"]["stage"] == 3) & (want["post"] < 0) & (want["dev"] == LAST)
    with_locals = want.withField("local", F.array(F.struct(F.lit(LAST).alias("n"), F.lit("").alias("s"))))
    plain = F.size(want["local"]) == 0
    trimmed = F.filter(F.transform(b["release"], lambda x, i: F.when(F.exists(F.slice(b["release"], i + 1, F.size(b["release"])), lambda y: y > 0), x)), lambda x: x.isNotNull())
    n = F.size(b["release"])
    behind = F.concat(F.slice(b["release"], 1, n - 1), F.array(F.element_at(b["release"], n) + 1))
    low = _edge(F.struct(want["epoch"].alias("epoch"), trimmed.alias("release")), -9)
    high = _edge(F.struct(want["epoch"].alias("epoch"), behind.alias("release")), -9)
    s = lambda lo, hi, hole=False: F.struct((nowhere if lo is None else lo).alias("lo"), (nowhere if hi is None else hi).alias("hi"), F.lit(hole).alias("hole"))
    prefix = (n > 0) & op.isin("p==*", "p!=*")
    return (
        F.when(op == "=", s(cut(want, -1), cut(want, 1))).when(op == "<", s(None, cut(want, -1))).when(op == "<=", s(None, cut(want, 1))).when(op == ">", s(cut(want, 1), None)).when(op == ">=", s(cut(want, -1), None))
        .when((op == "p>=") & plain, s(cut(want, -1), None)).when((op == "p<=") & plain, s(None, cut(with_locals, 1)))
        .when(op == "p==", F.when(plain, s(cut(want, -1), cut(with_locals, 1))).otherwise(s(cut(want, -1), cut(want, 1))))
        .when(op == "p!=", F.when(plain, s(cut(want, -1), cut(with_locals, 1), True)).otherwise(s(cut(want, -1), cut(want, 1), True)))
        .when(prefix & (op == "p==*"), s(cut(low, -1), cut(high, -1))).when(prefix, s(cut(low, -1), cut(high, -1), True))
        .when((op == "p<") & final & plain, s(None, cut(_edge(want, -9), -1))).when((op == "p<") & is_prerelease(want) & plain, s(None, cut(want, -1))).when((op == "p>") & final & plain, s(cut(_edge(want, 9), 1), None))
    )


def range_stretches(bounds: Column) -> Column:
    """A range as stretches struct(lo, hi) of the order of versions, whose union it is; null if a bound is no stretch. Where
    bounds exclude stretches (!=), what is left between the holes counts, each gap for itself."""
    cuts = f"array<{CUT_TYPE}>"

    def branch(each):
        inner, holes = F.filter(each, lambda x: ~x["hole"]), F.array_sort(F.filter(each, lambda x: x["hole"]))
        lo, hi = F.array_max(F.transform(inner, lambda x: x["lo"])), F.array_min(F.transform(inner, lambda x: x["hi"]))

        def gaps(h):
            starts = F.transform(F.sequence(F.lit(0), F.size(h)), lambda i: F.array_max(F.concat(F.array(lo).cast(cuts), F.transform(F.slice(h, 1, i), lambda x: x["hi"]))))
            return F.transform(starts, lambda x, i: F.struct(x.alias("lo"), F.array_min(F.array(hi, F.get(h, i)["lo"]).cast(cuts)).alias("hi")))

        return let(holes, gaps)

    each = F.transform(bounds, lambda b: F.transform(b, _stretch))
    known = ~F.exists(F.flatten(each), lambda x: x.isNull())
    return F.when(known, F.flatten(F.transform(each, branch)))
