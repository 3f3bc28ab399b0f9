"""Version order and ranges against an independent implementation and stated cases."""

import datetime
import itertools
import random

import pytest
from packaging.specifiers import SpecifierSet
from packaging.version import Version
from pyspark.sql import functions as F

from commitlens.functions import ranges
from commitlens.operators import evidence

TEXTS = ["1.0", "1.0.0", "1", "1.2.3", "1.10", "0.9.9", "2!1.0", "1.0a1", "1.0.b2", "1.0rc1", "1.0.dev3", "1.0a1.dev2", "1.0.post1", "1.0-2", "1.0.post1.dev4", "1.0+local.1", "1.0+2", "v3.1", "0.0", "1.2.4-beta.1", "2.0.0.0"]


def test_order(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "v string").withColumn("k", ranges.version_key(F.col("v")))
    pairs = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.v").alias("x"), F.col("b.v").alias("y"), (F.col("a.k") < F.col("b.k")).alias("lt"), (F.col("a.k") == F.col("b.k")).alias("eq")).collect()
    assert len(pairs) == len(TEXTS) ** 2
    for r in pairs:
        assert (r["lt"], r["eq"]) == (Version(r.x) < Version(r.y), Version(r.x) == Version(r.y)), r
    odd = spark.createDataFrame([("next",), ("",), (None,), ("1.0-next.1",), ("9" * 30,)], "v string")
    assert [r[0] for r in odd.select(ranges.version_key(F.col("v"))).collect()] == [None] * 5


def test_pep440(spark):
    specs = ["", ">=1,<2", "==1.0", "==1.*", "!=1.0", "!=1.*", "~=1.2", "~=1.2.3", ">1.0", "<1.0", "<=1.0", ">=1.0a1", "==1.0+local.1", "<1.0rc1", ">1.0.post1", "===1.0", "== 2.0.0", ">=1.0,!=1.10"]
    df = spark.createDataFrame(list(itertools.product(TEXTS, specs)), "v string, s string")
    df = df.withColumn("b", ranges.range_bounds("PyPI", F.col("s")))
    hit = ranges.range_match("PyPI", F.col("v"), ranges.version_key(F.col("v")), F.col("b"), ranges.takes_prereleases("PyPI", F.col("s"), F.col("b")))
    # prereleases only where the specifiers name one; newer releases of the library fall back to them
    want = lambda v, s: SpecifierSet(s).contains(v, prereleases=True) and (not Version(v).is_prerelease or not s or bool(SpecifierSet(s).prereleases))
    wrong = [(r.v, r.s, r.hit) for r in df.withColumn("hit", hit).collect() if r.hit != want(r.v, r.s)]
    assert not wrong
    bad = spark.createDataFrame([("nope",), (">=",), ("~=1",), ("1.0",)], "s string").select(ranges.range_bounds("PyPI", F.col("s"))).collect()
    assert [r[0] for r in bad] == [None] * 4


def semver_ranges():
    """Ranges with what they mean: (ecosystem, text, test of a version's numbers), out of the rules of each form."""
    for a, b, c in itertools.product((0, 1, 3), repeat=3):
        at = (a, b, c)
        top = (a + 1, 0, 0) if a else (0, b + 1, 0) if b else (0, 0, c + 1)
        for eco in ("npm", "Cargo"):
            yield eco, f"^{a}.{b}.{c}", lambda v, at=at, top=top: at <= v < top
            yield eco, f"~{a}.{b}.{c}", lambda v, at=at: at <= v < (at[0], at[1] + 1, 0)
            yield eco, f"{a}.{b}.*", lambda v, at=at: v[:2] == at[:2]
            yield eco, f">={a}.{b}.{c}, <{a + 2}.0.0", lambda v, at=at: at <= v < (at[0] + 2, 0, 0)
            yield eco, f"={a}.{b}.{c}", lambda v, at=at: v == at
        yield "npm", f"{a}.{b}.{c}", lambda v, at=at: v == at
        yield "Cargo", f"{a}.{b}.{c}", lambda v, at=at, top=top: at <= v < top
        yield "npm", f"{a}.x", lambda v, a=a: v[0] == a
        yield "npm", f"{a}", lambda v, a=a: v[0] == a
        yield "npm", f"{a}.{b}.{c} - {a + 1}.{c}.{b}", lambda v, at=at: at <= v <= (at[0] + 1, at[2], at[1])
        yield "npm", f"<{a}.{b}.{c} || >{b}.{c}.{a}", lambda v, at=at: v < at or v > (at[1], at[2], at[0])
        yield "Maven", f"[{a}.{b},{c}.{a})", lambda v, a=a, b=b, c=c: (a, b, 0) <= v < (c, a, 0)
        yield "Maven", f"(,{a}.{b}.{c}]", lambda v, at=at: v <= at


@pytest.mark.parametrize("eco", ["npm", "Cargo", "Maven"])
def test_matches(spark, eco):
    each = {s: f for e, s, f in semver_ranges() if e == eco}
    grid = list(itertools.product(range(5), repeat=3))
    df = spark.createDataFrame([(s,) for s in each], "s string").withColumn("b", ranges.range_bounds(eco, F.col("s")))
    df = df.join(spark.createDataFrame([(list(v), ".".join(map(str, v))) for v in grid], "at array<int>, v string"))
    hit = ranges.range_match(eco, F.col("v"), ranges.version_key(F.col("v")), F.col("b"), ranges.takes_prereleases(eco, F.col("s"), F.col("b")))
    got = {(r.s, r.v): r.hit for r in df.select("s", "v", hit.alias("hit")).collect()}
    assert got == {(s, ".".join(map(str, v))): f(v) for s, f in each.items() for v in grid}


def test_prereleases_and_versions_without_order(spark):
    cases = [(">=1.0.0", "2.0.0-rc.1", False), (">=1.0.0-alpha", "2.0.0-rc.1", True), ("*", "7.0.0-alpha.0", False), ("*", "latest", None), ("<2.0.0", "", None)]
    df = spark.createDataFrame(cases, "s string, v string, want boolean").withColumn("b", ranges.range_bounds("npm", F.col("s")))
    hit = ranges.range_match("npm", F.col("v"), ranges.version_key(F.col("v")), F.col("b"), ranges.takes_prereleases("npm", F.col("s"), F.col("b")))
    assert [r.hit for r in df.withColumn("hit", hit).collect()] == [c[2] for c in cases]
    maven = spark.createDataFrame([("[1.0,9.0)", "1.5-SNAPSHOT")], "s string, v string").withColumn("b", ranges.range_bounds("Maven", F.col("s")))
    assert maven.select(ranges.range_match("Maven", F.col("v"), ranges.version_key(F.col("v")), F.col("b"), F.lit(True))).first()[0] is None


def test_unsupported(spark):
    for eco, s in (("npm", ">=1 <"), ("npm", "next"), ("npm", "1.0.0 ||"), ("npm", "x.1"), ("Maven", "[1.0]"), ("Maven", "[a,b)"), ("Go", "v1")):
        assert spark.createDataFrame([(s,)], "s string").select(ranges.range_bounds(eco, F.col("s"))).first()[0] is None, (eco, s)


def some_specs(r, eco, versions):
    v = lambda: r.choice(versions)
    if eco == "PyPI":
        one = lambda: r.choice([">=", "<=", "==", "!=", ">", "<", "~="]) + r.choice(["1.0", "1.2.3", "2.0", "0.9", "1.0a1", "1.0.post1", "1.0+local.1", "2!1.0"])
        return [",".join([one() for _ in range(r.randint(1, 4))] + r.choice([[], ["!=1.*"], ["==1.0.*"], ["!=1.2.*", "!=1.*"], ["===1.0"], [">0"]])) for _ in range(60)] + ["", ">1.0rc1", "<1.0.post1", "==0.*", "!=1.0,!=1.2.3"]
    if eco == "Maven":
        return [f"{r.choice('[(')}{r.choice(['', '1.0', '0.9'])},{r.choice(['', '1.2.3', '2.0'])}{r.choice('])')}" for _ in range(20)]
    return [" ".join(r.choice(["^", "~", ">=", "<", "<=", ">", "="]) + v() for _ in range(r.randint(1, 2))) + r.choice(["", " || ^3.0.0", " || 1.x", " || 0.9.0 - 1.1.0"]) for _ in range(60)] + ["*", "1.x", "1", "^1.0.0-a"]


@pytest.mark.parametrize("eco", ["npm", "Cargo", "Maven", "PyPI"])
@pytest.mark.parametrize("endpoints", [3, 10**6])
def test_first_matches(spark, eco, endpoints):
    """What the index says of each range, against a test of each release; some packages dealt out in many parts."""
    r = random.Random(f"{eco}{endpoints}")
    days = [None, *[datetime.date(2020, 1, i) for i in range(1, 29)]]
    pool = [t for t in TEXTS if eco == "PyPI" or "post" not in t] + ["1.3.0", "0.0.4", "1.0.1", "3.1.4", "1.2.0-rc.1", "3.0.0-beta", "odd", "1.0.5"]
    releases = [(f"p{k}", v, r.choice(days)) for k in range(12) for v in r.sample([p for p in pool if k % 3 or p != "odd"], r.randint(1, 24))]
    rel = spark.createDataFrame(releases, "package_name string, v string, published_at date").withColumn("key", ranges.version_key(F.col("v")))
    asked = spark.createDataFrame(sorted({(f"p{k}", s) for k in range(13) for s in some_specs(r, eco, ["1.0.0", "1.2.3", "0.9.9", "2.0.0", "1.0.0-a1"])}), "package_name string, query_value string")
    asked = asked.withColumn("bounds", ranges.range_bounds(eco, F.col("query_value"))).filter("bounds is not null")
    asked = asked.withColumn("pre", F.lit(True) if eco == "Maven" else ranges.takes_prereleases(eco, F.col("query_value"), F.col("bounds"))).withColumn("stretches", ranges.range_stretches(F.col("bounds"))).cache()
    straight = asked.filter("stretches is not null")
    assert straight.count() > 0.5 * asked.count() > 10
    hit = ranges.range_match(eco, F.col("v"), F.col("key"), F.col("bounds"), F.col("pre"))
    want = straight.join(rel, "package_name").withColumn("hit", hit).groupBy("package_name", "query_value").agg(F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.col("published_at"))).alias("at"), F.bool_or(F.col("hit") & F.col("published_at").isNull()).alias("timeless"), F.bool_or(F.col("hit").isNull()).alias("unordered"))
    want = {(x.package_name, x.query_value): (x.n > 0, x.at, bool(x.timeless), x.unordered) for x in want.collect() if x.n or x.unordered}
    got = {(x.package_name, x.query_value): (bool(x.n), x.first_at, x.timeless, x.unordered) for x in evidence.first_matches(straight, rel, eco, endpoints).collect()}
    assert got == want


@pytest.mark.parametrize("eco", ["npm", "PyPI"])
def test_count_matches(spark, eco):
    """Counts out of the index against a test of each release; branches that overlap count a release once."""
    r = random.Random(eco)
    pool = [t for t in TEXTS if eco == "PyPI" or "post" not in t] + ["1.3.0", "3.1.4", "3.0.0-beta", "odd"]
    rel = spark.createDataFrame([(f"p{k}", v, "2020-01-01") for k in range(6) for v in r.sample(pool, 15)], "package_name string, v string, published_at string").withColumn("key", ranges.version_key(F.col("v")))
    specs = some_specs(r, eco, ["1.0.0", "0.9.9", "2.0.0"]) + ([">=0.1 || ^1.0.0 || 1.x", "* || 1.x", "<2.0.0 || >=1.0.0"] if eco == "npm" else [])
    asked = spark.createDataFrame(sorted({(f"p{k}", s) for k in range(7) for s in specs}), "package_name string, query_value string").withColumn("bounds", ranges.range_bounds(eco, F.col("query_value"))).filter("bounds is not null")
    asked = asked.withColumn("pre", ranges.takes_prereleases(eco, F.col("query_value"), F.col("bounds"))).withColumn("stretches", ranges.range_stretches(F.col("bounds"))).cache()
    hit = ranges.range_match(eco, F.col("v"), F.col("key"), F.col("bounds"), F.col("pre"))
    want = asked.join(rel, "package_name").groupBy("package_name", "query_value").agg(F.count_if(hit).alias("n")).filter("n > 0")
    assert sorted(map(tuple, evidence.count_matches(asked, rel, eco).collect())) == sorted(map(tuple, want.collect()))


def test_a_version_is_tested_once(spark):
    """e4 tests its ranges for each version, whatever the number of packages that have it."""
    from commitlens.plans import queries as core
    from commitlens.plans import table_queries  # noqa: F401

    plan = core.queries()["e4_prereleases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "forall" not in plan


@pytest.mark.parametrize("eco", ["npm", "Maven", "PyPI"])
def test_range_answers(spark, eco):
    """Ranges that meet their package's releases, those of large packages in the index, and runs over many blocks, against a
    test of each release; packages without releases and with odd versions too."""
    r = random.Random(eco)
    days = [None, *[datetime.date(2020, 1, i) for i in range(1, 29)]]
    pool = [t for t in TEXTS if eco == "PyPI" or "post" not in t] + ["1.3.0", "0.0.4", "1.0.1", "3.1.4", "1.2.0-rc.1", "3.0.0-beta", "odd", "1.0.5", "10.0.0", "1.10.0", "01.2.0"]
    releases = [(f"p{k}", v, r.choice(days)) for k in range(9) for v in r.sample([p for p in pool if k % 3 or p != "odd"], r.randint(1, 24))] + [("q", "odd", days[1])]
    rel = spark.createDataFrame(releases, "package_name string, v string, published_at date").withColumn("key", ranges.version_key(F.col("v"))).cache()
    asked = spark.createDataFrame(sorted({(p, s) for p in ["q", *[f"p{k}" for k in range(10)]] for s in some_specs(r, eco, ["1.0.0", "1.2.3", "0.9.9", "2.0.0", "1.0.0-a1"])}), "package_name string, query_value string")
    asked = asked.withColumn("bounds", ranges.range_bounds(eco, F.col("query_value"))).filter("bounds is not null")
    asked = asked.withColumn("pre", F.lit(True) if eco == "Maven" else ranges.takes_prereleases(eco, F.col("query_value"), F.col("bounds"))).withColumn("stretches", ranges.range_stretches(F.col("bounds"))).filter("stretches is not null").cache()
    hit = ranges.range_match(eco, F.col("v"), F.col("key"), F.col("bounds"), F.col("pre"))
    want = asked.join(rel, "package_name", "left").withColumn("hit", hit & F.col("v").isNotNull()).groupBy("package_name", "query_value").agg(F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.col("published_at"))).alias("at"), F.bool_or(F.col("hit") & F.col("published_at").isNull()).alias("timeless"), F.bool_or(F.col("v").isNotNull() & F.col("hit").isNull()).alias("unordered"), (F.count("v") > 0).alias("there"))
    want = {(x.package_name, x.query_value): (x.n > 0, x.at, bool(x.timeless), x.unordered, x.there) for x in want.collect()}
    say = lambda df: {(x.package_name, x.query_value): (bool(x.n), x.first_at, x.timeless, x.unordered, x.has_history) for x in df.collect()}
    history = evidence.package_history(rel, eco).cache()
    for most in (10, 256):
        assert say(evidence.range_answers(asked, rel, history, eco, most)) == want
    assert say(evidence.indexed_answers(asked, rel, eco, 10**6, block=2)) == want


def test_places_sort_like_keys(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "0", "0.0", "00.1.0", "1.10", "10", "1!0", "no", None]], "v string").withColumn("key", ranges.version_key(F.col("v")))
    df = df.select("v", "key", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side")).withColumn("cut", F.when(F.col("key").isNotNull(), ranges.cut(F.col("key"), 0).withField("side", F.col("side"))))
    df = df.withColumn("place", F.when(F.col("side") == 0, ranges.placed_version(F.col("v"))).when(F.col("key").isNotNull(), ranges.placed_cut(F.col("key"), F.col("side")))).cache()
    assert df.filter("(place is null) <> (key is null)").count() == 0 and df.filter(ranges.is_version(F.col("v")) != F.col("key").isNotNull()).count() == 0
    a, b = df.select(F.col("cut").alias("c"), F.col("place").alias("p")), df.select(F.col("cut").alias("d"), F.col("place").alias("q"))
    assert a.join(b, F.lit(True)).filter("(c < d) <> (p < q) or (c = d) <> (p = q)").count() == 0
