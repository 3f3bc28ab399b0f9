"""Registry and advisory evidence as it stood when a commit was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitlens.functions.ranges import NUMERIC, PLAIN, inside_box, is_prerelease, is_version, let, placed_cut, placed_version, range_bounds, range_box, range_match, range_stretches, takes_prereleases, version_key, without_zeros
from commitlens.functions.versions import bare_spec, exact_form, kind_of_bare, normalize_package, value_of_bare
from commitlens.operators.quality import content_id
from commitlens.plans.scratch import dealt_rows, materialize


def plan_queries(declared: DataFrame, ecosystem: str = "npm") -> DataFrame:
    """Adds query_kind and query_value to declarations (version_spec). Each step is a column of its own, worked out once."""
    eco = F.lit(ecosystem)
    kind = declared.withColumn("bare_spec", bare_spec(eco, F.col("version_spec"))).withColumn("query_kind", kind_of_bare(eco, F.col("bare_spec")))
    return kind.withColumn("query_value", value_of_bare(eco, F.col("bare_spec"), F.col("query_kind"))).drop("bare_spec")


def discover_queries(planned: DataFrame) -> DataFrame:
    """Distinct registry queries: for each package the number of values asked of each kind."""
    q = planned.filter(F.col("query_kind").isin("exact", "range", "name_only")).select("package_name", "query_kind", "query_value").distinct()
    return q.groupBy("package_name").agg(F.count("*").alias("n_queries"), F.count_if(F.col("query_kind") == "exact").alias("n_exact"), F.count_if(F.col("query_kind") == "range").alias("n_range"), F.count_if(F.col("query_kind") == "name_only").alias("n_name_only"))


def lookup_keys(planned: DataFrame, ecosystem: str = "npm", parts: int | None = None) -> DataFrame:
    """What has to be looked up, each once: source (registry, advisory), ecosystem, package_name, query_kind, query_value. A
    registry is asked for a package, with every value that is wanted of it; advisories for a package's exact version.
    parts: how many tasks tell the distinct ones, where there are many."""
    asked = planned.filter(F.col("query_kind").isin("exact", "range", "name_only"))
    eco = F.col("ecosystem") if "ecosystem" in planned.columns else F.lit(ecosystem)
    asked = asked.select(eco.alias("ecosystem"), "package_name", "query_kind", F.coalesce("query_value", F.lit("")).alias("query_value"))
    each = (asked.repartition(parts, "package_name", "query_kind", "query_value") if parts else asked).distinct()
    source = F.explode(F.when(F.col("query_kind") == "exact", F.array(F.lit("registry"), F.lit("advisory"))).otherwise(F.array(F.lit("registry"))))
    return each.select(source.alias("source"), "ecosystem", "package_name", "query_kind", "query_value")


#: Endpoints of a package's ranges that are placed by one task, with a copy of the package's releases; releases of a block.
ENDPOINTS, BLOCK = 200_000, 256


def has_order(ecosystem: str, easy=None):
    """Whether a release (v) has a place in the order of versions. easy: whether its text is PLAIN, where that is known."""
    return (is_version(F.col("v")) if easy is None else easy | is_version(F.col("v"))) & (F.col("v").rlike(NUMERIC) if ecosystem == "Maven" else F.lit(True))


def in_index(ecosystem: str, easy=None):
    """Whether a release is in the index of plain releases (Maven: of all); most versions show it by their text."""
    return has_order(ecosystem, easy) if ecosystem == "Maven" else (F.col("v").rlike(PLAIN) if easy is None else easy) | (has_order(ecosystem) & let(version_key(F.col("v")), lambda k: ~is_prerelease(k)))


def placed_runs(asked: DataFrame, releases: DataFrame, ecosystem: str, endpoints: int = ENDPOINTS) -> tuple[DataFrame, DataFrame]:
    """(rows of releases and ends with their place `at` in their package's order of versions, for each stretch i of each range
    the run of ranks from at0 up to before at1, with the releases without a time before both ends: late0, late1; and whether
    the package has releases at all, some of them without a place in the order: there, odd).

    asked: package_name, query_value, pre, stretches. Releases and ends are sorted once, together; a running count ranks the one
    and places the other, so nothing pairs ranges with releases. A package with many ranges is dealt out by range, each part
    with a copy of its releases. Two indexes: plain releases, and all with prereleases.
    """
    index, counted = ["package_name", "pre"], ["at", "late", "mark"]
    points = lambda rows, pre: rows.select("package_name", F.lit(pre).alias("pre"), F.struct(F.lit(0).alias("side"), placed_version(F.col("v")).alias("cut")).alias("place"), "published_at", F.lit(1).alias("release"), F.col("published_at").isNull().cast("int").alias("later"))
    # a package's first row: 1, or 2 if a release has no place
    marks = releases.groupBy("package_name").agg(F.max(F.when(F.coalesce(has_order(ecosystem), F.lit(False)), 1).otherwise(2)).alias("marked"))
    parts = [points(releases.filter(in_index(ecosystem)), ecosystem == "Maven"), marks.withColumn("pre", F.lit(ecosystem == "Maven"))]
    wanted = asked.filter("pre").select("package_name").distinct()
    if ecosystem != "Maven" and not wanted.isEmpty():
        parts += [points(releases.filter(has_order(ecosystem)).join(wanted, "package_name", "left_semi"), True), marks.join(wanted, "package_name", "left_semi").withColumn("pre", F.lit(True))]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x, allowMissingColumns=True)
    many = F.broadcast(asked.groupBy(*index).agg(F.ceil(F.sum(F.size("stretches")) * 2 / endpoints).cast("int").alias("parts")).filter("parts > 1"))  # few: each has more than `endpoints` ends
    n = F.coalesce("parts", F.lit(1))
    rows = rows.join(many, index, "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts")
    # an open lower end lies before, an open upper end behind all releases
    end = lambda c, upper: F.struct(F.lit(upper).alias("upper"), F.struct(F.when(F.col(c).isNotNull(), 0).otherwise(1 if upper else -1).alias("side"), F.when(F.col(c).isNotNull(), placed_cut(F.col(c)["key"], F.col(c)["side"])).alias("cut")).alias("place"))
    ends = asked.join(many, index, "left").select(*index, F.pmod(F.xxhash64("query_value"), n).cast("int").alias("part"), "query_value", F.posexplode("stretches").alias("i", "x"))
    ends = ends.select(*index, "part", "query_value", "i", F.explode(F.array(end("x.lo", False), end("x.hi", True))).alias("e")).select(*index, "part", "query_value", "i", "e.*")
    rows = rows.unionByName(ends, allowMissingColumns=True).withColumn("h", F.xxhash64(*index))  # h: sorts packages by a number
    rows = rows.repartition(dealt_rows(releases, asked, asked), *index, "part")
    upto = Window.partitionBy("h", *index, "part").orderBy(F.coalesce("place.side", F.lit(-2)), "place.cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {"at": F.sum("release"), "late": F.sum("later"), "mark": F.max("marked")}
    placed = rows.withColumns({k: F.coalesce(c.over(upto), F.lit(0)) for k, c in sums.items()})
    placed = materialize(placed.select(*index, "part", "query_value", "i", "upper", "release", "published_at", *counted), "placed")
    ends = placed.filter("upper is not null").groupBy(*index, "part", "query_value", "i")
    both = [F.max(F.when(F.col("upper") == u, F.col(c))).alias(f"{c}{int(u)}") for c in ("at", "late") for u in (False, True)]
    return placed, ends.agg(*both, (F.max("mark") > 0).alias("there"), (F.max("mark") > 1).alias("odd"))


def count_matches(asked: DataFrame, releases: DataFrame, ecosystem: str) -> DataFrame:
    """package_name, query_value, n (more than 0): how many releases (package_name, v, key, published_at) a range of asked
    (package_name, query_value, bounds, pre, stretches) holds. A release in two stretches of a range counts once. Only the few
    ranges that are no stretches of the order are tested release by release."""
    _, runs = placed_runs(asked.filter("stretches is not null"), releases, ecosystem)
    runs = runs.filter("at1 > at0")
    before = Window.partitionBy("package_name", "pre", "query_value").orderBy("at0", "at1").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("at1") - F.greatest("at0", F.least("at1", F.coalesce(F.max("at1").over(before), F.col("at0"))))
    counted = runs.withColumn("fresh", fresh).groupBy("package_name", "query_value").agg(F.sum("fresh").alias("n"))
    odd = each_match(asked.filter("bounds is not null and stretches is null"), releases, ecosystem)
    return counted.unionByName(odd.filter("n is not null").select("package_name", "query_value", "n"))


def first_matches(asked: DataFrame, releases: DataFrame, ecosystem: str, endpoints: int = ENDPOINTS) -> DataFrame:
    """package_name, query_value, first_at, n, unordered, timeless for each range of asked (package_name, query_value, pre,
    stretches) that holds releases (package_name, v, key, published_at) or whose package has some without a place in the
    order, which make every range of their package uncertain."""
    return indexed_answers(asked, releases, ecosystem, endpoints).filter("n is not null or unordered").drop("has_history")


def indexed_answers(asked: DataFrame, releases: DataFrame, ecosystem: str, endpoints: int = ENDPOINTS, block: int = BLOCK) -> DataFrame:
    """The same for each range of asked, n null where it holds nothing, with has_history: whether its package has releases.

    A stretch is a run of ranks of its package's releases (placed_runs). Publications are kept in blocks of ranks; a run is a
    piece of its first and one of its last block, and whole blocks between, whose earliest publication is the lesser of two
    runs of a power of two that cover them, each of which is one row of a table (block, power). Most packages are one block.
    """
    placed, runs = placed_runs(asked, releases, ecosystem, endpoints)
    index, keys = ["package_name", "pre"], ["package_name", "query_value"]
    held = placed.filter("release = 1 and part = 0").withColumn("block", F.expr(f"(at - 1) div {block}"))
    cells = held.groupBy(*index, "block").agg(F.sort_array(F.collect_list(F.struct("at", "published_at"))).getField("published_at").alias("times"))
    some = F.col("at1") > F.col("at0")
    runs = runs.withColumns({"some": some, "b0": F.expr(f"at0 div {block}"), "b1": F.expr(f"(at1 - 1) div {block}"), "unordered": F.col("odd"), "has_history": F.col("there"), "timeless": some & (F.col("late1") > F.col("late0"))})
    piece = lambda b, lo, hi: F.struct(F.col(b).alias("block"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    first = F.when(F.col("some"), piece("b0", F.col("at0") - F.col("b0") * block, F.least(F.col("at1") - F.col("b0") * block, F.lit(block))))
    last = F.when(F.col("some") & (F.col("b1") > F.col("b0")), piece("b1", F.lit(0), F.col("at1") - F.col("b1") * block))
    said = ["some", "unordered", "has_history", "timeless"]
    pieces = runs.select(*index, "query_value", *said, F.explode_outer(F.array_compact(F.array(first, last))).alias("x")).select(*index, "query_value", *said, "x.*")
    found = pieces.join(cells, [*index, "block"], "left").select(*keys, *said, F.array_min(F.slice("times", F.col("lo") + 1, F.col("hi") - F.col("lo"))).alias("first_at"))
    blocks = -(-(held.agg(F.max("at")).first()[0] or 0) // block)
    if blocks > 2:
        long = cells.select(*index, "block", F.array_min("times").alias("p0")).withColumn("most", F.max("block").over(Window.partitionBy(*index))).filter("most > 1").drop("most")
        by = Window.partitionBy(*index).orderBy("block")
        for k in range(1, blocks.bit_length()):
            long = long.withColumn(f"p{k}", F.least(f"p{k - 1}", F.lead(f"p{k - 1}", 1 << (k - 1)).over(by)))
        table = long.select(*index, "block", F.posexplode(F.array(*[c for c in long.columns if c not in (*index, "block")])).alias("power", "first_at"))
        between = runs.filter("some and b1 - b0 > 1").withColumn("power", F.floor(F.log2(F.col("b1") - F.col("b0") - F.lit(0.5))).cast("int"))
        between = between.select(*index, "query_value", *said, "power", F.explode(F.array(F.col("b0") + 1, F.expr("b1 - int(shiftleft(1, power))"))).alias("block"))
        found = found.unionByName(between.join(table, [*index, "block", "power"]).select(*keys, *said, "first_at"))
    return found.groupBy(*keys).agg(F.min("first_at").alias("first_at"), F.nullif(F.count_if("some"), F.lit(0)).alias("n"), *[F.bool_or(c).alias(c) for c in said[1:]])


def numbered(df: DataFrame, *by: str) -> DataFrame:
    """With a number h of the columns by, for joins on h and them: rows are sorted by it before texts are compared."""
    return df.withColumn("h", F.xxhash64(*by))


def package_history(releases: DataFrame, ecosystem: str) -> DataFrame:
    """package_name, n releases, first_at, timeless: whether one has no time, unordered: whether one has no place in the order."""
    unordered = F.bool_or(~F.coalesce(has_order(ecosystem), F.lit(False)))
    return releases.groupBy("package_name").agg(F.min("published_at").alias("first_at"), F.count("*").alias("n"), F.bool_or(F.col("published_at").isNull()).alias("timeless"), unordered.alias("unordered"))


def range_answers(asked: DataFrame, releases: DataFrame, history: DataFrame, ecosystem: str, most: int = BLOCK) -> DataFrame:
    """What indexed_answers says. history: package_history, materialised. Ranges of a package with at most so many releases meet
    each of them, which is cheaper than the index and still in proportion to the ranges; those of larger packages are looked
    up in the index."""
    large, keys = history.filter(F.col("n") > most).select("package_name"), ["package_name", "query_value"]
    told = [F.col("unordered"), F.col("n").isNotNull().alias("has_history")]
    indexed = None
    if not large.isEmpty():
        asked, large = materialize(asked, "asked"), materialize(large, "large")
        of = lambda df, how: df.join(large, "package_name", how)
        indexed = indexed_answers(of(asked, "left_semi"), of(releases, "left_semi"), ecosystem)
        asked, releases = of(asked, "left_anti"), of(releases, "left_anti")
    end = lambda c: F.when(c.isNotNull(), placed_cut(c["key"], c["side"]))
    each = asked.select(*keys, "pre", F.explode("stretches").alias("x")).select(*keys, "pre", end(F.col("x.lo")).alias("lo"), end(F.col("x.hi")).alias("hi"))
    known = releases.withColumns({"easy": F.col("v").rlike(PLAIN), "short": without_zeros(F.col("v"))})  # each worked out once
    ordered, plain = has_order(ecosystem, F.col("easy")), in_index(ecosystem, F.col("easy"))
    known = known.select(F.col("package_name").alias("of"), F.col("published_at").alias("at"), ordered.alias("ordered"), plain.alias("plain"), placed_version(F.col("v"), F.col("easy"), F.col("short")).alias("place"))
    a, r = numbered(each, "package_name"), numbered(known, "of").withColumnRenamed("h", "rh")
    same = (F.col("h") == F.col("rh")) & (F.col("package_name") == F.col("of"))
    inside = ((F.col("pre") & F.col("ordered")) | F.col("plain")) & (F.col("lo").isNull() | (F.col("place") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("place") < F.col("hi")))
    met = a.join(r, same & inside, "left").groupBy("h", *keys).agg(F.min("at").alias("first_at"), F.nullif(F.count("of"), F.lit(0)).alias("n"), F.bool_or(F.col("of").isNotNull() & F.col("at").isNull()).alias("timeless"))
    of_package = numbered(history, "package_name").select("h", "package_name", *told)
    out = met.join(of_package, ["h", "package_name"], "left").select(*keys, "first_at", "n", F.coalesce("unordered", F.lit(False)).alias("unordered"), F.coalesce("has_history", F.lit(False)).alias("has_history"), "timeless")
    return out if indexed is None else out.unionByName(indexed)


def each_match(asked: DataFrame, releases: DataFrame, ecosystem: str) -> DataFrame:
    """The same by a test of each release of the package: for the few ranges that are no stretches of the order (=== and
    comparisons with post-releases)."""
    met = asked.withColumn("box", range_box(F.col("bounds"))).join(releases, "package_name").filter(inside_box(F.col("key"), F.col("box")))
    met = met.withColumn("hit", range_match(ecosystem, F.col("v"), F.col("key"), F.col("bounds"), F.col("pre"))).filter("hit is null or hit")
    return met.groupBy("package_name", "query_value").agg(
        F.min(F.when(F.col("hit"), F.col("published_at"))).alias("first_at"), F.nullif(F.count_if("hit"), F.lit(0)).alias("n"), F.bool_or(F.col("hit").isNull()).alias("unordered"), F.coalesce(F.bool_or(F.col("hit") & F.col("published_at").isNull()), F.lit(False)).alias("timeless"),
    )


def registry_status(planned: DataFrame, releases: DataFrame, key: list[str], ecosystem: str = "npm", lookups: DataFrame | None = None, reasons: bool = True) -> DataFrame:
    """Registry status of each planned query against the author's time, with reasons.

    What a package's history says to a query does not depend on the time, so it is worked out once for each, and each episode
    compares its own time with it. Exact values join on (package, version); a bare name sees its package's history summed up.
    A range meets its package's releases, or an index of them (range_answers); its bounds are parsed once. lookups
    (package_name, lookup_status): packages whose answer was not ok; not_found is an absence, anything else cannot be
    compared. Without lookups every package with releases was answered, and every other one with an empty history. Only
    reasons tell why an exact version is absent; without them its package's history is not looked up.
    """
    planned = materialize(planned.select(*dict.fromkeys([*key, "package_name", "query_kind", "query_value", "author_date"])), "planned")  # read by kind
    rel = materialize(releases.select("package_name", exact_form(F.col("version")).alias("v"), "published_at"), "releases").withColumn("key", version_key(F.col("v")))
    history, there = materialize(package_history(rel, ecosystem), "history"), F.lit(True).alias("has_history")
    one = numbered(rel, "package_name", "v").groupBy("h", "package_name", "v").agg(F.min("published_at").alias("first_at"), F.bool_or(F.col("published_at").isNull()).alias("timeless")).withColumns({"n": F.lit(1).cast("long"), "unordered": F.lit(False)})
    kinds = ("exact", "name_only", "range")
    exact, name, ranged = [planned.filter(F.col("query_kind") == k) for k in kinds]
    values = ranged.select("query_value").distinct().withColumn("bounds", range_bounds(ecosystem, F.col("query_value")))
    values = values.withColumn("pre", F.lit(True) if ecosystem == "Maven" else takes_prereleases(ecosystem, F.col("query_value"), F.col("bounds"))).withColumn("stretches", range_stretches(F.col("bounds")))
    values = materialize(values, "ranges")
    asked = lambda which: ranged.select("package_name", "query_value").distinct().join(values.filter(which), "query_value")
    exact = numbered(exact.withColumn("v", exact_form(F.col("query_value"))), "package_name", "v").join(one, ["h", "package_name", "v"], "left").drop("v")
    exact = exact.join(history.select("package_name", there), "package_name", "left") if reasons else exact.select("*", there)
    name = name.join(history.withColumn("unordered", F.lit(False)), "package_name", "left").withColumn("has_history", F.col("n").isNotNull())
    told, by = ["first_at", "n", "unordered", "timeless", "has_history"], ["package_name", "query_value"]
    answers = range_answers(asked("stretches is not null").drop("bounds"), rel, history, ecosystem).select(*by, *told, F.lit(False).alias("unsupported"))
    if not values.filter("bounds is null").isEmpty():
        answers = answers.unionByName(asked("bounds is null").select(*by, F.lit(True).alias("unsupported")), allowMissingColumns=True)
    if not values.filter("bounds is not null and stretches is null").isEmpty():
        odd = materialize(asked("bounds is not null and stretches is null"), "odd")
        met = odd.select(*by).join(each_match(odd, rel, ecosystem), by, "left").join(history.select("package_name", there), "package_name", "left")
        answers = answers.unionByName(met.withColumn("unsupported", F.lit(False)))
    ranged = numbered(ranged, *by).join(numbered(answers, *by), ["h", *by], "left")
    cols = [*dict.fromkeys([*key, "package_name", "query_kind", "query_value", "author_date"]), *told]
    parts = exact.select(*cols, F.lit(False).alias("unsupported")).unionByName(name.select(*cols, F.lit(False).alias("unsupported"))).unionByName(ranged.select(*cols, "unsupported"))
    parts = parts.unionByName(planned.filter(~F.coalesce(F.col("query_kind").isin(*kinds), F.lit(False))), allowMissingColumns=True)
    if lookups is not None:
        parts = parts.join(lookups.groupBy("package_name").agg(F.max("lookup_status").alias("lookup")), "package_name", "left")
    lookup = F.coalesce("lookup", F.lit("lookup_failed")) if lookups is not None else F.lit("ok")
    none, has_history = F.col("n").isNull(), F.coalesce("has_history", F.lit(False))
    out = lambda status, *why: F.struct(F.lit(status).alias("s"), F.array(*[r if not isinstance(r, str) else F.lit(r) for r in why]).cast("array<string>").alias("r"))
    absent = lambda reason: out("current_absent_unknown", "unknown_deleted_or_unpublished_possible", reason)
    decided = (
        F.when(F.col("query_kind") == "excluded", out("excluded")).when(F.col("unsupported").isNull(), out("cannot_compare"))  # no query, or not of a known kind
        .when(lookup == "not_found", absent("registry_package_not_found_at_query")).when(lookup != "ok", out("cannot_compare", F.concat(F.lit("registry_"), lookup)))
        .when(F.col("author_date").isNull(), out("cannot_compare", "author_date_missing")).when(F.col("unsupported"), out("cannot_compare", "unsupported_range_syntax")).when(~has_history, absent("registry_release_history_empty"))
        .when(none & F.col("unordered"), out("cannot_compare", "range_candidate_version_unparseable")).when(none & (F.col("query_kind") == "range"), out("no_matching_version_before_author_date", "history_validation_required"))
        .when(none, absent("registry_requested_version_absent")).when(F.col("first_at") <= F.col("author_date"), out("exists_before_author_date")).when(F.col("timeless"), out("cannot_compare", "registry_publish_time_missing"))
        .otherwise(out("published_after_author_date", "history_validation_required"))
    )
    decided = parts.select(*key, "package_name", "query_kind", "query_value", decided.alias("d"))
    found = decided.select(*key, "package_name", "query_kind", "query_value", F.col("d.s").alias("registry_status"), F.col("d.r").alias("reasons"))
    return found if reasons else found.drop("reasons")


def advisory_status(queries: DataFrame, advisories: DataFrame, key: list[str]) -> DataFrame:
    """Advisory status of queries (key, package_name, author_date) from advisories (package_name, published, withdrawn,
    hydrated, malicious): an active advisory wins, then incomplete records, then withdrawn before, then future ones."""
    asked = queries.select("package_name", "author_date").distinct()  # once for each, not for each episode
    at = F.col("author_date")
    j = asked.join(advisories, "package_name", "left")
    gone = F.col("withdrawn").isNotNull() & (F.col("withdrawn") <= at)
    active = (F.col("published") <= at) & ~gone
    a = j.groupBy("package_name", "author_date").agg(
        F.count_if(active).alias("n_active"), F.count_if(active & F.col("malicious")).alias("n_malicious"), F.count_if((F.col("published") <= at) & gone).alias("n_withdrawn"),
        F.count_if(F.col("published") > at).alias("n_future"), F.count_if(~F.col("hydrated")).alias("n_incomplete"),
    )
    status = F.when(at.isNull(), "hydration_incomplete").when(F.col("n_active") > 0, "active_before_or_at_author_date").when(F.col("n_incomplete") > 0, "hydration_incomplete").when(F.col("n_withdrawn") > 0, "withdrawn_before_author_date").when(F.col("n_future") > 0, "published_after_author_date").otherwise("none_observed")
    known = a.select(F.col("package_name").alias("k_package"), F.col("author_date").alias("k_date"), status.alias("advisory_status"), (F.col("n_malicious") > 0).alias("malicious"))
    same = F.col("package_name").eqNullSafe(F.col("k_package")) & F.col("author_date").eqNullSafe(F.col("k_date"))
    return queries.join(known, same).select(*key, "package_name", "advisory_status", "malicious")


def evidence_key(kind, ecosystem, package, query_kind=None, query_value=None):
    """The key under which evidence answers a question: of a package (registry) or of one of its queries (advisory)."""
    out = F.concat_ws("|", kind, ecosystem, package)
    return out if query_kind is None else F.when(kind == "advisory", F.concat_ws("|", kind, ecosystem, package, F.coalesce(query_kind, F.lit("")), F.coalesce(query_value, F.lit("")))).otherwise(out)


def bundle_evidence(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each query_key with payload_sha256 and evidence_id, the keys whose payloads conflict with how many).

    evidence: evidence_type, source, ecosystem, package_name, query_kind, query_value, lookup_status, queried_at, payload
    (its text). Rows of one key and one payload are one piece of evidence, the last by time and source.
    """
    e = evidence.withColumns({"query_key": evidence_key(F.col("evidence_type"), F.col("ecosystem"), F.col("package_name"), F.col("query_kind"), F.col("query_value")), "payload_sha256": F.sha2("payload", 256)})
    e = e.withColumn("evidence_id", content_id("evd", source=F.col("source"), query_key=F.col("query_key"), payload_sha256=F.col("payload_sha256")))
    kept = ["evidence_id", "evidence_type", "source", "ecosystem", "package_name", "lookup_status", "queried_at", "payload_sha256"]
    per = e.groupBy("query_key").agg(F.count_distinct("payload_sha256").alias("n_payloads"), F.max_by(F.struct(*kept), F.struct("queried_at", "source", "evidence_id")).alias("x"))
    return per.filter("n_payloads = 1").select("query_key", "x.*"), per.filter("n_payloads > 1").select("query_key", "n_payloads")


def enrich_episodes(episodes: DataFrame, bundle: DataFrame) -> DataFrame:
    """Episodes with their evidence and what it decided; state says why a row could not be enriched.

    episodes: episode_id, ecosystem, package_name, query_kind, query_value, registry_status, advisory_status (both
    not_queried), reason_codes (array), decided_registry, decided_advisory, registry_reasons, advisory_reasons. Excluded
    and unresolved ones pass unchanged. An absence that an active advisory precedes is told by its own reason.
    """
    idle = F.col("query_kind").isin("excluded", "unresolved")
    kind = lambda k: evidence_key(F.lit(k), F.col("ecosystem"), F.col("package_name"), F.col("query_kind"), F.col("query_value"))
    e = episodes.withColumns({"registry_key": F.when(~idle, kind("registry")), "advisory_key": F.when(~idle, kind("advisory"))})
    e = e.join(bundle.select(F.col("query_key").alias("registry_key"), F.col("evidence_id").alias("r")), "registry_key", "left").join(bundle.select(F.col("query_key").alias("advisory_key"), F.col("evidence_id").alias("a")), "advisory_key", "left")
    fresh = (F.col("registry_status") == "not_queried") & (F.col("advisory_status") == "not_queried")
    state = F.when(idle, "not_queryable").when(~fresh, "not_in_first_state").when(F.col("r").isNull(), "missing_registry_evidence").when(F.col("a").isNull(), "missing_advisory_evidence").otherwise("enriched")
    done = F.col("state") == "enriched"
    swap = (F.col("decided_registry") == "current_absent_unknown") & (F.col("decided_advisory") == "active_before_or_at_author_date")
    more = F.concat("registry_reasons", "advisory_reasons")
    more = F.when(swap, F.concat(F.filter(more, lambda x: x != "unknown_deleted_or_unpublished_possible"), F.array(F.lit("historical_advisory_precedes_current_absence")))).otherwise(more)
    e = e.withColumn("state", state)
    return e.select(
        "episode_id", "state", F.when(done, F.col("decided_registry")).otherwise(F.col("registry_status")).alias("registry_status"), F.when(done, F.col("decided_advisory")).otherwise(F.col("advisory_status")).alias("advisory_status"),
        F.when(done, F.array_sort(F.array_distinct(F.concat("reason_codes", more)))).otherwise(F.col("reason_codes")).alias("reason_codes"), F.when(done, F.array_sort(F.array_distinct(F.array("r", "a")))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
    )


def reuse_registry(required: DataFrame, earlier: DataFrame) -> DataFrame:
    """ecosystem, package_name, lookup_status and versions of packages of whose required versions (ecosystem,
    package_name, version) all were looked up before: earlier (ecosystem, package_name, version, package_exists,
    version_exists, published_at); the last row of a version counts, by `seq`."""
    name = normalize_package(F.col("ecosystem"), F.col("package_name"))
    asked = required.filter("trim(version) <> ''").select("ecosystem", "package_name", name.alias("canonical"), F.trim("version").alias("version")).distinct()
    rows = earlier.filter("version <> ''").select("ecosystem", name.alias("canonical"), F.trim("version").alias("version"), "package_exists", "version_exists", "published_at", "seq")
    rows = rows.groupBy("ecosystem", "canonical", "version").agg(F.max_by(F.struct("package_exists", "version_exists", "published_at"), "seq").alias("x"))
    met = asked.join(rows, ["ecosystem", "canonical", "version"], "left").groupBy("ecosystem", "package_name").agg(
        F.count_if(F.col("x").isNull()).alias("n_missing"), F.bool_and(F.coalesce(~F.col("x.package_exists"), F.lit(False))).alias("gone"),
        F.array_sort(F.collect_list(F.when(F.col("x.version_exists"), F.struct("version", F.col("x.published_at").alias("published_at"))))).alias("versions"),
    )
    return met.filter("n_missing = 0").select("ecosystem", "package_name", F.when(F.col("gone"), "not_found").otherwise("ok").alias("lookup_status"), "versions")


def reuse_advisories(queries: DataFrame, earlier: DataFrame) -> DataFrame:
    """Exact queries (ecosystem, package_name, query_value) answered before: ids (to be hydrated) or a verified empty
    answer. earlier: ecosystem, package_name, version, status, ids (array), seq; only answers with status 200 count."""
    name = normalize_package(F.col("ecosystem"), F.col("package_name"))
    rows = earlier.select("ecosystem", name.alias("canonical"), F.trim("version").alias("query_value"), "status", "ids", "seq").groupBy("ecosystem", "canonical", "query_value").agg(F.max_by(F.struct("status", "ids"), "seq").alias("x"))
    j = queries.withColumn("canonical", name).withColumn("query_value", F.trim("query_value")).join(rows, ["ecosystem", "canonical", "query_value"]).filter("x.status = '200'")
    return j.select("ecosystem", "package_name", "query_value", F.col("x.ids").alias("advisory_ids"), F.when(F.size("x.ids") > 0, "to_hydrate").otherwise("verified_zero_result").alias("reuse"))


#: Ecosystems with an advisory database.
ADVISORY_ECOSYSTEMS = ("npm", "PyPI", "crates.io", "Cargo", "Go", "Maven")


def hydrate_advisories(queries: DataFrame, hits: DataFrame, records: DataFrame) -> DataFrame:
    """Advisory answers: query_key, lookup_status, advisories (array of id, published, withdrawn, hydrated, malicious).

    queries: query_key, ecosystem, query_kind; hits: query_key, id; records: id, published, withdrawn. A query that is
    not exact or of another ecosystem is unsupported; a hit without its record makes an answer incomplete.
    """
    asks = (F.col("query_kind") == "exact") & F.col("ecosystem").isin(*ADVISORY_ECOSYSTEMS)
    full = hits.filter("id <> ''").select("query_key", "id").distinct().join(records.groupBy("id").agg(F.min(F.struct("published", "withdrawn")).alias("x")), "id", "left")
    one = F.struct("id", F.col("x.published").alias("published"), F.col("x.withdrawn").alias("withdrawn"), F.col("x").isNotNull().alias("hydrated"), F.col("id").startswith("MAL-").alias("malicious"))
    got = full.groupBy("query_key").agg(F.array_sort(F.collect_list(one)).alias("advisories"), F.bool_and(F.col("x").isNotNull()).alias("complete"))
    j = queries.join(got, "query_key", "left")
    status = F.when(~asks, "unsupported").when(F.coalesce("complete", F.lit(True)), "ok").otherwise("hydration_incomplete")
    empty = F.filter("advisories", lambda x: F.lit(False))
    return j.select("query_key", status.alias("lookup_status"), F.when(asks, F.col("advisories")).otherwise(empty).alias("advisories"))


def go_module_candidates(package):
    """The modules that may hold a Go package: its full path, then the repository's root on a known host, with /vN."""
    full = F.regexp_replace(package, "^/+|/+$", "")
    parts = F.split(full, "/")
    root = F.slice(parts, 1, F.when(F.try_element_at(parts, F.lit(4)).rlike(r"^v\d+$"), 4).otherwise(3))
    known = parts[0].isin("github.com", "gitlab.com", "bitbucket.org") & (F.size(parts) >= 3)
    return F.array_distinct(F.when(known, F.array(full, F.array_join(root, "/"))).otherwise(F.array(full)))


def resolve_go_modules(packages: DataFrame, modules: DataFrame) -> DataFrame:
    """package_name, resolved_module: the first candidate among the modules with data (module); null if none."""
    each = packages.select("package_name", F.posexplode(go_module_candidates(F.col("package_name"))).alias("place", "module"))
    return each.join(modules.select("module", F.lit(True).alias("there")).distinct(), "module", "left").groupBy("package_name").agg(F.min_by("module", F.when(F.col("there"), F.col("place"))).alias("resolved_module"))


def query_states(queries: DataFrame, attempts: DataFrame) -> DataFrame:
    """query_key, state (pending, done, retry), attempts (errors so far), last_error: from attempts (query_key, seq,
    lookup_status, error); the last attempt decides."""
    a = attempts.groupBy("query_key").agg(F.max_by(F.struct("lookup_status", "error"), "seq").alias("x"), F.count_if(F.col("lookup_status") == "error").alias("attempts"), F.max_by("error", F.when(F.col("lookup_status") == "error", F.col("seq"))).alias("last_error"))
    state = F.when(F.col("x").isNull(), "pending").when(F.col("x.lookup_status") == "error", "retry").otherwise("done")
    return queries.select("query_key").distinct().join(a, "query_key", "left").select("query_key", state.alias("state"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"), F.coalesce("last_error", F.lit("")).alias("last_error"))


def error_rate_gate(attempts: DataFrame, least: int = 500, most: float = 0.02) -> DataFrame:
    """One row: observed, errors, error_rate and whether collecting is to pause (enough seen, too many errors)."""
    n, bad = F.count("*"), F.count_if(F.col("lookup_status") == "error")
    rate = F.when(n > 0, bad / n).otherwise(F.lit(0.0))
    return attempts.agg(n.alias("observed"), bad.alias("errors"), rate.alias("error_rate"), ((n >= least) & (rate > most)).alias("pause"))

