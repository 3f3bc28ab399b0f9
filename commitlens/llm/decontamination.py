"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, doc_id, row, pos) for every corpus word that the benchmark uses, in segments by
document, as it is written by the tasks that read the texts: no shuffle builds it. Phrases are found from the rarest
terms: each window of an item's words takes the ANCHORS terms with the fewest postings in the whole corpus; their
lists, moved back by the term's offset in the window, are intersected; what remains is a candidate start, and the
words of the document decide. A common word costs nothing unless a window has only common words.

Defined results: null text (document or item) has no words: no windows, no hits; an item of fewer than `window` words
is one window; equal windows of several items count for each; repeated rows of a doc_id are judged each by its own
text; an empty table of documents gives an empty result, an empty benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import PLAIN_WORD, lower_ascii, materialize, small

WINDOW, ANCHORS = 10, 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(PLAIN_WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """phrase (its words joined by a blank), terms, item_ids: one row for each distinct window."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("at", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {window - 1}))")))
    w = w.select("item_id", F.expr(f"slice(w, at, {window})").alias("terms"))
    return w.groupBy(F.array_join("terms", " ").alias("phrase")).agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (tid, doc_id, row, pos) of the vocabulary's terms (term, tid); pos counts from 0."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))  # the id first: beside posexplode it would count words
    posts = rows.select("doc_id", "row", F.posexplode("w").alias("pos", "term"))
    return materialize(posts.join(small(vocabulary), "term").select("tid", "doc_id", "row", "pos"), "postings")


def _anchors(windows: DataFrame, vocabulary: DataFrame, postings: DataFrame, most: int) -> DataFrame:
    """wid, tid, off, n: the rarest terms of each window all of whose terms occur in the corpus, rarest first."""
    counts = vocabulary.join(postings.groupBy("tid").agg(F.count("*").alias("n")), "tid")
    spread = windows.select("wid", "terms", F.posexplode("terms").alias("off", "term")).join(small(counts), "term")
    each = spread.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("n", "off", "tid"))).alias("list"), F.first(F.size("terms")).alias("size"))
    each = each.filter(F.size("list") == F.col("size")).withColumn("list", F.slice("list", 1, most))
    return each.select("wid", F.size("list").alias("n_anchors"), F.inline("list"))


def candidates(windows: DataFrame, vocabulary: DataFrame, postings: DataFrame, most: int = ANCHORS) -> DataFrame:
    """doc_id, row, start, wid where the offset-adjusted lists of all the window's anchors meet."""
    anchors = materialize(_anchors(windows, vocabulary, postings, most), "anchors")
    moved = postings.join(small(anchors.select("tid", "off", "wid", "n_anchors")), "tid").withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
    meet = moved.groupBy("row", "start", "wid").agg(F.count("*").alias("met"), F.first("n_anchors").alias("n_anchors"), F.first("doc_id").alias("doc_id"))
    return meet.filter("met = n_anchors").select("doc_id", "row", "start", "wid")


def _vocabulary(windows: DataFrame) -> DataFrame:
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    return materialize(terms.withColumn("tid", F.monotonically_increasing_id()), "vocabulary")


def _windows(items: DataFrame, window: int) -> DataFrame:
    return materialize(item_windows(items, window).withColumn("wid", F.monotonically_increasing_id()), "windows")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = ANCHORS) -> DataFrame:
    """For every row of docs: doc_id, n_words, spans (array of start, end (exclusive, in words), item_ids), exact."""
    wins = _windows(items, window)
    vocabulary = _vocabulary(wins)
    found = candidates(wins, vocabulary, build_index(docs, vocabulary), most)
    found = found.select("doc_id", "start", "wid").distinct().join(small(wins.select("wid", "phrase", "terms", "item_ids")), "wid")
    per_doc = found.groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_list(F.struct("start", (F.col("start") + F.size("terms")).alias("end"), "phrase", "item_ids")).alias("tries"))
    per_doc = small(materialize(per_doc, "tries"))
    held = docs.select("doc_id", "text").join(per_doc, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select("doc_id", words(F.col("text")).alias("w"), "tries")
    exact = F.expr("filter(tries, t -> t.end <= size(w) and array_join(slice(w, t.start + 1, t.end - t.start), ' ') = t.phrase)")
    spans = F.expr("array_sort(transform(spans, t -> named_struct('start', t.start, 'end', t.end, 'item_ids', t.item_ids)))")
    return held.select("doc_id", F.size("w").cast("long").alias("n_words"), F.coalesce(exact, F.expr("filter(array(named_struct('start', 0, 'end', 0, 'phrase', '', 'item_ids', array(''))), t -> false)")).alias("spans")).select("doc_id", "n_words", spans.alias("spans"))


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 5) -> DataFrame:
    """doc_id, row, near (position of the window's rarest term), phrase, item_ids: places where every distinct term of
    a window stands within window + slack words of its rarest term, in any order."""
    wins = _windows(items, window)
    vocabulary = _vocabulary(wins)
    postings = build_index(docs, vocabulary)
    rare = materialize(_anchors(wins, vocabulary, postings, 1), "anchors")
    near = postings.join(small(rare.select("tid", "wid")), "tid").select("row", "doc_id", "wid", F.col("pos").alias("near")).distinct()
    need = wins.select("wid", "phrase", "item_ids", F.array_distinct("terms").alias("terms"))
    each = need.select("wid", F.size("terms").alias("n_terms"), F.explode("terms").alias("term")).join(vocabulary, "term").select("wid", "n_terms", "tid")
    reach = window + slack
    cell = F.expr(f"pos div {reach}")
    here = postings.select("row", "tid", "pos", cell.alias("cell"))
    wanted = near.join(small(each), "wid").withColumn("cell", F.explode(F.expr(f"array(near div {reach} - 1, near div {reach}, near div {reach} + 1)")))
    met = wanted.join(here, ["row", "tid", "cell"]).filter(F.abs(F.col("pos") - F.col("near")) <= reach)
    full = met.groupBy("row", "doc_id", "wid", "near").agg(F.count_distinct("tid").alias("n"), F.first("n_terms").alias("n_terms")).filter("n = n_terms")
    return full.join(need.select("wid", "phrase", "item_ids"), "wid").select("doc_id", "row", "near", "phrase", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: phrase_matches, summed up for each document."""
    m = phrase_matches(docs, items, window)
    covered = F.expr("aggregate(spans, named_struct('upto', 0, 'n', 0), (a, s) -> named_struct('upto', greatest(a.upto, s.end), 'n', a.n + greatest(0, s.end - greatest(a.upto, s.start))), a -> a.n)")
    ids = F.array_sort(F.array_distinct(F.flatten(F.col("spans.item_ids"))))
    m = m.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), ids.alias("items"))
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
