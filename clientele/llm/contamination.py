"""Benchmark items in training documents by a positional inverted index, with DataFrame expressions only.

Words are runs of digits, small letters and anything beyond ASCII, after A-Z are lower-cased.  The index
is a written table of postings (term, row, place), in which each part holds the postings of some
documents, sorted by term, so building it moves no text between tasks.  A posting of the empty term
stands for the document itself, with the number of its words as its place.

A window is so many neighbouring words of an item, or all words of an item that has fewer.  The lists of its
two rarest terms, by the postings they have, are adjusted by the terms' offsets and intersected first; few
pairs of item, document and shift remain.  For those alone the other terms are looked up at the places where
they would have to stand, and a window occurs where all of its words do.  Equal items are searched once.

Defined cases: null texts have no words; repeated rows are documents of their own; null ids stay; an empty
table of documents gives an empty result, one of items leaves all documents clean.  Items without an id
count as hits, but are not listed; rows with one item id are listed once.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.licenses import WORD
from clientele.sources.scratch import discard, materialise

WINDOW_WORDS = 10

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The term whose posting stands for a whole document: words are never empty.
_DOCUMENT = ""


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Lower-casing as a whole is the same for ASCII texts, and faster.
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.regexp_extract_all(low, F.lit(WORD), 0)


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings ``(term, row, place, doc_id)`` of all documents, or of those ``terms`` alone.

    ``row`` numbers the documents, ``doc_id`` is set in the posting of the empty term.
    """
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words(F.col("text")).alias("words"))
    placed = given.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", F.posexplode(F.concat("words", F.array(F.lit(_DOCUMENT)))).alias("place", "term")
    )
    if terms is not None:
        wanted = terms.select("term").unionByName(docs.sparkSession.createDataFrame([(_DOCUMENT,)], "term string"))
        placed = placed.join(materialise(wanted.distinct(), "vocabulary"), "term", "left_semi")
    own = F.when(F.col("term") == _DOCUMENT, F.col("doc_id")).alias("doc_id")
    return materialise(placed.sortWithinPartitions("term", "row", "place").select("term", "row", "place", own), "postings")


class Items:
    """The distinct word sequences of items and their windows."""

    def __init__(self, benchmark: DataFrame, size: int) -> None:
        given = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
        given = given.where(F.size("words") > 0)
        sequences = given.select("words").distinct().withColumn("item", F.monotonically_increasing_id())
        #: ``(item, words)``, numbered.
        self.sequences = materialise(sequences, "sequences")
        #: ``(item, item_id)``.
        self.names = materialise(
            given.where("item_id is not null").join(self.sequences, "words").select("item", "item_id").distinct(), "names"
        )
        #: ``(item, at, term)``.
        self.terms = self.sequences.select("item", F.posexplode("words").alias("at", "term"))
        last = F.greatest(F.size("words") - size, F.lit(0))
        #: ``(item, first, size)``.
        self.windows = self.sequences.select(
            "item", F.explode(F.sequence(F.lit(0), last)).alias("first"), F.least(F.size("words"), F.lit(size)).alias("size")
        )


def _rarest(items: Items, postings: DataFrame) -> DataFrame:
    """``(item, first, size, one, two)``: the places of the two rarest terms of every window; of one word, the same."""
    held = postings.groupBy("term").agg(F.count("*").alias("n"))
    rarity = items.terms.join(held, "term", "left").select("item", "at", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    inside = items.windows.withColumn("at", F.explode(F.expr("sequence(first, first + size - 1)")))
    order = F.sort_array(F.collect_list(F.struct("n", "at")))
    ranked = inside.join(rarity, ["item", "at"]).groupBy("item", "first", "size").agg(order.alias("by"))
    # A window with a term that no document holds occurs nowhere.
    return ranked.where(F.col("by")[0]["n"] > 0).select(
        "item", "first", "size", F.col("by")[0]["at"].alias("one"), F.col("by")[F.least(F.size("by"), F.lit(2)) - 1]["at"].alias("two")
    )


def _candidates(items: Items, windows: DataFrame, postings: DataFrame) -> DataFrame:
    """``(row, item, shift, first, size)``: windows whose two rarest terms stand in a document as they do in the item."""
    both = windows.select("item", F.explode(F.array("one", "two")).alias("at"), F.least("size", F.lit(2)).alias("least"))
    asked = materialise(both.distinct().join(items.terms, ["item", "at"]), "asked")
    lists = postings.join(asked, "term").select("row", "item", (F.col("place") - F.col("at")).alias("shift"), "at", "least")
    met = lists.groupBy("row", "item", "shift", "least").agg(F.collect_list("at").alias("held")).where(F.size("held") >= F.col("least"))
    return met.join(windows, "item").where(
        F.array_contains("held", F.col("one")) & F.array_contains("held", F.col("two"))
    ).select("row", "item", "shift", "first", "size")


def _looked_up(needed: DataFrame, candidates: DataFrame, postings: DataFrame) -> DataFrame:
    """Of the needed ``(row, place, term)``, those that the index holds."""
    rows = candidates.select("row").distinct()
    return needed.join(postings.join(rows, "row", "left_semi").select("row", "place", "term"), ["row", "place", "term"])


def phrases(postings: DataFrame, items: Items) -> DataFrame:
    """``(row, item, place, first, size)``: windows that occur, at a document's place and from the item's ``first`` word on."""
    windows = materialise(_rarest(items, postings), "windows")
    candidates = materialise(_candidates(items, windows, postings), "candidates")
    key = ["row", "item", "shift"]
    needed = candidates.select(*key, F.explode(F.expr("sequence(first, first + size - 1)")).alias("at")).distinct()
    needed = needed.join(items.terms, ["item", "at"]).withColumn("place", F.col("shift") + F.col("at"))
    held = _looked_up(needed, candidates, postings).groupBy(*key).agg(F.collect_list("at").alias("held"))
    inside = F.filter("held", lambda at: (at >= F.col("first")) & (at < F.col("first") + F.col("size")))
    return candidates.join(held, key).where(F.size(inside) == F.col("size")).select(
        "row", "item", (F.col("shift") + F.col("first")).alias("place"), "first", "size"
    )


def near(postings: DataFrame, items: Items, slack: int) -> DataFrame:
    """``(row, item, place, first, size)``: windows all of whose words stand near enough in a document.

    Counted from the window's rarest term, every other word stands at most ``slack`` places before or after
    the place where the phrase has it; ``place`` is where the phrase would begin.
    """
    windows = materialise(_rarest(items, postings), "windows")
    asked = windows.join(items.terms.withColumnRenamed("at", "one"), ["item", "one"])
    key = ["row", "item", "place", "first", "size"]
    rarest = postings.withColumnRenamed("place", "_at").join(asked, "term")
    begins = materialise(
        rarest.select("row", "item", (F.col("_at") - F.col("one") + F.col("first")).alias("place"), "first", "size", "one"), "begins"
    )
    each = begins.withColumn("at", F.explode(F.expr("sequence(first, first + size - 1)")))
    away = F.explode(F.when(F.col("at") == F.col("one"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(-slack), F.lit(slack))))
    needed = each.withColumn("_away", away).join(items.terms, ["item", "at"])
    needed = needed.select(*key, "at", "term", (F.col("place") + F.col("at") - F.col("first") + F.col("_away")).alias("_place"))
    held = _looked_up(
        needed.withColumnsRenamed({"place": "_begin", "_place": "place"}), begins, postings
    ).select("row", "item", F.col("_begin").alias("place"), "first", "size", "at").distinct()
    return held.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("size")).select(*key)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``(doc_id, n_words, n_hit, items)`` per document: words inside windows that occur, and the ids of their items, sorted."""
    items = Items(benchmark, size)
    postings = build_index(docs, items.terms.select("term"))
    found = materialise(phrases(postings, items), "occurrences")
    places = found.select("row", F.explode(F.expr("sequence(place, place + size - 1)")).alias("place")).distinct()
    hits = places.groupBy("row").agg(F.count("*").alias("n_hit"))
    named = found.select("row", "item").distinct().join(items.names, "item").groupBy("row").agg(
        F.sort_array(F.collect_set("item_id")).alias("items")
    )
    every = postings.where(F.col("term") == _DOCUMENT).select("row", "doc_id", F.col("place").cast("bigint").alias("n_words"))
    done = materialise(
        every.join(hits, "row", "left").join(named, "row", "left").select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ),
        "contaminated",
    )
    discard(postings)
    return done
