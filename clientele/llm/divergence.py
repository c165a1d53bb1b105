"""How the terms of one source differ from those of another and from its language as a whole.

A translate table lowers letters and blanks separators of a text's UTF-8 bytes in one pass, ``bytes.split``
gives its terms, and a Counter per document their frequencies; a task adds those up per group and sends
one row per language, source and term.  Everything after that is sparse: a table holds the counts of the
terms a source has, and one shuffle by term gives both the sums of each source and those of its language.

A term's share is ``p = 1 + floor(10^9 (n + 1) / (N + V))``, for ``n`` occurrences of the term among ``N``
of all kept terms, ``V`` in number; the divergence of ``p`` from ``q`` is ``floor((p - q)^2 / q)``, summed over
all kept terms.  Most terms are missing in most sources, so the sum over all terms is taken apart:
terms neither source has add one constant each, terms of one source depend on its count alone and are
added up by count, and only terms both have are joined.  All arithmetic is on whole numbers.

Defined cases: null text, language and source count as empty; a group without terms, or a language that
keeps none, still meets the other sources of the language, with a value from the missing terms or zero.
Repeated rows count as documents of their own; ids are not read.  An empty table gives an empty result;
extra columns are ignored.  Ties go to the smaller item in UTF-8 order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.tokens import forget, slices
from clientele.operators.ranking import range_partitions
from clientele.sources.scratch import discard, materialise

#: Documents of a language that must hold a term, and ranks of the terms that stand out.
LEAST_DOCUMENTS, TERMS, SCALE = 3, 200, 1_000_000_000

#: Terms a task adds up before it sends them; sums are the same for any number.
HELD = 500_000

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters lowered, all else below 0x80 a blank.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TABLE).split()


class _Sums:
    """Occurrences and documents of the terms of every group met."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.held = 0

    def add(self, group: tuple[str, str], text: str) -> None:
        occurrences, documents = self.groups.setdefault(group, (Counter(), Counter()))
        before = len(occurrences)
        here = Counter(terms(text))
        occurrences.update(here)
        documents.update(here.keys())
        self.held += len(occurrences) - before

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row per term, and one without a term that tells that the group occurs."""
        for (lang, source), (occurrences, documents) in self.groups.items():
            n = len(occurrences) + 1
            yield pa.record_batch(
                [pa.array([lang] * n), pa.array([source] * n), pa.array([*occurrences, None], pa.string()),
                 pa.array([*occurrences.values(), 0], pa.int64()),
                 pa.array([*map(documents.__getitem__, occurrences), 0], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        self.groups, self.held = {}, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    sums = _Sums()
    for batch in slices(batches, "text"):
        columns = [batch.column(name).to_pylist() for name in ("lang", "source", "text")]
        for lang, source, text in zip(*columns, strict=True):
            sums.add((lang, source), text)
            if sums.held >= HELD:
                yield from sums.batches()
    yield from sums.batches()


def term_counts(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, of_lang, first)``: kept terms of each group; a null term stands for the group itself.

    ``of_lang`` counts the term in its language, ``first`` is true in one row of each term.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = given.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    # Dealt by term, which serves the sums of the sources and those of the language.
    dealt = found.repartition(range_partitions(docs.sparkSession), "lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    placed = counted.select(
        "lang", "source", "term", "n",
        F.sum("n").over(of_term).alias("of_lang"),
        F.sum("docs").over(of_term).alias("_docs"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"),
    )
    return placed.where(F.col("term").isNull() | (F.col("_docs") >= least_documents)).drop("_docs")


def _whole(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _div(one: Column, two: Column) -> Column:
    return F.call_function("div", one, two)


def share(n: Column, total: Column, terms: Column) -> Column:
    """``p`` of a term; null where no term is kept."""
    parts = _whole(F.nullif(total + terms, F.lit(0).cast("bigint")))
    return F.lit(1).cast("bigint") + _div(_whole(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), parts)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _groups(counts: DataFrame) -> DataFrame:
    """``(lang, source, total, terms, of_lang, none)``: sums per group and language; ``none`` is the share of a missing term."""
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = counts.groupBy("lang").agg(
        F.sum("n").alias("of_lang"), F.count_if(F.col("term").isNotNull() & F.col("first")).alias("terms")
    )
    joined = sums.join(per_lang, "lang")
    return joined.withColumn("none", share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")))


def standing_out(counts: DataFrame, groups: DataFrame, most: int = TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: terms that a source has a larger share of than its language, up to a rank."""
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("c.of_lang"), F.col("g.of_lang"), F.col("terms"))
    own = counts.where("term is not null and n > 0").alias("c").join(groups.alias("g"), ["lang", "source"])
    valued = own.select("lang", "source", F.col("term").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q")
    return _ranked(valued.select("lang", "source", "item", divergence(F.col("_p"), F.col("_q")).alias("value"))).where(
        F.col("rank") <= most
    )


def _ranked(valued: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


def between_sources(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: the divergence of a source from each other one of its language."""
    has = counts.where("term is not null and n > 0")
    shared = has.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.col("none").alias("p0")
    )
    other = shared.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = (F.col(name) for name in ("p", "p0", "q", "q0"))

    def beyond(p: Column, p0: Column, q: Column, q0: Column) -> Column:
        """What a term of both adds to what it adds as a term of each alone."""
        return divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)

    # Each pair of sources once, in both directions.
    met = shared.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(beyond(p, p0, q, q0)).alias("there"), F.sum(beyond(q, q0, p, p0)).alias("back")
    )
    both = materialise(met, "met")
    both = both.select("lang", "source", "item", F.col("there").alias("both")).unionByName(
        both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("both"))
    )

    # Terms of one source alone: equal counts give equal values.
    levels = materialise(
        has.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"])
        .select("lang", "source", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.col("none").alias("p0"), "times"),
        "levels",
    )
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"))
    met_levels = levels.join(others, "lang").where(F.col("source") != F.col("item"))
    alone = met_levels.groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * (divergence(p, q0) - divergence(p0, q0))).alias("mine"),
        F.sum(F.col("times") * (divergence(q0, p) - divergence(q0, p0))).alias("theirs"),
    )
    alone = materialise(alone, "alone")
    mine = alone.select("lang", "source", "item", "mine")
    theirs = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "theirs")

    pairs = groups.select("lang", "source", "terms", F.col("none").alias("p0")).join(others, "lang").where(
        F.col("source") != F.col("item")
    )
    key = ["lang", "source", "item"]
    zero = F.lit(0).cast("bigint")
    value = sum((F.coalesce(F.col(part), zero) for part in ("mine", "theirs", "both")), F.coalesce(F.col("terms") * divergence(p0, q0), zero))
    return _ranked(
        pairs.join(mine, key, "left").join(theirs, key, "left").join(both, key, "left").select(*key, value.alias("value"))
    )


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most: int = TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` compares sources, part ``term`` names terms that stand out."""
    counts = materialise(term_counts(docs, least_documents), "counts")
    groups = materialise(_groups(counts), "groups")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    found = [
        between_sources(counts, groups).withColumn("part", F.lit("pair")),
        standing_out(counts, groups, most).withColumn("part", F.lit("term")),
    ]
    done = materialise(found[0].select(*columns).unionByName(found[1].select(*columns)), "audit")
    discard(counts)
    return done
