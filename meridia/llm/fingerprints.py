"""Fingerprints of documents as threshold-scaled sketches, with DataFrame operations only.

A sketch keeps every hash of a document's shingles below a fixed fraction of the range of hashes, so its size follows the
document's, and it can be compared with that of a much shorter or longer one: of two sketches, the hashes below a common
bound are a fair sample of the union of both sets. Where fewer than `least` hashes are below the fraction, the `least`
smallest are kept, so that short documents aren't left without; a sketch always holds all hashes up to its largest.
Sketches are merged by uniting them, which gives the sketch of the united sets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import only, shared_folder

#: Hashes have 63 bits, so that they order as they should.
_BITS = 63
#: Rows of a range partition when documents are numbered, and the most partitions.
RANGE_ROWS, MOST_RANGES = 20_000, 32_768


@dataclass(frozen=True)
class Scale:
    """Words of a shingle, the fraction of hashes that is kept (1 / `one_in`), and the least number kept."""

    words: int = 5
    one_in: int = 8
    least: int = 16

    @property
    def threshold(self) -> int:
        return (1 << _BITS) // self.one_in


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingle_hashes(text: Column, scale: Scale) -> Column:
    """The hash of each run of `words` words of the lower-case text, repeats included; fewer words make one shingle, none make none.

    Words are split at ASCII white space.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.xxhash64(w))

    def run(every: Column) -> Column:
        many = F.size(every)
        long = F.transform(F.sequence(F.lit(0), many - scale.words), lambda i: F.xxhash64(*[F.get(every, i + k) for k in range(scale.words)]))
        return F.when(many == 0, F.array().cast("array<bigint>")).when(many < scale.words, F.array(F.xxhash64(every))).otherwise(long)

    return F.transform(_let(each, run), lambda h: h.bitwiseAND(F.lit((1 << _BITS) - 1)))


def _kept(hashes: Column, scale: Scale) -> Column:
    """Sorted different hashes below the fraction, or the `least` smallest; and the largest of all (-1: none)."""

    def pick(every: Column) -> Column:
        below = F.sort_array(F.array_distinct(F.filter(every, lambda h: h < scale.threshold)))
        of = lambda b: F.when(F.size(b) >= scale.least, b).otherwise(F.slice(F.sort_array(F.array_distinct(every)), 1, scale.least))
        return _let(below, of)

    return _let(hashes, lambda every: F.struct(pick(every).alias("hashes"), F.coalesce(F.array_max(every), F.lit(-1)).alias("top")))


def sketch(text: Column, scale: Scale = Scale()) -> Column:
    """A struct: the sorted `hashes` that are kept, and `bound`, up to which none is missing.

    Null and empty texts, and those without a word, have no hashes and no limit to their bound.
    """
    made = _kept(shingle_hashes(F.coalesce(text, F.lit("")), scale), scale)

    def closed(k: Column) -> Column:
        last = F.coalesce(F.array_max(k["hashes"]), F.lit(-1))
        whole = last >= k["top"]
        return F.struct(k["hashes"].alias("hashes"), F.when(whole, F.lit((1 << _BITS) - 1)).otherwise(F.greatest(last, F.lit(scale.threshold - 1))).alias("bound"))

    return _let(made, closed)


def merged(a: Column, b: Column, scale: Scale = Scale()) -> Column:
    """The sketch of the united sets of two sketches of one scale."""
    bound = F.least(a["bound"], b["bound"])
    every = F.sort_array(F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h <= bound))
    # of more hashes than `least`, those beyond the fraction and the least smallest go
    cut = F.greatest(F.coalesce(F.get(every, F.lit(scale.least - 1)), F.lit((1 << _BITS) - 1)), F.lit(scale.threshold - 1))
    return F.struct(F.filter(every, lambda h: h <= cut).alias("hashes"), F.least(bound, F.when(F.coalesce(F.array_max(every), F.lit(-1)) <= cut, bound).otherwise(cut)).alias("bound"))


def _comparable(a: Column, b: Column, of: Column) -> Column:
    bound = F.least(a["bound"], b["bound"])
    return F.filter(of["hashes"], lambda h: h <= bound)


def jaccard(a: Column, b: Column) -> Column:
    """The estimated share of shingles of either set that both have; 1 if neither has one below the common bound."""
    x, y = _comparable(a, b, a), _comparable(a, b, b)
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; 1 if a has none below the common bound."""
    x, y = _comparable(a, b, a), _comparable(a, b, b)
    return F.when(F.size(x) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))


def as_text(s: Column) -> Column:
    """A sketch as text: the bound and the hashes, hexadecimal, a colon between them and commas between hashes."""
    return F.concat(F.hex(s["bound"]), F.lit(":"), F.array_join(F.transform(s["hashes"], lambda h: F.hex(h)), ","))


def from_text(fingerprint: Column) -> Column:
    """The sketch of as_text()."""
    number = lambda x: F.conv(x, 16, 10).cast("bigint")
    hashes = F.filter(F.split(F.substring_index(fingerprint, ":", -1), ","), lambda x: x != "")
    return F.struct(F.transform(hashes, number).alias("hashes"), number(F.substring_index(fingerprint, ":", 1)).alias("bound"))


def next_ids(docs: DataFrame) -> DataFrame:
    """(id, own_hash, previous, quarter) of each different doc_id of the table doc_id, text: the id before it (of the first, the last), the
    quarter of that one's longest text in code points, and the smallest hash of its own texts.

    Only ids and numbers are sorted: they are range-partitioned, written to the shared folder and numbered from the
    partitions' sizes, of which a row each comes to the driver.
    """
    spark = docs.sparkSession
    thin = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("own_hash"), F.max(F.floor(F.char_length("text") / 4)).cast("long").alias("quarter"))
    folder, numbered = shared_folder(spark, "ids"), shared_folder(spark, "ids")
    thin.write.parquet(folder)
    thin = spark.read.schema(thin.schema).parquet(folder)
    parts = min(MOST_RANGES, max(1, -(-thin.count() // RANGE_ROWS)))
    order = F.col("doc_id").asc_nulls_first()
    placed = thin.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    placed.write.parquet(numbered)
    placed = spark.read.schema(placed.schema).parquet(numbered)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    first = F.broadcast(spark.createDataFrame(starts, "part long, first long"))
    place = placed.withColumn("part", F.shiftright("at", 33)).join(first, "part").withColumn("place", F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = place.select(((F.col("place") + 1) % max(total, 1)).alias("place"), F.col("doc_id").alias("previous"), "quarter")
    return place.select("place", F.col("doc_id").alias("id"), "own_hash").join(before, "place").drop("place")


def with_next(docs: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """doc_id, text, sketch, and of the next document: `prefix` (as many code points as a quarter of the text has, or all) and `next_sketch`.

    The next document has the next larger id (null ids first), after the last comes the first, alone it is its own next. Of
    several rows with one id, that with the smallest hash of its text stands for the id; all of them have the same next.
    Null texts are empty. Texts are shuffled once; beside that, a quarter of the next text and its sketch go to each id.
    """
    base = only(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    links = next_ids(base)
    base = base.withColumn("sketch", sketch(F.col("text"), scale))
    # both joins are by id alone, so that one shuffle of the texts and sketches serves both; equality of hashes would be a second key
    given = base.join(links, F.col("doc_id").eqNullSafe(F.col("id"))).where(F.xxhash64("text").bitwiseXOR(F.col("own_hash")) == 0)
    given = given.groupBy("previous").agg(F.first(F.substring(F.col("text"), F.lit(1), F.col("quarter").cast("int"))).alias("lead"), F.first("sketch").alias("next_sketch"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    return base.join(given, F.col("doc_id").eqNullSafe(F.col("previous"))).select("doc_id", "text", "sketch", F.substring(F.col("lead"), F.lit(1), quarter).alias("prefix"), "next_sketch")


def edited(docs: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    The edited text has the last quarter of its code points (rounded down) replaced by as many (or all) of the next
    document's first. Nulls, repeated ids and the last row are as in with_next(); repeated rows have equal values; two
    texts without words are alike (1). An empty table gives an empty one; other columns are left out.
    """
    found = with_next(docs, scale)
    n = F.char_length("text")
    found = found.withColumn("changed", F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("prefix")))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("changed"), scale).alias("changed_sketch"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("changed_sketch")).alias("edited_fingerprint"),
        jaccard(F.col("sketch"), F.col("changed_sketch")).alias("near_edited"), jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
