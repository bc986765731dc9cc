"""Near-duplicates by MinHash signatures and an inverted join over signature coordinates.

1. Each document becomes a set of word shingles (64-bit hashes), a signature of `coordinates` minima and a parity sketch:
   bit i says whether an odd number of shingles fall on i. Equal sets are one class from here on, so copies cost a row each
   and no pairs. The exclusive or of two sketches is the sketch of the symmetric difference, and has at most as many ones as
   that has members: a bound on similarity from above that never drops a link.
2. A class is posted under its coordinate-value pairs. Two sets that must be linked agree in far more than `matches`
   coordinates (with 48 coordinates and 24 matches, a pair at similarity 0.8 is missed with probability 8e-7), so they
   share one of the first (coordinates - matches + 1) pairs of each, with rare pairs first: only that prefix is posted,
   pairs of one class alone are skipped.
3. First each class meets the head of each of its postings, and of those of its few commonest values: the class there with
   the most coordinate values in common with others. Sizes and sketches are tested and collisions counted, on 4-bit
   fingerprints of all coordinates (so never too few), and what is left is confirmed on the shingle sets. These links give
   components.
4. Classes outside of the largest component of a posting meet one member of that component, another one for each posting.
   Then classes of one posting meet again, but only across components, and only those outside of the posting's largest
   component look for partners. The join itself makes the same tests, so only pairs that pass leave it, to be confirmed. A
   link inside a component would change nothing, so none is lost.

No step gathers a posting, a group of copies or a component in one task: all are joins and partial aggregates. Pairs that
leave a join are linked or nearly so; members of a group that aren't linked are told apart by sketches, inside the join.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import dropped, mapped, Memo, only, owned, shared_folder, slices

#: Multipliers and offsets of the coordinates' hash functions come from this generator.
_SEED = 20240229
#: Shingles that are hashed for all coordinates at once.
_BLOCK = 2048
#: Bits of the parity sketch of a set, and the size of a set above which it gets a second, wider one.
_BITS, _FEW = 1024, 1500
#: Of each class's values the commonest ones, under which it looks for the head of its group.
_COMMON = 4
#: Ids that are broadcast to pick texts; more are joined.
_IDS = 1_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


@functools.cache
def _memo() -> Memo:
    owned(__name__, _memo.cache_clear)
    return Memo(lambda word: xxhash.xxh3_64_intdigest(word).to_bytes(8, "little"))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of shingles of `words` words of the whole text, as 64-bit hashes.

    A-Z are lower-cased; words are runs of other bytes than space and 0x09 to 0x0D. With fewer words the whole sequence
    is one shingle; null texts and texts without words have none.
    """
    h = np.frombuffer(b"".join(map(_memo().__getitem__, (text or "").encode("utf-8", "surrogatepass").lower().split())), "<u8")
    k = min(words, len(h))
    if not k:
        return h
    n = len(h) - k + 1
    acc = h[:n] * _M1 + np.uint64(k)
    for j in range(1, k):
        acc = (acc ^ acc >> np.uint64(31)) * _M2 + h[j : j + n] * _M1
    acc = (acc ^ acc >> np.uint64(33)) * _M3
    return np.unique(acc ^ acc >> np.uint64(29))


@functools.cache
def _functions(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 64, coordinates, np.uint64), rng.integers(0, 1 << 63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, coordinates: int) -> np.ndarray:
    """The least hash of the set for each coordinate."""
    offsets, factors = _functions(coordinates)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        x = found[at : at + _BLOCK, None] ^ offsets
        x *= factors  # the shingles are mixed already: their order by another odd factor is another random order
        np.minimum(least, x.min(0), out=least)
    return least


def sketch(found: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the number of shingles on each of `bits` bits (a power of two, 64 at least), as 64-bit integers."""
    at = (found >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def marks(sig: np.ndarray) -> np.ndarray:
    """The last 4 bits of each coordinate, 16 in a 64-bit integer."""
    low = np.zeros(-(-len(sig) // 16) * 16, np.uint64)
    low[: len(sig)] = sig.view(np.uint64) & np.uint64(15)
    return (low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def wide_bits(n: int) -> int:
    """Bits of the second sketch of a set of n shingles, for which the first is too small; 0 if it isn't."""
    return 0 if n <= _FEW else _BITS << (-(-n // _FEW) - 1).bit_length()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), kind))


def _digest(s: np.ndarray) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _sets(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            n, k1, k2, sig, mark, narrow, wide = [], [], [], [], [], [], []
            for x in b.column(1).to_pylist():
                s = shingles(x, words)
                d1, d2 = _digest(s)
                n.append(len(s))
                k1.append(d1)
                k2.append(d2)
                sig.append(signature(s, coordinates).view(np.int64))
                mark.append(marks(sig[-1]))
                narrow.append(sketch(s, _BITS))
                wide.append(sketch(s, wide_bits(len(s))) if wide_bits(len(s)) else sig[-1][:0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *(_lists(x, pa.int64()) for x in (sig, mark, narrow, wide))], names=["doc_id", "n", "k1", "k2", "sig", "mark", "narrow", "wide"])

    return mapped(docs, run, "doc_id long, n long, k1 long, k2 long, sig array<long>, mark array<long>, narrow array<long>, wide array<long>", __name__)


def _grams(texts: DataFrame, words: int) -> DataFrame:
    """(node, grams) from (node, k1, k2, text): the shingles, where the text's set is the one with these digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            node, found = [], []
            for k, k1, k2, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(x, words)
                if _digest(s) == (k1, k2):
                    node.append(k)
                    found.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), _lists(found, pa.int64())], names=["node", "grams"])

    return mapped(texts.select("node", "k1", "k2", "text"), run, "node long, grams array<long>", __name__)


def _confirm(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""
    side = lambda name: grams.select(F.col("node").alias(name), F.col("grams").alias(f"grams_{name}"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    linked = both * (100 + percent) >= (F.size("grams_a") + F.size("grams_b")) * percent
    return pairs.join(side("b"), "b").join(side("a"), "a").where(linked).select("a", "b")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): the smallest node that it reaches.

    Each round hooks a node to its smallest neighbour, follows the hooks to their ends by doubling, and joins the ends'
    edges; so the rounds grow with the logarithm of the size. Every table between rounds is written to `folder`.
    """
    spark, step = edges.sparkSession, 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal step
        step += 1
        df.write.mode("overwrite").parquet(f"{folder}/{step}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{step}")

    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = kept(edges.select("a", "b").where("a <> b").distinct())
    roots = None
    while not left.isEmpty():
        up = both(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
        up = kept(up)
        while True:  # root -> root of root, until nothing changes
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            new = kept(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = new.select("node", "root")
            if new.where("moved").isEmpty():
                break
        roots = up if roots is None else kept(roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = left.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = kept(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def _differing(x: Column, y: Column) -> Column:
    """The number of 4-bit fingerprints in which two integers differ."""
    z = x.bitwiseXOR(y)
    z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
    return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x1111111111111111)))


def _apart(x: Column, y: Column) -> Column:
    """Ones of the exclusive or of two arrays; only called on arrays of one length."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _may_link(x: str, y: str, percent: int, coordinates: int, matches: int) -> Column:
    """Whether the classes with columns under the prefixes x and y can be linked: sizes, collisions, then sketches."""
    p, q = (lambda c: F.col(x + c)), (lambda c: F.col(y + c))
    room = (p("n") + q("n")) * (100 - percent)  # a link has (100 + percent) * (members of one set only) within this
    ones = functools.reduce(Column.__add__, (F.bit_count(p("narrow")[i].bitwiseXOR(q("narrow")[i])) for i in range(_BITS // 64)))
    wide = (F.size(p("wide")) != F.size(q("wide"))) | (F.size(p("wide")) == 0) | (_apart(p("wide"), q("wide")) * (100 + percent) <= room)
    return _collide(x, y, percent, coordinates, matches) & (ones * (100 + percent) <= room) & wide


def _collide(x: str, y: str, percent: int, coordinates: int, matches: int) -> Column:
    """Whether sizes allow a link and at least `matches` fingerprints are equal."""
    p, q = (lambda c: F.col(x + c)), (lambda c: F.col(y + c))
    sizes = F.least(p("n"), q("n")) * 100 >= F.greatest(p("n"), q("n")) * percent
    apart = functools.reduce(Column.__add__, (_differing(p("mark")[i], q("mark")[i]) for i in range(-(-coordinates // 16))))
    return sizes & (apart <= coordinates - matches)


def find(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = 48, matches: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id and kept.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets. component_id is the smallest doc_id
    that a row reaches over links, itself included, and kept says that it is the row's own. Rows without shingles are
    linked with nothing. Rows with a null id get the component of their equals, if those have one, and are kept if not.
    Repeated rows are equal sets; rows of one id with different texts are one document, whose links are those of all.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "neardup")
    thin = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def cleared(*names: str) -> None:
        dropped(spark, *(f"{folder}/{name}{part}" for name in names for part in ("", "-wanted", "-grams", "-grams-once")))

    sets = kept("sets", _sets(thin, words, coordinates))
    rows = kept("rows", sets.select("doc_id", "n", "k1", "k2"))
    some = "n > 0 and doc_id is not null"
    body = [F.first(c).alias(c) for c in ("n", "sig", "mark", "narrow", "wide")]  # equal in all rows of a class
    whole = kept("whole", sets.where(some).groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), *body).withColumn("node", F.monotonically_increasing_id()))
    classes = kept("classes", whole.select("node", "id", "k1", "k2", "n"))
    cleared("sets")
    # Only sets that can be linked to a different one: a set with one shingle more or less must be able to reach `percent`.
    linkable = whole.where((F.floor(F.col("n") * 100 / percent) > F.col("n")) | (F.ceil(F.col("n") * percent / 100) < F.col("n")))
    detail = ["n", "mark", "narrow", "wide"]
    nodes = kept("nodes", linkable.select("node", *detail))

    def with_detail(pairs: DataFrame, *sides: str) -> DataFrame:
        for side in sides:
            pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", *detail)]), f"{side}_node")
        return pairs

    posted = linkable.select("node", F.explode("sig").alias("value"))
    often = posted.groupBy("value").agg(F.count("*").alias("times")).where("times > 1")
    lists = posted.join(often, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "value"))).alias("own"), (-F.sum("times")).alias("seldom"))
    first = F.size("own") - (matches - 1)
    chosen = F.filter(F.transform("own", lambda v, i: F.struct(v["value"].alias("value"), (i < first).alias("first"), (i >= F.size("own") - _COMMON).alias("common"))), lambda v: v["first"] | v["common"])
    thin_detail = ["node", "n", "mark"]
    chosen_lists = lists.where(F.size("own") >= matches).select("node", (-F.size("own")).alias("alone"), "seldom", chosen.alias("own"))
    postings = kept("postings", chosen_lists.join(nodes.select(*thin_detail), "node").select(F.explode("own").alias("v"), "alone", "seldom", *thin_detail).select("v.value", "v.first", "alone", "seldom", *thin_detail))

    cleared("whole")

    # Collisions with the heads are counted where they meet, so only pairs that have enough of them take their details.
    central = postings.groupBy("value").agg(F.min(F.struct("alone", "seldom", *thin_detail)).alias("head"))
    heads = central.select("value", *[F.col(f"head.{c}").alias(f"x_{c}") for c in thin_detail])
    y = postings.select("value", *[F.col(c).alias(f"y_{c}") for c in thin_detail])
    met = y.join(heads, "value").where((F.col("x_node") != F.col("y_node")) & _collide("x_", "y_", percent, coordinates, matches)).select("x_node", "y_node").distinct()
    star = with_detail(met, "y", "x").where(_may_link("x_", "y_", percent, coordinates, matches))
    star = kept("star", star.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))

    def confirmed(name: str, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
        wanted = kept(f"{name}-wanted", wanted.join(classes, "node").select("node", "k1", "k2", F.col("id").alias("doc_id")))
        n = wanted.count()
        grams = kept(f"{name}-grams", _grams(thin.join(F.broadcast(wanted) if n <= _IDS else wanted, "doc_id"), words))
        if grams.count() > n:  # rows of one id and text came repeatedly
            grams = kept(f"{name}-grams-once", grams.dropDuplicates(["node"]))
        return kept(f"{name}-links", _confirm(pairs, grams, percent))

    def mixed(name: str, roots: DataFrame) -> DataFrame:
        """(value, main, node, root) of the postings that have several components; `main` has the most classes there."""
        placed = postings.where("first").select("value", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = placed.groupBy("value", "root").agg(F.count("*").alias("c"))
        of = by_root.groupBy("value").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("value", F.col("top.root").alias("main"))
        return kept(name, placed.join(of, "value").select("value", "main", "root", "node"))

    links = confirmed("star", star).union(_one_document(rows.where(some), classes, kept))
    dropped(spark, *(f"{folder}/star{part}" for part in ("-wanted", "-grams", "-grams-once")))
    # One step of the way to components is enough here: a class goes with its most central linked head.
    rank = postings.select(F.col("node").alias("a"), "alone", "seldom").distinct()
    hubs = links.join(rank, "a", "left").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("alone", "seldom", "a")).alias("hub")).select("node", F.col("hub.a").alias("root"))
    placed = mixed("placed-star", hubs)
    picked = F.min(F.struct(F.xxhash64("node", "value").alias("h"), "node")).alias("pick")  # another one for each posting
    members = placed.where("root = main").groupBy("value").agg(picked).select("value", F.col("pick.node").alias("a"))
    met = placed.where("root <> main").select("value", F.col("node").alias("b")).join(members, "value").where("a <> b").select("a", "b").distinct()
    met = met.join(star, ["a", "b"], "left_anti").select(F.col("a").alias("x_node"), F.col("b").alias("y_node"))
    spread = with_detail(met, "y", "x").where(_may_link("x_", "y_", percent, coordinates, matches))
    spread = kept("spread", spread.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")))
    if not spread.isEmpty():
        links = links.union(confirmed("spread", spread))
    roots = components(links, f"{folder}/roots")
    placed = mixed("placed-spread", roots)
    cleared("placed-star")

    placed = kept("placed", with_detail(placed.select("value", "main", *[F.col(c).alias(f"y_{c}") for c in ("node", "root")]), "y"))
    x = placed.where("y_root <> main").select("value", *[F.col(f"y_{c}").alias(f"x_{c}") for c in ("node", "root", *detail)])
    across = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
    more = x.join(placed, "value").where(across & _may_link("x_", "y_", percent, coordinates, matches)).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    known_pairs = star.union(spread).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = kept("more", more.join(known_pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        new = confirmed("more", more)
        cleared("placed", "placed-spread", "more", "spread", "star")
        if not new.isEmpty():
            roots = components(links.union(new), f"{folder}/roots-more")

    linked = roots.join(classes.select("node", "id"), "node")
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    known = kept("known", classes.select("k1", "k2", "node", "id").join(linked.join(least, "root").select("node", "component"), "node", "left").select("k1", "k2", F.coalesce("component", "id").alias("root")))
    cleared("classes", "nodes", "postings", "several", "star", "star-links", "spread", "spread-links", "more", "more-links", "placed", "placed-spread", "roots", "roots-more")
    dealt = rows.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    joined = dealt.join(salted, ["k1", "k2", "salt"], "left").select("doc_id", "n", "root")
    out = joined.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("root")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("root")).alias("kept"))


def _one_document(some: DataFrame, classes: DataFrame, kept: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that tie the classes of each id that has several."""
    several = some.groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("doc_id")
    found = kept("several", some.select("doc_id", "k1", "k2").join(several, "doc_id").join(classes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node").distinct())
    first = found.groupBy("doc_id").agg(F.min("node").alias("a"))
    return found.join(first, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")


def first_of_each(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that `found` keeps; rows that were repeated with their id stay repeated, null ids stay."""
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
