"""Shards of nearly equal size by sampled splitters, with DataFrame operations only.

Records are ordered by a key (a hash of the text, so equal texts stand together), then by document id and by their place in
the table, so no two records share a place. A sample in which a record's chance grows with its size gives quantiles of
the order as splitters of many fine ranges. The ranges'
exact sizes are summed; overfull ones get more splitters from a denser sample of their own rows until each is small, or
one record. Ranges of one key are one unit. Large units go to the emptiest shards, largest first, and the other ranges
fill the room that is left, in order. Only a key that fits into no shard's room is cut. Only a sample of records (about the
draws that were asked for, whatever repeats), splitters and one row for each range come to the driver: their number
follows from the parameters, not from the data.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import only, shared_folder

#: Bytes of a record besides its text.
OVERHEAD = 8
#: Splitters that are compared at once when a record's range is looked up.
_STEP = 40


@dataclass
class Plan:
    shards: int
    splitters: list[str]  # ascending; range r holds the places from splitters[r - 1] on, before splitters[r]
    shard: list[int]  # of each range
    first_slot: list[int]  # of each range: rows of its shard's ranges before it


def _records(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    thin = only(docs, doc_id=doc_id, text=text)
    place = F.concat(F.lpad(F.hex(F.xxhash64(t)), 16, "0"), F.lpad(F.coalesce(F.hex(F.col("doc_id").cast("long")), F.lit("")), 16, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    return thin.select("doc_id", (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), place.alias("place"))


def _range_of(place: Column, splitters: list[str]) -> Column:
    """The number of splitters at or before `place`, found in two steps."""
    if not splitters:
        return F.lit(0)

    def array(xs: list[str]) -> Column:
        return F.split(F.lit(",".join(xs)), ",")  # folded to a constant

    many = array(splitters)
    coarse = F.size(F.filter(array(splitters[::_STEP]), lambda s: s <= place))
    fine = F.size(F.filter(F.slice(many, F.greatest(coarse - 1, F.lit(0)) * _STEP + 1, F.lit(_STEP)), lambda s: s <= place))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * _STEP + fine)


def _sample(rows: DataFrame, total: int, draws: int, seed: int) -> list[tuple[str, float]]:
    """Places and weights of a sample of at most about `draws` rows that are drawn by size, in order."""
    share = total / draws
    chance = F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    got = rows.where(chance * share < F.col("size")).select("place", F.greatest(F.col("size").cast("double"), F.lit(share)).alias("w")).collect()
    return sorted((r["place"], r["w"]) for r in got)


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    """Places that begin about `parts` parts of equal weight."""
    total, done, cuts = sum(w for _, w in sample), 0.0, []
    for place, w in sample:
        if int(done * parts / total) < int((done + w) * parts / total):
            cuts.append(place)
        done += w
    return cuts


def _key_start(place: str) -> str:
    return place[:16] + "0" * 16


def _key_end(place: str) -> str:
    return place[:16] + "G"  # after all places of the key: hexadecimal digits end at F


def _finer(r: dict, sample: list[tuple[str, float]], most: float) -> set[str]:
    """More splitters inside an overfull range; at least its last key or record is split off."""
    parts = max(2, round(2 * r["size"] / most))
    if r["low"][:16] == r["high"][:16]:
        return {r["high"], *_quantiles(sample, parts)}
    weight: dict[str, float] = {}
    for place, w in sample:
        weight[place[:16]] = weight.get(place[:16], 0.0) + w
    heavy = {k for k, w in weight.items() if w > most / 2}
    return {_key_start(r["high"]), *map(_key_start, _quantiles(sample, parts)), *map(_key_start, heavy), *map(_key_end, heavy)}


def plan_records(rows: DataFrame, shards: int, fine: int = 48, draws_per_range: int = 6, seed: int = 5) -> Plan:
    """plan() from the table of records(), which is read once for each round."""
    rows = rows.select("place", "size")
    total = rows.agg(F.sum("size")).head()[0] or 0
    if not total:
        return Plan(shards, [], [0], [0])
    parts = shards * fine
    cuts = sorted({*map(_key_start, _quantiles(_sample(rows, total, parts * draws_per_range, seed), parts))})
    most = 2 * total / parts
    while True:
        placed = rows.withColumn("range", _range_of(F.col("place"), cuts))
        got = [r.asDict() for r in placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).collect()]
        over = [r for r in got if r["size"] > most and r["low"] != r["high"]]
        if not over:
            break
        seed += 1
        more = placed.where(F.col("range").isin([r["range"] for r in over]))
        of: dict[int, list] = {}
        for place, w in _sample(more, sum(r["size"] for r in over), parts * draws_per_range, seed):
            of.setdefault(bisect_right(cuts, place), []).append((place, w))
        cuts = sorted({*cuts, *(x for r in over for x in _finer(r, of.get(r["range"], []), most))})
    found = {r["range"]: r for r in got}
    shard = _packed([found.get(r) for r in range(len(cuts) + 1)], shards, total / shards, most)
    return Plan(shards, cuts, shard, _first_slots(shard, {r: x["n"] for r, x in found.items()}, shards))


def _first_slots(shard: list[int], counts: dict[int, int], shards: int) -> list[int]:
    """For each range the rows of its shard's ranges before it."""
    first, rows_of = [0] * len(shard), [0] * shards
    for r, to in enumerate(shard):
        first[r] = rows_of[to]
        rows_of[to] += counts.get(r, 0)
    return first


def _packed(ranges: list[dict | None], shards: int, target: float, most: float) -> list[int]:
    """The shard of each range: `target` bytes a shard, but for what no finer range could mend."""
    units: list[tuple[list[int], int]] = []  # ranges of one key, and their size
    last = None
    for r, x in enumerate(ranges):
        key = x["low"][:16] if x and x["low"][:16] == x["high"][:16] else None
        if key is not None and key == last:
            units[-1] = (units[-1][0] + [r], units[-1][1] + x["size"])
        elif x:
            units.append(([r], x["size"]))
        last = key if x else last
    load, shard = [0.0] * shards, [0] * len(ranges)

    def put(own: list[int], size: float, to: int) -> None:
        load[to] += size
        for r in own:
            shard[r] = to

    small = [u for u in units if u[1] <= most]
    for own, size in sorted((u for u in units if u[1] > most), key=lambda u: (-u[1], u[0])):
        to = min(range(shards), key=lambda s: (load[s], s))
        if load[to] + size <= target + most:
            put(own, size, to)
        else:  # it fits nowhere: its ranges are units of their own
            small += [([r], ranges[r]["size"]) for r in own]
    rooms = [max(0.0, target - x) for x in load]
    scale = sum(size for _, size in small) / (sum(rooms) or 1)
    to, edge, done = 0, rooms[0] * scale, 0.0
    for own, size in sorted(small, key=lambda u: u[0]):
        while to < shards - 1 and done + size / 2 >= edge:
            to += 1
            edge += rooms[to] * scale
        put(own, size, to)
        done += size
    return shard


def records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and place of each row, written to the shared folder: texts are read once, and a row's place stays."""
    spark, found = docs.sparkSession, _records(docs, doc_id, text)
    folder = shared_folder(spark, "records")
    found.write.mode("overwrite").parquet(folder)
    return spark.read.schema(found.schema).parquet(folder)


def plan(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", fine: int = 48, draws_per_range: int = 6, seed: int = 5) -> Plan:
    """Chooses the splitters and the shard of each range. `fine` ranges a shard.

    Equal texts go to one shard, as long as they fit into its room; an empty table has one range. Rows of equal id and text
    are records of their own: ranges and shards can part them where they are too many.
    """
    return plan_records(records(docs, doc_id, text), shards, fine, draws_per_range, seed)


def assign(docs: DataFrame, p: Plan, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law has none) of every row of `docs`.

    Null texts count as empty (8 bytes). Null ids are allowed; of rows repeated with their id and text any may take any of their
    slots. Slots of a shard are numbered without gaps: each range numbers its own rows, on from the rows of the ranges before.
    """
    rows = records(docs, doc_id, text)
    counts = {r["range"]: r["n"] for r in rows.groupBy(_range_of(F.col("place"), p.splitters).alias("range")).agg(F.count("*").alias("n")).collect()}  # a row a range
    return assign_records(rows, replace(p, first_slot=_first_slots(p.shard, counts, p.shards)))


def assign_records(rows: DataFrame, p: Plan) -> DataFrame:
    """assign() from the table of records()."""
    rows = rows.withColumn("range", _range_of(F.col("place"), p.splitters))
    pick = lambda xs: F.element_at(F.split(F.lit(",".join(map(str, xs))), ","), F.col("range") + 1).cast("long")
    number = F.row_number().over(Window.partitionBy("range").orderBy("place", "size")) - 1
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), pick(p.shard).cast("int").alias("shard"), (pick(p.first_slot) + number).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, p: Plan, folder: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes all columns of `docs` as Parquet, a folder a shard; a task holds one range, not a shard.

    Null texts and ids, repeated rows and ties are placed as by assign(); an empty table writes no shard. Columns of `docs`
    called `shard` are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    place = F.concat(F.lpad(F.hex(F.xxhash64(t)), 16, "0"), F.lpad(F.coalesce(F.hex(F.col(doc_id).cast("long")), F.lit("")), 16, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
    placed = docs.withColumn("__place", place).withColumn("__range", _range_of(F.col("__place"), p.splitters)).drop("__place")
    shard = F.element_at(F.split(F.lit(",".join(map(str, p.shard))), ","), F.col("__range") + 1).cast("int")
    placed.repartition("__range").withColumn("shard", shard).drop("__range").write.mode("overwrite").partitionBy("shard").parquet(folder)
