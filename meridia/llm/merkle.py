"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

The trees are built by an associative merge of sparse forests. A fragment holds nodes of unfinished runs by level and
index; merging two fragments unites their nodes and, as the number of leaves of each tree is known, replaces a run by its
parent as soon as all its members are there. The order of merges changes nothing. Rows are range-partitioned and numbered
in the order of the leaves, so a segment of leaves leaves a few nodes a level at each of its ends, and fragments of
neighbouring segments are reduced by a tree of grouped merges, each round written to the shared folder. No fragment and
no list of roots comes to the driver. Proofs go the same way down: what stands above a fragment's nodes is handed to
the fragments that it was merged from, and in the end to the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import dropped, fields, free_name, only, shared_folder

#: Consecutive nodes that have one parent.
ARITY = 3
#: Leaves of a range partition, and the most of them.
RANGE_ROWS, MOST_RANGES = 20_000, 32_768
#: Leaves of a segment: 2 to this power. A task holds one segment.
SEGMENT_BITS = 14
#: Fragments that one merge takes: 2 to this power.
FAN_BITS = 5

Node = tuple[int, int]  # level and index


def digest(*inputs: str) -> str:
    """Lower-case hexadecimal SHA-256 of the inputs, one after the other."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def serialised(*columns: Column) -> Column:
    """The columns one after the other: `-` for null, else the number of UTF-8 bytes, a colon, and the value as text."""

    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.concat(*[one(c) for c in columns])


def run_of(node: Node, n: int, arity: int = ARITY) -> list[Node] | None:
    """The members of a node's run in a tree of n leaves; None if the node is the root."""
    level, index = node
    for _ in range(level):
        n = -(-n // arity)
    if n == 1:
        return None
    first = index - index % arity
    return [(level, i) for i in range(first, min(first + arity, n))]


def merge(fragments: Iterable[dict[Node, str]], n: int, arity: int = ARITY, seen: dict[Node, str] | None = None) -> dict[Node, str]:
    """The fragments of one tree as one, with all finished runs replaced by their parents; `seen` gets every node met."""
    nodes: dict[Node, str] = {}
    for f in fragments:
        nodes.update(f)
    if seen is not None:
        seen.update(nodes)
    by_level: dict[int, list[int]] = {}
    for level, index in nodes:
        by_level.setdefault(level, []).append(index)
    level, width = 0, n
    while width > 1 and by_level:
        made = []
        for first in {i - i % arity for i in by_level.pop(level, ())}:
            run = [(level, i) for i in range(first, min(first + arity, width))]
            if all(x in nodes for x in run):
                parent = (level + 1, first // arity)
                nodes[parent] = hashlib.sha256("".join([nodes.pop(x) for x in run]).encode()).hexdigest()
                made.append(parent[1])
                if seen is not None:
                    seen[parent] = nodes[parent]
        level, width = level + 1, -(-width // arity)
        if made:
            by_level.setdefault(level, []).extend(made)
    return nodes


def is_root(node: Node, n: int, arity: int = ARITY) -> bool:
    return run_of(node, n, arity) is None


def step(node: Node, run: list[Node], seen: dict[Node, str]) -> str:
    """A level of a proof: digests left of the node, a bar, digests right of it, a semicolon."""
    at = run.index(node)
    return "".join([seen[x] for x in run[:at]]) + "|" + "".join([seen[x] for x in run[at + 1 :]]) + ";"


def above(node: Node, n: int, arity: int, seen: dict[Node, str], known: dict[Node, str]) -> str:
    """The levels of the proof from a node up; `known` has them for nodes that weren't merged here, and keeps the others."""
    if node not in known:
        run = run_of(node, n, arity)
        known[node] = step(node, run, seen) + above((node[0] + 1, node[1] // arity), n, arity, seen, known)
    return known[node]


def siblings(proof: str) -> str:
    """The digests of a proof, level by level from left to right."""
    return proof.replace("|", "").replace(";", "")


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and a proof give."""
    for level in proof.split(";")[:-1]:
        left, _, right = level.partition("|")
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


# From here on: the trees of a table. Its leaves are numbered, and a row of `nodes` is a node that a fragment holds.

_NODE = "tree string, level int, index long, digest string, n long"
_PROOF = "tree string, level int, index long, above string"


class Forest:
    """A tree for each value of `tree` (a string; null is a value) over the rows in the order of `order`.

    `leaves` has the columns tree, digest (hexadecimal) and any others; its rows are numbered within their tree.
    """

    def __init__(self, leaves: DataFrame, order: list[str], arity: int = ARITY):
        self.spark, self.arity = leaves.sparkSession, arity
        self.folder = shared_folder(self.spark, "merkle")
        self.tables = 0
        # rows that are equal in all of the order are told apart by their place in the input, so that ranges can cut them
        uid = free_name("uid", leaves.columns)
        found = leaves.withColumn(uid, F.monotonically_increasing_id())
        first = self._written(found)
        self.rows = first.count()
        parts = min(MOST_RANGES, max(1, -(-self.rows // RANGE_ROWS)))
        keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, uid)]
        # within a partition monotonically_increasing_id() counts the sorted rows; the partition is in its upper bits
        placed = first.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).drop(uid)
        self.leaves = self._written(placed.withColumn("segment", F.shiftright("at", SEGMENT_BITS)))
        dropped(self.spark, f"{self.folder}/0")
        self.starts = self._starts()
        last = (self.leaves.agg(F.max("segment")).head()[0] or 0) >> (33 - SEGMENT_BITS)  # the number of the last partition, as it was dealt
        #: Bits that a round takes off the segment's number; the last round has one group.
        self.shifts = [0, 33 - SEGMENT_BITS]
        while last >> (self.shifts[-1] - (33 - SEGMENT_BITS)):
            self.shifts.append(self.shifts[-1] + FAN_BITS)
        self.rounds: list[DataFrame] = []  # the fragments that each round leaves, by the place of their group
        self.tops = self._merged()

    def _written(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _starts(self) -> DataFrame:
        """(segment, tree, first, before, n): where a tree begins in a segment, its leaves in segments before, and all its leaves."""
        counts = self.leaves.groupBy("segment", "tree").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
        w = Window.partitionBy("tree")
        running = F.sum("rows").over(w.orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
        return self._written(counts.select("segment", "tree", "first", (running - F.col("rows")).alias("before"), F.sum("rows").over(w).alias("n")))

    def _merged(self) -> DataFrame:
        """Reduces fragments round by round; the roots of all trees."""
        arity, tops = self.arity, None

        def of_leaves(key: tuple, rows: pa.Table, starts: pa.Table) -> pa.Table:
            out: list[tuple] = []
            for tree, n, nodes in _segment(rows, starts):
                out += [(tree, *node, d, n) for node, d in merge([nodes], n, arity).items()]
            return _nodes(key[0].as_py(), out, arity)

        def of_nodes(key: tuple, rows: pa.Table) -> pa.Table:
            out: list[tuple] = []
            for tree, (n, nodes) in _by_tree(rows).items():
                out += [(tree, *node, d, n) for node, d in merge([nodes], n, arity).items()]
            return _nodes(key[0].as_py(), out, arity)

        schema = f"place long, {_NODE}, root boolean"
        for k, shift in enumerate(self.shifts):
            if k == 0:
                found = self.leaves.select("segment", "tree", "at", "digest").groupBy("segment").cogroup(self.starts.groupBy("segment")).applyInArrow(of_leaves, schema)
            else:
                grouped = self.rounds[-1].where("NOT root").withColumn("group", F.shiftright("place", shift - self.shifts[k - 1])).drop("place", "root")
                found = grouped.groupBy("group").applyInArrow(of_nodes, schema)
            found = self._written(found)
            self.rounds.append(found)
            done = found.where("root")
            tops = done if tops is None else tops.union(done)
            if found.where("NOT root").isEmpty():
                break
        return tops.select("tree", "digest", "n")

    def proofs(self, tops: DataFrame, make: Callable[[pa.Table, list[str]], pa.Table], schema: T.StructType | str) -> DataFrame:
        """make(rows of a segment, proofs of its leaves) for all segments, where `tops` (tree, above) has what stands above each root."""
        arity, given = self.arity, None
        top = tops.select(F.col("tree").alias("__tree"), F.col("above").alias("__above"))
        for k in range(len(self.rounds) - 1, -1, -1):
            roots = self.rounds[k].where("root").join(top, F.col("tree").eqNullSafe(F.col("__tree"))).select("place", "tree", "level", "index", F.col("__above").alias("above"))
            given = roots if given is None else roots.union(given)
            if k == 0:
                break
            shift = self.shifts[k] - self.shifts[k - 1]
            inputs = self.rounds[k - 1].where("NOT root").select(F.shiftright("place", shift).alias("group"), "place", "tree", "level", "index", "digest", "n")

            def handed(key: tuple, rows: pa.Table, known: pa.Table) -> pa.Table:
                out: list[tuple] = []
                proofs, places = _known(known), {}
                for r in rows.select(["place", "tree", "level", "index"]).to_pylist():
                    places[r["tree"], (r["level"], r["index"])] = r["place"]
                for tree, (n, nodes) in _by_tree(rows).items():
                    seen: dict[Node, str] = {}
                    merge([nodes], n, arity, seen)
                    own = proofs.get(tree, {})
                    out += [(places[tree, x], tree, *x, above(x, n, arity, seen, own)) for x in nodes]
                return _table(out, f"place long, {_PROOF}")

            given = self._written(inputs.groupBy("group").cogroup(given.groupBy("place")).applyInArrow(handed, f"place long, {_PROOF}"))
        starts = self.starts.select("segment", "tree", "first", "before", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("index", "long"), ("above", "string"))])
        both = starts.unionByName(given.withColumnRenamed("place", "segment"), allowMissingColumns=True)

        def of_leaves(rows: pa.Table, more: pa.Table) -> pa.Table:
            is_start = more.column("first").is_valid()
            proofs = _known(more.filter(pc.invert(is_start)))
            of_row: list[str] = [""] * rows.num_rows
            order = pc.sort_indices(rows, [("at", "ascending")])
            rows = rows.take(order)
            at = 0
            for tree, n, nodes in _segment(rows, more.filter(is_start)):
                seen: dict[Node, str] = {}
                merge([nodes], n, arity, seen)
                own = proofs.get(tree, {})
                for node in nodes:  # leaves in order; what stands above a run is kept once
                    run = run_of(node, n, arity)
                    if node in own or run is None:
                        of_row[at] = own[node]
                    else:
                        of_row[at] = step(node, run, seen) + above((1, node[1] // arity), n, arity, seen, own)
                    at += 1
            return make(rows, of_row)

        return self.leaves.groupBy("segment").cogroup(both.groupBy("segment")).applyInArrow(of_leaves, schema)


def _segment(rows: pa.Table, starts: pa.Table) -> Iterable[tuple[str | None, int, dict[Node, str]]]:
    """For each tree of a segment, in the order of rows: its number of leaves and its leaves here."""
    order = rows.select(["at", "digest"]).sort_by("at")
    at, digests = order.column("at").to_pylist(), order.column("digest").to_pylist()
    firsts = sorted(starts.select(["first", "before", "n", "tree"]).to_pylist(), key=lambda s: s["first"])
    low = 0
    for k, s in enumerate(firsts):
        high = low
        end = firsts[k + 1]["first"] if k + 1 < len(firsts) else None
        while high < len(at) and (end is None or at[high] < end):
            high += 1
        yield s["tree"], s["n"], {(0, s["before"] + i): d for i, d in enumerate(digests[low:high])}
        low = high


def _by_tree(rows: pa.Table) -> dict[str | None, tuple[int, dict[Node, str]]]:
    out: dict[str | None, tuple[int, dict[Node, str]]] = {}
    for r in rows.select(["tree", "level", "index", "digest", "n"]).to_pylist():
        out.setdefault(r["tree"], (r["n"], {}))[1][r["level"], r["index"]] = r["digest"]
    return out


def _known(rows: pa.Table) -> dict[str | None, dict[Node, str]]:
    out: dict[str | None, dict[Node, str]] = {}
    for r in rows.select(["tree", "level", "index", "above"]).to_pylist():
        out.setdefault(r["tree"], {})[r["level"], r["index"]] = r["above"]
    return out


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = [x.split() for x in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table({name: pa.array(list(c), _ARROW[kind]) for (name, kind), c in zip(kinds, columns, strict=True)})


def _nodes(place: int, rows: list[tuple], arity: int) -> pa.Table:
    return _table([(place, *r, is_root((r[1], r[2]), r[4], arity)) for r in rows], f"place long, {_NODE}, root boolean")


def leaf_digest(columns: Iterable[Column]) -> Column:
    return F.sha2(serialised(*columns).cast("binary"), 256)


def manifest(rows: DataFrame, key: str, group: str, changed: Column | None = None, leaf: Column | None = None, arity: int = ARITY) -> DataFrame:
    """`key`, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    The leaves of a group (null is one) ascend by `key` (null first), equal keys by their digest; the groups' roots
    ascend by the group's UTF-8 bytes, null first. `leaf` is the digest of a row as recorded and `changed` that of the
    row as found, null where it wasn't touched; by default all columns in their order, and nothing changed. Repeated rows
    are leaves of their own. Other columns may have any name. An empty table gives an empty one.
    """
    thin = rows.select(F.col(key).alias("key"), F.col(group).cast("string").alias("tree"), (leaf_digest([F.col(f"`{c}`") for c in rows.columns]) if leaf is None else leaf).alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    forest = Forest(thin, ["key", "digest"], arity)
    top = Forest(forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], arity)

    def subroot_rows(found: pa.Table, proofs: list[str]) -> pa.Table:
        digests = found.column("digest").to_pylist()
        return pa.table({"tree": found.column("group"), "subroot": found.column("digest"), "above": pa.array(proofs, pa.string()), "root": pa.array([fold(d, p) for d, p in zip(digests, proofs, strict=True)], pa.string())})

    nothing = rows.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit("").alias("above"))
    subroots = top._written(top.proofs(nothing, subroot_rows, "tree string, subroot string, above string, root string"))
    # the subroot's digest and the root go down in front of its proof: nothing is joined to the leaves
    packed = subroots.select("tree", F.concat_ws(",", "above", "subroot", "root").alias("above"))
    kind = thin.schema["key"]

    def leaf_rows(found: pa.Table, proofs: list[str]) -> pa.Table:
        out: list[tuple] = []
        for d, c, p in zip(found.column("digest").to_pylist(), found.column("changed").to_pylist(), proofs, strict=True):
            proof, subroot, root = p.split(",")
            folded = fold(d if c is None else c, proof)
            out.append((d, subroot, root, digest(siblings(proof)), folded, folded == root))
        made = _table(out, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return made.add_column(0, "key", found.column("key"))

    schema = T.StructType([kind, *fields("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")])
    return forest.proofs(packed, leaf_rows, schema).withColumnRenamed("key", key)


def manifest_of_documents(docs: DataFrame) -> DataFrame:
    """The manifest of a table of documents, where every second document's text (by the CRC-32 of its id) has lost its line ends.

    A null id is never tampered with.
    """
    thin = only(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    lost = F.when(tampered & F.contains("text", F.lit("\n")), leaf_digest([*columns, F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    return manifest(thin, "doc_id", "source", changed=lost, leaf=leaf_digest([*columns, F.col("text")]))
