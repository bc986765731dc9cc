"""Vector codes, the Merkle manifest and fingerprints against plain versions written for these tests."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.llm import fingerprints, merkle, queries, vectorcodes

SF = "/root/testdata/sf0.001"

# ---- vector codes ----------------------------------------------------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd's rounds with a scan of all entries each time."""
    kept = sorted(((i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[1]))
    cut = lambda v, p: v[p * len(v) // parts : (p + 1) * len(v) // parts]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(xs) for c in zip(*xs)] if xs else e for xs, e in zip(own, books[p])]
    out, by_label = [], {}
    for i, v, lab in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, code, e, by_label[lab]) for i, code, e, lab in out), sha


def coded(spark, rows, ddl="vec_id long, embedding array<double>, label int", **more):
    table, books = vectorcodes.compress(spark.createDataFrame(rows, ddl), **more)
    found = vectorcodes.with_label_errors(table)
    return [tuple(r[c] for c in ("vec_id", "code", "error", "label_error")) for r in found.collect()], books


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(3)
    grid = [x / 8 for x in range(-12, 13)]  # few values: many ties and equal parts
    rows = [(i, [rng.choice(grid) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(300)]
    rows += [(300 + i, rows[5][1], 1) for i in range(200)]  # one vector many times
    rows += [(900, None, 1), (901, [1.0] * 15 + [None], 1), (902, [float("nan")] * 16, 2), (903, [float("inf")] + [0.0] * 15, None)]
    found, books = coded(spark, rows)
    want, sha = plain_codes(rows)
    assert sorted(found) == want and books.sha256() == sha
    assert books.scans[0] == 500 * 8 and books.scans[-1] < books.scans[0]  # bounds spare scans


def test_codes_of_small_and_odd_tables(spark):
    assert coded(spark, [])[0] == []
    one, books = coded(spark, [(7, [0.5] * 8, None)])
    assert one == [(7, "00" * 8, 0, 0)] and books.sha256() == plain_codes([(7, [0.5] * 8, None)])[1]
    few = [(i, [float(i)] * 8, i) for i in range(3)]
    assert sorted(coded(spark, few)[0]) == plain_codes(few)[0]
    assert coded(spark, [(1, [], 1)])[0] == [(1, "00" * 8, 0, 0)]
    ruled = dict((r[0], r) for r in coded(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 9, 1), (None, [1.0] * 8, 2)])[0])
    assert ruled[2] == (2, None, None, 0) and ruled[None][1] == "01" * 8
    padded, _ = coded(spark, [(i, [float(i), 1.0, 2.0], 1) for i in range(4)])
    assert {r[1][:2] for r in padded} == {"00", "01", "02", "03"} and all(r[1].endswith("00") for r in padded)
    huge = coded(spark, [(i, [1e38 * (-1) ** i] * 8, 1) for i in range(40)])[0]
    assert len(huge) == 40 and all(r[2] >= 0 for r in huge)
    clash = spark.createDataFrame([(1, [0.0] * 8, 3, "x", 9)], "vec_id long, embedding array<double>, label int, code string, v int")
    assert vectorcodes.compress(clash)[0].columns == ["vec_id", "label", "code", "error"]


def test_repeated_ids_and_decoding(spark):
    rows = [(1, [0.25] * 8, 1)] * 3 + [(1, [0.5] * 8, 1), (2, [-1.0] * 8, 2)]
    found, _ = coded(spark, rows)
    assert sorted(found) == plain_codes(rows)[0]
    table, books = vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    back = {r["code"]: r["vector"] for r in vectorcodes.decode(table, books).collect()}
    assert all(v == (books.entries[np.arange(8), list(bytes.fromhex(c))] / 4096).ravel().tolist() for c, v in back.items())


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, (400, 4, 3))
    entries, old = rng.integers(-50, 50, (4, 6, 3)), None
    own, upper, lower = np.zeros((400, 4), np.uint16), np.zeros((400, 4)), np.zeros((400, 4))
    spared = 0
    for _ in range(12):
        spared += own.size - vectorcodes.Bounds(entries, old).assign(x, own, upper, lower)
        squares = ((x[:, :, None] - entries) ** 2).sum(3)
        assert (own == squares.argmin(2)).all()
        old, entries = entries, entries + rng.integers(-2, 3, entries.shape)
    assert spared > 0


# ---- Merkle manifest -------------------------------------------------------------------------------------------------


def sha(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_tree(leaves):
    """The root and, for each leaf, the levels of (left, right) siblings."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = range(i - i % 3, min(i - i % 3 + 3, len(nodes)))
            paths[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    """doc_id, source, lang, n_chars, text."""
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha(*map(part, r))
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (own, *plain_tree([leaf(r) for r in own]))
    root, above = plain_tree([trees[s][1] for s in sources])
    out = []
    for s, top in zip(sources, above):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            proof = path + top
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf((*r[:4], text))
            for left, right in proof:
                folded = sha(left, folded, right)
            out.append((r[0], leaf(r), subroot, root, sha(*(x for lr in proof for x in lr)), folded, folded == root))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows):
    return sorted(map(tuple, merkle.manifest_of_documents(spark.createDataFrame(rows, DOCS)).collect()), key=str)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(3 * n) if rng.random() < 0.95 else None, rng.choice(["a", "a", "a", "b", "é", "", None, "c\x00d", "c,d"]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["x\ny", "", None, "über\n", "z" * 5000])) for _ in range(n)]


def test_manifest_equals_plain_trees(spark):
    rows = some_docs(150)
    rows += rows[:5] * 4  # repeated rows are leaves of their own
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_over_many_segments_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SEGMENT_BITS", 2)  # segments of 4 leaves
    monkeypatch.setattr(merkle, "RANGE_ROWS", 30)
    monkeypatch.setattr(merkle, "FAN_BITS", 1)
    rows = some_docs(200, 2)
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_small_tables(spark):
    assert manifest(spark, []) == []
    one = [(4, "s", "en", 1, "t\n")]
    assert manifest(spark, one) == plain_manifest(one)
    same = [(None, None, None, None, None)] * 11  # one row many times
    assert manifest(spark, same) == plain_manifest(same)
    clash = spark.createDataFrame([(1, "s", "en", 1, "t", 0, "x")], DOCS + ", leaf int, digest string")
    assert clash.count() == merkle.manifest_of_documents(clash).count() == 1


def test_any_column_of_a_table_can_be_a_key(spark):
    rows = spark.createDataFrame([(k, f"g{k % 4}", k * 0.5) for k in range(40)], "name long, part string, value double")
    found = merkle.manifest(rows, "name", "part").collect()
    assert len(found) == 40 and all(r["verified"] for r in found) and len({r["subroot"] for r in found}) == 4


@given(st.integers(1, 60), st.lists(st.integers(0, 5), min_size=60, max_size=60), st.randoms())
@settings(max_examples=60, deadline=None)
def test_merging_is_associative(n, owner, rng):
    """Any deal of the leaves over fragments, merged in any order, gives the root."""
    leaves = [sha(str(i)) for i in range(n)]
    fragments = [{(0, i): leaves[i] for i in range(n) if owner[i] == f} for f in range(6)]
    fragments = [merkle.merge([f], n) for f in fragments]
    while len(fragments) > 1:
        a, b = (fragments.pop(rng.randrange(len(fragments))) for _ in range(2))
        fragments.append(merkle.merge([a, b], n))
    (node, found), = fragments[0].items()
    assert found == plain_tree(leaves)[0] and merkle.is_root(node, n)


# ---- fingerprints ----------------------------------------------------------------------------------------------------

MASK = (1 << 63) - 1


def plain_hashes(text, words=5):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    hashes = [xxhash.xxh64(w.encode(), 42).intdigest() for w in found]

    def chained(hs):
        seed = 42
        for h in hs:
            seed = xxhash.xxh64(h.to_bytes(8, "little"), seed).intdigest()
        return seed & MASK

    if not found:
        return set()
    return {chained(hashes[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def plain_sketch(hashes, scale):
    ranked = sorted(hashes)
    below = [h for h in ranked if h < scale.threshold]
    kept = below if len(below) >= scale.least else ranked[: scale.least]
    bound = MASK if len(kept) == len(ranked) else max(kept[-1], scale.threshold - 1)
    return kept, bound


def plain_jaccard(a, b):
    bound = min(a[1], b[1])
    x, y = ({h for h in s[0] if h <= bound} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def shown(sketch):
    return f"{sketch[1]:X}:" + ",".join(f"{h:X}" for h in sketch[0])


def plain_edits(rows, scale):
    texts = {}
    for i, t in rows:
        t = t or ""
        h = xxhash.xxh64(t.encode(), 42).intdigest()
        texts.setdefault(i, []).append((h - (1 << 64) if h >> 63 else h, t))
    ids = sorted(texts, key=lambda i: (i is not None, i or 0))
    after = {i: min(texts[ids[(k + 1) % len(ids)]])[1] for k, i in enumerate(ids)}
    out = []
    for i, t in rows:
        t, q = t or "", len(t or "") // 4
        changed = t[: len(t) - q] + after[i][:q]
        a, b, c = (plain_sketch(plain_hashes(x, scale.words), scale) for x in (t, changed, after[i]))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), shown(a), shown(b), plain_jaccard(a, b), plain_jaccard(a, c)))
    return sorted(out, key=str)


def edits(spark, rows, scale):
    return sorted(map(tuple, fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string"), scale).collect()), key=str)


def test_fingerprints_equal_plain_sketches(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["Alpha", "beta", "γάμμα", "delta", "x", "🙂"]) + str(rng.randrange(40))
    rows = [(i * 7 % 101, " ".join(word() for _ in range(rng.choice([0, 1, 4, 5, 30, 400])))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (None, "no id at all here"), (None, "another one without"), (5, "five again"), (5, "five again"), (203, "long " * 20_000), (204, rows[3][1]), (205, rows[3][1])]
    for scale in (fingerprints.Scale(), fingerprints.Scale(words=2, one_in=3, least=4)):
        assert edits(spark, rows, scale) == plain_edits(rows, scale)


def test_fingerprints_of_small_tables(spark):
    assert edits(spark, [], fingerprints.Scale()) == []
    assert edits(spark, [(9, "abcd efgh")], fingerprints.Scale()) == plain_edits([(9, "abcd efgh")], fingerprints.Scale())
    clash = spark.createDataFrame([(1, "a b", 5, "x"), (2, "c d", 6, "y")], "doc_id long, text string, sketch int, previous string")
    assert fingerprints.edited(clash).count() == 2


def test_sketches_merge_and_measure_containment(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    long, part, other = " ".join(words), " ".join(words[500:800]), " ".join(rng.sample(words, 300))
    scale = fingerprints.Scale(words=1)
    df = spark.createDataFrame([(long, part, other)], "a string, b string, c string")
    for c in "abc":
        df = df.withColumn(f"s{c}", fingerprints.sketch(F.col(c), scale))
    both = df.withColumn("whole", fingerprints.sketch(F.concat_ws(" ", "b", "c"), scale)).withColumn("m", fingerprints.merged(F.col("sb"), F.col("sc"), scale))
    row = both.select("whole", "m", fingerprints.containment(F.col("sb"), F.col("sa")).alias("inside"), fingerprints.jaccard(F.col("sb"), F.col("sa")).alias("near"), fingerprints.from_text(fingerprints.as_text(F.col("sa"))).alias("again"), "sa").head()
    assert row["whole"] == row["m"] and row["again"] == row["sa"]
    assert row["inside"] == 1.0 and abs(row["near"] - 0.1) < 0.05


@pytest.mark.parametrize("sizes", [(3, 5), (15, 2), (40, 200), (0, 30)])
def test_merged_sketches_of_all_sizes(spark, sizes):
    scale = fingerprints.Scale(words=1, one_in=4, least=16)
    a, b = (" ".join(f"{name}{i}" for i in range(n)) for name, n in zip("ab", sizes))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a"), scale).alias("a"), fingerprints.sketch(F.col("b"), scale).alias("b"), fingerprints.sketch(F.concat_ws(" ", "a", "b"), scale).alias("w"))
    row = df.select("w", fingerprints.merged(F.col("a"), F.col("b"), scale).alias("m")).head()
    assert row["w"] == row["m"]


def test_contracts_of_the_queries(spark):
    kinds = {
        "op11_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
        "op12_merkle": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
        "op13_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    }
    for name, columns in kinds.items():
        assert dict(queries.queries()[name](spark, SF).dtypes) == columns


def test_fingerprints_stay_in_the_jvm(spark):
    found = queries.op13_fingerprints(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
