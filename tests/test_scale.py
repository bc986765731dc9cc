"""Operators for large tables against plain versions: variant files, wide axes, neighbour descent, components, OPTICS, running totals."""

import gzip
import math
import os
import pickle
import random
import tempfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meridia.functions import projections
from meridia.operators import clusters, descent, embedding, genotype, neighbors, notches, optics, outliers, resample, samples, spatial, summary, wide
from meridia.sources import bgzf, files, shapefiles, variants
from meridia.sources import testviews as tv

SF = "/root/testdata/sf0.001"

# ---- block-compressed files ------------------------------------------------------------------------------------------


def blocks_of(text: bytes, size: int) -> bytes:
    return b"".join(bgzf.deflated(text[i : i + size]) for i in range(0, len(text), size)) + bgzf.EMPTY_BLOCK


@given(st.lists(st.text("ab\t", max_size=12), max_size=40), st.integers(1, 60), st.integers(1, 400), st.booleans())
@settings(max_examples=80, deadline=None)
def test_ranges_have_each_line_once(lines, size, step, ended):
    """However a file is cut into blocks and ranges, with or without a last line end."""
    text = "\n".join(lines).encode() + (b"\n" if ended else b"")
    want = text.split(b"\n")[: -1 if text.endswith(b"\n") or not text else None]
    for data, suffix in ((blocks_of(text, size), ".gz"), (text, "")):
        with tempfile.NamedTemporaryFile(suffix=suffix) as f:
            f.write(data)
            f.flush()
            source = bgzf.Source(f.name)
            got = [x for at in range(0, max(1, source.size), step) for x in source.lines(at, min(at + step, source.size))]
            source.close()
        assert got == want


def test_blocks_are_gzip_and_broken_ones_are_found(tmp_path):
    data = os.urandom(200_000)
    whole = b"".join(bgzf.deflated(data[i : i + bgzf.BLOCK_BYTES]) for i in range(0, len(data), bgzf.BLOCK_BYTES)) + bgzf.EMPTY_BLOCK
    assert gzip.decompress(whole) == data
    with pytest.raises(ValueError):
        bgzf.inflated(whole[:40] + bytes([whole[40] ^ 1]) + whole[41 : bgzf.block_size(whole[:64])])
    path = tmp_path / "x.gz"
    path.write_bytes(b"\x1f\x8b\x08\x04 no block here" + whole)  # what looks like a head isn't one
    assert bgzf.Source(str(path)).first_block(0) == len(b"\x1f\x8b\x08\x04 no block here")


@given(st.lists(st.tuples(st.integers(0, 1 << 27), st.integers(1, 1 << 18)), min_size=1, max_size=60), st.integers(0, 1 << 27), st.integers(1, 1 << 20))
@settings(max_examples=60, deadline=None)
def test_index_finds_all_records_of_a_region(spans, begin, width):
    spans = sorted(spans)
    index = bgzf.Index()
    places = [(i << 30, (i << 30) + 100) for i in range(len(spans))]  # far apart, so that each record is a chunk
    for (a, n), (first, last) in zip(spans, places):
        index.add("s", a, a + n, first, last)
    for own in (index, bgzf.Index.load(index.dump())):
        found = own.chunks("s", begin, begin + width)
        for (a, n), (first, last) in zip(spans, places):
            if a < begin + width and a + n > begin:
                assert any(x <= first and last <= y for x, y in found)
    assert all(bgzf.bin_of(a, a + n) in bgzf.bins_over(a, a + n) for a, n in spans)


@pytest.fixture(scope="module")
def written(spark):
    """A folder of files, the lines, and what the text reader makes of them."""
    rng = random.Random(4)
    names = [f"s{i}" for i in range(9)]
    lines = []
    for chrom in ("1", "2", "X"):
        for pos in sorted(rng.sample(range(1, 900_000), 120)):
            alt = rng.choice(["C", "C", "C", "G,T", "."])
            cells = [rng.choice(["0/0", "0|1", "1/1:7", "./.", ".", "1", "./1:3"]) for _ in names]
            lines.append((chrom, pos, "\t".join([chrom, str(pos), f"r{pos}", "A", alt, ".", "PASS", f"END={pos + 40_000}" if pos % 7 == 0 else ".", "GT:DP", *cells])))
    folder = tempfile.mkdtemp()
    df = spark.createDataFrame(lines, "chrom string, pos long, line string").repartition(5)
    variants.write(df, variants.header(names), f"file://{folder}/v", 4)
    plain = f"{folder}/plain.vcf"
    with open(plain, "w") as f:
        f.write(variants.header(names) + "\n" + "\n".join(x for _, _, x in lines) + "\n")
    return folder, plain, sorted(map(tuple, files.vcf(spark, plain).collect()), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_variants_equal_the_text_reader(spark, written):
    folder, plain, want = written
    variants.joined(f"file://{folder}/v", f"file://{folder}/one.vcf.gz")
    with open(f"{folder}/gz.vcf.gz", "wb") as f:
        f.write(gzip.compress(open(plain, "rb").read()))
    for path in (f"file://{folder}/v", f"file://{folder}/one.vcf.gz", plain, f"{folder}/gz.vcf.gz"):
        for size in (1 << 25, 2500):
            assert rows_of(variants.read(spark, path, size)) == want
    assert variants.read(spark, f"file://{folder}/one.vcf.gz", 1000).rdd.getNumPartitions() > 3
    assert gzip.open(f"{folder}/one.vcf.gz").read().count(b"#CHROM") == 1
    assert sorted(gzip.open(f"{folder}/one.vcf.gz").read().split(b"\n")) == sorted(open(plain, "rb").read().split(b"\n"))


@pytest.mark.parametrize("where", ["chrom = '2' AND pos BETWEEN 200000 AND 420000", "pos < 50000", "chrom IN ('1', 'X') AND pos >= 700000 AND sample = 's4'", "sample IN ('s1', 's8') AND a1 = 1", "chrom = 'none'", "chrom > '1' AND pos = 5"])
def test_filters_give_the_same_rows(spark, written, where):
    folder, plain, _ = written
    want = rows_of(files.vcf(spark, plain).where(where))
    for path in (f"file://{folder}/v", f"file://{folder}/one.vcf.gz", plain):
        assert rows_of(variants.read(spark, path, 3000).where(where)) == want


def test_filters_reach_the_scan_and_spare_ranges(spark, written):
    folder, _, _ = written
    variants.joined(f"file://{folder}/v", f"file://{folder}/two.vcf.gz")
    some = variants.read(spark, f"file://{folder}/two.vcf.gz").where("chrom = '2' AND pos <= 40000 AND sample = 's3'")
    assert "PushedFilters: [IsNotNull(chrom), IsNotNull(pos)" in some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    wanted = variants.Wanted(chroms={"2"}, low=1, high=40_000)
    assert sum(r.end - r.start for r in variants.ranges(f"file://{folder}/v", 1 << 25, wanted)) < sum(p["size"] for p in variants.files_of(f"file://{folder}/v"))


def test_variant_files_that_are_none(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("no header\n")
    with pytest.raises(Exception, match="no #CHROM line"):
        variants.read(spark, str(tmp_path / "a.vcf")).collect()
    with pytest.raises(Exception, match="no such file"):
        variants.read(spark, str(tmp_path / "b.vcf")).collect()
    (tmp_path / "c.vcf").write_text(variants.header(["x"]))
    assert variants.read(spark, str(tmp_path / "c.vcf")).count() == 0
    (tmp_path / "d.vcf").write_text(variants.header([]) + "\n1\t5\t.\tA\tC\t.\t.\t.\n")
    assert variants.read(spark, str(tmp_path / "d.vcf")).count() == 0


def test_records_of_calls(spark):
    calls = spark.createDataFrame([("1", 5, None, "A", "C", "s1", 0, 1), ("1", 5, None, "A", "C", "s1", 0, 1), ("1", 9, "x", "A", None, "s2", None, None)], "chrom string, pos long, id string, ref string, alt string, sample string, a1 int, a2 int")
    assert sorted(r["line"] for r in variants.records(calls, ["s1", "s2"]).collect()) == ["1\t5\t.\tA\tC\t.\tPASS\t.\tGT\t0/1\t./.", "1\t9\tx\tA\t.\t.\tPASS\t.\tGT\t./.\t./."]


# ---- axes of wide tables ---------------------------------------------------------------------------------------------


def long_table(spark, x):
    n, p = x.shape
    return spark.createDataFrame([(i, j, int(x[i, j]) if x[i, j] >= 0 else None) for i in range(n) for j in range(p) if x[i, j] > -2], "sample long, locus long, dosage int")


def test_wide_pca_equals_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (50, 130))
    x[rng.random(x.shape) < 0.05] = -1
    x[rng.random(x.shape) < 0.05] = -2  # pairs that are not there
    x[:, 7] = -1  # a locus without calls
    z = np.where(x < 0, np.nan, x).astype(float)
    z[:, 7] = 0
    z = np.nan_to_num(z - np.nanmean(z, 0))
    u, s, v = np.linalg.svd(z, full_matrices=False)
    e = wide.embed(long_table(spark, x), "pca", 4, rows=20, cols=40)
    assert np.allclose(e.singular, s[:4], rtol=1e-9) and np.allclose(e.shares, s[:4] ** 2 / (s**2).sum(), rtol=1e-9)
    got = np.array([r["features"] for r in e.samples.orderBy("sample").collect()])
    loci = np.array([r["features"] for r in e.loci.orderBy("locus").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :4] * s[:4]), atol=1e-6) and np.allclose(z @ loci, got, atol=1e-6)
    assert (loci[np.abs(loci).argmax(0), range(4)] > 0).all()


def test_wide_mca_equals_that_of_sums(spark):
    x = np.random.default_rng(2).integers(0, 3, (40, 30))
    rows = spark.createDataFrame([(i, r.astype(float).tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    want, values = embedding.mca(rows, 3)
    e = wide.embed(long_table(spark, x), "mca", 3, rows=16, cols=8)
    assert np.allclose(e.shares, values[:3], rtol=1e-9)
    a, b = (np.array([r["features"] for r in t.collect()]) for t in (want.orderBy("id"), e.samples.orderBy("sample")))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6)


def test_wide_axes_of_odd_tables(spark):
    ddl = "sample long, locus long, dosage int"
    none = wide.embed(spark.createDataFrame([], ddl))
    assert none.samples.count() == 0 and len(none.singular) == 0
    flat = wide.embed(spark.createDataFrame([(i, j, 1) for i in range(3) for j in range(4)], ddl))
    assert len(flat.singular) == 0 and flat.samples.count() == 3
    low = wide.embed(spark.createDataFrame([(i, j, 2 * (i % 2)) for i in range(6) for j in range(5)], ddl), k=4)  # one direction only
    assert low.singular[0] > 1 and np.allclose(low.singular[1:], 0, atol=1e-6)
    with pytest.raises(ValueError):
        wide.embed(spark.createDataFrame([(1, 1, 3)], ddl), "mca")


# ---- neighbours by descent -------------------------------------------------------------------------------------------


def test_descent_finds_nearly_all_neighbours(spark):
    v = tv.vectors(spark, "/root/testdata/sf0.01")
    found = descent.nearest(v, 10)
    exact = neighbors.nearest_vectors(v, 10)
    assert descent.recall(found, exact).head()[0] >= 0.95
    per = found.groupBy("id").agg(F.count("*").alias("n"), F.max("rank").alias("m"), F.count_if(F.col("id") == F.col("nbr_id")).alias("own"))
    assert per.where("n <> 10 or m <> 10 or own > 0").isEmpty()


def test_descent_of_small_and_equal_rows(spark):
    ddl = "id long, features array<double>"
    assert descent.nearest(spark.createDataFrame([(1, [0.0]), (2, None)], ddl), 3).count() == 0
    three = descent.nearest(spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], ddl), 3)
    assert sorted((r["id"], r["nbr_id"], r["rank"], r["dist"]) for r in three.collect()) == [(1, 2, 1, 1.0), (1, 3, 2, 5.0), (2, 1, 1, 1.0), (2, 3, 2, 4.0), (3, 2, 1, 4.0), (3, 1, 2, 5.0)][0:4] + [(3, 1, 2, 5.0), (3, 2, 1, 4.0)]
    same = descent.nearest(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], ddl), 4)
    assert same.groupBy("id").count().where("count <> 4").isEmpty() and same.agg(F.max("dist")).head()[0] == 0


def test_descent_meets_by_block(spark):
    """Vectors go to a block once, in single precision about their mean; pairs that leave a block are the best of each row."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x + 1e8)], "id long, features array<double>")
    exact = neighbors.nearest_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate((x + 1e8) - 1e8)], "id long, features array<double>"), 5)
    assert descent.recall(descent.nearest(df, 5), exact).head()[0] >= 0.95
    table = spark.createDataFrame([(i, v.astype(np.float32).tobytes()) for i, v in enumerate(np.concatenate([x, np.tile(x[:1], (900, 1))]))], "id long, v binary")
    sizes = [r["count"] for r in descent._placed(table, 200, 2400, 8, 0).groupBy("block").count().collect()]
    assert sum(sizes) == 2400 and max(sizes) < 320 and len(sizes) <= 24  # equal rows are dealt over blocks
    of, to, dist = descent._cut([(np.array([1, 1, 2]), np.array([5, 3, 4]), np.array([0.5, 0.5, 1.0])), (np.array([1, 1]), np.array([9, 5]), np.array([0.1, 0.7]))], 2)
    assert (of.tolist(), to.tolist(), dist.tolist()) == ([1, 1, 2], [9, 3, 4], [0.1, 0.5, 1.0])


# ---- components and OPTICS -------------------------------------------------------------------------------------------


def plain_components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def test_components_of_a_long_path_and_a_random_graph(spark, monkeypatch):
    rng = random.Random(1)
    path = list(range(10_000))
    rng.shuffle(path)
    tables = []
    monkeypatch.setattr(clusters, "_stars", lambda e: tables.append(1) or e.select("a", "b"))  # without what tasks tie at once
    edges = list(zip(path, path[1:]))
    got = {r[0]: r[1] for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(10_000), 0) and len(tables) <= 2 * math.log2(10_000)
    monkeypatch.undo()
    edges = [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1200)] + [(5000, 5000)]
    for held in (clusters.HELD_NODES, 20):
        monkeypatch.setattr(clusters, "HELD_NODES", held)
        assert {r[0]: r[1] for r in clusters.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()} == plain_components(edges)
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def km(a, b):
    (x, y), (u, v) = (map(math.radians, p) for p in (a, b))
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2)))


def plain_optics(points, least, most):
    """The classic walk: order, reachability and core distance of each point."""
    ids = sorted(points)
    near = {p: sorted((km(points[p], points[q]), q) for q in ids if km(points[p], points[q]) <= most) for p in ids}
    core = {p: near[p][least - 1][0] if len(near[p]) >= least else None for p in ids}
    reach, order, done = dict.fromkeys(ids, math.inf), [], set()
    for start in ids:
        if start in done:
            continue
        queue = {start}
        while queue:
            p = min(queue, key=lambda q: (reach[q], q))
            queue.remove(p)
            done.add(p)
            order.append(p)
            if core[p] is not None:
                for d, q in near[p]:
                    if q not in done:
                        reach[q] = min(reach[q], max(core[p], d))
                        queue.add(q)
    return order, reach, core


@pytest.mark.parametrize("least", [1, 3, 5])
def test_optics_labels_equal_the_walk(spark, least):
    rng = random.Random(least)
    points = {i: (rng.gauss(10 * (i % 4), 1.5), rng.gauss(50, 1.5)) for i in range(120)} | {200 + i: (rng.uniform(-40, 60), rng.uniform(20, 70)) for i in range(30)} | {300 + i: (3.0, 48.0) for i in range(8)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(999, None, 1.0)], "id long, x double, y double")
    order, reach, core = plain_optics(points, least, 600.0)
    found = optics.optics(df, least, 600.0)
    assert found.forest.count() <= found.places.count() - 1
    for radius in (60.0, 150.0, 600.0):
        labels, now = {}, -1
        for p in order:  # the walk's clusters at a radius
            if reach[p] > radius:
                now = p if core[p] is not None and core[p] <= radius else None
            labels[p] = now
        got = {r["id"]: r["label"] for r in optics.labels(found, radius).collect()}
        assert got.pop(999) == -1
        cores = [p for p in points if core[p] is not None and core[p] <= radius]
        pairs = {(labels[p], got[p]) for p in cores}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # the same clusters of cores
        assert all(min(p for p in cores if got[p] == got[q]) == got[q] for q in cores)
        for p in set(points) - set(cores):
            inside = [(max(core[q], km(points[p], points[q])), q) for q in cores if km(points[p], points[q]) <= radius]
            assert got[p] in ({got[q] for w, q in inside if w <= min(inside)[0] + 1e-9} if inside else {-1})
    with pytest.raises(ValueError):
        optics.labels(found, 700.0)


# ---- orders without one task -----------------------------------------------------------------------------------------


def test_running_totals_equal_plain_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.random(), rng.randrange(9)) for _ in range(2000)]
    got = summary.running_totals(spark.createDataFrame(rows, "g string, o double, v long").repartition(7), ["g"], ["o"], "v", "upto").collect()
    assert len(got) == 2000
    for g in ("a", "b", None):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["o"]):
            total += r["v"]
            assert r["upto"] == total


def test_quantiles_with_nan_and_infinities_are_the_same_on_both_ways(spark):
    inf, nan = math.inf, math.nan
    rng = np.random.default_rng(1)
    shares = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0]
    for extra in ([nan], [inf, -inf], [-inf] * 40, [nan] * 300 + [inf] * 9 + [-inf], [1e308, -1e308]):
        values = [*rng.normal(size=400).tolist(), *extra]
        df = spark.createDataFrame([(x,) for x in values], "v double")
        a, b = summary.quantiles(df, "v", shares), summary.quantiles(df, "v", shares, few=0)
        assert all((math.isnan(x) and math.isnan(y)) or x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b)), (extra[:3], a, b)


def test_picks_and_splits_have_no_limit_over_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("sample"), (F.col("id") % 3).alias("cluster"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    marked = samples.choose_unknown(df, 0.25)
    assert marked.where("not is_known").count() == 750
    parts = samples.split(df, 0.8, 0.1, F.xxhash64("sample"))
    for plan in (marked, parts):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in text and "SinglePartition" not in text
    counts = Counter((r["cluster"], r["split"]) for r in parts.collect())
    assert all(counts[c, s] == n for c in range(3) for s, n in (("train", 800), ("val", 51), ("test", 149)))  # 0.8 + 0.1 / 2 lies above 0.85


# ---- bootstrapped notches --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("draw", ["hash", "modulo"])
def test_bootstrap_equals_plain_resampling(spark, monkeypatch, draw):
    monkeypatch.setattr(notches, "PART_ROWS", 60)
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), rng.choice([rng.random(), 0.5])) for i in range(400)] + [(500, "c", 2.0), (501, "d", None), (502, "d", math.nan)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    for share in (0.5, 0.9):
        got = {(r["g"], r["replicate"]): r["q"] for r in notches.bootstrap(df, "id", "v", ["g"], share, 40, 3, draw).collect()}
        w = notches.weights(np.array([r[0] for r in rows]), 40, 3, draw)
        want = {}
        for g in "abcd":
            for rep in range(40):
                values = [v for (i, own, v), n in zip(rows, w[:, rep]) for _ in range(n) if own == g and v is not None and not math.isnan(v)]
                if values:
                    want[g, rep] = np.quantile(values, share)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    whole = notches.notch(df, "id", "v", replicates=40, seed=3, draw=draw).collect()
    assert len(whole) == 1 and whole[0]["low"] <= 0.5 <= whole[0]["high"]
    assert notches.notch(df.where("v is null"), "id", "v", replicates=5).count() == 0


def test_weights_are_poisson():
    w = notches.weights(np.arange(20_000), 30, 1, "hash")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.05 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.7


# ---- shapefiles and projections --------------------------------------------------------------------------------------


def test_transverse_mercator_both_ways():
    tm = projections.utm(15)
    rng = np.random.default_rng(3)
    lon, lat = rng.uniform(-123, -63, 500), rng.uniform(-84, 84, 500)
    back = tm.inverse(*tm.forward(lon, lat))
    assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)
    assert np.allclose(tm.forward(np.array([-93.0]), np.array([0.0])), [[500_000], [0]], atol=1e-6)
    # along the meridian the northing is the arc of the ellipse
    e2 = tm.f * (2 - tm.f)
    phi = np.linspace(0, np.radians(47.3), 200_001)
    m = tm.a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = ((m[1:] + m[:-1]) / 2 * np.diff(phi)).sum()
    assert math.isclose(tm.forward(np.array([-93.0]), np.array([47.3]))[1][0], 0.9996 * arc, abs_tol=1e-3)
    # it is conformal: a small step east and one north have one scale and are at right angles
    h = 1e-6
    x, y = tm.forward(np.array([-90.0, -90.0 + h, -90.0]), np.array([41.0, 41.0, 41.0 + h]))
    nu, rho = tm.a / math.sqrt(1 - e2 * math.sin(math.radians(41)) ** 2), tm.a * (1 - e2) / (1 - e2 * math.sin(math.radians(41)) ** 2) ** 1.5
    east, north = np.array([x[1] - x[0], y[1] - y[0]]) / (nu * math.cos(math.radians(41))), np.array([x[2] - x[0], y[2] - y[0]]) / rho
    assert np.allclose(east @ north / (np.linalg.norm(east) * np.linalg.norm(north)), 0, atol=1e-5) and math.isclose(np.linalg.norm(east), np.linalg.norm(north), rel_tol=1e-5)


UTM_PRJ = 'PROJCS["WGS_1984_UTM_Zone_15N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-93.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def square(x, y, r, clockwise=True):
    ring = [(x - r, y - r), (x - r, y + r), (x + r, y + r), (x + r, y - r), (x - r, y - r)]
    return ring if clockwise else ring[::-1]


def test_shapefiles_equal_their_geojson_twin(spark, tmp_path):
    import json

    maps = [({"STATEFP": "05", "NAME": "Plain"}, [square(-93, 35, 2)]), ({"STATEFP": "05", "NAME": "Inseln über"}, [square(-91, 34, 1), square(-91, 34, 0.4, False), square(-95, 31, 1), square(-91, 34, 0.2)]), ({"STATEFP": "48", "NAME": ""}, [square(-90, 41, 1)])]
    twin = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"STATEFP": "05", "NAME": "Plain"}, "geometry": {"type": "Polygon", "coordinates": [maps[0][1][0]]}},
        {"type": "Feature", "properties": {"STATEFP": "05", "NAME": "Inseln über"}, "geometry": {"type": "MultiPolygon", "coordinates": [[maps[1][1][0], maps[1][1][1]], [maps[1][1][2]], [maps[1][1][3]]]}},
        {"type": "Feature", "properties": {"STATEFP": "48", "NAME": None}, "geometry": {"type": "Polygon", "coordinates": [maps[2][1][0]]}},
    ]}
    (tmp_path / "t.geojson").write_text(json.dumps(twin))
    tm = projections.utm(15)
    plane = [(a, [list(zip(*(v.tolist() for v in tm.forward(*np.array(r).T)))) for r in rings]) for a, rings in maps]
    for name, content in (("degrees.zip", shapefiles.packed(maps)), ("plane.zip", shapefiles.packed(plane, UTM_PRJ))):
        (tmp_path / name).write_bytes(content)
        for fips in (None, "5"):
            want = sorted(files.regions(spark, str(tmp_path / "t.geojson"), fips).collect(), key=str)
            got = sorted(shapefiles.regions(spark, str(tmp_path / name), fips).collect(), key=str)
            assert [(r["statefp"], r["name"], r["part"]) for r in got] == [(r["statefp"], r["name"], r["part"]) for r in want]
            for a, b in zip(got, want):
                assert np.allclose(a["ring"], b["ring"], atol=1e-9) and len(a["holes"]) == len(b["holes"])
                assert all(np.allclose(p, q, atol=1e-9) for p, q in zip(a["holes"], b["holes"]))


def test_shapefiles_that_are_odd(spark, tmp_path):
    (tmp_path / "none.zip").write_bytes(shapefiles.packed([]))
    assert shapefiles.read(spark, str(tmp_path / "none.zip")).count() == 0
    (tmp_path / "odd.zip").write_bytes(shapefiles.packed([({"A": "x"}, [square(0, 0, 1, clockwise=False)])]))  # a hole in nothing
    row = shapefiles.read(spark, str(tmp_path / "odd.zip")).head()
    assert row["attributes"] == {"A": "x"} and len(row["ring"]) == 5 and shapefiles.regions(spark, str(tmp_path / "odd.zip")).head()["statefp"] is None
    (tmp_path / "bad.zip").write_bytes(shapefiles.packed([({}, [square(0, 0, 1)])], UTM_PRJ.replace("Transverse_Mercator", "Lambert_Conformal_Conic")))
    with pytest.raises(Exception, match="Lambert_Conformal_Conic"):
        shapefiles.read(spark, str(tmp_path / "bad.zip")).collect()
    x, y = projections.to_degrees('PROJCS["w",PROJECTION["Mercator_Auxiliary_Sphere"],UNIT["Meter",1.0]]')(np.array([20037508.342789244]), np.array([0.0]))
    assert np.allclose([x, y], [[180], [0]])


# ---- parts put together ----------------------------------------------------------------------------------------------


def test_smoteenn_balances_and_edits(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "a", rng.normal(0, 1, 3).tolist()) for i in range(60)] + [(100 + i, "b", rng.normal(6, 1, 3).tolist()) for i in range(23)] + [(200, "c", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label string, features array<double>")
    found = resample.smoteenn(df, "label").collect()
    kinds = Counter((r["label"], r["copy"] > 0) for r in found)
    assert kinds["b", False] == 23 and kinds["b", True] == 37 and kinds["a", True] == 0  # apart, so editing takes none of them
    assert kinds["c", False] == kinds["c", True] == 0  # alone among others: no copies, and edited out
    assert max(r["copy"] for r in found) == 2 and len({(r["id"], r["copy"]) for r in found}) == len(found)
    own = {i: np.array(f) for i, label, f in rows if label == "b"}
    for r in (r for r in found if r["copy"]):
        way = [(o - own[r["id"]], np.array(r["features"]) - own[r["id"]]) for i, o in own.items() if i != r["id"]]
        assert any(np.allclose(step, line * (step @ line) / (line @ line), atol=1e-9) and -1e-9 <= (step @ line) / (line @ line) <= 1 for line, step in way)
    assert resample.smoteenn(df.limit(0), "label").count() == 0


def test_genotype_errors_over_several_blocks(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (30, 50)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    knn = neighbors.nearest_vectors(df, 4).where("NOT (id = 3 AND rank > 2)")  # one row has fewer
    got = {(r["id"], r["k"]): r["d"] for r in outliers.genotype_errors(df, knn, [1, 2, 4], block=16).collect()}
    near = {}
    for r in sorted(knn.collect(), key=lambda r: r["rank"]):
        near.setdefault(r["id"], []).append((r["nbr_id"], r["dist"]))
    for i, found in near.items():
        for k in (1, 2, 4):
            w = np.array([1 / (d + 1e-8) ** 2 for _, d in found[:k]])
            want = (((w[:, None] * x[[n for n, _ in found[:k]]]).sum(0) / w.sum() - x[i]) ** 2).mean()
            assert math.isclose(got[i, k], want, rel_tol=1e-9)
    assert len(got) == 90


def test_nested_configuration(tmp_path):
    text = """---
# options
min_mac: 2
prefix: 'run # one'   # a comment
outliers:
  detect: True
  limits: [0.01, 2, 'a, b']
  spaces:
    - genetic
    - geographic
grid:
- lr: 0.1
  widths: {first: 8, last: 4}
- lr: 1e-3
  widths: null
empty:
path: a#b
"""
    (tmp_path / "c.yaml").write_text(text)
    assert files.config(str(tmp_path / "c.yaml")) == {"min_mac": 2, "prefix": "run # one", "outliers": {"detect": True, "limits": [0.01, 2, "a, b"], "spaces": ["genetic", "geographic"]}, "grid": [{"lr": 0.1, "widths": {"first": 8, "last": 4}}, {"lr": 0.001, "widths": None}], "empty": None, "path": "a#b"}
    (tmp_path / "e.yaml").write_text("# nothing\n")
    assert files.config(str(tmp_path / "e.yaml")) == {}
    for bad in ("a: 1\n   b: 2\n", "just a text\n", "a: 1\n- b\n"):
        (tmp_path / "b.yaml").write_text(bad)
        with pytest.raises(ValueError):
            files.config(str(tmp_path / "b.yaml"))


def test_optimal_density_of_a_curve_with_and_without_a_knee(spark):
    x = np.linspace(0, 1, 300)
    falling = spark.createDataFrame([(float(a), float((1 - a) ** 3)) for a in x], "x double, y double")
    found = spatial.optimal_density(falling, "x", "y").collect()
    grid = np.arange(1000) / 999
    assert len(found) == 1 and math.isclose(found[0]["density"], grid[np.argmax(1 - (1 - grid) ** 3 - grid)], abs_tol=1e-9)
    assert spatial.optimal_density(falling.withColumn("y", F.col("x")), "x", "y").count() == 0
    assert spatial.optimal_density(falling.limit(2), "x", "y").count() == 0


def test_vcf_records_grow_with_calls_and_ranges_stay_thin(spark, tmp_path):
    names = [f"s{i}" for i in range(3000)]
    calls = spark.createDataFrame([("1", 5 + k, "x", "A", "C", names[i], 0, 1) for k in range(4) for i in (0, 7 + k, 2999)] + [("1", 99, "y", "A", "C", "other", 1, 1)], "chrom string, pos long, id string, ref string, alt string, sample string, a1 int, a2 int")
    lines = {r["pos"]: r["line"].split("\t")[9:] for r in variants.records(calls, names).collect()}
    assert all(len(v) == 3000 for v in lines.values()) and set(lines[99]) == {"./."}
    assert all({i for i, v in enumerate(lines[5 + k]) if v == "0/1"} == {0, 7 + k, 2999} for k in range(4))
    made = variants.records(calls, names)
    assert "element_at" not in made._jdf.queryExecution().analyzed().toString()  # a map is searched from its start for each sample
    variants.write(made, variants.header(names), f"file://{tmp_path}/v", 2)
    found = variants.ranges(f"file://{tmp_path}/v", 1 << 20, variants.Wanted())
    assert found and all(len(pickle.dumps(r)) < 2000 for r in found)
    back = variants.read(spark, f"file://{tmp_path}/v")
    assert back.count() == 15000 and back.where("NOT is_missing").count() == 12


@pytest.mark.parametrize("kind", ["pca", "mca"])
def test_tiles_with_few_calls_are_not_made_dense(kind, monkeypatch):
    rng = np.random.default_rng(7)
    rows, cols, n = 60, 50, 200
    x = np.where(rng.random((rows, cols)) < 0.04, rng.integers(0, 3, (rows, cols)), -1).astype(np.int8)
    stats = rng.random(cols) * 2 if kind == "pca" else rng.integers(0, 9, 3 * cols).astype(float)
    stats = stats if kind == "pca" else np.maximum(stats, np.stack([(x == k).sum(0) for k in range(3)], 1).ravel())
    a = wide.dense(x.tobytes(), rows, stats.tobytes(), kind, n, 700.0)
    right, left = rng.normal(size=(a.shape[1], 4)), rng.normal(size=(rows, 4))
    monkeypatch.setattr(wide, "dense", None)
    given = (x.tobytes(), rows, stats.tobytes(), kind, n, 700.0)
    assert np.allclose(wide.times(*given, right, False), a @ right) and np.allclose(wide.times(*given, left, True), a.T @ left)
    none = np.full((rows, cols), -1, np.int8)
    assert wide.times(none.tobytes(), *given[1:], right, False).shape == (rows, 4)


def test_lle_equals_the_whole_matrix_and_has_no_limit_over_rows(spark, monkeypatch):
    """The passes over blocks give the values and vectors of the whole matrix; groups that are apart give vectors of error 0."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40))
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(square, np.inf)

    def matrix(x, near):
        m = np.eye(len(x))
        for i, to in enumerate(near):
            z = x[to] - x[i]
            w = np.linalg.solve(z @ z.T + np.eye(6) * 1e-3 * (z**2).sum(), np.ones(6))
            m[i, to] -= w / w.sum()
        return m, *np.linalg.eigh(m.T @ m)

    m, values, vectors = matrix(x, np.argsort(square, axis=1)[:, :6])
    monkeypatch.setattr(embedding, "DENSE_ROWS", 0)
    got, own = embedding._lowest(lambda v: m @ v, lambda v: m.T @ v, 300, 2, 1e-9, 500)  # restarts and all
    assert np.allclose(got, values[1:3], rtol=1e-6) and np.allclose(np.abs(own), np.abs(vectors[:, 1:3]), atol=1e-4)
    x, square = x[:50], square[:50, :50]
    m, values, vectors = matrix(x, np.argsort(square, axis=1)[:, :6])
    monkeypatch.setattr(embedding, "SPARSE_ROWS", 32)
    for dense in (0, 5000):
        monkeypatch.setattr(embedding, "DENSE_ROWS", dense)
        made, error = embedding.lle(spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>"), 6, 2)
        y = np.stack(made.orderBy("id").toPandas()["features"])
        assert np.isclose(error, values[1:3].sum(), rtol=1e-6) and np.allclose(np.abs(y), np.abs(vectors[:, 1:3]), atol=1e-5)
    # four groups apart: three vectors across the ones have no error
    monkeypatch.setattr(embedding, "DENSE_ROWS", 0)
    apart = np.concatenate([rng.normal(size=(14, 40)) + 1000 * np.eye(40)[g] for g in range(4)])
    made, none = embedding.lle(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(apart)], "id long, features array<double>"), 6, 2)
    y = np.stack(made.orderBy("id").toPandas()["features"])
    assert none < 1e-10 and np.allclose(y.T @ y, np.eye(2), atol=1e-8) and np.allclose(y.sum(0), 0, atol=1e-8)


def test_lle_takes_more_than_5000_rows(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(5100, 2)))]
    many = spark.createDataFrame([*rows, (9000, None), (9001, [1.0, float("nan")])], "id long, features array<double>")
    monkeypatch.setattr(embedding, "_lowest", lambda forward, back, n, k, *_: (forward(np.ones((n, k)))[:k, 0], np.eye(n)[:, :k]))  # the limit alone is looked at
    made, error = embedding.lle(many, 4, 1)
    assert made.count() == 5100 and abs(error) < 1e-9  # weights of a row have the sum 1


def test_genetic_distance_joins_nothing_and_partitions_follow_rows(spark, monkeypatch):
    """The true dosage beside the predicted one gives what the join of two tables gives; a large table has more partitions."""
    few = tv.dosages(spark, SF)
    d = few.where("dosage is not null")
    p = d.select("sample", "locus", ((F.col("dosage") + F.col("locus") % 2) / 2).alias("dosage"))
    want = {r["sample"]: r["dg"] for r in genotype.squared_error(p, d).collect()}
    got = genotype.squared_error(d.select("sample", "locus", ((F.col("dosage") + F.col("locus") % 2) / 2).alias("dosage"), F.col("dosage").alias("actual")))
    assert "Join" not in got._jdf.queryExecution().toString()
    assert {r["sample"]: pytest.approx(r["dg"], abs=1e-12) for r in got.collect()} == want and len(want) == 10
    monkeypatch.setattr(tv, "PART_ROWS", 500)
    many = tv.dosages(spark, SF)
    assert many.rdd.getNumPartitions() == 12 and sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, few.collect()), key=str)


def test_lle_passes_over_a_small_matrix_run_no_jobs(spark, monkeypatch):
    """The matrix comes to the driver once if it has few entries; passes on the executors give the same."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(7).normal(size=(60, 30)))], "id long, features array<double>")
    monkeypatch.setattr(embedding, "DENSE_ROWS", 0)
    remote, made = embedding._sparse_product, []
    monkeypatch.setattr(embedding, "_sparse_product", lambda blocks, v: made.append(1) or remote(blocks, v))
    held, error = embedding.lle(rows, 5, 1)
    assert not made
    monkeypatch.setattr(embedding, "HELD_ENTRIES", 60 * 5 - 1)
    spread, other = embedding.lle(rows, 5, 1)
    assert len(made) > 2 and np.isclose(error, other, rtol=1e-6)
    a, b = (np.stack(t.orderBy("id").toPandas()["features"]) for t in (held, spread))
    assert np.allclose(a, b, atol=1e-5)


@pytest.mark.parametrize("limits", [{}, {"WHOLE_ROWS": 0, "STRIPE_CALLS": 900}, {"GRAM_ROWS": 0, "STRIPE_CALLS": 900}, {"HELD_ROWS": 0}])
def test_wide_axes_by_products_passes_and_tiles_are_the_same(spark, monkeypatch, limits):
    """Products of samples, passes over stripes and passes over tiles against the matrix; only tiles take many jobs a pass."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 3, (60, 300))
    x[rng.random(x.shape) < 0.1] = -1
    x[:, 100:][rng.random((60, 200)) < 0.97] = -2  # stripes with few calls are multiplied call by call
    x[:, [5, 250]] = -1
    for name, value in limits.items():
        monkeypatch.setattr(wide, name, value)
    tiled, made = wide._product, []
    monkeypatch.setattr(wide, "_product", lambda *a: made.append(1) or tiled(*a))
    z = np.where(x < 0, np.nan, x).astype(float)
    z[:, [5, 250]] = 0
    z[:, np.isnan(z).all(0)] = 0
    z = np.nan_to_num(z - np.nanmean(z, 0))
    there = (x[:, :, None] == np.arange(3)).reshape(60, -1).astype(float)
    mass = there.sum(0) / there.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.where(mass > 0, 60**0.5 * (there / there.sum() - mass / 60) / np.sqrt(mass), 0.0)
    for kind, want, own in (("pca", z, 1.0), ("mca", m, 60**0.5)):
        u, sigma, v = np.linalg.svd(want, full_matrices=False)
        e = wide.embed(long_table(spark, x), kind, 3, rows=16, cols=40)
        assert np.allclose(e.singular, sigma[:3], rtol=1e-8)
        assert np.allclose(e.shares, sigma[:3] ** 2 / ((z**2).sum() if kind == "pca" else 1), rtol=1e-8)
        a = np.array([r["features"] for r in e.samples.orderBy("sample").collect()])
        assert np.allclose(np.abs(a), np.abs(u[:, :3] * sigma[:3] * own), atol=1e-6)
        loci = {r["locus"]: np.reshape(r["features"], (-1, 3)) for r in e.loci.collect()}
        right = np.concatenate([loci[j] if j in loci else np.zeros((want.shape[1] // 300, 3)) for j in range(300)])
        assert np.allclose(want @ right * own, a, atol=1e-6) and (right[np.abs(right).argmax(0), range(3)] > 0).all()
    assert bool(made) == ("HELD_ROWS" in limits)


def test_variogram_pairs_places_not_points(spark):
    """Points on one place meet others as one row, and count as all their pairs; rows of a repeated id are no pairs."""
    rng = np.random.default_rng(11)
    spots = rng.uniform(-8, 8, (12, 2))
    rows = [(i, *map(float, spots[i % 12]), float(rng.normal() + 1000)) for i in range(150)]

    def plain(rows):
        n, g = Counter(), Counter()
        for a in rows:
            for b in rows:
                u, v = np.radians(a[1:3]), np.radians(b[1:3])
                d = 2 * 6371.0 * np.arcsin(min(1.0, np.sqrt(np.sin((v[1] - u[1]) / 2) ** 2 + np.cos(u[1]) * np.cos(v[1]) * np.sin((v[0] - u[0]) / 2) ** 2)))
                if a[0] < b[0] and d < 900:
                    n[int(d // 300)] += 1
                    g[int(d // 300)] += 0.5 * (a[3] - b[3]) ** 2
        return {k: (n[k], pytest.approx(g[k] / n[k], rel=1e-9)) for k in n}

    ddl = "id long, x double, y double, v double"
    found = spatial.variogram(spark.createDataFrame([*rows, (900, None, 1.0, 2.0), (901, 1.0, 1.0, None), (None, 1.0, 1.0, 2.0)], ddl), "v", 300.0, 3)
    assert {r["lag"]: (r["n"], r["gamma"]) for r in found.collect()} == plain(rows)
    assert "c2" in found._jdf.queryExecution().toString()  # counts go into the join
    twice = rows + rows[:5]
    assert {r["lag"]: (r["n"], r["gamma"]) for r in spatial.variogram(spark.createDataFrame(twice, ddl), "v", 300.0, 3).collect()} == plain(twice)


@pytest.mark.parametrize("space", ["geographic", "genetic"])
def test_outlier_passes_search_once_and_find_what_new_searches_find(spark, monkeypatch, space):
    """Each pass over lists gives the outliers of a search among those that are left; only lists that are too short are searched anew."""
    rng = np.random.default_rng(4)
    base = rng.uniform(-20, 20, (90, 2))
    odd = base + (np.arange(90)[:, None] % 9 == 0) * rng.normal(0, 12, (90, 2))
    rows = spark.createDataFrame([(i, *map(float, odd[i]), [*map(float, base[i]), float(i % 3)]) for i in range(90)], "id long, x double, y double, features array<double>")
    want, left = set(), rows
    for _ in range(3):
        new = {r["id"] for r in outliers.detect(left, space, 3, 0.05).where("is_outlier").collect()}
        want |= new
        left = left.where(~F.col("id").isin(list(want)))
    searched, where = [], "nearest_vectors" if space == "geographic" else "nearest_on_globe"
    search = getattr(neighbors, where)
    monkeypatch.setattr(neighbors, where, lambda df, *a, **kw: searched.append(df.count()) or search(df, *a, **kw))
    found = {r["id"] for r in outliers.detect_outliers(rows, space, k=3, level=0.05, rounds=3).collect()}
    assert found == want and len(want) > 3 and searched[0] == 90 and sum(searched[1:]) < 90
    real = outliers._Lists.__init__
    monkeypatch.setattr(outliers._Lists, "__init__", lambda self, samples, space, long, *a: real(self, samples, space, 3, *a))  # every list that loses one is too short
    assert {r["id"] for r in outliers.detect_outliers(rows, space, k=3, level=0.05, rounds=3).collect()} == want and len(searched) > 2
