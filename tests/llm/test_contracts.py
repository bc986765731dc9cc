"""The registered queries' columns and rules, and operators against plain versions written for these tests."""

import json
import struct
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import decontam, langid, neardup, quality, queries, sharding, textkit, tiff, token_files, toolcalls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"

COLUMNS = {
    "op1_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_tool_calls": {"conv_id": "bigint", "call_id": "string", "level": "bigint", "valid": "boolean", "linked": "boolean", "record": "string"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op9_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_tiff": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_of_each_query(spark, name):
    out = queries.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = out.toPandas()
    if name in ("op2_language_id", "op4_quality"):
        parts, left = (3, 1) if name == "op2_language_id" else (4, 2)
        assert rows.held_out.tolist() == [zlib.crc32(str(i).encode()) % parts == left for i in rows.doc_id]
        assert rows.score.between(0, 1).all()
    if name == "op4_quality":
        assert rows.predicted.tolist() == (rows.score >= 0.7).astype(int).tolist()
    if name in ("op1_token_files", "op2_language_id", "op4_quality", "op5_bpe", "op7_sharding", "op9_near_duplicates", "op10_tiff"):
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert sorted(rows.doc_id) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_letters_beyond_the_basic_plane():
    assert not langid.counts("\U0001f600\U0001f680 123 !?").any()
    assert not langid.counts("").any() and not langid.counts(None).any()
    assert langid.counts("\U00010400\U00010428").any()  # Deseret letters
    mixed = langid.counts("\U0001f600 guten Tag \U0001f680")
    assert (mixed == langid.counts("☃ guten Tag ☃")).all()
    for c in ("\U0001f600", "\U00020000", "²", "Ж"):
        assert bool(langid.counts(c * 3).any()) == unicodedata.category(c).startswith("L")


def test_language_by_plain_centroids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    for r in docs.limit(60).collect():
        n = langid.counts(r["text"])
        v = [np.sqrt(float(x)) * float(w) for x, w in zip(n, model.idf)]
        length = sum(x * x for x in v) ** 0.5
        cosines = [sum(a * float(b) for a, b in zip(v, c)) / length for c in model.centroids]
        lang, score, _ = model.nearest(n)
        assert lang == model.langs[int(np.argmax(cosines))] and abs(score - max(cosines)) < 1e-4


def test_texts_of_a_language_that_was_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 5 = 0")
    for left in ("de", "es", "fr"):  # English lines stand in documents of all languages
        found = langid.predict(docs.where("n_chars > 200"), langid.fit(docs.where(F.col("lang") != left))).toPandas()
        assert found.rejected[found.lang == left].mean() > 0.9, left
        assert found.rejected[found.lang != left].mean() < 0.01, left


def test_quality_by_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(40)]
    y = [int(at[0] < 5) for at, _ in rows]
    model = quality.ftrl(rows, y, 2, 0.5, 1.0, 0.3, 0.5, 11)
    z, n, zb, nb = defaultdict(float), defaultdict(float), 0.0, 0.0
    order, r = np.arange(len(rows)), np.random.default_rng(11)

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.3 else ((0.3 if z[i] > 0 else -0.3) - z[i]) / ((1.0 + n[i] ** 0.5) / 0.5 + 0.5)

    for _ in range(2):
        r.shuffle(order)
        for k in order:
            w, wb = {i: weight(i) for i in rows[k][0]}, -zb * 0.5 / (1.0 + nb**0.5)
            g = 1 / (1 + np.exp(-(wb + sum(w[i] * x for i, x in zip(*rows[k]))))) - y[k]
            for i, x in zip(*rows[k]):
                z[i] += g * x - ((n[i] + (g * x) ** 2) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
                n[i] += (g * x) ** 2
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / 0.5 * wb
            nb += g * g
    assert np.allclose(model.weights[:50], [weight(i) for i in range(50)], atol=1e-5)
    assert abs(model.bias + zb * 0.5 / (1.0 + nb**0.5)) < 1e-9
    at = np.array([3, 3, 7])
    assert abs(model.score(at) - 1 / (1 + np.exp(-(model.bias + quality.SCALE * model.weights[at].mean())))) < 1e-6


def test_token_files_need_a_file_of_their_kind(tmp_path):
    spec = json.load(open(queries.WORD_BPE, encoding="utf-8"))
    assert token_files._check_kind(queries.WORD_BPE) == 49408
    for change in ({"normalizer": None}, {"pre_tokenizer": spec["pre_tokenizer"] | {"pretokenizers": spec["pre_tokenizer"]["pretokenizers"][1:]}}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            token_files._check_kind(str(path))


def test_shards_of_token_files_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = textkit.shared_folder(spark, "t")
    assert token_files.write(docs, queries.WORD_BPE, folder, 1).count() > 5
    assert token_files.read(spark, folder).count() == docs.count()


# ---- op3


def _plain_levels(calls):
    ids = {(c, i) for c, i, _, _ in calls}
    parents = defaultdict(set)
    for c, i, _, deps in calls:
        parents[c, i] |= {(c, d) for d in deps or () if (c, d) in ids}
    level = {}
    for _ in range(len(ids) + 1):
        for x in ids:
            if all(p in level for p in parents[x]):
                level[x] = max((level[p] + 1 for p in parents[x]), default=0)
    return {x: level.get(x) for x in ids}


def test_levels_against_plain(spark):
    rng, calls = np.random.default_rng(3), []
    for i in range(70):
        calls.append(("chain", str(i), i, [str(i - 1)] if i else []))
        calls.append(("forward", str(i), i, [str(i + 1)]))
        calls.append(("ring", str(i), i, [str((i + 1) % 70)]))
        calls.append(("random", str(i), i, [str(x) for x in rng.integers(0, max(1, i), rng.integers(0, 4))] if i else []))
        calls.append(("mixed", str(i), i, [str(x) for x in rng.integers(0, 90, 2)] if i % 5 == 0 else [str(i - 1)]))
    calls += [("self", "a", 0, ["a"]), ("self", "b", 1, ["a"]), ("self", "c", 2, None), ("unknown", "a", 0, ["x"]), ("twice", "a", 0, []), ("twice", "b", 1, ["a"]), ("twice", "b", 1, ["c"]), ("twice", "c", 2, ["a"])]
    df = spark.createDataFrame(calls, "conv_id string, call_id string, seq long, depends_on array<string>")
    got = {(r["conv_id"], r["call_id"]): (r["level"], r["cyclic"]) for r in toolcalls.levels(df).collect()}
    want = _plain_levels(calls)
    assert got == {x: (v, v is None) for x, v in want.items()}
    assert got["chain", "69"] == (69, False) and got["forward", "0"] == (69, False) and got["ring", "5"] == (None, True)


def test_canonical_records(spark):
    given = '{"z": 1.0, "a": {"y": [1e2, 12345678901234567], "b": null, "é": "\\u00e9\\n"}, "it\'s": true}'
    calls = spark.createDataFrame([("c", "1", 0, "t", given, []), ("c", "2", 1, "t", '{"it\'s": 3}', [])], "conv_id string, call_id string, seq long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([("c", "1", 5, "x" * 200_000)], "conv_id string, call_id string, seq long, content string")
    schema = {"type": "object", "properties": {"it's": {"type": "boolean"}}}
    got = {r["call_id"]: r for r in toolcalls.link(calls, results, {"t": schema}).collect()}
    record = got["1"]["record"]
    read = json.loads(record)
    assert read["arguments"] == json.loads(given) and read["result"] == "x" * 200_000
    assert [k for k in json.loads(record, object_pairs_hook=lambda p: [x for x, _ in p])] == ["arguments", "id", "name", "result"]
    assert record.index('"a":{') < record.index('"it\'s"') < record.index('"z":') and '"b":null' in record and ": " not in record
    assert got["1"]["valid"] and got["2"]["errors"] == "it's: type"
    with pytest.raises(ValueError):
        toolcalls.schema_errors(F.col("arguments"), {"properties": {"\"'": {"type": "string"}}})


def test_calls_are_hash_joined(spark):
    plan = toolcalls.link(*toolcalls.turns_as_calls(spark.read.parquet(f"{SF}/conversations.parquet")), toolcalls.TURN_TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Python" not in plan and "ArrowEval" not in plan


# ---- op6


def test_record_ids_are_unique(spark):
    rows = [(1, "u", "a" * 2000), (1, "u", "a" * 2000), (1, "v", "a" * 2000), (2, "u", "a" * 2000), (2, "u", "a" * 2000), (None, "u", "b" * 2000), (None, "u", "b" * 2000), (None, None, ""), (None, None, ""), (3, "u", "same"), (3, "u", "same")]
    folder = textkit.shared_folder(spark, "t")
    warc.write(warc.records(spark.createDataFrame(rows, "page_id long, url string, html string")), folder)
    found = warc.read(spark, folder).collect()
    assert len({(r["record_id"], r["chunk_no"]) for r in found}) == len(found) == len(rows)
    assert Counter(r["record_type"] for r in found) == {"response": 8, "revisit": 3}


# ---- op7


def _shards(rows):
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    return size


def test_keys_stay_whole_where_they_fit(spark):
    rng = np.random.default_rng(5)
    texts = [f"text {i} " + "x" * int(rng.integers(0, 200)) for i in range(3000)] + ["half of a shard " * 5] * 120 + ["most of a shard " * 5] * 230 + ["more than a shard " * 5] * 900 + [None] * 50 + ["word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    p = sharding.plan(df, 24)
    rows = sharding.assign(df, p).collect()
    size, of = _shards(rows), defaultdict(set)
    for r in rows:
        of[texts[r["doc_id"]]].add(r["shard"])
    mean = sum(size.values()) / 24
    assert len(rows) == len(texts) and set(size) == set(range(24))
    assert max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert {t[:9] for t, s in of.items() if t and len(s) > 1} == {"more than"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [tuple(r) for r in sorted(sharding.assign(df, p).collect(), key=lambda r: r["doc_id"])] == [tuple(r) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_rows_of_one_place_are_not_cut(spark):
    df = spark.createDataFrame([(7, "the same row " * 10)] * 400 + [(1000 + i, f"t{i}") for i in range(100)], DOCS)
    rows = sharding.assign(df, sharding.plan(df, 4)).collect()
    assert len(rows) == 500 and len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1


# ---- op8


def _plain_leaks(docs, items, least, share):
    """The definition: the longest free match again and again, over all pairs of places."""
    out = set()
    for d, text in docs:
        b = decontam.words(text).tolist()
        for i, item in items:
            a = decontam.words(item).tolist()
            size = min(least, len(a))
            free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
            while a:
                best = (0, 0, 0)
                for p in range(len(a)):
                    for q in range(len(b)):
                        k = 0
                        while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k] and free_a[p + k] and free_b[q + k]:
                            k += 1
                        if k > best[0]:
                            best = (k, p, q)
                if best[0] < max(1, size):
                    break
                k, p, q = best
                free_a[p : p + k], free_b[q : q + k] = [False] * k, [False] * k
                covered += k
            if a and covered >= share * len(a):
                out.add((d, i, covered))
    return out


def test_leaks_against_plain(spark):
    rng = np.random.default_rng(6)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 12, n))
    items = [(i, word(int(n))) for i, n in enumerate((2, 4, 7, 12, 18))] + [(9, "a a a a a a a a")]
    docs = [(i, word(30)) for i in range(25)]
    docs += [(100 + i, f"{word(5)} {items[k][1]} {word(4)}") for i, k in enumerate((0, 1, 2, 3, 4))] + [(200, " ".join(items[4][1].split()[9:] + items[4][1].split()[:9])), (201, "a " * 60), (202, ""), (203, None)]
    want = _plain_leaks(docs, items, 5, 0.5)
    df, bench = spark.createDataFrame([*docs, docs[26], (None, docs[26][1])], DOCS), spark.createDataFrame([*items, items[0], (None, items[3][1])], "item_id long, text string")
    both = []
    for passes in (decontam.PASSES, 0):
        rows = decontam.leaks(df, bench, passes=passes).collect()
        assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in rows if r["doc_id"] is not None and r["item_id"] is not None} == want
        clean = decontam.clean(df.withColumn("key", F.lit("k")), bench, passes=passes)
        assert clean.columns == ["doc_id", "text", "key"]
        both.append((sorted(map(str, rows)), sorted(map(str, clean.collect()))))
    assert both[0] == both[1] and both[0][1]


def test_joined_leaks_of_the_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(map(tuple, decontam.leaks(docs, bench, passes=p).collect())) for p in (decontam.PASSES, 0))
    assert a == b and a
    none = docs.where("false")
    assert decontam.leaks(none, bench, passes=0).count() == 0 and decontam.clean(none, bench, passes=0).count() == 0


def test_repeated_seeds_stay_bounded():
    seeds = decontam.Seeds([(1, "same " * 200), (2, "other words stand here now " * 3)], 5)
    runs = seeds.hits(decontam.words("same " * 20_000))
    assert set(runs) == {0} and len(runs[0]) <= 20_200  # diagonals, not 196 x 19,996 pairs
    assert decontam._leaks(seeds, "same " * 20_000, 0.5)[0][:4] == (1, 200, 1, 200)


# ---- op9


def test_links_of_repeated_ids_are_kept(spark):
    rng = np.random.default_rng(7)
    a, b = (" ".join(f"{c}{x}" for x in rng.integers(0, 1000, 80)) for c in "ab")
    other = lambda t: t.replace(t.split()[40], "changed", 1)
    df = spark.createDataFrame([(1, a), (1, b), (2, other(a)), (3, other(b)), (4, "alone with some words here")], DOCS)
    got = {(r["doc_id"], r["component_id"]) for r in neardup.find(df, words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def _texts_near(rng, n, words, changes):
    base, out = [f"b{x}" for x in range(words)], []
    for i in range(n):
        v = list(base)
        for at in rng.choice(words, changes, replace=False):
            v[at] = f"c{i}x{at}"
        out.append(" ".join(v))
    return out


def test_dense_group_of_near_texts_that_are_not_linked(spark, monkeypatch):
    rng = np.random.default_rng(8)
    apart, near = _texts_near(rng, 150, 100, 9), _texts_near(rng, 60, 100, 2)  # 0.69 and 0.92 similar to each other
    df = spark.createDataFrame(list(enumerate(apart + near)), DOCS)
    pairs = []
    whole = neardup._confirm
    monkeypatch.setattr(neardup, "_confirm", lambda p, *a: pairs.append(p.count()) or whole(p, *a))
    got = {r["doc_id"]: r["component_id"] for r in neardup.find(df, words=2).collect()}
    sets = [{(x, y) for x, y in zip(t.split(), t.split()[1:])} for t in apart + near]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    assert got == {i: top(i) for i in range(len(sets))}
    assert sum(pairs) < 2000  # of 11,175 pairs that aren't linked


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    for n in (3, 50, 400, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate([a[: len(a) * 9 // 10], rng.integers(0, 1 << 64, n // 10, np.uint64)]))
        for bits in (64, 1024, neardup.wide_bits(n) or 2048):
            x = neardup.sketch(a, bits) ^ neardup.sketch(b, bits)
            assert sum(int(v).bit_count() for v in x.view(np.uint64)) <= len(np.setxor1d(a, b))
    assert neardup.wide_bits(1500) == 0 and neardup.wide_bits(1501) == 2048 and neardup.wide_bits(6001) == 8192


@pytest.mark.parametrize("words", [2, 5])
def test_recall_of_links_of_the_larger_table(spark, words):
    """All links of 80 percent or more join their documents: the pairs come from a full inverted index of shingles."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in neardup.find(spark.createDataFrame(rows, DOCS), words=words).collect()}
    sets = {}
    for i, t in rows:
        s = neardup.shingles(t, words)
        if len(s):
            sets.setdefault(s.tobytes(), (i, s))
    kept = sorted(sets.values(), key=lambda x: x[0])
    post, links, caught = defaultdict(list), 0, 0
    for k, (_, s) in enumerate(kept):
        first = s[: len(s) - -(-len(s) * 4 // 5) + 1]  # sets that must be linked share one of these
        for j in {j for h in first.tolist() for j in post[h]}:
            t = kept[j][1]
            if 5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    links += 1
                    caught += got[kept[j][0]] == got[kept[k][0]]
        for h in first.tolist():
            post[h].append(k)
    assert links > 40 and caught == links


# ---- op10


def _one_page(tags, data):
    head = struct.pack("<2sHI", b"II", 42, 8 + len(data) + len(data) % 2)
    entries = b"".join(struct.pack("<HHI", t, 4, 1) + struct.pack("<I", v) for t, v in sorted(tags.items()))
    return head + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def test_few_bits_and_planes():
    grid = np.random.default_rng(1).integers(0, 2, (5, 13), np.uint8)
    ((facts, got),) = tiff.pages(_one_page({256: 13, 257: 5, 258: 1, 259: 1, 273: 8, 277: 1, 278: 5, 279: 10}, np.packbits(grid, axis=1).tobytes()))
    assert got == grid.tobytes() and facts["bits"] == 1
    four = np.arange(24, dtype=np.uint8).reshape(4, 6) % 16
    packed = (four[:, ::2] << 4 | four[:, 1::2]).tobytes()
    assert next(tiff.pages(_one_page({256: 6, 257: 4, 258: 4, 259: 1, 273: 8, 277: 1, 278: 4, 279: 12}, packed)))[1] == four.tobytes()
    planes = np.arange(2 * 3 * 4, dtype=np.uint8)
    data = planes.tobytes() + struct.pack("<4I", 8, 20, 12, 12)
    got = next(tiff.pages(_one_page({256: 4, 257: 3, 258: 8, 259: 1, 277: 2, 278: 3, 284: 2, 273: 0, 279: 0}, data).replace(struct.pack("<HHII", 273, 4, 1, 0), struct.pack("<HHII", 273, 4, 2, 32)).replace(struct.pack("<HHII", 279, 4, 1, 0), struct.pack("<HHII", 279, 4, 2, 40))))[1]
    assert got == planes.reshape(2, 3, 4).transpose(1, 2, 0).tobytes()


def test_files_that_claim_too_much_are_errors(spark):
    huge = _one_page({256: 1 << 31, 257: 1 << 31, 258: 8, 259: 1, 273: 8, 277: 1, 278: 1, 279: 4}, b"abcd")
    bomb = zlib.compress(bytes(50_000_000))
    small = _one_page({256: 4, 257: 4, 258: 8, 259: 8, 273: 8, 277: 1, 278: 4, 279: len(bomb)}, bomb)
    df = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(small))], "k long, media binary")
    got = {r["k"]: r for r in tiff.explode_pages(df).collect()}
    assert "more than a page may have" in got[1]["error"] and got[2]["error"] is None and bytes(got[2]["pixels"]) == bytes(16)


def test_every_compression_of_the_query(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 7)) for i in range(120)], DOCS)
    stored = tiff.store(df, compression=None)
    codes = Counter(r["compression"] for r in tiff.explode_pages(stored).collect())
    assert set(codes) == {tiff.CODES["lzw"], tiff.CODES["packbits"], tiff.CODES["deflate"]}
    a, b = (tiff.round_trip(df, compression=c).select("doc_id", "payload_sha256", "feature").orderBy("doc_id").collect() for c in (None, "deflate"))
    assert a == b


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

        def getConf(self):
            return self

        master, conf = "spark://host:7077", property(lambda self: self)
        sparkContext = property(lambda self: self)

    with pytest.raises(RuntimeError):
        textkit.shared_base(Conf())
