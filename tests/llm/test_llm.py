"""Each operator against a plain version, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import base64
import hashlib
import json
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridia.llm import bpe, decontam, langid, neardup, quality, queries, sharding, textkit, tiff, token_files, toolcalls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(0, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "  \n\t ", None, "s", 4), (None, "A null id here", "en", "s", 14), (None, None, None, None, None), (3, "word " * 40000, "en", "s", 200000), (4, "same text twice over", "en", "s", 1), (4, "same text twice over", "en", "s", 1), (5, "same text twice over", None, "s", 1), (6, "123 !!! \x1c <|endoftext|> É", "fr", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("score string, shard string, ids string, page string, media string, size string, place string, range string, n string, k1 string, kept string, root string, value string, level string")
    return spark.createDataFrame([(*r, *["x"] * 14) for r in ODD], f"{DOCS}, {extra}")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.WORD_BPE)


def test_bpe_matches_library(docs, odd, none, library):
    for df in (docs, odd):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, queries.WORD_BPE).collect())
        want = []
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want.append((r["doc_id"] is None, r["doc_id"] or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
        assert got == sorted(want)
    assert bpe.round_trip(none, queries.WORD_BPE).count() == 0
    back = bpe.decode_column(bpe.encode_column(odd, queries.WORD_BPE), queries.WORD_BPE)
    assert "ids" in back.columns and back.count() == len(ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aaabcthein's 09 <|endoftext|>éÉΣσ\x1c\n!?/w")), max_size=40))
def test_bpe_any_text(text):
    library = Tokenizer.from_file(queries.WORD_BPE) if not hasattr(test_bpe_any_text, "t") else test_bpe_any_text.t
    test_bpe_any_text.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    codec = bpe.load(queries.WORD_BPE)
    assert codec.encode(text).tolist() == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(token_files.token_bytes(queries.WORD_BPE, text), "<u4").tolist() == ids


def test_token_files(spark, docs, odd, none, library):
    for df in (docs, odd):
        folder = textkit.shared_folder(spark, "t")
        token_files.write(df, queries.WORD_BPE, folder, 1, shards=3)
        rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
        start, want = 0, []
        for r in rows:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
            start += len(ids)
        got = [tuple(r) for r in token_files.read(spark, folder).orderBy("start").collect()]
        assert got == want
    folder = textkit.shared_folder(spark, "t")
    token_files.write(none, queries.WORD_BPE, folder, 1)
    assert token_files.read(spark, folder).count() == 0


def test_language(spark, docs, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(big, langid.fit(big)).toPandas()
    held = found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (found.lang_pred == found.lang)[held].mean() > 0.98
    assert found.score.between(0, 1).all() and not found.rejected.any()
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert got[0, None]["lang_pred"] == got[1, ""]["lang_pred"] == "und" and got[6, ODD[-1][1]]["lang_pred"] != "und"
    assert got[4, "same text twice over"]["shard"] == "x"
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_foreign_scripts_are_rejected_at_any_size(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(big)
    assert (model.least > 0).all()
    rng = np.random.default_rng(3)
    for first, last in ((0x430, 0x450), (0x3B1, 0x3CA), (0x627, 0x64A), (0x4E00, 0x5400)):
        letters = np.array([" "] * 6 + [chr(c) for c in range(first, last)])
        for n in (3, 12, 200, 2000, 50_000, 300_000):
            text = chr(first) + "".join(rng.choice(letters, n))
            assert model.nearest(langid.counts(text))[2], (hex(first), n)
    for text in big.where("lang = 'de' and n_chars > 300").limit(5).toPandas()["text"]:
        assert not model.nearest(langid.counts(text))[2]


def test_long_text_counts_like_pieces():
    text = "Der schnelle Fuchs. " * 30000
    whole = langid.counts(text)
    assert whole.sum() > 0 and langid.counts("Der")[np.flatnonzero(langid.counts("Der"))].sum() > 0
    assert abs(int(whole.sum()) - 30000 * int(langid.counts("Der schnelle Fuchs. " * 2).sum() - langid.counts("Der schnelle Fuchs. ").sum())) < 100


def test_quality(spark, docs, odd, none):
    big, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(big.join(labels, "doc_id"), quality.fit(big, labels)).select("doc_id", "quality", "score").toPandas()
    held = found[found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.98
    assert held.score.between(0, 1).all()
    none_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, none_labels)).collect()} == {0.5}
    bad = spark.createDataFrame([(4, None), (None, 1), (3, 7), (3, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score(odd, quality.fit(odd, bad)).count() == len(ODD)
    assert quality.score(none, quality.fit(none, bad)).count() == 0


def _plain_components(texts, words, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        k = min(words, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    post = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            post[x].add(i)
    done = set()
    for ids in post.values():
        for i in ids:
            for j in ids:
                if i < j and (i, j) not in done:
                    done.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * len(sets[i] | sets[j]):
                        a, b = sorted((root(i), root(j)))
                        up[b] = a
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{rng.integers(60)}" for _ in range(n)) for n in (5, 6, 9, 12, 30, 60, 200)]
    texts = ["", None, "one", "ONE", "one two", " One\ttwo\n"]
    for b in base:
        w = b.split()
        for k in range(14):
            v = list(w)
            for _ in range(k % 5):
                v[rng.integers(len(v))] = f"x{rng.integers(1000)}"
            texts.append(" ".join(v))
        texts += [b, b.upper()]
        chain = list(w)  # each near the one before, far from the first
        for k in range(12):
            chain[k * len(w) // 12] = f"c{k}"
            texts.append(" ".join(chain))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    root, n = _plain_components(texts, words, 80)
    got = {r["doc_id"]: r for r in neardup.find(df, words=words).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == root
    assert [got[i]["n_shingles"] for i in range(len(texts))] == n
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert neardup.first_of_each(df, neardup.find(df, words=words)).count() == len(set(root))


def test_near_duplicates_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in df.collect())
    root, _ = _plain_components([t for _, t in rows], 2, 80)
    got = {r["doc_id"]: r["component_id"] for r in neardup.find(df, words=2).collect()}
    assert [got[i] for i, _ in rows] == [rows[r][0] for r in root]


def test_near_duplicates_odd(odd, none):
    found = neardup.find(odd, words=2).collect()
    assert len(found) == len(ODD)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} >= {(0, 0, True), (1, 1, True), (2, 2, True), (None, None, True), (4, 4, True), (5, 4, False)}
    assert neardup.find(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(500, 600), (600, 700), (900, 400), (7, 7)] + [(1000, 1001 + i) for i in range(200)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), textkit.shared_folder(spark, "t")).collect()}
    assert {got[i] for i in range(301)} == {0} and got[700] == 500 and got[900] == 400 and got[1100] == 1000


def _plain_tiles(a, b, least):
    """Tiles as the definition has them: the longest free match again and again."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                k = 0
                while p + k < len(a) and q + k < len(b) and a[p + k] == b[q + k] and not ua[p + k] and not ub[q + k]:
                    k += 1
                if k > best[0]:
                    best = (k, p, q)
        k, p, q = best
        if k < least:
            return sum(n for n, *_ in out)
        for i in range(k):
            ua[p + i] = ub[q + i] = True
        out.append(best)


def test_tiling_against_plain():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(3, 25)).astype(np.uint64)
        b = np.concatenate([rng.integers(0, 6, rng.integers(3, 20)).astype(np.uint64), a[len(a) // 2 :], rng.integers(0, 6, 4).astype(np.uint64), a[: len(a) // 2]])
        seeds = decontam.Seeds([], 3)
        ha, hb = decontam.rolling(a, 3), decontam.rolling(b, 3)
        pairs = [(i, j) for i in range(len(ha)) for j in range(len(hb)) if ha[i] == hb[j]]
        assert sum(n for *_, n in decontam.tiles(a, b, pairs, 3)) == _plain_tiles(a.tolist(), b.tolist(), 3), (a, b)
        assert seeds.hits(a) == {}


def test_decontamination(spark, odd, none):
    words = [f"t{i}" for i in range(40)]
    item = " ".join(words)
    texts = ["before " + item + " after", "x " + " ".join(words[20:]) + " y " + " ".join(words[:20]), " ".join(words[:19]) + " other", " ".join(words[:20]).upper() + " other", "nothing of it", None, "", " ".join(words[::-1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "too short", "x"), (7, item, "x"), (None, "a null id with enough words in it", "x")], "item_id long, text string, doc_id string")
    for block in (decontam.BLOCK, 100):
        got = decontam.leaks(df, bench, block=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["covered_words"]) for r in got) == [(0, 7, 1, 40), (1, 7, 2, 40), (3, 7, 1, 20)]
        assert sorted(r["doc_id"] for r in decontam.clean(df, bench, block=block).collect()) == [2, 4, 5, 6, 7]
    assert decontam.leaks(odd, bench).count() == 0 and decontam.clean(odd, bench).count() == len(ODD)
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(df, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_short_items_leak_as_a_whole(spark):
    docs = spark.createDataFrame([(0, "it says: Too SHORT, here"), (1, "too long, short"), (2, "one two three four"), (3, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "too short"), (8, "one two three four"), (9, "..."), (10, "long")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["longest_tile"]) for r in decontam.leaks(docs, bench).collect()) == [(0, 7, 2), (1, 10, 1), (2, 8, 4)]
    assert [r["doc_id"] for r in decontam.clean(docs, bench).collect()] == [3]


def test_decontamination_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r["item_id"]: plain(r["text"]) for r in b.collect()}
    want = {(r["doc_id"], i) for r in d.collect() for i, x in items.items() if x in plain(r["text"])}
    assert want and {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, b).collect()} == want


def test_warc(spark):
    long = "é" * 300000 + "x"
    rows = [(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, "u", "short"), (4, None, "short"), (5, "u\r\nX: 1", None), (6, "u", ""), (None, "u", "a" * 2000), (8, "u", long), (9, "u", long), (9, "u", long), (10, "u", "b" * 999), (11, "u", "b" * 999)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    folder = textkit.shared_folder(spark, "t")
    warc.write(warc.records(df), folder)
    found = warc.read(spark, folder).collect()
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found if r["last"])
    largest = {"a" * 2000: 2, long: 9}
    want = []
    for k, _, h in rows:
        p = (h or "").encode()
        to = largest.get(h)
        again = to is not None and k != to
        want.append((k or 0, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    parts = sorted((r for r in found if r["page_id"] == 8), key=lambda r: r["chunk_no"])
    assert len(parts) == 1 and parts[0]["record_type"] == "revisit"
    parts = defaultdict(list)
    for r in sorted((r for r in found if r["page_id"] == 9), key=lambda r: r["chunk_no"]):
        parts[r["chunk_no"]].append(r)
    assert len(parts) == 3 and b"".join(bytes(parts[k][0]["chunk"]) for k in sorted(parts)) == long.encode()
    assert all(r["digest_so_far"] == hashlib.sha1(long.encode()[: r["bytes_so_far"]]).hexdigest() for rs in parts.values() for r in rs)
    folder = textkit.shared_folder(spark, "t")
    warc.write(warc.records(df.where("false")), folder)
    assert warc.read(spark, folder).count() == 0


def _check_shards(rows, shards, slack):
    by, size = defaultdict(list), Counter()
    for r in rows:
        by[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert set(by) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    mean = sum(size.values()) / shards
    assert max(size.values()) <= mean + slack and min(size[k] for k in range(shards)) >= mean - slack


def test_sharding(spark, odd, none):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sharding.assign(df, sharding.plan(df, 24)).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(rows) == len(texts) and all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    _check_shards(rows, 24, max(r["size"] for r in rows))
    at = defaultdict(set)
    for r in rows:
        at[texts[r["doc_id"]]].add(r["shard"])
    assert max(map(len, at.values())) == 1
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text " * 9)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = sharding.assign(hot, sharding.plan(hot, 24)).collect()
    _check_shards(got, 24, 0.12 * sum(r["size"] for r in got) / 24 + 90)
    assert sharding.assign(none, sharding.plan(none, 24)).count() == 0
    p = sharding.plan(odd, 4)
    got = sharding.assign(odd, p).collect()
    assert len(got) == len(ODD) and sorted(r["size"] for r in got)[:3] == [8, 8, 8]
    folder = textkit.shared_folder(spark, "t")
    sharding.write(df, sharding.plan(df, 4), folder)
    assert spark.read.parquet(folder).groupBy("shard").count().count() == 4


def test_tiff(spark, docs, odd, none):
    for df in (docs, odd):
        text = {(r["doc_id"], hashlib.sha256((x := (r["text"] or "").encode()).ljust(max(1, -(-len(x) // 576)) * 576, b"\xff")).hexdigest()): x for r in df.collect()}
        got = tiff.round_trip(df).collect()
        assert len(got) == df.count()
        for r in got:
            x = text[r["doc_id"], r["payload_sha256"]]
            full = x.ljust(r["payload_bytes"], b"\xff")
            assert r["n_bytes"] == len(x) and r["payload_bytes"] % 576 == 0 and r["tail_crc32"] == zlib.crc32(full[-32:])
            assert r["media_sha256"] == hashlib.sha256(tiff.encode(full)).hexdigest()
    assert tiff.round_trip(none).count() == 0
    bad = spark.createDataFrame([(1, bytearray(b"II*\0")), (2, None), (3, bytearray(b"nonsense"))], "k long, media binary")
    assert sorted((r["k"], r["error"] is not None) for r in tiff.explode_pages(bad).collect()) == [(1, True), (3, True)]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.sampled_from(sorted(tiff.CODES)), st.sampled_from([1, 2]), st.integers(1, 40))
def test_tiff_codecs(data, compression, predictor, rows):
    data = data.ljust(-(-len(data) // 16) * 16, b"\xff")
    made = tiff.encode(data, 16, page_rows=rows, strip_rows=7, compression=compression, predictor=predictor)
    assert b"".join(p for _, p in tiff.pages(made)) == data


def test_tiff_tiles_big_endian():
    import struct

    grid = np.arange(20 * 24, dtype=np.uint8).reshape(20, 24)
    out, starts = bytearray(struct.pack(">2sHI", b"MM", 42, 0)), []
    for y in (0, 16):
        for x in (0, 16):
            block = np.zeros((16, 16), np.uint8)
            part = grid[y : y + 16, x : x + 16]
            block[: part.shape[0], : part.shape[1]] = part
            data = tiff.lzw(np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).tobytes())
            starts.append((len(out), len(data)))
            out += data
    lists = len(out)
    out += struct.pack(">8I", *[s for s, _ in starts], *[n for _, n in starts])
    struct.pack_into(">I", out, 4, len(out))
    entries = [(256, 4, 1, 24), (257, 4, 1, 20), (258, 3, 1, 8), (259, 3, 1, 5), (277, 3, 1, 1), (317, 3, 1, 2), (322, 4, 1, 16), (323, 4, 1, 16), (324, 4, 4, lists), (325, 4, 4, lists + 16)]
    out += struct.pack(">H", len(entries))
    for tag, kind, n, v in entries:
        out += struct.pack(">HHI", tag, kind, n) + (struct.pack(">HH", v, 0) if kind == 3 else struct.pack(">I", v))
    out += b"\0\0\0\0"
    ((facts, pixels),) = tiff.pages(bytes(out))
    assert pixels == grid.tobytes() and facts["width"] == 24


def test_tool_calls(spark):
    calls = [("c", "1", 1, "t", '{"n": 3, "s":"x\\u00e9"}', ["9", "2"]), ("c", "2", 2, "t", '{"n":"3"}', []), ("c", "3", 3, "t", '{"n":1', ["1"]), ("c", "4", 4, "u", "{}", ["5"]), ("c", "5", 5, "t", '{"s":"abcd","z":1}', ["4"]), ("d", "1", 1, "t", '{"n":99}', []), ("d", "1", 1, "t", '{"n":99}', []), ("d", None, 2, "t", "{}", []), (None, "1", 1, "t", "{}", []), ("e", "1", 1, None, None, None), ("f", "1", None, "t", "[1]", [])]
    results = [("c", "1", 7, 'say "hi"\n'), ("c", "1", 8, "later"), ("d", "1", 2, None), ("d", "77", 2, "no call")]
    schema = {"type": "object", "properties": {"n": {"type": "integer", "maximum": 10}, "s": {"type": "string", "maxLength": 3, "enum": ["xé", "abcd"]}}, "required": ["n"], "additionalProperties": False}
    c = spark.createDataFrame([(*r, "x") for r in calls], "conv_id string, call_id string, seq long, name string, arguments string, depends_on array<string>, level string")
    r = spark.createDataFrame(results, "conv_id string, call_id string, seq long, content string")
    got = defaultdict(list)
    for x in toolcalls.link(c, r, {"t": schema}).collect():
        got[x["conv_id"], x["call_id"]].append(x)
    one = got["c", "1"][0]
    assert one["valid"] and one["linked"] and one["level"] == 1 and one["record"] == '{"arguments":{"n":3,"s":"xé"},"id":"1","name":"t","result":"say \\"hi\\"\\n"}'
    assert json.loads(one["record"])["result"] == 'say "hi"\n'
    assert got["c", "2"][0]["level"] == 0 and got["c", "2"][0]["errors"] == "n: type"
    assert got["c", "3"][0]["level"] == 2 and got["c", "3"][0]["errors"] == "not JSON" and json.loads(got["c", "3"][0]["record"])["arguments"] is None
    assert got["c", "4"][0]["level"] is None and "cyclic" in got["c", "4"][0]["errors"] and "unknown tool" in got["c", "4"][0]["errors"]
    assert got["c", "5"][0]["errors"] == "n: missing; s: maxLength; z: unknown; cyclic"
    assert len(got["d", "1"]) == 2 and got["d", "1"][0]["errors"] == "n: maximum" and got["d", "1"][0]["linked"]
    assert got["e", "1"][0]["errors"] == "unknown tool" and "not an object" in got["f", "1"][0]["errors"]
    assert sum(map(len, got.values())) == 9
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(*toolcalls.turns_as_calls(empty), toolcalls.TURN_TOOLS).count() == 0


def test_tool_call_schemas(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1,"b":2}',)], "j string")
    rows = df.select("j", toolcalls.schema_errors(F.col("j"), {"properties": {"a": {"type": "integer"}}, "required": ["b"]}).alias("e")).collect()
    assert {r["j"]: r["e"] for r in rows} == {'{"a":1}': ["b: missing"], '{"a":1,"b":2}': []}
    for bad in ({"properties": {"a": {"pattern": "x"}}}, {"properties": {"a": {"type": "object", "properties": {}}}}, {"minProperties": 1}, {"type": "array"}):
        with pytest.raises(ValueError):
            toolcalls.schema_errors(F.col("j"), bad)


def test_tool_calls_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(queries.OP3_SQL).df()
    got = queries.op3_tool_calls(spark, SF).toPandas()
    key = ["conv_id", "call_id"]
    want, got = (x.sort_values(key).reset_index(drop=True)[sorted(x.columns)] for x in (want, got))
    assert (got == want).all().all() and len(got)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    library = Tokenizer.from_file(queries.WORD_BPE)
    kept = {r["doc_id"] for r in out}
    assert len(kept) == len(out) and 0.5 * len(docs) < len(kept) < len(docs)
    for r in out[:50]:
        assert list(r["ids"]) == library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
    root, _ = _plain_components([docs[i] for i in sorted(kept)], 5, 80)
    assert root == list(range(len(kept)))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in kept) < 10


def test_pipeline_stages_odd(spark, odd, none):
    import corpus_pipeline

    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (odd, none):
            out = stage(spark, df, SF)
            if k < 4:
                assert out.columns == df.columns
            assert out.count() <= df.count()
