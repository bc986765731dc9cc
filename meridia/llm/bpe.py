"""Exact BPE encoding by backtracking over longest matches, and decoding by an offset table.

A word is a string of symbols, one character each; its last symbol is shifted to mark the end of the word.
An Aho-Corasick automaton finds the longest token at each place. The encoder places tokens from left to right,
longest first, and takes a token only if it is compatible with the one before it: two tokens are compatible if
the merges of their joined text end in just these two. A sequence whose neighbours are all compatible is the
result of the merges, so the result is exact, and as each place is given up at most once the time is linear.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .textkit import WHITE_SPACE, chunks, fields, mapped, Memo, only, owned, slices, word_and_signs

#: Added to the code of a word's last symbol.
_END = 0x4000

#: Below U+0250 nothing composes, and all Unicode versions agree on letters, digits and cases.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")

#: The normaliser of the files that are read here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind: NFC, white space dropped, lower case, split by a pattern, byte-level BPE with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not suffix or spec["normalizer"] != NORMALIZER or splits[0]["behavior"] != "Removed" or splits[1]["type"] != "ByteLevel" or spec.get("decoder") or model.get("dropout"):
            raise ValueError(f"{path}: not a word-end BPE file of the kind that this encoder reads")
        pattern = splits[0]["pattern"]["Regex"].replace(r"^\s", "^" + WHITE_SPACE)
        self._words = regex.compile(pattern).findall
        self._library = Tokenizer.from_file(path)  # for its normalizer and pre-tokenizer
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special, self._special_split = special, re.compile("(" + "|".join(sorted(map(re.escape, special), key=len, reverse=True)) + ")") if special else None

        size = max([*model["vocab"].values(), *special.values()]) + 1
        names: list[str] = [""] * size
        for token, i in [*model["vocab"].items(), *special.items()]:
            names[i] = token
        encoded = [x.encode() for x in names]
        self.blob = b"".join(encoded)
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(x) for x in encoded], out=self.offsets[1:])
        self._pieces = [self.piece(i) for i in range(size)]
        self._decimal = [str(i) for i in range(size)]

        def symbols(token: str) -> str:
            if token.endswith(suffix):
                token = token[: -len(suffix)]
                return token[:-1] + chr(ord(token[-1]) + _END)
            return token

        self._bytes = byte_symbols()
        self._ids = {symbols(t): i for t, i in model["vocab"].items()}
        missing = [b for b in self._bytes if b not in self._ids or chr(ord(b) + _END) not in self._ids]
        if missing:
            raise ValueError(f"{path}: no token for bytes {missing}")
        self._rank = array("i", [-1]) * size
        self._left, self._right = array("i", [-1]) * size, array("i", [-1]) * size
        self._pair: dict[int, int] = {}
        self._size = size
        length = array("i", [0]) * size
        for s, i in self._ids.items():
            length[i] = len(s)
        self._length = length
        sound = bytearray(size)
        for b in self._bytes:
            sound[self._ids[b]] = sound[self._ids[chr(ord(b) + _END)]] = 1
        made = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            l, r = self._ids[symbols(a)], self._ids[symbols(b)]
            t = self._ids[symbols(a) + symbols(b)]
            self._pair.setdefault(l * size + r, rank)
            if self._rank[t] < 0 and not sound[t]:
                self._rank[t], self._left[t], self._right[t] = rank, l, r
                made.append(t)
        for t in made:  # a token that the merges never make of its own text can't be part of a result
            l, r = self._left[t], self._right[t]
            sound[t] = sound[l] and sound[r] and self._meet(l, r, self._rank[t])
        self._sound = sound
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self._ids.items():
            if sound[i]:
                machine.add_word(s, i)
        machine.make_automaton()
        self._machine = machine
        self._prefix = array("i", [-1]) * size
        for s, i in self._ids.items():
            if sound[i]:
                self._prefix[i] = next((j for k in range(len(s) - 1, 0, -1) if (j := self._ids.get(s[:k], -1)) >= 0 and sound[j]), -1)
        self._compatible: dict[int, bool] = {}
        self._kept = Memo(self._split, 600_000)  # plain words and signs, some 150 MB
        self._memo = Memo(self._chunk, 400_000)

    def _meet(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge across the border of a and b comes before `limit`, looking back through both tokens' merges.

        Of the two, the one made last is undone; ties are made from left to right, so the right one is the last.
        """
        rank, pair, size = self._rank, self._pair, self._size
        while True:
            if pair.get(a * size + b, limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self._right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self._left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as it is asked."""
        key = a * self._size + b
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) >= 1_000_000:
                self._compatible.clear()
            known = self._compatible[key] = self._meet(a, b, 1 << 30)
        return known

    def _word(self, word: str) -> list[int]:
        """The ids of one word of the split pattern, given by its byte symbols."""
        s = word[:-1] + chr(ord(word[-1]) + _END)
        whole = self._ids.get(s)
        if whole is not None and self._sound[whole]:
            return [whole]
        n, length, prefix = len(s), self._length, self._prefix
        best = [-1] * n
        for end, t in self._machine.iter(s):
            best[end - length[t] + 1] = t  # ends ascend, so the longest stays
        out: list[int] = []
        dead, at, t = bytearray(n + 1), 0, best[0]
        while at < n:
            while t >= 0 and (dead[at + length[t]] or (out and not self.compatible(out[-1], t))):
                t = prefix[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = best[at] if at < n else -1
            else:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
                t = prefix[t]
        return out

    def _split(self, chunk: str) -> bytes:
        if _BEYOND_LATIN.search(chunk):
            words = [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(chunk)]
        else:
            words = ["".join([self._bytes[b] for b in w.encode()]) for w in self._words(chunk)]
        ids: list[int] = []
        for word in words:
            ids += self._word(word)
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        parts = word_and_signs(chunk)
        return self._split(chunk) if parts is None else self._kept[parts[0]] + self._kept[parts[1]] if parts[1] else self._kept[parts[0]]

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian 32-bit integers."""
        if _BEYOND_LATIN.search(text):  # the library's own Unicode tables
            text = self._library.normalizer.normalize_str(text)
        else:  # composed already
            text = text.lower()
        return b"".join(map(self._memo.__getitem__, chunks(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids; null counts as empty. Special tokens are found in the raw text."""
        if not text:
            return np.zeros(0, "<u4")
        if self._special_split is not None and self._special_split.search(text):
            parts = self._special_split.split(text)
            raw = b"".join(np.array([self._special[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(parts))
        else:
            raw = self._plain(text)
        return np.frombuffer(raw, "<u4")

    def piece(self, i: int) -> str:
        """The text of one id, from the offset table."""
        return self.blob[self.offsets[i] : self.offsets[i + 1]].decode()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined by spaces, as the file has no decoder of its own."""
        return " ".join(map(self._pieces.__getitem__, ids))

    def decimals(self, ids: list[int]) -> str:
        return " ".join(map(self._decimal.__getitem__, ids))


@functools.lru_cache(2)
def load(path: str) -> WordBpe:
    """One model a worker process."""
    owned(__name__, load.cache_clear)
    return WordBpe(path)


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of `docs` and `ids`, an array of the token ids of column `text` (null and empty texts: an empty array).

    Whole texts are encoded; rows, repeated or not, stay as they are. A column that is called as `ids` already is replaced.
    """
    keep = docs.drop(ids)
    schema = T.StructType([*keep.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for b in slices(batches):
            at = b.schema.get_field_index(text)
            found = [codec.encode(x).astype(np.int32) for x in b.column(at).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[*b.schema.names, ids])

    return mapped(keep, run, schema, __name__)


def decode_column(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of `df` and `text`, decoded from the ids (null: null). An id beyond the table raises IndexError."""
    keep = df.drop(text)
    schema = T.StructType([*keep.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for b in slices(batches):
            at = b.schema.get_field_index(ids)
            found = [None if x is None else codec.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, text])

    return mapped(keep, run, schema, __name__)


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256, from encoding the text and decoding the ids; and ids if asked.

    Null and empty texts have no ids and decode to the empty string. Other columns are left out; decoded texts stay in
    the worker.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = load(path), lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in slices(batches):
            counts, coded, back, own = [], [], [], []
            for x in b.column(1).to_pylist():
                found = codec.encode(x)
                ids = found.tolist()
                counts.append(len(ids))
                coded.append(sha(codec.decimals(ids)))
                back.append(sha(codec.decode(ids)))
                own.append(found.astype(np.int32))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    thin = only(docs, doc_id=doc_id, text=text)
    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    return mapped(thin, run, T.StructType([thin.schema["doc_id"], *fields("n_tokens long, ids_sha256 string, decoded_sha256 string"), *more]), __name__)
