"""Token-id output: documents as ids, each compressed on its own with a shared zstandard dictionary.

A *segment* is one binary value of this little-endian layout::

    magic  b"LXT1"                      4 bytes
    dictionary id (xxh64 of it)         u8
    documents in the segment  d         u4
    bytes of one id           w         u4
    d x (doc_id i8, n_tokens u4, end of its frame u8)   the offset index
    d zstandard frames, in doc_id order

Segments are the rows of a Parquet table (``part``, ``seq``, least and greatest id, sizes,
``segment``), so that Spark's commit protocol makes each file whole or absent on any file system,
and a reader prunes to the segments that can hold an id. The dictionary is one row of a second
table beside it. Both are in folders below the path given.
"""

from __future__ import annotations

import decimal
import json
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, unit_hash, write_once
from .hashing import slices, small_batches

MAGIC = b"LXT1"
_HEAD = struct.Struct("<4sQII")
_ENTRY = np.dtype([("doc", "<i8"), ("tokens", "<u4"), ("end", "<u8")])
#: The id that ends a document.
END_ID = 2
#: Ids of a document without a doc_id are kept under this one.
NO_ID = -(1 << 63)
_STATE: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, read once in each worker."""
    if path not in _STATE:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _STATE[path] = Tokenizer.from_file(path)
    return _STATE[path]


#: White space other than single spaces and line feeds inside a text (RE2).
_UNEVEN = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: Latin letters, which end a piece where an ASCII sign follows, and ASCII signs.
_LETTERS, _SIGNS = "A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}", r"!-/:-@\[-`{-~"
_PLAIN = re.compile("\r?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch


class Encoder:
    """Whole texts to ids with the end id, by way of their distinct words.

    Where all white space of a text is single spaces and line feeds, each of them begins a piece that
    the tokenizer encodes on its own. Words are split and numbered by Arrow, each distinct one is encoded once,
    and texts are put together from them. That is exact for byte-level BPE with the usual split and no
    normaliser, which is looked up in the tokenizer's file; with any other tokenizer, and for other texts and those
    that hold the string of an added token, the whole text is encoded. About ``most`` words are kept,
    those met in the most batches.

    A word also ends where a sign follows a Latin letter, and before and after a line feed. Its key is the word if a
    space stands before it, else it begins with a carriage return.
    """

    def __init__(self, path: str, width: int, most: int = 500_000):
        self.tok, self.kind, self.most = tokenizer(path), f"<u{width}", most
        spec = json.loads(self.tok.to_str())
        self.by_word = spec.get("normalizer") is None and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
        self.by_word &= spec.get("pre_tokenizer", {}) == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.uneven = "|".join([_UNEVEN, *(re.escape(t["content"]) for t in spec.get("added_tokens", []))])
        self.model = self.tok.model
        # In byte-level BPE printable bytes stand for themselves, the others for the characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.names = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self._forget([], None)

    def _forget(self, kept: list[str], codes: np.ndarray | None) -> None:
        """Keep only these keys."""
        flat, end = array("H" if self.kind == "<u2" else "I"), array("q", [0])
        if kept:
            ids, size = self._join(codes)
            flat.frombytes(ids.tobytes())
            end.frombytes(np.cumsum(size).astype(np.int64).tobytes())
        self.code, self.flat, self.end = {k: i for i, k in enumerate(kept)}, flat, end
        self.met = np.zeros(len(kept), np.int64)

    def _join(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, end to end, and the length of each."""
        flat, end = np.frombuffer(self.flat, self.kind) if len(self.flat) else np.empty(0, self.kind), np.frombuffer(self.end, np.int64)
        size = end[codes + 1] - end[codes]
        upto = np.cumsum(size)
        return flat[np.repeat(end[codes + 1] - upto, size) + np.arange(upto[-1] if len(upto) else 0)], size

    def _add(self, key: str, ids: list[int]) -> int:
        n = self.code[key] = len(self.code)
        self.flat.extend(ids)
        self.end.append(len(self.flat))
        return n

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """Numbers of the keys; new ones are learned. A word of letters is one piece, others are split by the tokenizer."""
        code, tokenize = self.code, self.model.tokenize
        found = list(map(code.get, keys))
        new = [i for i, n in enumerate(found) if n is None]
        other = []
        for i in new:
            key = keys[i]
            if not _PLAIN(key):
                other.append(i)
                continue
            name = key[1:] if key[0] == "\r" else " " + key
            name = "Ġ" + key if key.isascii() and key[0] != "\r" else name.encode().decode("latin-1").translate(self.names)
            found[i] = self._add(key, [t.id for t in tokenize(name)])
        texts = [keys[i][1:] if keys[i][0] == "\r" else " " + keys[i] for i in other]
        for i, e in zip(other, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            found[i] = self._add(keys[i], [END_ID] if keys[i] == "\r\r" else e.ids)
        out = np.array(found, np.int64)
        if len(code) > len(self.met):
            self.met = np.concatenate([self.met, np.zeros(len(code) - len(self.met), np.int64)])
        self.met[out] += 1
        return out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Meant for some hundred thousand characters at a time."""
        if len(self.code) > self.most:
            least = np.sort(self.met)[-self.most // 2]
            kept = np.flatnonzero(self.met > least)
            names = list(self.code)
            self._forget([names[i] for i in kept], kept)
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.uneven) if self.by_word else pa.array([True] * len(texts))
        plain = pc.replace_substring_regex(pc.if_else(odd, "", texts), f"([{_LETTERS}])([{_SIGNS}])", "\\1 \r\\2")
        plain = pc.replace_substring(plain, "\n", " \r\n \r")
        words = pc.split_pattern(pc.binary_join_element_wise("\r", plain, " \r\r", ""), " ")
        coded = words.flatten().dictionary_encode()
        ids, size = self._join(self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(pc.list_value_length(words).to_numpy())]
        out = [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        for i, e in zip(whole, self.tok.encode_batch_fast(texts.take(pa.array(whole, pa.int64())).to_pylist(), add_special_tokens=False)):
            out[i] = np.array([*e.ids, END_ID], self.kind)
        return out


def encode(texts: pa.Array, path: str, width: int) -> list[np.ndarray]:
    """Ids of whole texts with the end id, as little-endian unsigned integers of ``width`` bytes."""
    key = (path, width)
    if key not in _STATE:
        _STATE[key] = Encoder(path, width)
    return _STATE[key](texts)


def id_width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, samples: int = 1000, sample_ids: int = 4096, size: int = 65536) -> bytes:
    """A zstandard dictionary of serialized id arrays.

    Learned on about ``samples`` documents at most, chosen by a hash of their id; of each it takes at most
    ``sample_ids`` ids in a row from a place chosen by hash. This bounds what comes to the driver. Where
    there is too little to learn from, the dictionary is the raw content of the samples.
    """
    n = max(1, docs.count())
    some = docs.where(unit_hash(F.col("id")) < F.lit(min(1.0, samples / n))).select("text")
    width = id_width(path)

    def run(batches):
        for batch in small_batches(batches, "text"):
            found = []
            for x in encode(batch.column(0), path, width):
                a = xxhash.xxh64_intdigest(x.tobytes()) % max(1, len(x) - sample_ids + 1)
                found.append(x[a : a + sample_ids].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["ids"])

    found = sorted(r["ids"] for r in some.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, found).as_bytes()
    except zstandard.ZstdError:
        return b"".join(found)[:size]


def pack(entries: list[tuple[int, int, int]], frames: list[bytes], mark: int, width: int) -> bytes:
    """A segment of (doc_id, n_tokens, end of frame) entries and their frames."""
    return _HEAD.pack(MAGIC, mark, len(entries), width) + np.array(entries, _ENTRY).tobytes() + b"".join(frames)


def _writer(path: str, dictionary: bytes, segment_bytes: int, level: int):
    width = id_width(path)
    mark = xxhash.xxh64_intdigest(dictionary)

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        with_dict = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        entries, frames, at, total = [], [], 0, 0

        def segment():
            row = [[part], [seq], [entries[0][0]], [entries[-1][0]], [len(entries)], [total], [pack(entries, frames, mark, width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seq", "first_id", "last_id", "docs", "tokens", "segment"])

        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(size, 1_000_000):
                ids, texts = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a)
                for i, x in zip(ids, encode(texts, path, width)):
                    frame = with_dict.compress(x)
                    at += len(frame)
                    total += len(x)
                    frames.append(frame)
                    entries.append((NO_ID if i is None else i, len(x), at))
                    if at >= segment_bytes:
                        yield segment()
                        seq += 1
                        entries, frames, at, total = [], [], 0, 0
        if entries:
            yield segment()

    return run


def write_tokens(docs: DataFrame, to: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 1 << 20, level: int = 3, partitions: int | None = None) -> None:
    """Write all documents in ascending doc_id order below the path ``to``.

    Null texts are empty ones and hold the end id only; documents with a null id come first;
    repeated rows are written as often as given, rows of one id in order of a hash of their text. Further
    columns are ignored. An empty table gives a store without segments.
    """
    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long"), "text")
    dictionary = train_dictionary(rows, tokenizer_path)
    schema = "mark decimal(20,0), dictionary binary"
    spark.createDataFrame([(decimal.Decimal(xxhash.xxh64_intdigest(dictionary)), bytearray(dictionary))], schema).coalesce(1).write.parquet(f"{to}/dictionary")
    # Rows of one id, or without one, are dealt out by their text's hash, copies by where they stand.
    keys = [F.col("id").asc_nulls_first(), "h", "at"]
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).select("id", "text")
    out = dealt.mapInArrow(_writer(tokenizer_path, dictionary, segment_bytes, level), "part int, seq int, first_id long, last_id long, docs long, tokens long, segment binary")
    write_once(out, f"{to}/segments")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def unpack(segment: bytes, dictionary: bytes):
    """(doc_id, ids) of the documents in a segment; a wrong dictionary or magic is an error."""
    magic, mark, n, width = _HEAD.unpack_from(segment)
    if magic != MAGIC or mark != xxhash.xxh64_intdigest(dictionary):
        raise ValueError("not a segment of this dictionary")
    index = np.frombuffer(segment, _ENTRY, n, _HEAD.size)
    start, back = _HEAD.size + index.nbytes, zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    begin = 0
    for doc, tokens, end in index:
        yield int(doc), np.frombuffer(back.decompress(segment[start + begin : start + int(end)], max_output_size=int(tokens) * width), f"<u{width}")
        begin = int(end)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """The documents of a store: doc_id, start (ids of all documents before), n_tokens, ids (packed u4).

    With ``digest`` the unsigned crc32 of the packed ids, ids_crc32, is in their place, made where they are read.
    """
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")
    segments = spark.read.parquet(f"{path}/segments")
    dictionary = _dictionary(spark, path)
    # Ids before each segment: its part's beginning (a row for each written partition comes to the
    # driver) and the segments before it in the part.
    parts = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    begin, total = {}, 0
    for part, n in parts:
        begin[part] = total
        total += n
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    places = segments.select("part", "seq", "tokens").withColumn("within", F.coalesce(within, F.lit(0))).drop("tokens")

    def run(batches):
        for batch in batches:
            for body, part, before in zip(*(batch.column(c).to_pylist() for c in ("segment", "part", "within"))):
                at, out = begin[part] + before, ([], [], [], [])
                for doc, ids in unpack(body, dictionary):
                    packed = ids.astype("<u4").tobytes()
                    for x, v in zip(out, (None if doc == NO_ID else doc, at, len(ids), zlib.crc32(packed) if digest else packed)):
                        x.append(v)
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()))], ["doc_id", "start", "n_tokens", last])

    return segments.join(places, ["part", "seq"]).select("segment", "part", "within").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {kind}")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document, by way of the offset index: only its frames are decompressed."""
    dictionary = _dictionary(spark, path)
    rows = spark.read.parquet(f"{path}/segments").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "seq").select("segment").collect()
    found, back = [], zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    for row in rows:
        segment = bytes(row["segment"])
        _, _, n, width = _HEAD.unpack_from(segment)
        index = np.frombuffer(segment, _ENTRY, n, _HEAD.size)
        for k in np.flatnonzero(index["doc"] == doc_id):
            a = _HEAD.size + index.nbytes + (int(index["end"][k - 1]) if k else 0)
            b = _HEAD.size + index.nbytes + int(index["end"][k])
            found.append(np.frombuffer(back.decompress(segment[a:b], max_output_size=int(index["tokens"][k]) * width), f"<u{width}").tolist())
    return found
