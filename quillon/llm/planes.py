"""Token-id output: fixed-size id blocks transposed into bit or byte planes, each compressed with zstandard, with a chunk index.

A store is a Parquet table whose rows are segments. A segment holds the ids of consecutive documents, about SEGMENT_IDS
of them, and ends where a document ends; it can be decoded on its own:

    shard, segment   int           order of the segments: shards follow ascending ids of documents
    doc_ids          array<bigint> one entry per document row, in order
    doc_tokens       array<int>    ids of each, the end id included
    width            int           bytes per id, little-endian
    chunk_index      array<struct<block int, plane int, ids int, offset int, bytes int>>
    payload          binary        the compressed planes, one after another
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._batches import holds_cache, shared_folder, written

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 19
LEVEL = 1
END_ID = 2
CACHED_WORDS = 450_000

SCHEMA = "shard int, segment int, doc_ids array<bigint>, doc_tokens array<int>, width int, chunk_index array<struct<block: int, plane: int, ids: int, offset: int, bytes: int>>, payload binary"
_INDEX = pa.list_(pa.struct([(n, pa.int32()) for n in ("block", "plane", "ids", "offset", "bytes")]))


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The byte planes of little-endian ids of `width` bytes, or their bit planes, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if not bits:
        return [raw[:, k].tobytes() for k in range(width)]
    return [np.packbits(raw[:, k // 8] >> (k % 8) & 1).tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if len(planes) == width:
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            out[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return out.reshape(-1).view("<u4")


def encode_ids(ids: np.ndarray, width: int, bits: bool = False, block_ids: int = BLOCK_IDS) -> tuple[bytes, list[dict]]:
    """(payload, chunk index) of a segment."""
    pack, out, index, at = zstandard.ZstdCompressor(level=LEVEL), [], [], 0
    for b, i in enumerate(range(0, len(ids), block_ids)):
        block = ids[i : i + block_ids]
        for k, plane in enumerate(to_planes(block, width, bits)):
            out.append(pack.compress(plane))
            index.append({"block": b, "plane": k, "ids": len(block), "offset": at, "bytes": len(out[-1])})
            at += len(out[-1])
    return b"".join(out), index


def decode_ids(payload: bytes, index: list[dict], width: int) -> np.ndarray:
    unpack, blocks = zstandard.ZstdDecompressor(), {}
    for c in index:
        blocks.setdefault(c["block"], (c["ids"], {}))[1][c["plane"]] = payload[c["offset"] : c["offset"] + c["bytes"]]
    parts = [from_planes([unpack.decompress(p[k]) for k in sorted(p)], n, width) for _, (n, p) in sorted(blocks.items())]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


#: The pre-tokens of word_bpe_49k.json's pattern in lower-cased text of code points below 256.
LATIN_PATTERN = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa00-9²³¹¼-¾a-zªµºß-öø-ÿ]+")
#: The pattern that this is the Latin form of, as the tokenizer's file has it.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """ids of texts, each distinct piece of which the library encodes once while it stays in the cache.

    With a tokenizer of the shape of word_bpe_49k.json (lower case, SPLIT_PATTERN, white space dropped, word ends), texts
    of code points below 256 are cut by LATIN_PATTERN, where NFC changes nothing and lower case is one to one; other
    texts are cut at spaces and line ends, across which the tokenizer never looks. Texts with an added token's string,
    and all texts with a tokenizer of another shape, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.added = [t["content"] for t in spec["added_tokens"]]
        parts = [p["type"] for p in (spec["normalizer"] or {}).get("normalizers", [])], [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = parts == (["NFC", "Replace", "Lowercase"], [SPLIT_PATTERN, None]) and spec["post_processor"] is None and bool(suffix)
        self.known: dict[str, bytes] = {"": b""}
        if self.by_word:
            # for pieces that are pre-tokens already
            spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            self.pieces = Tokenizer.from_str(json.dumps(spec))
            self.last = np.zeros(self.size, bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    @cached_property
    def whole(self):
        """The tokenizer as its file has it; few texts need it, so it is loaded for the first."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), 512):
            own = pieces[i : i + 512]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(own, [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word:
            return self._library(texts)
        out = []
        for i in range(0, len(texts), 100):
            if len(self.known) > CACHED_WORDS:
                self.known = {"": b""}
            known = self.known
            group: list[list[str] | bytes] = []
            new, odd = set(), set()
            for text in texts[i : i + 100]:
                if any(t in text for t in self.added):
                    group.append(self._library([text])[0])
                elif text.isascii() or max(text) <= "ÿ":
                    group.append(cut := LATIN_PATTERN.findall(text.lower()))
                    new.update(cut)
                else:
                    group.append(cut := text.replace("\n", " ").split(" "))
                    odd.update(cut)
            self._learn([w for w in new if w not in known])
            rest = [w for w in odd if w not in known]
            known.update(zip(rest, self._library(rest), strict=True))
            get = known.__getitem__
            out += [g if isinstance(g, bytes) else b"".join(map(get, g)) for g in group]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_store(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, bits: bool = False, block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, shards: int | None = None) -> DataFrame:
    """Encode whole texts, append end_id to each document, and write the ids at `path` in ascending id order.

    One range exchange of (id, text) orders the documents; each shard then streams through one task that holds a
    segment at a time. NULL ids come first, NULL and empty texts are the end id alone; rows that repeat an id stand next
    to each other, in the order of a hash of their texts; an empty table writes an empty store. Other columns are not read.
    """
    spark = docs.sparkSession

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds_cache("planes", _encoder.cache_clear)
        encoder, shard, number = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = max(1, (max(encoder.size - 1, end_id).bit_length() + 7) // 8)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            payload, index = encode_ids(np.frombuffer(b"".join(held), "<u4"), width, bits, block_ids)
            row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([width], pa.int32()), pa.array([index], _INDEX), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=["shard", "segment", "doc_ids", "doc_tokens", "width", "chunk_index", "payload"])

        total = 0
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                coded = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                for i, c in zip(part.column(0).to_pylist(), coded, strict=True):
                    ids.append(i)
                    counts.append(len(c) // 4 + 1)
                    held += (c, end)
                    total += counts[-1]
                    if total >= segment_ids:
                        yield flush()
                        number, total = number + 1, 0
                        ids.clear(), counts.clear(), held.clear()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that repeat an id, or have none, are dealt by a hash of their texts, so that they don't all meet in one shard
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ordered.mapInArrow(segments, SCHEMA), path)


def read_store(store: DataFrame) -> DataFrame:
    """(id, shard, segment, place, n_tokens, ids) of every document of a store, from its planes; ids are little-endian unsigned 32-bit."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                raw = decode_ids(row["payload"], row["chunk_index"], row["width"]).tobytes()
                ends = np.cumsum([0, *row["doc_tokens"]])
                n = len(row["doc_ids"])
                blobs = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                cols = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(ends[:-1].astype(np.int64)), pa.array(row["doc_tokens"], pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "shard", "segment", "place", "n_tokens", "ids"])

    return store.mapInArrow(documents, "id bigint, shard int, segment int, place bigint, n_tokens bigint, ids binary")


def segment_starts(store: DataFrame) -> DataFrame:
    """(shard, segment, first): ids of the store before each segment. Only shard totals meet in one task."""
    sizes = store.select("shard", "segment", F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before = Window.unboundedPreceding
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(before, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(before, -1)), F.lit(0))
    return sizes.withColumn("own", own).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("own")).alias("first"))


def id_digests(store: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the store's planes."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_py()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "shard", "segment", "place", "n_tokens")), crc], names=["id", "shard", "segment", "place", "n_tokens", "ids_crc32"])

    found = read_store(store).mapInArrow(digests, "id bigint, shard int, segment int, place bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(segment_starts(store), ["shard", "segment"]).select("id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_token_planes(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs
    store = write_store(docs, f"{shared_folder(spark)}/planes", default_tokenizer())
    return id_digests(store).withColumnRenamed("id", "doc_id")
