"""Byte-level BPE by a global shuffle of distinct words.

1.  Documents are cut into pre-tokens, a block of some million at a time.  A
    block keeps its distinct words, and each text as positions into them.
2.  The words of all blocks are dealt out by a hash: a word meets itself from
    all blocks in one bucket, where it is encoded once.  A block's words of a
    bucket travel as one packed row.
3.  The ids go back to their block, where the texts are put together by
    position.  Decoding looks every id up in the table of token bytes.

Texts are cut twice, once for their words and once for the positions: that
costs less than a written copy of the positions.  A block is known by a hash of
its place (partition, and number within it), its words and its ids, so blocks of
equal content stay apart, and a pass that met other rows fails instead of mixing
them up; rows in no fixed order should be written first.

Blocks are bounded, so no task holds more than one block of texts and one
bucket's row of words.  The ranks come from a file named by a parameter, are
read once by the driver (under a megabyte) and sent along.

Edge cases: null and empty texts have no ids; a text longer than a block is a
block of its own; bytes that are no characters cannot occur, as texts are
strings; repeated rows are encoded row by row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens of a block, and texts in one packed row of it.
BLOCK_TOKENS, PART_ROWS = 2_000_000, 128
SLICE = 256
#: Distinct words whose ids a bucket remembers.
REMEMBERED = 1_000_000
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters that both regular expression modules class alike.
PLAIN = re.compile("[^\\t-\\r -~\\xc0-\\u024f\\u2010-\\u2027]")


class Splitter:
    """The pre-tokens of a text. The general pattern is the caller's; texts of
    plain characters take the same pattern in a faster module."""

    def __init__(self, pattern: str) -> None:
        self.general = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        quick = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.quick = re.compile(quick) if r"\p" not in quick else None

    def __call__(self, text: str) -> list[str]:
        if self.quick and not PLAIN.search(text):
            return self.quick.findall(text)
        return self.general.findall(text)


class Positions(dict):
    """Word -> number in the order of first sight."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def packed(values: np.ndarray) -> list[bytes]:
    """Byte planes of unsigned 32-bit numbers, compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return [squeeze(planes[:, k].tobytes()) for k in range(4)]


def unpacked(planes: list[bytes]) -> np.ndarray:
    open_up = zstandard.ZstdDecompressor().decompress
    return np.column_stack([np.frombuffer(open_up(p), dtype=np.uint8) for p in planes]).astype(np.uint8).copy().view("<u4").reshape(-1) if planes else np.zeros(0, "<u4")


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The lines of a rank file: base64 of a token's bytes, blank, rank."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in zlib.decompress(data).splitlines() if line)}


class Gather:
    """``values[starts[i] : starts[i] + lengths[i]]`` for many i, joined."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values, self.lengths = values, lengths.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        n = self.lengths[at]
        ends = np.cumsum(n)
        if not len(n) or not ends[-1]:
            return self.values[:0]
        step = np.repeat(self.starts[at] - (ends - n), n)
        return self.values[step + np.arange(ends[-1])]


def _block(place: tuple[int, int], words: Positions, rows: list[tuple], buckets: int, with_words: bool) -> pa.RecordBatch:
    """The packed rows of one block: kind 0 words by bucket, or 1 their order and 2 texts."""
    names = [w.encode("utf-8", "replace") for w in words]
    number = int(np.uint64(xxhash.xxh64_intdigest(pickle.dumps((place, names, [r[0] for r in rows])))).view(np.int64))
    bucket = [zlib.crc32(w) % buckets for w in names]
    order = np.array(sorted(range(len(names)), key=lambda i: (bucket[i], names[i])), dtype=np.int64)
    out = []
    if with_words:
        cuts = np.searchsorted(np.array(bucket, dtype=np.int64)[order], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for k in range(buckets):
            own = [names[i] for i in order[cuts[k] : cuts[k + 1]]]
            if own:
                out.append((0, k, squeeze(pickle.dumps((np.array([len(w) for w in own], dtype="<u4").tobytes(), b"".join(own))))))
    else:
        ranks = np.empty(len(names), dtype="<u4")
        ranks[order] = np.arange(len(names))
        out.append((1, 0, pickle.dumps(packed(ranks))))
        for at in range(0, len(rows), PART_ROWS):
            part = rows[at : at + PART_ROWS]
            out.append((2, at, pickle.dumps(([r[0] for r in part], [len(r[1]) for r in part], packed(np.concatenate([r[1] for r in part]))))))
    return pa.RecordBatch.from_pydict({"block": pa.array([number] * len(out), pa.int64()), "kind": pa.array([o[0] for o in out], pa.int32()), "part": pa.array([o[1] for o in out], pa.int32()), "data": pa.array([o[2] for o in out], pa.binary())})


BLOCK_SCHEMA = "block bigint, kind int, part int, data binary"


def blocks(docs: DataFrame, pattern: str, buckets: int, with_words: bool) -> DataFrame:
    """The packed rows of all blocks of ``docs`` (doc_id, text): their words, or what refers to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        words, rows, total, partition, done = Positions(), [], 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                partition = part.column("_partition")[0].as_py()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = split(text or "")
                    rows.append((doc_id, np.fromiter(map(words.__getitem__, found), dtype="<u4", count=len(found))))
                    total += len(found) + 1
                    if total >= BLOCK_TOKENS:
                        yield _block((partition, done), words, rows, buckets, with_words)
                        words, rows, total, done = Positions(), [], 0, done + 1
        if rows:
            yield _block((partition, done), words, rows, buckets, with_words)

    # the number within ``docs``, the same in both passes; that of the task counts what a union puts before it
    return docs.select("doc_id", "text", F.spark_partition_id().alias("_partition")).mapInArrow(run, BLOCK_SCHEMA)


def encoded_words(words: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """For each packed row of words (kind 0) a packed row of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_of(ranks), special_tokens={})._encode_single_piece
        open_up, known = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for block, part, data in zip(*(batch.column(k).to_pylist() for k in ("block", "part", "data")), strict=True):
                lengths, joined = pickle.loads(open_up(data))
                ids, at = [], 0
                for n in np.frombuffer(lengths, dtype="<u4").tolist():
                    word = joined[at : at + n]
                    at += n
                    found = known.get(word)
                    if found is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        found = known[word] = np.array(encode(word), dtype="<u4")
                    ids.append(found)
                out = pickle.dumps((packed(np.array([len(i) for i in ids])), packed(np.concatenate(ids))))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "kind": pa.array([0], pa.int32()), "part": pa.array([part], pa.int32()), "data": pa.array([out], pa.binary())})

    return words.mapInArrow(run, BLOCK_SCHEMA)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers) of every row of ``docs``."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = encoded_words(blocks(docs, pattern, buckets, True).repartition("part"), ranks, pattern)
    dealt = ids.union(blocks(docs, pattern, buckets, False)).repartition("block").sortWithinPartitions("block", "kind", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lists, lengths, gather, place = None, [], [], None, None
        for batch in batches:
            for at in range(batch.num_rows):
                block, what, data = (batch.column(k)[at].as_py() for k in ("block", "kind", "data"))
                if block != current:
                    current, lists, lengths, gather, place = block, [], [], None, None
                data = pickle.loads(data)
                if what == 0:
                    lengths.append(unpacked(data[0]))
                    lists.append(unpacked(data[1]))
                elif what == 1:
                    place = unpacked(data).astype(np.int64)
                    gather = Gather(np.concatenate(lists) if lists else np.zeros(0, "<u4"), np.concatenate(lengths) if lengths else np.zeros(0, "<u4"))
                else:
                    doc_ids, sizes, planes = data
                    if place is None or len(place) != len(gather.lengths):
                        raise RuntimeError("the rows to encode came in another order the second time: write them first")
                    every, ends = place[unpacked(planes)], np.cumsum(sizes)
                    found = [gather(every[e - n : e]) for n, e in zip(sizes, ends, strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, type=batch_kind), "n_tokens": pa.array([len(f) for f in found], pa.int64()), "ids": pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())})

    batch_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    return dealt.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(tokens: DataFrame, ranks: bytes, *keep: str) -> DataFrame:
    """The ``keep`` columns of ``tokens`` and decoded, the bytes that its ids stand for."""
    schema = ", ".join(f"{k} {tokens.schema[k].dataType.simpleString()}" for k in keep) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted((rank, token) for token, rank in ranks_of(ranks).items())
        lengths = np.zeros(table[-1][0] + 1, dtype=np.int64)
        lengths[[r for r, _ in table]] = [len(t) for _, t in table]
        gather = Gather(np.frombuffer(b"".join(t for _, t in table), dtype=np.uint8), lengths)
        for batch in batches:
            out = [None if b is None else gather(np.frombuffer(b, dtype="<u4").astype(np.int64)).tobytes() for b in batch.column("ids").to_pylist()]
            yield batch.select(list(keep)).append_column("decoded", pa.array(out, pa.binary()))

    return tokens.select("ids", *[k for k in keep if k != "ids"]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    ranks = read_ranks(docs.sparkSession, path)
    tokens = encode(docs, ranks, pattern).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))
    out = decode(tokens, ranks, "doc_id", "n_tokens", "ids_sha256")
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
