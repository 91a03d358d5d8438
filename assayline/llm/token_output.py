"""Token ids of documents in compressed, checksummed files, and back."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.scratch import scratch_path
from . import _bytes as B
from .id_coder import decode, encode


@dataclass(frozen=True)
class TokenParams:
    """``segment_ids``: a segment, one row of a file, holds whole documents of at least so many ids; ``cache_bits``: a Python worker has places for
    ``1 << cache_bits`` pieces whose ids it keeps, and forgets all when they have four times as many ids."""

    tokenizer: str
    end_id: int = 0
    block_ids: int = 1024
    segment_ids: int = 3 << 20
    cache_bits: int = 21
    slice_bytes: int = 1 << 21


#: Bytes next to which a space certainly begins a new piece of the tokenizer's own splitting.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
#: First bytes of Latin letters, none of which is white space.
_LETTER = np.zeros(256, bool)
_LETTER[0xC3:0xCA] = True
#: Second bytes of the two signs that begin like letters (and of some letters).
_SIGN = np.zeros(256, bool)
_SIGN[[0x97, 0xB7]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
#: Visible ASCII that is neither letter nor digit; an apostrophe may be part of a piece with letters.
_MARK = _PLAIN & ~_ASCII_LETTER
_MARK[0x30:0x3A] = _MARK[0x27] = False


#: Pieces that are given to the tokenizer as one text.
_JOINED = 1024
#: Bytes of the longest pieces that are kept from slice to slice.
_TOLD = 16


class Encoder:
    """A tokenizer that seldom meets a piece of a text twice.

    Byte-level tokenizers split a text before the space of a word that follows a
    visible character, and before a mark that follows a letter, whatever stands around; pieces between
    such places can so be encoded apart. Any other tokenizer keeps texts whole, and so does a text that holds one
    of the tokenizer's added tokens.
    """

    def __init__(self, params: TokenParams) -> None:
        # Spark runs a task on each core; the tokenizer's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(params.tokenizer)
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.splits = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or []]
        # A normalizer may change what a text holds before it is split.
        self.splits = self.splits and not spec.get("normalizer")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        # A byte-level vocabulary writes each byte as one character.
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.bits = params.cache_bits
        self._forget()

    def _forget(self) -> None:
        """Empties the table of short pieces: at its place a piece's bytes as two numbers and their count, where its ids begin among all kept, and how many they are."""
        self.head, self.tail, self.length = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint8)
        self.begin, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(cuts, sure)``: the places where pieces begin or end, and which pieces begin with a cut's space and end at a cut."""
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        if self.splits and len(raw) > 2:
            before, at, after = raw[:-2], raw[1:-1], raw[2:]
            second = np.zeros(len(before), bool)
            second[1:] = _LETTER[raw[:-3]] & (before[1:] >= 0x80)
            mark = (_ASCII_LETTER[before] | (second & ~_SIGN[before])) & _MARK[at]
            # Both neighbours must be of the same document.
            cut = ((at == 0x20) & (_PLAIN[before] | second) & (_PLAIN[after] | _LETTER[after]) | mark) & ~edge[1:-2] & ~edge[2:-1]
            data = raw.tobytes()
            for token in self.added:
                at = data.find(token)
                while at >= 0:
                    row = np.searchsorted(offsets, at, side="right") - 1
                    cut[max(offsets[row] - 1, 0) : max(offsets[row + 1] - 1, 0)] = False
                    at = data.find(token, offsets[row + 1])
            edge[1:-2] |= cut
        cuts = np.flatnonzero(edge)
        edge[offsets] = False
        inner, space = edge[cuts], np.append(raw, 0)[cuts] == 0x20
        return cuts, inner[:-1] & space[:-1] & inner[1:]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all texts, one after the other, and how many each has."""
        raw, offsets = B.utf8(column)
        cuts, sure = self._pieces(raw, offsets)
        start, end = cuts[:-1], cuts[1:]
        begin, n = self._of_pieces(raw, start, end, sure)
        upto = np.cumsum(n)
        place = np.repeat(begin - (upto - n), n)
        place += np.arange(len(place))
        ends = np.concatenate([[0], upto])[np.searchsorted(cuts, offsets)] if len(cuts) else np.zeros(len(offsets), np.int64)
        return self.ids.take(place), np.diff(ends)

    def _encode_apart(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, sizes)`` of texts that are encoded one by one."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _encode_joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces that are sure: joined they are cut at the same places, and ids' bytes tell whose they are."""
        lines = [b"".join(texts[i : i + _JOINED]).decode() for i in range(0, len(texts), _JOINED)]
        found = [np.array(e.ids, np.uint32) for line in lines for e in self.tokenizer.encode_batch_fast([line], add_special_tokens=False)]
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        upto = np.cumsum(self.bytes_of[np.minimum(ids, len(self.bytes_of) - 1)])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        last = np.searchsorted(upto, ends)
        if len(ids) and (last[-1] != len(ids) - 1 or not np.array_equal(upto[last], ends)):
            return self._encode_apart(texts)
        return ids, np.diff(last, prepend=-1)

    def _of_pieces(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(begin, size)``: where in ``self.ids`` the ids of each piece begin, and how many they are; ``sure``: as ``_pieces`` says."""
        if len(self.ids) > 4 << self.bits:
            self._forget()
        # The first and the last eight bytes and the length are all of a piece of up to sixteen; a longer one's length is
        # told as 255, which none in the table has.
        length = end - start
        view = B.eights(raw)
        head, tail = B.lane(view, start, length), B.lane(view, np.maximum(end - 8, start), length)
        told = np.where(length > _TOLD, 255, length).astype(np.uint8)
        place = (B.mix64(B.mix64(head + told) ^ tail) >> np.uint64(64 - self.bits)).astype(np.int64)
        begin, size = self.begin.take(place), self.size.take(place)
        known = (self.length.take(place) == told) & (self.head.take(place) == head) & (self.tail.take(place) == tail)
        new = np.flatnonzero(~known)
        if not len(new):
            return begin, size
        data = raw.tobytes()
        short, long_ = new[told[new] < 255], new[told[new] == 255]
        order = short[np.lexsort((told[short], tail[short], head[short]))]
        first = np.ones(len(order), bool)
        first[1:] = (head[order[1:]] != head[order[:-1]]) | (tail[order[1:]] != tail[order[:-1]]) | (told[order[1:]] != told[order[:-1]])
        seen: dict[bytes, int] = {}
        of_long = [seen.setdefault(data[a:b], i) for i, (a, b) in enumerate(zip(start[long_].tolist(), end[long_].tolist(), strict=True))]
        of_long, which_long = np.unique(np.array(of_long, np.int64), return_inverse=True)
        at = np.concatenate([order[first], long_[of_long]])
        begins, sizes = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        for which, encoded in ((sure[at], self._encode_joined), (~sure[at], self._encode_apart)):
            some = at[which]
            ids, counts = encoded([data[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
            sizes[which], begins[which] = counts, len(self.ids) + np.cumsum(counts) - counts
            self.ids = np.concatenate([self.ids, ids])
        # Of short pieces with one place the last keeps it, in all tables.
        n = int(first.sum())
        kept, where = at[:n], place[at[:n]]
        self.head[where], self.tail[where], self.length[where] = head[kept], tail[kept], told[kept]
        self.begin[where], self.size[where] = begins[:n], sizes[:n]
        back = np.cumsum(first) - 1
        begin[order], size[order] = begins[back], sizes[back]
        begin[long_], size[long_] = begins[n + which_long], sizes[n + which_long]
        return begin, size


@lru_cache(maxsize=1)
def _encoder(params: TokenParams) -> Encoder:
    """The encoder of a Python worker, which serves many tasks; the tokenizer's file mustn't change meanwhile."""
    return Encoder(params)


_SEGMENT = "part int, before long, doc_ids array<long>, lengths array<int>, n_ids long, data binary"


def write_ids(docs: DataFrame, path: str, params: TokenParams) -> None:
    """Writes each text of ``docs(doc_id, text)`` as its token ids and an end id, in ascending doc_id order.

    Rows are dealt by range of doc_id and sorted; each task cuts its range into
    segments of whole documents, and each segment into blocks that are coded from
    nothing but themselves and carry a checksum. A segment is one row: the range's
    number, the ids before it in the range, the documents' ids and lengths, and the coded blocks.
    Files are written by Spark's committer, so a lost executor leaves no half file.

    Null text counts as empty, which is an end id alone. Null doc_ids come first;
    rows of one id, however many, spread over ranges by a hash of their text, and equal ones by a seeded draw. Very long texts are encoded as a slice of their own. Other columns are ignored. An empty table writes
    no segment.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = _encoder(p)
        ids: list[np.ndarray] = []
        docs_in: list[int | None] = []
        lengths: list[np.ndarray] = []
        held = 0

        def segment() -> pa.RecordBatch:
            every = np.concatenate(ids)
            sizes = np.concatenate(lengths)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([docs_in], pa.list_(pa.int64())),
                    pa.array([sizes.tolist()], pa.list_(pa.int32())),
                    pa.array([len(every)], pa.int64()),
                    pa.array([encode(every, p.block_ids)], pa.binary()),
                ],
                ["part", "before", "doc_ids", "lengths", "n_ids", "data"],
            )

        for batch in batches:
            for piece in B.slices(batch, max_bytes=p.slice_bytes):
                found, counts = encoder.encode(piece.column("text"))
                ended = np.insert(found, np.cumsum(counts), np.uint32(p.end_id))
                ids.append(ended)
                lengths.append(counts + 1)
                docs_in += piece.column("doc_id").to_pylist()
                held += len(ended)
                if held >= p.segment_ids:
                    yield segment()
                    ids, docs_in, lengths, held, before = [], [], [], 0, before + held
        if held:
            yield segment()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["doc_id", "text_hash", "draw"]
    ranged = slim.withColumns({"text_hash": F.xxhash64("text"), "draw": F.rand(3)}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged.select("doc_id", "text").mapInArrow(run, _SEGMENT).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SEGMENT).parquet(path)


def range_starts(segments: DataFrame) -> DataFrame:
    """``(part, first)``: the ids before each range; as many rows as ``write_ids`` had tasks."""
    upto = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return segments.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from files of ``write_ids``; ``digest``: ``ids_crc32`` in place of ``ids``.

    ``start`` counts the ids of all documents before. Damaged blocks raise an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in ("first", "doc_ids", "lengths", "data")}
                ids = decode(row["data"].as_py())
                lengths = np.asarray(row["lengths"].values).astype(np.int64)
                ends = np.cumsum(lengths)
                first = row["first"].as_py()
                if digest:
                    little = ids.astype("<u4")
                    last = pa.array([zlib.crc32(little[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [row["doc_ids"].values, pa.array(first + ends - lengths), pa.array(lengths), last],
                    ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    last = "ids_crc32 long" if digest else "ids array<int>"
    rows = segments(spark, path)
    # A row of two numbers for each task that wrote.
    placed = rows.join(F.broadcast(range_starts(rows)), "part")
    placed = placed.select((F.col("first") + F.col("before")).alias("first"), "doc_ids", "lengths", "data")
    return placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def ids_round_trip(docs: DataFrame, params: TokenParams) -> DataFrame:
    """``docs`` written to the shared folder and read back as ``(doc_id, start, n_tokens, ids_crc32)``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids")
    write_ids(docs, path, params)
    return read_ids(spark, path, digest=True)
