"""Token ids as length-delimited binary records, with a separate offset index.

Record: length of the payload (u64), masked CRC-32 of those eight bytes (u32),
payload, masked CRC-32 of the payload (u32), one 0x0A; all little-endian. The
payload holds ids of ``width`` bytes each. A mask rotates the checksum and adds
a constant, so that checksums stored inside payloads stay harmless. Files hold
contiguous ranges of doc_id; the index has one row for each record, so readers
can shuffle. Spark's own writer puts the files in place, so they reach any
store and a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.sparkkit import Table, fresh_path, remove_path, shuffle_partitions
from gridloom.llm.textkit import batch_chunks, chunks, prefix_hash, range_hash

HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
#: Pieces that the table holds before it begins anew.
CACHE_ENTRIES = 1_500_000
#: Bytes of text for one file, about.
FILE_BYTES = 32 << 20


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked_crc(size)) + payload + TAIL.pack(masked_crc(payload)) + b"\n"


def unframe(data: bytes):
    """(offset, payload) of each record; ValueError where a checksum or a length is wrong."""
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"cut short at {at}")
        size, check = HEAD.unpack_from(data, at)
        if masked_crc(data[at : at + 8]) != check:
            raise ValueError(f"length checksum at {at}")
        start = at + HEAD.size
        payload = data[start : start + size]
        if len(payload) != size or start + size + TAIL.size + 1 > len(data) or TAIL.unpack_from(data, start + size)[0] != masked_crc(payload):
            raise ValueError(f"payload checksum at {at}")
        yield at, payload
        at = start + size + TAIL.size + 1


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_padding()
    t.no_truncation()
    return t


#: Pieces of more bytes are encoded each time, not remembered by hash.
MAX_KNOWN_BYTES = 64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_IS_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
#: White space beyond ASCII, as UTF-8.
_WIDE_SPACES = re.compile(b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class _Known:
    """Ids of pieces by the piece's 64-bit hash: a sorted table, which holds the pieces' bytes too."""

    def __init__(self, dtype: np.dtype):
        self.hashes, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        self.text, self.text_at, self.text_len = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if unknown."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)

    def differ(self, rows: np.ndarray, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Whether buf[start:start+len] is not the text of its row."""
        out = self.text_len[rows] != lens
        same = np.flatnonzero(~out)
        wrong = buf[_ragged(starts[same], lens[same])] != self.text[_ragged(self.text_at[rows[same]], lens[same])]
        if wrong.any():
            out[same[np.searchsorted(np.cumsum(lens[same]), np.flatnonzero(wrong), side="right")]] = True
        return out

    def add(self, h: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray], begin: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """text: a buffer, and where each piece starts and ends in it."""
        buf, a, b = text
        order, start = np.argsort(h), begin + len(self.ids)
        text_at = len(self.text) + np.cumsum(b - a) - (b - a)
        at = np.searchsorted(self.hashes, h[order])
        self.hashes = np.insert(self.hashes, at, h[order])
        self.start, self.size = np.insert(self.start, at, start[order]), np.insert(self.size, at, sizes[order])
        self.text_at, self.text_len = np.insert(self.text_at, at, text_at[order]), np.insert(self.text_len, at, (b - a)[order])
        self.ids = np.concatenate((self.ids, ids))
        self.text = np.concatenate((self.text, buf[_ragged(a, b - a)]))


@functools.lru_cache(maxsize=2)
def _cache(path: str, dtype: str) -> list[_Known]:
    """One table for each worker process."""
    return [_Known(np.dtype(dtype))]


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


class PieceEncoder:
    """Encodes texts piece by piece, each distinct piece once while it stays in a bounded table.

    Pieces are cut where the split pattern must begin a match whatever comes
    before: a blank or line feed after a non-space, a comma or full stop after
    an ASCII letter or digit. So pieces encode as they do within the text.
    Pieces are found and looked up by hash in numpy, and every one is compared
    with the remembered text. New pieces are encoded together, again because cuts there change nothing, and told
    apart by their lengths in bytes.
    """

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype, self.table = load_tokenizer(path), np.dtype(dtype), _cache(path, dtype)
        self.lengths = _byte_lengths(path)

    @staticmethod
    def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the pieces of the texts buf[offs[i]:offs[i+1]]."""
        space = _IS_SPACE[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = ((buf[1:] == 32) | (buf[1:] == 10)) & ~space[:-1] | ((buf[1:] == 44) | (buf[1:] == 46)) & _IS_ALNUM[buf[:-1]]
        if (buf >= 0xC2).any():
            for m in _WIDE_SPACES.finditer(buf.tobytes()):
                cut[m.end()] = False
        cut[offs] = True
        cut[-1] = False
        return np.flatnonzero(cut)

    def _encode_new(self, raw: bytes, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece raw[a:b] has its ids, how many, and all ids."""
        first, last = buf[a], buf[b - 1]
        joint = ((first == 32) | (first == 10)) & ~_IS_SPACE[last] & (last < 128) & (b - a > 1)
        sizes, begin, out, done = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), [], 0
        k = np.flatnonzero(joint)
        for at in range(0, len(k), 4096):
            part = k[at : at + 4096]
            text = b"".join([raw[x:y] for x, y in zip(a[part].tolist(), b[part].tolist())]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(b[part] - a[part])) + 1
            begin[part] = done + np.concatenate(([0], ends[:-1]))
            sizes[part] = np.diff(np.concatenate(([0], ends)))
            out.append(ids)
            done += len(ids)
        k = np.flatnonzero(~joint)
        for i, e in zip(k.tolist(), self.tokenizer.encode_batch_fast([raw[x:y].decode() for x, y in zip(a[k].tolist(), b[k].tolist())], add_special_tokens=False)):
            begin[i], sizes[i] = done, len(e.ids)
            out.append(np.array(e.ids, np.int64))
            done += len(e.ids)
        return begin, sizes, np.concatenate(out).astype(self.dtype) if out else np.zeros(0, self.dtype)

    def encode_buffer(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the ids' offsets by text."""
        if not len(buf):
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        if len(self.table[0].hashes) > CACHE_ENTRIES:
            self.table[0] = _Known(self.dtype)
        known, raw = self.table[0], buf.tobytes()
        starts = self.cuts(buf, offs)
        ends = np.append(starts[1:], len(buf))
        h = range_hash(prefix_hash(buf), starts, ends)
        h[ends - starts > MAX_KNOWN_BYTES] |= np.uint64(1)
        h[ends - starts <= MAX_KNOWN_BYTES] &= ~np.uint64(1)
        uniq, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        row = known.find(uniq)
        new = np.flatnonzero((row < 0) & ~(uniq & np.uint64(1)).astype(bool))
        if len(new):
            a, b = starts[at[new]], ends[at[new]]
            known.add(uniq[new], (buf, a, b), *self._encode_new(raw, buf, a, b))
            row = known.find(uniq)
        rows = row[inverse]
        alone = ends - starts > MAX_KNOWN_BYTES
        short = np.flatnonzero(~alone)
        alone[short] = known.differ(rows[short], buf, starts[short], (ends - starts)[short])
        piece_begin, piece_size, store = known.start[rows], known.size[rows], known.ids
        every = np.flatnonzero(alone)  # long pieces, and others with a remembered piece's hash, each by itself
        if len(every):
            first, sizes, ids = self._encode_new(raw, buf, starts[every], ends[every])
            piece_begin[every], piece_size[every] = len(store) + first, sizes
            store = np.concatenate((store, ids))
        total = np.concatenate(([0], np.cumsum(piece_size)))
        return store[_ragged(piece_begin, piece_size)], total[np.searchsorted(starts, offs)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, buf, offs in chunks(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())):
            ids, at = self.encode_buffer(buf, offs)
            out += [ids[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
        return out


@functools.lru_cache(maxsize=2)
def _byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id stands for: the byte-level alphabet has one character a byte."""
    vocab = load_tokenizer(path).get_vocab(with_added_tokens=False)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Write ``path``/data and ``path``/index; return the index, made by reading the files back: file, doc_id, offset, n_tokens, ids_crc32.

    Null text is empty and gives the end id alone; documents with a null id
    come first; repeated ids keep one record each. ``width`` 2 takes ids under
    65,536; a vocabulary with others is an error. Spark has no binary sink, so
    records pass its text writer as unchecked strings, of which it writes the
    bytes; read_records() verifies every checksum.
    """
    spark = docs.sparkSession
    dtype = "<u2" if width == 2 else "<u4"
    if max(end_id, *load_tokenizer(tokenizer_file).get_vocab().values()) >= 1 << 8 * np.dtype(dtype).itemsize:
        raise ValueError(f"ids of this vocabulary need more than {width} bytes")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-size // FILE_BYTES))
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = PieceEncoder(tokenizer_file, dtype)
        tail = np.array([end_id], dtype).tobytes()
        for doc_ids, buf, offs in batch_chunks(batches, "doc_id", "text"):
            ids, at = enc.encode_buffer(buf, offs)
            # The first eight payload bytes name the document; -2**63 stands for a null id.
            names = [struct.pack("<q", -(1 << 63) if i is None else i) for i in doc_ids.to_pylist()]
            rows = [frame(n + ids[x:y].tobytes() + tail)[:-1] for n, x, y in zip(names, at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    ordered.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{path}/data")
    read_records(spark, path, width).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """file, doc_id, offset, n_tokens, ids_crc32 (ids as uint32) and ids (uint32 bytes) of every record of the data files, checksums verified."""
    dtype = "<u2" if width == 2 else "<u4"

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                out = []
                for at, payload in unframe(data):
                    ids = np.frombuffer(payload, dtype, offset=8).astype("<u4")
                    i = struct.unpack_from("<q", payload)[0]
                    out.append((name, None if i == -(1 << 63) else i, at, len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) == 4096:
                        yield _record_batch(out)
                        out = []
                if out:
                    yield _record_batch(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("path", "content")
    return files.mapInArrow(run, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")


def _record_batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, ids (array of int) of every record; for training readers."""
    dtype = "<u2" if width == 2 else "<u4"

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                for _, payload in unframe(data):
                    i = struct.unpack_from("<q", payload)[0]
                    ids = np.frombuffer(payload, dtype, offset=8).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([None if i == -(1 << 63) else i], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("content").mapInArrow(run, "doc_id long, ids array<int>")


def with_starts(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from an index: ``start`` counts the ids before the document in doc_id order.

    Files hold ranges of doc_id in order of their part numbers (as numbers:
    names stop sorting at part 100,000), so only per-file totals (one row a
    file) meet in one task; within a file a window runs over its own records.
    """
    inside = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("total")).withColumn("part", F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long"))
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    local = records.withColumn("_local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(totals, "file").selectExpr("doc_id", "base + _local AS start", "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write the files into the shared folder, read them back: doc_id, start, n_tokens, ids_crc32; the files are removed again."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    out = Table(spark, with_starts(write_token_files(docs, tokenizer_file, path)), "token-table")
    remove_path(spark, path)
    return out.df
