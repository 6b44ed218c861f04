"""Token ids as binary files: a concatenated id array whose document boundaries are Elias-Fano sequences.

One file holds one run of documents in ascending id order, little-endian: the head (`HEAD`), the Elias-Fano sequence of
the documents' ends, that of their ids, the token ids (two bytes each for vocabularies up to 65,536, else four), and one
line feed, which Spark's text writer puts there. Files are written and read by Spark's own sources, so they may lie in any
store that Spark reaches and a lost executor's tasks are simply run again. The folder of a file names its place, documents
and ids (`run=00012-0003-4096-1048576`), so that the starts of all files come from a listing alone.

Elias-Fano: of n values up to u, the low floor(log2(u / n)) bits of each stand in a packed array, the high parts in unary
in a bit array of at most 2 n + 1 bits; every 256th set bit has its position in a table of 32-bit numbers (select), so a
document's offset is found with a scan of some 64 bytes. That is 2 + log2(u / n) bits a document in place of 64.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.llm._shared import shared_folder
from tidepool.llm._words import Spans, byte_hashes, lean, pieces

#: magic, bytes of a token id, documents, documents without an id (they come first), token ids
HEAD = struct.Struct("<8sIQQQ")
MAGIC = b"TIDEIDS1"
#: values, first value, low bits, bytes of the high part
SEQUENCE = struct.Struct("<QqIQ")
SAMPLED = 256
END_ID = 2
#: Token ids after which a file is closed; a longer document has a file of its own.
FILE_IDS = 1 << 24
#: Distinct chunks (about 150 bytes each) that a Python worker remembers the ids of, in each of two generations.
REMEMBERED = 300_000


class EliasFano:
    """A non-decreasing sequence of 64-bit integers in 2 + log2(u / n) bits each, with access by select."""

    def __init__(self, buffer: memoryview, at: int = 0):
        self.n, self.first, self.bits, high = SEQUENCE.unpack_from(buffer, at)
        at += SEQUENCE.size
        n_samples, n_low = -(-self.n // SAMPLED), (self.n * self.bits + 7) // 8
        self.samples = np.frombuffer(buffer, "<u4", n_samples, at)
        self.high = np.frombuffer(buffer, np.uint8, high, at + 4 * n_samples)
        self.low = np.frombuffer(buffer, np.uint8, n_low, at + 4 * n_samples + high)
        self.end = at + 4 * n_samples + high + n_low

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        """Bytes of non-decreasing int64 values."""
        n = len(values)
        if not n:
            return SEQUENCE.pack(0, 0, 0, 0)
        rest = (values - values[0]).view(np.uint64)  # differences of int64 fit unsigned 64 bits
        bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
        ones = (rest >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, bool)
        high[ones] = True
        low = (rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        packed = np.packbits(high, bitorder="little")
        return b"".join((SEQUENCE.pack(n, int(values[0]), bits, len(packed)), ones[::SAMPLED].astype("<u4").tobytes(), packed.tobytes(), np.packbits(low.astype(bool).ravel(), bitorder="little").tobytes()))

    def _select(self, i: int) -> int:
        """Position of the i-th set bit of the high part."""
        at = int(self.samples[i // SAMPLED])
        left, byte = i % SAMPLED, at // 8
        word = int(self.high[byte]) & (0xFF << (at % 8))
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return 8 * byte + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        b = i * self.bits
        low = int.from_bytes(self.low[b // 8 : (b + self.bits + 7) // 8].tobytes(), "little") >> (b % 8) & ((1 << self.bits) - 1)
        return self.first + ((self._select(i) - i) << self.bits | low)

    def __len__(self) -> int:
        return self.n

    def values(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")[: len(self.high) * 8])[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits).astype(np.uint64)
        low = (low << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((high.astype(np.uint64) << np.uint64(self.bits)) | low).view(np.int64) + np.int64(self.first)

    def find(self, value: int) -> tuple[int, int]:
        """Range of positions that hold value, by bisection over select."""
        ends = []
        for above in (False, True):
            lo, hi = 0, self.n
            while lo < hi:
                mid = (lo + hi) // 2
                x = self[mid]
                lo, hi = (mid + 1, hi) if x < value or above and x == value else (lo, mid)
            ends.append(lo)
        return ends[0], ends[1]


class TokenFile:
    """A file of token ids from its bytes: a document's ids need a few select steps and no table of offsets."""

    def __init__(self, content: bytes):
        magic, self.width, self.n, self.n_null, self.n_ids = HEAD.unpack_from(content)
        if magic != MAGIC:
            raise ValueError("no file of token ids")
        self.ends = EliasFano(content, HEAD.size)
        self.keys = EliasFano(content, self.ends.end)
        self.ids = np.frombuffer(content, f"<u{self.width}", self.n_ids, self.keys.end)

    def offset(self, i: int) -> int:
        """Ids of this file before document i."""
        return self.ends[i - 1] if i else 0

    def key(self, i: int) -> int | None:
        return self.keys[i - self.n_null] if i >= self.n_null else None

    def document(self, i: int) -> np.ndarray:
        """Token ids of document i, its end id included."""
        return self.ids[self.offset(i) : self.ends[i]]

    def positions(self, key: int | None) -> range:
        """Places of the documents with this id."""
        lo, hi = (0, self.n_null) if key is None else (x + self.n_null for x in self.keys.find(key))
        return range(lo, hi)


def file_bytes(keys: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """A file of documents in ascending id order (those without an id first)."""
    known = np.array([k for k in keys if k is not None], np.int64)
    head = HEAD.pack(MAGIC, width, len(keys), len(keys) - len(known), len(ids) // width)
    return b"".join((head, EliasFano.encode(np.cumsum(np.array(lengths, np.int64))), EliasFano.encode(known), ids))


_SPACE, _INK, _PUNCT, _LETTER = (np.zeros(256, bool) for _ in range(4))
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_INK[0x21:0x7F] = True
_PUNCT[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a byte-level pre-tokenizer surely starts a new token: at white space after a character that is surely none, and at
    .,;:!? after a letter. Only ASCII and Latin letters count as sure, so that any Unicode version gives the same cuts."""
    cut = np.zeros(len(data), bool)
    before, here = data[:-1], data[1:]
    latin = np.zeros(len(before), bool)
    latin[1:] = (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7) & (before[1:] >= 0x80)
    cut[1:] = _SPACE[here] & (_INK[before] | latin) | _PUNCT[here] & (_LETTER[before] | latin)
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class ChunkIds:
    """Token ids of chunks of text as bytes, for byte-level tokenizers. Two generations: what is used again stays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(names.values()) < 1 << 16 else 4
        self.lengths = np.zeros(max(names.values()) + 1, np.int64)  # a byte-level token has one character for each byte
        self.lengths[list(names.values())] = [len(x) for x in names]
        self.young, self.old = {}, {}

    def of(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, new = self.young, []
        for c in chunks:
            if c not in young:
                if c in self.old:
                    young[c] = self.old[c]
                else:
                    new.append(c)
        # chunks that start with white space and end in a sure letter or mark are tokenized as one text
        joined = [c for c in new if _SPACE[c[0]] and _INK[c[-1]]]
        for s in range(0, len(joined), 4096):
            part = joined[s : s + 4096]
            ids = np.array(self.tokenizer.encode(b"".join(part).decode(), add_special_tokens=False).ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c) for c in part]), "left") + 1
            raw = ids.astype(f"<u{self.width}").tobytes()
            lo = 0
            for c, hi in zip(part, (ends * self.width).tolist(), strict=True):
                young[c] = raw[lo:hi]
                lo = hi
        alone = [c for c in new if c not in young]
        for c, e in zip(alone, self.tokenizer.encode_batch_fast([c.decode(errors="replace") for c in alone], add_special_tokens=False), strict=True):
            young[c] = np.array(e.ids, f"<u{self.width}").tobytes()
        return [young[c] for c in chunks]


_KNOWN: dict[str, ChunkIds] = {}


def _known(path: str) -> ChunkIds:
    if path not in _KNOWN:
        _KNOWN[path] = ChunkIds(path)
    return _KNOWN[path]


def encoded(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of some documents one after the other, and each document's number of ids."""
    known = _known(path)
    kind = f"<u{known.width}"
    if not len(data):
        return np.zeros(0, kind), np.zeros(len(offsets) - 1, np.int64)
    start = chunk_starts(data, offsets)
    end = np.append(start[1:], len(data))
    _, at, which = np.unique(Spans(byte_hashes(data)).hash(start, end), return_index=True, return_inverse=True)
    raw = memoryview(data)
    ids = known.of([raw[s:e].tobytes() for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)])
    sizes = np.array([len(x) // known.width for x in ids], np.int64)
    table = np.frombuffer(b"".join(ids), kind)
    each = sizes[which]
    ends = np.cumsum(each)
    out = table[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - each), each) + np.arange(int(ends[-1]))]
    return out, np.diff(np.concatenate([[0], ends])[np.searchsorted(start, offsets)])


def _files(path: str, end_id: int, limit: int):
    def run(batches):
        shard, block, keys, lengths, held = TaskContext.get().partitionId(), 0, [], [], []
        total = 0

        def close():
            ids = b"".join(held)
            name = f"{shard:06d}-{block:06d}-{len(keys)}-{total}"
            body = file_bytes(keys, lengths, ids, _known(path).width)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([body], pa.large_binary())], names=["run", "body"])

        for b in batches:
            own = b.column(0).to_pylist()
            for first, data, offsets in pieces(b.column(1)):
                ids, sizes = encoded(path, data, offsets)
                at = 0
                end = np.array([end_id], ids.dtype)
                for k, size in enumerate(sizes.tolist()):
                    if total and total + size + 1 > limit:
                        yield close()
                        block, total = block + 1, 0
                        keys.clear(), lengths.clear(), held.clear()
                    held.append(ids[at : at + size].tobytes() + end.tobytes())
                    keys.append(own[first + k])
                    lengths.append(size + 1)
                    at, total = at + size, total + size + 1
        if keys:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encode all texts and write their ids in ascending id order into a new folder.

    tokenizer: path of a byte-level `tokenizers` file, on every executor. Each document is its ids and then end_id.

    Null and empty texts are the end id alone. Documents without an id come first; rows that share an id come by a hash of
    their text, and repeated rows are written each. A very long text has a file of its own and is held by one task. Other
    columns are ignored; an empty table writes no file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    files = dealt.mapInArrow(lean(_files(tokenizer, end_id, file_ids)), "run string, body binary")
    # a cast keeps the bytes as they are
    files.select("run", F.col("body").cast("string")).write.partitionBy("run").option("maxRecordsPerFile", 1).text(folder)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    # the run is taken from the path and not as a partition column, so that a folder without files is an empty table
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("run", F.regexp_extract("path", "run=([^/]+)/", 1))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files with documents, ids and the ids of all files before them, from their names."""
    runs = _stored(spark, folder).select("run")
    part = F.split("run", "-")
    runs = runs.select("run", part[2].cast("long").alias("n_docs"), part[3].cast("long").alias("n_ids"))
    # one short row for each file of millions of ids
    before = F.sum("n_ids").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("run", "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("before"))


_DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Documents of a folder: doc_id, start (ids of all documents before), n_tokens with the end id, ids_crc32 over
    little-endian unsigned 32-bit ids; keep_ids adds those bytes as `ids`."""
    schema = f"run string, {_DOCUMENT}" + ", ids binary" * keep_ids

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = TokenFile(content.as_buffer())
                ends = f.ends.values()
                starts = np.concatenate([[0], ends[:-1]])
                crc, ids = np.zeros(f.n, np.int64), []
                for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    own = f.ids[s:e].astype("<u4").tobytes()
                    crc[i] = zlib.crc32(own)
                    if keep_ids:
                        ids.append(own)
                keys = pa.concat_arrays([pa.nulls(f.n_null, pa.int64()), pa.array(f.keys.values(), pa.int64())])
                columns = [pa.array([name] * f.n), keys, pa.array(starts), pa.array(ends - starts), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if keep_ids else []), names=[x.split()[0] for x in schema.split(", ")])

    files = _stored(spark, folder).select("run", "content")
    docs = files.mapInArrow(lean(run), schema)
    names = ["doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return docs.join(_listed(spark, folder).select("run", "before"), "run").select(*names)


def find_documents(spark: SparkSession, folder: str, wanted: list[int | None]) -> DataFrame:
    """Token ids (doc_id, ids array) of the documents with the given ids, which the caller lists, through select alone."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                f = TokenFile(content.as_buffer())
                found = [(k, f.document(i).tolist()) for k in wanted for i in f.positions(k)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _stored(spark, folder).select("content").mapInArrow(lean(run), "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents written into a new folder of the shared one, read back from the files."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, folder)
    return read_token_files(spark, folder)
