"""Token ids in binary shards: a concatenated id array with Elias-Fano document boundaries.

Shard layout, little-endian: 8-byte magic, then seven 64-bit numbers (documents, tokens, low bits, bytes of each of
low part, high part, select samples, and bytes of one id), then the document ids (64-bit), low part, high part,
select samples and the ids. Boundaries take about 2 + log2(tokens / documents) bits each instead of 64; `select`
returns one without unpacking the rest.

Defined results: documents are written in ascending doc_id order, ties by the text's hash and then by text, a null
doc_id first (it is kept as null); a null or empty text is one end id; repeated rows are written each; an empty table
makes no file and no row; a file holds whole documents, so a very long one makes a file of its own; other columns, of
whatever name, are never read.
A task writes under a name of its own and only the finished task's name gets into the manifest, so a lost executor
or a task that ran twice leaves at most an unused file behind.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, shared_dir, ship, table
from .bpe import Memo, Vocabulary
from .bpe_codec import default_vocabulary
from .words import keeping, kept, pieces, small_batches

MAGIC = b"RHTOKEN1"
#: Every so many boundaries the place of one in the high part is stored.
SAMPLE = 64
#: Id that ends each document.
END = 2
NO_ID = -(1 << 63)
#: Ids from which on a task begins a new file, and what a task holds at a time.
SHARD_IDS = 16 << 20
MANIFEST = pa.schema([("shard", pa.int64()), ("file", pa.string()), *((c, pa.int64()) for c in ("first_doc", "last_doc", "n_docs", "n_ids", "n_bytes"))])


class EliasFano:
    """A non-decreasing sequence of n + 1 numbers up to u."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        u, n = int(v[-1]), len(v)
        bits = max(0, (u // n).bit_length() - 1) if u else 0
        low = np.zeros(n * bits, np.uint8)
        for b in range(bits):
            low[b::bits] = (v >> np.uint64(bits - 1 - b)) & np.uint64(1)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low), np.packbits(high), ones[::SAMPLE].astype("<u8"))

    def select(self, i: int) -> int:
        """Number i: from the sample before it, count ones in the high part; then add its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += int.bit_count(int(self.high[byte]) >> (8 - at % 8)) if at % 8 else 0  # ones before the sample in its byte
        while left >= (c := int.bit_count(int(self.high[byte]))):
            left -= c
            byte += 1
        x, pos = int(self.high[byte]), 0
        while True:
            if x >> (7 - pos) & 1:
                if not left:
                    break
                left -= 1
            pos += 1
        return (byte * 8 + pos - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a, z = i * self.low_bits, (i + 1) * self.low_bits
        x = int.from_bytes(self.low[a // 8 : (z + 7) // 8].tobytes(), "big")
        return x >> (-z % 8) & ((1 << self.low_bits) - 1)

    def selects(self, a: int, z: int) -> np.ndarray:
        """Numbers a to z - 1: the samples around them give the bytes of the high part to look at, and no others."""
        if not 0 <= a < z <= self.n:
            raise IndexError((a, z))
        byte = int(self.samples[a // SAMPLE]) // 8
        stop = int(self.samples[-(-z // SAMPLE)]) // 8 + 1 if -(-z // SAMPLE) < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:stop])) + 8 * byte
        skip = int(np.searchsorted(ones, int(self.samples[a // SAMPLE]))) + a % SAMPLE
        out = (ones[skip : skip + z - a] - np.arange(a, z)).astype(np.int64) << self.low_bits
        if self.low_bits:
            first, last = a * self.low_bits, z * self.low_bits
            bits = np.unpackbits(self.low[first // 8 : -(-last // 8)])[first % 8 :][: last - first].reshape(z - a, self.low_bits)
            for b in range(self.low_bits):
                out |= bits[:, b].astype(np.int64) << (self.low_bits - 1 - b)
        return out

    def all(self) -> np.ndarray:
        return self.selects(0, self.n)


def to_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray | bytes) -> bytes:
    """A shard of documents whose 32-bit ids are concatenated in `ids`."""
    x = np.frombuffer(ids, "<u4")
    ef = EliasFano.encode(np.concatenate(([0], np.cumsum(lengths))))
    width = 2 if not len(x) or int(x.max()) < 1 << 16 else 4
    parts = [ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes()]
    head = np.array([len(doc_ids), len(x), ef.low_bits, *map(len, parts), width], "<u8")
    return b"".join([MAGIC, head.tobytes(), np.asarray(doc_ids, "<i8").tobytes(), *parts, x.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard read back; `document(i)` finds its ids by two selects."""

    def __init__(self, buf):
        if bytes(buf[:8]) != MAGIC:
            raise ValueError("not a token shard")
        n, self.tokens, bits, a, b, c, width = map(int, np.frombuffer(buf, "<u8", 7, 8))
        at = 64
        self.doc_ids = np.frombuffer(buf, "<i8", n, at)
        at += 8 * n
        low, high = np.frombuffer(buf, np.uint8, a, at), np.frombuffer(buf, np.uint8, b, at + a)
        self.bounds = EliasFano(n + 1, bits, low, high, np.frombuffer(buf, "<u8", c // 8, at + a + b))
        self.ids = np.frombuffer(buf, f"<u{width}", self.tokens, at + a + b + c)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct chunk that a worker meets (boundedly remembered).

    New chunks are joined to longer texts, which the library does faster; the joined text's tokens fall apart at the
    chunks' ends, as no token crosses them.
    """

    def __init__(self, path: str, most: int = 2_500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        special = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.size = np.array([len(b) for b in Vocabulary(path).token], np.int64)
        self.memo = Memo(self.ask, self.whole, special, most)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, np.uint32)

    def ask(self, todo: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alone = [len(c) < 2 or c[0] != " " or c[1].isspace() or c[-1].isspace() or "\x1c" in c or "<" in c for c in todo]  # "<": so that no special token can arise
        size, flat = np.zeros(len(todo), np.int64), []
        joined = np.flatnonzero(~np.array(alone))
        for a in range(0, len(joined), 4000):
            part = [todo[i] for i in joined[a : a + 4000].tolist()]
            flat.append(self.whole("".join(part)))
            ends = np.cumsum(self.size[flat[-1]])
            at = np.searchsorted(ends, np.cumsum([len(c.encode()) for c in part])) + 1
            size[joined[a : a + 4000]] = np.diff(at, prepend=0)
        rest = np.flatnonzero(alone)
        got = [e.ids for e in self.t.encode_batch_fast([todo[i] for i in rest.tolist()], add_special_tokens=False)]
        size[rest] = [len(x) for x in got]
        order = np.concatenate((joined, rest))
        begin = np.zeros(len(todo), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([*flat, *(np.array(x, np.uint32) for x in got)]), begin, size

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for _, _, buf, offs in pieces(pa.array(texts, pa.large_string())):
            ids, count = self.memo.encode(buf, offs)
            out += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(count)[:-1])]
        return out


def write(docs: DataFrame, uri: str, path: str | None = None, end: int = END, shards: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write docs (doc_id, text) as shards below `uri`; the manifest (one row a shard, in order) as a DataFrame.

    Each of `shards` tasks begins a new file when one has shard_ids ids.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or default_vocabulary()
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @keeping
    def run(batches):
        from pyspark import TaskContext

        enc = kept(("library", path), lambda: LibraryEncoder(path))
        fs, folder = open_fs(uri)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId() << 32
        doc_ids, lengths, ids, size = [], [], [], 0

        def flush(shard: int):
            d, n_ids = np.concatenate(doc_ids), np.concatenate(lengths)
            data = to_bytes(d, n_ids, np.concatenate(ids))
            name = f"{folder}/{uuid.uuid4().hex}.tok"
            with fs.open_output_stream(name + ".part") as f:
                f.write(data)
            fs.move(name + ".part", name)
            first, last = (None if x == NO_ID else int(x) for x in (d[0], d[-1]))
            cols = {"shard": shard, "file": name.rsplit("/", 1)[1], "first_doc": first, "last_doc": last, "n_docs": len(d), "n_ids": int(n_ids.sum()), "n_bytes": len(data)}
            return pa.RecordBatch.from_pylist([cols], MANIFEST)

        for batch in batches:
            own = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            for i, j, buf, offs in pieces(batch.column("text")):
                flat, count = enc.memo.encode(buf, offs)
                ids.append(np.insert(flat, np.cumsum(count), end).astype(np.uint32))
                doc_ids.append(own[i:j])
                lengths.append(count + 1)
                size += len(ids[-1])
                if size >= shard_ids:
                    yield flush(part)
                    part, doc_ids, lengths, ids, size = part + 1, [], [], [], 0
        if doc_ids:
            yield flush(part)

    key = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id"), key).sortWithinPartitions("doc_id", key, "text")
    made = small_batches(ordered).mapInArrow(run, "shard long, file string, first_doc long, last_doc long, n_docs long, n_ids long, n_bytes long")
    return cut(made, "token-manifest")


def open_fs(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def read(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """Per document from the files alone: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    before, rows = 0, []
    for r in manifest.orderBy("shard").select("file", "n_ids").collect():  # one row a shard
        rows.append((r["file"], before))
        before += r["n_ids"]

    @keeping
    def run(batches):
        fs, at = open_fs(uri)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{at}/{name}") as f:
                    s = Shard(f.read())
                for a in range(0, len(s.doc_ids), 4096):
                    z = min(a + 4096, len(s.doc_ids))
                    bounds = s.bounds.selects(a, z + 1)
                    crc = [zlib.crc32(s.ids[x:y].astype("<u4").tobytes()) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    ids = s.doc_ids[a:z]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(bounds[:-1] + base, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "file string, base long")
    return files.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: write all documents to shards in the shared folder, and read them back."""
    uri = shared_dir(spark, "tokens")
    return read(spark, uri, write(table(spark, sf_dir, "documents"), uri))
