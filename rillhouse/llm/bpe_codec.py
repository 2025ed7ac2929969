"""BPE encoding and decoding over a transducer lexicon of the frequent words.

Words are counted over all documents; the most frequent are compiled, with their ids, into a minimal acyclic
transducer that every worker maps. A word outside of it is merged exactly, so the lexicon's size changes only speed.

Defined results: a null or empty text has no tokens, the digest of nothing and decodes to the empty text; special
token strings inside a text become their id, as in the library; repeated rows are encoded each for itself; an empty
table gives no rows; a very long text makes an Arrow batch of its own and is encoded whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship, table
from .bpe import Encoder, Lexicon, Vocabulary, chunk_bounds, compile_lexicon, pretokens
from .words import keeping, kept, pieces, small_batches, span_hashes, tidy

#: Words in the lexicon: a fixed bound of what is broadcast (about 25 bytes a word).
LEXICON_WORDS = 32_768
#: Longer words are not looked for in the lexicon; they are merged exactly as others outside of it.
LEXICON_CHARS = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def chunk_counts(batches, most: int = 24 << 20):
    """({chunk: n}) of runs of about `most` bytes of text."""
    held: list[tuple] = []  # (hash, n, first start, first end, bytes) of the distinct chunks of a piece
    size = 0

    def flush():
        key, first = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
        n = np.zeros(len(key), np.int64)
        for h in held:
            n[np.searchsorted(key, h[0])] += h[1]
        out, base = {}, 0
        order = np.argsort(first)
        at, first, n = 0, first[order], n[order].tolist()
        for h in held:
            mine = first[(first >= base) & (first < base + len(h[0]))] - base
            for a, z in zip(h[2][mine].tolist(), h[3][mine].tolist(), strict=True):
                out[h[4][a:z].decode()] = n[at]
                at += 1
            base += len(h[0])
        return out

    for batch in batches:
        for _, _, buf, offs in pieces(batch.column("text")):
            start, end, _ = chunk_bounds(buf, offs)
            if len(start):
                key, row, n = np.unique(span_hashes(buf, start, end), return_index=True, return_counts=True)
                held.append((key, n, start[row], end[row], buf.tobytes()))
                size += len(buf)
            if size > most:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def frequent_words(docs: DataFrame, n: int) -> DataFrame:
    """The n most frequent pre-tokens of all documents, ties in byte order; counted per task before the shuffle.

    A histogram of the counts says from which count on words can be among them, so that few are ordered.
    """

    @tidy
    def run(batches):
        for seen in chunk_counts(batches):
            words: Counter[str] = Counter()
            for c, k in seen.items():
                for w in pretokens(c):
                    if len(w) <= LEXICON_CHARS:
                        words[w] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    counted = cut(small_batches(docs.select("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    size = F.floor(F.log2("n") * 16)
    left, least = n, 0
    for r in sorted(counted.groupBy(size.alias("size")).count().collect(), reverse=True):  # some hundreds of sizes
        least, left = r["size"], left - r["count"]
        if left <= 0:
            break
    return counted.where(size >= least).orderBy(F.desc("n"), "word").limit(n)


def lexicon(docs: DataFrame, path: str, n: int = LEXICON_WORDS) -> bytes:
    v = Vocabulary(path)
    words = [r[0].encode() for r in frequent_words(docs, n).select("word").toLocalIterator()]
    return compile_lexicon({w: v.unseen(w) for w in words})


def _encoder(path: str, data, mark: str) -> Encoder:
    return kept(("codec", path, mark), lambda: Encoder(Vocabulary(path), Lexicon.mapped(data.value)))


def with_ids(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_tokens, ids_sha256 and decoded_sha256: digests of the ids and of the decoded text.

    A kept column of one of these names goes, as in DataFrame.withColumn.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = tuple(c for c in keep if c.lower() not in ("n_tokens", "ids_sha256", "decoded_sha256"))
    out = ", ".join(f"`{c}` {k}" for c, k in docs.select(*keep).dtypes) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    path = path or default_vocabulary()
    data, mark = spark.sparkContext.broadcast(lexicon(docs, path, words)), uuid.uuid4().hex

    @keeping
    def run(batches):
        enc = _encoder(path, data, mark)
        texts = enc.v.texts
        for batch in batches:
            n, a, b = [], [], []
            for _, _, buf, offs in pieces(batch.column("text")):
                flat, count = enc.memo.encode(buf, offs)
                n += count.tolist()
                at = 0
                for z in np.cumsum(count).tolist():
                    ids = flat[at:z].tolist()
                    at = z
                    a.append(hashlib.sha256(",".join(map(texts.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(run, out)


def encode(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """docs with `ids`, the ids of each text; a column of that name is replaced."""
    spark = docs.sparkSession
    ship(spark)
    path = path or default_vocabulary()
    data, mark = spark.sparkContext.broadcast(lexicon(docs, path, words)), uuid.uuid4().hex

    @keeping
    def run(batches):
        enc = _encoder(path, data, mark)
        for batch in batches:
            ids = [x.astype("<i4") for _, _, buf, offs in pieces(batch.column("text")) for flat, count in [enc.memo.encode(buf, offs)] for x in np.split(flat, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    df = small_batches(docs.drop("ids"))
    return df.mapInArrow(run, df.withColumn("ids", F.lit(None).cast("array<int>")).schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with `decoded`, the text of the column `ids`, in place of a column of that name; null ids are empty."""
    ship(rows.sparkSession)
    path = path or default_vocabulary()

    @keeping
    def run(batches):
        enc = kept(("decode", path), lambda: Encoder(Vocabulary(path)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([enc.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], [*batch.schema.names, "decoded"])

    df = small_batches(rows.drop("decoded"))
    return df.mapInArrow(run, df.withColumn("decoded", F.lit(None).cast("string")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text."""
    return with_ids(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
