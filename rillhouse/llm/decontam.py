"""Benchmark decontamination with suffix arrays.

Each run of training texts is a shard with its own suffix array (sorted to the depth of a window; sorting deeper
would not change any answer). Every test suffix is binary-searched in it; the range it finds gives the places of
verbatim matches, and neighbouring matches on one diagonal join to the longest match.

Defined results: a null or empty text has no words, no hits and is clean; an item without words matches nothing;
an item shorter than a window is one window; repeated documents or items are judged each for itself (equal item_ids
count once); a null item_id is left out; an empty table of documents gives no rows, one of items leaves all clean; a
very long text is one shard by itself, and one item of very many words has wider keys; other columns, of whatever name,
are never read and pass through clean() unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship, table
from .words import NON_ALNUM, Words, fresh, pieces, small_batches, tidy

WINDOW = 13
#: Bytes of item text in one broadcast block; more items make more blocks, scanned one after the other
#: (a worker holds one of them, about ten times as many bytes).
BLOCK_BYTES = 8 << 20
#: A block's words are numbered in 16 bits; a block with more distinct words is split, one item with more has 32 bits.
MAX_WORDS = 65_000

HITS = "array<struct<item:string,item_at:int,doc_at:int,length:int>>"


class Block:
    """Windows of some items as keys of 64-bit numbers, each of which holds four 16-bit or two 32-bit word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        col = pa.array([t for _, t in items], pa.large_string())
        self.ids = [i for i, _ in items]
        keys, lens, owner, at, hs = [], [], [], [], []
        for i, j, b, o in pieces(col):
            w = Words(b, o, NON_ALNUM, lower=True)
            hs += [(k, w.h[w.first[k - i] : w.first[k - i + 1]]) for k in range(i, j)]
        self.vocab = np.unique(np.concatenate([h for _, h in hs])) if hs else np.zeros(0, np.uint64)
        self.per = 4 if len(self.vocab) <= MAX_WORDS else 2
        self.cols = -(-window // self.per)
        for k, h in hs:
            if n := len(h):
                x = np.searchsorted(self.vocab, h).astype(np.uint64) + np.uint64(1)
                m = min(n, window)
                c = max(1, n - window + 1)
                keys.append(pack(x, np.arange(c), m, self.cols, per=self.per))
                lens.append(np.full(c, m))
                owner.append(np.full(c, k))
                at.append(np.arange(c))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        keys = np.concatenate(keys) if keys else np.zeros((0, self.cols), np.uint64)
        lens, owner, at = cat(lens), cat(owner), cat(at)
        # equal windows are one key; whose they are stands at first[key] to first[key + 1] of owner and at
        order = np.lexsort((*keys.T[::-1], lens))
        keys, lens, self.owner, self.at = keys[order], lens[order], owner[order], at[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1) | (lens[1:] != lens[:-1])
        self.keys, self.lens, self.first = keys[new], lens[new], np.append(np.flatnonzero(new), len(keys))
        self.least = int(self.lens.min()) if len(self.lens) else 0


def pack(x: np.ndarray, at: np.ndarray, depth: int, cols: int, upto: np.ndarray | None = None, fill: int = 0, per: int = 4) -> np.ndarray:
    """Keys of the runs of depth words that start at `at`; words from `upto` on count as absent."""
    out = np.zeros((len(at), cols), np.uint64)
    bits = 64 // per
    for d in range(cols * per):
        if d < depth:
            i = at + d
            v = x[np.minimum(i, len(x) - 1)]
            v = np.where(i < (len(x) if upto is None else upto), v, np.uint64(0))
        else:
            v = np.uint64(fill)
        out[:, d // per] |= v << np.uint64(64 - bits - bits * (d % per))
    return out


def below(keys: np.ndarray, want: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each wanted key how many sorted keys are smaller (or equal): a binary search of all at once."""
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(keys), np.int64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.minimum((lo + hi) // 2, max(0, len(keys) - 1))
        less, same = np.zeros(len(want), bool), np.ones(len(want), bool)
        for c in range(keys.shape[1]):
            k = keys[mid, c]
            less |= same & (k < want[:, c])
            same &= k == want[:, c]
        go = open_ & (less | (same & or_equal))
        lo = np.where(go, mid + 1, lo)
        hi = np.where(open_ & ~go, mid, hi)


def search(w: Words, b: Block) -> list[tuple[int, int, int, int]]:
    """(word of the shard, item, word of the item, length) of every window of the block that occurs in the shard."""
    if not len(w.h) or not len(b.keys):
        return []
    i = np.minimum(np.searchsorted(b.vocab, w.h), len(b.vocab) - 1)
    x = np.where(b.vocab[i] == w.h, i + 1, 0).astype(np.uint64)
    stop = np.zeros(len(x) + 1, bool)  # where a run of known words of one document ends
    stop[:-1] = x == 0
    stop[w.first[w.first < len(x)]] = True
    stop[-1] = True
    # the first stop after position p
    nxt = np.where(stop, np.arange(len(stop)), len(x))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    upto = nxt[1:]
    at = np.flatnonzero((upto - np.arange(len(x)) >= b.least) & (x > 0))
    if not len(at):
        return []
    keys = pack(x, at, b.window, b.cols, upto[at], per=b.per)
    order = np.lexsort(keys.T[::-1])  # the suffix array
    keys, at = keys[order], at[order]
    short = b.lens < b.window
    lo = below(keys, b.keys, False)
    high, bits = b.keys.copy(), 64 // b.per
    for d in range(b.window):  # a shorter window finds every suffix that begins with it
        high[:, d // b.per] |= np.where(short & (b.lens <= d), np.uint64((1 << bits) - 1), np.uint64(0)) << np.uint64(64 - bits - bits * (d % b.per))
    hi = below(keys, high, True)
    n = hi - lo
    found = np.flatnonzero(n > 0)
    key = np.repeat(found, n[found])
    pos = at[np.repeat(lo[found], n[found]) + np.arange(len(key)) - np.repeat(np.cumsum(n[found]) - n[found], n[found])]
    return join(pos, key, b, np.searchsorted(w.first, pos, "right"))


def join(pos: np.ndarray, key: np.ndarray, b: Block, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Matches of windows as longest ones: those that overlap on one diagonal of a text and an item are one.

    The places of an item shorter than a window join where they touch, whatever the diagonal.
    """
    if not len(pos):
        return []
    length = b.lens[key]
    short = length < b.window
    o = np.lexsort((pos, key))
    o = o[short[o]]
    p, k, end = pos[o], key[o], pos[o] + length[o]
    new = np.ones(len(o), bool)
    new[1:] = (k[1:] != k[:-1]) | (doc[o][1:] != doc[o][:-1]) | (p[1:] > end[:-1])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(o)) - 1 if len(a) else a
    p, k, end = p[a], k[a], end[z]
    times = b.first[k + 1] - b.first[k]
    who = b.owner[np.repeat(b.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    out = list(zip(np.repeat(p, times).tolist(), who.tolist(), [0] * len(who), np.repeat(end - p, times).tolist(), strict=True))

    pos, key = pos[~short], key[~short]
    times = b.first[key + 1] - b.first[key]
    place = np.repeat(b.first[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    pos, item, at = np.repeat(pos, times), b.owner[place], b.at[place]
    o = np.lexsort((pos, pos - at, item))
    pos, item, at = pos[o], item[o], at[o]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (pos[1:] - at[1:] != pos[:-1] - at[:-1]) | (pos[1:] != pos[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(pos)) - 1 if len(a) else a
    return out + list(zip(pos[a].tolist(), item[a].tolist(), at[a].tolist(), (pos[z] + b.window - pos[a]).tolist(), strict=True))


def scan_batch(batch: pa.RecordBatch, b: Block) -> list[list[dict]]:
    """Matches of each row of the batch."""
    out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
    for i, _, buf, offs in pieces(batch.column("text")):
        w = Words(buf, offs, NON_ALNUM, lower=True)
        for p, k, at, n in search(w, b):
            d = int(np.searchsorted(w.first, p, "right")) - 1
            out[i + d].append({"item": b.ids[k], "item_at": at, "doc_at": p - int(w.first[d]), "length": n})
    return out


def item_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[Block]:
    """The items block by block; the driver holds one block at a time."""
    rows, size = [], 0
    for r in items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text").toLocalIterator():
        rows.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield from split(rows, window)
            rows, size = [], 0
    if rows:
        yield from split(rows, window)


def split(rows: list[tuple[str, str]], window: int) -> Iterator[Block]:
    b = Block(rows, window)
    if len(b.vocab) > MAX_WORDS and len(rows) > 1:
        yield from split(rows[: len(rows) // 2], window)
        yield from split(rows[len(rows) // 2 :], window)
    else:
        yield b


def scanned(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, finish, schema) -> DataFrame:
    """finish(batch, hits of each row) over documents and all their hits, in one map for the last (or only) block.

    Every earlier block's hits are written with the documents, so that a worker holds one block at a time.
    """
    ship(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    name = fresh(docs, "hits")
    df, last = docs, None
    for block in item_blocks(items, window, block_bytes):
        if last is not None:
            before, with_hits = share(last), small_batches(df) if name in df.columns else small_batches(df).withColumn(name, F.lit(None).cast(HITS))
            df = cut(with_hits.mapInArrow(_scan(before, name, lambda b, hits: _put(b, name, hits)), with_hits.schema), "hits")
            before.destroy()
        last = block
    return small_batches(df).mapInArrow(_scan(share(last) if last is not None else None, name, finish), schema(docs))


def _put(batch: pa.RecordBatch, name: str, hits: list) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(name), name, pa.array(hits, batch.schema.field(name).type))


def _scan(shared, name: str, finish):
    @tidy
    def run(batches):
        for batch in batches:
            hits = scan_batch(batch, shared.value) if shared is not None else [[] for _ in range(batch.num_rows)]
            if name in batch.schema.names:
                hits = [(o or []) + g for o, g in zip(batch.column(name).to_pylist(), hits, strict=True)]
            yield finish(batch, hits)

    return run


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, name: str = "hits") -> DataFrame:
    """docs with the column `name`, in place of one of that name: every verbatim match of an item, as long as it goes."""
    docs = docs.drop(name)
    out = lambda d: d.withColumn(name, F.lit(None).cast(HITS)).schema
    kind = pa.list_(pa.struct([("item", pa.string()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
    names = docs.columns
    return scanned(docs, items, window, block_bytes, lambda b, hits: b.select(names).append_column(name, pa.array(hits, kind)), out)


def judged(batch: pa.RecordBatch, hits: list) -> list[tuple]:
    """(n_words, n_hit, items, contaminated, longest match) of each row."""
    rows = []
    for i, j, buf, offs in pieces(batch.column("text")):
        first = Words(buf, offs, NON_ALNUM).first
        for k in range(i, j):
            n = int(first[k - i + 1] - first[k - i])
            hit = np.zeros(n + 1, np.int64)
            for h in hits[k]:
                hit[h["doc_at"]] += 1
                hit[h["doc_at"] + h["length"]] -= 1
            n_hit = int((np.cumsum(hit) > 0).sum())
            rows.append((n, n_hit, sorted({h["item"] for h in hits[k]}), n_hit > 0 and 20 * n_hit >= n, max((h["length"] for h in hits[k]), default=0)))
    return rows


DIGEST = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest_match": pa.int64()}
DIGEST_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


def _digest(batch: pa.RecordBatch, hits: list) -> pa.RecordBatch:
    rows = [(n, hit, len(of), hashlib.sha256(",".join(of).encode()).hexdigest(), bad, most) for n, hit, of, bad, most in judged(batch, hits)]
    cols = zip(*rows, strict=True) if rows else [[]] * len(DIGEST)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, DIGEST.values(), strict=True))], ["doc_id", *DIGEST])


def digest(df: DataFrame) -> DataFrame:
    """Of documents with `hits`, one row each: words, words inside a match, items, and whether a twentieth is hit."""

    @tidy
    def run(batches):
        for batch in batches:
            yield _digest(batch, [x or [] for x in batch.column("hits").to_pylist()])

    return small_batches(df.select("doc_id", "text", "hits")).mapInArrow(run, DIGEST_SCHEMA)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """digest(matches(docs, items)) in one map."""
    return scanned(docs.select("doc_id", "text"), items, WINDOW, BLOCK_BYTES, _digest, lambda _: DIGEST_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: whole documents against the whole benchmark."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without those that the contamination rule names; their columns stay as they are."""
    names = docs.columns

    def finish(batch, hits):
        return batch.select(names).filter(pa.array([not bad for *_, bad, _ in judged(batch, hits)], pa.bool_()))

    return scanned(docs, items, WINDOW, BLOCK_BYTES, finish, lambda d: d.schema)
