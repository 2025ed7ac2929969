"""Exact removal of repeated passages with suffix automata.

A passage is a window of words whose sequence also starts elsewhere. Every window is assigned to its minimizer, the
smallest hash among its runs of eight words: equal windows have equal minimizers, so windows meet where their
minimizers meet. Consecutive windows with one minimizer are a run.

Steps: (1) minimizers are counted; a run whose minimizer occurs once cannot hold a repeated window. Those that occur
more often are kept as bits of a bitmap of fixed size; a false hit only carries a run further than needed. (2) Runs
that pass go, without their words, to their minimizer. A run that occurs twice is repeated whole. If a minimizer has
other runs as well, all its distinct runs make its reference shard. (3) Their words are fetched, and each shard's
runs, weighted by their copies, make a suffix automaton; the runs that occur once are streamed through it for matching
statistics: a window is repeated if its state was reached by two or more occurrences. A shard of one distinct run needs
no automaton: it would be a single path, whose count is the number of copies. The automata are dealt out by minimizer
instead of being broadcast to all, since all reference text together has no size bound and every document against
every automaton would take time in the square of the input. A minimizer of very many runs (a passage in a large part
of all documents) is dealt window by window; equal windows, as shards of one path, are counted before they are sent.

Defined results: a null or empty text has no words; fewer words than a window remove nothing; rows that repeat a
doc_id with one text are occurrences like any other (the passages of both go); a null doc_id is kept; an empty table
gives no rows; a very long text is one row of words like any other, whole; other columns, of whatever name, are never
read and pass through remove() unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship, table
from .words import Words, fresh, mix, pieces, small_batches, tidy

WINDOW = 35
GRAM = 8
#: A minimizer with more runs than this is dealt window by window.
HOT = 256
#: Bits of the bitmaps of minimizers and of occurrences: a fixed 8 MB each, whatever the input.
BITS = 26
_CHUNK = 19


class SuffixAutomaton:
    """Generalised suffix automaton of weighted sequences; `count` is how often a state's strings occur."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, seq: list[int], weight: int) -> None:
        at = 0
        for c in seq:
            q = self.next[at].get(c)
            if q is not None:
                at = q if self.length[q] == self.length[at] + 1 else self._split(at, c, q)
            else:
                new, p = self._state(self.length[at] + 1, {}, 0), at
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                at = new
            self.count[at] += weight

    def close(self) -> None:
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, seq: list[int], window: int) -> list[int]:
        """Starts of the windows of seq that occur twice or more (matching statistics, one pass)."""
        s, n, out = 0, 0, []
        for i, c in enumerate(seq):
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s, n = self.next[s][c], n + 1
            while s and self.length[self.link[s]] >= window:
                s = self.link[s]
                n = self.length[s]
            if n >= window and self.count[s] > 1:
                out.append(i - window + 1)
        return out


def runs(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimizer) of every run of windows of one text that share a minimizer."""
    h, span = w.h, window - gram + 1
    if len(h) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    g = h[: len(h) - gram + 1].copy()
    for j in range(1, gram):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)])
    value, place, size = g, np.arange(len(g)), 1
    while size < span:  # smallest of `size` grams, leftmost on ties; windows double, the last step overlaps
        step = min(size, span - size)
        a, b = value[:-step], value[step:]
        left = a <= b
        value, place = np.where(left, a, b), np.where(left, place[:-step], place[step:])
        size += step
    count = np.maximum(np.diff(w.first) - window + 1, 0)
    start = np.repeat(w.first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return np.searchsorted(w.first, start[at], "right") - 1, start[at], np.diff(np.append(at, len(start))), value[start[at]]


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^BITS bits, one set for each value of the one column of 64-bit hashes; made chunk by chunk on the executors."""

    @tidy
    def places(batches):
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(h >> np.uint64(64 - BITS)).astype(np.int64)
            chunk = at >> _CHUNK
            first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))) if len(at) else at
            parts = np.split((at & ((1 << _CHUNK) - 1)).astype("<u4"), first[1:]) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(chunk[first], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "at"])

    @tidy
    def union(batches):
        chunk, bits = None, None
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if c != chunk:
                    if chunk is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["chunk", "bits"])
                    chunk, bits = c, np.zeros(1 << _CHUNK, np.uint8)
                bits[np.frombuffer(x, "<u4")] = 1
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["chunk", "bits"])

    parts = hashes.mapInArrow(places, "chunk long, at binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(union, "chunk long, bits binary")
    out = np.zeros(1 << (BITS - 3), np.uint8)
    size = 1 << (_CHUNK - 3)
    for c, x in parts.collect():  # at most 2^(BITS - _CHUNK) chunks of 64 KB
        out[c * size : (c + 1) * size] = np.frombuffer(x, np.uint8)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def minimizers(docs: DataFrame) -> DataFrame:
    """(mini, n): runs of each minimizer, counted per task before the shuffle."""

    @tidy
    def run(batches):
        held, size = [], 0

        def flush():
            m, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n.astype(np.int64))], ["mini", "n"])

        for batch in batches:
            for _, _, buf, offs in pieces(batch.column("text")):
                held.append(runs(Words(buf, offs))[3])
                size += len(held[-1])
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
        yield flush()

    return docs.mapInArrow(run, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))


def occurrence(text_hash: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of a place: the text and the word where it starts."""
    return mix(text_hash ^ mix(at.astype(np.uint64) + np.uint64(1)))


def run_hash(w: Words, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of the words of each run, by sums of the words' hashes with powers of an odd number."""
    pw = np.full(len(w.h) + 1, 0xD1342543DE82EF95, np.uint64)
    pw[0] = 1
    pw = np.cumprod(pw)
    inv = np.full(len(w.h) + 1, pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)
    inv[0] = 1
    inv = np.cumprod(inv)
    acc = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.h * pw[:-1])))
    return mix((acc[start + n + WINDOW - 1] - acc[start]) * inv[start] + n.astype(np.uint64))


def _places(common, hot):
    """Runs whose minimizer may be common, without words: mini, run, text, place, windows."""

    @tidy
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash").to_numpy()
            out = [[] for _ in range(6)]
            for i, _, buf, offs in pieces(batch.column("text")):
                w = Words(buf, offs)
                text, start, n, mini = runs(w)
                ok = has(common.value, mini)
                text, start, n, mini = text[ok], start[ok], n[ok], mini[ok]
                many = has(hot.value, mini)
                wide = np.where(many, n, 1)  # a hot run falls into its windows
                again = np.repeat(np.arange(len(n)), wide)
                step = np.arange(len(again)) - np.repeat(np.cumsum(wide) - wide, wide)
                start, n = start[again] + step, np.where(wide[again] > 1, 1, n[again])
                text, mini = text[again], mini[again]
                rh = run_hash(w, start, n)
                deal = np.where(many[again], mix(mini ^ rh), mini)  # equal windows of a hot minimizer decide alone
                for col, v in zip(out, (mini, rh, text + i, start - w.first[text], n, deal), strict=True):
                    col.append(v)
            mini, rh, row, at, n, deal = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            take = pa.array(row.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(rh.view(np.int64)), ids.take(take), pa.array(hashes[row.astype(np.int64)]), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(deal.view(np.int64))], ["mini", "run", "doc_id", "text_hash", "at", "n", "deal"])

    return run


@tidy
def _decide(batches):
    """Rows sorted by minimizer and run: repeated runs are given out (copies 0); of a minimizer with other runs too,
    each distinct run once more with its copies (1: it occurs once, 2: more often)."""
    key = None  # minimizer
    waiting, singles, distinct, longest = [], False, 0, 0
    first, copies = None, 0
    out: list[tuple] = []

    def end_run():
        nonlocal singles, distinct, longest
        if first is None:
            return
        distinct += 1
        singles |= copies == 1
        longest = max(longest, first[5])
        if len(waiting) <= HOT:  # more runs only has a minimizer that is dealt window by window
            waiting.append((*first, min(copies, 2)))
        if copies > 1:
            out.append((*first, 0))

    def end_mini():
        if distinct > 1 and singles and longest > 1:  # single windows are decided by their copies
            out.extend(waiting)

    def batch_of(kind):
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        out.clear()
        kinds = (pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["mini", "run", "doc_id", "text_hash", "at", "n", "copies"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("mini", "run", "doc_id", "text_hash", "at", "n")), strict=True):
            if row[0] != key:
                end_run()
                end_mini()
                key, waiting, singles, distinct, longest, first, copies = row[0], [], False, 0, 0, row, 1
            elif row[1] != first[1]:
                end_run()
                first, copies = row, 1
            else:
                copies += 1
                out.append((*row, 0))
        if len(out) > 20_000:
            yield batch_of(kind)
    end_run()
    end_mini()
    yield batch_of(kind)


def _bodies(wanted):
    """Words of the runs whose place is wanted."""

    @tidy
    def run(batches):
        for batch in batches:
            hashes = batch.column("text_hash").to_numpy().view(np.uint64)
            rows = [[] for _ in range(4)]
            for i, _, buf, offs in pieces(batch.column("text")):
                w = Words(buf, offs)
                text, start, n, mini = runs(w)
                at = start - w.first[text]
                ok = np.flatnonzero(has(wanted.value, occurrence(hashes[text + i], at)))
                rh = run_hash(w, start[ok], n[ok])
                rows[0] += mini[ok].view(np.int64).tolist()
                rows[1] += rh.view(np.int64).tolist()
                rows[2] += [w.h[a : a + k + WINDOW - 1].tobytes() for a, k in zip(start[ok].tolist(), n[ok].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], ["mini", "run", "body"])

    return run


@tidy
def _match(batches):
    """Rows sorted by minimizer and run, some with words and some with places: repeated windows of runs that occur once."""
    key, body, place = None, {}, {}
    out: list[tuple] = []

    def solve():
        runs_ = [(r, p) for r, p in place.items() if r in body]
        if len(runs_) < 2:
            return
        auto = SuffixAutomaton()
        seqs = {r: np.frombuffer(body[r], np.uint64).tolist() for r, _ in runs_}
        for r, p in runs_:
            auto.add(seqs[r], p[4])
        auto.close()
        for r, p in runs_:
            if p[4] == 1 and (at := auto.repeated(seqs[r], WINDOW)):
                out.append((p[0], p[1], p[2], p[3], at))

    def batch_of(kind):
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        out.clear()
        kinds = (kind, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "text_hash", "at", "n", "windows"])

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for mini, run, b, doc, text, at, n, copies in zip(*(batch.column(c).to_pylist() for c in ("mini", "run", "body", "doc_id", "text_hash", "at", "n", "copies")), strict=True):
            if mini != key:
                solve()
                key, body, place = mini, {}, {}
            if b is None:
                place[run] = (doc, text, at, n, copies)
            else:
                body[run] = b
        if len(out) > 20_000:
            yield batch_of(kind)
    solve()
    yield batch_of(kind)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, hits): for documents with repeated windows the runs and the windows in them (null: all n)."""
    ship(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    kind = dict(docs.dtypes)["doc_id"]
    base = small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
    counts = cut(minimizers(base.select("text")).where("n > 1"), "minimizers")
    common, hot = share(bitmap(counts.select("mini"))), share(bitmap(counts.where(F.col("n") > HOT).select("mini")))
    rows = f"mini long, run long, doc_id {kind}, text_hash long, at int, n int"
    places = cut(base.mapInArrow(_places(common, hot), f"{rows}, deal long"), "places")
    by_mini = small_batches(places.where("deal = mini").drop("deal").repartition("mini").sortWithinPartitions("mini", "run"))
    decided = cut(by_mini.mapInArrow(_decide, f"{rows}, copies int"), "decided")
    # equal windows of a hot minimizer: counted per task before the shuffle, and a join that splits large keys
    alone = places.where("deal <> mini")
    again = cut(alone.groupBy("deal").agg(F.count(F.lit(1)).alias("n_all")).where("n_all > 1").select("deal"), "again")
    alone = alone.join(again, "deal").select("doc_id", "text_hash", "at", "n")
    shards = decided.where("copies > 0")

    @tidy
    def hashed(batches):
        for b in batches:
            x = occurrence(b.column("text_hash").to_numpy().view(np.uint64), b.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], ["place"])

    wanted = share(bitmap(shards.select("text_hash", "at").mapInArrow(hashed, "place long")))
    bodies = small_batches(base).mapInArrow(_bodies(wanted), "mini long, run long, body binary")
    none = F.lit(None)
    both = bodies.select("mini", "run", "body", none.cast(kind).alias("doc_id"), none.cast("long").alias("text_hash"), none.cast("int").alias("at"), none.cast("int").alias("n"), none.cast("int").alias("copies"))
    both = both.union(shards.select("mini", "run", none.cast("binary"), "doc_id", "text_hash", "at", "n", "copies"))
    found = both.repartition("mini").sortWithinPartitions("mini", "run").mapInArrow(_match, f"doc_id {kind}, text_hash long, at int, n int, windows array<int>")
    sure = decided.where("copies = 0").select("doc_id", "text_hash", "at", "n").union(alone)
    hits = sure.withColumn("windows", none.cast("array<int>")).union(found)
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "n", "windows")).alias("hits"))


def marked(docs: DataFrame, name: str = "hits") -> DataFrame:
    """docs, which has no column `name`, with that column (null: none)."""
    key, mark = fresh(docs, "hit_id"), fresh(docs, "hit_hash")
    hits = repeated(docs).withColumnsRenamed({"doc_id": key, "text_hash": mark, "hits": name})
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(mark)), "left").drop(key, mark)


def kept_words(text: str | None, hits: list[dict] | None) -> tuple[int, list[bytes]]:
    words = (text or "").encode().split()
    if not hits:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int64)
    for h in hits:
        if h["windows"] is None:  # all n windows
            gone[h["at"]] += 1
            gone[h["at"] + h["n"] - 1 + WINDOW] -= 1
        for x in h["windows"] or ():
            gone[h["at"] + x] += 1
            gone[h["at"] + x + WINDOW] -= 1
    left = np.cumsum(gone)[:-1] == 0
    return len(words), [w for w, k in zip(words, left.tolist(), strict=True) if k]


def remove(docs: DataFrame) -> DataFrame:
    """docs with the repeated passages taken out of the text; kept words are joined by one blank."""

    @tidy
    def run(batches):
        for batch in batches:
            texts = [t if not h else b" ".join(kept_words(t, h)[1]).decode() for t, h in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist(), strict=True)]
            b = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.schema.field("text").type))
            yield b.select(names)

    names, name = docs.columns, fresh(docs, "hits")
    return small_batches(marked(docs, name).select(*names, name)).mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    @tidy
    def run(batches):
        for batch in batches:
            n, gone, sha = [], [], []
            for t, h in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                total, left = kept_words(t, h)
                n.append(total)
                gone.append(total - len(left))
                sha.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every whole text."""
    return report(table(spark, sf_dir, "documents"))
