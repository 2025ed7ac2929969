"""Toxicity by two class-conditional Kneser-Ney models.

Words of toxic and of ordinary labelled documents make a bigram model for each class. On the upper level counts are
occurrences of a pair in different contexts, on the lower one the different words that a word follows (continuation
counts); an absolute discount is taken off each, and what it leaves goes to the level below, at last to shared
continuation counts, which are gathered over all documents. The weight of a backoff is the larger one of both classes
and each class's discounted part is scaled to the rest, so that every conditional distribution sums to one and a rare
expression, of which neither class keeps anything, has the same probability in both.

A text's score compares both log-likelihoods, normalised by the text's length: of all words under the bigram models,
and of the expressions whose odds under the continuation models are beyond the chance error of words that both classes
use alike (once a text, divided by the length or its root). A logistic curve, fitted on other labelled documents than
the models, turns that into a probability.

Rows of a held-out third (crc32 of the doc_id) are never learned from. The models are fitted on at most CLASS_DOCS
labelled documents of each class, those with the smallest hashes of doc_id among the labels that have a document. The counts
over all documents grow with the corpus and stay a distributed table, of which the models take the words they know:
the share of any other word is the same in both classes, so it falls out of the comparison whatever its counts.

Defined results: a null or empty text scores as its class odds alone say; a document with several labels counts as
toxic if one says so; a null doc_id is not held out, never learned from and scored like the others; without labels of
both classes every score is 0; repeated rows are scored each for itself; an empty table gives no rows; a very long text
is scored whole, in an Arrow batch of its own; other columns, of whatever name, are never inputs and pass unchanged.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship, table
from .words import NON_ALNUM, Words, fresh, mix, pieces, small_batches, tidy, utf8

CLASS_DOCS = 1500
#: Absolute discounts of pairs, of continuations in a class, and of the shared continuations.
PAIR, CLASS, SHARED = 1.0, 2.0, 0.75
#: Log-odds of an expression from which it is told from chance, and the most that counts.
STRONG, LOUDEST = 2.0, 4.0
FEATURES = 3
#: Score from which a document is predicted toxic.
THRESHOLD = 0.7
#: Words whose different pairs are gathered at a time before they are sent.
HELD_WORDS = 1_500_000
_C = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x5354415254)


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def word_pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (a start mark for the first of a text), and the pair's hash."""
    before = np.empty_like(w.h)
    before[1:] = w.h[:-1]
    before[w.first[:-1][w.first[:-1] < len(w.h)]] = _START
    return before, mix(before * _C + w.h)


def contexts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word before, word) of each word; the context is a hash of the two words before it and itself."""
    before, key = word_pairs(w)
    two = np.empty_like(before)
    two[1:] = before[:-1]
    two[w.first[:-1][w.first[:-1] < len(w.h)]] = _START
    return mix(two * _C + key), before, w.h


def utf8_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


def find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted keys, -1 where it is not."""
    if not len(keys):
        return np.full(len(x), -1)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, i, -1)


class Model:
    """The models of both classes (0 ordinary, 1 toxic) from pairs in different contexts.

    Copies of a passage are one context, so what stands in many copies of one text doesn't look frequent.
    """

    def __init__(self, before: np.ndarray, word: np.ndarray, toxic: np.ndarray, n: np.ndarray):
        """Different pairs of each class with the number of contexts they stand in."""
        self.words, at = np.unique(word, return_inverse=True)
        self.pairs, pat = np.unique(mix(before * _C + word), return_inverse=True)
        self.contexts, cat = np.unique(before, return_inverse=True)
        own = np.zeros(len(self.pairs), np.int64)
        own[pat] = cat
        one = [np.bincount(at[toxic == c], minlength=len(self.words)) for c in (0, 1)]
        two = [np.bincount(pat[toxic == c], n[toxic == c], len(self.pairs)) for c in (0, 1)]
        seen = [np.bincount(own, x, len(self.contexts)) for x in two]
        part = [np.maximum(x - PAIR, 0) for x in two]
        mass = [np.bincount(own, x, len(self.contexts)) for x in part]
        # a word after which either class keeps nothing leaves all to the level below
        self.left = np.max([1 - m / np.maximum(s, 1) for m, s in zip(mass, seen, strict=True)], axis=0) if len(self.contexts) else np.zeros(0)
        self.two = [(1 - self.left[own]) * p / np.maximum(m[own], 1e-300) for p, m in zip(part, mass, strict=True)]
        part = [np.maximum(x - CLASS, 0) for x in one]
        self.rest = max((1 - p.sum() / max(1, x.sum()) for p, x in zip(part, one, strict=True)), default=1.0)
        self.one = [(1 - self.rest) * p / max(p.sum(), 1e-300) for p in part]
        self.curve = np.zeros(1 + FEATURES)

    def finish(self, cont: np.ndarray, v: int, size: float) -> None:
        """cont: shared continuations of the models' words; v and size: words and continuations of the corpus."""
        none = SHARED * v / (v + 1) / size
        self.shared, self.unknown = self.rest * (np.maximum(cont - SHARED, 0) / size + none), self.rest * none

    def probabilities(self, w: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By class: of each word after the one before it, and by itself (the level below)."""
        before, key = word_pairs(w)
        i, p, b = find(self.words, w.h), find(self.pairs, key), find(self.contexts, before)
        take = lambda x, k, other: np.where(k >= 0, x[k], other) if len(x) else np.full(len(k), other)
        low = [take(one + self.shared, i, self.unknown) for one in self.one]
        left = take(self.left, b, 1.0)
        return [take(two, p, 0.0) + left * x for two, x in zip(self.two, low, strict=True)], low

    def ratio(self, w: Words) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word after the one before it."""
        high, _ = self.probabilities(w)
        return np.log(high[1]) - np.log(high[0])

    def features(self, batch: pa.RecordBatch) -> np.ndarray:
        x = np.zeros((batch.num_rows, FEATURES))
        for i, j, buf, offs in pieces(batch.column("text")):
            w = Words(buf, offs, NON_ALNUM, lower=True)
            high, low = self.probabilities(w)
            all_, r = np.log(high[1] / high[0]), np.log(low[1] / low[0])
            n = np.maximum(np.diff(w.first), 1)
            part = lambda v: (t := np.concatenate(([0.0], np.cumsum(v))))[w.first[1:]] - t[w.first[:-1]]  # noqa: E731, B023
            x[i:j, 0] = part(all_) / n
            at = np.flatnonzero(r > STRONG)  # each expression once a text, and none for many others
            _, one = np.unique(np.stack([np.searchsorted(w.first, at, "right").astype(np.uint64), w.h[at]]), axis=1, return_index=True)
            once = np.zeros(len(r))
            once[at[one]] = np.minimum(r[at[one]], LOUDEST)
            strong = part(once)
            x[i:j, 1], x[i:j, 2] = strong / n, np.sqrt(strong / np.sqrt(n))
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))

    def fit_curve(self, x: np.ndarray, y: np.ndarray, odds: float = 0.0, ridge: float = 1e-3) -> None:
        """Logistic regression by Newton steps; the ridge keeps it finite where classes are apart.

        odds: what to add to the log-odds, as the sample has other shares of the classes than all labels.
        """
        scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(FEATURES)
        z = np.column_stack([np.ones(len(x)), x / scale])
        w, on = np.zeros(1 + FEATURES), np.array([0] + [1] * FEATURES)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) / max(1, len(y)) + ridge * w * on
            h = (z.T * (p * (1 - p))) @ z / max(1, len(y)) + np.diag(1e-9 + ridge * on)
            step = np.linalg.solve(h, g)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        self.curve = np.append(w[0] + odds, w[1:] / scale)


def learnable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic of every label that may be learned from and has a document."""
    ids = labels.join(docs.select("doc_id"), "doc_id", "left_semi").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return ids.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")


def labelled(known: DataFrame, class_docs: int) -> DataFrame:
    """doc_id, toxic, part (1: for the curve, else for the models) of the documents to learn from."""
    learn = known.withColumn("order", F.xxhash64("doc_id"))
    parts = [learn.where(F.col("toxic") == c).orderBy("order").limit(class_docs) for c in (0, 1)]
    return parts[0].union(parts[1]).select(F.col("doc_id").alias("label_id"), "toxic", F.expr("pmod(xxhash64(label_id, 7), 3) = 0").cast("int").alias("part"))


def pack(words: np.ndarray, sizes: np.ndarray, n: np.ndarray, before: np.ndarray) -> bytes:
    """Words with how many different ones stand before each, how often it occurs, and 32 bits of the former's hashes."""
    small = b"".join(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for x in (sizes, n))
    head = np.array([len(words), len(before)], np.int64).tobytes()
    return head + words.tobytes() + before.astype(np.uint32).tobytes() + zlib.compress(small, 1)


def unpack(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, sizes, n, before) of what pack() made."""
    words, pairs = np.frombuffer(x, np.int64, 2).tolist()
    at = 16 + 8 * words
    small = np.frombuffer(zlib.decompress(x[at + 4 * pairs :]), np.uint8).reshape(2, 4, words)
    sizes, n = (np.ascontiguousarray(c.T).view(np.uint32)[:, 0].astype(np.int64) for c in small)
    return np.frombuffer(x, np.uint64, words, 16), sizes, n, np.frombuffer(x, np.uint32, pairs, at)


def continuations(docs: DataFrame) -> DataFrame:
    """word, cont (different words before it, the start of a text being one) and n (occurrences), over all documents.

    Each task gathers the different pairs of HELD_WORDS words and sends them, packed, by ranges of the word's hash: a
    word that stands everywhere is sent once a run and context, not once an occurrence. Words before one word are told
    apart by 32 bits, which takes 1 in 10,000 of a million of them for another.
    """
    parts = max(8, 2 * docs.rdd.getNumPartitions())

    @tidy
    def deal(batches):
        held, size = [], 0

        def flush():
            names, ids, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True, return_counts=True)
            pair = ids.view(np.uint64)
            pair <<= np.uint64(32)
            pair |= np.concatenate([x for _, x in held])
            held.clear()
            pair = np.unique(pair)
            ids = (pair >> np.uint64(32)).astype(np.int64)
            sizes = np.bincount(ids, minlength=len(names))
            part = ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(at[1:], len(names))
            row = np.concatenate(([0], np.cumsum(sizes)))
            packed = [pack(names[a:z], sizes[a:z], n[a:z], pair[row[a] : row[z]] & np.uint64(0xFFFFFFFF)) for a, z in zip(at, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(packed, pa.binary())], ["part", "pairs"])

        for batch in batches:
            for _, _, buf, offs in pieces(batch.column("text")):
                w = Words(buf, offs, NON_ALNUM, lower=True)
                if len(w.h):
                    held.append((w.h, mix(word_pairs(w)[0]) >> np.uint64(32)))
                    size += len(w.h)
                if size > HELD_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    @tidy
    def count(batches):
        """Cells of any words, one after the other: what is held are the different pairs so far."""
        names, total, pair = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        held, size = [], 0

        def merge(names, total, pair):
            both, at = np.unique(np.concatenate([names, *(x[0] for x in held)]), return_inverse=True)
            n = np.bincount(at, np.concatenate([total, *(x[2] for x in held)]), len(both)).astype(np.int64)
            keys = [(at[: len(names)].astype(np.uint64)[(pair >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (pair & np.uint64(0xFFFFFFFF))]
            base = len(names)
            for w, sizes, _, before in held:
                keys.append((np.repeat(at[base : base + len(w)].astype(np.uint64), sizes) << np.uint64(32)) | before.astype(np.uint64))
                base += len(w)
            return both, n, np.unique(np.concatenate(keys))

        for batch in batches:
            for x in batch.column("pairs").to_pylist():
                held.append(unpack(x))
                size += len(x)
                if size > 8 << 20:
                    names, total, pair = merge(names, total, pair)
                    held, size = [], 0
        names, total, pair = merge(names, total, pair)
        cont = np.bincount((pair >> np.uint64(32)).astype(np.int64), minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(cont), pa.array(total)], ["word", "cont", "n"])

    dealt = small_batches(docs.select("text")).mapInArrow(deal, "part long, pairs binary").repartition(parts, "part")
    return cut(dealt.mapInArrow(count, "word long, cont long, n long"), "continuations")


def fit(docs: DataFrame, labels: DataFrame, class_docs: int = CLASS_DOCS) -> Model | None:
    """The models; None without documents of both classes."""
    spark = docs.sparkSession
    known = cut(learnable(docs, labels), "labels")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    odds = float(np.log(sizes[1] / sizes[0]) - np.log(min(class_docs, sizes[1]) / min(class_docs, sizes[0])))
    rows = cut(docs.join(F.broadcast(labelled(known, class_docs)), F.col("doc_id") == F.col("label_id")).select("text", "toxic", "part"), "sample")

    @tidy
    def count(batches):
        for batch in batches:
            held: list[list] = [[np.zeros(0, np.uint64)] for _ in range(3)]
            kinds = [np.zeros(0, np.int32)]
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32)
            for i, j, buf, offs in pieces(batch.column("text")):
                w = Words(buf, offs, NON_ALNUM, lower=True)
                for h, v in zip(held, contexts(w), strict=True):
                    h.append(v)
                kinds.append(np.repeat(toxic[i:j], np.diff(w.first)))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(h).view(np.int64)) for h in held), pa.array(np.concatenate(kinds))], ["context", "before", "word", "toxic"])

    each = small_batches(rows).where("part = 0").mapInArrow(count, "context long, before long, word long, toxic int").distinct()
    got = each.groupBy("before", "word", "toxic").agg(F.count(F.lit(1)).alias("n")).toArrow()
    if len(got["toxic"].unique()) < 2:
        return None
    m = Model(*(got[c].to_numpy().view(np.uint64) for c in ("before", "word")), got["toxic"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(float))
    del got
    words = spark.sparkContext.broadcast(m.words)

    @tidy
    def of_models(batches):
        for batch in batches:
            at = find(words.value, batch.column("word").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("cont")], ["at", "cont"]).filter(pa.array(at >= 0))

    corpus = continuations(docs)
    v, size = corpus.agg(F.count(F.lit(1)), F.sum("cont")).first()
    mine = corpus.mapInArrow(of_models, "at long, cont long").toArrow()
    words.destroy()
    cont = np.zeros(len(m.words))
    cont[mine["at"].to_numpy()] = mine["cont"].to_numpy()
    m.finish(cont, v, float(size or 1))
    model = spark.sparkContext.broadcast(m)

    @tidy
    def measure(batches):
        for batch in batches:
            x = model.value.features(batch)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(FEATURES)), batch.column("toxic").cast(pa.int32())], [*names, "toxic"])

    names = [f"x{k}" for k in range(FEATURES)]
    held = rows.where("part = 1").mapInArrow(measure, ", ".join(f"{x} double" for x in names) + ", toxic int").toArrow()
    model.destroy()
    m.fit_curve(np.column_stack([held[c].to_numpy() for c in names]), held["toxic"].to_numpy().astype(float), odds)
    return m


def score(docs: DataFrame, labels: DataFrame, class_docs: int = CLASS_DOCS, name: str = "toxic_score") -> DataFrame:
    """docs with the score in a column `name`, in place of one of that name."""
    ship(docs.sparkSession)
    m = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), class_docs)
    df = small_batches(docs.drop(name))
    if m is None:
        return df.withColumn(name, F.lit(0.0))
    model = docs.sparkSession.sparkContext.broadcast(m)

    @tidy
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.score(model.value.features(b)))], [*b.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(None).cast("double")).schema)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    name = fresh(docs, "toxic_score")
    return score(docs, labels, name=name).where(F.col(name) < THRESHOLD).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every whole text."""
    got = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), F.lit(False))
    return got.select("doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
