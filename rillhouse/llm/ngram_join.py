"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; equal sets are one node, weighted by its rows. Similar sets are put into groups,
the union of each group's tokens is stored, and a query set is compared with the members of a group only if the tokens
that it shares with the union leave room for a link.

Steps: (1) shingles that many sets share are counted over all documents and come last in the token order; (2) each
set's prefix goes into the matrix, keyed by token. It is a quarter longer than the least prefix of which any partner
must share one token, so that partners must share several, which unrelated documents don't; (3) a set's group is the
one of the set that shares most of its prefix, followed up to the group's own group; (4) each group is dealt in blocks of
bounded size, every pair of blocks to one task, which makes a matrix of tokens and smaller groups, bounds each query by
the groups' unions and compares it with all members of the groups that it opens; links are summed there, no pairs are
written; (5) across groups, each token's row of the matrix holds the groups' sizes and positions; a set opens a group
if these leave room for enough common tokens, and pairs that share too few prefix tokens, or whose bitmaps rule a link
out, go no further. No link between different sets is lost.

Defined results: a null or empty text has no shingles, no link and is its own component; fewer words than a shingle are
one shingle; rows that repeat a doc_id are one component whose sets all count; a null doc_id has a null component and a
null number of links and counts for no other; an empty table gives no rows; a very long text is one set like any other;
columns besides doc_id and text, of whatever name, are never read, and representatives() passes them unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship, table
from .words import SPACES, Words, fresh, pieces, shingles, small_batches, tidy

#: Shingles in more than COMMON sets come last in the order; of all hashes this part is counted, and at most so many are kept.
COMMON, COUNTED, MOST_COMMON = 32, 0.5, 500_000
#: Sets of a block; a task compares one or two blocks at a time.
BLOCK = 4096
#: Where links are counted: shingles of a block, and sets of a group of its token-group matrix.
TOKENS, GROUP = 2_000_000, 32
#: Documents in groups up to which their list is broadcast (some tens of bytes each); beyond it, a shuffle join.
MOST_BROADCAST = 1_000_000


def sets_of(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingle hashes) of each row of the batch."""
    for i, _, buf, offs in pieces(batch.column("text")):
        for d, s in enumerate(shingles(Words(buf, offs, SPACES, lower=True), k)):
            yield i + d, s


def bitmap(s: np.ndarray) -> bytes:
    """Which of 2^b hash ranges hold a token, 2^b the power of two from twice the set's size on."""
    b = max(6, (2 * len(s) - 1).bit_length())
    bits = np.zeros(1 << b, np.uint8)
    bits[(s >> np.uint64(64 - b)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def fold(x: bytes, size: int) -> bytes:
    while len(x) > size:
        x = np.packbits(np.unpackbits(np.frombuffer(x, np.uint8)).reshape(-1, 2).max(1)).tobytes()
    return x


def may_link(n: int, x: bytes, m: int, y: bytes, num: int, den: int) -> bool:
    """Whether two sets can share enough: a range that only one of them uses holds a token the other lacks."""
    size = min(len(x), len(y))
    a, b = int.from_bytes(fold(x, size), "big"), int.from_bytes(fold(y, size), "big")
    most = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return most * (num + den) >= num * (n + m)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    c = np.concatenate((a, b))
    c.sort()
    return int((c[1:] == c[:-1]).sum()) * (num + den) >= num * len(c)


def prefix_length(n: int, num: int, den: int) -> int:
    """The least prefix: a partner shares one of its tokens."""
    return n - -(-num * n // den) + 1


def must_share(n: int, num: int, den: int) -> int:
    """Tokens that partners share of prefixes that are longer by one less than this."""
    return 1 + (n - -(-num * n // den)) // 4


#: The same in SQL, for the smaller set of a pair.
def must_share_sql(n: str, num: int, den: int) -> str:
    return f"(1 + ({n} - cast(ceil({num} * {n} / {den}) as int)) div 4)"


def link_counts(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None, num: int, den: int, opened=None) -> tuple[np.ndarray, np.ndarray]:
    """(member of its component, weight of all sets it is linked with) of each set; none may be empty.

    Sets that begin alike share a group, whose union of tokens is kept. Tokens in common with the union bound those
    with a member; only groups whose bound leaves room for a link are opened, and each of their members is compared.
    With sides, sets of one side are not compared with each other. opened: gets the number of groups each set opens.
    """
    order = np.array(sorted(range(len(sets)), key=lambda x: sets[x][:8].tolist()))
    length = np.array([len(sets[x]) for x in order])
    end = np.cumsum(length)
    start = end - length
    tokens, ids = np.unique(np.concatenate([sets[x] for x in order]), return_inverse=True)
    w, sides = weight[order], None if side is None else side[order]
    at = np.arange(0, len(sets), GROUP)
    union = np.unique(ids * len(at) + np.repeat(np.arange(len(sets)) // GROUP, length))  # token by token, its groups
    group = union % len(at)
    row = np.searchsorted(union, np.arange(len(tokens) + 1) * len(at))
    least, most = np.minimum.reduceat(length, at), np.maximum.reduceat(length, at)
    mark = np.zeros(len(tokens), np.int64)
    comp, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    for x, n in enumerate(length.tolist()):
        mine = ids[start[x] : end[x]]
        low, high = -(-num * n // den), den * n // num
        a, size = row[mine], row[mine + 1] - row[mine]
        hits = np.bincount(group[np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())], minlength=len(at))
        room = (hits * (num + den) >= num * (n + np.maximum(least, low))) & (most >= low) & (least <= high)
        mark[mine] = 1
        if opened is not None:
            opened(int(room[x // GROUP + 1 :].sum()))
        for g in np.flatnonzero(room[x // GROUP :]) + x // GROUP:
            i, j = max(g * GROUP, x + 1), min((g + 1) * GROUP, len(sets))
            if i >= j:
                continue
            both = np.add.reduceat(mark[ids[start[i] : end[j - 1]]], start[i:j] - start[i])
            ok = both * (num + den) >= num * (n + length[i:j])
            if sides is not None:
                ok &= sides[i:j] != sides[x]
            if ok.any():
                y = np.flatnonzero(ok) + i
                links[x] += w[y].sum()
                links[y] += w[x]
                for c in set(comp[y].tolist()) - {comp[x]}:
                    comp[comp == c] = comp[x]
        mark[mine] = 0
    root, out = np.zeros_like(comp), np.zeros_like(links)
    root[order], out[order] = order[comp], links
    return root, out


def components_of(edges: DataFrame) -> DataFrame:
    """(node, comp): the least node that edges (a, b) reach, by label exchange and pointer jumping, cut each round."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("seen"))
        step = label.join(near, "a", "left").select("a", "comp", F.least("comp", F.coalesce("seen", "comp")).alias("next"))
        jump = step.join(label.select(F.col("a").alias("next"), F.col("comp").alias("far")), "next", "left").select("a", "comp", F.least("next", F.coalesce("far", "next")).alias("next"))
        new = cut(jump, "labels")
        if new.where("next <> comp").isEmpty():
            return label.select(F.col("a").alias("node"), "comp")
        label = new.select("a", F.col("next").alias("comp"))


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles in very many sets, counted over all documents, sorted; at most MOST_COMMON by construction."""
    top = np.uint64(int(COUNTED * 2**64))

    @tidy
    def run(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "n"])

        for batch in batches:
            for _, s in sets_of(batch, k):
                held.append(s[: np.searchsorted(s, top)])
                n += len(held[-1])
            if n > 2_000_000:
                yield flush()
                held, n = [], 0
        yield flush()

    counts = docs.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    counts = cut(counts, "common")
    least = max(COMMON, (counts.agg(F.sum("n")).first()[0] or 0) // MOST_COMMON)
    got = counts.where(F.col("n") > least).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(got.view(np.uint64))


def shared_rows(docs: DataFrame, k: int, num: int, den: int, kind: str) -> DataFrame:
    """The matrix' rows of tokens that two or more prefixes hold: token, doc_id, n (set size), rest (tokens from this
    one on, in the token order), and the token's hub, the document of least priority among its holders."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))

    @tidy
    def run(batches):
        last = common.value
        for batch in batches:
            rows, token, size, rest = [], [], [], []
            for d, s in sets_of(batch, k):
                if n := len(s):
                    p = min(n, prefix_length(n, num, den) + must_share(n, num, den) - 1)
                    if len(last):
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        s = np.concatenate((s[~late], s[late])) if late.any() else s
                    rows.append(np.full(p, d))
                    token.append(s[:p])
                    size.append(np.full(p, n, np.int32))
                    rest.append(np.arange(n, n - p, -1, dtype=np.int32))
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([pa.array(cat(token, np.uint64).view(np.int64)), batch.column("doc_id").take(pa.array(cat(rows, np.int64))), pa.array(cat(size, np.int32)), pa.array(cat(rest, np.int32))], ["token", "doc_id", "n", "rest"])

    rows = docs.mapInArrow(run, f"token long, doc_id {kind}, n int, rest int")
    by_token = rows.repartition("token").sortWithinPartitions("token", F.xxhash64("doc_id"), "doc_id")

    @tidy
    def with_hub(batches):
        """Rows of one token follow each other; its first document is the hub; tokens of one row are left out."""
        held = None  # the last row so far, and the first row of its token
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*([held[0]] if held else []), batch]).combine_chunks().to_batches()[0]
            token = t.column("token").to_numpy()
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            again = np.zeros(len(token), bool)  # holder of a token that another row has too
            again[1:] = ~new[1:]
            again[:-1] |= ~new[1:]
            hub, hub_n = t.column("doc_id").take(pa.array(first)), t.column("n").take(pa.array(first))
            if held and not new[1:2].any() and held[1] is not None:  # the token began before this batch
                lead = first == 0
                a = pa.scalar(held[1][0], hub.type)
                hub = pc.if_else(pa.array(lead), a, hub)
                hub_n = pc.if_else(pa.array(lead), pa.scalar(held[1][1], pa.int32()), hub_n)
            start = hub[-1].as_py(), hub_n[-1].as_py()
            keep = again.copy()
            if held:
                keep[0] = again[0] and not held[2]  # already given out with its batch
            out = pa.RecordBatch.from_arrays([*t.columns, hub, hub_n], [*t.schema.names, "hub", "hub_n"])
            yield out.filter(pa.array(keep))
            held = (t.slice(len(token) - 1, 1), start, bool(again[-1]))

    small = small_batches(by_token)
    out = cut(small.mapInArrow(with_hub, f"token long, doc_id {kind}, n int, rest int, hub {kind}, hub_n int"), "shared")
    common.destroy()
    return out


def sketches(docs: DataFrame, k: int, kind: str) -> DataFrame:
    """doc_id, n and token bitmap of each row."""

    @tidy
    def run(batches):
        for batch in batches:
            got = [(len(s), bitmap(s)) for _, s in sets_of(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], ["doc_id", "n", "bits"])

    return cut(docs.mapInArrow(run, f"doc_id {kind}, n int, bits binary"), "sketches")


def bounded(pairs: DataFrame, sketch: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose bitmaps allow a link."""
    s = lambda c: sketch.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(s("a"), "a").join(s("b"), "b").where(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")

    @tidy
    def run(batches):
        for batch in batches:
            ok = [may_link(n, x, m, y, num, den) for n, x, m, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True)]
            yield batch.select(names).filter(pa.array(ok, pa.bool_()))

    names = pairs.columns
    return both.select(*names, "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, pairs.schema)


def groups_of(shared: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id and grp: the hub that shares most of a document's prefix, or the group that the hub itself is in."""
    fits = f"{den} * least(n, hub_n) >= {num} * greatest(n, hub_n)"
    pairs = shared.where(F.col("doc_id") != F.col("hub")).where(fits).groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("hits"), F.min(F.least("n", "hub_n")).alias("n"))
    pairs = cut(pairs, "hub-pairs")
    most = F.expr("max_by(hub, struct(hits, -xxhash64(hub)))").alias("grp")
    best = cut(pairs.where(f"hits >= {must_share_sql('n', num, den)}").groupBy("doc_id").agg(most), "groups")
    for _ in range(3):  # a hub comes before its followers in priority, so paths end
        up = best.select(F.col("doc_id").alias("grp"), F.col("grp").alias("up"))
        best = best.join(up, "grp", "left").select("doc_id", F.coalesce("up", "grp").alias("grp"))
    best = cut(best, "groups")
    # who shares too little with any hub joins the group of the nearest one, so that its pairs needn't be listed
    rest = pairs.join(best.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(most)
    up = best.select(F.col("doc_id").alias("grp"), F.col("grp").alias("up"))
    best = cut(best.union(rest.join(up, "grp", "left").select("doc_id", F.coalesce("up", "grp").alias("grp"))), "groups")
    hubs = best.select(F.col("grp").alias("doc_id")).distinct().join(best.select("doc_id"), "doc_id", "left_anti")
    return cut(best.union(hubs.select("doc_id", F.col("doc_id").alias("grp"))), "all-groups")


def counts_inside(uniq: DataFrame, groups: DataFrame, weights: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """a, b, links of each set a that is linked inside its group: b is of its component, links the weight of its partners.

    Every pair of a group is decided in one task: of a large group, each block alone, then each
    two blocks against each other.
    """
    known = groups.join(weights.select(F.col("node").alias("doc_id"), "weight", "n"), "doc_id")
    sizes = known.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("tokens")).where("size > 1")
    sizes = sizes.select("grp", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("tokens") / TOKENS)).cast("int").alias("blocks"))
    mine = F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(j, mine) * F.col("blocks").cast("long") + F.greatest(j, mine))
    dealt = cut(known.join(sizes, "grp").select("doc_id", "grp", "blocks", mine.alias("side"), "weight", F.explode(cells).alias("block")), "cells")
    if dealt.count() <= MOST_BROADCAST:
        dealt = F.broadcast(dealt)
    texts = uniq.join(dealt, "doc_id").repartition("grp", "block").sortWithinPartitions("grp", "block", F.xxhash64("doc_id"))

    @tidy
    def run(batches):
        key, ids, sets, weight, side = None, [], [], [], []

        def done():
            apart = key[1] // key[2] != key[1] % key[2]
            root, n = link_counts(sets, np.array(weight), np.array(side) if apart else None, num, den)
            at = np.flatnonzero(n)
            a = np.array(ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(a[root[at]]), pa.array(n[at])], ["a", "b", "links"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "blocks")), strict=True))
            doc, w, of = (batch.column(c).to_pylist() for c in ("doc_id", "weight", "side"))
            for d, s in sets_of(batch, k):
                if keys[d] != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, sets, weight, side = keys[d], [], [], [], []
                ids.append(doc[d])
                sets.append(s)
                weight.append(w[d])
                side.append(of[d])
        if len(ids) > 1:
            yield done()

    return cut(small_batches(texts).mapInArrow(run, "a long, b long, links long"), "links")


def pairs_outside(shared: DataFrame, groups: DataFrame, num: int, den: int, kind: str) -> DataFrame:
    """Pairs (a, b) of documents of different groups that share as many prefix tokens as partners must.

    The rows of a token, group by group, are the matrix' column: a group's bounds are its sizes and the most tokens
    that one of its members has from this token on. A document opens a group only if these leave room for a link.
    """
    mine = shared.select("token", "doc_id", "n", "rest").join(groups, "doc_id", "left").withColumn("grp", F.coalesce("grp", "doc_id"))
    by_token = small_batches(mine.repartition("token").sortWithinPartitions("token", "grp"))

    def pairs_of(grp, doc, n, rest, seen):
        """Pairs of one token's rows, sorted by group."""
        at = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1])))
        if len(at) < 2:
            return
        end = np.append(at[1:], len(grp))
        g_min, g_max = np.minimum.reduceat(n, at), np.maximum.reduceat(n, at)
        before = n - rest  # tokens ahead of this one: at most so many are shared besides the rest
        g_rest, g_before = np.maximum.reduceat(rest, at), np.maximum.reduceat(before, at)
        for g in range(1, len(at)):
            for q in range(at[g], end[g]):  # against the groups before its own
                room = (num * n[q] <= den * g_max[:g]) & (num * g_min[:g] <= den * n[q])
                room &= (num + den) * (np.minimum(rest[q], g_rest[:g]) + np.minimum(before[q], g_before[:g])) >= num * (n[q] + np.maximum(g_min[:g], -(-num * n[q] // den)))
                for o in np.flatnonzero(room):
                    a, z = at[o], end[o]
                    ok = (den * np.minimum(n[q], n[a:z]) >= num * np.maximum(n[q], n[a:z])) & ((num + den) * (np.minimum(rest[q], rest[a:z]) + np.minimum(before[q], before[a:z])) >= num * (n[q] + n[a:z]))
                    for y in np.flatnonzero(ok) + a:
                        key = (doc[q], doc[y], int(min(n[q], n[y])))
                        seen[key] = seen.get(key, 0) + 1

    @tidy
    def run(batches):
        held, seen = None, {}

        def flush(kind_):
            cols = list(zip(*seen, strict=True)) if seen else [[], [], []]
            out = pa.RecordBatch.from_arrays([pa.array(cols[0], kind_), pa.array(cols[1], kind_), pa.array(cols[2], pa.int32()), pa.array(list(seen.values()), pa.int32())], ["a", "b", "n", "hits"])
            seen.clear()
            return out

        kind_ = None
        for batch in batches:
            kind_ = batch.schema.field("doc_id").type
            t = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks()
            if not len(t):
                continue
            t = t.to_batches()[0]
            token = t.column("token").to_numpy()
            at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            held = t.slice(int(at[-1]))
            doc, grp = t.column("doc_id").to_pylist(), t.column("grp").to_pandas().to_numpy()
            n, rest = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "rest"))
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if grp[a] != grp[z - 1]:
                    pairs_of(grp[a:z], doc[a:z], n[a:z], rest[a:z], seen)
            if len(seen) > 300_000:
                yield flush(kind_)
        if held is not None:
            pairs_of(held.column("grp").to_pandas().to_numpy(), held.column("doc_id").to_pylist(), *(held.column(c).to_numpy().astype(np.int64) for c in ("n", "rest")), seen)
            yield flush(kind_)

    found = by_token.mapInArrow(run, f"a {kind}, b {kind}, n int, hits int").groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("n").alias("n"))
    out = cut(found.where(f"hits >= {must_share_sql('n', num, den)}").select("a", "b"), "open-pairs")
    return out


def links_of_pairs(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, kind: str) -> DataFrame:
    """Pairs that are linked, by comparing the sets themselves."""
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    @tidy
    def hashes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for _, s in sets_of(batch, k)], pa.binary())], ["doc_id", "set"])

    sets = cut(docs.join(wanted, "doc_id").mapInArrow(hashes, f"doc_id {kind}, set binary"), "sets")

    @tidy
    def compare(batches):
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}"), "links")


def nodes_of(docs: DataFrame, k: int, kind: str, salt: int, text: bool) -> DataFrame:
    """doc_id, n, node (a hash of the set, null for an empty one), and another hash of it with one of the text, or else
    the text."""

    @tidy
    def run(batches):
        for batch in batches:
            got = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(8, "big")).digest()) for _, s in sets_of(batch, k)]
            halves = [pa.array([int.from_bytes(h[i : i + 8], "big", signed=True) if n else None for n, h in got], pa.int64()) for i in (0, 8)]
            cols = [batch.column("doc_id"), pa.array([n for n, _ in got], pa.int32()), halves[0], *([batch.column("text")] if text else [halves[1], batch.column("text_hash")])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "node", *(["text"] if text else ["proof", "text_hash"])])

    docs = docs if text else docs.withColumn("text_hash", F.xxhash64("text"))
    return docs.mapInArrow(run, f"doc_id {kind}, n int, node long, " + ("text string" if text else "proof long, text_hash long"))


def linked_nodes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, node, text_hash; nodes: node, comp, weight, least, links).

    Equal sets are one node, weighted by its rows that have a doc_id; all pairs of different nodes that can be linked
    are compared. Inside a group the links are summed where they are found, so no pairs are written.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    docs = small_batches(docs.select("doc_id", "text"))
    salt = 0
    while True:  # until no two sets have one hash
        rows = cut(nodes_of(docs, k, kind, salt, False), "nodes")
        known = rows.where("doc_id is not null and node is not null")
        weights = cut(known.groupBy("node").agg(F.count(F.lit(1)).alias("weight"), F.min("n").alias("n"), F.min("doc_id").alias("least"), (F.min("proof") != F.max("proof")).alias("clash")), "weights")
        if weights.where("clash").isEmpty():
            break
        salt += 1
    some = nodes_of(docs.where(F.col("doc_id").isNotNull()), k, kind, salt, True).where("node is not null")
    uniq = small_batches(cut(some.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts"))
    shared = shared_rows(uniq, k, num, den, "long")
    groups = groups_of(shared, num, den)
    inside = counts_inside(uniq, groups, weights, k, num, den)
    edges, links = inside.where("a <> b").select("a", "b"), inside.select("a", "links")
    more = pairs_outside(shared, groups, num, den, "long")
    if not more.isEmpty():
        more = cut(bounded(more, sketches(uniq, k, "long"), num, den), "bounded-pairs")
        across = links_of_pairs(uniq, more, k, num, den, "long")
        edges = edges.union(across)
        both = across.union(across.select("b", "a"))
        links = links.union(both.join(weights.select(F.col("node").alias("b"), "weight"), "b").select("a", "weight"))
    links = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    several = known.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("nodes")).where("a <> z")
    comp = components_of(edges.union(several.select("a", F.explode("nodes").alias("b"))))
    return rows, cut(weights.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(links, "node", "left"), "labels")


def components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: sets of k-word shingles are linked from a similarity of num / den on.

    n_links is the number of other rows whose set is linked with the row's own.
    """
    rows, label = linked_nodes(docs, k, num, den)
    info = label.join(label.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = cut(rows.select("doc_id", "n", "node").join(info, "node", "left"), "linked")
    of_doc = out.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")
    return out.drop("component_id").join(of_doc, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), n_links)


def representatives(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs with one row of each component: of its least doc_id the text with the least hash, once.

    Rows without shingles stay. A row with a null doc_id goes if a set equal to its own is kept; of several such rows
    without a kept copy one stays.
    """
    rows, label = linked_nodes(docs, k, num, den)
    keys = rows.where("node is not null").join(label.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    keys = keys.groupBy("comp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    first = keys.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")).select("comp", "first")
    known = cut(keys.join(first, "comp").select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"), "copies"), "representatives")
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.xxhash64("text") == F.col("key_hash"))
    twice = known.where("stays and copies > 1")
    taken = docs.columns
    gone = known.where("not stays or copies > 1").select("key_id", "key_hash")
    plain = renamed(docs, ("key_id", "key_hash"))
    out = plain.join(gone, same, "left_anti")
    if not twice.isEmpty():  # rows that repeat both id and text
        out = out.union(plain.join(twice.select("key_id", "key_hash"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.toDF(*taken)


def renamed(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df without columns of these names: they get others, at the same places."""
    out = df
    for c in df.columns:
        if c.lower() in names:
            out = out.withColumnRenamed(c, fresh(out, "_" + c))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: three-word shingles, similarity of 0.9 or more, all documents."""
    return components(table(spark, sf_dir, "documents"), 3, 90, 100)
