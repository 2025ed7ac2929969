import random

import pytest

from rillhouse.llm import ngram_join as N


def sets_of(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, num, den):
    sets = [(d, sets_of(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def cases(seed=2):
    rng = random.Random(seed)
    w = lambda n, v=3000: [f"w{rng.randint(0, v)}" for _ in range(n)]
    base, line = w(120), w(30)
    docs = [None, "", "one", "ONE", "one two", "one two", "É x y z", " ".join(w(5000))]
    for _ in range(60):  # near copies of one text, some linked only through others
        x = list(base)
        for _ in range(rng.randint(0, 5)):
            x[rng.randrange(len(x))] = f"n{rng.randint(0, 9999)}"
        docs.append(" ".join(x))
    docs += [" ".join(w(rng.randint(5, 60)) + line) for _ in range(60)]  # one passage in many documents
    docs += [" ".join(line)] * 40
    for _ in range(40):
        x = w(rng.randint(10, 40), 30)
        docs += [" ".join(x), " ".join(x + ["tail"]), " ".join(x[1:])]
    rng.shuffle(docs)
    return [*enumerate(docs), (None, "one two"), (None, None), (5, " ".join(base)), (5, "x y z a b c")]


def test_bitmaps_never_rule_a_link_out():
    import numpy as np

    rng = random.Random(4)
    for _ in range(40):
        sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 20))), np.uint64) for _ in range(30)]
        for a in sets:
            for b in sets:
                if N.linked(a, b, 7, 10):
                    assert N.may_link(len(a), N.bitmap(a), len(b), N.bitmap(b), 7, 10)


def test_unions_reject_groups(monkeypatch):
    """A query that shares tokens with a group, but too few for a link with any member, doesn't open it."""
    import numpy as np

    monkeypatch.setattr(N, "GROUP", 4)
    sets = [np.arange(i * 100, i * 100 + 20, dtype=np.uint64) for i in range(8)] + [np.concatenate((np.arange(5), np.arange(700, 715))).astype(np.uint64)]
    opened = []
    root, n = N.link_counts(sets, np.ones(9, np.int64), None, 9, 10, opened.append)
    assert n.sum() == 0 and root.tolist() == list(range(9))
    assert sum(opened) < 9  # of 9 queries and 3 groups; own groups are met only by what comes later in them


@pytest.mark.parametrize(("k", "num", "den", "block", "common"), [(3, 90, 100, 2048, 32), (5, 8, 10, 8, 3)])
def test_small_cases(spark, monkeypatch, k, num, den, block, common):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "COMMON", common)
    docs = cases()
    df = spark.createDataFrame([(d, t, 3, "x") for d, t in docs], "doc_id long, text string, n int, comp string")
    want = sorted(brute(docs, k, num, den), key=key)
    assert sorted((tuple(r)[:3] for r in N.components(df, k, num, den).collect()), key=key) == want
    keep = N.representatives(df, k, num, den)
    assert keep.columns == df.columns
    assert {r["doc_id"] for r in keep.collect()} == {None} | {d for d, _, c in want if d == c and d is not None}
    ids = [r["doc_id"] for r in keep.where("size(split(trim(text), ' ')) > 0 and trim(text) <> ''").collect()]
    assert len(ids) == len(set(ids)) and None not in ids  # one row of each component; the null id's text is a copy


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.components(df).count() == 0 and N.representatives(df).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, N.query(spark, sf).collect())) == sorted(brute_links(docs, 3, 90, 100))


def brute_links(docs, k, num, den):
    sets = [(d, sets_of(t, k)) for d, t in docs]
    ok = lambda x, y: x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y)
    return [(*c, None if c[0] is None else sum(bool(ok(x, y)) for j, (d, y) in enumerate(sets) if j != i and d is not None)) for i, (c, (_, x)) in enumerate(zip(brute(docs, k, num, den), sets, strict=True))]


def test_link_counts_equal_brute_force(monkeypatch):
    import numpy as np

    monkeypatch.setattr(N, "GROUP", 4)
    rng = random.Random(5)
    for _ in range(30):
        sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64) for _ in range(40)]
        weight = np.array([rng.randint(1, 3) for _ in sets])
        for side in (None, np.array([rng.randint(0, 1) for _ in sets])):
            link = lambda x, y: x != y and (side is None or side[x] != side[y]) and N.linked(sets[x], sets[y], 7, 10)  # noqa: B023, E731
            root, n = N.link_counts(sets, weight, side, 7, 10)
            assert n.tolist() == [sum(int(weight[y]) for y in range(len(sets)) if link(x, y)) for x in range(len(sets))]
            assert all(root[x] == root[y] for x in range(len(sets)) for y in range(len(sets)) if link(x, y))


@pytest.mark.parametrize(("k", "num", "den", "block"), [(3, 90, 100, 2048), (5, 8, 10, 8)])
def test_every_link_counts(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(N, "BLOCK", block)
    docs = cases()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, n_links string")
    assert sorted(map(tuple, N.components(df, k, num, den).collect()), key=key) == sorted(brute_links(docs, k, num, den), key=key)


def test_repeated_rows_and_clashing_columns(spark):
    docs = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 2), (2, "a b c d e f g", 3), (None, "a b c d e f g", 4), (None, "q r s t u", 5), (None, "q r s t u", 6), (3, None, 7), (3, "", 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, key_id int").selectExpr("*", "key_id as key_hash", "key_id as node")
    kept = N.representatives(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, "q r s t u"), (1, "a b c d e f g"), (3, ""), (3, "")]
    assert all(r["key_id"] == r["key_hash"] == r["node"] for r in got)
