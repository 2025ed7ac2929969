import hashlib
import random

from rillhouse.llm import merkle as M

TEXTS = ["", None, "a", "one line of words that goes on and on for a while", "p one\np two\n\np three is longer than that", "é😀" * 50, "x " * 20000, "p one\np two\n\np three is longer than that", "\n\n", "\n"]


def brute(rows):
    rows = [(i, t or "") for i, t in rows]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        new = t[: len(t) - m] + after[:m]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), M.fingerprint(t), M.fingerprint(new), M.likeness(M.fingerprint(t), M.fingerprint(new)), M.likeness(M.fingerprint(t), M.fingerprint(after))))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:3])


def test_equality_and_likeness():
    prints = [M.fingerprint(t or "") for t in TEXTS]
    for a, x in zip(TEXTS, prints, strict=True):
        for b, y in zip(TEXTS, prints, strict=True):
            assert ((a or "") == (b or "")) == (x == y) and M.likeness(x, y) == M.likeness(y, x)
    rng = random.Random(1)
    t = "\n".join(" ".join(f"w{rng.randint(0, 999)}" for _ in range(40)) for _ in range(12))
    lines = t.split("\n")
    lines[7] = "entirely other words here"
    a, b = M.fingerprint(t), M.fingerprint("\n".join(lines))
    assert 0.8 < M.likeness(a, b) < 1 and len(M.changed(a, b)) == 1
    assert M.likeness(a, M.fingerprint("nothing in common at all")) < 0.05


def test_rows(spark):
    rows = [*enumerate(TEXTS), (3, "again"), (3, "again"), (None, "n"), (None, None)]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, n_chars long, bucket string")
    assert sorted(map(tuple, M.compare(df).collect()), key=key) == sorted(brute(rows), key=key)
    one = df.where("doc_id = 4")
    assert M.compare(one).first()["near_next"] == 1.0
    assert M.compare(df.limit(0)).count() == 0
    assert M.fingerprints(df).count() == len(rows)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, M.query(spark, sf).collect()), key=key)
    assert got == sorted(brute(docs), key=key)
    long = [r for r in got if r[1] > 300]
    assert sum(r[5] > r[6] for r in long) > 0.98 * len(long) and min(r[5] for r in long) > 0.3


def test_tree_by_hand():
    """Root and branches from hashlib alone; an edit changes its own paragraph, the sections and the root above it only."""
    import hashlib

    from rillhouse.llm import merkle as M

    lines = [f"paragraph number {i} has some words of its own in it, and then some more of them" for i in range(40)]
    text = "\n".join(lines)
    got = M.tree(M.fingerprint(text))
    assert [h for _, s in got for h, _ in s] == [hashlib.sha256(x.encode()).hexdigest()[:12] for x in lines]
    top, own = hashlib.sha256(), hashlib.sha256()
    for x in lines:
        d = hashlib.sha256(x.encode()).digest()
        own.update(d)
        if not d[0] & 3:
            top.update(own.digest())
            own = hashlib.sha256()
    if hashlib.sha256(lines[-1].encode()).digest()[0] & 3:
        top.update(own.digest())
    assert M.fingerprint(text)[:64] == top.hexdigest()
    other = "\n".join([*lines[:20], lines[20] + " edited", *lines[21:]])
    assert [got[i][1][j][0] for i, s in enumerate(got) for j in range(len(s[1]))].index(hashlib.sha256(lines[20].encode()).hexdigest()[:12]) == 20
    changed = M.changed(M.fingerprint(text), M.fingerprint(other))
    assert len(changed) == 1
    leaves = [x for _, s in got for _, p in s for x in p]
    new = [x for _, s in M.tree(M.fingerprint(other)) for _, p in s for x in p]
    from collections import Counter

    assert M.likeness(M.fingerprint(text), M.fingerprint(other)) == 2 * (Counter(leaves) & Counter(new)).total() / (len(leaves) + len(new)) > 0.9
