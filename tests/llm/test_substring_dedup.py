import hashlib
import random
from collections import Counter

from rillhouse.llm import substring_dedup as S


def brute(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), b" ".join(left).decode()))
    return out


def test_automaton():
    rng = random.Random(1)
    for _ in range(30):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(3, 30))] for _ in range(4)]
        a = S.SuffixAutomaton()
        for s in seqs:
            a.add(s, 1)
        a.close()
        seen = Counter(tuple(s[i : i + 3]) for s in seqs for i in range(len(s) - 2))
        for s in seqs:
            assert a.repeated(s, 3) == [i for i in range(len(s) - 2) if seen[tuple(s[i : i + 3])] > 1]


def texts():
    rng = random.Random(7)
    w = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    p, q = w(60), w(35)
    out = [None, "", "few words", " ".join(w(34)), " ".join(w(20) + p + w(20)), " ".join(w(5) + p), " ".join(p[:50] + w(9)), " ".join(q), "\t".join(q) + "\n", " ".join(w(3) + q[:34] + w(3))]
    out += [" ".join(w(40) + p[10:48] + w(40) + p[10:48]), "a " * 200, "É é " * 30, " ".join(w(8000))]
    out += [" ".join(w(60))] * 3 + [" ".join(w(rng.randint(1, 12)) + p + w(rng.randint(1, 12))) for _ in range(40)]
    return out


def check(spark, hot):
    rows = [(i, t, 9, "x") for i, t in enumerate(texts())] + [(None, texts()[4], 9, "x"), (5, "other text", 9, "x")]
    old, S.HOT = S.HOT, hot
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string, hits int, mini string")
        want = brute([r[1] for r in rows])
        got = S.report(df).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[3])
        assert sorted(map(tuple, got), key=key) == sorted(((r[0], *x[:3]) for r, x in zip(rows, want, strict=True)), key=key)
        assert S.report(df.limit(0)).count() == 0
        return rows, want
    finally:
        S.HOT = old


def test_small_cases(spark):
    check(spark, 256)


def test_hot_minimizers(spark):
    check(spark, 4)


def test_remove(spark):
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts())], "doc_id long, text string, source string")
    want = brute(texts())
    for r in S.remove(df).collect():
        x = want[r["doc_id"]]
        assert r["source"] == "s" and r["text"] == (x[3] if x[1] else texts()[r["doc_id"]])


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute([t for _, t in docs])
    assert sorted(map(tuple, S.query(spark, sf).collect())) == sorted((d, *x[:3]) for (d, _), x in zip(docs, want, strict=True))
    assert any(x[1] for x in want)


def test_clashing_columns_pass_unchanged(spark):
    from rillhouse.llm import substring_dedup as S

    same = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, f"a {same}", "h"), (2, f"b {same}", "h"), (3, "c", None)], "doc_id long, text string, hits string").selectExpr("*", "hits as own_hash", "hits as hit_id", "hits as hit_hash", "hits as text_hash")
    out = S.remove(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a", *["h"] * 5), (2, "b", *["h"] * 5), (3, "c", *[None] * 5)]
