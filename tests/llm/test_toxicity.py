import random
import zlib

import numpy as np

from rillhouse.llm import toxicity as T


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(2, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "awful", "nasty"]))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (None, "vile vile awful", "x"), (900, None, "x"), (901, "", "x"), (902, "w1 " * 30000, "x"), (3, docs[3][1], "x")], "doc_id long, text string, toxic string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    rows = T.score(d, lab).collect()
    assert len(rows) == len(docs) + 5 and all(0 <= r["toxic_score"] <= 1 for r in rows)
    got = {r["doc_id"]: r["toxic_score"] for r in rows}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if T.held_out(i)]
    right = sum((got[i] >= T.THRESHOLD) == bool(truth[i]) for i in held)
    assert right >= 0.9 * len(held)
    assert got[900] == got[901] < T.THRESHOLD and got[None] > T.THRESHOLD
    kept = T.reject(d, lab)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < T.THRESHOLD}


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    flip = [(i, q, 1 - t if T.held_out(i) else t) for i, q, t in labels]
    a, b = ({r["doc_id"]: r["toxic_score"] for r in T.score(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flip))
    assert a == b
    assert zlib.crc32(b"12") % 3 == 1 or not T.held_out(12)


def test_counts_of_all_documents(spark):
    docs, labels = corpus()
    unlabelled = [(1000 + i, f"w1 u{i} w2 u{i} u{i + 1}", "en") for i in range(300)]
    d = spark.createDataFrame([*docs, *unlabelled, (None, None, "x")], "doc_id long, text string, lang string")
    pairs, n = {}, {}
    for _, text, _ in [*docs, *unlabelled]:
        w = text.split()
        for a, b in zip([None, *w], w, strict=False):
            pairs.setdefault(b, set()).add(a)
            n[b] = n.get(b, 0) + 1
    got = T.continuations(d).collect()
    assert sorted((r["cont"], r["n"]) for r in got) == sorted((len(pairs[w]), n[w]) for w in pairs)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = T.fit(d.where("doc_id < 1000"), lab), T.fit(d, lab)
    assert (a.words == b.words).all() and not np.array_equal(a.shared, b.shared)
    words = T.Words(*next(T.pieces(T.pa.array(["never seen words of no class"])))[2:], T.NON_ALNUM, lower=True)
    before = b.ratio(words)
    b.unknown *= 1000
    assert np.allclose(b.ratio(words), before)


def test_sample_is_of_labels_with_a_document(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    more = [(10_000 + i, 1, i % 2) for i in range(4000)]
    a, b = ([tuple(r) for r in T.score(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int"), 50).select("doc_id", "toxic_score").collect()] for x in (labels, [*labels, *more]))
    assert sorted(a) == sorted(b)


def test_no_labels_and_no_documents(spark):
    docs, labels = corpus(n=20)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["toxic_score"] for r in T.score(d, none).collect()} == {0.0}
    assert T.score(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in T.query(spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    p = np.array([got[i]["score"] for i in held])
    y = np.array([truth[i] for i in held])
    rank = p.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.88 and ((p >= 0.7) == y).mean() > 0.95


def by_hand(docs, kinds):
    """Both models from dictionaries: P(c, word, before) and the words before it by class."""
    import math

    contexts = [set(), set()]
    for text, kind in zip(docs, kinds, strict=True):
        w = ["^", "^", *text.split()]
        contexts[kind] |= {(w[i - 2], w[i - 1], w[i]) for i in range(2, len(w))}
    two = [{}, {}]
    for c in (0, 1):
        for _, b, w in contexts[c]:
            two[c][b, w] = two[c].get((b, w), 0) + 1
    one = [{}, {}]
    for c in (0, 1):
        for _, w in two[c]:
            one[c][w] = one[c].get(w, 0) + 1
    words = {w for c in (0, 1) for w in one[c]}
    cont = {w: len({b for c in (0, 1) for b, x in two[c] if x == w}) for w in words}
    size, v = sum(cont.values()), len(words)
    none = T.SHARED * v / (v + 1) / size
    shared = lambda w: max(cont.get(w, 0) - T.SHARED, 0) / size + none
    keep = lambda n, d: {k: max(x - d, 0) for k, x in n.items()}
    low = [keep(one[c], T.CLASS) for c in (0, 1)]
    rest = max(1 - sum(low[c].values()) / sum(one[c].values()) for c in (0, 1))
    high = [keep(two[c], T.PAIR) for c in (0, 1)]

    def p(c, w, b):
        below = (1 - rest) * low[c].get(w, 0) / max(sum(low[c].values()), 1e-300) + rest * shared(w)
        mass = [sum(x for (a, _), x in high[k].items() if a == b) for k in (0, 1)]
        seen = [sum(x for (a, _), x in two[k].items() if a == b) for k in (0, 1)]
        left = max(1 - m / max(s, 1) for m, s in zip(mass, seen, strict=True))
        return (1 - left) * high[c].get((b, w), 0) / max(mass[c], 1e-300) + left * below

    return lambda w, b: math.log(p(1, w, b) / p(0, w, b)), p, words, cont, contexts


def test_models_equal_brute_force_and_sum_to_one():
    rng = random.Random(6)
    docs = [" ".join(rng.choice("abcdefg" if rng.random() < 0.9 else "xyz") for _ in range(40)) for _ in range(30)]
    kinds = [i % 2 for i in range(30)]
    docs = [d + " vile x vile y vile" if k else d for d, k in zip(docs, kinds, strict=True)]
    ratio, p, words, cont, _ = by_hand(docs, kinds)
    pairs = []
    for kind in (0, 1):
        w = T.Words(*T.utf8_of([d for d, k in zip(docs, kinds, strict=True) if k == kind]), T.NON_ALNUM, lower=True)
        three = np.unique(np.stack(T.contexts(w)), axis=1)
        two, n = np.unique(three[1:], axis=1, return_counts=True)
        pairs.append((two[0], two[1], np.full(len(n), kind), n.astype(float)))
    m = T.Model(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
    names = sorted(words)
    of = lambda texts: T.Words(*T.utf8_of(texts), T.NON_ALNUM, lower=True)
    hashes = of(names).h
    order = np.empty(len(m.words))
    order[np.searchsorted(m.words, hashes)] = [cont[w] for w in names]
    m.finish(order, len(words), float(sum(cont.values())))
    text = "a b vile x q vile never a c"
    got = m.ratio(of([text]))
    w = ["^", *text.split()]
    assert np.allclose(got, [ratio(w[i], w[i - 1]) for i in range(1, len(w))])
    for before in ["a", "vile", "never"]:
        high, low = m.probabilities(of([f"{before} {x}" for x in [*names, "unknownword"]]))
        for c in (0, 1):
            assert abs(high[c][1::2].sum() - 1) < 1e-9 and abs(low[c][1::2].sum() - 1) < 1e-9


def test_clashing_columns(spark):
    docs, labels = corpus(n=120)
    d = spark.createDataFrame([(*r, "mine", 7) for r in docs], "doc_id long, text string, lang string, toxic_score string, label_id int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = T.reject(d, lab)
    assert kept.columns == d.columns and {(r["toxic_score"], r["label_id"]) for r in kept.collect()} == {("mine", 7)}
