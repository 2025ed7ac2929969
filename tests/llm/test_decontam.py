import hashlib
import re

from rillhouse.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        if i is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = {}
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def rows(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_small_cases(spark):
    a = " ".join(f"w{i}" for i in range(20))
    docs = [(0, f"x y {a.upper()} z"), (1, None), (2, ""), (3, "short É item!"), (4, " ".join(f"w{i}" for i in range(12))), (5, "é item short item " * 9), (6, (a + " ") * 3), (7, "q " * 20000 + a), (8, "w1 w2 " + " ".join(f"w{i}" for i in range(7)) + " end")]
    items = [(10, a), (9, "Short É-item"), (8, None), (7, "..."), (None, "x"), (10, a), (11, "w3 w4 w5"), (12, " ".join(f"w{i}" for i in range(5, 20)))]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert rows(decontam.digest(decontam.matches(d, b))) == want
    assert rows(decontam.digest(decontam.matches(d, b, block_bytes=1))) == want
    assert {r[0] for r in decontam.clean(d, b).select("doc_id").collect()} == {i for i, x in want.items() if not x[-1]}
    assert decontam.clean(d, b).columns == d.columns
    longest = {r["doc_id"]: r["longest_match"] for r in decontam.digest(decontam.matches(d, b)).collect()}
    assert longest[0] == 20 and longest[1] == 0
    assert decontam.digest(decontam.matches(d.limit(0), b)).count() == 0
    assert all(not x[-1] for x in rows(decontam.digest(decontam.matches(d, b.limit(0)))).values())


def test_whole_tables_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert rows(decontam.query(spark, sf)) == want
    assert any(x[-1] for x in want.values())


def test_item_of_very_many_words(spark):
    words = [f"x{i}" for i in range(70_000)]
    items = spark.createDataFrame([("big", " ".join(words)), ("short", "only five words in here"), ("other", " ".join(f"y{i}" for i in range(20)))], "item_id string, text string")
    docs = [(1, "a b " + " ".join(words[65_520:65_560]) + " c"), (2, " ".join(words[100:112])), (3, "say only five words in here " + " ".join(f"y{i}" for i in range(20))), (4, " ".join(words[69_900:]))]
    got = {r["doc_id"]: sorted((h["item"], h["item_at"], h["doc_at"], h["length"]) for h in r["hits"] or ()) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {1: [("big", 65_520, 2, 40)], 2: [], 3: [("other", 0, 6, 20), ("short", 0, 1, 5)], 4: [("big", 69_900, 0, 100)]}


def test_wide_word_numbers_find_the_same(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 6, n))
    items = [(str(i), text(n)) for i, n in enumerate([3, 5, 12, 13, 40, 200])]
    batch = decontam.pa.RecordBatch.from_arrays([decontam.pa.array([text(300) + " " + items[5][1][20:200] for _ in range(5)])], ["text"])
    narrow = decontam.scan_batch(batch, decontam.Block(items, 4))
    monkeypatch.setattr(decontam, "MAX_WORDS", 2)
    assert any(narrow) and decontam.scan_batch(batch, decontam.Block(items, 4)) == narrow


def test_short_items_everywhere_and_clashing_columns(spark):
    items = spark.createDataFrame([(i, "a") for i in range(3000)] + [(5000, "a b a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " * 3000, "mine"), (2, "b a b a b", "mine"), (3, "c", None)], "doc_id long, text string, hits string")
    got = {r["doc_id"]: r for r in decontam.report(docs, items).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["longest_match"]) for i in (1, 2, 3)] == [(3000, 3000, 3000), (3, 3001, 3), (0, 0, 0)]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(3, "c", None)]
