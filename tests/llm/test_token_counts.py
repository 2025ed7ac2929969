import random

from rillhouse.llm import token_counts as T
from rillhouse.llm.bpe import pretokens
from rillhouse.llm.bpe_codec import default_vocabulary

TEXTS = [None, "", " ", "hello hello world", "  two  spaces\n\n", "é😀 日本語", "supercalifragilistic " * 500, "z" * 3000, "don't 123", "hello hello world"]


def brute(model, text):
    n = tokens = score = 0
    for w in pretokens(text or ""):
        b = w.encode()
        best = [(0, 0)] + [None] * len(b)
        for i in range(1, len(b) + 1):
            for j in range(i):
                s = model.score.get(b[j:i])
                if s is not None and best[j] is not None:
                    x = (best[j][0] + s, best[j][1] - 1)
                    best[i] = x if best[i] is None or x > best[i] else best[i]
        n, tokens, score = n + 1, tokens - best[-1][1], score + best[-1][0]
    return n, tokens, score


def test_shared_prefixes_equal_word_by_word():
    m = T.Unigram(default_vocabulary())
    rng = random.Random(2)
    words = {"".join(rng.choice("abtheinér ") for _ in range(rng.randint(1, 14))).encode() for _ in range(2000)}
    together = m.counts(words)
    assert all(m.counts([w])[w] == together[w] for w in words)


def test_rows(spark):
    m = T.Unigram(default_vocabulary())
    rows = [*enumerate(TEXTS), (None, "none"), (3, "other")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, T.token_counts(df).collect()), key=key) == sorted(((i, *brute(m, t)) for i, t in rows), key=key)
    assert T.token_counts(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    m = T.Unigram(default_vocabulary())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in T.query(spark, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[d] == brute(m, t) for d, t in docs if len(t) < 4000)


def test_scores_are_worked_out_once_a_prefix():
    trie = T.Trie(T.Unigram(default_vocabulary()))
    words = [b"token", b"tokens", b"tokenizer", b"to", b"token"]
    got = [trie.count(w) for w in words]
    assert len(trie.best) == 1 + len(b"tokenizer") + 1 and len(trie.ends) == 4
    assert got == [(n, s) for _, n, s in (brute(trie.model, w.decode()) for w in words)]


def test_bounded_memory_gives_the_same():
    path = default_vocabulary()
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abtheinr") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    col = T.pa.array([*texts, None, "", "x" * 50_000], T.pa.large_string())
    small = T.Counter_(path, most=100, nodes=200)
    both = [[c.count(col.slice(i, 5)).tolist() for i in range(0, len(col), 5)] for c in (small, T.Counter_(path))]
    assert both[0] == both[1]
