import hashlib

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from rillhouse.llm import secrets, toxicity

from .test_decontam import brute as contaminated
from .test_ngram_join import brute as components
from .test_secrets import brute as spans


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [C.STAGES[0][1](spark, docs, sf)]
    scores = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = [r for r in docs.collect() if scores[r["doc_id"]] < toxicity.THRESHOLD]
    assert sorted(kept[0].collect()) == sorted(rows)

    step = C.STAGES[1][1](spark, spark.createDataFrame(rows, docs.schema), sf)
    alone = {d for d, _, c in components([(r["doc_id"], r["text"]) for r in rows], 5, 8, 10) if d == c}
    rows = [r for r in rows if r["doc_id"] in alone]
    assert step.columns == columns and sorted(step.collect()) == sorted(rows)

    step = C.STAGES[2][1](spark, spark.createDataFrame(rows, docs.schema), sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, x in contaminated([(r["doc_id"], r["text"]) for r in rows], items).items() if x[-1]}
    rows = [r for r in rows if r["doc_id"] not in bad]
    assert step.columns == columns and sorted(step.collect()) == sorted(rows)

    step = C.STAGES[3][1](spark, spark.createDataFrame(rows, docs.schema), sf)
    masked = {}
    for r in rows:
        at, out = 0, ""
        for a, _, b, _ in spans(r["text"], secrets.BASE + secrets.MORE):
            if a >= at:
                out += r["text"][at:a] + secrets.MASK
            at = max(at, b)
        masked[r["doc_id"]] = out + r["text"][at:]
    assert step.columns == columns and {r["doc_id"]: r["text"] for r in step.collect()} == masked
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect())

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in C.run(spark, sf).collect():
        assert r["text"] == masked.pop(r["doc_id"])
        ids = lib.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert not masked


NAMES = ["hits", "text_hash", "own_hash", "toxic_score", "label_id", "key_id", "node", "cand_id", "may_assign", "secret_spans", "fingerprint", "ids", "decoded", "item", "toxic"]


def test_every_stage_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing columns: what each stage keeps."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(1, None), (2, ""), (3, "plain words that stand in no other row here"), (3, "plain words that stand in no other row here"), (None, "a row without any number of its own at all"), (None, None), (4, item), (5, "long " * 60_000), (6, "token=abcdefgh and more")]
    plain = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = plain.selectExpr("*", *(f"concat('mine', coalesce(doc_id, 0)) as {c}" for c in NAMES))
    want = {
        "toxicity": sorted(rows, key=str),
        "ngram_jaccard_join": sorted([*rows[:3], *rows[4:]], key=str),
        "benchmark_decontamination": sorted((r for r in rows if r[0] != 4), key=str),
        "secret_scans": sorted([*rows[:-1], (6, f"{secrets.MASK} and more")], key=str),
        "bpe_encoding": sorted(rows, key=str),
    }
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want[name], name
        assert all(r[c] == f"mine{r['doc_id'] or 0}" for r in got for c in NAMES), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    encoded = {r["doc_id"]: r["n_tokens"] for r in out.collect()}
    assert encoded[1] == encoded[2] == 0 and encoded[5] >= 60_000
