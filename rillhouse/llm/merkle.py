"""Document fingerprints: a Merkle tree over sections and paragraphs.

A paragraph is a line; a section ends at an empty line or where a paragraph's hash says so (so that texts without
empty lines have sections too, and an edit moves no other section's end). A paragraph's leaves are short runs of
words, cut where a word's hash says so. The fingerprint is the tree written out: root, and for each section and
paragraph its hash, with the leaves' hashes. Roots are SHA-256 over the paragraphs' SHA-256: equal texts have equal
fingerprints, other texts other roots. Likeness walks both trees from the top, takes equal branches whole, and goes
down only where they differ: the share of leaves that both have.

Defined results: a null text is empty; two empty texts are alike (1), an empty and another are not (0); documents come
in descending doc_id order, ties by text descending, a null doc_id last; a single document is its own next one;
repeated rows stand one after the other; an empty table gives no rows; a very long text is one tree, written whole;
columns besides doc_id and text, of whatever name, are never read and pass through fingerprints() unchanged.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, table
from .words import small_batches, tidy


#: A leaf ends after so many words at the latest.
LEAF_WORDS = 6
_CUT = b"".join(b"\\x%02x" % b for b in range(0, 256, 8))
_PARTS = re.compile(b"[^%s]*[%s]|[^%s]+" % (_CUT, _CUT, _CUT), re.S)


def leaves(paragraph: bytes) -> list[str]:
    out, run, words = [], 0, paragraph.split(b" ")
    if len(paragraph) < 64:  # short lines, and long strings without blanks, are cut where their bytes say so
        words = _PARTS.findall(paragraph)
    elif len(paragraph) > 16 * len(words):
        words = [p for w in words for p in (_PARTS.findall(w) if len(w) > 24 else (w,))]
    n, most = 0, 1 if len(paragraph) < 64 else LEAF_WORDS
    for w in words:
        c = zlib.crc32(w)
        run = zlib.crc32(w, run + 1 & 0xFFFFFFFF)
        n += 1
        if not c & 3 or n == most:
            out.append(f"{run:08x}")
            run = n = 0
    if run:
        out.append(f"{run:08x}")
    return out


def fingerprint(text: str | None) -> str:
    """root[section(paragraph,leaf,leaf)(paragraph...)][section...]"""
    if not text:
        return hashlib.sha256(b"").hexdigest()
    top, sections, inside, own = hashlib.sha256(), [], [], hashlib.sha256()
    for line in text.encode().split(b"\n"):
        h = hashlib.sha256(line).digest()
        inside.append(f"({h.hex()[:12]}{''.join(',' + x for x in leaves(line))})" if line else "()")
        own.update(h)
        if not line or not h[0] & 3:
            top.update(own.digest())
            sections.append(f"[{own.hexdigest()[:12]}{''.join(inside)}]")
            inside, own = [], hashlib.sha256()
    if inside:
        top.update(own.digest())
        sections.append(f"[{own.hexdigest()[:12]}{''.join(inside)}]")
    return top.hexdigest() + "".join(sections)


def tree(print_: str) -> list[tuple[str, list[tuple[str, list[str]]]]]:
    """Sections as (hash, paragraphs), paragraphs as (hash, leaves)."""
    out = []
    for s in print_[64:].split("[")[1:]:
        h, *paragraphs = s[:-1].split("(")
        parts = (p[:-1].split(",") for p in paragraphs)
        out.append((h, [(p[0], p[1:]) for p in parts]))
    return out


def likeness(a: str, b: str) -> float:
    """Dice share of common leaves; equal branches are not opened."""
    if a[:64] == b[:64]:
        return 1.0
    left, right = tree(a), tree(b)
    total = sum(len(p) for t in (left, right) for _, s in t for _, p in s)
    if not total:
        return 0.0
    common = 0
    same = Counter(h for h, _ in left) & Counter(h for h, _ in right)

    def rest(nodes, same, size):
        """Nodes that have no equal on the other side, and the leaves of those that have."""
        left_over, taken, have = [], 0, Counter(same)
        for h, below in nodes:
            if have[h]:
                have[h] -= 1
                taken += size(below)
            else:
                left_over += below
        return left_over, taken

    left, n = rest(left, same, lambda s: sum(len(p) for _, p in s))
    right, _ = rest(right, same, lambda s: 0)
    common += n
    same = Counter(h for h, _ in left) & Counter(h for h, _ in right)
    left, n = rest(left, same, len)
    right, _ = rest(right, same, len)
    common += n + (Counter(left) & Counter(right)).total()
    return 2 * common / total


def changed(a: str, b: str) -> list[tuple[int, int]]:
    """Where b differs from a: (section, paragraph) of b whose paragraph a doesn't have."""
    have = Counter(h for _, s in tree(a) for h, _ in s)
    out = []
    for i, (_, s) in enumerate(tree(b)):
        for j, (h, _) in enumerate(s):
            if have[h]:
                have[h] -= 1
            else:
                out.append((i, j))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with `fingerprint`, in place of a column of that name."""
    ship(docs.sparkSession)

    @tidy
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(t) for t in b.column("text").to_pylist()], pa.string())], [*b.schema.names, "fingerprint"])

    df = small_batches(docs.drop("fingerprint"))
    return df.mapInArrow(run, df.withColumn("fingerprint", F.lit(None).cast("string")).schema)


def numbers(x: list[int]) -> Column:
    """A constant array, which the optimizer makes one literal, however long it is."""
    return F.from_json(F.lit(json.dumps(x)), "array<bigint>")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, tail, doc_id, text) sorted so that each document's next one follows it.

    Documents are dealt to ranges of doc_id; the first of a range also goes, as a tail, to the end of the range
    before it (and the very first to the end of the last), so no task needs another's rows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted({int(x) for x in docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})
    bounds = numbers(edges)

    def step(x, _):
        mid = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        up = F.get(bounds, mid) <= F.col("doc_id").cast("long")
        return F.when(x["lo"] >= x["hi"], x).otherwise(F.struct(F.when(up, mid + 1).otherwise(x["lo"]).alias("lo"), F.when(up, x["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(edges).bit_length()))), start, step, lambda x: x["lo"])  # binary search
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(F.lit(len(edges)) - found)
    rows = docs.select(bucket.cast("int").alias("bucket"), F.lit(0).alias("tail"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    used = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # at most n numbers
    before = [0] * (len(edges) + 1)
    for i, b in enumerate(used):
        before[b] = used[i - 1]
    heads = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("h")).select(F.get(numbers(before), F.col("bucket")).cast("int").alias("bucket"), F.lit(1).alias("tail"), F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"))
    return rows.union(heads).repartitionByRange(max(1, len(used)), "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def edited(text: str, after: str) -> str:
    """The last third of the code points replaced by as many of the next document's first."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document, its edited text and the next document."""
    ship(spark)
    return compare(table(spark, sf_dir, "documents"))


def compare(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    @tidy
    def run(batches):
        last = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for tail, i, text in zip(*(batch.column(c).to_pylist() for c in ("tail", "doc_id", "text")), strict=True):
                mark = fingerprint(text)
                if last:
                    j, before, own = last
                    new = edited(before, text)
                    changed_mark = fingerprint(new)
                    row = (j, len(before), hashlib.sha256(new.encode()).hexdigest(), own, changed_mark, likeness(own, changed_mark), likeness(own, mark))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                last = None if tail else (i, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return small_batches(with_next(docs)).mapInArrow(run, schema)
