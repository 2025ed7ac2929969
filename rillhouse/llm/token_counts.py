"""Token counts by dynamic programming over a trie of pre-tokens.

The vocabulary is read as a unigram model: piece number i has the probability of Zipf's law, so its score is
-log(i + 1) in thousandths (whole numbers, so that sums are exact). A pre-token's count is the number of pieces in its
best-scored cut, fewest pieces on ties. Distinct pre-tokens go into a trie, which a worker keeps over its batches up to
a bounded size; a node's forward score depends only on the bytes above it and is worked out once for all words below;
nodes where words end store their counts. A text's numbers are the sums over its words.

Defined results: a null or empty text has no tokens; any byte is a piece, so every text can be cut; repeated rows are
counted each for itself; an empty table gives no rows; a very long text is counted whole; columns besides doc_id and
text, of whatever name, are never read.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship, table
from .bpe import Memo, byte_alphabet, pretokens
from .bpe_codec import default_vocabulary
from .words import keeping, kept, pieces, small_batches


class Unigram:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_alphabet()
        special = {x["content"] for x in spec.get("added_tokens", [])}
        self.score = {bytes(byte[c] for c in s): -round(1000 * math.log(i + 1)) for s, i in spec["model"]["vocab"].items() if s not in special}
        #: Every ending of a piece, with the score of those that are pieces: a search backwards ends where none goes on.
        self.tails: dict[bytes, int | None] = {p[i:]: None for p in self.score for i in range(len(p))}
        self.tails.update(self.score)

    def counts(self, words) -> dict[bytes, tuple[int, int]]:
        """(pieces, score) of each word, through the trie of all of them."""
        trie = Trie(self)
        return {w: trie.count(w) for w in words}


class Trie:
    """Pre-tokens with shared prefixes: each node has the best score, and its pieces, of the bytes from the root to it.

    A node's score needs only nodes above it and is worked out once, when the first word through it is inserted; where
    words end, their counts are stored.
    """

    def __init__(self, model: Unigram):
        self.model = model
        self.child: dict[int, int] = {}  # 256 * node + byte -> node
        self.best = [(0, 0)]  # (score, -pieces)
        self.ends: dict[int, tuple[int, int]] = {}

    def count(self, word: bytes) -> tuple[int, int]:
        """(pieces, score) of a word, which is inserted."""
        child, best, tails = self.child, self.best, self.model.tails
        node, path = 0, [(0, 0)]
        for i, c in enumerate(word, 1):
            key = 256 * node + c
            node = child.get(key, -1)
            if node < 0:
                top = None
                for k in range(i - 1, -1, -1):
                    s = tails.get(word[k:i], 0)
                    if s is None:  # the end of pieces, but none itself
                        continue
                    if not s and word[k:i] not in tails:
                        break
                    a, b = path[k]
                    if top is None or (a + s, b - 1) > top:
                        top = (a + s, b - 1)
                node = child[key] = len(best)
                best.append(top)
            path.append(best[node])
        if node not in self.ends:
            self.ends[node] = (-best[node][1], best[node][0])
        return self.ends[node]


class Counter_:
    """Counts of chunks, remembered boundedly."""

    def __init__(self, path: str, most: int = 1_000_000, nodes: int = 400_000):
        self.model, self.nodes = Unigram(path), nodes
        self.trie = Trie(self.model)
        self.memo = Memo(self.ask, None, [], most)

    def ask(self, chunks_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Four numbers for each chunk: pre-tokens, pieces, and the score's lower and upper half, less its sign."""
        if len(self.trie.best) > self.nodes:
            self.trie = Trie(self.model)
        out, count = [], self.trie.count
        for c in chunks_:
            got = [count(w.encode()) for w in pretokens(c)]
            score = -sum(s for _, s in got)
            out += (len(got), sum(n for n, _ in got), score & 0xFFFFFFFF, score >> 32)
        at = 4 * np.arange(len(chunks_))
        return np.array(out, np.uint32), at, np.full(len(chunks_), 4)

    def count(self, col: pa.Array) -> np.ndarray:
        """Pre-tokens, pieces and score of each text."""
        out = [np.zeros((0, 3), np.int64)]
        for i, j, buf, offs in pieces(col):
            flat, n = self.memo.encode(buf, offs)
            flat, own = flat.reshape(-1, 4).astype(np.int64), np.repeat(np.arange(j - i), n // 4)
            total = np.zeros((j - i, 4), np.int64)
            np.add.at(total, own, flat)
            out.append(np.column_stack((total[:, 0], total[:, 1], -(total[:, 2] + (total[:, 3] << 32)))))
        return np.concatenate(out)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, score (thousandths of a log-probability, up to the model's constant)."""
    ship(docs.sparkSession)
    path = path or default_vocabulary()
    kind = dict(docs.dtypes)["doc_id"]

    @keeping
    def run(batches):
        c = kept(("unigram", path), lambda: Counter_(path))
        for b in batches:
            rows = c.count(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, k]) for k in range(3))], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every whole text."""
    return token_counts(table(spark, sf_dir, "documents"))
