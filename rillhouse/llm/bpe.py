"""Byte-level BPE: cutting text into pieces that are encoded alone, a transducer lexicon, exact merges, decoding."""

from __future__ import annotations

import json
import mmap
import os
import re
import tempfile
from array import array

import numpy as np
import regex

from .words import span_hashes

#: Pattern of the byte-level pre-tokenizer and its byte alphabet (fixed values of that format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_SPACE = regex.compile(r"\p{White_Space}")
#: A blank at which a text may not be cut: white space or nothing follows it.
_BLANK = regex.compile(r" (?:\p{White_Space}|$)")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, turned round."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def chunks(text: str) -> list[str]:
    """Cut before a blank that a non-space follows: no token crosses such a place, so chunks are encoded alone.

    Joined, the chunks give the text again.
    """
    if not text:
        return []
    plain = text.isascii() and not ("  " in text or " \n" in text or " \t" in text or " \r" in text or " \x0b" in text or " \x0c" in text or text[-1] == " ")
    if not plain and _BLANK.search(text):
        at = [m.start() for m in regex.finditer(r" (?=\P{White_Space})", text)]
        if not at or at[0]:
            at = [0, *at]
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
    head, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if head:
        out.insert(0, head)
    return out


def pretokens(text: str) -> list[str]:
    if text.isalpha() or text[1:].isalpha() and text[0] == " ":  # letters only, as in \p{L}
        return [text]
    return _WORDS.findall(text)


class Vocabulary:
    """Ids, bytes and merge ranks of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.token[i] = s.encode() if s in self.special else bytes(byte[c] for c in s)
        for s, i in self.special.items():
            self.token[i] = s.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.texts = [str(i) for i in range(size)]
        self.unseen = self.merged
        try:  # the same merges in native code, if that library is there
            import tiktoken

            ranks = {self.token[i]: r for r, i in enumerate([*self.of_byte, *(new for _, new in self.merge.values())])}
            if len(ranks) == 256 + len(self.merge):
                core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
                back = [*self.of_byte, *(new for _, new in self.merge.values())]
                self.unseen = lambda word: [back[r] for r in core.encode_single_piece(word)]
        except (ImportError, AttributeError):
            pass

    def merged(self, word: bytes) -> list[int]:
        """Exact merges of one pre-token: the lowest rank first, leftmost on ties."""
        ids = [self.of_byte[b] for b in word]
        merge = self.merge
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:], strict=False):
                m = merge.get(pair)
                if m is not None and (best is None or m < best[0]):
                    best = (m, pair)
            if best is None:
                break
            (_, new), (a, b) = best
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ids[i] == a and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


# ------------------------------------------------------------------ the lexicon


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer over sorted words.

    States that accept the same endings are one. Each arc carries the number of words that sort before those below it,
    and the sum along a path is the word's number, which finds its ids. One flat buffer, made to be mapped.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, list[tuple[int, int]]]] = []
    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]  # the last word's states, not frozen yet

    def freeze(state: tuple[bool, list[tuple[int, int]]]) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(frozen)
            frozen.append((state[0], list(state[1])))
        return register[key]

    last = b""
    for w in [*words, None]:
        same = 0
        if w is not None:
            while same < min(len(w), len(last)) and w[same] == last[same]:
                same += 1
        while len(path) - 1 > same:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))
        if w is None:
            break
        path += [(False, []) for _ in range(len(w) - same)]
        path[-1] = (True, path[-1][1])
        last = w
    root = freeze(path[0])

    below = []
    for final, arcs in frozen:  # targets are frozen before their sources
        below.append(final + sum(below[t] for _, t in arcs))
    first = np.zeros(len(frozen) + 1, np.uint32)
    first[1:] = np.cumsum([len(a) for _, a in frozen])
    label = np.zeros(int(first[-1]), np.uint8)
    target, out = np.zeros(len(label), np.uint32), np.zeros(len(label), np.uint32)
    for s, (final, arcs) in enumerate(frozen):
        n = int(final)
        for k, (c, t) in enumerate(arcs):
            i = int(first[s]) + k
            label[i], target[i], out[i] = c, t, n
            n += below[t]
    final = np.array([f for f, _ in frozen], np.uint8)
    ids = [entries[w] for w in words]
    at = np.zeros(len(ids) + 1, np.uint32)
    at[1:] = np.cumsum([len(x) for x in ids])
    flat = np.array([i for x in ids for i in x], np.uint32)
    head = np.array([0x52484C58, len(frozen), len(label), len(ids), len(flat), root], np.uint32)
    return b"".join(x.tobytes() for x in (head, first, target, out, at, flat, final, label))


class Lexicon:
    """The compiled transducer over a mapped file (or any buffer)."""

    def __init__(self, buf):
        head = np.frombuffer(buf, np.uint32, 6)
        if head[0] != 0x52484C58:
            raise ValueError("not a lexicon")
        _, states, arcs, words, ids, self.root = map(int, head)
        self.n_words, self.n_states, self.n_arcs = words, states, arcs
        at = 24
        part = {}
        for name, n, kind in (("first", states + 1, np.uint32), ("target", arcs, np.uint32), ("out", arcs, np.uint32), ("at", words + 1, np.uint32), ("ids", ids, np.uint32), ("final", states, np.uint8), ("label", arcs, np.uint8)):
            part[name] = np.frombuffer(buf, kind, n, at)
            at += part[name].nbytes
        self.__dict__.update({k: memoryview(v) for k, v in part.items()})
        self.labels = part["label"].tobytes()

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Put the buffer in a file of this worker and map it; the name goes at once, the pages stay shared."""
        fd, name = tempfile.mkstemp()
        try:
            os.write(fd, data)
            m = mmap.mmap(fd, len(data), access=mmap.ACCESS_READ)
        finally:
            os.close(fd)
            os.unlink(name)
        return cls(m)

    def get(self, word: bytes) -> list[int] | None:
        s, n, first, labels = self.root, 0, self.first, self.labels
        for c in word:
            i = labels.find(c, first[s], first[s + 1])
            if i < 0:
                return None
            n += self.out[i]
            s = self.target[i]
        return self.ids[self.at[n] : self.at[n + 1]].tolist() if word and self.final[s] else None


class Memo:
    """Ids of the chunks seen so far, by the hash of a chunk: flat arrays of some 30 bytes a chunk, boundedly many.

    A chunk begins at a blank before something else than white space; which bytes may follow it is decided on the safe
    side, as a longer chunk gives the same ids. Texts that hold a special token go to `whole` by themselves.
    """

    def __init__(self, ask, whole, special: list[str], most: int = 1_500_000):
        self.ask, self.whole, self.most = ask, whole, most
        self.special = [s.encode() for s in special]
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]  # all but the latest, and the latest, sorted
        self.at = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.size = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.bits, self.start = 1, np.zeros(2, np.int32)  # where the keys of each range of hashes begin

    def place(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands, or would stand, among the keys but the latest: about one stands in each range."""
        keys = self.keys[0]
        i = self.start[h >> np.uint64(64 - self.bits)]
        left = np.flatnonzero((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] < h))
        while len(left):
            i[left] += 1
            left = left[i[left] < len(keys)]
            left = left[keys[i[left]] < h[left]]
        return i

    def put(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            more = np.zeros(2 * (self.used + len(ids)), np.uint32)
            more[: self.used] = self.flat[: self.used]
            self.flat = more
        self.flat[self.used : self.used + len(ids)] = ids
        at = (self.used + np.cumsum(size) - size).astype(np.int32)
        self.used += len(ids)

        def merge(k, keys, at, size):
            i = np.searchsorted(self.keys[k], keys)
            self.keys[k], self.at[k], self.size[k] = np.insert(self.keys[k], i, keys), np.insert(self.at[k], i, at), np.insert(self.size[k], i, size)

        merge(1, keys, at, size.astype(np.int32))
        if len(self.keys[1]) > 20_000 + len(self.keys[0]) // 8:
            merge(0, self.keys[1], self.at[1], self.size[1])
            self.keys[1], self.at[1], self.size[1] = (x[1][:0] for x in (self.keys, self.at, self.size))
            self.bits = max(1, len(self.keys[0]).bit_length())
            self.start = np.searchsorted(self.keys[0], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of ids) of each chunk; number -1 where it is not known."""
        at, size = np.zeros(len(h), np.int32), np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        for keys, a, n in zip(self.keys, self.at, self.size, strict=True):
            if len(keys) and len(left):
                i = self.place(h[left]) if keys is self.keys[0] else np.searchsorted(keys, h[left])
                i[i == len(keys)] = 0
                ok = keys[i] == h[left]
                at[left[ok]], size[left[ok]] = a[i[ok]], n[i[ok]]
                left = left[~ok]
        return at, size

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text) of UTF-8 texts at `offs`."""
        starts, ends, own = chunk_bounds(buf, offs)
        raw = buf.tobytes()
        odd = sorted({int(np.searchsorted(offs, m.start(), "right")) - 1 for s in self.special for m in re.finditer(re.escape(s), raw)})
        if odd:
            ok = ~np.isin(own, odd)
            starts, ends, own = starts[ok], ends[ok], own[ok]
        h = span_hashes(buf, starts, ends)
        if len(self.keys[0]) + len(self.keys[1]) > self.most or self.used > 8 * self.most:
            self.clear()
        at, size = self.find(h)
        new, row = np.unique(h[size < 0], return_index=True)
        if len(new):
            row = np.flatnonzero(size < 0)[row]
            order = np.argsort(starts[row])  # asked in the order of the texts
            ids, begin, n = self.ask([raw[a:z].decode() for a, z in zip(starts[row[order]].tolist(), ends[row[order]].tolist(), strict=True)])
            back = np.argsort(order)
            self.put(new, ids[gathered(begin[back], n[back])], n[back])
            miss = size < 0
            at[miss], size[miss] = self.find(h[miss])
        count = np.bincount(own, size, len(offs) - 1).astype(np.int64)
        ids = self.flat[gathered(at, size)]
        if odd:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in odd:
                parts[i] = self.whole(raw[offs[i] : offs[i + 1]].decode())
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, count


def gathered(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at[0], at[0] + 1 ... (size[0] of them), at[1] ... one after the other."""
    size = size.astype(np.int64)
    return np.repeat(at - np.cumsum(size) + size, size) + np.arange(size.sum())


#: Bytes that begin white space, or may do so, or are taken for it by some libraries: no cut before them.
_NO_CUT = np.zeros(256, bool)
_NO_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def chunk_bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the chunks of texts: cut at their starts and before blanks that a non-space follows."""
    cut = np.zeros(len(buf) + 1, bool)
    if len(buf) > 1:
        cut[: len(buf) - 1] = (buf[:-1] == 0x20) & ~_NO_CUT[buf[1:]]
    last = offs[1:][np.diff(offs) > 0] - 1
    cut[last] = False  # a text's last byte: what follows it is another text
    cut[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(cut[: len(buf)])
    return starts, np.append(starts[1:], len(buf)) if len(starts) else starts, np.searchsorted(offs, starts, "right") - 1


class Encoder:
    """Text to ids: lexicon first, exact merges for unseen words; chunks seen before are remembered, boundedly."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None, remember: int = 1_500_000):
        self.v, self.lex = vocab, lexicon
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.memo = Memo(self.ask, self.whole, list(vocab.special), remember)

    def ask(self, chunks_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each chunk's begin, how many they are)."""
        out, size = array("I"), []
        get, unseen = self.lex.get if self.lex is not None else (lambda _: None), self.v.unseen
        for c in chunks_:
            n = len(out)
            for w in pretokens(c):
                b = w.encode()
                ids = get(b)
                out.extend(unseen(b) if ids is None else ids)
            size.append(len(out) - n)
        n = np.array(size, np.int64)
        return np.array(out, np.uint32), np.cumsum(n) - n, n

    def whole(self, text: str) -> np.ndarray:
        """A text with special tokens, which are found before anything else is cut."""
        return np.concatenate([np.array([self.v.special[p]], np.uint32) if p in self.v.special else self.ask(chunks(p))[0] for p in self.special.split(text)])

    def encode(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        return self.memo.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.v.token.__getitem__, ids)).decode("utf-8", "replace")
