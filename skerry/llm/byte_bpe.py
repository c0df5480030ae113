"""Byte-level BPE by rounds over padded numpy matrices.

All distinct pre-tokens of a slice are bucketed by length and padded into one
matrix per bucket.  Each round, every row merges its leftmost pair of minimum
rank; pairs are ranked by a hash table in arrays, merged rows close their gap,
and rows without a pair left go out of the matrix.  Rows longer than
``LONGEST_ROW`` bytes would need as many rounds as bytes; they are merged by a
heap instead, with the same result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from skerry.llm.common import ChunkCache, id_and_text, slices, with_id

LONGEST_ROW = 256
BUCKETS = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, LONGEST_ROW)
NONE = np.int32(2**31 - 1)
#: A space between two visible characters always begins a new match of the pattern.
INNER_SPACE = regex.compile(r"(?<=\S) (?=\S)")


class PairTable:
    """Open addressing over (left id, right id); a missing pair ranks ``NONE``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, self.steps = self._slot(key), 1
        waiting = np.arange(len(key))
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] == -1]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.ranks[slot[first]] = key[first], rank[first]
            waiting = waiting[self.keys[slot[waiting]] != key[waiting]]
            slot[waiting] = (slot[waiting] + 1) & (size - 1)
            self.steps += bool(len(waiting))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for _ in range(self.steps):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = open_[seen == key[open_]]
            out[hit] = self.ranks[slot[hit]]
            open_ = open_[(seen != key[open_]) & (seen != -1)]
        return out


class Encoder:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.names = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = [(ranks[w[:k]], ranks[w[k:]], r) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
        pairs = np.array(made, np.int64).reshape(-1, 3)
        self.pairs = PairTable(pairs[:, 0], pairs[:, 1], pairs[:, 2].astype(np.int32))
        self.pair_rank = {(a, b): r for a, b, r in made}

    def merged_rows(self, tokens: list[bytes]) -> list[np.ndarray]:
        """Ids of every pre-token, in order."""
        out: list[np.ndarray] = [None] * len(tokens)  # type: ignore[list-item]
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        low = -1
        for width in BUCKETS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for a in range(0, len(rows), 40_000):
                self._matrix(tokens, lengths, rows[a : a + 40_000], width, out)
        for k in np.flatnonzero(lengths > LONGEST_ROW):
            out[k] = self._heap(tokens[k])
        return out

    def _matrix(self, tokens, lengths, rows, width, out) -> None:
        if not len(rows):
            return
        flat = b"".join(tokens[k].ljust(width, b"\0") for k in rows)
        ids = self.single[np.frombuffer(flat, np.uint8).reshape(len(rows), width)]
        left = lengths[rows].copy()
        ids[np.arange(width)[None, :] >= left[:, None]] = -1
        rank = np.full((len(rows), width), NONE, np.int32)
        if width > 1:
            rank[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
            rank[np.arange(width)[None, :] >= left[:, None] - 1] = NONE
        while len(rows):
            at = rank.argmin(1)  # the leftmost of equal ranks
            every = np.arange(len(rows))
            best = rank[every, at]
            done = best == NONE
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : left[k]].copy()
            if done.any():  # compaction: ended rows leave the matrix, then columns that no row needs
                keep = ~done
                rows, left, at, best = rows[keep], left[keep], at[keep], best[keep]
                if not len(rows):
                    return
                need = int(left.max())
                ids, rank, every = ids[keep, :need], rank[keep, :need], np.arange(len(rows))
            source = np.minimum(np.arange(ids.shape[1])[None, :] + (np.arange(ids.shape[1])[None, :] > at[:, None]), ids.shape[1] - 1)
            last = ids.shape[1] - 1
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[:, last], rank[:, last] = -1, NONE
            ids[every, at] = best
            left = left - 1
            rank[every, at] = NONE
            after = every[at + 1 < left]
            rank[after, at[after]] = self.pairs.find(ids[after, at[after]], ids[after, at[after] + 1])
            before = every[at > 0]
            rank[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])

    def _heap(self, token: bytes) -> np.ndarray:
        """The same merges for one very long pre-token, by a heap over a linked list."""
        ids = [int(self.single[b]) for b in token]
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_rank.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (s := self.pair_rank.get((r, ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[nxt[i]]))
            if prv[i] >= 0 and (s := self.pair_rank.get((ids[prv[i]], r))) is not None:
                heapq.heappush(heap, (s, prv[i], ids[prv[i]], r))
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of texts that begin and end at matches' borders."""
        found = [[m.encode("utf-8", "replace") for m in self.pattern.findall(c)] for c in chunks]
        distinct = list({t for f in found for t in f})
        ids = dict(zip(distinct, (x.astype("<u4").tobytes() for x in self.merged_rows(distinct))))
        return [b"".join([ids[t] for t in f]) for f in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.names.__getitem__, ids.tolist()))


def border_chunks(text: str) -> list[str]:
    """The text cut before single spaces where a match always begins; the space is left out.

    Without double spaces that is every space; elsewhere only one between visible characters."""
    return INNER_SPACE.split(text) if "  " in text else text.split(" ")


def chunk_table(head: dict, rest: dict, split: list[list[str]], encode) -> None:
    """Adds to both caches what a slice's texts need: first chunks stand alone, the others after a space."""
    new = list({s[0] for s in split}.difference(head))
    head.room(new)
    head.update(zip(new := list({s[0] for s in split}.difference(head)), encode(new)))
    wanted = {c for s in split for c in s[1:]}
    rest.room(list(wanted.difference(rest)))
    new = list(wanted.difference(rest))
    rest.update(zip(new, encode([f" {c}" for c in new])))


@functools.lru_cache(maxsize=2)
def load_encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Encoder(ranks, pattern)


def bpe_ids(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text (null: empty) and the bytes they decode to.

    Returns ``id_col, n_tokens, ids, decoded``; ``ids`` holds little-endian unsigned 32-bit ids.  One
    output row for every input row, repeated ids included; other columns are ignored; an empty table
    gives an empty result.  The work is narrow: no shuffle, and a task holds one slice of texts and two
    bounded caches.
    """
    made = id_and_text(df, id_col, text_col).mapInPandas(functools.partial(_encoded, path=path, pattern=pattern, digest=False), "id string, n_tokens long, ids binary, decoded binary")
    return with_id(made, df, id_col)


def bpe_digests(df: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``bpe_ids``, with SHA-256 of the ids and of the decoded bytes in place of both."""
    made = id_and_text(df, id_col, text_col).mapInPandas(functools.partial(_encoded, path=path, pattern=pattern, digest=True), "id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return with_id(made, df, id_col)


def _encoded(frames: Iterator[pd.DataFrame], path: str, pattern: str, digest: bool) -> Iterator[pd.DataFrame]:
    encoder = load_encoder(path, pattern)
    head, rest = ChunkCache(2_000_000), ChunkCache()
    for frame in slices(frames):
        split = [border_chunks(t) for t in frame["text"]]
        chunk_table(head, rest, split, encoder.chunk_ids)
        count, ids, decoded = [], [], []
        for s in split:
            raw = b"".join([head[s[0]], *map(rest.__getitem__, s[1:])])
            text = encoder.decode(np.frombuffer(raw, "<u4"))
            count.append(len(raw) // 4)
            ids.append(hashlib.sha256(raw).hexdigest() if digest else raw)
            decoded.append(hashlib.sha256(text).hexdigest() if digest else text)
        names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
        yield pd.DataFrame({"id": frame["id"].to_numpy(), "n_tokens": count, names[0]: ids, names[1]: decoded})
