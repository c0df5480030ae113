"""Hierarchical packing of documents into windows of several context sizes.

Every document goes to the smallest tier (context size) that holds it; longer
ones give off full windows of the largest tier and their rest goes to a tier.
Tiers are packed from the longest down: the longest waiting piece of a tier
opens a window of it, and the gap is filled with two pieces that fit exactly
or with the longest that fit, of any tier; only where none fits one is cut,
its tail routed again.  What is left of a partition at its end, less than one
window, goes to windows of powers of two.  So every window is full: its length is the largest tier or a power of
two, and nothing is padded.

Windows of one tier are dealt to step groups of equal token count, in
serpentine order of their attention cost, so that the steps of a run take
about equally long.

Documents are packed where their input partition lies: no shuffle, and a task
holds one slice of texts and POOL_TOKENS of waiting pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skerry.llm.common import id_and_text, slices, with_id

TIERS = (128, 256, 512, 1024)
#: Tokens of a step group, and groups that are balanced against each other.
GROUP_TOKENS, GROUPS_DEALT = 8192, 8
#: Tokens that wait in a task for windows that they fit, the more the fewer documents are cut.
POOL_TOKENS = 64 * 1024


class Piece:
    """A run of one document's ids that waits for a place."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, length: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, self.ids[:length], self.total), Piece(self.doc, self.start + length, self.ids[length:], self.total)


class Pool:
    """Waiting pieces by length; bit n of ``mask`` is set if one of n ids waits."""

    def __init__(self) -> None:
        self.queues: dict[int, deque[Piece]] = {}
        self.mask = 0

    def add(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.queues.setdefault(n, deque()).append(piece)
        self.mask |= 1 << n

    def take(self, n: int) -> Piece:
        queue = self.queues[n]
        piece = queue.popleft()
        if not queue:
            self.mask ^= 1 << n
        return piece

    def longest(self, most: int) -> int:
        """The greatest waiting length up to ``most``, or 0."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1)

    def pair(self, gap: int) -> int:
        """The longer of two waiting lengths that fill ``gap`` together, or 0."""
        n = self.longest(gap - 1)
        while 2 * n >= gap:
            if self.mask >> (gap - n) & 1 and (2 * n > gap or len(self.queues[n]) > 1):
                return n
            n = self.longest(n - 1)
        return 0


class TierPacker:
    """Packs the pieces of one partition; ``rows`` holds what is ready to go out."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.whole, self.parts = Pool(), Pool()  # documents in one piece, and rests of others
        self.held = 0
        self.waiting: dict[int, list[list[Piece]]] = {}
        self.base, self.sequences, self.groups = partition << 32, 0, 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        """Routes one tokenised document."""
        top, piece = self.tiers[-1], Piece(doc, 0, ids, len(ids))
        while len(piece.ids) > top:
            head, piece = piece.cut(top)
            self._window(top, [head])
        self._route(piece)

    def _route(self, piece: Piece) -> None:
        (self.parts if piece.start else self.whole).add(piece)
        self.held += len(piece.ids)

    def _take(self, pool: Pool, n: int) -> Piece:
        self.held -= n
        return pool.take(n)

    def _fill(self, gap: int) -> Iterator[Piece]:
        """Pieces that fill a gap: one or two of just its length, else the longest that fits and on; a piece is cut
        only where none fits, and then the shortest rest of a document that is cut already, if there is one."""
        while gap:
            n = max(self.whole.longest(gap), self.parts.longest(gap))
            pool = self.parts if self.parts.mask >> n & 1 else self.whole
            if n and n < gap and (first := self.whole.pair(gap)):
                yield self._take(self.whole, first)
                yield self._take(self.whole, gap - first)
                return
            if n:
                yield self._take(pool, n)
                gap -= n
                continue
            pool = self.parts if self.parts.mask else self.whole
            piece = self._take(pool, (pool.mask & -pool.mask).bit_length() - 1)
            piece, tail = piece.cut(gap)
            self._route(tail)
            yield piece
            return

    def pack(self, last: bool = False) -> None:
        """Closes windows, those of the longest tier first, as long as enough is waiting to choose from; at last, all."""
        least = 0 if last else POOL_TOKENS
        for t, shorter in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while self.held >= max(t, least):
                n, m = self.whole.longest(t), self.parts.longest(t)
                if max(n, m) <= shorter:
                    break
                first = self._take(self.parts, m) if m >= n else self._take(self.whole, n)
                self._window(t, [first, *self._fill(t - len(first.ids))])
        while last and self.held:
            size = 1 << (self.held.bit_length() - 1)
            self._window(size, list(self._fill(size)))
        if last:
            for size in list(self.waiting):
                self._deal(size)

    def _window(self, size: int, pieces: list[Piece]) -> None:
        queue = self.waiting.setdefault(size, [])
        queue.append(pieces)
        if len(queue) >= GROUPS_DEALT * max(1, GROUP_TOKENS // size):
            self._deal(size)

    def _deal(self, size: int) -> None:
        """Serpentine by attention cost over as many step groups as are full or begun."""
        queue = sorted(self.waiting.pop(size), key=lambda w: -sum(len(p.ids) ** 2 for p in w))
        n = -(-len(queue) * size // GROUP_TOKENS)
        for k, window in enumerate(queue):
            turn, at = divmod(k, n)
            group = self.base + self.groups + (at if turn % 2 == 0 else n - 1 - at)
            offset = 0
            for p in window:
                crc = zlib.crc32(np.ascontiguousarray(p.ids, dtype="<u4"))
                self.rows.append((p.doc, p.start, len(p.ids), crc, p.total, self.base + self.sequences, offset, size, group))
                offset += len(p.ids)
            self.sequences += 1
        self.groups += n


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives one core to a task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def latin_encoder(path: str):
    """A faster encoder with the same ids for Latin text, and the names of added tokens, which it does not know.

    Only for a byte-level vocabulary with the usual pattern whose ids follow the order of its merges, so
    that an id is a rank; None for others."""
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, before = made["model"], made.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or made.get("normalizer"):
        return None, ()
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelling = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)).difference(printable)))}
    vocabulary = {name: k for name, k in model["vocab"].items() if set(name) <= spelling.keys()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    if order != sorted(set(order)):
        return None, ()
    special = {t["content"] for t in made.get("added_tokens", [])}
    ranks = {bytes(map(spelling.__getitem__, name)): k for name, k in vocabulary.items() if name not in special}
    return tiktoken.Encoding("latin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), tuple(special)


#: Texts of these characters only, of which both encoders know the classes, take the faster one.
LATIN = re.compile(r"[\t\n\r -~\xa1-\xac\xae-\u024f]*")


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of one whole text, those of the tokenizer's plain call (``add_special_tokens=False``)."""
    fast, added = latin_encoder(path)
    if fast and LATIN.fullmatch(text) and not any(name in text for name in added):
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.array(load_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4")


def pack_documents(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", separator: int = 0, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of all documents in full windows.

    Each text (null: empty) is tokenised whole and ends with ``separator``; each id lies in exactly one
    piece.  Returns one row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, tier`` (the window's length) ``, step_group``.  Repeated ids or rows are separate documents;
    ids may be null; other columns are ignored; an empty table gives no pieces.  Latin text takes a faster
    encoder with equal ids.
    """
    made = id_and_text(df, id_col, text_col).mapInPandas(
        functools.partial(_packed, path=tokenizer_path, separator=separator, tiers=tuple(tiers)),
        "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long",
    )
    return with_id(made, df, id_col)


def _packed(frames: Iterator[pd.DataFrame], path: str, separator: int, tiers: tuple[int, ...]) -> Iterator[pd.DataFrame]:
    packer = TierPacker(TaskContext.get().partitionId() if TaskContext.get() else 0, tiers)
    end = np.array([separator], "<u4")

    def ready() -> Iterator[pd.DataFrame]:
        rows, packer.rows = packer.rows, []
        if rows:
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"])

    for frame in slices(frames):
        for doc, text in zip(frame["id"].tolist(), frame["text"]):
            packer.add(doc, np.concatenate([token_ids(text, path), end]))
        packer.pack()
        yield from ready()
    packer.pack(last=True)
    yield from ready()
