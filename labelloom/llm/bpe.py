"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

The distinct words of a block of texts become one array of byte symbols with links to the next and the previous symbol
of the same word; the ids of each word are then gathered for all its occurrences.
The pair occurrence index maps each mergeable pair, by its rank, to all its positions in the block. Active ranks are
taken in ascending order; each merges all its positions at once and files the pairs that arise under their own, always
higher, ranks. A block is closed once it holds BLOCK_BYTES; a longer text is a block of its own and encoded whole.

Defined results: null and empty texts give an empty list; blank texts are encoded as they are; strings that look like
special tokens are ordinary text; a null id gives no row; each row of the input gives one row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import spread

#: UTF-8 bytes encoded at once, which bounds a worker's memory.
BLOCK_BYTES = 3_000_000
#: Folder of the tokenizer files; None asks the installed vocabulary package.
TOKENIZER_DIR: str | None = None

#: Fixed value: the vocabulary's pattern of words.
WORDS = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a vocabulary file on this machine."""
    folder = folder or TOKENIZER_DIR
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteBpe:
    """Ranks and ids of one vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.of_byte = np.zeros(256, np.int32)
        for ch, b in _byte_letters().items():
            self.of_byte[b] = vocab[ch]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.left = (keys >> 32).astype(np.int32)
        self.right = (keys & 0xFFFFFFFF).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 where it does not merge."""
        key = (a.astype(np.int64) << 32) | b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.rank_of_key[k], -1)

    def encode_block(self, raw: np.ndarray, word_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, place of each id's first byte) of the bytes ``raw``, whose words end before ``word_ends``."""
        n = len(raw)
        if not n:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        sym = self.of_byte[raw]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[word_ends - 1] = -1
        starts = word_ends[:-1]
        prv[starts[starts < n]] = -1
        prv[0] = -1
        # the index: rank -> arrays of positions; heap: the active ranks
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(pos: np.ndarray) -> None:
            r = self.ranks(sym[pos], sym[nxt[pos]])
            keep = r >= 0
            if not keep.any():
                return
            pos, r = pos[keep], r[keep]
            if len(pos) > 1:
                order = np.argsort(r, kind="stable")
                pos, r = pos[order], r[order]
                cuts = np.flatnonzero(np.diff(r)) + 1
                parts = np.split(pos, cuts) if len(cuts) else [pos]
                heads = r[np.concatenate(([0], cuts))] if len(cuts) else r[:1]
            else:
                parts, heads = [pos], r
            for h, p in zip(heads.tolist(), parts):
                if h in index:
                    index[h].append(p)
                else:
                    index[h] = [p]
                    heappush(heap, h)

        file(np.flatnonzero(nxt >= 0).astype(np.int32))
        while heap:
            rank = heappop(heap)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            right = nxt[pos]
            ok = (sym[pos] == a) & (right >= 0)
            pos, right = pos[ok], right[ok]
            ok = sym[right] == b
            pos, right = pos[ok], right[ok]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # runs of the same symbol merge from the left, without overlap
                pos = np.sort(pos)
                right = nxt[pos]
                chained = np.concatenate(([False], right[:-1] == pos[1:]))
                at = np.arange(len(pos))
                head = np.maximum.accumulate(np.where(chained, 0, at))
                take = (at - head) % 2 == 0
                pos, right = pos[take], right[take]
            after = nxt[right]
            sym[pos] = self.made[rank]
            sym[right] = -1
            nxt[pos] = after
            linked = after >= 0
            prv[after[linked]] = pos[linked]
            before = prv[pos]
            # an after that was itself merged away this round is the next pair's left symbol, so links stay whole
            again = np.concatenate((before[before >= 0], pos[linked]))
            if len(again):
                again = np.unique(again)
                again = again[(sym[again] >= 0) & (nxt[again] >= 0)]
                if len(again):
                    file(again)
        left = np.flatnonzero(sym >= 0)
        return sym[left], left

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; each distinct word of the block is encoded once."""
        found = [WORDS.findall(t) if t else () for t in texts]
        place = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        if not place:
            return [np.empty(0, np.int32) for _ in texts]
        sizes = np.fromiter((len(w) for w in place), np.int64, len(place))
        raw = np.frombuffer("".join(place).encode("utf-8", "replace"), np.uint8)
        first_byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of each character
        ends = first_byte[np.cumsum(sizes)]
        ids, at = self.encode_block(raw, ends)
        begin = np.searchsorted(at, np.concatenate(([0], ends)))  # of each distinct word's ids
        many = np.diff(begin)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        words = np.fromiter(map(place.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        n = many[words]
        to = np.cumsum(n)
        flat = ids[np.repeat(begin[words] - (to - n), n) + np.arange(int(to[-1]))]
        bounds = np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(counts)))]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


_LOADED: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """One vocabulary per worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.json", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text by the vocabulary, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer_path(vocabulary, folder))
        for b in batches:
            texts = b.column(1).to_pylist()
            sizes = [len(t) if t else 0 for t in texts]
            at = 0
            while at < b.num_rows:
                to, held = at, 0
                while to < b.num_rows and (to == at or held + 3 * sizes[to] <= BLOCK_BYTES):
                    held += 3 * sizes[to]
                    to += 1
                part = b.slice(at, to - at)
                ids = bpe.encode(texts[at:to])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))],
                    names=[key, "ids"],
                )
                at = to

    kind = df.schema[key].dataType.simpleString()
    return spread(df.where(F.col(key).isNotNull()).select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")
