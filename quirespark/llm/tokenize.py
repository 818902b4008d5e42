"""Problem 6: token ids of a byte-level BPE vocabulary.

Two tiers. A pre-token that is itself in the vocabulary, which holds for most, is resolved by a minimal perfect hash over
the vocabulary's byte strings: one displacement table, one slot a word, one comparison of the bytes. The others are
merged with a heap of adjacent pairs over a doubly linked list of bytes, O(n log n) in the length of the pre-token, so
a document that is one very long word is no trap.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash

TOKENIZERS = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges, as the vocabulary's publisher gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PerfectHash:
    """A minimal perfect hash over byte strings, by hash and displace.

    Keys fall into buckets by one half of a 64-bit hash; buckets are placed from the largest down, each with the first
    displacement that puts its keys into free slots. Of n keys each gets its own slot in 0 .. n - 1.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 3) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // load)
        self.shift = [0] * self.buckets
        own: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            own[(h >> 40) % self.buckets].append((h & 0xFFFFF, h >> 20 & 0xFFFFF, k))
        free, slots = [True] * n, [0] * n
        left: list[int] | None = None
        for b in sorted(range(self.buckets), key=lambda b: -len(own[b])):
            if len(own[b]) == 1:  # any free slot does
                left = left if left is not None else [i for i in range(n) if free[i]]
                low, _, k = own[b][0]
                slots[k] = left.pop()
                self.shift[b] = (slots[k] - low) % n
                continue
            d = 0
            while own[b]:  # the displacement is a factor of the step and an added shift in one number
                factor, added = divmod(d, n)
                at = [(low + factor * step + added) % n for low, step, _ in own[b]]
                if all(free[i] for i in at) and len({*at}) == len(at):
                    break
                d += 7919
            for i, (_, _, k) in zip(at if own[b] else (), own[b], strict=True):
                free[i], slots[k] = False, i
            self.shift[b] = d
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for key, value, slot in zip(keys, values, slots, strict=True):
            self.keys[slot], self.values[slot] = key, value

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 40) % self.buckets]
        at = ((h & 0xFFFFF) + d // self.n * (h >> 20 & 0xFFFFF) + d % self.n) % self.n
        return self.values[at] if self.keys[at] == key else -1


class BytePairEncoder:
    """cache: pre-tokens kept with their ids, at most so many in a worker."""

    def __init__(self, path: str, cache: int = 200_000) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.cache = cache
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: the pair of least rank first, of equal ranks the leftmost."""
        ranks, n = self.ranks, len(raw)
        part: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue  # one of the two was merged meanwhile
            part[i] = joined = left + part[j]
            part[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(joined + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(joined) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + joined)) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(joined)))
        return [ranks[p] for p in part if p is not None]

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.whole.get(raw)
        ids = (whole,) if whole >= 0 else tuple(self.merge(raw))
        if len(self.seen) >= self.cache:
            self.seen.clear()
        self.seen[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        get, ids = self.seen.get, []
        for piece in self.split(text):
            ids += get(piece) or self.piece(piece)
        return ids

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """One list of ids a text; an empty or null text gives an empty list."""
        ids = [self.encode(t) for t in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.fromiter((x for own in ids for x in own), np.int32, int(ends[-1]))
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> BytePairEncoder:
    return BytePairEncoder(os.path.join(folder, f"{name}.tiktoken"))
