"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .kernels import chunks, code_points, span_hash
from .tokenizers import DEFAULT_VOCABULARY, PATTERN, ranks
from .work import pruned


def merged_count(piece: bytes, rank: dict[bytes, int]) -> int:
    """Initial symbols (bytes) less merges: the lowest-rank adjacent pair is popped again and again, leftmost first."""
    n = len(piece)
    if n < 2:
        return n
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # where the symbol that begins at i ends; 0 once it is merged away
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, to = heapq.heappop(heap)
        j = nxt[i] if end[i] else n
        if not end[i] or j >= n or end[j] != to:  # one of the two symbols has changed since
            continue
        merges += 1
        end[i], end[j] = to, 0
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := rank.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if (p := prv[i]) >= 0 and (r := rank.get(piece[p:to])) is not None:
            heapq.heappush(heap, (r, p, to))
    return n - merges


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@functools.cache
def _classes() -> np.ndarray:
    """The pattern's class of each code point, asked of the regex library itself."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for kind, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(p, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a : b + 1] = kind
            else:  # a run across the surrogates
                out[[ord(c) for c in m[0]]] = kind
    return out


def pre_tokens(cp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pattern's matches begin, and the text of each, for texts that begin at at[:-1]; the matches leave no gap."""
    n = len(cp)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[at] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    start = change.copy()
    space = kind == SPACE
    # The last white space before something else leaves its run: a match of its own, or the head of what follows if it is ' '.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= last
    blank = last & (cp == 32)
    head = np.zeros(n, bool)
    head[1:] = blank[:-1]  # begins in the ' ' before it
    start &= ~head
    # 's 't 're 've 'm 'll 'd, where a match begins at the apostrophe
    quotes = np.flatnonzero((cp == 39) & change & ~head)
    if len(quotes):
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        a, b = pad[quotes + 1], pad[quotes + 2]
        one = ~edge[quotes + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~edge[quotes + 1] & ~edge[quotes + 2] & (((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108)))
        for take, size in ((one, 2), (two, 3)):
            q = quotes[take]
            start[q + 1] = False
            after = q + size
            after = after[after < n]
            # what follows begins a match, unless a ' ' or a run's last space had been settled there already
            start[after] |= ~head[after]
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(at, starts, side="right") - 1


class Counter:
    """Counts of pre-tokens met so far, by 64-bit hash; each is merged once. Emptied when large, which only costs time."""

    MOST = 2_000_000

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.known, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        cp, at = code_points(texts)
        if not len(cp):
            return np.zeros(len(texts), np.int64)
        starts, doc = pre_tokens(cp, at)
        ends = np.append(starts[1:], len(cp))
        h = span_hash(cp, starts, ends)
        order = np.argsort(h)
        sorted_h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = sorted_h[1:] != sorted_h[:-1]
        own, where = sorted_h[new], order[new]
        if len(self.known) > self.MOST:
            self.known, self.count = self.known[:0], self.count[:0]
        i = np.searchsorted(self.known, own)
        i[i == len(self.known)] = 0
        have = self.known[i] == own if len(self.known) else np.zeros(len(own), bool)
        counts = np.zeros(len(own), np.int64)
        counts[have] = self.count[i[have]]
        miss = np.flatnonzero(~have)
        if len(miss):
            rank, a, b = self.rank, starts[where[miss]], ends[where[miss]]
            counts[miss] = [merged_count(cp[s:e].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), rank) for s, e in zip(a.tolist(), b.tolist(), strict=True)]
            known = np.concatenate([self.known, own[miss]])
            by = np.argsort(known, kind="stable")
            self.known, self.count = known[by], np.concatenate([self.count, counts[miss]])[by]
        each = np.empty(len(h), np.int64)
        each[order] = counts[np.cumsum(new) - 1]
        return np.bincount(doc, weights=each, minlength=len(texts)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs(doc_id, text): tokens that the byte-level BPE vocabulary makes of it.

    Null and empty texts have 0 tokens; a null doc_id stays null; repeated rows are counted one by one; other
    columns are not read. A narrow pass without a shuffle: each worker merges a distinct pre-token once and keeps its count.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.setdefault(vocabulary, Counter(vocabulary))
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for i in range(0, b.num_rows, 512):
                for j, part in chunks(b.column(1).slice(i, 512).to_pylist()):
                    n[i + j : i + j + len(part)] = counter.of(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    return pruned(docs, "doc_id", "text").mapInArrow(count, "doc_id bigint, n_tokens bigint")


__all__ = ["PATTERN", "Counter", "merged_count", "pre_tokens", "token_counts"]
