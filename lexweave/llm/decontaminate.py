"""Benchmark decontamination: an FM-index per shard of training text, searched for the test phrases."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import Words, chunks
from .work import new_path, places, pruned, through

PHRASE_WORDS = 8
LEAST_WORDS = 5
SHARD_CHARS = 1 << 21
SAMPLE = 16
#: Phrases loaded at a time; more are searched for in further rounds over the same texts, each with an index over the
#: words of its own phrases.
PART_PHRASES = 1 << 20


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        k = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.words[k] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class Wavelet:
    """A wavelet matrix: rank of a symbol, and symbol with rank at a place, in one step a bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        s = symbols
        for shift in range(bits - 1, -1, -1):
            one = (s >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(one), int(len(s) - np.count_nonzero(one))))
            s = np.concatenate([s[~one], s[one]])
        every = np.arange(1 << bits)
        self.first = self._walk(every, np.zeros(1 << bits, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, b, zeros in self.levels:
            ones = b.rank(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(c, i) - self.first[c]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        c = np.zeros(len(i), np.int64)
        for shift, b, zeros in self.levels:
            one, ones = b.get(i), b.rank(i)
            c |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self.first[c]


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Positions of s in the order of their suffixes. 0 is a separator: each is less than any symbol and than the
    separators after it, so a comparison ends there; the last symbol has to be one."""
    n = len(s)
    place = max(1, int(n - 1).bit_length())
    m = max(1, (63 - place) // bits)
    zero, rest = np.flatnonzero(s == 0), np.flatnonzero(s)
    padded = np.concatenate([s, np.zeros(m, s.dtype)]).astype(np.uint64)
    key, alive = np.zeros(len(rest), np.uint64), np.ones(len(rest), bool)
    for j in range(m):
        c = padded[rest + j]
        alive &= c > 0
        key = key << np.uint64(bits) | np.where(alive, c, np.uint64(0))
    key = key << np.uint64(1) | alive.astype(np.uint64)
    key = np.sort(key << np.uint64(place) | rest.astype(np.uint64)) if bits * m + 1 + place <= 64 else None
    assert key is not None
    order = (key & np.uint64((1 << place) - 1)).astype(np.int64)
    key >>= np.uint64(place)
    sa = np.concatenate([zero, order])
    rank = np.empty(n, np.int64)
    rank[zero] = np.arange(len(zero))
    rows = np.arange(len(zero), n)
    # Suffixes that agree so far, without a separator among what was compared, share the rank of their first row.
    new = np.ones(len(rest), bool)
    new[1:] = (key[1:] != key[:-1]) | (key[1:] & np.uint64(1) == 0)
    h, pos = m, order
    while len(rows):
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[pos] = rows[starts][group]
        size = np.diff(np.append(starts, len(rows)))
        open_ = size[group] > 1
        rows, pos = rows[open_], pos[open_]
        if not len(rows):
            break
        key = (rank[pos] << 32 | rank[pos + h]).astype(np.uint64)
        by = np.argsort(key)
        key, pos = key[by], pos[by]
        sa[rows] = pos
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        h *= 2
    return sa


class FMIndex:
    """Of word symbols (0: any word outside the phrases' vocabulary, and the end of each text)."""

    def __init__(self, s: np.ndarray, bits: int, sample: int = SAMPLE):
        sa = suffix_array(s, bits)
        before = np.where(sa > 0, s[sa - 1], 0)
        self.wavelet = Wavelet(before, bits)
        self.less = np.zeros((1 << bits) + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=1 << bits), out=self.less[1:])
        kept = (sa % sample == 0) | (before == 0)
        self.kept, self.samples = Bits(kept), sa[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search for the rows of `phrases` (symbols): those that occur, and their ranges of suffixes."""
        which = np.arange(len(phrases))
        c = phrases[:, -1]
        lo, hi = self.less[c], self.less[c + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            if not len(which):
                break
            c = phrases[which, j]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
            lo, hi = self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]
        live = lo < hi
        return which[live], lo[live], hi[live]

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Positions of all suffixes in the ranges, range by range."""
        size = hi - lo
        row = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        out, steps, todo = np.empty(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            done = self.kept.get(row)
            out[todo[done]] = self.samples[self.kept.rank(row[done])] + steps
            todo, row = todo[~done], row[~done]
            c, k = self.wavelet.at(row)
            row = self.less[c] + k
            steps += 1
        return out


def phrase_parts(bench: Iterable[str | None], k: int = PHRASE_WORDS, least: int = LEAST_WORDS, part: int = PART_PHRASES) -> Iterator[dict[int, np.ndarray]]:
    """Distinct phrases as rows of word hashes, by length: every run of k words of an item, or all of an item that has
    from `least` to k - 1 words."""
    have: dict[int, list[np.ndarray]] = {}
    n = 0

    def flush() -> dict[int, np.ndarray]:
        return {size: np.unique(np.concatenate(v), axis=0) for size, v in have.items()}

    for _, texts in chunks(list(bench)):
        w = Words(texts)
        for i in range(len(texts)):
            h = w.hash[w.at[i] : w.at[i + 1]]
            size = min(k, len(h))
            if size < least:
                continue
            have.setdefault(size, []).append(np.lib.stride_tricks.sliding_window_view(h, size).copy())
            n += len(h) - size + 1
            if n >= part:
                yield flush()
                have, n = {}, 0
    if n:
        yield flush()


def spans(texts: list[str], parts: Iterable[dict[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged removal spans of the texts, one FM-index over all of them: text, first and end code point within it."""
    w = Words(texts)
    found: list[np.ndarray] = []
    for phrases in parts:
        vocabulary = np.unique(np.concatenate([p.ravel() for p in phrases.values()]))
        i = np.searchsorted(vocabulary, w.hash)
        i[i == len(vocabulary)] = 0
        s = np.zeros(len(w.hash) + len(texts), np.int32)
        s[np.arange(len(w.hash)) + w.doc] = np.where(vocabulary[i] == w.hash, i + 1, 0)
        index = FMIndex(s, int(len(vocabulary)).bit_length())
        ends = w.at[1:] + np.arange(len(texts))  # of each text in s
        for size, p in phrases.items():
            _, lo, hi = index.search(np.searchsorted(vocabulary, p) + 1)
            pos = index.locate(lo, hi)
            doc = np.searchsorted(ends, pos)
            word = pos - doc
            found.append(np.stack([doc, w.starts[word], w.ends[word + size - 1]]))
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    every = every[:, np.lexsort((every[2], every[1]))]
    if not every.shape[1]:
        return every[0], every[1], every[2]
    doc, a, b = every
    reach = np.maximum.accumulate(b)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] > reach[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    base = w.text_at[doc[first]]
    return doc[first], a[first] - base, np.maximum.reduceat(b, first) - base


_PARTS: dict[str, list[dict[int, np.ndarray]]] = {}


class Phrases:
    """The phrases as files of the shared folder, loaded a part at a time by the workers."""

    def __init__(self, bench: DataFrame, k: int, least: int):
        from pyarrow import fs

        self.uri = new_path(bench.sparkSession, "phrases")
        store, root = fs.FileSystem.from_uri(self.uri)
        store.create_dir(root, recursive=True)
        texts = (r[0] for r in pruned(bench, "text").where("text IS NOT NULL").toLocalIterator())
        self.n = 0
        for phrases in phrase_parts(texts, k, least):
            buffer = io.BytesIO()
            np.savez(buffer, **{str(size): p for size, p in phrases.items()})
            with store.open_output_stream(f"{root}/{self.n}.npz") as f:
                f.write(buffer.getvalue())
            self.n += 1

    def parts(self) -> Iterator[dict[int, np.ndarray]]:
        from pyarrow import fs

        if self.uri in _PARTS:
            yield from _PARTS[self.uri]
            return
        store, root = fs.FileSystem.from_uri(self.uri)
        for i in range(self.n):
            with store.open_input_stream(f"{root}/{i}.npz") as f, np.load(io.BytesIO(f.read())) as z:
                part = {int(size): z[size] for size in z.files}
            if self.n == 1:  # stays with the worker
                _PARTS.clear()
                _PARTS[self.uri] = [part]
            yield part


def contaminated_spans(docs: DataFrame, bench: DataFrame, k: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, span_start, span_end) in code points: merged spans of docs(doc_id, text) that repeat benchmark text.

    A phrase is a run of k words of an item of bench(text); an item of `least` to k - 1 words is one phrase, a shorter
    one is none. Words are runs of letters, digits and marks in lower case, so case, punctuation and white space don't
    matter. Occurrences that touch or overlap are one span. Documents without any give no row; so do null and empty
    texts. A null doc_id stays null; repeated rows give their spans each; no benchmark gives no rows. Other columns
    are not read. No shuffle: each shard of about 2 M code points has its own FM-index where it is read.
    """
    phrases = Phrases(bench, k, least)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in _shards(b.column(1)):
                doc, a, e = spans(part, phrases.parts()) if phrases.n else (np.zeros(0, np.int64),) * 3
                if len(doc):
                    ids = b.column(0).take(pa.array(doc + i))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(a.astype(np.int32)), pa.array(e.astype(np.int32))], names=["doc_id", "span_start", "span_end"])

    return pruned(docs, "doc_id", "text").mapInArrow(find, "doc_id bigint, span_start int, span_end int")


def _shards(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about SHARD_CHARS together; a batch is taken piece by piece, so that few are Python's at once."""
    for i in range(0, len(column), 1024):
        for j, part in chunks(column.slice(i, 1024).to_pylist(), SHARD_CHARS):
            yield i + j, part


def decontaminate(docs: DataFrame, bench: DataFrame, k: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """docs with the spans of `contaminated_spans` cut out of text (and n_chars, where there is one, counted again).

    All rows and columns stay, in one pass without a shuffle. Texts without a span, null and empty ones are unchanged.
    """
    phrases = Phrases(bench, k, least)
    names = docs.columns
    at = places(docs, "text")[0]
    counted = names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new: list[pa.Array] = []
            for i, part in _shards(b.column(at)):
                doc, a, e = spans(part, phrases.parts()) if phrases.n else (np.zeros(0, np.int64),) * 3
                own = b.column(at).slice(i, len(part))
                if len(doc):
                    texts = own.to_pylist()
                    for d, x, y in zip(doc[::-1].tolist(), a[::-1].tolist(), e[::-1].tolist(), strict=True):
                        texts[d] = texts[d][:x] + texts[d][y:]
                    own = pa.array(texts, own.type)
                new.append(own)
            columns = list(b.columns)
            columns[at] = pa.concat_arrays(new) if new else b.column(at)
            if counted is not None:
                was = columns[counted]
                columns[counted] = pc.coalesce(pc.utf8_length(columns[at]).cast(was.type), was)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return through(docs, cut)
