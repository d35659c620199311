"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, weighted votes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Words, chunks, release
from .work import drop, places, pruned, saved, through

#: Labelled rows that are fitted at most: the ones with the least hash of their doc_id.
MAX_EXAMPLES = 12_000
NEIGHBOURS = 15
BLOCK = 64
#: A term that one in so many examples holds has a full row of weights (zeros too) instead of postings.
FULL = 16
#: Blocks that are scored before the k-th best cosine rules others out; texts whose full rows are multiplied at once.
FIRST_BLOCKS, GROUP = 6, 64
#: Postings of a term up to which they are read at once, without largest weights by block.
FEW = 8
#: Blocks are scored by their own postings if they are fewer than one in so many; else reading whole lists is faster.
SPARSE = 16
#: Cosines count as equal if they agree to so many places.
PLACES = 5
SCORE = 0.5
#: How much a term's inverse document frequency is raised by the label, and with how many examples at the overall rate its
#: rate of toxic examples is evened out.
EMPHASIS, EVEN = 2.0, 20.0


def term_counts(texts: list[str], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of each text's words, in order of text and term: terms are indices into the vocabulary of
    sorted hashes (other words don't count), or without one the hashes themselves."""
    w = Words(texts)
    if not len(w.hash) or vocabulary is not None and not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, back = np.unique(w.hash, return_inverse=True)
    doc = w.doc
    if vocabulary is not None:
        i = np.searchsorted(vocabulary, own)
        i[i == len(vocabulary)] = 0
        i = np.where(vocabulary[i] == own, i, -1)[back]
        doc, back, own = doc[i >= 0], i[i >= 0], np.arange(len(vocabulary))
    key, times = np.unique(doc * len(own) + back, return_counts=True)
    return key // len(own), own[key % len(own)], times


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two small floats in one number each: what is read together lies together."""
    out = np.empty((len(a), 2), np.float32)
    out[:, 0], out[:, 1] = a, b
    return out.view(np.uint64).ravel()


def _joined(pairs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of pairs[start[0] : end[0]], pairs[start[1] : end[1]], ..., the first as an integer."""
    return _apart(np.concatenate([pairs[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]) if len(start) else pairs[:0])


def _apart(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = pairs.view(np.float32).reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1]


def _alike(rows: np.ndarray, size: np.ndarray, axes: int = 4) -> np.ndarray:
    """An order of the columns of `rows` that puts like ones together: halves along the main axes, then by size."""
    n = rows.shape[1]
    if min(rows.shape) < axes or n < 4 * BLOCK:
        return np.argsort(size, kind="stable")
    even = rows - rows.mean(axis=1, keepdims=True)
    v = np.random.default_rng(0).normal(size=(len(rows), axes)).astype(np.float32)
    for _ in range(8):
        v = np.linalg.qr(even @ (even.T @ v))[0]
    place = even.T @ v
    groups = [np.arange(n)]
    for k in range(axes):
        groups = [h for g in groups for h in np.array_split(g[np.argsort(place[g, k], kind="stable")], 2)]
    return np.concatenate([g[np.argsort(size[g], kind="stable")] for g in groups])


class BlockMaxIndex:
    """Examples (like ones together) in blocks of BLOCK; of each term its postings by block and the largest weight in each block.

    A search bounds each block by the sum of its terms' largest products, scores the blocks of the highest bounds, and then
    all others whose bound reaches the k-th best cosine so far: the result is exact. Terms that many examples hold are
    multiplied for all of them at once, and those with FEW postings need no largest weights; both count exactly in a bound.
    Ties go to the example that comes first.
    """

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int):
        self.ids, self.toxic, self.n = ids, toxic, len(ids)
        self.blocks = -(-self.n // BLOCK)
        held = np.bincount(term, minlength=terms)
        # Frequent terms first: what many searches read lies together.
        order = np.argsort(-held, kind="stable")
        self.rank = np.empty(terms, np.int32)
        self.rank[order] = np.arange(terms)
        held = held[order]
        term = self.rank[term]
        full = int(np.searchsorted(-held * FULL, -self.n, side="left"))  # these come first
        rows = np.zeros((full, self.n), np.float32)
        own = term < full
        rows[term[own], example[own]] = weight[own]
        self.number = _alike(rows, np.bincount(example, minlength=self.n))  # of the example at each place
        self.place = np.empty(self.n, np.int32)
        self.place[self.number] = np.arange(self.n)
        self.full = rows[:, self.number]
        del rows
        term, example, weight = term[~own], self.place[example[~own]], weight[~own]
        order = np.argsort(term.astype(np.int64) * max(1, self.n) + example)
        term, example, weight = term[order], example[order], weight[order]
        del order, own
        self.posting = _paired(example, weight)  # place, weight
        self.posting_at = np.searchsorted(term, np.arange(terms + 1)).astype(np.int32)
        block = example // BLOCK
        first = np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])) if len(term) else np.zeros(0, bool)
        first = np.flatnonzero(first & (np.diff(self.posting_at)[term] > FEW)).astype(np.int32)
        stop = np.minimum(np.append(first[1:], len(term)), self.posting_at[term[first] + 1])[: len(first)] if len(first) else first
        self.run = np.stack([first, stop], axis=1).astype(np.int32)
        most = np.zeros(len(first), np.float32)
        np.maximum.at(most, np.repeat(np.arange(len(first)), stop - first), weight[_runs(first, stop - first)])
        self.entry = _paired(block[first], most)
        self.entry_at = np.searchsorted(term[first], np.arange(terms + 1)).astype(np.int32)

    def search(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n texts (doc ascending) numbers and cosines of the k nearest of positive cosine, best first;
        `without`: an example for each text to leave out."""
        at = np.searchsorted(doc, np.arange(n + 1))
        term, weight = self.rank[term], weight.astype(np.float32)
        for g in range(0, n, GROUP):
            end = min(n, g + GROUP)
            a, b = at[g], at[end]
            own = term[a:b] < len(self.full)
            q = np.zeros((end - g, len(self.full)), np.float32)
            q[doc[a:b][own] - g, term[a:b][own]] = weight[a:b][own]
            base = q @ self.full
            for d in range(g, end):
                own = slice(at[d], at[d + 1])
                rare = term[own] >= len(self.full)
                yield self._nearest(base[d - g], term[own][rare], weight[own][rare], k, -1 if without is None else int(self.place[without[d]]))

    def _nearest(self, base: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        start, end = self.posting_at[term], self.posting_at[term + 1]
        few = end - start <= FEW
        base = base + self._summed(start[few], end[few], weight[few])
        term, weight = term[~few], weight[~few]
        start, end = self.entry_at[term], self.entry_at[term + 1]
        block, most = _joined(self.entry, start, end)
        bound = np.maximum.reduceat(base, np.arange(0, self.n, BLOCK)) + np.bincount(block, weights=most * np.repeat(weight, end - start), minlength=self.blocks)
        chosen = np.zeros(self.blocks, bool)
        chosen[np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1)[:FIRST_BLOCKS]] = True
        own = (base, term, block, weight, k, without)
        best, cos = self._scored(chosen, *own)
        least = cos[k - 1] - 10.0**-PLACES if len(cos) >= k else 0.0
        more = ~chosen & (bound > 0) & (bound >= least)
        if more.any():
            others = self._scored(more, *own)
            best, cos = np.concatenate([best, others[0]]), np.concatenate([cos, others[1]])
            order = np.lexsort((best, -cos))[:k]
            best, cos = best[order], cos[order]
        return best, cos

    def _summed(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What whole lists add to each example."""
        place, own = _joined(self.posting, start, end)
        return np.bincount(place, weights=own * np.repeat(weight, end - start), minlength=self.n)

    def _scored(self, blocks: np.ndarray, base: np.ndarray, term: np.ndarray, block: np.ndarray, weight: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of some blocks."""
        which = np.flatnonzero(np.repeat(blocks, BLOCK)[: self.n])
        if SPARSE * np.count_nonzero(blocks) < self.blocks:  # their own postings
            size = self.entry_at[term + 1] - self.entry_at[term]
            pick = np.flatnonzero(blocks[block])
            of = np.searchsorted(np.cumsum(size), pick, side="right")
            run = self.run[pick + (self.entry_at[term] - np.cumsum(size) + size)[of]]
            size = run[:, 1] - run[:, 0]
            place, own = _apart(self.posting[_runs(run[:, 0], size)])
            added = np.bincount(place, weights=own * np.repeat(weight[of], size), minlength=self.n)
        else:  # whole lists, which lie together
            added = self._summed(self.posting_at[term], self.posting_at[term + 1], weight)
        score = np.round((added + base)[which], PLACES)
        good = (score > 0) & (which != without)
        which, score = which[good], score[good]
        if len(which) > k:
            good = score >= np.partition(score, -k)[-k]
            which, score = which[good], score[good]
        number = self.number[which]
        order = np.lexsort((number, -score))[:k]
        return number[order], np.minimum(score[order], 1.0)


@dataclass
class Model:
    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex | None
    prior: float

    def vectors(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Weights (1 + ln tf) idf of unit length."""
        w = np.log(times, dtype=np.float32)
        w += 1
        w *= self.idf[term]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n))
        w /= np.maximum(norm, 1e-30).astype(np.float32)[doc]
        return w

    def vote(self, near: np.ndarray, cos: np.ndarray) -> float:
        """Votes weighted by 1 / distance, with the prior as one vote from the greatest distance."""
        w = 1 / (1 - cos + 0.02)
        return float((w @ self.index.toxic[near] + self.prior) / (w.sum() + 1))

    def score(self, texts: list[str], steps: Steps) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        doc, term, times = term_counts(texts, self.vocabulary)
        score, ids, cosines = np.full(len(texts), self.prior), [], []
        for d, (near, cos) in enumerate(self.index.search(doc, term, self.vectors(doc, term, times, len(texts)), len(texts), NEIGHBOURS)):
            if len(near):
                score[d] = np.interp(self.vote(near, cos), *steps)
            ids.append(self.index.ids[near])
            cosines.append(cos)
        return score, ids, cosines


#: Points between which votes are calibrated.
Steps = tuple[np.ndarray, np.ndarray]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y at x, by pooling adjacent violators, as points to interpolate."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order].astype(float)
    pools: list[list[float]] = []  # sum, size, first x, last x
    for a, b in zip(xs.tolist(), ys.tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    px = np.array([v for p in pools for v in (p[2], p[3])])
    py = np.array([v for p in pools for v in [(p[0] + 0.5) / (p[1] + 1)] * 2])
    return px, np.maximum.accumulate(py) if len(py) else py


def emphasis(term: np.ndarray, toxic: np.ndarray, terms: int) -> np.ndarray:
    """The factor of each term's idf: 1, more by the evened-out log ratio of its rate of toxic examples to the overall one.
    term, toxic: of each posting."""
    held, bad = np.bincount(term, minlength=terms), np.bincount(term, weights=toxic.astype(np.float32), minlength=terms)
    rate = float(toxic.sum()) / max(1, len(toxic))
    if not rate:
        return np.ones(terms)
    return 1 + EMPHASIS * np.maximum(0, np.log((bad + EVEN * rate) / ((held + EVEN) * rate)))


def _examples(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that are fitted, as a written table."""
    given = pruned(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    given = given.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` narrow rows: small enough to be sent everywhere, however large the tables are.
    joined = pruned(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return saved(joined.where("text IS NOT NULL"), "examples")


def _lists(at: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in values]


def _example_terms(examples: DataFrame) -> DataFrame:
    """(doc_id, toxic, term, times) of each example, as a written table."""

    def terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in chunks(b.column(1).to_pylist()):
                doc, term, times = term_counts(part)
                lists = _lists(np.searchsorted(doc, np.arange(len(part) + 1)), term.view(np.int64), times.astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), b.column(2).slice(i, len(part)), *lists], names=["doc_id", "toxic", "term", "times"])

    return saved(examples.mapInArrow(terms, "doc_id bigint, toxic int, term array<bigint>, times array<int>"), "example-terms")


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """How many rows docs has, and how many of them hold each term."""
    v = len(vocabulary)
    given = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def frequency(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(v + 1, np.int64), 0
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                for _, part in chunks(b.column(0).slice(i, 1024).to_pylist()):
                    df += np.bincount(term_counts(part, given.value)[1], minlength=v + 1)
            n += b.num_rows
        df[v] = n
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have])], names=["term", "df"])

    t = pruned(docs, "text").mapInArrow(frequency, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(v + 1, np.int64)
    df[np.asarray(t.column("term"))] = np.asarray(t.column("df"))
    given.destroy()
    return int(df[v]), df[:v]


def _flat(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.asarray(c.flatten()) for c in t.column(name).chunks)])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> tuple[Broadcast, Steps]:
    """The model of labels(doc_id, toxic): every term of at most `most` labelled rows, all of them in the index; document
    frequencies from all of docs(doc_id, text). Votes are calibrated on the examples, each judged by the others."""
    examples = _examples(docs, labels, most)
    held = _example_terms(examples)
    drop(examples)
    t = held.orderBy("doc_id").toArrow()  # the examples' terms: bounded by their number and lengths
    ids, toxic = np.asarray(t.column("doc_id")).astype(np.int64), np.asarray(t.column("toxic")).astype(float) > 0
    example = np.repeat(np.arange(len(ids), dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *(np.asarray(c.value_lengths()) for c in t.column("term").chunks)]).astype(np.int64))
    own, times = _flat(t, "term", np.int64).view(np.uint64), _flat(t, "times", np.int32)
    del t
    vocabulary = np.unique(own)
    term = np.searchsorted(vocabulary, own).astype(np.int32)
    del own
    release()
    n, df = _frequencies(docs, vocabulary)
    idf = np.maximum(1e-3, np.log((1 + n) / (1 + df)) + 1e-3)  # a term of all documents keeps a little
    idf *= emphasis(term, toxic[example], len(vocabulary))
    model = Model(vocabulary, idf.astype(np.float32), None, float(toxic.mean()) if len(toxic) else 0.0)
    model.index = BlockMaxIndex(ids, toxic.astype(float), example, term, model.vectors(example, term, times, len(ids)), len(vocabulary))
    del example, term, times
    sc = docs.sparkSession.sparkContext
    given = sc.broadcast(model)
    del model, vocabulary, idf, df
    release()

    def votes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for b in batches:
            x = pa.Table.from_batches([b])
            doc = np.repeat(np.arange(b.num_rows), np.asarray(b.column(2).value_lengths()))
            own = np.searchsorted(m.vocabulary, _flat(x, "term", np.int64).view(np.uint64))
            weight = m.vectors(doc, own, _flat(x, "times", np.int32), b.num_rows)
            found = m.index.search(doc, own, weight, b.num_rows, NEIGHBOURS, np.searchsorted(m.index.ids, np.asarray(b.column(0))))
            yield pa.RecordBatch.from_arrays([pa.array([m.vote(*f) if len(f[0]) else m.prior for f in found]), b.column(1)], names=["vote", "toxic"])

    judged = held.repartition(sc.defaultParallelism).mapInArrow(votes, "vote double, toxic int").toArrow()
    drop(held)
    steps = isotonic(np.asarray(judged.column("vote")), np.asarray(judged.column("toxic")) > 0)
    # Without examples of both kinds nothing can be told apart.
    if not len(toxic) or toxic.all() or not toxic.any():
        steps = (np.zeros(1), np.zeros(1))
    return given, steps


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, score, is_toxic, evidence_ids, evidence_cosines) for every row of docs(doc_id, text).

    score: share of toxic labels among the NEIGHBOURS examples of greatest cosine, weighted by 1 / distance and
    calibrated by isotonic regression on examples judged without themselves; evidence lists those neighbours. Vectors hold
    every word of the labelled examples: (1 + ln times) x idf over all documents x a factor of at least 1 that words of
    toxic examples get (`emphasis`). A text without any such word (null and empty ones too) has no neighbours and the rate
    of toxic examples as its score. is_toxic: score >= 0.5 with evidence. Cosines that agree to five places are equal
    and go to the smaller doc_id of the example. At most `most` labelled rows are fitted (rows without label or doc_id
    don't count, a repeated doc_id is toxic if any of its rows is); without examples of both kinds nobody is toxic. A null
    doc_id stays null, repeated rows are judged each, other columns are not read. Two passes over the texts, no
    shuffle of them.
    """
    model, steps = fit(docs, labels, most)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                for i, part in chunks(b.column(1).slice(k, 1024).to_pylist()):
                    score, ids, cos = model.value.score(part, steps)
                    at = np.cumsum([0, *map(len, ids)])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(k + i, len(part)), pa.array(score), pa.array(toxic_flags(score, ids)), *_lists(at, np.concatenate(ids), np.concatenate(cos))],
                        names=["doc_id", "score", "is_toxic", "evidence_ids", "evidence_cosines"],
                    )
        release()

    return pruned(docs, "doc_id", "text").mapInArrow(judge, "doc_id bigint, score double, is_toxic boolean, evidence_ids array<bigint>, evidence_cosines array<double>")


def toxic_flags(score: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    return (score >= SCORE) & np.array([len(x) > 0 for x in ids], bool)


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    """The rows of docs that `toxicity` doesn't call toxic, with all their columns; one pass, nothing shuffled."""
    model, steps = fit(docs, labels, most)
    at = places(docs, "text")[0]

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags = np.zeros(b.num_rows, bool)
            for k in range(0, b.num_rows, 1024):
                for i, part in chunks(b.column(at).slice(k, 1024).to_pylist()):
                    score, ids, _ = model.value.score(part, steps)
                    flags[k + i : k + i + len(part)] = toxic_flags(score, ids)
            yield b.filter(pa.array(~flags))

    return through(docs, keep)
