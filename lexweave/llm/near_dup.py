"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact verification."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import RADIX, Words, chunks, mix, shingles
from .work import drop, packed, pruned, saved, sent_if_small, tidy, unpacked

SHINGLE = 3
THRESHOLD = 0.5
#: 2**P buckets; a register keeps a count of leading zeros (6 bits) and R bits of mantissa: two bytes.
P, R = 7, 10
BUCKETS = 1 << P
#: Registers in a band, and orders of the buckets that are cut into bands. A pair shares a band (simulated: the orders'
#: bands aren't independent) with chance 0.974 at a Jaccard index of 0.5 and 0.995 at 0.55; README has both cuts together.
ROWS, SHUFFLES = 4, 2
BANDS = SHUFFLES * (BUCKETS // ROWS)
ORDERS = np.concatenate([np.random.default_rng(5 + k).permutation(BUCKETS)[: BUCKETS // ROWS * ROWS] for k in range(SHUFFLES)]).reshape(BANDS, ROWS)
#: Standard errors that an estimate may lie below the threshold and still be verified.
MARGIN = 3.0
#: Pairs of one document that one task verifies; more of them are dealt to several, each with the document's text.
FAN = 4096


def registers(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(n, BUCKETS) registers of each text's shingle hashes; 0 is an empty bucket, a larger register a smaller hash."""
    out = np.zeros(n * BUCKETS, np.uint16)
    bucket = (h >> np.uint64(64 - P)).astype(np.int64)
    rest = h << np.uint64(P)
    # Leading zeros of the 64 - P bits that are left, through the exponent of a double (exact: the top 53 bits decide).
    top = rest >> np.uint64(11)
    exponent = np.frexp(top.astype(np.float64))[1]  # 53 for a set top bit, 0 for none
    zeros = np.minimum(53 - exponent, 62).astype(np.uint64)
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - R)
    register = ((zeros + np.uint64(1)) << np.uint64(R) | (np.uint64((1 << R) - 1) - mantissa)).astype(np.uint16)
    np.maximum.at(out, doc * BUCKETS + bucket, register)
    return out.reshape(n, BUCKETS)


#: Where an empty bucket borrows: the first that isn't empty of an order of its own, so that the registers of a band
#: stand for different shingles even where a text has few.
PROBES = np.stack([np.concatenate([[j], np.random.default_rng(1000 + j).permutation(np.delete(np.arange(BUCKETS), j))]) for j in range(BUCKETS)])


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers as banded, without empty ones."""
    out = regs.copy()
    for i in range(0, len(regs), 64):
        part = regs[i : i + 64]
        first = (part > 0)[:, PROBES].argmax(axis=2)
        out[i : i + 64] = np.take_along_axis(part, PROBES[np.arange(BUCKETS), first], axis=1)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys; equal where all registers of the band are."""
    f = mix(filled(regs).astype(np.uint64))
    key = np.zeros((len(regs), BANDS), np.uint64)
    for j in range(ROWS):
        key = key * np.uint64(RADIX) + f[:, ORDERS[:, j]]
    return mix(key + (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))).view(np.int64)


@functools.lru_cache(1 << 16)
def expected_collisions(n: int, m: int) -> float:
    """Buckets in which disjoint sets of n and m shingles are expected to have equal registers by chance."""
    if min(n, m) == 0:
        return 0.0
    total = 0.0
    steps = 1 << min(R, 6)  # intervals of equal mantissa are far finer; within one of these the density is even
    for z in range(1, 64 - P):
        lo = 2.0**-z
        edge = lo + np.arange(steps + 1) * (lo / steps)
        inside = lambda k: np.power(1 - edge[:-1] / BUCKETS, k) - np.power(1 - edge[1:] / BUCKETS, k)  # noqa: B023, E731
        total += float((inside(n) * inside(m)).sum()) / (2.0**R / steps)
        if lo * max(n, m) < 1e-9 * BUCKETS:
            break
    return total * BUCKETS


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard of pairs from their raw registers (rows), less what chance adds, and how many buckets tell of it.
    n, m: their distinct shingles."""
    same = ((a == b) & (a > 0)).sum(axis=1)
    either = np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1))

    def rough(k: int) -> int:  # three figures are more than the correction needs
        e = 10 ** max(0, len(str(k)) - 3)
        return k // e * e

    chance = np.array([expected_collisions(rough(x), rough(y)) for x, y in zip(n.tolist(), m.tolist(), strict=True)])
    return np.maximum(0.0, same - chance) / either, either


def distinct_hashes(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingle hashes once, texts in order."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _pieces(column: pa.Array, step: int = 1024) -> Iterator[tuple[int, list[str]]]:
    for i in range(0, len(column), step):
        for j, part in chunks(column.slice(i, step).to_pylist()):
            yield i + j, part


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n, regs) of every row of docs(doc_id, text) that has a word."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in _pieces(b.column(1)):
                w = Words(part)
                h, doc = shingles(w, SHINGLE)
                h, doc = distinct_hashes(h, doc)
                count = np.bincount(doc, minlength=len(part))
                have = np.flatnonzero(count)
                if not len(have):
                    continue
                regs = registers(h, doc, len(part))[have]
                # 128 bits of the sequence of words: exact copies but for case, punctuation and white space
                size = np.diff(w.at)
                place = np.arange(len(w.hash)) - np.repeat(w.at[:-1], size)
                two = [np.zeros(len(w.hash) + 1, np.uint64) for _ in range(2)]
                for k, t in enumerate(two):
                    np.cumsum(mix(w.hash + mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(k))), out=t[1:])
                digest = np.stack([t[w.at[1:]] - t[w.at[:-1]] for t in two], axis=1)[have]
                cols = [b.column(0).slice(i, len(part)).take(pa.array(have)), _binary(digest), pa.array(count[have].astype(np.int32)), _binary(regs)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "n", "regs"])

    return docs.select("doc_id", "text").mapInArrow(tidy(sign), "doc_id bigint, digest binary, n int, regs binary")


def banded(sig: DataFrame) -> DataFrame:
    """(key, doc_id): BANDS rows of each signature."""

    def band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                ids = np.asarray(b.column(0).slice(i, 2048))
                keys = band_keys(_registers(b.column(1).slice(i, 2048)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, BANDS))], names=["key", "doc_id"])

    return sig.select("doc_id", "regs").mapInArrow(tidy(band), "key bigint, doc_id bigint")


def _likely(value: np.ndarray, buckets: np.ndarray, threshold: float) -> np.ndarray:
    return value >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / buckets)


ESTIMATED = "a bigint, b bigint, estimate float"


def _rows(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value.astype(np.float32))], names=["a", "b", "estimate"])


def _estimated(pairs: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    """(a, b, estimate) of the pairs(a, b) whose estimate reaches the threshold less MARGIN standard errors."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for i in range(0, t.num_rows, 4096):
                p = t.slice(i, 4096)
                value, buckets = estimate(_registers(p.column(2)), _registers(p.column(3)), np.asarray(p.column(4)), np.asarray(p.column(5)))
                good = _likely(value, buckets, threshold)
                yield _rows(np.asarray(p.column(0))[good], np.asarray(p.column(1))[good], value[good])

    one = sig.select(F.col("doc_id").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"))
    two = sig.select(F.col("doc_id").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"))
    # Sets of very different size can't reach the threshold: |smaller| / |larger| bounds the Jaccard index.
    sized = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(float(threshold))
    return pairs.join(one, "a").join(two, "b").where(sized).select("a", "b", "ra", "rb", "na", "nb").mapInArrow(tidy(judge), ESTIMATED)


#: Documents of a bucket that one task compares with each other, or with as many others.
TOGETHER = 2048


def _estimated_across(members: DataFrame, threshold: float, block: int = TOGETHER) -> DataFrame:
    """(a, b, estimate), a < b, of the likely pairs of members(key, size, doc_id, root, n, regs) that share a key and differ in root.

    Registers are compared where they lie; only pairs that pass leave the task. A bucket of more than `block` documents is cut
    into blocks, and each two of its blocks (and each with itself) meet in a group of their own, so that no task holds more
    than two blocks and no pair is left out."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def compared(side, ids, root, n, regs) -> Iterator[pa.RecordBatch]:
            apart = (side != side[0]).any()
            filled = np.count_nonzero(regs, axis=1)
            for i in np.flatnonzero(side == 0).tolist() if apart else range(len(ids) - 1):
                j = np.flatnonzero(side == 1) if apart else np.arange(i + 1, len(ids))
                j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]))]
                if not len(j):
                    continue
                # A bound without the correction first: it only lowers an estimate.
                same = ((regs[j] == regs[i]) & (regs[i] > 0)).sum(axis=1)
                j = j[same >= (threshold - MARGIN * 0.5 / np.sqrt(np.maximum(1, filled[i]))) * filled[i]]
                if len(j):
                    value, buckets = estimate(np.broadcast_to(regs[i], (len(j), BUCKETS)), regs[j], np.full(len(j), n[i]), n[j])
                    good = _likely(value, buckets, threshold)
                    if good.any():
                        other = ids[j[good]]
                        yield _rows(np.minimum(ids[i], other), np.maximum(ids[i], other), value[good])

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                side, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                low, high = now[1:]
                # Within one block there is one side; between two, both have to be there.
                if low == high or len(np.unique(side)) == 2:
                    yield from compared(side, *rest)

        for t in batches:
            if not t.num_rows:
                continue
            key, low, high, side, ids, root, n = (np.asarray(t.column(k)) for k in range(7))
            regs = _registers(t.column(7))
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                if now != (key[x], low[x], high[x]):
                    yield from flush()
                    held, now = [], (key[x], low[x], high[x])
                held.append((side[x:y], ids[x:y], root[x:y], n[x:y], regs[x:y]))
        yield from flush()

    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    each = members.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    met = each.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    placed = met.select("key", "lo", "hi", "side", "doc_id", "root", "n", "regs").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return placed.mapInArrow(tidy(judge), ESTIMATED)


def _verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the written pairs(a, b) whose exact Jaccard index of shingles reaches the threshold, as a written table.

    Each b's text moves once for each of its pairs, to a's; rows stream by, and a task holds one set at a time."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for t in batches:
            a, is_head, b = np.asarray(t.column(0)), t.column(1).to_pylist(), np.asarray(t.column(2))
            for i, part in _pieces(t.column(3)):
                h, doc = distinct_hashes(*shingles(Words(part), SHINGLE))
                at = np.searchsorted(doc, np.arange(len(part) + 1))
                good = np.zeros(len(part), bool)
                for k in range(len(part)):
                    own = h[at[k] : at[k + 1]]
                    if is_head[i + k]:
                        head = own
                    elif len(own) and len(head):
                        where = np.searchsorted(head, own)
                        common = int(np.count_nonzero(head[np.minimum(where, len(head) - 1)] == own))
                        good[k] = common >= threshold * (len(own) + len(head) - common)
                where = i + np.flatnonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(a[where]), pa.array(b[where])], names=["a", "b"])

    around = Window.partitionBy("a")
    dealt = saved(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.count("*").over(around) / F.lit(FAN))).cast("int").alias("part")), "dealt")
    heads = dealt.select("a", "part").distinct()
    members = docs.join(sent_if_small(dealt.withColumnRenamed("b", "doc_id")), "doc_id").select("a", "part", F.lit(False).alias("h"), F.col("doc_id").alias("b"), "text")
    first = docs.join(sent_if_small(heads.withColumnRenamed("a", "doc_id")), "doc_id").select(F.col("doc_id").alias("a"), "part", F.lit(True).alias("h"), F.col("doc_id").alias("b"), "text")
    rows = members.unionByName(first).repartition("a", "part").sortWithinPartitions("a", "part", F.desc("h"))
    out = saved(rows.select("a", "h", "b", "text").mapInArrow(tidy(judge), "a bigint, b bigint"), "verified")
    drop(dealt)
    return out


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs(a, b, estimate) that lie in different components, with the components' roots x < y."""
    one, two = (roots.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in ("a", "b"))
    rooted = pairs.join(one, "a", "left").join(two, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return rooted.where("ra <> rb").select("a", "b", "estimate", F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y"))


def repeated_ids(ids: DataFrame) -> DataFrame | None:
    """The identifiers that several rows have, as a written table; None if there are none. A narrow scan."""
    twice = saved(ids.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    return None if twice.isEmpty() else twice


def _groups(ids: DataFrame, twice: DataFrame | None, threshold: float) -> DataFrame:
    """(node, root) of every document that isn't its group's least."""
    if twice is not None:
        several = ids.join(sent_if_small(twice), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        ids = ids.join(sent_if_small(twice), "doc_id", "left_anti").unionByName(several)
    sig = saved(signatures(ids), "signatures")
    # Copies share all their keys: the least doc_id of a digest stands for them from here on.
    near = Window.partitionBy("digest")
    copies = saved(sig.select("doc_id", "digest").withColumn("root", F.min("doc_id").over(near)).where("doc_id <> root").select("doc_id", "root"), "copies")
    single = sig.join(sent_if_small(copies.select("doc_id")), "doc_id", "left_anti")
    around = Window.partitionBy("key")
    shared = banded(single).withColumn("size", F.count("*").over(around)).withColumn("head", F.min("doc_id").over(around)).where("size > 1")
    shared = saved(shared.select("key", "doc_id", "head"), "buckets")
    partnered = saved(shared.select("doc_id").distinct(), "partnered")
    regs = saved(single.join(sent_if_small(partnered), "doc_id", "left_semi").select("doc_id", "n", "regs"), "registers")
    drop(partnered)

    stars = shared.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = saved(_estimated(stars, regs, threshold), "stars")
    written = [sig, copies, shared, regs, stars]

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        """Components after the pairs that verify have been added."""
        own = saved(pairs.select("a", "b"), "pairs")
        good = _verified(own, ids, threshold)
        out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(good))
        for t in (own, good, roots):
            drop(t)
        return out

    nothing = saved(stars.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0), "roots")
    # Only components matter: a pair within one needs no look at its texts. So each document's best pair comes first.
    roots = joined(nothing, stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a")))
    rest = _across(stars, roots)
    if not rest.isEmpty():
        roots = joined(roots, rest)
    # Then every pair of a bucket that is still in different components, whatever its head.
    placed = shared.select("key", "doc_id").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = placed.withColumns({"lo": F.min("root").over(around), "hi": F.max("root").over(around), "size": F.count("*").over(around)}).where("lo <> hi").select("key", "size", "doc_id", "root")
    mixed = saved(mixed, "mixed")
    tried = stars.select("a", "b")
    found = _estimated_across(mixed.join(regs, "doc_id"), threshold).groupBy("a", "b").agg(F.max("estimate").alias("estimate"))
    found = saved(_across(found, roots).join(tried, ["a", "b"], "left_anti"), "across")
    best = Window.partitionBy("x", "y").orderBy(F.desc("estimate"), "a", "b")
    if not found.isEmpty():
        roots = joined(roots, found.withColumn("r", F.row_number().over(best)).where("r <= 4"))
        rest = _across(found.drop("x", "y"), roots)
        if not rest.isEmpty():
            roots = joined(roots, rest)
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("root").alias("a"), F.col("doc_id").alias("b"))))
    for t in (*written, mixed, found, roots):
        drop(t)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id, keep) of every document that has a near-duplicate; group_id is the one kept of its group.

    Two documents of docs(doc_id, text) are near-duplicates if their words agree wholly or the Jaccard index of their
    sets of three-word shingles reaches `threshold`; groups are the connected components, and the least doc_id is
    kept. Words are runs of letters, digits and marks in lower case. Texts without a word (null and empty ones among
    them) are no one's duplicate; rows with a null doc_id take no part; rows that repeat a doc_id count as one
    document, its least text. No rows give none; other columns are not read.

    Steps: (1) registers in the scan; copies fall together by digest. (2) Documents that share a band key are
    candidates. In each bucket all are first compared with the least (a star, so a group of thousands costs thousands of
    comparisons, not millions); (3) then every pair of a bucket that is still in different components is compared as
    well, where the bucket lies, so that no candidate is left out. A comparison is the corrected estimate from registers;
    what it doesn't rule out is verified by the exact index, unless its documents are in one component already.
    """
    ids = pruned(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    groups = _groups(ids, repeated_ids(ids), threshold)
    kept = groups.select(F.col("root").alias("doc_id"), F.col("root").alias("group_id")).distinct()
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), F.lit(False).alias("keep")).unionByName(kept.withColumn("keep", F.lit(True)))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that `near_duplicates` doesn't keep; of rows that repeat a doc_id, the one with the least
    text (null last) stays. Rows with a null doc_id and texts without a word stay as they are. All columns stay.
    Texts are shuffled only where identifiers repeat or more are dropped than can be sent to every executor."""
    ids = pruned(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    twice = repeated_ids(ids)
    gone = _groups(ids, twice, threshold).select(F.col("node").alias("_gone"))
    left = packed(docs, _id="doc_id", _t="text").join(sent_if_small(gone.withColumnRenamed("_gone", "_id")), "_id", "left_anti")
    if twice is None:
        return unpacked(left, docs.columns)
    again = twice.withColumnRenamed("doc_id", "_id")
    first = Window.partitionBy("_id").orderBy(F.col("_t").asc_nulls_last())
    once = left.join(sent_if_small(again), "_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return unpacked(left.join(sent_if_small(again), "_id", "left_anti").select("_d").unionByName(once.select("_d")), docs.columns)
