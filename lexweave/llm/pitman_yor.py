"""Language-model scoring by a hierarchical Pitman-Yor model of byte n-grams, its seating sampled by Gibbs.

A restaurant stands for a context; the shorter context (without its first byte) is its parent, whose customers are the
tables of all its children. Restaurants of two or more context bytes are dealt to shards by the last two bytes, so every
chain of parents down to there lies within one shard; those of one byte and of none are few (at most 65,792 dishes)
and are sampled on the driver, in turn with the shards.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import ORDER, Tally, pieces, scored
from .work import drop, pruned, saved

#: Distinct n-grams a shard, about, and the fewest shards.
SHARD, SHARDS = 1 << 20, 64
ROUNDS, BURN_IN, SAMPLES = 2, 3, 4
STRENGTH = 1.0
BASE = 1.0 / 256
#: Customers of a dish up to which weights come from the recursion; beyond, from an integral of NODES points a side.
EXACT, NODES, CHEBYSHEV = 1024, 48, 12
#: Numbers of tables weighed for a dish, and dishes weighed at a time.
POINTS, BLOCK = 96, 4096


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of gamma(x), x > 0."""
    z = x + 6
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


@functools.lru_cache(4)
def _weights(discount: float) -> np.ndarray:
    """[c, t]: log of the weight of all seatings of c customers, up to EXACT, at t tables: discount ** t times a generalized Stirling number."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        for c in range(EXACT):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1] + np.log(discount), out[c, 1:] + np.log(np.maximum(0, c - t * discount)))
    return out


def _root(left, shape: tuple, low: float = -700.0, steps: int = 40) -> np.ndarray:
    """log of the y in (0, 1) where left(log y), which falls, passes 0."""
    lo, hi = np.full(shape, low), np.full(shape, -1e-12)
    for _ in range(steps):
        mid = (lo + hi) / 2
        above = left(mid) > 0
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def _slope(log_y: np.ndarray, scale: np.ndarray, d: float) -> np.ndarray:
    """log of scale * y ** (d - 1) * (1 - y)."""
    return np.log(scale) + (d - 1) * log_y + np.log(-np.expm1(log_y))


def _many(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """As _weights for any c and (rows of) real t: c! / t! times the coefficient of x ** c in (1 - (1 - x) ** d) ** t.

    That is Cauchy's integral over a parabola around the cut, w = -c log x, with its vertex at the saddle point."""
    c = c[:, None].astype(float)
    log_y = _root(lambda x: _slope(x, t * d / c, d) - np.log(-np.expm1(d * x)), t.shape)
    y = np.exp(log_y)
    mu = np.maximum(1.0, -c * np.log1p(-y))
    s = -np.expm1(-mu / c)
    f = np.maximum(1e-300, -np.expm1(d * np.log(s)))
    first = -d * s ** (d - 1) * (1 - s) / c / f
    second = d * (1 - s) / c**2 * ((1 - d) * s ** (d - 2) * (1 - s) + s ** (d - 1)) / f - first**2
    reach = 9 / np.sqrt(np.minimum(mu, np.maximum(0.5 * mu, 2 * mu**2 * t * second)))
    u = np.arange(NODES) / (NODES - 1)
    v = reach[..., None] * u
    w = mu[..., None] * (1 + 1j * v) ** 2
    height = w + t[..., None] * np.log(1 - (-np.expm1(-w / c[..., None])) ** d)
    top = height[..., :1].real
    part = ((1 + 1j * v) * np.exp(height - top)).real
    total = (2 * part.sum(axis=-1) - part[..., 0]) * reach / (NODES - 1)
    return _lgamma(c + 1) - _lgamma(t + 1) + np.log(mu / (np.pi * c)) + top[..., 0] + np.log(np.maximum(1e-300, total))


class Level:
    """All restaurants of one length of context: dishes (n-grams), their customers and how many tables these sit at.

    Probabilities depend on numbers of tables alone, so the seating of a dish's customers at them is summed over."""

    def __init__(self, code: np.ndarray, rng: np.random.Generator):
        self.code, self.rng = code, rng  # sorted
        ctx = code >> np.uint64(8)
        self.contexts, self.ctx = np.unique(ctx, return_inverse=True)
        self.customers = np.zeros(len(code), np.int64)
        self.tables = np.zeros(len(code), np.int64)
        self.discount = 0.5
        self._count()

    def _count(self) -> None:
        self.ctx_customers = np.bincount(self.ctx, weights=self.customers, minlength=len(self.contexts))
        self.ctx_tables = np.bincount(self.ctx, weights=self.tables, minlength=len(self.contexts))

    @property
    def owner(self) -> np.ndarray:
        """Dish of each table."""
        return np.repeat(np.arange(len(self.code)), self.tables)

    @property
    def size(self) -> np.ndarray:
        """Customers of each table in one of the seatings that have these numbers of tables (not a draw)."""
        out = np.ones(int(self.tables.sum()), np.int64)
        have = self.tables > 0
        out[(np.cumsum(self.tables) - self.tables)[have]] += (self.customers - self.tables)[have]
        return out

    def set_discount(self, customers: np.ndarray) -> None:
        one, two = np.count_nonzero(customers == 1), np.count_nonzero(customers == 2)
        self.discount = round(float(np.clip(one / max(1, one + 2 * two), 0.1, 0.95)), 2)

    def seat_first(self, customers: np.ndarray) -> None:
        """A starting number of tables."""
        self.set_discount(customers)
        self.customers = customers.astype(np.int64)
        self.tables = np.minimum(self.customers, np.ceil(self.customers**self.discount)).astype(np.int64)
        self._count()

    def draw(self, customers: np.ndarray, parent: np.ndarray) -> None:
        """A Gibbs move of all customers: each dish's get up together and a number of tables is drawn for them given
        all other dishes of the restaurant, whatever their number. The r-th dishes of all restaurants move at once."""
        self.customers = customers.astype(np.int64)
        self.tables = np.minimum(np.maximum(1, self.tables), self.customers)
        self._count()
        several = np.flatnonzero(self.customers > 1)
        at = 0
        while at < len(several):  # whole restaurants, some thousands of dishes
            to = int(np.searchsorted(self.ctx[several], self.ctx[several[min(len(several), at + BLOCK) - 1]], side="right"))
            self._draw(several[at:to], parent)
            at = to
        self._count()

    def _draw(self, dish: np.ndarray, parent: np.ndarray) -> None:
        d, c, ctx = self.discount, self.customers[dish], self.ctx[dish]
        h = np.clip(parent[dish], 1e-300, 1 - 1e-12)
        log_h = np.log(h)
        others = STRENGTH / d + self.ctx_tables[ctx] - self.tables[dish]
        # About where the number of tables will lie: the saddle point, and the curvature there.
        y = np.exp(_root(lambda x: _slope(x, others * h * d / c, d) - np.log1p(h * np.expm1(d * x)), h.shape))
        f = np.maximum(1e-12, 1 - y**d)
        t = np.clip(others * h * f / (1 - h * f), 1, c)
        second = np.maximum(0, d * (1 - y) / c**2 * ((1 - d) * np.maximum(y, 1e-150) ** (d - 2) * (1 - y) + np.maximum(y, 1e-150) ** (d - 1)) / f - 1 / t**2)
        wide = 1 / np.sqrt(1 / t - 1 / (others + t) + 1 / np.maximum(1e-300, t**3 * second))
        wide = np.minimum(wide, np.sqrt(t * (others + t) / others))
        lo = np.maximum(1, np.floor(t - 9 * wide - 12)).astype(np.int64)
        hi = np.minimum(c, np.ceil(t + 16 * wide + 12)).astype(np.int64)
        # Every number of the range, or where these are many, equally spaced ones from a random one on.
        step = -(-(hi - lo + 1) // POINTS)
        width = min(POINTS, int((hi - lo).max()) + 1)
        count = (lo + (self.rng.random(len(c)) * step).astype(np.int64))[:, None] + step[:, None] * np.arange(width)
        good = count <= hi[:, None]
        count = np.minimum(count, hi[:, None])
        weight = np.empty(count.shape)
        few = c <= EXACT
        if few.any():
            weight[few] = _weights(d)[c[few][:, None], count[few]]
        many = np.flatnonzero(~few)
        for i in range(0, len(many), 512):
            k = many[i : i + 512]
            weight[k] = self._interpolated(c[k], lo[k], hi[k], count[k])
        weight += count * log_h[:, None]
        weight[~good] = -np.inf
        rank = np.arange(len(dish)) - np.searchsorted(ctx, ctx)
        order = np.argsort(rank, kind="stable")
        cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            k = order[a:b]
            rest = STRENGTH / d + self.ctx_tables[ctx[k]] - self.tables[dish[k]]
            p = weight[k] + _lgamma(rest[:, None] + count[k])
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            j = (p < self.rng.random(len(k))[:, None] * p[:, -1:]).sum(axis=1)
            new = count[k, j]
            self.ctx_tables[ctx[k]] += new - self.tables[dish[k]]
            self.tables[dish[k]] = new

    def _interpolated(self, c, lo, hi, count) -> np.ndarray:
        """_many at count, by Chebyshev interpolation between lo and hi of what is smooth in it."""
        k = np.arange(CHEBYSHEV)
        x = np.cos((k + 0.5) * np.pi / CHEBYSHEV)
        half = np.maximum(0.5, (hi - lo)[:, None] / 2)
        middle = (hi + lo)[:, None] / 2
        t = middle + half * x
        value = _many(c, t, self.discount) + _lgamma(t + 1) - np.log(t)
        basis = np.cos(k[:, None] * np.arccos(x)[None, :]) * (2.0 / CHEBYSHEV)
        basis[0] /= 2
        part = value @ basis.T
        z = np.clip((count - middle) / half, -1, 1)
        one, two = np.zeros_like(z), np.zeros_like(z)  # Clenshaw
        for j in range(CHEBYSHEV - 1, 0, -1):
            one, two = 2 * z * one - two + part[:, j : j + 1], one
        return z * one - two + part[:, :1] - _lgamma(count + 1.0) + np.log(count)

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        own = self.customers - self.discount * self.tables
        return (own + (STRENGTH + self.discount * self.ctx_tables[self.ctx]) * parent) / (STRENGTH + self.ctx_customers[self.ctx])


class Chain:
    """Levels lowest .. highest of one shard, below them a fixed probability of each dish of the lowest."""

    def __init__(self, code: np.ndarray, n: np.ndarray, lowest: int, highest: int, below: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.lowest, self.below_table = lowest, below
        codes = {highest: code}
        for m in range(highest - 1, lowest - 1, -1):
            codes[m] = np.unique(codes[m + 1] & np.uint64((1 << 8 * (m + 1)) - 1))
        self.levels = {m: Level(c, rng) for m, c in codes.items()}
        self.up = {m: np.searchsorted(codes[m - 1], codes[m] & np.uint64((1 << 8 * m) - 1)) for m in codes if m > lowest}
        self.n = n
        self.base = below[(codes[lowest] & np.uint64((1 << 8 * lowest) - 1)).astype(np.int64)] if lowest else np.full(len(codes[0]), BASE)
        customers = n
        for m in range(highest, lowest - 1, -1):
            self.levels[m].seat_first(customers)
            if m > lowest:
                customers = np.bincount(self.up[m], weights=self.levels[m].tables, minlength=len(codes[m - 1])).astype(np.int64)

    def probabilities(self) -> dict[int, np.ndarray]:
        out, parent = {}, self.base
        for m in sorted(self.levels):
            parent = parent if m == self.lowest else out[m - 1][self.up[m]]
            out[m] = self.levels[m].predictive(parent)
        return out

    def parent(self, m: int, p: dict[int, np.ndarray]) -> np.ndarray:
        return self.base if m == self.lowest else p[m - 1][self.up[m]]

    def asked(self, m: int) -> np.ndarray:
        """Customers of each dish: the n-gram's count, or its children's tables."""
        if m == max(self.levels):
            return self.n
        return np.bincount(self.up[m + 1], weights=self.levels[m + 1].tables, minlength=len(self.levels[m].code)).astype(np.int64)

    def sweep(self, fit: bool = False) -> None:
        """All customers of all levels move, given the probabilities below as they were; discounts are fitted if asked."""
        p = self.probabilities()
        for m in sorted(self.levels, reverse=True):
            customers = self.asked(m)
            if fit:
                self.levels[m].set_discount(customers)
            self.levels[m].draw(customers, self.parent(m, p))

    def run(self, burn_in: int = BURN_IN, samples: int = SAMPLES) -> dict[int, np.ndarray]:
        """Predictive probabilities of the dishes, averaged over samples."""
        total: dict[int, np.ndarray] = {}
        for i in range(burn_in + samples):
            self.sweep(i < burn_in)
            if i >= burn_in:
                for m, p in self.probabilities().items():
                    total[m] = total.get(m, 0) + p / samples
        return total

    def back_off(self, p: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Each context's weight of what it hasn't seen, so that its averaged probabilities sum to 1."""
        out = {}
        for m, level in self.levels.items():
            low = self.base if m == self.lowest else p[m - 1][self.up[m]]
            seen = np.bincount(level.ctx, weights=p[m], minlength=len(level.contexts))
            covered = np.bincount(level.ctx, weights=low, minlength=len(level.contexts))
            out[m] = np.maximum(1e-12, 1 - seen) / np.maximum(1e-9, 1 - covered)
        return out

    def rows(self, p: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        gamma = self.back_off(p)
        for m, level in self.levels.items():
            for ctx, code, value in ((False, level.code, p[m]), (True, level.contexts, gamma[m])):
                yield _table_rows(m, ctx, code, np.log(value))


def _table_rows(m: int, ctx: bool, code: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    n = len(code)
    cols = [pa.array([""] * n, pa.string()), pa.array(np.full(n, m, np.int32)), pa.array(np.full(n, ctx)), pa.array(code.view(np.int64)), pa.array(value.astype(np.float64))]
    return pa.RecordBatch.from_arrays(cols, names=["lang", "level", "is_context", "code", "value"])


def _sampler(given, seed: int, last: bool):
    """Samples a shard, from the tables of the round before on if there are any: its tables of the model, or (before the
    last round) how many tables each dish of each level has."""

    def sample(t):
        code = np.asarray(t.column("code").combine_chunks()).view(np.uint64)
        n, of = np.asarray(t.column("n").combine_chunks()), np.asarray(t.column("of").combine_chunks())

        def part(m: int) -> tuple[np.ndarray, np.ndarray]:
            where = np.flatnonzero(of == m)
            where = where[np.argsort(code[where])]
            return code[where], n[where]

        chain = Chain(*part(-1), 2, ORDER - 1, given.value, seed + int(t.column("shard")[0].as_py()))
        for m, level in chain.levels.items():
            before = part(m)[1]
            if len(before):
                level.tables = before.copy()
        for m, level in chain.levels.items():
            level.customers = chain.asked(m)
            level._count()
        p = chain.run()
        if last:
            return pa.Table.from_batches(chain.rows(p))
        return pa.Table.from_batches([_table_rows(m, False, level.code, level.tables) for m, level in chain.levels.items()])

    return sample


SCHEMA = "lang string, level int, is_context boolean, code bigint, value double"


def gram_counts(docs: DataFrame) -> DataFrame:
    """(code, n) of all n-grams of docs(text): every document, every byte."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for _, part in pieces(b.column(0)):
                tally.add(part)
        code, n = tally.result()
        for i in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["code", "n"])

    return docs.select("text").where("text <> ''").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def hierarchical_pitman_yor(counts: DataFrame, seed: int = 11) -> DataFrame:
    """The model as back-off tables (a written table), from counts(code, n).

    Rounds alternate: shards sample their restaurants given the probabilities after one byte; what tables they opened
    there are the customers from which the driver samples the two lowest levels anew.
    """
    low_mask = 0xFFFF
    # Distinct (context of two, byte): how many restaurants of two bytes hold a dish; 65,536 rows at most.
    kinds = counts.select(F.col("code").bitwiseAND(0xFFFFFF).alias("c")).distinct().groupBy(F.col("c").bitwiseAND(low_mask).alias("c")).agg(F.count("*").alias("n")).collect()
    customers = {r["c"]: r["n"] for r in kinds}
    shard = F.pmod(F.hash(F.shiftright("code", 8).bitwiseAND(low_mask)), F.lit(max(SHARDS, -(-counts.count() // SHARD)))).alias("shard")
    dealt = counts.select("code", "n", F.lit(-1).alias("of"), shard)
    code = np.array(sorted(customers), np.uint64)
    low = Chain(code, np.array([customers[int(c)] for c in code], np.int64), 0, 1, np.zeros(0), seed)
    out = drawn = None
    for r in range(ROUNDS):
        p = low.run()
        gamma = low.back_off(p)
        after = _dense(low, p, gamma)
        last = r == ROUNDS - 1
        given = counts.sparkSession.sparkContext.broadcast(after)  # 256 x 256 probabilities
        before = drawn
        # The seating is kept from round to round.
        both = dealt if before is None else dealt.unionByName(before.select("code", F.col("value").cast("long").alias("n"), F.col("level").alias("of"), shard))
        drawn = saved(both.groupBy("shard").applyInArrow(_sampler(given, seed + 1000 * r, last), SCHEMA), "seating")
        if before is not None:
            drop(before)
        if not last:
            asked = drawn.where("level = 2").groupBy(F.col("code").bitwiseAND(low_mask).alias("code")).agg(F.sum("value").alias("n"))
            customers = {x["code"]: int(x["n"]) for x in asked.collect()}
            low.n = np.array([customers[int(c)] for c in code], np.int64)
        else:
            rows = [b for b in low.rows(p)]
            # Level 0 gives every byte a probability, seen or not.
            unseen = np.setdiff1d(np.arange(256, dtype=np.uint64), low.levels[0].code)
            rows.append(_table_rows(0, False, unseen, np.full(len(unseen), np.log(gamma[0][0] * BASE)) if len(gamma[0]) else np.full(256, np.log(BASE))))
            small = counts.sparkSession.createDataFrame(pa.Table.from_batches(rows).to_pandas(), SCHEMA)
            out = saved(drawn.unionByName(small), "pitman-yor")
            drop(drawn)
    return out


def _dense(low: Chain, p: dict[int, np.ndarray], gamma: dict[int, np.ndarray]) -> np.ndarray:
    """Probability of each byte after each byte, by (first << 8 | second)."""
    zero = np.full(256, (gamma[0][0] if len(gamma[0]) else 1.0) * BASE)
    zero[low.levels[0].code.astype(np.int64)] = p[0]
    out = np.tile(zero, (256, 1))
    out[low.levels[1].contexts.astype(np.int64)] *= gamma[1][:, None]
    out = out.ravel()
    out[low.levels[1].code.astype(np.int64)] = p[1]
    return out


def language_model_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, log_prob, perplexity) for every row of docs(doc_id, text).

    The model is fitted to the n-grams of all documents of `docs`; perplexity is per byte. Null and empty texts have
    0 bytes, log_prob 0 and no perplexity. A null doc_id stays null, repeated rows are scored (and counted) each, no rows
    give none, other columns are not read. Counts are added up within a partition before they are shuffled; texts
    are not, unless the tables exceed bytegrams.WORKER_MB: then documents meet their n-grams' probabilities by joins.
    """
    base = pruned(docs, "doc_id", "text")
    counts = saved(gram_counts(base), "grams")
    tables = hierarchical_pitman_yor(counts)
    drop(counts)
    found = scored(base, tables, ["doc_id"])
    return found.select("doc_id", "n_bytes", "log_prob", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_prob") / F.col("n_bytes"))).alias("perplexity"))
