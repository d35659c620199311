"""Byte n-grams: counting them, and scoring texts by back-off tables, loaded where they are small and joined where not."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks
from .work import saved

ORDER = 5
PAD = b"\n" * (ORDER - 1)
#: Bytes worked on at once, about.
PIECE = 1 << 20


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, as a number (first byte highest), and the text it belongs to.
    Before a text there are line ends."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(PAD + PAD.join(raw), np.uint8).astype(np.uint64)
    inside = np.ones(len(b), bool)
    ends = np.cumsum(size + len(PAD))
    for j in range(len(PAD)):
        inside[ends - size - len(PAD) + j] = False
    code = np.zeros(len(b) - len(PAD), np.uint64)
    for j in range(ORDER):
        code = code << np.uint64(8) | b[j : len(b) - len(PAD) + j]
    return code[inside[len(PAD) :]], np.repeat(np.arange(len(raw)), size)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(key) else n


def pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    for i in range(0, len(column), 1024):
        for j, part in chunks(column.slice(i, 1024).to_pylist(), PIECE):
            yield i + j, part


class Tally:
    """n-gram counts of texts, merged whenever they have become many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: list[str]) -> None:
        key, n = np.unique(codes(texts)[0], return_counts=True)
        self.parts.append((key, n))
        self.size += len(key)
        if self.size > 4_000_000:
            self.parts = [merged(self.parts)]
            self.size = len(self.parts[0][0])
            # What stays distinct may itself be large: merging again waits until it has doubled.
            self.size = 0 if self.size > 2_000_000 else self.size

    def held(self) -> int:
        return sum(len(key) for key, _ in self.parts)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.parts) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Tables:
    """Back-off tables: of each level (bytes of context) the log probabilities of n-grams seen and the log weights of
    contexts seen. An n-gram that isn't there gets its context's weight (1 if that isn't there either) times the
    probability after a context shorter by the first byte; at level 0 every byte has a probability."""

    def __init__(self, level: np.ndarray, is_context: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.grams, self.contexts = [], []
        for m in range(ORDER):
            for own, out in ((~is_context, self.grams), (is_context, self.contexts)):
                pick = np.flatnonzero(own & (level == m))
                pick = pick[np.argsort(code[pick])]
                out.append((code[pick], value[pick]))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = table
        if not len(keys):
            return np.zeros(len(code), bool), np.zeros(len(code))
        i = np.searchsorted(keys, code)
        i[i == len(keys)] = 0
        return keys[i] == code, values[i]

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """Of distinct n-grams in ascending order."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for m in range(ORDER - 1, -1, -1):
            own = code[todo] & np.uint64((1 << 8 * (m + 1)) - 1)
            have, value = self._find(self.grams[m], own)
            out[todo[have]] += value[have]
            todo, own = todo[~have], own[~have]
            if not len(todo):
                break
            have, value = self._find(self.contexts[m], own >> np.uint64(8))
            out[todo[have]] += value[have]
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities and number of bytes of each text."""
        code, doc = codes(texts)
        own, back = np.unique(code, return_inverse=True)
        n = len(texts)
        return np.bincount(doc, weights=self.log_prob(own)[back], minlength=n).astype(float), np.bincount(doc, minlength=n)


#: MB of tables up to which every worker loads them; beyond, the documents' n-grams are joined with them.
WORKER_MB = 256
#: Code points of the documents that meet their n-grams' probabilities in one group.
PART = 1 << 24
_TABLES: dict[str, dict[str, Tables]] = {}


def load_tables(uri: str) -> dict[str, Tables]:
    """The tables that a written DataFrame (lang, level, is_context, code, value) holds, once in each worker."""
    if uri not in _TABLES:
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        t = ds.dataset(root, filesystem=store, format="parquet").to_table()
        lang = t.column("lang").to_pandas().fillna("").to_numpy(str)
        level, ctx, code, value = (np.asarray(t.column(c)) for c in ("level", "is_context", "code", "value"))
        code = code.view(np.uint64)
        _TABLES.clear()
        _TABLES[uri] = {str(k): Tables(*(x[lang == k] for x in (level, ctx, code, value.astype(np.float32)))) for k in np.unique(lang)}
    return _TABLES[uri]


def table_uri(df: DataFrame) -> str:
    return df._lexweave_path


def scored(docs: DataFrame, tables: DataFrame, keep: list[str], lang: str | None = None, worker_mb: int = WORKER_MB) -> DataFrame:
    """docs' columns `keep`, n_bytes and log_prob (the sum over the text's bytes) of each row of docs(text, ...).

    `lang` names the column of `keep` that picks the tables (null is ''), without one these are those of ''. log_prob is 0 for a
    text without bytes and null where its language has no tables. `tables` is a written table; if it was counted and takes
    worker_mb at most (16 bytes a row), every worker loads it, else `joined_scores` is the way."""
    if tables.count() * 16 <= worker_mb << 20:
        return _loaded_scores(docs, table_uri(tables), keep, lang)
    return joined_scores(docs, tables, keep, lang)


def _schema(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_bytes bigint, log_prob double"


def _rows(b: pa.RecordBatch, i: int, n: int, first: int, keep: list[str], size: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    cols = [b.column(first + j).slice(i, n) for j in range(len(keep))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(size), pa.array(value, mask=np.isnan(value))], names=[*keep, "n_bytes", "log_prob"])


def _languages(column: pa.Array | None, n: int) -> np.ndarray:
    return np.array([x or "" for x in column.to_pylist()] if column is not None else [""] * n, object)


def _by_language(part: list[str], own: np.ndarray, score) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and log probability of texts; score(language, texts) gives both, or None if there are no tables."""
    size, value = np.array([len(t.encode("utf-8", "replace")) for t in part], np.int64), np.full(len(part), np.nan)
    for k in {x for x in own}:
        where = np.flatnonzero(own == k)
        found = score(k, [part[j] for j in where])
        if found is not None:
            value[where] = found
    return size, value


def _loaded_scores(docs: DataFrame, uri: str, keep: list[str], lang: str | None) -> DataFrame:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = load_tables(uri)
        for b in batches:
            langs = _languages(b.column(1 + keep.index(lang)) if lang else None, b.num_rows)
            for i, part in pieces(b.column(0)):
                size, value = _by_language(part, langs[i : i + len(part)], lambda k, texts: tables[k].score(texts)[0] if k in tables else None)
                yield _rows(b, i, len(part), 1, keep, size, value)

    return docs.select("text", *keep).mapInArrow(score, _schema(docs, keep))


def resolved(asked: DataFrame, tables: DataFrame) -> DataFrame:
    """(lang, code, value): the log probability of each of asked(lang, code), by joins with the sharded tables: at each level
    what is found leaves, the rest takes its context's weight along to the level below. Languages without tables are left out."""
    rest, found = asked.select("lang", "code", F.lit(0.0).alias("weight")), []
    for m in range(ORDER - 1, -1, -1):
        own = F.col("code").bitwiseAND((1 << 8 * (m + 1)) - 1)
        table = lambda ctx, name: tables.where((F.col("level") == m) & (F.col("is_context") == ctx)).select(F.col("lang"), F.col("code").alias("own"), F.col("value").alias(name))  # noqa: B023, E731
        hit = saved(rest.withColumn("own", own).join(table(False, "gram"), ["lang", "own"], "left").select("lang", "code", "weight", "gram"), "hits")
        found.append(hit.where("gram IS NOT NULL").select("lang", "code", (F.col("weight") + F.col("gram")).alias("value")))
        miss = hit.where("gram IS NULL").withColumn("own", F.shiftrightunsigned(own, 8))
        rest = miss.join(table(True, "more"), ["lang", "own"], "left").select("lang", "code", (F.col("weight") + F.coalesce("more", F.lit(0.0))).alias("weight"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def joined_scores(docs: DataFrame, tables: DataFrame, keep: list[str], lang: str | None = None, part: int = PART) -> DataFrame:
    """As `scored`, without a whole table in any task: documents are dealt to parts of about `part` code points, whatever
    they hold; each part asks once for each of its n-grams, these are resolved by sharded joins, and a part's answers meet its
    documents in one group."""
    own = docs.select("text", *keep)
    total = own.agg(F.sum(F.length("text").cast("long")).alias("n")).head()["n"] or 0
    dealt = saved(own.withColumn("_part", F.floor(F.rand(7) * F.lit(max(1, -(-total // part))))), "dealt")  # written: the same for both uses
    at = 2 + keep.index(lang) if lang else None

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, langs = np.asarray(b.column(0)), _languages(b.column(at) if lang else None, b.num_rows)
            for i, texts in pieces(b.column(1)):
                code, doc = codes(texts)
                for p, k in {x for x in zip(where[i : i + len(texts)].tolist(), langs[i : i + len(texts)].tolist(), strict=True)}:
                    mine = np.flatnonzero((where[i : i + len(texts)] == p) & (langs[i : i + len(texts)] == k))
                    c = np.unique(code[np.isin(doc, mine)]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), p)), pa.array([k] * len(c), pa.string()), pa.array(c)], names=["_part", "lang", "code"])

    asked = saved(dealt.select("_part", "text", *keep).mapInArrow(ask, "_part bigint, lang string, code bigint").distinct(), "asked")
    answers = asked.join(resolved(asked.select("lang", "code").distinct(), tables), ["lang", "code"]).select("_part", F.col("lang").alias("_lang"), "code", "value")

    def score(texts: pa.Table, given: pa.Table) -> pa.Table:
        langs, code, value = np.array(given.column("_lang").to_pylist(), object), np.asarray(given.column("code")).view(np.uint64), np.asarray(given.column("value"))
        by = {}
        for k in set(langs.tolist()):
            pick = np.flatnonzero(langs == k)
            pick = pick[np.argsort(code[pick])]
            by[k] = (code[pick], value[pick])

        def of(k: str, part: list[str]) -> np.ndarray | None:
            c, doc = codes(part)
            if k not in by:
                return np.zeros(len(part)) if k in known and not len(c) else None
            i = np.searchsorted(by[k][0], c)
            return np.bincount(doc, weights=by[k][1][i], minlength=len(part)).astype(float)

        out = []
        for b in texts.combine_chunks().to_batches():
            own = _languages(b.column(at) if lang else None, b.num_rows)
            for i, part in pieces(b.column(1)):
                size, value_ = _by_language(part, own[i : i + len(part)], of)
                out.append(_rows(b, i, len(part), 2, keep, size, value_))
        return pa.Table.from_batches(out)

    known = {r["lang"] or "" for r in tables.select("lang").distinct().collect()}  # languages: few
    sides = dealt.select("_part", "text", *keep).groupBy("_part"), answers.groupBy("_part")
    return sides[0].cogroup(sides[1]).applyInArrow(score, _schema(docs, keep))
