"""Quality rules: one table of thresholds, compiled into one projection (and into the same SQL)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import pruned

STOP = (
    "the of and to a in is it that was for on be with as are this by at from "
    "de la le les et des un une est que qui dans pour sur au par avec "
    "der die das und ist nicht ein eine zu den von mit sich des auf für im "
    "el los las en por con para del al se lo su una no"
).split()
SPACE = r"[ \t\n\r]+"

#: Whole numbers measured of a text `t`, its words `w` and its lines `l`: name -> (Spark SQL, DuckDB SQL).
MEASURES = {
    "n_chars_all": ("length(t)", "length(t)"),
    "n_words": ("size(w)", "len(w)"),
    "n_lines": ("size(l)", "len(l)"),
    "n_word_chars": (
        "length(regexp_replace(t, '[ \\\\t\\\\n\\\\r]+', ''))",
        r"length(regexp_replace(t, '[ \t\n\r]+', '', 'g'))",
    ),
    "n_symbols": (
        "length(t) - length(translate(t, '#$%&*|!@~^<>{}=+', ''))",
        "length(t) - length(translate(t, '#$%&*|!@~^<>{}=+', ''))",
    ),
    "n_capitals": (
        "length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
        "length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))",
    ),
    "n_digits": ("length(t) - length(translate(t, '0123456789', ''))", "length(t) - length(translate(t, '0123456789', ''))"),
    "n_stop": ("size(filter(w, x -> lower(x) IN ({stop})))", "len(list_filter(w, lambda x: lower(x) IN ({stop})))"),
    "n_distinct_words": ("size(array_distinct(w))", "len(list_distinct(w))"),
    "n_repeats": ("size(filter(w, (x, i) -> i > 0 AND x = w[i - 1]))", "len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1]))"),
    "n_distinct_lines": ("size(array_distinct(l))", "len(list_distinct(l))"),
    "n_dotted_lines": ("size(filter(l, x -> x LIKE '%...'))", "len(list_filter(l, lambda x: x LIKE '%...'))"),
    "n_bullet_lines": (
        "size(filter(l, x -> x LIKE '- %' OR x LIKE '* %' OR x LIKE '• %'))",
        "len(list_filter(l, lambda x: x LIKE '- %' OR x LIKE '* %' OR x LIKE '• %'))",
    ),
}


@dataclass(frozen=True)
class Rule:
    """`part` lies within [low, high] per mille of `whole` (or of 1, where whole is None), once `whole` reaches `least`."""

    name: str
    part: str
    whole: str | None
    low: int
    high: int | None
    least: int = 1


#: The table. Bounds are per mille; those without `whole` are counts times 1000.
TABLE = (
    Rule("length", "n_words", None, 1_000, 100_000_000_000),
    Rule("mean_word_length", "n_word_chars", "n_words", 2_000, 15_000, 20),
    Rule("symbols_to_words", "n_symbols", "n_words", 0, 250, 5),
    Rule("capitals_to_chars", "n_capitals", "n_chars_all", 0, 400, 40),
    Rule("digits_to_chars", "n_digits", "n_chars_all", 0, 300, 120),
    Rule("stop_to_words", "n_stop", "n_words", 20, None, 50),
    Rule("distinct_to_words", "n_distinct_words", "n_words", 50, None, 50),
    Rule("repeats_to_words", "n_repeats", "n_words", 0, 200, 10),
    Rule("distinct_to_lines", "n_distinct_lines", "n_lines", 300, None, 8),
    Rule("dotted_to_lines", "n_dotted_lines", "n_lines", 0, 300, 8),
    Rule("bullets_to_lines", "n_bullet_lines", "n_lines", 0, 900, 8),
)


def _stop() -> str:
    return ", ".join(f"'{s}'" for s in dict.fromkeys(STOP))


def _passes(r: Rule) -> str:
    """As SQL that both engines read; only whole numbers, so that nothing is rounded."""
    of = r.whole or "1"
    part = f"CAST({r.part} AS BIGINT) * 1000"
    both = [f"{part} >= CAST({r.low} AS BIGINT) * {of}"] + ([f"{part} <= CAST({r.high} AS BIGINT) * {of}"] if r.high is not None else [])
    return (f"({r.whole} < {r.least} OR (" if r.whole else "((") + " AND ".join(both) + "))"


def quality_rules(docs: DataFrame, table: tuple[Rule, ...] = TABLE) -> DataFrame:
    """(doc_id, each measure, failed, keep) for every row of docs(doc_id, text).

    One narrow projection over the scan: no shuffle, no Python. Null text is measured like ''; it has no word and
    fails `length`. A null doc_id stays null; repeated rows are judged one by one; other columns are not read.
    Ratios are compared as whole numbers. `failed` lists the failing rules in the table's order, '' if none.
    """
    base = pruned(docs, "doc_id", "text").select("doc_id", F.expr("coalesce(text, '')").alias("t"))
    split = base.select(
        "doc_id",
        "t",
        F.expr("filter(split(t, '[ \\\\t\\\\n\\\\r]+'), x -> x <> '')").alias("w"),
        F.expr("filter(split(t, '\\\\n'), x -> x <> '')").alias("l"),
    )
    measured = split.select("doc_id", *[F.expr(s.replace("{stop}", _stop())).cast("long").alias(n) for n, (s, _) in MEASURES.items()])
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_passes(r)} THEN '{r.name}' END" for r in table) + ")"
    return measured.select("*", F.expr(failed).alias("failed")).select("*", (F.col("failed") == "").alias("keep"))


def quality_rules_sql(table: tuple[Rule, ...] = TABLE) -> str:
    measures = ", ".join(f"CAST({s.replace("{stop}", _stop())} AS BIGINT) AS {n}" for n, (_, s) in MEASURES.items())
    failed = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {_passes(r)} THEN '{r.name}' END" for r in table) + ")"
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\r]+'), lambda x: x <> '') AS w,
          list_filter(string_split(t, chr(10)), lambda x: x <> '') AS l FROM base),
measured AS (SELECT doc_id, {measures} FROM split),
judged AS (SELECT *, {failed} AS failed FROM measured)
SELECT *, failed = '' AS keep FROM judged"""
