"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger stores a text's measurements and, in ``rule_bits``, one bit a
failed rule. Policies are versioned masks over those bits, so another policy, or the effect of leaving
a rule out, costs no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gneiss.llm.frames import kept
from gneiss.llm.words import words
from gneiss.session import ship

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rule name -> the failure condition: factor * measure, sign, factor * measure (or a number). A rule's bit is its place here.
RULES = {
    "few_words": (1, "n_words", "<", 10, None),
    "repeated_windows": (100, "n_repeat_words", ">", 20, "n_words"),
    "symbols": (10, "n_symbols", ">", 1, "n_words"),
    "repeated_lines": (10, "n_dup_lines", ">", 3, "n_lines"),
    "short_words": (1, "word_chars", "<", 3, "n_words"),
    "long_words": (1, "word_chars", ">", 12, "n_words"),
}
#: Policy version -> the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
DEFAULT_POLICY = "v2"


def repeat_words(w: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in ``w``, first occurrences included."""
    n = len(w)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(x, len(seen)) for x in w), dtype=np.uint64, count=n)
    m = n - WINDOW + 1
    mix = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
    h = reduce(np.add, (ids[k : k + m] * np.uint64(c) for k, c in enumerate(mix)))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    new = np.concatenate([[True], ~same])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    grouped = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    at, of = order[grouped], first[grouped]
    if not all(np.array_equal(ids[at + k], ids[of + k]) for k in range(WINDOW)):  # a hash collision: count the windows themselves
        own: dict[tuple, list[int]] = {}
        for i in at.tolist():
            own.setdefault(tuple(ids[i : i + WINDOW].tolist()), []).append(i)
        at = np.array([i for v in own.values() if len(v) > 1 for i in v], dtype=np.int64)
    marks = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + WINDOW, minlength=n + 1)[: n + 1]
    return int((np.cumsum(marks)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text; zeros for null."""
    w = words(text)
    if not w:
        return (0, 0, sum(map(text.count, SYMBOLS)) if text else 0, 0, 0, 0)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\f")]
    return (len(w), len(text) - sum(map(text.count, " \t\n\x0b\f\r")), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeat_words(w))


def condition(rule: str) -> str:
    """A rule's failure condition in SQL over the measurements."""
    a, left, sign, b, right = RULES[rule]
    return f"{a} * {left} {sign} {b}" + (f" * {right}" if right else "")


def measured(texts: pa.Array) -> np.ndarray:
    """(texts, MEASURES and then rule_bits), each rule evaluated once."""
    found = np.array([measure(t.as_py()) for t in texts], dtype=np.int64).reshape(len(texts), len(MEASURES))
    column = dict(zip(MEASURES, found.T)) | {None: 1}
    bits = np.zeros(len(texts), dtype=np.int64)
    for k, (a, left, sign, b, right) in enumerate(RULES.values()):
        x, y = a * column[left], b * column[right]
        bits |= (x < y if sign == "<" else x > y).astype(np.int64) << k
    return np.column_stack([found, bits])


def mask(policy: str = DEFAULT_POLICY) -> int:
    """The bits of the rules that reject under a policy."""
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def passes(policy: str = DEFAULT_POLICY, bits: str = "rule_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0


def ledger(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, the MEASURES (long) and ``rule_bits`` (long), a row for each row of ``docs``; no shuffle.

    Null, empty and white-space texts measure as zero words and so fail ``few_words``. Repeated rows give
    repeated rows. Columns of ``docs`` outside ``carry`` are not read, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *(pa.array(x) for x in measured(b.column("_text")).T)], names=names)

    src = docs.select(*carry, F.col(text_col).cast("string").alias("_text"))
    names = [*carry, *MEASURES, "rule_bits"]
    schema = StructType([*(f for f in src.schema.fields if f.name != "_text"), *(StructField(m, LongType()) for m in names[len(carry) :])])
    return src.mapInArrow(run, schema)


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """rule, n_failed, n_only (rejected by this rule alone, so kept without it), n_docs: one row a rule.

    The ledger is first counted by its bits, which leaves at most 2^rules rows whatever its size.
    """
    by_bits = rows.groupBy("rule_bits").agg(F.count("*").alias("n"))
    m = mask(policy)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if r in POLICIES[policy]])).alias("r")
    bit = F.col("r.bit")
    failed = F.col("rule_bits").bitwiseAND(bit) != 0
    only = F.col("rule_bits").bitwiseAND(F.lit(m)) == bit
    return by_bits.select("rule_bits", "n", rules).groupBy("r.rule").agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"), F.sum("n").alias("n_docs")
    )


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with the columns of ``docs``.

    Null and empty texts have no words and go, under every policy here. Repeated rows stay or go together.
    """
    rejecting = mask(policy)
    return kept(docs, text_col, lambda texts: measured(texts)[:, -1] & rejecting == 0)


#: The same in DuckDB, over the view ``documents``.
LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 THEN 1 ELSE 0 END AS twice FROM g),
v AS (SELECT r, i, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM c),
n AS (SELECT r, sum(covered) AS n_repeat_words FROM v GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN n USING (r) LEFT JOIN l USING (r))
"""


def query_sql(policy: str = DEFAULT_POLICY) -> str:
    """DuckDB SQL of the registered query."""
    fails = lambda names: " OR ".join(f"({condition(r)})" for r in names)
    return LEDGER_SQL + f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({fails(POLICIES['base'])}) AS base_failed, NOT ({fails(POLICIES['base'] + POLICIES[policy])}) AS kept FROM m"


def ablation_sql(policy: str = DEFAULT_POLICY) -> str:
    """DuckDB SQL of ``ablations`` over the ledger of ``documents``."""
    fails = {r: f"({condition(r)})" for r in POLICIES[policy]}
    rows = [f"SELECT '{r}' AS rule, CAST(count(*) FILTER ({f}) AS BIGINT) AS n_failed, CAST(count(*) FILTER ({' AND '.join([f, *(f'NOT {g}' for q, g in fails.items() if q != r)])}) AS BIGINT) AS n_only, CAST(count(*) AS BIGINT) AS n_docs FROM m" for r, f in fails.items()]
    return LEDGER_SQL + " UNION ALL ".join(rows)
