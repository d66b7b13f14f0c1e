"""Quality rules as a ledger: each rule is evaluated once, policies and ablations are bit arithmetic afterwards.

The ledger has one row for each document: its measurements and ``fail_bits``, in which bit k is set if rule k fails.
A policy is a named mask of rules; a document is kept under it if ``fail_bits & mask`` is 0. Policies can be added or
changed without reading a text again, and what each rule costs follows from counts by ``fail_bits``.

Null texts count as empty, which fail ``few_words``. Repeated rows and null ids stay as rows of their own, an empty table
gives an empty ledger, other columns are dropped by ``ledger`` and kept by ``keep``. All comparisons are of integers, so
no result hangs on rounding; a value at a limit passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import slices, texts_of, thrifty

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 8

#: Rule names in the order of their bits, with the condition of failure.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("shouting", "n_upper > n_lower"),
)
BASE = 0b11
#: Versions of the policy; the last is the one in production.
POLICIES: dict[str, int] = {"v1": BASE, "v2": BASE | 0b1100, "v3": (1 << len(RULES)) - 1}
PRODUCTION = "v3"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower")


def _repeats(words: list[list[str]]) -> np.ndarray:
    """Words of each text that lie in an 8-word window which the text holds twice or more.

    Windows of 2, 4 and 8 words get exact numbers from pairs of numbers of windows half as long.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros(len(words), np.int64)
    flat = list(chain.from_iterable(words))
    if len(flat) < WINDOW:
        return out
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64)
    span = 1
    while span < WINDOW:
        codes = pd.factorize(codes[:-span] * (int(codes.max()) + 1) + codes[span:])[0].astype(np.int64)
        span *= 2
    doc = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    first = np.flatnonzero(np.arange(len(codes)) + WINDOW <= ends[doc[: len(codes)]])
    keys = pd.factorize(codes[first] * len(words) + doc[first])[0]
    twice = first[np.bincount(keys, minlength=1)[keys] > 1] if len(first) else first
    marks = np.zeros(len(flat) + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(marks[:-1]) > 0], minlength=len(words))


def _measure(texts: list[str]) -> list[np.ndarray]:
    words = [_WORD.findall(t) for t in texts]
    rows = []
    for text, own in zip(texts, words):
        lines = [line for line in text.split("\n") if _WORD.search(line)]
        letters = np.frombuffer(text.encode("ascii", "ignore"), np.uint8)
        rows.append((
            len(own),
            len(text) - sum(map(text.count, " \t\n\v\f\r")),
            sum(map(text.count, "#*$%&|<>")),
            len(lines),
            len(lines) - len(set(lines)),
            int(((letters >= 65) & (letters <= 90)).sum()),
            int(((letters >= 97) & (letters <= 122)).sum()),
        ))
    table = np.array(rows, np.int64).reshape(-1, 7)
    return [*table[:, :5].T, _repeats(words), *table[:, 5:].T]


def _measured(rows: DataFrame, names: list[str], keep_text: bool) -> DataFrame:
    """``rows`` with the measurements of ``text`` under ``names``, and ``names[-1]`` for the failure bits; map-only."""
    fields = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    order = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_measure(part) for part in slices(texts_of(batch.column("text")))]
            columns = [pa.array(np.concatenate(c)) for c in zip(*done)] if done else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in order), *columns], names=[*order, *names[:-1]])

    schema = StructType([*fields, *(StructField(n, LongType()) for n in names[:-1])])
    given = dict(zip(MEASURES, names))
    total = F.lit(0)
    for k, (_, fails) in enumerate(RULES):
        fails = re.sub(r"\bn_\w+|\bword_chars", lambda m: f"`{given[m[0]]}`", fails)
        total = total.bitwiseOR(F.when(F.expr(fails), 1 << k).otherwise(0))
    return rows.mapInArrow(thrifty(run), schema).withColumn(names[-1], total)


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits`` of each document."""
    return _measured(docs.select("doc_id", "text"), [*MEASURES, "fail_bits"], keep_text=False)


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written: every policy and every ablation reads this table, none a text."""
    return materialize(ledger(docs), "ledger")


def apply_policy(rows: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("fail_bits").bitwiseAND(mask) == 0)


def ablations(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """What each policy rejects, and what it would keep if one rule were left out.

    ``policy, rule, rejected, rule_fails, rescued``; only counts by ``fail_bits`` (64 values at most) meet the policies.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plan = [(p, RULES[k][0], mask, 1 << k) for p, mask in (policies or POLICIES).items() for k in range(len(RULES)) if mask >> k & 1]
    table = spark.createDataFrame(plan, "policy string, rule string, mask int, bit int")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (
        counts.join(F.broadcast(table), hit != 0)
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("rejected"),
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("rule_fails"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("rescued"),
        )
    )


def judge(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The stored ledger with ``base_failed`` and the policy's verdict ``kept``."""
    rows = stored(docs).withColumn("base_failed", F.col("fail_bits").bitwiseAND(BASE) != 0)
    return apply_policy(rows, POLICIES[policy] | BASE)


def keep(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the policy keeps; each row is judged by its own text."""
    stem = "_q"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "_"
    names = [f"{stem}{k}" for k in range(len(MEASURES) + 1)]
    rows = _measured(docs, names, keep_text=True)
    return rows.filter(F.col(names[-1]).bitwiseAND(POLICIES[policy] | BASE) == 0).select(*(f"`{c}`" for c in docs.columns))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(8)) AS k FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
             + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
             + 32 * (n_upper > n_lower)::INT) AS fail_bits FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


_POLICY_ROWS = ", ".join(f"('{name}', {mask})" for name, mask in (("v1", 3), ("v2", 15), ("v3", 63)))
_RULE_ROWS = ", ".join(f"('{name}', {1 << k})" for k, name in enumerate(("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting")))
ABLATIONS_SQL = f"""
SELECT policy, rule, count(*) FILTER (fail_bits & mask <> 0) AS rejected, count(*) FILTER (fail_bits & bit <> 0) AS rule_fails, count(*) FILTER (fail_bits & mask = bit) AS rescued
FROM ({SQL}) q, (VALUES {_POLICY_ROWS}) p(policy, mask), (VALUES {_RULE_ROWS}) r(rule, bit) WHERE mask & bit <> 0 GROUP BY policy, rule HAVING count(*) FILTER (fail_bits & mask <> 0) > 0
"""
