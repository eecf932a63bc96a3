"""Quality rules: base statistics and cross-document line frequency.

Lines are normalised (A-Z lower-cased, runs of white space as one space, ends
trimmed) and hashed.  For every host the documents that hold a line are
counted; lines in more than ``line_limit`` documents of one host are removed,
and a document of which too little is left is rejected.

Counting is a partial-then-final aggregate on one 64-bit key of host and line,
so a line that every document of a host shares costs one row per task.  The
lines above the limit are few (at most ``lines / line_limit``); they are joined
back under ``SALTS`` copies so that the rows of one frequent line meet in many
tasks.  The texts themselves are never shuffled.

Edge cases: a null text counts as empty; an empty text has no words and fails
the base rules; a null host is a host of its own; rows that repeat id, host and
text are one document, which counts once and is judged alike in every row; null
ids with different texts are different documents; an empty table gives no rows;
further columns are ignored (:func:`line_quality`) or passed along
(:func:`cleaned`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import (
    BYTE_VALUES,
    BYTE_VALUES_LOWER,
    Block,
    _ODD,
    blocks,
    cut,
    free_names,
    lists,
    mix64,
    small_batches,
    span_hashes,
    sums_at,
    table,
)

#: Production parameters.
LINE_LIMIT = 30
MIN_LEFT_SHARE = 0.3
MIN_LEFT_WORDS = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SALTS = 16

_FIRST_BYTES = (np.arange(256) & 0xC0) != 0x80  # of a code point
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

STATS = "row_key long, doc_id long, host string, h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_no array<int>, line_hash array<long>, line_words array<int>"


def _repeated(hashes: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Per text the words that lie in a 3-word window found twice or more in it."""
    m = len(hashes) - 2
    if m < 1:
        return np.zeros(n, np.int64)
    key = mix64(hashes[:m] * _ODD[0] + hashes[1 : m + 1] * _ODD[1] + hashes[2 : m + 2] * _ODD[2])
    inside = np.flatnonzero(text_of[:m] == text_of[2 : m + 2])
    key = key[inside] ^ mix64(text_of[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(ranked), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    hit = np.zeros(len(hashes), bool)
    for j in range(3):
        hit[at + j] = True
    return np.bincount(text_of[hit], minlength=n)


def block_stats(block: Block) -> dict[str, object]:
    """All columns of ``STATS`` but the keys, for one block."""
    data, n = block.data, block.n
    starts, ends, firsts = block.words()
    counts = np.diff(firsts)
    text_of = np.repeat(np.arange(n), counts)
    exact = span_hashes(data, starts, ends, BYTE_VALUES)
    folded = span_hashes(data, starts, ends, BYTE_VALUES_LOWER)
    to_end, to_start = sums_at(data, _FIRST_BYTES, ends, starts)
    word_sums = np.concatenate(([0], np.cumsum(to_end - to_start)))
    # lines: cut at every line feed and at the ends of the texts
    feeds = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate((block.offsets[:-1], feeds + 1)))
    finish = np.sort(np.concatenate((block.offsets[1:], feeds)))
    line_text = np.repeat(np.arange(n), np.bincount(np.searchsorted(block.offsets, feeds, "right") - 1, minlength=n) + 1)
    line_first = np.searchsorted(starts, begin)
    line_last = np.searchsorted(starts, finish)
    line_no = np.arange(len(begin)) - np.searchsorted(line_text, line_text)
    full = np.flatnonzero(line_last > line_first)
    raw = span_hashes(data, begin[full], finish[full], BYTE_VALUES) ^ mix64(line_text[full].astype(np.uint64) + np.uint64(7))
    norm = span_hashes(folded, line_first[full], line_last[full])
    of = line_text[full]
    distinct = np.zeros(n, np.int64)
    _, first_at = np.unique(raw, return_index=True)
    distinct += np.bincount(of[first_at], minlength=n)
    bounds = np.searchsorted(of, np.arange(n + 1))
    split = lambda x: [x[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return {
        "n_words": counts,
        "word_chars": word_sums[firsts[1:]] - word_sums[firsts[:-1]],
        "n_symbols": block.per_text(_SYMBOLS),
        "n_dup_lines": np.bincount(of, minlength=n) - distinct,
        "n_repeat_words": _repeated(exact, text_of, n),
        "line_no": split(line_no[full].astype(np.int32)),
        "line_hash": split(norm.view(np.int64)),
        "line_words": split((line_last - line_first)[full].astype(np.int32)),
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        texts = batch.column(3)
        for block in blocks(texts):
            s = block_stats(block)
            columns = [pa.array(np.arange(key, key + block.n)), *[batch.column(c).slice(block.first, block.n) for c in range(3)]]
            columns += [pa.array(s[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [lists(pa.int32(), s["line_no"]), lists(pa.int64(), s["line_hash"]), lists(pa.int32(), s["line_words"])]
            key += block.n
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATS.split(", ")])


def line_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    line_limit: int = LINE_LIMIT,
    min_left_share: float = MIN_LEFT_SHARE,
    min_left_words: int = MIN_LEFT_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: statistics, base verdict, removed lines and final verdict."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.xxhash64(text).alias("h"), text.alias("text"))
    stats = cut(small_batches(rows).mapInArrow(_stats, STATS))
    counted = stats
    again = cut(stats.groupBy("host", "doc_id", "h").agg(F.min("row_key").alias("first"), F.count("*").alias("n")).where("n > 1"))
    if not again.isEmpty():  # rows that repeat a document don't count
        listed = again.select(*[F.col(c).alias(f"a_{c}") for c in ("host", "doc_id", "h")], "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("a_salt"))
        same = [F.col(c).eqNullSafe(F.col(f"a_{c}")) for c in ("host", "doc_id", "h")]
        on = same[0] & same[1] & same[2] & (F.pmod(F.xxhash64("row_key"), F.lit(SALTS)) == F.col("a_salt"))
        counted = stats.join(listed, on, "left").where("first IS NULL OR first = row_key")
    key = F.xxhash64(F.coalesce(F.col("host"), F.lit("")), F.col("host").isNull(), F.col("hash")).alias("key")
    frequent = (
        counted.select("host", F.explode(F.array_distinct("line_hash")).alias("hash"))
        .groupBy(key)
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") > line_limit)
        .select("key", "n_docs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    lines = (
        stats.select("row_key", "host", F.explode(F.arrays_zip("line_no", "line_hash", "line_words")).alias("line"))
        .select("row_key", "host", F.col("line.line_hash").alias("hash"), F.col("line.line_no").alias("no"), F.col("line.line_words").alias("words"))
        .select("row_key", key, "no", "words", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int").alias("salt"))
    )
    removed = (
        lines.join(frequent, ["key", "salt"])
        .groupBy("row_key")
        .agg(F.sum("words").alias("removed_words"), F.array_sort(F.collect_list("no")).alias("removed_lines"), F.max("n_docs").alias("most_docs"))
    )
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        stats.drop("line_no", "line_hash", "line_words")
        .join(removed, "row_key", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
        .withColumn("base_failed", failed)
        .withColumn("depleted", (F.col("removed_words") > 0) & ((left < min_left_words) | (left < min_left_share * F.col("n_words"))))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def remove_lines(text: str | Column, removed_lines: str | Column) -> Column:
    """The text without the numbered lines, as a column (feed it the decisions joined to the documents)."""
    text, removed = (F.col(c) if isinstance(c, str) else c for c in (text, removed_lines))
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(removed, i))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(kept, "\n"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits: float) -> DataFrame:
    """``docs`` without rejected rows, and without the removed lines in the texts of the others.

    Rows equal in id, host and text share their decisions, so these are joined
    by hashes of the three; rows that stay as they are meet no decision.
    """
    judged = line_quality(docs, id_col, host_col, text_col, **limits).where("NOT kept OR size(removed_lines) > 0")
    k0, k1, kept, lines = free_names(("_k0", "_k1", "_kept", "_lines"), docs.columns)

    def keys(doc_id: Column, host: Column, h: Column) -> tuple[Column, Column]:
        known = F.concat(doc_id.isNull().cast("string"), host.isNull().cast("string"))
        return F.xxhash64(doc_id, host, h, known), F.xxhash64(F.lit("second"), doc_id, host, h, known)

    of_row = keys(F.col("doc_id"), F.col("host"), F.col("h"))
    judged = judged.groupBy(of_row[0].alias(k0), of_row[1].alias(k1)).agg(F.first("kept").alias(kept), F.first("removed_lines").alias(lines))
    text = F.col(text_col).cast("string")
    own = keys(F.col(id_col).cast("long"), F.col(host_col).cast("string"), F.xxhash64(text))
    joined = docs.join(judged, (own[0] == F.col(k0)) & (own[1] == F.col(k1)), "left").where(F.coalesce(F.col(kept), F.lit(True)))
    done = F.when(F.col(lines).isNull(), text).otherwise(remove_lines(text, F.col(lines)))
    return joined.select(*[done.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rk FROM documents),
w AS (SELECT rk, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
wi AS (SELECT rk, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT rk, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM wi),
rep AS (SELECT rk, i FROM (SELECT rk, i, count(*) OVER (PARTITION BY rk, k) AS c FROM g) WHERE c > 1),
rw AS (SELECT rk, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rk),
l0 AS (SELECT rk, source, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT rk, source, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l0),
l AS (SELECT rk, source, line, array_to_string(ws, ' ') AS norm, len(ws) AS n FROM l1 WHERE len(ws) > 0),
dl AS (SELECT rk, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rk),
fr AS (SELECT source, norm FROM l GROUP BY source, norm HAVING count(DISTINCT rk) > {LINE_LIMIT}),
rm AS (SELECT rk, sum(n) AS n FROM l JOIN fr ON l.source IS NOT DISTINCT FROM fr.source AND l.norm = fr.norm GROUP BY rk),
s AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(rm.n, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (rk) LEFT JOIN dl USING (rk) LEFT JOIN rw USING (rk) LEFT JOIN rm USING (rk)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {MIN_LEFT_WORDS} OR n_words - removed_words < {MIN_LEFT_SHARE} * n_words)) AS kept FROM b
"""
