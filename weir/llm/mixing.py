"""Mixing sources to target weights by capped water-filling.  DataFrame functions only.

Every source has a weight; the targets share the total size of all documents by
weight, none above ``max_epochs`` times its source's size, and what the caps
free is shared again by weight.  Sorted by ``cap / weight`` the level is the
first ``(total - caps before) / (weights from here on)`` that its own cap
allows, so prefix sums over the sources (one row each) replace the iteration.

A source repeats each document ``floor(target / size)`` times; the fraction
that remains is a seeded sample.  Documents are dealt to about ``n / 64``
buckets of their source by a digest of the id (rows that share an id: of id,
text and number, so that a repeated id is no hot bucket).  Whole buckets are
taken in order until the next would exceed the remainder; in that one bucket
documents are taken in digest order wherever they still fit.  Sums run over
runs of buckets and then over the buckets of one run.  So neither sampling nor
summing needs the documents of a source in one task, and a rerun draws the
same documents.

Edge cases: a null text has size 0; null is a source of its own and the last;
an empty table gives no rows; a total of 0 gives targets of 0; null ids are one
id in several rows; equal rows are interchangeable.  A row is taken at most
``max_epochs`` times.  Other columns are ignored (:func:`mix`) or passed along
(:func:`mixed`), whatever their names.  Sources, one row each, are ranked in
one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import WORD, cut, table

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
BUCKET_DOCS = 64
RUN_BUCKETS = 4096
BROADCAST_SOURCES = 10_000
SALTS = 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: n_docs, source_size, weight, target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        sizes.groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
        .withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(whole) - before) / onward)
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
        .select("source", "n_docs", "source_size", "weight", "target")
    )


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, source, size, h, digest) of every row, and the ids that stand in several rows (None: there are none).

    The digest of an id in one row depends on the id alone.  Rows that share
    an id are told apart by a hash of the text, and equal rows by their number,
    so that no digest is common.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            words.alias("size"),
            F.xxhash64(F.col(text_col).cast("string")).alias("h"),
            F.monotonically_increasing_id().alias("row_key"),
        )
    )
    plain = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    again = cut(sizes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return sizes.withColumn("digest", F.md5(plain)).drop("row_key"), None
    salted = sizes.withColumn("salt", F.pmod("row_key", F.lit(SALTS)).cast("int"))
    listed = again.select(F.col("doc_id").alias("again_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("again_salt"))
    on = F.col("doc_id").eqNullSafe(F.col("again_id")) & (F.col("salt") == F.col("again_salt"))
    once = salted.join(listed, on, "left_anti").select("doc_id", "source", "size", "h", F.md5(plain).alias("digest"))
    # equal rows are numbered within the tasks that read them, and those by their totals
    key = ["doc_id", "source", "size", "h", "part"]
    same = salted.join(listed, on, "left_semi").withColumn("part", F.shiftright("row_key", 33))
    by_part = Window.partitionBy(*key[:-1]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = same.groupBy(*key).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"s_{c}") for c in key], "before")
    numbered = same.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("row_key")))
    matched = [F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in key]
    numbered = numbered.join(starts, reduce(lambda x, y: x & y, matched))
    full = F.concat_ws(":", plain, F.col("h").cast("string"), (F.col("before") + F.col("nth")).cast("string"))
    return once.unionByName(numbered.select("doc_id", "source", "size", "h", F.md5(full).alias("digest"))), again


def _key() -> list[Column]:
    """A source as two columns that are never null."""
    return [F.coalesce("source", F.lit("")).alias("skey"), F.col("source").isNull().alias("snull")]


def _bucket(digest: Column, buckets: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets


def _salted(df: DataFrame, plan: DataFrame, salt: Column) -> DataFrame:
    """``df`` (with skey, snull) joined with the plan of its source, in ``SALTS`` places: a source may hold a third of all rows."""
    copies = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(copies, ["skey", "snull", "salt"])


def _plan(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: sizes and target, whole repetitions, number of buckets, the last one taken from and the words left for it."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = cut(
        source_targets(rows, weights, max_epochs)
        .withColumn("whole", F.floor(rate))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_DOCS)).cast("long"))
        .select(*_key(), "source_size", "target", "whole", "rest", "buckets")
    )
    dealt = _salted(rows.select("size", "digest", *_key()), plan, F.xxhash64("digest")).withColumn("bucket", _bucket(F.col("digest"), F.col("buckets")))
    sums = cut(dealt.groupBy("skey", "snull", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")))

    def first_above(sums: DataFrame, place: str) -> DataFrame:
        """Per source the first place up to which more than ``rest`` words stand, and what is left of rest before it."""
        upto = F.sum("words").over(Window.partitionBy("skey", "snull").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        left = F.struct(place, (F.col("rest") - F.col("upto") + F.col("words")).alias("room"))
        found = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("skey", "snull").agg(F.min(left).alias("last"))
        return found.select("skey", "snull", F.col(f"last.{place}").alias(place), F.col("last.room").alias("room"))

    # runs of buckets first, then the buckets of one run: no task sorts more than a run, or all runs, of a source
    runs = sums.withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS)).groupBy("skey", "snull", "run").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    run = first_above(runs, "run").withColumnRenamed("room", "rest")
    inner = sums.drop("rest").withColumn("run", F.floor(F.col("bucket") / RUN_BUCKETS)).join(run, ["skey", "snull", "run"])
    ends = first_above(inner, "bucket").withColumnRenamed("bucket", "last_bucket")
    # a source of size 0 has no last bucket; what it takes is 0 words either way
    return cut(plan.join(ends, ["skey", "snull"], "left").withColumn("last_bucket", F.coalesce("last_bucket", F.lit(-1).cast("long"))))


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    placed = _salted(rows.select("*", *_key()), plan, F.xxhash64("digest")).withColumn("bucket", _bucket(F.col("digest"), F.col("buckets")))
    some = F.col("rest") > 0  # else not even empty texts are taken once more
    kept = ["doc_id", "source", "size", "h", "digest", "source_size", "target", "whole"]
    sure = placed.where(F.col("bucket") != F.col("last_bucket")).select(*kept, (some & (F.col("bucket") < F.col("last_bucket"))).cast("int").alias("extra"))
    doc = "digest:string,doc_id:" + rows.schema["doc_id"].dataType.simpleString() + ",size:bigint,h:bigint"
    start = F.struct(F.first("room").alias("room"), F.array().cast(f"array<struct<{doc},extra:int>>").alias("out"))

    def take(acc: Column, d: Column) -> Column:
        fits = d["size"] <= acc["room"]
        out = F.struct(*[d[c].alias(c) for c in ("digest", "doc_id", "size", "h")], fits.cast("int").alias("extra"))
        return F.struct(F.when(fits, acc["room"] - d["size"]).otherwise(acc["room"]).alias("room"), F.concat(acc["out"], F.array(out)).alias("out"))

    edge = (
        placed.where(F.col("bucket") == F.col("last_bucket"))
        .groupBy("skey", "snull")
        .agg(
            F.array_sort(F.collect_list(F.struct("digest", "doc_id", "size", "h"))).alias("docs"),
            start.alias("start"),
            *[F.first(c).alias(c) for c in ("source", "source_size", "target", "whole", "rest")],
        )
        .select("source", "source_size", "target", "whole", "rest", F.explode(F.aggregate("docs", F.col("start"), take, lambda acc: acc["out"])).alias("d"))
        .select("d.doc_id", "source", "d.size", "d.h", "d.digest", "source_size", "target", "whole", F.when(some, F.col("d.extra")).otherwise(0).alias("extra"))
    )
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return sure.unionByName(edge).withColumn("copies", copies).drop("whole", "extra")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    rows, _ = _rows(docs, id_col, source_col, text_col, seed)
    decided = _decided(rows, _plan(rows, weights, max_epochs))
    return decided.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Where the ids are unique a row knows its bucket, so texts are not sent:
    the plan, one row per source, is broadcast up to ``BROADCAST_SOURCES``
    rows, and only the rows of the last buckets are joined with decisions.
    Rows whose ids repeat are joined with theirs by id, source and text.
    """
    rows, again = _rows(docs, id_col, source_col, text_col, seed)
    plan = _plan(rows, weights, max_epochs)
    decided = _decided(rows, plan)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, copy = "_row", "_copy"
    ident = F.struct(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    held = docs.select(F.struct(*columns).alias(row), ident.alias("k")).select(row, F.col("k.i").alias("doc_id"), F.col("k.s").alias("source"), F.col("k.h").alias("h"))

    def out(df: DataFrame, times: Column) -> DataFrame:
        """Each row ``times`` times."""
        return df.where(times > 0).select(row, F.explode(F.sequence(F.lit(1), times.cast("int"))).alias(copy)).select(f"{row}.*")

    alone = held
    if again is not None:
        listed = again.select(F.col("doc_id").alias("again_id"))
        alone = held.join(listed, F.col("doc_id").eqNullSafe(F.col("again_id")), "left_anti")
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    alone = alone.select(row, "doc_id", *_key(), digest.alias("digest"))
    if plan.count() <= BROADCAST_SOURCES:
        alone = alone.join(F.broadcast(plan), ["skey", "snull"])
    else:
        alone = _salted(alone, plan, F.xxhash64("digest"))
    alone = alone.withColumn("bucket", _bucket(F.col("digest"), F.col("buckets")))
    extra = ((F.col("rest") > 0) & (F.col("bucket") < F.col("last_bucket"))).cast("int")
    made = out(alone.where(F.col("bucket") != F.col("last_bucket")), F.col("whole") + extra)
    edge = alone.where(F.col("bucket") == F.col("last_bucket")).select(row, F.col("digest").alias("own"))
    made = made.unionByName(out(edge.join(decided.select("digest", "copies"), F.col("own") == F.col("digest")), F.col("copies")))
    if again is None:
        return made
    # of m equal rows that are taken t times each is taken t div m times, and one of them t mod m times more
    total = decided.join(again.select(F.col("doc_id").alias("again_id")), F.col("doc_id").eqNullSafe(F.col("again_id")), "left_semi")
    total = cut(total.groupBy("doc_id", "source", "h").agg(F.sum("copies").alias("t"), F.count("*").alias("m")).toDF("t_doc", "t_source", "t_h", "t", "m"))
    on = F.col("doc_id").eqNullSafe(F.col("t_doc")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("h") == F.col("t_h"))
    made = made.unionByName(out(held.join(total, on), F.floor(F.col("t") / F.col("m"))))
    rest = held.join(total.where("t % m > 0"), on).groupBy("t_doc", "t_source", "t_h").agg(F.first(row).alias(row), F.first(F.expr("t % m")).alias("more"))
    return made.unionByName(out(rest, F.col("more")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s0 AS (SELECT source, count(*) AS n, CAST(sum(size) AS BIGINT) AS ss, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w FROM d GROUP BY source),
s1 AS (SELECT *, 3 * ss AS cap, 3 * ss / w AS ratio FROM s0),
s2 AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1),
s3 AS (SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(lv, ratio) FROM s2 WHERE lv <= ratio)) AS target FROM s2),
s AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole, greatest(1, CAST(ceil(n / {BUCKET_DOCS}.0) AS BIGINT)) AS nb FROM s3),
e AS (SELECT d.*, s.ss, s.target, s.whole, s.target - s.whole * s.ss AS rest, CAST('0x' || substr(digest, 1, 8) AS BIGINT) % s.nb AS bucket
   FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
b AS (SELECT source, bucket, sum(size) AS inb, any_value(rest) AS rest FROM e GROUP BY source, bucket),
u AS (SELECT *, sum(inb) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM b),
f AS (SELECT source, min(bucket) AS lb, arg_min(rest - upto + inb, bucket) AS room FROM u WHERE upto > rest GROUP BY source),
p AS (SELECT e.*, coalesce(f.lb, -1) AS lb, f.room FROM e LEFT JOIN f ON e.source IS NOT DISTINCT FROM f.source),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest, doc_id, size) AS k FROM p WHERE bucket = lb),
r AS (SELECT source, doc_id, k, size, room, size <= room AS got FROM q WHERE k = 1
   UNION ALL SELECT q.source, q.doc_id, q.k, q.size, CASE WHEN r.got THEN r.room - r.size ELSE r.room END, q.size <= CASE WHEN r.got THEN r.room - r.size ELSE r.room END
   FROM r JOIN q ON q.source IS NOT DISTINCT FROM r.source AND q.k = r.k + 1)
SELECT p.doc_id, p.size, p.ss AS source_size, p.target,
  CAST(p.size * (p.whole + CASE WHEN p.bucket < p.lb THEN 1 WHEN p.bucket = p.lb AND r.got THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.bucket = p.lb
"""
