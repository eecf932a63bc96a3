"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, as components.

Prefix filtering: two sets with Jaccard similarity of at least ``percent`` share
an n-gram among their first ``n - ceil(percent * n / 100) + 1``, in any order
common to all documents.  The order is rare-first, by a count sketch over all
shingles, ties by hash.  Pairs that meet on a prefix n-gram pass
a length filter, a positional filter and a suffix filter (a lower bound of the
symmetric difference: the sets are dealt to parity bits, ``64 * WORDS`` for
every set and for a larger one about as many as it has members, and each
difference changes one bit at most) and are then verified once, exactly.

Documents with equal sets are one class; only classes are joined.  Within a
prefix n-gram not all pairs are made:

1. each class meets up to ``PIVOTS`` pivots of its n-gram (other pivots for
   every n-gram); the verified links give first components;
2. what remains are pairs across components.  For each n-gram, the members
   outside its largest component meet the members of other components that have
   a like size (equal or neighbouring size bins), and the filters are part of
   the join condition.

A pair inside a component can't change the components, so they are exact after
two steps.  With ``all_links`` (op2_jaccard) a third counts the links inside:

3. every link is within a component, so the sets of a component's classes are
   compared run against run, those of sizes that may link; see
   :func:`linked_rows`.  No pairs are made, only sums by class.

Components come from alternating large-star and small-star steps.

Texts are read, never shuffled: the passes send sketches, prefixes, and the
sets of those classes that occur in pairs (found by a Bloom filter; its false
positives only cost traffic).  What reaches the driver is the sketch and the
Bloom filter; both are sized by the table, within fixed bounds.  Beyond them
the order is less exactly rare-first and more sets are sent; the result is the
same.

Edge cases: documents without words or text have an empty set and link with
nothing; fewer words than ``width`` make one shingle of the whole sequence;
rows are documents, so a repeated row links with its copies and counts in
n_links; equal ids are one id in the result; a null id never becomes a
component's id unless the component has no other; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import blocks, cut, free_names, lists, mix64, shingle_sets, small_batches, table

MIN_SKETCH, MAX_SKETCH = 20, 24
CHUNK = 1 << 14
LEVELS = 4096
WORDS = 8
PIVOTS = 3
RUN = 512
RUN_TOKENS = 1 << 19
SLICE = 4096
JOIN_SALTS = 16
HUB_SALTS = 64
MIN_BLOOM, MAX_BLOOM = 26, 29

FACTS = "row_key long, doc_id long, k0 long, k1 long, n int, s0 long, s1 long, parity array<long>, wide array<long>, part int, chunk int, counts binary"
_SALTS = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    a, b = (int(mix64(s ^ x).sum(dtype=np.uint64)) for x in _SALTS)
    return a - (1 << 64 if a >> 63 else 0), b - (1 << 64 if b >> 63 else 0)


def _parity(s: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Parities of the members dealt to ``64 * words`` bits (a power of two); halves fold onto each other by XOR."""
    bits = np.bincount((s >> np.uint64(23)).astype(np.int64) & (64 * words - 1), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _wide(s: np.ndarray) -> list[int] | None:
    """Parities of a set of more members than the short ones have bits."""
    if len(s) <= 64 * WORDS:
        return None
    words = WORDS
    while 64 * words < len(s):
        words *= 2
    return _parity(s, words).tolist()


def sketch_size(df: DataFrame) -> int:
    """Buckets of the count sketch by the optimizer's estimate of the table's bytes, a power of two between the bounds."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = size < 1 << 60
    return 1 << min(MAX_SKETCH, max(MIN_SKETCH, (size >> 10).bit_length() if known else 0))


def _facts(width: int, sketch: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key = part << 40
        counts = np.zeros(sketch, np.uint32)
        names = [c.split()[0] for c in FACTS.split(", ")]
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, width)
                if any(map(len, sets)):
                    at, many = np.unique(np.concatenate(sets) & np.uint64(sketch - 1), return_counts=True)
                    counts[at.astype(np.int64)] += many.astype(np.uint32)
                sigs = [_signature(s) for s in sets]
                n = block.n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(key, key + n)),
                        *[batch.column(c).slice(block.first, n) for c in (0, 2, 3)],
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([s[0] for s in sigs], pa.int64()),
                        pa.array([s[1] for s in sigs], pa.int64()),
                        lists(pa.int64(), [_parity(s) for s in sets]),
                        pa.array([_wide(s) for s in sets], pa.list_(pa.int64())),
                        *[pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary())],
                    ],
                    names=names,
                )
                key += n
        used = [c for c in range(sketch // CHUNK) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        if used:
            packed = [zlib.compress(counts[c * CHUNK : (c + 1) * CHUNK].astype(np.uint64).tobytes(), 1) for c in used]
            none = [pa.nulls(len(used), t) for t in (*[pa.int64()] * 4, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*none, pa.array([part] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def _levels(facts: DataFrame, sketch: int) -> np.ndarray:
    """Rank of every sketch bucket among ``LEVELS`` quantiles; sums run on the executors, at most 256 parts at once."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint64)
        for raw in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(raw), np.uint64)
        return pd.DataFrame({"part": pdf["part"].iloc[:1] // 256, "chunk": pdf["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "part int, chunk int, counts binary"
    rows = facts.where("chunk IS NOT NULL").select("part", "chunk", "counts")
    rows = rows.groupBy("chunk", F.floor(F.col("part") / 256).alias("g")).applyInPandas(lambda k, pdf: add(pdf), schema)
    sums = np.zeros(sketch, np.uint64)
    for r in rows.groupBy("chunk").applyInPandas(lambda k, pdf: add(pdf), schema).collect():  # sketch / CHUNK rows
        sums[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    cuts = np.quantile(sums, np.arange(1, LEVELS) / LEVELS)
    return np.searchsorted(cuts, sums).astype(np.uint16)


def _prefixes(width: int, percent: int, levels, sketch: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = levels.value, set()
        for batch in batches:
            for block in blocks(batch.column(0)):
                sigs, prefixes = [], []
                for s in shingle_sets(block, width):
                    if not len(s) or (sig := _signature(s)) in seen:
                        continue
                    seen.add(sig)
                    n = len(s)
                    size = n + (-percent * n // 100) + 1
                    key = (level[(s & np.uint64(sketch - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(52)) | (s >> np.uint64(12))
                    first = np.argpartition(key, size - 1)[:size]
                    prefixes.append(s[first[np.argsort(key[first], kind="stable")]].view(np.int64))
                    sigs.append(sig)
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sigs], pa.int64()), pa.array([s[1] for s in sigs], pa.int64()), lists(pa.int64(), prefixes)], names=["s0", "s1", "tokens"])

    return run


def _bloom_positions(s0: np.ndarray, s1: np.ndarray, ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each (signature, id)."""
    h = mix64(s0.view(np.uint64) ^ mix64(s1.view(np.uint64) + ids.view(np.uint64)))
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter over (s0, s1, rep_doc), about 16 bits a member between the bounds."""
    size = 1 << min(MAX_BLOOM, max(MIN_BLOOM, (16 * wanted.count()).bit_length()))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2).fill_null(0)
            bits = np.unique(np.concatenate(_bloom_positions(*[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (batch.column(0), batch.column(1), ids)], size)))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 5), pa.array(np.int64(1) << (bits & 31))], names=["word", "bit"])

    words = wanted.select("s0", "s1", "rep_doc").mapInArrow(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _sets(width: int, bloom):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for batch in batches:
            ids = batch.column(0)
            own = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, width)
                sigs = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
                hit = np.array([len(s) > 0 for s in sets], bool)
                for bits in _bloom_positions(sigs[:, 0].copy(), sigs[:, 1].copy(), own[block.first : block.first + block.n], 32 * len(words)):
                    hit &= (words[bits >> 5] >> (bits & 31).astype(np.uint32) & 1).astype(bool)
                at = np.flatnonzero(hit)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at + block.first)), pa.array(sigs[at, 0]), pa.array(sigs[at, 1]), lists(pa.int64(), [sets[k].view(np.int64) for k in at.tolist()])],
                        names=["doc_id", "s0", "s1", "tokens"],
                    )

    return run


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of their u.

    The edges of a hub are split by ``HUB_SALTS`` values of v: the least of each
    is found first, then of these at most ``HUB_SALTS`` rows, and only salts
    that occur are joined back.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int")).repartition("u", "salt")
    low = salted.groupBy("u", "salt").agg(F.min("v").alias("least")).select("u", "salt", F.min("least").over(Window.partitionBy("u")).alias("m"))
    return salted.join(low, ["u", "salt"]).select("u", "v", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Steps end when the edges (u, v), u > v, are stars: every u has one v, and no v is a u.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 OR up = 1 AND n > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(small.select("e.u", "e.v").where("u <> v").distinct())


def _may_link(percent: int, na: Column, nb: Column) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _size_bin(percent: int, n: Column) -> Column:
    """Sets that may link are in one bin or in neighbouring ones."""
    return n if percent >= 100 else F.floor(F.log(n) / F.lit(-math.log(percent / 100) * 1.000001)).cast("int")


def _position(percent: int, na: Column, nb: Column, pa_: Column, pb: Column) -> Column:
    most = F.least(pa_, pb) + 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 + percent) * most >= percent * (na + nb)


def _suffix(percent: int, na: Column, nb: Column, xa: Column, xb: Column) -> Column:
    apart = sum((F.bit_count(xa[k].bitwiseXOR(xb[k])) for k in range(1, WORDS)), F.bit_count(xa[0].bitwiseXOR(xb[0])))
    return (100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb)


def _wide_suffix(percent: int, na: Column, nb: Column, xa: Column, xb: Column) -> Column:
    """The suffix filter on wide parities; their lengths are equal or, by the length filter, one fold apart."""

    def fold(x: Column, size: Column) -> Column:
        halves = F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > size, halves).otherwise(x)

    size = F.least(F.size(xa), F.size(xb))
    apart = F.aggregate(F.zip_with(fold(xa, size), fold(xb, size), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, x: t + x)
    return F.coalesce((100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb), F.lit(True))


def _link_counts(percent: int) -> Callable[[pa.Table], pa.Table]:
    """For one cell of two runs of classes (or of one run with itself) the rows that each class links with.

    Intersections are products of 0/1 matrices over the shingles that two sets
    or more have, ``SLICE`` of them at a time.
    """

    def run(cell: pa.Table) -> pa.Table:
        node, n, weight = (cell[c].to_numpy().astype(np.int64) for c in ("node", "n", "n_rows"))
        left = cell["left"].to_numpy(zero_copy_only=False).astype(bool)
        mine = np.flatnonzero(left)
        other = np.flatnonzero(~left) if not left.all() else mine
        tokens = cell["tokens"].combine_chunks()
        sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, token, often = np.unique(tokens.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(node)), sizes)
        shared = often[token] > 1
        number = np.cumsum(often > 1) - 1
        token, of = number[token[shared]], of[shared]
        order = np.argsort(token, kind="stable")
        token, of = token[order], of[order]
        common = np.zeros((len(mine), len(other)))
        for a in range(0, int(token[-1]) + 1 if len(token) else 0, SLICE):
            lo, hi = np.searchsorted(token, (a, a + SLICE))
            held = np.zeros((len(node), SLICE), np.float32)
            held[of[lo:hi], token[lo:hi] - a] = 1
            common += held[mine] @ held[other].T
        linked = 100 * common >= percent * (n[mine][:, None] + n[other][None] - common)
        if other is mine:
            np.fill_diagonal(linked, False)
            return pa.table({"node": node[mine], "n_linked": linked @ weight[mine]})
        return pa.table({"node": np.concatenate((node[mine], node[other])), "n_linked": np.concatenate((linked @ weight[other], weight[mine] @ linked))})

    return run


def linked_rows(classes: DataFrame, roots: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, n_linked): how many rows the links of every class in a component of two or more lead to.

    All links are within components.  Two classes of a component are linked;
    in larger ones the sets are compared in cells: classes go to size bins
    (only sets of one bin or of neighbours can link), a bin of a component to
    runs of about ``RUN`` classes and ``RUN_TOKENS`` shingles, and every two
    runs that may link meet in one cell, which gives sums, not pairs.
    """
    members = cut(roots.join(classes.select("node", "s0", "s1", "rep_doc", "n", "n_rows"), "node"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).alias("salt")
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(JOIN_SALTS)).cast("int"))
    totals = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n_rows").alias("all_rows"))
    two = salted.join(totals.where("m = 2").select("root", "all_rows", salts), ["root", "salt"]).select("node", (F.col("all_rows") - F.col("n_rows")).alias("n_linked"))
    large = cut(salted.join(totals.where("m > 2").select("root", salts), ["root", "salt"]).withColumn("bin", _size_bin(percent, F.col("n"))))
    runs = large.groupBy("root", "bin").agg(F.greatest(F.ceil(F.count("*") / RUN), F.ceil(F.sum("n") / RUN_TOKENS)).cast("int").alias("runs"))
    # what a member meets: the runs of its own bin and of the next ones
    near = cut(runs.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("bin", "runs"))).alias("by_bin")))
    placed = large.join(near.select("root", "by_bin", salts), ["root", "salt"])
    placed = placed.withColumn("runs", F.col("by_bin")[F.col("bin")]).withColumn("run", F.pmod(F.xxhash64(F.lit("run"), "node"), "runs").cast("int"))
    runs_of = lambda step: F.coalesce(F.try_element_at("by_bin", F.col("bin") + step), F.lit(0))

    def cells(step: int, left: bool) -> Column:
        """The cells with the runs of the bin ``step`` further, as the left or the right side; a run meets itself as the left."""
        upto = F.sequence(F.lit(0), runs_of(step) - 1)
        cell = lambda r: F.struct(*((F.col("bin") + (0 if left else step)).alias("lb"), (F.col("run") if left else r).alias("lr"), (F.col("bin") + (step if left else 0)).alias("rb"), (r if left else F.col("run")).alias("rr"), F.lit(left).alias("left")))
        with_ = F.filter(upto, lambda r: (r >= F.col("run")) if left else (r < F.col("run"))) if step == 0 else upto
        return F.when(runs_of(step) > 0, F.transform(with_, cell)).otherwise(F.array().cast("array<struct<lb:int,lr:int,rb:int,rr:int,left:boolean>>"))

    here = placed.select("node", "s0", "s1", "n", "n_rows", "root", F.concat(cells(0, True), cells(0, False), cells(1, True), cells(-1, False)).alias("cells"))
    sets = sets_of(large.select("s0", "s1", "rep_doc")).select("s0", "s1", "tokens")
    again = F.row_number().over(Window.partitionBy("s0", "s1").orderBy(F.size("tokens")))
    filled = here.join(sets.withColumn("again", again).where("again = 1"), ["s0", "s1"])
    sent = filled.select("node", "n", "n_rows", "root", "tokens", F.explode("cells").alias("c")).select("root", "c.lb", "c.lr", "c.rb", "c.rr", "c.left", "node", "n", "n_rows", "tokens")
    found = sent.groupBy("root", "lb", "lr", "rb", "rr").applyInArrow(_link_counts(percent), "node long, n_linked long")
    return two.unionByName(found).groupBy("node").agg(F.sum("n_linked").alias("n_linked"))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell (id, text) pairs apart, nulls included."""
    known = F.concat(doc_id.isNull().cast("string"), text.isNull().cast("string"))
    return F.xxhash64(doc_id, text, known), F.xxhash64(F.lit("second"), doc_id, text, known)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", all_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id, n_links, component, k0, k1.

    class_id is the smallest id with the same set, n_links the number of other
    rows that a row links with.  Without ``all_links`` (for callers that need
    components only) it counts just the links that were needed to find the
    components.  ``component`` tells components apart even where ids are null
    or repeated; k0 and k1 are the :func:`row_keys`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = sketch_size(rows)
    keyed = small_batches(rows).select("*", *[k.alias(f"k{j}") for j, k in enumerate(row_keys(F.col("doc_id"), F.col("text")))])
    facts = cut(keyed.mapInArrow(_facts(width, sketch), FACTS))
    own = facts.where("row_key IS NOT NULL").select("row_key", "doc_id", "k0", "k1", "n", "s0", "s1", "parity", "wide")
    classes = cut(
        own.where("n > 0")
        .groupBy("s0", "s1")
        .agg(F.min("row_key").alias("node"), F.min("doc_id").alias("rep_doc"), F.min("n").alias("n"), F.min("parity").alias("parity"), F.min("wide").alias("wide"), F.count("*").alias("n_rows"))
    )
    levels = spark.sparkContext.broadcast(_levels(facts, sketch))  # sketch entries
    tokens = rows.select("text").mapInArrow(_prefixes(width, percent, levels, sketch), "s0 long, s1 long, tokens array<long>")
    # a class comes from every task that saw one of its rows; the join needs this order anyway
    tokens = tokens.withColumn("again", F.row_number().over(Window.partitionBy("s0", "s1").orderBy(F.size("tokens")))).where("again = 1")
    posted = tokens.join(classes.select("s0", "s1", "node", "n"), ["s0", "s1"]).select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    by_token = Window.partitionBy("token").orderBy(F.xxhash64("token", "node"), "node")
    upto, own_row = by_token.rowsBetween(Window.unboundedPreceding, 0), F.struct("node", "n", "pos")
    before = F.array(*[F.nth_value(own_row, k).over(upto) for k in range(1, PIVOTS + 1)])
    runs = cut(
        posted.select("token", "node", "n", "pos")
        .withColumn("pivots", before)
        .withColumn("next", F.lead("node").over(by_token))
        .where((F.col("pivots")[0]["node"] != F.col("node")) | (F.col("next") != F.col("node")))
        .select("token", "node", "n", "pos", "pivots")
    )

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose parities allow a link, with sizes and signatures."""
        side = lambda x: classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "s0", "s1", "parity", "wide")])
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        col = F.col
        near = _suffix(percent, col("n_a"), col("n_b"), col("parity_a"), col("parity_b"))
        near = F.when(near, _wide_suffix(percent, col("n_a"), col("n_b"), col("wide_a"), col("wide_b"))).otherwise(False)
        return joined.where(near).select("a", "b", "n_a", "n_b", "s0_a", "s1_a", "s0_b", "s1_b")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(s0, s1, tokens) of at least the wanted classes (s0, s1, rep_doc); a row that repeats its id comes again."""
        bloom = spark.sparkContext.broadcast(_bloom(wanted))  # at most 2^MAX_BLOOM bits
        return rows.mapInArrow(_sets(width, bloom), "doc_id long, s0 long, s1 long, tokens array<long>")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs: sets are sent only of classes in pairs, by signature."""
        ends = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(f"s0_{x}").alias("s0"), F.col(f"s1_{x}").alias("s1")) for x in "ab"])).alias("e"))
        wanted = ends.select("e.*").distinct().join(classes.select("node", "rep_doc"), "node")
        sets = sets_of(wanted)
        side = lambda x: sets.select(F.col("s0").alias(f"s0_{x}"), F.col("s1").alias(f"s1_{x}"), F.col("tokens").alias(f"t_{x}"))
        common = F.size(F.array_intersect("t_a", "t_b"))
        both = pairs.join(side("b"), ["s0_b", "s1_b"]).join(side("a"), ["s0_a", "s1_a"])
        return both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")

    pivot = F.col("pivot")
    runs_by_pivot = runs.select("node", "n", "pos", F.explode("pivots").alias("pivot"))
    star = runs_by_pivot.where(pivot["node"] != F.col("node")).where(_may_link(percent, pivot["n"], F.col("n")) & _position(percent, pivot["n"], F.col("n"), pivot["pos"], F.col("pos")))
    star = star.select(F.least(pivot["node"], F.col("node")).alias("a"), F.greatest(pivot["node"], F.col("node")).alias("b")).distinct()
    tested = cut(filtered(star))
    links = cut(verified(tested).distinct())
    roots = components(links)

    labelled = runs.select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    one, all_ = Window.partitionBy("token", "root"), Window.partitionBy("token")
    open_ = cut(
        labelled.withColumn("members", F.count("*").over(one))
        .withColumn("largest", F.max(F.struct("members", "root")).over(all_)["root"])
        .withColumn("others", F.max((F.col("root") != F.col("largest")).cast("int")).over(all_))
        .where("others = 1")
        .select("token", "node", "n", "pos", "root", (F.col("root") == F.col("largest")).alias("main"))
        .join(classes.select("node", "parity"), "node")
    )
    # members meet by n-gram and size bin; those outside the largest component come to the bins beside theirs too
    size_bin = _size_bin(percent, F.col("n"))
    left = open_.where("NOT main").select("token", size_bin.alias("bin"), *[F.col(c).alias(f"l_{c}") for c in ("node", "n", "pos", "root", "parity")])
    left = left.withColumn("bin", F.explode(F.array(*[F.col("bin") + d for d in (-1, 0, 1)])))
    right = open_.select("token", size_bin.alias("bin"), "main", *[F.col(c).alias(f"r_{c}") for c in ("node", "n", "pos", "root", "parity")])
    col = F.col
    across = (
        (col("l_root") != col("r_root"))
        & (col("main") | (col("l_node") < col("r_node")))
        & _may_link(percent, col("l_n"), col("r_n"))
        & _position(percent, col("l_n"), col("r_n"), col("l_pos"), col("r_pos"))
        & _suffix(percent, col("l_n"), col("r_n"), col("l_parity"), col("r_parity"))
    )
    rest = left.join(right, (left["token"] == right["token"]) & (left["bin"] == right["bin"]) & across).select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"))
    rest = cut(filtered(rest.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")))
    if not rest.isEmpty():
        found = cut(verified(rest).distinct())
        links, roots = links.union(found), components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    # links of a document: the copies of its class, and all documents of the classes linked with it
    if all_links:
        degree = linked_rows(classes, roots, lambda wanted: sets_of(wanted), percent)
    else:
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        degree = ends.join(classes.select(F.col("node").alias("other"), F.col("n_rows").alias("others")), "other").groupBy("node").agg(F.sum("others").alias("n_linked"))
    placed = classes.select("s0", "s1", "node", "rep_doc", "n_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = placed.join(placed.groupBy("root").agg(F.min("rep_doc").alias("component_id")), "root").join(degree, "node", "left")
    n_links = F.col("n_rows") - 1 + F.coalesce("n_linked", F.lit(0).cast("long"))
    placed = placed.select("s0", "s1", F.lit(True).alias("full"), F.col("rep_doc").alias("class_id"), "component_id", n_links.alias("n_links"), "root")
    return (
        own.select("row_key", "doc_id", "k0", "k1", "n", "s0", "s1", (F.col("n") > 0).alias("full"))
        .join(placed, ["s0", "s1", "full"], "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("full"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
            F.when(F.col("full"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("root", "row_key").alias("component"),
            "k0",
            "k1",
        )
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: of its rows with the smallest id (null last) one.

    Rows without words are components of their own and stay.  What goes is
    decided by id and text together; only rows that repeat both are gathered,
    to keep one of them.
    """
    found = near_duplicates(docs, width, percent, id_col, text_col, all_links=False)
    rows = cut(found.where("n_shingles > 0").groupBy("component", "k0", "k1").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))).alias("salt")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "k0", "k1")).alias("first"), F.sum("n").alias("all"))
    first = first.where("all > 1").select("component", F.col("first.k0").alias("f0"), F.col("first.k1").alias("f1"), salts)
    own = rows.withColumn("salt", F.pmod("k0", F.lit(JOIN_SALTS)).cast("int")).join(first, ["component", "salt"])
    stays = (F.col("k0") == F.col("f0")) & (F.col("k1") == F.col("f1"))
    k0, k1, row = free_names(("_k0", "_k1", "_row"), docs.columns)
    judged = cut(own.select(F.col("k0").alias(k0), F.col("k1").alias(k1), stays.alias("stays"), "n").where("NOT stays OR n > 1"))
    keys = row_keys(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    on = (keys[0] == F.col(k0)) & (keys[1] == F.col(k1))
    kept = docs.join(judged.select(k0, k1), on, "left_anti")
    again = judged.where("stays").select(k0, k1)
    if again.isEmpty():
        return kept
    once = docs.join(again, on).groupBy(k0, k1).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(row))
    return kept.unionByName(once.select(f"{row}.*"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a),
e AS (SELECT a, min(b) AS low FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c = x.n AND c = y.n GROUP BY a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(e.low, d.doc_id)) AS class_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id LEFT JOIN e ON e.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""
