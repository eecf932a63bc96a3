"""Language identification with interpolated Kneser-Ney character models.

A text becomes lower-case letters with one space for every run of anything
else.  Per language an interpolated Kneser-Ney model of order ``ORDER`` is
trained; all n-grams of one order of all languages share one sorted array of
64-bit hashes with a row of log-probabilities (one per language) for each, and
a second array keeps the back-off weights of the contexts.  Scoring looks all
positions of a block of texts up by binary search, longest n-gram first, and
sums per text.  The language with the lowest cross-entropy per character wins.

Calibrated rejection: a part of the labelled sample is held back from the
counts; a text is rejected when its lowest cross-entropy exceeds the
``REJECT_QUANTILE`` of its language there by ``REJECT_MARGIN`` and an allowance
for short texts.

Bound of the classifier (a sample of labelled rows, those with the smallest
hashes of id and text, copies once): at most ``TRAIN_DOCS`` texts for each
language, whole.  Every label is learnt; the
languages are held and scored in blocks of ``BLOCK_LANGUAGES``, so that the
model that is broadcast grows in proportion to the languages, not with the table.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and
not rejected by entropy but by the lack of letters; without any labelled row
every text is ``und``; ties go to the first language in code point order; null
and repeated ids are ids like any other; kept columns named like a result get
underscores in front.  Long texts are counted and scored in windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm.common import BLOCK_BYTES, _ODD, blocks, kept_as, mix64, small_batches, table
from weir.ship import ship

ORDER = 4
TRAIN_DOCS = 400
BLOCK_LANGUAGES = 32
CALIBRATE_EVERY = 5
REJECT_QUANTILE = 0.995
REJECT_MARGIN = 0.2
SHORT_ALLOWANCE = 4.0
SHARPNESS = 8.0
WINDOW = 1 << 18

_NORMAL: np.ndarray | None = None


def _normal() -> np.ndarray:
    """Per code point its lower-case letter, or a space for what is no letter."""
    global _NORMAL
    if _NORMAL is None:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _NORMAL = out
    return _NORMAL


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two spaces, and their offsets."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _normal()[raw]
    ends = np.cumsum(sizes)
    first = np.zeros(len(points), bool)
    first[(ends - sizes)[sizes > 0]] = True
    keep = (points != 32) | first
    keep[1:] |= points[:-1] != 32
    sums = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], sums[np.concatenate(([0], ends))]


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each position (len - n + 1 of them)."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out += points[j : m + j].astype(np.uint64) * _ODD[j]
    return mix64(out)


def windows(text: str, order: int, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """The code points that :func:`normalised` gives for one text, in windows of about ``size``.

    Each comes with the last ``order - 1`` points before it; the second value is
    how many points a window has that an earlier one had.
    """
    table_, tail = _normal(), np.zeros(0, np.uint32)
    for at in range(0, len(text), size):
        part = text[at : at + size]
        part = (" " if at == 0 else "") + part + (" " if at + size >= len(text) else "")
        points = table_[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)]
        last = tail[-1:] if len(tail) else np.zeros(1, np.uint32)
        points = points[(points != 32) | (np.concatenate((last, points[:-1])) != 32)]
        yield np.concatenate((tail, points)), len(tail)
        tail = np.concatenate((tail, points))[-(order - 1) :] if order > 1 else points[-1:]


def _batches(texts: list[str], order: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(points, offsets, how many of the first points were in the batch before): all texts, in bounded batches."""
    run: list[str] = []
    held = 0
    for t in texts:
        if len(t) > size:
            for points, old in windows(t, order, size):
                yield points, np.array([0, len(points)]), old
            continue
        if run and held + len(t) > size:
            yield *normalised(run), 0
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield *normalised(run), 0


Counts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def count_grams(texts: list[str], order: int, size: int = WINDOW) -> list[Counts]:
    """Per n = 1..order: distinct hashes, raw counts, hashes of the suffix and of the context."""
    empty = np.zeros(0, np.uint64)
    parts: list[list[Counts]] = [[(empty, np.zeros(0, np.int64), empty, empty)] for _ in range(order)]

    def merged(found: list[Counts]) -> Counts:
        keys, at, inverse = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, inverse, np.concatenate([f[1] for f in found]))
        return keys, counts, *(np.concatenate([f[k] for f in found])[at] for k in (2, 3))

    for points, offsets, old in _batches(texts, order, size):
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for n in range(1, order + 1):
            h = gram_hashes(points, n)
            inside = np.flatnonzero(of[: len(h)] == of[n - 1 : n - 1 + len(h)])
            inside = inside[inside + n > old]  # those that end in what is new
            keys, at, counts = np.unique(h[inside], return_index=True, return_counts=True)
            at = inside[at]
            shorter = gram_hashes(points, n - 1) if n > 1 else np.zeros(len(points) + 1, np.uint64)
            parts[n - 1].append((keys, counts.astype(np.int64), shorter[at + 1] if n > 1 else np.zeros(len(at), np.uint64), shorter[at]))
            if len(parts[n - 1]) >= 16:
                parts[n - 1] = [merged(parts[n - 1])]
    return [merged(p) for p in parts]


class Model:
    """Sorted hash arrays of all orders, their log-probabilities and back-off weights.

    ``letters`` is the number of distinct 1-grams (of these languages, if not given).
    """

    def __init__(self, langs: list[str], counts: list[list[tuple]], order: int, letters: int | None = None) -> None:
        self.langs, self.order = langs, order
        size = len(langs)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        links = []
        for n in range(order):
            keys = np.unique(np.concatenate([c[n][0] for c in counts]))
            raw = np.zeros((len(keys), size))
            suffix, context = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for k, c in enumerate(counts):
                at = np.searchsorted(keys, c[n][0])
                raw[at, k] = c[n][1]
                suffix[at], context[at] = c[n][2], c[n][3]
            self.keys.append(keys)
            links.append((raw, suffix, context))
        below = np.full((1, size), 1.0 / ((letters or len(self.keys[0])) + 1))
        self.floor = np.log(below[0]).astype(np.float32)
        for n in range(order):
            raw, _, context = links[n]
            if n + 1 < order:  # lower orders count the distinct characters before
                longer, suffix, _ = links[n + 1]
                used = np.zeros_like(raw)
                np.add.at(used, np.searchsorted(self.keys[n], suffix), longer > 0)
                used[(used == 0) & (raw > 0)] = 1  # only at the start of a text
            else:
                used = raw
            ctx = np.searchsorted(self.keys[n - 1], context) if n else np.zeros(len(used), np.int64)
            groups = len(self.keys[n - 1]) if n else 1
            total, kinds = np.zeros((groups, size)), np.zeros((groups, size))
            np.add.at(total, ctx, used)
            np.add.at(kinds, ctx, used > 0)
            ones, twos = (used == 1).sum(0), (used == 2).sum(0)
            discount = np.where(ones + 2 * twos > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            discount = np.clip(discount, 0.05, 0.95)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            lower = below[np.searchsorted(self.keys[n - 1], links[n][1])] if n else below[np.zeros(len(used), np.int64)]
            p = np.where(total[ctx] > 0, np.maximum(used - discount, 0) / np.maximum(total[ctx], 1e-9), 0.0) + weight[ctx] * lower
            self.logp.append(np.log(p).astype(np.float32))
            self.backoff.append(np.log(weight).astype(np.float32))
            below = p
        self.limits = np.full(size, np.inf)

    def _scores(self, points: np.ndarray, offsets: np.ndarray, given: int) -> np.ndarray:
        """Sums of log-probabilities per text and language, without the first ``given`` points of each."""
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        # position i is the last character of its n-gram
        total = np.zeros((len(points), len(self.langs)), np.float32)
        start = offsets[of]
        index = np.arange(len(points))
        todo = index[index >= start + given]
        room = todo - start[todo] + 1
        for n in range(self.order, 0, -1):
            if not len(todo):
                break
            h = gram_hashes(points, n)
            can = room >= n
            at_n = todo[can]
            got = h[at_n - n + 1]
            where = np.minimum(np.searchsorted(self.keys[n - 1], got), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][where] == got
            total[at_n[hit]] += self.logp[n - 1][where[hit]]
            missed = at_n[~hit]
            if n > 1:
                ctx = gram_hashes(points, n - 1)[missed - n + 1]
                w = np.minimum(np.searchsorted(self.keys[n - 2], ctx), len(self.keys[n - 2]) - 1)
                known = self.keys[n - 2][w] == ctx
                total[missed[known]] += self.backoff[n - 1][w[known]]
            else:
                total[missed] += self.backoff[0][0] + self.floor
            todo = np.sort(np.concatenate((missed, todo[~can])))
            room = todo - start[todo] + 1
        return np.add.reduceat(total, offsets[:-1], axis=0, dtype=np.float64)

    def entropies(self, texts: list[str], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) of each text in each language, and the letters of each text.

        A text of more than ``size`` characters is scored window by window, with the same result.
        """
        out, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        short = [k for k, t in enumerate(texts) if len(t) <= size]
        if short:
            points, offsets = normalised([texts[k] for k in short])
            of = np.repeat(np.arange(len(short)), np.diff(offsets))
            letters[short] = np.bincount(of, weights=points != 32, minlength=len(short)).astype(np.int64)
            out[short] = -self._scores(points, offsets, 1) / np.maximum(np.diff(offsets) - 1, 1)[:, None]
        for k, t in enumerate(texts):
            if len(t) > size:
                scored = 0
                for points, old in windows(t, self.order, size):
                    given = max(old, 1)  # the leading space of a text is given
                    if len(points) > given:
                        out[k] -= self._scores(points, np.array([0, len(points)]), given)[0]
                        scored += len(points) - given
                    letters[k] += int((points[old:] != 32).sum())
                out[k] /= max(scored, 1)
        return out, letters

    def calibrate(self, texts_by_lang: list[list[str]], quantile: float, margin: float) -> None:
        for k, texts in enumerate(texts_by_lang):
            texts = [t for t in texts if len(t) >= 40]
            if len(texts) >= 5:
                self.limits[k] = np.quantile(self.entropies(texts)[0][:, k], quantile) + margin

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, lowest cross-entropy and rejection of each text."""
        ce, letters = self.entropies(texts)
        best = ce.argmin(1)
        low = ce[np.arange(len(best)), best]
        score = 1.0 / np.exp(-SHARPNESS * (ce - low[:, None])).sum(1)
        none = letters == 0
        rejected = none | (low > self.limits[best] + SHORT_ALLOWANCE / np.sqrt(np.maximum(letters, 1)))
        langs = ["und" if n else self.langs[b] for n, b in zip(none.tolist(), best.tolist(), strict=True)]
        return langs, np.where(none, 0.0, score), np.where(none, np.nan, low), rejected


class Blocks(Model):
    """Models of some languages each, over one alphabet, that score as one."""

    def __init__(self, langs: list[str], counts: Callable[[str], list[tuple]], order: int, size: int = BLOCK_LANGUAGES) -> None:
        self.langs, self.order = langs, order
        alphabet = np.zeros(0, np.uint64)
        for x in langs:
            alphabet = np.union1d(alphabet, counts(x)[0][0])
        parts = [langs[k : k + size] for k in range(0, len(langs), size)]
        self.models = [Model(part, [counts(x) for x in part], order, len(alphabet)) for part in parts]
        self.limits = np.full(len(langs), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [m.entropies(texts) for m in self.models]
        return np.concatenate([ce for ce, _ in found], axis=1), found[0][1]

    def calibrate(self, texts_by_lang: list[list[str]], quantile: float, margin: float) -> None:
        at = 0
        for m in self.models:  # a text's limit is that of its own language
            m.calibrate(texts_by_lang[at : at + len(m.langs)], quantile, margin)
            at += len(m.langs)
        self.limits = np.concatenate([m.limits for m in self.models])


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    order: int = ORDER,
    train_docs: int = TRAIN_DOCS,
    quantile: float = REJECT_QUANTILE,
    margin: float = REJECT_MARGIN,
) -> Model | None:
    """Fit the models on a bounded sample of the labelled rows; counting runs on the executors."""
    ship(labelled.sparkSession)
    own = F.xxhash64(F.lit("train"), F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("h")
    rows = labelled.select(own, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row a language
    if not sizes:
        return None
    langs = sorted(r["lang"] for r in sizes)
    # a little more than wanted by the share, then exactly so many: those with the smallest hashes, copies once
    share = labelled.sparkSession.createDataFrame(pa.table({"lang": [r["lang"] for r in sizes], "share": [1.5 * train_docs / r["n"] for r in sizes]}))
    u = F.shiftrightunsigned("h", 12) / float(1 << 52)
    some = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 12), "h"))
    part = F.pmod(F.xxhash64(F.lit("part"), "h"), F.lit(CALIBRATE_EVERY)) == 0
    sample = some.withColumn("rank", rank).where(F.col("rank") <= train_docs).select("lang", "text", part.alias("held"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["held"]]["text"].tolist()
        grams = count_grams(pdf[~pdf["held"]]["text"].tolist() or held, order)
        row = {"lang": pdf["lang"].iloc[0], "held": held}
        row |= {f"{k}{n}": a.tobytes() for n, g in enumerate(grams) for k, a in zip("kcsx", g, strict=True)}
        return pd.DataFrame([row])

    schema = "lang string, held array<string>, " + ", ".join(f"{k}{n} binary" for n in range(order) for k in "kcsx")
    found = {r["lang"]: r for r in sample.groupBy("lang").applyInPandas(count, schema).collect()}
    langs = [x for x in langs if x in found]
    if not langs:
        return None
    read = lambda r, n: tuple(np.frombuffer(r[f"{k}{n}"], np.int64 if k == "c" else np.uint64) for k in "kcsx")
    model = Blocks(langs, lambda x: [read(found[x], n) for n in range(order)], order)
    model.calibrate([list(found[x]["held"]) for x in langs], quantile, margin)
    return model


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts (null: empty) of about ``limit`` bytes, with the index of the first.

    Only one run at a time exists as Python strings.
    """
    for block in blocks(column, limit):
        yield block.first, [x or "" for x in column.slice(block.first, block.n).to_pylist()]


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score, entropy and rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    own = text_col in keep and dict(docs.dtypes)[text_col] == "string"  # then the text travels once
    rows = docs.select(*keep) if own else docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    at, fields = (keep.index(text_col), rows.schema.fields) if own else (len(keep), rows.schema.fields[:-1])
    names = [*kept_as(keep, ("lang_pred", "score", "entropy", "rejected")), "lang_pred", "score", "entropy", "rejected"]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=False))
    schema += ", lang_pred string, score double, entropy double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, texts in text_blocks(batch.column(at)):
                if m is None:
                    n = len(texts)
                    new = [["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)]
                else:
                    new = list(m.predict(texts))
                kept = [batch.column(k).slice(first, len(texts)) for k in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(new[0], pa.string()), pa.array(new[1], pa.float64()), pa.array(new[2], pa.float64(), from_pandas=True), pa.array(new[3], pa.bool_())], names=names)

    return small_batches(rows).mapInArrow(run, schema)


def fold() -> F.Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold() != 1))
    held = F.coalesce(fold() == 1, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), model, keep=("doc_id", "held_out"))
