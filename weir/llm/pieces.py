"""Sampled SentencePiece segmentations and their decoding.

The lattice of a text has a node between any two characters and an edge for
every vocabulary piece that matches there.  Forward filtering gives each node
the log-sum of all paths to it; backward sampling then draws, from the end, one
edge into each node with its share of that sum.  The draws come from a counter
hash of seed, row key, unit and step, so a row is segmented alike on every
rerun and on every executor.

No piece has a space after another character, so the lattice falls apart at
the starts of space runs: the distribution over paths is a product over these
units.  Each distinct unit's lattice is filtered once per worker, and all units
of a block of texts are sampled together, step by step, with binary search in
one cumulative array.  (A vocabulary for which this doesn't hold is handled
with the whole text as one unit.)

Scores: a unigram vocabulary has log-probabilities; a BPE vocabulary has merge
ranks, which become Zipf log-probabilities ``-log(rank + 2)``.  ``alpha``
sharpens or flattens the distribution.

Lossless: no normalisation; white space other than the space, literal U+2581
and characters outside the vocabulary are spelled in byte pieces; decoding
concatenates bytes and drops the one leading space that encoding adds.

Edge cases: a null or empty text has no pieces and decodes to the empty text;
a null key is a key like any other; repeated rows are segmented alike; kept
columns named like a result get underscores in front.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import _ODD, kept_as, lists, mix64, small_batches, table
from weir.llm.langid import text_blocks

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 11
#: Units whose lattices a worker keeps; frequent ones come early.  Those of others last for one block.
MAX_CACHED_UNITS = 40_000
LONG_UNIT = 48
WIDTH = 8
SPELLED_COST = 12.0
BITS = 32
#: Characters of one text that are segmented at once.
PART_CHARS = 1 << 19


class Vocabulary:
    """Pieces of a SentencePiece model as plain data that can be sent to executors."""

    def __init__(self, texts: list[str], scores: list[float], normal: list[bool], byte_ids: dict[int, int]) -> None:
        self.texts, self.byte_ids = texts, byte_ids
        self.ids = {t: k for k, (t, ok) in enumerate(zip(texts, normal, strict=True)) if ok and t}
        self.scores = {k: scores[k] for k in self.ids.values()}
        self.digest = hashlib.md5(repr((texts, scores, normal, sorted(byte_ids.items()))).encode("utf-8", "surrogatepass")).hexdigest()
        self.longest = max(map(len, self.ids), default=1)
        self.split = not any(re.search("[^ ] |[^\n]\n|\n[^\n]", t) for t in self.ids)
        # per length all endings of pieces: sorted hashes, piece (-1: only an ending), spelling, score
        self.by_length: list[tuple[np.ndarray, ...]] = []
        for n in range(1, self.longest + 1):
            own = sorted({t[-n:] for t in self.ids if len(t) >= n})
            spelled = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(-1, n)
            h = spelled[:, -1].astype(np.uint64)
            for j in range(2, n + 1):
                h = h + spelled[:, -j].astype(np.uint64) * _ODD[j]
            order = np.argsort(h)
            if (np.diff(np.sort(h)) == 0).any():
                raise ValueError("two endings of pieces share a hash")
            codes = np.array([self.ids.get(t, -1) for t in own], np.int32)
            self.by_length.append((h[order], codes[order], spelled[order], np.array([scores[k] if k >= 0 else -np.inf for k in codes])[order]))
        values = {i: bytes([b]) for b, i in byte_ids.items()}
        self.bytes = [values.get(k, t.encode() if k in self.scores else b"") for k, t in enumerate(texts)]

    @classmethod
    def load(cls, model_file: str = MODEL_FILE) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        names = [p.id_to_piece(k) for k in range(n)]
        plain = [not (p.is_control(k) or p.is_unknown(k) or p.is_unused(k) or p.is_byte(k)) for k in range(n)]
        raw = [p.get_score(k) for k in range(n)]
        ranked = all(s <= 0 and s == int(s) for s, ok in zip(raw, plain, strict=True) if ok)
        scores = [-math.log(2.0 - s) if ranked else s for s in raw]
        spelled = {int(t[3:5], 16): k for k, t in enumerate(names) if p.is_byte(k)}
        if len(spelled) != 256:
            raise ValueError("lossless encoding needs a vocabulary with all 256 byte pieces")
        return cls([t.replace("▁", " ") for t in names], scores, plain, spelled)


class Sampler:
    """Forward-filtered lattices of units, and backward sampling of many units at once.

    Node 0 is the start of every unit.  Node ``k`` owns the integers in
    ``(k << BITS, (k + 1) << BITS]`` of the cumulative array: its shares in units of
    ``2**-BITS``, rounded on their own, so that neither the number of a node nor
    what a worker has seen before changes a draw.  Sums go over edges in fixed
    order, whatever else is in the block.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float = ALPHA, seed: int = SEED) -> None:
        self.v, self.alpha = vocabulary, alpha
        self.seed = mix64(np.array([seed], np.uint64))[0]
        # how long a unit may be for the sums of its lattice to stay well above the smallest double
        cost = alpha * max(SPELLED_COST, -min(vocabulary.scores.values(), default=0.0))
        self.short = max(1, min(LONG_UNIT, int(600 / max(cost, 1e-9))))
        self.spelled_weight = math.exp(-alpha * SPELLED_COST)
        weigh = lambda values: np.array([math.exp(alpha * x) for x in values.tolist()])
        self.endings = [(keys, ids, spelled[:, 0].copy(), weigh(values)) for keys, ids, spelled, values in vocabulary.by_length]
        self.unit = re.compile(r" *[^ \n]+| +|\n" if vocabulary.split else r"(?s:.+)")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.nodes = 1
        self.size = 0
        self.cum, self.come, self.piece = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.spelled: list[bytes] = []
        self.spelled_of: dict[str, int] = {}

    def _append(self, cum: np.ndarray, come: np.ndarray, piece: np.ndarray) -> None:
        end = self.size + len(cum)
        if end > len(self.cum):
            grow = lambda x: np.concatenate((x, np.zeros(max(end, 2 * len(x)) - len(x), x.dtype)))
            self.cum, self.come, self.piece = grow(self.cum), grow(self.come), grow(self.piece)
        for own, new in ((self.cum, cum), (self.come, come), (self.piece, piece)):
            own[self.size : end] = new
        self.size = end

    def _spell(self, ch: str) -> int:
        raw = ch.encode("utf-8", "surrogatepass")
        if len(raw) == 1:
            return self.v.byte_ids[raw[0]]
        if ch not in self.spelled_of:
            self.spelled_of[ch] = len(self.v.texts) + len(self.spelled)
            self.spelled.append(raw)
        return self.spelled_of[ch]

    def _filter(self, unit: str) -> int:
        """Adds the lattice of one long unit; returns its last node."""
        ids, scores, alpha, longest, n = self.v.ids, self.v.scores, self.alpha, self.v.longest, len(unit)
        forward = [0.0] * (n + 1)
        base = self.nodes - 1  # node of position j is base + j, of position 0 it is 0
        cum, come, piece = [], [], []
        for j in range(1, n + 1):
            edges = []
            for i in range(max(0, j - longest), j):
                k = ids.get(unit[i:j])
                if k is not None:
                    edges.append((forward[i] + alpha * scores[k], i, k))
            if not edges or edges[-1][1] != j - 1:
                edges.append((forward[j - 1] - alpha * SPELLED_COST, j - 1, self._spell(unit[j - 1])))
            top = max(edges)[0]
            weights = [math.exp(e[0] - top) for e in edges]
            total = sum(weights)
            forward[j] = top + math.log(total)
            at, node = 0.0, base + j
            for w, (_, i, k) in zip(weights, edges, strict=True):
                at += w / total
                cum.append((node << BITS) + round(min(at, 1.0) * (1 << BITS)))
                come.append(base + i if i else 0)
                piece.append(k)
            cum[-1] = (node + 1) << BITS
        self.nodes += n
        self._append(np.array(cum, np.int64), np.array(come, np.int32), np.array(piece, np.int32))
        return base + n

    def _filter_all(self, units: list[str]) -> tuple[np.ndarray, list[int]]:
        """Adds the lattices of many short units, position by position over all of them.

        Returns their last nodes, and which units hold a piece of more than
        ``WIDTH`` characters (their lattices here are incomplete).  The sums
        are of probabilities, not logarithms: ``short`` keeps them in range.
        """
        sizes = np.array([len(u) for u in units], np.int64)
        stops = np.cumsum(sizes)
        begins = stops - sizes
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.repeat(np.arange(len(units)), sizes)
        at = np.arange(len(chars)) - begins[of]  # position in the unit of each character
        width = min(WIDTH, int(sizes.max()))
        weight = np.zeros((len(chars), width))  # by last character and length of the piece
        piece = np.zeros((len(chars), width), np.int32)
        wide = np.zeros(len(units), bool)
        last, hashes = np.arange(len(chars)), np.zeros(len(chars), np.uint64)  # ends of what may still be a piece's ending
        for n in range(1, min(self.v.longest, int(sizes.max())) + 1):
            before = chars[last - n + 1]
            hashes = before.astype(np.uint64) if n == 1 else hashes + before.astype(np.uint64) * _ODD[n]
            keys, ids, first, weights = self.endings[n - 1]
            where = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            same = (keys[where] == hashes) & (before == first[where])  # the rest was compared one character at a time
            last, hashes, where = last[same], hashes[same], where[same]
            whole = ids[where] >= 0
            if n > width:
                wide[of[last[whole]]] = True
            else:
                weight[last[whole], n - 1], piece[last[whole], n - 1] = weights[where[whole]], ids[where[whole]]
            more = at[last] >= n
            last, hashes = last[more], hashes[more]
            if not len(last):
                break
        for k in np.flatnonzero(weight[:, 0] == 0).tolist():
            weight[k, 0], piece[k, 0] = self.spelled_weight, self._spell(chr(chars[k]))
        # forward sums, with a slot for the start of every unit
        slot = np.arange(len(chars)) + of + 1
        forward = np.zeros(len(chars) + len(units))
        forward[begins + np.arange(len(units))] = 1.0
        order = np.argsort(-sizes, kind="stable")
        longest_first = -sizes[order]
        steps = np.arange(1, width + 1)
        for j in range(int(sizes.max())):
            rows = begins[order[: np.searchsorted(longest_first, -j, "left")]] + j
            n = min(width, j + 1)
            x = weight[rows, :n]
            x *= forward[slot[rows][:, None] - steps[:n]]
            total = x[:, 0].copy()
            for c in range(1, n):
                total += x[:, c]
            forward[slot[rows]] = total
            weight[rows, :n] = x / total[:, None]
        row, col = np.nonzero(weight)
        node = self.nodes + np.arange(len(chars))
        share = np.minimum(np.cumsum(weight, 1)[row, col], 1.0)
        cum = (node[row] << BITS) + np.rint(share * (1 << BITS)).astype(np.int64)
        cum[np.concatenate((row[1:] != row[:-1], [True]))] = (node + 1) << BITS
        come = np.where(at[row] - col > 0, node[row] - col - 1, 0)
        self._append(cum, come.astype(np.int32), piece[row, col])
        self.nodes += len(chars)
        return node[stops - 1], np.flatnonzero(wide).tolist()

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= self.short]
        rest = [u for u in units if len(u) > self.short]
        for a in range(0, len(short), 2_000):
            part = short[a : a + 2_000]
            nodes, wide = self._filter_all(part)
            self.known.update(zip(part, nodes.tolist(), strict=True))
            rest += [part[k] for k in wide]
        for u in rest:
            self.known[u] = self._filter(u)

    def _spellings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per piece, or character outside the vocabulary: how many ids it has, where they begin, and all ids."""
        spell = [[self.v.byte_ids[b] for b in raw] for raw in self.spelled]
        size = len(self.v.texts)
        width = np.concatenate((np.ones(size, np.int64), np.array([len(x) for x in spell], np.int64)))
        flat = np.concatenate((np.arange(size, dtype=np.int32), np.array([b for x in spell for b in x], np.int32)))
        return width, np.cumsum(width) - width, flat

    def encode(self, texts: list[str], keys: np.ndarray, part_chars: int = PART_CHARS) -> list[np.ndarray]:
        """Piece ids of every text; ``keys`` (uint64) seed the draws.  Long texts go in parts, with the same result."""
        if not self.v.split or all(len(t) <= part_chars for t in texts):
            return self._encode([self.unit.findall(" " + t) if t else [] for t in texts], np.zeros(len(texts), np.int64), keys)
        out = []
        for k, t in enumerate(texts):
            made, place, run, held = [], 0, [], 0
            for m in self.unit.finditer(" " + t if t else ""):
                if run and held + len(m[0]) > part_chars:
                    made += self._encode([run], np.array([place]), keys[k : k + 1])
                    place, run, held = place + len(run), [], 0
                run.append(m[0])
                held += len(m[0])
            made += self._encode([run], np.array([place]), keys[k : k + 1])
            out.append(np.concatenate(made))
        return out

    def _encode(self, found: list[list[str]], first: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of some units of each text, of which the first is unit ``first`` of its text."""
        units = [u for f in found for u in f]
        counts = [len(f) for f in found]
        known = self.known
        new = sorted(u for u in set(units) if u not in known)
        keep, kept_size, kept_nodes = len(known) < MAX_CACHED_UNITS, self.size, self.nodes
        self._learn(new)
        last = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        cum, come, piece = self.cum[: self.size], self.come, self.piece
        width, begin, flat = self._spellings()
        counts = np.array(counts, np.int64)
        of = np.repeat(np.arange(len(found)), counts)
        place = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts - first, counts)
        state = mix64(mix64(keys ^ self.seed)[of] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        active = np.argsort(last)  # neighbours in the arrays are looked up together
        node, state = last[active], state[active]
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        steps = np.zeros(len(units), np.int64)
        while len(active):
            state = mix64(state + np.uint64(0xD1B54A32D192ED03))
            edge = np.searchsorted(cum, (node << BITS) + (state >> np.uint64(64 - BITS)).astype(np.int64), "right")
            drawn.append((active, piece[edge]))
            steps[active] += 1
            node = come[edge].astype(np.int64)
            more = node > 0
            active, node, state = active[more], node[more], state[more]
        if not keep:
            self.size, self.nodes = kept_size, kept_nodes
            for u in new:
                del known[u]
        ends = np.cumsum(steps)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for s, (who, what) in enumerate(drawn):
            ids[ends[who] - 1 - s] = what
        wide = width[ids]
        stops = np.cumsum(wide)
        out = flat[np.repeat(begin[ids] - (stops - wide), wide) + np.arange(int(stops[-1]) if len(stops) else 0)]
        per_text = np.concatenate(([0], stops))[np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]]
        return [out[a:b] for a, b in zip(per_text[:-1].tolist(), per_text[1:].tolist(), strict=True)]


#: The sampler of this worker process; its lattices serve the tasks that follow.
_OWN: dict[tuple, Sampler] = {}


def worker_sampler(vocabulary: Vocabulary, alpha: float, seed: int) -> Sampler:
    key = (vocabulary.digest, alpha, seed)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Sampler(vocabulary, alpha, seed)
    return _OWN[key]


def decode(ids: list[int] | np.ndarray, table_: list[bytes]) -> str:
    """The text that piece ids spell (``table_``: the bytes of every piece)."""
    raw = b"".join(map(table_.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return raw[1:].decode("utf-8", "surrogatepass")


def _names(rows: DataFrame, own: tuple[str, ...]) -> tuple[str, list[str]]:
    """Schema and names of the kept columns of ``rows`` (all but the last two), free of the operator's ``own``."""
    fields = rows.schema.fields[:-2]
    names = kept_as(tuple(f.name for f in fields), own)
    return "".join(f"`{n}` {f.dataType.simpleString()}, " for n, f in zip(names, fields, strict=True)), names


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, text_col: str = "text", key_col: str | Column = "doc_id", keep: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA, seed: int = SEED, digests: bool = False) -> DataFrame:
    """The ``keep`` columns with piece_ids; with ``digests`` instead n_pieces, ids_sha256, text_sha256 and lossless."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())  # bounded by the vocabulary
    key = F.xxhash64(F.col(key_col) if isinstance(key_col, str) else key_col)
    rows = docs.select(*keep, key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    own = ("n_pieces", "ids_sha256", "text_sha256", "lossless") if digests else ("piece_ids",)
    schema, names = _names(rows, own)
    schema += "n_pieces long, ids_sha256 string, text_sha256 string, lossless boolean" if digests else "piece_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        sampler = worker_sampler(vocab, alpha, seed)
        for batch in batches:
            wide = batch.num_columns
            keys = batch.column(wide - 2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, texts in text_blocks(batch.column(wide - 1), 1 << 19):
                ids = sampler.encode(texts, keys[first : first + len(texts)])
                kept = [batch.column(k).slice(first, len(texts)) for k in range(wide - 2)]
                if digests:
                    back = [decode(x, vocab.bytes) for x in ids]
                    new = [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back]),
                        pa.array([a == b for a, b in zip(back, texts, strict=True)]),
                    ]
                    yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names, *own])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, lists(pa.int32(), ids)], names=[*names, *own])

    return small_batches(rows).mapInArrow(run, schema)


def decoded(encoded: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "piece_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with the text that ``ids_col`` spells."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocabulary or Vocabulary.load()).bytes)
    rows = encoded.select(*keep, F.lit(0).alias("_key"), F.col(ids_col).alias("_ids"))
    schema, names = _names(rows, ("text",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(x or [], shared.value) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string())], names=[*names, "text"])

    return small_batches(rows).mapInArrow(run, f"{schema}text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digests=True)
