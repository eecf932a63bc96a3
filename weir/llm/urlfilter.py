"""URL filters on a memory-mapped sorted digest array.

A rule is a host and a path prefix (``example.com/en/``); it fits its host and
all subdomains when the path starts with the rule's.  The rules are stored in
one file: the sorted 64-bit xxhash keys, the action of each, and the rule
strings themselves.  Executors map the file and probe it with vectorised binary
search; every hit is confirmed against the stored string, so two strings with
one digest can't be confused.

For a URL the candidates are its host suffixes times those path lengths that
occur in rules, longest first, so a lookup costs a few digests per URL however
many rules there are.  The file travels by ``SparkContext.addFile``: a lost
executor's successor fetches it again, and each maps its own copy.

Edge cases: a null URL, or one without ``://``, has empty host and path and
fits no rule; a rule without ``/`` fits every path; equal rules keep the last
action; the longest rule wins, first by the length of its host, then of its
path; repeated rows and null ids are passed along, an empty table gives no rows;
kept columns named like a result get underscores in front.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import kept_as, small_batches, table

#: Rules of the query, and the method's own block list (used where no rule fits).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
BLOCKED = ("spam-farm.example.org/",)
DEFAULT = "allow"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def rules_of(source: str | Iterable[tuple[str, str]], action: str = "block") -> Iterable[tuple[str, str]]:
    """(action, rule) pairs: as given, or one rule a line of a UTF-8 file (blank lines and those with ``#`` in front don't count)."""
    if not isinstance(source, str):
        return source
    with open(source, encoding="utf-8") as lines:
        return [(action, line) for line in map(str.strip, lines) if line and not line.startswith("#")]


def _host_size(rule: str) -> int:
    return rule.find("/") if "/" in rule else len(rule)


def build_digest_file(rules: Iterable[tuple[str, str]], path: str) -> None:
    """Writes header, sorted digests, actions, string offsets, strings and path lengths."""
    unique = {rule: action for action, rule in rules}
    names = list(unique)
    keys = np.fromiter(map(digest, names), np.uint64, len(names))
    order = np.lexsort((np.array(names, object), keys)) if len(np.unique(keys)) < len(keys) else np.argsort(keys)
    raw = [names[k].encode("utf-8", "surrogatepass") for k in order.tolist()]
    depths = np.array(sorted({len(rule) - _host_size(rule) for rule in names}), np.int64)
    with open(path, "wb") as out:
        out.write(np.array([len(names), len(depths), sum(map(len, raw)), max(map(_host_size, names), default=0)], np.int64).tobytes())
        out.write(keys[order].tobytes())
        out.write(np.array([unique[names[k]] == "block" for k in order.tolist()], np.int64).tobytes())
        out.write(np.cumsum([0, *map(len, raw)], dtype=np.int64).tobytes())
        out.write(depths.tobytes())
        out.write(b"".join(raw))


class DigestArray:
    """The mapped file; ``find`` answers many strings at once."""

    def __init__(self, path: str) -> None:
        n, d, size, self.widest = np.memmap(path, np.int64, "r", shape=(4,)).tolist()
        at = 32

        def part(kind: type, length: int) -> np.ndarray:
            nonlocal at
            out = np.memmap(path, kind, "r", offset=at, shape=(length,)) if length else np.zeros(0, kind)
            at += length * np.dtype(kind).itemsize
            return out

        self.keys, self.block, self.offsets = part(np.uint64, n), part(np.int64, n), part(np.int64, n + 1)
        self.depths = part(np.int64, d).tolist()
        self.strings = part(np.uint8, size)

    def find(self, texts: list[str], digests: np.ndarray | None = None) -> np.ndarray:
        """Index of each text in the array, or -1."""
        if not texts or not len(self.keys):
            return np.full(len(texts), -1)
        digests = np.array([digest(t) for t in texts], np.uint64) if digests is None else digests
        out = np.full(len(texts), -1)
        at = np.searchsorted(self.keys, digests)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests).tolist():
            wanted, j = texts[k].encode("utf-8", "surrogatepass"), int(at[k])
            while j < len(self.keys) and self.keys[j] == digests[k]:  # strings that share a digest stand together
                if self.strings[self.offsets[j] : self.offsets[j + 1]].tobytes() == wanted:
                    out[k] = j
                    break
                j += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    stop = min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))
    return host, tail[:stop]


def candidates(host: str, path: str, rules: DigestArray) -> list[str]:
    """The rules that could fit, longest first: none has a longer host than the widest rule."""
    at = max(0, len(host) - rules.widest)
    if at and host[at - 1] != ".":
        at = host.find(".", at) + 1 or len(host)
    suffixes = []
    while at < len(host):
        suffixes.append(host[at:])
        at = host.find(".", at) + 1 or len(host)
    prefixes = [path[:d] for d in sorted(rules.depths, reverse=True) if d <= len(path)]
    return [s + p for s in suffixes for p in prefixes]


def longest_rule(rules: DigestArray, parts: list[tuple[str, str]]) -> np.ndarray:
    """Index of the longest rule that fits each (host, path), or -1; equal pairs are probed once."""
    own: dict[tuple[str, str], int] = {}
    deepest = max(rules.depths, default=0)
    keys = [(h, p[:deepest]) for h, p in parts]
    texts, owner = [], []
    for key in keys:
        if key not in own:
            own[key] = len(own)
            found = candidates(*key, rules)
            texts += found
            owner += [own[key]] * len(found)
    hits = rules.find(texts)
    best = np.full(len(own), -1)
    for k in np.flatnonzero(hits >= 0)[::-1].tolist():
        best[owner[k]] = hits[k]
    return best[[own[k] for k in keys]] if keys else np.zeros(0, np.int64)


def _shared_file(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Name of the digest file of these rules, built and served once a session; the driver's copy goes with the driver."""
    content = xxhash.xxh3_128()
    for action, rule in rules:
        content.update(f"{action} {rule}\n".encode("utf-8", "surrogatepass"))
    name = f"urls-{content.hexdigest()}.digests"
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        folder = tempfile.mkdtemp()  # only the driver writes and serves it
        atexit.register(shutil.rmtree, folder, True)
        build_digest_file(rules, os.path.join(folder, name))
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge_urls(pages: DataFrame, rules: str | Iterable[tuple[str, str]] = RULES, blocked: str | Iterable[str] = BLOCKED, default: str = DEFAULT, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns with host, path, rule and verdict.

    ``rules`` are (action, rule) pairs, or a file of rules to block; ``blocked``
    is a list, or a file, of rules that block where none of ``rules`` fits.
    """
    lists = {"rules": rules_of(rules), "blocked": rules_of(blocked) if isinstance(blocked, str) else [("block", b) for b in blocked]}
    names = {kind: _shared_file(pages.sparkSession, list(rows)) for kind, rows in lists.items()}
    rows = pages.select(*keep, F.col(url_col).cast("string").alias("_url"))
    fields = rows.schema.fields[:-1]
    own = ("host", "path", "rule", "verdict")
    columns = [*kept_as(keep, own), *own]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(columns, fields, strict=False)) + ", host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, listed = (DigestArray(SparkFiles.get(names[k])) for k in ("rules", "blocked"))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            rule, spam = longest_rule(own, parts), longest_rule(listed, parts)
            text = [bytes(own.strings[own.offsets[k] : own.offsets[k + 1]]).decode("utf-8", "surrogatepass") if k >= 0 else None for k in rule.tolist()]
            verdict = [("block" if own.block[k] else "allow") if k >= 0 else ("block" if b >= 0 else default) for k, b in zip(rule.tolist(), spam.tolist(), strict=True)]
            new = [pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], text, verdict)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=columns)

    return small_batches(rows).mapInArrow(run, schema)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in RULES)
_BLOCKED_SQL = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r in BLOCKED)
OP4_SQL = rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS rk, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rk, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(action, rule, rhost, rpath) AS (VALUES {_RULES_SQL}),
b(rhost, rpath) AS (VALUES {_BLOCKED_SQL}),
m AS (SELECT rk, rule, action, row_number() OVER (PARTITION BY rk ORDER BY length(rhost) DESC, length(rpath) DESC) AS k FROM h JOIN r
   ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)),
s AS (SELECT DISTINCT rk FROM h JOIN b ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, m.rule, CASE WHEN m.action IS NOT NULL THEN m.action WHEN s.rk IS NOT NULL THEN 'block' ELSE '{DEFAULT}' END AS verdict
FROM h LEFT JOIN m ON h.rk = m.rk AND m.k = 1 LEFT JOIN s ON h.rk = s.rk
"""
