"""Chat formatting by schema fingerprints.

A record's fingerprint is a digest of its nested field paths (``[]`` marks a
list) with their types, of all paths that any mapping reads; further fields
don't matter.  It selects a declarative mapping that says where the turns are,
or which fields make which turn, and the record becomes canonical (role, text)
turns.  The template wraps every turn in control marks; control strings inside
texts get one more backslash in front (of the backslashes they may already
have), which reading takes off again, so any text survives.  The loss mask is a
list of spans of the formatted string: each assistant text, without its marks.

Rows by turn are gathered per conversation, the natural unit of the output;
their order is turn, then role, then text.

Edge cases: null texts are empty, null roles are the empty role; a record with
a fingerprint that no mapping fits (a text that is a number, a list of bare
strings), with broken JSON, or nested too deep to parse has no turns and its
``layout`` is null; lone surrogates become U+FFFD; an empty table gives no rows;
a null conversation id is a conversation of its own.  Kept columns named like a
result get underscores in front.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import kept_as, small_batches, table

Turn = tuple[str, str]

#: The marks of the template around system, user and assistant texts, and of any other role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = "|".join(re.escape(x) for x in sorted({*sum(MARKS.values(), ()), *OTHER}, key=len, reverse=True))
_IN_TEXT = re.compile(rf"\\*(?:{_CONTROL})")
_MARK = re.compile(rf"(?<!\\)(?:{_CONTROL})")
_OPEN = {a: (role, b) for role, (a, b) in MARKS.items()}


Node = dict[str, "Node"]


def _kind(value: Any) -> str:
    """Type of a leaf: s string, 0 null, n number or boolean, d object, l list, e empty list."""
    if value is None:
        return "0"
    if isinstance(value, list):
        return "l" if value else "e"
    return "s" if isinstance(value, str) else "d" if isinstance(value, dict) else "n"


def paths(value: Any, known: Node) -> set[str]:
    """The nested field paths of a record that some mapping reads, with the type of what is there.

    ``known`` is the tree of those paths (``[]`` stands for the elements of a
    list).  Other fields are not visited, so neither their number nor their
    depth matters.
    """
    out: set[str] = set()
    todo: list[tuple[Any, Node, str]] = [(value, known, "")]
    while todo:
        value, node, at = todo.pop()
        if isinstance(value, list) and value and "[]" in node:
            todo += [(v, node["[]"], f"{at}[]") for v in value]
        elif isinstance(value, dict) and any(k != "[]" for k in node):
            out.add(f"{at}:d")
            todo += [(value[k], node[k], f"{at}.{k}") for k in node if k in value]
        else:
            out.add(f"{at}:{_kind(value)}")
    return out


def fingerprint(found: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Either ``turns`` (a list field with ``role`` and ``text`` inside), or ``fields``: role and the fields joined to its text.

    With ``parts`` the text is a list of parts, each with its text in that
    field (parts of other kinds have none); with ``either`` a string as well.
    """

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    parts: str | None = None
    either: bool = False
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def leaves(self) -> dict[str, str]:
        """The paths that the mapping reads, with the types that each may have."""
        if self.turns is None:
            return {f".{f}": "s0" for _, names in self.fields for f in names}
        at = f".{self.turns}[]"
        out = {f"{at}.{self.role}": "s0"}
        if self.parts is None or self.either:
            out[f"{at}.{self.text}"] = "s0e" if self.either else "s0"
        if self.parts:
            out[f"{at}.{self.text}[].{self.parts}"] = "s0"
        return out

    def fits(self, found: set[str]) -> bool:
        """Whether a record with these paths has all that the mapping reads, in types that it reads, and nothing else in its place."""
        leaves = self.leaves()
        above = {p[:k] for p in leaves for k in range(len(p)) if p.startswith((".", "[]"), k)}  # containers on the way
        types: dict[str, set[str]] = {}
        for f in found:
            path, _, kind = f.rpartition(":")
            types.setdefault(path, set()).add(kind)
        empty = any(p in types and types[p] <= {"e"} for p in above if p)  # a list without elements says nothing more
        for path, allowed in leaves.items():
            if path not in types and not empty:
                return False
            if not types.get(path, set()) <= set(allowed) and not (self.either and path in above):
                return False
        for path, kinds in types.items():
            if path in above:
                either = "s" if self.either and path in leaves else ""
                if not kinds <= set("d0e" + either) or path == "" and kinds != {"d"}:
                    return False
            elif path not in leaves and any(path.startswith((f"{p}.", f"{p}[")) for p in leaves):
                return False
        return True

    def read(self, record: dict) -> list[Turn]:
        if self.turns is None:
            texts = [(role, "\n\n".join(record[f] for f in names if record.get(f))) for role, names in self.fields]
            return [(role, text) for role, text in texts if text or role != "system"]
        out = []
        for t in record.get(self.turns) or []:
            t = t or {}
            role, text = t.get(self.role) or "", t.get(self.text) or ""
            if not isinstance(text, str):
                text = "".join((p or {}).get(self.parts) or "" for p in text)
            out.append((self.roles.get(role, role), text))
        return out


_SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("messages", turns="messages"),
    Mapping("message-parts", turns="messages", parts="text"),
    Mapping("message-mixed", turns="messages", parts="text", either=True),
    Mapping("from-value", turns="conversations", role="from", text="value", roles=_SHARED),
    Mapping("author-text", turns="dialog", role="author", text="text", roles=_SHARED),
    Mapping("prompt-completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt-response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question-answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction-input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("system-instruction-input", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


class Mappings:
    """Mappings by fingerprint.  What a new fingerprint selects is found once: of the mappings that fit, the one that reads most paths."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS) -> None:
        self.mappings = mappings
        self.known: Node = {}
        for m in mappings:
            for path in m.leaves():
                node = self.known
                for step in re.findall(r"\[\]|[^.\[\]]+", path):
                    node = node.setdefault(step, {})
        self.selected: dict[str, Mapping | None] = {}

    def select(self, record: Any) -> Mapping | None:
        found = paths(record, self.known)
        key = fingerprint(found)
        if key not in self.selected:
            self.selected[key] = max((m for m in self.mappings if m.fits(found)), key=lambda m: len(m.leaves()), default=None)
        return self.selected[key]

    def canonical(self, record: Any) -> tuple[str | None, list[Turn]]:
        """Layout name and turns of a record; (None, []) if no mapping fits."""
        m = self.select(record)
        return (m.name, m.read(record)) if m else (None, [])


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: m[0][1:] if m[0][0] == "\\" else m[0], text)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask."""
    out, size, spans = [], 0, []
    for role, text in turns:
        body = escape(text)
        if role in MARKS:
            before, after = f"{MARKS[role][0]} ", f" {MARKS[role][1]}"
        else:
            before, after = f"{OTHER[0]} {escape(role)} {OTHER[1]} ", f" {OTHER[2]}"
        if role == "assistant":
            spans.append((size + len(before), size + len(before) + len(body)))
        out += [before, body, after]
        size += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        opened = _MARK.match(formatted, at)
        if opened is None:
            raise ValueError(f"no mark at {at}")
        mark, role, end = opened[0], "", opened.end()
        if mark == OTHER[0]:
            middle = _MARK.search(formatted, end)
            role, end, close = unescape(formatted[end + 1 : middle.start() - 1]), middle.end(), OTHER[2]
        else:
            role, close = _OPEN[mark]
        closed = _MARK.search(formatted, end)
        if closed is None or closed[0] != close:
            raise ValueError(f"{close} is missing after {at}")
        turns.append((role, unescape(formatted[end + 1 : closed.start() - 1])))
        at = closed.end()
    return turns


def digests(formatted: str, spans: list[tuple[int, int]]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    turns = parse(formatted)
    loss = "".join(unescape(formatted[a:b]) for a, b in spans)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)


def format_records(records: DataFrame, json_col: str = "record", keep: tuple[str, ...] = ("conv_id",), mappings: tuple[Mapping, ...] = MAPPINGS, digest: bool = False) -> DataFrame:
    """The ``keep`` columns with layout, formatted and loss_spans; with ``digest`` what :func:`digests` gives instead."""
    rows = records.select(*keep, F.col(json_col).cast("string").alias("_json"))
    fields = rows.schema.fields[:-1]
    own = ["formatted", "loss_spans"] if not digest else ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    names = [*kept_as(keep, ("layout", *own)), "layout", *own]
    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, fields, strict=False)) + ", layout string"
    schema += ", formatted string, loss_spans array<array<int>>" if not digest else ", n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.string(), pa.list_(pa.list_(pa.int32()))] if not digest else [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Mappings(mappings)
        for batch in batches:
            layouts, made = [], []
            for text in batch.column(batch.num_columns - 1):
                try:
                    layout, turns = known.canonical(json.loads(text.as_py() or "null"))
                except (ValueError, RecursionError):  # no JSON, or nested too deep to be a conversation
                    layout, turns = None, []
                turns = [(_utf8(role), _utf8(text)) for role, text in turns]
                formatted, spans = render(turns)
                layouts.append(layout)
                made.append(digests(formatted, spans) if digest else (formatted, [list(s) for s in spans]))
            new = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(layouts, pa.string()), *new], names=names)

    return small_batches(rows).mapInArrow(run, schema)


def _utf8(text: str) -> str:
    """``text`` with lone surrogates (JSON can spell them, no string column can hold them) as U+FFFD."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def conversation_records(turns: DataFrame, id_col: str = "conv_id", layouts: tuple[str, ...] = ("messages",)) -> DataFrame:
    """Rows by turn as one record (JSON) for each conversation, dealt to the ``layouts`` by a hash of the id.

    Layouts are names of ``MAPPINGS``.  A conversation that its layout can't
    hold (a pair of fields holds one user's and one assistant's text; a shared
    role name would be read as another) is a ``messages`` record.
    """
    by_name = {m.name: m for m in MAPPINGS}
    row = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    gathered = turns.select(F.col(id_col), row.alias("t")).groupBy(id_col).agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda t: t["role"])

    def one(name: str) -> tuple[Column, Column]:
        """Whether a conversation can have this layout, and its record."""
        m = by_name[name]
        if m.turns is None:
            wanted = F.array(*[F.lit(role) for role, _ in m.fields])
            fields = [F.get(F.col("t"), k)["content"].alias(names[0]) for k, (_, names) in enumerate(m.fields)]
            return (roles == wanted) & F.lit(all(len(names) == 1 for _, names in m.fields)), F.to_json(F.struct(*fields, F.lit("x").alias("id")))
        back = {v: k for k, v in reversed(m.roles.items())}  # the first name of each role
        spoken: Callable[[Column], Column] = lambda r: reduce(lambda c, kv: c.when(r == kv[0], kv[1]), back.items(), F.when(F.lit(False), "")).otherwise(r)

        def content(t: Column) -> Column:
            return F.array(F.struct(F.lit("text").alias("type"), t["content"].alias(m.parts))) if m.parts else t["content"]

        message = F.transform("t", lambda t: F.struct(spoken(t["role"]).alias(m.role), content(t).alias(m.text)))
        holds = ~F.arrays_overlap(roles, F.array(*[F.lit(r) for r in m.roles])) if m.roles else F.lit(True)
        return holds, F.to_json(F.struct(message.alias(m.turns), F.lit(1).alias("version")))

    which = F.pmod(F.xxhash64(id_col), F.lit(len(layouts)))
    made = F.when(F.lit(False), F.lit(""))
    for k, name in enumerate(layouts):
        holds, record = one(name)
        made = made.when((which == k) & holds, record)
    return gathered.select(id_col, made.otherwise(one("messages")[1]).alias("record"))


#: Layouts that the query's records have in turn.
QUERY_LAYOUTS = ("messages", "message-parts", "from-value", "author-text", "prompt-completion", "question-answer")
PLANTED = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    records = conversation_records(turns.unionByName(planted), layouts=QUERY_LAYOUTS)
    return format_records(records, digest=True).drop("layout")


OP7_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}')),
e AS (SELECT *, length(regexp_replace(text, '(\\*)({"|".join(re.escape(x) for x in sorted({*sum(MARKS.values(), ()), *OTHER}, key=len, reverse=True))})', '\\\1\2', 'g')) AS n,
   CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b) + 2}" for r, (a, b) in MARKS.items())} END AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + m) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
