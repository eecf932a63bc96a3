"""Personal data in texts.  DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards,
mod-97 for IBANs, ranges and digit counts for addresses and phones), and words
within ``CONTEXT`` code points adjust the score of a proposal; what reaches
``THRESHOLD`` is reported.  The four base kinds (email, ip, card, phone) follow
fixed patterns and stay whatever their context; further proposals are added
where they don't overlap a base span.  A base span that starts more than
``SECRET_HEAD`` code points into a secret is a part of it and doesn't displace it.

Positions come from cutting the text at the matches: with ``n`` matches there
are ``n + 1`` pieces, and running lengths give starts and ends in code points.
Running totals are taken in two levels, overlaps by a sweep over sorted spans,
and context is looked up in parts of the text: the work grows with the text and
``n log n``, however many matches a text has.
The patterns are written so that Java's matcher neither backtracks over long
runs nor recurses: a run is entered at its start only (or where the last match
ended), and repeated groups are bounded or replaced by lookarounds.

Edge cases: a null or empty text has no spans and the digest of the empty
string; other columns, null ids and repeated rows are passed along; a column
named like one of the two results must be renamed by the parameters, else it is
an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import table

CONTEXT = 40
SECRET_HEAD = 24
THRESHOLD = 0.5

#: The base kinds in order, as patterns without deep repetition.
#: email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card   [0-9]([ -]?[0-9])+  of 12 to 19 digits
#: phone  \+[0-9][ ().0-9-]+[0-9]  of 9 to 15 digits
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?:[^A-Za-z0-9.-]|\z))"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

#: Further proposals: kind, pattern, cheap test of the text, prior score, bonus of a passed checksum, context words.
CARD_BLOCK = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE_BLOCK = r"(?<![0-9])\+?[0-9]{0,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:(?<![a-z])(?:password|passwd|secret|token|api[_-]?key))\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/.~-]{8,}+"
EXTRA = (
    ("card", CARD_BLOCK, "[0-9]{4}", 0.2, 0.5, "card|visa|credit|payment|account|carte|tarjeta|karte"),
    ("phone", PHONE_BLOCK, r"\(", 0.55, 0.0, "phone|call|tel|mobile|fax"),
    ("iban", IBAN, "[A-Z]{2}[0-9]{2}", 0.2, 0.5, "iban|bank|account|konto|compte|cuenta"),
    ("ssn", SSN, "[0-9]-[0-9]", 0.3, 0.0, "ssn|social security|tax"),
    ("secret", SECRET, "AKIA|[=:]", 0.6, 0.0, "key|login|secret|credential"),
)
CONTEXT_BONUS = 0.25
AGAINST = "isbn|order no|part no|serial|version"
AGAINST_LOSS = 0.3

#: Sizes from which arrays are worked on in runs and texts in parts, so that work stays linear in the matches.
RUN = 256
PART = 1024
MANY = 64
PAIRS = 4096

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn test."""

    def value(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    digits = F.split(F.reverse(_digits(text)), "")
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether ``text`` without spaces has remainder 1 as an IBAN (letters count as 10 to 35)."""
    code = F.regexp_replace(text, " ", "")
    turned = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")

    def step(a: Column, x: Column) -> Column:
        v = F.ascii(x)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Inclusive running totals of an int array under an associative ``step``.

    Appending to an array copies it, so runs of ``RUN`` elements are totalled
    on their own, then the totals of the runs, and both are put together.
    """

    def short(xs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))

        def more(acc: Column, x: Column) -> Column:
            at = step(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(xs, start, more, lambda acc: acc["out"])

    def runs(xs: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int"))
        return F.transform(cuts, lambda k: short(F.slice(xs, k * RUN + 1, RUN)))

    def long(xs: Column) -> Column:
        def joined(inner: Column) -> Column:
            before = F.concat(F.array(zero), short(F.transform(inner, lambda i: F.element_at(i, -1))))
            return _let(before, lambda b: F.flatten(F.transform(inner, lambda i, k: F.transform(i, lambda x: step(F.get(b, k), x)))))

        return _let(runs(xs), joined)

    return _let(values, lambda xs: F.when(F.size(xs) <= RUN, short(xs)).otherwise(long(xs)))


def _matches(text: Column, pattern: str, test: Column) -> Column:
    """Array of (start, end, match) of all leftmost non-overlapping matches."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def placed(found: Column) -> Column:
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda piece, m: F.length(piece) + F.length(m))
        ends = running(sizes, lambda a, x: a + x, F.lit(0))
        place = lambda e: F.transform(found, lambda m, k: F.struct((F.get(e, k) - F.length(m)).alias("start"), F.get(e, k).alias("end"), m.alias("match")))
        return F.when(F.size(found) == 0, none).otherwise(_let(ends, place))

    return F.when(test, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _cut(text: Column, many: Column) -> Column:
    """``text`` in parts of ``PART`` code points where ``many`` (a substring is found from the start of its string), else null."""
    return F.when(many, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))


def _sub(text: Column, parts: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` (0 is the first), by way of the parts where there are any."""
    first = F.floor(start / PART).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.floor((start + size) / PART).cast("int") - first + 1), "")
    return F.when(parts.isNull(), F.substring(text, start + 1, size)).otherwise(F.substring(near, start - first * PART + 1, size))


def _span(x: Column, kind: str, score: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))


def base_spans(text: Column) -> Column:
    """The four base kinds, sorted by start and kind."""
    digits = text.rlike("[0-9]")
    valid = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}\z"),
        "card": luhn,
        "phone": lambda m: F.length(_digits(m)).between(9, 15),
    }
    tests = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": digits, "phone": F.contains(text, F.lit("+"))}

    def confirmed(kind: str, pattern: str) -> Column:
        right = F.filter(_matches(text, pattern, tests[kind]), lambda x: valid[kind](x["match"]))
        return F.transform(right, lambda x: _span(x, kind, F.lit(1.0)))

    found = [confirmed(kind, pattern) for kind, pattern in zip(BASE_KINDS, (EMAIL, IP, CARD, PHONE), strict=True)]
    return F.array_sort(F.concat(*found))


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (span and the end that counts) that overlap no base span, by a sweep over both in order of start."""
    event = lambda start, own, end, span: F.struct(start.alias("start"), F.lit(own).alias("own"), end.alias("end"), span.alias("span"))
    none = F.lit(None).cast(SPAN)
    both = F.concat(F.transform(base, lambda b: event(b["start"], 0, b["end"], none)), F.transform(spans, lambda s: event(s["span"]["start"], 1, s["end"], s["span"])))
    far = F.lit(2**31 - 1)

    def swept(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0)), lambda a, x: F.greatest(a, x), F.lit(0))
        starts = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["own"] == 0, e["start"]).otherwise(far))), lambda a, x: F.least(a, x), far))
        free = lambda e, k, before, after: (e["own"] == 1) & (F.get(before, k) <= e["start"]) & (F.get(after, k) >= e["end"])
        return _let(ends, lambda before: _let(starts, lambda after: F.transform(F.filter(events, lambda e, k: free(e, k, before, after)), lambda e: e["span"])))

    pairwise = F.transform(F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["span"]["start"] < b["end"]))), lambda s: s["span"])
    return F.when(F.size(spans) * F.size(base) <= PAIRS, pairwise).otherwise(_let(F.array_sort(both), swept))


def added_spans(text: Column, base: Column, threshold: float = THRESHOLD) -> Column:
    """Further proposals that reach the threshold and overlap no base span."""

    def scored(x: Column, parts: Column, prior: float, bonus: float, words: str, kind: str) -> Column:
        start = F.greatest(F.lit(0), x["start"] - CONTEXT)
        near = _sub(text, parts, start, x["end"] - x["start"] + 2 * CONTEXT)
        score = F.lit(prior)
        if bonus:
            passed = luhn(x["match"]) if kind == "card" else mod97(x["match"])
            score = F.when(passed, score + bonus).otherwise(F.lit(0.0))
        score = score + F.when(near.rlike(f"(?i:{words})"), CONTEXT_BONUS).otherwise(0.0)
        return score - F.when(near.rlike(f"(?i:{AGAINST})"), AGAINST_LOSS).otherwise(0.0)

    def proposals(kind: str, pattern: str, test: str, prior: float, bonus: float, words: str) -> Column:
        none = F.array().cast(f"array<{SPAN}>")
        end = lambda s: F.least(s["end"], s["start"] + SECRET_HEAD) if kind == "secret" else s["end"]

        def judged(found: Column) -> Column:
            spans = _let(_cut(text, F.size(found) > MANY), lambda parts: F.transform(found, lambda x: _span(x, kind, scored(x, parts, prior, bonus, words, kind))))
            likely = F.transform(F.filter(spans, lambda s: s["score"] >= threshold), lambda s: F.struct(s.alias("span"), end(s).alias("end")))
            return F.when(F.size(found) == 0, none).otherwise(_let(likely, lambda x: _apart(x, base)))

        return _let(_matches(text, pattern, text.rlike(test)), judged)

    return F.concat(*[proposals(*row) for row in EXTRA])


def find_pii(docs: DataFrame, text_col: str = "text", base_col: str = "pii_base", spans_col: str = "pii_spans", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base spans and all spans as arrays of (start, rank, end, kind, score)."""
    clash = {base_col.lower(), spans_col.lower()} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"result columns exist already: {sorted(clash)}")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with_base = docs.withColumn(base_col, base_spans(text))
    return with_base.withColumn(spans_col, F.array_sort(F.concat(F.col(base_col), added_spans(text, F.col(base_col), threshold))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span (of overlapping ones the first, extended to cover all) as ``[KIND]``; ``spans`` in order of start."""
    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))

    def heads(upto: Column) -> Column:
        """The spans that start after all before them have ended, each with where those ended."""
        seen = lambda k: F.when(k == 0, 0).otherwise(F.get(upto, k - 1))
        each = F.transform(spans, lambda s, k: F.struct(seen(k).alias("from"), s["start"].alias("start"), s["kind"].alias("kind"), (k == 0).alias("first")))
        return F.filter(each, lambda h: h["first"] | (h["start"] >= h["from"]))

    def written(upto: Column, parts: Column) -> Column:
        piece = lambda h: F.concat(_sub(text, parts, h["from"], h["start"] - h["from"]), F.lit("["), F.upper(h["kind"]), F.lit("]"))
        tail = F.substring(text, F.element_at(upto, -1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(heads(upto), piece), ""), tail)

    made = _let(ends, lambda upto: _let(_cut(text, F.size(spans) > MANY), lambda parts: written(upto, parts)))
    return F.when(F.size(spans) == 0, text).otherwise(made)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_base", "pii_spans")
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(F.col("pii_base")), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
