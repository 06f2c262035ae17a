"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus-signs, digits, URL schemes and identifier cues ("iban", "account",
"token", ...). A deterministic parser expands each anchor to the boundaries of its candidate and validates it. Base kinds (email, ip,
card, phone) give exactly the leftmost non-overlapping matches of their patterns, with candidates that fail validation dropped; the parsers
are linear where a backtracking search would not be. Added kinds (url, iban, account, secret) never overlap base spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

# What anchors the search.
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "www.")
CUES = {
    "iban": ("iban",),
    "account": ("account", "acct", "passport", "ssn", "social security", "customer id", "member id", "routing"),
    "secret": ("token", "password", "passwd", "secret", "api_key", "apikey", "api key", "access key"),
}

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+")
DIGITS = re.compile(r"[0-9]")
URL_REST = re.compile(r"[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
HOST = re.compile(r"(?:[^@/?#]*@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?=[/?#]|$)")
GLUE = re.compile(r"(?:[\x20\t]*(?:number|no\.?|nr\.?|id|#|is))?[\x20\t]*[:=#]?[\x20\t]*[\"']?", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[A-Za-z0-9](?:[-/]?[A-Za-z0-9]){4,33}")
SECRET = re.compile(r"[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9_\-+/=.]{12,})")

Span = tuple[str, int, int]


@lru_cache(1)
def anchors():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in "0123456789":
        machine.add_word(word, ("digit", 1))
    machine.add_word("@", ("at", 1))
    machine.add_word("+", ("plus", 1))
    for kind, words in [("url", SCHEMES), *CUES.items()]:
        for word in words:
            for form in {word, word.upper(), word.capitalize(), word.title()}:
                machine.add_word(form, (kind, len(form)))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def email_at(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at ``at``; its local part starts at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL_CHARS:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return ("email", start, domain.end()) if domain else None


def ips_in(text: str, start: int, end: int) -> list[Span]:
    """Groups of four in a chain of numbers joined by dots."""
    found, at, four = [], start, []
    for part in text[start:end].split("."):
        four.append((part, at, at + len(part)))
        at += len(part) + 1
        if len(four) == 4:
            small = [p.lstrip("0") for p, _, _ in four]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in small):
                found.append(("ip", four[0][1], four[3][2]))
            four = []
    return found


def phone_at(text: str, start: int) -> Span | None:
    run = DIALLED.match(text, start)
    if not run:
        return None
    end = run.end()
    while end > start and not "0" <= text[end - 1] <= "9":
        end -= 1
    ok = end - start >= 4 and 9 <= len(DIGITS.findall(text, start, end)) <= 15
    return ("phone", start, end) if ok else None


def url_at(text: str, start: int, end: int) -> Span | None:
    """The URL whose scheme ends at ``end``, with a dotted host; a closing stop or bracket is not part of it."""
    rest = URL_REST.match(text, end)
    if not rest:
        return None
    stop = rest.end()
    while stop > end and text[stop - 1] in ".,;:!?)]'":
        stop -= 1
    host = text[end:stop] if "//" in text[start:end] else text[start:stop]
    return ("url", start, stop) if HOST.match(host) else None


def identifier_after(text: str, kind: str, end: int) -> Span | None:
    """The value behind a cue that ends at ``end``."""
    if kind == "secret":
        m = SECRET.match(text, end)
        return ("secret", m.start(1), m.end(1)) if m and DIGITS.search(m[1]) else None
    at = GLUE.match(text, end).end()
    if at == end:
        return None
    m = (IBAN if kind == "iban" else ACCOUNT).match(text, at)
    if not m:
        return None
    ok = iban_valid(m[0]) if kind == "iban" else len(DIGITS.findall(m[0])) >= 5
    return (kind, m.start(), m.end()) if ok else None


def spans_of(text: str) -> list[Span]:
    """All spans of a text, base kinds first, by kind and start; code points, end exclusive."""
    base: dict[str, list[Span]] = {k: [] for k in KINDS}
    more: list[Span] = []
    email_end = dotted_end = grouped_end = 0
    for last, (kind, size) in anchors().iter(text):
        start, end = last + 1 - size, last + 1
        if kind == "digit":
            if start >= dotted_end:
                dotted_end = DOTTED.match(text, start).end()
                base["ip"] += ips_in(text, start, dotted_end)
            if start >= grouped_end and (m := GROUPED.match(text, start)):
                grouped_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    base["card"].append(("card", start, m.end()))
        elif kind == "at":
            if span := email_at(text, start, email_end):
                email_end = span[2]
                base["email"].append(span)
        elif kind == "plus":
            if span := phone_at(text, start):
                base["phone"].append(span)
        elif span := url_at(text, start, end) if kind == "url" else identifier_after(text, kind, end):
            more.append(span)
    if more:
        starts, ends = merged([span[1:] for k in BASE_KINDS for span in base[k]])
        for span in set(more):
            if bisect_right(ends, span[1]) == bisect_left(starts, span[2]):  # no base span between
                base[span[0]].append(span)
    return [span for k in KINDS for span in sorted(base[k])]


def merged(intervals: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of intervals."""
    starts, ends = [], []
    for start, end in sorted(intervals):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, replace: bool = False) -> DataFrame:
    """``doc_id, spans`` of every row and, with ``replace``, the ``redacted`` text. A null text has no spans and stays null."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [spans_of(t) if t else [] for t in texts]
            columns = [batch.column(0), pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], _ARROW)]
            if replace:
                columns.append(pa.array([redacted(t, x) if x else t for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "redacted"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}" + ", redacted string" * replace)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the checksum of base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
