"""Secret scan with multipart linking.

Base spans are found by three fixed patterns. A credential often has several parts, each of which proves little by
itself: an access identifier, a secret, an endpoint. Candidates of the three kinds are found by wide patterns and joined
as intervals: within a scope (a paragraph, cut where the text falls silent about credentials for longer than `REACH`
code points) each candidate is matched with the nearest of the complementary kinds. Weak candidates are reported only if
a secret stands together with an identifier or an endpoint; alone they are dropped. A candidate that overlaps a base span is
no candidate, and a part that starts where another starts is not its complement.

The join runs within a document's own row, by sorted starts, so nothing is shuffled.

Cases. A null or empty text has no spans, and redacts to itself. Repeated rows and ids are scanned one by one. Columns
other than those asked for are not read. Texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame

from roadgeo.llm.common import by_row

# Fixed values of the contract: the base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 16 or more starts where the whole run starts, so asking for 16 finds the runs that are long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "linked_id", "linked_secret", "linked_endpoint")

#: Candidates that say nothing alone. Each pattern consumes a whole run, so a scan takes time linear in the text.
CANDIDATES = {
    "linked_id": re.compile(r"""\b(?:user(?:name)?|login|account|client[_-]?id|access[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.IGNORECASE | re.ASCII),
    "linked_secret": re.compile(r"""\b(?:pwd|pass|private[_-]?key|auth|bearer|credentials?)["']?\x20*[:=]\x20*["']?([^\s"',;]{6,})""", re.IGNORECASE | re.ASCII),
    "linked_endpoint": re.compile(r"""\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]{4,}|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}""", re.IGNORECASE | re.ASCII),
}
#: A run that looks like key material: long, with upper case, lower case and digits.
MATERIAL = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PARAGRAPH = re.compile(r"\n[\x20\t]*\n")
REACH = 240
REDACTED = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _mixed(run: str) -> bool:
    return any(c.isdigit() for c in run) and any("A" <= c <= "Z" for c in run) and any("a" <= c <= "z" for c in run)


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates that a complementary part confirms."""
    weak = [(m.start(), m.end(), kind) for kind, p in CANDIDATES.items() for m in p.finditer(text)]
    weak += [(m.start(), m.end(), "linked_secret") for m in MATERIAL.finditer(text) if _mixed(m.group())]
    if not weak:
        return []
    covered = sorted(base)
    begins, reach_to = [s for s, _, _ in covered], list(accumulate((e for _, e, _ in covered), max))

    def in_base(start: int, end: int) -> bool:
        """Whether any base span overlaps: of those that start before `end`, the one that reaches furthest tells."""
        i = bisect_left(begins, end)
        return i > 0 and reach_to[i - 1] > start

    weak = sorted({w for w in weak if not in_base(w[0], w[1])})
    role = {"assign": "linked_secret", "hex": "linked_secret", "access": "linked_id"}
    parts = sorted([(s, e, k) for s, e, k in weak] + [(s, e, role[k]) for s, e, k in base])
    breaks = [m.start() for m in PARAGRAPH.finditer(text)]
    scope = lambda s: bisect_left(breaks, s)
    starts = {k: [s for s, _, kind in parts if kind == k] for k in CANDIDATES}

    def near(kind: str, start: int) -> bool:
        """Whether a part of this kind starts in the scope, within reach on either side."""
        own = starts[kind]
        neighbours = bisect_left(own, start) - 1, bisect_right(own, start)
        return any(0 <= j < len(own) and abs(own[j] - start) <= REACH and scope(own[j]) == scope(start) for j in neighbours)

    partners = {"linked_secret": ("linked_id", "linked_endpoint"), "linked_id": ("linked_secret",), "linked_endpoint": ("linked_secret",)}
    return [(s, e, k) for s, e, k in weak if any(near(p, s) for p in partners[k])]


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str | None) -> tuple[list, list]:
    """The base spans and the linked ones of a text."""
    text = text or ""
    base = base_spans(text)
    return base, linked_spans(text, base)


def _report(doc_id, text):
    base, linked = scan_text(text)
    kinds = [k for _, _, k in base]
    return (doc_id, *(kinds.count(k) for k in BASE), hashlib.sha256(_line(base).encode()).hexdigest(), _line([*base, *linked]), len(linked))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, their digest, all spans and the number of linked ones."""
    return by_row(docs.select("doc_id", "text"), _report, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint")


def redact_text(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by one mark."""
    if not text:
        return text
    spans = sorted((s, e) for found in scan_text(text) for s, e, _ in found)
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], REDACTED]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, with secrets in `text` replaced and `n_chars`, if asked for, counted anew."""
    at, n = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def row(*values):
        values = list(values)
        new = redact_text(values[at])
        if n is not None and new != values[at]:
            values[n] = len(new)
        values[at] = new
        return tuple(values)

    picked = docs.select(*columns)
    return by_row(picked, row, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema))
