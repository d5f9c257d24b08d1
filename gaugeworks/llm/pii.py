"""Personal data: fixed patterns, and spans that a trained tagger adds."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

from pyspark.sql import DataFrame

from gaugeworks.llm.common import per_row
from gaugeworks.llm.tagger import KINDS, TAGGED, Model, decode, default_model, luhn

# The patterns. A lookbehind keeps a search from starting inside a run of digits, where it would find
# nothing that it didn't find at the start of the run, so that time stays in proportion to the text.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")


def count_digits(s: str) -> int:
    return sum("0" <= c <= "9" for c in s)


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from each @: its name is the run of name characters before it, after the last match."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > free and LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def base(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind; matches that fail a kind's check are dropped."""
    if not ANCHOR.search(text):
        return {k: [] for k in KINDS}
    ips = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    cards = [m.span() for m in CARD.finditer(text) if 16 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in PHONE.finditer(text) if 8 <= count_digits(m[0]) <= 15]
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


def holds(kind: str, s: str) -> bool:
    """An exact check of what the tagger found: whatever separates its parts, a span must have the parts of its kind."""
    numbers = re.findall(r"[0-9]+", s)
    digits = "".join(numbers)
    if kind == "email":
        folded = re.sub(r"\s*[\[(]?([@.])[\])]?\s*", r"\1", s)
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", folded))
    if kind == "ip":
        between = {re.sub(r"\s", "", x) for x in re.split(r"[0-9]+", s)[1:-1]}
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers) and between <= {"[.]", "(.)", "."} and len(between) == 1
    if kind == "secret":
        # a key's value: long, of one piece, of letters and digits that change often
        changes = sum(a.isdigit() != b.isdigit() for a, b in itertools.pairwise(s))
        return bool(re.fullmatch(r"[A-Za-z0-9]{16,128}", s)) and 5 * changes >= len(s)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9\s./-]", s)
    return 8 <= len(digits) <= 15 and len(numbers) >= 3 and not re.search(r"[^0-9\s()+./-]", s)


def added(text: str, found: list[tuple[str, int, int]], known: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """Spans of the tagger that hold, stand by themselves and touch no span of the patterns."""
    taken = sorted(s for spans in known.values() for s in spans)
    starts, reach = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    out = []
    for kind, s, e in found:
        while s < e and text[s] in " \t\r\n,;:.":
            s += 1
        while s < e and text[e - 1] in " \t\r\n,;:.":
            e -= 1
        alone = not (s > 0 and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
        if s < e and alone and holds(kind, text[s:e]) and not ((k := bisect.bisect_left(starts, e)) and reach[k - 1] > s):
            out.append((kind, s, e))
    return out


def spans(texts: list[str], model: Model) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """For each text the pattern spans by kind, and what the tagger adds."""
    known = [base(t) for t in texts]
    return [(k, added(t, found, k)) for t, k, found in zip(texts, known, decode(model, texts), strict=True)]


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, added>> of each document, in code points, end exclusive.

    Spans of the fixed patterns always stay. A bidirectional LSTM over characters with CRF transitions, trained from
    labelled spans on the driver, adds others, and values of keys and tokens as kind secret: it reads overlapping windows wherever a digit or an @ stands near,
    and the windows' scores are put together before one decoding. The model's size is fixed, whatever the input.
    Whole texts of any length are read; null or empty text has no spans; repeated rows and ids are
    each read; an empty table gives no rows; other columns are not read.
    """
    model = model or default_model()

    def f(c: dict[str, list]) -> list:
        out = []
        for known, more in spans([t or "" for t in c["text"]], model):
            own = [{"kind": k, "start": s, "end": e, "added": False} for k in KINDS for s, e in known[k]]
            out.append(own + [{"kind": k, "start": s, "end": e, "added": True} for k, s, e in more])
        return [c["id"], out]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_row(docs.selectExpr("doc_id as id", "text"), f"doc_id {kind}, spans array<struct<kind: string, start: int, end: int, added: boolean>>", "text", f)


def joined(spans: list[dict]) -> str:
    """Spans as kind:start:end, by kind as listed, then by start."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (TAGGED.index(s["kind"]), s["start"], s["end"])))


def report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts of the patterns by kind, the digest of their spans, all spans, and from these how many the tagger added, how many
    are secrets, and how many there are, from ``find``."""
    found = find(docs, model)

    def f(c: dict[str, list]) -> list:
        own = [[s for s in all_of if not s["added"]] for all_of in c["spans"]]
        counts = [[sum(s["kind"] == k for s in o) for o in own] for k in KINDS]
        return [c["doc_id"], *counts, [hashlib.sha256(joined(o).encode()).hexdigest() for o in own], [joined(s) for s in c["spans"]], [len(a) - len(o) for a, o in zip(c["spans"], own, strict=True)], [sum(s["kind"] == "secret" for s in a) for a in c["spans"]], [len(a) for a in c["spans"]]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {kind}, {names}, base_sha256 string, spans string, n_added long, n_secret long, n_spans long"
    return per_row(found.selectExpr("*", "'' as sized"), schema, "sized", f)
