"""PII by anchor expansion.

One Aho-Corasick pass finds anchors (at-signs, plus signs, digits, URL schemes
and identifier cues); deterministic local parsers expand each anchor to the
boundaries of an address, number or account and validate it. Nothing scans
the text but the automaton. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.textkit import slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base kinds.
EXTRA_KINDS = ("account", "url_login")
CUES = ("account no", "account number", "acct", "iban", "passport", "ssn", "api_key", "api key", "secret", "token=")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
PHONE = frozenset("0123456789 ().-")
IDENT = DOMAIN | {"_"}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def build_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in DIGITS:
        a.add_word(d, ("0", 1))
    for s in SCHEMES:
        a.add_word(s, ("s", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.title(), c.capitalize()}:
            a.add_word(form, ("c", len(form)))
    a.make_automaton()
    return a


def _run(text: str, i: int, chars: frozenset) -> int:
    n = len(text)
    while i < n and text[i] in chars:
        i += 1
    return i


def parse_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand around an at-sign: local part back to ``floor`` at most, then two or more dot-joined labels."""
    a = at
    while a > floor and text[a - 1] in LOCAL:
        a -= 1
    if a == at:
        return None
    end = _run(text, at + 1, DOMAIN)
    if end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, DOMAIN)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (a, end) if labels else None


def parse_dotted(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The digit groups joined by single dots from ``at`` on, and their end."""
    parts, i = [], at
    while True:
        j = _run(text, i, DIGITS)
        parts.append((i, j))
        if j + 1 < len(text) and text[j] == "." and text[j + 1] in DIGITS:
            i = j + 1
        else:
            return parts, j


def parse_card(text: str, at: int) -> int:
    """End of the digit run from ``at`` that single blanks or hyphens may interrupt."""
    i, n = at + 1, len(text)
    while i < n:
        if text[i] in DIGITS:
            i += 1
        elif text[i] in " -" and i + 1 < n and text[i + 1] in DIGITS:
            i += 2
        else:
            break
    return i


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        v = ord(ch) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def parse_phone(text: str, plus: int) -> int | None:
    """End of ``+`` digit, one or more phone characters, digit; as long as possible."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end - plus >= 4 else None


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, each list in order and free of overlaps within its kind. Every candidate match uses up its text, whether it is valid or not."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + EXTRA_KINDS}
    email_at = card_at = phone_at = dotted_at = extra_at = 0
    for last, (what, size) in automaton.iter(text):
        if what == "0":
            if last >= card_at:
                card_at = parse_card(text, last)
                if card_at - last >= 16:
                    digits = text[last:card_at].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((last, card_at))
            if last >= dotted_at:
                parts, dotted_at = parse_dotted(text, last)
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    if all(len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
                        out["ip"].append((four[0][0], four[3][1]))
        elif what == "@":
            if last >= email_at and (m := parse_email(text, last, email_at)):
                out["email"].append(m)
                email_at = m[1]
        elif what == "+":
            if last >= phone_at and (end := parse_phone(text, last)):
                phone_at = end
                if 8 <= sum(c in DIGITS for c in text[last:end]) <= 15:
                    out["phone"].append((last, end))
        elif what == "s":
            a = last - size + 1
            end = _run(text, last + 1, LOCAL | {":"})
            if a >= extra_at and end < len(text) and text[end] == "@" and ":" in text[last + 1 : end]:
                extra_at = max(extra_at, end)
                out["url_login"].append((a, end))
        elif last >= extra_at:
            i = last + 1
            while i < len(text) and i - last <= 4 and text[i] in " :#=.":
                i += 1
            end = _run(text, i, IDENT)
            if end - i >= 6 and sum(c in DIGITS for c in text[i:end]) >= 4:
                out["account"].append((i, end))
                extra_at = end
    out["account"].sort()
    return out


def render(spans: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document (null text: empty, no spans; repeated rows each give one)."""

    def run(batches):
        automaton = build_automaton()
        for b in slices(batches):
            rows = []
            for text in b.column(text_col).to_pylist():
                found = find_spans(text or "", automaton)
                base = render(found, KINDS)
                rows.append((*(len(found[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), render(found, KINDS + EXTRA_KINDS)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", *names])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)
