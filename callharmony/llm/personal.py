"""Personal data by anchors: an automaton finds cues, small parsers expand each to its boundaries and check it.

One Aho-Corasick pass over the whole text gives the places of at-signs, plus signs before digits, digits, schemes
and words that announce an account. A parser starts from its cue, walks to both boundaries and validates.
Kinds are independent of each other; spans of one kind never overlap, and a match that fails its check is
dropped together with its characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from callharmony.llm.tables import column

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

# Fixed by the task.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"://[^\s<>\"'`{}|\\^\[\]]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_ACCOUNT = re.compile(r"(?:\s?(?:no|nr|number|#))?\.?\s?[:=#]\s?\"?([A-Za-z]{0,4}-?[0-9][0-9-]{5,30})(?![A-Za-z0-9])", re.IGNORECASE)
SCHEMES = ("http", "https", "ftp", "mailto", "ssh", "jdbc")
CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "konto", "Konto", "cuenta", "Cuenta", "compte", "Compte")
IBAN_CUES = ("IBAN", "iban", "Iban")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", "at")
    found.add_word("://", "scheme")
    for digit in "0123456789":
        found.add_word(digit, "digit")
        found.add_word(f"+{digit}", "plus")
    for cue in CUES:
        found.add_word(cue, "account")
    for cue in IBAN_CUES:
        found.add_word(cue, "iban")
    found.make_automaton()
    return found


_cues: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    end = 0
    for at in anchors:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = start < at and _DOMAIN.match(text, at + 1)
        if domain:
            end = domain.end()
            yield "email", start, end


def _ips(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    end = 0
    for at in anchors:
        if at < end:
            continue
        match = _IP.match(text, at)
        end = match.end() if match else _DIGITS.match(text, at).end()
        if match and all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in match[0].split(".")):
            yield "ip", at, end


def _cards(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    end = 0
    for at in anchors:
        match = at >= end and _CARD.match(text, at)
        if match:
            end = match.end()
            digits = match[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", at, end


def _phones(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    for at in anchors:
        match = _PHONE.match(text, at)
        if match and 9 <= sum(map(str.isdigit, match[0])) <= 15:
            yield "phone", at, match.end()


def _urls(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    end = 0
    for at in anchors:
        start = at
        while start > max(end, at - 10) and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        match = text[start:at].lower() in SCHEMES and _URL.match(text, at)
        if match:
            end = at + len(match[0].rstrip(".,;:!?)"))
            if end > at + 3:
                yield "url", start, end


def _ibans(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    """The account right after its cue, with a valid checksum."""
    for at in anchors:
        while at < len(text) and text[at] in " :=\"":
            at += 1
        match = _IBAN.match(text, at)
        if match:
            code = match[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                yield "iban", at, match.end()


def _accounts(text: str, anchors: list[int]) -> Iterator[tuple[str, int, int]]:
    for at in anchors:
        match = _ACCOUNT.match(text, at)
        if match:
            yield "account", *match.span(1)


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start and then in the order of ``KINDS``; none for a null."""
    if not text:
        return []
    if not _cues:
        _cues.append(_automaton())
    anchors: dict[str, list[int]] = {"at": [], "digit": [], "plus": [], "scheme": [], "account": [], "iban": []}
    for end, cue in _cues[0].iter(text):
        anchors[cue].append(end)
    found = [
        *_emails(text, anchors["at"]),
        *_ips(text, anchors["digit"]),
        *_cards(text, anchors["digit"]),
        *_phones(text, [end - 1 for end in anchors["plus"]]),
        *_urls(text, [end - 2 for end in anchors["scheme"]]),
        *_ibans(text, [end + 1 for end in anchors["iban"]]),
        *_accounts(text, [end + 1 for end in anchors["account"]]),
    ]
    return sorted(found, key=lambda span: (span[1], KINDS.index(span[0]), span[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def mask(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one stands."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]]) if text else text


def find_personal(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", masked: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_<kind> for each of BASE, base_sha256, spans``, and ``masked`` text if asked for.

    Nulls and empty texts have no spans. Rows are handled one by one; other columns play no part.
    """
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    fields = "".join(f"n_{kind} long, " for kind in BASE) + "base_sha256 string, spans string, masked string"

    @F.arrow_udf(fields)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for body in texts:
            body = body.as_py()
            spans = spans_of(body)
            base = [span for span in spans if span[0] in BASE]
            row = {f"n_{kind}": sum(span[0] == kind for span in base) for kind in BASE}
            row |= {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)}
            out.append(row | {"masked": mask(body, spans) if masked else None})
        types = [(name, pa.int64()) for name in row_names[:-3]] + [(name, pa.string()) for name in row_names[-3:]]
        return pa.array(out, pa.struct(types))

    row_names = [*(f"n_{kind}" for kind in BASE), "base_sha256", "spans", "masked"]
    shown = row_names if masked else row_names[:-1]
    return rows.select("doc_id", find("text").alias("found")).select("doc_id", *[f"found.{name}" for name in shown])
