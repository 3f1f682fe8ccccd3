"""URL filters: all rules at once, as a bit-parallel automaton with wildcards.

Every rule becomes a chain of states, one bit each, in words of 64 bits. A step reads one byte of the URL: states move
one bit on where the byte fits (Shift-And), and those that stand before a wildcard may also stay. One step of a few
bit operations moves every rule, and numpy takes it for many URLs side by side. A URL that is longer than ``WIDE``
bytes takes the same steps alone, over one whole number that holds all words.

The automaton reads a URL in canonical form: a dot, the host in lower case, a mark, the path, another mark and the
query; scheme and fragment are left out. The marks are bytes that no UTF-8 text has, so no wildcard can take a host's
end for anything else.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from callharmony.llm.tables import column

PATH, QUERY = 0xFF, 0xFE
# Longer URLs, in bytes, are read one by one, so that a batch stays as wide as it was planned.
WIDE = 2048
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains, on paths that start with ``path``.

    In both, ``*`` is any run and ``?`` any one character, of the host or of the path; an empty host is any host.
    """

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed by the task.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
# What the method itself blocks where no rule fits: pages without prose, and files that are no pages.
DEFAULTS = (
    Rule("block", "ads.*"),
    Rule("block", "tracker.*"),
    Rule("block", "", "/cgi-bin/"),
    Rule("block", "", "/*/login"),
    Rule("block", "", "/login"),
    Rule("block", "", "/search"),
    Rule("block", "", "/tag?/"),
    Rule("block", "", "*.exe"),
    Rule("block", "", "*.zip"),
    Rule("block", "", "*.jpg"),
    Rule("block", "", "*.png"),
    Rule("allow", "", "/search/help"),
)


def parts_of(url: str | None) -> tuple[str, str, str | None]:
    """Host (A-Z in lower case), path and query (None without one) of a URL; empty without ``://``."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.partition("://")[2].partition("#")[0]
    place, mark, query = rest.partition("?")
    host, slash, path = place.partition("/")
    return host.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), slash + path, query if mark else None


def canonical(host: str, path: str, query: str | None) -> bytes:
    body = b"." + host.encode("utf-8", "surrogatepass") + bytes([PATH]) + path.encode("utf-8", "surrogatepass")
    return body if query is None else body + bytes([QUERY]) + query.encode("utf-8", "surrogatepass")


class Automaton:
    """The masks of a set of rules, as whole numbers and as words.

    ``step[c]`` has the states that byte ``c`` leads to, ``stay[c]`` those in which it may be read over.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        self.step, self.stay = [0] * 256, [0] * 256
        self.start, self.size, ends = 0, 0, []
        for rule in self.rules:
            self.start |= 1 << self.size
            anything = range(256)
            self._loop(anything)  # the name may be any subdomain's
            self.size += 1
            inside = [c for c in range(256) if c not in (PATH, QUERY)]
            if rule.host:
                self._literal(ord("."))
                self._text(rule.host.encode().translate(_LOWER), inside)
            self._literal(PATH)
            self._text(rule.path.encode(), inside)
            ends.append(self.size - 1)
            self._loop(anything, self.size - 1)  # the rule is a prefix
        self.ends = ends
        self.words = max(1, -(-self.size // 64))
        self._steps, self._stays = self._table(self.step), self._table(self.stay)

    def _literal(self, byte: int) -> None:
        self.step[byte] |= 1 << self.size
        self.size += 1

    def _loop(self, some, at: int | None = None) -> None:
        for byte in some:
            self.stay[byte] |= 1 << (self.size if at is None else at)

    def _text(self, text: bytes, inside: list[int]) -> None:
        for byte in text:
            if byte == ord("*"):
                self._loop(inside, self.size - 1)
            elif byte == ord("?"):
                # One character: its first byte, and those that continue it.
                for first in inside:
                    if not 0x80 <= first < 0xC0:
                        self.step[first] |= 1 << self.size
                self._loop(range(0x80, 0xC0), self.size)
                self.size += 1
            else:
                self._literal(byte)

    def _table(self, masks: list[int]) -> np.ndarray:
        return np.array([[mask >> (64 * w) & (2**64 - 1) for w in range(self.words)] for mask in masks], np.uint64)

    def _vector(self, mask: int) -> np.ndarray:
        return self._table([mask])[0]

    def read(self, text: bytes) -> int:
        """The states after one text."""
        states, step, stay = self.start, self.step, self.stay
        for byte in text:
            states = (states << 1 & step[byte]) | (states & stay[byte])
            if not states:
                break
        return states

    def read_all(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text, which rules fit it: a row of booleans."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        fits = np.zeros((len(texts), len(self.rules)), bool)
        for i in np.flatnonzero(lengths > WIDE):
            states = self.read(texts[i])
            fits[i] = [states >> end & 1 for end in self.ends]
        # The longest first, so that those still being read are always the first rows.
        short = np.flatnonzero(lengths <= WIDE)
        order = short[np.argsort(-lengths[short], kind="stable")]
        if not len(order):
            return fits
        sizes = lengths[order]
        width = int(sizes[0])
        letters = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
        states = np.repeat(self._vector(self.start)[None], len(order), axis=0)
        reading = np.searchsorted(-sizes, -np.arange(width), side="left")  # texts longer than each place
        one, carry = np.uint64(1), np.uint64(63)
        for at in range(width):
            now = states[: reading[at]]
            byte = letters[: reading[at], at]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> carry
            states[: reading[at]] = (moved & self._steps[byte]) | (now & self._stays[byte])
        for r, end in enumerate(self.ends):
            fits[order, r] = (states[:, end // 64] >> np.uint64(end % 64) & one).astype(bool)
        return fits


def _by_rank(rules: Sequence[Rule]) -> list[Rule]:
    """Longest first, as the rule is written; of equal lengths a block goes first, then the smaller text."""
    return sorted(rules, key=lambda rule: (-len(rule.name), rule.verdict != "block", rule.name))


def judge_urls(urls: Sequence[str | None], rules: Automaton, defaults: Automaton) -> Iterator[tuple[str, str, str | None, str]]:
    """Host, path, name of the rule that decides and verdict of each URL; both automata hold their rules by rank."""
    parts = [parts_of(url) for url in urls]
    texts = [canonical(*part) for part in parts]
    ruled, own = rules.read_all(texts), defaults.read_all(texts)
    for (host, path, _), fits, others in zip(parts, ruled, own, strict=True):
        first = next(iter(np.flatnonzero(fits)), None)
        if first is not None:
            yield host, path, rules.rules[first].name, rules.rules[first].verdict
        else:
            other = next(iter(np.flatnonzero(others)), None)
            yield host, path, None, "allow" if other is None else defaults.rules[other].verdict


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    defaults: Sequence[Rule] = DEFAULTS,
    url: str = "url",
    page_id: str = "page_id",
) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    Of the rules that fit, the longest decides. Where none fits, ``rule`` is null and ``defaults`` decide in the same
    way; a URL that none of them fits is allowed. A null, or a text without ``://``, has an empty host and path, which
    no rule with a host or a path fits. Rows are judged one by one, so repeated rows and null ids are all returned; an
    empty table gives no rows, and other columns play no part.
    """
    by_rank = tuple(_by_rank(rules)), tuple(_by_rank(defaults))
    made: list[Automaton] = []

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judge(urls: pa.Array) -> pa.Array:
        if not made:
            made.extend(Automaton(some) for some in by_rank)
        found: list[tuple] = []
        # So many URLs at a time that their letters and states stay within a few dozen megabytes.
        texts = urls.to_pylist()
        for at in range(0, len(texts), 4096):
            found += judge_urls(texts[at : at + 4096], *made)
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["host", "path", "rule", "verdict"])

    rows = pages.select(column(pages, page_id).alias("page_id"), judge(column(pages, url)).alias("judged"))
    return rows.select("page_id", "judged.*")
