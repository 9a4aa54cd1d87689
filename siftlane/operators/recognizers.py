"""Recognizers of spans: patterns as native columns, models as plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlane.functions import spans
from siftlane.functions.text import URL
from siftlane.operators.keywords import Keyword, quoted

_F = spans.FLAGS


def _luhn(m: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(m, "[ -]", ""))


def _iban(m: Column) -> Column:
    """ISO 13616: the first four characters to the end, letters as 10 to 35, remainder 1 modulo 97."""
    s = F.upper(F.regexp_replace(m, " ", ""))
    chars = F.split(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))), "")
    rest = F.aggregate(
        F.filter(chars, lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return F.length(s).between(15, 34) & (rest == 1)


def _ipv4(m: Column) -> Column:
    return F.when(m.contains(":"), True).otherwise(F.forall(F.split(m, "[.]"), lambda p: p.try_cast("int") <= 255))


def _ssn(m: Column) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    return ~(d.startswith("000") | d.startswith("666") | d.startswith("9") | (F.substr(d, F.lit(4), F.lit(2)) == "00") | d.endswith("0000"))


def _digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(low, high)


def _digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def _has(part: str) -> Callable[[Column], Column]:
    return lambda text: text.contains(part)


@dataclass(frozen=True)
class Pattern:
    """A pattern, a test that its matches must pass, and a cheap one that a text with matches always passes."""

    entity: str
    regex: str
    valid: Callable[[Column], Column] | None = None
    needs: Callable[[Column], Column] | None = None

    def find(self, text: Column | str, order: int) -> Column:
        found = spans.find_all(text, self.regex, self.entity, order, None if self.needs is None else self.needs(spans.as_column(text)))
        return found if self.valid is None else F.filter(found, lambda s: self.valid(s["text"]))


#: Written from public formats; each is (entity, pattern, validity, need). A pattern looks at its first signs before it looks at
#: word boundaries, which cost more.
PATTERNS = {
    p.entity: p
    for p in (
        Pattern("EMAIL_ADDRESS", _F + r"\b[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}\b", needs=_has("@")),
        Pattern("PHONE_NUMBER", _F + r"(?=[+(\d])(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]?\d{3,4}(?![\w])", _digits(7, 15), _digit),
        Pattern("CREDIT_CARD", _F + r"(?=\d)\b(?:\d[ -]?){12,18}\d\b", _luhn, _digit),
        Pattern("CRYPTO", r"(?=[b13])\b(?:bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", needs=_digit),
        Pattern("IBAN_CODE", _F + r"\b[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?\b", _iban, _digit),
        Pattern("IP_ADDRESS", _F + r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)|(?=[0-9a-f]{1,4}:)(?<![:\w])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![:\w])", _ipv4, lambda t: t.contains(":") | _digit(t)),
        Pattern("US_SSN", _F + r"(?=\d)\b\d{3}-\d{2}-\d{4}\b", _ssn, _digit),
        Pattern("US_BANK_NUMBER", _F + r"(?=\d)(?<![\d-])(?<=account )\d{8,17}(?![\d-])", needs=_digit),
        Pattern("US_DRIVER_LICENSE", r"(?=[A-Z]\d)\b(?:[A-Z]\d{7}|[A-Z]\d{3}-\d{4}-\d{4})\b", needs=_digit),
        Pattern("US_ITIN", _F + r"(?=9)\b9\d{2}-(?:5\d|6[0-5]|7\d|8[0-8]|9[0-24-9])-\d{4}\b", needs=_digit),
        Pattern("US_PASSPORT", r"(?<=[Pp]assport )[A-Z]?\d{8,9}\b", needs=_has("assport ")),
        Pattern("MEDICAL_LICENSE", r"(?=[ABFGM][A-Z]\d)\b[ABFGM][A-Z]\d{7}\b", needs=_digit),
        Pattern("URL", URL, needs=_has("://")),
    )
}
REGEX_ENTITIES = frozenset(PATTERNS)


def engine(entity: Column | str) -> Column:
    """'regex' for the entities found by patterns, 'NER' for all others."""
    return F.when(spans.as_column(entity).isin(*sorted(REGEX_ENTITIES)), "regex").otherwise("NER")


def keyword_patterns(keywords: list[Keyword]) -> list[Pattern]:
    """One recognizer a keyword, KW_0, KW_1 and so on."""
    return [Pattern(f"KW_{i}", rf"{_F}(?={quoted(k.find)})\b(?:{quoted(k.find)})\b") for i, k in enumerate(keywords)]


@dataclass(frozen=True)
class Model:
    """A plug-in: `find` maps a text column and an order to an array of spans, as an Arrow or pandas UDF does."""

    entities: frozenset[str]
    finder: Callable[[Column, int], Column]

    def find(self, text: Column | str, order: int) -> Column:
        return self.finder(spans.as_column(text), order)


def gazetteer(entity: str, names: list[str]) -> Pattern:
    """Stand-in for a model: a list of names. No statistical model ships with this package."""
    alts = "|".join(quoted(n) for n in sorted(names, key=len, reverse=True))
    return Pattern(entity, rf"{_F}\b(?:{alts})\b")


def unavailable(kind: str):
    """What asking for a missing backend does: it says so, before any file is touched."""
    raise RuntimeError(f"no {kind} backend is installed; pass one as a plug-in")
