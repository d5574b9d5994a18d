"""Personal data: patterns propose spans, checksums confirm them, words near a span move its score.

*Base* spans are fixed rules of four kinds (email, ip, card, phone), each leftmost and without overlap of its own kind;
they are always reported. The method adds, where it overlaps none of these:

* ``card``: cards inside a run of digits that fails as a whole (two numbers side by side, a number after a phone), as
  groups that make up 13 to 19 digits and pass Luhn;
* ``phone``: the number at the front of a run that has too many digits, and national numbers without a plus sign;
* ``iban``: account numbers that pass mod-97;
* ``ssn``: numbers of the form 3-2-4 with an area and group that are given out.

A proposal's score starts with its kind's own, rises with a passed checksum and with a word of its kind among those near
it, and falls with a word that speaks against it (order, invoice, version); added spans need ``THRESHOLD``.

All patterns are linear in the text: runs are taken whole (possessive), and an email is found from its ``@`` backwards, so
a text of one long run costs no more than others.

Offsets are code points, ends exclusive. Edge cases: a null or empty text has no spans; equal rows and rows that share a
doc_id are judged apart; null ids stay; other columns are kept by ``annotate`` and ``redact``; an empty table gives no
rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.runtime import small_batches

#: Kinds in the order of reports; the first four have base rules.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
THRESHOLD = 0.6
#: Characters before and after a span in which words count.
BEFORE, AFTER = 40, 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FRONT = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_GROUP = re.compile(r"[0-9]+")
#: Sizes of a card number's groups as they are printed.
PRINTED = [(4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5)]

#: Words that speak for a kind, in the corpus's languages; and against any.
CONTEXT = {
    "email": "email mail correo courriel contact contacto kontakt",
    "ip": "ip address host server adresse dirección",
    "card": "card credit debit visa mastercard amex carte tarjeta karte kreditkarte",
    "phone": "phone tel telephone mobile cell call fax téléphone teléfono telefon handy",
    "iban": "iban account bank konto compte cuenta",
    "ssn": "ssn social security",
}
AGAINST = "order invoice isbn version serial ticket model part"
_FOR = {k: re.compile(rf"\b(?:{'|'.join(v.split())})\b") for k, v in CONTEXT.items()}
_NOT = re.compile(rf"\b(?:{'|'.join(AGAINST.split())})\b")
#: What a proposal has by itself, and what a passed checksum adds.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.3, "phone": 0.7, "iban": 0.3, "ssn": 0.4, "short card": 0.1, "national phone": 0.4}
CHECKED, NEAR = 0.4, 0.3

Span = tuple[str, int, int, float, bool]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account's first four characters go to its end, letters count from 10 on."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and (m := _LOCAL.search(text, max(done, start - 64), start)) and m.start() < start:
            start = m.start()
        m = _HOST.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _score(kind: str, text: str, start: int, end: int, *, prior: str = "", checked: bool = False) -> float:
    near = f"{text[max(0, start - BEFORE) : start]} {text[end : end + AFTER]}".lower()
    score = PRIOR[prior or kind] + CHECKED * checked + NEAR * bool(_FOR[kind].search(near)) - NEAR * bool(_NOT.search(near))
    return round(min(1.0, max(0.0, score)), 2)


def _cards_in(text: str, start: int, end: int) -> Iterator[Span]:
    """Cards among the groups of a run of digits."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    i = 0
    while i < len(groups):
        sizes = tuple(b - a for a, b in groups[i : i + 5])
        for k in [*(len(p) for p in PRINTED if sizes[: len(p)] == p), *([1] if 13 <= sizes[0] <= 19 else [])]:
            a, b = groups[i][0], groups[i + k - 1][1]
            digits = text[a:b].replace(" ", "").replace("-", "")
            if luhn(digits):
                yield "card", a, b, _score("card", text, a, b, prior="" if len(digits) > 15 else "short card", checked=True), False
                i += k - 1
                break
        i += 1


def find(text: str | None) -> list[Span]:
    """(kind, start, end, score, base) of all spans, by kind and start."""
    if not text:
        return []
    base: list[Span] = [("email", a, b, _score("email", text, a, b), True) for a, b in _emails(text)]
    more: list[Span] = []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            base.append(("ip", *m.span(), _score("ip", text, *m.span()), True))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if len(m[0]) < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            base.append(("card", *m.span(), _score("card", text, *m.span(), checked=True), True))
        elif m.end() - m.start() > 12:
            more.extend(_cards_in(text, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            base.append(("phone", *m.span(), _score("phone", text, *m.span()), True))
        elif (f := _FRONT.match(text, *m.span())) and 8 <= sum("0" <= c <= "9" for c in f[0]) <= 15:
            more.append(("phone", *f.span(), _score("phone", text, *f.span()), False))
    for m in _NATIONAL.finditer(text):
        more.append(("phone", *m.span(), _score("phone", text, *m.span(), prior="national phone"), False))
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if mod97(account):
            more.append(("iban", *m.span(), _score("iban", text, *m.span(), checked=True), False))
    for m in _SSN.finditer(text):
        area, group, number = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and number != "0000":
            more.append(("ssn", *m.span(), _score("ssn", text, *m.span()), False))
    return sorted(base + _apart([s for s in more if s[3] >= THRESHOLD], base), key=lambda s: (KINDS.index(s[0]), s[1]))


def _apart(more: list[Span], base: list[Span]) -> list[Span]:
    """Of ``more`` those that overlap nothing in ``base`` nor one of higher score (ties: the first) taken before."""
    taken: list[tuple[int, int]] = []  # in order, none overlaps another
    for a, b in sorted((s[1], s[2]) for s in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for s in sorted(more, key=lambda s: (-s[3], s[1], s[2])):
        i = bisect.bisect_left(taken, (s[1], s[2]))
        if (i and taken[i - 1][1] > s[1]) or (i < len(taken) and taken[i][0] < s[2]):
            continue
        taken.insert(i, (s[1], s[2]))
        out.append(s)
    return out


SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def spans_of(text: Column) -> Column:
    """All spans of a text."""

    @F.pandas_udf(SPANS)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in find(t)] for t in column], index=column.index)

    return found.asNondeterministic()(text.cast("string"))


def annotate(docs: DataFrame, *, to: str = "pii") -> DataFrame:
    """``docs`` with an array of spans."""
    small_batches(docs.sparkSession)
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != to), spans_of(F.col("text")).alias(to))


def redact(docs: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """``docs`` with each span of at least ``threshold`` replaced by its kind, as [EMAIL]; of spans that overlap the first
    stands for all."""

    def replaced(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for kind, start, end, score, _ in sorted(find(text), key=lambda s: (s[1], -s[2])):
            if score >= threshold:
                if start >= at:
                    out += [text[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in texts:
            yield column.map(replaced, na_action="ignore")

    small_batches(docs.sparkSession)
    return docs.select(*((clean(F.col("text").cast("string")) if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, the base spans' digest, and all spans of each row."""
    small_batches(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans_of(F.col("text")).alias("s"))
    base = F.filter("s", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"))
