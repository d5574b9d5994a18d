"""Personal data: base spans against the plain patterns, added spans by hand."""

import hashlib
import random
import re
import time

import pytest

from strataq.llm import pii


def plain(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


PARTS = ["a@b.co", "x.", "@", "+", "1", "255.", "256", "4845168114407329", "4845 1681 1440 7329", " ", "-", ".", "(017) ", "555-7713", "é", "+1 ", "00", "%", "a-b@c-d.e.f", "\n", "9", "card ", "DE89 3704 0044 0532 0130 00", "𝒳"]


def test_base_spans_are_those_of_the_plain_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))
        spans = pii.find(t)
        assert [s[:3] for s in spans if s[4]] == plain(t), t
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        fixed = [s for s in spans if s[4]]
        added = [s for s in spans if not s[4]]
        assert all(a[2] <= b[1] or b[2] <= a[1] for i, a in enumerate(added) for b in fixed + added[:i]), t


@pytest.mark.parametrize("text, want", [
    ("two 7536784127813050 4845168114407329 cards", ["card:4:20", "card:21:37"]),
    ("call +1 (826) 555-4081 190.137.2.9 now", ["ip:23:34", "phone:5:22"]),
    ("amex card 3782 822463 10005 used", ["card:10:27"]), ("number 3782 822463 10005 used", []),
    ("iban DE89 3704 0044 0532 0130 00.", ["iban:5:32"]), ("IBAN GB82WEST12345698765432", ["iban:5:27"]), ("GB83WEST12345698765432", []),
    ("phone (212) 555-0187", ["phone:6:20"]), ("order (212) 555-0187", []), ("tel 212-555-0187 x", ["phone:4:16"]), ("(212) 555-0187", []),
    ("ssn 078-05-1120", ["ssn:4:15"]), ("078-05-1120", []), ("social security 666-05-1120", []),
    ("order 4111 1111 1111 1112", []), ("card 4111 1111 1111 1111 12", ["card:5:24"]), ("", []), (None, []),
])
def test_added_spans(text, want):
    assert [f"{s[0]}:{s[1]}:{s[2]}" for s in pii.find(text)] == want


def test_words_near_a_span_move_its_score():
    score = lambda t: next(s[3] for s in pii.find(t) if s[0] == "card")
    number = "4111111111111111"
    assert score(f"order {number}") < score(f"thing {number}") < score(f"visa {number}")


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


@pytest.mark.parametrize("text", ["a" * 10**6, "a@" * 500_000, "1" * 10**6, "1 " * 500_000, "1." * 500_000, "+1" * 500_000, "+1(" * 300_000, "a." * 500_000 + "@", "AB12" * 250_000, "a" * 10**6 + "@b.c", "4845168114407329 " * 50_000, "@" * 10**6, "AB12 " * 200_000, "123-45-" * 150_000])
def test_long_runs_cost_no_more(text):
    began = time.time()
    pii.find(text)
    assert time.time() - began < 20


def test_query_rows(spark):
    texts = ["mail a.b@c.de or +1 (017) 555-7713", None, "", "𝒳 é 97.51.17.173 4845168114407329 4845168114407329", "x"]
    rows = [(i, t, "p", 7) for i, t in enumerate(texts)] + [(None, texts[0], None, None), (0, texts[0], "p", 1), (0, "other@x.yz", "p", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii string, n_email long")
    got = sorted(map(tuple, pii.personal_data(df).collect()), key=str)
    want = []
    for i, t, _, _ in rows:
        base = plain(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in pii.find(t))
        want.append((i, *(sum(k == b[0] for b in base) for k in ("email", "ip", "card", "phone")), hashlib.sha256(listed.encode()).hexdigest(), every))
    assert got == sorted(want, key=str)
    assert pii.personal_data(df.where("false")).count() == 0
    clean = {(r.doc_id, r.text) for r in pii.redact(df).collect()}
    assert (0, "mail [EMAIL] or [PHONE]") in clean and (1, None) in clean and (3, "𝒳 é [IP] [CARD] [CARD]") in clean and pii.redact(df).columns == df.columns
    marked = pii.annotate(df)
    assert marked.columns == ["doc_id", "text", "n_email", "pii"] and marked.where("doc_id = 4").first().pii == []
