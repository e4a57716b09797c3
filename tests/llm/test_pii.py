"""Pseudonyms: bijections, validity, and equal values that stay equal."""

import re
from datetime import date

import pytest
from conftest_llm import ODD

from flowspark.llm import pii

P = pii.Permutation(b"key")
VALUES = [
    "4111 1111 1111 1111", "4111111111111111", "378282246310005", "+1 (643) 555-5742", "643-555-5742", "213.174.22.103", "2024-02-29", "29.02.2024", "02/29/2024",
    "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "the.16@mail8.example.com", "123-45-6789", "+44 20 7946 0958", "+442079460958",
    "463A598BE7E762208AC6A4730A37634729CBD1D2", "04dbebab91ab85687d33eeaaf9ac699e1188f962",
]
OTHERS = ["9999999999999999", "4111111111111112", "1.2.3.4.5", "2024-13-01", "31.02.2024", "v1.2.3", "300.1.1.1", "000-12-3456", "DE89 3704 0044 0532 0130 01", "12345", "call 911 now", "x4111111111111111"]


@pytest.mark.parametrize("n", [1, 2, 7, 97, 1000])
def test_permutations(n):
    image = [P(x, n, b"t") for x in range(n)]
    assert sorted(image) == list(range(n))
    assert [P(y, n, b"t", back=True) for y in image] == list(range(n))
    if n > 100:
        assert image != [P(x, n, b"u") for x in range(n)]


@pytest.mark.parametrize("value", VALUES)
def test_values_keep_their_form(value):
    text = f"see {value}, or {value}!!"
    new, found = pii.pseudonymise(text, P)
    assert sum(found.values()) == 2
    one, two = re.fullmatch(r"see (.*), or (.*)!!", new).groups()
    assert one == two != value
    if "." not in value or "@" in value:
        assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", one))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value))) or len(value) == 40
    assert pii.pseudonymise(new, P)[1] == found  # valid again
    assert pii.pseudonymise(new, P, back=True)[0] == text


def test_forms_of_a_value_stay_linked():
    new = lambda t: pii.pseudonymise(t, P)[0]
    assert new("4111 1111 1111 1111").replace(" ", "") == new("4111111111111111")
    assert pii.luhn(new("4111111111111111")) == 0
    y, m, d = map(int, new("2024-02-29").split("-"))
    assert new("29.02.2024") == f"{d:02d}.{m:02d}.{y}"
    assert new("02/29/2024") == f"{m:02d}/{d:02d}/{y}"
    assert date(y, m, d)
    assert pii.iban_rest(new("GB82WEST12345698765432")) == 1
    assert new("+44 20 7946 0958").replace(" ", "") == new("+442079460958")


@pytest.mark.parametrize("text", OTHERS)
def test_what_is_not_valid_stays(text):
    assert pii.pseudonymise(text, P) == (text, {})


def test_tables(table):
    texts = [*ODD, *VALUES, *OTHERS]
    got = {r.doc_id: r for r in pii.pseudonyms(table(texts), b"key").collect()}
    for k, t in enumerate(texts):
        new, found = pii.pseudonymise(t, P) if t else (t, {})
        assert (got[k].text, got[k].n_found) == (new, sum(found.values()))
        assert {n: got[k][f"n_{n}"] for n in pii.KINDS} == {n: found.get(n, 0) for n in pii.KINDS}
    other = {r.doc_id: r.text for r in pii.pseudonyms(table(texts), b"other").collect()}
    assert all(other[k] != got[k].text for k in range(len(ODD), len(ODD) + len(VALUES)))
    assert pii.pseudonyms(table([]), b"key").count() == 0
    assert pii.pseudonyms(table([(None, "a"), (None, "a")]), b"key").count() == 2


def test_all_days_in_all_notations():
    """Different days get different pseudonyms, each comes back, and notations of a day stay linked."""
    first = date(1900, 1, 1).toordinal()
    days = [date.fromordinal(k) for k in range(first, date(2100, 1, 1).toordinal())]
    notations = [
        lambda d: f"{d.year}-{d.month:02d}-{d.day:02d}", lambda d: f"{d.month:02d}/{d.day:02d}/{d.year}", lambda d: f"{d.day:02d}.{d.month:02d}.{d.year}",
        lambda d: f"{d.day}-{d.month}-{d.year}", lambda d: f"{d.month}/{d.day}/{d.year}", lambda d: f"{d.year}/{d.month}/{d.day}",
    ]
    there = [[pii._date(write(d), P, False) for d in days[:: 1 if k == 0 else 31]] for k, write in enumerate(notations)]
    for k, (write, new) in enumerate(zip(notations, there, strict=True)):
        own = days[:: 1 if k == 0 else 31]
        assert len(set(new)) == len(own)
        assert all(len(a) == len(write(d)) for a, d in zip(new, own, strict=True))
        assert [pii._date(a, P, True) for a in new] == [write(d) for d in own]
    image = {d: date.fromisoformat(a) for d, a in zip(days, there[0], strict=True)}
    assert sorted(image.values()) == days
    for write, new in zip(notations[1:], there[1:], strict=True):
        assert new == [write(image[d]) for d in days[::31]]
    ambiguous = ["28/01/1990", "22/03/1992", "11/05/1992", "11.05.1992", "05-11-1992", "13/12/2001"]
    once = [pii.pseudonymise(t, P)[0] for t in ambiguous]
    assert [pii.pseudonymise(t, P, back=True)[0] for t in once] == ambiguous
    assert len(set(once)) == len(once)


@pytest.mark.parametrize(
    ("text", "value"),
    [("4111 1111 1111 1111 123", "4111 1111 1111 1111"), ("4111 1111 1111 1111 12/25", "4111 1111 1111 1111"), ("call 212-555-0123 12", "212-555-0123"),
     ("in 2024 212-555-0123", "212-555-0123"), ("12 34 56 2021-03-04T10:00:00Z", "2021-03-04"), ("1 22 333 378282246310005", "378282246310005"),
     ("DE89 3704 0044 0532 0130 00 123", "DE89 3704 0044 0532 0130 00")],
)
def test_values_beside_other_numbers(text, value):
    new, found = pii.pseudonymise(text, P)
    assert sum(found.values()) == 1
    assert new != text
    before, after = text.split(value)
    assert new.startswith(before)
    assert new.endswith(after)
    assert pii.pseudonymise(new, P, back=True)[0] == text


def test_other_columns_are_not_read(table):
    docs = table([(1, "mail a.b@c.example"), (1, "mail a.b@c.example")]).withColumnRenamed("lang", "n_found").withColumnRenamed("source", "n_card")
    rows = pii.pseudonyms(docs, b"key").collect()
    assert [r.n_email for r in rows] == [1, 1]
    assert rows[0].text == rows[1].text != "mail a.b@c.example"
