"""One value in many forms has one pseudonym."""

import random
import re

import pytest

from lexmill.llm import pseudonyms as P


def digits(text):
    return re.sub(r"\D", "", text)


def forms(country, national):
    n = national
    if country == "1":
        a, b, c = n[:3], n[3:6], n[6:]
        return [f"+1 {a} {b} {c}", f"+1{n}", f"+1-{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"1 ({a}) {b}.{c}"]
    return [f"+{country} {n[:2]} {n[2:6]} {n[6:]}", f"+{country}{n}", f"+{country}-{n[:3]}-{n[3:6]}-{n[6:]}", f"+{country} ({n[:2]}) {n[2:6]} {n[6:]}"] + ([f"+{country} (0){n[:2]} {n[2:6]} {n[6:]}"] if len(country) < 3 else [])


@pytest.mark.parametrize("country", ["1", "44", "49", "7", "351", "91"])
def test_forms_of_one_number_link(country):
    rng, seen = random.Random(country), set()
    for _ in range(40):
        national = str(rng.randrange(2, 10)) + "".join(rng.choices("0123456789", k=9))
        got = set()
        for form in forms(country, national):
            text, kinds = P.pseudonymise(f"call {form} now", b"key")
            new = text[5:-4]
            assert kinds == ["phone"] and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", form) and new != form
            size = len(digits(form)) - 10
            assert digits(new)[:size] == digits(form)[:size]
            got.add(digits(new)[size:])
        assert len(got) == 1
        seen |= got
    assert len(seen) == 40


def test_forms_of_the_review():
    one = [P.phone(x, b"k") for x in ("+1 487 555 7209", "+14875557209", "1-487-555-7209", "(487) 555-7209")]
    assert len({digits(x)[-10:] for x in one}) == 1 and one[0].startswith("+1 ") and one[1].startswith("+1")
    a, b = P.phone("+44 20 7946 0958", b"k"), P.phone("+442079460958", b"k")
    assert digits(a) == digits(b) and a.startswith("+44 ")


def test_lengths_are_kept():
    for mail in ("İx@host.org", "STRAẞE@Host.org", "ŉame.É@x-y.com"):
        text, kinds = P.pseudonymise(mail, b"key")
        assert kinds == ["email"] and len(text) == len(mail) and text != mail
