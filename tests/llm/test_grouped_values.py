"""Cards and IBANs that stand next to other groups of digits or capitals."""

import re

import pytest

from tidepool.llm.pseudonyms import luhn, pseudonymise

KEY = b"0123456789abcdef"


@pytest.mark.parametrize(
    ("kind", "value", "text"),
    [
        ("card", "4111 1111 1111 1111", "card {} 12/26"),
        ("card", "4111111111111111", "{} 123"),
        ("card", "4111-1111-1111-1111", "pay {}-123 now"),
        ("card", "4111 1111 1111 1111", "no 12 {} 12 26"),
        ("card", "4111 1111 1111 1111", "12 34 {}"),
        ("card", "3782 822463 10005", "amex {} 1234"),
        ("iban", "BE68 5390 0754 7034", "{} BIC"),
        ("iban", "BE68 5390 0754 7034", "an IBAN {} KREDBEBB NOW"),
        ("iban", "BE68 5390 0754 7034", "XY99 {} BIC"),
    ],
)
def test_neighbours(kind, value, text):
    new, spans = pseudonymise(text.format(value), KEY)
    assert [k for k, _, _ in spans] == [kind]
    (_, a, b), = spans
    before, after = text.split("{}")
    assert new[:a] == before and new[b:] == after and len(new[a:b]) == len(value) and new[a:b] != value
    assert kind != "card" or luhn(re.sub(r"\D", "", new[a:b]))


def test_two_in_a_row():
    new, spans = pseudonymise("4111 1111 1111 1111 5500 0000 0000 0004 99", KEY)
    assert [k for k, _, _ in spans] == ["card", "card"] and new.endswith(" 99") and "4111 1111" not in new and "0000 0004" not in new
