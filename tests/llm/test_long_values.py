"""Pseudonyms of values of any length: nothing of the value stays, equal values stay linked, and the mapping is one to one."""

import random
import string

import pytest

from tidepool.llm.pseudonyms import _permute_characters, permute, pseudonymise, pseudonymise_documents

KEY = b"a key of 32 bytes for this test."


@pytest.mark.parametrize("n", [80, 200, 513, 20_000])
def test_no_position_is_kept_beyond_chance(n):
    rng = random.Random(n)
    value = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    new, spans = pseudonymise(f'token = "{value}"', KEY)
    got = new.removeprefix('token = "').removesuffix('"')
    assert [k for k, _, _ in spans] == ["secret"] and len(got) == n
    assert [c.isdigit() for c in got] == [c.isdigit() for c in value] and [c.isupper() for c in got] == [c.isupper() for c in value]
    for part in range(0, n, 100):
        kept = sum(a == b for a, b in zip(value[part : part + 100], got[part : part + 100], strict=True))
        assert kept <= 20  # of 100, by chance about 5
    other = pseudonymise(f'token = "{value[:-1]}{"1" if value[-1] == "0" else "0"}"', KEY)[0]
    assert sum(a == b for a, b in zip(other, new, strict=True)) < 12 + 0.25 * n  # the last character changes all
    assert pseudonymise(f'"x" token = "{value}"', KEY)[0].endswith(new)


def test_one_to_one():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(permute(v, size, KEY, "t") for v in range(size)) == list(range(size))
    rng = random.Random(1)
    values = {"".join(rng.choice("01") for _ in range(600)) for _ in range(200)}
    assert len({_permute_characters(v, KEY, "t") for v in values}) == len(values)


def test_documents(spark):
    long = "A1b2" * 5000
    rows = [(1, f'password: "{long}" end'), (2, f'"{long}"'), (None, f'password: "{long}"'), (3, None), (4, ""), (5, "word " * 40_000)]
    got = {r.doc_id: r for r in pseudonymise_documents(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    assert long not in got[1].text and got[1].text.split()[1] == got[None].text.split()[1]
    assert got[2].text == rows[1][1] and got[3].text is None and got[4].text == "" and got[5].text == rows[5][1]
    assert pseudonymise_documents(spark.createDataFrame(rows, "doc_id long, text string").limit(0), KEY).collect() == []
