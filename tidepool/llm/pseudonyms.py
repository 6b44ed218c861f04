"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (check digits, calendar, ranges), then permuted inside their own format by a
keyed Feistel network, so a pseudonym is valid again and equal values stay equal in every document. Networks over a
domain that is no power of two walk their cycle until the value is inside.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feistel rounds; characters that one network permutes at once.
ROUNDS, PIECE = 8, 512
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date", "secret")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size) by a balanced Feistel network with cycle walking; its round function is as wide as a half."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    head = b"".join(len(x).to_bytes(4, "big") + x for x in (key, tweak.encode(), size.to_bytes((size.bit_length() + 7) // 8, "big")))
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            seen = hashlib.shake_256(head + bytes([r]) + right.to_bytes(width, "big")).digest(width)
            left, right = right, left ^ (int.from_bytes(seen, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _permute_piece(text: str, key: bytes, tweak: str) -> str:
    radix = [10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 1 for c in text]
    value = 0
    zero = ["0" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in text]
    for c, z, r in zip(text, zero, radix, strict=True):
        value = value * r + (ord(c) - ord(z))
    shape = "".join(zero)
    value, out = permute(value, prod(radix), key, f"{tweak}|{shape}"), []
    for z, r in zip(reversed(zero), reversed(radix), strict=True):
        value, k = divmod(value, r)
        out.append(chr(ord(z) + k))
    return "".join(reversed(out))


def _permute_characters(text: str, key: bytes, tweak: str) -> str:
    """Digits, small and capital ASCII letters each within their kind; all else stays. Longer texts are permuted piece by piece,
    forward and then backward, each piece under a digest of the pieces on one side of it, so that every piece depends on all."""
    if len(text) <= PIECE:
        return _permute_piece(text, key, tweak)
    parts = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    for order in (range(len(parts)), range(len(parts) - 1, -1, -1)):
        seen = hashlib.blake2b(key=key, digest_size=16)
        for i in order:
            parts[i] = _permute_piece(parts[i], key, f"{tweak}|{order.step}|{i}|{seen.hexdigest()}")
            seen.update(parts[i].encode())
    return "".join(parts)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{permute(int(digits[:-1]), 10**n, key, 'card'):0{n}d}"
    return _refill(text, next(body + str(d) for d in range(10) if luhn(body + str(d))))


def _phone(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    n = len(digits) - (text[0] == "+")
    if not 9 <= n <= 14:
        return None
    keep = digits[: len(digits) - n]
    return _refill(text, keep + f"{permute(int(digits[len(keep) :]), 10**n, key, 'phone'):0{n}d}")


def _ssn(text: str, key: bytes) -> str | None:
    value = int(text.replace("-", ""))
    valid = lambda v: 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0
    if not valid(value):
        return None
    value = permute(value, 10**9, key, "ssn")
    while not valid(value):
        value = permute(value, 10**9, key, "ssn")
    return _refill(text, f"{value:09d}")


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()


def _date(text: str, key: bytes) -> str | None:
    a, mark, b, _, c = re.fullmatch(r"(\d+)([-./])(\d+)([-./])(\d+)", text).groups()
    order = (0, 1, 2) if len(a) == 4 else (2, 0, 1) if mark == "/" and int(a) <= 12 else (2, 1, 0)
    parts = (int(a), int(b), int(c))
    try:
        day = datetime.date(*(parts[k] for k in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day < _LAST:
        return None
    only_day_first = mark == "/" and order == (2, 1, 0)  # 31/12/1999: its pseudonym has such a day too, so it is read alike
    new = datetime.date.fromordinal(_FIRST + permute(day - _FIRST, _LAST - _FIRST, key, "date"))
    while only_day_first and new.day <= 12:
        new = datetime.date.fromordinal(_FIRST + permute(new.toordinal() - _FIRST, _LAST - _FIRST, key, "date"))
    back = dict(zip(order, (new.year, new.month, new.day), strict=True))
    return mark.join(f"{back[k]:0{len(x)}d}" for k, x in enumerate((a, b, c)))


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "").upper()
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    small = text[0].islower()  # small letters stand between words of prose too: eight digits at least
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1 or (small and sum(c.isdigit() for c in plain) < 8):
        return None
    body = _permute_characters(plain[4:], key, "iban" + plain[:2])
    new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
    out = "".join(" " if c == " " else next(new) for c in text)
    return out.lower() if small else out


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.partition("@")
    return _permute_characters(local, key, f"email|{domain.lower()}") + "@" + domain


def _secret(text: str, key: bytes) -> str:
    name = re.match(r"(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)|[^\"']*[\"']", text)[0]
    return name + _permute_characters(text[len(name) :], key, "secret")


#: Kind, pattern, what makes the pseudonym (None: not valid, left alone). The first pattern that takes a place keeps it. A group
#: named value is what is replaced: a number without marks counts behind a label only.
RULES: tuple[tuple[str, str, Callable[[str, bytes], str | None]], ...] = (
    ("email", r"[A-Za-z0-9\u00C0-\u00FF][A-Za-z0-9\u00C0-\u00FF._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[po]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}\b|\bxox[abp]-[A-Za-z0-9-]{10,}\b|\b(?i:token|secret|api_key|password)\s*[=:]\s*[\"'][A-Za-z0-9+/_=-]{8,}(?=[\"'])", _secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b|\b[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?\b", _iban),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("date", r"(?<![\d./-])(?:\d{4}([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{4})(?![\d]|[./-]\d)", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|\b(?i:ssn|social security)(?i: number| no\.?)?\s{0,3}[:#=]?\s{0,3}(?P<value>\d{9})(?![\d-])", _ssn),
    ("card", r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d]|[.-]\d)", _card),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.(-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d)|\b(?i:tel|telephone|phone|mobile|cell|fax)\b(?i: number| no)?\.?\s{0,3}[:#=]?\s{0,3}(?P<value>\d{10,12})(?![\d-])", _phone),
)
#: Kinds of digit groups, of which a check that fails on the longest match may hold for fewer: what a group is, what a value begins with.
GROUPED = {"card": (re.compile(r"\d+"), re.compile(r"\d")), "iban": (re.compile(r"[A-Z0-9]+|[a-z0-9]+"), re.compile(r"(?:[A-Z]{2}|[a-z]{2})\d{2}"))}
#: Groups as cards are printed; these go before other runs of groups that pass the check by chance.
_PRINTED = re.compile(r"(?:\d{13,19}|\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}[ -]?\d{6}[ -]?\d{4,5})")
_DIGITS = re.compile(r"\d+(?:[ -]\d+)*")
_COMPILED = [(k, re.compile(p), f) for k, p, f in RULES]
_MAYBE = re.compile(r"[0-9@]|(?i:token|secret|password|api_key)|sk-|xox")


def _parts(kind: str, text: str, first: int, last: int) -> list[tuple[int, int]]:
    """A match and the runs of whole groups that start in it: cards as printed first, then the match, then by start, the
    longest of each start first. A card may end beyond the match, which other digits before it have cut short."""
    group, begin = GROUPED[kind]
    end = _DIGITS.match(text, first, last + 38).end() if kind == "card" else last
    groups = [m.span() for m in group.finditer(text, first, end)]
    runs = {(first, last)}
    for k, (a, _) in enumerate(groups):
        if a < last and begin.match(text, a):
            runs.update((a, d) for _, d in groups[k:] if d - a < 38 and (kind != "card" or not text[d : d + 1].isdigit()))
    return sorted(runs, key=lambda x: (kind == "card" and not _PRINTED.fullmatch(text, *x), x != (first, last), x[0], -x[1]))


def _values(kind: str, pattern: re.Pattern, change: Callable[[str, bytes], str | None], text: str, key: bytes, taken: list[tuple[int, int, str, str]]):
    """First place, end, kind and pseudonym of each value of a kind outside the places that are taken, which are sorted and apart."""
    starts = [a for a, _, _, _ in taken]

    def free(x: int, y: int) -> bool:
        k = bisect_left(starts, y)
        return k == 0 or taken[k - 1][1] <= x

    own = "value" if "value" in pattern.groupindex else 0
    at = 0
    while m := pattern.search(text, at):
        at = m.end()
        for x, y in _parts(kind, text, *m.span()) if kind in GROUPED else [m.span(own) if m[own] is not None else m.span()]:
            new = change(text[x:y], key) if free(x, y) else None
            if new is not None:
                yield x, y, kind, new
                at = y
                break
        else:
            if kind in GROUPED:  # a value may begin at the next group
                at = GROUPED[kind][0].match(text, m.start()).end()


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start and end (of the new text) of each."""
    if not _MAYBE.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in _COMPILED:
        taken = sorted(taken + list(_values(kind, pattern, change, text, key, taken)))
    out, spans, at, size = [], [], 0, 0
    for a, b, kind, new in taken:
        out += [text[at:a], new]
        size += a - at
        spans.append((kind, size, size + len(new)))
        size, at = size + len(new), b
    return "".join([*out, text[at:]]), spans


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, and found: array of (kind, first, last) spans of the new text, for every row.

    The same key gives the same pseudonym for the same value in every document and run. Null and empty texts stay as they
    are with no spans; texts and values may have any length; where values overlap, the kind that stands first in RULES takes
    the place. Repeated rows and null ids are treated like all others; other columns are ignored; an empty table gives no rows.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("key: 16 to 64 bytes")
    kind = dict(docs.dtypes)[id_col]
    span = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches):
        for b in batches:
            texts, found = [], []
            for t in b.column(1).to_pylist():
                new, spans = (t, []) if t is None else pseudonymise(t, key)
                texts.append(new)
                found.append([{"kind": k, "first": x, "last": y} for k, x, y in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(found, pa.list_(span))], names=["doc_id", "text", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, found array<struct<kind: string, first: int, last: int>>")
