"""Format-preserving pseudonyms for personal data: keyed Feistel permutations of validated values.

Card numbers, bank account numbers, phone and social security numbers, network addresses, e-mail addresses, dates and
access tokens are found by pattern, validated, and permuted within their own format by a Feistel
network under a key, walking the cycle until the result is valid again. A value has the same
pseudonym wherever and however it is written (separators stay as they are), so equal values stay linked
across documents; no table of values is kept.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick
from .hashing import small_batches

ROUNDS = 8
_DAY0, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "email_local": r"(?<!\S)[^\s@<>()\[\]\",;:]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+?1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?![\d/-]|\.\d)",
    "card": r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])",
}
_FIND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_MAYBE = re.compile(r"@|\d[\d .()/-]{5}|[0-9a-fA-F]{32}|[A-Z]{2}\d\d").search


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1: an unbalanced Feistel network on a x b >= n, walking while out of range."""
    a = max(1, int(n**0.5)) if n < 1 << 52 else 1 << (n.bit_length() // 2)
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(ROUNDS):
            part = right if r % 2 == 0 else left
            h = int.from_bytes(hashlib.blake2b(f"{tweak}|{n}|{r}|{part}".encode(), key=key, digest_size=32).digest(), "big")
            if r % 2 == 0:
                left = (left + h) % a
            else:
                right = (right + h) % b
        x = left * b + right
        if x < n:
            return x


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _refill(text: str, chars: str, kind) -> str:
    """The value's characters of a kind replaced in order, all others as they are."""
    it = iter(chars)
    return "".join(next(it) if kind(c) else c for c in text)


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _number(digits: str, key: bytes, tweak: str, valid=lambda d: True) -> str:
    """Digits permuted among those of their length whose validity is the same."""
    want = valid(digits)
    while True:
        digits = str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))
        if valid(digits) == want:
            return digits


def card(text: str, key: bytes) -> str | None:
    """Numbers of 13 to 19 digits with a valid check digit; they get a valid one."""
    d = _digits(text)
    return _refill(text, _number(d, key, "card", luhn), str.isdigit) if luhn(d) else None


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban(text: str, key: bytes) -> str | None:
    """Valid account numbers; country and letters' places stay, the check digits are made anew."""
    if not iban_ok(text):
        return None
    s = text.replace(" ", "")
    body = mixed(s[4:], key, "iban" + s[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
    return _refill(text, f"{s[:2]}{check:02d}{body}", lambda c: c != " ")


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The characters that one may stand for: digits, small or capital letters of ASCII; beyond it those of
    its category in its run of 128 code points that lower case leaves as they are. None for other ASCII signs.
    """
    if ord(c) < 128:
        return next((k for k in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in k), "")
    kind, low = unicodedata.category(c), ord(c) & ~127
    found = "".join(x for x in map(chr, range(low, low + 128)) if unicodedata.category(x) == kind and x.lower() == x)
    return found if c in found else ""


def mixed(text: str, key: bytes, tweak: str, letters: str = "") -> str:
    """Characters permuted within their alphabets at each place; the rest stays. One to one among texts of one shape."""
    at = [(i, letters if c in letters else "" if letters else _alphabet(c)) for i, c in enumerate(text)]
    at = [(i, k) for i, k in at if k]
    x, n = 0, 1
    for i, k in at:
        x, n = x * len(k) + k.index(text[i]), n * len(k)
    if n == 1:
        return text
    shape = "".join(k[0] if k else c for c, k in ((c, letters if c in letters else "" if letters else _alphabet(c)) for c in text))
    y = permute(x, n, key, tweak + shape)
    out = list(text)
    for i, k in reversed(at):
        y, d = divmod(y, len(k))
        out[i] = k[d]
    return "".join(out)


def email(text: str, key: bytes) -> str:
    """Local part and host names but the last are permuted by character, in lower case's sense of equal."""
    name, host = text.rsplit("@", 1)
    host, last = host.rsplit(".", 1)
    given = f"{name}@{host}"
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in given)
    out = mixed(low, key, "email")
    out = "".join(c.upper() if g.isupper() and c.upper().lower() == c else c for c, g in zip(out, given))
    return f"{out}.{last}"


def ip(text: str, key: bytes) -> str | None:
    """Addresses of four numbers up to 255."""
    parts = [int(p) for p in text.split(".")]
    if any(p > 255 for p in parts):
        return None
    x = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(text: str, key: bytes) -> str | None:
    d = _digits(text)
    return _refill(text, _number(d, key, "ssn", ssn_ok), str.isdigit) if ssn_ok(d) else None


# Calling codes of one and of two digits; all others have three.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def phone_parts(text: str) -> tuple[str, str, int]:
    """(country, national number, digits written before it) of a number, however it is written.

    After a + the country is told by the table of calling codes; numbers in the North American form without one are of country 1. A
    zero in parentheses after the country is no part of the national number.
    """
    d = _digits(text)
    if not text.startswith("+"):
        before = len(d) - 10
        return ("1", d[before:], before) if before == 0 or before == 1 and d[0] == "1" else ("", d, 0)
    size = 1 if d.startswith(ONE_DIGIT) else 2 if d[:2] in TWO_DIGITS else 3
    before = size + (re.match(r"\+\d{%d}[ .-]?\(0\)" % size, text) is not None)
    return d[:size], d[before:], before


def phone(text: str, key: bytes) -> str | None:
    """Numbers of 7 to 15 digits: the national number is permuted among those of its country and length, and written in the given form."""
    d = _digits(text)
    if not 7 <= len(d) <= 15:
        return None
    country, national, before = phone_parts(text)
    return _refill(text, d[:before] + _number(national, key, f"phone{country}|"), str.isdigit)


def date(text: str, key: bytes) -> str | None:
    """Calendar days of 1900 to 2099: year first, or day and month in the order that is valid (day first if both are)."""
    a, sep, b, c = re.match(r"(\d+)([./-])(\d+)[./-](\d+)", text).groups()
    order = "ymd" if len(a) == 4 else "dmy" if int(b) <= 12 else "mdy"
    value = dict(zip(order, map(int, (a, b, c))))
    try:
        day = datetime.date(value["y"], value["m"], value["d"]).toordinal() - _DAY0
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = datetime.date.fromordinal(_DAY0 + permute(day, _DAYS, key, "date"))
    parts = {"y": f"{new.year:04d}", "m": f"{new.month:0{len(b) if order[1] == 'm' else len(a)}d}", "d": f"{new.day:0{len(a) if order[0] == 'd' else len(b if order[1] == 'd' else c)}d}"}
    return sep.join(parts[k] for k in order)


def token(text: str, key: bytes) -> str | None:
    """Hexadecimal secrets, with letters and digits both."""
    if text.isdigit() or text.isalpha():
        return None
    out = mixed(text.lower(), key, "token", "0123456789abcdef")
    return out.upper() if text.upper() == text else out


_MAKE = {"email": email, "email_local": email, "iban": iban, "token": token, "ip": ip, "ssn": ssn, "phone": phone, "date": date, "card": card}


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with pseudonyms in place of values found, and the kinds of these in order."""
    if not text or not _MAYBE(text):
        return text, []
    kinds: list[str] = []

    def put(m: re.Match) -> str:
        new = _MAKE[m.lastgroup](m[0], key)
        if new is None:
            return m[0]
        kinds.append(m.lastgroup.split("_")[0])
        return new

    return _FIND.sub(put, text), kinds


def _replace(key: bytes):
    def run(batches):
        for batch in small_batches(batches, "text"):
            done = [pseudonymise(t, key) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(k) for _, k in done], pa.int64()), pa.array([k for _, k in done], pa.list_(pa.string()))], ["doc_id", "text", "n_replaced", "kinds"])

    return run


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, text, n_replaced, kinds), values of personal data replaced by pseudonyms.

    Texts without a value are returned as they are; null texts stay null with nothing replaced. Values that look
    like one kind but are not valid (card numbers without their check digit, addresses with parts over 255, impossible
    days) stay. Whole texts are searched, however long. Rows with a null id and repeated rows are treated like others;
    further columns are ignored; an empty table gives an empty result. Pass a secret ``key`` of up to 64 bytes.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_replace(key), "doc_id long, text string, n_replaced long, kinds array<string>")
