"""PII as format-preserving pseudonyms: a keyed Feistel permutation within each value's own format.

Equal values get equal pseudonyms in every document (values stay linked), different values of a format different ones,
and whoever has the key can invert them. Card numbers stay valid (Luhn), dates stay dates of their century, addresses
stay addresses, lengths and separators of the others stay. Numbers and dates count only if they validate: dates by the
calendar, cards by their check digit, addresses by their octets, phone numbers by their grouping (ten digits in a row
without a separator, bracket or country code are no phone number).
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from secrets import token_hex

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import documents, fresh, text_or_empty

ROUNDS = 8
KEY_SETTING = "spark.pseudonyms.key"  # where the query takes its key from
_OWN: dict[str, str] = {}  # random keys made here, by application

#: Fixed patterns, in the order in which they claim text.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "date": r"(?<![0-9A-Za-z/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9A-Za-z])",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "card": r"(?<![0-9A-Za-z.+-])\d(?:[ -]?\d){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![0-9A-Za-z])",
}
COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def _round(key: bytes, tweak: str, k: int, x: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{k}|{x}".encode(), key=key, digest_size=32).digest(), "big")


def permute(digits: list[int], radices: list[int], key: bytes, tweak: str, back: bool = False) -> list[int]:
    """A keyed permutation of all digit lists with these radices: alternating sums into the two halves, modulo the product of a half's radices."""
    half = (len(digits) + 1) // 2
    sides = [slice(0, half), slice(half, None)]
    values, sizes = [], []
    for s in sides:
        v, m = 0, 1
        for d, r in zip(digits[s], radices[s], strict=True):
            v, m = v * r + d, m * r
        values.append(v)
        sizes.append(m)
    for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        a = k % 2
        f = _round(key, tweak, k, values[1 - a])
        values[a] = (values[a] - f if back else values[a] + f) % sizes[a]
    out: list[int] = []
    for s, v in zip(sides, values, strict=True):
        own = []
        for r in reversed(radices[s]):
            own.append(v % r)
            v //= r
        out += own[::-1]
    return out


def below(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A permutation of 0 .. n - 1: of all numbers of as many decimal digits, again until the result is below n."""
    width = len(str(n - 1))
    while True:
        x = int("".join(map(str, permute([int(c) for c in str(x).zfill(width)], [10] * width, key, tweak, back))))
        if x < n:
            return x


def luhn(digits: list[int]) -> int:
    """The check digit after these."""
    return -sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(reversed(digits))) % 10


def refilled(text: str, digits: list[int]) -> str:
    it = iter(digits)
    return "".join(str(next(it)) if c.isdigit() else c for c in text)


def pseudonym(kind: str, text: str, key: bytes, back: bool = False) -> str | None:
    """The value's pseudonym (back: the value of a pseudonym); None if it doesn't validate."""
    if kind == "email":
        local, _, host = text.partition("@")
        alphabets = [next((a for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") if c in a), c) for c in local]
        new = permute([a.index(c) for a, c in zip(alphabets, local, strict=True)], [len(a) for a in alphabets], key, f"email|{host.lower()}", back)
        return "".join(a[i] for a, i in zip(alphabets, new, strict=True)) + "@" + host
    if kind == "ip":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        return ".".join(map(str, permute(octets, [256] * 4, key, "ip", back)))
    if kind == "date":
        form = "%Y-%m-%d" if text[4] == "-" else "%d/%m/%Y" if text[2] == "/" else "%d.%m.%Y"
        try:
            day = dt.datetime.strptime(text, form).date()
        except ValueError:
            return None
        first = dt.date(max(1, day.year // 100 * 100), 1, 1)
        days = dt.date(day.year // 100 * 100 + 99, 12, 31).toordinal() - first.toordinal() + 1
        new = dt.date.fromordinal(first.toordinal() + below(day.toordinal() - first.toordinal(), days, key, f"date|{first.year}", back))
        return form.replace("%Y", f"{new.year:04}").replace("%m", f"{new.month:02}").replace("%d", f"{new.day:02}")
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "card":
        if luhn(digits[:-1]) != digits[-1]:
            return None
        inner = permute(digits[1:-1], [10] * (len(digits) - 2), key, f"card|{digits[0]}|{len(digits)}", back)
        return refilled(text, [digits[0], *inner, luhn([digits[0], *inner])])
    if text.isdigit():
        return None
    head = len(digits) - 10  # the country's digits stay
    return refilled(text, digits[:head] + permute(digits[head:], [10] * 10, key, f"phone|{digits[:head]}", back))


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of all values that validate, in order; an earlier kind's text isn't claimed again."""
    if not text or not ("@" in text or any(c.isdigit() for c in text)):
        return []
    out: list[tuple[int, int, str, str]] = []
    claimed = bytearray(len(text))
    for kind, pattern in COMPILED.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if not any(claimed[m.start() : m.end()]) and pseudonym(kind, m.group(), b"check") is not None:
                out.append((m.start(), m.end(), kind, m.group()))
                claimed[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    return sorted(out)


def replaced(text: str, key: bytes, back: bool = False) -> tuple[str, list[dict]]:
    out, at, spans = [], 0, []
    for start, end, kind, value in found(text):
        out += [text[at:start], pseudonym(kind, value, key, back) or value]
        spans.append({"kind": kind, "start": start, "end": end})
        at = end
    return "".join([*out, text[at:]]), spans


def pseudonymised(text: Column, key: str) -> Column:
    """struct<text, spans array<struct<kind, start, end>>>: places are code points of the input."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @F.pandas_udf("text string, spans array<struct<kind:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        done = [replaced(x or "", secret) for x in texts]
        return pd.DataFrame({"text": [t for t, _ in done], "spans": [s for _, s in done]})

    return run(text)


def pseudonymise_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's personal values replaced, and pii_spans (kind, start, end in the input's code points; replaces a column of that name).

    Nulls: a null text becomes an empty one without spans. Very long texts are scanned whole. Ties: an earlier kind of
    PATTERNS claims its text first. Repeated rows get equal results. An empty table gives an empty
    result. A value that maps to itself (one in as many as its format has) stays as it is.
    """
    [done] = fresh(docs, "__p")
    return docs.withColumn(done, pseudonymised(text_or_empty(text_col), key)).withColumns({text_col: F.col(f"{done}.text"), "pii_spans": F.col(f"{done}.spans")}).drop(done)


def key_of(spark: SparkSession) -> str:
    """The session's key. Where none is set, a random one: equal values stay linked within the application, and nobody can turn them back later."""
    return spark.conf.get(KEY_SETTING, "") or _OWN.setdefault(spark.sparkContext.applicationId, token_hex(32))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise_documents(documents(spark, sf_dir).select("doc_id", "text"), key_of(spark))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_found"), *[count(k) for k in PATTERNS], "pii_spans")


QUERIES = {"op8_pii": op8_pii}
ORACLES = {}
