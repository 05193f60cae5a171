"""Operator 5: format-preserving pseudonyms for personal data.

A value is found by pattern and taken only if it is valid (Luhn sum, octet
range, calendar date, modulus 97, area rules).  It is a number in a domain of
its format; a Feistel network keyed by BLAKE2 permutes the smallest power of
four that holds the domain, and is walked until it lands inside.  A card or IBAN that is not valid is read again
without its last groups, and a card from its next group on.  So each
format keeps its shape and its validity, equal values keep equal pseudonyms
in every document, and different values never meet.

Null texts stay null, with no findings; empty texts stay empty.  Equal rows are
rewritten alike; of two readings that overlap the first that is valid is taken;
an empty table gives no rows; texts of any length are scanned whole, and other
columns are not read.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, column_of, only

ROUNDS = 8
KINDS = ("email", "card", "phone", "ip", "ssn", "iban", "date", "secret")

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\5[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![0-9A-Za-z.])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9A-Za-z]|\.[0-9]))"
)
LIKELY = re.compile(r"[0-9@]")
GAP = re.compile(r"[ -]")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ"
_CLASSES = {c: alphabet for alphabet in (_DIGITS, _LOWER, _UPPER, _ACCENTED, _ACCENTED.upper().replace("SS", "")) for c in alphabet}
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal() - datetime.date(1900, 1, 1).toordinal() + 1


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    if size <= 1:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def round_value(x: int, r: int) -> int:
        out, block = b"", 0
        while len(out) < width:
            out += hashlib.blake2b(x.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width - len(out)), person=f"{r}:{block}".encode()[:16], salt=hashlib.blake2b(f"{tweak}:{size}".encode(), digest_size=16).digest()).digest()
            block += 1
        return int.from_bytes(out, "big") & mask

    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            left, right = right, left ^ round_value(right, r)
        value = (left << half) | right
        if value < size:
            return value


def _permute_text(text: str, key: bytes, tweak: str) -> str:
    """Each character moves within its own alphabet; the string as a whole is the value."""
    value, size = 0, 1
    for c in text:
        alphabet = _CLASSES.get(c)
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    shape = "".join({_DIGITS: "9", _LOWER: "a", _UPPER: "A"}.get(_CLASSES[c], "x") if c in _CLASSES else c for c in text)
    value = permute(value, size, key, f"{tweak}:{hashlib.blake2b(shape.encode(), digest_size=8).hexdigest()}")
    out = []
    for c in reversed(text):
        alphabet = _CLASSES.get(c)
        if alphabet:
            value, at = divmod(value, len(alphabet))
            c = alphabet[at]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit valid."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c)
        if i % 2 == 0:
            d = d * 2 - (9 if d > 4 else 0)
        total += d
    return str(-total % 10)


def _respell(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def _iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ssn_ok(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _date_of(text: str) -> tuple[datetime.date, str] | None:
    try:
        if text[4:5] == "-":
            date, form = datetime.date(int(text[:4]), int(text[5:7]), int(text[8:])), "iso"
        else:
            mark = "." if "." in text else "/"
            day, month, year = text.split(mark)
            date, form = datetime.date(int(year), int(month), int(day)), mark
    except ValueError:
        return None
    return (date, form) if 0 <= date.toordinal() - _FIRST_DAY < _DAYS else None


def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The stand-in of a found value; None when the value is not valid."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        return f"{_permute_text(local, key, 'email:' + domain.lower())}@{domain}"
    if kind == "secret":
        if not (any(c in _DIGITS for c in text) and any(c.isalpha() for c in text)):
            return None
        new = f"{permute(int(text, 16), 16 ** len(text), key, 'secret'):0{len(text)}x}"
        return new.upper() if text.upper() == text else new
    d = _digits(text)
    if kind == "card":
        if luhn_digit(d[:-1]) != d[-1] or not 13 <= len(d) <= 19:
            return None
        payload = f"{permute(int(d[:-1]), 10 ** (len(d) - 1), key, 'card'):0{len(d) - 1}d}"
        return _respell(text, payload + luhn_digit(payload))
    if kind == "phone":
        lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", text).group()
        rest = _digits(text[len(lead) :])
        if not 7 <= len(d) <= 15 or len(rest) < 6:
            return None
        return lead + _respell(text[len(lead) :], f"{permute(int(rest), 10 ** len(rest), key, 'phone' + lead):0{len(rest)}d}")
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255:
            return None
        value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
        return ".".join(str(b) for b in value.to_bytes(4, "big"))
    if kind == "ssn":
        if not _ssn_ok(d):
            return None
        value = d
        while True:  # walk the permutation of all nine-digit numbers back into the valid ones
            value = f"{permute(int(value), 10**9, key, 'ssn'):09d}"
            if _ssn_ok(value):
                return _respell(text, value)
    if kind == "iban":
        if not _iban_ok(text):
            return None
        plain = text.replace(" ", "")
        body = _permute_text(plain[4:], key, "iban" + plain[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        new = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in text)
    found = _date_of(text)
    if not found:
        return None
    date = datetime.date.fromordinal(_FIRST_DAY + permute(found[0].toordinal() - _FIRST_DAY, _DAYS, key, "date"))
    return date.isoformat() if found[1] == "iso" else f"{date.day:02d}{found[1]}{date.month:02d}{found[1]}{date.year:04d}"


def pseudonymize_text(text: str, replace) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its values replaced, and where they were (start, end, kind)."""
    if not LIKELY.search(text):
        return text, []
    spans, parts, at, scan = [], [], 0, 0
    # a valid card or IBAN may be followed by a short number or word, which its pattern takes for a last group
    while found := PATTERN.search(text, scan):
        kind, value = found.lastgroup, found.group()
        if kind == "email":
            trimmed = value.rstrip(".-")
            value = trimmed
        whole = value
        while (new := replace(kind, value)) is None and kind in ("card", "iban") and (cut := max(value.rfind(" "), value.rfind("-"))) > 0:
            value = value[:cut]
        if new is None:
            # a card may begin at a later group
            group = GAP.search(whole) if kind == "card" else None
            scan = found.start() + group.end() if group else found.end() if kind in ("card", "secret") else found.start() + 1
            continue
        start = found.start()
        spans.append((start, start + len(value), kind))
        parts += [text[at:start], new]
        at = scan = start + len(value)
    return "".join([*parts, text[at:]]), spans


def pseudonymize(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, the text with pseudonyms, n_found, and the spans in the old text; one pass without a shuffle."""

    def run(batches):
        replace = functools.lru_cache(maxsize=1 << 17)(functools.partial(pseudonym, key=key))
        cached = lambda kind, value: replace(kind, value)
        for part in chunks(batches, text_column):
            texts, spans = [], []
            for text in column_of(part, text_column).to_pylist():
                new, found = pseudonymize_text(text, cached) if text else (text, [])
                texts.append(new)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([column_of(part, id_column), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind)], names=[id_column, text_column, "n_found", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    return only(docs, id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, `{text_column}` string, n_found bigint, spans array<struct<start: bigint, end: bigint, kind: string>>")
