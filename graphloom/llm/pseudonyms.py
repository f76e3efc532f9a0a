"""Personal data: format-preserving Feistel pseudonyms.

Found values are permuted, under a key, within their own format: equal values become equal pseudonyms in every document, and
different values of one format stay different.  The formats: payment card numbers (13 to 19 digits with a right Luhn digit), IPv4
addresses, telephone numbers (+country (area) number or grouped), social security numbers, IBANs with a right check number, dates
(year-month-day, day.month.year, month/day/year; real days of 1900 to 2099), e-mail addresses (local part) and
secrets (hex of 32 digits or more).  Numbers that fail their check are left as they are.
Runs of groups are read as a card or IBAN from each group on, the longest reading first that passes its check (an IBAN of its country's length before others): what stands
beside a number, such as an expiry date, does not hide it.

A value is read as a number below the size of its format, and a balanced Feistel network of ten keyed rounds on the next even number of
bits is applied until the result is below that size again (cycle walking): a permutation of the format.  Check digits are recomputed.

Null texts stay null with zero counts; empty texts stay empty; repeated rows get the same result.  Work is row by row, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

KEY = b"graphloom demonstration key"  # a parameter: real runs pass their own
ROUNDS, PART = 10, 256
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
KINDS = ("email", "secret", "iban", "date", "ssn", "ip", "card", "phone")
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z]))"
    r"|(?P<date>(?<![\d.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-]))"
    r"|(?P<ip>(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?!\d))"
    r"|(?P<card>(?<![\d-])[0-9](?:[ -]?[0-9]){12,18}(?!\d))"
)
#: within a run that is no card as a whole, one may also begin after a dash
WITHIN = re.compile(PATTERN.pattern.replace(r"(?P<card>(?<![\d-])", r"(?P<card>(?<!\d)"))
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def permute(x: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    tag = label.encode()[:16]
    while True:
        a, b = x >> half, x & mask
        for k in range(ROUNDS):
            h, need = b"", b.to_bytes(width, "big")
            while len(h) < width:  # one digest gives 64 bytes
                h += blake2b(need + len(h).to_bytes(4, "big"), key=key[:64], salt=bytes([k]), person=tag).digest()
            a, b = b, a ^ (int.from_bytes(h[:width], "big") & mask)
        x = a << half | b
        if x < size:
            return x


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def refill(shape: str, symbols: str) -> str:
    """shape with its letters and digits replaced one by one."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def classes(text: str, key: bytes, label: str, digits: str = "") -> str:
    """Permutes letters within their case and digits among digits; digits: another alphabet for all symbols.

    A long text is permuted in parts of `PART` characters, each under a label of what stands before it: still a permutation."""
    if len(text) > PART:
        seen, out = blake2b(label.encode(), digest_size=2), []
        for k in range(0, len(text), PART):
            out.append(classes(text[k : k + PART], key, seen.hexdigest(), digits))
            seen.update(text[k : k + PART].encode())
        return "".join(out)
    sets = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    at = [(digits or next((s for s in sets if c in s), "")) if c.isascii() and c.isalnum() else "" for c in text]
    x, size = 0, 1
    for c, s in zip(text, at, strict=True):
        if s:
            x, size = x * len(s) + s.index(c), size * len(s)
    form = "".join(s[0] if s else c for c, s in zip(text, at, strict=True))
    x, out = permute(x, size, key, label + blake2b(form.encode(), digest_size=6).hexdigest()), []
    for c, s in zip(reversed(text), reversed(at), strict=True):
        if s:
            x, k = divmod(x, len(s))
            out.append(s[k])
        else:
            out.append(c)
    return "".join(reversed(out))


def card(v: str, key: bytes) -> str | None:
    d = re.sub(r"\D", "", v)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, f"card{len(d)}")).zfill(len(d) - 1)
    return refill(v, body + luhn_digit(body))


def ip(v: str, key: bytes) -> str | None:
    parts = [int(x) for x in v.split(".")]
    if max(parts) > 255 or v != ".".join(map(str, parts)):
        return None
    return ".".join(map(str, permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip").to_bytes(4, "big")))


def phone(v: str, key: bytes) -> str | None:
    lead = m.group(0) if (m := re.match(r"\+\d{1,3}(?=[ (-])", v)) else ""
    d = re.sub(r"\D", "", v[len(lead):])
    return lead + refill(v[len(lead):], str(permute(int(d), 10 ** len(d), key, f"phone{lead}{len(d)}")).zfill(len(d)))


def ssn(v: str, key: bytes) -> str | None:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    a, g, s = map(int, v.split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    x = permute(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, key, "ssn")
    (a, g), s = divmod(x // 9999, 99), x % 9999 + 1
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s:04d}"


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def iban(v: str, key: bytes) -> str | None:
    flat = v.replace(" ", "")
    if iban_check(flat[:2], flat[4:]) != flat[2:4]:
        return None
    body = classes(flat[4:], key, "iban")
    return refill(v, flat[:2] + iban_check(flat[:2], body) + body)


def day(v: str, key: bytes) -> str | None:
    try:
        if v[4] == "-":
            d, form = date(int(v[:4]), int(v[5:7]), int(v[8:])), "{0:04d}-{1:02d}-{2:02d}"
        elif v[2] == ".":
            d, form = date(int(v[6:]), int(v[3:5]), int(v[:2])), "{2:02d}.{1:02d}.{0:04d}"
        else:
            d, form = date(int(v[6:]), int(v[:2]), int(v[3:5])), "{1:02d}/{2:02d}/{0:04d}"
    except ValueError:
        return None
    if not FIRST <= d.toordinal() <= LAST:
        return None
    new = date.fromordinal(FIRST + permute(d.toordinal() - FIRST, LAST - FIRST + 1, key, "date"))
    return form.format(new.year, new.month, new.day)


def email(v: str, key: bytes) -> str | None:
    local, _, domain = v.rpartition("@")
    return f"{classes(local, key, 'mail')}@{domain}"


def secret(v: str, key: bytes) -> str | None:
    if v.isdigit():
        return None
    return classes(v, key, "hex", "0123456789abcdef" if v == v.lower() else "0123456789ABCDEF")


MAKERS: dict[str, Callable[[str, bytes], str | None]] = {"email": email, "secret": secret, "iban": iban, "date": day, "ssn": ssn, "ip": ip, "card": card, "phone": phone}


def readings(kind: str, v: str) -> Iterator[str]:
    """v and, of cards and IBANs, its beginnings that end with a group."""
    groups = [v[: m.start()] for m in re.finditer("[ -]", v)][::-1] if kind in ("card", "iban") else []
    if kind == "iban" and (n := IBAN_LENGTH.get(v[:2])):
        at = [k for k, c in enumerate(v, 1) if c != " "]
        if n <= len(at):
            yield v[: at[n - 1]]
    yield v
    for g in groups:
        if kind == "iban" or 13 <= sum(c.isdigit() for c in g) <= 19:
            yield g


def replace(text: str, key: bytes, counts: Counter) -> str:
    out, done, at, run = [], 0, 0, 0  # done: up to where text is out; run: the end of a run that is no card as a whole
    while True:
        m = WITHIN.search(text, at) if at < run else None
        if m is None or m.start() >= run:
            m = PATTERN.search(text, at)
        if m is None:
            return "".join([*out, text[done:]])
        kind = m.lastgroup
        for v in readings(kind, m.group(0)):
            if (made := MAKERS[kind](v, key)) is not None:
                counts[kind] += 1
                out += [text[done : m.start()], made]
                done = at = m.start() + len(v)
                break
        else:
            at = m.start() + 1 if kind in ("card", "iban") else m.end()
        if kind == "card":
            run = max(run, m.end())


def pseudonymise(docs: DataFrame, *, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """The input row as struct __row with the new text and n_<kind> beside it."""
    ready = re.compile(r"[0-9@]|[0-9A-Fa-f]{32}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = batch.column(batch.schema.get_field_index("text")).to_pylist(), []
            for k, text in enumerate(texts):
                counts.append(c := Counter())
                if text and ready.search(text):
                    texts[k] = replace(text, key, c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array([c[n] for c in counts], pa.int64()) for n in KINDS)], names=["__row", "text", *(f"n_{n}" for n in KINDS)])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("__row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["__row"], T.StructField("text", T.StringType()), *(T.StructField(f"n_{n}", T.LongType()) for n in KINDS)])
    return rows.mapInArrow(apply, schema)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text")).select("__row.doc_id", "text", *[f"n_{n}" for n in KINDS])
