"""Personal data: format-preserving pseudonyms from keyed Feistel permutations."""

from __future__ import annotations

import re
from datetime import date
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
KINDS = ("card", "iban", "phone", "ssn", "ipv4", "date", "email", "token")
YEARS = (1900, 2099)
#: How each kind is written. A match counts only if its check accepts it.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<token>(?<![A-Za-z0-9])(?=[a-fA-F]*[0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9]))"
    r"|(?P<ipv4>(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9]))"
    r"|(?P<date>(?<![A-Za-z0-9./-])(?:[0-9]{4}(?P<y>[-/.])[0-9]{1,2}(?P=y)[0-9]{1,2}|[0-9]{1,2}(?P<z>[-/.])[0-9]{1,2}(?P=z)[0-9]{4})(?:(?=[Tt][0-9]{2}:)|(?![A-Za-z0-9/-]|\.[0-9])))"
    r"|(?P<ssn>(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-]))"
    r"|(?P<card>(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9]|[.-][0-9]))"
    r"|(?P<phone>(?<![A-Za-z0-9+.])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){1,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\+[0-9]{8,15}(?![A-Za-z0-9]))"
)


#: Digit groups of cards (others are of one size but for a shorter last one) and of North American phone numbers.
CARD_GROUPS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))
PHONE_GROUPS = ((3, 3, 4), (1, 3, 3, 4))


class Permutation:
    """Keyed permutations of the whole numbers below any n: a Feistel network over pairs, walked until it lands below n."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, step: int, x: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        data = tweak + b"\0" + step.to_bytes(1, "big") + x.to_bytes((x.bit_length() + 7) // 8, "big")
        out = b"".join(blake2b(data, key=self.key, digest_size=min(64, size), salt=k.to_bytes(2, "big")).digest() for k in range(-(-size // 64)))
        return int.from_bytes(out, "big") % modulus

    def __call__(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        """Where x goes, or with back, what comes to x."""
        if not 0 <= x < n:
            raise ValueError("outside the domain")
        a = isqrt(n - 1) + 1
        tweak = tweak + b"\0" + n.to_bytes((n.bit_length() + 7) // 8, "big")
        while True:
            left, right = divmod(x, a)
            for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = (right - self._round(tweak, step, left, a)) % a, left
                else:
                    left, right = right, (left + self._round(tweak, step, right, a)) % a
            x = left * a + right
            if x < n:
                return x


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for valid card numbers."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10


def iban_rest(iban: str) -> int:
    """1 for a valid IBAN."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def spread(digits: str, like: str) -> str:
    """The characters of digits at the places of letters and digits in like, in like's case; the rest of like stays."""
    source = iter(digits)
    return "".join((next(source).lower() if c.islower() else next(source).upper()) if c.isalnum() else c for c in like)


def classes(text: str, tweak: bytes, permute: Permutation, back: bool) -> str:
    """Letters go to letters and digits to digits, all of them together as one mixed number."""
    x, n, kinds = 0, 1, []
    for c in text:
        base = 10 if c.isdigit() else 26
        x = x * base + (int(c) if base == 10 else ord(c.lower()) - 97)
        n *= base
        kinds.append(base)
    x, out = permute(x, n, tweak + bytes(kinds), back), []
    for base in reversed(kinds):
        x, r = divmod(x, base)
        out.append(str(r) if base == 10 else chr(97 + r))
    return "".join(reversed(out))


def _card(text, permute, back):
    digits, sizes = re.sub("[^0-9]", "", text), tuple(map(len, re.findall("[0-9]+", text)))
    even = len(set(sizes[:-1])) == 1 and sizes[0] >= max(4, sizes[-1])
    if luhn(digits) or len(set(digits)) == 1 or len(sizes) > 1 and not (len({*re.sub("[0-9]", "", text)}) == 1 and (even or sizes in CARD_GROUPS)):
        return None
    middle = permute(int(digits[1:-1]), 10 ** (len(digits) - 2), b"card" + digits[:1].encode(), back)
    body = f"{digits[0]}{middle:0{len(digits) - 2}d}"
    return spread(body + str(-luhn(body + "0") % 10), text)


def _iban(text, permute, back):
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
        return None
    account = classes(plain[4:], b"iban" + plain[:2].encode(), permute, back).upper()
    return spread(f"{plain[:2]}{98 - iban_rest(plain[:2] + '00' + account):02d}{account}", text)


def _phone(text, permute, back):
    digits = re.sub("[^0-9]", "", text)
    plus = text.startswith("+")
    if not plus and tuple(map(len, re.findall("[0-9]+", text))) not in PHONE_GROUPS:
        return None
    national = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits if len(digits) == 10 and not plus else ""
    if national and national[0] >= "2" and national[3] >= "2":  # North American: area and exchange begin with 2 to 9
        area, exchange, line = int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])
        x = permute((area * 800 + exchange) * 10_000 + line, 6_400_000_000, b"phone", back)
        new = f"{x // 8_000_000 + 200}{x // 10_000 % 800 + 200}{x % 10_000:04d}"
        return spread(digits[: len(digits) - 10] + new, text)
    if plus and 8 <= len(digits) <= 15:  # the country stays
        rest = len(digits) - 3
        return spread(f"{digits[:3]}{permute(int(digits[3:]), 10**rest, b'phone' + digits[:3].encode(), back):0{rest}d}", text)
    return None


def _ssn(text, permute, back):
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    x = permute(((area - (area > 666) - 1) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn", back)
    area = x // (99 * 9999) + 1
    return f"{area + (area >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def _ipv4(text, permute, back):
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


#: Months, and days of a month, that go to each other only: the number of digits and the way a date is read can't change.
_MONTHS, _DAYS = ((1, 9), (10, 12)), ((1, 9), (10, 12), (13, 31))


def _date(text, permute, back):
    """Dates of YEARS among themselves: months below 10 and from 10, days below 10, to 12 and from 13 each go to their like.

    So a date has as many digits as its pseudonym, and whether its first number is the day or the month can be told from
    one as from the other. All notations of a day go the same way.
    """
    sign = re.search("[-/.]", text)[0]
    a, b, c = text.split(sign)
    if len(a) == 4:
        order = "ymd"
    elif int(b) > 12 or (sign == "/" and int(a) <= 12):
        order = "mdy"
    else:
        order = "dmy"
    part = dict(zip(order, (a, b, c), strict=True))
    y, m, d = (int(part[k]) for k in "ymd")
    try:
        date(y, m, d)
    except ValueError:
        return None
    if not YEARS[0] <= y <= YEARS[1]:
        return None
    (m0, m1), (d0, d1) = next(r for r in _MONTHS if r[0] <= m <= r[1]), next(r for r in _DAYS if r[0] <= d <= r[1])
    months, days = m1 - m0 + 1, d1 - d0 + 1
    x = ((y - YEARS[0]) * months + m - m0) * days + d - d0
    while True:  # days that a month doesn't have are walked over
        x = permute(x, (YEARS[1] - YEARS[0] + 1) * months * days, f"date{m0}/{d0}".encode(), back)
        y, m, d = x // (months * days) + YEARS[0], x // days % months + m0, x % days + d0
        try:
            date(y, m, d)
        except ValueError:
            continue
        new = {"y": y, "m": m, "d": d}
        return sign.join(f"{new[k]:0{len(part[k])}d}" for k in order)


def _email(text, permute, back):
    name, host = text.rsplit("@", 1)
    plain = re.sub("[^A-Za-z0-9]", "", name)
    return f"{spread(classes(plain, b'email' + host.lower().encode(), permute, back), name)}@{host}"


def _token(text, permute, back):
    new = f"{permute(int(text, 16), 1 << 4 * len(text), b'token', back):0{len(text)}x}"
    return new.upper() if any(c.isupper() for c in text) else new


CHECKED = {"card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "date": _date, "email": _email, "token": _token}


_GROUP = re.compile("[A-Za-z0-9]+")


def _shorter(text: str, kind: str, permute: Permutation, back: bool) -> tuple[str, str, int] | None:
    """Of a run of groups that is nothing valid as a whole, the kind, pseudonym and end of the longest valid value at its start."""
    groups = list(_GROUP.finditer(text))
    sizes = tuple(len(g[0]) for g in groups)
    for n in range(len(groups) - 1, 0, -1):
        end = groups[n - 1].end()
        kinds = ["card"] * (sizes[:n] in CARD_GROUPS or (n == 1 and 13 <= sizes[0] <= 19)) + ["phone"] * (sizes[:n] in PHONE_GROUPS)
        for kind in ["iban"] if kind == "iban" else kinds:
            if (new := CHECKED[kind](text[:end], permute, back)) is not None:
                return kind, new, end
    return None


def pseudonymise(text: str, permute: Permutation, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with each validated value replaced, and how many of each kind there were.

    Where a run of numbers isn't valid as a whole, shorter values at its start are tried, and the search goes on after
    its first number, so a valid value next to other numbers isn't passed over.
    """
    found: dict[str, int] = {}
    out, done, at = [], 0, 0
    while match := PATTERN.search(text, at):
        kind = next(k for k in KINDS if match[k] is not None)
        start, end = match.span()
        new = CHECKED[kind](match[0], permute, back)
        if new is None and kind == "card":  # too long a run of digits may still be a phone number
            kind = "phone"
            new = _phone(match[0], permute, back)
        if new is None and kind in ("phone", "iban") and (cut := _shorter(match[0], kind, permute, back)):
            kind, new, end = cut[0], cut[1], start + cut[2]
        if new is None:
            at = start + _GROUP.search(match[0]).end() if kind in ("phone", "date") else end
            continue
        out += [text[done:start], new]
        done = at = end
        found[kind] = found.get(kind, 0) + 1
    return "".join([*out, text[done:]]), found


def pseudonyms(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts with personal data replaced: doc_id, text, n_found, n_card, n_iban, n_phone, n_ssn, n_ipv4, n_date, n_email, n_token; a row for each input row, no shuffle.

    A value is replaced only if it is valid: card numbers by Luhn's sum, IBANs modulo 97, North American and
    international phone numbers, US social security numbers, IPv4 addresses, dates of 1900 to 2099 by the calendar (also before the time of an ISO timestamp), mail
    addresses, and keys of 32 to 128 hexadecimal digits. Its pseudonym is its image under a permutation, drawn by the
    key, of all valid values of that kind; checks, separators, digit groups, letter case, a card's first digit, country
    prefixes, an address's host, a date's notation and the digits of its day and month (``_date``) stay. So equal values get equal pseudonyms in all documents,
    however they are grouped, different ones get different ones, and the owner of the key can undo it.

    Null text stays null and counts nothing; ids may be null or repeat. Other columns aren't read.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["n_found", *(f"n_{k}" for k in KINDS)]

    def run(batches):
        permute, digit = Permutation(key), re.compile("[0-9@]").search
        for batch in batches:
            texts, counts = [], {n: [] for n in names}
            for text in batch.column("text").to_pylist():
                new, found = pseudonymise(text, permute) if text and digit(text) else (text, {})
                texts.append(new)
                counts["n_found"].append(sum(found.values()))
                for k in KINDS:
                    counts[f"n_{k}"].append(found.get(k, 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), *(pa.array(counts[n], pa.int64()) for n in names)], ["doc_id", "text", *names])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, ", ".join([f"doc_id {kind}", "text string", *(f"{n} long" for n in names)]))
