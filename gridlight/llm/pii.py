"""Personal values replaced by format-preserving pseudonyms: a keyed Feistel permutation inside each value's own format.

The permutation is one to one, so equal values get equal pseudonyms in every document and different values different ones,
without any table of values; whoever holds the key can reverse it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from datetime import date
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import DataFrame

from gridlight.llm.tables import map_columns

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
RUN = re.compile(r"[+(]?\d[\d ().\-/]*\d")
NUMBERS = re.compile(r"""(?<!\d)(?<!\d\.)(?:
    (?P<ymd>\d{4}([-/.])\d{1,2}\2\d{1,2})(?![\d]|[-/.]\d) | (?P<dmy>\d{1,2}([-/.])\d{1,2}\4\d{4})(?![\d]|[-/.]\d)
  | (?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\d]|\.\d)
  | (?P<card>\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)
  | (?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])
  | (?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4}|(?<!\d[ ])\d{3}[ ]\d{3}[ ]\d{4}(?![ ]\d))(?!\d))""", re.X)
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
# Letters and digits of an IBAN by country.
IBAN_LENGTH = {country: int(n) for n, countries in (x.split(":") for x in """15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV
    22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM
    28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU""".split()) for country in countries.split(",")}
SECRET = re.compile(r"\b[0-9a-fA-F]{32,128}\b")


def permuted(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mixed(no: int, x: int) -> int:
        made = b"".join(blake2b(b"%d|%d|%d|%d|" % (no, half, size, part) + kind.encode() + b"|" + x.to_bytes(width, "big"), key=key[:64], digest_size=64).digest()
                        for part in range(-(-width // 64)))
        return int.from_bytes(made[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for no in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
            left, right = (right ^ mixed(no, left), left) if back else (right, left ^ mixed(no, right))
        value = left << half | right
        if value < size:
            return value


def walked(value: int, size: int, key: bytes, kind: str, good: Callable[[int], bool], back: bool) -> int:
    """``permuted`` until the result is good, which is again a permutation of the good values."""
    while True:
        value = permuted(value, size, key, kind, back)
        if good(value):
            return value


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def in_shape(raw: str, made: str) -> str:
    """The letters and digits of ``made`` in the places of those of ``raw``."""
    letters = iter(made)
    return "".join(next(letters) if c.isascii() and c.isalnum() else c for c in raw)


def spelled(raw: str, key: bytes, kind: str, back: bool, hexadecimal: bool = False) -> str:
    """Digits become digits and letters letters of the same case; all other characters stay."""
    if hexadecimal:
        letter = "abcdef" if raw.islower() or not any(c in "ABCDEF" for c in raw) else "ABCDEF"
        alphabets = ["0123456789" + letter if raw.islower() or raw.isupper() else string.digits if c.isdigit() else "abcdef" if c.islower() else "ABCDEF" for c in raw]
    else:
        alphabets = [string.digits if c.isdigit() else string.ascii_lowercase if c.islower() else string.ascii_uppercase for c in raw if c.isascii() and c.isalnum()]
    symbols = raw if hexadecimal else [c for c in raw if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for c, alphabet in zip(symbols, alphabets):
        value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    shape = f"{kind}:{','.join(map(str, (len(a) for a in alphabets)))}"
    value, out = permuted(value, size, key, shape, back), []
    for alphabet in reversed(alphabets):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return in_shape(raw, "".join(reversed(out)))


def card(raw: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", raw)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    whole = lambda v: next(f"{v:0{n}d}{c}" for c in range(10) if luhn(f"{v:0{n}d}{c}"))
    return in_shape(raw, whole(walked(int(digits[:-1]), 10 ** n, key, "card", lambda v: len(set(whole(v))) > 1, back)))


def ssn(raw: str, key: bytes, back: bool) -> str | None:
    good = lambda v: v // 10**6 not in (0, 666) and v // 10**6 < 900 and v // 10**4 % 100 > 0 and v % 10**4 > 0
    value = int(raw.replace("-", ""))
    return in_shape(raw, f"{walked(value, 10**9, key, 'ssn', good, back):09d}") if good(value) else None


def phone(raw: str, key: bytes, back: bool) -> str | None:
    """The country code stays; of the rest 7 to 14 digits are permuted."""
    code = re.match(r"\+(\d{1,3})(?=[ .(-])|\+(1|7|\d\d)", raw)
    head = (code[1] or code[2]) if code else ""
    digits = re.sub(r"\D", "", raw)[len(head):]
    if not 7 <= len(digits) <= 14:
        return None
    return in_shape(raw, head + f"{permuted(int(digits), 10 ** len(digits), key, f'phone{head}:{len(digits)}', back):0{len(digits)}d}")


def ip(raw: str, key: bytes, back: bool) -> str | None:
    parts = [int(p) for p in raw.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in raw.split(".")):
        return None
    value = permuted(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def day(raw: str, key: bytes, back: bool) -> str | None:
    """A day of 1900 to 2099 becomes another one of these, any other day of the years 1000 to 9999 one outside them."""
    a, b, c = re.split(r"[-/.]", raw)
    sign = re.search(r"[-/.]", raw)[0]
    order = "ymd" if len(a) == 4 else "mdy" if sign == "/" and int(a) <= 12 or int(b) > 12 else "dmy"
    got = dict(zip(order, (a, b, c)))
    try:
        value = date(int(got["y"]), int(got["m"]), int(got["d"])).toordinal()
    except ValueError:
        return None
    if int(got["y"]) < 1000:
        return None
    if FIRST_DAY <= value <= LAST_DAY:
        value = FIRST_DAY + permuted(value - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "day", back)
    else:
        least, most = date(1000, 1, 1).toordinal(), date(9999, 12, 31).toordinal()
        value = least + walked(value - least, most - least + 1, key, "far day", lambda v: not FIRST_DAY <= least + v <= LAST_DAY, back)
    made = date.fromordinal(value)
    padded = all(len(x) != 1 for x in (a, b, c))
    part = {"y": f"{made.year:04d}", "m": f"{made.month:02d}" if padded else str(made.month), "d": f"{made.day:02d}" if padded else str(made.day)}
    if order in ("mdy", "dmy") and sign == "/":    # read back in the same order only if the middle or first number tells it
        part = part if order == "mdy" or made.day > 12 else {"y": part["y"], "m": part["d"], "d": part["m"]}
    return sign.join(part[x] for x in order)


def iban_number(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4]))


def is_iban(value: str) -> bool:
    return 15 <= len(value) <= 34 and iban_number(value) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """(start, end) of valid IBANs.  What looks like one may have taken in words behind it: of its beginnings that end with a
    group, the one of the country's length is tried first, then all from the longest on."""
    found, at = [], 0
    while m := IBAN.search(text, at):
        raw, at = m[0], m.start() + 2
        cuts = [i for i in range(len(raw), 0, -1) if i == len(raw) or raw[i] == " "]
        size = IBAN_LENGTH.get(raw[:2])
        cuts.sort(key=lambda i: i - raw.count(" ", 0, i) != size)
        for i in cuts:
            if is_iban(raw[:i].replace(" ", "")):
                found.append((m.start(), m.start() + i))
                at = m.start() + i
                break
    return found


def iban(raw: str, key: bytes, back: bool) -> str | None:
    value, number = raw.replace(" ", ""), iban_number
    if not is_iban(value):
        return None
    rest = spelled(value[4:], key, f"iban{value[:2]}", back)
    return in_shape(raw, f"{value[:2]}{98 - number(value[:2] + '00' + rest) % 97:02d}{rest}")


def email(raw: str, key: bytes, back: bool) -> str | None:
    name, _, host = raw.rpartition("@")
    return f"{spelled(name, key, f'email@{host.lower()}', back)}@{host}"


def secret(raw: str, key: bytes, back: bool) -> str | None:
    if not (any(c.isdigit() for c in raw) and any(c.isalpha() for c in raw)):
        return None
    return spelled(raw, key, "secret", back, hexadecimal=True)


KINDS = {"date": day, "ip": ip, "card": card, "ssn": ssn, "phone": phone, "iban": iban, "email": email, "secret": secret}


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, raw: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if it is no valid value of its kind.  ``back`` reverses it."""
    return KINDS[kind](raw, key, back)


def values_of(text: str, key: bytes, kinds: frozenset[str] = frozenset(KINDS), back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of every valid value, from left to right and without overlap."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0]) for m in EMAIL.finditer(text)]
    found += [(a, b, "iban", text[a:b]) for a, b in ibans(text)]
    found += [(m.start(), m.end(), "secret", m[0]) for m in SECRET.finditer(text)]
    taken = [(a, b) for a, b, _, _ in found]
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        for m in NUMBERS.finditer(text, run.start(), run.end()):
            kind = {"ymd": "date", "dmy": "date"}.get(m.lastgroup, m.lastgroup)
            edge = text[m.start() - 1:m.start()] + text[m.end():m.end() + 1]
            if not any(c.isalnum() or c in "_@" for c in edge) and not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), kind, m[0]))
    made, last = [], 0
    for a, b, kind, raw in sorted(found):
        if a >= last and kind in kinds and (new := pseudonym(kind, raw, key, back)) is not None:
            made.append((a, b, kind, new))
            last = b
    return made


def replaced(text: str, values: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for a, b, _, new in values:
        parts += [text[at:a], new]
        at = b
    return "".join([*parts, text[at:]])


def pseudonymise(docs: DataFrame, key: bytes, kinds: frozenset[str] = frozenset(KINDS), id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """(doc_id, text with pseudonyms, found array of kind, start, end in the given text, pseudonym) of every whole text.

    A null text stays null and has nothing found.  Rows are independent: null ids, ties and repeated rows stay as they are;
    other columns are left out.  ``back`` turns pseudonyms into the values again."""
    def run(texts):
        new, found = [], []
        for text in texts:
            values = values_of(text, key, kinds, back) if text else []
            new.append(replaced(text, values) if values else text)
            found.append([{"kind": kind, "start": a, "end": b, "pseudonym": made} for a, b, kind, made in values])
        return [new, found]
    return map_columns(docs, [text_col], run, "text string, found array<struct<kind:string,start:int,end:int,pseudonym:string>>", [id_col])
