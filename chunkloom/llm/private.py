"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, URL schemes, cues such as ``password`` or ``AKIA``,
plus signs, pairs of digits and colons.  At each anchor a local parser walks outwards, finds where the candidate begins and
ends, and validates it: an e-mail address has a domain with a letters-only top label, an IPv4 address four numbers
up to 255, an IPv6 address a range in which hosts have theirs, a card number a right Luhn digit, an IBAN remainder 1 modulo 97, a telephone
number 8 to 15 digits with a plus sign or a bracketed area code.  Between anchors no Python code runs.
"""

from __future__ import annotations

import ipaddress
import re
import sys
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from chunkloom.llm.common import columns

Span = tuple[int, int, str]
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~-")
_HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DIGIT = frozenset("0123456789")
_TOKEN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-.")
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key")
#: The lengths of the IBAN registry.
_IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
        "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _left(t: str, i: int, ok: frozenset) -> int:
    while i > 0 and t[i - 1] in ok:
        i -= 1
    return i


def _right(t: str, i: int, ok: frozenset) -> int:
    n = len(t)
    while i < n and t[i] in ok:
        i += 1
    return i


def email(t: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign; a name of 1 to 64 characters, a host of two labels or more."""
    a = at
    while a > floor and at - a < 65 and t[a - 1] in _LOCAL:
        a -= 1
    while a < at and t[a] in ".!#$%&'*/=?^`{|}~-+":
        a += 1
    b = _right(t, at + 1, _HOST)
    labels = t[at + 1 : b].rstrip(".-").split(".")
    while len(labels) > 1 and not (labels[-1].isalpha() and len(labels[-1]) > 1):
        labels.pop()
    if a == at or at - a > 64 or t[at - 1] == "." or len(labels) < 2 or any(not x or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    return a, at + 1 + len(".".join(labels)), "email"


_DOTTED = re.compile("[0-9.]+")


def ip(t: str, a: int) -> tuple[int, Span | None]:
    """The end of the run of digits and dots that begins at a, and, if it is an address, its span: four numbers
    up to 255, neither part of a longer dotted number nor of a word."""
    end = b = _DOTTED.match(t, a).end()
    if b - a > 32:  # no address with any dots around it is worth so much
        inner = t[a:b].strip(".")
        if len(inner) > 15:
            return end, None
    while a < b and t[a] == ".":
        a += 1
    while b > a and t[b - 1] == ".":
        b -= 1
    parts = t[a:b].split(".")
    if len(parts) != 4 or not all(0 < len(p) < 4 and int(p) < 256 and (len(p) == 1 or p[0] != "0") for p in parts):
        return end, None
    if (a and t[a - 1].isalnum()) or (b < len(t) and t[b].isalnum()):
        return end, None
    return end, (a, b, "ip")


_HEX = frozenset("0123456789abcdefABCDEF:.")
_RANGES = [ipaddress.IPv6Network(n) for n in ("2000::/3", "fc00::/7", "fe80::/10", "::ffff:0:0/96", "64:ff9b::/96")]


_HEX_RUN = re.compile("[0-9a-fA-F:.]+")


def ipv6(t: str, a: int) -> tuple[int, Span | None]:
    """The end of the run of hexadecimal digits, colons and dots that begins at a, and, if it is a global, local or link-local
    address, or one that holds an IPv4 address, its span; :: and ::1 are nobody's."""
    end = b = _HEX_RUN.match(t, a).end()
    if b - a > 64 or t.count(":", a, b) < 2:
        return end, None
    if a and t[a - 1].isalnum():  # "node:2001:db8::1"
        a = t.find(":", a, b)
        if t[a + 1 : a + 2] == ":":
            return end, None
    if b < len(t) and t[b].isalnum():
        b = t.rfind(":", a, b)
        if b < 1 or t[b - 1] == ":":
            return end, None
    while a < b and (t[a] == "." or (t[a] == ":" and t[a + 1 : a + 2] != ":")):
        a += 1
    while b > a and (t[b - 1] == "." or (t[b - 1] == ":" and t[b - 2] != ":")):
        b -= 1
    try:
        at = ipaddress.IPv6Address(t[a:b])
    except ValueError:
        return end, None
    return end, (a, b, "ip") if any(at in n for n in _RANGES) else None


_RUN, _CHAIN = re.compile("[0-9]+"), re.compile("[0-9]+(?:[ -][0-9]+)*")
_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}


def cards(t: str, a: int, stop: int = sys.maxsize) -> tuple[int, list[Span]]:
    """The end of the chain of digit groups, split by single blanks or hyphens, that begins at a and goes up to ``stop``, and the cards in it.

    A card has 13 to 19 digits with a right check digit: one group, or neighbouring groups of 3 digits or more.  Of
    overlapping ones a single group goes first, then the whole chain, then the usual groups with one kind of separator;
    a hyphen binds closer than a blank, and of groups that begin with 2 those that are issued (2221 to 2720) go first.
    """
    end = _RUN.match(t, a).end()
    if end - a < 13 and t[end : end + 1] not in (" ", "-"):
        return end, []
    end = _CHAIN.match(t, a, stop).end()
    groups = [m.span() for m in _RUN.finditer(t, a, end)]
    options = []
    for j, (x, first) in enumerate(groups):
        if t[x] not in "23456" or (x and (t[x - 1].isalnum() or t[x - 1] == "_")):
            continue
        n = 0
        for k in range(j, len(groups)):
            lo, y = groups[k]
            n += y - lo
            if n > 19 or (k > j and min(first - x, y - lo) < 3):
                break
            if n < 13 or (y < len(t) and (t[y].isalnum() or t[y] == "_")) or not luhn(t[x:y].replace(" ", "").replace("-", "")):
                continue
            usual = tuple(e - s for s, e in groups[j : k + 1]) in _SHAPES
            inner = {t[e] for _, e in groups[j:k]}
            torn = " " in inner and ((x > a and t[x - 1] == "-") or (y < end and t[y] == "-"))
            rank = 0 if k == j else 1 if (x, y) == (a, end) else 4 - usual - (len(inner) == 1) + torn + (t[x] == "2" and not "2221" <= t[x : x + 4] <= "2720")
            options.append((rank, x, -y))
    taken: set[int] = set()
    found = []
    for _, x, y in sorted(options):
        if taken.isdisjoint(range(x, -y)):
            taken.update(range(x, -y))
            found.append((x, -y, "card"))
    return end, sorted(found)


_PHONE = re.compile(
    r"(?<![^\W_])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))"
    r"|(?<![^\W_])(?<![-.+(])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
#: More than any of these numbers has.
_PHONE_SIZE = 40
_SSN = re.compile(r"(?<![^\W_])(?<!-)(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
_IBAN = re.compile(r"([A-Z]{2})\d{2}(?: ?[A-Z0-9]){11,30}")


def phone(t: str, i: int, top: int) -> Span | None:
    """A number around the digit at i, written with a plus sign, a bracketed area code or as 3-3-4 digits, that ends at ``top`` at the latest."""
    at, top = max(0, i - 24), min(top, i + _PHONE_SIZE)
    while m := _PHONE.search(t, at, top):
        if m.start() > i:
            return None
        if m.end() > i and 8 <= sum(c in _DIGIT for c in m[0]) <= 15:
            return m.start(), m.end(), "phone"
        at = m.start() + 1
    return None


def ssn(t: str, i: int) -> Span | None:
    """Three, two and four digits around the one at i, not part of a longer chain."""
    m = _SSN.search(t, max(0, i - 10), i + 12)
    return (m.start(), m.end(), "ssn") if m and m.start() <= i < m.end() else None


def iban(t: str, s: int) -> Span | None:
    """A country with a known length, and remainder 1 modulo 97; s is at the country."""
    if t[s : s + 2] not in _IBAN_LENGTH or (s and t[s - 1].isalnum()) or not (m := _IBAN.match(t, s)):
        return None
    need, e, n = _IBAN_LENGTH[m[1]], s, 0
    while e < len(t) and n < need and (t[e] in _ALNUM or t[e] == " "):
        n += t[e] != " "
        e += 1
    word = t[s:e].replace(" ", "")
    if n == need and not (e < len(t) and t[e].isalnum()) and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1:
        return s, e, "iban"
    return None


def access_key(t: str, i: int) -> Span | None:
    """AKIA or ASIA and 16 capitals or digits."""
    b = i + 20
    word = t[i:b]
    ok = len(word) == 20 and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" for c in word)
    return (i, b, "access_key") if ok and not (i and t[i - 1].isalnum()) and not (b < len(t) and t[b].isalnum()) else None


_ASSIGN = re.compile(r"['\"]?\s{0,3}(?::=|=>|=|:)\s{0,3}(['\"]?)")


def secret(t: str, i: int, cue: str) -> Span | None:
    """The value that is assigned to a cue: eight characters or more, with a digit."""
    if i and (t[i - 1].isalnum() and t[i - 1] not in "_"):
        return None
    m = _ASSIGN.match(t, i + len(cue))
    if not m:
        return None
    a = m.end()
    b = _right(t, a, _TOKEN)
    if not m[1]:
        while b > a and t[b - 1] in ".-":
            b -= 1
    return (a, b, "secret") if b - a >= 8 and any(c in _DIGIT for c in t[a:b]) else None


def userinfo(t: str, i: int) -> Span | None:
    """The name and password in scheme://name:password@host; i is behind the slashes."""
    b = i
    while b < len(t) and not t[b].isspace() and t[b] not in "/?#@\"'<>":
        b += 1
    return (i, b, "credentials") if b < len(t) and t[b] == "@" and ":" in t[i:b] and b > i + 2 else None


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("://", ("://", 3))
    for x in "0123456789abcdef:":
        a.add_word(":" + x, ("colon", 2))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    for k in ("akia", "asia"):
        a.add_word(k, ("key", 4))
    for c in _IBAN_LENGTH:
        for x in "0123456789":
            a.add_word(c.lower() + x, ("iban", 3))
    for x in "0123456789":
        for y in "0123456789":
            a.add_word(x + y, ("digit", 2))
        for s in ".-":
            a.add_word(x + s, ("digit", 2))
    a.make_automaton()
    return a


_shared: list[ahocorasick.Automaton] = []


def _lower(t: str) -> str:
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def find(text: str) -> list[Span]:
    """(start, end, kind) of all personal data, in order, without overlaps; an earlier start, then a longer span wins."""
    if not _shared:
        _shared.append(_automaton())
    out: list[Span] = []
    done = -1  # digits before this place are settled
    floor = chain = dotted = 0  # where the last number found, the chain of groups and the run of digits and dots end
    seen = 0  # where the last run of hexadecimal digits and colons ends
    held: list[Span] = []  # the chain's cards, the first one last
    plain = False
    address = account = None  # the run's address, the last account
    for end, (kind, size) in _shared[0].iter(_lower(text)):
        i = end + 1 - size
        if kind == "digit":
            if i < done:
                continue
            if i >= dotted:
                a = i
                while a > dotted and text[a - 1] in "0123456789.":
                    a -= 1
                dotted, address = ip(text, a)
            got = address if address and address[0] <= i < address[1] else account if account and i < account[1] else None
            if got:
                done = floor = got[1]
                if got is account:
                    continue
            else:
                if i >= chain:
                    a = max(floor, _left(text, i, _DIGIT))
                    chain, held = cards(text, a)
                    held.reverse()
                    # Where no number can be, all groups but the last, which may go on behind a dot, are settled at once.
                    plain = not held and not _SSN.search(text, max(0, a - 10), chain + 12) and not _PHONE.search(text, max(0, a - 24), chain + _PHONE_SIZE)
                if plain:
                    last = _left(text, chain, _DIGIT)
                    done = last if last > i else chain - 1
                    continue
                while held and held[-1][1] <= i:
                    held.pop()
                card = held[-1] if held and held[-1][0] <= i else None
                got = card or ssn(text, i)
                if not got:
                    near = held[-1:]
                    if not near and text[chain : chain + 1] in (")", ".") and (m := _RUN.search(text, chain, chain + 3)):
                        near = cards(text, m.start())[1]
                    got = phone(text, i, near[0][0] if near else len(text))
                done = got[1] if got else _right(text, i, _DIGIT) - 1
                if got:
                    floor = done
                    if got is not card and held and held[-1][0] < floor:  # what was a card goes on in another number
                        while held and held[-1][0] < floor:
                            held.pop()
                        if m := _RUN.search(text, floor, min(chain, floor + 2)):
                            held += reversed(cards(text, m.start(), held[-1][0] if held else min(chain, floor + 160))[1])
        elif kind == "iban":
            got = iban(text, i) if not account or i >= account[1] else None
            account = got or account
        elif kind == "colon":
            if i < seen:
                continue
            a = i
            while a > seen and text[a - 1] in _HEX:
                a -= 1
            seen, got = ipv6(text, a)
        elif kind == "@":
            got = email(text, i, 0)
        elif kind == "://":
            got = userinfo(text, i + 3)
        elif kind == "key":
            got = access_key(text, i)
        else:
            got = secret(text, i, text[i : i + size])
        if got:
            out.append(got)
    out.sort(key=lambda s: (s[0], -s[1], s[2]))
    kept: list[Span] = []
    for s in out:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def redact(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], "<", kind.upper(), ">"]
        at = b
    return "".join([*parts, text[at:]])


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parse: Callable[[str], list[Span]] = find) -> DataFrame:
    """(doc_id, kind, start, end, value) for each piece of personal data; places count characters from 0.

    A null or empty text has none.  Repeated rows give repeated findings, a null id is reported as null.
    Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, kinds, starts, ends, values = [], [], [], [], []
            for n, t in enumerate(b.column(1)):
                if (text := t.as_py()) and (found := parse(text)):
                    for a, e, k in found:
                        row.append(n)
                        kinds.append(k)
                        starts.append(a)
                        ends.append(e)
                        values.append(text[a:e])
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "kind", "start", "end", "value"])

    return columns(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, kind string, start int, end int, value string")


def redacted(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The table with <KIND> in place of personal data, and ``n_chars``, if there is such a column and
    a text changed, counted anew.  Null texts stay null; all other columns and rows stay."""
    at = docs.columns.index(text_col)
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            texts = cols[at].to_pylist()
            sizes = cols[size_at].to_pylist() if size_at is not None else None
            changed = False
            for n, t in enumerate(texts):
                if t and (found := find(t)):
                    texts[n] = redact(t, found)
                    changed = True
                    if sizes is not None:
                        sizes[n] = len(texts[n])
            if changed:
                cols[at] = pa.array(texts, cols[at].type)
                if sizes is not None:
                    cols[size_at] = pa.array(sizes, cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
