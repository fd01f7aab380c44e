"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, plus signs, digits and cue words.  A small parser
per kind then expands the place to its bounds and validates it.  Emails, IPv4 addresses, cards and phones are
found exactly as a leftmost non-overlapping search with these patterns would (places that fail validation are
dropped and not tried again):

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                      16 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                8 to 15 digits

Other kinds are added by cues: words that say what follows (``IBAN number: ...``, ``api_key = "..."``), of any case,
whole words only, and beginnings that say what they are themselves (``AKIA...``, ``-----BEGIN ... PRIVATE KEY-----``).
Between a cue and its value may stand a few linking words and signs.

    iban         as long as its country says, remainder 97
    ssn          ddd-dd-dddd or ddd dd dddd, no area 000, 666 or 9.., no group 00, no serial 0000
    passport     6 to 9 letters and digits, a digit at least
    account      6 to 17 digits, in groups or not
    routing      9 digits with their check digit
    secret       after key, token, secret, password: 8 and more signs without blanks, letters and digits mixed
                 or in quotation marks; keys that are known by their beginning; JSON web tokens; private keys
    ipv6         two and more groups of hex digits that the address rules allow
    url          with user and password in front of its host
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from ipaddress import AddressValueError, IPv6Address

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "passport", "account", "routing", "secret", "ipv6", "url")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | _DIGITS
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | {"-"}
_DIALLED = _DIGITS | frozenset(" ().-")
# Characters of an IBAN by country, as the IBAN registry has them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: What may stand between a cue and its value.
_LINK = re.compile(r"(?:[\s\"'=:#>.,()-]{0,4}(?:numbers?|num|no|nr|nummer|code|id|is|are|was)\b){0,3}[\s\"'`=:#>.,(-]{0,6}", re.I)
_SPACED = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([- ]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9]|-[0-9])")
_PASSPORT = re.compile(r"(?=[A-Z]{0,8}[0-9])[A-Z0-9]{6,9}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9]|[ -][0-9])")
_ROUTING = re.compile(r"[0-9]{9}(?![0-9])")
#: Only an assignment makes a secret of what follows a cue.
_ASSIGNED = re.compile(r"[\"'`\])]{0,2}\s{0,3}(?:=>|:=|[=:]|\bis\b)\s{0,3}")
_QUOTED = re.compile(r"([\"'`])([!-~]{8,512}?)\1")
_BARE = re.compile(r"[A-Za-z0-9!#$%&*+./:=?@^_~-]{8,512}")
# Beginnings of keys that their issuers document, and what follows them.
_KNOWN = {
    "AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "ghp_": "[A-Za-z0-9]{36,}", "gho_": "[A-Za-z0-9]{36,}", "ghs_": "[A-Za-z0-9]{36,}", "github_pat_": "[A-Za-z0-9_]{50,}", "glpat-": "[A-Za-z0-9_-]{20,}",
    "sk_live_": "[A-Za-z0-9]{16,}", "rk_live_": "[A-Za-z0-9]{16,}", "sk-": "[A-Za-z0-9_-]{32,}", "xoxb-": "[A-Za-z0-9-]{20,}", "xoxp-": "[A-Za-z0-9-]{20,}", "AIza": "[A-Za-z0-9_-]{35}",
    "npm_": "[A-Za-z0-9]{36}", "hf_": "[A-Za-z0-9]{30,}", "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
_KNOWN_AT = {k: re.compile(f"(?:{v})(?![A-Za-z0-9])") for k, v in _KNOWN.items()}
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[\sA-Za-z0-9+/=]|\\n)*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")
_HEX6 = re.compile(r"[0-9A-Fa-f:]*:(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]*)")
#: Kind by cue.
CUES = {
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "social-security": "ssn", "passport": "passport", "account": "account", "acct": "account", "a/c": "account",
    "routing": "routing", "aba": "routing", "password": "secret", "passwd": "secret", "pwd": "secret", "passphrase": "secret", "secret": "secret", "token": "secret", "api key": "secret",
    "api_key": "secret", "api-key": "secret", "apikey": "secret", "access_key": "secret", "access key": "secret", "private_key": "secret", "secret_key": "secret", "client_secret": "secret",
}
_USERINFO = re.compile(r"[A-Za-z0-9._~%-]+:[^\s/@:?#]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
_NAME = _ALNUM | {"_", "-"}
_HEXES = _DIGITS | frozenset("abcdefABCDEF:")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for anchor, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789"), ("-----BEGIN ", "pem"), ("::", "colons"), *((k, "known") for k in _KNOWN)]:
        a.add_word(anchor, (kind, anchor))
    for cue in CUES:
        for written in {cue, cue.upper(), cue.title(), cue.capitalize(), " ".join([cue.split()[0].upper(), *cue.split()[1:]])}:
            a.add_word(written, ("cue", cue))
    for h in "0123456789abcdefABCDEF":  # a group of an address and its colon
        a.add_word(f"{h}:", ("colons", ":"))
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email(text: str, at: int, least: int) -> tuple[int, int] | None:
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while text[end : end + 1] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else None


def ip(text: str, start: int) -> tuple[int, bool, bool]:
    """End, whether there are four parts, whether they are valid."""
    end = first = _run(text, start, _DIGITS)
    parts = [text[start:end]]
    while len(parts) < 4 and text[end : end + 1] == "." and (more := _run(text, end + 1, _DIGITS)) > end + 1:
        parts.append(text[end + 1 : more])
        end = more
    if len(parts) < 4:
        return first, False, False
    return end, True, all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in parts)


def card(text: str, start: int) -> tuple[int, bool]:
    end, n = start + 1, len(text)
    while end < n:
        if text[end] in _DIGITS:
            end += 1
        elif text[end] in " -" and text[end + 1 : end + 2] in _DIGITS and end + 1 < n:
            end += 2
        else:
            break
    digits = [int(c) for c in text[start:end] if c in _DIGITS] if end - start < 40 else []
    if not 16 <= len(digits) <= 19:
        return end, False
    doubled = [2 * d - 9 * (d > 4) for d in digits[-2::-2]]
    return end, (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def phone(text: str, at: int) -> tuple[int, bool] | None:
    if text[at + 1 : at + 2] not in _DIGITS or at + 1 >= len(text):
        return None
    last = _run(text, at + 2, _DIALLED) - 1
    while last >= at + 3 and text[last] not in _DIGITS:
        last -= 1
    if last < at + 3:
        return None
    return last + 1, 8 <= sum(c in _DIGITS for c in text[at : last + 1]) <= 15


def iban_valid(s: str) -> bool:
    s = re.sub("[ -]", "", s).upper()
    return len(s) == IBAN_LENGTHS.get(s[:2]) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban(text: str, at: int) -> tuple[int, int] | None:
    m = _SPACED.match(text, at)
    left = IBAN_LENGTHS.get(text[at : at + 2].upper(), 0) if m else 0
    if not left:
        return None
    end = at
    while left and end < m.end():
        left -= text[end] not in " -"
        end += 1
    return (at, end) if not left and text[end : end + 1] not in _ALNUM and iban_valid(text[at:end]) else None


def _shaped(pattern: re.Pattern, valid: Callable[[str], bool] = lambda s: True):
    def parse(text: str, at: int) -> tuple[int, int] | None:
        m = pattern.match(text, at)
        return m.span() if m and valid(m[0]) else None

    return parse


def routing_valid(s: str) -> bool:
    d = [int(c) for c in s]
    return any(d) and (3 * sum(d[::3]) + 7 * sum(d[1::3]) + sum(d[2::3])) % 10 == 0


_VALUES = {"iban": _iban, "ssn": _shaped(_SSN), "passport": _shaped(_PASSPORT), "account": _shaped(_ACCOUNT), "routing": _shaped(_ROUTING, routing_valid)}


def secret(text: str, at: int) -> tuple[int, int] | None:
    """The value that is assigned to what ends at ``at``."""
    tail = at + _run(text[at : at + 25], 0, _NAME)  # the rest of a name: token_v2, secretKey
    if tail - at > 24 or not (m := _ASSIGNED.match(text, tail)):
        return None
    if q := _QUOTED.match(text, m.end()):
        return q.span(2)
    if not (bare := _BARE.match(text, m.end())):
        return None
    value = bare[0].rstrip(".:?!")  # those are the sentence's
    mixed = any(c in _DIGITS for c in value) and not all(c in _DIGITS or c not in _ALNUM for c in value)
    return (bare.start(), bare.start() + len(value)) if len(value) >= 8 and mixed else None


def ipv6(text: str, at: int, least: int) -> tuple[int, int, bool]:
    """Bounds of the run that has colons in front of ``at``, and whether it is an address (with a digit, of some length)."""
    start = at
    while start > least and text[start - 1] in _HEXES:
        start -= 1
    m = _HEX6.match(text, start)
    end = m.end() if m else at
    if text[end - 1] == ":" and text[end - 2 : end] != "::":  # the sentence's
        end -= 1
    s = text[start:end]
    valid = 6 <= len(s) <= 45 and s.count(":") > 1 and not _DIGITS.isdisjoint(s) and not (start and text[start - 1] in _ALNUM) and text[end : end + 1] not in _ALNUM
    try:
        return start, max(end, at), valid and bool(IPv6Address(s))
    except AddressValueError:
        return start, max(end, at), False


def spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans, by kind as listed, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_from = ip_from = card_from = phone_from = url_from = six_from = 0
    until = dict.fromkeys(KINDS, 0)
    for end, (kind, anchor) in automaton.iter(text):
        if kind == "digit":
            if end >= ip_from:
                ip_from, four, valid = ip(text, end)
                if valid:
                    found["ip"].append((end, ip_from))
            if end >= card_from:
                card_from, valid = card(text, end)
                if valid:
                    found["card"].append((end, card_from))
        elif kind == "at":
            if end >= email_from and (got := email(text, end, email_from)):
                found["email"].append(got)
                email_from = got[1]
        elif kind == "plus":
            if end >= phone_from and (got := phone(text, end)):
                phone_from, valid = got
                if valid:
                    found["phone"].append((end, phone_from))
        elif kind == "scheme":
            if end >= url_from and (m := _USERINFO.match(text, end + 1)):
                start = end - 2
                while start > url_from and text[start - 1] in _SCHEME:
                    start -= 1
                if start < end - 2:
                    found["url"].append((start, m.end()))
                    url_from = m.end()
        elif kind == "colons":
            if end >= six_from:
                start, six_from, valid = ipv6(text, end + 1, six_from)
                if valid:
                    found["ipv6"].append((start, six_from))
        else:
            got, what = None, CUES.get(anchor, "secret")
            begin = end + 1 - len(anchor)
            if kind == "pem":
                m = _PEM.match(text, begin)
                got = m and m.span()
            elif kind == "known":
                if not begin or text[begin - 1] not in _ALNUM:
                    m = _KNOWN_AT[anchor].match(text, end + 1)
                    got = m and (begin, m.end())
            elif what == "secret":
                got = secret(text, end + 1)
            elif (not begin or text[begin - 1] not in _ALNUM) and text[end + 1 : end + 2] not in _ALNUM:
                got = _VALUES[what](text, _LINK.match(text, end + 1).end())
            # a value after two cues is one
            if got and got[0] >= until[what]:
                found[what].append(got)
                until[what] = got[1]
    return [(k, a, b) for k, at in found.items() for a, b in at]


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in batches:
        out = []
        for value in batch.column(1):
            text = value.as_py() or ""
            out.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for k, a, b in spans(text, automaton)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _TYPE)], ["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, text), ordered by kind as in ``KINDS``, then start.

    A null or empty text has none; a very long one is read whole, in time that grows with its length.  Null ids pass through, repeated rows are searched alike, an empty table
    gives an empty result, other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,text:string>>")
