"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before digits, digits beside digits or
dots, schemes, kinds of streets, and cues of identifiers. A parser for each kind expands an anchor to the borders of what
it may belong to and validates it. All parsers are linear in the text and never look at a stretch twice.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` follow fixed grammars (leftmost, non-overlapping, failing
matches dropped without retries). Added kinds: ``iban`` (country code, check digits, the country's length and mod
97; a token of its own unless a cue came before in the text, from where on codes without a known length count,
too), ``login`` (user and password before the host of a URL, or a mailto address), ``secret`` (an access key id,
or the value after password=, token = and the like), ``account`` (digits behind cues of account numbers and sort codes),
``national`` (social security numbers behind their cues, impossible ones left out), ``address`` (house number, names and
kind of a street, town and postal code).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from string import ascii_uppercase

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import bounded_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "login", "secret", "account", "national", "address")
ACCOUNT_CUES = ("account", "acct", "a/c", "konto", "kontonummer", "compte", "cuenta")
SORT_CUES = ("sort code", "bank code", "routing number")
NATIONAL_CUES = ("ssn", "social security", "social security number")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Ct", "Square", "Terrace", "Way", "Place")
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
#: Characters of an account number by country.
IBAN_LENGTHS = {
    code: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"[A-Za-z0-9._%+-]++:[^\s@/:]++@(?=[A-Za-z0-9])")
_VALUE = re.compile(r"\s?[=:]\s?[\"']?([A-Za-z0-9_/+.~-]{8,}+)[\"']?")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_ACCOUNT = re.compile(r"(?:\s?(?:number|num|no|nr)\b\.?)?(?:\s(?:is|was))?\s?[:#=]?\s?([0-9](?:[ -]?[0-9]){5,16}+)(?![A-Za-z0-9])", re.I)
_SORT = re.compile(r"\s?[:#=]?\s?([0-9]{2}[ -][0-9]{2}[ -][0-9]{2}|[0-9]{6})(?![A-Za-z0-9-])")
_SSN = re.compile(r"(?:\s?(?:number|no)\b\.?)?(?:\s(?:is|was))?\s?[:#=]?\s?([0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4})(?![A-Za-z0-9-])", re.I)
#: Years, pairs of them and dates, which aren't account numbers.
_DATES = re.compile(r"(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ -](?:0[1-9]|1[0-2])[ -](?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[ -](?:0[1-9]|1[0-2])[ -](?:19|20)[0-9]{2}")
#: Bits a character that a secret has at least, by how often it has each.
SECRET_BITS = 2.0
#: Behind the kind of a street: an optional unit, a town, and a postal code, which validates the address.
_TOWN = r"(?:[ ,]{1,2}(?:Apt|Suite|Unit|Floor)\.? ?[A-Za-z0-9-]{1,6})?,\s(?:[A-Z][A-Za-z.'-]++ ?){1,4}"
_PLACE = re.compile(rf"\.?{_TOWN}(?:,?\s?[A-Z]{{2}} [0-9]{{5}}(?:-[0-9]{{4}})?|,?\s?[A-Z]{{1,2}}[0-9][0-9A-Z]? [0-9][A-Z]{{2}})(?![A-Za-z0-9])")


def _secret(value: str) -> bool:
    """Whether a value behind a cue is like a key or a password and not a word of the sentence: letters with digits, or capitals among small letters, and varied."""
    if _DATES.fullmatch(value):
        return False
    digits, letters = any(map(str.isdigit, value)), any(map(str.isalpha, value))
    mixed = any(c.isupper() for c in value[1:]) and any(map(str.islower, value))
    if not (digits and letters or mixed or (digits and len(value) >= 16)):
        return False
    shares = [value.count(c) / len(value) for c in set(value)]  # of some seventy characters at most
    return -sum(p * math.log2(p) for p in shares) >= SECRET_BITS


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    words: dict[str, list[str]] = {"@": ["email"]}
    for d in "0123456789":
        words.setdefault(f"+{d}", []).append("phone")
        words.setdefault(f"{d}.", []).append("ip")
        for e in "0123456789":
            for gap in ("", " ", "-"):
                words.setdefault(d + gap + e, []).append("card")
    for scheme in ("://", "mailto:"):
        words.setdefault(scheme, []).append("login")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            words.setdefault(form, []).append("secret")
    for cue in ("AKIA", "ASIA"):
        words.setdefault(cue, []).append("key")
    for kind, cues in (("account", ACCOUNT_CUES), ("sort", SORT_CUES), ("national", NATIONAL_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                words.setdefault(form, []).append(kind)
    for street in STREETS:
        words.setdefault(f" {street}", []).append("street")
    for cue in ("IBAN", "iban", "Iban"):
        words.setdefault(cue, []).append("cue")
    for a1 in ascii_uppercase:
        for a2 in ascii_uppercase:
            for d in "0123456789":
                words.setdefault(a1 + a2 + d, []).append("iban")
    for w, kinds in words.items():
        a.add_word(w, (len(w), kinds[0]))
    a.make_automaton()
    return a


def _left(text: str, at: int, least: int) -> int:
    while at > least and _LOCAL.match(text, at - 1):
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _iban(found: str) -> bool:
    s = found.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@lru_cache(maxsize=64)
def _iban_of(length: int) -> re.Pattern:
    return re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}")


def _iban_end(text: str, at: int, cued: bool) -> int:
    """End of the account number that begins at a country code, 0 if there is none."""
    if not cued and at and _ALNUM.match(text, at - 1):
        return 0
    if length := IBAN_LENGTHS.get(text[at : at + 2]):
        m = _iban_of(length).match(text, at)
        return m.end() if m and _iban(m[0]) and (cued or not _ALNUM.match(text, m.end())) else 0
    m = _IBAN.match(text, at) if cued else None
    if m:  # of unknown length: the longest that holds and ends with its run or a group of it
        for end in range(m.end(), at + 14, -1):
            if (end == m.end() or text[end] == " ") and _iban(text[at:end]):
                return end
    return 0


def _street_start(text: str, at: int, least: int) -> int:
    """Where an address whose street's kind stands at ``at`` begins: a house number before one to four capitalised names; -1 if it doesn't."""
    k = at
    for names in range(5):
        start = k
        while start > least and text[start - 1] not in " \n\t":
            start -= 1
        word = text[start:k]
        if names and word.rstrip("abcdABCD").isdecimal() and len(word) <= 6:
            return start
        if not word or not word[0].isupper() or not word.replace("'", "").replace(".", "").replace("-", "").isalpha() or not start or text[start - 1] != " ":
            return -1
        k = start - 1
    return -1


def _national(found: str) -> bool:
    s = found.replace(" ", "").replace("-", "")
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points of each kind, ascending; null and empty texts have none."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    done = dict.fromkeys(KINDS, 0)  # up to where each kind has looked
    cued = False  # whether a cue of account numbers came before
    for last, (size, kind) in _anchors().iter(text):
        at = last - size + 1
        if kind == "email":
            start = _left(text, at, done["email"])
            m = start < at and _DOMAIN.match(text, at + 1)
            if m:
                out["email"].append((start, m.end()))
            done["email"] = m.end() if m else at + 1
        elif kind == "ip":
            if at < done["ip"]:
                continue
            start = at
            while start > done["ip"] and "0" <= text[start - 1] <= "9":
                start -= 1
            m = _IP.match(text, start)
            if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out["ip"].append((start, m.end()))
            done["ip"] = m.end() if m else last
        elif kind == "card":
            if at < done["card"]:
                continue
            m = _CHAIN.match(text, at)
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        elif kind == "phone":
            m = _PHONE.match(text, at)
            if m and (end := at + len(m[0].rstrip(" ().-"))) >= at + 4 and 8 <= sum(c.isdigit() for c in text[at:end]) <= 15:
                out["phone"].append((at, end))
        elif kind == "login":
            if at < done["login"]:
                continue
            mail = size > 3
            m = (_MAIL if mail else _LOGIN).match(text, last + 1)
            if m:
                end = m.end() - (not mail)
                out["login"].append((last + 1, end))
                done["login"] = end
        elif kind == "secret":
            m = _VALUE.match(text, last + 1)
            if m and m.start(1) >= done["secret"] and _secret(m[1]):
                out["secret"].append(m.span(1))
                done["secret"] = m.end(1)
        elif kind == "key":
            m = _KEY.match(text, at)
            if m and at >= done["secret"] and (at == 0 or not text[at - 1].isalnum()):
                out["secret"].append(m.span())
                done["secret"] = m.end()
        elif kind in ("account", "sort", "national"):
            into = "national" if kind == "national" else "account"
            if at and _ALNUM.match(text, at - 1):
                continue
            m = {"account": _ACCOUNT, "sort": _SORT, "national": _SSN}[kind].match(text, last + 1)
            if m and m.start(1) >= done[into] and (_national(m[1]) if kind == "national" else not _DATES.fullmatch(m[1])):
                out[into].append(m.span(1))
                done[into] = m.end(1)
        elif kind == "street":
            if at < done["address"] or (last + 1 < len(text) and _ALNUM.match(text, last + 1)):
                continue
            start = _street_start(text, at, done["address"])
            m = _PLACE.match(text, last + 1) if start >= 0 else None
            if m:
                out["address"].append((start, m.end()))
                done["address"] = m.end()
        elif kind == "cue":
            cued, done["iban"] = True, max(done["iban"], last + 1)
        elif at >= done["iban"] and (end := _iban_end(text, at, cued)):
            out["iban"].append((at, end))
            done["iban"] = end
    return out


def mask(text: str | None) -> str | None:
    """The text with every span, overlapping ones merged, replaced by its first kind's name in brackets."""
    if not text:
        return text
    spans = sorted((s, e, k) for k, found in find_spans(text).items() for s, e in found)
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with personal data in ``text`` masked; texts without any stay as they are.

    Null texts stay null, empty ones empty; repeated rows are masked alike; an empty frame stays empty.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index("text")
            masked = pa.array(map(mask, b.column(k).to_pylist()), pa.string())
            yield b.set_column(k, "text", masked)

    return docs.mapInArrow(run, docs.schema)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row of ``docs`` (doc_id, text); other columns are ignored.

    Null and empty texts have no spans; rows are answered one by one, so null ids and repeated rows stay.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, found in find_spans(t).items() for s, e in found]
                for t in b.column("text").to_pylist()
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each row of ``documents``; null and empty texts have none, repeated rows have the same, an empty table gives no rows."""
    found = pii_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.encode(said(of(*BASE)), "UTF-8"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )
