"""Personal data by anchors: one Aho-Corasick pass finds cues, local parsers expand and validate.

Every kind of datum has a cue that the automaton knows: the at-sign, a plus
before a digit, a digit before a digit, blank, hyphen or dot, a scheme, an
identifier word, the first characters of a service's keys.  A parser looks at
the text around a cue only, so texts without cues cost one pass of the
automaton.  Email, ip, card and phone give the leftmost, not overlapping
matches of fixed patterns; urls, accounts and keys are what the cues add.
Cues are found in any case; identifier words may be part of a compound name,
and a value has to pass the check of its sort.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns that the base kinds are defined by.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
KINDS = ("email", "ip", "card", "phone", "url", "account", "key")

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
#: Behind a scheme: a user before an at-sign, which alone makes a url personal.
USER_URL = re.compile(r"[A-Za-z0-9._%+-]+(:[^\s@/]*)?@[A-Za-z0-9.-]+(:[0-9]+)?(/\S*)?")

# Identifier words by the sort of value that they lead to; case doesn't matter, and a blank may be "_", "-" or nothing.
WORDS = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "routing": ("routing", "aba"),
    "number": ("account", "acct", "passport", "driver license", "drivers license", "driving licence", "tax id", "taxpayer id", "customer id", "member id", "policy"),
    "secret": ("password", "passwd", "passphrase", "pwd", "secret", "token", "api key", "access key", "secret key", "private key", "access token", "auth token", "refresh token", "client secret"),
    "bearer": ("bearer",),
}
#: What leads from an identifier word to its value: a sign of assignment, or "is".
LEAD = re.compile(r"""["']?[\s_-]{0,2}(?:number|no\.?|nr\.?|code|value)?["']?\s{0,2}(?:[:=#]>?\s{0,2}|->\s{0,2}|\bis:?\s{1,2})["'`]?""", re.IGNORECASE)
BLANK = re.compile(r"\s{1,2}[\"']?")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
SSN = re.compile(r"([0-9]{3})[ -]?([0-9]{2})[ -]?([0-9]{4})(?![0-9])")
ROUTING = re.compile(r"[0-9]{9}(?![0-9])")
#: Plain values reach as far as their characters do.
VALUE = {
    "number": re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/=.~-]*"),
    "secret": re.compile(r"[^\s\"'`<>,;()\[\]{}$%][^\s\"'`<>,;()\[\]{}]*"),
    "bearer": re.compile(r"[A-Za-z0-9_+/=.~-]{16,}"),
}

# How keys of public services and web tokens begin, in lower case, and their form.
KEYS = {
    "akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "asia": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "aiza": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "github_pat_": re.compile(r"github_pat_[0-9A-Za-z_]{20,}"),
    "glpat-": re.compile(r"glpat-[0-9A-Za-z_-]{20,}"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{10,}"),
    "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{10,}"),
    "sk_live_": re.compile(r"sk_live_[0-9A-Za-z]{16,}"),
    "sk_test_": re.compile(r"sk_test_[0-9A-Za-z]{16,}"),
    "rk_live_": re.compile(r"rk_live_[0-9A-Za-z]{16,}"),
    "eyj": re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(value: str) -> bool:
    s = re.sub("[ -]", "", value).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def octet(part: str) -> bool:
    """At most 255, however many digits there are."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def social(area: str, group: str, serial: str) -> bool:
    """Areas 000, 666 and from 900, group 00 and serial 0000 are never given out."""
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def routing(number: str) -> bool:
    return number != "0" * 9 and sum(int(c) * w for c, w in zip(number, (3, 7, 1) * 3, strict=True)) % 10 == 0


def secretive(value: str) -> bool:
    """Three digits in six characters, or all of small and capital letter, digit and sign in eight; so with any longer value too."""
    if len(value) >= 6 and sum(map(value.count, DIGITS)) >= 3:
        return True
    return len(value) >= 8 and all(re.search(c, value) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[!@#$%^&*?+~]"))


def forms(word: str) -> set[str]:
    return {word.replace(" ", by) for by in ("", " ", "_", "-")}


def automaton():
    """Of all cues in lower case, with how far before its last character a cue begins, its kind, and its sort or first characters."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word("+" + d, (1, "phone", ""))
        for e in "0123456789 -.":
            a.add_word(d + e, (1, "number", ""))
    a.add_word("@", (0, "email", ""))
    for s in SCHEMES:
        a.add_word(s, (len(s) - 1, "url", s))
    for k in KEYS:
        a.add_word(k, (len(k) - 1, "key", k))
    for sort, words in WORDS.items():
        for form in set().union(*map(forms, words)):
            a.add_word(form, (len(form) - 1, "account", sort))
    a.make_automaton()
    return a


def apart(text: str, at: int, last: int) -> bool:
    """Is text[at : last + 1] a word, or one word of a name such as my_api_key or myApiKey?"""
    before, after = text[at - 1] if at else " ", text[last + 1] if last + 1 < len(text) else " "
    return (not before.isalnum() or before.islower() and text[at].isupper()) and (not after.isalnum() or text[last].islower() and after.isupper())


def account(sort: str, text: str, end: int, dead: dict) -> tuple[int, int] | None:
    """Begin and end of the value of that sort behind an identifier word that ends at `end`, if it is one.

    A plain value that begins before `dead` of its sort ends a longer one that
    was refused, and so would be refused itself.
    """
    lead = (BLANK if sort == "bearer" else LEAD).match(text, end)
    if not lead:
        return None
    begin = lead.end()
    if sort == "iban":
        m = IBAN.match(text, begin)
        ends = [m.end(), *(m.start() + k for k in range(len(m[0]) - 1, 14, -1) if m[0][k] in " -")] if m else []
        good = next((e for e in ends if iban(text[begin:e])), None)
        return (begin, good) if good else None
    if sort == "ssn":
        m = SSN.match(text, begin)
        return m.span() if m and social(*m.groups()) else None
    if sort == "routing":
        m = ROUTING.match(text, begin)
        return m.span() if m and routing(m[0]) else None
    if begin < dead.get(sort, 0) or not (m := VALUE[sort].match(text, begin)):
        return None
    value = m[0].rstrip("=.~-:?!" if sort == "secret" else "=.~-")
    if secretive(value):
        return begin, begin + len(value)
    dead[sort] = m.end()
    return None


def find(text: str, a) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base kinds, and those with the added kinds too, both sorted."""
    base, added = [], []
    email = ip = card = phone = other = 0  # where the last match of a kind ends; phone, ip, card: also what was tried
    dead: dict = {}
    folded = text.lower()
    for last, (back, kind, sort) in a.iter(folded if len(folded) == len(text) else text.translate(LOWER)):  # a capital may be longer in lower case
        at = last - back
        if kind == "number":
            before = text[at - 1] if at else ""
            if at >= ip and before not in DIGITS:
                if (m := IP.match(text, at)) and all(map(octet, m[0].split("."))):
                    base.append((at, 1, m.end()))
                ip = m.end() if m else ip
            if at >= card:
                m = CARD.match(text, at)
                if m:
                    card = m.end()
                    digits = re.sub("[ -]", "", m[0])
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        base.append((at, 2, m.end()))
        elif kind == "phone":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    base.append((at, 3, m.end()))
        elif kind == "email":
            begin = at
            while begin > email and text[begin - 1] in LOCAL:
                begin -= 1
            if begin < at and at >= email and (m := DOMAIN.match(text, at + 1)):
                base.append((begin, 0, m.end()))
                email = m.end()
        elif kind == "url":
            begin = last + 1
            if begin >= other and (m := USER_URL.match(text, begin)):
                added.append((at, 4, m.end()))
                other = m.end()
        elif kind == "key":
            if at >= other and not (at and (text[at - 1].isalnum() or text[at - 1] in "_-")) and (m := KEYS[sort].match(text, at)):
                added.append((at, 6, m.end()))
                other = m.end()
        elif at >= other and apart(text, at, last) and (found := account(sort, text, last + 1, dead)):
            added.append((found[0], 5, found[1]))
            other = found[1]
    base.sort()
    return base, sorted(base + added)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, marks.

    spans: kind:start:end by start, then kind, comma-joined; code points, end
    exclusive.  marks: the same as structs.  Null and empty texts have none;
    repeated rows stay; an empty table gives no rows; a null id stays null;
    columns other than the two are not read, so their names don't matter.  Texts
    and runs of digits may be of any length: every parser moves on from where it
    stopped.  Of cues that end at one place the longest is tried first (ties);
    added kinds don't overlap each other, but may lie over base ones.
    """
    mark = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("until", pa.int32())]))

    def run(batches):
        a = automaton()
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts, sha, spans, marks = [[], [], [], []], [], [], []
            for t in batch.column(1):
                base, every = find(t.as_py() or "", a)
                joined = ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in base)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(joined.encode()).hexdigest() if base else empty)
                spans.append(",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in every) if len(every) > len(base) else joined)
                marks.append([{"kind": KINDS[k], "begin": b, "until": e} for b, k, e in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(marks, mark)], ["id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "marks"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, marks array<struct<kind:string,begin:int,until:int>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str, marks: list) -> str:
    """The text with each run of marked characters replaced by <kind>, the first mark's kind."""
    out, at = [], 0
    for m in sorted(marks, key=lambda m: (m["begin"], -m["until"])):
        if m["begin"] >= at:
            out += [text[at : m["begin"]], f"<{m['kind']}>"]
        at = max(at, m["until"])
    return "".join(out) + text[at:]
