"""Personal data by anchor expansion: an Aho-Corasick pass finds cues, local parsers expand and validate them.

One automaton holds every cue: the at-sign, URL schemes, the plus sign, digits, identifier words, and the signs of an
assignment. A cue's parser looks only at the characters around it, so the work is linear in the text even where a backtracking
pattern would be quadratic. Base kinds follow fixed patterns (leftmost, non-overlapping per kind; a match that
fails its check is dropped without a retry): email, ip, card, phone. The method adds: url (scheme cue) and
account (identifier cue followed by a separator and a value; an IBAN, also in groups of four, must pass its mod-97
check; the value of an assignment whose name speaks of a key, secret, token or password, or that is long and mixed
enough to be one whatever its name). A value is taken whole, however long.

Defined cases: null text reads as empty; every row gives a row, repeated rows and null ids included; ties in the
span order go by kind as listed; an empty table gives an empty result; further columns are never read.
No shuffle: documents are scored where they are read, one text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: order of kinds in span lists
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account"]
#: fixed values: cue strings
SCHEMES = ["http://", "https://", "ftp://"]
IDENTIFIERS = ["iban", "account", "passport", "ssn", "token", "api_key"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE_TAIL = re.compile(r"[ ().0-9-]+")
_URL_TAIL = re.compile(r"[^\s<>\"']+")
_VALUE = re.compile(r"\s{0,3}(?:[:=#]|no\.?|is)?\s{0,3}[\"']?([A-Za-z0-9][A-Za-z0-9_.-]*)")
_IBAN_VALUE = re.compile(r"\s{0,3}(?:[:=#]|no\.?|is)?\s{0,3}[\"']?([A-Z]{2}[0-9]{2}(?: [A-Z0-9]{1,4}){2,8})")
_ASSIGNED = re.compile(r"[ \t]{0,3}[\"']?([A-Za-z0-9_+/~][A-Za-z0-9_.+/=~!@#$%^&*-]*)")
#: names of secrets, and how long and mixed a value under another name must be
_SECRET_NAME = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer", re.I)
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
SECRET_LENGTH, NAMED_LENGTH = 24, 6


def cue_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    cues = [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789"),
            ("=", "assign"), (":", "assign"), *((s, "scheme") for s in SCHEMES), *((w, "identifier") for x in IDENTIFIERS for w in (x, x.upper(), x.capitalize()))]
    for cue, kind in cues:
        auto.add_word(cue, (kind, len(cue)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace("-", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, cue: str, last: int) -> tuple[int, int] | None:
    """The value after an identifier word."""
    if cue == "iban" and (value := _IBAN_VALUE.match(text, last + 1)):
        groups = value[1].split(" ")      # a following word may look like one more group
        for n in range(len(groups), 2, -1):
            whole = " ".join(groups[:n])
            if iban(whole.replace(" ", "")):
                return value.start(1), value.start(1) + len(whole)
    value = _VALUE.match(text, last + 1)
    token = value[1].rstrip("-._") if value else ""
    if len(token) >= 5 and (iban(token) if cue == "iban" else sum("0" <= c <= "9" for c in token) >= 4):
        return value.start(1), value.start(1) + len(token)
    return None


def _secret(text: str, at: int) -> tuple[int, int, bool] | None:
    """The value of an assignment, and whether its name or its look says that it is a secret."""
    stop = at
    while stop > 0 and at - stop < 3 and text[stop - 1] in " \t\"'":
        stop -= 1
    start = stop
    while start > 0 and text[start - 1] in _NAME:
        start -= 1
    value = start < stop and _ASSIGNED.match(text, at + 1)
    if not value:
        return None
    token = value[1].rstrip(".-!*&")
    digits, letters = sum("0" <= c <= "9" for c in token), sum(c.isalpha() for c in token)
    named = len(token) >= NAMED_LENGTH and (digits or len(token) > digits + letters) and _SECRET_NAME.search(text, start, stop)
    looks = len(token) >= SECRET_LENGTH and digits >= 6 and letters >= 6
    return value.start(1), value.start(1) + len(token), bool(named or looks)


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    domain = start < at and _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    if not ("0" <= text[at + 1: at + 2] <= "9"):
        return None
    tail = _PHONE_TAIL.match(text, at + 2)
    if not tail:
        return None
    end = tail.end()
    while end > at + 3 and not "0" <= text[end - 1] <= "9":
        end -= 1
    return (at, end) if end > at + 3 else None


def _numbers(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """ip and card spans from the digit runs of a text (both made of whole runs)."""
    i = 0
    while i + 3 < len(runs):
        four = runs[i: i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:])):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (text[a:b].lstrip("0") for a, b in four)):
                yield "ip", four[0][0], four[3][1]
            i += 4
        else:
            i += 1
    done = -1
    for a, _ in runs:
        if a >= done:
            done = _CHAIN.match(text, a).end()
            digits = text[a:done].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", a, done


def find_spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All (kind, start, end) of a text, by start, then kind."""
    found: list[tuple[str, int, int]] = []
    end = dict.fromkeys(KINDS, 0)
    runs: list[tuple[int, int]] = []
    seen = 0

    def put(kind: str, span: tuple[int, int] | None, keep: bool = True) -> None:
        if span:
            end[kind] = span[1]
            if keep:
                found.append((kind, *span))

    for last, (cue, size) in auto.iter(text):
        at = last - size + 1
        if cue == "digit":
            if not runs or at >= runs[-1][1]:
                runs.append(_DIGITS.match(text, at).span())
        elif cue == "at":
            put("email", _email(text, at, end["email"]))
        elif cue == "plus":
            if at >= end["phone"] and (span := _phone(text, at)):
                put("phone", span, 9 <= sum("0" <= c <= "9" for c in text[span[0]: span[1]]) <= 15)
        elif cue == "scheme":
            if at >= end["url"] and (tail := _URL_TAIL.match(text, last + 1)):
                stop = last + 1 + len(tail[0].rstrip(".,;:!?)]}"))
                put("url", (at, stop) if stop > last + 1 else None)
        elif cue == "assign":
            if at >= max(end["account"], end["url"], end["email"], seen) and (value := _secret(text, at)):
                seen = value[1]     # no run is looked at twice
                if value[2]:
                    put("account", value[:2])
        elif at >= end["account"] and not text[at - 1: at].isalnum():
            put("account", _account(text, text[at: last + 1].lower(), last))
    if len(runs):
        found += _numbers(text, runs)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): one row per row of ``docs``; code points, end exclusive."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = cue_automaton()
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end"), s)) for s in find_spans(t, auto)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")



def op2(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda keep: F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(joined(lambda s: s["kind"].isin(*BASE)), 256).alias("base_sha256"),
                        joined(lambda s: F.lit(True)).alias("spans"))
