"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a single pass over each whole text:
at-signs, plus signs, digits, URL schemes and identifier cues. A deterministic
local parser then expands each anchor and validates the span: e-mail addresses
around an at-sign, dotted numbers and card-like digit runs around a digit, phone
numbers after a plus sign, addresses after a scheme, account numbers and secrets
after a cue. A parser never goes over characters again that it has matched for its
kind, whether the match became a span or failed, so the whole scan is linear.

Null text counts as empty. Offsets are code points, end exclusive. Rows are
independent and streamed in Arrow batches, so memory is bounded by a batch and
the longest text; columns other than id and text are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = KINDS[:4]

#: Schemes and cues that start a span.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "password", "passwd", "api_key", "apikey", "secret")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~:/?#@!$&'()*+,;=%\[\]-]+")
_AFTER_CUE = re.compile(r"\s{0,2}(?:no|number|nr|id|key)?\.?\s{0,2}[:=#]?\s{0,2}[\"']?")
_ACCOUNT = re.compile(r"[A-Za-z]{0,2}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]*[0-9][A-Za-z0-9]*)*")
_SECRET = re.compile(r"[A-Za-z0-9_+/=.-]+")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, cues in (("url", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text, by start and then kind."""
    out: list[tuple[str, int, int]] = []
    n = len(text)
    email_end = dotted_end = card_end = phone_end = url_end = account_end = secret_end = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last + 1 - size
        if kind == "digit":
            if at >= dotted_end:
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                parts = m.group().split(".")
                p = at
                for i in range(0, len(parts) - len(parts) % 4, 4):
                    four = parts[i:i + 4]
                    end = p + sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        out.append(("ip", p, end))
                    p = end + 1
            if at >= card_end:
                m = _CARD.match(text, at)
                card_end = m.end() if m else at + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card_end))
        elif kind == "email":
            start = at
            while start > email_end and _LOCAL.match(text[start - 1]):
                start -= 1
            m = _LABEL.match(text, at + 1) if start < at else None
            if m:
                end, labels = m.end(), 0
                while end < n and text[end] == "." and (m := _LABEL.match(text, end + 1)):
                    end, labels = m.end(), labels + 1
                if labels:
                    out.append(("email", start, end))
                    email_end = end
        elif kind == "phone":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", at, phone_end))
        elif kind == "url":
            if at >= url_end and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m.group().rstrip(".,;:!?)]'"))
                if end > last + 1:
                    out.append(("url", at, end))
                    url_end = end
        elif (at == 0 or not text[at - 1].isalpha()) and not text[last + 1:last + 2].isalpha():
            start = _AFTER_CUE.match(text, last + 1).end()
            if kind == "account":
                if start >= account_end and (m := _ACCOUNT.match(text, start)):
                    account_end = m.end()
                    if 6 <= sum(c.isdigit() for c in m.group()) <= 34:
                        out.append(("account", start, account_end))
            else:
                if start >= secret_end and (m := _SECRET.match(text, start)):
                    secret_end = m.end()
                    if len(m.group()) >= 12 and any(c.isdigit() for c in m.group()):
                        out.append(("secret", start, secret_end))
    rank = KINDS.index
    return sorted(out, key=lambda s: (s[1], rank(s[0]), s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "")] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], ["id", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _batches, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with every span replaced by ``[kind]``; a span inside or across an
    earlier one is merged into it."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
