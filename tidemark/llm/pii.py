"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, ``://`` schemes and identifier cues
("account", "iban", "ssn", ...). From each anchor a deterministic local parser grows the span to its
boundaries and validates it: e-mail addresses grow both ways from the at-sign, URLs with credentials
grow from the scheme, accounts grow right from their cue and are checked (IBAN by mod 97). Numeric
kinds that carry no cue (ip, card, phone) are grown from the first digit or plus sign of each run.
Every parser is linear in the text it looks at.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import ship_package

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the anchors find; they follow the listed kinds in the span list.
MORE_KINDS = ("account", "login_url")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starts of digit runs only: a match that began inside a run would have begun at its start
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ACCOUNT = re.compile(r"[\s:#=\".-]{0,4}(?:no|nr|num|number)?[\s:#=\".]{0,4}([A-Za-z]{0,2}[0-9][0-9A-Za-z -]{4,38})", re.ASCII | re.IGNORECASE)
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[^\s/?#\"'<>]+", re.ASCII)

#: Identifier cues (fixed values). Passport numbers are shorter and may begin with letters.
CUES = ("account", "acct", "iban", "ssn", "social security", "routing", "passport", "konto", "kontonummer", "compte", "cuenta")
_PASSPORT = re.compile(r"[\s:#=\".-]{0,4}(?:no|nr|num|number)?[\s:#=\".]{0,4}([A-Za-z]{0,2}[0-9]{6,9})(?![0-9A-Za-z])", re.ASCII | re.IGNORECASE)
_LOWER = {c: c + 32 for c in range(65, 91)}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("://", ("://", 3))
    for cue in CUES:
        found.add_word(cue, (cue, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if at & 1:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def iban(text: str) -> bool:
    flat = text.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", flat):
        return False
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, not reaching before ``since``."""
    start = at
    while start > since and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _account(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The number right after a cue that ends at ``at``: 8 to 17 digits, an IBAN that checks, or after its cue a passport's."""
    if cue == "passport" and (found := _PASSPORT.match(text, at)):
        return found.span(1)
    found = _ACCOUNT.match(text, at)
    if not found:
        return None
    start, raw = found.start(1), found[1]
    parts = re.match(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{1,4})+", raw)
    if parts:
        words = parts[0]
        while words:
            if iban(words):
                return start, start + len(words)
            words = words[:-1].rstrip()
    number = re.match(r"[0-9](?:[ -]?[0-9])*", raw)
    if number and 8 <= len(re.sub(r"[^0-9]", "", number[0])) <= 17:
        return start, start + number.end()
    return None


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind in code points, end exclusive, in order; within a kind they don't overlap."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*KINDS, *MORE_KINDS)}
    mail_end = account_end = login_end = 0
    # A-Z lower-cased, one character for one, so that every way of writing a cue is found
    for last, (kind, size) in anchors.iter(text.translate(_LOWER)):
        if kind == "@":
            if found := _email(text, last, mail_end):
                out["email"].append(found)
                mail_end = found[1]
        elif kind == "://":
            found = _LOGIN.match(text, last + 1)
            if found:
                start = last - 2
                while start > login_end and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                out["login_url"].append((start, found.end()))
                login_end = found.end()
        else:
            before = last - size
            if before >= 0 and text[before].isalnum() or last + 1 <= account_end:
                continue
            if found := _account(text, last + 1, kind):
                out["account"].append(found)
                account_end = found[1]
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, a count per kind, ``base_sha256``, ``spans``.

    ``spans`` lists ``kind:start:end`` by kind as listed, then start, comma-joined; the listed kinds
    come before those found from cues and schemes. ``base_sha256`` covers the listed kinds. Null and
    empty texts have no spans. Texts are read whole; repeated rows give equal rows; other columns
    are ignored; an empty table gives no rows.
    """
    names = ["doc_id", *[f"n_{k}" for k in (*KINDS, *MORE_KINDS)], "base_sha256", "spans"]
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        anchors = _automaton()
        for batch in batches:
            sums, digests, lists = [], [], []
            for text in batch.column(1).to_pylist():
                found = spans(text, anchors)
                sums.append([len(v) for v in found.values()])
                base = [f"{k}:{a}:{b}" for k in KINDS for a, b in found[k]]
                digests.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                lists.append(",".join([*base, *[f"{k}:{a}:{b}" for k in MORE_KINDS for a, b in found[k]]]))
            table = np.array(sums, np.int64).reshape(-1, len(KINDS) + len(MORE_KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, k]) for k in range(table.shape[1])], pa.array(digests, pa.string()), pa.array(lists, pa.string())], names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *[f"{n} long" for n in names[1:-2]], "base_sha256 string, spans string"]))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of :func:`find` replaced by ``<KIND>`` (overlaps: the leftmost, longest first)."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        anchors = _automaton()
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    parts, to = [], 0
                    for a, minus_b, k in sorted((a, -b, k) for k, v in spans(text, anchors).items() for a, b in v):
                        if a >= to:
                            parts += [text[to:a], f"<{k.upper()}>"]
                            to = -minus_b
                    text = "".join([*parts, text[to:]])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
