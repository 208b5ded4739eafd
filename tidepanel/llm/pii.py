"""Personal data in text by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, URL schemes
and words that announce an identifier. At each anchor a deterministic local
parser looks left and right, decides the boundaries and validates the value, so
the text between anchors is never matched against any pattern.

Kinds. The base: `email`, `ip`, `card` (Luhn), `phone`, each found leftmost and
without overlaps within its kind. The method adds `url` (an address that names
a person: user information, or a personal path) and `account` (an IBAN by its
check digits, or a number of at least six digits right after a cue word).
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("iban", "account", "acct", "passport", "ssn", "social security", "tax id", "konto", "cuenta", "compte")

AT, PLUS, DIGIT, SCHEME, CUE = range(5)
ANCHORS = ahocorasick.Automaton()
for _text, _kind in [("@", AT), ("+", PLUS), *((d, DIGIT) for d in "0123456789"), *((s, SCHEME) for s in SCHEMES)]:
    ANCHORS.add_word(_text, (_kind, len(_text)))
for _cue in CUES:
    for _text in {_cue, _cue.upper(), _cue.capitalize(), _cue.title()}:
        ANCHORS.add_word(_text, (CUE, len(_text)))
ANCHORS.make_automaton()

# Local parsers: each is applied at one position only.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_grouped = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_dialled = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_address = re.compile(r"(?:([A-Za-z0-9._%+-]+)(?::[^\s/@]*)?@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(/[^\s<>\"']*)?").match
_personal = re.compile(r"/(?:~|@|u/|user/|users/|people/|profile/)[A-Za-z0-9_.-]+").match
_after_cue = re.compile(r"(?: (?:no|nr|number|num)\.?)?[ \t]{0,2}[:#=]?[ \t]{0,2}").match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match
_number = re.compile(r"[A-Z]{0,2}[0-9](?:[ -]?[0-9]){5,17}").match
_word = re.compile(r"\w").match


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def small(part: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start, then kind as in `KINDS`; code points, end exclusive."""
    out: list[tuple[int, int, int]] = []
    mail_end = dotted_end = card_end = phone_end = url_end = 0
    size = len(text)
    for last, (kind, length) in ANCHORS.iter(text):
        if kind == DIGIT:
            if last >= dotted_end:
                m = _dotted(text, last)
                dotted_end, at = m.end(), last
                parts = m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i:i + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(map(small, four)):
                        out.append((at, 1, end))
                    at = end + 1
            if last >= card_end:
                m = _grouped(text, last)
                card_end = m.end() if m else last + 1
                if m and card_end - last >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((last, 2, card_end))
        elif kind == AT:
            start = last
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _domain(text, last + 1)):
                mail_end = m.end()
                out.append((start, 0, mail_end))
        elif kind == PLUS:
            if last >= phone_end and (m := _dialled(text, last)):
                phone_end = m.end()
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((last, 3, phone_end))
        elif kind == SCHEME:
            start = last + 1 - length
            if start >= url_end and (m := _address(text, last + 1)):
                end = m.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                url_end = end
                if m[1] or (m[2] and _personal(m[2])):
                    out.append((start, 4, end))
        else:
            start = last + 1 - length
            if (start and _word(text, start - 1)) or (last + 1 < size and _word(text, last + 1)):
                continue
            at = _after_cue(text, last + 1).end()
            if m := _iban(text, at):
                value = m[0]
                while len(value.replace(" ", "")) >= 15 and not mod97(value.replace(" ", "")):
                    value = value[:-1].rstrip()
                if len(value.replace(" ", "")) >= 15:
                    out.append((at, 5, at + len(value)))
                    continue
            if m := _number(text, at):
                out.append((at, 5, m.end()))
    out.sort()
    return [(start, KINDS[kind], end) for start, kind, end in out]


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with `found`, an array of (start, kind, end).

    A null or empty text has no spans; null ids and repeated rows stay. Rows are
    independent, and a text is scanned once from end to end: no shuffle.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"start": s, "kind": k, "end": e} for s, k, e in find(t.as_py() or "")] for t in batch["text"]]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, kind)], ["doc_id", "found"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each,
                       "doc_id long, found array<struct<start: int, kind: string, end: int>>")


def masked(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with each span replaced by its kind in brackets; of overlapping spans the first holds."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for value in batch["text"]:
            text, out, at = value.as_py(), [], 0
            for start, kind, end in find(text or ""):
                if start >= at:
                    out += [text[at:start], f"[{kind}]"]
                    at = end
            texts.append(None if text is None else "".join(out) + text[at:])
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, text string")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; nulls as in `detect`."""
    counts = [f"n_{kind}" for kind in BASE]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        tallies, hashes, texts = [[] for _ in BASE], [], []
        for value in batch["text"]:
            spans = find(value.as_py() or "")
            base = [s for s in spans if s[1] in BASE]
            for tally, kind in zip(tallies, BASE, strict=True):
                tally.append(sum(s[1] == kind for s in base))
            hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
            texts.append(written(spans))
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(t, pa.int64()) for t in tallies), pa.array(hashes, pa.string()), pa.array(texts, pa.string())],
            ["doc_id", *counts, "base_sha256", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each,
                       f"doc_id long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string")
