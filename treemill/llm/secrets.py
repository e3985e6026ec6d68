"""Secret scans: keywords first, patterns only where a keyword is, checksums last.

An Aho-Corasick automaton finds all keywords of all kinds in one pass over a text.  At each hit
the kind's pattern is tried anchored there; hits inside an earlier match of the kind
are passed over, which gives what a leftmost, non-overlapping search gives.  Runs of
hexadecimal digits have no keyword and are searched by their pattern alone.  Kinds whose
tokens carry a checksum or a readable header are kept only if that is right.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from treemill.llm.common import documents, per_row, texts

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TAGGED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
KINDS = ("assign", "access", "hex", "tagged", "jwt")
BASE = KINDS[:3]
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "tagged": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "jwt": ("eyj",)}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}


def crc_matches(body: str) -> bool:
    """Whether the last 6 of 36 characters are the base-62 CRC-32 of the first 30."""
    value = zlib.crc32(body[:30].encode())
    digits = ""
    while value:
        value, d = divmod(value, 62)
        digits = DIGITS[d] + digits
    return body[30:] == digits.rjust(6, "0")


def header_reads(part: str) -> bool:
    """Whether a token's first part is base64 of a JSON object with an algorithm."""
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "tagged": TAGGED, "jwt": JWT}
VALID = {
    "assign": lambda m: len(m[2]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "tagged": lambda m: crc_matches(m[1]),
    "jwt": lambda m: header_reads(m[1]),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans(keywords, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed."""
    if not text:
        return []
    found, done = [], dict.fromkeys(PATTERNS, 0)
    lowered = text.lower() if text.isascii() else text.translate(LOWER)
    for last, (kind, size) in keywords.iter(lowered):
        start = last + 1 - size
        if start >= done[kind] and (m := PATTERNS[kind].match(text, start)):
            done[kind] = m.end()
            if VALID[kind](m):
                found.append((start, m.end(), kind))
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (start, end, kind), of every row; null texts have none.

    Whole texts are read; offsets count code points.  Other columns are not looked at.
    """
    one = lambda keywords, doc_id, text: (doc_id, [{"start": s, "end": e, "kind": k} for s, e, k in spans(keywords, text)])
    return per_row(texts(docs), one, "doc_id long, spans array<struct<start: long, end: long, kind: string>>", automaton)


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(keywords, doc_id, text):
        found = spans(keywords, text)
        base = [s for s in found if s[2] in BASE]
        counts = [sum(s[2] == k for s in base) for k in BASE]
        return (doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found))

    return per_row(texts(documents(spark, sf_dir)), one, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", automaton)
