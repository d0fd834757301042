"""Secret scan: keyword automaton, regular expressions anchored at its hits, checksums.

One pass of an Aho-Corasick automaton over a text (in ASCII lower case) gives the
places where a keyword stands. Only there is a kind's regular expression tried, at
that very place. Runs of hex digits have no keyword; they are found by comparing
neighbouring bytes of a whole slice. Kinds with a checksum inside (a base-62 CRC-32
in the last six characters) count only if it fits.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shelfspark.llm.batches import add_columns, text_bytes

# The kinds, their keywords and patterns.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
)
ACCESS_WORDS = ["AKIA"]
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
#: Order of kinds that start at one place.
KINDS = ["assign", "access", "hex", "checked"]
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of ``body`` in six base-62 digits."""
    value, out = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out.encode()


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in ((0, ASSIGN_WORDS), (1, ACCESS_WORDS), (3, CHECKED_WORDS)):
        for keyword in keywords:
            found.add_word(keyword.lower(), (kind, len(keyword)))
    found.make_automaton()
    return found


_KEYWORDS = _automaton()


def keyword_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of all kinds with keywords.

    Trying a pattern at each hit that lies after the kind's last match gives the
    leftmost matches that do not overlap, as every match starts with a keyword. A
    match that is too short counts for nothing but still uses up its bytes.
    """
    # Latin-1 makes one character of each byte.
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _KEYWORDS.iter(text.lower().decode("latin-1")))
    out, free = [], [0, 0, 0, 0]
    for start, kind in hits:
        if start < free[kind]:
            continue
        match = (ASSIGN, ACCESS, None, CHECKED)[kind].match(text, start)
        if match is None:
            continue
        free[kind] = match.end()
        good = (
            match.end(2) - match.start(2) >= ASSIGN_CHARS
            if kind == 0
            else match.end() - start >= ACCESS_CHARS
            if kind == 1
            else base62_crc(match[1]) == match[2]
        )
        if good:
            out.append((start, kind, match.end()))
    return out


def hex_runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of maximal runs of hex digits within a row."""
    is_hex = _HEX[data]
    begins, ends = is_hex.copy(), is_hex.copy()
    first = np.zeros(len(data) + 1, bool)
    first[bounds[:-1]] = True
    begins[1:] &= ~is_hex[:-1] | first[1:-1]
    ends[:-1] &= ~is_hex[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = end - start >= HEX_CHARS
    start, end = start[long], end[long]
    row = np.searchsorted(bounds, start, "right") - 1
    return row, start - bounds[row], end - bounds[row]


def scan_rows(data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans of each row as (start, kind, end) in code points, in order."""
    whole = data.tobytes()
    rows = [keyword_spans(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    if len(data):
        for row, start, end in zip(*[x.tolist() for x in hex_runs(data, bounds)]):
            rows[row].append((start, 2, end))
    for i, spans in enumerate(rows):
        if spans:
            text = whole[bounds[i] : bounds[i + 1]]
            if not text.isascii():
                # Code points before each place asked for, counted in one pass.
                places, at, n = {}, 0, 0
                for p in sorted({p for s in spans for p in (s[0], s[2])}):
                    n, at = n + len(text[at:p].decode("utf-8", "ignore")), p
                    places[p] = n
                spans[:] = [(places[s], k, places[e]) for s, k, e in spans]
            spans.sort()
    return rows


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``out``: the secrets of the text as (kind, start, end), by start, then kind.

    Places are code points, the end exclusive. A null or empty text has none. Rows
    stay as they are, repeated ones included; a column named like ``out`` is replaced.
    """

    def compute(column: pa.Array) -> list[pa.Array]:
        rows = scan_rows(*text_bytes(column))
        flat = [s for row in rows for s in row]
        spans = pa.StructArray.from_arrays(
            [
                pa.array([KINDS[k] for _, k, _ in flat], pa.string()),
                pa.array([s for s, _, _ in flat], pa.int64()),
                pa.array([e for _, _, e in flat], pa.int64()),
            ],
            names=["kind", "start", "end"],
        )
        ends = np.cumsum([0, *map(len, rows)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)]

    return add_columns(df, text, StructType([StructField(out, ArrayType(SPAN))]), compute, keep)


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``mark``; overlapping secrets are replaced as one. Null stays null."""

    def compute(column: pa.Array) -> list[pa.Array]:
        rows, texts = scan_rows(*text_bytes(column)), column.to_pylist()
        for i, spans in enumerate(rows):
            if not spans:
                continue
            pieces, at = [], 0
            for start, _, end in spans:
                if start >= at:
                    pieces += [texts[i][at:start], mark]
                at = max(at, end)
            texts[i] = "".join([*pieces, texts[i][at:]])
        return [pa.array(texts, pa.string())]

    names = df.columns
    done = add_columns(df, text, StructType([df.schema[text]]), compute)
    return done.select(*[f"`{c}`" for c in names])
