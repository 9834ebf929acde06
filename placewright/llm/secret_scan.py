"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Fixed patterns give the kinds ``assign``, ``access`` and ``hex``. The battery looks at every
maximal run of 20 or more token characters, infers its encoding (hex, base32 or
base64/base62) and tests it for being drawn at random from that alphabet: chi-squared for
uniform use of the alphabet, Wald-Wolfowitz runs above and below the middle, and serial
correlation at lag one, combined by Fisher's method. Within a text the hypotheses "this token is random"
form one family: Benjamini-Hochberg with weights in proportion to token length
rejects those that are not, holding the share of true secrets among the rejected at
``FALSE_DISCOVERY``. What is not rejected and touches no fixed-pattern span becomes a span
``random_hex``, ``random_base32`` or ``random_base64``.

Positions count code points, ends are exclusive. A null text is an empty one and has no spans. Each row is
read alone and gives one row; repeated rows repeat. Other columns are passed by name only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import extended

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
TOKEN_LEAST = 20
#: Lower-case beginnings of the words that ASSIGN starts with.
LEADS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
KINDS = ["assign", "access", "hex", "random_hex", "random_base32", "random_base64"]
FALSE_DISCOVERY = 0.05

_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "random_hex": [_DIGITS + "abcdef", _DIGITS + "ABCDEF"],
    "random_base32": [_UPPER + "234567"],
    "random_base64": [_UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_"],
}


def encoding(token: str) -> tuple[str, str] | None:
    """Kind and alphabet of the smallest encoding that a token can be in.

    A token without a digit, or without the letters of its encoding in every
    case that encoding has, is no encoded value.
    """
    used = set(token)
    if not used & set(_DIGITS) or used <= set(_DIGITS):
        return None
    for kind, alphabets in ALPHABETS.items():
        for alphabet in alphabets:
            if used <= set(alphabet):
                if kind == "random_base64" and not (used & set(_LOWER) and used & set(_UPPER)):
                    return None
                return kind, alphabet
    return None


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, alphabet: str) -> float:
    """Combined p-value of the hypothesis that ``token`` is random in ``alphabet``."""
    place = {c: k for k, c in enumerate(alphabet)}
    values = np.array([place[c] for c in token], float)
    n, size = len(values), len(alphabet)
    # at least five expected in a bin, bins of neighbouring symbols
    bins = max(2, min(size, n // 5))
    seen = np.bincount((values * bins // size).astype(int), minlength=bins)
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    chi = float(((seen - n * share) ** 2 / (n * share)).sum())
    free = bins - 1
    spread = 2 / (9 * free)
    uniform = _normal_tail(((chi / free) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    high = values >= size / 2
    above, below = int(high.sum()), int(n - high.sum())
    if above and below:
        found = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * above * below / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = 2 * _normal_tail(abs(found - mean) / math.sqrt(variance))
    else:
        runs = 2.0 ** (1 - n)
    centred = values - values.mean()
    square = float((centred**2).sum())
    serial = 0.0 if not square else float((centred[1:] * centred[:-1]).sum()) / square
    related = 2 * _normal_tail(abs(serial + 1 / n) * math.sqrt(n)) if square else 2.0 ** (1 - n)
    half = -sum(math.log(min(max(p, 1e-300), 1.0)) for p in (uniform, runs, related))
    return math.exp(-half) * (1 + half + half * half / 2)


def not_random(p_values: list[float], lengths: list[int], level: float = FALSE_DISCOVERY) -> list[bool]:
    """Weighted Benjamini-Hochberg: which hypotheses of randomness are rejected."""
    n = len(p_values)
    if not n:
        return []
    mean = sum(lengths) / n
    scaled = [p * mean / length for p, length in zip(p_values, lengths)]
    ranked = sorted(scaled)
    bar = max((p for k, p in enumerate(ranked, 1) if p <= level * k / n), default=-1.0)
    return [p <= bar for p in scaled]


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of all spans of a text, in order."""
    found = []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(lead in low for lead in LEADS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    inside = _TOKEN_BYTE[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    if len(edges) and (edges[1::2] - edges[::2]).max() >= TOKEN_LEAST:
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        taken = sorted((start, end) for start, _, end in found)
        tokens = []
        for m in TOKEN.finditer(text):
            known = encoding(m[0])
            if known and not any(start < m.end() and m.start() < end for start, end in taken):
                tokens.append((m.start(), m.end(), known[0], randomness(m[0], known[1])))
        refused = not_random([t[3] for t in tokens], [t[1] - t[0] for t in tokens])
        found += [
            (start, KINDS.index(kind), end) for (start, end, kind, _), no in zip(tokens, refused) if not no
        ]
    return sorted(found)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``spans``, an array of kind, start and end."""
    rows = documents.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = extended(rows.select(*keep).schema, f"spans {SPANS}")
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t.as_py() or "")]
                for t in batch.column("__text")
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(out, kind_of)], [*keep, "spans"]
            )

    return rows.mapInArrow(run, fields)


def listed(found: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """One row per document: counts of the fixed kinds, their digest, all spans."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in KINDS[:3]]
    return find_secrets(documents, ["doc_id"]).select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redacted(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans(text):
        if end > at:
            out += [text[at : max(start, at)], mark if start >= at else ""]
            at = end
    return "".join(out) + text[at:]


def redact(documents: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, every span of ``text`` replaced by ``mark``.

    Spans that overlap are replaced as one. Null texts stay null.
    """
    columns = documents.columns
    spot = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else redacted(t, mark) for t in batch.column(spot).to_pylist()]
            arrays = list(batch.columns)
            arrays[spot] = pa.array(new, arrays[spot].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return documents.mapInArrow(run, documents.schema)
