"""Secrets in texts: named patterns, and a token-efficiency test that finds random strings no pattern names.

A run of 16 or more key characters that a byte-level BPE vocabulary needs many tokens for (few characters a token) is
random rather than language. A run that is not random as a whole, or too long to be judged so, is judged by its pieces
between / + = _ - and by overlapping windows; hits that overlap are one span. Runs that are known digests (32, 40, 56, 64, 96 or 128 hex digits), identifiers (UUIDs, numbers,
dates, words of one case or of few tokens joined by - or _ or /, with up to four digits) or lack a digit or a change of case are let go; so is what overlaps a span of a named pattern.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import lean, parts
from xylem.llm.tokens import VOCABULARY, encoding

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A run of fewer characters a token than this is random. Language has above 3, base64 and hex noise below 2.
CHARS_PER_TOKEN = 2.2
#: Characters of a run that is judged as a whole at most; of a window of a longer run, and from one window to the next.
WHOLE, WINDOW, STEP = 256, 64, 32
PIECE = re.compile(r"[A-Za-z0-9]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
IDENTIFIER = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9+/_=-]+", re.IGNORECASE)
#: Letters with joiners, and up to four digits at the end; a part of these that is plainly one word.
LETTERS, JOINER, ONE_CASE = re.compile(r"([A-Za-z_/=+-]*)[0-9]{0,4}"), re.compile(r"[-_/=+]+"), re.compile(r"(?:[A-Z]?[a-z]*|[A-Z]*)")

#: What a window may hold a part of without being random.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{DIGEST.pattern}|[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}})(?![A-Za-z0-9])", re.IGNORECASE)

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The named patterns, leftmost and non-overlapping per kind; code points, end exclusive."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def is_words(run: str, encode) -> bool:
    """Words, joined or in camel case: each part is short and of one case, or has as few tokens as language."""
    if not (m := LETTERS.fullmatch(run)):
        return False
    return all(len(x) < 16 and ONE_CASE.fullmatch(x) or len(x) >= CHARS_PER_TOKEN * len(encode(x)) for x in JOINER.split(m[1]))


def is_random(run: str, encode) -> bool:
    if DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return False
    if not any(map(str.isdigit, run)) and run[1:].islower():
        return False
    return len(run) < CHARS_PER_TOKEN * len(encode(run)) and not is_words(run, encode)


def parts_of(run: str) -> list[tuple[int, int]]:
    """Where a run is judged when it isn't judged as a whole: its pieces, and windows that leave out no character."""
    out = [m.span() for m in PIECE.finditer(run) if len(m.group()) <= WHOLE]
    if len(run) > WINDOW:
        known = [m.span() for m in KNOWN.finditer(run)]
        starts = [*range(0, len(run) - WINDOW, STEP), len(run) - WINDOW]
        out += [(i, i + WINDOW) for i in starts if not any(a < i + WINDOW and i < b for a, b in known)]
    return sorted(out)


def random_spans(text: str, named: list[Span], encode) -> list[Span]:
    out = []
    for m in RUN.finditer(text):
        run = m.group().strip("=/+-_")
        if len(run) < 16 or DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
            continue
        start = m.start() + m.group().index(run)
        end = start + len(run)
        near = [(a, b) for _, a, b in named if a < end and start < b]
        if not near and len(run) <= WHOLE and is_random(run, encode):
            out.append(("random", start, end))
            continue
        last = start
        for a, b in parts_of(run):
            a, b = a + start, b + start
            if any(x < b and a < y for x, y in near) or not is_random(text[a:b], encode):
                continue
            if out and a < last:
                out[-1] = ("random", out[-1][1], last := max(last, b))
            else:
                out.append(("random", a, last := b))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scanned(vocabulary: str):
    def scanned(batches):
        encode = encoding(vocabulary).encode_ordinary
        for batch in parts(batches):
            ids, found = batch.column("id"), []
            for text in batch.column("text").to_pylist():
                named = base_spans(text := text or "")
                every = named + random_spans(text, named, encode)
                found.append([{"kind": k, "start": a, "end": b, "secret": text[a:b]} for k, a, b in sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))])
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, SPANS)], ["id", "found"])

    return scanned


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """id_col and found, an array of (kind, start, end, secret) by start and kind, for each row of docs. A null text is empty and has none.

    Texts of any length are searched whole; repeated rows, ties and null ids (of any type) are each a row of the result,
    and an empty table gives an empty one. Other columns are not read, so their names don't matter.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(_scanned(vocabulary)), f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint,secret:string>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes in place of the spans, by SQL functions."""

    def line(kinds):
        kept = F.filter("found", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    out = {f"n_{k}": count(k) for k in KINDS} | {"base_sha256": F.sha2(line(KINDS[:3]), 256), "spans": line(KINDS)}
    return found.withColumns(out).drop("found")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
