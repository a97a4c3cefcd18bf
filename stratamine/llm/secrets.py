"""Secret scans: fixed patterns, and strings that a primed compressor cannot shorten.

A candidate is a long string of credential characters, with digits among letters, that follows a sensitive word
closely. What counts is its novelty: the bytes that zstandard needs for it beyond those for its surroundings, with a
dictionary of identifiers and the surrounding text as history. Repeated, dictionary-like and structured strings cost
next to nothing; a random one costs what its alphabet carries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamine.llm.tokens import two

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, so the same as runs of which the short ones are dropped
#: Cheap marks of which a text with an assignment has one, lower-cased.
MARKS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"passw|pwd|secret|token|api.?key|access.?key|private.?key|credential|auth|bearer|signature|licen[cs]e.?key", re.I | re.ASCII)
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = re.compile(r"[A-Za-z0-9+/_=-]{16}")
START = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}")
REST = re.compile(r"[A-Za-z0-9+/_-]*")  # of an identifier, up to an assignment
REACH = 48  # characters before a candidate in which a sensitive word must lie
AROUND = 256  # characters on either side that prime the compressor
#: The least share of what the alphabet carries that a candidate must cost.
NOVELTY = 0.85
#: Identifiers and words that code and settings are made of.
IDENTIFIERS = " ".join(
    f"{a}{s}{b}"
    for a in "get set is has to from new old max min num app user client server session request response access refresh auth api db aws http config default public private".split()
    for s in ("_", "", "-")
    for b in "id key name value type token secret password url path host port user count size time date index list map file data error status code version header body".split()
) + " import return class function const let var def self this null None true false string integer boolean if else for while export https://www. .com/ abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "

_TOOLS: list = []


def _compressor():
    if not _TOOLS:
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _TOOLS.append(zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False))
    return _TOOLS[0]


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes of a candidate over what its alphabet would carry at random."""
    compress = _compressor().compress
    around = (before + "\n" + after + "\n").encode()
    cost = len(compress(around + candidate.encode())) - len(compress(around))
    alphabet = 16 if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", candidate) else 36 if not re.search("[a-z]", candidate) or not re.search("[A-Z]", candidate) else 64
    return cost * 8 / (len(candidate) * log2(alphabet))


def free(a: int, b: int, covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches of a candidate where no other span lies."""
    out = []
    for x, y in sorted(s for s in covered if a < s[1] and s[0] < b):
        if a < x:
            out.append((a, x))
        a = max(a, y)
    return [*out, (a, b)] if a < b else out


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind."""
    found = []
    low = text.lower()
    if any(m in low for m in MARKS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    covered = [(a, b) for _, a, b in found]
    searched, edge, begin, end, judged = 0, 0, 0, 0, set()  # starts before searched have been seen
    for word in SENSITIVE.finditer(text):
        low = word.end()
        if low >= edge:
            edge = REST.match(text, low).end()
        # the rest of an identifier is none, unless something is assigned in it
        starts = [edge + 1] if text[edge : edge + 1] == "=" else []
        starts += [m.start() for m in START.finditer(text, max(low, searched), low + REACH + 16)]
        searched = max(searched, low + REACH + 1)
        for a in starts:
            if a in judged or not LEAST.match(text, a):
                continue
            judged.add(a)
            if not begin <= a < end:
                begin, end = STRING.match(text, a).span()
            for a, b in free(a, end, covered):
                s = text[a:b]
                if len(s) < 16 or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
                    continue
                if novelty(s, text[max(0, a - AROUND) : a], text[b : b + AROUND]) >= NOVELTY:
                    found.append(("novel", a, b))
                    covered.append((a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (an array of kind, start and end in code points, by start and kind) of every text.

    Kinds: assign, access and hex by their patterns; novel by compression, where no other span lies. A null or empty
    text has none. Repeated rows each give a row; a null id stays null.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    return two(df, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans: str | Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with every span of the text replaced by ``mark``. A null text stays null."""
    names = df.columns
    plain = df.schema[text_col]
    ship_docs = df.withColumn(text_col, F.col(text_col).cast("string"))
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(where):
                text = x.as_py()
                spans = scan(text) if text else []
                if spans:
                    parts, at = [], 0
                    for _, a, b in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = [pa.array(out, pa.string()) if i == where else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    from stratamine.llm.ship import ship

    ship(df.sparkSession)
    return ship_docs.mapInArrow(run, df.schema) if plain else ship_docs
