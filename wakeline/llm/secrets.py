"""Operator 8: secret scan by fixed patterns and dictionary-primed zstandard novelty."""

from __future__ import annotations

import hashlib
import importlib
import keyword
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# The patterns of the contract; ASCII letters of a keyword match in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Long opaque strings; whether one is reported depends on its context and its novelty.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CONTEXT = re.compile(r"(?ai)passw|passwd|pwd|secret|token|api.?key|private.?key|access.?key|credential|authori[sz]|bearer|login")

#: Marginal bytes for each byte of a candidate from which it is reported.
NOVEL = 0.92
#: What a measured block ends with; the dictionary has it.
FILLER = b" timestamp checksum sha256 md5 abcdefghijklmnopqrstuvwxyz 0123456789 aaaaaaaaaaaaaaaa 0000000000000000 "

#: Words of configuration and addresses that surround secrets.
WORDS = """
config settings environment variable header request response client server session user username email address name id
password passwd secret token api_key apikey access_key private_key public_key authorization bearer credential login
http https www com org net example localhost host port path query version license update timestamp checksum sha256 md5
import export return function class public private static const final void string int float bool true false null none ================
"""
#: Modules whose identifiers prime the compressor.
MODULES = "builtins string os os.path sys re json logging http.client urllib.parse email.message socket ssl hashlib datetime collections threading subprocess unittest configparser argparse sqlite3".split()


def dictionary() -> bytes:
    """Identifiers of code in lower case: those of common modules and of their classes, keywords, the words they are made of, and WORDS."""
    names = set(keyword.kwlist) | set(sys.stdlib_module_names)
    for module in MODULES:
        own = importlib.import_module(module)
        for name in dir(own):
            names.add(name)
            if isinstance(value := getattr(own, name), type):
                names.update(dir(value))
    own = " ".join(sorted(n for n in names if len(n) > 3))
    parts = sorted({w.lower() for w in re.findall("[A-Z]?[a-z]{3,}", own)})
    return (own.lower() + WORDS.lower() + " ".join(parts)).encode() + FILLER


class Novelty:
    """Marginal compressed bytes of a candidate within its surroundings, per candidate byte."""

    def __init__(self, words: bytes | None = None, around: int = 256, level: int = 9):
        self.around = around
        data = zstandard.ZstdCompressionDict(dictionary() if words is None else words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        # In lower case, as identifiers come in any: what is left of a random string is as novel.
        before, after, own = (x.lower().encode("utf-8", "replace") for x in (text[max(0, start - self.around) : start], text[end : end + self.around], text[start:end]))
        return (self.block(before + after, own + FILLER) - self.block(before + after, FILLER)) / max(1, len(own))

    def block(self, history: bytes, data: bytes) -> int:
        """Bytes of data in a block of its own, which may refer to the history and to the dictionary. With a filler that
        the dictionary holds, a block is never left uncompressed for its size, nor are its few literals coded."""
        frame = self.packer.compressobj()
        frame.compress(history)
        frame.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        return len(frame.compress(data)) + len(frame.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the contract's patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, threshold: float, window: int) -> list:
    """Opaque strings after a sensitive word that the primed compressor cannot shorten."""
    if not CONTEXT.search(text):
        return []
    found, begins = [], sorted(s for s, _, _ in base)
    # The end furthest right of the spans up to each one, as kinds may overlap.
    ends = list(accumulate((e for _, e in sorted((s, e) for s, _, e in base)), max))
    for m in CANDIDATE.finditer(text):
        own = m.group()
        if not (re.search(r"\d", own) and re.search(r"[A-Za-z]", own)):
            continue
        before = bisect_left(begins, m.end())
        if before and ends[before - 1] > m.start():
            continue
        if CONTEXT.search(text, max(0, m.start() - window), m.start()) and (new := novelty(text, m.start(), m.end())) >= threshold:
            found.append((m.start(), 3, m.end(), new))
    return found


def find_secrets(docs: DataFrame, threshold: float = NOVEL, window: int = 48) -> DataFrame:
    """Every span of every document: doc_id and an array of (kind, start, end, novelty); spans of the fixed patterns have no novelty.

    Offsets are code points, the end exclusive. A null text is empty, an empty text has no span,
    repeated rows are scanned one by one, an empty table gives none; other columns are ignored.
    """
    kind, words = docs.schema["doc_id"].dataType.simpleString(), dictionary()  # one dictionary for all executors

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted([(*b, None) for b in base] + novel_spans(text, base, novelty, threshold, window), key=lambda s: s[:3])
                out.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": x} for s, k, e, x in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"
    )


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
