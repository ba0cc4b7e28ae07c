"""Secret scans: fixed patterns, and strings that surrounding code does not explain.

Base spans follow three patterns (see KINDS). On top of them, a candidate is a
long string of key characters that begins shortly after a sensitive word on the
same line; it runs to its own end. It is compressed by zstandard twice: the bytes
around it alone, and the bytes around it with the candidate at their end, both
primed with a dictionary of identifiers and with the text around, in which other
copies of the candidate do not count. The difference, over the length of the
candidate, is its novelty; strings that stay incompressible are reported as kind
`novel`. Only novelty decides, so a long word that neither the dictionary nor the
text around explains is reported, too.

The identifier dictionary is made of the names that stand before `:`, `=` or `(`
in all documents, most frequent last (zstandard reaches the end of a dictionary
with the shortest distances), in a fixed number of bytes.

Offsets are code points, end exclusive. Null counts as empty and has no spans.
Rows without doc_id are rows like others, repeated rows give repeated rows.
Empty tables give no rows. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks
from activity_timeline.llm.words import slices

# fixed values: the patterns of the contract
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")     # the same runs as [0-9a-f]+ of 32 characters or more
KINDS = ("assign", "access", "hex")
SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api_?key|credential|private|auth|bearer",
                       re.IGNORECASE | re.ASCII)
SHORTEST = 16         # characters of a candidate
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}(?=\x20?[:=(])")

REACH = 64            # characters between a sensitive word and a candidate
AROUND = 512          # characters of surrounding text on each side
NOVELTY = 0.55        # compressed bytes for each byte of the candidate
DICTIONARY_BYTES = 16_384
IDENTIFIERS = 2_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end of every base match."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _named(batches):
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(IDENTIFIER.findall(text))
        yield pa.record_batch([pa.array(list(counts), pa.string()),
                               pa.array(list(counts.values()), pa.int64())],
                              names=["name", "n"])


def identifier_dictionary(docs: DataFrame) -> bytes:
    """The most frequent identifiers of all documents; IDENTIFIERS rows reach the driver."""
    named = in_tasks(docs.select("text").where("text IS NOT NULL"), _named, "name string, n bigint")
    top = (named.groupBy("name").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "name").limit(IDENTIFIERS))
    return " = ".join(r["name"] for r in reversed(top.collect())).encode()[-DICTIONARY_BYTES:]


def _bits(value: str) -> float:
    """Bits that a character of the value's alphabet can hold."""
    return log2(10) if value.isdigit() else 4 if HEXADECIMAL.fullmatch(value) else 6


def novelty(text: str, start: int, end: int, names: bytes) -> float:
    """Marginal compressed bytes of text[start:end], for each of its bytes.

    A random digit takes log2(10) bits and not the log2(64) of a key character, so the bytes
    of digits and of hexadecimal digits count by what their alphabet can hold.
    """
    value, wide = text[start:end], AROUND + end - start
    before = text[max(0, start - wide):start].replace(value, "\n")[-AROUND:]
    after = text[end:end + wide].replace(value, "\n")[:AROUND]
    around = (before + after).encode(errors="replace")
    primed = zstandard.ZstdCompressionDict(names + b"\n" + around,
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)
    candidate = value.encode()
    return (len(packer.compress(around[-64:] + candidate))
            - len(packer.compress(around[-64:]))) / (len(candidate) * _bits(value) / 6)


def novel_spans(text: str, base: list[tuple[int, int, int]], names: bytes):
    """start, 3, end of the candidates that nothing around them explains."""
    found, done, line_end = [], -1, -1
    starts = [start for start, _, _ in base]
    ends = list(accumulate((end for _, _, end in base), max))  # of all spans up to one
    for word in SENSITIVE.finditer(text):
        if line_end < word.end():
            line_end = text.find("\n", word.end())
            line_end = len(text) if line_end < 0 else line_end
        at = max(word.end(), done)
        reach = min(line_end, word.end() + REACH + SHORTEST)  # the start is bounded, not the end
        while m := CANDIDATE.search(text, at, reach):
            start, end = CANDIDATE.match(text, m.start()).span()
            before = bisect_right(starts, start)
            known = before > 0 and end <= ends[before - 1]
            if not known and novelty(text, start, end, names) >= NOVELTY:
                found.append((start, 3, end))
            at = done = end
    return found


def spell(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "novel")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string,"
         " spans string, n_novel bigint")


def scan_secrets(docs: DataFrame, names: bytes | None = None) -> DataFrame:
    """One row per document: counts per kind, digest of the base spans, all spans."""
    names = identifier_dictionary(docs) if names is None else names

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    novel = novel_spans(text, base, names)
                    kinds = Counter(k for _, k, _ in base)
                    rows.append((kinds[0], kinds[1], kinds[2],
                                 hashlib.sha256(spell(base).encode()).hexdigest(),
                                 spell(base + novel), len(novel)))
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])]
                yield pa.record_batch([batch.column("doc_id"), *columns], names=[
                    "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return in_tasks(docs.select("doc_id", "text"), run, FOUND)
