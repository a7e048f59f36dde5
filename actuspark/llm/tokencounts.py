"""Token counts by section from one encoding of each whole document.

A document is encoded once; the lengths of its tokens give each token's span, and sorted section bounds give the section of
each span by binary search (the interval join of two sorted lists). Rule for tokens that cross a bound: a token belongs to the
section that holds most of its bytes, on a tie to the earlier one. So the counts of the sections add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actuspark.llm.common import mapped, slices, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how these vocabularies cut a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 18
#: Sections end after the blanks that follow a sentence, and after line feeds. Of bytes; never empty.
SEPARATOR = rb"[.!?]+[ \t]+|\n+"
#: A blank between two visible characters always begins a word of the pattern, so a text may be cut there.
CUT = regex.compile(r"(?<=\S) (?=\S)")
#: The pattern takes a long run of blanks as one word, but for the last blank before a visible character. Its search tries every
#: shorter run first, in steps that pile up, so such words are taken out of the text and encoded on their own.
BLANKS = regex.compile(r"\s{1000,}")
MAX_VOCABULARY_BYTES = 64 << 20


@lru_cache(maxsize=2)
def encoding(content: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """A text in pieces that the pattern parts anyway; True for a run of blanks that is one word."""
    at = 0
    while at < len(text):
        cut = CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        for run in BLANKS.finditer(text, at, end):
            last = run.end() if run.end() == len(text) else run.end() - 1
            yield text[at:run.start()], False
            yield text[run.start():last], True
            at = last
        yield text[at:end], False
        at = end


def token_ends(text: str, content: bytes) -> np.ndarray:
    """Where each token of a text ends, in bytes."""
    encoder, sizes = encoding(content)
    ids: list[int] = []
    for piece, one_word in stretches(text):
        ids += encoder._encode_single_piece(piece) if one_word else encoder.encode_ordinary(piece)
    return np.cumsum(sizes[np.array(ids, np.int64)])


def allocate(token_end: np.ndarray, section_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross into or out of it). Ends are increasing and share the last value."""
    start = np.concatenate([[0], token_end[:-1]])
    first = np.searchsorted(section_end, start, side="right")
    last = np.searchsorted(section_end, token_end - 1, side="right")
    owner = first.copy()
    begin = np.concatenate([[0], section_end[:-1]])
    crossing = np.zeros(len(section_end), np.int64)
    two = np.flatnonzero(last - first == 1)
    left = section_end[first[two]]
    owner[two] += (token_end[two] - left > left - start[two])
    np.add.at(crossing, np.concatenate([first[two], last[two]]), 1)
    for t in np.flatnonzero(last - first > 1):
        touched = np.arange(first[t], last[t] + 1)
        part = np.minimum(section_end[touched], token_end[t]) - np.maximum(begin[touched], start[t])
        owner[t] = touched[np.argmax(part)]
        crossing[touched] += 1
    return np.bincount(owner, minlength=len(section_end)), crossing


def section_ends(raw: bytes, separator: re.Pattern) -> np.ndarray:
    """Ends of the sections of a text, each with the separator that closes it; an empty text has none."""
    ends = [m.end() for m in separator.finditer(raw)]
    if raw and (not ends or ends[-1] < len(raw)):
        ends.append(len(raw))
    return np.array(ends, np.int64)


SECTIONS = pa.schema([("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])


def section_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
                   separator: bytes = SEPARATOR) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): one row for each section of each document, counted from 0.

    ``start`` and ``end`` are characters. Null and empty texts have one section without tokens. Repeated rows come out as
    often as they come in, an empty table gives an empty result, other columns may have any names. The vocabulary is read on
    the driver and broadcast (refused above 64 MB). Long texts are encoded in pieces cut where the pattern cuts anyway.
    """
    content = Path(vocabulary).read_bytes()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    closing = re.compile(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            index, found = [], [np.zeros((5, 0), np.int64)]
            for i, (value, raw) in enumerate(zip(piece.column("text").to_pylist(), texts(piece.column("text")))):
                data, ends = np.frombuffer(raw, np.uint8), section_ends(raw, closing)
                if not len(ends):
                    rows = np.zeros((5, 1), np.int64)
                else:
                    tokens, crossing = allocate(token_ends(value, shared.value), ends)
                    chars = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
                    rows = np.stack([np.arange(len(ends)), np.concatenate([[0], chars[:-1]]), chars, tokens, crossing])
                index += [i] * rows.shape[1]
                found.append(rows)
            columns = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(index, pa.int64())), *(pa.array(c) for c in columns)],
                                             ["id", *SECTIONS.names])

    kind = base.schema["id"].dataType.simpleString()
    own = "section long, start long, end long, n_tokens long, n_crossing long"
    return mapped(base, run, f"id {kind}, {own}").withColumnRenamed("id", doc_id)
