"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, computed in numpy over whole texts, show which words
lie inside an n-gram that the same text holds twice or more; the characters of those words, and
of lines that equal an earlier line, are measured against the characters of all words.

Defined results: a null or empty text has no words, so every count is 0 and it fails the base
rule; rows are judged one by one, so ties and repeated rows simply repeat; a null ``doc_id``
stays null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cellcast.llm.common import Words, ngram_hashes, sliced, tune

#: Word n-gram lengths whose repeated characters are measured, with the largest share kept.
COVERAGE_LIMITS = {4: 0.50, 8: 0.35, 16: 0.30}
#: Largest share of characters in lines that equal an earlier line.
LINE_LIMIT = 0.40
#: Most markup symbols (``#*$%&|<>``) for each word.
SYMBOL_LIMIT = 0.3
#: Window of the base rule.
WINDOW = 8
#: Base rule: least number of words, and largest percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, " + ", ".join(f"share_{n} double" for n in COVERAGE_LIMITS) + ", share_lines double"
)


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Marks the words inside an n-gram that occurs twice or more within its own text."""
    grams = ngram_hashes(words.hash, n)
    inside = np.zeros(len(words) + 1, np.int64)
    if len(grams):
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        own = text[: len(grams)] == text[n - 1 :]
        at = np.flatnonzero(own)
        with np.errstate(over="ignore"):
            keys = grams[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = at[twice]
        np.add.at(inside, hit, 1)
        np.add.at(inside, hit + n, -1)
    return np.cumsum(inside)[:-1] > 0


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the code points of their words."""
    if b"\n" not in text:
        return 0, 0
    seen: set[bytes] = set()
    count = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return count, chars


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        texts = batch.column("text")
        words = Words(texts)
        per = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[words.first])
        points = words.code_points()
        length = points[words.end] - points[words.start]
        n_words, chars = np.diff(words.first), per(length)
        symbols = np.diff(np.concatenate(([0], np.cumsum(_SYMBOL[words.data])))[words.offsets])
        lines = [duplicate_lines(words.data[a:b].tobytes()) for a, b in zip(words.offsets[:-1], words.offsets[1:])]
        repeat = per(repeated_words(words, WINDOW))
        least = np.maximum(chars, 1)
        shares = {n: per(length * repeated_words(words, n)) / least for n in COVERAGE_LIMITS}
        share_lines = np.array([c for _, c in lines], np.float64) / least
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        kept = ~failed & (share_lines <= LINE_LIMIT) & (symbols <= SYMBOL_LIMIT * n_words)
        for n, limit in COVERAGE_LIMITS.items():
            kept &= shares[n] <= limit
        columns = [batch.column("doc_id"), n_words, chars, symbols, np.array([c for c, _ in lines], np.int64), repeat, failed, kept, *shares.values(), share_lines]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): counts, shares and verdict.

    A narrow map: no shuffle, memory bounded by one text or about 2 MB of texts.
    """
    tune(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(measure, SCHEMA)
