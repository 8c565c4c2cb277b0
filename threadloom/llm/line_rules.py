"""Line-first cleaning: rules per line, failing lines go, documents that lose too much text are rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.arrow_rows import slices
from threadloom.llm.registry import documents, query
from threadloom.session import ship_package

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
WINDOW, MIN_WORDS, REPEAT_PERCENT = 5, 10, 20
SYMBOLS_PER_100_WORDS = 30  # a line with more is a table, a menu or noise
SHOUTS_PER_100_WORDS, SHOUT_WORDS = 50, 3  # exclamation marks, in lines of at least so many words
MOST_LOST_PERCENT = 50
# Phrases of navigation and legal boilerplate; a line made of little else is removed.
BOILERPLATE = ("all rights reserved", "licensed under", "released under", "this work is licensed", "copyright",
               "terms of use", "privacy policy", "cookie policy", "accept cookies")
NAVIGATION = ("click here", "read more", "log in", "sign up", "next page", "previous page", "back to top",
              "skip to content", "share this", "main menu")
PHRASE = re.compile("|".join(map(re.escape, BOILERPLATE + NAVIGATION)))
PHRASE_WORDS = 12
MIXERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                   0xA0761D6478BD642F], np.uint64)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words inside any window of five that stands twice or more in the text, the first copy included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    m = n - WINDOW + 1
    windows = sum((hashes[k:k + m] * MIXERS[k] for k in range(1, WINDOW)), hashes[:m] * MIXERS[0])
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[k:k + m] |= twice
    return int(covered.sum())


def count_any(text: str, characters: str) -> int:
    return sum(map(text.count, characters))


def line_fails(line: str, words: int) -> bool:
    """Punctuation, navigation and boilerplate rules for one line of ``words`` words."""
    if 100 * count_any(line, SYMBOLS) > SYMBOLS_PER_100_WORDS * words:
        return True
    if words >= SHOUT_WORDS and 100 * line.count("!") > SHOUTS_PER_100_WORDS * words:
        return True
    return words <= PHRASE_WORDS and PHRASE.search(line.lower()) is not None


def clean(text: str | None) -> tuple[list[int], int, str]:
    """Counts of ``COUNTS``, word characters left after cleaning, and the text without failing and repeated lines."""
    if not text:
        return [0, 0, 0, 0, 0], 0, ""
    words = text.encode().split()  # cuts at SPACES only
    characters = len(text) - count_any(text, SPACES)
    seen: set[str] = set()
    good, left, repeats = [], characters, 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        if n:
            again = line in seen
            repeats += again
            if again or line_fails(line, n):
                left -= len(line) - count_any(line, SPACES)
                seen.add(line)
                continue
            seen.add(line)
        good.append(line)
    return [len(words), characters, count_any(text, SYMBOLS), repeats, repeated_words(words)], left, "\n".join(good)


def clean_lines(docs: DataFrame, text_col: str = "text", out: str = "rules", with_text: bool = True) -> DataFrame:
    """``docs`` with a struct ``out``: the counts, base_failed, kept, lost_percent and cleaned_text.

    Lines are judged first: too many signs or exclamation marks per word, short lines with a phrase of navigation or
    boilerplate, copies of an earlier line. A document is kept unless its word count or repetition fails the base
    rules or its lines lose more than ``MOST_LOST_PERCENT`` percent of the characters in words.

    A NULL, empty or blank text has zero counts, fails the base rule and is not kept. ``cleaned_text`` is NULL
    unless ``with_text``. A column named ``out`` is replaced, all others stay. Rows are independent: no shuffle.
    """
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    fields = [*[f"{c} long" for c in COUNTS], "base_failed boolean", "kept boolean", "lost_percent double",
              "cleaned_text string"]
    names = [f.split()[0] for f in fields]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, text_col):
            found = [clean(t) for t in texts]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            failed = [f[0][0] < MIN_WORDS or 100 * f[0][4] > REPEAT_PERCENT * f[0][0] for f in found]
            lost = [100 * (1 - f[1] / f[0][1]) if f[0][1] else 0.0 for f in found]
            columns += [
                pa.array(failed), pa.array([not b and x <= MOST_LOST_PERCENT for b, x in zip(failed, lost)]),
                pa.array(lost, pa.float64()), pa.array([f[2] if with_text else None for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.StructArray.from_arrays(columns, names)], [*kept, out])

    schema = docs.select(*kept).withColumn(out, F.lit(None).cast(f"struct<{','.join(f.replace(' ', ':') for f in fields)}>")).schema
    return docs.select(*kept).mapInArrow(cleaned, schema)


@query("op4_quality_rules")
def quality_rules(spark, sf_dir) -> DataFrame:
    ruled = clean_lines(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    return ruled.select("doc_id", *[f"rules.{c}" for c in (*COUNTS, "base_failed", "kept", "lost_percent")])
