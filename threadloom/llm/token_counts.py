"""Token counts by heap-and-linked-list merging: initial symbols minus merges, no ids."""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from threadloom.llm.arrow_rows import Memo, built_once, file_broadcast, slices
from threadloom.llm.registry import documents, query

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEPARATORS = "\x1c\x1d\x1e\x1f"  # str.split() cuts here, White_Space doesn't


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class TokenCounter:
    """Counts what a word-end BPE file (JSON) would give, special strings in the text included."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"normalizers {kinds} are not known here")
        self.ranks = {" ".join(m) if isinstance(m, list) else m: i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.matches = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.marks = special
        self.letters = byte_letters()
        self.words = Memo(self._word, 500_000)

    def merged(self, match: str) -> int:
        """Symbols left of one match. The heap pops the lowest rank, leftmost first; entries gone stale are skipped."""
        symbols = [self.letters[b] for b in match.encode()]
        symbols[-1] += self.end
        n = left = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.ranks.get
        heap = []
        for i in range(n - 1):
            if (r := rank_of(f"{symbols[i]} {symbols[i + 1]}")) is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(f"{symbols[i]} {symbols[k]}")) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (p := before[i]) >= 0 and (r := rank_of(f"{symbols[p]} {symbols[i]}")) is not None:
                heapq.heappush(heap, (r, p, symbols[p], symbols[i]))
        return left

    def _word(self, word: str) -> int:
        return sum(map(self.merged, self.matches(word)))

    def _plain(self, text: str) -> int:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # lower case by character, without the rule for a final sigma
        cut = regex.split(r"\s+", text) if any(c in text for c in SEPARATORS) else text.split()
        return sum(map(self.words.__getitem__, cut))

    def count(self, text: str) -> int:
        if not any(m in text for m in self.marks):
            return self._plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self._plain, pieces))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text",
                 out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``out``: tokens of the whole text, without begin or end.

    White space always ends a token of this vocabulary, so counts are kept per word. NULL and empty texts count 0.
    A column named ``out`` is replaced, all others stay. Rows are independent: no shuffle.
    """
    content = file_broadcast(docs.sparkSession, vocabulary)
    kept = [c for c in docs.columns if c != out]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = built_once(TokenCounter, content.value)
        for rows, texts in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array([counter.count(t) if t else 0 for t in texts], pa.int64())], [*kept, out])

    return docs.select(*kept).mapInArrow(
        counted, docs.select(*kept).withColumn(out, F.lit(None).cast("long")).schema)


@query("op5_token_counts")
def token_counts(spark, sf_dir) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"))
