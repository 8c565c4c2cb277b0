"""Deterministic annotators for the registered queries, tests and benchmarks."""

from __future__ import annotations

import json
import re

_ITEM = re.compile(r"^ID: (\S+) \| Text: ", re.MULTILINE)
SENTIMENT = ("Positive", "Negative", "Neutral")
TOXICITY = ("Low", "Medium", "High")


def prompt_items(prompt: str) -> list[tuple[str, str]]:
    """(id, text) of every item line of a row prompt."""
    starts = list(_ITEM.finditer(prompt))
    ends = [m.start() for m in starts[1:]] + [len(prompt)]
    return [(m.group(1), prompt[m.end():end - 1]) for m, end in zip(starts, ends)]


def by_length(prompt: str) -> str:
    """Labels by text length."""
    return json.dumps({"results": [
        {"id": i, "sentiment": SENTIMENT[len(t) % 3], "toxicity": TOXICITY[len(t) % 4 % 3],
         "topics": f"len {len(t)}"}
        for i, t in prompt_items(prompt)]})


def failing_by_id(prompt: str) -> str:
    """Fails for good when the length of the first id is a multiple of three."""
    if len(prompt_items(prompt)[0][0]) % 3 == 0:
        raise ValueError("no answer for this batch")
    return by_length(prompt)


def corpus_length(prompt: str) -> str:
    """Summary of a macro prompt: how many sample blocks it has, and its length."""
    body = prompt.split("Sample:\n", 1)[1]
    blocks = len(re.findall(r"^Content block \[\d+\]: ", body, re.MULTILINE))
    return json.dumps({"Summary": f"{blocks} blocks", "patterns": ["a", f"{len(body)} characters", "c"]})


def used_up(prompt: str) -> str:
    """A service whose quota of the day is used up."""
    raise RuntimeError("429 daily quota exhausted")
