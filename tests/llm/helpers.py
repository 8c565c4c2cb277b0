"""Plain Python versions of the operators, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, __plan string"
SENTENCE = "the cat sat on the mat and the dog ran after the ball in the long green garden today again"


def awkward() -> list[tuple]:
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    random.seed(5)
    words = SENTENCE.split()
    texts = [None, "", " \t\n", "one", "one two three", "A b.c@d.ee +1 (988) 555-2485 4111111111111111 1.2.3.4", SENTENCE,
             SENTENCE.upper(), SENTENCE + " once", "\n".join([SENTENCE] * 3), "é 😀 ß\x1c x \xa0  y  z\r\n",
             "x" * 30_000, " ".join(random.choices(words, k=8000)), "| a | b | c | d |", "#### $$$$ %%%%",
             "<|endoftext|> <|startoftext|>", "12345", SENTENCE + " ", "the " * 40]
    texts += [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "ä", "src0")[i % 5] if i % 7 else "src0",
             None if i % 4 else 3, 7, "x", None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[0]]
    rows += [(None, "a text without an id but with quite a few words in it to count", None, None, None, None, None, None)]
    return rows


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None, width: int) -> set[tuple]:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def jaccard_classes(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int, int]]:
    """id: (number of shingles, component, links), for distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    links = {i: [j for j in sets if j != i and sets[i] and sets[j]
                 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        out[i] = (len(sets[i]), min(seen), len(links[i]))
    return out


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text: str | None) -> list[str]:
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}
            if good[kind]():
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [f[2] for f in sorted(found)]


def repeat_words(w: list[str]) -> int:
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    counts, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 5))
    return len(covered)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
