"""Cut a text where byte-level pre-tokenizers always cut it, into pieces that repeat often.

For a pattern whose matches start at a white-space character or not, but never
run over one into the next word, the text may be cut before each single space
between two other characters: the matches of the pieces are the matches of the
text. Texts with other white space than single spaces and line feeds are left
whole.
"""

from __future__ import annotations

from collections.abc import Callable

from threadloom.llm.arrow_rows import Memo

# White space by Unicode's White_Space property, without space and line feed.
OTHER_SPACE = ("\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
ASCII_SPACE = OTHER_SPACE[:4]
RUNS = ("  ", "\n ", " \n")
MARKS = frozenset(".,;:!?")
LONGEST = 64  # characters of a piece whose result is kept


def words(text: str) -> list[str] | None:
    """The pieces between single spaces; None if the text can't be cut there."""
    for c in ASCII_SPACE if text.isascii() else OTHER_SPACE:
        if c in text:
            return None
    for run in RUNS:
        if run in text:
            return None
    return text.split(" ")


class PieceEncoder:
    """Encodes texts by pieces and keeps the results of pieces in two generations.

    ``first`` encodes a list of pieces at the start of a text or of whole texts, ``later`` one of pieces that each
    follow a space. When the young generation holds ``most`` pieces it becomes the old one, and the one before is forgotten:
    frequent pieces stay. A mark after a letter, at the end of a piece, is always a match of its own, so such pieces
    are put together from two.
    """

    def __init__(self, first: Callable[[list[str]], list[bytes]], later: Callable[[list[str]], list[bytes]],
                 most: int = 300_000):
        self.first, self.later, self.most = first, later, most
        self.marks = Memo(lambda mark: first([mark])[0], len(MARKS) + 1)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, wanted: set[str]) -> None:
        young, old = self.young, self.old
        marked, plain = [], []
        for piece in wanted.difference(young):
            if len(piece) > LONGEST:
                continue
            if (known := old.get(piece)) is not None:
                young[piece] = known
            elif piece[-1:] in MARKS and piece[-2:-1].isalpha():
                marked.append(piece)
            else:
                plain.append(piece)
        bases = {p[:-1] for p in marked}
        extra = [p for p in bases.difference(plain) if p not in young and p not in old]
        young.update(zip(plain + extra, self.later(plain + extra), strict=True))
        for piece in marked:
            base = piece[:-1]
            young[piece] = (young[base] if base in young else old[base]) + self.marks[piece[-1]]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [words(t) for t in texts]
        self._learn(set().union(*[pieces[1:] for pieces in cut if pieces]))
        young, out = self.young, []
        first = self.first([t if pieces is None else pieces[0] for t, pieces in zip(texts, cut, strict=True)])
        for start, pieces in zip(first, cut, strict=True):
            if pieces is None:
                out.append(start)
                continue
            found = [young.get(p) for p in pieces[1:]]
            if None in found:  # long pieces are not kept
                found = [self.later([p])[0] if f is None else f for p, f in zip(pieces[1:], found, strict=True)]
            out.append(start + b"".join(found))
        if len(young) >= self.most:
            self.old, self.young = young, {}
        return out
