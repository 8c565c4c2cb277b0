"""Text expressions with the white-space and case rules of the Python originals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from threadloom.constants import DEFAULT_TARGET, MISSING_ID


# The characters that Python's str.strip() takes as white space (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A noncharacter, so it is in no valid text; with the blank it marks a word start.
WORD_MARK = "\uffff "


def utrim(c: Column) -> Column:
    """Strip all Unicode white space at both ends (SQL trim strips U+0020 only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def capitalize(c: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def title_case(c: Column) -> Column:
    """A new word starts after any uncased character: ``3d gen-z`` -> ``3D Gen-Z``.

    ``initcap`` starts words at blanks only, so each start gets a marked blank first.
    """
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    marked = F.regexp_replace(c, f"(?<!{cased})(?={cased})", WORD_MARK)
    return F.replace(F.initcap(marked), F.lit(WORD_MARK), F.lit(""))


def raw_topics(c: Column) -> Column:
    """Comma-separated topic text -> array of the texts between commas, as they are written."""
    return F.split(F.translate(c, "[]\"'", ""), ",")


def topic_tokens(c: Column) -> Column:
    """Comma-separated topic text -> array of title-cased tokens, blanks dropped."""
    tokens = F.transform(raw_topics(c), lambda t: utrim(title_case(t)))
    return F.filter(tokens, lambda t: t != "")


def post_text(title: Column, body: Column) -> Column:
    """Title, one blank, body; a missing side counts as empty and the blank stays."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def comment_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def id_text(c: Column) -> Column:
    """An id as text; a missing one reads ``nan``, so that its row keeps its place in prompts and lists."""
    return F.coalesce(utrim(c.cast("string")), F.lit(MISSING_ID))


def target_name(c: Column) -> Column:
    """Community name as typed by a user -> bare lower-case name, blank -> default."""
    given = F.coalesce(non_empty(utrim(c)), F.lit(DEFAULT_TARGET))
    return utrim(F.replace(F.lower(given), F.lit("r/"), F.lit("")))


def flatten_newlines(c: Column) -> Column:
    return F.replace(utrim(c), F.lit("\n"), F.lit(" "))


def pattern_cell(c: Column) -> Column:
    """Pattern separators as table-cell line breaks."""
    return F.replace(c, F.lit(" | "), F.lit("<br><br>"))


def percent(c: Column, digits: int) -> Column:
    """``57.78%``; a tie goes to the even digit, as in Python's formatting."""
    return F.concat(F.bround(c.cast("decimal(24,12)"), digits).cast("string"), F.lit("%"))
