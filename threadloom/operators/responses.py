"""Annotator answers (JSON text) to labels. Every step is a projection: nothing is shuffled.

A map of variants keeps both the key order and the value types of an object;
the same map of strings keeps the raw text of nested values in document order.
A parser knows numbers by value only, so before parsing each number becomes a
marked string that keeps it as written, in lists and objects of any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.constants import DEFAULT_PATTERNS, DEFAULT_SUMMARY, UNKNOWN
from threadloom.functions.bind import bind, let
from threadloom.functions.text import utrim

LABELS = ("sentiment", "toxicity", "topics")
ITEMS = "array<struct<is_object:boolean,id:string,sentiment:string,toxicity:string,topics:string>>"


NUMBER_MARK = "\ue0c0#"
# A string, or a number that is a token of its own. The unrolled string takes long texts without recursion.
_TOKENS = (r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")'
           r"|(?<![\w.+-])(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+)(?![\w.+-])")
_OPEN, _CLOSE = "\x01", "\x02"  # no JSON text has them: they may stand in strings as escapes only


def mark_numbers(text: Column) -> Column:
    """JSON text with each number ``n`` as the string ``NUMBER_MARK n``; strings stay as they are."""
    clean = text.contains(_OPEN) | text.contains(_CLOSE)
    tokens = F.regexp_replace(text, _TOKENS, f"$1{_OPEN}$2{_CLOSE}")
    marked = F.replace(F.replace(F.replace(tokens, F.lit(_OPEN + _CLOSE), F.lit("")), F.lit(_OPEN), F.lit(f'"{NUMBER_MARK}')),
                       F.lit(_CLOSE), F.lit('"'))
    return F.when(clean, text).otherwise(marked)


def python_number(written: Column) -> Column:
    """A JSON number as Python reads and spells it: whole ones digit by digit, others by the shortest text of the double."""
    return F.when(~written.rlike("[.eE]"), F.when(written == "-0", "0").otherwise(written)).otherwise(
        let(written.try_cast("double"), _python_double))


def _python_double(d: Column) -> Column:
    def spelled(text: Column) -> Column:
        sign = F.when(text.startswith("-"), "-").otherwise("")
        power = F.regexp_extract(text, "e([+-][0-9]+)$", 1).try_cast("int")
        whole, rest = F.regexp_extract(text, r"^-?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]+)", 1)
        return let(F.struct(sign.alias("sign"), F.concat(whole, rest).alias("all"), (F.char_length(whole) + power).alias("at")), placed)

    def placed(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(p["all"], "^0+", ""), "0+$", "")
        at = p["at"] - F.char_length(F.regexp_extract(p["all"], "^0*", 0))  # digits before the point, or minus zeros after it
        return let(F.struct(p["sign"].alias("sign"), digits.alias("digits"), at.alias("at")), laid_out)

    def laid_out(p: Column) -> Column:
        digits, at, n = p["digits"], p["at"], F.char_length(p["digits"])
        cut = lambda start, length: F.substring(digits, start, length)
        plain = (F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
                 .when(at >= n, F.concat(digits, F.repeat(F.lit("0"), at - n), F.lit(".0")))
                 .otherwise(F.concat(cut(F.lit(1), at), F.lit("."), cut(at + 1, n))))
        tail = F.when(n > 1, F.concat(F.lit("."), cut(F.lit(2), n))).otherwise("")
        power = F.concat(F.when(at < 1, "-").otherwise("+"), F.lpad(F.abs(at - 1).cast("string"), F.greatest(
            F.lit(2), F.char_length(F.abs(at - 1).cast("string"))), F.lit("0")))
        text = F.when(n == 0, "0.0").when((at - 1).between(-4, 15), plain).otherwise(
            F.concat(cut(F.lit(1), F.lit(1)), tail, F.lit("e"), power))
        return F.concat(p["sign"], text)

    # the fewest digits that are read as the same double; a text of the double itself may have more
    shortest = F.get(F.filter(F.array(*[F.format_string(f"%.{k}e", d) for k in range(17)]),
                              lambda s: s.try_cast("double") == d), F.lit(0))
    return F.when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").otherwise(let(shortest, spelled))


def _type_is(v: Column, name: str) -> Column:
    return F.schema_of_variant(v).startswith(name)


def _values(text: Column) -> Column:
    """Values of a JSON object's fields in document order, as variants and as raw texts."""
    return F.struct(
        F.map_values(F.from_json(text, "map<string,variant>")).alias("typed"),
        F.map_values(F.from_json(text, "map<string,string>")).alias("raw"))


def _is_list(v: Column) -> Column:
    return F.coalesce(_type_is(v, "ARRAY"), F.lit(False))


def _holds_object(v: Column) -> Column:
    elements = F.try_variant_get(v, "$", "array<variant>")
    return _is_list(v) & F.coalesce(F.exists(elements, lambda e: _type_is(e, "OBJECT")), F.lit(False))


def _with_root(df: DataFrame, response: str) -> DataFrame:
    """Bind ``__root``: the response as exactly one JSON value (raw text), else NULL."""
    df = bind(df, __list=F.from_json(F.concat(F.lit("["), mark_numbers(F.col(response)), F.lit("]")), "array<string>"),
              __lead=F.substring(utrim(F.col(response)), 1, 1))
    return bind(df, __root=F.when(F.size("__list") == 1, F.get("__list", F.lit(0)))).drop("__list")


def _quoted(s: Column) -> Column:
    q = F.when(s.contains("'") & ~s.contains('"'), '"').otherwise("'")
    return F.concat(q, s, q)


def _scalar_text(v: Column) -> Column:
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(F.is_variant_null(v), "None")
        .when(_type_is(v, "BOOLEAN"), F.initcap(text))
        .when(text.startswith(NUMBER_MARK), let(F.substring(text, len(NUMBER_MARK) + 1, 1 << 30), python_number))
        .otherwise(text)
    )


def python_text(v: Column) -> Column:
    """A JSON value as Python's ``str`` spells it: None, True, ['a', 'b']; NULL stays NULL."""
    element = lambda e: F.when(
        _type_is(e, "STRING") & ~F.try_variant_get(e, "$", "string").startswith(NUMBER_MARK),
        let(F.try_variant_get(e, "$", "string"), _quoted)).otherwise(_scalar_text(e))
    listed = lambda x: F.concat(
        F.lit("["), F.array_join(F.transform(F.try_variant_get(x, "$", "array<variant>"), element), ", "),
        F.lit("]"))
    return let(v, lambda x: F.when(x.isNull(), None).when(_is_list(x), listed(x)).otherwise(_scalar_text(x)))


def _field(entries: Column, name: str) -> Column:
    """Value of the last entry with this key, NULL if absent."""
    return F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]


def _id_value(entries: Column, exact_first: bool) -> Column:
    """Text of the id-like field: the first whose key contains ``id``.

    With ``exact_first`` a key that is ``id`` or ends in ``_id`` / `` id`` wins
    over keys such as ``confidence``.
    """
    like = F.get(F.filter(entries, lambda e: e["key"].contains("id")), F.lit(0))["value"]
    found = like
    if exact_first:
        exact = F.get(F.filter(entries, lambda e: e["key"].rlike(r"(^|[_ ])id$")), F.lit(0))["value"]
        found = F.coalesce(exact, like)
    return utrim(python_text(found))


def decode_items(df: DataFrame, response: str = "response", out: str = "items",
                 legacy: bool = False) -> DataFrame:
    """Add ``out``: ``array<struct<is_object, id, sentiment, toxicity, topics>>`` from response text.

    An object yields its first list of objects, else itself as the only item; a
    list yields its elements; anything else yields no item. A label is NULL when
    its key is absent. ``legacy`` pins three oddities of the original: keys
    inside a wrapped list keep their case, any list field counts (also a list
    of topics), and the first key containing ``id`` is the id.
    """
    columns = [c for c in df.columns if c != out]
    lead = F.col("__lead")
    step = _with_root(df.select(*columns), response)
    step = bind(step, __fields=F.when(lead == "{", _values(F.col("__root"))))
    # an object with a repeated key is no variant; its raw text still shows the shape
    by_text = lambda t: F.coalesce(t.startswith("[") & (F.lit(legacy) | t.contains("{")), F.lit(False))
    wanted = F.coalesce(F.transform("__fields.typed", _is_list if legacy else _holds_object),
                        F.transform("__fields.raw", by_text))
    step = bind(step, __inner=F.get("__fields.raw", F.array_position(wanted, True).cast("int") - 1))
    step = bind(step, __items=(
        F.when(F.col("__inner").isNotNull(), F.col("__inner"))
        .when(lead == "{", F.concat(F.lit("["), "__root", F.lit("]")))
        .when(lead == "[", F.col("__root"))))
    key = lambda e: F.lower(e["key"])
    if legacy:
        key = lambda e: F.when(F.col("__inner").isNotNull(), e["key"]).otherwise(F.lower(e["key"]))
    fields = lambda text: F.transform(
        F.map_entries(F.from_json(text, "map<string,variant>")),
        lambda e: F.struct(key(e).alias("key"), e["value"].alias("value")))
    step = bind(step, __texts=F.from_json("__items", "array<string>"),
                __types=F.from_json("__items", "array<variant>"))
    is_object = lambda t, i: F.coalesce(
        _type_is(F.get("__types", i), "OBJECT"), F.col("__types").isNull() & t.startswith("{"))
    # an element that is no object has no fields
    step = bind(step, __pairs=F.transform("__texts", lambda t, i: F.when(is_object(t, i), fields(t))))
    item = lambda entries: F.struct(
        entries.isNotNull().alias("is_object"),
        _id_value(entries, not legacy).alias("id"),
        *[python_text(_field(entries, n)).alias(n) for n in LABELS])
    step = bind(step, **{out: F.coalesce(F.transform("__pairs", item), F.array().cast(ITEMS))})
    return step.select(*columns, out)


def align(requests: DataFrame, keep: list[str], members: str = "members", items: str = "items") -> DataFrame:
    """One row per batch member: ``keep..., pos, id, sentiment, toxicity, topics``.

    By key first, the last item with the member's id; then, when there are as
    many items as members, the item in the member's own place for members that
    no item named or that are Unknown throughout. Members and items share a
    row, so no join is needed; a batch has a handful of members.
    """
    unknown = F.lit(UNKNOWN)

    def label(it: Column) -> list[Column]:
        return [F.coalesce(it[n], unknown).alias(n) for n in LABELS]

    def place(m: Column, i: Column) -> Column:
        hits = F.filter(F.col(items), lambda it: it["is_object"] & (it["id"] == m) & (m != ""))
        return F.struct(
            i.cast("bigint").alias("pos"), m.alias("id"),
            F.try_element_at(hits, F.lit(-1)).alias("by_key"),
            F.get(F.col(items), i).alias("by_pos"),
        )

    rows = requests.select(
        *keep, (F.size(items) == F.size(members)).alias("same_size"),
        F.inline(F.transform(F.col(members), place)),
    )
    named = F.col("by_key").isNotNull()
    all_unknown = F.lit(True)
    for n in LABELS:
        all_unknown = all_unknown & (F.coalesce(F.col("by_key")[n], unknown) == unknown)
    use_pos = F.coalesce(
        F.col("same_size") & (~named | all_unknown) & F.col("by_pos.is_object"), F.lit(False))
    return rows.select(
        *keep, "pos", "id",
        *[F.when(use_pos, F.coalesce(F.col("by_pos")[n], unknown))
          .otherwise(F.coalesce(F.col("by_key")[n], unknown)).alias(n) for n in LABELS],
    )


def decode_macro(df: DataFrame, response: str = "response", summary_default: str = DEFAULT_SUMMARY,
                 patterns_default: str = DEFAULT_PATTERNS) -> DataFrame:
    """Add ``summary`` and ``patterns`` from response text; list patterns are joined by `` | ``."""
    columns = [c for c in df.columns if c not in ("summary", "patterns")]
    step = _with_root(df.select(*columns), response)
    lowered = F.transform(
        F.map_entries(F.from_json(F.when(F.col("__lead") == "{", F.col("__root")), "map<string,variant>")),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    step = bind(step, __fields=lowered)
    step = bind(step, __summary=_field(F.col("__fields"), "summary"),
                __patterns=_field(F.col("__fields"), "patterns"))
    patterns = F.col("__patterns")
    parts = F.transform(F.try_variant_get(patterns, "$", "array<variant>"), python_text)
    return step.select(
        *columns,
        F.coalesce(python_text(F.col("__summary")), F.lit(summary_default)).alias("summary"),
        F.coalesce(F.when(_is_list(patterns), F.array_join(parts, " | ")).otherwise(python_text(patterns)),
                   F.lit(patterns_default)).alias("patterns"))
