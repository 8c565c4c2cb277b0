"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

All of it is column expressions; what comes to the driver are counts of vote and shape patterns, of which there are
a few thousand at most whatever the size of the table.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Row, functions as F

from threadloom.functions.bind import bind
from threadloom.llm.registry import documents, query

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Those that start with a run begin where the run does, or where the last match
# ended, and never give back what a run or group took: the same matches, in linear time and without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Other ways to write the same data: masked addresses, IPv6, and numbers that a base match swallowed or didn't reach.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++"
             r"(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Texts without any of these have no match: of the base patterns, and of the other forms.
HINTS = {"email": ("@",), "phone": ("+",)}
LOOSE_HINTS = {"email": ("at)", "at]", "at )", "at ]")}
BASE_FORM, FAILED_FORM, LOOSE_FORM = 0, 1, 2
# Gazetteers and cue words of the context labeler.
DOMAIN_ENDS = ("com org net edu gov mil int info biz io co us uk de fr es it nl be ch at pl se no fi dk pt eu ca au "
               "nz jp cn in br mx ru")
CUES = {"email": "e-?mail|mailto|contact|write to|correo|courriel", "ip": r"\bip\b|address|host|server|adresse",
        "card": "card|visa|master|credit|karte|carte|tarjeta", "phone": "phone|call|tel|mobile|fax|anruf|appel"}
COUNTER_CUES = "order|invoice|isbn|version|serial|build|sku|part no"
CUE_CHARS = 32
LABELERS = ("format", "gazetteer", "context")
SHAPES = ("form", "format", "gazetteer", "context", "before", "after", "digits")
EM_ROUNDS, PRIOR_WEIGHT, SMOOTHING, MIN_PROBABILITY = 30, 4.0, 2.0, 0.9
# How a labeler is taken to vote before any data: (no, abstain, yes) for a false and a true span.
PRIOR_VOTES = ((0.5, 0.3, 0.2), (0.1, 0.3, 0.6))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        digits = _digits(match)
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(_digits(match)).between(9, 15)
    return F.lit(True)


SPANS = "array<struct<start:int,end:int,match:string>>"


def _matches(text: Column, pattern: str, hints: tuple[str, ...] = ()) -> Column:
    """All matches with their places in code points: the texts between them tell how far apart they are."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
                       lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["m"])
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(F.struct(
            start.alias("start"), end.alias("end"), pair["m"].alias("match")))).alias("spans"))

    spans = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()),
                        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans")), add, lambda d: d["spans"])
    worth = text.rlike(pattern)
    if hints:
        some = text.contains(hints[0])
        for h in hints[1:]:
            some = some | text.contains(h)
        worth = some & worth
    return F.when(worth, spans).otherwise(F.array().cast(SPANS))


def _candidate(kind: int, span: Column, form: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                    span["match"].alias("match"), form.cast("int").alias("form"))


def _described(text: Column, c: Column) -> Column:
    """A candidate with the labelers' votes (-1, 0, 1) and its shape."""
    match, kind = c["match"], c["kind"]
    left = F.lower(F.substring(text, F.greatest(c["start"] - CUE_CHARS, F.lit(0)) + 1,
                               F.least(c["start"], F.lit(CUE_CHARS))))
    around = F.substring(text, F.greatest(c["start"], F.lit(1)), c["end"] - c["start"] + 2)

    def by_kind(values: dict[str, Column]) -> Column:
        out = F.lit(None)
        for name, value in values.items():
            out = F.when(kind == KINDS.index(name), value).otherwise(out)
        return out

    def vote(yes: Column) -> Column:
        return F.when(yes, 1).otherwise(-1)

    number = _digits(match)
    ends = "|".join(DOMAIN_ENDS.split())
    form_vote = by_kind({
        "email": vote(F.char_length(match) <= 254), "ip": vote((c["form"] == LOOSE_FORM) | _valid("ip", match)),
        "card": vote(_valid("card", match)), "phone": vote(F.char_length(number).between(9, 15))})
    gazetteer = by_kind({
        "email": vote(F.lower(match).rlike(rf"(?:\.|dot ?[\])] ?)(?:{ends})$")),
        "ip": F.when(c["form"] == LOOSE_FORM, 0).otherwise(vote(match.rlike(r"^0*(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."))),
        "card": vote(number.rlike("^[3-6]")), "phone": vote(number.rlike("^1?[2-9]|^[1-9][0-9]{10}"))})
    cue = by_kind({k: left.rlike(v) for k, v in CUES.items()})
    context = F.when(cue, 1).when(left.rlike(COUNTER_CUES), -1).otherwise(0)

    def side(ch: Column) -> Column:
        return F.when(ch == "", 0).when(ch.rlike(r"^\s$"), 1).when(ch.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)

    before = F.when(c["start"] == 0, F.lit("")).otherwise(F.substring(around, 1, 1))
    after = F.substring(text, c["end"] + 1, F.lit(1))
    return F.struct(
        kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["form"].alias("form"),
        form_vote.cast("int").alias("format"), gazetteer.cast("int").alias("gazetteer"),
        context.cast("int").alias("context"), side(before).cast("int").alias("before"),
        side(after).cast("int").alias("after"), F.least(F.floor(F.char_length(number) / 4), F.lit(5)).cast("int").alias("digits"))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... (so that no name can clash) and ``candidates``: spans that may be
    personal data: base matches, valid or not, and other forms.

    Candidates of other forms that touch a valid base span are left out.
    """
    text = F.col("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("text", F.coalesce(names[docs.columns.index(text_col)], F.lit("")))
    df = bind(rows, **{f"base_{k}": _matches(text, BASE[k], HINTS.get(k, ())) for k in KINDS},
              **{f"loose_{k}": _matches(text, LOOSE[k], LOOSE_HINTS.get(k, ())) for k in KINDS})

    def base(i: int, kind: str) -> Column:
        return F.transform(f"base_{kind}", lambda s: _candidate(
            i, s, F.when(_valid(kind, s["match"]), BASE_FORM).otherwise(FAILED_FORM)))

    def other(i: int, kind: str) -> Column:
        return F.transform(f"loose_{kind}", lambda s: _candidate(i, s, F.lit(LOOSE_FORM)))

    df = bind(df, base=F.concat(*[base(i, k) for i, k in enumerate(KINDS)]))
    valid = F.filter("base", lambda b: b["form"] == BASE_FORM)
    loose = F.concat(*[other(i, k) for i, k in enumerate(KINDS)])
    free = F.filter(loose, lambda s: ~F.exists(valid, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    df = bind(df, every=F.concat("base", free))
    return df.select(*names, F.transform("every", lambda c: _described(text, c)).alias("candidates"))


def pattern_counts(candidates: DataFrame) -> list[Row]:
    """How often each pattern of kind, votes and shape occurs. Summed before the shuffle; bounded by the patterns."""
    names = ["kind", *SHAPES]
    return candidates.select(F.inline("candidates")).groupBy(*names).agg(F.count("*").alias("n")).collect()


def estimate(counts: list[Row]) -> dict[int, dict[tuple, float]]:
    """Per kind: the probability that a span with some votes is personal data, by expectation-maximisation.

    Labelers are taken as independent given the truth. Their reliabilities start at ``PRIOR_VOTES``, which also
    weigh as ``PRIOR_WEIGHT`` spans in each round, so a labeler that always says the same can't take over.
    """
    votes: dict[int, dict[tuple, float]] = defaultdict(lambda: defaultdict(float))
    for r in counts:
        votes[r["kind"]][tuple(r[v] for v in LABELERS)] += r["n"]
    found = {}
    for kind, patterns in sorted(votes.items()):
        prior, tables = 0.5, [[list(t) for t in PRIOR_VOTES] for _ in LABELERS]
        for _ in range(EM_ROUNDS):
            belief = {}
            for p in sorted(patterns):
                true, false = prior, 1 - prior
                for table, v in zip(tables, p, strict=True):
                    true, false = true * table[1][v + 1], false * table[0][v + 1]
                belief[p] = true / (true + false)
            weight = sum(patterns.values())
            prior = (1 + sum(patterns[p] * b for p, b in belief.items())) / (2 + weight)
            for j, table in enumerate(tables):
                for y in (0, 1):
                    sums = [PRIOR_WEIGHT * q for q in PRIOR_VOTES[y]]
                    for p, b in belief.items():
                        sums[p[j] + 1] += patterns[p] * (b if y else 1 - b)
                    table[y] = [s / sum(sums) for s in sums]
        found[kind] = belief
    return found


def train(counts: list[Row]) -> dict[tuple, float]:
    """Weights of the span classifier: log odds per (kind, shape, value), learnt from the estimated probabilities.

    A value's odds count ``SMOOTHING`` more spans with the odds of the whole kind, so what was hardly seen, or seen in
    one class only because the other is all but empty, weighs next to nothing. Votes count ``PRIOR_WEIGHT`` spans of
    ``PRIOR_VOTES`` in either class instead, as they do for EM: a kind with a single span is judged by its votes.
    """
    belief = estimate(counts)
    sums: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for r in counts:
        p = belief[r["kind"]][tuple(r[v] for v in LABELERS)]
        for name in ("", *SHAPES):
            key = (r["kind"], name, r[name] if name else 0)
            sums[key][1] += r["n"] * p
            sums[key][0] += r["n"] * (1 - p)
    weights = {}
    for key, (no, yes) in sums.items():
        kind, name, value = key
        all_no, all_yes = (1 + n for n in sums[(kind, "", 0)])
        if not name:
            weights[key] = math.log(all_yes / all_no)
            continue
        if name in LABELERS:
            usual = [PRIOR_WEIGHT * votes[value + 1] for votes in PRIOR_VOTES]
            all_no, all_yes = all_no + PRIOR_WEIGHT, all_yes + PRIOR_WEIGHT
        else:
            usual = [SMOOTHING * n / (all_no + all_yes) for n in (all_no, all_yes)]
        weights[key] = math.log((yes + usual[1]) / (no + usual[0])) - math.log(all_yes / all_no)
    return weights


def _score(c: Column, weights: dict[tuple, float]) -> Column:
    """Log odds of a candidate; shapes that were not seen weigh nothing."""
    total = F.lit(0.0)
    for name in ("", *SHAPES):
        known = {(k, v): w for (k, n, v), w in sorted(weights.items()) if n == name}
        if known:
            table = F.create_map(*[F.lit(x) for (k, v), w in known.items() for x in (f"{k}/{v}", w)])
            value = c[name].cast("string") if name else F.lit("0")
            total = total + F.coalesce(table[F.concat_ws("/", c["kind"].cast("string"), value)], F.lit(0.0))
    return total


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "pii", weights: dict | None = None) -> DataFrame:
    """``docs`` with an array ``out`` of structs (start, kind, end, base), ordered; ends exclusive, in code points.

    Valid base matches are always spans. Other candidates are if they pass their own check (a card its checksum) and
    the classifier gives them a probability of ``MIN_PROBABILITY`` or more; it is trained on all of ``docs`` unless ``weights`` are given. ``kind`` counts from
    0 in the order of ``KINDS``. NULL and empty texts have no spans. A column named ``out`` is replaced, all others
    stay. The texts are read twice and never shuffled.
    """
    if weights is None:
        weights = train(pattern_counts(with_candidates(docs.select(text_col), text_col)))
    least = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
    good = F.filter("candidates", lambda c: (c["form"] == BASE_FORM) | (
        F.lit(bool(weights)) & (c["format"] == 1) & (_score(c, weights) >= least)))
    spans = F.array_sort(F.array_distinct(F.transform(good, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
        (c["form"] == BASE_FORM).alias("base")))))
    found = bind(with_candidates(docs, text_col), spans=spans)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out],
                        F.col("spans").alias(out))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def add(done: Column, s: Column) -> Column:
        fresh = F.concat(done["out"], F.array(
            F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.get(names, s["kind"])))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"))

    return F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), add,
        lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; columns unchanged, a NULL text stays NULL."""
    found = find_spans(docs, text_col, "__pii")
    return found.withColumn(text_col, F.when(F.size("__pii") > 0, redacted(F.col(text_col), F.col("__pii")))
                            .otherwise(F.col(text_col))).select(*docs.columns)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_pii")
def pii(spark, sf_dir) -> DataFrame:
    found = find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])

    def count(i: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long")

    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
