"""Running a caller-supplied annotator over prompts on the executors."""

from __future__ import annotations

import re
import traceback
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from threadloom.constants import (
    AUDIT, CORPUS_ROWS, MAX_ATTEMPTS, SEGMENT, SKIPPED, SLICE_ROWS, SWEEP_BATCH, UNKNOWN,
)
from threadloom.functions.text import flatten_newlines
from threadloom.operators.batching import assign_batches, corpus_prompts, gather_requests, slice_batch
from threadloom.operators.resolve import last_labels, resolve_slice, resolve_sweep
from threadloom.operators.responses import align, decode_items, decode_macro
from threadloom.session import new_path, stage_table

Annotator = Callable[[str], "str | None"]

# Error texts that mean the service is used up for now (fixed values).
QUOTA_WORDS = re.compile("quota|exhausted|429", re.IGNORECASE)
QUOTA_NOW = re.compile("daily", re.IGNORECASE)

CORPUS_IDENTIFIER = "MACRO_CORPUS_SLICE"

CALLED = "response string, attempts array<struct<attempt:int,output:string,error:string>>, status string"


@dataclass(frozen=True)
class Model:
    """How one annotator covers the rows.

    ``rows=None`` sweeps every row in batches of ``batch``; a number takes that
    many first rows of each segment as one batch. A model with an ``annotate``
    of None was not run at all. With ``waves`` above 1 the requests go out in
    waves, and none after one that met a used-up quota.
    """

    name: str
    annotate: Annotator | None
    rows: int | None = None
    batch: int = SWEEP_BATCH
    max_attempts: int = MAX_ATTEMPTS
    waves: int = 1

    @classmethod
    def slice(cls, name: str, annotate: Annotator | None, rows: int = SLICE_ROWS) -> "Model":
        return cls(name, annotate, rows)


def _attempts(annotate: Annotator, prompt: str, limit: int):
    """Call until it answers or ``limit`` is reached: (response, attempts, used_up)."""
    tries = []
    for n in range(1, limit + 1):
        try:
            text = annotate(prompt)
            tries.append({"attempt": n, "output": text, "error": None})
            return text, tries, False
        except Exception as e:  # the annotator's failure is data
            tries.append({"attempt": n, "output": "", "error": traceback.format_exc()})
            if QUOTA_WORDS.search(str(e)) and (QUOTA_NOW.search(str(e)) or n == limit):
                return None, tries, True
    return None, tries, False


def call_annotator(requests: DataFrame, model: Model, parallelism: int | None = None) -> DataFrame:
    """Add ``response``, ``attempts`` and ``status`` (ok | failed | unavailable) per prompt.

    ``parallelism`` is the number of tasks that call at the same time. A request
    whose annotator reports that its quota is used up is ``unavailable``; each
    request is tried by itself, so no outcome depends on which others share its
    task. A retried task calls again; stage the result before using it twice.
    """
    annotate, limit = model.annotate, model.max_attempts
    if parallelism:
        requests = requests.repartition(parallelism)

    def run(prompt):
        text, tries, used_up = _attempts(annotate, prompt, limit)
        return text, tries, "ok" if text is not None else "unavailable" if used_up else "failed"

    # prompts go to Python by the hundred and alone; a batch of Arrow would hold ten thousand with all their columns
    call = F.udf(run, CALLED, useArrow=False).asNondeterministic()
    called = requests.withColumn("__called", call("prompt"))
    return called.select(*[F.col(f"`{c}`") for c in requests.columns], "__called.*")


WAVES = 32


def call_in_waves(requests: DataFrame, model: Model, parallelism: int | None = None, waves: int = WAVES,
                  path: str | None = None) -> DataFrame:
    """``call_annotator`` in up to ``waves`` waves; once a request of one meets a used-up quota, no further one is sent.

    Each wave is written before its status is read, so no request is made twice and the decision is known to all that
    follow, on any executor. A request belongs to a wave by a hash of its prompt and members: repeats agree. Requests
    of the waves that were not sent are ``unavailable`` too, without response or attempts. The first wave is the
    smallest, each further one as large as all before: an annotator that is used up from the start is asked a
    ``2 ** (1 - waves)``-th of the requests, or one wave's worth of one request where there are few.
    """
    spark = requests.sparkSession
    path = path or new_path(spark, f"waves-{model.name}")
    rows = stage_table(requests, "requests", f"{path}/requests")
    share = F.pmod(F.xxhash64("prompt", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))), F.lit(1 << 62)) / (1 << 62)
    # doubling shares: wave 0 and 1 have the smallest, the last one half of all
    wave = F.greatest(F.lit(0), F.lit(waves) + F.ceil(F.log2(share)) - 1)
    rows = rows.withColumn("__wave", F.coalesce(wave, F.lit(0)).cast("int"))
    sent = []
    present = [r["__wave"] for r in rows.select("__wave").distinct().orderBy("__wave").collect()]  # at most ``waves``
    for at, n in enumerate(present):
        of_wave = rows.where(F.col("__wave") == n).drop("__wave")
        done = stage_table(call_annotator(of_wave, model, parallelism), "wave", f"{path}/wave={n}")
        sent.append(done)
        if not done.where("status = 'unavailable'").isEmpty():
            rest = rows.where(F.col("__wave").isin(present[at + 1:])).drop("__wave")
            sent.append(rest.select("*", F.lit(None).cast("string").alias("response"), F.array().cast(
                done.schema["attempts"].dataType).alias("attempts"), F.lit("unavailable").alias("status")))
            break
    return reduce(DataFrame.unionByName, sent) if sent else call_annotator(requests, model)


def audit_rows(called: DataFrame, model: str, identifiers: str | None = None,
               flatten: bool = True) -> DataFrame:
    """One audit row per attempt, in the five-column layout of the audit sheet.

    ``flatten`` puts every text on one line; without it texts stay as they are.
    """
    shown = flatten_newlines if flatten else lambda c: c
    ids = (
        F.concat(F.lit("['"), F.array_join("members", "', '"), F.lit("']"))
        if identifiers is None else F.lit(identifiers)
    )
    a = called.select(ids.alias("ids"), "prompt", F.explode("attempts").alias("a"))
    return a.select(
        shown(F.col("ids")).alias("input_text_identifiers"),
        shown(F.col("prompt")).alias("prompt_used"),
        F.lit(model).alias("model_api_used"),
        shown(F.coalesce("a.output", F.lit(""))).alias("generated_output"),
        F.coalesce(shown(F.col("a.error")), F.lit("None")).alias("errors_encountered"),
    )


def row_requests(rows: DataFrame, model: Model, batching: str = "exact") -> DataFrame:
    """Payload rows -> one request per batch of this model's coverage."""
    if model.rows is None:
        return gather_requests(assign_batches(rows, model.batch, mode=batching))
    return gather_requests(slice_batch(rows, model.rows))


def _called(requests: DataFrame, model: Model, parallelism: int | None, name: str, path: str | None) -> DataFrame:
    if model.waves > 1:
        return call_in_waves(requests, model, parallelism, model.waves, path)
    return stage_table(call_annotator(requests, model, parallelism), f"{name}-{model.name}", path)


@dataclass
class Annotated:
    labels: DataFrame
    audit: DataFrame
    responses: DataFrame


def annotate_rows(rows: DataFrame, model: Model, parallelism: int | None = None,
                  responses_path: str | None = None, batching: str = "exact") -> Annotated:
    """Labels of one model for every row of ``community, kind, id, text, ord``.

    The raw responses are staged in the shared folder (or at ``responses_path``)
    before decoding: they are the one costly, unrepeatable step.
    """
    base = rows.select(*SEGMENT, "id", "ord")
    if model.annotate is None:
        labels = base.select("*", *[F.lit(SKIPPED).alias(n) for n in ("sentiment", "toxicity", "topics")])
        return Annotated(labels.withColumn("model", F.lit(model.name)), None, None)
    called = _called(row_requests(rows, model, batching), model, parallelism, "responses", responses_path)
    # a batch the model never answered leaves its rows to the fill label
    tried = called.where("response <> ''") if model.rows is not None else called
    answered = decode_items(tried.select(*SEGMENT, "batch_no", "members", "response"))
    found = last_labels(align(answered, [*SEGMENT, "batch_no"]))
    if model.rows is None:
        labels = resolve_sweep(base, found, UNKNOWN)
    else:
        labels = resolve_slice(base, found, model.rows, SKIPPED)
    return Annotated(labels.withColumn("model", F.lit(model.name)), audit_rows(called, model.name), called)


def annotate_corpus(rows: DataFrame, model: Model, sample: int = CORPUS_ROWS,
                    responses_path: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(macro rows, audit rows): one request per segment over its first texts.

    A model that covers only a slice reports ``Skipped`` when it gave no answer;
    a sweeping model reports the default texts.
    """
    segments = corpus_prompts(rows, sample)
    if model.annotate is None:
        skipped = segments.select(*SEGMENT, F.lit(model.name).alias("model"),
                                  F.lit(SKIPPED).alias("summary"), F.lit(SKIPPED).alias("patterns"))
        return skipped, None
    called = _called(segments, model, None, "corpus", responses_path)
    out = decode_macro(called.select(*SEGMENT, F.lit(model.name).alias("model"), "response"))
    if model.rows is not None:
        nothing = F.coalesce("response", F.lit("")) == ""
        out = out.withColumns({c: F.when(nothing, SKIPPED).otherwise(F.col(c)) for c in ("summary", "patterns")})
    out = out.drop("response")
    return out, audit_rows(called, model.name, CORPUS_IDENTIFIER)


def annotate_all(rows: DataFrame, models: list[Model], parallelism: int | None = None,
                 batching: str = "exact") -> tuple[DataFrame, DataFrame]:
    """(annotations of all models, audit rows) for payload rows; the rows are staged once."""
    rows = stage_table(rows.select(*SEGMENT, "id", "text", "ord"), "payload")
    done = [annotate_rows(rows, m, parallelism, batching=batching) for m in models]
    labels = reduce(DataFrame.unionByName, [d.labels for d in done])
    audits = [d.audit for d in done if d.audit is not None]
    audit = reduce(DataFrame.unionByName, audits) if audits else rows.sparkSession.createDataFrame([], AUDIT)
    return labels, audit
