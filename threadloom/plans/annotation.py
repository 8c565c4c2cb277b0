"""Payloads, batches, prompts, answers, labels on rows, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators.annotate import (
    Model, annotate_all, annotate_corpus, annotate_rows, audit_rows, call_annotator, row_requests,
)
from threadloom.operators.batching import assign_batches, corpus_prompts, gather_requests, post_payload
from threadloom.operators.resolve import coverage, last_labels, resolve_slice, resolve_sweep
from threadloom.operators.responses import align, decode_items, decode_macro
from threadloom.plans import bindings as b
from threadloom.plans import rules
from threadloom.plans.registry import query
from threadloom.session import ship_package

SEG = ["community", "kind"]


@query("row_payload_text", f"""WITH {b.POSTS}
  SELECT community, 'posts' AS kind, post_id AS id,
         CASE WHEN ord % 3 = 0 THEN '' ELSE title END || ' ' || CASE WHEN ord % 4 = 0 THEN '' ELSE body END
         AS text, ord FROM posts""")
def _(spark, sf):
    k = F.col("ord")
    return post_payload(b.posts(spark, sf).withColumns({
        "post_id": F.concat(F.lit("\t "), "post_id", F.lit("  ")),
        "title": F.when(k % 3 != 0, F.col("title")), "body": F.when(k % 4 != 0, F.col("body"))}))


_BATCHED = f"""{b.PAYLOAD}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY ord) - 1 AS nth FROM payload),
  batched AS (
    SELECT community, kind, id, text, ord, CAST(floor(nth / 5) AS BIGINT) AS batch_no, nth % 5 AS pos FROM placed)"""


@query("batch_assign", f"WITH {_BATCHED} SELECT community, kind, id, ord, batch_no, pos FROM batched")
def _(spark, sf):
    return assign_batches(b.payload(spark, sf).drop("text"))


@query("batch_assign_small_blocks", f"WITH {_BATCHED} SELECT community, kind, id, ord, batch_no, pos FROM batched")
def _(spark, sf):
    return assign_batches(b.payload(spark, sf).drop("text"), block=7)


@query("batch_assign_partition", f"""WITH {b.PAYLOAD}, placed AS (
    SELECT *, CAST(floor(ord / 64) AS BIGINT) AS block,
           row_number() OVER (PARTITION BY community, kind, CAST(floor(ord / 64) AS BIGINT) ORDER BY ord) - 1 AS nth
    FROM payload)
  SELECT community, kind, id, ord, block, block * 13 + CAST(floor(nth / 5) AS BIGINT) AS batch_no, nth % 5 AS pos
  FROM placed""")
def _(spark, sf):
    return assign_batches(b.payload(spark, sf).drop("text"), mode="partition", block=64)


@query("row_prompts", f"""WITH {_BATCHED.replace(b.PAYLOAD, b.GAPPY_PAYLOAD)}
  SELECT community, kind, batch_no, string_agg(id, ',' ORDER BY pos) AS members,
         'Items:' || chr(10) || string_agg('ID: ' || id || ' | Text: ' || text || chr(10), '' ORDER BY pos) AS prompt
  FROM batched GROUP BY community, kind, batch_no""")
def _(spark, sf):
    r = gather_requests(assign_batches(b.gappy_payload(spark, sf)), header="Items:\n")
    return r.withColumn("members", F.array_join("members", ","))


@query("corpus_prompt", f"""WITH {b.PAYLOAD}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY ord) - 1 AS nth FROM payload)
  SELECT community, kind, 'Sample:' || chr(10)
         || string_agg('Content block [' || nth || ']: ' || text, chr(10) ORDER BY nth) AS prompt
  FROM placed WHERE nth < 25 GROUP BY community, kind""")
def _(spark, sf):
    return corpus_prompts(b.payload(spark, sf), header="Sample:\n")


# --- answers ------------------------------------------------------------------------------


def _answers(spark, sf):
    """One answer per document in eight shapes, by ``doc_id`` modulo 8."""
    d = b.table(spark, sf, "documents").select("doc_id", "lang")
    i = F.concat(F.lit("t3_"), F.col("doc_id").cast("string"))
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = [
        c('{"results":[{"id":"', i, '","sentiment":"Neutral","toxicity":"Low","topics":"a, ', F.col("lang"), '"}]}'),
        c('[{"ID":"', i, '","Sentiment":"Positive"}]'),
        c('{"id":"', i, '","topics":["x","', F.col("lang"), '"]}'),
        c('{"Results":[{"sentiment":null,"toxicity":true},{"confidence":0.9,"id":" ', i, ' "}]}'),
        c("oops ", F.col("lang")),
        c('{"results":["x"]}'),
        c('{"id":"', i, '"} trailing'),
        c('{"meta":{"n":1},"items":[{"post_id":"', i, '","topics":"z"}],"more":[1]}'),
    ]
    return d.select("doc_id", b._case_columns(F.col("doc_id") % 8, *shapes).alias("response"))


@query("response_decode", """WITH e AS (
    SELECT doc_id, doc_id % 8 AS k, 't3_' || doc_id AS i, lang FROM documents)
  SELECT doc_id, CAST(0 AS BIGINT) AS pos, true AS is_object,
         CASE WHEN k IN (0, 1, 2, 7) THEN i END AS id,
         CASE k WHEN 0 THEN 'Neutral' WHEN 1 THEN 'Positive' WHEN 3 THEN 'None' END AS sentiment,
         CASE k WHEN 0 THEN 'Low' WHEN 3 THEN 'True' END AS toxicity,
         CASE k WHEN 0 THEN 'a, ' || lang WHEN 2 THEN '[''x'', ''' || lang || ''']' WHEN 7 THEN 'z' END AS topics
  FROM e WHERE k NOT IN (4, 6)
  UNION ALL SELECT doc_id, 1, true, i, NULL, NULL, NULL FROM e WHERE k = 3""")
def _(spark, sf):
    items = decode_items(_answers(spark, sf)).select("doc_id", F.posexplode("items").alias("pos", "item"))
    return items.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "item.*")


def _requests(spark, sf):
    return gather_requests(assign_batches(b.payload(spark, sf))).drop("prompt")


def _json_list(items):
    return F.concat(F.lit('{"results":['), F.array_join(items, ","), F.lit("]}"))


def _aligned(requests, response):
    return align(decode_items(requests.withColumn("response", response)), [*SEG, "batch_no"])


_SIZED = f"""{_BATCHED}, sized AS (
    SELECT *, count(*) OVER (PARTITION BY community, kind, batch_no) AS n FROM batched)"""


@query("align_by_key", f"""WITH {_SIZED}
  SELECT community, kind, batch_no, pos, id,
         CASE WHEN batch_no % 2 = 0 THEN 'Positive' WHEN pos = n - 1 THEN 'Negative'
              WHEN pos = 0 THEN 'Unknown' ELSE 'Positive' END AS sentiment,
         'Unknown' AS toxicity,
         CASE WHEN batch_no % 2 = 0 THEN id WHEN pos = n - 1 THEN 'again'
              WHEN pos = 0 THEN 'Unknown' ELSE id END AS topics
  FROM sized""")
def _(spark, sf):
    """Even batches answer in reverse order; odd ones leave out the first member and repeat the last."""
    r = _requests(spark, sf)
    item = lambda m: F.concat(F.lit('{"id":"'), m, F.lit('","sentiment":"Positive","topics":"'), m, F.lit('"}'))
    again = F.concat(F.lit('{"id":"'), F.element_at("members", -1),
                     F.lit('","sentiment":"Negative","topics":"again"}'))
    odd = F.concat(F.transform(F.slice("members", F.lit(2), F.size("members")), item), F.array(again, again))
    even = F.transform(F.reverse("members"), item)
    return _aligned(r, _json_list(F.when(F.col("batch_no") % 2 == 0, even).otherwise(odd)))


@query("align_by_position", f"""WITH {_SIZED}
  SELECT community, kind, batch_no, pos, id,
         CASE WHEN batch_no % 2 = 0 THEN 'Neutral' ELSE 'Unknown' END AS sentiment,
         'Unknown' AS toxicity,
         CASE WHEN batch_no % 2 = 0 THEN 'place ' || pos ELSE 'Unknown' END AS topics
  FROM sized""")
def _(spark, sf):
    """No ids in the answers; odd batches answer with one item too many."""
    r = _requests(spark, sf)
    places = F.sequence(F.lit(0), F.size("members") - 1 + (F.col("batch_no") % 2).cast("int"))
    item = lambda p: F.concat(F.lit('{"sentiment":"Neutral","topics":"place '), p.cast("string"), F.lit('"}'))
    return _aligned(r, _json_list(F.transform(places, item)))


@query("macro_decode", """SELECT doc_id,
    CASE doc_id % 6 WHEN 0 THEN 'about ' || lang WHEN 1 THEN 'No summary generated.' WHEN 2 THEN 'None'
         ELSE 'No summary generated.' END AS summary,
    CASE doc_id % 6 WHEN 0 THEN 'p1 | ' || source || ' | None' WHEN 1 THEN 'only ' || lang
         ELSE 'No patterns identified.' END AS patterns FROM documents""")
def _(spark, sf):
    d = b.table(spark, sf, "documents")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    response = b._case_columns(
        F.col("doc_id") % 6,
        c('{"summary":"about ', F.col("lang"), '","patterns":["p1","', F.col("source"), '",null]}'),
        c('{"Patterns":"only ', F.col("lang"), '"}'),
        c('{"summary":null}'), c("[1]"), c("not json"))
    return decode_macro(d.select("doc_id", response.alias("response"))).drop("response")


# --- labels on rows ------------------------------------------------------------------------


def _found(spark, sf):
    """Labels of some posts, as they come out of two overlapping batches."""
    lab = b.labelled(spark, sf).withColumn("topics", F.lit("t"))
    first = lab.withColumns({"batch_no": F.lit(0).cast("bigint"), "pos": F.col("ord")})
    again = first.where("ord % 2 = 0").withColumns({"batch_no": F.lit(1).cast("bigint"), "topics": F.lit("again")})
    return last_labels(first.unionByName(again))


_RESOLVED = f"""{b.PAYLOAD}, {b.LABELLED}, resolved AS (
    SELECT p.community, p.kind, p.id, p.ord,
           row_number() OVER (PARTITION BY p.community, p.kind ORDER BY p.ord) - 1 AS nth,
           l.id IS NOT NULL AS known, l.sentiment, l.toxicity,
           CASE WHEN l.ord % 2 = 0 THEN 'again' ELSE 't' END AS topics
    FROM payload p LEFT JOIN labelled l ON l.community = p.community AND l.kind = p.kind AND l.id = p.id)"""


@query("resolve_full_sweep", f"""WITH {_RESOLVED}
  SELECT community, kind, id, ord, coalesce(sentiment, 'Unknown') AS sentiment,
         coalesce(toxicity, 'Unknown') AS toxicity, CASE WHEN known THEN topics ELSE 'Unknown' END AS topics
  FROM resolved""")
def _(spark, sf):
    return resolve_sweep(b.payload(spark, sf).drop("text"), _found(spark, sf))


_SLICE = f"""{_RESOLVED}, sliced AS (
    SELECT community, kind, id, ord,
           CASE WHEN nth < 45 THEN coalesce(sentiment, 'Skipped') ELSE 'Skipped' END AS sentiment,
           CASE WHEN nth < 45 THEN coalesce(toxicity, 'Skipped') ELSE 'Skipped' END AS toxicity,
           CASE WHEN nth < 45 AND known THEN topics ELSE 'Skipped' END AS topics
    FROM resolved)"""


@query("resolve_slice", f"WITH {_SLICE} SELECT * FROM sliced")
def _(spark, sf):
    return resolve_slice(b.payload(spark, sf).drop("text"), _found(spark, sf))


@query("coverage_counts", f"""WITH {_SLICE}
  SELECT community, kind, count(*) AS rows,
         CAST(sum(CASE WHEN sentiment = 'Skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped,
         CAST(sum(CASE WHEN sentiment = 'Unknown' THEN 1 ELSE 0 END) AS BIGINT) AS unknown,
         CAST(sum(CASE WHEN sentiment NOT IN ('Skipped', 'Unknown') THEN 1 ELSE 0 END) AS BIGINT) AS labelled
  FROM sliced GROUP BY community, kind""")
def _(spark, sf):
    return coverage(resolve_slice(b.payload(spark, sf).drop("text"), _found(spark, sf)))


# --- the annotator stage ------------------------------------------------------------------------

_RULE = """CASE length(text) % 3 WHEN 0 THEN 'Positive' WHEN 1 THEN 'Negative' ELSE 'Neutral' END"""
_TOX = """CASE length(text) % 4 % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END"""


@query("response_numbers", """SELECT doc_id AS batch_id, 0 AS pos, doc_id || '.0' AS id, 'inf' AS sentiment,
  CASE doc_id % 2 WHEN 0 THEN '-0.0' ELSE '1e+16' END AS toxicity,
  '[' || coalesce(n_chars, 0) || ', 1.5, ''x'', 100000.0]' AS topics FROM documents""")
def _(spark, sf):
    """Ids and labels that are numbers, alone and in lists, come out as Python spells them."""
    k = F.col("doc_id").cast("string")
    odd = F.when(F.col("doc_id") % 2 == 0, "-0.0").otherwise("1E16")
    rows = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("batch_id"), F.array(F.concat(k, F.lit(".0"))).alias("members"),
        F.concat(F.lit('{"results": [{"id": '), k, F.lit('.0, "sentiment": 1e400, "toxicity": '), odd, F.lit(', "topics": ['),
                 F.coalesce(F.col("n_chars"), F.lit(0)).cast("string"), F.lit(', 1.50, "x", 1e5]}]}')).alias("response"))
    return align(decode_items(rows), ["batch_id"])


@query("annotate_until_used_up", """SELECT source AS community, 'posts' AS kind, doc_id::VARCHAR AS id, doc_id AS ord,
  'm' AS model, 'Skipped' AS sentiment, 'Skipped' AS toxicity, 'Skipped' AS topics FROM documents""")
def _(spark, sf):
    """A slice model whose quota is used up from the start: one wave goes out, all rows are skipped."""
    ship_package(spark)
    rows = b.table(spark, sf, "documents").select(
        F.col("source").alias("community"), F.lit("posts").alias("kind"), F.col("doc_id").cast("string").alias("id"),
        "text", F.col("doc_id").alias("ord"))
    return annotate_rows(rows, Model("m", rules.used_up, rows=45, waves=8)).labels


@query("annotate_rows_rule", f"""WITH {b.PAYLOAD}
  SELECT community, kind, id, ord, 'groq' AS model, {_RULE} AS sentiment, {_TOX} AS toxicity,
         'len ' || length(text) AS topics FROM payload""")
def _(spark, sf):
    ship_package(spark)
    return annotate_rows(b.payload(spark, sf), Model("groq", rules.by_length)).labels


@query("annotate_slice_rule", f"""WITH {b.PAYLOAD}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY ord) AS nth FROM payload)
  SELECT community, kind, id, ord, 'gemini' AS model,
         CASE WHEN nth <= 45 THEN {_RULE} ELSE 'Skipped' END AS sentiment,
         CASE WHEN nth <= 45 THEN {_TOX} ELSE 'Skipped' END AS toxicity,
         CASE WHEN nth <= 45 THEN 'len ' || length(text) ELSE 'Skipped' END AS topics FROM placed""")
def _(spark, sf):
    ship_package(spark)
    return annotate_rows(b.payload(spark, sf), Model.slice("gemini", rules.by_length)).labels


@query("annotate_with_failures", f"""WITH {_BATCHED}, judged AS (
    SELECT *, length(first_value(id) OVER (PARTITION BY community, kind, batch_no ORDER BY pos)) % 3 = 0 AS lost
    FROM batched)
  SELECT community, kind, id, ord, 'groq' AS model, CASE WHEN lost THEN 'Unknown' ELSE {_RULE} END AS sentiment,
         CASE WHEN lost THEN 'Unknown' ELSE {_TOX} END AS toxicity,
         CASE WHEN lost THEN 'Unknown' ELSE 'len ' || length(text) END AS topics FROM judged""")
def _(spark, sf):
    ship_package(spark)
    return annotate_rows(b.payload(spark, sf), Model("groq", rules.failing_by_id)).labels


@query("annotate_all_models", f"""WITH {b.PAYLOAD}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY ord) AS nth FROM payload)
  SELECT community, kind, id, ord, 'groq' AS model, {_RULE} AS sentiment, {_TOX} AS toxicity FROM placed
  UNION ALL
  SELECT community, kind, id, ord, 'gemini', CASE WHEN nth <= 45 THEN {_RULE} ELSE 'Skipped' END,
         CASE WHEN nth <= 45 THEN {_TOX} ELSE 'Skipped' END FROM placed""")
def _(spark, sf):
    ship_package(spark)
    models = [Model("groq", rules.by_length), Model.slice("gemini", rules.by_length)]
    return annotate_all(b.payload(spark, sf), models)[0].drop("topics")


@query("annotate_not_run", f"""WITH {b.PAYLOAD}
  SELECT community, kind, id, ord, 'gemini' AS model, 'Skipped' AS sentiment, 'Skipped' AS toxicity,
         'Skipped' AS topics FROM payload""")
def _(spark, sf):
    return annotate_rows(b.payload(spark, sf), Model.slice("gemini", None)).labels


@query("audit_log", f"""WITH {_BATCHED.replace(b.PAYLOAD, b.GAPPY_PAYLOAD)}, b AS (
    SELECT community, kind, batch_no, '[''' || string_agg(id, ''', ''' ORDER BY pos) || ''']' AS ids,
           length(min(CASE WHEN pos = 0 THEN id END)) % 3 = 0 AS lost,
           replace(trim('Label: ' || string_agg('ID: ' || id || ' | Text: ' || text || chr(10), '' ORDER BY pos),
                        ' ' || chr(10) || chr(9) || chr(13)), chr(10), ' ') AS prompt
    FROM batched GROUP BY community, kind, batch_no),
  tries AS (SELECT *, unnest(CASE WHEN lost THEN [1, 2, 3] ELSE [1] END) AS attempt FROM b)
  SELECT ids AS input_text_identifiers, prompt AS prompt_used, 'groq' AS model_api_used,
         CASE WHEN lost THEN '' ELSE 'answer' END AS generated_output,
         CASE WHEN lost THEN 'error' ELSE 'None' END AS errors_encountered FROM tries""")
def _(spark, sf):
    """Audit content; the answer and the error trace are reduced to their presence."""
    ship_package(spark)
    model = Model("groq", rules.failing_by_id)
    requests = gather_requests(assign_batches(b.gappy_payload(spark, sf)), header="Label: ")
    # the first item starts in the header's line, so the rule must see a line start
    requests = requests.withColumn("shown", F.col("prompt")).withColumn(
        "prompt", F.replace("prompt", F.lit("Label: "), F.lit("Label:\n")))
    called = call_annotator(requests, model).withColumn("prompt", F.col("shown"))
    return audit_rows(called, model.name).withColumns({
        "generated_output": F.when(F.col("generated_output") != "", "answer").otherwise(""),
        "errors_encountered": F.when(F.col("errors_encountered") == "None", "None").otherwise("error")})


@query("annotate_corpus_rule", f"""WITH {b.PAYLOAD}, placed AS (
    SELECT *, row_number() OVER (PARTITION BY community, kind ORDER BY ord) - 1 AS nth FROM payload),
  corpus AS (
    SELECT community, kind, count(*) AS blocks,
           length(string_agg('Content block [' || nth || ']: ' || text, chr(10) ORDER BY nth)) AS len
    FROM placed WHERE nth < 25 GROUP BY community, kind)
  SELECT community, kind, 'groq' AS model, blocks || ' blocks' AS summary,
         'a | ' || len || ' characters | c' AS patterns FROM corpus""")
def _(spark, sf):
    ship_package(spark)
    return annotate_corpus(b.payload(spark, sf), Model("groq", rules.corpus_length))[0]


@query("annotate_corpus_failed", f"""WITH {b.PAYLOAD}
  SELECT DISTINCT community, kind, 'gemini' AS model, 'Skipped' AS summary, 'Skipped' AS patterns FROM payload""")
def _(spark, sf):
    ship_package(spark)

    def fails(prompt):
        raise RuntimeError("429 daily quota")

    return annotate_corpus(b.payload(spark, sf), Model.slice("gemini", fails))[0]


@query("requests_per_model", f"""WITH {_BATCHED}
  SELECT community, kind, 'groq' AS model, count(DISTINCT batch_no) AS requests, count(*) AS rows
  FROM batched GROUP BY community, kind
  UNION ALL SELECT community, kind, 'gemini', 1, least(count(*), 45) FROM batched GROUP BY community, kind""")
def _(spark, sf):
    rows = b.payload(spark, sf)
    one = lambda m: row_requests(rows, m).groupBy(*SEG).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.size("members")).alias("rows")).select(
        *SEG, F.lit(m.name).alias("model"), "requests", "rows")
    return one(Model("groq", rules.by_length)).unionByName(one(Model.slice("gemini", rules.by_length)))
