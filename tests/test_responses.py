import json

from hypothesis import HealthCheck, given, settings, strategies as st

from threadloom.operators.responses import align, decode_items, decode_macro

U = "Unknown"


def decoded(frame, response, legacy=False):
    df = decode_items(frame([(response,)], "response string"), legacy=legacy)
    return [tuple(i) for i in df.first()["items"]]


def aligned(frame, response, members, legacy=False):
    df = decode_items(frame([(1, members, response)], "b bigint, members array<string>, response string"), legacy=legacy)
    return [tuple(r[2:]) for r in align(df, ["b"]).orderBy("pos").collect()]


def test_shapes(frame):
    full = {"id": "a", "sentiment": "Neutral", "toxicity": "Low", "topics": "x, y"}
    row = (True, "a", "Neutral", "Low", "x, y")
    assert decoded(frame, json.dumps({"results": [full]})) == [row]
    assert decoded(frame, "  " + json.dumps([full]) + "\n") == [row]
    assert decoded(frame, json.dumps(full)) == [row]
    assert decoded(frame, json.dumps([{"ID": "a", "Sentiment": "Neutral"}])) == [(True, "a", "Neutral", None, None)]
    assert decoded(frame, json.dumps({"first": [1], "second": [full]})) == [row]
    assert decoded(frame, json.dumps({"id": "a", "topics": ["x", "o'y"]})) == [(True, "a", None, None, str(["x", "o'y"]))]
    assert decoded(frame, json.dumps({"results": [full, "x", None, 3]}))[1:] == [(False, None, None, None, None)] * 3
    for bad in ("", None, "null", "3", "oops", '{"a":1} trailing', "[1", "[]", '"text"'):
        assert decoded(frame, bad) == []


def test_id_key(frame):
    one = lambda d, legacy=False: decoded(frame, json.dumps({"results": [d]}), legacy)[0][1]
    assert one({"confidence": 0.9, "id": " a "}) == "a"
    assert one({"confidence": 0.9, "id": "a"}, legacy=True) == "0.9"
    assert one({"toxidity": "Low", "post ID": "b"}) == "b"
    assert one({"identifier": "c"}) == "c"
    assert one({"name": "c"}) is None
    assert one({"id": 7}) == "7"


def test_legacy_keeps_key_case_of_wrapped_items(frame):
    wrapped = json.dumps({"Results": [{"ID": "a", "Sentiment": "Neutral"}]})
    assert decoded(frame, wrapped) == [(True, "a", "Neutral", None, None)]
    assert decoded(frame, wrapped, legacy=True) == [(True, None, None, None, None)]
    bare = json.dumps([{"ID": "a", "Sentiment": "Neutral"}])
    assert decoded(frame, bare, legacy=True) == [(True, "a", "Neutral", None, None)]
    lone = json.dumps({"id": "a", "topics": ["x"]})
    assert decoded(frame, lone, legacy=True) == [(False, None, None, None, None)]


def test_values_read_like_python_text(frame):
    item = {"id": "a", "sentiment": None, "toxicity": True, "topics": ["a", None, False, 2]}
    assert decoded(frame, json.dumps([item])) == [(True, "a", "None", "True", str(["a", None, False, 2]))]


def test_duplicate_keys_last_wins(frame):
    twice = '{"id":"a","sentiment":"x","sentiment":"y"}'
    for response in (f"[{twice}]", twice, f'{{"results":[{twice}]}}'):
        assert decoded(frame, response) == [(True, "a", "y", None, None)]


def test_last_item_of_an_id_wins_and_unknown_ids_are_ignored(frame):
    response = json.dumps({"results": [
        {"id": "b", "sentiment": "1"}, {"id": "zzz", "sentiment": "2"}, {"id": "b", "sentiment": "3"}]})
    assert aligned(frame, response, ["a", "b"]) == [("a", U, U, U), ("b", "3", U, U)]


def test_position_fills_unmatched_members(frame):
    response = json.dumps({"results": [{"sentiment": "1"}, {"id": "b", "sentiment": "2"}]})
    assert aligned(frame, response, ["a", "b"]) == [("a", "1", U, U), ("b", "2", U, U)]
    assert aligned(frame, json.dumps([{"sentiment": "1"}]), ["a", "b"]) == [("a", U, U, U), ("b", U, U, U)]
    assert aligned(frame, None, ["a"]) == [("a", U, U, U)]


def expected_labels(items, members, place):
    """What one member gets: its own last item, unless that says nothing and its place has one."""
    read = lambda it: tuple(str(it[k]) if k in it else U for k in ("sentiment", "toxicity", "topics"))
    own = [read(it) for it in items if isinstance(it, dict) and str(it.get("id", "")).strip() == members[place]]
    by_key = own[-1] if own else (U, U, U)
    placed = items[place] if len(items) == len(members) else None
    return read(placed) if by_key == (U, U, U) and isinstance(placed, dict) else by_key


ITEM = st.one_of(
    st.fixed_dictionaries({}, optional={
        "id": st.sampled_from(["a", "b", " c ", "d", "zz"]), "sentiment": st.sampled_from(["Neutral", "Unknown"]),
        "topics": st.sampled_from(["x", "y, z"])}),
    st.sampled_from(["text", 5]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(ITEM, min_size=1, max_size=5), st.integers(1, 4)), min_size=3, max_size=12))
def test_align_matches_the_rules(spark, batches):
    batches = [(items, n) for items, n in batches if any(isinstance(i, dict) for i in items)]
    rows = [(k, list("abcd")[:n], json.dumps({"results": items})) for k, (items, n) in enumerate(batches)]
    df = spark.createDataFrame(rows, "b bigint, members array<string>, response string")
    got = {}
    for r in align(decode_items(df), ["b"]).collect():
        got.setdefault(r.b, []).append((r.pos, (r.id, r.sentiment, r.toxicity, r.topics)))
    for k, (items, n) in enumerate(batches):
        members = list("abcd")[:n]
        assert [v for _, v in sorted(got[k])] == [
            (m, *expected_labels(items, members, i)) for i, m in enumerate(members)]


def test_macro(frame):
    def macro(response):
        return tuple(decode_macro(frame([(response,)], "response string")).select("summary", "patterns").first())

    default = ("No summary generated.", "No patterns identified.")
    assert macro('{"Summary":"s","patterns":["p1","p2",null]}') == ("s", "p1 | p2 | None")
    assert macro('{"Patterns":"p"}') == (default[0], "p")
    assert macro('{"summary":null,"patterns":[]}') == ("None", "")
    for bad in ("[1]", "", None, "oops", '{"summary":"s"} x'):
        assert macro(bad) == default


def test_parsing_is_evaluated_once(frame):
    plan = decode_items(frame([("{}",)], "response string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 6
