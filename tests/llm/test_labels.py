"""Language ID and the span classifier against plain Python, with rare shapes, repeated ids and numeric signs."""

import hashlib
import math
import unicodedata

import pytest
import zstandard
from pyspark.sql import Row

from threadloom.llm import language_id, pii


def letters(text):
    return " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split())


def predicted(rows, texts):
    """(language, score) of each text: dictionaries from (id, text, lang) rows in order, whole texts in blocks."""
    words = {}
    place = lambda r: (len(r[1]) > 4000, hashlib.md5(str(r[0]).encode()).hexdigest())
    for lang in {r[2] for r in rows}:
        some = sorted({r for r in rows if r[2] == lang}, key=place)[:100]
        words[lang] = b"\n".join(letters(r[1]).encode() for r in some)[:100 << 10]
    out = []
    for text in texts:
        plain = letters(text or "").encode()
        if not plain:
            out.append(("und", 0.0))
            continue
        sizes = []
        for lang, content in words.items():
            d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(9, source_size=1024, dict_size=len(content.ljust(8)),
                                                              write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=p)
            press = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
            sizes.append((sum(len(press.compress(plain[i:i + 1024])) for i in range(0, len(plain), 1024)), lang))
        sizes.sort()
        out.append((sizes[0][1], 1 - sizes[0][0] / sizes[1][0]))
    return out


def test_language_id_equals_plain_python(spark):
    sentences = {"en": "the house and the garden with of this that is a very fine place to be",
                 "de": "das haus und der garten mit von dieser jener ist ein sehr feiner ort",
                 "fr": "la maison et le jardin avec de ce cette est un tres bel endroit"}
    rows = [(i, f"{s} {i * 7}! {s.split()[i % 9]} ½" * (1 + i % 5), lang) for lang, s in sentences.items() for i in range(30)]
    rows += [(200, "x" * 9000 + " long", "de"), (200, "Haus", "de"), (200, "Haus", "de")]
    texts = ["½", "²", "Ⅷ", "①", "5² Ⅷ", "", None, "12 !!", "_", "ß", "ʼn Haus", "das Haus und der Garten", "THE garden ② is fine " * 200]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(asked, model).collect()}
    for i, (lang, score) in enumerate(predicted(rows, texts)):
        assert (got[i].lang_pred, got[i].score) == (lang, pytest.approx(score)), texts[i]
    assert [got[i].lang_pred for i in range(9)] == ["und"] * 9


def test_a_repeated_id_sends_bounded_text(spark):
    """A third of the rows share an id: repeated rows come once, long texts are cut before they leave the executors."""
    rows = [(7, "wort " * 40_000, "de")] * 40 + [(7, f"haus {i} garten", "de") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import pickle

    words = pickle.loads(language_id.fit(df))["de"]
    assert len(words) == 100 * len(b"haus garten") + 99


def smoothed(counts, belief):
    """Weights by the docstring of ``train``: two more spans with the odds of the kind, or four with the prior votes."""
    weights = {}
    for kind in {r["kind"] for r in counts}:
        mine = [(r, belief[kind][tuple(r[v] for v in pii.LABELERS)]) for r in counts if r["kind"] == kind]
        yes, no = 1 + sum(r["n"] * p for r, p in mine), 1 + sum(r["n"] * (1 - p) for r, p in mine)
        weights[kind, "", 0] = math.log(yes / no)
        for shape in pii.SHAPES:
            for v in {r[shape] for r, _ in mine}:
                y = sum(r["n"] * p for r, p in mine if r[shape] == v)
                n = sum(r["n"] * (1 - p) for r, p in mine if r[shape] == v)
                if shape in ("format", "gazetteer", "context"):
                    votes = {-1: (2.0, 0.4), 0: (1.2, 1.2), 1: (0.8, 2.4)}[v]
                    weights[kind, shape, v] = math.log((y + votes[1]) / (yes + 4)) - math.log((n + votes[0]) / (no + 4))
                else:
                    share = yes / (yes + no)
                    weights[kind, shape, v] = math.log((y + 2 * share) / (n + 2 * (1 - share))) - math.log(yes / no)
    return weights


def test_span_classifier_equals_plain_python(spark):
    texts = [f"call +1 ({200 + i}) 555-2485 or mail a{i}@b.com" for i in range(40)]
    texts += [f"version {i}.{i}.3.4 of order 4111 1111 1111 111{i % 10}" for i in range(40)]
    texts += [f"jane{i} [at] example [dot] com" for i in range(20)] + ["visa 4111111111111111", "host 10.0.0.1"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = pii.pattern_counts(pii.with_candidates(docs))
    weights, want = pii.train(counts), smoothed(counts, pii.estimate(counts))
    assert weights.keys() == want.keys() and all(weights[k] == pytest.approx(want[k]) for k in want)
    # the added spans: candidates that pass their own check and score high enough
    least = math.log(pii.MIN_PROBABILITY / (1 - pii.MIN_PROBABILITY))
    found = {r.doc_id: [(s.start, s.kind, s.end) for s in r.pii if not s.base] for r in pii.find_spans(docs).collect()}
    for r in pii.with_candidates(docs).collect():
        score = lambda c: sum(want.get((c.kind, n, c[n] if n else 0), 0.0) for n in ("", *pii.SHAPES))
        assert found[r.c0] == sorted({(c.start, c.kind, c.end) for c in r.candidates if c.form != pii.BASE_FORM
                                      and c["format"] == 1 and score(c) >= least}), r.c1


def redacted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]


def test_a_rare_neighbour_is_no_evidence_against(spark):
    """What EM is sure of stays found where a blank stands behind it for the first time."""
    texts = [f"jane{i} [at] example [dot] com, or mail bob{i}@example.org" for i in range(50)]
    got = redacted(spark, [*texts, "e-mail contact aaaa [at] example [dot] com now"])
    assert got == ["<EMAIL>, or mail <EMAIL>"] * 50 + ["e-mail contact <EMAIL> now"]


def test_kinds_with_few_spans(spark):
    """One span of a kind, and kinds without any false span."""
    assert redacted(spark, ["write to jane [at] example [dot] com"]) == ["write to <EMAIL>"]
    assert redacted(spark, [f"call (269) 555-32{i:02d}" for i in range(9)] + ["tel 269-555-3296 today"]) == ["call <PHONE>"] * 9 + ["tel <PHONE> today"]


def test_long_masked_addresses_are_taken_whole(spark):
    long = "x" * 100
    labels = " [dot] ".join(["part"] * 8 + ["com"])
    assert redacted(spark, [f"mail {long} [at] {labels} please"]) == ["mail <EMAIL> please"]
    big = "a" * 200_000 + " [at] "
    assert redacted(spark, [big, "b [at] " + "c [dot] " * 30_000]) == [big, "b [at] " + "c [dot] " * 30_000]


def test_more_evidence_weighs_more():
    row = lambda n, **v: Row(**({"kind": 0, "form": 2, "format": 1, "gazetteer": 1, "context": 1, "before": 1, "after": 1, "digits": 0} | v | {"n": n}))
    weights = pii.train([row(100), row(100, format=-1, gazetteer=-1, context=-1, after=3, before=3), row(1, after=2)])
    assert weights[0, "after", 1] > 1 > -1 > weights[0, "after", 3] and abs(weights[0, "after", 2]) < 1
