"""Each operator on awkward documents against a plain Python version, on an empty table and with clashing columns."""

import base64
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import SCHEMA, awkward, base_spans, jaccard_classes, repeat_words, sha, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import ans, arrow_rows, byte_bpe, hamming_search, jaccard_join, language_id, line_rules, mixing, pii, sharding
from threadloom.llm import token_counts, token_files
from threadloom.session import new_path


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(docs, rows):
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    placed = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in placed]
    assert ids == sorted(ids)
    total, before, slots = sum(r.size for r in got), 0, defaultdict(int)
    for r in placed:
        assert r.slot == slots[r.shard]
        assert r.shard == min(3, int((before + r.size / 2) * 4 / total))
        slots[r.shard], before = slots[r.shard] + 1, before + r.size


def test_mixing(docs, rows):
    sizes, source = defaultdict(int), {}
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
        source[r[0]] = r[3]
    total = sum(sizes.values())
    names = sorted(n for n in sizes if n is not None) + [None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    target, free = {}, list(names)
    while free:  # stop those above their cap, share the rest again
        left, share = total - sum(target.values()), sum(weight[n] for n in free)
        above = [n for n in free if left * weight[n] / share > 3 * sizes[n]]
        if not above:
            target |= {n: left * weight[n] / share for n in free}
            break
        target |= {n: 3.0 * sizes[n] for n in above}
        free = [n for n in free if n not in above]
    got, taken = mixing.mix(docs).collect(), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[n] - target[n]) <= 8000 for n in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    many = mixing.mixed_documents(docs)
    assert many.columns == docs.columns
    assert sum(len(words(r.text)) for r in many.collect()) == sum(taken.values())


def test_mixing_of_shared_ids(spark):
    """Sources whose rows share one id or have none, and a source of equal rows, are cut within a document of the target."""
    rows = [(None, f"w{i} a b c", "a") for i in range(60)] + [(5, f"v{i} a b c", "b") for i in range(61)]
    rows += [(None, "x y z", "c")] * 67 + [(i, "one two", "d") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    target, taken, many = {}, defaultdict(int), defaultdict(int)
    got = mixing.mix(docs, weights=(5, 7, 9)).collect()
    assert len(got) == len(rows)
    for r in got:
        target[r.source_size] = r.target
        taken[r.source_size] += r.taken
    assert len(target) == 4 and all(abs(taken[n] - target[n]) <= 4 for n in target), (taken, target)
    for r in mixing.mixed_documents(docs, weights=(5, 7, 9)).collect():
        many[r.source] += len(words(r.text))
    assert sorted(many.values()) == sorted(taken.values())


def test_jaccard(spark, docs, rows):
    got = jaccard_join.jaccard_classes(docs, 4, 85).collect()
    assert len(got) == len(rows)
    want = jaccard_classes([(r[0], r[1]) for r in rows if r[0] is not None], 4, 85)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.n_links == 0
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id][:2]
    kept = jaccard_join.keep_one(docs, width=4, percent=85)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in want.values()} | {None}


@pytest.mark.parametrize(("width", "percent"), [(2, 60), (5, 80)])
def test_jaccard_of_near_copies(spark, monkeypatch, width, percent):
    """A group of near copies, cut into many tasks, with the links of all pairs counted."""
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 700)
    random.seed(width)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = f"x{random.randrange(40)}"
        rows.append((1000 - i, " ".join(w[random.randint(0, 5):])))
    rows += [(i, " ".join(random.choices(base, k=random.randint(1, 30)))) for i in range(60)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    want = jaccard_classes(rows, width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got.collect()} == want


def test_jaccard_of_shared_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " end"
    rows = [(3, near, "x")] + [(7, a, "x"), (7, b, "x")] * 2 + [(9, c, "z"), (9, c, "y"), (9, c, "z"), (9, c + " ", "x")]
    rows += [(None, a, "x")] * 2 + [(11, "", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string").repartition(3)
    got = jaccard_join.jaccard_classes(docs, 5, 80).where("n_shingles > 0 and doc_id is not null").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == [
        (3, 37, 3, 2), (7, 36, 3, 2), (7, 36, 3, 2), (7, 36, 7, 1), (7, 36, 7, 1)] + [(9, 36, 9, 3)] * 4
    kept = [tuple(r) for r in jaccard_join.keep_one(docs, width=5, percent=80).collect()]
    nines = [r for r in kept if r[0] == 9]
    assert len(nines) == 1 and nines[0] in [(9, c, "y"), (9, c + " ", "x")]
    assert sorted((str(r) for r in kept if r[0] != 9)) == sorted(
        map(str, [(3, near, "x"), (7, b, "x")] + [(None, a, "x")] * 2 + [(11, "", "x")] * 2))


def test_pii(docs, rows):
    by_id = dict((r[0], r[1]) for r in rows)
    for r in pii.find_spans(docs.drop("size")).collect():
        spans = [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.pii if s.base]
        assert spans == base_spans(by_id[r.doc_id])
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[5] == "A <EMAIL> <PHONE> <CARD> <IP>".replace("<PHONE> <CARD>", by_id[5][11:45]) or "<EMAIL>" in text[5]
    assert text[0] is None and text[6] == by_id[6]


def test_pii_finds_what_base_matches_swallow(spark):
    sure = [(i, f"call +1 ({200 + i}) 555-2485 or 4111111111111111, mail a{i}@b.com") for i in range(60)]
    rows = sure + [(100, "call +1 (269) 555-3296 4111111111111111 now"), (101, "4111111111111112 is no card"),
                   (102, "a clean text with 12 words and 2024 dates")]
    got = {r.doc_id: {f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.pii}
           for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == {"phone:5:22", "card:23:39"}
    assert got[101] == got[102] == set()


def test_pii_finds_masked_addresses_alone_in_a_text(spark):
    marks = [f"{a}{b}{m}{c}{d}" for a in ("[", " [", " (") for b in ("", " ") for m in ("at",) for c in ("", " ")
             for d in ("]", ")", "] ", ") ")]
    dots = [".", " [ dot ] ", "(dot)", " (dot ) "]
    rows = [(i, f"write to jane{m}example{dots[i % 4]}com") for i, m in enumerate(marks)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.with_candidates(docs).collect():
        assert [(c.kind, c.start, c.end) for c in r.candidates] == [(0, 9, len(r.c1))], r.c1
    assert {r.text for r in pii.redact(docs).collect()} == {"write to <EMAIL>"}


def test_pii_of_long_runs(spark):
    rows = [(0, "1" * 20_000), (1, "a" * 20_000 + "@"), (2, "a@b" + ".c" * 20_000), (3, "1.2.3.4 " * 2000)]
    got = {r.doc_id: len(r.pii) for r in pii.find_spans(
        spark.createDataFrame(rows, "doc_id long, text string"), weights={}).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2000}


def test_em_trusts_labelers_that_agree():
    class Row(dict):
        pass
    counts = [Row(kind=0, form=0, format=1, gazetteer=1, context=0, before=1, after=1, digits=1, n=500),
              Row(kind=0, form=1, format=-1, gazetteer=-1, context=-1, before=1, after=1, digits=1, n=300)]
    belief = pii.estimate(counts)[0]
    assert belief[(1, 1, 0)] > 0.95 and belief[(-1, -1, -1)] < 0.05


def test_quality_rules(docs, rows):
    by_id = dict((r[0], r[1]) for r in rows)
    for r in line_rules.clean_lines(docs).collect():
        text = by_id[r.doc_id] or ""
        w, seen, repeats = words(text), set(), 0
        for line in text.split("\n"):
            repeats += bool(words(line)) and line in seen
            seen.add(line)
        assert (r.rules.n_words, r.rules.word_chars, r.rules.n_dup_lines, r.rules.n_repeat_words) == (
            len(w), sum(map(len, w)), repeats, repeat_words(w))
        assert r.rules.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.rules.base_failed == (len(w) < 10 or 100 * repeat_words(w) > 20 * len(w))
        assert not (r.rules.base_failed and r.rules.kept)


def test_line_rules():
    clean, table = "This is a plain line of text, and it ends well.", "home | shop | news | about | help"
    counts, left, text = line_rules.clean(f"{clean}\n{table}\nAll rights reserved.\n{clean}\nTHIS!! IS!! LOUD!!")
    assert text == clean and counts[3] == 1 and left == len(clean.replace(" ", ""))


def test_byte_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = dict((r[0], r[1]) for r in rows)
    for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs.withColumn("ids", F.lit(1)))).collect():
        assert r.ids == library.encode_ordinary(by_id[r.doc_id] or "")
        assert bytes(r.decoded) == (by_id[r.doc_id] or "").encode()
    digests = byte_bpe.with_digests(docs.select("doc_id", "text")).where("doc_id in (0, 6)").distinct().collect()
    for r in digests:
        ids = library.encode_ordinary(by_id[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(by_id[r.doc_id] or ""))


ODD = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "\xa0", "　", "\x1c", "\x85", "'s", "'LL", "1", "23", "!", "##", "Σ",
       "ς", "İ", "ß", "中", "é", "́", "😀", "<|endoftext|>", "<|startoftext|>", "\r\n", "ﬁ", "Ⅷ", "²", "ab" * 60, "​"]


def odd_texts(n: int) -> list[str]:
    random.seed(n)
    return ["".join(random.choices(ODD, k=random.randint(0, 30))) for _ in range(n)]


def test_byte_bpe_of_odd_texts():
    content = open(byte_bpe.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = byte_bpe.ByteBpe(content, public_tokenizers.PATTERN)
    for text in odd_texts(3000):
        assert np.frombuffer(mine.encode(text), np.uint32).tolist() == library.encode_ordinary(text)
    assert not any(mine.words)


def test_byte_bpe_with_ranks_in_any_order():
    """A lower rank may turn up while a higher one is merged; the library's rule is checked step by step."""
    random.seed(2)
    tokens = [bytes([c]) for c in b"abc"] + list({bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(60)})
    random.shuffle(tokens)
    mine = byte_bpe.ByteBpe(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)), ".+")
    for _ in range(500):
        piece = bytes(random.choices(b"abc", k=random.randint(1, 30)))
        parts = [bytes([c]) for c in piece]
        while piece not in mine.ranks and len(parts) > 1:
            pairs = [(mine.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(pairs)
            if rank == 1 << 30:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert mine.merge(piece) == ([mine.ranks[piece]] if piece in mine.ranks else [mine.ranks[p] for p in parts])


def test_token_counts(docs, rows):
    library = Tokenizer.from_file(token_counts.VOCABULARY)
    by_id = dict((r[0], r[1]) for r in rows)
    for r in token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("x"))).collect():
        assert r.n_tokens == len(library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids)
    counter = token_counts.TokenCounter(open(token_counts.VOCABULARY, "rb").read())
    for text in odd_texts(3000):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_files(spark, docs, rows):
    library = Tokenizer.from_file(token_files.VOCABULARY)
    folder = new_path(spark, "token-test")
    files = token_files.write_token_files(docs, folder, file_ids=2000)
    got = sorted(token_files.read_token_files(folder, files).collect(), key=lambda r: r.start)
    want = sorted(((-1 if r[0] is None else r[0], r[1] or "") for r in rows), key=lambda r: r[0])
    at = 0
    assert len(got) == len(want) and files.count() > 3
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert ((-1 if r.doc_id is None else r.doc_id), r.start, r.ids) == (doc_id, at, ids)
        at += len(ids)
    sums = {(r.doc_id, r.start): r for r in token_files.id_checksums(token_files.read_token_files(folder, files)).collect()}
    assert all(sums[(r.doc_id, r.start)].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000, 200_000])
def test_coder_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n) - 1, 50_256).astype(np.uint32)
    content = ans.encode_file(ids, [1], [n])
    held = ans.TokenFile(content)
    assert (held.decode() == ids).all() and len(held.decode()) == n
    if held.header["blocks"] > 1:  # a reader may start at any block
        assert (held.decode(1) == ids[held.header["steps"] * ans.LANES:]).all()
    if n > 1000:
        broken = bytearray(content)
        broken[-1000] ^= 1
        with pytest.raises(ValueError):
            ans.TokenFile(bytes(broken)).decode()
        with pytest.raises(ValueError):
            ans.TokenFile(content[:-4])


def codes(vectors):
    return ["".join("1" if x > 0 else "0" for x in v) if v and None not in v else None for v in vectors]


def test_hamming_search(spark, monkeypatch):
    monkeypatch.setattr(hamming_search, "BLOCK_CODES", 60)
    monkeypatch.setattr(hamming_search, "BLOCK_QUERIES", 4)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=40).tolist() for _ in range(150)]
    vectors += [vectors[0]] * 40 + [None, [], [1.0, None], [1.0] * 20]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0]), (None, vectors[1])]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", hamming_search.sign_code(F.col("v")).alias("code"))
    got = defaultdict(list)
    for r in hamming_search.nearest(df, df.where("id % 10 = 0"), 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.id))
    code = dict(enumerate(codes(vectors)))
    for q in range(0, len(vectors), 10):
        if code[q]:
            want = sorted((sum(a != b for a, b in zip(code[q], c)), i) for i, c in code.items()
                          if i != q and c and len(c) == len(code[q]))
            assert got.pop(q) == want[:7]
    assert not got


def test_language_id(spark, docs):
    english, german = "the house and the garden with of this that ", "das haus und der garten mit von dieser jener "
    rows = [(i, (english, german)[i % 2] * (1 + i % 9), ("en", "de")[i % 2]) for i in range(60)]
    rows += [(100, None, "en"), (101, "12 !!", None), (102, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_on_documents(df)
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("score", F.lit("x")), model).collect()}
    assert all(got[i].lang_pred == rows[i][2] and 0 <= got[i].score <= 1 for i in range(60))
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (100, 101, 102))
    assert language_id.identify(docs, model).count() == docs.count()


def test_language_id_learns_nothing_from_nothing(none, docs):
    model = language_id.fit_on_documents(none)
    assert {r.lang_pred for r in language_id.identify(docs, model).select("lang_pred").collect()} == {"und"}


def test_empty_tables(spark, none):
    assert sharding.shard_by_bytes(none, 4).count() == 0
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert jaccard_join.jaccard_classes(none).count() == jaccard_join.keep_one(none).count() == 0
    assert pii.redact(none).count() == line_rules.clean_lines(none).count() == 0
    assert byte_bpe.with_digests(none).count() == token_counts.count_tokens(none).count() == 0
    folder = new_path(spark, "no-tokens")
    assert token_files.read_token_files(folder, token_files.write_token_files(none, folder)).count() == 0
    vectors = spark.createDataFrame([], "id long, code string")
    assert hamming_search.nearest(vectors, vectors, 3).count() == 0


def test_library_encoder_asks_once_for_what_repeats(monkeypatch):
    """The ids of the library for texts of every kind; few calls, as words, signs and line feeds are told apart before."""
    library = Tokenizer.from_file(token_files.VOCABULARY)
    with open(token_files.VOCABULARY, "rb") as f:
        mine = token_files.LibraryEncoder(f.read())
    texts = odd_texts(3000) + ["", " ", " a", "a ", "a\n", "\n\n", "a\n\n", "a\n\nb", "a\n\n\nb", "a.\n\n\n", "# #", "a #", "#a ##b1c2",
                               "it's so'. 'tis", "é'x «a» …b.", "a  b", "a\tb", "x<|endoftext|>y", "12 a34,5", "²3 ½", "ʰa ǆ×÷ª"]
    for _ in range(2):
        for text, ids in zip(texts, mine.encode_all(texts), strict=True):
            assert np.frombuffer(ids, np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    calls, merged = [], mine.merged
    monkeypatch.setattr(mine, "merged", lambda match: calls.append(match) or merged(match))
    monkeypatch.setattr(mine, "_whole", lambda text: pytest.fail(text))
    mine.encode_all([f"Qzxa qzxb{'.' * (i % 9)} qzxc, qzxd\nqzxe{'!' * (i % 7)} qzxb" for i in range(2000)])
    assert len(calls) < 40


def test_coder_with_large_ids():
    ids = np.array([5, 2 ** 32 - 1, 7, 5] * 100, np.uint32)
    assert ans.TokenFile(ans.encode_file(ids, [1], [len(ids)])).decode().tolist() == ids.tolist()


def test_a_worker_keeps_the_state_of_one_operator():
    class Table:
        def __init__(self, content, *args):
            self.content = content

    first = arrow_rows.built_once(Table, b"1")
    assert arrow_rows.built_once(Table, b"1") is first
    arrow_rows.built_once(Table, b"2")
    assert [x.content for x in arrow_rows._built.values()] == [b"2"]
    jaccard_join.word_hashes()
    assert not arrow_rows._built


def test_tree_join_is_bounded_in_memory():
    """A group of near copies of the largest size that one task gets."""
    random.seed(3)
    common = np.arange(1, 40_001, dtype=np.uint64) * np.uint64(2 ** 40)
    sets = [np.sort(np.delete(common[i // 8 * 500:i // 8 * 500 + 500], random.sample(range(500), 9))) for i in range(640)]
    sizes = np.array(list(map(len, sets)))
    tracemalloc.start()
    links = sum(len(js) for _, js in jaccard_join.tree_join(sets, None, 80, sizes, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == 640 * 8 and peak < 64 << 20


def test_keep_one_joins_texts_by_one_plan_at_every_size(docs):
    plan = jaccard_join.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and not [x for x in plan.splitlines() if "Broadcast" in x and "LeftAnti" in x]


def test_byte_bpe_merges_the_pieces_of_many_texts_together(monkeypatch):
    """One call of the queue for all new pieces of a batch, not one per match, and the ids of tiktoken's merging."""
    with open(byte_bpe.VOCABULARY, "rb") as f:
        mine = byte_bpe.ByteBpe(f.read(), public_tokenizers.PATTERN)
    calls, merge_all = [], mine.queue.merge_all
    monkeypatch.setattr(mine.queue, "merge_all", lambda pieces: calls.append(len(pieces)) or merge_all(pieces))
    texts = [f"qzx{i} vbnmq{i * i}, Überlänge{i}\n\nwrtz  doppelt" if i % 3 else f"zzzq{i} plkj{i}." for i in range(400)]
    got = mine.encode_all(texts)
    assert len(calls) <= 4 and sum(calls) > 400
    for text, ids in zip(texts, got, strict=True):
        one = [i for m in mine.matches(text) for i in mine.merge(m.encode())]
        assert np.frombuffer(ids, np.uint32).tolist() == one
        assert mine.decode(one).decode() == text
