"""Exact self-join of documents on the Jaccard similarity of their word shingles, by prefix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.arrow_rows import Memo, forget_built, slices
from threadloom.llm.components import components
from threadloom.llm.key_bits import by_bits, key_bits
from threadloom.llm.registry import documents, query
from threadloom.session import ship_package, stage_table

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
GROUP_TOKENS = 400_000  # shingles of one side of a tree join task
SET_TOKENS = 64  # a set counts as so many shingles besides its own: a task's time grows with its number of sets too
PAIRED = 16  # sets that meet at a shingle and are paired one by one; of more, each is linked to the first
MEETINGS = 4  # of a pair, that are asked for at most
SALTS = 64  # copies of a component's row
CELLS = 1 << 22  # of the table of probes and shingles that are traversed together: five bytes each


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes() -> Memo:
    """Hashes of words. A task makes its own, so that no worker holds one after it."""
    forget_built()
    return Memo(xxhash.xxh3_64_intdigest, 250_000)


def shingle_set(text: str | None, width: int, hash_of: Memo) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles of a text, in ascending (= global) order.

    Words are runs of other characters than the six ASCII white spaces; A-Z are lower-cased. Fewer words than
    ``width`` make one shingle; no words make none.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(hash_of.__getitem__, words), np.uint64, n)
    if n < width:
        value = np.array([n], np.uint64)
        for h in hashes:
            value = _mixed(value * MIX[0] + h)
        return value
    m = n - width + 1
    values = hashes[:m].copy()
    for k in range(1, width):
        values = _mixed(values * MIX[0] + hashes[k:k + m])
    return np.unique(_mixed(values + MIX[1]))


# What a set of n shingles must share with any partner, and how many it may have besides.
def _spare(n, percent: int):
    return n - -(-n * percent // 100)


def _deep(n, percent: int):
    return 1 + _spare(n, percent) // 2


def _prefixes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document: id, hash of the text, set size, 128-bit signature of the set, and the first shingles of the
    global order."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = word_hashes()
        for rows, texts in slices(batches):
            sets = [shingle_set(t, width, hash_of) for t in texts]
            sizes = [len(s) for s in sets]
            kept = [s[:min(n, _spare(n, percent) + _deep(n, percent))] for s, n in zip(sets, sizes)]
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in kept]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("hash"), pa.array(sizes, pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept).view(np.int64)))],
                ["doc_id", "hash", "n", "signature", "prefix"])

    return docs.select("doc_id", "hash", "text").mapInArrow(
        found, "doc_id long, hash long, n long, signature binary, prefix array<long>")


def _spare_col(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100)


def _deep_col(n: Column, percent: int) -> Column:
    """How many shingles a set of ``n`` shares at least, within both prefixes, with any similar set."""
    return 1 + F.floor(_spare_col(F.ceil(n * percent / 100), percent) / 2)


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(token, rep, n): shingles by which two sets that are similar enough are sure to meet.

    Two such sets share the first ``L`` of their common shingles within their prefixes, L by the smaller set. So a
    set with fewer shared shingles in its prefix than ``deep``, L for the smallest partner, has no partner. In the
    order of rising frequency, the first t common ones, t up to ``deep`` of both sets, are among the first (shared -
    deep + t) of each. Frequencies are counted in the prefixes.
    """
    n = F.col("n")
    # Smaller sets are similar to equal ones only.
    tokens = classes.where(100 * n >= percent * (n + 1)).select("rep", "n", F.explode("prefix").alias("token"))
    of_set = Window.partitionBy("rep")
    # Counted where they are brought together: the shingles of all prefixes are shuffled once.
    shared = tokens.withColumn("df", F.count("*").over(Window.partitionBy("token"))).where("df > 1")
    ranked = shared.withColumns({"deep": _deep_col(n, percent), "shared": F.count("*").over(of_set),
                                 "rank": F.row_number().over(of_set.orderBy("df", "token"))})
    return ranked.where(F.expr(f"shared >= deep and rank <= shared - deep + least(deep, {MEETINGS})")).select(
        "token", "rep", "n")


def _near(meet: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all sets that can be similar, and few others.

    Similar sets meet at ``need`` shingles, as many as ``_candidates`` took of the smaller set. Where few sets meet,
    they are paired, and pairs count with so many meetings: sets that meet by chance, mostly once, don't chain. Where
    many meet, each is linked to the first.
    """
    sized = meet.withColumn("sets", F.count("*").over(Window.partitionBy("token")))
    few = sized.where(F.col("sets") <= PAIRED)
    small, both = F.least("na", "nb"), F.col("na") + F.col("nb")
    most = small - (F.col("na") == F.col("nb")).cast("int")  # shingles in common: equal sets are one class
    pairs = few.select("token", F.col("rep").alias("a"), F.col("n").alias("na")).join(
        few.select("token", F.col("rep").alias("b"), F.col("n").alias("nb")), "token").where(
        (F.col("a") < F.col("b")) & (100 * most >= percent * (both - most)))
    need = F.least(_deep_col(small, percent), F.lit(MEETINGS)).cast("int")
    paired = pairs.groupBy("a", "b", need.alias("need")).count().where("count >= need").select("a", "b")
    crowd = sized.where(F.col("sets") > PAIRED)
    hub = crowd.groupBy("token").agg(F.min("rep").alias("b"))
    return paired.union(crowd.join(hub, "token").select(F.col("rep").alias("a"), "b").where("a <> b"))


class Tree:
    """Sets of shingle numbers in a prefix tree whose edges carry runs of numbers."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        self.root = [np.empty(0, np.int64), [], [], 0, 0]  # run, children, sets that end here, longest rest, smallest
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self._grow(self.root, sets, order, 0)

    def _grow(self, root: list, sets: list[np.ndarray], order: list[int], at: int) -> None:
        todo = [(root, order, at)]
        while todo:
            node, members, depth = todo.pop()
            node[2] = [i for i in members if len(sets[i]) == depth]
            rest = [i for i in members if len(sets[i]) > depth]
            start = 0
            while start < len(rest):
                head = sets[rest[start]][depth]
                end = start
                while end < len(rest) and sets[rest[end]][depth] == head:
                    end += 1
                a, b = sets[rest[start]], sets[rest[end - 1]]  # sorted: what these two share, all between share
                m = min(len(a), len(b))
                differ = np.nonzero(a[depth:m] != b[depth:m])[0]
                to = depth + int(differ[0]) if len(differ) else m
                lengths = [len(sets[i]) for i in rest[start:end]]
                child = [a[depth:to], [], [], max(lengths) - to, int(self.sizes[rest[start:end]].min())]
                node[1].append(child)
                todo.append((child, rest[start:end], to))
                start = end


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int,
              sizes_left: np.ndarray, sizes_right: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): each set of the tree with all similar probes. ``right`` None: the sets of ``left`` with each other.

    All sets stand in one order: frequent shingles first, so that sets share long runs of the tree. The tree is walked
    once per batch of probes. A probe carries the overlap with the path so far, shared by all sets below, and leaves
    a subtree as soon as the overlap and what can follow, by the rest of the probe or of the longest set below, can
    no longer reach the bound. Shingles that only one set has are left out; they count in the sizes.
    """
    both = left + (right or [])
    tokens, inverse, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    number = np.empty(len(tokens), np.int64)
    number[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    shared = int((counts > 1).sum())  # numbers below are those of shingles that two sets have
    cut = np.cumsum([len(s) for s in both])[:-1]
    numbered = [np.sort(x[x < shared]) for x in np.split(number[inverse], cut)]
    trees, probes = numbered[:len(left)], numbered[len(left):] if right is not None else numbered
    probe_sizes = sizes_right if right is not None else sizes_left
    tree = Tree(trees, sizes_left)
    step = max(1, CELLS // max(1, shared))
    for low in range(0, len(probes), step):
        batch = probes[low:low + step]
        has = np.zeros((len(batch), shared + 1), np.uint8)
        for row, p in enumerate(batch):
            has[row, p] = 1
        upto = np.cumsum(has, axis=1, dtype=np.int32)  # shingles of the probe up to a number
        size = probe_sizes[low:low + step]
        everyone = np.arange(len(batch))
        todo = [(child, everyone, np.zeros(len(batch), np.int64)) for child in tree.root[1]]
        while todo:
            (run, children, ends, longest, smallest), probe, overlap = todo.pop()
            overlap = overlap + has[np.ix_(probe, run)].sum(axis=1, dtype=np.int64)
            rest = np.minimum(upto[probe, shared] - upto[probe, run[-1]], longest)
            partner = np.maximum(smallest, -(-size[probe] * percent // 100))  # the smallest size that it may have
            need = -(-percent * (size[probe] + partner) // (100 + percent))
            stays = overlap + rest >= need
            probe, overlap = probe[stays], overlap[stays]
            if not len(probe):
                continue
            for i in ends:
                union = size[probe] + sizes_left[i] - overlap
                yield i, low + probe[100 * overlap >= percent * union]
            todo.extend((c, probe, overlap) for c in children)


def _linked(groups: Iterator[pa.RecordBatch] | pa.Table, percent: int) -> pa.Table:
    """Spanning links and numbers of links of one task: sets of side 0 with each other, or of side 0 with side 1."""
    forget_built()
    table = groups.sort_by([("side", "ascending"), ("rep", "ascending")])
    side, reps = table.column("side").to_numpy(), table.column("rep").to_numpy()
    copies, sizes = table.column("copies").to_numpy(), table.column("n").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    a = int((side == 0).sum())
    alone = bool(table.column("alone")[0].as_py())
    if not a or (not alone and a == len(sets)):
        found = iter(())
    elif alone:
        found = tree_join(sets, None, percent, sizes, None)
    else:
        found = tree_join(sets[:a], sets[a:], percent, sizes[:a], sizes[a:])
    group = np.arange(len(sets))
    links = np.zeros(len(sets), np.int64)
    for i, js in found:
        js = js if alone else js + a
        js = js[js != i]
        links[i] += copies[js].sum()
        if not alone:
            links[js] += copies[i]
        joined = np.unique(group[np.append(js, i)])
        if len(joined) > 1:
            group[np.isin(group, joined)] = joined[0]
    return pa.table({"a": reps, "b": reps[group], "links": links})


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """Members with ``part`` of their block and ``others``, the parts (its own too) that it is compared with.

    A block over ``GROUP_TOKENS`` is cut into parts of about that weight in the order of set sizes, sets of one size by
    a hash. Similar sets differ little in size: a part is compared with those near it, however many a block has.
    """
    up, block = Window.partitionBy("block").orderBy("n"), Window.partitionBy("block")
    sizes = members.groupBy("block", "n").agg(F.sum(F.col("n") + SET_TOKENS).alias("weight")).withColumns({
        "upto": F.sum("weight").over(up), "all": F.sum("weight").over(block)}).where(
        F.col("all") > GROUP_TOKENS).drop("all")
    share = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) / F.lit(1 << 20)
    at = F.floor((F.col("upto") - F.col("weight") * (1 - share)) / GROUP_TOKENS)
    placed = stage_table(members.join(sizes, ["block", "n"], "left").withColumn(
        "part", F.coalesce(at, F.lit(0)).cast("int")), "jaccard-placed")
    parts = placed.where("weight is not null").groupBy("block", "part").agg(
        F.min("n").alias("low"), F.max("n").alias("high"))
    later = parts.select("block", F.col("part").alias("other"), F.col("low").alias("other_low"))
    near = parts.join(later, "block").where(
        (F.col("other") >= F.col("part")) & (percent * F.col("other_low") <= 100 * F.col("high")))
    both = near.select("block", "part", "other").union(near.where("other > part").select("block", "other", "part"))
    others = both.groupBy("block", "part").agg(F.collect_list("other").alias("others"))
    return placed.drop("weight", "upto").join(others, ["block", "part"], "left").withColumn(
        "others", F.coalesce("others", F.array(F.lit(0))))


def _class_links(docs: DataFrame, by_set: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, links): sets to compare are brought together in blocks, each block split into tasks of bounded size."""
    meet = stage_table(_candidates(classes, percent), "jaccard-meet")
    blocks = components(_near(meet, percent), "jaccard-blocks").select(
        F.col("id").alias("rep"), F.col("component").alias("block"))
    members = stage_table(blocks.join(by_set.select("rep", "n", "copies", "doc_id", "hash"), "rep"), "jaccard-members")
    placed = _placed(members, percent)

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = word_hashes()
        for rows, texts in slices(batches):
            kept = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(c) for c in kept],
                 pa.array([shingle_set(t, width, hash_of).tobytes() for t in texts], pa.binary())], [*kept, "shingles"])

    columns = ["rep", "n", "copies", "block", "part", "others"]
    # A few texts of all are wanted, but how many grows with the input: those that a bitmap of the keys lets pass are
    # shuffled by id and hash at every size, never broadcast.
    key = ["doc_id", "hash"]
    texts = by_bits(docs.select(*key, "text"), key_bits(members, key, "jaccard-wanted"), key).dropDuplicates(key)
    sets = placed.hint("merge").join(texts, key).select(*columns, "text").mapInArrow(
        with_sets, "rep long, n long, copies long, block long, part int, others array<int>, shingles binary")
    dealt = sets.withColumn("other", F.explode("others")).select(
        "rep", "n", "copies", "block", "shingles", F.least("part", "other").alias("p"),
        F.greatest("part", "other").alias("q"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"),
        (F.col("part") == F.col("other")).alias("alone"))
    return dealt.groupBy("block", "p", "q").applyInArrow(
        lambda table: _linked(table, percent), "a long, b long, links long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the text's hash: rows that share an id are told apart by their texts."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("hash"))


def _members(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows that can link (doc_id, hash, n, component, component_id, n_links), and the others (doc_id, n).

    A class of equal sets has a number, ``rep``, that of its first row, fixed when rows are written: an id does not
    name a class, as rows may share an id but not a text. ``component`` is the smallest such number, ``component_id``
    the smallest id.
    """
    prefixes = stage_table(_prefixes(docs, width, percent).withColumn("row", F.monotonically_increasing_id()),
                           "jaccard-prefixes")
    full = prefixes.where("n > 0 and doc_id is not null")
    by_set = stage_table(full.groupBy("n", "signature").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("hash", "doc_id").alias("hash"), F.count("*").alias("copies"),
        F.min("row").alias("rep")), "jaccard-classes")
    # Of rows with equal sets one is taken. Only rows that may have such others are shuffled with their prefixes.
    key = ["n", "signature"]
    copied = key_bits(by_set.where("copies > 1"), key, "jaccard-copied")
    rows = full.select(F.col("row").alias("rep"), *key, "prefix")
    classes = by_bits(rows, copied, key, "left_anti").union(
        by_bits(rows, copied, key).join(by_set.select("rep").hint("merge"), "rep", "left_semi").select(rows.columns))
    linked = stage_table(_class_links(docs, by_set, classes, width, percent), "jaccard-links")
    found = components(linked.select("a", "b"), "jaccard-found").withColumnRenamed("id", "rep")
    counted = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    smallest = found.join(by_set.select("rep", "doc_id"), "rep").groupBy("component").agg(
        F.min("doc_id").alias("component_id"))
    # One row per component meets all its classes: copied, so that those of a large component go to many tasks.
    named = found.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(
        smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["component", "salt"]).select(
        "rep", "component", "component_id")
    of_class = stage_table(by_set.join(named, "rep", "left").join(counted, "rep", "left").select(
        "n", "signature", F.coalesce("component", "rep").alias("component"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-named")
    rows = full.select("doc_id", "hash", "n", "signature").join(of_class, ["n", "signature"]).drop("signature")
    return rows, prefixes.where("n = 0 or doc_id is null").select("doc_id", "n")


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable by links) and n_links (documents it links to).

    Two documents link if 100 * |A & B| >= percent * |A | B| for their sets of ``width``-word shingles. Equal sets
    are one class; only classes are compared. See ``_candidates`` for what is compared and ``tree_join`` for how.
    Shingles, and the texts of one id, are told apart by 64-bit hashes.

    A NULL, empty or blank text has no shingles, is its own component and links to nothing, nor does a document with
    a NULL id (its component is NULL). Every row is a document of its own, also if rows share an id, with a text or
    without. An empty table gives no rows. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    rows, others = _members(_keyed(docs, id_col, text_col), width, percent)
    empty = others.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                          F.lit(0).cast("long").alias("n_links"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").union(
        empty).withColumnRenamed("doc_id", id_col)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row of each component, one with its smallest id; columns unchanged. Rows with a NULL id or no words stay.

    Rows that share that id are told apart by the hash of the text, then by their other columns. Texts are joined
    with the keys of the rows to drop; only of rows repeated in full or in part, the first is sought.
    """
    ship_package(docs.sparkSession)
    rows, _ = _members(_keyed(docs, id_col, text_col), width, percent)
    keys = stage_table(rows.groupBy("doc_id", "hash").agg(
        F.first("component").alias("component"), F.count("*").alias("n")), "jaccard-keys")
    chosen = keys.groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("k")).select("k.*")
    # Columns travel as c0, c1, ..., so that their names can't clash with the keys.
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    wide = docs.toDF(*names).withColumns({"doc_id": doc_id.cast("long"), "hash": F.xxhash64(text)})
    # Left of each key: no row (not chosen), one of several, or the only one (not listed).
    many = keys.join(chosen, ["doc_id", "hash"], "left_semi").where("n > 1").select("doc_id", "hash")
    dropped = keys.join(chosen, ["doc_id", "hash"], "left_anti").select("doc_id", "hash")
    many, gone = stage_table(many, "jaccard-many"), stage_table(dropped.union(many), "jaccard-dropped")
    ordered = [n for n, f in zip(names, docs.schema.fields) if "map<" not in f.dataType.simpleString()]
    first = wide.join(many, ["doc_id", "hash"], "left_semi").groupBy("doc_id", "hash").agg(
        F.min_by(F.struct(*names), F.struct(*ordered)).alias("row")).select("row.*")
    # Merged at every size: what is dropped grows with the input.
    return wide.join(gone.hint("merge"), ["doc_id", "hash"], "left_anti").select(*names).union(first).toDF(*docs.columns)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
                      WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]
                                          FOR i IN range(1, len(w) - 2)]) END AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * o >= 85 * (p.n + q.n - o)),
twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS c FROM sizes
          UNION SELECT b.y, r.c FROM reach r JOIN twoway b ON b.x = r.x WHERE b.y > r.c),
found AS (SELECT x, min(c) AS c FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS d FROM twoway GROUP BY x)
SELECT s.doc_id, s.n AS n_shingles, f.c AS component_id, coalesce(d.d, 0)::BIGINT AS n_links
FROM sizes s JOIN found f ON f.x = s.doc_id LEFT JOIN degree d ON d.x = s.doc_id
"""


@query("op2_jaccard_join", JACCARD_SQL)
def jaccard_join(spark, sf_dir) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir), width=4, percent=85)
