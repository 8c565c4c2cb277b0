"""A Merkle manifest of a dataset: hash trees over the rows of each language, proofs and verification of every row.

A node carries the interval [lo, hi) of the leaf ranks it covers. The interval says all about its place: its level's
bucket of ``FAN`` children is ``lo div width``, its parent is the node of that bucket whose interval contains it, and
its siblings are the children of the parent with other intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadloom.llm.prefix_sums import PART, range_parts, sums_before
from threadloom.llm.registry import documents, query
from threadloom.session import stage_table

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def digest_of_nodes(nodes: Column) -> Column:
    """The digest of some digests, laid end to end, as hex text."""
    return digest(F.lower(F.hex(nodes)))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(columns[name]) for name in FIELDS]))


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Level 1 and up of the trees over leaves (tree, leaves, lo, hi, digest): the same columns, bucket, children in order.

    A tree with one leaf has no nodes. At most ``FAN`` rows meet under one key.
    """
    levels, below, width = [], leaves.where("leaves > 1").select("tree", "leaves", "lo", "hi", "digest"), FAN
    most = below.agg(F.max("leaves")).first()[0] or 0
    while width < most * FAN:
        runs = below.groupBy("tree", "leaves", F.expr(f"lo div {width}").alias("bucket")).agg(
            F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        level = stage_table(runs.select(
            "tree", "leaves", "bucket", F.col("children")[0]["lo"].alias("lo"),
            F.element_at("children", -1)["hi"].alias("hi"), "children",
            digest_of_nodes(_joined(F.transform("children", lambda c: c["digest"]))).alias("digest")),
            f"{name}-{len(levels) + 1}")
        levels.append(level)
        # a tree whose node covers all leaves is done
        below, width = level.where("hi - lo < leaves").select("tree", "leaves", "lo", "hi", "digest"), width * FAN
    return levels


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda all_, d: F.concat(all_, d))


def _attach(nodes: DataFrame, parents: DataFrame, width: int, carried: list[str]) -> DataFrame:
    """Join each node with the parent that contains it; its siblings go before the parent's ``path``.

    Nodes meet parents of one bucket of the level only, and of those the one whose interval contains theirs. The
    siblings are what the parent's interval has besides the node's own: those left of it and those right of it.
    """
    p = parents.select(F.col("tree").alias("p_tree"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                       F.col("children").alias("p_children"), F.col("path").alias("p_path"), *[F.col(c).alias(f"p_{c}") for c in carried])
    contained = ((F.col("tree") == F.col("p_tree")) & (F.expr(f"lo div {width}") == F.expr(f"p_lo div {width}"))
                 & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi")))

    def side(keep) -> Column:
        return _joined(F.transform(F.filter("p_children", keep), lambda c: c["digest"]))

    siblings = F.struct(side(lambda c: c["hi"] <= F.col("lo")).alias("left"),
                        side(lambda c: c["lo"] >= F.col("hi")).alias("right"))
    return nodes.join(p, contained).select(
        *nodes.columns, F.concat(F.array(siblings), "p_path").alias("path"), *[F.col(f"p_{c}").alias(c) for c in carried])


def _paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """``leaves`` with the ``path`` from each to the end of the path of its tree's top, and the columns carried by it.

    ``tops`` has a row per tree: tree, leaves, path, carried columns. From the top level down each level meets only
    the one above it, so no key has more than ``FAN`` nodes, and what reaches the leaves is one row per ``FAN`` of them.
    """
    above = None
    for i in range(len(levels), 0, -1):
        level, width = levels[i - 1], FAN ** i
        whole = level.where("hi - lo = leaves").join(tops.drop("leaves"), "tree")
        columns = [*level.columns, "path", *carried]
        here = whole.select(*columns)
        if above is not None:
            here = here.unionByName(_attach(level.where("hi - lo < leaves"), above, width * FAN, carried).select(*columns))
        above = here
    single = leaves.where("leaves = 1").join(tops.where("leaves = 1").drop("leaves"), "tree")  # the leaf is the top
    columns = [*leaves.columns, "path", *carried]
    if above is None:
        return single.select(*columns)
    below = _attach(leaves.where("leaves > 1"), above, FAN, carried)
    return single.select(*columns).unionByName(below.select(*columns))


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their rank ``lo`` within ``tree``, ``hi`` = lo + 1 and the tree's number of ``leaves``.

    A large tree is dealt to many partitions, and its size reaches the rows by tree and partition, never by tree alone.
    """
    parts = range_parts(rows, ["tree", *order], name)
    totals = parts.groupBy("tree", PART).count()
    sizes = totals.select("tree", PART, F.sum("count").over(Window.partitionBy("tree")).alias("leaves"))
    ranked = sums_before(parts, ["tree"], ["tree", *order], {"lo": F.lit(1).cast("long")}).join(sizes, ["tree", PART])
    return stage_table(ranked.withColumn("hi", F.col("lo") + 1).drop(PART), f"{name}-ranked")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings; a run of one hashes its node alone."""
    return F.aggregate(path, leaf, lambda node, run: digest_of_nodes(F.concat(run["left"], node, run["right"])))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; digests as hex.

    A leaf is the SHA-256 of a row's fields. Per lang the leaves ascend by doc_id, and runs of ``FAN`` nodes become
    their digest until one remains, the subroot; the subroots, by lang, become the root likewise. ``proof_sha256`` is
    the digest of all siblings from leaf to root. ``folded_root`` climbs again from the leaf, or, where ``tampered``
    holds (NULL: it doesn't), from the leaf of a row with the columns of ``changed`` instead, and ``verified`` says
    whether it meets the root.

    NULL fields are '-', so a NULL text is not an empty one; a NULL lang is a tree of its own and the first one; NULL
    doc_ids come first. Rows of one doc_id stand in the order of their leaves, so equal rows are neighbours and each
    has a place. One lang with one row has its leaf as subroot and, if alone, as root: its proof is the digest of
    nothing. An empty table gives no rows. Further columns are not read.
    """
    columns = {c: F.col(c) for c in FIELDS}
    instead = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaves = stage_table(docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", leaf_digest(columns).alias("digest"),
        F.when(instead, leaf_digest(columns | (changed or {}))).alias("other")), "merkle-leaves")
    ranked = _ranked(leaves, ["doc_id", "digest"], "merkle-rows")
    levels = _levels(ranked, "merkle-level")
    top = ranked.where("leaves = 1").select("tree", "leaves", "digest")
    for level in levels:
        top = top.unionByName(level.where("hi - lo = leaves").select("tree", "leaves", "digest"))
    top = stage_table(top, "merkle-subroots")

    # the subroots are the leaves of one more tree
    of = top.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("leaves").alias("of_leaves"), "digest")
    subroots = _ranked(of, ["of"], "merkle-forest")
    upper = _levels(subroots, "merkle-upper")
    root = (upper[-1] if upper else subroots).select("digest").first()
    root_digest = F.lit(bytes(root.digest) if root else b"")
    count = subroots.count()
    one_tree = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(count).alias("leaves"),
                                                 F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    tops = _paths(subroots, upper, one_tree, []).select(
        F.col("of").alias("tree"), F.col("of_leaves").alias("leaves"), "path", F.col("digest").alias("subroot"))
    tops = stage_table(tops, "merkle-tops")

    def as_hex(value: Column) -> Column:
        return F.lower(F.hex(value))

    found = _paths(ranked, levels, tops, ["subroot"])
    siblings = _joined(F.flatten(F.transform("path", lambda run: F.array(run["left"], run["right"]))))
    return found.withColumn("folded", fold(F.coalesce("other", "digest"), F.col("path"))).select(
        "doc_id", as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"),
        as_hex(root_digest).alias("root"), F.sha2(as_hex(siblings).cast("binary"), 256).alias("proof_sha256"),
        as_hex(F.col("folded")).alias("folded_root"), (F.col("folded") == root_digest).alias("verified"))


def _tree_sql(leaves: str, prefix: str, name: str, levels: int) -> str:
    """Levels of hash trees as SQL: from ``leaves`` (tree, i, digest), tables ``prefix``0 to ``prefix``levels."""
    out = f"{prefix}0 AS MATERIALIZED (SELECT tree, i, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"
    for k in range(levels):
        out += f""",
{name}{k} AS MATERIALIZED (SELECT tree, i // {FAN} AS i, n, list(digest ORDER BY i) AS run,
  CASE WHEN n = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY i)) END AS digest
  FROM {prefix}{k} GROUP BY tree, i // {FAN}, n),
{prefix}{k + 1} AS MATERIALIZED (SELECT tree, i, digest, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k})"""
    return out


def _climb_sql(start: str, name: str, runs: str, levels: int) -> str:
    """From ``start`` (doc, tree, i, node, proof), climb ``levels`` levels: tables ``name``0 to ``name``levels."""
    out = f"{name}0 AS MATERIALIZED (SELECT * FROM {start})"
    for k in range(levels):
        at = f"(c.i % {FAN})"
        out += f""",
{name}{k + 1} AS MATERIALIZED (SELECT c.* EXCLUDE (i, node, proof), c.i // {FAN} AS i,
  CASE WHEN r.n = 1 THEN c.node ELSE sha256(array_to_string(run[:{at}], '') || c.node || array_to_string(run[{at} + 2:], '')) END AS node,
  CASE WHEN r.n = 1 THEN c.proof ELSE c.proof || array_to_string(run[:{at}], '') || array_to_string(run[{at} + 2:], '') END AS proof
  FROM {name}{k} c JOIN {runs}{k} r ON r.tree = c.tree AND r.i = c.i // {FAN})"""
    return out


SQL_LEVELS = 10  # 8 ** 10 rows of a language


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if c == "text" else c) for c in FIELDS) + ")"


# DuckDB has no CRC-32: the table of the usual polynomial is made first, then each id's digits are folded through it.
MANIFEST_SQL = f"""
WITH RECURSIVE bits(byte, step, value) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT byte, step + 1, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END FROM bits WHERE step < 8),
crc_table AS MATERIALIZED (SELECT list(value ORDER BY byte) AS t FROM bits WHERE step = 8),
ids AS MATERIALIZED (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL),
crcs AS MATERIALIZED (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
    LAMBDA crc, c: xor(crc // 256, t[xor(crc % 256, c) + 1])), 4294967295) AS crc FROM ids, crc_table),
docs AS MATERIALIZED (
  SELECT d.doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS digest,
    CASE WHEN coalesce(crc % 3 = 0, false) THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents d LEFT JOIN crcs USING (doc_id)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i FROM docs),
{_tree_sql("ranked", "level", "runs", SQL_LEVELS)},
subroots AS MATERIALIZED (
  SELECT tree AS lang_tree, '' AS tree, row_number() OVER (ORDER BY encode(level{SQL_LEVELS}.tree)) - 1 AS i, digest FROM level{SQL_LEVELS}),
{_tree_sql("subroots", "upper", "upper_runs", SQL_LEVELS)},
begun AS (SELECT row_number() OVER () AS row, doc_id, tree, i, digest AS leaf, coalesce(other, digest) AS node, '' AS proof FROM ranked),
{_climb_sql("begun", "climb", "runs", SQL_LEVELS)},
begun_upper AS (SELECT c.doc_id, c.leaf, s.digest AS subroot, s.tree, s.i, c.node, c.proof
  FROM climb{SQL_LEVELS} c JOIN subroots s ON s.lang_tree = c.tree),
{_climb_sql("begun_upper", "high", "upper_runs", SQL_LEVELS)}
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = u.digest AS verified
FROM high{SQL_LEVELS} h JOIN upper{SQL_LEVELS} u ON u.tree = h.tree
"""


def lowered_thirds() -> tuple[Column, dict[str, Column]]:
    """What the query tampers with: where 3 divides the checksum of the id's digits, A-Z of the text in lower case."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return third, {"text": F.translate("text", UPPER, LOWER)}


@query("op11_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark, sf_dir) -> DataFrame:
    return manifest(documents(spark, sf_dir), *lowered_thirds())
