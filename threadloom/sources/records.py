"""CSV records from files that are split: quoted cells may hold line breaks, and one huge sheet is read by many tasks.

Where a split begins, nobody there knows whether it lies inside a quoted cell. Each line is therefore a function from
the state before it (outside or inside quotes) to the state after it: a line without quotes keeps the state, one with
an opening quote alone swaps it, most others end in one state whatever they began in. Functions are composed line by
line within a split and, one narrow row per split, over the splits of a file; then each line's state is known, and
with it the borders of the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.functions.bind import bind

SPLIT = ["file", "split"]


def quote_states(line: Column) -> Column:
    """(outside, inside): whether the line ends inside quotes, for either state before it.

    Doubled quotes don't change the state and are taken out. Of the others one closes a quoted cell where there is
    one, else opens a cell if it stands at the cell's start; anywhere else it is an ordinary character.
    """
    pieces = F.split(F.replace(line, F.lit('""'), F.lit("")), '"', -1)

    def opens(piece: Column, at: Column) -> Column:
        return piece.endswith(",") | ((at == 0) & (piece == ""))

    before = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p, i: opens(p, i))
    start = F.struct(F.lit(False).alias("outside"), F.lit(True).alias("inside"))
    step = lambda s, o: F.struct((~s["outside"] & o).alias("outside"), (~s["inside"] & o).alias("inside"))
    # the first quote after a start inside closes, whatever stands before it: ~True & o is False
    return F.when(line.contains('"'), F.aggregate(before, start, step)).otherwise(start)


def _state_before(rows: DataFrame, window, first: Column, outside: str, inside: str, out: str) -> DataFrame:
    """``out``: the state before each row of ``window``, which begins in the state ``first``.

    A row whose end doesn't depend on its beginning sets the state; since the last such row only swaps count.
    """
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    sets, swap = F.col(outside) == F.col(inside), (F.col(outside) & ~F.col(inside)).cast("bigint")
    swaps = F.coalesce(F.sum(swap).over(earlier), F.lit(0))
    rows = rows.withColumn("__swaps", swaps)
    last = F.last(F.when(sets, F.struct(F.col(outside).alias("state"), F.col("__swaps").alias("swaps"))), True).over(earlier)
    rows = rows.withColumn("__set", last)
    since = F.col("__swaps") - F.coalesce(F.col("__set.swaps"), F.lit(0))
    return rows.withColumn(out, F.coalesce(F.col("__set.state"), first) != (since % 2 == 1)).drop("__swaps", "__set")


def read_records(spark: SparkSession, files) -> DataFrame:
    """``file, seq, record``: the records of CSV files without their header, ``seq`` dense from 0 within a file.

    Line breaks inside quotes stay; a carriage return before a line's end goes; blank lines are no records. A quote
    that is never closed makes the rest of its file one record. The lines are shuffled once, by split, and their states
    travel as one row per split; only records that lie in more than one split are gathered.
    """
    raw = spark.read.option("lineSep", "\n").text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    lines = bind(raw, states=quote_states(F.col("value"))).select(*SPLIT, "at", "value", "states.outside", "states.inside")
    in_split = Window.partitionBy(*SPLIT).orderBy("at")
    of_file = Window.partitionBy("file").orderBy("split")
    local = lines
    for start in (False, True):
        local = _state_before(local, in_split, F.lit(start), "outside", "inside", f"from_{'inside' if start else 'outside'}")
    # per split: its own function, and for either beginning how many records start in it and where the last one does
    ends = {}
    for name in ("outside", "inside"):
        starts = ~F.col(f"from_{name}")
        after = F.when(F.col(f"from_{name}"), F.col("inside")).otherwise(F.col("outside"))
        blank = starts & ~after & (F.trim(F.replace("value", F.lit("\r"), F.lit(""))) == "")
        ends |= {f"end_{name}": F.max_by(after, "at"), f"n_{name}": F.count_if(starts & ~blank)}
    splits = local.groupBy(*SPLIT).agg(*[c.alias(n) for n, c in ends.items()])
    splits = _state_before(splits, of_file, F.lit(False), "end_outside", "end_inside", "begin")
    n = F.when(F.col("begin"), F.col("n_inside")).otherwise(F.col("n_outside"))
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("begin"), F.col("end_inside")).otherwise(F.col("end_outside"))
    splits = splits.withColumn("n", n).select(
        *SPLIT, "begin", "n", ends.alias("ends_inside"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("records_before"))
    known = local.join(splits, SPLIT).withColumn(
        "inside_before", F.when(F.col("begin"), F.col("from_inside")).otherwise(F.col("from_outside")))
    known = known.withColumn("inside_after", F.when(F.col("inside_before"), F.col("inside")).otherwise(F.col("outside")))
    blank = ~F.col("inside_before") & ~F.col("inside_after") & (F.trim(F.replace("value", F.lit("\r"), F.lit(""))) == "")
    begun = F.sum((~F.col("inside_before") & ~blank).cast("bigint")).over(
        in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = known.withColumn("no", F.col("records_before") + begun - 1).where(~blank)
    # a record within one split is put together where the split's lines are; only those over a border are gathered
    of_next = F.col("ends_inside") & (F.col("no") == F.col("records_before") + F.col("n") - 1)
    crossing = (F.col("no") < F.col("records_before")) | of_next

    def joined(lines: DataFrame, keys: list[str]) -> DataFrame:
        return lines.groupBy(*keys).agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda p: p["value"]), "\n").alias("record"))

    whole = joined(placed.where(~crossing), [*SPLIT, "no"]).drop("split")
    parts = joined(placed.where(crossing), ["file", "no"])
    records = whole.unionByName(parts).where("no > 0")  # the first record is the header
    return records.select("file", (F.col("no") - 1).alias("seq"), F.regexp_replace("record", "\r$", "").alias("record"))
