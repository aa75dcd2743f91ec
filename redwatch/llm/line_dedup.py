"""Line dedup over a suffix array of line sequences, in DataFrame operations only.

Every line of every document is a position; documents are ordered by id (then by a hash of their text), lines by number. The
suffixes that start at the positions are ranked by distributed prefix doubling: ranks by one line, then by two, four and
so on, each from the pairs (rank here, rank half a window on), until no window repeats. A position whose window occurs
once has found its place and leaves, so only repeated runs are carried on.

The positions of equal rank are a longest-common-prefix interval: their suffixes share that many lines. All but the first of an
interval start a later copy. A maximal repeated run of n lines, 2^k <= n < 2^(k+1), is the union of its first and its last
2^k lines, so the intervals at powers of two cover every line of every run that occurs earlier; covered lines go.
The limit on characters holds per window of 2^k lines, as in the SQL form, not per maximal run: a run of short lines can stay, or
go in part, although the whole run reaches the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stages

#: Characters that a repeated window must have in all to count: blank lines and brackets repeat anyway.
MIN_CHARS = 20
KEY = ["doc_id", "print"]


def ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with ``place``: numbers that grow with the keys, by ranges of the keys."""
    return groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, print, line, h1, h2, chars: one row per line of the documents with an id and a text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    split = rows.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    # two hashes of a line stand for it
    return split.select(*KEY, "line", F.xxhash64("content").alias("h1"), F.xxhash64(F.lit("line"), "content").alias("h2"), F.char_length("content").cast("long").alias("chars"))


def intervals(lines: DataFrame, stages: Stages) -> list[tuple[int, DataFrame]]:
    """(window length, positions) per level: doc_id, print, line, pos, chars, rank, and the first position of the interval."""
    # written first: then the rows of a very common line can be split over tasks in the join
    often = stages.put(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"))
    repeated = lines.join(often, ["h1", "h2"], "left_semi").dropDuplicates([*KEY, "line"])
    # positions grow with document and line; written, so that they stay the same for every reader
    at = stages.put(repeated.repartitionByRange(*KEY, "line").sortWithinPartitions(*KEY, "line").withColumn("pos", F.monotonically_increasing_id()))
    stages.drop(often)
    here = at.select(*KEY, "line", "pos", "chars", "h1", "h2")
    keys, length, out = ["h1", "h2"], 1, []
    while True:
        groups = here.groupBy(*keys).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where("first < last").drop("last")
        groups = stages.put(ranked(groups, keys))
        level = stages.put(here.join(groups, keys).select(*KEY, "line", "pos", "chars", F.col("place").alias("rank"), "first"))
        stages.drop(groups)
        if level.isEmpty():
            stages.drop(level)
            break
        out.append((length, level))
        ahead = level.select(*KEY, (F.col("line") - length).alias("line"), F.col("rank").alias("rank2"), F.col("chars").alias("chars2"))
        here = level.join(ahead, [*KEY, "line"]).select(*KEY, "line", "pos", (F.col("chars") + F.col("chars2")).alias("chars"), "rank", "rank2")
        keys, length = ["rank", "rank2"], 2 * length
    stages.drop(at)
    return out


def later_copies(levels: list[tuple[int, DataFrame]], min_chars: int) -> DataFrame:
    """doc_id, print, ranges: per document the line ranges (start, stop) that copy earlier lines, in order and apart."""
    parts = [level.where((F.col("pos") > F.col("first")) & (F.col("chars") >= min_chars)).select(*KEY, "line", (F.col("line") + length).alias("stop")) for length, level in levels]
    windows = parts[0]
    for part in parts[1:]:
        windows = windows.unionByName(part)
    windows = windows.groupBy(*KEY, "line").agg(F.max("stop").alias("stop"))
    in_order = Window.partitionBy(*KEY).orderBy("line")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opened = windows.withColumn("new", (F.col("line") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
    numbered = opened.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*KEY, "run").agg(F.min("line").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def without(lines: Column, ranges: Column) -> Column:
    """The lines outside the ranges, as one text: the pieces between one range's end and the next one's start."""
    stops = F.concat(F.array(F.lit(0)), F.transform(ranges, lambda r: r["stop"]))
    starts = F.concat(F.transform(ranges, lambda r: r["start"]), F.array(F.size(lines)))
    pieces = F.zip_with(stops, starts, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.concat_ws("\n", F.flatten(pieces))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the input row as a struct), ``text`` (what is left), ``n_lines`` and ``n_deleted`` per input row.

    Lines are the pieces between newlines. A line goes if it lies in a window of 1, 2, 4 ... lines of its document that has at
    least ``min_chars`` characters and also starts at an earlier position, in an earlier document or further up. If nothing is left the
    text is empty. A null text stays null, with 0 lines. Rows of equal id and text are one document and keep the same
    lines; rows of equal id and different text are two documents. Rows without an id are compared with nothing. Columns
    with any names are kept apart in ``row``; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "lines")
    levels = intervals(lines_of(docs, id_col, text_col), stages)
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row")[id_col].cast("long").alias("doc_id"), F.col("row")[text_col].alias("text"))
    split = F.split("text", "\n", -1)
    total = F.when(F.col("text").isNotNull(), F.size(split)).otherwise(0).cast("long").alias("n_lines")
    if not levels:
        return rows.select("row", "text", total, F.lit(0).cast("long").alias("n_deleted"))
    ranges = stages.put(later_copies(levels, min_chars))
    stages.drop(*[level for _, level in levels])
    marked = rows.withColumn("print", F.xxhash64("text")).join(ranges, KEY, "left")
    gone = F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"]), F.lit(0).cast("long"))
    left = F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.transform(F.array(split), lambda x: without(x, F.col("ranges"))).getItem(0))
    return marked.select("row", left.alias("text"), total, gone.alias("n_deleted"))


def oracle(min_chars: int = MIN_CHARS, levels: int = 14) -> str:
    """DuckDB SQL for ``op1_line_dedup``; its doubling is written out for runs of up to 2^levels lines."""
    steps = []
    for k in range(levels):
        half = 1 << k
        steps.append(
            f"l{k + 1} AS MATERIALIZED (SELECT * FROM (SELECT x.doc_id, x.ln, x.pos, x.chars + y.chars AS chars, "
            f"min(x.pos) OVER (PARTITION BY x.first, y.first) AS first, count(*) OVER (PARTITION BY x.first, y.first) AS n "
            f"FROM l{k} x JOIN l{k} y ON x.doc_id = y.doc_id AND y.ln = x.ln + {half}) WHERE n > 1)"
        )
    windows = " UNION ALL ".join(f"SELECT doc_id, ln, ln + {1 << k} AS stop FROM l{k} WHERE pos > first AND chars >= {min_chars}" for k in range(levels + 1))
    return f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS ln FROM split WHERE text IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id, ln) AS pos FROM lines),
l0 AS MATERIALIZED (SELECT * FROM (SELECT doc_id, ln, pos, length(line) AS chars, min(pos) OVER (PARTITION BY line) AS first,
  count(*) OVER (PARTITION BY line) AS n FROM numbered) WHERE n > 1),
{", ".join(steps)},
windows AS ({windows}),
reach AS (SELECT doc_id, ln, max(stop) AS stop FROM windows GROUP BY ALL),
marked AS (SELECT n.doc_id, n.ln, n.line, coalesce(max(r.stop) OVER (PARTITION BY n.doc_id ORDER BY n.ln) > n.ln, false) AS gone
  FROM numbered n LEFT JOIN reach r ON r.doc_id = n.doc_id AND r.ln = n.ln),
done AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_deleted,
  md5(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT gone), '')) AS kept_md5 FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, kept_md5
FROM documents d LEFT JOIN done USING (doc_id)
"""
