"""Line dedup by overlapping three-line windows, in DataFrame functions only.

A line ends at a line break, or behind a full stop, exclamation mark, question mark or
comma that a blank follows; so a passage is found wherever it stands in a paragraph, and
whatever is wrapped around it. Every three consecutive lines (without the blank or line
break that ends them, the outer two not empty) are a window, however short. Windows are
compared by 96 bits of hashes. The first occurrence in the order (doc_id, hash of the text,
position) stays; the lines that later occurrences cover are merged into runs, and runs of at
least ``MIN_CHARS`` characters are removed. Every removed line has an equal line earlier in
that order, so each content stays at least once.

Plan: (1) an aggregate that combines in the tasks gives each repeated window's number and
its first occurrence; this narrow table is stored; (2) all windows meet it, and those that
are not the first are the later ones; windows with more than ``PART`` occurrences and a
ten-thousandth of all, of which there are ten thousand at most, are dealt over parts; (3)
the covered positions of each document are merged into runs, and the long ones cut out of
its text. No window's occurrences are ever gathered in one task.

Defined results: null texts stay null and have no lines; empty and short texts stay as they
are; rows that repeat a document exactly share its result; rows with the same doc_id (or
none) and other text are told apart by 96 bits of hashes of the text; null doc_ids come first
in the order; a text of any length is one row of line hashes; an empty table gives an empty
result; other columns of the rows are kept, but ``removed_lines`` and ``removed_runs``
replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import stored

LINES = 3
#: Shorter runs of repeated lines are phrases that clean documents share by chance.
MIN_CHARS = 60
#: Occurrences of one window that one task joins with its first; more may be dealt over parts.
PART = 4096
#: Most windows that are dealt over parts: the most frequent of all, told to every task.
HOT_WINDOWS = 10_000


def pieces(text) -> F.Column:
    """Lines of a text with their ends; joined they are the text again."""
    return F.split(text, r"(?<=\n|[.!?,] )")


def contents(text) -> F.Column:
    """The same lines without the blank or line break that ends them: what is compared.
    The pattern starts with the rare character, so most positions are passed at once."""
    return F.split(text, r"[ \n](?<=\n|[.!?,] )")


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, t1, place, k1, k2 of every window. ``t1`` and the high half of ``place`` tell
    texts apart, its low half is the position; ``k1`` and ``k2`` are the window's hashes."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("t1"), F.hash("text").cast("long").alias("t2"),
                                                  contents("text").alias("lines"))
    empty = F.transform("lines", lambda p: p == "")
    rows = rows.select("doc_id", "t1", "t2", F.transform("lines", lambda p: F.xxhash64(p)).alias("hs"), empty.alias("empty"))
    # The outer form and coalesce: from a plain explode, a filter on the array's size or a
    # comparison that needs the array the optimizer infers a filter that splits every text again.
    rows = rows.select("doc_id", "t1", "t2", "hs", "empty", F.posexplode_outer("hs").alias("pos", "h"))
    h = [F.col("h"), *[F.get("hs", F.col("pos") + i) for i in range(1, LINES)]]
    blank = [F.coalesce(F.get("empty", F.col("pos") + i), F.lit(True)) for i in (0, LINES - 1)]
    rows = rows.filter((F.col("pos") <= F.size("hs") - LINES) & ~blank[0] & ~blank[1])
    return rows.select("doc_id", "t1", (F.shiftleft("t2", 32) + F.col("pos")).alias("place"),
                       F.xxhash64(*h).alias("k1"), F.hash(*h[1:], h[0]).alias("k2"))


def later_windows(docs: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, t1, place) of every window that has an earlier occurrence."""
    all_windows, occurrence = windows(docs), F.struct("doc_id", "t1", "place")
    firsts = all_windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(occurrence).alias("first")).filter("n > 1")
    firsts = stored(firsts, "repeated-windows")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(part, total // HOT_WINDOWS)
    parts = F.when(F.col("n") > least, F.ceil(F.col("n") / least)).otherwise(1).cast("int")
    hot = firsts.filter(F.col("n") > least).select("k1", "k2", parts.alias("parts"))  # HOT_WINDOWS rows at most
    own = F.pmod(F.xxhash64("doc_id", "t1", "place"), F.coalesce("parts", F.lit(1))).cast("int")
    rows = all_windows.join(F.broadcast(hot), ["k1", "k2"], "left").withColumn("part", own).drop("parts")
    side = firsts.select("k1", "k2", "first", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    joined = rows.join(side, ["k1", "k2", "part"])
    return joined.filter(~occurrence.eqNullSafe(F.col("first"))).select("doc_id", "t1", "place")


def covered_runs(docs: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, t1, t2, runs: per document with later windows the merged runs (first, last)
    of covered line positions, in order."""
    at = later_windows(docs, part).select("doc_id", "t1", F.shiftright("place", 32).alias("t2"),
                                          F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    # Sets of one text's positions, put together in the tasks first: one narrow shuffle.
    at = at.groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    n = F.size("at")
    first = F.filter("at", lambda x, i: (i == 0) | (x > F.get("at", i - 1) + LINES))
    last = F.filter("at", lambda x, i: (i == n - 1) | (F.get("at", i + 1) > x + LINES))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + LINES - 1).alias("last")))
    return at.select("doc_id", "t1", "t2", runs.alias("runs"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, part: int = PART) -> DataFrame:
    """``docs`` with later occurrences cut out of ``text``; adds ``removed_lines`` (long)
    and ``removed_runs``, which replace columns of these names."""
    names = [c for c in docs.columns if c not in ("removed_lines", "removed_runs")]
    runs = covered_runs(docs.select("doc_id", "text"), part).select(
        F.col("doc_id").alias("_id"), F.col("t1").alias("_r1"), F.col("t2").alias("_r2"), F.col("runs").alias("_found"))
    rows = docs.select(*names, F.xxhash64("text").alias("_t1"), F.hash("text").cast("long").alias("_t2"))
    rows = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("_r1"))
                     & (F.col("_t2") == F.col("_r2")), "left")
    rows = rows.withColumn("_lines", F.when(F.col("_found").isNotNull(), pieces("text")))
    chars = lambda r: F.length(F.array_join(F.slice("_lines", r["first"] + 1, r["last"] - r["first"] + 1), ""))
    long = F.filter("_found", lambda r: chars(r) >= min_chars)
    rows = rows.withColumn("_long", long).withColumn("_runs", F.when(F.size("_long") > 0, F.col("_long")))
    n = F.size("_runs")
    gap = lambda j: F.slice(  # noqa: E731  the lines between run j - 1 and run j
        "_lines", F.when(j == 0, 1).otherwise(F.get("_runs", j - 1)["last"] + 2),
        F.when(j == n, F.size("_lines")).otherwise(F.get("_runs", j)["first"])
        - F.when(j == 0, 0).otherwise(F.get("_runs", j - 1)["last"] + 1))
    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), gap)), "")
    cut = F.aggregate("_runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return rows.select(
        *[F.when(F.col("_runs").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in names],
        F.coalesce(cut, F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce("_runs", F.array().cast("array<struct<first:int,last:int>>")).alias("removed_runs"))
