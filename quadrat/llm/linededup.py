"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Lines stand between newlines. Every run of three consecutive lines is hashed; windows that occur more
than once anywhere keep their first occurrence, and the lines covered by later ones are removed after
overlapping windows are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID

WINDOW = 3


def _window_hash(lines: Column, at: Column) -> Column:
    """128 bits of the lines from position at on: two differently seeded hashes of the same three lines."""
    own = [F.get(lines, at + k) for k in range(WINDOW)]
    return F.struct(F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit("second"), *reversed(own)).alias("h2"))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, at, h1, h2) for every window that has a line with a character other than white space.

    body is a hash of the whole text: rows are one document where both id and text agree. A null id sorts
    before all others. Windows of blank lines alone are no passages and stay.
    """
    lines = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("id"), F.xxhash64(text_col).alias("body"), F.split(text_col, "\n", -1).alias("lines")).filter(F.size("lines") >= WINDOW)
    full = lines.select("id", "body", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW)).alias("at"))
    blank = [F.trim(F.translate(F.get("lines", F.col("at") + k), "\t\r\x0b\x0c", "    ")) == "" for k in range(WINDOW)]
    hashed = full.filter(~(blank[0] & blank[1] & blank[2])).select("id", "body", "at", _window_hash(F.col("lines"), F.col("at")).alias("h"))
    return hashed.select("id", "body", "at", "h.h1", "h.h2")


def later(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, body, starts): the windows of each document that occurred before, by (id, hash of the text, position).

    Rows that share id and text count as one occurrence at the same place. Repeats are counted after a
    map-side sum, so a window that a third of all documents hold meets in one small row; windows that
    occur once never leave the aggregate, and the join of the rest is split by the adaptive skew join.
    """
    found = windows(docs, id_col, text_col)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "body", "at")).alias("first"), F.max(F.struct("id", "body", "at")).alias("last")).filter("first <> last")
    first = first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    again = found.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter(F.struct("id", "body", "at") != F.col("first"))
    return again.groupBy("id", "body").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """docs with the later occurrences of repeated windows taken out of the text, and docs' columns.

    removed_col names a further column with the removed line positions (from 0, ascending). A null text
    stays null, an empty one empty; texts of fewer than three lines stay as they are; a document may lose
    all lines and then has an empty text. Rows that share id and text lose the same positions; other texts under the
    same or a null id are documents of their own. All rows stay.
    """
    gone = later(docs, id_col, text_col).select(F.col("id").alias("__line_id"), F.col("body").alias("__line_body"), "starts")
    held = docs.select(F.struct(*docs.columns).alias("__line_row"), F.coalesce(F.col(id_col), F.lit(NULL_ID)).alias("__line_key"), F.xxhash64(text_col).alias("__line_own"))
    joined = held.join(gone, (F.col("__line_key") == F.col("__line_id")) & (F.col("__line_own") == F.col("__line_body")), "left")
    text = F.col("__line_row").getField(text_col)
    lines = F.split(text, "\n", -1)
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    clean = F.when(F.col("__line_gone").isNull(), text).otherwise(F.concat_ws("\n", F.transform(left, lambda i: F.get(lines, i))))
    done = joined.withColumn("__line_gone", covered)
    columns = [clean.alias(c) if c == text_col else F.col("__line_row").getField(c).alias(c) for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.sort_array("__line_gone"), F.array().cast("array<int>")).alias(removed_col))
    return done.select(*columns)
