"""Removal of repeated multi-line chunks, in DataFrame functions alone.

The lines of a text are hashed, and a rolling hash runs over each two consecutive line hashes. A chunk begins where the
rolling hash starts to be one that the corpus holds elsewhere, and ends where it stops to be: boundaries follow from the
lines beside them alone, so a shared passage gives the same chunk however the texts around it are shifted, and goes whole. A line
of ``long_line`` characters or more is a chunk even by itself. Of all occurrences the first (least id, text hash, position) stays; the lines of later ones
are compared byte by byte with all lines of their hash and removed where they are equal. Occurrences that overlap their first
one stay ("a a a" is no repeated "a a"), so every removed line has a kept copy before it.

Boundaries drawn by a rolling hash alone (every so many lines on average) would leave the ends of each passage in place, and all of a
passage that holds no whole chunk; here they are drawn by the rolling hash and its recurrence.

What is counted over the corpus are hashes, summed before they are shuffled. Texts move once: the
comparison and the removal read the same exchange. A window that holds a large share of all
rows is dealt to many tasks where it meets its first occurrence.

Defined cases: null texts stay null; empty texts stay empty; a text whose lines are all removed becomes empty; rows alike in id and text are one
document and treated alike; null ids come first; ties do not arise (id, text hash and position order all occurrences); lines of blanks are skipped when
lines are counted as consecutive, stay by themselves, and go with the line before them; repeated short single lines stay; very long texts and lines are read whole; an empty table
gives an empty table; all columns of the input are kept (names used inside may occur), ``n_chars`` is brought up to date where it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, join_spread

_HASH = 16  # bytes of a line's hash
_SALTS = 64


def _barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later expressions read as they are; Catalyst would otherwise inline them into lambdas and evaluate them per element."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _lined(rows: DataFrame) -> DataFrame:
    """``rows`` (with t_text) plus t_lines and t_at, the positions of lines that are not blank."""
    rows = _barrier(rows, t_lines=F.split(F.coalesce("t_text", F.lit("")), "\n", -1))
    filled = F.filter(F.sequence(F.lit(0), F.size("t_lines") - 1), lambda i: F.trim(F.get("t_lines", i)) != "")
    return _barrier(rows, t_at=filled)


def _windows(rows: DataFrame, long_line: int) -> DataFrame:
    """t_id, t_th, t_k, t_n, t_h: the rolling hash of every two consecutive lines, and the hash of every long line."""
    lines = F.transform("t_at", lambda i: F.get("t_lines", i))
    rows = _barrier(_lined(rows), t_full=lines)
    rows = _barrier(rows, t_hash=F.transform("t_full", lambda x: F.unhex(F.md5(x))), t_long=F.transform("t_full", lambda x: F.length(x) >= long_line)).drop("t_text", "t_lines", "t_full")
    rolling = lambda h, k: F.when(k + 1 < F.size("t_hash"), F.struct(k.alias("k"), F.lit(2).alias("n"), F.concat(h, F.get("t_hash", k + 1)).alias("h")))
    alone = lambda h, k: F.when(F.get("t_long", k), F.struct(k.alias("k"), F.lit(1).alias("n"), h.alias("h")))
    found = F.filter(F.concat(F.transform("t_hash", rolling), F.transform("t_hash", alone)), lambda u: u.isNotNull())
    return rows.select("t_id", "t_th", F.inline(found)).withColumnsRenamed({"k": "t_k", "n": "t_n", "h": "t_h"})


def _unpruned(rows: DataFrame) -> DataFrame:
    """A condition that always holds and reads every carried column, so that this join and the last one share one exchange of the texts.

    It reads ``t_asked`` too, or it would move below the join and make the exchanges differ.
    """
    read = [c for c, kind in rows.dtypes if c.startswith("t_column_") and "map<" not in kind and kind != "variant"]
    return rows.filter(F.xxhash64("t_asked", *read).cast("string") != "")


def remove_repeated_chunks(docs: DataFrame, long_line: int = 120, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``; adds lines_removed and lines_kept (long)."""
    keys = {"t_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "t_th": F.xxhash64(text_col)}
    plain = docs.select(*[c.alias(name) for name, c in keys.items()], F.col(text_col).alias("t_text")).filter(F.col("t_text").isNotNull())
    where = F.struct("t_id", "t_th", "t_k")

    seen = _windows(plain, long_line)
    # the number of rows is read in every branch, so that all of them share one aggregation
    found = seen.groupBy("t_h").agg(F.min(where).alias("t_first"), F.max(where).alias("t_last"), F.count("*").alias("t_rows"))
    repeated = found.filter("t_rows > 1 AND t_first < t_last")
    apart = (F.col("t_id") != F.col("t_first.t_id")) | (F.col("t_th") != F.col("t_first.t_th")) | (F.col("t_k") - F.col("t_first.t_k") >= F.col("t_n"))
    lines = F.transform(F.sequence(F.lit(0), F.col("t_n") - 1), lambda i: F.struct((F.col("t_k") + i).alias("k"), F.substring("t_h", i * _HASH + 1, F.lit(_HASH)).alias("line_h")))
    marks = join_spread(seen, repeated.drop("t_last", "t_rows"), "t_h", hot_keys(repeated, "t_h", "t_rows"), ["t_id", "t_th", "t_k"]).select("t_id", "t_th", apart.alias("later"), F.inline(lines))

    # the other columns travel under names of our own
    own = {c: f"t_column_{k}" for k, c in enumerate(docs.columns) if c != text_col}
    packed = docs.select(*[c.alias(name) for name, c in keys.items()], F.col(text_col).alias("t_text"), *[F.col(c).alias(name) for c, name in own.items() if c != "n_chars"])

    # lines that share a hash but not their bytes are left alone
    asked = marks.groupBy("t_id", "t_th").agg(F.collect_set("k").alias("t_asked"))
    held = _lined(_unpruned(packed.join(asked, ["t_id", "t_th"]))).select(F.explode(F.transform("t_asked", lambda k: F.get("t_lines", F.get("t_at", k)))).alias("line"))
    unequal = held.groupBy(F.unhex(F.md5("line")).alias("line_h")).agg(F.min("line").alias("least"), F.max("line").alias("most")).filter("least < most").select("line_h")
    # a frequent line meets them in many tasks; there are as good as none
    spread = marks.filter("later").withColumn("t_salt", F.pmod(F.xxhash64("t_id", "t_th", "k"), F.lit(_SALTS)).cast("int"))
    unequal = unequal.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    removals = spread.join(unequal, ["line_h", "t_salt"], "left_anti").groupBy("t_id", "t_th").agg(F.collect_set("k").alias("t_removed"))

    joined = _lined(packed.join(removals, ["t_id", "t_th"], "left"))
    end = lambda k: F.coalesce(F.get("t_at", k + 1), F.size("t_lines")) - 1
    gone = F.flatten(F.transform(F.coalesce("t_removed", F.array().cast("array<int>")), lambda k: F.sequence(F.get("t_at", k), end(k))))
    joined = _barrier(joined, t_stays=F.array_except(F.sequence(F.lit(0), F.size("t_lines") - 1), gone))
    left = F.array_join(F.transform("t_stays", lambda k: F.get("t_lines", k)), "\n")
    joined = _barrier(joined, t_new=F.when(F.col("t_removed").isNull(), F.col("t_text")).otherwise(left), t_kept=F.size("t_stays").cast("long"))
    new = {text_col: F.col("t_new")} | ({"n_chars": F.length("t_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    columns = [(new[c] if c in new else F.col(own[c])).alias(c) for c in docs.columns]
    return joined.select(*columns, (F.size("t_lines") - F.col("t_kept")).cast("long").alias("lines_removed"), F.col("t_kept").alias("lines_kept"))
