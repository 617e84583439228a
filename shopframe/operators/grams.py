"""Contains search by postings of character grams.

``GramIndex`` keeps, for the grams of one, two and three characters of a row's lower-cased texts, which rows hold them.
A needle of three or more characters is answered from its rarest gram: the rows in that gram's postings are the only
ones read and compared. One and two characters are grams themselves, so they need no scan either. A needle that is
written with wildcards uses the longest runs between them; one that holds nothing but wildcards is the plain scan.

Postings may be stale, never short: rows that were added or altered are appended with ``add``, what they no longer hold
is refused by the comparison, and the counts only choose the gram. Files are cut by a hash of the gram and then of the
key (``spread`` parts a bucket), larger parts into pieces of the advised partition size, and sorted by gram, so that a
reader skips the others. Rows are dealt to tasks by their number before they become postings, so no task's memory grows
with the table.

Defined results: as ``predicates.search`` gives them by reading all texts. A null text holds nothing, an empty needle
puts no condition, needles and rows that repeat stay repeated rows, of a null key no posting is kept and such rows are
compared directly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import escape_like, search

LONGEST = 3
ROWS_A_TASK = 50_000  # rows whose postings one task makes


def grams_of(text: str | Column) -> Column:
    """The distinct grams of one to three characters of the lower-cased text; none of a null."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)

    def of_length(n: int) -> Column:
        last = F.length(low) - F.lit(n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(n))))

    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(of_length(n), none) for n in range(1, LONGEST + 1)]))


def literal_runs(pattern: str) -> list[str]:
    """The texts between the wildcards of a LIKE pattern whose escape is a backslash."""
    runs, run, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            run += pattern[at]
        elif c in "%_":
            runs.append(run)
            run = ""
        else:
            run += c
        at += 1
    return [r for r in [*runs, run] if r]


def needle_grams(runs: Sequence[str]) -> list[str]:
    """Grams that every text with all runs holds: the longest that each run allows."""
    out = set()
    for r in runs:
        n = min(LONGEST, len(r))
        out.update(r[i:i + n] for i in range(len(r) - n + 1))
    return sorted(out)


class GramIndex:
    """Postings of one table below ``root``; ``key`` tells its rows apart, ``cols`` are the texts searched."""

    def __init__(self, spark: SparkSession, root: str, key: str, cols: Sequence[str], buckets: int = 64, spread: int = 4):
        self.spark, self.root, self.key, self.cols = spark, root.rstrip("/"), key, list(cols)
        self.buckets, self.spread = int(buckets), int(spread)

    def add(self, rows: DataFrame, batch: str | int = 0) -> None:
        """Add the postings of new or altered rows under a batch key; a batch that is repeated replaces itself."""
        named = rows.where(F.col(self.key).isNotNull())
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-named.count() // ROWS_A_TASK))
        texts = named.select(F.col(self.key).alias("k"), F.array(*[F.col(c) for c in self.cols]).alias("texts"))
        # dealt out before the texts become some hundred postings each; a key that repeats is one row from here on
        texts = texts.repartition(tasks, "k").groupBy("k").agg(F.flatten(F.collect_set("texts")).alias("texts"))
        grams = F.array_distinct(F.flatten(F.transform("texts", grams_of)))
        found = texts.select("k", F.explode(grams).alias("gram")).withColumn("b", self._bucket("gram"))
        # Spark cuts a bucket's rows into pieces of the advised size, however many there are
        found = found.withColumn("s", F.pmod(F.hash("k"), F.lit(self.spread)))
        (found.hint("rebalance", "b", "s").sortWithinPartitions("b", "gram").drop("s")
         .write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/postings/batch={batch}"))
        written = self.spark.read.parquet(f"{self.root}/postings/batch={batch}")
        counts = written.groupBy("b", "gram").agg(F.count(F.lit(1)).alias("n"))
        (counts.repartition(self.buckets, "b").sortWithinPartitions("gram")
         .write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/counts/batch={batch}"))

    def _bucket(self, gram: str) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def rarest(self, grams: Sequence[str]) -> tuple[str, int]:
        """The gram with the fewest postings, and how many; a gram without any ends the search. As many rows as the
        needle has grams reach the driver."""
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string").withColumn("b", self._bucket("gram"))
        places = [r["b"] for r in asked.select("b").distinct().collect()]
        counts = (self._read("counts").where(F.col("b").isin(places) & F.col("gram").isin(list(grams)))
                  .groupBy("gram").agg(F.sum("n").alias("n")))
        known = {r["gram"]: r["n"] for r in counts.collect()}
        return min(((g, known.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))

    def postings(self, gram: str) -> DataFrame:
        """(k) of the rows that hold the gram: one folder, its other grams skipped by the files' statistics."""
        place = self.spark.createDataFrame([(gram,)], "gram string").select(self._bucket("gram")).first()[0]
        return self._read("postings").where((F.col("b") == place) & (F.col("gram") == gram)).select("k").distinct()

    def search(self, rows: DataFrame, needle: str | None, escape: bool = False) -> DataFrame:
        """The rows of ``rows`` that ``predicates.search(needle, cols, escape)`` keeps."""
        condition = search(needle, self.cols, escape)
        if condition is None:
            return rows
        text = escape_like(needle) if escape else needle
        low = self.spark.range(1).select(F.lower(F.lit(f"%{text}%"))).first()[0]
        grams = needle_grams(literal_runs(low))
        if not grams:
            return rows.where(condition)
        found = self.postings(self.rarest(grams)[0]).withColumnRenamed("k", "__gram_key")
        near = rows.join(found, F.col(self.key) == F.col("__gram_key"), "left_semi")
        return near.unionByName(rows.where(F.col(self.key).isNull())).where(condition)

    def search_many(self, rows: DataFrame, needles: DataFrame, needle_col: str = "needle") -> DataFrame:
        """(needle, all columns of ``rows``): every row that holds a needle, for a table of needles taken literally.
        Each needle meets only the postings of its rarest gram; null and empty needles find nothing, repeated ones
        count once, and rows without a key are not found."""
        asked = (needles.select(F.col(needle_col).alias("__needle")).where("__needle <> ''").distinct()
                 .withColumn("__low", F.lower("__needle")))
        n = F.least(F.length("__low"), F.lit(LONGEST))
        own = F.transform(F.sequence(F.lit(1), F.length("__low") - n + 1), lambda i: F.substring(F.col("__low"), i, n))
        asked = asked.withColumn("gram", F.explode(F.array_distinct(own)))
        counts = self._read("counts").groupBy("gram").agg(F.sum("n").alias("n"))
        best = (asked.join(counts, "gram", "left").groupBy("__needle", "__low")
                .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
                .where("best.n > 0").select("__needle", "__low", F.col("best.gram").alias("gram")))
        pairs = (best.join(self._read("postings").select("gram", "k"), "gram")
                 .select("__needle", "__low", F.col("k").alias("__gram_key")).distinct())
        met = rows.join(pairs, F.col(self.key) == F.col("__gram_key"))
        holds = [F.coalesce(F.contains(F.lower(c), "__low"), F.lit(False)) for c in self.cols]
        any_of = holds[0]
        for h in holds[1:]:
            any_of = any_of | h
        return met.where(any_of).select(F.col("__needle").alias(needle_col), *[F.col(f"`{c}`") for c in rows.columns])
