"""A stored trigram index over review texts: searches read only the files that can hold a hit."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronvoice.operators.search import search_hits

#: Letters that a case-blind match takes for an ASCII one, each with that one (fixed by Unicode).
_FOLD_FROM, _FOLD_TO = ascii_uppercase + "\u0131\u0130\u017f\u212a", ascii_lowercase + "iisk"
#: Folders of the index; a search opens those of its own trigrams.
GRAM_FOLDERS = 32
#: The ids of so many files are broadcast at most: 8 bytes each.
BROADCAST_FILES = 1_000_000


def required_texts(query: str, mode: str = "regex") -> list[list[str]] | None:
    """Per alternative of the query the plain ASCII texts that each of its matches holds.

    Errs on the side of too little: groups and classes count as anything, and None, that
    is no bound at all, stands for syntax this does not look into.
    """
    if mode == "literal":
        return [_runs(re.sub(r"[^\x20-\x7e]", "\0", query))]
    if re.search(r"\(\?(?!:)|\\[QEupPxNck0-9]|&&", query):
        return None
    plain = re.sub(r"\\[A-Za-z]", "\0", query)  # \d, \b and the like
    if re.search(r"\[[^\]\\]*[\[\\]|\[\^?\]", plain):
        return None  # classes with brackets or escapes inside
    plain = re.sub(r"\\(.)", lambda m: "\0" if m[1] in "()[]{}|?*+.^$\\" else m[1], plain, flags=re.S)
    plain = re.sub(r"\[[^\]]*\]", "\0", plain)
    while (inner := re.sub(r"\([^()]*\)", "\0", plain)) != plain:
        plain = inner
    # what a quantifier may leave out or repeat ends a text
    plain = re.sub(r".(?:[?*]|\{[^}]*\})[?+]?", "\0", plain, flags=re.S)
    plain = re.sub(r"(.)\+[?+]?", "\\1\0", plain, flags=re.S)
    if re.search(r"[()\[\]{}?*+]", plain):
        return None
    return [_runs(re.sub(r"[.^$]|[^\x20-\x7e]", "\0", part)) for part in plain.split("|")]


def _runs(text: str) -> list[str]:
    folded = text.translate(str.maketrans(_FOLD_FROM, _FOLD_TO))
    return [run for run in folded.split("\0") if len(run) >= 3]


def _grams_of(text: Column) -> Column:
    """Distinct trigrams of printable ASCII; the look-ahead steps through a text once."""
    folded = F.translate(text, _FOLD_FROM, _FOLD_TO)
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(r"(?=([\x20-\x7e]{3}))"), F.lit(1)))


def _folder_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_FOLDERS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Reviews in many files under ``rows`` and, under ``grams``, which trigram occurs in which file."""

    rows: DataFrame
    grams: DataFrame
    file_col: str
    files: int

    def candidates(self, query: str, mode: str = "regex") -> DataFrame | None:
        """(file) that hold all trigrams of one alternative of the query; None if any file may match."""
        wanted = required_texts(query, mode) if query else None
        if wanted is None or not all(wanted):
            return None
        sets = [sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)}) for runs in wanted]
        every = sorted(set().union(*sets))
        spark = self.grams.sparkSession
        folders = spark.createDataFrame([(g,) for g in every], "gram string").select(_folder_of(F.col("gram"))).distinct()
        found = self.grams.where(F.col("folder").isin([r[0] for r in folders.collect()]) & F.col("gram").isin(every))
        held = [F.count_if(F.col("gram").isin(some)) == len(some) for some in sets]
        flags = found.groupBy("file").agg(*[h.alias(f"h{i}") for i, h in enumerate(held)])
        return flags.where(" OR ".join(f"h{i}" for i in range(len(held)))).select("file")

    def hits(self, query: str = "", topic: str | None = None, sentiment: str | None = None, mode: str = "regex") -> DataFrame:
        """The rows of `search_hits` over all reviews; each candidate's text is matched again.

        Files without a hit are skipped before they are opened (Spark prunes the folders
        of the join). A query without three plain characters in a row reads all files.
        """
        files = self.candidates(query, mode)
        rows = self.rows
        if files is not None:
            files = files.withColumnRenamed("file", self.file_col)
            rows = rows.join(F.broadcast(files) if self.files <= BROADCAST_FILES else files, self.file_col, "left_semi")
        return search_hits(rows, query, topic, sentiment, mode).drop(self.file_col)

    def read_report(self, query: str, mode: str = "regex") -> DataFrame:
        """One row: all files, and those the query reads."""
        files = self.candidates(query, mode)
        read = F.lit(self.files).cast("bigint") if files is None else F.count(F.lit(1))
        source = self.grams.sparkSession.range(1) if files is None else files
        return source.select(F.lit(self.files).cast("bigint").alias("files"), read.alias("files_read"))


def build_search_index(reviews: DataFrame, folder: str, text_col: str = "review_text", rows_per_file: int = 20_000) -> SearchIndex:
    """Writes the reviews, cut by the hash of whole rows into files of about ``rows_per_file``, and their trigrams.

    Rows of one text spread by their other columns; equal rows share a file. (trigram,
    file) pairs are made distinct in the task that reads the file, before the exchange,
    so a frequent trigram costs one row per file. Null and short texts have no trigram
    and are found by queries that read everything.
    """
    file_col = "_file"
    while file_col.lower() in {c.lower() for c in reviews.columns}:
        file_col += "_"
    files = max(1, math.ceil(reviews.count() / rows_per_file))
    # JSON covers columns that have no hash of their own, such as maps
    number = F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in reviews.columns]))), F.lit(files)).cast("int")
    numbered = reviews.withColumn(file_col, number)
    numbered.repartition(file_col).write.partitionBy(file_col).parquet(f"{folder}/rows")
    spark = reviews.sparkSession
    rows = spark.read.schema(numbered.schema).parquet(f"{folder}/rows")
    pairs = rows.select(F.explode(_grams_of(F.col(text_col))).alias("gram"), F.col(file_col).alias("file")).distinct()
    stored = pairs.withColumn("folder", _folder_of(F.col("gram"))).repartition("folder").sortWithinPartitions("folder", "gram")
    stored.write.partitionBy("folder").parquet(f"{folder}/grams")
    return open_search_index(spark, folder, numbered, file_col, files)


def open_search_index(spark: SparkSession, folder: str, like: DataFrame, file_col: str = "_file", files: int | None = None) -> SearchIndex:
    """The index written before; ``like`` has its columns, the file number last."""
    rows = spark.read.schema(like.schema).parquet(f"{folder}/rows")
    grams = spark.read.schema("gram string, file int, folder int").parquet(f"{folder}/grams")
    return SearchIndex(rows, grams, file_col, rows.select(file_col).distinct().count() if files is None else files)
