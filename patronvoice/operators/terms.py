"""Terms of texts and their class-based TF-IDF weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronvoice.functions import keyword_weight_map
from patronvoice.functions.text import WORD
from patronvoice.operators.joins import lookup_join


#: Words of the texts whose terms are summed at once, beyond one text; bounds the memory of a task.
WORDS = 1 << 20


def stop_words(languages: Sequence[str] = ("english",)) -> list[str]:
    """Spark's own lists; needs a running session."""
    return sorted({w for lang in languages for w in StopWordsRemover.loadDefaultStopWords(lang)})


def tokens(c: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-case words of two or more characters, without the stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]{{2,}})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(list(stop))) if stop else words


def _ngrams(words: Column, n: int) -> Column:
    grams = words
    for i in range(1, n):
        rest = F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1)))
        # the shorter list ends first; the padded tail is null and dropped
        grams = F.zip_with(grams, rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.filter(grams, lambda g: g.isNotNull()) if n > 1 else grams


def _all_ngrams(words: Column, ngrams: tuple[int, int]) -> Column:
    return F.concat(*[_ngrams(words, n) for n in range(ngrams[0], ngrams[1] + 1)])


def explode_known_terms(
    df: DataFrame,
    text_col: str,
    carry: Sequence[str],
    known: Sequence[str],
    ngrams: tuple[int, int] = (1, 2),
    stop: Sequence[str] = (),
) -> DataFrame:
    """One row per text and each of the known terms it holds; the rest never leaves its row."""
    words = df.select(*carry, tokens(F.col(text_col), stop).alias("_words"))
    held = F.filter(_all_ngrams(F.col("_words"), ngrams), lambda t: t.isin(list(known)))
    return words.select(*carry, F.explode(F.array_distinct(held)).alias("term"))


def explode_terms(
    df: DataFrame, text_col: str, carry: Sequence[str], ngrams: tuple[int, int] = (1, 2), stop: Sequence[str] = ()
) -> DataFrame:
    """One row per occurrence: carried columns, term, and 1 at its first occurrence in the text.

    The flag comes from sorting the terms inside the row, so counting documents
    needs no shuffle by document.
    """
    words = df.select(*carry, tokens(F.col(text_col), stop).alias("_words"))
    terms = words.select(*carry, F.sort_array(_all_ngrams(F.col("_words"), ngrams)).alias("_terms"))
    # next to each term its predecessor; the predecessors are one longer
    pairs = F.arrays_zip(F.col("_terms").alias("term"), F.concat(F.array(F.lit("")), F.col("_terms")).alias("before"))
    return (
        terms.select(*carry, F.inline(pairs).alias("term", "before"))
        .where(F.col("term").isNotNull())
        .select(*carry, "term", (F.col("term") != F.col("before")).cast("int").alias("first"))
    )


def _summed_terms(df: DataFrame, text_col: str, topic_col: str, ngrams: tuple[int, int], stop: Sequence[str]) -> DataFrame:
    """(topic, term, tf, docs): occurrences and texts, summed within batches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
            ends, at = np.cumsum(sizes), 0
            while at < len(batch):
                start, to = at, max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + WORDS, "right")))
                part, at = batch.slice(start, to - start), to
                words = part.column(1).flatten()
                text = np.repeat(np.arange(len(part)), sizes[start:to])
                texts, terms = [], []
                for n in range(ngrams[0], ngrams[1] + 1):
                    count = max(0, len(words) - n + 1)
                    whole = text[:count] == text[len(text) - count :]
                    grams = pc.binary_join_element_wise(*[words.slice(i, count) for i in range(n)], " ") if n > 1 else words
                    texts.append(text[:count][whole])
                    terms.append(grams.filter(pa.array(whole)))
                each = pa.table({"text": np.concatenate(texts), "term": pa.chunked_array(terms, pa.string())}).group_by(["text", "term"]).aggregate([([], "count_all")])
                each = each.append_column("topic", part.column(0).take(each["text"].combine_chunks()))
                found = each.group_by(["topic", "term"]).aggregate([("count_all", "sum"), ("count_all", "count")])
                columns = [found[c] for c in ("topic", "term", "count_all_sum", "count_all_count")]
                yield from pa.table(columns, names=[topic_col, "term", "tf", "_docs"]).to_batches()

    words = df.select(topic_col, tokens(F.col(text_col), stop).alias("_words"))
    topic = df.select(topic_col).schema[0].dataType.simpleString()
    return words.mapInArrow(run, f"`{topic_col}` {topic}, term string, tf bigint, _docs bigint")


def term_counts(
    df: DataFrame,
    text_col: str,
    topic_col: str,
    ngrams: tuple[int, int] = (1, 2),
    min_df: int = 5,
    max_df: float = 0.90,
    max_features: int | None = None,
    stop: Sequence[str] = (),
) -> DataFrame:
    """(topic, term, tf) of the terms within the document-frequency limits.

    Occurrences are summed per (topic, term) before anything is compared, so a
    frequent term or a topic holding a third of the texts shuffles as sums.
    """
    counted = (
        _summed_terms(df, text_col, topic_col, ngrams, stop).repartition("term")
        .groupBy(topic_col, "term")
        .agg(F.sum("tf").alias("tf"), F.sum("_docs").alias("_docs"))
    )
    by_term = Window.partitionBy("term")  # one row per topic
    documents = df.agg(F.count(F.lit(1))).scalar()
    kept = counted.withColumns({"_df": F.sum("_docs").over(by_term), "_all": F.sum("tf").over(by_term)}).where(
        (F.col("_df") >= min_df) & (F.col("_df") <= max_df * documents)
    )
    if max_features is not None:
        vocabulary = kept.select("term", "_all").distinct().orderBy(F.desc("_all"), "term").limit(max_features)
        kept = kept.join(vocabulary.select("term"), "term", "left_semi")
    return kept.select(topic_col, "term", "tf")


def class_tfidf(counts: DataFrame, topic_col: str) -> DataFrame:
    """Adds ``weight`` = tf / terms in class x ln(1 + mean terms per class / term total)."""
    per_class = counts.groupBy(topic_col).agg(F.sum("tf").alias("_class"))
    mean_terms = per_class.agg(F.sum("_class") / F.count(F.lit(1))).scalar()
    by_term = Window.partitionBy("term")
    return (
        lookup_join(counts.withColumn("_term", F.sum("tf").over(by_term)), per_class, [topic_col], salts=16)
        .withColumn("weight", F.col("tf") / F.col("_class") * F.log1p(mean_terms / F.col("_term")))
        .drop("_class", "_term")
    )


def top_terms(weights: DataFrame, topic_col: str, k: int = 10, by: str = "weight") -> DataFrame:
    """The k heaviest terms per topic with their rank; Spark limits each task to k before the shuffle."""
    w = Window.partitionBy(topic_col).orderBy(F.desc(by), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_keywords(weights: DataFrame, topic_col: str, k: int = 10, by: str = "weight") -> DataFrame:
    """(topic, keywords, kw_weights): term list and term -> weight map of the k heaviest."""
    ranked = top_terms(weights, topic_col, k, by)
    listed = ranked.groupBy(topic_col).agg(F.array_sort(F.collect_list(F.struct("rank", "term", by))).alias("t"))
    words = F.transform("t", lambda t: t["term"])
    return listed.select(
        topic_col, words.alias("keywords"), keyword_weight_map(words, F.transform("t", lambda t: t[by]), k).alias("kw_weights")
    )
