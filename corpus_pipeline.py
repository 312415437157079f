"""The training-corpus pipeline: documents in, packed sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read back as the next stage's ``docs``.  All but the last keep the
columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import decontaminate, language, neardup, packing, suffixes
from anchorline.llm.common import free_names, quoted, row_keys, ship, stage, table
from anchorline.llm.superkmers import Scheme

#: Shortest repeat that is cut out of texts, in bytes: less than fifty words.
REPEATS = Scheme(window=200, k=48, words=False)
NEAR = neardup.Rule(words=5, percent=80)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those predicted as ``und`` go.

    The network learns from these documents' labels, as in the query.  NULL and
    letterless texts go; without any label to learn from, all texts with letters
    stay.
    """
    ship(spark)
    return language.known(docs)


def _with_keys(docs: DataFrame, facts: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` and, under ``names``, the keys and further columns of ``facts`` where a row has the keys."""
    own = free_names(docs, *names, "own_id", "own_text")[-2:]
    id_key, text_key = row_keys()
    keyed = docs.withColumns({own[0]: id_key, own[1]: text_key})
    same = (F.col(own[0]) == F.col(names[0])) & (F.col(own[1]) == F.col(names[1]))
    return keyed.join(facts.toDF(*names), same, "left").drop(*own)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the first by id, then by text.

    Rows without an id come last in a group; of equal rows one stays; rows without
    words stay.
    """
    choice = stage(neardup.decisions(docs, NEAR).where("not kept or copies > 1"), "choices")
    names = free_names(docs, "id_key", "text_key", "copies", "kept")
    kept = [F.col(c) for c in names]
    joined = _with_keys(docs, choice, names)
    found = joined.where(kept[3].isNull())
    if not choice.where("kept").isEmpty():  # of equal rows the first of each group of keys
        found = found.unionAll(joined.where(kept[3]).dropDuplicates(names[:2]))
    return found.select(*map(quoted, docs.columns))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; no document goes.

    ``n_chars`` is that of the remaining text.
    """
    names = free_names(docs, "id_key", "text_key", "kept")
    joined = _with_keys(docs, suffixes.without_repeats(docs, REPEATS), names)
    kept = F.col(names[2])
    news = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return joined.select(
        *[F.when(kept.isNotNull(), news[c]).otherwise(quoted(c)).alias(c) if c in news else quoted(c) for c in docs.columns]
    )


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; those with one go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_near_copies),
    ("repeats", without_repeats),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Most stages are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
