"""Making and checking term lists, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.functions.fold import fold_column, squeeze_column
from lexsieve.operators.dictionary import contained_terms
from lexsieve.plans.policy import Category

#: Letters and digits of any script, without anything that folding takes out or changes.
FOLDED = r"^[\p{L}\p{N}\p{M}]+$"


@dataclass(frozen=True)
class Import:
    """least: length of the shortest term; up to whole_to characters a term only matches as a whole word. Raw
    words say nothing of category and severity, so all get these."""

    least: int = 4
    whole_to: int = 6
    category: str = "profanity"
    severity: int = 3


def import_words(words: DataFrame, common: DataFrame, how: Import = Import()) -> DataFrame:
    """term, cat_name, sev, w out of raw words (word), without the common words (word) of another language.

    Words are folded first; null ones, repeated ones and what folds to nothing go. A term that
    holds another one which matches inside words is found through that and goes too. An empty table gives none.
    """
    folded = words.select(fold_column(F.col("word")).alias("term")).filter(F.length("term") >= how.least).distinct()
    own = folded.join(common.select(F.lower("word").alias("term")).distinct(), "term", "left_anti")
    marked = own.withColumn("w", F.length("term") <= how.whole_to)
    found = marked.join(contained_terms(marked), "term", "left_anti")
    return found.select("term", F.lit(how.category).alias("cat_name"), F.lit(how.severity).alias("sev"), "w")


def list_problems(terms: DataFrame, allow: DataFrame) -> DataFrame:
    """problem, term: what is wrong with terms (term, cat_name, sev) and words to allow (word).

    not_folded: a term or word that is not in folded form, empty or null; category: an unknown name; severity: not 1 to 5;
    repeated: a term that is there twice; dead: a word to allow that holds no term, as it is or squeezed.
    Each problem of a text once. Parts of words are looked up by hash, so lists of any size do.
    """
    every = terms.select("term").union(allow.select(F.col("word").alias("term")))
    ready = F.col("term").rlike(FOLDED) & (F.col("term") == fold_column(F.col("term")))
    short = terms.filter("term <> ''").select(F.col("term").alias("part")).distinct()
    # Parts of the terms' lengths only: a few numbers.
    lengths = [r[0] for r in short.select(F.length("part").alias("n")).distinct().collect()]
    forms = allow.select("word", F.explode(F.array("word", squeeze_column(F.col("word")))).alias("form"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("form"), F.lit(1)))

    def parts_of(size: int) -> Column:
        return F.transform(starts, lambda i: F.substring("form", i, F.lit(size)))

    none = F.array().cast("array<string>")
    parts = forms.select("word", F.explode(F.concat(none, *map(parts_of, lengths))).alias("part"))
    alive = parts.join(short, "part", "left_semi").select("word").distinct()
    known = [str(c) for c in Category]
    found = [
        ("not_folded", every.filter(~F.coalesce(ready, F.lit(False)))),
        ("category", terms.filter(~F.coalesce(F.col("cat_name").isin(known), F.lit(False)))),
        ("severity", terms.filter(~F.coalesce(F.col("sev").between(1, 5), F.lit(False)))),
        ("repeated", terms.groupBy("term").count().filter("count > 1")),
        ("dead", allow.filter("word is not null").join(alive, "word", "left_anti").select(F.col("word").alias("term"))),
    ]
    out = None
    for name, rows in found:
        one = rows.select(F.lit(name).alias("problem"), "term")
        out = one if out is None else out.union(one)
    return out.distinct()
