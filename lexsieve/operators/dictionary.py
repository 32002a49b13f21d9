"""Term dictionaries: merging, adding, removing; for a run in Python, for tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexsieve.functions.fold import fold
from lexsieve.plans.policy import Policy
from lexsieve.sources import languages
from lexsieve.sources.documents import Preset, Term, TermList, read_list
from lexsieve.sources.typed import DocumentError

TERM_SCHEMA = T.StructType(
    [
        T.StructField("term_id", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("cat_name", T.StringType()),
        T.StructField("cat", T.StringType()),
        T.StructField("sev", T.IntegerType()),
        T.StructField("w", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Dictionary:
    """Folded terms in order, words to allow, and the policy that came with a preset. Never changed: methods return another."""

    terms: dict[str, Term] = field(default_factory=dict)
    allow: frozenset[str] = frozenset()
    policy: Policy | None = None

    def use_language(self, code: str = languages.DEFAULT) -> Dictionary:
        return self.add_list(languages.read(code))

    def add_list(self, found: TermList) -> Dictionary:
        return self._merged(_folded(found.terms), False).add_allow(*found.allow)

    def add_seed(self, source: str | bytes, **how: bytes) -> Dictionary:
        return self.add_list(read_list(source, **how))

    def add_term(self, text: str, category: str | None = None, severity: int = 1, word: bool = False) -> Dictionary:
        if not 1 <= severity <= 5:
            raise ValueError(f"a severity is 1 to 5, not {severity}")
        if not fold(text):
            raise ValueError(f"the term '{text}' folds to nothing")
        return self._merged([Term(fold(text), category or "other", severity, word)], False)

    def add_allow(self, *words: str) -> Dictionary:
        return Dictionary(self.terms, self.allow | {f for w in words if (f := fold(w))}, self.policy)

    def remove_term(self, text: str) -> Dictionary:
        gone = fold(text)
        return Dictionary({k: t for k, t in self.terms.items() if k != gone}, self.allow, self.policy)

    def add_preset(self, preset: Preset | str, resolver: Callable[[str], str | bytes | TermList | None] | None = None) -> Dictionary:
        """Lists, then entries (which can only narrow a term to whole words), words to allow, removals, policy."""
        if isinstance(preset, str):
            preset = Preset.parse(preset, None if resolver else languages.available())
        lists = []
        for code in preset.languages:
            found = resolver(code) if resolver else None
            if found is None:
                found = languages.read(code)
            lists.append(found if isinstance(found, TermList) else read_list(found))
        out = self
        entries = _folded(preset.entries)
        for found in lists:
            out = out.add_list(found)
        out = out._merged(entries, True).add_allow(*preset.allow)
        for text in preset.remove:
            out = out.remove_term(text)
        return Dictionary(out.terms, out.allow, preset.policy)

    def has_term(self, text: str) -> bool:
        return fold(text) in self.terms

    def __len__(self) -> int:
        return len(self.terms)

    def _merged(self, terms: list[Term], sticky: bool) -> Dictionary:
        out = dict(self.terms)
        for t in terms:
            was = out.get(t.text)
            if was is not None:
                stronger = t if t.severity > was.severity else was
                word = (was.word or t.word) if sticky else (was.word and t.word)
                t = Term(t.text, stronger.category_name, stronger.severity, word)
            out[t.text] = t
        return Dictionary(out, self.allow, self.policy)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t.text, t.category_name, str(t.category), t.severity, t.word) for i, t in enumerate(self.terms.values())]
        return spark.createDataFrame(rows, TERM_SCHEMA)

    def allow_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(w,) for w in sorted(self.allow)], "word string")


def _folded(terms: tuple[Term, ...]) -> list[Term]:
    out = [Term(fold(t.text), t.category_name, t.severity, t.word) for t in terms]
    for t, raw in zip(out, terms, strict=True):
        if not t.text:
            raise DocumentError(f"'t' folds to nothing: '{raw.text}'")
    return out


# --- the same on tables (term, cat_name, sev, w, seq), where terms are many -------------------


def merge_terms(entries: DataFrame, sticky: bool = False) -> DataFrame:
    """One row a term: the highest severity with the category that first had it, w if all say so
    (sticky: if any does), and the first seq. One aggregate with a partial one before its shuffle."""
    word = F.bool_or("w") if sticky else F.bool_and("w")
    return entries.groupBy("term").agg(
        F.min_by("cat_name", F.struct(-F.col("sev"), F.col("seq"))).alias("cat_name"),
        F.max("sev").alias("sev"),
        word.alias("w"),
        F.min("seq").alias("seq"),
    )


def apply_entries(base: DataFrame, entries: DataFrame) -> DataFrame:
    """base (merged) with entries merged into it: w of a term known to either is true if any says so."""
    last = base.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("last"))
    later = entries.crossJoin(F.broadcast(last)).withColumn("seq", F.col("seq") + F.col("last")).drop("last")
    return merge_terms(base.unionByName(later), sticky=True)


def remove_terms(base: DataFrame, gone: DataFrame) -> DataFrame:
    return base.join(gone.select("term").distinct(), "term", "left_anti")


def contained_terms(terms: DataFrame) -> DataFrame:
    """The terms that hold another term which is no whole-word term: such a term adds no detection.

    Every part of a term is looked up by a hash join; terms are short."""
    parts = terms.select(
        "term",
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.length("term")),
                    lambda i: F.transform(F.sequence(i, F.length("term")), lambda j: F.substring("term", i, j - i + 1)),
                )
            )
        ).alias("part"),
    ).filter("part <> term")
    short = terms.filter("not w").select(F.col("term").alias("part"))
    return parts.join(short, "part", "left_semi").select("term").distinct()
