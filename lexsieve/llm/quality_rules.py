"""Quality rules: counting rules and distribution divergence, with SQL functions only.

A text's character classes and common words are compared with references of
several languages by Jensen-Shannon distance. Short texts are not judged.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm.common import BLANK, let, table, words

#: Character classes, as patterns in the order in which they are taken out of a text.
CLASSES = (
    ("lower", r"\p{Ll}+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"\p{Lu}+"),
    ("digit", r"\p{N}+"),
    ("point", r"[.,;:?!'\"()\-‐-‟]+"),
    ("symbol", r"[#*$%&|<>]+"),
)

# Rounded shares of character classes in running text, "other" last.
CLASS_REFERENCES = {
    "en": (0.795, 0.165, 0.018, 0.002, 0.019, 0.0005, 0.0005),
    "de": (0.790, 0.140, 0.045, 0.002, 0.022, 0.0005, 0.0005),
    "fr": (0.790, 0.165, 0.018, 0.002, 0.024, 0.0005, 0.0005),
    "es": (0.795, 0.165, 0.018, 0.002, 0.019, 0.0005, 0.0005),
}

# Common words of each language with rounded uses in a thousand words; all other words make up the rest.
WORD_REFERENCES = {
    "en": {"the": 62, "of": 31, "and": 28, "to": 26, "a": 22, "in": 20, "that": 11, "is": 10,
           "it": 9, "for": 9, "was": 9, "on": 7, "with": 7, "as": 7, "be": 6, "by": 5},
    "de": {"die": 33, "der": 32, "und": 28, "in": 18, "den": 13, "zu": 11, "das": 11, "von": 10,
           "mit": 9, "ist": 9, "sich": 8, "des": 8, "auf": 8, "nicht": 8, "für": 7, "im": 7},
    "fr": {"de": 50, "la": 28, "le": 25, "et": 22, "les": 20, "des": 16, "en": 14, "un": 13,
           "du": 12, "une": 11, "que": 9, "est": 9, "pour": 8, "qui": 8, "dans": 8, "par": 6},
    "es": {"de": 60, "la": 36, "que": 30, "el": 28, "en": 26, "y": 25, "a": 20, "los": 17,
           "se": 13, "del": 13, "las": 11, "un": 10, "por": 10, "con": 9, "no": 9, "una": 8},
}
VOCABULARY = sorted({w for row in WORD_REFERENCES.values() for w in row})


def word_shares(uses: dict[str, int]) -> list[float]:
    """A reference by VOCABULARY, other words last."""
    return [*(float(uses.get(w, 0)) for w in VOCABULARY), 1000.0 - sum(uses.values())]


@dataclass(frozen=True)
class Rules:
    """Limits. A text is judged by its characters from min_chars on, by its words
    from min_judged words on; distances are between 0 and 1. A text without any common word is 0.346
    from the nearest reference, so the limit for words lies just below."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_chars: int = 200
    min_judged: int = 100
    max_class_distance: float = 0.2
    max_word_distance: float = 0.33


def repeated_words(tokens: Column, window: int = 5) -> Column:
    """Words in windows that occur twice or more, each word once.

    Windows are compared by 64-bit hashes of their words. Only texts with a
    repeated window are sorted.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda e, k: F.when(
                        (F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)))
                        | (F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))),
                        e["i"],
                    ),
                ),
                lambda i: i.isNotNull(),
            ),
        )
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            F.sort_array(twice),
            zero,
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def counted(w: Column) -> Column:
        # By element: slice() copies the whole array at every call.
        starts = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
        )

    return let(
        tokens, lambda w: F.when(F.size(w) > window, counted(w)).otherwise(F.lit(0).cast("long"))
    )


def duplicate_lines(text: Column) -> Column:
    r"""Lines (split at \n) that hold a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{BLANK}]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def divergence(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram from reference; null if the histogram is empty."""
    total = sum(reference)
    shares = F.array(*[F.lit(x / total) for x in reference])

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def distance(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
        terms = let(n, lambda m: F.zip_with(c, shares, lambda x, q: part(x / m, q) + part(q, x / m)))
        # Rounded, so that sums in another order give the same verdict.
        return F.when(n > 0, F.round(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2, F.lit(0.0))), 9))

    return let(counts, distance)


def class_histogram(text: Column) -> Column:
    """Characters of each class, other characters last."""

    # The count of a class is what its removal takes away; every pattern runs once.
    def shrink(value: Column, patterns: list[str], sizes: list[Column]) -> Column:
        if not patterns:
            return F.array(*[(a - b).cast("long") for a, b in zip(sizes, [*sizes[1:], F.lit(0)], strict=True)])
        return let(F.regexp_replace(value, patterns[0], ""), lambda v: shrink(v, patterns[1:], [*sizes, F.length(v)]))

    return shrink(text, [p for _, p in CLASSES], [F.length(text)])


def word_histogram(tokens: Column) -> Column:
    """Uses of each word of VOCABULARY, other words last."""
    longest = max(len(w.encode()) for w in VOCABULARY)
    common = F.transform(
        F.filter(tokens, lambda w: (F.octet_length(w) <= longest) & F.lower(w).isin(*VOCABULARY)),
        lambda w: F.concat(F.lit(" "), F.lower(w), F.lit(" ")),
    )

    def uses(said: Column, word: str) -> Column:
        return ((F.length(said) - F.length(F.replace(said, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")

    def counted(found: Column) -> Column:
        rest = (F.size(tokens) - F.size(found)).cast("long")
        return let(F.array_join(found, ""), lambda said: F.array(*[uses(said, w) for w in VOCABULARY], rest))

    return let(common, counted)


#: What judge_quality adds.
VERDICT = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept",
)


def judge_quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance, base_failed, kept (columns of docs with these names are replaced, all others kept).

    A null text is a text without words: it fails. Texts under the length guards
    are kept if the counting rules keep them; their distances are null. Rows are judged
    one by one (no shuffle), a text of any length as one, repeated rows alike, an empty table gives none.
    """

    def measured(t: Column, w: Column, classes: Column) -> Column:
        class_distance = F.least(*[divergence(classes, list(r)) for r in CLASS_REFERENCES.values()])
        word_distance = let(
            word_histogram(w), lambda uses: F.least(*[divergence(uses, word_shares(r)) for r in WORD_REFERENCES.values()])
        )
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(t) - classes[1]).cast("long").alias("word_chars"),
            classes[5].alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"),
            repeated_words(w, rules.window).alias("n_repeat_words"),
            F.when(F.length(t) >= rules.min_chars, class_distance).alias("class_distance"),
            F.when(F.size(w) >= rules.min_judged, word_distance).alias("word_distance"),
        )

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
        near = (F.coalesce(m["class_distance"], F.lit(0.0)) <= rules.max_class_distance) & (
            F.coalesce(m["word_distance"], F.lit(0.0)) <= rules.max_word_distance
        )
        return F.struct(*[m[c].alias(c) for c in VERDICT[:-2]], failed.alias("base_failed"), (~failed & near).alias("kept"))

    # One value bound once: whatever filters or picks columns of it later, the text is read once.
    whole = F.coalesce(F.col(text), F.lit(""))
    verdict = let(whole, lambda t: let(words(t), lambda w: let(class_histogram(t), lambda c: let(measured(t, w, c), judged))))
    own = f"verdict_{uuid.uuid4().hex}"
    return docs.withColumn(own, verdict).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in VERDICT], *[F.col(own)[c].alias(c) for c in VERDICT]
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "class_distance", "word_distance",
    )


def _sql_distance(counts: str, reference: list[float]) -> str:
    total = sum(reference)
    shares = "[" + ", ".join(repr(x / total) for x in reference) + "]"

    def part(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    x, q = f"({counts}[i] / CAST(list_sum({counts}) AS DOUBLE))", f"{shares}[i]"
    terms = f"list_transform(range(1, {len(reference) + 1}), lambda i: {part(x, q)} + {part(q, x)})"
    return f"CASE WHEN list_sum({counts}) > 0 THEN round(sqrt(greatest(list_sum({terms}) / 2, 0)), 9) END"


def oracle_sql(rules: Rules = Rules()) -> str:
    """DuckDB SQL for op2: windows are grouped by their words, not hashed."""
    removed = [f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for _, p in CLASSES]
    every = "[" + ", ".join([*removed, f"length(t) - ({' + '.join(f'({x})' for x in removed)})"]) + "]"
    said = [f"len(list_filter(ws, lambda x: lower(x) = '{w}'))" for w in VOCABULARY]
    others = ", ".join(f"'{w}'" for w in VOCABULARY)
    uses = "[" + ", ".join([*said, f"len(list_filter(ws, lambda x: lower(x) NOT IN ({others})))"]) + "]"
    near = ", ".join(_sql_distance("classes", list(r)) for r in CLASS_REFERENCES.values())
    far = ", ".join(_sql_distance("uses", word_shares(r)) for r in WORD_REFERENCES.values())
    n = rules.window
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[{BLANK}]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{BLANK}]')) AS ls,
         row_number() OVER () AS k
  FROM documents
), win AS (
  SELECT k, i, list_slice(ws, i, i + {n - 1}) AS win FROM (SELECT k, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + {n})) AS p FROM twice) GROUP BY k
), c AS (
  SELECT d.*, {every} AS classes, {uses} AS uses, coalesce(rep.n, 0) AS r FROM d LEFT JOIN rep USING (k)
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) - classes[2] AS BIGINT) AS word_chars,
    CAST(classes[6] AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(r AS BIGINT) AS n_repeat_words,
    len(ws) < {rules.min_words} OR 100 * r > {rules.max_repeat_percent} * len(ws) AS base_failed,
    CASE WHEN length(t) >= {rules.min_chars} THEN least({near}) END AS class_distance,
    CASE WHEN len(ws) >= {rules.min_judged} THEN least({far}) END AS word_distance
  FROM c
)
SELECT *, NOT base_failed AND coalesce(class_distance, 0) <= {rules.max_class_distance}
  AND coalesce(word_distance, 0) <= {rules.max_word_distance} AS kept FROM m
"""


OP2_SQL = oracle_sql()
