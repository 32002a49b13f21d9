"""The dataflow in built-in operators: streams as rows, matching as a hash join.

It is for checking and for dictionaries that grow too large for a worker; screens scan row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.functions import fold


def stream_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, i (from 0), ch, hard, gap, cp: the folded characters of every text, in place.

    row tells texts of one key apart. Null and empty texts give none.
    """
    docs = docs.select(key, F.monotonically_increasing_id().alias("row"), text)
    folds = docs.sparkSession.createDataFrame(
        [(c, k, to) for c, (k, to) in fold.FOLDS.items()], "c string, kind int, fold string"
    )
    each = docs.select(key, "row", F.posexplode(F.split(text, "")).alias("cp", "c")).filter("c <> ''")
    kinds = each.join(F.broadcast(folds), "c", "left").select(
        key, "row", "cp", F.coalesce("kind", F.lit(fold.HARD)).alias("kind"), F.coalesce("fold", "c").alias("fold")
    )
    place = Window.partitionBy(key, "row").orderBy("cp")
    breaks = F.sum((F.col("kind") == fold.BREAK).cast("int")).over(place)
    kept = (
        kinds.withColumn("breaks", breaks)
        .filter(F.col("kind") >= fold.SOFT)
        .select(key, "row", "cp", "kind", "breaks", F.posexplode(F.split("fold", "")).alias("within", "ch"))
        .filter("ch <> ''")
    )
    order = Window.partitionBy(key, "row").orderBy("cp", "within")
    return kept.select(
        key,
        "row",
        (F.row_number().over(order) - 1).alias("i"),
        "ch",
        (F.col("kind") == fold.HARD).alias("hard"),
        F.coalesce(F.col("breaks") != F.lag("breaks").over(order), F.lit(True)).alias("gap"),
        "cp",
    )


def squeeze_rows(stream: DataFrame, key: str) -> DataFrame:
    """Runs of stream_rows as one row: first i, ch, hard and gap of the first, its cp and the last's, length run."""
    order = Window.partitionBy(key, "row").orderBy("i")
    opens = F.coalesce(F.col("ch") != F.lag("ch").over(order), F.lit(True)).cast("int")
    marked = stream.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order))
    first = lambda c: F.min_by(c, "i").alias(c)
    return marked.groupBy(key, "row", "island").agg(
        F.min("i").alias("first_i"), first("ch"), first("hard"), first("gap"), first("cp"),
        F.max("cp").alias("last_cp"), F.count("*").cast("int").alias("run"),
    ).select(key, "row", (F.col("island") - 1).cast("int").alias("i"), "ch", "hard", "gap", "cp", "last_cp", "run")


def raw_hits(docs: DataFrame, terms: DataFrame, key: str, folded: str) -> DataFrame:
    """key, i, term of all occurrences of terms (term) in the column of folded texts.

    At every place of a text as many characters as the longest term has are cut, by one pass of a
    pattern, and joined by their first ones, as many as the shortest term has, with those of the terms; a row
    holds no more of its text than that. Neither side is broadcast unless it is small. Null and empty texts and terms give
    none; rows that are repeated give repeated hits, a term that is repeated counts once.
    """
    known = terms.select(F.col("term").alias("term")).filter("term <> ''").distinct()
    sizes = known.agg(F.min(F.length("term")).alias("least"), F.max(F.length("term")).alias("most")).first()
    least, most = sizes["least"] or 1, sizes["most"] or 1
    windows = F.regexp_extract_all(folded, F.lit(rf"(?s)(?=(.{{1,{most}}}))."), F.lit(1))
    cut = docs.select(F.col(key).alias("key"), F.posexplode(windows).alias("i", "window"))
    heads = known.select("term", F.substring("term", 1, least).alias("head"))
    met = cut.withColumn("head", F.substring("window", 1, least)).join(heads, "head").filter(F.startswith("window", "term"))
    return met.select(F.col("key").alias(key), "i", "term")
