"""Many term lists as one table, read by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions.fold import PROFILE, fold_column
from lexsieve.sources.documents import SCHEMA

LIST = "schema int, profile string, entries array<struct<t:string,cat:string,sev:int,w:boolean>>, allow array<string>"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """kind (term or allow), term (folded), cat_name, sev, w, seq, source of all JSON lists of a path.

    seq orders the entries of a list, as merge_terms takes them. Members that are of another kind than they should be,
    another schema or profile, a missing list of entries, an empty term or a severity outside 1 to 5 end the read with an error. A list
    without entries gives no rows.
    """
    raw = spark.read.schema(LIST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lists = raw.select("*", F.input_file_name().alias("source"))

    def checked(good: Column, value: Column, fault: str) -> Column:
        return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{fault} in "), "source")))

    pins = (F.coalesce("schema", F.lit(SCHEMA)) == SCHEMA) & (F.coalesce("profile", F.lit(PROFILE)) == PROFILE)
    lists = lists.select("source", "allow", checked(pins & F.col("entries").isNotNull(), F.col("entries"), "'schema', 'profile' or 'entries' is wrong").alias("entries"))
    each = lists.select("source", F.posexplode("entries").alias("seq", "e"))
    folded = fold_column(F.col("e.t"))
    severity = F.coalesce("e.sev", F.lit(1))
    terms = each.select(
        F.lit("term").alias("kind"),
        checked(F.coalesce(folded != "", F.lit(False)), folded, "'t' is missing or folds to nothing").alias("term"),
        F.coalesce("e.cat", F.lit("other")).alias("cat_name"),
        checked(severity.between(1, 5), severity, "'sev' is not 1 to 5").alias("sev"),
        F.coalesce("e.w", F.lit(False)).alias("w"),
        F.col("seq").cast("long").alias("seq"),
        "source",
    )
    allow = lists.select("source", F.posexplode("allow").alias("seq", "t")).select(
        F.lit("allow").alias("kind"), fold_column(F.col("t")).alias("term"), F.lit(None).cast("string").alias("cat_name"),
        F.lit(None).cast("int").alias("sev"), F.lit(None).cast("boolean").alias("w"), F.col("seq").cast("long").alias("seq"), "source",
    ).filter("term <> ''")
    return terms.unionByName(allow)
