"""Secret scans: fixed patterns plus a randomness test battery, with SQL functions only.

Beside what the patterns find, long runs of key characters are tested twice. A battery asks whether a run can
be drawn uniformly from the alphabet of its inferred encoding: chi-squared uniformity, runs about the middle, lag-one
serial correlation. A second hypothesis is that a run is built like text, from words, paths and names: then
characters repeat as letters do, and classes of characters change seldom. What is reported is what rejects this second
one by a Benjamini-Hochberg procedure over the text's runs, weighted by length, so the share of
text among the reported runs is what is controlled; the battery must not speak against it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve.llm.common import let, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet on; a run has the first that holds all its characters.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)


# Chances that two and that three characters of running text are one, rounded down, and that the
# class of characters changes between neighbours in names and paths, rounded up; so text is not reported lightly.
PAIR, TRIPLE, CHANGE = 0.055, 0.004, 0.3


@dataclass(frozen=True)
class Battery:
    """min_length is the shortest run that the tests can tell from words; level the share of text-like runs
    among a text's reported runs; uniform the p-value of the battery below which a run is not reported."""

    min_length: int = 24
    level: float = 0.01
    uniform: float = 0.001


def located(text: Column, pattern: str, kind: str, rank: int, least: int, group: int = 0) -> Column:
    """array<struct<start, rank, kind, end, value>> of the leftmost matches that do not
    overlap and whose group has at least this many characters; code points, end exclusive."""
    kind_type = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(F.coalesce(F.length(x["part"]) >= least, F.lit(False)), F.concat(state["out"], F.array(found)))
            .otherwise(state["out"])
            .alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind_type).alias("out"))
    return F.aggregate(pieces, zero, step, lambda s: s["out"])


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by an exponential fit (error under 0.01 of the value for z < 4)."""
    up = F.exp(-0.717 * F.abs(z) - 0.416 * z * z) / 2
    return F.when(z >= 0, up).otherwise(1 - up)


def randomness(value: Column) -> Column:
    """struct<uniform, text>: the p-value that value is drawn uniformly from its encoding's alphabet (the least of the
    three tests, times three), and that it is built like text (two tests, by Fisher's method); null for a value of
    letters or digits only or of no encoding."""
    alphabet = F.lit(None).cast("string")
    for _, pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(value.rlike(pattern), letters).otherwise(alphabet)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    # The alphabet is data, so that the battery stands in the plan once.
    return let(
        F.when(mixed, alphabet),
        lambda a: F.when(
            a.isNotNull(), let(_codes(value, a), lambda codes: _battery(codes, F.length(a).cast("double"), class_changes(value)))
        ),
    )


def class_changes(value: Column) -> Column:
    """Neighbours of different classes: small letters, capitals, digits, signs."""
    runs = F.regexp_extract_all(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0))
    return (F.size(runs) - 1).cast("double")


def _like_text(n: Column, squares: Column, changes: Column) -> Column:
    """p-value of as few equal pairs and as many changes of class as seen, under text."""
    pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    spread = F.sqrt(pairs * (PAIR - PAIR * PAIR) + 6 * triples * (TRIPLE - PAIR * PAIR))
    few = tail((pairs * PAIR - (squares - n) / 2 - 0.5) / spread)
    many = tail((changes - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * (CHANGE * (1 - CHANGE))))
    half = -(F.log(F.greatest(few, F.lit(1e-300))) + F.log(F.greatest(many, F.lit(1e-300))))
    return F.exp(-half) * (1 + half)


def _codes(value: Column, alphabet: Column) -> Column:
    return F.transform(
        F.filter(F.split(value, ""), lambda c: c != ""), lambda c: (F.position(c, alphabet) - 1).cast("double")
    )


def _battery(codes: Column, k: Column, changed: Column) -> Column:
    n = F.size(codes).cast("double")
    add = lambda a, x: a + x
    zero = F.lit(0.0)

    # Counts of equal symbols, from the sorted codes: a symbol's j-th use adds 2j-1 to the sum of squares.
    squares = F.aggregate(
        F.array_sort(codes),
        F.struct(F.lit(-1.0).alias("last"), zero.alias("run"), zero.alias("sum")),
        lambda a, x: let(
            F.when(x == a["last"], a["run"] + 1).otherwise(1.0),
            lambda run: F.struct(x.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum")),
        ),
        lambda a: a["sum"],
    )

    def tests(mean: Column, squared: Column) -> Column:
        chi = squared * k / n - n
        z_chi = (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        high = F.transform(codes, lambda x: (x >= k / 2).cast("double"))
        ups = F.aggregate(high, zero, add)
        changes = F.aggregate(
            high,
            F.struct(F.lit(-1.0).alias("last"), zero.alias("runs")),
            lambda a, x: F.struct(x.alias("last"), (a["runs"] + (x != a["last"]).cast("double")).alias("runs")),
            lambda a: a["runs"],
        )
        both = 2 * ups * (n - ups)
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (changes - both / n - 1) / F.sqrt(spread)).otherwise(F.sqrt(n))
        lag = F.aggregate(
            codes,
            F.struct(F.lit(None).cast("double").alias("last"), zero.alias("sum"), zero.alias("square")),
            lambda a, x: F.struct(
                (x - mean).alias("last"),
                (a["sum"] + F.coalesce(a["last"] * (x - mean), zero)).alias("sum"),
                (a["square"] + (x - mean) * (x - mean)).alias("square"),
            ),
            lambda a: F.when(a["square"] > 0, a["sum"] / a["square"]).otherwise(1.0),
        )
        z_lag = (lag * n + 1) / F.sqrt(n)
        least = F.least(tail(z_chi), 2 * tail(F.abs(z_runs)), 2 * tail(F.abs(z_lag)))
        return F.struct(F.least(3 * least, F.lit(1.0)).alias("uniform"), _like_text(n, squared, changed).alias("text"))

    return let(F.aggregate(codes, zero, add) / n, lambda mean: let(squares, lambda q: tests(mean, q)))


def random_runs(text: Column, battery: Battery) -> Column:
    """The runs of key characters that are reported.

    Weights are lengths over their mean: longer runs, whose tests have more power, are reported at larger p-values.
    """
    pattern = rf"[A-Za-z0-9+/_-]{{{battery.min_length},}}"
    runs = F.transform(
        located(text, pattern, "random", 3, battery.min_length),
        lambda r: F.struct(r.alias("r"), randomness(r["value"]).alias("p"), F.length(r["value"]).alias("n")),
    )

    def cut(tested: Column) -> Column:
        """The largest weighted p-value that is reported, -1 for none; and the mean length."""
        m = F.size(tested)
        mean = F.aggregate(tested, F.lit(0.0), lambda a, x: a + x["n"]) / F.greatest(m, F.lit(1))
        weighted = let(mean, lambda u: F.array_sort(F.transform(tested, lambda x: x["p"]["text"] * u / x["n"])))
        passed = let(weighted, lambda q: F.filter(q, lambda v, i: v <= battery.level * (i + 1) / m))
        return F.struct(F.coalesce(F.array_max(passed), F.lit(-1.0)).alias("most"), mean.alias("mean"))

    def kept(tested: Column) -> Column:
        def reported(c: Column) -> Column:
            secret = lambda x: (x["p"]["text"] * c["mean"] / x["n"] <= c["most"]) & (x["p"]["uniform"] >= battery.uniform)
            return F.transform(F.filter(tested, secret), lambda x: x["r"])

        return let(cut(tested), reported)

    return let(F.filter(runs, lambda x: x["p"].isNotNull()), kept)


def scan_secrets(docs: DataFrame, battery: Battery = Battery(), text: str = "text") -> DataFrame:
    """docs with secrets array<struct<start, rank, kind, end, value>>, by start and kind.

    Kinds: assign, access, hex (patterns) and random (battery; only where no pattern
    matches). A null text counts as empty. Every row is scanned whole on its own, whatever its length: no
    shuffle; repeated rows give repeated results, an empty table none. A column of
    docs named secrets is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    least = battery.min_length
    plain = F.concat(
        F.when(
            (F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))) & body.rlike(ASSIGN),
            located(body, ASSIGN, "assign", 0, 6, 1),
        ).otherwise(none),
        F.when(F.contains(body, F.lit("AKIA")), located(body, ACCESS, "access", 1, 20)).otherwise(none),
        F.when(body.rlike("[0-9a-f]{24}"), located(body, HEX + "(?<=[0-9a-f]{24})", "hex", 2, 24)).otherwise(none),
    )
    free = F.when(body.rlike(rf"[A-Za-z0-9+/_-]{{{least}}}"), random_runs(body, battery)).otherwise(none)
    added = let(
        plain,
        lambda p: F.concat(
            p, F.filter(free, lambda r: ~F.exists(p, lambda b: (b["start"] < r["end"]) & (b["end"] > r["start"])))
        ),
    )
    return docs.withColumn("secrets", F.array_sort(added))


def span_list(secrets: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, secrets: Column, mark: str = "[secret]") -> Column:
    """text with every stretch covered by secrets replaced by mark; an unmarked text stays as it is."""

    def step(state: Column, s: Column) -> Column:
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= state["at"],
                F.concat(
                    state["out"],
                    F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)),
                ),
            )
            .otherwise(state["out"])
            .alias("out"),
        )

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(secrets, zero, step)
    masked = let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, d["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, masked).otherwise(text)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(span_list(base), "UTF-8"), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
    )
