"""Every operator on small inputs: against brute force, and on nulls, empty and long texts, ties, empty tables, odd columns."""

import collections
import hashlib
import random
import re
import tracemalloc
import weakref
import zlib
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexsieve.llm import (
    bpe_codec, chat_format, common, context_tree, ngram_join, packing, phrase_fingerprint, pu_classifier, quality_rules, secret_scan, url_rules,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n int, words string, secrets string, part int, gram long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    words = ["the", "of", "and", "tion", "ing", "damn", "Über", "naïve", "to", "in", "a", "x1", "日本", "😀"]
    long = " ".join(draw.choice(words) + str(draw.randrange(50)) for _ in range(4000))
    some = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) for _ in range(40)]
    near = some[0] + " end of it"
    return [None, "", " ", "\n", "one", long, long, long + " more", near, near, *some, some[0], "a  b\n\n c", "Σας <|endoftext|> ok"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k * 3, t, 1, "w", "s", 2, 3) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[12], (None, "null id here", 1, "w", "s", 2, 3)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---------------------------------------------------------------------------------------------


def test_pu_learns_from_positives_and_unlabelled():
    draw = np.random.default_rng(1)
    good = draw.normal(0, 1, (3000, pu_classifier.N_FEATURES)) + 1.5
    bad = draw.normal(0, 1, (600, pu_classifier.N_FEATURES)) - 1.5
    net, prior = pu_classifier.train(good[:1000], np.concatenate([good[1000:2400], bad]), pu_classifier.Learning(epochs=20))
    assert abs(prior - 0.7) < 0.08
    assert (net.score(good[2400:]) >= 0.5).mean() > 0.97 and (net.score(bad) < 0.5).mean() > 0.97


def test_pu_scores_every_row(spark, docs, nothing):
    ids = docs.filter("doc_id < 60").select("doc_id")
    found = pu_classifier.score_quality(docs, ids, docs.select("doc_id"), pu_classifier.Learning(epochs=2)).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    flat = pu_classifier.score_quality(docs, nothing.select("doc_id"), nothing.select("doc_id")).select("score").distinct().collect()
    assert flat == [(0.5,)]
    assert pu_classifier.score_quality(nothing, ids, ids).count() == 0


def test_pu_features_of_odd_texts():
    classes = pu_classifier.class_matrix()
    assert (classes.sum(1) <= 1).all()
    for text in ("", " ", "\n", "x", "日本", "a" * 100_000):
        assert np.isfinite(pu_classifier.features(text, classes)).all()


def test_pu_query_ranks_held_out_documents_and_ignores_their_labels(spark, tmp_path):
    source = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("documents", "labels"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels.withColumn("quality", F.when(kept_out, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    found = pu_classifier.op1_pu_classifier(spark, source).collect()
    assert sorted(found) == sorted(pu_classifier.op1_pu_classifier(spark, str(tmp_path)).collect())
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in found)
    good, bad = ([r["score"] for r in found if r["held_out"] and quality.get(r["doc_id"]) == k] for k in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95


def test_pu_sample_is_bounded_and_the_same(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"))
    first = {r[0] for r in pu_classifier.least_hashes(ids, 50).collect()}
    every = ids.orderBy(F.xxhash64("doc_id")).limit(50).collect()
    assert first == {r[0] for r in every}
    assert {r[0] for r in pu_classifier.least_hashes(ids.union(ids).repartition(7), 50).collect()} <= first
    assert pu_classifier.least_hashes(ids, 9000).count() == 3000


# --- 2 ---------------------------------------------------------------------------------------------


def base_rules(text):
    words = WORDS.findall(text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed


def test_quality_rules_agree_with_brute_force(spark, docs, nothing):
    odd = ["a b c d e " * 4 + "f", "x y z x y z x y z q", "#*$ | <>", "l\nl\n\n \nl", "1 2 3 4 5 6 1 2 3 4 5 7 1 2 3 4 5"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    for r in quality_rules.judge_quality(rows).collect():
        own = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert own == base_rules(r["text"]), r["text"]
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge_quality(nothing).count() == 0


def test_divergence_is_a_distance(spark):
    row = spark.range(1).select(
        quality_rules.divergence(F.array(F.lit(2).cast("long"), F.lit(2).cast("long")), [1.0, 1.0]),
        quality_rules.divergence(F.array(F.lit(5).cast("long"), F.lit(0).cast("long")), [0.0, 1.0]),
        quality_rules.divergence(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), [1.0, 1.0]),
    ).first()
    assert tuple(row) == (0.0, 1.0, None)


def test_quality_rules_reject_signs_and_capitals_and_keep_prose(spark):
    prose = (
        "In the morning the keeper of the inn went down to the river, and there he saw that the boats of the fishers were gone. "
        "It was the first day of spring, a day on which a man of sense stays in bed; but the keeper had to sell his bread to somebody. "
        "He walked along the bank until he came to an old bridge, where two boys sat in the sun and threw stones into the water. "
    )
    noisy = " ".join(f"w{k}$$$ |||" for k in range(60))
    loud = " ".join(f"WORD{chr(65 + k % 26)}{chr(65 + k // 26)}" for k in range(90))
    rows = spark.createDataFrame([(1, prose), (2, noisy), (3, loud)], "doc_id long, text string")
    assert [r["kept"] for r in quality_rules.judge_quality(rows).orderBy("doc_id").collect()] == [True, False, False]


def test_quality_rules_keep_other_columns_and_judge_rare_words(spark):
    draw = random.Random(3)
    strange = " ".join("".join(draw.choice("aeioulnrst") for _ in range(7)) for _ in range(300))
    said = ["the", "of", "and", "to", "a", "in", "that", "is", *(f"{a}{b}{c}e" for a in "bdfgk" for b in "aeiou" for c in "lmnrst")]
    long = " ".join(draw.choice(said[: draw.choice([8, 150])]) + draw.choice(["", "", "", "."]) for _ in range(600_000))
    rows = spark.createDataFrame([(1, strange, "x", 7), (2, long, "y", 8), (2, long, "y", 8)], "doc_id long, text string, _words string, kept int")
    found = quality_rules.judge_quality(rows).select("doc_id", "_words", "kept", "word_distance", "n_words").collect()
    assert sorted((r["doc_id"], r["_words"], r["kept"]) for r in found) == [(1, "x", False), (2, "y", True), (2, "y", True)]
    assert max(r["n_words"] for r in found) > 500_000 and found[0]["word_distance"] > 0.33


# --- 3 ---------------------------------------------------------------------------------------------


def base_spans(text):
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_patterns_agree_with_brute_force(spark, docs, nothing):
    odd = [
        "TOKEN='abc' token = \"abcdefg\" secret=token =abcdef", "😀é api_key:abcdef", "AKIA" + "A" * 16 + " AKIA123", "0" * 23 + "g" + "f" * 24,
        "password=" + "0123456789abcdef" * 3, "secret=ab secret=abcdef" * 50, "apikey=x.y-z_1/2+3=", "passwd: \"hunter22\" password:",
    ]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    for r in secret_scan.scan_secrets(rows).select("text", secret_scan.span_list(base).alias("spans")).collect():
        assert r["spans"] == base_spans(r["text"] or ""), r["text"]
    assert secret_scan.scan_secrets(nothing).count() == 0


def test_battery_tells_random_from_structured(spark):
    draw = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(k, "see " + "".join(draw.choice(alphabet) for _ in range(40)) + " here") for k in range(300)]
    plain = ["internationalization1aaaaaaaaaaaa", "aB1" * 12, "some_function_name_in_a_program_2", "2024-01-02_report_final_version_2"]
    rows += [(1000 + k, f"see {x} here") for k, x in enumerate(plain)]
    kinds = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("secrets").alias("n"))
    found = {r["doc_id"]: r["n"] for r in kinds.collect()}
    assert sum(found[k] for k in range(300)) > 255
    assert not any(found[1000 + k] for k in range(len(plain)))


def test_redaction_keeps_all_else(spark):
    rows = spark.createDataFrame([(1, "é token=abcdef, AKIA" + "B" * 16 + "!"), (2, None), (3, "none")], "doc_id long, text string")
    found = secret_scan.scan_secrets(rows).orderBy("doc_id").select(secret_scan.redact(F.col("text"), F.col("secrets"))).collect()
    assert [r[0] for r in found] == ["é [secret], [secret]!", None, "none"]


def slow_p_values(value):
    """Both p-values with the exact normal tail."""
    from math import erfc, exp, log, sqrt

    upper = lambda z: erfc(z / sqrt(2)) / 2
    letters = next(x for _, pattern, x in secret_scan.ENCODINGS if re.fullmatch(pattern[1:-1], value))
    codes, n, k = [letters.index(c) for c in value], len(value), len(letters)
    uses = collections.Counter(codes)
    chi = sum((c - n / k) ** 2 / (n / k) for c in uses.values()) + (k - len(uses)) * n / k
    z_chi = (chi - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)
    high = [c >= k / 2 for c in codes]
    up, down = sum(high), n - sum(high)
    changes = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean, var = 1 + 2 * up * down / n, 2 * up * down * (2 * up * down - n) / (n * n * (n - 1))
    z_runs = (changes - mean) / sqrt(var)
    centre = sum(codes) / n
    lag = sum((a - centre) * (b - centre) for a, b in zip(codes, codes[1:])) / sum((a - centre) ** 2 for a in codes)
    z_lag = (lag * n + 1) / sqrt(n)
    uniform = min(1, 3 * min(upper(z_chi), 2 * upper(abs(z_runs)), 2 * upper(abs(z_lag))))
    equal = sum(c * (c - 1) // 2 for c in uses.values())
    pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    few = upper((pairs * 0.055 - equal - 0.5) / sqrt(pairs * (0.055 - 0.055**2) + 6 * triples * (0.004 - 0.055**2)))
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    turns = sum(kind(a) != kind(b) for a, b in zip(value, value[1:]))
    many = upper((turns - 0.5 - (n - 1) * 0.3) / sqrt((n - 1) * 0.21))
    return uniform, exp(log(few) + log(many)) * (1 - log(few) - log(many))


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_battery_agrees_with_a_slow_one_and_is_calibrated(spark):
    draw = random.Random(31)
    values = ["".join(draw.choice(BASE64[: draw.choice([62, 64])]) for _ in range(draw.choice([24, 32, 40, 64]))) for _ in range(400)]
    values += ["some-long-title-of-2024-about-things", "articles/2023/05/17/the/keeper/of/the/inn", "aB1" * 12]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.randomness(F.col("v")).alias("p")).collect()
    uniform, text = [], []
    for r in rows:
        if not re.search("[0-9]", r["v"]):
            assert r["p"] is None
            r = {"v": r["v"], "p": {"uniform": slow_p_values(r["v"])[0], "text": slow_p_values(r["v"])[1]}}
        a, b = slow_p_values(r["v"])
        assert r["p"]["uniform"] == pytest.approx(a, rel=0.05, abs=0.005), r["v"]
        assert r["p"]["text"] == pytest.approx(b, rel=0.3, abs=0.005), r["v"]
        uniform.append(r["p"]["uniform"])
        text.append(r["p"]["text"])
    assert np.mean(np.array(uniform[:400]) < 0.05) < 0.09 and np.mean(np.array(uniform[:400]) < 0.001) < 0.02
    assert max(text[:400]) < 0.2 and np.mean(np.array(text[:400]) < 0.01) > 0.9 and min(text[400:402]) > 0.2


def test_planted_keys_are_found_and_names_are_not(spark):
    draw = random.Random(32)
    words = "keeper river stone market bridge letter garden winter number yellow copper silver Tuesday Version master Branch data".split()

    def name():
        parts = [draw.choice(words) for _ in range(draw.randrange(4, 8))] + [str(draw.randrange(2030))]
        draw.shuffle(parts)
        return draw.choice("/-_").join(parts)

    rows, keys = [], {}
    for k in range(300):
        key = "".join(draw.choice(BASE64) for _ in range(draw.choice([32, 40, 64]))) if k % 3 == 0 else None
        text = " ".join(draw.choice(words) if draw.random() < 0.9 else name() for _ in range(60)) + (f" 😀 {key} " if key else " ") + name()
        keys[k] = key
        rows.append((k, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hits = misses = false = 0
    for r in secret_scan.scan_secrets(docs).collect():
        found = [s for s in r["secrets"] if s["kind"] == "random"]
        for s in found:
            assert r["text"][s["start"] : s["end"]] == s["value"]
        right = [s for s in found if s["value"] == keys[r["doc_id"]]]
        hits, misses, false = hits + len(right), misses + (keys[r["doc_id"]] is not None and not right), false + len(found) - len(right)
    assert hits >= 90 and misses <= 10 and false <= 5
    again = docs.union(docs).select("doc_id", "text", F.lit("own").alias("secrets"))
    assert secret_scan.scan_secrets(again).count() == 600


# --- 4 ---------------------------------------------------------------------------------------------


def slow_names(text, level):
    """Names of a level's phrases, one by one."""
    one, whole = 0xFFFFFFFFFFFFFFFF, (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & one
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & one
        return x ^ (x >> 31)

    def tossed(symbols, size):
        out, equal = [], 0
        for a in range(size):
            for b in range(size):
                if a != b:
                    low = ((a ^ b) & -(a ^ b)).bit_length() - 1
                    equal = max(equal, 2 * low + (b >> low & 1))
        for a, b in zip([0, *symbols], symbols):
            low = ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(equal + 1 if a == b else 2 * low + (b >> low & 1))
        return out, equal + 2

    factor = int(phrase_fingerprint.MULTIPLIER)
    names = [mixed((b + 1) * factor & whole) for b in text]
    labels, size = tossed(list(text), 256)
    labels, size = tossed(labels, size)
    for _ in range(level):
        begins = [0]
        for i in range(1, len(labels)):
            if labels[i] > labels[i - 1] and labels[i] >= (labels[i + 1] if i + 1 < len(labels) else 0):
                begins.append(i)
        phrases = [names[a:b] for a, b in zip(begins, [*begins[1:], len(names)])]
        names = [mixed((sum(x * pow(factor, j, 1 << 64) for j, x in enumerate(p)) + mixed(len(p))) & one) for p in phrases]
        labels = []
        for a, b in zip([0, *names], names):
            differ = a ^ b
            low = (differ & -differ).bit_length() - 1
            labels.append(128 if not differ else 2 * low + (b >> low & 1))
        labels, size = tossed(labels, 129)
        labels, size = tossed(labels, size)
    return names


def test_names_and_likeness_agree_with_slow_ones():
    draw = random.Random(41)
    texts = ["".join(draw.choice("ab cdé") for _ in range(n)).encode() for n in (1, 2, 5, 40, 300)] + [b"aaaa" * 30]
    for level in (1, 2, 3):
        for text in texts:
            assert phrase_fingerprint.parse([text], level)[0].tolist() == slow_names(text, level), text
    for keep in (4, 64):
        for _ in range(50):
            a, b = (sorted(draw.sample(range(90), draw.randrange(1, 70)))[:keep] for _ in range(2))
            lowest = sorted(set(a) | set(b))[:keep]
            own = len([x for x in lowest if x in a and x in b]) / len(lowest)
            assert phrase_fingerprint.likeness(np.array(a, np.uint64), np.array(b, np.uint64), keep) == own


def test_interior_phrases_do_not_depend_on_the_offset():
    draw = random.Random(4)
    shared = "".join(draw.choice("abcde fgh") for _ in range(3000)).encode()
    for level in (1, 2, 3):
        names = [set(phrase_fingerprint.parse([h + shared + t], level)[0].tolist()) for h, t in ((b"", b""), (b"xyz" * 7, b"q"), (b"-", b"end" * 50))]
        whole = set(phrase_fingerprint.parse([shared], level)[0].tolist())
        for other in names:
            assert len(whole & other) > 0.9 * len(whole)


def test_a_text_is_parsed_alike_in_any_company():
    some = [b"the cat sat on the mat " * 9, b"a", b"aaaaaaaaaaaaaaaa", b"", "é日".encode() * 30]
    how = phrase_fingerprint.Parsing()
    alone = [phrase_fingerprint.sketch([t], how)[0].tolist() for t in some]
    assert [x.tolist() for x in phrase_fingerprint.sketch(some[::-1], how)][::-1] == alone


def test_fingerprints_of_neighbours_agree_with_brute_force(spark, docs, nothing):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -(2**63)), r["text"] or ""))
    found = phrase_fingerprint.compare_with_next(docs).collect()
    own, same, near = collections.Counter(), {}, {}
    for a, b in zip(rows, rows[1:] + rows[:1], strict=True):
        text, half = a["text"] or "", len(a["text"] or "") // 2
        edited = text[: len(text) - half] + (b["text"] or "")[:half]
        own[a["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        same[a["doc_id"]] = max(same.get(a["doc_id"], False), text == (b["text"] or ""))
    got = collections.Counter()
    for r in found:
        got[r["doc_id"], r["n_chars"], r["edited_sha256"]] += 1
        near[r["doc_id"]] = max(near.get(r["doc_id"], 0), r["near_next"])
        assert 0 <= r["near_edited"] <= 1
    assert got == own and all(near[k] == 1 for k in same if same[k])
    assert phrase_fingerprint.compare_with_next(nothing).count() == 0
    single = phrase_fingerprint.compare_with_next(docs.filter("doc_id = 12")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0
    assert phrase_fingerprint.fingerprint_texts(docs).count() == docs.count()


# --- 5 ---------------------------------------------------------------------------------------------


def test_word_model_agrees_with_brute_force(spark, docs, nothing):
    train = docs.filter("doc_id % 2 = 0")
    how = context_tree.Scoring(depth=3, max_head=8)
    found = context_tree.score_texts(docs, train, how).collect()
    said = {r["doc_id"]: [*WORDS.findall(lower(r["text"])), None] for r in docs.collect()}
    uses = collections.Counter(w for r in train.collect() for w in said[r["doc_id"]])
    total, kinds = sum(uses.values()), len(uses)
    assert len(found) == docs.count()
    for r in found:
        words = said[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(uses[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(log10((uses[w] + 1) / (total + kinds + 1)) for w in words))
    assert context_tree.score_texts(nothing, train, how).count() == 0
    blank = context_tree.score_texts(docs.filter("text = 'one'"), nothing, how).first()
    assert blank["score"] == pytest.approx(-8 * 4 * log10(2)) and blank["n_known"] == 0


def slow_tree(counts, depth):
    """Context-tree weighting straight from its definition, for one decision: counts[context] = (zeros, ones)."""
    from functools import cache
    from math import gamma, pi

    def estimate(z, o):
        return gamma(z + 0.5) * gamma(o + 0.5) / pi / gamma(z + o + 1)

    @cache
    def weighted(context):
        z, o = (sum(v[k] for c, v in counts.items() if c.endswith(context)) for k in (0, 1))
        if len(context) == depth or not z + o:
            return estimate(z, o)
        product = 1.0
        for byte in {c[-len(context) - 1 :][:1] for c in counts if c.endswith(context)}:
            product *= weighted(byte + context)
        return (estimate(z, o) + product) / 2

    return weighted, estimate


def test_tree_weights_follow_the_definition():
    draw = random.Random(6)
    text = "".join(draw.choice("ab") for _ in range(40))
    depth = 2
    full, starts = context_tree.grams([text], depth)
    entries = []
    for d in range(depth + 1):
        entries.append(np.unique(full & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True))
    tree = context_tree.ContextTree.grown(depth, entries)
    assert len(full) == len(text) + 1
    # The last bit tells "a" (0x61) from "b" (0x62) after their common bits: bits 7 and 8 of the byte.
    node = 0b1011000  # decisions 0 1 1 0 0 0 made: the seventh bit is next
    counts = {}
    for i, c in enumerate(text):
        context = ("\0\0" + text)[i : i + 2].encode()
        z, o = counts.get(context, (0, 0))
        counts[context] = (z + (c == "a"), o + (c == "b"))
    weighted, estimate = slow_tree(counts, depth)
    found, chance, share = tree.tables[0]
    at = int(np.searchsorted(found, np.uint64(node)))
    zeros, ones = text.count("a"), text.count("b")
    assert chance[at] == pytest.approx((ones + 0.5) / (zeros + ones + 1))
    assert share[at] == pytest.approx(estimate(zeros, ones) / 2 / weighted(b""), rel=1e-4)


def test_tree_is_a_probability_and_likes_what_it_saw():
    full, _ = context_tree.grams(["the cat sat on the mat. " * 20], 3)
    entries = [np.unique(full & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(4)]
    tree = context_tree.ContextTree.grown(3, entries)
    for context in (b"the", b"xyz", b"\0\0\0"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert (10 ** tree.log10(keys)).sum() == pytest.approx(1)
    asked = np.unique(full)
    held = context_tree.Remembered(tree)
    assert np.allclose(held.log10(asked[::2]), tree.log10(asked[::2])) and np.allclose(held.log10(asked), tree.log10(asked))
    assert tree.log10(full).mean() > -0.3


@pytest.mark.parametrize("depth", [0, 1, 2, 4])
def test_scores_are_those_of_every_counted_pair(spark, docs, depth):
    train = docs.filter("doc_id % 2 = 0")
    full, _ = context_tree.grams([lower(r["text"]) for r in train.collect()], depth)
    entries = [np.unique(full & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True) for d in range(depth + 1)]
    tree = context_tree.ContextTree.grown(depth, entries)
    found = context_tree.score_texts(docs, train, context_tree.Scoring(depth=depth, max_entries=8))
    own = collections.Counter()
    for r in docs.collect():
        own[r["doc_id"], round(tree.log10(context_tree.grams([lower(r["text"])], depth)[0]).sum(), 2)] += 1
    assert collections.Counter((r["doc_id"], round(r["score"], 2)) for r in found.collect()) == own


def test_copies_of_the_model_answer_alike_and_bits_are_told(spark, docs, monkeypatch):
    train = docs.filter("doc_id % 2 = 0")
    once = context_tree.score_texts(docs, train, context_tree.Scoring(depth=3)).collect()
    monkeypatch.setattr(context_tree, "COPY_BYTES", sum(len((r["text"] or "").encode()) for r in docs.collect()) // 3)
    monkeypatch.setattr(context_tree, "ASKED_BYTES", 500)
    often = context_tree.score_texts(docs, train, context_tree.Scoring(depth=3)).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 2), round(r["base_score"], 6))
    assert sorted(map(key, once)) == sorted(map(key, often))
    sizes = collections.Counter(len(lower(r["text"]).encode()) + 1 for r in docs.collect())
    assert collections.Counter(round(-r["score"] / log10(2) / r["bits_per_byte"]) for r in once) == sizes


def test_least_count_keeps_within_the_bound():
    assert context_tree.least_count({0: 100, 1: 10, 3: 5}, 15) == 2 and context_tree.least_count({0: 1}, 5) == 1
    assert context_tree.least_count({4: 9}, 5) == 32


# --- 6 ---------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["", "<", "<|", "<\\|", "<\\\\|im_end|>\n", "<|im_end|>\n<|im_start|>assistant\nok", "a\\nb\n\\", "é😀"]
    rows = [(c, t, role, text) for c, text in enumerate(hard) for t, role in enumerate(("user", "assistant"))]
    rows += [(50, 0, "we\\ird\n<|role", "x"), (51, 1, "assistant", None), (51, None, None, "first"), (52, 0, "user", "b"), (52, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.format_conversations(table).select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("segments")).alias("m")).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [tuple(t) for t in out[c]["t"]] == [(r[2] or "", r[3] or "") for r in turns]
        assert out[c]["m"] == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert "".join(s["text"] for s in out[c]["segments"]) == out[c]["formatted"]
    assert out[0]["valid"] and not out[50]["valid"] and not out[52]["valid"]
    assert chat_format.format_conversations(table.filter("false")).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------


def slow_components(rows, how):
    sets = {}
    for key, text in rows:
        w = WORDS.findall(lower(text))
        sets[key] = frozenset(tuple(w[i : i + how.n]) for i in range(len(w) - how.n + 1)) if len(w) >= how.n else frozenset([tuple(w)] if w else [])
    home = {k: k for k in sets}
    for _ in range(len(sets)):
        before = dict(home)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and how.whole * len(sets[a] & sets[b]) >= how.part * len(sets[a] | sets[b]):
                    home[a] = home[b] = min(home[a], home[b])
        if home == before:
            break
    return {k: (len(sets[k]), home[k]) for k in sets}


@pytest.mark.parametrize("how", [ngram_join.Join(hub_rounds=1), ngram_join.Join(2, 60, 100, 4, 0), ngram_join.Join(3, 70, 100, hub_rounds=0, hot=2)])
def test_components_agree_with_brute_force(spark, docs, nothing, how):
    draw = random.Random(8)
    stem = [f"w{k}" for k in range(60)]
    near = []
    for k in range(24):  # near copies with edits of their own, and steps between far ones
        words = list(stem)
        for _ in range(k % 4):
            words[draw.randrange(60)] = f"e{k}"
        near.append((1000 + k, " ".join(words[: 60 - k % 3])))
    near += [(2000 + k, " ".join(stem[k : k + 40])) for k in range(12)]
    rows = [(r["doc_id"], r["text"]) for r in docs.filter("doc_id is not null").distinct().collect()] + near
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = slow_components(rows, how)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(table, how).collect()}
    assert found == own


def test_join_of_odd_tables(spark, docs, nothing):
    assert ngram_join.join_components(nothing).count() == 0
    found = ngram_join.join_components(docs).collect()
    assert len(found) == docs.count()
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {None}


def test_overlap_counts_by_blocks():
    draw = np.random.default_rng(4)
    for size in (1, 30, 5000):
        a, b = (np.unique(draw.integers(0, size * 2, size).astype(np.uint64)) for _ in range(2))
        own = len(np.intersect1d(a, b))
        assert ngram_join.overlap(a, b, 0) == own == ngram_join.overlap(b, a, own) and ngram_join.overlap(a, b, own + 1) == -1


def test_pieces_of_many_tasks_add_up(spark):
    schema = ngram_join.T.StructType(ngram_join.PIECE)

    def run(batches):
        for _ in batches:
            pass
        yield ngram_join.batch_of(schema, ngram_join.pieces(np.arange(64, dtype=np.uint16) * 10))

    rows = spark.range(150).repartition(150).mapInArrow(run, schema)
    assert ngram_join.merged(rows, 150, ngram_join.added, "uint16").tolist() == [min(65535, 1500 * k) for k in range(64)]


def test_links_of_nameless_documents_and_one_row_of_each(spark, nothing):
    stem = " ".join(f"w{k}" for k in range(100))
    rows = [(None, stem), (None, stem), (None, stem + " x"), (7, stem + " y"), (9, stem + " y"), (9, stem + " y"), (9, "else"), (9, None), (9, None), (None, "alone"), (3, ""), (4, "b c d e f g h")]
    docs = spark.createDataFrame([(k, t, i, "s") for i, (k, t) in enumerate(rows)], "doc_id long, text string, s1 int, stays string").repartition(3)
    found = collections.Counter((r["doc_id"], r["component_id"]) for r in ngram_join.join_components(docs).collect())
    assert found == {(None, 7): 3, (7, 7): 1, (9, 7): 2, (9, 9): 3, (None, None): 1, (3, 3): 1, (4, 4): 1}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    own = [(7, stem + " y"), (9, "else"), (9, None), (9, None), (None, "alone"), (3, ""), (4, "b c d e f g h")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(own)
    assert ngram_join.one_of_each(nothing).count() == 0


def test_shingles_of_a_batch_take_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(["the cat sat on a mat " * 100] * 1500)], ["doc_id", "text"])
    phrase_fingerprint.POWERS.clear()
    tracemalloc.start()
    try:
        for _, few in ngram_join.slices(iter([batch])):
            ngram_join.shingle_sets(few, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        phrase_fingerprint.POWERS.clear()  # it would go to the workers with the functions
    assert peak < 25e6


def test_memory_is_given_back_once_a_task_holds_nothing(monkeypatch):
    class Model:
        pass

    models, left = [], []
    monkeypatch.setattr(common, "give_back", lambda: left.append([m() for m in models]))

    def run(batches):
        model = Model()
        models.append(weakref.ref(model))
        yield from batches

    assert list(common.released(run)(iter([1, 2]))) == [1, 2] and left == [[None]]
    ended = common.released(run)(iter([1, 2]))
    assert next(ended) == 1
    ended.close()
    assert left[1:] == [[None, None]]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    found = {r["id"]: r["component"] for r in ngram_join.components(links).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# --- 8 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing_holds_every_id_once(spark, docs, nothing, byte_tokenizer):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: [*byte_tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in rows.collect()}
    found = packing.pack_documents(rows).collect()
    seen, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in (*(sorted(seen[k]) for k in ids), *map(sorted, bins.values())):
        assert [a for a, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
    assert all(sum(n for _, n in seen[k]) == len(ids[k]) for k in ids)
    for parts in bins.values():
        size = sum(n for _, n in parts)
        assert size <= 2048 and size & (size - 1) == 0
    assert packing.pack_documents(nothing).count() == 0
    assert packing.pack_documents(docs).filter("start = 0").count() == docs.count()


def test_packer_fills_harmonic_classes():
    draw = random.Random(9)
    packer = packing.HarmonicPacker(64, 0)
    for k in range(500):
        n = draw.randrange(1, 150)
        packer.add(packing.Piece(k, 0, n, bytes(4 * n)))
    packer.finish()
    sizes = collections.Counter()
    for row in packer.rows:
        sizes[row[5]] += row[2]
    assert sum(n != 64 for n in sizes.values()) <= 6 and all(n & (n - 1) == 0 for n in sizes.values())
    with pytest.raises(ValueError):
        packing.HarmonicPacker(100, 0)


def test_ids_by_words_equal_the_tokenizers(byte_tokenizer, texts):
    encoder = packing.WordEncoder("byte_bpe_50k.json")
    odd = ["a  b", " a", "a ", "\n x", "x\n\n y", "it's  \t ok", "x é　 y", " ", "a \nb", "x's 12 3½Ⅷ", "\r\n \x85 z"]
    for t in [*(x or "" for x in texts), *odd]:
        assert encoder.encode(t) == np.array(byte_tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


# --- 9 ---------------------------------------------------------------------------------------------


def test_codec_agrees_with_the_tokenizers(spark, docs, nothing, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, own = Tokenizer.from_file(path), bpe_codec.Codec(path)
    draw = random.Random(10)
    odd = ["It's 12½ Ⅷ x's 'LL", "ΑΣ ΣΑΣ", "İstanbul ﬁ é ẛ̣", "\x1c a\x1db \x85 \xa0 c　d", "aaaa aaaaaaa", "<|startoftext|><|endoftext|> '", "<|endof"]
    odd += ["".join(draw.choice("ab c'sdtllre1é \n\tßΣİ<|>😀́﻿​") for _ in range(draw.randrange(60))) for _ in range(400)]
    every = [*(t or "" for t in texts), *odd]
    for text, ids in zip(every, own.encode(every), strict=True):
        shown = own.decode(ids)
        e = theirs.encode(text, add_special_tokens=False).ids
        assert ids == np.array(e, dtype="<u4").tobytes(), text
        assert shown.decode() == theirs.decode(e, skip_special_tokens=False), text
    assert bpe_codec.encode_documents(docs).count() == docs.count() and bpe_codec.encode_documents(nothing).count() == 0


def test_pair_index_merges_by_rank_from_the_left():
    index = bpe_codec.PairIndex({(1, 1): (0, 2), (2, 1): (1, 3), (5, 2): (2, 6), (4, 5): (3, 7)})
    assert index.encode([[1, 1, 1], [1, 1, 1, 1], [5, 1, 1], [4, 5, 1, 1], [], [9]]) == [[3], [2, 2], [6], [4, 6], [], [9]]


# --- 10 --------------------------------------------------------------------------------------------


def test_urls_and_rules(spark):
    rows = [
        "http://a.NET/x?y", "http://example.net/en/1", "http://example.net/EN/1", "https://www.example.com/de/#t", "ftp://x.org/fr/", "x.org/fr/", None, "", "://",
        "http://net/", "http://net", "http://xnet/", "http://h?q://z", "http://u@h:1/p", "a://b://c.net/",
    ]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "page_id long, url string")
    found = [tuple(r)[1:5] for r in url_rules.judge_urls(table).orderBy("page_id").collect()]
    assert [r[:3] for r in found] == [
        ("a.net", "/x", "net/"), ("example.net", "/en/1", "example.net/en/"), ("example.net", "/EN/1", "net/"), ("www.example.com", "/de/", "example.com/de/"),
        ("x.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("", "", None), ("", "", None), ("net", "/", "net/"), ("net", "", None), ("xnet", "/", None),
        ("h", "", None), ("u@h:1", "/p", None), ("b:", "//c.net/", None),
    ]
    assert [r[3] for r in found[:5]] == ["block", "allow", "block", "block", "allow"]
    assert url_rules.judge_urls(table.filter("false")).count() == 0
    assert {r["verdict"] for r in url_rules.judge_urls(table.filter("page_id in (5, 6)")).collect()} == {"allow"}


def test_rules_of_rarer_tokens_of_long_urls(spark):
    common = [f"p:c{k}" for k in range(9)]
    rows = [(f"u{k}", [*common, "p:bad" if k < 8 else "p:good"], "block" if k < 8 else "allow") for k in range(20)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, tokens array<string>, verdict string"), url_rules.Mining(min_support=0.3))
    found = {(*r["antecedent"], r["verdict"]): (r["confidence"], r["support"]) for r in rules.collect()}
    assert found == {("p:bad", "block"): (1.0, 0.4), ("p:good", "allow"): (1.0, 0.6)}


def test_mined_rules_are_those_of_brute_force(spark):
    draw = random.Random(12)
    rows = []
    for k in range(200):
        tokens = sorted(t for t in "abcd" if draw.random() < 0.6) or ["a"]
        bad = "a" in tokens and "b" in tokens or draw.random() < 0.05
        rows.append((f"u{k}", tokens, "block" if bad else "allow"))
    mining = url_rules.Mining(min_support=0.05, min_confidence=0.7)
    table = spark.createDataFrame(rows, "url string, tokens array<string>, verdict string")
    found = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in url_rules.mine_rules(table.union(table), mining).collect()}
    from itertools import combinations

    every = {}
    for n in range(1, 5):
        for part in combinations("abcd", n):
            fits = [v for _, t, v in rows if set(part) <= set(t)]
            for verdict in ("block", "allow"):
                hits = fits.count(verdict)
                if hits >= 0.05 * len(rows) and hits >= 0.7 * len(fits):
                    every[part, verdict] = hits / len(fits)
    pruned = {k: c for k, c in every.items() if not any(set(p) < set(k[0]) and v == k[1] and x >= c for (p, v), x in every.items())}
    assert found == pytest.approx(pruned)
    tokens = spark.createDataFrame([(list("ab"),), (["z"],)], "tokens array<string>")
    best = url_rules.match_rules(tokens, url_rules.mine_rules(table, mining)).collect()
    assert len(best) == 1 and best[0]["mined"]["verdict"] == "block"


def test_the_rule_with_more_support_wins(spark):
    rows = [(f"u{k}", ["h:com", "p:de"] if k < 12 else ["h:org", "p:en"], "block" if k < 12 else "allow") for k in range(60)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, tokens array<string>, verdict string"))
    asked = spark.createDataFrame([(["h:com", "p:en"],), (["h:com", "p:xx"],), (["h:xx"],)], "tokens array<string>")
    found = {tuple(r["tokens"]): r["mined"]["verdict"] for r in url_rules.match_rules(asked, rules).collect()}
    assert found == {("h:com", "p:en"): "allow", ("h:com", "p:xx"): "block"}


def test_verdicts_of_urls_agree_with_brute_force(spark):
    draw = random.Random(14)
    urls = []
    for _ in range(300):
        host = ".".join([*draw.sample(["www", "a", "b7", "example"], draw.randrange(3)), draw.choice(["net", "org", "com", "de"])])
        urls.append(f"http://{host}/" + "/".join(draw.choice(["en", "fr", "de", "x12", "y"]) for _ in range(draw.randrange(4))) + draw.choice(["", "?q", "#t"]))
    urls += [None, "", "no", "http://long.de/" + "/".join(["z"] * 5000)]
    pages = spark.createDataFrame([(k // 2, u, "r", "v") for k, u in enumerate(urls * 2)], "page_id long, url string, rule string, tokens string")
    found = url_rules.judge_urls(pages, url_rules.Mining(min_support=0.05)).collect()
    assert len(found) == 2 * len(urls)

    def parted(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        labels = [f"h:{x}" for x in lower(host).split(".")] + ["p:" + re.sub("[0-9]+", "#", x) for x in path.lower().split("/")]
        return lower(host), path, tuple(sorted({x for x in labels if len(x) > 2}))

    def explicit(host, path):
        fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else None

    told = {u: (*parted(u), explicit(*parted(u)[:2])) for u in urls}
    seen = [(t, r[1]) for u, (_, _, t, r) in told.items() if r and t]
    parts = {}
    from itertools import combinations

    for tokens in {t for t, _ in seen}:
        for n in range(1, len(tokens) + 1):
            for part in combinations(tokens, n):
                parts.setdefault(part, [v for t, v in seen if set(part) <= set(t)])
    rules = {}
    for part, said in parts.items():
        for v in ("allow", "block"):
            hits, n = said.count(v), len(said)
            if hits >= 0.05 * len(seen) and hits / n >= 0.8:
                c, z = hits / n, 1.96
                rules[part, v] = c, (c + z * z / (2 * n) - z * (c * (1 - c) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    rules = {k: b for k, b in rules.items() if not any(set(p) < set(k[0]) and v == k[1] and c >= b[0] for (p, v), (c, _) in rules.items())}
    own = collections.Counter()
    for url in urls * 2:
        host, path, tokens, rule = told[url]
        mined = [(round(b, 9), len(p), v) for (p, v), (_, b) in rules.items() if set(p) <= set(tokens)]
        own[host, path, rule and rule[0], rule[1] if rule else max(mined)[2] if mined else "allow"] += 1
    assert collections.Counter(tuple(r)[1:5] for r in found) == own


# --- SQL and pipeline ------------------------------------------------------------------------------


def test_every_query_gives_its_columns_for_every_row(spark):
    from lexsieve.llm import registry

    folder = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name, columns in {
        "op1_pu_classifier": "doc_id held_out score predicted",
        "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op4_phrase_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op5_context_tree": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op7_ngram_join": "doc_id n_shingles component_id",
        "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op9_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op10_url_rules": "page_id host path rule verdict",
    }.items():
        found = registry.QUERIES[name](spark, folder)
        assert found.columns[: len(columns.split())] == columns.split(), name
        rows = found.collect()
        if name == "op10_url_rules":
            assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count()
        else:
            assert len({r["doc_id"] for r in rows}) == documents and (len(rows) == documents or name == "op8_packing"), name


@pytest.mark.parametrize("name", ["op2_quality_rules", "op6_chat_format", "op7_ngram_join"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    from lexsieve.llm import registry

    folder = "/root/testdata/sf0.001"
    link = duckdb.connect()
    for t in ("documents", "conversations"):
        link.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = registry.QUERIES[name](spark, folder)
    columns = sorted(found.columns)
    own = sorted(map(repr, (tuple(r) for r in found.select(columns).collect())))
    other = sorted(map(repr, link.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()))
    assert own == other


def told(spark, sql, folder="/root/testdata/sf0.001"):
    import duckdb

    link = duckdb.connect()
    for t in ("documents", "pages"):
        link.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(link.execute(sql).fetchall(), key=repr)


def test_base_columns_agree_with_sql(spark):
    """The parts of op3, op4, op5 and op10 that SQL can express."""
    from lexsieve.llm import registry

    folder = "/root/testdata/sf0.001"

    def own(name, columns):
        return sorted(map(tuple, registry.QUERIES[name](spark, folder).select(*columns).collect()), key=repr)

    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    hexes = "len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24))"
    keys = "len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20))"
    assign = "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    sets = f"len(list_filter(regexp_extract_all(coalesce(text, ''), '{assign}', 1), lambda x: length(x) >= 6))"
    assert own("op3_secret_scan", ["doc_id", "n_assign", "n_access", "n_hex"]) == told(spark, f"SELECT doc_id, {sets}, {keys}, {hexes} FROM documents")
    edited = """SELECT doc_id, length(t), sha256(substr(t, 1, length(t) - length(t) // 2) || substr(next, 1, length(t) // 2)) FROM (
      SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next FROM documents)"""
    assert own("op4_phrase_fingerprint", ["doc_id", "n_chars", "edited_sha256"]) == told(spark, edited)
    out = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in told(spark, "SELECT doc_id FROM documents")}
    away = ", ".join(str(k) for k, x in out.items() if x) or "NULL"
    base = f"""WITH d AS (SELECT doc_id, list_append({words}, ' ') AS ws FROM documents), c AS (SELECT w, count(*) AS c FROM (SELECT unnest(ws) AS w FROM d WHERE doc_id NOT IN ({away})) GROUP BY w),
      s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
      SELECT doc_id, count(*), count(c), any_value(n), round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 6) FROM (SELECT doc_id, unnest(ws) AS w FROM d) LEFT JOIN c USING (w), s GROUP BY doc_id"""
    found = registry.QUERIES["op5_context_tree"](spark, folder).collect()
    for r, x in zip(sorted(found, key=lambda r: repr(r["doc_id"])), told(spark, base), strict=True):
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:4] and r["base_score"] == pytest.approx(x[4], abs=1e-5) and r["held_out"] == out[x[0]]
    rules = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(url_rules.RULES, key=lambda r: -len(r[1] + r[2])))
    parts = "SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages"
    hosts = f"SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM ({parts})"
    assert own("op10_url_rules", ["page_id", "host", "path", "rule"]) == told(spark, f"SELECT *, CASE {rules} END FROM ({hosts})")


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/documents.parquet")
    clean = source.join(spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id").select(*corpus_pipeline.COLUMNS)
    known = {k: f(spark, clean, folder).select("doc_id").collect() for k, f in corpus_pipeline.STAGES[:2]}
    assert all(len(rows) >= 0.95 * clean.count() for rows in known.values())
    text = clean.orderBy("doc_id").first()["text"]
    odd = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, text, None, None, None), (5, text, None, None, None), (6, None, "en", "s", 0), (7, "", "en", "s", 0), (8, " \n", "en", "s", 2), (9, " ".join(f"{w}{k}" for k in range(300) for w in text.split()), "en", "s", 1)]
    rows = spark.createDataFrame([(*r, "x", "y", 1.0) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, kept string, secrets string, score double")
    docs = rows.repartition(3)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        many = collections.Counter(r["doc_id"] for r in found.collect())
        if name == "quality rules":
            assert many[5] == many[None] == 2 and not many[6] and not many[7] and not many[8]
        if name == "quality classifier":
            assert many[5] == many[None]
        if name == "n-gram Jaccard join":
            assert (many[5], many[None], many[6], many[7], many[8], many[9]) == (1, 0, 1, 1, 1, 1)
        if name == "secret scans":
            assert sum(many.values()) == len(odd)
            assert [r["n_chars"] for r in found.collect() if r["doc_id"] == 6] == [None]
        if name == "packing":
            assert set(many) == {None, 5, 6, 7, 8, 9}
        if k < 4:
            assert found.columns == corpus_pipeline.COLUMNS


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after and after <= before
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = spark.read.parquet(str(tmp_path / "3"))
    assert secret_scan.scan_secrets(texts).filter("size(secrets) > 0").count() == 0
    assert sum(r["length"] for r in docs.collect()) == sum({r["doc_id"]: r["doc_tokens"] for r in docs.collect()}.values())
    empty = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
