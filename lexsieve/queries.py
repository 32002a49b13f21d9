"""The engine's queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsieve import oracle
from lexsieve.functions import fold
from lexsieve.operators import dictionary as algebra
from lexsieve.operators import intervals, lists, native
from lexsieve.operators.dictionary import Dictionary
from lexsieve.plans.policy import Category, Policy, ScoreMode
from lexsieve.plans.screen import Screen, excerpt
from lexsieve.sources import languages, pack
from lexsieve.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

#: Documents with a tail that takes the rarer paths, by doc_id; the same SQL for both sides.
EVASIVE = """concat(text, CASE doc_id % 8
  WHEN 0 THEN concat(' da', repeat('a', CAST(doc_id % 5 AS INT)), 'mn it')
  WHEN 1 THEN ' h.e.l.l o, what the h e l l'
  WHEN 2 THEN ' shell hello debugger de-bugger bugger'
  WHEN 3 THEN ' 1d10t st00pid D@MN goddamn'
  WHEN 4 THEN ' looser l-o-o-s-e-r losser Loser'
  WHEN 5 THEN ' ＤＡＭＮ dámn 😀crap 𝐝𝐚𝐦𝐧 ﬁdamn'
  WHEN 6 THEN ' mid amn dam nation id iot hee ll heel'
  ELSE ' hellll crapp goddammn dаmn' END)"""

#: A second policy document, in the shape that a server would send.
PRESET = """{"schema": 1, "profile": "fold-v1", "name": "forum", "languages": ["en"],
 "options": {"minSeverity": 2, "maskChar": "-", "scoreMode": "max"},
 "entries": [{"t": "blorp", "cat": "hate", "sev": 4, "w": true}, {"t": "damn", "cat": "other", "sev": 2, "w": true}],
 "allow": ["blorpshire"], "remove": ["hell", "crap"]}"""


def base() -> Dictionary:
    return Dictionary().use_language()


def texts(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return read_table(spark, sf_dir, table)


def evasive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", F.expr(EVASIVE).alias("text"))


def _scan(screen: Screen) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evasive(spark, sf_dir).select("doc_id", F.explode(screen.scan("text")).alias("m"))
        return found.select("doc_id", "m.start", "m.end", "m.term", "m.cat", "m.sev", "m.cp_start", "m.cp_end")

    return run


def _verdicts(screen: Screen) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        told = evasive(spark, sf_dir).select("doc_id", screen.verdict("text").alias("v"))
        return told.select("doc_id", F.col("v.flagged").alias("detected"), "v.score")

    return run


def _masked(screen: Screen) -> Query:
    return lambda spark, sf_dir: evasive(spark, sf_dir).select("doc_id", screen.filter("text").alias("masked"))


def _candidates(screen: Screen, where: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = evasive(spark, sf_dir).select("doc_id", F.inline(screen.candidates("text")))
        return found.filter(where).select("doc_id", "stream", "cp_start", "cp_end", "term_id", "reason")

    return run


def _candidate_sql(where: str) -> str:
    head = oracle.screening(base(), Policy(), text=EVASIVE)
    rows = "SELECT id AS doc_id, CAST(s AS INTEGER) AS stream, CAST(a AS INTEGER) AS cp_start, CAST(z AS INTEGER) AS cp_end, CAST(term_id AS INTEGER) AS term_id, reason FROM cand"
    return f"{head} SELECT * FROM ({rows}) WHERE {where}"


SCAN, SCORE, MASK = "scan_matches", "detect_score", "filter_mask"
POLICIES = {
    "": ((SCAN, SCORE, MASK), Policy()),
    "_no_collapse": ((SCAN,), Policy(collapse_contained=False)),
    "_no_repeat": ((SCAN,), Policy(repeat_tolerance=False)),
    "_min_severity": ((SCAN,), Policy(min_severity=2)),
    "_category": ((SCORE,), Policy(categories=frozenset({Category.PROFANITY, Category.DRUG}))),
    "_no_category": ((SCORE,), Policy(categories=frozenset())),
    "_max": ((SCORE,), Policy(score_mode=ScoreMode.MAX)),
    "_token": ((MASK,), Policy(mask_token="[x]")),
    "_char": ((MASK,), Policy(mask_char="#", collapse_contained=False)),
}
CANDIDATES = {
    "raw_hits_plain": "stream = 0",
    "raw_hits_squeezed": "stream = 1",
    "boundary_rejects": "reason = 'edge'",
    "interior_gap_rejects": "reason = 'inner_gap'",
    "runs_cover_rejects": "reason = 'runs'",
    "allow_suppressed": "reason = 'allowed'",
    "stream_precedence": "reason = 'preceded'",
}


# --- functions and streams ---------------------------------------------------------------------


def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evasive(spark, sf_dir).select("doc_id", fold.fold_column(F.col("text")).alias("folded"))


def squeeze_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_text(spark, sf_dir).select("doc_id", fold.squeeze_column(F.col("folded")).alias("squeezed"))


def fold_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = evasive(spark, sf_dir).select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''")
    by = each.groupBy("c").agg(F.count("*").alias("n"))
    return by.groupBy(fold.kind_column(F.col("c")).alias("kind")).agg(F.sum("n").alias("n"))


def normalized_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = native.stream_rows(evasive(spark, sf_dir), "doc_id", "text")
    return rows.groupBy("doc_id", "hard", "gap").agg(
        F.count("*").alias("n"), F.sum("cp").alias("places"), F.sum(F.ascii("ch").cast("long")).alias("points")
    )


def squeezed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = native.squeeze_rows(native.stream_rows(evasive(spark, sf_dir), "doc_id", "text"), "doc_id")
    return rows.groupBy("doc_id", "hard", "gap", "run").agg(F.count("*").alias("n"), F.sum("cp").alias("places"), F.sum("last_cp").alias("ends"))


def term_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = base().table(spark)
    return terms.select("term", F.array_join(fold.runs_column(F.col("term")), ",").alias("runs"), fold.squeeze_column(F.col("term")).alias("squeezed"))


TURNS = ("conversations", "conv_id * 1000 + turn", "text")


def native_raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash join on heads, over folded texts."""
    folded = fold_text(spark, sf_dir)
    return native.raw_hits(folded, base().table(spark).select("term"), "doc_id", "folded").select("doc_id", F.col("i").cast("int").alias("i"), "term")


# --- interval operators on rows ------------------------------------------------------------------


def _spans(where: str) -> Query:
    return lambda spark, sf_dir: _candidates(Screen(base()), where)(spark, sf_dir).select(
        "doc_id", F.col("cp_start").alias("start"), F.col("cp_end").alias("end"), "term_id"
    )


def interval_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.collapse_contained(_spans("reason = 'match'")(spark, sf_dir).distinct(), ["doc_id"], "term_id")


def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.islands(_spans("reason IN ('match', 'edge')")(spark, sf_dir), ["doc_id"])


def interval_not_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = _spans("stream = 1")(spark, sf_dir), _spans("stream = 0")(spark, sf_dir)
    return intervals.not_overlapping(rows, spans, ["doc_id"])


def interval_not_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = _spans("stream = 0")(spark, sf_dir), _spans("stream = 1")(spark, sf_dir)
    return intervals.not_contained(rows, spans, ["doc_id"])


def _span_sql(name: str, where: str) -> str:
    return f"{name} AS (SELECT id AS doc_id, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS \"end\", CAST(term_id AS INTEGER) AS term_id FROM cand WHERE {where})"


def _interval_sql(ctes: list[str], final: str) -> str:
    return oracle.screening(base(), Policy(), text=EVASIVE) + ", " + ", ".join(ctes) + final


# --- dictionary algebra ----------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries out of the parts' names: many ties and repetitions, so that merging has work."""
    return texts(spark, sf_dir, "part").select(F.expr(ENTRY_TERM).alias("term"), F.expr(ENTRY_CAT).alias("cat_name"), F.expr("CAST(p_size % 5 + 1 AS INT)").alias("sev"), F.expr("p_partkey % 3 <> 0").alias("w"), F.col("p_partkey").alias("seq"))


ENTRY_TERM = "concat(lower(substring(p_brand, 1, 8)), CAST(p_partkey % 40 AS STRING))"
ENTRY_CAT = "CASE p_partkey % 4 WHEN 0 THEN 'hate' WHEN 1 THEN 'drug' WHEN 2 THEN 'other' ELSE 'sexual' END"
ENTRY_SQL = f"""e AS (SELECT {ENTRY_TERM.replace('STRING', 'VARCHAR')} AS term, {ENTRY_CAT} AS cat_name, CAST(p_size % 5 + 1 AS INT) AS sev, p_partkey % 3 <> 0 AS w, p_partkey AS seq FROM part)"""


def term_merge_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algebra.merge_terms(_entries(spark, sf_dir))


def term_merge_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    return algebra.apply_entries(algebra.merge_terms(rows.filter("seq % 2 = 0")), rows.filter("seq % 2 = 1"))


def term_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir)
    return algebra.remove_terms(algebra.merge_terms(rows), rows.filter("sev = 5"))


def term_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = texts(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("term"), F.expr("p_partkey % 3 <> 0").alias("w"))
    return algebra.contained_terms(numbers)


_MERGE = "SELECT term, arg_min(cat_name, (-sev, seq)) AS cat_name, max(sev) AS sev, {word}(w) AS w, min(seq) AS seq FROM {rows} GROUP BY term"


# --- presets, catalogue, packs ------------------------------------------------------------------


def _preset() -> Screen:
    return Screen.from_preset(PRESET)


def language_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.table(spark)


def language_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the list, written as it is, is found."""
    found = base()
    return found.table(spark).select("term", Screen(found).detect("term").alias("found"))


def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [(t.text, t.category_name, t.severity, t.word) for t in base().terms.values()]
    back = pack.decode(pack.from_text(pack.to_text(pack.encode(terms, sorted(base().allow)))))
    return spark.createDataFrame(back["entries"], "term string, cat_name string, sev int, w boolean")


def word_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list out of part names, with a sign and a digit and as single words, without the words of part types."""
    part = texts(spark, sf_dir, "part")
    raw = part.select(F.expr("concat('#', upper(p_name), CAST(p_partkey % 8 AS STRING))").alias("word")).union(part.select(F.explode(F.split("p_name", " "))))
    return lists.import_words(raw, part.select(F.col("p_type").alias("word")))


def word_list_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a list made of part names and numbers."""
    part = texts(spark, sf_dir, "part")
    terms = part.select(F.expr(FAULTY_TERM).alias("term"), F.expr(FAULTY_CAT).alias("cat_name"), F.expr("CAST(p_size % 7 AS INT)").alias("sev"))
    return lists.list_problems(terms, part.select(F.expr("concat('x', CAST(p_partkey % 300 AS STRING))").alias("word")))


FAULTY_TERM = "CASE WHEN p_partkey % 11 = 0 THEN 'No-' ELSE 'x' END || CAST(p_partkey * 37 % 1000 AS STRING)"
FAULTY_CAT = "CASE p_partkey % 5 WHEN 0 THEN 'weather' WHEN 1 THEN NULL ELSE 'drug' END"


# --- reports on top ---------------------------------------------------------------------------------


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evasive(spark, sf_dir).select("doc_id", "text", F.explode(Screen(base()).scan("text")).alias("m"))
    return found.select("doc_id", "m.start", "m.term_id", excerpt(F.col("text"), F.col("m")).alias("excerpt"), (F.col("m.end") - F.col("m.start")).alias("length"))


def source_category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select("source", F.inline(Screen(base()).scan("text")))
    by = found.cube("source", "sev").agg(F.count("*").alias("n"))
    return by.select(F.coalesce("source", F.lit("(all)")).alias("source"), F.coalesce("sev", F.lit(0)).alias("sev"), "n")


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir).select("doc_id", F.inline(Screen(base()).scan("text")))
    by = found.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return by.orderBy(F.desc("n"), "term").limit(5)


def conversation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = texts(spark, sf_dir, "conversations").select("conv_id", Screen(base()).score("text").alias("score"))
    return scored.groupBy("conv_id").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"))


def toxicity_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = texts(spark, sf_dir).select("doc_id", Screen(base()).detect("text").alias("flagged"))
    return flagged.join(texts(spark, sf_dir, "labels"), "doc_id").groupBy("toxic", "flagged").agg(F.count("*").alias("n"))


def plain_term_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of page source that hold a term, screened or as a bare word."""
    lines = texts(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line", "content"))
    words = "|".join(sorted(base().terms))
    bare = F.col("content").rlike(rf"(?i)\b({words})\b")
    flagged = lines.select("page_id", F.col("line"), Screen(base()).detect("content").alias("screened"), bare.alias("bare"))
    return flagged.filter("screened OR bare")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by severity of what their documents hold."""
    scored = texts(spark, sf_dir).select("source", Screen(base()).score("text").alias("score"))
    return scored.groupBy("source").agg(F.sum("score").alias("score"), F.count("*").alias("n_docs"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"severity_by_source": flagship}
    for name, (verbs, policy) in POLICIES.items():
        screen = Screen(base(), policy)
        every = {"scan_matches": _scan(screen), "detect_score": _verdicts(screen), "filter_mask": _masked(screen)}
        out |= {f"{verb}{name}": every[verb] for verb in verbs}
    for name, where in CANDIDATES.items():
        out[name] = _candidates(Screen(base()), where)
    out |= {"preset_scan": _scan(_preset()), "preset_score": _verdicts(_preset())}
    own = (
        fold_text, squeeze_text, fold_class_histogram, normalized_stream, squeezed_stream, term_runs, native_raw_hits,
        interval_collapse, interval_islands, interval_not_overlapping, interval_not_contained,
        term_merge_widen, term_merge_sticky, term_remove, term_contained,
        language_catalogue, language_self_check, pack_round_trip, word_import, word_list_problems,
        excerpts, source_category_cube, top_terms, conversation_rollup, toxicity_vs_label, plain_term_audit,
    )
    return out | {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (verbs, policy) in POLICIES.items():
        head = oracle.screening(base(), policy, text=EVASIVE)
        every = {"scan_matches": oracle.MATCHES, "detect_score": oracle.verdicts(policy), "filter_mask": oracle.masked(policy)}
        out |= {f"{verb}{name}": head + every[verb] for verb in verbs}
    preset = _preset()
    head = oracle.screening(preset.dictionary, preset.policy, text=EVASIVE)
    out |= {"preset_scan": head + oracle.MATCHES, "preset_score": head + oracle.verdicts(preset.policy)}
    out |= {name: _candidate_sql(where) for name, where in CANDIDATES.items()}
    plain = oracle.screening(base(), Policy())
    streams = oracle.streams('documents', 'doc_id', EVASIVE)
    chars = oracle.characters("documents", "doc_id", EVASIVE)
    terms = oracle.values([(t.text, t.category_name, t.severity, t.word) for t in base().terms.values()])
    kinds = " ".join(f"WHEN {k} THEN '{name}'" for k, name in ((fold.BREAK, "break"), (fold.SILENT, "silent"), (fold.SOFT, "soft"), (fold.HARD, "hard")))
    folded = f"fd AS (SELECT src.id AS doc_id, coalesce(string_agg(CASE WHEN kind >= {fold.SOFT} THEN t ELSE '' END, '' ORDER BY cp), '') AS folded FROM src LEFT JOIN k USING (id) GROUP BY src.id)"
    carried = {c: languages.read(c) for c in languages.available()}
    names = [(c, languages.NAMES.get(c, c)) for c in sorted({*languages.NAMES, *carried})]
    catalogue = oracle.values([(c, n, c in carried, c == "en") for c, n in names])
    kept = oracle.values([(c, t.text) for c, found in carried.items() for t in found.terms])
    spared = oracle.values([(c, w) for c, found in carried.items() for w in found.allow])
    # Folding, as far as the words of these two tables need it.
    simple = "translate(lower({0}), '@4310!|$57+ -#', 'aaeioiisstt')".format
    squeezed = "array_to_string(list_filter(string_split(word, ''), lambda c, i: i = 1 OR c <> word[i - 1]), '')"
    out |= {
        "language_catalogue": f"WITH c(code, name, carried, vetted) AS ({catalogue}), t(code, term) AS ({kept}), a(code, word) AS ({spared}) SELECT *, CAST((SELECT count(*) FROM t WHERE t.code = c.code) AS INTEGER) AS n_terms, CAST((SELECT count(*) FROM a WHERE a.code = c.code) AS INTEGER) AS n_allow FROM c",
        "word_import": f"""WITH raw AS (SELECT '#' || upper(p_name) || CAST(p_partkey % 8 AS VARCHAR) AS word FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part),
            t AS (SELECT DISTINCT {simple('word')} AS term FROM raw WHERE length({simple('word')}) >= 4 AND {simple('word')} NOT IN (SELECT lower(p_type) FROM part))
            SELECT term, 'profanity' AS cat_name, 3 AS sev, length(term) <= 6 AS w FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.term <> t.term AND length(o.term) > 6 AND contains(t.term, o.term))""",
        "word_list_problems": f"""WITH t AS (SELECT {FAULTY_TERM.replace('STRING', 'VARCHAR')} AS term, {FAULTY_CAT} AS cat, p_size % 7 AS sev FROM part), a AS (SELECT 'x' || CAST(p_partkey % 300 AS VARCHAR) AS word FROM part)
            SELECT DISTINCT problem, term FROM (
              SELECT 'not_folded' AS problem, term FROM (SELECT term FROM t UNION ALL SELECT word FROM a) WHERE term <> {simple('term')}
              UNION ALL SELECT 'category', term FROM t WHERE cat IS NULL OR cat = 'weather' UNION ALL SELECT 'severity', term FROM t WHERE sev NOT BETWEEN 1 AND 5
              UNION ALL SELECT 'repeated', term FROM t GROUP BY term HAVING count(*) > 1
              UNION ALL SELECT 'dead', word FROM (SELECT DISTINCT word, {squeezed} AS flat FROM a) WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(word, term) OR contains(flat, term)))""",
        "severity_by_source": plain + ", v AS (SELECT src.id, coalesce(sum(sev), 0) AS s FROM src LEFT JOIN m USING (id) GROUP BY src.id) SELECT source, CAST(sum(s) AS BIGINT) AS score, count(*) AS n_docs FROM documents JOIN v ON v.id = doc_id GROUP BY source",
        "fold_text": f"WITH {chars}, {folded} SELECT * FROM fd",
        "squeeze_text": f"WITH {oracle.streams('documents', 'doc_id', EVASIVE)}, q AS (SELECT id, string_agg(c, '' ORDER BY i) AS squeezed FROM isl WHERE opens = 1 GROUP BY id) SELECT src.id AS doc_id, coalesce(squeezed, '') AS squeezed FROM src LEFT JOIN q USING (id)",
        "fold_class_histogram": f"WITH {chars} SELECT CASE kind {kinds} END AS kind, count(*) AS n FROM k GROUP BY 1",
        "normalized_stream": f"WITH {streams} SELECT id AS doc_id, hard, gap, count(*) AS n, CAST(sum(a) AS BIGINT) AS places, CAST(sum(unicode(c)) AS BIGINT) AS points FROM sa GROUP BY ALL",
        "squeezed_stream": f"WITH {streams}, q AS (SELECT id, g, arg_min(hard, i) AS hard, arg_min(gap, i) AS gap, min(a) AS a, max(z) - 1 AS z, CAST(count(*) AS INTEGER) AS run FROM isl GROUP BY id, g) SELECT id AS doc_id, hard, gap, run, count(*) AS n, CAST(sum(a) AS BIGINT) AS places, CAST(sum(z) AS BIGINT) AS ends FROM q GROUP BY ALL",
        "term_runs": f"""WITH t(term, cat, sev, w) AS ({terms}), c AS (SELECT term, unnest(string_split(term, '')) AS c, unnest(range(length(term))) AS i FROM t),
            o AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY term ORDER BY i) THEN 0 ELSE 1 END AS opens FROM c),
            g AS (SELECT *, sum(opens) OVER (PARTITION BY term ORDER BY i) AS g FROM o),
            r AS (SELECT term, g, any_value(c) AS c, count(*) AS n FROM g GROUP BY term, g)
            SELECT term, string_agg(CAST(n AS VARCHAR), ',' ORDER BY g) AS runs, string_agg(c, '' ORDER BY g) AS squeezed FROM r GROUP BY term""",
        "native_raw_hits": f"WITH {chars}, {folded}, t(term, cat, sev, w) AS ({terms}), p AS (SELECT doc_id, term, list_transform(string_split(folded, term), lambda x: length(x)) AS gaps FROM fd JOIN t ON contains(folded, term)), q AS (SELECT *, unnest(range(1, len(gaps))) AS k FROM p) SELECT doc_id, CAST(list_sum(gaps[1:k]) + (k - 1) * length(term) AS INTEGER) AS i, term FROM q",
        "interval_collapse": _interval_sql([_span_sql("r", "reason = 'match'"), "q AS (SELECT DISTINCT * FROM r)"], ' SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q v WHERE v.doc_id = q.doc_id AND v."end" >= q."end" AND (v.start < q.start OR v.start = q.start AND (v."end" > q."end" OR v.term_id < q.term_id)))'),
        "interval_islands": _interval_sql([_span_sql("each", "reason IN ('match', 'edge')"), "r AS (SELECT DISTINCT * FROM each)", """x AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, term_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM r)""", """y AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, term_id ROWS UNBOUNDED PRECEDING) AS g FROM x)"""], ' SELECT doc_id, min(start) AS start, max("end") AS "end" FROM y GROUP BY doc_id, g'),
        "interval_not_overlapping": _interval_sql([_span_sql("r", "s = 1"), _span_sql("v", "s = 0")], ' SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = r.doc_id AND v.start < r."end" AND v."end" > r.start)'),
        "interval_not_contained": _interval_sql([_span_sql("r", "s = 0"), _span_sql("v", "s = 1")], ' SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = r.doc_id AND v.start <= r.start AND v."end" >= r."end")'),
        "term_merge_widen": f"WITH {ENTRY_SQL} " + _MERGE.format(word="bool_and", rows="e"),
        "term_merge_sticky": f"WITH {ENTRY_SQL}, b AS ({_MERGE.format(word='bool_and', rows='(SELECT * FROM e WHERE seq % 2 = 0)')}), n AS (SELECT term, cat_name, sev, w, seq FROM b UNION ALL SELECT term, cat_name, sev, w, seq + (SELECT max(seq) + 1 FROM b) FROM e WHERE seq % 2 = 1) " + _MERGE.format(word="bool_or", rows="n"),
        "term_remove": f"WITH {ENTRY_SQL}, b AS ({_MERGE.format(word='bool_and', rows='e')}) SELECT * FROM b WHERE term NOT IN (SELECT term FROM e WHERE sev = 5)",
        "term_contained": "WITH t AS (SELECT CAST(p_partkey AS VARCHAR) AS term, p_partkey % 3 <> 0 AS w FROM part) SELECT term FROM t WHERE EXISTS (SELECT 1 FROM t v WHERE NOT v.w AND v.term <> t.term AND contains(t.term, v.term))",
        "language_self_check": f"WITH t(term, cat, sev, w) AS ({terms}) SELECT term, true AS found FROM t",
        "pack_round_trip": f"WITH t(term, cat_name, sev, w) AS ({terms}) SELECT term, cat_name, CAST(sev AS INTEGER) AS sev, w FROM t",
        "excerpts": oracle.screening(base(), Policy(), text=EVASIVE) + ', x AS (' + oracle.MATCHES.replace("SELECT m.id", "SELECT m.term_id, m.id") + ') SELECT doc_id, start, CAST(term_id AS INTEGER) AS term_id, substr(text, cp_start + 1, cp_end - cp_start) AS excerpt, "end" - start AS length FROM x JOIN src ON src.id = doc_id',
        "source_category_cube": plain + ", g AS (SELECT source, sev, count(*) AS n FROM m JOIN documents ON doc_id = m.id GROUP BY CUBE (source, sev)) SELECT coalesce(source, '(all)') AS source, CAST(coalesce(sev, 0) AS INTEGER) AS sev, n FROM g",
        "top_terms": plain + " SELECT term, count(*) AS n, count(DISTINCT id) AS n_docs FROM m GROUP BY term ORDER BY n DESC, term LIMIT 5",
        "conversation_rollup": oracle.screening(base(), Policy(), *TURNS) + ", v AS (SELECT id, sum(sev) AS s FROM m GROUP BY id) SELECT conv_id, CAST(coalesce(sum(s), 0) AS BIGINT) AS score, count(*) AS n_turns FROM conversations LEFT JOIN v ON v.id = conv_id * 1000 + turn GROUP BY conv_id",
        "toxicity_vs_label": plain + " SELECT toxic, doc_id IN (SELECT id FROM m) AS flagged, count(*) AS n FROM labels WHERE doc_id IN (SELECT id FROM src) GROUP BY ALL",
        "plain_term_audit": "WITH ln AS (SELECT page_id, unnest(string_split(html, chr(10))) AS content, unnest(range(len(string_split(html, chr(10))))) AS line FROM pages), "
        + oracle.screening(base(), Policy(), "ln", "page_id * 100000 + line", "content").strip().removeprefix("WITH")
        + " SELECT page_id, CAST(line AS INTEGER) AS line, page_id * 100000 + line IN (SELECT id FROM m) AS screened, regexp_matches(content, '(?i)\\b("
        + "|".join(sorted(base().terms))
        + ")\\b') AS bare FROM ln WHERE screened OR bare",
    }
    return out
