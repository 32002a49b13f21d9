import json
import time

import pytest

from lexsieve.operators import dictionary as algebra
from lexsieve.operators import lists, native
from lexsieve.operators.dictionary import Dictionary
from lexsieve.plans.policy import Policy, ScoreMode
from lexsieve.sources import convert, documents, languages, pack, seeds
from lexsieve.sources.documents import Preset, Term, TermList, read_list
from lexsieve.sources.typed import DocumentError


def test_merging():
    d = Dictionary().add_term("foo", "hate", 2, True).add_term("F-O-O", "drug", 2, False)
    assert list(d.terms.values()) == [Term("foo", "hate", 2, False)]
    d = d.add_term("foo", "drug", 3, True)
    assert d.terms["foo"] == Term("foo", "drug", 3, False)
    d = d.add_preset(Preset(entries=(Term("foo", "other", 1, True),)))
    assert d.terms["foo"] == Term("foo", "drug", 3, True)
    assert not d.remove_term("foo").has_term("foo") and d.has_term("F o o") and len(d) == 1
    assert Dictionary().add_allow("...", "Ok").allow == {"ok"}


@pytest.mark.parametrize("bad", [dict(severity=0), dict(severity=6), dict(text="...")])
def test_callers_errors(bad):
    with pytest.raises(ValueError):
        Dictionary().add_term(**({"text": "x"} | bad))


#: A document in order; what a member is; and what is given in its place.
SHOP = {
    "schema": 1, "profile": "fold-v1", "name": "shop floor", "description": "names on badges", "languages": ["en"],
    "options": {"minSeverity": 2, "categories": ["drug"], "maskChar": "-", "maskToken": "[cut]", "repeatTolerance": True, "collapseContained": False, "scoreMode": "total"},
    "entries": [{"t": "gizmo", "cat": "drug", "sev": 4, "w": False}], "allow": ["gizmology"], "remove": ["heck"],
}
MEMBERS = {
    "text": [("name",), ("description",), ("profile",), ("options", "maskToken"), ("options", "scoreMode"), ("entries", 0, "t"), ("entries", 0, "cat")],
    "number": [("schema",), ("options", "minSeverity"), ("entries", 0, "sev")],
    "truth": [("options", "repeatTolerance"), ("options", "collapseContained"), ("entries", 0, "w")],
    "list": [("languages",), ("entries",), ("allow",), ("remove",), ("options", "categories")],
    "object": [("options",)],
}
STRANGE = {"text": "badge", "number": 3, "broken number": 3.5, "truth": True, "list": ["badge"], "object": {"badge": 1}}
OUTSIDE = [
    (("schema",), 44), (("profile",), "fold-v0"), (("languages",), ["klingon-east"]), (("options", "minSeverity"), 17), (("options", "maskChar"), "ab"),
    (("options", "maskToken"), ""), (("options", "scoreMode"), "median"), (("options", "categories"), ["weather"]), (("entries", 0, "t"), ""),
    (("entries", 0, "sev"), -4), (("entries",), ["gizmo"]), (("allow",), [["gizmology"]]), (("remove",), [False]),
]


def with_member(path, value):
    document = json.loads(json.dumps(SHOP))
    inner = document
    for step in path[:-1]:
        inner = inner[step]
    inner[path[-1]] = value
    return json.dumps(document)


WRONG = [(path, value) for kind, paths in MEMBERS.items() for path in paths for other, value in STRANGE.items() if other != kind] + OUTSIDE


@pytest.mark.parametrize(("path", "value"), WRONG)
def test_a_member_of_another_kind_is_named(path, value):
    with pytest.raises(DocumentError, match=str(path[-1])):
        Preset.parse(with_member(path, value))


def test_documents_that_are_no_objects():
    assert Preset.parse(json.dumps(SHOP)).policy.mask_token == "[cut]"
    for text in ("", "<shop/>", "17", '"shop"', json.dumps([SHOP]), json.dumps(SHOP)[:-1]):
        with pytest.raises(DocumentError):
            Preset.parse(text)


def test_preset_round_trip_and_composition():
    text = """{"name": "n", "languages": ["en"], "options": {"minSeverity": 2, "scoreMode": "max", "categories": []},
      "entries": [{"t": "zed", "w": true}], "allow": ["zedd"], "remove": ["hell", "unknown"]}"""
    preset = Preset.parse(text, languages.available())
    assert Preset.parse(preset.to_json()) == preset and preset.entries[0].severity == 3
    d = Dictionary().add_preset(preset)
    assert d.policy == Policy(2, frozenset(), score_mode=ScoreMode.MAX) and not d.has_term("hell") and "zedd" in d.allow
    with pytest.raises(DocumentError):
        Preset.parse('{"languages": ["xx"]}', languages.available())
    own = Dictionary().add_preset('{"languages": ["xx"]}', lambda code: TermList((Term("zot"),)))
    assert own.has_term("zot")
    with pytest.raises(DocumentError):
        Dictionary().add_preset(Preset(entries=(Term("..."),)))


def test_policy_round_trip():
    p = Policy(3, frozenset({"hate"}), "#", "[x]", False, False, ScoreMode.MAX)
    assert Policy.from_json(p.to_json()) == p and Policy.from_json("{}") == Policy()
    assert Policy().replace(min_severity=2).min_severity == 2
    with pytest.raises(ValueError):
        Policy(min_severity=0)


def test_lists_by_form(tmp_path):
    data = pack.encode([("foo", "hate", 4, True)], ["food"])
    for form in (data, pack.to_text(data), "﻿ " + pack.to_text(data).rstrip("=").replace("+", "-")):
        assert read_list(form) == TermList((Term("foo", "hate", 4, True),), ("food",))
    assert read_list('﻿ {"entries": [{"t": "x"}], "allow": ["", "y"]}') == TermList((Term("x"),), ("y",))
    with pytest.raises(DocumentError):
        read_list("neither")
    (tmp_path / "fr.pack").write_bytes(data)
    languages.use_folder(tmp_path)
    try:
        assert languages.available() == ("en", "fr") and languages.has("FR") and languages.read("fr").terms[0].text == "foo"
    finally:
        languages.use_folder(None)
    with pytest.raises(ValueError):
        languages.read("fr")


def test_damaged_packs_are_refused():
    good = pack.encode([("foo", "hate", 4, True), ("bar", "drug", 1, False)], ["food"])
    for n in range(len(good)):
        with pytest.raises(DocumentError):
            pack.decode(good[:n])
    with pytest.raises(DocumentError):
        pack.decode(good + b"\0")

    def refused(body: bytes) -> None:
        with pytest.raises(DocumentError):
            pack.decode(pack.MAGIC + pack.masked(body, pack.KEY))

    head = bytes([1, 0, 7]) + b"fold-v1"
    refused(bytes([2]) + head[1:] + b"\0\0")
    refused(head + b"\1\1x" + b"\xff\xff\xff\xff\x7f")
    refused(head + b"\1\1x" + b"\xff\xff\xff\xff\xff\1")
    refused(head + b"\1\1x\1" + b"\1a" + bytes([0x10 | 1]))
    refused(head + b"\1\1x\1" + b"\1a" + bytes([6]))
    refused(head + b"\1\1x\1" + b"\1\xff" + bytes([1]))
    assert pack.decode(pack.MAGIC + pack.masked(head + b"\0\0", pack.KEY)) == {"entries": [], "allow": []}


def test_tables_merge_as_dictionaries_do(spark):
    rows = [("a", "hate", 2, True, 0), ("b", "drug", 1, True, 1), ("a", "drug", 2, False, 2), ("a", "other", 3, True, 3)]
    entries = spark.createDataFrame(rows, "term string, cat_name string, sev int, w boolean, seq long")
    own = Dictionary()
    for t, c, s, w, _ in rows:
        own = own.add_term(t, c, s, w)
    found = {r["term"]: Term(r["term"], r["cat_name"], r["sev"], r["w"]) for r in algebra.merge_terms(entries).collect()}
    assert found == own.terms
    extra = spark.createDataFrame([("b", "hate", 1, False, 0), ("c", "hate", 1, False, 1)], entries.schema)
    after = {r["term"]: r["w"] for r in algebra.apply_entries(algebra.merge_terms(entries), extra).collect()}
    assert after == {"a": False, "b": True, "c": False}
    assert algebra.remove_terms(entries, extra).select("term").distinct().count() == 1
    short = spark.createDataFrame([("ab", False), ("xaby", False), ("aby", True), ("q", True)], "term string, w boolean")
    assert {r[0] for r in algebra.contained_terms(short).collect()} == {"xaby", "aby"}


def test_words_become_a_list(spark):
    raw = spark.createDataFrame([(w,) for w in ["Gizmo", "g-i-z-m-o", "gizmology", "regizmologyst", "cat", "", None, "...", "house", "H0use", "thingamabob", "thingamabobs"]], "word string")
    common = spark.createDataFrame([("House",), (None,)], "word string")
    found = {tuple(r) for r in lists.import_words(raw, common).collect()}
    assert found == {("gizmo", "profanity", 3, True), ("gizmology", "profanity", 3, False), ("thingamabob", "profanity", 3, False)}
    assert lists.import_words(raw.filter("false"), common).count() == 0
    assert lists.import_words(raw, common.filter("false")).count() == 4


def test_faults_of_a_list(spark):
    terms = spark.createDataFrame([("good", "hate", 1), ("good", "drug", 5), ("Bad", "hate", 0), ("a b", "rain", 3), (None, None, None), ("", "hate", 6)], "term string, cat_name string, sev int")
    allow = spark.createDataFrame([("goods",), ("gooodwill",), ("ggoodd",), ("well",), (None,)], "word string")
    found = {tuple(r) for r in lists.list_problems(terms, allow).collect()}
    assert found == {
        ("not_folded", "Bad"), ("not_folded", "a b"), ("not_folded", None), ("not_folded", ""), ("category", "a b"), ("category", None),
        ("severity", "Bad"), ("severity", None), ("severity", ""), ("repeated", "good"), ("dead", "gooodwill"), ("dead", "well"),
    }
    none = lists.list_problems(terms.filter("false"), allow)
    assert {r["term"] for r in none.collect() if r["problem"] == "dead"} == {"goods", "gooodwill", "ggoodd", "well"}


def test_native_operators_on_repeated_keys_and_a_long_text(spark):
    rows = [(1, "ab"), (1, "cd"), (1, "ab"), (2, None), (3, ""), (None, "xaby")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stream = native.stream_rows(docs, "doc_id", "text")
    said = {}
    for r in sorted(stream.collect(), key=lambda r: r["i"]):
        said.setdefault((r["doc_id"], r["row"]), []).append(r["ch"])
    assert sorted((str(k), "".join(v)) for (k, _), v in said.items()) == [("1", "ab"), ("1", "ab"), ("1", "cd"), ("None", "xaby")]
    squeezed = native.squeeze_rows(native.stream_rows(spark.createDataFrame([(1, "aab"), (1, "bba")], docs.schema), "doc_id", "text"), "doc_id")
    assert sorted((r["ch"], r["run"]) for r in squeezed.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    terms = spark.createDataFrame([("ab",), ("abyss",), ("ab",), (None,), ("",)], "term string")
    assert sorted((str(r["doc_id"]), r["i"], r["term"]) for r in native.raw_hits(docs, terms, "doc_id", "text").collect()) == [("1", 0, "ab"), ("1", 0, "ab"), ("None", 1, "ab")]
    long = spark.createDataFrame([(7, "😀abyss " * 40_000)], docs.schema)
    began = time.time()
    found = native.raw_hits(long, terms, "doc_id", "text")
    assert found.count() == 80_000 and found.agg({"i": "max"}).first()[0] == 7 * 39_999 + 1
    assert time.time() - began < 60
    assert native.raw_hits(docs, terms.filter("false"), "doc_id", "text").count() == 0


def test_lists_are_converted_and_shown(tmp_path, capsys):
    source, out = tmp_path / "list.json", tmp_path / "list.pack"
    source.write_text(json.dumps({"profile": "fold-v1", "entries": [{"t": "gizmo", "cat": "hate", "sev": 4, "w": True}, {"t": "zed"}], "allow": ["gizmology"]}))
    assert convert.main([str(source), "-o", str(out)]) == 0
    assert read_list(out.read_bytes()) == read_list(source.read_text())
    assert convert.main([str(source)]) == 0
    assert read_list(capsys.readouterr().out) == read_list(source.read_text())
    assert convert.main([str(out), "--show"]) == 0
    assert read_list(capsys.readouterr().out) == read_list(source.read_text())
    for bad in ('{"entries": []}', '{"profile": "fold-v1"}', "[", '{"profile": "fold-v1", "entries": [{"t": "a", "sev": 9}]}'):
        source.write_text(bad)
        assert convert.main([str(source), "-o", str(tmp_path / "none")]) == 1
    assert not (tmp_path / "none").exists()


def test_many_lists_are_one_table(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema": 1, "entries": [{"t": "G-izmo", "cat": "hate", "sev": 4, "w": True}, {"t": "zed"}], "allow": ["Gizmology", ""]}))
    (tmp_path / "b.json").write_text(json.dumps({"profile": "fold-v1", "entries": [{"t": "zed", "sev": 2}]}, indent=2))
    found = seeds.read_seeds(spark, str(tmp_path))
    assert sorted((r["kind"], r["term"], r["cat_name"], r["sev"], r["w"], r["seq"], r["source"][-6:]) for r in found.collect()) == [
        ("allow", "gizmology", None, None, None, 0, "a.json"), ("term", "gizmo", "hate", 4, True, 0, "a.json"),
        ("term", "zed", "other", 1, False, 1, "a.json"), ("term", "zed", "other", 2, False, 0, "b.json"),
    ]
    merged = {r["term"]: r["sev"] for r in algebra.merge_terms(found.filter("kind = 'term'")).collect()}
    assert merged == {"gizmo": 4, "zed": 2}
    for k, bad in enumerate(['{"schema": 2, "entries": []}', '{"profile": "x", "entries": []}', '{"allow": []}', '{"entries": [{"t": "--"}]}', '{"entries": [{"t": "a", "sev": 0}]}', '{"entries": [{"t": "a", "sev": "two"}]}']):
        place = tmp_path / f"bad{k}"
        place.mkdir()
        (place / "c.json").write_text(bad)
        with pytest.raises(Exception):
            seeds.read_seeds(spark, str(place)).collect()
