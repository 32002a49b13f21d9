"""Cases worked out by hand: what folding, screening, presets and evasive spellings must give."""

import json

import pytest

from lexsieve.functions.streams import Normalizer, utf16_offsets
from lexsieve.operators.dictionary import Dictionary
from lexsieve.plans.policy import Policy
from lexsieve.plans.screen import Screen
from lexsieve.sources import documents, pack
from lexsieve.sources.documents import Preset
from lexsieve.sources.typed import DocumentError

# text, folded, hard, gap, start and end of each folded character in UTF-16 units, squeezed (None without a run)
NORMAL = [
    ("", "", "", "", "", "", None),
    ("-- ..", "", "", "", "", "", None),
    ("Hi", "hi", "11", "10", "0,1", "1,2", None),
    ("a b", "ab", "11", "11", "0,2", "1,3", None),
    ("a­b", "ab", "11", "10", "0,2", "1,3", None),
    ("4ss", "ass", "011", "100", "0,1,2", "1,2,3", "as"),
    ("😀a", "a", "1", "1", "2", "3", None),
    ("ß-ß", "ssss", "1111", "1010", "0,0,2,2", "1,1,3,3", "s"),
    ("𝐚b", "ab", "11", "10", "0,2", "2,3", None),
    ("ée", "ee", "11", "10", "0,2", "1,3", "e"),
    ("​x​", "x", "1", "1", "1", "2", None),
    ("中文", "中文", "11", "10", "0,1", "1,2", None),
]


@pytest.mark.parametrize(("text", "folded", "hard", "gap", "start", "end", "squeezed"), NORMAL)
def test_folded_streams(text, folded, hard, gap, start, end, squeezed):
    make = Normalizer()
    points = make.points(text)
    units = utf16_offsets(points)
    s = make.stream(points)
    bits = lambda x: "".join(str(int(b)) for b in x)
    commas = lambda x: ",".join(map(str, x))
    assert (s.text(), bits(s.hard), bits(s.gap)) == (folded, hard, gap)
    assert (commas(units[s.start]), commas(units[s.end])) == (start, end)
    short = make.squeezed(s)
    assert (short.text() if short is not None else None) == squeezed


# text, options, score, masked text, matches (start, end, term, severity) in UTF-16 units
SCREENED = [
    ("what the hell", {}, 1, "what the ****", [(9, 13, "hell", 1)]),
    ("shell", {}, 0, "shell", []),
    ("damn, DAMN", {}, 2, "****, ****", [(0, 4, "damn", 1), (6, 10, "damn", 1)]),
    ("damn moron", {"scoreMode": "max"}, 2, "**** *****", [(0, 4, "damn", 1), (5, 10, "moron", 2)]),
    ("goddamn", {}, 2, "*******", [(0, 7, "goddamn", 2)]),
    ("goddamn", {"collapseContained": False}, 3, "*******", [(0, 7, "goddamn", 2), (3, 7, "damn", 1)]),
    ("moron", {"minSeverity": 3}, 0, "moron", []),
    ("moron", {"categories": []}, 0, "moron", []),
    ("moron", {"categories": ["profanity"]}, 2, "*****", [(0, 5, "moron", 2)]),
    ("hellll", {}, 1, "******", [(0, 6, "hell", 1)]),
    ("hellll", {"repeatTolerance": False}, 0, "hellll", []),
    ("hel", {}, 0, "hel", []),
    ("😀 damn", {"maskChar": "#"}, 1, "😀 ####", [(3, 7, "damn", 1)]),
    ("d😀amn", {}, 1, "******", [(0, 6, "damn", 1)]),
    ("damn idiot", {"maskToken": "[x]"}, 2, "[x] [x]", [(0, 4, "damn", 1), (5, 10, "idiot", 1)]),
    ("damnify", {}, 0, "damnify", []),
    ("debugger", {}, 0, "debugger", []),
    ("mid amn", {}, 0, "mid amn", []),
    ("", {}, 0, "", []),
]


def test_screening(spark):
    for options in {json.dumps(c[1]) for c in SCREENED}:
        cases = [c for c in SCREENED if json.dumps(c[1]) == options]
        screen = Screen.default(Policy.from_json(options))
        rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, text string")
        for r in rows.select("k", "text", screen.verdict("text").alias("v")).collect():
            _, _, score, masked, matches = cases[r["k"]]
            v = r["v"]
            assert (v["flagged"], v["score"], v["masked"]) == (bool(matches), score, masked), r["text"]
            assert [(m["start"], m["end"], m["term"], m["sev"]) for m in v["matches"]] == matches


EVASIVE = [
    "damn", "DAMN", "d.a.m.n", "d a m n", "d-a-m-n", "d_a_m_n", "d/a/m/n", "d*a*m*n", "D@MN", "d4mn", "d@@mn", "daaaamn", "ddaammnn", "ｄａｍｎ",
    "𝐝𝐚𝐦𝐧", "𝕕𝕒𝕞𝕟", "ⓓⓐⓜⓝ", "🄳🄰🄼🄽", "dámn", "dä̈mn", "dаmn", "dαmn", "d​amn", "da­mn", "dámn", "damn!!!", "...damn...", "(damn)", "d\namn",
    "goddamned", "idiotic", "1d1ot", "!diot", "id|ot", "id10t", "ïdïôt", "i.d.i.o.t", "m0r0n", "MORON", "mmmoron", "m o r o n", "l0s3r", "lo$er", "lo5er", "cr@p", "cr4p", "h3ll",
    "he11o hell", "ѕсum", "7rash", "+rash", "tra$h", "dum8 dumb", "jerk", "j3rk", "bl00dy", "git", "g1t", "g!t", "bugger it", "bu99er bugger",
]


def test_evasive_spellings_are_found(spark):
    rows = spark.createDataFrame([(t,) for t in EVASIVE], "text string")
    missed = [r["text"] for r in rows.filter(~Screen.default().detect("text")).collect()]
    assert missed == []


CALM = [
    "hello there", "a shell of an egg", "the class assessed a digit", "scrapbook", "trashy novels", "dumbbell", "bloodyminded", "legitimate", "heckle",
    "darning wool", "scumble glaze", "jerky", "looser trousers", "hel lo", "the loose rope",
]


def test_calm_phrases_are_left_alone(spark):
    rows = spark.createDataFrame([(t,) for t in CALM], "text string")
    assert [r["text"] for r in rows.filter(Screen.default().detect("text")).collect()] == []


PRESETS = {
    "all": {},
    "loud": {"languages": ["en"], "options": {"minSeverity": 2}},
    "own": {"entries": [{"t": "gizmo", "cat": "hate", "sev": 4, "w": True}], "allow": ["gizmology"], "options": {"maskToken": "~"}},
    "less": {"languages": ["en"], "remove": ["damn"], "allow": ["hell fire"]},
}
# text -> score by preset
SCORES = {
    "damn": {"loud": 0, "own": 0, "less": 0},
    "goddamn gizmo": {"loud": 2, "own": 4, "less": 2},
    "gizmology": {"loud": 0, "own": 0, "less": 0},
    "hell fire": {"loud": 0, "own": 0, "less": 0},
    "hell, moron": {"loud": 2, "own": 0, "less": 3},
    "": {"loud": 0, "own": 0, "less": 0},
}


def test_presets(spark):
    for name in ("loud", "own", "less"):
        screen = Screen.from_preset(json.dumps(PRESETS[name]))
        rows = spark.createDataFrame([(t,) for t in SCORES], "text string").select("text", screen.verdict("text").alias("v"))
        for r in rows.collect():
            assert r["v"]["score"] == SCORES[r["text"]][name] and r["v"]["flagged"] == (r["v"]["score"] > 0), (name, r["text"])
    with pytest.raises((DocumentError, RuntimeError)):
        Screen.from_preset(json.dumps(PRESETS["all"]))
    assert Preset.parse(json.dumps(PRESETS["own"])).entries[0].word


def test_hostile_packs():
    good = pack.encode([("zed", "hate", 2, True), ("yot", "drug", 5, False)], ["zedd"])
    for k in range(len(good)):
        for mask in (0x01, 0x80, 0xFF):
            bad = bytearray(good)
            bad[k] ^= mask
            try:
                found = pack.decode(bytes(bad))
            except DocumentError:
                continue
            assert all(1 <= s <= 5 and t for t, _, s, _ in found["entries"])
    for text in ("", "AAAA", "not base64 at all", "{", "e30=" * 1000, "\0"):
        with pytest.raises(DocumentError):
            documents.read_list(text)
    assert Dictionary().add_seed(pack.to_text(good)).has_term("ZED")
