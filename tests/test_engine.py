import random
import re
import time

import pytest

from lexsieve.functions import fold
from lexsieve.operators.automaton import Automaton
from lexsieve.operators.dictionary import Dictionary
from lexsieve.plans.engine import MATCH, Engine, Spans
from lexsieve.plans.policy import Category, Policy, ScoreMode

import numpy as np


def engine(policy=Policy(), dictionary=None):
    d = dictionary or Dictionary().use_language()
    return Engine([(t.text, t.category_name, t.severity, t.word) for t in d.terms.values()], sorted(d.allow), policy)


def terms(e, text):
    return [e.terms[t][0] for t in e.scan(text).term]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("", []), (None, []), ("a fine day", []), ("oh hell", ["hell"]), ("a shell", []), ("hello", []), ("h-e-l-l no", ["hell"]),
        ("what the hellll", ["hell"]), ("heel", []), ("hel", []), ("daaamn", ["damn"]), ("D@MN", ["damn"]), ("dаmn", ["damn"]),
        ("ＤＡＭＮ", ["damn"]), ("goddamn", ["goddamn"]), ("mid amn", []), ("debugger", []), ("bugger", ["bugger"]), ("de bugger", []),
        ("d­amn", ["damn"]), ("c­rap", ["crap"]), ("scrap", []), ("s crap", ["crap"]), ("loser", ["loser"]), ("looser", []),
    ],
)
def test_rules(text, found):
    assert terms(engine(), text) == found


def test_offsets_and_masks_count_utf16_units():
    e = engine()
    found = e.scan("😀 𝐝𝐚𝐦𝐧!")
    assert [x.tolist() for x in e.utf16("😀 𝐝𝐚𝐦𝐧!", found)] == [[3], [11]]
    assert e.mask("😀 𝐝𝐚𝐦𝐧!") == "😀 ********!"
    assert e.mask("nothing") == "nothing" and e.mask(None) is None


def test_policies():
    d = Dictionary().add_term("blorp", "hate", 4).add_term("lorp", "drug", 2)
    assert terms(engine(Policy(), d), "blorp") == ["blorp"]
    assert terms(engine(Policy(collapse_contained=False), d), "blorp") == ["blorp", "lorp"]
    assert terms(engine(Policy(categories={Category.DRUG}), d), "blorp") == ["lorp"]
    assert terms(engine(Policy(categories=frozenset()), d), "blorp") == []
    assert terms(engine(Policy(min_severity=3), d), "lorp blorp") == ["blorp"]
    assert terms(engine(Policy(repeat_tolerance=False), d), "bloorp") == []
    e = engine(Policy(score_mode=ScoreMode.MAX), d)
    assert e.score(e.scan("blorp lorp")) == 4
    assert engine(Policy(mask_token="[x]"), d).mask("a blorpblorp lorp") == "a [x][x] [x]"


def test_a_screen_needs_terms():
    with pytest.raises(RuntimeError):
        Engine([], [], Policy())


def test_automaton_finds_nested_and_overlapping_occurrences():
    a = Automaton()
    assert [a.add(p) for p in ("he", "she", "hers", "he")] == [0, 1, 2, 0]
    with pytest.raises(ValueError):
        a.add("")
    with pytest.raises(RuntimeError):
        a.scan("x")
    a.build()
    assert a.scan("ushers") == [(1, 3, 1), (2, 3, 0), (2, 5, 2)]
    with pytest.raises(RuntimeError):
        a.add("x")


def test_spans_agree_with_pairwise_comparison():
    draw = random.Random(3)
    for _ in range(200):
        spans = [(s := draw.randrange(30), s + draw.randrange(1, 6)) for _ in range(draw.randrange(8))]
        own = [(s := draw.randrange(30), s + draw.randrange(1, 6)) for _ in range(8)]
        a, b = (np.array(x, dtype=np.int64).reshape(-1, 2) for x in (spans, own))
        held = Spans(a[:, 0], a[:, 1])
        assert held.containing(b[:, 0], b[:, 1]).tolist() == [any(s <= x and e >= y for s, e in spans) for x, y in own]
        assert held.overlapping(b[:, 0], b[:, 1]).tolist() == [any(s < y and e > x for s, e in spans) for x, y in own]


def test_plain_matches_agree_with_regular_expressions():
    draw = random.Random(5)
    e = engine(Policy(repeat_tolerance=False, collapse_contained=False), Dictionary().add_term("aba").add_term("ab", word=True))
    for _ in range(300):
        text = "".join(draw.choice("ab ") for _ in range(20))
        words = [(m.start(), m.end()) for m in re.finditer("(?<![a-z])ab(?![a-z])", text)]
        found = e.scan(text)
        own = [(a, b) for a, b, t in zip(found.start, found.end, found.term) if t == 1]
        assert set(words) <= set(own)
        whole = [(m.start(), m.start() + 3) for m in re.finditer("(?=aba)", text)]
        assert set(whole) <= {(a, b) for a, b, t in zip(found.start, found.end, found.term) if t == 0}


def test_a_long_adversarial_text_takes_linear_time():
    e = engine()
    short, long = "looser " * 2_000, "looser " * 20_000
    e.scan(short)
    began = time.perf_counter()
    e.scan(short)
    middle = time.perf_counter()
    e.scan(long)
    assert time.perf_counter() - middle < 40 * (middle - began) + 1


def test_every_term_is_found_and_every_harmless_word_is_needed():
    d = Dictionary().use_language()
    e = engine(Policy(), d)
    for t in d.terms:
        assert len(e.scan(t).start), t
    for word in d.allow:
        assert not len(e.scan(word).start), word
        assert (e.candidates(word).reason != MATCH).any() or fold.squeeze(word) != word


def test_many_texts_are_scanned_like_each():
    draw = random.Random(21)
    parts = ["damn", " ", "hell", "o", "l", "l", "sh", "\U0010FFFF", "😀", "d a", "mn", "-", "idiot", "D@", "", "ａ", "goddamn", "debugger"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(3000)] + [None, "", "l" * 50, "hell", "hell"]
    for policy in (Policy(), Policy(repeat_tolerance=False), Policy(collapse_contained=False, score_mode=ScoreMode.MAX, mask_token="<>")):
        e = engine(policy)
        own = [e.scan(t) for t in texts]
        k = 0
        for part in e.slices(texts):
            found, detected = e.scan_of(part), e.detect_of(part)
            rows, masks, scores = part.rows(found), e.masks_of(part, found), e.scores_of(part, found)
            raw = e.candidates_of(part)
            for i, text in enumerate(part.texts):
                at = rows == i
                assert (found.start[at] - part.begins[i]).tolist() == own[k].start.tolist() and found.term[at].tolist() == own[k].term.tolist(), text
                assert (found.end[at] - part.begins[i]).tolist() == own[k].end.tolist()
                assert detected[i] == (len(own[k].start) > 0) == e.detect(text)
                assert masks[i] == (e.mask(text) or "") and scores[i] == e.score(own[k])
                assert sorted(raw.reason[part.rows(raw) == i].tolist()) == sorted(e.candidates(text).reason.tolist())
                k += 1
        assert k == len(texts)
