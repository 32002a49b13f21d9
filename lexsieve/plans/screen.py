"""Screens: the four verbs on text columns, row by row, in batch and on streams."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexsieve.functions.streams import utf16_offsets
from lexsieve.operators.dictionary import Dictionary
from lexsieve.plans.engine import REASONS, Engine, Found, Slice
from lexsieve.plans.policy import Policy
from lexsieve.sources.documents import Preset

MATCH_TYPE = "array<struct<start:int,end:int,term:string,cat:string,cat_name:string,sev:int,term_id:int,cp_start:int,cp_end:int>>"
CANDIDATE_TYPE = "array<struct<cp_start:int,cp_end:int,term_id:int,stream:int,reason:string>>"


class Screen:
    """A dictionary under a policy. Verbs take a text column and give a column; nothing is shuffled.

    A null or empty text is clean: detect false, scan empty, filter the text itself (null for null), score 0.
    """

    def __init__(self, dictionary: Dictionary, policy: Policy | None = None) -> None:
        if not len(dictionary):
            raise RuntimeError("a screen needs at least one term")
        self.dictionary = dictionary
        self.policy = policy or dictionary.policy or Policy()

    @classmethod
    def default(cls, policy: Policy | None = None) -> Screen:
        return cls(Dictionary().use_language(), policy)

    @classmethod
    def from_seed(cls, source: str | bytes, policy: Policy | None = None) -> Screen:
        return cls(Dictionary().add_seed(source), policy)

    @classmethod
    def from_preset(cls, preset: Preset | str, resolver: Callable | None = None) -> Screen:
        return cls(Dictionary().add_preset(preset, resolver))

    def with_policy(self, policy: Policy) -> Screen:
        """The same dictionary under another policy; workers keep its compiled patterns."""
        return Screen(self.dictionary, policy)

    @property
    def term_count(self) -> int:
        return len(self.dictionary)

    def maker(self) -> Callable[[], Engine]:
        """A function that gives the engine: compiled once a worker process, whichever tasks, verbs and policies ask for it."""
        terms = [(t.text, t.category_name, t.severity, t.word) for t in self.dictionary.terms.values()]
        allow, policy = sorted(self.dictionary.allow), self.policy
        name = hashlib.sha256(repr((terms, allow)).encode()).hexdigest()
        return lambda: held(name, lambda: Engine(terms, allow, policy)).with_policy(policy)

    def scan(self, text: str | Column) -> Column:
        """The matches in order, array of struct: start and end in UTF-16 units, cp_start and cp_end in code points."""
        return self.udf("scan")(text)

    def candidates(self, text: str | Column) -> Column:
        """Every occurrence in either stream and what became of it (see engine.REASONS)."""
        return self.udf("candidates")(text)

    def detect(self, text: str | Column) -> Column:
        return self.udf("detect")(text)

    def filter(self, text: str | Column) -> Column:
        return self.udf("filter")(text)

    def score(self, text: str | Column) -> Column:
        return self.udf("score")(text)

    def verdict(self, text: str | Column) -> Column:
        """struct<matches, flagged, masked, score>: all verbs by one scan."""
        return self.udf("verdict")(text)

    def udf(self, verb: str) -> Callable:
        """The verb as a function of a text column."""
        make = self.maker()
        one, kind = VERBS[verb]
        arrow = _arrow(kind)

        def run(texts: pa.Array) -> pa.Array:
            engine = make()
            found = [one(engine, part, arrow) for part in engine.slices(texts.to_pylist())]
            whole = pa.concat_arrays(found) if found else pa.array([], arrow)
            return _nulls_kept(whole, texts, arrow) if verb == "filter" else whole

        return F.arrow_udf(run, kind)

    def register(self, spark: SparkSession, prefix: str = "screen") -> None:
        """The verbs as SQL functions, screen_detect(text) and so on, and the matches as a table function for
        LATERAL joins: screen_matches(text), a row a match."""
        for verb in ("detect", "scan", "filter", "score"):
            spark.udf.register(f"{prefix}_{verb}", self.udf(verb))
        make, arrow = self.maker(), _arrow(MATCH_TYPE)

        class Matches:
            def eval(self, text: str) -> Iterator[tuple]:
                engine = make()
                part = next(engine.slices([text]))
                yield from (tuple(m.values()) for m in _matches(engine, part, engine.scan_of(part), arrow)[0].as_py())

        spark.udtf.register(f"{prefix}_matches", F.udtf(Matches, returnType=MATCH_TYPE.removeprefix("array<struct<").removesuffix(">>").replace(":", " ")))


def held(name: str, make: Callable[[], Engine]) -> Engine:
    """The worker process's engine of this dictionary. The store is a module of its own, as functions that are sent to
    executors come with globals of their own each time."""
    store = sys.modules.setdefault("_held_engines", types.ModuleType("_held_engines")).__dict__
    if name not in store:
        for other in [k for k in store if not k.startswith("_")][:-7]:
            del store[other]
        store[name] = make()
    return store[name]


def _grouped(part: Slice, found: Found, order: np.ndarray, values: pa.StructArray) -> pa.ListArray:
    """The values, which are in this order of the found, as a list a text."""
    sizes = np.bincount(part.rows(found), minlength=len(part.texts))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(order)))


def _struct(kind: pa.DataType, columns: list) -> pa.StructArray:
    fields = list(kind.value_type)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)


def _matches(engine: Engine, part: Slice, found: Found, kind: pa.DataType) -> pa.Array:
    low = part.begins[part.rows(found)]
    units = utf16_offsets(part.points)
    told = [engine.terms[t] for t in found.term.tolist()]
    columns = [
        units[found.start] - units[low], units[found.end] - units[low], [t[0] for t in told],
        [str(engine.category[t]) for t in found.term.tolist()], [t[1] for t in told], [t[2] for t in told],
        found.term, found.start - low, found.end - low,
    ]
    return _grouped(part, found, np.arange(len(low)), _struct(kind, columns)).cast(kind)


def _candidates(engine: Engine, part: Slice, kind: pa.DataType) -> pa.Array:
    found = engine.candidates_of(part)
    row = part.rows(found)
    low = part.begins[row]
    columns = [found.start - low, found.end - low, found.term, found.stream, [REASONS[r] for r in found.reason.tolist()]]
    return _grouped(part, found, np.argsort(row, kind="stable"), _struct(kind, columns)).cast(kind)


def _verdict(engine: Engine, part: Slice, kind: pa.DataType) -> pa.Array:
    found = engine.scan_of(part)
    matches = _matches(engine, part, found, kind.field("matches").type)
    flags = pa.array(np.bincount(part.rows(found), minlength=len(part.texts)) > 0)
    columns = [matches, flags, pa.array(engine.masks_of(part, found), pa.string()), pa.array(engine.scores_of(part, found), pa.int32())]
    return pa.StructArray.from_arrays(columns, fields=list(kind))


def _nulls_kept(values: pa.Array, texts: pa.Array, kind: pa.DataType) -> pa.Array:
    return pc.if_else(pc.is_null(texts), pa.scalar(None, kind), values)


#: By verb: a function of the engine, a slice and the Arrow type, and the type.
VERBS: dict[str, tuple[Callable, str]] = {
    "scan": (lambda e, part, kind: _matches(e, part, e.scan_of(part), kind), MATCH_TYPE),
    "candidates": (_candidates, CANDIDATE_TYPE),
    "detect": (lambda e, part, kind: pa.array(e.detect_of(part)), "boolean"),
    "filter": (lambda e, part, kind: pa.array(e.masks_of(part, e.scan_of(part)), kind), "string"),
    "score": (lambda e, part, kind: pa.array(e.scores_of(part, e.scan_of(part)), pa.int32()), "int"),
    "verdict": (_verdict, f"struct<matches:{MATCH_TYPE},flagged:boolean,masked:string,score:int>"),
}


def excerpt(text: Column, match: Column) -> Column:
    """The stretch of text that a match covers."""
    return F.substring(text, match["cp_start"] + 1, match["cp_end"] - match["cp_start"])


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))
