"""The spoken form of a sentence: what is skipped, and how offsets map back."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import BULLETS, DEFAULT_CITATIONS, WS_CHARS
from ..constants import WS as _WS

_S = "[" + re.escape(WS_CHARS) + "]"
# What can be skipped. The range from ; to the en dash between numbers is intended.
NUMBERS = rf"{_S}*[0-9]{{1,3}}(?:{_S}*[,;-–]{_S}*[0-9]{{1,3}})*{_S}*"
_BULLET = re.compile(rf"\A{_S}*[{BULLETS}]{_S}*")
_NUMERIC = [re.compile(rf"\[{NUMBERS}\]"), re.compile(rf"\({NUMBERS}\)")]
_RAISED = re.compile("[¹²³⁰⁴-⁹]+")
_DIGITS = re.compile(rf"(?:[0-9,;.–—-]|{_S})+")
_AFTER = re.compile(rf"(?:{_S}|[.,;:!?)\]}}])")
_L, _LU = r"[^\W\d_]", "[A-ZÀ-ÖØ-ÞĀ-Ɏ]"
_AUTHOR = re.compile(
    rf"\({_S}*(?:e\.g\.,?{_S}*|see{_S}+|cf\.{_S}*)?{_LU}(?:{_L}|['’-])+(?:{_S}+(?:et{_S}+al\.?|and|&|,){_S}*(?:{_L}|['’.-])*)*,?{_S}*(?:19|20)[0-9]{{2}}[a-z]?"
    rf"(?:{_S}*[;,]{_S}*[^()]{{0,60}}?(?:19|20)[0-9]{{2}}[a-z]?)*{_S}*\)"
)
_BULLET_SAID, _NUMBER_SAID, _RAISED_SAID, _AUTHOR_SAID = "list bullet", "isolated numeric citation marker", "superscript citation marker", "parenthetical author-year citation"

PROJECTION = "struct<text:string,skipped:array<struct<start:int,end:int,text:string,reason:string>>,anchors:array<struct<spoken:int,display:int>>,transformations:array<struct<kind:string,offset:int,before:string,after:string>>>"


def project(text: str, markers: list[tuple[int, int]], settings: dict) -> dict:
    found = [(m.start(), m.end(), _BULLET_SAID) for m in [_BULLET.match(text)] if m]
    if settings["skip_numeric"]:
        found += [(m.start(), m.end(), _NUMBER_SAID) for p in _NUMERIC for m in p.finditer(text)]
    if settings["skip_superscript"]:
        found += [(m.start(), m.end(), _RAISED_SAID) for m in _RAISED.finditer(text)]
        clipped = [(max(0, s), min(len(text), e)) for s, e in markers]
        found += [(s, e, _RAISED_SAID) for s, e in clipped if s < e and _DIGITS.fullmatch(text, s, e)]
    if not settings["read_parenthetical"]:
        found += [(m.start(), m.end(), _AUTHOR_SAID) for m in _AUTHOR.finditer(text)]
    # earliest first, longest of those; one that begins inside another goes
    skipped: list[tuple[int, int, str]] = []
    for s, e, why in sorted(found, key=lambda f: (f[0], -f[1])):
        if not skipped or s >= skipped[-1][1]:
            skipped.append((s, e, why))
    spoken, at, anchors, log = "", 0, [], []
    for s, e, why in skipped:
        anchors.append({"spoken": len(spoken), "display": at})
        spoken += text[at:s]
        log.append({"kind": "list-marker-skip" if why == _BULLET_SAID else "citation-marker-skip", "offset": len(spoken), "before": text[s:e], "after": ""})
        if _AFTER.match(text, e):
            spoken = spoken.rstrip(WS_CHARS)
        at = e
    anchors.append({"spoken": len(spoken), "display": at})
    return {"text": spoken + text[at:], "skipped": [{"start": s, "end": e, "text": text[s:e], "reason": why} for s, e, why in skipped], "anchors": anchors, "transformations": log}


def projection(text: Column, markers: Column | None = None, settings: dict | None = None, strict: bool = False) -> Column:
    """The spoken form as PROJECTION; in strict mode, and where nothing can match, the text itself without
    calling Python."""
    own = DEFAULT_CITATIONS | (settings or {})
    marks = F.coalesce(markers, F.array().cast("array<struct<start:int,end:int>>")) if markers is not None else F.array().cast("array<struct<start:int,end:int>>")
    same = F.struct(
        text.alias("text"), F.array().cast("array<struct<start:int,end:int,text:string,reason:string>>").alias("skipped"),
        F.array(F.struct(F.lit(0).alias("spoken"), F.lit(0).alias("display"))).alias("anchors"), F.array().cast("array<struct<kind:string,offset:int,before:string,after:string>>").alias("transformations"),
    )
    if strict:
        return same

    @pandas_udf(PROJECTION)
    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([project(t or "", [(int(m["start"]), int(m["end"])) for m in s], own) for t, s in zip(texts, spans)], columns=["text", "skipped", "anchors", "transformations"])

    possible = (F.size(marks) > 0) | F.regexp_like(text, F.lit(f"[\\[(¹²³⁰⁴-⁹]|^[{_WS}]*[{BULLETS}]"))
    # the function sees only texts that may change
    return F.when(~F.coalesce(possible, F.lit(False)), same).otherwise(run(F.when(possible, text), F.when(possible, marks).otherwise(F.array().cast("array<struct<start:int,end:int>>"))))


def simple_projection(text: Column) -> Column:
    """Bullets, numeric and superscript markers only, as one expression in the JVM: the usual case."""
    number = f"[{_WS}]*[0-9]{{1,3}}([{_WS}]*[,;-–][{_WS}]*[0-9]{{1,3}})*[{_WS}]*"
    marker = f"(\\[{number}\\]|\\({number}\\)|[¹²³⁰⁴-⁹]+)"
    no_bullet = F.regexp_replace(text, f"^[{_WS}]*[{BULLETS}][{_WS}]*", "")
    return F.regexp_replace(F.regexp_replace(no_bullet, f"[{_WS}]+{marker}([{_WS}.,;:!?)\\]}}])", "$4"), marker, "")


def display_offset(anchors: Column, spoken: Column) -> Column:
    """Where a spoken offset stands in the displayed text: the last anchor at or before it."""
    last = F.element_at(F.filter(anchors, lambda a: a["spoken"] <= spoken), -1)
    return last["display"] + (spoken - last["spoken"])


def segments(text: Column, skipped: Column) -> Column:
    """array<struct<text, skipped, start>> that add up to the text, in the JVM: cuts at all span edges."""
    spans = F.array_sort(skipped)
    edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.length(text)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))))))
    pairs = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda e, k: F.struct(e.alias("s"), F.get(edges, k + 1).alias("e")))
    cut = lambda p: F.struct(F.substr(text, p["s"] + 1, p["e"] - p["s"]).alias("text"), F.exists(spans, lambda s: (s["start"] <= p["s"]) & (p["e"] <= s["end"])).alias("skipped"), p["s"].alias("start"))
    return F.transform(F.filter(pairs, lambda p: p["e"] > p["s"]), cut)
