"""Scalar text functions as Column expressions; nothing here leaves the JVM unless it says so."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BOLD,
    BULLETS,
    CAPTION,
    CONTROL,
    ENTRY_SIGNALS,
    EXOTIC_SPACE,
    FRONT_MATTER,
    INVISIBLE,
    LIGATURES,
    LIST_PREFIX,
    PAGE_NUMBERS,
    REFERENCE_HEADINGS,
    SENTENCE_END,
    WS,
    WS_CHARS,
)
from .arrow import arrow_udf

_WORD = re.compile(f"[^{re.escape(WS_CHARS)}]+")
TRANSFORMATIONS = "array<struct<kind:string,offset:int,before:string,after:string,source_item_ids:array<string>>>"


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+$", "")


def blank(c: Column) -> Column:
    return trim(c) == ""


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{WS}]+"))


def round_half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def expand_ligatures(c: Column) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), c)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, f"[\\x{{AD}}{INVISIBLE}{CONTROL}]", "")


def collapse_spaces(c: Column) -> Column:
    """Runs of two or more horizontal spaces, and any single one that is not U+0020, become U+0020."""
    return F.regexp_replace(c, f"[ \\t{EXOTIC_SPACE}]{{2,}}|[{EXOTIC_SPACE}]", " ")


def normalize(c: Column) -> Column:
    return collapse_spaces(strip_invisible(expand_ligatures(c)))


def splits_word(current: Column, following: Column) -> Column:
    """Whether `current` ends in a hyphen that only wraps a word into `following`."""
    hyphen = matches(trim_end(current), r"\p{L}\p{L}[-\x{2010}\x{2011}]$")
    return F.coalesce(hyphen & matches(following, f"^[{WS}]*\\p{{Ll}}"), F.lit(False))


def repetition_signature(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[0-9]+", "#"), r"[^\p{L}\p{N}#]+", " "))


def page_number_form(c: Column) -> Column:
    """Name of the first page-number form that the whole text has, else null."""
    t = trim(c)
    out = F.when(t == "", F.lit(None).cast("string"))
    for name, pattern in PAGE_NUMBERS:
        out = out.when(matches(t, pattern), F.lit(name))
    return out


def reference_heading(c: Column) -> Column:
    """struct(type, label) of a heading that opens a reference section, else null."""
    t = trim(c)
    kind = "struct<type:string,label:string>"
    out = F.when(F.length(t) > 40, F.lit(None).cast(kind))
    for type_, label, pattern in REFERENCE_HEADINGS:
        out = out.when(matches(t, pattern), F.struct(F.lit(type_).alias("type"), F.lit(label).alias("label")))
    return out


def entry_signals(c: Column) -> Column:
    """Names of the bibliography signs in a text."""
    return F.filter(F.array(*(F.when(matches(c, p), F.lit(n)) for n, p in ENTRY_SIGNALS)), lambda x: x.isNotNull())


def entry_score(c: Column) -> Column:
    return F.least(F.lit(1.0), F.size(entry_signals(c)) / F.lit(3.0))


def is_front_matter_heading(c: Column) -> Column:
    return matches(trim(c), FRONT_MATTER)


def is_caption(c: Column) -> Column:
    return matches(c, CAPTION)


def is_list_item(c: Column) -> Column:
    return matches(c, LIST_PREFIX)


def is_bold(font: Column) -> Column:
    return F.coalesce(matches(font, BOLD), F.lit(False))


def ends_sentence(c: Column) -> Column:
    return matches(c, SENTENCE_END)


def _words(texts: pa.Array) -> pa.Array:
    found, starts, ends, sizes = [], [], [], [0]
    for t in texts.to_pylist():
        for m in _WORD.finditer(t or ""):
            found.append(m[0])
            starts.append(m.start())
            ends.append(m.end())
        sizes.append(len(found))
    own = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), own)


def words(c: Column) -> Column:
    """array<struct<text, start, end>> of the words of a text (none of a null one): one pass through Arrow,
    since running offsets in the JVM would copy their array once a word."""
    return F.arrow_udf(_words, "array<struct<text:string,start:int,end:int>>")(c)


def composite_key(*fields: Column) -> Column:
    """Each field with its length in front, so that no two lists of fields read alike."""
    parts = [f.cast("string") for f in fields]
    return F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def redact(c: Column) -> Column:
    named = rf"(?i)(api[_-]?key|authorization|bearer|xi-api-key|subscription-key)[{WS}]*[:=][{WS}]*[^{WS}]+"
    return F.regexp_replace(F.regexp_replace(c, named, "[redacted]"), r"sk-[A-Za-z0-9_-]{16,}", "[redacted]")


def escape_xml(c: Column, attribute: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")) if attribute else ()):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ssml(text: Column, voice: Column, language: Column, speed: Column) -> Column:
    """Speech markup; the rate is the speed's distance from 1 in whole percent, halves to even."""
    rate = F.format_string("%+d%%", F.bround((speed - 1) * 100, 0).cast("int"))
    return F.concat(
        F.lit('<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis" xml:lang="'), escape_xml(language, True),
        F.lit('"><voice name="'), escape_xml(voice, True), F.lit('"><prosody rate="'), rate, F.lit('">'), escape_xml(text), F.lit("</prosody></voice></speak>"),
    )


def format_time(seconds: Column) -> Column:
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0) | (seconds == float("inf"))
    total = F.floor(seconds)
    return F.when(bad, F.lit("0:00")).otherwise(F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0")))


def clamp_speed(speed: Column) -> Column:
    odd = speed.isNull() | F.isnan(speed) | (F.abs(speed) == float("inf"))
    return F.when(odd, F.lit(1.0)).otherwise(F.least(F.lit(3.0), F.greatest(F.lit(0.5), round_half_up(speed * 100) / 100)))


def short_title(c: Column) -> Column:
    return F.when(F.length(c) > 90, F.concat(F.substring(c, 1, 87), F.lit("..."))).otherwise(c)


def match_key(c: Column) -> Column:
    """A text whose white space does not matter."""
    return trim(F.regexp_replace(c, f"[{WS}]+", " "))


def marker_label(kind: Column, page: Column) -> Column:
    figure = F.concat(F.lit("Figure on page "), page.cast("string"), F.lit(" — not described"))
    drawn = F.concat(F.lit("Drawn area on page "), page.cast("string"), F.lit(" — a chart, table or box; the text inside is read in page order, which may not be the order it is meant to be read in"))
    return F.when(kind == "figure", figure).otherwise(drawn)


def marker_speech(kind: Column, page: Column) -> Column:
    figure = F.concat(F.lit("Figure on page "), page.cast("string"), F.lit(", not described."))
    drawn = F.concat(F.lit("Drawn area on page "), page.cast("string"), F.lit(". The text inside is read in page order."))
    return F.when(kind == "figure", figure).otherwise(drawn)


def timing_label(source: Column) -> Column:
    return (
        F.when(source == "provider-exact", F.lit("Exact word timing from the speech provider"))
        .when(source == "browser-boundary", F.lit("Exact word timing from your browser"))
        .when(source == "estimated", F.lit("Estimated word position (the provider did not supply word timings)"))
        .otherwise(F.lit("Sentence-level highlighting only"))
    )


def upload_error(size: Column, most: Column) -> Column:
    """Why an upload of `size` bytes is refused, else null."""
    text = F.format_string(
        "That file is %.0f MB, which is larger than the %.0f MB limit for this deployment.",
        F.bround(size / F.lit(1048576.0), 0), F.bround(most / F.lit(1048576.0), 0),
    )
    return F.when(size > most, text)


def provider_name(c: Column) -> Column:
    return F.lower(trim(F.coalesce(c, F.lit(""))))


def origins(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim), lambda x: x != "")


def upload_bytes(megabytes: Column) -> Column:
    return (megabytes * 1024 * 1024).cast("long")


def logs_content(asked: Column, env: Column) -> Column:
    return asked & ~F.lower(env).isin("production", "prod")


def client_key(forwarded: Column, host: Column) -> Column:
    """Who asks: the first forwarded address, else the peer."""
    return F.when(F.coalesce(forwarded, F.lit("")) != "", trim(F.split(forwarded, ",")[0])).otherwise(F.coalesce(host, F.lit("unknown")))


@arrow_udf("string")
def safe_filename(names: pd.Series) -> pd.Series:
    """A base name of plain characters; Unicode decomposition needs Python."""
    import re

    def one(name: str | None) -> str:
        base = unicodedata.normalize("NFKD", (name or "").replace("\\", "/").rsplit("/", 1)[-1]).encode("ascii", "ignore").decode()
        base = re.sub(r"[^A-Za-z0-9._-]+", "_", base).lstrip(".").strip("._")
        return base[:120] or "document.pdf"

    return names.map(one)


@arrow_udf(TRANSFORMATIONS)
def normalization_log(texts: pd.Series, ids: pd.Series) -> pd.Series:
    """What `normalize` changes in each item, with offsets; zero-width characters go unlogged."""
    import re

    horizontal = "[ \t  -   　]{2,}"
    control = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"

    def one(text: str, item: str) -> list[dict]:
        log: list[dict] = []

        def note(kind: str, offset: int, before: str, after: str) -> str:
            log.append({"kind": kind, "offset": offset, "before": before, "after": after, "source_item_ids": [item]})
            return after

        out: list[str] = []
        at = 0
        for ch in text or "":
            got = note("ligature-expand", at, ch, LIGATURES[ch]) if ch in LIGATURES else ch
            out.append(got)
            at += len(got)
        now = re.sub("­", lambda m: note("soft-hyphen-removal", m.start(), m[0], ""), "".join(out))
        now = re.sub("[​‌‍﻿⁠]", "", now)
        now = re.sub(control, lambda m: note("control-char-removal", m.start(), m[0], ""), now)
        re.sub(horizontal, lambda m: note("whitespace-collapse", m.start(), m[0], " "), now)
        return log

    return pd.Series([one(t, i) for t, i in zip(texts, ids)])


def is_bullet(token: Column) -> Column:
    return matches(token, f"^[{BULLETS}]$")
