import random
import re

import pytest

from pagewright.constants import ABBREVIATIONS, WS_CHARS
from pagewright.operators import sentences


def plain_segments(text):
    """A character-by-character model of the rules."""
    spans, start, i = [], 0, 0
    ws = lambda c: c in WS_CHARS

    def word(upto):
        upto = len(text[:upto].rstrip(WS_CHARS))
        begin = upto
        while begin > 0 and not ws(text[begin - 1]):
            begin -= 1
        return re.sub("[^a-z.]", "", text[begin:upto].lower())

    while i < len(text):
        c = text[i]
        at = lambda k: text[k] if 0 <= k < len(text) else None
        if c in "●•▪◦‣·∙" and i > start and ws(at(i - 1)) and at(i + 1) is not None and ws(at(i + 1)):
            spans.append(text[start:i])
            start = i
        elif c in ".!?…":
            end = i + 1
            while end < len(text) and text[end] in ".!?…\"'’”)]}»":
                end += 1
            rest = text[end:].lstrip(WS_CHARS)
            ok = end >= len(text) or ws(text[end])
            if ok and c == ".":
                w = word(i)
                single = i > 0 and re.fullmatch("[A-Za-z]", text[i - 1]) and (i < 2 or ws(text[i - 2]) or text[i - 2] == "(")
                number = i > 0 and text[i - 1] in "0123456789" and rest[:1] in tuple("0123456789")
                ok = not (w in ABBREVIATIONS or re.sub(r"\.$", "", w) in ABBREVIATIONS or single or re.fullmatch(r"(?:[a-z]\.){2,5}", word(i + 1)) or number)
            if ok and end < len(text):
                ok = bool(rest) and (rest[0].isupper() or rest[0].isnumeric() or rest[0] in "\"'“‘([")
                ok = ok or not rest
            if ok and (end >= len(text) or rest):
                end += len(text[end:]) - len(rest)
                spans.append(text[start:end])
                start, i = end, end - 1
        i += 1
    return spans + ([text[start:]] if start < len(text) else [])


def cut(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = {k: [] for k in range(len(texts))}
    for r in sentences.sentences(df, ["k"]).orderBy("k", "sentence_index").collect():
        out[r.k].append(r.text)
        assert texts[r.k][r.start : r.end] == r.text
    return [out[k] for k in range(len(texts))]


CASES = {
    "One idea. Two ideas! Three ideas?": 3,
    "Dr. Alvarez reviewed the chart. It was complete.": 2,
    "H.J.L. Heerspink and D.C. Wheeler reported the outcome.": 1,
    "Patients received vitamin D. The dose was fixed.": 1,
    "Intro • one item • another item": 3,
    "The ratio was 3·5 and rose.": 1,
    "Ellipsis... then more.": 1,
    "Numbers 1. 2. 3. in a row.": 1,
    "He said \"Stop.\" Then he left.": 2,
    "": 0,
}


def test_examples(spark):
    for text, got in zip(CASES, cut(spark, list(CASES))):
        assert len(got) == CASES[text], (text, got)
        assert "".join(got) == text


def test_against_the_plain_model(spark):
    rng = random.Random(3)
    parts = ["a", "B", "Dr", "etc", "e.g", "U.S", "1", "2", ".", ".", "!", "?", "…", " ", " ", "\n", '"', ")", "(", "•", "x", "É", "i", " "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(3000)]
    for text, got in zip(texts, cut(spark, texts)):
        assert got == plain_segments(text), repr(text)


def test_wrapped_lines(spark):
    rows = [("a", 0, "the bar- "), ("a", 1, "rier held"), ("a", 2, ""), ("a", 3, "X-"), ("a", 4, "Ray ok"), ("b", 0, "- item"), ("b", 1, "two")]
    df = spark.createDataFrame(rows, "d string, k int, text string")
    got = {r.d: r.text for r in sentences.region_texts(df, ["d"], "k").collect()}
    assert got == {"a": "the barrier held X- Ray ok", "b": "- item two"}


def test_lossless_check_passes(spark):
    df = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "text string")
    assert sentences.assert_lossless(df).count() == len(CASES) + 1


@pytest.mark.parametrize("override,confidence,want", [(None, 0.9, "excluded"), (None, 0.6, "uncertain"), ("include", 0.6, "included"), (None, 0.4, "included")])
def test_inclusion_of_sentences(spark, override, confidence, want):
    r = spark.createDataFrame([("d", "r1", want != "excluded", confidence, override)], "document_id string, id string, included boolean, confidence double, user_override string")
    s = spark.createDataFrame([("d", "s1", "r1"), ("d", "s2", "none")], "document_id string, id string, region_id string")
    got = {x.id: x.inclusion_status for x in sentences.apply_inclusion(s, r).collect()}
    assert got == {"s1": want, "s2": "included"}
