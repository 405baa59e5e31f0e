"""Values shared by all stages. Code points are the unit of every offset and length."""

# What counts as white space here, as the inside of a character class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters for Python's own string methods.
WS_CHARS = "\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"

#: Confidence from which a region is left out without asking, and from which it is flagged.
HIGH, MEDIUM, UNCERTAIN_ORDER = 0.8, 0.5, 0.6

# Characters written as two or three letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae"}
# Invisible and control characters, horizontal space.
INVISIBLE = r"\x{200B}\x{200C}\x{200D}\x{FEFF}\x{2060}"
CONTROL = r"\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}"
EXOTIC_SPACE = r"\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof st jr sr vs etc inc ltd co corp dept univ est approx no vol ed eds pp fig figs al et eg ie cf ca "
    "i.e e.g a.m p.m u.s u.k"
).split()
# Sentence terminators, closing marks and stand-alone list bullets, as classes.
TERMINATORS, CLOSERS, BULLETS = ".!?…", "\"'’”)\\]}»", "●•▪◦‣·∙"

# Page-number forms, tried in this order (first hit names the form).
PAGE_NUMBERS = [
    ("arabic numeral", r"^\d{1,4}$"),
    ("roman numeral", r"(?i)^[ivxlcdm]{1,7}$"),
    ("dashed numeral", rf"^[-–—][{WS}]*\d{{1,4}}[{WS}]*[-–—]$"),
    ('"Page N"', rf"(?i)^(page|p\.?|pg\.?)[{WS}]*\d{{1,4}}$"),
    ('"N of M"', rf"(?i)^\d{{1,4}}[{WS}]*(of|/)[{WS}]*\d{{1,4}}$"),
    ('"Page N of M"', rf"(?i)^page[{WS}]*\d{{1,4}}[{WS}]*(of|/)[{WS}]*\d{{1,4}}$"),
    ("chapter-page numeral", r"^\d{1,3}[-–]\d{1,4}$"),
]
_NUMBERING = rf"(\d+\.?[{WS}]*|[ivxlcdm]+\.?[{WS}]*)?"
# Headings that open a reference section.
REFERENCE_HEADINGS = [
    ("reference", "references heading", rf"(?i)^{_NUMBERING}(references|reference list|works cited|literature cited|citations)[{WS}]*:?$"),
    ("bibliography", "bibliography heading", rf"(?i)^{_NUMBERING}(bibliography|selected bibliography|further reading|suggested reading)[{WS}]*:?$"),
    ("index", "index heading", rf"(?i)^{_NUMBERING}(index|subject index|author index|name index)[{WS}]*:?$"),
]
#: ASCII word boundaries without look-around, so that any engine reads them alike.
_B, _E = r"(^|[^A-Za-z0-9_])", r"($|[^A-Za-z0-9_])"
# Signs that a region is a bibliography entry.
ENTRY_SIGNALS = [
    ("a year in parentheses", rf"\([{WS}]*(19|20)\d{{2}}[a-z]?[{WS}]*\)"),
    ("a DOI", rf"(?i){_B}(doi:[{WS}]*)?10\.\d{{4,9}}/[^{WS}]+"),
    ("a volume(issue), pages pattern", rf"{_B}\d{{1,4}}[{WS}]*\([{WS}]*\d{{1,3}}[{WS}]*\)[{WS}]*,?[{WS}]*\d{{1,5}}[{WS}]*[-–][{WS}]*\d{{1,5}}"),
    ("a page range", rf"(?i){_B}pp?\.[{WS}]*\d{{1,5}}[{WS}]*[-–][{WS}]*\d{{1,5}}"),
    ('an "Author, A." name form', rf"({_B}[A-Z]|[A-Za-z0-9_][^\P{{Lu}}A-Z])\p{{Ll}}+,[{WS}]+\p{{Lu}}\."),
    ("an editor or edition marker", rf"(?i){_B}(eds?\.[A-Za-z0-9_]|vol\.[A-Za-z0-9_]|no\.[A-Za-z0-9_]|(edition|in press|retrieved from){_E})"),
    ("a bracketed entry number", rf"^[{WS}]*\[\d{{1,3}}\][{WS}]"),
]
# Headings of front matter.
FRONT_MATTER = (
    r"(?i)^(preface|foreword|contents|table of contents|acknowledge?ments?|dedication|copyright|about the authors?|"
    rf"list of (figures|tables|abbreviations)|abstract|title page)[{WS}]*:?$"
)
# Marks of layout elements.
CAPTION = r"(?i)^(table|figure|fig\.?|chart|exhibit|scheme|plate)[" + WS + r"]*\d"
LIST_PREFIX = rf"^([•·●▪⁃–—-]|\(?\d{{1,2}}[.)]|\(?[a-zA-Z][.)])[{WS}]+"
SENTENCE_END = rf"[.!?][’\"')\]]?[{WS}]*$"
BOLD = r"(?i)bold|black|heavy|semibold|demibold"

#: Region type to the category that a reader can switch; the rest is always read in custom mode.
CATEGORY_OF = {
    "header": "headers", "footer": "footers", "page-number": "page-numbers", "footnote": "footnotes", "endnote": "endnotes",
    "caption": "captions", "table": "tables", "reference": "references", "bibliography": "bibliography", "index": "index", "sidebar": "sidebars",
}
EXCLUDABLE = ["header", "footer", "page-number", "watermark", "reference", "bibliography", "index"]
DEFAULT_CATEGORIES = {
    "front-matter": True, "headers": False, "footers": False, "page-numbers": False, "footnotes": True, "endnotes": True, "captions": True,
    "tables": False, "citation-markers": False, "references": False, "bibliography": False, "index": False, "sidebars": True,
}
DEFAULT_CITATIONS = {"read_parenthetical": True, "skip_numeric": True, "skip_superscript": True, "footnotes": "after-page", "reference_lists": False}
DEFAULT_SETTINGS = {
    "reading_mode": "clean", "categories": DEFAULT_CATEGORIES, "citations": DEFAULT_CITATIONS,
    "reader": {"font_size_px": 19, "line_height": 1.7, "text_width_ch": 68, "theme": "system", "focus_mode": False},
    "playback": {"voice_id": None, "provider": "browser", "speed": 1, "volume": 1},
    "tables": {"mode": "skip"}, "announcements": {"speak_figure_markers": True}, "region_overrides": {}, "ocr_consent": False, "ocr_render_scale": 2,
}
CHARS_PER_SECOND = 14.5
