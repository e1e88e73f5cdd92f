"""Text functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent English and Russian words that queries drop: a list of our own.
STOP_WORDS = frozenset(
    """a about above after again all am an and any are as at be because been before being below between both but by can
    did do does doing down during each few for from further had has have having he her here hers him his how i if in into
    is it its just me more most my no nor not now of off on once only or other our out over own same she so some such than
    that the their them then there these they this those through to too under until up very was we were what when where
    which while who whom why will with you your и в во не что он на я с со как а то все она так его но да ты к у же вы за бы
    по только ее мне было вот от меня еще нет о из ему""".split()
)


def query_tokens(query: str) -> list[str]:
    """Lower-cased words without stop words and words under three bytes; if none is left, all words."""
    words = [w for w in re.split(r"[\W_]+", query.lower()) if w]
    kept = [w for w in words if w not in STOP_WORDS and len(w.encode()) >= 3]
    return kept or [w for w in re.split(r"[\W_]+", query) if w]


def query_words(query: Column) -> Column:
    """``query_tokens`` of a column, in lower case and without operators: what a search asks for."""
    apart = lambda text: F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    kept = F.filter(apart(F.lower(query)), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*sorted(STOP_WORDS)))
    words = F.when(F.size(kept) > 0, kept).otherwise(apart(query))
    return F.transform(F.filter(words, lambda w: ~w.isin("AND", "OR", "NOT")), F.lower)


#: White space by the Unicode property.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def n_tokens(text: Column) -> Column:
    """The larger of 1.5 tokens a word (between Unicode white space) and a token for three characters, rounded up."""
    trimmed = F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))
    return F.ceil(F.greatest(words * 1.5, F.char_length(text) / 3)).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slug(name: Column) -> Column:
    return F.lower(F.btrim(name))


def hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"#([a-zA-Z0-9_\-/]+)"), 1)


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs, without overlaps."""
    left = F.char_length(F.replace(text, F.lit(term), F.lit("")))
    return ((F.char_length(text) - left) / len(term)).cast("long")


def _replaced(text: Column, marks: tuple[str, ...], pattern: str, by: str = "") -> Column:
    """``pattern`` replaced in the texts that hold one of ``marks``, without which it matches nothing; a search for
    these is far cheaper.  The text is computed once, as the only element of an array."""
    held = lambda t: reduce(Column.__or__, [F.contains(t, F.lit(m)) for m in marks])
    return F.get(F.transform(F.array(text), lambda t: F.when(held(t), F.regexp_replace(t, pattern, by)).otherwise(t)), F.lit(0))


def blank_lines_collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\n\s*\n", "\n")


def links_to_labels(text: Column) -> Column:
    """Wiki links become their alias or target, Markdown links their label."""
    text = _replaced(text, ("[[",), r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1")
    text = _replaced(text, ("[[",), r"\[\[([^\]|]+)\]\]", "$1")
    return _replaced(text, ("](",), r"\[([^\]]+)\]\([^\)]+\)", "$1")


def list_markers_dropped(text: Column) -> Column:
    return _replaced(text, ("-", "+", "*"), r"(?md)^\s*[-+*]\s+")


def numbers_dropped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?md)^\s*\d+\.\s+", "")


def heading_marks_dropped(text: Column) -> Column:
    return _replaced(text, ("#",), r"(?md)^#{1,6}\s+")


def rules_dropped(text: Column) -> Column:
    return _replaced(text, ("***", "---", "___"), r"(?md)^(?:\*{3,}|-{3,}|_{3,})\s*$")


def emphasis_dropped(text: Column) -> Column:
    """Bold, struck, marked and code text; italics only where white space or the text's ends are around."""
    for mark in (r"\*\*", "__", "~~", "==", "`"):
        text = _replaced(text, (mark.replace("\\", ""),), f"(?d){mark}(.+?){mark}", "$1")
    for mark, other in (("_", "[^_]"), (r"\*", "[^*]")):
        text = _replaced(text, (mark.replace("\\", ""),), rf"(^|\s){mark}({other}+){mark}(\s|$)", "$1$2$3")
    return text


def latex_dropped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\$\$.*?\$\$", ""), r"\$[^$\n]+\$", "")


def cleaned(text: Column, rules: bool = True, numbers: bool = True, markers: bool = True, links: bool = True, latex: str = "keep",
            emphasis: bool = True, headings: bool = True, compact: bool = True, lower: bool = True) -> Column:
    """The cleaning chain, each step as its flag says.  ``latex`` is ``keep`` or ``remove``; tables as
    lines and formatted LaTeX need ``functions.markdown.clean``, which has the same steps."""
    steps = ((rules, rules_dropped), (numbers, numbers_dropped), (markers, list_markers_dropped), (links, links_to_labels),
             (latex == "remove", latex_dropped), (emphasis, emphasis_dropped), (headings, heading_marks_dropped), (compact, blank_lines_collapsed))
    for wanted, step in steps:
        text = step(text) if wanted else text
    return F.btrim(F.lower(text) if lower else text, F.lit(" \t\n\x0b\f\r"))


def json_payload(text: Column) -> Column:
    """From the first opening brace or bracket to the last closing one."""
    return F.regexp_extract(text, r"(?s)[\{\[].*[\}\]]", 0)
