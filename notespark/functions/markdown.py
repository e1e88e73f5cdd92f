"""Cleaning Markdown: tables as lines, LaTeX as text, marks dropped; plain functions.

The steps that need no callback exist as Column expressions in ``functions.text`` too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .notes import linear_table, split_tables
from .symbols import ACCENTS, SYMBOLS

_COMMAND = re.compile(r"\\([a-zA-Z]+)(?![a-zA-Z0-9_])")
_ACCENT = re.compile(rf"\\({'|'.join(ACCENTS)})\{{([^}}]+)\}}")
_FRACTION = re.compile(r"\\frac\{([^}]+)\}\{([^}]+)\}")
_DISPLAY, _INLINE = re.compile(r"\$\$(.*?)\$\$", re.S), re.compile(r"\$([^$]+)\$")


@dataclass(frozen=True)
class Flags:
    """What cleaning does.  ``latex``: keep, format or remove; the last three concern whole documents."""

    lower: bool = True
    links: bool = True
    formatting: bool = True
    rules: bool = True
    numbering: bool = True
    list_markers: bool = True
    heading_markers: bool = True
    compact_lines: bool = True
    latex: str = "format"
    preserve_tables: bool = True
    linearize_tables: bool = True
    each_table_row: bool = True
    tables_apart: bool = True


EMBEDDING = Flags()
GENERATION = replace(EMBEDDING, latex="keep", linearize_tables=False, each_table_row=False)
RAW = Flags(lower=False, links=False, formatting=False, rules=False, numbering=False, list_markers=False, heading_markers=False,
            compact_lines=False, latex="keep", linearize_tables=False, each_table_row=False, tables_apart=False)


def _formula(text: str) -> str:
    text = _COMMAND.sub(lambda m: SYMBOLS.get(m[1], m[0]), text)
    for name, sign in (("sum", "∑"), ("prod", "∏")):  # directly followed by a limit, where the word's end doesn't show
        text = re.sub(rf"\\{name}\s*(?=[_^]\{{)", sign, text)
    text = _ACCENT.sub(lambda m: m[2] + ACCENTS[m[1]], text)
    text = _FRACTION.sub(r"(\1)/(\2)", text)
    return re.sub(r"\\[a-zA-Z]+", "", re.sub("[{}]", "", text))


def formatted_latex(text: str) -> str:
    """Formulas as text between their dollar signs: symbols, accents, fractions; other commands go."""
    text = _DISPLAY.sub(lambda m: f"$${_formula(m[1])}$$", text)
    return _INLINE.sub(lambda m: f"${_formula(m[1])}$", text)


def removed_latex(text: str) -> str:
    return _INLINE.sub("", _DISPLAY.sub("", text))


def _links(text: str) -> str:
    text = re.sub(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]", lambda m: m[2] or m[1], text)
    return re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", text)


def _formatting(text: str) -> str:
    for mark in (r"\*\*", "__", "~~", "==", "`"):
        text = re.sub(f"{mark}(.+?){mark}", r"\1", text)
    text = re.sub(r"(^|\s)_([^_]+)_(\s|$)", r"\1\2\3", text)
    return re.sub(r"(^|\s)\*([^*]+)\*(\s|$)", r"\1\2\3", text)


def clean(text: str, flags: Flags = EMBEDDING) -> str:
    """One fragment cleaned, steps in their order."""
    if flags.linearize_tables:
        text = "\n".join(linear_table(part) if is_table else part for is_table, part in split_tables(text))
    latex = {"format": formatted_latex, "remove": removed_latex}.get(flags.latex)
    steps = (
        (flags.rules, lambda t: re.sub(r"(?m)^(?:\*{3,}|-{3,}|_{3,})\s*$", "", t)),
        (flags.numbering, lambda t: re.sub(r"(?m)^\s*\d+\.\s+", "", t)),
        (flags.list_markers, lambda t: re.sub(r"(?m)^\s*[-+*]\s+", "", t)),
        (flags.links, _links),
        (latex is not None, latex),
        (flags.formatting, _formatting),
        (flags.heading_markers, lambda t: re.sub(r"(?m)^#{1,6}\s+", "", t)),
        (flags.compact_lines, lambda t: re.sub(r"\n\s*\n", "\n", t)),
        (flags.lower, str.lower),
    )
    for wanted, step in steps:
        text = step(text) if wanted else text
    return text.strip()
