"""Text functions that need more than Column expressions: plain functions and their Arrow UDFs."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import ACCENTS, SYMBOLS

#: Frequent words by language, a list of our own, for telling languages in Latin letters apart.
COMMON_WORDS = {
    "en": "the and of to in is that for it with as was on are this be".split(),
    "de": "der die und das von mit den ist nicht ein zu dem sich auf für im".split(),
    "fr": "le la les de des et un une du est que pour dans qui au en".split(),
    "es": "el la los de que y en un una por con para del se es al".split(),
    "it": "il lo gli di che e un una per con del della non sono è al".split(),
    "pt": "o os as de que e em um uma para com do da não é ao".split(),
    "pl": "i w na z się nie że do to jest jak po od dla przez są".split(),
    "nl": "de het een van en in is dat op te zijn voor met niet aan er".split(),
}
#: Letters that only one of the languages in Cyrillic letters has.
OWN_LETTERS = {"be": "ў", "uk": "іїєґ"}


def _by_script(text: str) -> str | None:
    """The language of a text in letters that aren't Latin: the most frequent script decides."""
    counts = {
        "ja": len(re.findall("[\u3040-\u30ff]", text)),
        "zh": len(re.findall("[\u4e00-\u9fff]", text)),
        "ru": len(re.findall("[\u0400-\u04ff]", text)),
    }
    if max(counts.values()) <= len(re.findall("[a-zA-Z\u00c0-\u024f]", text)):
        return None
    best = max(counts, key=counts.get)
    if best == "zh" and counts["ja"] * 10 > counts["zh"]:
        return "ja"  # kana among Chinese characters
    if best == "ru":
        return next((k for k, own in OWN_LETTERS.items() if any(c in own for c in text.lower())), "ru")
    return best


def detect_language(text: str, default: str | None = "en") -> str | None:
    """The language of a text: by its script, else the one with most frequent words in it; ``default``
    without any, ties by code."""
    if (found := _by_script(text or "")) is not None:
        return found
    words = re.findall(r"\w+", (text or "").lower())
    votes = {lang: sum(w in known for w in words) for lang, known in ((k, set(v)) for k, v in COMMON_WORDS.items())}
    best = max(votes.values())
    return min(k for k, v in votes.items() if v == best) if best else default


def is_english(text: str) -> bool:
    """False where the language can't be told."""
    return detect_language(text, None) == "en"


def language(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: detect_language(t or ""))

    return run(text)


def revision_patch(old: str, new: str) -> str:
    """A unified diff from the old to the new content."""
    lines = difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), "old", "new", lineterm="")
    return "\n".join(lines)


def revision(old: Column, new: Column) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([revision_patch(x, y) for x, y in zip(a, b, strict=True)], dtype="object")

    return run(old, new)


def _cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip().removeprefix("|").removesuffix("|").split("|")]


def _is_separator(row: str) -> bool:
    return bool(re.fullmatch(r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|?\s*", row))


def linear_table(table: str) -> str:
    """A Markdown table as lines ``1. header: value. header: value``; the text itself if it is none."""
    rows = table.split("\n")
    cut = next((i for i, r in enumerate(rows) if _is_separator(r)), None)
    if not cut:
        return table
    header, out = _cells(rows[cut - 1]), []
    for row in rows[cut + 1 :]:
        parts = [f"{h}: {c}" for h, c in zip(header, _cells(row), strict=False) if c]
        if parts:
            out.append(f"{len(out) + 1}. {'. '.join(parts)}")
    return "\n".join(out) or table


def split_tables(text: str) -> list[tuple[bool, str]]:
    """Runs of lines, and whether each is a table: lines that start with a bar, one a separator."""
    runs: list[tuple[bool, list[str]]] = []
    for line in text.split("\n"):
        bar = line.strip().startswith("|")
        if runs and runs[-1][0] == bar:
            runs[-1][1].append(line)
        else:
            runs.append((bar, [line]))
    out: list[tuple[bool, str]] = []
    for bar, lines in runs:
        is_table = bar and any(_is_separator(x) for x in lines)
        if out and not is_table and not out[-1][0]:
            out[-1] = False, out[-1][1] + "\n" + "\n".join(lines)
        else:
            out.append((is_table, "\n".join(lines)))
    return out


def prefixed_query(text: Column, model: Column) -> Column:
    """The query as embedding models want it."""
    m = F.lower(model)
    return (
        F.when(m.contains("bge"), F.concat(F.lit("Represent this sentence for searching relevant passages: "), text))
        .when(m.contains("e5"), F.concat(F.lit("query: "), text))
        .when(m.contains("qwen3"), F.concat(F.lit("Instruct: Given a query, retrieve relevant passages\nQuery: "), text))
        .otherwise(text)
    )


def prefixed_passage(text: Column, model: Column) -> Column:
    return F.when(F.lower(model).contains("e5"), F.concat(F.lit("passage: "), text)).otherwise(text)


#: Dimensions by what a model's name contains, the first that fits (fixed values).
KNOWN_DIMENSIONS = {
    "bge-small": 384, "bge-base": 768, "bge-large": 1024, "e5-small": 384, "e5-base": 768, "e5-large": 1024, "minilm-l6": 384,
    "nomic-embed": 768, "arctic-embed-s": 384, "granite-embedding": 384, "qwen3-embedding": 4096,
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536,
}


def known_dimension(model: Column) -> Column:
    """The dimension of a model by its name; null for others."""
    m, found = F.lower(model), F.lit(None).cast("int")
    for name, n in reversed(KNOWN_DIMENSIONS.items()):
        found = F.when(m.contains(name), n).otherwise(found)
    return found


def quantization(file_name: Column) -> Column:
    """The first part of a file name, between hyphens and underscores, that names a quantisation."""
    fits = lambda x: x.startswith("q") & F.octet_length(x).between(2, 6)
    return F.upper(F.get(F.filter(F.split(F.lower(file_name), "[-_]"), fits), F.lit(0)))


def draft_title(at: Column) -> Column:
    return F.concat(F.lit("Draft "), F.date_format(at, "yyyy-MM-dd HH:mm"))


def plain_latex(text: Column) -> Column:
    """Formulas as text without their dollar signs, by Column expressions: symbols, accents, fractions."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)\$\$(.*?)\$\$", "$1"), r"\$([^$]+)\$", "$1")
    for name, sign in SYMBOLS.items():
        text = F.regexp_replace(text, rf"\\{name}(?![a-zA-Z])" + (r"(?:\s*(?=[_^]\{))?" if name in ("sum", "prod") else ""), sign)
    for name, mark in ACCENTS.items():
        text = F.regexp_replace(text, rf"\\{name}\{{([^}}]+)\}}", f"$1{mark}")
    text = F.regexp_replace(text, r"\\frac\{([^}]+)\}\{([^}]+)\}", "($1)/($2)")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[{}]", ""), r"\\[a-zA-Z]+", ""), F.lit(" \t\n\r"))


def safe_file_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/"), "(?<=.)/$", "")
