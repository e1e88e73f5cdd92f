"""Cutting Markdown notes into fragments: segments, packing under a budget, tables, titles.

Plain functions over one note's text; ``operators.fragments.fragmented`` runs them over a table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from .markdown import EMBEDDING, GENERATION, RAW, Flags, clean
from .notes import linear_table, split_tables

_BLANK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"[^.!?]+[.!?]+|.+\Z", re.S)
_PLACEHOLDER = re.compile(r"\{\{TABLE_\d+\}\}")


def n_tokens(text: str) -> int:
    """The larger of 1.5 tokens a word and a token for three characters, rounded up."""
    return -(-max(len(text.split()) * 9, len(text) * 2) // 6)


@dataclass(frozen=True)
class Atom:
    """A piece of a note that packing doesn't cut unless it is larger than a budget."""

    text: str
    title: str | None = None
    path: tuple[str, ...] = ()
    top: bool = False  # a heading of the first or second level
    heading: bool = False


@dataclass(frozen=True)
class Fragment:
    text: str
    title: str | None = None
    path: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """How notes are cut.  ``segment``: headings, blocks, semantic or whole; ``pack``: tokens, bytes or none."""

    segment: str = "headings"
    level: int = 2
    split_deeper: bool = True
    glue: bool = True
    pack: str = "tokens"
    budget: int = 256
    overlap: int = 0
    flags: Flags = field(default=EMBEDDING)
    title_in_text: bool = True
    front_matter: bool = True
    threshold: float = 0.7  # of semantic segments
    most_bytes: int = 800  # of semantic segments
    #: Keeps titles of fragments that overflow a budget, which are lost otherwise.
    keep_titles: bool = False


EMBEDDING_PRESET = Config()
GENERATION_PRESET = Config(glue=False, pack="none", flags=GENERATION, title_in_text=False)
STRUCTURAL_PRESET = Config(split_deeper=False, pack="none", flags=RAW)


def topic_preset(budget: int) -> Config:
    return Config(segment="blocks", pack="bytes", budget=budget, flags=RAW, title_in_text=False)


def semantic_preset(budget: int, threshold: float) -> Config:
    return replace(topic_preset(budget), segment="semantic", threshold=threshold, most_bytes=budget)


# Segments


def front_matter(content: str) -> tuple[dict | None, str]:
    """The YAML block at a note's start, None if there is none or it can't be read, and the rest."""
    found = re.match(r"(?s)\A---\n(.*?)\n---\n(.*)\Z", content)
    if not found:
        return None, content
    import yaml

    try:
        values = yaml.safe_load(found[1])
    except yaml.YAMLError:
        values = None
    return values if isinstance(values, dict) and values else None, found[2]


def first_heading(text: str) -> tuple[str, int] | None:
    """Title and level of the first heading."""
    found = re.search(r"(?m)^\s*(#{1,6})(.*)$", text)
    return (found[2].strip(), len(found[1])) if found else None


def _cut_at(text: str, level: int) -> list[str]:
    """``text`` cut before each heading of exactly ``level``; a line feed before a cut goes."""
    starts = [m.start() for m in re.finditer(rf"(?m)^#{{{level}}}\s", text)]
    edges = [0, *(s for s in starts if s), len(text)]
    parts = [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    return [p.removesuffix("\n").removesuffix("\r") for p in parts[:-1]] + parts[-1:]


def _section_title(section: str, level: int) -> tuple[str | None, tuple[str, ...]]:
    line = section.lstrip().split("\n", 1)[0].rstrip("\r")
    if not re.match(rf"#{{{level}}}\s", line):
        return None, ()
    return line.replace("#", "").strip(), (line,)


def heading_atoms(text: str, level: int = 2, split_deeper: bool = True, glue: bool = True) -> list[Atom]:
    """Paragraphs of the sections at a level; a heading of a lower level is glued to the next paragraph."""
    out = []
    for section in _cut_at(text, level):
        title, path = _section_title(section, level)
        spans, at = [], 0
        for blank in _BLANK.finditer(section):
            spans.append((at, blank.start()))
            at = blank.end()
        spans = [(a, b) for a, b in [*spans, (at, len(section))] if section[a:b].strip()]
        while spans:
            begin, end = spans.pop(0)
            if glue and spans and re.match(r"#{1,6}\s", section[begin:end]):
                end = spans.pop(0)[1]
            piece = section[begin:end]
            deeper = _cut_at(piece, level + 1) if split_deeper else [piece]
            out += [Atom(p, title, path) for p in deeper if p.strip()]
    return out


def _starts_block(line: str) -> bool:
    return bool(re.match(r" {0,3}(#{1,6}(\s|$)|>|```|~~~|[-+*]\s|\d{1,9}[.)]\s|([-*_])(\s*\3){2,}\s*$|\|)", line))


def blocks(text: str) -> Iterator[str]:
    """The top-level blocks: headings, fences, quotes, lists, tables, rules, paragraphs."""
    lines, at = text.split("\n"), 0
    while at < len(lines):
        line, begin = lines[at], at
        at += 1
        if not line.strip():
            continue
        fence = re.match(r" {0,3}(`{3,}|~{3,})", line)
        item = re.match(r" {0,3}([-+*]|\d{1,9}[.)])\s", line)
        if fence:
            while at < len(lines) and not re.match(rf" {{0,3}}{fence[1][0]}{{{len(fence[1])},}}\s*$", lines[at]):
                at += 1
            at = min(at + 1, len(lines))
        elif re.match(r" {0,3}(([-*_])(\s*\2){2,}\s*$|#{1,6}(\s|$))", line):
            pass
        elif item:
            while at < len(lines):
                nxt = lines[at]
                ahead = next((x for x in lines[at:] if x.strip()), None)
                inside = bool(ahead) and (ahead.startswith((" ", "\t")) or bool(re.match(r" {0,3}([-+*]|\d{1,9}[.)])\s", ahead)))
                if not nxt.strip() and not inside or nxt.strip() and not inside and (not lines[at - 1].strip() or _starts_block(nxt)):
                    break
                at += 1
        else:
            quote, table = line.lstrip().startswith(">"), line.lstrip().startswith("|")
            while at < len(lines) and lines[at].strip():
                if re.match(r" {0,3}(=+|-+)\s*$", lines[at]) and not (quote or table):
                    at += 1  # the line under a heading
                    break
                own = lines[at].lstrip().startswith(">") if quote else lines[at].lstrip().startswith("|") if table else False
                if not own and _starts_block(lines[at]):
                    break
                at += 1
        yield "\n".join(lines[begin:at]).rstrip("\n")


def block_atoms(text: str) -> list[Atom]:
    out = []
    for block in blocks(text):
        marks = re.match(r" {0,3}(#{1,6})(\s|$)(.*)", block)
        under = re.match(r"(?s)(.+)\n {0,3}(=+|-+)\s*\Z", block)
        if marks:
            title = re.sub(r"\s+#+\s*$", "", marks[3]).strip()
            out.append(Atom(block, title, (), len(marks[1]) <= 2, True))
        elif under and not _starts_block(block):
            out.append(Atom(block, under[1].strip(), (), True, True))
        else:
            out.append(Atom(block))
    return out


def semantic_atoms(atoms: list[Atom], embed: Callable | None, threshold: float, most_bytes: int) -> list[Atom]:
    """Neighbouring blocks joined while they are alike, short together and no heading follows."""
    try:
        vectors = embed([a.text for a in atoms]) if atoms else []
    except Exception:  # without vectors nothing is alike
        vectors = [()] * len(atoms)
    out, group, size = [], [], 0

    def flush() -> None:
        if group:
            title = next((a.title for a in group if a.title), None)
            out.append(Atom("\n\n".join(a.text for a in group), title, group[0].path, group[0].top, group[0].heading))

    for i, atom in enumerate(atoms):
        alike = i > 0 and sum(x * y for x, y in zip(vectors[i - 1], vectors[i], strict=False)) >= threshold
        if group and (not alike or size + len(atom.text.encode()) > most_bytes or atom.heading):
            flush()
            group, size = [], 0
        group.append(atom)
        size += len(atom.text.encode())
    flush()
    return out


# Large texts


def _greedy(pieces: list[tuple[str, int]], budget: int, joint: str, smaller: Callable[[str], list]) -> Iterator[tuple[str, int]]:
    """Pieces joined while they fit, a token for each joint; one that is too large is cut by ``smaller``."""
    group, total = [], 0
    for text, size in pieces:
        if group and (size > budget or total + 1 + size > budget):
            yield joint.join(group), total
            group, total = [], 0
        if size > budget:
            yield from smaller(text)
        else:
            total += size + bool(group)
            group.append(text)
    if group:
        yield joint.join(group), total


def by_words(text: str, budget: int) -> list[tuple[str, int]]:
    """Words freely up to two bytes a token, from there on as long as the tokens fit."""
    words, out, at = text.split(), [], 0
    while at < len(words):
        begin, size = at, 0
        while at < len(words) and (at == begin or size + len(words[at].encode()) + 1 <= 2 * budget):
            size += len(words[at].encode()) + 1
            at += 1
        total = n_tokens(" ".join(words[begin:at]))
        while at < len(words) and total + 1 + n_tokens(words[at]) <= budget:
            total += 1 + n_tokens(words[at])
            at += 1
        out.append((" ".join(words[begin:at]), total))
    return out


def by_sentences(text: str, budget: int) -> list[tuple[str, int]]:
    sentences = [s.strip() for s in _SENTENCE.findall(text)]
    sized = [(s, n_tokens(s)) for s in sentences if s]
    return list(_greedy(sized, budget, " ", lambda s: by_words(s, budget))) or by_words(text, budget)


def by_lines(text: str, budget: int) -> list[tuple[str, int]]:
    """A large paragraph cut by lines, large lines by sentences, large sentences by words."""
    sized = [(line, n_tokens(line)) for line in text.split("\n")]
    return list(_greedy(sized, budget, "\n", lambda line: by_sentences(line, budget)))


# Packing


def _meta(atoms: list[Atom]) -> tuple[str | None, tuple[str, ...]]:
    return (atoms[0].title, atoms[0].path) if atoms else (None, ())


def pack_tokens(atoms: list[Atom], budget: int, overlap: int = 0, keep_titles: bool = False) -> list[Fragment]:
    """Atoms joined by blank lines under a budget of tokens; the last ones of a fragment that fit
    ``overlap`` tokens start the next one too."""
    out: list[Fragment] = []
    batch: list[tuple[Atom, int]] = []

    def flush(last: bool = False) -> None:
        nonlocal batch
        if not batch:
            return
        kept, total = [], 0
        for atom, size in reversed(batch if not last else []):
            if total + size > overlap:
                break
            kept.insert(0, (atom, size))
            total += size
        named = batch if last or keep_titles else kept
        out.append(Fragment("\n\n".join(a.text for a, _ in batch), *_meta([a for a, _ in named])))
        batch = kept

    for atom in atoms:
        size = n_tokens(atom.text)
        pieces = [(atom, size)]
        if size > budget:
            flush(last=True)
            batch = []
            pieces = [(replace(atom, text=t), n) for t, n in by_lines(atom.text, budget)]
        for piece, n in pieces:
            if n > budget:
                flush(last=True)
                batch = []
                out.append(Fragment(piece.text, *_meta([piece])))
                continue
            if batch and sum(m for _, m in batch) + n > budget:
                flush()
            batch.append((piece, n))
    flush(last=True)
    return out


def pack_bytes(atoms: list[Atom], budget: int) -> list[Fragment]:
    """Atoms joined by blank lines under a budget of bytes; a heading of the first levels starts anew."""
    groups: list[list[Atom]] = []
    size = 0
    for atom in atoms:
        n = len(atom.text.encode())
        if not groups or atom.top or size + n > budget:
            groups.append([])
            size = 0
        groups[-1].append(atom)
        size += n
    out = []
    for group in groups:
        line = group[0].text.split("\n", 1)[0].replace("#", "").strip()
        short = line if len(line) <= 40 else line[:40] + "..."
        out.append(Fragment("\n\n".join(a.text for a in group), next((a.title for a in group if a.title), short), group[0].path))
    return out


def pack(atoms: list[Atom], config: Config) -> list[Fragment]:
    """Packing as configured; sections of headings are packed one by one."""
    if config.pack == "none":
        return [Fragment(a.text, a.title, a.path) for a in atoms]
    groups: list[list[Atom]] = []
    for atom in atoms:
        if not groups or config.segment == "headings" and atom.path != groups[-1][-1].path:
            groups.append([])
        groups[-1].append(atom)
    if config.pack == "bytes":
        return [f for g in groups for f in pack_bytes(g, config.budget)]
    return [f for g in groups for f in pack_tokens(g, config.budget, config.overlap, config.keep_titles)]


# Tables


def extracted_tables(text: str) -> tuple[str, list[str]]:
    """The text with placeholders for its tables, and these."""
    out, tables = [], []
    for is_table, part in split_tables(text):
        if is_table:
            out.append(f"{{{{TABLE_{len(tables)}}}}}")
            tables.append(part)
        else:
            out.append(part)
    return "\n".join(out), tables


def _table_texts(table: str, flags: Flags) -> list[str]:
    return linear_table(table).split("\n") if flags.linearize_tables and flags.each_table_row else [table]


def restored_tables(fragments: list[Fragment], tables: list[str], flags: Flags) -> list[Fragment]:
    """Tables back in their places, apart from the text around them if asked; those that no fragment
    has come last.  Fragments of headings alone go."""
    if not tables:
        return fragments
    named = {f"{{{{TABLE_{i}}}}}": t for i, t in enumerate(tables)}
    used, out = set(), []
    for fragment in fragments:
        held = [p for p in _PLACEHOLDER.findall(fragment.text) if p in named]
        used |= set(held)
        if not flags.tables_apart:
            out.append(replace(fragment, text=_PLACEHOLDER.sub(lambda m: named.get(m[0], m[0]), fragment.text)))
            continue
        rest = fragment.text
        for mark in dict.fromkeys(held):
            before, _, rest = rest.partition(mark)
            out += [replace(fragment, text=before.strip())] if before.strip() else []
            out += [replace(fragment, text=t) for t in _table_texts(named[mark], flags)]
        if not held or rest.strip():
            out.append(replace(fragment, text=rest.strip() if held else rest))
    out += [Fragment(t) for mark, table in named.items() if mark not in used for t in _table_texts(table, flags)]
    lines = lambda f: [x for x in f.text.split("\n") if x.strip()]
    return [f for f in out if not all(re.match(r"\s*#{1,6}\s", x) for x in lines(f))]


# A whole note


def _titled(text: str, title: str | None, flags: Flags) -> str:
    """The text behind its cleaned title, unless that is its first line already."""
    if not title:
        return text
    shown = clean(title, flags)
    return text if text.split("\n", 1)[0].strip().lower() == shown.lower() else f"{shown}\n{text}"


def fragment(content: str, config: Config = EMBEDDING_PRESET, embed: Callable | None = None) -> list[Fragment]:
    """The fragments of a note; without ``embed`` semantic segments are blocks."""
    body = front_matter(content)[1] if config.front_matter else content
    tables: list[str] = []
    if config.flags.preserve_tables:
        body, tables = extracted_tables(body)
    if config.segment == "headings":
        atoms = heading_atoms(body, config.level, config.split_deeper, config.glue)
    elif config.segment == "whole":
        atoms = [Atom(body)] if body.strip() else []
    else:
        atoms = block_atoms(body)
        if config.segment == "semantic" and embed is not None:
            atoms = semantic_atoms(atoms, embed, config.threshold, config.most_bytes)
    out = []
    for f in restored_tables(pack(atoms, config), tables, config.flags):
        text = clean(f.text, config.flags)
        if text:
            out.append(replace(f, text=_titled(text, f.title if config.title_in_text else None, config.flags)))
    return out


def fragment_pairs(content: str, config: Config = EMBEDDING_PRESET, embed: Callable | None = None) -> list[tuple[Fragment, str]]:
    """Raw fragments, each with its text for embedding."""
    raw = replace(config, flags=replace(RAW, tables_apart=config.flags.tables_apart))
    return [(f, clean(f.text, config.flags)) for f in fragment(content, raw, embed)]


def rule_chunks(content: str, budget: int) -> list[Fragment]:
    """Chunks of a draft by blocks."""
    return fragment(content, topic_preset(budget))


def semantic_chunks(content: str, embed: Callable, budget: int = 800, threshold: float = 0.7) -> list[Fragment]:
    """Chunks of a draft by likeness of its blocks."""
    return fragment(content, semantic_preset(budget, threshold), embed)
