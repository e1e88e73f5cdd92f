"""Prompts for language models, and reading their answers."""

from __future__ import annotations

import json

#: Characters of a passage that a prompt for ranking shows; other prompts show whole texts.
PASSAGE_CHARS = 500


def parsed_json(text: str, kind: type = object):
    """The outermost object or array of an answer; an empty one of the kind where there is none."""
    opens = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    closes = max(text.rfind("}"), text.rfind("]"))
    empty = [] if kind is list else {} if kind is dict else None
    if not opens or closes < min(opens):
        return empty
    try:
        value = json.loads(text[min(opens) : closes + 1])
    except ValueError:
        return empty
    return value if isinstance(value, kind) else empty


def _numbered(passages: list[str]) -> str:
    return "\n".join(f"[{i}] {p[:PASSAGE_CHARS]}" for i, p in enumerate(passages))


def scoring(query: str, passages: list[str]) -> str:
    return f"Score each passage from 0 to 10 for how well it answers the query.\nQuery: {query}\n{_numbered(passages)}\nAnswer as JSON: [{{\"id\": 0, \"score\": 7}}, ...]"


def listwise(query: str, passages: list[str]) -> str:
    return f"Order the passages by how well they answer the query, best first.\nQuery: {query}\n{_numbered(passages)}\nAnswer as a JSON array of their numbers."


def hypothesis(query: str, language: str) -> str:
    return f"Write a short passage in the language '{language}' that would answer: {query}"


def synonyms(query: str, language: str) -> str:
    return f"Give up to three other wordings of this query in the language '{language}', as a JSON array of strings: {query}"


def translation(text: str, language: str) -> str:
    return f"Translate into the language '{language}', answering with the translation only: {text}"


def distribution(chunks: list[tuple[int, str, list[tuple[int, str]]]]) -> str:
    """Asks what becomes of each chunk; ``chunks``: number, whole text, ids and titles of candidate notes."""
    named = lambda notes: "; ".join(f"[{i}] {title}" for i, title in notes) or "none"
    parts = [f"Chunk {n}: {text}\nCandidates: {named(notes)}" for n, text, notes in chunks]
    actions = '"append" (target_note_id), "create_child" (parent_note_id or parent_chunk_index, new_note_title), "merge_with_chunk" (chunk_index) or "skip"'
    return "For each chunk of the draft choose an action: " + actions + ".\n" + "\n\n".join(parts) + "\nAnswer as a JSON array with action, its fields, tags, confidence and reason for each chunk."


def card_front(section: str) -> str:
    return f"Write one question that the following text answers, and nothing else:\n{section}"


def atoms(text: str) -> str:
    return f"Split the text into notes of one idea each. Answer as a JSON array of objects with title and text.\n{text}"


def taxonomy(titles: list[str]) -> str:
    return "Arrange the titles in a tree. Answer as a JSON array of objects with title and parent.\n" + "\n".join(titles)


def placement(title: str, paths: list[str]) -> str:
    return f"Under which of these paths does the note '{title}' belong? Answer with the path only.\n" + "\n".join(paths)
