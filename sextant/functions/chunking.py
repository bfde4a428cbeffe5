"""Splitting one text into packed, overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

BLANK_LINE = re.compile(r"\n\s*\n")


def _packed(pieces: Iterable[str], limit: int, joint: str) -> Iterator[str]:
    """Join neighbouring pieces while they fit; a piece longer than the limit stays whole."""
    held: list[str] = []
    size = 0
    for piece in pieces:
        if held and size + len(joint) + len(piece) > limit:
            yield joint.join(held)
            held, size = [], 0
        size += len(piece) + (len(joint) if held else 0)
        held.append(piece)
    if held:
        yield joint.join(held)


def split_text(text: str, limit: int) -> Iterator[str]:
    """Short paragraphs packed line by line, long ones word by word."""
    short: list[str] = []
    for paragraph in filter(None, (p.strip() for p in BLANK_LINE.split(text.strip()))):
        if len(paragraph) <= limit:
            short.append(paragraph)
            continue
        yield from _packed(short, limit, "\n")
        yield from _packed(paragraph.split(), limit, " ")
        short = []
    yield from _packed(short, limit, "\n")


def overlapping_chunks(text: str | None, limit: int = 500, overlap: int = 50) -> list[str]:
    """Chunks of a text, each led by the tail of the chunk before it."""
    plain = list(split_text(text or "", limit))
    if overlap <= 0:
        return plain
    tails = ["", *[chunk[-overlap:] for chunk in plain]]
    return [f"{tail} {chunk}".strip() for tail, chunk in zip(tails, plain)]
