"""Patterns for many literal phrases."""

from __future__ import annotations

from collections.abc import Iterable

# A class body for letters, figures and marks. Few parts on purpose: every further range slows each character's test.
WORD_CHARS = "\\p{L}\\p{N}\\p{M}"


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in ".*+?()[]{}|^$\\#" else c for c in text)


def alternatives(words: Iterable[str]) -> str:
    """A pattern for any of ``words``, branching on the first character, so that most places fail at once."""
    words = sorted(set(words))
    heads = sorted({w[0] for w in words})
    tails = {h: sorted({w[1:] for w in words if w[0] == h}, key=lambda t: (-len(t), t)) for h in heads}
    return "|".join(f"{_literal(h)}(?:{'|'.join(map(_literal, tails[h]))})" for h in heads)
