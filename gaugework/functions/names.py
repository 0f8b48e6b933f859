"""SQL for column-name tokens and vocabulary matching."""

from __future__ import annotations


def name_tokens(name: str) -> str:
    """Lower-case words of a column name: camel case, underscores, dashes and spaces separate."""
    spaced = f"regexp_replace({name}, r'(?<=[a-z0-9])(?=[A-Z])', ' ')"
    return f"filter(split(lower({spaced}), r'(?U)[_\\-\\s]+'), word -> word <> '')"


def ends_with_phrase(words: str, phrases: tuple[str, ...]) -> str:
    """Whether the space-joined tokens are, or end with, one of the phrases."""
    return "(" + " or ".join(f"endswith(concat(' ', {words}), ' {phrase}')" for phrase in phrases) + ")"


def is_phrase(words: str, phrases: tuple[str, ...]) -> str:
    """Whether the space-joined tokens are exactly one of the phrases."""
    return f"{words} in ({', '.join(repr(phrase) for phrase in phrases)})"


def has_word(tokens: str, words: tuple[str, ...]) -> str:
    return f"arrays_overlap({tokens}, array({', '.join(repr(word) for word in words)}))"
