"""Patterns of written numbers, keys and names, built from how they are written."""

from __future__ import annotations

from collections.abc import Iterable

#: What words are made of, inside a character class.
WORD = r"\p{L}\p{N}_"
UPPER = "A-ZÇĞİÖŞÜ"
LETTERS = UPPER + "a-zçğıöşü"


def number(shape: str, gap: str = "") -> str:
    """A run written as ``shape``: ``#`` is a digit, a blank may be a ``gap``, the rest stands for itself.

    ``number("5## ### ##", "[ -]")`` takes 532 123 45, 532-123-45 and 53212345.
    """
    out, run = [], 0
    for c in shape + "\0":
        if c == "#":
            run += 1
            continue
        if run:
            out.append(f"[0-9]{{{run}}}" if run > 1 else "[0-9]")
            run = 0
        if c != "\0":
            out.append((f"{gap}?" if gap else "") if c == " " else c)
    return "".join(out)


def digits(least: int, most: int, gap: str = "") -> str:
    """``least`` to ``most`` digits, each after the first with a gap before it if there is one."""
    return f"[0-9](?:{gap}?[0-9]){{{least - 1},{most - 1}}}" if gap else f"[0-9]{{{least},{most}}}"


def alone(body: str, besides: str = "", first: str = "") -> str:
    """``body`` where no word goes on: no letter, digit or underscore beside it (nor ``besides`` before it).

    ``first`` is what it must begin with; looked at first, it spares most places the look behind.
    """
    ahead = f"(?={first})" if first else ""
    return rf"{ahead}(?<![{WORD}{besides}])(?:{body})(?![{WORD}])"


def dialled(country: str, body: str, gap: str, must: bool = False) -> str:
    """A phone number with its country's code or a trunk zero before it; a plus sign belongs to the code."""
    return alone(rf"(?:\+?{country}{gap}?|0){'' if must else '?'}{body}", "+", "[+0-9]")


def key(starts: str, letters: str, least: int) -> str:
    """A credential: a known beginning, then ``least`` or more of some characters."""
    return rf"(?<![{WORD}])(?:{starts})[{letters}]{{{least},}}"


def one_of(words: Iterable[str]) -> str:
    """Any of the words, longer ones first."""
    escaped = [w.replace(".", "[.]") for w in sorted(words, key=lambda w: (-len(w), w))]
    return f"(?:{'|'.join(escaped)})"


def capitalised(least: int, most: int, gap: str = r"\s+") -> str:
    """So many words that begin with a capital, each followed by a gap."""
    return f"(?:[{UPPER}][{LETTERS}]*{gap}){{{least},{most}}}"
