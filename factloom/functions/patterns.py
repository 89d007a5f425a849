"""Java patterns of dictionary terms. Texts are prepared: lower case and single spaces.

\\b here means an ASCII boundary, written as explicit guards, as Java's own is Unicode-aware.
"""

from __future__ import annotations

import re

#: Letters that count as equal in a term.
EQUAL = {c: group for group in ("aăâ", "iî", "sșş", "tțţ") for c in group}
#: The same as a translation to the first letter of each group.
MARKED, UNMARKED = "".join(c for c, g in EQUAL.items() if c != g[0]), "".join(g[0] for c, g in EQUAL.items() if c != g[0])
#: Words before or after a term that say it only looks so.
QUALIFIER_BEFORE = "aspect(?: de)?|tip|imita[tț]ie(?: de)?|efect(?: de)?|imitation|faux|look(?: of)?|effect"
QUALIFIER_AFTER = "effect|look(?:alike)?|style"
#: Names of dimensions; one that begins beyond ASCII has its boundary the other way round.
DIMENSIONS = "l|h|w|d|lungime|latime|lățime|inaltime|înălțime|adancime|adâncime|diametru|length|width|height|depth|diameter"

LETTER = r"[\p{L}\p{N}]"
BEGIN, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
NUMBER = r"\d+(?:[.,]\d+)?"
UNIT = 'cm|mm|m|inch|in|"'

CHAIN = rf'(?iu){BEGIN}{NUMBER}(?:\s*[x×]\s*{NUMBER}){{1,2}}\s*(?:(?:cm|mm|m|inch|in){END}|"(?=[A-Za-z0-9_]))'
#: What every hit of it has.
CHAINED = r"\d\s*[xX×]"


def _by_letter(names: list[str]) -> str:
    """The names as a pattern that asks for a first letter once, however many names begin with it."""
    return "|".join(f"{c}(?:{'|'.join(sorted((n[1:] for n in names if n[0] == c), reverse=True))})" for c in sorted({n[0] for n in names}))


_ASCII, _BEYOND = (f"(?:{_by_letter([n for n in DIMENSIONS.split('|') if n[0].isascii() is a])})" for a in (True, False))
#: A name's first letter is looked at first, so few places go further; no two names fit one place.
NAMED = rf"(?iu)(?=[{''.join(sorted({n[0] for n in DIMENSIONS.split('|')}))}])((?:{BEGIN}{_ASCII}|(?<=[A-Za-z0-9_]){_BEYOND}))\s*[:=]?\s*({NUMBER})\s*({UNIT})?"
#: The same three parts in a whole hit of it.
NAMED_PARTS = rf"(?iu)^([^\s:=\d]+)\s*[:=]?\s*({NUMBER})\s*({UNIT})?"
BARE = rf"(?iu){BEGIN}{NUMBER}\s*(?:cm|mm|kg|g|ml|l){END}"


#: The one to three words after a term, in what follows it.
CAPTURED = r"^ ((?:[\p{L}\p{N}-]+ ){0,2}[\p{L}\p{N}-]+)"


def term_pattern(term: str) -> str:
    """A fragment that ignores marks on letters."""
    return "".join(f"[{EQUAL[c]}]" if c in EQUAL else " " if c == " " else re.escape(c) for c in term.lower())


def plain_pattern(base: str) -> str:
    """Existence of a term as a word of its own without a qualifier; its letters come first, so few places go further."""
    t = term_pattern(base)
    return rf"{t}(?!{LETTER})(?! ?-? ?(?:{QUALIFIER_AFTER}){END})(?<!{LETTER}{t})(?<!(?:{QUALIFIER_BEFORE}) ?{t})"


def sure_part(base: str) -> str:
    """The longest part of a term that term_pattern asks for as it is."""
    return max(re.split(f"[{''.join(EQUAL)}]", base.lower()), key=len)


def prefix_pattern(base: str) -> str:
    t = term_pattern(base)
    return rf"{t}(?<!{LETTER}{t}) ((?:[\p{{L}}\p{{N}}-]+ ){{0,2}}[\p{{L}}\p{{N}}-]+)"


def count_pattern(base: str) -> str:
    return rf"{BEGIN}(\d+) {term_pattern(base)}(?!{LETTER})"
