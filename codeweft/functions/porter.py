"""Stemming by the published Porter algorithm, and the splitter of code identifiers."""

from __future__ import annotations

import re

#: English stop words.
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
#: Suffix tables of steps 2, 3 and 4 (suffix and replacement).
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut:
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        found = max((x for x in table if word.endswith(x[0])), key=lambda x: len(x[0]), default=None)
        if found and _measure(word[: -len(found[0])]) > 0:
            word = word[: -len(found[0])] + found[1]
    found = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if found:
        rest = word[: -len(found)]
        if _measure(rest) > 1 and (found != "ion" or rest[-1] in "st"):
            word = rest
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short(rest):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


ESCAPE = re.compile(r"\\(?:u+([0-9a-fA-F]{4})|([0-3]?[0-7]{1,2})|(.))", re.DOTALL)
#: One-letter escapes.
LETTERS = {"n": "\n", "t": "\t", "b": "\b", "r": "\r", "f": "\f", "s": " "}
HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_A-Za-z]+")


def unescaped(text: str) -> tuple[str, list[int]]:
    """The text with escapes decoded and NUL removed, and where each character came from (and the end)."""
    out, origin, at = [], [], 0
    for m in ESCAPE.finditer(text):
        out += text[at : m.start()]
        origin += range(at, m.start())
        value = chr(int(m[1], 16)) if m[1] else chr(int(m[2], 8)) if m[2] else LETTERS.get(m[3], m[3])
        out.append(value)
        origin.append(m.start())
        at = m.end()
    out += text[at:]
    origin += [*range(at, len(text)), len(text)]
    kept = [i for i, c in enumerate(out) if c != "\0"]
    return "".join(out[i] for i in kept), [*(origin[i] for i in kept), origin[-1]]


def english(text: str, start: int = 0) -> list[tuple[str, int, int, bool]]:
    """(stem, start, length, symbol) of the humps of words in prose, without stop words."""
    plain, origin = unescaped(text)
    found = []
    for m in HUMP.finditer(plain):
        word = m[0].lower()
        if word not in STOP:
            begin = origin[m.start()]
            found.append((stem(word), start + begin, origin[m.end()] - begin, False))
    return found


TOKEN = re.compile(r"/\*.*?(?:\*/|$)|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|[^\W\d]\w*|\d[\w.]*|[-+*/%&|^<>=!]=|&&|\|\||\+\+|--|->|::|<<|>>|\S", re.DOTALL)


def tokenize(source: str) -> list[tuple[str, int, int, bool]]:
    """(text, start, length, symbol) of the tokens of a source file; comments, names and strings as prose."""
    found = []
    for m in TOKEN.finditer(source):
        piece = m[0]
        if piece.startswith(("/*", "//", '"', "'")) or piece[0].isalpha() or piece[0] in "_$":
            found += english(piece, m.start())
        else:
            found.append((piece, m.start(), len(piece), not re.search("[A-Za-z0-9]", piece)))
    return found
