"""Vocabulary files of public tokenizers, read once per process, and the pieces texts fall into.

``path`` is a file name under the installed vocabularies or any path that every executor has.
"""

import json
import os
import re
from functools import lru_cache

import regex

from leadloom.llm.spans import text_column

#: The patterns by which the two tokenizers cut text before merging.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Unicode white space; the separators 0x1C-0x1F that Python adds are not among it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Cut so that no piece of BYTE_PATTERN crosses a cut: a word with the space before it, or white space.
UNITS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
BARE_UNITS = re.compile(rf"[^{WHITE}]+")
_UNEVEN = re.compile(rf"[{WHITE.replace(' ', '')}]|  |^ | $")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def place(path):
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@lru_cache(maxsize=None)
def byte_letters():
    """The visible character that stands for each byte in vocabulary files: printable Latin-1
    characters stand for themselves, the others for 256 and up, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else extra))
        extra += byte not in shown
    return letters


@lru_cache(maxsize=None)
def to_letters():
    """A table for str.translate, from Latin-1 decoded bytes to their letters."""
    return dict(enumerate(byte_letters()))


class Vocabulary:
    """Ids by token, merges and special strings of a tokenizer file. Symbols are the tokens' ids."""

    def __init__(self, path):
        with open(place(path), encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.ids = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[left] << 32 | self.ids[right]] = rank
            self.made.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.bytes = [self.ids[c] for c in byte_letters()]
        self.last_bytes = [self.ids[c + self.end] for c in byte_letters()]

    def symbols(self, piece):
        """The symbols merging starts from: one for each byte, the last one marked as an end."""
        raw = piece.encode()
        found = list(map(self.bytes.__getitem__, raw))
        if raw:
            found[-1] = self.last_bytes[raw[-1]]
        return found


@lru_cache(maxsize=None)
def vocabulary(path):
    return Vocabulary(path)


byte_pieces = regex.compile(BYTE_PATTERN).findall
word_pieces = regex.compile(WORD_PATTERN).findall


def units(text):
    """A text as words with the single space before them, and white space in between."""
    if _UNEVEN.search(text) is None:
        first, *rest = text.split(" ")
        return [first, *[" " + word for word in rest]] if first else []
    return UNITS.findall(text)


def bare_units(text):
    """The words between white space."""
    return BARE_UNITS.findall(text) if _SEPARATORS.search(text) else text.split()


class Memory(dict):
    """Results by key, found when first asked for; emptied when it holds ``limit`` of them."""

    def __init__(self, find, limit=1 << 18):
        super().__init__()
        self.find, self.limit = find, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.find(key)
        return value


def strings(column, size=1 << 22):
    """Runs of consecutive texts of an Arrow column as str, about ``size`` bytes at a time."""
    from leadloom.llm.spans import slices

    data, offsets = text_column(column)
    for first, part, places in slices(data, offsets, size):
        whole = part.tobytes()
        yield first, [whole[a:b].decode("utf-8", "replace") for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
