"""Splitting texts into the words that byte-pair merges stay within, exactly as the public tokenizers do.

Texts of Latin letters take a fast expression of the standard library.  Any other text goes through the tokenizer
library's own normaliser and pre-tokeniser, so letters of every script and Unicode version agree with it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters on whose classes, normal forms and lower case all Unicode versions agree.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-ſ‐-‧‰-⁞€]*")
_BYTE_LEVEL = re.compile(rf"{_ENDS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = re.compile(rf"{_ENDS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def letter_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


def spelled(word: str) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in word.encode("utf-8", "replace")])


def unspelled(letters: str) -> str:
    table = letter_bytes()
    return bytes([table[c] for c in letters]).decode("utf-8", "replace")


class Splitter:
    """Words of a text, with the special strings of the tokenizer between them.

    ``parts(text)`` gives lists of words and, between them, special ids as integers.
    """

    def __init__(self, tokenizer, specials: dict[str, int], fast: re.Pattern, lower: bool):
        self._normalizer, self._pre = tokenizer.normalizer, tokenizer.pre_tokenizer
        self._specials = specials
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self._find, self._lower = fast.findall, lower

    def plain(self, text: str) -> bool:
        """Whether all characters are ones on which every implementation agrees, and no special string stands there."""
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self._specials)

    def words(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return self._find(text.lower() if self._lower else text)
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        return [unspelled(w) for w, _ in self._pre.pre_tokenize_str(text)]

    def parts(self, text: str) -> list[list[str] | int]:
        if self._cut is None or not any(s in text for s in self._specials):
            return [self.words(text)]
        return [self._specials[p] if p in self._specials else self.words(p) for p in self._cut.split(text) if p]


def rank_encoder(tokenizer, spec: dict):
    """A function from plain texts to ids that merges by ranks, or None where that could differ from the library.

    A merge by ranks joins any two neighbours that make up an entry, the entry of the least id first.  That equals the
    library's merging by listed pairs if (1) ids follow the order of the merges and (2) the library gives each entry as
    that entry alone: neighbours that make up an entry then stand where the library's own merging of the entry's
    letters would have them, and the pair it has at that point is the listed one.  Both are checked on the whole
    vocabulary here.  Only texts that ``Splitter`` would split by its own expression may be passed.
    """
    import tiktoken

    vocab, merges = spec["model"]["vocab"], [m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"]]
    letters = letter_bytes()
    spelled_all = all(c in letters for token in vocab for c in token)
    in_order = len(vocab) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    model = tokenizer.model
    if not (spelled_all and in_order and all([t.id for t in model.tokenize(token)] == [i] for token, i in vocab.items())):
        return None
    ranks = {bytes([letters[c] for c in token]): i for token, i in vocab.items()}
    pattern = rf"(?:{_ENDS})| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def load(path: str) -> tuple[object, dict, Callable[[], Splitter]]:
    """A tokenizer file: the library's tokenizer, its JSON, and a maker of its splitter."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    word_ends = spec["model"].get("end_of_word_suffix")
    return tokenizer, spec, lambda: Splitter(tokenizer, specials, _WORD_LEVEL if word_ends else _BYTE_LEVEL, bool(word_ends))
