"""Word splits of the public tokenizers and a direct way to encode single words."""

from __future__ import annotations

import functools
import re

from tokenizers import Tokenizer

#: Characters for which one lower-casing, NFC and white-space rule holds in all libraries.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xff]*\Z")
#: Letters, numbers and white space among the plain characters.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r" \t-\r"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def specials(tok: Tokenizer) -> tuple[dict[str, int], re.Pattern]:
    """The special tokens' ids, and a pattern that cuts a text at them."""
    ids = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    return ids, re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next of U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


def word_ids(tok: Tokenizer, word: str) -> list[int]:
    """Ids of one word that the tokenizer's split would keep whole: its merges only."""
    letters = word.encode().decode("latin-1").translate(LETTERS)
    return [t.id for t in tok.model.tokenize(letters)]
