"""Token ids of whole texts, by a cache of the ids of the pre-tokenizer's parts, or of stretches between plain spaces and line feeds."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

from quantframe.llm.common import Recent

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core; a call with one text needs no threads
#: Steps before the model with which a text's ids are those of its stretches, one after the other, and PARTS holds.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
    "post_processor": None,
}
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
MARK = rf"[^{LETTERS}{DIGITS}\t-\r \x85\xA0]"
#: The pre-tokenizer's parts of a plain text, and the same with a comma left at its word if no mark follows it.
PARTS, WORDS = (re.compile(rf" ?([{LETTERS}]+{comma}|'(?i:s|t|re|ve|m|ll|d)|[{DIGITS}]|{MARK}+)") for comma in ("", f"(?:,(?!{MARK}))?"))
BYTE_LEVEL = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
LEVEL = str.maketrans({chr(c): BYTE_LEVEL.pre_tokenize_str(chr(c))[0][0] for c in range(256)})
CACHED = 450_000


def plain(text: str) -> bool:
    """Whether PARTS holds for it: Latin-1 is the same in NFC, and special tokens begin with <."""
    if "<" in text:
        return False
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokens:
    """ids(text): the ids of Tokenizer.encode(text, add_special_tokens=False), as little-endian unsigned 32-bit bytes.

    For a tokenizer with STEPS, each of its parts has ids of its own, which come from its model without the steps before
    it and are kept, so that words in capitals or with marks around them cost no more than putting parts together. A text
    that isn't plain is cut into stretches between plain spaces or line feeds, which are tokenised one by one and kept as
    well: by their parts, or by themselves where they aren't plain. The cache holds about CACHED parts, words and
    stretches, the last used ones, which bounds the memory that a worker keeps from task to task. With any other
    tokenizer, whole texts are encoded.
    """

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = [t for t in spec.get("added_tokens", []) if t["normalized"] or not t["content"].startswith("<") or re.search(r"\s", t["content"]) or t["single_word"] or t["lstrip"] or t["rstrip"]]
        self.by_parts = not special and all(spec.get(k) == v for k, v in STEPS.items())
        self.known = Recent(CACHED)  # parts, words and stretches; a part has the same ids as a stretch

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        """The ids of a lower-case part, which are those of the model."""
        known = self.known
        data = known.get(part)
        if data is None:
            data = known.before.get(part)
            if data is None:
                data = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part if part.isascii() and part.isprintable() else part.translate(LEVEL))])
            known[part] = data
        return data

    def learn(self, words: list[str]) -> None:
        known = self.known
        known.trim()
        before = known.before
        for w in words:
            data = before.get(w)
            if data is None:
                if w.isalpha() and w.isascii():
                    data = self.part(w.lower())
                elif plain(w):
                    data = b"".join(map(self.part, PARTS.findall(w.lower())))
                else:
                    data = self.encoded(w)
            known[w] = data

    def ids(self, text: str) -> bytes:
        if not self.by_parts:
            return self.encoded(text)
        words = WORDS.findall(text) if plain(text) else text.replace("\n", " ").split(" ")
        known = self.known
        found = list(map(known.get, words))
        try:
            return b"".join(found)
        except TypeError:  # at least one is None
            self.learn([w for w, data in zip(words, found) if data is None])
            return b"".join([known[w] if data is None else data for w, data in zip(words, found)])


_made: dict[str | None, WordTokens] = {}


def word_tokens(path: str | None = None) -> WordTokens:
    """One tokenizer and cache for each Python worker, which Spark uses for many tasks."""
    if path not in _made:
        _made[path] = WordTokens(path)
    return _made[path]
