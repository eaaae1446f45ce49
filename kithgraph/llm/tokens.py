"""Byte-level BPE: the ids of a tokenizers file, by the faster merging of tiktoken where that gives the same.

It does where the file splits texts as byte-level BPE does by itself and its merges come
in the order of their ids, which makes the ids themselves the ranks; otherwise the
tokenizers library encodes. Texts are split at the file's special tokens first, and a long
text is encoded in parts, cut where a pretoken starts whatever stands before and behind.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import regex
import tiktoken

from kithgraph.llm.textbytes import texts_of

#: How byte-level BPE splits a text: an apostrophe's ending, a run of letters, of numbers or of others with one
#: blank before it, or white space without the last one before such a run. Fixed value, the pattern that is published with it.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters of a part of a long text.
PART = 1 << 20
#: Behind a letter or number that something else follows a pretoken starts.
_CUT = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as a letter: printable ones as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _ranked(file: dict) -> tiktoken.Encoding | None:
    """The file's merges as ranks, or None where it does more or other things."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if model["type"] != "BPE" or not usual or file.get("normalizer"):
        return None
    vocab, letters = model["vocab"], _byte_letters()
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if made != sorted(made) or len(made) + 256 > len(vocab):
        return None
    merged = {*made}
    try:
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if i in merged or len(t) == 1}
    except KeyError:
        return None
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about `size` characters whose ids make up the text's."""
    size = PART if size is None else size
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    if at < len(text) or not text:
        yield text[at:]


class Encoder:
    """Encodes texts with one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        added = file.get("added_tokens") or []
        # Tokens that stand for a text of their own wherever it occurs, each by itself.
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        self.ranked = _ranked(file) if plain else None
        self.special = {t["content"]: t["id"] for t in added}
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.library = None
        if self.ranked is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> Encoder:
        return Encoder(path)

    def ids(self, text: str) -> np.ndarray:
        if self.library is not None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) <= PART and not (self.at_special and self.at_special.search(text)):
            return np.array(self.ranked.encode_ordinary(text), np.uint32)
        found, at = [np.zeros(0, np.uint32)], 0
        for mark in [*(self.at_special.finditer(text) if self.at_special else ()), None]:
            between = text[at : mark.start() if mark else len(text)]
            found += [np.array(self.ranked.encode_ordinary(p), np.uint32) for p in parts(between)]
            if mark:
                found.append(np.array([self.special[mark.group()]], np.uint32))
                at = mark.end()
        return np.concatenate(found)

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of UTF-8, end_id after each, and the bounds of the rows among them."""
        end = np.array([end_id], np.uint32)
        each = [x for text in texts_of(data, offsets) for x in (self.ids(text.decode("utf-8")), end)]
        sizes = np.fromiter(map(len, each[::2]), np.int64, len(each) // 2) + 1
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
