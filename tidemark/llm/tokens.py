"""Token ids of whole texts by files of public tokenizers, and the bytes of each id."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

#: Characters encoded at once.
CHARS_AT_ONCE = 400_000

# The pre-tokenizer's pattern, as the tokenizer's library has it (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes no two versions of Unicode see differently: Latin, Greek, Cyrillic, punctuation, kana, ideographs, Hangul.
_SETTLED = re.compile("[\x00-ɏΑ-ΡΣ-ωА-я‐-‧、-〃ぁ-ゔァ-ヺ一-龥가-힣]*")


def batches(texts: Iterable[str], most: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Texts in lists of about ``most`` characters; a longer text is alone."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > most:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """A byte-level BPE tokenizer file. ``special``: strings of added tokens inside texts are these tokens, else plain text.

    ``library`` reads the file and could encode every text. Where merges follow the ids, merging by rank gives the same ids several times faster; it
    is used for texts of settled characters without strings of added tokens. Tests hold it against the library.
    """

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocab = _byte_of(), spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in vocab.items():
            if token not in added:
                self.bytes_of[i] = bytes(byte[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.names = re.compile("|".join(map(re.escape, added))) if added and special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        pre = spec["pre_tokenizer"] or {}
        usual = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.quick = None
        if usual and order == sorted(order):
            self.quick = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks={self.bytes_of[i]: i for t, i in vocab.items() if t not in added}, special_tokens={})

    def encode_plainly(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        quick = [self.quick is not None and _SETTLED.fullmatch(t) is not None and not (self.names and self.names.search(t)) for t in texts]
        other = iter(self.encode_plainly([t for t, ok in zip(texts, quick, strict=True) if not ok]))
        return [self.quick.encode_ordinary(t) if ok else next(other) for t, ok in zip(texts, quick, strict=True)]


class PieceTokens:
    """A SentencePiece model file; the library puts a space in front of a text."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        ids = range(self.library.get_piece_size())
        self.bytes_of = [bytes([int(self.library.id_to_piece(i)[3:-1], 16)]) if self.library.is_byte(i) else self.library.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1) if texts else []
