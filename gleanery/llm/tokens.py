"""Public tokenizers inside tasks: ids of texts, and the bytes behind each id."""

from __future__ import annotations

import json

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

#: How byte-level files split a text before merging, a fixed value of that kind of tokenizer.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def public_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE from a file of the tokenizers library.

    Where merges are in the order of their ids, the rank form of the same vocabulary gives
    the same ids several times faster; other files, and texts that its regex engine gives
    up on (runs of hundreds of thousands of blanks), go through the library itself.
    ``special``: whether strings of special tokens inside a text become their ids.
    """

    def __init__(self, path: str, special: bool):
        self.path, self.special, self.slow = path, special, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = _byte_alphabet(), spec["model"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in word): i for word, i in model["vocab"].items() if word not in added}
        self.pieces: dict[int, bytes] = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in added.items()}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
        order = np.array([model["vocab"]["".join(x)] for x in pairs])
        plain = (spec["normalizer"] is None and spec["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not model["ignore_merges"] and all(len(s.split()) == 1 and not x["lstrip"] and not x["rstrip"] and not x["single_word"]
                                                   for s, x in zip(added, spec["added_tokens"])))
        self.fast = None
        if plain and np.all(np.diff(order) > 0):
            self.fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=added)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=())
            except ValueError:
                pass
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.special
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Pieces:
    """A SentencePiece model; ``pieces`` are the bytes of its ids, blanks for U+2581."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        named = [(i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.pieces: dict[int, bytes] = {
            i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in named}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), dtype=np.uint32)
