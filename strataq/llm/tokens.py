"""Token ids by a byte-level BPE file of the ``tokenizers`` library.

The file's vocabulary and pattern are given to ``tiktoken``, which yields the same ids in a fraction of the time (tests
hold the two against each other). Blanks without end are beyond its pattern engine: runs of ``BLANKS`` or more are cut out by
the pattern's own rule and given to ``tokenizers``. A file that asks for anything else than what is built here is refused.
The file's added tokens are taken out of a text first, as that library does, and have
their own ids, with ``ordinary=False``; ``ordinary=True`` leaves their strings as ordinary text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Fixed value: the pre-token pattern of byte-level BPE files that ask for ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the blanks of that pattern (Unicode's White_Space).
_BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Blanks in a row from which they are cut out.
BLANKS = 10_000
#: What a file must ask for: pre-tokens by the pattern over bytes, pairs merged in order of their ids, nothing else.
_PRE_TOKENS = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def _refuse_others(file: dict) -> None:
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    odd = [k for k, v in _PRE_TOKENS.items() if pre.get(k) != v] + [k for k, v in _MODEL.items() if (model.get(k) or None) != (v or None)] + [k for k in ("normalizer", "truncation") if file.get(k)]
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if odd or None in made or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError(f"not a byte-level file as built here: {odd or 'merges are not in order of ids'}")


def _byte_of() -> dict[str, int]:
    """Byte-level files write bytes as printable characters: those that are printable as themselves, the others in
    order as the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids and counts of texts."""

    def __init__(self, path: str, *, ordinary: bool = True) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        _refuse_others(file)
        self.path, self._library = path, None
        self.blanks = re.compile(_BLANK + "{%d,}" % BLANKS)
        special = {t["content"] for t in file["added_tokens"] if t["special"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = {} if ordinary else {t["content"]: t["id"] for t in file["added_tokens"]}
        if odd := [t for t in file["added_tokens"] if t["content"] in self.added and (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]))]:
            raise ValueError(f"added tokens that depend on what stands beside them, or hold blanks: {odd}")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if len(text) < BLANKS:
            return self.bpe.encode_ordinary(text)
        out, at = [], 0
        for m in self.blanks.finditer(text):
            # the last blank goes with what follows; at the end all go together
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.bpe.encode_ordinary(text[at : m.start()]) + self._of_blanks(text[m.start() : end])
            at = end
        return out + self.bpe.encode_ordinary(text[at:]) if at else self.bpe.encode_ordinary(text)

    def _of_blanks(self, run: str) -> list[int]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library.encode(run, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.split is None or not self.split.search(text):
            return self._plain(text)
        # every second part is an added token
        return [i for k, x in enumerate(self.split.split(text)) for i in ([self.added[x]] if k % 2 else self._plain(x))]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, uint16 (vocabularies up to 65,536)."""
        return np.array(self.ids(text), np.uint16)

    def count(self, text: str) -> int:
        return len(self.ids(text))
