"""The splitting rule and the vocabulary of a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import zlib

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 3, 1, 2, 0
#: Endings that the splitting rule of byte-level BPE cuts off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points of the White_Space property (fixed values).
WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Planes above this one hold no letters or numbers.
LAST_PLANE = 3


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """What tasks need of a tokenizer file, small enough to travel with them (about 1 MB).

    Code points that Python's Unicode tables do not know are put to the library itself.
    """
    from tokenizers import Tokenizer

    spec = json.load(open(path, encoding="utf-8"))
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
    kinds = np.zeros(0x110000, np.uint8)
    for cp in range((LAST_PLANE + 1) << 16):
        major = unicodedata.category(chr(cp))
        kinds[cp] = LETTER if major[0] == "L" else NUMBER if major[0] == "N" else OTHER
    kinds[list(WHITE)] = SPACE
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    for cp in range((LAST_PLANE + 1) << 16):
        if unicodedata.category(chr(cp)) == "Cn":
            if len(split("a" + chr(cp))) == 1:
                kinds[cp] = LETTER
            elif len(split("1" + chr(cp))) == 1:
                kinds[cp] = NUMBER
    # how each token was merged: (left, right) of its first merge rule
    ids = {t: i for t, i in spec["model"]["vocab"].items()}
    merges: dict[int, tuple[int, int]] = {}
    pairs: dict[tuple[int, int], int] = {}
    for rule in spec["model"]["merges"]:
        left, right = rule if isinstance(rule, list) else rule.split(" ")
        pairs[ids[left], ids[right]] = ids[left + right]
        merges.setdefault(ids[left + right], (ids[left], ids[right]))
    key = hashlib.sha256(json.dumps(spec["model"]).encode()).hexdigest()
    return {"key": key, "tokens": tokens, "special": special, "merges": merges, "pairs": pairs, "kinds": zlib.compress(kinds.tobytes(), 9)}


class Splitter:
    """Finds all pre-tokens of many texts at once, as flags over their code points."""

    def __init__(self, spec: dict):
        self.kinds = np.frombuffer(zlib.decompress(spec["kinds"]), np.uint8)

    def __call__(self, text: str, seams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pre-tokens in code points, and in bytes with the length of all bytes at the end.

        ``seams`` are the sorted starts of independent texts inside ``text`` (0 among them, unless empty).
        """
        cps = np.frombuffer(text.encode("utf-32-le"), "<u4")
        n = len(cps)
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        kind = self.kinds[cps]
        seam = np.zeros(n + 1, bool)
        seam[seams] = True
        seam[n] = True
        start = seam[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        white = kind == SPACE
        # the last white space before a word is a piece of its own or the word's first character
        before = np.zeros(n, bool)
        before[:-1] = white[:-1] & ~white[1:] & ~seam[1:n]
        start |= before
        joined = np.zeros(n, bool)
        joined[1:] = before[:-1] & (cps[:-1] == 32)
        start &= ~joined
        # apostrophe endings, only where a piece starts with the apostrophe
        for i in np.flatnonzero(start & (cps == 39)):
            i = int(i)
            for size in (1, 2):
                if i + size < n and not seam[i + 1 : i + 1 + size].any() and text[i + 1 : i + 1 + size] in ENDINGS:
                    start[i + 1] = False
                    if i + 1 + size < n and kind[i + 1 + size] == LETTER and not seam[i + 1 + size]:
                        start[i + 1 + size] = True
                    break
        at = np.flatnonzero(start)
        width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
        byte_at = np.zeros(n + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        return at, np.append(byte_at[at], byte_at[n])
