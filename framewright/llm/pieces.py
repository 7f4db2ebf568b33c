"""Pieces of texts between white space, each encoded once and looked up from then on."""

from __future__ import annotations

import json
import re
import string
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Pieces in a worker's cache.
CACHE = 600_000
SPACES = "[\t-\r \x85\xa0  -     　]+"
#: White space beyond ASCII, and the control characters at which Python splits too.
WIDE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
MARK = "S"


def byte_letters() -> dict[int, str]:
    """The usual printable letter of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Cutter:
    """How a tokenizer file cuts texts into words: normaliser, special strings, white
    space and pattern. It holds no vocabulary, so it is there at once."""

    def __init__(self, spec: dict) -> None:
        check_spec(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.white = re.compile(SPACES)
        self.words = regex.compile(pattern.replace(r"\s", SPACES[1:-2]), regex.V0)
        # the same pattern over the characters below 256, for Python's faster engine
        below = {k: "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == k) for k in "LN"}
        self.latin = re.compile(pattern.replace(r"\p{L}", below["L"]).replace(r"\p{N}", below["N"]).replace(r"\s", r"\t-\r \x85\xa0"))
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def lowered(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def split(self, text: str) -> list[str | int]:
        """The pieces between white space of a text after normalisation, and special ids
        where their strings stand. No word reaches across white space, so it need not be
        made uniform, and a piece has the same words wherever it stands."""
        found: list[str | int] = []
        for piece in self.specials.split(text) if self.specials and "<" in text else (text,):
            if piece in self.special:
                found.append(self.special[piece])
                continue
            piece = self.lowered(piece)
            # Python also splits at four control characters, which are no white space here
            odd = any(c in piece for c in "\x1c\x1d\x1e\x1f")
            found += filter(None, self.white.split(piece)) if odd else piece.split()
        return found

    def words_of(self, piece: str) -> list[str]:
        return (self.latin if latin(piece) else self.words).findall(piece)

    def lettered(self, word: str) -> str:
        """A word in byte letters; visible ASCII stands for itself."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)


class Pieces(Cutter):
    """The ids of each piece between white space, from those of its words, which
    :meth:`encoded` gives. A word is a piece too, so it is encoded once whatever stands
    around it.

    Pieces lie in an Arrow array, their ids one after another in ``flat``; the pieces of
    many texts are split and looked up at once, and only new ones become Python strings.
    Over ``most`` pieces, the half that was seen lately stays.
    """

    def __init__(self, spec: dict) -> None:
        super().__init__(spec)
        self.pieces = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint32)
        self.begins, self.sizes, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.calls = 0

    @property
    def most(self) -> int:
        return CACHE

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and how many each has."""
        raise NotImplementedError

    def encode(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and how many each has."""
        self.calls += 1
        if len(self.pieces) > self.most:
            self.keep(self.seen >= np.median(self.seen))
        end = "" if end_id is None else f" {MARK}{end_id}"
        split = pc.ascii_split_whitespace(pa.array([self.spaced(t) + end for t in texts], pa.string()))
        found = split.flatten().dictionary_encode()
        # white space at a border leaves an empty piece there, which has no ids
        number = self.number(found.dictionary)
        self.seen[number] = self.calls
        ids, ends = self.ids_at(number[found.indices.to_numpy()])
        return ids, np.diff(ends[split.offsets.to_numpy()])

    def ids_at(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces that stand there, and where each piece's begin in them,
        with the end."""
        sizes = self.sizes[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.begins[number] - ends[:-1], sizes)
        at += np.arange(len(at))
        return self.flat[at], ends

    def spaced(self, text: str) -> str:
        """A text after normalisation, its pieces between plain spaces; special ids are
        numbers after MARK, a capital that no other piece holds."""
        if text.isascii() and "<" not in text:
            return text.lower()
        if not ("<" in text or any(c in text for c in WIDE)):
            return self.lowered(text)
        return " ".join([p if type(p) is str else f"{MARK}{p}" for p in self.split(text)])

    def number(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand; new ones are encoded."""
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        if new.any():
            at[new] = self.learn(pieces.filter(pa.array(new)))
        return at

    def learn(self, fresh: pa.Array) -> np.ndarray:
        """Encode new words, then put together the pieces of several; where each stands."""
        parts = [self.words_of(p) for p in fresh.to_pylist()]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        words = pa.array(chain.from_iterable(parts), pa.string()).dictionary_encode()
        at = pc.index_in(words.dictionary, value_set=self.pieces)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[new] = len(self.pieces) + np.arange(int(new.sum()))
        unknown = words.dictionary.filter(pa.array(new))
        if len(unknown):
            self.add(unknown, *self.encoded(unknown))
        word = at[words.indices.to_numpy()]
        first = np.cumsum(counts) - counts
        single = counts == 1
        found = np.empty(len(parts), np.int64)
        found[single] = word[first[single]]
        if not single.all():
            found[~single] = len(self.pieces) + np.arange(int((~single).sum()))
            ids, ends = self.ids_at(word[np.repeat(~single, counts)])
            sizes = np.diff(ends[np.concatenate([[0], np.cumsum(counts[~single])])])
            self.add(fresh.filter(pa.array(~single)), ids, sizes)
        return found

    def add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32, copy=False)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.seen = np.concatenate([self.seen, np.full(len(sizes), self.calls)])

    def keep(self, stay: np.ndarray) -> None:
        self.pieces = self.pieces.filter(pa.array(stay))
        self.flat = self.flat[np.repeat(stay, self.sizes)]
        self.sizes, self.seen = self.sizes[stay], self.seen[stay]
        self.begins = np.cumsum(self.sizes) - self.sizes

    def words_of(self, piece: str) -> list[str]:
        core = piece.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or latin(core)):  # letters and the marks after them: no pattern needed
            return [core] if len(core) == len(piece) else [core, piece[len(core) :]]
        return [piece] if piece.startswith(MARK) else super().words_of(piece)


def spec_of(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def check_spec(spec: dict) -> None:
    """Refuse a tokenizer file that asks for anything else than what is done here."""
    normal = [{k: v for k, v in n.items() if k != "pattern"} | {"pattern": n.get("pattern", {}).get("Regex")} for n in (spec["normalizer"] or {}).get("normalizers", [])]
    expected = [{"type": "NFC", "pattern": None}, {"type": "Replace", "content": " ", "pattern": r"\s+"}, {"type": "Lowercase", "pattern": None}]
    kinds = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    added = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    split = kinds == ["Split", "ByteLevel"] and spec["pre_tokenizer"]["pretokenizers"][0]["invert"] and not spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"]
    starts = all(t["content"].startswith("<") for t in spec["added_tokens"])
    if normal != expected or not split or spec["decoder"] or spec["post_processor"] or model["type"] != "BPE" or not model["end_of_word_suffix"] or not plain or not added or not starts:
        raise ValueError("the tokenizer file has a normalizer, splitter, model or decoder of another kind")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
