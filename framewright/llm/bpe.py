"""Byte-pair encoding by speculation and verification, and decoding.

Greedy longest match proposes the tokens of each distinct word. A proposal is the
encoding exactly when every adjacent pair of its tokens is compatible, that is, when
no merge would have joined across their border before the tokens themselves were
made. All new words of a batch walk through the trie of tokens at once in numpy, as do
those checks over all distinct adjacent pairs; words with an incompatible pair are
merged exactly, a step in each word at a time. Runs of letters over LONG are stepped
through by the same checks, token by token: each time the longest token that is
compatible with the one before, stepping back where none is. A sequence whose pairs are
all compatible is the encoding, so all give the same, and the last takes time in
proportion to the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, tokenizer_path
from .pieces import MARK, Pieces, spec_of

#: Bytes from which a word is stepped through.
LONG = 64
NEVER = np.int64(1) << 40
#: The symbol after a word's last byte, and checked pairs that a worker keeps.
END, PAIRS = 256, 1_000_000
_loaded: dict[str, Vocabulary] = {}


class Vocabulary(Pieces):
    """A byte-level BPE vocabulary with a word-end mark, from a tokenizer file.

    Words are strings of byte letters; ``mid`` are tokens inside a word and ``last``
    those that carry the mark. Every token has its rank (the merge that makes it, or
    -1), and the chains of parts along its left and right border.
    """

    def __init__(self, path: str) -> None:
        spec = spec_of(path)
        super().__init__(spec)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): (k, self.ids[a + b]) for k, (a, b) in reversed([*enumerate(merges)]) if a in self.ids and b in self.ids and a + b in self.ids}
        size = max(self.names) + 1
        self.rank = np.full(size, -1, np.int64)
        self.part = np.full((2, size), -1, np.int64)
        for (a, b), (k, whole) in self.ranks.items():
            if self.rank[whole] < 0 or k < self.rank[whole]:
                self.rank[whole] = k
                self.part[:, whole] = a, b
        self.keys = np.sort(np.fromiter((a << 32 | b for a, b in self.ranks), np.int64, len(self.ranks)))
        self.key_rank = np.array([self.ranks[k >> 32, k & 0xFFFFFFFF][0] for k in self.keys.tolist()] or [0], np.int64)
        self.key_whole = np.array([self.ranks[k >> 32, k & 0xFFFFFFFF][1] for k in self.keys.tolist()] or [0], np.int64)
        self.mid, self.last = {}, {}
        bodies = [name.removesuffix(self.mark) for name in self.ids]
        merged = self.merged_lists([self.symbols(body, name != body) for name, body in zip(self.ids, bodies, strict=True)])
        for (name, i), body, found in zip(self.ids.items(), bodies, merged, strict=True):
            if body and found == [i]:
                (self.last if name != body else self.mid)[body] = i
        self.border = [self.chains(side, size) for side in (1, 0)]
        self.sure: dict[int, bool] = {}
        self.chained: tuple[dict, dict] = {}, {}
        #: Letters of the longest token that begins with these two.
        self.reach: dict[str, int] = {}
        for name in chain(self.mid, self.last):
            self.reach[name[:2]] = max(self.reach.get(name[:2], 0), len(name))
        #: Every id's number and name, each with a space after it.
        self.numbers = pa.array([f"{i} " for i in range(size)], pa.large_string())
        self.spelled = pa.array([f"{self.names.get(i, '')} " for i in range(size)], pa.large_string())
        self.known = np.zeros(size, bool)
        self.known[[*self.names]] = True
        self.letter = np.array([[self.ids.get(self.letters[b] + mark, -1) for b in range(256)] for mark in ("", self.mark)])
        self.edges, self.follows, self.token = self.tree()
        #: Pairs checked by :meth:`compatible` and what it said.
        self.pairs, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The trie of all tokens by their bytes, marked ones with END behind: its edges,
        node above symbol, in order, the node each leads to, and the token that ends in
        each node, or -1."""
        byte = {letter: b for b, letter in self.letters.items()}
        node: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for names, tail in ((self.mid, []), (self.last, [END])):
            for name, i in names.items():
                if not byte.keys() >= {*name}:  # no text has these letters
                    continue
                at = 0
                for b in [*map(byte.__getitem__, name), *tail]:
                    at = node.setdefault((at, b), len(node) + 1)
                ends[at] = i
        edges = np.array([(a << 9 | b, to) for (a, b), to in node.items()] or [(-1, 0)], np.int32)
        edges = edges[np.argsort(edges[:, 0])]
        token = np.full(len(node) + 1, -1, np.int32)
        token[[*ends]] = [*ends.values()]
        return edges[:, 0].copy(), edges[:, 1].copy(), token

    def symbols(self, word: str, marked: bool = True) -> list[int]:
        """The single-letter tokens of a word, the last with the word-end mark."""
        units = [*word]
        if marked and units:
            units[-1] += self.mark
        return [self.ids[u] for u in units if u in self.ids]

    def merged(self, units: list[int]) -> list[int]:
        """Exact merging: the lowest-ranked adjacent pair first, the leftmost of equals."""
        while len(units) > 1:
            best = min(((self.ranks[p], i) for i, p in enumerate(zip(units, units[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            (rank, whole), _ = best
            out, i = [], 0
            while i < len(units):
                if i + 1 < len(units) and self.ranks.get((units[i], units[i + 1]), (-1,))[0] == rank:
                    out.append(whole)
                    i += 2
                else:
                    out.append(units[i])
                    i += 1
            units = out
        return units

    def merged_many(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words at once."""
        return self.merged_lists([self.symbols(w) for w in words])

    def merged_lists(self, units: list[list[int]]) -> list[list[int]]:
        counts = [len(u) for u in units]
        flat, owner = self.merge(np.fromiter(chain.from_iterable(units), np.int64, sum(counts)), np.repeat(np.arange(len(units)), counts))
        ends = np.searchsorted(owner, np.arange(len(units) + 1)).tolist()
        flat = flat.tolist()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the merge of each left and right token; NEVER without one."""
        if not len(self.keys):
            return np.full(len(left), NEVER), left
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER), self.key_whole[at]

    def merge(self, flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the letters of many words, the word of each in ascending ``owner``: each
        round does, in every word, its lowest-ranked adjacent pair, wherever it stands,
        from the left. Only pairs beside a merge are looked up again."""
        done = []

        def look(at: np.ndarray) -> None:
            rank[-1:] = NEVER
            at = at[(at >= 0) & (at < len(flat) - 1)]
            rank[at], whole[at] = self.joined(flat[at], flat[at + 1])
            rank[at[owner[at] != owner[at + 1]]] = NEVER

        flat, rank, whole = flat.copy(), np.full(len(flat), NEVER), flat.copy()
        look(np.arange(len(flat)))
        while len(flat):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(flat))))
            left = lowest < NEVER
            done.append((flat[~left], owner[~left]))
            hit = (rank == lowest) & left
            if (hit[1:] & hit[:-1]).any():
                # in a run of hits next to each other (a a a) every other one counts
                run_start = hit & ~np.concatenate([[False], hit[:-1]])
                place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run_start, np.arange(len(hit)), 0))
                hit &= place % 2 == 0
            where = np.flatnonzero(hit)
            flat[where] = whole[where]
            left[where + 1] = False
            where = np.cumsum(left)[where] - 1
            flat, owner, rank, whole = flat[left], owner[left], rank[left], whole[left]
            look(where)
            look(where - 1)
        if not done:
            return flat, owner
        flat, owner = (np.concatenate(parts) for parts in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        return flat[order], owner[order]

    def chains(self, side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token, the parts along one border from the token down to a letter,
        and the rank of the merge that ends each part (NEVER for the token itself)."""
        parts, ends = [np.arange(size)], [np.full(size, NEVER)]
        while True:
            part = np.where(parts[-1] >= 0, self.part[side][parts[-1]], -1)
            if (part < 0).all():
                return np.stack(parts, 1), np.stack(ends, 1)
            ends.append(np.where(part >= 0, self.rank[parts[-1]], -1))
            parts.append(part)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each left token, followed by its right token, stays as it is.

        Parts x of the left one's right border and y of the right one's left border
        meet while both exist. A merge of (x, y) breaks the pair if it comes before
        the merge that ends x and no later than the one that ends y, for of equal
        merges the leftmost is done first.
        """
        good = np.ones(len(left), bool)
        (lx, le), (ry, re_) = self.border
        for i in range(lx.shape[1]):
            x, ends_x = lx[left, i], le[left, i]
            here = np.flatnonzero((x >= 0) & good)
            if not len(here):
                break
            for j in range(ry.shape[1]):
                y, ends_y = ry[right[here], j], re_[right[here], j]
                on = y >= 0
                if not on.any():
                    break
                key = x[here] << 32 | np.where(on, y, 0)
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(on & (self.keys[at] == key), self.key_rank[at], NEVER) if len(self.keys) else np.full(len(here), NEVER)
                good[here[(rank < ends_x[here]) & (rank <= ends_y) & (rank < NEVER)]] = False
        return good

    def compatible_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """What :meth:`compatible` says of distinct pairs, left token above right one."""
        if len(self.pairs) > PAIRS:
            self.pairs, self.good = self.pairs[:0], self.good[:0]
        new = pairs[~np.isin(pairs, self.pairs, assume_unique=True)]
        if len(new):
            every = np.concatenate([self.pairs, new])
            order = np.argsort(every, kind="stable")
            good = np.concatenate([self.good, self.compatible(new >> 32, new & 0xFFFFFFFF)])
            self.pairs, self.good = every[order], good[order]
        return self.good[np.searchsorted(self.pairs, pairs)]

    def greedy(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest token at each place of many words, with END at ``ends``; the last
        one carries the mark: all tokens, the word of each, and the words without such."""
        tokens, owners, failed = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        word, at, ends = np.arange(len(begins)), begins.copy(), ends.copy()
        node = np.zeros(len(word), np.int32)
        best, after = np.full(len(word), -1, np.int32), at.copy()
        while len(word):
            edge = node << 9 | symbols[at]
            place = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            on = self.edges[place] == edge
            node = self.follows[place]
            at += 1
            token = self.token[node]
            longer = np.flatnonzero(on & (token >= 0) & (at != ends))
            best[longer], after[longer] = token[longer], at[longer]
            stop = np.flatnonzero(~on | (at > ends))
            if len(stop):
                found = stop[best[stop] >= 0]
                tokens.append(best[found])
                owners.append(word[found])
                failed.append(word[stop[best[stop] < 0]])
                at[stop], node[stop] = after[stop], 0
                left = np.ones(len(word), bool)
                left[stop[(best[stop] < 0) | (after[stop] > ends[stop])]] = False
                best[stop] = -1
                if not left.all():
                    word, at, ends, node, best, after = (x[left] for x in (word, at, ends, node, best, after))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[order].astype(np.int64), owner[order], np.concatenate(failed)

    def fits(self, left: int, right: int) -> bool:
        """Whether one pair of tokens is compatible, as :meth:`compatible` has it."""
        pair = left << 32 | right
        found = self.sure.get(pair)
        if found is None:
            (lx, le), (ry, re_) = self.border
            sides = []
            for token, parts, ends, known in ((left, lx, le, self.chained[0]), (right, ry, re_, self.chained[1])):
                if token not in known:
                    known[token] = [(x, e) for x, e in zip(parts[token].tolist(), ends[token].tolist(), strict=True) if x >= 0]
                sides.append(known[token])
            found = True
            for x, ends_x in sides[0]:
                for y, ends_y in sides[1]:
                    merge = self.ranks.get((x, y))
                    if merge is not None and merge[0] < ends_x and merge[0] <= ends_y:
                        found = False
            self.sure[pair] = found
        return found

    def stepped(self, word: str) -> list[int] | None:
        """The encoding by longest compatible tokens, stepping back where none is. A place
        that was stepped back from is never tried again."""
        found, sizes, at, n = [], [], 0, len(word)
        closed, most, mid, last, fits = set(), n, self.mid, self.last, self.fits
        while at < n:
            for size in range(min(most, self.reach.get(word[at : at + 2], 1), n - at), 0, -1):
                token = (last if at + size == n else mid).get(word[at : at + size])
                if token is not None and at + size not in closed and (not found or fits(found[-1], token)):
                    found.append(token)
                    sizes.append(size)
                    at, most = at + size, n
                    break
            else:
                if not found:
                    return None
                closed.add(at)
                found.pop()
                most = sizes.pop() - 1
                at -= most + 1
        return found

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        sizes = np.diff(offsets)
        special = data[offsets[:-1]] == ord(MARK)
        alone = {i: [int(words[i].as_py()[1:])] for i in np.flatnonzero(special).tolist()}
        if len(self.sure) > PAIRS:
            self.sure = {}
        for i in np.flatnonzero(~special & (sizes > LONG)).tolist():
            ids = self.stepped(self.lettered(words[i].as_py()))
            if ids is not None:
                alone[i] = ids
        # the bytes of all words, each with END behind
        begins = offsets[:-1] + np.arange(len(words))
        symbols = np.full(len(data) + len(words), END, np.int16)
        symbols[np.arange(len(data)) + np.repeat(np.arange(len(words)), sizes)] = data
        todo = np.ones(len(words), bool)
        todo[[*alone]] = False
        todo = np.flatnonzero(todo)
        flat, owner, failed = self.greedy(symbols, begins[todo], (begins + sizes)[todo])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        distinct, where = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        bad = np.zeros(len(todo), bool)
        bad[failed] = bad[owner[inner[~self.compatible_pairs(distinct)[where]]]] = True
        good = ~bad[owner]
        parts = [(flat[good], todo[owner[good]]), self.merge(*self.units(data, offsets, todo[bad]))]
        if alone:
            parts.append((np.array([*chain.from_iterable(alone.values())], np.int64), np.repeat([*alone], [len(ids) for ids in alone.values()])))
        flat, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
        return flat[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def units(self, data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`symbols` gives for these words, and the word of each letter."""
        sizes = np.diff(offsets)[words]
        ends = np.cumsum(sizes)
        units = self.letter[0][data[np.arange(int(sizes.sum())) + np.repeat(offsets[words] - ends + sizes, sizes)]]
        units[ends - 1] = self.letter[1][data[offsets[words + 1] - 1]]
        owner = np.repeat(words, sizes)
        return units[units >= 0], owner[units >= 0]

    def ids_of(self, text: str) -> list[int]:
        return self.encode([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Token names joined by spaces, special ones kept: what a tokenizer file
        without a decoder gives. Unknown ids are left out."""
        return str(self.decoded(np.array([-1 if i is None else i for i in ids], np.int64), np.array([len(ids)]))[0], "utf-8")

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
        """The texts, in UTF-8, of rows of ids that stand one after another."""
        known = (ids >= 0) & (ids < len(self.known))
        known[known] = self.known[ids[known]]
        if not known.all():
            sizes = np.diff(np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(sizes)])])
        return spelled(self.spelled, ids[known], sizes)


def spelled(entries: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> list[memoryview]:
    """The entries of each row's ids one after another, without the space at the end."""
    found = entries.take(pa.array(ids))
    ends = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1, 8 * found.offset)[np.concatenate([[0], np.cumsum(sizes)])].tolist()
    data = memoryview(found.buffers()[2] or b"")
    return [data[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def groups(texts: list[str], most: int = 8 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def digests(texts: list[str], path: str) -> tuple[list[int], list[str], list[str]]:
    """Number of ids, digest of the ids and digest of the text decoded from them."""
    vocab = vocabulary(path)
    counts, of_ids, of_text = [], [], []
    for group in groups(texts):
        ids, sizes = vocab.encode(group)
        counts += sizes.tolist()
        of_ids += [hashlib.sha256(x).hexdigest() for x in spelled(vocab.numbers, ids, sizes)]
        of_text += [hashlib.sha256(x).hexdigest() for x in vocab.decoded(ids, sizes)]
    return counts, of_ids, of_text


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each whole text, one row for each input row.

    A null or empty text has no ids; strings of special tokens in a text become their
    ids. Texts of any length, and words of any length in them, are encoded whole.
    Repeated rows give repeated results, an empty table an empty one; other columns are
    ignored, whatever their names.
    """
    path = tokenizer_path(tokenizer)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for texts in batches:
            parts = [vocab.encode(group) for group in groups([t or "" for t in texts.to_pylist()])]
            ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids.astype(np.int32)))

    return docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(encode, "array<int>")(text_or_empty(text_col)).alias("ids"))


def decode_documents(encoded: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the decoded text of each row of ids; null ids give an empty text."""
    path = tokenizer_path(tokenizer)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        for ids in batches:
            flat, sizes = ids.flatten().fill_null(-1), ids.value_lengths().fill_null(0)
            yield pa.array([str(t, "utf-8") for t in vocab.decoded(flat.to_numpy(), sizes.to_numpy())], pa.string())

    return encoded.select(F.col(id_col).alias("doc_id"), F.arrow_udf(decode, "string")(F.col(ids_col)).alias("text"))


def encode_digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for each input row:
    what :func:`encode_documents` and :func:`decode_documents` give, digested where it
    is made: the decoded text is made from the ids. A null or empty text has no ids and
    an empty decoded text; repeated rows, an empty table and other columns are treated
    as there."""
    path = tokenizer_path(tokenizer)

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, of_ids, of_text = digests([t or "" for t in texts.to_pylist()], path)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.select("doc_id", F.arrow_udf(digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")("text").alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")
