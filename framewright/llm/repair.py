"""Token-id files compressed by Re-Pair grammars.

A shard's ids are rewritten by rules: a frequent pair of neighbours becomes a
nonterminal, again and again until no pair stands often enough to pay for its rule,
never across the end of a document. Where two frequent pairs overlap, the one that
stands more often is replaced first. The file holds the rules, how many ids every
nonterminal expands to, the rewritten sequence, and where each document starts in it
and in the ids, so a document is read and expanded alone.

File layout (little-endian): MAGIC; six uint32: documents, those of them without an id
(they come first), rules, symbols, first nonterminal, crc32 of all that follows; then
int64 document ids; uint32 first symbol and uint32 first id of each document, with a
closing entry each; uint32 left and right of each rule; uint32 expansion length of each
rule; the sequence, its symbols in as few bytes each (2, 3 or 4) as hold them.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import saved, scratch, text_or_empty, tokenizer_path
from .pieces import MARK, Pieces, spec_of

MAGIC = b"RPIDS002"
#: Ids in a shard at least (a document is never split), and replacements from which a
#: rule of 12 bytes pays with symbols of 3 bytes.
SHARD_IDS, LEAST = 1 << 20, 5
#: Symbols that one call of a reader expands at most, but for a longer document.
READ_SYMBOLS = 1 << 16
#: Ids that a rule may stand for and still be expanded beforehand, once for its file.
SHORT = 32
#: Pieces in each of two generations of a worker's cache: about 200 bytes each.
CACHE = 600_000
#: Texts that are encoded at once, in characters.
AT_ONCE = 8 << 20
_PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]
_models: dict[str, object] = {}


@dataclass
class Grammar:
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray  # ids that each rule expands to
    first: int  # the first nonterminal
    sequence: np.ndarray
    starts: np.ndarray  # first symbol of each document, and the end

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol expands to."""
        out = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        out[rule] = self.length[symbols[rule] - self.first]
        return out

    @cached_property
    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules of up to SHORT, one after another, and where each rule's
        begin (-1 for longer ones)."""
        rule = np.flatnonzero(self.length <= SHORT)
        at = np.cumsum(self.length[rule]) - self.length[rule]
        begins = np.full(len(self.length), -1)
        begins[rule] = at
        ids = np.empty(int(self.length[rule].sum()), np.uint32)
        put(ids, rule + self.first, at, self, ids, np.full(len(begins), -1))
        return ids, begins


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> Grammar:
    """Re-Pair in rounds over a linked list of the symbols.

    A round counts the pairs that may stand ``least`` times: all at first, then those
    that did in the round before and those beside a replacement, for other pairs can
    only have become fewer. It replaces each pair where no neighbour that overlaps it
    stands more often (in a run of equally frequent ones, every other), unless that
    makes fewer than ``least`` replacements. Rounds end when none replaces anything.
    """
    n = len(ids)
    first = int(ids.max()) + 1 if n else 0
    sequence = ids.astype(np.int64)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[starts[1:][np.diff(starts) > 0] - 1] = n  # no pair begins at a document's end
    before[starts[:-1][np.diff(starts) > 0]] = -1
    lefts, rights, made = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    dead, on = np.zeros(n, bool), np.zeros(n, bool)
    live = np.flatnonzero(after < n).astype(np.int32)
    while len(live) >= least:
        pairs, times, places = counted(sequence[live], sequence[after[live]], first + made, least)
        if not len(pairs):
            break
        which = np.full(len(live), -1, np.int32)
        which[places] = np.repeat(np.arange(len(pairs), dtype=np.int32), times)
        at = np.flatnonzero(which >= 0)
        live, which = live[at], which[at]
        count = times.astype(np.int32)[which]
        # plateaus: neighbours that overlap and stand equally often
        linked = after[live[:-1]] == live[1:]
        fall, rise = linked & (count[:-1] > count[1:]), linked & (count[:-1] < count[1:])
        begins = np.flatnonzero(np.concatenate([[True], ~linked | fall | rise]))
        ends = np.append(begins[1:], len(live)) - 1
        # those that no neighbour outnumbers: their first place, and every other one after it
        top = np.flatnonzero(~(np.concatenate([[False], fall])[begins] | np.append(rise, False)[ends]))
        hit = begins[top]
        others = (ends[top] - hit) >> 1
        long = np.flatnonzero(others)
        if len(long):
            others = others[long]
            step = np.arange(1, int(others.sum()) + 1) - np.repeat(np.cumsum(others) - others, others)
            hit = np.concatenate([hit, np.repeat(hit[long], others) + 2 * step])
        pair = which[hit]
        pays = np.bincount(pair, minlength=len(pairs)) >= least
        paid = pays[pair]
        spot, pair = live[hit[paid]], pair[paid]
        if not len(spot):
            break
        number = np.cumsum(pays) - 1
        lefts.append(pairs[pays] >> 32)
        rights.append(pairs[pays] & 0xFFFFFFFF)
        gone = after[spot]
        sequence[spot] = first + made + number[pair]
        made += int(pays.sum())
        dead[gone] = True
        follow = after[gone]
        after[spot] = follow
        inner = follow < n
        before[follow[inner]] = spot[inner]
        near = before[spot]
        near = near[near >= 0]
        if len(live) + len(near) < n >> 6:
            live = np.unique(np.concatenate([live, near]))  # the rows hit stand in live
            live = live[~dead[live] & (after[live] < n)]
        else:
            on[live] = on[near] = True
            on[gone] = on[spot[~inner]] = False
            live = np.flatnonzero(on).astype(np.int32)
            on[live] = False
    left, right = np.concatenate(lefts), np.concatenate(rights)
    stays = np.flatnonzero(~dead)
    return Grammar(left, right, lengths_of(left, right, first), first, sequence[stays].astype(np.uint32), np.searchsorted(stays, starts))


def counted(left: np.ndarray, right: np.ndarray, bound: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of symbols under ``bound`` that stand ``least`` times, how often each
    does, and all places of the first, of the second and so on. Pair and place are sorted
    as one number where 63 bits hold them."""
    wide, deep = bound.bit_length(), len(left).bit_length()
    if 2 * wide + deep <= 63:
        pair = np.sort((left << wide | right) << deep | np.arange(len(left)))
        place = pair & ((1 << deep) - 1)
        pair >>= deep
    else:
        wide, pair = 32, left << 32 | right
        place = np.argsort(pair, kind="stable")
        pair = pair[place]
    edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
    times = np.diff(edges)
    often = np.flatnonzero(times >= least)
    times, pairs = times[often], pair[edges[often]]
    places = place[np.repeat(edges[often] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
    return pairs >> wide << 32 | pairs & ((1 << wide) - 1), times, places


def lengths_of(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to; a rule's parts are made before it."""
    length, known = np.zeros(len(left), np.int64), np.zeros(len(left), bool)
    todo = np.arange(len(left))
    while len(todo):
        sizes = []
        for part in (left[todo], right[todo]):
            inner = part >= first
            at = np.where(inner, part - first, 0)
            sizes.append((np.where(inner, length[at], 1), ~inner | known[at]))
        ready = sizes[0][1] & sizes[1][1]
        length[todo[ready]] = (sizes[0][0] + sizes[1][0])[ready]
        known[todo[ready]] = True
        todo = todo[~ready]
    return length


def expand(sequence: np.ndarray, g: Grammar) -> np.ndarray:
    """The ids that these symbols stand for. Every symbol knows how many ids it becomes,
    so each part goes to its place at once and ids are never moved again."""
    symbols = sequence.astype(np.int64)
    sizes = g.sizes(symbols)
    out = np.empty(int(sizes.sum()), np.uint32)
    put(out, symbols, np.cumsum(sizes) - sizes, g, *g.short)
    return out


def put(out: np.ndarray, symbols: np.ndarray, at: np.ndarray, g: Grammar, ids: np.ndarray, begins: np.ndarray) -> None:
    """Write what each symbol stands for at its place in ``out``. Rules that begin in
    ``ids`` are copied from there, others are taken apart."""
    while len(symbols):
        rules = symbols >= g.first
        plain = np.flatnonzero(~rules)
        out[at[plain]] = symbols[plain]
        rules = np.flatnonzero(rules)
        rule, at = symbols[rules] - g.first, at[rules]
        begin = begins[rule]
        short = np.flatnonzero(begin >= 0)
        if len(short):
            sizes = g.length[rule[short]]
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(at[short], sizes) + step] = ids[np.repeat(begin[short], sizes) + step]
            long = np.flatnonzero(begin < 0)
            rule, at = rule[long], at[long]
        left = g.left[rule]
        symbols, at = np.concatenate([left, g.right[rule]]), np.concatenate([at, at + g.sizes(left)])


def symbol_bytes(most: int) -> int:
    return 2 if most <= 0xFFFF else 3 if most <= 0xFFFFFF else 4


def to_bytes(doc_ids: np.ndarray, unnamed: int, id_starts: np.ndarray, g: Grammar) -> bytes:
    """The file of a shard; its first ``unnamed`` documents have no id."""
    wide = symbol_bytes(len(g.left) + g.first)
    symbols = g.sequence.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :wide]
    body = b"".join([doc_ids.astype("<i8").tobytes(), g.starts.astype("<u4").tobytes(), id_starts.astype("<u4").tobytes(), g.left.astype("<u4").tobytes(), g.right.astype("<u4").tobytes(), g.length.astype("<u4").tobytes(), symbols.tobytes()])
    head = np.array([len(doc_ids), unnamed, len(g.left), len(g.sequence), g.first, zlib.crc32(body)], "<u4").tobytes()
    return MAGIC + head + body


class Shard:
    """A shard read from its file; documents are expanded by themselves or in runs."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        docs, self.unnamed, rules, symbols, first, check = (int(x) for x in np.frombuffer(data, "<u4", 6, 8))
        if zlib.crc32(memoryview(data)[32:]) != check:
            raise ValueError("the token-id file is damaged")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.doc_ids, starts, self.id_starts = take("<i8", docs), take("<u4", docs + 1).astype(np.int64), take("<u4", docs + 1).astype(np.int64)
        left, right, length = (take("<u4", rules).astype(np.int64) for _ in range(3))
        wide = symbol_bytes(rules + first)
        sequence = np.zeros((symbols, 4), np.uint8)
        sequence[:, :wide] = take("u1", symbols * wide).reshape(-1, wide)
        self.grammar = Grammar(left, right, length, first, sequence.view("<u4").ravel(), starts)

    def documents(self, i: int, j: int) -> np.ndarray:
        """Ids of the documents i..j, one after another."""
        g = self.grammar
        return expand(g.sequence[g.starts[i] : g.starts[j]], g)

    def document(self, i: int) -> np.ndarray:
        return self.documents(i, i + 1)

    def ids(self, i: int, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of document ``i``: only symbols that reach into them expand."""
        g = self.grammar
        part = g.sequence[g.starts[i] : g.starts[i + 1]]
        ends = np.cumsum(g.sizes(part))
        a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(part[a:b], g)[begin - skipped : end - skipped]

    def runs(self, most: int = READ_SYMBOLS) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``most`` symbols."""
        starts, i = self.grammar.starts, 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
            yield i, j
            i = j


class LibraryWords(Pieces):
    """Pieces whose words are encoded by the library's model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(spec_of(path))
        self.model = Tokenizer.from_file(path).model

    @property
    def most(self) -> int:
        return CACHE

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.word(w) for w in words.to_pylist()]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def word(self, word: str) -> bytes:
        if word.startswith(MARK):
            return struct.pack("<I", int(word[1:]))
        ids = [t.id for t in self.model.tokenize(self.lettered(word))]
        return _PACKS[len(ids)](*ids) if len(ids) < len(_PACKS) else np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return self.encode([text])[0].tobytes()


def library_words(path: str) -> LibraryWords:
    if path not in _models:
        _models[path] = LibraryWords(path)
    return _models[path]


def shard_writer(folder: str, path: str, end_id: int):
    """Encode documents in the order they come, write shards, and yield a row for each
    file: only rows of a task that ended count, so files of lost attempts are unread."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(path)
        part = TaskContext.get().partitionId()
        begun = 0

        def flush(names: list, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
            nonlocal begun
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            grammar = compress(ids, starts)
            name = f"{folder}/ids-{part:05d}-{uuid.uuid4().hex}.rp"
            with files.writer(name) as out:
                out.write(to_bytes(np.array([i or 0 for i in names], np.int64), names.count(None), starts, grammar))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([begun], pa.int64()), pa.array([int(starts[-1])], pa.int64())], ["part", "path", "begun", "n_ids"])
            begun += int(starts[-1])
            return row

        def encoded() -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
            """Ids of documents, all their token ids and how many each has."""
            names, texts, size = [], [], 0
            for batch in batches:
                for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    names.append(i)
                    texts.append(text or "")
                    size += len(texts[-1])
                    if size >= AT_ONCE:
                        yield names, *words.encode(texts, end_id)
                        names, texts, size = [], [], 0
            if texts:
                yield names, *words.encode(texts, end_id)

        names, ids, sizes = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for more in encoded():
            names, ids, sizes = names + more[0], np.concatenate([ids, more[1]]), np.concatenate([sizes, more[2]])
            while ids.size >= SHARD_IDS:
                ends = np.cumsum(sizes)
                n = int(np.searchsorted(ends, SHARD_IDS)) + 1
                yield flush(names[:n], ids[: ends[n - 1]], sizes[:n])
                names, ids, sizes = names[n:], ids[ends[n - 1] :], sizes[n:]
        if names:
            yield flush(names, ids, sizes)

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order as token-id files in ``folder``.

    Returns the saved list of files: ``part, path, begun`` (ids of the part before the
    file) and ``n_ids``. A null text is empty, its ids are the end id alone; rows with
    a null id come first and have none in the files. Rows that share an id follow each
    other by text, repeated ones as often as they stand. Texts of any length are encoded
    whole. Other columns are ignored, whatever their names; an empty table writes no file.
    """
    files.make_folder(folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(ordered.mapInArrow(shard_writer(folder, tokenizer_path(tokenizer), end_id), "part int, path string, begun long, n_ids long"), "files")


def read_token_files(listed: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the listed files. Runs
    of documents are expanded by themselves, from where they start in the sequence."""
    # a row for each part: as many as tasks wrote
    parts = sorted((r["part"], r["n"]) for r in listed.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, before = {}, 0
    for part, n in parts:
        base[part] = before
        before += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path, begun in zip(batch["part"].to_pylist(), batch["path"].to_pylist(), batch["begun"].to_pylist(), strict=True):
                with files.reader(path) as file:
                    shard = Shard(file.read())
                for i, j in shard.runs():
                    ids, starts = shard.documents(i, j).astype("<u4", copy=False), shard.id_starts[i : j + 1]
                    ends = (starts - starts[0]).tolist()
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    names = pa.array(shard.doc_ids[i:j], mask=np.arange(i, j) < shard.unnamed)
                    yield pa.RecordBatch.from_arrays([names, pa.array(starts[:-1] + (base[part] + begun)), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return listed.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write token-id files in the shared folder and read every document back."""
    folder = scratch(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
