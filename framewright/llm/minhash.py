"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of M hash keys each (a key is ROWS minimum hashes) stand in for
M*M tables: table (i, j) is keyed by key i of the first collection and key j of the
second, so 2*M*ROWS minimum hashes serve where M*M*2*ROWS would be computed. Two
documents meet in a table when they share a key on both sides. Candidates are
confirmed on their full shingle sets.

Documents with the same shingle set are one class and are compared once. The tables
are never spelled out: a bucket holds the classes that share a key of the first
collection, at most M for a class, and its members are compared if they share a key of
the second. In a round every bucket has one hub, chosen by an aggregate, and all its
other members outside the hub's component are compared with it; the hub then leaves.
The first hub is the member that shares most buckets, for a text that others were
derived from shares more of them than any of its copies. Rounds go on while a bucket
has over BLOCK members outside its largest component. Then all pairs of different
components that the buckets still hold are compared, in tiles of two blocks, the
largest component of a bucket only with the rest: every candidate pair is settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, saved, text_or_empty
from .components import compact, components
from .words import byte_blocks, lowered, mixed, span_hashes, word_spans

#: Keys in each collection and minimum hashes in each key: a pair of similarity s meets
#: in a table with probability (1 - (1 - s^ROWS)^M)^2, 0.9993 at 0.8.
M, ROWS = 12, 3
HASHES = 2 * M * ROWS
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Least equal minimum hashes of HASHES for a pair to be compared in full: a pair of
#: similarity 0.8 has fewer with probability below 1e-6.
LEAST_EQUAL = 40
#: Least shingles of a set kept as its sample. A set of no more is its sample; of larger
#: ones, the SAMPLE least of both hold the shared ones in the share of all, and a pair
#: of similarity 0.8 has under LEAST_SAMPLED with probability below 1e-8.
SAMPLE, LEAST_SAMPLED = 256, 166
#: Rounds of hubs before the pairs that are left are compared in tiles.
ROUNDS = 6
#: Members of a bucket in one block; a tile compares two blocks.
BLOCK = 2000
#: Pairs of a hub that one task confirms.
SHARE = 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashed shingles of every text, one after another, and where each
    text's begin. A text of fewer than ``words`` words has its whole sequence as one."""
    n = len(offsets) - 1
    data = lowered(data)
    starts, ends, owner = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    total = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        total += hashes[j : j + len(total)] * _PLACES[j]
    whole = owner[: len(total)] == owner[words - 1 :] if len(total) else np.zeros(0, bool)
    shingles, of = mixed(total[whole]), owner[: len(total)][whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            has = counts[short] > j
            extra[has] += hashes[first[short[has]] + j] * _PLACES[j]
        extra = mixed(extra ^ (counts[short].astype(np.uint64) * _PLACES[63]))
        shingles, of = np.concatenate([shingles, extra]), np.concatenate([of, short])
    order = np.lexsort((shingles, of))
    shingles, of = shingles[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, of = shingles[new], of[new]
    return shingles, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def sketches(shingles: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(2*M keys, HASHES short minimum hashes) of every set; zeros for empty sets."""
    n, sizes = len(begins) - 1, np.diff(begins)
    full = np.flatnonzero(sizes)
    keys, short = np.zeros((n, 2 * M), np.int64), np.zeros((n, HASHES), np.int16)
    if len(full):
        for k in range(2 * M):
            key = np.full(len(full), k + 1, np.uint64)
            for r in range(ROWS):
                f = k * ROWS + r
                least = mixed(np.minimum.reduceat(shingles * _FACTORS[f] + _SHIFTS[f], begins[full]))
                short[full, f] = (least & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
                key = mixed(key * _PLACES[0] + least)
            keys[full, k] = key.view(np.int64)
    return keys, short


def set_digests(shingles: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set: two sums of independently mixed members."""
    found = []
    for place in (5, 6):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(shingles * _PLACES[place] + _PLACES[place + 2]), dtype=np.uint64)])
        found.append(mixed(sums[begins[1:]] - sums[begins[:-1]] + np.diff(begins).astype(np.uint64)).view(np.int64))
    return found[0], found[1]


_FEATURES = "n long, h1 long, h2 long, keys array<long>, short array<short>"


def features_udf(words: int):
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for data, offsets in byte_blocks(texts):
                shingles, begins = shingle_sets(data, offsets, words)
                keys, short = sketches(shingles, begins)
                h1, h2 = set_digests(shingles, begins)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys, short)]
                parts.append(pa.StructArray.from_arrays([pa.array(np.diff(begins), pa.int64()), pa.array(h1), pa.array(h2), *lists], ["n", "h1", "h2", "keys", "short"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], parts[0].type if parts else pa.struct([("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("short", pa.list_(pa.int16()))]))

    return F.arrow_udf(features, _FEATURES)


def samples_udf(words: int):
    """Digests and the SAMPLE least shingles of the set of each text."""

    def samples(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            h1, h2, lists = [], [], []
            for data, offsets in byte_blocks(texts):
                shingles, begins = shingle_sets(data, offsets, words)
                one, two = set_digests(shingles, begins)
                h1 += one.tolist()
                h2 += two.tolist()
                lists += [shingles[s : min(e, s + SAMPLE)].view(np.int64) for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["h1", "h2", "sample"])

    return F.arrow_udf(samples, "h1 long, h2 long, sample array<long>")


def confirm(words: int, percent: int):
    """Links of runs of rows ``hub, salt, rep, text``: a run begins with the hub's own
    texts, whose ``rep`` is null, and its other rows are compared with those."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, mine = None, []
        for batch in batches:
            sets: list[np.ndarray] = []
            for data, offsets in byte_blocks(batch["text"]):
                shingles, begins = shingle_sets(data, offsets, words)
                sets += [shingles[s:e] for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            a, b = [], []
            for hub, salt, rep, other in zip(batch["hub"].to_pylist(), batch["salt"].to_pylist(), batch["rep"].to_pylist(), sets, strict=True):
                if (hub, salt) != run:
                    run, mine = (hub, salt), []
                if rep is None:
                    mine.append(other.copy())
                elif any(linked(x, other, percent) for x in mine):
                    a.append(hub)
                    b.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same > 0 and 100 * same >= percent * (len(x) + len(y) - same)


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b``: the pairs ``hub, rep`` that are linked on their full sets. A hub's text
    is sent once for SHARE pairs, and a task holds one hub and a batch of others."""
    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    salted = pairs.join(shares, "hub").select("hub", "rep", F.pmod(F.xxhash64("rep"), "shares").cast("int").alias("salt"))
    others = salted.join(texts, "rep").select("hub", "salt", "rep", "text")
    hubs = salted.select("hub", "salt").distinct().join(texts.withColumnRenamed("rep", "hub"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("rep"), "text")
    runs = others.unionByName(hubs).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("rep").asc_nulls_first())
    return runs.mapInArrow(confirm(words, percent), "a long, b long")


class Tile:
    """Rows of one tile, or of several one after another."""

    def __init__(self, rows: pa.Table) -> None:
        number = lambda c: rows[c].to_numpy()
        flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
        self.tile = np.stack([number(c) for c in ("key", "x", "y")], 1)
        self.rep, self.component, self.n, self.block = (number(c) for c in ("rep", "component", "n", "block"))
        self.keys, self.short = flat("keys").reshape(len(rows), 2 * M), flat("short").reshape(len(rows), HASHES)
        self.ends = np.cumsum(rows["sample"].combine_chunks().value_lengths().to_numpy())
        self.sample = flat("sample").view(np.uint64)
        self.whole = self.n <= SAMPLE

    def samples(self, i: int) -> np.ndarray:
        return self.sample[self.ends[i - 1] if i else 0 : self.ends[i]]

    def settle(self, begin: int, end: int, percent: int, links: list, likely: list) -> None:
        """Compare the pairs of rows begin..end. Pairs of sets that are whole in their
        samples are settled, and those that links of the tile connect already are passed
        over; others that may be linked by sizes and samples are ``likely``."""
        key, one, two = self.tile[begin].tolist()
        n, short, whole = self.n[begin:end], self.short[begin:end], self.whole[begin:end]
        left, right = self.keys[begin:end, :M], self.keys[begin:end, M:]
        place = int(np.flatnonzero(left[0] == key)[0])
        _, group = np.unique(self.component[begin:end], return_inverse=True)
        block = self.block[begin:end]
        firsts, seconds = np.flatnonzero(block == one), np.flatnonzero(block == two)
        ids = has = None
        base = self.ends[begin - 1] if begin else 0
        ends = self.ends[begin:end] - base
        begins = np.r_[0, ends[:-1]]
        for i in firsts.tolist():
            j = seconds[group[seconds] != group[i]]
            if one == two:
                j = j[j > i]
            if not len(j):
                continue
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            # a pair counts in the first bucket that it shares
            j = j[(right[j] == right[i]).any(1) & ~(left[j, :place] == left[i, :place]).any(1)]
            j = j[(short[j] == short[i]).sum(1) >= LEAST_EQUAL]
            if not len(j):
                continue
            exact = j[whole[j]] if whole[i] else j[:0]
            if len(exact):
                if ids is None:
                    values, ids = np.unique(self.sample[base : base + ends[-1]], return_inverse=True)
                    has = np.zeros(len(values), np.int32)
                has[ids[begins[i] : ends[i]]] = 1
                sizes = n[exact]
                at = np.repeat(begins[exact] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                same = np.add.reduceat(has[ids[at]], np.cumsum(sizes) - sizes)
                has[ids[begins[i] : ends[i]]] = 0
                hits = exact[(same > 0) & (100 * same >= percent * (sizes + n[i] - same))]
                for h in hits.tolist():
                    if group[h] != group[i]:
                        links.append((int(self.rep[begin + i]), int(self.rep[begin + h])))
                        group[group == group[h]] = group[i]
            mine = self.samples(begin + i)
            for k in (j[~whole[j]] if whole[i] else j).tolist():
                if group[k] != group[i]:
                    other = self.samples(begin + k)
                    least = np.union1d(mine, other)[:SAMPLE]
                    same = len(np.intersect1d(mine[mine <= least[-1]], other[other <= least[-1]], assume_unique=True))
                    if same * SAMPLE >= LEAST_SAMPLED * len(least):
                        likely.append((int(self.rep[begin + i]), int(self.rep[begin + k])))


def settle_tiles(percent: int):
    """Links and likely pairs of tiles whose rows come one tile after another."""

    def told(rows: pa.Table) -> pa.RecordBatch:
        links: list[tuple[int, int]] = []
        likely: list[tuple[int, int]] = []
        tiles = Tile(rows)
        cuts = np.flatnonzero((tiles.tile[1:] != tiles.tile[:-1]).any(1)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            tiles.settle(begin, end, percent, links, likely)
        pairs = links + likely
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64()), pa.array([True] * len(links) + [False] * len(likely), pa.bool_())], ["hub", "rep", "sure"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held[c][-1] for c in ("key", "x", "y")]
            same = np.logical_and.reduce([held[c].to_numpy() == v.as_py() for c, v in zip(("key", "x", "y"), last, strict=True)])
            cut = len(held) - int(same.sum())
            if cut:
                yield told(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield told(held)

    return settle


def pairs_of_the_rest(members: DataFrame, mixed_keys: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """``hub, rep, sure``: links and likely pairs between members of different components
    in the same bucket. ``mixed_keys`` has each bucket's largest component, its members
    there and its others."""
    blocks = [F.ceil(F.col(c) / BLOCK).cast("int").alias(f"{c}_blocks") for c in ("others", "top")]
    rows = members.join(mixed_keys.select("key", "major", *blocks), "key").join(light, "rep").where(F.array_contains(F.slice("keys", 1, M), F.col("key")))
    major = F.col("component") == F.col("major")
    place = lambda n: F.pmod(F.xxhash64("rep", F.lit("block")), n).cast("int")
    rows = rows.withColumn("block", F.when(major, F.col("others_blocks") + place(F.col("top_blocks"))).otherwise(place(F.col("others_blocks"))))
    # blocks of the largest component meet those of the others only
    with_all = F.sequence(F.lit(0), F.col("others_blocks") + F.col("top_blocks") - 1)
    rows = rows.withColumn("other", F.explode(F.when(major, F.sequence(F.lit(0), F.col("others_blocks") - 1)).otherwise(with_all)))
    tiles = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "component", "n", "keys", "short", "sample")
    return tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(settle_tiles(percent), "hub long, rep long, sure boolean")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """``key, rep, size``: keys of the first collection that several classes have. Those
    of the second need no rows: they are compared where two classes meet."""
    halves = classes.select("rep", F.explode(F.slice("keys", 1, M)).alias("key")).distinct()
    often = halves.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return halves.join(often, "key")


def joined(group: DataFrame | None, links: DataFrame) -> DataFrame:
    """``rep, component`` by new links and the components so far."""
    if group is not None:
        links = links.unionByName(group.where("rep != component").select(F.col("rep").alias("a"), F.col("component").alias("b")))
    return compact(saved(components(links).select(F.col("node").alias("rep"), "component"), "groups"))


def class_links(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``rep, component``: components of the classes by confirmed links."""
    buckets = compact(saved(shared_buckets(classes), "buckets"))
    busy = compact(saved(buckets.groupBy("rep").agg(F.sum("size").alias("busy")), "busy"))
    light = compact(saved(classes.select("rep", "n", "keys", "short", "h1", "h2").join(busy, "rep"), "light"))
    texts = saved(docs.select(F.col("doc_id").alias("rep"), "text").join(busy.select("rep"), "rep", "left_semi"), "texts")
    sides = [light.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("short").alias(f"short_{s}"), F.slice("keys", M + 1, M).alias(f"right_{s}")) for s in ("hub", "rep")]
    equal = F.aggregate(F.zip_with("short_hub", "short_rep", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + x)
    members = buckets.select("key", "rep", F.col("rep").alias("component"))
    group, turn = None, 0
    while True:
        if turn == 0:
            ranked = members.join(busy, "rep").withColumn("order", F.struct("busy", "rep", "component"))
        else:
            outside = members.join(mixed_keys.select("key", "major"), "key").where("component != major")
            ranked = outside.withColumn("order", F.struct(F.xxhash64("rep", F.lit(turn)), "rep", "component"))
        hubs = compact(saved(ranked.groupBy("key").agg(F.max("order").alias("h")).select("key", F.col("h.rep").alias("hub"), F.col("h.component").alias("its")), "hubs"))
        met = members.join(hubs, "key").where("component != its").select("hub", "rep").distinct()
        likely = met.join(sides[0], "hub").join(sides[1], "rep").where(100 * F.least("n_hub", "n_rep") >= percent * F.greatest("n_hub", "n_rep"))
        likely = likely.where(F.arrays_overlap("right_hub", "right_rep") & (equal >= LEAST_EQUAL))
        pairs = compact(saved(likely.select("hub", "rep").distinct(), "pairs"))
        links = compact(saved(confirmed(pairs, texts, words, percent), "links"))
        if not links.isEmpty():
            group = joined(group, links)
        left = members.select("key", "rep").join(hubs.select("key", F.col("hub").alias("rep")), ["key", "rep"], "left_anti")
        left = left.join(group, "rep", "left").withColumn("component", F.coalesce("component", "rep")) if group is not None else left.withColumn("component", F.col("rep"))
        members = compact(saved(left, "left"))
        counts = members.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
        counts = counts.agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size")).select("key", F.col("most.component").alias("major"), F.col("most.n").alias("top"), (F.col("size") - F.col("most.n")).alias("others"))
        mixed_keys = compact(saved(counts.where("others > 0"), "mixed"))
        turn += 1
        if turn >= ROUNDS or mixed_keys.where(F.col("others") > BLOCK).isEmpty():
            break
    if not mixed_keys.isEmpty():
        members = compact(saved(members.join(mixed_keys.select("key"), "key", "left_semi"), "rest"))
        rest = light.join(members.select("rep").distinct(), "rep", "left_semi")
        read = texts.join(rest.select("rep").distinct(), "rep", "left_semi").select("rep", samples_udf(words)("text").alias("s")).select("rep", "s.*").dropDuplicates(["rep", "h1", "h2"])
        full = saved(rest.join(read, ["rep", "h1", "h2"]).select("rep", "n", "keys", "short", "sample"), "sampled")
        found = compact(saved(pairs_of_the_rest(members, mixed_keys, full, percent), "rest-pairs"))
        links = found.where("sure").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        likely = found.where("not sure").select("hub", "rep").distinct()
        links = compact(saved(links.unionByName(confirmed(likely, texts, words, percent)), "links"))
        if not links.isEmpty():
            group = joined(group, links)
    return group if group is not None else classes.select("rep", F.col("rep").alias("component")).limit(0)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each input row.

    Words are runs of bytes other than space and 9 to 13 after A-Z are lower-cased. A
    document's set holds its distinct shingles of ``words`` words; with fewer words,
    the whole sequence as one. Sets A, B are linked if 100 |A & B| >= percent |A | B|.
    A null, empty or blank text has an empty set and no links. Rows that share an id
    are one document with several texts: links of any of them count for it. Documents
    with a null id keep a null component. Other columns are ignored.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    table = saved(rows.select("doc_id", features_udf(words)("text").alias("f")).select("doc_id", "f.*"), "sketches")
    inside = table.where("n > 0 and doc_id is not null")
    least = inside.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    firsts = inside.join(least, ["h1", "h2"]).where("doc_id = rep")
    classes = saved(firsts.select("rep", "n", "keys", "short", "h1", "h2").dropDuplicates(["rep", "h1", "h2"]), "classes")
    group = class_links(rows, classes, words, percent)
    named = classes.select("h1", "h2", "rep").join(group, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    result = table.select("doc_id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), F.when(F.col("n") > 0, F.col("h2")).alias("h2")).join(named, ["h1", "h2"], "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: that with the
    smallest id. Of rows that share an id the one with the smallest text stays (nulls
    first; equal texts by a hash of the row); rows with a null id all stay. Columns of
    any name are kept as they are; an empty table gives an empty one."""
    chosen = near_duplicates(docs, words, percent, id_col, text_col).where("kept and doc_id is not null").select(F.col("doc_id").alias("_chosen")).distinct()
    kept = docs.join(chosen, F.col(id_col) == F.col("_chosen"), "left_semi")
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first(), F.xxhash64(*docs.columns))
    one = kept.withColumn("_place", F.row_number().over(order)).where("_place = 1").select(docs.columns)
    return one.unionByName(docs.where(F.col(id_col).isNull()))
