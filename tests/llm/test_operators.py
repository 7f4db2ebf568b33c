"""Small fixtures against brute force, and the stated results of odd inputs."""

import base64
import hashlib
import io
import itertools
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, langid, minhash, mixing, nearest, pieces, quality, repair, token_count, warc
from framewright.llm.components import components
from framewright.llm.cover_tree import near_vectors
from framewright.llm.minhash import near_duplicates
from framewright.llm.words import byte_blocks, span_hashes, word_spans

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", "   ", "x", "\t\n", "word " * 9000, "Straße ΣΑΣ İstanbul don't I'LL", "<|endoftext|>a<|startoftext|> b<|endoftext", "日本語 한국어 éàü 123 ½", "a\x85b\xa0c\x1cd\x00e", "a  b   c", " ▁ x▁y", "🎉🎉 emoji"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def docs_of(spark, texts, **columns):
    rows = [(i, t, (columns.get("lang") or ["en"] * len(texts))[i], (columns.get("source") or ["s"] * len(texts))[i], len(t or ""), 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentences(n, seed=0, size=40, words=300):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary, size)) for _ in range(n)]


# 1


def brute_components(texts, k, percent=80):
    def shingles(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        same = len(sets[i] & sets[j])
        if same and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_agree_with_brute_force(spark):
    base = sentences(30, size=60)
    rng = np.random.default_rng(1)
    texts = [*ODD, *base]
    for t in base[:12]:
        for edits in (1, 2, 8):
            w = t.split()
            for at in rng.choice(len(w), edits, replace=False):
                w[at] = "edited"
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), "one two", "One Two", "one"]
    found = {r["doc_id"]: r for r in near_duplicates(docs_of(spark, texts), words=4).collect()}
    assert len(found) == len(texts)
    for i, (n, root) in enumerate(brute_components(texts, 4)):
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (n, root, root == i)


def test_near_duplicates_in_a_star_of_copies(spark):
    rng = np.random.default_rng(5)
    centre = [f"w{i}" for i in range(120)]
    texts = [" ".join(centre)]
    for _ in range(60):
        w = list(centre)
        for at in rng.choice(120, 3, replace=False):
            w[at] = f"e{rng.integers(1 << 40)}"
        texts.append(" ".join(w))
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(spark, texts), words=4).collect()}
    assert [found[i] for i in range(len(texts))] == [root for _, root in brute_components(texts, 4)]


@pytest.mark.parametrize(("block", "sample"), [(minhash.BLOCK, minhash.SAMPLE), (60, minhash.SAMPLE), (60, 2000)])
def test_near_duplicates_in_a_family_of_unlike_variants(spark, monkeypatch, block, sample):
    # two wordings at each of 60 places, so that all shingles are common: pairs resemble
    # each other at about 0.7, the planted ones (18 places apart) alone at 0.8 and more
    monkeypatch.setattr(minhash, "ROUNDS", 2)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SAMPLE", sample)
    monkeypatch.setattr(minhash, "LEAST_SAMPLED", int(0.65 * sample))
    rng = np.random.default_rng(7)
    kept = []
    while len(kept) < 500:
        v = rng.integers(0, 2, 60)
        if all((v != u).sum() >= 20 for u in kept):
            kept.append(v)
    for i in (100, 200, 300):
        v = kept[i].copy()
        v[rng.choice(60, 18, replace=False)] ^= 1
        kept.append(v)
    texts = [" ".join(f"w{i}" if i % 12 else f"w{i}v{v[i // 12]}" for i in range(720)) for v in kept]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(spark, texts), words=4).collect()}
    assert [found[i] for i in range(len(texts))] == [root for _, root in brute_components(texts, 4)]


def test_near_duplicates_of_nothing_and_repeated_ids(spark):
    assert near_duplicates(docs_of(spark, []), words=5).count() == 0
    twice = docs_of(spark, ["a b c d e f", "x y"]).union(docs_of(spark, ["a b c d e f"]))
    assert sorted((r["doc_id"], r["component_id"]) for r in near_duplicates(twice).collect()) == [(0, 0), (0, 0), (1, 1)]


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_word_spans_and_hashes():
    import pyarrow as pa

    (data, offsets), = byte_blocks(pa.array(["ab cd", None, "ab", " ab\tx "]))
    starts, ends, owner = word_spans(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(starts, ends)] == [b"ab", b"cd", b"ab", b"ab", b"x"]
    assert owner.tolist() == [0, 0, 2, 3, 3]
    h = span_hashes(data, starts, ends)
    assert h[0] == h[2] == h[3] and len({*h.tolist()}) == 3


# 2


def test_exponent_meets_entropy_or_limit():
    shares = [0.7, 0.2, 0.1]
    k = mixing.exponent(shares, 0.95, 100.0, 1.0)
    h = [mixing.entropy(mixing.mixture(shares, x / mixing.GRID)) for x in (k, k + 1)]
    assert h[0] >= 0.95 * np.log(3) - 1e-9 > h[1]
    k = mixing.exponent(shares, 1.0, 1.5, 1.0)
    assert max(w / p for w, p in zip(mixing.mixture(shares, k / mixing.GRID), shares)) <= 1.5 + 1e-9
    assert mixing.exponent(shares, 0.0, 9.0, 1.0) == mixing.GRID


def test_mixture_meets_its_budget(spark):
    texts = ["w " * (1 + i % 7) for i in range(600)]
    source = ["big" if i % 3 else ("a" if i % 2 else None) for i in range(600)]
    docs = docs_of(spark, [*texts, None, ""], source=[*source, "big", "x"])
    rows = mixing.mix(docs, evenness=0.99, repeat=4.0).toPandas()
    totals = {s: sum(len(t.split()) for t, x in zip(texts, source) if (x or "") == s) for s in ("big", "a", "")}
    plan = {p[0]: p for p in mixing.source_plan(list(totals.items()), 0.99, 4.0, 1.0)}
    for s, part in rows.groupby("source"):
        due = plan[s][3] * plan[s][1] + plan[s][4]
        assert 0 <= due - part["n_tokens"].sum() <= 7
        assert not part.duplicated(["doc_id", "pass"]).any()
    assert mixing.mix(docs_of(spark, [])).count() == 0
    again = mixing.mixed_documents(docs, evenness=0.99, repeat=4.0)
    assert again.columns == docs.columns and again.count() == len(rows)


# 3, 5


def test_bpe_is_the_library_s():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    vocab, library = bpe.vocabulary(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    texts = [t or "" for t in ODD] + sentences(30) + ["".join(rng.choice(list("aeht ns'’0!é\n"), 80)) for _ in range(200)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert vocab.ids_of(t) == ids, t
        assert vocab.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(repair.library_words(path).ids(t), "<u4").tolist() == ids


def test_bpe_of_long_words_takes_time_in_proportion():
    import time

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    vocab, library = bpe.vocabulary(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list(letters), n)) for n in (65, 300, 3000) for letters in ("abcdefghijklmnopqrstuvwxyz", "aeinst", "éaßt", "日本語")] + ["ab" * 500, "a" * 1001]
    for w in words:
        assert vocab.ids_of(w) == library.encode(w, add_special_tokens=False).ids
        if len(w) > bpe.LONG and w.isascii():
            assert vocab.stepped(w) == vocab.merged_many([w])[0]
    took = []
    for n in (20_000, 200_000):
        w = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
        began = time.process_time()
        assert vocab.ids_of(w) == library.encode(w, add_special_tokens=False).ids
        took.append(time.process_time() - began)
    assert took[1] < 40 * took[0]  # a square would be 100


def test_bpe_costs_less_than_half_of_the_library(monkeypatch):
    import time

    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "_loaded", {})
    bpe.vocabulary(path)
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    parts = np.array("the of and her ing tion que los der sch un er".split())
    words = ["".join(parts[rng.integers(0, len(parts), n)]) for n in rng.integers(1, 8, 60_000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(1500)]
    began = time.process_time()
    found = bpe.digests(texts, path)
    took = time.process_time() - began
    began = time.process_time()
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert took < 0.5 * (time.process_time() - began)  # 0.77 with words encoded one by one
    assert found[0] == [len(w) for w in wanted] and found[1] == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in wanted]


def test_bpe_of_many_texts_as_pieces_come_and_go(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    vocab, library = bpe.Vocabulary(path), Tokenizer.from_file(path)
    monkeypatch.setattr(pieces, "CACHE", 100)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    rng = np.random.default_rng(5)
    letters = [*map(chr, range(256)), *"aaaeS .'s<|>Σςſ日本\u3000\u200b", "<|endoftext|>", "S1", "a" * 70, "é" * 40, " the", "'ll"]
    for _ in range(200):
        texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3)]
        ids, sizes = vocab.encode(texts)
        wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for w in wanted for i in w] and sizes.tolist() == [len(w) for w in wanted]
        assert [str(t, "utf-8") for t in vocab.decoded(ids, sizes)] == [library.decode(w, skip_special_tokens=False) for w in wanted]
    assert len(vocab.pieces) < 400
    # ids without a token are left out, wherever they stand
    assert [bytes(t) for t in vocab.decoded(np.array([-1, 7, 1 << 20, 1 << 20]), np.array([0, 3, 1, 0]))] == [b"", vocab.names[7].encode(), b"", b""]
    assert vocab.decode([None, 7, -3, 8]) == f"{vocab.names[7]} {vocab.names[8]}" and vocab.decode([]) == ""


def test_bpe_decodes_null_ids(spark):
    rows = [(1, [7, None, 8]), (2, None), (3, []), (4, [None, -1, 1 << 30]), (5, [49407])]
    found = {r["doc_id"]: r["text"] for r in bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    names = bpe.vocabulary(P.path("word_bpe_49k.json")).names
    assert found == {1: f"{names[7]} {names[8]}", 2: "", 3: "", 4: "", 5: "<|endoftext|>"}


def test_bpe_refuses_other_tokenizer_files(tmp_path):
    import json

    spec = json.load(open(P.path("word_bpe_49k.json")))
    for key, value in (("decoder", {"type": "ByteLevel"}), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFKC"}]})):
        (tmp_path / "other.json").write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError, match="tokenizer file"):
            bpe.Vocabulary(str(tmp_path / "other.json"))


def test_compatibility_is_exact_merging():
    vocab = bpe.vocabulary(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(0)
    mid, last = [*vocab.mid.items()], [*vocab.last.items()]
    left = [mid[i] for i in rng.integers(len(mid), size=600)]
    right = [last[i] for i in rng.integers(len(last), size=600)]
    good = vocab.compatible(np.array([i for _, i in left]), np.array([i for _, i in right]))
    for (a, i), (b, j), g in zip(left, right, good.tolist()):
        assert g == (vocab.merged(vocab.symbols(a + b)) == [i, j])
    words = [a + b for (a, _), (b, _) in zip(left, right)]
    assert vocab.merged_many(words) == [vocab.merged(vocab.symbols(w)) for w in words]


def test_bpe_queries_on_odd_rows(spark):
    docs = docs_of(spark, ODD)
    digests = {r["doc_id"]: r for r in bpe.encode_digests(docs).collect()}
    encoded = bpe.encode_documents(docs)
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded).collect()}
    for r in encoded.collect():
        d = digests[r["doc_id"]]
        assert d["n_tokens"] == len(r["ids"])
        assert d["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_digests(docs_of(spark, [])).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 30, n) for n in (0, 1, 5000, 0, 20000, 3)] + [np.zeros(999, int)]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    flat = np.concatenate(docs)
    g = repair.compress(flat, starts, least=8)
    assert len(g.left) and len(g.sequence) < len(flat)
    # no pair is left that stands often enough, and every rule was used as often
    inner = np.ones(len(g.sequence), bool)
    inner[g.starts[1:][np.diff(g.starts) > 0] - 1] = False
    seq = g.sequence.astype(np.int64)
    at = np.flatnonzero(inner)
    left = np.unique(seq[at] << 32 | seq[at + 1], return_counts=True)[1]
    assert left.max() < 16  # pairs that overlap others, as in a a a
    shard = repair.Shard(repair.to_bytes(np.arange(len(docs)), 1, starts, g))
    assert (shard.documents(0, len(docs)) == flat).all() and shard.unnamed == 1
    assert [i for a, b in shard.runs(500) for i in range(a, b)] == [*range(len(docs))]
    assert all((shard.documents(a, b) == flat[starts[a] : starts[b]]).all() for a, b in shard.runs(500))
    for i, d in enumerate(docs):
        assert (shard.document(i) == d).all()
    assert (shard.ids(4, 777, 7777) == docs[4][777:7777]).all()
    damaged = bytearray(repair.to_bytes(np.arange(len(docs)), 0, starts, g))
    damaged[60] ^= 1
    with pytest.raises(ValueError):
        repair.Shard(bytes(damaged))


def test_grammar_goes_on_until_no_rule_pays():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 40_000, 700)
    docs = [text] * 40 + [rng.integers(0, 40_000, 700) for _ in range(20)]
    starts = np.arange(0, 700 * 61, 700)
    flat = np.concatenate(docs)
    g = repair.compress(flat, starts)
    assert g.length.max() > 300  # rules span copies of a text, not 32 ids
    assert np.diff(g.starts)[:40].max() <= 4
    assert (repair.expand(g.sequence, g) == flat).all()
    assert (g.length == [len(repair.expand(np.array([g.first + i]), g)) for i in range(len(g.left))]).all()
    for empty in (np.zeros(0, np.uint32), np.array([5], np.uint32)):
        h = repair.compress(empty, np.array([0, len(empty)]))
        assert (repair.expand(h.sequence, h) == empty).all()


def test_token_files_encode_each_word_once(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "_loaded", {})
    words = repair.LibraryWords(path)
    assert not bpe._loaded  # the tables of op3, which take over a second, are not built
    model, asked = words.model, []

    class Asked:
        def tokenize(self, letters):
            asked.append(letters)
            return model.tokenize(letters)

    words.model = Asked()
    texts = ["Haus HAUS. haus, (haus) haus! Haus.", "l'été Été. l'été, 'haus 'sie it's", "x1 12. ... '. '.s é.é ª.º µ, ÷. ×× 日本. Σας. a\x1cb.\xa0c. \x00. d\x00. <|endoftext|>. _a_ a_"]
    for text in texts * 2:
        assert np.frombuffer(words.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) == len(set(asked)) and {"haus", "."} < set(asked)


def test_token_files_encode_as_pieces_come_and_go(monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, words = Tokenizer.from_file(path), repair.LibraryWords(path)
    monkeypatch.setattr(repair, "CACHE", 100)
    rng = np.random.default_rng(4)
    letters = [*map(chr, range(256)), *"aeS .'s<|>Σςſ日本\u3000\u200b", "<|endoftext|>", "S1"]
    for _ in range(200):
        texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3)]
        ids, sizes = words.encode(texts, 1)
        wanted = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == [i for w in wanted for i in w] and sizes.tolist() == [len(w) for w in wanted]
    assert len(words.pieces) < 400


def test_pairs_are_counted_alike_by_narrow_and_wide_numbers():
    rng = np.random.default_rng(7)
    left, right = rng.integers(0, 9, 2000), rng.integers(0, 9, 2000)
    narrow = repair.counted(left, right, 9, 20)
    wide = repair.counted(left, right, (1 << 31) - 1, 20)
    assert all((a == b).all() for a, b in zip(narrow, wide)) and len(narrow[0])
    at = 0
    for pair, n in zip(narrow[0].tolist(), narrow[1].tolist()):
        assert narrow[2][at : at + n].tolist() == [i for i in range(2000) if (left[i], right[i]) == (pair >> 32, pair & 0xFFFFFFFF)]
        at += n


def test_token_files_of_null_and_repeated_ids(spark):
    rows = [(None, "b b"), (-1, "c"), (2, "x y z"), (2, "a"), (2, "a"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, start int, n_tokens int")
    found = sorted(((r["doc_id"] if r["doc_id"] is not None else -9, r["start"], r["n_tokens"]) for r in repair.round_trip(docs).collect()), key=lambda r: r[1])
    assert found == [(-9, 0, 1), (-9, 1, 3), (-1, 4, 2), (2, 6, 2), (2, 8, 2), (2, 10, 4)]


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, *sentences(200)]
    found = {r["doc_id"]: r for r in repair.round_trip(docs_of(spark, texts)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert repair.round_trip(docs_of(spark, [])).count() == 0


# 4, 6


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, dim string")


def made_vectors(seed=0, n=500, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:140] = x[100] + rng.normal(size=(40, dim)).astype(np.float32) * 0.03
    x[140:160] = x[140]
    x[160:170] = 2 * x[140]
    return x


ODD_VECTORS = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]


def test_nearest_against_brute_force(spark):
    x = made_vectors()
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)] + [(1000 + 20 * i, v, 0, "x") for i, v in enumerate(ODD_VECTORS)]
    found = nearest.nearest(vectors_of(spark, rows)).toPandas()
    xd = x.astype(float)
    hits = 0
    for q in range(0, 500, 20):
        s = xd @ xd[q]
        best = sorted((i for i in range(500) if i != q), key=lambda i: (-s[i], i))[:20]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], s[mine["vec_id"]])
        hits += len(set(best) & set(mine["vec_id"]))
    assert hits >= 0.9 * 20 * 25
    assert set(found["query_id"]) == {*range(0, 500, 20)}
    assert nearest.nearest(vectors_of(spark, [])).count() == 0


def test_nearest_splits_and_stops():
    assert abs(nearest.chi_square(nearest.BOUND) - nearest.KEEP) < 1e-9
    rng = np.random.default_rng(0)
    d2 = (rng.normal(size=(20000, nearest.DIMS)) ** 2).sum(1)
    assert abs((d2 < nearest.BOUND).mean() - nearest.KEEP) < 0.01
    splits = nearest.Splits(rng.normal(size=(4096, nearest.DIMS)), 4)
    assert len(np.unique(splits.cell(rng.normal(size=(4096, nearest.DIMS))))) == 16


def test_near_vectors_against_brute_force(spark, monkeypatch):
    from framewright.llm import cover_tree

    monkeypatch.setattr(cover_tree, "CELL", 60)
    monkeypatch.setattr(cover_tree, "SEEKERS", 64)
    x = made_vectors()
    labels = [None if i % 50 == 3 else int(i % 7 == 0) for i in range(500)]
    rows = [(i, v.tolist(), labels[i], "x") for i, v in enumerate(x)] + [(1000 + i, v, 0, "x") for i, v in enumerate(ODD_VECTORS)]
    found = {r["vec_id"]: r for r in near_vectors(vectors_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    xd = x.astype(float)
    u = xd / np.linalg.norm(xd, axis=1)[:, None]
    near = (u @ u.T >= 0.98) & np.array([[a is not None and a == b for b in labels] for a in labels])
    root = list(range(500))
    for _ in range(60):
        root = [min(root[j] for j in [i, *np.flatnonzero(near[i])]) for i in range(500)]
    for i in range(500):
        n = int(near[i].sum()) - 1 if labels[i] is not None else 0
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (n, root[i], root[i] == i)
    for i in range(len(ODD_VECTORS)):
        assert (found[1000 + i]["n_links"], found[1000 + i]["component_id"]) == (0, 1000 + i)
    assert near_vectors(vectors_of(spark, [])).count() == 0


# 7, 8

PARTS = {"aa": ["ka", "ko", "ku"], "bb": ["ély", "ßen", "tür"]}


def language_docs(spark, n=120):
    rng = np.random.default_rng(0)
    lang = [["aa", "bb"][i % 2] for i in range(n)]
    texts = [" ".join("".join(rng.choice(PARTS[lang_], 3)) for _ in range(20)) for lang_ in lang]
    return texts, lang


def test_language_is_learned_and_odd_texts_are_undetermined(spark):
    texts, lang = language_docs(spark)
    docs = docs_of(spark, [*texts, *ODD, "123 !!"], lang=[*lang, *[None] * (len(ODD) + 1)])
    model = langid.fit(docs)
    found = {r["doc_id"]: r for r in langid.predict_language(docs, model).collect()}
    right = [found[i]["lang_pred"] == x for i, x in enumerate(lang) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean(right) > 0.95
    n = len(texts)
    for i in (0, 1, 2, 4):  # null, empty, blank
        assert (found[n + i]["lang_pred"], found[n + i]["score"]) == ("und", 0.0)
    assert found[n + len(ODD)]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    nothing = langid.fit(docs_of(spark, []))
    assert {r["lang_pred"] for r in langid.predict_language(docs, nothing).collect()} == {"und"}
    assert langid.predict_language(docs_of(spark, []), model).count() == 0
    assert langid.keep_languages(docs, model).columns == docs.columns


def differences(gradients, weights, picks):
    """Largest gap between slopes and differences of the loss."""
    _, slopes = gradients(weights)
    worst = 0
    for key, i in picks:
        old, e = weights[key][i], 1e-6
        weights[key][i] = old + e
        above = gradients(weights)[0]
        weights[key][i] = old - e
        below = gradients(weights)[0]
        weights[key][i] = old
        worst = max(worst, abs((above - below) / (2 * e) - slopes[key][i]))
    return worst


def test_language_gradient():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    w = langid.initial(3, rng, np.float64)
    x = rng.integers(97, 110, (9, 5)).astype(np.intp)
    x[7:, 2] = langid.PAD
    mask = (x < langid.PAD) * 1.0
    mask[:2, 0] = 0
    picks = [(k, (int(rng.integers(v.shape[0])), int(x[rng.integers(7), 0])) if k[0] == "x" else tuple(rng.integers(0, s) for s in v.shape)) for k, v in w.items() for _ in range(12)]
    assert differences(lambda w: langid.gradients(x, np.array([0, 1, 2, 1, 0]), mask, w), w, picks) < 1e-7


def plain_language(text, model):
    """Mean label probabilities by plain loops, one position at a time."""
    w, data = model.weights, text.encode()
    bend = lambda x: x / (1 + np.abs(x))
    k, total = langid.UNITS, np.zeros(len(model.names))
    whole = len(data) <= langid.CORE + 2 * langid.MARGIN
    cuts = [0, len(data)] if whole else [*range(0, len(data), langid.CORE), len(data)]
    while any(0 < c < len(data) and data[c] & 0xC0 == 0x80 for c in cuts):
        cuts = [c - (0 < c < len(data) and data[c] & 0xC0 == 0x80) for c in cuts]
    for begin, end in zip(cuts, cuts[1:]):
        lo, hi = max(0, begin - langid.MARGIN), min(len(data), end + langid.MARGIN)
        states = {}
        for side, order in (("f", range(lo, hi)), ("b", range(hi - 1, lo - 1, -1))):
            h = np.zeros(k)
            for i in order:
                a, u = w[f"x{side}"][:, data[i]], w[f"u{side}"] @ h
                gates = 0.5 + 0.5 * bend(a[: 2 * k] + u[: 2 * k])
                new = bend(a[2 * k :] + gates[:k] * u[2 * k :])
                h = new + gates[k:] * (h - new)
                states[side, i] = h
        for i in range(begin, end):
            e = np.exp(w["vf"] @ states["f", i] + w["vb"] @ states["b", i] + w["b"])
            total += e / e.sum()
    return total / max(1, len(data))


def test_language_of_every_position_by_plain_loops():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    model = langid.Model(["aa", "bb", "cc"], langid.initial(3, rng))
    texts = ["", "a", "né" * 300, "one two  three " * 60, "日本語" * 200, "x" * (langid.CORE + 2 * langid.MARGIN), "y" * 700]
    found = langid.probabilities(pa.array(texts), model)
    for t, p in zip(texts, found):
        assert np.allclose(p, plain_language(t, model), atol=1e-4)
    assert np.allclose(found[[3]], langid.probabilities(pa.array(texts[3:4]), model), atol=1e-5)  # the batch does not matter


def test_language_ties_go_to_the_first_name(spark):
    w = langid.initial(2, np.random.default_rng(0))
    even = langid.Model(["aa", "bb"], {k: v * 0 for k, v in w.items()})
    assert {r["lang_pred"] for r in langid.predict_language(docs_of(spark, ["abc", "abc", "é"]), even).collect()} == {"aa"}


def test_quality_gradient_and_plain_loops():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    p = quality.initial(rng, np.float64)
    chunks = rng.integers(97, 110, (7, quality.CHUNK)).astype(np.int16)
    picks = [(k, (int(rng.integers(quality.WIDTH)), int(rng.integers(97, 110)), int(rng.integers(quality.FILTERS))) if k == "tables" else tuple(rng.integers(0, s) for s in v.shape)) for k, v in p.items() for _ in range(10)]
    target = np.array([0, 1, 1, 0, 1, 0, 1.0])
    assert differences(lambda p: quality.gradients(chunks, target, np.ones(7), p), p, picks) < 1e-6
    model = quality.model_of({k: v.astype(np.float32) for k, v in p.items()})
    model.combine = np.array([0.5, 0.3, -0.2, 0.1])
    texts = ["", "short", "é" * 400, "".join(rng.choice(list("abc def\n"), 1500))]
    for text, score in zip(texts, quality.scores(pa.array(texts), model)):
        data, logits, start = text.encode(), [], 0
        while True:
            padded = [*data[start : start + quality.CHUNK]]
            padded += [quality.PAD] * (quality.CHUNK - len(padded))
            top = [max(sum(model.tables[j, padded[i + j], f] for j in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1)) for f in range(quality.FILTERS)]
            dense = np.maximum(np.maximum(np.array(top) + model.bias, 0) @ model.w1 + model.b1, 0)
            logits.append(float(dense @ model.w2 + model.b2))
            if start + quality.CHUNK >= len(data):
                break
            start += quality.STRIDE
        logit = np.dot([np.mean(logits), max(logits), min(logits), 1], model.combine)
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-4


def test_quality_threshold_and_repeated_rows(spark):
    model = quality.model_of(quality.initial(np.random.default_rng(1)))
    model.prior = 0.3
    docs = docs_of(spark, ["a", "a"]).union(spark.createDataFrame([(None, "a", None, None, 1, 1)], DOCS))
    assert [(r["score"], r["predicted"]) for r in quality.score_quality(docs, model).collect()] == [(0.3, 1)] * 3
    assert quality.keep_quality(docs, model).count() == 3


def test_quality_is_learned_over_the_whole_text(spark):
    good = sentences(150, size=80)
    bad = [" ".join(f"{w}###" for w in t.split()) for t in sentences(150, seed=9, size=80)]
    texts = [x for pair in zip(good, bad) for x in pair] + ODD
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    found = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i]["predicted"] == 1 - i % 2 for i in held]) > 0.95
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found.values())
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs_of(spark, []), model).count() == 0


def test_quality_of_long_texts_is_fitted_on_all_chunks(spark):
    # a fifth of a good text's chunks is bad and the other way round
    rng = np.random.default_rng(4)
    good, bad = (["".join(rng.choice(list(letters), 5)) for _ in range(50)] for letters in ("abcdefghij", "ghijklmnop"))
    labels, texts = [i % 2 for i in range(60)], []
    for label in labels:
        mostly, other = (good, bad) if label else (bad, good)
        texts.append(" ".join(" ".join(rng.choice(other if rng.random() < 0.2 else mostly, 40)) for _ in range(60)))
    model = quality.fit(docs_of(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"), k=10**6, remainder=-1)
    import pyarrow as pa

    (data, offsets), = byte_blocks(pa.array(texts), most=1 << 30)
    owner, start = quality.chunk_starts(np.diff(offsets))
    features = quality.combined(quality.chunk_logits(quality.chunk_matrix(data, offsets, owner, start), model), owner, len(texts))
    scale = np.abs(features).mean(0) + 1e-6
    # at the optimum over all chunks the slope is nearly zero
    slope = (features / scale).T @ (quality.sigmoid(features @ model.combine) - labels) / len(labels) + 1e-3 * model.combine * scale
    assert np.abs(slope).max() < 0.004


def test_chunks_cover_everything():
    lengths = np.array([0, 1, 256, 257, 480, 481, 100_000])
    owner, start = quality.chunk_starts(lengths)
    for i, n in enumerate(lengths):
        seen = np.zeros(n, bool)
        for s in start[owner == i]:
            assert s == 0 or s < n
            seen[s : s + quality.CHUNK] = True
        assert seen.all()


# 9


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [*ODD, *sentences(50), "ab  cd " * 20000, "x" * 50000]
    found = {r["doc_id"]: r for r in token_count.count_tokens(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)
    assert token_count.count_tokens(docs_of(spark, [])).count() == 0


def test_token_batches_are_even_in_bytes(monkeypatch):
    path, sizes = P.path("piece_bpe_32k.model"), []
    count = token_count.counter(path)[0]
    monkeypatch.setitem(token_count._loaded, path, (lambda texts: sizes.append(sum(len(t.encode()) for t in texts)) or count(texts), True))
    texts = ["日本語" * 40, "abc" * 40] * 60
    assert token_count.lengths(texts, path, 4000) == [count([t])[0] for t in texts]
    assert len(sizes) > 3 and all(4000 <= n < 4000 + 360 for n in sizes[:-1])


def test_safe_parts_add_up():
    count, cuts = token_count.counter(P.path("piece_bpe_32k.model"))
    assert cuts
    rng = np.random.default_rng(4)
    for _ in range(60):
        t = "".join(rng.choice(list("ab é▁\n  "), 400))
        parts = token_count.safe_parts(t, 20)
        assert sum(count([p])[0] for p in parts if p) == count([t])[0]


# 10


def test_archives_round_trip(spark):
    htmls = ["<p>a</p>", None, "", "<p>a</p>", "é" * 5000, "<p>a</p>", "x\r\n\r\ny"]
    pages = spark.createDataFrame([(i, f"http://h/{i} \n", h, 0) for i, h in enumerate(htmls)] + [(None, "u", "z", 0)], "page_id long, url string, html string, payload int")
    rows = warc.round_trip(pages).collect()
    found = {r["page_id"]: r for r in rows}
    assert len(rows) == len(found) == len(htmls) + 1
    assert (found[None]["record_type"], found[None]["refers_to"], found[None]["payload_bytes"]) == ("response", None, 1)
    again = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages.union(spark.createDataFrame([(None, "u", "<p>a</p>", 0), (0, "u", "<p>a</p>", 0)], pages.schema))).collect()}
    assert {(None, "revisit", 0), (None, "response", None), (0, "response", None)} <= again
    for i, h in enumerate(htmls):
        data = (h or "").encode()
        first = next(j for j, x in enumerate(htmls) if (x or "") == (h or ""))
        r = found[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
    assert {r["record_type"] for r in warc.round_trip(pages, least=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_reader_and_zip64():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        with z.open("archive/data.warc.gz", "w", force_zip64=True) as member:
            member.write(b"0123456789")
        z.writestr("indexes/index.cdx", "{}")
        z.writestr(zipfile.ZipInfo("packed"), b"a" * 100, compress_type=zipfile.ZIP_DEFLATED)
    archive = warc.Archive(data)
    assert archive.read("archive/data.warc.gz", 3, 4) == b"3456"
    with pytest.raises(ValueError):
        archive.read("archive/data.warc.gz", 8, 4)
    with pytest.raises(ValueError):
        archive.read("packed")
    with pytest.raises(ValueError):
        warc.Archive(io.BytesIO(b"no archive here"))
    extra = b"\x01\x00\x18\x00" + b"".join(x.to_bytes(8, "little") for x in (1 << 33, 1 << 34, 1 << 35))
    assert warc.zip64_fields(extra, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF) == (1 << 33, 1 << 34, 1 << 35)
    assert warc.zip64_fields(b"\x01\x00\x10\x00" + extra[12:], 5, 0xFFFFFFFF, 7) == (5, 1 << 34, 7)


def test_zip64_directory_with_many_members():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for i in range(66000):  # over 65535: the end record is ZIP64
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"end")
    archive = warc.Archive(data)
    assert len(archive.members) == 66001 and archive.read("last") == b"end"


def test_clashing_columns_do_no_harm(spark):
    docs = docs_of(spark, ["a b c d e", "f"]).withColumns({c: F.lit(1) for c in ("n_tokens", "component", "f", "rep", "key", "kept", "block", "row")})
    assert near_duplicates(docs).count() == token_count.count_tokens(docs).count() == mixing.mix(docs).count() == 2
    assert mixing.mixed_documents(docs).columns == docs.columns
