"""The training-data operators against brute force, exact round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from helpers import LABELS, clashing, corpus, frame, odd_documents, shingle_set, words_of

from hduframe.llm import brown_lm, byte_bpe, common, components, exact_dedup, fingerprints, jaccard_join, language_id, packing, quality, sampling, token_counts, toxicity
from hduframe.llm.common import shingles

JSON, WORD_JSON, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
PARTS = ["a", "B", "the", "Ing", " ", "  ", "\n", "\t", "é", "É", "ñ", "'", "'ll", "1", "23", "!", "...", " ", "　", "<|endoftext|>", "Σ", "日本", "😀", "\x1c", "----", "aaaaaaa", "́", "<|", "ß", "÷"]


def odd_texts(n=1500, seed=3):
    chance = random.Random(seed)
    return ["".join(chance.choice(PARTS) for _ in range(chance.randrange(40))) for _ in range(n)] + ["a" * 3000, "ab" * 900, "x " * 500]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


# 3, 4: tokenizers ------------------------------------------------------------------------------------------------------


def test_prefix_counts(library):
    counter = token_counts.PrefixCounter(JSON, PATTERN)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = odd_texts()
    assert counter.counts([t.encode() for t in texts]) == [count(t) for t in texts]
    for text in texts[:120]:
        prefixes, want = counter.prefixes(text), [count(text[:n]) for n in range(len(text) + 1)]
        assert [prefixes.count(n) for n in range(len(text) + 1)] == want
        for budget in (0, 1, 5, 20):
            assert prefixes.fit(budget) == max(n for n, c in enumerate(want) if c <= budget)
    long = counter.prefixes("the rain's falling " * 2000)
    counter.prefix_counts = None  # nothing is encoded again
    assert long.count(19 * 2000) == count("the rain's falling " * 2000) and long.count(19 * 1000 + 3) == count("the rain's falling " * 1000 + "the") and long.fit(1024) > 3000


def test_truncation(spark, library):
    docs = [*odd_documents(), (500, "some words, 'll  and\n\n more " * 300, "en", "s", 0)]
    for r in token_counts.truncate(clashing(frame(spark, docs)), JSON, PATTERN, 20).join(frame(spark, docs).select("doc_id", F.col("text").alias("whole")).distinct(), "doc_id").collect():
        whole = r.whole or ""
        fits = [n for n in range(min(len(whole), 400) + 1) if len(library.encode(whole[:n], add_special_tokens=False).ids) <= 20]
        assert r.text == whole[: max(fits)] or len(whole) == len(r.text)


def test_byte_bpe_matches_library_and_round_trips(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, texts = byte_bpe.DuckBPE(RANKS, PATTERN), odd_texts()
    ids = codec.encode_many([t.encode() for t in texts])
    assert ids == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert codec.decode_many(ids) == [t.encode() for t in texts]
    docs = frame(spark, odd_documents())
    coded = byte_bpe.encode(docs, RANKS, PATTERN)
    back = {r.doc_id: r.text for r in byte_bpe.decode(coded, RANKS, PATTERN).collect()}
    assert back == {r[0]: r[1] or "" for r in odd_documents()}


def test_byte_bpe_of_long_words():
    """Segments of a word join to what the library gives, for random letters and for runs that only their beginning aligns."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, chance = byte_bpe.DuckBPE(RANKS, PATTERN), random.Random(8)
    words = ["".join(chance.choice(letters) for _ in range(n)) for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "日本語中文é") for n in (31, 33, 100, 700, 3000)]
    words += [" " + "a" * 5000, "x" + "-" * 999 + "=" * 333, "ab" * 1500, "abc" * 999, "!" * 4097, "the" * 500, "ing" * 700 + "s", " " * 1300, "-=" * 600 + "-"]
    words.append("".join(chance.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(100_000)))
    got = codec.encode_words([w.encode() for w in words])
    for word, ids in zip(words, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [t for p in [word.encode()] for t in library._core_bpe.encode_single_piece(p)], word[:40]


def test_token_queries_on_odd_documents(spark, library):
    docs = clashing(frame(spark, odd_documents()))
    for r in token_counts.count_tokens(docs, JSON, PATTERN).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024)
    got = byte_bpe.round_trip(docs, RANKS, PATTERN)
    assert got.count() == len(odd_documents())
    assert got.where("doc_id = 1").first().decoded_sha256 == hashlib.sha256(b"").hexdigest()
    empty = docs.limit(0)
    assert token_counts.count_tokens(empty, JSON, PATTERN).count() == byte_bpe.round_trip(empty, RANKS, PATTERN).count() == 0


# 6: packing ------------------------------------------------------------------------------------------------------------


def test_spaceless_encoder():
    library = Tokenizer.from_file(WORD_JSON)
    texts = odd_texts()
    assert packing.SpacelessEncoder(WORD_JSON).encode([t.encode() for t in texts]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_new_plain_words_skip_the_library_and_their_endings_are_remembered():
    library, encoder, asked = Tokenizer.from_file(WORD_JSON), packing.SpacelessEncoder(WORD_JSON), []
    by_library = encoder._by_library
    encoder._by_library = lambda chunks: asked.extend(chunks) or by_library(chunks)
    texts = ["Alpha, beta. été!", "gamma, DELTA. zeta, gamma! über. don't. x<| 7, ..."]
    assert encoder.encode([t.encode() for t in texts[:1]]) + encoder.encode([t.encode() for t in texts[1:]]) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert sorted(asked) == sorted([b",", b".", b"!", b"don't.", b"x<|", b"7,", b"..."])


def check_packing(spark, docs, capacity):
    library = Tokenizer.from_file(WORD_JSON)
    rows = packing.pack_documents(docs, WORD_JSON, capacity).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            some = np.array(ids[k : k + capacity], "<u4")
            want[r.doc_id, k // capacity, k, len(some), zlib.crc32(some.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark):
    docs, _ = corpus(300)
    used, least = check_packing(spark, frame(spark, docs), 512)
    assert used <= least * 1.02 + 1
    check_packing(spark, clashing(frame(spark, odd_documents())), 4096)
    assert packing.pack_documents(frame(spark, []), WORD_JSON).count() == 0


def test_genetic_search_beats_best_fit():
    # three items fill a bin only in the right company, which best fit by length misses
    chance = random.Random(5)
    lengths = []
    for _ in range(12):
        a, b = chance.randrange(20, 45), chance.randrange(20, 35)
        lengths += [a, b, 100 - a - b]
    search = packing.GroupingGenetic(lengths, 100, 1)
    first = next(search.first_packings(1))
    best = search.evolve([], 12, 60)
    assert sorted(i for b in best for i in b) == list(range(36)) and all(search.fill(b) <= 100 for b in best)
    assert len(best) <= len(first) and search.fitness(best) >= search.fitness(first)
    child = search.crossover(first, best)
    assert sorted(i for b in child for i in b) == list(range(36)) and all(search.fill(b) <= 100 for b in child)


# 7: exact dedup --------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    docs = [*odd_documents(), *((100 + k, "hot text" + " " * (k % 3), "en", "s", 9) for k in range(400))]
    for counters in (1024, 3):
        got = exact_dedup.duplicates(clashing(frame(spark, docs)).repartition(5), counters).collect()
        groups = defaultdict(list)
        for r in docs:
            groups[hashlib.sha256("".join(c for c in r[1] or "" if c not in exact_dedup.WHITE_SPACE).encode()).hexdigest()].append(r)
        assert len(got) == len(docs) and sum(r.kept for r in got) == len(groups)
        for r in got:
            group = groups[r.text_sha256]
            keep = min(group, key=lambda d: (-len(d[1] or ""), d[0] is None, d[0] or 0))
            assert (r.keep_id, r.group_size) == (keep[0], len(group)) and (not r.kept or r.doc_id == keep[0])
    kept = exact_dedup.dedup(clashing(frame(spark, docs)))
    assert kept.count() == len(groups) and kept.columns == clashing(frame(spark, docs)).columns
    assert exact_dedup.duplicates(frame(spark, [])).count() == 0


def test_misra_gries_bound():
    chance = random.Random(2)
    rows = ["hot"] * 300 + [f"k{chance.randrange(500)}" for _ in range(600)]
    chance.shuffle(rows)
    summary = exact_dedup.MisraGries(9)
    for at in range(0, len(rows), 7):
        summary.add(Counter(rows[at : at + 7]))
    true = Counter(rows)
    assert len(summary.counts) <= 9 and all(true[k] - len(rows) / 10 <= summary.counts.get(k, 0) <= true[k] for k in true)


# 2: Jaccard join -------------------------------------------------------------------------------------------------------


def brute_components(docs):
    sets = [shingle_set(d[1]) for d in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, d in enumerate(docs):
        if d[0] is not None:
            least[root(k)] = min(least.get(root(k), d[0]), d[0])
    return Counter((d[0], len(sets[k]), least.get(root(k))) for k, d in enumerate(docs))


def near_copies(seed, n, edits):
    """Families of texts, with edits around the threshold, and a passage that many share."""
    chance, docs = random.Random(seed), []
    passage = [f"p{k}" for k in range(60)]
    for family in range(6):
        base = [f"f{family}w{chance.randrange(400)}" for _ in range(chance.choice([6, 30, 90]))]
        for _ in range(n // 6):
            words = list(base)
            for _ in range(chance.randrange(edits)):
                words[chance.randrange(len(words))] = f"e{chance.randrange(10**6)}"
            if chance.random() < 0.3:
                words += passage
            docs.append((len(docs), " ".join(words), "en", "s", 0))
    return docs


@pytest.mark.parametrize(("seed", "crowded", "block"), [(1, 64, 512), (2, 4, 5), (3, 2, 3)])
def test_jaccard_join(spark, monkeypatch, seed, crowded, block):
    monkeypatch.setattr(jaccard_join, "CROWDED", crowded)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1 if seed == 3 else 3)
    docs = [*near_copies(seed, 120, 5), *[(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in odd_documents()]]
    got = jaccard_join.classes(clashing(frame(spark, docs)).repartition(3)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(docs)


def test_jaccard_join_of_a_passage_in_ten_thousand_sets(spark):
    """Sets of 64 shingles, 56 of them of one passage, are alike at 56 / 72; those of which only the last word differs are linked."""
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k, f"{passage} " + " ".join(f"w{k}x{n}" for n in range(8)), "en", "s", 0) for k in range(10_050)]
    docs += [(20_000 + k, docs[k][1] + "y", "en", "s", 0) for k in range(0, 10_050, 201)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(frame(spark, docs).repartition(4)).collect()}
    assert got == {d[0]: (64, d[0] - 20_000 if d[0] >= 20_000 else d[0]) for d in docs}


def test_overlaps_add_up_over_all_crowded_columns(spark):
    """Classes 2 and 3, of 100 shingles, share 4 of their first ones in one block of columns and 6 in another, which comes so late
    among theirs that it alone wouldn't do; together they have what alike sets must have."""
    early = [(1, s, 100, 5, 4) for s in (1, 2, 3, 4)]
    late = [(2, s, 100, 15, 6) for s in (2, 3, 5, 8)]
    rows = [(h, s, n, place, k, s, 10 if s in (2, 3) else k, 0, 85 if s in (5, 8) else 95) for h, s, n, place, k in early + late]
    left = spark.createDataFrame(rows, "h long, s long, n int, place int, k long, root long, total long, outside long, room int")
    assert left.groupBy("h").agg(F.min(F.xxhash64("s")).alias("g")).select("g").distinct().count() == 2
    spread = bytearray([1] * 100 + [0] * 156)
    known = spark.createDataFrame([(s, spread) for s in range(1, 9)], "s long, spread binary")
    found = jaccard_join._crowded(left, known, (80, 100)).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.max("least").alias("least"))
    assert [tuple(r) for r in found.where("overlap >= least").collect()] == [(2, 3, 10, 10)]


def test_classes_whose_first_64_bits_clash():
    digest = bytes(range(16))
    first, second = jaccard_join._two_longs(digest)
    assert jaccard_join._key(digest, frozenset()) == first and jaccard_join._key(digest, frozenset([first])) == second


def test_near_dedup_keeps_one_of_each(spark):
    docs = near_copies(4, 60, 3) + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in odd_documents()]
    kept = jaccard_join.dedup(clashing(frame(spark, docs)))
    assert kept.columns == clashing(frame(spark, docs)).columns
    # empty sets stay one by one; a component keeps its smallest id
    want = Counter(c for (i, n, c), m in brute_components(docs).items() for _ in range(m) if n and i is not None)
    got = Counter(r.doc_id for r in kept.collect() if r.doc_id is not None and shingle_set(r.text))
    assert set(got) == set(want) and all(v == 1 for v in got.values())
    assert jaccard_join.classes(frame(spark, [])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40) if k != 20] + [(100, 100), (50, 70), (70, 60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 21)}, **{k: 21 for k in range(21, 41)}, 50: 50, 60: 50, 70: 50}


def test_shingles_equal_brute_force():
    texts = ["", "  ", "A b c", "a B c d e F", "x " * 50, "é É a\x0bb\x0cc d", *(d[1] or "" for d in odd_documents())]
    for text, hashes in zip(texts, shingles([t.encode() for t in texts]), strict=True):
        assert len(hashes) == len(shingle_set(text))
    same = [list(h) for h in shingles([b"The Cat sat on the mat", b"the cat\nsat  on the MAT "])]
    assert same[0] == same[1]


# 10: fingerprints ------------------------------------------------------------------------------------------------------


def test_fingerprints_and_densification(spark):
    docs = clashing(frame(spark, odd_documents()))
    hasher = fingerprints.MinHash()
    got = Counter((r.doc_id, bytes(r.fingerprint)) for r in fingerprints.fingerprints(docs).collect())
    assert got == Counter((d[0], hasher.of(next(shingles([(d[1] or "").encode()])))) for d in odd_documents())
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    # a bin's draws go on until one is filled, however many that takes
    few = fingerprints.MinHash(1 << 11)
    two = few.of(np.array([1, 1 << 63], np.uint64))
    values = {x for b in two for x in (b >> 4, b & 15)}
    assert len(two) == 1 << 10 and len(values) <= 2


def test_minhash_estimates_jaccard():
    chance, hasher = np.random.default_rng(0), fingerprints.MinHash()
    for n, least, most in ((20, 0.2, 0.35), (400, 0.45, 0.55), (2000, 0.75, 0.85)):
        errors = []
        for share in (least, most):
            both = int(2 * n * share / (1 + share))
            for _ in range(40):
                pool = chance.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2)
                a, b = np.unique(pool[:n]), np.unique(pool[n - both :])
                errors.append(hasher.likeness(hasher.of(a), hasher.of(b)) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    one = np.array([5], np.uint64)
    assert len(hasher.of(one)) == 256 and hasher.likeness(b"", b"") == 1 and hasher.likeness(b"", hasher.of(one)) == 0


@pytest.mark.parametrize("rows", ["odd", "corpus", "one", "none"])
def test_edited_and_next(spark, rows):
    docs = {"odd": odd_documents(), "corpus": corpus(90)[0], "one": [(3, "one two three four five six", "en", "s", 0)], "none": []}[rows]
    got = fingerprints.compare_edited(clashing(frame(spark, docs)).repartition(4)).collect()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = Counter()
    for k, d in enumerate(order):
        text, following = d[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        want[d[0], len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    hasher = fingerprints.MinHash()
    by_id = {d[0]: base64.b64encode(hasher.of(next(shingles([(d[1] or "").encode()])))).decode() for d in docs}
    assert all(r.fingerprint == by_id[r.doc_id] for r in got)
    # likenesses against those of the sets themselves, and the edited text's fingerprint against its own
    following = {d[0]: order[(k + 1) % len(order)] for k, d in enumerate(order)}
    once = Counter(d[0] for d in docs)
    for r in got:
        if once[r.doc_id] > 1 or r.doc_id is None or once[following[r.doc_id][0]] > 1:
            continue
        text, after = next(d[1] or "" for d in docs if d[0] == r.doc_id), following[r.doc_id][1] or ""
        edited = fingerprints.edited_text(text, after)
        assert r.edited_fingerprint == base64.b64encode(hasher.of(next(shingles([edited.encode()])))).decode()
        for estimate, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingle_set(text), shingle_set(other)
            assert abs(estimate - (len(a & b) / len(a | b) if a | b else 1)) < 0.15


# 5: language model -----------------------------------------------------------------------------------------------------


def test_brown_model(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "KNOWN", 30)
    monkeypatch.setattr(brown_lm, "WORDS", 20)
    docs = [*corpus(250)[0], *((r[0] + 5000 if r[0] is not None else None, *r[1:]) for r in odd_documents())]
    given = clashing(frame(spark, docs))
    got = brown_lm.score(given, *brown_lm.train(given)).collect()
    out = lambda d: d[0] is not None and zlib.crc32(str(d[0]).encode()) % 10 == 0
    counts = Counter(w for d in docs if not out(d) for w in [*words_of(d[1]), None])
    total, none = sum(counts.values()), len(counts) + 1
    want = Counter()
    for d in docs:
        words = [*words_of(d[1]), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * none)) for w in words)
        want[d[0], out(d), len(words), sum(counts[w] > 0 for w in words), total, round(base, 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    empty = frame(spark, [])
    assert brown_lm.score(empty, *brown_lm.train(empty)).count() == 0


def told_apart(words):
    """Hash and ending of each word, as the model has them."""
    (run,) = brown_lm.tokenised([b" ".join(words)])
    return run.hashes, run.endings


@pytest.mark.parametrize("known", [200_000, 60])
def test_words_beyond_the_items_have_their_own_class(spark, monkeypatch, known):
    """Nouns follow articles and verbs follow nouns; all share one ending. A few of them are items, others known, others not. The
    model is a distribution, and scores are what its tables give word by word."""
    monkeypatch.setattr(brown_lm, "KNOWN", known)
    monkeypatch.setattr(brown_lm, "WORDS", 30)
    chance = random.Random(5)
    nouns, verbs = [f"n{k}xxxx" for k in range(60)], [f"v{k}xxxx" for k in range(60)]
    pick = lambda some: some[min(int(chance.expovariate(0.06)), 59)]
    sentence = lambda: f"the {pick(nouns)} {pick(verbs)}"
    rows = [(k, " ".join(sentence() for _ in range(20)), "en", "s", 0) for k in range(400)]
    rows.append((400, " ".join(sentence() for _ in range(60_000)), "en", "s", 0))  # longer than a run
    docs = frame(spark, rows)
    model, counts = brown_lm.train(docs)
    items = model.items
    true = Counter(w.encode() for r in rows if zlib.crc32(str(r[0]).encode()) % 10 for w in r[1].split())
    words = sorted(true)
    hashes, endings = told_apart(words)
    places, numbers = items.read(hashes, endings)
    far = {r.h: (r.c, r["class"]) for r in counts.collect()}
    assert model.far == (known == 60) and len(words) > 110
    kinds, inside, logs = {}, Counter(), {}
    for word, h, place, item in zip(words, hashes.view(np.int64).tolist(), places.tolist(), numbers.tolist(), strict=True):
        c, own = (int(items.counts[place]), None if model.of_place[place] < 0 else int(model.of_place[place])) if place >= 0 else far[h]
        assert c == true[word] and (own is None) == (0 <= place < items.words or c < brown_lm.LEAST)
        kinds[word] = int(model.classes[item]) if own is None else own
        logs[word] = math.log10(c + 0.1) - model.within[own] if own is not None else model.emission[item] + (0 if item < items.words else math.log10(c + 0.1))
        inside[kinds[word]] += 10 ** logs[word]
    end = int(model.classes[items.end])
    inside[end] += 10 ** model.emission[items.end]
    assert all(0.8 < x <= 1 + 1e-9 for x in inside.values())
    assert all(0.8 < sum(10**t * inside.get(c, 0) for c, t in enumerate(line)) <= 1 + 1e-9 for line in model.transition)
    often = [w for w, c in true.items() if c >= 20 and w != b"the"]
    sides = [{kinds[w] for w in often if w[:1] == x} for x in (b"n", b"v")]
    assert not sides[0] & sides[1]  # one ending's class for all of them without their own counts
    context = {w: kinds[w] if p >= 0 else int(model.classes[i]) for w, p, i in zip(words, places.tolist(), numbers.tolist(), strict=True)}
    got = {r.doc_id: r.score for r in brown_lm.score(docs, model, counts).collect()}
    for doc_id, text, *_ in [*rows[:40], rows[-1]]:
        want, before = 0.0, end
        for word in text.encode().split():
            if word not in true:
                item = int(items.read(*told_apart([word]))[1][0])
                kinds[word] = context[word] = int(model.classes[item])
                logs[word] = model.emission[item] + math.log10(0.1)
            want += model.transition[before, kinds[word]] + logs[word]
            before = context[word]
        want += model.transition[before, end] + model.emission[items.end]
        assert abs(got[doc_id] - want) < 1e-6 * max(1, abs(want))


def test_long_texts_are_read_in_parts():
    text = b"one two  three\nfour " * 5
    (whole,) = brown_lm.tokenised([b"a b", text, b"", b"c"])
    parts = list(brown_lm.tokenised([b"a b", text, b"", b"c"], 30))
    assert len(parts) > 3 and np.array_equal(np.concatenate([r.hashes for r in parts]), whole.hashes)
    kinds, steps, owners, before = {h: k for k, h in enumerate(sorted(set(whole.hashes.tolist())), 1)}, [], [], 0
    for r in parts:
        row = r.row(np.array([kinds[h] for h in r.hashes.tolist()], np.int64), 0, before)
        before = row[-1]
        steps += zip(row[:-1].tolist(), row[1:].tolist(), strict=True)
        owners += r.texts().tolist()
    row = whole.row(np.array([kinds[h] for h in whole.hashes.tolist()]), 0, 0).tolist()
    assert steps == list(zip(row, row[1:], strict=False)) and owners == whole.texts().tolist()
    assert common.part_runs([]) is not None and not list(common.part_runs([]))
    assert b"".join(p for _, ps, _, _ in common.part_runs([b"x" * 100 + b" y"], 10) for p in ps) == b"x" * 100 + b" y"


def test_exchange_finds_classes():
    # items of one kind are followed by those of the other
    one, other = [1, 2, 3, 5], [4, 6, 7, 8]
    counts = np.zeros((9, 9))
    counts[np.ix_(one, other)], counts[np.ix_(other, one)], counts[0, one], counts[other, 0] = 30, 28, 2, 2
    counts *= np.linspace(1, 2, 9)[:, None]
    found = brown_lm.exchange_clusters(counts, 3, 10, 0)
    assert found[0] == 0 and len(set(found[one])) == 1 and len(set(found[other])) == 1 and found[1] != found[4]


# 1, 8, 9: classifiers --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus(600)
    return frame(spark, docs), spark.createDataFrame(labels, LABELS), {r[0]: r for r in labels}


def test_quality(spark, labelled):
    docs, labels, truth = labelled
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and (r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    odd = clashing(frame(spark, odd_documents()))
    assert quality.score(odd, model).count() == len(odd_documents()) and quality.keep_good(odd, model).columns == odd.columns
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.0} and quality.score(odd.limit(0), model).count() == 0


def test_toxicity(spark, labelled):
    docs, labels, truth = labelled
    nulls = spark.createDataFrame([(None, None, None), (1, None, None)], LABELS)
    model = toxicity.train(docs, labels.unionByName(nulls))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id][2] for r in held]) > 0.97
    odd = clashing(frame(spark, odd_documents()))
    assert not any(r.predicted for r in toxicity.score(odd, model).collect()) and toxicity.keep_clean(odd, model).count() == len(odd_documents())
    assert toxicity.score(odd, toxicity.train(docs, labels.limit(0))).count() == len(odd_documents())


def test_toxic_pairs_of_words_that_are_harmless_alone(spark):
    """Either word is as frequent in clean documents as in toxic ones; only both together are toxic."""
    chance, docs, labels = random.Random(4), [], []
    for k in range(3000):
        one, other = chance.random() < 0.5, chance.random() < 0.5
        words = [chance.choice(["river", "house", "light", "stone", "paper", "table"]) for _ in range(8)] + [chance.choice(["these", "those"]), chance.choice(["vermin", "people"])]
        words[-2:] = ["strangers" if one else "neighbours", "rotten" if one == other else "gentle"]
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(one and one == other or not one and one != other)))
    share = lambda w: np.mean([t for (_, text, *_), (_, _, t) in zip(docs, labels, strict=True) if w in text.split()])
    assert abs(share("strangers") - 0.5) < 0.05 and abs(share("rotten") - 0.5) < 0.05
    frame_ = frame(spark, docs)
    model = toxicity.train(frame_, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in toxicity.score(frame_, model).collect() if r.held_out}
    assert np.mean([(r.score > 0.5) == bool(labels[k][2]) for k, r in got.items()]) > 0.95


def test_factorization_machine_learns_pairs():
    chance = np.random.default_rng(3)
    rows = [np.flatnonzero(chance.random(6) < 0.5) for _ in range(2000)]
    labels = np.array([float(0 in r and 1 in r) for r in rows])
    machine = toxicity.FactorizationMachine(6)
    machine.fit(rows, labels, np.ones(len(rows)), epochs=40)
    assert np.mean([(machine.score(r) > 0.5) == y for r, y in zip(rows, labels, strict=True)]) > 0.98


def test_sample_of_a_label_with_millions_of_rows(spark):
    rows = spark.range(10_000_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("label"))  # times 2^40, more than a bigint holds
    got = sampling.sampled_ids(rows, 50).collect()
    assert 40 <= len({r.doc_id for r in got}) <= 50 and {r.weight for r in got} == {10_000_000 / len(got)}


def test_sample_with_a_repeated_id(spark):
    rows = spark.range(100_300).select(F.when(F.col("id") < 100_000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("label"))
    got = sampling.sampled_ids(rows, 1000)
    assert got.count() == got.distinct().count() <= 301
    texts = sampling.sample_texts(rows.select("doc_id", F.when(F.col("doc_id") > 7, "a").alias("text")), got).collect()
    assert len(texts) == got.count() and {r.text for r in texts} <= {"a", ""}


def test_language(spark, labelled):
    docs = labelled[0]
    model = language_id.train(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language_id.identify(docs, model).collect() if r.held_out]
    assert held and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    assert set(model.pair_machines) == {("de", "en"), ("es", "fr")}
    odd = {r.doc_id: r.lang_pred for r in language_id.identify(clashing(frame(spark, odd_documents())), model).collect()}
    assert odd[1] == odd[2] == odd[3] == odd[9] == "und" and odd[4] in ("en", "de", "fr", "es")
    untaught = language_id.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs.limit(5), untaught).collect()} == {"und"}


# pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(400, seed=9)
    docs += [(1000 + k, docs[k][1] + " ", *docs[k][2:]) for k in range(0, 60, 2)]  # exact copies but for white space
    docs += [(2000 + k, docs[k][1] + " end", *docs[k][2:]) for k in range(0, 60, 3)]  # near copies
    docs += [(3000 + k, *r[1:]) for k, r in enumerate(odd_documents())]
    clashing(frame(spark, docs)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, now, str(tmp_path)).write.parquet(path)
        after = spark.read.parquet(path)
        if k < 4:
            assert after.columns == now.columns, name
            kept.append({r.doc_id for r in after.select("doc_id").collect()})
        now = after
    toxic = {k for k, _, t in labels if t}
    poor = {k for k, q, _ in labels if not q}
    clean = {k for k, q, t in labels if q and not t}
    assert len(kept[0] & toxic) < 0.05 * len(toxic) and len(clean - kept[0]) < 0.02 * len(clean)
    assert len(kept[1] & poor) < 0.05 * len(poor) and len(clean - kept[1]) < 0.05 * len(clean)
    texts = {d[0]: d[1] for d in docs}
    bare = [("".join((texts[k] or "").split())) for k in kept[2]]
    assert len(bare) == len(set(bare)) and {"".join((texts[k] or "").split()) for k in kept[1]} == set(bare)
    left = [shingle_set(texts[k]) for k in kept[3]]
    assert not any(a and 100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    assert {r.doc_id for r in now.collect()} == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
