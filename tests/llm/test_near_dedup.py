"""The pipeline's near dedup against brute force over all pairs."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from canopy.llm import near_dedup, simhash


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    kept, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingle_set(t)
        if not any(s == k or len(s & k) * 5 >= len(s | k) * 4 and s for k in kept):
            kept.append(s)
            out.append(i)
    return Counter(out)


def corpus(n):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \n"), (3, rows[3][1]), (None, rows[5][1]), (None, "alone without an id")]


def test_stage_drops_all_near_copies_and_only_them(spark, monkeypatch):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    want = brute_kept(rows)
    for heads in (near_dedup.HEADS, 3):
        monkeypatch.setattr(near_dedup, "HEADS", heads)
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert got.columns == docs.columns
        assert Counter(r["doc_id"] for r in got.collect()) == want
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_copies_beyond_two_bits_are_dropped_and_dissimilar_texts_stay(spark):
    words = [f"w{k}" for k in range(100)]
    edit = lambda *at: " ".join("new" if k in at else w for k, w in enumerate(words))
    rows = [(1, edit()), (2, edit(50)), (3, edit(20, 70)), (4, edit(10, 30, 50, 70, 90)), (5, edit(20, 45, 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4, 5]


def test_a_large_group_of_dissimilar_copies_is_not_paired_with_itself(spark, monkeypatch):
    """Copies with four new words each keep most of their text, yet are no near copies of each other; pairs must follow the group's size, not its square."""
    rng, met, thinned = random.Random(5), [], near_dedup._thinned
    base = [f"w{k}" for k in range(150)]

    def edited(i, edits):
        words = list(base)
        for k in rng.sample(range(5, 145, 8), edits):
            words[k] = f"new{i}x{k}"
        return " ".join(words)

    def counted(pairs, *rest):
        met.append(pairs.count())
        return thinned(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_thinned", counted)
    for size in (40, 120):  # 120 are hot, 40 are not
        rows = [(0, " ".join(base)), *((i, edited(i, 4)) for i in range(1, size)), *((i, edited(i, 1)) for i in range(size, size + 10))]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        met.clear()
        got = corpus_pipeline.near_dedup(spark, docs, "")
        assert Counter(r["doc_id"] for r in got.collect()) == brute_kept(rows) == Counter(range(size))
        assert sum(met) <= 4 * len(rows), (size, met)


def test_simhash_links_are_candidates_and_checked_exactly(spark, monkeypatch):
    """The stage's first candidates are the operator's: the components of five-word fingerprints within two bits. Links below the similarity drop nothing."""
    rng, seen, linked_pairs = random.Random(7), [], near_dedup.linked_pairs
    chorus = "sing it once again now " * 60
    words = [f"w{k}" for k in range(300)]
    rows = [(i, chorus + " ".join(f"v{rng.randrange(99)}" for _ in range(6))) for i in range(8)]  # one loop, other words behind: near in bits, not in shingles
    rows += [(10 + i, " ".join([*words[:-1], f"end{i}"])) for i in range(8)] + [(30 + i, " ".join(rng.sample(words, 60))) for i in range(8)] + [(50, rows[0][1])]

    def told(described, sets):
        found = linked_pairs(described, sets)
        names = {r["id"]: r["doc_id"] for r in described.join(sets.select("row", "id"), "row").select("id", "doc_id").collect()}
        seen.append({(names[r["a"]], names[r["b"]]) for r in found.collect()})
        return found

    monkeypatch.setattr(near_dedup, "linked_pairs", told)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    prints = {i: simhash.fingerprint(t.encode(), 5) for i, t in rows if i != 50}
    lowest = {i: i for i in prints}
    for _ in prints:
        lowest = {i: min(lowest[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
    want = {(low, i) for i, low in lowest.items() if low < i}
    assert seen == [want]
    assert any(b < 10 for _, b in want) and any(10 <= b < 30 for _, b in want)
    assert got == brute_kept(rows)
    assert {i for i in got if i < 30} == {*range(8), 10}
