"""Near-duplicate operators and the pipeline against brute force."""

import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import public_tokenizers
import pytest

from textveil.llm import jaccard_join as J
from textveil.llm.components import components
from textveil.llm.packing import cut
from textveil.llm.substring_dedup import compact_windows, cut_words, passages, repeats, without_repeats
from textveil.llm.words import mixed, shingles, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node int, key string, c int, __x string"


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def frame(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "k", 2, "x") for (i, t), s in zip(texts, sources or ["a"] * len(texts))], DOCS)


def jaccard_components(texts, n=4, percent=85):
    def shingle(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets, parent = [shingle(t) for _, t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(s), (least.get(root(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(texts, sets)))


def near_copies(rng):
    texts = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, "one two three four"), (6, " \n"), (None, "no id here at all"), (None, "no id here at all"), (7, "é É one two three")]
    for k in range(12):
        base, n = words(rng, rng.choice([5, 30, 120, 400])), rng.randrange(1, 12)
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 25) + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.8, 1))]
            texts.append((len(texts) + 10, " ".join(w)))
    texts += [texts[12], texts[20], (13, texts[30][1])]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [J.BLOCK, 300])
def test_jaccard_join(spark, block):
    texts = near_copies(random.Random(7))
    got = J.join(frame(spark, texts).repartition(3), block=block)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == jaccard_components(texts)


def shuffled(spark):
    return sum(x.shuffleWriteBytes() for x in stages(spark))


def stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


@pytest.mark.parametrize("changes", [1, 6])  # all alike, and in one candidate group but hardly any alike
def test_large_group_is_not_copied_from_block_to_block(spark, changes):
    rng = random.Random(changes)
    base, written = words(rng, 150), []
    for n in (40, 160):
        texts = []
        for i in range(n):
            w = list(base)
            for at in rng.sample(range(150), changes):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append((i, " ".join(w)))
        before = shuffled(spark)
        got = J.join(frame(spark, texts), block=600, guests=6000)
        assert Counter(tuple(r) for r in got.collect()) == jaccard_components(texts)
        written.append(shuffled(spark) - before)
    assert written[1] < 6 * written[0]  # four times the sets


def test_links_between_finds_all_alike():
    rng = random.Random(3)
    texts = [t for _, t in near_copies(rng)]
    sets = [s for s in map(J.shingle_set, texts) if len(s)]
    for _ in range(20):
        home = rng.sample(range(len(sets)), len(sets) // 2)
        guests = rng.sample(range(len(sets)), len(sets) // 3)
        links = J.links_between([sets[h] for h in home], home, [sets[g] for g in guests], guests)
        parent = {k: k for k in range(len(sets))}

        def root(k):
            return k if parent[k] == k else root(parent[k])

        def alike(a, b):
            return 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))

        for a, b in links:
            parent[root(a)] = root(b)
        found = {(a, b) for a in guests for b in home if root(a) == root(b)}
        for a in guests:
            for b in home:
                if alike(a, b):
                    parent[root(a)] = root(b)
        assert found == {(a, b) for a in guests for b in home if root(a) == root(b)}


def test_jaccard_join_of_nothing(spark):
    assert J.join(frame(spark, [])).count() == 0
    assert J.one_of_each(frame(spark, [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, None)])).select("doc_id").distinct().count() == 2


def test_prefix_keys_never_miss():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2**63, rng.integers(2, 120)).astype(np.uint64))
        k = int(rng.integers(0, max(2, len(a) // 6)))
        b = np.unique(np.r_[np.delete(a, rng.integers(0, len(a), int(rng.integers(0, k + 1)))), rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            often = np.sort(rng.choice(np.union1d(a, b), 1 + len(a) // 10, replace=False))
            ranks = rng.permutation(len(often))
            assert len(np.intersect1d(J.neighbour_keys(J.prefix(a, often, ranks)), J.neighbour_keys(J.prefix(b, often, ranks))))


def test_tree_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = []
        for _ in range(rng.integers(1, 6)):
            base = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
            for _ in range(rng.integers(1, 8)):
                s = base.copy()
                s[rng.integers(0, len(s), rng.integers(0, max(1, len(s) // 8) + 1))] = rng.integers(0, 2**63)
                sets.append(np.unique(s))

        def rooted(links):
            parent = list(range(len(sets)))

            def root(k):
                while parent[k] != k:
                    k = parent[k]
                return k

            for a, b in links:
                parent[root(a)] = root(b)
            return [min(j for j in range(len(sets)) if root(j) == root(k)) for k in range(len(sets))]

        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * (i := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - i)]
        assert rooted(J.spanning_links(sets)) == rooted(pairs)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(200, 240)] + [(300, k) for k in range(301, 330)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_compact_windows_by_definition():
    """Every run of the width lies in the one window of each pair of functions that has its least hashes as roots."""
    from textveil.llm.substring_dedup import PAIRS, _SEEDS

    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 30, n).astype(np.uint64) for n in (3, 40, 12, 0, 25, 8)]
    which, key, first, last, one, two = compact_windows(sequences, 8)
    got = Counter((int(w), int(a), int(x), int(y)) for w, f, t, x, y in zip(which, first, last, one, two) for a in range(f, t + 1))
    want = Counter()
    for k, s in enumerate(sequences):
        for pair in range(PAIRS):
            values = [mixed(s ^ _SEEDS[2 * pair + j]) for j in (0, 1)]
            want.update((k, a, *(a + int(v[a : a + 8].argmin()) for v in values)) for a in range(len(s) - 7))
    assert got == want
    keys = {(int(k), int(sequences[w][x]), int(sequences[w][y])) for k, w, x, y in zip(key, which, one, two)}
    assert len(keys) == len({k for k, _, _ in keys})  # a key stands for two shingles


def test_repeats(spark):
    rng = random.Random(4)
    shared, near = words(rng, 60), words(rng, 80)
    changed = [*near[:30], "other", *near[31:]]
    inserted = [*near[:40], "more", *near[40:]]
    texts = [(1, words(rng, 100) + shared + words(rng, 40)), (2, shared + words(rng, 30)), (3, words(rng, 300)), (4, words(rng, 20) + near), (5, changed + words(rng, 5)), (6, words(rng, 9) + inserted), (7, words(rng, 10) + shared[:49] + words(rng, 10))]
    texts += [(k, words(rng, 5) + shared + words(rng, 5)) for k in range(10, 40)]
    rows = [(i, " ".join(w)) for i, w in texts] + [(50, None), (51, ""), (None, " ".join(shared)), (3, texts[2][1] and " ".join(texts[2][1]))]
    docs = frame(spark, rows).repartition(4)
    got = repeats(docs).collect()
    found = {r.doc_id: r for r in got}
    assert set(found) == {2, 5, 6, *range(10, 40), None}
    for k in (2, *range(10, 40)):
        assert (found[k].n_words, found[k].similarity, found[k].source_id < k) == (60, 1.0, True)
    assert (found[None].start_word, found[None].n_words) == (0, 60)  # a row without an id comes last
    assert found[5].source_id in (4,) and 78 <= found[5].n_words <= 82 and found[6].n_words >= 78
    kept = {r.doc_id: r.text for r in without_repeats(docs, chars_col="n_chars").collect() if r.doc_id is not None}
    assert kept[1] == rows[0][1] and shared[0] not in kept[2].split() and len(kept[2].split()) == 30 and kept[50] is None and kept[51] == ""
    assert without_repeats(docs).columns == docs.columns and repeats(frame(spark, [])).count() == 0


def test_passages_and_cutting():
    rng = random.Random(6)
    a, b = words(rng, 200), words(rng, 150)
    b[50:110] = a[20:80]
    sa, sb = (shingles(word_hashes(" ".join(w)), 5) for w in (a, b))
    assert passages(sa, sb, 46) == [(20, 76, 50, 106, 1.0)]
    same = shingles(word_hashes("so " * 500), 5)
    assert passages(same, same, 46)[0][-1] == 1.0
    assert cut_words("  a b\nc d  e", [(1, 2)]) == "  a d  e" and cut_words("a b", [(0, 2)]) == "" and cut_words("é 日", [(0, 1)]) == "日"


def test_pipeline(spark, tmp_path):
    """All stages by brute force. Sources are alike in size, so that each document is used once."""
    import corpus_pipeline
    from textveil.llm.quality import BUCKETS, PRIOR, THRESHOLD
    from textveil.llm.tokens import TextEncoder

    rng = random.Random(9)
    shared = words(rng, 55)
    plain = [(k, words(rng, 60 + k)) for k in range(20)]
    texts = plain + [(k + 20, [*plain[k][1][:-1], "z"]) for k in range(5)] + [(k, words(rng, 30) + shared) for k in range(30, 34)] + [(k, ["SO!!"] * 3) for k in range(40, 44)] + [(k, words(rng, 4) * 20) for k in range(44, 47)]
    texts += [(k, [f"{rng.choice('abcd')}!!" for _ in range(60)]) for k in range(47, 60)]
    rows = [(i, " ".join(w)) for i, w in texts]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(15)] + [(50, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def grams(w):
        crc = [zlib.crc32(x.encode()) for x in w]
        return [c % BUCKETS for c in crc] + [BUCKETS + (a * 31 + b) % BUCKETS for a, b in zip(crc, crc[1:])]

    raw = Counter(g for _, w in texts for g in grams(w))
    good = Counter(g for i, w in texts if i < 15 for g in grams(w))

    def ratio(g):
        kind = g >= BUCKETS
        total = [sum(n for x, n in c.items() if (x >= BUCKETS) == kind) for c in (raw, good)]
        return log((good[g] + PRIOR) / (raw[g] * total[1] / total[0] + PRIOR))

    ratios = {g: ratio(g) for g in raw}

    def keeps(w):
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        return len(w) >= 20 and 100 * len(again) <= 30 * len(w) and sum(ratios[g] for g in grams(w)) / len(grams(w)) >= THRESHOLD

    left = [(i, t) for i, t in rows if keeps(t.split())]
    assert {i for i, _ in left} >= set(range(25)) and not {i for i, _ in left} & set(range(40, 47))
    linked = {i: c for i, _, c in jaccard_components(left)}
    left = [(i, t) for i, t in left if linked[i] == i]
    seen, out = set(), []
    for i, t in sorted(left):
        w = t.split()
        gone = {p for k in range(len(w) - 49) if tuple(w[k : k + 50]) in seen for p in range(k, k + 50)}
        seen |= {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        if len(gone) < len(w):
            out.append((i, cut_words(t, [(p, 1) for p in gone])))
    known, want = TextEncoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in out:
        ids = np.append(known.ids(t), 0).astype("<u4")
        want.update((i, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids))))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert floor(0.5) == 0 and len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1


def test_repeats_behind_an_earlier_part(spark):
    """An earlier document that holds only part of a passage does not keep the others from each other."""
    rng = random.Random(11)
    texts = []
    for group in range(12):
        shared = words(rng, 60)
        texts += [(1000 * group, words(rng, 30) + shared[:49] + words(rng, 30))] + [(1000 * group + k, words(rng, 30) + shared + words(rng, 30)) for k in (1, 10, 11, 12)]
    got = repeats(frame(spark, [(i, " ".join(w)) for i, w in texts]).repartition(4)).collect()
    assert {r.doc_id for r in got} == {1000 * group + k for group in range(12) for k in (10, 11, 12)} and {r.n_words for r in got} == {60}


def test_pipeline_stage_takes_out_copies_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(12)
    base = words(rng, 100)
    texts = [(1, " ".join(base)), (2, " ".join(base + words(rng, 20))), (3, " ".join(words(rng, 100)))]  # 96 of 116 runs of five words: 0.83
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, frame(spark, texts), "").collect()} == {1, 3}


def test_passages_at_any_place_of_a_shingle():
    rng = random.Random(13)
    part, end = words(rng, 60), words(rng, 20)
    sa, sb, sc, sd = (shingles(word_hashes(" ".join(w)), 5) for w in (
        words(rng, 5) + part + words(rng, 5),
        words(rng, 10) + part[:30] + words(rng, 160) + part + end,
        words(rng, 5) + part[:30] + ["other"] + part[31:],
        words(rng, 10) + part[31:36] + words(rng, 50) + part,
    ))
    assert passages(sa, sb, 46) == [(5, 61, 200, 256, 1.0)]
    assert [f[:4] for f in passages(sc, sd, 46)] == [(5, 61, 65, 121)]


@pytest.mark.parametrize("inserted", range(9, 15))
def test_passages_over_as_wide_a_gap_as_the_similarity_allows(inserted):
    rng = random.Random(14)
    part = words(rng, 98)
    sa, sb = (shingles(word_hashes(" ".join(w)), 5) for w in (part[:49] + words(rng, inserted) + part[49:], part))
    assert [f[:4] for f in passages(sa, sb, 46)] == [(0, 94 + inserted, 0, 94)]


def test_enough_hash_functions():
    """Of two runs at the least similarity 98 in 100 agree in a pair of hash functions."""
    from textveil.llm.substring_dedup import PAIRS, SIMILARITY

    assert (1 - SIMILARITY**2) ** PAIRS < 0.02


def linked(rows, batches, whole):
    """The links, as (doc, place, doc0, place0), and the windows marked, of rows that come in several batches."""
    from textveil.llm.substring_dedup import _linked

    links, marked, held, old = set(), [], np.empty((3, 0), np.int64), 0
    for part in batches:
        data = np.concatenate([held, np.array([rows[k] for k in part]).T], axis=1)
        batch, held = _linked(data, old, whole)
        old = held.shape[1]
        links |= {(r["doc"], r["place"], r["doc0"], r["place0"]) for r in batch.to_pylist() if r["doc0"] is not None}
        marked += [(r["key"], r["doc"], r["place"]) for r in batch.to_pylist() if r["doc0"] is None]
    return links, marked


def test_all_windows_of_a_key_are_linked():
    """Every place of the later document with every place of the first one, also if a batch ends between them."""
    rows = [[1, doc, place] for doc, place in ((3, 5), (3, 70), (500, 10), (500, 900), (600, 1))]
    want = {(doc, place, 3, other) for doc, place in ((500, 10), (500, 900), (600, 1)) for other in (5, 70)}
    for batches in ([range(5)], [range(2), range(2, 4), range(4, 5)], [range(4), range(4, 5)]):
        assert linked(rows, batches, {}) == (want, [])
    wide = [[1, 3, place] for place in range(9)] + [[1, 4, 0], [2, 5, 0]]
    assert linked(wide, [range(11)], {}) == ({(4, 0, 3, -1)}, [])  # too many places: anywhere


def test_hot_keys_are_linked_in_parts():
    from textveil.llm.substring_dedup import PARTS, part_key, parts_of

    hot = np.array([-5, 77], np.int64)
    names = parts_of(hot)
    assert len(names) == 2 * PARTS and names[int(part_key(hot[1:], np.uint64(3))[0])] == 77
    key = int(part_key(hot[:1], np.uint64(1))[0])
    links, marked = linked([[key, doc, 9] for doc in (2, 4, 8)], [range(2), range(2, 3)], names)
    assert links == {(4, 9, 2, 9), (8, 9, 2, 9)} and marked == [(-5, 2, 9)]


def test_run_keys_and_windows_that_repeat():
    from textveil.llm.substring_dedup import again, run_keys

    s = np.array([3, 4, 5, 6] * 3 + [9], np.uint64)
    for width in (1, 2, 3, 4, 5, 7, 8, 13, 14):
        keys = run_keys(s, width)
        runs = [tuple(s[k : k + width]) for k in range(len(s) - width + 1)]
        assert len(keys) == len(runs) and len(set(zip(keys.tolist(), runs))) == len(set(keys.tolist())) == len(set(runs))
    which, key, first = np.zeros(9, int), np.r_[np.ones(8, int), 2], np.arange(9)
    assert again(which, key, first, key, key, 3).tolist() == [False, True, True, False, True, True, False, True, False]
    assert not again(which, key, first, first, key, 3).any()


def test_passages_of_repeated_words():
    """Words repeated over and over are one passage, also if there are more of them than in the earlier document."""
    rng = random.Random(31)
    sa, sb = (shingles(word_hashes(" ".join(w)), 5) for w in (words(rng, 20) + ["of"] * 900 + words(rng, 20), ["of"] * 60 + words(rng, 9)))
    assert [f[:2] for f in passages(sa, sb, 46)] == [(20, 916)]
    line = words(rng, 31)
    many = shingles(word_hashes(" ".join(line * 300)), 5)
    changed = shingles(word_hashes(" ".join((line[:4] + ["other"] + line[5:]) * 300)), 5)
    assert passages(changed, many, 46) == []  # 26 of 36 different runs: 0.72, at 90,000 places
    assert [f[:2] for f in passages(many[:5000], many, 46)] == [(0, 5000)]


def test_repeats_with_hot_keys(spark, monkeypatch):
    """Results hold where signatures are dealt to parts, and with several turns."""
    from textveil.llm import substring_dedup as S

    rng = random.Random(21)
    shared, line = words(rng, 60), words(rng, 30)
    texts = [(k, " ".join(words(rng, 30) + shared + words(rng, 30) + line + words(rng, 30))) for k in range(40)]
    docs = frame(spark, texts)
    plain = repeats(docs).collect()
    keyed = docs.select("doc_id", "text")
    hot = np.unique(compact_windows([shingles(word_hashes(t), 5) for _, t in texts], 46)[1])
    monkeypatch.setattr(S, "_hot", lambda *a: hot)
    parted = S._repeats(keyed, "doc_id", "text").collect()
    for got, name in ((plain, "doc_id"), (parted, "doc")):
        assert {(r[name], r.start_word, r.n_words) for r in got} == {(k, 30, 60) for k in range(1, 40)}


def test_repeats_against_all_pairs(spark):
    """Near copies: what a look at every pair of texts finds is found too, at least 95 in 100, and nothing else; exact
    copies are all found, behind earlier copies that were changed, and however rows are dealt."""
    rng = random.Random(22)
    texts = []
    for group in range(60):
        part = words(rng, rng.choice([55, 70, 100]))
        for copy in range(4):
            changed = list(part)
            for _ in range(rng.choice([0, 1, 2, 4]) if copy < 3 else 0):
                changed[rng.randrange(len(part))] = f"x{rng.randrange(10**6)}"
            texts.append((10 * group + copy, words(rng, 20) + changed + words(rng, rng.randrange(30))))
    sequences = {i: shingles(word_hashes(" ".join(w)), 5) for i, w in texts}
    want = {i for i in sequences if any(passages(sequences[i], sequences[j], 46) for j in range(i - i % 10, i))}
    docs = frame(spark, [(i, " ".join(w)) for i, w in texts])
    got = repeats(docs.repartition(1)).collect()
    found = {r.doc_id for r in got}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert {tuple(r) for r in got} == {tuple(r) for r in repeats(docs.repartition(7)).collect()}
    seen = set()
    for i, w in texts:
        runs = {tuple(w[k : k + 50]): k for k in range(len(w) - 49)}
        for k in (k for run, k in runs.items() if run in seen):
            assert any(r.doc_id == i and r.start_word <= k and k + 50 <= r.start_word + r.n_words for r in got)
        seen |= set(runs)


def test_very_long_texts_and_odd_rows(spark):
    """A long text and one long word, repeated ids with and without the same text, ties, and columns with inner names."""
    rng = random.Random(23)
    long, part = words(rng, 60_000), words(rng, 60)
    rows = [(1, " ".join(long)), (2, " ".join(words(rng, 10) + long[40_000:40_080])), (3, " ".join(part)), (3, " ".join(part)), (4, "x" * 3_000_000), (4, " ".join(part + ["end"])), (5, " ".join(["so"] * 3000)), (6, " ".join(["so"] * 60))]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, __spans int, __row int, doc int")
    got = {(r.doc_id, r.start_word, r.n_words, r.source_id) for r in repeats(docs).collect()}
    assert got == {(2, 10, 80, 1), (4, 0, 60, 3), (6, 0, 60, 5)}
    left = without_repeats(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, len(r.text.split())) for r in left.collect()) == Counter([(1, 60_000), (2, 10), (3, 60), (3, 60), (4, 1), (4, 1), (5, 3000)])


def test_words_of_long_texts():
    """Hashes do not depend on what is hashed together, or on where a long text is cut."""
    from textveil.llm import words as W

    rng = random.Random(24)
    parts = ["a" * rng.choice([1, 5, 63, 64, 65, 5000, 400_000, 1_500_000]) + str(k) for k in range(40)] + [f"W{k}" for k in range(200_000)]
    rng.shuffle(parts)
    text = " \n".join(parts)
    alone = np.concatenate(W.words_of([p for p in parts]))
    assert np.array_equal(W.word_hashes(text), alone) and np.array_equal(W.word_hashes(text.encode()), alone)
    assert [len(x) for x in W.words_of(["a b", text, None, " ", "c"])] == [2, len(parts), 0, 0, 1]


def test_rows_without_an_id_of_their_own(spark):
    rng = random.Random(15)
    base, other, third, near, part = (" ".join(words(rng, 60)) for _ in range(5))
    docs = frame(spark, [(1, base), (None, base), (None, other), (5, base), (5, third), (None, near + " a"), (None, near + " b")])
    left = Counter((r.doc_id, r.text if r.text[:-2] != near else near) for r in J.one_of_each(docs).collect())
    assert left == Counter({(1, base): 1, (None, other): 1, (5, third): 1, (None, near): 1})
    docs = frame(spark, [(1, part), (5, part + " " + base), (5, other)])
    assert {(r.doc_id, r.text) for r in without_repeats(docs).collect()} == {(1, part), (5, base), (5, other)}
    from textveil.llm.quality import kept_documents

    docs = frame(spark, [(None, base), (None, "too short"), (6, other), (6, "short")])
    assert {r.text for r in kept_documents(docs, spark.createDataFrame([], "doc_id long")).collect()} == {base, other}
