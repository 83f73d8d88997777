import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from photofold.llm import components, decontamination, mixing, ngram_join
from photofold.llm.queries import word_tokenizer
from tests_llm_cases import as_set, frame, pairs, prose, rows
from test_quality_secrets_html import WORD, brute_quality


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(some, threshold=0.8):
    sets = [shingles(t) for _, t in some]
    root = list(range(len(some)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(some)
    for i in range(len(some)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(some)):
        members[find(i)].append(some[i][0])
    ids = {k: min((x for x in m if x is not None), default=None) for k, m in members.items()}
    return sorted(((some[i][0], ids[find(i)], links[i]) for i in range(len(some))), key=repr)


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates_edge_cases(spark, block):
    found = ngram_join.similar_documents(frame(spark), block=block)
    assert as_set(found, "doc_id", "class_id", "n_links") == brute_links(pairs())


def edited(seed, base, n):
    r = random.Random(seed)
    words = base.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates_of_edited_copies(spark, block):
    bases = [prose(70 + k, 150) for k in range(3)]
    some = [(k, edited(k, bases[k % 3], k % 5)) for k in range(90)] + [(200 + k, prose(200 + k, 100)) for k in range(30)]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(5)
    found = as_set(ngram_join.similar_documents(df, block=block), "doc_id", "class_id", "n_links")
    want = brute_links(some)
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert sum(x[2] for x in found) >= 0.999 * sum(x[2] for x in want)
    assert all(a[2] <= b[2] for a, b in zip(found, want))


def test_a_chain_is_compared_along_its_length(spark):
    """Only neighbours share a band: the pairs of blocks grow with the chain, not with its square."""
    r, asked = random.Random(3), {}
    for n in (400, 1600):
        ids = r.sample(range(10 * n), n)
        nodes = spark.createDataFrame([(i, 10) for i in ids], "node long, n long")
        groups = spark.createDataFrame([(i, min(ids)) for i in ids], "node long, part long")
        links = [(0, k, x) for k, pair in enumerate(zip(ids, ids[1:])) for x in pair]
        members = spark.createDataFrame(links, "band int, key long, node long")
        edges = spark.createDataFrame([(max(p), min(p)) for p in zip(ids, ids[1:])], "u long, v long")
        dealt = {x.node: x for x in ngram_join.deal(groups, nodes, members, edges, 8).collect()}
        assert len(dealt) == n
        for a, b in zip(ids, ids[1:]):
            assert dealt[b].home in dealt[a].others and dealt[a].home in dealt[b].others
        homes = {x.home: set(x.others) for x in dealt.values()}
        assert max(Counter(x.home for x in dealt.values()).values()) <= 8
        asked[n] = sum(map(len, homes.values()))
    assert asked[1600] <= 6 * asked[400]


def test_long_texts_count_as_several(spark):
    nodes = spark.createDataFrame([(k, 100_000) for k in range(6)], "node long, n long")
    groups = spark.createDataFrame([(k, 0) for k in range(6)], "node long, part long")
    members = spark.createDataFrame([(0, 0, k) for k in range(6)], "band int, key long, node long")
    edges = spark.createDataFrame([(k, 0) for k in range(1, 6)], "u long, v long")
    dealt = ngram_join.deal(groups, nodes, members, edges, 128).collect()
    assert max(Counter(x.home for x in dealt).values()) <= 2
    homes = {x.home for x in dealt}
    assert all(set(x.others) == homes for x in dealt)


def test_keep_one_of_each_class(spark):
    left = ngram_join.keep_one(frame(spark))
    assert left.columns == frame(spark).columns
    classes = Counter(c for i, c, n in brute_links(pairs()) if n)
    kept = [r.doc_id for r in left.collect()]
    alone = [i for i, c, n in brute_links(pairs()) if not n]
    assert sorted(kept, key=repr) == sorted([*alone, *classes], key=repr)
    assert ngram_join.keep_one(frame(spark, [])).count() == 0


def test_bands_meet_the_recall():
    bands = ngram_join.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** bands >= 0.9995
    r = np.random.default_rng(1)
    met = 0
    for _ in range(400):
        x = np.unique(r.integers(1, 2**63, 900, dtype=np.int64).astype(np.uint64))
        a, b = ngram_join.band_keys(x[:-90], bands, 7), ngram_join.band_keys(x[90:], bands, 7)
        met += bool((a == b).any())
    assert met >= 397


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(7, 7), (300, 200), (200, 300)]
    r.shuffle(edges)
    found = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert found == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 60)}, 200: 200, 300: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


ITEMS = [(1, "Tom has 3 apples and buys 12 more apples at the market for Anna. How many apples does Tom have?"), (2, "short one"), (3, None), (4, "seven words are enough to be found"), (4, "")]


def leaks(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    found = decontamination.find_leaks(docs, spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, hash int"))
    return sorted((r.doc_id, r.item_id) for r in found.collect())


def test_leaks_with_other_numbers_and_names(spark):
    texts = [
        f"{prose(1, 30)}. Bob has 5 apples and buys 40 more apples at the market for Lisa. How many apples does Bob have? {prose(2, 20)}",
        "Bob has 5 apples and buys 40 more pears at a shop for Lisa. Who paid?",
        ITEMS[0][1].upper(), None, "", prose(3, 300), "... SEVEN words, are enough to be found!", "short one",
    ]
    assert leaks(spark, texts) == [(0, 1), (2, 1), (6, 4)]
    assert leaks(spark, texts, []) == [] and leaks(spark, []) == []


DENSE = [
    (1, "A train travels 60 km in 2 hours and 90 km in 3 hours"), (2, "What is 12 + 7 * 3 - 4 divided by 2?"), (3, "I have 3 red apples"),
    (4, "Which of the rivers is long: 3 km, 4 km, 5 km, 6 km, 7 km, 8 km"), (5, "1, 2, 4, 8, 17"),
]


def test_leaks_of_slot_dense_and_short_items(spark):
    texts = [f"{prose(1, 30)}. {t} {prose(2, 20)}" for _, t in DENSE] + [
        "A train travels 80 km in 5 hours and 70 km in 4 hours", "What is 2 + 9 * 5 - 1 divided by 8?", "Hm, I have 7 red apples",
        "A train travels 60 km in 2 hours or so", "She saw 1, 2, 4, 8, 16 of them", "60 km in 3 hours and 90 km in 2 hours",
    ]
    assert leaks(spark, texts, DENSE) == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (6, 2), (7, 3), (8, 1)]


def test_inconsistent_slots_do_not_count():
    window = lambda mine, theirs, at: {"item_slots": mine, "slots": theirs, "at": [at], "times": 1}
    agree = [window(["3", "", ""], ["5", "", ""], 0), window(["", "", "3"], ["", "", "5"], 4)]
    assert decontamination.consistent_tokens(agree) == 6
    assert decontamination.consistent_tokens([*agree, window(["3", "", ""], ["6", "", ""], 9)]) == 6


def test_leaks_beside_copies_with_other_values(spark):
    item = "Tom has {} apples and {} pears. Anna has {} apples and {} pears."
    own, other = item.format(3, 4, 5, 6), item.format(1, 9, 2, 8)
    texts = [f"{own} {other}", f"{other} {own}", " ".join(item.format(k, 3 * k % 10, 7 * k % 10, 9 - k) for k in range(1, 9)), own, other]
    assert leaks(spark, texts, [(1, own)]) == [(k, 1) for k in range(5)]


def test_best_occurrence_counts():
    window = lambda theirs, at, place: {"item_slots": ["3", "", "", "4"], "slots": theirs, "at": [at], "times": 1, "place": place}
    first = [window(["7", "", "", "8"], 0, 20), window(["7", "", "", "8"], 4, 25)]
    second = [window(["9", "", "", "1"], 0, 50), window(["9", "", "", "2"], 4, 54)]
    assert decontamination.best_covered(first + second, 8) == 8
    assert decontamination.best_covered(second, 8) == 4


def test_rows_that_share_an_id_are_judged_alone(spark):
    item = "Tom has 3 apples and buys 12 more apples at the market for Anna. How many apples does Tom have?"
    texts = [item.replace("3", "5"), item.replace("12", "40"), item[:30], item[30:62], item[62:], prose(1, 40), None]
    for i in (None, 7):
        docs = spark.createDataFrame([(i, t, 1) for t in texts], "doc_id long, text string, tag int")
        items = spark.createDataFrame([(1, item)], "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()] == [(i, 1)] * 2
        assert as_set(decontamination.without_leaks(docs, items), "text") == sorted(((t,) for t in texts[2:]), key=repr)


def test_rows_without_an_id_do_not_meet_each_other(spark):
    base = prose(1, 120)
    some = [(None, f"{base} {k}") if k % 2 else (None, prose(k, 90)) for k in range(60)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    found = ngram_join.similar_documents(docs)
    assert as_set(found, "doc_id", "class_id", "n_links") == brute_links(some)


def test_leaks_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    plain = lambda t: " ".join(t.split()).lower()
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    known = {r.item_id: plain(r.text) for r in items.collect()}
    assert {(d, i) for d, t in texts.items() for i, x in known.items() if x in t} <= found
    assert decontamination.without_leaks(docs, items).count() == docs.count() - len({d for d, _ in found})


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {i: r for i, r in docs.items() if brute_quality(r.text)[-1]}
    classes = brute_links([(i, r.text) for i, r in kept.items()])
    kept = {i: kept[i] for i, c, _ in classes if i == c}
    items = [" ".join(r.text.split()).lower() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i: r for i, r in kept.items() if not any(x in " ".join(r.text.split()).lower() for x in items)}
    tokenizer = Tokenizer.from_file(word_tokenizer())
    found = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r.start)
    times, start = Counter(r.doc_id for r in found), 0
    for r in found:
        ids = tokenizer.encode(kept[r.doc_id].text, add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found) and set(times) <= set(kept)
    size, target = Counter(), {}
    words = {i: len(WORD.findall(r.text)) for i, r in kept.items()}
    for i, r in kept.items():
        size[r.source] += words[i]
    order = sorted(size)
    target = dict(zip(order, mixing.targets([size[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2)))
    taken = Counter()
    for i, n in times.items():
        assert n <= 2
        taken[kept[i].source] += n * words[i]
    longest = {s: max(words[i] for i, r in kept.items() if r.source == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= longest[s] + mixing.PACKET_WORDS for s in order)


def test_pipeline_stages_take_edge_cases(spark):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for some in (None, []):
            df = frame(spark, some)
            out = stage(spark, df, "/root/testdata/sf0.001")
            assert name == "token_files" or out.columns == df.columns
            assert out.count() <= 2 * len(rows() if some is None else some)


def test_columns_named_like_the_ones_of_the_join(spark):
    names = ["leaking", "leaking_tag", "tag", "item_id", "_docs", "_leaks"]
    text = "The quick brown fox jumps over the lazy dog near the river bank today"
    docs = spark.createDataFrame([(1, text, *names), (2, "clean " * 20, *names)], ["doc_id", "text", *names])
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    left = decontamination.without_leaks(docs, items)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [2]


def test_short_items_as_whole_sentences(spark):
    items = spark.createDataFrame([(1, "3 + 4 = 7"), (2, "Yes."), (3, "12 * 5.5 + 3"), (4, None), (5, "Two. Three"), (6, "one two three four five"), (7, "3+4=7")], "item_id long, text string")
    docs = [
        (1, "Let us see. 3 + 4 = 7. It is 13 + 4 = 7 or so\n3 + 4 = 7"), (2, "yes! YES"), (3, "That is yes and no"), (4, "12 * 5.5 + 3\n12 * 5.5 + 30"),
        (5, None), (5, "Yes"), (5, "Yes"), (6, "Two. Three"), (7, "one two three four five"),
    ]
    found = decontamination.find_short_items(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert as_set(found, "doc_id", "item_id", "n_times") == [(1, 1, 2), (1, 7, 2), (2, 2, 2), (4, 3, 1), (5, 2, 2)]
    assert decontamination.find_short_items(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


def test_slot_dense_items_ask_for_few_window_sizes():
    r, kinds = random.Random(6), set()
    for _ in range(300):
        words = [str(r.randrange(100)) if r.random() < 0.8 else r.choice(["apples", "cost", "for", "with"]) for _ in range(r.randint(5, 120))]
        t = decontamination.Templates([" ".join(words)])
        places = t.item_places(8)
        assert places and all(0 <= a and a + size <= len(words) for a, size, _ in places)
        kinds |= {(size, exact) for _, size, exact in places}
    assert len(kinds) <= 24
    assert [decontamination.window_size(n) for n in (5, 16, 17, 24, 25, 32, 33, 49)] == [5, 16, 24, 24, 32, 32, 48, 64]
