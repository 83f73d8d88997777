import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from photofold.llm import substring_dedup, suffix_dedup
from photofold.llm.spans import union_of
from tests_llm_cases import as_set, frame, pairs

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def repeated_bytes(rows, length=200):
    raw = [t.encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (name, _), b in zip(rows, raw):
        covered = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        flags = np.cumsum(covered[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        out.append((name, len(b), int(flags.sum()), runs, digest(np.frombuffer(b, np.uint8)[~flags].tobytes())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [64, 1])
def test_suffix_dedup_edge_cases(spark, most):
    assert as_set(suffix_dedup.remove_repeats(frame(spark), most=most), *COLUMNS) == repeated_bytes(pairs())


@pytest.mark.parametrize("most", [64, 3])
def test_suffix_dedup_edited_copies(spark, most):
    r = random.Random(3)
    bases = ["".join(r.choice("ab c") for _ in range(600)) for _ in range(3)]
    rows = [(0, bases[0] + bases[0]), (1, "x" * 201), (2, "ab" * 300), (3, bases[1][100:350]), (4, bases[2][:199])]
    for k in range(40):
        t = list(bases[r.randrange(3)])
        for _ in range(r.randrange(4)):
            t[r.randrange(600)] = r.choice("xyz")
        rows.append((10 + k, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_set(suffix_dedup.remove_repeats(df, most=most), *COLUMNS) == repeated_bytes(rows)


def test_intervals_and_maximal_repeats():
    contexts = [b"LLaaaa", b"LLaabb", b"MLaaaa", b"MLaacc"]
    found = {(left, right, tuple(sorted(m))) for left, right, m in suffix_dedup.maximal_repeats(contexts, [2] * 4, [0] * 4, 3)}
    assert (1, 4, (0, 2)) in found  # L aaaa, with different bytes before
    assert (2, 2, (0, 1)) in found and (2, 2, (2, 3)) in found
    assert (1, 2, (0, 1, 2, 3)) in found


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_union_of_spans():
    a, b = union_of(np.array([5, 0, 3, 20]), np.array([9, 4, 5, 21]))
    assert list(zip(a.tolist(), b.tolist())) == [(0, 9), (20, 21)]


def first_chunks_stay(rows, least=substring_dedup.LEAST_RUN):
    cut = [(i, t.encode(), substring_dedup.chunks([t.encode()])[0].tolist()) for i, t in rows]
    first = {}
    for i, b, ends in cut:
        for x, y in zip([0, *ends], ends):
            at = (i is not None, i or 0, x)
            first[b[x:y]] = min(first.get(b[x:y], at), at)
    out = []
    for i, b, ends in cut:
        gone = [(x, y) for x, y in zip([0, *ends], ends) if first[b[x:y]] != (i is not None, i or 0, x)]
        runs = []
        for x, y in gone:
            if runs and runs[-1][1] == x:
                runs[-1][1] = y
            else:
                runs.append([x, y])
        runs = [r for r in runs if r[1] - r[0] >= least]
        kept = b"".join(b[x:y] for x, y in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(b)]))
        out.append((i, len(b), sum(y - x for x, y in runs), len(runs), digest(kept)))
    return sorted(out, key=repr)


def test_substring_dedup_edge_cases(spark):
    assert as_set(substring_dedup.dedup_substrings(frame(spark)), *COLUMNS) == first_chunks_stay(pairs())


def test_chunks_resist_insertions():
    r = random.Random(8)
    text = bytes(r.randrange(97, 123) for _ in range(20000))
    shifted = text[:7000] + b"some inserted words" + text[7000:]

    def parts(t):
        ends = substring_dedup.chunks([t])[0].tolist()
        return {t[a:b] for a, b in zip([0, *ends], ends)}

    assert len(parts(text) - parts(shifted)) <= 4
    assert substring_dedup.chunks([b"", b"a" * 10000])[1].tolist()[-1] == 10000


def test_chunks_do_not_depend_on_the_batch():
    r = random.Random(9)
    texts = [bytes(r.randrange(256) for _ in range(r.randrange(900))) for _ in range(20)]
    together = substring_dedup.chunks(texts)
    assert all((substring_dedup.chunks([t])[0] == c).all() for t, c in zip(texts, together))


def test_passage_of_fifty_words_is_caught(spark):
    from tests_llm_cases import prose

    passage = prose(50, 52)
    rows = [(1, prose(51, 90) + " " + passage + " " + prose(52, 40)), (2, prose(53, 33) + " " + passage + " " + prose(54, 90)), (3, prose(55, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cdc = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(df).collect()}
    assert cdc[1] == cdc[3] == 0 and cdc[2] >= 64
    sa = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    n = len(passage.encode())
    assert sa[3] == 0 and n <= sa[1] <= n + 8 and n <= sa[2] <= n + 8


def test_equal_rows_without_ids_keep_short_lists(spark):
    from photofold.llm.spans import cut_spans

    text = "a passage that stands twice, " * 20
    docs = spark.createDataFrame([(None, text)] * 3000, "doc_id long, text string").repartition(4)
    from photofold.llm.common import text_tag
    from pyspark.sql import functions as F

    spans = docs.select("doc_id", text_tag(F.col("text")).alias("tag"), F.lit(3).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    found = cut_spans(docs, spans.union(spans.withColumn("end", F.lit(12).cast("long"))))
    assert {(r.n_removed, r.n_spans) for r in found.select("n_removed", "n_spans").collect()} == {(9, 1)} and found.count() == 3000
