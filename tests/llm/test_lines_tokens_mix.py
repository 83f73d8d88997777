import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from photofold.llm import line_dedup, mixing, token_files
from photofold.llm.queries import word_tokenizer
from tests_llm_cases import as_set, frame, pairs, prose, rows

SPACES = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def kept_lines(some, least=5):
    lines = [(i, t.split("\n")) for i, t in some]
    key = lambda x: x.strip(SPACES).translate(LOWER)
    holders = defaultdict(list)
    for i, own in lines:
        for k in {key(x) for x in own}:
            if len(k) >= 40:
                holders[k].append(i)
    out = []
    for i, own in lines:
        stay = []
        for x in own:
            ids = holders.get(key(x), [])
            known = [j for j in ids if j is not None]
            if len(ids) < least or i == (max(known) if known else None):
                stay.append(x)
        out.append((i, len(own), len(own) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_line_dedup_edge_cases(spark, parts):
    docs = frame(spark)
    batches = None if parts == 1 else [frame(spark, rows()[k::parts]) for k in range(parts)]
    found = line_dedup.dedup_lines(docs, batches, fanout=2)
    assert as_set(found, "doc_id", "n_lines", "n_dropped", "text") == kept_lines(pairs())


def test_runs_compact_and_find_unseen_lines(spark):
    runs = line_dedup.LineRuns(spark, min_chars=5, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, f"shared line\nline number {k}\nshared line")], "doc_id long, text string"))
    assert [len(runs.levels[k]) for k in range(3)] == [1, 0, 1]
    assert sorted((r.n_docs, r.last_doc) for r in runs.merged().collect()) == [(1, k) for k in range(5)] + [(5, 4)]
    new = spark.createDataFrame([(9, "SHARED line\nnever seen")], "doc_id long, text string")
    assert runs.unseen(new).count() == 1


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert line_dedup.LineRuns(spark).merged().count() == 0


def whole_file(some):
    tokenizer, start, out = Tokenizer.from_file(word_tokenizer()), 0, []
    for i, t in some:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_round_trip(spark):
    from pyspark.sql import functions as F

    found = token_files.round_trip(frame(spark), word_tokenizer(), 1).withColumn("crc", F.crc32("ids"))
    mine = sorted((tuple(r) for r in found.select("doc_id", "start", "n_tokens", "crc").collect()), key=lambda r: r[1])
    assert [r[0] is None for r in mine] == sorted((r[0] is None for r in mine), reverse=True)
    assert [r[0] for r in mine if r[0] is not None] == sorted(r[0] for r in mine if r[0] is not None)
    assert all(a[1] + a[2] == b[1] for a, b in zip(mine, mine[1:])) and mine[0][1] == 0
    want = whole_file(pairs())
    assert sorted(((r[0], *r[2:]) for r in mine), key=repr) == sorted(((r[0], *r[2:]) for r in want), key=repr)
    assert token_files.round_trip(frame(spark, []), word_tokenizer(), 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("aA'sß éİ ǅΣ1²٣<|>\n\t\x1c ", max_size=40), max_size=6))
def test_words_encode_like_whole_texts(texts):
    encoder = token_files.WordEncoder.of_worker(word_tokenizer())
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_grammar_expands_to_the_ids(ids, a, b):
    ids = np.array(ids * 3, np.uint32)
    base, rules, lengths, seq = token_files.compress(ids, 3)
    assert (token_files.expand(seq, base, rules, lengths) == ids).all()
    block = token_files.pack(base, rules, lengths, seq)
    a, b = sorted((a, b))
    assert (token_files.decode_range(block, a, b) == ids[a:b]).all()


def test_mix_meets_targets_and_reruns_agree(spark):
    r = random.Random(4)
    some = [(k, prose(k, r.randint(1, 120)), None, r.choice([None, "a", "b", "é", "z"]), None, k, "", k, "") for k in range(300)]
    docs = spark.createDataFrame([(s[0], s[3], len(s[1].split())) for s in some], "doc_id long, source string, size long")
    mine = as_set(mixing.mixed_documents(docs), "doc_id", "source", "size", "source_size", "target", "taken")
    again = as_set(mixing.mixed_documents(docs.repartition(7)), "doc_id", "source", "size", "source_size", "target", "taken")
    assert mine == again and len(mine) == 300
    assert all(0 <= x[5] <= 2 * x[2] for x in mine)
    size, target, taken = Counter(), {}, Counter()
    for _, source, n, _, t, k in mine:
        size[source] += n
        target[source] = t
        taken[source] += k
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [5, 2, 1, 5, 2], 1.5 * sum(size.values()), 2)
    assert [target[s] for s in order] == pytest.approx(want)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= mixing.PACKET_WORDS + 1 for s in order)
    assert sum(taken.values()) == round(1.5 * sum(size.values()))


def test_mix_edge_cases(spark):
    docs = frame(spark)
    sized = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("size"))
    found = mixing.mixed_documents(sized).collect()
    assert len(found) == len(rows())
    assert sum(r.taken for r in found) == round(1.5 * sum(r.size for r in found))
    assert mixing.mix(sized.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "doc_id long, source string, size long")
    assert [(r.target, r.taken) for r in mixing.mixed_documents(nothing).collect()] == [(0.0, 0), (0.0, 0)]
    copies = mixing.mixed_copies(docs)
    assert copies.columns == docs.columns
    assert max(Counter(r["_row"] for r in copies.collect()).values()) <= 2


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.targets([1, 100], [5, 1], 60, 2) == pytest.approx([2, 58])
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0, 5], [1, 1], 7.5, 2) == pytest.approx([0, 7.5])


def test_line_dedup_query_against_sql(spark):
    import duckdb

    from check import digest
    from photofold.llm.oracles import ORACLES
    from photofold.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, folder)
        cursor = con.execute(sql)
        assert digest(df.columns, df.collect()) == digest([d[0] for d in cursor.description], cursor.fetchall())
