"""Registered queries over the whole smallest tables against brute force."""

import hashlib
from collections import defaultdict

import pytest

from photofold.llm import mixing
from photofold.llm.queries import QUERIES
from test_lines_tokens_mix import kept_lines, whole_file
from test_near_and_leaks import brute_links
from test_quality_secrets_html import NAMES, WORD, brute_quality, brute_secrets
from test_substrings import first_chunks_stay, repeated_bytes
from tests_llm_cases import as_set

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())


def run(spark, name, *columns):
    df = QUERIES[name](spark, FOLDER)
    return as_set(df, *(columns or df.columns))


def test_op1(spark, documents):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert run(spark, "op1_suffix_dedup", *columns) == repeated_bytes(documents)


def brute_mix(rows):
    """Taken words by document: packets of all sources by virtual finish time, up to the budget."""
    draw = {i: hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest() for i, _, _ in rows}
    size = defaultdict(int)
    for _, source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    shares = mixing.targets([size[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2)
    packets = []
    for k, source in enumerate(order):
        before = 0
        for copy in range(2):
            for place, (i, _, n) in enumerate(sorted((r for r in rows if r[1] == source), key=lambda r: (draw[r[0]], r[0]))):
                for packet, start in enumerate(range(0, n, mixing.PACKET_WORDS)):
                    words = min(mixing.PACKET_WORDS, n - start)
                    packets.append(((before + start + words) / shares[k], k, place, copy, packet, i, words))
                before += n
    left, taken = round(sum(shares)), defaultdict(int)
    for *_, i, words in sorted(packets):
        taken[i] += min(words, left)
        left -= min(words, left)
    return [(i, n, size[s], shares[order.index(s)], taken[i]) for i, s, n in rows]


def test_op2(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = sorted(brute_mix([(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs]), key=repr)
    found = run(spark, "op2_mixing", "doc_id", "size", "source_size", "target", "taken")
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want])
    assert [r[4] for r in found] == [r[4] for r in want]


def test_op3(spark, documents):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert run(spark, "op3_substring_dedup", *columns) == first_chunks_stay(documents)


def test_op5(spark, documents):
    want = []
    for i, t in documents:
        counts, spans = brute_secrets(t)
        want.append((i, *counts, hashlib.sha256(spans.encode()).hexdigest()))
    assert run(spark, "op5_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)


def test_op6(spark, documents):
    assert run(spark, "op6_token_files", "doc_id", "start", "n_tokens", "ids_crc32") == sorted(whole_file(documents), key=repr)


def test_op7(spark, documents):
    assert run(spark, "op7_quality_rules", "doc_id", *NAMES) == sorted(((i, *brute_quality(t)) for i, t in documents), key=repr)


def test_op9(spark, documents):
    assert run(spark, "op9_ngram_join", "doc_id", "class_id", "n_links") == brute_links(documents)


def test_op10(spark, documents):
    want = [(i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in kept_lines(documents)]
    assert run(spark, "op10_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
