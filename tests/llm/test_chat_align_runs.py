import cProfile
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from photofold.llm import chat_format, periodic_runs, token_alignment
from photofold.llm.queries import MARKS, QUERIES
from tests_llm_cases import as_set, frame, pairs, rows

FOLDER = "/root/testdata/sf0.001"
SPACES = b" \t\n\x0b\x0c\r"


# Chat formatting

PARTS = ["\\", "### Assistant: ", "### User: ", "</turn>", "\n", '### Role "x": ', '### Role "', "a", "###", " ", "</tur", "n>", "User: ", "é", "\x00"]
ROLE = st.sampled_from(["user", "assistant", "", "</turn>", "User", "### User: ", '"\\', "a\nb", "tool"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, st.lists(st.sampled_from(PARTS), max_size=9).map("".join)), min_size=1, max_size=4))
def test_every_conversation_comes_back(turns):
    made = [chat_format.render(role, text) for role, text in turns]
    assert [(t.role, t.text) for t in chat_format.parse("".join(m[0] for m in made))] == turns
    assert [chat_format.unescape(m[a:b]) for m, a, b in made] == [text for _, text in turns]


def test_only_conflicting_text_is_escaped():
    assert chat_format.render("user", "plain \\ text ### Title") == ("### User: plain \\ text ### Title\n</turn>\n", 10, 32)
    assert chat_format.render("assistant", MARKS)[0] == "### Assistant: \\\\### Assistant: \\</turn> ok\n</turn>\n"


@pytest.mark.parametrize("broken", ["x", "### User: a", "### User: a\n</turn>", "### User: a</turn>\n", "### Nobody: a\n</turn>\n", "### User: ### User: a\n</turn>\n"])
def test_the_parser_rejects_other_texts(broken):
    with pytest.raises(chat_format.ChatSyntaxError):
        chat_format.parse(broken)


TURNS = "conv_id long, turn long, role string, text string, part int, chunk int, mask string, tie long"


def turn_rows():
    r = random.Random(4)
    some = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, None, "a"), (2, None, "system", "s"), (3, 0, "user", "x"),
        (3, 0, "user", "x"), (3, 0, "assistant", "y"), (None, 0, "assistant", MARKS), (None, 1, "Assistant", "z"), (4, 0, "assistant", "long " * 5000),
    ]
    some += [(5, k, r.choice(["user", "assistant"]), "".join(r.choice(PARTS) for _ in range(12))) for k in range(400)]
    return [(*row, 1, 2, "m", 3) for row in some]


def brute_chats(some):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in some:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in turns.items():
        # turns of one number come by role and a hash of both, which the digest below has to follow
        said = [(role, text) for _, _, role, text in sorted(own, key=lambda t: t[:3])]
        loss = "".join(t for r, t in said if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        size = sum(len(chat_format.render(r, t)[0]) for r, t in said)
        out.append((conv, len(said), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1, 500, 1 << 20])
def test_chats_in_chunks_of_any_size(spark, chunk):
    turns = spark.createDataFrame(turn_rows(), TURNS).repartition(5)
    assert as_set(chat_format.round_trip(turns, chunk), *[f.split()[0] for f in chat_format.READ.split(", ")]) == brute_chats(turn_rows())


def test_the_mask_covers_the_assistant_alone(spark, tmp_path):
    chat_format.write_chats(spark.createDataFrame(turn_rows(), TURNS), str(tmp_path / "chats"), 300)
    masked = Counter()
    for row in spark.read.parquet(str(tmp_path / "chats")).collect():
        assert row.n_turns == len(chat_format.parse(row.text))
        masked[row.conv_id] += sum(len(chat_format.unescape(row.text[m.start : m.end])) for m in row.mask)
    assert masked == Counter({conv: n for conv, _, _, n, _, _ in brute_chats(turn_rows())})


def test_no_chats(spark):
    assert chat_format.round_trip(spark.createDataFrame([], TURNS)).count() == 0


def test_op11(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute_chats([*turns, (-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)])
    found = QUERIES["op11_chat_format"](spark, FOLDER)
    assert as_set(found, *found.columns) == want


# Alignment of tokens

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD = [
    " ", "  ", " a", "a ", "a  b", "\n", "a\nb c", "▁x y", "<|endoftext|> a", "<s> </s>", "\x00\x01 é́ 😀😀", "ab " * 300, " " * 1000, "x" * 7000,
    "🏳️‍🌈" * 50, "日本語 テスト" * 20, "a\x85b", "a \x1c b", "don't  it's 'S", "\u200b q", "\ufeffabc d", "ｆｕｌｌ １２", "<unk>", "<0x41> -----",
]


@pytest.fixture(scope="module")
def tokenizers():
    return token_alignment.ByteLevel(PATHS[0]), token_alignment.Pieces(PATHS[1])


def brute_groups(tokenizers, text):
    """Groups of the whole text's tokens, or none."""
    if not text:
        return []
    first, second = tokenizers
    sides = []
    for side, ids in ((first, first.encode([" " + text])[0]), (second, second.model.encode(text))):
        parts = [side.bytes[i] for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return []
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        sides.append((ids, ends))
    groups = [([], []) for _ in range(len(set(sides[0][1]) & set(sides[1][1])))]
    cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
    for k, (ids, ends) in enumerate(sides):
        for i, end in zip(ids, ends):
            groups[next(j for j, c in enumerate(cuts) if end <= c) if len(cuts) < 50 else _place(cuts, end)][k].append(i)
    return groups


def _place(cuts, end):
    import bisect

    return bisect.bisect_left(cuts, end)


def brute_alignment(tokenizers, some):
    held, documents = Counter(), []
    for name, text in some:
        groups = brute_groups(tokenizers, text)
        linked = Counter((a, b) for ga, gb in groups for a in ga for b in gb)
        held.update(linked.keys())
        documents.append((name, groups, linked))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for name, groups, linked in documents:
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            name, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(linked.values()),
            sum(n for p, n in linked.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in linked.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


NUMBERS = [f.split()[0] for f in token_alignment.RESULT.split(", ")]


@pytest.mark.parametrize("block", [100, 3 << 20])
def test_alignment_of_odd_texts(spark, tokenizers, monkeypatch, block):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment.Known.__init__, "__defaults__", (block >> 3,))
    r = random.Random(5)
    alphabet = [" ", "  ", "a", "b", "é", "\n", "\t", "'s", "1", "12", "😀", "the", "　", "\u00a0", "▁", "=", "ß"]
    made = ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 30))) for _ in range(60)]
    some = rows() + [(100 + k, t, None, None, None, k, "x", k, "y") for k, t in enumerate(made)]
    found = token_alignment.align_counted(frame(spark, some), *PATHS)
    assert as_set(found, *NUMBERS) == brute_alignment(tokenizers, pairs(some))


def test_groups_with_many_links_are_not_written_out(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(token_alignment, "LONG_GROUP", 1)
    assert as_set(token_alignment.align_counted(frame(spark), *PATHS), *NUMBERS) == brute_alignment(tokenizers, pairs())


def test_tokens_and_groups(spark, tokenizers):
    for row in token_alignment.align(frame(spark), *PATHS).collect():
        groups = [[[int(i) for i in side.split(",")] for side in g.split("|")] for g in row.groups.split(";")] if row.groups else []
        assert row.a == [i for g in groups for i in g[0]] and row.b == [i for g in groups for i in g[1]]


def test_overlaps_are_those_of_all_pairs(tokenizers):
    aligned = token_alignment.align_texts(*tokenizers, [" don't", " überzeugend", " 😀é"])
    for ids, sizes in ((aligned.a, tokenizers[0].bytes), (aligned.b, tokenizers[1].bytes)):
        assert b"".join(sizes[i] for i in ids).decode() == " don't überzeugend 😀é"
    ends = [[sum(len(t.bytes[i]) for i in ids[: k + 1]) for k in range(len(ids))] for t, ids in zip(tokenizers, (aligned.a, aligned.b))]
    starts = [[0, *e[:-1]] for e in ends]
    want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
    assert list(aligned.overlap.itertuples(index=False, name=None)) == want


SPACED = ODD + ["", "a", "a b c", "a  b c", " a b", "\na b", "a b\n", "a\tb c", "a \tb", "a\u3000b c", "a \u2003 b c", "a b\x85", "\x1c", "é ü\u2028 z"]


def test_texts_are_cut_alike_one_by_one_and_together():
    parts, first, count = token_alignment.cut_texts(pa.array(SPACED, pa.large_string()))
    found = [parts.slice(i, n).to_pylist() for i, n in zip(first.tolist(), count.tolist())]
    # the space before the first may be left out: it is put before every piece that has none
    spaced = [[p if p[0] == " " else " " + p for p in cut] for cut in found]
    assert spaced == [[p if p[0] == " " else " " + p for p in token_alignment.cut_text(t)] for t in SPACED]


def test_spaces_are_those_of_python():
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    assert pc.match_substring_regex(pa.array(every), rf"\A{token_alignment._SPACE}\z").to_pylist() == [c.isspace() for c in every]
    plain = token_alignment.Texts([" " + t for t in SPACED] + SPACED).plain.tolist()
    assert plain == [bool(re.fullmatch(r" \S(?:.*\S)?", t, re.DOTALL)) for t in [" " + t for t in SPACED] + SPACED]


def test_a_piece_takes_no_python_calls(tokenizers):
    profile = cProfile.Profile()
    texts = [f" w{k:x}q" for k in range(20_000)]
    profile.runcall(token_alignment.align_texts, *tokenizers, texts)
    assert sum(entry.callcount for entry in profile.getstats()) < len(texts)


def test_pairs_of_some_documents_at_a_time(tokenizers, monkeypatch):
    made = []
    for at_once in (1, 5, 1 << 16):
        monkeypatch.setattr(token_alignment, "LINKED_AT_ONCE", at_once)
        block = token_alignment._Block(token_alignment.Known(*tokenizers), pa.array(ODD + ["", "a b a", "don't don't"]))
        made.append([values.tolist() for values in block.linked()])
    assert made[0] == made[1] == made[2]


def test_pairs_with_many_occurrences(spark, tokenizers):
    some = [(k, "ab cd " * n + "e", None, None, None, k, "x", k, "y") for k, n in enumerate([1, 200, 300, 70_000])]
    assert as_set(token_alignment.align_counted(frame(spark, some), *PATHS), *NUMBERS) == brute_alignment(tokenizers, pairs(some))


def test_nothing_to_align(spark):
    assert token_alignment.align_counted(frame(spark, []), *PATHS).count() == 0
    assert token_alignment.align(frame(spark, []), *PATHS).count() == 0


def test_op12(spark, tokenizers):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert as_set(QUERIES["op12_token_alignment"](spark, FOLDER), *NUMBERS) == brute_alignment(tokenizers, docs)


# Periodic runs


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def repetitive(draw):
    words = []
    for _ in range(draw(st.integers(1, 4))):
        part = draw(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=20))
        words += (part * draw(st.integers(1, 7)))[: draw(st.integers(1, 120))]
    return words


@settings(max_examples=300, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4))
def test_runs_are_those_of_all_periods(texts):
    assert periodic_runs.runs_of_texts(texts) == [brute_runs(t) for t in texts]


def test_gram_sizes_serve_all_periods():
    sizes = periodic_runs.gram_sizes(10**6)
    for q in [*range(1, 2000), 10**5, 249_999]:
        assert any(q <= k <= periodic_runs.guaranteed(q) for k in sizes)


def test_long_texts_take_little_more_than_linear_work():
    for words in ([b"a"] * 300_000, [b"a", b"b"] * 150_000, [b"%d" % (i % 70_000) for i in range(300_000)]):
        assert len(periodic_runs.runs_of_texts([words])[0]) == 1


def brute_result(name, words):
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (name, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_odd_rows(spark):
    some = rows() + [(200, "a " * 6, None, None, None, 0, "", 0, ""), (201, "a b " * 4 + "a c a", None, None, None, 0, "", 0, "")]
    found = periodic_runs.digests(periodic_runs.detect(frame(spark, some)))
    assert as_set(found, *found.columns) == sorted((brute_result(i, t.encode().split()) for i, t in pairs(some)), key=repr)
    assert periodic_runs.detect(frame(spark, [])).count() == 0


def test_op13(spark):
    want = []
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        words, h = (row.text or "").encode().split(), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want.append(brute_result(row.doc_id, words))
    found = QUERIES["op13_periodic_runs"](spark, FOLDER)
    assert as_set(found, *found.columns) == sorted(want, key=repr)
    assert any(r[1] for r in want)
