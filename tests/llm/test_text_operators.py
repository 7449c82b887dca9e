"""Exact dedup, token counts, BPE, SimHash, lines and mixing against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderbrook.llm import simhash as sh
from cinderbrook.llm.bpe import BytePairCodec, bpe_decode, bpe_encode, bpe_round_trip, read_ranks
from cinderbrook.llm.exact_dedup import drop_exact_copies, exact_dedup, grace
from cinderbrook.llm.line_dedup import dedup_lines, line_decisions, without_dropped_lines
from cinderbrook.llm.mixing import mix_sources, mixed_documents, source_targets
from cinderbrook.llm.token_counts import PieceAutomaton, split_vocabulary, token_counts

RANKS = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
LONG = "x" * 30_000 + " word" * 3_000

#: Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns.
EDGE = [(1, "Aa bB cc dd ee", "s", "k"), (2, "aA bb cc dd EE", "s", None), (3, None, None, "k"), (4, "", "t", "k"), (5, LONG, "t", "k"), (6, LONG.upper(), None, "k"), (7, "É ß", "s", "k"), (8, "é ß", "s", "k"), (9, "\t\n ", "u", "k"), (9, "\t\n ", "u", "k"), (None, "", "t", "k")]
EDGE_SCHEMA = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


def ascii_lower(text):
    return (text or "").encode().lower()


def test_exact_dedup_edge_cases(spark, edge):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(edge).collect())
    groups = {}
    for i, text, *_ in EDGE:
        groups.setdefault(ascii_lower(text), []).append(i)
    expected = []
    for i, text, *_ in EDGE:
        ids = [x for x in groups[ascii_lower(text)] if x is not None]
        keep = max(ids) if ids else None
        expected.append((-1 if i is None else i, keep, len(groups[ascii_lower(text)]), i == keep, hashlib.sha256(ascii_lower(text)).hexdigest()))
    assert got == sorted(expected)
    assert exact_dedup(empty(spark)).count() == 0
    assert sorted(drop_exact_copies(edge).columns) == sorted(edge.columns)
    assert {r.doc_id for r in drop_exact_copies(edge).collect()} == {r[0] for r in got if r[3]}


def test_grace_partitions_recursively_to_spill_files():
    rng = random.Random(1)
    texts = [f"text {rng.randrange(400)}".encode() * 20 for _ in range(2_000)]
    records = [(hashlib.sha256(t).digest(), t, k, 1) for k, t in enumerate(texts)]
    got = sorted(grace(iter(records), limit=3_000))
    expected = {}
    for digest, text, k, _ in records:
        top, n = expected.get((digest, text), (k, 0))
        expected[digest, text] = (max(top, k), n + 1)
    assert got == sorted((*key, *value) for key, value in expected.items())


def test_equal_digests_of_different_texts_are_refused():
    with pytest.raises(ValueError):
        list(grace(iter([(b"d" * 32, b"a", 1, 1), (b"d" * 32, b"b", 2, 1)]), 1_000))


def greedy(word, first, later, longest=None):
    at = pieces = 0
    longest = longest or max(map(len, first | later), default=0)
    while at < len(word):
        vocabulary = later if at else first
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary), None)
        if end is None and not at and vocabulary is first and b"" in first:
            pieces = greedy(word, later, later, longest)
            return pieces + 1 if pieces else 0
        if end is None:
            return 0
        at, pieces = end, pieces + 1
    return pieces


words = st.text("abc", max_size=12).map(str.encode)


@settings(deadline=None, max_examples=200)
@given(st.sets(words, max_size=8), st.sets(words.filter(len), max_size=8), st.lists(words.filter(len), max_size=20))
def test_automaton_counts_greedy_pieces(first, later, tried):
    automaton = PieceAutomaton(first, later)
    assert [automaton.count(w) for w in tried] == [greedy(w, first, later) for w in tried]


def test_token_counts(spark, edge):
    first, later = split_vocabulary(set(RANKS))
    got = {(r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts(edge, first, later).collect()}
    expected = set()
    for i, text, *_ in EDGE:
        pieces = [greedy(w, first, later, 300) for w in (text or "").encode().split()]
        expected.add((i, len(pieces), sum(max(p, 1) for p in pieces), pieces.count(0)))
    assert got == expected
    assert token_counts(empty(spark), first, later).count() == 0
    others = spark.createDataFrame([(1, "中文没有空格 ภาษาไทย 😀"), (2, "\x00\x01 x")], "doc_id long, text string")
    assert [r.n_unknown for r in token_counts(others, first, later).collect()] == [0, 0]
    assert token_counts(others, first, later).first().n_tokens > 10


def test_vocabularies_that_look_alike_in_one_session(spark):
    """Equal sizes, first tokens, least and largest entries, but two ranks swapped, or one entry changed."""
    df = spark.createDataFrame([(k, "some words and others, again and again") for k in range(4)], "doc_id long, text string").coalesce(1)
    used = [t for t in TIKTOKEN.encode_ordinary("some words and others, again and again")]
    tokens = list(RANKS)
    swapped = dict(RANKS)
    for a, b in zip(used[1::2], used[2::2]):
        swapped[tokens[a]], swapped[tokens[b]] = swapped[tokens[b]], swapped[tokens[a]]
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=swapped, special_tokens={})
    for ranks, codec in ((RANKS, TIKTOKEN), (swapped, other), (RANKS, TIKTOKEN)):
        assert {tuple(r.ids) for r in bpe_encode(df, ranks, public_tokenizers.PATTERN).collect()} == {tuple(codec.encode_ordinary("some words and others, again and again"))}
    single = {bytes([b]) for b in range(256)}
    for later in (single | {b"others"}, single | {b"other!"}, single | {b"others"}):
        first = {b"", b"a", b"z"}
        expected = sum(greedy(w, first, later) for w in b"some words and others, again and again".split())
        assert {r.n_tokens for r in token_counts(df, first, later).collect()} == {expected}


CODEC = BytePairCodec(RANKS, public_tokenizers.PATTERN)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from("abcAB  \n\t\x1c\x85éñß漢1２٣😀'sltverd.,!?́=-"), max_size=80) | st.text(max_size=40), max_size=8))
def test_codec_equals_tiktoken(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for text, ids in zip(texts, CODEC.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == TIKTOKEN.encode_ordinary(text)
        assert CODEC.decode(np.frombuffer(ids, "<u4")) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5_000, "ab" * 3_000, " " * 4_000, "xyz" * 200, "=-" * 700, "aab" * 64, "\n" * 193, "qwertyuiop" * 19])
def test_long_pieces_equal_tiktoken(text):
    assert np.frombuffer(next(CODEC.encode([text])), "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


def test_bpe_operators(spark, edge):
    encoded = bpe_encode(edge, RANKS, public_tokenizers.PATTERN)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.decoded)) for r in bpe_decode(encoded, RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted((-1 if i is None else i, TIKTOKEN.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in EDGE)
    for r in bpe_round_trip(edge.where("doc_id is not null"), RANKS, public_tokenizers.PATTERN).collect():
        text = next(t for i, t, *_ in EDGE if i == r.doc_id) or ""
        ids = TIKTOKEN.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def plain_fingerprint(text):
    words = ascii_lower(text).split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return [min((x for x in groups[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_fingerprints_and_spark_hash_agree(spark):
    text = "one two three four five Six"
    shingles = ["one two three four", "two three four five", "three four five six"]
    hashes = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()
    values = [h[0] & (1 << 64) - 1 for h in hashes]
    assert sh.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > 3)
    assert sh.fingerprint(b"a b") == xxhash.xxh64_intdigest(b"a b", 42) and sh.fingerprint(b" \t") == 0 == sh.fingerprint(None)


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=6), st.sampled_from([5, 6, 7, 8, 9]))
def test_close_fingerprints_share_a_block_key(value, flipped, blocks):
    other = value ^ sum(1 << b for b in flipped)
    if len(flipped) <= sh.DISTANCE:
        assert any(value & m == other & m for m in sh.block_masks(blocks))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 20), max_size=7), min_size=1, max_size=60, unique_by=lambda x: frozenset(k for k in x if x.count(k) % 2)))
def test_spanning_links_connect_what_links_connect(flips):
    values = np.array([np.bitwise_xor.reduce(np.array([1 << b for b in f] + [0], np.uint64)) for f in flips], np.uint64)
    found = set(sh.spanning_links(values))
    close = lambda a, b: int(np.bitwise_count(values[a] ^ values[b])) <= sh.DISTANCE
    assert all(close(a, b) for a, b in found)
    ids = list(range(len(values)))
    assert components(ids, lambda a, b: (a, b) in found or (b, a) in found) == components(ids, close)


@pytest.mark.parametrize("tile_rows", [3, 20_000])
def test_simhash_groups(spark, tile_rows):
    rng = random.Random(5)
    base = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=400)) for _ in range(6)]
    rows = [r[:2] for r in EDGE]
    for k in range(60):
        text = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            text[rng.randrange(400)] = f"n{k}"
        rows.append((100 + k, " ".join(text)))
    got = simhash_rows(spark, rows, tile_rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    expected = components([i for i, _ in rows], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert got == sorted(((-1 if i is None else i), f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, expected))
    assert len({c for *_, c in got}) < len(got) - 10


def simhash_rows(spark, rows, tile_rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in sh.simhash_groups(df, tile_rows=tile_rows).collect())


def test_simhash_of_nothing(spark):
    assert sh.simhash_groups(empty(spark)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits_bound, least_chars", [(1, 1), (1, 4), (0, 1), (2, 1)])
def test_line_dedup_against_all_pairs(spark, edits_bound, least_chars):
    rng = random.Random(3)
    n_docs, longest = (60, 30) if edits_bound < 2 else (25, 9)
    base = ["".join(rng.choices("abé😀 ", k=rng.randint(0, longest))) for _ in range(12)]

    def mutated(line):
        chars = list(line)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at, kind = rng.randint(0, len(chars)), rng.randint(0, 2)
            if kind == 0:
                chars.insert(at, rng.choice("abé😀"))
            elif chars and kind == 1:
                chars.pop(min(at, len(chars) - 1))
            elif chars:
                chars[min(at, len(chars) - 1)] = rng.choice("abé😀")
        return "".join(chars)

    docs = [(i, None if i == 5 else "\n".join(mutated(rng.choice(base)) for _ in range(rng.randint(1, 6)))) for i in range(n_docs)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, line string")
    options = {"edits": edits_bound, "least_chars": least_chars}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in dedup_lines(df, **options).collect()}
    reasons = {(r.doc_id, r.at): (r.first_id, r.first_at) for r in line_decisions(df, **options).collect()}
    seen, expected, because = [], {}, {}
    for i, text in docs:
        lines = [] if text is None else text.split("\n")
        dropped = []
        for k, line in enumerate(lines):
            if line.strip(" "):
                near = lambda s: line == s or (min(len(line), len(s)) >= least_chars and edits(line, s) <= edits_bound)  # noqa: B023, E731
                earlier = next((place for place, s in seen if near(s)), None)
                if earlier:
                    dropped.append(k)
                    because[i, k] = earlier
                seen.append(((i, k), line))
        expected[i] = (len(lines), len(dropped), dropped)
    assert got == expected and reasons == because
    cleaned = {r.doc_id: r.text for r in without_dropped_lines(df, **options).collect()}
    for i, text in docs:
        assert cleaned[i] == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected[i][2]))


def test_near_equal_lines_of_every_length(spark):
    """From one character to very long ones, each with an edit at its start, middle or end; and a common line in every text."""
    rng = random.Random(8)
    lines = ["".join(rng.choices("abcdefghij", k=n)) for n in (15, 16, 17, 200, 20_000, 20_001)]
    docs = [(0, "\n".join(["fifteen chars a", "sixteen chars aa", "a", *lines]))]
    for k, edit in enumerate((lambda s: "#" + s[1:], lambda s: s[: len(s) // 2] + s[len(s) // 2 + 1 :], lambda s: s + "#")):
        docs.append((k + 1, "\n".join(["fifteen chars b", "sixteen chars ab", "b", *map(edit, lines), "quite another line " + "xyz"[k] * 40])))
    docs += [(10 + k, "a line that is everywhere\nand its own number " + "0123456789"[k] * 9) for k in range(10)]
    got = {r.doc_id: r.dropped for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0] == [] and all(got[k] == list(range(9)) for k in (1, 2, 3))
    assert got[10] == [] and all(got[10 + k] == [0] for k in range(1, 10))


def test_line_dedup_edge_cases(spark, edge):
    got = {r.doc_id: r.n_dropped for r in dedup_lines(edge).collect() if r.doc_id != 9}
    assert got[1] == 0 and got[3] == 0 and got[None] == 0
    assert dedup_lines(empty(spark)).count() == 0


def water_filling(sizes, weights, total):
    open_sources, target = set(sizes), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_sources) for s in open_sources}
        over = [s for s in open_sources if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_sources.discard(s)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_source_targets_are_the_reshared_ones(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([1, 10, 200, 5_000]) for k in range(9)} | {None: 40}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    expected = water_filling(sizes, weights, sum(sizes.values()))
    assert got == pytest.approx(expected)


def test_mixing(spark, edge):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", "c", "d", None])) for k in range(400)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    got = mix_sources(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(df.repartition(7)).collect()))
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        mine = [r for r in got if source[r.doc_id] == s]
        assert sum(r.taken for r in mine) == round(mine[0].target)
        assert all(r.size == sizes[r.doc_id] and r.taken <= 3 * r.size for r in mine)
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
    times = {r.doc_id: -(-r.taken // r.size) for r in got if r.taken}
    copies = {r.doc_id: r["count"] for r in mixed_documents(df).groupBy("doc_id").count().collect()}
    assert copies == times and mixed_documents(df).columns == df.columns
    assert mix_sources(empty(spark)).count() == 0
    assert sum(r.taken for r in mix_sources(edge).collect()) == sum(len((t or "").split()) for _, t, *_ in EDGE)
