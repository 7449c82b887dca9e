"""WARC, URL filters, toxicity, embeddings and the pipeline against plain Python."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cinderbrook.llm import embedding_dedup as emb
from cinderbrook.llm.bpe import read_ranks
from cinderbrook.llm.simhash import fingerprint, simhash_groups
from cinderbrook.llm.toxicity import BlockMaxIndex, fit_toxicity, score_toxicity
from cinderbrook.llm.url_filters import DAMPING, RULES, judge_urls
from cinderbrook.llm.warc import VERSION, parse_head, read_warc, warc_round_trip, write_warc

RECORD = f"{VERSION}WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/x", "plain"), (2, "http://b/\r\ny", "magic " + VERSION + " inside"), (3, None, RECORD), (4, "u", RECORD * 3 + "tail"), (5, "u", None), (6, "u", ""),
    (7, "u", "plain"), (8, "u", "é" * 4_000 + VERSION + "x" * 3_000 + RECORD), (8, "u", "é" * 4_000 + VERSION + "x" * 3_000 + RECORD), (None, "u", "no id"), (9, "u", VERSION), (10, "u", "\r\n\r\n" + VERSION[:-1]),
]
PAGE_SCHEMA = "page_id long, url string, html string, record_type string"


@pytest.mark.parametrize("stretch", ["4k", "128m"])
def test_warc_keeps_records_apart_whatever_payloads_hold(spark, tmp_path, stretch):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], PAGE_SCHEMA).coalesce(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", stretch)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(map(tuple, warc_round_trip(df, f"file://{tmp_path}/w").collect()), key=str)
        records = read_warc(spark, f"file://{tmp_path}/w").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    expected = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        top = max((j for j, _, h in PAGES if j is not None and (h or "") == (html or "")), default=None)
        revisit = i is not None and i != top
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(expected, key=str)
    by_id = {r.record_id: bytes(r.payload) for r in records if r.warc_type == "response" and r.record_id}
    assert by_id["<urn:page:4>"] == (RECORD * 3 + "tail").encode() and by_id["<urn:page:8>"] == PAGES[7][2].encode()
    for r in records:
        assert open(urlparse(r.file).path, "rb").read()[r.offset :].startswith(VERSION.encode())


def test_warc_of_nothing_and_of_a_broken_file(spark, tmp_path):
    empty = spark.createDataFrame([], PAGE_SCHEMA)
    assert warc_round_trip(empty, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/a.warc").write_bytes((RECORD * 2 + RECORD[:-9]).encode())
    (tmp_path / "cut/b.warc").write_bytes(("junk" + RECORD).encode())
    assert [bytes(r.payload) for r in read_warc(spark, f"file://{tmp_path}/cut").collect()] == [b"hello"] * 2


def test_warc_splits_that_change_between_the_readings(spark, tmp_path):
    """Splits follow minPartitionNum (by default the live cores); both readings must cut alike and lose no record."""
    pages = [(k, f"http://a/{k}", f"payload {k} " * 40) for k in range(400)]
    write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    digests = sorted(hashlib.sha1(html.encode()).hexdigest() for _, _, html in pages)
    for before, after in (("1", "64"), ("64", "1"), ("7", "40")):
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", before)
        try:
            records = read_warc(spark, f"file://{tmp_path}/w")
            spark.conf.set("spark.sql.files.minPartitionNum", after)
            assert sorted(hashlib.sha1(r.payload).hexdigest() for r in records.collect()) == digests
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_archive_that_changes_between_the_readings_is_refused(spark, tmp_path):
    write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    records = read_warc(spark, f"file://{tmp_path}/w")
    archive = next((tmp_path / "w").glob("part-*"))
    archive.write_bytes(archive.read_bytes().replace(b"WARC/1.1", b"warc/1.1", 1)[::-1])
    (archive.parent / f".{archive.name}.crc").unlink()
    with pytest.raises(Exception, match="changed between two readings"):
        records.collect()


def test_an_id_with_several_payloads(spark, tmp_path):
    pages = [(1, "u", "p"), (5, "u", "p"), (5, "u", "q"), (5, "u", "r"), (7, "u", "q"), (7, "u", "r"), (3, "u", "r"), (3, "u", "alone"), (7, "u", "r"), (2, "u", "alone 2")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc_round_trip(df, f"file://{tmp_path}/w").collect())
    expected = []
    for i, _, html in pages:
        top = max(j for j, _, h in pages if h == html)
        expected.append((i, base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(), len(html), "response" if i == top else "revisit", 0 if i == top else top))
    assert got == sorted(expected)
    payloads = {bytes(r.payload).decode() for r in read_warc(spark, f"file://{tmp_path}/w").collect() if r.warc_type == "response"}
    assert payloads == {html for *_, html in pages}


def test_heads_that_are_none():
    assert parse_head(b"WARC-Type: x\r\nContent-Length: 5\r\n\r\nhello")[0] == len(VERSION) + 35 + 5 + 4
    assert all(parse_head(x) is None for x in (b"", b"no colon\r\n\r\n", b"Content-Length: 5\r\n\r\n", b"WARC-Type: x\r\nContent-Length: -1\r\n\r\n"))


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]


def test_url_filters_against_a_plain_walk(spark):
    rng = random.Random(4)
    hosts = [f"h{k}.example.{d}" for k in range(6) for d in ("com", "net", "org")] + ["com", "É.fr"]
    pages = []
    for k in range(200):
        links = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4)))
        pages.append((k, f"http{rng.choice(['', 's'])}://{rng.choice(hosts).upper()}{rng.choice(['/en/7', '/en/', '/de/8', '/de/', '/es/1', '/fr', '', '?q=/de/', '#/en/'])}", links))
    pages += [(900, None, None), (901, "no scheme", "<a href='http://h0.example.com'>"), (902, "x://", ""), (900, None, None)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.trust, r.distrust) for r in judge_urls(df).collect() if r.page_id is not None)
    found, seeds, links = [], {"trust": Counter(), "distrust": Counter()}, Counter()
    for i, url, html in pages:
        host, path = plain_url(url)
        rule = max((r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), key=lambda r: len(r[1] + r[2]), default=None)
        found.append((i, host, path, rule))
        if rule and host:
            seeds["trust" if rule[0] == "allow" else "distrust"][host] += 1
        for target in {part.split("//", 1)[1].split("/")[0].lower() if part.split("//", 1)[1].split("/")[0].isascii() else part.split("//", 1)[1].split("/")[0] for part in (html or "").split('href="')[1:]}:
            if host and target != host:
                links[host, target] += 1
    score = {}
    for kind in seeds:
        edges = links if kind == "trust" else {(b, a): n for (a, b), n in links.items()}
        out = Counter()
        for (a, _), n in edges.items():
            out[a] += n
        walk, total = dict(seeds[kind]), Counter(seeds[kind])
        for _ in range(60):
            step = Counter()
            for (a, b), n in edges.items():
                if a in walk:
                    step[b] += walk[a] * n / out[a] * DAMPING
            walk = step
            total.update(step)
        score[kind] = {h: x * (1 - DAMPING) for h, x in total.items()}
    expected = []
    for i, host, path, rule in found:
        t, d = (score[k].get(host, 0.0) for k in ("trust", "distrust"))
        verdict = rule[0] if rule else "block" if t + d and round(d / (t + d), 9) > 0.5 else "allow"
        expected.append((i, host, path, rule[1] + rule[2] if rule else None, verdict, pytest.approx(t, abs=0.01), pytest.approx(d, abs=0.01)))
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert judge_urls(spark.createDataFrame([], df.schema)).count() == 0


def test_trust_is_walked_until_the_tolerance_and_to_the_last_host(spark):
    cycle = [(1, "http://a.net/de/1", '<a href="http://b.fr/x">'), (2, "http://b.fr/x", '<a href="http://a.net/de/1">')]
    chain = [(10 + k, f"http://h{k}.fr/", f'<a href="http://h{k + 1}.fr/">') for k in range(70)] + [(99, "http://h70.fr/", '<a href="http://x.org/es/">'), (100, "http://x.org/es/", "")]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(cycle + chain, "page_id long, url string, html string")).collect()}
    exact = (1 - DAMPING) * 1 / (1 - DAMPING**2)
    assert got[1].trust == pytest.approx(exact, abs=1e-4) and got[2].trust == pytest.approx(exact * DAMPING, abs=1e-4)
    assert {got[k].verdict for k in got if k >= 10} == {"block"}  # 71 links from the seed, and only distrust leads there


vectors = st.dictionaries(st.integers(0, 8), st.floats(0.1, 1), max_size=5).map(lambda v: {k: x / math.sqrt(sum(y * y for y in v.values())) for k, x in v.items()})


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(vectors, st.integers(0, 1)), max_size=40), vectors, st.integers(1, 8), st.integers(1, 6))
def test_block_max_search_is_exact(examples, query, wanted, block):
    index = BlockMaxIndex([(k, y, v) for k, (v, y) in enumerate(examples)], block, 9)
    queries = [query, *(v for v, _ in examples[:10]), {}]
    dense = np.zeros((len(queries), 9))
    for row, vector in enumerate(queries):
        dense[row, list(vector)] = list(vector.values())
    for one, near, place in zip(queries, *index.nearest(dense, wanted)):
        every = sorted(((round(sum(x * v.get(k, 0.0) for k, x in one.items()), 9), i) for i, (v, _) in enumerate(examples)), key=lambda r: (-r[0], r[1]))
        every = [r for r in every if r[0] > 0][:wanted]
        assert near[: len(every)].tolist() == pytest.approx([s for s, _ in every]) and set(place[len(every) :]) <= {-1}
        if len({round(s, 7) for s, _ in every}) == len(every):
            assert index.ids[place[: max(0, len(every) - 1)]].tolist() == [i for _, i in every[:-1]]


def test_toxicity_end_to_end_against_brute_force(spark):
    """Terms, document frequencies, cosines with every example, votes and the fitted map, all anew in plain Python."""
    rng = random.Random(6)
    words = [f"wort{k}" for k in range(40)] + ["calm", "quiet", "é"]
    bad = ["vile", "vilest", "grim"]
    docs, labels = [], []
    for k in range(160):
        text = rng.choices(words, k=rng.randint(0, 30))
        toxic = rng.random() < 0.3
        text += rng.choices(bad, k=rng.randint(1, 4)) if toxic and rng.random() < 0.9 else []
        rng.shuffle(text)
        docs.append((k, None if k == 9 else " ".join(text)))
        if k % 4:
            labels.append((k, int(toxic)))
    docs += [(200, docs[1][1]), (201, ""), (202, "grim grim Vile wort1")]
    labels.append((200, 1))
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(frame, marks, neighbours=5)
    got = {r.doc_id: (r.score, r.predicted, [(e.doc_id, e.similarity, e.toxic) for e in r.evidence]) for r in score_toxicity(frame, model).collect()}

    def terms(text):
        found = Counter()
        for word in re.findall(r"\w+", (text or "").lower()):
            found[word] += 1
            for n in range(2, 8):
                if len(word) > n:
                    found["^" + word[:n]] += 1
        return found

    learnt = {}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 5:
            learnt.setdefault(dict(docs)[i] or "", []).append((i, y))
    examples = sorted((min(i for i, _ in rows), max(y for _, y in rows), text) for text, rows in learnt.items())
    p, n = sum(y for _, y, _ in examples), sum(1 - y for _, y, _ in examples)
    chi = {}
    for term in set().union(*(terms(text) for *_, text in examples)):
        a, b = (sum(term in terms(text) for _, y, text in examples if y == label) for label in (1, 0))
        spread = (a + b) * (p + n - a - b) * p * n
        if a + b >= 5 and spread and (value := round((p + n) * (a * (n - b) - b * (p - a)) ** 2 / spread, 6)) >= 16:
            chi[term] = value
    assert set(model.numbers) == set(chi) and chi
    idf = {term: math.log((1 + len(docs)) / (1 + sum(term in terms(text) for _, text in docs))) for term in chi}

    def vector(text):
        raw = {term: (1 + math.log(k)) * idf[term] for term, k in terms(text).items() if term in idf and idf[term] > 0}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {term: x / norm for term, x in raw.items()}

    def nearest(text, but=None):
        mine = vector(text)
        every = [(-round(sum(x * other.get(t, 0.0) for t, x in mine.items()), 9), i, y) for i, y, other in held if i != but]
        return [(i, -s, y) for s, i, y in sorted(every)[:5] if s < 0]

    held = [(i, y, vector(text)) for i, y, text in examples]
    share = lambda near: (sum(s * s * y for _, s, y in near) + 0.3 * p / (p + n)) / (sum(s * s for _, s, _ in near) + 0.3)
    left_out = np.array([share(nearest(text, i)) for i, _, text in examples])
    x, target = np.log(left_out / (1 - left_out)), np.array([(p + 1) / (p + 2) if y else 1 / (n + 2) for _, y, _ in examples])
    loss = lambda a, b: float(np.sum(np.logaddexp(0, a * x + b) - target * (a * x + b)))
    best = loss(model.slope, model.offset)
    assert all(best <= loss(model.slope + da, model.offset + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    for i, text in docs:
        near = nearest(text)
        vote = share(near)
        score = 1 / (1 + math.exp(-(model.slope * math.log(vote / (1 - vote)) + model.offset)))
        assert got[i][0] == pytest.approx(score, abs=1e-6) and got[i][1] == int(got[i][0] >= 0.5)
        assert [s for _, s, _ in got[i][2]] == pytest.approx([s for _, s, _ in near], abs=1e-8)
    assert got[202][1] == 1 and got[201][1] == 0 and got[201][2] == []


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(scored) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in scored.items())
    held = [(truth[i], r.predicted) for i, r in scored.items() if r.held_out and i in truth]
    hits, missed, false = (sum(h == pair for h in held) for pair in ((1, 1), (1, 0), (0, 1)))
    assert hits / (hits + missed) >= 0.9 and hits / (hits + false) > 0.95
    chance = {i: r.score for i, r in scored.items() if r.held_out and i in truth}
    assert sum((x - truth[i]) ** 2 for i, x in chance.items()) / len(chance) < 0.02  # Brier score; always 0.11 would give 0.1


def test_toxicity_edge_cases(spark):
    rows = [(k, f"calm words here {k}" if k % 2 else f"vile wording here {k}", "s") for k in range(60)] + [(None, "vile", "s"), (100, None, "s"), (101, "", None), (7, "calm words here 7", "s"), (102, "vile " * 20_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert got[102].predicted == 1 and got[None].predicted == 1 and got[None].held_out is False and got[7].predicted == 0
    assert got[100].score == got[101].score == pytest.approx(float(model.calibrated(np.array([model.prior]))[0])) and got[100].evidence == []
    flipped = fit_toxicity(docs, labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic"))
    assert flipped.examples == model.examples
    none = fit_toxicity(docs.limit(0), labels.limit(0))
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.0} and score_toxicity(docs.limit(0), model).count() == 0


def plain_groups(vectors, ids):
    usable = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for v, ok in zip(vectors, usable)]
    near = [[j for j in range(len(ids)) if j != i and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.9] for i in range(len(ids))]
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, partners in enumerate(near):
        for j in partners:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(find(k), []).append(ids[k])
    return [(ids[k], len(near[k]), min(groups[find(k)]), ids[k] == min(groups[find(k)])) for k in range(len(ids))]


@pytest.mark.parametrize("options", [{}, {"leaf": 16, "tile_rows": 10, "trees": 8, "sample_rows": 64}])
def test_embedding_groups(spark, options):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 8))
    rows = [centers[k % 12] + rng.standard_normal(8) * rng.choice([0.05, 0.15, 0.25]) for k in range(240)]
    rows = [list(map(float, v)) for v in rows] + [[float(x) for x in rows[0]]] * 5
    rows += [[float(x) for x in row[:3]] for row in rows[:40]] + [[1.0] * 4, [], [2.5], [0.5], [-1.0]]  # other lengths link among themselves
    rows += [None, [0.0] * 8, [1.0] * 3, [None, *[1.0] * 7], [math.nan, *[1.0] * 7], [math.inf, *[1.0] * 7], [-0.0, 1.0, *[0.0] * 6], [0.0, 1.0, *[-0.0] * 6], [1e-300, *[0.0] * 7], [1e300] * 8]
    ids = [int(x) for x in rng.permutation(len(rows)) + 10]
    df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, rows)], "vec_id long, embedding array<double>, n_links int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.embedding_groups(df, **options).collect())
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = [None if v is None else [None if x is None else x / (max((abs(y) for y in v if y is not None and math.isfinite(y)), default=1) or 1) for x in v] for v in rows]
    assert got == sorted(plain_groups(scaled, ids))
    assert emb.embedding_groups(df.limit(0)).count() == 0


def test_one_longer_vector_changes_nothing_for_the_others(spark):
    rows = [(k, [1.0, 0.01 * k, 0.0]) for k in range(6)]
    schema = "vec_id long, embedding array<float>"
    plain = sorted(map(tuple, emb.embedding_groups(spark.createDataFrame(rows, schema)).collect()))
    got = sorted(map(tuple, emb.embedding_groups(spark.createDataFrame([*rows, (9, [1.0, 0.0, 0.0, 0.0])], schema)).collect()))
    assert got == [*plain, (9, 0, 9, True)] and {n for _, n, *_ in plain} == {5}


@pytest.mark.parametrize("n", [1_500, 6_000])
def test_forest_recall_at_the_threshold(spark, n):
    """Pairs exactly at the threshold, the hardest ones, meet in a leaf of some tree, at two sizes."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    partner = 0.9001 * base + math.sqrt(1 - 0.9001**2) * side
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.vstack([base, partner]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in emb.embedding_groups(df, leaf=64).collect()}
    assert sum(got[n + k] == (1, k) for k in range(n)) / n > 0.99


def test_a_dense_group_stays_one_leaf():
    """Where most of a node would go down both sides, it isn't split: leaves can't multiply its rows."""
    rng = np.random.default_rng(1)
    dense = rng.standard_normal(16) + 0.01 * rng.standard_normal((3_000, 16))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    assert (emb.grow(dense, 3_000, 7, 0, 1, 64, emb.margin_of(16, 0.9, emb.OVERLAP))[0] < 0).all()


def test_scratch_tables_go_with_their_block_and_after_stop(spark, tmp_path):
    from cinderbrook.llm.common import Scratch, freed

    df = spark.createDataFrame([(k, f"text {k % 5}") for k in range(50)], "doc_id long, text string")
    before = list(Scratch._open)
    with freed():
        rows = simhash_groups(df).collect()
        made = [s for s in Scratch._open if s not in before]
        assert len(rows) == 50 and made
    assert Scratch._open == before and not any(s.files.exists(s.path(s.root)) for s in made)
    script = f"""
import sys; sys.path.insert(0, {str(Path(corpus_pipeline.__file__).parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from cinderbrook.llm.simhash import simhash_groups
simhash_groups(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=300)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_pipeline_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_copies", "near_copies", "source_mix", "token_ids"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, sf_dir)
        if name != "token_ids":
            assert result.columns == docs.columns
        rows = result.collect()
        docs = spark.createDataFrame(rows, result.schema)
        kept[name] = rows
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    after = {r.doc_id for r in kept["toxicity"]}
    winners = {}
    for i in after:
        key = (text[i] or "").encode().lower()
        winners[key] = max(winners.get(key, i), i)
    assert {r.doc_id for r in kept["exact_copies"]} == set(winners.values())
    ids = sorted(winners.values())
    prints = {i: fingerprint((text[i] or "").encode()) for i in ids}
    root = {i: i for i in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id for r in kept["near_copies"]} == {i for i in ids if find(i) == i}
    assert {r.doc_id for r in kept["source_mix"]} <= {r.doc_id for r in kept["near_copies"]}
    assert Counter(r.doc_id for r in kept["token_ids"]) == Counter(r.doc_id for r in kept["source_mix"])
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == codec.encode_ordinary(text[r.doc_id]) for r in kept["token_ids"])


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "plain words of one row", "en", "a", 1), (1, "plain words of one row", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "a text without an id", "en", "a", 1), (4, "word " * 30_000, "en", None, 1), (5, "x" * 60_000, "en", "b", 1)]
    odd = spark.createDataFrame(rows, schema)
    kept = {"toxicity": 7, "exact_copies": 6, "near_copies": None, "source_mix": None, "token_ids": 7}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        found = got.collect()
        assert kept[name] is None or len(found) == kept[name]
        assert name == "token_ids" or got.columns == odd.columns
        if name == "near_copies":  # the two wordless rows have one fingerprint
            assert sorted((r.doc_id for r in found), key=str) == [1, 1, 2, 4, 5, None]
        if name == "source_mix":
            taken = Counter(r.doc_id for r in found)
            assert taken[2] == taken[3] == 0 and taken[1] % 2 == 0 and taken[4] >= 1
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
