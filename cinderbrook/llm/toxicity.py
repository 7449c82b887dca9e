"""Toxicity by the nearest labelled examples, with evidence.

A bounded sample of labelled rows gives the examples. The terms are the words and word beginnings that tell the labels apart (chi
squared over distinct example texts); their document frequencies are counted over the whole corpus. Texts and examples are unit
TF-IDF vectors over the terms, and their similarity is the cosine. The examples form an inverted index in blocks; each term knows
its largest weight in each block. A batch of documents visits its blocks by falling upper bound and a document's search ends when
no block can hold a nearer example, so the nearest are exact. Their votes count by squared similarity, and the sample's share of
toxic rows votes with them; a logistic map, fitted to the votes that each example gets from the others, makes the vote a
probability: the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, in_batches

#: Labelled rows that become examples, at most.
EXAMPLES = 8_000
#: Terms kept, at most.
FEATURES = 1_024
#: Chi squared that a term must reach: chance passes one in fifteen thousand. This, NEIGHBOURS and BEGINNINGS are those that
#: four-fold cross-validation on the training rows of a labelled corpus preferred; held-out rows had no say.
LEAST_CHI = 16.0
#: Lengths of the word beginnings that are terms beside whole words.
BEGINNINGS = (2, 3, 4, 5, 6, 7)
#: Distinct example texts that a term must be in.
LEAST_TEXTS = 5
#: Examples that vote.
NEIGHBOURS = 25
#: Weight of the sample's share of toxic rows among the votes.
PRIOR_WEIGHT = 0.3
#: Examples in a block of the index.
BLOCK = 64
#: Documents that are searched for together.
QUERIES = 2_048
#: Words that a worker remembers the terms of.
MEMO = 100_000
#: Similarities count to so many decimals, so that equal examples tie however they are summed.
DECIMALS = 9

WORDS = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def text_features(text: str | None) -> Counter:
    """How often each feature is in a whole text."""
    found: Counter = Counter()
    for word, times in Counter(WORDS.findall((text or "").lower())).items():
        for feature in word_features(word):
            found[feature] += times
    return found


class Chosen(dict):
    """word -> numbers of the chosen features it carries; remembers words up to a bound."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers
        # a word carries no chosen feature unless its first four characters begin one, or a shorter beginning is one
        self.fours = {f.removeprefix("^")[:4] for f in numbers if len(f.removeprefix("^")) >= 4 or not f.startswith("^")}
        self.threes, self.twos = ({f[1:] for f in numbers if f.startswith("^") and len(f) == n + 1} for n in (3, 2))

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        if len(self) < MEMO:
            self[word] = found
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        fours, threes, twos = self.fours, self.threes, self.twos
        for word in WORDS.findall((text or "").lower()):
            if word[:4] in fours or word[:3] in threes or word[:2] in twos:
                for k in self[word]:
                    found[k] = found.get(k, 0) + 1
        return found


class BlockMaxIndex:
    """Inverted lists of unit vectors, in blocks with their largest weights; exact top-k by inner product for many queries."""

    def __init__(self, examples: list[tuple[int, int, dict[int, float]]], block: int, terms: int):
        held = [x for x in examples if x[2]]
        held.sort(key=lambda x: (max(x[2], key=lambda k: (x[2][k], -k)), x[0]))  # alike vectors share blocks: tight bounds
        self.ids = np.array([x[0] for x in held], np.int64)
        self.labels = np.array([x[1] for x in held], np.int64)
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []  # of a block: its terms, and their weights in each of its examples
        self.highest = np.zeros((-(-len(held) // block), terms))
        self.starts = list(range(0, len(held), block))
        for b, start in enumerate(self.starts):
            part = [x[2] for x in held[start : start + block]]
            used = sorted({k for vector in part for k in vector})
            place = {k: at for at, k in enumerate(used)}
            weights = np.zeros((len(used), len(part)))
            for at, vector in enumerate(part):
                for k, weight in vector.items():
                    weights[place[k], at] = weight
            self.lists.append((np.array(used, np.int64), weights))
            self.highest[b, used] = weights.max(axis=1)

    def nearest(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(similarities, positions) of each query's `wanted` nearest examples, nearest first, of equals the smaller id first.

        Only positive similarities count; position -1 fills up a row.
        """
        near = np.zeros((len(queries), wanted))
        place = np.full((len(queries), wanted), -1, np.int64)
        bounds = queries @ self.highest.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        going = np.arange(len(queries))
        for turn in range(len(self.starts)):
            blocks = order[going, turn]
            bound = bounds[going, blocks] + 10.0**-DECIMALS
            open_still = (bound > 2 * 10.0**-DECIMALS) & (bound >= near[going, -1])
            going, blocks = going[open_still], blocks[open_still]
            if not len(going):
                break
            by_block = np.argsort(blocks, kind="stable")
            for rows in np.split(going[by_block], np.flatnonzero(np.diff(blocks[by_block])) + 1):
                b = int(order[rows[0], turn])
                terms, weights = self.lists[b]
                found = np.round(queries[np.ix_(rows, terms)] @ weights, DECIMALS)
                at = np.where(found > 0, np.arange(self.starts[b], self.starts[b] + weights.shape[1]), -1)
                every, places = np.hstack([near[rows], found]), np.hstack([place[rows], at])
                ids = np.where(places >= 0, self.ids[places], np.iinfo(np.int64).max)
                best = np.lexsort((ids, -every), axis=1)[:, :wanted]
                near[rows], place[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(places, best, 1)
        return near, place


@dataclass
class ToxicityModel:
    """Terms, their weights, the examples as (id, label, {term: weight}) with unit vectors, and the map from votes to scores."""

    numbers: dict[str, int]
    weights: list[float]
    examples: list[tuple[int, int, dict[int, float]]]
    prior: float
    neighbours: int = NEIGHBOURS
    prior_weight: float = PRIOR_WEIGHT
    block: int = BLOCK
    slope: float = 1.0
    offset: float = 0.0
    _index: BlockMaxIndex | None = field(default=None, repr=False)
    _chosen: Chosen | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_chosen": None}

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit TF-IDF vector; empty if no feature has weight."""
        raw = {k: (1 + math.log(n)) * self.weights[k] for k, n in sorted(counts.items()) if self.weights[k] > 0}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {k: x / norm for k, x in raw.items()} if norm else {}

    def votes(self, vectors: list[dict[int, float]], own_ids: list[int] | None = None) -> tuple[np.ndarray, list[list[tuple[int, float, int]]]]:
        """The toxic part of the votes on each vector, and its nearest examples (id, similarity, label). own_ids don't vote."""
        if self._index is None:
            self._index = BlockMaxIndex(self.examples, self.block, len(self.numbers))
        queries = np.zeros((len(vectors), len(self.numbers)))
        for row, vector in enumerate(vectors):
            queries[row, list(vector)] = list(vector.values())
        near, place = self._index.nearest(queries, self.neighbours + (own_ids is not None))
        if own_ids is not None:
            mine = (place >= 0) & (self._index.ids[place] == np.array(own_ids)[:, None]) if len(self._index.ids) else np.zeros(place.shape, bool)
            first = np.argsort(mine, axis=1, kind="stable")[:, : self.neighbours]  # one's own place goes last
            near, place = np.take_along_axis(near, first, 1), np.take_along_axis(place, first, 1)
        toxic = np.where(place >= 0, self._index.labels[place], 0) if len(self._index.ids) else np.zeros(place.shape)
        squares = near * near
        share = ((squares * toxic).sum(axis=1) + self.prior_weight * self.prior) / (squares.sum(axis=1) + self.prior_weight)
        evidence = [[(int(self._index.ids[p]), float(s), int(y)) for s, p, y in zip(*row) if p >= 0] for row in zip(near, place, toxic)]
        return share, evidence

    def judge(self, texts: Iterable[str | None]) -> tuple[np.ndarray, list[list[tuple[int, float, int]]]]:
        """The scores of whole texts and their nearest examples (id, similarity, label), nearest first."""
        if self._chosen is None:
            self._chosen = Chosen(self.numbers)
        profiles = [tuple(sorted(self._chosen.counts(text).items())) for text in texts]
        distinct = {profile: row for row, profile in enumerate(dict.fromkeys(profiles))}
        share, evidence = self.votes([self.vector(dict(profile)) for profile in distinct])
        rows = [distinct[profile] for profile in profiles]
        return self.calibrated(share)[rows], [evidence[row] for row in rows]

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * log_odds(share) + self.offset))) if self.examples else share


def log_odds(share: np.ndarray) -> np.ndarray:
    inner = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(inner / (1 - inner))


def logistic_map(share: np.ndarray, toxic: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic regression of the labels on the votes' log odds, by Newton's method.

    Targets are drawn in from 0 and 1 by one pseudo-count each. With one label only, votes stay as they are.
    """
    n, p = len(toxic), int(toxic.sum())
    if not 0 < p < n:
        return 1.0, 0.0
    x = np.column_stack([log_odds(share), np.ones(n)])
    target = np.where(toxic > 0, (p + 1) / (p + 2), 1 / (n - p + 2))
    line = np.array([1.0, 0.0])
    for _ in range(turns):
        chance = 1 / (1 + np.exp(-(x @ line)))
        bend = (x * (chance * (1 - chance))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(bend, x.T @ (target - chance))
        line = line + step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(line[0]), float(line[1])) if line[0] > 0 else (1.0, 0.0)


def held_out(id_column) -> F.Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, examples: int = EXAMPLES, features: int = FEATURES, neighbours: int = NEIGHBOURS, prior_weight: float = PRIOR_WEIGHT, block: int = BLOCK) -> ToxicityModel:
    """Learns from at most `examples` labelled rows that are not held out, chosen by a hash of their id.

    Only ids, texts and the one label are read. Rows without id or label aren't learnt from; an id with several labels has the
    largest, an id with several texts the least; equal texts are one example, toxic if any of them is. Document frequencies are
    counted over all of `docs`. Only the terms, the examples and their votes on each other come to the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id")))
    usable = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64(F.lit("example"), "id"), "id").limit(examples)
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = scratch.keep(sample.groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")), "sample")
    n_docs = texts.count()

    count_schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])
    arrow_counts = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def label_counts(batches):
        for batch in batches:
            found: dict[str, list[int]] = {}
            for toxic, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                for feature in text_features(text):
                    found.setdefault(feature, [0, 0])[0 if toxic else 1] += 1
            yield from in_batches(((f, *n) for f, n in found.items()), arrow_counts)

    totals = sample.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    counts = sample.select(F.greatest("toxic", F.lit(0)).alias("toxic"), "text").mapInArrow(label_counts, count_schema).groupBy("feature").agg(F.sum("toxic").cast("double").alias("a"), F.sum("clean").cast("double").alias("b"))
    p, n = float(totals["toxic"]), float(totals["all"] - totals["toxic"])
    spread = (F.col("a") + F.col("b")) * (p + n - F.col("a") - F.col("b")) * p * n
    chi = F.try_divide((p + n) * F.pow(F.col("a") * (n - F.col("b")) - F.col("b") * (p - F.col("a")), 2), spread)
    ranked = counts.where(F.col("a") + F.col("b") >= LEAST_TEXTS).select("feature", F.round(chi, 6).alias("chi")).where(F.col("chi") >= LEAST_CHI)
    ranked = ranked.orderBy(F.desc("chi"), "feature").limit(features).collect()
    numbers = {row["feature"]: k for k, row in enumerate(ranked)}

    def document_frequencies(batches):
        chosen_features, total = Chosen(numbers), np.zeros(len(numbers), np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[list(chosen_features.counts(text.as_py()))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(numbers)), pa.int32()), pa.array(total)], names=["k", "n"])

    frequencies = {row["k"]: row["n"] for row in texts.select("text").mapInArrow(document_frequencies, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    weights = [math.log((1 + n_docs) / (1 + frequencies.get(k, 0))) for k in range(len(numbers))]
    model = ToxicityModel(numbers, weights, [], 0.0, neighbours, prior_weight, block)

    def vectors(batches):
        chosen_features = Chosen(numbers)
        schema = pa.schema([("id", pa.int64()), ("toxic", pa.int32()), ("k", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)))
            made = ((i, y, model.vector(chosen_features.counts(t))) for i, y, t in rows)
            yield from in_batches(((i, y, list(v), list(v.values())) for i, y, v in made), schema)

    rows = sample.select("id", "toxic", "text").mapInArrow(vectors, "id long, toxic int, k array<int>, w array<double>").collect()
    model.examples = sorted((r["id"], int(r["toxic"] > 0), dict(zip(r["k"], r["w"]))) for r in rows)
    model.prior = sum(y for _, y, _ in model.examples) / len(model.examples) if model.examples else 0.0
    shared = spark.sparkContext.broadcast(model)

    def left_out(batches):
        for batch in batches:
            some = [shared.value.examples[k] for k in batch.column(0).to_pylist()]
            share, _ = shared.value.votes([v for _, _, v in some], [i for i, _, _ in some])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share)], names=["k", "share"])

    voted = spark.range(len(rows), numPartitions=max(1, min(len(rows) // 500, 32))).mapInArrow(left_out, "k long, share double").orderBy("k").collect()
    model.slope, model.offset = logistic_map(np.array([r["share"] for r in voted]), np.array([y for _, y, _ in model.examples]))
    shared.unpersist()
    scratch.close()
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted, evidence (nearest examples: doc_id, similarity, toxic).

    Only the text decides the score. A null, empty or unknown text has no evidence, and as its score the map of the sample's share
    of toxic rows; without examples that is 0. Repeated rows stay; an empty table gives an empty result; other columns aren't read.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(model)
    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    arrow_evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def judged(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, QUERIES):
                part = batch.slice(low, QUERIES)
                scores, near = vocabulary.value.judge(value.as_py() for value in part.column(1))
                found = [[{"doc_id": i, "similarity": s, "toxic": y} for i, s, y in row] for row in near]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(found, arrow_evidence)], names=["id", "score", "evidence"])

    return source.mapInArrow(judged, schema).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose score is below the threshold, with all columns, in one pass.

    Only the text decides: null and empty texts have the score of a text without evidence, repeated rows stay or go together, and
    an empty table gives an empty result.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for low in range(0, batch.num_rows, QUERIES):
                part = batch.slice(low, QUERIES)
                yield part.filter(pa.array(vocabulary.value.judge(value.as_py() for value in part.column(at))[0] < threshold, pa.bool_()))

    return df.mapInArrow(clean, df.schema)
