"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = logistic(w . x - theta_k): the weights are shared by all thresholds, which increase.
Features are how often a word, or one of its beginnings, occurs in a text, on a log scale. The labels
give grade 0 and "toxic"; grades 1 to 3 above it are cut by how much of what the labels mark as toxic
a text holds, at the terciles of the labelled toxic texts. The model is fitted on a bounded sample of labelled rows;
expected severity is the sum of P(grade > k).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, kept_columns, text_slices

GRADES = 3
#: Labelled rows (about) that the model is fitted on; they bound its features too.
TRAIN_ROWS = 8_000
#: Sampled texts that must hold a feature.
LEAST_TEXTS = 5
#: Least standard score of a feature: chance does not pass it among a million words.
LEAST_Z = 5.0
PREFIXES = (4, 5)
STRIP = "".join(map(chr, range(33, 48))) + "".join(map(chr, range(58, 65))) + "[\\]^_`{|}~"
#: Odds that make a feature count towards a toxic text's grade.
STRONG_ODDS = 20.0
REJECT = 0.35
#: Columns that score() makes.
MADE = ("p_toxic", "severity", "grade", "toxic")


def features(word: str) -> list[str]:
    """The word without punctuation around it, and its beginnings."""
    word = word.strip(STRIP)
    return [f"={word}", *[f"{word[:n]}*" for n in PREFIXES if len(word) >= n]] if word else []


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray


class Scorer(dict):
    """Word -> its (feature number, ...) in the model; at most LIMIT words of at most LONGEST
    characters are remembered."""

    LIMIT, LONGEST = 100_000, 64

    def __init__(self, model: Model):
        super().__init__()
        self.number = {f: i for i, f in enumerate(model.weights)}
        self.weight = list(model.weights.values())
        self.thresholds = model.thresholds

    def __missing__(self, word: str) -> tuple[int, ...]:
        value = tuple(self.number[f] for f in features(word) if f in self.number)
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = value
        return value

    def __call__(self, text: bytes | None) -> tuple[float, np.ndarray]:
        found: Counter[int] = Counter()
        for hit in filter(None, map(self.__getitem__, (text or b"").decode("utf-8", "replace").lower().split())):
            found.update(hit)
        score = math.fsum(self.weight[i] * math.log2(1 + n) for i, n in found.items())
        return score, 1.0 / (1.0 + np.exp(-np.clip(score - self.thresholds, -40, 40)))


def fit_cumulative_link(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int, n_features: int, grade: np.ndarray, l2: float = 5e-5, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the ordinal model by Adam on the mean log-likelihood.

    rows, cols and values give the cells of a sparse matrix. theta_k = theta_0 + exp(g_1) + ... + exp(g_k).
    """
    k = GRADES
    params = np.zeros(n_features + k)
    params[n_features] = 2.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        gaps = np.exp(raw[1:])
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, weights=w[cols] * values, minlength=n)
        over = np.hstack([np.ones((n, 1)), sig(z[:, None] - theta), np.zeros((n, 1))])
        p = np.maximum(over[at, grade] - over[at, grade + 1], 1e-12)
        slope = over * (1 - over)
        dz = (slope[at, grade] - slope[at, grade + 1]) / p
        dtheta = np.zeros(k)
        for j in range(k):
            # theta_j bounds grade j from above and grade j + 1 from below
            dtheta[j] = (np.where(grade == j + 1, -1.0, 0.0) + np.where(grade == j, 1.0, 0.0)) @ (slope[:, j + 1] / p)
        grad = np.concatenate([np.bincount(cols, weights=dz[rows] * values, minlength=n_features) / n - l2 * w, [dtheta.sum() / n], [dtheta[j + 1 :].sum() / n * gaps[j] for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = params[n_features:]
    return params[:n_features], raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents whose hashed id falls under train_rows / count: about train_rows
    of them at any size, all where there are fewer. Rows with a null label or id are left out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    total = known.count()
    nothing = Model({}, np.array([40.0] * GRADES))
    if not total:
        return nothing
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(train_rows / total * (1 << 30)))
    # at most about train_rows rows of two numbers
    texts = docs.select(id_col, text_col).join(F.broadcast(known), id_col).select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), "y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                found = []
                for text in as_bytes(part.column(1)):
                    counts: Counter[str] = Counter()
                    for word in text.decode("utf-8", "replace").lower().split():
                        counts.update(features(word))
                    found.append(list(counts.items()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.map_(pa.string(), pa.int32()))], ["id", "y", "found"])

    kind = texts.schema["id"].dataType.simpleString()
    each = texts.mapInArrow(extract, f"id {kind}, y int, found map<string,int>").persist()
    try:
        n1, n0 = each.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
        if not n1 or not n0:
            return nothing
        counts = each.select("y", F.explode("found").alias("f", "n")).groupBy("f").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")).where(F.col("c1") + F.col("c0") >= LEAST_TEXTS)
        p = (F.col("c1") + F.col("c0")) / F.lit(float(n1 + n0))
        z = (F.col("c1") / float(n1) - F.col("c0") / float(n0)) / F.sqrt(p * (1.0 - p) * (1.0 / n1 + 1.0 / n0) + F.lit(1e-12))
        chosen = counts.withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy("f").collect()
        names = [r["f"] for r in chosen]
        odds = np.array([(r["c1"] + 0.5) / (n1 + 1) / ((r["c0"] + 0.5) / (n0 + 1)) for r in chosen])
        picked = F.broadcast(spark.createDataFrame([(f, i) for i, f in enumerate(names)], "f string, i int"))
        sparse = each.select("id", "y", F.explode_outer("found").alias("f", "n")).join(picked, "f", "left").groupBy("id", "y").agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("on")).orderBy("id").collect()
    finally:
        each.unpersist()
    y = np.array([r["y"] for r in sparse])
    rows = np.repeat(np.arange(len(sparse)), [len(r["on"]) for r in sparse])
    cols = np.array([i for r in sparse for i, _ in r["on"]], dtype=np.int64)
    values = np.log2(1.0 + np.array([n for r in sparse for _, n in r["on"]]))
    strong = np.bincount(rows, weights=values * (odds >= STRONG_ODDS)[cols], minlength=len(sparse))
    grade = np.where(y == 1, 1 + (strong[:, None] > np.quantile(strong[y == 1], [1 / 3, 2 / 3])).sum(axis=1), 0)
    weights, thresholds = fit_cumulative_link(rows, cols, values, len(sparse), len(names), grade)
    return Model(dict(zip(names, weights.tolist(), strict=True)), thresholds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, reject: float = REJECT) -> DataFrame:
    """Severity of every whole text, one narrow pass.

    Returns id_col, the columns in keep, p_toxic = P(grade > 0), severity (expected grade, 0 to 3),
    grade (thresholds passed with probability over one half) and toxic (p_toxic >= reject). A null
    text counts as empty; it and every text without a known feature score by the thresholds alone. A
    very long text is read whole, its counts on a log scale. Rows stay one to one, so repeated rows
    and null ids score alike and for themselves; an empty table gives no rows. A kept column with
    the name of a result column is refused; columns that are not named are ignored.
    """
    keep = kept_columns(keep, id_col, MADE)
    picked = docs.select(F.col(text_col).alias("_text"), F.col(id_col), *[c for c in keep if c != text_col])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # a kept text crosses to Python once
    fields = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(picked.schema.fields)}
    fields[text_col] = fields.get(text_col, fields["_text"])
    carried = [id_col, *keep]
    schema = ", ".join(f"`{c}` {fields[c][1]}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in text_slices(batch, 0):
                over = np.array([scorer(t)[1] for t in as_bytes(part.column(0))]).reshape(part.num_rows, -1)
                made = [pa.array(over[:, 0]), pa.array(over.sum(axis=1)), pa.array((over > 0.5).sum(axis=1).astype(np.int32)), pa.array(over[:, 0] >= reject)]
                yield pa.RecordBatch.from_arrays([*[part.column(fields[c][0]) for c in carried], *made], [*carried, "p_toxic", "severity", "grade", "toxic"])

    return picked.mapInArrow(run, f"{schema}, p_toxic double, severity double, grade int, toxic boolean")
