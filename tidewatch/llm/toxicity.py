"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words and word beginnings that occur far more often in documents labelled toxic, and a few fixed patterns. The
label model is a tree-structured generative model: each voter depends on the hidden class and on one other voter, so
that correlated voters do not count twice; its accuracies and correlations are estimated by expectation
maximization over the sample, the given label being one more noisy voter. A logistic regression on the votes is trained on
the posterior labels and calibrated on the given ones, so that 0.5 separates the classes.

Everything is fitted on a sample of about ``SAMPLE`` labelled documents at most, chosen by a hash of their ids; all
texts are scored whole. Null and empty texts get the score of a text without votes. Labels that are null or neither 0 nor 1, or
of no document, are not used; of repeated labels of a document the larger counts. Without labels of both
classes every score is the share of toxic labels (0 if there are none).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.boosting import logistic
from tidewatch.llm.common import documents, map_arrow
from tidewatch.session import settle

SAMPLE = 20_000  # labelled documents used for fitting
ENTRIES = 50_000  # lexicon entries considered, at most
VOTERS = 96  # lexicon voters kept
STEMS = (4, 5, 6)  # lengths of word beginnings
WORD = regex.compile(r"\w+")
ASCII = regex.compile(r"[\x00-\x7f]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Pattern voters, on the whole text.
PATTERNS = (regex.compile(r"(?:!\s*){3,}"), regex.compile(r"\byou(?:'re| are)?\s+(?:a|an|such|all)\b", regex.I), regex.compile(r"\b(?:shut up|go away|hate you)\b", regex.I))


def entries(text: str) -> set[str]:
    """The words of a text and their beginnings (marked by a star)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for n in STEMS for w in words if len(w) > n}


def capitals(text: str) -> tuple[int, int]:
    """Upper-case characters and letters of the whole text."""
    plain = text.encode("ascii", "ignore")
    upper, lower = (len(plain) - len(plain.translate(None, x)) for x in (UPPER, LOWER))
    rest = "" if len(plain) == len(text) else ASCII.sub("", text)
    return upper + sum(map(str.isupper, rest)), upper + lower + sum(map(str.isalpha, rest))


class Votes:
    """Votes of the lexicon voters and of the patterns."""

    def __init__(self, lexicon: list[str]):
        self.place = {x: k for k, x in enumerate(lexicon)}
        self.words = {x for x in lexicon if x[-1] != "*"}
        self.stems = {n: {x[:-1] for x in lexicon if x[-1] == "*" and len(x) == n + 1} for n in STEMS}
        self.size = len(lexicon) + len(PATTERNS) + 1

    def of(self, text: str) -> np.ndarray:
        out = np.zeros(self.size, bool)
        if not text:
            return out
        words = set(WORD.findall(text.lower()))
        for w in words & self.words:
            out[self.place[w]] = True
        for n, stems in self.stems.items():
            if stems:
                for w in {w[:n] for w in words if len(w) > n} & stems:
                    out[self.place[w + "*"]] = True
        base = len(self.place)
        for k, p in enumerate(PATTERNS):
            out[base + k] = p.search(text) is not None
        upper, letters = capitals(text)
        out[-1] = len(text) >= 20 and upper > 0.6 * letters
        return out


class LabelModel:
    """Hidden class and a tree of dependences among the voters, fitted by expectation maximization."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, label_accuracy: float = 0.95, rounds: int = 15):
        v = votes.astype(np.float64)
        n, m = v.shape
        given = np.where(labels == 1, label_accuracy, 1 - label_accuracy)
        post = given.copy()
        for _ in range(rounds):
            self.prior = (post.sum() + 1) / (n + 2)
            parent = self._tree(v, post)
            logs = [np.log(given) + np.log(self.prior), np.log(1 - given) + np.log(1 - self.prior)]
            self.accuracy = np.zeros((2, m))
            for c, w in enumerate((post, 1 - post)):
                self.accuracy[c] = (w @ v + 0.5) / (w.sum() + 1)
                for j in range(m):
                    up = np.zeros(n) if parent[j] < 0 else v[:, parent[j]]
                    for value in (0.0, 1.0):
                        there = up == value
                        p = (w[there] @ v[there, j] + 2 * self.accuracy[c, j]) / (w[there].sum() + 2)
                        logs[c][there] += np.where(v[there, j] > 0, np.log(max(p, 1e-9)), np.log(max(1 - p, 1e-9)))
            new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
            moved = np.abs(new - post).max()
            post = new
            if moved < 1e-4:
                break
        self.parent, self.posterior = parent, post

    @staticmethod
    def _tree(v: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Each voter's parent in the spanning tree with the most information between voters given the class; -1: none."""
        n, m = v.shape
        info = np.zeros((m, m))
        for w in (post, 1 - post):
            total = w.sum() + 1
            one = (w @ v + 0.5) / total
            both = ((v * w[:, None]).T @ v + 0.25) / total
            for a in (0, 1):
                for b in (0, 1):
                    joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                    apart = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
                    joint, apart = np.maximum(joint, 1e-12), np.maximum(apart, 1e-12)
                    info += total / n * joint * np.log(joint / apart)
        parent, best, link = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1)
        left = np.ones(m, bool)
        for _ in range(m):
            j = int(np.argmax(np.where(left, best, -np.inf))) if (best[left] > -np.inf).any() else int(np.flatnonzero(left)[0])
            left[j], parent[j] = False, link[j]
            closer = left & (info[j] > best)
            best[closer], link[closer] = info[j][closer], j
        return parent


class Scorer:
    """Votes, linear weights and the share of toxic labels."""

    def __init__(self, lexicon: list[str], weights: np.ndarray | None, share: float):
        self.lexicon, self.weights, self.share = lexicon, weights, share

    def start(self) -> Votes:
        return Votes(self.lexicon)

    def scores(self, votes: Votes, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        x = np.array([design(votes.of(t or "")) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def design(votes: np.ndarray) -> np.ndarray:
    """The votes and the logarithm of their number."""
    return np.append(votes.astype(np.float64), np.log1p(votes.sum()))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _counts(sample: DataFrame, wanted: dict[str, int] | None) -> DataFrame:
    """(entry, toxic, clean): documents of either class that hold the entry; without ``wanted`` of the toxic ones only."""
    schema = pa.schema([("entry", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    shared = sample.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                every = entries(text or "")
                found[label].update(every if shared.value is None else every & shared.value.keys())
        names = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[c][x] for x in names], pa.int64()) for c in (1, 0))], schema=schema)

    rows = sample if wanted is not None else sample.where("label = 1")
    return map_arrow(rows.select("text", "label"), run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Entries whose documents are toxic far more often than others, by the lower bound of that share.

    The likelihood ratio against the general share must outweigh the number of entries that were looked at.
    """
    out = []
    base = n_toxic / (n_toxic + n_clean)
    needed = np.log(max(len(rows), 1)) + 1
    for entry, toxic, clean in rows:
        n = toxic + clean
        p, z = toxic / n, 1.64
        low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        evidence = toxic * np.log(max(p / base, 1e-9)) + (clean * np.log(max((1 - p) / (1 - base), 1e-9)) if clean else 0.0)
        if low > max(0.35, min(2.5 * base, 0.9)) and evidence > needed:
            out.append((-low * np.log1p(toxic), len(entry), entry))
    return [e for *_, e in sorted(out)[:VOTERS]]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    share = 1 << 20
    bound = -(-share * sample // max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < bound).groupBy("doc_id").agg(F.max("label").alias("label"))
    # ``picked`` has about ``sample`` rows of 12 bytes, whatever the input
    rows = settle(documents(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label"), "toxicity-sample")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Scorer([], None, float(n_toxic > 0))
    often = _counts(rows, None).where(F.col("toxic") >= max(3, n_toxic // 200)).orderBy(F.desc("toxic"), "entry").limit(ENTRIES)
    counts = [tuple(r) for r in _counts(rows, {r.entry: 1 for r in often.select("entry").collect()}).collect()]
    lexicon = choose(counts, n_toxic, n_clean)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("votes", pa.binary())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(lexicon)
        for b in batches:
            ids, texts, marks = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array([np.packbits(votes.of(t or "")).tobytes() for t in texts], pa.binary())], schema=schema)

    got = map_arrow(rows.select("doc_id", "text", "label"), vote, "doc_id long, label int, votes binary").orderBy("doc_id", "votes").collect()
    size = Votes(lexicon).size
    v = np.array([np.unpackbits(np.frombuffer(r.votes, np.uint8))[:size] for r in got]).astype(bool)
    y = np.array([r.label for r in got])
    model = LabelModel(v, y)
    x = np.array([design(r) for r in v])
    weights = logistic(x, model.posterior)
    # calibration on the given labels: a slope and a shift of the log odds
    odds = x @ weights[:-1] + weights[-1]
    slope, shift = logistic(odds[:, None], y.astype(np.float64), ridge=1e-3)
    if slope > 0:
        weights = weights * slope
        weights[-1] += shift
    return Scorer(lexicon, weights, n_toxic / (n_toxic + n_clean))


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = scorer.start()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(votes, b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return map_arrow(documents(docs, id_col, text_col), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5, all columns unchanged."""

    @F.pandas_udf("double")
    def scored(texts):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series(scorer.scores(scorer.start(), [t if isinstance(t, str) else None for t in texts]))

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return docs.where(scored(F.col(text_col).cast("string")) < 0.5)
