"""Personal data in whole texts: fixed rules, and candidate spans scored by boosted trees.

Four kinds are found by fixed rules (``base_spans``). High-recall generators propose further, possibly overlapping
spans: spelled-out addresses and groups of digits in other formats. Boosted trees score each proposal from its format and
context; a proposal is taken if its kind's calibrated threshold is met and no base span overlaps it; of proposals that
overlap, the best one stays.

The trees are trained here on all documents: proposals
that a rule confirms are positive, the others negative; confirmed spans rewritten in other formats are more
positives; their digits as plain numbers, dates or cards with a changed digit are more negatives. Thresholds are set on the documents not used for training so that
``PRECISION`` is kept; a kind for which that is impossible adds nothing.

Null and empty texts have no spans. Offsets are code points of the whole text, the end exclusive. Repeated rows are scanned
each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.boosting import BoostedTrees
from tidewatch.llm.common import documents, give_back, map_arrow
from tidewatch.session import settle

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
GRID, GRID_END = 256, 16  # thresholds lie on a grid of log odds: so many steps a unit, from -16 to 16
BLOCK = 32_768  # distinct vectors a task of the fit holds, about

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these begins where a run of digits begins, so the look-behind changes no result and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:@|[(\[{]\s?(?i:at)\s?[)\]}]|\s(?i:at)\s)\s?[\w-]{1,63}(?:\s?(?:\.|[(\[{]\s?(?i:dot)\s?[)\]}]|\s(?i:dot)\s)\s?[\w-]{1,63}){1,4}")
AT = re.compile(r"@|[\s(\[{](?i:at)[\s)\]}]")  # in every match of SPELLED
GROUPS = re.compile(r"(?<!\w)[+(]?[0-9](?:[\x20()./-]{0,3}[0-9]){6,24}(?![\w])")
CUES = tuple(re.compile(x, re.I) for x in (r"mail|contact|write", r"tel|phone|call|fon|mobil", r"card|visa|credit|kart", r"\bip\b|server|host|addr"))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outward: the local part is the run before it."""
    out: list[tuple[int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            out.append((begin, domain.end()))
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", *s) for s in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NO_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the generators; one place may be proposed as several kinds."""
    out: list[tuple[str, int, int]] = []
    if AT.search(text):
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        out += [(kind, *m.span()) for m in GROUPS.finditer(text) for kind in ("ip", "card", "phone")]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = NO_DIGIT.sub("", span)
    groups = [g for g in re.split(r"[^0-9]+", span) if g]
    edge = lambda c: 0.0 if not c or c.isspace() else 2.0 if c.isalnum() else 1.0
    n = len(digits)
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)),
        float(n),
        float(sum(c.isalpha() for c in span)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)),
        *(float(span.count(c)) for c in " .-/()@"),
        float(span[:1] == "+"),
        float(13 <= n <= 19),
        float(9 <= n <= 15),
        float(13 <= n <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(len(set(digits))),
        edge(before[-1:]),
        edge(after[:1]),
        *(float(bool(c.search(before))) for c in CUES),
        float(bool(re.search(r"\bat\b|\bdot\b", span, re.I))),
    ]


def rewritten(kind: str, span: str) -> list[tuple[str, float]]:
    """A confirmed span in other formats (1.0), or spoiled (0.0)."""
    if kind == "email":
        name, _, host = span.partition("@")
        return [(f"{name} (at) {host.replace('.', ' (dot) ')}", 1.0), (f"{name}[at]{host.replace('.', '[dot]')}", 1.0), (f"{name} at {host.replace('.', ' dot ')}", 1.0)]
    digits = NO_DIGIT.sub("", span)
    if kind == "phone":
        formats = [(f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", 1.0), (f"00{digits[:-10]} {digits[-10:-7]}/{digits[-7:]}", 1.0)]
        numbers = [f"{digits[-9:-6]} {digits[-6:-3]} {digits[-3:]}", f"{digits[-7]} {digits[-6:-3]} {digits[-3:]}", f"20{digits[-6:-4]}-{digits[-4:-2]}-{digits[-2:]}", digits[-9:], f"{digits[-9:-3]}.{digits[-3:]}"]
        return formats + [(x, 0.0) for x in numbers]
    if kind == "card":
        spoiled = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        return [("/".join(digits[k : k + 4] for k in range(0, len(digits), 4)), 1.0), (spoiled, 0.0)]
    return [(span.replace(".", "-"), 0.0)]


def training_rows(text: str) -> list[tuple[str, float, list[float]]]:
    base = base_spans(text)
    exact = set(base)
    out = [(k, float((k, a, b) in exact), features(text, k, a, b)) for k, a, b in proposals(text)]
    for kind, a, b in base:
        for span, label in rewritten(kind, text[a:b]):
            out.append((kind, label, features(text[:a] + span + text[b:], kind, a, a + len(span))))
    return out


class SpanModel:
    """Trees and a threshold (log odds) for each kind."""

    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        taken = sorted((a, b) for _, a, b in base)
        begins, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
        # a base span that begins before the proposal's end and reaches beyond its start overlaps it
        found = [p for p in proposals(text) if p[0] in self.thresholds and reach[bisect_left(begins, p[2])] <= p[1]]
        if not found:
            return []
        score = self.trees.score(np.array([features(text, *p) for p in found]))
        out: list[tuple[str, int, int, float]] = []
        starts, ends = [], []  # of the proposals taken, in order; they are disjoint
        for i in np.argsort(-score, kind="stable"):
            kind, a, b = found[i]
            at = bisect_left(starts, b)
            if score[i] >= self.thresholds[kind] and (at == 0 or ends[at - 1] <= a):
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((kind, a, b, float(1 / (1 + np.exp(-score[i])))))
        return out


def _steps(scores: np.ndarray) -> np.ndarray:
    """The step of the grid of log odds that each score lies on."""
    return np.clip(np.floor((scores + GRID_END) * GRID), 0, 2 * GRID_END * GRID - 1).astype(np.int64)


def _counted(rows: Iterator, cuts: list[np.ndarray]) -> Iterator[tuple]:
    """One block of a task's vectors: bins, label, count."""
    x, y, n = [], [], []
    for r in rows:
        x.append(r.x)
        y.append(r.label)
        n.append(r.n)
    if x:
        whole = np.array(x)
        bins = np.column_stack([np.searchsorted(c, whole[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)
        yield bins, np.array(y), np.array(n, float)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SpanModel:
    """Trees and thresholds from every row of training: equal rows are counted, and tasks add up histograms of them."""
    own = documents(docs, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in training_rows(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    rows = map_arrow(own, run, "doc_id long, kind string, label double, x array<double>")
    by_id = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(10)) >= 7
    vectors = settle(rows.groupBy(by_id.alias("fold"), "kind", "label", "x").agg(F.count("*").alias("n")), "pii-vectors")
    there = {(r.fold, r.label) for r in vectors.select("fold", "label").distinct().collect()}
    if len({y for _, y in there}) < 2:
        return SpanModel(BoostedTrees(), {})
    if len({y for fold, y in there if not fold}) < 2 or not any(fold for fold, _ in there):
        vectors = vectors.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(10)) >= 7)
    fitted = vectors.where(~F.col("fold"))
    marks = [k / 32 for k in range(33)]
    spots = fitted.select(F.posexplode("x").alias("j", "v"), "n").groupBy("j", "v").agg(F.sum("n").alias("n")).groupBy("j").agg(F.percentile("v", marks, F.col("n")).alias("q"))
    cuts = [np.unique(r.q)[:-1] for r in sorted(spots.collect())]
    if not cuts:
        return SpanModel(BoostedTrees(), {})
    # The fit runs a job for each level of each tree: its tasks are as many as the vectors need, not as their files are.
    sizes = {r.fold: r["count"] for r in vectors.groupBy("fold").count().collect()}
    blocks = fitted.select("x", "label", "n").coalesce(sizes[False] // BLOCK + 1).rdd.mapPartitions(lambda rows: _counted(rows, cuts)).persist(StorageLevel.MEMORY_AND_DISK)
    trees = BoostedTrees().fit_blocks(blocks, cuts)
    blocks.unpersist()

    def curves(rows: Iterator) -> Iterator[np.ndarray]:
        """How many held-out rows of each kind and label have a score on each step."""
        out = np.zeros((len(KINDS), 2, 2 * GRID_END * GRID))
        todo = list(rows)
        if todo:
            step = _steps(trees.score(np.array([r.x for r in todo])))
            np.add.at(out, ([KINDS.index(r.kind) for r in todo], [int(r.label) for r in todo], step), [r.n for r in todo])
        yield out

    held = vectors.where("fold").select("kind", "label", "x", "n").coalesce(sizes.get(True, 0) // BLOCK + 1).rdd.mapPartitions(curves).treeReduce(np.add)
    thresholds = {}
    for kind, (no, yes) in zip(KINDS, held, strict=True):
        right, taken = yes[::-1].cumsum()[::-1], (no + yes)[::-1].cumsum()[::-1]  # at or above each step
        good = np.flatnonzero((taken > 0) & (right >= PRECISION * taken) & (no + yes > 0))
        if len(good) and right[good[0]] >= 3:
            thresholds[kind] = max(float(good[0] / GRID - GRID_END), 0.0)
    return SpanModel(trees, thresholds)


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"


def _map_spans(own: DataFrame, model: SpanModel, with_text: bool) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, texts = [], []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                every = [{"kind": k, "start": s, "end": e, "base": True, "score": 1.0} for k, s, e in base]
                every += [{"kind": k, "start": s, "end": e, "base": False, "score": p} for k, s, e, p in model.added(text or "", base)]
                every.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"]))
                spans.append(every)
                texts.append(redacted(text, every) if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(texts, pa.string())], ["doc_id", "spans", "text"])

    return map_arrow(own, run, f"doc_id long, spans {SPANS}, text string")


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in brackets."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every span with its kind, place, whether a fixed rule found it, and score."""
    return _map_spans(documents(docs, id_col, text_col), model or train(docs, id_col=id_col, text_col=text_col), False).drop("text")


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with personal data replaced in ``text_col``; all other columns stay as they are."""
    found = model or train(docs, id_col=id_col, text_col=text_col)

    def one(text: str | None) -> str | None:
        base = base_spans(text or "")
        spans = [{"kind": k, "start": s, "end": e} for k, s, e in base]
        return redacted(text, spans + [{"kind": k, "start": s, "end": e} for k, s, e, _ in found.added(text or "", base)])

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(one)
        give_back()

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests of the rows of ``find_spans``."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def n_of(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [n_of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
