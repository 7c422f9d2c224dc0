"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text only. Training sees a bounded sample of labelled rows, picked by a hash of the id;
features are cut into at most 64 bins at quantiles, and each tree grows level by level from gradient histograms. The
fitted trees are flattened into arrays of equal length, so scoring a batch is one numpy gather for each level, over all
trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexgraph.llm.common import table

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "distinct_words", "top_word",
    "upper", "lower", "digit", "space", "punct", "symbol", "high_bytes", "exclaim", "capital_words", "symbol_words",
    "log_lines", "distinct_lines", "mean_line", "terminal_lines", "byte_entropy", "repeat_pairs", "longest_run", "digit_words",
)

_CLASS = np.zeros(256, dtype=np.int64)  # 0 lower, 1 upper, 2 digit, 3 space, 4 ordinary punctuation, 5 symbol, 6 high byte
_CLASS[:] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:'\"?!()-"]] = 4


def statistics(text: str | None) -> np.ndarray:
    """The features of a whole text. A null text counts as empty."""
    raw = (text or "").encode("utf-8")
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    b = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(b, minlength=256)
    n = len(b)
    by_class = np.bincount(_CLASS, weights=counts, minlength=7) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / n
    edges = np.flatnonzero(np.diff(b)) if n > 1 else np.zeros(0, dtype=np.int64)
    runs = np.diff(np.concatenate([[-1], edges, [n - 1]]))
    w = len(words)
    if w:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=w)
        kinds: dict[bytes, int] = {}
        for x in words:
            kinds[x] = kinds.get(x, 0) + 1
        pairs = len(set(zip(words, words[1:])))
        out[2:8] = lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths < 3).mean(), len(kinds) / w, max(kinds.values()) / w
        # Over word kinds, weighed: cheap even for long texts.
        out[16] = sum(c for x, c in kinds.items() if x.isupper() and len(x) > 1) / w
        out[17] = sum(c for x, c in kinds.items() if not x[-1:].isalnum() and x[-1] < 128 and x[-1:] not in b".,;:?\"')") / w
        out[23] = 1 - pairs / max(1, w - 1) if w > 1 else 0.0
        out[25] = sum(c for x, c in kinds.items() if x.isdigit()) / w
    out[0], out[1] = np.log1p(n), np.log1p(w)
    out[8], out[9], out[10], out[11], out[12], out[13], out[14] = by_class[1], by_class[0], by_class[2], by_class[3], by_class[4], by_class[5], by_class[6]
    out[15] = counts[33] / n
    if lines:
        out[18:22] = np.log1p(len(lines)), len(set(lines)) / len(lines), sum(map(len, lines)) / len(lines), sum(x.rstrip()[-1:] in b".?!\"" for x in lines) / len(lines)
    out[22] = -(p * np.log2(p)).sum()
    out[24] = np.log1p(runs.max())
    return out


@dataclass
class Trees:
    """Complete trees of one depth: inner node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    cut: np.ndarray  # (trees, 2**depth - 1); values up to the cut go left
    value: np.ndarray  # (trees, 2**depth)
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(x):
            return np.zeros(0)
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.cut[tree, at])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, at - (2**self.depth - 1)].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0, least: int = 8) -> Trees:
    """Logistic boosting on binned features. Without rows, or with one label, the score is a constant."""
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    if not len(y) or y.min() == y.max():
        return Trees(feature, cut, value, base, depth)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, m = binned.shape
    flat = binned + np.arange(m) * bins
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            index = ((node - first)[:, None] * (m * bins) + flat).ravel()
            shape = (width, m, bins)
            sums = [np.bincount(index, weights=np.repeat(v, m), minlength=width * m * bins).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = sums, (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
            gain = np.where((nl >= least) & (na - nl >= least), gain, -1.0)
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6 and b < len(edges[f]):
                    feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            # Rows compare raw values, as scoring does.
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        top, low = np.bincount(leaf, weights=g, minlength=2**depth), np.bincount(leaf, weights=h, minlength=2**depth)
        value[t] = rate * top / (low + smooth)
        raw += value[t][leaf]
    return Trees(feature, cut, value, base, depth)


def held_out(id_column) -> F.Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (columns..., _text) to columns... and _x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(len(columns))]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), type=pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), arrays], names=[*columns, "_x"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", _x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Trees:
    """Fit on labelled documents that are not held out: all of them, or about `most` picked by a hash of the id.

    Only features, labels and ids of the sample reach the driver, one row an id: of rows that share an id, or labels that
    disagree, the least label and statistics count, so that repeated ids do not outgrow the bound. Rows are sorted first,
    so reruns agree. Null ids, and labels other than 0 and 1, are never trained on.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    count = known.count()
    share = min(1.0, most / count) if count else 1.0
    picked = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample has a bounded number of ids, so it may be sent to every executor.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "doc_id")
    each = _features(rows.select("doc_id", "y", "_text"), ["doc_id", "y"])
    one = each.groupBy("doc_id").agg(F.min(F.struct("y", "_x")).alias("_r")).select("doc_id", "_r.y", "_r._x")
    got = sorted((r["doc_id"], r["y"], r["_x"]) for r in one.collect())
    x = np.array([r[2] for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r[1] for r in got], dtype=np.float64), **how)


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """doc_id and score of every row; with keep, the columns of docs and one of that name with the score.

    A null or empty text has all statistics 0 and is scored like any other; null ids and repeated rows are scored row by
    row; other columns are not looked at; an empty table gives no rows."""

    rows = docs if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    columns = docs.columns if keep else ["doc_id"]
    text_at = docs.columns.index(text_col) if keep else 1
    name = keep or "score"
    sent = trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at)
            x = np.array([statistics(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(sent.score(x))], names=[*columns, name])

    schema = T.StructType([*rows.schema.fields[: len(columns)], T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row of docs.

    Labels, language, source and id are not inputs of a score. Defined results: a null or empty text has all
    statistics 0 and is scored like any other; a null id counts as the empty id for held_out and is never trained on;
    repeated rows get equal scores; labels other than 0 and 1 are ignored; without labels the score is 0.5; an empty
    table gives no rows.
    """
    trees = train(docs, labels, id_col=id_col, text_col=text_col, **how)
    scored = score(docs, trees, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
