"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features in turn; each step fits a
shallow tree to what is still unexplained, on that feature alone, and adds it to the feature's table
of bins. Then the pairs of features with most left to explain get tables of their own in the same
way. A score is a sum of table entries, looked up for a whole batch at a time.

The model is fitted on the driver from at most `sample` labelled texts, the first by a hash of their
id; that bound does not grow with the corpus. Every text is scored whole.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, encode
from .ngram_join import Shingler, text_buffers

FEATURES = ("log_bytes", "upper", "digit", "mark", "bar", "bang", "symbol", "beyond_ascii", "space", "word_length", "repeated_next", "distinct_words", "top_word", "distinct_lines", "line_length", "ended_lines")
#: The characters counted by some of the features.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "mark": b".,;:?'\"()-", "bar": b"|<>{}[]\\/=_~^", "bang": b"!", "symbol": b"#$%&*@+"}


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return (total[ends] - total[starts]).astype(float)


def features(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, from the bytes of many; an empty text has zeros."""
    shingler = encode.worker_wide(Shingler)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    size = np.maximum(ends - starts, 1).astype(float)
    cols = {"log_bytes": np.log1p(ends - starts)}
    for name, chars in CLASSES.items():
        is_in = np.zeros(256, bool)
        is_in[list(chars)] = True
        cols[name] = _sums(is_in[data], starts, ends) / size
    cols["beyond_ascii"] = _sums(data >= 128, starts, ends) / size
    words, first, last, begins, stops = shingler.words(data, ends)
    n = np.maximum(last - first, 1).astype(float)
    letters = np.concatenate(([0], np.cumsum(stops - begins)))
    cols["space"] = 1 - (letters[last] - letters[first]) / size
    cols["word_length"] = (letters[last] - letters[first]) / n
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    inner = np.ones(len(words), bool)
    inner[first[first < last]] = False
    cols["repeated_next"] = _sums(same & inner, first, last) / n
    newline = np.flatnonzero(data == 10)
    distinct, top, lines_distinct, line_length, ended = (np.zeros(len(ends)) for _ in range(5))
    stop_mark = np.zeros(256, bool)
    stop_mark[list(b".!?:;\"')")] = True
    low, high = np.searchsorted(newline, starts), np.searchsorted(newline, ends)
    word_at = np.searchsorted(begins, newline)
    for d in range(len(ends)):
        if first[d] == last[d]:
            continue
        w = np.sort(words[first[d] : last[d]])
        edge = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1], [True])))
        distinct[d] = (len(edge) - 1) / len(w)
        top[d] = np.diff(edge).max() / len(w)
        at = np.unique(np.concatenate(([first[d]], word_at[low[d] : high[d]], [last[d]])))
        at = at[(at >= first[d]) & (at <= last[d])]
        k = len(at) - 1
        h = np.add.reduceat(words[first[d] : last[d]], at[:-1] - first[d])
        lines_distinct[d] = len(np.unique(h)) / k
        line_length[d] = np.log1p(len(w) / k)
        ended[d] = stop_mark[data[stops[at[1:] - 1] - 1]].mean()
    cols |= {"distinct_words": distinct * np.sqrt(n), "top_word": top, "distinct_lines": lines_distinct, "line_length": line_length, "ended_lines": ended}
    return np.column_stack([cols[f] for f in FEATURES])


@dataclasses.dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: the tables' entries added up."""
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for f, g, t in self.pairs:
            z += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, int]:
    """Best place to cut ordered bins in two, by gain; 0 gain if there is none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < 0.5) | (hr < 0.5)] = 0
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Value of each bin in a tree of a few leaves over ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_cut(g[a:b], h[a:b]), a, b) for a, b in parts), default=(0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """A tree of four leaves on two features: one cut of the first, then one of the second on each side."""
    best, out = 0.0, np.zeros(g.shape)
    rows_g, rows_h = g.cumsum(0), h.cumsum(0)
    for k in range(1, len(g)):
        sides = ((rows_g[k - 1], rows_h[k - 1]), (rows_g[-1] - rows_g[k - 1], rows_h[-1] - rows_h[k - 1]))
        cuts = [_cut(a, b) for a, b in sides]
        gain = sum(c[0] for c in cuts) + sum(a.sum() ** 2 / (b.sum() + ridge) for a, b in sides)
        if gain > best:
            best, out = gain, np.zeros(g.shape)
            for (a, b), (won, at), part in zip(sides, cuts, (slice(0, k), slice(k, None))):
                for s in (slice(0, at), slice(at, None)) if won > 0 else (slice(None),):
                    out[part, s] = a[s].sum() / (b[s].sum() + ridge)
    return best - g.sum() ** 2 / (h.sum() + ridge), out


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, bins: int = 32, rate: float = 0.15) -> Model:
    """The model for labels y (0 or 1). Without labels texts are taken to be good: 0.9 for all."""
    n, width = len(y), x.shape[1]
    prior = (y.sum() + 9) / (n + 10)
    base = float(np.log(prior / (1 - prior))) if prior < 1 else 9.0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(width)]
    model = Model(edges, base, [np.zeros(len(e) + 1) for e in edges], [])
    if n == 0 or y.min() == y.max():
        return model
    b, z = model.bins(x), np.full(n, base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            k = len(model.tables[f])
            step = rate * _tree(np.bincount(b[:, f], g, k), np.bincount(b[:, f], h, k))
            model.tables[f] += step
            z += step[b[:, f]]

    def grid(f, k):
        g, h = slopes()
        shape = (len(model.tables[f]), len(model.tables[k]))
        at = b[:, f] * shape[1] + b[:, k]
        return _grid(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))

    found = sorted(((grid(f, k)[0], -f, -k) for f in range(width) for k in range(f + 1, width)), reverse=True)[:pairs]
    model.pairs = [(-f, -k, np.zeros((len(model.tables[-f]), len(model.tables[-k])))) for gain, f, k in found if gain > 1e-6]
    for _ in range(pair_rounds):
        for f, k, table in model.pairs:
            step = rate * grid(f, k)[1]
            table += step
            z += step[b[:, f], b[:, k]]
    return model


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled texts that are not held out. A null label is none; of several the least counts."""
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for a, data, ends in text_buffers(batch.column(2), 1 << 19):
                x = features(data, ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(x)), batch.column(1).slice(a, len(x)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])
            encode.release()

    # the sample has at most `sample` rows of 12 bytes
    rows = common.keyed(docs, id_col, text_col).join(F.broadcast(y), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x array<double>")
    with common.arrow_batches(docs.sparkSession, 8):
        got = sorted(rows.collect())
    x = np.array([r[2] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text; null texts are scored as empty ones.
    Ids that are null or repeat: as in `common`."""

    def run(batches):
        for batch in batches:
            for a, data, ends in text_buffers(batch.column(1), 1 << 19):
                got = model.score(features(data, ends))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(got)), pa.array(got, pa.float64())], ["doc_id", "score"])
            encode.release()

    rows = common.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double").withColumn("doc_id", common.id_out())
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    with common.arrow_batches(docs.sparkSession, 8):
        bad, _ = common.written(score(docs, model, id_col=id_col, text_col=text_col, threshold=threshold).where("predicted = 0").select("doc_id"), "rejected")
    return common.without(docs, bad, id_col)
