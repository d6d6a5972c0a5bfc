"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of three hashed ones: of the word and of its
first four and five bytes, so that inflected forms share most of it.  Filters of
several widths slide over a text, each keeps its greatest response, and a
logistic layer turns these into a score.  The net is fitted with numpy on a
bounded sample of labelled rows; it then scores whole texts inside the tasks.
Only the fit is sampled: thresholds are set on every labelled row, of a text of
any length, with a score by a net that was not fitted on that row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.store import written
from telemill.llm.text import slices, text_buffers, words_of

BUCKETS = 1 << 17  # rows of each embedding table
WIDTH = 8  # of an embedding
FILTERS = 8  # of each width
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)
SAMPLE_ROWS = 2500  # labelled rows of each class to fit on
FOLDS = 4  # of the sample: each is scored by a net fitted on the others
THRESHOLD = 0.3
NO_EVIDENCE = -3.0  # log odds that a fit starts from for a text without words
BINS = 64  # of a score's log odds to one unit, for counts over all labelled rows
MOST_ODDS = 40  # log odds beyond this share the last bin
_SLICE = 1 << 20
_WORDS = 1 << 16


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of each word, a column for each table; where each text's words begin)."""
    rows, counts = [np.zeros((0, 1 + len(PREFIXES)), dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for i, j in slices(offsets, _SLICE):
        words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], prefix_sizes=PREFIXES)
        rows.append(np.stack([(h >> np.uint64(64 - 17)).astype(np.int32) for h in (words.hashes, *words.prefixes)], axis=1))
        counts.append(words.counts())
    return np.concatenate(rows), np.cumsum(np.concatenate(counts))


@dataclass
class Net:
    """The classifier's parameters."""

    tables: np.ndarray  # (1 + prefixes, BUCKETS, WIDTH)
    filters: list[np.ndarray]  # for each width w: (w, WIDTH, FILTERS)
    shift: list[np.ndarray]  # for each width: (FILTERS,)
    weight: np.ndarray  # (len(WIDTHS) * FILTERS,)
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)  # by language
    common: float | None = None  # threshold over all languages, for those without one

    def __getstate__(self) -> dict:
        """Tables travel in half precision, to which :func:`fit` has rounded them."""
        return vars(self) | {"tables": self.tables.astype(np.float16)}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state | {"tables": state["tables"].astype(np.float32)})

    def _responses(self, x: np.ndarray, k: int) -> np.ndarray:
        """Responses of the k-th width's filters at every place; past the end there are zeros."""
        f = self.filters[k]
        y = x @ f[0]
        for d in range(1, len(f)):
            y[:-d] += x[d:] @ f[d]
        return y + self.shift[k]

    def pooled(self, rows: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(greatest response of each filter in each text, not under 0; the word where it is, -1 for none)."""
        n, m = len(bounds) - 1, len(WIDTHS) * FILTERS
        best, place = np.zeros((n, m), dtype=np.float32), np.full((n, m), -1, dtype=np.int64)
        for t in range(n):
            a, b = int(bounds[t]), int(bounds[t + 1])
            for i in range(a, b, _WORDS):  # a long text in pieces that overlap by the greatest width
                j = min(b, i + _WORDS)
                x = self.embedded(rows[i : min(b, j + max(WIDTHS) - 1)])
                for k in range(len(WIDTHS)):
                    y = self._responses(x, k)[: j - i]
                    at = y.argmax(axis=0)
                    top = y[at, np.arange(FILTERS)]
                    s = slice(k * FILTERS, (k + 1) * FILTERS)
                    more = top > best[t, s]
                    best[t, s] = np.where(more, top, best[t, s])
                    place[t, s] = np.where(more, i + at, place[t, s])
        return best, place

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        x = self.tables[0][rows[:, 0]]
        for k in range(1, len(self.tables)):
            x = x + self.tables[k][rows[:, k]]
        return x

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of every text, many texts at once."""
        rows, bounds = features(data, offsets)
        n, m = len(bounds) - 1, len(WIDTHS) * FILTERS
        best = np.zeros((n, m), dtype=np.float32)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + _WORDS, side="right")) - 1)
            if j == i + 1:
                best[i : i + 1] = self.pooled(rows, bounds[i : i + 2])[0]
            else:
                own = bounds[i : j + 1] - bounds[i]
                some = np.flatnonzero(np.diff(own))
                x = self.embedded(rows[bounds[i] : bounds[j]])
                for k, w in enumerate(WIDTHS):
                    y = self._responses(x, k)
                    for d in range(1, w):  # windows that run into the next text
                        cut = own[1:] - d
                        cut = np.unique(cut[(cut >= 0) & (cut < len(y))])
                        z = x[cut] @ self.filters[k][0] + self.shift[k]
                        first = np.searchsorted(own, cut, side="right")
                        for e in range(1, w):
                            inside = cut + e < own[np.minimum(first, len(own) - 1)]
                            z[inside] += x[cut[inside] + e] @ self.filters[k][e]
                        y[cut] = z
                    if len(some):
                        best[i + some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, own[some], axis=0), 0)
            i = j
        return 1 / (1 + np.exp(-(best @ self.weight + self.bias).astype(np.float64)))


def _fresh(seed: int) -> Net:
    r = np.random.default_rng(seed)
    return Net(
        r.normal(0, 0.02, (1 + len(PREFIXES), BUCKETS, WIDTH)).astype(np.float32),
        [r.normal(0, 0.4, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS],
        np.abs(r.normal(0, 0.3, len(WIDTHS) * FILTERS)).astype(np.float32) * np.tile([1, -1], len(WIDTHS) * FILTERS // 2).astype(np.float32),
        NO_EVIDENCE,
    )


def fit(texts: list[str], labels: np.ndarray, share: float, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 1) -> Net:
    """A net from labelled texts; ``share`` is the label's share among all rows, to which the scores are set.

    Beginnings of a few words, or none, of texts without the label go with them:
    labelled texts are hardly ever that short, and a text without evidence must
    not get the score of an average one.
    """
    net, n, seen = _fresh(seed), len(texts), float(labels.mean()) if len(texts) else 0.0
    if n == 0 or labels.min() == labels.max():
        net.weight[:] = 0
        net.bias = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
        return net
    clean = np.flatnonzero(labels == 0)
    starts = np.random.default_rng(seed + 1).choice(clean, max(1, len(clean) // 6), replace=False)
    texts = [*texts, *(" ".join((texts[t] or "").split(None, k % 4)[: k % 4]) for k, t in enumerate(starts.tolist()))]
    labels, n = np.concatenate([labels, np.zeros(len(starts), dtype=labels.dtype)]), len(texts)
    rows, bounds = features(*text_buffers(pa.array(texts, pa.string())))
    squares = [np.full_like(p, 1e-6) for p in [net.tables, *net.filters, *net.shift, net.weight]]
    bias_square, order = 1e-6, np.random.default_rng(seed)
    for _ in range(epochs):
        for at in np.array_split(order.permutation(n), max(1, n // batch)):
            own = np.concatenate([np.arange(bounds[t], bounds[t + 1]) for t in at])
            part = np.concatenate([[0], np.cumsum(bounds[at + 1] - bounds[at])])
            few = rows[own]
            best, place = net.pooled(few, part)
            error = (1 / (1 + np.exp(-(best @ net.weight + net.bias))) - labels[at]).astype(np.float32) / len(at)
            back = error[:, None] * net.weight[None, :] * (best > 0)
            tables = {}
            for k, w in enumerate(WIDTHS):
                s = slice(k * FILTERS, (k + 1) * FILTERS)
                t, f = np.nonzero(back[:, s])
                where, g = place[t, s.start + f], back[t, s.start + f]
                grad = np.zeros_like(net.filters[k])
                for d in range(w):
                    ok = where + d < part[t + 1]
                    r = few[where[ok] + d]
                    x = net.embedded(r)
                    np.add.at(grad[d].T, f[ok], g[ok, None] * x)
                    tables.setdefault("rows", []).append(r)
                    tables.setdefault("grads", []).append(g[ok, None] * net.filters[k][d][:, f[ok]].T)
                shift = np.bincount(f, g, FILTERS).astype(np.float32)
                for p, q, v in ((net.filters[k], squares[1 + k], grad), (net.shift[k], squares[1 + len(WIDTHS) + k], shift)):
                    q += v * v
                    p -= rate * v / np.sqrt(q)
            r, g = np.concatenate(tables["rows"]), np.concatenate(tables["grads"])
            for k in range(len(net.tables)):
                touched, which = np.unique(r[:, k], return_inverse=True)
                v = np.zeros((len(touched), WIDTH), dtype=np.float32)
                np.add.at(v, which, g)
                squares[0][k][touched] += v * v
                net.tables[k][touched] -= rate * v / np.sqrt(squares[0][k][touched])
            v = error @ best
            squares[-1] += v * v
            net.weight -= rate * v / np.sqrt(squares[-1])
            v = float(error.sum())
            bias_square += v * v
            net.bias -= rate * v / bias_square**0.5
    share = float(np.clip(share, 1e-6, 1 - 1e-6))
    net.bias += float(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    net.tables = net.tables.astype(np.float16).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, folds: int = FOLDS, thresholds: bool = True) -> Net:
    """Fit on at most ``rows`` labelled documents of each class, and calibrate thresholds on all labelled documents.

    docs: doc_id, text, lang; labels: doc_id, toxic (null: unlabelled).  The
    sample is the rows of least hash, with texts of any length.  For the
    thresholds every labelled row counts once, so that classes have their true
    shares: rows of the sample with the score by a net fitted on the other
    folds, all others with the net's own.  Without labels of both classes all
    scores are the label's share.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = sum(k * x for k, x in n.items()) / max(1, sum(n.values()))
    h = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # a first cut by the hash keeps the ranking small: twice the rows that are wanted, and some
    few = [known.where((F.col("toxic") == label) & (h < min(1.0, 2.0 * rows / count + 50 / count))).orderBy(h, "doc_id").limit(rows) for label, count in sorted(n.items())]
    chosen = known.limit(0) if not few else few[0]
    for x in few[1:]:
        chosen = chosen.unionByName(x)
    chosen = written(chosen, "toxicity-sample")
    found = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "toxic")

    def fitted(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bounded sample in one task, which leaves the driver free: the net, then each row's score by a net that has not seen it."""
        every = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "lang": [], "toxic": []}), *pages]).sort_values(["doc_id", "text"], ignore_index=True)
        y, texts = every["toxic"].to_numpy(dtype=np.float32), every["text"].tolist()
        # ids that stand for several documents each could make the sample larger than it may be
        used = np.argsort(np.argsort(pd.util.hash_array(every["text"].fillna("").to_numpy(dtype=object)), kind="stable")) < 4 * rows
        pick = lambda mask: [texts[i] for i in np.flatnonzero(mask)]
        net = fit(pick(used), y[used], share)
        yield pd.DataFrame({"net": [pickle.dumps(net)], "lang": [None], "toxic": [None], "score": [None]})
        if not thresholds:
            return
        fold = np.random.default_rng(2).permutation(len(every)) % folds
        fold[~used] = folds  # by the net itself
        for k in np.unique(fold):
            own = fold == k
            other = net if k == folds else fit(pick(used & ~own), y[used & ~own], share)
            yield pd.DataFrame({"net": None, "lang": every["lang"][own], "toxic": y[own].astype(np.int32), "score": other.scores(*text_buffers(pa.array(pick(own), pa.string())))})

    made = written(found.repartition(1).mapInPandas(fitted, "net binary, lang string, toxic int, score double"), "toxicity-net")
    first = made.where(F.col("net").isNotNull()).select("net").first()
    net = pickle.loads(first.net) if first else fit([], np.zeros(0), share)
    if thresholds and len(n) > 1:
        scored = score(docs.select("doc_id", "lang", "text"), net, ["doc_id", "lang"])
        seen = F.broadcast(chosen.distinct().withColumn("chosen", F.lit(True)))
        outside = scored.join(known, "doc_id").join(seen, ["doc_id", "toxic"], "left").where(F.col("chosen").isNull())
        counts = made.where(F.col("net").isNull()).select("lang", "toxic", "score").unionByName(outside.select("lang", "toxic", "score"))
        cells = counts.groupBy("lang", odds_bin(F.col("score")).alias("bin")).agg(F.count_if(F.col("toxic") == 0).alias("no"), F.count_if(F.col("toxic") != 0).alias("yes")).toPandas()
        net.thresholds, net.common = thresholds_of(cells)
    return net


def odds_bin(s):
    """Bin of a score by its log odds, so that scores near 0 and 1 are told apart as well."""
    odds = F.greatest(F.lit(-MOST_ODDS), F.least(F.lit(MOST_ODDS), F.log(s) - F.log1p(-s)))
    return F.floor(F.coalesce(odds, F.when(s > 0.5, F.lit(MOST_ODDS)).otherwise(F.lit(-MOST_ODDS))) * BINS).cast("int")


def thresholds_of(cells: pd.DataFrame, least: int = 20) -> tuple[dict[str, float], float | None]:
    """(threshold by language, threshold over all rows) from counts of both classes by language and bin.

    A language with fewer than ``least`` rows of a class has none of its own and
    takes that over all rows, which is there as soon as both classes are.
    """

    def best(own: pd.DataFrame, least: int) -> float | None:
        own = own.groupby("bin")[["no", "yes"]].sum().sort_index()
        if own["no"].sum() < least or own["yes"].sum() < least:
            return None
        at = 1 / (1 + np.exp(-own.index.to_numpy() / BINS))
        ends = 1 / (1 + np.exp(-(own.index.to_numpy() + 1) / BINS))
        wrong = np.concatenate([[0], np.cumsum(own["yes"])]) + np.concatenate([np.cumsum(own["no"][::-1])[::-1], [0]])
        low, high = np.concatenate([[0], ends]), np.concatenate([at, [1]])
        k = int(np.where(wrong == wrong.min(), high - low, -1).argmax())
        return float((low[k] + high[k]) / 2)

    each = {lang: best(own, least) for lang, own in cells.groupby("lang")}
    return {lang: t for lang, t in each.items() if t is not None}, best(cells, 1)


def score(docs: DataFrame, net: Net, keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``, its score (0 to 1).  Null and empty texts have a text's score without words.

    Every row is scored by its text alone, of any length; columns of any name
    and type stay (or those of ``keep``), but one named ``into`` is replaced.
    """
    docs = docs.drop(into)
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    kept = [docs.columns.index(f.name) for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            got = [shared.value.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, _SLICE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(np.concatenate(got) if got else np.zeros(0))], names=[*(f.name for f in fields), into])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(into, T.DoubleType())]))


def rejected(net: Net, default: float = THRESHOLD, scores: str = "score"):
    """Whether a scored row goes: its score reaches its language's threshold, or else that over all languages."""
    limit = F.lit(default if net.common is None else net.common)
    for lang, t in sorted(net.thresholds.items()):
        limit = F.when(F.col("lang") == lang, F.lit(t)).otherwise(limit)
    return F.col(scores) >= limit
