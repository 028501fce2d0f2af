"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into chunks that overlap by more than a filter's width and cover all of it. Each byte
becomes a short fixed vector (its class and a random code); learned filters of `WIDTH` bytes slide over a chunk
by `STRIDE`, and the chunk keeps each filter's maximum, rectified. The document keeps the mean, greatest and
least of its chunks' values; one logistic unit turns them into a probability. Training is by Adam, gradients
going through the maxima only.

The classifier is fitted on a bounded sample: the `PER_CLASS` labelled documents of each class with the least
hash of their doc_id, whole; labels without a document, and those of empty texts, are passed over.

Defined cases: null or empty text has no chunk and gets the training sample's share of label 1; without
labels of both classes every score is that share (0.5 with none); ties, repeated rows and extra columns do no
harm; any length is scored whole in bounded memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import id_remainder, sample_by_group, tidy

WIDTH, STRIDE = 8, 4
CHUNK, OVERLAP = 1024, 64
FILTERS = 32
DIM = 16
PER_CLASS = 700
EPOCHS = 6
AT_ONCE = 256  # chunks convolved together


def _byte_vectors() -> np.ndarray:
    """Row b for byte b, row 256 for padding (zeros)."""
    out = np.zeros((257, DIM), np.float32)
    b = np.arange(256)
    chars = [chr(x) for x in b]
    classes = [
        [c.islower() and x < 128 for c, x in zip(chars, b, strict=True)],
        [c.isupper() and x < 128 for c, x in zip(chars, b, strict=True)],
        [c.isdigit() and x < 128 for c, x in zip(chars, b, strict=True)],
        [c == " " for c in chars],
        [c in "\n\r\t" for c in chars],
        [c in ".,;:!?'\"()-" for c in chars],
        [c in "#*$%&|<>@^~_=+/\\{}[]`" for c in chars],
        list(b >= 128),
    ]
    out[:256, : len(classes)] = np.array(classes, np.float32).T
    code = np.random.default_rng(7).standard_normal((256, DIM - len(classes))).astype(np.float32)
    out[:256, len(classes) :] = 0.5 * code
    return out


VECTORS = _byte_vectors()


def chunks(text: str | None) -> np.ndarray:
    """Byte values by chunk (256 pads the last); no row for an empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty((0, CHUNK), np.uint16)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, 256, np.uint16)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Net:
    filters: np.ndarray  # [WIDTH * DIM, FILTERS]
    bias: np.ndarray  # [FILTERS]
    out: np.ndarray  # [3 * FILTERS]
    shift: float
    share: float
    mean: np.ndarray
    scale: np.ndarray

    def pooled(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maximum of each filter, its place) in each chunk, before the bias."""
        c = len(part)
        x = VECTORS[part].reshape(c * CHUNK // STRIDE, STRIDE * DIM)
        k = WIDTH // STRIDE
        w = self.filters.reshape(k, STRIDE * DIM, FILTERS).transpose(1, 0, 2).reshape(STRIDE * DIM, k * FILTERS)
        y = (x @ w).reshape(c, CHUNK // STRIDE, k, FILTERS)
        z = y[:, : CHUNK // STRIDE - k + 1, 0]
        for j in range(1, k):
            z = z + y[:, j : CHUNK // STRIDE - k + 1 + j, j]
        at = z.argmax(axis=1)
        return np.take_along_axis(z, at[:, None], axis=1)[:, 0], at

    def features(self, part: np.ndarray) -> np.ndarray:
        x = VECTORS[part].reshape(-1, STRIDE * DIM)
        k = WIDTH // STRIDE
        w = self.filters.reshape(k, STRIDE * DIM, FILTERS)
        z = (x @ w[0]).reshape(len(part), CHUNK // STRIDE, FILTERS)[:, : CHUNK // STRIDE - k + 1]
        for j in range(1, k):
            z += (x @ w[j]).reshape(len(part), CHUNK // STRIDE, FILTERS)[:, j : CHUNK // STRIDE - k + 1 + j]
        return np.maximum(z.max(axis=1) + self.bias, 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 of each text; chunks of several texts are convolved together."""
        n = len(texts)
        total = np.zeros((n, FILTERS))
        most, least = np.zeros((n, FILTERS)), np.full((n, FILTERS), np.inf)
        count = np.zeros(n)
        waiting: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if not owner:
                return
            h = self.features(np.concatenate(waiting))
            who = np.array(owner)
            np.add.at(total, who, h)
            np.maximum.at(most, who, h)
            np.minimum.at(least, who, h)
            np.add.at(count, who, 1)
            waiting.clear()
            owner.clear()

        for k, text in enumerate(texts):
            part = chunks(text)
            for at in range(0, len(part), AT_ONCE):
                piece = part[at : at + AT_ONCE]
                waiting.append(piece)
                owner.extend([k] * len(piece))
                if len(owner) >= AT_ONCE:
                    flush()
        flush()
        some = count > 0
        doc = np.concatenate([total / np.maximum(count, 1)[:, None], most, np.where(some[:, None], least, 0)], axis=1)
        logit = ((doc - self.mean) / self.scale) @ self.out + self.shift
        return np.where(some, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), self.share)


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Net:
    """A net from labelled texts."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    filters = (rng.standard_normal((WIDTH * DIM, FILTERS)) * 0.15).astype(np.float32)
    net = Net(filters, np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS), 0.0, float(y.mean()) if len(y) else 0.5, np.zeros(3 * FILTERS), np.ones(3 * FILTERS))
    docs = [c for c in map(chunks, texts)]
    use = np.array([k for k, c in enumerate(docs) if len(c)], np.int64)
    if not len(use) or len(set(labels)) < 2:
        net.shift = float(np.log(max(net.share, 1e-6) / max(1 - net.share, 1e-6)))
        return net
    # Classes weigh the same while filters are learned.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    net.out = rng.standard_normal(3 * FILTERS) * 0.05
    params = [net.filters, net.bias, net.out, np.zeros(1)]
    moments = [(np.zeros_like(p, dtype=np.float64), np.zeros_like(p, dtype=np.float64)) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(use)
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            sizes = np.array([len(docs[k]) for k in batch])
            part = np.concatenate([docs[k] for k in batch])
            starts = np.cumsum(sizes) - sizes
            top, place = net.pooled(part)
            raw = top + net.bias
            h = np.maximum(raw, 0)
            mean = np.add.reduceat(h, starts) / sizes[:, None]
            most, least = np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)
            doc = np.concatenate([mean, most, least], axis=1)
            p = 1 / (1 + np.exp(-np.clip(doc @ net.out + params[3][0], -30, 30)))
            g = (p - y[batch]) * weight[batch] / len(batch)
            g_doc = g[:, None] * net.out
            who = np.repeat(np.arange(len(batch)), sizes)
            g_mean, g_most, g_least = np.split(g_doc, 3, axis=1)
            g_h = g_mean[who] / sizes[who][:, None] + g_most[who] * (h == most[who]) + g_least[who] * (h == least[who])
            g_h *= raw > 0
            g_filters = np.zeros_like(filters, dtype=np.float64)
            offsets = np.arange(WIDTH)
            for f in range(FILTERS):
                live = np.flatnonzero(g_h[:, f])
                if len(live):
                    window = part[live[:, None], place[live, f][:, None] * STRIDE + offsets]
                    g_filters[:, f] = g_h[live, f] @ VECTORS[window].reshape(len(live), -1)
            grads = [g_filters, g_h.sum(axis=0), g @ doc + 1e-4 * net.out, np.array([g.sum()])]
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for p_, d, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p_ -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p_.dtype)
    return _finish(net, docs, use, y)


def _finish(net: Net, docs: list[np.ndarray], use: np.ndarray, y: np.ndarray) -> Net:
    """Refit the logistic unit on the learned features by Newton steps, unweighted, so that scores are calibrated."""
    rows = []
    for k in use:
        h = np.concatenate([net.features(docs[k][a : a + AT_ONCE]) for a in range(0, len(docs[k]), AT_ONCE)])
        rows.append(np.concatenate([h.mean(axis=0), h.max(axis=0), h.min(axis=0)]))
    x = np.array(rows, np.float64)
    net.mean, net.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.concatenate([(x - net.mean) / net.scale, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], 2.0)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y[use]) + penalty * w)
    net.out, net.shift = w[:-1], float(w[-1])
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded training sample (crc32(doc_id) mod 3 isn't 1)."""
    marks = labels.where("doc_id is not null and quality is not null").where(id_remainder(F.col("doc_id"), 3) != 1)
    marks = marks.groupBy("doc_id").agg((F.max("quality") >= 1).cast("int").alias("grp"))
    usable = F.when(F.col("text") != "", F.col("text"))
    rows = sample_by_group(marks, docs, usable, per_class)
    return [text for _, text in rows], [y for y, _ in rows]


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
