"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of fixed length, each filter keeps its largest
response in a window, and a softmax turns these into languages. The network is trained here in numpy, on windows of
a bounded sample of labelled rows; then every window of every text is scored, and a text's probabilities are the
normalised geometric mean over its windows. Scoring is a map: no shuffle, and the network of a few thousand numbers
goes with the tasks.
"""

import numpy as np
from pyspark.sql import functions as F

from .textops import widened

WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
WINDOW = 256  # bytes
BATCH = 512  # windows that are worked on at once
SAMPLE = 1500  # labelled rows a language, about
PIECES, PIECE = 3, 200  # cut from a row of the sample; characters of a piece
UNKNOWN = "und"


class Network:
    def __init__(self, languages, seed=7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n = len(WIDTHS) * FILTERS
        # one matrix holds the filters of all widths; rows beyond a filter's width stay zero
        self.mask = np.repeat(np.repeat((np.arange(max(WIDTHS))[:, None] < np.array(WIDTHS)[None, :]).astype(np.float32), EMBED, 0), FILTERS, 1)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.3, (max(WIDTHS) * EMBED, n)).astype(np.float32) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.prior = np.zeros(len(languages), np.float32)

    def spread(self, x):
        """The embedded bytes of ``max(WIDTHS)`` places side by side, for each place of each window."""
        e = self.embed[x]
        n, size, d = e.shape
        places = size - max(WIDTHS) + 1
        view = np.lib.stride_tricks.as_strided(e, (n, places, max(WIDTHS) * d), e.strides, writeable=False)
        return np.ascontiguousarray(view).reshape(n * places, -1), places

    def logits(self, x):
        """Log-probabilities of the languages for windows of bytes."""
        flat, places = self.spread(x)
        top = (flat @ self.filters).reshape(len(x), places, -1).max(axis=1)
        z = np.maximum(top + self.bias, 0) @ self.out + self.prior
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def step(self, x, y):
        """The gradients of the mean cross entropy, by parameter."""
        flat, places = self.spread(x)
        conv = (flat @ self.filters).reshape(len(x), places, -1)
        best = conv.argmax(axis=1)
        top = np.take_along_axis(conv, best[:, None, :], 1)[:, 0] + self.bias
        act = np.maximum(top, 0)
        z = act @ self.out + self.prior
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (top > 0)
        picked = flat[np.arange(len(x))[:, None] * places + best]  # window, filter, inputs
        d_filters = np.einsum("wf,wfi->if", back, picked, optimize=True) * self.mask
        d_inputs = (back[:, :, None] * self.filters.T[None]).reshape(len(x), best.shape[1], max(WIDTHS), EMBED)
        d_embed = np.zeros_like(self.embed)
        at = best[:, :, None] + np.arange(max(WIDTHS))
        np.add.at(d_embed, x[np.arange(len(x))[:, None, None], at], d_inputs)
        return {"embed": d_embed, "filters": d_filters, "bias": back.sum(0), "out": act.T @ p, "prior": p.sum(0)}


def windowed(texts):
    """Windows of bytes of some texts, zero-filled, with the number of windows of each text."""
    rows, counts = [], []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        n = max(1, -(-len(data) // WINDOW))
        padded = np.zeros(n * WINDOW, np.uint8)
        padded[: len(data)] = data
        rows.append(padded.reshape(n, WINDOW))
        counts.append(n)
    return np.concatenate(rows), np.array(counts)


def train(texts, languages, steps=800, rate=0.004, seed=7):
    """A network fitted to bytes and their languages by so many steps of Adam on 128 windows each."""
    net = Network(sorted(set(languages)), seed)
    x, counts = windowed(texts)
    y = np.repeat(np.array([net.languages.index(v) for v in languages]), counts)
    rng, names = np.random.default_rng(seed), ("embed", "filters", "bias", "out", "prior")
    one = {k: np.zeros_like(getattr(net, k)) for k in names}
    two = {k: np.zeros_like(getattr(net, k)) for k in names}
    order = rng.permutation(len(x))
    for t in range(1, steps + 1):
        if len(order) < 128:
            order = np.concatenate([order, rng.permutation(len(x))])
        some, order = order[:128], order[128:]
        for k, g in net.step(x[some], y[some]).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            getattr(net, k)[...] -= (rate * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def labelled_sample(docs, text="text", lang="lang", key="doc_id", sample=SAMPLE):
    """About ``sample`` rows a language of a table of labelled texts, picked by a hash of key and text: pieces of the
    text from its start, middle and end. Null and empty texts and null languages are left out."""
    usable = docs.filter(F.col(f"`{lang}`").isNotNull() & (F.length(F.trim(F.col(f"`{text}`"))) > 0))
    shares = {r[0]: min(1.0, sample / r[1]) for r in usable.groupBy(F.col(f"`{lang}`").alias("v")).count().collect()}
    if not shares:
        return []
    share = F.create_map(*(F.lit(v) for pair in shares.items() for v in pair))
    draw = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.length(F.col(f"`{text}`"))), F.lit(1_000_003)) / 1_000_003.0
    size = F.length(F.col(f"`{text}`"))
    cuts = [F.substring(F.col(f"`{text}`"), F.greatest(F.lit(1), (size - PIECE) * i / (PIECES - 1)).cast("int"), F.lit(PIECE)) for i in range(PIECES)]
    rows = usable.filter(draw < F.element_at(share, F.col(f"`{lang}`"))).select(F.col(f"`{lang}`"), F.array_distinct(F.array(*cuts)))
    return [(piece, language) for language, pieces in rows.collect() for piece in pieces]


def identify(docs, network, text="text"):
    """``docs`` with ``lang_pred`` and ``score`` added, columns of these names replaced.

    ``score`` is the probability of ``lang_pred``. A text that is null or has no letter is ``und`` with score 0, and so
    is every text if the network is None, for want of labels.
    """
    rest, shape = widened(docs.schema, "lang_pred string, score double")
    return docs.mapInArrow(_identify(network, text, rest), shape)


def _identify(network, text, names):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            values = batch[text].to_pylist()
            some = [i for i, v in enumerate(values) if network is not None and v and any(map(str.isalpha, v))]
            languages, scores = [UNKNOWN] * len(values), np.zeros(len(values))
            for i, p in zip(some, probabilities(network, (values[i].encode() for i in some)), strict=True):
                best = int(p.argmax())
                languages[i], scores[i] = network.languages[best], min(1.0, float(p[best]))
            yield pa.record_batch([*(batch[c] for c in names), pa.array(languages, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return run


def probabilities(network, texts):
    """For each of some texts (bytes) the probabilities of the languages, with a bounded number of windows at a time."""
    held, n = [], 0
    for data in texts:
        if held and n + len(data) // WINDOW >= BATCH:
            yield from _scored(network, held)
            held, n = [], 0
        held.append(data)
        n += len(data) // WINDOW + 1
    if held:
        yield from _scored(network, held)


def _scored(network, texts):
    x, counts = windowed(texts)
    logs = np.concatenate([network.logits(x[i : i + BATCH]) for i in range(0, len(x), BATCH)])
    mean = np.add.reduceat(logs, np.concatenate([[0], np.cumsum(counts)[:-1]]), axis=0) / counts[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def learned(docs, sample=SAMPLE, **columns):
    """The network of a table of labelled texts; None without any."""
    pieces = labelled_sample(docs, sample=sample, **columns)
    return train([p.encode() for p, _ in pieces], [v for _, v in pieces]) if pieces else None
