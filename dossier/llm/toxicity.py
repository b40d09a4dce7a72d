"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence's probability is logistic in its words, the text's is the noisy-or of its
sentences, and only texts have labels: training moves the words of the sentences that explain a label. The fit is
numpy over a bounded sample of labelled rows; scoring is a map over whole texts that also names the sentence that
speaks most for the score. Features are whole words and the beginnings of words, known by their hash, so the model
is two arrays and unseen forms of a known stem count too.
"""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from .textops import Words, buffers, mix, slices, widened

SAMPLE, SAMPLE_BYTES = 4000, 12_000_000  # rows of each label, and bytes of all of these, at most and about, in the sample
INDEXED = 1_000_000  # features of the sample that are looked up at once
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True  # line feed ! . ?
#: Words end at every ASCII character that is no letter, digit or apostrophe.
GAPS = np.ones(256, bool)
START = -8.0  # the bias that training starts from: few sentences offend
HEADS = (4, 6)  # bytes of the beginnings
GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False


class Bags:
    """Word hashes of some texts with the sentences they stand in."""

    def __init__(self, array):
        words = Words(array, lower=True, gaps=GAPS)
        size = words.end - words.start
        kinds = [words.hashes(), *(mix(words.hashes(n) + np.uint64(n)) for n in HEADS)]
        self.hashes = np.stack(kinds, axis=1)  # of each word: a row of features
        self.used = np.stack([np.ones(len(words), bool), *(size > n for n in HEADS)], axis=1)
        ends = np.concatenate([[0], np.cumsum(ENDS[words.data])])[words.start]
        text = words.text_of()
        new = np.ones(len(words), bool)
        new[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
        self.first = np.flatnonzero(new)  # of the sentences: their first words
        self.sentence = np.cumsum(new) - 1
        self.text = text[self.first]  # of the sentences
        self.texts = len(words.count)
        self.begin = words.start[self.first]
        self.end = words.end[np.append(self.first[1:], len(words)) - 1] if len(words) else self.begin
        self.words = words


class Model:
    def __init__(self, keys, weights, bias):
        self.keys, self.weights, self.bias = keys, weights, bias

    def index(self, hashes):
        """Places in the weights; those of unknown words are one beyond them, where the weight is 0."""
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def logits(self, bags):
        """One for each sentence with words."""
        w = np.append(self.weights, 0.0)[self.index(bags.hashes)]
        return self.bias + np.bincount(bags.sentence, (w * bags.used).sum(axis=1), len(bags.first))

    def score(self, bags):
        """The noisy-or of each text; 0 for a text without words. The strongest sentence of each text, or -1."""
        z = self.logits(bags)
        total = np.bincount(bags.text, np.logaddexp(0, z), bags.texts)
        order = np.lexsort((np.arange(len(z)), -z, bags.text))
        strongest = np.full(bags.texts, -1)
        lead = order[np.flatnonzero(np.diff(bags.text[order], prepend=-1))]
        strongest[bags.text[lead]] = lead
        return -np.expm1(-total), strongest


def train(texts, labels, shares=None, epochs=150, rate=1.0, penalty=1e-4, rare=3):
    """A model fitted by AdaGrad on the whole sample; features of fewer than ``rare`` texts are not learned.

    ``shares``: the weight of a text of each label, for a sample that has the labels in other shares than all rows.
    """
    y = np.asarray(labels, float)
    hashes, sentence, text, once = _features(texts)
    keys, count = np.unique(once, return_counts=True)
    model = Model(keys[count >= rare], np.zeros((count >= rare).sum()), START)
    at = np.concatenate([model.index(hashes[i : i + INDEXED]).astype(np.int32) for i in range(0, max(1, len(hashes)), INDEXED)])
    at, sentence = at[at < len(model.keys)], sentence[at < len(model.keys)]
    del hashes, once
    each = np.array([(shares or {}).get(int(v), 1.0) for v in labels])
    each /= each.sum()
    grads, grad_b = np.full(len(model.keys), 1e-8), 1e-8
    for _ in range(epochs):
        z = model.bias + np.bincount(sentence, model.weights[at], len(text))
        total = np.bincount(text, np.logaddexp(0, z), len(y))
        pull = each * np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)  # of the loss by the total
        g = pull[text] / (1 + np.exp(-np.clip(z, -500, 500)))
        gw = np.bincount(at, g[sentence], len(model.keys)) + penalty * np.tanh(10 * model.weights)
        gb = g.sum()
        grads, grad_b = grads + gw * gw, grad_b + gb * gb
        model.weights = model.weights - rate * gw / np.sqrt(grads)
        model.bias -= rate * gb / np.sqrt(grad_b)
    return model


def _features(texts):
    """Of all texts: feature hashes with their sentences, the text of each sentence, and the features of each text once."""
    import pyarrow as pa

    hashes, sentence, text, once = ([] for _ in range(4))
    sentences = done = 0
    for part in slices(pa.record_batch([pa.array(texts, pa.string())], names=["text"])):
        bags = Bags(part["text"])
        row, kind = np.nonzero(bags.used)
        hashes.append(bags.hashes[row, kind])
        pairs = mix(hashes[-1] + mix(bags.text[bags.sentence[row]].astype(np.uint64)))
        once.append(hashes[-1][np.unique(pairs, return_index=True)[1]])
        sentence.append((bags.sentence[row] + sentences).astype(np.int32))
        text.append(bags.text + done)
        sentences, done = sentences + len(bags.first), done + part.num_rows
    return (np.concatenate(x) for x in (hashes, sentence, text, once))


def labelled_sample(docs, labels, id="doc_id", text="text", label="toxic", sample=SAMPLE, most=SAMPLE_BYTES):
    """(text, label) of about ``sample`` rows of each label, or of so many that they have about ``most`` bytes, picked by
    a hash of the id whatever the length of the text; and what share of the rows with that label was drawn, by label.

    Rows that lack an id, a text or a label are left out; of contradicting labels of one id the higher counts. The ids
    of the sample, about ``sample`` a label at most, go to the texts; no text is shuffled, only lengths are.
    """
    marks = labels.filter(F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("id")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("y"))
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())
    sizes = texts.select("id", F.octet_length("text").cast("long").alias("size")).join(marks, "id").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    rows = {r.y: (r.n, r["size"]) for r in sizes.collect()}
    if not rows:
        return [], {}
    rates = {y: min(1.0, sample / n, most / max(1, size)) for y, (n, size) in rows.items()}
    rate = F.create_map(*(F.lit(v) for pair in rates.items() for v in pair))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    picked = marks.filter(draw < F.element_at(rate, F.col("y")))
    drawn = [(r.text, r.y) for r in texts.join(F.broadcast(picked), "id").select("text", "y").collect()]
    count = Counter(y for _, y in drawn)
    return drawn, {y: k / rows[y][0] for y, k in count.items()}


def learned(docs, labels, **options):
    """The model of a table of texts and a table of labels; without labels one that gives 0.5 to nothing."""
    sample, shares = labelled_sample(docs, labels, **options)
    return train([t for t, _ in sample], [y for _, y in sample], {y: 1 / s for y, s in shares.items()}) if sample else Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)


def judge(docs, model, text="text"):
    """``docs`` with ``score`` (0 to 1) and the strongest ``sentence`` with its ``sentence_score`` added.

    Columns of these names are replaced. A text without words, a null one too, has score 0 and a null sentence.
    """
    rest, shape = widened(docs.schema, "score double, sentence string, sentence_score double")
    return docs.mapInArrow(_judge(model, text, rest), shape)


def _judge(model, text, names):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                bags = Bags(part[text])
                score, strongest = model.score(bags)
                logits, values = model.logits(bags), buffers(part[text])[0].tobytes()
                sentences, chances = [], []
                for s in strongest.tolist():
                    sentences.append(None if s < 0 else values[bags.begin[s] : bags.end[s]])
                    chances.append(None if s < 0 else float(1 / (1 + np.exp(-logits[s]))))
                new = [pa.array(score), pa.array(sentences, pa.binary()).cast(pa.string()), pa.array(chances, pa.float64())]
                yield pa.record_batch([*(part[c] for c in names), *new], names=[*names, "score", "sentence", "sentence_score"])

    return run

