"""Language-model scores by a probabilistic suffix tree over words.

The root is the smoothed word distribution. A context of one to ``DEPTH`` words is a candidate if it occurs at least
``LEAST_CONTEXT`` times; it becomes a state if its distribution of next words diverges from that of its longest retained
suffix. A state's distribution keeps the next words that follow it at least ``LEAST_JOINT`` times, discounted; the rest
of its mass goes to the distribution of the shorter suffix. So each distribution sums to one. A token is scored by the
longest suffix that is a state. The floors are counts, whatever the size of the corpus: the tree grows with it.

All counts are taken over the whole corpus. Words and runs of words (grams) go by their 64-bit hash; tasks count before
they shuffle. Counts, chances and states are stored tables that are joined; nothing of them but frequent rows and bit
sieves reaches the driver. A sieve is a bitmap of fixed size that knows every key of a table and few others, so tasks
leave out most grams that no join would find; joins decide. The logarithm of a token's chance is that of its word and a
sum over contexts: the rest of a state's mass if the word is no entry of it, the gain of the entry if it is. So each gram
has one value, and a text's score is the sum of the values of its grams. Words with a share of at least ``HEAVY`` and
values with a share of at least ``NEAR`` of the tokens go with the tasks (at most 1/HEAVY, and 1/NEAR for each size of
gram); the many rare ones are found by joins, in ``PASSES`` of which each holds its share of the grams. A job's shuffle files and
the tables of a finished depth are removed as soon as nothing reads them.
"""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import dropped, freed
from .textops import Words, slices

DEPTH, HEAVY, NEAR = 3, 2.0**-21, 2.0**-20
LEAST_CONTEXT, LEAST_JOINT = 5, 2  # counts below which nothing is learned
DISCOUNT, DIVERGENCE, GAIN = 0.75, 0.01, 10.0  # of counts; nats a token and nats in all that a state must gain
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
FLUSH = 1_000_000  # distinct keys that a task counts before it sends them on
SIEVE = 27  # a sieve has 2**SIEVE bits
PASSES = 4  # in which values are joined to the texts, so that a part of the pairs is shuffled at a time; a power of two


def score(docs, held_out, id="doc_id", text="text"):
    """One row for each row of ``docs``: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``held_out`` is a column: rows where it is true are not learned from (null counts as false). Tokens are
    ASCII-lower-cased words and one end; a null or empty text is an end alone. Scores are log10 probabilities of the
    text, ``base_score`` that of single tokens. Without any training row both have one unknown token to go by, with
    probability one. Repeated rows count as often as they occur.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    training = rows.filter(~F.col("held_out")).select("text")
    words = freed(training.mapInArrow(_counted(_words, ["k"]), "k long, n long").groupBy("k").agg(F.sum("n").alias("c")))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    mass = total + 0.5 * (distinct + 1)
    values = tree(training, words, mass)
    heavy, near = (_sorted(df, v) for df, v in ((words.filter(F.col("c") >= HEAVY * total), "c"), (values.filter(F.col("c") >= NEAR * total), "value")))
    sent = spark.sparkContext.broadcast((mass, heavy, near, sieve(values)))
    held = "row long, id {0}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>" + "".join(f", far{i} array<long>, far_times{i} array<int>" for i in range(PASSES))
    scored = freed(rows.mapInArrow(_scored(sent), held.format(docs.schema[id].dataType.simpleString())))
    pairs = lambda keys, n: scored.select("row", F.explode(F.arrays_zip(keys, n)).alias("x")).select("row", F.col(f"x.{keys}").alias("k"), F.col(f"x.{n}").alias("n"))
    chance = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(mass))
    found = freed(pairs("rare", "times").join(words, "k", "left").groupBy("row").agg(F.sum(F.col("n") * chance).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")))
    parts = []
    for i in range(PASSES):
        some = values.filter(F.pmod("k", F.lit(PASSES)) == i).select("k", "value")
        parts.append(freed(pairs(f"far{i}", f"far_times{i}").join(some, "k").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("gained"))))
    gained = union(parts).groupBy("row").agg(F.sum("gained").alias("gained"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found, "row", "left").join(gained, "row", "left").select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more + F.coalesce("gained", F.lit(0.0))).alias("score"),
    )


def tree(training, words, mass):
    """The stored values (``k``, ``c``, ``value``) of the grams of one to ``DEPTH`` + 1 words that have one; ``c`` is how often they occur."""
    grams, tables, parts = words.select("k", "c", ((F.col("c") + 0.5) / F.lit(mass)).alias("p")), [], []
    of_context = Window.partitionBy("context")
    for n in range(1, DEPTH + 1):
        contexts = grams.filter(F.col("c") >= LEAST_CONTEXT).select(F.col("k").alias("context"), F.col("c").alias("seen"))
        sent = training.sparkSession.sparkContext.broadcast((sieve(contexts, "context"), sieve(grams.filter(F.col("c") >= LEAST_JOINT))))
        made = training.mapInArrow(_counted(_grams(n, sent), ["context", "suffix"]), "context long, suffix long, n long")
        # what a task sends is counted and in order of the contexts: neither counted again before it is sent, nor a context written out for each of its rows
        dealt = made.withColumn("part", F.shiftrightunsigned("suffix", 61)).repartition("context", "part")
        counted = dealt.groupBy("context", "part", "suffix").agg(F.sum("n").alias("c")).filter(F.col("c") >= LEAST_JOINT)
        counted = freed(counted.select(F.xxhash64("context", "suffix").alias("k"), "context", "suffix", "c"))
        found = counted.join(grams.select(F.col("k").alias("suffix"), F.col("p").alias("shorter")), "suffix").drop("suffix").join(contexts, "context")
        entries = found.withColumn("kept", (F.col("c") - DISCOUNT) / F.col("seen")).withColumn("rest", 1.0 - F.sum("kept").over(of_context))
        chance = F.col("kept") + F.col("rest") * F.col("shorter")
        told = F.sum(F.col("c") * F.log(chance / F.col("shorter"))).over(of_context) + (F.col("seen") - F.sum("c").over(of_context)) * F.log(F.greatest("rest", F.lit(1e-12)))
        state = (F.col("gain") >= GAIN) & (F.col("gain") >= DIVERGENCE * F.col("seen"))
        judged = entries.withColumn("gain", told).withColumn("state", state).withColumn("p", F.when(F.col("state"), chance).otherwise(F.col("shorter")))
        value = F.when(F.col("state"), F.log10(F.col("p") / F.col("shorter")) - F.log10("rest"))
        held = freed(judged.select("k", "context", "c", "p", value.alias("value"), *(F.when(F.col("state"), F.col(x)).alias(x) for x in ("seen", "rest"))))
        grams = held.select("k", "c", "p")
        states = held.filter("seen IS NOT NULL").groupBy("context").agg(F.first("seen").alias("c"), F.log10(F.first("rest")).alias("value"))
        parts += [states.withColumnRenamed("context", "k"), held.filter("seen IS NOT NULL").select("k", "c", "value")]
        tables.append(held)
        dropped(counted)
        sent.unpersist()
    values = freed(union(parts).groupBy("k").agg(F.max("c").alias("c"), F.sum("value").alias("value")))
    dropped(*tables)
    return values


def union(parts):
    """All rows of some tables."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def sieve(df, key="k"):
    """A bitmap of the first ``SIEVE`` bits of the keys."""
    table = df.select(F.col(key).alias("k")).mapInArrow(_bits, "part int, bits binary").repartition("part").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    out = np.zeros((2 ** (SIEVE - 15), 2**12), np.uint8)
    for part, bits in zip(table["part"], table["bits"], strict=True):
        out[part.as_py()] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.ravel()


def _bits(batches):
    """The bitmap of the keys of a task, in parts of 2**15 bits."""
    import pyarrow as pa

    bits = np.zeros((2 ** (SIEVE - 15), 2**12), np.uint8)
    for batch in batches:
        slot = np.asarray(batch["k"]).view(np.uint64) >> np.uint64(64 - SIEVE)
        np.bitwise_or.at(bits.reshape(-1), slot >> np.uint64(3), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    used = np.flatnonzero(bits.any(axis=1))
    for at in np.array_split(used, -(-len(used) // 512) or 1):
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array([bits[i].tobytes() for i in at], pa.binary())], names=["part", "bits"])


def passes(bits, keys):
    """Whether the sieve lets the keys pass."""
    slot = keys >> np.uint64(64 - SIEVE)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _sorted(df, value):
    """Keys in order and their values."""
    table = df.select("k", F.col(value).cast("double").alias("v")).toArrow()
    keys = np.asarray(table["k"]).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(table["v"])[order]


class Tokens:
    """Hashes of the tokens of some texts, ends included, and their places in their texts."""

    def __init__(self, array):
        words = Words(array, lower=True)
        self.count = words.count + 1
        self.last = np.cumsum(self.count) - 1
        self.hashes = np.full(self.count.sum(), END, np.uint64)
        inner = np.ones(len(self.hashes), bool)
        inner[self.last] = False
        self.hashes[inner] = words.hashes()
        self.known = [self.hashes]
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.hashes)) - (self.last - self.count + 1)[self.text]

    def grams(self, n):
        """A hash for each ``n`` consecutive tokens, across ends too: that of a word, or of what a gram starts and ends with."""
        while len(self.known) < n:
            last = self.known[-1]
            self.known.append(paired(last[:-1], last[1:]))
        return self.known[n - 1]

    def within(self, n):
        """Places at which ``n`` tokens of one text start."""
        return np.flatnonzero(self.text[: max(0, len(self.text) - n + 1)] == self.text[n - 1 :])


def paired(first, second):
    """``xxhash64`` of two columns of longs, as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x, by):
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    out = np.full(len(first), 42, np.uint64)
    for value in (first, second):
        out = out + (p5 + np.uint64(8)) ^ turned(value * p2, 31) * p1
        out = turned(out, 27) * p1 + p4
        out = (out ^ (out >> np.uint64(33))) * p2
        out = (out ^ (out >> np.uint64(29))) * p3
        out ^= out >> np.uint64(32)
    return out


def _words(tokens):
    return [tokens.hashes, tokens.hashes]


def _grams(n, sent):
    """Grams of n + 1 words with the contexts they start with and the grams of n words they end with."""

    def run(tokens):
        contexts, suffixes = sent.value
        short, at = tokens.grams(n), tokens.within(n + 1)
        at = at[passes(contexts, short[at])]
        at = at[passes(suffixes, short[at + 1])]
        return [tokens.grams(n + 1)[at], short[at], short[at + 1]]

    return run


def _counted(columns_of, names):
    """Counts the keys of all texts of a task, in parts of bounded size; further columns are functions of the key.

    Of each part the keys stay here; the further columns are sent, in the order of the first of them.
    """
    import pyarrow as pa

    def reduced(columns, n=None):
        order = np.argsort(columns[0])
        keys = columns[0][order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first) if len(keys) else n
        return [c[order[first]] for c in columns], times.astype(np.int64)

    def merged(held):
        return reduced([np.concatenate(c) for c in zip(*(c for c, _ in held), strict=True)], np.concatenate([n for _, n in held]))

    def batch_of(columns, n):
        order = np.argsort(columns[1])
        return pa.record_batch([*(pa.array(c[order].view(np.int64)) for c in columns[1:]), pa.array(n[order])], names=[*names, "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                held.append(reduced(columns_of(Tokens(part["text"]))))
                size += len(held[-1][1])
                if size > FLUSH:
                    held = [merged(held)]
                    size = len(held[0][1])
                    if size > FLUSH // 2:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged(held))

    return run


def _index(keys):
    """Where in the sorted keys those with the same first bits begin; there are about as many slots as keys."""
    bits = max(1, len(keys).bit_length())
    return keys, np.append(np.searchsorted(keys, np.arange(2**bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)), np.uint64(64 - bits)


def _find(index, values):
    """Places of the values in the sorted keys, -1 for those that are not there."""
    keys, begin, shift = index
    slot = (values >> shift).astype(np.int64)
    at, end, out = begin[slot], begin[slot + 1], np.full(len(values), -1)
    left = np.flatnonzero(at < end)
    at = at[left]
    while len(left):
        hit = keys[at] == values[left]
        out[left[hit]] = at[hit]
        on = ~hit & (at + 1 < end[left])
        left, at = left[on], at[on] + 1
    return out


def _scored(sent):
    import pyarrow as pa

    def lists(text, keys, n):
        """For each of n texts its distinct keys and how often each occurs."""
        order = np.lexsort((keys, text))
        text, keys = text[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(keys))).astype(np.int32)
        ends = np.searchsorted(text[first], np.arange(n + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (keys[first].view(np.int64), times)]

    def run(batches):
        mass, (words, counts), (near, values), known = sent.value
        chances, values = np.append(np.log10((counts + 0.5) / mass), 0.0), np.append(values, 0.0)  # -1: the appended 0
        words, near = _index(words), _index(near)
        for batch in batches:
            for part in slices(batch):
                tokens = Tokens(part["text"])
                number, n = _find(words, tokens.hashes), len(tokens.count)
                rare = number < 0
                base = np.bincount(tokens.text, chances[number], n)
                score, far = base.copy(), [(tokens.text[:0], tokens.hashes[:0])]
                for size in range(1, DEPTH + 2):
                    at = tokens.within(size)
                    keys = tokens.grams(size)[at]
                    some = passes(known, keys)
                    keys, text = keys[some], tokens.text[at[some]]
                    place = _find(near, keys)
                    score += np.bincount(text, values[place], n)
                    far.append((text[place < 0], keys[place < 0]))
                n_known = pa.array(np.bincount(tokens.text, ~rare, n).astype(np.int64))
                own = lists(tokens.text[rare], tokens.hashes[rare], n)
                columns, names = [part["row"], part["id"], part["held_out"], pa.array(tokens.count), n_known, pa.array(base), pa.array(score), *own], ["rare", "times"]
                text, keys = map(np.concatenate, zip(*far, strict=True))
                turn = keys % np.uint64(PASSES)
                for i in range(PASSES):
                    columns += lists(text[turn == i], keys[turn == i], n)
                    names += [f"far{i}", f"far_times{i}"]
                yield pa.record_batch(columns, names=["row", "id", "held_out", "n_tokens", "n_known", "base", "score", *names])

    return run
