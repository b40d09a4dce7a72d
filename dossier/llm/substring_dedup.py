"""Removal of passages that occur more than once, found by difference-cover anchors.

A difference cover is a set of residues modulo a period in which any two positions have a common
shift: for all i and j some d < period has both i + d and j + d in the cover. Only words at cover
positions start an anchor (a short window), and two equal windows of ``window`` words always share an
aligned anchor of ``window - period + 1`` words. So a few anchors a period tell where a repeat can be;
the full windows around repeated anchors are then compared by a 96-bit hash, and nothing else is.

Of equal texts only the first takes part, marked as repeated: its copies lose the same words. Hot passages: equal anchors or windows of one slice of text are told there and then, and one of them
is sent on, so a passage in a third of all documents sends one row a slice, not one a document.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import by_place, named, numbered, stored
from .textops import Words, mix, slices, widened, windows

#: Perfect difference sets by their period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
_OTHER = 0xA0761D6478BD642F  # step of the second hash of a window


def remove_repeats(docs, text="text", window=35):
    """``docs`` with ``n_words``, ``n_removed`` (long) and ``kept_text`` added, columns of these names replaced.

    Words are runs of anything but ASCII white space. Every word is removed that a window of
    ``window`` words covers whose word sequence also starts at another place of any text. A null or
    empty text has no words, ``kept_text`` is then ''. Repeated rows are texts of their own, so both
    lose all words if they are long enough. Windows are judged on the input: removals do not make new
    neighbours. ``docs`` is read more than once.
    """
    rows, names = by_place(docs)
    return named(_removed(rows, names[text], window), names, "n_words", "n_removed", "kept_text")


def _removed(docs, text, window):
    period = max(p for p in COVERS if p <= max(1, (window + 7) // 2) and p <= window)
    keyed = numbered(docs)
    base = keyed.join(_copies(keyed, text), "__row", "left")
    anchors = base.filter("__first is null or __first").mapInArrow(_anchors(text, window, period), "k long, row long, pos int")
    near = _repeated(anchors, "k")
    found = base.join(near, F.col("__row") == F.col("__near"), "left").mapInArrow(_extended(text, window, period), "k long, k2 int, row long, pos int")
    sure = _repeated(found, "k", "k2")
    kept, shape = widened(docs.schema, "n_words long, n_removed long, kept_text string")
    return base.join(sure, F.col("__row") == F.col("__near"), "left").mapInArrow(_cut(text, window, kept), shape)


def _copies(keyed, text):
    """The rows whose text occurs more than once, and whether a row is the first of its text."""
    marks = keyed.select("__row", F.xxhash64(F.col(f"`{text}`")).alias("h"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("h2"))
    groups = stored(marks.groupBy("h", "h2").agg(F.min("__row").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    return marks.join(groups, ["h", "h2"]).select("__row", (F.col("__row") == F.col("least")).alias("__first"))


def _repeated(rows, *key):
    """The positions of each row whose key occurs twice; a position that is known to repeat comes as its complement."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    hits = rows.withColumn("n", n).filter((F.col("n") > 1) | (F.col("pos") < 0))
    place = F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos"))
    return hits.groupBy(F.col("row").alias("__near")).agg(F.collect_list(place).alias("__at"))


def _told(keys, rows, places, known=False):
    """A record batch of keys with their rows and places, ``known`` to repeat or not. Of equal keys the first is sent under the key, the others,
    known to repeat, under keys of their own."""
    import pyarrow as pa

    _, first, group, count = np.unique(keys[0], return_index=True, return_inverse=True, return_counts=True)
    twice = count[group] > 1
    known = known | twice
    rest = twice
    rest[first] = False
    spread = mix(mix(rows.astype(np.uint64)) + places.astype(np.uint64))
    sent = [pa.array(np.where(rest, spread, keys[0]).view(np.int64))]
    sent += [pa.array((np.where(rest, spread, k) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for k in keys[1:]]
    at = np.where(known, ~places, places).astype(np.int32)
    return pa.record_batch([*sent, pa.array(rows), pa.array(at)], names=["k", *["k2"][: len(sent) - 1], "row", "pos"])


def _anchors(text, window, period):
    size, cover = window - period + 1, np.isin(np.arange(period), COVERS[period])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part[text])
                keys = windows(words.hashes(), size)
                place = np.arange(len(words)) - np.repeat(words.first[:-1], words.count)
                pick = np.flatnonzero((words.fits(size) & cover[place % period])[: len(keys)])
                if len(pick):
                    which = words.text_of()[pick]
                    yield _told([keys[pick]], np.asarray(part["__row"])[which], place[pick], _first(part)[which])

    return run


def _first(part):
    """Which texts are the first of several equal ones."""
    return np.asarray(part["__first"].fill_null(False))


def _spans(words, lists, before, after):
    """Which words lie between ``before`` words ahead of a listed place and ``after`` words behind it, in its text."""
    change = np.zeros(len(words) + 1, np.int64)
    flat = np.asarray(lists.flatten()).astype(np.int64)
    if len(flat):
        filled = lists.fill_null([]) if lists.null_count else lists
        sizes = np.diff(np.asarray(filled.offsets))
        base = np.repeat(words.first[:-1], sizes)
        end = np.repeat(words.first[1:], sizes)
        np.add.at(change, np.maximum(base + flat - before, base), 1)
        np.add.at(change, np.minimum(base + flat + after, end), -1)
    return np.cumsum(change[:-1]) > 0


def _extended(text, window, period):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                if part["__at"].null_count == part.num_rows:
                    continue
                words = Words(part[text])
                starts = _spans(words, part["__at"], period - 1, 1) & words.fits(window)
                pick = np.flatnonzero(starts)
                if len(pick):
                    hashes = words.hashes()
                    keys = [windows(hashes, window)[pick], windows(hashes, window, _OTHER)[pick]]
                    which = words.text_of()[pick]
                    yield _told(keys, np.asarray(part["__row"])[which], pick - words.first[which], _first(part)[which])

    return run


def _cut(text, window, names):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part[text])
                copied = np.asarray(part["__first"].is_valid()) & (words.count >= window)
                gone = _spans(words, part["__at"], 0, window) | copied[words.text_of()]
                before = np.concatenate([[0], np.cumsum(gone)])
                removed = before[words.first[1:]] - before[words.first[:-1]]
                data, kept = words.data.tobytes(), []
                for i, n in enumerate(removed):
                    tokens = data[words.offsets[i] : words.offsets[i + 1]].split()
                    if n:
                        tokens = [w for w, g in zip(tokens, gone[words.first[i] : words.first[i + 1]], strict=True) if not g]
                    kept.append(b" ".join(tokens))
                new = [pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.record_batch([*(part[c] for c in names), *new], names=[*names, "n_words", "n_removed", "kept_text"])

    return run
