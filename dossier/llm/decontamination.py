"""Benchmark decontamination: windows of an item's size are compared with the item by SimHash, then exactly.

For each item length, windows of that many words slide over every text; a text that is shorter than the item is one
window as a whole. A window is fingerprinted if it has so
many shingles that occur in any item that the wanted similarity is possible at all (a sound bound, one cumulative
sum a text). Fingerprints are looked up in a multi-index: 64 bits in eight blocks, and an item stands in a block's
list under every value within ``radius // 8`` bits of its own, so by the pigeonhole principle no item within
``radius`` bits is missed. What is found is verified by weighted Jaccard similarity of the shingle multisets.

The benchmark is the stated query set: it is taken in blocks of bounded size, each sent to all tasks, and every
block reads the texts once. There is no shuffle, whatever the number of copies of a passage.
"""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from .textops import Words, slices, windows

BLOCK_ITEMS, BLOCK_CHARS = 10_000, 8_000_000  # of the benchmark that are sent at once
PARTS = 8  # blocks of the multi-index, of eight bits each
CHUNK = 1024  # windows that are fingerprinted at once


def contamination(docs, benchmark, id="doc_id", text="text", item="item_id", item_text="text", similarity=0.8, shingle=5, radius=23):
    """(``id``, ``item``, ``similarity``, ``first_word``, ``n_words``): the best window of each text for each item it holds.

    Words are lower-cased (ASCII) runs of non-blanks. An item of fewer than ``shingle`` words is one shingle. Ties
    go to the first window. Null or empty texts and items match nothing; equal items are reported one by one, and
    repeated rows give repeated results. ``radius`` is in bits and below 24; at a similarity of 0.8 the expected
    distance is 9 bits with a standard deviation below 3, so the default loses about one pair in a million.
    """
    shape = f"`{id}` {docs.schema[id].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, similarity double, first_word long, n_words long"
    texts, out = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), None
    for block in _blocks(benchmark.select(F.col(f"`{item}`").alias("id"), F.col(f"`{item_text}`").alias("text")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))):
        found = texts.mapInArrow(_search(Items(block, shingle, radius), similarity, shape), shape)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], shape) if out is None else out


def _blocks(items):
    block, chars = [], 0
    for row in items.toLocalIterator():
        if block and (len(block) == BLOCK_ITEMS or chars + len(row.text) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((row.id, row.text))
        chars += len(row.text)
    if block:
        yield block


class Items:
    """The index of a block of items."""

    def __init__(self, rows, shingle, radius):
        import pyarrow as pa

        self.shingle, self.radius, self.ids = shingle, radius, [r[0] for r in rows]
        words = Words(pa.array([r[1] for r in rows], pa.string()), lower=True)
        hashes = words.hashes()
        self.bags, prints, by_length = [], [], {}
        for i, (lo, hi) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            shingles = windows(hashes[lo:hi], min(shingle, hi - lo))
            self.bags.append(Counter(shingles.tolist()))
            prints.append(simhash(shingles[None, :])[0])
            by_length.setdefault(int(hi - lo), []).append(i)
        self.prints = np.array(prints, np.uint64)
        self.groups = {n: np.array(g) for n, g in sorted(by_length.items())}
        # shingles by their size in words: items shorter than a shingle have shingles of their own
        self.known = {}
        for n, g in self.groups.items():
            self.known.setdefault(min(n, shingle), []).extend(k for i in g for k in self.bags[i])
        self.known = {n: np.unique(np.array(k, np.uint64)) for n, k in self.known.items()}
        within = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= radius // PARTS
        self.lists = {n: [[g[within[value, _part(self.prints[g], p)]] for value in range(256)] for p in range(PARTS)] for n, g in self.groups.items()}

    def near(self, length, fingerprint):
        """The items of this length within the radius."""
        found = np.unique(np.concatenate([lists[int(_part(fingerprint, p))] for p, lists in enumerate(self.lists[length])]))
        return found[np.bitwise_count(self.prints[found] ^ fingerprint) <= self.radius]


def _part(fingerprints, p):
    return (fingerprints >> np.uint64(8 * p)) & np.uint64(255)


def simhash(shingles):
    """The fingerprint of each row of shingle hashes: bits that are set in over half of them."""
    n, size = shingles.shape
    bits = np.unpackbits(np.ascontiguousarray(shingles).astype(">u8").view(np.uint8).reshape(n, size, 8), axis=2)
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > size, axis=1).view(">u8").ravel().astype(np.uint64)


def similar(a, b):
    """Weighted Jaccard similarity of two bags."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _search(items, similarity, shape):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(shape))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                best = search(items, part["text"], similarity)
                if best:
                    ids = part["id"].take(pa.array([k[0] for k in best], pa.int64()))
                    rest = zip(*((items.ids[k[1]], v[0], -v[1], v[2]) for k, v in best.items()), strict=True)
                    yield pa.record_batch([ids, *(pa.array(c, f.type) for c, f in zip(rest, list(schema)[1:], strict=True))], names=schema.names)

    return run


def search(items, texts, similarity):
    """{(text, item): (similarity, -first word, words)} of all pairs that are similar enough."""
    words, best = Words(texts, lower=True), {}
    hashes, grams = words.hashes(), {}
    for size, known in items.known.items():
        keys = windows(hashes, size)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        grams[size] = keys, np.concatenate([[0], np.cumsum(known[at] == keys)])
    which = words.text_of()
    last = words.first[1:]
    for length in items.groups:
        size = min(length, items.shingle)
        keys, hits = grams[size]
        m = length - size + 1
        if len(keys) < m or hits[-1] == 0:
            continue
        need = int(np.ceil(2 * similarity / (1 + similarity) * m - 1e-9))
        starts = np.flatnonzero(hits[m:] - hits[:-m] >= max(need, 1))
        starts = starts[starts + length <= last[which[starts]]]
        for i in range(0, len(starts), CHUNK):
            some = starts[i : i + CHUNK]
            rows = keys[some[:, None] + np.arange(m)]
            for start, shingles, mark in zip(some.tolist(), rows, simhash(rows), strict=True):
                _meet(items, length, mark, shingles, similarity, int(which[start]), (int(words.first[which[start]] - start), length), best)
    if items.shingle not in grams:
        return best
    # texts as a whole, with the items that are longer
    keys, hits = grams[items.shingle]
    m = words.count - items.shingle + 1
    some = np.flatnonzero((m > 0) & (words.count < max(items.groups)))
    held = hits[words.first[some] + m[some]] - hits[words.first[some]]
    for text in some[held >= np.maximum(1, np.ceil(2 * similarity / (1 + similarity) * m[some] - 1e-9))].tolist():
        first, own, count = int(words.first[text]), int(m[text]), int(words.count[text])
        shingles = keys[first : first + own]
        mark = simhash(shingles[None, :])[0]
        for length in items.groups:
            if length > count and (length - items.shingle + 1) * similarity <= own + 1e-9:
                _meet(items, length, mark, shingles, similarity, text, (0, count), best)
    return best


def _meet(items, length, mark, shingles, similarity, text, place, best):
    """Keeps a window of a text for each item of a length that it is similar enough to, if it is the best so far."""
    found = items.near(length, mark)
    if len(found):
        bag = Counter(shingles.tolist())
        for item in found.tolist():
            value = (similar(bag, items.bags[item]), *place)
            if value[0] >= similarity and value > best.get((text, item), (0.0,)):
                best[text, item] = value
