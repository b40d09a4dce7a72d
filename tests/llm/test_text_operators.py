"""Operators on texts against plain versions of what they compute."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from dossier.llm import license_scan, lm_scoring, shared
from dossier.llm.decontamination import contamination
from dossier.llm.packing import best_fit, pack
from dossier.llm.simhash_dedup import components, deduplicated, linked, near_duplicates
from dossier.llm.substring_dedup import COVERS, remove_repeats
from dossier.llm.textops import Words, windows


def words_of(text):
    return (text or "").encode().split()


def test_words_and_windows(odd):
    texts = [*odd, "The  the\tTHE\x0bx"]
    words = Words(pa.array(texts, pa.string()))
    assert words.count.tolist() == [len(words_of(t)) for t in texts]
    data = words.data.tobytes()
    assert [data[s:e] for s, e in zip(words.start, words.end, strict=True)] == [w for t in texts for w in words_of(t)]
    hashes = Words(pa.array(["a b a b a"])).hashes()
    two = windows(hashes, 2)
    assert two[0] == two[2] and two[1] == two[3] and two[0] != two[1]


def test_covers_meet_every_pair_of_places():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- substring dedup ----------------------------------------------------------------------------


def cut(texts, window):
    """Kept words of each text: every window is a tuple that is counted."""
    tokens = [words_of(t) for t in texts]
    count = collections.Counter(tuple(t[i : i + window]) for t in tokens for i in range(len(t) - window + 1))
    out = []
    for t in tokens:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if count[tuple(t[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(t), sum(gone), b" ".join(w for w, g in zip(t, gone, strict=True) if not g).decode()))
    return out


@pytest.mark.parametrize("window", [35, 10, 1])
def test_remove_repeats(make_docs, prose, odd, window):
    passage = prose(60, 1)
    texts = [f"{prose(i * 3, i)} {passage} {prose(i, -i - 1)}" for i in range(12)]
    texts += [passage, passage, prose(34, 5), prose(200, 6), prose(200, 6), prose(50, 7) + " " + prose(50, 7), "a " * 300, *odd]
    texts += [f"{prose(9, 90 + i)} {' '.join(passage.split()[i : i + 35])} {prose(9, 95 + i)}" for i in range(3)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(make_docs(texts), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts, window)


def test_remove_repeats_of_repeated_rows_and_nothing(make_docs, prose):
    text = prose(40, 1)
    rows = remove_repeats(make_docs([text, text, "b"], ids=[1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.kept_text, r.row, r.score) for r in rows) == [(0, 0, "b", "x", 7), (1, 40, "", "x", 7), (1, 40, "", "x", 7)]
    assert remove_repeats(make_docs([])).count() == 0


# --- SimHash --------------------------------------------------------------------------------------


def fingerprint(text):
    tokens = (text or "").encode().lower().split()
    grams = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups_of(nodes, near):
    """The smallest member of the component of each node."""
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {n: root(n) for n in nodes}


def test_near_duplicates(make_docs, prose, odd):
    texts = [prose(30, i // 3) + " " + prose(i % 3, i) for i in range(30)] + [prose(400, 77), prose(400, 77) + " x"] + odd
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    expected = groups_of(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    rows = near_duplicates(make_docs(texts)).collect()
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in rows} == {i: (prints[i], expected[i]) for i in prints}
    assert sorted(r.doc_id for r in deduplicated(make_docs(texts)).collect()) == sorted(set(expected.values()))


def test_near_duplicates_of_repeated_and_null_ids(make_docs):
    rows = near_duplicates(make_docs(["a b c d", "a b c d", "a b c d", "z"], ids=[5, 5, None, None])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert deduplicated(make_docs(["a b", "a b", "a b"], ids=[5, 5, None])).count() == 1
    assert near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("cell", [8192, 4])
def test_links_of_crowded_fingerprints(spark, cell):
    """A ball of fingerprints around one centre, with cells split and not split."""
    r, values = random.Random(3), set()
    for centre in (0, r.getrandbits(64), 2**64 - 1):
        values.add(centre)
        for _ in range(60):
            values.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(1, 6))}))
    values = sorted(values)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    links = linked(spark.createDataFrame([(signed(v),) for v in values], "fp long"), cell=cell)
    got = {r.node: r.root for r in components(links).collect()}
    assert {signed(v): got.get(signed(v), signed(v)) for v in values} == groups_of([signed(v) for v in values], lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)


# --- decontamination ------------------------------------------------------------------------------


def test_contamination(make_docs, spark, prose, odd):
    items = [prose(20, 1), prose(33, 2), prose(33, 2), "only three words", prose(25, 3)]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ")], "item_id long, text string")
    near = items[1].split()
    near[16] = "changed"
    far = [w if i % 3 else "no" for i, w in enumerate(items[4].split())]
    texts = [f"{prose(40, 10)} {items[0].upper()} {prose(9, 11)}", prose(300, 12), " ".join([prose(5, 13), *near, prose(7, 14)]), "x only  three words y", " ".join(far), *odd]

    def best(text, item):
        t, q = words_of((text or "").lower()), words_of(item.lower())
        n = len(q)
        bag = lambda w: collections.Counter(tuple(w[i : i + min(5, n)]) for i in range(n - min(5, n) + 1))
        values = []
        for i in range(len(t) - n + 1):
            a, b = bag(t[i : i + n]), bag(q)
            values.append((sum((a & b).values()) / sum((a | b).values()), -i))
        return max(values, default=(0.0, 0))

    expected = {(i, j): (v, -at) for i, t in enumerate(texts) for j, q in enumerate(items) for v, at in [best(t, q)] if v >= 0.7}
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in contamination(make_docs(texts), bench, similarity=0.7).collect()}
    assert got == expected and {(0, 0), (2, 1), (2, 2), (3, 3)} == set(expected)
    assert contamination(make_docs(texts), bench.limit(0)).count() == 0
    assert contamination(make_docs([]), bench).count() == 0


def test_contamination_of_texts_shorter_than_the_item(make_docs, spark, prose, odd):
    item = prose(50, 1)
    bench = spark.createDataFrame([(0, item), (1, "only three words")], "item_id long, text string")
    words = item.split()
    texts = [" ".join(words[:-1]), " ".join(words[1:-1]), " ".join(words[:30]), prose(49, 2), "only three", *odd]
    rows = contamination(make_docs(texts), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity, r.first_word, r.n_words) for r in rows) == [(0, 0, 45 / 46, 0, 49), (1, 0, 44 / 46, 0, 48)]


# --- packing ----------------------------------------------------------------------------------------


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(4)
    pieces = sorted(((r.randrange(0, 60), r.randrange(-1, 5), r.randrange(-1, 9)) for _ in range(400)), reverse=True)
    bins, offsets = best_fit(*zip(*pieces, strict=True), 100)
    state = []  # words, sources, clusters
    for (size, source, cluster), b, offset in zip(pieces, bins, offsets, strict=True):
        fits = [(100 - w - size, i) for i, (w, s, c) in enumerate(state) if w + size <= 100 and source not in s and cluster not in c]
        if fits:
            assert b == min(fits)[1] and offset == state[b][0]
        else:
            assert b == len(state) and offset == 0
            state.append([0, set(), set()])
        state[b][0] += size
        state[b][1] |= {source} - {-1}
        state[b][2] |= {cluster} - {-1}


def test_pack_keeps_every_word_once(make_docs, prose, odd):
    texts = [prose(n, n) for n in (5, 99, 100, 101, 250, 250, 1000)] + odd
    texts[5] = texts[4]
    docs = make_docs(texts, source=["hot" if i % 2 else None for i in range(len(texts))])
    rows = pack(docs, capacity=100, pool=7).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.bin_id].append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(p.n_words for p in pieces) == len(words_of(t)) and [p.first_word for p in pieces] == [100 * k for k in range(len(pieces))]
    for held in by_bin.values():
        assert sum(r.n_words for r in held) <= 100
        spans = sorted((r.bin_offset, r.n_words) for r in held)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        named = [source[r.doc_id] for r in held if source[r.doc_id]]
        assert len(named) == len(set(named)) and len({texts[r.doc_id] or "" for r in held}) == len(held)
    assert pack(make_docs([])).count() == 0


# --- language model ---------------------------------------------------------------------------------


def test_scores_sum_the_words_and_beat_them(make_docs, prose, odd):
    phrase = "the quick brown fox jumps"
    texts = [f"{phrase} {prose(i % 5, i)} {phrase}" for i in range(80)] + odd
    docs = make_docs(texts)
    from dossier.llm.queries import held_out

    rows = {r.doc_id: r for r in lm_scoring.score(docs, held_out("doc_id", 5, 1)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, t in tokens.items() if not out[i] for w in t)
    total, distinct = sum(c.values()), len(c)
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (out[i], len(t), sum(w in c for w in t), total)
        assert rows[i].base_score == pytest.approx(base)
    assert sum(r.score for r in rows.values() if r.held_out) > 0.6 * sum(r.base_score for r in rows.values() if r.held_out)
    assert lm_scoring.score(make_docs([]), held_out("doc_id", 5, 1)).count() == 0


class PlainTree:
    """The suffix tree over words themselves, without hashes: dictionaries of runs of words. None is the end of a text."""

    def __init__(self, texts):
        rows = [self.tokens(t) for t in texts]
        words = collections.Counter(w for row in rows for w in row)
        self.mass = sum(words.values()) + 0.5 * (len(words) + 1)
        self.words, self.kept, self.rest = words, {}, {}
        seen, chance = {(w,): c for w, c in words.items()}, {(w,): self.alone(w) for w in words}
        for n in range(1, lm_scoring.DEPTH + 1):
            runs = collections.Counter(tuple(row[i : i + n + 1]) for row in rows for i in range(len(row) - n))
            after = collections.defaultdict(dict)
            for run, c in runs.items():
                if c >= 2 and seen.get(run[:-1], 0) >= 5 and run[1:] in chance:
                    after[run[:-1]][run] = c
            longer = {}
            for context, entries in after.items():
                kept = {run: (c - 0.75) / seen[context] for run, c in entries.items()}
                rest = 1 - sum(kept.values())
                mixed = {run: k + rest * chance[run[1:]] for run, k in kept.items()}
                gain = sum(c * math.log(mixed[run] / chance[run[1:]]) for run, c in entries.items())
                gain += (seen[context] - sum(entries.values())) * math.log(max(rest, 1e-12))
                state = gain >= 10 and gain >= 0.01 * seen[context]
                if state:
                    self.rest[context] = rest
                    self.kept.update(kept)
                longer.update(mixed if state else {run: chance[run[1:]] for run in kept})
            seen, chance = {run: runs[run] for run in longer}, longer

    @staticmethod
    def tokens(text):
        return [*(text or "").lower().split(), None]

    def alone(self, word):
        return (self.words.get(word, 0) + 0.5) / self.mass

    def after(self, before, word):
        p = self.alone(word)
        for n in range(1, min(len(before), lm_scoring.DEPTH) + 1):
            context = tuple(before[len(before) - n :])
            if context in self.rest:
                p = self.kept.get((*context, word), 0.0) + self.rest[context] * p
        return p

    def score(self, text):
        row = self.tokens(text)
        return sum(math.log10(self.after(row[max(0, i - lm_scoring.DEPTH) : i], w)) for i, w in enumerate(row))


def test_every_distribution_of_the_tree_sums_to_one(make_docs, prose):
    """The chances of all words, of the end and of an unknown word, after each context; the operator's scores are the tree's."""
    texts = ["one two one four " * 5 + prose(6, i) for i in range(40)]
    tree = PlainTree(texts)
    assert {len(context) for context in tree.rest} >= {1, 2}
    for before in ("", "one", "one two", "four one", "two one", "zzz"):
        assert sum(tree.after(before.split(), w) for w in [*tree.words, "unseen"]) == pytest.approx(1.0)
    assert tree.after(["one"], "two") > tree.alone("two")
    new = ["one two one four", "", "two one unseen one two", None, "zzz one two one"]
    rows = {r.doc_id: r.score for r in lm_scoring.score(make_docs(texts + new), F.col("doc_id") >= len(texts)).collect()}
    assert [rows[i] for i in range(len(rows))] == pytest.approx([tree.score(t) for t in texts + new])


# --- licenses -----------------------------------------------------------------------------------------


def test_license_scan(make_docs, odd):
    texts = [
        "x CC-BY y\nall  RIGHTS reserved. cc by",
        "Licensed under the Apache License, Version 2.0.",
        "licensed under apache license version 2",  # six of eight words are too few
        "licensed under the apache license version 2",
        "under the mit license\nreleased",  # in two blocks
        "scc by cc byx general public\nlicense",
        *odd,
    ]
    rows = {r.doc_id: r for r in license_scan.scan(make_docs(texts)).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].last_word) == (9, 3, 1, 7)
    assert (rows[0].base_labels, rows[0].labels, rows[0].score) == ("cc-by,reserved", "cc-by,reserved", 1.0)
    assert (rows[1].base_labels, rows[1].labels, rows[1].score) == ("", "apache-2.0", 1.0)
    assert (rows[2].labels, rows[2].score) == ("", 0.0) and (rows[3].labels, rows[3].score) == ("apache-2.0", 0.875)
    assert rows[4].labels == "mit" and rows[4].score == 0.8
    assert (rows[5].n_base, rows[5].first_word, rows[5].base_labels) == (1, 4, "gpl")
    assert [rows[i].n_words for i in range(6, 9)] == [0, 0, 0] and rows[6].first_word is None
    assert license_scan.scan(make_docs([])).count() == 0


def test_license_notices_wrapped_over_lines(make_docs, prose):
    bsd = license_scan.TEMPLATES["bsd"].replace(" with or", "\n * with or")
    grant = license_scan.TEMPLATES["mit-grant"].replace(" to any", "\n# to any")
    words = license_scan.TEMPLATES["bsd"].split()
    texts = [
        bsd,
        f"{prose(90, 1)}\n{prose(31, 2)}\n// {grant}\n{prose(70, 3)}\n\nx",
        bsd.replace("\n", "\n \n"),  # a blank line ends a paragraph
        "\n".join(f"{w} {prose(9, i)}" for i, w in enumerate(words)),  # too far apart
        f"released under\nthe license\n{prose(3, 4)}",
        "released under the\nmit license",
    ]
    rows = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(make_docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == [("bsd", 1.0), ("mit-grant", 1.0), ("", 0.0), ("", 0.0), ("mit", 0.8), ("mit", 1.0)]


def test_kept_text_is_hashed_as_utf8(make_docs):
    row = remove_repeats(make_docs(["é  ü"])).first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == hashlib.sha256("é ü".encode()).hexdigest()


def test_what_is_learned_does_not_depend_on_the_size_of_the_corpus(spark, make_docs, monkeypatch):
    """A phrase told ten times among 1.2 million other tokens: more than the shares 1e-5 and 1e-6 let pass. All scores are
    those of the plain tree, whether values go with the tasks or are joined."""
    import numpy as np

    r = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in r.zipf(1.3, 4000) % 3000) for _ in range(300)]
    texts += [f"w{i} amber birds circle distant elms w{i + 1}" for i in range(10)] + ["amber birds circle distant elms", None]
    out = F.col("doc_id") >= 310
    tree = PlainTree(texts[:310])
    wanted = [tree.score(t) for t in texts]
    for near in (lm_scoring.NEAR, 1e-3):
        monkeypatch.setattr(lm_scoring, "NEAR", near)
        rows = {r.doc_id: r for r in lm_scoring.score(make_docs(texts), out).collect()}
        assert [rows[i].score for i in range(len(texts))] == pytest.approx(wanted)
        assert rows[310].score > 0.5 * rows[310].base_score


def test_scoring_leaves_no_tables_behind_that_nothing_reads(spark, make_docs, prose, tmp_path, monkeypatch):
    """Words, values, texts and the sums joined to them stay; what the tree was made of is gone."""
    from dossier.llm.queries import held_out

    monkeypatch.setattr(shared, "folder", lambda spark: str(tmp_path))
    docs = make_docs([prose(60, i % 7) for i in range(60)])
    rows = lm_scoring.score(docs, held_out("doc_id", 5, 1))
    assert len(list(tmp_path.iterdir())) <= 4 + lm_scoring.PASSES
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert sum(r.score - r.base_score for r in rows.collect()) > 0


def test_hashes_of_grams_are_those_of_the_joins(spark):
    values = np.array([0, 1, 2**63, 2**64 - 1, 12345678901234567], np.uint64)
    pairs = [(int(a), int(b)) for a in values.view(np.int64) for b in values.view(np.int64)]
    want = [r[0] for r in spark.createDataFrame(pairs, "i long, j long").select(F.xxhash64("i", "j")).collect()]
    first, second = (np.array(x, np.int64).view(np.uint64) for x in zip(*pairs, strict=True))
    assert lm_scoring.paired(first, second).view(np.int64).tolist() == want
