"""The Merkle manifest, whitening and the BPE codec against plain versions of them."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossier.llm import bpe, merkle, whitening
from dossier.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest -----------------------------------------------------------------------------


def plain_tree(leaves):
    """The root and for each leaf the siblings of every level."""
    row, paths = list(leaves), [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(row) > 1:
        for k, path in enumerate(paths):
            i = at[k]
            run = range(i // 8 * 8, min(i // 8 * 8 + 8, len(row)))
            path.append(("".join(row[j] for j in run if j < i), "".join(row[j] for j in run if j > i)))
            at[k] = i // 8
        row = [sha("".join(row[i : i + 8])) for i in range(0, len(row), 8)]
    return row[0], paths


def plain_manifest(rows):
    """rows: (group, order, leaf); the root and sorted (group, leaf, subroot, siblings)."""
    groups = {}
    for g, o, leaf in rows:
        groups.setdefault(g, []).append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    root, tops = plain_tree([trees[g][0] for g in names])
    found = [(g, leaf, trees[g][0], path + tops[k]) for k, g in enumerate(names) for (*_, leaf), path in zip(sorted(groups[g]), trees[g][1])]
    return root, sorted(map(str, found))


def manifest_rows(manifest):
    return sorted(str((r["name"], r["leaf"], r["subroot"], [(s["left"], s["right"]) for s in r["siblings"]])) for r in manifest.proofs().collect())


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_a_plain_tree(spark, height):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "b", "b", None, "é", ""]), None if i % 50 == 0 else i) for i in range(650)]
    rows += [("b", 3)] * 5 + [(f"z{j}", 10**6) for j in range(70)]
    rows = [(g, o, sha(f"{g}{o}")) for g, o in rows]
    df = spark.createDataFrame(rows, "lang string, doc_id long, h string").repartition(5)
    manifest = merkle.Manifest(df, F.col("h"), keep=[F.col("lang").alias("name"), F.lit("x").alias("Leaf")], height=height)
    root, wanted = plain_manifest(rows)
    assert manifest.root == root and manifest_rows(manifest) == wanted
    told = manifest.proofs().select(merkle.folded(F.col("leaf"), F.col("siblings")).alias("f"), merkle.folded(F.sha2(F.lit("other"), 256), F.col("siblings")).alias("g"))
    assert {(x.f == root, x.g == root) for x in told.distinct().collect()} == {(True, False)}


@pytest.mark.parametrize("sizes", [[1], [8], [9], [64, 65], [513, 1]])
def test_manifest_of_round_numbers(spark, sizes):
    rows = [(f"g{k}", i, sha(f"{k} {i}")) for k, n in enumerate(sizes) for i in range(n)]
    manifest = merkle.Manifest(spark.createDataFrame(rows, "lang string, doc_id long, h string"), F.col("h"), keep=[F.col("lang").alias("name")])
    root, wanted = plain_manifest(rows)
    assert manifest.root == root and manifest_rows(manifest) == wanted


def test_empty_manifest(spark, make_docs):
    manifest = merkle.Manifest(make_docs(["a"]).filter("false"), merkle.leaf())
    assert manifest.root is None and manifest.proofs().count() == 0


def test_leaf_takes_nulls_and_long_texts(make_docs, odd):
    docs = make_docs([*odd, "ä" * 300_000])
    for r in docs.select("*", merkle.leaf().alias("leaf")).collect():
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)]
        assert r.leaf == sha("".join(parts))


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_every_node_has_a_place_and_parts_lie_together(levels):
    places = np.concatenate([merkle.place(levels, d, np.arange(8**d)) for d in range(levels)])
    assert sorted(places.tolist()) == list(range(merkle.size(levels)))
    top = levels // 2
    if top:  # the parts below the cut are whole runs, one after the other
        below = levels - top
        for number in (0, 8**top - 1):
            part = np.concatenate([merkle.place(levels, top + d, np.arange(number * 8**d, (number + 1) * 8**d)) for d in range(below)])
            assert part.min() == merkle.size(top) + number * merkle.size(below) and part.max() - part.min() + 1 == merkle.size(below)


# --- whitening -----------------------------------------------------------------------------------


def vectors(spark, values):
    return spark.createDataFrame([(i, v, "w") for i, v in enumerate(values)], "vec_id long, embedding array<float>, WHITENED string").repartition(3)


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(1)
    x = (r.normal(size=(400, 6)) @ r.normal(size=(6, 6)) + r.normal(size=6)).astype(np.float32)
    odd = [None, [], [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0] * 5]
    values = [*x.tolist(), *x[:3].tolist(), *odd]
    rows = vectors(spark, values)
    model = whitening.fit(rows, components=4)
    whole = np.floor(64 * np.concatenate([x, x[:3]]).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(whole), whole.sum(0)
    centred = whole - sums / n
    covariance = centred.T @ centred / n
    assert model.n == n and model.sums == sums.tolist()
    np.testing.assert_allclose(model.covariance, covariance, rtol=1e-9, atol=1e-9 * np.abs(covariance).max())
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    np.testing.assert_allclose(model.explained, e / np.trace(covariance), rtol=1e-9)
    made = whitening.whiten(rows, model)
    assert made.columns == ["vec_id", "embedding", "whitened", "deviation"]
    got = made.orderBy("vec_id").collect()
    assert [g.vec_id for g in got] == list(range(n))
    np.testing.assert_allclose(np.abs([g.whitened for g in got]), np.abs(centred @ v / np.sqrt(e)), atol=1e-8)
    assert [g.deviation for g in got] == ((n * whole - sums) ** 2).sum(1).tolist()
    assert whitening.identity_error(made, model) < 1e-9


def test_squares_are_exact_when_they_are_large():
    y = np.array([[2**40, -(2**40), 3], [2**40 - 1, 5, 2**39]], np.int64)
    rows = y.astype(object)
    wanted = [int((rows[:, i] ** 2).sum()) if i == j else int(((rows[:, i] + rows[:, j]) ** 2).sum()) for i in range(3) for j in range(i, 3)]
    assert whitening._squares(y) == wanted and whitening._squares(y // 2**30) != wanted


def test_whitening_without_scale(spark):
    """Constant dimensions have no component; no vector, no model."""
    model = whitening.fit(vectors(spark, [[1.0, 2.0, float(i)] for i in range(5)]))
    assert len(model.values) == 1 and model.explained == [1.0]
    assert len(whitening.fit(vectors(spark, [[1.0, 2.0]] * 4)).values) == 0
    empty = vectors(spark, [None, []])
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    large = vectors(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]])
    assert [r.deviation for r in whitening.whiten(large, whitening.fit(large)).collect() if r.vec_id != 2] == [None, None]


# --- BPE -----------------------------------------------------------------------------------------

LETTERS = [*"aBéΣςßİ \n　1漢かが՗՘Ᲊ!\x00\x1c​", "é", "'s", "'T", "٣", "\U0001f600", "\U00010d50", "<|endoftext|>", "<|startoftext|>", "<|", "..."]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_codec_equals_the_library(spark, library, odd, prose):
    r = random.Random(1)
    texts = ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += [*odd, prose(400_000, 5), "ab" * 3000 + " " + "qzj" * 5000, "a\n" * 700_000, "<|endoftext|>" * 3]
    docs = spark.createDataFrame([(i, t, "e", "d") for i, t in enumerate(texts)], "doc_id long, text string, IDS string, Decoded string").repartition(3)
    codec = bpe.codec(docs, VOCABULARY, most=300)
    coded = codec.encode(docs)
    decoded = codec.decode(coded)
    assert decoded.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = decoded.collect()
    assert sorted(g.doc_id for g in got) == list(range(len(texts)))
    for g in got:
        ids = library.encode(texts[g.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(g.ids, "<u4").tolist() == ids and g.n_tokens == len(ids)
        assert g.decoded == library.decode(ids, skip_special_tokens=False)


def test_registered_codec_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_bpe_codec"](spark, sf).collect()
    assert len(got) == len(texts)
    for g in got:
        ids = library.encode(texts[g.doc_id], add_special_tokens=False).ids
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_tables_without_words(spark, make_docs):
    docs = make_docs([None, ""])
    codec = bpe.codec(docs, VOCABULARY)
    assert [(r.n_tokens, r.decoded) for r in codec.decode(codec.encode(docs)).collect()] == [(0, "")] * 2
    assert codec.encode(docs.filter("false")).count() == 0


def test_automaton_is_minimal_and_holds_its_words_alone(tmp_path):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(1, 7))).encode() for _ in range(600)})
    lexicon = [(w, [r.randrange(5) for _ in range(r.randint(1, 4))]) for w in words]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.Transducer.compiled(lexicon).to_bytes())
    mapped = bpe.Transducer.mapped(path)
    others = [b"", b"zz", *(w + b"a" for w in words), *(w[:-1] for w in words)]
    asked = [*words, *others]
    found, ids, bounds = mapped.look_up(asked)
    known = dict(lexicon)
    for i, w in enumerate(asked):
        assert found[i] == (w in known)
        assert ids[bounds[i] : bounds[i + 1]].tolist() == known.get(w, [])


def test_equal_endings_share_their_states():
    """With equal ids the automaton is that of the words alone: {a, b, c} x {walking, talking} needs one state a depth."""
    words = sorted(a + b for a in (b"a", b"b", b"c") for b in (b"walking", b"talking"))
    made = bpe.Transducer.compiled([(w, [1, 2]) for w in words])
    assert len(made.last_at) == 9 and len(made.arc) == 3 + 2 + 6 and made.ids.tolist() == [1, 2]


def test_ids_go_towards_the_root():
    made = bpe.Transducer.compiled([(b"ab", [7, 1]), (b"ac", [7, 2]), (b"acd", [7])])
    found, ids, bounds = made.look_up([b"ab", b"ac", b"acd", b"a"])
    assert found.tolist() == [True, True, True, False]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[7, 1], [7, 2], [7], []]


def test_words_are_merged_alike_alone_and_in_step(library):
    with open(VOCABULARY, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    r = random.Random(4)
    words = ["".join(r.choice("etaoinshé") for _ in range(r.randint(1, 30))).encode() for _ in range(500)]
    words += [b"z", b"a" * bpe.WORD_BYTES, b"e"]
    in_step = vocabulary.merged_all(words)
    assert in_step == [vocabulary.merged(w) for w in words] == [library.encode(w.decode()).ids for w in words]
    assert vocabulary.merged_all([]) == []
