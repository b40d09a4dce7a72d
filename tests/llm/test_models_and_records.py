"""Neighbours, trained models, WARC derivatives and the pipeline."""

import base64
import gzip
import hashlib
import html
import json
import math
import random
import re
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm import ann, language_id, toxicity
from dossier.llm.warc import derive, html_text, responses, write_warc


# --- nearest neighbours -----------------------------------------------------------------------------


def vectors_of(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    return (centres[r.integers(0, 8, n)] + 0.6 * r.normal(size=(n, dim))).astype(np.float32)


def test_search_finds_the_nearest(spark):
    values = vectors_of(1500, 16, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = table.filter("vec_id % 50 = 0")
    got = {}
    for r in ann.search(table, asked).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 1500, 50))
    hits = 0
    wide = values.astype(float)
    for q, found in got.items():
        distance = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        assert all(s == pytest.approx(distance[i], rel=1e-12) for i, s in found.values())
        assert list(found.values()) == sorted(found.values(), key=lambda x: (x[1], x[0])) or sorted(found) == list(range(1, 11))
        distance[q] = np.inf
        hits += len({i for i, _ in found.values()} & set(np.lexsort((np.arange(1500), distance))[:10].tolist()))
    assert hits >= 0.9 * 10 * len(got)


def test_search_of_odd_vectors(spark):
    """Nulls, zeros, what is not finite, other lengths, ties, repeated ids and fewer candidates than asked for."""
    nan, inf = math.nan, math.inf
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(table, table.filter("vec_id in (0, 4, 9)")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert ann.search(table, table.limit(0)).count() == 0


# --- language identification ------------------------------------------------------------------------

SOUNDS = {"aa": "ka lo ni sa tu ve", "bb": "sch ung eit pf er zu", "cc": "ñar ción ll os que ía"}


def sentence(language, n, seed):
    r = random.Random(f"{language}{seed}")
    return " ".join("".join(r.choice(SOUNDS[language].split()) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_language_id_on_held_out_texts(make_docs, odd):
    texts = [sentence(l, 10 + i % 60, i) for i in range(60) for l in SOUNDS]
    langs = [l for _ in range(60) for l in SOUNDS]
    net = language_id.learned(make_docs(texts, lang=langs))
    fresh = [sentence(l, 3000 if i == 0 else 12, 1000 + i) for i in range(30) for l in SOUNDS]
    rows = {r.doc_id: r for r in language_id.identify(make_docs([*fresh, *odd]), net).collect()}
    right = sum(rows[i].lang_pred == list(SOUNDS)[i % 3] for i in range(len(fresh)))
    assert right >= 0.97 * len(fresh) and all(0 <= r.score <= 1 for r in rows.values())
    silent = [not any(c.isalpha() for c in t or "") for t in odd]
    assert [rows[len(fresh) + i].lang_pred == "und" for i in range(len(odd))] == silent
    assert language_id.learned(make_docs(odd, lang=[None] * len(odd))) is None
    assert {r.lang_pred for r in language_id.identify(make_docs(["abc"]), None).collect()} == {"und"}
    assert language_id.identify(make_docs([]), net).count() == 0


def test_gradients_of_the_network():
    """Against differences of the loss."""
    net = language_id.Network(["a", "b", "c"], seed=1)
    r = np.random.default_rng(2)
    x, y = r.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    net.bias += 0.5
    loss = lambda: float(-net.logits(x).astype(float)[np.arange(6), y].mean())
    for name, gradient in net.step(x, y).items():
        part = getattr(net, name)
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old, eps = part[at], 1e-2
        part[at] = old + eps
        up = loss()
        part[at] = old - eps
        down = loss()
        part[at] = old
        assert (up - down) / (2 * eps) == pytest.approx(float(gradient[at]), rel=0.05, abs=2e-3)


# --- toxicity ------------------------------------------------------------------------------------------


def test_toxicity_learns_from_labels_of_texts(make_docs, spark, prose, odd):
    bad = ["vexl", "grobel"]
    texts, marks = [], []
    for i in range(160):
        parts = [prose(6, i * 7 + k) for k in range(1 + i % 5)]
        if i % 4 == 0:
            parts.insert(i % len(parts), f"{prose(2, i)} {bad[i // 4 % 2]}{'st' * (i // 4 % 3)} {prose(2, -i)}")
        texts.append(". ".join(parts))
        marks.append((i, int(i % 4 == 0)))
    labels = spark.createDataFrame([*marks, (5, None), (None, 1)], "doc_id long, toxic int")
    docs = make_docs([*texts, *odd])
    model = toxicity.learned(docs.filter("doc_id % 5 != 0"), labels)
    rows = {r.doc_id: r for r in toxicity.judge(docs, model).collect()}
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[160].score == rows[161].score == 0 and rows[160].sentence is None
    right = [(rows[i].score >= 0.5) == bool(y) for i, y in marks if i % 5 == 0]
    assert sum(right) >= 0.9 * len(right)
    caught = [rows[i].sentence for i, y in marks if y and rows[i].score >= 0.5]
    assert all(any(b in s for b in bad) for s in caught) and len(caught) >= 30
    none = toxicity.learned(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.judge(docs, none).collect())
    assert toxicity.judge(make_docs([]), model).count() == 0


def test_toxicity_learns_from_long_texts(make_docs, spark, prose):
    """Labels lie on texts of 18,000 bytes and more only, some of them clean; and a sample of fewer bytes has all lengths."""
    texts, marks = [], []
    for i in range(60):
        parts = [prose(8, 1000 * i + k) for k in range(600 + 10 * (i % 5))]
        if i % 3 == 0:
            parts[7 * i] = f"{prose(2, i)} vexl {prose(2, -i)}"
        texts.append(". ".join(parts))
        marks.append((i, int(i % 3 == 0)))
    assert min(map(len, texts)) > 18_000
    docs, labels = make_docs(texts), spark.createDataFrame(marks, "doc_id long, toxic int")
    fold = docs.filter("doc_id % 5 != 0")
    rows = {r.doc_id: r for r in toxicity.judge(docs, toxicity.learned(fold, labels)).collect()}
    assert [(rows[i].score >= 0.5) for i, _ in marks] == [bool(y) for _, y in marks]
    some, shares = toxicity.labelled_sample(fold.union(docs.filter("doc_id = 0").selectExpr("100L doc_id", "'short' text", "lang", "source", "n_chars", "row", "score")), labels.union(spark.createDataFrame([(100, 0)], "doc_id long, toxic int")), most=300_000)
    assert 0 < len(some) < 48 and any(len(t) > 18_000 for t, _ in some)
    assert shares == {y: sum(k == y for _, k in some) / n for y, n in {0: 33, 1: 16}.items() if any(k == y for _, k in some)}


def test_noisy_or():
    words = toxicity.Bags(pa.array(["a b. c", None, "..."]))
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)
    score, strongest = model.score(words)
    p = 1 / (1 + math.exp(1))
    assert score.tolist() == pytest.approx([1 - (1 - p) ** 2, 0, 0]) and strongest.tolist()[1:] == [-1, -1]


# --- WARC ------------------------------------------------------------------------------------------------


class Visible(HTMLParser):
    """A plain reader of well-formed pages."""

    BREAKS = set("p div br hr li ul ol h1 h2 table tr td body head html title nav article".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.out.append("\n" if tag in self.BREAKS else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        self.out.append("\n" if tag in self.BREAKS else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data.replace("\n", " "))

    def text(self):
        lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<!-- no <p> --><ul><li><a href="/a?x=1&amp;y=2">one</a></li><li><a class=k HREF='b'>two</a></li></ul><p>a <b>b</b>
c&#233;<br/>d</p></body></html>"""


def test_html_text_agrees_with_a_parser():
    reader = Visible()
    reader.feed(PAGE)
    assert html_text(PAGE) == reader.text() == "T & t\none\ntwo\na b cé\nd"
    assert html_text("<p>a<script>never closed") == "a" and html_text("x<!-- y") == "x" and html_text("1 < 2") == "1 < 2"


def test_derivatives_link_back_to_their_source(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (3, "http://c/", ""), (1, "http://a/", PAGE)], "page_id long, url string, html string")
    source = {r.page_id: r for r in responses(pages).collect()}
    records = derive(responses(pages), keys=["page_id"])
    rows = records.collect()
    assert len(rows) == 8
    for r in rows:
        data = r.block.encode()
        assert r.refers_to == source[r.page_id].record_id and r.content_length == len(data)
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(source[r.page_id].payload.encode()).digest()).decode()
        other = next(x for x in rows if x.record_id == r.concurrent_to)
        assert other.concurrent_to == r.record_id and other.warc_type != r.warc_type
    meta = json.loads(next(r.block for r in rows if r.page_id == 1 and r.warc_type == "metadata"))["Envelope"]
    assert meta["WARC-Header-Metadata"]["WARC-Record-ID"] == source[1].record_id
    held = meta["Payload-Metadata"]["HTTP-Response-Metadata"]
    assert held["HTML-Metadata"] == {"Title": "T & t", "Metas": 0, "Links": ["/a?x=1&y=2", "b"]}
    assert held["Headers"]["Content-Length"] == str(len(PAGE.encode())) and held["Status"] == "HTTP/1.1 200 OK"
    # written files are read record by record, by the lengths they state
    write_warc(records, str(tmp_path / "out"))
    seen = []
    for path in Path(tmp_path / "out").glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1") and rest[n : n + 4] == b"\r\n\r\n"
            seen.append((fields["WARC-Type"], fields["WARC-Refers-To"], rest[:n].decode()))
            data = rest[n + 4 :]
    assert sorted(seen) == sorted((r.warc_type, r.refers_to, r.block) for r in rows)
    assert derive(responses(pages.limit(0))).count() == 0


def test_other_content_types(spark):
    rows = [("r1", "u", "d", "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n", "a <b>"), ("r2", "u", "d", "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n", "x"), (None, None, None, None, None)]
    made = derive(spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, http string, payload string")).collect()
    assert sorted((r.refers_to or "", r.warc_type) for r in made) == [("", "metadata"), ("r1", "conversion"), ("r1", "metadata"), ("r2", "metadata")]
    assert next(r.block for r in made if r.warc_type == "conversion") == "a <b>" and html.unescape("&lt;") == "<"


def test_repeated_headers_are_kept(spark):
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nSet-Cookie: a=1\r\nVia: x\r\nset-cookie: b=2\r\n"
    made = derive(spark.createDataFrame([("r", "u", "d", head, "")], "record_id string, target_uri string, warc_date string, http string, payload string")).collect()
    meta = json.loads(next(r.block for r in made if r.warc_type == "metadata"))["Envelope"]["Payload-Metadata"]
    assert meta["HTTP-Response-Metadata"]["Headers"] == {"Content-Type": "text/plain", "Set-Cookie": ["a=1", "b=2"], "Via": "x"}


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, prose):
    import corpus_pipeline as cp

    passage, item = prose(60, 1), prose(30, 2)
    texts = [prose(80, 10 + i) for i in range(20)]
    texts += [texts[3], None, "12 34", f"{prose(30, 50)} {passage} {prose(30, 51)}", f"{prose(30, 52)} {passage} {prose(30, 53)}", f"{prose(30, 54)} {item} {prose(20, 55)}", prose(5000, 56)]
    rows = [(i, t, "en", "s", len(t or ""), "extra", "z") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = cp.stored(out)
        kept.append({r.doc_id: r for r in docs.collect()})
    everything = set(range(len(texts)))
    assert set(kept[0]) == everything - {21, 22}
    assert set(kept[1]) == set(kept[0]) - {20}
    assert set(kept[2]) == set(kept[1]) and kept[2][23].text == f"{prose(30, 50)} {prose(30, 51)}" and kept[2][23].n_chars == len(kept[2][23].text)
    assert kept[2][0] == kept[1][0] and kept[2][23].n_words == "extra"
    assert set(kept[3]) == set(kept[2]) - {25}
    packed = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and sum(r.n_words for r in packed) == sum(len(r.text.split()) for r in kept[3].values())


def test_pipeline_keeps_texts_when_no_language_is_known(make_docs):
    import corpus_pipeline as cp

    texts = ["a plain text", "12 34", None, "", "\u00dcber", "\u4f60\u597d", "--- !"]
    docs = make_docs(texts, **{"lang": [None] * len(texts)})
    assert sorted(r.doc_id for r in cp.languages(None, docs, None).collect()) == [0, 4, 5]
