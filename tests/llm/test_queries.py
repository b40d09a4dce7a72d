"""The registered queries: those with SQL against it, all by their contract's columns."""

import duckdb
import numpy as np
import pytest
from check import compare, connect

from dossier.llm.license_scan import TEMPLATES
from dossier.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_simhash_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_embedding_whitening": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13_bpe_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(name, spark, sf):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_come_first(name, spark, sf):
    wanted = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    df = QUERIES[name](spark, sf)
    assert df.dtypes[: len(wanted)] == wanted
    documents = duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert df.count() == documents or name in ("op6_nearest_neighbours", "op12_embedding_whitening")


def test_recall_on_the_test_table(spark):
    """Against brute force over all rows of a table."""
    sf = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{sf}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, values = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {}
    for r in QUERIES["op6_nearest_neighbours"](spark, sf).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    hits = 0
    for q, got in found.items():
        distance = np.sqrt(((values - values[ids == q]) ** 2).sum(axis=1))
        distance[ids == q] = np.inf
        hits += len({v for _, v in got} & set(ids[np.lexsort((ids, distance))[:10]].tolist()))
        assert [k for k, _ in sorted(got)] == list(range(1, 11))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)
    print("recall", hits / (10 * len(found)))


def test_wrapped_notices_agree_with_sql(spark, tmp_path):
    """Notices over lines, words far apart, notices a word a line, blank lines with white space in them."""
    bsd, grant = (TEMPLATES[k].split() for k in ("bsd", "mit-grant"))
    far = [w + " z" * 40 for w in bsd[:18]]
    texts = ["intro\n\n" + " ".join(bsd[:9]) + "\n" + " ".join(bsd[9:]) + "\n\nrest", "x " * 50 + "\n" + " ".join(grant[:8]) + "\n" + " ".join(grant[8:]) + "\n" + "y " * 70]
    texts += [None, "", " ".join(far[:9]) + "\n" + " ".join(far[9:]), "\n".join(bsd), "Released under\nthe MIT License", "a\n \t\nb\nc", " ".join(bsd)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["op9_license_scan"](spark, str(tmp_path))
    assert compare(found, con, ORACLES["op9_license_scan"]) is None
    assert {r.doc_id: r.labels for r in found.collect() if r.labels} == {0: "bsd", 1: "mit-grant", 5: "bsd", 6: "mit", 8: "bsd"}
