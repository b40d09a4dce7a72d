"""A training corpus from raw documents, in stages that each work on all that the one before kept."""

from pyspark.sql import functions as F

from dossier.llm import language_id
from dossier.llm.decontamination import contamination
from dossier.llm.packing import pack
from dossier.llm.queries import held_out
from dossier.llm.shared import by_place, named, numbered, stored
from dossier.llm.simhash_similar import distinct_documents
from dossier.llm.substring_dedup import remove_repeats


def languages(spark, docs, sf_dir):
    """Rejects documents without a language (null or no letter). The network learns from the rows of three folds; if none
    of them has a language there is no network, and every text with a letter stays."""
    rows, names = by_place(docs)
    network = language_id.learned(docs.filter(~held_out("doc_id", 4, 2)))
    judged = language_id.identify(rows, network, text=names["text"])
    known = F.col(names["text"]).rlike(r"\p{L}") if network is None else F.col("lang_pred") != language_id.UNKNOWN
    return named(judged.filter(known), names)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each component of texts whose five-word shingles are similar to 0.8 or more."""
    return distinct_documents(docs, shingle=5, similarity=0.8)


def substrings(spark, docs, sf_dir):
    """Removes repeated passages of 35 words and more; a document of which nothing is left goes."""
    rows, names = by_place(docs)
    cut = remove_repeats(rows, text=names["text"], window=35).filter("n_removed = 0 or kept_text <> ''")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return named(cut.withColumns({names[c]: F.when(F.col("n_removed") > 0, v).otherwise(F.col(names[c])) for c, v in new.items()}), names)


def benchmarks(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    rows, names = by_place(docs)
    keyed = numbered(rows)
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id="__row", text=names["text"]).select("__row").distinct()
    return named(keyed.join(stored(found), "__row", "left_anti"), names)


def packing(spark, docs, sf_dir):
    """Places every piece of every document in a sequence of 2048 words."""
    return pack(docs, capacity=2048)


STAGES = [
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmarks),
    ("best-fit packing", packing),
]

#: SQL cannot express the network, the fingerprints and the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage; each stage is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
