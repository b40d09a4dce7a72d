"""The registered queries of the operators: thin calls over whole tables, with SQL where it can say the same."""

from pyspark.sql import functions as F

from . import ann, bpe, language_id, license_scan, lm_scoring, toxicity, whitening
from .decontamination import contamination
from .merkle import Manifest, folded, leaf, proof_text
from .packing import pack
from .simhash_dedup import near_duplicates
from .substring_dedup import remove_repeats
from .warc import derive, responses

QUERIES, ORACLES = {}, {}


def _query(build):
    QUERIES[build.__name__] = build
    return build


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_substring_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT r, i, md5(string_agg(word, ' ') OVER f) AS k, count(*) OVER f AS n FROM w
      WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM g WHERE n = 35) WHERE c > 1),
marks AS (SELECT w.r, w.i, w.word, max(rep.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
          FROM w LEFT JOIN rep ON w.r = rep.r AND w.i = rep.i),
s AS (SELECT r, count(*) AS n, count_if(gone) AS m, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marks GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""


@_query
def op2_decontamination(spark, sf_dir):
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id", 5, 0))
    model = toxicity.learned(docs.filter(~F.col("held_out")), labels)
    judged = toxicity.judge(docs, model)
    return judged.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentence", "sentence_score")


@_query
def op5_simhash_dedup(spark, sf_dir):
    groups = near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op7_warc_derivatives(spark, sf_dir):
    return derive(responses(_table(spark, sf_dir, "pages")), keys=["page_id"])


@_query
def op8_best_fit_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"))


@_query
def op10_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    network = language_id.learned(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.drop("lang"), network).select("doc_id", "held_out", "lang_pred", "score")


@_query
def op3_lm_scoring(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, held_out("doc_id", 5, 1))


@_query
def op6_nearest_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 100 = 0"))


@_query
def op9_license_scan(spark, sf_dir):
    return license_scan.scan(_table(spark, sf_dir, "documents"))


ORACLES["op9_license_scan"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS (SELECT r, i, CASE WHEN ws[i+1] = 'cc' AND ws[i+2] = 'by' THEN 'cc-by'
                             WHEN ws[i+1] = 'general' AND ws[i+2] = 'public' AND ws[i+3] = 'license' THEN 'gpl'
                             WHEN ws[i+1] = 'all' AND ws[i+2] = 'rights' AND ws[i+3] = 'reserved' THEN 'reserved' END AS label
           FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM d)),
base AS (SELECT r, count(*) AS n, min(i) AS f, max(i) AS l, list(DISTINCT label) AS labels FROM places WHERE label IS NOT NULL GROUP BY r),
t AS (SELECT label, list_distinct(words) AS words, len(words) AS length FROM (SELECT label, regexp_extract_all(lower(notice), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
      FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in license_scan.TEMPLATES.items())}) AS v(label, notice))),
lines AS (SELECT r, list_distinct(regexp_extract_all(lower(line), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
hits AS (SELECT r, label, len(list_intersect(lines.words, t.words)) / len(t.words) AS share FROM lines, t
         WHERE len(list_intersect(lines.words, t.words)) >= ceil(len(t.words) * 8 / 10.0)),
parts AS (SELECT r, unnest(regexp_split_to_array(text, '\n[ \t\r\x0B\f]*\n')) AS part FROM d),
wide AS (SELECT r, regexp_extract_all(lower(part), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM parts WHERE contains(trim(part, chr(10)), chr(10))),
over AS (SELECT r, label, t.words, list_max(list_transform(range(0, len(ws), length), lambda i: len(list_distinct(list_intersect(ws[i+1:i+2*length], t.words))))) AS n
         FROM wide, t WHERE len(list_distinct(list_intersect(ws, t.words))) >= ceil(len(t.words) * 8 / 10.0)),
wrapped AS (SELECT r, label, n / len(words) AS share FROM over WHERE n >= ceil(len(words) * 8 / 10.0)),
every AS (SELECT r, label, share FROM hits UNION ALL SELECT r, label, share FROM wrapped ANTI JOIN hits USING (r, label)),
own AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM every GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""


@_query
def op11_merkle_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = leaf(change=lambda name: F.translate(name, letters, letters.lower()) if name == "text" else F.col(name))
    altered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    manifest = Manifest(docs, leaf(), keep=["doc_id", F.when(altered, lowered).otherwise(leaf()).alias("given")])
    proofs = manifest.proofs()
    told = proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text("siblings"), 256).alias("proof_sha256"), folded(F.col("given"), F.col("siblings")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_levels(tree, levels):
    """SQL of the levels above ``tree``0 (g, i, h, total): a node with its siblings, and the level that its runs of eight make."""
    for k in range(levels):
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
        yield f"""{tree}s{k} AS (SELECT g, i, total > 1 AS several, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                   coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{k})"""
        yield f"""{tree}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN total > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (total + 7) // 8 AS total
                   FROM {tree}{k} GROUP BY g, i // 8, total)"""


def _merkle_folds(start, tree, levels, to):
    """SQL of the way up from ``start`` (row, g, i, proof, node): siblings join the proof and the node becomes their hash."""
    for k in range(levels):
        source = start if k == 0 else f"{to}{k}"
        yield f"""{to}{k + 1} AS (SELECT a.row, a.g, a.i // 8 AS i, CASE WHEN several THEN proof || l || r ELSE proof END AS proof,
                   CASE WHEN several THEN sha256(l || node || r) ELSE node END AS node
                   FROM {source} a JOIN {tree}s{k} b ON a.g IS NOT DISTINCT FROM b.g AND a.i = b.i)"""


def _merkle_sql(levels=8, top_levels=4):
    """Up to 8 ** levels rows a group and 8 ** top_levels groups; CRC32 is counted bit by bit."""

    def hashed(text):
        fields = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"

    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE {shift} END), 4294967295)"
    parts = [
        f"d AS (SELECT doc_id, lang AS g, {hashed('text')} AS h, {hashed(small)} AS changed, {crc} % 3 = 0 AS altered FROM documents)",
        """o AS (SELECT *, row_number() OVER (ORDER BY g NULLS FIRST, doc_id NULLS FIRST, h) AS row, count(*) OVER (PARTITION BY g) AS total,
              row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d)""",
        "t0 AS (SELECT g, i, h, total FROM o)",
        *_merkle_levels("t", levels),
        f"top AS (SELECT g AS name, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS total FROM t{levels})",
        "u0 AS (SELECT 0 AS g, i, h, total FROM top)",
        *_merkle_levels("u", top_levels),
        "a0 AS (SELECT row, g, i, '' AS proof, CASE WHEN altered THEN changed ELSE h END AS node FROM o)",
        *_merkle_folds("a0", "t", levels, "a"),
        f"b0 AS (SELECT a.row, 0 AS g, top.i, a.proof, a.node FROM a{levels} a JOIN top ON a.g IS NOT DISTINCT FROM top.name)",
        *_merkle_folds("b0", "u", top_levels, "b"),
    ]
    return f"""WITH {", ".join(parts)}
        SELECT o.doc_id, o.h AS leaf, top.h AS subroot, u{top_levels}.h AS root, sha256(b.proof) AS proof_sha256, b.node AS folded_root, b.node = u{top_levels}.h AS verified
        FROM o JOIN b{top_levels} b USING (row) JOIN top ON o.g IS NOT DISTINCT FROM top.name, u{top_levels}"""


ORACLES["op11_merkle_manifest"] = _merkle_sql()


VOCABULARY = "word_bpe_49k.json"


@_query
def op12_embedding_whitening(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    made = whitening.whiten(rows, model).drop("embedding")
    error = whitening.identity_error(made, model) if model else None
    explained = F.array(*(F.lit(v) for v in (model.explained if model else []))).cast("array<double>")
    each = made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


@_query
def op13_bpe_codec(spark, sf_dir, vocabulary=None):
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    codec = bpe.codec(docs, vocabulary or public_tokenizers.path(VOCABULARY))
    decoded = codec.decode(codec.encode(docs, keep=["doc_id"]))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(key, parts, part):
    """Whether a row is held out: by the CRC32 of its key as text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts)) == part
