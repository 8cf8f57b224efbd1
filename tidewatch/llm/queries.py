"""The registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, codes, line_dedup, main_text, merkle, ngram_join, packing, pii, simhash, substring, topk, toxicity, warc
from tidewatch.llm.common import same_session_zone, table
from tidewatch.session import settle

QUERIES = {}
ORACLES = {}


def query(fn):  # type: ignore[no-untyped-def]
    QUERIES[fn.__name__] = same_session_zone(fn)
    return fn


@query
def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf, "embeddings"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op6_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, 1 + least(len(q.w), len(c.w))), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe.decode(bpe.encode(table(spark, sf, "documents"), file), file)
    return bpe.digests(back)


@query
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    index = warc.write_archives(warc.plan(table(spark, sf, "pages")))
    return warc.read_records(index, payload=False).drop("url")


ORACLES["op5_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op9_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Also within_radius: how many other documents lie within the radius, exact copies included, for ids divisible by 50."""
    found = settle(simhash.compare_edited(table(spark, sf, "documents")), "op9")
    asked = found.where(F.col("doc_id") % 50 == 0)
    counted = asked.join(simhash.others_within(asked, found), "fingerprint").select("doc_id", "fingerprint", F.col("others").alias("within_radius"))
    return found.join(counted.distinct(), ["doc_id", "fingerprint"], "left").select(*found.columns, "within_radius")


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op7_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(pii.find_spans(table(spark, sf, "documents")))


@query
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    kept = substring.remove_repeats(docs, substring.repeated_spans(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document, how many go as similar to earlier ones, and a digest of the rest. Lines of any length take part."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    kept = line_dedup.drop_lines(docs, line_dedup.removed_lines(docs, least=1), number_col="n_removed")
    return kept.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's leaf and proof; rows whose crc32 of the id is divisible by 5 are checked with their text in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = merkle.manifest(table(spark, sf, "documents"), claims={"text": F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))})
    root = F.lit(made.root).cast("string")
    return made.audit().select(
        F.col("id").cast("long").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified")
    )


def _merkle_sql(levels: int = 5, top_levels: int = 2) -> str:
    """Trees of up to 16 ** levels rows a source and 16 ** top_levels sources, level by level."""
    field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bit = "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    byte = f"list_reduce(list_prepend(xor(acc, c), CAST([0,0,0,0,0,0,0,0] AS BIGINT[])), lambda a, i: {bit})"
    codes = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda acc, c: {byte}), 4294967295)"
    out = [
        f"base AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('t')} AS claim FROM (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS t FROM documents))",
        "n0 AS (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS d FROM base)",
        "f0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, '' AS proof, claim AS folded FROM base)",
    ]

    def rise(k: int, nodes: str, keyed: str, group: str) -> list[str]:
        """Level k of ``nodes`` to k + 1, and the proofs with it."""
        same = f"n.g IS NOT DISTINCT FROM f.{group}"
        return [
            f"c{keyed}{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {nodes}{k})",
            f"{nodes}{k + 1} AS (SELECT g, p // 16 AS p, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d FROM c{keyed}{k} GROUP BY g, p // 16)",
            f"r{keyed}{k} AS (SELECT g, p // 16 AS run, any_value(m) AS m, list(d ORDER BY p) AS ds FROM c{keyed}{k} GROUP BY g, p // 16)",
            f"{keyed}{k + 1} AS (SELECT f.* REPLACE (f.p // 16 AS p, proof || CASE WHEN n.m > 1 THEN array_to_string(ds[:f.p % 16], '') || array_to_string(ds[f.p % 16 + 2:], '') ELSE '' END AS proof,"
            f" CASE WHEN n.m > 1 THEN sha256(array_to_string(ds[:f.p % 16], '') || folded || array_to_string(ds[f.p % 16 + 2:], '')) ELSE folded END AS folded) FROM {keyed}{k} f JOIN r{keyed}{k} n ON {same} AND n.run = f.p // 16)",
        ]

    for k in range(levels):
        out += rise(k, "n", "f", "source")
    out += [
        f"t0 AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, d FROM n{levels})",
        f"u0 AS (SELECT f.* REPLACE (t.p AS p), t.d AS subroot, 0 AS g0 FROM f{levels} f JOIN t0 t ON t.source IS NOT DISTINCT FROM f.source)",
    ]
    for k in range(top_levels):
        out += rise(k, "t", "u", "g0")
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.d AS verified FROM u{top_levels} JOIN t{top_levels} t ON true"


ORACLES["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    made = codes.compress(table(spark, sf, "embeddings"))
    return made.rows.select("vec_id", "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 2) -> str:
    """Every part against every entry in each round; 16 parts of equal length, 64 entries."""
    out = [
        """kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        "pieces AS (SELECT r, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] AS w FROM kept, range(16) t(p))",
        "b0 AS (SELECT p, r - 1 AS e, w FROM pieces WHERE r <= 64)",
    ]
    for k in range(rounds + 1):
        out.append(
            f"a{k} AS (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT x.r, x.p, b.e, "
            f"CAST(list_sum(list_transform(range(1, len(x.w) + 1), lambda i: (x.w[i] - b.w[i]) * (x.w[i] - b.w[i]))) AS BIGINT) AS d FROM pieces x JOIN b{k} b USING (p)) GROUP BY r, p)"
        )
        if k < rounds:
            sums = f"SELECT p, best.e AS e, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM pieces JOIN a{k} USING (r, p), range(1, 1025) t(i) WHERE i <= len(w) GROUP BY p, best.e, i"
            # s // n cuts towards zero; the floor is one less where that is above the mean
            out.append(f"m{k} AS (SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS w FROM ({sums}) GROUP BY p, e)")
            out.append(f"b{k + 1} AS (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{k} b LEFT JOIN m{k} m USING (p, e))")
    out += [
        f"coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)",
        f"sha AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return f"WITH {', '.join(out)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT codebooks_sha256 FROM sha) AS codebooks_sha256 FROM coded JOIN kept USING (r)"


ORACLES["op12_vector_codes"] = _codes_sql()


@query
def op13_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return main_text.extract(pages, main_text.train(pages))
