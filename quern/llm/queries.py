"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, kdtree, lm, minhash, mixing, multi_index, nbest, passages, quality, simhash, spelling, token_counts, warc
from ._scratch import new_path, table


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its shingles, its group and whether it is the one kept."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget asks, dealt into blocks in a fixed shuffled order."""
    mixture = mixing.mixture(table(spark, sf_dir, "documents"), repeats=1.5)
    return mixture.select("doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "block", "position")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the model's and the base's log10 probability of its text."""
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: its record as read back from the archives that were written."""
    folder = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found for every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.nearest(rows, rows.where("vec_id % 100 = 0"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the network's probability of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.fitted(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return rows.select("doc_id", (quality.remainder("doc_id", 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: how many words recurring passages take from it, and a digest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return passages.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its tokens under the unigram model."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its best segmentations with their scores, each decoded again."""
    return nbest.encoded(table(spark, sf_dir, "documents"), keep=["doc_id"], ids=False)


def op9_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products for every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return kdtree.top_k(rows, rows.where("vec_id % 50 = 0"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its fingerprint and its group."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a vector: its cluster after ten rounds."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a word: its count, near words, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_lm_scoring,
        op3_warc,
        op4_multi_index_search,
        op5_quality_classifier,
        op6_substring_dedup,
        op7_token_counts,
        op8_sentencepiece_nbest,
        op9_kdtree_top_k,
        op10_minhash_near_dedup,
        op11_simhash_near_dedup,
        op12_centroid_clustering,
        op13_spelling_variants,
    )
}


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and exact means, one after the other; a mean is floor(sum / count) for sums below zero too."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "f AS (SELECT v, sha256('3:' || vec_id) AS lot FROM v ORDER BY lot NULLS LAST, v LIMIT 8)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lot NULLS LAST, v) - 1 AS c, v FROM f)",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS (SELECT r, c, list_sum(list_transform(list_zip(v.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{t} AS k)")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, min((d, c)) AS m FROM d{t} GROUP BY r)")
        if t < rounds:
            steps.append(f"e{t} AS (SELECT m[2] AS c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{t} JOIN v USING (r))")
            steps.append(f"g{t} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{t} GROUP BY c, i)")
            steps.append(f"n{t} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM g{t} GROUP BY c)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT k.c, coalesce(n.v, k.v) AS v FROM c{t} AS k LEFT JOIN n{t} AS n USING (c))")
    steps.append(f"z AS (SELECT r, vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance FROM a{rounds} JOIN v USING (r))")
    return f"""WITH {", ".join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(k.v, ',')) AS centroid_sha256 FROM z JOIN c{rounds} AS k ON k.c = cluster"""


WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": rf"""
        WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS n_tokens FROM documents),
        s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t FROM d WHERE n_tokens > 0 GROUP BY 1),
        x AS (SELECT max(t) AS most, round(greatest(0, least(1, 1 - ln(1.5) / ln(max(t) / min(t)))), 6) AS a FROM s),
        q AS (SELECT source, t, CAST(floor(t * pow(t / most, a - 1)) AS BIGINT) AS quota FROM s, x),
        b AS (SELECT greatest(1, CAST(ceil(sum(quota) / 1048576) AS BIGINT)) AS nb FROM q),
        p AS (SELECT source, t, quota, greatest(1, CAST(ceil(quota / nb) AS BIGINT)) AS part FROM q, b),
        e AS (SELECT doc_id, d.source, n_tokens, t, quota, part, unnest(range(0, (quota - 1) // t + 1)) AS epoch FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE n_tokens > 0),
        l AS (SELECT *, md5(concat_ws('|', 'quern', epoch, doc_id, n_tokens)) AS lot FROM e),
        o AS (SELECT *, CAST(epoch * t + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY lot, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at FROM l),
        k AS (SELECT doc_id, source, n_tokens, epoch, begin_at // part AS block FROM o WHERE begin_at < quota)
        SELECT doc_id, source, n_tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws('|', 'quern', block, epoch, doc_id, n_tokens))) AS position FROM k""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> least THEN least END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op6_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        t AS (SELECT doc_id, r, ws, unnest(range(1, greatest(len(ws) - 34, 0) + 1)) AS i FROM w),
        h AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM t),
        a AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
        c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h SEMI JOIN a USING (h)),
        g AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
        k AS (SELECT doc_id, ws, coalesce(len(gone), 0) AS n, [ws[j] FOR j IN range(1, len(ws) + 1) IF gone IS NULL OR NOT list_contains(gone, j)] AS kept FROM w LEFT JOIN g USING (r))
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op9_kdtree_top_k": """
        WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_centroid_clustering": _lloyd(10),
    # CRC-32 byte by byte with its table of 256; near words share a pattern with one letter open, or one is the other less a letter
    "op13_spelling_variants": """
        WITH RECURSIVE t AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
        u AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
        d AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM u GROUP BY ALL),
        b AS (SELECT w, n, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, '')]) AS v FROM d),
        h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), v), lambda a, x: xor(a // 256, t[CAST(xor(a, x) % 256 AS INTEGER) + 1])), 4294967295) AS h FROM b, t),
        s AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
        k AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
        x AS MATERIALIZED (SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM k)),
        p AS (SELECT q.word, r.word AS other, r.n AS m FROM x AS q JOIN x AS r ON q.i = r.i AND q.a = r.a AND q.z = r.z AND q.word <> r.word
              UNION SELECT q.word, r.word, r.n FROM x AS q JOIN k AS r ON r.word = q.a || q.z UNION SELECT r.word, q.word, q.n FROM x AS q JOIN k AS r ON r.word = q.a || q.z),
        o AS (SELECT word, count(*) AS n_near, max(m) AS best FROM p GROUP BY 1),
        f AS MATERIALIZED (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN best >= 2 * k.n THEN (SELECT min(other) FROM p WHERE p.word = k.word AND p.m = best) END AS form, CASE WHEN best >= 2 * k.n THEN best END AS form_n FROM k LEFT JOIN o USING (word)),
        e AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, e.root FROM f JOIN e ON f.form = e.word)
        SELECT f.word, f.form, e.root, f.n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN e USING (word)""",
    "op10_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
        u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
        m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY 1)
        SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(least, s.doc_id) AS component_id, s.doc_id = coalesce(least, s.doc_id) AS kept FROM s LEFT JOIN m ON s.doc_id = m.doc_id""",
}
