"""The registered queries of the corpus operators, one for each, and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievecraft.llm import bpe, divergence, exact_dedup, html_extract, langid, line_dedup, merkle, mixing, pii, quality, search, simhash, substring_dedup
from sievecraft.session import table

try:
    import public_tokenizers
except ModuleNotFoundError:  # the place of the vocabulary is a parameter
    public_tokenizers = None

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of documents."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of documents; the vocabulary's place and the pattern are parameters."""
    ranks = bpe.read_ranks(path or public_tokenizers.path(VOCABULARY))
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, pattern or public_tokenizers.PATTERN, with_ids=False)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents."""
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of documents."""
    docs = table(spark, sf_dir, "documents")
    out = langid.identify_languages(docs.select("doc_id", "text"), langid.fit_language_models(docs))
    held = (quality.remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return out.select("doc_id", held, "lang_pred", F.col("lang_score").alias("score"), "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, doc_id, score: the ten best documents for every document whose id is divisible by 100."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(search.build_index(docs), docs.where("doc_id % 100 = 0"), k=10).withColumn("score", F.round("score", 6))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of documents."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank: distances of every two sources of a language and the terms that mark each."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_line_dedup, op4_quality, op5_bpe, op6_substring_dedup, op7_language, op8_mixing, op9_html, op10_search, op11_pii, op12_divergence, op13_manifest)}

OP1 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST) AS keep_id,
  first_value(n_cp) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST) AS best_n FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND n_cp = best_n) AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP3 = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM base),
w AS (SELECT r, doc_id, line, pos, regexp_extract_all(regexp_replace(line, '[^\x20\x09-\x0D0-9]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS w FROM l),
p AS (SELECT *, len(w) AS n, (len(w) - 2) // 4 AS a, 2 * (len(w) - 2) // 4 AS b, 3 * (len(w) - 2) // 4 AS c, len(w) - 2 AS m FROM w WHERE len(w) >= 3),
q AS (SELECT *, [0, a, b, c, m] AS cut, array_to_string(w[1:2], chr(31)) AS lead, [array_to_string(w[3 : 2 + a], chr(31)), array_to_string(w[3 + a : 2 + b], chr(31)), array_to_string(w[3 + b : 2 + c], chr(31)), array_to_string(w[3 + c : n], chr(31))] AS part FROM p),
pairs AS (SELECT i, j FROM range(1, 5) x(i), range(1, 5) y(j) WHERE j >= i),
k AS (
  SELECT r, doc_id, pos, concat_ws(chr(30), n, 0, array_to_string(w, chr(31))) AS key FROM p
  UNION ALL SELECT r, doc_id, pos, concat_ws(chr(30), n, 10 * i + j, lead, CASE WHEN i <> 1 THEN part[1] ELSE '' END, CASE WHEN 2 NOT IN (i, j) THEN part[2] ELSE '' END, CASE WHEN 3 NOT IN (i, j) THEN part[3] ELSE '' END, CASE WHEN j <> 4 THEN part[4] ELSE '' END) AS key
  FROM q, pairs WHERE cut[i + 1] > cut[i] AND cut[j + 1] > cut[j] AND cut[i + 1] - cut[i] + CASE WHEN j > i THEN cut[j + 1] - cut[j] ELSE 0 END <= floor(0.5 * n + 1e-9)),
t AS (SELECT key, min(doc_id) AS first FROM k GROUP BY key HAVING count(DISTINCT r) >= 3),
gone AS (SELECT DISTINCT r, pos FROM k JOIN t USING (key) WHERE k.doc_id > t.first OR (k.doc_id IS NULL AND t.first IS NOT NULL)),
kept AS (SELECT l.r, string_agg(line, chr(10) ORDER BY l.pos) AS kept, count(*) AS n_kept FROM l ANTI JOIN gone ON l.r = gone.r AND l.pos = gone.pos GROUP BY l.r)
SELECT b.doc_id, len(string_split(b.text, chr(10)))::BIGINT AS n_lines, (len(string_split(b.text, chr(10))) - coalesce(n_kept, 0))::BIGINT AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM base b LEFT JOIN kept ON b.r = kept.r
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, i AS pos, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 12, 0) + 1)) AS i FROM d)),
f AS (SELECT win, min(doc_id) AS first FROM p GROUP BY win HAVING count(*) > 1),
late AS (SELECT DISTINCT r, pos FROM p JOIN f USING (win) WHERE doc_id > first),
gone AS (SELECT DISTINCT r, pos + j AS pos FROM (SELECT r, pos, unnest(range(0, 13)) AS j FROM late)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM s),
w AS (SELECT *, CASE s % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS w, 2 * source_size AS cap FROM o),
r AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM w) - coalesce(sum(cap) OVER q, 0)::BIGINT) / ((SELECT sum(w)::BIGINT FROM w) - coalesce(sum(w) OVER q, 0)::BIGINT) AS rate
  FROM w WINDOW q AS (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN rate > cap / w THEN cap::DOUBLE ELSE (SELECT max(rate) FROM r) * w END AS target FROM r),
g AS (SELECT *, least(floor(target + 1e-6), cap)::BIGINT AS goal FROM t),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.goal,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(key, 1, 3), key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (greatest(least(a + size, goal) - a, 0) + greatest(least(a + source_size + size, goal) - a - source_size, 0))::BIGINT AS taken FROM p
"""

OP10 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
k AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t),
c AS (SELECT doc_id, dl, term, count(*) AS tf FROM k GROUP BY ALL),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t),
f AS (SELECT term, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM c, n GROUP BY term, n),
s AS (SELECT q.doc_id AS query_id, c.doc_id, round(sum(idf * c.tf * 2.2 / (c.tf + 1.2 * (0.25 + 0.75 * c.dl / avgdl))), 9) AS score
  FROM (SELECT DISTINCT doc_id, term FROM c WHERE doc_id % 100 = 0) q JOIN c USING (term) JOIN f USING (term), n GROUP BY q.doc_id, c.doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, round(score, 6) AS score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""

OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(ln)::BIGINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (s.total + 5 * v.v))::BIGINT AS p, 1 + (1000000000::HUGEINT * (k.ln + 5) // (v.total + 5 * v.v))::BIGINT AS q
  FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN far USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 50
"""


def manifest_sql(source_levels: int = 6, root_levels: int = 4) -> str:
    """Levels are written out: sources of up to 16^6 rows, up to 16^4 sources. A level whose group has one node is passed on."""
    framed = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    fields = [framed(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = framed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    # crc32 without a table: -1 shifts by a bit, another number is a byte to take in.
    steps = "list_concat([4294967295], flatten(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda j: [ord(substr(doc_id::VARCHAR, j, 1)), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
    parts = [
        f"leaves AS (SELECT doc_id, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, leaf, coalesce(changed, leaf) AS start FROM "
        f"(SELECT doc_id, source, sha256(concat({', '.join([*fields, framed('text')])})) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256(concat({', '.join([*fields, lowered])})) END AS changed FROM documents))",
        "s0 AS (SELECT g, n, i, leaf AS h FROM leaves)",
    ]
    up = lambda t, k: f"{t}{k + 1} AS (SELECT g, (n + 15) // 16 AS n, i // 16 AS i, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {t}{k} GROUP BY g, n, i // 16)"
    parts += [up("s", k) for k in range(source_levels)]
    parts.append(f"r0 AS (SELECT 0 AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS source FROM s{source_levels})")
    parts += [up("r", k) for k in range(root_levels)]
    parts.append(f"f0 AS (SELECT leaves.doc_id, leaf, s{source_levels}.h AS subroot, (SELECT h FROM r{root_levels}) AS root, leaves.g, leaves.i, r0.i AS ri, start AS f, '' AS proof FROM leaves JOIN s{source_levels} ON s{source_levels}.g IS NOT DISTINCT FROM leaves.g JOIN r0 ON r0.source IS NOT DISTINCT FROM leaves.g)")
    at = 0
    for t, levels, group, place in (("s", source_levels, "g", "i"), ("r", root_levels, "0", "ri")):
        for k in range(levels):
            kids = f"(SELECT g, i // 16 AS up, any_value(n) AS n, list(h ORDER BY i) AS kids FROM {t}{k} GROUP BY g, i // 16)"
            pos = f"({place} // {16**k}) % 16"
            left, right = f"array_to_string(kids[1 : {pos}], '')", f"array_to_string(kids[{pos} + 2 : 16], '')"
            parts.append(f"f{at + 1} AS (SELECT doc_id, leaf, subroot, root, f{at}.g, f{at}.i, ri, CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof FROM f{at} JOIN {kids} k ON k.g IS NOT DISTINCT FROM {'f' + str(at) + '.g' if group == 'g' else '0'} AND k.up = {place} // {16 ** (k + 1)})")
            at += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{at}"


ORACLES = {"op1_exact_dedup": OP1, "op3_line_dedup": OP3, "op6_substring_dedup": OP6, "op8_mixing": OP8, "op10_search": OP10, "op12_divergence": OP12, "op13_manifest": manifest_sql()}
