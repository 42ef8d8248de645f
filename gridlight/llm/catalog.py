"""The registered queries of the operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlight.llm import ann, contamination, fim, html_text, lines, near, pii, pitman_yor, resampling, secret_scan, tokenize, toxicity, warc
from gridlight.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"
# Pseudonyms of the registered query can be reversed by anyone who reads this; a deployment passes a key of its own.
EXAMPLE_KEY = b"an example key for the registered query"


def held_out_quarter():
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    return tokenize.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside ten-word windows of benchmark items."""
    found = contamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


ORACLES["op10_decontamination"] = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS win
        FROM item, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(i) WHERE len(ws) > 0),
doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
hits AS (SELECT d.doc_id, d.i, d.n, w.item_id
         FROM (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
               FROM doc, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(ws) - n + 2)) t(i)) d JOIN win w ON w.win = d.win AND w.n = d.n),
words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words w ON w.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("uri"), F.col("html").cast("binary").alias("payload"))
    last = warc.read(warc.archived(pages), data=False).where("last")
    revisit = F.col("record_type") == "revisit"
    return last.select(F.col("key").cast("bigint").alias("page_id"), F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
                       F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"), "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"))


ORACLES["op2_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM g"""


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels of the held-out quarter are not seen."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out_quarter()))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", held_out_quarter().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal values replaced by format-preserving pseudonyms."""
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), EXAMPLE_KEY)
    return found.select("doc_id", "text", F.size("found").cast("bigint").alias("n_found"), "found")


@query
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates, links and copies of every document."""
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without later repeated runs of lines."""
    done = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("_words_removed").cast("bigint").alias("words_removed"))


@query
def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under a model of six sevenths of them."""
    rest = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    scored = pitman_yor.log10_scores(table(spark, sf_dir, "documents"), rest() != 2)
    return scored.select("doc_id", F.coalesce(rest() == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty vectors of largest inner product for every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0)).withColumnRenamed("id", "vec_id")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_ngram_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
u AS (SELECT row_number() OVER () AS k, t, any_value(ws) AS ws, min(doc_id) AS doc, count(*) AS n_copies FROM d GROUP BY t),
s AS (SELECT DISTINCT k, array_to_string(ws[i:i + 4], ' ') AS g FROM u, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) r(i) WHERE len(ws) > 0),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE c >= 0.8e0 * (a.n + b.n - c) - 1e-9),
m AS (SELECT k, doc AS r FROM u UNION SELECT l.y, m.r FROM m JOIN l ON l.x = m.k),
c AS (SELECT k, min(r) AS class_id FROM m GROUP BY k),
e AS (SELECT x AS k, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, CASE WHEN len(d.ws) = 0 THEN d.doc_id ELSE c.class_id END AS class_id, CAST(coalesce(e.n_links, 0) AS BIGINT) AS n_links,
       CAST(CASE WHEN len(d.ws) = 0 THEN 1 ELSE u.n_copies END AS BIGINT) AS n_copies
FROM d JOIN u ON u.t = d.t JOIN c ON c.k = u.k LEFT JOIN e ON e.k = u.k"""

# A line is repeated if a run of three lines around it stands earlier, or if it has 20 words and stands earlier, or if it is one
# of two neighbours that such a long line has in common with its first place.
ORACLES["op5_line_dedup"] = """
WITH raw AS (SELECT doc_id, text, string_split(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1)) AS us FROM documents),
x AS (SELECT doc_id, i, us[i] AS piece, trim(us[i], ' ' || chr(9) || chr(13) || chr(10)) AS t FROM raw, unnest(range(1, len(us) + 1)) r(i)),
n AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, len(t) - len(replace(t, ' ', '')) + 1 AS w FROM x WHERE t <> ''),
k AS (SELECT *, lag(t, 2) OVER q AS a2, lag(t) OVER q AS a1, lead(t) OVER q AS b1, lead(t, 2) OVER q AS b2, (doc_id, j) AS place FROM n WINDOW q AS (PARTITION BY doc_id ORDER BY j)),
f3 AS (SELECT doc_id, j, place > min(place) OVER (PARTITION BY t, b1, b2) AS again FROM k WHERE b2 IS NOT NULL),
f1 AS (SELECT t, min(place) AS first FROM k WHERE w >= 20 GROUP BY t),
m1 AS (SELECT k.doc_id, k.j, CASE WHEN k.a1 = s.a1 AND k.a2 = s.a2 THEN 2 WHEN k.a1 = s.a1 THEN 1 ELSE 0 END AS back, CASE WHEN k.b1 = s.b1 AND k.b2 = s.b2 THEN 2 WHEN k.b1 = s.b1 THEN 1 ELSE 0 END AS fore
       FROM k JOIN f1 ON f1.t = k.t AND k.place > f1.first JOIN k s ON s.t = f1.t AND s.place = f1.first WHERE k.w >= 20),
hit AS (SELECT doc_id, j + o AS j FROM f3, (SELECT unnest([0, 1, 2]) AS o) WHERE again UNION SELECT doc_id, j + o FROM m1, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) WHERE o BETWEEN -back AND fore),
run AS (SELECT n.doc_id, n.i, n.w, n.j - row_number() OVER (PARTITION BY n.doc_id ORDER BY n.j) AS island FROM hit JOIN n ON n.doc_id = hit.doc_id AND n.j = hit.j),
gone AS (SELECT doc_id, min(i) AS a, max(i) AS b, sum(w) AS w FROM run GROUP BY doc_id, island HAVING sum(w) >= 25),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND x.i BETWEEN g.a AND g.b) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(w) AS w FROM gone GROUP BY doc_id)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL WHEN l.w IS NULL THEN r.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(l.w, 0) AS BIGINT) AS words_removed
FROM raw r LEFT JOIN kept k ON k.doc_id = r.doc_id LEFT JOIN lost l ON l.doc_id = r.doc_id"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text in fill-in-the-middle form and, from that, as it was."""
    made = fim.transformed(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(us) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: the three base kinds, and windows of high entropy."""
    spans = secret_scan.found(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return spans.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.LEAST],
                        F.sha2(secret_scan.listed(of(*secret_scan.LEAST)), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def secret_scan_sql() -> str:
    """Places by running sums over split texts; entropy of each window from a histogram of its own."""
    name = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    assign = name + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    classes = secret_scan.CLASSES
    kinds = [("assign", assign), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")] + [(c.kind, c.pattern) for c in classes]
    found = " UNION ALL ".join(f"SELECT id, {k} AS k, unnest(regexp_extract_all(t, '{p}')) AS v, unnest(string_split_regex(t, '{p}')[:-2]) AS before, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d" for k, (_, p) in enumerate(kinds))
    allowed = " OR ".join([*(f"regexp_matches(v, '{p}')" for p in secret_scan.ALLOWED), *(f"ends_with(lower(right(before, 12)), '{e}')" for e in secret_scan.ALLOWED_BEFORE)])
    tables = " ".join(f"WHEN {k + 3} THEN {c.table}" for k, c in enumerate(classes))
    most, wide = (" ".join(f"WHEN {k + 3} THEN {v(c)}" for k, c in enumerate(classes)) for v in (lambda c: c.most, lambda c: c.window))
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(kinds))
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
m AS (SELECT id, k, v, before, sum(length(before) + length(v)) OVER (PARTITION BY id, k ORDER BY i) - length(v) AS start FROM f),
base AS (SELECT id, k, start, start + length(v) AS stop FROM m
         WHERE k = 0 AND length(regexp_extract(v, '{assign}', 2)) >= 6 OR k = 1 AND length(v) >= 20 OR k = 2 AND length(v) >= 24),
w AS (SELECT id, k, start, v, CASE k {wide} END AS n FROM m WHERE k > 2 AND regexp_matches(v, '{secret_scan.MIXED}') AND NOT ({allowed})),
h AS (SELECT id, k, start + i - 1 AS a, start + i - 1 + n AS b, list_sum(list_transform(map_values(list_histogram(string_split(v[i:i + n - 1], ''))), lambda c: (CASE k {tables} END)[CAST(c AS BIGINT) + 1])) AS s
      FROM (SELECT *, unnest(range(1, length(v) - n + 2)) AS i FROM w)),
g AS (SELECT *, a > max(b) OVER (PARTITION BY id, k ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS new FROM (SELECT id, k, a, b FROM h WHERE s <= CASE k {most} END)),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY id, k ORDER BY a) AS island FROM g),
x AS (SELECT id, k, start, stop FROM base UNION ALL SELECT id, k, min(a), max(b) FROM r GROUP BY id, k, island),
o AS (SELECT id, k, start, CASE k {names} END || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM x),
z AS (SELECT id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM o GROUP BY id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z ON z.id = d.id"""


ORACLES["op12_secret_scan"] = secret_scan_sql()


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents drawn towards the benchmark's word n-grams."""
    drawn = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# The checksum of every distinct run of words is worked out byte by byte, with a table made from the polynomial.
ORACLES["op13_importance_resampling"] = r"""
WITH polynomial AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS tab FROM range(256) r(b)),
w AS (SELECT 0 AS side, row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, id, array_to_string(ws[i:i + n - 1], ' ') AS f, count(*) AS c FROM w, unnest([1, 2, 3]) k(n), unnest(range(1, len(ws) - n + 2)) t(i) GROUP BY ALL),
x AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
             lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]))) % 10000 AS bucket FROM x, polynomial),
n AS (SELECT bucket, coalesce(sum(c) FILTER (side = 0), 0) AS s, coalesce(sum(c) FILTER (side = 1), 0) AS t FROM f JOIN b USING (f) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * CAST(s_all + 10000 AS DOUBLE) / ((CAST(s AS DOUBLE) + 1) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n, a),
v AS (SELECT id, sum(c) AS n_features, sum(c * gain) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
d AS (SELECT doc_id, len(ws) AS n, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS DOUBLE) AS h
      FROM w LEFT JOIN v USING (id) WHERE side = 0),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n >= 20) AS able FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND place <= able * 5 // 100 THEN place END AS rank FROM r"""
