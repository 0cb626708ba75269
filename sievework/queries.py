"""Registered queries of the curation operators on the driver's tables, and the same in SQL.

The tables hold texts and vectors, not images; each query exercises its operator on columns that stand for an
asset's (named in the SQL). documents and embeddings are paired by number where both are needed, an arbitrary
pairing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.config import Config
from sievework.functions import expressions as X
from sievework.operators import dedup, export, features, filters, sampling, summaries
from sievework.operators.graph import connected_components

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- scans, scalar functions ----------------------------------------------------------------------------------


@query(r"""SELECT page_id, coalesce(nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\.[^./]+)$', 1)), ''), '') AS suffix
FROM pages WHERE lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\.[^./]+)$', 1)) IN ('.html', '.php', '.jpg', '.jpeg', '.png')""")
def ext_filter(spark, d):
    path = X.url_path("url")
    return _t(spark, d, "pages").select("page_id", X.suffix(path).alias("suffix")).where(F.col("suffix").isin(".html", ".php", ".jpg", ".jpeg", ".png"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents")
def sha256_project(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.sha256_hex("text").alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))


@query("""SELECT doc_id, sha256(text) AS hex,
  substr(sha256(text), 1, 8) AS bucket_hex, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS bucket FROM documents""")
def hash_hex_codec(spark, d):
    words = X.hash_words(X.sha256_hex("text"))
    out = _t(spark, d, "documents").select("doc_id", words.alias("words"))
    bucket = X.bucket32("words")
    return out.select("doc_id", X.hash_hex("words").alias("hex"), F.lpad(F.lower(F.hex(bucket)), 8, "0").alias("bucket_hex"), bucket.alias("bucket"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents)
SELECT a.doc_id, (SELECT sum(bit_count(('0x' || substr(a.s, i, 8))::BIGINT # ('0x' || substr(b.s, i, 8))::BIGINT)) FROM (VALUES (1),(9),(17),(25),(33),(41),(49),(57)) v(i))::INT AS distance
FROM h a JOIN h b ON b.doc_id = a.doc_id + 1""".replace(" # ", " ^ ").replace("(('0x' || substr(a.s, i, 8))::BIGINT ^ ('0x' || substr(b.s, i, 8))::BIGINT)", "(xor(('0x' || substr(a.s, i, 8))::BIGINT, ('0x' || substr(b.s, i, 8))::BIGINT))"))
def hamming_256(spark, d):
    h = _t(spark, d, "documents").select("doc_id", X.hash_words(X.sha256_hex("text")).alias("h"))
    after = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return h.join(after, "doc_id").select("doc_id", X.hamming_words("h", "g", 4).cast("int").alias("distance"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*/', '') AS rel_path FROM pages WHERE regexp_matches(url, '^https?://[^/]+/')""")
def relative_path(spark, d):
    p = _t(spark, d, "pages").where(F.col("url").rlike("^https?://[^/]+/"))
    return p.select("page_id", X.relative_path(X.url_path("url"), F.regexp_extract("url", "^(https?://[^/]*)/", 1)).alias("rel_path"))


@query("""SELECT doc_id, w, h, w2 AS scaled_w, h2 AS scaled_h, least(w2, h2) AS edge,
  ((w2 - least(w2, h2)) // 2)::INT AS "left", ((h2 - least(w2, h2)) // 2)::INT AS top FROM (
  SELECT doc_id, w, h, round_even(w * greatest(300.0::DOUBLE / w, 300.0::DOUBLE / h, 1.0::DOUBLE), 0)::INT AS w2, round_even(h * greatest(300.0::DOUBLE / w, 300.0::DOUBLE / h, 1.0::DOUBLE), 0)::INT AS h2
  FROM (SELECT doc_id, (1 + doc_id * 37 % 1000)::INT AS w, (1 + doc_id * 61 % 700)::INT AS h FROM documents))""")
def crop_geometry(spark, d):
    sizes = _t(spark, d, "documents").select("doc_id", (1 + F.col("doc_id") * 37 % 1000).cast("int").alias("w"), (1 + F.col("doc_id") * 61 % 700).cast("int").alias("h"))
    return sizes.select("doc_id", "w", "h", X.crop_box("w", "h", 300).alias("box")).select("doc_id", "w", "h", "box.*")


@query(r"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN left(text, 3) ELSE (doc_id * 7 % 1000)::VARCHAR END || '.jpg' AS name FROM documents)
SELECT doc_id, name, row_number() OVER (ORDER BY n IS NULL, n, stem, name, doc_id) AS position FROM (
  SELECT *, try_cast(CASE WHEN regexp_matches(stem, '^\s*[+-]?\d+\s*$') THEN trim(stem) END AS BIGINT) AS n FROM (SELECT *, regexp_replace(regexp_replace(name, '^.*/', '', 's'), '(.)\.[^.]*$', '\1', 's') AS stem FROM s))
ORDER BY position LIMIT 400""")
def numeric_stem_order(spark, d):
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, F.left("text", F.lit(3))).otherwise((F.col("doc_id") * 7 % 1000).cast("string")), F.lit(".jpg"))
    rows = _t(spark, d, "documents").select("doc_id", name.alias("name"))
    first = rows.orderBy(*X.stem_order("name"), "doc_id").limit(400)  # the gallery's limit
    return first.withColumn("position", F.row_number().over(Window.orderBy(*X.stem_order("name"), "doc_id")).cast("bigint"))


@query("""WITH u AS (SELECT doc_id, source AS root FROM documents UNION ALL SELECT doc_id, 'lang-' || lang FROM documents)
SELECT doc_id, min(root) AS root FROM u GROUP BY doc_id""")
def union_roots(spark, d):
    """Every document is found under two roots, its source and its language."""
    docs = _t(spark, d, "documents")
    both = docs.select("doc_id", F.col("source").alias("root")).unionByName(docs.select("doc_id", F.concat(F.lit("lang-"), "lang").alias("root")))
    return both.groupBy("doc_id").agg(F.min("root").alias("root"))


# ---- filters ----------------------------------------------------------------------------------------------------

_METRICS = """(SELECT doc_id, n_chars / 10.0::DOUBLE AS sharpness, CASE WHEN doc_id % 41 <> 0 THEN (doc_id % 23)::DOUBLE END AS saturation, (doc_id % 7) / 100.0::DOUBLE AS border_frac FROM documents)"""


def _metrics(spark, d):
    return _t(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") / 10.0).alias("sharpness"), F.when(F.col("doc_id") % 41 != 0, (F.col("doc_id") % 23).cast("double")).alias("saturation"), (F.col("doc_id") % 7 / 100.0).alias("border_frac")
    )


@query(f"""SELECT doc_id, CASE WHEN sharpness < 100 THEN 'blurry' WHEN saturation <= 10 THEN 'grayscale' WHEN border_frac >= 0.03 THEN 'bordered' END AS reason FROM {_METRICS}""")
def quality_reason(spark, d):
    config = Config(min_sharpness=100.0, drop_grayscale=True, drop_bordered=True)
    return _metrics(spark, d).select("doc_id", filters.quality_reason(config).alias("reason"))


@query("SELECT doc_id, toxic = 1 AS has_person, CASE WHEN toxic = 1 THEN false ELSE quality = 0 END AS has_face, CASE WHEN toxic = 1 THEN 'person' WHEN quality = 0 THEN 'face' END AS reason FROM labels")
def detect_reason(spark, d):
    flags = filters.detection_flags(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)
    return flags.select("doc_id", "has_person", "has_face", filters.detection_reason().alias("reason"))


@query("SELECT count(*) FILTER (toxic = 1) AS people, count(*) FILTER (toxic <> 1 AND quality = 0) AS face_only, count(*) FILTER (toxic <> 1 AND quality <> 0) AS clean FROM labels")
def detection_stats(spark, d):
    return filters.detection_stats(filters.detection_flags(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0))


@query("""WITH r AS (SELECT conv_id, turn, length(text) > 200 AS wide FROM conversations)
SELECT conv_id, coalesce(min(CASE WHEN wide THEN turn END), max(turn) + 1)::BIGINT AS flat_run, count(*) AS turns FROM r GROUP BY conv_id""")
def flat_prefix_run(spark, d):
    wide = F.length("text") > 200
    run = F.coalesce(F.min(F.when(wide, F.col("turn"))), F.max("turn") + 1)
    return _t(spark, d, "conversations").groupBy("conv_id").agg(run.cast("bigint").alias("flat_run"), F.count("*").alias("turns"))


# ---- exact duplicates and representatives -------------------------------------------------------------------------


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_groups(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", X.sha256_hex("text").alias("sha256"))
    return dedup.exact_groups(docs, "sha256", "doc_id")


def _assets(spark, d):
    """Exact copies are equal in size, so size, time and sharpness here vary with the number."""
    return _t(spark, d, "documents").select("doc_id", X.sha256_hex("text").alias("sha256"), (F.col("doc_id") % 7).alias("size"), (F.col("doc_id") % 11).cast("double").alias("mtime"), (F.col("doc_id") % 5).cast("double").alias("sharpness"))


_ASSETS = "(SELECT doc_id, sha256(text) AS sha256, doc_id % 7 AS size, (doc_id % 11)::DOUBLE AS mtime, (doc_id % 5)::DOUBLE AS sharpness FROM documents)"
_ORDER = {"first": "doc_id", "largest": "size DESC, doc_id", "newest": "mtime DESC, doc_id", "oldest": "mtime, doc_id", "sharpest": "sharpness DESC, doc_id"}


def _policy(policy: str):
    def representative(spark, d):
        return dedup.representatives(_assets(spark, d), "sha256", "doc_id", policy).where("n > 1")

    representative.__name__ = f"exact_representative_{policy}"
    return query(f"SELECT sha256, first(doc_id ORDER BY {_ORDER[policy]}) AS representative, count(*) AS n FROM {_ASSETS} GROUP BY sha256 HAVING count(*) > 1")(representative)


for _p in _ORDER:
    _policy(_p)


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_survivors(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "n_chars", X.sha256_hex("text").alias("sha256"))
    return dedup.survivors(docs, "sha256", "doc_id", "first").drop("sha256")


# ---- hashes, vectors, near duplicates -----------------------------------------------------------------------------


def _signs(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", F.sort_array(F.transform("embedding", lambda x: x.cast("double"))).alias("s"))
    e = e.withColumn("median", (F.get("s", F.lit(31)) + F.get("s", F.lit(32))) / 2)
    word = F.lit(0).cast("bigint")
    for i in range(64):
        word = word.bitwiseOR(F.shiftleft((F.get("embedding", F.lit(i)).cast("double") > F.col("median")).cast("bigint"), 63 - i))
    return e.select("vec_id", word.alias("h"))


_SIGN_BITS = "list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > (list_sort(embedding)[32]::DOUBLE + list_sort(embedding)[33]::DOUBLE) / 2 THEN '1' ELSE '0' END)"
_HASHES = f"(SELECT vec_id, array_to_string({_SIGN_BITS}, '') AS bits FROM embeddings)"


@query(f"SELECT vec_id, array_to_string(list_transform(range(1, 62, 4), lambda i: printf('%x', ('0b' || substr(bits, i, 4))::INT)), '') AS hex, ('0b' || substr(bits, 1, 4))::BIGINT AS bucket FROM {_HASHES}".replace("('0b' || substr(bits, i, 4))::INT", "(8*substr(bits,i,1)::INT+4*substr(bits,i+1,1)::INT+2*substr(bits,i+2,1)::INT+substr(bits,i+3,1)::INT)").replace("('0b' || substr(bits, 1, 4))::BIGINT", "(8*substr(bits,1,1)::BIGINT+4*substr(bits,2,1)::BIGINT+2*substr(bits,3,1)::BIGINT+substr(bits,4,1)::BIGINT)"))
def sign_hash(spark, d):
    return _signs(spark, d).select("vec_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("hex"), F.shiftrightunsigned("h", 60).alias("bucket"))


_PAIRS = f"""(SELECT a.vec_id AS a, b.vec_id AS b, (SELECT count(*) FROM range(1, 65) r(i) WHERE substr(a.bits, r.i::INT, 1) <> substr(b.bits, r.i::INT, 1)) AS distance
  FROM {_HASHES} a JOIN {_HASHES} b ON substr(a.bits, 1, 4) = substr(b.bits, 1, 4) AND a.vec_id < b.vec_id)"""
_PAIRS = _PAIRS.replace("(SELECT count(*) FROM range(1, 65) r(i) WHERE substr(a.bits, r.i::INT, 1) <> substr(b.bits, r.i::INT, 1))", "hamming(a.bits, b.bits)")
_MOST = 22


@query(f"SELECT a, b, distance::INT AS distance FROM {_PAIRS} WHERE distance <= {_MOST}")
def hamming_pairs_bucketed(spark, d):
    return dedup.hamming_pairs(_signs(spark, d), "vec_id", F.array("h"), F.shiftrightunsigned("h", 60), _MOST)


def _components_sql(edges: str, more: str = "") -> str:
    """Lowest reachable node of every node of an edge."""
    return f"""WITH RECURSIVE {more} e AS MATERIALIZED (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
r(node, component) AS (SELECT a, a FROM e UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.node WHERE r.component < e.b)
SELECT node, min(component) AS component FROM r GROUP BY node"""


_CANDIDATES = f"(SELECT a, b FROM {_PAIRS} WHERE distance <= {_MOST})"


@query(_components_sql("p", f"p AS MATERIALIZED {_CANDIDATES},"))
def hash_components(spark, d):
    return connected_components(dedup.hamming_links(_signs(spark, d), "vec_id", F.array("h"), F.shiftrightunsigned("h", 60), _MOST))


_COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_LEAST = 0.40


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "embedding")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COSINE} >= {_LEAST}")
def cosine_pairs(spark, d):
    return dedup.cosine_pairs(_vectors(spark, d), "vec_id", "embedding", _LEAST).withColumn("similarity", F.round("similarity", 6))


_VERIFIED = f"""SELECT x.node AS a, y.node AS b FROM c x JOIN c y ON x.component = y.component AND x.node < y.node
JOIN embeddings a ON a.vec_id = x.node JOIN embeddings b ON b.vec_id = y.node WHERE {_COSINE} >= 0.2"""
_CLUSTERS = f"c AS MATERIALIZED (SELECT * FROM ({_components_sql('p', f'p AS MATERIALIZED {_CANDIDATES},')}))"


@query(f"WITH {_CLUSTERS} {_VERIFIED}")
def verify_in_cluster(spark, d):
    within = hash_components(spark, d)
    return dedup.cosine_pairs(_vectors(spark, d), "vec_id", "embedding", 0.2, within).select("a", "b")


@query(_components_sql("v", f"{_CLUSTERS}, v AS MATERIALIZED ({_VERIFIED}),"))
def near_groups_hash(spark, d):
    return dedup.near_groups_by_hash(_signs(spark, d), _vectors(spark, d), "vec_id", F.array("h"), F.shiftrightunsigned("h", 60), "embedding", _MOST, 0.2)


_KNN = f"""(SELECT i, j, similarity, rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, {_COSINE} AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COSINE}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5)"""


@query(f"SELECT i, j, round(similarity, 6) AS similarity, rank::INT AS rank FROM {_KNN}")
def knn_topk(spark, d):
    return dedup.blocked_neighbours(_vectors(spark, d), "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT i AS a, j AS b FROM {_KNN} WHERE i < j AND similarity >= 0.3")
def knn_edges_strict(spark, d):
    return dedup.neighbour_edges(dedup.blocked_neighbours(_vectors(spark, d), "vec_id", "embedding", 5), 0.3, strict=True)


_EDGES = f"(SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COSINE} >= {_LEAST})"
_NEAR = f"""WITH RECURSIVE p AS MATERIALIZED {_EDGES}, e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, component) AS (SELECT a, a FROM e UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.node WHERE r.component < e.b)"""


@query(_components_sql("p", f"p AS MATERIALIZED {_EDGES},"))
def near_groups_vector(spark, d):
    return dedup.near_groups_by_vector(_vectors(spark, d), "vec_id", "embedding", None, _LEAST)


@query(f"""{_NEAR}, g AS (SELECT node, min(component) AS component FROM r GROUP BY node)
SELECT component, first(node ORDER BY node % 7 DESC, node) AS representative, count(*) AS n FROM g GROUP BY component""")
def near_representative(spark, d):
    groups = near_groups_vector(spark, d).withColumn("size", F.col("node") % 7)
    return dedup.representatives(groups, "component", "node", "largest")


_SHIFTED = """(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL
SELECT -1 - vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.1 * CASE WHEN i % 2 = 1 THEN embedding[65 - i] ELSE 0 END) FROM embeddings)"""


@query(f"SELECT a.vec_id AS a, b.vec_id AS b FROM {_SHIFTED} a JOIN {_SHIFTED} b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9")
def near_pairs_lsh(spark, d):
    """Every vector and a slightly shifted copy of it, found by hash tables."""
    v = _vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    shifted = F.transform("e", lambda x, i: x + F.when(i % 2 == 0, 0.1 * F.get("e", 63 - i)).otherwise(0.0))
    rows = v.union(v.select(-1 - F.col("vec_id"), shifted))
    return dedup.lsh_pairs(rows.select("vec_id", X.normalised("e").alias("v")), "vec_id", "v", 0.9).select("a", "b")


# ---- screening ----------------------------------------------------------------------------------------------------

_ZERO = f"""SELECT a.vec_id, round(1 / (1 + exp(max(CASE WHEN b.vec_id >= 8 THEN {_COSINE} END) - max(CASE WHEN b.vec_id < 8 THEN {_COSINE} END))), 6) AS unsafe
FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id < 13) b GROUP BY a.vec_id"""


@query(_ZERO)
def zero_shot_score(spark, d):
    """The first 8 vectors stand for unsafe prompts, the next 5 for safe ones: a fixed table of 13 rows."""
    e = _vectors(spark, d)
    prompts = e.where("vec_id < 13").select((F.col("vec_id") < 8).alias("unsafe"), F.col("embedding").alias("prompt"))
    scored = e.crossJoin(F.broadcast(prompts)).withColumn("s", X.dot("embedding", "prompt"))
    best = scored.groupBy("vec_id").agg(F.max(F.when(F.col("unsafe"), F.col("s"))).alias("u"), F.max(F.when(~F.col("unsafe"), F.col("s"))).alias("v"))
    return best.select("vec_id", F.round(X.unsafe_from_similarities("u", "v"), 6).alias("unsafe"))


@query("SELECT doc_id, greatest(CASE WHEN doc_id % 3 <> 2 THEN toxic * 0.9::DOUBLE ELSE 0 END, CASE WHEN doc_id % 3 = 1 THEN (1 - quality) * 0.4::DOUBLE ELSE 0 END)::DOUBLE AS unsafe FROM labels")
def label_max_score(spark, d):
    score = lambda label, x: F.struct(label.alias("label"), x.cast("double").alias("score"))
    n = F.col("doc_id") % 3
    labels = F.array(
        score(F.when(n != 2, "NSFW").otherwise("safe"), F.col("toxic") * 0.9),
        score(F.when(n == 1, "Porn").otherwise("neutral"), (1 - F.col("quality")) * 0.4),
        score(F.lit("other"), F.lit(1.0)),
    )
    return _t(spark, d, "labels").select("doc_id", X.unsafe_from_labels(labels).alias("unsafe"))


_ROUTES = "(SELECT doc_id, CASE WHEN toxic IS NULL THEN 'skipped' WHEN toxic >= 0.5 THEN 'blocked' ELSE 'moved' END AS route FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT * FROM {_ROUTES}")
def screen_route(spark, d):
    scores = _t(spark, d, "labels").select("doc_id", F.col("toxic").cast("double").alias("score"))
    return _t(spark, d, "documents").select("doc_id").join(scores, "doc_id", "left").select("doc_id", filters.screen_route("score", 0.5).alias("route"))


@query(f"SELECT count(*) AS total, count(*) FILTER (route = 'moved') AS moved, count(*) FILTER (route = 'blocked') AS blocked, count(*) FILTER (route = 'skipped') AS skipped, 0.5::DOUBLE AS threshold, 'table' AS backend FROM {_ROUTES}")
def screen_summary(spark, d):
    return filters.screen_summary(screen_route(spark, d), 0.5, "table")


# ---- numbering, mirrors, logs --------------------------------------------------------------------------------------


@query("SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS index FROM documents")
def export_numbering(spark, d):
    return export.numbered(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""SELECT index, index || '.jpg' AS filename, source || '/' || doc_id AS original_path
FROM (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS index FROM documents) WHERE lang IS DISTINCT FROM 'de'""")
def manifest(spark, d):
    """All documents are numbered; those in one language stand for unreadable ones, which leave a gap."""
    rows = export.numbered(_t(spark, d, "documents").select("doc_id", "source", "lang"), "source", "doc_id")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return export.manifest(rows.where(~F.col("lang").eqNullSafe("de")).withColumn("path", path))


_RELS = "(SELECT doc_id, source AS root, n_chars::VARCHAR || '.jpg' AS rel_path, lang IS NOT DISTINCT FROM 'de' AS unkept FROM documents)"


def _rels(spark, d):
    """Texts of equal length share a name; those in one language are in the mask."""
    return _t(spark, d, "documents").select("doc_id", F.col("source").alias("root"), F.concat(F.col("n_chars").cast("string"), F.lit(".jpg")).alias("rel_path"), F.col("lang").eqNullSafe("de").alias("unkept"))


@query(f"SELECT doc_id, root, rel_path FROM {_RELS} WHERE rel_path NOT IN (SELECT rel_path FROM {_RELS} WHERE unkept)")
def export_mask(spark, d):
    rows = _rels(spark, d)
    return export.masked(rows, rows.where("unkept")).select("doc_id", "root", "rel_path")


@query(f"SELECT doc_id, root, rel_path FROM {_RELS} WHERE (root || '|' || rel_path) NOT IN (SELECT root || '|' || rel_path FROM {_RELS} WHERE unkept)")
def export_mask_by_root(spark, d):
    rows = _rels(spark, d)
    return export.masked(rows, rows.where("unkept"), by_root=True).select("doc_id", "root", "rel_path")


@query(r"""WITH w AS (SELECT doc_id, (doc_id % 50)::VARCHAR || CASE WHEN doc_id % 11 = 3 THEN ' (' || (1 + doc_id % 4) || ').jpg' ELSE '.jpg' END AS dst FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY doc_id) - 1 AS k FROM w),
f AS (SELECT dst, n, row_number() OVER (PARTITION BY dst ORDER BY n) AS k FROM (SELECT dst, unnest(range(1, max(k) + 6)) AS n FROM r GROUP BY dst)
  WHERE regexp_replace(dst, '\.jpg$', ' (' || n || ').jpg') NOT IN (SELECT dst FROM w))
SELECT doc_id, r.dst, CASE WHEN r.k = 0 THEN r.dst ELSE regexp_replace(r.dst, '\.jpg$', ' (' || n || ').jpg') END AS final FROM r LEFT JOIN f ON f.dst = r.dst AND f.k = r.k""")
def collision_names(spark, d):
    """Some rows ask for names that look like those which others would be given."""
    end = F.when(F.col("doc_id") % 11 == 3, F.concat(F.lit(" ("), (1 + F.col("doc_id") % 4).cast("string"), F.lit(").jpg"))).otherwise(".jpg")
    return export.collision_free(_t(spark, d, "documents").select("doc_id", F.concat((F.col("doc_id") % 50).cast("string"), end).alias("dst")), "dst", "doc_id")


@query(f"""WITH a AS (SELECT doc_id AS src, 'dst' || doc_id AS dst, sha256(text) AS sha256 FROM documents),
e AS (SELECT CASE WHEN lang = 'en' THEN 'dst' ELSE 'other' END || doc_id AS dst, sha256(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS have FROM documents)
SELECT src, dst, CASE WHEN have IS NULL THEN 'copy' WHEN have = sha256 THEN 'skip' ELSE 'rename' END AS action FROM a LEFT JOIN e USING (dst)""")
def mirror_plan(spark, d):
    """All documents are there already, those in one language under the same name, some with other bytes."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("src"), F.concat(F.lit("dst"), F.col("doc_id").cast("string")).alias("dst"), "text", "lang")
    name = F.concat(F.when(F.col("lang") == "en", "dst").otherwise("other"), F.col("src").cast("string"))
    there = docs.select(name.alias("dst"), X.sha256_hex(F.when(F.col("src") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("sha256"))
    return export.mirror_plan(docs.withColumn("sha256", X.sha256_hex("text")).drop("text", "lang"), there).select("src", "dst", "action")


_OUTCOMES = f"""(WITH RECURSIVE m AS (SELECT * FROM {_METRICS}),
q AS (SELECT doc_id, text, toxic, quality, CASE WHEN sharpness < 30 THEN 'blurry' WHEN border_frac >= 0.06 THEN 'bordered' WHEN toxic = 1 THEN 'person' WHEN quality = 0 THEN 'face' END AS early
  FROM documents JOIN m USING (doc_id) LEFT JOIN labels USING (doc_id)),
x AS (SELECT doc_id, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate_exact' END) AS reason FROM q),
s AS (SELECT doc_id, embedding FROM x JOIN embeddings ON vec_id = doc_id WHERE reason IS NULL),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.doc_id < b.doc_id WHERE {_COSINE} >= {_LEAST}),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, component) AS (SELECT a, a FROM e UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.node WHERE r.component < e.b),
g AS (SELECT node, min(component) AS component FROM r GROUP BY node)
SELECT x.doc_id, coalesce(reason, CASE WHEN component < node THEN 'duplicate_near' END) AS reason FROM x LEFT JOIN g ON node = doc_id)"""


def _curated(spark, d):
    from sievework.plans.pipeline import curate

    docs = _metrics(spark, d).join(_t(spark, d, "documents").select("doc_id", X.sha256_hex("text").alias("sha256"), F.col("n_chars").alias("size")), "doc_id")
    labels = _t(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("has_person"), (F.col("quality") == 0).alias("has_face"))
    rows = docs.join(labels, "doc_id", "left").join(_t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    config = Config(min_sharpness=30.0, drop_bordered=True, border_min_frac=0.06, similarity=_LEAST, use_vectors=True, neighbours=None, rep_policy="first")
    return curate(rows.withColumn("mtime", F.lit(0.0)), config, key="doc_id")


@query(f"SELECT doc_id, reason FROM {_OUTCOMES}")
def outcomes(spark, d):
    return _curated(spark, d).outcomes.select("doc_id", "reason")


_N = "count(*) FILTER (reason = '{}') AS {}"


@query("SELECT count(*) AS total_input, " + ", ".join(_N.format(r, n) for r, n in (("blurry", "rejected_blurry"), ("grayscale", "rejected_grayscale"), ("bordered", "rejected_bordered"), ("person", "rejected_person"), ("face", "rejected_face"), ("duplicate_exact", "rejected_exact_dup"), ("duplicate_near", "rejected_near_dup"))) + f", count(*) FILTER (reason IS NULL) AS survivors FROM {_OUTCOMES}")
def run_summary(spark, d):
    return _curated(spark, d).summary


@query(f"SELECT count(*) AS total, count(*) FILTER (reason = 'duplicate_exact') AS rejected_exact, count(*) FILTER (reason = 'duplicate_near') AS rejected_near, count(*) FILTER (reason IS NULL) AS survivors FROM {_OUTCOMES}")
def dedup_summary(spark, d):
    return summaries.dedup_summary(_curated(spark, d).outcomes)


@query(f"SELECT count(*) FILTER (reason IS NULL) AS kept, count(*) FILTER (reason IS NOT NULL) AS rejected FROM {_OUTCOMES}")
def gallery_counts(spark, d):
    return summaries.gallery_counts(_curated(spark, d).outcomes)


@query("""WITH j AS (SELECT 'p' || doc_id AS rel_path FROM documents), o AS (SELECT 'p' || doc_id AS rel_path, CASE WHEN toxic = 1 THEN 'person' ELSE 'face' END AS reason FROM labels)
SELECT rel_path, coalesce(reason, rel_path) AS caption FROM (SELECT * FROM j ORDER BY rel_path LIMIT 400) LEFT JOIN o USING (rel_path)""")
def review_join(spark, d):
    name = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("rel_path")
    rejected = _t(spark, d, "documents").select(name)
    log = _t(spark, d, "labels").select(name, F.when(F.col("toxic") == 1, "person").otherwise("face").alias("reason"))
    return export.review(rejected, log, 400).select("rel_path", "caption")


@query("""WITH c AS (SELECT label FROM (SELECT DISTINCT label FROM embeddings) ORDER BY md5('7|' || label), label LIMIT 6)
SELECT label, vec_id, rank::INT AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || vec_id), vec_id) AS rank FROM embeddings SEMI JOIN c USING (label)) WHERE rank <= 4""")
def seed_sample(spark, d):
    return sampling.sample_seed(_t(spark, d, "embeddings").select("label", "vec_id"), "label", "vec_id", 6, 4, seed=7)


# ---- the feature table ----------------------------------------------------------------------------------------------


def _snapshots(spark, d):
    """A table of features, and the assets of today: some changed in size, some in time, some new, some gone.

    All documents are in both, but those in one language under a key of their own in the old table and those in
    another today."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id", "lang", F.col("n_chars").alias("size"), X.sha256_hex("text").alias("sha256"))
    key = lambda lang: F.concat(F.when(F.col("lang") == lang, lang).otherwise(""), "key").alias("key")
    params = F.when(F.col("doc_id") % 4 == 0, "other").otherwise("p").alias("params")
    old = docs.select(key("de"), "size", (F.col("doc_id") % 100).cast("double").alias("mtime"), F.when(F.col("doc_id") % 6 != 0, F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 2 == 0).alias("has_person"), params)
    changed = F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    shift = F.when(F.col("doc_id") % 8 == 0, 1.0).when(F.col("doc_id") % 8 == 1, 1.5).otherwise(0.0)
    now = docs.select(key("fr"), changed.alias("size"), (F.col("doc_id") % 100 + shift).cast("double").alias("mtime"))
    return old, now


_SNAP = """d AS (SELECT doc_id::VARCHAR AS key, doc_id, lang, n_chars AS size, sha256(text) AS sha256 FROM documents),
old AS (SELECT CASE WHEN lang = 'de' THEN 'de' ELSE '' END || key AS key, size, (doc_id % 100)::DOUBLE AS mtime, CASE WHEN doc_id % 6 <> 0 THEN sha256 END AS sha256, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 2 = 0 END AS has_person,
  CASE WHEN doc_id % 4 = 0 THEN 'other' ELSE 'p' END AS params FROM d),
now AS (SELECT CASE WHEN lang = 'fr' THEN 'fr' ELSE '' END || key AS key, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, (doc_id % 100 + CASE doc_id % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 0.0 END)::DOUBLE AS mtime FROM d)"""
_VALID = "n.key = o.key AND n.size = o.size AND abs(n.mtime - o.mtime) <= 1.0"


@query(f"""WITH {_SNAP} SELECT n.key, n.size, n.mtime, coalesce(o.params = 'p', false) AS cached, CASE WHEN o.params = 'p' THEN o.sha256 END AS sha256, CASE WHEN o.params = 'p' THEN o.has_person END AS has_person
FROM now n LEFT JOIN old o ON {_VALID}""")
def cache_lookup(spark, d):
    old, now = _snapshots(spark, d)
    return features.lookup(now, old, "p")


@query(f"WITH {_SNAP} SELECT n.key, n.size, n.mtime FROM now n LEFT JOIN old o ON {_VALID} AND o.params = 'p' WHERE o.sha256 IS NULL OR o.has_person IS NULL")
def cache_missing(spark, d):
    old, now = _snapshots(spark, d)
    return features.missing(now, old, "sha256", "has_person", params="p")


@query(f"""WITH {_SNAP}, new AS (SELECT key, size, mtime, 'new' || key AS sha256, NULL::BOOLEAN AS has_person, CASE WHEN size % 3 <> 0 THEN 'p' END AS params FROM now),
j AS (SELECT coalesce(o.key, n.key) AS key, n.key IS NULL AS gone, coalesce({_VALID}, false) AS same, n.params IS NOT NULL AND n.params IS DISTINCT FROM o.params AS other,
  o.size AS os, n.size AS ns, o.mtime AS om, n.mtime AS nm, o.sha256 AS oh, n.sha256 AS nh, o.has_person AS op, n.has_person AS np, o.params AS og, n.params AS ng FROM old o FULL JOIN new n ON o.key = n.key)
SELECT key, CASE WHEN gone OR same THEN os ELSE ns END AS size, CASE WHEN gone OR same THEN om ELSE nm END AS mtime,
  CASE WHEN gone THEN oh WHEN same AND NOT other THEN coalesce(nh, oh) ELSE nh END AS sha256, CASE WHEN gone THEN op WHEN same AND NOT other THEN coalesce(np, op) ELSE np END AS has_person,
  CASE WHEN gone THEN og WHEN same THEN coalesce(ng, og) ELSE ng END AS params FROM j""")
def cache_merge(spark, d):
    old, now = _snapshots(spark, d)
    new = now.withColumn("sha256", F.concat(F.lit("new"), "key")).withColumn("has_person", F.lit(None).cast("boolean")).withColumn("params", F.when(F.col("size") % 3 != 0, "p"))
    return features.merge(old, new)


@query(f"WITH {_SNAP} SELECT count(*) AS total_rows, count(sha256) AS with_sha256, count(has_person) AS with_detection FROM old")
def cache_info(spark, d):
    return features.info(_snapshots(spark, d)[0])


@query(f"WITH {_SNAP} SELECT * FROM old WHERE key IN (SELECT key FROM now)")
def cache_prune(spark, d):
    old, now = _snapshots(spark, d)
    return features.prune(old, now)


# ---- images and streams (no SQL) --------------------------------------------------------------------------------------


def _synthetic(spark, d):
    """A small image for each of the vectors, drawn from its numbers."""
    import numpy as np
    import pyarrow as pa

    from sievework.sources.files import _packed

    def draw(batches):
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), np.float64)
            images = [np.clip(128 + 400 * np.kron(x.reshape(8, 8), np.ones((4, 6)))[..., None] * np.array([1.0, 0.8, 0.6]), 0, 255).astype(np.uint8) for x in v]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(i) for i in images], pa.binary())], ["path", "image"])

    return _vectors(spark, d).select(F.col("vec_id").cast("string").alias("path"), "embedding").mapInArrow(draw, "path string, image binary")


@query()
def image_quality(spark, d):
    from sievework.plans.pipeline import measure

    return measure(_synthetic(spark, d)).select("path", "sharpness", "saturation", "border_frac", "sharpness_full")


@query()
def image_phash(spark, d):
    from sievework.plans.pipeline import measure

    return measure(_synthetic(spark, d)).select("path", X.hash_hex("phash").alias("phash"))


@query()
def image_crop(spark, d):
    import numpy as np
    import pyarrow as pa

    from sievework.functions import kernels
    from sievework.sources.files import unpacked

    def crop(batches):
        for batch in batches:
            means = [float(np.mean(kernels.crop_square(unpacked(x), 48))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64())], ["path", "mean"])

    return _synthetic(spark, d).mapInArrow(crop, "path string, mean double")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def feature_stream(spark, d):
    """The stream's windows over the events that have arrived; the tests run it as a stream too."""
    from sievework.streaming.features import windowed_counts

    events = _t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return windowed_counts(events).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
