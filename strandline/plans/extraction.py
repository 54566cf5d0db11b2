"""Queries on item text and item vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import codes as C
from strandline.functions import text as X
from strandline.functions import vectors as V
from strandline.operators import item_codes as K
from strandline.operators import ranking as G
from strandline.operators import rotation as R
from strandline.operators.tables import kept
from strandline.plans.inputs import FOUR, SLOT_ITEMS, four_slots, slot_items, table
from strandline.sources import artefacts as A


def page_titles(s, d):
    """Titles of web pages, cleaned."""
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return table(s, d, "pages").select("page_id", X.clean_text(title).alias("title"))


def item_sentences(s, d):
    p = table(s, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_brand", F.array(F.array(F.concat("p_type", F.lit("*")), F.concat("p_name", F.lit("*")))).alias("kinds"))
    return p.select("p_partkey", X.item_sentence([("p_name", "text"), ("p_retailprice", "number"), ("p_brand", "text"), ("kinds", "list")]).alias("sentence"))


def structured_texts(s, d):
    p = table(s, d, "part").withColumn("p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_type")))
    return p.select("p_partkey", X.structured_text([("p_name", "Title"), ("p_type", "Type"), ("p_size", "Size")]).alias("text"))


def bilingual_texts(s, d):
    p = table(s, d, "part")
    zh = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type"))
    en = F.when(F.col("p_size") % 2 == 0, F.lit(None)).otherwise(F.col("p_name"))
    return p.select("p_partkey", X.bilingual_text(zh, en).alias("both_text"), X.bilingual_text(zh, en, "zh").alias("zh_text"), X.bilingual_text(zh, en, "en").alias("en_text"))


def first_urls(s, d):
    p = table(s, d, "pages").select("page_id", F.when(F.col("url").contains("#"), "").otherwise(F.col("url")).alias("one"), F.array(F.lit(" "), F.concat(F.lit("img/"), F.col("page_id"))).alias("many"))
    return p.select("page_id", X.first_url(("one", "string"), ("many", "array")).alias("url"))


def safe_names(s, d):
    p = table(s, d, "pages")
    return p.select("page_id", X.safe_name("url", 30).alias("name"), X.identity("page_id", "url").alias("identity"), X.percent(F.col("page_id") / 1000).alias("share"))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def vector_norms(s, d):
    out = G.norm_report(_vectors(s, d).withColumn("vec", F.when(F.col("id") % 50 == 0, F.transform("vec", lambda x: x * 0)).otherwise(F.col("vec"))), "vec")
    return out.select(F.round("min_norm", 5).alias("min_norm"), F.round("max_norm", 5).alias("max_norm"), "n_zero", "n_not_finite")


def vector_prefixes(s, d):
    v = _vectors(s, d).withColumn("p", V.prefix("vec", 16))
    return v.select("id", F.round(V.norm("p"), 5).alias("norm"), F.round(F.element_at("p", 1), 5).alias("first"), F.size("p").cast("long").alias("width"))


def vector_fusion(s, d):
    v = _vectors(s, d).withColumn("f", V.fuse(F.slice("vec", 1, 32), F.slice("vec", 33, 32), 0.5))
    return v.select("id", F.round(F.element_at("f", 1), 5).alias("first"), F.round(F.element_at("f", -1), 5).alias("last"), F.size("f").cast("long").alias("width"))


def vector_cosines(s, d):
    """Each vector against the next one by id."""
    v = _vectors(s, d).select("id", "vec")
    n = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return v.join(n, "id").select("id", F.round(V.cosine("vec", "other"), 5).alias("cosine"))


def packed_codes(s, d):
    f = four_slots(s, d)
    return f.select("item", F.array_join(C.pack_digits("codes", 2), " ").alias("digits"), F.array_join(C.pack_pairs("codes", [(0, 3), (1, 2)]), " ").alias("pairs"), F.array_join(C.with_null_slots("codes", 2, 2), " ").alias("nulls"))


def collision_stats(s, d):
    return K.collision_stats(slot_items(s, d), "feats")


def repeated_tuples(s, d):
    return K.repeated_tuples(slot_items(s, d)).select(F.array_join("feats", " ").alias("feats"), "n")


def collision_digits(s, d):
    """Feature tuples with the collision digit: within the buckets, and unique up to 256 items of a tuple."""
    out = K.with_collision_digit(slot_items(s, d).withColumnRenamed("feats", "codes"), buckets=256, more="repeat")
    return out.select("item", F.array_join("feats", " ").alias("feats"))


def unique_features(s, d):
    """No two items share a tuple once it has its collision digit, or digits where 256 are too few."""
    out = K.with_collision_digit(slot_items(s, d).withColumnRenamed("feats", "codes"), buckets=256, more="digits")
    return out.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("feats").alias("n_tuples"), F.max(F.element_at("feats", -1) < 256).alias("in_range"))


def joined_codes(s, d):
    f = four_slots(s, d)
    text = f.where("item % 2 = 0").select("item", F.slice("codes", 1, 2).alias("codes"))
    image = f.where("item % 3 = 0").select("item", F.slice("codes", 3, 2).alias("codes"))
    return K.join_codes(text, image).select("item", F.array_join("codes", " ").alias("codes"))


def slot_pair_frequency(s, d):
    return K.slot_pair_frequency(four_slots(s, d), 4)


def best_slot_pairing(s, d):
    best = K.best_matching(K.slot_pair_frequency(four_slots(s, d), 4), 4)
    return best.select("total", F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["a"], p["b"], p["score"])), " ").alias("pairs"))


def product_codes(s, d):
    """Codes of the embeddings by product quantisation."""
    v = _vectors(s, d).select("id", "vec")
    return K.ProductQuantizer(4, 16, 5).fit(v).encode(v).select("id", F.array_join("codes", " ").alias("codes"))


def rotated_codes(s, d):
    """Codes of the embeddings after a rotation, trained on those that some order bought, and how far they are from what the codes stand for."""
    v = _vectors(s, d).select("id", "vec")
    bought = table(s, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().withColumn("bought", F.lit(True))
    marked = kept(v.join(bought, "id", "left"), "marked")
    out = R.RotatedQuantizer(4, 16, 5, 5).fit(marked, train=F.col("bought").isNotNull()).encode(marked.drop("bought"))
    return out.select("id", F.array_join("codes", " ").alias("codes"), F.round("error", 6).alias("error"))


def whitened_vectors(s, d):
    w = R.whiten(_vectors(s, d).select("id", "vec"), 8)
    return w.select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


def content_manifest(s, d):
    return A.manifest(table(s, d, "part"), "p_partkey", ["p_name", "p_size"])


QUERIES = {
    f.__name__: f
    for f in (
        page_titles, item_sentences, structured_texts, bilingual_texts, first_urls, safe_names, vector_norms, vector_prefixes, vector_fusion, vector_cosines,
        packed_codes, collision_stats, repeated_tuples, collision_digits, unique_features, joined_codes, slot_pair_frequency, best_slot_pairing, product_codes, rotated_codes, whitened_vectors, content_manifest,
    )
}

_UNESCAPED = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
for _ref, _char in X.ENTITIES.items():
    _UNESCAPED = "replace({}, '{}', '{}')".format(_UNESCAPED, _ref, _char.replace("'", "''"))
_UNESCAPED = f"replace({_UNESCAPED}, '&amp;', '&')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '<[^>]+>', '', 'g'), '[\\n\\t]', ' ', 'g'), ' +', ' ', 'g'), '[^\\x00-\\x7F]', ' ', 'g')"
_PAIRS = " UNION ALL ".join(
    f"SELECT {a} AS a, {b} AS b, max(n)::BIGINT AS max_freq, count(*) AS n_pairs FROM (SELECT codes[{a + 1}] AS va, codes[{b + 1}] AS vb, sum(n) AS n FROM ({FOUR}) GROUP BY ALL)"
    for a in range(4) for b in range(a + 1, 4)
)
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"

SQL = {
    "page_titles": f"SELECT page_id, {_CLEAN.format(_UNESCAPED)} AS title FROM pages",
    "item_sentences": """
        SELECT p_partkey, p_name || ' ' || p_retailprice::VARCHAR || '. ' || p_brand || ' ' || p_type || ', ' || p_name || '. ' AS sentence FROM part""",
    "structured_texts": """
        SELECT p_partkey, 'Title: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Type: ' || p_type ELSE '' END || chr(10) || 'Size: ' || p_size AS text FROM part""",
    "bilingual_texts": """
        SELECT p_partkey,
          CASE WHEN zh IS NOT NULL AND en IS NOT NULL THEN 'Chinese: ' || zh || chr(10) || 'English: ' || en ELSE coalesce(zh, en, '') END AS both_text,
          coalesce(zh, en, '') AS zh_text, coalesce(en, zh, '') AS en_text
        FROM (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_type END AS zh, CASE WHEN p_size % 2 <> 0 THEN p_name END AS en FROM part)""",
    "first_urls": "SELECT page_id, CASE WHEN contains(url, '#') THEN 'img/' || page_id ELSE url END AS url FROM pages",
    "safe_names": """
        SELECT page_id, CASE WHEN length(n) <= 30 THEN n ELSE substr(n, 1, 17) || '-' || substr(sha256(n), 1, 12) END AS name,
          substr(sha256(page_id || chr(31) || url), 1, 12) AS identity, printf('%.2f%%', page_id / 1000.0 * 100) AS share
        FROM (SELECT page_id, url, regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g') AS n FROM pages)""",
    "vector_norms": f"""
        SELECT round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm, count(*) FILTER (n = 0) AS n_zero, 0::BIGINT AS n_not_finite
        FROM (SELECT CASE WHEN vec_id % 50 = 0 THEN 0 ELSE {_NORM.format("embedding")} END AS n FROM embeddings)""",
    "vector_prefixes": f"SELECT vec_id AS id, 1.0::DOUBLE AS norm, round(embedding[1] / {_NORM.format('embedding[1:16]')}, 5) AS first, 16::BIGINT AS width FROM embeddings",
    "vector_fusion": f"""
        SELECT vec_id AS id, round(embedding[1] / {_NORM.format("embedding[1:32]")} / sqrt(1.25), 5) AS first,
          round(embedding[64] / {_NORM.format("embedding[33:64]")} * 0.5 / sqrt(1.25), 5) AS last, 64::BIGINT AS width FROM embeddings""",
    "vector_cosines": """
        SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "packed_codes": f"""
        SELECT item, (codes[1] * 256 + codes[2]) || ' ' || (codes[3] * 256 + codes[4]) AS digits, (codes[1] * 256 + codes[4]) || ' ' || (codes[2] * 256 + codes[3]) AS pairs,
          codes[1] || ' ' || codes[2] || ' 256 256 ' || codes[4] AS nulls FROM ({FOUR})""",
    "collision_stats": f"""
        SELECT count(*) AS n_tuples, count(*) FILTER (n > 1) AS n_duplicated, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_affected, max(n) AS largest
        FROM (SELECT feats, count(*) AS n FROM ({SLOT_ITEMS}) GROUP BY feats)""",
    "repeated_tuples": f"SELECT array_to_string(feats, ' ') AS feats, count(*) AS n FROM ({SLOT_ITEMS}) GROUP BY feats HAVING count(*) > 1",
    "unique_features": "SELECT count(*) AS n_items, count(*) AS n_tuples, true AS in_range FROM part",
    "joined_codes": f"SELECT item, array_to_string(codes, ' ') AS codes FROM ({FOUR}) WHERE item % 6 = 0",
    "collision_digits": """
        WITH f AS (SELECT p_partkey AS item, [p_partkey % 7, p_partkey % 11, p_size] AS c FROM part),
        n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY item) - 1 AS n, ('0x' || md5('2024|' || array_to_string(c, '|'))[1:14])::BIGINT AS h FROM f)
        SELECT item, array_to_string(c || [(((h % 256) | 1) * n + (h >> 20) % 256) % 256], ' ') AS feats FROM n""",
    "slot_pair_frequency": _PAIRS,
    "best_slot_pairing": f"""
        WITH e AS ({_PAIRS})
        SELECT total, pairs FROM (
          SELECT (x.max_freq + y.max_freq)::BIGINT AS total, x.a || '-' || x.b || '-' || x.max_freq || ' ' || y.a || '-' || y.b || '-' || y.max_freq AS pairs, x.b AS place
          FROM e x JOIN e y ON x.a = 0 AND y.a > 0 AND y.a <> x.b AND y.b <> x.b)
        ORDER BY total DESC, place LIMIT 1""",
    "content_manifest": """
        SELECT count(*) AS n_rows, sha256(concat_ws('-', sum(('0x' || substr(h, 1, 14))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 15, 14))::BIGINT)::VARCHAR,
          sum(('0x' || substr(h, 29, 14))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 43, 14))::BIGINT)::VARCHAR)) AS content_sha256
        FROM (SELECT sha256(concat_ws(chr(31), p_partkey, p_name, p_size)) AS h FROM part)""",
}
