"""Queries on interactions: order, ids, sequences, splits, windows, statistics and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import interactions as I
from strandline.operators.tables import kept
from strandline.plans.inputs import BY_TIME, ORDER, PURCHASES, SEQS, purchases, table
from strandline.sources import records as R


def _seqs(s, d):
    return I.sequences(purchases(s, d), "user", "item", ORDER)


def user_sequences(s, d):
    return _seqs(s, d).select("user", F.array_join("seq", " ").alias("items"), F.size("seq").cast("long").alias("n"))


def user_positions(s, d):
    return I.positions(purchases(s, d), "user", ORDER).select("user", "item", "okey", "line", "supp", F.col("pos").cast("long").alias("pos"))


def user_ids(s, d):
    return I.first_appearance_ids(purchases(s, d), "user", [F.col(c) for c in ORDER])


def item_ids(s, d):
    """Items in the order of walking the users (by first purchase), each along its own sequence."""
    log = purchases(s, d)
    ids = user_ids(s, d).withColumnRenamed("id", "uid")
    placed = I.positions(log, "user", ORDER).join(ids, "user")
    return I.first_appearance_ids(placed, "item", [F.col("uid"), F.col("pos")])


def leave_one_out(s, d):
    parts = I.split(_seqs(s, d))
    return parts.select("user", "split", F.size("seq").cast("long").alias("n"), F.element_at("seq", -1).alias("last"))


def prefix_windows(s, d):
    w = I.prefix_windows(_seqs(s, d), 20)
    return w.select("user", F.col("target_pos").cast("long").alias("target_pos"), F.array_join("window", " ").alias("items"))


def eval_windows(s, d):
    return I.last_window(_seqs(s, d), 20).select("user", F.array_join("window", " ").alias("items"))


def dataset_stats(s, d):
    return I.dataset_stats(_seqs(s, d))


def _by_category(s, d):
    e = table(s, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("user"), F.col("event_type"), (F.col("event_id") % 40).alias("item"), "ts", F.col("event_id").alias("ord"))
    # the event types are the categories; as many as there are category files
    return {c: rows.where(F.col("event_type") == c).drop("event_type") for c in ("click", "error", "login", "purchase", "view")}


def merged_categories(s, d):
    log, _ = I.merge_categories(_by_category(s, d))
    return I.sequences(log, "user", "item", ("ts", "ord")).select("user", F.array_join("seq", " ").alias("items"))


def item_sources(s, d):
    _, sources = I.merge_categories(_by_category(s, d))
    return sources.select("item", F.array_join("sources", ",").alias("sources"))


def known_items(s, d):
    """Parts that were bought in 1995; of several records (one per supplier) the last by (size, supplier) wins."""
    bought = purchases(s, d).where("year(ts) = 1995").select("item")
    li = table(s, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("line"), (F.col("l_linenumber") % 3).alias("file"), F.col("l_suppkey").alias("supp"))
    return I.known_items(li, bought).select("item", "file", "supp")


def unknown_items(s, d):
    """Parts bought in 1995 that have no line in 1996."""
    log = purchases(s, d)
    meta = log.where("year(ts) = 1996").select("item").distinct()
    return I.unknown_items(meta, log.where("year(ts) = 1995"))


def key_difference(s, d):
    """Customers and suppliers by nation: nations that only one side has."""
    c = table(s, d, "customer").select((F.col("c_nationkey") * 7 + F.floor(F.col("c_acctbal") / 100)).alias("k"))
    p = table(s, d, "supplier").select((F.col("s_nationkey") * 7 + F.floor(F.col("s_acctbal") / 100)).alias("k"))
    return I.key_difference(c, p, "k")


def image_status(s, d):
    """Parts with the picture of a matching supplier key, downloaded or missing, counted by status."""
    items = table(s, d, "part").select(F.col("p_partkey").alias("item"))
    files = table(s, d, "supplier").select((F.col("s_suppkey") * 3).alias("item"), F.col("s_name").alias("path"))
    return R.with_image_status(items, files).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def field_coverage(s, d):
    """Pages with a secure address, with a fragment, and with a query."""
    p = table(s, d, "pages")
    return p.agg(
        F.count_if(F.col("url").startswith("https:")).alias("n_secure"), F.count_if(F.col("url").contains("#")).alias("n_fragment"),
        F.count_if(F.col("url").contains("?")).alias("n_query"), F.count(F.lit(1)).alias("n_pages"),
    )


def review_profile(s, d):
    return R.review_profile(purchases(s, d))


def usage_totals(s, d):
    """Sums over the property maps of events."""
    from strandline.operators.ranking import usage_totals as totals

    e = table(s, d, "events").select(F.from_json("props", "map<string, bigint>").alias("usage"))
    return totals(e)


def latest_status(s, d):
    """The last event type of every user by (ts, event_id)."""
    e = table(s, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def first_with_image(s, d):
    """The first part, by key, that has a text and a picture."""
    p = table(s, d, "part").where("p_name is not null and p_name <> ''").select(F.col("p_partkey").alias("item"), "p_name")
    files = table(s, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 3).alias("item"), "s_name")
    return p.join(files, "item").orderBy("item").limit(1).select("item", "p_name", "s_name")


def _streamed(s, d):
    """User sequences from a stream of event files, committed batch by batch."""
    from strandline.streaming.sequences import append_batches, current_sequences

    root = kept(s.range(1), "stream").inputFiles()[0].rsplit("/", 1)[0]
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    append_batches(stream, f"{root}/events", f"{root}/progress").awaitTermination()
    return current_sequences(s, f"{root}/events", "user_id", "event_id", ("ts", "event_id"))


def streamed_sequences(s, d):
    """The streamed sequences with all their items."""
    return _streamed(s, d).select("user_id", F.array_join("seq", " ").alias("items"))


def keyed_sequences(s, d):
    """The streamed sequences from keyed state: the events come in three files, each a trigger, and a day is the horizon."""
    from strandline.streaming import keyed
    from strandline.streaming.sequences import append_batches

    events = kept(table(s, d, "events").repartition(3, "event_id"), "event-files")
    files = events.inputFiles()[0].rsplit("/", 1)[0]
    root = kept(s.range(1), "stream").inputFiles()[0].rsplit("/", 1)[0]
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)
    append_batches(keyed.tails(stream, "user_id", "event_id", "ts", "event_id", 86400.0), f"{root}/log", f"{root}/progress").awaitTermination()
    seqs = keyed.sequences_of(keyed.read_log(s, f"{root}/log"))
    return seqs.select(F.col("user").cast("long").alias("user_id"), F.array_join("seq", " ").alias("items"))


def example_windows(s, d):
    """History and target of the examples of every split."""
    parts = [I.example_windows(_seqs(s, d), x).select(F.lit(x).alias("split"), "user", F.array_join("window", " ").alias("items")) for x in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def training_frequency(s, d):
    """How often each item stands in a training prefix."""
    return I.training_frequency(_seqs(s, d))


QUERIES = {
    f.__name__: f
    for f in (
        user_sequences, user_positions, user_ids, item_ids, leave_one_out, prefix_windows, eval_windows, dataset_stats, merged_categories, item_sources,
        known_items, unknown_items, key_difference, image_status, field_coverage, review_profile, usage_totals, latest_status, first_with_image, streamed_sequences, keyed_sequences, example_windows, training_frequency,
    )
}

_POS = f"SELECT *, row_number() OVER (PARTITION BY user ORDER BY {BY_TIME}) AS pos FROM ({PURCHASES})"
_UIDS = f"SELECT user, row_number() OVER (ORDER BY first) AS id FROM (SELECT user, min(({BY_TIME})) AS first FROM ({PURCHASES}) GROUP BY user)"
_CATS = "SELECT event_type || '::' || user_id AS user, event_id % 40 AS item, ts, event_id, event_type FROM events WHERE event_type IN ('click', 'error', 'login', 'purchase', 'view')"

SQL = {
    "user_sequences": f"SELECT user, array_to_string(seq, ' ') AS items, len(seq) AS n FROM ({SEQS})",
    "user_positions": f"SELECT user, item, okey, line, supp, pos FROM ({_POS})",
    "user_ids": _UIDS,
    "item_ids": f"""
        SELECT item, row_number() OVER (ORDER BY first) AS id FROM (
          SELECT item, min((id, pos)) AS first FROM ({_POS}) JOIN ({_UIDS}) USING (user) GROUP BY item)""",
    "leave_one_out": f"""
        SELECT user, split, n, seq[n] AS last FROM (
          SELECT user, seq, 'test' AS split, len(seq) AS n FROM ({SEQS})
          UNION ALL SELECT user, seq, 'val', len(seq) - 1 FROM ({SEQS}) WHERE len(seq) > 1
          UNION ALL SELECT user, seq, 'train', len(seq) - 2 FROM ({SEQS}) WHERE len(seq) > 2)""",
    "prefix_windows": f"""
        SELECT user, target_pos, array_to_string(seq[greatest(target_pos - 20, 1):target_pos], ' ') AS items
        FROM (SELECT user, seq, unnest(range(2, len(seq) + 1)) AS target_pos FROM ({SEQS}))""",
    "eval_windows": f"SELECT user, array_to_string(seq[greatest(len(seq) - 20, 1):len(seq)], ' ') AS items FROM ({SEQS})",
    "dataset_stats": f"""
        SELECT count(DISTINCT user) + 1 AS n_users, count(DISTINCT item) + 1 AS n_items, count(*) AS n_interactions,
          count(*) / (count(DISTINCT user) + 1) AS avg_length FROM ({PURCHASES})""",
    "merged_categories": f"SELECT user, string_agg(item, ' ' ORDER BY ts, event_id) AS items FROM ({_CATS}) GROUP BY user",
    "item_sources": f"SELECT item, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM ({_CATS}) GROUP BY item",
    "known_items": f"""
        SELECT item, file, supp FROM (
          SELECT l_partkey AS item, l_linenumber % 3 AS file, l_suppkey AS supp,
            row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 3 DESC, l_suppkey DESC) AS r
          FROM lineitem WHERE l_partkey IN (SELECT item FROM ({PURCHASES}) WHERE year(ts) = 1995)) WHERE r = 1""",
    "unknown_items": f"""
        SELECT DISTINCT item FROM ({PURCHASES}) WHERE year(ts) = 1995
        EXCEPT SELECT item FROM ({PURCHASES}) WHERE year(ts) = 1996""",
    "key_difference": """
        SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side
        FROM (SELECT DISTINCT c_nationkey * 7 + CAST(floor(c_acctbal / 100) AS BIGINT) AS k FROM customer) a
        FULL JOIN (SELECT DISTINCT s_nationkey * 7 + CAST(floor(s_acctbal / 100) AS BIGINT) AS k FROM supplier) b ON a.k = b.k
        WHERE a.k IS NULL OR b.k IS NULL""",
    "image_status": """
        SELECT CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'downloaded' END AS status, count(*) AS n
        FROM part LEFT JOIN supplier ON s_suppkey * 3 = p_partkey GROUP BY 1""",
    "field_coverage": """
        SELECT count(*) FILTER (starts_with(url, 'https:')) AS n_secure, count(*) FILTER (contains(url, '#')) AS n_fragment,
          count(*) FILTER (contains(url, '?')) AS n_query, count(*) AS n_pages FROM pages""",
    "review_profile": f"SELECT count(DISTINCT item) AS n_items, count(DISTINCT user) AS n_users, count(*) AS n_rows FROM ({PURCHASES})",
    "usage_totals": "SELECT 'k' AS name, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events",
    "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id",
    "first_with_image": """
        SELECT p_partkey AS item, p_name, s_name FROM part JOIN supplier ON s_suppkey * 3 = p_partkey
        WHERE p_name <> '' AND s_acctbal > 0 ORDER BY item LIMIT 1""",
    "streamed_sequences": "SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id), ' ') AS items FROM events GROUP BY user_id",
    "keyed_sequences": "SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id), ' ') AS items FROM events GROUP BY user_id",
    "example_windows": f"""
        WITH cut AS (SELECT user, 'train' AS split, seq[1:len(seq) - 2] AS seq FROM ({SEQS}) WHERE len(seq) > 2
          UNION ALL SELECT user, 'val', seq[1:len(seq) - 1] FROM ({SEQS}) UNION ALL SELECT user, 'test', seq FROM ({SEQS})),
        ends AS (SELECT *, unnest(CASE WHEN split = 'train' THEN range(2, len(seq) + 1) ELSE [len(seq)] END) AS last FROM cut WHERE len(seq) > 1)
        SELECT split, user, array_to_string(seq[greatest(last - 20, 1):last], ' ') AS items FROM ends""",
    "training_frequency": f"SELECT item, count(*) AS n FROM (SELECT unnest(seq[1:len(seq) - 2]) AS item FROM ({SEQS}) WHERE len(seq) > 2) GROUP BY item",
}
