"""Queries on the merge vocabulary and on merge logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import codes as C
from strandline.operators import examples as X
from strandline.operators import merge_log as L
from strandline.operators import ranking as G
from strandline.operators import search as B
from strandline.operators import training
from strandline.operators import vocabulary as M
from strandline.operators.interactions import sequences
from strandline.operators.tables import kept
from strandline.plans.inputs import ATOMS, CLASSIFIED, ORDER, PURCHASES, SLOT_ITEMS, STATES, log_of_merges, purchase_tables, purchases, slot_items, table

END = 0
TEXT, IMAGE, HASH = [0, 1, 2, 3], [4, 5, 6, 7], 8


def initial_vocabulary(s, d):
    return M.initial_vocabulary(slot_items(s, d)).select(F.col("token").cast("long").alias("token"), F.col("slot").cast("long").alias("slot"), F.col("code").cast("long").alias("code"))


def _states(s, d):
    items = slot_items(s, d)
    return M.token_states(sequences(purchases(s, d), "user", "item", ORDER), items, M.initial_vocabulary(items), "user")


def token_states(s, d):
    return _states(s, d).select("user", F.col("pos").cast("long").alias("pos"), F.array_join("state", " ").alias("state"))


def _totals(s, d, cross=True):
    return M.total_masses(M.pair_masses(_states(s, d), "user", cross), "user")


def pair_masses(s, d):
    t = _totals(s, d)
    return t.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("mass", 4).alias("mass"), "n_sequences")


def best_pair(s, d):
    return M.best_pair(_totals(s, d, False)).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("mass", 4).alias("mass"), "n_sequences")


def mass_difference(s, d):
    """What pairs across neighbouring items add to those inside items."""
    masses = kept(M.pair_masses(_states(s, d), "user").select("a", "b", "mass"), "masses")
    new = masses.groupBy("a", "b").agg(F.sum("mass").alias("mass"))
    diff = M.mass_difference(new, _totals(s, d, False))
    return diff.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("change", 4).alias("change")).where("change != 0")


def decoded_states(s, d):
    """Atoms of every item back to its codes; odd items lack a slot, and do not decode."""
    items = slot_items(s, d)
    vocab = M.initial_vocabulary(items)
    flat = items.select("item", F.posexplode("feats").alias("slot", "code")).join(vocab, ["slot", "code"])
    flat = flat.where("item % 2 = 0 or slot > 0").select("item", "token")
    return M.decode_states(flat, vocab.select("token", "slot", "code"), "item", 3).select("item", F.array_join("codes", " ").alias("codes"))


def atom_sources(s, d):
    """Brands in which each atom occurs."""
    items = slot_items(s, d)
    brands = table(s, d, "part").select(F.col("p_partkey").alias("item"), F.array("p_brand").alias("sources"))
    out = M.atom_sources(items, brands, M.initial_vocabulary(items))
    return out.select(F.col("token").cast("long").alias("token"), F.array_join("sources", ",").alias("sources"))


def provenance_classes(s, d):
    """How the buyers' segments of two neighbouring parts relate."""
    seg = table(s, d, "customer").select(F.col("c_custkey").alias("user"), "c_mktsegment")
    src = purchases(s, d).join(seg, "user").groupBy("item").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("sources"))
    nxt = src.select((F.col("item") - 1).alias("item"), F.col("sources").alias("other"))
    return src.join(nxt, "item").groupBy(M.provenance(F.col("sources"), F.col("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _trained(s, d, size=160, keep=False):
    """Vocabulary, log and the users' sequences. The training is found again by the tables that sequences are made of, so only who
    reads them (keep) or trains makes them."""
    seqs = purchases(s, d).join(slot_items(s, d), "item")
    rows = seqs.groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "feats"))), lambda x: x["feats"]).alias("feats"))
    rows = kept(rows, "user-feats") if keep else rows
    return *training.trained_once(rows, size, [*purchase_tables(s, d), slot_items(s, d)]), rows


def trained_merges(s, d):
    _, log, _ = _trained(s, d)
    return log


def encoded_sequences(s, d):
    vocab, _, rows = _trained(s, d, keep=True)
    out = M.encode_sequences(rows, vocab, "user", "none", "sequence")
    return out.select("user", F.array_join("tokens", " ").alias("tokens"))


def merge_outputs(s, d):
    rows = L.classified(log_of_merges(s, d), TEXT, IMAGE, HASH)
    return L.output_composition(rows).select("output", "n", F.round("priority", 2).alias("priority"), F.col("affected").cast("long").alias("affected"), "n_hash")


def merge_transitions(s, d):
    rows = L.classified(log_of_merges(s, d), TEXT, IMAGE, HASH)
    return L.transition_composition(rows).select("transition", "n", F.round("priority", 2).alias("priority"), F.col("affected").cast("long").alias("affected"), F.col("first_step").cast("long").alias("first_step"))


def merge_phases(s, d):
    rows = L.classified(log_of_merges(s, d), TEXT, IMAGE, HASH)
    return L.phases(rows, 10).select(F.col("bin").cast("long").alias("bin"), "phase_group", "n", F.round("priority", 2).alias("priority"))


def merge_examples(s, d):
    rows = L.classified(log_of_merges(s, d), TEXT, IMAGE, HASH)
    return G.examples_by_class(rows, "transition", "step").select("transition", F.col("step").cast("long").alias("step"), F.col("new_token").cast("long").alias("new_token"))


def merge_exposure(s, d):
    """Selected kinds against the candidates of each step, with orders as steps."""
    o = table(s, d, "orders")
    x = F.col("o_orderkey")
    m = lambda a, b, c: F.create_map(F.lit("text_text"), a.cast("double"), F.lit("image_image"), b.cast("double"), F.lit("text_image"), c.cast("double"))
    sel = F.when(x % 3 == 0, "text_text").when(x % 3 == 1, "image_image").otherwise("text_image")
    log = o.select(sel.alias("selected"), m(x % 5, x % 7, x % 11).alias("counts"), m(x % 13, x % 3, x % 2).alias("masses"))
    out = L.exposure(log)
    return out.select("kind", "selected", *[F.round(c, 4).alias(c) for c in ("expected_by_count", "count_enrichment", "expected_by_mass", "mass_enrichment")])


def slot_permutation(s, d):
    out = L.slot_permutation_test(log_of_merges(s, d), TEXT, IMAGE, HASH)
    return out.select("metric", *[F.round(c, 6).alias(c) for c in out.columns if c != "metric"])


def candidate_kinds(s, d):
    """Candidate pairs inside items by the slots of their tokens."""
    t = _totals(s, d, False)
    v = M.initial_vocabulary(slot_items(s, d)).select("token", "slot")
    both = t.join(v.withColumnRenamed("token", "a").withColumnRenamed("slot", "sa"), "a").join(v.withColumnRenamed("token", "b").withColumnRenamed("slot", "sb"), "b")
    kind = F.concat_ws("-", C.pair_low("sa", "sb"), C.pair_high("sa", "sb"))
    return L.candidate_exposure(both, kind).select("kind", "n", F.round("mass", 3).alias("mass"), F.round("largest", 3).alias("largest"))


def merge_path_stages(s, d):
    """How many stages the merge paths of the distinct tuples have."""
    vocab, _, _ = _trained(s, d)
    return X.path_report(X.merge_paths(slot_items(s, d), vocab))


def history_policies(s, d):
    """Token counts of the catalogue under each history policy."""
    vocab, _, _ = _trained(s, d)
    items = slot_items(s, d)
    paths = kept(items.join(X.merge_paths(items, vocab), "feats"), "paths")
    out = None
    for policy in ("raw", "full", "middle", "random"):
        one = X.history_tokens(paths, policy, ["item"]).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("n_tokens")).select(F.lit(policy).alias("policy"), "n", "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def model_examples(s, d, split="test"):
    """Examples of a split: up to twenty items of history, item by item encoded, and the target's atoms."""
    from strandline.operators.interactions import example_windows

    vocab, _, _ = _trained(s, d)
    items = slot_items(s, d)
    n = len(vocab)
    spelt = X.label_atoms(X.history_tokens(items.join(X.merge_paths(items, vocab), "feats"), "full", ["item"]), vocab)
    # an item is spelt once, tokens and label as text along with each purchase, so that windows are slices of a user's own sequence; unknown items keep their place
    spelt = spelt.select("item", X.spelt("tokens").alias("text"), F.size("tokens").alias("n"), F.array_join(X.padded_label("label", 4, n + 1), " ").alias("label"))
    bought = purchases(s, d).join(spelt, "item", "left").groupBy("user").agg(F.array_sort(F.collect_list(F.struct(*ORDER, "text", "n", "label"))).alias("seq"))
    w = example_windows(bought.select("user", F.transform("seq", lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), x["label"].alias("label"))).alias("seq")), split, 20)
    h = w.select("user", F.element_at("window", -1)["label"].alias("labels"), F.slice("window", F.lit(1), F.size("window") - 1).alias("h"))
    rows = h.select("user", "labels", F.col("h.text").alias("texts"), F.array_compact("h.n").alias("counts")).where("labels is not null and size(counts) > 0")
    return X.assemble_texts(rows, 64, n, n + 1).select("user", "input_ids", "attention_mask", "labels")


def train_examples(s, d):
    """The same of the training split: an example for every prefix."""
    return model_examples(s, d, "train")


def _transitions(s, d):
    """(context, step, prev, token, score): for every user, how often an atom of their purchases follows the one of the slot before. Parts of
    odd keys end after two slots; END follows the last atom."""
    items = slot_items(s, d)
    atoms = M.initial_vocabulary(items)
    flat = items.select("item", F.posexplode("feats").alias("slot", "code")).join(atoms, ["slot", "code"]).where("slot < 2 or item % 2 = 0")
    spelt = flat.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "token"))), lambda x: x["token"]).alias("t"))
    spelt = spelt.select("item", F.concat(F.array(F.lit(B.START)), "t", F.array(F.lit(END))).alias("t"))
    steps = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda k: F.struct(k.alias("step"), F.get("t", k).alias("prev"), F.get("t", k + 1).alias("token")))
    uses = purchases(s, d).groupBy(F.col("user").alias("context"), "item").agg(F.count(F.lit(1)).alias("n")).join(spelt.select("item", F.explode(steps).alias("x")), "item")
    counts = uses.groupBy("context", "x.step", "x.prev", "x.token").agg(F.sum("n").alias("n")).select("context", "step", "prev", "token", F.log(F.col("n").cast("double")).alias("score"))
    grammar = atoms.select(F.col("slot").alias("step"), "token").unionByName(s.createDataFrame([(2, END), (3, END)], "step int, token int"))
    return counts, grammar


def _searched(s, d, end_aware):
    counts, grammar = _transitions(s, d)
    scores = kept(B.constrained(counts, grammar), "scores")
    out = B.search_table(scores.select(F.col("context").alias("example"), "context").distinct(), scores, END, 4, 4, 3, end_aware)
    return out.select(F.col("example").alias("user"), F.col("rank").cast("long").alias("rank"), F.array_join("tokens", " ").alias("tokens"), F.round("score", 6).alias("score"))


def searched_items(s, d):
    """The three likeliest items of every user, spelt in atoms, by beam search over the user's own transitions."""
    return _searched(s, d, True)


def searched_items_fixed(s, d):
    """The same with beams of fixed length, where items that end early fall out."""
    return _searched(s, d, False)


def label_tokens(s, d):
    """The atoms of every item as tokens."""
    items = slot_items(s, d)
    atoms = M.initial_vocabulary(items).orderBy("token").collect()  # bounded by the code books
    vocab = M.Vocabulary([(r["slot"], r["code"]) for r in atoms])
    return X.label_atoms(items, vocab).select("item", F.array_join("label", " ").alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        searched_items, searched_items_fixed, merge_path_stages, history_policies, model_examples, train_examples, label_tokens, initial_vocabulary, token_states, pair_masses, best_pair, mass_difference, decoded_states, atom_sources, provenance_classes, trained_merges, encoded_sequences,
        merge_outputs, merge_transitions, merge_phases, merge_examples, merge_exposure, slot_permutation, candidate_kinds,
    )
}

_INSIDE = f"""
SELECT s.user, least(x.t, y.t) AS a, greatest(x.t, y.t) AS b, 2.0 / len(s.state) AS w FROM ({STATES}) s,
  LATERAL (SELECT unnest(s.state) AS t, generate_subscripts(s.state, 1) AS i) x, LATERAL (SELECT unnest(s.state) AS t, generate_subscripts(s.state, 1) AS i) y WHERE x.i < y.i
"""
_CROSS = f"""
SELECT s.user, least(x.t, y.t) AS a, greatest(x.t, y.t) AS b, 1.0 / (len(s.state) * len(n.state)) AS w
FROM ({STATES}) s JOIN ({STATES}) n ON n.user = s.user AND n.pos = s.pos + 1, LATERAL (SELECT unnest(s.state) AS t) x, LATERAL (SELECT unnest(n.state) AS t) y
"""
_GROUP = "CASE WHEN transition IN ('text_text', 'image_image', 'text_image', 'hash_related') THEN transition WHEN starts_with(transition, 'mixed') THEN 'mixed_related' ELSE 'unknown' END"
_TOTAL = "SELECT a, b, round(sum(w), 4) AS mass, count(DISTINCT user) AS n_sequences FROM ({0}) GROUP BY a, b"


def _search_sql(end_aware: bool) -> str:
    """Beam search over four steps, one common table after the other."""
    top = "QUALIFY row_number() OVER (PARTITION BY user ORDER BY round(score, 9) DESC, tokens) <= 4"
    steps = ["b0 AS (SELECT user, [-1] AS tokens, -1 AS prev, 0.0::DOUBLE AS score FROM (SELECT DISTINCT user FROM sc))"]
    for k in range(4):
        steps.append(f"g{k + 1} AS (SELECT b.user, list_append(b.tokens, sc.token) AS tokens, sc.token AS prev, b.score + sc.s AS score FROM b{k} b JOIN sc ON sc.user = b.user AND sc.prev = b.prev AND sc.step = {k})")
        steps.append(f"b{k + 1} AS (SELECT * FROM g{k + 1} WHERE {'prev != 0' if end_aware else 'true'} {top})")
    found = " UNION ALL ".join(["SELECT * FROM b4", *(f"SELECT * FROM g{k} WHERE prev = 0" for k in range(1, 5) if end_aware)])
    return f"""
        WITH spelt AS (SELECT item, list(token ORDER BY slot) AS t FROM (SELECT item, unnest([0, 1, 2]) AS slot, unnest(feats) AS code FROM ({SLOT_ITEMS})) JOIN ({ATOMS}) USING (slot, code) GROUP BY item),
        uses AS (SELECT user, item, t FROM ({PURCHASES}) JOIN spelt USING (item)),
        tr AS (SELECT user, 0 AS step, -1 AS prev, t[1] AS token FROM uses UNION ALL SELECT user, 1, t[1], t[2] FROM uses
          UNION ALL SELECT user, 2, t[2], CASE WHEN item % 2 = 0 THEN t[3] ELSE 0 END FROM uses UNION ALL SELECT user, 3, t[3], 0 FROM uses WHERE item % 2 = 0),
        sc AS (SELECT user, step, prev, token, ln(n / sum(n) OVER (PARTITION BY user, step, prev)) AS s FROM (SELECT user, step, prev, token, count(*)::DOUBLE AS n FROM tr GROUP BY ALL)),
        {", ".join(steps)}
        SELECT user, rank, array_to_string(tokens[2:], ' ') AS tokens, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY round(score, 9) DESC, tokens) AS rank FROM ({found})) WHERE rank <= 3"""


SQL = {
    "searched_items": _search_sql(True),
    "searched_items_fixed": _search_sql(False),
    "initial_vocabulary": ATOMS,
    "label_tokens": f"""
        SELECT item, string_agg(token, ' ' ORDER BY slot) AS label
        FROM (SELECT item, unnest([0, 1, 2]) AS slot, unnest(feats) AS code FROM ({SLOT_ITEMS})) JOIN ({ATOMS}) USING (slot, code) GROUP BY item""",
    "token_states": f"SELECT user, pos, array_to_string(state, ' ') AS state FROM ({STATES})",
    "pair_masses": _TOTAL.format(f"{_INSIDE} UNION ALL {_CROSS}"),
    "best_pair": f"{_TOTAL.format(_INSIDE)} ORDER BY sum(w) DESC, a, b LIMIT 1",
    "mass_difference": f"SELECT a, b, round(sum(w), 4) AS change FROM ({_CROSS}) GROUP BY a, b HAVING round(sum(w), 4) != 0",
    "decoded_states": f"SELECT item, CASE WHEN item % 2 = 0 THEN array_to_string(feats, ' ') END AS codes FROM ({SLOT_ITEMS})",
    "atom_sources": f"""
        SELECT token, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources
        FROM (SELECT item, unnest([0, 1, 2]) AS slot, unnest(feats) AS code FROM ({SLOT_ITEMS})) JOIN ({ATOMS}) USING (slot, code) JOIN part ON p_partkey = item GROUP BY token""",
    "provenance_classes": """
        WITH src AS (SELECT l_partkey AS item, list_sort(list(DISTINCT c_mktsegment)) AS sources FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON c_custkey = o_custkey GROUP BY 1)
        SELECT CASE WHEN NOT list_has_any(x.sources, y.sources) THEN 'cross_source' WHEN len(list_distinct(x.sources || y.sources)) > 1 THEN 'mixed_or_shared_source' ELSE 'single_source' END AS kind,
          count(*) AS n FROM src x JOIN src y ON y.item = x.item + 1 GROUP BY 1""",
    "merge_outputs": f"SELECT output, count(*) AS n, round(sum(priority), 2) AS priority, sum(affected)::BIGINT AS affected, count(*) FILTER (includes_hash) AS n_hash FROM ({CLASSIFIED}) GROUP BY output",
    "merge_transitions": f"SELECT transition, count(*) AS n, round(sum(priority), 2) AS priority, sum(affected)::BIGINT AS affected, min(step) AS first_step FROM ({CLASSIFIED}) GROUP BY transition",
    "merge_phases": f"""
        SELECT least(9, greatest(0, (step - 1) * 10 // (SELECT max(o_orderkey) + 1 FROM orders))) + 1 AS bin, {_GROUP} AS phase_group, count(*) AS n, round(sum(priority), 2) AS priority
        FROM ({CLASSIFIED}) GROUP BY ALL""",
    "merge_examples": f"SELECT transition, step, new_token FROM (SELECT *, row_number() OVER (PARTITION BY transition ORDER BY step) AS r FROM ({CLASSIFIED})) WHERE r <= 3",
    "merge_exposure": """
        WITH log AS (SELECT o_orderkey % 3 AS s, o_orderkey % 5 AS c1, o_orderkey % 7 AS c2, o_orderkey % 11 AS c3, o_orderkey % 13 AS m1, o_orderkey % 3 AS m2, o_orderkey % 2 AS m3 FROM orders),
        ok AS (SELECT *, (c1 + c2 + c3)::DOUBLE AS c, (m1 + m2 + m3)::DOUBLE AS m FROM log WHERE c1 + c2 + c3 > 0 AND m1 + m2 + m3 > 0),
        e AS (SELECT 'text_text' AS kind, count(*) FILTER (s = 0) AS selected, sum(c1 / c) AS ec, sum(m1 / m) AS em FROM ok
          UNION ALL SELECT 'image_image', count(*) FILTER (s = 1), sum(c2 / c), sum(m2 / m) FROM ok UNION ALL SELECT 'text_image', count(*) FILTER (s = 2), sum(c3 / c), sum(m3 / m) FROM ok)
        SELECT kind, selected, round(ec, 4) AS expected_by_count, round(selected / ec, 4) AS count_enrichment, round(em, 4) AS expected_by_mass, round(selected / em, 4) AS mass_enrichment FROM e""",
    "candidate_kinds": f"""
        SELECT least(x.slot, y.slot) || '-' || greatest(x.slot, y.slot) AS kind, count(*) AS n, round(sum(mass), 3) AS mass, round(max(mass), 3) AS largest
        FROM (SELECT a, b, sum(w) AS mass FROM ({_INSIDE}) GROUP BY a, b) t JOIN ({ATOMS}) x ON x.token = a JOIN ({ATOMS}) y ON y.token = b GROUP BY 1""",
}
