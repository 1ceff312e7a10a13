"""Experiments and rules replayed over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import predicates, text
from vitrine.operators import experiments, fusion, sessions
from vitrine.plans import merchandising, search
from vitrine.queries.registry import VIEWS, query
from vitrine.queries.search import text_index
from vitrine.sources import bind

VIEWS.update(
    {
        "rules_v": """
SELECT n_nationkey AS n, 's' || (n_nationkey % 3) AS tenant, 'rule' || n_nationkey AS rule_id, n_nationkey % 4 AS kind,
  ['red', 'blue', 'hot', 'cold', 'small', 'large', 'old', 'new'][n_nationkey % 8 + 1] AS word,
  ['economy', 'small', 'promo', 'standard', 'medium', 'large'][n_nationkey % 6 + 1] AS ttype, n_nationkey % 24 AS sh, n_nationkey * 5 % 24 AS eh
FROM nation""",
        "rule_hits_v": """
SELECT q.query_id, q.tenant, lower(trim(q.query)) AS query, q.ts, r.* EXCLUDE (tenant) FROM (SELECT *,
  extract('hour' FROM ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris') AS h FROM requests_v) q JOIN rules_v r ON r.tenant = q.tenant
WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN contains(lower(trim(q.query)), word) WHEN 2 THEN lower(trim(q.query)) = ttype
  ELSE sh = eh OR (sh < eh AND h >= sh AND h < eh) OR (sh > eh AND (h >= sh OR h < eh)) END""",
        "exp_hits_v": """
SELECT q.query_id, q.tenant, q.session_id, lower(trim(q.query)) AS query, q.ts, r_regionkey AS n FROM (SELECT *,
  extract('hour' FROM ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Jerusalem') AS hj, extract('hour' FROM ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS hn
  FROM requests_v) q, region
WHERE CASE r_regionkey WHEN 0 THEN true WHEN 1 THEN contains(lower(query), 'red') OR contains(lower(query), 'blue')
  WHEN 2 THEN lower(trim(query)) = 'zzzz qqqq' WHEN 3 THEN (contains(query, 'ring') OR contains(query, 'widget')) AND (hj >= 22 OR hj < 6)
  ELSE hn >= 8 AND hn < 20 END""",
        "bucket_v": """
SELECT tenant, n, session_id, CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('exp' || n || ':' || session_id, ''),
  lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 10000 AS BIGINT) AS bucket
FROM (SELECT DISTINCT tenant, n, session_id FROM exp_hits_v)""",
        "arms_v": """
SELECT r_regionkey AS n, 2000 * (r_regionkey + 1) AS enrolled, place, key, w, sum(w) OVER (PARTITION BY r_regionkey) AS total,
  sum(w / (r_regionkey + 3 + r_regionkey % 2) * 2000 * (r_regionkey + 1)) OVER (PARTITION BY r_regionkey ORDER BY place) AS hi
FROM region, (SELECT unnest([0, 1, 2]) AS place, unnest(['control', 'variant', 'third']) AS key)
  , LATERAL (SELECT CAST(CASE place WHEN 0 THEN r_regionkey + 1 WHEN 1 THEN 2 ELSE r_regionkey % 2 END AS DOUBLE) AS w)""",
        "assigned_v": """
SELECT b.tenant, b.n, b.session_id, b.bucket, coalesce((SELECT a.key FROM arms_v a WHERE a.n = b.n AND b.bucket < a.hi ORDER BY a.place LIMIT 1), 'third') AS arm
FROM bucket_v b WHERE b.bucket < 2000 * (b.n + 1)""",
    }
)


def _experiments(spark, sf):
    return experiments.read_experiments(bind.experiments(spark, sf))


def _rule_hits(spark, sf):
    return experiments.rule_hits(bind.requests(spark, sf), experiments.read_rules(bind.rules(spark, sf)))


@query(
    "definition_tables",
    """SELECT tenant, 'rule' AS kind, rule_id AS id, CAST(CASE kind WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS patterns,
  CASE WHEN kind = 3 THEN 'Europe/Paris' END AS timezone, NULL AS traffic_pct, NULL AS arms FROM rules_v
UNION ALL SELECT 's' || s, 'experiment', 'exp' || r_regionkey, CASE r_regionkey WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END,
  CASE r_regionkey WHEN 3 THEN 'Asia/Jerusalem' WHEN 4 THEN 'America/New_York' END, 20.0::DOUBLE * (r_regionkey + 1), 'control,variant,third'
FROM region, (SELECT unnest([0, 1, 2]) AS s)""",
)
def definition_tables(spark, sf):
    """Rules and experiments of every store, one row each."""
    rules = experiments.read_rules(bind.rules(spark, sf)).select("tenant", F.explode("rules").alias("d"))
    tests = _experiments(spark, sf).select("tenant", F.explode("experiments").alias("d"))
    described = lambda target: (
        F.greatest(F.coalesce(F.size(f"{target}.patterns"), F.lit(0)), F.lit(0)).cast("long").alias("patterns"),
        F.col(f"{target}.timeWindow.timezone").alias("timezone"),
    )
    return rules.select(
        "tenant", F.lit("rule").alias("kind"), "d.id", *described("d.condition"), F.lit(None).cast("double").alias("traffic_pct"), F.lit(None).cast("string").alias("arms")
    ).unionByName(tests.select(
        "tenant", F.lit("experiment").alias("kind"), "d.id", *described("d.targeting"), F.col("d.trafficPct").alias("traffic_pct"),
        F.array_join("d.arms.key", ",").alias("arms"),
    ))


@query(
    "query_targeting",
    "SELECT q.tenant, q.query, r.rule_id FROM (SELECT DISTINCT tenant, lower(trim(query)) AS query FROM requests_v) q JOIN rules_v r ON r.tenant = q.tenant AND ((kind = 1 AND contains(q.query, word)) OR (kind = 2 AND q.query = ttype))",
)
def query_targeting(spark, sf):
    hits = _rule_hits(spark, sf)
    rules = experiments.read_rules(bind.rules(spark, sf)).select("tenant", F.explode("rules").alias("r"))
    rules = rules.filter("r.condition.mode = 'queryMatch'").select("tenant", F.col("r.id").alias("rule_id"))
    return hits.join(rules, ["tenant", "rule_id"], "left_semi").select("tenant", "query", "rule_id").distinct()


@query(
    "hour_targeting",
    """SELECT query_id, n, sh = eh OR (sh < eh AND h >= sh AND h < eh) OR (sh > eh AND (h >= sh OR h < eh)) AS matches
FROM (SELECT query_id, tenant, extract('hour' FROM ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris') AS h FROM requests_v) q
JOIN rules_v r ON r.tenant = q.tenant AND r.kind = 3""",
)
def hour_targeting(spark, sf):
    rules = experiments.read_rules(bind.rules(spark, sf)).select("tenant", F.explode("rules").alias("r"))
    windows = rules.filter("r.condition.timeWindow is not null").select(
        "tenant", F.expr("cast(substring(r.id, 5) as int)").alias("n"), "r.condition.timeWindow.*"
    )
    log = bind.requests(spark, sf).select("query_id", "tenant", "ts").join(windows, "tenant")
    ok = predicates.hour_matches(F.col("ts"), F.col("timezone"), F.col("startHour"), F.col("endHour"))
    return log.select("query_id", "n", ok.alias("matches"))


@query(
    "arm_bounds",
    """SELECT t.tenant, 'exp' || n AS experiment_id, key AS arm, round(hi - w / total * enrolled, 6) AS lo, round(CASE WHEN place = 2 THEN enrolled ELSE hi END, 6) AS hi
FROM arms_v, (SELECT unnest(['s0', 's1', 's2']) AS tenant) t""",
)
def arm_bounds(spark, sf):
    bounds = experiments.arm_bounds(_experiments(spark, sf))
    return bounds.select("tenant", "experiment_id", "arm", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("arm_assignment", "SELECT tenant, 'exp' || n AS experiment_id, session_id, bucket, arm FROM assigned_v")
def arm_assignment(spark, sf):
    rows = experiments.exposures(bind.requests(spark, sf), _experiments(spark, sf))
    return rows.select("tenant", "experiment_id", "session_id", "bucket", "arm")


@query(
    "experiment_exposures",
    """, f AS (SELECT tenant, n, session_id, min(ts) AS first_ts, count(*) AS requests FROM exp_hits_v GROUP BY ALL)
SELECT a.tenant, 'exp' || a.n AS experiment_id, a.session_id, a.arm, epoch_us(f.first_ts) AS first_us, f.requests
FROM assigned_v a JOIN f USING (tenant, n, session_id)""",
)
def experiment_exposures(spark, sf):
    rows = experiments.exposures(bind.requests(spark, sf), _experiments(spark, sf))
    return rows.select("tenant", "experiment_id", "session_id", "arm", F.unix_micros("first_ts").alias("first_us"), "requests")


@query(
    "rule_daily_counts",
    "SELECT tenant, rule_id, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS matches FROM rule_hits_v GROUP BY ALL",
)
def rule_daily_counts(spark, sf):
    counts = experiments.daily_counts(_rule_hits(spark, sf))
    return counts.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "effective_boosts",
    """SELECT tenant, query, slot, key, arg_max(v, n) AS value FROM (SELECT tenant, query, epoch_us(ts) // 900000000 AS slot, CAST(n % 5 AS VARCHAR) AS key, n / 100 AS v, n FROM rule_hits_v) GROUP BY ALL""",
)
def effective_boosts(spark, sf):
    boosts = experiments.effective_boosts(_rule_hits(spark, sf), "productBoosts", "tenant", "query", "slot")
    slot = F.floor(F.unix_seconds("slot") / 900).alias("slot")
    return boosts.select("tenant", "query", slot, "key", "value")


@query(
    "effective_multipliers",
    """SELECT tenant, query, slot, round(product(m), 6) AS multiplier FROM (SELECT DISTINCT tenant, query, epoch_us(ts) // 900000000 AS slot, n, 1 + n / 100 AS m FROM rule_hits_v WHERE n % 2 = 0) GROUP BY ALL""",
)
def effective_multipliers(spark, sf):
    rows = experiments.effective_multiplier(_rule_hits(spark, sf), "tenant", "query", "slot")
    return rows.select("tenant", "query", F.floor(F.unix_seconds("slot") / 900).alias("slot"), F.round("multiplier", 6).alias("multiplier"))


@query(
    "boosted_scores",
    """, always AS (SELECT tenant, arg_max(n / 100, n) AS b, CAST(n % 5 AS VARCHAR) AS id FROM rules_v WHERE kind = 0 GROUP BY tenant, n % 5),
s AS (SELECT tenant, word, arg_max(n / 100, n) AS b FROM rules_v WHERE kind = 0 GROUP BY tenant, word),
m AS (SELECT tenant, product(1 + n / 100) AS m FROM rules_v WHERE kind = 0 AND n % 2 = 0 GROUP BY tenant)
SELECT p.tenant, p.id, round(p.boost * coalesce(m.m, 1) + coalesce(a.b, 0) + coalesce(s.b, 0), 6) AS boosted_score
FROM products_v p LEFT JOIN always a ON a.tenant = p.tenant AND a.id = p.id LEFT JOIN s ON s.tenant = p.tenant AND s.word = split_part(p.name, ' ', 1) LEFT JOIN m ON m.tenant = p.tenant""",
)
def boosted_scores(spark, sf):
    """Catalog scores under the settings of the rules that always match."""
    rules = experiments.read_rules(bind.rules(spark, sf))
    hits = (
        rules.select("tenant", F.posexplode("rules").alias("place", "r"))
        .filter("r.condition is null")
        .select("tenant", F.lit("all").alias("query"), "place", F.col("r.patch").alias("patch"))
    )
    rows = bind.products(spark, sf).select("tenant", F.lit("all").alias("query"), "id", "soft_category", F.col("boost").alias("rrf"))
    keys = ["tenant", "query"]
    scored = experiments.boosted(
        rows,
        experiments.effective_boosts(hits, "productBoosts", *keys),
        experiments.effective_boosts(hits, "softCategoriesBoost", *keys),
        experiments.effective_multiplier(hits, *keys),
    )
    return scored.select("tenant", "id", F.round("boosted_score", 6).alias("boosted_score"))


@query(
    "association_pins",
    """, a AS (SELECT DISTINCT tenant, query, word, upper(ttype) AS cat, CASE WHEN n % 4 * 3 = 0 THEN 5 ELSE n % 4 * 3 END AS lim, rule_id FROM rule_hits_v WHERE n % 6 = 0)
SELECT tenant, query, rule_id, id, CAST(pin_position AS INTEGER) AS pin_position FROM (SELECT a.*, p.id, row_number() OVER (PARTITION BY a.tenant, a.query, a.rule_id ORDER BY p.boost DESC, p.id) AS pin_position
  FROM a JOIN shown_v p ON p.tenant = a.tenant AND (p.type = a.cat OR list_contains(p.soft_category, a.word))) WHERE pin_position <= lim""",
)
def association_pins(spark, sf):
    patched = _rule_hits(spark, sf).filter("patch.categoryAssociation is not null").select(
        "tenant", F.concat_ws("\u0001", "rule_id", "query").alias("query"),
        F.col("patch.categoryAssociation.categories").alias("categories"),
        F.col("patch.categoryAssociation.softCategories").alias("soft_categories"),
        F.col("patch.categoryAssociation.limit").alias("limit"),
    ).distinct()
    pins = experiments.association_pins(patched, bind.products(spark, sf))
    part = lambda n: F.split_part("query", F.lit("\u0001"), F.lit(n))
    return pins.select("tenant", part(2).alias("query"), part(1).alias("rule_id"), "id", "pin_position")


@query(
    "pin_override",
    """, ex AS (SELECT 's' || (p_partkey % 3) AS tenant, p_name AS query, p_partkey, row_number() OVER (PARTITION BY p_partkey % 3, p_name ORDER BY p_partkey DESC) AS pin_position FROM part),
e AS (SELECT tenant, upper(query) AS query, CAST(p_partkey AS VARCHAR) AS id FROM ex WHERE pin_position <= 3),
p AS (SELECT DISTINCT tenant, p_name AS query, CAST(unnest([n, n + 1]) AS VARCHAR) AS id FROM rules_v JOIN part ON starts_with(p_name, word) WHERE n % 5 = 0)
SELECT tenant, query, id, 'patch' AS origin FROM p UNION ALL
SELECT tenant, query, id, 'existing' FROM e WHERE (tenant, lower(query)) NOT IN (SELECT (tenant, lower(query)) FROM p)""",
)
def pin_override(spark, sf):
    existing = bind.name_pins(spark, sf).select("tenant", F.upper("query").alias("query"), "id")
    names = bind.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    rules = experiments.read_rules(bind.rules(spark, sf)).select("tenant", F.explode("rules").alias("r"))
    pins = rules.select("tenant", F.explode("r.patch.pinnedResults").alias("pin")).select(
        "tenant", F.col("pin.query").alias("word"), F.explode("pin.productIds").alias("id")
    )
    patch = pins.join(names.withColumn("word", F.split_part("name", F.lit(" "), F.lit(1))), "word").select(
        "tenant", F.col("name").alias("query"), "id"
    ).distinct()
    return experiments.pins_after_override(existing, patch)


@query(
    "alias_edges",
    "SELECT old_session_id, new_session_id, epoch_us(ts) AS first_us FROM aliases_v",
)
def alias_edges(spark, sf):
    raw = bind.session_aliases(spark, sf)
    again = raw.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    broken = raw.withColumn("new_session_id", F.col("old_session_id"))
    edges = sessions.alias_edges(raw.unionByName(again).unionByName(broken))
    return edges.select("old_session_id", "new_session_id", F.unix_micros("first_ts").alias("first_us"))


@query(
    "session_identity",
    """, chain(start_id, id, steps) AS (SELECT old_session_id, new_session_id, 1 FROM aliases_v UNION ALL
  SELECT c.start_id, a.new_session_id, c.steps + 1 FROM chain c JOIN aliases_v a ON a.old_session_id = c.id)
SELECT start_id AS old_session_id, arg_max(id, steps) AS session_id FROM chain GROUP BY start_id""",
)
def session_identity(spark, sf):
    return sessions.canonical_ids(sessions.alias_edges(bind.session_aliases(spark, sf)))


def _fused(spark, sf):
    """The fused pool of every different search."""
    log = bind.requests(spark, sf)
    asked = log.select("tenant", text.js_trim("query").alias("query"), F.coalesce("in_stock", F.lit(True)).alias("in_stock")).distinct()
    hits = search.retrieve(asked, bind.products(spark, sf, embedding=True), bind.query_vectors(spark, sf), text_index(spark, sf))
    part = lambda n: F.split_part("lane", F.lit("|"), F.lit(n))
    return fusion.fuse(*hits).select(
        part(1).alias("tenant"), (part(2) == "instock").alias("in_stock"), F.col("qid").alias("query"), "id", "rrf", "text_rank", "vector_rank"
    )


@query(
    "merchandised_results",
    """, h AS (SELECT DISTINCT tenant, query, epoch_us(ts) // 900000000 AS slot, rule_id FROM rule_hits_v),
s AS (SELECT DISTINCT tenant, query, setting FROM (SELECT tenant, query, slot, string_agg(rule_id, ',' ORDER BY rule_id) AS setting FROM h GROUP BY tenant, query, slot)),
m AS (SELECT s.tenant, s.query, s.setting, r.n, r.word, r.ttype FROM s JOIN rules_v r ON r.tenant = s.tenant AND list_contains(string_split(s.setting, ','), r.rule_id)),
pb AS (SELECT tenant, query, setting, CAST(n % 5 AS VARCHAR) AS id, arg_max(n / 100, n) AS b FROM m GROUP BY tenant, query, setting, n % 5),
sb AS (SELECT tenant, query, setting, word, arg_max(n / 100, n) AS b FROM m GROUP BY tenant, query, setting, word),
mu AS (SELECT tenant, query, setting, product(1 + n / 100) AS f FROM m WHERE n % 2 = 0 GROUP BY tenant, query, setting),
a AS (SELECT * FROM (SELECT m.*, p.id, row_number() OVER (PARTITION BY m.tenant, m.query, m.setting, m.n ORDER BY p.boost DESC, p.id) AS pin_position
  FROM m JOIN shown_v p ON p.tenant = m.tenant AND (p.type = upper(m.ttype) OR list_contains(p.soft_category, m.word)) WHERE m.n % 6 = 0)
  WHERE pin_position <= CASE WHEN n % 4 * 3 = 0 THEN 5 ELSE n % 4 * 3 END),
l AS (SELECT m.*, p.id, CASE WHEN p.id = CAST(n AS VARCHAR) THEN 1 ELSE 2 END AS pin_position FROM m JOIN shown_v p ON p.tenant = m.tenant
  AND p.id IN (CAST(n AS VARCHAR), CAST(n + 1 AS VARCHAR)) WHERE m.n % 5 = 0 AND m.word = m.query),
b AS (SELECT *, 1 AS kind FROM a UNION ALL SELECT *, 0 FROM l),
pins AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY tenant, query, setting ORDER BY n DESC, kind DESC) AS d FROM b) WHERE d = 1),
x AS (SELECT p.tenant, p.in_stock, p.query, s.setting, p.id, p.text_rank, p.vector_rank,
    round(p.rrf * coalesce(mu.f, 1) + coalesce(pb.b, 0) + coalesce(sb.b, 0), 9) AS boosted_score
  FROM pool_v p JOIN s ON s.tenant = p.tenant AND s.query = lower(p.query) JOIN products_v c ON c.id = p.id
  LEFT JOIN mu ON mu.tenant = s.tenant AND mu.query = s.query AND mu.setting = s.setting
  LEFT JOIN pb ON pb.tenant = s.tenant AND pb.query = s.query AND pb.setting = s.setting AND pb.id = p.id
  LEFT JOIN sb ON sb.tenant = s.tenant AND sb.query = s.query AND sb.setting = s.setting AND sb.word = split_part(c.name, ' ', 1)),
y AS (SELECT g.tenant, g.in_stock, g.query, g.setting, q.id, q.pin_position FROM (SELECT DISTINCT tenant, in_stock, query, setting FROM x) g
  JOIN pins q ON q.tenant = g.tenant AND q.query = lower(g.query) AND q.setting = g.setting)
SELECT tenant, in_stock, query, setting, id, pin_position IS NOT NULL AS pinned, boosted_score, row_number() OVER (PARTITION BY tenant, in_stock, query, setting
  ORDER BY pin_position NULLS LAST, boosted_score DESC NULLS LAST, text_rank NULLS LAST, vector_rank NULLS LAST, id) AS position
FROM x FULL OUTER JOIN y USING (tenant, in_stock, query, setting, id)""",
)
def merchandised_results(spark, sf):
    """Results of every search under each different set of rules that matched it."""
    hits = _rule_hits(spark, sf).withColumn("label", F.col("rule_id"))
    return merchandising.applied(_fused(spark, sf), bind.products(spark, sf), merchandising.settings(hits, "slot"))


@query(
    "experiment_results",
    """, h AS (SELECT DISTINCT e.tenant, e.query, e.session_id, epoch_us(e.ts) // 900000000 AS slot, 'exp' || e.n || ':' || a.arm AS label
  FROM exp_hits_v e JOIN assigned_v a USING (tenant, n, session_id)),
s AS (SELECT DISTINCT tenant, query, setting FROM (SELECT tenant, query, string_agg(label, ',' ORDER BY label) AS setting FROM h GROUP BY tenant, query, session_id, slot)),
m AS (SELECT tenant, query, setting, CAST(substr(label, 4, 1) AS BIGINT) AS n FROM (SELECT *, unnest(string_split(setting, ',')) AS label FROM s) WHERE label NOT LIKE '%:control'),
f AS (SELECT tenant, query, setting, product(1 + n / 10) AS f, max(n) + 1 AS red FROM m GROUP BY tenant, query, setting)
SELECT p.tenant, p.in_stock, p.query, s.setting, p.id, false AS pinned, boosted_score, row_number() OVER (PARTITION BY p.tenant, p.in_stock, p.query, s.setting
  ORDER BY boosted_score DESC, text_rank NULLS LAST, vector_rank NULLS LAST, p.id) AS position
FROM pool_v p JOIN s ON s.tenant = p.tenant AND s.query = lower(p.query) JOIN products_v c ON c.id = p.id
LEFT JOIN f ON f.tenant = s.tenant AND f.query = s.query AND f.setting = s.setting
LEFT JOIN m ON m.tenant = s.tenant AND m.query = s.query AND m.setting = s.setting AND CAST(m.n AS VARCHAR) = p.id,
LATERAL (SELECT round(p.rrf * coalesce(f.f, 1) + coalesce((m.n + 1) / 100, 0) + CASE WHEN split_part(c.name, ' ', 1) = 'red' THEN coalesce(f.red, 0) ELSE 0 END, 9) AS boosted_score)""",
)
def experiment_results(spark, sf):
    """Results of every search under each different set of arms that a session was served."""
    served = experiments.exposed(bind.requests(spark, sf), _experiments(spark, sf))
    return merchandising.applied(_fused(spark, sf), bind.products(spark, sf), merchandising.settings(served, "session_id", "slot"))
