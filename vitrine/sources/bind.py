"""Storefront views over the given tables.

Every view is a plain derivation of the parquet tables, so its size follows theirs. Timestamps are
stored without a zone and are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vitrine.session import pin_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _first_word(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def products(
    spark: SparkSession, sf_dir: str, description: bool = False, embedding: bool = False
) -> DataFrame:
    """The catalog. Description and vector are joined only for plans that use them."""
    part = table(spark, sf_dir, "part")
    key, word = F.col("p_partkey"), _first_word(F.col("p_name"))
    df = part.select(
        key,
        key.cast("string").alias("id"),
        F.concat(F.lit("s"), F.pmod(key, F.lit(3)).cast("string")).alias("tenant"),
        F.concat_ws(
            " ", "p_name", F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")))
        ).alias("name"),
        F.col("p_type").alias("type"),
        F.array("p_type").alias("category"),
        F.array(word, F.col("p_brand")).alias("soft_category"),
        F.when(word.isin("blue", "red"), F.array(word))
        .otherwise(F.array().cast("array<string>"))
        .alias("colors"),
        F.when(key % 17 != 0, F.col("p_retailprice")).alias("price"),
        F.when(key % 10 == 0, "outofstock").when(key % 10 != 1, "instock").alias("stock_status_canonical"),
        F.when(key % 20 == 1, "outofstock").alias("stock_status_legacy"),
        F.when(key % 23 == 0, True).when(key % 23 != 1, False).alias("hidden"),
        F.when(key % 7 == 0, F.array(F.lit("sale")))
        .otherwise(F.array().cast("array<string>"))
        .alias("special_sales"),
        F.col("p_size").cast("double").alias("boost"),
        F.concat(F.lit("https://shop.example/p/"), key.cast("string")).alias("url"),
        F.concat(F.lit("https://shop.example/i/"), key.cast("string")).alias("image"),
    )
    if description:
        docs = table(spark, sf_dir, "documents")
        # Spread on the join key, which a shuffled join needs anyway: the text work that follows
        # then runs in parallel however few files the catalog has.
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").join(
            docs.select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("description")),
            "p_partkey",
            "left",
        )
    if embedding:
        vectors = table(spark, sf_dir, "embeddings")
        df = df.join(
            vectors.select(F.col("vec_id").alias("p_partkey"), "embedding"), "p_partkey", "left"
        )
    return df.drop("p_partkey")


def events(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """The event log with its key parsed; ``source`` may be the same table as a stream."""
    df = table(spark, sf_dir, "events") if source is None else source
    return df.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("user_id").cast("string").alias("session_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def requests(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """The search log: views, with query text from the part the event points at."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        "p_name",
        F.concat_ws(
            " ", "p_name", F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")))
        ).alias("name"),
        F.lower("p_type").alias("type_text"),
        _first_word(F.col("p_name")).alias("word"),
    )
    log = events(spark, sf_dir, source).filter("event_type = 'view'").join(part, "k")
    variant, f = F.col("event_id") % 5, F.col("event_id") % 60
    no_list = F.lit(None).cast("array<string>")
    return log.select(
        F.col("event_id").alias("query_id"),
        F.concat(F.lit("s"), F.pmod("k", F.lit(3)).cast("string")).alias("tenant"),
        "session_id",
        "ts",
        "k",
        F.when(variant == 0, F.col("name"))
        .when(variant == 1, F.col("p_name"))
        .when(variant == 2, F.concat(F.substring("name", 1, 1), F.expr("substring(name, 3)")))
        .when(variant == 3, F.col("type_text"))
        .otherwise("zzzz qqqq")
        .alias("query"),
        F.when(f % 4 == 0, F.lit(920.0)).alias("price_min"),
        F.when(f % 6 == 0, F.lit(1050.0)).alias("price_max"),
        F.when(f % 12 == 1, F.array(F.substring("type_text", 1, 4))).otherwise(no_list).alias("categories"),
        F.when(f % 12 == 2, F.array(F.upper("word"))).otherwise(no_list).alias("tags"),
        F.when(f % 15 == 0, False).alias("in_stock"),
        F.when(f % 7 == 1, "price_asc").when(f % 7 == 2, "price_desc").alias("sort"),
        (f % 31).cast("int").alias("limit"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors keyed by (tenant, query): the vector of the lowest part asked for.

    Texts whose lowest part number ends in 2 have none, as when the embedding service fails.
    """
    keyed = requests(spark, sf_dir).groupBy("tenant", "query").agg(F.min("k").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return keyed.filter("vec_id % 10 <> 2").join(vectors, "vec_id").drop("vec_id")


def cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart additions: purchases, with the part ids both result tiers showed."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    ids = lambda low, high: F.expr(f"transform(sequence(k + {low}, k + {high}), x -> cast(x as string))")
    return e.select(
        "event_id",
        F.concat(F.lit("s"), F.pmod("k", F.lit(3)).cast("string")).alias("tenant"),
        "session_id",
        "ts",
        "k",
        F.concat(F.lit("query "), (F.col("k") % 20).cast("string")).alias("search_query"),
        (F.col("k") + F.col("event_id") % 9).cast("string").alias("product_id"),
        ids(0, 4).alias("search_results"),
        F.when(F.col("event_id") % 4 != 0, ids(3, 7)).alias("tier2_results"),
        F.col("value").alias("cart_total"),
    )


def clicks(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    return (
        events(spark, sf_dir, source)
        .filter("event_type = 'click'")
        .select(
            F.col("event_id").alias("click_id"),
            "session_id",
            F.col("k").cast("string").alias("product_id"),
            F.col("ts").alias("clicked_at"),
        )
    )


def rapid_orders(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Orders in the shoppers' own sessions (one line each), from purchases."""
    return (
        events(spark, sf_dir, source)
        .filter("event_type = 'purchase'")
        .select(
            F.col("event_id").alias("order_id"),
            "session_id",
            F.concat(F.lit("s"), F.pmod("k", F.lit(3)).cast("string")).alias("tenant"),
            F.col("k").cast("string").alias("product_id"),
            F.col("ts").alias("created_at"),
            F.col("value").alias("total_price"),
        )
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("query_id", "session_id", "ts", "query")


def order_deliveries(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Webhook deliveries: each order once, every tenth order a second time an hour later."""
    o = (table(spark, sf_dir, "orders") if source is None else source).withColumn("created_at", F.col("o_orderdate").cast("timestamp"))
    hours = F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    sent = o.withColumn("late", F.explode(hours)).withColumn(
        "received_at", F.col("created_at") + F.make_interval(hours=F.col("late"))
    )
    return sent.select(
        F.col("o_orderkey").alias("order_id"),
        F.concat(F.lit("s"), F.pmod("o_custkey", F.lit(3)).cast("string")).alias("tenant"),
        F.col("o_custkey").cast("string").alias("session_id"),
        "created_at",
        "received_at",
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_price"),
    )


def order_webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order JSON as the shop platform posts it; money is text, the session is a note."""
    o = table(spark, sf_dir, "orders")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("l_linenumber").alias("variant_id"),
                        F.col("l_partkey").alias("product_id"),
                        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
                        F.col("l_quantity").cast("long").alias("quantity"),
                        F.format_string("%.2f", "l_extendedprice").alias("price"),
                    )
                )
            ).alias("line_items")
        )
    )
    joined = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    body = F.struct(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("#"), F.col("o_orderkey").cast("string")).alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lit("ILS").alias("currency"),
        F.format_string("%.2f", "o_totalprice").alias("total_price"),
        F.struct(F.col("o_custkey").alias("id")).alias("customer"),
        "line_items",
        F.array(
            F.struct(F.lit("custom_note").alias("name"), F.lit("x").alias("value")),
            F.struct(F.lit("session_id").alias("name"), F.col("o_custkey").cast("string").alias("value")),
        ).alias("note_attributes"),
    )
    return joined.select(F.to_json(body).alias("body"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response log: one JSON payload per request, in every shape the storefront answers with.

    By query id modulo 6: object with products and tier counts, object with results, bare array,
    empty products, neither, complex object. The products are the five parts from k on.
    """
    p = products(spark, sf_dir)
    shown = (
        p.withColumn("number", F.col("id").cast("long"))
        .withColumn("k", F.explode(F.sequence(F.col("number") - 4, F.col("number"))))
        .groupBy("k")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "number",
                        "id",
                        "name",
                        "type",
                        "category",
                        F.col("soft_category").alias("softCategory"),
                        "price",
                        F.col("stock_status_canonical").alias("stockStatus"),
                        F.col("stock_status_legacy").alias("stock_status"),
                    )
                )
            ).alias("shown")
        )
    )
    log = requests(spark, sf_dir).select("query_id", "tenant", "session_id", "ts", "query", "k")
    shape = F.col("query_id") % 6
    sold_out = F.filter("shown", lambda x: F.coalesce(x["stockStatus"], F.lit("")) == "outofstock")
    tiers = F.struct(F.struct((F.col("query_id") % 3).alias("highTextMatches")).alias("tiers"))
    payload = (
        F.when(shape == 0, F.to_json(F.struct(F.col("shown").alias("products"), tiers.alias("metadata"))))
        .when(shape == 1, F.to_json(F.struct(F.col("shown").alias("results"))))
        .when(shape == 2, F.to_json("shown"))
        .when(shape == 3, F.to_json(F.struct(sold_out.alias("products"))))
        .when(shape == 4, F.lit('{"other":1}'))
        .otherwise(
            F.to_json(
                F.struct(
                    F.col("shown").alias("products"),
                    F.struct(F.lit(True).alias("isComplex")).alias("metadata"),
                )
            )
        )
    )
    return log.join(shown, "k").select("query_id", "tenant", "session_id", "ts", "query", payload.alias("payload"))


def chat_turns(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    c = table(spark, sf_dir, "conversations") if source is None else source
    return c.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.concat(F.lit("s"), F.pmod("conv_id", F.lit(3)).cast("string")).alias("tenant"),
        F.concat(F.lit("u"), (F.col("conv_id") % 40).cast("string")).alias("session_id"),
        F.col("turn"),
        F.expr(
            "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(conv_id as int),cast(turn as int),0)"
        ).alias("ts"),
        "role",
        "text",
    )


def model_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls behind assistant turns with their token counts."""
    size = F.length("text")
    return (
        chat_turns(spark, sf_dir)
        .filter("role = 'assistant'")
        .select(
            "conversation_id",
            "tenant",
            "session_id",
            "turn",
            "ts",
            size.cast("long").alias("prompt_tokens"),
            (size % 50).cast("long").alias("cached_tokens"),
            (F.col("turn") * 10).cast("long").alias("visible_tokens"),
            (F.col("conversation_id").cast("long") % 7).alias("thinking_tokens"),
        )
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call log with repeats: events as calls of 100 conversations, some without call id."""
    e = events(spark, sf_dir)
    return e.select(
        (F.col("event_id") % 100).cast("string").alias("conversation_id"),
        F.to_date("ts").alias("day"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string"))).alias("call_id"),
        F.col("event_type").alias("name"),
        (F.col("k") % 10).cast("string").alias("args"),
    )


def feedback(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    e = events(spark, sf_dir, source)
    kind = (
        F.when(F.col("event_type") == "click", "product_click")
        .when(F.col("event_type") == "purchase", "add_to_cart")
        .when(F.col("event_type") == "view", "opened")
        .when(F.col("event_type") == "signup", "helpful")
        .otherwise("unknown_event")
    )
    return e.select(
        (F.col("event_id") % 100).cast("string").alias("conversation_id"),
        kind.alias("event"),
        F.col("k").cast("string").alias("product_id"),
        F.col("ts").alias("at"),
    )


def conversation_writes(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """One write per chat turn: the state of the conversation after it."""
    return chat_turns(spark, sf_dir, source).select(
        "conversation_id",
        "tenant",
        F.when(F.col("conversation_id").cast("long") % 11 != 0, F.col("session_id")).alias("session_id"),
        F.concat(F.lit("query "), F.col("conversation_id")).alias("query"),
        F.when(F.col("conversation_id").cast("long") % 4 == 0, "no_results")
        .when(F.col("conversation_id").cast("long") % 4 == 1, "out_of_stock")
        .when(F.col("conversation_id").cast("long") % 4 == 2, "non_literal")
        .alias("reason"),
        (F.col("turn") + 1).alias("turns"),
        F.col("ts").alias("written_at"),
    )


def session_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey % 5 in (0, 1)").select(
        F.col("c_custkey").cast("string").alias("old_session_id"),
        (F.col("c_custkey") + 1).cast("string").alias("new_session_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(c_custkey as int),0)").alias("ts"),
    )


def phrased_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shopper phrasings with prices, categories and context words, one per event."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", F.lower("p_type").alias("t"))
    e = events(spark, sf_dir).join(part, "k")
    price = (F.col("k") + 50).cast("string")
    v = F.col("event_id") % 8
    text = (
        F.when(v == 0, F.col("p_name"))
        .when(v == 1, F.concat(F.col("t"), F.lit(" באיזור ה-"), price, F.lit(" שקל")))
        .when(v == 2, F.concat(F.col("p_name"), F.lit(" מ-"), price, F.lit(" עד 200")))
        .when(v == 3, F.concat(F.col("t"), F.lit(" for dinner around 100 shekel")))
        .when(v == 4, F.concat(price, F.lit(" to 300 "), F.col("p_name")))
        .when(v == 5, F.concat(F.col("p_name"), F.lit(" מתאים לארוחת ערב")))
        .when(v == 6, F.concat(F.lit("  "), F.col("t"), F.lit(" "), F.col("p_name")))
        .otherwise(F.concat(F.lit("יין ב-"), price))
    )
    return e.select(
        "event_id", F.concat(F.lit("s"), F.pmod("k", F.lit(3)).cast("string")).alias("tenant"), text.alias("query")
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shopper messages: chat turns, documents and benchmark texts, whole."""
    c = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        "text",
    )
    d = table(spark, sf_dir, "documents").select(
        F.concat_ws("-", F.lit("d"), F.col("doc_id").cast("string")).alias("message_id"), "text"
    )
    b = table(spark, sf_dir, "benchmark").select(
        F.concat_ws("-", F.lit("b"), F.col("item_id").cast("string")).alias("message_id"), "text"
    )
    return c.unionByName(d).unionByName(b)


def name_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant pins: for each two-word name of a store its three highest part numbers."""
    w = Window.partitionBy("tenant", "query").orderBy(F.desc("number"))
    return (
        products(spark, sf_dir)
        .select("tenant", F.expr("substring_index(name, ' ', 2)").alias("query"), "id", F.col("id").cast("long").alias("number"))
        .withColumn("pin_position", F.row_number().over(w))
        .filter("pin_position <= 3")
        .drop("number")
    )


def parked_triggers(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Triggers parked for conversations: some minutes before the first turn, some again at turn 2."""
    number = F.col("conversation_id").cast("long")
    early = F.col("ts") - F.make_interval(mins=(number % 45).cast("int"))
    return (
        chat_turns(spark, sf_dir, source)
        .filter((F.col("turn") == 0) | ((F.col("turn") == 2) & (number % 3 == 0)))
        .select(
            "conversation_id",
            F.when(F.col("turn") == 0, early).otherwise(F.col("ts")).alias("parked_at"),
            F.when(number % 4 == 0, "no_results").when(number % 4 == 1, "out_of_stock")
            .when(number % 4 == 2, "non_literal").otherwise("something_else").alias("trigger_reason"),
            F.concat(F.lit("q"), F.col("turn").cast("string")).alias("trigger_query"),
        )
    )


def _words(spark_column: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (spark_column % len(values) + 1).cast("int"))


RULE_WORDS = ["red", "blue", "hot", "cold", "small", "large", "old", "new"]
RULE_TYPES = ["economy", "small", "promo", "standard", "medium", "large"]


def _targeting(mode, patterns, match, zone=None, start=None, end=None) -> Column:
    none = F.lit(None).cast("string")
    window = F.when(
        F.lit(zone is not None),
        F.struct(
            F.lit(zone).cast("string").alias("timezone"),
            (F.lit(None) if start is None else start).cast("int").alias("startHour"),
            (F.lit(None) if end is None else end).cast("int").alias("endHour"),
        ),
    )
    return F.struct(
        (F.lit(mode) if mode else none).cast("string").alias("mode"),
        (F.array(*patterns) if patterns else F.lit(None)).cast("array<string>").alias("patterns"),
        (F.lit(match) if match else none).cast("string").alias("matchType"),
        window.alias("timeWindow"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment definitions as one JSON list per tenant, derived from the regions."""
    n = F.col("r_regionkey")
    lit = lambda *v: [F.lit(x) for x in v]
    targeting = (
        F.when(n == 1, _targeting("queryMatch", lit(" Red ", "blue"), "contains"))
        .when(n == 2, _targeting("queryMatch", lit("zzzz qqqq"), "exact"))
        .when(n == 3, _targeting("queryMatch", lit("ring", "widget"), "contains", "Asia/Jerusalem", F.lit(22), F.lit(6)))
        .when(n == 4, _targeting(None, None, None, "America/New_York", F.lit(8), F.lit(20)))
    )
    patch = F.struct(
        F.create_map(F.lit("red"), (n + 1).cast("double")).alias("softCategoriesBoost"),
        F.create_map(n.cast("string"), (n + 1) / 100).alias("productBoosts"),
        (1 + n / 10).alias("profileBoostMultiplier"),
    )
    arm = lambda key, weight, p: F.struct(F.lit(key).alias("key"), weight.cast("double").alias("weight"), p.alias("patch"))
    arms = F.array(arm("control", n + 1, F.when(F.lit(False), patch)), arm("variant", F.lit(2), patch), arm("third", n % 2, patch))
    definition = F.struct(
        F.concat(F.lit("exp"), n.cast("string")).alias("id"),
        (20.0 * (n + 1)).alias("trafficPct"),
        arms.alias("arms"),
        targeting.alias("targeting"),
    )
    every = table(spark, sf_dir, "region").withColumn("tenant", F.explode(F.array(*lit("s0", "s1", "s2"))))
    return _listed(every, n, definition, F.col("tenant"), "experiments")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchandising rules as one JSON list per tenant, derived from the nations."""
    n = F.col("n_nationkey")
    word, kind = _words(n, RULE_WORDS), _words(n, RULE_TYPES)
    condition = (
        F.when(n % 4 == 1, _targeting("queryMatch", [word], "contains"))
        .when(n % 4 == 2, _targeting("queryMatch", [kind], "exact"))
        .when(n % 4 == 3, _targeting(None, None, None, "Europe/Paris", n % 24, n * 5 % 24))
    )
    pin = F.struct(word.alias("query"), F.array(n.cast("string"), (n + 1).cast("string")).alias("productIds"), F.lit(True).alias("enabled"))
    association = F.struct(
        F.array(word).alias("softCategories"), F.array(F.upper(kind)).alias("categories"), (n % 4 * 3).cast("int").alias("limit")
    )
    patch = F.struct(
        F.create_map(word, n / 100).alias("softCategoriesBoost"),
        F.when(n % 5 == 0, F.array(pin)).alias("pinnedResults"),
        F.create_map((n % 5).cast("string"), n / 100).alias("productBoosts"),
        F.when(n % 2 == 0, 1 + n / 100).alias("profileBoostMultiplier"),
        F.when(n % 6 == 0, association).alias("categoryAssociation"),
    )
    definition = F.struct(F.concat(F.lit("rule"), n.cast("string")).alias("id"), condition.alias("condition"), patch.alias("patch"))
    tenant = F.concat(F.lit("s"), (n % 3).cast("string"))
    return _listed(table(spark, sf_dir, "nation"), n, definition, tenant, "rules")


def _listed(rows: DataFrame, order: Column, definition: Column, tenant: Column, name: str) -> DataFrame:
    entries = rows.select(tenant.alias("tenant"), F.struct(order.alias("place"), definition.alias("d")).alias("e"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col("e.place"), F.to_json("e.d").alias("j")))), lambda x: x["j"])
    return entries.groupBy("tenant").agg(
        F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias(name)
    )


def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of an external review for every third request; every fifth is turned down."""
    q = F.col("query_id")
    return requests(spark, sf_dir).filter(q % 3 == 0).select("query_id", (q % 5 != 0).alias("should_trigger"))
