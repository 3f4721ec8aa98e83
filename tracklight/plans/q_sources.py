"""Queries: parsers, merges, universes, read views, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklight.functions import tables
from tracklight.operators import outcomes as oc
from tracklight.operators import sinks, views
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_signals as qs
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY
from tracklight.sources import adapters, parsers
from tracklight.streaming import events as stream

AT = qo.AS_OF_US


def raw_transactions(spark, sf_dir):
    """Landed transaction JSON made of lineitem and orders: the customer pays, the part is the token, returns go out.

    By line number: 2 failed if it is of status A, 3 has a fraction of a second, 4 states no amount, 5 moves a quote
    only, 6 moves nothing, 7 has a time that is no number. Types are SWAP or UNKNOWN.
    """
    line, orders = adapters.read(spark, sf_dir, "lineitem"), adapters.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    payer, mint, n = F.col("o_custkey").cast("string"), F.concat(F.lit("mint"), F.col("l_partkey").cast("string")), F.col("l_linenumber")
    sold = F.col("l_returnflag") == "R"
    amount = F.when(n != 4, F.col("l_quantity"))
    move = lambda m, out: F.struct(m.alias("mint"), amount.alias("tokenAmount"), F.when(out, payer).otherwise("pool").alias("fromUserAccount"), F.when(out, "pool").otherwise(payer).alias("toUserAccount"))
    quote = move(F.lit(parsers.QUOTE_MINTS[0]), ~sold)
    body = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("signature"), F.when(F.col("l_linestatus") == "F", "SWAP").otherwise("UNKNOWN").alias("type"), payer.alias("feePayer"),
        F.when(n == 6, F.array().cast("array<struct<mint:string,tokenAmount:double,fromUserAccount:string,toUserAccount:string>>")).when(n == 5, F.array(quote)).otherwise(F.array(quote, move(mint, sold))).alias("tokenTransfers"),
        F.when((n == 2) & (F.col("l_returnflag") == "A"), F.struct(F.lit(3).alias("InstructionError"))).alias("transactionError"),
    )
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("string")
    time = F.when(n == 7, '"soon"').when(n == 3, F.concat(seconds, F.lit(".5"))).otherwise(seconds)
    return joined.select(F.concat(F.lit('{"timestamp":'), time, F.lit(","), F.substring(F.to_json(body), 2, 2**31 - 1)).alias("raw"))


@query(
    "parse_tx_swaps",
    """SELECT event_type, side, asset_id, actor, flags, count(*) AS n, sum(q)::DOUBLE AS amount, sum(us)::BIGINT AS us FROM (
  SELECT CASE WHEN swap THEN 'swap' ELSE 'unknown_interaction' END AS event_type, CASE WHEN swap THEN CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END END AS side,
    CASE WHEN swap THEN 'solana:mint' || l_partkey::VARCHAR END AS asset_id, o_custkey::VARCHAR AS actor, CASE WHEN swap AND l_linenumber <> 4 THEN l_quantity END AS q,
    CASE WHEN NOT swap THEN 'unparsed_instruction' WHEN l_linenumber = 4 THEN 'partial_parse,missing_price' ELSE 'missing_price' END AS flags,
    epoch_us(l_shipdate) + CASE WHEN l_linenumber = 3 THEN 500000 ELSE 0 END AS us
  FROM (SELECT *, l_linenumber NOT IN (5, 6) AS swap FROM lineitem) JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 7 AND NOT (l_linenumber = 2 AND l_returnflag = 'A')) GROUP BY ALL""",
)
def parse_tx_swaps(spark, sf_dir):
    parsed = parsers.transactions(raw_transactions(spark, sf_dir), observation_lag_seconds=5).withColumn("flags", F.array_join("quality_flags", ","))
    return parsed.groupBy("event_type", "side", "asset_id", "actor", "flags").agg(F.count(F.lit(1)).alias("n"), F.sum("token_amount").cast("double").alias("amount"), F.sum(F.unix_micros("chain_time")).alias("us"))


@query(
    "parse_pool_listing",
    "SELECT 'solana:' || p_partkey::VARCHAR AS asset_id, p_brand AS symbol, p_retailprice AS liquidity_usd, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS volume_24h, 1704067200000000 + p_partkey * 60000000 AS created_us FROM part WHERE p_size % 7 <> 0",
)
def parse_pool_listing(spark, sf_dir):
    part, key = adapters.read(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    symbol = F.when(F.col("p_size") % 7 == 0, "usdc").otherwise(F.col("p_brand"))
    created = F.date_format(F.timestamp_seconds(1704067200 + F.col("p_partkey") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    volume = F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    attributes = F.struct(F.concat(F.lit("pool"), key).alias("address"), F.concat(symbol, F.lit(" / SOL")).alias("name"), F.col("p_retailprice").cast("string").alias("reserve_in_usd"), F.struct(volume.alias("h24")).alias("volume_usd"), created.alias("pool_created_at"))
    item = F.struct(F.concat(F.lit("solana_"), key).alias("id"), attributes.alias("attributes"), F.struct(F.struct(F.struct(F.concat(F.lit("solana_"), key).alias("id")).alias("data")).alias("base_token")).alias("relationships"))
    raw = part.select(F.to_json(F.struct(F.array(item).alias("data"))).alias("raw"))
    return parsers.pools(raw).select("asset_id", "symbol", "liquidity_usd", "volume_24h", F.unix_micros("created_at").alias("created_us"))


@query("parse_ohlcv", sql.with_(sql.CANDLES_K) + "SELECT asset_id, s AS us, close, volume FROM cd")
def parse_ohlcv(spark, sf_dir):
    candles = adapters.clickstream_candles(spark, sf_dir)
    row = F.array(F.unix_seconds("start").cast("string"), *[F.col("close").cast("string")] * 4, F.col("volume").cast("string"))
    broken = F.array(F.lit("soon"), F.lit("1"))
    body = F.struct(F.struct(F.struct(F.array(row, broken).alias("ohlcv_list")).alias("attributes")).alias("data"))
    return parsers.candles_of_arrays(candles.select("asset_id", F.to_json(body).alias("raw"))).select("asset_id", F.unix_micros("start").alias("us"), "close", "volume")


@query("parse_ohlcv_objects", sql.with_(sql.CANDLES_K) + "SELECT asset_id, s AS us, close, CASE WHEN (s // 1000000) % 43200 = 0 THEN 0 ELSE volume END AS volume FROM cd")
def parse_ohlcv_objects(spark, sf_dir):
    candles, seconds = adapters.clickstream_candles(spark, sf_dir), F.unix_seconds("start")
    item = F.struct(seconds.alias("unixTime"), *[F.col("close").alias(n) for n in "ohlc"], F.when(seconds % 43200 != 0, F.col("volume")).alias("v"))
    body = F.struct(F.lit(True).alias("success"), F.struct(F.array(item).alias("items")).alias("data"))
    return parsers.candles_of_objects(candles.select("asset_id", F.to_json(body).alias("raw"))).select("asset_id", F.unix_micros("start").alias("us"), "close", "volume")


@query("parse_token_listing", "SELECT 'solana:m' || p_partkey::VARCHAR AS asset_id, p_brand AS symbol, p_retailprice AS volume_24h, (1704067200 + p_partkey) * 1000000 AS created_us FROM part")
def parse_token_listing(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part")
    even, price, at = F.col("p_partkey") % 2 == 0, F.col("p_retailprice").cast("string"), 1704067200 + F.col("p_partkey")
    token = F.struct(
        F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("address"), F.col("p_brand").alias("symbol"), F.when(even, price).otherwise("0").alias("v24hUSD"), F.when(~even, price).alias("volume24hUSD"),
        F.when(even, (at * 1000).cast("string")).otherwise(at.cast("string")).alias("createdAt"),
    )
    raw = part.select(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(token).alias("tokens")).alias("data"))).alias("raw"))
    return parsers.tokens(raw).select("asset_id", "symbol", "volume_24h", F.unix_micros("created_at").alias("created_us"))


def deliveries(spark, sf_dir):
    """Events delivered by order and line: keys repeat, and the last delivery says what became of them."""
    line = adapters.read(spark, sf_dir, "lineitem")
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"), F.lit("swap").alias("event_type"), F.col("l_suppkey").cast("string").alias("actor"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("asset_id"),
        F.when(F.col("l_quantity") < 2, F.lit(-1.0)).otherwise(F.col("l_extendedprice")).alias("usd_value"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000 + F.col("l_partkey") % 1000).alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"), F.when(F.col("l_returnflag") == "R", "reverted").when(F.col("l_returnflag") == "A", "confirmed").otherwise("finalized").alias("finality"),
    )


DELIVERIES = """
dl AS (
  SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS event_id, l_suppkey::VARCHAR AS actor, 'part:' || l_partkey::VARCHAR AS asset_id, CASE WHEN l_quantity < 2 THEN -1.0 ELSE l_extendedprice END AS usd_value,
    epoch_us(l_shipdate) * 1000 + l_partkey % 1000 AS seq, CASE l_returnflag WHEN 'R' THEN 'reverted' WHEN 'A' THEN 'confirmed' ELSE 'finalized' END AS finality
  FROM lineitem
), gd AS (SELECT * FROM dl WHERE usd_value >= 0)"""


@query("event_upsert", sql.with_(DELIVERIES) + "SELECT event_id, min(seq) AS seq, arg_max(finality, struct_pack(a := seq, b := finality)) AS finality FROM gd GROUP BY 1")
def event_upsert(spark, sf_dir):
    """The stored table holds what was shipped in the first half; the rest arrives as a batch that overlaps it."""
    good, _ = sinks.split_dead_letters(deliveries(spark, sf_dir))
    cut = F.lit("1995-06-01").cast("timestamp")
    empty = good.limit(0)
    stored = sinks.upsert_events(empty, good.where(F.col("observed_at") < cut), "seq")
    return sinks.upsert_events(stored, good.where(F.col("observed_at") >= cut), "seq").select("event_id", "seq", "finality")


@query("dead_letters", sql.with_(DELIVERIES) + "SELECT 'negative value' AS error, count(*) AS n FROM dl WHERE usd_value < 0 HAVING count(*) > 0")
def dead_letters(spark, sf_dir):
    _, bad = sinks.split_dead_letters(deliveries(spark, sf_dir))
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("asset_dimension", sql.with_(sql.EVENTS) + "SELECT asset_id, 'k' AS network, substr(asset_id, 3) AS address, min(us) AS first_us, arg_min(event_type, us) FILTER (event_type = 'swap') AS symbol, max(length(asset_id)::INTEGER) FILTER (event_type = 'swap') AS decimals FROM ev WHERE asset_id IS NOT NULL GROUP BY 1")
def asset_dimension(spark, sf_dir):
    swap = F.col("event_type") == "swap"
    events = adapters.clickstream_events(spark, sf_dir).withColumns({"symbol": F.when(swap, F.col("event_type")), "decimals": F.when(swap, F.length("asset_id"))})
    cut = qo.as_of()
    empty = spark.createDataFrame([], "asset_id string, network string, address string, symbol string, decimals int, first_seen_at timestamp")
    old = sinks.asset_dimension(empty, events.where(F.col("observed_at") >= cut))
    found = sinks.asset_dimension(old.drop("network", "address"), events.where(F.col("observed_at") < cut))
    return found.select("asset_id", "network", "address", F.unix_micros("first_seen_at").alias("first_us"), "symbol", "decimals")


@query(
    "universe_merge",
    "WITH u AS (SELECT 0 AS r, p_partkey AS k, p_retailprice AS v FROM part WHERE p_size > 40 UNION ALL SELECT 1, p_partkey, p_size FROM part WHERE p_size > 20 UNION ALL SELECT 2, p_partkey, 1 FROM part) SELECT 'part:' || k::VARCHAR AS asset_id, arg_min(v, r) AS volume_24h FROM u GROUP BY k",
)
def universe_merge(spark, sf_dir):
    part = adapters.read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("asset_id"), "p_retailprice", "p_size")
    of = lambda df, v: df.select("asset_id", v.cast("double").alias("volume_24h"))
    return sinks.merge_universe(of(part.where("p_size > 40"), F.col("p_retailprice")), of(part.where("p_size > 20"), F.col("p_size")), of(part, F.lit(1)))


@query("tradable_universe", sql.with_(sql.CANDLES_PART) + "SELECT asset_id, round(peak, 4) AS peak_volume, last < 0.05 * peak AS dead FROM (SELECT asset_id, max(volume) AS peak, arg_max(volume, s) AS last FROM cd GROUP BY 1) WHERE peak >= 50000")
def tradable_universe(spark, sf_dir):
    return sinks.tradable(adapters.market_candles(spark, sf_dir)).select("asset_id", F.round("peak_volume", 4).alias("peak_volume"), "dead")


SUSPECTS = f"SELECT DISTINCT actor FROM oc JOIN ev ON ev.asset_id = oc.asset_id AND us < t0 AND us >= t0 - {30 * DAY} WHERE event_type = 'swap' AND side = 'buy'"


@query("suspects", sql.with_(sql.EVENTS, sql.CANDLES_K, sql.outcomes(qo.K)) + SUSPECTS)
def suspects(spark, sf_dir):
    return sinks.suspects(adapters.clickstream_events(spark, sf_dir), oc.detect_all(adapters.clickstream_candles(spark, sf_dir), qo.K))[0]


@query("suspects_budget", sql.with_(sql.EVENTS, sql.CANDLES_K, sql.outcomes(qo.K)) + SUSPECTS + " ORDER BY actor LIMIT 150")
def suspects_budget(spark, sf_dir):
    """As a paid source of histories would bound them."""
    return sinks.suspects(adapters.clickstream_events(spark, sf_dir), oc.detect_all(adapters.clickstream_candles(spark, sf_dir), qo.K), limit=150)[0]


@query("trailing_volume", sql.with_(sql.CANDLES_PART) + "SELECT asset_id, s AS us, round(sum(volume) OVER (PARTITION BY asset_id ORDER BY s ROWS 23 PRECEDING), 4) AS trailing_volume FROM cd")
def trailing_volume(spark, sf_dir):
    return views.trailing_volume(adapters.market_candles(spark, sf_dir)).select("asset_id", F.unix_micros("start").alias("us"), F.round("trailing_volume", 4).alias("trailing_volume"))


@query("asset_page", sql.with_(*qs.TRACKED_PARTS) + """, f AS (SELECT actor, min(us) AS first_us, sum(usd_value) AS usd FROM ev WHERE asset_id = 'k:7' AND side IN ('buy', 'long') GROUP BY 1), m AS (SELECT min(t0) AS t0 FROM o WHERE asset_id = 'k:7')
SELECT actor, first_us, round(usd, 4) AS usd_value, archetype FROM f, m LEFT JOIN tr ON wallet = actor WHERE t0 IS NULL OR first_us < t0 ORDER BY first_us, actor LIMIT 50""")  # fmt: skip
def asset_page(spark, sf_dir):
    found = views.asset_page(adapters.clickstream_events(spark, sf_dir), qo.k_outcomes(spark, sf_dir), qs.tracked(spark, sf_dir), "k:7")
    return found.select("actor", F.unix_micros("first_at").alias("first_us"), F.round("usd_value", 4).alias("usd_value"), "archetype")


@query("signal_evidence", sql.with_(*qs.TRACKED_PARTS, qs.ACTIONS) + "SELECT event_id, actor, event_type, us AS event_us, usd_value FROM act_s WHERE sig >= 0.25")
def signal_evidence(spark, sf_dir):
    found = views.signal_evidence(qs.k_actions(spark, sf_dir), adapters.clickstream_events(spark, sf_dir))
    return found.select("event_id", "actor", "event_type", F.unix_micros("event_at").alias("event_us"), "usd_value")


def workspace(spark):
    """A new folder that driver and executors share."""
    return tables.new_path(spark, "stream")


def event_stream(spark, sf_dir, batch=False):
    """The driver's events as a stream, or at once, of canonical events with a finality."""
    schema = adapters.read(spark, sf_dir, "events").schema
    kind = F.col("event_type")
    reader = spark.read if batch else spark.readStream
    source = reader.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    side = F.when(kind == "purchase", "buy").when(kind == "click", "sell").when(kind.isin("view", "signup"), "long")
    return source.select(
        F.col("event_id").cast("string").alias("event_id"), F.when(F.col("user_id") % 11 == 0, "unheard").otherwise("swap").alias("event_type"), F.col("ts").cast("timestamp").alias("observed_at"), F.when(kind == "error", "reverted").otherwise("finalized").alias("finality"),
        F.col("user_id").cast("string").alias("actor"), F.concat(F.lit("k:"), F.get_json_object("props", "$.k")).alias("asset_id"), side.alias("side"), F.col("value").alias("usd_value"),
    )


@query("stream_dedupe", "SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type = 'error' THEN 'reverted' ELSE 'finalized' END AS finality FROM events WHERE user_id % 11 <> 0")
def stream_dedupe(spark, sf_dir):
    """Intake of a stream into a table: the table after everything has arrived; rows of an unknown type are dead letters."""
    path = workspace(spark)
    stream.ingest(stream.deduplicated(event_stream(spark, sf_dir), "40 days"), f"{path}/table", f"{path}/state").awaitTermination()
    return stream.current(spark, f"{path}/table").select("event_id", "finality")


@query(
    "stream_late_finality",
    "SELECT event_id::VARCHAR AS event_id, CASE WHEN event_type = 'error' THEN 'reverted' ELSE 'finalized' END AS finality, value AS usd_value, user_id % 11 = 0 AS dead FROM events",
)
def stream_late_finality(spark, sf_dir):
    """Every row is delivered twice, first as pending, then with other values and its finality, in batches of their own; then a base is written and the first batch comes again."""
    path = workspace(spark)
    rows = event_stream(spark, sf_dir, batch=True)
    write = stream.table_writer(spark, path)
    first = rows.withColumn("finality", F.lit("pending"))
    write(first.unionByName(first), 0)
    write(rows.withColumn("usd_value", F.lit(0.0)), 1)
    stream.compact(spark, path)
    write(first.limit(0), 2)
    write(rows.limit(0), 2)
    good = stream.current(spark, path).select("event_id", "finality", "usd_value", F.lit(False).alias("dead"))
    bad = spark.read.parquet(f"{path}/dead/1").select("event_id", "finality").join(spark.read.parquet(f"{path}/dead/0").select("event_id", "usd_value").distinct(), "event_id")
    return good.unionByName(bad.select("event_id", "finality", "usd_value", F.lit(True).alias("dead")))


@query(
    "stream_watched",
    "SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS actor FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 4)) AND (user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR epoch_us(ts) >= "
    f"{1_704_067_200_000_000 + 15 * DAY})",
)
def stream_watched(spark, sf_dir):
    """Events of watched actors, half a month per stream; in between a nation is added to the list, and a batch comes again."""
    path, half = workspace(spark), F.timestamp_micros(F.lit(1_704_067_200_000_000 + 15 * DAY))
    customers = adapters.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("actor"), "c_nationkey")
    write, rows = stream.watch(f"{path}/out", f"{path}/lists"), event_stream(spark, sf_dir)
    for version, part in enumerate((F.col("observed_at") < half, F.col("observed_at") >= half)):
        customers.where(F.col("c_nationkey").between(3, 3 + version)).select("actor").write.parquet(f"{path}/lists/version={version}")
        run = lambda batch, n, v=version: write(batch, 100 * v + n)
        rows.where(part).writeStream.foreachBatch(run).option("checkpointLocation", f"{path}/state{version}").trigger(availableNow=True).start().awaitTermination()
    write(event_stream(spark, sf_dir, batch=True).where(F.col("observed_at") < half), 0)  # takes the list that it took before
    return stream.written(spark, f"{path}/out").select("event_id", "actor")


@query(
    "stream_window_accumulation",
    f"SELECT e AS window_end, 'k:' || (props->>'$.k') AS asset_id, count(*) AS buys, count(DISTINCT user_id) AS buyers, round(sum(value), 4) AS net_usd FROM (SELECT *, unnest(range((epoch_us(ts) // {DAY} + 1) * {DAY}, (epoch_us(ts) // {DAY} + 15) * {DAY}, {DAY})) AS e FROM events WHERE event_type = 'purchase') WHERE e <= (SELECT max(epoch_us(ts)) FROM events WHERE event_type = 'purchase') - {DAY} GROUP BY 1, 2",
)
def stream_window_accumulation(spark, sf_dir):
    path = workspace(spark)
    found = stream.trailing_buyers(event_stream(spark, sf_dir)).select(F.unix_micros("window_end").alias("window_end"), "asset_id", "buys", "buyers", F.round("net_usd", 4).alias("net_usd"))
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")
