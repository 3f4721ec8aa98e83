"""Landed JSON to canonical rows. Schemas are declared; what does not fit is null or dropped, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklight.functions import scalars as fn

TRANSACTION = (
    "signature string, timestamp double, slot bigint, type string, source string, feePayer string, transactionError string, "
    "tokenTransfers array<struct<mint:string,tokenAmount:string,fromUserAccount:string,toUserAccount:string>>"
)
NO_ERROR = ("", "{}", "[]", "0", "false")
# Mints of the tokens that others are priced in.
QUOTE_MINTS = ("So11111111111111111111111111111111111111112", "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB")
QUOTE_SYMBOLS = ("SOL", "USDC", "USDT", "WSOL")


def once(value: Column) -> Column:
    """``value``, computed once per row however many columns and filters read it: nothing is inlined through a generator."""
    return F.explode(F.array(value))


def transactions(raw: DataFrame, body: str = "raw", subject: str | None = None, observation_lag_seconds: int | None = None, quotes=QUOTE_MINTS) -> DataFrame:
    """Canonical events of raw transaction JSON, at most one per transaction.

    Rows without signature, numeric time or actor, and failed transactions, are dropped; times may be fractions. A
    transaction is a swap if its fee payer received (buy), or else sent (sell), a token other than a quote, whatever
    type it is said to be; all else is unknown_interaction. The actor is the column ``subject`` if given, else the
    fee payer. Amounts are exact decimals, and null where none is stated. Observation is now, or chain time plus a lag.
    """
    tx = raw.select("*", once(F.from_json(body, TRANSACTION)).alias("tx"))
    actor = F.coalesce(F.nullif(F.col(subject), F.lit("")), F.col("tx.feePayer")) if subject else F.col("tx.feePayer")
    payer, moves = F.col("tx.feePayer"), F.coalesce("tx.tokenTransfers", F.array().cast("array<struct<mint:string,tokenAmount:string,fromUserAccount:string,toUserAccount:string>>"))
    came, went = lambda t: t["toUserAccount"].eqNullSafe(payer), lambda t: t["fromUserAccount"].eqNullSafe(payer)
    other = lambda t: F.coalesce((t["mint"] != "") & ~t["mint"].isin(*quotes), F.lit(False))
    legs = F.struct(F.get(F.filter(moves, lambda t: other(t) & came(t)), 0).alias("inbound"), F.get(F.filter(moves, lambda t: other(t) & ~came(t) & went(t)), 0).alias("outbound"))
    inbound = F.col("legs.inbound")
    leg = F.coalesce(inbound, F.col("legs.outbound"))
    is_swap = leg.isNotNull()
    amount = fn.to_decimal(leg["tokenAmount"])
    seconds = F.col("tx.timestamp")
    chain = F.timestamp_seconds(seconds)
    seen = F.current_timestamp() if observation_lag_seconds is None else F.timestamp_seconds(seconds + observation_lag_seconds)
    flags = F.when(is_swap, F.array_compact(F.array(F.when(amount.isNull(), "partial_parse"), F.lit("missing_price")))).otherwise(F.array(F.lit("unparsed_instruction")))
    kind = F.when(is_swap, "swap").otherwise("unknown_interaction")
    failed = ~F.coalesce(F.col("tx.transactionError").isin(*NO_ERROR), F.lit(True))
    ok = F.coalesce((F.col("tx.signature") != "") & seconds.isNotNull() & (actor != "") & ~failed, F.lit(False))
    return tx.where(ok).select("*", once(legs).alias("legs")).select(
        fn.event_key("solana", F.col("tx.signature"), kind, 0).alias("event_id"), kind.alias("event_type"), F.col("tx.signature").alias("transaction_id"), chain.alias("chain_time"),
        F.greatest(seen, chain).alias("observed_at"), F.lit("finalized").alias("finality"), actor.alias("actor"), F.when(is_swap, fn.asset_id("solana", leg["mint"])).alias("asset_id"),
        F.when(is_swap, F.when(inbound.isNotNull(), "buy").otherwise("sell")).alias("side"), F.when(is_swap, amount).alias("token_amount"), flags.alias("quality_flags"),
    )


POOL = (
    "data array<struct<id:string,attributes:struct<address:string,name:string,reserve_in_usd:string,volume_usd:struct<h24:string>,pool_created_at:string>,"
    "relationships:struct<base_token:struct<data:struct<id:string>>>>>"
)


def pools(raw: DataFrame, body: str = "raw") -> DataFrame:
    """Universe rows of pool-listing pages; pools of quote tokens are left out."""
    item = raw.select(F.explode(F.from_json(body, POOL)["data"]).alias("p"))
    base = F.col("p.relationships.base_token.data.id")
    symbol = F.trim(F.split_part(F.col("p.attributes.name"), F.lit("/"), F.lit(1)))
    token = F.when(F.instr(base, "_") > 0, F.substring_index(base, "_", -1))
    return item.where(token.isNotNull() & F.col("p.attributes.address").isNotNull() & ~F.upper(symbol).isin(*QUOTE_SYMBOLS)).select(
        fn.asset_id(F.substring_index(base, "_", 1), token).alias("asset_id"), F.col("p.attributes.address").alias("pool"), symbol.alias("symbol"), F.col("p.attributes.reserve_in_usd").try_cast("double").alias("liquidity_usd"),
        F.col("p.attributes.volume_usd.h24").try_cast("double").alias("volume_24h"), fn.parse_utc(F.col("p.attributes.pool_created_at")).alias("created_at"),
    )


TOKEN = "success boolean, data struct<tokens:array<map<string,string>>>"


def first_of(row: Column, *names: str) -> Column:
    """The first of several names of a field that has a value other than nothing and 0."""
    return F.coalesce(*[F.when(~row[n].isin("", "0", "null", "false"), row[n]) for n in names])


def any_timestamp(value: Column) -> Column:
    """Seconds, milliseconds or ISO text as a timestamp."""
    number = value.try_cast("double")
    return F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number)).otherwise(F.try_to_timestamp(value))


def tokens(raw: DataFrame, body: str = "raw", network: str = "solana") -> DataFrame:
    """Universe rows of token-listing pages, whose fields go by several names."""
    item = raw.select(F.from_json(body, TOKEN).alias("b")).where("b.success").select(F.explode("b.data.tokens").alias("t"))
    t = F.col("t")
    address = first_of(t, "address", "mint")
    return item.where(address.isNotNull()).select(
        fn.asset_id(network, address).alias("asset_id"), first_of(t, "symbol").alias("symbol"), first_of(t, "liquidity").try_cast("double").alias("liquidity_usd"),
        first_of(t, "v24hUSD", "volume24hUSD", "volume24h").try_cast("double").alias("volume_24h"), any_timestamp(first_of(t, "createdAt", "created_at", "listedAt")).alias("created_at"),
    )


def candles_of_arrays(raw: DataFrame, asset: str = "asset_id", body: str = "raw") -> DataFrame:
    """Candles of [time, open, high, low, close, volume] rows; short rows and those with anything not a number go."""
    rows = raw.select(asset, F.explode(F.from_json(body, "data struct<attributes:struct<ohlcv_list:array<array<string>>>>")["data"]["attributes"]["ohlcv_list"]).alias("r"))
    number = lambda i: F.get("r", F.lit(i)).try_cast("double")
    found = rows.select(F.col(asset).alias("asset_id"), F.timestamp_seconds(number(0)).alias("start"), *[number(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])
    return found.dropna()


def candles_of_objects(raw: DataFrame, asset: str = "asset_id", body: str = "raw") -> DataFrame:
    """Candles of objects; a missing volume is 0, a missing price drops the candle."""
    rows = raw.select(asset, F.explode(F.from_json(body, "success boolean, data struct<items:array<struct<unixTime:bigint,o:double,h:double,l:double,c:double,v:double,vUsd:double>>>")["data"]["items"]).alias("r"))
    found = rows.select(
        F.col(asset).alias("asset_id"), F.timestamp_seconds("r.unixTime").alias("start"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"), F.col("r.c").alias("close"), F.coalesce("r.v", "r.vUsd", F.lit(0.0)).alias("volume")
    )
    return found.dropna()
