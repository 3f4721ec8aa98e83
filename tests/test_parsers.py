"""Parsers of landed JSON."""

from tracklight.sources import parsers


def test_each_transaction_is_parsed_once(spark):
    """However many filters and columns read its fields, and whatever is wrong with it."""
    moves = '"tokenTransfers":[{"mint":"m","tokenAmount":"2.5","fromUserAccount":"%s","toUserAccount":"%s"}]'
    head = '{"signature":"%s","timestamp":%s,"feePayer":"a",'
    raw = [head % ("s1", 5) + moves % ("pool", "a") + "}", head % ("s2", 6) + moves % ("a", "pool") + "}", head % ("s3", 7) + '"type":"SWAP"}', head % ("", 8) + moves % ("a", "b") + "}", "no json", None]
    found = parsers.transactions(spark.createDataFrame([(r,) for r in raw], "raw string"), observation_lag_seconds=5)
    rows = {r["transaction_id"]: (r["event_type"], r["side"], r["asset_id"], r["token_amount"] and float(r["token_amount"])) for r in found.collect()}
    assert rows == {"s1": ("swap", "buy", "solana:m", 2.5), "s2": ("swap", "sell", "solana:m", 2.5), "s3": ("unknown_interaction", None, None, None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
