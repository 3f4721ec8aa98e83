"""Query of the replay of all families over a clock."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tracklight.operators import replay
from tracklight.plans import q_graph as qg
from tracklight.plans import q_nights as qn
from tracklight.plans import q_outcomes as qo
from tracklight.plans import q_signals as qs
from tracklight.plans import sql_parts as sql
from tracklight.plans.catalogue import query
from tracklight.schema import DAY
from tracklight.sources import adapters

#: Thirty days, one tick a day; what is recent is a day old at most.
CLOCK = replay.Clock(qo.AS_OF_US - 24 * DAY, qo.AS_OF_US + 5 * DAY, DAY)
SIGNAL = replace(qs.SIGNAL, lookback_days=1)


def _tick(at: int) -> str:
    shorter = qn.families_sql(qo.AS_OF_US).replace(str(qo.AS_OF_US - 3 * DAY), str(qo.AS_OF_US - DAY))
    return f"SELECT *, {at} AS t FROM ({qn.moved(shorter, at)})"


REPLAYED = ", " + ",\n".join(["tra AS (SELECT *, 'tracked' AS status FROM tr)", *[f"tick{i} AS ({_tick(CLOCK.start + i * DAY)})" for i in range(CLOCK.last + 1)]])
EVERY = " UNION ALL ".join(f"SELECT * FROM tick{i}" for i in range(CLOCK.last + 1))


@query(
    "replay_all",
    sql.with_(*qo.TRACKED_PARTS) + REPLAYED + f"""
SELECT family, asset_id, wallet, us, round(significance, 6) AS significance, t AS tick_us FROM ({EVERY})
QUALIFY row_number() OVER (PARTITION BY family, asset_id, wallet, us // {DAY} ORDER BY t, round(significance, 9) DESC, us) = 1""",
)
def replay_all(spark, sf_dir):
    """All families over thirty days, each day seeing the edges of its moment."""
    found = replay.replay(adapters.clickstream_events(spark, sf_dir), qo.tracked(spark, sf_dir), qo.k_outcomes(spark, sf_dir), CLOCK, qg.GRAPH, SIGNAL)
    return found.select("family", "asset_id", "wallet", F.unix_micros("triggered_at").alias("us"), F.round("significance", 6).alias("significance"), F.unix_micros("evidence_cutoff").alias("tick_us"))
