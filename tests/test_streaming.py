from pyspark.sql import functions as F

from duecast.functions.values import TIER_BOUNDS, tier
from duecast.operators.projection import row_alerts
from duecast.sources import lenses
from duecast.streaming.arrivals import arriving, process_arrived


def _scored_alerts(df):
    scored = df.withColumn("risk_tier", tier(F.col("p"), *TIER_BOUNDS["scoring"]))
    return row_alerts(scored.withColumn("is_anomaly", F.col("risk_tier") == "HIGH_RISK"), "row_id", F.lit("now"))


def test_new_files_are_processed_once(spark, small, tmp_path):
    df = lenses.scores(spark, small)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    expected = {r.alert_id for r in _scored_alerts(df).collect()}
    for part in (df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1")):
        part.write.mode("append").parquet(source)
        process_arrived(arriving(spark, source, df.schema), _scored_alerts, out, checkpoint)
    got = [r.alert_id for r in spark.read.parquet(out).collect()]
    assert len(got) == len(expected) and set(got) == expected
