"""Assignment against fixed centroids on a stream (a stateless projection)."""

from pyspark.sql import functions as F

from mixclust.plans.geometry import Geometry
from mixclust.plans.params import SPAM_FEATURES
from mixclust.session import fresh_dir
from mixclust.streaming.assign_stream import assign_stream

from .conftest import SPAM_WEIGHTS


def test_stream_matches_batch(spark, spam):
    pts, lim, rows = spam
    geom = Geometry(SPAM_FEATURES, SPAM_WEIGHTS, 1)
    cents = [{k: v for k, v in dict(rows[i], cluster_id=j).items() if k != "id"} for j, i in enumerate([0, 2, 4])]
    src = fresh_dir(spark, "stream-in")
    raw = pts.select("id", *[((F.col(c) * (mx - mn)) + mn).alias(c) for c, (mn, mx) in lim.items()], "bot", "uri")
    raw.write.parquet(src)
    stream = spark.readStream.schema(raw.schema).parquet(src)
    q = (assign_stream(stream, cents, geom, lim).select("id", "cluster_id")
         .writeStream.format("memory").queryName("assigned_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.cluster_id for r in spark.sql("SELECT * FROM assigned_stream").collect()}
    from mixclust.operators.assign import assign
    want = {r.id: r.cluster_id for r in assign(pts, cents, geom).collect()}
    assert got == want
