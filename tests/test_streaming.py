"""Incremental scoring: two arrivals with a restart between them end in the
batch result, each row once."""

from pyspark.sql import functions as F

from glossa.operators import language as L
from glossa.operators import scoring as S
from glossa.session import scratch_dir
from glossa.sources import fixtures as X
from glossa.streaming import incremental as ST

from .conftest import SF_SMALL


def test_stream_equals_batch(spark):
    comp, items = X.completions(spark, SF_SMALL), X.items(spark, SF_SMALL)
    prof = L.fit_profile(X.labelled_text(spark, SF_SMALL), "text", "lang", ("de", "en")).cache()
    base = scratch_dir(spark, "test-stream")
    src, sink, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    comp.where(F.col("mode") == "en").write.parquet(f"{src}/a")
    ST.stream_score(spark, f"{src}/*", sink, ckpt, items, prof, "de", "en")
    first = ST.read_scored(spark, sink).count()
    ST.stream_score(spark, f"{src}/*", sink, ckpt, items, prof, "de", "en")  # nothing new
    assert ST.read_scored(spark, sink).count() == first
    comp.where(F.col("mode") != "en").write.parquet(f"{src}/b")
    ST.stream_score(spark, f"{src}/*", sink, ckpt, items, prof, "de", "en")
    got = ST.read_scored(spark, sink)
    want = S.score_completions(comp, items, prof, "de", "en")
    cols = S.KEY + ["boxed", "pred", "correct", "lang_label"]
    assert got.count() == want.count() == comp.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.groupBy(*S.KEY).count().where("count > 1").count() == 0
