from pyspark.sql import functions as F

from seqscore.plans import all_queries
from seqscore.session import table_path

SF = "/root/testdata/sf0.001"


def test_whole_texts_and_padding(spark):
    """Every letter of every text is there, and some rows are padding."""
    texts = {r.item_id: r.text for r in spark.read.parquet(table_path(SF, "benchmark")).collect()}
    out = all_queries()[0]["padding_batches"](spark, SF)
    rows = out.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "letter", "kept"))).alias("x"), F.first("batch").alias("batch")).collect()
    assert {r.item_id: "".join(x.letter for x in r.x if x.kept) for r in rows} == texts
    size = {}
    for r in rows:
        size.setdefault(r.batch, set()).add(len(r.x))
        assert [x.pos for x in r.x] == list(range(1, len(r.x) + 1))
    assert all(len(s) == 1 for s in size.values())
    assert max(map(len, texts.values())) > 64 and out.where("not kept").count() > 0
