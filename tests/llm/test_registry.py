from pyspark.sql import functions as F

from graphloom.llm import registry


def test_reports_agree_with_what_they_report(spark, sf):
    packed = registry.p6_packing(spark, sf).where("container_id is not null")
    containers = registry.p6_containers(spark, sf)
    assert containers.agg(F.sum("tokens")).collect()[0][0] == packed.agg(F.sum("tokens")).collect()[0][0]
    assert containers.where("unused < 0").count() == 0
    found = registry.p7_found(spark, sf)
    assert registry.p7_documents(spark, sf).agg(F.sum("n_items")).collect()[0][0] == found.count()
    assert registry.p7_items(spark, sf).agg(F.sum("n_documents")).collect()[0][0] == found.count()
