from textloom.plans import catalogue


def test_all_concepts_are_matched(spark, tmp_path):
    rows = [(f"name {i}", f"name {i}") for i in range(5_100)]
    spark.createDataFrame(rows, "p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.concept_match(spark, str(tmp_path)).filter("query = concept")
    assert found.count() == 5_100
