import bz2

from pyspark.sql import functions as F

from refloom.operators import context as X
from refloom.operators import labels as L
from refloom.sources import dump, lists
from refloom.streaming import parts

PAGE = """<page><title>T{i}</title><ns>{ns}</ns><id>{i}</id>{redirect}<revision><id>{i}0</id><parentid>{i}1</parentid>
<text bytes="3" xml:space="preserve">body {i}
{{{{cite web|title=x &amp; y|doi=10.1/{i}}}}}</text></revision></page>
"""


def write_dump(folder, name="xx-articles1.xml-p1p9.bz2", n=60):
    pages = "".join(
        PAGE.format(i=i, ns=1 if i % 10 == 9 else 0, redirect='<redirect title="Z" />' if i % 10 == 8 else "") for i in range(1, n + 1)
    )
    path = folder / name
    path.write_bytes(bz2.compress(f"<mediawiki>\n{pages}</mediawiki>\n".encode()))
    return str(path)


def test_dump_both_ways(spark, tmp_path):
    path = write_dump(tmp_path)
    split, whole = dump.read_dump(spark, path), dump.read_dump(spark, path, splittable=False)
    assert split.count() == whole.count() == 60
    a = {tuple(r) for r in dump.articles(split).drop("file").collect()}
    assert a == {tuple(r) for r in dump.articles(whole).collect()}
    assert len(a) == 48
    row = dump.articles(split).where("page_id = 1").first()
    assert (row.title, row.r_id, row.r_parentid) == ("T1", 10, 11)
    assert row.content == "body 1\n{{cite web|title=x & y|doi=10.1/1}}"
    assert dump.page_content(split).columns == ["page_id", "page_title", "content"]
    assert dump.with_dump_part(dump.articles(split)).first().part == "-articles1.xml-p1p9"


def test_batches_resume(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "out")
    assert dump.write_partitioned_batches(df, path, "id", batches=8) == 8
    assert dump.read_stage(spark, path).count() == 100
    assert dump.write_partitioned_batches(df, path, "id", batches=8) == 0


def test_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("abc.com,1\nnodot,2\n")
    (tmp_path / "b.txt").write_text("The Paper (www.paper.co.uk)\nbare.org\nNo address\n")
    (tmp_path / "c.txt").write_text('***https://src.org/list\n"https://www.x.com"\n"https://y.com"\n***https://src2.org\n"https://z.com"\n')
    csv = lists.read_domain_csv(spark, str(tmp_path / "a.csv"))
    bias = lists.read_bias_list(spark, str(tmp_path / "b.txt"))
    links = lists.read_media_links(spark, str(tmp_path / "c.txt"))
    assert [r.address for r in csv.collect()] == ["abc.com"]
    assert [r.address for r in bias.collect()] == ["www.paper.co.uk", "bare.org"]
    assert links.count() == 3
    by_source = {(r.source, r.address) for r in lists.media_links_by_source(spark, str(tmp_path / "c.txt")).collect()}
    assert by_source == {("https://src.org/list", "https://www.x.com"), ("https://src.org/list", "https://y.com"),
                         ("https://src2.org", "https://z.com")}
    domains = L.build_domain_set(csv, bias, links.select(F.translate("address", '"', "").alias("address")))
    text = lists.domains_text(domains).first().domains
    assert text == "abc,bare,paper,x,y,z"
    (tmp_path / "d.txt").write_text(text)
    assert lists.read_domains_text(spark, str(tmp_path / "d.txt")).count() == 6


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text\nline', "['x','y']")], "id int, citations string, sections string")
    lists.write_csv(df, str(tmp_path / "csv"))
    back = lists.csv_array_columns(lists.read_csv(spark, str(tmp_path / "csv"), "id int, citations string, sections string"), "sections")
    assert [tuple(r) for r in back.collect()] == [(1, 'a "quoted", text\nline', ["x", "y"])]
    (tmp_path / "counts.csv").write_text("template,count\ncite web,3\n")
    assert lists.template_counts(spark, str(tmp_path / "counts.csv")).first()["count"] == 3


def test_stream_goes_on_after_restart(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    pages = lambda i: spark.createDataFrame([(i, "{{cite journal|title=x|pmid=%d}}" % i)], "page_id int, content string")
    for i in (1, 2):
        pages(i).write.mode("append").parquet(source)
        parts.stream_dump_parts(spark, source, pages(i).schema, target, mark).awaitTermination()
        done = spark.read.parquet(target)
        assert done.count() == i and {r.actual_label for r in done.collect()} == {"journal"}


def test_bucketed_stages_join_without_a_shuffle(spark, tmp_path):
    cites = [(p, f"{{{{c|{p % 3}{i % 2}}}}}", f"S{i}") for p in range(40) for i in range(p % 5)]
    near = [(p, t, p % 3, 9) for p, t, _ in cites]
    left = spark.createDataFrame(cites, "id long, citations string, section string")
    right = spark.createDataFrame(near, "page_id long, retrieved_citation string, ref_index long, total_words long")
    want = sorted(map(tuple, X.join_features(left, right).collect()))
    a = dump.bucketed_stage(left, str(tmp_path / "cites"), ["id", "citations"], 4)
    b = dump.bucketed_stage(right, str(tmp_path / "near"), ["page_id", "retrieved_citation"], 4)
    joined = X.join_features_bucketed(a, b)
    assert sorted(map(tuple, joined.collect())) == want and joined.columns == X.join_features(left, right).columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = X.join_features_bucketed(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_rows_of_few_row_groups_are_spread(spark, tmp_path):
    """One row group is read by one task, however many tasks the bytes of its file are cut into."""
    path = str(tmp_path / "one")
    wide = spark.range(0, 40_000, numPartitions=1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    wide.write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "100000")
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 8
        held = dump.spread(rows, 8).groupBy(F.spark_partition_id()).count().collect()
        assert len(held) >= 8 and sum(r["count"] for r in held) == 40_000
        assert max(r["count"] for r in held) < 10_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    even = spark.range(0, 800, numPartitions=8)
    assert dump.spread(even, 8) is even
