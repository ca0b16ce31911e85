"""Reading archives back in many tasks, and the headers by which other readers resolve revisits."""

from strandspark.llm import warc


def test_archives_are_read_by_as_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" * 60) for i in range(40)], "page_id long, url string, html string").repartition(7)
    got = warc.archived(pages)
    assert got.rdd.getNumPartitions() == 7 and got.count() == 40


def test_revisits_name_the_record_they_refer_to():
    head = lambda *a: dict(x.split(": ", 1) for x in warc.record(*a).decode().split("\r\n\r\n")[0].split("\r\n")[1:])
    first, again = head(3, "http://x", b"body", "d", None), head(9, None, b"body", "d", 3)
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] != again["WARC-Record-ID"]
    assert again["WARC-Type"] == "revisit" and "WARC-Refers-To" not in first


def test_folders_keep_their_file_system(spark):
    assert warc.qualified(spark, "/tmp/x") == warc.qualified(spark, "file:/tmp/x") == "file:///tmp/x"
