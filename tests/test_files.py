"""The page source and the file sink: packing, bad bytes, streams, commits, lost and repeated tasks."""

import glob
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from papyrine.sources.pages import read_pages, stream_pages
from papyrine.sources.sink import SinkStreamWriter, SinkWriter, read_manifest, save_files, stream_files
from papyrine.sources.store import OPEN_COST, File, decoded, packed


def test_packing():
    files = [File(f"/f{i}", "/", (i * 7919) % 4000 + (300_000 if i % 500 == 0 else 0), i) for i in range(10_000)]
    bins = packed(files, 1 << 24)
    sizes = [sum(f.size + OPEN_COST for f in b) for b in bins]
    assert len(bins) > 20 and max(sizes) < 2 * min(sizes) and sum(map(len, bins)) == 10_000
    assert len(packed([File("/a", "/", 1 << 30, 0), *files], 1 << 24)[0]) == 1 and packed([], 5) == []


def test_decoding():
    assert decoded(b"\xff\xfe\x00\xd8a\x00") == (None, "utf-16-le") and decoded("é".encode("utf-16")) == ("é", None)
    assert decoded(b"\xfe\xff\x00a\x00") == (None, "utf-16-be") and decoded(b"\xff", None) == (None, "utf-8")
    assert decoded(b"\x80\x81", "latin1") == ("€\x81", None) and decoded("日本".encode("shift_jis"), "Shift_JIS") == ("日本", None)
    assert decoded(b"\x81", "shift_jis") == (None, "cp932") and decoded(b"\xef\xbb\xbf\xc3\xa9", "latin1") == ("é", None)
    with pytest.raises(ValueError):
        decoded(b"", "no such")


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    for i in range(300):
        at = top / f"d{i % 3}" / ("x.htm" if i % 2 else "y.HTML")
        at = at.with_name(f"{i}{at.name}")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(f"<p>é{i}".encode() + b" " * (i % 7) * 1000)
    (top / "bad.html").write_bytes(b"\xff\xfe\x00\xd8a\x00")
    (top / "note.txt").write_text("no")
    return top


def test_batch_and_stream_read_the_same(spark, folder, tmp_path):
    df = read_pages(spark, str(folder), recursive=True, partitionBytes=2_000_000)
    rows = {os.path.relpath(r.path, folder): r for r in df.collect()}
    assert df.rdd.getNumPartitions() > 5 and len(rows) == 301
    assert rows["bad.html"].html is None and "utf-16-le" in rows["bad.html"].error and rows["d1/1x.htm"].html.startswith("<p>é1")
    assert sum(r.error is not None for r in rows.values()) == 1 and {r.base for r in rows.values()} == {str(folder)}
    assert abs(rows["bad.html"].modified.timestamp() - os.path.getmtime(folder / "bad.html")) < 1e-3
    assert read_pages(spark, str(folder)).count() == 1 and read_pages(spark, f"{folder}/d?/*.htm").count() == 150
    assert read_pages(spark, str(folder / "note.txt")).first().html == "no" and read_pages(spark, f"{folder}/**/1y*").count() == 0
    assert read_pages(spark, str(folder), f"file://{folder}/d0", recursive=True).count() == 401

    def read_stream():
        s = stream_pages(spark, str(folder), recursive=True, settleSeconds=0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
        s.start(str(tmp_path / "out")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    assert sorted(map(str, read_stream())) == sorted(map(str, rows.values()))
    (folder / "new.html").write_text("<p>new")
    got = read_stream()  # a restart goes on where the last one ended
    assert len(got) == 302 and [r.html for r in got if r.path.endswith("new.html")] == ["<p>new"]


def leftovers(root):
    return sorted(os.path.relpath(p, root) for p in glob.glob(f"{root}/**", recursive=True, include_hidden=True) if os.path.isfile(p))


def docs(spark, n=40):
    return spark.range(n, numPartitions=4).selectExpr("concat('a', id % 3, '/', id, '.md') output_path", "concat('# ', id) markdown", "concat('in', id) input_path", "timestamp'2020-01-02 03:04:05' modified")


def test_sink(spark, tmp_path):
    root = f"{tmp_path}/o"
    records = save_files(docs(spark).withColumn("error", F.when(F.col("input_path") == "in7", "broken")), root, timestamps=True)
    assert records.count() == 40 and [r.input for r in records.filter("error is not null").collect()] == ["in7"]
    assert len(leftovers(root)) == 40 and not os.path.exists(f"{root}/_staging")
    assert open(f"{root}/a2/5.md").read() == "# 5" and os.path.getmtime(f"{root}/a2/5.md") == 1577934245
    whole = json.load(open(f"{root}/manifest.json"))
    assert len(whole["files"]) == 40 and (whole["changed_count"], whole["skipped_count"], whole["error_count"]) == (0, 0, 1)
    # in7 has no output yet, so it alone is written.
    assert save_files(docs(spark), root, policy="skip-existing").filter("not skipped").count() == 1
    changed = docs(spark).withColumn("markdown", F.when(F.col("input_path") == "in9", "new").otherwise(F.col("markdown")))
    assert [r.input for r in save_files(changed, root, check=True, manifest="checked.json").filter("changed").collect()] == ["in9"]
    assert open(f"{root}/a0/9.md").read() == "# 9"
    with pytest.raises(ValueError, match="several|same output"):
        save_files(docs(spark).unionAll(docs(spark)), root)
    for bad in ("../x.md", "/x.md", ""):
        with pytest.raises(Exception, match="isn't below"):
            save_files(docs(spark).withColumn("output_path", F.when(F.col("input_path") == "in3", bad).otherwise(F.col("output_path"))), root)


def test_lost_tasks_leave_nothing(spark, tmp_path):
    root = f"{tmp_path}/o"

    @F.udf("string")
    def killed(x):
        if x == "# 33":
            os._exit(1)
        return x

    with pytest.raises(Exception):
        save_files(docs(spark).withColumn("markdown", killed("markdown")), root)
    assert leftovers(root) == []
    with pytest.raises(Exception, match="fail-if-exists"):
        save_files(docs(spark, 3), root)
        save_files(docs(spark), root, policy="fail-if-exists")
    assert len(leftovers(root)) == 4 and not os.path.exists(f"{root}/_staging")


def test_repeated_tasks_change_nothing(spark, tmp_path):
    df = docs(spark, 6)
    batches = df.toArrow().to_batches()
    w = SinkWriter({"path": f"{tmp_path}/o"}, df.schema)
    first, again = w.write(iter(batches)), w.write(iter(batches))
    assert first.folder != again.folder and leftovers(f"{tmp_path}/o") and not os.path.exists(f"{tmp_path}/o/a0")
    w.commit([None, again])
    assert len(leftovers(f"{tmp_path}/o")) == 7 and read_manifest(spark, f"{tmp_path}/o").count() == 6
    # A batch of a stream that was committed before is dropped, whatever it brings.
    w = SinkStreamWriter({"path": f"{tmp_path}/s"}, df.schema)
    w.commit([w.write(iter(batches))], 3)
    before = {p: open(f"{tmp_path}/s/{p}").read() for p in leftovers(f"{tmp_path}/s")}
    other = docs(spark, 9).withColumn("markdown", F.lit("other")).toArrow().to_batches()
    w.commit([w.write(iter(other))], 3)
    assert {p: open(f"{tmp_path}/s/{p}").read() for p in leftovers(f"{tmp_path}/s")} == before and len(before) == 7
    w.write(iter(other))
    w.abort([], 4)
    assert len(leftovers(f"{tmp_path}/s")) == 7


def test_stream_sink(spark, folder, tmp_path):
    from papyrine.convert import convert_table

    pages = stream_pages(spark, str(folder), recursive=True, settleSeconds=0)
    done = convert_table(pages.filter("error is null")).selectExpr("concat(replace(path, base || '/', ''), '.md') output_path", "result.markdown markdown", "path input_path", "result.error error")
    for _ in range(2):
        stream_files(done, f"{tmp_path}/o", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    found = leftovers(f"{tmp_path}/o")
    assert sum(p.endswith(".md") for p in found) == 300 and open(f"{tmp_path}/o/d1/1x.htm.md").read() == "é1\n"
    assert not any("_staging" in p for p in found) and read_manifest(spark, f"{tmp_path}/o", "_batches/0.json").count() + (read_manifest(spark, f"{tmp_path}/o", "_batches/1.json").count() if "_batches/1.json" in found else 0) == 300


def test_small_batches(spark, tmp_path):
    """While files are written a Python worker gets batches of some megabytes, not of ten thousand rows."""

    @F.pandas_udf("string")
    def rows(text: pd.Series) -> pd.Series:
        return pd.Series([str(len(text))] * len(text))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    texts = spark.range(0, 6000, 1, 1).select(F.concat("id", F.lit(".md")).alias("output_path"), F.concat("id", F.repeat(F.lit("x"), 5000)).alias("markdown"))
    saved = save_files(texts.withColumn("title", rows("markdown")), str(tmp_path / "out")).collect()
    assert len(saved) == len({r.output for r in saved}) == 6000 and all((tmp_path / "out" / r.output).stat().st_size > 5000 for r in saved[:50])
    assert max(int(r.title) for r in saved) * 5000 <= 8 << 20 and spark.conf.get(name) == was
