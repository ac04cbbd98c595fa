import base64
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from certmill.operators import certs as ct, entries as en, jobs as jb
from certmill.plans import audits as pl
from certmill.schemas import PARSED_COLUMNS
from certmill.sinks import files as sk
from certmill.sources import certfiles
from certmill.sources.certfiles import read_cert_files
from certmill.sources.dump import dump_audit, dump_metadata, read_dump
from certmill.streaming import names, scan as st
from tests.test_framing import b64, chain, leaf


def line(i, leaf_b, extra=b""):
    return json.dumps({"index": i, "entry": {"leaf_input": b64(leaf_b), "extra_data": b64(extra)}})


@pytest.fixture
def dump_file(tmp_path):
    p = tmp_path / "dump.jsonl"
    p.write_text("\n".join([
        json.dumps({"type": "any_dump_entries", "log_uri": "u", "tree_size": 9, "start": 7, "end": 9, "batch_size": 2}),
        line(7, leaf(kind=1), chain(b"\x30\x03\xaa\xbb\xcc")), "", "{broken", line(8, leaf()), line(9, b"\x00\x00"), "[1]", '{"index": 3}',
    ]) + "\n")
    return str(p)


def test_dump_is_read(spark, dump_file):
    assert sorted(r["index"] for r in read_dump(spark, dump_file).collect()) == [7, 8, 9]
    meta = dump_metadata(spark, dump_file).first()
    assert (meta["type"], meta["tree_size"], meta["start"], meta["end"]) == ("any_dump_entries", 9, 7, 9)
    assert tuple(dump_audit(spark, dump_file).first()) == (3, 1, 3)


def test_dump_without_metadata(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text(line(1, leaf()) + "\n" + line(2, leaf()) + "\n")
    assert read_dump(spark, str(p)).count() == 2


def test_parsed_rows(spark, dump_file, tmp_path):
    fields = spark.createDataFrame(
        [("CA", "Org", "x.com", "N/A", "nb", "na", ["x.com", "y.com"], b"\x30\x03\xaa\xbb\xcc")],
        "issuer_cn string, issuer_org string, subject_cn string, subject_org string, not_before string, not_after string, san array<string>, der binary",
    ).withColumn("fingerprint", F.sha2("der", 256))
    parsed = pl.parse_dump(spark, dump_file, fields)
    rows = {r["index"]: r for r in parsed.collect()}
    # The entry whose certificate has no fields keeps its row.
    assert len(rows) == 2 and sorted(r["fields_known"] for r in rows.values()) == [False, True]
    row = rows[7]
    assert (row["index"], row["timestamp_ms"], row["timestamp_utc"]) == (7, 1720000000000, "2024-07-03T09:46:40+00:00")
    assert (row["domain"], base64.b64decode(row["cert_der_b64"])) == ("x.com", b"\x30\x03\xaa\xbb\xcc")
    sk.write_parsed_csv(parsed, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines()[0] == ",".join(PARSED_COLUMNS)
    assert "x.com;y.com" in text
    sk.write_parsed_jsonl(parsed, str(tmp_path / "jsonl"))
    lines = "".join(p.read_text() for p in (tmp_path / "jsonl").glob("part-*")).splitlines()
    objs = {o["index"]: o for o in map(json.loads, lines)}
    assert objs[7]["san"] == ["x.com", "y.com"] and list(objs[7]) == PARSED_COLUMNS and len(objs) == 2
    assert en.parse_limit(parsed, 0).count() == 0


def test_dump_round_trip(spark, dump_file, tmp_path):
    out = str(tmp_path / "out")
    sk.write_dump(read_dump(spark, dump_file), out, "u", 9, 7, 9, 2)
    assert sorted(r["index"] for r in read_dump(spark, f"{out}/*").collect()) == [7, 8, 9]
    assert dump_metadata(spark, f"{out}/metadata").first()["log_uri"] == "u"


def test_certificate_files(spark, tmp_path):
    folder = str(tmp_path / "certs")
    hits = spark.createDataFrame([(42, b"\x30\x03abc"), (43, None), (44, b"zz")], "log_index bigint, der binary")
    assert tuple(sk.outcome_counts(sk.write_cert_files(hits.where("log_index < 44"), folder)).first()) == (1, 0, 1, 0)
    before = os.stat(f"{folder}/42.pem").st_mtime_ns
    assert tuple(sk.outcome_counts(sk.write_cert_files(hits, folder)).first()) == (1, 1, 1, 0)
    assert os.stat(f"{folder}/42.pem").st_mtime_ns == before
    assert sorted(p for p in os.listdir(folder) if not p.startswith(".")) == ["42.pem", "44.pem"]
    got = {os.path.basename(r["path"]): bytes(r["der"]) for r in read_cert_files(spark, folder, "*.pem").collect()}
    assert got == {"42.pem": b"\x30\x03abc", "44.pem": b"zz"}
    sk.write_cert_files(hits, f"{folder}/der", "der")
    assert (tmp_path / "certs" / "der" / "44.der").read_bytes() == b"zz"
    with pytest.raises(ValueError):
        sk.write_cert_files(hits, folder, "p12")


def test_written_names_are_joined_not_listed(spark, tmp_path):
    folder = str(tmp_path / "certs")

    def names():
        return sorted(r["file_name"] for r in sk.written_names(spark, folder).collect())

    def outcomes(first, last, **more):
        rows = spark.range(first, last).selectExpr("id AS log_index", "cast(concat('c', id) AS binary) AS der")
        return tuple(sk.outcome_counts(sk.write_cert_files(rows, folder, "der", **more)).first())

    assert names() == [] and outcomes(0, 30) == (30, 0, 0, 0)
    assert names() == sorted(f"{i}.der" for i in range(30))
    # A recorded name is not looked up again, nor is its file written.
    os.remove(f"{folder}/3.der")
    assert outcomes(0, 32) == (2, 30, 0, 0) and not os.path.exists(f"{folder}/3.der")
    # Files of a run that died before it recorded them, or put there by others, are found and recorded.
    (tmp_path / "certs" / "40.der").write_bytes(b"other")
    assert outcomes(38, 42) == (3, 1, 0, 0) and (tmp_path / "certs" / "40.der").read_bytes() == b"other"
    assert names() == sorted(f"{i}.der" for i in [*range(32), *range(38, 42)])
    assert outcomes(38, 42) == (0, 4, 0, 0) and len(names()) == 36
    assert read_cert_files(spark, folder, "*.der").count() == 35
    assert outcomes(0, 5, recheck=True) == (1, 4, 0, 0) and os.path.exists(f"{folder}/3.der") and len(names()) == 36


def test_files_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(certfiles, "FILES_PER_TASK", 50, raising=False)
    for i in range(400):
        (tmp_path / f"{i % 2}" / "in").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{i % 2}" / "in" / f"{i}.der").write_bytes(b"c%d" % i)
    read = read_cert_files(spark, str(tmp_path), "*.der")
    # The driver holds some files with names, not the status of every certificate.
    assert len(read.inputFiles()) < 40 and read.rdd.getNumPartitions() == 8
    assert sorted(bytes(r["der"]) for r in read.collect()) == sorted(b"c%d" % i for i in range(400))


def test_files_are_those_of_sparks_reader(spark, tmp_path):
    top = tmp_path / "odd \u00fc%20"
    names = ["1.pem", "a/2.der", "a/b/3.pem", ".h/4.pem", "_t/5.pem", "_x=1/6.pem", "_metadata", "_m=2.pem", ".c.pem", "d._COPYING_",
             "e.gz", "f e%20.pem", "k,1.{a}.pem", "empty.pem", "sub.pem/7.der", "x\n8.pem", "_metadata_x/10.pem", "A.PEM", "[z].pem"]
    for n in names:
        (top / n).parent.mkdir(parents=True, exist_ok=True)
        (top / n).write_bytes(b"" if n == "empty.pem" else n.encode())
    (top / "none").mkdir()
    os.symlink(top / "1.pem", top / "link.pem")
    for path, pattern in [(top, None), (top, "*.pem"), (f"file:{top}/", "{1,2}*.{pem,der}"), (top / "a", "*.[^p]*"), (top / "none", None),
                          (top / "1.pem", None), (f"{top}/*", "?.pem"), (top / "_t", "*.pem")]:
        plain = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        plain = plain.option("pathGlobFilter", pattern) if pattern else plain
        want = sorted((r["path"], bytes(r["content"])) for r in plain.load(str(path)).collect())
        assert sorted((r["path"], bytes(r["der"])) for r in read_cert_files(spark, str(path), pattern).collect()) == want
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_cert_files(spark, str(top / "nowhere"))


def test_a_task_that_fails_leaves_manifest_and_files_in_step(spark, tmp_path):
    folder, flag = str(tmp_path / "certs"), str(tmp_path / "failed")
    put = sk._writer(f"file://{folder}")

    def dies_once(uri):
        def run(batches):
            yield from put(batches)
            if not os.path.exists(flag):
                open(flag, "w").close()
                raise OSError("lost after its files were written")
        return run

    rows = spark.range(20).selectExpr("id AS log_index", "cast(concat('c', id) AS binary) AS der")
    before = sk._writer
    sk._writer = dies_once
    try:
        with pytest.raises(Exception, match="lost after"):
            sk.write_cert_files(rows, folder, "der")
    finally:
        sk._writer = before
    on_disk = {f for f in os.listdir(folder) if f.endswith(".der") and not f.startswith(".")}
    assert on_disk and sk.written_names(spark, folder).count() == 0
    counts = sk.outcome_counts(sk.write_cert_files(rows, folder, "der")).first()
    assert tuple(counts) == (20 - len(on_disk), len(on_disk), 0, 0)
    assert {r["file_name"] for r in sk.written_names(spark, folder).collect()} == {f"{i}.der" for i in range(20)}


def test_few_names_read_few_buckets(spark, tmp_path):
    folder = str(tmp_path / "certs")
    sk._record(spark.range(5000).selectExpr("concat(id, '.der') AS file_name"), folder)
    known = sk.written_names(spark, folder)
    assert known.select("bucket").distinct().count() == sk.NAME_BUCKETS
    some = spark.createDataFrame([("7.der",), ("no.der",)], "file_name string")
    assert [tuple(r) for r in sk._present(some, f"file://{folder}").collect()] == [("7.der", True)]
    plan = known.where(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan


def test_certificates_of_hits_are_read_back(spark, tmp_path):
    rows = spark.range(400).selectExpr(
        "IF(id % 2 = 0, 'https://a/', 'https://b/') AS log_uri", "id div 2 AS log_index", "IF(id = 102, NULL, cast(concat('c', id) AS binary)) AS der")
    rows.unionByName(rows).repartition("log_uri").write.partitionBy("log_uri").parquet(str(tmp_path / "certs"))
    certs = spark.read.parquet(str(tmp_path / "certs"))
    hits = spark.createDataFrame([("https://a/", 50), ("https://a/", 51), ("https://a/", 51), ("https://a/", 60)], "log_uri string, log_index bigint")
    found = pl.hit_certificates(hits, certs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(log_index,50)" in plan and "LessThanOrEqual(log_index,60)" in plan and "(log_uri#" in plan
    out = {r.file_name: r.outcome for r in sk.write_cert_files(found, str(tmp_path / "out"), "der").collect()}
    assert out == {"a-50.der": "written", "a-51.der": "failed", "a-60.der": "written"}
    assert (tmp_path / "out" / "a-60.der").read_bytes() == b"c120"
    assert pl.hit_certificates(hits.limit(0), certs).count() == 0


def test_rows_without_name_or_bytes_fail(spark, tmp_path):
    rows = spark.createDataFrame([(None, b"a"), ("x", None), ("y", b"1"), ("y", b"2"), ("z", b"3"), ("z", b"3")], "file_name string, der binary")
    out = {r.file_name: r.outcome for r in sk.write_cert_files(rows, str(tmp_path / "c"), "der").collect()}
    assert out == {None: "failed", "x": "failed", "y": "conflict", "z": "written"}
    assert sk.outcome_counts(sk.write_cert_files(rows.limit(0), str(tmp_path / "d"), "der")).first()["written"] == 0


def test_backfill_takes_bytes_from_the_entries(spark, dump_file, tmp_path):
    matches = spark.createDataFrame([(1, 5, 7, "a"), (2, 5, 7, "b"), (3, 5, 9, "c"), (4, 5, 100, "d")], "id bigint, job_id bigint, log_index bigint, domain string")
    rows = sk.backfill_rows(jb.job_log_indices(matches, 5), en.decode_entries(read_dump(spark, dump_file)))
    counts = sk.outcome_counts(sk.write_cert_files(rows, str(tmp_path / "pem"))).first()
    assert tuple(counts) == (1, 0, 2, 0)


def test_match_export_file(spark, tmp_path):
    from certmill.schemas import JOBS, MATCHES
    from tests.test_jobs import job, match

    matches = spark.createDataFrame([match(9, 1, 'a"b,c'), match(4, 1, "z")], MATCHES)
    rows = jb.export_rows(matches, spark.createDataFrame([job(1)], JOBS))
    sk.write_matches_csv(rows, str(tmp_path / "m"), one_file=True)
    (part,) = (tmp_path / "m").glob("part-*")
    lines = part.read_text().splitlines()
    assert lines[0] == "index,job_id,log_index,domain,issuer_cn,issuer_org,not_before,not_after,matched_rule"
    assert [x.split(",")[0] for x in lines[1:]] == ["1", "2"] and '"a""b,c"' in lines[2]


def test_standard_form(spark):
    raw = spark.createDataFrame(
        [("u", 1, None, None, "2026-01-01 00:00:00 UTC", None), ("u", 2, "cn.com", None, "", []),
         ("u", 3, "N/A", "O", "2027-01-01 00:00:00 UTC", ["x"])],
        "log_uri string, log_index bigint, subject_cn string, subject_org string, not_after string, san array<string>",
    )
    rows = {r["log_index"]: r for r in ct.standard_certs(raw, "2026-06-01 00:00:00 UTC").collect()}
    assert [rows[i]["san"] for i in (1, 2, 3)] == [["__cert:1__"], ["cn.com"], ["x"]]
    assert [rows[i]["is_expired"] for i in (1, 2, 3)] == [True, False, False]
    assert rows[1]["subject_org"] == "N/A"
    assert ct.first_domain(ct.fill_names(raw)).where("log_index = 3").first()["domain"] == "x"


def test_stream_reads_new_files_only(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        st.stream_scan(spark, str(src), out, ck).awaitTermination()
        return sorted(r["index"] for r in spark.read.parquet(out).collect())

    (src / "a.json").write_text(line(1, leaf()) + "\n\n{broken\n" + line(2, b"xx") + "\n")
    assert run() == [1, 2]
    assert run() == [1, 2]
    (src / "b.json").write_text(line(3, leaf()) + "\n")
    assert run() == [1, 2, 3]
    errors = {r["index"]: r["error"] for r in spark.read.parquet(out).collect()}
    assert errors == {1: None, 2: "leaf_too_short", 3: None}


@pytest.mark.parametrize("bounded", [False, True])
def test_stream_names_are_unique_across_runs(spark, tmp_path, bounded):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def run(names):
        rows = spark.createDataFrame([(n,) for n in names], "domain string").withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
        rows.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("domain string, ts timestamp_ntz").parquet(src)
        named = st.stream_names_within(stream, "ts", "1 day") if bounded else st.stream_names(stream)
        st.run_to_parquet(named, out, ck).awaitTermination()
        return sorted(r["clean"] for r in spark.read.parquet(out).collect())

    assert run(["a.com", "*.a.com", "b.com"]) == ["a.com", "b.com"]
    assert run(["b.com", "c.com"]) == ["a.com", "b.com", "c.com"]


@pytest.mark.parametrize("every", [1, 3, 16])
def test_names_never_return_and_state_stays_bounded(spark, tmp_path, every):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    seen, states = set(), []
    for step in range(2):
        for part in range(4):
            # Each file repeats the first names and half of those before it; a wildcard is the same name.
            first = 400 * (4 * step + part)
            rows = spark.range(600).selectExpr(f"concat(IF(id % 2 = 0, '*.', ''), 'n', IF(id < 50, id, {first} + id), '.com') AS domain")
            rows.unionByName(spark.createDataFrame([(None,)], "domain string")).coalesce(1).write.mode("append").parquet(src)
            seen |= {f"n{i if i < 50 else first + i}.com" for i in range(600)}
        stream = spark.readStream.schema("domain string").option("maxFilesPerTrigger", 1).parquet(src)
        query = names.keep_names(stream, out, ck, "0 seconds", every=every)
        query.awaitTermination()
        states += [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        got = [r["clean"] for r in names.kept_names(spark, out).collect()]
        assert len(got) == len(set(got)) and set(got) == seen
    assert max(states) <= 1_300 < len(seen)


def test_a_batch_run_again_keeps_the_same_names(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.range(10 * k, 10 * k + 20).selectExpr("concat('n', id) AS domain").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("domain string").option("maxFilesPerTrigger", 1).parquet(src)
    names.keep_names(stream(), out, str(tmp_path / "a"), "1 day", every=2).awaitTermination()
    once = sorted(r["clean"] for r in names.kept_names(spark, out).collect())
    # A lost checkpoint: all batches run again over what they had written.
    names.keep_names(stream(), out, str(tmp_path / "b"), "1 day", every=2).awaitTermination()
    assert once == sorted(r["clean"] for r in names.kept_names(spark, out).collect()) == sorted(f"n{i}" for i in range(40))


def test_a_plain_folder_is_one_of_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert sk._shared_uri(spark, "/a/b") == "file:///a/b" and sk._shared_uri(spark, "s3a://x/y") == "s3a://x/y"
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020/")
        assert sk._shared_uri(spark, "/a/b") == "hdfs://name:8020/a/b"
    finally:
        conf.set("fs.defaultFS", before)
