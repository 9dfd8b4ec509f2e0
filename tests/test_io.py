"""Codecs, metric texts, sources, sinks, pipelines and streams."""

import gzip
import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from weirflow.model import gauge, metric, tags_of
from weirflow.plans.pipeline import ConfigError, Pipeline, interpolated
from weirflow.sources import codecs, metrics as texts, readers, sinks
from weirflow.streaming import operators as streams

T0 = datetime(2024, 1, 1)


def payloads(spark, *texts_):
    return spark.createDataFrame([(t,) for t in texts_], "value string")


# ---- codecs ----


def test_json_arrays_are_rows(spark):
    df = payloads(spark, '{"a": 1}', '[{"a": 2}, {"a": 3}]')
    assert sorted(r.a for r in codecs.decode_json(df, schema="a int").collect()) == [1, 2, 3]
    assert codecs.decode_json(payloads(spark, '{"a": 1}', "bad")).count() == 1


def test_gelf_both_ways(spark):
    out = codecs.decode_gelf(payloads(spark, '{"version":"1.1","host":"h","short_message":"m","timestamp":1.5,"_user":"u","level":3}', '{"version":"1.0","host":"h","short_message":"m"}')).collect()
    assert [(r.host, r.message, r.fields, r.level) for r in out] == [("h", "m", {"user": "u"}, 3)]
    row = spark.createDataFrame([(T0, "h", "m", "x")], "ts timestamp, host string, message string, extra string")
    text = json.loads(codecs.encode_gelf(row).first()[0])
    assert text == {"version": "1.1", "host": "h", "short_message": "m", "timestamp": 1704067200.0, "_extra": "x"}


def test_chunks(spark):
    parts = codecs.gelf_chunks(b"x" * 20_000, 7)
    df = spark.createDataFrame([(p,) for p in [*reversed(parts), b"plain"]], "value binary")
    assert sorted(len(bytes(r.value)) for r in codecs.joined_chunks(df).collect()) == [5, 20_000]
    assert codecs.joined_chunks(spark.createDataFrame([(parts[0],)], "value binary")).count() == 0


def test_text_encoders(spark):
    df = spark.createDataFrame([(1, "a b", None)], "n int, s string, z string")
    assert codecs.encode_json(df).first()[0] == '{"n":1,"s":"a b","z":null}'
    assert codecs.encode_csv_rows(df, ["s", "z", "nope", "n"]).first()[0] == "a b,,,1"
    assert codecs.encode_logfmt(df).first()[0] == 'n=1 s="a b" z=null'
    cef = codecs.encode_cef(df, "v|x", "p", "1", "id", "s", 7, {"cn": "n"}).first()[0]
    assert cef == "CEF:0|v\\|x|p|1|id|a b|7|cn=1"


def test_influx_lines(spark):
    out = codecs.decode_influxdb(payloads(spark, "cpu,host=A value=1.5,n=3i,s=\"x y\" 1590488773254420000\nbad")).collect()
    assert sorted((r.name, r.tags, r.value.value) for r in out) == [("cpu_n", {"host": ["A"]}, 3.0), ("cpu_value", {"host": ["A"]}, 1.5)]


def test_otlp_logs(spark):
    body = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}, "scopeLogs": [{"scope": {"name": "n"}, "logRecords": [{"timeUnixNano": "1000000000", "severityText": "INFO", "body": {"stringValue": "hi"}, "attributes": [{"key": "k", "value": {"intValue": "1"}}]}]}]}]}
    r = codecs.decode_otlp_logs(payloads(spark, json.dumps(body))).first()
    assert (r.message, r.severity_text, r.attributes, r.resources, r.ts_ns) == ("hi", "INFO", {"k": "1"}, {"service.name": "s"}, 1_000_000_000)


def test_framing(spark):
    df = payloads(spark, "a\nb\r\n\nc")
    assert [r.value for r in codecs.split_frames(df).collect()] == ["a", "b", "c"]
    assert [r.value for r in codecs.split_frames(df, max_length=0).collect()] == []
    assert codecs.cut_lengths(b"\0\0\0\2ab\0\0\0\1c\0\0") == [b"ab", b"c"]
    assert codecs.cut_varints(b"\2ab\1c") == [b"ab", b"c"]
    assert codecs.cut_octets(b"2 ab3 c\nd\nline\n") == [b"ab", b"c\nd", b"line"]
    x = payloads(spark, "xyz")
    framed = codecs.split_frames(x.select(codecs.framed(x, "length_delimited").alias("value")), "length_delimited")
    assert [bytes(r.value) for r in framed.collect()] == [b"xyz"]


def test_arrow_batches(spark):
    import pyarrow as pa

    blob = codecs.encode_arrow(spark.range(3).coalesce(1)).first()[0]
    assert pa.ipc.open_stream(bytes(blob)).read_all().column("id").to_pylist() == [0, 1, 2]


# ---- metric texts ----


def test_statsd(spark):
    lines = "foo:1|c|@0.5\nbar:3.5|g|#a:b,c\nt:250|ms\nu:x|s\ng:-2|g\nbroken\nbad name/x:1|c"
    out = {r.name: (r.kind, r.value.type, r.value.value, r.tags) for r in texts.parse_statsd(payloads(spark, lines)).collect()}
    assert out["foo"] == ("incremental", "counter", 2.0, {}) and out["bar"] == ("absolute", "gauge", 3.5, {"a": ["b"], "c": [None]}) and out["g"][0:3] == ("incremental", "gauge", -2.0) and "bad_name-x" in out and len(out) == 6
    t = texts.parse_statsd(payloads(spark, "t:250|ms|@0.1")).first().value
    assert [(s.value, s.rate) for s in t.samples] == [(0.25, 10)]


def test_exposition_both_ways(spark):
    text = """# TYPE up gauge
up{host="a\\"b"} 1
# TYPE n_total counter
n_total 5 1000
# TYPE h histogram
h_bucket{le="1"} 2
h_bucket{le="5"} 7
h_bucket{le="+Inf"} 9
h_sum 30
h_count 9
# TYPE s summary
s{quantile="0.5"} 4
s_sum 10
s_count 3
plain 7
"""
    m = texts.parse_exposition(payloads(spark, text))
    out = {r.name: r for r in m.collect()}
    assert sorted(out) == ["h", "n_total", "plain", "s", "up"]
    assert out["up"].tags == {"host": ['a"b']} and out["n_total"].value.type == "counter" and out["plain"].value.type == "gauge"
    assert [(b.upper_limit, b["count"]) for b in out["h"].value.buckets] == [(1, 2), (5, 5)] and out["h"].value["count"] == 9
    assert [(q.quantile, q.value) for q in out["s"].value.quantiles] == [(0.5, 4)] and out["s"].value.sum == 10
    lines = [r.value for r in texts.encode_exposition(m).orderBy("family", "part", "series", "place").collect()]
    assert 'h_bucket{le="5"} 7' in lines and 'h_bucket{le="+Inf"} 9' in lines and 's{quantile="0.5"} 4' in lines and 'up{host="a\\"b"} 1' in lines


def test_pushes_and_status_pages(spark):
    m = texts.parse_exposition(payloads(spark, "# TYPE a counter\na 1", "# TYPE a counter\na 2"))
    assert [r.value.value for r in texts.summed_pushes(m).collect()] == [3]
    page = "Active connections: 291 \nserver accepts handled requests\n 16630948 16630946 31070465 \nReading: 6 Writing: 179 Waiting: 106 \n"
    out = {r.name: r.value.value for r in texts.parse_nginx_status(payloads(spark, page)).collect()}
    assert out["connections_active"] == 291 and out["http_requests_total"] == 31070465 and out["connections_waiting"] == 106
    out = {r.name: r.value.value for r in texts.parse_apache_status(payloads(spark, "Total Accesses: 30\nBusyWorkers: 1\nScoreboard: __W_.\n")).collect()}
    assert out["access_total"] == 30 and out["scoreboard_waiting"] == 3 and out["scoreboard_sending"] == 1
    assert {r.name: r.value.value for r in texts.flattened_numbers(payloads(spark, '{"a": {"b": 1}, "c_total": 2}'), "value", "x").collect()} == {"a_b": 1, "c_total": 2}


# ---- sources and sinks ----


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    assert sorted(r.message for r in readers.read(spark, "file", include=str(tmp_path / "*.log")).collect()) == ["one", "two"]
    assert readers.read(spark, "demo_logs", count=5, format="json").select(F.get_json_object("message", "$.method")).count() == 5
    same = [[r.message for r in readers.read(spark, "demo_logs", count=5, format="apache_common").collect()] for _ in range(2)]
    assert same[0] == same[1]
    assert {r.stream for r in readers.read(spark, "exec", command=["sh", "-c", "echo a; echo b >&2"]).collect()} == {"stdout", "stderr"}
    assert [r.value.value for r in readers.read(spark, "static_metrics", metrics=[{"name": "x", "value": 2, "tags": {"a": "b"}}]).collect()] == [2.0]
    names = {r.name for r in readers.read(spark, "host_metrics").collect()}
    assert {"load1", "memory_total_bytes", "cpu_seconds_total"} <= names
    with pytest.raises(ValueError):
        readers.read(spark, "nope")
    (tmp_path / "pods_web_0").mkdir()
    k = tmp_path / "ns_pod_uid" / "main"
    k.mkdir(parents=True)
    (k / "0.log").write_text("2024-01-01T00:00:00.5Z stdout F hello\nbad\n")
    r = readers.read(spark, "kubernetes_logs", include=str(k / "0.log")).first()
    assert (r.message, r.pod_namespace, r.pod_name, r.pod_uid, r.container_name, r.partial) == ("hello", "ns", "pod", "uid", "main", False)


def test_files_by_key(spark, tmp_path):
    df = spark.createDataFrame([(T0, "a", "m1"), (T0, "b", "m2"), (T0, None, "m3"), (T0, "../x", "m4")], "ts timestamp, app string, message string")
    sinks.write(df, "file", path=str(tmp_path / "out"), format="text", key_prefix="{{ app }}/%Y")
    back = spark.read.text(str(tmp_path / "out"))
    assert sorted((r.value, r.key) for r in back.collect()) == [("m1", "a/2024"), ("m2", "b/2024")]
    sinks.to_parquet(df, str(tmp_path / "p"), "app string, n int")
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["app", "n"]
    with pytest.raises(ValueError):
        sinks.to_parquet(df, str(tmp_path / "q"), "app string", mode="strict")
    sinks.write(df, "blackhole")


class _Taker(BaseHTTPRequestHandler):
    got: list = []
    fail = 1

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if _Taker.fail:
            _Taker.fail -= 1
            self.send_response(503)
        else:
            _Taker.got.append((self.path, self.headers.get("Content-Encoding"), body))
            self.send_response(200)
        self.end_headers()

    def log_message(self, *a):
        pass


def test_requests_are_batched_and_tried_again(spark):
    server = HTTPServer(("127.0.0.1", 0), _Taker)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    df = spark.range(5).coalesce(1).select(F.col("id").cast("string").alias("message"))
    sinks.write(df, "axiom", url=url, compression="gzip", max_events=2)
    server.shutdown()
    assert [path for path, _, _ in _Taker.got] == ["/v1/ingest"] * 3
    assert [x["message"] for _, kind, b in _Taker.got for x in json.loads(gzip.decompress(b))] == ["0", "1", "2", "3", "4"]


def test_bodies(spark):
    make = lambda name, *events, **o: [b.decode() for b in sinks.bodies(iter(events), sinks.SHAPES[name], **o)]
    assert make("elasticsearch", '{"create":{}}\n{"a":1}\n') == ['{"create":{}}\n{"a":1}\n']
    assert make("loki", '["1","m"]', labels={"app": "x"}) == ['{"streams":[{"stream":{"app": "x"},"values":[["1","m"]]}]}']
    assert make("events_intake", "1", "2") == ["1", "2"]
    assert make("axiom", "a" * 30, "b" * 30, max_bytes=40) == [f"[{'a' * 30}]", f"[{'b' * 30}]"]
    row = spark.createDataFrame([(T0, "h", "a b", 2)], "ts timestamp, host string, message string, n bigint")
    assert row.select(sinks.influx_text(row, tags=["host"])).first()[0] == 'logs,host=h message="a b",n=2i 1704067200000000000'
    for name, shape in sinks.SHAPES.items():
        if name.split("_")[-1] not in ("metrics",) and "metrics" not in name:
            assert row.select(shape.event(row)).first()[0], name
    m = row.select(*metric(F.col("ts"), F.lit("x"), "absolute", gauge(F.lit(1.0)), tags_of(a=F.lit("b"))))
    for name, shape in sinks.SHAPES.items():
        if "metrics" in name:
            assert m.select(shape.event(m)).first()[0], name


# ---- pipelines ----


def test_pipeline_ports_wildcards_and_run(spark, tmp_path):
    df = spark.createDataFrame([(T0, i, "abc"[i % 3]) for i in range(9)], "ts timestamp, id bigint, k string")
    config = {
        "transforms": {
            "r": {"type": "route", "inputs": ["in"], "route": {"a": '.k == "a"', "b": '.k == "b"'}},
            "m": {"type": "remap", "inputs": ["r.*"], "source": ".n = .id * 2", "drop_on_error": True},
            "d": {"type": "dedupe", "inputs": ["m"], "fields": {"match": ["k"]}, "order": ["ts", "id"]},
        },
        "sinks": {"out": {"type": "file", "inputs": ["d"], "path": str(tmp_path / "o"), "format": "json"}},
    }
    p = Pipeline(spark, config, {"in": df})
    p.run()
    assert sorted((r.k, r.n) for r in spark.read.json(str(tmp_path / "o")).collect()) == [("a", 0), ("b", 2), ("c", 4)]
    assert p.test({"m": df.limit(1).withColumn("n", F.lit(7))}, "d", [".n == 7", ".n == 8"]) == [True, False]


def test_wrong_configurations(spark):
    bad = {"transforms": {"a": {"type": "filter", "inputs": ["b"], "condition": "true"}, "b": {"type": "filter", "inputs": ["a"], "condition": "true"}, "c": {"type": "nope", "inputs": ["zzz"]}, "d": {"type": "filter"}}}
    with pytest.raises(ConfigError) as e:
        Pipeline(spark, bad)
    for part in ("feeds itself", "no transform", "nothing is named zzz", "d has no inputs"):
        assert part in str(e.value)
    assert interpolated("$A ${B:-x} $$ ${C}", {"A": "1", "C": "3"}) == "1 x $ 3"
    with pytest.raises(ConfigError):
        interpolated("${NOPE}", {})


# ---- streams: the same rows as in batch ----


def landed(spark, tmp_path, df, parts=3):
    path = str(tmp_path / "in")
    df.repartitionByRange(parts, "id").write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def run(query_df, tmp_path, mode="append"):
    q = streams.written(query_df, str(tmp_path / "out"), str(tmp_path / "check"), mode=mode)
    q.awaitTermination(120)
    return query_df.sparkSession.read.schema(query_df.schema).parquet(str(tmp_path / "out"))


def events(spark, n=200):
    return spark.range(n).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("string").alias("k"), (F.col("id") % 7).cast("double").alias("value"))


def test_a_stream_of_windows(spark, tmp_path):
    df = events(spark)
    out = run(streams.aggregated(landed(spark, tmp_path, df), 10_000, ["k"], "sum", "0 seconds"), tmp_path)
    want = {(r.w, r.k): r.v for r in df.groupBy(F.window("ts", "10 seconds")["start"].alias("w"), "k").agg(F.sum("value").alias("v")).collect()}
    got = {(r.window_start, r.k): r.value for r in out.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_a_stream_without_copies(spark, tmp_path):
    df = events(spark)
    out = run(streams.deduplicated(landed(spark, tmp_path, df), ["k"], "1 hour"), tmp_path)
    assert sorted(r.k for r in out.collect()) == ["0", "1", "2"]


def test_a_throttled_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from weirflow.operators.state import throttle

    df = events(spark)
    out = run(streams.throttled(landed(spark, tmp_path, df), ["k"], 2, 20.0), tmp_path)
    assert sorted(r.id for r in out.collect()) == sorted(r.id for r in throttle(df, 2, 20.0, ["k"], order=("ts", "id")).collect())


def test_a_reduced_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from weirflow.operators.reduce import reduce

    df = events(spark)
    out = run(streams.reduced(landed(spark, tmp_path, df), ["k"], ["value"], ["id"], ".value == 6", 5000, "0 seconds"), tmp_path)
    got = {(r.k, r.id): (r.value, r.events) for r in out.collect()}
    rows = df.withColumn("events", F.lit(1)).withColumn("last", F.col("ts"))
    want = {(r.k, r.id): (r.value, r.events) for r in reduce(rows, ["k"], ("ts", "id"), merge_strategies={"id": "min"}, ends_when=".value == 6", expire_after_ms=5000).collect()}
    assert got and all(want.get(k) == v for k, v in got.items())
