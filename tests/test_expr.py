"""The remap language: values, errors, branches, paths and what becomes of rows that fail."""

import pytest

from weirflow.expr import CompileError, ParseError, remap
from weirflow.operators.routing import filter_events


def run(spark, source, schema, *rows, **options):
    df = spark.createDataFrame(list(rows), schema)
    return [r.asDict(recursive=True) for r in remap(df, source, **options).collect()]


def one(spark, source, schema="x string", row=("a",), **options):
    return run(spark, source, schema, row, **options)[0]


@pytest.mark.parametrize(
    "expression, want",
    [
        ("1 + 2 * 3", 7), ("9 / 12", 0.75), ("7 // 2 ?? 0", 3), ("7 % 4 ?? 0", 3), ("(1 + 2) * 3", 9), ('"foo" + "bar"', "foobar"), ("27 == 27.0", True), ('"1" == 1', False), ("1 < 2 && 3 >= 3", True),
        ("null || 5", 5), ("false || true", True), ("!true", False), ("-3", -3), ('upcase("a")', "A"), ('slice!("foobar", 1)', "oobar"), ('slice!("foobar", 0, 1)', "f"), ('slice!("foobar", start: -2)', "ar"), ('slice!("foobar", 1, end: -1)', "ooba"),
        ('truncate("foobar", limit: 3)', "foo"), ('truncate("foobar", limit: 4, suffix: "...")', "foob..."), ('split("a b c d", " ", 3)', ["a", "b", "c d"]), ("split(\"fooaXbbar\", r'(?i)axb')", ["foo", "bar"]),
        ('replace("foo foo", "foo", "bar", count: 1)', "bar foo"), ("replace(\"a1b22\", r'[0-9]+', \"#\")", "a#b#"), ("ceil(92.489, precision: 1)", 92.5), ("floor(92.489, precision: 2)", 92.48), ("round(92.489, precision: 1)", 92.5), ("round(-2.5)", -3.0),
        ('parse_duration!("2s", "ms")', 2000.0), ('parse_duration!("100ms", unit: "s")', 0.1), ('parse_duration!("1h30m", "m")', 90.0), ('parse_bytes!("1KiB", "B")', 1024.0), ('format_number(1234.567, scale: 2, decimal_separator: ",", grouping_separator: ".")', "1.234,56"),
        ('strip_whitespace("  foobar  ")', "foobar"), ('to_string(null) ?? "x"', ""), ('to_int!("42")', 42), ('to_bool!("yes")', True), ('to_float!("1.5")', 1.5), ('contains("foobar", "OBA", case_sensitive: false)', True), ('starts_with("foobar", "FOO")', False), ('ends_with("foobar", "bar")', True),
        ('sha1("foo")', "0beec7b5ea3f0fdbc95d0dd47f3c5bc275da8a33"), ('md5("foo")', "acbd18db4cc2f85cedef654fccc4a4d8"), ('sha2("foo")', "d58042e6aa5a335e03ad576c6a9e43b41591bfd2077f72dec9df7930e492055d"), ('sha2("foo", variant: "SHA-256")', "2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae"),
        ('encode_base64("foo")', "Zm9v"), ('decode_base64!("Zm9v")', "foo"), ('length("foo")', 3), ("length([1, 2])", 2), ("push([1], 2)", [1, 2]), ("append([1], [2, 3])", [1, 2, 3]), ("pop([1, 2])", [1]), ('join(["a", "b"], ",")', "a,b"), ("flatten([[1], [2, 3]])", [1, 2, 3]), ("unique([1, 1, 2])", [1, 2]), ("includes([1, 2], 2)", True),
        ('compact(["", "a", null])', ["a"]), ('is_nullish(" - ")', True), ('is_nullish("a")', False), ("is_null(null)", True), ('is_string("a")', True), ("is_integer(1)", True), ("is_float(1)", False), ('ip_cidr_contains!("192.168.0.0/16", "192.168.10.2")', True), ('ip_cidr_contains!("192.168.0.0/16", "192.169.10.2")', False),
        ('ip_cidr_contains!("2404:6800:4003:c02::/64", "2404:6800:4003:c02::aaaa")', True), ('ip_subnet!("192.168.10.23", "255.255.0.0")', "192.168.0.0"), ('ip_subnet!("192.168.10.23", "/8")', "192.0.0.0"), ('ip_to_ipv6!("192.168.10.2")', "::ffff:192.168.10.2"), ('ipv6_to_ipv4!("::ffff:192.168.10.2")', "192.168.10.2"), ('ip_aton!("1.2.3.4")', 16909060), ("ip_ntoa!(16909060)", "1.2.3.4"),
        ('camelcase("input_string")', "inputString"), ('snakecase("inputString")', "input_string"), ('kebabcase("InputString")', "input-string"), ('pascalcase("input-string")', "InputString"), ('screamingsnakecase("inputString")', "INPUT_STRING"), ('basename("/usr/local/bin")', "bin"), ('dirname("/usr/local/bin")', "/usr/local"), ('find("foobar", "bar")', 3),
        ("sieve(\"abc.dev/lowerUPPER\", permitted_characters: r'[a-z]', replace_single: \"X\", replace_repeated: \"<REMOVED>\")", "abcXdevXlower<REMOVED>"), ('redact("my ssn is 123-45-6789", filters: ["us_social_security_number"])', "my ssn is [REDACTED]"), ("redact(\"id 42\", filters: [r'[0-9]+'])", "id [REDACTED]"), ('redact("x", filters: [])', "x"),
        ("format_int!(42, 2)", "101010"), ('parse_int!("-42")', -42), ('parse_int!("0x2a")', 42), ('encode_percent("a b")', "a%20b"), ('decode_percent("a%20b")', "a b"), ('encode_punycode!("www.café.com")', "www.xn--caf-dma.com"), ('decode_punycode!("www.xn--caf-dma.com")', "www.café.com"), ('decode_mime_q!("=?utf-8?Q?Hello=2C_World!?=")', "Hello, World!"),
        ('to_syslog_level!(3)', "err"), ('to_syslog_facility!(4)', "auth"), ('to_syslog_severity!("alert")', 1), ('parse_tokens!("a \\"b c\\" [d e] -")', ["a", "b c", "d e", None]), ('parse_csv!("a,\\"b,c\\"")', ["a", "b,c"]), ('encode_csv(["a", "b,c"])', 'a,"b,c"'), ('crc("foo")', "2356372769"), ('xxhash("foo")', 3792637401), ('format_timestamp!(from_unix_timestamp!(10), format: "%+")', "1970-01-01T00:00:10+00:00"),
        ('to_string(parse_timestamp!("2021-01-01T00:00:00.5Z", "%+"))', "2021-01-01T00:00:00.500Z"), ('to_unix_timestamp(parse_timestamp!("10", "%s"))', 10), ("chunks([1, 2, 3], 2)", [[1, 2], [3]]), ('tally(["a", "b", "a"])', {"a": 2, "b": 1}), ('strlen("é")', 1), ('length("é")', 2), ('match("abc", r\'^a.c$\')', True), ('shannon_entropy("aabb")', 1.0), ("haversine(0.0, 0.0, 0.0, 0.0)", 0.0),
    ],
)
def test_values(spark, expression, want):
    assert one(spark, f".out = {expression}")["out"] == want


@pytest.mark.parametrize(
    "source, want",
    [
        ("arr = [1, 2, 3]\n.out = filter(arr) -> |i, v| { v > 1 }", [2, 3]), ("arr = [1, 2]\n.out = map_values(arr) -> |v| { v * 10 }", [10, 20]), ('.out = map_keys({"a": 1}) -> |k| { upcase(k) }', None),
        ("if .x == \"a\" { .out = 1 } else { .out = 2 }", 1), (".out = if .x == \"b\" { 1 } else { 2 }", 2), ("y = 1\ny = y + 1\n.out = y", 2), ('.out = to_string!(parse_json("{ no") ?? "nope")', "nope"), (".out = {\"a\": {\"b\": 1}}\n.out.a.c = 2", {"a": {"b": 1, "c": 2}}),
        ('.out = "\\t\\"q\\""', '\t"q"'), (".out = s'raw \\n'", "raw \\n"), (".out = replace_with(\"a1b2\", r'[0-9]') -> |m| { \"<\" + m.string + \">\" }", "a<1>b<2>"), (".out = 1 # a comment", 1), (".out = [1,\n 2]", [1, 2]), ("a.b = 1\n.out = a.b", 1),
        ("set_secret(\"k\", \"v\")\n.out = get_secret(\"k\")", "v"), ("%m.n = 3\n.out = %m.n", 3), (".b[2] = \"two\"\n.b[0] = \"zero\"\n.out = .b", ["zero", None, "two"]), ('.o = {"a": 1}\n.o |= {"b": 2}\n.out = .o', {"a": 1, "b": 2}),
        (".out = merge({\"a\": {\"x\": 1}}, {\"a\": {\"y\": 2}}, deep: true)", {"a": {"x": 1, "y": 2}}), ('.gone = del(.x)\n.out = exists(.x)', False), (".out = exists(.x)", True), (".out = exists(.nope)", False),
    ],
)
def test_programs(spark, source, want):
    if want is None:
        with pytest.raises(CompileError):
            one(spark, source)
    else:
        assert one(spark, source)["out"] == want


def test_failed_assignments_have_the_default_of_their_type(spark):
    out = one(spark, "a = 10\nb = 0\n.q, .err = a / b\n.p, .err2 = parse_json(\"{ INVALID }\")")
    assert out["q"] == 0.0 and out["err"] and out["p"] is None and out["err2"]
    assert one(spark, ".q, .err = 10 / 5")["err"] is None


def test_rows_that_fail(spark):
    rows = [("1",), ("x",)]
    source = ".n = to_int!(.x)\n.x = \"done\""
    assert [(r["n"], r["x"]) for r in run(spark, source, "x string", *rows)] == [(1, "done"), (None, "x")]
    assert [r["n"] for r in run(spark, source, "x string", *rows, drop_on_error=True)] == [1]
    kept, dropped = remap(spark.createDataFrame(rows, "x string"), source, drop_on_error=True, reroute_dropped=True)
    assert [r.x for r in kept.collect()] == ["done"]
    assert [(r.x, "to_int" in r.dropped_reason) for r in dropped.collect()] == [("x", True)]


def test_abort(spark):
    source = ".foo = \"new\"\nif .x == \"a\" { abort }\n.bar = true"
    assert run(spark, source, "x string, foo string", ("a", "old"), ("b", "old")) == [{"x": "b", "foo": "new", "bar": True}]
    kept = run(spark, source, "x string, foo string", ("a", "old"), drop_on_abort=False)
    assert kept == [{"x": "a", "foo": "old", "bar": None}]


def test_an_array_at_the_root_becomes_rows_and_a_scalar_the_message(spark):
    assert [r["message"] for r in run(spark, '. = [{"message": "hello"}, {"message": "world"}]', "x string", ("a",))] == ["hello", "world"]
    assert one(spark, ". = 5") == {"message": 5}


def test_errors_inside_a_branch_count_only_there(spark):
    source = "if .x == \"n\" { .n = to_int!(.v) } else { .n = 0 }"
    rows = run(spark, source, "x string, v string", ("n", "7"), ("t", "text"), ("n", "bad"), drop_on_error=True)
    assert [r["n"] for r in rows] == [7, 0]


def test_nested_paths_and_variants(spark):
    out = one(spark, ".a.b = 123\n.d = parse_json!(.j)\n.e = .d.child.n\n.f = to_int(.e) ?? 0\n.g = .d.list[1] == \"y\"", "j string", ('{"child": {"n": 4}, "list": ["x", "y"]}',))
    assert out["a"] == {"b": 123} and out["f"] == 4 and out["g"] is True


def test_what_is_refused(spark):
    with pytest.raises(ParseError):
        one(spark, ".a = (1")
    for bad in (".a = nope(1)", ".a = to_int(.x)", ".a = y", '.a = 1 + true', '.a = upcase()', ".a = 1 < true"):
        with pytest.raises(CompileError):
            one(spark, bad)


def test_a_condition_with_an_error_is_false(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,)], "v string")
    assert [r.v for r in filter_events(df, "to_int!(.v) > 3").collect()] == ["5"]


def test_lookups_become_joins(spark):
    table = spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "id int, name string")
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    out = remap(df, 'r, err = get_enrichment_table_record("t", {"id": .k})\n.ok = err == null\n.n = length(find_enrichment_table_records("t", {"id": .k}))', tables={"t": table})
    assert {r.k: (r.ok, r.n) for r in out.collect()} == {1: (True, 1), 2: (False, 2), 3: (False, 0)}


@pytest.mark.parametrize(
    "call, want",
    [
        ('parse_common_log!(.x)', ("127.0.0.1 bob frank [10/Oct/2000:13:55:36 -0700] \"GET /a.gif HTTP/1.0\" 200 2326", {"host": "127.0.0.1", "user": "frank", "method": "GET", "path": "/a.gif", "status": 200, "size": 2326})),
        ('parse_apache_log!(.x, format: "combined")', ('127.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 - "http://r" "agent x"', {"referrer": "http://r", "agent": "agent x", "size": None})),
        ('parse_nginx_log!(.x, "combined")', ('172.17.0.1 - alice [01/Apr/2021:12:02:31 +0000] "POST /x HTTP/1.1" 404 153 "http://l/s" "Mozilla/5.0" "2.75"', {"user": "alice", "status": 404, "compression": "2.75"})),
        ('parse_syslog!(.x)', ('<13>1 2020-03-13T20:45:38.119Z host.local non 2426 ID931 [ex@1 k="v"] Try me', {"facility": "user", "severity": "notice", "appname": "non", "message": "Try me", "msgid": "ID931", "structured": {"ex@1.k": "v"}})),
        ('parse_glog!(.x)', ("I20210131 14:48:54.411655 15520 main.c++:9] Hello world!", {"level": "info", "id": 15520, "file": "main.c++", "line": 9, "message": "Hello world!"})),
        ('parse_grok!(.x, "%{TIMESTAMP_ISO8601:timestamp} (%{EMAILADDRESS:email}|%{LOGLEVEL:level}) %{GREEDYDATA:message}")', ("2020-10-02T23:22:12.223222Z info Hello world", {"timestamp": "2020-10-02T23:22:12.223222Z", "level": "info", "email": None, "message": "Hello world"})),
        ('parse_aws_vpc_flow_log!(.x)', ("2 123456789010 eni-1 10.0.0.1 10.0.0.2 443 49152 6 25 20000 1418530010 1418530070 ACCEPT OK", {"srcport": 443, "action": "ACCEPT", "bytes": 20000})),
        ('parse_url!(.x)', ("ftp://foo:bar@example.com:4343/foobar?hello=world#123", {"scheme": "ftp", "username": "foo", "password": "bar", "host": "example.com", "port": 4343, "path": "/foobar", "query": {"hello": "world"}, "fragment": "123"})),
        ('parse_cef!(.x)', ("CEF:0|CyberArk|PTA|12.6|1|Suspected theft|8|suser=mike2@p2.com duser=a b dhost=None", {"deviceVendor": "CyberArk", "severity": "8", "extensions": {"suser": "mike2@p2.com", "duser": "a b", "dhost": "None"}})),
        ("parse_regex!(.x, r'(?P<number>\\d+) (?P<word_a>\\w+)')", ("42 apples", {"number": "42", "word_a": "apples"})),
    ],
)
def test_parsers(spark, call, want):
    text, fields = want
    out = one(spark, f".out = {call}", "x string", (text,))["out"]
    assert {k: out[k] for k in fields} == fields


def test_key_values(spark):
    out = one(spark, ".a = parse_key_value!(.x)\n.b = encode_logfmt({\"b\": \"two words\", \"a\": 1})", "x string", ('level=info msg="a b" done',))
    assert out["a"] == {"level": "info", "msg": "a b", "done": "true"} and out["b"] == 'a=1 b="two words"'
    assert one(spark, ".q = parse_query_string(.x)", "x string", ("?a=1&a=2&b=%20",))["q"] == {"a": ["1", "2"], "b": [" "]}
