"""Queries of the functions and codecs: programs over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..expr import remap
from ..sources import codecs
from .queries import QUERIES, SQL, events, query, table


def programs(name: str, source: str, key: str, pairs: dict[str, tuple[str, str]], prelude: str = "", view: str | None = None) -> None:
    """Registers a query: each column is an expression of the remap language beside its SQL.

    ``prelude`` is a program that runs first; ``view`` is SQL to read from instead of the table.
    """
    text = "\n".join([prelude, *(f".{column} = {expression}" for column, (expression, _) in pairs.items())])

    def run(spark: SparkSession, d: str) -> DataFrame:
        return remap(table(spark, d, source), text).select(key, *pairs)

    QUERIES[name] = run
    SQL[name] = f"select {key}, " + ", ".join(f"{sql} as {column}" for column, (_, sql) in pairs.items()) + f" from {view or source}"


KIND = '"seen_" + string!(.event_type)'

programs("fn_case", "events", "event_id", {
    "camel": (f"camelcase({KIND})", "'seen' || upper(event_type[1]) || event_type[2:]"),
    "pascal": (f"pascalcase({KIND})", "'Seen' || upper(event_type[1]) || event_type[2:]"),
    "snake": (f"snakecase(camelcase({KIND}))", "'seen_' || event_type"),
    "kebab": (f"kebabcase({KIND})", "'seen-' || event_type"),
    "loud": (f"screamingsnakecase({KIND})", "'SEEN_' || upper(event_type)"),
    "small": ("downcase(upcase(.event_type))", "event_type"),
})

programs("fn_text", "events", "event_id", {
    "ends": ('ends_with(.event_type, "w")', "ends_with(event_type, 'w')"),
    "at": ('find(.props, ":")', "strpos(props, ':')::bigint - 1"),
    "size": ("strlen(.props)", "length(props)::bigint"),
    "bare": ('strip_whitespace("  " + string!(.event_type) + " \\n")', "event_type"),
    "both": ('contains_all(.event_type, ["e", "r"])', "contains(event_type, 'e') and contains(event_type, 'r')"),
    "early": ("match(.event_type, r'^[a-m]')", "regexp_matches(event_type, '^[a-m]')"),
    "either": ("match_any(.event_type, [r'^v', r'p$'])", "regexp_matches(event_type, '^v|p$')"),
    "base": ('basename("/a/" + string!(.event_type) + "/x.log")', "'x.log'"),
    "dir": ('dirname("/a/" + string!(.event_type) + "/x.log")', "'/a/' || event_type"),
    "parts": ('join(split_path("/a/" + string!(.event_type)), "|")', "'/|a|' || event_type"),
    "digits": ("sieve(.props, permitted_characters: r'[0-9]')", "regexp_replace(props, '[^0-9]', '', 'g')"),
    "tokens": ('join!(parse_tokens!(string!(.event_type) + " [" + to_string(.user_id) + " a] \\"x y\\""), "|")', "event_type || '|' || user_id || ' a|x y'"),
    "marked": ("replace_with(.props, r'[0-9]+') -> |m| { \"<\" + m.string + \">\" }", r"regexp_replace(props, '([0-9]+)', '<\1>', 'g')"),
    "plain": ('strip_ansi_escape_codes(string!(.event_type) + "\\u{1b}[31m")', "event_type"),
})

programs("fn_types", "events", "event_id", {
    "arr": ("is_array([.user_id])", "true"), "boo": ("is_boolean(.value > 20)", "true"), "emp": ('is_empty(replace(.event_type, "view", ""))', "event_type = 'view'"), "flo": ("is_float(.value)", "true"),
    "int": ("is_integer(.value)", "false"), "jso": ('is_json(if .event_type == "view" { .props } else { .event_type })', "event_type = 'view'"), "nul": ('is_nullish(if .event_type == "view" { " - " } else { .event_type })', "event_type = 'view'"),
    "obj": ('is_object({"a": .user_id})', "true"), "str": ("is_string(.user_id)", "false"), "tim": ("is_timestamp(.ts)", "true"), "kind": ('type_def(.event_type) != null', "true"),
})

programs("fn_convert", "events", "event_id", {
    "text": ("to_string(.user_id)", "user_id::varchar"),
    "number": ("to_float!(to_string(.value))", "value"),
    "yes": ('to_bool!(if .value > 20 { "yes" } else { "no" })', "value > 20"),
    "whole": ("parse_int!(to_string(.user_id))", "user_id"),
    "sixteen": ("format_int!(.user_id, 16)", "format('{:x}', user_id)"),
    "back": ("parse_int!(format_int!(.user_id, 16), 16)", "user_id"),
    "real": ("parse_float!(to_string(.value))", "value"),
    "grouped": ('format_number(.user_id * 1000 + 0.25, scale: 2, decimal_separator: ".", grouping_separator: ",")', "format('{:,.2f}', user_id * 1000 + 0.25)"),
    "level": ("to_syslog_level!(mod!(.user_id, 8))", "(['emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug'])[user_id % 8 + 1]"),
    "severity": ("to_syslog_severity!(to_syslog_level!(mod!(.user_id, 8)))", "user_id % 8"),
    "facility": ("to_syslog_facility!(mod!(.user_id, 4))", "(['kern', 'user', 'mail', 'daemon'])[user_id % 4 + 1]"),
    "code": ("to_syslog_facility_code!(to_syslog_facility!(mod!(.user_id, 4)))", "user_id % 4"),
})

programs("fn_units", "events", "event_id", {
    "at": ("format_timestamp!(from_unix_timestamp!(.user_id), format: \"%Y-%m-%dT%H:%M:%S\")", "strftime(make_timestamp(user_id * 1000000), '%Y-%m-%dT%H:%M:%S')"),
    "again": ('to_unix_timestamp(to_timestamp!(.user_id))', "user_id"),
    "seconds": ('parse_duration!(to_string(.user_id) + "ms", "s")', "user_id / 1000::double"),
    "bytes": ('parse_bytes!(to_string(.user_id) + "KiB", "B")', "user_id * 1024::double"),
    "same_s": ("string!(.event_type)", "event_type"), "same_i": ("int!(.user_id)", "user_id"), "same_f": ("float!(.value)", "value"), "same_b": ("bool!(.value > 20)", "value > 20"),
    "same_t": ("to_unix_timestamp(timestamp!(.ts))", "epoch_us(ts) // 1000000"),
    "zone": ("get_timezone_name!() != \"\"", "true"),
})

ADDRESS = '"10.0." + to_string(mod!(.user_id, 256)) + "." + to_string(mod!(.event_id, 256))'
DOTTED = "'10.0.' || user_id % 256 || '.' || event_id % 256"
programs("fn_addresses", "events", "event_id", {
    "packed": ("ip_ntop!(ip_pton!(a))", DOTTED), "net": ('ip_subnet!(a, "/24")', "'10.0.' || user_id % 256 || '.0'"), "version": ("ip_version!(a)", "'IPv4'"), "is4": ("is_ipv4(a)", "true"),
}, prelude=f"a = {ADDRESS}")

programs("fn_collections", "events", "event_id", {
    "appended": ('join!(append([.event_type], ["a", "b"]), ",")', "event_type || ',a,b'"),
    "cut": ('encode_json(chunks([1, 2, .user_id], 2))', "'[[1,2],[' || user_id || ']]'"),
    "packed": ('join!(compact(["", .event_type, null]), ",")', "event_type"),
    "few": ("length(filter([1, .user_id, 50]) -> |i, v| { v > 40 })", "1 + (user_id > 40)::bigint"),
    "flat": ("encode_json(flatten([[1], [.user_id, 3]]))", "'[1,' || user_id || ',3]'"),
    "tree": ('encode_json(unflatten({"a.b": .user_id}))', """'{"a":{"b":' || user_id || '}}'"""),
    "level": ('encode_json(flatten({"a": {"b": .user_id}}))', """'{"a.b":' || user_id || '}'"""),
    "times": ("encode_json(map_values([1, .user_id]) -> |v| { v * 10 })", "'[10,' || user_id * 10 || ']'"),
    "keys": ('join!(keys({"a": 1, "b": .user_id}), ",")', "'a,b'"),
    "vals": ('encode_json(values({"a": 1, "b": .user_id}))', "'[1,' || user_id || ']'"),
    "zipped": ('encode_json(zip(["a", "b"], ["x", .event_type]))', """'[["a","x"],["b","' || event_type || '"]]'"""),
    "hit": ("match_array([.event_type, \"zzz\"], r'^[a-m]')", "regexp_matches(event_type, '^[a-m]')"),
    "counts": ('encode_json(tally(["z", .event_type, .event_type]))', """'{"' || event_type || '":2,"z":1}'"""),
    "twice": ('tally_value([.event_type, "view"], "view")', "1 + (event_type = 'view')::bigint"),
    "made": ('encode_json(object_from_array([["k", .user_id]]))', """'{"k":' || user_id || '}'"""),
    "got": ('get!({"a": {"b": .user_id}}, ["a", "b"])', "user_id"),
    "put": ('encode_json(set!({"a": {"b": 1}}, ["a", "b"], .user_id))', """'{"a":{"b":' || user_id || '}}'"""),
    "less": ('encode_json(remove!({"a": .user_id, "b": 1}, ["b"]))', """'{"a":' || user_id || '}'"""),
    "merged": ('encode_json(merge({"a": 1}, {"b": .user_id}))', """'{"a":1,"b":' || user_id || '}'"""),
    "there": ("exists(.props)", "true"), "gone": ("exists(.nope)", "false"),
    "first": ('encode_json(array!([.user_id]))', "'[' || user_id || ']'"), "whole": ('encode_json(object!({"a": .user_id}))', """'{"a":' || user_id || '}'"""),
    "own": ('assert!(.user_id >= 0, message: "negative")', "true"), "equal": ("assert_eq!(.user_id, .user_id)", "true"),
})

programs("fn_encodings", "events", "event_id", {
    "csv": ('encode_csv([.event_type, "a,b"])', """event_type || ',"a,b"'"""),
    "pairs": ('encode_key_value({"kind": .event_type, "user": .user_id})', "'kind=' || event_type || ' user=' || user_id"),
    "logfmt": ('encode_logfmt({"kind": .event_type, "what": "a b"})', """'kind=' || event_type || ' what="a b"'"""),
    "percent": ('encode_percent(string!(.event_type) + " x")', "event_type || '%20x'"),
    "plain": ('decode_percent(encode_percent(.props))', "props"),
    "ascii": ('decode_punycode!(encode_punycode!("www.café" + to_string(.user_id) + ".com"))', "'www.café' || user_id || '.com'"),
    "mime": ('decode_mime_q!("=?utf-8?Q?" + string!(.event_type) + "=2C_x?=")', "event_type || ', x'"),
    "sixteen": ("decode_base16!(encode_base16(.props))", "props"), "sixty": ("decode_base64!(encode_base64(.props))", "props"),
    "latin": ('decode_charset!(encode_charset!(.event_type, "iso-8859-1"), "iso-8859-1")', "event_type"),
    "secret": ('decrypt!(encrypt!(.props, "AES-256-CBC-PKCS7", key: "01234567890123456789012345678901", iv: "0123456789012345"), "AES-256-CBC-PKCS7", key: "01234567890123456789012345678901", iv: "0123456789012345")', "props"),
})

programs("fn_compression", "documents", "doc_id", {
    **{n: (f"md5(string!(decode_{n}!(encode_{n}(string!(.text)))))", "md5(text)") for n in ("gzip", "zlib", "zstd")},
    **{n: (f"md5(string!(decode_{n}!(encode_{n}!(string!(.text)))))", "md5(text)") for n in ("snappy", "lz4")},
    "sixty": ("md5(decode_base64!(encode_base64(string!(.text))))", "md5(text)"),
}, view="documents where text is not null", prelude="if is_null(.text) { abort }")

LINE = '"10.0.0.1 - u" + to_string(.user_id) + " [10/Oct/2000:13:55:36 +0000] \\"GET /" + string!(.event_type) + " HTTP/1.0\\" 200 " + to_string(.event_id)'
programs("fn_parse_access", "events", "event_id", {
    "c_user": ("string!(c.user)", "'u' || user_id"), "c_path": ("string!(c.path)", "'/' || event_type"), "c_size": ("int!(c.size)", "event_id"),
    "a_agent": ("string!(a.agent)", "'agent ' || user_id"), "a_path": ("string!(a.path)", "'/' || event_type"),
}, prelude=f'c = parse_common_log!({LINE})\na = parse_apache_log!({LINE} + " \\"http://r\\" \\"agent " + to_string(.user_id) + "\\"", format: "combined")')

programs("fn_parse_nginx", "events", "event_id", {
    "n_user": ("string!(n.user)", "'u' || user_id"), "n_status": ("int!(n.status)", "200"), "n_size": ("int!(n.size)", "event_id"),
}, prelude=f'n = parse_nginx_log!({LINE} + " \\"http://r\\" \\"agent\\"", "combined")')

programs("fn_parse_syslog", "events", "event_id", {
    "s_text": ("string!(s.message)", "event_type"), "s_app": ("string!(s.appname)", "'app'"), "g_line": ("int!(g.line)", "user_id"), "k_text": ("string!(k.message)", "'seen ' || event_type"), "l_text": ("string!(l.message)", "'user ' || user_id"),
}, prelude="""s = parse_syslog!("<13>1 2020-03-13T20:45:38.119Z host app 2426 ID931 - " + string!(.event_type))
g = parse_glog!("I20210131 14:48:54.411655 15520 main.c++:" + to_string(.user_id) + "] Hello")
k = parse_klog!("I0505 17:59:40.692994   28133 klog.go:70] seen " + string!(.event_type))
l = parse_linux_authorization!("Mar 23 01:49:58 localhost sshd[1111]: user " + to_string(.user_id))""")  # fmt: skip

programs("fn_parse_cloud", "events", "event_id", {
    "v_bytes": ("int!(v.bytes)", "event_id"), "v_action": ("string!(v.action)", "'ACCEPT'"), "e_name": ("string!(e.name)", "event_type"),
}, prelude="""v = parse_aws_vpc_flow_log!("2 123456789010 eni-1 10.0.0.1 10.0.0.2 443 49152 6 25 " + to_string(.event_id) + " 1418530010 1418530070 ACCEPT OK")
e = parse_cef!("CEF:0|v|p|1|7|" + string!(.event_type) + "|8|suser=a")""")  # fmt: skip

programs("fn_parse_patterns", "events", "event_id", {
    "word": ("string!(r.word)", "event_type"), "n": ("string!(r.n)", "'42'"), "vowels": ("length(parse_regex_all!(.event_type, r'(?P<c>[aeiou])'))", "length(regexp_replace(event_type, '[^aeiou]', '', 'g'))::bigint"),
    "grok": ("string!(g.kind)", "event_type"), "groks": ("string!(h.kind)", "event_type"),
}, prelude="""r = parse_regex!(string!(.event_type) + " 42", r'(?P<word>\\w+) (?P<n>\\d+)')
g = parse_grok!(string!(.event_type) + " " + to_string(.user_id), "%{WORD:kind} %{INT:n}")
h = parse_groks!(string!(.event_type) + " " + to_string(.user_id), patterns: ["%{INT:x} %{WORD:kind}", "%{WORD:kind} %{INT:n}"])""")  # fmt: skip

programs("fn_parse_pairs", "events", "event_id", {
    "pair": ("string!(p.kind)", "event_type"), "fmt": ("string!(f.kind)", "event_type || ' x'"), "cell": ('join!(parse_csv!("a,\\"" + string!(.event_type) + ",b\\""), "|")', "'a|' || event_type || ',b'"),
    "asked": ("encode_json(q)", """'{"a":["' || event_type || '"],"b":["1"]}'"""), "path": ("string!(u.path)", "'/' || event_type"),
}, prelude="""p = parse_key_value!("user=" + to_string(.user_id) + " kind=" + string!(.event_type))
f = parse_logfmt!("kind=\\"" + string!(.event_type) + " x\\"")
q = parse_query_string("?a=" + string!(.event_type) + "&b=1")
u = parse_url!("https://h.example:8443/" + string!(.event_type) + "?q=1#f")""")  # fmt: skip

programs("fn_parse_trees", "events", "event_id", {
    "ruby": ("encode_json(r)", """'{"kind":"' || event_type || '","n":' || user_id || '}'"""), "xml": ("encode_json(x)", """'{"a":{"kind":"' || event_type || '"}}'"""), "yaml": ("encode_json(y)", """'{"kind":"' || event_type || '","n":' || user_id || '}'"""),
    "json": ("encode_json(j)", "replace(props, ' ', '')"), "nested": ("int!(j.k)", "json_extract(props, '$.k')::bigint"), "valid": ("""validate_json_schema!(.props, s'{"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}')""", "true"),
}, prelude="""r = parse_ruby_hash!("{ :kind => \\"" + string!(.event_type) + "\\", \\"n\\" => " + to_string(.user_id) + " }")
x = parse_xml!("<a><kind>" + string!(.event_type) + "</kind></a>")
y = parse_yaml!("kind: " + string!(.event_type) + "\\nn: " + to_string(.user_id))
j = parse_json!(.props)""")  # fmt: skip

programs("fn_parse_names", "events", "event_id", {
    "etld": ("string!(e.etld_plus)", "event_type || '.co.uk'"), "influx": ('length(parse_influxdb!("cpu,host=a v=" + to_string(.user_id) + ",w=2i 1590488773254420000"))', "2"), "browser": ("string!(a.browser.family)", "'Firefox'"),
}, prelude="""e = parse_etld!(string!(.event_type) + ".co.uk", plus_parts: 1)
a = parse_user_agent("Mozilla/5.0 (X11; Linux x86_64; rv:109.0) Gecko/20100101 Firefox/" + to_string(.user_id) + ".0")""")  # fmt: skip

programs("fn_system", "events", "event_id", {
    "four": ("match(uuid_v4(), r'^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$')", "true"), "seven": ("match(uuid_v7(), r'^[0-9a-f]{8}-[0-9a-f]{4}-7')", "true"),
    "flip": ("is_boolean(random_bool())", "true"), "some": ("length(encode_base16(random_bytes!(8)))", "16"), "unit": ("random_float!(0.0, 1.0) < 1.0", "true"), "die": ("random_int!(1, 7) < 7", "true"),
    "later": ("now() > .ts", "true"), "host": ('get_hostname!() != ""', "true"), "env": ('get_env_var("WEIRFLOW_NOT_SET") ?? "none"', "'none'"),
    "friendly": ('uuid_from_friendly_id!("3s87yEvnmkiPBMHsj8bwwc")', "'7f41deed-d5e2-8b5e-7a13-ab4ff93cfad2'"),
})


# ---- codecs ----


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", "event_type", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"))


@query("select event_id, user_id, event_type from events")
def codec_json(spark, d):
    return codecs.decode_json(codecs.encode_json(_lines(spark, d).select("event_id", "user_id", "event_type")), schema="event_id long, user_id long, event_type string")


@query("select 'event_id=' || event_id || ' event_type=' || event_type as value from events")
def codec_logfmt(spark, d):
    return codecs.encode_logfmt(_lines(spark, d).select("event_id", "event_type"))


@query("select event_id || ',' || event_type || ',,u' || user_id as value from events")
def codec_csv(spark, d):
    return codecs.encode_csv_rows(_lines(spark, d), ["event_id", "event_type", "nope", "host"])


@query("select event_type as value from events")
def codec_text(spark, d):
    return codecs.encode_text(_lines(spark, d), "event_type")


@query("select 'CEF:0|v|p|1|7|' || event_type || '|5|id=' || event_id as value from events")
def codec_cef(spark, d):
    return codecs.encode_cef(_lines(spark, d), "v", "p", "1", "7", "event_type", extensions={"id": "event_id"})


@query("select event_id::varchar as id, 'u' || user_id as host, event_type as message, date_trunc('second', ts) as ts from events")
def codec_gelf(spark, d):
    lines = _lines(spark, d).select("host", "ts", F.col("event_type").alias("message"), F.col("event_id").alias("_id_"))
    out = codecs.decode_gelf(codecs.encode_gelf(lines))
    return out.select(F.col("fields")["id_"].alias("id"), "host", "message", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))


@query("select event_type as name, 'u' || user_id as host, event_id::double as value from events")
def codec_influxdb(spark, d):
    line = F.format_string("%s,host=%s value=%d 1590488773254420000", "event_type", "host", "event_id")
    out = codecs.decode_influxdb(_lines(spark, d).select(line.alias("value")))
    return out.select(F.split("name", "_")[0].alias("name"), F.col("tags")["host"][0].alias("host"), F.col("value.value").alias("value"))


@query("select event_id, event_type as message, 'u' || user_id as host, epoch_us(ts) * 1000 as ns from events")
def codec_otlp(spark, d):
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value"))
    e = _lines(spark, d)
    record = F.struct((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string").alias("timeUnixNano"), F.struct(F.col("event_type").alias("stringValue")).alias("body"), F.array(attribute("id", F.col("event_id"))).alias("attributes"))
    scope = F.array(F.struct(F.array(record).alias("logRecords")))
    whole = F.struct(F.array(F.struct(F.struct(F.array(attribute("host", F.col("host"))).alias("attributes")).alias("resource"), scope.alias("scopeLogs"))).alias("resourceLogs"))
    out = codecs.decode_otlp_logs(e.select(F.to_json(whole).alias("value")))
    return out.select(F.col("attributes")["id"].cast("bigint").alias("event_id"), "message", F.col("resources")["host"].alias("host"), F.col("ts_ns").alias("ns"))


@query("select event_id, event_type from events")
def codec_program(spark, d):
    lines = _lines(spark, d).select(F.concat_ws(" ", "event_id", "event_type").alias("message"))
    out = codecs.decode_program(lines, ".event_id = to_int!(split(.message, \" \")[0])\n.event_type = string!(split(.message, \" \")[1])")
    return out.select("event_id", "event_type")


@query("select event_id, event_type from events")
def codec_frames(spark, d):
    lines = _lines(spark, d).select(F.concat_ws(" ", "event_id", "event_type").alias("value"))
    # several frames a payload, in each kind of framing
    packed = lines.groupBy(F.pmod(F.xxhash64("value"), F.lit(50))).agg(F.array_join(F.collect_list("value"), "\n").alias("value")).select("value")
    out = codecs.split_frames(packed)
    return out.select(F.split(F.col("value").cast("string"), " ")[0].cast("bigint").alias("event_id"), F.split(F.col("value").cast("string"), " ")[1].alias("event_type"))


# ---- known answers: the functions that SQL lacks, by documented values ----

programs("fn_known", "events", "event_id", {
    "crc": ('crc("foo")', "'2356372769'"), "xx": ('xxhash("foo")', "3792637401"), "sha3": ('sha3("foo", variant: "SHA3-256")', "'76d3bc41c9f588f7fcd0d5bf4718f8f84b1c41b20882703100b9eb9413807c01'"),
    "mac": ('encode_base64(hmac("Hello there", "super-secret-key"))', "'eLGE8YMviv85NPXgISRUZxstBNSU47JQdcXkUWcClmI='"),
    "flow": ('community_id!(source_ip: "1.2.3.4", destination_ip: "5.6.7.8", source_port: 1122, destination_port: 3344, protocol: 6)', "'1:wCb3OG7yAFWelaUydu0D+125CLM='"),
    "sea": ('seahash("foobar")', "5348458858952426560"),
})

programs("fn_search", "events", "event_id", {
    "found": ('match_search_query({"message": .event_type}, "view OR error")', "event_type in ('view', 'error')"),
    "secret": ('get_secret("k")', "event_type"),
}, prelude='set_secret("k", string!(.event_type))')
