"""Parsers: each gives null for a text that it cannot read."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, functions as F

from .registry import bound, function, named_groups, python
from .time import java_format


@function("parse_json", "value", "max_depth=None", literal="max_depth", fallible=True)
def parse_json(value: Column, max_depth: int | None = None) -> Column:
    return F.try_parse_json(value)


def grouped(value: Column, pattern: str, kinds: dict[str, str] | None = None, times: dict[str, str] | None = None, dash: bool = False) -> Column:
    """A struct of a pattern's named groups; groups that did not take part are null, as is the whole without a match."""
    plain, names, _ = named_groups(pattern)

    def fields(found: Column) -> Column:
        out = []
        for at, name in enumerate(names):
            text = F.get(found, at)
            text = F.when(~text.isin("", "-") if dash else text != "", text)
            kind = (kinds or {}).get(name)
            if name in (times or {}):
                text = F.try_to_timestamp(text, F.lit(times[name]))
            elif kind:
                text = text.try_cast(kind)
            out.append(text.alias(name))
        return F.struct(*out)

    if not names:
        return F.when(value.rlike(plain), F.struct())
    return bound(value, lambda v: F.when(v.rlike(plain), bound(F.array(*[F.regexp_extract(v, plain, i) for i in names.values()]), fields)))


@function("parse_regex", "value", "pattern", "numeric_groups=False", literal="pattern numeric_groups", fallible=True)
def parse_regex(value: Column, pattern: re.Pattern, numeric_groups: bool = False) -> Column:
    text = pattern.pattern
    if not numeric_groups:
        return grouped(value, text)
    plain, names, n = named_groups(text)
    return F.when(value.rlike(plain), F.struct(*[F.regexp_extract(value, plain, i).alias(k) for k, i in names.items()], *[F.regexp_extract(value, plain, i).alias(str(i)) for i in range(n + 1)]))


@function("parse_regex_all", "value", "pattern", "numeric_groups=False", literal="pattern numeric_groups", fallible=True)
def parse_regex_all(value: Column, pattern: re.Pattern, numeric_groups: bool = False) -> Column:
    plain, names, n = named_groups(pattern.pattern)
    wanted = dict(names) | ({str(i): i for i in range(n + 1)} if numeric_groups else {})
    every = F.arrays_zip(*[F.regexp_extract_all(value, F.lit(plain), F.lit(i)).alias(f"g{i}") for i in sorted(set(wanted.values()))])
    return F.transform(every, lambda x: F.struct(*[x[f"g{i}"].alias(k) for k, i in wanted.items()]))


#: Named patterns that grok expressions are made of.
GROK = {
    "USERNAME": r"[a-zA-Z0-9._-]+", "USER": "%{USERNAME}", "EMAILLOCALPART": r"[a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~][a-zA-Z0-9!#$%&'*+\-/=?^_`{|}~.]*", "EMAILADDRESS": "%{EMAILLOCALPART}@%{HOSTNAME}",
    "INT": r"[+-]?[0-9]+", "BASE10NUM": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)", "NUMBER": "%{BASE10NUM}", "BASE16NUM": r"[+-]?(?:0x)?[0-9A-Fa-f]+", "POSINT": r"\b[1-9][0-9]*\b", "NONNEGINT": r"\b[0-9]+\b",
    "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": ".*?", "GREEDYDATA": ".*", "QUOTEDSTRING": r"\"(?:\\.|[^\\\"])*\"|'(?:\\.|[^\\'])*'", "QS": "%{QUOTEDSTRING}", "UUID": r"[A-Fa-f0-9]{8}-(?:[A-Fa-f0-9]{4}-){3}[A-Fa-f0-9]{12}",
    "MAC": r"(?:[A-Fa-f0-9]{2}[:-]){5}[A-Fa-f0-9]{2}", "IPV4": r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)", "IPV6": r"[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+", "IP": "(?:%{IPV6}|%{IPV4})",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?", "IPORHOST": "(?:%{IP}|%{HOSTNAME})", "HOSTPORT": "%{IPORHOST}:%{POSINT}",
    "PATH": r"(?:/[\w_%!$@:.,+~-]*)+", "UNIXPATH": r"(?:/[\w_%!$@:.,+~-]*)+", "URIPROTO": r"[A-Za-z][A-Za-z0-9+\-.]+", "URIHOST": r"%{IPORHOST}(?::%{POSINT})?", "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+", "URIPARAM": r"\?[^\s]*", "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@]*)?@)?(?:%{URIHOST})?(?:%{URIPATH}(?:%{URIPARAM})?)?",
    "MONTH": r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b", "MONTHNUM": r"(?:0?[1-9]|1[0-2])", "MONTHDAY": r"(?:0[1-9]|[12][0-9]|3[01]|[1-9])", "DAY": r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*", "YEAR": r"(?:\d\d){1,2}",
    "HOUR": r"(?:2[0123]|[01]?[0-9])", "MINUTE": r"[0-5][0-9]", "SECOND": r"(?:[0-5]?[0-9]|60)(?:[:.,][0-9]+)?", "TIME": "%{HOUR}:%{MINUTE}:%{SECOND}", "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))", "TIMESTAMP_ISO8601": r"%{YEAR}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?",
    "HTTPDATE": "%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}", "SYSLOGTIMESTAMP": "%{MONTH} +%{MONTHDAY} %{TIME}", "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+", "LOGLEVEL": r"(?:[Aa]lert|ALERT|[Tt]race|TRACE|[Dd]ebug|DEBUG|[Nn]otice|NOTICE|[Ii]nfo|INFO|[Ww]arn(?:ing)?|WARN(?:ING)?|[Ee]rr(?:or)?|ERR(?:OR)?|[Cc]rit(?:ical)?|CRIT(?:ICAL)?|[Ff]atal|FATAL|[Ss]evere|SEVERE|EMERG(?:ENCY)?|[Ee]merg(?:ency)?)",
}
_GROK = re.compile(r"%\{(\w+)(?::([\w.@\[\]-]+))?(?::(\w+))?\}")


def grok_pattern(expression: str, more: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """A pattern with named groups, and the types that the expression gives them."""
    known, kinds = GROK | (more or {}), {}

    def expand(text: str, depth: int = 0) -> str:
        if depth > 20:
            raise ValueError("patterns refer to one another without end")

        def one(m: re.Match) -> str:
            if m[1] not in known:
                raise ValueError(f"there is no pattern {m[1]}")
            inner = expand(known[m[1]], depth + 1)
            if m[2] is None or depth:
                return f"(?:{inner})"
            if m[3]:
                kinds[m[2]] = {"int": "bigint", "integer": "bigint", "float": "double"}.get(m[3], m[3])
            name = re.sub(r"[^A-Za-z0-9_]", "_", m[2])
            return f"(?P<{name}>{inner})"

        return _GROK.sub(one, text)

    return expand(expression), kinds


@function("parse_grok", "value", "pattern", literal="pattern", fallible=True)
def parse_grok(value: Column, pattern: str) -> Column:
    rx, kinds = grok_pattern(pattern)
    return grouped(value, rx, kinds)


@function("parse_groks", "value", "patterns", "aliases={}", literal="patterns aliases", fallible=True)
def parse_groks(value: Column, patterns: list, aliases: dict | None = None) -> Column:
    """The first expression that fits; fields of the others are null."""
    every = [grok_pattern(p, aliases) for p in patterns]
    names = list(dict.fromkeys(n for rx, _ in every for n in named_groups(rx)[1]))
    out = F.lit(None)
    for rx, kinds in reversed(every):
        one, own = grouped(value, rx, kinds), named_groups(rx)[1]
        shaped = F.struct(*[(one[n] if n in own else F.lit(None).cast("string")).alias(n) for n in names])
        out = F.when(one.isNotNull(), shaped).otherwise(out)
    return out


_COMMON = r'^(?P<host>\S+) (?P<identity>\S+) (?P<user>\S+) \[(?P<timestamp>[^\]]+)\] "(?P<message>(?P<method>\S+) (?P<path>\S+) (?P<protocol>[^"]+))" (?P<status>\d+|-) (?P<size>\d+|-)'
_HTTP_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


@function("parse_common_log", "value", "timestamp_format='%d/%b/%Y:%T %z'", literal="timestamp_format", fallible=True)
def parse_common_log(value: Column, timestamp_format: str = "%d/%b/%Y:%T %z") -> Column:
    return grouped(value, _COMMON + r"\s*$", {"status": "bigint", "size": "bigint"}, {"timestamp": java_format(timestamp_format)}, dash=True)


_APACHE_ERROR = r"^\[(?P<timestamp>[^\]]+)\] \[(?:(?P<module>[^:\]]*):)?(?P<severity>[^\]]+)\] \[pid (?P<pid>\d+)(?::tid (?P<thread>\d+))?\](?: \[client (?P<client>[^:\]]+)(?::(?P<port>\d+))?\])? (?P<message>.*)$"


@function("parse_apache_log", "value", "format", "timestamp_format='%d/%b/%Y:%T %z'", literal="format timestamp_format", fallible=True)
def parse_apache_log(value: Column, format: str, timestamp_format: str = "%d/%b/%Y:%T %z") -> Column:
    numbers = {"status": "bigint", "size": "bigint", "pid": "bigint", "port": "bigint"}
    if format == "common":
        return parse_common_log(value, timestamp_format)
    if format == "combined":
        return grouped(value, _COMMON + r' "(?P<referrer>[^"]*)" "(?P<agent>[^"]*)"\s*$', numbers, {"timestamp": java_format(timestamp_format)}, dash=True)
    if format == "error":
        return grouped(value, _APACHE_ERROR, numbers, {"timestamp": "EEE MMM dd HH:mm:ss[.SSSSSS] yyyy"})
    raise ValueError(f"{format} is none of common, combined, error")


_NGINX = r'^(?P<client>\S+) - (?P<user>\S+) \[(?P<timestamp>[^\]]+)\] "(?P<request>[^"]*)" (?P<status>\d+) (?P<size>\d+) "(?P<referer>[^"]*)" "(?P<agent>[^"]*)"(?: "(?P<compression>[^"]*)")?\s*$'
_NGINX_ERROR = r"^(?P<timestamp>\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(?P<severity>\w+)\] (?P<pid>\d+)#(?P<tid>\d+):(?: \*(?P<cid>\d+))? (?P<message>.*?)(?:, client: (?P<client>[^,]+))?(?:, server: (?P<server>[^,]*))?(?:, request: \"(?P<request>[^\"]*)\")?(?:, upstream: \"(?P<upstream>[^\"]*)\")?(?:, host: \"(?P<host>[^\"]*)\")?\s*$"


@function("parse_nginx_log", "value", "format", "timestamp_format=None", literal="format timestamp_format", fallible=True)
def parse_nginx_log(value: Column, format: str, timestamp_format: str | None = None) -> Column:
    numbers = {k: "bigint" for k in ("status", "size", "pid", "tid", "cid")}
    if format == "combined":
        return grouped(value, _NGINX, numbers, {"timestamp": java_format(timestamp_format) if timestamp_format else _HTTP_TIME}, dash=True)
    if format == "error":
        return grouped(value, _NGINX_ERROR, numbers, {"timestamp": "yyyy/MM/dd HH:mm:ss"})
    raise ValueError(f"{format} is none of combined, error")


_RFC5424 = r"^<(?P<pri>\d{1,3})>(?P<version>\d+) (?P<timestamp>\S+) (?P<hostname>\S+) (?P<appname>\S+) (?P<procid>\S+) (?P<msgid>\S+) (?P<data>-|(?:\[(?:[^\]\\\"]|\"(?:[^\"\\]|\\.)*\")*\])+)(?: (?P<message>(?s:.*)))?$"
_RFC3164 = r"^(?:<(?P<pri>\d{1,3})>)?(?P<timestamp>[A-Z][a-z]{2} +\d{1,2} \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\S+) (?P<hostname>\S+) (?P<appname>[^\s:\[]+)(?:\[(?P<procid>[^\]]*)\])?: ?(?P<message>(?s:.*))$"


def syslog(value: Column) -> Column:
    """timestamp, hostname, facility, severity, version, appname, procid, msgid, message, structured (data of RFC 5424 as a map)."""
    from .convert import FACILITIES, LEVELS, named

    def fields(found: Column) -> Column:
        new, old = found["new"], found["old"]
        pick = lambda k: F.coalesce(new[k], old[k])
        year = F.concat(F.date_format(F.current_timestamp(), "yyyy "), F.regexp_replace(old["timestamp"], " +", " "))
        at = F.coalesce(new["timestamp"].try_cast("timestamp"), old["timestamp"].try_cast("timestamp"), F.try_to_timestamp(year, F.lit("yyyy MMM d HH:mm:ss")))
        facility = bound(pick("pri").cast("int"), lambda pri: named(FACILITIES, F.floor(pri / 8)))
        severity = bound(pick("pri").cast("int"), lambda pri: named(LEVELS, pri % 8))
        blocks = F.regexp_extract_all(new["data"], F.lit(r'\[(?:[^\]\\"]|"(?:[^"\\]|\\.)*")*\]'), F.lit(0))
        name = lambda b: F.regexp_extract(b, r"^\[([^\s\]]+)", 1)
        params = lambda b: F.transform(F.regexp_extract_all(b, F.lit(r'([^\s=\["]+)="((?:[^"\\]|\\.)*)"'), F.lit(0)), lambda p: F.struct(F.concat(name(b), F.lit("."), F.substring_index(p, "=", 1)).alias("key"), F.regexp_replace(F.regexp_extract(p, r'(?s)="(.*)"$', 1), r'\\(["\\\]])', "$1").alias("value")))
        # of a name given twice the last value holds
        last = lambda every: F.filter(every, lambda e, i: ~F.exists(F.slice(every, i + 2, F.size(every)), lambda x: x["key"] == e["key"]))
        structured = F.map_from_entries(bound(F.flatten(F.transform(blocks, params)), last))
        return F.when(new.isNotNull() | old.isNotNull(), F.struct(
            at.alias("timestamp"), pick("hostname").alias("hostname"), facility.alias("facility"), severity.alias("severity"),
            new["version"].try_cast("int").alias("version"), pick("appname").alias("appname"), pick("procid").alias("procid"), new["msgid"].alias("msgid"), F.trim(pick("message")).alias("message"), structured.alias("structured"),
        ))

    def read(v: Column) -> Column:
        # no line fits both: after the priority one has a version, the other a date
        new = grouped(v, _RFC5424, dash=True)
        return bound(new, lambda x: bound(F.struct(x.alias("new"), F.when(x.isNull(), grouped(v, _RFC3164)).alias("old")), fields))

    return bound(value, read)


@function("parse_syslog", "value", fallible=True)
def parse_syslog(value: Column) -> Column:
    return syslog(value)


@function("parse_linux_authorization", "value", fallible=True)
def parse_linux_authorization(value: Column) -> Column:
    return syslog(value)


_GLOG = r"^(?P<level>[IWEF])(?P<timestamp>\d{8} \d\d:\d\d:\d\d\.\d+) +(?P<id>\d+) (?P<file>[^:]+):(?P<line>\d+)\] (?P<message>.*)$"
_KLOG = r"^(?P<level>[IWEF])(?P<timestamp>\d{4} \d\d:\d\d:\d\d\.\d+) +(?P<id>\d+) (?P<file>[^:]+):(?P<line>\d+)\] (?P<message>.*)$"
_GLOG_LEVELS = {"I": "info", "W": "warning", "E": "error", "F": "fatal"}


def _leveled(found: Column) -> Column:
    level = F.create_map(*[F.lit(x) for kv in _GLOG_LEVELS.items() for x in kv])
    return bound(found, lambda x: F.when(x.isNotNull(), x.withField("level", F.element_at(level, x["level"]))))


@function("parse_glog", "value", fallible=True)
def parse_glog(value: Column) -> Column:
    return _leveled(grouped(value, _GLOG, {"id": "bigint", "line": "bigint"}, {"timestamp": "yyyyMMdd HH:mm:ss.SSSSSS"}))


@function("parse_klog", "value", fallible=True)
def parse_klog(value: Column) -> Column:
    """The year is the current one, as the text has none."""
    found = grouped(value, _KLOG, {"id": "bigint", "line": "bigint"})
    at = lambda x: F.try_to_timestamp(F.concat(F.date_format(F.current_timestamp(), "yyyy"), x["timestamp"]), F.lit("yyyyMMdd HH:mm:ss.SSSSSS"))
    return _leveled(bound(found, lambda x: F.when(x.isNotNull(), x.withField("timestamp", at(x)))))


#: Fields of a load balancer's log, in order, with the types of those that are not text.
_ALB = ("type timestamp elb client_host target_host request_processing_time:double target_processing_time:double response_processing_time:double elb_status_code target_status_code received_bytes:bigint sent_bytes:bigint request user_agent ssl_cipher ssl_protocol target_group_arn trace_id domain_name chosen_cert_arn matched_rule_priority request_creation_time actions_executed redirect_url error_reason target_port_list target_status_code_list classification classification_reason")
_VPC = "version:int account_id interface_id srcaddr dstaddr srcport:int dstport:int protocol:int packets:bigint bytes:bigint start:bigint end:bigint action log_status"


def _columns(parts: Column, spec: str) -> Column:
    fields = []
    for i, f in enumerate(spec.split()):
        name, _, kind = f.partition(":")
        text = F.get(parts, i)
        text = F.when(text != "-", text)
        fields.append((text.try_cast(kind) if kind else text).alias(name))
    return F.struct(*fields)


@function("parse_aws_alb_log", "value", fallible=True)
def parse_aws_alb_log(value: Column) -> Column:
    parts = F.transform(F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]|\\.)*"|\S+'), F.lit(0)), lambda x: F.regexp_replace(x, r'^"|"$', ""))
    n = len(_ALB.split())
    return F.when(F.size(parts) >= n - 4, _columns(parts, _ALB))


@function("parse_aws_vpc_flow_log", "value", "format=None", literal="format", fallible=True)
def parse_aws_vpc_flow_log(value: Column, format: str | None = None) -> Column:
    known = {f.partition(":")[0]: f for f in _VPC.split()}
    spec = _VPC if format is None else " ".join(known.get(f, f) for f in format.replace("-", "_").split())
    parts = F.split(F.trim(value), r"\s+")
    return F.when(F.size(parts) == len(spec.split()), _columns(parts, spec))


@function("parse_aws_cloudwatch_log_subscription_message", "value", fallible=True)
def parse_subscription(value: Column) -> Column:
    shape = "owner string, messageType string, logGroup string, logStream string, subscriptionFilters array<string>, logEvents array<struct<id: string, timestamp: bigint, message: string>>"
    x = F.from_json(value, shape)
    events = F.transform(x["logEvents"], lambda e: F.struct(e["id"].alias("id"), F.timestamp_millis(e["timestamp"]).alias("timestamp"), e["message"].alias("message")))
    return F.when(x["messageType"].isNotNull(), F.struct(x["owner"].alias("owner"), x["messageType"].alias("message_type"), x["logGroup"].alias("log_group"), x["logStream"].alias("log_stream"), x["subscriptionFilters"].alias("subscription_filters"), events.alias("log_events")))


@function("parse_cef", "value", fallible=True)
def parse_cef(value: Column) -> Column:
    """The seven parts of the header, and the extensions as a map."""
    head = r"CEF:(?P<cefVersion>\d+)\|(?P<deviceVendor>(?:[^|\\]|\\.)*)\|(?P<deviceProduct>(?:[^|\\]|\\.)*)\|(?P<deviceVersion>(?:[^|\\]|\\.)*)\|(?P<deviceEventClassId>(?:[^|\\]|\\.)*)\|(?P<name>(?:[^|\\]|\\.)*)\|(?P<severity>[^|]*)\|(?P<rest>.*)$"
    x = grouped(value, head)
    pairs = F.regexp_extract_all(x["rest"], F.lit(r"(\w+)=((?:[^=\\]|\\.)*?)(?=\s+\w+=|\s*$)"), F.lit(0))
    more = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(F.regexp_extract(p, r"(?s)^\w+=(.*)$", 1), r"\\([=|\\])", "$1").alias("value"))))
    return F.when(x.isNotNull(), F.struct(*[F.regexp_replace(x[n], r"\\([|\\])", "$1").alias(n) for n in ("cefVersion", "deviceVendor", "deviceProduct", "deviceVersion", "deviceEventClassId", "name", "severity")], more.alias("extensions")))


def _pairs(text: str, between: str, after: str, standalone: bool) -> dict[str, str]:
    out: dict[str, str] = {}
    rx = re.compile(rf'("(?:[^"\\]|\\.)*"|(?:(?!{re.escape(between)}|{re.escape(after)})[^\s])+)(?:\s*{re.escape(between)}\s*("(?:[^"\\]|\\.)*"|\'[^\']*\'|\[[^\]]*\]|(?:(?!{re.escape(after)}).)*))?')
    plain = lambda s: re.sub(r"\\(.)", r"\1", s[1:-1]) if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s.strip()
    for m in rx.finditer(text):
        if m[2] is None:
            if not standalone:
                continue
            out[plain(m[1])] = "true"
        else:
            out[plain(m[1])] = plain(m[2])
    if not out:
        raise ValueError(text)
    return out


@function("parse_key_value", "value", "key_value_delimiter='='", "field_delimiter=' '", "whitespace='lenient'", "accept_standalone_key=True", literal="key_value_delimiter field_delimiter whitespace accept_standalone_key", fallible=True)
def parse_key_value(value: Column, key_value_delimiter: str = "=", field_delimiter: str = " ", whitespace: str = "lenient", accept_standalone_key: bool = True) -> Column:
    return python(lambda s: _pairs(s, key_value_delimiter, field_delimiter, accept_standalone_key), "map<string,string>", value)


@function("parse_logfmt", "value", fallible=True)
def parse_logfmt(value: Column) -> Column:
    return parse_key_value(value)


@function("parse_csv", "value", "delimiter=','", literal="delimiter", fallible=True)
def parse_csv(value: Column, delimiter: str = ",") -> Column:
    def read(s: str) -> list[str]:
        import csv

        return next(csv.reader([s], delimiter=delimiter), [])

    # a line without quotes needs no parser
    return F.when(~value.contains('"'), F.split(value, re.escape(delimiter), -1)).otherwise(python(read, "array<string>", F.when(value.contains('"'), value)))


@function("parse_query_string", "value")
def parse_query_string(value: Column) -> Column:
    """Keys with all their values."""
    bare = F.regexp_replace(value, r"^\?", "")
    pairs = F.transform(F.filter(F.split(bare, "&"), lambda p: p != ""), lambda p: F.struct(_plus(F.substring_index(p, "=", 1)).alias("k"), F.when(p.contains("="), _plus(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.lit("")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("value"))))


def _plus(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(value), value)


_URL = r"^(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*)://(?:(?P<username>[^:@/?#]*)(?::(?P<password>[^@/?#]*))?@)?(?P<host>\[[^\]]*\]|[^:/?#]*)(?::(?P<port>\d+))?(?P<path>/[^?#]*)?(?:\?(?P<query>[^#]*))?(?:#(?P<fragment>.*))?$"
#: Ports that a scheme implies.
PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


@function("parse_url", "value", "default_known_ports=False", literal="default_known_ports", fallible=True)
def parse_url(value: Column, default_known_ports: bool = False) -> Column:
    x = grouped(value, _URL, {"port": "bigint"})
    port = x["port"]
    for scheme, p in PORTS.items() if default_known_ports else ():
        port = F.coalesce(port, F.when(F.lower(x["scheme"]) == scheme, F.lit(p).cast("bigint")))
    blank = lambda n: F.coalesce(x[n], F.lit(""))
    query = F.transform_values(parse_query_string(blank("query")), lambda _, v: F.get(v, 0))
    return F.when(x.isNotNull(), F.struct(F.lower(x["scheme"]).alias("scheme"), blank("username").alias("username"), blank("password").alias("password"), F.lower(x["host"]).alias("host"), port.alias("port"), F.coalesce(x["path"], F.lit("/")).alias("path"), query.alias("query"), x["fragment"].alias("fragment")))


#: Suffixes under which names are registered, besides single labels.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.za", "co.kr", "com.tr", "com.ar", "com.tw")


@function("parse_etld", "value", "plus_parts=0", "psl=None", literal="plus_parts psl", fallible=True)
def parse_etld(value: Column, plus_parts: int = 0, psl: list | None = None) -> Column:
    """The suffix under which a name is registered, with so many labels before it."""
    two = F.substring_index(value, ".", -2)
    known = two.isin(*(psl or SUFFIXES))
    etld = F.when(known, two).otherwise(F.substring_index(value, ".", -1))
    plus = F.when(known, F.substring_index(value, ".", -2 - plus_parts)).otherwise(F.substring_index(value, ".", -1 - plus_parts))
    return F.struct(etld.alias("etld"), plus.alias("etld_plus"), known.alias("known_suffix"))


@function("parse_xml", "value", literal="", fallible=True)
def parse_xml(value: Column) -> Column:
    """Elements as objects: repeated children as arrays, attributes under @, text under text."""

    def read(s: str) -> str:
        import xml.etree.ElementTree as E

        if "<!DOCTYPE" in s or "<!ENTITY" in s:
            raise ValueError("declarations are not read")

        def walk(e):
            out: dict = {f"@{k}": v for k, v in e.attrib.items()}
            for c in e:
                x = walk(c)
                if c.tag in out:
                    out[c.tag] = [*out[c.tag], x] if isinstance(out[c.tag], list) else [out[c.tag], x]
                else:
                    out[c.tag] = x
            text = (e.text or "").strip()
            return (out | {"text": text} if text else out) if out else text

        try:
            root = E.fromstring(s)
        except E.ParseError as e:
            raise ValueError(str(e)) from e
        return json.dumps({root.tag: walk(root)})

    return F.try_parse_json(python(read, "string", value, pure=True))


@function("parse_yaml", "value", fallible=True)
def parse_yaml(value: Column) -> Column:
    """Needs a YAML library on the executors."""

    def read(s: str) -> str:
        import yaml

        try:
            # the parser in C takes a fifth of the time
            return json.dumps(yaml.load(s, getattr(yaml, "CSafeLoader", yaml.SafeLoader)), default=str)
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e

    return F.try_parse_json(python(read, "string", value, pure=True))


_RUBY = re.compile(r':"([^"]*)"\s*=>|:(\w+)\s*=>|"((?:[^"\\]|\\.)*)"\s*=>|(\d+)\s*=>|\bnil\b|(?<![:\w"]):(\w+)')


@function("parse_ruby_hash", "value", fallible=True)
def parse_ruby_hash(value: Column) -> Column:
    def read(s: str) -> str:
        def one(m: re.Match) -> str:
            key = next((g for g in m.groups()[:4] if g is not None), None)
            return "null" if m[0] == "nil" else json.dumps(m[5]) if key is None else json.dumps(key) + ":"

        return json.dumps(json.loads(_RUBY.sub(one, s)))

    return F.try_parse_json(python(read, "string", value, pure=True))


def cbor(data: bytes, at: int = 0):
    """The value that starts at a place, and where it ends (RFC 8949, definite and indefinite lengths)."""
    import struct

    if at >= len(data):
        raise ValueError("it ends early")
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    if low < 24:
        n = low
    elif low < 28:
        size = 1 << (low - 24)
        n, raw = int.from_bytes(data[at : at + size], "big"), data[at : at + size]
        at += size
    elif low == 31 and major in (2, 3, 4, 5):
        items = []
        while data[at] != 0xFF:
            x, at = cbor(data, at)
            items.append(x)
        at += 1
        if major == 5:
            return dict(zip(items[::2], items[1::2])), at
        return (items if major == 4 else (b"" if major == 2 else "").join(items)), at
    else:
        raise ValueError(low)
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        part = data[at : at + n]
        return (part if major == 2 else part.decode()), at + n
    if major == 4:
        out = []
        for _ in range(n):
            x, at = cbor(data, at)
            out.append(x)
        return out, at
    if major == 5:
        made = {}
        for _ in range(n):
            k, at = cbor(data, at)
            made[k], at = cbor(data, at)
        return made, at
    if major == 6:
        return cbor(data, at)
    if low in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], raw)[0], at
    return {20: False, 21: True}.get(low), at


@function("parse_cbor", "value", fallible=True)
def parse_cbor(value: Column) -> Column:
    def read(x) -> str:
        raw = x.encode("latin-1") if isinstance(x, str) else bytes(x)
        return json.dumps(cbor(raw)[0], default=lambda b: b.decode("latin-1"))

    return F.try_parse_json(python(read, "string", value))


_INFLUX = re.compile(r"^((?:[^,\s\\]|\\.)+)((?:,(?:[^=,\s\\]|\\.)+=(?:[^,\s\\]|\\.)+)*)\s+((?:[^=,\s\\]|\\.)+=(?:\"(?:[^\"\\]|\\.)*\"|[^,\s]+)(?:,(?:[^=,\s\\]|\\.)+=(?:\"(?:[^\"\\]|\\.)*\"|[^,\s]+))*)(?:\s+(-?\d+))?\s*$")


def influx_line(line: str) -> list[dict]:
    """Gauges of a line: a name, tags, and nanoseconds since 1970, one for each field that is a number or truth value."""
    m = _INFLUX.match(line)
    if not m:
        raise ValueError(line)
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    split = lambda s: re.findall(r"((?:[^=,\s\\]|\\.)+)=(\"(?:[^\"\\]|\\.)*\"|(?:[^,\\]|\\.)+)", s)
    tags = {plain(k): plain(v) for k, v in split(m[2])}
    out = []
    for k, v in split(m[3]):
        if v.startswith('"'):
            continue
        low = v.lower()
        number = 1.0 if low in ("t", "true") else 0.0 if low in ("f", "false") else float(v.rstrip("iu"))
        out.append({"name": f"{plain(m[1])}_{plain(k)}", "tags": tags, "value": number, "ns": int(m[4]) if m[4] else None})
    return out


@function("parse_influxdb", "value", fallible=True)
def parse_influxdb(value: Column) -> Column:
    return python(influx_line, "array<struct<name: string, tags: map<string,string>, value: double, ns: bigint>>", value)


#: What tells browsers, systems and devices apart in a user agent, tried in turn.
_BROWSERS = (("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"OPR/([\d.]+)"), ("Firefox", r"Firefox/([\d.]+)"), ("Chrome", r"Chrome/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari"), ("curl", r"curl/([\d.]+)"))
_SYSTEMS = (("iOS", r"(?:iPhone|iPad).*? OS ([\d_]+)"), ("Android", r"Android ([\d.]+)"), ("Windows", r"Windows NT ([\d.]+)"), ("Mac OSX", r"Mac OS X ([\d_.]+)"), ("Linux", r"Linux()"))


@function("parse_user_agent", "value", "mode='fast'", literal="mode")
def parse_user_agent(value: Column, mode: str = "fast") -> Column:
    def family(table) -> Column:
        name, version = F.lit(None).cast("string"), F.lit(None).cast("string")
        for n, rx in reversed(table):
            hit = value.rlike(rx)
            name, version = F.when(hit, F.lit(n)).otherwise(name), F.when(hit, F.translate(F.regexp_extract(value, rx, 1), "_", ".")).otherwise(version)
        return F.struct(name.alias("family"), F.nullif(version, F.lit("")).alias("version"))

    device = F.when(value.rlike("iPad|Tablet"), "tablet").when(value.rlike("Mobile|iPhone|Android"), "smartphone").when(value.rlike(r"(?i)bot|crawler|spider"), "crawler").otherwise("pc")
    return F.struct(family(_BROWSERS).alias("browser"), family(_SYSTEMS).alias("os"), F.struct(device.alias("category")).alias("device"))


def fits(x, schema: dict) -> bool:
    """Whether a value meets a JSON schema: type, enum, const, bounds, lengths, pattern, required, properties, items and combinations."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    if schema is True or schema is False:
        return schema

    def of(t: str) -> bool:
        if t in ("number", "integer"):
            return isinstance(x, (int, float)) and not isinstance(x, bool) and (t == "number" or float(x).is_integer())
        return isinstance(x, kinds[t])

    if "type" in schema and not any(map(of, [schema["type"]] if isinstance(schema["type"], str) else schema["type"])):
        return False
    if "enum" in schema and x not in schema["enum"] or "const" in schema and x != schema["const"]:
        return False
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        if x < schema.get("minimum", x) or x > schema.get("maximum", x) or "exclusiveMinimum" in schema and x <= schema["exclusiveMinimum"] or "exclusiveMaximum" in schema and x >= schema["exclusiveMaximum"]:
            return False
    if isinstance(x, str) and (not schema.get("minLength", 0) <= len(x) <= schema.get("maxLength", len(x)) or "pattern" in schema and not re.search(schema["pattern"], x)):
        return False
    if isinstance(x, list):
        if not schema.get("minItems", 0) <= len(x) <= schema.get("maxItems", len(x)) or not all(fits(y, schema["items"]) for y in x if "items" in schema):
            return False
    if isinstance(x, dict):
        known = schema.get("properties", {})
        if any(k not in x for k in schema.get("required", ())) or not all(fits(x[k], s) for k, s in known.items() if k in x):
            return False
        more = schema.get("additionalProperties", True)
        if not all(fits(v, more) for k, v in x.items() if k not in known):
            return False
    if not all(fits(x, s) for s in schema.get("allOf", ())) or "anyOf" in schema and not any(fits(x, s) for s in schema["anyOf"]):
        return False
    return not ("oneOf" in schema and sum(fits(x, s) for s in schema["oneOf"]) != 1 or "not" in schema and fits(x, schema["not"]))


@function("validate_json_schema", "value", "schema", literal="schema", fallible=True)
def validate_json_schema(value: Column, schema: str) -> Column:
    wanted = json.loads(schema)

    def test(s: str) -> bool:
        return fits(json.loads(s), wanted)

    return python(test, "boolean", value, pure=True)


