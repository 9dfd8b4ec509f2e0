"""Encodings, compression, encryption and checksums."""

from __future__ import annotations

import gzip
import hashlib
import hmac as _hmac
import quopri
import re
import zlib
from base64 import b64decode

from pyspark.sql import Column, functions as F

from .convert import text_of
from .registry import Value, function, python_few


def object_map(v: Value) -> Column:
    """An object as a map of texts."""
    if v.type.typeName() == "map":
        return F.transform_values(v.col, lambda _, x: x.cast("string"))
    if v.type.typeName() == "struct":
        return F.create_map(*[x for f in v.type.fields for x in (F.lit(f.name), text_of(Value(v.col.getField(f.name), f.dataType)))])
    return F.from_json(F.to_json(v.col), "map<string,string>")


@function("encode_json", "value", "pretty=False", literal="pretty", typed=True)
def encode_json(value: Value, pretty: bool = False) -> Column:
    """Null fields stay."""
    if value.kind in ("object", "array", "variant"):
        return F.to_json(value.col, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    # a scalar: the text between the brackets of an array of one
    text = F.to_json(F.array(value.col), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


@function("encode_csv", "value", "delimiter=','", literal="delimiter")
def encode_csv(value: Column, delimiter: str = ",") -> Column:
    quote = lambda x: F.when(x.rlike(f'[{re.escape(delimiter)}"\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))
    return F.array_join(F.transform(value, lambda x: quote(x.cast("string"))), delimiter)


@function("encode_key_value", "value", "fields_ordering=[]", "key_value_delimiter='='", "field_delimiter=' '", "flatten_boolean=False", literal="fields_ordering key_value_delimiter field_delimiter flatten_boolean", typed=True)
def encode_key_value(value: Value, fields_ordering: list = (), key_value_delimiter: str = "=", field_delimiter: str = " ", flatten_boolean: bool = False) -> Column:
    """Keys in the order given, then by name; texts with spaces or quotes are quoted."""
    m = object_map(value)
    first = F.filter(F.array(*[F.lit(k) for k in fields_ordering]) if fields_ordering else F.array().cast("array<string>"), lambda k: F.map_contains_key(m, k))
    keys = F.concat(first, F.array_except(F.array_sort(F.map_keys(m)), first))
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    quote = lambda v: F.when(v.rlike(r'[\s"=]') | (v == ""), F.concat(F.lit('"'), escape(v), F.lit('"'))).otherwise(v)
    pair = lambda k: F.concat(quote(k), F.lit(key_value_delimiter), quote(F.coalesce(F.try_element_at(m, k), F.lit("null"))))
    item = (lambda k: F.when(F.try_element_at(m, k) == "true", quote(k)).when(F.try_element_at(m, k) == "false", F.lit(None)).otherwise(pair(k))) if flatten_boolean else pair
    return F.array_join(F.transform(keys, item), field_delimiter)


@function("encode_logfmt", "value", "fields_ordering=[]", literal="fields_ordering", typed=True)
def encode_logfmt(value: Value, fields_ordering: list = ()) -> Column:
    return encode_key_value(value, fields_ordering)


@function("encode_base64", "value", "padding=True", "charset='standard'", literal="padding charset")
def encode_base64(value: Column, padding: bool = True, charset: str = "standard") -> Column:
    out = F.regexp_replace(F.base64(value.cast("binary")), r"[\r\n]", "")
    out = F.translate(out, "+/", "-_") if charset == "url_safe" else out
    return out if padding else F.rtrim(out, F.lit("="))


@function("decode_base64", "value", "charset='standard'", literal="charset", fallible=True)
def decode_base64(value: Column, charset: str = "standard") -> Column:
    plain = F.translate(value, "-_", "+/") if charset == "url_safe" else value
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))


@function("encode_base16", "value")
def encode_base16(value: Column) -> Column:
    return F.lower(F.hex(value.cast("binary")))


@function("decode_base16", "value", fallible=True)
def decode_base16(value: Column) -> Column:
    return F.try_validate_utf8(F.try_to_binary(value, F.lit("hex")).cast("string"))


@function("encode_percent", "value")
def encode_percent(value: Column) -> Column:
    out = F.url_encode(value)
    for a, b in (("\\+", "%20"), ("\\*", "%2A"), ("\\.", "%2E"), ("_", "%5F"), ("-", "%2D")):
        out = F.regexp_replace(out, a, b)
    return out


@function("decode_percent", "value")
def decode_percent(value: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(value, r"\+", "%2B")), value)


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def _text(x: bytes) -> str:
    return x.decode()


for _n, _pack, _unpack in (("gzip", lambda b: gzip.compress(b, mtime=0), gzip.decompress), ("zlib", zlib.compress, zlib.decompress)):
    function(f"encode_{_n}", "value")(lambda value, f=_pack: python_few(lambda x: f(_bytes(x)), "binary", value))

    def _unpacker(value, f=_unpack):
        def run(x):
            try:
                return _text(f(_bytes(x)))
            except (OSError, EOFError, zlib.error) as e:
                raise ValueError(str(e)) from e

        return python_few(run, "string", value)

    function(f"decode_{_n}", "value", fallible=True)(_unpacker)


@function("encode_zstd", "value", "compression_level=3", literal="compression_level")
def encode_zstd(value: Column, compression_level: int = 3) -> Column:
    def run(x):
        import zstandard

        return zstandard.ZstdCompressor(compression_level).compress(_bytes(x))

    return python_few(run, "binary", value)


@function("decode_zstd", "value", fallible=True)
def decode_zstd(value: Column) -> Column:
    def run(x):
        import zstandard

        try:
            return _text(zstandard.ZstdDecompressor().decompressobj().decompress(_bytes(x)))
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e

    return python_few(run, "string", value)


def _arrow_codec(name: str):
    """Blocks with their size in four bytes before them, by Arrow's own codecs."""

    def pack(x):
        import pyarrow as pa

        raw = _bytes(x)
        return len(raw).to_bytes(4, "little") + pa.compress(raw, codec=name, asbytes=True)

    def unpack(x):
        import pyarrow as pa

        try:
            return _text(pa.decompress(_bytes(x)[4:], int.from_bytes(_bytes(x)[:4], "little"), codec=name, asbytes=True))
        except (OSError, pa.ArrowInvalid) as e:
            raise ValueError(str(e)) from e

    return pack, unpack


for _n, _codec in (("snappy", "snappy"), ("lz4", "lz4_raw")):
    _p, _u = _arrow_codec(_codec)
    function(f"encode_{_n}", "value")(lambda value, f=_p: python_few(f, "binary", value))
    function(f"decode_{_n}", "value", fallible=True)(lambda value, f=_u: python_few(f, "string", value))


@function("encode_charset", "value", "to_charset", literal="to_charset")
def encode_charset(value: Column, to_charset: str) -> Column:
    return python_few(lambda x: x.encode(to_charset), "binary", value)


@function("decode_charset", "value", "from_charset", literal="from_charset", fallible=True)
def decode_charset(value: Column, from_charset: str) -> Column:
    return python_few(lambda x: _bytes(x).decode(from_charset), "string", value)


@function("encode_punycode", "value", fallible=True)
def encode_punycode(value: Column) -> Column:
    return python_few(lambda s: ".".join(p if p.isascii() else "xn--" + p.lower().encode("punycode").decode() for p in s.split(".")), "string", value)


@function("decode_punycode", "value", fallible=True)
def decode_punycode(value: Column) -> Column:
    return python_few(lambda s: ".".join(p[4:].encode().decode("punycode") if p.lower().startswith("xn--") else p for p in s.split(".")), "string", value)


_MIME = re.compile(r"=\?([^?]+)\?([QqBb])\?([^?]*)\?=")


@function("decode_mime_q", "value", fallible=True)
def decode_mime_q(value: Column) -> Column:
    """Encoded words in a header's text; what stands between two of them goes if it is blank."""

    def one(m: re.Match) -> str:
        raw = b64decode(m[3]) if m[2] in "Bb" else quopri.decodestring(m[3].replace("_", " "))
        return raw.decode(m[1])

    return python_few(lambda s: _MIME.sub(one, re.sub(r"(\?=)\s+(=\?)", r"\1\2", s)), "string", value)


#: Encryption by name: Spark's mode and padding.
CIPHERS = {
    "AES-256-GCM": "GCM", "AES-192-GCM": "GCM", "AES-128-GCM": "GCM", "AES-256-CBC-PKCS7": "CBC", "AES-192-CBC-PKCS7": "CBC", "AES-128-CBC-PKCS7": "CBC",
}


@function("encrypt", "plaintext", "algorithm", "key", "iv", literal="algorithm")
def encrypt(plaintext: Column, algorithm: str, key: Column, iv: Column) -> Column:
    """The cipher text without its start block."""
    out = F.aes_encrypt(plaintext.cast("binary"), key.cast("binary"), F.lit(CIPHERS[algorithm]), F.lit("DEFAULT"), iv.cast("binary"))
    return F.substring(out, 13 if CIPHERS[algorithm] == "GCM" else 17, 2**31 - 1)


@function("decrypt", "ciphertext", "algorithm", "key", "iv", literal="algorithm", fallible=True)
def decrypt(ciphertext: Column, algorithm: str, key: Column, iv: Column) -> Column:
    return F.try_aes_decrypt(F.concat(iv.cast("binary"), ciphertext), key.cast("binary"), F.lit(CIPHERS[algorithm]), F.lit("DEFAULT")).cast("string")


@function("hmac", "value", "key", "algorithm='SHA-256'", literal="algorithm")
def hmac(value: Column, key: Column, algorithm: str = "SHA-256") -> Column:
    name = {"SHA1": "sha1", "SHA-224": "sha224", "SHA-256": "sha256", "SHA-384": "sha384", "SHA-512": "sha512"}[algorithm]
    return python_few(lambda v, k: _hmac.new(_bytes(k), _bytes(v), name).digest(), "binary", value, key)


@function("md5", "value")
def md5(value: Column) -> Column:
    return F.md5(value.cast("binary"))


@function("sha1", "value")
def sha1(value: Column) -> Column:
    return F.sha1(value.cast("binary"))


@function("sha2", "value", "variant='SHA-512/256'", literal="variant")
def sha2(value: Column, variant: str = "SHA-512/256") -> Column:
    plain = {"SHA-224": 224, "SHA-256": 256, "SHA-384": 384, "SHA-512": 512}
    if variant in plain:
        return F.sha2(value.cast("binary"), plain[variant])
    name = {"SHA-512/224": "sha512_224", "SHA-512/256": "sha512_256"}[variant]
    return python_few(lambda x: hashlib.new(name, _bytes(x)).hexdigest(), "string", value)


@function("sha3", "value", "variant='SHA3-512'", literal="variant")
def sha3(value: Column, variant: str = "SHA3-512") -> Column:
    name = variant.replace("SHA3-", "sha3_")
    return python_few(lambda x: hashlib.new(name, _bytes(x)).hexdigest(), "string", value)


@function("crc", "value", "algorithm='CRC_32_ISO_HDLC'", literal="algorithm")
def crc(value: Column, algorithm: str = "CRC_32_ISO_HDLC") -> Column:
    if algorithm != "CRC_32_ISO_HDLC":
        raise ValueError(f"{algorithm} is not offered")
    return F.crc32(value.cast("binary")).cast("string")


@function("xxhash", "value", "variant='XXH32'", literal="variant")
def xxhash(value: Column, variant: str = "XXH32") -> Column:
    def run(x):
        import xxhash as lib

        out = {"XXH32": lib.xxh32_intdigest, "XXH64": lib.xxh64_intdigest, "XXH3-64": lib.xxh3_64_intdigest}[variant](_bytes(x))
        return out - 2**64 if out >= 2**63 else out

    return python_few(run, "bigint", value)


_MASK = 2**64 - 1


def _stir(x: int) -> int:
    x = x * 0x6EED0E9DA4D94A4F & _MASK
    x ^= (x >> 32) >> (x >> 60)
    return x * 0x6EED0E9DA4D94A4F & _MASK


def sea(data: bytes) -> int:
    """SeaHash with its standard keys."""
    lanes = [0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381]
    for i, at in enumerate(range(0, len(data), 8)):
        lanes[i % 4] = _stir(lanes[i % 4] ^ int.from_bytes(data[at : at + 8], "little"))
    return _stir(lanes[0] ^ lanes[1] ^ lanes[2] ^ lanes[3] ^ len(data))


@function("seahash", "value")
def seahash(value: Column) -> Column:
    def run(x):
        out = sea(_bytes(x))
        return out - 2**64 if out >= 2**63 else out

    return python_few(run, "bigint", value)


@function("encode_proto", "value", "desc_file", "message_type", literal="desc_file message_type")
def encode_proto(value: Column, desc_file: str, message_type: str) -> Column:
    from pyspark.sql.protobuf.functions import to_protobuf

    return to_protobuf(value, message_type, desc_file)


@function("parse_proto", "value", "desc_file", "message_type", literal="desc_file message_type", fallible=True)
def parse_proto(value: Column, desc_file: str, message_type: str) -> Column:
    from pyspark.sql.protobuf.functions import from_protobuf

    return from_protobuf(value, message_type, desc_file, {"mode": "PERMISSIVE"})


