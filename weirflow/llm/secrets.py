"""Secret scan: three base patterns, and a battery of randomness tests over every other long token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

KINDS = ("assign", "access", "hex", "random")
#: Pattern, group that counts, its least length.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12)
# a run that is long enough is the whole run either way, so the least length can stand in the pattern
ACCESS = (r"AKIA[A-Z0-9]{14,}", 0, 18)
HEX = (r"[0-9a-f]{16,}", 0, 16)
TOKEN = (r"[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20)

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
VOWELS, SIGNS = "aeiouAEIOU", "+/_-"
#: Encodings tried in turn: name, what the whole token must look like, its alphabet. Letters of one case alone are a
#: word, whatever its length, and no encoding.
ENCODINGS = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("alnum36", r"^([a-z0-9]+|[A-Z0-9]+)$", LOWER + DIGITS),
    ("alpha52", r"^[A-Za-z]+$", UPPER + LOWER),
    ("alnum62", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("base66", r"^[A-Za-z0-9+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Encodings in which upper case stands for lower case.
FOLDED = (0, 2)
#: Length classes of an encoding, bins of p, the lowest p that is ever reported, tests combined.
CLASSES, P_BINS, FLOOR, TESTS = 8, 400, 0.05, 5
#: Matches that are put in a row at a time, so that work grows with their number and not with its square.
STEP = 128
#: A character that stands for one that a span covers; OTHER in texts that hold it.
FILL, OTHER = "\ufdd0", "\ufdd1"
SPAN = "array<struct<s:bigint,e:bigint,v:string>>"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _pieces(text: Column, pattern: tuple) -> Column:
    """What lies between matches (g), each match (m) and the text that counts (v); the last piece has no match."""
    rx, group, _ = pattern
    rx = F.lit(rx)
    return F.arrays_zip(F.split(text, rx, -1).alias("g"), F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.regexp_extract_all(text, rx, F.lit(group)).alias("v"))


def _matches(text: Column, pattern: tuple) -> Column:
    """Spans of a pattern in code points, with the text that counts; the gaps between matches give the places."""
    least = pattern[2]
    zero = lambda kind: F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    def join(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["v"].alias("v")))
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def spans(z: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(z)), F.lit(STEP))
        parts = F.transform(starts, lambda i: F.aggregate(F.slice(z, i, STEP), zero(SPAN), step))
        return F.aggregate(parts, zero(f"array<{SPAN}>"), join, lambda acc: F.flatten(acc["out"]))

    return F.when(text.rlike(pattern[0]), _bound(_pieces(text, pattern), spans)).otherwise(F.array().cast(SPAN))


def _covered(text: Column, pattern: tuple, hit=None) -> Column:
    """The text with each match that counts, or that ``hit`` of its number picks, written over by FILL."""
    hit = hit or (lambda x, i: F.length(x["v"]) >= pattern[2])
    over = lambda x, i: F.concat(x["g"], F.when(hit(x, i), F.repeat(F.lit(FILL), F.length(x["m"]))).otherwise(F.coalesce(x["m"], F.lit(""))))
    return _bound(_pieces(text, pattern), lambda z: F.array_join(F.transform(z, over), ""))


def _of(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _above(z: Column) -> Column:
    """The normal law's share above z."""
    y = F.abs(z) / 2**0.5
    k = 1 / (1 + 0.3275911 * y)
    tail = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * F.exp(-y * y) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tested(token: Column) -> Column:
    """Stratum (encoding and length class) and p of a token under the hypothesis that it was drawn uniformly; null: no encoding.

    p is that of the smallest of five: chi-squared over the alphabet, over vowels against all else (more of them only) and over
    kinds of characters; runs of one kind (fewer only); serial correlation at lag one. What people write departs in these ways.
    """
    v = F.rtrim(token, F.lit("="))
    name = F.lit(None).cast("int")
    # separate searches: one pattern for both would try every pair of places in a long run of letters
    lower, upper, digit = v.rlike("[a-z]"), v.rlike("[A-Z]"), v.rlike("[0-9]")
    mixed = (digit & (lower | upper)) | (lower & upper)
    for i, (_, rx, _) in reversed(list(enumerate(ENCODINGS))):
        name = F.when(v.rlike(rx) & mixed, i).otherwise(name)
    return _bound(F.struct(v.alias("v"), name.alias("name")), _battery)


def _battery(x: Column) -> Column:
    alphabet = F.get(F.array(*[F.lit(letters) for _, _, letters in ENCODINGS]), x["name"])
    same = F.when(x["name"].isin(*FOLDED), F.lower(x["v"])).otherwise(x["v"])
    kinds = F.translate(same, LOWER + UPPER + DIGITS + SIGNS, "a" * 26 + "A" * 26 + "0" * 10 + "-" * len(SIGNS))
    held = lambda chars: (F.length(same) - F.length(F.translate(same, chars, ""))).cast("double")
    first = F.struct(x["name"].alias("name"), same.alias("same"), alphabet.alias("alphabet"), F.length(same).cast("double").alias("n"), held(VOWELS).alias("vowels"),
                     *[held(c).alias(k) for k, c in zip("ludm", (LOWER, UPPER, DIGITS, SIGNS))], F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")).cast("double").alias("runs"))
    return _bound(first, _sums)


def _sums(x: Column) -> Column:
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    squares = F.aggregate(letters(x["alphabet"]), F.lit(0.0), lambda a, c: a + F.pow((F.length(x["same"]) - F.length(F.replace(x["same"], c, F.lit("")))).cast("double"), F.lit(2.0)))
    index = F.transform(letters(x["same"]), lambda c: (F.position(c, x["alphabet"]) - 1).cast("double"))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "prev", "first", "s", "ss", "p")])

    def step(a: Column, i: Column) -> Column:
        begins = a["n"] == 0
        return F.struct((a["n"] + 1).alias("n"), i.alias("prev"), F.when(begins, i).otherwise(a["first"]).alias("first"), (a["s"] + i).alias("s"), (a["ss"] + i * i).alias("ss"), F.when(begins, 0.0).otherwise(a["p"] + a["prev"] * i).alias("p"))

    return _bound(F.struct(x.alias("x"), squares.alias("squares"), F.aggregate(index, zero, step).alias("a")), _p_value)


def _p_value(y: Column) -> Column:
    x, a, n = y["x"], y["a"], y["x"]["n"]
    sizes = [len(letters) for _, _, letters in ENCODINGS]
    shares = [[sum(c in chars for c in letters) / len(letters) for chars in (LOWER, UPPER, DIGITS, SIGNS)] for _, _, letters in ENCODINGS]
    size, vowel = F.get(_of(sizes), x["name"]), F.get(_of([sum(c in VOWELS for c in letters) / len(letters) for _, _, letters in ENCODINGS]), x["name"])
    alphabet = (y["squares"] * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    vowels = (x["vowels"] - n * vowel) / F.sqrt(n * vowel * (1 - vowel))
    chi, degrees = F.lit(0.0), F.get(_of([sum(p > 0 for p in ps) - 1 for ps in shares]), x["name"])
    for k, kind in enumerate("ludm"):
        p = F.get(_of([ps[k] for ps in shares]), x["name"])
        chi = chi + F.when(p > 0, F.pow(x[kind] - n * p, F.lit(2.0)) / (n * p)).otherwise(0.0)
    spread = 2 / (9 * degrees)
    kinds = (F.pow(chi / degrees, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    change = F.get(_of([1 - sum(p * p for p in ps) for ps in shares]), x["name"])
    twice = F.get(_of([sum(p * (1 - p) ** 2 for p in ps) for ps in shares]), x["name"])
    runs = (x["runs"] - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (twice - change * change))
    mean = a["s"] / n
    lagged = a["p"] - mean * (2 * a["s"] - a["first"] - a["prev"]) + (n - 1) * mean * mean
    whole = a["ss"] - n * mean * mean
    serial = F.when(whole > 0, (lagged / whole + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    least = F.least(_above(alphabet), _above(vowels), _above(kinds), 1 - _above(runs), 2 * _above(F.abs(serial)))
    p = 1 - F.pow(1 - least, F.lit(float(TESTS)))
    grade = F.least(F.lit(CLASSES - 1), F.floor(F.log2(n / 20 + 1e-9) * 2)).cast("int")
    return F.when(x["name"].isNotNull(), F.struct((x["name"] * CLASSES + F.greatest(F.lit(0), grade)).alias("stratum"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)).alias("p")))


def _kind(k: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))


def _is(k: int):
    return lambda x: x["k"] == k


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds to every row base (s, k, e), rest (the text with base spans written over; null without one), tokens and their tests.

    Tokens are looked for in what the base spans leave, so none overlaps one. Tests are null where no encoding fits.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        out = out.withColumn(f"_k{k}", _matches(t, pattern))
    rest = F.when(t.contains(FILL), F.replace(t, F.lit(FILL), F.lit(OTHER))).otherwise(t)
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        out = out.withColumn("_r", F.when(F.size(f"_k{k}") > 0, _covered(rest, pattern)).otherwise(rest))
        rest = F.col("_r")
    base = F.array_sort(F.concat(*[F.transform(f"_k{k}", _kind(k)) for k in range(3)]))
    out = out.withColumn("base", base).withColumn("tokens", _matches(F.col("_r"), TOKEN)).withColumn("rest", F.when(F.size("base") > 0, F.col("_r")))
    return out.withColumn("tests", F.transform("tokens", lambda x: _tested(x["v"]))).drop("_k0", "_k1", "_k2", "_r")


def _bin(p: Column) -> Column:
    return F.least(F.lit(P_BINS - 1), F.floor(p * P_BINS)).cast("int")


def limits(found: DataFrame, rate: float) -> dict[int, int]:
    """For each stratum (encoding and length class) the p bin from which a token is reported.

    Random tokens have a uniform p, others a low one, the longer the lower. Twice the tokens with p over a half are so many random
    ones; the limit is the least p, FLOOR or more, at which the reported tokens beyond that number are at most ``rate`` of
    all that are reported. At most 64 strata by P_BINS bins reach the driver.
    """
    tests = found.select(F.explode("tests").alias("c")).filter("c is not null").select(F.col("c.stratum").alias("stratum"), _bin(F.col("c.p")).alias("bin"))
    counts: dict[int, dict[int, int]] = {}
    for stratum, b, n in tests.groupBy("stratum", "bin").count().collect():
        counts.setdefault(stratum, {})[b] = n
    half, out = P_BINS // 2, {}
    for stratum, by in counts.items():
        random = 2 * (1 + sum(n for b, n in by.items() if b >= half))
        out[stratum] = next((b for b in range(round(FLOOR * P_BINS), half) if 1 - random * (1 - b / P_BINS) / (1 + sum(n for c, n in by.items() if c >= b)) <= rate), half)
    return out


def _reported(limit: dict[int, int]):
    """Whether a test says that its token is a secret."""
    known = F.map_from_arrays(F.array(*map(F.lit, limit)), F.array(*map(F.lit, limit.values()))) if limit else None

    def says(test: Column) -> Column:
        if known is None:
            return F.lit(False)
        return F.coalesce(_bin(test["p"]) >= F.try_element_at(known, test["stratum"]), F.lit(False))

    return says


def _joined(spans: str) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every document.

    A null text counts as empty: no spans, and the hash of the empty string. Rows are judged each by itself, repeated
    rows alike; an empty table gives an empty result; other columns are not read.
    """
    found = scanned(docs.select("doc_id", "text"))
    tokens = F.filter(F.arrays_zip(F.transform("tokens", _kind(3)).alias("t"), F.col("tests").alias("test")), lambda x: x["test"].isNotNull())
    found = staged(found.select("doc_id", "base", tokens.alias("cand"), F.filter("tests", lambda x: x.isNotNull()).alias("tests")))
    says = _reported(limits(found, rate))
    out = found.withColumn("all", F.array_sort(F.concat("base", F.transform(F.filter("cand", lambda x: says(x["test"])), lambda x: x["t"]))))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("all").alias("spans"))


def redacted(docs: DataFrame, rate: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, and n_chars set anew where the text changed. No row is dropped.

    Spans that touch are replaced by one mark. The texts are scanned once; the second pass looks at those with a span only.
    """
    columns = docs.columns
    # numbers for names, so that no column of the documents clashes with one made here
    named = [c if c == "text" else f"d{i}" for i, c in enumerate(columns)]
    found = scanned(docs.toDF(*named))
    found = staged(found.select(*named, "rest", "tests"))
    says = _reported(limits(found.select("tests"), rate))
    text = F.col("text")
    flagged = F.exists("tests", lambda x: says(x))
    rest = F.coalesce("rest", F.replace(text, F.lit(FILL), F.lit(OTHER)))
    over = F.when(flagged, _covered(rest, TOKEN, lambda x, i: F.coalesce(says(F.get("tests", i)), F.lit(False)))).otherwise(rest)
    clean = F.regexp_replace(over, f"{FILL}+", mark.replace("\\", "\\\\").replace("$", "\\$"))
    # what stood for itself comes back
    clean = F.when(text.contains(FILL), F.replace(clean, F.lit(OTHER), F.lit(FILL))).otherwise(clean)
    changed = F.col("rest").isNotNull() | flagged
    out = found.withColumn("_changed", F.coalesce(changed, F.lit(False))).withColumn("_clean", F.when(F.col("_changed"), clean).otherwise(text))
    made = {"text": F.col("_clean")}
    if "n_chars" in columns:
        old = F.col(named[columns.index("n_chars")])
        made["n_chars"] = F.when(F.col("_changed"), F.length("_clean").cast("long")).otherwise(old).cast(docs.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(n)).alias(c) for c, n in zip(columns, named)])
