"""Scalar functions of the analytics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("high", "medium", "low")


def severity_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(3)


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes as 16 hex digits, in halves of 32 bits: the prime is 2^40 + 435, so no product reaches 2^42."""
    # one character a byte
    chars = F.filter(F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), ""), lambda c: c != "")
    long_ = lambda n: F.lit(n).cast("long")
    mask = long_(0xFFFFFFFF)

    def step(h: Column, c: Column) -> Column:
        low = h["low"].bitwiseXOR(F.ascii(c).cast("long"))
        high = h["high"] * long_(435) + F.shiftleft(low, 8) + F.shiftright(low * long_(435), 32)
        return F.struct(high.bitwiseAND(mask).alias("high"), (low * long_(435)).bitwiseAND(mask).alias("low"))

    start = F.struct(long_(0xCBF29CE4).alias("high"), long_(0x84222325).alias("low"))
    word = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(chars, start, step, lambda h: F.concat(word(h["high"]), word(h["low"])))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; empty: 0."""
    chars, n = F.filter(F.split(text, ""), lambda c: c != ""), F.length(text)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def public_ipv4(ip: Column) -> Column:
    """True for a dotted quad outside private, loopback, link-local, shared, test and reserved ranges."""
    o = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    a, b, c = o[0], o[1], o[2]
    private = a.isin(0, 10, 127) | (a == 169) & (b == 254) | (a == 172) & b.between(16, 31) | (a == 192) & (b == 168)
    special = (a == 100) & b.between(64, 127) | (a == 192) & (b == 0) & c.isin(0, 2) | (a == 198) & b.isin(18, 19) | (a == 198) & (b == 51) & (c == 100) | (a == 203) & (b == 0) & (c == 113)
    return (F.size(o) == 4) & F.forall(o, lambda x: x.between(0, 255)) & ~private & ~special & (a < 224)


def semver_key(version: Column) -> Column:
    """major, minor, patch to compare versions by, each as the length and the digits of its number; missing parts are zero."""

    def part(i: int) -> Column:
        digits = F.ltrim(F.coalesce(F.regexp_extract(version, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", i), F.lit("")), F.lit("0"))
        return F.struct(F.length(digits).alias("length"), digits.alias("digits"))

    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def byte_size(text: Column) -> Column:
    """'2MB', '10 kb', '512' as bytes; null if it is no size."""
    n, unit = F.regexp_extract(text, r"^\s*(\d+)\s*([kKmMgG]?)[bB]?\s*$", 1), F.lower(F.regexp_extract(text, r"^\s*(\d+)\s*([kKmMgG]?)[bB]?\s*$", 2))
    return n.try_cast("long") * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def placeholder(value: Column, path: Column | None = None) -> Column:
    """A stand-in for a secret, by its words or because it repeats one character."""
    words = "(?i)" + "|".join(["change_?me", "deadbeef", "dummy", "example", "fake", "mock", "not.?a.?secret", "placeholder", "replace[-_]me", "sample", "test", "xxx", "your"])
    both = value if path is None else F.concat_ws("\n", path, value)
    low = F.lower(value)
    return both.rlike(words) | low.rlike(r"^([01axz])\1*$") & (F.length(value) >= 16)


def non_production(path: Column) -> Column:
    plural = "|".join(x + "s?" for x in ("demo", "doc", "example", "fixture", "mock", "sample", "spec", "test"))
    return F.lower(path).rlike(rf"(^|/)({plural}|__(fixtures|mocks|tests)__|documentation|e2e|integration_test|test-?data)(/|$)")


def high_entropy_secret(s: Column) -> Column:
    """A string of 20 to 200 characters that looks random: none of the usual harmless forms, two kinds of characters, 4.5 bits each."""
    harmless = [
        r"^[a-fA-F0-9]+$", r"\s", r"%[dfirs]|\{(\d\}|\{)|\$\{", r"^[hH][tT][tT][pP][sS]?://", r"^[./\\]|/\.\./", r"<[a-zA-Z]|</[a-zA-Z]", r"\\.*\\.*\\", r"^[#.\[]|\[\^",
        r"^eyJ(0eX[AB]|hbGci|hdWQi|pc3Mi|raWQi|zdWIi)", r"^sha(256|384|512)-", r"^sha\d+-[+/=\w]+$",
    ]
    ok = F.length(s).between(20, 200)
    for rx in harmless:
        ok = ok & ~s.rlike(rx)
    claims = F.try_to_binary(F.rpad(F.translate(s, "-_", "+/"), F.ceil(F.length(s) / 4).cast("int") * 4, "="), F.lit("base64"))
    json = F.coalesce(F.decode(claims, "UTF-8"), F.lit("")).rlike(r'^\s*\{[\s\S]*"(a(lg|ud)|exp|ia?ss?|iat|kid|sub|typ)"\s*:[\s\S]*\}\s*$')
    ok = ok & ~F.coalesce(s.rlike(r"^[-\w]+={0,2}$") & (F.length(s) % 4 != 1) & json, F.lit(False))
    kinds = sum((s.rlike(k).cast("int") for k in ("[a-z]", "[0-9]", "[^A-Za-z0-9]")), s.rlike("[A-Z]").cast("int"))
    return ok & (kinds >= 2) & (entropy(s) >= 4.5)


def gitlab_severity(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "high") & (confidence == "high"), "blocker").when(severity == "high", "critical").when(severity == "medium", "major").when(severity == "low", "minor").otherwise("info")


def gitlab_security_severity(severity: Column, confidence: Column) -> Column:
    high, medium = severity == "high", severity == "medium"
    return F.when(high & (confidence == "high"), "Critical").when(high, "High").when(medium & (confidence == "low"), "Low").when(medium, "Medium").when(severity == "low", "Low").otherwise("Info")


def bitbucket_severity(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "high") & (confidence == "high"), "CRITICAL").when(severity == "high", "HIGH").when(severity == "medium", "MEDIUM").otherwise("LOW")


def milliseconds(text: Column) -> Column:
    """'250ms', '5s', '2m', '1000' as milliseconds; null if it is no duration."""
    rx = r"^\s*(\d+)\s*(ms|s|m)?\s*$"
    unit = F.regexp_extract(text, rx, 2)
    return F.regexp_extract(text, rx, 1).try_cast("long") * F.when(unit == "s", 1000).when(unit == "m", 60_000).otherwise(1)


def ttl_seconds(expr: Column) -> Column:
    """Seconds of a whole number or of Duration(days: 1) and its like; null for anything else."""
    bare = F.regexp_replace(expr, r"\s+", "")
    unit, n = (F.regexp_extract(bare, r"Duration\((days|hours|minutes|seconds):(\d+)\)", i) for i in (1, 2))
    by_unit = n.try_cast("long") * F.when(unit == "days", 86400).when(unit == "hours", 3600).when(unit == "minutes", 60).when(unit == "seconds", 1)
    return F.coalesce(F.trim(expr).try_cast("long"), by_unit)


def public_ipv6(ip: Column) -> Column:
    """True for an IPv6 address (one :: at most, groups of four hex digits at most) outside the unspecified, loopback, link-local, unique-local,
    multicast and documentation ranges."""
    low = F.lower(ip)
    groups = F.filter(F.split(low, ":"), lambda g: g != "")
    short = low.contains("::")
    well = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(short, F.size(groups) < 8).otherwise(F.size(groups) == 8)
    well = well & ~low.rlike(":::|::.*::|^:[^:]|[^:]:$") & low.rlike("^[0-9a-f:]+$") & low.contains(":")
    special = low.rlike("^(::1?$|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:|ff[0-9a-f]{2}:|2001:0?db8(:|$))")
    return well & ~special


def html_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unquoted(c: Column) -> Column:
    """One layer of matching quotes less."""
    return F.when(c.rlike(r"^'[^\n]*'$|^\"[^\n]*\"$") & (F.length(c) >= 2), F.substr(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def plain_symbol(c: Column) -> Column:
    """a?.b['c'] as a.b.c, without white space."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\?\.", ".")
    return F.regexp_replace(c, r"\[['\"]?(\w+)['\"]?\]", ".$1")


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clamp(c: Column, n: int = 320) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "high", "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rank(severity: Column, confidence: Column) -> Column:
    base = F.when(severity == "high", 80).when(severity == "medium", 50).otherwise(25)
    return base + F.when(confidence == "high", 15).when(confidence == "medium", 5).otherwise(0)


def uuid_of(text: Column) -> Column:
    """A UUID-shaped id from SHA-1."""
    h = F.sha1(text)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


#: Why a confidence was given, by confidence and by how the finding was made.
REASONS = {
    "high": {"taint": "a flow from a source to this sink was followed", "ast": "the syntax tree shows exactly this construct", "regex": "the text allows hardly any other reading", "config": "a setting states it", "entropy": "the value looks random and has a telling name", "engine": "the graph engine proved a path", "heuristic": "several independent signs agree"},
    "medium": {"taint": "a flow was followed in part", "ast": "the construct is there, its data is not known", "regex": "a pattern with some context; other uses are possible", "config": "a setting suggests it", "entropy": "the value looks random", "engine": "a path exists under assumptions", "heuristic": "some signs agree"},
    "low": {"taint": "a flow is possible", "ast": "a construct that is often harmless", "regex": "a pattern alone", "config": "a setting is missing", "entropy": "the value is unusual", "engine": "a path may exist", "heuristic": "one weak sign"},
}


def confidence_reason(confidence: Column, method: Column) -> Column:
    table = F.create_map(*(F.lit(x) for c, row in REASONS.items() for m, why in row.items() for x in (f"{c}/{m}", why)))
    return F.coalesce(F.element_at(table, F.concat_ws("/", F.coalesce(confidence, F.lit("")), method)), F.lit("no reason is recorded"))


def backend_url(url: Column) -> Column:
    """https for hosts of the service; hosts on this machine or the local network may use http."""
    nets = "|".join([r"10(\.\d+){3}", r"127(\.\d+){3}", r"172\.(1[6-9]|2\d|3[01])(\.\d+){2}", r"192\.168(\.\d+){2}", "localhost", r"[\w-]+\.local"])
    local = rf"^https?://({nets})(:\d+)?(/|$)"
    return url.rlike(local) | url.rlike(r"^https://[a-z0-9-]+(\.[a-z0-9-]+)+(:\d+)?(/[^\s]*)?$")
