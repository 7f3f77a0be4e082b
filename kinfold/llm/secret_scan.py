"""Secret scan by patterns and a randomness test battery, in DataFrame functions only.

Base spans, leftmost and non-overlapping per kind: `assign` (a credential name, a separator and a value of 12 or more
characters), `access` (AKIA..., 18 or more) and `hex` (16 or more lower-case hex digits).

The battery adds `random` spans. A candidate is a maximal run of 20 or more token characters with its padding; a run
that mixes - or _ with + or / fits no encoding, so its parts of 20 or more letters and digits are candidates instead.
Every candidate that holds a letter and a digit gets the tightest encoding that fits (hex, base32, base36, base62, base64, base64url), its characters become numbers,
and three tests look at them: chi-squared uniformity over the alphabet, runs above and below the middle, and lag-1
serial correlation. The p-value of a run is the chance that text-like characters, whose chi-squared statistic grows
with length, look as uniform as it does; runs that the other two tests reject as not random get 1. Within each band
of length, p-values are held to a false discovery rate by Benjamini and Hochberg's step-up rule over all candidates of
the corpus, counted in bins of a tenth of a decimal. Accepted runs that touch no base span become spans.

Defined cases: null text is empty text (no spans; the digest is that of the empty string); repeated rows are scanned
once per row; a null doc_id is kept; further columns are ignored; an empty table gives an empty result. Texts are
scanned whole; positions are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# fixed values: the patterns of the three base kinds
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the runs of 16 and more among all maximal runs
ASSIGN_MIN, ACCESS_MIN = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: A whole run that fits one alphabet, or else its parts of letters and digits; '=' only pads the end.
CANDIDATE = "(?:(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/]{20,}+|[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9+/_-])|(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+)={0,2}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encoding: what fits it, its alphabet in order, and how far text-like characters are from uniform over it
#: (alphabet size * sum of squared letter shares - 1).
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef", 0.6),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.6),
    ("base32", "^[A-Z2-7]+$", _LOWER.upper() + "234567", 1.1),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER, 1.3),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _LOWER.upper(), 1.3),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _LOWER.upper() + _LOWER, 3.0),
    ("base64url", "^[0-9A-Za-z_-]+$", _LOWER.upper() + _LOWER + _DIGITS + "-_", 3.1),
    ("base64", "^[0-9A-Za-z+/]+$", _LOWER.upper() + _LOWER + _DIGITS + "+/", 3.1),
)
#: Two-sided p-values of the runs and serial tests under which a run is not random.
NOT_RANDOM = 0.001
FALSE_DISCOVERY = 0.01
#: Lower ends of the length bands.
BANDS = (20, 32, 48)
BINS = 300


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches: start, end (exclusive), the text of `group`.

    A split at the pattern gives what stands between the matches, so running lengths give positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(hits, F.length).alias("h"), values.alias("v"), F.transform(gaps, F.length).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.coalesce(x["h"], F.lit(0))
        return F.struct(e.alias("at"), F.when(x["h"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))))).alias("out"))

    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)"))


def _below(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation that is off by less than 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(z * 1.5976 + z * z * z * 0.070566)))


def _step(alphabet: str):
    """One character of the runs and serial tests: its number less the middle of the alphabet."""

    def step(acc: Column, c: Column) -> Column:
        x = F.instr(F.lit(alphabet), c).cast("double") - (len(alphabet) + 1) / 2
        first = acc["last"] == F.lit(-1.0)  # never a number of an even alphabet
        return F.struct(
            x.alias("last"),
            (acc["runs"] + F.when(first, 0.0).otherwise(((x > 0) != (acc["last"] > 0)).cast("double"))).alias("runs"),
            (acc["products"] + F.when(first, 0.0).otherwise(x * acc["last"])).alias("products"),
        )

    return step


def battery(token: Column) -> Column:
    """struct<encoding, n, chi2, p_runs, p_serial, p> of a token; null where no encoding fits."""
    body = F.regexp_replace(token, "=+$", "")
    n = F.length(body).cast("double")
    out = F.lit(None)
    for name, fits, alphabet, text_like in reversed(ENCODINGS):
        k = float(len(alphabet))
        symbols = F.array(*(F.lit(c) for c in alphabet))
        counts = F.transform(symbols, lambda s: (F.length(body) - F.length(F.replace(body, s, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        chi2 = squares * k / n - n
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("runs"), F.lit(0.0).alias("products"))

        walk = F.aggregate(F.split(body, ""), start, _step(alphabet))
        z_runs = (walk["runs"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = walk["products"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        p_runs, p_serial = F.lit(2.0) * _below(-F.abs(z_runs)), F.lit(2.0) * _below(-F.abs(z_serial))
        p_text = _below((chi2 - (k - 1) - n * text_like) / F.sqrt(F.lit(2 * (k - 1)) + n * (4 * text_like)))
        p = F.when((p_runs < NOT_RANDOM) | (p_serial < NOT_RANDOM), F.lit(1.0)).otherwise(p_text)
        found = F.struct(F.lit(name).alias("encoding"), n.alias("n"), chi2.alias("chi2"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), p.alias("p"))
        out = F.when(body.rlike(fits), found).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Runs of token characters with a letter and a digit; the battery judges them."""
    return F.filter(_located(text, CANDIDATE), lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]"))


def scan(docs: DataFrame, false_discovery: float = FALSE_DISCOVERY) -> DataFrame:
    """doc_id, base and random spans: base / random array<struct<s, kind_no, e>> in order of start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = lambda found, no: F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(no).alias("kind_no"), x["e"].alias("e")))
    base = F.array_sort(
        F.concat(
            plain(F.filter(_located(text, ASSIGN, 2), lambda x: F.length(x["v"]) >= ASSIGN_MIN), 0),
            plain(F.filter(_located(text, ACCESS), lambda x: F.length(x["v"]) >= ACCESS_MIN), 1),
            plain(_located(text, HEX), 2),
        )
    )
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"), candidates(text).alias("runs"))
    found = cut(found)
    free = F.filter("runs", lambda r: ~F.exists(F.col("base"), lambda b: (b["s"] < r["e"]) & (r["s"] < b["e"])))
    tested = cut(found.select("doc_id", "base", F.transform(free, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), battery(r["v"]).alias("t"))).alias("runs")))
    band = F.lit(0)
    for i, low in enumerate(BANDS):
        band = F.when(F.col("n") >= low, F.lit(i)).otherwise(band)
    bin_ = lambda p: F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10)).cast("int")
    each = tested.select(F.explode("runs").alias("r")).where("r.t is not null").select(F.col("r.t.n").alias("n"), bin_(F.col("r.t.p")).alias("bin"))
    counts = each.groupBy(band.alias("band"), "bin").agg(F.count("*").alias("c")).collect()  # at most bands * bins rows
    least = {}
    for i in range(len(BANDS)):
        mine = sorted(((r["bin"], r["c"]) for r in counts if r["band"] == i), reverse=True)
        total, at_least = sum(c for _, c in mine), 0
        for b, c in mine:  # step-up: the largest p whose bound holds
            at_least += c
            if 10 ** (-b / 10) * total <= false_discovery * at_least:
                least[i] = b
    needed = lambda n: F.coalesce(*[F.when((n >= BANDS[i]) if i else F.lit(True), F.lit(least.get(i, BINS + 1))) for i in reversed(range(len(BANDS)))])
    accepted = F.filter("runs", lambda r: r["t"].isNotNull() & (bin_(r["t"]["p"]) >= needed(r["t"]["n"])))
    return tested.select("doc_id", "base", F.transform(accepted, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("kind_no"), r["e"].alias("e"))).alias("random"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind_no"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    n = lambda no: F.size(F.filter("base", lambda x: x["kind_no"] == no)).cast("long")
    return scanned.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
