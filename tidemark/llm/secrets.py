"""Secret scans: fixed patterns plus a battery of randomness tests, in DataFrame functions only.

Each long run of code-like characters is assigned the smallest encoding that
holds it. Its characters, as numbers of that alphabet, go through a chi-squared
test of uniformity, a runs test and a serial correlation test; Fisher's method
joins the three. Within each stratum of encoding and length the
Benjamini-Hochberg procedure over the whole corpus decides which runs are
shown not to be random; the others are reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shared_dir, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Only maximal runs: what a lookbehind skips cannot begin a leftmost match.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
#: Stands for the characters of base spans where runs are looked for; in a run it shows that the two overlap.
MASK = "\x01"
RUN = r"(?<![A-Za-z0-9+/_=\x01-])[A-Za-z0-9+/_=\x01-]{20,}+"
#: Encodings from the narrowest: name, what their runs consist of, alphabet in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Lengths at which a stratum begins.
LENGTHS = (20, 28, 40, 64)
BINS, LOG_BINS = 8, 400
#: Rate of false discoveries among the runs called not random, and the least joint p of a reported one.
RATE, LEAST_P = 0.05, 0.002


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def matches(text: Column, pattern: str, body) -> Column:
    """``body`` of the pattern's matches, an array of (gap, hit): what lies before each match, and the match, and of what follows the last.

    The pattern runs over the text once to find the matches and, only where
    there are any, once more to cut out the gaps. Null without a match.
    """

    def paired(found):
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda cut: body(F.arrays_zip(F.slice(cut, F.lit(1), F.size(found)).alias("gap"), found.alias("hit")), F.element_at(cut, -1))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


#: Matches whose positions are added up in one go; goes of goes keep long lists from being copied at each step.
CHUNK = 64
SPAN = "struct<start:int,end:int,value:string>"


def placed(pieces: Column) -> Column:
    """Array of (start, end, value) in code points, from (gap, hit) pieces by adding up lengths."""

    def within(chunk):  # base, items
        def step(s, x):
            start = s["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

        return F.aggregate(chunk["items"], F.struct(chunk["base"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")), step)["out"]

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")), lambda k: F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK)))
    sized = F.transform(chunks, lambda p: F.struct(p.alias("items"), F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])).alias("size")))

    def based(p):
        ends = F.aggregate(F.transform(p, lambda x: x["size"]), F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return let(ends, lambda e: F.transform(p, lambda x, i: F.struct(F.get(e, i).alias("base"), x["items"].alias("items"))))

    return F.flatten(F.transform(let(sized, based), within))


def _long_enough(hit: Column, pattern: str, group: int, least: int) -> Column:
    return F.length(F.regexp_extract(hit, pattern, group)) >= least if least else F.lit(True)


def spans_of(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, value) of the pattern's matches whose ``group`` has ``least`` characters; null without a match."""
    return matches(text, pattern, lambda pieces, _: F.filter(placed(pieces), lambda x: _long_enough(x["value"], pattern, group, least)))


def covered(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """``text`` with as many ``MASK`` characters in place of each match that :func:`spans_of` reports."""

    def body(pieces, tail):
        hidden = lambda x: F.when(_long_enough(x["hit"], pattern, group, least), F.repeat(F.lit(MASK), F.length(x["hit"]))).otherwise(x["hit"])
        return F.concat(F.array_join(F.transform(pieces, lambda x: F.concat(x["gap"], hidden(x))), ""), tail)

    return F.coalesce(matches(text, pattern, body), text)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def neighbours(values: Column, f) -> Column:
    """``f`` of each value and the next one."""
    return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), f)


def _tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (a polynomial, error below 2e-7)."""

    def of(x):
        t = 1 / (1 + 0.3275911 * x)
        return let(t, lambda t: F.greatest(F.lit(1e-300), F.least(F.lit(1.0), reduce(lambda acc, a: (acc + a) * t, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), 1.061405429 * t) * F.exp(-x * x))))

    return let(F.abs(z) / F.lit(2.0**0.5), of)


def _uniformity(x: Column) -> Column:
    """p of the chi-squared test over BINS ranges of the alphabet, one-sided: only too uneven counts against it."""
    width, n = F.length(x["alphabet"]), x["n"]
    share = lambda b: F.ceil((b + 1) * width / BINS) - F.ceil(b * width / BINS)
    ranks = F.transform(x["codes"], lambda c: F.floor(c * BINS / width))

    def part(r, b):
        return let(F.struct(F.size(F.filter(r, lambda v: v == b)).alias("seen"), (n * share(b) / width).alias("due")), lambda e: F.pow(e["seen"] - e["due"], 2) / e["due"])

    chi = let(ranks, lambda r: total(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: part(r, b))))
    k = float(BINS - 1)
    z = (F.pow(chi / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / ((2 / (9 * k)) ** 0.5)
    return let(z, lambda z: let(_tail(z) / 2, lambda t: F.when(z > 0, t).otherwise(1 - t)))


def _runs(x: Column) -> Column:
    """p of the runs test: how often the sequence changes between the halves of the alphabet."""
    high = F.transform(x["codes"], lambda c: (2 * c >= F.length(x["alphabet"])).cast("int"))
    counts = let(high, lambda h: F.struct(total(h).alias("ones"), (total(neighbours(h, lambda p, q: (p != q).cast("int"))) + 1).alias("runs")))

    def of(c):
        return let(2 * c["ones"] * (x["n"] - c["ones"]) / x["n"] + 1, lambda mean: let(
            (mean - 1) * (mean - 2) / (x["n"] - 1), lambda var: F.when(var > 0, _tail((c["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(1e-12))))

    return let(counts, of)


def _serial(x: Column) -> Column:
    """p of the correlation of each character with the next."""
    dev = let(total(x["codes"]) / x["n"], lambda avg: F.transform(x["codes"], lambda c: c - avg))
    sums = let(dev, lambda d: F.struct(total(F.transform(d, lambda c: c * c)).alias("square"), total(neighbours(d, lambda p, q: p * q)).alias("cross")))
    return let(sums, lambda s: F.when(s["square"] > 0, _tail((s["cross"] / s["square"] * x["n"] + 1) / F.sqrt(x["n"]))).otherwise(F.lit(1e-12)))


def battery(run: Column) -> Column:
    """Struct (encoding, n, p) of a run of ASCII characters; null where no encoding fits.

    ``p`` joins the three tests by Fisher's method: small means not random.
    """

    def tests(x):  # alphabet, encoding, codes, n
        p = F.struct(_uniformity(x).alias("a"), _runs(x).alias("b"), _serial(x).alias("c"))
        half = let(p, lambda p: -(F.ln(p["a"]) + F.ln(p["b"]) + F.ln(p["c"])))
        joint = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # chi-squared with 6 degrees of freedom
        return F.struct(x["encoding"].alias("encoding"), x["n"].cast("int").alias("n"), joint.alias("p"))

    def coded(x):  # body, encoding, alphabet
        codes = F.transform(F.filter(F.split(x["body"], ""), lambda c: c != ""), lambda c: (F.position(c, x["alphabet"]) - 1).cast("double"))
        return let(F.struct(x["encoding"].alias("encoding"), x["alphabet"].alias("alphabet"), codes.alias("codes"), F.length(x["body"]).cast("double").alias("n")), tests)

    def kind(body):
        encoding = F.coalesce(*[F.when(body.rlike(rx), F.struct(body.alias("body"), F.lit(name).alias("encoding"), F.lit(letters).alias("alphabet"))) for name, rx, letters in ENCODINGS])
        return let(encoding, lambda x: F.when(x.isNotNull() & (F.length(body) >= LENGTHS[0]), coded(x)))

    return let(F.regexp_replace(run, "=+$", ""), kind)


def _stratum(e: Column, n: Column) -> Column:
    return F.concat_ws(":", e, reduce(lambda acc, x: F.when(n >= x, F.lit(str(x))).otherwise(acc), LENGTHS[1:], F.lit(str(LENGTHS[0]))))


RUNS = "array<struct<start:int,end:int,stratum:string,p:double>>"


def scanned(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with ``_base`` (spans) and ``_runs`` (start, end, stratum, p) of runs outside them.

    Where there are base spans they are masked before runs are looked for: a
    run that overlaps one shows the mask, so none is held against a list of
    spans. (Of two base spans that overlap, what the second one's mask misses
    adjoins the first one's.)
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    rules = {"assign": (ASSIGN, 2, 6), "access": (ACCESS,), "hex": (HEX,)}

    def named(kind):
        return F.coalesce(F.transform(spans_of(text, *rules[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), empty)

    def measured(c):
        return let(battery(c["value"]), lambda m: F.struct(c["start"].alias("start"), c["end"].alias("end"), _stratum(m["encoding"], m["n"]).alias("stratum"), m["p"].alias("p")))

    # Letters and digits must be mixed: a word or a plain number is no secret.
    free = lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~F.contains(c["value"], F.lit(MASK))
    runs = lambda t: F.filter(F.transform(F.filter(spans_of(t, RUN), free), measured), lambda r: r["p"].isNotNull())
    out = docs.select(*columns, text.alias("_text"), F.concat(*[named(k) for k in rules]).alias("_base"))
    own = F.translate("_text", MASK, " ")
    masked = F.when(F.size("_base") == 0, own).otherwise(let(let(covered(own, *rules["assign"]), lambda t: covered(t, *rules["access"])), lambda t: covered(t, *rules["hex"])))
    return out.select(*columns, "_base", F.coalesce(let(masked, runs), F.array().cast(RUNS)).alias("_runs"))


def thresholds(marked: DataFrame, rate: float = RATE) -> dict[str, float]:
    """For each stratum the largest p that is called not random at the given rate of false discoveries.

    p-values are counted in bins of their logarithm; the counts of all tasks
    are summed, and the procedure runs over the bins (a bounded table).
    """
    bin_ = F.least(F.lit(LOG_BINS), F.greatest(F.lit(0), F.floor(-20 * F.log10(F.greatest(F.col("r.p"), F.lit(1e-30))))))
    counts = marked.select(F.explode("_runs").alias("r")).groupBy(F.col("r.stratum").alias("s"), bin_.alias("b")).count()
    table_: dict[str, dict[int, int]] = {}
    for row in counts.collect():  # at most strata x LOG_BINS rows
        table_.setdefault(row["s"], {})[int(row["b"])] = row["count"]
    out = {}
    for s, bins in table_.items():
        m, seen, cut = sum(bins.values()), 0, 0.0
        for b in sorted(bins, reverse=True):  # from the smallest p
            seen += bins[b]
            top = 10 ** (-b / 20)  # upper edge of the bin
            if top <= rate * seen / m:
                cut = top
        out[s] = cut
    return out


def find_secrets(docs: DataFrame, rate: float = RATE, least_p: float = LEAST_P, into: str = "_secrets", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with ``into``: array of (kind, start, end), by start, then kind as listed.

    Every whole text is scanned, once; what the scan finds is written down
    before the rates are counted over all documents. A null text has no spans.
    Base spans (assign, access, hex) always stay, random ones lie outside
    them. Other columns stay as they are, whatever their names, but for
    ``into``, ``_base``, ``_text`` and ``_runs``; repeated rows stay repeated;
    an empty table gives an empty table.
    """
    own = {into, "_base", "_text", "_runs"}
    columns = [c for c in columns or docs.columns if c not in own]
    marked = materialise(scanned(docs, columns), shared_dir(docs.sparkSession), "scanned")
    cuts = thresholds(marked, rate)
    level = F.create_map(*[F.lit(x) for kv in sorted(cuts.items()) for x in kv]) if cuts else F.create_map().cast("map<string,double>")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    random_ = F.filter("_runs", lambda r: r["p"] > F.greatest(F.lit(least_p), F.coalesce(F.try_element_at(level, r["stratum"]), F.lit(0.0))))
    every = F.concat(
        F.transform("_base", lambda b: F.struct(b["start"].alias("start"), F.try_element_at(order, b["kind"]).alias("k"), b["end"].alias("end"))),
        F.transform(random_, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("k"), r["end"].alias("end"))),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(every), lambda x: F.struct(F.get(names, x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return marked.select(*columns, spans.alias(into))


def count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every row of ``documents``."""
    out = find_secrets(table(spark, sf_dir, "documents"), columns=["doc_id"])
    base = F.filter("_secrets", lambda x: x["kind"] != "random")
    return out.select(
        "doc_id",
        *[count_kind("_secrets", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_secrets")).alias("spans"),
    )
