"""Secret scans by a battery of randomness tests (operator 10).

Native: DataFrame functions alone. Base spans come from three patterns (an assigned
value, an access key, a hexadecimal run). The battery adds spans of kind ``random``:

1. Candidates are runs of at least 20 characters of ``A-Za-z0-9+/_=-``. Their
   encoding is inferred: hexadecimal (alphabet of 16), base 32 (32) or base 64 (64).
   Runs without a digit and without a capital after a small letter are words.
2. For each candidate of n characters over an alphabet of k: Pearson's chi-squared
   for uniform use of the alphabet, the number of runs of character classes against
   that of independent uniform characters, and the lag-one serial correlation of
   character codes. A candidate that one of them rejects as not random is dropped.
3. The rest is tested against prose: chi-squared against the noncentral law that
   prose's index of coincidence gives at this length, class changes against prose's
   rate at this length. Both look at the same characters, so twice the lesser of the
   two one-sided bounds is taken, which holds for any dependence. Long candidates so
   need, and can have, far stronger evidence.
4. Weighted Benjamini-Hochberg control over all candidates of all documents picks those
   reported, at rate ``fdr``; a weight is the length over the mean length of all
   candidates, so weights have mean 1. The step is found on a histogram of -log10 p with
   fixed bins, each taken at its larger p, so what reaches the driver is bounded and the
   control is on the safe side.

Positions are code points, ends exclusive. Null texts count as empty and have no
spans. Repeated rows get equal results; extra columns of any name are carried or
ignored; an empty table gives no rows. Texts are scanned whole, very long ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough matches whole or not at all, so the least length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Coincidence of two letters, and chance of a change of character class, in prose.
PROSE_COINCIDENCE, PROSE_CHANGE = 0.06, 0.08
REJECT_Z, FDR = 3.5, 0.01
BINS_PER_DECADE, LAST_BIN = 4, 1600
CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_="
CHUNK = 256


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once: lambdas do not share common expressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(sizes: Column) -> Column:
    """For each entry the sum of those before it, by a fold over chunks and one inside each, since a fold copies what it has."""

    def running(values: Column, start: Column) -> Column:
        zero = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(sizes) / CHUNK).cast("int") - 1), lambda i: F.slice(sizes, i * CHUNK + 1, CHUNK))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return F.flatten(F.zip_with(parts, running(sums, F.lit(0)), running))

    return F.when(F.size(sizes) <= CHUNK, running(sizes, F.lit(0))).otherwise(_let(chunks, joined))


def _matches(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Array of (start, kind, stop, value) of the pattern's matches whose value passes ``keep``.

    Texts between matches and the matches alternate, so their lengths give positions.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    sizes = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.transform(whole, F.length), lambda gap, size: F.struct(gap.alias("gap"), F.coalesce(size, F.lit(0)).alias("size")))

    def spans(sizes: Column) -> Column:
        return F.zip_with(sizes, _before(F.transform(sizes, lambda x: x["gap"] + x["size"])), lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop")))

    found = F.transform(F.arrays_zip(_let(sizes, spans).alias("span"), value.alias("value")), lambda x: F.struct(x["span"]["start"].alias("start"), F.lit(kind).alias("kind"), x["span"]["stop"].alias("stop"), x["value"].alias("value")))
    kept = F.filter(found, lambda x: x["value"].isNotNull() & (keep(x["value"]) if keep is not None else F.lit(True)))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,value:string>>"))


def _log_tail(z: Column) -> Column:
    """ln of an upper bound of the normal law's mass below z."""
    return F.when(z < 0, -z * z / 2 - F.lit(0.6931471805599453)).otherwise(F.log(1 - 0.5 * F.exp(-z * z / 2)))


def _log10_p(token: Column) -> Column:
    """log10 of the evidence that the token is prose; null if a randomness test rejects it or it is a word."""
    is_hex = token.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    base32 = token.rlike("^[A-Z2-7]+=*$")
    k = F.when(is_hex, F.lit(16.0)).when(base32, F.lit(32.0)).otherwise(F.lit(64.0))
    body = F.regexp_replace(token, "=+$", "")
    n = F.length(body).cast("double")
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    squares = F.aggregate(F.transform(F.array_distinct(chars), lambda c: F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    chi = k / n * squares - n
    uniform_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    runs = body
    for one, sign in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        runs = F.regexp_replace(runs, one, sign)
    changes = F.length(runs) - 1.0
    # Chance that two neighbours are of different classes, and its law for independent uniform characters
    rate = F.when(k == 16, F.lit(2 * (10 / 16) * (6 / 16))).when(k == 32, F.lit(2 * (26 / 32) * (6 / 32))).otherwise(F.lit(1 - 2 * (26 / 64) ** 2 - (10 / 64) ** 2 - 2 / 64**2))
    runs_z = (changes - (n - 1) * rate) / F.sqrt((n - 1) * rate * (1 - rate) * 1.5)
    codes = F.transform(chars, lambda c: F.instr(F.lit(CODES), c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(codes, lambda x: x - mean)
    spread = F.aggregate(centred, F.lit(0.0), lambda a, x: a + x * x)
    lagged = F.aggregate(F.zip_with(F.slice(centred, 1, F.size(centred) - 1), F.slice(centred, 2, F.size(centred) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    serial_z = F.sqrt(n) * lagged / F.when(spread > 0, spread)
    surplus = k * PROSE_COINCIDENCE - 1
    surplus = F.when(surplus > 0.5, surplus).otherwise(F.lit(0.5))
    prose_z = (chi - (k - 1) - n * surplus) / F.sqrt(2 * (k - 1) + 4 * n * surplus)
    share = F.least(changes / (n - 1), F.lit(0.999))
    apart = share * F.log(share / PROSE_CHANGE) + (1 - share) * F.log((1 - share) / (1 - PROSE_CHANGE))
    change_log = F.when(share > PROSE_CHANGE, -(n - 1) * apart).otherwise(F.lit(0.0))
    log_p = F.least(F.least(_log_tail(prose_z), change_log) + F.log(F.lit(2.0)), F.lit(0.0))
    random = (n >= 20) & (uniform_z <= REJECT_Z) & (F.abs(runs_z) <= REJECT_Z) & (F.abs(serial_z) <= REJECT_Z)
    return F.when(random, log_p / F.log(F.lit(10.0)))


def _scan(docs: DataFrame) -> DataFrame:
    """row (all of ``docs``), base and candidate spans; a candidate's p is the log10 of its p-value; tests, chars: how many were tested and their length."""
    text = F.col("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("text", F.coalesce("row.text", F.lit("")))
    kinds = (
        (ASSIGN, lambda v: F.length(v) >= 8, 2),
        (ACCESS, None, 0),
        (HEX, None, 0),
    )
    base = F.concat(*[_matches(text, p, i, keep, group) for i, (p, keep, group) in enumerate(kinds)])
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.lit(None).cast("double").alias("p")))
    rows = rows.withColumn("base", F.array_sort(plain))
    odd = _matches(text, CANDIDATE, 3, lambda v: v.rlike("[0-9]|[a-z][A-Z]"))
    rows = rows.withColumn("odd", F.filter(odd, lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))
    tested = F.transform("odd", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), _log10_p(s["value"]).alias("p")))
    rows = rows.select("row", "base", F.size("odd").alias("tests"), F.aggregate("odd", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("chars"), tested.alias("odd"))
    return rows.withColumn("odd", F.filter("odd", lambda s: s["p"].isNotNull()))


def _weighted(span: Column, mean: float) -> Column:
    """log10 of a candidate's p-value over its weight."""
    return span["p"] - F.log10((span["stop"] - span["start"]) / F.lit(mean))


def _threshold(scanned: DataFrame, fdr: float) -> tuple[float, float]:
    """The mean length of all candidates and the largest weighted log10 p-value that the step-up procedure accepts; minus infinity if none."""
    totals = scanned.agg(F.sum("tests").alias("n"), F.sum("chars").alias("chars")).first()
    if not totals["n"]:
        return 1.0, float("-inf")
    mean = totals["chars"] / totals["n"]
    bins = scanned.select(F.explode("odd").alias("s")).select(F.least(F.floor(-F.least(_weighted(F.col("s"), mean), F.lit(0.0)) * BINS_PER_DECADE), F.lit(LAST_BIN)).alias("bin"))
    found, accepted = 0, float("-inf")
    for row in sorted(bins.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        found += row["count"]
        upper = -row["bin"] / BINS_PER_DECADE
        if 10.0**upper * totals["n"] <= fdr * found:
            accepted = upper
    return mean, accepted


def scanned_documents(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """row, a struct of the columns of ``docs``, and ``base`` and ``every``: arrays of spans."""
    held = written(_scan(docs), "secret-spans")
    mean, limit = _threshold(held, fdr)
    extra = F.filter("odd", lambda s: _weighted(s, mean) <= F.lit(limit))
    return held.select("row", "base", F.array_sort(F.concat("base", extra)).alias("every"))


def _written_out(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scanned_documents(docs.select("doc_id", "text"), fdr)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("row.doc_id", count(0), count(1), count(2), F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"), _written_out(F.col("every")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans share one."""
    found = scanned_documents(docs, fdr)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(F.col("row.text"), state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        new = F.concat(state["out"], gap, F.lit(mark))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], new).otherwise(state["out"]).alias("out"))

    text = F.aggregate("every", zero, step, lambda s: F.concat(s["out"], F.substring(F.col("row.text"), s["at"] + 1, F.length("row.text"))))
    return found.select(*[F.when(F.size("every") > 0, text).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
