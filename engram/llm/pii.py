"""Operator 2: personal data by fixed patterns and by bootstrapped contextual extraction, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import documents, scratch, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java's engine takes linear time on any text: a run is entered at its start
#: only (or where the last match ended), and repeats whose end is certain don't backtrack.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){15,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a look.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Identifier-like strings beyond the fixed patterns: numbers with separators, and local parts with a bare host.
CANDIDATE = f"(?<![0-9])[0-9(][0-9().\\x20-]{{4,24}}[0-9](?![0-9])|(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++"
#: Shape that a discovered identifier of a kind must have, over its text without separators.
_SHAPE = {"email": "^.+@.+$", "ip": "^[0-9]+(?:\\.[0-9]+){2,5}$", "card": "^[0-9]{12,19}$", "phone": "^[0-9]{6,15}$"}
LEAST_SUPPORT, LEAST_CONFIDENCE = 3, 0.8
#: Characters on either side of a string that its contexts are taken from.
_NEAR = 96


def found(text: Column, pattern: str, needs: str | None) -> Column:
    """Matches of a pattern as array<struct<start, stop, match, before, after>>; start and stop in code points.

    The pieces between matches and the matches themselves, laid end to end, are the text; so their lengths give the
    places. before: the end of the piece that comes before the match; after: the beginning of the one behind it.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, stop: int, match: string, before: string, after: string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"])
        stop = start + F.length(x["matches"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["matches"].alias("match"), F.right(x["gaps"], F.lit(_NEAR)).alias("before"), F.left(x["next"], F.lit(_NEAR)).alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gaps"), matches.alias("matches"), F.slice(gaps, 2, F.size(matches)).alias("next"))
    folded = F.aggregate(pairs, empty, step, lambda acc: acc["out"])
    some = text.rlike(pattern) if needs is None else text.contains(needs)
    return F.when(some, folded).otherwise(empty["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.split(F.reverse(digits), "")

    def add(total: Column, x: Column) -> Column:
        d = x["d"].cast("int") * x["f"]
        return total + F.when(d > 9, d - 9).otherwise(d)

    factors = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(F.arrays_zip(back.alias("d"), factors.alias("f")), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a kind's pattern stands."""
    if kind == "ip":  # parts of any number of digits: no cast that may overflow
        return F.forall(F.split(m, "\\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(16, 19) & F.when(F.length(d) <= 19, _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _stands(kind: str):
    return lambda x: valid(kind, x["match"])


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: hashes of the last two words and the last one on the left, the first one and two on the right.

    Words are runs of letters, without case; a pattern with fewer words than it asks for is left out.
    """
    left, right = (F.filter(F.split(F.lower(x), "[^\\p{L}]+"), lambda w: w != "") for x in (before, after))
    forms = [F.when(F.size(w) >= n, F.xxhash64(F.lit(i), F.array_join(F.slice(w, at, n), " "))) for i, (w, at, n) in enumerate(((left, -2, 2), (left, -1, 1), (right, 1, 1), (right, 1, 2)))]
    return F.array_compact(F.array(*forms))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), base (spans by kind), seen (kind or null, start, stop, contexts, instance) of each row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    h = F.xxhash64("t")
    for k in KINDS:
        rows = rows.withColumn(k, F.filter(found(F.col("t"), PATTERNS[k], _NEEDS[k]), _stands(k)))
    rows = rows.withColumn("other", found(F.col("t"), CANDIDATE, None))
    taken = F.concat(*[F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))) for k in KINDS])
    rows = rows.withColumn("taken", taken)
    free = F.filter("other", lambda x: ~F.exists("taken", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))

    def view(kind: int | None):
        def of(x: Column) -> Column:
            plain = F.lower(F.regexp_replace(x["match"], "[\\x20()-]", ""))
            return F.struct(F.lit(kind).cast("int").alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), _contexts(x["before"], x["after"]).alias("contexts"), F.xxhash64(plain).alias("instance"), _shapes(plain).alias("shapes"))

        return of

    def span(kind: int):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))

    seen = F.concat(*[F.transform(k, view(i)) for i, k in enumerate(KINDS)], F.transform(free, view(None)))
    base = F.concat(*[F.transform(k, span(i)) for i, k in enumerate(KINDS)])
    return rows.select("doc_id", h.alias("h"), base.alias("base"), seen.alias("seen"))


def _shapes(plain: Column) -> Column:
    """Bit i: the string may be of kind i."""
    return sum((F.when(plain.rlike(_SHAPE[k]), F.lit(1 << i)).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))


def bootstrap(edges: DataFrame, support: int, confidence: float) -> DataFrame:
    """instance, kind of identifiers that no fixed pattern names.

    edges: context, instance, kind (of a seed; else null), shapes; one row for each context and instance. In each round
    a context's confidence in a kind is the share of its instances that are known to be of it, and it is trusted with
    at least so much support and confidence; an unknown instance's is 1 - product of (1 - confidence) over its trusted
    contexts, and it becomes known from the bound on. Rounds end when one finds nothing new, as one must: each makes
    some instances known.
    """
    known = edges.select("instance", "kind").limit(0)
    while True:
        now = edges.join(known.withColumnRenamed("kind", "new"), "instance", "left").withColumn("kind", F.coalesce("kind", "new")).drop("new")
        counts = [F.sum(F.when(F.col("kind") == i, 1).otherwise(0)).alias(f"k{i}") for i in range(len(KINDS))]
        per = now.groupBy("context").agg(F.count(F.lit(1)).alias("n"), *counts)
        best = F.greatest(*[F.struct(F.col(f"k{i}").alias("c"), F.lit(i).alias("kind")) for i in range(len(KINDS))])
        trusted = per.withColumn("best", best).select("context", F.col("best.kind").alias("k"), F.col("best.c").alias("c"), (F.col("best.c") / F.col("n")).alias("p")).where((F.col("c") >= support) & (F.col("p") >= confidence) & (F.col("p") < 1))
        votes = now.where("kind is null").join(trusted, "context").where("(shapes & shiftleft(1, k)) > 0")
        scored = votes.groupBy("instance", "k").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("s")).groupBy("instance").agg(F.max(F.struct("s", F.col("k").alias("kind"))).alias("b"))
        fresh = table(scored.where(F.col("b.s") >= confidence).select("instance", F.col("b.kind").alias("kind")), "pii_known")
        if fresh.isEmpty():
            return known
        known = fresh if not hasattr(known, "written_at") else table(known.union(fresh), "pii_known")


def find(docs: DataFrame, support: int = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """doc_id, base, spans: array<struct<kind: int, start: int, stop: int>> for each row of docs (doc_id, text).

    base: matches of the fixed patterns, leftmost and not overlapping within a kind, without those that fail the kind's
    check. They are seeds: the words on either side of each are its contexts, and contexts that mostly stand beside one
    kind name further strings of that kind's shape, which name further contexts. spans: base and what is discovered;
    discovered spans never overlap base ones. kind is a place in KINDS; places are in code points, stop exclusive.
    Contexts see so many characters (_NEAR) on a side, up to the next match of the same pattern. Null and empty texts
    have no spans; equal rows have equal results; without seeds nothing is discovered.
    """
    with scratch(docs.sparkSession) as keep:
        seen = keep(table(scan(docs), "pii_scan"))
        occ = seen.select("doc_id", "h", F.explode("seen").alias("x")).select("doc_id", "h", "x.*")
        edges = occ.select(F.explode("contexts").alias("context"), "instance", "kind", "shapes")
        edges = table(edges.groupBy("context", "instance").agg(F.min("kind").alias("kind"), F.max("shapes").alias("shapes")), "pii_edges")
        known = bootstrap(edges, support, confidence)
        hits = occ.where("kind is null").drop("kind").join(known, "instance").groupBy("doc_id", "h").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("more"))
        hits = keep(table(hits, "pii_found"))
    rows = seen.select("doc_id", "h", "base").alias("a").join(hits.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")), "left")
    none = F.expr("cast(array() as array<struct<kind: int, start: int, stop: int>>)")
    return rows.select("a.doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def _equals(i: int):
    return lambda x: x == i


def as_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = find(documents(spark, sf_dir))
    counts = [F.size(F.filter("base.kind", _equals(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
