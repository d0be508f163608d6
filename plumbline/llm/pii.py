"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Four base kinds are found by expression and check. Their values, together with
values after a few seed cues (``password=``) and key formats, are the seed
entities of a pattern-instance graph: a pattern is the cue before a value (or
its upper-case prefix) with the value's shape, an instance is a value. A
pattern's confidence is the mean belief in its instances, an instance's belief
the best confidence of its patterns; after a few rounds, values in contexts of
confident and well-supported patterns are spans too, beside the seed entities
that a cue or format marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored
from .common import table, unused

#: The base kinds, in the order that breaks ties, and their expressions. Java's possessive quantifiers
#: replace greedy ones where nothing can follow, so that long runs need neither recursion nor a second look.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Values that contexts are learned for: after a name and = or :, after a plain word, and with an upper-case prefix.
#: Each match ends where its value ends, and the second expression's group is the value; values have no greatest length.
#: A value after = or : may have parts between single marks, as web tokens and passwords do, and padding at its end.
CANDIDATES = {
    "keyed": (
        r"(?<![\p{L}\p{N}_])\p{L}[\p{L}_-]{2,30}+ ?[=:] ?[\"']?(?=[A-Za-z0-9+/_.~!@$%^*=:-]{6})[A-Za-z0-9+/_-]++(?:[.~!@$%^*=:][A-Za-z0-9+/_-]++)*+={0,2}+",
        r"^\p{L}[\p{L}_-]{2,30}+ ?[=:] ?[\"']?(.*)$",
    ),
    "word": (r"(?<![\p{L}\p{N}_+-])\p{L}{2,20}+ [\"']?(?=[A-Za-z-]*+[0-9])[A-Za-z0-9-]{6,}+(?![A-Za-z0-9@._-])", r"([A-Za-z0-9-]++)$"),
    "prefix": (r"(?<![A-Za-z0-9_])[A-Z]{2,6}[_-]?(?=[A-Z]*+[0-9])[A-Z0-9]{10,}+(?![A-Za-z0-9_])", r"([A-Z0-9_-]++)$"),
}
#: Cues whose values are seeds, and a published key format.
SEED_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "ssn", "iban", "passport")
SEED_FORMAT = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$"
#: Rounds of the graph, least confidence of a pattern, and the distinct instances that it needs.
ROUNDS, LEAST_CONFIDENCE, LEAST_SUPPORT = 3, 0.75, 3
_CHUNK = 256


def prefix_sums(numbers: Column) -> Column:
    """Exclusive running sums of an int array, in chunks, so that long arrays aren't copied for every element."""
    zero = F.struct(F.lit(0).alias("t"), F.expr("cast(array() as array<int>)").alias("a"))

    def running(values: Column, of) -> Column:
        return F.aggregate(values, zero, lambda s, x: F.struct((s["t"] + of(x)).alias("t"), F.concat(s["a"], F.array(s["t"])).alias("a")))

    n = F.size(numbers)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: F.slice(numbers, c * _CHUNK + 1, F.lit(_CHUNK)))
    inner = F.transform(chunks, lambda ch: running(ch, lambda x: x))
    offsets = running(inner, lambda x: x["t"])["a"]
    return F.when(n > 0, F.flatten(F.zip_with(inner, offsets, lambda x, o: F.transform(x["a"], lambda y: y + o)))).otherwise(F.expr("cast(array() as array<int>)"))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, value) of all leftmost non-overlapping matches, in code points: pieces between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(found, F.split(text, pattern, -1), lambda m, p: F.struct(F.length(m).alias("m"), F.length(p).alias("p"), m.alias("v")))
    lengths = F.filter(lengths, lambda x: x["v"].isNotNull())
    before = prefix_sums(F.transform(lengths, lambda x: x["m"] + x["p"]))
    spans = F.zip_with(before, lengths, lambda b, x: F.struct((b + x["p"]).alias("start"), (b + x["p"] + x["m"]).alias("end"), x["v"].alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_OCTETS)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda m: _valid(kind, m["value"])


def _as_span(kind: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value"))


def _shape(value: Column) -> Column:
    """Letters and digits by class with their count; hexadecimal strings of 16 and more as one class."""
    classed = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    hexadecimal = value.rlike("^[0-9a-f]{16,}$") & value.rlike("[a-f]") & value.rlike("[0-9]")
    return F.when(hexadecimal, F.lit("hex")).when(value.rlike("^[0-9]+$"), F.concat(F.lit("9x"), F.length(value).cast("string"))).otherwise(F.when(F.length(classed) <= 12, classed).otherwise(F.lit("mixed")))


def _instance(value: Column) -> Column:
    return F.xxhash64(value, F.length(value))


def _findings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, print, base, found) per row: base spans (start, kind, end, instance) and candidates with their patterns."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("__text"))
    out = out.select("doc_id", F.xxhash64(t, F.length(t)).alias("print"), t.alias("__text"))
    text_ = F.col("__text")
    columns = {f"__{k}": F.filter(matches(text_, p), _checked(k)) for k, p in KINDS.items()}
    columns |= {f"__{k}": matches(text_, p) for k, (p, _) in CANDIDATES.items()}
    out = out.select("doc_id", "print", *[c.alias(n) for n, c in columns.items()])
    base = F.concat(*[F.transform(f"__{k}", _as_span(i)) for i, k in enumerate(KINDS)])
    out = out.withColumn("__base", F.array_sort(base))

    def candidates(kind: str, tail: str) -> Column:
        def one(m: Column) -> Column:
            value = F.regexp_extract(m["value"], tail, 1)
            cue = F.lower(F.regexp_extract(m["value"], r"^[\p{L}_-]+", 0)) if kind != "prefix" else F.concat(F.substring(value, 1, 4), F.length(value).cast("string"))
            pattern = F.concat_ws("|", F.lit(kind), cue, _shape(value) if kind != "prefix" else F.lit(""))
            seed = (F.lit(kind == "keyed") & cue.isin(*SEED_CUES) & value.rlike("[0-9]")) | value.rlike(SEED_FORMAT)
            return F.struct((m["end"] - F.length(value)).alias("start"), m["end"].alias("end"), pattern.alias("pattern"), _instance(value).alias("instance"), seed.alias("seed"))

        return F.filter(F.transform(f"__{kind}", one), lambda c: c["end"] > c["start"])

    return out.select("doc_id", "print", F.transform("__base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), _instance(b["value"]).alias("instance"))).alias("base"), F.concat(*[candidates(k, tail) for k, (_, tail) in CANDIDATES.items()]).alias("found"))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, least: float = LEAST_CONFIDENCE, support: int = LEAST_SUPPORT) -> DataFrame:
    """Patterns whose instances are believed in, from edges (pattern, instance, seed).

    Belief starts at 1 for seeds and 0 for all others and passes through the
    graph ``rounds`` times: confidence of a pattern is the sum of the beliefs
    over its instances plus one, belief the greatest confidence.
    """
    edges = stored(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "contexts")
    belief = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for i in range(rounds):
        scored = edges.join(belief, "instance").groupBy("pattern").agg(F.sum("belief").alias("good"), F.count("*").alias("n"))
        patterns = stored(scored.select("pattern", "n", (F.col("good") / (F.col("n") + 1)).alias("confidence")), "patterns")
        if i + 1 < rounds:
            passed = edges.join(patterns, "pattern").groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("confidence"))).alias("belief"))
            belief = stored(passed, "beliefs")
    return patterns.where((F.col("confidence") >= least) & (F.col("n") >= support)).select("pattern", "confidence")


def _chosen(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """(doc_id, print, extra): of the spans taken (doc_id, print, start, end) those that overlap no base span and lie in no longer one.

    Spans are compared in order of place with what came before and what
    follows, so a text of many spans costs their sorting.
    """
    none = F.lit(None).cast("int")
    texts = taken.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct()
    base = rows.join(texts, rows["doc_id"].eqNullSafe(texts["__id"]) & (rows["print"] == texts["__print"]), "left_semi")
    base = base.select("doc_id", "print", F.explode("base").alias("b")).select("doc_id", "print", "b.start", "b.end", F.lit(True).alias("is_base"))
    spans = taken.select("doc_id", "print", "start", "end", F.lit(False).alias("is_base")).unionAll(base).distinct()
    order = Window.partitionBy("doc_id", "print").orderBy("start", F.desc("end"), "is_base")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    end, start, is_base = F.col("end"), F.col("start"), F.col("is_base")
    spans = spans.withColumns(
        {
            "base_end": F.max(F.when(is_base, end).otherwise(none)).over(before),
            "base_start": F.min(F.when(is_base, start).otherwise(none)).over(after),
            "own_end": F.max(F.when(~is_base, end).otherwise(none)).over(before),
        }
    )
    free = (F.coalesce("base_end", F.lit(0)) <= start) & (F.coalesce("base_start", end) >= end) & (F.coalesce("own_end", F.lit(0)) < end)
    good = spans.where(~is_base & free)
    return good.groupBy("doc_id", "print").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("extra"))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, base, spans): base spans, and all spans with those of confident contexts, sorted.

    A span is (start, kind, end) in code points, end exclusive; kinds 0 to 3
    are those of ``KINDS``, 4 is a discovered identifier. One row per input
    row; rows that agree in id and text share their spans. Null and empty
    texts have none. Discovered spans overlap no base span, and of equal
    starts the longest stays. Other columns are not read.
    """
    rows = stored(_findings(docs, doc_id, text), "findings")
    each = rows.select("doc_id", "print", F.explode("found").alias("c")).select("doc_id", "print", "c.*")
    known = rows.select(F.explode("base.instance").alias("instance")).distinct().withColumn("known", F.lit(True))
    edges = each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")).join(known, "instance", "left")
    good = confident_patterns(edges.select("pattern", "instance", (F.col("seed") | F.coalesce("known", F.lit(False))).alias("seed")))
    believed = each.join(good, "pattern", "left").where(F.col("seed") | F.col("confidence").isNotNull())
    taken = stored(believed.select("doc_id", "print", "start", "end").distinct(), "taken")
    extra = _chosen(rows, taken)
    extra = extra.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), "extra")
    same = rows["doc_id"].eqNullSafe(extra["__id"]) & (rows["print"] == extra["__print"])
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    joined = rows.join(extra, same, "left").select("doc_id", "print", base.alias("base"), F.coalesce("extra", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).alias("extra"))
    return joined.select("doc_id", "print", "base", F.array_sort(F.concat("base", "extra")).alias("spans"))


def _named(spans: str) -> Column:
    """kind:start:end, comma-joined by start, then kind."""
    names = F.array(*map(F.lit, [*KINDS, "identifier"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one.

    All rows and columns stay, whatever these are named. Null texts stay null,
    empty ones empty; rows that agree in id and text are cut alike.
    """
    id_, own, spans = unused(docs, "id_of_spans"), unused(docs, "print"), unused(docs, "spans_of_text")
    found = find_pii(docs, doc_id, text).where(F.size("spans") > 0).dropDuplicates(["doc_id", "print"])
    found = found.select(F.col("doc_id").alias(id_), F.col("print").alias(f"{own}_of_spans"), F.col("spans").alias(spans))
    t = F.col(f"`{text}`").cast("string")
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(t, F.lit("")), F.length(F.coalesce(t, F.lit("")))))
    joined = keyed.join(found, keyed[f"`{doc_id}`"].eqNullSafe(found[id_]) & (keyed[own] == found[f"{own}_of_spans"]), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "identifier"]])
    start = F.expr("struct(0 as at, cast(array() as array<string>) as parts)")

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"]))
        later = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["start"] >= acc["at"], later).otherwise(inside)

    cut = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), cut).otherwise(t)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and discovered spans of personal data in every document."""
    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_named("base"), 256).alias("base_sha256"), _named("spans").alias("spans"))
