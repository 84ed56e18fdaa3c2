"""Personal data: checked base patterns as seeds, and bootstrapped contextual extraction of identifiers that they miss.

Every match of a base pattern is a seed. What stands before a seed, the last word and the signs after it, and what stands
behind it, the signs and the next word, are lexical patterns. Other identifier-like tokens are instances without a kind.
Patterns and instance values form a graph; in each round a pattern's confidence in a kind is the share of its occurrences
that are instances of that kind, and an instance's is that of its best pattern. After the rounds, patterns of high
confidence and enough distinct seeds give their kind to the tokens beside them, provided that the token can be of that kind
at all. Everything here is built from SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialize

# The kinds in their order, and their patterns. Possessive forms and the anchors before them change no
# match; they keep long runs of one class of characters from being scanned anew from each of their places.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# A token that may be an identifier: something with an at sign, or digits and signs, with single blanks between them. It
# takes all that it can, and is one only if what stands right before and behind it is no part of a longer word.
TOKEN = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++|[+(]?[0-9](?:\x20?[()./-]*+[0-9])++"
APART = r"[A-Za-z0-9@._%+/-]"
LEAST_CHARS = 6  # of a token of digits
# The last word before, and the first word behind, each with the signs between; of longer words the near end.
BEFORE = r"(\p{L}+[^\p{L}\p{N}\s]{0,3}\s?)$"
BEHIND = r"^(\s?[^\p{L}\p{N}\s]{0,3}\s?\p{L}+)"
CONTEXT_CHARS = 32
CHUNK = 256  # matches of a text that are put together at a time, so that the work grows in proportion to them


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    confidence: float = 0.9  # a pattern's least confidence to give its kind
    seeds: int = 5  # distinct seed values that a pattern needs
    smoothing: float = 0.25  # occurrences without a kind that each pattern is taken to have besides


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check sum: every second digit from the right doubled, less nine if over nine."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda a, i: a + F.when((F.length(d) - i) % 2 == 0, F.substr(d, i, F.lit(1)).cast("int")).otherwise((F.substr(d, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substr(d, i, F.lit(1)).cast("int") >= 5, 1).otherwise(0)),
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda s: valid(kind, s["value"])


SPANS = "array<struct<start: bigint, end: bigint, value: string, left: string, right: string>>"


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunks(array: Column) -> Column:
    """An array cut into arrays of CHUNK elements; none of an empty one."""
    last = lambda a: F.greatest(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int"))
    cut = lambda a: F.transform(F.sequence(F.lit(0), last(a)), lambda k: F.slice(a, k * CHUNK + 1, F.lit(CHUNK)))
    return let(array, lambda a: F.filter(cut(a), lambda c: F.size(c) > 0))


def located(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of start and end in code points, value, and the text before and behind, up to CONTEXT_CHARS and the next match."""
    nothing = F.array().cast(SPANS)

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("left"), F.left(x["next"], F.lit(CONTEXT_CHARS)).alias("right"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(one)).alias("spans"))

    def chunked(x: Column) -> Column:
        n = F.size(x["found"])
        behind = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(2), n), lambda v, g: F.struct(v.alias("value"), g.alias("next")))
        pairs = F.zip_with(F.slice(x["gaps"], F.lit(1), n), behind, lambda g, v: F.struct(g.alias("gap"), v["value"].alias("value"), v["next"].alias("next")))
        return chunks(pairs)

    def put_together(parts: Column) -> Column:
        sizes = F.transform(parts, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["gap"]) + F.length(x["value"])))

        def of(begins: Column):
            return lambda c, k: F.aggregate(c, F.struct(F.aggregate(F.slice(begins, F.lit(1), k), F.lit(0).cast("bigint"), lambda n, y: n + y).alias("at"), nothing.alias("spans")), step, lambda s: s["spans"])

        return let(sizes, lambda z: F.flatten(F.transform(parts, of(z))))

    def matched(found: Column) -> Column:
        both = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"))
        return F.when(F.size(found) == 0, nothing).otherwise(let(let(both, chunked), put_together))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), matched)


def scan(docs: DataFrame) -> DataFrame:
    """docs with _base (array of kind, start, end, value, contexts) and _other (tokens without a kind that overlap no base span)."""
    text = F.coalesce("text", F.lit(""))
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": F.lit(True), "phone": F.contains(text, F.lit("+"))}

    def full(kind: str | None):
        def of(s: Column) -> Column:
            before, behind = F.regexp_extract(s["left"], BEFORE, 1), F.regexp_extract(s["right"], BEHIND, 1)
            contexts = F.filter(F.array(F.concat(F.lit("<"), F.lower(before)), F.concat(F.lit(">"), F.lower(behind))), lambda c: F.length(c) > 1)
            return F.struct(F.lit(kind).cast("string").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), contexts.alias("contexts"))

        return of

    docs = docs.withColumns({f"_{k}": F.when(needs[k], located(text, PATTERNS[k])).otherwise(F.array().cast(SPANS)) for k in KINDS} | {"_token": located(text, TOKEN)})
    base = F.concat(*(F.transform(F.filter(f"_{k}", passing(k)), full(k)) for k in KINDS))
    docs = docs.withColumn("_base", base)
    apart = lambda s: ~F.right(s["left"], F.lit(1)).rlike(APART) & ~F.left(s["right"], F.lit(1)).rlike(r"[A-Za-z0-9@/-]") & ((F.length(s["value"]) >= LEAST_CHARS) | F.contains(s["value"], F.lit("@")))
    meets = lambda a, b: (b["start"] < a["end"]) & (a["start"] < b["end"])

    def free(c: Column) -> Column:
        """The tokens of a chunk that overlap no base span; only spans near the chunk are looked at."""
        whole = F.struct(c[0]["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"))
        return let(F.filter("_base", lambda b: meets(whole, b)), lambda near: F.filter(c, lambda s: ~F.exists(near, lambda b: meets(s, b))))

    tokens = F.transform(chunks(F.filter("_token", apart)), free)
    return docs.withColumn("_other", F.transform(F.flatten(tokens), full(None))).drop("_token", *(f"_{k}" for k in KINDS))


def fits(kind: Column, value: Column) -> Column:
    """Whether a token may be of the kind at all."""
    n = F.length(digits(value))
    return (
        F.when(kind == "email", F.contains(value, F.lit("@")))
        .when(kind == "ip", value.rlike(r"^[0-9]+(\.[0-9]+){2,5}$"))
        .when(kind == "card", ~F.contains(value, F.lit("@")) & n.between(12, 19))
        .otherwise(~F.contains(value, F.lit("@")) & n.between(6, 15))
    )


def discover(found: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """Patterns of high confidence: context, kind. found has the arrays of scan()."""
    seen = found.select(F.explode(F.concat("_base", "_other")).alias("x")).select(F.explode("x.contexts").alias("context"), "x.value", "x.kind")
    edges = materialize(seen.groupBy("context", "value", "kind").agg(F.count("*").alias("n")), "edges")
    seeds = edges.where("kind is not null").groupBy("context", "kind").agg(F.count("*").alias("seeds"))
    totals = edges.groupBy("context").agg(F.sum("n").alias("total"))
    # Patterns without enough seeds of a kind can never give it.
    alive = seeds.where(F.col("seeds") >= how.seeds).join(totals, "context")
    alive = materialize(alive, "patterns")
    if not alive.limit(1).count():
        return alive.select("context", "kind")
    own = edges.where("kind is not null").join(alive, ["context", "kind"]).groupBy("context", "kind").agg(F.sum("n").alias("sure"))
    score = materialize(alive.join(own, ["context", "kind"]).select("context", "kind", "sure", "total", (F.col("sure") / (F.col("total") + how.smoothing)).alias("score")), "score")
    loose = materialize(edges.where("kind is null").join(alive.select("context").distinct(), "context").select("context", "value", "n"), "loose")
    for _ in range(how.rounds):
        held = loose.join(score, "context").where(fits(F.col("kind"), F.col("value")))
        belief = held.groupBy("value", "kind").agg(F.max("score").alias("belief"))
        gained = loose.join(belief, "value").groupBy("context", "kind").agg(F.sum(F.col("n") * F.col("belief")).alias("gain"))
        score = score.join(gained, ["context", "kind"], "left").select("context", "kind", "sure", "total", ((F.col("sure") + F.coalesce("gain", F.lit(0.0))) / (F.col("total") + how.smoothing)).alias("score"))
        score = materialize(score, "score")
    return score.where(F.col("score") >= how.confidence).select("context", "kind")


def find(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """The columns of docs but text, with spans: array of kind, start, end (code points), base; by kind as in KINDS, then start.

    A null text is empty. Rows are taken as they come, repeated ones each for itself; no rows give no rows. A column
    spans of docs gives way, other names may clash. A very long text is one row and must fit a task.
    """
    found = materialize(scan(_apart(docs)).drop("text"), "found")
    kept = [f"_doc.`{c}`" for c in docs.columns if c not in ("text", "spans")]
    return _with_spans(found, discover(found, how)).select(*kept, "spans")


def _apart(docs: DataFrame) -> DataFrame:
    """The text, a number for each row, and the other columns in one, so that no name of theirs can clash with ours."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in others) if others else (F.lit(0).alias("none"),)).alias("_doc"), "text").withColumn("_row", F.monotonically_increasing_id())


def _with_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    one = found.select("_row", F.explode("_other").alias("x")).select("_row", "x.start", "x.end", "x.value", F.explode("x.contexts").alias("_c"))
    more = one.join(patterns.select(F.col("context").alias("_c"), F.col("kind").alias("_k")), "_c").where(fits(F.col("_k"), F.col("value")))
    more = more.groupBy("_row").agg(F.collect_set(F.struct(F.col("_k").alias("kind"), "start", "end")).alias("_more"))
    ranked = lambda a, base: F.transform(a, lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(base).alias("base")))
    joined = found.join(more, "_row", "left")
    every = F.concat(ranked("_base", True), F.coalesce(ranked("_more", False), F.array().cast("array<struct<order: bigint, start: bigint, end: bigint, kind: string, base: boolean>>")))
    return joined.withColumn("spans", F.transform(F.array_sort(every), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))


def redact(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """docs with each found span's text replaced by its kind in brackets, as in ``[email]``; overlapping spans become one, named by the first.

    A null text stays null. Columns and rows are those of docs, repeated ones too; no rows give no rows.
    """
    held = materialize(scan(_apart(docs)), "held")
    spans = _with_spans(held.drop("text").select("_row", "_base", "_other"), discover(held, how)).where("size(spans) > 0").select("_row", "spans")
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kind = "array<struct<start: bigint, end: bigint, kind: string>>"

    # Overlapping spans become one, then the pieces between them are joined.
    def step(m: Column, s: Column) -> Column:
        open_ = (F.size(m["done"]) >= 0) & m["last"].isNotNull()
        over = open_ & (s["start"] < m["last"]["end"])
        wider = F.struct(m["last"]["start"].alias("start"), F.greatest(m["last"]["end"], s["end"]).alias("end"), m["last"]["kind"].alias("kind"))
        return F.struct(F.when(open_ & ~over, F.concat(m["done"], F.array(m["last"]))).otherwise(m["done"]).alias("done"), F.when(over, wider).otherwise(s).alias("last"))

    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<start: bigint, end: bigint, kind: string>").alias("last"))
    merge = lambda a: F.aggregate(a, zero, step, lambda m: F.concat(m["done"], F.array(m["last"])))
    cut = lambda t, a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))
    pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a)), lambda x, y: y["start"] < x["end"])
    merged = let(by_place, lambda a: F.when(F.exists(pairs(a), lambda x: x), merge(a)).otherwise(a))

    def replaced(spans: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
        items = F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))

        def of_chunk(c: Column) -> Column:
            piece = lambda t: lambda i: F.concat(cut(t, i["at"] - c[0]["at"], i["start"] - c[0]["at"]), F.lit("["), i["kind"], F.lit("]"))
            return let(cut(F.col("text"), c[0]["at"], F.element_at(c, -1)["start"]), lambda t: F.array_join(F.transform(c, piece(t)), ""))

        return F.concat(F.array_join(F.transform(chunks(items), of_chunk), ""), cut(F.col("text"), F.element_at(spans, -1)["end"], F.length("text")))

    text = let(merged, replaced)
    return held.join(spans, "_row", "left").withColumn("text", F.when(F.col("spans").isNotNull(), text).otherwise(F.col("text"))).select(*(F.col("text" if c == "text" else f"_doc.`{c}`") for c in docs.columns))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document."""
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))
