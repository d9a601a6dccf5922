"""Personal data, and the terms that give it away.

Entities (email, ip, card, phone) are found by patterns. A term reveals an entity if it is
nearly always seen near it: with document counts over the corpus, PMI(entity; term) is
compared with the information of the entity, -log p(entity). The share that the term
reveals is 1 - log p(entity | term) / log p(entity); from THRESHOLD on, and if
SUPPORT different surroundings show it, the term is sanitised wherever it occurs.

All is DataFrame functions. Texts are identified by their digest, so copies are worked
on once and counted as often as they occur, and a text itself is never shuffled. Offsets
are code points, found by running sums over the pieces between matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import broadcast_below, cut, load

KINDS = ("email", "ip", "card", "phone", "term")
#: One pattern per kind of entity. They find what plain greedy patterns find, without their backtracking: an email
#: starts at the start of a run of its characters or where the last one ended, an address at the start of a
#: run of digits; a card is a maximal chain of digits of at least 13.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words on each side of an entity that are near it, within so many code points; shorter terms are not sanitised.
NEAR, REACH, SHORTEST = 8, 160, 4
#: Different surroundings in which a term and an entity are seen together; the share of its information that a term may not reveal.
SUPPORT, THRESHOLD = 3, 0.95
#: Code points of the pieces in which texts are rewritten.
PIECE = 1000


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    return F.regexp_extract_all(_folded(text), F.lit(WORD), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    digit = lambda i: F.substring(number, -i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    small = lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False)
    parts = F.forall(F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), small)
    n = F.length(digits(match))
    card = F.when(n.between(13, 19), luhn(digits(match))).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", parts).when(kind == "card", card).otherwise(n.between(9, 15))


def entity(kind: Column, match: Column) -> Column:
    """What a match names, however it is written."""
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits(match)).otherwise(_folded(match)))


def _pieces(text: Column, pattern: str) -> Column:
    """Array of (hit, gap, before, after): every match, the length of what lies between it and the last one, and what is near it."""
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), between.alias("left"), F.slice(between, F.lit(2), F.size(between)).alias("right")
    )
    return F.transform(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        lambda z: F.struct(z["hit"].alias("hit"), F.length(z["left"]).alias("gap"), F.right(z["left"], F.lit(REACH)).alias("before"), F.left(z["right"], F.lit(REACH)).alias("after")),
    )


def mentions(docs: DataFrame) -> DataFrame:
    """(digest, kind, start, end, valid, entity, before, after, copies) of every match in the texts of `docs` (digest, text)."""
    none = F.array().cast("array<struct<hit:string,gap:int,before:string,after:string>>")
    there = {"email": F.contains("text", F.lit("@")), "ip": F.regexp_like("text", F.lit(PATTERNS["ip"])), "card": F.regexp_like("text", F.lit(PATTERNS["card"])), "phone": F.contains("text", F.lit("+"))}
    kinds = [F.struct(F.lit(k).alias("kind"), F.when(there[k], _pieces(F.col("text"), p)).otherwise(none).alias("hits")) for k, p in PATTERNS.items()]
    found = docs.select("digest", F.explode(F.array(*kinds)).alias("k")).select("digest", "k.kind", F.posexplode("k.hits").alias("i", "h"))
    good = valid(F.col("kind"), F.col("h.hit"))
    found = found.withColumn("valid", good).select(
        "digest", "kind", "i", "valid", F.length("h.hit").alias("length"), "h.gap", *[F.when(F.col("valid"), c).alias(n) for n, c in (("entity", entity(F.col("kind"), F.col("h.hit"))), ("before", F.col("h.before")), ("after", F.col("h.after")))]
    )
    found = cut(found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("copies")), "mentions")
    so_far = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).where("valid").drop("i", "gap", "length", "valid")


def revealing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, entity, disclosure) of the terms that reveal an entity; `docs` has (digest, text), `found` the mentions.

    A document counts as often as it is repeated; surroundings that are equal count once as support.
    """
    near_left = F.slice(F.reverse(F.when(F.length("before") >= REACH, F.slice(words(F.col("before")), F.lit(2), F.lit(REACH))).otherwise(words(F.col("before")))), 1, NEAR)
    near_right = F.slice(F.when(F.length("after") >= REACH, F.slice(words(F.col("after")), F.lit(1), F.greatest(F.size(words(F.col("after"))) - 1, F.lit(0)))).otherwise(words(F.col("after"))), 1, NEAR)
    around = found.select("digest", "entity", "copies", near_left.alias("l"), near_right.alias("r"))
    seen = around.select("digest", "entity", "copies", F.md5(F.concat_ws(" ", "l", F.lit("|"), "r")).alias("place"), F.explode(F.array_distinct(F.concat("l", "r"))).alias("term"))
    seen = cut(seen.where(F.length("term") >= SHORTEST), "near")
    often = seen.select("entity", "term", "place").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") >= SUPPORT)
    often = cut(often.select("entity", "term"), "often")
    total = docs.count()
    if often.isEmpty():
        return often.select("term", "entity", F.lit(0.0).alias("disclosure"))
    together = seen.join(often, ["entity", "term"], "left_semi").select("entity", "term", "digest", "copies").distinct().groupBy("entity", "term").agg(F.sum("copies").alias("both"))
    entities = found.select("entity", "digest", "copies").distinct().groupBy("entity").agg(F.sum("copies").alias("of_entity"))
    terms = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    share = 1 - F.ln(F.least(F.col("both") / F.col("of_term"), F.lit(1.0))) / F.ln(F.col("of_entity") / F.lit(float(total)))
    known = together.join(entities, "entity").join(terms, "term").where(F.col("of_entity") < total)
    return known.select("term", "entity", share.alias("disclosure")).where(F.col("disclosure") >= THRESHOLD)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(digest, kind, start, end) of every occurrence of the `terms` in the texts of `docs` (digest, text)."""
    terms = broadcast_below(terms)
    holding = docs.select("digest", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(terms, "term", "left_semi").select("digest").distinct()
    holding = cut(holding, "holding")
    gaps = F.transform(F.split(_folded(F.col("text")), WORD, -1), lambda g: F.length(g))
    tokens = F.arrays_zip(words(F.col("text")).alias("word"), gaps.alias("gap"))
    rows = docs.join(holding, "digest", "left_semi").select("digest", F.posexplode(tokens).alias("i", "t")).where("t.word is not null")
    rows = rows.select("digest", "i", F.col("t.word").alias("term"), F.col("t.gap").alias("gap")).distinct()
    so_far = Window.partitionBy("digest").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("term")).over(so_far))
    return rows.join(terms, "term", "left_semi").select("digest", F.lit("term").alias("kind"), (F.col("end") - F.length("term")).alias("start"), "end")


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, spans) of every different text that has any: an array of (kind, start, end), by kind in the order of KINDS, then start.

    Offsets are code points, end exclusive. Matches of one kind do not overlap; those of different kinds may.
    A term that starts inside an entity is not named again. A null text is empty and
    has no spans; repeated rows, empty tables and further columns need no care.
    """
    texts = docs.select(digest_of(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = cut(mentions(texts), "found")
    base = found.select("digest", "kind", "start", "end")
    terms = cut(revealing(texts, found).select("term").distinct(), "terms")
    every = base
    if not terms.isEmpty():
        every = base.unionByName(term_spans(texts, terms))
        before = Window.partitionBy("digest").orderBy("start", F.col("kind") == "term").rowsBetween(Window.unboundedPreceding, 0)
        covered = F.max(F.when(F.col("kind") != "term", F.col("end"))).over(before)
        every = every.withColumn("covered", F.coalesce(covered, F.lit(0))).where((F.col("kind") != "term") | (F.col("covered") <= F.col("start"))).drop("covered")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    row = F.struct(order.alias("order"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind")
    whole = every.groupBy("digest").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return whole.select("digest", F.transform("rows", lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), r["end"].alias("end"))).alias("spans"))


def digest_of(text: Column) -> Column:
    """What identifies a text; null and empty texts are one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a column `spans` (see `spans`; empty if there are none); a column of that name is replaced."""
    found = cut(spans(docs, text_col), "spans").withColumnsRenamed({"digest": "_digest", "spans": "_spans"})
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    joined = docs.withColumn("_of", digest_of(F.col(text_col))).join(found, F.col("_of") == F.col("_digest"), "left")
    return joined.select(*[docs[c] for c in docs.columns if c != "spans"], F.coalesce("_spans", none).alias("spans"))


def sanitise(found: DataFrame, text_col: str = "text") -> DataFrame:
    """`found` (rows with `spans`) with a column `clean`: entities are generalised to <EMAIL>, <IP>, <CARD> or <PHONE>, terms removed.

    Where spans overlap, what they cover together takes the name of the first. Texts without
    spans stay as they are; a null text stays null. The others are rewritten in pieces of
    PIECE code points, so the work grows with the text and its spans, not with their product.
    """
    texts = found.where(F.size("spans") > 0).select(digest_of(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"), "spans")
    parts = texts.select("digest", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "part")).distinct()
    rows = texts.select("digest", F.explode("spans").alias("s")).distinct().select("digest", "s.*")
    in_order = Window.partitionBy("digest").orderBy("start", F.col("end").desc(), "kind")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("group", F.sum(F.when(F.coalesce(reached, F.lit(0)) <= F.col("start"), 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("digest", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    named = F.when(F.col("kind") == "term", "").otherwise(F.concat(F.lit("<"), F.upper("kind"), F.lit(">")))
    pieces = F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE)))
    local = merged.select("digest", "start", "end", named.alias("name"), pieces.alias("piece")).select(
        "digest",
        F.col("piece").cast("int").alias("piece"),
        F.greatest(F.col("start") - F.col("piece") * PIECE, F.lit(0)).cast("int").alias("from"),
        F.least(F.col("end") - F.col("piece") * PIECE, F.lit(PIECE)).cast("int").alias("to"),
        F.when(F.floor(F.col("start") / PIECE) == F.col("piece"), F.col("name")).otherwise("").alias("name"),
    )
    cuts = local.groupBy("digest", "piece").agg(F.array_sort(F.collect_list(F.struct("from", "to", "name"))).alias("cuts"))
    at = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    step = lambda a, c: F.struct(c["to"].alias("at"), F.concat(a["text"], F.substring(F.col("part"), a["at"] + 1, c["from"] - a["at"]), c["name"]).alias("text"))
    done = F.aggregate("cuts", at, step, lambda a: F.concat(a["text"], F.substring(F.col("part"), a["at"] + 1, F.lit(PIECE))))
    rewritten = parts.join(cuts, ["digest", "piece"], "left").select("digest", F.struct("piece", F.when(F.col("cuts").isNull(), F.col("part")).otherwise(done).alias("text")).alias("p"))
    clean = rewritten.groupBy("digest").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("_clean"))
    clean = clean.withColumnRenamed("digest", "_digest")
    joined = found.withColumn("_of", digest_of(F.col(text_col))).join(clean, F.col("_of") == F.col("_digest"), "left")
    return joined.select(*[found[c] for c in found.columns if c != "clean"], F.coalesce("_clean", F.col(text_col)).alias("clean"))


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(load(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda s: F.array_join(F.transform(s, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda r: r["kind"] != "term")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
