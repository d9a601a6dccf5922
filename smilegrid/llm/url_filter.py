"""URL filter by a tree of path templates per host.

Known URLs grow a tree for every host: level by level, a segment that many of its
branch's URLs share stays literal, the others become their shape (digits as {n}) if
that is frequent, and else {x} or {w} (with and without digits). Sibling branches
whose shares of blocked labels do not differ by a two-sample test are merged, named
{a|b}, and grow on as one branch. A template is rejected when the smoothed share of
blocked labels in it is high enough, counted by labels and by the segments it
generalises, and when labels cover enough of it.

Explicit rules come first and the longest wins. Everything is DataFrame functions;
a hot host is spread because all counts are partial sums by (host, branch, segment).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, load

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A segment, or else its shape, keeps a branch of its own with this many URLs and this share of those
#: of the branch above, so a branch has at most 1 / share children of either kind.
SUPPORT, SHARE = 5, 0.05
#: Pseudo-labels, half blocked; the share from which on a template is rejected; the difference in
#: standard errors up to which siblings are alike.
PSEUDO, REJECT_FROM, ALIKE = 2.0, 0.8, 1.96
#: A template is rejected only if labels cover this share of the URLs and of the distinct segments at each position it generalises.
COVER = 0.25


@dataclass(frozen=True)
class Rule:
    """Blocks or allows the paths that start with `path` on `host` and all its subdomains."""

    blocked: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule's text, and whether it blocks; null if none fits."""
    text, blocked = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later, longer rules are asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        blocked = F.when(fits, F.lit(rule.blocked)).otherwise(blocked)
    return text, blocked


def literal(segment: Column) -> Column:
    """A segment's own name. Braces and bars stand for wildcards and merged branches only."""
    return F.replace(F.replace(segment, F.lit("{"), F.lit("%7B")), F.lit("|"), F.lit("%7C"))


def shape(segment: Column) -> Column:
    return F.when(F.regexp_like(segment, F.lit("[0-9]")), F.regexp_replace(literal(segment), "[0-9]+", "{n}"))


def other(segment: Column) -> Column:
    """What a segment becomes that is frequent neither itself nor by its shape."""
    return F.when(segment == "", "").otherwise(F.when(F.regexp_like(segment, F.lit("[0-9]")), "{x}").otherwise("{w}"))


def _template(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit("/"), F.array_join(names, "/"))).otherwise("")


def _alike(nodes: DataFrame) -> DataFrame:
    """(host, above, name, merged): labelled siblings that merge, and the name of what they become.

    Siblings are put in order of their share of blocked labels. Where two neighbours
    differ by a two-sample test of shares, a group ends. A branch has at most
    2 / SHARE + 3 children, so a window holds no more rows than that.
    """
    by_share = Window.partitionBy("host", "above").orderBy("share", "name")
    share, labels = F.col("share"), F.col("labels")
    all_labels = labels + F.lag("labels").over(by_share)
    pooled = (F.col("blocked") + F.lag("blocked").over(by_share)) / all_labels
    error = F.sqrt(pooled * (1 - pooled) * (1 / labels + 1 / F.lag("labels").over(by_share)))
    ends = F.coalesce(share - F.lag("share").over(by_share) > error * ALIKE, F.lit(False))
    grouped = (
        nodes.where("labels > 0")
        .withColumn("share", F.col("blocked") / labels)
        .withColumn("ends", ends.cast("int"))
        .withColumn("group", F.sum("ends").over(by_share.rowsBetween(Window.unboundedPreceding, 0)))
    )
    of = Window.partitionBy("host", "above", "group")
    merged = F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("name").over(of)), "|"), F.lit("}"))
    return grouped.select("host", "above", "name", F.count(F.lit(1)).over(of).alias("members"), merged.alias("merged")).where("members > 1").drop("members")


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, n, labels, blocked, parts, names) of distinct (host, path, n, labels, blocked):
    `parts` are a path's segments and `names` what each of them is called in the tree.

    The tree grows from the root until every branch with SUPPORT URLs has ended, however deep.
    Segments that all URLs of a branch have next are taken in one round, so rounds are
    the depths at which branches part. In a branch below SUPPORT nothing can be frequent:
    the rest of its paths is named at once. The empty path has no segments.
    """
    parts = F.split("path", "/", -1)
    rows = paths.withColumn("parts", F.slice(parts, F.lit(2), F.size(parts))).withColumn("names", F.array().cast("array<string>"))
    columns, done, here = rows.columns, None, ["host", "above"]
    before = [c for c in columns if c != "names"]
    while True:
        placed = rows.withColumns({"at": F.size("names"), "above": _template(F.col("names"))})
        ended = placed.where(F.col("at") == F.size("parts")).select(*columns)
        done = ended if done is None else done.unionByName(ended)
        live = placed.where(F.col("at") < F.size("parts"))
        if live.isEmpty():
            return done
        left = F.slice("parts", F.col("at") + 1, F.size("parts"))
        branches = live.groupBy(*here).agg(F.sum("n").alias("total"), F.min(left).alias("least"), F.max(left).alias("most"))
        parting = F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        shared = F.when(parting == 0, F.size("least")).otherwise(parting - 1)  # the least is a prefix of the most, or they part
        kind = F.when(F.col("total") < SUPPORT, "small").when(shared > 0, "chain").otherwise("wide")
        live = live.join(branches.select(*here, "total", shared.alias("shared"), kind.alias("kind")), here)
        live = live.withColumn("segment", F.get("parts", F.col("at"))).withColumn("shape", shape(F.col("segment")))

        enough = (F.col("k") >= SUPPORT) & (F.col("k") >= F.col("total") * SHARE)
        counted = live.where("kind = 'wide'").groupBy(*here, "segment", "shape", "total").agg(F.sum("n").alias("k"))
        frequent = enough & (F.col("segment") != "")
        own = counted.where(frequent).select(*here, "segment", F.lit(True).alias("own"))
        shaped = counted.where(~frequent & F.col("shape").isNotNull()).groupBy(*here, "shape", "total").agg(F.sum("k").alias("k"))
        shapes = shaped.where(enough).select(*here, "shape", F.col("shape").alias("kept"))
        one = F.when(F.col("own"), literal(F.col("segment"))).otherwise(F.coalesce("kept", other(F.col("segment"))))
        rest = F.transform(left, other)
        run = F.transform(F.slice("parts", F.col("at") + 1, F.greatest("shared", F.lit(1))), literal)
        more = F.when(F.col("kind") == "small", rest).when(F.col("kind") == "chain", run).otherwise(F.array(one))
        named = live.join(own, [*here, "segment"], "left").join(shapes, [*here, "shape"], "left").withColumn("more", more)
        named = cut(named.select(*columns, "above", "more", F.when(F.col("kind") == "wide", F.get("more", F.lit(0))).alias("name")), "named")
        nodes = named.where("name is not null").groupBy(*here, "name").agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"))
        called = F.concat("names", F.when(F.col("merged").isNull(), F.col("more")).otherwise(F.array("merged")))
        rows = cut(named.join(_alike(nodes), [*here, "name"], "left").select(*before, called.alias("names")), "rows")


def units(placed: DataFrame) -> DataFrame:
    """`placed` with every path once for each (position, segment) whose name in its template is not its own."""
    pairs = F.transform(F.arrays_zip("parts", "names"), lambda p, i: F.struct(i.alias("position"), p["parts"].alias("segment"), p["names"].alias("name")))
    wild = F.filter(pairs, lambda p: literal(p["segment"]) != p["name"])
    kept = [c for c in placed.columns if c not in ("parts", "names")]
    return placed.select(*kept, F.explode(wild).alias("u")).select(*kept, F.col("u.position").alias("position"), F.col("u.segment").alias("segment"))


def rejected(placed: DataFrame) -> DataFrame:
    """(host, template, purity) of the templates that are rejected, from (host, path, n, labels, blocked, parts, names, template).

    Labels that rules or reports give to a section speak for that section only. So a template's
    purity is the lowest of that of its labels and, for each position at which it replaces
    segments, that of the replaced segments, where each segment counts once however many labels it
    has; segments without labels call for PSEUDO votes more, half of them blocked. Labels must also
    cover COVER of the URLs and of the distinct segments at each such position.
    A template without labels is never rejected.
    """
    own = placed.where("labels > 0").groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + PSEUDO / 2) / (F.col("labels") + PSEUDO)
    pure = cut(own.select("host", "template", purity.alias("purity")).where(F.col("purity") >= REJECT_FROM), "pure")
    seen = units(placed.join(pure.select("host", "template"), ["host", "template"], "left_semi"))
    seen = seen.groupBy("host", "template", "position", "segment").agg(
        F.sum(F.greatest("n", "labels")).alias("urls"),
        F.sum(F.when(F.col("labels") > 0, F.greatest("n", "labels")).otherwise(0)).alias("covered"),
        (F.sum("blocked") / F.nullif(F.sum("labels"), F.lit(0))).alias("vote"),
    )
    unseen = F.when(F.count("vote") < F.count(F.lit(1)), PSEUDO).otherwise(0.0)
    by_position = seen.groupBy("host", "template", "position").agg(
        F.least(F.sum("covered") / F.sum("urls"), F.count("vote") / F.count(F.lit(1))).alias("cover"),
        ((F.coalesce(F.sum("vote"), F.lit(0.0)) + unseen / 2) / (F.count("vote") + unseen)).alias("vote"),
    )
    worst = by_position.groupBy("host", "template").agg(F.min("cover").alias("cover"), F.min("vote").alias("vote"))
    found = pure.join(worst, ["host", "template"], "left").withColumn("purity", F.least("purity", "vote"))
    return found.where((F.col("purity") >= REJECT_FROM) & (F.coalesce("cover", F.lit(1.0)) >= COVER)).select("host", "template", "purity")


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """The columns of `pages` with (host, path, rule, template, verdict) after them.

    `rule` is the longest fitting rule (null if none) and decides; any other URL is
    blocked if its template is rejected. Labels are the pages that rules decide and,
    if given, the rows of `labels` (url, blocked), which may be null in any column
    (such rows are not used). The rules are a list in the program, not a table.

    A URL is split at its first ://; a null URL or one without :// has an empty host
    and path and an empty template. Repeated URLs count as often as they occur.
    Columns of `pages` that have one of these names are replaced.
    """
    names = ("host", "path", "rule", "template", "verdict")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.withColumns({"_host": host, "_path": path})
    text, blocked = ruled(F.col("_host"), F.col("_path"), rules)
    split = split.withColumns({"_rule": text, "_blocked": blocked})
    known = split.select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_blocked").alias("blocked"), F.lit(1).alias("n"))
    if labels is not None:
        more = labels.where("url is not null and blocked is not null")
        known = known.unionByName(more.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked", F.lit(0).alias("n")))
    paths = cut(
        known.groupBy("host", "path").agg(F.sum("n").alias("n"), F.count("blocked").alias("labels"), F.count_if("blocked").alias("blocked")), "paths"
    )
    placed = cut(templates(paths).withColumn("template", _template(F.col("names"))), "templates")
    bad = rejected(placed)
    found = placed.join(bad, ["host", "template"], "left").select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("template").alias("_template"), F.col("purity").isNotNull().alias("_rejected")
    )
    block = F.coalesce(F.col("_blocked"), F.col("_rejected"))
    joined = split.join(found, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_p")), "left")
    return joined.select(
        *[pages[c] for c in pages.columns if c not in names],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.col("_template").alias("template"),
        F.when(block, "block").otherwise("allow").alias("verdict"),
    )


OP4_RULES = [
    Rule(True, "com", "/en/"),
    Rule(False, "example.com", "/en/7"),
    Rule(False, "net", "/de/"),
    Rule(True, "example.net", "/de/8"),
    Rule(True, "org", "/es/"),
]


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    judged = judge(load(spark, sf_dir, "pages").select("page_id", "url"), OP4_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


_LITERAL = "replace(replace({0}, '{{', '%7B'), '|', '%7C')"
_OTHER = "CASE WHEN {0} = '' THEN '' WHEN regexp_matches({0}, '[0-9]') THEN '{{x}}' ELSE '{{w}}' END"

OP4_SQL = rf"""
WITH RECURSIVE split AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
rules(blocked, rhost, rpath) AS (VALUES {", ".join(f"({r.blocked}, '{r.host}', '{r.path}')" for r in OP4_RULES)}),
best AS (
  SELECT host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(blocked, length(rhost || rpath)) AS blocked
  FROM (SELECT DISTINCT host, path FROM split), rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
paths AS (
  SELECT s.host, s.path, CAST(count(*) AS BIGINT) AS n, CAST(count(b.blocked) AS BIGINT) AS labels,
         CAST(count(*) FILTER (WHERE b.blocked) AS BIGINT) AS blocked
  FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path GROUP BY s.host, s.path),
tree(host, path, n, labels, blocked, parts, names, template) AS (
  SELECT host, path, n, labels, blocked, string_split(path, '/')[2:], CAST([] AS VARCHAR[]), '' FROM paths
  UNION ALL (
    WITH live AS (
      SELECT *, parts[len(names) + 1] AS seg, sum(n) OVER (PARTITION BY host, template) AS total FROM tree WHERE len(names) < len(parts)),
    counted AS (SELECT *, sum(n) OVER (PARTITION BY host, template, seg) AS k FROM live),
    shaped AS (
      SELECT *, seg <> '' AND k >= {SUPPORT} AND k >= total * CAST({SHARE} AS DOUBLE) AS own,
             CASE WHEN regexp_matches(seg, '[0-9]') THEN regexp_replace({_LITERAL.format("seg")}, '[0-9]+', '{{n}}', 'g') END AS shape FROM counted),
    kept AS (SELECT *, sum(n) OVER (PARTITION BY host, template, shape, own) AS of_shape FROM shaped),
    named AS (
      SELECT *, CASE WHEN own THEN {_LITERAL.format("seg")}
                     WHEN shape IS NOT NULL AND of_shape >= {SUPPORT} AND of_shape >= total * CAST({SHARE} AS DOUBLE) THEN shape
                     ELSE {_OTHER.format("seg")} END AS name FROM kept),
    nodes AS (
      SELECT host, template, name, CAST(sum(labels) AS DOUBLE) AS l, CAST(sum(blocked) AS DOUBLE) AS b FROM named
      WHERE total >= {SUPPORT} GROUP BY ALL HAVING sum(labels) > 0),
    pairs AS (
      SELECT *, b / l AS share, lag(b / l) OVER w AS share_, lag(l) OVER w AS l_, (b + lag(b) OVER w) / (l + lag(l) OVER w) AS p
      FROM nodes WINDOW w AS (PARTITION BY host, template ORDER BY b / l, name)),
    ends AS (SELECT *, CASE WHEN share - share_ > sqrt(p * (1 - p) * (1 / l + 1 / l_)) * CAST({ALIKE} AS DOUBLE) THEN 1 ELSE 0 END AS e FROM pairs),
    grouped AS (SELECT *, sum(e) OVER (PARTITION BY host, template ORDER BY share, name ROWS UNBOUNDED PRECEDING) AS g FROM ends),
    merged AS (
      SELECT host, template, unnest(list(name)) AS name, '{{' || string_agg(name, '|' ORDER BY name) || '}}' AS called
      FROM grouped GROUP BY host, template, g HAVING count(*) > 1)
    SELECT a.host, a.path, a.n, a.labels, a.blocked, a.parts, list_append(a.names, coalesce(m.called, a.name)),
           a.template || '/' || coalesce(m.called, a.name)
    FROM named a LEFT JOIN merged m ON a.host = m.host AND a.template = m.template AND a.name = m.name)),
placed AS (SELECT * FROM tree WHERE len(names) = len(parts)),
own AS (SELECT host, template, (sum(blocked) + {PSEUDO / 2}) / (sum(labels) + {PSEUDO}) AS purity FROM placed WHERE labels > 0 GROUP BY ALL),
positions AS (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM placed),
seen AS (
  SELECT host, template, i, parts[i] AS seg, sum(greatest(n, labels)) AS urls, sum(CASE WHEN labels > 0 THEN greatest(n, labels) ELSE 0 END) AS covered,
         CAST(sum(blocked) AS DOUBLE) / nullif(sum(labels), 0) AS vote
  FROM positions WHERE names[i] <> {_LITERAL.format("parts[i]")} GROUP BY ALL),
by_position AS (
  SELECT host, template, i, least(sum(covered) / sum(urls), CAST(count(vote) AS DOUBLE) / count(*)) AS cover,
         CASE WHEN count(vote) < count(*) THEN (coalesce(sum(vote), 0) + {PSEUDO / 2}) / (count(vote) + {PSEUDO})
              ELSE sum(vote) / count(vote) END AS vote FROM seen GROUP BY ALL),
worst AS (SELECT host, template, min(cover) AS cover, min(vote) AS vote FROM by_position GROUP BY ALL),
bad AS (
  SELECT o.host, o.template FROM own o LEFT JOIN worst w ON o.host = w.host AND o.template = w.template
  WHERE least(o.purity, coalesce(w.vote, 1)) >= {REJECT_FROM} AND coalesce(w.cover, 1) >= {COVER})
SELECT s.page_id, s.host, s.path, b.rule,
       CASE WHEN coalesce(b.blocked, x.host IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict, p.template
FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
JOIN placed p ON s.host = p.host AND s.path = p.path
LEFT JOIN bad x ON p.host = x.host AND p.template = x.template
"""
