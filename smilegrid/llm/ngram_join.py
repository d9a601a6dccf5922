"""N-gram Jaccard join by vertical partitioning.

The global order of all shingles is cut into fragments. A document's set falls
into one segment per fragment, fragments are worked on independently, and what
they find is summed:

1. every document becomes a set of word shingles; equal sets are one class;
2. the order by hash is cut into fragments of a few million shingles. Each
   fragment counts, per class, the shingles that some other class holds too.
   A class whose partial counts sum to less than the overlap that any link
   needs cannot be linked and leaves;
3. the remaining shingles are ordered by rarity. Classes that share a shingle of
   their necessary prefixes are candidates, the order is cut into fragments
   again, and the partial overlaps of each candidate pair are summed.

A group of near copies would be quadratic in candidates, so they are taken in
two passes: first every class against the most central classes of about its size
at each prefix shingle, which joins nearly all of a group; then all remaining candidates
between different components. The second pass is exhaustive, so components are
those of all links, and no pair within a joined group is built.

Shingles and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import SPACED, mix, run_hashes, text_bytes, whole_hash, words
from .memory import returning_memory
from .tables import broadcast_below, components, cut, load

#: Text handled at a time by a task, in bytes.
CHUNK_BYTES = 8 << 20
#: Shingles of one fragment.
FRAGMENT = 2_000_000
#: Pivots of the order by rarity: documents that hold a shingle.
RARITY_PIVOTS = (2, 3, 5, 9, 17, 65, 257)
_MANY = np.uint32(0xFFFFFFFF)
#: Bits of a class's hash that name it to the fragments.
NAME = 0xFFFFFFFF


def _set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of a text's words."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < size:
        return np.array([whole_hash(hashes)])
    runs = np.sort(run_hashes(hashes, size))
    keep = np.ones(len(runs), dtype=bool)
    np.not_equal(runs[1:], runs[:-1], out=keep[1:])
    return runs[keep]


def _class_of(shingles: np.ndarray) -> int:
    total = int(np.add.reduce(mix(shingles), dtype=np.uint64)) + len(shingles) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (2**64 - 1)], dtype=np.uint64)).view(np.int64)[0])


def _chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches cut into row ranges of bounded text size."""
    for batch in batches:
        column = batch.column(text)
        _, bounds = text_bytes(column)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + CHUNK_BYTES, "right")) - 1)
            yield batch.slice(start, end - start), column.slice(start, end - start)
            start = end


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    found = words(column, SPACED)
    starts = found.starts
    return [_set(found.hashes[a:b], size) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def set_sizes(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, n, cls): size of each document's set and the class of equal sets (null if empty)."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, column in _chunks(batches, "text"):
            sets = _sets(column, size)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                ],
                ["doc_id", "n", "cls"],
            )

    return _pair(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, cls long")


def _pair(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _need(n: Column, percent: int) -> Column:
    """Fewest common shingles of a set of n with any linked set."""
    return F.ceil(n * percent / 100).cast("long")


def _entries(sets: list[np.ndarray], fragments: int, name: int = NAME) -> Iterator[tuple[int, bytes]]:
    """What one chunk tells each fragment.

    A shingle that several classes of the chunk hold is sent once, without them:
    they already know that it is common. So a very frequent shingle costs one
    entry a chunk, however many documents hold it.

    Of a hash only the lower half travels; the upper half has chosen the fragment.
    Different shingles of a fragment that agree in it (one in some 2,000, as a fragment
    holds a few million) count as common, which can keep a class and never drops one.
    A class is named by the `name` bits of its hash, once a fragment: with many fragments
    that is nearly once a shingle.
    """
    classes: dict[int, np.ndarray] = {}
    for s in sets:
        if len(s):
            classes.setdefault(_class_of(s), s)
    if not classes:
        return
    names = (np.array(list(classes), dtype=np.int64) & name).astype(np.uint32)
    hashes = np.concatenate(list(classes.values()))
    owner = np.repeat(np.arange(len(names), dtype=np.uint32), [len(s) for s in classes.values()])
    order = np.argsort(hashes)
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    common = ~first
    common[:-1] |= ~first[1:]
    edges = np.searchsorted((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), np.arange(fragments + 1))
    for part in range(fragments):
        a, b = int(edges[part]), int(edges[part + 1])
        if a == b:
            continue
        own, shared, lead = owner[a:b], common[a:b], first[a:b]
        who, local = np.unique(own, return_inverse=True)
        known = np.bincount(local[shared], minlength=len(who)).astype(np.uint32)
        sender = np.where(shared, _MANY, local.astype(np.uint32))[lead]
        sent = hashes[a:b][lead].astype(np.uint32)
        by_sender = np.argsort(sender, kind="stable")  # runs of equal numbers compress well
        head = np.array([len(sent), len(who)], dtype=np.uint64)
        yield part, b"".join(x.tobytes() for x in (head, sent[by_sender], sender[by_sender], known, names[who]))


def _read_entry(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k, m = (int(x) for x in np.frombuffer(payload, np.uint64, 2))
    at = 16
    out = []
    for kind, count in ((np.uint32, k), (np.uint32, k), (np.uint32, m), (np.uint32, m)):
        out.append(np.frombuffer(payload, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return tuple(out)


def _count_fragment(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a fragment and how many of their shingles in it another class holds."""
    hashes, owner, known, names = [], [], [], []
    offset = 0
    for payload in payloads:
        h, o, k, c = _read_entry(payload)
        hashes.append(h)
        owner.append(np.where(o == _MANY, np.int64(-1), o.astype(np.int64) + offset))
        known.append(k)
        names.append(c)
        offset += len(c)
    h, o, n = np.concatenate(hashes), np.concatenate(owner), np.concatenate(names)
    order = np.argsort(h)
    h, o = h[order], o[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    # Classes are compared by their place among the distinct names, so copies in several chunks are one class.
    distinct, first, place = np.unique(n, return_index=True, return_inverse=True)
    holder = np.where(o < 0, -1, place[o])
    low, high = np.minimum.reduceat(holder, starts), np.maximum.reduceat(holder, starts)
    common = np.repeat((low < 0) | (low != high), np.diff(np.append(starts, len(h)))) & (o >= 0)
    counts = np.bincount(o[common], minlength=offset) + np.concatenate(known)
    return distinct, counts[first]


def common_counts(docs: DataFrame, id_col: str, text_col: str, size: int, fragments: int, name: int = NAME) -> DataFrame:
    """(name, common): how many shingles of the class of that name a class of another name holds too, or a few more.
    Where classes share a name the count is of any of them."""

    @returning_memory
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column in _chunks(batches, "text"):
            for part, payload in _entries(_sets(column, size), fragments, name):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([payload], pa.binary())], ["part", "payload"])

    @returning_memory
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                parts.setdefault(part, []).append(payload)
        for part in list(parts):
            names, counts = _count_fragment(parts.pop(part))
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[some].astype(np.int64)), pa.array(counts[some].astype(np.int64))], ["name", "common"])

    return (
        _pair(docs, id_col, text_col)
        .mapInArrow(send, "part int, payload binary")
        .repartition(fragments, "part")
        .mapInArrow(count, "name long, common long")
        .groupBy("name")
        .agg(F.sum("common").alias("common"))
    )


def class_tokens(docs: DataFrame, id_col: str, text_col: str, size: int, chosen: DataFrame) -> DataFrame:
    """(cls, n, hashes) of the chosen classes, read from one document of each."""

    @returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, column in _chunks(batches, "text"):
            sets = {_class_of(s): s for s in _sets(column, size) if len(s)}
            lengths = [len(s) for s in sets.values()]
            values = np.concatenate([*sets.values(), np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sets), pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(values)),
                ],
                ["cls", "n", "hashes"],
            )

    ids = broadcast_below(cut(chosen.select(F.col("rep").alias("chosen_id")).distinct(), "chosen"))
    source = _pair(docs, id_col, text_col)
    source = source.join(ids, source["doc_id"].eqNullSafe(ids["chosen_id"]), "left_semi")
    found = source.mapInArrow(run, "cls long, n long, hashes array<long>").dropDuplicates(["cls"])
    return found.join(chosen.select("cls"), "cls", "left_semi")


def _ranked(tokens: DataFrame, percent: int) -> DataFrame:
    """Shared shingles of each class in the global order by rarity: (cls, n, m, need, toks)."""
    postings = tokens.select("cls", "n", F.explode("hashes").alias("h"))
    rarity = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return (
        postings.join(rarity, "h")
        .groupBy("cls", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("toks"))
        .withColumn("m", F.size("toks").cast("long"))
        .withColumn("need", _need(F.col("n"), percent))
        .where("m >= need")
    )


def _prefixes(ranked: DataFrame) -> DataFrame:
    """Necessary prefix: a link needs `need` common shingles, so of the m that are shared at
    all, one of the first m - need + 1 in the global order is common."""
    centrality = F.aggregate("toks", F.lit(0).cast("long"), lambda total, t: total + t["df"]) / F.col("n")
    return ranked.withColumn("centre", centrality).select(
        "cls",
        "n",
        "m",
        "centre",
        F.posexplode(F.slice("toks", F.lit(1), (F.col("m") - F.col("need") + 1).cast("int"))).alias("pos", "t"),
    ).select("cls", "n", "m", "centre", "pos", F.col("t.h").alias("h"))


def _segments(ranked: DataFrame) -> DataFrame:
    """(cls, frag, hs): the order by rarity cut at the pivots."""
    bounds = [0, *RARITY_PIVOTS, None]

    def piece(low: int, high: int | None) -> Column:
        inside = lambda t: (t["df"] >= low) & ((t["df"] < high) if high else F.lit(True))
        return F.transform(F.filter("toks", inside), lambda t: t["h"])

    pieces = F.array(*[piece(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return ranked.select("cls", F.posexplode(pieces).alias("frag", "hs")).where(F.size("hs") > 0)


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose partial overlaps sum to enough."""
    left = segments.select(F.col("cls").alias("a"), "frag", F.col("hs").alias("ha"))
    right = segments.select(F.col("cls").alias("b"), "frag", F.col("hs").alias("hb"))
    return (
        pairs.join(left, "a")
        .join(right, ["b", "frag"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("part"))
        .groupBy("a", "b", "na", "nb")
        .agg(F.sum("part").alias("overlap"))
        .where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent)
        .select("a", "b")
    )


def _fits(na: Column, nb: Column, percent: int) -> Column:
    return (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def _central_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """Each class with the most central classes of about its size at each of its prefix shingles."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.1)).cast("int")  # sizes of a band differ by a tenth
    banded = prefixes.select("h", "cls", "n", "centre", band.alias("band"))
    centres = banded.groupBy("h", "band").agg(F.max(F.struct("centre", "cls", "n")).alias("top"))
    nearby = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    return (
        banded.select("h", "cls", "n", nearby)
        .join(centres, ["h", "band"])
        .where((F.col("cls") != F.col("top.cls")) & _fits(F.col("n"), F.col("top.n"), percent))
        .select(
            F.least("cls", "top.cls").alias("a"),
            F.greatest("cls", "top.cls").alias("b"),
            F.when(F.col("cls") < F.col("top.cls"), F.col("n")).otherwise(F.col("top.n")).alias("na"),
            F.when(F.col("cls") < F.col("top.cls"), F.col("top.n")).otherwise(F.col("n")).alias("nb"),
        )
        .distinct()
    )


def _cross_pairs(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All candidates between different components, by length and position.

    The smaller set of a pair needs a shorter prefix: with percent/(100 + percent)
    of both sizes in common, at least that of twice its own. Shingles held by one
    component only are dropped first; then components that meet at a shingle are
    paired before their classes, so classes of one component never meet.

    At its first common shingle a pair's overlap is at most what either has from
    there on, so a partner's size is at most
    room = ((100 + percent) * (m - pos) - percent * n) / percent. A linked pair passes
    this there, so meetings that do not pass are left out. The extremes of a
    component's classes at a shingle tell if any of its pairs can pass.
    """
    owned = prefixes.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").select(
        "h", F.coalesce("label", "cls").alias("label"), "cls", "n", "m", "pos", ((F.col("m") - F.col("pos")) * (100 + percent) - F.col("n") * percent).alias("room")
    )
    owned = cut(owned, "owned")
    mixed = owned.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    meeting = cut(owned.join(mixed.select("h"), "h", "left_semi"), "meeting")
    short = meeting.where(F.col("pos") <= F.col("m") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)))
    extremes = (F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
    small, large = (t.groupBy("h", F.col("label").alias(f"l{k}")).agg(*extremes) for t, k in ((short, 1), (meeting, 2)))
    small, large = (t.select("h", f"l{k}", *[F.col(c).alias(f"{c}{k}") for c in ("least", "most", "room")]) for t, k in ((small, 1), (large, 2)))
    both = small.join(large, "h").where(
        (F.col("l1") != F.col("l2"))
        & (F.col("least1") <= F.col("most2"))
        & (F.col("least1") * percent <= F.col("room2"))
        & (F.col("least2") * percent <= F.col("room1"))
        & (F.col("least2") * percent <= F.col("most1") * 100)
    )
    one = short.select("h", F.col("label").alias("l1"), F.col("cls").alias("c1"), F.col("n").alias("n1"), F.col("room").alias("own1"))
    two = meeting.select("h", F.col("label").alias("l2"), F.col("cls").alias("c2"), F.col("n").alias("n2"), F.col("room").alias("own2"))
    some = two.join(both.select("h", "l1", "l2", "least1", "room1"), ["h", "l2"]).where(
        (F.col("least1") <= F.col("n2")) & (F.col("least1") * percent <= F.col("own2")) & (F.col("n2") * percent <= F.col("room1"))
    )
    enough = (F.col("n1") * percent <= F.col("own2")) & (F.col("n2") * percent <= F.col("own1"))
    first = F.col("c1") < F.col("c2")
    return (
        some.join(one, ["h", "l1"])
        .where((F.col("n1") <= F.col("n2")) & _fits(F.col("n1"), F.col("n2"), percent) & enough)
        .select(
            F.least("c1", "c2").alias("a"),
            F.greatest("c1", "c2").alias("b"),
            F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("na"),
            F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("nb"),
        )
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs`.

    Sets are the distinct runs of `size` words (white-space separated, A-Z folded);
    a shorter text is one run. Two documents are linked when
    100 * intersection >= percent * union. `component_id` is the smallest id that
    links reach.

    Null and empty texts, and texts of white space, have the empty set: size 0,
    linked with nothing, their own component. Rows with equal ids are separate
    rows and each is returned; a null id stays null and its component is the
    smallest non-null id linked to it, if any. Other columns are not read.
    """
    sets = cut(set_sizes(docs, id_col, text_col, size), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    classes = cut(sets.where("cls is not null").groupBy("cls").agg(F.max("n").alias("n"), F.min("doc_id").alias("rep")), "classes")
    fragments = max(16, -(-int(total) // FRAGMENT))
    common = common_counts(docs, id_col, text_col, size, fragments, NAME)
    named = classes.withColumn("name", F.col("cls").bitwiseAND(F.lit(NAME)))
    twins = named.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("name")))
    # The counts of classes that share a name tell nothing of any of them, so these few stay.
    stays = (F.col("_same") > 1) | (F.col("common") >= _need(F.col("n"), percent))
    active = cut(twins.join(common, "name", "left").where(stays).select(*classes.columns), "active")
    ranked = cut(_ranked(class_tokens(docs, id_col, text_col, size, active), percent), "ranked")
    segments = cut(_segments(ranked), "segments")
    prefixes = cut(_prefixes(ranked), "prefixes")

    near = cut(_central_pairs(prefixes, percent), "central")
    links = cut(_links(near, segments, percent), "links")
    labels = components(links)
    rest = _cross_pairs(prefixes, labels, percent).join(near, ["a", "b"], "left_anti").select("a", "b", "na", "nb")
    more = cut(_links(cut(rest, "cross"), segments, percent), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    linked = classes.join(labels.withColumnRenamed("node", "cls"), "cls")
    smallest = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    placed = classes.join(
        linked.select("cls", "label").join(smallest, "label").select("cls", "component_id"), "cls", "left"
    ).select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    return sets.join(placed, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
