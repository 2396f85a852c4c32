"""N-gram Jaccard join by vertical partitioning.

Equal shingle sets are one class, joined by its representative. The global order of
shingles is rare first: those of one class alone, which overlap with nothing and do not
travel, then the others. The others are cut by hash into fragments, at the same places for
all. A class that has a partner at similarity t shares a
shingle of its prefix with it, and all but (1 - t) of its shingles lie in some other class
too. Verification is vertical: a class's segment in each fragment is a row of its own,
partial overlaps are counted fragment by fragment, and summed for each pair.

Candidate pairs are not all pairs of a posting list. First each class is tested with one
pivot of the lists it stands in, the class whose shingles are the most frequent, then
with another; classes that links have joined need no further test among themselves. What
is left are pairs of one list in different components. Two classes that were tested with
the same pivot share at most, in each fragment, the lesser of their overlaps with it, and
of the shingles outside it the lesser number of those that are not unique: pairs that the
sum leaves are tested in full, so no link between components is lost.

No list is one task: pivots come by partial aggregation and meet their list in a join that
AQE can split, and for the last join a list is cut into cells of CELL classes, of which
each two are a key of their own. (The pairs that the last join looks at still grow with
the square of a list whose classes neither link nor differ by the bounds.)

Document frequencies (which only order the shingles) come from packed blobs, one for
each (group of documents, hash range), so frequent shingles are combined per group.

Cases: null texts and texts without words have no shingle and link with nothing; under
five words the whole sequence is the one shingle; repeated shingles count once; rows
with equal sets are linked whatever their doc_id, and a row without one takes its
component's least (null if there is none); an empty table gives none. keep_one chooses
rows, not ids: texts that share a doc_id, or have none, stay if no link joins them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import windows as W
from .components import components
from .decontaminate import lower

SHINGLE = 5
#: Ranges of hashes. Bands of frequency instead, or four ranges in each of four bands, leave six and four times the pairs to test.
FRAGMENTS = 16
#: Neighbouring fragments that are counted as one where only the sum is wanted.
JOINED = 4
PIVOT_ROUNDS = 2
#: Classes of a list's cell in the last join.
CELL = 512
#: Postings of a task of the last join, and the most tasks.
POSTINGS_OF_TASK = 16_384
PARTS_MOST = 100_000


def sets_of(raw: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    raw = lower(raw)
    starts, ends, words = C.words(raw, off)
    if not len(starts):
        return [np.empty(0, np.uint64)] * (len(off) - 1)
    h = C.word_hashes(raw, starts, ends)
    g = C.grams(h, size)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - size + 1]) if b - a >= size else C.grams(h[a:b], b - a) if b > a else g[:0])
    return out


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


SETS = "doc_id long, n_shingles long, node long, h long"


def set_sizes(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes, nodes = [], []
        for _, raw, off in W.blocks(table):
            sets = sets_of(raw, off)
            sizes += [len(s) for s in sets]
            nodes += [class_of(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), batch.column("h")], ["doc_id", "n_shingles", "node", "h"])


def keys_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket in the high half and 32 bits of the place in its hash range in the low half."""
    return (W.bucket_of(h, n_buckets).astype(np.uint64) << np.uint64(32)) | ((h * np.uint64(n_buckets)) >> np.uint64(32))


def _representatives(docs: pa.Table, said: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    """(node, doc_id, shingles) of the classes whose representative is in the group, each once."""
    wanted = {(d, n) for d, n in zip(said["doc_id"].to_pylist(), said["node"].to_pylist(), strict=True) if n is not None}
    ids = {d for d, _ in wanted}
    mine = docs.filter(pa.array([d in ids for d in docs["doc_id"].to_pylist()], pa.bool_()))
    out = []
    for block_ids, raw, off in W.blocks(mine):
        for d, s in zip(block_ids.tolist(), sets_of(raw, off), strict=True):
            if len(s) and (d, n := class_of(s)) in wanted:
                wanted.discard((d, n))
                out.append((n, d, s))
    return sorted(out, key=lambda x: x[0])


def _group_keys(found: list[tuple[int, int, np.ndarray]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([keys_of(s, n_buckets) for _, _, s in found])
    return np.unique(keys, return_counts=True)


def frequencies_of_group(n_buckets: int):
    def ask(key: tuple, docs: pa.Table, said: pa.Table) -> pa.Table:
        found = _representatives(docs, said)
        if not found:
            return W._rows(g=[], bucket=[], blob=[])
        keys, counts = _group_keys(found, n_buckets)
        low, few = keys.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        cuts = np.searchsorted(keys >> np.uint64(32), np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        return W._rows(g=[key[0].as_py()] * len(full), bucket=full, blob=[low[cuts[b] : cuts[b + 1]].tobytes() + few[cuts[b] : cuts[b + 1]].tobytes() for b in full])

    return ask


SAID = "g int, bucket int, blob binary, doc_id long, node long"


def ranks_of_bucket(key: tuple, table: pa.Table) -> pa.Table:
    """For each group, in the order of its keys: 0 if one class holds the shingle, else a rank that grows with the frequency."""
    blobs = table["blob"].to_pylist()
    sizes = [len(b) // 5 for b in blobs]
    keys = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in zip(blobs, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(b, np.uint8, n, 4 * n) for b, n in zip(blobs, sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    total = np.add.reduceat(counts[order].astype(np.int64), begin)
    rank = np.where(total == 1, 0, np.ceil(4 * np.log2(total))).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(rank, np.diff(np.append(begin, len(k))))
    ends = np.cumsum(sizes)
    n = len(blobs)
    return pa.table({"g": table["g"], "bucket": table["bucket"], "blob": pa.array([out[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)], pa.binary()), "doc_id": pa.nulls(n, pa.int64()), "node": pa.nulls(n, pa.int64())})


CANDIDATES = "node long, doc_id long, n long, u long, central double, prefix array<long>, fragments array<array<long>>"


def candidates_of_group(n_buckets: int, num: int, den: int):
    """Classes that may have a partner, with their prefix and fragments."""

    def ask(key: tuple, docs: pa.Table, said: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        found = _representatives(docs, said)
        if found:
            keys, _ = _group_keys(found, n_buckets)
            blobs = {b: x for b, x in zip(said["bucket"].to_pylist(), said["blob"].to_pylist(), strict=True) if x is not None}
            rank = np.frombuffer(b"".join(blobs[b] for b in sorted(blobs)), np.uint8)
            for node, doc_id, s in found:
                q = rank[np.searchsorted(keys, keys_of(s, n_buckets))]
                n, u = len(s), int((q == 0).sum())
                if den * (n - u) < num * n:
                    continue
                ordered = s[np.lexsort((s, q))].view(np.int64)
                prefix = ordered[: n - -(-num * n // den) + 1]
                at = np.where(q == 0, -1, W.bucket_of(s, FRAGMENTS))  # held by one class: in no fragment
                by = s[np.argsort(at, kind="stable")].view(np.int64)
                cuts = np.append(np.searchsorted(np.sort(at), np.arange(FRAGMENTS)), n)
                rows.append((node, doc_id, n, u, float(q.mean()), prefix.tolist(), [by[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]))
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))]
        return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("node", "doc_id", "n", "u", "central", "prefix", "fragments"))})

    return ask


PARTS = [f"p{i}" for i in range(FRAGMENTS)]


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, shared, p0, p1, ...): partial overlaps of each fragment, and their sum for each pair."""
    left = segments.select(F.col("node").alias("a"), "f", F.col("seg").alias("left"))
    right = segments.select(F.col("node").alias("b"), "f", F.col("seg").alias("right"))
    part = pairs.select("a", "b").join(left, "a").join(right, ["b", "f"]).select("a", "b", "f", F.size(F.array_intersect("left", "right")).alias("part"))
    return part.groupBy("a", "b").agg(F.sum("part").alias("shared"), *[F.sum(F.when(F.col("f") == i, F.col("part")).otherwise(0)).alias(c) for i, c in enumerate(PARTS)])


def may_link(num: int, den: int, a: str = "", b: str = "p_"):
    """The greatest overlap that sizes and unique shingles leave reaches the threshold."""
    need = F.lit(num) * (F.col(f"{a}n") + F.col(f"{b}n"))
    most = F.least(F.col(f"{a}n") - F.col(f"{a}u"), F.col(f"{b}n") - F.col(f"{b}u"))
    return (num + den) * most >= need


def may_link_by_fragments(num: int, den: int, a: str = "", b: str = "p_") -> Column:
    """Unless both were tested with one pivot and what they share with it, by fragment, is too little."""
    inside = sum((F.least(F.col(f"{a}{c}"), F.col(f"{b}{c}")) for c in PARTS), F.lit(0))
    most = inside + F.least(F.col(f"{a}outside"), F.col(f"{b}outside"))
    enough = (num + den) * most >= F.lit(num) * (F.col(f"{a}n") + F.col(f"{b}n"))
    return F.coalesce((F.col(f"{a}pivot") != F.col(f"{b}pivot")) | enough, F.lit(True))


def links_between(found: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) links of candidate classes, enough for the right components."""
    fine = found.select("node", F.posexplode("fragments").alias("f", "seg")).where(F.size("seg") > 0)
    wide = F.array(*[F.flatten(F.slice("fragments", i + 1, JOINED)) for i in range(0, FRAGMENTS, JOINED)])
    coarse = found.select("node", F.posexplode(wide).alias("f", "seg")).where(F.size("seg") > 0)
    sizes = found.select("node", "n", "u")
    postings = C.materialise(found.select("node", "central", "n", "u", F.explode("prefix").alias("s")))
    # what is aggregated by list is written first, so that its join with the list has nothing but exchanges below and can be split
    lists = C.materialise(postings.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s"))
    postings = C.materialise(postings.join(lists, "s"))

    def linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
        n_a, n_b = sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b"))
        shared = overlaps(pairs, segments).join(n_a, "a").join(n_b, "b")
        return C.materialise(shared.withColumn("link", (num + den) * F.col("shared") >= num * (F.col("n_a") + F.col("n_b"))).drop("n_a", "n_b"))

    def between_components(tested: DataFrame) -> DataFrame:
        """Postings whose list reaches into several components."""
        at = C.materialise(postings.join(components(tested.where("link")), "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        open_ = C.materialise(at.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("s"))
        return C.materialise(at.join(open_, "s"))

    def unordered(tested: DataFrame) -> DataFrame:
        return tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    profile = tested = None
    at = postings.withColumn("comp", F.col("node"))
    for round_ in range(PIVOT_ROUNDS):
        first = -F.col("central") if round_ == 0 else F.xxhash64("node", F.lit(round_))
        pivots = at.groupBy("s").agg(F.min(F.struct(first, "node", "comp", "n", "u")).alias("p"))
        pivots = C.materialise(pivots.select("s", F.col("p.node").alias("p"), F.col("p.comp").alias("p_comp"), F.col("p.n").alias("p_n"), F.col("p.u").alias("p_u")))
        pairs = at.join(pivots, "s").where((F.col("comp") != F.col("p_comp")) & may_link(num, den))
        best = pairs.groupBy("node", "p").agg(F.count("*").alias("c")).groupBy("node").agg(F.max_by("p", F.struct("c", "p")).alias("p"))
        best = best.select(F.col("node").alias("a"), F.col("p").alias("b"))
        if tested is None:
            more = profile = linked(best, fine)
        else:
            more = linked(unordered(best).distinct().join(unordered(tested), ["a", "b"], "left_anti"), coarse)
        tested = more if tested is None else tested.union(more)
        if not more.isEmpty():  # else no list is joined yet, and the pairs are left to the next round or the last join
            at = between_components(tested)
    near = profile.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "shared", *PARTS)
    cells = C.materialise(at.groupBy("s").agg(F.ceil(F.count("*") / CELL).alias("cells")).where("cells > 1"))
    at = at.drop("central").join(cells, "s", "left").withColumn("cell", F.pmod(F.xxhash64("node"), F.coalesce("cells", F.lit(1))))
    at = C.materialise(at.join(near, "node", "left").withColumn("outside", F.col("n") - F.col("shared") - F.col("u")).drop("shared"))
    # a key for each two cells of a list: the lower cell of the pair on the left
    last = F.coalesce("cells", F.lit(1)) - 1
    lower = at.withColumns({"i": F.col("cell"), "j": F.explode(F.sequence(F.col("cell"), last))}).drop("cells", "cell")
    upper = at.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("cell"))), "j": F.col("cell")}).drop("cells", "cell")
    keys = ["s", "i", "j"]
    upper = upper.select(*keys, *[F.col(c).alias(f"p_{c}") for c in upper.columns if c not in keys])
    parts = max(1, min(PARTS_MOST, at.count() // POSTINGS_OF_TASK))  # a given number: few bytes can be many pairs
    met = lower.repartition(parts, *keys).join(upper.repartition(parts, *keys), keys).where((F.col("comp") != F.col("p_comp")) & ((F.col("i") < F.col("j")) | (F.col("node") < F.col("p_node"))))
    rest = met.where(may_link(num, den) & may_link_by_fragments(num, den))
    rest = rest.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
    more = linked(rest.join(unordered(tested), ["a", "b"], "left_anti"), coarse)
    return tested.union(more).where("link").select("a", "b")


def _components(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n_shingles, node and text hash of each row; node and doc_id of each class; node and comp of each class."""
    docs = docs.select("doc_id", "text")
    total = C.text_bytes(docs)
    n_groups = C.group_count(total)
    n_buckets = W.bucket_count(total)  # about a shingle of four bytes for each four bytes of text
    sets = C.materialise(docs.withColumn("h", F.xxhash64("text")).mapInArrow(set_sizes, SETS))
    classes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    group = C.group_of("doc_id", n_groups).alias("g")
    own = docs.select(group, "doc_id", "text").groupBy("g")
    wanted = C.materialise(classes.select(group, "doc_id", "node"))
    asked = own.cogroup(wanted.groupBy("g")).applyInArrow(frequencies_of_group(n_buckets), W.ASKED)
    ranks = asked.groupBy("bucket").applyInArrow(ranks_of_bucket, SAID)
    said = ranks.unionByName(wanted, allowMissingColumns=True).select("g", "bucket", "blob", "doc_id", "node")
    found = C.materialise(own.cogroup(said.groupBy("g")).applyInArrow(candidates_of_group(n_buckets, num, den), CANDIDATES))
    links = C.materialise(links_between(found, num, den))
    label = classes.select("node").join(components(links), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    return sets, classes, label


def join_components(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id of each document of (doc_id, text), at Jaccard num / den or more."""
    sets, classes, label = _components(docs, num, den)
    # least doc_id of each component, over its classes
    label = label.join(classes, "node")
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = label.join(least, "comp").select("node", "component_id")
    return sets.join(by_class, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: A row by its doc_id and text: what says whether it has a doc_id, the doc_id, the text's hash.
ROW = ["no_id", "id", "h"]


def keep_one(docs: DataFrame, num: int = 3, den: int = 4) -> DataFrame:
    """One row of each component, all columns: the least doc_id, rows without one last, then the least text hash.

    Of the texts without words, which link with nothing, one row of each doc_id and text
    stays, and every row without a doc_id.
    """
    no_id, id_ = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")
    sets, _, label = _components(docs, num, den)
    rows = sets.select(no_id, id_, "h", "node")
    first = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(*ROW)).alias("row"))
    first = first.join(label, "node").groupBy("comp").agg(F.min("row").alias("row")).select("row.*")
    kept = first.unionByName(rows.where("node is null and not no_id").select(*ROW).distinct())
    names = [f"_keep_one_{c}" for c in ROW]
    loose = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(C.WORD), F.lit(False))
    keyed = docs.where(~loose).select("*", *[c.alias(n) for c, n in zip((no_id, id_, F.xxhash64("text")), names, strict=True)])
    same = keyed.join(kept.toDF(*names), names, "left_semi").dropDuplicates(names)
    return same.select(*docs.columns).unionByName(docs.where(loose))
