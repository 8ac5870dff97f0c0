"""SimHash near-duplicates at a similarity: sets of five-word shingles with a Jaccard similarity of at least 0.8.

Two texts at 0.8 differ in a SimHash bit with probability 0.15 to 0.19, so a search needs a radius of RADIUS = 28 of 64
bits to lose fewer than one pair in a million; blocks of the bits can't shard such a search, as they do for two bits. Shards
are the buckets of BANDS fingerprints of ROWS permuted minima each: texts at similarity s share a bucket of a band with
probability s ** ROWS, so a pair at 0.8 shares none with 3e-6. Within a bucket BK-trees over the SimHash fingerprints
give the candidates; those that agree in fewer than LEAST of the minima are dropped (a pair at 0.8 with 5e-6), and all
others are confirmed on the texts themselves.

Texts with the same set are one node. Most nodes join a group by one comparison: with the node of their buckets that
shares its own buckets with the most others, such as the original of many copies. What that leaves apart is searched in
full: the nodes outside the component of a bucket's best known node make trees of about TREE nodes each, and every tree
is sent to all groups of about PROBES nodes of the bucket (a bounded broadcast), so no pair of different components is
skipped. A first search gives each of those nodes its likeliest partner; where candidates of other components remain, a
second one carries the texts and gives the links it confirms, one for each component. Neither gives out all pairs of a
group. Components come from star contraction.

Defined cases: words are split and lower-cased (A-Z) as in simhash; a text under five words is one shingle, a null or
empty one the empty shingle; each row is a document of its own, also where doc_ids repeat or are null; the first of a
group is the row with the least doc_id, nulls last; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import with_rows, written
from vitrine.llm.simhash import BKTree, components, majority

WORDS = 5
#: Similarity 4 / 5, compared in integers.
SHARE = (4, 5)
RADIUS = 28
BANDS, ROWS = 32, 5
#: Of the BANDS * ROWS minima.
LEAST = 105
TREE, PROBES = 256, 4096
CHUNK = 512
#: The permutations are h -> odd * h + shift over 64 bits.
_ODD, _SHIFT = (np.random.Generator(np.random.PCG64(s)).integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64, False) for s in (11, 12))
_ODD |= np.uint64(1)


def shingles(text: str | None) -> set[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < WORDS:
        return {b" ".join(words)}
    return set(map(b" ".join, zip(*(words[i:] for i in range(WORDS)))))


def sketch(text: str | None) -> tuple[bytes, int, int, np.ndarray, bytes]:
    """Digest of the set of shingles, their number, their SimHash (signed), the bands' fingerprints, and 16 bits of each minimum."""
    found = shingles(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    h.sort()
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(h), CHUNK):
        np.minimum(least, (h[at : at + CHUNK] * _ODD + _SHIFT).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    bands = np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)), np.uint64, BANDS)
    return xxhash.xxh3_128_digest(h.tobytes()), len(found), int(np.uint64(majority(h)).view(np.int64)), bands.view(np.int64), least.astype(np.uint16).tobytes()


def near(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return SHARE[1] * both >= SHARE[0] * (len(a) + len(b) - both)


def _sketches(batches):
    import pandas as pd

    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at : at + 1000]
            rows = [(d, *sketch(t)) for d, t in zip(part["row"], part["t"])]
            yield pd.DataFrame(rows, columns=["row", "digest", "n", "fp", "bands", "minima"])


def _confirmed(batches):
    import pandas as pd

    last, found = None, None
    for pdf in batches:
        out = []
        for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
            if found is None or last != ta:
                last, found = ta, shingles(ta)
            if near(found, shingles(tb)):
                out.append((a, b))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def agreeing(a: bytes, b: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))


def _compared(batches):
    """a, b and agree of pairs that agree in LEAST minima at least."""
    for pdf in batches:
        agree = [agreeing(x, y) for x, y in zip(pdf["ma"], pdf["mb"])]
        pdf = pdf[["a", "b"]].assign(agree=agree)
        yield pdf[pdf["agree"] >= LEAST]


class Trees:
    """The BK-trees of groups whose rows begin with the nodes of the tree (probe false), followed by the nodes to look up.
    Each node is (name, n, component, minima, extra)."""

    def __init__(self):
        self.group, self.tree, self.held = None, BKTree(), []

    def candidates(self, batch):
        """(node, probe) pairs, of different components, that may be near; batch has lists by column."""
        extras = batch.get("t") or [None] * len(batch["group"])
        for g, probe, name, n, fp, component, minima, extra in zip(*(batch[c] for c in ("group", "probe", "name", "n", "fp", "component", "minima")), extras):
            if g != self.group:
                self.group, self.tree, self.held = g, BKTree(), []
            node = [name, n, component, np.frombuffer(minima, np.uint16), extra]
            if not probe:
                at = self.tree.add(fp % (1 << 64))
                if at == len(self.held):
                    self.held.append([])
                self.held[at].append(node)
                continue
            for at in self.tree.near(fp % (1 << 64), RADIUS):
                for other in self.held[at]:
                    if other[2] != component and SHARE[1] * min(n, other[1]) >= SHARE[0] * max(n, other[1]):
                        agree = int(np.count_nonzero(node[3] == other[3]))
                        if agree >= LEAST:
                            yield other, node, agree


def _likeliest(batches):
    """a, b, agree, lo, hi: for the nodes a of trees their likeliest candidate b in a group, and the least and the largest of
    the components of all."""
    import pandas as pd

    trees, group, best = Trees(), None, {}

    def frame():
        rows = [(a, -b, agree, lo, hi) for a, ((agree, b), lo, hi) in best.items()]
        return pd.DataFrame(rows, columns=["a", "b", "agree", "lo", "hi"])

    for pdf in batches:
        for other, node, agree in trees.candidates({c: pdf[c].tolist() for c in pdf.columns}):
            if trees.group != group:
                if best:
                    yield frame()
                group, best = trees.group, {}
            of = node[2]
            known = best.get(other[0], ((-1, 0), of, of))  # of equal agreement, the least name
            best[other[0]] = (max(known[0], (agree, -node[0])), min(known[1], of), max(known[2], of))
    if best:
        yield frame()


def _hashes(text) -> np.ndarray:
    found = shingles(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    h.sort()
    return h


def _links(batches):
    """Links (a, b) between the trees' nodes a and near nodes, one for each component, by the hashes of all their shingles."""
    import pandas as pd

    trees, group, done = Trees(), None, set()
    for pdf in batches:
        out = []
        for other, node, _ in trees.candidates({c: pdf[c].tolist() for c in pdf.columns}):
            if trees.group != group:
                group, done = trees.group, set()
            if (other[0], node[2]) in done:
                continue
            for x in (other, node):
                if not isinstance(x[4], np.ndarray):
                    x[4] = _hashes(x[4])
            both = len(np.intersect1d(other[4], node[4], assume_unique=True))
            if SHARE[1] * both >= SHARE[0] * (len(other[4]) + len(node[4]) - both):
                done.add((other[0], node[2]))
                out.append((other[0], node[0]))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def sent(nodes: DataFrame, *more: str) -> DataFrame:
    """Groups of a tree's nodes and nodes to look up, in order, of nodes (key, name, n, fp, component, minima, in_tree): those
    with in_tree make trees, and all are looked up in every tree of their key."""
    counts = nodes.groupBy("key").agg(F.count_if("in_tree").alias("outside"), F.count("*").alias("size"))
    nodes = nodes.join(counts, "key")
    trees, groups = F.ceil(F.col("outside") / TREE).cast("int"), F.ceil(F.col("size") / PROBES).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("name", F.lit(seed)), n).cast("int")
    in_tree = nodes.where("in_tree").select("*", own(trees, 1).alias("tree"), every(groups).alias("part"), F.lit(False).alias("probe"))
    probes = nodes.where("outside > 0").select("*", every(trees).alias("tree"), own(groups, 2).alias("part"), F.lit(True).alias("probe"))
    rows = in_tree.unionByName(probes).select(F.xxhash64("key", "tree", "part").alias("group"), "probe", "name", "n", "fp", "component", "minima", *more)
    return rows.repartition("group").sortWithinPartitions("group", "probe")


def apart(placed: DataFrame, minima: DataFrame) -> DataFrame:
    """The nodes of buckets that hold several components, with in_tree for those outside the bucket's main component; placed
    has key, name, n, fp, fame, component, and minima a row (name, minima) for each node."""
    home = F.max_by("component", F.struct("fame", -F.col("name")))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), home.alias("home")).where("lo < hi")
    nodes = placed.join(open_.select("key", "home"), "key").withColumn("in_tree", F.col("component") != F.col("home"))
    return written(nodes.select("key", "name", "n", "fp", "component", "in_tree").join(minima, "name"), "apart")


def near_rows(rows: DataFrame) -> DataFrame:
    """row and component, the least row of its group, for each of rows (row, t)."""
    schema = "row long, digest binary, n long, fp long, bands array<long>, minima binary"
    marked = written(rows.select("row", "t").mapInPandas(_sketches, schema), "sketches")
    classes = marked.groupBy("digest").agg(F.min("row").alias("name"))

    # the buckets of each band that hold more than one node
    nodes = marked.join(classes.select(F.col("name").alias("row")), "row", "left_semi").withColumnRenamed("row", "name")
    hits = nodes.select("name", "n", "fp", F.explode("bands").alias("key"))
    sizes = hits.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(hits.join(sizes, "key"), "buckets")
    fame = members.groupBy("name").agg(F.sum("size").alias("fame"))
    members = members.drop("size").join(fame, "name")
    minima = marked.select(F.col("row").alias("name"), "minima")

    def confirmed(pairs):
        """The pairs (a, b) whose texts are near."""
        names = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        texts = rows.select("row", "t").join(names, "row", "left_semi")
        pairs = pairs.select("a", "b").join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
        return written(pairs.select("a", "b", "ta", "tb").mapInPandas(_confirmed, "a long, b long"), "links")

    def placed(links):
        return members.join(components(links), "name", "left").withColumn("component", F.coalesce("component", "name"))

    def likeliest(pairs, of):
        """One pair for each name in column of: that which agrees most."""
        return pairs.groupBy(of).agg(F.max_by(F.struct("a", "b"), F.struct("agree", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()

    # with the node of each bucket that shares its buckets with the most others
    pivots = members.groupBy("key").agg(F.max_by(F.struct("name", "n", "fp"), F.struct("fame", -F.col("name"))).alias("pivot"))
    small, large = F.least("n", "pivot.n"), F.greatest("n", "pivot.n")
    near_pivot = (F.col("name") != F.col("pivot.name")) & (SHARE[1] * small >= SHARE[0] * large) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot.fp"))) <= RADIUS)
    pairs = members.join(pivots, "key").where(near_pivot).select(F.col("pivot.name").alias("a"), F.col("name").alias("b")).distinct()
    pairs = pairs.join(minima.toDF("b", "mb"), "b").join(minima.toDF("a", "ma"), "a").select("a", "b", "ma", "mb")
    links = confirmed(written(likeliest(pairs.mapInPandas(_compared, "a long, b long, agree int"), "b"), "first"))

    # what that left apart: the likeliest partner of each node first
    nodes = apart(placed(links), minima)
    found = written(sent(nodes).mapInPandas(_likeliest, "a long, b long, agree int, lo long, hi long"), "likeliest")
    found = found.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    links = links.unionByName(confirmed(found.select("a", "b").distinct()))
    joined = written(components(links), "joined")

    # then, where candidates of other components remain, all of them, with their texts
    at = lambda c: joined.toDF(c, f"c{c}")
    labels = found.join(at("a"), "a", "left").join(at("lo"), "lo", "left")
    own, theirs = F.coalesce("ca", "a"), F.coalesce("clo", "lo")
    open_ = labels.where((F.col("lo") != F.col("hi")) | (own != theirs)).select(F.col("a").alias("name"), F.lit(True).alias("open")).distinct()
    nodes = nodes.join(open_, "name", "left").withColumn("in_tree", F.col("open").isNotNull())
    keys = nodes.where("in_tree").select("key").distinct()
    nodes = nodes.join(keys, "key", "left_semi").drop("component").join(joined, "name", "left").withColumn("component", F.coalesce("component", "name"))
    nodes = nodes.join(rows.select(F.col("row").alias("name"), "t"), "name")
    more = written(sent(nodes, "t").mapInPandas(_links, "a long, b long"), "links")
    joined = components(links.unionByName(more))

    names = classes.join(joined, "name", "left").select("digest", F.coalesce("component", "name").alias("component"))
    return marked.select("row", "digest").join(names, "digest").select("row", "component")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, component_id (the doc_id of its group's first row) and first (whether it is that row) for each row of docs."""
    rows, _ = with_rows(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")))
    found = near_rows(rows).join(rows.select("row", "doc_id"), "row")
    firsts = found.where("row = component").select("component", F.col("doc_id").alias("component_id"))
    return found.join(firsts, "component").select("doc_id", "component_id", (F.col("row") == F.col("component")).alias("first"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The first row of each group, with the columns of docs."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows, _ = with_rows(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"), whole))
    stay = near_rows(rows).where("row = component").select("row")
    return rows.join(stay, "row", "left_semi").select("whole.*")
