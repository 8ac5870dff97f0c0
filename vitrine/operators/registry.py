"""Registry construction and upkeep: hashes, lineage, identity, links, upserts and latest-row views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import pep503, successor_keys, tail_name
from vitrine.operators.digests import sha256_of_lines


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that must end in a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def content_hashes(files: DataFrame) -> DataFrame:
    """revision, n_files and the SHA-256 over its sorted path TAB hash lines. Lines stream in order, so that a revision's
    size doesn't bound memory; one without any whole line has the hash of nothing."""
    whole = F.col("path").isNotNull() & F.col("content_hash").isNotNull()
    line = F.when(whole, F.concat(F.encode("path", "utf-8"), F.lit(b"\t"), F.encode("content_hash", "utf-8"), F.lit(b"\n")))
    # the order of the whole lines, as of the array that was sorted before
    return sha256_of_lines(files.select("revision", line.alias("line"), line.alias("place")), "revision", "n_files", "content_hash", b"")


def version_keys(revisions: DataFrame) -> DataFrame:
    """revision and version_key; equal content shares a key."""
    return revisions.select("revision", F.concat(F.lit("content:"), F.left("content_hash", F.lit(16))).alias("version_key"))


def promotable(revisions: DataFrame, binding: DataFrame) -> DataFrame:
    """Revisions that are snapshotted, hashed and not bound yet."""
    ready = revisions.where("snapshot_status = 'snapshotted' and content_hash is not null")
    return ready.join(binding.select("revision_id").distinct(), "revision_id", "left_anti")


def supersession(lineage: DataFrame) -> DataFrame:
    """lineage (capability_id, asset_id, version_id, made) with superseded_by, the next version of the same asset."""
    w = Window.partitionBy("capability_id", "asset_id").orderBy("made", "version_id")
    return lineage.withColumn("superseded_by", F.lead("version_id").over(w))


def newer_revisions(binding: DataFrame, revision: DataFrame) -> DataFrame:
    """version_id, bound_at and newest snapshotted revision of the asset where it is newer: a window maximum, no range join."""
    newest = revision.where("snapshot_status = 'snapshotted'").groupBy("asset_id").agg(F.max("identified_at").alias("newest"))
    bound = binding.join(revision.select("revision_id", "asset_id", "identified_at"), "revision_id")
    bound = bound.groupBy("version_id").agg(F.max_by("asset_id", "identified_at").alias("asset_id"), F.max("identified_at").alias("bound_at"))
    return bound.join(newest, "asset_id").where("newest > bound_at").select("version_id", "bound_at", "newest")


def identities(manifests: DataFrame) -> DataFrame:
    """manifests (asset, provider, path, name) to one normalized_key for each asset: the shallowest pyproject.toml with a
    name, else package.json, else the source itself."""
    file = F.element_at(F.split("path", "/"), -1)
    kind = F.when(file == "pyproject.toml", 0).when(file == "package.json", 1).otherwise(2)
    named = manifests.withColumn("_kind", F.when(F.trim(F.coalesce("name", F.lit(""))) == "", 2).otherwise(kind)).withColumn("_depth", F.size(F.split("path", "/")))
    best = latest(named, ["asset"], F.asc("_kind"), F.asc("_depth"), F.asc("path"))
    key = F.when(F.col("_kind") == 0, F.concat(F.lit("pypi:"), pep503(F.col("name")))).when(F.col("_kind") == 1, F.concat(F.lit("npm:"), F.lower(F.trim("name"))))
    return best.select("asset", F.coalesce(key, F.concat(F.lit("source:"), "provider", F.lit(":"), F.lower("asset"))).alias("normalized_key"))


#: Members of a name on one side of a block of pairs, about, and the most blocks on one side: a member stands in the join once
#: for each block of the other side, so its rows don't grow with the size of its name.
PAIR_BLOCK, MOST_BLOCKS = 1000, 32


def _tailed(capability: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """id, tail and side (library or repo) of what may be linked."""
    named = capability.select("id", tail_name(F.col("normalized_key")).alias("tail"), F.col("component_kind").alias("side"), *carried)
    return named.where("tail is not null and side in ('library', 'repo')")


def _cuts(members: DataFrame, block: int, *more: Column, size: Column | None = None) -> DataFrame:
    """tail and into how many blocks either side of it is cut; size is how many a row stands for, if not for one."""
    count = lambda s: F.count_if(F.col("side") == s) if size is None else F.sum(F.when(F.col("side") == s, size))
    blocks = lambda s: F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(1), F.ceil(count(s) / block))).cast("int")
    return members.groupBy("tail").agg(blocks("library").alias("of_library"), blocks("repo").alias("of_repo"), *more)


def _in_blocks(rows: DataFrame, side: str, *carried: str) -> DataFrame:
    """The members of one side, each in its own block, once for every block of the other side."""
    own = F.pmod(F.xxhash64("id"), F.col(f"of_{side}")).cast("int")
    every = lambda s: F.explode(F.sequence(F.lit(0), F.col(f"of_{s}") - 1))
    lb, rb = (own, every("repo")) if side == "library" else (every("library"), own)
    return rows.where(F.col("side") == side).select("tail", F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in carried), lb.alias("lb"), rb.alias("rb"))


def _met_by(library: DataFrame, repo: DataFrame) -> DataFrame:
    """Never by a broadcast: what a plan knows of the rows is their size before they are set in blocks."""
    return library.join(repo.hint("merge"), ["tail", "lb", "rb"]).drop("lb", "rb")


def link_candidates(capability: DataFrame, asked: DataFrame | None = None, carried: tuple[str, ...] = (), block: int = PAIR_BLOCK) -> DataFrame:
    """(tail, library_id, repo_id) with one tail name, without those that were asked before; a hot name is cut into blocks as in
    new_link_candidates. Columns carried are there for either side, as library_ and repo_."""
    members = _tailed(capability, carried)
    rows = members.join(_cuts(members, block), "tail")
    pairs = _met_by(_in_blocks(rows, "library", *carried), _in_blocks(rows, "repo", *carried))
    return pairs if asked is None else pairs.join(asked, ["library_id", "repo_id"], "left_anti")


#: Components in a group of such as are alike, about: a pair of groups is one row of the join, and as many pairs as that squared.
ALIKE = 128


def alike_groups(capability: DataFrame, carried: str) -> DataFrame:
    """tail, side, the column carried (not null) and id, an array of about ALIKE components of one tail name that are alike in it."""
    members, alike = _tailed(capability, (carried,)), ["tail", "side", carried]
    parts = members.groupBy(*alike).agg(F.ceil(F.count("*") / ALIKE).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    return members.join(parts, alike).groupBy(*alike, part.alias("part")).agg(F.collect_list("id").alias("id")).drop("part")


def alike_link_candidates(groups: DataFrame, carried: str, block: int = PAIR_BLOCK) -> DataFrame:
    """The pairs of link_candidates by pairs of alike_groups: arrays library_id and repo_id, which both exploded give the pairs, and
    carried for either side. What follows from it is computed once for all pairs of a row. Hot names are cut into blocks as above."""
    rows = groups.join(_cuts(groups, block, size=F.size("id")), "tail")
    # few bytes, but very many pairs for each row: not to be gathered into few tasks for their size
    spark = groups.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    library, repo = (_in_blocks(rows, side, carried).repartition(tasks, "tail", "lb", "rb") for side in ("library", "repo"))
    return _met_by(library, repo)


def new_link_candidates(capability: DataFrame, met: DataFrame | None = None, block: int = PAIR_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs library_id, repo_id with one tail name of which at least one member is new; the new members id, tail, side, to be
    added to the ledger met). Members that the ledger holds are old: they have met each other, and don't meet again.

    A name with more than `block` libraries or repos is cut into blocks on either side, and each pair of blocks is a join key
    of its own, so no task has more than about block x block pairs to make, or a thousandth of a name's where it has more than
    MOST_BLOCKS blocks."""
    members = _tailed(capability)
    if met is None:
        members = members.withColumn("new", F.lit(True))
    else:
        members = members.join(met.select("id", "tail", "side").distinct().withColumn("_met", F.lit(True)), ["id", "tail", "side"], "left").withColumn("new", F.col("_met").isNull()).drop("_met")
    rows = members.join(_cuts(members, block, F.bool_or("new").alias("changed")).where("changed"), "tail")
    lib, repo = _in_blocks(rows, "library", "new"), _in_blocks(rows, "repo", "new")
    pairs = _met_by(lib.where("library_new"), repo).unionByName(_met_by(lib.where("not library_new"), repo.where("repo_new")))
    return pairs.select("library_id", "repo_id"), members.where("new").select("id", "tail", "side")


def resolve_successors(names: DataFrame, capability: DataFrame) -> DataFrame:
    """names (ref, name) to the registered component with the earliest key of the name, the smallest id among equal keys."""
    keys = names.select("ref", F.posexplode(successor_keys(F.col("name"))).alias("pos", "normalized_key"))
    least = capability.groupBy("normalized_key").agg(F.min("id").alias("id"))  # a key may have very many components
    found = keys.join(least, "normalized_key")
    return found.groupBy("ref").agg(F.min_by("id", F.struct("pos", "id")).alias("successor_id"))


def symmetric(links: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Both directions of same-component links, without the negative answers that are stored as such links."""
    kept = links.where((F.col("confidence") >= threshold) & ~F.startswith("rationale", F.lit("NOT_SAME:"))).select("a", "b")
    return kept.unionByName(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))


def upsert(target: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table after the batch: new rows added, columns of known rows replaced where the batch has a value, with outcome
    new, updated, unchanged or kept (not in the batch)."""
    t = target.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns), F.lit(True).alias("_old"))
    b = batch.select(key, *columns, F.lit(True).alias("_new"))
    merged = t.join(b, key, "full_outer")
    after = {c: F.coalesce(F.col(c), F.col(f"_o_{c}")) for c in columns}
    same = F.lit(True)
    for c in columns:
        same = same & after[c].eqNullSafe(F.col(f"_o_{c}"))
    outcome = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("updated")
    return merged.select(key, *(after[c].alias(c) for c in columns), outcome.alias("outcome"))


def as_states(batch: DataFrame, key: str, columns: list[str], sequence: list[str]) -> DataFrame:
    """A row for each key of batch, with a struct (sequence, value) in each column: its non-null value of the greatest
    sequence, the greatest of several values there, null where there is none. Rows of a hot key are combined before the shuffle."""
    state = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.struct(*sequence).alias("sequence"), F.col(c).alias("value"))))
    return batch.groupBy(key).agg(*(state(c).alias(c) for c in columns))


def merge_states(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The states of both, by the greater sequence. Neither the order of merges nor a repeated one changes the result."""
    both = old.select(key, *columns).unionByName(new.select(key, *columns))
    return both.groupBy(key).agg(*(F.max(c).alias(c) for c in columns))


def state_values(states: DataFrame, key: str) -> DataFrame:
    return states.select(key, *(F.col(f"`{c}`.value").alias(c) for c in states.columns if c != key))


def state_outcomes(old: DataFrame | None, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and outcome of each key in new: new, updated, or unchanged where no value differs after the merge."""
    if old is None:
        return new.select(key, F.lit("new").alias("outcome"))
    before = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in columns), F.lit(True).alias("_old"))
    rows = new.join(before, key, "left")
    differs = F.lit(False)
    for c in columns:
        after = F.greatest(c, f"_o_{c}")  # of structs, by sequence; nulls are skipped
        differs = differs | ~after["value"].eqNullSafe(F.col(f"_o_{c}.value"))
    return rows.select(key, F.when(F.col("_old").isNull(), "new").when(differs, "updated").otherwise("unchanged").alias("outcome"))


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    names = ("new", "updated", "unchanged", "deprecated", "error")
    return outcomes.groupBy(*by).agg(*(F.count_if(F.col("outcome") == n).alias(f"n_{n}") for n in names))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is true where the row is right, null counts as broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows of child whose reference doesn't resolve."""
    return child.join(parent.select(on).distinct(), on, "left_anti")
