"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.bpe import encode
from sievework.operators.hash_rank import hash_rank
from sievework.session import stage


class Node:
    """A node of the weight tree; a leaf has a capacity."""

    def __init__(self, weight: float, capacity: float = 0.0):
        self.weight, self.own, self.children = weight, capacity, {}

    def child(self, name: object, weight: float) -> Node:
        return self.children.setdefault(name, Node(weight))

    def capacity(self) -> float:
        return sum(c.capacity() for c in self.children.values()) if self.children else self.own


def distribute(node: Node, amount: float, path: tuple = ()) -> dict[tuple, float]:
    """Budget per leaf. Each node passes its amount on by its children's weights; what a child cannot hold goes to its
    siblings by their weights, and only what they cannot hold either comes back to the level above."""
    if not node.children:
        return {path: min(amount, node.own)}
    given = dict.fromkeys(node.children, 0.0)
    room = {k: c.capacity() for k, c in node.children.items()}
    left = min(amount, sum(room.values()))
    live = [k for k in given if room[k] > 0]
    while left > 1e-9 and live:
        weight = sum(node.children[k].weight for k in live)
        share = {k: left * (node.children[k].weight / weight if weight else 1 / len(live)) for k in live}
        full = [k for k in live if given[k] + share[k] >= room[k] - 1e-9]
        for k in full or live:
            take = min(share[k], room[k] - given[k])
            given[k] += take
            left -= take
        live = [k for k in live if k not in full]
        if not full:
            break
    out: dict[tuple, float] = {}
    for k, c in node.children.items():
        out |= distribute(c, given[k], (*path, k))
    return out


def _round(budgets: list[tuple], edge: dict, source: dict) -> list[tuple[str, bool]]:
    """Which leaves take the document that their budget ends in. They are decided together for each source, the largest
    document first, so that the source's sum comes nearest to its budget."""
    lack: dict[str, float] = {}
    for leaf, _, rest in budgets:
        if leaf in edge:
            lack[source[leaf]] = lack.get(source[leaf], 0.0) + rest - edge[leaf]["before"]
    out = []
    for leaf in sorted((b[0] for b in budgets), key=lambda x: (-edge[x]["n_tokens"] if x in edge else 0, x)):
        take = leaf in edge and edge[leaf]["n_tokens"] <= 2 * lack[source[leaf]]
        if take:
            lack[source[leaf]] -= edge[leaf]["n_tokens"]
        out.append((leaf, take))
    return out


def token_sizes(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", domain: str | None = None) -> DataFrame:
    """(doc_id, source, lang, n_tokens, and domain where a column of it is named), written once: encoding is the costly part
    and all later steps read its result."""
    names = {"doc_id": id_col, "source": source, "lang": lang, "text": text} | ({"domain": domain} if domain else {})
    return stage(encode(docs.select(*[F.col(c).alias(n) for n, c in names.items()]), tokenizer_path, lists=False), "token-sizes")


def mix_sources(sizes: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = 0, max_leaves: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: (doc_id, source, lang, epoch, n_tokens), one row a use of a document; shares: (source,
    target_share, max_repeats, n_documents, available_tokens, mixed_tokens, share), a row a source of targets.

    sizes is (doc_id, source, lang, n_tokens) and may have a domain, targets (source, target_share, max_repeats). Weights run
    down a tree: the sources by their targets, their domains if there are any, their languages (these in proportion to
    their tokens). total_tokens is the size wanted: a number, or "available" for all tokens that the targets' sources have; what a source then lacks, even
    with max_repeats uses of each document, goes to its leaves' siblings first and then to the other sources, and shares tells
    what was reached. Without it the mix is as large as every source with tokens can meet its share. A leaf's budget is whole epochs over its documents and then a prefix of the next, in an order of its own
    drawn by seeded hash; where the prefixes of a source's leaves end is rounded so that their sum is nearest its budget. No document is used more than max_repeats times.

    Sources without tokens get nothing and are reported with share 0, their weight falling to the others; documents of
    sources that have no target, of null sources, and those without tokens are not chosen; a null language or domain is one of
    its own; repeated targets of a source count as one, their shares added. The driver sees one row a leaf and one a target, at
    most max_leaves of each; more are an error.
    """
    goal = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    aims = goal.limit(max_leaves + 1).collect()
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in aims}
    levels = [c for c in ("domain", "lang") if c in sizes.columns]
    sized = sizes.where("n_tokens > 0 AND source IS NOT NULL").join(goal.select("source"), "source", "left_semi")
    sized = sized.withColumn("leaf", F.to_json(F.array("source", *levels)))
    leaves = sized.groupBy("source", *levels, "leaf").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    listed = leaves.limit(max_leaves + 1).collect()
    if max(len(listed), len(aims)) > max_leaves:
        raise ValueError(f"more than {max_leaves} targets, or leaves of sources and languages")
    tokens = {r["leaf"]: r["tokens"] for r in listed}
    root = Node(1.0)
    for r in listed:
        share, repeats = wanted[r["source"]]
        node = root.child(r["source"], share)
        for c in levels[:-1]:
            node = node.child((c, r[c]), 0.0)
            node.weight += float(r["tokens"])
        leaf = node.child(r["leaf"], float(r["tokens"]))
        leaf.own = float(r["tokens"] * repeats)
    usable = {s: n for s, n in root.children.items() if n.weight > 0 and n.capacity() > 0}
    weight = sum(n.weight for n in usable.values())
    if total_tokens is None:
        total_tokens = min((n.capacity() * weight / n.weight for n in usable.values()), default=0.0)
    elif total_tokens == "available":
        total_tokens = float(sum(r["tokens"] for r in listed if r["source"] in usable))
    root.children = usable
    rows = []
    for path, budget in distribute(root, total_tokens).items():
        leaf = path[-1] if path else None
        if leaf in tokens:
            epochs = int(budget // tokens[leaf] + 1e-12)
            rows.append((leaf, epochs, float(budget - epochs * tokens[leaf])))
    spark = sizes.sparkSession
    budgets = spark.createDataFrame(rows, "leaf string, epochs int, rest double")
    ranked = hash_rank(sized.join(F.broadcast(budgets), "leaf"), "leaf", "doc_id", "n_tokens", seed, few_keys=True)
    edge = ranked.where("before < rest AND before + n_tokens > rest").select("source", "leaf", "before", "n_tokens").collect()
    extra = spark.createDataFrame(_round(rows, {r["leaf"]: r for r in edge}, {r["leaf"]: r["source"] for r in listed}), "leaf string, extra boolean")
    ranked = ranked.join(F.broadcast(extra), "leaf")
    uses = F.col("epochs") + F.when((F.col("before") + F.col("n_tokens") <= F.col("rest")) | (F.col("extra") & (F.col("before") < F.col("rest"))), 1).otherwise(0)
    used = ranked.withColumn("uses", uses).where("uses > 0")
    chosen = used.select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(1), "uses")).alias("epoch"), "n_tokens")
    stats = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("available_tokens"))
    mixed = used.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("mixed_tokens"))
    shares = goal.join(stats, "source", "left").join(mixed, "source", "left").na.fill(0, ["n_documents", "available_tokens", "mixed_tokens"])
    total = mixed.agg(F.sum("mixed_tokens").alias("total"))
    shares = shares.crossJoin(total).withColumn("share", F.round(F.coalesce(F.col("mixed_tokens") / F.col("total"), F.lit(0.0)), 6)).drop("total")
    return chosen, shares
