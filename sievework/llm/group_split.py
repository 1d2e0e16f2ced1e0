"""Train, validation and test splits that never divide a group."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import split_name, trimmed_lower
from sievework.operators.hash_rank import hash_rank
from sievework.session import stage


class Flow:
    """Successive shortest paths with potentials over a small graph."""

    def __init__(self) -> None:
        self.arcs: list[list[float]] = []
        self.out: dict[object, list[int]] = defaultdict(list)

    def arc(self, a: object, b: object, capacity: float, cost: float) -> int:
        self.out[a].append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out[b].append(len(self.arcs))
        self.arcs.append([a, 0.0, -cost])
        return len(self.arcs) - 2

    def run(self, source: object, sink: object) -> None:
        height: dict[object, float] = defaultdict(float)
        while True:
            dist, via, heap, tick = {source: 0.0}, {}, [(0.0, 0, source)], 0
            while heap:
                d, _, a = heapq.heappop(heap)
                if d > dist[a] + 1e-12:
                    continue
                for e in self.out[a]:
                    b, left, cost = self.arcs[e]
                    if left > 1e-9 and (x := d + cost + height[a] - height[b]) < dist.get(b, 1e300) - 1e-12:
                        dist[b], via[b] = x, e
                        tick += 1
                        heapq.heappush(heap, (x, tick, b))
            if sink not in dist:
                return
            far = max(dist.values())
            for a in self.out:
                height[a] += dist.get(a, far)
            path, a = [], sink
            while a != source:
                path.append(via[a])
                a = self.arcs[via[a] ^ 1][0]
            push = min(self.arcs[e][1] for e in path)
            for e in path:
                self.arcs[e][1] -= push
                self.arcs[e ^ 1][1] += push


Bundle = tuple[str, int, int]


def place_heavy(heavy: list[Bundle], targets: dict[str, float], total: int) -> tuple[dict[str, dict[str, int]], dict[str, float], dict[tuple[str, str], int]]:
    """(groups of each heavy bundle by split, room left in each split, rows placed by label and split): the largest first, each
    where the most room is left."""
    weight = sum(targets.values())
    room = {k: total * w / weight for k, w in targets.items()}
    out, placed = {}, defaultdict(int)
    for p, size, n in sorted(heavy, key=lambda b: (-b[1], b[0])):
        own = out.setdefault(p, dict.fromkeys(targets, 0))
        for _ in range(n):
            k = max(targets, key=lambda k: room[k])
            own[k] += 1
            room[k] -= size
            for label, rows in json.loads(p):
                placed[label, k] += int(rows)
    return out, room, placed


def allocate(bundles: list[Bundle], targets: dict[str, float], label_shares: Callable[[str], dict[str, float]] | None = None) -> dict[str, dict[str, int]]:
    """How many groups of each bundle go to each split. bundles: (profile, rows of a group, number of groups), the profile
    being a JSON list of [label, rows]. targets: the splits' shares of these bundles' rows; label_shares: a label's own.

    A min-cost flow of rows from bundles over (label, split) to splits: rows within a label's quota of a split and within the
    split's quota are free, others cost their deviation, the split's own more than the label's. Flows become whole numbers of
    groups by largest remainders, in favour of the splits that are then the furthest below their quota.
    """
    names = list(targets)
    weight = sum(targets.values())
    share = {k: w / weight for k, w in targets.items()}
    total = sum(size * n for _, size, n in bundles)
    parts = {p: [(label, int(rows)) for label, rows in json.loads(p)] for p, _, _ in bundles}
    by_label: dict[str, float] = defaultdict(float)
    for p, _, n in bundles:
        for label, rows in parts[p]:
            by_label[label] += rows * n
    room = {k: total * share[k] for k in names}
    out: dict[str, dict[str, int]] = {p: dict.fromkeys(names, 0) for p, _, _ in bundles}
    flow = Flow()
    of: dict[tuple[str, str], list[int]] = defaultdict(list)
    for p, size, n in sorted(bundles, key=lambda b: (-b[1], b[0])):
        flow.arc("source", ("b", p), size * n, 0)
        for k in names:
            for label, rows in parts[p]:
                of[p, k].append(flow.arc(("b", p), ("l", label, k), rows * n, 0))
    for label, rows in by_label.items():
        own = (label_shares and label_shares(label)) or share
        for k in names:
            flow.arc(("l", label, k), ("s", k), max(0.0, rows * own[k]), 0)
            flow.arc(("l", label, k), ("s", k), float(total), 1)
    for k in names:
        flow.arc(("s", k), "sink", room[k], 0)
        flow.arc(("s", k), "sink", float(total), 4)
    flow.run("source", "sink")
    rests = []
    for p, size, n in bundles:
        want = {k: sum(flow.arcs[e ^ 1][1] for e in of[p, k]) / size for k in names}
        for k in names:
            out[p][k] = int(want[k] + 1e-9)
            room[k] -= size * out[p][k]
        rests.append((size, p, want, n - sum(out[p].values())))
    for size, p, want, left in sorted(rests, key=lambda r: (-r[0], r[1])):
        for _ in range(left):
            k = max(names, key=lambda k: (min(1.0, want[k] - out[p][k]) * size + room[k], k))
            out[p][k] += 1
            room[k] -= size
    return out


def group_table(df: DataFrame, group: str, split: str, label: str) -> DataFrame:
    """(group_id, n_rows, profile, splits): group_id trimmed and in lower case; rows of a null group or split are left out."""
    rows = df.select(trimmed_lower(F.col(group)).alias("group_id"), split_name(F.col(split)).alias("split"), F.coalesce(F.col(label), F.lit("")).alias("label"))
    rows = rows.where("group_id IS NOT NULL AND split IS NOT NULL")
    cells = rows.groupBy("group_id", "label", "split").agg(F.count(F.lit(1)).alias("n"))
    labels = cells.groupBy("group_id", "label").agg(F.sum("n").alias("n"), F.collect_set("split").alias("splits"))
    return labels.groupBy("group_id").agg(
        F.sum("n").alias("n_rows"),
        F.to_json(F.array_sort(F.collect_list(F.array(F.col("label"), F.col("n").cast("string"))))).alias("profile"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("splits")))).alias("splits"),
    )


def split_groups(
    df: DataFrame, targets: DataFrame, group: str = "group_id", split: str = "split", label: str = "config", seed: int = 0, per_block: int = 256, heavy: float = 0.01, max_splits: int = 1000
) -> DataFrame:
    """(group_id, n_rows, splits, divided, new_split): every group once, the splits it is in now, whether that is more than one
    of the targets' splits, and its new one.

    targets has (split, target_share), at most max_splits of them (more are an error); shares are taken relative to their sum.
    Empty groups don't exist; an empty table gives no rows; without targets it is an error.

    Plan: groups of one size and label profile form a bundle. Groups with more than `heavy` of all rows (so fewer than
    1 / heavy) are placed first, where the most room is left: a flow cannot divide them. The other bundles are dealt by
    hash into blocks of about per_block, and each block's quotas, its share of every split's and label's room, are met by a
    min-cost flow of its own: full profiles at every size, no driver that sees all bundles, and what rounding leaves in a
    block is less than its largest group. Members of a bundle are assigned by their rank in the order of a hash.
    """
    goals = targets.where("target_share > 0").groupBy("split").agg(F.sum("target_share").alias("target_share")).orderBy("split").limit(max_splits + 1).collect()
    if not goals or len(goals) > max_splits:
        raise ValueError(f"targets must have between 1 and {max_splits} splits")
    shares = {r["split"]: float(r["target_share"]) for r in goals}
    names = list(shares)
    groups = stage(group_table(df, group, split, label), "groups")
    bundles = stage(groups.groupBy("profile", "n_rows").agg(F.count(F.lit(1)).alias("n")), "bundles")
    total, n_bundles = bundles.agg(F.coalesce(F.sum(F.col("n_rows") * F.col("n")), F.lit(0)), F.count(F.lit(1))).first()
    is_heavy = F.col("n_rows") > heavy * total
    first = [(r["profile"], r["n_rows"], r["n"]) for r in bundles.where(is_heavy).collect()]  # fewer than 1 / heavy
    fixed, room, placed = place_heavy(first, shares, total)
    light = {k: max(0.0, x) for k, x in room.items()}
    light = light if sum(light.values()) else shares
    # labels of heavy groups: what these leave of each split's quota
    own: dict[str, dict[str, float]] = {}
    if placed:
        touched = list({x for x, _ in placed})
        each = bundles.select("n", F.explode(F.from_json("profile", "array<array<string>>")).alias("c"))
        sums = each.groupBy(F.col("c")[0].alias("label")).agg(F.sum(F.col("c")[1].cast("bigint") * F.col("n")).alias("rows")).where(F.col("label").isin(touched))
        weight = sum(shares.values())
        for r in sums.collect():
            left = {k: max(0.0, r["rows"] * shares[k] / weight - placed[r["label"], k]) for k in names}
            whole = sum(left.values())
            own[r["label"]] = {k: x / whole for k, x in left.items()} if whole else {k: x / sum(light.values()) for k, x in light.items()}

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        plan = allocate(list(zip(block["profile"], block["n_rows"].astype(int), block["n"].astype(int), strict=True)), light, own.get)
        return pd.DataFrame({"profile": list(plan), "counts": [[c[k] for k in names] for c in plan.values()]})

    blocks = max(1, -(-n_bundles // per_block))
    dealt = bundles.where(~is_heavy).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "profile"), F.lit(blocks)))
    solved = dealt.groupBy("block").applyInPandas(solve, "profile string, counts array<bigint>")
    known = df.sparkSession.createDataFrame([(p, [c[k] for k in names]) for p, c in fixed.items()], "profile string, counts array<bigint>")
    plan = stage(solved.unionByName(known), "split-plan")
    ranked = hash_rank(groups, "profile", "group_id", seed=seed).join(plan, "profile")
    upto = F.transform("counts", lambda c, i: F.aggregate(F.slice("counts", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    place = F.array_position(F.transform(upto, lambda u: u >= F.col("rank")), True)
    inside = F.size(F.array_intersect("splits", F.array(*map(F.lit, names))))
    return ranked.select("group_id", "n_rows", "splits", (inside > 1).alias("divided"), F.get(F.array(*map(F.lit, names)), place.cast("int") - 1).alias("new_split"))


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_rows, n_groups, share): what each split gets, a row a target."""
    got = assigned.groupBy(F.col("new_split").alias("split")).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))
    total = got.agg(F.sum("n_rows").alias("total"))
    return targets.join(got.crossJoin(total), "split", "left").select("split", "target_share", "n_rows", "n_groups", F.round(F.col("n_rows") / F.col("total"), 6).alias("share"))
