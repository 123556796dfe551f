"""Speakers' clusters: agglomeration of vectors, merges of centroids, and assignment of labels. One recording's clusters (a few
to some thousand vectors) are one group; recordings are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.operators import speakers


#: Clusters whose distances are held as one square (34 MB), and numbers of a block of rows of what is larger (32 MB).
SQUARE, BLOCK = 2048, 1 << 22


def _nearness(unit: np.ndarray, order: np.ndarray, starts: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Cosine distances of the clusters ``which`` (ascending) to all clusters, one after the other: the largest ones between
    members. Cluster k has the members order[starts[k] : starts[k + 1]]. A block of rows is held at a time."""
    sizes = np.diff(starts, append=len(order))
    members = np.concatenate([order[starts[k] : starts[k] + sizes[k]] for k in which.tolist()])
    owner = np.repeat(which, sizes[which])
    # first members of all clusters, then the second ones of those that have two, and so on, larger clusters ahead
    large = np.argsort(-sizes, kind="stable")
    rank = np.arange(len(order)) - np.repeat(starts, sizes)
    place = np.empty(len(starts), np.int64)
    place[large] = np.arange(len(starts))
    theirs = unit[order[np.lexsort((np.repeat(place, sizes), rank))]]
    layers = np.bincount(rank).tolist()
    rows, held = max(1, BLOCK // len(order)), None
    for at in range(0, len(members), rows):
        own = owner[at : at + rows]
        near = theirs @ unit[members[at : at + rows]].T
        done = layers[0]
        for n in layers[1:]:
            np.minimum(near[:n], near[done : done + n], out=near[:n])
            done += n
        near = np.ascontiguousarray(near[place].T)
        heads = [*np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist(), len(own)]
        for begin, end in zip(heads, heads[1:]):
            k, row = int(own[begin]), near[begin:end].min(axis=0)
            if held is not None and held[0] == k:
                row = np.minimum(held[1], row)  # a cluster with rows in several blocks
            elif held is not None:
                yield held[0], 1 - held[1]
            held = k, row
    yield held[0], 1 - held[1]


def _greedy(far: np.ndarray, limit: float) -> list[tuple[float, int, int]]:
    """Merges (distance, both places) by falling nearness in a square of distances, up to ``limit``.

    Each cluster knows the nearest one after it. A union is at least as far from any other as its parts were, so only those
    whose nearest was one of both look again, and a merge takes time linear in the number of clusters."""
    n = len(far)
    np.fill_diagonal(far, np.inf)
    nearest, least, merges = np.zeros(n, np.int64), np.full(n, np.inf), []

    def look(k: int) -> None:
        if k + 1 < n:
            nearest[k] = k + 1 + int(np.argmin(far[k, k + 1 :]))
            least[k] = far[k, nearest[k]]

    for k in range(n):
        look(k)
    while len(merges) < n - 1:
        i = int(np.argmin(least))
        j = int(nearest[i])
        if least[i] > limit:
            break
        merges.append((float(least[i]), i, j))
        union = np.maximum(far[i], far[j])  # its distances are the larger ones of both parts
        far[i], far[:, i] = union, union
        far[j], far[:, j] = np.inf, np.inf
        least[j] = np.inf
        nearest[j] = j
        for k in np.flatnonzero((nearest == i) | (nearest == j) | (np.arange(n) == i)).tolist():
            if np.isfinite(least[k]):
                look(k)
    return merges


def _joined(group: np.ndarray, merges: list[tuple[float, int, int]]) -> np.ndarray:
    """The place of each vector's cluster after merges (the second place goes to the first, which is smaller)."""
    to = np.arange(len(group))
    for _, i, j in merges:
        to[j] = i
    for j in sorted(j for _, _, j in merges):
        to[j] = to[to[j]]
    return to[group]


def _by_rounds(unit: np.ndarray, limit: float) -> list[tuple[float, int, int]]:
    """The merges of _greedy, in another order, in memory linear in the vectors.

    Of pairs ordered by distance and places, a merge never makes one that comes before what both parts had. So two clusters
    that are each other's nearest are merged whatever comes first, and all such pairs of a round at once. Equal vectors are
    merged ahead. Once SQUARE clusters are left their distances are a square."""
    n = len(unit)
    _, first, same = np.unique(unit, axis=0, return_index=True, return_inverse=True)
    group = first[same.ravel()]
    self = 1 - np.einsum("ij,ij->i", unit, unit)
    group = np.where(self <= limit, group, np.arange(n))
    merges = [(float(self[j]), int(group[j]), j) for j in np.flatnonzero(group != np.arange(n)).tolist()]
    nearest, least, stale = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    while True:
        order = np.argsort(group, kind="stable")
        places, starts = np.unique(group[order], return_index=True)
        if len(places) <= SQUARE:
            far = np.empty((len(places), len(places)))
            for k, row in _nearness(unit, order, starts, np.arange(len(places))):
                far[k] = row
            return merges + [(d, int(places[i]), int(places[j])) for d, i, j in _greedy(far, limit)]
        for k, row in _nearness(unit, order, starts, np.flatnonzero(stale[places])):
            row[k] = np.inf
            best = int(np.argmin(row))  # of equally near ones the smallest place, from both sides
            nearest[places[k]], least[places[k]] = places[best], row[best]
        other = nearest[places]
        ready = (places < other) & (nearest[other] == places)
        if not ready.any():  # rounding has made a distance differ from its mirror
            ready[np.argmin(np.where(places < other, least[places], np.inf))] = True
        ready &= least[places] <= limit
        if not ready.any():
            return merges
        found = [(float(least[i]), i, int(nearest[i])) for i in places[ready].tolist()]
        merges += found
        moved = np.zeros(n, bool)
        moved[[i for _, i, _ in found] + [j for _, _, j in found]] = True
        group = _joined(group, found)
        stale = moved | moved[nearest]


def complete_linkage(vectors: np.ndarray, threshold: float = 0.9, count: int | None = None) -> np.ndarray:
    """Labels from 0 (by first member) of clusters merged while the largest cosine distance within stays at most threshold, or
    down to ``count`` clusters. Nearest pairs go first (ties: the smallest places).

    Up to SQUARE vectors their distances are held; more take time by the square of their number, and memory in proportion."""
    n = len(vectors)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    limit = threshold if count is None else np.inf
    if n <= SQUARE:
        far = unit @ unit.T
        merges = _greedy(np.subtract(1, far, out=far), limit)
    else:
        merges = _by_rounds(unit, limit)
    if count is not None:
        merges = sorted(merges)[: max(0, n - max(count, 1))]
    return np.unique(_joined(np.arange(n), merges), return_inverse=True)[1]


def clustering(vectors: DataFrame, key: str = "rec", threshold: float = 0.9, count: int | None = None) -> DataFrame:
    """vectors: key, vec_id, embedding. Cluster of each vector within its recording; null and zero vectors are left out."""
    good = vectors.filter("embedding is not null and exists(embedding, x -> x <> 0)").select(key, "vec_id", "embedding")

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        labels = complete_linkage(np.stack(part.embedding.to_numpy()).astype(np.float64), threshold, count)
        return pd.DataFrame({key: part[key], "vec_id": part.vec_id, "cluster": labels.astype(np.int64)})

    return good.groupBy(key).applyInPandas(label, f"{key} {good.schema[key].dataType.simpleString()}, vec_id long, cluster long")


def minor_to_main(centroids: DataFrame, shares: DataFrame, key: str = "rec", least: float = 0.55) -> DataFrame:
    """centroids: key, label, centroid; shares: key, label, share, is_main. The most similar main label of each minor one, if
    its cosine is ``least`` or more (ties: the larger share)."""
    c = centroids.join(shares, [key, "label"])
    minor = c.filter("not is_main").select(key, "label", F.col("centroid").alias("own"))
    main = c.filter("is_main").select(key, F.col("label").alias("to"), "centroid", "share")
    sims = minor.join(main, key).withColumn("sim", speakers.cosine(F.col("own"), F.col("centroid")))
    best = F.row_number().over(Window.partitionBy(key, "label").orderBy(F.desc("sim"), F.desc("share"), "to"))
    return sims.withColumn("k", best).filter((F.col("k") == 1) & (F.col("sim") >= least)).select(key, "label", "to", "sim")


def merge_labels(rows: list[tuple], main_share: float = 0.03, minor: float = 0.55, main: float = 0.78, dominant_share: float = 0.6, dominant: float = 0.6, fold: float = 0.5) -> dict:
    """rows: label, duration, vector (or None). Where each label goes: minor ones to the nearest main one, main ones together
    until none is close (the larger takes the smaller; vectors stay as they were), then main and minor ones into a dominant one."""
    took = {r[0]: r[1] for r in rows}
    unit = {}
    for name, _, v in rows:
        if v is not None and np.linalg.norm(v) > 0:
            unit[name] = np.asarray(v, dtype=np.float64) / np.linalg.norm(v)

    def near(a, b) -> float:
        return float(unit[a] @ unit[b]) if a in unit and b in unit else -1.0

    whole = sum(took.values()) or 1.0
    share = {k: v / whole for k, v in took.items()}
    mains = sorted((k for k in share if share[k] >= main_share), key=lambda k: -share[k])
    minors = [k for k in share if share[k] < main_share]
    to = {k: k for k in took}
    if not mains:
        return to

    def move(a, b) -> None:
        to.update({k: b for k, v in to.items() if v == a or k == a})

    for m in minors:
        known = [k for k in mains if k in unit] if m in unit else []
        best = max(known, key=lambda k: near(m, k), default=None)
        if best is not None and near(m, best) >= minor:
            to[m] = best
    left = list(mains)
    while pair := next(((a, b) for i, a in enumerate(left) for b in left[i + 1 :] if near(a, b) >= main), None):
        small, large = sorted(pair, key=lambda k: (share[k], -left.index(k)))
        move(small, large)
        left.remove(small)
    held: dict = {}
    for k, v in to.items():
        held[v] = held.get(v, 0.0) + took[k]
    top = max(held, key=held.get)
    if held[top] / (sum(held.values()) or 1.0) >= dominant_share:
        alone = [m for m in minors if to[m] == m]
        for k in left:
            if k != top and near(k, top) >= dominant:
                move(k, top)
        to.update({m: top for m in alone if m != top and near(m, top) >= fold})
    return to


def merged_clusters(centroids: DataFrame, key: str = "rec") -> DataFrame:
    """centroids: key, label (string), duration, centroid. merge_labels within each recording."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.label, float(r.duration), r.centroid) for r in part.sort_values("label").itertuples()]
        to = merge_labels(rows)
        return pd.DataFrame({key: [part[key].iloc[0]] * len(to), "label": list(to), "merged": list(to.values())})

    return centroids.select(key, "label", "duration", "centroid").groupBy(key).applyInPandas(each, f"{key} {centroids.schema[key].dataType.simpleString()}, label string, merged string")


def regrouped(rows: DataFrame, mapping: DataFrame, key: str = "rec") -> DataFrame:
    """rows: key, label, duration; mapping: key, label, to. Durations and shares by new label; labels without an entry stay."""
    moved = rows.join(mapping.select(key, "label", "to"), [key, "label"], "left")
    own = moved.groupBy(key, F.coalesce("to", "label").alias("label")).agg(F.sum("duration").alias("duration"))
    whole = F.sum("duration").over(Window.partitionBy(key))
    return own.withColumn("share", F.col("duration") / F.when(whole == 0, 1.0).otherwise(whole))


def remap(rows: DataFrame, mapping: DataFrame, keys: list[str], inner: bool = False) -> DataFrame:
    """Speakers by a mapping (keys, speaker, to); without an entry they stay, or (inner) their rows go."""
    found = rows.join(mapping.select(*keys, "speaker", "to"), [*keys, "speaker"], "inner" if inner else "left")
    return found.withColumn("speaker", F.coalesce("to", "speaker")).drop("to")


def greedy_pairs(scores: DataFrame, key: str = "rec") -> DataFrame:
    """scores: key, local, label, score. One-to-one assignment by falling score (ties: the smaller local, then label): the
    pairs of a recording are folded in order, in Catalyst."""
    kind = "array<struct<local:string,label:string,score:double>>"
    row = F.struct((-F.col("score")).alias("o"), F.col("local").cast("string").alias("local"), F.col("label").cast("string").alias("label"), F.col("score").cast("double").alias("score"))
    rows = scores.filter("score > 0").groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("r"))

    def step(out, x):
        taken = F.exists(out, lambda o: (o["local"] == x["local"]) | (o["label"] == x["label"]))
        return F.when(taken, out).otherwise(F.concat(out, F.array(F.struct(x["local"].alias("local"), x["label"].alias("label"), x["score"].alias("score"))))).cast(kind)

    pairs = F.aggregate("r", F.array().cast(kind), step)
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def _assigned(gain: list[list[int]]) -> list[int]:
    """Column of each row in a one-to-one assignment of largest sum (at least as many columns as rows): the Hungarian method."""
    n, m = len(gain), len(gain[0])
    u, v, of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, way, used = [None] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while of[j]:
            used[j], row = True, of[j]
            for k in range(1, m + 1):
                if not used[k]:
                    cost = -gain[row - 1][k - 1] - u[row] - v[k]
                    if least[k] is None or cost < least[k]:
                        least[k], way[k] = cost, j
            step, to = min((least[k], k) for k in range(1, m + 1) if not used[k])
            for k in range(m + 1):
                if used[k]:
                    u[of[k]] += step
                    v[k] -= step
                elif k:
                    least[k] -= step
            j = to
        while j:
            of[j], j = of[way[j]], way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if of[k]:
            out[of[k] - 1] = k - 1
    return out


def best_mapping(confusion: dict) -> dict:
    """Mapping of labels that covers most of the counts {(own, true): n}: one-to-one, or, with more own labels than true ones,
    each to its most frequent one. Of equally good mappings it is the first, as labels are sorted: the first label has the
    smallest true one it can, then the second."""
    own, true = sorted({a for a, _ in confusion}), sorted({b for _, b in confusion})
    if len(own) > len(true):
        return {a: max(true, key=lambda b: confusion.get((a, b), 0)) for a in own}
    if not own:
        return {}
    # a place costs less than any count is worth, and that of an earlier label more than all of later ones
    n, m = len(own), len(true)
    gain = [[confusion.get((a, b), 0) * m**n - j * m ** (n - 1 - i) for j, b in enumerate(true)] for i, a in enumerate(own)]
    return {a: true[j] for a, j in zip(own, _assigned(gain))}


def label_mapping(counts: DataFrame, key: str = "rec") -> DataFrame:
    """counts: key, own, true, n. best_mapping of each recording."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        to = best_mapping({(r.own, r.true): int(r.n) for r in part.itertuples()})
        return pd.DataFrame({key: [part[key].iloc[0]] * len(to), "own": list(to), "mapped": list(to.values())})

    return counts.select(key, "own", "true", "n").groupBy(key).applyInPandas(each, f"{key} {counts.schema[key].dataType.simpleString()}, own string, mapped string")


def spurious(turns: DataFrame, least_ms: int = 2000, least_share: float = 0.01, key: str = "conv_id") -> DataFrame:
    """Turns of speakers below least_ms or least_share of the recording go to the speaker of the turn with the nearest
    middle among the others (ties: the earlier row); recordings without any other speaker stay as they are."""
    whole = Window.partitionBy(key)
    own = turns.groupBy(key, "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total"))
    limit = F.greatest(F.lit(float(least_ms)), F.max("total").over(whole) * 0 + F.sum("total").over(whole) * least_share)
    own = own.withColumn("weak", F.col("total") < limit).withColumn("any", F.bool_or(~F.col("weak")).over(whole))
    rows = turns.join(own.select(key, "speaker", (F.col("weak") & F.col("any")).alias("weak")), [key, "speaker"])
    # Nearest middle on either side, by two scans; twice the middle is an integer.
    rows = rows.withColumn("mid", F.col("start_ms") + F.col("end_ms"))
    good = F.when(~F.col("weak"), F.struct("mid", "pos", "speaker"))
    back = Window.partitionBy(key).orderBy("mid", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc("mid"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"low": F.last(good, True).over(back), "high": F.last(good, True).over(ahead)})
    d = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["mid"] - F.col("mid")).alias("d"), F.col(c)["pos"].alias("pos"), F.col(c)["speaker"].alias("speaker")))
    return rows.withColumn("new", F.when(F.col("weak"), F.least(d("low"), d("high"))["speaker"]).otherwise(F.col("speaker"))).select(key, "pos", F.col("speaker").alias("was"), F.col("new").alias("speaker"), "start_ms", "end_ms")
