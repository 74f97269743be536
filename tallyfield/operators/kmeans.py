"""K-means with all restarts and all numbers of clusters side by side.

One pass over the points an iteration serves every fit that still moves: tasks hold the centres of
all of them, sum the points by (fit, cluster) and send a row a cluster. Seeding is k-means++ by
exponential races: the next centre of a run is the point with the smallest -ln(u) / d2, u from a hash of
seed, run, step and the point's id, d2 the squared distance to the run's centres. So a point wins with a
chance proportional to d2, one minimum a run decides, and other engines can repeat the choice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workers import importable

#: Decimals of squared distances when they are compared, so that summation order cannot show.
DIGITS = 9
#: A fit is done when no centre moves further.
STILL = 1e-9
#: Rows whose distances are held at once.
BLOCK = 2048


@dataclass(frozen=True)
class Fit:
    """Centres of one fit, its cost (sum of squared distances) and the iterations it took."""

    k: int
    run: int
    centres: np.ndarray
    cost: float = float("nan")
    iterations: int = 0


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre."""
    out = np.zeros((len(x), len(centres)))
    for f in range(x.shape[1]):
        out += (x[:, f, None] - centres[None, :, f]) ** 2
    return out


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, features) of some rows at a time."""
    for batch in rows:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = part.column("features").flatten().to_numpy(zero_copy_only=False)
            yield part.column("id"), x.astype(float).reshape(part.num_rows, -1)


def luck(seed: int, run: int, step: int, key: str) -> float:
    """A number between 0 and 1 from a hash."""
    return (int(hashlib.md5(f"{seed}|{run}|{step}|{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def lucks(seed: int, run: int, step: int, keys: Sequence[bytes]) -> np.ndarray:
    """``luck`` of many keys in UTF-8: the top 52 bits of each digest."""
    start = hashlib.md5(f"{seed}|{run}|{step}|".encode()).copy

    def digest(key: bytes) -> bytes:
        made = start()
        made.update(key)
        return made.digest()

    bits = np.frombuffer(b"".join(map(digest, keys)), ">u8")[::2].astype(np.uint64) >> np.uint64(12)
    return (bits + 0.5) / 2**52


def seeds(points: DataFrame, n: int, runs: int, seed: int) -> list[np.ndarray]:
    """Up to ``n`` centres for each run, the first of which seed smaller fits; fewer where fewer points differ."""
    found: list[list[np.ndarray]] = [[] for _ in range(runs)]
    for step in range(n):

        def race(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for ids, x in _blocks(rows):
                keys = ids.cast(pa.binary()).to_pylist()
                for run, chosen in enumerate(found):
                    far = squared(x, np.array(chosen)).min(1) if chosen else np.ones(len(x))
                    open_ = np.flatnonzero(far > 0)
                    if not len(open_):
                        continue
                    time = -np.log(lucks(seed, run, step, keys if len(open_) == len(keys) else [keys[i] for i in open_])) / far[open_]
                    first = int(time.argmin())
                    if run not in best or time[first] < best[run][0]:
                        best[run] = (float(time[first]), x[open_[first]].tolist())
            yield pa.RecordBatch.from_arrays([
                pa.array(list(best), pa.int32()), pa.array([t for t, _ in best.values()], pa.float64()),
                pa.array([x for _, x in best.values()], pa.list_(pa.float64())),
            ], names=["run", "time", "x"])

        won = points.mapInArrow(race, "run int, time double, x array<double>").groupBy("run").agg(F.min_by("x", "time").alias("x"))
        for r in won.collect():  # a row a run
            found[r.run].append(np.array(r.x))
    return [np.array(c) for c in found]


def _sums(points: DataFrame, fits: Sequence[Fit]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each fit the sizes and sums of its clusters and its cost, in one pass."""
    centres = np.concatenate([f.centres for f in fits])
    edges = np.cumsum([0, *(len(f.centres) for f in fits)])
    width = centres.shape[1]

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cost, sums = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros((len(centres), width))
        for _, x in _blocks(rows):
            d = np.round(squared(x, centres), DIGITS)
            for a, b in zip(edges, edges[1:]):
                near = a + d[:, a:b].argmin(1)
                size += np.bincount(near, minlength=len(centres))
                cost += np.bincount(near, weights=d[np.arange(len(x)), near], minlength=len(centres))
                for f in range(width):
                    sums[:, f] += np.bincount(near, weights=x[:, f], minlength=len(centres))
        held = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(size[held]), pa.array(cost[held]), *(pa.array(sums[held, f]) for f in range(width))],
            names=["at", "size", "cost", *(f"s{f}" for f in range(width))],
        )

    kinds = "at int, size bigint, cost double" + "".join(f", s{f} double" for f in range(width))
    made = points.mapInArrow(add, kinds).groupBy("at").agg(*[F.sum(c).alias(c) for c in ("size", "cost", *(f"s{f}" for f in range(width)))])
    size, cost, sums = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros((len(centres), width))
    for r in made.collect():  # a row a centre
        size[r.at], cost[r.at], sums[r.at] = r.size, r.cost, r[3:]
    return [(size[a:b], sums[a:b], float(cost[a:b].sum())) for a, b in zip(edges, edges[1:])]


def all_fits(points: DataFrame, ks: Sequence[int], seed: int = 42, restarts: int = 10, max_iter: int = 100) -> list[Fit]:
    """The fit of every k and run.

    ``points`` has a text ``id`` and an array ``features`` and should be a written table, as it is read once an iteration.
    A cluster that loses all points stays where it is.
    """
    importable(points.sparkSession)
    found = seeds(points, max(ks, default=0), restarts, seed)
    if not any(len(c) for c in found):
        return []
    moving = [Fit(k, run, found[run][:k]) for k in ks for run in range(restarts)]
    done: list[Fit] = []
    for at in range(1, max_iter + 1):
        still = []
        for fit, (size, sums, _) in zip(moving, _sums(points, moving)):
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], fit.centres)
            shift = float(np.sqrt(((centres - fit.centres) ** 2).sum(1)).max())
            (done if shift <= STILL or at == max_iter else still).append(Fit(fit.k, fit.run, centres, iterations=at))
        moving = still
        if not moving:
            break
    done.sort(key=lambda f: (f.k, f.run))
    return [Fit(f.k, f.run, f.centres, cost, f.iterations) for f, (_, _, cost) in zip(done, _sums(points, done))]


def best_fits(points: DataFrame, ks: Sequence[int], seed: int = 42, restarts: int = 10, max_iter: int = 100) -> dict[int, Fit]:
    """For each k the cheapest of its fits, the first of equally cheap ones."""
    fits = all_fits(points, ks, seed, restarts, max_iter)
    return {k: min((f for f in fits if f.k == k), key=lambda f: (round(f.cost, 6), f.run)) for k in ks if fits}


def nearest(features: str, fit: Fit) -> Column:
    """Number of the nearest centre, as an expression; of equally near ones the first."""
    away = [
        F.round(sum(((F.col(features)[f] - F.lit(float(v))) * (F.col(features)[f] - F.lit(float(v))) for f, v in enumerate(centre)), F.lit(0.0)), DIGITS)
        for centre in fit.centres
    ]
    return F.array_min(F.array(*[F.struct(d.alias("away"), F.lit(j).alias("at")) for j, d in enumerate(away)]))["at"]


def silhouettes(points: DataFrame, fits: Sequence[Fit], most: int = 20_000) -> dict[int, float] | None:
    """Mean Euclidean silhouette of each fit, in one pass for all; None if there are more than ``most`` points.

    Each block of points is compared with all points, which every task holds: ``most`` bounds them. A point
    that is alone in its cluster counts 0.
    """
    importable(points.sparkSession)
    held = points.select("features").limit(most + 1).collect()
    if len(held) > most or not fits:
        return None
    every = np.array([r.features for r in held], float)
    labels = [np.round(squared(every, f.centres), DIGITS).argmin(1) for f in fits]
    edges = np.cumsum([0, *(len(f.centres) for f in fits)])
    member = np.zeros((len(every), edges[-1]))
    for a, label in zip(edges, labels):
        member[np.arange(len(every)), a + label] = 1.0
    size = member.sum(0)

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(fits))
        for _, x in _blocks(rows):
            sums = np.sqrt(squared(x, every)) @ member
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                own = np.round(squared(x, fits[i].centres), DIGITS).argmin(1)
                at = np.arange(len(x))
                n = size[a:b][own]
                within = sums[:, a:b][at, own] / np.maximum(n - 1, 1)
                mean = np.where(size[a:b] > 0, sums[:, a:b] / np.maximum(size[a:b], 1), np.inf)
                mean[at, own] = np.inf
                other = mean.min(1)
                widest = np.maximum(within, other)
                good = (n > 1) & np.isfinite(other) & (widest > 0)
                total[i] += ((other - within)[good] / widest[good]).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fits)), pa.int32()), pa.array(total)], names=["at", "total"])

    made = points.mapInArrow(compare, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()  # a row a fit
    return {fits[r.at].k: r.total / len(every) for r in made}
