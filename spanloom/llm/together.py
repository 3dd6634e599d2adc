"""Problem 3: splits that keep records of one filer together.

Filers named in one title are linked; components of these links are found by alternating star
contraction, each round written to the shared folder.  The label vectors of components go into
a bounded number of bundles (a component above ``1 / BUNDLES`` of all rows is a bundle of its own,
the others are bundled by hash, so no component is divided), and only those vectors, one row a bundle, reach the
driver, which places the bundle with the rarest outstanding label first into the split needing
it most.  A bundle is then as exact as a component down to 1/8,192 of all rows; what that costs is shown by ``balance``.

Null titles get no split; a title without a filer's name is a component of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from .asread import as_read
from .shared import kept

BUNDLES = 8192
MOVES = 32  # bundles compared for each closing move
CELL = 100_000  # titles of one filer that are joined with their component by a shuffle
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}

# Closing legal forms that don't make another filer, and the signs between two filers.
LEGAL_FORMS = ("incorporated", "corporation", "limited", "corp", "inc", "llc", "ltd")
_JOINED = re.compile(r" (?:&|and|f-k-a) ", re.IGNORECASE)
_PIECE = re.compile(r"[^\W_]+")


def filer_key(name: str) -> str:
    """Letters and digits of a filer's name, in lower case, without a closing legal form."""
    pieces = _PIECE.findall(name.lower().replace(".", ""))
    if len(pieces) > 1 and pieces[-1] in LEGAL_FORMS:
        return "".join(pieces[:-1])
    key = "".join(pieces)
    if len(pieces) == 1:
        for form in LEGAL_FORMS:
            if key.endswith(form) and len(key) > len(form) + 1:
                return key[: -len(form)]
    return key


def filers(title: str | None) -> list[str]:
    """Keys of the filers that a title names."""
    if title is None:
        return []
    name = " ".join(as_read(title).partition("_")[0].split())
    return list(dict.fromkeys(k for part in _JOINED.split(name) if (k := filer_key(part))))


@arrow_udf(ArrayType(StringType()))
def filers_of(titles: pa.Array) -> pa.Array:
    return pa.array([filers(t) for t in titles.to_pylist()], pa.list_(pa.string()))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; the component is named by its least node."""
    e = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    state = None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state and now[0]:
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = kept(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def title_components(titles: DataFrame) -> DataFrame:
    """(title, component) of every distinct title; one that names no filer is its own component."""
    named = kept(titles.select("title").filter("title is not null").distinct().select("title", filers_of("title").alias("f")))
    linked = named.filter(F.size("f") > 1).select(F.col("f")[0].alias("a"), F.explode(F.slice("f", 2, 1 << 30)).alias("b"))
    comp = components(linked)
    alone = F.concat(F.lit("title "), "title")  # keys of filers have no blank
    first = named.select("title", F.coalesce(F.get("f", F.lit(0)), alone).alias("node"))
    # a filer may have a third of all titles; filers with more than CELL are at most one in CELL titles, and don't go through a shuffle
    hot = kept(first.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    rest = first.join(F.broadcast(hot.select("node")), "node", "left_anti").join(comp, "node", "left")
    return first.join(F.broadcast(hot), "node").select("title", "component").unionByName(rest.select("title", F.coalesce("component", "node").alias("component")))


def stratify(vectors: np.ndarray, shares: list[float]) -> np.ndarray:
    """The split of each bundle, by iterative stratification and then moves that bring the rows nearer to the shares.

    vectors: rows per bundle and label.
    """
    want = np.outer(shares, vectors.sum(0)).astype(float)
    where = np.full(len(vectors), -1)
    rows = vectors.sum(1)
    while (left := where < 0).any():
        outstanding = vectors[left].sum(0)
        if not outstanding.any():
            where[left] = 0
            break
        label = np.where(outstanding > 0, outstanding, np.inf).argmin()
        own = np.flatnonzero(left & (vectors[:, label] > 0))
        for i in own[np.lexsort((own, -rows[own]))]:
            s = np.lexsort((-want.sum(1), -want[:, label]))[0]
            where[i] = s
            want[s] -= vectors[i]
    goal = np.outer(shares, vectors.sum(0))
    have = np.array([vectors[where == s].sum(0) for s in range(len(shares))], float)
    for _ in range(4 * len(vectors)):
        over_by = have.sum(1) - goal.sum(1)
        over, under = np.argmax(over_by), np.argmin(over_by)
        gap = min(over_by[over], -over_by[under])
        can = np.flatnonzero((where == over) & (rows > 0) & (rows < 2 * gap))
        if not len(can):
            break
        can = can[np.argsort(np.abs(rows[can] - gap), kind="stable")[:MOVES]]  # of those of nearly the right size, what leaves the labels best
        off = np.abs(have[over] - vectors[can] - goal[over]).sum(1) + np.abs(have[under] + vectors[can] - goal[under]).sum(1)
        i = can[np.argmin(off)]
        where[i] = under
        have[over] -= vectors[i]
        have[under] += vectors[i]
    return where


def grouped_split(samples: DataFrame, label: Column, shares: dict[str, float] = SHARES, bundles: int = BUNDLES) -> DataFrame:
    """(title, component, split) of every title; ``samples`` has one row per sample, ``label`` is of few values."""
    of = kept(title_components(samples))
    counts = samples.filter("title is not null").groupBy("title", label.cast("string").alias("label")).agg(F.count("*").alias("rows"))
    counts = kept(counts.join(of, "title").groupBy("component", "label").agg(F.sum("rows").alias("rows")))
    per = counts.groupBy("component").agg(F.sum("rows").alias("all_rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    small = F.concat(F.lit("#"), F.pmod(F.xxhash64("component"), F.lit(bundles)).cast("string"))
    bundle = kept(per.select("component", F.when(F.col("all_rows") * bundles >= total, F.concat(F.lit("="), "component")).otherwise(small).alias("bundle")))
    labels = [r.label for r in counts.select("label").distinct().orderBy("label").collect()]  # of few values
    names = list(shares)
    if not labels:
        return of.withColumn("split", F.lit(None).cast("string"))
    at = F.array_position(F.array(*(F.coalesce(F.lit(x), F.lit("\0")) for x in labels)), F.coalesce("label", F.lit("\0")))
    per = counts.join(bundle, "component").groupBy("bundle", at.cast("int").alias("k")).agg(F.sum("rows").alias("rows"))
    per = per.groupBy("bundle").agg(F.collect_list(F.struct("k", "rows")).alias("v")).orderBy("bundle")  # the labels of one bundle
    found = per.toPandas()  # 2 x BUNDLES rows at most
    vectors = np.zeros((len(found), len(labels)), np.int64)
    for i, v in enumerate(found["v"]):
        for x in v:
            vectors[i, x["k"] - 1] = x["rows"]
    at = stratify(vectors, [shares[n] for n in names])
    chosen = samples.sparkSession.createDataFrame([(b, names[s]) for b, s in zip(found["bundle"], at.tolist(), strict=True)], "bundle string, split string")
    return of.join(bundle.join(F.broadcast(chosen), "bundle"), "component").select("title", "component", "split")


def balance(samples: DataFrame, label: Column, split: DataFrame) -> DataFrame:
    """(label, split, rows, share): how the rows of each label fall on the splits; label null is one of its own.  ``split`` has each title once."""
    rows = samples.filter("title is not null").groupBy("title", label.cast("string").alias("label")).agg(F.count("*").alias("rows"))
    rows = rows.join(split.select("title", "split"), "title").groupBy("label", "split").agg(F.sum("rows").alias("rows"))
    return rows.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("label")), 6))
