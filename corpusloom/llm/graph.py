"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions

#: Up to so many links one task labels them all; beyond, star contraction over the cluster.
ONE_TASK = 2_000_000


def label_links(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id reachable) for the ids in the links."""
    ids, inverse = np.unique(np.concatenate((src, dst)), return_inverse=True)
    a, b = inverse[: len(src)], inverse[len(src) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return ids, ids[label]
        label = new


def _local_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces a partition's links by one link from each id to the smallest it reaches here."""
    src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for pdf in batches:
        ids, low = label_links(np.concatenate((src, pdf["src"].to_numpy(np.int64))), np.concatenate((dst, pdf["dst"].to_numpy(np.int64))))
        src, dst = ids, low
    if len(src):
        yield pd.DataFrame({"src": src, "dst": dst})


def components(scratch: Scratch, links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every id in links(src long, dst long); component is the smallest id reachable.

    Each partition first shrinks its links to stars. At most ``one_task`` stars are
    finished by one task; more go through rounds of large-star and small-star
    contraction, whose groups need only a minimum (combined before the shuffle) and
    joins that AQE can split, so a hub of any degree is no hot task. Links with a null
    end are ignored; an empty table gives an empty result.
    """
    links = links.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    stars = scratch.save(links.mapInPandas(_local_stars, "src long, dst long"), "stars")
    if stars.count() <= one_task:
        done = scratch.save(stars.coalesce(1).mapInPandas(_local_stars, "src long, dst long"), "components")
        scratch.drop(stars)
        return done.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return star_components(scratch, stars)


def star_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """As components(), in DataFrame operations only: large-star and small-star rounds until only stars are left."""
    links = links.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    edges = scratch.save(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = scratch.save(small, "small")
        scratch.drop(edges, large)
        edges = after
        # Done when each node has one link, to a node that has none.
        n, nodes_linked = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes_linked and edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    done = nodes.join(edges.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
    return scratch.save(done, "components")


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions df by keys into the session's number of shuffle partitions."""
    return df.repartition(partitions(df.sparkSession), *keys)
