"""Near duplicates of embeddings by an exact metric range join.

Between unit vectors a cosine of at least c is a distance of at most r = sqrt(2 - 2c), so the join is a range join in a
metric space. Pivots chosen from the vectors of a label cut them into cells, each vector at home in the cell of its nearest
pivot. A vector visits a foreign cell only where the triangle inequality allows a member within r: the cell's pivot is
no further than the cell's radius plus r, and no further than the own pivot plus 2r. Each cell then joins its visitors with its
members independently, in blocks: a cell of any size, also one that cannot be cut as all its vectors are close, is
spread over tasks of bounded memory. Blocks count links and name one component edge per vector; no list of pairs exists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import components
from codefacts.session import cut_lineage

COSINE = 0.93
#: Pivots of a label at most; larger cells are cut into blocks.
PIVOTS = 32
#: Vectors of one block.
BLOCK = 2_048
#: A label's vectors are dealt over so many parts for the assignment.
SALTS = 32
_SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ y.T))


def usable(vector: str = "embedding") -> Column:
    """True where a row may link: id, label and a vector without nulls and non-finite numbers, not zero, not empty."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    return known & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _assigned(r: float):
    """Home cell and visits of each vector of a label, given the label's pivots."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for _, group in frame.groupby(["label", "dim"]):
                pivots = _unit(group["pivots"].iloc[0])
                kept = [0]  # a pivot within r of an earlier one cuts no new cell
                for i in range(1, len(pivots)):
                    if _distances(pivots[i : i + 1], pivots[kept]).min() > r:
                        kept.append(i)
                far = _distances(_unit(group["embedding"]), pivots[kept])
                home = far.argmin(axis=1)
                out.append(pd.DataFrame({"node": group["node"], "label": group["label"], "dim": group["dim"], "embedding": group["embedding"], "copies": group["copies"], "cell": home, "near": far.min(axis=1), "far": list(far)}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["node", "label", "dim", "embedding", "copies", "cell", "near", "far"])

    return rows


def _joined(cosine: float):
    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        members = frame[frame["member"]]
        visitors = frame[~frame["member"]]
        if members.empty or visitors.empty:
            return pd.DataFrame({"node": [], "links": [], "least": []}).astype({"node": "int64", "links": "int64", "least": "int64"})
        v, m = _unit(visitors["embedding"]), _unit(members["embedding"])
        linked = v @ m.T >= cosine
        mine, theirs, copies = visitors["node"].to_numpy(), members["node"].to_numpy(), members["copies"].to_numpy()
        linked &= mine[:, None] != theirs[None, :]
        links = linked @ copies
        top = np.iinfo(np.int64).max
        low_m = np.where(linked, mine[:, None], top).min(axis=0)  # smallest visitor of each member
        low_v = np.where(linked, theirs[None, :], top).min(axis=1)  # smallest member of each visitor
        label_v, label_m = np.minimum(mine, low_v), np.minimum(theirs, low_m)
        while True:  # smallest label in the block's own components
            new_v = np.minimum(label_v, np.where(linked, label_m[None, :], top).min(axis=1))
            new_m = np.minimum(label_m, np.where(linked, new_v[:, None], top).min(axis=0))
            if (new_v == label_v).all() and (new_m == label_m).all():
                break
            label_v, label_m = new_v, new_m
        return pd.concat([
            pd.DataFrame({"node": mine, "links": links, "least": label_v})[lambda x: (x["links"] > 0)],
            pd.DataFrame({"node": theirs, "links": np.zeros(len(theirs), np.int64), "least": label_m})[lambda x: x["least"] < x["node"]],
        ])

    return rows


def linked(vectors: DataFrame, cosine: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links`` (other vectors with the same label and a cosine of at least ``cosine``), ``component_id``, ``kept``.

    One row per row of ``vectors`` (vec_id, embedding, label); other columns are ignored. The cosine is in double precision.
    Vectors that are null, empty, zero or hold null or non-finite numbers, and vectors with a null label or a null id, link
    with nothing; vectors of different length never link. Equal vectors of one label collapse to one node first and link
    with each other. The component of a row is the smallest vec_id reachable, itself included. An empty table gives no rows.
    """
    r = math.sqrt(2 - 2 * cosine) + _SLACK
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = rows.where(usable())
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = cut_lineage(nodes.select("node", "label", F.size("embedding").alias("dim"), "embedding", "copies"))
    drawn = nodes.select("label", "dim", F.struct(F.xxhash64("node").alias("h"), "node", "embedding").alias("p"), F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).alias("s"))
    # the pivots are the smallest hashes, picked in two steps so that no task holds a label
    part = _least(drawn, ["label", "dim", "s"], pivots)
    chosen = _least(part.drop("s"), ["label", "dim"], pivots).groupBy("label", "dim").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    chosen = chosen.select("label", "dim", F.col("ps.embedding").alias("pivots"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    schema = "node bigint, label int, dim int, embedding array<double>, copies bigint, cell int, near double, far array<double>"
    schema = schema.replace("label int", f"label {dict(vectors.dtypes)['label']}")
    homes = cut_lineage(salted.join(chosen, ["label", "dim", "salt"]).drop("salt").mapInPandas(_assigned(r), schema))
    cells = homes.groupBy("label", "dim", "cell").agg(F.max("near").alias("radius"), F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / block).cast("int")
    key = ["label", "dim", "cell"]
    members = homes.join(cells.select(*key, parts.alias("parts")), key).select("node", *key, "embedding", "copies", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("mine"))
    visits = homes.select("node", "label", "dim", "embedding", "copies", "near", F.col("cell").alias("home"), F.posexplode("far").alias("cell", "d")).where(F.col("d") <= F.col("near") + 2 * r)
    visits = visits.join(cells, key).where(F.col("d") <= F.col("radius") + r)
    guests = visits.groupBy(*key).agg(F.count("*").alias("guests")).join(cells.select(*key, parts.alias("parts")), key).select(*key, F.ceil(F.col("guests") / block).cast("int").alias("rows_of"), F.col("parts").alias("cols_of"))
    left = visits.select("node", *key, "embedding", "copies").join(guests, key)
    left = left.select("node", *key, "embedding", "copies", F.lit(False).alias("member"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("rows_of")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols_of") - 1)).alias("j"))
    right = members.join(guests, key).select("node", *key, "embedding", "copies", F.lit(True).alias("member"), F.explode(F.sequence(F.lit(0), F.col("rows_of") - 1)).alias("i"), F.col("mine").alias("j"))
    found = cut_lineage(left.unionByName(right).groupBy(*key, "i", "j").applyInPandas(_joined(cosine), "node bigint, links bigint, least bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = nodes.join(counts, "node", "left").join(placed, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    known = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return known.unionByName(alone)


def _least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` smallest ``p`` of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("p"))).where(F.col("_n") <= n).drop("_n")
