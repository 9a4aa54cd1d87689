"""Operator 10, sharding by vector bin packing.

Documents go to shards in groups (by GROUP_BY), so that bytes, tokens and rows are balanced jointly. Each group is
placed, largest first, on the shard where the dot product of its needs with the residual capacity is highest, of
those where it fits; where it fits nowhere, on the one that it overfills least.

Every group that fits a shard stays whole and is placed by its own needs; one that exceeds a shard is cut by a hash of
its documents into pieces of about 1/SPLIT of a shard. All shards are looked at for each item, at any size. The driver
holds a record for each group or piece and one for each shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlane.llm.common import materialize, text_key
from siftlane.llm.mixing import token_count

GROUP_BY = ("source", "lang")
TARGET_BYTES = 32 << 20
SPLIT = 8


def place(needs: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; needs: items x dimensions, in parts of a shard's capacity.

    Items go largest first (by their largest need; of equal ones the first). Of equally good shards the first is
    taken. Shards are looked at in groups of about sqrt(shards): a group's largest residuals bound what any of its
    shards can offer, so that only groups which may hold the best are opened.
    """
    width = max(1, int(np.sqrt(shards)))
    groups = -(-shards // width)
    residual = np.full((groups * width, needs.shape[1]), -np.inf)
    residual[:shards] = 1
    residual = residual.reshape(groups, width, -1)
    most = residual.max(1)
    out = np.zeros(len(needs), np.int64)
    dot = lambda r, need: sum((r[..., d] * x for d, x in enumerate(need) if x), np.zeros(r.shape[:-1]))
    for i in np.lexsort((np.arange(len(needs)), -needs.max(1, initial=0))):
        need = needs[i]
        roomy = (most - need).min(1) >= -1e-12
        best = _best(np.where(roomy, dot(most, need), -np.inf), lambda g: np.where((residual[g] - need).min(1) >= -1e-12, dot(residual[g], need), -np.inf))  # noqa: B023
        if best is None:
            best = _best((most - need).min(1), lambda g: (residual[g] - need).min(1))  # noqa: B023
        g, s = best
        residual[g, s] -= need
        most[g] = residual[g].max(0)
        out[i] = g * width + s
    return out


def _best(bound: np.ndarray, values) -> tuple[int, int] | None:
    """(group, place) of the first of the highest values; bound: of each group's values. None if all are -inf."""
    bound, found, value = bound.copy(), None, -np.inf
    while True:
        g = int(bound.argmax())
        if bound[g] == -np.inf or bound[g] < value or (found is not None and bound[g] == value and g > found[0]):
            return found
        v = values(g)
        s = int(v.argmax())
        if v[s] > value or (v[s] == value and found is not None and g < found[0]):
            found, value = (g, s), v[s]
        bound[g] = -np.inf


def shard(docs: DataFrame, group_by: tuple[str, ...] = GROUP_BY, target_bytes: int = TARGET_BYTES, split: int = SPLIT) -> DataFrame:
    """doc_id and shard (from 0) of every row of docs; as many shards as target_bytes of text asks for.

    Groups that fit a shard in bytes, tokens and rows stay together and are placed by their own needs; one that exceeds
    a shard is cut by a hash of its rows' doc_id and text into pieces of about 1/split of a shard. Of equal items the one
    with the lesser hash of its group goes first. A null in a group column is a value like any other. Null and empty
    texts have no bytes and no tokens, but count as rows; a very long text is one row and overfills a shard alone. Null
    doc_ids and repeated rows are placed like any other row; rows that repeat doc_id and text share a shard. Other
    columns are ignored. An empty table gives none.
    """
    key = F.to_json(F.struct(*(F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_by))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id", text_key()).alias("h"),
        F.xxhash64(key).alias("item"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        token_count().alias("tokens"),
    )
    rows = materialize(rows, "sizes")
    dims = ("bytes", "tokens", "n")
    sums = (F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    groups = materialize(rows.groupBy("item").agg(*sums), "groups")
    total = groups.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in dims)).first()
    shards = max(1, -(-total["bytes"] // target_bytes))
    share = F.greatest(*(F.col(d) * float(shards) / max(1, total[d]) for d in dims))
    groups = groups.select("item", F.when(share > 1 + 1e-9, F.ceil(share * split)).otherwise(F.lit(1).cast("long")).alias("parts"))
    rows = rows.join(groups, "item").withColumn("part", F.pmod("h", "parts"))
    # five numbers an item come to the driver, texts and keys never
    listed = rows.groupBy("item", "part").agg(*sums).orderBy("item", "part").toArrow()
    needs = np.stack([listed.column(d).to_numpy() * shards / max(1, total[d]) for d in dims], axis=1)
    placed = docs.sparkSession.createDataFrame(listed.select(["item", "part"]).append_column("shard", pa.array(place(needs, shards), pa.int64())))
    return rows.join(placed, ["item", "part"]).select("doc_id", "shard")
