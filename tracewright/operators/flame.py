"""Flame graphs from folded stacks (stack, count)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cct import prefixes


def stacks(folded: DataFrame, keep_blank: bool = False) -> DataFrame:
    """path and count, equal stacks once; blank frames go unless kept."""
    path = F.split("stack", ";")
    path = path if keep_blank else F.filter(path, lambda x: F.trim(x) != "")
    return folded.select(path.alias("path"), F.col("count").cast("bigint").alias("count")).groupBy("path").agg(F.sum("count").alias("count"))


def tree(folded: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Every frame of the flame graph: path, name, depth, value below it, own value."""
    rows = stacks(folded, keep_blank)
    every = prefixes(rows, "path", ["count"]).groupBy(F.col("prefix").alias("path")).agg(F.sum("count").alias("value"), F.sum(F.when(F.size("prefix") == F.col("full"), F.col("count")).otherwise(0)).alias("self"))
    return every.select("path", F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), "value", "self")


def total(folded: DataFrame) -> DataFrame:
    return folded.agg(F.coalesce(F.sum(F.col("count").cast("bigint")), F.lit(0)).alias("total"))


def _parent():  # noqa: ANN202
    return F.slice("path", 1, F.size("path") - 1)


def children(nodes: DataFrame) -> DataFrame:
    """Frames in their parents' order: heaviest first; frames without value go."""
    w = Window.partitionBy(_parent()).orderBy(F.desc("value"), "name")
    return nodes.where("value > 0").withColumn("rank", F.row_number().over(w))


def layout(nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """x and width of each frame as shares of the whole, siblings side by side, heaviest first.

    A frame's offset within its parent is a running sum over siblings; its x is
    the sum of the offsets along its path, found by joining paths to prefixes.
    """
    every = nodes.where("depth = 1").agg(F.sum("value").alias("all"))
    w = Window.partitionBy(_parent()).orderBy(F.desc("value"), "name").rowsBetween(Window.unboundedPreceding, -1)
    rows = nodes.where("value > 0").withColumn("offset", F.coalesce(F.sum("value").over(w), F.lit(0)))
    up = prefixes(rows.select("path", F.col("path").alias("whole")), "path", ["whole"]).select("whole", F.col("prefix").alias("path"))
    x = up.join(rows.select("path", "offset"), "path").groupBy(F.col("whole").alias("path")).agg(F.sum("offset").alias("x_value"))
    out = rows.join(x, "path").crossJoin(F.broadcast(every))
    out = out.select("path", "name", "depth", "value", "self", (F.col("x_value") / F.col("all").cast("double")).alias("x"), (F.col("value") / F.col("all").cast("double")).alias("width"))
    return out.where(F.col("width") >= least)


def icicle(nodes: DataFrame, least_pct: float = 0.02, most: int = 2000, search: str | None = None) -> DataFrame:
    """The frames worth showing, in depth-first order; those whose name matches a search are marked."""
    every = nodes.where("depth = 1").agg(F.sum("value").alias("all"))
    rows = children(nodes).crossJoin(F.broadcast(every)).where(F.lit(100.0) * F.col("value") / F.col("all") >= least_pct)
    up = prefixes(rows.select("path", F.col("path").alias("whole")), "path", ["whole"]).select("whole", F.col("prefix").alias("path"))
    key = up.join(rows.select("path", "depth", "rank"), "path").groupBy(F.col("whole").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "rank"))), lambda s: s["rank"]).alias("order"))
    hit = F.lit(False) if not search else F.lower("name").contains(search.lower())
    out = rows.join(key, "path").orderBy("order").limit(most)
    return out.select("path", "name", "depth", "value", "self", "order", hit.alias("hit"))


def columns(nodes: DataFrame, width: int) -> list[dict]:
    """Whole columns of a text flame graph: a child gets one at least, the last child what is left.

    Runs on the driver over the frames of an icicle, whose number is bounded.
    """
    rows = {tuple(r["path"]): r for r in icicle(nodes).collect()}
    out: list[dict] = []

    def place(path: tuple, x: int, w: int) -> None:
        kids = sorted((p for p in rows if p[:-1] == path), key=lambda p: rows[p]["order"])
        whole = rows[path]["value"] if path else sum(rows[p]["value"] for p in kids)
        at = x
        for i, kid in enumerate(kids):
            left = x + w - at
            if left <= 0:
                break
            share = left if i == len(kids) - 1 and not (path and rows[path]["self"]) else max(1, int(w * rows[kid]["value"] / whole))
            share = min(share, left)
            out.append({"path": list(kid), "x": at, "width": share, "depth": len(kid)})
            place(kid, at, share)
            at += share

    place((), 0, width)
    return out


def zoom(nodes: DataFrame, path: list[str]) -> DataFrame:
    """The subtree below a frame, with that frame as its root."""
    n = len(path)
    return nodes.where(F.slice("path", 1, n) == F.array(*[F.lit(p) for p in path])).withColumn("path", F.slice("path", n, F.size("path") - n + 1)).withColumn("depth", F.size("path"))


def search(nodes: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """Frames by part of their name or by a regular expression."""
    return nodes.where(F.col("name").rlike(pattern) if regex else F.lower("name").contains(pattern.lower()))


def fold(spans: DataFrame) -> DataFrame:
    """Folded stacks (stack, count) of spans with stacks."""
    rows = spans.where("size(stack_frames) > 0").select(F.array_join(F.reverse("stack_frames"), ";").alias("stack"))
    return rows.groupBy("stack").agg(F.count("*").alias("count"))
