"""Context assembly: parents of the ranked chunks, packed into a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.functions.text import SOURCE_MARK

# A fixed value: the mark after a cut passage.
CUT_MARK = "\n…（超出预算截断）"
# A fixed value: what a code search answers where there is no index.
NO_CODE_INDEX = "（代码索引未加载）"


def expand_parents(ranked: DataFrame, parent: str = "parent") -> DataFrame:
    """Parent texts of a query's chunks in rank order; a text that several chunks share counts once."""
    once = Window.partitionBy("query_id", parent).orderBy("rank")
    first = ranked.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def pack_budget(items: DataFrame, max_chars: int, keys: list[str], order: str = "rank", text: str = "text", mark: str = CUT_MARK) -> DataFrame:
    """Whole items while they fit; the first that does not is cut to the room that is left, and ends the list.

    All before it fitted, so a running sum decides each item on its own.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.length(text)).over(w)
    sized = items.withColumn("__cum", total).withColumn("__room", F.lit(max_chars) - (F.col("__cum") - F.length(text)))
    room = F.col("__room")
    cut = F.when(room > len(mark), F.concat(F.substring(F.col(text), F.lit(1), (room - len(mark)).cast("int")), F.lit(mark))).otherwise(F.substring(F.col(text), F.lit(1), room.cast("int")))
    fits = F.col("__cum") <= max_chars
    kept = sized.where(room >= 0).withColumn(text, F.when(fits, F.col(text)).otherwise(cut)).withColumn("truncated", ~fits)
    # After a cut nothing follows; an item without characters would still have room.
    first_cut = F.min(F.when(F.col("truncated"), F.col(order))).over(Window.partitionBy(*keys))
    return kept.withColumn("__cut", first_cut).where(F.col("__cut").isNull() | (F.col(order) <= F.col("__cut"))).drop("__cum", "__room", "__cut")


def with_header(source: Column, text: Column) -> Column:
    """The source's base name in brackets on a line before the text."""
    return F.concat(F.lit(SOURCE_MARK), F.substring_index(source, "/", -1), F.lit("]\n"), text)


def join_context(packed: DataFrame, keys: list[str], order: str = "rank", text: str = "text") -> DataFrame:
    """One context string a query, items in order with a blank line between."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text))))
    return packed.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n\n").alias("context"), F.count("*").alias("n_items"))


def or_message(queries: DataFrame, contexts: DataFrame | None, message: str = NO_CODE_INDEX) -> DataFrame:
    """(query_id, context) for every query: the message where there is no index to search, '' where the search found nothing."""
    asked = queries.select("query_id")
    if contexts is None:
        return asked.withColumn("context", F.lit(message))
    return asked.join(contexts.select("query_id", "context"), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
