"""Context for a prompt: what fits the budget, and its text by kind of source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.table_tools import token_estimate

#: Kinds of sources in the order of the text, with their headings.
KINDS = (("product", "产品信息"), ("academic", "学术文献"), ("clinical", "临床研究"), ("patent", "专利信息"), ("official", "官方资料"), ("news", "新闻动态"), ("general", "相关知识"))
HEADING, SOURCE = "【检索到的相关知识】\n", "   [来源: "
CHARS_PER_TOKEN, LEAST_LEFT = 4, 50


def truncated(text: Column, tokens: Column) -> Column:
    """The text cut to so many tokens: behind its last 。or line end if that lies in the second half, with an ellipsis."""
    most = (tokens * CHARS_PER_TOKEN).cast("int")
    head = F.substring(text, F.lit(1), most)
    last = lambda mark: F.when(head.contains(mark), F.length(head) - F.locate(mark, F.reverse(head))).otherwise(-1)
    at = F.greatest(last("。"), last("\n"))
    cut = F.when(at > most * 0.5, F.substring(head, F.lit(1), at + 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("...")))


def within_budget(rows: DataFrame, budget: int, by: list[str], order: list, text: str = "text") -> DataFrame:
    """Rows of each group in order while their tokens fit; the first that doesn't is cut to what is left if that is over 50.

    Adds ``tokens`` of the original text and ``used``, the sum before the row.
    """
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counted = rows.withColumn("tokens", token_estimate(F.col(text)))
    counted = counted.withColumn("used", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    left = F.lit(budget) - F.col("used")
    kept = counted.where((F.col("used") <= budget) & ((F.col("tokens") <= left) | (left > LEAST_LEFT)))
    return kept.withColumn(text, F.when(F.col("tokens") <= left, F.col(text)).otherwise(truncated(F.col(text), left)))


def context_text(rows: DataFrame, by: str, order: list[str], kind: str, content: str, title: str, reference: str) -> DataFrame:
    """(by, context): chunks of each group numbered within their kind of source, in the order of :data:`KINDS`.

    Chunks of other kinds don't appear; a null kind is general.
    """
    names = F.create_map(*[F.lit(x) for pair in KINDS for x in pair])
    place = F.array_position(F.array(*[F.lit(k) for k, _ in KINDS]), F.coalesce(kind, F.lit("general")))
    listed = rows.withColumn("__place", place).where("__place > 0")
    within = W.partitionBy(by, "__place").orderBy(*order)
    references = F.concat_ws("; ", F.nullif(title, F.lit("")), F.nullif(reference, F.lit("")))
    line = F.concat(F.lit("\n"), F.col("__n").cast("string"), F.lit(". "), F.coalesce(content, F.lit("")))
    line = F.when(references != "", F.concat_ws("\n", line, F.concat(F.lit(SOURCE), references, F.lit("]")))).otherwise(line)
    line = F.when(F.col("__n") == 1, F.concat(F.lit("\n【"), F.try_element_at(names, F.coalesce(kind, F.lit("general"))), F.lit("】\n"), line)).otherwise(line)
    lines = listed.withColumn("__n", F.row_number().over(within)).select(by, F.struct("__place", "__n", line.alias("line")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n")
    return lines.groupBy(by).agg(F.concat(F.lit(HEADING), F.lit("\n"), joined).alias("context"))


def budget_info(rows: DataFrame, budget: int, by: str, text: str = "text") -> DataFrame:
    """(by, total, within, utilisation): tokens of each group against the budget, utilisation up to 1."""
    total = rows.groupBy(by).agg(F.sum(token_estimate(F.col(text))).alias("total"))
    return total.select(by, "total", (F.col("total") <= budget).alias("within"), F.round(F.least(F.lit(1.0), F.col("total") / budget), 6).alias("utilisation"))
