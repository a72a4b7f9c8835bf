"""Tables in documents: arrays of rows of cells (text, colspan, bg)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

CELL = "struct<text:string,colspan:int,bg:string>"
TABLE = f"array<array<{CELL}>>"
# Period labels, the share of cells at which a table repeats its text, and headings of flattened tables.
PERIOD = r"^M(\+\d+)?$"
REPEATED_FROM = 0.9
HEADING, GANTT_HEADING = "[표]", "[표: 기간표(추진일정 등)로 추정]"
MARKED, SHADED, NO_PERIOD = "시점", "기간", "(표시된 기간 없음)"


def flat_rows(table: Column) -> Column:
    """Non-empty cells joined by bars, non-empty rows by line ends, under a heading; an empty table is an empty string."""
    lines = F.filter(F.transform(table, lambda row: F.array_join(F.transform(F.filter(row, lambda c: F.coalesce(c["text"], F.lit("")) != ""), lambda c: c["text"]), " | ")), lambda line: F.coalesce(line, F.lit("")) != "")
    return F.when(F.size(lines) > 0, F.concat(F.lit(HEADING + "\n"), F.array_join(lines, "\n"))).otherwise(F.lit(""))


def placed(row: Column) -> Column:
    """Cells of a row with the grid columns they take: start and end from running column spans."""
    first = F.struct(F.expr(f"cast(array() as array<struct<text:string,bg:string,start:int,end:int>>)").alias("cells"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        end = s["at"] + F.greatest(F.coalesce(c["colspan"], F.lit(1)), F.lit(1))
        cell = F.struct(F.coalesce(c["text"], F.lit("")).alias("text"), c["bg"].alias("bg"), s["at"].alias("start"), end.alias("end"))
        return F.struct(F.concat(s["cells"], F.array(cell)).alias("cells"), end.alias("at"))

    return F.aggregate(row, first, step, lambda s: s["cells"])


def period_header(table: Column) -> Column:
    """(row from 0, periods) of the first of two rows with at least two period labels; null if there is none."""

    def periods(row: Column) -> Column:
        return F.transform(F.filter(placed(row), lambda c: F.trim(c["text"]).rlike(PERIOD)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.trim(c["text"]).alias("label")))

    rows = F.transform(F.slice(table, 1, 2), lambda row, i: F.struct(i.alias("row"), periods(row).alias("periods")))
    return F.get(F.filter(rows, lambda r: F.size(r["periods"]) >= 2), F.lit(0))


def gantt_lines(tables: DataFrame, key: str = "table_id", column: str = "cells") -> DataFrame:
    """(key, text) of tables with a period header: each row's label and the periods its marked or shaded cells overlap.

    Body rows give up their first cell as a label, so their columns start again at 0, and colours that fill most body
    cells (all of them on a tie, none first) count as background.
    """
    t = tables.select(key, F.col(column).alias("cells"), period_header(F.col(column)).alias("header")).where("header is not null")
    body = t.select(key, F.col("header.periods").alias("periods"), F.posexplode("cells").alias("row", "row_cells"), "header").where("row > header.row and size(row_cells) > 1")
    body = body.select(key, "row", "periods", F.coalesce(F.trim(F.get("row_cells", F.lit(0))["text"]), F.lit("")).alias("label"), placed(F.slice("row_cells", F.lit(2), F.size("row_cells"))).alias("rest")).where("label <> ''")
    cells = body.select(key, "row", "label", "periods", F.posexplode_outer("rest").alias("nth", "cell"))
    color = Window.partitionBy(key)
    by = cells.groupBy(key, F.col("cell.bg").alias("bg")).count().withColumn("most", F.max("count").over(color)).where("count = most")
    by = by.withColumn("blank", F.max(F.col("bg").isNull().cast("int")).over(color)).where("blank = 0 or bg is null").select(key, F.col("bg").alias("base"), F.lit(True).alias("plain"))
    marked = cells.join(by, (cells[key] == by[key]) & F.col("cell.bg").eqNullSafe(F.col("base")), "left").drop(by[key])
    marked = marked.withColumn("text_mark", F.trim(F.coalesce("cell.text", F.lit(""))) != "")
    active = marked.where("cell is not null and (text_mark or plain is null)")
    hit = active.select(key, "row", "nth", "text_mark", F.col("cell.start").alias("a"), F.col("cell.end").alias("b"), F.explode("periods").alias("p")).where("a < p.end and b > p.start")
    found = hit.groupBy(key, "row").agg(F.max("text_mark").alias("mark"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("p.start").alias("s"), F.col("p.label").alias("label")))), lambda x: x["label"])).alias("labels"))
    rows = body.join(found, [key, "row"], "left")
    line = F.when(F.col("labels").isNull(), F.concat("label", F.lit(": " + NO_PERIOD))).otherwise(F.concat("label", F.lit(" ("), F.when(F.col("mark"), MARKED).otherwise(SHADED), F.lit("): "), F.array_join("labels", ", ")))
    lines = rows.select(key, F.struct("row", line.alias("line")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select(key, F.concat(F.lit(GANTT_HEADING + "\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n")).alias("text"))


def repeat_ratio(table: Column, body: Column) -> Column:
    """Share of non-blank cells whose text, white space aside, is in the body already; 0 without such cells."""
    cells = F.filter(F.transform(F.flatten(table), lambda c: T.squeezed(c["text"])), lambda x: x != "")
    inside = F.filter(cells, lambda x: F.contains(T.squeezed(body), x))
    return F.when(F.size(cells) > 0, F.size(inside) / F.size(cells)).otherwise(F.lit(0.0))


def without_repeats(tables: Column, body: Column) -> Column:
    """Tables whose repeat ratio is below the limit; all of them where there is no body."""
    return F.when(F.coalesce(body, F.lit("")) == "", tables).otherwise(F.filter(tables, lambda t: repeat_ratio(t, body) < REPEATED_FROM))


def insert_inline(docs: DataFrame, flat: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "<표>") -> DataFrame:
    """(key, text, inserted): the n-th placeholder line becomes the n-th table, only where both counts agree.

    ``flat`` has (key, nth from 0, table_text).
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("is_mark", F.col("line") == mark)
    lines = lines.withColumn("nth", F.sum(F.col("is_mark").cast("int")).over(Window.partitionBy(key).orderBy("pos")) - 1)
    n = flat.groupBy(key).agg(F.count("*").alias("n_tables"))
    marks = lines.groupBy(key).agg(F.sum(F.col("is_mark").cast("int")).alias("n_marks"))
    fits = marks.join(n, key, "left").select(key, (F.col("n_marks") == F.coalesce("n_tables", F.lit(0))).alias("inserted"))
    out = lines.join(flat.withColumn("is_mark", F.lit(True)), [key, "nth", "is_mark"], "left").join(fits, key)
    line = F.when(F.col("is_mark") & F.col("inserted"), F.col("table_text")).otherwise(F.col("line"))
    return out.groupBy(key, "inserted").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def css_backgrounds(css: Column) -> Column:
    """Class to background colour, from rules of a style sheet."""
    rules = F.regexp_extract_all(css, F.lit(r"\.([\w-]+)\s*\{[^}]*background(?:-color)?\s*:\s*#?[\w]+"), F.lit(0))
    return F.map_from_entries(F.array_distinct(F.transform(rules, lambda r: F.struct(F.regexp_extract(r, r"\.([\w-]+)", 1), F.lower(F.regexp_extract(r, r"background(?:-color)?\s*:\s*(#?\w+)", 1))))))


def table_statistics(docs: DataFrame, note: str = "note", text: str = "text") -> DataFrame:
    """Counts of documents by what their parse notes say about tables, with placeholders left in the text."""
    status = F.when(F.col(note).contains("timeout"), "timeout").when(F.col(note).contains("fail"), "failed").when(F.col(note).contains("no table"), "none").otherwise("ok")
    return docs.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.sum(F.regexp_count(F.col(text), F.lit("(?m)^<표>$"))).alias("placeholders"))
