"""The structure table: a node for each workbook, sheet, region, column, row group, formula cluster, object, header cell, defined name
and for each target of an edge that has no node yet, with parents, children, what it reads and what it can't say.

Everything is a select per kind and one union; joins are within a workbook's sheet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzgrid.functions.a1 import column_letter, to_a1
from quartzgrid.functions.text import display, name_label, node_id, qualified, version_key
from quartzgrid.operators import model
from quartzgrid.operators.documents import CHUNK, _chunk
from quartzgrid.operators.formulas import patterns

SPAN = ("row_lo", "row_hi", "col_lo", "col_hi")
REFERENCE = "struct<target_node_id:string,sheet:string,a1:string,kind:string>"
GAP = "struct<text:string,reason:string>"
NODE = ["node_id", "workbook_id", "version", "version_key", "node_type", "sheet_name", "a1_range", *SPAN, "parent_id", "formula", "display_value", "table_name", "column_name", "named_range", "references", "gaps"]
#: What an object does with the ranges it reads (fixed values).
VERBS = {"chart": "plots", "pivot_table": "summarises", "data_validation": "takes its allowed values or rule from"}
BOOK = ["workbook_id", "version"]


def target_type(kind: Column, a1: Column) -> Column:
    """The type of the node that an edge's target is."""
    return F.when(kind == "table_column", "column").when(kind == "named_range", "named_range").when((kind == "cell") & ~F.contains(a1, F.lit(":")), "cell").otherwise("range")


def _id(kind: Column | str, key: Column) -> Column:
    return node_id(F.col("workbook_id"), F.col("version"), F.lit(kind) if isinstance(kind, str) else kind, key)


def _at(sheet: str = "sheet", a1: str = "a1") -> Column:
    return F.concat(F.col(sheet), F.lit("!"), F.col(a1))


def target_id(sheet: Column, a1: Column, kind: Column) -> Column:
    return _id(target_type(kind, a1), F.concat(sheet, F.lit("!"), a1))


def _node(df: DataFrame, kind: Column | str, own_id: Column, parent: Column, **more: Column) -> DataFrame:
    """Columns NODE; what `more` doesn't give and the frame doesn't have is null."""
    kinds = {"row_lo": "int", "row_hi": "int", "col_lo": "int", "col_hi": "int", "references": f"array<{REFERENCE}>", "gaps": f"array<{GAP}>"}
    given = {"node_id": own_id, "workbook_id": F.col("workbook_id"), "version": F.col("version"), "version_key": version_key(F.col("workbook_id"), F.col("version")), "node_type": F.lit(kind) if isinstance(kind, str) else kind, "parent_id": parent} | more
    return df.select(*(given.get(c, F.col(c) if c in SPAN and c in df.columns else F.lit(None)).cast(kinds.get(c, "int" if c == "version" else "string")).alias(c) for c in NODE))


def read_by(found: DataFrame, keys: list[str]) -> DataFrame:
    """Edges and gaps gathered by `keys`: (keys, references, gaps), each once, in the order of their targets."""
    span = F.struct(*SPAN)
    reference = F.when(F.col("target_sheet").isNotNull(), F.struct(target_id(F.col("target_sheet"), to_a1(span), F.col("kind")).alias("target_node_id"), F.col("target_sheet").alias("sheet"), to_a1(span).alias("a1"), F.col("kind").alias("kind")))
    gap = F.when(F.col("reason").isNotNull(), F.struct(F.col("reference_text").alias("text"), F.col("reason").alias("reason")))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set(reference)).alias("references"), F.array_sort(F.collect_set(gap)).alias("gaps"))


def clusters(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """Formula clusters of a sheet: extent, first formula, size, one member's saved value, and the edges of all members together."""
    named = cells.where("formula IS NOT NULL").join(patterns(cells.select("formula").distinct()), "formula")
    keys = [*BOOK, "sheet", "pattern"]
    first = F.min(F.struct("row", "col", "formula", "display"))
    found = named.groupBy(*keys).agg(F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi"), first.alias("first"), F.count("*").alias("n_cells"))
    own = model.edges_of_cells(cells, facts)
    own = own.join(named.select(*keys, "row", "col"), ["workbook_id", "sheet", "row", "col"])
    spread = own.where("target_sheet IS NOT NULL").groupBy(*keys, "target_sheet", "kind").agg(*(f(c).alias(c) for f, c in ((F.min, "row_lo"), (F.max, "row_hi"), (F.min, "col_lo"), (F.max, "col_hi"))))
    gaps = own.where("reason IS NOT NULL").select(*keys, "reference_text", "reason").distinct()
    together = read_by(spread.unionByName(gaps, allowMissingColumns=True), keys)
    return found.join(together, keys, "left").withColumn("a1", to_a1(F.struct(*SPAN)))


def objects(facts: DataFrame, books: DataFrame) -> DataFrame:
    """Objects of books(workbook_id, version), with what they read; an object without a place sits at A1."""
    found = model.objects(facts).join(books, "workbook_id")
    keys = [*BOOK, "sheet", "object_kind", "name", "anchor"]
    return read_by(found, keys).withColumn("anchor", F.coalesce(F.nullif("anchor", F.lit("")), F.lit("A1")))


def with_parents(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds parent_region, the id of the first region of the sheet that the item's span meets, null where none does."""
    spans = regions.select(*BOOK, "sheet", "region_ix", F.col("a1").alias("region_a1"), F.col("kind").alias("region_kind"), *(F.col(c).alias(f"r_{c}") for c in SPAN))
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*BOOK, "sheet", *SPAN)])
    keyed = items.withColumn("item", key)
    met = keyed.select("item", *BOOK, "sheet", *SPAN).distinct().join(spans, [*BOOK, "sheet"]).where("row_lo <= r_row_hi AND row_hi >= r_row_lo AND col_lo <= r_col_hi AND col_hi >= r_col_lo")
    first = met.groupBy("item").agg(F.min(F.struct("region_ix", *BOOK, "sheet", "region_a1")).alias("r"))
    first = first.select("item", node_id(F.col("r.workbook_id"), F.col("r.version"), F.lit("region"), F.concat("r.sheet", F.lit("!"), "r.region_a1")).alias("parent_region"))
    return keyed.join(first, "item", "left").drop("item")


def header_cells(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """The cells that name a table's columns: the lowest header row's, one a column."""
    tables = regions.where("kind = 'table' AND size(header_rows) > 0")
    columns = tables.select(*BOOK, "sheet", F.col("a1").alias("region_a1"), F.array_max("header_rows").alias("row"), F.explode(F.arrays_zip(F.col("cols").alias("col"), F.col("headers").alias("name"))).alias("c")).select(*BOOK, "sheet", "region_a1", "row", F.col("c.col").alias("col"), F.col("c.name").alias("column_name"))
    return columns.join(cells.select(*BOOK, "sheet", "row", "col", "display"), [*BOOK, "sheet", "row", "col"], "left")


def structure(cells: DataFrame, regions: DataFrame, facts: DataFrame) -> DataFrame:
    """cells(workbook_id, version, sheet, row, col, kind, num, str, ts, formula, display), regions with version, facts as the reader gives them -> NODE and child_ids.

    A node that several kinds would give is given once, by the first of them. Targets of edges on sheets that aren't there get no node.
    """
    books = cells.select(*BOOK).distinct()
    known = model.of_workbooks(facts).join(books, "workbook_id")
    here = known.drop("version")  # facts have no version of their own: a workbook's cells say it
    sheet_id = lambda sheet="sheet": _id("sheet", F.col(sheet))
    book_id = _id("workbook", F.col("workbook_id"))
    parts = [_node(books, "workbook", book_id, F.lit(None))]
    sheets = known.where(F.col("fact").isin("sheet", "macro_sheet"))
    span = F.struct(*SPAN)
    parts.append(_node(sheets, "sheet", sheet_id(), book_id, sheet_name=F.col("sheet"), a1_range=F.when(F.col("fact") == "sheet", to_a1(span)).otherwise("")))
    region_id = _id("region", _at())
    tables = known.where("fact = 'table'").select(*BOOK, "sheet", F.col("name").alias("table_name"), *(F.col(c).alias(f"t_{c}") for c in SPAN))
    inside = regions.join(tables, [*BOOK, "sheet"]).where("t_row_lo >= row_lo AND t_row_hi <= row_hi AND t_col_lo >= col_lo AND t_col_hi <= col_hi").groupBy(*BOOK, "sheet", "a1").agg(F.min("table_name").alias("table_name"))
    named = regions.join(inside, [*BOOK, "sheet", "a1"], "left")
    parts.append(_node(named, F.when(F.col("kind") == "table", "table").otherwise("region"), region_id, sheet_id(), sheet_name=F.col("sheet"), a1_range=F.col("a1"), table_name=F.col("table_name")))
    columns = named.where("kind = 'table'").select("*", F.explode(F.arrays_zip(F.col("cols").alias("col"), F.col("headers").alias("name"))).alias("c"))
    first_row = F.coalesce(F.array_max(F.concat("header_rows", F.array(F.coalesce(F.col("units_row"), F.lit(0))))), F.col("row_lo") - 1) + 1
    columns = columns.select(*BOOK, "sheet", "a1", "table_name", first_row.alias("first"), "row_hi", F.col("c.col").alias("col"), F.col("c.name").alias("column_name")).select("*", F.col("first").alias("row_lo"), F.col("col").alias("col_lo"), F.col("col").alias("col_hi"))
    parts.append(_node(columns, "column", _id("column", F.concat("sheet", F.lit("!"), to_a1(span))), region_id, sheet_name=F.col("sheet"), a1_range=to_a1(span), table_name=F.col("table_name"), column_name=F.col("column_name")))
    formulas = with_parents(clusters(cells, here), regions)
    own_kind = F.when(F.col("n_cells") == 1, "formula").otherwise("range")
    parts.append(_node(formulas, own_kind, _id("formula", _at()), F.coalesce("parent_region", sheet_id()), sheet_name=F.col("sheet"), a1_range=F.col("a1"), formula=F.col("first.formula"), display_value=F.when(F.col("n_cells") == 1, F.col("first.display")), references=F.col("references"), gaps=F.col("gaps")))
    drawn = objects(here, books)
    parts.append(_node(drawn, F.col("object_kind"), _id(F.col("object_kind"), F.concat("sheet", F.lit("!"), "name")), sheet_id(), sheet_name=F.col("sheet"), a1_range=F.col("anchor"), references=F.col("references"), gaps=F.col("gaps")))
    heads = with_parents(header_cells(cells, regions).select("*", *(F.col(c).alias(n) for n, c in zip(SPAN, ("row", "row", "col", "col")))), regions)
    cell_a1 = F.concat(column_letter(F.col("col")), F.col("row").cast("string"))
    parts.append(_node(heads, "cell", _id("cell", F.concat("sheet", F.lit("!"), cell_a1)), F.coalesce("parent_region", sheet_id()), sheet_name=F.col("sheet"), a1_range=cell_a1, display_value=F.col("display"), column_name=F.col("column_name")))
    defined = model.names(here).join(books, "workbook_id").withColumn("a1", to_a1(span))
    to_target = F.when(F.col("resolved"), F.array(F.struct(target_id(F.col("target_sheet"), F.col("a1"), F.when(F.contains("a1", F.lit(":")), "range").otherwise("cell")).alias("target_node_id"), F.col("target_sheet").alias("sheet"), F.col("a1").alias("a1"), F.when(F.contains("a1", F.lit(":")), "range").otherwise("cell").alias("kind"))))
    missing = F.when(~F.col("resolved"), F.array(F.struct(F.col("target").alias("text"), F.col("detail").alias("reason"))))
    parts.append(_node(defined, "named_range", _id("named_range", name_label(F.col("name"), F.col("scope_sheet"))), F.when(F.col("resolved"), sheet_id("target_sheet")).otherwise(book_id), sheet_name=F.col("target_sheet"), a1_range=F.col("a1"), named_range=F.col("name"), references=to_target, gaps=missing))
    held = reduce(lambda a, b: a.unionByName(b), [p.withColumn("place", F.lit(k)) for k, p in enumerate(parts)])
    held = held.unionByName(dangling_targets(held, sheets, regions).withColumn("place", F.lit(len(parts))))
    once = held.groupBy("node_id").agg(F.min_by(F.struct(*NODE), "place").alias("n")).select("n.*")
    return with_children(once)


def dangling_targets(held: DataFrame, sheets: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes for targets of edges that no node stands for, each once; targets on sheets that aren't there, or are macro sheets, get none."""
    reads = held.select(*BOOK, F.explode("references").alias("r")).select(*BOOK, F.col("r.target_node_id").alias("node_id"), F.col("r.sheet").alias("sheet"), F.col("r.a1").alias("a1"), F.col("r.kind").alias("kind")).distinct()
    loose = reads.join(held.select("node_id"), "node_id", "left_anti").join(sheets.where("fact = 'sheet'").select(*BOOK, "sheet"), [*BOOK, "sheet"], "left_semi")
    from quartzgrid.functions.a1 import parse_a1

    spanned = loose.withColumn("s", parse_a1(F.col("a1"))).select("*", *(F.col(f"s.{c}").alias(c) for c in SPAN)).drop("s")
    placed = with_parents(spanned.where("row_lo IS NOT NULL"), regions)
    return _node(placed, target_type(F.col("kind"), F.col("a1")), F.col("node_id"), F.coalesce("parent_region", _id("sheet", F.col("sheet"))), sheet_name=F.col("sheet"), a1_range=F.col("a1"))


def with_children(nodes: DataFrame) -> DataFrame:
    """child_ids in the order of ids; a workbook's nodes are bounded by the document ceiling."""
    children = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("node_id")).alias("child_ids"))
    return nodes.join(children, "node_id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))


def edges(nodes: DataFrame) -> DataFrame:
    """(src, dst, sheet_name, span, kind): the structure's references as rows, for expansion and for dependents."""
    from quartzgrid.functions.a1 import parse_a1

    each = nodes.select(F.col("node_id").alias("src"), "workbook_id", "version_key", F.explode("references").alias("r"))
    return each.withColumn("s", parse_a1(F.col("r.a1"))).select("src", F.col("r.target_node_id").alias("dst"), "workbook_id", "version_key", F.col("r.sheet").alias("sheet_name"), *(F.col(f"s.{c}").alias(c) for c in SPAN), F.col("r.kind").alias("kind"))


def gaps(nodes: DataFrame) -> DataFrame:
    """(node_id, text, reason)."""
    return nodes.select("node_id", F.explode("gaps").alias("g")).select("node_id", "g.text", "g.reason")


# ---- chunks of what isn't a cell or a region -------------------------------------------


def _listed(references: Column, with_kind: bool = False) -> Column:
    one = lambda r: F.concat(qualified(r["sheet"], r["a1"]), F.concat(F.lit(" ("), r["kind"], F.lit(")")) if with_kind else F.lit(""))
    return F.array_join(F.array_distinct(F.transform(references, one)), ", ")


def _unresolved(gaps_: Column) -> Column:
    return F.array_join(F.transform(gaps_, lambda g: F.concat(g["text"], F.lit(" ("), g["reason"], F.lit(")"))), ", ")


def _sentence(test: Column, *parts: Column | str) -> Column:
    return F.when(test, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def formula_chunks(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """One chunk a cluster: where, what, how often, what it reads, what stays unresolved."""
    found = clusters(cells, facts)
    content = F.concat_ws(" ", _sentence(F.lit(True), "Formulas on worksheet ", F.col("sheet"), " at ", F.col("a1"), " compute: ", F.col("first.formula"), "."), _sentence(F.col("n_cells") > 1, "This pattern repeats across ", F.col("n_cells").cast("string"), " cells."), _sentence(F.size("references") > 0, "Reads: ", _listed(F.col("references"), True), "."), _sentence(F.size("gaps") > 0, "Unresolved: ", _unresolved(F.col("gaps")), "."))
    title = F.concat(F.when(F.col("n_cells") > 1, "Formula pattern ").otherwise("Formula in "), "sheet", F.lit(" "), "a1")
    return _chunk(found, "formula_summary", _at(), F.col("sheet"), F.col("a1"), title, content)


def object_line(kind: Column, name: Column, at: Column, references: Column, gaps_: Column) -> Column:
    """An object in one line: what and where it is, what it does with the ranges it reads."""
    verb = F.coalesce(*(F.when(kind == k, v) for k, v in VERBS.items()), F.lit("reads"))
    label = F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" "), name)
    return F.concat(label, F.when(kind == "data_validation", " applies to ").otherwise(" sits at "), at, F.lit("."), F.coalesce(_sentence(F.size(references) > 0, " It ", verb, " ", _listed(references), "."), F.lit("")), F.coalesce(_sentence(F.size(gaps_) > 0, " Unresolved: ", _unresolved(gaps_), "."), F.lit("")))


def object_chunks(facts: DataFrame, books: DataFrame) -> DataFrame:
    found = objects(facts, books)
    line = object_line(F.col("object_kind"), F.col("name"), qualified(F.col("sheet"), F.col("anchor")), F.col("references"), F.col("gaps"))
    made = _chunk(found, "object", F.concat("sheet", F.lit("!"), "name"), F.col("sheet"), F.col("anchor"), F.concat("object_kind", F.lit(" "), "name", F.lit(" on "), "sheet"), line)
    kinds = found.select(_id("object", F.concat("sheet", F.lit("!"), "name")).alias("node_id"), "object_kind", _id(F.col("object_kind"), F.concat("sheet", F.lit("!"), "name")).alias("own"))
    return made.join(kinds, "node_id").withColumns({"chunk_type": F.col("object_kind"), "node_id": F.col("own")}).select(*CHUNK)


def name_chunks(facts: DataFrame, books: DataFrame) -> DataFrame:
    found = model.names(facts).join(books, "workbook_id").withColumn("a1", to_a1(F.struct(*SPAN)))
    label = name_label(F.col("name"), F.col("scope_sheet"))
    content = F.when(F.col("resolved"), F.concat(F.lit("Named range "), label, F.lit(" is "), qualified(F.col("target_sheet"), F.col("a1")), F.lit("."))).otherwise(F.concat(F.lit("Named range "), label, F.lit(" is no static range: "), F.coalesce("detail", F.lit("unresolved")), F.lit(".")))
    return _chunk(found, "named_range", label, F.col("target_sheet"), F.col("a1"), label, content)


def macro_sheet_chunks(facts: DataFrame, books: DataFrame) -> DataFrame:
    found = model.of_workbooks(facts).where("fact = 'macro_sheet'").join(books, "workbook_id")
    content = F.concat(F.lit("Sheet "), "sheet", F.lit(" is a macro sheet; its cells are not loaded or run, and references to it are gaps (macro_sheet)."))
    return _chunk(found, "sheet", F.col("sheet"), F.col("sheet"), F.lit(""), F.concat(F.lit("Macro sheet "), "sheet"), content)


def shown(kind: str = "kind", num: str = "num", text: str = "str", when: str = "ts") -> Column:
    """A cell's display column, from the reader's columns."""
    return display(F.col(kind), F.col(num), F.col(text), F.col(when))
