"""Dropping of recurring lines by a fixed-depth template tree, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.llm.common import fresh, passing, written

#: A template recurs if its lines are in so many documents; shorter lines are never dropped.
MIN_DOCS, MIN_TOKENS = 10, 3
#: A line of so many tokens recurs by itself if two documents have it, alike but for tokens with a digit.
LONG_TOKENS = 10
#: Leading tokens that lead to a leaf of the tree, below the token count.
DEPTH = 2
#: Share of a template's tokens that must be constant; of a template that makes one of different lines, the share and the number of
#: tokens after the leading ones (or all of them, if they are fewer).
CONSTANT, CONSTANT_AFTER = 0.5, 2
VARIABLE = "<*>"


def _form(line: Column) -> Column:
    """The line's tokens (between spaces) joined by one space, those with a digit as VARIABLE."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*[0-9][^ ]*", VARIABLE)).otherwise(line)
    return F.trim(F.when(masked.contains("  "), F.regexp_replace(masked, " +", " ")).otherwise(masked))


def _lines(docs: DataFrame, row: Column, id_col: str, text_col: str) -> DataFrame:
    """(row, id, no, form, leaf, long) of the lines that have MIN_TOKENS tokens."""
    lines = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line")).select("row", "id", "no", _form(F.col("line")).alias("form"))
    count = F.length("form") - F.length(F.replace(F.col("form"), F.lit(" "), F.lit(""))) + 1
    variable = (F.length("form") - F.length(F.replace(F.col("form"), F.lit(VARIABLE), F.lit("")))) / len(VARIABLE)
    long = (count >= LONG_TOKENS) & (variable <= count * (1 - CONSTANT))
    return lines.where(count >= MIN_TOKENS).withColumns({"leaf": F.xxhash64(count, F.substring_index("form", " ", DEPTH)), "long": long})


def _shapes(marked: DataFrame) -> DataFrame:
    """(form, template) of the forms that have enough constant tokens for a template."""
    kept = F.when(F.col("constant"), F.col("token")).otherwise(VARIABLE)
    fixed, after = F.col("constant").cast("int"), (F.col("place") >= DEPTH).cast("int")
    shapes = marked.groupBy("form", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("place", kept.alias("token")))).alias("shape"),
        F.avg(fixed).alias("share"),
        F.max((~F.col("constant") & (F.col("token") != VARIABLE)).cast("int")).alias("merged"),
        F.sum(after).alias("after"),
        F.sum(fixed * after).alias("fixed"),
    )
    strict = F.greatest(F.least("after", F.lit(CONSTANT_AFTER)), F.ceil(F.col("after") * CONSTANT))
    return shapes.where(F.col("share") >= CONSTANT).where((F.col("merged") == 0) | (F.col("fixed") >= strict)).select("form", F.xxhash64("leaf", "shape").alias("template"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of `docs`, the text without recurring lines, and a struct `lines`: total and dropped.

    A line goes down a tree by its token count and its leading tokens; tokens with a digit are variable. In a leaf,
    a token is constant at its place if lines of at least `min_docs` documents have it there, else variable; what remains is
    the line's template. A template of which at least half is constant and whose lines are in at least `min_docs` documents
    recurs; if it makes a token variable that has no digit, half of the tokens after the leading ones, two or all of them,
    must be constant as well. Any other line of LONG_TOKENS tokens or more, of which half have no digit, is a template of its own and
    recurs if two documents have it. All lines of a recurring template are dropped but the first (of the least id, null before
    all), and the other lines stay in order.

    Lines that occur often are counted as forms, not compared with each other; only forms of leaves with enough documents are
    taken apart. Null text stays null with 0 lines; an empty text has one line, which stays. Rows alike in id and text count as
    one document and are treated alike; documents whose lines all go keep an empty text. An input column named `lines` is replaced.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    with passing(docs.sparkSession):
        lines = _lines(docs, row, id_col, text_col)
        lines = written(lines.select("row", "id", "no", "leaf", F.xxhash64("leaf", "form").alias("form"), "long", F.col("form").alias("tokens")), "lines")
        slim = lines.drop("tokens")
        leaves = written(slim.select("leaf", "row").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
        held = written(slim.join(leaves, "leaf", "left_semi"), "held")
        counts = held.select("form", "row").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n"))
        wanted = lines.join(leaves, "leaf", "left_semi")
        forms = wanted.groupBy("form").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens"))
        tokens = written(forms.join(counts, "form").select("form", "leaf", "n", F.posexplode(F.split("tokens", " ")).alias("place", "token")), "tokens")
        constant = tokens.where(F.col("token") != VARIABLE).groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("leaf", "place", "token", F.lit(True).alias("constant"))
        marked = tokens.join(constant, ["leaf", "place", "token"], "left").withColumn("constant", F.coalesce("constant", F.lit(False)))
        placed = written(held.join(_shapes(marked), "form").select("template", "form", "id", "row", "no"), "placed")
        once = placed.groupBy("template", "id", "row").agg(F.min("no").alias("no"))
        templates = once.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "no")).alias("first")).where(F.col("n") >= min_docs)
        recurring = placed.join(written(templates, "recurring"), "template")
        settled = written(recurring.select("form").distinct(), "settled")
        alone = slim.where("long").join(settled, "form", "left_anti").select("form", "id", "row", "no")
        shared = alone.groupBy("form").agg(F.min("row").alias("least"), F.max("row").alias("most"), F.min(F.struct("id", "row", "no")).alias("first")).where("least < most")
        same = alone.join(written(shared.select("form", "first"), "same"), "form")
        lost = recurring.select("row", "no", "first").union(same.select("row", "no", "first"))
        gone = lost.where(F.struct("row", "no") != F.struct("first.row", "first.no")).groupBy("row").agg(F.collect_set("no").alias("gone"))
        gone = written(gone, "gone", lasting=True)
    own = fresh(docs, "gone")
    mark = F.col(own)
    every = F.split(F.col(text_col), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), mark["gone"])
    text = F.when(mark.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda k: F.get(every, k)), "\n"))
    found = docs.join(gone.select(F.struct("row", "gone").alias(own)), row == mark["row"], "left")
    total = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(every))
    facts = F.struct(total.alias("total"), F.coalesce(F.size(mark["gone"]), F.lit(0)).alias("dropped"))
    return found.select(*((text if c == text_col else F.col(c)).alias(c) for c in docs.columns if c != "lines"), facts.alias("lines"))
