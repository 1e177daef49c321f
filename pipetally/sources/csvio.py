"""CSV import with row-level validation, and byte-exact CSV export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pipetally.functions.texts import or_else, trimmed
from pipetally.operators.changes import append_rows
from pipetally.operators.validation import Rule, application_rules, validate
from pipetally.sources.folders import stored

# The exported columns in order, and those that an import needs.
HEADER = {
    "Company Name": "company_name", "Position Title": "position_title", "Application Date": "application_date", "Status": "status", "Location": "location",
    "Salary Range": "salary_range", "Application Method": "application_method", "Job Description": "job_description", "Notes": "notes",
}
NEEDED = ["company name", "position title", "application date", "status"]
#: A quoted record may be so many bytes long.
LONGEST_RECORD = 16 << 20


def fields(line: Column) -> Column:
    """The trimmed fields of one line: a quote toggles quoting anywhere, a doubled one inside quotes is a quote."""
    # a field is plain runs and quoted runs; a quote left open runs to the end of the line
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',((?:[^",]++|"(?:[^"]|"")*+(?:"|$))*+)'), F.lit(1))
    return F.transform(found, lambda x: trimmed(F.replace(F.regexp_replace(x, r'"((?:[^"]|"")*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"'))))


def quoted_records(lines: DataFrame, order: Column, file: str, block: str, longest: int = LONGEST_RECORD) -> DataFrame:
    """(value, file, block, at, fault): the records of files in which a quoted field may hold newlines.

    ``lines`` are physical lines; ``block`` parts a file into runs of lines, in order (the splits of a read), and
    ``order`` orders the lines of a block.  Whether a line begins inside quotes follows from the number of
    quotes before it.  So blocks count their lines with an odd number of quotes; the sums over the blocks
    before (one row a block) carry the state over; and the odd lines, numbered through the file, open and
    close its records in turn.  No task reads a whole file.  Lines that are a record by themselves stay
    where they are, and only the lines of the others meet, at the place (``block``, ``at``) of their first.

    A quote that is never closed makes the rest of its file one record.  A record of more than ``longest``
    bytes is not put together: it has its first line as ``value`` and a ``fault``, and all others have null.
    """
    w = W.partitionBy(file, block).orderBy("__order")
    text = F.coalesce("value", F.lit(""))
    odd = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2
    rows = lines.select(text.alias("value"), file, block, order.alias("__order"), odd.cast("long").alias("__odd"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(file).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(file, block).agg(F.sum("__odd").alias("__c")).select(file, block, before.alias("__before"))
    rows = rows.withColumns({"at": F.row_number().over(w), "__upto": F.sum("__odd").over(w)}).join(counts, [file, block])
    upto = F.col("__upto") + F.col("__before")
    rows = rows.select("value", file, block, "at", upto.alias("__upto"), (upto % 2 == 1).alias("__open"), ((upto - F.col("__odd")) % 2 == 1).alias("__inside"))
    rows = stored(rows, "csv-lines")  # read three times below
    fault = F.lit(None).cast("string")
    single = rows.filter("not __open and not __inside").select("value", file, block, "at", fault.alias("fault"))
    # an odd line opens a record, the next one closes it
    parts = rows.filter("__open or __inside").withColumn("__record", F.call_function("div", F.col("__upto") + 1, F.lit(2)))
    place = F.struct(F.col(block).alias("block"), "at", "value")
    sizes = parts.groupBy(file, "__record").agg(F.sum(F.octet_length("value") + 1).alias("__bytes"), F.min(place).alias("__first"))
    short = parts.join(sizes.filter(F.col("__bytes") <= longest).select(file, "__record"), [file, "__record"])
    whole = short.groupBy(file, "__record").agg(F.sort_array(F.collect_list(place)).alias("__lines"))
    first = lambda c: c["block"].alias(block)
    whole = whole.select(F.array_join(F.transform("__lines", lambda z: z["value"]), "\n").alias("value"), file, first(F.col("__lines")[0]), F.col("__lines")[0]["at"].alias("at"), fault.alias("fault"))
    long = sizes.filter(F.col("__bytes") > longest).select(
        "__first.value", file, first(F.col("__first")), "__first.at", F.concat(F.lit("record of "), F.col("__bytes").cast("string"), F.lit(f" bytes, more than {longest}: is a quote left open?")).alias("fault"))
    return single.unionByName(whole).unionByName(long)


def numbered_lines(lines: DataFrame, order: Column | None = None, file: str | None = None, block: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """(file, line, n) of the lines that are not blank, from 1 in every file, and the columns ``keep``.

    ``file`` names the column that tells files apart (none: all are one file).  Lines follow ``order``, or
    the order in which a task reads them.  ``block`` columns, in order, part a file further (as ``read_csv_rows``
    does by split), so that no task numbers a whole file: each block starts after the lines of those before it.
    """
    rows = lines.filter(trimmed(F.col("value")) != "").select(
        (F.col(file) if file else F.lit("")).alias("file"), F.col("value").alias("line"), (F.monotonically_increasing_id() if order is None else order).alias("at"), *block, *keep)
    n = F.row_number().over(W.partitionBy("file", *block).orderBy("at"))
    if not block:
        return rows.withColumn("n", n).select("file", "line", "n", *keep)
    counts = rows.groupBy("file", *block).agg(F.count("*").alias("c"))  # one row a block
    before = F.coalesce(F.sum("c").over(W.partitionBy("file").orderBy(*block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", *block, before.alias("before"))
    return rows.withColumn("n", n).join(starts, ["file", *block]).select("file", "line", (F.col("n") + F.col("before")).cast("int").alias("n"), *keep)


def parse_applications(lines: DataFrame, rules: list[Rule] | None = None, order: Column | None = None, file: str | None = None, block: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of files of applications, both with ``file``: one bad row rejects its file whole.

    A missing header or required column is an error of the file.  Unknown columns are ignored, the last of
    repeated ones counts, short rows are padded with empty texts, and rows are named by their place among
    the lines that are not blank.  Lines with a ``fault`` (of ``quoted_records``) are errors of that row.
    """
    faults = ["fault"] if "fault" in lines.columns else []
    # numbered, split and checked once, whatever is read of them below
    rows = stored(numbered_lines(lines, order, file, block, faults).withColumn("f", fields(F.col("line"))).drop("line"), "csv-fields")
    head = rows.filter("n = 1").select("file", F.transform("f", lambda h: F.lower(trimmed(h))).alias("h"))
    have = F.array(*[F.lit(x) for x in NEEDED])
    # where a file has each column, found once a file
    place = {c: F.when(F.array_contains("h", t.lower()), (F.size("h") - F.array_position(F.reverse("h"), F.lit(t.lower()))).cast("int")) for t, c in HEADER.items()}
    places = head.select("file", F.struct(*[at.alias(c) for c, at in place.items()]).alias("p"))
    data = rows.filter("n > 1").join(places, "file").select("file", "n", "f", "p", *faults)

    def named(column: str) -> Column:
        at = F.col("p")[column]
        return F.when(at.isNotNull(), F.coalesce(F.get("f", at), F.lit("")))

    parsed = data.select("file", "n", *[named(c).alias(c) for c in HEADER.values()], *faults)
    checked = validate(parsed, application_rules() if rules is None else rules)
    if faults:
        checked = checked.withColumn("errors", F.when(F.col("fault").isNull(), F.col("errors")).otherwise(F.array("fault"))).drop("fault")
    checked = stored(checked, "csv-checked")
    missing = head.select("file", F.array_except(have, F.col("h")).alias("m")).filter(F.size("m") > 0)
    missing = missing.select("file", F.lit(0).alias("n"), F.concat(F.lit("Missing required columns: "), F.array_join("m", ", ")).alias("message"))
    filled = F.count(F.when(trimmed(F.col("value")) != "", 1)).alias("c")
    few = lines.groupBy(F.col(file).alias("file")).agg(filled) if file else lines.agg(filled).withColumn("file", F.lit(""))
    few = few.filter("c < 2").select("file", F.lit(0).alias("n"), F.lit("CSV file must contain headers and at least one data row").alias("message"))
    bad = checked.filter(F.size("errors") > 0).select("file", "n", F.concat(F.lit("Row "), F.col("n").cast("string"), F.lit(": "), F.array_join("errors", ", ")).alias("message"))
    whole = few.unionByName(missing)
    errors = whole.unionByName(bad.join(whole.select("file"), "file", "left_anti"))
    good = checked.drop("errors").join(errors.select("file"), "file", "left_anti")
    return good, errors


def read_csv_rows(spark: SparkSession, path: str, rules: list[Rule] | None = None, multi_line: bool = False, longest: int = LONGEST_RECORD) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of the file, or of each file, at ``path``; large files are numbered by split.

    A newline ends a row, quoted or not, unless ``multi_line``; then quoted ones belong to their field, and a
    row of more than ``longest`` bytes is an error.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    if not multi_line:
        return parse_applications(lines, rules, file="path", block=["start"])
    # a task reads the lines of a split in order, so this order is the same in every evaluation
    records = stored(quoted_records(lines, F.monotonically_increasing_id(), "path", "start", longest), "csv-records")
    return parse_applications(records, rules, order=F.col("at"), file="path", block=["start"])


def import_applications(apps: DataFrame, rows: DataFrame, user_id: Column, as_of: Column | None = None) -> DataFrame:
    """``apps`` and the parsed ``rows`` as new applications of a tenant; the columns that a table lacks are left out."""
    new = rows.drop("file", "n").withColumns({"user_id": user_id, "application_date": F.col("application_date").try_cast("date")})
    return append_rows(apps, new.select(*[c for c in new.columns if c in apps.columns]), as_of)


def csv_line(df: DataFrame, compat: bool = False) -> Column:
    """One export line.  ``compat`` doubles quotes in the last two columns only, as the tracked application does."""

    def quoted(c: str, double: bool) -> Column:
        text = or_else(F.col(c).cast("string"), "") if c in df.columns else F.lit("")
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')) if double else text, F.lit('"'))

    cols = [
        F.coalesce(F.col(c).cast("string"), F.lit("")) if c == "application_date" else quoted(c, not compat or c in ("job_description", "notes")) for c in HEADER.values()
    ]
    return F.concat_ws(",", *cols)


def csv_lines(df: DataFrame, compat: bool = False) -> DataFrame:
    """(value) of each row; ``csv_header`` goes before it."""
    return df.select(csv_line(df, compat).alias("value"))


def csv_header() -> str:
    return ",".join(HEADER)


def write_csv_parts(df: DataFrame, path: str, order: list[Column], compat: bool = False) -> None:
    """The export as ordered text files, one a partition, the header first: for tables of any size."""
    head = df.sparkSession.range(1).select(F.lit(csv_header()).alias("value"))
    head.unionByName(csv_lines(df.orderBy(*order), compat)).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, order: list[Column], compat: bool = False) -> None:
    """The export as the one file ``path``, byte for byte: lines parted by newlines, none after the last.

    One file is one task's work, which sorts (and spills) the rows that stream through it; ``path`` (a URI) must be seen by it.
    """
    head = df.sparkSession.range(1).select(F.lit(csv_header()).alias("__line"), F.lit(0).alias("__part"))
    rows = df.withColumns({"__line": csv_line(df, compat), "__part": F.lit(1)})
    lines = rows.unionByName(head, allowMissingColumns=True).repartition(1).sortWithinPartitions("__part", *order).select(F.col("__line").alias("value"))

    def work(batches):
        fs, name = pafs.FileSystem.from_uri(path)
        own = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            first = True
            for b in batches:
                for v in b.column(0).to_pylist():
                    f.write(v.encode() if first else b"\n" + v.encode())
                    first = False
        fs.move(own, name)
        yield from ()

    lines.mapInArrow(work, "value string").write.format("noop").mode("overwrite").save()
