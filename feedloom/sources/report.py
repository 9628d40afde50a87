"""The row report as CSV text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.csvtext import escape_cell
from feedloom.operators.groups import spread_join
from feedloom.rules import CONTRACT, Rules
from feedloom.session import stage

_CONTRACT_NAMES = {"column_name": "column"}


def header_line(rules: Rules) -> str:
    names = _CONTRACT_NAMES if rules is CONTRACT else {}
    return ",".join(names.get(c, c) for c in rules.report_columns)


def report_lines(report: DataFrame, rules: Rules) -> DataFrame:
    """(import_id, row_number, line), one CSV line per finding."""
    cells = [escape_cell(F.col(c), rules) for c in rules.report_columns]
    return report.select("import_id", "row_number", F.concat_ws(",", *cells).alias("line"))


def write_report(report: DataFrame, rules: Rules, path: str, imports: DataFrame) -> None:
    """One folder for each of `imports`; its part files, in name order, are the CSV with its header, which
    stands alone where nothing was found."""
    headers = imports.select("import_id").distinct().select(
        "import_id", F.lit(0).cast("bigint").alias("row_number"), F.lit(header_line(rules)).alias("line")
    )
    lines = report_lines(report, rules).unionByName(headers)
    (
        lines.repartitionByRange("import_id", "row_number")
        .sortWithinPartitions("import_id", "row_number", "line")
        .select("import_id", "line")
        .write.partitionBy("import_id")
        .text(path)
    )


FINDINGS = (
    "import_id bigint, row_number bigint, column_name string, code string, severity string, message string, phase string, "
    "part string, written bigint"
)


def _written(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all writes; `written` is the number of the write, `part` what of an import it replaced."""
    try:
        return spark.read.schema(FINDINGS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDINGS)


def write_findings(report: DataFrame, path: str, rules: Rules, imports: DataFrame) -> None:
    """Store findings so that validating `imports` again replaces what it found before.

    Every write adds a folder, whose files hold ranges of imports, so their number does not grow with that of the imports;
    `read_findings` takes the newest write of each import, or of each phase of it. Each of `imports` gets a row without
    a code, so an import that is clean now loses its old findings too. One writer at a time is assumed.
    """
    part = F.lit("") if rules.replace_all_phases else F.coalesce("phase", F.lit(""))
    marks = imports.select("import_id").distinct().withColumn("phase", F.lit("validate"))
    last = _written(report.sparkSession, path).agg(F.coalesce(F.max("written"), F.lit(0))).first()[0]
    (
        report.unionByName(marks, allowMissingColumns=True)
        .withColumn("part", part)
        .repartitionByRange("import_id", "part", "row_number")  # an import with many findings takes many tasks
        .sortWithinPartitions("import_id", "part", "row_number")
        .selectExpr(*[f"cast({name} as {kind}) {name}" for name, kind in map(str.split, FINDINGS.split(", ")) if name != "written"])
        .write.parquet(f"{path}/written={last + 1}")
    )


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    rows = _written(spark, path).withColumn("_import", F.struct("import_id"))  # a null in a struct equals another
    key = ["_import", "part"]
    newest = stage(rows.groupBy(*key).agg(F.max("written").alias("written")), "newest-findings")
    found = rows.filter("code is not null")
    return spread_join(found, newest, [*key, "written"], F.col("row_number"), "left_semi").drop("_import", "part", "written")
