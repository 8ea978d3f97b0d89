"""Reports of external tools, one JSON text per row, as violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("file_path", "line", "col", "code", "message", "source", "fixable", "fix_applicability")


def _row(df: DataFrame, source: str, path: Column, line: Column, col: Column, code: Column, message: Column, fixable: Column | None = None, applicability: Column | None = None) -> DataFrame:
    return df.select(
        path.alias("file_path"), F.coalesce(line, F.lit(0)).cast("int").alias("line"), F.coalesce(col, F.lit(0)).cast("int").alias("col"), code.alias("code"), message.alias("message"), F.lit(source).alias("source"),
        F.coalesce(fixable if fixable is not None else F.lit(False), F.lit(False)).alias("fixable"), F.coalesce(applicability if applicability is not None else F.lit(""), F.lit("")).alias("fix_applicability"),
    )


def clean_message(message: Column) -> Column:
    """Without file positions, colours and trailing linter names."""
    bare = F.regexp_replace(message, "\x1b\\[[0-9;]*m", "")
    bare = F.regexp_replace(bare, r"^\S+:\d+(:\d+)?:\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*\((\w+)\)\s*$", ""))


def golangci(reports: DataFrame) -> DataFrame:
    schema = "struct<Issues:array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:int,Column:int>>>>"
    i = reports.select(F.explode(F.from_json("json", schema)["Issues"]).alias("i"))
    return _row(i, "golangci-lint", F.col("i.Pos.Filename"), F.col("i.Pos.Line"), F.col("i.Pos.Column"), F.col("i.FromLinter"), clean_message(F.col("i.Text")))


def ruff(reports: DataFrame) -> DataFrame:
    schema = "array<struct<code:string,message:string,filename:string,location:struct<row:int,column:int>,fix:struct<applicability:string>>>"
    i = reports.select(F.explode(F.from_json("json", schema)).alias("i"))
    return _row(i, "ruff", F.col("i.filename"), F.col("i.location.row"), F.col("i.location.column"), F.col("i.code"), F.col("i.message"), F.col("i.fix").isNotNull(), F.col("i.fix.applicability"))


def pyright(reports: DataFrame) -> DataFrame:
    schema = "struct<generalDiagnostics:array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:struct<line:int,character:int>>>>>"
    i = reports.select(F.explode(F.from_json("json", schema)["generalDiagnostics"]).alias("i"))
    return _row(i, "pyright", F.col("i.file"), F.col("i.range.start.line") + 1, F.col("i.range.start.character") + 1, F.col("i.rule"), F.col("i.message"))


def eslint(reports: DataFrame) -> DataFrame:
    schema = "array<struct<filePath:string,messages:array<struct<ruleId:string,message:string,line:int,column:int,fix:struct<text:string>>>>>"
    f = reports.select(F.explode(F.from_json("json", schema)).alias("f")).select("f.filePath", F.explode("f.messages").alias("i"))
    return _row(f, "eslint", F.col("filePath"), F.col("i.line"), F.col("i.column"), F.col("i.ruleId"), F.col("i.message"), F.col("i.fix").isNotNull(), F.when(F.col("i.fix").isNotNull(), "safe"))


def markdownlint(reports: DataFrame) -> DataFrame:
    schema = "array<struct<fileName:string,lineNumber:int,ruleNames:array<string>,ruleDescription:string,fixInfo:struct<lineNumber:int>>>"
    i = reports.select(F.explode(F.from_json("json", schema)).alias("i"))
    return _row(i, "markdownlint", F.col("i.fileName"), F.col("i.lineNumber"), F.lit(0), F.get("i.ruleNames", F.lit(0)), F.col("i.ruleDescription"), F.col("i.fixInfo").isNotNull())


def vale(reports: DataFrame) -> DataFrame:
    schema = "map<string,array<struct<Check:string,Message:string,Line:int,Span:array<int>,Severity:string>>>"
    f = reports.select(F.explode(F.from_json("json", schema)).alias("file", "issues")).select("file", F.explode("issues").alias("i"))
    return _row(f, "vale", F.col("file"), F.col("i.Line"), F.get("i.Span", F.lit(0)), F.col("i.Check"), F.col("i.Message"))


READERS = {"golangci-lint": golangci, "ruff": ruff, "pyright": pyright, "eslint": eslint, "markdownlint": markdownlint, "vale": vale}


def read(reports: DataFrame) -> DataFrame:
    """All reports of (tool, json) rows, united without de-duplication."""
    out = None
    for tool, reader in READERS.items():
        part = reader(reports.where(F.col("tool") == tool))
        out = part if out is None else out.unionByName(part)
    return out
