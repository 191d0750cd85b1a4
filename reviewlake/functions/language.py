"""Language detection as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.severity import lookup

# Language per file extension, service and command line variants.
BY_EXTENSION = {
    "py": "python", "scala": "scala", "sc": "scala", "sql": "sql", "tf": "terraform", "hcl": "terraform",
    "java": "java", "js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript",
    "go": "go", "rs": "rust", "rb": "ruby", "sh": "bash", "yaml": "yaml", "yml": "yaml", "json": "json",
}
BY_EXTENSION_CLI = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript",
    "scala": "scala", "sql": "sql", "tf": "terraform",
}

# Substrings that turn a Python file into a PySpark file.
PYSPARK_INDICATORS = (
    "from pyspark", "import pyspark", "SparkSession", "SparkContext", ".read.", ".write.",
    "DataFrame", "spark.sql", ".createDataFrame",
)
PYSPARK_IMPORT = r"(?:from|import)[\s\x{a0}\x{feff}]+pyspark"

# Content signals, tested on the lower-cased text.  A tuple needs all its parts.
TERRAFORM_SIGNALS = ('resource "', 'provider "', 'variable "', "terraform {", 'module "', 'data "')
SCALA_SIGNALS = (
    "object ", "case class", "trait ", "extends ", "override def", "implicit ", "sealed ", "match {",
    "package ", "import org.", "import scala.", "import java.",
    ("val ", ": "), ("def ", "): "), ("def ", " = {"),
)
PYSPARK_SIGNALS = (
    "pyspark", ("spark.", "def "), ("spark.", "import "), ".createdataframe", ("df.", ".select("), ("df.", ".filter("),
)
PYTHON_SIGNALS = ("def ", "import ", "class ", "if __name__", "print(")
SQL_STATEMENTS = (
    r"^\s*select\s+", r"^\s*create\s+(table|view|index|database)", r"^\s*insert\s+into",
    r"^\s*update\s+\w+\s+set", r"^\s*delete\s+from", r"^\s*alter\s+table",
    r"^\s*drop\s+(table|view|index|database)", r"^\s*with\s+\w+\s+as\s*\(",
)


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _signals(text: Column, signals) -> Column:
    def one(signal) -> Column:
        parts = signal if isinstance(signal, tuple) else (signal,)
        return reduce(lambda a, b: a & b, [text.contains(p) for p in parts])

    return _any([one(s) for s in signals])


def language_by_extension(path: Column) -> Column:
    return lookup(F.lower(F.substring_index(path, ".", -1)), BY_EXTENSION, "text")


def language_by_extension_cli(path: Column) -> Column:
    """Extension of the base name (a leading dot is not an extension); default python."""
    base = F.substring_index(path, "/", -1)
    ext = F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1))
    return lookup(ext, BY_EXTENSION_CLI, "python")


def is_pyspark(content: Column, language: Column) -> Column:
    return (language == "python") & _any([content.contains(i) for i in PYSPARK_INDICATORS])


def effective_language(path: Column, content: Column, language: Column) -> Column:
    """Given language, else by extension; Python with Spark indicators becomes pyspark."""
    named = F.when(F.coalesce(language, F.lit("")) != "", language).otherwise(language_by_extension(path))
    return F.when(is_pyspark(content, named), "pyspark").otherwise(named)


def editor_language(language_id: Column, content: Column) -> Column:
    """Editor variant: import test for PySpark; NULL for unsupported languages."""
    return (
        F.when(language_id == "python", F.when(content.rlike(PYSPARK_IMPORT), "pyspark").otherwise("python"))
        .when(language_id.isin("scala", "sql"), language_id)
        .when(language_id.isin("terraform", "hcl"), "terraform")
    )


def language_by_content(content: Column, lowered: Column | None = None) -> Column:
    """Ordered cascade; the first language whose signals are present wins."""
    text = F.lower(content) if lowered is None else lowered
    sql = _any([content.rlike("(?im)" + p) for p in SQL_STATEMENTS])
    return (
        F.when(_signals(text, TERRAFORM_SIGNALS), "terraform")
        .when(_signals(text, SCALA_SIGNALS), "scala")
        .when(_signals(text, PYSPARK_SIGNALS), "pyspark")
        .when(_signals(text, PYTHON_SIGNALS), "python")
        .when(sql, "sql")
        .otherwise("python")
    )
