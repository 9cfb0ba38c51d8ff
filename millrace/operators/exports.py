"""Where names of modules come from: definitions, imports, re-exports and star imports, by the order of lines.

``definitions`` is (module, name, line), ``imports`` (module, source, name,
alias, line) at the top of modules, '*' standing for all public names of the
source. A later line takes a name over from an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import kept, stored
from millrace.operators.fixpoint import closure

_NAME = ["module", "name"]


def exported(definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name): the names that a module holds; star imports hand on public ones, over any number of modules."""
    named = imports.where("name <> '*'").select("module", F.coalesce("alias", "name").alias("name"))
    stars = kept(imports.where("name = '*'").select("module", "source").distinct())
    onward = lambda new: new.where("not startswith(name, '_')").join(stars.withColumnsRenamed({"module": "to", "source": "module"}), "module").select(F.col("to").alias("module"), "name")
    return closure(definitions.select(*_NAME).unionByName(named), onward)


def bindings(definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name, source, source_name, line): what holds a name at the end of its module; ``source`` is null for a definition of its own.

    The last line wins, ranked once for each name of a module. A star import
    counts for the names that its source holds only, so it shadows no others.
    """
    held = exported(definitions, imports)
    none = F.lit(None)
    own = definitions.select(*_NAME, none.cast(imports.schema["source"].dataType).alias("source"), none.cast("string").alias("source_name"), "line")
    named = imports.where("name <> '*'").select("module", F.coalesce("alias", "name").alias("name"), "source", F.col("name").alias("source_name"), "line")
    public = held.where("not startswith(name, '_')").select(F.col("module").alias("source"), F.col("name").alias("source_name"))
    starred = imports.where("name = '*'").select("module", "source", "line").join(public, "source").select("module", F.col("source_name").alias("name"), "source", "source_name", "line")
    every = own.unionByName(named).unionByName(starred)
    last = every.groupBy(*_NAME).agg(F.max(F.struct("line", F.col("source").isNull().alias("own"), "source", "source_name")).alias("b"))
    return last.select(*_NAME, "b.source", "b.source_name", "b.line")


def origins(definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name, origin, origin_name): the module in which what a name stands for is defined, through any chain of re-exports.

    A source that is no module of the tree is the origin itself; names that
    only import one another in a ring have none.
    """
    held = stored(bindings(definitions, imports))
    own = held.where("source is null").select(*_NAME, F.col("module").alias("origin"), F.col("name").alias("origin_name"))
    modules = definitions.select("module").unionByName(imports.select("module")).distinct()
    outside = held.where("source is not null").join(modules.withColumnRenamed("module", "source"), "source", "left_anti").select(*_NAME, F.col("source").alias("origin"), F.col("source_name").alias("origin_name"))
    further = kept(held.where("source is not null").select(F.col("module").alias("to"), F.col("name").alias("as"), F.col("source").alias("module"), F.col("source_name").alias("name")))
    return closure(own.unionByName(outside), lambda new: new.join(further, _NAME).select(F.col("to").alias("module"), F.col("as").alias("name"), "origin", "origin_name"))
