"""Document drivers to the end: what two companies' documents become when the orders or pickings of one are mirrored.

A run takes source documents with their built lines and gives every table that changes: headers to create or update, lines
to create, change or delete, links of both sides, versions of what was written, and append-only events. Documents with a
line that cannot be built fail as a whole and change nothing but their events. New counterparts are numbered after the
largest id by the sources' keys, so reruns agree; a rerun over its own results updates nothing.

Defined cases: a document without lines is created empty; a cancelled counterpart does not count, so a new one is made; a
line key that stands twice in a document is an error of it; lines of documents that are not there are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import interim
from . import history as H
from .mirror import sync_documents
from .numbering import number_rows


@dataclass(frozen=True)
class Run:
    """The tables of a run: documents (action, outcome), headers, lines, links, history and events."""

    documents: DataFrame
    headers: DataFrame
    lines: DataFrame
    links: DataFrame
    history: DataFrame
    events: DataFrame


def sync(sources: DataFrame, built: DataFrame, existing: DataFrame, existing_lines: DataFrame, versions: DataFrame, header: list[str], content: list[str], eligible: Column, at: Column, run: str) -> Run:
    """sources: key and header columns. built: key, line_key, error and content columns. existing: key, counterpart_id, state
    and header columns. existing_lines: key, line_key and content columns. versions: a history by key of one column `snapshot`."""
    built, found = interim.write(built.select("key", "line_key", "error", *content), "built")

    def dealt(df: DataFrame, *more: str) -> DataFrame:
        """By key to tasks for the built lines' number, so that a task's rows do not grow with the tables."""
        return interim.spread(df, found["n"], "key", *more)

    both = F.array_compact(F.array(F.min("error"), F.when(F.count(F.lit(1)) > 1, "line_key")))
    errors = dealt(built.select("key", "line_key", "error")).groupBy("key", "line_key").agg(both.alias("each")).select("key", F.explode("each").alias("error"))
    decided, _ = interim.write(sync_documents(dealt(sources), dealt(existing), errors, "key", eligible), "decided")
    good = decided.where("outcome = 'success'")
    top = existing.agg(F.coalesce(F.max("counterpart_id"), F.lit(0))).first()[0]
    new = number_rows(good.where("action = 'create'").select("key"), ["key"], "__new", int(top) + 1)
    numbered = good.join(new, "key", "left").withColumn("counterpart_id", F.coalesce("counterpart_id", "__new").cast("bigint")).select("key", "action", "counterpart_id")
    numbered, _ = interim.write(numbered, "numbered")
    old_head = existing.select("counterpart_id", F.struct(*header).alias("__old"))
    heads = sources.select("key", *header).join(numbered, "key").join(old_head, "counterpart_id", "left")
    heads = heads.withColumn("action", F.when(F.col("action") == "create", "create").when(F.struct(*header).eqNullSafe(F.col("__old")), "keep").otherwise("update"))
    own = dealt(built).join(dealt(numbered), "key").select("key", "line_key", "counterpart_id", F.struct(*content).alias("__new"))
    live = numbered.where("action = 'update'").select("key", F.col("counterpart_id").alias("__live"))
    there = dealt(existing_lines).join(dealt(live), "key").select("key", "line_key", "__live", F.struct(*content).alias("__old"))
    both = dealt(own, "line_key").join(dealt(there, "line_key"), ["key", "line_key"], "full_outer")
    change = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "delete").when(F.col("__new").eqNullSafe(F.col("__old")), "keep").otherwise("update")
    lines = both.withColumn("action", change).withColumn("counterpart_id", F.coalesce("counterpart_id", "__live"))
    lines, _ = interim.write(lines.select("key", "counterpart_id", "line_key", "action", F.coalesce("__new", "__old").alias("__c")).select("key", "counterpart_id", "line_key", "action", "__c.*"), "lines")
    links = numbered.select("key", "counterpart_id").join(lines.where("action <> 'delete'").groupBy("key").agg(F.count(F.lit(1)).alias("n_lines")), "key", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    order = F.array_sort(F.collect_list(F.struct("line_key", *content)))
    snapshots = dealt(lines.where("action <> 'delete'")).groupBy("key").agg(order.alias("lines"))
    snapshots = heads.select("key", F.struct(*header).alias("header")).join(snapshots, "key", "left").select("key", F.sha2(F.to_json(F.struct("header", "lines")), 256).alias("snapshot"))
    after, _ = interim.write(H.finalise(versions, snapshots, ["key"], at, run), "history")
    changed = after.where(F.col("run") == run).select("key", "version")
    events = decided.where("action <> 'skip'").join(changed, "key", "left").select("key", F.when(F.col("outcome") == "failed", "failed").when(F.col("version").isNull(), "unchanged").otherwise(F.col("action")).alias("kind"), "version", "error", at.alias("at"))
    return Run(decided, heads.select("key", "counterpart_id", "action", *header), lines, links, after, events)


def mapped_taxes(lines: DataFrame, mapping: DataFrame, line_id: str = "line_id", taxes: str = "taxes") -> DataFrame:
    """line_id, taxes (each tax of a line as the first mapping's target, in order), error: 'tax <id>' of the first without one.

    mapping: company, tax, sequence, target; lines: line_id, company, taxes. A line without taxes has none and no error."""
    first = mapping.groupBy(F.col("company").alias("__c"), F.col("tax").alias("__t")).agg(F.min_by("target", F.struct("sequence", "target")).alias("__to"))
    e = lines.select(line_id, "company", F.posexplode_outer(taxes).alias("__n", "__tax"))
    j = e.join(first, (F.col("company") == F.col("__c")) & (F.col("__tax") == F.col("__t")), "left")
    found = F.array_sort(F.collect_list(F.when(F.col("__to").isNotNull(), F.struct("__n", "__to"))))
    lost = F.min(F.when(F.col("__tax").isNotNull() & F.col("__to").isNull(), F.struct("__n", "__tax")))
    g = j.groupBy(line_id).agg(found.alias("__f"), lost.alias("__l"))
    return g.select(line_id, F.transform("__f", lambda x: x["__to"]).alias("taxes"), F.concat(F.lit("tax "), F.col("__l.__tax").cast("string")).alias("error"))
