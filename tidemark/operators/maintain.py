"""Set-style maintenance: every operator returns what stays, goes or is written, as a DataFrame.

Filters and complements are single scans. Retention orders versions within a group by windows;
merging removes duplicates by keys, and renumbers by running counts over each known group's incoming rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import doc_fingerprint, join_column, strip
from tidemark.operators.filters import check_criterion, matches, matches_strictly

#: Row ids that one task orders when pruning by size.
PRUNE_BIN = 1 << 16


def _meta(key: str) -> Column:
    return F.get_json_object("metadata", f"$.{key}")


def _named(source: str) -> Column:
    """Rows of a source: by its name, a file name or path, or the ``name:`` prefix of a chunk's source."""
    name, path = source.strip(), _meta("file_path")
    return F.coalesce((F.col("source") == name) | F.col("source").startswith(name + ":"), F.lit(False)) | F.coalesce(_meta("filename") == name, F.lit(False)) | F.coalesce((path == name) | (F.element_at(F.split(path, "/"), -1) == name), F.lit(False))


def document_of() -> Column:
    return F.coalesce(_meta("parent_id"), F.col("doc_id"))


def delete_predicate(ids: list[str] | None = None, text_exact: str | None = None, text_contains: str | None = None, source: str | None = None, where: dict | None = None) -> Column:
    """The conjunction of the criteria that are given; rows that meet it go. No criterion: no row."""
    for name, value in (("text_exact", text_exact), ("text_contains", text_contains), ("source", source), ("where", where)):
        check_criterion(name, value)
    tests = []
    if ids:
        tests.append(F.col("doc_id").isin(ids) | F.coalesce(_meta("parent_id").isin(ids), F.lit(False)))
    if text_exact is not None:
        print_ = hashlib.sha256(text_exact.strip().encode()).hexdigest()
        tests.append((strip(F.col("text")) == text_exact.strip()) | F.coalesce(_meta("parent_sha256") == print_, F.lit(False)))
    if text_contains is not None:
        tests.append(F.lower("text").contains(text_contains.lower()))
    if source is not None:
        tests.append(_named(source))
    if where is not None:
        tests.append(matches(F.col("metadata"), where))
    out = F.lit(bool(tests))
    for test in tests:
        out = out & F.coalesce(test, F.lit(False))
    return out


def delete(facts: DataFrame, **criteria) -> DataFrame:
    return facts.where(~delete_predicate(**criteria))


def export(facts: DataFrame, where: dict | None = None, source_doc: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(matching, rest)``: strict equality of metadata and a substring of the source or file name."""
    check_criterion("where", where)
    check_criterion("source_doc", source_doc)
    test = F.lit(True)
    if where is not None:
        test = test & matches_strictly(F.col("metadata"), where)
    if source_doc is not None:
        test = test & (F.coalesce(F.col("source").contains(source_doc), F.lit(False)) | F.coalesce(_meta("filename").contains(source_doc), F.lit(False)))
    return facts.where(test), facts.where(~test)


def split_by_source(facts: DataFrame, name: str) -> DataFrame:
    check_criterion("source", name)
    tests = [_meta("filename") == name, _meta("file").endswith(name), F.col("source").contains(name), _meta("file_path").endswith(name)]
    return facts.where(F.greatest(*[F.coalesce(t, F.lit(False)) for t in tests]))


def split_by_date(facts: DataFrame, after: float | None = None, before: float | None = None) -> DataFrame:
    """Both ends belong to the range."""
    low = F.lit(True) if after is None else F.col("ts") >= after
    return facts.where(low if before is None else low & (F.col("ts") <= before))


def file_name(value: str, taken: set[str] | None = None) -> str:
    """A value as a file name; one that another value took (in any case) gets a digest."""
    name = re.sub(r"[^A-Za-z0-9._-]+", "_", value).strip("._") or "value"
    if taken is not None and name.casefold() in {t.casefold() for t in taken}:
        name += "-" + hashlib.md5(value.encode()).hexdigest()[:6]
    return name


def split_by_key(facts: DataFrame, key: str) -> DataFrame:
    """Rows with the value of a metadata key as ``part`` (rows without one are left out), for ``write.partitionBy('part')``."""
    return facts.withColumn("part", _meta(key)).where(F.col("part").isNotNull())


def unmerge(facts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(the rows that a store contributed, the rest)``, by the store's name, its base name or the project."""
    origin = _meta("source_vault")
    base = F.element_at(F.split(origin, "/"), -1)
    test = F.coalesce((origin == key) | (base == key), F.lit(False)) | F.coalesce(F.col("project") == key, F.lit(False))
    return facts.where(test), facts.where(~test)


def versions(facts: DataFrame) -> DataFrame:
    """Rows with ``version``, 1 the newest document of its (user, project, entity); chunks of a document share one."""
    group = ["user_id", "project", "entity"]
    rows = facts.where(F.col("entity").isNotNull()).withColumn("document", document_of())
    newest = F.max(F.struct("ts", "revision")).alias("at")
    docs = rows.groupBy(*group, "document").agg(newest, F.max("ts").alias("last_ts"), F.min("row_id").alias("first_row"))
    order = Window.partitionBy(*group).orderBy(F.col("at").desc(), F.col("first_row").desc())
    docs = docs.withColumn("version", F.row_number().over(order)).withColumn("n_versions", F.count("*").over(Window.partitionBy(*group)))
    keys = [rows[c].eqNullSafe(docs[c]) for c in (*group, "document")]
    return rows.join(docs, keys[0] & keys[1] & keys[2] & keys[3]).select(rows["*"], docs["version"], docs["n_versions"], docs["last_ts"])


def forget_superseded(facts: DataFrame, keep: int = 1, min_revisions: int = 2, older_than: float | None = None) -> DataFrame:
    """The rows that retention drops: versions beyond the newest ``keep`` of groups with enough versions, if all their rows are older."""
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    rows = versions(facts).where((F.col("version") > keep) & (F.col("n_versions") >= max(2, min_revisions)))
    return rows if older_than is None else rows.where(F.col("last_ts") < older_than)


def protected(facts: DataFrame) -> DataFrame:
    """The row ids of the newest version of every group."""
    return versions(facts).where("version = 1").select("row_id")


def prune(facts: DataFrame, now: float, max_age_days: float | None = None, free_bytes: int | None = None, protect: bool = True) -> DataFrame:
    """The rows that pruning drops: those older than the limit, then the first rows until so many text bytes are free.

    Current values are exempt unless ``protect`` is off. Running sums are taken over bins of row ids, so
    that no single task orders the table.
    """
    rows = facts.join(protected(facts), "row_id", "left_anti") if protect else facts
    old = F.lit(False) if max_age_days is None else (F.lit(now) - F.col("ts")) > max_age_days * 86400
    rows = rows.withColumn("__old", old)
    if free_bytes is None:
        return rows.where("__old").drop("__old")
    rows = rows.withColumn("__size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn("__bin", F.floor(F.col("row_id") / PRUNE_BIN))
    young = F.when(F.col("__old"), F.lit(0)).otherwise(F.col("__size"))
    bins = rows.groupBy("__bin").agg(F.sum(young).alias("__young"), F.sum(F.when(F.col("__old"), F.col("__size")).otherwise(0)).alias("__gone"))
    up = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a bin
    bins = bins.withColumn("__base", F.coalesce(F.sum("__young").over(up), F.lit(0))).withColumn("__free", F.lit(free_bytes) - F.sum("__gone").over(Window.partitionBy()))
    inside = Window.partitionBy("__bin").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bins.select("__bin", "__base", "__free"), "__bin").withColumn("__before", F.col("__base") + F.coalesce(F.sum(young).over(inside), F.lit(0)))
    return rows.where(F.col("__old") | (F.col("__before") < F.col("__free"))).select(facts.columns)


def signature() -> list[Column]:
    """What makes two rows duplicates: scope, attribute and normalised text."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [part("user_id").alias("s_user"), part("project").alias("s_project"), part("entity").alias("s_entity"), F.md5(F.lower(strip(F.col("text"))).cast("binary")).alias("s_text")]


def merge(existing: DataFrame, incoming: DataFrame, origin: str, deduplicate: bool = False, user_id: str | None = None, project: str | None = None, reconcile: bool = True) -> DataFrame:
    """The rows that a merge adds, stamped with their origin; row ids follow the existing ones in incoming order.

    With ``deduplicate`` rows whose signature exists already, there or earlier in the merge, are
    skipped. With ``reconcile`` a row of a known group that is not older than its newest gets the next
    revision, an older one the least revision less one (at least 1); each decides over the next.
    """
    rows = incoming
    for name, value in (("user_id", user_id), ("project", project)):
        rows = rows if value is None else rows.withColumn(name, F.lit(value))
    stamp = F.to_json(F.map_concat(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("source_vault"), F.lit(origin))))
    rows = rows.withColumn("metadata", stamp).withColumns({n: c for n, c in zip(("s_user", "s_project", "s_entity", "s_text"), signature(), strict=True)})
    keys = ["s_user", "s_project", "s_entity", "s_text"]
    if deduplicate:
        known = existing.select(*signature()).distinct()
        first = Window.partitionBy(*keys).orderBy("row_id")
        rows = rows.join(known, keys, "left_anti").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if reconcile:
        rows = _renumbered(existing, rows)
    top = existing.agg(F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).withColumn("row_id", F.col("top") + F.col("row_id")).drop("top", *keys)
    return rows


def _renumbered(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of known groups numbered on: newer ones count up from the highest revision, older ones down from the least.

    A row is newer if it is not older than its group's newest, stored or earlier in the merge. Rows of no
    known group stand alone in the windows, so untagged rows never meet in one task.
    """
    scope = ["s_user", "s_project", "s_entity"]
    held = existing.where(F.col("entity").isNotNull()).select(*signature()[:3], "ts", "revision")
    held = held.groupBy(*scope).agg(F.max("ts").alias("h_ts"), F.max("revision").alias("h_max"), F.min("revision").alias("h_min"))
    known = F.col("entity").isNotNull() & F.col("h_max").isNotNull()
    touched = rows.join(held, scope, "left").withColumn("__alone", F.when(~known, F.col("row_id")))
    by = Window.partitionBy(*scope, "__alone").orderBy("row_id")
    before = F.max("ts").over(by.rowsBetween(Window.unboundedPreceding, -1))
    touched = touched.withColumn("__newer", (F.col("ts") >= F.greatest("h_ts", before)).cast("int"))
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    newer, older = F.sum("__newer").over(so_far), F.sum(1 - F.col("__newer")).over(so_far)
    number = F.when(F.col("__newer") == 1, F.col("h_max") + newer).otherwise(F.greatest(F.lit(1), F.col("h_min") - older))
    return touched.withColumn("revision", F.when(known, number).otherwise(F.col("revision")).cast("int")).drop("h_ts", "h_max", "h_min", "__alone", "__newer")


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """Adds ``row_id`` from ``start`` on, ascending in ``order``, with gaps: each partition of a range partition counts for itself."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("row_id", F.monotonically_increasing_id() + F.lit(start))


def update(facts: DataFrame, doc_id: str, text: str | None = None, metadata: dict | None = None, source: str | None = None, embed=None) -> DataFrame:
    """The table with the first row of an id patched: revision one up, time kept; a new text is embedded by ``embed(column)``."""
    first = facts.where(F.col("doc_id") == doc_id).agg(F.min("row_id").alias("__row"))
    rows = facts.crossJoin(F.broadcast(first)).withColumn("__hit", F.col("row_id") == F.col("__row"))
    patch = lambda name, value: F.when(F.col("__hit"), value).otherwise(F.col(name))
    changed = {"revision": patch("revision", F.col("revision") + 1)}
    if text is not None:
        changed["text"] = patch("text", F.lit(text))
        if embed is not None:
            changed["embedding"] = patch("embedding", embed(F.lit(text)))
    if source is not None:
        changed["source"] = patch("source", F.lit(source))
    if metadata:
        pairs = F.create_map(*[F.lit(str(x)) for kv in metadata.items() for x in kv])
        held = F.map_filter(F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(map(str, metadata))))
        changed["metadata"] = patch("metadata", F.to_json(F.map_concat(held, pairs)))
    return rows.withColumns(changed).drop("__row", "__hit")


def get(facts: DataFrame, doc_id: str) -> DataFrame:
    """The latest row of an id, else the document whose chunks name it as their parent, rejoined in order."""
    row = facts.where(F.col("doc_id") == doc_id)
    latest = row.orderBy(F.col("row_id").desc()).limit(1).select("doc_id", "text", "source", "ts", "revision")
    parts = chunks_of(facts, doc_id)
    whole = parts.groupBy(F.lit(doc_id).alias("doc_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_at", "row_id", "text"))), lambda c: c["text"]).alias("parts"),
        F.min_by("source", "row_id").alias("source"), F.max("ts").alias("ts"), F.max("revision").alias("revision"),
    )
    whole = whole.select("doc_id", join_column(F.col("parts")).alias("text"), "source", "ts", "revision")
    return latest.withColumn("__n", F.lit(0)).unionByName(whole.withColumn("__n", F.lit(1))).orderBy("__n").limit(1).drop("__n")


def chunk_index(doc_id: Column) -> Column:
    """The place of a chunk in its document: ``_chunk_N``, else the first line of ``name:a-b``, else last."""
    number = F.regexp_extract(doc_id, r"_chunk_(\d+)$", 1)
    line = F.regexp_extract(doc_id, r":(\d+)(?:-[^:]*)?$", 1)
    return F.coalesce(number.try_cast("int"), line.try_cast("int"), F.lit(1 << 30))


def chunks_of(facts: DataFrame, parent: str) -> DataFrame:
    return facts.where(_meta("parent_id") == parent).withColumn("chunk_at", chunk_index(F.col("doc_id"))).orderBy("chunk_at", "row_id")


def legacy_chunks(facts: DataFrame, wanted: str) -> DataFrame:
    """Rows of ``base@digest:a-b`` for a bare ``base:a-b``; one that names chunks of several files is refused."""
    m = re.fullmatch(r"(?P<name>[^@]+):(?P<span>\d+-\d+)", wanted.strip())
    if not m:
        return facts.where(F.lit(False))
    found = facts.where(F.col("doc_id").startswith(m["name"] + "@") & F.col("doc_id").endswith(":" + m["span"]))
    files = found.select(document_of().alias("f")).distinct().limit(2).collect()
    if len(files) > 1:
        raise ValueError(f"id {wanted!r} names chunks of several files")
    return found


def new_documents(incoming: DataFrame, facts: DataFrame) -> DataFrame:
    """Incoming texts whose ``(parent_id, fingerprint)`` is not stored yet: unchanged files are skipped."""
    held = facts.select(_meta("parent_id").alias("parent_id"), _meta("parent_sha256").alias("sha")).where("sha is not null").distinct()
    return incoming.withColumn("sha", doc_fingerprint(F.col("text"))).join(held, ["parent_id", "sha"], "left_anti")
