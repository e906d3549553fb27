"""The whole API over one store: writes go through :class:`FactStore`, reads return DataFrames."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed as K
from tidemark.functions import gate
from tidemark.functions import text as T
from tidemark.functions.encode import LexicalEncoder, embed_column
from tidemark.operators import analytics, maintain, revisions, search
from tidemark.operators import vectors as V
from tidemark.operators.filters import check_reserved, matches
from tidemark.schema import FACTS
from tidemark.sources.files import file_chunks, read_directory
from tidemark.sources.store import FactStore
from tidemark.streaming.ingest import ingest_batch


class Vault:
    """Facts of one store, with an embedder (any object with ``embed``, ``embed_batch`` and ``dim``)."""

    def __init__(self, spark: SparkSession, path: str, embedder=None):
        self.spark, self.store, self.embedder = spark, FactStore(spark, path), embedder or LexicalEncoder()

    # -- writes ------------------------------------------------------------------------------
    def add(self, text: str, source: str = "user_input", metadata: dict | None = None, timestamp: float | None = None, user_id: str | None = None, project: str | None = None, entity: str | None = None) -> str:
        """Adds one statement; its id. A blank text adds nothing. Long texts become chunks of one document."""
        check_reserved(metadata or {})
        clean = str(text or "").strip()
        if not clean:
            return ""
        row = (clean, source, {str(k): str(v) for k, v in (metadata or {}).items()}, float(time.time() if timestamp is None else timestamp), user_id, project, entity)
        rows = self.spark.createDataFrame([row], "text string, source string, metadata map<string,string>, ts double, user_id string, project string, entity string")
        self.add_batch(rows)
        return rows.select(T.doc_id(F.col("text")).alias("id")).first().id

    def add_batch(self, rows: DataFrame, flush: bool = True) -> None:
        """Adds ``(text, source, metadata map, ts, user_id, project, entity)``: chunked, embedded, tagged and numbered.

        Revisions continue those stored in each group. Row ids follow the stored ones in order of time,
        text and chunk, with gaps. Without ``flush`` the rows are held in memory until :meth:`flush`:
        searches see them, batch searches don't.
        """
        held = self.store.facts()
        parts = rows.withColumn("text", T.strip(F.col("text"))).where("text <> ''").withColumn("parent", T.doc_id(F.col("text"))).withColumn("sha", T.doc_fingerprint(F.col("text")))
        parts = parts.select("*", F.posexplode(T.chunk_column(F.col("text"))).alias("at", "piece")).withColumn("n", F.max("at").over(Window.partitionBy("parent", "ts", "user_id")) + 1)
        chunk = F.create_map(F.lit("parent_id"), F.col("parent"), F.lit("chunk_index"), F.col("at").cast("string"), F.lit("chunk_total"), F.col("n").cast("string"), F.lit("is_chunked"), F.lit("True"), F.lit("parent_sha256"), F.col("sha"))
        none = F.create_map().cast("map<string,string>")
        meta = F.to_json(F.map_concat(F.coalesce("metadata", none), F.when(F.col("n") > 1, chunk).otherwise(none)))
        name = F.when(F.col("n") > 1, F.concat("parent", F.lit("_chunk_"), "at")).otherwise(F.col("parent"))
        plain = parts.select(name.alias("doc_id"), F.col("piece").alias("text"), "source", meta.alias("metadata"), "ts", "user_id", "project", "entity", "parent", "at")
        plain = maintain.numbered(plain, ["ts", "parent", "at"], self.store.next_row()).drop("parent", "at")
        done = ingest_batch(plain)
        known = revisions.group_extremes(held).select("group_key", "max_revision")
        done = done.join(known, "group_key", "left").withColumn("revision", (F.col("revision") + F.coalesce("max_revision", F.lit(0))).cast("int")).drop("max_revision")
        done = done.withColumn("embedding", embed_column(F.col("text"), self.embedder))
        if flush:
            self.store.append(done)
        else:
            self.store.hold(done.persist())

    def flush(self) -> None:
        self.store.flush()

    def ingest_directory(self, path: str, **options) -> int:
        """Adds the text files under a folder as line windows; how many rows the store then has.

        Files whose content is stored already are skipped. New files are appended; only where a stored file has
        changed is the store rewritten, without that file's old chunks.
        """
        held = self.store.facts()
        files = read_directory(self.spark, path, **options)
        parent = F.concat(F.lit("doc_"), F.substring(F.md5(F.col("path").cast("binary")), 1, 10))
        fresh = maintain.new_documents(files.withColumn("parent_id", parent), held).drop("parent_id", "sha")
        none = F.lit(None).cast("string")
        rows = maintain.numbered(file_chunks(fresh), ["doc_id"], self.store.next_row())
        rows = rows.select("row_id", "doc_id", "text", "source", "metadata", F.lit(time.time()).alias("ts"), F.lit(1).alias("revision"), none.alias("user_id"), none.alias("project"), none.alias("entity"), none.alias("group_key"), F.lit(False).alias("declared"), embed_column(F.col("text"), self.embedder).alias("embedding"))
        rows = rows.persist()
        try:
            parents = rows.select(F.get_json_object("metadata", "$.parent_id").alias("p")).distinct()
            stale = (F.get_json_object("metadata", "$.file_path").isNotNull()) & (F.get_json_object("metadata", "$.parent_id") == F.col("p"))
            if held.join(parents, stale, "left_semi").isEmpty():
                if not rows.isEmpty():
                    self.store.append(rows)
            else:
                names = [f.name for f in FACTS]
                self.store.rewrite(lambda facts: facts.join(parents, stale, "left_anti").select(names).unionByName(rows.select(names)))
        finally:
            rows.unpersist()
        return self.store.count()

    def update(self, doc_id: str, **patch) -> None:
        embed = lambda text: embed_column(text, self.embedder)
        self.store.rewrite(lambda facts: maintain.update(facts, doc_id, embed=embed, **patch))

    def delete(self, **criteria) -> int:
        return self.store.delete(**criteria)

    def forget(self, question: str, k: int = 5, min_score: float = K.FORGET_FLOOR) -> int:
        """Deletes what a search finds at or above the floor, by exact text."""
        found = {r.text for r in self.search(question, k, min_score=min_score).collect()}
        facts = self.store.facts()
        gone = facts.where(F.col("text").isin(list(found))).count() if found else 0
        if gone:
            self.store.rewrite(lambda facts: facts.where(~F.col("text").isin(list(found))))
        return gone

    def forget_superseded(self, **rules) -> DataFrame:
        return self.store.forget_superseded(**rules)

    def prune(self, **rules) -> int:
        """Drops old rows; the bytes of text freed."""
        now = rules.pop("now", time.time())
        dropped = maintain.prune(self.store.facts(), now, **rules)
        freed = dropped.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        if freed:
            self.store.rewrite(lambda facts: facts.join(maintain.prune(facts, now, **rules).select("row_id"), "row_id", "left_anti"))
        return freed

    def merge(self, other: Vault, **options) -> dict:
        return self.store.merge(other.store.facts(), other.store.path, **options)

    def unmerge(self, key: str, target: Vault | None = None) -> int:
        match, _ = maintain.unmerge(self.store.facts(), key)
        n = match.count()
        if n:
            if target is not None:
                target.store.append(match)
            self.store.rewrite(lambda facts: maintain.unmerge(facts, key)[1])
        return n

    def export(self, target: Vault, **criteria) -> int:
        return self.store.export(target.store, **criteria)

    def split_by_key(self, key: str, folder: str) -> dict[str, int]:
        """One folder of Parquet for each value of a metadata key; rows by folder name."""
        parts = maintain.split_by_key(self.store.facts(), key)
        counts = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
        names: dict[str, str] = {}
        for value in sorted(counts):
            names[value] = maintain.file_name(value, set(names.values()))
        if names:
            rename = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
            parts.withColumn("part", rename[F.col("part")]).write.partitionBy("part").parquet(folder)
        return {names[value]: n for value, n in counts.items()}

    def compact(self, partitions: int = 8, recluster: bool = False) -> None:
        self.store.compact(partitions, (lambda facts: V.cells(facts)[0]) if recluster else None)

    # -- reads -------------------------------------------------------------------------------
    def get(self, doc_id: str) -> DataFrame:
        return self.store.get(doc_id)

    def exists(self, doc_id: str) -> bool:
        return self.store.exists(doc_id)

    def get_all_records(self, where: dict | None = None, embeddings: bool = False) -> DataFrame:
        rows = self.store.facts()
        rows = rows if where is None else rows.where(matches(F.col("metadata"), where))
        return (rows if embeddings else rows.drop("embedding")).orderBy("row_id")

    def search(self, question: str, k: int = 3, decompose: bool = True, **options) -> DataFrame:
        run = search.search_decomposed if decompose else lambda f, q, e, k, **o: search.search(f, q, e.embed(q), k, **o)
        return run(self.store.facts(), question, self.embedder, k, **options)

    def search_multihop(self, question: str, k: int = 3, bridge=None, **options) -> DataFrame:
        return search.multihop(self.store.facts(), question, self.embedder, k, bridge, **options)

    def search_batch(self, vectors: list, k: int = 3) -> DataFrame:
        units = [(i, V.checked_query(v)) for i, v in enumerate(vectors)]
        return V.batch_top_k(self.store.facts(pending=False), [(i, u) for i, u in units if u], k)

    def search_multi(self, others: list[Vault], question: str, k: int = 3) -> DataFrame:
        unit = V.checked_query(self.embedder.embed(question))
        return search.federated({v.store.path: v.store.facts() for v in [self, *others]}, unit, k)

    def history(self, question: str, max_len: int | None = None, min_score: float = 0.0) -> DataFrame:
        return search.history(self.store.facts(), question, self.embedder.embed(question), max_len, min_score)

    def changes(self, since: float, until: float | None = None, limit: int | None = None) -> DataFrame:
        return analytics.changes(self.store.facts(), since, until, limit)

    def volatility(self, min_revisions: int = 2, now: float | None = None) -> DataFrame:
        return analytics.volatility(self.store.facts(), time.time() if now is None else now, min_revisions, with_intervals=True)

    def staleness(self, now: float | None = None, **options) -> DataFrame:
        return analytics.staleness(self.store.facts(), time.time() if now is None else now, **options)

    def inspect(self) -> tuple[DataFrame, DataFrame]:
        return analytics.inspect_sources(self.store.facts()), analytics.inspect_metadata(self.store.facts())

    def stats(self) -> DataFrame:
        return analytics.stats(self.store.facts())

    def should_store(self, text: str) -> bool:
        return self.inspect_memory(text).should_store

    def inspect_memory(self, text: str):
        """The gate's decision on one utterance with all its features."""
        rows = gate.decide(self.spark.createDataFrame([(text,)], "text string"))
        return rows.select("*", *[c.alias(n) for n, c in gate.features(F.col("text")).items()]).first()

    def context(self, question: str, words: int = 800, k: int = 3, cite: bool = True) -> str:
        """The numbered snippets of a search for a prompt, each marked if it was replaced; the overflowing one is cut short."""
        lines, used = [], 0
        hits = self.search(question, k).withColumn("mark", T.staleness_label(F.col("superseded"), F.col("superseded_at"), F.lit(time.time())))
        for at, hit in enumerate(hits.collect(), 1):
            said = hit.text.split()
            head = f"[{at}] (Source: {hit.source})" if cite else "•"
            if lines and used + len(said) > words:
                lines.append(f"{head}: {' '.join(said[: max(30, words - used)])}...")
                break
            lines.append(f"{head}{f' [{hit.mark}]' if hit.mark else ''}: {hit.text}")
            used += len(said)
        return "\n".join(lines)

    def close(self) -> None:
        """Stores what is held and refuses further writes."""
        self.store.flush()
        self.store.close()
