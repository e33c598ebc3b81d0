"""A graph of two DataFrames with the operators as methods.

A Graph is a value: what changes it returns a new one. Nothing runs before an action, but for the stages that the
operators write by themselves; save() and load() keep a graph as Parquet.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.expressions import short_id
from graphloom.operators import changes, communities, documents, expand, explorer, export, graph, ingest, lifecycle, linking, metadata, retrieval, search, sessions, structured, tools
from graphloom.operators.lineage import written
from graphloom.operators.ontology import Ontology
from graphloom.schema import NODE
from graphloom.sources import readers

EDGE = "source_id string, target_id string, kind string, weight double"
#: What a new node has where its source says nothing.
REST = {"level": 0, "vitality": 1.0, "access_count": 0, "success_count": 0, "failure_count": 0}


def as_nodes(df: DataFrame, now: float, source: str = "") -> DataFrame:
    """Rows with some of the node table's columns as whole nodes."""
    schema = df.sparkSession.createDataFrame([], NODE).schema
    fill = {**{k: F.lit(v) for k, v in REST.items()}, "created_at": F.lit(now), "updated_at": F.lit(now), "source": F.lit(source)}
    cols = [(F.col(f.name) if f.name in df.columns else fill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols)


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    ontology: Ontology | None = None

    # Making graphs

    @classmethod
    def empty(cls, spark: SparkSession, ontology: Ontology | None = None) -> Graph:
        return cls(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), ontology)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, now: float, source: str = "", ontology: Ontology | None = None) -> Graph:
        return cls(as_nodes(nodes, now, source), edges.select("source_id", "target_id", "kind", F.col("weight").cast("double").alias("weight")), ontology)

    @classmethod
    def from_data(cls, spark: SparkSession, path: str, now: float) -> Graph:
        return cls.of(*readers.from_data(spark, path), now, path)

    @classmethod
    def from_chunks(cls, chunks: DataFrame, now: float) -> Graph:
        return cls.of(*readers.from_chunks(chunks), now)

    @classmethod
    def from_tables(cls, tables: list[ingest.Table], now: float) -> Graph:
        return cls.of(*ingest.ingest_tables(tables), now)

    @classmethod
    def from_database(cls, spark: SparkSession, url: str, now: float, schema: str | None = None, **options: str) -> Graph:
        return cls.from_tables(readers.database_tables(spark, url, schema, **options), now)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        return cls(spark.read.schema(NODE).parquet(f"{path}/nodes"), spark.read.schema(EDGE).parquet(f"{path}/edges"))

    def save(self, path: str) -> Graph:
        """To a folder that holds no graph yet: a graph is never written over."""
        self.nodes.write.parquet(f"{path}/nodes")
        self.edges.write.parquet(f"{path}/edges")
        return Graph.load(self.nodes.sparkSession, path)

    def checkpoint(self) -> Graph:
        """The same graph from files of its own, with its lineage cut."""
        return replace(self, nodes=written(self.nodes, "nodes"), edges=written(self.edges, "edges"))

    # Changing them

    def put(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        """With these nodes and edges in place of those of the same id, or the same ends and kind."""
        out = self
        if nodes is not None:
            out = replace(out, nodes=out.nodes.join(nodes.select("id"), "id", "left_anti").unionByName(nodes.select(out.nodes.columns)))
        return replace(out, edges=graph.upsert_edges(out.edges, edges)) if edges is not None else out

    def add(self, records: DataFrame, now: float) -> Graph:
        """Records (title, content), classified and tagged, with the edges that rules find between them and the rest."""
        new = as_nodes(ingest.add_records(records), now)
        grown = self.put(new)
        found = linking.relations(grown.nodes.select("id", "kind", "title", "content", "tags")).join(new.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        return grown.put(edges=found)

    def add_documents(self, docs: DataFrame, now: float) -> Graph:
        new, edges = ingest.add_documents(docs)
        return self.put(as_nodes(new, now), edges)

    def add_table(self, table: ingest.Table, now: float) -> Graph:
        new, edges = ingest.ingest_tables([table], keep_dangling=True)
        return self.put(as_nodes(new, now, table.name), edges)

    def add_conversations(self, turns: DataFrame, now: float) -> Graph:
        new, edges = sessions.conversation(turns)
        return self.put(as_nodes(new, now), edges)

    def log(self, activities: DataFrame, now: float) -> Graph:
        new, edges = sessions.activities(activities)
        return self.put(as_nodes(new, now), edges)

    def link(self, edges: DataFrame) -> Graph:
        """Edges that the ontology allows; those that it does not are left out, and invalid_edges() tells why."""
        if self.ontology is not None:
            bad = self.ontology.validate_edges(edges, self.nodes).select("source_id", "target_id", "kind")
            edges = edges.join(bad, ["source_id", "target_id", "kind"], "left_anti")
        return self.put(edges=edges)

    def update(self, ids: Iterable[str], now: float, **values: Column) -> Graph:
        """Nodes of the ids with new values of some columns."""
        here = F.col("id").isin(list(ids))
        changed = {k: F.when(here, v).otherwise(F.col(k)) for k, v in {**values, "updated_at": F.lit(now)}.items()}
        return replace(self, nodes=self.nodes.withColumns(changed))

    def remove(self, ids: DataFrame) -> Graph:
        return Graph(*graph.delete_nodes(self.nodes, self.edges, ids), self.ontology)

    def merge(self, same: DataFrame, now: float) -> Graph:
        """Pairs (old, new) as one node each."""
        merged = graph.merge_contents(self.nodes, same)
        into = as_nodes(self.nodes.drop("content", "tags", "access_count", "success_count", "failure_count", "vitality").join(merged.drop("kind", "title"), "id"), now)
        return Graph(into, graph.merge_nodes(self.edges, same), self.ontology)

    def reinforce(self, pairs: DataFrame, success: bool = True) -> Graph:
        return replace(self, edges=lifecycle.reinforce(self.edges, pairs, success))

    def maintain(self, now: float) -> Graph:
        nodes, edges, _ = lifecycle.maintain(self.nodes, self.edges, now)
        return Graph(nodes.select(self.nodes.columns), edges, self.ontology)

    def prune(self, least: float = 0.1) -> Graph:
        return replace(self, edges=lifecycle.prune(self.edges, least))

    def decay(self, factor: float = 0.95) -> Graph:
        return replace(self, nodes=lifecycle.decay(self.nodes, factor).select(self.nodes.columns))

    def touch(self, uses: DataFrame, now: float) -> Graph:
        return replace(self, nodes=lifecycle.touch(self.nodes, uses, now).select(self.nodes.columns))

    def link_entities(self, docs: DataFrame, locale: str = "en", least: int = 3, share: float = 0.3, now: float = 0.0) -> Graph:
        """Hubs of phrases that several documents (doc_id, text) share, and the edges to them."""
        found = linking.phrase_hubs(docs, locale)
        edges = documents.entity_links(found, docs.count(), least, share)
        hubs = found.select(short_id("phrase_", F.col("phrase")).alias("id"), F.lit("entity").alias("kind"), F.col("phrase").alias("title"), F.array(F.lit("_phrase")).alias("tags")).distinct()
        return self.put(as_nodes(hubs.join(edges.select(F.col("target_id").alias("id")), "id", "left_semi"), now), edges)

    def communities(self, now: float, rounds: int = 20, by: str = "labels") -> Graph:
        """With a node for each community, by label propagation or by modularity."""
        if by not in ("labels", "modularity"):
            raise ValueError(f"communities are found by labels or by modularity, not by {by!r}")
        labels = graph.communities(self.edges, rounds) if by == "labels" else communities.louvain(self.edges)
        made, edges = graph.community_nodes(labels, self.nodes)
        return self.put(as_nodes(made, now), edges)

    # Reading them

    def list(self, kind: str | None = None, level: int | None = None, limit: int = 100) -> DataFrame:
        """The newest nodes of a kind and a level."""
        return structured.scan(self.nodes, kind, level, limit)

    def get(self, ids: Iterable[str]) -> DataFrame:
        return self.nodes.where(F.col("id").isin(list(ids)))

    def table(self, name: str) -> DataFrame:
        """The rows of an ingested table, its properties as columns; the names are few and read first."""
        rows = self.nodes.where(F.try_element_at("properties", F.lit("_table_name")) == name)
        names = sorted(r.k for r in rows.select(F.explode(F.map_keys("properties")).alias("k")).distinct().collect() if not r.k.startswith("_"))
        return rows.select("id", "title", *[F.try_element_at("properties", F.lit(n)).alias(n) for n in names if n not in ("id", "title")])

    def filter_nodes(self, table: str, name: str, op: str, value, limit: int = 20, cursor=None, from_ids: list | None = None) -> DataFrame:
        found = structured.filter_nodes(self.table(table), name, op, value, from_ids, ["id", "title"])
        return structured.enveloped(found, [F.col("id")], limit, cursor)

    def aggregate_nodes(self, table: str, group_by: str, metric: str = "count", metric_property: str | None = None, limit: int = 50, cursor=None, **options) -> DataFrame:
        return structured.aggregate_nodes(self.table(table), group_by, metric, metric_property, limit=limit, cursor=cursor, **options)

    def top_nodes(self, table: str, sort_by: str, order: str = "desc", limit: int = 5, cursor=None) -> DataFrame:
        return structured.top_nodes(self.table(table), sort_by, order, limit, "id", cursor)

    def join_related(self, values: DataFrame, key: str, table: str, limit: int = 20, cursor=None) -> DataFrame:
        return structured.join_related(self.table(table), key, values, [F.col("id")], limit, cursor)

    def search(self, query: str, limit: int = 10, as_of: int = 9999, **options) -> DataFrame:
        """Rows (id, rank, total, reason, anchor) of evidence, by all stages; options as of retrieval.find."""
        return retrieval.find(self.nodes, self.edges, query, as_of, limit, **options)

    def legacy_search(self, query: str, now: float, limit: int = 10, **options) -> DataFrame:
        return tools.legacy(self.nodes, query, now, limit, edges=self.edges, **options)

    def agent_search(self, query: str, now: float, intent: str = "general", limit: int = 10, context: list[str] | None = None) -> DataFrame:
        """By intent where there is one, else as it is."""
        hits = self.legacy_search(query, now, limit * 2, kinds=tools.WANTED.get(intent))
        if intent == "general":
            return hits.limit(limit)
        return tools.by_intent(hits.select("id", F.col("relevance").alias("score")), self.nodes, self.edges, intent, now, limit, context)

    def vector_search(self, vector: list[float], limit: int = 10) -> DataFrame:
        return search.vector_top(self.nodes, vector, limit, "id", "embedding")

    def search_exact(self, needle: str) -> DataFrame:
        return search.exact(self.nodes, needle, ["title", "content"])

    def search_page(self, query: str, limit: int = 10, **options) -> DataFrame:
        return tools.search_page(self.nodes, query, limit, **options)

    def deep_search(self, query: str) -> DataFrame:
        return tools.deep_search(self.nodes, self.edges, query)

    def compare_search(self, query: str, limit: int = 10) -> DataFrame:
        return tools.compare_search(self.nodes, query, limit)

    def build_evidence(self, query: str, seeds: list[str]) -> DataFrame:
        return expand.evidence_chain(self.nodes, self.edges, seeds, query)

    def expand(self, seeds: DataFrame, categories: DataFrame) -> DataFrame:
        return expand.expand(self.nodes, self.edges, seeds, categories)

    def neighbours(self, ids: DataFrame, hops: int = 1) -> DataFrame:
        return graph.neighbours(self.edges, ids, hops)

    def around(self, node: str, limit: int = 20) -> DataFrame:
        return tools.around(self.nodes, self.edges, node, limit)

    def follow(self, node: str, kind: str, direction: str = "both", limit: int = 20) -> DataFrame:
        return graph.follow(self.edges, node, kind, direction).orderBy("way", "id").limit(limit)

    def shortest_path(self, start: str, goal: str, most: int = 5) -> DataFrame:
        return graph.shortest_path(self.edges, start, goal, most)

    def read_document(self, doc: str, page: int = 0) -> DataFrame:
        return tools.read_document(self.nodes, self.edges, doc, page)

    def rank(self, seeds: DataFrame) -> DataFrame:
        return graph.personalized_rank(self.edges, seeds)

    def find_duplicates(self, least: float = 0.85, limit: int = 50) -> DataFrame:
        return linking.duplicates(self.nodes, least, limit)

    def resolve(self, least: float = 0.85) -> DataFrame:
        """Pairs (old, new) of entities that are one, the likest merged first."""
        found = communities.resolve(linking.duplicates(self.nodes.where("kind = 'entity'"), least, None), self.nodes)
        return graph.final_targets(found.select(F.col("removed").alias("old"), F.col("kept").alias("new")))

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.nodes, self.edges)

    def count(self, kind: str | None = None, category: str | None = None, year: str | None = None) -> DataFrame:
        return structured.count_nodes(self.nodes, kind, category, year)

    def summary(self) -> DataFrame:
        return metadata.summary(self.nodes)

    def invalid_nodes(self) -> DataFrame:
        return (self.ontology or Ontology()).validate_nodes(self.nodes)

    def invalid_edges(self, edges: DataFrame | None = None) -> DataFrame:
        return (self.ontology or Ontology()).validate_edges(edges if edges is not None else self.edges, self.nodes)

    def backfill(self, locale: str = "en", vectors: DataFrame | None = None) -> Graph:
        """With phrase hubs, and vectors where given, for nodes that lack them."""
        nodes, edges = lifecycle.backfill(self.nodes, self.edges, locale, vectors=vectors)
        return replace(self, nodes=nodes, edges=edges)

    def explore(self, root: str | None = None, **options) -> explorer.Overview:
        """A part of the graph to look at; options as of explorer.overview."""
        return explorer.overview(self.nodes, self.edges, root, **options)

    def statistics(self, source: str | None = None) -> DataFrame:
        return explorer.statistics(self.nodes, self.edges, source)

    def document(self, ids: DataFrame, query: str = "") -> DataFrame:
        """Documents' chunks, those that share most with a query in full."""
        return tools.document(self.nodes, self.edges, ids, query)

    def backfill_needs(self) -> DataFrame:
        return lifecycle.needs_backfill(self.nodes, self.edges)

    def export_markdown(self) -> DataFrame:
        return export.markdown_lines(self.nodes)

    def export_json(self) -> DataFrame:
        return export.json_rows(self.nodes, self.edges)

    def snapshot(self) -> str:
        return export.report(self.nodes, self.edges)

    def chunk_entities(self) -> DataFrame:
        return linking.chunk_entities(self.edges)

    def timeline(self, session: str) -> DataFrame:
        return sessions.timeline(self.nodes, self.edges, session)

    def decision_chain(self, decision: str) -> DataFrame:
        return sessions.decision_chain(self.edges, decision)

    def sync(self, tables: list[ingest.Table], store: changes.Store, now: float) -> tuple[Graph, dict]:
        """With what changed in the tables since the last run, and what each run found."""
        found = changes.sync_all(tables, store)
        by = {t.name: t for t in tables}
        out = self
        for name, run in found.items():
            if "error" in run:
                continue
            key = lambda c, name=name: F.concat(F.lit(f"{name}:"), c)
            table = by[name]
            fresh = ingest.table_nodes(table).join(run["delta"].select(key(F.col("pk")).alias("id")), "id", "left_semi")
            edges = ingest.table_edges(table, by, keep_dangling=True)
            out = out.remove(run["deleted"].select(key(F.col("pk")).alias("id")))
            stale = run["moved"].where("old_target is not null and old_target <> ''")
            targets = F.create_map(*[F.lit(x) for c, (to, _) in table.foreign.items() for x in (c, to)]) if table.foreign else None
            if targets is not None:
                gone = stale.select(key(F.col("pk")).alias("source_id"), F.concat(targets[F.col("column")], F.lit(":"), "old_target").alias("target_id"), F.lit("related").alias("kind"))
                out = replace(out, edges=out.edges.join(gone, ["source_id", "target_id", "kind"], "left_anti"))
            out = out.put(as_nodes(fresh, now, name), edges)
        return out, found
