"""The note graph: neighbours, orphans, entity matching, seeds and bounded expansion.

Every step works for many queries at once (query_id is a key of every window), and hops
are unrolled joins: there are two at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import lexical, prefix_terms
from corpusloom.operators.scans import first_per
from corpusloom.sources.storage import written

BUCKETS = {
    ("supports", "out"): "supporting",
    ("supports", "in"): "supported_by",
    ("contradicts", "out"): "contradicting",
    ("contradicts", "in"): "contradicted_by",
    ("related_to", "out"): "related",
    ("related_to", "in"): "related_from",
}


#: Hops of an expansion at most, so a path has visited so many notes when it takes a step.
MOST_HOPS = 2


@dataclass(frozen=True)
class Expansion:
    seed_entities: int = 4
    seed_notes: int = 12
    hops: int = 1
    fanout: int = 8
    outbound: bool = True
    inbound: bool = True
    least_confidence: float = 0.0
    decay: float = 0.8
    candidates: int = 32
    seed_score: float = 0.03
    edge_types: tuple[str, ...] = ("supports", "contradicts", "related_to", "derived_from")


def both_directions(edges: DataFrame) -> DataFrame:
    """note_id, other_id, direction and the edge's columns, one row per end."""
    kept = ["id", "edge_type", "confidence"]
    out = edges.select(F.col("from_id").alias("note_id"), F.col("to_id").alias("other_id"), F.lit("out").alias("direction"), *kept)
    return out.unionByName(edges.select(F.col("to_id").alias("note_id"), F.col("from_id").alias("other_id"), F.lit("in").alias("direction"), *kept))


def related_notes(visible_edges: DataFrame) -> DataFrame:
    """Per note the sorted neighbours in six buckets; derived_from isn't among them."""
    ends = both_directions(visible_edges.filter("edge_type <> 'derived_from'"))
    columns = [
        F.sort_array(F.collect_set(F.when((F.col("edge_type") == kind) & (F.col("direction") == direction), F.col("other_id")))).alias(name)
        for (kind, direction), name in BUCKETS.items()
    ]
    return ends.groupBy("note_id").agg(*columns)


def orphans(visible: DataFrame, visible_edges: DataFrame) -> DataFrame:
    """Visible notes that no edge but derived_from connects to a visible note."""
    ends = both_directions(visible_edges.filter("edge_type <> 'derived_from'")).select(F.col("note_id").alias("id"))
    return visible.join(ends, "id", "left_anti")


def edges_per_type(edges: DataFrame, most: int) -> DataFrame:
    return first_per(edges, ["edge_type"], ["id"], most)


def entity_matches(queries: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """query_id, entity_id, tier, entity_rank: of exact, contained-phrase and prefix matches the first tier that has any.

    Exact matches are joined on their text, phrases on their words' hashes: a query's runs
    of words (bounded by the longest phrase) meet entity phrases by equality, so the two
    tables never meet row by row. Prefixes meet by equality of beginnings, too.
    """
    phrases = entities.select(F.col("id").alias("entity_id"), "canonical_name", F.explode(F.concat(F.array(lexical(F.col("canonical_name"))), F.coalesce(F.transform("aliases", lexical), F.array().cast("array<string>")))).alias("phrase")).filter("phrase <> ''")
    asked = queries.select("query_id", lexical(F.col("query")).alias("text")).filter("text <> ''")
    longest = phrases.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    words = asked.withColumn("words", F.split("text", " "))
    runs = words.select("query_id", "text", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"), "words")
    runs = runs.select("query_id", "text", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - F.col("at") + 1)), lambda n: F.array_join(F.slice(F.col("words"), F.col("at"), n), " "))).alias("phrase"))
    found = runs.distinct().join(phrases, "phrase").select("query_id", "entity_id", "canonical_name", F.when(F.col("phrase") == F.col("text"), 1).otherwise(2).alias("tier"), (-F.char_length("phrase")).alias("specific"))
    starts = queries.select("query_id", F.explode(F.array_distinct(prefix_terms(F.col("query")))).alias("term"))
    names = entities.select(F.col("id").alias("entity_id"), "canonical_name", lexical(F.col("canonical_name")).alias("name"))
    beginnings = names.select("entity_id", "canonical_name", F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.char_length("name"), F.lit(4))), lambda n: F.substring(F.col("name"), F.lit(1), n))).alias("term")).distinct()
    recovered = starts.join(beginnings, "term").select("query_id", "entity_id", "canonical_name", F.lit(3).alias("tier"), F.char_length("term").alias("specific"))
    every = found.unionByName(recovered)
    best = every.withColumn("__first", F.min("tier").over(Window.partitionBy("query_id"))).filter("tier = __first")
    best = best.groupBy("query_id", "entity_id", "canonical_name", "tier").agg(F.min("specific").alias("specific"))
    order = [F.when(F.col("tier") > 1, F.col("specific")), "canonical_name", "entity_id"]
    return first_per(best, ["query_id"], order, limit, "entity_rank").select("query_id", "entity_id", "tier", "entity_rank")


def seed_pages(matches: DataFrame, mentions: DataFrame, visible: DataFrame, most: int) -> DataFrame:
    """For every matched entity the first visible notes that mention it."""
    found = mentions.join(matches, "entity_id").join(visible.select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return first_per(found, ["query_id", "entity_id"], ["note_id"], most, "page_rank")


def pick_seeds(pages: DataFrame, most: int) -> DataFrame:
    """Coverage first: a new note for each entity in rank order, then the rest in that order.

    A query has at most seed_entities * seed_notes rows here, so one group is small.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["entity_rank", "page_rank"])
        chosen: dict[str, None] = {}
        for _, own in pdf.groupby("entity_rank", sort=True):
            new = next((n for n in own["note_id"] if n not in chosen), None)
            if new is not None and len(chosen) < most:
                chosen[new] = None
        for note in pdf["note_id"]:
            if len(chosen) < most:
                chosen.setdefault(note)
        kept = pdf[pdf["note_id"].isin(chosen)]
        return kept.groupby(["query_id", "note_id"], as_index=False).agg(entity_rank=("entity_rank", "min"))

    return pages.groupBy("query_id").applyInPandas(pick, "query_id string, note_id string, entity_rank int")


STEP = "struct<edge_id:string,from_id:string,to_id:string,direction:string,edge_type:string,confidence:double>"


def priority() -> list[Column]:
    """Order of evidence: score, then the path step by step, then the seed."""
    return [F.desc(F.round("score", 9)), F.transform("path", lambda s: F.struct(s["edge_id"].alias("a"), s["from_id"].alias("b"), s["to_id"].alias("c"), s["direction"].alias("d"))), "seed_id"]


def directed(edges: DataFrame, how: Expansion) -> DataFrame:
    """The edges that an expansion may take, once for each note that it can leave by them."""
    ends = both_directions(edges.filter(F.col("edge_type").isin(*how.edge_types) & (F.coalesce("confidence", F.lit(1.0)) >= how.least_confidence)))
    if not (how.outbound and how.inbound):
        ends = ends.filter(F.col("direction") == ("out" if how.outbound else "in"))
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return ends.select(F.col("note_id").alias("__from"), "other_id", "direction", F.col("id").alias("edge_id"), "edge_type", sure.alias("sure"), "confidence")


def best_ends(ends: DataFrame, how: Expansion) -> DataFrame:
    """Of each note's edges those that a step can take whatever its path: what a query reads of a hub is bounded.

    A step takes the first ``fanout`` edges of a type to notes that its path hasn't visited.
    It has visited two at most, and of edges to one note only the first ``fanout`` can be
    taken, so those to one note beyond that go, and of what is left the first three times
    ``fanout`` of each note and type are enough. Both limits are applied before the shuffle,
    too, so no task gets all edges of a hub.
    """
    order = [F.desc_nulls_last("confidence"), "edge_id"]
    ends = first_per(ends, ["__from", "edge_type", "other_id"], order, how.fanout, "__parallel")
    return first_per(ends, ["__from", "edge_type"], order, (MOST_HOPS + 1) * how.fanout, "__place").drop("__parallel", "__place")


def adjacency(edges: DataFrame, how: Expansion = Expansion()) -> DataFrame:
    """The bounded edges of every note, to be kept (``storage.Versions``) for many expansions with these options."""
    return best_ends(directed(edges, how), how)


def expand(seeds: DataFrame, edges: DataFrame, how: Expansion = Expansion(), anchors: DataFrame | None = None, adjacent: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, hops, seed_id, path of the graph candidates of each query.

    ``seeds`` (query_id, note_id, entity_rank) are candidates themselves; ``anchors``
    (query_id, note_id) only start paths. A hop keeps the best edges per table and per
    note, then the best state per neighbour; the candidates are the best of old and new
    up to their number, and only states whose note is among them go on. Each step's rows
    (bounded per query) are written to the shared folder, as the next step reads them twice.
    ``adjacent`` is what ``adjacency`` gave for these edges and options, if a caller keeps it.
    """
    start = seeds.select("query_id", F.col("note_id").alias("id"), "entity_rank", F.lit(True).alias("entity"))
    if anchors is not None:
        more = anchors.select("query_id", F.col("note_id").alias("id")).join(start.select("query_id", "id"), ["query_id", "id"], "left_anti")
        start = start.unionByName(more.withColumns({"entity_rank": F.lit(2147483647), "entity": F.lit(False)}))
    start = first_per(start, ["query_id"], ["entity_rank", "id"], how.candidates)
    start = written(start, "graph-seeds")
    frontier = start.select(
        "query_id", "id", F.lit(how.seed_score).alias("score"), F.col("id").alias("seed_id"), F.array().cast(f"array<{STEP}>").alias("path"), F.array("id").alias("visited"), "entity", F.lit(0).alias("hops")
    )
    candidates = frontier.filter("entity").drop("entity")
    frontier = frontier.drop("entity")
    ends = directed(edges, how) if adjacent is None else adjacent
    for hop in range(1, min(how.hops, MOST_HOPS) + 1):
        near = ends
        if adjacent is None:  # of the notes that are left now only
            near = best_ends(ends.join(frontier.select(F.col("id").alias("__from")).distinct(), "__from", "left_semi"), how)
        moves = near.join(frontier, F.col("__from") == F.col("id")).filter(~F.array_contains("visited", F.col("other_id")))
        moves = first_per(moves, ["query_id", "id", "edge_type"], [F.desc_nulls_last("confidence"), "edge_id"], how.fanout, "__table")
        moves = moves.withColumn("next", F.col("score") * how.decay * F.col("sure"))
        moves = first_per(moves, ["query_id", "id"], [F.desc(F.round("next", 9)), "edge_id", "other_id"], how.fanout, "__node")
        step = F.struct("edge_id", F.col("id").alias("from_id"), F.col("other_id").alias("to_id"), "direction", "edge_type", F.col("sure").alias("confidence")).cast(STEP)
        states = moves.select(
            "query_id", F.col("other_id").alias("id"), F.col("next").alias("score"), "seed_id", F.array_append("path", step).alias("path"), F.array_append("visited", F.col("other_id")).alias("visited"), F.lit(hop).alias("hops"), "edge_id"
        )
        states = first_per(states, ["query_id", "id"], [F.desc(F.round("score", 9)), "edge_id", "id"], 1, "__state").drop("__state", "edge_id")
        states = written(states, "graph-states")
        best = first_per(candidates.unionByName(states), ["query_id", "id"], priority(), 1, "__best").drop("__best")
        candidates = first_per(best, ["query_id"], [*priority(), "id"], how.candidates, "__kept").drop("__kept")
        candidates = written(candidates, "graph-candidates")
        frontier = states.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return candidates.drop("visited")


def graph_search(queries: DataFrame, entities: DataFrame, mentions: DataFrame, visible: DataFrame, edges: DataFrame, how: Expansion = Expansion(), anchors: DataFrame | None = None) -> DataFrame:
    """Entities of a query, their notes, and what those lead to."""
    matches = entity_matches(queries, entities, how.seed_entities)
    seeds = pick_seeds(seed_pages(matches, mentions, visible, how.seed_notes), how.seed_notes)
    return expand(seeds, edges, how, anchors)


def merge_hits(hits: DataFrame, candidates: DataFrame, note_weight: float = 1.0) -> DataFrame:
    """Hybrid hits keep their score and gain evidence; notes only the graph has are added."""
    found = candidates.select("query_id", "id", F.col("score").alias("graph_score"), "hops", "seed_id", "path")
    both = hits.join(found, ["query_id", "id"], "full_outer")
    return both.withColumn("score", F.coalesce("score", F.col("graph_score") * note_weight))


def provenance(links: DataFrame) -> DataFrame:
    """Per note the sorted distinct records that it came from."""
    return links.groupBy("note_id").agg(F.sort_array(F.collect_set("origin_id")).alias("origins"))
