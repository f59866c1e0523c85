"""Plain questions: what is asked, about which nodes, and the sections that answer it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import divergence, incidents as inc, rootcause, traverse
from .graph import Graph, materialise, side

# Intents in order (the first whose pattern occurs decides), and words that name no node.
INTENTS = (
    ("root-cause", r"\b(why|root[\s-]?cause|failing|fail(?:s|ed)?|breaking|broke(?:n)?|crash(?:ing|ed)?|throw(?:ing|s)?|culprit|5\d\d)\b"),
    ("blast-radius", r"\b(blast|break[\s-]?if|breaks[\s-]?if|impact|downstream|dependents?|redeploy|who\s+(?:uses|calls|depends)|what\s+depends\s+on|affect(?:s|ed)?)\b"),
    ("divergence", r"\b(diverg\w*|weird|mismatch|drift|out\s+of\s+sync|inconsistent|disagree\w*|declared\s+vs|anything\s+wrong)\b"),
    ("incidents", r"\b(incidents?|recent\s+(?:errors?|failures?)|error\s+history|failure\s+history)\b"),
    ("observed", r"\b(at\s+runtime|in\s+prod(?:uction)?|actually\s+call\w*|really\s+call\w*|observed|runtime\s+traffic)\b"),
    ("dependencies", r"\b(depend\w*|calls?|uses?|imports?|relies\s+on|needs?)\b"),
)
STOP_WORDS = tuple(
    "the a an is are was were be been being of to in on at by for with and or but if as this that these those it its do does did has have had what which who whom how when where my "
    "me i we you they them from into about would will can could should anything everything something all any some no not so up out over get got show tell explain find give happen "
    "happens happening here there system code service node graph".split()
)
INTENT_WORDS = tuple(
    "why root cause failing fail fails failed breaking broke broken crash crashing crashed throw throwing throws culprit blast radius break breaks impact downstream dependent dependents "
    "redeploy affect affects affected diverge divergence divergences weird mismatch drift inconsistent disagree declared observed incident incidents recent errors error failures failure "
    "history runtime production prod traffic actually really depend depends dependency dependencies call calls use uses using import imports relies rely needs need sync".split()
)


def intent(question: Column) -> Column:
    out = None
    for name, pattern in INTENTS:
        out = (F.when if out is None else out.when)(F.lower(question).rlike(pattern), name)
    return out.otherwise("overview")


def tokens(text: Column, drop_common: bool = True) -> Column:
    """Distinct words of two characters or more, camel case split, common words dropped."""
    split = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    words = F.regexp_extract_all(F.lower(split), F.lit("[a-z0-9]+"), F.lit(0))
    words = F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))
    if not drop_common:
        return words
    return F.array_except(words, F.array(*(F.lit(w) for w in dict.fromkeys(STOP_WORDS + INTENT_WORDS))))


def _body(node: Column) -> Column:
    """What an id says behind its type."""
    return F.regexp_replace(node, "^[^:]*:", "")


def entity_scores(nodes: DataFrame, questions: DataFrame, key: str, question: str) -> DataFrame:
    """(key, node, score, via): nodes that a question names or shares a word with, scored.

    A node whose id (behind the type) or name stands in the question scores 0.9
    or more, others by the share of the question's words they have.  Words are
    joined, and names are joined with the question's substrings, so a question
    meets only nodes it has to do with.  Frontier nodes are left out.  What is
    asked is cut and goes to the nodes, which are never sent through the driver.
    """
    asked = materialise(questions.select(key, F.lower(question).alias("_text"), tokens(F.col(question)).alias("_asked")))
    name = F.coalesce("name", "id")
    # Null for a table without types.
    kind = F.col("type") if "type" in nodes.columns else F.lit("")
    known = nodes.filter(F.coalesce(kind != "FrontierNode", F.lit(True))).select(F.col("id").alias("node"), _body(F.col("id")).alias("_body"), name.alias("_name"))
    words = known.select("node", tokens(F.concat_ws(" ", "_body", "_name"), drop_common=False).alias("_known"), tokens(F.col("_name"), drop_common=False).alias("_named"))
    words = words.select("node", F.explode("_known").alias("t"), "_named").select("node", "t", F.array_contains("_named", F.col("t")).alias("_label"))
    shared = side(asked.select(key, F.explode("_asked").alias("t"))).join(words, "t").groupBy(key, "node").agg(F.count(F.lit(1)).alias("_n"), F.max("_label").alias("_label"))
    # All substrings of two characters or more, for names of any length.
    starts = asked.select(key, "_text", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_text") - 1))).alias("_at"))
    parts = starts.select(key, F.explode(F.expr("transform(sequence(2, greatest(2, length(_text) - _at + 1)), n -> substring(_text, _at, n))")).alias("t")).filter("length(t) >= 2").distinct()
    called = known.select("node", F.explode(F.array_distinct(F.array(F.lower("_body"), F.lower("_name")))).alias("t")).filter("length(t) >= 2")
    named = side(materialise(parts)).join(called, "t").select(key, "node").distinct().withColumn("_called", F.lit(True))
    joined = shared.join(named, [key, "node"], "full").join(side(asked.select(key, F.size("_asked").alias("_words"))), key)
    coverage = F.when(F.col("_words") > 0, F.coalesce("_n", F.lit(0)) / F.col("_words")).otherwise(0.0)
    by_name = F.coalesce("_called", F.lit(False))
    score = F.when(by_name, F.greatest(F.lit(0.9), coverage)).otherwise(F.least(F.lit(0.85), 0.3 + 0.7 * coverage))
    via = F.when(by_name, "id").when(F.coalesce("_label", F.lit(False)), "label").otherwise("token")
    return joined.select(key, "node", F.round(F.least(F.lit(1.0), score), 6).alias("score"), via.alias("via"))


def matched_entities(scores: DataFrame, key: str, top: int = 3) -> DataFrame:
    """The best nodes of each question: by score, then by how they matched, then id.

    A task keeps ``top`` nodes of each question before they meet.
    """
    via = F.when(F.col("via") == "id", 3).when(F.col("via") == "label", 2).when(F.col("via") == "token", 1).otherwise(0)
    best = Window.partitionBy(key).orderBy(F.desc("score"), F.desc(via), "node")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select(key, "rank", "node", F.round("score", 3).alias("score"), "via")


def shape(graph: Graph) -> DataFrame:
    """(kind, name, n): nodes by type, edges by provenance and type."""
    nodes = graph.nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    edges = graph.valid_edges()
    one = edges.groupBy(F.lit("provenance").alias("kind"), F.col("provenance").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    two = edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.union(one).union(two)


def busiest(graph: Graph, top: int = 6) -> DataFrame:
    """Services with most direct dependencies, containment aside."""
    services = graph.nodes.filter("type = 'ServiceNode'").select(F.col("id").alias("near"))
    best = graph.best_edges("down").filter("edge.type <> 'CONTAINS'").join(services, "near", "left_semi")
    return best.groupBy(F.col("near").alias("service")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "service").limit(top)


def unobserved(graph: Graph) -> DataFrame:
    """Services that no observed edge touches."""
    seen = graph.valid_edges().filter("provenance = 'OBSERVED'")
    ends = seen.select(F.col("source").alias("id")).union(seen.select(F.col("target").alias("id"))).distinct()
    return graph.nodes.filter("type = 'ServiceNode'").join(ends, "id", "left_anti").select("id")


# The sections of an answer about a node, in order, by intent.
SECTIONS = {
    "root-cause": ("root-cause", "incidents", "blast", "observed", "divergence"),
    "blast-radius": ("blast", "dependencies", "observed", "incidents"),
    "dependencies": ("dependencies", "observed", "blast"),
    "observed": ("observed", "dependencies", "incidents"),
    "incidents": ("incidents", "root-cause", "observed"),
    "divergence": ("divergence", "observed", "dependencies", "incidents"),
    "overview": ("dependencies", "observed", "blast", "incidents", "divergence"),
}


def _section(kind: str, graph: Graph, node: str, incidents: DataFrame) -> DataFrame:
    if kind == "root-cause":
        return rootcause.navigated_causes(graph, [node], incidents)
    if kind == "blast":
        return traverse.blast_radius(graph, [node])
    if kind == "observed":
        return traverse.observed_dependencies(graph, [node])[0]
    if kind == "dependencies":
        return traverse.transitive_dependencies(graph, [node])
    return inc.history(incidents, node) if kind == "incidents" else divergence.divergences(graph, node=node)


def ask(graph: Graph, question: str, incidents: DataFrame) -> dict:
    """{intent, entities, scope, sections} of a question.

    Sections are DataFrames in the order of ``SECTIONS`` about the node that the
    question names best, without those that say nothing.  If it names none,
    divergences, incidents and overviews are answered for the whole graph, and
    other questions not at all (scope None).
    """
    spark = graph.spark
    asked = spark.createDataFrame([(1, question)], "q int, text string")
    kind = asked.select(intent(F.col("text"))).first()[0]
    names = [r["node"] for r in matched_entities(entity_scores(graph.nodes, asked, "q", "text"), "q").collect()]
    scope, made = None, {}
    if names:
        scope, made = "node", {k: _section(k, graph, names[0], incidents) for k in SECTIONS[kind]}
    elif kind == "divergence":
        scope, made = "global", {"divergence": divergence.divergences(graph).limit(3)}
    elif kind == "incidents":
        scope, made = "global", {"incidents": inc.rollup(incidents)}
    elif kind == "overview":
        found = divergence.divergences(graph).agg(F.count(F.lit(1)).alias("n"))
        scope, made = "global", {"shape": shape(graph), "busiest": busiest(graph), "incidents": inc.rollup(incidents), "divergence": found}
    return {"intent": kind, "entities": names, "scope": scope, "sections": {k: df for k, df in made.items() if not df.isEmpty()}}
