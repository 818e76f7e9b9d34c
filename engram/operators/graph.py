"""Entities and relationships: merging, traversal, statistics, calls and the formats of export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import tasks
from engram.store import materialised, remove

#: Types that a count by type always lists.
ENTITY_TYPES = ("PERSON", "ORG", "GPE", "TECHNOLOGY", "CONCEPT", "EVENT", "DATE")


def dedupe_entities(mentions: DataFrame) -> DataFrame:
    """name, type, mentions (sum), confidence (greatest), id (smallest): one row for each name, whatever its case, and type."""
    key = [F.lower("name").alias("_name"), "type"]
    return mentions.groupBy(*key).agg(F.min("name").alias("name"), F.sum("mentions").alias("mentions"), F.max("confidence").alias("confidence"), F.min("id").alias("id")).select("name", "type", "mentions", "confidence", "id")


def upsert_entities(have: DataFrame, new: DataFrame) -> DataFrame:
    """have and new by name; a new row replaces an old one. Both: name, updated_at and the same other columns."""
    both = have.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("name").agg(F.max_by(F.struct(*have.columns), F.struct("_new", "updated_at", "id")).alias("r")).select("r.*")


def merge_counts(have: DataFrame, new: DataFrame) -> DataFrame:
    """created, merged: new nodes by name and type, without case; blank names are left out."""
    key = lambda df: df.where(F.trim("name") != "").select(F.lower(F.trim("name")).alias("n"), F.lower("type").alias("t")).distinct()
    found = key(new).join(key(have).withColumn("_old", F.lit(True)), ["n", "t"], "left")
    return found.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("merged"))


def add_relationships(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the rows of new (src, dst, type, strength) whose ends exist, whose type is a name and strength in [0, 1]."""
    ids = nodes.select("id").distinct()
    strength = F.coalesce("strength", F.lit(1.0))
    ok = new.withColumn("strength", strength).where(F.col("type").rlike("^[A-Z_][A-Z0-9_]*$") & F.col("strength").between(0, 1))
    ok = ok.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(ok.select(*edges.columns))


def _hops(edges: DataFrame) -> DataFrame:
    e = edges.select(F.xxhash64("src", "dst", "type").alias("edge"), "src", "dst", F.coalesce("strength", F.lit(1.0)).alias("strength"))
    return e.select("edge", F.col("src").alias("a"), F.col("dst").alias("b"), "strength").unionByName(e.where("src <> dst").select("edge", F.col("dst").alias("a"), F.col("src").alias("b"), "strength"))


def related(edges: DataFrame, start: str, depth: int = 2, score: str = "mean", types: list[str] | None = None, limit: int | None = 20) -> DataFrame:
    """id, strength, hops of what lies within depth undirected steps of start, best first.

    Paths use no edge twice. strength: mean or product of a path's strengths (null: 1); an id comes once for each
    distinct strength and length. Each step is a join of the paths so far with the edges; types filters them first.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be from 1 to 5")
    hops = _hops(edges if types is None else edges.where(F.col("type").isin(types)))
    paths = hops.where(F.col("a") == start).select(F.col("b").alias("id"), F.array("edge").alias("seen"), F.array("strength").alias("s"))
    out = paths
    for _ in range(depth - 1):
        step = paths.join(hops, F.col("id") == F.col("a")).where(~F.array_contains("seen", F.col("edge")))
        paths = step.select(F.col("b").alias("id"), F.concat("seen", F.array("edge")).alias("seen"), F.concat("s", F.array("strength")).alias("s"))
        out = out.unionByName(paths)
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s") if score == "mean" else F.aggregate("s", F.lit(1.0), lambda a, x: a * x)
    out = out.where(F.col("id") != start).select("id", F.round(total, 6).alias("strength"), F.size("s").cast("long").alias("hops")).distinct()
    return out if limit is None else out.orderBy(F.desc("strength"), "id", "hops").limit(limit)


def type_counts(nodes: DataFrame, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """type, n: every standard type, with 0 where there is none, and the others that occur."""
    every = nodes.sparkSession.createDataFrame([(t,) for t in types], "type string")
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("c"))
    return every.join(counts, "type", "full").select("type", F.coalesce("c", F.lit(0)).alias("n"))


def health(n_nodes: Column, n_entities: Column) -> Column:
    return F.when(n_nodes == 0, "Critical").when(n_entities == 0, "Warning").otherwise("Healthy")


def subgraph(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of some types, and the edges both of whose ends are among them."""
    n = nodes.where(F.col("type").isin(types))
    ids = n.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return n, e.select(*edges.columns)


def callers(calls: DataFrame, callee: str, limit: int = 100) -> DataFrame:
    """caller, line, type, args, n: who calls it, most calls first."""
    return _calls(calls.where(F.col("callee") == callee), "caller", limit)


def callees(calls: DataFrame, caller: str, limit: int = 100) -> DataFrame:
    return _calls(calls.where(F.col("caller") == caller), "callee", limit)


def _calls(calls: DataFrame, what: str, limit: int) -> DataFrame:
    g = [what, "line", "type", "args"]
    return calls.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *g).limit(limit)


def upsert_calls(have: DataFrame, new: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """One row for each (caller, callee, line); new ones win. functions (name): both ends must be among them."""
    if functions is not None:
        names = functions.select("name").distinct()
        new = new.join(names.withColumnRenamed("name", "caller"), "caller", "left_semi").join(names.withColumnRenamed("name", "callee"), "callee", "left_semi")
    both = have.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("caller", "callee", "line").agg(F.max_by(F.struct("type", "args"), F.struct("_new", "type", "args")).alias("r")).select("caller", "callee", "line", "r.type", "r.args")


#: Levels of a hierarchy that one job goes down.
_LEVELS = 8


def class_hierarchy(classes: DataFrame) -> DataFrame:
    """name, depth, n_children of classes (name, bases: array): the greatest depth from any root, whatever the order.

    Bases that aren't among the classes don't count. The classes of each level are those with a base in the one before;
    some levels are one job, whose rows are written, so none is computed twice. It ends where a level is empty, or is
    the same as an earlier one: then classes that still come are in or below a circle of bases, and have depth null.
    """
    spark = classes.sparkSession
    names = classes.select("name").distinct()
    links = classes.select("name", F.explode("bases").alias("base")).distinct()
    inner = materialised(links.join(names.select(F.col("name").alias("base")), "base", "left_semi").select("name", "base"), "bases")
    level = names.join(inner.select("name"), "name", "left_anti")
    tops = materialised(level if not level.isEmpty() else names, "levels")  # without a root, all are in or below circles
    parts, seen, start = [tops.select("name", F.lit(0).cast("long").alias("d"))], {}, 0
    level, endless = tops, None
    while endless is None:
        rows = []
        for i in range(start + 1, start + _LEVELS + 1):
            level = inner.join(level.select(F.col("name").alias("base")), "base").select("name").distinct()
            rows.append(level.withColumn("d", F.lit(i).cast("long")))
        made = rows[0]
        for r in rows[1:]:
            made = made.unionByName(r)
        made = materialised(made.coalesce(1) if start == 0 else made, "levels")
        parts.append(made)
        start += _LEVELS
        level = made.where(F.col("d") == start).select("name")
        state = tuple(level.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("name")), F.sum(F.xxhash64("name").cast("decimal(38,0)"))).first())
        if not state[0]:
            break
        endless = seen.get(state)
        seen[state] = start
    depths = parts[0]
    for p in parts[1:]:
        depths = depths.unionByName(p)
    depth = F.max("d") if endless is None else F.when(F.max("d") < endless, F.max("d"))
    depths = depths.groupBy("name").agg(depth.alias("depth"))
    children = inner.groupBy(F.col("base").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    out = names.join(depths, "name", "left").join(children, "name", "left").select("name", "depth", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"))
    out = materialised(out, "hierarchy")
    for p in (inner, tops, *parts[1:]):
        remove(spark, p.written_at)
    return out


# --- Formats of export --------------------------------------------------------------------------------------------------


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _quoted(c: str) -> Column:
    """A string as JSON has it."""
    j = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _lines(nodes: DataFrame, edges: DataFrame, node: Column, edge: Column) -> DataFrame:
    """kind, key, line for nodes (id, name, type, confidence) and edges (src, dst, type, strength)."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), node.alias("line"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("key"), edge.alias("line")))


def _edge_id() -> Column:
    return F.concat_ws("-", "src", "type", "dst").alias("id")


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON object for each node and edge."""
    n = F.struct("id", F.array(F.lit("Entity")).alias("labels"), F.struct("name", "type", "confidence").alias("properties"))
    e = F.struct(_edge_id(), F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.struct("strength").alias("properties"))
    return _lines(nodes, edges, F.to_json(n), F.to_json(e))


def cytoscape_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = F.struct(F.struct("id", F.col("name").alias("label"), "name", "type", "confidence").alias("data"))
    e = F.struct(F.struct(_edge_id(), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("label"), "strength").alias("data"))
    return _lines(nodes, edges, F.to_json(n), F.to_json(e))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def data(**values: Column) -> Column:
        return F.concat(*[F.coalesce(F.concat(F.lit(f'<data key="{k}">'), v, F.lit("</data>")), F.lit("")) for k, v in values.items()])

    n = F.concat(F.lit('<node id="'), _xml("id"), F.lit('">'), data(name=_xml("name"), type=_xml("type"), confidence=F.col("confidence").cast("string")), F.lit("</node>"))
    e = F.concat(F.lit('<edge id="'), _xml(_edge_id()), F.lit('" source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('">'), data(label=_xml("type"), strength=F.col("strength").cast("string")), F.lit("</edge>"))
    return _lines(nodes, edges, n, e)


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A statement for each node and edge; a type that isn't a plain name stands between backticks."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    name = F.when(F.col("type").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.col("type")).otherwise(F.concat(F.lit("`"), F.replace("type", F.lit("`"), F.lit("``")), F.lit("`")))
    n = F.concat(F.lit("CREATE (:Entity {id: "), _quoted("id"), F.lit(", name: "), _quoted("name"), F.lit(", type: "), _quoted("type"), F.lit(", confidence: "), number("confidence"), F.lit("});"))
    e = F.concat(F.lit("MATCH (a {id: "), _quoted("src"), F.lit("}), (b {id: "), _quoted("dst"), F.lit("}) CREATE (a)-[:"), name, F.lit(" {strength: "), number("strength"), F.lit("}]->(b);"))
    return _lines(nodes, edges, n, e)


FORMATS = {"json": json_lines, "cytoscape": cytoscape_lines, "graphml": graphml_lines, "cypher": cypher_lines}
_KEYS = "".join(f'<key id="{k}" for="{of}" attr.name="{k}" attr.type="{kind}"/>' for k, of, kind in (("name", "node", "string"), ("type", "node", "string"), ("confidence", "node", "double"), ("label", "edge", "string"), ("strength", "edge", "double")))
_FRAME = {
    "json": ('{"nodes":[', '],"edges":[', "]}", ","), "cytoscape": ('{"elements":{"nodes":[', '],"edges":[', "]}}", ","), "cypher": ("", "", "", ""),
    "graphml": (f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{_KEYS}<graph id="graph" edgedefault="directed">', "", "</graph></graphml>", ""),
}


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, kind: str) -> None:
    """Part files of lines, nodes before edges, between a head and a foot: the parts of a folder in order are one document."""
    head, middle, foot, comma = _FRAME[kind]
    spark = nodes.sparkSession
    lines = FORMATS[kind](nodes, edges).withColumn("o", F.when(F.col("kind") == "node", 1).otherwise(3))
    frame = spark.createDataFrame([(0, head), (2, middle), (4, foot)], "o int, line string").where("line <> ''").select("o", F.lit("").alias("key"), F.lit(0).alias("n"), "line")
    least = F.broadcast(lines.groupBy("o").agg(F.min("key").alias("least")))
    place = F.row_number().over(Window.partitionBy("o", "key").orderBy("line"))  # of rows that share a key
    parted = lines.withColumn("n", place).join(least, "o")
    alone = (F.col("key") == F.col("least")) & (F.col("n") == 1)
    parted = parted.select("o", "key", "n", F.when(alone, F.col("line")).otherwise(F.concat(F.lit(comma), F.col("line"))).alias("line"))
    parted.unionByName(frame).repartitionByRange("o", "key", "n").sortWithinPartitions("o", "key", "n").select("line").write.text(folder)


#: Bytes of input files for each task that forms pairs.
PAIR_BYTES = 2 << 20


def _parts(df: DataFrame) -> int:
    """Parts that keep what a task holds the same size: by the bytes of the files that df comes from."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 50)  # a table that isn't in files has no size
    return max(tasks(df.sparkSession), -(-known // PAIR_BYTES))


def cooccurrence(mentions: DataFrame, least: int = 2) -> DataFrame:
    """src, dst, n: entities that stand in so many chunks together. mentions: chunk_id, entity, deduplicated here.

    Pairs are formed inside each chunk's own array of entities, so no self-join on a hot entity is needed. Chunks are
    dealt to parts, pairs counted in each and then over all; parts grow in number with the input, not in size.
    """
    n = _parts(mentions)
    dealt = mentions.select("chunk_id", "entity", F.pmod(F.xxhash64("chunk_id"), F.lit(n)).alias("part")).repartition(n, "part")
    sets = dealt.groupBy("part", "chunk_id").agg(F.array_sort(F.collect_set("entity")).alias("e"))
    at = F.transform("e", lambda x, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda y: F.struct(x.alias("src"), y.alias("dst"))))
    pairs = sets.select("part", F.explode(F.flatten(at)).alias("p")).select("part", "p.*").groupBy("part", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("src", "dst", "n").repartition(n, "src", "dst").groupBy("src", "dst").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def capitalised_mentions(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, entity, n: runs of two or more capitalised words, a stand-in for a name tagger."""
    return docs.select(id, F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+(?: [A-Z][a-z]+)+)"), F.lit(1))).alias("entity")).groupBy(id, "entity").agg(F.count(F.lit(1)).alias("n"))


def ranked_entities(entities: DataFrame, least: float = 0.7, limit: int | None = None) -> DataFrame:
    out = entities.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "name")
    return out if limit is None else out.limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
