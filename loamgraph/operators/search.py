"""Full-text search, ranking and retrieval of source, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.functions.text import overlap, words

# BM25's constants, the weights of the indexed fields and of the ranking signals.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"identity": 4.0, "signature": 1.0, "documentation": 3.0, "effects": 2.0}
RANK_WEIGHTS = {"name": 0.38, "path": 0.12, "signature": 0.1, "proximity": 0.18, "entry": 0.06, "tests": 0.06, "public": 0.03, "concept": 0.05, "git": 0.02}
MOST_TERMS = 30


def index_terms(df: DataFrame, id: str, fields: dict[str, Column | str]) -> DataFrame:
    """(id, field, term, tf): the inverted index; a field is one of ``FIELD_WEIGHTS``."""
    field = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).alias("text")) for n, c in fields.items()]))
    rows = df.select(F.col(id).alias("id"), field.alias("f")).select("id", "f.field", F.explode(words("f.text")).alias("term"))
    return rows.groupBy("id", "field", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, id, score, rank) of the best rows for each query (query_id, query).

    Any of the query's first distinct terms may match, as the beginning of a word. A term's frequency is the weighted
    sum over fields and matched words; length is that of all fields.

    What a term gives a row does not depend on the query, so it is computed once for all queries, and queries that share
    their matching terms share their best rows. Sizes that grow with the index or the queries are estimated far too small from
    compressed files, hence the merge joins: else they may be broadcast through the driver.
    """
    lengths = index.groupBy("id").agg(F.sum("tf").alias("length"))
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    terms = queries.select("query_id", F.explode(F.slice(F.array_distinct(words("query")), 1, MOST_TERMS)).alias("wanted"))
    # a wanted term's first letters join; whole beginnings are compared after
    first = F.array_distinct(F.array(*[F.substring("term", 1, n) for n in (1, 2, 3)]))
    vocabulary = index.select("term").distinct().select("term", F.explode(first).alias("_first"))
    wanted = terms.select("wanted").distinct().withColumn("_first", F.substring("wanted", 1, 3))
    expanded = wanted.join(vocabulary.hint("merge"), "_first").where(F.col("term").startswith(F.col("wanted"))).select("wanted", "term")
    weight = reduce(lambda acc, kv: acc.when(F.col("field") == kv[0], kv[1]), FIELD_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    hits = index.hint("merge").join(expanded, "term").groupBy("wanted", "id").agg(F.sum(F.col("tf") * weight).alias("wtf"))
    spread = hits.groupBy("wanted").agg(F.count("wtf").alias("df"))  # of the same columns, so that hits are computed once
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    parts = hits.join(spread, "wanted").join(lengths.hint("merge"), "id").crossJoin(F.broadcast(size)).select("wanted", "id", part.alias("part"))
    asked = terms.hint("merge").join(spread.select("wanted"), "wanted").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("wanted")), " ").alias("_set"))
    sets = asked.select("_set").distinct().select("_set", F.explode(F.split("_set", " ")).alias("wanted"))
    score = parts.join(sets, "wanted").groupBy("_set", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("_set").orderBy(F.desc("score"), "id"))
    best = score.withColumn("rank", rank).where(F.col("rank") <= top)
    listed = best.groupBy("_set").agg(F.collect_list(F.struct("id", "score", "rank")).alias("_best"))
    found = asked.join(listed, "_set").select("query_id", "_best").repartition("query_id")  # many queries may share a set
    return found.select("query_id", F.explode("_best").alias("b")).select("query_id", "b.*")


def term_coverage(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, hits): how many of a query's terms each row has, as whole words."""
    terms = queries.select("query_id", F.explode(F.array_distinct(words("query"))).alias("term"))
    return index.select("id", "term").distinct().join(terms, "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"))


def rank_score(terms: str, name_tokens: str, path_tokens: str, signature_tokens: str, distance: Column, entry: Column, kind: Column, strategy: Column, public: Column, concept: Column | None = None, git: Column | None = None, weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of a candidate's signals, between 0 and 1, to four places."""
    w = RANK_WEIGHTS | (weights or {})
    if not set(w) <= set(RANK_WEIGHTS) or any(not 0 <= x <= 10 for x in w.values()):
        raise ValueError("weights must be of known signals and between 0 and 10")
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    signals = {
        "name": overlap(terms, name_tokens),
        "path": overlap(terms, path_tokens),
        "signature": overlap(terms, signature_tokens),
        "proximity": F.coalesce(1 / (distance + 1), F.lit(0.0)),
        "entry": one(entry),
        "tests": F.when(kind != "test", 0.0).when(strategy == "tests", 1.0).otherwise(0.5),
        "public": one(public),
        "concept": F.lit(0.0) if concept is None else F.coalesce(concept, F.lit(0.0)),
        "git": F.lit(0.0) if git is None else F.coalesce(git, F.lit(0.0)),
    }
    total = sum(w.values())
    if not total:
        return F.lit(0.0)
    mean = reduce(lambda a, b: a + b, [signals[k] * w[k] for k in RANK_WEIGHTS]) / total
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 4)


def lines_of(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line, content), lines from 1."""
    split = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("_at", "content")
    return df.select(F.col(id).alias("id"), split).select("id", (F.col("_at") + 1).alias("line"), "content")


def text_search(df: DataFrame, id: str, text: str, query: str, case_sensitive: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(id, line, col, snippet) of lines that hold ``query`` literally, in order; a page of them with ``limit``."""
    if not query:
        raise ValueError("the query is empty")
    fold = (lambda c: c) if case_sensitive else F.lower
    rows = df.where(fold(F.col(text)).contains(query if case_sensitive else query.lower()))
    at = F.instr(fold(F.col("content")), query if case_sensitive else query.lower())
    hits = lines_of(rows, id, text).withColumn("col", at).where("col > 0").select("id", "line", "col", F.substring(F.trim("content"), 1, 240).alias("snippet"))
    if limit is None:
        return hits
    return hits.orderBy("id", "line").offset(offset).limit(limit)


def enclosing(points: DataFrame, spans: DataFrame, size: int = 64) -> DataFrame:
    """The smallest span around each point: points (file, line, ...), spans (file, id, start_line, end_line).

    Lines are dealt into strips of ``size``; a span joins by the strips it covers, so no file meets itself in full.
    Ties go to the smaller id; points in no span are left out.
    """
    strip = F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size)))
    laid = spans.where("start_line is not null and end_line >= start_line").select("file", "id", "start_line", "end_line", strip.alias("_strip"))
    near = points.withColumn("_strip", F.floor(F.col("line") / size)).join(laid, ["file", "_strip"]).where("line between start_line and end_line")
    keys = [F.col(f"`{c}`") for c in points.columns]
    best = near.groupBy(*keys).agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "id")).alias("best"))
    return best.select(*points.columns, F.col("best.id").alias("id"), F.col("best.span").alias("span"))


def excerpt_window(df: DataFrame, id: str, text: str, query: str, size: int = 20) -> DataFrame:
    """(id, start_line, score): the window of ``size`` lines with the greatest sum of 1 / sqrt(df) of its lines' terms.

    ``df`` of a term is the number of lines of the text that hold it; the first of equal windows holds.
    """
    terms = F.array_distinct(words(F.lit(query)))
    holds = lambda c: F.exists(terms, lambda t: F.contains(F.lower(c), t))  # noqa: E731  what holds a word holds its letters
    own = F.when(holds(F.col("content")), F.array_intersect(F.array_distinct(words("content")), terms))
    held = lines_of(df.where(holds(F.col(text))), id, text).select("id", "line", F.explode_outer(own).alias("term"))
    spread = held.where("term is not null").groupBy("id", "term").agg(F.count("*").alias("df"))
    weight = F.coalesce(1 / F.sqrt("df"), F.lit(0.0))
    lines = held.join(spread, ["id", "term"], "left").groupBy("id", "line").agg(F.sum(weight).alias("weight"))
    ahead = Window.partitionBy("id").orderBy("line").rowsBetween(0, size - 1)
    sums = lines.withColumn("score", F.round(F.sum("weight").over(ahead), 9))
    best = sums.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), "line")).alias("b"))
    return best.select("id", F.col("b.line").alias("start_line"), (-F.col("b.less")).alias("score")).where("score > 0")


def file_slice(df: DataFrame, id: str, text: str, start: int, end: int, hash: str | None = None, expected: str | None = None) -> DataFrame:
    """(id, start, end, content): a range of lines, checked against an expected SHA-256 if one is named."""
    if not 1 <= start <= end or end - start > 1000:
        raise ValueError("a slice is of 1 to 1001 lines")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    content = F.array_join(F.slice(lines, start, end - start + 1), "\n")
    if expected is not None:
        fresh = F.sha2(F.col(text), 256) == F.col(expected)
        content = F.when(fresh, content).otherwise(F.raise_error(F.concat(F.lit("Stale index: "), F.col(id).cast("string"))))
    return df.select(F.col(id).alias("id"), F.lit(start).alias("start"), F.least(F.lit(end), F.size(lines)).alias("end"), content.alias("content"))


TRACE = r"^\s*at (?:(?:async )?(.+?) \()?(.+?):(\d+):(\d+)\)?\s*$"


def trace_frames(df: DataFrame, id: str, trace: str, most: int = 20) -> DataFrame:
    """(id, frame, function, file, line, col) of the first stack frames of a trace."""
    lines = lines_of(df, id, trace).where(F.col("content").rlike(TRACE))
    part = lambda i: F.regexp_extract("content", TRACE, i)
    frame = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    file = F.regexp_replace(F.regexp_replace(part(2), r"\\", "/"), "^file://", "")
    found = lines.withColumn("frame", frame).where(F.col("frame") <= most)
    return found.select("id", "frame", F.nullif(part(1), F.lit("")).alias("function"), file.alias("file"), part(3).cast("int").alias("line"), part(4).cast("int").alias("col"))


IDENTIFIER = r"[\w$]+(?:\.[\w$]+)+"


def exact_identifiers(tasks: DataFrame, id: str, task: str) -> DataFrame:
    """(id, identifier): the dotted identifiers that a task names, each once."""
    return tasks.select(F.col(id).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(task, F.lit(IDENTIFIER), F.lit(0)))).alias("identifier"))


def candidate_score(inherited: Column, ranked: Column, lexical: Column, distance: Column, kind: Column, exact: Column, named: Column, stem: Column) -> Column:
    """A candidate's score in a context, at most 1: the better of its own and its inherited one (properties not asked for
    count for two fifths), a quarter of its lexical one if it was reached along the graph, and more if the task names it
    exactly, by its name, or by its name's stem."""
    property = (kind == "property") & ~exact
    base = F.greatest(inherited, ranked) * F.when(property, 0.4).otherwise(1.0)
    bonus = F.when(exact, 0.5).when(~property & named, 0.2).when(~property & stem, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.when(distance > 0, lexical * 0.25).otherwise(0.0) + bonus)


def stemmed_index(df: DataFrame, id: str, fields: dict[str, Column | str]) -> DataFrame:
    """``index_terms`` by the stems of words."""
    from loamgraph.functions.text import stems

    rows = df
    for name, c in fields.items():
        text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
        rows = rows.withColumn(f"_s_{name}", F.array_join(stems(words(text)), " "))
    return index_terms(rows, id, {name: f"_s_{name}" for name in fields})


def stemmed_search(index: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """``bm25`` of a ``stemmed_index``: the queries' words are stemmed likewise, so forms of a word find one another."""
    from loamgraph.functions.text import stems

    return bm25(index, queries.withColumn("query", F.array_join(stems(words("query")), " ")), top)
