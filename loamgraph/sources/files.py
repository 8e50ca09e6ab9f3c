"""Files as a table: admissible sources and manifests under a folder, with digests, through Spark's file reader."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import language_of, line_count, project_identity
from loamgraph.sources.config import Config

# Folders never read, names that may hold credentials, generated names, and what is read.
HARD_DIRECTORIES = (".git", "node_modules", "dist", "build", ".next", "coverage", ".turbo", ".cache", ".yarn", "vendor", "generated", "__generated__")
SENSITIVE = r"(?i)(^|/)(\.env(?:\..*)?|.*\.(?:pem|key|p12|pfx)|credentials(?:\..*)?|secrets?(?:\..*)?)$"
GENERATED = r"\.min\.js$|\.generated\.[jt]s$"
SOURCES = r"\.(?:[cm]?[jt]sx?)$"
MANIFESTS = r"(^|/)(package|function|host|tsconfig[^/]*)\.json$"


def admissible(path: Column) -> Column:
    """Whether a path may be read: not sensitive, not under a hard folder, not generated, and a source or JSON."""
    parts = F.split(F.lower(path), "/", -1)
    return ~path.rlike(SENSITIVE) & ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in HARD_DIRECTORIES])) & ~path.rlike(GENERATED) & path.rlike(SOURCES + r"|\.json$")


def glob_to_regex(pattern: str) -> str:
    """A glob with ``**``, ``*``, ``?`` and ``{a,b}`` as a regular expression of whole paths."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if pattern.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "{":
            depth += 1
            out += "(?:"
        elif c == "}" and depth:
            depth -= 1
            out += ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".^$+()[]|\\" else c)
        i += 1
    return f"^{out}$"


def discover(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, hash, language, bytes, lines, content, manifest) of the files admitted, paths relative to ``root``.

    Files over the size limit are left out; ignore patterns are the configuration's.
    """
    config = config or Config()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace("path", r"^\w+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.regexp_replace(F.expr("substring(p, instr(p, base) + length(base))"), r"\\", "/")
    rows = files.select(bare.alias("p"), F.lit(base).alias("base"), "length", "content").withColumn("path", path)
    rows = rows.where(admissible(F.col("path")) & (F.col("length") <= config.limits.max_file_bytes))
    any_of = lambda globs: "|".join(glob_to_regex(g) for g in globs)
    rows = rows.where(F.col("path").rlike(any_of(config.include)))
    if config.exclude:
        rows = rows.where(~F.col("path").rlike(any_of(config.exclude)))
    text = F.col("content").cast("string")
    manifest = F.col("path").rlike(MANIFESTS)
    found = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if found[0] > config.limits.max_files or found[1] > config.limits.max_total_bytes:
        raise ValueError(f"{found[0]} files of {found[1]} bytes are more than the configuration allows")
    return rows.select("path", F.sha2("content", 256).alias("hash"), language_of("path").alias("language"), F.col("length").alias("bytes"), line_count(text).alias("lines"), text.alias("content"), manifest.alias("manifest"))


def config_hash(files: DataFrame, config: Config) -> DataFrame:
    """(config_hash): SHA-256 over the configuration and the digests of all manifests, by path; one row."""
    settings = json.dumps(dataclasses.asdict(config), sort_keys=True)
    listed = F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash")))
    return files.where("manifest").agg(F.sha2(F.concat_ws("\n", F.lit(settings), F.array_join(listed, "\n")), 256).alias("config_hash"))


def scenarios(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """(id, category, task, baselineFiles, baselineSearchCalls, requiredSymbols, maxTokens) of a suite of scenarios as
    JSON, an array or lines; one that breaks its limits, or too many, is an error."""
    kind = "id string, category string, task string, baselineFiles array<string>, baselineSearchCalls int, requiredSymbols array<string>, maxTokens int"
    rows = spark.read.schema(kind).option("multiLine", "true").json(path)
    sound = F.col("id").isNotNull() & F.col("task").isNotNull() & (F.length("task") <= 4000) & (F.size("requiredSymbols") > 0) & F.col("maxTokens").between(128, 32_000) & (F.col("baselineSearchCalls") >= 0)
    first = rows.limit(most + 1).select(F.coalesce(sound, F.lit(False)).alias("ok")).collect()  # a suite is small by definition
    if len(first) > most or not all(r.ok for r in first):
        raise ValueError("a scenario breaks its limits, or there are too many")
    return rows


def projects(folders: DataFrame, most: int = 64) -> DataFrame:
    """(project, path) of folders (path, real_path, is_repository, child): a repository is one project, else each of its
    children that is one; of folders that are one place by their real path the first holds."""
    own = folders.where("is_repository and child is null")
    inner = folders.where("is_repository and child is not null").join(own.select("path"), "path", "left_anti")
    all_of = own.select("real_path", "path").unionByName(inner.select("real_path", F.concat_ws("/", "path", "child").alias("path")))
    once = all_of.groupBy("real_path").agg(F.min("path").alias("path")).orderBy("path").limit(most)
    return once.select(project_identity("real_path").alias("project"), "path")


def packages(files: DataFrame) -> DataFrame:
    """(path, directory, name, dependencies) of ``package.json`` files."""
    kind = "name string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, scripts map<string,string>"
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("d", F.from_json("content", kind))
    keys = [F.coalesce(F.map_keys(f"d.{k}"), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies", "peerDependencies")]
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    return rows.select("path", directory.alias("directory"), F.col("d.name").alias("name"), F.array_sort(F.array_distinct(F.concat(*keys))).alias("dependencies"))


def package_edges(found: DataFrame) -> DataFrame:
    """(source, target) directories of packages that depend on one another by name; names used twice link nothing."""
    one = found.groupBy("name").agg(F.count("*").alias("n"), F.min("directory").alias("target")).where("n = 1").select("name", "target")
    wants = found.select(F.col("directory").alias("source"), F.explode("dependencies").alias("name"))
    return wants.join(one, "name").where("source <> target").select("source", "target").distinct()


# Fixed value: the names of scripts that check a repository.
CHECKS = r"^(?:test|check|typecheck|lint|build)(?::[\w.-]+)?$"


def repository_checks(files: DataFrame) -> DataFrame:
    """(directory, script, command): the scripts of packages that check the repository."""
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).withColumn("d", F.from_json("content", "scripts map<string,string>"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    return rows.select(directory.alias("directory"), F.explode("d.scripts").alias("script", "command")).where(F.col("script").rlike(CHECKS))


def function_bindings(files: DataFrame) -> DataFrame:
    """Endpoints of ``function.json`` files: (file, protocol, direction, method, address, channel_kind, setting)."""
    kind = "bindings array<struct<type:string,direction:string,methods:array<string>,route:string,queueName:string,topicName:string,connection:string,topicEndpointUri:string>>"
    rows = files.where(F.col("path").rlike(r"(^|/)function\.json$")).withColumn("d", F.from_json("content", kind))
    b = rows.select(F.col("path").alias("file"), F.explode(F.slice("d.bindings", 1, 200)).alias("b")).withColumn("t", F.lower("b.type"))
    protocol = F.when(F.col("t") == "httptrigger", "http").when(F.col("t").startswith("servicebus"), "service-bus").when(F.col("t").startswith("eventgrid"), "event-grid").when(F.col("t").isin("queue", "queuetrigger"), "storage-queue")
    http = F.col("protocol") == "http"
    safe = lambda c: F.when((F.length(c) <= 500) & ~F.col(c).rlike("[;=]"), F.col(c))
    direction = F.when(http, "provide").when(F.col("t").endswith("trigger"), "subscribe").when(F.col("b.direction") == "out", "publish").otherwise("subscribe")
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    address = F.when(http, F.when(F.col("b.route").isNull(), folder).otherwise(safe("b.route"))).otherwise(F.coalesce(safe("b.queueName"), safe("b.topicName"), F.when(F.col("protocol") == "event-grid", "*")))
    channel = F.when(safe("b.queueName").isNotNull(), "queue").when(safe("b.topicName").isNotNull(), "topic")
    methods = F.when(http, F.coalesce(F.transform(F.slice("b.methods", 1, 10), F.upper), F.array(F.lit("*")))).otherwise(F.array(F.lit(None).cast("string")))
    rows = b.withColumn("protocol", protocol).where("protocol is not null").withColumn("method", F.explode(methods))
    return rows.select("file", "protocol", direction.alias("direction"), "method", address.alias("address"), channel.alias("channel_kind"), F.coalesce(safe("b.connection"), safe("b.topicEndpointUri")).alias("setting"))


def host_prefixes(files: DataFrame) -> DataFrame:
    """(directory, prefix) of ``host.json`` files; ``api`` where none is named."""
    rows = files.where(F.col("path").rlike(r"(^|/)host\.json$"))
    prefix = F.coalesce(F.get_json_object("content", "$.extensions.http.routePrefix"), F.lit("api"))
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    return rows.select(directory.alias("directory"), prefix.alias("prefix"))
